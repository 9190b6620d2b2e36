"""What the readers of a packet contribute: one table of signals, each with its kind as a bit.

A reader is allowed kinds of contribution, not fields. Facts of the whole packet are gathered in
a first pass; what hangs on them (continued notes, both halves of a receipt) is admitted in
a second one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions import text as T
from caseloom.operators import layout, notes
from caseloom.operators.layout import admit, scan_lines

#: Kinds of contribution.
KINDS = {k: 1 << n for n, k in enumerate(("fields", "literals", "flags", "note", "singletons", "reason_facts"))}
EVERYTHING = frozenset(KINDS)
SCHEMA = "case_id string, page int, seq long, kind int, name string, value string, engine string, source string"
#: A scan's place among its page's signals: readings, then lines; literals come behind all labelled lines.
READING, LITERAL = 10_000, 100_000_000
#: Names of risk flags, and the sentence that states one outright. Fixed values.
FLAG_NAMES = ("memory_tampering", "planetary_embargo", "active_warrant", "biohazard_red", "identity_conflict", "sponsor_mismatch", "illegible_biometrics", "rescinded_denial")
RESCINDED, RESCINDED_FLAG = "prior denial stamp rescinded", "rescinded_denial"
PANEL_MISSING, TRANSIT_REASON = "RISK PANEL MISSING", "transit class cannot authorize"
#: Titles of a biometric slip, and what a note calls a flag, as scans show them. Fixed values.
SLIP = r"(?i)B\s*[-—._]?\s*13\b|Biometric\s+Scan"
CALLED_FLAG = r"(?i)risk flag(?:\s+present)?\s*[:;.]\s*([a-z_]+)"
#: Amount and waiver code on a scanned receipt. Fixed values.
AMOUNT = r"(?i)am[o0]unt\W{0,4}\$?\s*([0-9,]+(?:[.,][0-9]{2})?)"
WAIVER = r"(?i)wa[il1]ver\s*c[o0]de\W{0,4}([a-z0-9/-]{2,20})"


def mask(kinds: frozenset[str]) -> int:
    """Kinds of contribution as one number."""
    return sum(KINDS[k] for k in kinds)


def _signal(kind: str | None, name: Column | str, value: Column, source: Column, behind: int = 0) -> Column:
    """One signal; typed pages have no kind, as nobody restricts them."""
    name = F.lit(name) if isinstance(name, str) else name
    return F.struct(F.lit(KINDS[kind] if kind else 0).alias("kind"), name.alias("name"), value.cast("string").alias("value"), source.alias("source"), F.lit(behind).cast("long").alias("behind"))


def _each(kind: str | None, name: str, values: Column, source: Column, behind: int = 0) -> Column:
    """A signal for each of an array of values."""
    return F.transform(values, lambda v: _signal(kind, name, v, source, behind))


def _emit(df: DataFrame, engine: Column, *signals: Column) -> DataFrame:
    """All signals of the rows ``(case_id, page, seq)``, in one pass; those without a value are none."""
    found = F.filter(F.concat(*signals), lambda s: s["value"].isNotNull())
    out = df.select("case_id", "page", F.col("seq").cast("long").alias("_at"), engine.alias("_by"), F.explode(found).alias("s"))
    return out.select("case_id", "page", (F.col("_at") + F.col("s.behind")).alias("seq"), "s.kind", "s.name", "s.value", F.col("_by").alias("engine"), "s.source")


def _listed(value: Column) -> Column:
    """Flags that a panel lists; "none" is none."""
    return F.filter(F.transform(F.split(value, "[,;|]"), lambda x: F.trim(x)), lambda x: ~F.lower(x).isin("", "none"))


def _percent(value: Column) -> Column:
    """The first number of a text, up to 100, as a share."""
    return F.least(F.lit(100), F.regexp_extract(value, r"([0-9]{1,3})", 1).try_cast("int")) / 100.0


def _line(field: Column, value: Column, source: Column, scanned: bool) -> list[Column]:
    """Signals of a labelled line: a field as it is, a panel split, a share read."""
    kind, flag, single = ("fields", "flags", "singletons") if scanned else (None, None, None)
    panel = field == "_observed_flags"
    plain = ~F.startswith(field, F.lit("_"))
    named = [
        _signal(kind, field, F.when(plain, value), source), _signal(single, field, F.when(field.isin("_registry_status", "_waiver_code", "_amount"), value), source),
        _signal(single, "_biometric", F.when(field == "_biometric_confidence", _percent(value)), source),
    ]
    if scanned:  # a typed slip is told by its page
        named.append(_signal(flag, "_panel_read", F.when(panel, F.lit("1")), source))
    return [F.array(*named), _each(flag, "_flag", F.when(panel, _listed(value)).otherwise(F.array().cast("array<string>")), source)]


def typed_signals(spans: DataFrame, page: DataFrame) -> DataFrame:
    """Signals of the text layer: ``spans`` with their visibility, ``page`` as ``layout.pages`` gives it."""
    seen = spans.where(~F.col("hidden") & ~T.non_evidentiary(F.col("text")))
    engine, adjudicator = F.lit("typed"), F.lit("adjudicator")
    lines = layout.labelled(seen).unionByName(layout.inline(seen.where(F.col("size") < layout.TITLE))).join(page.select("case_id", "page", F.col("kind").alias("source")), ["case_id", "page"])
    plain = _emit(lines, engine, *_line(F.col("field"), F.col("value"), F.col("source"), False))
    hand = F.lit("manual_correction")
    signed = _emit(layout.corrections(seen), engine, F.array(_signal(None, F.col("field"), T.clean(F.col("value")), hand), _signal(None, "_correction", F.col("field"), hand)))
    letter = _emit(layout.letters(page), engine, F.array(_signal(None, F.col("field"), F.col("value"), F.lit("sponsor_letter"))))
    said = seen.where(F.contains(F.lower("text"), F.lit("finding:"))).select("case_id", "page", F.col("span_idx").alias("seq"), T.note_parts(T.clean(F.col("text"))).alias("n")).where("n is not null")
    said = said.select("case_id", "page", "seq", F.upper("n.finding").alias("finding"), F.trim("n.reason").alias("reason")).withColumn("f", notes.reason_facts(F.col("reason")))
    note = _emit(
        said, engine, F.array(_signal(None, "_note_finding", F.col("finding"), adjudicator), _signal(None, "_note_reason", F.col("reason"), adjudicator), _signal(None, "fee_status", F.col("f.fee_status"), adjudicator), _signal(None, "home_world", F.col("f.home_world"), adjudicator)),
        _each(None, "_candidate", T.mine_flags(F.col("reason")), adjudicator),
    )
    # the whole page tells what a finding's reason says behind its first line
    more = page.where("kind = 'adjudicator'").select("case_id", "page", F.lit(1 << 30).alias("seq"), T.note_parts(F.col("text"))["reason"].alias("reason")).where("reason is not null")
    rescinded = F.when(F.col("reason").rlike(rf"(?i)\b{RESCINDED}\b"), F.lit(RESCINDED_FLAG))
    more = _emit(more, engine, _each(None, "_continued", T.mine_flags(F.col("reason")), adjudicator), F.array(_signal(None, "_continued", rescinded, adjudicator)))
    return reduce(DataFrame.unionByName, (plain, signed, letter, note, more))


def scan_signals(reads: DataFrame) -> DataFrame:
    """Signals of readings ``(case_id, page, engine, read_idx, text)`` of scanned pages."""
    primary = F.col("engine") == "primary"
    engine = F.when(primary, F.lit("primary")).otherwise(F.lit("fallback"))
    scan = F.when(primary, F.lit("scanned_page")).otherwise(F.lit("scanned_page_fallback"))
    # what a note or a receipt states outright has that page's authority, if the primary reader saw it
    stated = lambda page_kind: F.when(primary, F.lit(page_kind)).otherwise(F.lit("scanned_page_fallback"))
    lines = scan_lines(reads).withColumn("seq", F.col("read_idx") * READING + F.col("line_no"))
    late = F.col("field").isin("_registry_status", "_waiver_code")  # a reading's last line of these counts, of fields the first, of panels all
    place = F.when(F.col("field") == "_observed_flags", F.col("seq")).otherwise(F.lit(0))
    one = lines.groupBy("case_id", "page", "engine", "read_idx", "field", place.alias("place")).agg(F.min(F.struct("seq", "value")).alias("a"), F.max(F.struct("seq", "value")).alias("b"))
    one = one.withColumn("m", F.when(late, F.col("b")).otherwise(F.col("a"))).select("case_id", "page", "engine", "field", F.col("m.seq").alias("seq"), F.col("m.value").alias("value"))
    named = _emit(one, engine, *_line(F.col("field"), F.col("value"), scan, True))
    text = F.col("text")
    found = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), 1)
    spelled = "(?i)(" + "|".join(name.replace("_", r"[_\s-]?") for name in FLAG_NAMES) + ")"
    part = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    r = reads.select("case_id", "page", "engine", "text", (F.col("read_idx") * READING + READING - 1).alias("seq"), part(AMOUNT).alias("amount"), part(WAIVER).alias("waiver"), notes.reason_facts(text).alias("f"))
    fee = F.when(F.col("amount").isNotNull() & F.col("waiver").isNotNull(), T.fee_of(F.col("amount"), F.col("waiver")))
    whole = _emit(
        r, engine,
        F.array(
            _signal(None, "_scanned", F.lit("1"), scan), _signal("flags", "_panel_read", F.when(text.rlike(SLIP), F.lit("1")), scan), _signal("flags", "_panel_missing", F.when(F.contains(F.upper(text), F.lit(PANEL_MISSING)), F.lit("1")), scan),
            _signal("reason_facts", "fee_status", fee, stated("fee_receipt")), _signal("reason_facts", "fee_status", F.col("f.fee_status"), stated("adjudicator")), _signal("reason_facts", "home_world", F.col("f.home_world"), stated("adjudicator")),
        ),
        _each("flags", "_flag", F.transform(found(CALLED_FLAG), lambda x: F.btrim(x, F.lit(" ."))), scan), _each("flags", "_flag", found(spelled), scan), _each("flags", "_candidate", T.mine_flags(text), scan),
        _each("literals", "sponsor_id", T.mine_sponsors(text), scan, LITERAL), _each("literals", "arrival_date", T.mine_dates(text), scan, LITERAL),
    )
    finding = notes.note_findings(reads, ("case_id", "page", "engine")).withColumn("seq", F.lit(0))
    finding = _emit(finding, engine, F.array(_signal("note", "_note_finding", F.col("finding"), scan), _signal("note", "_note_reason", F.col("reason"), scan)))
    return named.unionByName(whole).unionByName(finding)


def contributed(signals: DataFrame, primary: frozenset[str] = EVERYTHING, fallback: frozenset[str] = EVERYTHING) -> DataFrame:
    """The signals that readers are allowed to contribute; the text layer is never restricted."""
    bits = F.when(F.col("engine") == "primary", F.lit(mask(primary))).otherwise(F.lit(mask(fallback)))
    return signals.where((F.col("kind") == 0) | (F.col("kind").bitwiseAND(bits) != 0))


def observations(signals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(observations, damaged)`` of contributed signals.

    What a page's readers say twice counts once, the primary's first; the key counts as
    seen before the value is validated. Facts that reasons and receipts state are not
    told apart from what else was read, and so are never dropped.
    """
    named = signals.where(~F.startswith(F.col("name"), F.lit("_"))).withColumnRenamed("name", "field")
    plain = F.col("kind").isin(KINDS["fields"], KINDS["literals"])
    first = F.min(F.struct(F.when(F.col("engine") == "primary", 0).otherwise(1).alias("e"), "seq", "value", "source"))
    once = named.where(plain).groupBy("case_id", "page", "field", T.norm(F.col("value")).alias("_v")).agg(first.alias("m"))
    once = once.select("case_id", "page", F.col("m.seq").alias("seq"), "field", F.col("m.value").alias("value"), F.col("m.source").alias("source"))
    return admit(once.unionByName(named.where(~plain).select(*once.columns)))


def packet_facts(signals: DataFrame, page: DataFrame) -> DataFrame:
    """One row a case: what is not a field, of contributed signals, with the fallback reader's apart.

    The text layer's last word counts, then the primary reader's first. ``injected`` and the
    receipt need all pages, so they are settled here and not while pages are read.
    """
    at = lambda name, engine: (F.col("name") == name) & (F.col("engine") == engine)
    first = lambda name, engine: F.min(F.when(at(name, engine), F.struct("page", "seq", "value")))["value"]
    last = lambda name: F.max(F.when(at(name, "typed"), F.struct("page", "seq", "value")))["value"]
    said = lambda name, engine: F.coalesce(F.bool_or(at(name, engine)), F.lit(False))
    own = signals.where(F.startswith(F.col("name"), F.lit("_"))).groupBy("case_id").agg(
        F.coalesce(last("_registry_status"), first("_registry_status", "primary")).alias("registry_status"), first("_registry_status", "fallback").alias("fallback_registry_status"),
        F.coalesce(last("_waiver_code"), first("_waiver_code", "primary")).alias("waiver_code"), first("_waiver_code", "fallback").alias("fallback_waiver_code"), last("_amount").alias("amount"),
        F.coalesce(first("_biometric", "typed"), first("_biometric", "primary")).cast("double").alias("biometric_confidence"), first("_biometric", "fallback").cast("double").alias("fallback_biometric_confidence"),
        F.coalesce(last("_note_finding"), first("_note_finding", "primary")).alias("note_finding"), first("_note_finding", "fallback").alias("fallback_note"),
        F.coalesce(last("_note_reason"), first("_note_reason", "primary")).alias("note_reason"), first("_note_reason", "fallback").alias("fallback_note_reason"),
        said("_panel_read", "primary").alias("panel_read"), said("_panel_missing", "primary").alias("panel_missing"), said("_panel_read", "fallback").alias("fallback_panel_read"), said("_panel_missing", "fallback").alias("fallback_panel_missing"),
        F.array_sort(F.collect_set(F.when(F.col("name") == "_correction", F.col("value")))).alias("corrections"),
    )
    scans = signals.where("name = '_scanned'").groupBy("case_id").agg(F.count_distinct("page").alias("scans"))
    seen = layout.facts(page)
    out = seen.join(own, "case_id", "full_outer").join(scans, "case_id", "full_outer")
    no = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    flags = ("panel_read", "panel_missing", "fallback_panel_read", "fallback_panel_missing", "has_text_layer", "injection_detected", "sample_denial_watermark")
    reason = F.lower(F.concat_ws(" ", "note_reason", "fallback_note_reason"))
    kinds = F.concat(F.coalesce("page_types", F.array().cast("array<string>")), F.array_repeat(F.lit("scanned_page"), F.coalesce(F.col("scans"), F.lit(0)).cast("int")))
    return out.select(
        "case_id", *[no(c) for c in flags], *[c for c in own.columns if c not in ("case_id", *flags)], "stamps", F.coalesce("hidden_spans", F.lit(0)).alias("hidden_spans"), F.coalesce("machine_spans", F.lit(0)).alias("machine_spans"),
        kinds.alias("page_types"), F.coalesce("scans", F.lit(0)).alias("ocr_pages"), F.when(F.col("waiver_code").isNotNull(), T.fee_of(F.col("amount"), F.col("waiver_code"))).alias("receipt_fee"), F.contains(reason, F.lit(TRANSIT_REASON)).alias("transit"),
    )


def flag_readings(signals: DataFrame, facts: DataFrame) -> DataFrame:
    """``case_id, raw, observed, fallback``: words that may be flags, of contributed signals.

    ``observed`` are those that a label calls flags. What a note says behind its first line is
    admitted only where nothing was injected.
    """
    words = signals.where(F.col("name").isin("_flag", "_candidate")).select("case_id", F.col("value").alias("raw"), (F.col("name") == "_flag").alias("observed"), (F.col("engine") == "fallback").alias("fallback"))
    clean = facts.where("not injection_detected").select("case_id")
    more = signals.where("name = '_continued'").join(clean, "case_id", "left_semi").select("case_id", F.col("value").alias("raw"), F.lit(False).alias("observed"), F.lit(False).alias("fallback"))
    return words.unionByName(more).distinct()
