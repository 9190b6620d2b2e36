"""Phase 1: spans of typed pages and readings of scans become observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseloom.functions import text as T
from caseloom.functions.validate import looks_damaged, valid_for_field
from caseloom.operators.snap import match_labels

#: Labels of typed pages, of inline lines and of scans with their fields. Fixed values.
LABELS = {
    "Applicant": "applicant_name", "Registry Name": "applicant_name", "Species Code": "species_code", "Home World": "home_world", "Visa Class": "visa_class",
    "Sponsor ID": "sponsor_id", "Arrival Date": "arrival_date", "Declared Purpose": "declared_purpose", "Fee Status": "fee_status",
    "Waiver Code": "_waiver_code", "Registry Status": "_registry_status", "Case ID": "_case_id", "Amount": "_amount",
}
INLINE = {"applicant": "applicant_name", "species match": "species_code", "observed flags": "_observed_flags", "case id": "_case_id", "biometric confidence": "_biometric_confidence"}
SUBJECTS = {
    "sponsor": "sponsor_id", "sponsor id": "sponsor_id", "visa class": "visa_class", "applicant": "applicant_name", "fee status": "fee_status",
    "species": "species_code", "species code": "species_code", "home world": "home_world", "arrival date": "arrival_date", "declared purpose": "declared_purpose",
}
#: Short labels that only scans use.
SCAN_ONLY = {"purpose": "declared_purpose", "world": "home_world", "species": "species_code"}
SCAN_LABELS = {k.lower(): v for k, v in LABELS.items() if v != "_amount"} | INLINE | SCAN_ONLY
#: How a correction begins, before white space is collapsed: most spans are no more than looked at.
CORRECTED = r"(?iU)^\s*manual\s+correction:"
TYPED_LABEL, TITLE, LEAST_RASTER = (7.5, 8.5), 13.0, 400_000


def with_visibility(spans: DataFrame) -> DataFrame:
    """Spans with ``reasons`` why they are hidden, ``hidden``, and ``rotated``."""
    s = spans.where(F.trim("text") != "").withColumn("reasons", T.hide_reasons(F.col("alpha"), F.col("color"), F.col("bbox"), F.col("visible_rect")))
    return s.withColumn("hidden", F.size("reasons") > 0).withColumn("rotated", T.rotated(F.col("page_rotation"), F.col("dir_y")))


def pages(spans: DataFrame) -> DataFrame:
    """Per page: kind by its first title, visible characters, texts in order, damage, stamps, hidden text."""
    v = ~F.col("hidden") & ~T.non_evidentiary(F.col("text"))
    ordered = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("span_idx", "text")))), lambda x: x["text"])
    title = F.min(F.when(v & (F.col("size") >= TITLE), F.struct("span_idx", "text")))["text"]
    mark = T.stamp(F.col("text"), F.col("size"))
    page = spans.groupBy("case_id", "page").agg(
        title.alias("title"), F.sum(F.when(v, F.length("text")).otherwise(0)).alias("visible_chars"), F.array_join(ordered(v), "\n").alias("text"), F.array_join(ordered(F.col("hidden")), "\n").alias("hidden_text"),
        F.bool_or(T.non_evidentiary(F.col("text"))).alias("non_evidentiary"), F.array_sort(F.collect_set(F.when(v, mark["word"]))).alias("stamps"), F.bool_or(v & mark["sample"]).alias("sample"),
        F.count_if(F.col("hidden")).alias("hidden_spans"), F.count_if(~F.col("hidden") & T.non_evidentiary(F.col("text"))).alias("machine_spans"),
    )
    return page.withColumn("kind", T.page_kind(F.col("title"))).withColumn("damaged", T.damaged_fields(F.col("text")))


def labelled(spans: DataFrame) -> DataFrame:
    """Label spans (by font size) with the visible span right after them, if that is larger."""
    w = W.partitionBy("case_id", "page").orderBy("span_idx")
    nxt = F.lead(F.struct("text", "size")).over(w)
    s = spans.where("not hidden").select("case_id", "page", "span_idx", "text", "size", nxt.alias("n"))
    hit = F.col("size").between(*TYPED_LABEL) & (F.col("n.size") > TYPED_LABEL[1])
    return s.where(hit).select("case_id", "page", F.col("span_idx").alias("seq"), T.lookup(LABELS, F.trim("text")).alias("field"), F.col("n.text").alias("value")).where("field is not null")


def inline(spans: DataFrame) -> DataFrame:
    """``Key: value`` lines of typed pages."""
    parts = F.split("text", ":", 2)
    s = spans.where(~F.col("hidden") & F.contains(F.col("text"), F.lit(":")))
    return s.select("case_id", "page", F.col("span_idx").alias("seq"), T.lookup(INLINE, T.norm(F.get(parts, F.lit(0)))).alias("field"), F.trim(F.get(parts, F.lit(1))).alias("value")).where("field is not null")


def corrections(spans: DataFrame) -> DataFrame:
    c = T.correction(F.col("text"), SUBJECTS)
    return spans.where(~F.col("hidden") & F.col("text").rlike(CORRECTED)).select("case_id", "page", F.col("span_idx").alias("seq"), c.alias("c")).where("c is not null").select("case_id", "page", "seq", F.col("c.field").alias("field"), F.col("c.value").alias("value"))


def letters(page: DataFrame) -> DataFrame:
    """Observations of sponsors' letters; the compliance class is a visa."""
    a = T.attestation(F.col("text"))
    fields = [("sponsor_id", "sponsor"), ("applicant_name", "applicant"), ("declared_purpose", "purpose"), ("visa_class", "visa")]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("seq"), F.lit(f).alias("field"), a[n].alias("value")) for k, (f, n) in enumerate(fields)]))
    return page.where("kind = 'sponsor_letter'").select("case_id", "page", each.alias("x")).select("case_id", "page", "x.seq", "x.field", "x.value").where("value is not null")


def scan_lines(reads: DataFrame) -> DataFrame:
    """``case_id, page, engine, read_idx, line_no, field, value``: all ``label : value`` lines of readings.

    ``reads`` has case_id, page, engine, read_idx, text. Separators are ``: ; . =``. Of what
    stands before the first one the last three, two or one words are a label, whatever signs
    are among them, or else the last two a garbled one. The fallback engine drops blanks;
    its labels get them back.
    """
    lines = reads.select("case_id", "page", "engine", "read_idx", F.posexplode(F.split("text", r"\R|\f|\x1c|\x1d|\x1e")).alias("line_no", "line"))
    pattern = r"^(.*?)\s*[:;.=]\s*(.*)$"
    head = F.regexp_extract("line", pattern, 1)
    head = F.when(F.col("engine") == "primary", head).otherwise(T.respace(head, list(SCAN_LABELS)))
    out = lines.select("*", head.alias("head"), T.strip_debris(F.regexp_extract("line", pattern, 2)).alias("value")).where("head <> '' and value <> ''")
    labels = reads.sparkSession.createDataFrame([(k, x) for k, x in enumerate(SCAN_LABELS)], "idx int, label string")
    known = match_labels(out.select("head"), labels, "head").select("head", T.lookup(SCAN_LABELS, F.col("label")).alias("field"))
    return out.join(known, "head").where("field is not null").select("case_id", "page", "engine", "read_idx", "line_no", "field", "value")


def scanned_lines(reads: DataFrame) -> DataFrame:
    """Of the ``scan_lines`` of each reading a field's first."""
    best = scan_lines(reads).groupBy("case_id", "page", "engine", "read_idx", "field").agg(F.min(F.struct("line_no", "value")).alias("m"))
    return best.select("case_id", "page", "engine", "read_idx", F.col("m.line_no").alias("line_no"), "field", F.col("m.value").alias("value"))


def mined(reads: DataFrame) -> DataFrame:
    """Sponsor ids, dates and flag-shaped words anywhere in readings."""
    found = F.concat(
        F.transform(T.mine_sponsors(F.col("text")), lambda v: F.struct(F.lit("sponsor_id").alias("field"), v.alias("value"))),
        F.transform(T.mine_dates(F.col("text")), lambda v: F.struct(F.lit("arrival_date").alias("field"), v.alias("value"))),
        F.transform(T.mine_flags(F.col("text")), lambda v: F.struct(F.lit("_flag").alias("field"), v.alias("value"))),
    )
    return reads.select("case_id", "page", "engine", "read_idx", F.posexplode(found).alias("k", "x")).select("case_id", "page", "engine", "read_idx", (F.col("k") + 1000).alias("line_no"), "x.field", "x.value")


def absorb(lines: DataFrame) -> DataFrame:
    """One observation of each (field, value) a page, the primary engine's first.

    The key counts as seen before it is validated, so a bad primary reading blocks an
    equal one of the fallback engine.
    """
    w = W.partitionBy("case_id", "page", "field", T.norm(F.col("value"))).orderBy(F.when(F.col("engine") == "primary", 0).otherwise(1), "read_idx", "line_no", "value")
    out = lines.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    source = F.when(F.col("engine") == "primary", F.lit("scanned_page")).otherwise(F.lit("scanned_page_fallback"))
    return out.select("case_id", "page", (F.col("read_idx") * 10_000 + F.col("line_no")).cast("int").alias("seq"), "field", "value", source.alias("source"))


def admit(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Observations, and fields that bad values of sources other than the fallback mark damaged.

    Values that hold a damage marker, or are a bare word of damage, are no evidence at all.
    """
    c = candidates.withColumn("value", T.clean(F.col("value"))).withColumn("trust", T.lookup(T.TRUST, F.col("source"), F.lit(9)))
    open_field = ~F.startswith(F.col("field"), F.lit("_"))
    c = c.where(~open_field | ~(F.col("value").rlike(T.MARKER) | F.upper("value").isin(*T.SENTINELS)))
    ok = ~open_field | valid_for_field(F.col("field"), F.col("value"))
    obs = c.where(ok & ~(open_field & looks_damaged(F.col("value"))))
    bad = c.where(open_field & ~ok & (F.col("source") != "scanned_page_fallback")).select("case_id", "field").distinct()
    return obs, bad


def needs_reading(page: DataFrame, obs: DataFrame, images: DataFrame) -> DataFrame:
    """Pages without any labelled value but with a large raster, text or not: they go to a reader."""
    big = images.where(F.exists("images", lambda i: i["w"] * i["h"] >= LEAST_RASTER)).select("case_id", "page")
    return big.join(obs.select("case_id", "page").distinct(), ["case_id", "page"], "left_anti")


def observe(spans: DataFrame, reads: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(observations, damaged, pages)`` of cases, from spans and readings of scanned pages."""
    s = with_visibility(spans)
    s = s.where(~T.non_evidentiary(F.col("text")) | F.col("hidden"))
    page = pages(with_visibility(spans))
    kind = page.select("case_id", "page", "kind")
    typed = labelled(s).unionByName(inline(s.where(F.col("size") < TITLE))).join(kind, ["case_id", "page"]).select("case_id", "page", "seq", "field", "value", F.col("kind").alias("source"))
    signed = corrections(s).withColumn("source", F.lit("manual_correction"))
    letter = letters(page).withColumn("source", F.lit("sponsor_letter"))
    scans = absorb(scanned_lines(reads).unionByName(mined(reads)))
    obs, damaged = admit(typed.unionByName(signed).unionByName(letter).unionByName(scans))
    marks = page.select("case_id", F.explode("damaged").alias("field"))
    return obs, damaged.unionByName(marks).distinct(), page


def facts(page: DataFrame) -> DataFrame:
    """Per case: text layer, injection, stamps and watermark, pages by kind."""
    per = page.groupBy("case_id").agg(
        F.sum("visible_chars").alias("chars"), F.array_join(F.array_sort(F.collect_list("hidden_text")), "\n").alias("hidden"), F.bool_or("non_evidentiary").alias("ne"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("stamps")))).alias("stamps"), F.bool_or("sample").alias("sample_denial_watermark"), F.array_sort(F.collect_list("kind")).alias("page_types"),
        F.sum("hidden_spans").alias("hidden_spans"), F.sum("machine_spans").alias("machine_spans"),
    )
    return per.select("case_id", (F.col("chars") >= 50).alias("has_text_layer"), T.injected(F.col("hidden"), F.col("ne")).alias("injection_detected"), "stamps", "sample_denial_watermark", "page_types", "hidden_spans", "machine_spans")
