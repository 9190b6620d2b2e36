"""Phase 1 after reading: signals of packets become records for policy and values to print."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.functions.policy import PAYOFF
from caseloom.functions.text import flag_string
from caseloom.operators import boxes as B
from caseloom.operators import evidence, layout, signals
from caseloom.operators.signals import EVERYTHING
from caseloom.sources.stages import staged

FIELDS = ("applicant_name", "species_code", "home_world", "visa_class", "sponsor_id", "arrival_date", "declared_purpose", "fee_status")
#: What the fallback reader may do: fill what is printed, and settle the fee.
PROMOTE = frozenset({"printed", "fee"})
#: What steps read of spans.
SEEN = ("case_id", "page", "span_idx", "text", "size", "hidden")
#: Vocabularies of a lexicon ``(field, idx, value)`` that are no fields. Fixed values.
FIRST, LAST, FLAG = "first_name", "last_name", "risk_flag"


def gather(spans: DataFrame, reads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(signals, pages)`` of spans and of readings of scanned pages: all that later steps need. Both are staged.

    So are spans with their visibility, and readings, as each of them is read by many steps.
    """
    seen = staged(layout.with_visibility(spans).select(*SEEN), "spans")
    page = staged(layout.pages(seen), "pages")
    return staged(signals.typed_signals(seen, page).unionByName(signals.scan_signals(staged(reads, "reads"))), "signals"), page


def assemble(cases: DataFrame, found: DataFrame, page: DataFrame, boxes: DataFrame, extra: DataFrame, lexicon: DataFrame, promote: frozenset[str] = PROMOTE, primary: frozenset[str] = EVERYTHING, fallback: frozenset[str] = EVERYTHING) -> DataFrame:
    """One row for each of ``cases (case_id)``: the record that policy reads, what is printed, and facts.

    ``found`` and ``page`` are what ``gather`` gives; ``boxes (case_id, page, box_idx, text,
    confidence)``; ``extra (case_id, field, value, score)`` is what a third reader sees in the
    packet; ``lexicon (field, idx, value)`` holds the vocabularies. ``primary`` and ``fallback``
    are the kinds of signals that the readers may contribute, ``promote`` what the
    fallback reader's may do. Repairs come last, change what is printed only, and never
    reach the record.
    """
    allowed = signals.contributed(found, primary, fallback)
    facts = staged(signals.packet_facts(allowed, page), "facts")
    obs, damaged = observed(allowed, page, lexicon)
    words = lambda f: lexicon.where(F.col("field") == f).select("idx", "value")
    corrected = facts.select("case_id", F.explode("corrections").alias("field"))
    registry = facts.select("case_id", F.coalesce("registry_status", "fallback_registry_status").alias("status"), F.col("registry_status").isNull().alias("fallback")).where("status is not null")
    flags = evidence.flag_sets(evidence.flag_evidence(signals.flag_readings(allowed, facts), registry, obs, words(FLAG), corrected), evidence.without_embargo(obs), promote)
    rec = evidence.records(obs, FIELDS, promote)
    names = evidence.printed_names(rec.select("case_id", F.col("printed_applicant_name").alias("value")), obs, corrected, 7 if "printed" in promote else 6).select("case_id", F.col("value").alias("_name"))
    marks = damaged.groupBy("case_id").agg(F.array_sort(F.collect_set("field")).alias("damaged_fields"))
    base = cases.select("case_id").join(facts, "case_id", "left").join(rec, "case_id", "left").join(names, "case_id", "left").join(flags, "case_id", "left").join(marks, "case_id", "left")
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    none = F.array().cast("array<string>")
    either = lambda a, b, kind: F.coalesce(a, b) if kind in promote else F.col(a)
    outcome = lambda c: F.when(F.col(c).isin(*PAYOFF), F.col(c))
    waiver = F.upper(F.coalesce(either("waiver_code", "fallback_waiver_code", "singletons"), F.lit("")))
    seen = no("panel_read") | (no("fallback_panel_read") if "panel" in promote else F.lit(False))
    missing = no("panel_missing") | (no("fallback_panel_missing") if "panel" in promote else F.lit(False))
    note = either("note_finding", "fallback_note", "note")
    sets = {c: F.coalesce(F.col(c), none).alias(c) for c in ("risk_flags", "printed_flags", "damaged_fields", "page_types", "stamps", "corrections")}
    base = base.select("case_id", *[sets.get(c, F.col(c)) for c in base.columns if c not in ("case_id", "_name", "printed_applicant_name", "printed_fee_status")], F.col("_name").alias("printed_applicant_name"), F.coalesce("receipt_fee", "printed_fee_status").alias("printed_fee_status"), F.col("printed_fee_status").alias("stated_fee"))
    base = base.select(
        "*", evidence.flags_known(F.col("risk_flags"), F.col("page_types"), seen, note, missing).alias("risk_flags_known"), (~waiver.isin("", "N/A", "NONE")).alias("has_hardship_waiver"), F.contains(waiver, F.lit("DIP")).alias("has_diplomatic_note"),
        F.col("arrival_date").isNull().alias("arrival_date_untrusted"), F.array_contains("page_types", "scanned_page").alias("has_scanned_pages"),
    ).withColumn("injection_detected", no("injection_detected")).withColumn("note_finding", F.when(note.isin(*PAYOFF), note)).withColumn("fallback_note", outcome("fallback_note"))
    repaired = evidence.direct_repairs(base, obs, facts.select("case_id", F.col("transit")))
    boxed = repaired.join(B.direct(boxes, obs, lexicon.where(~F.col("field").isin(FIRST, LAST, FLAG))), "case_id", "left")
    for f in B.CLOSED_LABELS:
        boxed = boxed.withColumn(f"printed_{f}", F.coalesce(f"box_{f}", f"printed_{f}")).drop(f"box_{f}")
    arrays = [F.coalesce(c, none).alias(c) for c in ("box_strict", "box_cheap")]
    boxed = boxed.select(*[c for c in boxed.columns if c not in ("box_strict", "box_cheap")], *arrays)
    waiting = boxed.where("box_sponsor is not null or box_sponsor_placeholder is not null").select("case_id", F.lit("sponsor_id").alias("field"))
    return evidence.fill_unresolved(boxed, extra, damaged.select("case_id", "field").unionByName(waiting), facts.where("injection_detected"))


def observed(allowed: DataFrame, page: DataFrame, lexicon: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(observations, damaged)`` of contributed signals: observations snapped on the lexicon, fields that
    bad values or markers of ``page`` declare damaged. Both are staged, as many steps read them."""
    obs, bad = signals.observations(allowed)
    obs = staged(obs, "values")
    words = lambda f: lexicon.where(F.col("field") == f).select("idx", "value")
    snapped = evidence.snapped(obs, lexicon.where(F.col("field").isin(*evidence.CLOSED)), words(FIRST), words(LAST))
    marks = page.select("case_id", F.explode("damaged").alias("field"))
    return staged(snapped, "observations"), staged(bad.unionByName(marks).distinct(), "damaged")


def as_text(decided: DataFrame) -> DataFrame:
    """Decided cases with their flags as text, for reports."""
    return decided.withColumn("risk_flags", flag_string(F.col("risk_flags"))).withColumn("printed_flags", flag_string(F.col("printed_flags")))
