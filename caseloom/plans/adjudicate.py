"""Phase 2: context, policy, decisions, settlement, and exactly one row an input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.functions import policy as P
from caseloom.functions.text import flag_string
from caseloom.functions.validate import date_of, valid_date, valid_sponsor
from caseloom.operators import corpus
from caseloom.operators.resolve import backfill

PUBLIC_REVOKED = ("SPN-0007", "SPN-0139", "SPN-4040")
NO_SPONSOR, NO_DATE = "SPN-0000", "2000-01-01"
NOTE_CONFIDENCE, FALLBACK_NOTE_CONFIDENCE = 0.997207, 0.95
NOTE_PATH, UNREADABLE = "adjudicator_note_finding", "unreadable_packet"
#: The row of a calibration table that holds the global prior.
GLOBAL = "*"
FALLBACK = {"p_approved": 1 / 3, "p_denied": 1 / 3, "p_review": 1 / 3}
#: Of an unreadable packet where no table says otherwise.
UNREAD = ("NEEDS_REVIEW", 0.6)


def context_of(state: DataFrame) -> DataFrame:
    """One row: reference date, median date, revoked sponsors, known years, of a ``corpus.corpus_state``.

    All four are counts of the corpus; only single values and the revoked list leave the
    executors' hands.
    """
    dated = state.where((F.col("kind") == "arrival") & valid_date(F.col("value"))).withColumn("arrival", date_of(F.col("value")))
    ref = corpus.reference_date(dated, [], "arrival", weight="n").agg(F.max("reference_date").alias("reference_date"))
    med = corpus.median_date(dated, [], "arrival", weight="n").agg(F.max("median_date").alias("median_date"))
    out = corpus.frequency_outliers(state.where((F.col("kind") == "sponsor") & valid_sponsor(F.col("value"))), "value", weight="n").agg(F.collect_set("value").alias("r"))
    years = corpus.contiguous_years(dated.withColumn("year", F.year("arrival")), "year", weight="n")
    years = corpus.year_counts(years).crossJoin(years.agg(F.max(F.struct("n", "year"))["year"].alias("modal_year")))
    one = ref.crossJoin(med).crossJoin(out).crossJoin(years)
    return one.withColumn("revoked", F.array_sort(F.array_union(F.array(*map(F.lit, PUBLIC_REVOKED)), "r"))).drop("r")


def context(records: DataFrame) -> DataFrame:
    """The context of ``records`` with ``arrival_date`` (text) and ``sponsor_id``: one row, see ``context_of``."""
    return context_of(corpus.corpus_state(records))


def _priors(calibration: DataFrame, fallback: dict[str, float] | None) -> DataFrame:
    """One row of a calibration table: the probabilities of a path that it lacks, the confidence of
    notes, and the decision on unreadable packets.

    The global prior is the row ``GLOBAL``, else the shares of the outcomes in all records the
    table was fitted on, by ``support``, else even.
    """
    c, have = F.col, set(calibration.columns)
    at = lambda path, value: F.max(F.when(c("path") == path, value))
    support = c("support") if "support" in have else F.lit(None).cast("long")
    fitted = c("path") != GLOBAL
    prior = [F.coalesce(F.lit(fallback[p]) if fallback else at(GLOBAL, c(p)), F.sum(F.when(fitted, c(p) * support)) / F.sum(F.when(fitted, support)), F.lit(v)).alias(f"g_{p}") for p, v in FALLBACK.items()]
    unread = P.decide((c("p_approved"), c("p_denied"), c("p_review")))
    sure = at(NOTE_PATH, c("accuracy")) if "accuracy" in have else F.lit(None).cast("double")
    return calibration.agg(*prior, F.coalesce(sure, F.lit(NOTE_CONFIDENCE)).alias("note_confidence"), F.coalesce(at(UNREADABLE, F.struct(unread["decision"].alias("d"), unread["confidence"].alias("c"))), F.struct(F.lit(UNREAD[0]).alias("d"), F.lit(UNREAD[1]).alias("c"))).alias("unread"))


def adjudicate(records: DataFrame, calibration: DataFrame, fallback: dict[str, float] | None = None, known: DataFrame | None = None) -> DataFrame:
    """Records with path, decision and confidence, under the corpus context ``known``, by default their own.

    A primary note's finding decides first; then the path table, or for a path that it
    lacks ``fallback``, by default its global prior; a fallback reader's finding
    overrides where there is no primary note and nothing was injected.
    """
    table = calibration.select("path", *FALLBACK)
    r = corpus.with_context(records, context(records) if known is None else known).withColumn("arrival", date_of(F.col("arrival_date")))
    far = F.coalesce(P.implausible(F.col("reference_date"), F.col("arrival")), F.lit(False))
    r = r.withColumn("stale", P.stale(F.col("reference_date"), F.col("arrival"))).withColumn("untrusted", F.coalesce("arrival_date_untrusted", F.lit(False)) | far)
    path = P.decision_path(
        {
            "visa": F.col("visa_class"), "sponsor": F.col("sponsor_id"), "fee": F.col("fee_status"), "flags": F.col("risk_flags"), "stale": F.col("stale"), "arrival": F.col("arrival"), "arrival_untrusted": F.col("untrusted"),
            "hardship": F.col("has_hardship_waiver"), "diplomatic": F.col("has_diplomatic_note"), "revoked": F.array_contains("revoked", F.col("sponsor_id")), "flags_known": F.col("risk_flags_known"), "scanned": F.col("has_scanned_pages"), "injection": F.col("injection_detected"),
        }
    )
    r = r.withColumn("path", path).join(F.broadcast(table), "path", "left").crossJoin(F.broadcast(_priors(calibration, fallback)))  # paths are as few as the rules
    for p in FALLBACK:
        r = r.withColumn(p, F.coalesce(p, f"g_{p}")).drop(f"g_{p}")
    d = P.decide((F.col("p_approved"), F.col("p_denied"), F.col("p_review")))
    other = F.col("fallback_note").isNotNull() & F.col("note_finding").isNull() & ~F.coalesce("injection_detected", F.lit(False))
    r = r.withColumn("_d", d)
    return r.withColumn("adjudication", F.coalesce("note_finding", F.when(other, F.col("fallback_note")), F.col("_d.decision"))).withColumn(
        "confidence", F.when(F.col("note_finding").isNotNull(), F.col("note_confidence")).when(other, F.lit(FALLBACK_NOTE_CONFIDENCE)).otherwise(F.col("_d.confidence"))
    ).drop("_d", "note_confidence", "unread")


def settle_dates(rows: DataFrame) -> DataFrame:
    """Printed dates: repaired into known years, unread ones become the median, staged box dates last.

    ``rows`` carries the context, ``arrival_date`` as policy knows it and
    ``printed_arrival_date``, which where policy knows none is the fallback reader's: that is
    repaired, never replaced by the median. Optional arrays ``box_strict`` and ``box_cheap``
    hold staged readings.
    """
    text = lambda d: F.date_format(d, "yyyy-MM-dd")
    mended = lambda c: text(corpus.repaired(date_of(F.col(c)), F.col("year_counts")))
    printed = F.when(valid_date(F.col("printed_arrival_date")), F.col("printed_arrival_date"))
    settled = F.when(F.col("arrival_date").isNotNull(), F.coalesce(mended("arrival_date"), printed, "arrival_date")).otherwise(F.coalesce(mended("printed_arrival_date"), printed, text(F.col("median_date"))))
    out = rows.withColumn("printed_arrival_date", F.coalesce(settled, F.lit(NO_DATE)))
    if {"box_strict", "box_cheap"} <= set(rows.columns):
        box = corpus.settle_box_date(F.col("box_strict"), F.col("box_cheap"), F.col("year_counts"), F.col("modal_year"))
        out = out.withColumn("printed_arrival_date", F.coalesce(box, "printed_arrival_date"))
    return out


def enforce(rows: DataFrame) -> DataFrame:
    """The output schema, whatever came before: bad values become defaults, confidence lies in [0, 1]."""
    text = lambda c, d: F.coalesce(F.col(c).cast("string"), F.lit(d))
    return rows.select(
        "case_id",
        *[text(c, "unknown").alias(c) for c in ("applicant_name", "species_code", "home_world", "visa_class", "declared_purpose")],
        F.when(valid_sponsor(F.col("sponsor_id")), F.col("sponsor_id")).otherwise(F.lit(NO_SPONSOR)).alias("sponsor_id"),
        F.when(valid_date(F.col("arrival_date")), F.col("arrival_date")).otherwise(F.lit(NO_DATE)).alias("arrival_date"),
        text("risk_flags", "none").alias("risk_flags"),
        F.when(F.col("fee_status").isin("paid", "unpaid", "waived", "unknown"), F.col("fee_status")).otherwise(F.lit("unknown")).alias("fee_status"),
        F.when(F.col("adjudication").isin(*P.PAYOFF), F.col("adjudication")).otherwise(F.lit("NEEDS_REVIEW")).alias("adjudication"),
        F.coalesce(P.clamp(F.col("confidence").try_cast("double")), F.lit(0.0)).alias("confidence"),
    )


def shown_mode(state: DataFrame) -> DataFrame:
    """One row ``_mode``: the commonest printed sponsor of a ``corpus.corpus_state`` (ties: the least)."""
    shown = state.where((F.col("kind") == "shown") & valid_sponsor(F.col("value"))).groupBy(F.trim("value").alias("v")).agg(F.sum("n").alias("n")).where(F.col("v") != NO_SPONSOR)
    return shown.agg(F.min(F.struct((-F.col("n")).alias("k"), "v"))["v"].alias("_mode"))


def finish(inputs: DataFrame, decided: DataFrame, calibration: DataFrame | None = None, priors: DataFrame | None = None, state: DataFrame | None = None) -> DataFrame:
    """One valid row for each input: printed values, backfill, schema, then the sponsor placeholder
    becomes the commonest sponsor, and last the sponsors of boxes.

    What nothing could be read for is printed as the commonest value of its field,
    ``priors (field, mode)``. Inputs without a row are unreadable packets: all their fields are
    printed so, and they get the decision of that path of ``calibration``. ``decided`` may hold
    ``box_sponsor, box_sponsor_seen, box_sponsor_placeholder`` and ``revoked``. The commonest
    sponsor is that of all rows, or of a corpus ``state``.
    """
    d = settle_dates(decided)
    staged = [c for c in ("box_sponsor", "box_sponsor_seen", "box_sponsor_placeholder", "revoked") if c in d.columns]
    guessed = ("applicant_name", "species_code", "home_world", "visa_class", "declared_purpose", "fee_status")
    shown = d.select("case_id", *[F.col(f"printed_{c}").alias(c) for c in (*guessed, "sponsor_id", "arrival_date")], flag_string(F.col("printed_flags")).alias("risk_flags"), "adjudication", "confidence")
    all_rows = backfill(inputs, shown, "case_id", {"risk_flags": "none", "arrival_date": NO_DATE})
    if calibration is None:
        all_rows = all_rows.withColumn("unread", F.struct(F.lit(UNREAD[0]).alias("d"), F.lit(UNREAD[1]).alias("c")))
    else:
        all_rows = all_rows.crossJoin(F.broadcast(_priors(calibration, None).select("unread")))
    all_rows = all_rows.withColumn("adjudication", F.coalesce("adjudication", "unread.d")).withColumn("confidence", F.coalesce("confidence", "unread.c"))
    if priors is not None:
        modes = priors.agg(*[F.max(F.when(F.col("field") == c, F.col("mode"))).alias(f"_m_{c}") for c in guessed])
        all_rows = all_rows.crossJoin(F.broadcast(modes))
        for c in guessed:
            all_rows = all_rows.withColumn(c, F.coalesce(c, f"_m_{c}"))
    rows = enforce(all_rows)
    if state is None:
        state = rows.select(F.lit("shown").alias("kind"), F.col("sponsor_id").alias("value"), F.lit(1).cast("long").alias("n"))
    out = rows.crossJoin(F.broadcast(shown_mode(state))).withColumn("sponsor_id", F.when(F.col("sponsor_id") == NO_SPONSOR, F.coalesce("_mode", "sponsor_id")).otherwise(F.col("sponsor_id")))
    if len(staged) < 4:
        return out.drop("_mode")
    both = out.join(d.select("case_id", *staged), "case_id", "left")
    sponsor = corpus.settle_box_sponsor(F.col("sponsor_id"), F.col("box_sponsor"), F.col("box_sponsor_seen"), F.col("box_sponsor_placeholder"), F.col("revoked"), F.col("_mode"))
    return both.withColumn("sponsor_id", sponsor).drop("_mode", *staged)
