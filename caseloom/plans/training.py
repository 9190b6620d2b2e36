"""Learning from labels: calibration tables from true fields, and rows scored out of fold; queries on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.functions import policy as P
from caseloom.functions.text import flags
from caseloom.functions.validate import date_of
from caseloom.operators import calibrate, evaluate
from caseloom.plans.adjudicate import GLOBAL, UNREADABLE, finish
from caseloom.plans.catalogue import Query, read
from caseloom.sources import io

#: Of a packet that nobody can read: policy, not a count. Fixed values.
UNREADABLE_ODDS = (0.12, 0.28, 0.60)
NAMES = ("p_approved", "p_denied", "p_review")


def label_records(labels: DataFrame) -> DataFrame:
    """Policy records of label rows: what policy would know if everything were read; facts that only
    documents hold (waivers, notes, injections) are not in the labels, and all of it counts as known."""
    text = lambda c: F.nullif(F.trim(c), F.lit("unknown"))
    no = F.lit(False)
    return labels.select(
        "case_id", text("visa_class").alias("visa_class"), text("sponsor_id").alias("sponsor_id"), F.trim("fee_status").alias("fee_status"), text("arrival_date").alias("arrival_date"), flags(F.col("risk_flags")).alias("risk_flags"), F.trim("adjudication").alias("adjudication"),
        no.alias("arrival_date_untrusted"), no.alias("has_hardship_waiver"), no.alias("has_diplomatic_note"), F.lit(True).alias("risk_flags_known"), no.alias("has_scanned_pages"), no.alias("injection_detected"),
    )


def fit_calibration(records: DataFrame, receipt_date: str, revoked: tuple[str, ...] = (), strength: float = 4.0) -> DataFrame:
    """A calibration table ``path, p_approved, p_denied, p_review, support`` of records with their true ``adjudication``,
    as of ``receipt_date``; with the global prior and the odds of unreadable packets."""
    day, ref = date_of(F.col("arrival_date")), date_of(F.lit(receipt_date))
    path = P.decision_path(
        {
            "visa": F.col("visa_class"), "sponsor": F.col("sponsor_id"), "fee": F.col("fee_status"), "flags": F.col("risk_flags"), "stale": P.stale(ref, day), "arrival": day, "arrival_untrusted": F.col("arrival_date_untrusted"),
            "hardship": F.col("has_hardship_waiver"), "diplomatic": F.col("has_diplomatic_note"), "revoked": F.col("sponsor_id").isin(*revoked) if revoked else F.lit(False), "flags_known": F.col("risk_flags_known"), "scanned": F.col("has_scanned_pages"), "injection": F.col("injection_detected"),
        }
    )
    table = evaluate.smoothed(records.withColumn("path", path), "path", "adjudication", list(calibrate.OUTCOMES), strength)
    rows = table.where(F.col("path") != UNREADABLE).select("path", *[F.col(f"p_{o}").alias(n) for o, n in zip(calibrate.OUTCOMES, NAMES, strict=True)], "support")
    whole = evaluate.global_prior(records, "adjudication").agg(F.lit(GLOBAL).alias("path"), *[F.coalesce(F.max(F.when(F.col("adjudication") == o, F.col("p"))), F.lit(0.0)).alias(n) for o, n in zip(calibrate.OUTCOMES, NAMES, strict=True)], F.lit(None).cast("long").alias("support"))
    unread = records.sparkSession.createDataFrame([(UNREADABLE, *UNREADABLE_ODDS, None)], "path string, p_approved double, p_denied double, p_review double, support long")
    return rows.unionByName(whole).unionByName(unread)


def out_of_fold_rows(inputs: DataFrame, decided: DataFrame, oof: DataFrame, calibration: DataFrame, priors: DataFrame, weight: float = 1.0) -> DataFrame:
    """Output rows with out-of-fold decisions, so that a model is judged on what it did not see.

    ``oof (case_id, m_<outcome>)``; cases without a row there are settled by rule. The
    model's probabilities are blended with those of the path, and on paths whose evidence was unread no approval is given.
    """
    prior = [F.col(n).alias(f"prior_{o}") for o, n in zip(calibrate.OUTCOMES, NAMES, strict=True)]
    both = decided.select("case_id", "path", *prior).join(oof, "case_id")
    p = tuple(P.blend(F.col(f"m_{o}"), F.col(f"prior_{o}"), weight) for o in calibrate.OUTCOMES)
    new = both.select("case_id", P.decide_safely(p, F.col("path")).alias("_d"))
    rows = decided.join(new, "case_id", "left")
    free = F.col("note_finding").isNull() & F.col("_d").isNotNull()
    rows = rows.withColumn("adjudication", F.when(free, F.col("_d.decision")).otherwise(F.col("adjudication"))).withColumn("confidence", F.when(free, F.col("_d.confidence")).otherwise(F.col("confidence")))
    return io.to_output(finish(inputs, rows.drop("_d"), calibration, priors))


QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _keep(sql: str):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


_JUDGED = "j AS (SELECT d.doc_id, d.lang, d.source, length(d.text) AS chars, l.quality, CASE WHEN l.toxic = 1 THEN 'DENIED' WHEN l.quality = 1 THEN 'APPROVED' ELSE 'NEEDS_REVIEW' END AS truth FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"


def judged(spark, sf_dir) -> DataFrame:
    """Labelled documents as cases with a true outcome."""
    d, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    truth = F.when(F.col("toxic") == 1, "DENIED").when(F.col("quality") == 1, "APPROVED").otherwise("NEEDS_REVIEW")
    return d.join(labels, "doc_id").select("doc_id", "lang", "source", F.length("text").alias("chars"), "quality", truth.alias("truth"))


@_keep(f"""WITH {_JUDGED}, g AS (SELECT chars, count(*) AS n, sum(quality) AS s, row_number() OVER (ORDER BY chars) AS i FROM j WHERE chars IS NOT NULL GROUP BY chars),
  c AS (SELECT *, sum(n) OVER (ORDER BY i) AS cn, sum(s) OVER (ORDER BY i) AS cs FROM g),
  m AS (SELECT a.i AS a, b.i AS b, min((b.cs - a.cs + a.s)::DOUBLE / (b.cn - a.cn + a.n)) OVER (PARTITION BY a.i ORDER BY b.i DESC) AS least FROM c a JOIN c b ON b.i >= a.i)
  SELECT min(chars)::DOUBLE AS lo, max(chars)::DOUBLE AS hi, sum(n)::DOUBLE AS n, round(v, 6) AS value FROM (SELECT chars, c.n, max(least) AS v FROM m JOIN c ON c.i = m.b GROUP BY chars, c.n) GROUP BY v""")
def t01_isotonic(spark, sf_dir):
    """Isotonic regression of quality on the length of labelled documents: the steps."""
    return calibrate.isotonic(judged(spark, sf_dir), "chars", F.col("quality")).select("lo", "hi", "n", F.round("value", 6).alias("value"))


_SWEEP = f"""{_JUDGED}, r AS (SELECT j.*, k AS repeat FROM j, (SELECT unnest([0, 1, 2]) AS k) WHERE lang IS NOT NULL AND source IS NOT NULL),
  f AS (SELECT *, (row_number() OVER (PARTITION BY repeat, truth ORDER BY md5(repeat || ':' || doc_id), doc_id) - 1) % 5 AS fold FROM r),
  o AS (SELECT f.*, {", ".join(f"count(*) FILTER (truth = '{o}') OVER (PARTITION BY repeat, lang) - count(*) FILTER (truth = '{o}') OVER (PARTITION BY repeat, fold, lang) AS r{k}, count(*) FILTER (truth = '{o}') OVER (PARTITION BY repeat) - count(*) FILTER (truth = '{o}') OVER (PARTITION BY repeat, fold) AS w{k}, count(*) FILTER (truth = '{o}') OVER (PARTITION BY repeat, source) AS s{k}, count(*) FILTER (truth = '{o}') OVER (PARTITION BY repeat) AS t{k}" for k, o in enumerate(P.PAYOFF))} FROM f),
  p AS (SELECT *, {", ".join(f"(r{k} + 4.0::DOUBLE * w{k} / (w0 + w1 + w2)) / (r0 + r1 + r2 + 4.0::DOUBLE) AS m{k}, round((s{k} + 4.0::DOUBLE * t{k} / (t0 + t1 + t2)) / (s0 + s1 + s2 + 4.0::DOUBLE), 6) AS q{k}" for k in range(3))} FROM o),
  e AS (SELECT p.*, w, {", ".join(f"m{k} * w + q{k} * (1.0::DOUBLE - w) AS p{k}" for k in range(3))} FROM p, (SELECT unnest([0.0, 0.2, 0.35, 0.5, 0.65, 0.8, 1.0]::DOUBLE[]) AS w)),
  v AS (SELECT *, p0 * 8 + p1 * -4 + p2 AS ea, p1 * 8 + p2 AS ed, p0 * 2 + p1 * 2 + p2 * 8 AS er FROM e),
  d AS (SELECT *, CASE WHEN ea >= ed AND ea >= er THEN 'APPROVED' WHEN ed >= er THEN 'DENIED' ELSE 'NEEDS_REVIEW' END AS decision, CASE WHEN ea >= ed AND ea >= er THEN p0 WHEN ed >= er THEN p1 ELSE p2 END AS sure FROM v),
  s AS (SELECT w, repeat, 80 * avg(CASE decision || truth WHEN 'APPROVEDAPPROVED' THEN 8 WHEN 'APPROVEDDENIED' THEN -4 WHEN 'APPROVEDNEEDS_REVIEW' THEN 1 WHEN 'DENIEDAPPROVED' THEN 0 WHEN 'DENIEDDENIED' THEN 8 WHEN 'DENIEDNEEDS_REVIEW' THEN 1 WHEN 'NEEDS_REVIEWNEEDS_REVIEW' THEN 8 ELSE 2 END) / 8 AS cls,
    20 * greatest(0, 1 - 2 * avg((sure - (decision = truth)::INT) ** 2)) AS cal, avg((decision = truth)::INT) AS acc, count(*) FILTER (decision = 'APPROVED' AND truth = 'DENIED') AS cfa FROM d GROUP BY w, repeat),
  a AS (SELECT w, avg(cls + cal) AS mean, stddev_samp(cls + cal) / sqrt(count(*)) AS se, avg(cls) AS cls, avg(cal) AS cal, avg(acc) AS acc, avg(cfa) AS cfa FROM s GROUP BY w),
  b AS (SELECT max({{'m': mean, 's': se}}) FILTER (w > 0) AS x, max(mean) FILTER (w = 0) AS base FROM a), n AS (SELECT a.*, base, w > 0 AND mean >= x.m - x.s AS within FROM a, b)"""


@_keep(f"""WITH {_SWEEP} SELECT w AS weight, round(mean, 6) AS mean, round(se, 6) AS se, round(cls, 6) AS classification, round(cal, 6) AS calibration, round(acc, 6) AS accuracy, round(cfa, 6) AS false_approvals, within,
  w > 0 AND w = (SELECT min(w) FROM n WHERE within) AS chosen, w > 0 AND w = (SELECT min(w) FROM n WHERE within) AND mean - se > base AS ships FROM n""")
def t02_blend_sweep(spark, sf_dir):
    """Blends of an out-of-fold model (shares by language) with a prior (shares by source), over three repeats of five
    folds; the weight of the one-standard-error rule, guarded by the prior alone."""
    rows = judged(spark, sf_dir).where("lang is not null and source is not null")
    folded = calibrate.repeated_folds(rows, "truth", "doc_id", 5, 3)
    oof = calibrate.out_of_fold_shares(folded, "lang", "truth")
    prior = evaluate.smoothed(rows, "source", "truth", list(calibrate.OUTCOMES)).select("source", *[F.col(f"p_{o}").alias(f"prior_{o}") for o in calibrate.OUTCOMES])
    t = calibrate.selected(calibrate.sweep(oof.join(prior, "source"), "truth"))
    return t.select("weight", *[F.round(c, 6).alias(c) for c in ("mean", "se", "classification", "calibration", "accuracy", "false_approvals")], "within", "chosen", "ships")
