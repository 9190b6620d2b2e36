"""Calibration, scoring, drift, vocabularies and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseloom.functions.policy import PAYOFF


def smoothed(df: DataFrame, path: str, outcome: str, outcomes: list[str], strength: float = 4.0) -> DataFrame:
    """P(outcome | path), drawn towards the global shares by ``strength`` pseudo-counts."""
    counts = df.groupBy(path).agg(*[F.count_if(F.col(outcome) == o).alias(f"c_{o}") for o in outcomes], F.count(F.lit(1)).alias("support"))
    prior = counts.agg(*[(F.sum(f"c_{o}") / F.sum("support")).alias(f"g_{o}") for o in outcomes])
    p = [F.round((F.col(f"c_{o}") + strength * F.col(f"g_{o}")) / (F.col("support") + strength), 6).alias(f"p_{o}") for o in outcomes]
    return counts.crossJoin(F.broadcast(prior)).select(path, *p, "support")


def laplace(df: DataFrame, key: str, correct: Column) -> DataFrame:
    """(k + 1) / (n + 2) of each key."""
    return df.groupBy(key).agg(F.round((F.count_if(correct) + 1) / (F.count(F.lit(1)) + 2), 6).alias("accuracy"), F.count(F.lit(1)).alias("support"))


def with_probabilities(df: DataFrame, calibration: DataFrame, path: str, fallback: dict[str, float]) -> DataFrame:
    """A path's probabilities, or the global fallback where the path is new."""
    return df.join(calibration, path, "left").select(*[df[c] for c in df.columns], *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in fallback.items()])


def challenge_score(df: DataFrame, truth: str, decision: str, confidence: str) -> DataFrame:
    """Payoff, Brier score of the confidence, accuracy, and approvals of what was to be denied."""
    names = list(PAYOFF)
    points = F.lit(0.0)
    for d, row in PAYOFF.items():
        for t, w in zip(names, row, strict=True):
            points = F.when((F.col(decision) == d) & (F.col(truth) == t), F.lit(w)).otherwise(points)
    right = (F.col(decision) == F.col(truth)).cast("double")
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(points).alias("payoff"),
        F.avg(F.pow(F.col(confidence) - right, 2)).alias("brier"),
        F.avg(right).alias("accuracy"),
        F.count_if((F.col(decision) == "APPROVED") & (F.col(truth) == "DENIED")).alias("false_approvals"),
    )


def repeats(df: DataFrame, value: str) -> DataFrame:
    """Mean and standard error over repeats."""
    return df.agg(F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("standard_error"))


def shares(df: DataFrame, key: str, name: str) -> DataFrame:
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("t")))).select(key, (F.col("n") / F.col("t")).alias(name))


def drift(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Shares of each category in two sets and their difference, absent ones as 0."""
    x, y = shares(a, key, "share_a"), shares(b, key, "share_b")
    out = x.join(y, key, "full_outer").select(key, F.coalesce("share_a", F.lit(0.0)).alias("share_a"), F.coalesce("share_b", F.lit(0.0)).alias("share_b"))
    return out.withColumn("delta", F.col("share_b") - F.col("share_a"))


def unseen(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Values of ``b`` that ``a`` never has."""
    return b.select(key).distinct().join(a.select(key).distinct(), key, "left_anti")


def histogram(df: DataFrame, value: str, edges: tuple[float, ...] = (0.0, 0.4, 0.6, 0.8, 1.01)) -> DataFrame:
    """Counts between fixed edges, each bucket open above."""
    b = F.lit(None).cast("int")
    for k in range(len(edges) - 2, -1, -1):
        b = F.when((F.col(value) >= edges[k]) & (F.col(value) < edges[k + 1]), F.lit(k)).otherwise(b)
    return df.select(b.alias("bucket")).where("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def prior_lexicon(df: DataFrame, fields: list[str]) -> DataFrame:
    """Of each closed field the values, their counts, shares (5 places) and whether they are the mode."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("x")).select("x.field", "x.value").where("value is not null")
    counts = long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("field").agg(F.sum("n").alias("t"), F.min(F.struct((-F.col("n")).alias("k"), "value")).alias("m"))
    return counts.join(F.broadcast(totals), "field").select("field", "value", "n", F.round(F.col("n") / F.col("t"), 5).alias("share"), (F.col("value") == F.col("m.value")).alias("is_mode"))


def name_tokens(df: DataFrame, name: str) -> DataFrame:
    """First and last tokens of names of two tokens or more, with counts."""
    tokens = F.split(F.trim(F.col(name)), r"\s+")
    both = df.where(F.size(tokens) >= 2).select(F.explode(F.array(F.struct(F.lit("first").alias("position"), F.get(tokens, F.lit(0)).alias("token")), F.struct(F.lit("last").alias("position"), F.try_element_at(tokens, F.lit(-1)).alias("token")))).alias("x"))
    return both.groupBy("x.position", "x.token").agg(F.count(F.lit(1)).alias("n"))


def stratified_folds(df: DataFrame, label: str, key: str, k: int, seed: int = 0) -> DataFrame:
    """Fold numbers 0 to k-1 in which each label is dealt evenly: its rows take them in turn, in the
    order of a hash of the key, the same in every run."""
    w = W.partitionBy(label).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)
    return df.withColumn("fold", ((F.row_number().over(w) - 1) % k).cast("int"))


def unclassified(flags: DataFrame, known: list[str]) -> DataFrame:
    """Distinct flags of ``flags (flag)`` that no class lists."""
    return flags.select("flag").distinct().where(~F.col("flag").isin(*known))


def trainable(rows: DataFrame) -> DataFrame:
    """Rows a model learns from: read without failure, and not settled by a note."""
    return rows.where(~F.coalesce("failed", F.lit(False)) & F.col("note_finding").isNull())


def with_out_of_fold(df: DataFrame, oof: DataFrame, key: str, settled: str) -> DataFrame:
    """Rows with their out-of-fold probabilities ``p``; those without any are on the ``settled`` path."""
    out = df.join(oof.select(key, "p"), key, "left")
    return out.withColumn("path", F.when(F.col("p").isNull(), F.lit(settled)).otherwise(F.col("path")))


def percent(c: Column, places: int = 1) -> Column:
    """A share as text in percent."""
    return F.format_string(f"%.{places}f%%", c * 100)


def global_prior(df: DataFrame, outcome: str) -> DataFrame:
    """``outcome, p``: shares of the outcomes, six places."""
    counts = df.groupBy(outcome).agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("t")))).select(outcome, F.round(F.col("n") / F.col("t"), 6).alias("p"))


def one_standard_error(rows: list[tuple[float, float, float]]) -> float:
    """Of (setting, mean, error) the least setting within one error of the best mean."""
    best = max(rows, key=lambda r: (r[1], -r[0]))
    return min(r[0] for r in rows if r[1] >= best[1] - best[2])


def top_counts(df: DataFrame, keys: list[str], value: str, n: int) -> DataFrame:
    """The ``n`` commonest values of each key: the report keeps no more."""
    from caseloom.operators.resolve import ranked

    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return ranked(counts, keys, [F.col("n").desc(), F.col(value)]).where(F.col("rn") <= n)
