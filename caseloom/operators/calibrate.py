"""Calibration of scores: isotonic regression by merging blocks, and a sigmoid; blends and their selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseloom.functions.policy import PAYOFF, blend, decide
from caseloom.sources.stages import staged

OUTCOMES = tuple(PAYOFF)
#: Points of a perfect classification and of perfect confidences, and the payoff of a right decision. Fixed values.
CLASSIFICATION_POINTS, CALIBRATION_POINTS, MOST_PAYOFF = 80.0, 20.0, 8.0
#: Weights of the model that a sweep tries, besides the model alone.
WEIGHTS = (0.2, 0.35, 0.5, 0.65, 0.8)
#: Places to which a fitted step function is kept when it is applied: it has no more steps than values then.
PLACES = 4


def _pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adjacent violators pooled within each part: ``part, lo, hi, n, s`` in order, with means that never fall."""
    stack: list[list] = []
    now = None

    def rows() -> pa.RecordBatch:
        columns = list(zip(*[[now, *b] for b in stack], strict=True))
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.float64()), strict=True)], ["part", "lo", "hi", "n", "s"])

    for batch in batches:
        for part, lo, hi, n, s in zip(*(batch.column(c).to_pylist() for c in ("part", "lo", "hi", "n", "s")), strict=True):
            if part != now:
                if stack:
                    yield rows()
                now, stack = part, []
            stack.append([lo, hi, n, s])
            # a block that is not above the one before it joins it
            while len(stack) > 1 and stack[-2][3] * stack[-1][2] >= stack[-1][3] * stack[-2][2]:
                _, hi_, n_, s_ = stack.pop()
                stack[-1][1:] = [hi_, stack[-1][2] + n_, stack[-1][3] + s_]
    if stack:
        yield rows()


def isotonic(points: DataFrame, score: str, label: Column, weight: Column | None = None, parts: int = 64) -> DataFrame:
    """``lo, hi, n, value``: the non-decreasing step function of ``score`` nearest to ``label`` by squares.

    Equal scores are one point. The points are cut into ranges of scores, and violators are
    pooled within each; what is left is a block a step. As pooling may start from blocks as
    well as from points, neighbouring ranges are then put together, two by two, until no border
    is violated: mostly long before one range is left.
    """
    w = F.lit(1.0) if weight is None else weight.cast("double")
    rows = points.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("lo")).agg(F.sum(w).alias("n"), F.sum(w * label.cast("double")).alias("s"))
    schema = "part long, lo double, hi double, n double, s double"
    rows = rows.withColumn("hi", F.col("lo")).repartitionByRange(parts, "lo").withColumn("part", F.spark_partition_id().cast("long"))
    blocks = staged(rows.select("part", "lo", "hi", "n", "s").sortWithinPartitions("part", "lo").mapInArrow(_pooled, schema), "isotonic")
    while parts > 1:
        end = lambda f: f(F.struct("lo", "n", "s"))
        ends = blocks.groupBy("part").agg(end(F.min).alias("a"), end(F.max).alias("b"))  # a row a range
        after = F.lead("a").over(W.orderBy("part"))
        bad = ends.select(F.col("b"), after.alias("c")).where("c is not null and b.s * c.n >= c.s * b.n")
        if not bad.limit(1).count():
            break
        parts = -(-parts // 2)
        merged = blocks.withColumn("part", F.floor(F.col("part") / 2)).repartition(parts, "part").sortWithinPartitions("part", "lo")
        blocks = staged(merged.mapInArrow(_pooled, schema), "isotonic")
    return blocks.select("lo", "hi", "n", (F.col("s") / F.col("n")).alias("value"))


def apply_steps(df: DataFrame, score: str, steps: DataFrame, name: str) -> DataFrame:
    """``df`` with the step function ``isotonic`` of its scores, straight lines between the steps.

    Values are kept to ``PLACES`` places, so there are at most 10,001 steps of a share, and every task gets them all.
    """
    few = steps.groupBy(F.round("value", PLACES).alias("v")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    known = few.agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "v"))).alias("_steps"))

    def at(x: Column, s: Column) -> Column:
        within = F.filter(s, lambda b: (b["lo"] <= x) & (x <= b["hi"]))
        below, above = F.filter(s, lambda b: b["hi"] < x), F.filter(s, lambda b: b["lo"] > x)
        a, b = F.try_element_at(below, F.lit(-1)), F.get(above, F.lit(0))
        between = a["v"] + (b["v"] - a["v"]) * (x - a["hi"]) / (b["lo"] - a["hi"])
        return F.when(x.isNull(), F.lit(None)).otherwise(F.coalesce(F.get(within, F.lit(0))["v"], between, a["v"], b["v"]))

    return df.crossJoin(F.broadcast(known)).withColumn(name, at(F.col(score).cast("double"), F.col("_steps"))).drop("_steps")


def sigmoid(df: DataFrame, score: str, label: str, name: str, held: DataFrame | None = None) -> DataFrame:
    """``held`` (by default ``df``) with the logistic curve of ``score`` that is fitted on ``df``."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    one = VectorAssembler(inputCols=[score], outputCol="_x")
    model = LogisticRegression(featuresCol="_x", labelCol=label, probabilityCol="_p", predictionCol="_y", rawPredictionCol="_r").fit(one.transform(df))
    return model.transform(one.transform(df if held is None else held)).withColumn(name, vector_to_array("_p")[1]).drop("_x", "_p", "_y", "_r")


def calibrated(held: DataFrame, learnt: DataFrame, classes: tuple[str, ...], label: str, method: str = "isotonic") -> DataFrame:
    """``held`` with ``q_<class>``: probabilities ``p_<class>`` calibrated class by class on out-of-fold rows ``learnt``
    (with the same columns and ``label``), and made to sum to one."""
    out = held
    for c in classes:
        if method == "isotonic":
            out = apply_steps(out, f"p_{c}", isotonic(learnt, f"p_{c}", F.col(label) == c), f"q_{c}")
        else:
            out = sigmoid(learnt.withColumn("_y01", (F.col(label) == c).cast("double")), f"p_{c}", "_y01", f"q_{c}", out)
    whole = sum(F.col(f"q_{c}") for c in classes)
    even = F.lit(1.0 / len(classes))
    return out.select(*[c for c in out.columns if c not in {f"q_{k}" for k in classes}], *[F.when(whole > 0, F.col(f"q_{c}") / whole).otherwise(even).alias(f"q_{c}") for c in classes])


def repeated_folds(df: DataFrame, label: str, key: str, k: int, repeats: int) -> DataFrame:
    """``df`` once for each repeat, with ``repeat`` and ``fold``: the rows of each label take the folds in
    turn, in the order of the MD5 of repeat and key, so repeats deal them independently."""
    each = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    order = F.md5(F.concat_ws(":", "repeat", key).cast("binary"))
    w = W.partitionBy("repeat", label).orderBy(order, key)
    return each.withColumn("fold", ((F.row_number().over(w) - 1) % k).cast("int"))


def out_of_fold_shares(folded: DataFrame, by: str, outcome: str, outcomes: tuple[str, ...] = OUTCOMES, strength: float = 4.0) -> DataFrame:
    """``folded`` with ``m_<outcome>``: P(outcome | by) of the rows of other folds of its repeat, drawn to their overall
    shares by ``strength`` pseudo-counts. One count serves all folds: a fold's own counts are taken off the whole."""
    counts = lambda keys, s: folded.groupBy(*keys).agg(*[F.count_if(F.col(outcome) == o).alias(f"{s}{k}") for k, o in enumerate(outcomes)])
    cell, fold, row, whole = counts(["repeat", "fold", by], "c"), counts(["repeat", "fold"], "f"), counts(["repeat", by], "r"), counts(["repeat"], "w")
    out = folded.join(cell, ["repeat", "fold", by]).join(fold, ["repeat", "fold"]).join(row, ["repeat", by]).join(whole, ["repeat"])
    ks = range(len(outcomes))
    n, rest = sum(F.col(f"r{k}") - F.col(f"c{k}") for k in ks), sum(F.col(f"w{k}") - F.col(f"f{k}") for k in ks)
    share = lambda k: (F.col(f"r{k}") - F.col(f"c{k}") + strength * (F.col(f"w{k}") - F.col(f"f{k}")) / rest) / (n + strength)
    return out.select(*folded.columns, *[share(k).alias(f"m_{o}") for k, o in enumerate(outcomes)])


def sweep(rows: DataFrame, truth: str, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``weight, mean, se, classification, calibration, accuracy, false_approvals``: scores of blends over repeats.

    ``rows (repeat, truth, m_<outcome>, prior_<outcome>)`` are out-of-fold. A row meets all weights at
    once, so one pass scores them all; weight 0 is the prior alone, 1 the model alone.
    """
    each = rows.withColumn("weight", F.explode(F.array(*[F.lit(float(w)) for w in (0.0, *weights, 1.0)])))
    p = tuple(F.col(f"m_{o}") * F.col("weight") + F.col(f"prior_{o}") * (1.0 - F.col("weight")) for o in OUTCOMES)
    each = each.select("repeat", "weight", F.col(truth).alias("truth"), decide(p).alias("d"))
    points = F.lit(0.0)
    for d, row in PAYOFF.items():
        for t, v in zip(OUTCOMES, row, strict=True):
            points = F.when((F.col("d.decision") == d) & (F.col("truth") == t), F.lit(v)).otherwise(points)
    right = (F.col("d.decision") == F.col("truth")).cast("double")
    one = each.groupBy("weight", "repeat").agg(
        (CLASSIFICATION_POINTS * F.avg(points) / MOST_PAYOFF).alias("classification"), (CALIBRATION_POINTS * F.greatest(F.lit(0.0), 1.0 - 2.0 * F.avg(F.pow(F.col("d.confidence") - right, 2)))).alias("calibration"),
        F.avg(right).alias("accuracy"), F.count_if((F.col("d.decision") == "APPROVED") & (F.col("truth") == "DENIED")).alias("false_approvals"),
    )
    total = F.col("classification") + F.col("calibration")
    se = F.when(F.count(F.lit(1)) > 1, F.stddev_samp(total) / F.sqrt(F.count(F.lit(1)))).otherwise(0.0)
    return one.groupBy("weight").agg(F.avg(total).alias("mean"), se.alias("se"), *[F.avg(c).alias(c) for c in ("classification", "calibration", "accuracy", "false_approvals")])


def selected(table: DataFrame, tie_break: str = "conservative", pin: float | None = None) -> DataFrame:
    """A ``sweep`` with ``within``, ``chosen`` and ``ships``.

    Within one standard error of the best mean all weights are alike. Of these the least is
    chosen, or with ``tie_break`` aggressive the greatest; a ``pin`` overrides that. The prior
    alone is what others have to beat: the chosen blend ships only if its mean less its error does.
    """
    tried = F.col("weight") > 0
    best = F.max(F.when(tried, F.struct("mean", "se")))
    edge = table.agg((best["mean"] - best["se"]).alias("_edge"), F.max(F.when(F.col("weight") == 0, F.col("mean"))).alias("_base"))
    t = table.crossJoin(F.broadcast(edge)).withColumn("within", tried & (F.col("mean") >= F.col("_edge")))
    rank = F.struct((F.col("weight") if tie_break == "conservative" else -F.col("weight")).alias("k"), "weight")
    choice = t.agg(F.lit(pin).cast("double").alias("_w") if pin is not None else F.min(F.when(F.col("within"), rank))["weight"].alias("_w"))
    t = t.crossJoin(F.broadcast(choice)).withColumn("chosen", tried & F.col("weight").eqNullSafe(F.col("_w")))
    return t.withColumn("ships", F.col("chosen") & (F.col("mean") - F.col("se") > F.col("_base"))).drop("_edge", "_base", "_w")


def blended(rows: DataFrame, weight: float) -> DataFrame:
    """``rows`` with ``p_approved, p_denied, p_review``: the model's probabilities blended with the prior's."""
    names = ("p_approved", "p_denied", "p_review")
    return rows.select("*", *[blend(F.col(f"m_{o}"), F.col(f"prior_{o}"), weight).alias(n) for o, n in zip(OUTCOMES, names, strict=True)])


def brute_force_isotonic(scores: np.ndarray, labels: np.ndarray) -> dict[float, float]:
    """The same function from its definition, for small inputs: at each score the greatest over all
    starts before it of the least mean over all ends behind it."""
    xs = np.unique(scores)
    n = np.array([(scores == x).sum() for x in xs], float)
    s = np.array([labels[scores == x].sum() for x in xs], float)
    mean = lambda j, k: s[j : k + 1].sum() / n[j : k + 1].sum()
    return {float(x): max(min(mean(j, k) for k in range(i, len(xs))) for j in range(i + 1)) for i, x in enumerate(xs)}
