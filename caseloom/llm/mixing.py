"""Mixing sources to target weights, by repeating and sampling whole documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseloom.llm.common import materialize, word_count

#: Weights of the sources in the order of their names, over and over.
WEIGHTS = (1, 2, 3)
#: No source and no document is taken more often than this.
MOST = 3


def source_rates(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size, target, rate`` for ``sizes (source, size)``; one row a source.

    The sources, by code point and null last, take ``weights`` in turn and share the
    sum of all sizes. A target stops at ``most`` times its source's size; what is
    above is shared again by weight until none is above. That ends at one level:
    sources in the order of cap over weight stop one after the other, and the first
    whose cap is above its share of what is left sets the level for the rest. The
    windows run over one row a source, never over documents. Rates of sources
    without words are 0.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("n", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("n") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("w", weight.cast("long")).withColumn("cap", F.col("source_size") * most)
    order = W.orderBy(F.col("cap") / F.col("w"), "n")
    before, onward = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    level = ranked.withColumn("left", F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("share", F.sum("w").over(onward))
    big = lambda c: F.col(c).cast("decimal(19,0)")
    level = level.withColumn("open", big("cap") * big("share") > big("left") * big("w"))
    first = F.min(F.when(F.col("open"), F.struct(F.col("share") * -1, "left", "share"))).over(W.partitionBy())
    level = level.withColumn("at", first)
    open_ = F.col("at").isNotNull() & (F.col("share") <= F.col("at.share"))
    target = F.when(open_, F.col("w") * F.col("at.left").cast("double") / F.col("at.share")).otherwise(F.col("cap").cast("double"))
    out = level.withColumn("target", target)
    return out.select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"))


def written_rates(sizes: DataFrame) -> DataFrame:
    """``source_rates`` as a written table, whose size the planner knows: it broadcasts the table
    where that is below the session's threshold, so texts are not shuffled by source."""
    return materialize(source_rates(sizes), "mix-rates")


def draw(doc_id: Column, seed: int) -> Column:
    """A number from 0 to below 1 that doc_id and seed decide, the same in every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def copies(rate: Column, doc_id: Column, seed: int) -> Column:
    """floor(rate), and one more with the probability of the fraction."""
    return (F.floor(rate) + (draw(doc_id, seed) < rate - F.floor(rate)).cast("long")).cast("long")


def mix_sizes(sizes: DataFrame, seed: int = 0) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for ``sizes (doc_id, source, size)``."""
    rates = written_rates(sizes).withColumnRenamed("source", "_source")
    out = sizes.join(rates, F.col("source").eqNullSafe(F.col("_source")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies(F.col("rate"), F.col("doc_id"), seed)).alias("taken"))


def with_sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The rows of ``docs (doc_id, text, source, ...)`` as often as the mix takes them.

    All columns are kept; repeated rows are drawn alike, by doc_id and seed. Null and
    empty texts have no words but are drawn like the rest; sources that have no words
    at all are not taken. A null source is a source of its own, the last.
    """
    rates = written_rates(with_sizes(docs)).select(F.col("source").alias("_source"), F.col("rate").alias("_rate"))
    drawn = docs.join(rates, F.col("source").cast("string").eqNullSafe(F.col("_source")))
    drawn = drawn.withColumn("_copies", copies(F.col("_rate"), F.col("doc_id"), seed)).where("_copies > 0")
    return drawn.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select([docs[c] for c in docs.columns])
