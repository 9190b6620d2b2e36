"""Ranked, majority and consensus resolution of competing observations.

All operators take the fact table's columns by name, order totally, and shuffle once
on the case key unless they say otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_ranked(df: DataFrame, keys: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """Of each key the columns ``keep`` of the row first in ``order``.

    An aggregate of a struct: partial on the map side, so hot keys do not pile up as
    they would under ``row_number``. ``order`` must be ascending and total.
    """
    rank = F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], *[F.col(c).alias(f"k_{c}") for c in keep])
    return df.groupBy(*keys).agg(F.min(rank).alias("_r")).select(*keys, *[F.col(f"_r.k_{c}").alias(c) for c in keep])


def ranked(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """All rows with their place ``rn`` within the key."""
    return df.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def trust_resolve(obs: DataFrame, keys: list[str], ceiling: int = 8, score: Column | None = None) -> DataFrame:
    """The value of the best source: least trust rank, then plausibility, page and order.

    ``obs`` has value, trust, page, seq. Sources of rank 9, or above ``ceiling``, do
    not count.
    """
    seen = obs.where(F.col("trust") <= min(8, ceiling))
    order = [F.col("trust"), -(score if score is not None else F.lit(0.0)), F.col("page"), F.col("seq")]
    return first_ranked(seen, keys, order, ["value", "trust"])


def tier_majority(obs: DataFrame, keys: list[str]) -> DataFrame:
    """Of the most trusted tier with any valid value: most votes, best score, first page, least value.

    ``obs`` has value (null or invalid values are not in it), trust, page, score.
    """
    votes = obs.groupBy(*keys, "trust", "value").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("score"), F.min("page").alias("page"))
    return first_ranked(votes, keys, [F.col("trust"), -F.col("n"), -F.col("score"), F.col("page"), F.col("value")], ["value", "trust", "n"])


def consensus(obs: DataFrame, keys: list[str], lead: int = 2) -> DataFrame:
    """The commonest value where it leads the next one by ``lead`` votes or more."""
    votes = obs.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    top = ranked(votes, keys, [F.col("n").desc(), F.col("value")]).where("rn <= 2")
    two = top.groupBy(*keys).agg(F.max(F.when(F.col("rn") == 1, F.struct("n", "value"))).alias("a"), F.coalesce(F.max(F.when(F.col("rn") == 2, F.col("n"))), F.lit(0)).alias("b"))
    return two.where(F.col("a.n") - F.col("b") >= lead).select(*keys, F.col("a.value").alias("value"), F.col("a.n").alias("votes"), F.col("b").alias("runner_up"))


def unanimous(obs: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """The value of keys whose rows all agree; minimum and maximum tell, without a distinct."""
    both = obs.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias(value), F.count(F.lit(1)).alias("n"))
    return both.where(F.col("lo") == F.col(value)).select(*keys, value, "n")


def conflicts(obs: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Keys with two or more distinct values, and how many."""
    n = obs.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c")).groupBy(*keys).agg(F.count(value).alias("n_values"), F.sum("c").alias("n_obs"))
    return n.where("n_values > 1")


def corroboration(obs: DataFrame, case: str = "case_id") -> DataFrame:
    """Per case: observations, fields with one value, fields with several."""
    per = obs.groupBy(case, "field").agg(F.count(F.lit(1)).alias("n"), (F.min("value") != F.max("value")).alias("split"))
    return per.groupBy(case).agg(F.sum("n").alias("obs_total"), F.count_if(~F.col("split")).alias("fields_corroborated"), F.count_if(F.col("split")).alias("fields_conflicting"))


def corroborated(a: DataFrame, keys: list[str], page: str = "page") -> DataFrame:
    """Keys that two different pages state: distinct pages meet in an aggregate, not in a self-join."""
    return a.groupBy(*keys).agg(F.min(page).alias("first_page"), F.max(page).alias("last_page")).where("first_page <> last_page")


def pair_with_next(df: DataFrame, keys: list[str], order: list[Column], is_label: Column, is_value: Column, label: str, value: str) -> DataFrame:
    """Label rows with the row right after them, where that is a value."""
    w = W.partitionBy(*keys).orderBy(*order)
    nxt = F.lead(F.struct(F.col(value).alias("value"), is_value.alias("ok"))).over(w)
    return df.select(*keys, F.col(label).alias("label"), is_label.alias("_is"), nxt.alias("_n")).where(F.col("_is") & F.col("_n.ok")).select(*keys, "label", F.col("_n.value").alias("value"))


def first_and_last(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """First and last non-null value by a total order."""
    seen = df.where(F.col(value).isNotNull())
    return seen.groupBy(*keys).agg(F.min(F.struct(*order, value)).alias("a"), F.max(F.struct(*order, value)).alias("b")).select(*keys, F.col(f"a.{value}").alias("first_value"), F.col(f"b.{value}").alias("last_value"))


def union_flags(channels: list[DataFrame], case: str) -> DataFrame:
    """Distinct sorted flags of a case from any number of ``(case, flag)`` channels."""
    out = channels[0]
    for c in channels[1:]:
        out = out.unionByName(c)
    return out.where("flag is not null").groupBy(case).agg(F.array_sort(F.collect_set("flag")).alias("flags"))


def backfill(inputs: DataFrame, rows: DataFrame, key: str, defaults: dict) -> DataFrame:
    """Exactly one row for each input key: its row, or the defaults."""
    out = inputs.select(key).join(rows.withColumn("_hit", F.lit(True)), key, "left")
    filled = out.select(key, *[F.coalesce(c, F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in rows.columns if c != key], F.col("_hit").isNull().alias("missing"))
    return filled
