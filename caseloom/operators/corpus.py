"""Corpus-wide statistics that the second phase needs, and repairs that use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def index_pick(counts: DataFrame, keys: list[str], value: str, q: Column, name: str) -> DataFrame:
    """The element of the sorted values at index ``q(n)``: ``sorted(values)[i]``.

    ``counts`` holds each value once, with ``n``. The running count over distinct
    values finds the index without gathering all values in an array; ``q`` is an
    expression of ``total``.
    """
    w = W.partitionBy(*keys)
    run = counts.withColumn("total", F.sum("n").over(w)).withColumn("upto", F.sum("n").over(w.orderBy(value)))
    return run.where(F.col("upto") > q).groupBy(*keys).agg(F.min(value).alias(name))


def value_counts(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """``*keys, value, n``: rows of each value, or the sum of ``weight`` where rows are counts already."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))


def median_date(df: DataFrame, keys: list[str], date: str, weight: str | None = None) -> DataFrame:
    """Upper median: the date at index n div 2."""
    return index_pick(value_counts(df, keys, date, weight), keys, date, F.floor(F.col("total") / 2), "median_date")


def reference_date(df: DataFrame, keys: list[str], date: str, least_window: int = 730, spread: int = 6, weight: str | None = None) -> DataFrame:
    """Robust latest date: the index 98% of dates near the median.

    Dates further from the median than ``max(least_window, spread * MAD)`` days are
    trimmed; if that leaves none, none are.
    """
    counts = value_counts(df, keys, date, weight).withColumn("day", F.unix_date(date).cast("long"))
    middle = index_pick(counts, keys, "day", F.floor(F.col("total") / 2), "median")
    off = counts.join(middle, keys).withColumn("off", F.abs(F.col("day") - F.col("median"))) if keys else counts.crossJoin(F.broadcast(middle)).withColumn("off", F.abs(F.col("day") - F.col("median")))
    mad = index_pick(off.groupBy(*keys, "off").agg(F.sum("n").alias("n")), keys, "off", F.floor(F.col("total") / 2), "mad")
    near = off.join(mad, keys) if keys else off.crossJoin(F.broadcast(mad))
    kept = near.where(F.col("off") <= F.greatest(F.lit(least_window), spread * F.col("mad"))).select(*keys, "day", "n")
    p98 = index_pick(kept, keys, "day", F.least(F.col("total") - 1, F.floor(F.col("total") * 0.98)), "ref")
    return p98.select(*keys, F.date_from_unix_date(F.col("ref").cast("int")).alias("reference_date"))


def frequency_outliers(df: DataFrame, value: str, multiple: float = 4.0, least_distinct: int = 400, weight: str | None = None) -> DataFrame:
    """Values far commoner than the 99th percentile of counts (index rule), if enough are distinct."""
    counts = value_counts(df, [], value, weight)
    levels = counts.groupBy(F.col("n").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    p99 = index_pick(levels, [], "level", F.floor(F.col("total") * 0.99), "p99")
    size = counts.agg(F.count(F.lit(1)).alias("n_distinct"))
    bar = p99.crossJoin(size)
    return counts.crossJoin(F.broadcast(bar)).where((F.col("n_distinct") >= least_distinct) & (F.col("n") > multiple * F.col("p99"))).select(value, "n", "p99")


def contiguous_years(df: DataFrame, year: str, support: int = 50, weight: str | None = None) -> DataFrame:
    """The unbroken run of supported years around the commonest one (ties: the later year)."""
    counts = value_counts(df, [], year, weight)
    islands = counts.where(F.col("n") >= support).withColumn("island", F.col(year) - F.row_number().over(W.orderBy(year)))
    mode = islands.agg(F.max(F.struct("n", year, "island")).alias("m")).select(F.col("m.island").alias("island"))
    return islands.join(F.broadcast(mode), "island").select(year, "n")


def year_counts(years: DataFrame) -> DataFrame:
    """One row ``year_counts``: ``years (year, n)`` as an array, as small as years are."""
    return years.agg(F.collect_list(F.struct(F.col("n").cast("long").alias("n"), F.col("year").cast("string").alias("y"))).alias("year_counts"))


def repaired(date: Column, counts: Column, dominance: int = 4, least_records: int = 50) -> Column:
    """A date whose year is unknown, moved to the year one digit off; null where its year is known or none will do.

    ``counts`` is the array of ``year_counts``. Of several such years the commonest must
    have ``dominance`` times the records of the next, of ``least_records`` in all; 29
    February moves only to leap years.
    """
    y = F.lpad(F.year(date).cast("string"), 4, "0")
    one_off = lambda a, b: sum((F.substring(a, k, 1) != F.substring(b, k, 1)).cast("int") for k in range(1, 5)) == 1
    near = F.sort_array(F.filter(counts, lambda s: one_off(s["y"], y)), asc=False)
    best, second = F.get(near, F.lit(0)), F.coalesce(F.get(near, F.lit(1))["n"], F.lit(0))
    records = F.aggregate(counts, F.lit(0).cast("long"), lambda a, s: a + s["n"])
    moved = F.try_to_date(F.concat(best["y"], F.date_format(date, "-MM-dd")), "yyyy-MM-dd")
    known = F.exists(counts, lambda s: s["y"] == y)
    return F.when(~known & (records >= least_records) & best.isNotNull() & (best["n"] >= dominance * second), moved)


def repair_years(df: DataFrame, date: str, years: DataFrame, dominance: int = 4, least_records: int = 50) -> DataFrame:
    """``repaired``: the date itself if its year is in ``years (year, n)``, else moved as ``repaired`` does."""
    out = df.crossJoin(F.broadcast(year_counts(years)))
    known = F.exists("year_counts", lambda s: s["y"] == F.lpad(F.year(date).cast("string"), 4, "0"))
    return out.withColumn("repaired", F.when(known, F.col(date)).otherwise(repaired(F.col(date), F.col("year_counts"), dominance, least_records))).drop("year_counts")


def mode_fill(df: DataFrame, value: str, is_missing: Column) -> DataFrame:
    """Missing values become the commonest present one (ties: the least)."""
    mode = df.where(~is_missing).groupBy(value).agg(F.count(F.lit(1)).alias("n")).agg(F.min(F.struct((-F.col("n")).alias("k"), F.col(value).alias("v")))["v"].alias("_mode"))
    return df.crossJoin(F.broadcast(mode)).withColumn(value, F.when(is_missing, F.coalesce("_mode", value)).otherwise(F.col(value))).drop("_mode")


def with_context(df: DataFrame, context: DataFrame) -> DataFrame:
    """A one-row context on every row; the aggregate makes it one row whatever it is given."""
    one = context.agg(*[F.first(c).alias(c) for c in context.columns])
    return df.crossJoin(F.broadcast(one))


def profile(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, minimum, p10, median and maximum, percentiles by index."""
    counts = value_counts(df, keys, value)
    base = counts.groupBy(*keys).agg(F.sum("n").alias("n"), F.min(value).alias("min"), F.max(value).alias("max"))
    p10 = index_pick(counts, keys, value, F.floor(F.col("total") * 0.1), "p10")
    mid = index_pick(counts, keys, value, F.floor(F.col("total") / 2), "median")
    return base.join(p10, keys).join(mid, keys)


def settle_box_date(strict: Column, cheap: Column, counts: Column, modal: Column) -> Column:
    """One date from staged readings, or null.

    ``strict`` readings (arrays of dates as text) count repaired into the known years where
    that is possible, ``cheap`` ones only in the modal year; all that count must agree.
    """
    day = lambda d: F.try_to_date(d, "yyyy-MM-dd")
    mended = F.transform(strict, lambda d: F.coalesce(F.date_format(repaired(day(d), counts), "yyyy-MM-dd"), d))
    one = F.array_distinct(F.concat(mended, F.filter(cheap, lambda d: F.substring(d, 1, 4).cast("int") == modal)))
    return F.when((F.size(one) == 1) & (F.size(counts) > 0), F.get(one, F.lit(0)))


def settle_box_sponsor(printed: Column, box: Column, seen: Column, rescue: Column, revoked: Column, mode: Column) -> Column:
    """What is printed, or a box's sponsor.

    A printed sponsor gives way to ``box`` if that was ``seen`` elsewhere, and the commonest
    sponsor ``mode``, a mere guess, to ``rescue`` or else ``box``. Never does one revoked
    sponsor replace another, nor a revoked one the guess.
    """
    hit = lambda c: F.coalesce(F.array_contains(revoked, c), F.lit(False))
    guess = F.coalesce(printed == mode, F.lit(False))
    new = F.when(guess, F.coalesce(rescue, box)).when(F.coalesce(seen, F.lit(False)), box)
    barred = hit(new) & (guess | hit(printed))
    return F.when(new.isNotNull() & ~barred, new).otherwise(printed)


def presence(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: how many rows have a value in each of the columns, and how many there are."""
    return df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"has_{c}") for c in columns])


def corpus_state(cases: DataFrame) -> DataFrame:
    """``kind, value, n``: all that a corpus has to be remembered by to give context to other cases.

    Arrival dates and sponsors as policy knows them, and the sponsors that are printed
    (where ``cases`` has them). States of parts of a corpus add up to that of the whole.
    """
    pairs = [("arrival", "arrival_date"), ("sponsor", "sponsor_id"), ("shown", "printed_sponsor_id")]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("value")) for k, c in pairs if c in cases.columns]))
    return cases.select(each.alias("x")).select("x.*").where("value is not null").groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))


def merged_states(states: list[DataFrame]) -> DataFrame:
    """The state of the corpora of ``states`` taken together."""
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    return out.groupBy("kind", "value").agg(F.sum("n").alias("n"))
