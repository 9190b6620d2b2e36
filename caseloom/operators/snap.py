"""Nearest-vocabulary matching: distinct readings meet values of near length, joined back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseloom.functions.distance import SCAN, Costs, distance
from caseloom.functions.text import canon


def confidence(best: Column, second: Column, n: Column, ratio: float) -> Column:
    """1 at distance 0, falling to 0 at the budget; 0.35 of it when a runner-up is close."""
    budget = F.greatest(F.lit(1.0), n * ratio)
    c = F.greatest(F.lit(0.0), 1.0 - best / budget)
    tied = (best > 0) & (second - best < 0.5)
    return F.when(best > budget, F.lit(0.0)).otherwise(F.when(tied, c * 0.35).otherwise(c))


def snap(readings: DataFrame, vocabulary: DataFrame, reading: str, keys: list[str] | None = None, ratio: float = 0.34, costs: Costs = SCAN) -> DataFrame:
    """``*keys, reading, snapped, confidence, distance`` for each distinct reading.

    ``vocabulary`` has ``*keys, idx, value``. Only distinct canonical readings meet
    the vocabulary, joined by length: values whose length alone exceeds the budget are
    left out, as a change of length by one costs 0.4 at least. Ties go to the least ``idx``.
    Readings without letters or digits, or too far from all values, get null and 0.
    """
    keys = keys or []
    seen = readings.select(*keys, F.col(reading), canon(F.col(reading)).alias("_c")).distinct()
    want = seen.where("_c <> ''").select(*keys, "_c").distinct()
    words = vocabulary.select(*keys, "idx", "value", canon(F.col("value")).alias("_w"))
    cheapest = 1.0 if not costs.joined else costs.joined_cost
    budget = F.greatest(F.lit(1.0), F.length("_c") * ratio)
    near = F.abs(F.length("_c") - F.length("_w")) * cheapest <= budget + 0.5
    reach = F.ceil((budget + 0.5) / cheapest).cast("int")
    lengths = F.sequence(F.greatest(F.length("_c") - reach, F.lit(0)), F.length("_c") + reach)
    pairs = want.withColumn("_n", F.explode(lengths)).join(words.withColumn("_n", F.length("_w")), [*keys, "_n"])
    scored = pairs.where(near).withColumn("_d", distance(F.col("_c"), F.col("_w"), costs))
    # the two nearest of each reading; all others are cut before the shuffle too
    place = F.row_number().over(W.partitionBy(*keys, "_c").orderBy("_d", "idx", "value"))
    two = scored.withColumn("_n", place).where("_n <= 2").groupBy(*keys, "_c").agg(F.max(F.when(F.col("_n") == 1, F.struct(F.col("_d").alias("d"), "value"))).alias("_r"), F.max(F.when(F.col("_n") == 2, F.col("_d"))).alias("_s"))
    out = two.select(*keys, "_c", F.col("_r.value").alias("_v"), F.col("_r.d").alias("_d"), confidence(F.col("_r.d"), F.coalesce("_s", F.lit(1e9)), F.length("_c"), ratio).alias("_k"))
    joined = seen.join(out, [*keys, "_c"], "left")
    hit = F.col("_k") > 0
    return joined.select(*keys, reading, F.when(hit, F.col("_v")).alias("snapped"), F.coalesce("_k", F.lit(0.0)).alias("confidence"), "_d").withColumnRenamed("_d", "distance")


def snap_names(readings: DataFrame, first_tokens: DataFrame, last_tokens: DataFrame, reading: str, costs: Costs = SCAN) -> DataFrame:
    """Names by their first and last token; tokens that match nothing stay, middle ones go.

    Confidence is that of the weaker token; names of one token have none.
    """
    tokens = F.split(F.trim(F.col(reading)), r"\s+")
    names = readings.select(reading).distinct().withColumn("_a", F.get(tokens, F.lit(0))).withColumn("_b", F.when(F.size(tokens) > 1, F.try_element_at(tokens, F.lit(-1))))
    one = snap(names.select("_a"), first_tokens, "_a", costs=costs).select("_a", F.col("snapped").alias("_sa"), F.col("confidence").alias("_ca"))
    two = snap(names.where("_b is not null").select("_b"), last_tokens, "_b", costs=costs).select("_b", F.col("snapped").alias("_sb"), F.col("confidence").alias("_cb"))
    out = names.join(one, "_a", "left").join(two, "_b", "left")
    both = F.col("_b").isNotNull()
    return out.select(reading, F.when(both, F.concat_ws(" ", F.coalesce("_sa", "_a"), F.coalesce("_sb", "_b"))).otherwise(F.col(reading)).alias("snapped"), F.when(both, F.least("_ca", "_cb")).otherwise(F.lit(0.0)).alias("confidence"))


def unique_prefix(readings: DataFrame, vocabulary: DataFrame, reading: str, least: int = 6) -> DataFrame:
    """The value of which the reading is a beginning, if it is one value only.

    Hashes of the first ``least``, twice, four times ... as many letters tell which lengths
    of readings a value may be asked for; it is hashed at those lengths, and beginnings are
    counted before readings meet them. A reading meets one count and at most one value, however
    many values share its beginning, and a text travels twice: to its lengths, and as the result.
    Rows of equal values count one by one.
    """
    seen = readings.select(reading).distinct().withColumn("_c", canon(F.col(reading))).where(F.length("_c") >= least)
    name = lambda c: [F.xxhash64(c).alias("_a"), F.xxhash64(F.lit(1), c).alias("_b")]
    words = vocabulary.where("value is not null").select(*name(F.col("value")), canon(F.col("value")).alias("_w")).where(F.length("_w") >= least)
    levels = lambda c: F.floor(F.log2(F.length(c) / F.lit(float(least))) + 1e-9).cast("int")
    head = lambda c, k: F.xxhash64(F.substring(c, F.lit(1), (F.pow(F.lit(2.0), k) * least).cast("int")))
    starts = words.select("_a", "_b", F.length("_w").alias("_most"), F.explode(F.transform(F.sequence(F.lit(0), levels("_w")), lambda k: F.struct(k.alias("k"), head(F.col("_w"), k).alias("h")))).alias("s"))
    asked = seen.select(levels("_c").alias("_k"), "_c").select("_k", head(F.col("_c"), F.col("_k")).alias("_h"), F.length("_c").alias("_n")).distinct()
    lengths = starts.select("_a", "_b", "_most", F.col("s.k").alias("_k"), F.col("s.h").alias("_h")).join(asked, ["_k", "_h"]).where("_n <= _most").groupBy("_a", "_b").agg(F.collect_set("_n").alias("_lengths"))
    cut = words.join(lengths, ["_a", "_b"]).select("_a", "_b", F.explode(F.transform("_lengths", lambda n: F.struct(n.alias("n"), *[h.alias(x) for h, x in zip(name(F.substring(F.col("_w"), F.lit(1), n)), "xy", strict=True)]))).alias("s"))
    once = cut.groupBy("s.n", "s.x", "s.y").agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct("_a", "_b")).alias("m")).where("rows = 1")
    begun = seen.select(reading, F.length("_c").alias("n"), *[h.alias(x) for h, x in zip(name(F.col("_c")), "xy", strict=True)])
    hits = begun.join(once, ["n", "x", "y"]).select(reading, "m._a", "m._b")
    return hits.join(vocabulary.where("value is not null").select("value", *name(F.col("value"))), ["_a", "_b"]).select(reading, "value")


def _begins(readings: DataFrame, vocabulary: DataFrame, reading: str, least: int = 6) -> DataFrame:
    """``unique_prefix`` for a fixed vocabulary of a few values: readings meet the values themselves."""
    seen = readings.select(reading).distinct().withColumn("_c", canon(F.col(reading))).where(F.length("_c") >= least)
    words = vocabulary.select("value", canon(F.col("value")).alias("_w")).where(F.length("_w") >= least)
    levels = lambda c: F.floor(F.log2(F.length(c) / F.lit(float(least))) + 1e-9).cast("int")
    head = lambda c, k: F.xxhash64(F.substring(c, F.lit(1), (F.pow(F.lit(2.0), k) * least).cast("int")))
    starts = words.withColumn("_k", F.explode(F.sequence(F.lit(0), levels("_w")))).withColumn("_h", head(F.col("_w"), F.col("_k")))
    hashed = seen.withColumn("_k", levels("_c")).withColumn("_h", head(F.col("_c"), F.col("_k")))
    hits = hashed.join(starts, ["_k", "_h"]).where(F.startswith(F.col("_w"), F.col("_c")))
    return hits.groupBy(reading).agg(F.min("value").alias("value"), F.count(F.lit(1)).alias("n")).where("n = 1").select(reading, "value")


def truncated(readings: DataFrame, flags: DataFrame, reading: str) -> DataFrame:
    """``reading, clipped, clip``: the flag whose beginning is nearest to a reading of three characters or more.

    At a distance of 1 at most and a lead of 0.5; confidence ``clip`` up to 0.7. Safe only
    where a label says that the reading is a flag.
    """
    seen = readings.select(reading).distinct().withColumn("_c", canon(F.col(reading))).where(F.length("_c") >= 3)
    words = flags.select("value", canon(F.col("value")).alias("_w"))
    pairs = seen.crossJoin(F.broadcast(words)).where(F.length("_c") <= F.length("_w"))
    scored = pairs.withColumn("d", distance(F.col("_c"), F.substring(F.col("_w"), F.lit(1), F.length("_c")), SCAN)).where("d <= 1.0")
    best = scored.groupBy(reading).agg(F.array_sort(F.collect_list(F.struct("d", "value", (F.length("_c") / F.length("_w")).alias("share")))).alias("_r"))
    a, b = F.get("_r", F.lit(0)), F.get("_r", F.lit(1))
    sure = best.where(b.isNull() | (b["d"] - a["d"] >= 0.5))
    return sure.select(reading, a["value"].alias("clipped"), F.least(F.lit(0.7), a["share"] * (1.0 - a["d"]) + 0.25).alias("clip"))


def snap_flags(readings: DataFrame, flags: DataFrame, reading: str, ratio: float = 0.30, clipped: bool = False) -> DataFrame:
    """Flags by distance, else by a unique beginning of six characters (confidence up to 0.75),
    else, with ``clipped``, by ``truncated``."""
    near = snap(readings, flags, reading, ratio=ratio)
    start = _begins(readings, flags, reading).withColumnRenamed("value", "by_start")
    share = F.least(F.lit(0.75), F.length(canon(F.col(reading))) / F.length(canon(F.col("by_start"))))
    out = near.join(start, reading, "left")
    out = out.select(reading, F.coalesce("snapped", "by_start").alias("snapped"), F.when(F.col("snapped").isNotNull(), F.col("confidence")).when(F.col("by_start").isNotNull(), share).otherwise(F.lit(0.0)).alias("confidence"))
    if not clipped:
        return out
    out = out.join(truncated(readings, flags, reading), reading, "left")
    return out.select(reading, F.coalesce("snapped", "clipped").alias("snapped"), F.when(F.col("snapped").isNotNull(), F.col("confidence")).otherwise(F.coalesce("clip", F.lit(0.0))).alias("confidence"))


def mismatches(a: Column, b: Column) -> Column:
    """Places in which two texts differ, over the length of the shorter one."""
    n = F.least(F.length(a), F.length(b))
    return F.aggregate(F.zip_with(F.split(F.substring(a, F.lit(1), n), ""), F.split(F.substring(b, F.lit(1), n), ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))


def match_labels(readings: DataFrame, labels: DataFrame, reading: str) -> DataFrame:
    """``reading, label, mismatches``: the label that ends a reading, or looks most like its end.

    ``labels`` has ``idx, label``. Only letters count. The last three, two or one words are a
    label exactly, the longest group first (0 mismatches); else the last two words, or the
    only one, are compared place by place: differing places and the difference in length,
    of four at most, count, up to two or a quarter of the words' length. Ties go to the first label.
    """
    letters = F.split(F.trim(F.lower(F.regexp_replace(F.col(reading), "[^A-Za-z ]+", " "))), " +")
    seen = readings.select(reading).distinct().withColumn("_w", F.filter(letters, lambda x: x != "")).where(F.size("_w") > 0)
    last = lambda n: F.when(F.size("_w") >= n, F.array_join(F.slice("_w", -n, n), " "))
    known = labels.select("idx", "label", F.lower("label").alias("_l"))
    ends = seen.select(reading, F.posexplode(F.array(last(3), last(2), last(1))).alias("_k", "_l"))
    exact = ends.join(known, "_l").groupBy(reading).agg(F.min(F.struct("_k", "idx", "label"))["label"].alias("label")).select(reading, "label", F.lit(0).alias("mismatches"))
    rest = seen.join(exact.select(reading), reading, "left_anti").select(reading, F.coalesce(last(2), last(1)).alias("_t"))
    gap = F.abs(F.length("_t") - F.length("_l"))
    pairs = rest.withColumn("_n", F.explode(F.sequence(F.greatest(F.length("_t") - 4, F.lit(1)), F.length("_t") + 4))).join(known.withColumn("_n", F.length("_l")), "_n")
    scored = pairs.withColumn("_d", mismatches(F.col("_t"), F.col("_l")) + gap)
    best = scored.groupBy(reading, "_t").agg(F.min(F.struct(F.col("_d").alias("d"), "idx", "label")).alias("m"))
    near = best.where(F.col("m.d") <= F.greatest(F.lit(2), F.floor(F.length("_t") / 4))).select(reading, F.col("m.label").alias("label"), F.col("m.d").cast("int").alias("mismatches"))
    return exact.unionByName(near)


def snap_findings(readings: DataFrame, reading: str) -> DataFrame:
    """Outcomes from garbled words: a unique beginning, else the nearest with a lead of 1.

    Words that only resemble outcomes are never taken.
    """
    spark = readings.sparkSession
    names = spark.range(3).select(F.col("id").alias("idx"), F.element_at(F.array(*map(F.lit, ("APPROVED", "DENIED", "NEEDS_REVIEW"))), (F.col("id") + 1).cast("int")).alias("value"))
    blocked = ("approval", "approvals", "denial", "denials", "review", "reviewed", "reviewer")
    seen = readings.select(reading).distinct().withColumn("_c", canon(F.col(reading))).where(~F.col("_c").isin("", *blocked))
    start = _begins(seen, names, reading, 3).withColumnRenamed("value", "by_start")
    pairs = seen.crossJoin(F.broadcast(names)).withColumn("_d", distance(F.col("_c"), canon(F.col("value")), SCAN))
    best = pairs.groupBy(reading).agg(F.array_sort(F.collect_list(F.struct(F.col("_d").alias("d"), "value"))).alias("_r"))
    a, b = F.get("_r", F.lit(0)), F.get("_r", F.lit(1))
    ok = (a["d"] < F.greatest(F.lit(1.0), F.length(canon(a["value"])) * 0.35)) & (b["d"] - a["d"] >= 1.0)
    near = best.select(reading, F.when(ok, a["value"]).alias("near"))
    return near.join(start, reading, "left").select(reading, F.coalesce("by_start", "near").alias("finding")).where("finding is not null")
