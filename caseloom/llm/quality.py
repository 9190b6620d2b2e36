"""Quality rules: text statistics, and a log-likelihood ratio of hashed n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseloom.llm.common import SPACE, WORD, materialize

BUCKETS = 1 << 15
#: Pseudo-count of each bucket.
SMOOTHING = 0.5
#: A document is kept if its mean log ratio is not below this, where no labelled rows give a better one.
THRESHOLD = -0.25
WINDOW = 5


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")


def _pairs(x: Column, by: int, f) -> Column:
    """f of each element and the one ``by`` places on; null where there is none."""
    return F.zip_with(x, F.slice(x, by + 1, F.greatest(F.size(x), F.lit(1))), f)


def hashes_of(words: Column) -> Column:
    """A 64-bit hash of each word; all else is computed on these."""
    return F.transform(words, lambda w: F.xxhash64(w))


def pairs_of(hashes: Column) -> Column:
    """A hash of each word and the next one; one less than words."""
    return F.slice(_pairs(hashes, 1, lambda a, b: F.xxhash64(a, b)), 1, F.greatest(F.size(hashes) - 1, F.lit(0)))


def windows_of(hashes: Column, pairs: Column) -> Column:
    """Hashes of all windows of five words; empty if there are fewer words."""
    four = _pairs(pairs, 2, lambda a, b: F.xxhash64(a, b))
    five = F.zip_with(four, F.slice(hashes, WINDOW, F.greatest(F.size(hashes), F.lit(1))), lambda a, b: F.xxhash64(a, b))
    return F.slice(five, 1, F.greatest(F.size(hashes) - (WINDOW - 1), F.lit(0)))


def with_repeat_words(rows: DataFrame) -> DataFrame:
    """``n_repeat_words``: words in windows that the text holds twice or more.

    The windows of texts that repeat any are sorted with their places; equal
    neighbours are repeats, and the words they cover are counted once. Each step is
    a column of its own, so that none is computed twice.
    """
    w, keep = F.col("windows"), [c for c in rows.columns if c != "windows"]
    n = F.greatest(F.size("ordered"), F.lit(1))
    placed = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    out = rows.select(*keep, F.when(F.size(F.array_distinct(w)) < F.size(w), placed).alias("ordered"))
    same = F.zip_with("ordered", F.slice("ordered", 2, n), lambda a, b: F.struct(a["i"].alias("i"), F.coalesce(a["x"] == b["x"], F.lit(False)).alias("next")))
    out = out.select(*keep, same.alias("same"))
    before = F.concat(F.array(F.struct(F.lit(-1).alias("i"), F.lit(False).alias("next"))), "same")
    out = out.select(*keep, "same", before.alias("before"))
    marked = F.zip_with("same", F.slice("before", 1, F.greatest(F.size("same"), F.lit(1))), lambda a, b: F.when(a["next"] | b["next"], a["i"]))
    out = out.select(*keep, F.sort_array(F.filter(marked, lambda i: i.isNotNull())).alias("at"))
    gaps = F.zip_with("at", F.slice("at", 2, F.greatest(F.size("at"), F.lit(1))), lambda p, q: F.coalesce(F.least(q - p, F.lit(WINDOW)), F.lit(WINDOW)))
    total = F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x)
    return out.select(*keep, F.coalesce(total, F.lit(0).cast("long")).alias("n_repeat_words"))


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit(BUCKETS - 1).cast("long")).cast("int")


def _ids(rows: DataFrame) -> DataFrame:
    """``_id``: the distinct doc_ids of ``rows``."""
    return rows.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("_id")).distinct()


def ratio_weights(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """One row ``weights``: of each bucket log p(target) - log p(raw), by bucket number.

    The raw multinomial counts all of ``docs``; the target one all documents whose
    doc_id is in ``trusted (doc_id)``, joined in the same way at every size. Without trusted
    documents all weights are 0.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("_doc"), "text")
    named = rows.where("_doc is not null").join(_ids(trusted).hint("merge"), F.col("_doc") == F.col("_id"), "left").select(F.col("_id").isNotNull().cast("long").alias("t"), "text")
    flagged = named.unionByName(rows.where("_doc is null").select(F.lit(0).cast("long").alias("t"), "text"))
    hashed = flagged.select("t", hashes_of(words_of(F.col("text"))).alias("h"))
    grams = hashed.select("t", F.explode(F.concat("h", pairs_of(F.col("h")))).alias("h"))
    counts = grams.select("t", _bucket(F.col("h")).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("target"))
    counts = materialize(counts, "quality-counts")
    sums = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("all_raw"), F.coalesce(F.sum("target"), F.lit(0)).alias("all_target"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").crossJoin(F.broadcast(sums))
    p = lambda c: F.log((F.coalesce(c, F.lit(0)) + SMOOTHING) / (F.col(f"all_{c}") + SMOOTHING * BUCKETS))
    weight = F.when(F.col("all_target") > 0, p("target") - p("raw")).otherwise(F.lit(0.0)).cast("float")
    return every.select("bucket", weight.alias("weight")).agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "weight"))), lambda x: x["weight"]).alias("weights"))


def scored(docs: DataFrame, weights: DataFrame) -> DataFrame:
    """All columns of ``quality`` but ``kept``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    n = lambda p: F.regexp_count(text, F.lit(p)).cast("long")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        hashes_of(words_of(F.col("text"))).alias("h"),
        (F.length(text) - n(SPACE)).alias("word_chars"),
        n(r"[#*$%&|<>]").alias("n_symbols"),
        lines.alias("lines"),
    )
    rows = rows.select("doc_id", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "h", pairs_of(F.col("h")).alias("pairs"))
    rows = rows.select("doc_id", F.size("h").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", "h", "pairs", windows_of(F.col("h"), F.col("pairs")).alias("windows"))
    rows = rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.concat("h", "pairs").alias("grams"), "windows")
    rows = with_repeat_words(rows)
    rows = rows.crossJoin(F.broadcast(weights))
    total = F.aggregate("grams", F.lit(0.0), lambda s, h: s + F.get(F.col("weights"), _bucket(h)))
    score = F.when(F.size("grams") > 0, total / F.size("grams")).otherwise(F.lit(0.0))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), score.alias("score"))


def best_cut(labelled: DataFrame) -> DataFrame:
    """One row ``cut``: where scores part good from bad rows best; null where a side has no rows.

    ``labelled (score, g, b)``: how often a row counts as good and as bad. Of all cuts between
    neighbouring scores that one is taken for which the share of good rows below it and the
    share of bad rows not below it have the least sum, the lowest one of a tie; it lies
    halfway between the two scores. Scores are dealt into ranges: running counts are taken
    within each, upon the sums of the ranges before it.
    """
    at = labelled.groupBy("score").agg(F.sum("g").alias("g"), F.sum("b").alias("b"))
    ranges = int(at.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = materialize(at.repartitionByRange(ranges, "score").withColumn("cell", F.spark_partition_id()), "quality-scores")
    sums = at.groupBy("cell").agg(F.sum("g").alias("g"), F.sum("b").alias("b"), F.max("score").alias("top"))
    every, past = W.partitionBy(), W.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    before = sums.select("cell", *[F.coalesce(F.sum(c).over(past), none).alias(f"past_{c}") for c in "gb"], F.max("top").over(past).alias("past_top"), *[F.sum(c).over(every).alias(f"all_{c}") for c in "gb"])
    w = W.partitionBy("cell").orderBy("score")
    below = lambda c: F.col(f"past_{c}") + F.sum(c).over(w) - F.col(c)
    last = F.coalesce(F.lag("score").over(w), "past_top", "score")
    runs = at.join(F.broadcast(before), "cell").select("score", last.alias("last"), below("g").alias("lost"), below("b").alias("gone"), "all_g", "all_b")
    wrong = F.col("lost") * F.col("all_b") + (F.col("all_b") - F.col("gone")) * F.col("all_g")
    cut = (F.col("score") + F.col("last")) / 2
    return runs.where("all_g > 0 and all_b > 0").agg(F.min(F.struct(wrong.alias("wrong"), cut.alias("cut")))["cut"].alias("cut"))


def labelled_threshold(rows: DataFrame, trusted: DataFrame, low: DataFrame, otherwise: float = THRESHOLD) -> DataFrame:
    """One row ``threshold``: the ``best_cut`` of the scores of all rows that ``trusted`` and ``low
    (doc_id)`` name, less those that fail the base rules anyway; ``otherwise`` where a side has no rows.

    ``rows`` are scored documents, see ``scored``.
    """
    sides = _ids(trusted).withColumn("good", F.lit(1)).unionByName(_ids(low).withColumn("good", F.lit(0)))
    ids = sides.groupBy("_id").agg(F.sum("good").alias("g"), F.sum(1 - F.col("good")).alias("b"))
    labelled = rows.where("not base_failed and doc_id is not null").select("doc_id", "score").join(ids, F.col("doc_id") == F.col("_id"))
    return best_cut(labelled).select(F.coalesce("cut", F.lit(otherwise)).alias("threshold"))


def quality(docs: DataFrame, trusted: DataFrame, low: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept``.

    One row for every row of ``docs (doc_id, text)``. ``score`` is the sum of the
    weights of all words and pairs of the whole text over their number; 0 without
    words. ``base_failed`` holds with fewer than 10 words, or with more than a fifth
    of the words in repeated windows. ``kept``: not failed, and score not below the cut
    that parts labelled rows of ``trusted`` and ``low (doc_id)`` best; without ``low``,
    or where a side has no rows, not below ``threshold``. Null texts count as empty;
    repeated rows and null doc_ids are scored like any other; other columns are ignored.
    """
    weights = materialize(ratio_weights(docs, trusted), "quality-weights")
    if low is None:
        return scored(docs, weights).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
    rows = materialize(scored(docs, weights), "quality-scored")
    cut = materialize(labelled_threshold(rows, trusted, low, threshold), "quality-threshold")
    rows = rows.crossJoin(F.broadcast(cut))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.col("threshold"))).drop("threshold")
