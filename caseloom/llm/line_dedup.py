"""Repeated runs of lines, found by prefix doubling, and their later copies deleted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseloom.llm.common import WORD, join_groups, materialize

#: A run of lines counts when it has so many words. Lines hold a word at least, so the
#: shortest run that counts has no more lines than this.
LEAST_WORDS = 50


def _name(*parts):
    """Two 64-bit hashes that stand for a sequence."""
    return F.struct(F.xxhash64(F.lit(1), *parts).alias("a"), F.xxhash64(F.lit(2), *parts).alias("b"))


def _power(k):
    return F.pow(F.lit(2.0), k).cast("long")


def _place() -> list:
    """Order of documents: by doc_id, null last."""
    return [F.col("doc_id").isNull().alias("o"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("d")]


def deleted_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``o, d, th, gone`` of documents that lose lines, ``o, d`` from ``_place``; ``gone`` are line numbers from 0.

    The sequences are the lines that hold a word, named by 128-bit hashes. A line that
    the corpus holds once ends every repeated run, so only lines found twice or more
    go on, as islands of neighbours. Prefix doubling names the 1, 2, 4, ... lines from
    each position on; two such names overlap to name any length, as in a suffix array
    with its longest common prefixes: positions with the same name at length L are an
    interval of suffixes that share L lines.

    For each position the lengths that matter are the shortest with ``least_words``
    words and longer ones whose rest, without the first line, has fewer; every
    longer repeated run is the union of such ones. Of each interval the first copy, by doc_id, a hash of
    the text, and line, stays; the others go unless they overlap the first.
    """
    text = F.col("text")
    each = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("at"), x.alias("line")))
    worded = F.filter(each, lambda x: x["line"].rlike(WORD))
    lines = docs.where(text.isNotNull()).select(*_place(), F.xxhash64(text).alias("th"), F.posexplode(worded).alias("q", "x"))
    line = F.col("x.line")
    lines = lines.select("o", "d", "th", "q", "x.at", F.regexp_count(line, F.lit(WORD)).alias("n"), F.xxhash64(line).alias("a"), F.xxhash64(F.lit(3), line).alias("b"))
    lines = materialize(lines, "line-names")
    again = materialize(lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "line-again")
    text_order = W.partitionBy("o", "d", "th").orderBy("q")
    counted = join_groups(lines, again, ["a", "b"], "c", lines.count()).drop("c")
    # rows that repeat doc_id and text are one sequence
    counted = counted.dropDuplicates(["o", "d", "th", "q"])
    island = counted.withColumn("island", F.col("q") - F.row_number().over(text_order))
    run = W.partitionBy("o", "d", "th", "island").orderBy("q")
    island = island.withColumn("upto", F.sum("n").over(run)).withColumn("start", F.col("upto") - F.col("n"))
    # how many lines begin within the words of the shortest run that counts
    near = W.partitionBy("o", "d", "th", "island").orderBy("start").rangeBetween(0, least_words - 1)
    island = island.withColumn("least", F.count(F.lit(1)).over(near)).withColumn("end", F.max("upto").over(W.partitionBy("o", "d", "th", "island")))
    island = island.withColumn("last", F.count(F.lit(1)).over(W.partitionBy("o", "d", "th", "island")) + F.min("q").over(W.partitionBy("o", "d", "th", "island")) - 1)
    nxt = F.lead("least").over(run)
    rest_ok = F.col("end") - F.col("upto") >= least_words
    most = F.when(nxt.isNull(), F.lit(1)).when(rest_ok, nxt).otherwise(F.col("last") - F.col("q") + 1)
    names, levels = [_name("a", "b").alias("n0")], 1
    while (1 << levels) <= least_words:
        levels += 1
    island = island.select("o", "d", "th", "island", "at", "q", "n", "least", most.cast("long").alias("most"), (F.col("end") - F.col("start") >= least_words).alias("enough"), *names)
    for k in range(1, levels):
        further = F.lead(f"n{k - 1}", 1 << (k - 1)).over(run)
        island = island.withColumn(f"n{k}", F.when(further.isNotNull(), _name(f"n{k - 1}", further)))
    island = materialize(island.withColumn("names", F.array(*[f"n{k}" for k in range(levels)])).drop(*[f"n{k}" for k in range(levels)]), "line-islands")
    asked = island.where("enough").select("o", "d", "th", "q", "names", F.explode(F.sequence(F.col("least"), F.greatest("least", "most"))).alias("len"))
    level = F.floor(F.log2(F.col("len"))).cast("int")
    asked = asked.withColumn("k", F.when(_power(level + 1) <= F.col("len"), level + 1).otherwise(level)).withColumn("q2", F.col("q") + F.col("len") - _power(F.col("k")))
    asked = asked.select("o", "d", "th", "q", "len", "k", "q2", F.element_at("names", F.col("k") + 1).alias("head"))
    other = island.select("o", "d", "th", F.col("q").cast("long").alias("q2"), F.col("names").alias("tails"))
    named = asked.join(other, ["o", "d", "th", "q2"])
    named = named.select("o", "d", "th", "q", "len", _name("head", F.element_at("tails", F.col("k") + 1), "len").alias("name"))
    named = materialize(named.select("o", "d", "th", "q", "len", F.col("name.a").alias("a"), F.col("name.b").alias("b")), "line-runs")
    first = named.groupBy("a", "b").agg(F.min(F.struct("o", "d", "th", "q")).alias("f"), F.count(F.lit(1)).alias("c")).where("c > 1")
    copies = join_groups(named, materialize(first, "line-first"), ["a", "b"], "c", named.count())
    same_doc = (F.col("o") == F.col("f.o")) & (F.col("d") == F.col("f.d")) & (F.col("th") == F.col("f.th"))
    later = copies.where(~same_doc | (F.col("q") >= F.col("f.q") + F.col("len")))
    spans = later.groupBy("o", "d", "th", "q").agg(F.max("len").alias("len"))
    qs = spans.select("o", "d", "th", F.explode(F.sequence(F.col("q").cast("long"), F.col("q") + F.col("len") - 1)).alias("q")).distinct()
    gone = qs.join(island.select("o", "d", "th", F.col("q").cast("long").alias("q"), "at"), ["o", "d", "th", "q"])
    return gone.groupBy("o", "d", "th").agg(F.array_sort(F.collect_list("at")).alias("gone"))


def deduplicate_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``doc_id, n_lines, n_deleted, text`` for every row of ``docs (doc_id, text)``.

    ``text`` is the text without the lines that ``deleted_lines`` names, the others
    joined by line feeds as before. Lines without a word are never deleted and do not
    part a run. Null texts stay null with 0 lines; the empty text has one line. Rows
    that repeat doc_id and text are one document and get the same result; rows that
    share doc_id only are told apart by their texts, a null doc_id is the last.
    Other columns are ignored.
    """
    gone = deleted_lines(docs, least_words)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", "text", *_place(), F.xxhash64("text").alias("th"))
    rows = rows.join(gone, ["o", "d", "th"], "left")
    lines, at = F.split("text", "\n"), F.col("gone").cast("array<int>")
    # what lies between one deleted line and the next stays
    ends = F.zip_with(F.concat(F.array(F.lit(-1)), at), F.concat(at, F.array(F.size(lines))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    kept = F.array_join(F.flatten(F.transform(ends, lambda x: F.slice(lines, x["a"] + 2, x["b"] - x["a"] - 1))), "\n")
    return rows.select(
        "doc_id",
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long").alias("n_deleted"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"),
    )
