"""How far the sources of a language are apart: exact divergences of their smoothed term shares."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseloom.llm.common import materialize, slices

#: Documents of its language that a term needs.
LEAST_DOCUMENTS = 30
#: Shares are whole numbers: 1 + floor(SCALE * (count + SMOOTH) / (all + SMOOTH * terms)).
SCALE, SMOOTH = 1_000_000_000, 5
#: Ranks of the terms that set a source apart.
TOP_TERMS = 50
#: (language, source, term) entries that a worker holds before it passes them on.
ENTRIES = 400_000

#: Bytes as terms see them: ASCII letters in lower case, all bytes of other characters, and blanks for the rest.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of a task: a row each language, source and term, and one without a term each group."""

    def rows(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in held.items():
            size = len(terms)
            words, n, docs = [None, *terms], [0, *[v >> 32 for v in terms.values()]], [0, *[v & 0xFFFFFFFF for v in terms.values()]]
            same = lambda v: pa.array([v], pa.string()).take(pa.array([0] * (size + 1), pa.int32()))
            yield pa.RecordBatch.from_arrays([same(lang), same(source), pa.array(words, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], ["lang", "source", "term", "n", "docs"])

    held: dict[tuple[str, str], dict[bytes, int]] = {}
    entries = 0
    for batch in slices(batches, "text"):
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            group = held.setdefault((lang, source), {})
            before = len(group)
            for term, n in Counter(text.encode().translate(LETTERS).split()).items():
                group[term] = group.get(term, 0) + (n << 32 | 1)
            entries += len(group) - before
            if entries > ENTRIES:
                yield from rows(held)
                held, entries = {}, 0
    yield from rows(held)


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs`` of ``docs (lang, source, text)``; a null term for each group that occurs.

    Terms are maximal runs of ASCII letters and characters beyond ASCII; only A-Z are
    lower-cased. ``n`` counts occurrences, ``docs`` the documents with the term. Nulls
    count as empty. Tasks count before anything is shuffled, in bounded memory.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    part = docs.select(text("lang"), text("source"), text("text")).mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return part.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: Column, whole: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (whole + SMOOTH * terms)) without rounding."""
    big = lambda c: c.cast("decimal(18,0)")
    over = F.lit(SCALE).cast("decimal(10,0)") * big(count + SMOOTH)
    return F.lit(1).cast("long") + F.call_function("div", over, big(whole + terms * SMOOTH))


def audit_sources(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every (lang, source) group of ``docs (lang, source, text)``.

    A language keeps the terms of at least ``least`` of its documents. Part ``pair``
    ranks all other sources of the language by the sum of the differences of their
    shares over all kept terms (0 if none is kept); part ``term`` ranks the terms whose
    share is above that of the whole language, down to ``top``. Larger values come
    first, then the lesser item in UTF-8. All arithmetic is in whole numbers.

    The sum over a pair of sources is never taken term by term. Inclusion and exclusion
    over their supports: the terms of one side are priced from its histogram of counts,
    against the other's share of a missing term; a join of postings, which only meets terms
    that both have, corrects the overlap; terms that neither has cost a constant each.

    Null texts, languages and sources count as empty. Rows that repeat count as documents
    of their own. Texts are read whole, however long. An empty table gives an empty result;
    other columns are ignored, whatever their names.
    """
    counts = materialize(term_counts(docs), "audit-counts")
    groups = counts.where("term is null").select("lang", "source")
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least)
    kept = materialize(kept.select("lang", "term", "lang_n"), "audit-kept")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_all"))
    found = materialize(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "audit-found")
    sums = found.groupBy("lang", "source").agg(F.sum("n").alias("whole"), F.count(F.lit(1)).alias("has"))
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    groups = groups.join(langs, "lang", "left").join(sums, ["lang", "source"], "left").select("lang", "source", none("terms"), none("lang_all"), none("whole"), none("has"))
    # the share of a term that a group lacks; a language that keeps no term has none
    groups = materialize(groups.withColumn("zero", F.when(F.col("terms") > 0, _share(F.lit(0).cast("long"), F.col("whole"), F.col("terms"))).otherwise(0)), "audit-groups")
    postings = found.join(groups, ["lang", "source"])
    postings = postings.select("lang", "source", "term", "n", "zero", _share(F.col("n"), F.col("whole"), F.col("terms")).alias("p"), _share(F.col("lang_n"), F.col("lang_all"), F.col("terms")).alias("q"))
    postings = materialize(postings, "audit-postings")
    return _pairs(groups, postings).unionByName(_terms(postings, top))


def _pairs(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """All other sources of each group, ranked."""
    side = lambda s: groups.select("lang", *[F.col(c).alias(f"{c}_{s}") for c in ("source", "zero", "has")], *([F.col("terms")] if s == "a" else []))
    pairs = side("a").join(side("b"), "lang").where("source_a <> source_b")  # as many rows as the result has
    # one-sided terms, as if the other had none of them
    prices = postings.groupBy("lang", F.col("source").alias("source_a"), F.col("p").alias("p_a")).agg(F.count(F.lit(1)).alias("times"))
    priced = prices.join(groups.select("lang", F.col("source").alias("source_b"), "zero"), "lang").where("source_a <> source_b")
    priced = priced.groupBy("lang", "source_a", "source_b").agg(F.sum(F.col("times") * F.abs(F.col("p_a") - F.col("zero"))).alias("one"))
    both_ways = priced.select("lang", F.least("source_a", "source_b").alias("low"), F.greatest("source_a", "source_b").alias("high"), "one").groupBy("lang", "low", "high").agg(F.sum("one").alias("one"))
    # terms that both have
    post = lambda s: postings.select("lang", "term", *[F.col(c).alias(f"{c}_{s}") for c in ("source", "p", "zero")])
    met = post("a").join(post("b"), ["lang", "term"]).where("source_a < source_b")
    gap = lambda x, y: F.abs(F.col(x) - F.col(y))
    fix = gap("p_a", "p_b") - gap("p_a", "zero_b") - gap("zero_a", "p_b") + gap("zero_a", "zero_b")
    overlap = met.select("lang", F.col("source_a").alias("low"), F.col("source_b").alias("high"), fix.alias("fix")).groupBy("lang", "low", "high").agg(F.sum("fix").alias("fix"))
    pairs = pairs.withColumn("low", F.least("source_a", "source_b")).withColumn("high", F.greatest("source_a", "source_b"))
    pairs = pairs.join(both_ways, ["lang", "low", "high"], "left").join(overlap, ["lang", "low", "high"], "left")
    none = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    neither = (F.col("terms") - F.col("has_a") - F.col("has_b")) * gap("zero_a", "zero_b")
    out = pairs.select("lang", F.col("source_a").alias("source"), F.lit("pair").alias("part"), F.col("source_b").alias("item"), (none("one") + none("fix") + neither).cast("long").alias("value"))
    return out.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def _terms(postings: DataFrame, top: int) -> DataFrame:
    """The terms of each group that it has most above its language; ranks beyond ``top`` are cut
    before the shuffle too."""
    above = postings.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return above.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))).where(F.col("rank") <= top)
