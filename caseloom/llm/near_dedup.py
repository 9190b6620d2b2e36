"""Near-duplicate groups by HyperMinHash, banding and verification on full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm import shingles as S
from caseloom.llm.common import join_groups, materialize, slices, trim
from caseloom.llm.components import connected_components

#: A pair goes to verification unless its corrected estimate is this far below the
#: threshold: six standard deviations of 128 registers at a similarity of 0.75.
SLACK = 0.23
#: Registers of the finer sketches of the last step; classes in a block there, and pairs of one
#: leader that are verified together.
FINE = 512
BLOCK = 256


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = S.WordHashes()
    for batch in slices(batches, "text"):
        n, digests, sketch = [], [], []
        for text in batch.column("text").to_pylist():
            s = S.shingle_set(text, hashes)
            n.append(len(s))
            digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            sketch.append(S.bands(S.registers(s)) if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("doc_id"), batch.column("t"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketch, pa.list_(pa.int64()))],
            ["row", "doc_id", "t", "n_shingles", "cls", "sketch"],
        )
    hashes.clear()
    trim()


def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs whose full shingle sets are similar enough."""
    hashes = S.WordHashes()
    last, last_set = None, None
    for batch in slices(batches, "text_b"):
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        keep = np.zeros(len(a), bool)
        for i, (x, text_a, text_b) in enumerate(zip(a, batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True)):
            if x != last:
                last, last_set = x, S.shingle_set(text_a, hashes)
            other = S.shingle_set(text_b, hashes)
            both = len(np.intersect1d(last_set, other, assume_unique=True))
            keep[i] = 100 * both >= percent * (len(last_set) + len(other) - both)
        mask = pa.array(keep)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()).filter(mask), pa.array(b, pa.binary()).filter(mask)], ["a", "b"])


def _agreeing(x: Column, y: Column) -> Column:
    """Number of equal registers in two sketches."""
    lanes = [0xFFFF, 0xFFFF0000, 0xFFFF00000000, -0x1000000000000]

    def count(acc: Column, v: Column) -> Column:
        for m in lanes:
            acc = acc + (v.bitwiseAND(F.lit(m).cast("long")) == 0).cast("int")
        return acc

    return F.aggregate(F.zip_with(x, y, lambda p, q: p.bitwiseXOR(q)), F.lit(0), count)


def _similar(x: Column, y: Column, n_x: Column, n_y: Column, percent: int) -> Column:
    """Whether the collision-corrected estimate leaves the pair a chance.

    The chance rate of a register is at most that of two sets of the same size,
    for which ``collision_rate`` gives about 2^-12; one bound serves all pairs, and
    sets whose sizes alone rule the similarity out never pass.
    """
    p = S.collision_rate(1 << 20, 1 << 20)
    corrected = (_agreeing(x, y) / F.lit(float(S.BUCKETS)) - F.lit(p)) / F.lit(1.0 - p)
    return (F.least(n_x, n_y) * 100 >= F.greatest(n_x, n_y) * percent) & (corrected >= percent / 100 - SLACK)


def _key(doc_id: Column, t: Column) -> Column:
    """Doc_id and the hash of the text, as one key that is never null."""
    return F.concat_ws("/", F.coalesce(doc_id.cast("string"), F.lit("null")), t.cast("string"))


def _texts(classes: DataFrame, reps: DataFrame, docs: DataFrame, total: int) -> DataFrame:
    """``cls, text``, one row for each of ``classes (cls)``: the text of its first document.

    Rows that repeat this document all meet it, and are united before anything else does.
    """
    found = reps.join(classes, "cls", "left_semi").select(_key(F.col("rep_id"), F.col("rep_t")).alias("key"), "cls", F.col("rep_rows").alias("n"))
    d = docs.select(_key(F.col("doc_id"), F.col("t")).alias("key"), "text")
    return join_groups(d, materialize(found, "near-wanted"), ["key"], "n", total, alike=True).groupBy("cls").agg(F.first("text").alias("text"))


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs (a, b)`` that hold on full sets.

    The pairs of one ``a`` are dealt to blocks, each of which gets its text, so that a
    leader of many classes does not gather them in one task.
    """
    n = materialize(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "near-asked")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = join_groups(pairs, n, ["a"], "n", pairs.count()).select("a", "b", F.pmod(F.xxhash64("b"), blocks).cast("int").alias("block"))
    text_a = n.join(texts, n.a == texts.cls).select("a", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.col("text").alias("text_a"))
    full = dealt.join(texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b")), "b").join(text_a, ["a", "block"])
    return full.select("a", "b", "text_a", "text_b").mapInArrow(lambda it: _linked(it, percent), "a binary, b binary").distinct()


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = S.WordHashes()
    for batch in slices(batches, "text"):
        sets = [S.shingle_set(t, hashes) for t in batch.column("text").to_pylist()]
        fine = [S.registers(s, FINE).astype(np.uint16).tobytes() for s in sets]
        bands = [S.bands(S.registers(s)).tobytes() for s in sets]
        yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array([len(s) for s in sets], pa.int64()), pa.array(fine, pa.binary()), pa.array(bands, pa.binary())], ["cls", "n", "fine", "bands"])


def _block_pairs(block: pa.Table, percent: int) -> pa.Table:
    """Pairs of a block, one of them asking, of different components and likely similar.

    A pair comes up in each band that it shares; only the first of them gives it. There
    it is in one bucket too, and was either paired with the leader or comes up here.
    """
    comp = np.unique(np.array(block.column("comp").to_pylist(), object), return_inverse=True)[1]
    n = block.column("n").to_numpy().astype(float)
    asks = np.array(block.column("asks").to_pylist(), bool)
    cls = block.column("cls").to_pylist()
    fine = np.frombuffer(b"".join(block.column("fine").to_pylist()), np.uint16).reshape(len(cls), FINE)
    bands = np.frombuffer(b"".join(block.column("bands").to_pylist()), np.int64).reshape(len(cls), S.BANDS)
    band = block.column("band")[0].as_py()
    stay = np.nonzero(~asks)[0]
    p = S.collision_rate(1 << 20, 1 << 20)
    least = percent / 100 - 4.5 * np.sqrt(percent / 100 * (1 - percent / 100) / FINE)
    out = set()
    for i in np.nonzero(asks)[0]:
        size = (100 * np.minimum(n[stay], n[i]) >= percent * np.maximum(n[stay], n[i])) & (comp[stay] != comp[i])
        js = stay[size]
        js = js[(bands[js] == bands[i]).argmax(axis=1) == band]
        agree = (fine[js] == fine[i]).mean(axis=1)
        out.update((min(cls[i], cls[j]), max(cls[i], cls[j])) for j in js[(agree - p) / (1 - p) >= least])
    a, b = zip(*out, strict=True) if out else ((), ())
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def _across(rest: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Likely pairs across components within the buckets of ``rest (bucket, band, cls, comp, major, blocks, askers)``.

    In each bucket the classes outside its largest component ask all its classes. Askers
    and asked are cut into blocks of about ``BLOCK``, and every two blocks meet in a group
    of their own. Finer sketches, of 512 registers, let pass what is no more than 4.5
    standard deviations below the threshold.
    """
    wanted = texts.join(rest.select("cls").distinct(), "cls", "left_semi")
    fine = materialize(wanted.mapInArrow(_fine, "cls binary, n long, fine binary, bands binary"), "near-fine")
    rows = rest.join(fine, "cls")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = lambda c: F.pmod(F.xxhash64("cls"), F.col(c)).cast("int")
    kept = ("band", "cls", "comp", "n", "fine", "bands")
    stay = rows.select("bucket", own("blocks").alias("block"), every("askers").alias("asker"), F.lit(False).alias("asks"), *kept)
    asks = rows.where("comp <> major").select("bucket", every("blocks").alias("block"), own("askers").alias("asker"), F.lit(True).alias("asks"), *kept)
    pairs = stay.unionByName(asks).groupBy("bucket", "block", "asker").applyInArrow(lambda t: _block_pairs(t, percent), "a binary, b binary")
    return materialize(pairs.distinct(), "near-pairs")


def near_groups(docs: DataFrame, percent: int = 75, row: str | None = None) -> DataFrame:
    """``row, doc_id, n_shingles, comp`` for every row of ``docs``: the group of each, null without words."""
    docs = docs.select((F.col(row).cast("long") if row else F.lit(None).cast("long")).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    docs = docs.withColumn("t", F.xxhash64("text"))
    base = materialize(docs.mapInArrow(_sketches, "row long, doc_id long, t long, n_shingles long, cls binary, sketch array<long>"), "near-sketches")
    total = base.count()
    per = base.where("cls is not null").groupBy("cls", "doc_id", "t").agg(F.count(F.lit(1)).alias("c"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    reps = per.groupBy("cls").agg(F.min(F.struct("doc_id", "t", "c")).alias("r"), F.sum("c").alias("rows"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    reps = materialize(reps.select("cls", F.col("r.doc_id").alias("rep_id"), F.col("r.t").alias("rep_t"), F.col("r.c").alias("rep_rows"), "rows", "n", "sketch"), "near-classes")

    slots = reps.select("cls", F.posexplode("sketch").alias("band", "key")).select("cls", "band", F.xxhash64("band", "key").alias("bucket"))
    shared = materialize(slots.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "near-shared")
    members = materialize(join_groups(slots, shared, ["bucket"], "size", S.BANDS * reps.count()), "near-buckets")
    # a bucket's leader is its class with the most company in all buckets: the likely original
    company = members.groupBy("cls").agg(F.struct(F.sum("size").alias("n"), "cls").alias("rank"))
    ranked = materialize(members.join(company, "cls"), "near-ranked")
    leaders = materialize(ranked.groupBy("bucket").agg(F.max("rank").alias("leader"), F.count(F.lit(1)).alias("led")), "near-leaders")
    held = ranked.count()
    members = join_groups(ranked.drop("rank"), leaders, ["bucket"], "led", held)
    members = materialize(members.select("bucket", "band", "cls", "size", "leader", F.col("leader.cls").alias("lead")), "near-buckets")
    led = materialize(members.groupBy("lead").agg(F.count(F.lit(1)).alias("led")), "near-led")
    texts = materialize(_texts(members.select("cls").distinct(), reps, docs, total), "near-texts")

    side = lambda c: reps.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))

    def verified(pairs: DataFrame) -> DataFrame:
        asked = materialize(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("asked")).join(side("a"), "a"), "near-asked")
        known = join_groups(pairs.join(side("b"), "b"), asked, ["a"], "asked", held)
        likely = known.where(_similar(F.col("s_a"), F.col("s_b"), F.col("n_a"), F.col("n_b"), percent)).select("a", "b")
        return materialize(_verified(materialize(likely, "near-pairs"), texts, percent), "near-links")

    def labelled(comp: DataFrame) -> DataFrame:
        named = comp.withColumnRenamed("node", "cls")
        of_lead = materialize(led.join(comp.select(F.col("node").alias("lead"), F.col("component").alias("lead_comp")), "lead", "left"), "near-lead")
        rows = join_groups(members.drop("leader").join(named, "cls", "left"), of_lead, ["lead"], "led", held)
        return rows.select("bucket", "band", "cls", "size", "lead", F.coalesce("component", "cls").alias("comp"), F.coalesce("lead_comp", "lead").alias("lead_comp"))

    # first each class with its best leader, then with the leaders that are in another component
    first = members.groupBy("cls").agg(F.max("leader").alias("l")).select(F.col("l.cls").alias("a"), F.col("cls").alias("b")).where("a <> b")
    first = materialize(first, "near-pairs")
    links = verified(first)
    comp = connected_components(links)
    second = labelled(comp).where("comp <> lead_comp").select(F.col("lead").alias("a"), F.col("cls").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    links = materialize(links.unionByName(verified(materialize(second, "near-pairs"))), "near-links")
    comp = connected_components(links)

    # what the leaders left: buckets whose other classes are in several components
    left = materialize(labelled(comp).where("size > 2 and cls <> lead").select("bucket", "band", "cls", "comp"), "near-left")
    by_comp = left.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"))
    mixed = by_comp.groupBy("bucket").agg(F.max(F.struct("n", "comp")).alias("major"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    cut = lambda c: F.ceil(c / BLOCK).cast("int")
    mixed = materialize(mixed.select("bucket", F.col("major.comp").alias("major"), cut(F.col("n")).alias("blocks"), cut(F.col("n") - F.col("major.n")).alias("askers"), "n"), "near-mixed")
    rest = materialize(join_groups(left, mixed, ["bucket"], "n", held).drop("n"), "near-rest")
    more = materialize(_verified(_across(rest, texts, percent), texts, percent), "near-links")
    if more.limit(1).count():
        comp = connected_components(links.unionByName(more))

    named = materialize(reps.select("cls", "rows").join(comp.withColumnRenamed("node", "cls"), "cls", "left").select("cls", F.coalesce("component", "cls").alias("comp"), "rows"), "near-named")
    with_words = join_groups(base.where("cls is not null").select("row", "doc_id", "n_shingles", "cls"), named, ["cls"], "rows", total)
    without = base.where("cls is null").select("row", "doc_id", "n_shingles", F.lit(None).cast("binary").alias("comp"))
    return materialize(with_words.select("row", "doc_id", "n_shingles", "comp").unionByName(without), "near-groups")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs (doc_id, text)``.

    1. Every text becomes its set of 5-word shingles (64-bit hashes), a 128-bit
       digest of the set and a HyperMinHash sketch. Equal sets are one class.
    2. Bands of four compressed registers put classes into buckets. A bucket's leader
       is its class with the most company. Each class is paired with the best of its
       leaders, then with those leaders that are still in another component; pairs
       whose collision-corrected estimate is hopeless go, the rest is verified on
       full sets, of one text a class.
    3. In buckets that still hold several components, classes outside the largest one
       ask all others, in blocks, by finer sketches; what these let pass is verified
       as well. So no link that banding can find is lost, while a group of copies
       costs pairs in proportion to its size.

    A pair at a similarity of exactly 0.75 escapes all 32 bands with probability
    5e-6, and less above. Hot buckets, leaders, classes and hubs are spread over all
    tasks. Null, empty and blank texts have no shingles and link with nothing; texts of
    any length are taken whole. Rows that share doc_id stay separate rows, repeated rows
    count as one text; null doc_id is passed through, and a group with null ids only has a
    null component_id (kept: true). Other columns of ``docs`` are ignored.
    """
    rows = near_groups(docs, percent)
    least = materialize(rows.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "near-least")
    out = join_groups(rows.where("comp is not null"), least, ["comp"], "n", rows.count()).select("doc_id", "n_shingles", "component_id")
    out = out.unionByName(rows.where("comp is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def kept_rows(docs: DataFrame, row: str, percent: int = 75) -> DataFrame:
    """``row`` of one document of each group, that with the least doc_id (null last) and then the
    least ``row``, a number of the rows of ``docs``; texts without words all stay."""
    rows = near_groups(docs, percent, row)
    first = rows.where("comp is not null").groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("m")).select(F.col("m.row").alias(row))
    return first.unionByName(rows.where("comp is null").select(F.col("row").alias(row)))
