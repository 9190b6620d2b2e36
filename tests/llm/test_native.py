import collections
import hashlib
import math
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from caseloom.llm import line_dedup, mixing, quality, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_mixing_targets(spark):
    sizes = {"a": 100, "b": 10, "c": 0, None: 50, "é": 40}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_rates(df).collect()}
    order = ["a", "b", "c", "é", None]
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    target, full = dict.fromkeys(order, 0.0), set()
    left = float(sum(sizes.values()))
    while True:  # reshare the excess until none is above
        free = [s for s in order if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            full.add(s)
        left = sum(sizes.values()) - sum(target[s] for s in full)
    assert got == pytest.approx(target)
    assert mixing.source_rates(df.limit(0)).collect() == []
    assert [r["target"] for r in mixing.source_rates(df.where("size = 0")).collect()] == [0.0]


def test_mix_repeats_whole_documents(spark):
    rows = [(k, "w " * (k % 30 + 1), "hot" if k % 3 else f"s{k % 7}", "x") for k in range(3000)] + [(9999, None, None, "x"), (None, "a b", "hot", "x"), (5, "dup", "hot", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, rate string")
    plan = mixing.mix_sizes(mixing.with_sizes(df)).collect()
    assert len(plan) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0) for r in plan)
    again = mixing.mix_sizes(mixing.with_sizes(df.repartition(5))).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, plan)) == sorted(map(key, again))
    by = collections.defaultdict(lambda: [0, 0.0])
    src = {r[0]: r[2] for r in rows}
    for r in plan:
        if r["doc_id"] not in (5, None):
            by[src[r["doc_id"]]][0] += r["taken"]
            by[src[r["doc_id"]]][1] = r["target"]
    assert all(abs(t - want) <= 0.2 * want + 60 for t, want in by.values())
    out = mixing.mix(df)
    assert out.columns == df.columns
    taken = collections.Counter(r["doc_id"] for r in out.collect())
    assert all(taken[r["doc_id"]] * r["size"] == r["taken"] for r in plan if r["doc_id"] not in (5, None) and r["size"])
    assert mixing.mix(df.limit(0)).collect() == []


def test_shards(spark):
    rows = [(k, "x" * (k * 37 % 400), 1) for k in range(1500)] + [(5000 + k, "same text", 1) for k in range(1200)] + [(7000 + k, f"pair {k // 2} " * 3, 1) for k in range(200)] + [(None, None, 1), (None, None, 1), (3, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = sharding.shard_documents(df, 8).collect()
    assert len(got) == len(rows)
    load, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    mean = sum(load.values()) / 8
    assert set(load) == set(range(8)) and all(abs(v - mean) < 0.05 * mean for v in load.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    pairs = collections.defaultdict(set)
    for r in got:
        if r["doc_id"] is not None and 7000 <= r["doc_id"] < 7200:
            pairs[(r["doc_id"] - 7000) // 2].add(r["shard"])
    assert sum(len(s) > 1 for s in pairs.values()) <= 15  # few edges are cut
    assert sharding.shard_documents(df.limit(0), 8).collect() == []
    one = sharding.shard_documents(df.limit(1), 8).collect()
    assert len(one) == 1 and one[0]["slot"] == 0


def cut(rows):
    """Links between shards, of (group, shard) pairs: by counting all pairs."""
    groups = collections.defaultdict(list)
    for g, shard in rows:
        groups[g].append(shard)
    return sum(a != b for s in groups.values() for k, a in enumerate(s) for b in s[:k])


def test_large_group_fills_few_shards(spark):
    rows = [(k, f"text {k} " * 5) for k in range(1200)] + [(5000 + k, "copied " * 7) for k in range(1600)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 16).collect()
    load, group = collections.Counter(), collections.Counter()
    for r in got:
        load[r["shard"]] += r["size"]
        if r["doc_id"] >= 5000:
            group[r["shard"]] += r["size"]
    mean = sum(load.values()) / 16
    assert len(got) == len(rows) and all(abs(v - mean) < 0.05 * mean for v in load.values())
    few = -(-sum(group.values()) // mean)
    assert few > 4 and sum(sorted(group.values())[-int(few) :]) >= 0.98 * sum(group.values())


def test_propagation_moves_documents_and_cuts_fewer_links(spark):
    rows = [(k, f"pair {k // 2} of some words") for k in range(2000)] + [(5000 + k, f"five {k // 5} " * 4) for k in range(500)] + [(9000 + k, "big " * 10) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    base = df.select(F.col("doc_id").alias("uid"), F.md5("text").alias("g"), (F.length("text") + 16).cast("long").alias("size"))
    docs = sharding.linked_documents(base, len(rows), 8)
    pieces = docs.where("linked").groupBy("g", "origin", "part").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).withColumn("shard", F.col("origin"))
    size = base.agg(F.sum("size")).first()[0]
    after = sharding.propagate(pieces.select("g", "origin", "part", "shard", "size", "n"), size / 8, 8)
    was = sharding.cut_edges(pieces)
    assert was == cut([(r["g"], r["origin"]) for r in docs.collect()])
    now = sharding.cut_edges(after)
    moved = after.where("shard <> origin").agg(F.sum("n")).first()[0]
    assert moved > len(rows) / 2 and now < 0.7 * was  # no shard can hold the largest group: two can hold it nearly
    pairs = after.join(base.where("uid < 5600").select("g").distinct(), "g")
    assert sharding.cut_edges(pairs) < 0.05 * sharding.cut_edges(pieces.join(base.where("uid < 5600").select("g").distinct(), "g"))
    load = {r["shard"]: r["x"] for r in after.where("settled").groupBy("shard").agg(F.sum("size").alias("x")).collect()}
    assert all(x <= size / 8 for x in load.values())  # the quotas hold
    got = sharding.shard_documents(df, 8).collect()
    text = dict(rows)
    assert cut([(text[r["doc_id"]], r["shard"]) for r in got]) < 0.7 * was


def test_shards_of_odd_rows(spark):
    import zlib

    rows = [(1, "é" * 100_000, "a"), (2, "é" * 100_000, "b"), (3, "", "c"), (4, None, None), (None, None, "d"), (1, "x", "e"), (1, "x", "e")] + [(k, f"n{k}", "f") for k in range(10, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, g string").withColumn("uid", F.lit(1)).withColumn("size", F.lit("z")).withColumn("slot", F.lit(None).cast("string"))
    got = sharding.shard_documents(df, 4).collect()
    want = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    for s in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def one(word):
    return signed(xxhash.xxh64_intdigest(word.encode(), 42))


def two(a, b):
    seed = 42
    for x in (a, b):
        seed = xxhash.xxh64_intdigest(struct.pack("<q", x), seed)
    return signed(seed)


def grams(text):
    w = [one(x) for x in WORD.findall(text or "")]
    return [x & (quality.BUCKETS - 1) for x in w + [two(*p) for p in zip(w, w[1:])]]


def test_quality_equals_brute_force(spark):
    good = "the quick brown fox jumps over the lazy dog near the river bank today".split()
    docs = [(k, " ".join(good[k % 5 :] + good[: k % 5] + [f"n{k}"])) for k in range(40)]
    docs += [(100, "a b c d e f " * 10), (101, "one\ntwo\none\n\n \none"), (102, None), (103, ""), (104, "#x* $y %z &a |b <c >d " * 2), (105, "é" * 50000), (106, "w " * 20000), (0, "repeated id"), (None, "no id here at all but ten words in this text ok")]
    docs += [(107, "p q r s t p q r s t u p q r s t"), (108, "x x x x x x"), (109, "junk### junk$$$ " * 20)]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, words int, score int")
    trusted = spark.createDataFrame([(k,) for k in range(1, 40)] + [(None,), (1,)], "doc_id long")
    raw, target = collections.Counter(), collections.Counter()
    for i, t in docs:
        raw.update(grams(t))
        if i in range(1, 40):
            target.update(grams(t))
    a = quality.SMOOTHING
    weight = lambda b: math.log((target[b] + a) / (target.total() + a * quality.BUCKETS)) - math.log((raw[b] + a) / (raw.total() + a * quality.BUCKETS))
    want = []
    for i, t in docs:
        w = WORD.findall(t or "")
        seen = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        cover = {j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        failed = len(w) < 10 or 100 * len(cover) > 20 * len(w)
        g = grams(t)
        s = sum(map(weight, g)) / len(g) if g else 0.0
        want.append((str(i), len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover), failed, round(s, 3), not failed and s >= quality.THRESHOLD))
    got = [(str(r[0]), *r[1:7], round(r["score"], 3), r["kept"]) for r in quality.quality(df, trusted).collect()]
    assert sorted(got) == sorted(want)
    assert quality.quality(df.limit(0), trusted).collect() == []
    assert {r["score"] for r in quality.quality(df, trusted.limit(0)).collect()} == {0.0}


def test_quality_threshold_from_labels(spark):
    words = {x: [f"{x}{k}" for k in range(60)] for x in ("en", "de", "es", "fr")}
    docs, trusted, low = [], [], []
    for n, (lang, w) in enumerate(words.items()):
        for k in range(60):
            i = 1000 * n + k
            text = [w[(k * 7 + j * (1 + k % 5)) % 60] for j in range(40)]
            if k % 6 == 0:  # two words of forty carry signs: damaged, yet nearly as likely as the rest
                text = [x + "&&&" if j in (11, 29) else x for j, x in enumerate(text)]
            docs.append((i, " ".join(text)))
            (low if k % 6 == 0 else trusted).append((i,))
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    df, good, bad = frame(docs, "doc_id long, text string"), frame(trusted, "doc_id long"), frame(low, "doc_id long")
    rows = quality.quality(df, good, bad).collect()
    marked = {i for (i,) in low}
    alive = [r for r in rows if not r["base_failed"]]
    assert {r["doc_id"] // 1000 for r in alive if r["doc_id"] in marked} == {0, 1, 2, 3}
    assert [r["doc_id"] for r in alive if r["kept"] == (r["doc_id"] in marked)] == []
    assert any(r["score"] >= quality.THRESHOLD for r in alive if r["doc_id"] in marked)
    none = quality.quality(df, good, bad.limit(0)).collect()
    assert all(r["kept"] == (not r["base_failed"] and r["score"] >= quality.THRESHOLD) for r in none)


def test_quality_counts_all_trusted_rows(spark):
    df = spark.range(20_500).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit(f"w{k}x"), F.pmod(F.col("id") * (k + 3), F.lit(997))) for k in range(12)]).alias("text"))
    rows = quality.quality(df, df.select("doc_id"))
    assert rows.where("score <> 0").count() == 0  # the target's shares are those of all documents


def test_quality_cut_takes_all_scores(spark):
    rows = [(((k * 7919) % 25_013) / 1000.0, int(k % 25_013 > 9_000 or k % 3 == 0), int(k % 25_013 <= 9_000 and k % 5 != 0)) for k in range(26_000)]
    rows = [(s, g, b) for s, g, b in rows if g or b]
    at = collections.defaultdict(lambda: [0, 0])
    for s, g, b in rows:
        at[s][0] += g
        at[s][1] += b
    all_g, all_b, lost, gone, last, best = sum(r[1] for r in rows), sum(r[2] for r in rows), 0, 0, None, None
    for s, (g, b) in sorted(at.items()):
        new = (lost * all_b + (all_b - gone) * all_g, (s + (s if last is None else last)) / 2)
        best, lost, gone, last = new if best is None else min(best, new), lost + g, gone + b, s
    df = spark.createDataFrame(rows, "score double, g long, b long")
    assert quality.best_cut(df).collect()[0]["cut"] == best[1]
    assert quality.best_cut(df.where("b = 0")).collect()[0]["cut"] is None


def brute_lines(docs, least):
    """Line numbers that go, from all runs of all documents."""
    seqs = {}
    for i, t in docs:
        if t is not None:
            seqs[i] = [(k, x, len(WORD.findall(x))) for k, x in enumerate(t.split("\n")) if WORD.search(x)]
    where = collections.defaultdict(list)
    for i in sorted(seqs):
        s = seqs[i]
        for a in range(len(s)):
            n = 0
            for b in range(a, len(s)):
                n += s[b][2]
                if n >= least:
                    where[tuple(x for _, x, _ in s[a : b + 1])].append((i, a))
    gone = collections.defaultdict(set)
    for run, at in where.items():
        i0, a0 = at[0]
        for i, a in at[1:]:
            if i != i0 or a >= a0 + len(run):
                gone[i].update(k for k, _, _ in seqs[i][a : a + len(run)])
    return gone


@pytest.mark.parametrize("least", [4, 7])
def test_line_runs_equal_brute_force(spark, least):
    import random

    r = random.Random(least)
    lines = ["a b", "c", "d e f", "", "g h i j", "  ", "k l m n o p"]
    docs = [(k, "\n".join(r.choice(lines) for _ in range(r.randint(1, 12)))) for k in range(30)]
    docs += [(100, None), (101, ""), (102, "\n".join(["x y"] * 20)), (103, "u " * 20000), (104, "u " * 20000)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, gone int")
    gone = brute_lines(docs, least)
    got = {x["doc_id"]: x for x in line_dedup.deduplicate_lines(df, least).collect()}
    for i, t in docs:
        n = 0 if t is None else len(t.split("\n"))
        kept = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])
        assert (got[i]["n_lines"], got[i]["n_deleted"], got[i]["text"]) == (n, len(gone[i]), kept), (i, t)


def test_line_dedup_of_repeated_rows_and_nothing(spark):
    t = "\n".join(f"word{k} " * 10 for k in range(8))
    df = spark.createDataFrame([(1, t), (1, t), (None, t), (2, t + "\nmore")], "doc_id long, text string")
    got = sorted((str(x["doc_id"]), x["n_deleted"]) for x in line_dedup.deduplicate_lines(df).collect())
    assert got == [("1", 0), ("1", 0), ("2", 8), ("None", 8)]
    assert line_dedup.deduplicate_lines(df.limit(0)).collect() == []
    assert hashlib.sha256(b"").hexdigest()
