import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.llm import near_dedup as N
from caseloom.llm import shingles as S
from caseloom.llm.common import join_groups
from caseloom.llm.components import connected_components
from caseloom.llm.near_dedup import near_duplicates


def shingle(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    """Component of each row number, by all pairs."""
    sets = [shingle(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(docs)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [docs[k][0] if not sets[k] else least.get(find(k)) for k in range(len(docs))]


def check(spark, docs, extra=()):
    df = spark.createDataFrame([(*d, *["x"] * len(extra)) for d in docs], "doc_id long, text string" + "".join(f", {c} string" for c in extra))
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in near_duplicates(df).collect())
    want = sorted((str(i), len(shingle(t)), str(c), i == c) for (i, t), c in zip(docs, brute(docs), strict=True))
    assert got == want


def words(seed, n):
    r = np.random.RandomState(seed)
    return [f"w{x}" for x in r.randint(0, 5000, n)]


def test_chains_copies_and_edge_cases(spark):
    base = words(1, 120)
    docs = [(k, " ".join([*words(100 + k, 3 * k), *base[3 * k :]])) for k in range(12)]  # each near the next, the ends far apart
    docs += [(50, "short one"), (51, "Short  ONE"), (52, "short one two"), (53, ""), (54, None), (55, " \n\t"), (56, "a b c d e"), (57, "É b c d e"), (58, "é b c d e")]
    docs += [(7, "repeated id with another text of more than five words"), (60, "same row here it is"), (60, "same row here it is"), (None, "no id but text of five words"), (None, None)]
    docs += [(70, " ".join(words(5, 20000))), (71, " ".join(words(5, 20000)[:-5]))]
    check(spark, docs, ("cls", "sketch", "a", "text_b"))


def test_many_near_copies_of_one_text(spark):
    base = words(9, 80)
    docs = []
    for k in range(150):
        w = list(base)
        for j in np.random.RandomState(k).randint(0, 80, k % 6):
            w[j] = f"x{k}_{j}"
        docs.append((k, " ".join(w)))
    check(spark, docs)


def test_repeated_rows_are_verified_once(spark, monkeypatch):
    seen = []
    verified = N._verified
    monkeypatch.setattr(N, "_verified", lambda pairs, texts, percent: (seen.append((pairs.count(), texts.count(), texts.select("cls").distinct().count())), verified(pairs, texts, percent))[1])
    base = words(3, 60)
    docs = [(1, " ".join(base))] * 600 + [(2, " ".join([*base[:-1], "other"]))] * 600 + [(9, " ".join(words(4, 60)))]
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (2, 1), (9, 9)} and len(got) == len(docs)
    assert sum(p for p, _, _ in seen) == 1 and all(t == c for _, t, c in seen)


def test_one_row_of_a_group_stays(spark):
    base = words(3, 60)
    docs = [(7, " ".join(base), 1), (7, " ".join([*base[:-1], "x"]), 2), (None, " ".join([*base[:-1], "y"]), 3), (None, None, 4), (8, "", 5), (9, "a lone text", 6), (9, "a lone text", 7)]
    got = sorted(r["k"] for r in N.kept_rows(spark.createDataFrame(docs, "doc_id long, text string, k long"), "k").collect())
    assert got == [1, 4, 5, 6]


def test_hot_groups_join_like_others(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top")).where("k % 2 = 1")
    key = lambda r: (r["k"], r["id"], r["n"], r["top"])
    for how in ("inner", "left"):
        want = sorted(map(str, map(key, rows.join(groups, "k", how).collect())))
        assert sorted(map(str, map(key, join_groups(rows, groups, ["k"], "n", 5000, how).collect()))) == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(df).collect() == []


def test_components_of_a_long_path(spark):
    e = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["component"] for r in connected_components(e).collect()} == {0}


@pytest.mark.parametrize("buckets", [128, 512])
@pytest.mark.parametrize(("n", "share"), [(6, 5), (60, 50), (3000, 2400)])
def test_registers_agree_with_jaccard(n, share, buckets):
    r = np.random.RandomState(3)
    agree = []
    for _ in range(60):
        pool = np.unique(r.randint(0, 2**63, 2 * n, dtype=np.int64).astype(np.uint64) * np.uint64(2))
        a, b = pool[:n], np.concatenate([pool[:share], pool[n : 2 * n - share]])
        a, b = np.unique(S._mix(a)), np.unique(S._mix(b))
        agree.append((S.registers(a, buckets) == S.registers(b, buckets)).mean())
    p = S.collision_rate(n, n)
    assert abs((np.mean(agree) - p) / (1 - p) - share / (2 * n - share)) < 0.06


def test_chance_collisions_are_as_computed():
    r = np.random.RandomState(4)
    a, b = (np.unique(S._mix(r.randint(0, 2**62, 5000).astype(np.uint64))) for _ in range(2))
    many = [(S.registers(np.unique(S._mix(a + np.uint64(k)))) == S.registers(np.unique(S._mix(b + np.uint64(k * 7 + 1))))).mean() for k in range(300)]
    assert np.mean(many) == pytest.approx(S.collision_rate(5000, 5000), abs=4e-4)
