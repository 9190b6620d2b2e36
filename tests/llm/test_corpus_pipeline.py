"""The pipeline against a plain version of each stage, and the contract of its stages."""

import hashlib
import itertools
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from caseloom.llm import toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder):
    r = np.random.RandomState(5)
    words = [f"w{k}" for k in range(400)]
    docs, labels = [], []
    for k in range(240):
        t = list(r.choice(words, r.randint(8, 60)))
        if k % 6 == 0:
            for at in r.randint(0, len(t), 3):
                t[at] = "scoundrel"
        docs.append([k, " ".join(t), "en", "hot" if k % 3 else f"s{k % 4}", 0])
        labels.append((k, 1, int(k % 6 == 0)))
    for k in range(240, 300):  # copies, with other white space, and near copies
        base = docs[k - 200][1]
        docs.append([k, base.replace(" ", "  ", k % 3) if k % 2 else base + " tail", "en", "copies", 0])
    docs += [[400, None, None, None, None], [401, "", "en", "hot", 0], [402, "one two", "en", "hot", 7]]
    for d in docs:
        d[4] = len(d[1] or "")
    spark.createDataFrame([tuple(d) for d in docs], SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs, labels


def brute(docs, labels):
    taught = sorted((i, (dict((d[0], d[1]) for d in docs)[i] or "").encode(), y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 5)
    model = toxicity.fit([t for _, t, _ in taught], [y for _, _, y in taught])
    emissions = toxicity.Emissions(model)
    docs = [d for d in docs if toxicity._score([None if d[1] is None else d[1].encode()], model, emissions)[0][0] < 0.5]
    best = {}
    for d in docs:
        key = "".join((d[1] or "").split())
        best[key] = min(best.get(key, (1, 0)), (-len(d[1] or ""), d[0]))
    docs = [d for d in docs if best["".join((d[1] or "").split())][1] == d[0]]
    sets = []
    for d in docs:
        w = (d[1] or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(docs)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    docs = [d for k, d in enumerate(docs) if find(k) == k]
    size, per = {}, {}
    for d in docs:
        size[d[0]] = len((d[1] or "").split())
        per[d[3]] = per.get(d[3], 0) + size[d[0]]
    order = sorted(per, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    target, full, left = {}, set(), float(sum(per.values()))
    while True:
        free = [s for s in order if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * per[s]]
        if not over:
            target |= share
            break
        full.update(over)
        target |= {s: 3.0 * per[s] for s in over}
        left = sum(per.values()) - sum(target[s] for s in full)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = []
    for d in docs:
        rate = target[d[3]] / per[d[3]] if per[d[3]] else 0.0
        u = int(hashlib.md5(f"0:{d[0]}".encode()).hexdigest()[:13], 16) / 2**52
        ids = library.encode(d[1] or "", add_special_tokens=False).ids
        out += [(d[0], len(ids), ids)] * (int(rate) + (u < rate - int(rate)))
    return sorted(out)


def test_pipeline_equals_brute_force(spark, tmp_path):
    docs, labels = tables(spark, str(tmp_path))
    got = sorted((r["doc_id"], r["n_tokens"], r["ids"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == brute(docs, labels)


def test_repeated_rows_and_ids_are_dropped_once(spark, tmp_path):
    rows = [(1, "ab", "a"), (1, "a b", "b"), (5, "q r", "c"), (5, "q r", "c"), (6, "other words that stand alone here of all these rows today", "d"), (6, "other words that stand alone here" + " of all these rows today" + " now", "e"), (None, "zz", "f"), (None, "zz", "f")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], SCHEMA).repartition(3)
    exact = corpus_pipeline.exact_dedup(spark, docs, str(tmp_path))
    assert sorted((str(r["doc_id"]), r["text"], r["source"]) for r in exact.collect()) == sorted({(str(i), t, s) for i, t, s in rows if s != "a"})
    near = corpus_pipeline.near_dedup(spark, docs.where("doc_id = 6 or doc_id is null"), str(tmp_path))
    assert sorted(r["text"][:5] for r in near.collect()) == ["other", "zz"]


def test_stages_keep_the_columns_and_stand_an_empty_table(spark, tmp_path):
    tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "bpe"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), str(tmp_path))
        assert out.collect() == []
        assert name == "bpe" or out.columns == docs.columns
