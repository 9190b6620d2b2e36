import re
from collections import Counter, defaultdict

from caseloom.llm import divergence
from caseloom.llm.queries import op11_source_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(rows, least, top):
    """The audit term by term, over rows (lang, source, text)."""
    docs, n, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = TERM.findall((text or "").translate(LOWER))
        docs[lang].update(set(words))
        n[lang, source].update(words)
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, d in docs[lang].items() if d >= least]
        sources = sorted(s for x, s in groups if x == lang)
        whole = Counter()
        for s in sources:
            whole.update(n[lang, s])

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = {s: shares(n[lang, s]) for s in sources}, shares(whole)
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, v, k) for k, (item, v) in enumerate(items[:most], 1)}
    return out


def got(df):
    rows = [(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def corpus(k=400):
    words = ["the", "The", "é", "straße", "Éclair", "x-y", "a1b", "rare", "zzz", "ZZZ", "中文", " ", "ﬁ"]
    rows = []
    for i in range(k):
        text = " ".join(words[(i * j + j * j) % len(words)] for j in range(i % 23))
        rows.append((("en", "de", None, "", "fr")[i % 5], ("hot", "hot", "s1", None, "s2", "hot", "é", "s10")[i % 8], None if i % 41 == 0 else text))
    return [*rows, *rows[:50], ("solo", "one", "the the"), ("void", "a", None), ("void", "b", "!!! 12")]


def test_audit_equals_the_plain_one(spark):
    rows = corpus()
    df = spark.createDataFrame([(k, "x", *r) for k, r in enumerate(rows)], "n long, term string, lang string, source string, text string").repartition(5)
    for least, top in ((30, 50), (1, 3), (10_000, 50)):
        assert got(divergence.audit_sources(df, least, top)) == plain(rows, least, top)
    assert divergence.audit_sources(df.limit(0)).collect() == []


def test_partial_counts_are_exact(spark, monkeypatch):
    rows = corpus(60)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({c: [(r[k] or "") for r in rows] for k, c in enumerate(("lang", "source", "text"))})
    monkeypatch.setattr(divergence, "ENTRIES", 5)
    total, docs = Counter(), Counter()
    for out in divergence._counted(iter([batch])):
        for r in out.to_pylist():
            if r["term"] is not None:
                total[r["lang"], r["source"], r["term"]] += r["n"]
                docs[r["lang"], r["source"], r["term"]] += r["docs"]
    want, want_docs = Counter(), Counter()
    for lang, source, text in rows:
        words = TERM.findall((text or "").translate(LOWER))
        want.update((lang or "", source or "", w) for w in words)
        want_docs.update((lang or "", source or "", w) for w in set(words))
    assert total == want and docs == want_docs


def test_long_text_and_large_counts(spark):
    rows = [("en", "a", "word " * 300_000 + "other"), ("en", "b", "other"), ("en", "b", "word")]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    assert got(divergence.audit_sources(df, 1)) == plain(rows, 1, 50)


def test_query(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("lang", "source", "text").collect()
    assert got(op11_source_divergence(spark, data)) == plain([tuple(r) for r in docs], 30, 50)
