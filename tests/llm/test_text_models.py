import itertools
import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from caseloom.llm import bpe, toxicity
from caseloom.llm import html_extract as H

BPE = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", None, " ", "\n", "aaaaaaaaaaaa", "<|endoftext|>", "a<|startoftext|>b c<|endoftext|><|endoftext|>", "<|ENDOFTEXT|>", "it's I'll we'd'd'ss 'RE x'Ve", "ΑΣ ΣΑΣ", "İstanbul ẞ", "é é ́a", "x\x1cy\u0085w v　t​s",
    "日本語テスト 한국어 ½ ²", "👍🏽👨‍👩‍👧", "\x00\x01 \x7f", "...!!!???", "<|endoftext", "<|<|endoftext|>|>", "\U0001f1e6", "12345 3.14 a1b2", "z" * 30000, "word " * 20000,
]


def test_bpe_equals_the_library(spark):
    library = Tokenizer.from_file(BPE)
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(ODD)] + [(None, "no id", "x"), (0, "", "x")], "doc_id long, text string, ids string")
    for r, t in [(r, ODD[r["doc_id"]]) for r in bpe.encode_documents(df, BPE).collect() if r["doc_id"]]:
        want = library.encode(t or "", add_special_tokens=False).ids
        assert r["ids"] == " ".join(map(str, want)) and r["n_tokens"] == len(want)
        assert r["decoded"] == library.decode(want, skip_special_tokens=False)
    assert bpe.encode_documents(df.limit(0), BPE).collect() == []


def test_bpe_on_all_of_the_basic_plane():
    library = Tokenizer.from_file(BPE)
    texts = [chr(c) + "a" + chr(c) for c in range(1, 0x3000)]
    ours = [x[1] for x in bpe.WordBpe(BPE).encode_all(texts)]
    assert ours == [" ".join(map(str, e.ids)) for e in library.encode_batch(texts, add_special_tokens=False)]


def merged(word, merges):
    """Tokens by the rule itself: the pair of least rank, the leftmost one, again and again."""
    ids = list(word)
    while True:
        ranks = [(merges[a << 16 | b], k) for k, (a, b) in enumerate(zip(ids, ids[1:])) if a << 16 | b in merges]
        if not ranks:
            return ids
        m, k = min(ranks)
        ids[k : k + 2] = [m & 0xFFFF]


def test_automaton_of_small_vocabularies():
    r = np.random.RandomState(1)
    for seed in range(40):
        tokens = {b"a": 0, b"b": 1, b"c": 2}
        final = {b"a": 3, b"b": 4, b"c": 5}
        merges, n = {}, 6
        for rank in range(12):
            left = list(tokens.items())[r.randint(len(tokens))]
            end = r.rand() < 0.3
            right = list((final if end else tokens).items())[r.randint(len(final if end else tokens))]
            word, pair = left[0] + right[0], left[1] << 16 | right[1]
            if pair in merges or word in (final if end else tokens):
                continue
            (final if end else tokens)[word] = n
            merges[pair] = rank << 16 | n
            n += 1
        a = bpe.MergeAutomaton(tokens, final, merges, most=seed)
        for size in range(1, 8):
            for w in itertools.product(b"abc", repeat=size):
                word = bytes(w)
                ids = [tokens[bytes([x])] for x in word[:-1]] + [final[word[-1:]]]
                assert a.encode(word) == merged(ids, merges), (word, merges)


def test_forgetting_changes_nothing(monkeypatch):
    library = Tokenizer.from_file(BPE)
    monkeypatch.setattr(bpe, "REMEMBER", 3)
    w = bpe.WordBpe(BPE)
    w.automaton.most = 5
    texts = ["one two three four xqzvvkw", "five one zzyzx", "six two seven xqzvvkw"]
    assert [w.encode(t) for t in texts * 2] == [library.encode(t, add_special_tokens=False).ids for t in texts * 2]
    assert len(w.automaton.table) <= len(w.automaton.base) + 6


def test_words_that_are_read_together_equal_the_rule():
    r = np.random.RandomState(3)
    tokens, final, merges = {b"a": 0, b"b": 1, b"c": 2}, {b"a": 3, b"b": 4, b"c": 5}, {}
    while len(merges) < 30:
        left = list(tokens.items())[r.randint(len(tokens))]
        ends = final if r.rand() < 0.3 else tokens
        right = list(ends.items())[r.randint(len(ends))]
        if left[1] << 16 | right[1] not in merges and left[0] + right[0] not in ends:
            ends[left[0] + right[0]] = 6 + len(merges)
            merges[left[1] << 16 | right[1]] = len(merges) << 16 | 6 + len(merges)
    a = bpe.MergeAutomaton(tokens, final, merges)
    words = [b"", *[bytes(r.choice(list(b"abc"), r.randint(0, 30)).tolist()) for _ in range(500)], b""]
    size = np.array([len(w) for w in words])
    found, count = a.encode_words(np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size)
    for w, got in zip(words, np.split(found, np.cumsum(count)[:-1]), strict=True):
        assert got.tolist() == merged([tokens[bytes([x])] for x in w[:-1]] + [final[w[k : k + 1]] for k in [len(w) - 1] if w], merges) == a.encode(w)


def test_blocks_of_mixed_pieces_equal_the_library(monkeypatch):
    library = Tokenizer.from_file(BPE)
    monkeypatch.setattr(bpe, "REMEMBER", 3)
    monkeypatch.setattr(bpe, "BLOCK", 4)
    monkeypatch.setattr(bpe, "TOGETHER", 9)
    w = bpe.WordBpe(BPE)
    texts = [*ODD, "Übermäßigkeiten über ALLES, naïve; l'été <|endoftext|>Grüße日本<|startoftext|> <|", "\u2003 x\u2003y \x85", *ODD[::-1]]
    for t, (n, ids, decoded) in zip(texts, w.encode_all(texts), strict=True):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert (n, ids, decoded) == (len(want), " ".join(map(str, want)), library.decode(want, skip_special_tokens=False))
    assert [*w.encode_all([])] == [] and [*w.encode_all([None])] == [(0, "", "")]


def test_new_words_cost_less_together_than_one_by_one():
    import time

    r = np.random.RandomState(4)
    parts = ["er", "th", "on", "sch", "ing", "ti", "ä", "ble", "pf", "un", "st", "ly"]
    words = ["".join(r.choice(parts, 5)) for _ in range(60_000)]
    w = bpe.WordBpe(BPE)
    texts = [" ".join(words)]
    want = [i for x in words for i in w.automaton.encode(x.encode())]
    began = time.process_time()
    for x in words:
        w.automaton.encode(x.encode())
    single, began = time.process_time() - began, time.process_time()
    (_, ids, _), = w.encode_all(texts)
    assert time.process_time() - began < 0.7 * single
    assert ids == " ".join(map(str, want))


def chain(em, m):
    z, p = 0.0, np.zeros(len(em))
    for s in itertools.product((0, 1), repeat=len(em)):
        q = m.start[s[0]] * np.exp(em[0] * s[0])
        for k in range(1, len(em)):
            q *= m.step[s[k - 1]][s[k]] * np.exp(em[k] * s[k])
        z, p = z + q, p + q * np.array(s)
    return p / z


def test_marginals_equal_enumeration():
    m = toxicity.Model(step=((0.8, 0.3), (0.5, 0.9)), start=(0.7, 0.3))
    r = np.random.RandomState(0)
    lengths = [1, 4, 2, 7, 1, 3]
    em = r.randn(sum(lengths))
    first = np.zeros(len(em), bool)
    first[np.cumsum([0, *lengths[:-1]])] = True
    want = np.concatenate([chain(x, m) for x in np.split(em, np.cumsum(lengths)[:-1])])
    assert np.allclose(toxicity.marginals(em, first, m), want)
    p, pairs = toxicity.marginals(em, first, m, pairs=True)
    assert pairs.sum() == pytest.approx(len(em) - len(lengths)) and len(toxicity.marginals(em[:0], first[:0], m)) == 0


def corpus(n=400):
    r = np.random.RandomState(2)
    words = [f"w{k}" for k in range(300)]
    out = []
    for k in range(n):
        t = list(r.choice(words, r.randint(5, 60)))
        if k % 5 == 0:
            for at in r.randint(0, len(t), 3):
                t[at] = str(r.choice(["scoundrel", "rascals", "Rascal,"]))
        out.append((k, " ".join(t), int(k % 5 == 0)))
    return out


def test_toxicity_held_out_and_edge_cases(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows] + [(None, "w1 scoundrel", "s"), (9000, None, "s"), (9001, "", "s"), (9002, "é " * 20000, "s"), (5, rows[5][1], "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (7, None)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == len(rows) + 5 and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 9000]
    truth = {i: y for i, _, y in rows}
    assert len(held) > 40 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    text = dict((i, t) for i, t, _ in rows)
    for r in got:
        for s in r["spans"]:
            if r["doc_id"] in text:
                assert re.search("scoundrel|rascal", text[r["doc_id"]][s["start"] : s["end"]], re.I)
    clean = toxicity.clean_documents(docs, toxicity.train(docs, labels))
    assert clean.columns == docs.columns and clean.count() == sum(r["predicted"] == 0 for r in got)
    nothing = toxicity.train(docs, labels.limit(0))
    assert {r["predicted"] for r in toxicity.score_toxicity(docs, nothing).collect()} == {0}
    assert toxicity.score_toxicity(docs.limit(0), nothing).collect() == []


def test_tree_marginals_equal_enumeration():
    parent, depth = np.array([-1, 0, 0, 1, -1]), np.array([0, 1, 1, 2, 0])
    r = np.random.RandomState(0)
    unary, pair = r.randn(5, 2), r.randn(2, 2)
    z, p = 0.0, np.zeros(5)
    for s in itertools.product((0, 1), repeat=5):
        q = np.exp(sum(unary[i, s[i]] for i in range(5)) + sum(pair[s[parent[i]], s[i]] for i in range(5) if parent[i] >= 0))
        z, p = z + q, p + q * np.array(s)
    assert np.allclose(H.marginals(unary, parent, depth, pair), p / z)


def test_extraction_on_pages_not_trained_on():
    good = total = 0
    for page in H.labelled_pages(150, seed=77):
        tree = H.parse(page)
        y = H.labels_of(page)
        main = H.extract([page], H.default_model())[0].split("\n\n")
        for node, text in tree.runs:
            total += 1
            good += (text in main) == bool(y[node])
    assert good >= 0.95 * total


def test_structure_decides_where_names_do_not():
    get = lambda page: H.extract([page], H.default_model())[0]
    lone = "one paragraph of seventeen words that stands alone on its page and says all there is to say"
    real = "Real text of an article that is long."
    assert get(f"<html><body><p>{lone}</p></body></html>") == get(f"<p>{lone}") == get(lone) == lone
    assert get(f'<article><p>{real}</p><div class="trending">Hot: <a href=x>this</a> <a href=y>that</a></div></article>') == real
    assert get(f'<article><p>{real}</p><div class="trending">Something else</div></article>') == real
    assert get(f'<article><h1>Title</h1><p>{real} It has two sentences.</p></article><div class="user-feedback"><div class="item"><p>I liked it.</p></div><div class="item"><p>Me too.</p></div></div>') == f"Title\n\n{real} It has two sentences."
    assert get("<main><p>Hi there.</p></main><footer><p>Terms apply. All rights reserved.</p></footer>") == "Hi there."


@pytest.mark.parametrize("page", ['<a href="' * 110_000, "<a " * 350_000, "<a title='>" * 90_000, "<!--" * 250_000, "<" * 1_000_000, "</b>" * 250_000, "<script>" * 120_000])
def test_a_megabyte_of_broken_markup_takes_linear_time(page):
    import time

    H.default_model()
    began = time.process_time()
    H.extract([page], H.default_model())
    assert time.process_time() - began < 1.0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">a</a></li><li><a href="/b">b</a></li></ul></nav><!-- ad --><div class="ad">Buy this now.</div>
<article><h1>Head &amp; line</h1><p><b>First   part<br>goes on.<p>Second&nbsp;one &lt;x&gt; with <a href="/c">a link</a> in it &copy 5 &am<P>Third part of the text, long enough to read.</p></article><footer>&copy; someone</footer></body></html>"""


def test_extraction_cases(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 1), (2, None, None, 1), (3, "v", "", 1), (None, "w", "<p>", 1), (1, "u", PAGE, 1), (4, "x", "<div " * 2000 + 'class="' + "a" * 50000, 1), (5, "y", PAGE.replace("</article>", "<p>w</p>" * 5000 + "</article>"), 1)], "page_id long, url string, html string, text int")
    got = [(r["page_id"], r["text"]) for r in H.extract_main_text(df).collect()]
    want = "Head & line\n\nFirst part goes on.\n\nSecond one <x> with a link in it © 5 &am\n\nThird part of the text, long enough to read."
    assert sorted(str(g) for g in got if g[0] in (1, 2, 3)) == sorted(map(str, [(1, want), (1, want), (2, ""), (3, "")]))
    assert len(got) == 7 and dict(got)[5].count("\n\nw") == 5000
    assert H.extract_main_text(df.limit(0)).collect() == []
