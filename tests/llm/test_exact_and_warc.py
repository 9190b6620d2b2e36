import gzip
import hashlib
import io as pyio

import pytest

from caseloom.llm import exact_dedup as X
from caseloom.llm import warc


def plain(t):
    return "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")


def expected(docs, key=plain):
    groups = {}
    for i, t in docs:
        groups.setdefault(key(t), []).append((-len(t or ""), i is None, i or 0))
    out, taken = [], set()
    for i, t in docs:
        g = groups[key(t)]
        best = min(g)
        kept = (-len(t or ""), i is None, i or 0) == best and key(t) not in taken
        taken.update([key(t)] if kept else [])
        out.append((str(i), "None" if best[1] else str(best[2]), len(g), kept, hashlib.sha256(plain(t).encode()).hexdigest()))
    return sorted(out)


DOCS = [(1, "a b"), (2, "ab"), (3, "a  b"), (9, "a b"), (4, ""), (5, None), (6, " \n"), (7, "é"), (7, "é"), (8, "long " * 30000), (10, "long" * 30000), (None, "ab "), (None, "only here"), (11, "AB")]


def test_exact_duplicates(spark):
    df = spark.createDataFrame([(*d, 1, "y") for d in DOCS], "doc_id long, text string, digest int, keep_id string").repartition(3)
    got = sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"], r["text_sha256"]) for r in X.exact_duplicates(df).collect())
    assert got == expected(DOCS)
    assert X.exact_duplicates(df.limit(0)).collect() == []


def test_colliding_digests_are_told_apart_by_bytes(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)
    got = sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in X.exact_duplicates(df, lambda b: b"\0" * 31 + bytes([len(b) % 2])).collect())
    assert got == [x[:4] for x in expected(DOCS)]


def test_one_row_of_repeated_rows_stays(spark):
    df = spark.createDataFrame([(1, "ab", 7), (1, "a b", 8), (5, "q", 9), (5, "q", 10), (None, "n", 11), (None, "n", 12)], "doc_id long, text string, k long").repartition(4)
    got = X.exact_duplicates(df, row="k").where("kept").collect()
    assert sorted((str(r["doc_id"]), r["row"]) for r in got)[0] == ("1", 8)
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "5", "None"]


def test_tiny_memtables_change_nothing(spark):
    df = spark.createDataFrame([*DOCS, *[(100 + k, f"text {k % 30}") for k in range(300)]], "doc_id long, text string").repartition(2)
    key = lambda r: (str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"])
    assert sorted(map(key, X.exact_duplicates(df, memtable_bytes=3000).collect())) == sorted(map(key, X.exact_duplicates(df).collect()))


def test_index_flushes_compacts_and_still_finds(tmp_path):
    index = X.Index(f"file://{tmp_path}", "t", memtable_bytes=2000, most_runs=2)
    held = 0
    for k in range(200):
        t = f"text {k % 50}".encode()
        index.put(X.sha256(t), t, (-1, False, 200 - k, 0, k))
        held = max(held, sum(len(v) for v in index.memtable.values()))
    assert index.runs and held <= 6 and index.number > 3
    before = [p.read_bytes() for p in sorted(tmp_path.iterdir())]
    got = list(index.entries())
    assert [p.read_bytes() for p in sorted(tmp_path.iterdir())] == before  # runs never change
    assert len(got) == 50 and [e.digest for e in got] == sorted(e.digest for e in got)
    assert all(e.count == 4 and e.packed for e in got) and min(e.best[2] for e in got) == 1
    index.close()
    assert not list(tmp_path.iterdir())
    f = X.Filter([X.sha256(bytes([k])) for k in range(200)])
    assert all(X.sha256(bytes([k])) in f for k in range(200))
    assert sum(X.sha256(b"no" + bytes([k])) in f for k in range(200)) < 20


PAGES = [(1, "http://a/é?x=1", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://c", None), (4, "http://d", ""), (5, "http://e\r\nX: y", "ü" * 200_000), (6, "http://f", "WARC/1.1 \x1f not a record"), (7, "http://g", "<p>two</p>"), (7, "http://g", "<p>two</p>"), (None, "http://h", "<p>nobody</p>"), (None, "http://i", "<p>one</p>")]


@pytest.mark.parametrize("split", [1, 97, 1 << 20])
def test_warc_round_trip_at_any_split(spark, tmp_path, split):
    df = spark.createDataFrame([(*p, "z") for p in PAGES], "page_id long, url string, html string, payload string")
    a = warc.write_archives(df, f"file://{tmp_path}/w{split}")
    if split == 1:
        a = a.limit(1)
    if split == 97:
        sizes = [r["size"] for r in a.collect()]
        assert warc.read_archives(a, split).rdd.getNumPartitions() == sum(-(-n // split) for n in sizes) > 1
    rows = warc.read_archives(a, split).collect()
    if split == 1:
        assert rows and len({(r["page_id"], r["url"]) for r in rows}) <= len(rows)
        return
    assert len(rows) == len(PAGES)
    latest = {}
    for i, _, h in PAGES:
        if i is not None:
            latest[h or ""] = max(i, latest.get(h or "", i))
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in rows)
    want = []
    for i, _, h in PAGES:
        b, top = (h or "").encode(), latest.get(h or "")
        back = top is not None and i != top
        want.append((str(i), len(b), warc.payload_digest(b), "revisit" if back else "response", str(top) if back else "None"))
    assert got == sorted(want)
    assert all(r["payload"] == (dict((p[0], p[2]) for p in PAGES)[r["page_id"]] or "").encode() for r in rows if r["record_type"] == "response" and r["page_id"])


def test_archives_are_plain_warc_and_false_magic_is_passed_over(spark, tmp_path):
    warc.write_archives(spark.createDataFrame(PAGES, "page_id long, url string, html string"), f"file://{tmp_path}/x").collect()
    text = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "x").glob("*.warc.gz"))
    assert text.count(b"WARC/1.1\r\nWARC-Type: ") == len(PAGES)
    good = warc.member(warc.record(1, "u", b"abc", None, warc.payload_digest(b"abc")))
    junk = b"\x1f\x8b\x08junk" + gzip.compress(b"no archive")
    data = junk + good + junk + good
    w = warc._Window(pyio.BytesIO(data), len(data))
    assert [r["page_id"] for r in warc.records_in(w, 0, len(data))] == [1, 1]
    cut = len(junk) + 1
    assert [sum(1 for _ in warc.records_in(w, a, b)) for a, b in ((0, cut), (cut, len(data)))] == [1, 1]
    assert spark.createDataFrame([], "path string, size long").count() == 0
    assert warc.read_archives(spark.createDataFrame([], "path string, size long")).collect() == []
