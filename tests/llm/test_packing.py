import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from caseloom.llm import packing
from caseloom.llm.queries import op13_packing

FILES = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILES[0])


def expected(library, rows, length=1024):
    """Counter of (doc_id, piece, start, length, crc)."""
    out = Counter()
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        cut = len(ids) % length or length
        cuts = [0, *range(cut, len(ids) + 1, length)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            out[doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    return out


def check(rows, want, length=1024, slack=0.02):
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in held.values():
        at = 0
        for offset, size in sorted(places):
            assert offset == at
            at += size
        assert at <= length
    least = -(-sum(r["length"] for r in rows) // length)
    assert len(held) <= least * (1 + slack) + 8
    return len(held)


def test_ids_equal_the_library(library):
    encode = packing.Encoder(*FILES)
    rng = random.Random(5)
    signs = [chr(c) for c in range(0x250)]
    texts = [a + b + a for a in signs for b in (" ", "a", "1", "'s", "\n", ".")] + [f"x{c}y {c}{c} z" for c in signs]
    texts += ["".join(rng.choices(signs + [" "] * 200 + list("etaoin") * 40, k=rng.randrange(300))) for _ in range(500)]
    texts += ["", " ", "<|endoftext|>", "a<|endoftext|> b", "中文 текст 🙂   x", "a" * 5000, " " * 3000 + "x", "ab " * 3000, "don't we'll I'M 'S", "\x00\x1f", "İ ŉ"]
    for text, got in zip(texts, encode(texts), strict=True):
        assert got.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_rule_is_the_sum_of_squares():
    rng = random.Random(1)
    room, gaps = packing.OpenSequences(64), {}
    for size in sorted((rng.randrange(1, 64) for _ in range(3000)), reverse=True):
        counts = Counter(gaps.values())
        squares = lambda c: sum(v * v for v in c.values())
        options = []
        for g in set(gaps.values()):
            if g >= size:
                after = counts.copy()
                after[g] -= 1
                if g > size:
                    after[g - size] += 1
                options.append((squares(after), g - size))
        number, at = room.place(size)
        if options:
            assert number in gaps and gaps[number] == 64 - at
            assert gaps[number] - size == min(options)[1]
        else:
            assert number not in gaps and at == 0
        gaps[number] = 64 - at - size
        if not gaps[number]:
            del gaps[number]


def test_packs_whole_documents(spark, library):
    rng = random.Random(2)
    words = ["alpha", "beta,", "Γ", "don't", "12", "\n"]
    rows = [(k % 700, " ".join(rng.choices(words, k=int(rng.paretovariate(0.7) * 20) % 4000))) for k in range(900)]
    rows += [(None, None), (None, ""), (5, "again"), (5, "again"), (6, "long " * 100_000), (7, "x" * 50_000)]
    df = spark.createDataFrame([(*r, "a", 1, 2) for r in rows], "doc_id long, text string, piece string, uid long, cell int").repartition(6)
    check(packing.pack_documents(df, *FILES).collect(), expected(library, rows))
    check(packing.pack_documents(df, FILES[0]).collect(), expected(library, rows))
    assert packing.pack_documents(df.limit(0), *FILES).collect() == []


def test_many_cells(spark, library):
    rows = [(k, "word " * (k * 37 % 900)) for k in range(3000)]
    pieces = packing.materialize(packing.token_pieces(spark.createDataFrame(rows, "doc_id long, text string"), *FILES).drop("ids").withColumn("uid", packing.F.monotonically_increasing_id()), "t")
    one = check(packing.pack_pieces(pieces).collect(), expected(library, rows), slack=0.01)
    many = check(packing.pack_pieces(pieces, cell_rows=300).collect(), expected(library, rows), slack=0.06)
    assert one <= many


def test_ids_of_pieces(spark, library):
    rows = [(1, "one two three " * 700), (2, None)]
    got = packing.token_pieces(spark.createDataFrame(rows, "doc_id long, text string"), FILES[0], length=100).orderBy("doc_id", "piece").collect()
    assert sum((r["ids"] for r in got if r["doc_id"] == 1), []) == [*library.encode(rows[0][1], add_special_tokens=False).ids, 2]
    assert [r["ids"] for r in got if r["doc_id"] == 2] == [[2]]


def test_query(spark, data, library):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    check(op13_packing(spark, data).collect(), expected(library, rows))
