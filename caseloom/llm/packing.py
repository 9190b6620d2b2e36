"""Packing of token sequences: whole documents into sequences of fixed length."""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from caseloom.llm.common import materialize, slices, trim

#: Tokens of a sequence, and the id that ends a document.
LENGTH, END_ID = 1024, 2
#: Pieces that are packed together; the table has as many cells as it takes.
CELL_ROWS = 50_000
#: Documents that are encoded by one call of the library.
CALL = 64
#: Texts that both libraries cut alike: letters up to Latin Extended-B, and no run of these many
#: letters, signs or blanks, which the faster one takes quadratic time for.
SHARED = re.compile("[\\x00-\u024f]*")
RUN = re.compile(r"\S{400}|\s{400}")


class Encoder:
    """Ids of texts as the tokenizers library gives them for the file at ``path``.

    With ``ranks``, a file of the same vocabulary for the tiktoken library, which is some five
    times as fast, that one encodes the texts that both cut into the same words.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.fast = None
        if ranks and pattern:
            with open(ranks, "rb") as f:
                known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=known, special_tokens=special)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out, rest = [None] * len(texts), []
        for k, text in enumerate(texts):
            if self.fast and SHARED.fullmatch(text) and not RUN.search(text):
                out[k] = self.fast.encode_to_numpy(text, allowed_special="all")
            else:
                rest.append(k)
        if rest:
            for k, x in zip(rest, self.library.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False), strict=True):
                out[k] = np.array(x.ids, np.uint32)
        return out


def token_pieces(docs: DataFrame, path: str, ranks: str | None = None, pattern: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, ids`` for every row of ``docs (doc_id, text)``.

    A document is its ids by the tokenizer file at ``path`` (see ``Encoder``), then ``end_id``;
    null counts as empty. Documents above ``length`` are cut into pieces of that length, but
    for the first, which takes what is left over. ``ids`` are the piece's own; who does not
    need them should drop them at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path, ranks, pattern)
        for batch in slices(batches, "text", CALL):
            doc, piece, start, size, crc, ids = [], [], [], [], [], []
            for doc_id, x in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist()), strict=True):
                whole = np.append(x.astype("<u4"), np.array([end_id], "<u4"))
                first = len(whole) % length or length
                cuts = [0, *range(first, len(whole) + 1, length)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    doc.append(doc_id)
                    piece.append(k)
                    start.append(a)
                    size.append(b - a)
                    crc.append(zlib.crc32(whole[a:b].tobytes()))
                    ids.append(whole[a:b])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *size]), pa.int32()), pa.array(np.concatenate(ids).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64()), lists], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])
        del encode
        trim()

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>")


class OpenSequences:
    """Sequences with room, by their gap; a piece goes where the sum of squared counts becomes least.

    ``counts[g]`` open sequences have a gap of g. Placing a piece of s into one of them takes
    one from ``counts[g]`` and adds one to ``counts[g - s]``, unless that fills it; of the gaps
    that can take the piece, the one after which the sum of the squares is least is chosen, of
    equal ones the tightest. A new sequence is begun only if no open one can take the piece.
    """

    def __init__(self, length: int):
        self.length, self.counts, self.open, self.begun = length, np.zeros(length + 1, np.int64), [[] for _ in range(length + 1)], 0

    def place(self, size: int) -> tuple[int, int]:
        """The number of the sequence that takes a piece, and the place in it."""
        counts, length = self.counts, self.length
        change = counts[: length + 1 - size] - counts[size:]  # half of what the sum changes by, less one
        change = np.where(counts[size:] > 0, 2 * change + 2, 1 << 60)
        if counts[size]:
            change[0] = 1 - 2 * counts[size]  # full sequences are not open
        rest = int(change.argmin())
        if change[rest] < 1 << 60:
            gap = rest + size
            counts[gap] -= 1
            number = self.open[gap].pop()
        else:
            gap, rest, number = length, length - size, self.begun
            self.begun += 1
        if rest:
            counts[rest] += 1
            self.open[rest].append(number)
        return number, length - gap


def pack_pieces(pieces: DataFrame, length: int = LENGTH, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``pieces (doc_id, piece, start, length, ids_crc32)`` with ``sequence_id`` and ``offset``.

    ``pieces`` should be written. Full ones are sequences of their own. The others are dealt
    by a hash of their number into cells of about ``cell_rows``, however many there are, and
    each cell is packed by itself, longest pieces first: a task holds the open sequences
    of one cell. The sum-of-squares rule keeps sequences of all gaps open, so that shorter
    pieces find exact room.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, room = None, None
        for batch in batches:
            number, offset = [], []
            for c, size in zip(batch.column("cell").to_pylist(), batch.column("length").to_pylist(), strict=True):
                if c != cell:
                    cell, room = c, OpenSequences(length)
                n, at = room.place(size)
                number.append(c << 32 | n)
                offset.append(at)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(number, pa.int64()), pa.array(offset, pa.int64())], [*names, "sequence_id", "offset"])

    full = F.col("length") == length
    alone = pieces.where(full).select(*names, (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(~full)
    cells = max(1, -(-rest.count() // cell_rows))
    dealt = rest.withColumn("cell", F.pmod(F.xxhash64("uid"), F.lit(cells))).repartition(cells, "cell").sortWithinPartitions("cell", F.desc("length"), "uid")
    return alone.unionByName(dealt.select(*names, "cell").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"))


def pack_documents(docs: DataFrame, path: str, ranks: str | None = None, pattern: str | None = None, length: int = LENGTH) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every row of ``docs (doc_id, text)``.

    See ``token_pieces`` and ``pack_pieces``. Null and empty texts are one piece, the ending
    id. Rows are told apart by a number given when pieces are first written, so repeated
    rows and null doc_ids are documents of their own. Whole texts of any length are
    encoded. An empty table gives an empty result; other columns are ignored.
    """
    pieces = token_pieces(docs, path, ranks, pattern, length).drop("ids").withColumn("uid", F.monotonically_increasing_id())
    return pack_pieces(materialize(pieces, "pack-pieces"), length)
