"""Exact duplicates through log-structured merge indexes."""

from __future__ import annotations

import hashlib
import heapq
import pickle
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import fresh_path, materialize, slices

#: Bytes of a memtable before it is flushed as a run.
MEMTABLE_BYTES = 32 << 20
#: Runs of an index before they are compacted into one.
MOST_RUNS = 8
#: Entries that are read from a run at a time, and bytes of a block at most, or one entry.
BLOCK, BLOCK_BYTES = 64, 1 << 20
_SPACE = bytes(range(9, 14)) + b" "
Best = tuple  # (minus code points, no doc_id, doc_id, partition, place in it): the least is kept


def normalise(text: bytes | None) -> bytes:
    """The text without blanks and ASCII controls 9 to 13; null is empty."""
    return (text or b"").translate(None, _SPACE)


def sha256(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


class Filter:
    """Bloom filter over digests: ten bits a key, four probes."""

    def __init__(self, keys: list[bytes]):
        self.bits = max(64, 10 * len(keys))
        self.field = bytearray(self.bits // 8 + 1)
        for k in keys:
            for p in self._probes(k):
                self.field[p >> 3] |= 1 << (p & 7)

    def _probes(self, key: bytes) -> list[int]:
        a, b = int.from_bytes(key[:8], "big"), int.from_bytes(key[8:16], "big") | 1
        return [(a + i * b) % self.bits for i in range(4)]

    def __contains__(self, key: bytes) -> bool:
        return all(self.field[p >> 3] >> (p & 7) & 1 for p in self._probes(key))


@dataclass
class Entry:
    """Rows of one text. ``packed`` is the text, or None in a run if an older run holds it.

    ``variant`` tells texts apart that share a digest.
    """

    digest: bytes
    variant: int
    best: Best
    count: int
    packed: bytes | None
    fresh: bool = True  # whether this entry brings the text

    @property
    def key(self) -> tuple[bytes, int]:
        return self.digest, self.variant


def merged(runs: Iterable[Iterable[Entry]]) -> Iterator[Entry]:
    """Sorted runs as one: of entries for the same text the least identifier and the sum of rows."""
    last: Entry | None = None
    for e in heapq.merge(*runs, key=lambda e: e.key):
        if last is None or e.key != last.key:
            if last is not None:
                yield last
            last = Entry(e.digest, e.variant, e.best, e.count, e.packed, e.packed is not None)
        else:
            last.best, last.count = min(last.best, e.best), last.count + e.count
            if last.packed is None:
                last.packed, last.fresh = e.packed, e.packed is not None
    if last is not None:
        yield last


class Run:
    """An immutable file of sorted entries, in blocks; a filter and every block's first digest in memory."""

    def __init__(self, store: fs.FileSystem, path: str, entries: Iterable[Entry]):
        self.store, self.path = store, path
        self.first: list[bytes] = []
        self.at: list[tuple[int, int]] = []
        keys: list[bytes] = []
        with store.open_output_stream(path, compression=None) as out:
            block, held = [], 0

            def write() -> None:
                data = pickle.dumps([(e.digest, e.variant, e.best, e.count, e.packed if e.fresh else None) for e in block])
                self.first.append(block[0].digest)
                self.at.append((out.tell(), len(data)))
                out.write(data)

            for e in entries:
                # a digest never runs over the end of a block
                if block and (len(block) >= BLOCK or held > BLOCK_BYTES) and e.digest != block[-1].digest:
                    write()
                    block, held = [], 0
                block.append(e)
                held += len(e.packed or b"") if e.fresh else 0
                keys.append(e.digest)
            if block:
                write()
        self.bloom = Filter(keys)

    def _block(self, file: pa.NativeFile, k: int) -> list[Entry]:
        at, n = self.at[k]
        file.seek(at)
        return [Entry(*x, x[-1] is not None) for x in pickle.loads(file.read(n))]

    def find(self, digest: bytes) -> list[Entry]:
        k = bisect_right(self.first, digest) - 1
        if k < 0 or digest not in self.bloom:
            return []
        with self.store.open_input_file(self.path) as f:
            return [e for e in self._block(f, k) if e.digest == digest]

    def __iter__(self) -> Iterator[Entry]:
        with self.store.open_input_file(self.path) as f:
            for k in range(len(self.at)):
                yield from self._block(f, k)

    def delete(self) -> None:
        self.store.delete_file(self.path)


class Index:
    """Log-structured merge index from digest to entries, in bounded memory.

    New entries go to a memtable. When full it is flushed as a run, a file in ``folder``
    that never changes; more runs than ``most_runs`` are compacted into one, which keeps
    the smallest identifiers. A digest is looked up in the memtable, then in the runs
    whose filter has it; a hit is verified on the bytes, and a text that merely shares the
    digest becomes a further variant. A hit in a run adds an entry without text to the
    memtable, which a later compaction unites with the older one.
    """

    def __init__(self, folder: str, name: str, memtable_bytes: int = MEMTABLE_BYTES, most_runs: int = MOST_RUNS):
        self.limit, self.most_runs, self.name = memtable_bytes, most_runs, name
        self.folder = folder
        self.store: fs.FileSystem | None = None
        self.memtable: dict[bytes, list[Entry]] = {}
        self.size = self.number = 0
        self.runs: list[Run] = []

    def put(self, digest: bytes, plain: bytes, best: Best) -> Entry:
        """Add a row of a text; the entry it belongs to."""
        packed = zlib.compress(plain, 1)
        young = self.memtable.get(digest, [])
        for e in young:
            if e.packed == packed:
                e.best, e.count = min(e.best, best), e.count + 1
                return e
        known = len({e.variant for e in young})
        e = None
        if self.runs:
            old = [x for run in self.runs for x in run.find(digest)]
            known = len({x.variant for x in [*old, *young]})
            e = next((Entry(digest, x.variant, best, 1, packed, False) for x in old if x.packed == packed), None)
        e = e or Entry(digest, known, best, 1, packed)
        self.memtable.setdefault(digest, []).append(e)
        self.size += len(packed) + 400
        if self.size >= self.limit:
            self.flush()
        return e

    def _young(self) -> Iterator[Entry]:
        for k in sorted(self.memtable):
            yield from sorted(self.memtable[k], key=lambda e: e.variant)

    def _write(self, entries: Iterable[Entry]) -> Run:
        if self.store is None:
            self.store, base = fs.FileSystem.from_uri(self.folder)
            self.store.create_dir(base, recursive=True)
            self.base = base
        self.number += 1
        return Run(self.store, f"{self.base}/{self.name}-{self.number}", entries)

    def flush(self) -> None:
        self.runs.append(self._write(self._young()))
        self.memtable, self.size = {}, 0
        if len(self.runs) > self.most_runs:
            old = self.runs
            self.runs = [self._write(merged(old))]
            for r in old:
                r.delete()

    def entries(self) -> Iterator[Entry]:
        """All entries in the order of their digests, each with its text."""
        young = (Entry(e.digest, e.variant, e.best, e.count, e.packed if e.fresh else None) for e in self._young())
        return merged([*self.runs, young])

    def close(self) -> None:
        for r in self.runs:
            r.delete()
        self.runs = []


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    make = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
    for r in rows:
        held.append(r)
        size += 100 + (len(r[-1]) if isinstance(r[-1], bytes) else 0)
        if size >= most:
            yield make()
            held, size = [], 0
    if held:
        yield make()


_LOCAL = "row long, doc_id long, run int, place long, digest binary, variant int, chars long, count long, packed binary"
_LOCAL_ARROW = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("run", pa.int32()), ("place", pa.int64()), ("digest", pa.binary()), ("variant", pa.int32()), ("chars", pa.int64()), ("count", pa.int64()), ("packed", pa.binary())])


def _local(batches: Iterator[pa.RecordBatch], digest_of: Callable[[bytes], bytes], folder: str, memtable_bytes: int) -> Iterator[pa.RecordBatch]:
    """One index for each input partition. Gives a row for each document, without text, and
    one for each distinct text of the partition, with ``count`` and the row to keep."""
    context = TaskContext.get()
    run, place = context.partitionId(), 0
    index = Index(folder, f"{run}-{context.taskAttemptId()}", memtable_bytes)
    try:
        for batch in slices(batches, "text"):
            rows = []
            for row, doc_id, chars, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "chars", "text")), strict=True):
                plain = normalise(text)
                digest = digest_of(plain)
                e = index.put(digest, plain, (-chars, doc_id is None, doc_id or 0, run, place))
                rows.append((row, doc_id, run, place, digest, e.variant, None, None, None))
                place += 1
            yield from _batches(iter(rows), _LOCAL_ARROW)
        yield from _batches(((None, None if e.best[1] else e.best[2], run, e.best[4], e.digest, e.variant, -e.best[0], e.count, e.packed) for e in index.entries()), _LOCAL_ARROW)
    finally:
        index.close()


_MERGED = "run int, digest binary, variant int, keep_id long, group_size long, keep_run int, keep_place long"
_MERGED_ARROW = pa.schema([("run", pa.int32()), ("digest", pa.binary()), ("variant", pa.int32()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("keep_run", pa.int32()), ("keep_place", pa.int64())])


def _compacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of all input partitions, sorted by digest, as one stream: the last compaction.

    Held are the texts that share the digest at hand and, of each, the partitions it came from.
    """

    def answers() -> Iterator[tuple]:
        digest, texts = None, []
        for batch in slices(batches, "packed"):
            c = batch.to_pydict()
            for run, d, variant, best, count, packed in zip(c["run"], c["digest"], c["variant"], zip([-x for x in c["chars"]], [x is None for x in c["doc_id"]], [x or 0 for x in c["doc_id"]], c["run"], c["place"], strict=True), c["count"], c["packed"], strict=True):
                if d != digest:
                    yield from done(digest, texts)
                    digest, texts = d, []
                for t in texts:
                    if t[0] == packed:
                        t[1], t[2] = min(t[1], best), t[2] + count
                        t[3].append((run, variant))
                        break
                else:
                    texts.append([packed, best, count, [(run, variant)]])
        yield from done(digest, texts)

    def done(digest: bytes | None, texts: list) -> Iterator[tuple]:
        for _, best, count, members in texts:
            for run, variant in members:
                yield run, digest, variant, None if best[1] else best[2], count, best[3], best[4]

    yield from _batches(answers(), _MERGED_ARROW)


def exact_duplicates(docs: DataFrame, digest_of: Callable[[bytes], bytes] = sha256, row: str | None = None, memtable_bytes: int = MEMTABLE_BYTES) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs (doc_id, text)``.

    Texts are equal when identical without blanks and controls 9 to 13. Of equal texts
    one row stays: that with the most code points in the original text, then the least
    doc_id (null ids come last), and of rows that repeat both, one. Null counts as
    empty; empty texts are equal. Texts of any length are taken whole; other columns are
    ignored, but for ``row``, the name of a number of rows that is passed through.

    Each input partition fills an index of its own, so of a group of copies every
    partition sends on one entry. The entries are dealt by digest, sorted, and compacted
    as a stream, where each hit is verified on the bytes again. Documents get their
    answer by a join on (partition, digest, variant), which spreads a large group
    over as many keys as partitions hold it. ``digest_of`` is a parameter so that
    tests can make digests collide.
    """
    spark = docs.sparkSession
    folder = fresh_path(spark, "exact-index")
    rows = docs.select(
        (F.col(row).cast("long") if row else F.lit(None).cast("long")).alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"), F.col("text").cast("binary").alias("text"),
    )
    local = materialize(rows.mapInArrow(lambda it: _local(it, digest_of, folder, memtable_bytes), _LOCAL), "exact-runs")
    entries = local.where("count is not null").select("doc_id", "run", "place", "digest", "variant", "chars", "count", "packed")
    merged_runs = entries.repartition("digest").sortWithinPartitions("digest", "run", "variant").mapInArrow(_compacted, _MERGED)
    rows = local.where("count is null").select("row", "doc_id", "run", "place", "digest", "variant")
    out = rows.join(merged_runs, ["run", "digest", "variant"])
    kept = (F.col("run") == F.col("keep_run")) & (F.col("place") == F.col("keep_place"))
    return out.select(*(["row"] if row else []), "doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
