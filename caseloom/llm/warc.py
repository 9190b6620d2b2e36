"""WARC archives: a writer with one gzip member a record, and a splittable reader."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm.common import fresh_path, join_groups, materialize, slices

#: An archive is closed and the next begun beyond this size.
ARCHIVE_BYTES = 1 << 30
#: Least bytes of an archive that one reading task owns.
SPLIT_BYTES = 8 << 20
#: Reading tasks at most; beyond, each owns more bytes.
MOST_SPLITS = 100_000
_CHUNK = 1 << 20
_MAGIC = b"\x1f\x8b\x08"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2000-01-01T00:00:00Z"  # a fixed capture time, so that reruns write the same bytes
_PAGE = re.compile(rb"<urn:page:(-?\d+)>")


def _open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    """One WARC record: a response, or without payload a revisit of page ``refers_to``."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._' + chr(39))}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse(data: bytes) -> dict:
    """Fields of one decompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    named = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines[1:])}
    block = rest[: int(named[b"content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next((int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    page = lambda k: int(m[1]) if (m := _PAGE.match(named.get(k, b""))) else None
    kind = named[b"warc-type"].decode()
    digest = named.get(b"warc-payload-digest", b"").decode().removeprefix("sha1:")
    if kind == "response":
        if payload_digest(payload) != digest or length != len(payload):
            raise ValueError(f"damaged record {named.get(b'warc-record-id')!r}")
    return {
        "page_id": page(b"warc-record-id"),
        "url": named[b"warc-target-uri"].decode() if b"warc-target-uri" in named else None,
        "record_type": kind,
        "payload": payload if kind == "response" else None,
        "payload_bytes": length,
        "payload_digest": digest,
        "refers_to": page(b"warc-refers-to"),
    }


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write a record for every row of ``pages (page_id, url, html)``; ``path, size`` of the archives.

    The payload is the html in UTF-8, null as empty. Of records with equal payloads
    of ``least_bytes`` or more, that with the largest page_id is the response and the
    others revisit it; rows that repeat this page_id are responses too. Rows without
    page_id are responses where no row of their group has one. Payloads are equal when
    their length and SHA-256 are: the record's own digest, SHA-1, is known to be forged
    with equal lengths, so it decides nothing. The copies of one payload, empty pages for
    one, are spread over all tasks; where the table of copied payloads is small the
    planner broadcasts it and no payload moves.
    An attempt writes under a name of its own and renames at its end, so lost or doubled
    tasks leave one whole archive of each partition. Payloads of any length are written
    whole; a task holds a bounded slice of them, or one.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("same", F.concat(F.sha2("payload", 256), F.lit("-"), F.length("payload").cast("string")))
    groups = rows.groupBy("same").agg(F.max("page_id").alias("latest"), F.count(F.lit(1)).alias("n")).where("n > 1 and latest is not null")
    groups = materialize(groups, "warc-copies")
    revisit = (F.length("payload") >= least_bytes) & F.col("latest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("latest"))
    joined = join_groups(rows, groups, ["same"], "n", pages.count(), "left")
    rows = joined.select("page_id", "url", "payload", F.when(revisit, F.col("latest")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, base = _open_fs(folder)
        store.create_dir(base, recursive=True)
        done, out, number = [], None, 0

        def close() -> None:
            nonlocal out
            if out is not None:
                size = out.tell()
                out.close()
                final = f"part-{context.partitionId():06d}-{number:04d}.warc.gz"
                store.move(f"{base}/{attempt}", f"{base}/{final}")
                done.append((f"{folder}/{final}", size))
                out = None

        for batch in slices(batches, "payload"):
            for page_id, url, payload, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                if out is None:
                    number += 1
                    attempt = f"_attempt-{context.taskAttemptId()}-{number}"
                    out = store.open_output_stream(f"{base}/{attempt}", compression=None)
                out.write(member(record(page_id, url, payload, refers, payload_digest(payload))))
                if out.tell() >= ARCHIVE_BYTES:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["path", "size"])

    return materialize(rows.mapInArrow(run, "path string, size long"), "warc-archives")


class _Window:
    """Bytes of a file from any offset, read piece by piece."""

    def __init__(self, file: pa.NativeFile, size: int):
        self.file, self.size = file, size

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(min(n, max(0, self.size - at)))


def _member_at(window: _Window, at: int) -> tuple[bytes, int] | None:
    """The record in the gzip member at an offset and where the member ends; None if there is none.

    The candidate must decompress, begin with a WARC version and keep its checksum.
    """
    z, parts, where, begun = zlib.decompressobj(31), [], at, False
    while not z.eof:
        chunk = window.read(where, _CHUNK if begun else 4096)
        if not chunk:
            return None
        try:
            parts.append(z.decompress(chunk))
        except zlib.error:
            return None
        where += len(chunk)
        if not begun and (sum(map(len, parts)) >= 7 or z.eof):
            if not b"".join(parts).startswith(b"WARC/1."):
                return None
            begun = True
    return b"".join(parts), where - len(z.unused_data)


def records_in(window: _Window, start: int, end: int) -> Iterator[dict]:
    """Records whose member starts at an offset from ``start`` to before ``end``, read to their own end."""
    at = start
    while at < end:
        chunk = window.read(at, min(_CHUNK, end - at) + 2)
        found = chunk.find(_MAGIC)
        if found < 0 or at + found >= end:
            at += max(1, len(chunk) - 2) if chunk else end
            continue
        at += found
        got = _member_at(window, at)
        if got is None:
            at += 1
            continue
        yield parse(got[0])
        at = got[1]


_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])


def read_archives(archives: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of ``archives (path, size)``, wherever they are split.

    Each archive is cut into byte ranges, and there are as many partitions as ranges, so
    that each is a task of its own. A task looks for gzip magic in its range, takes a
    candidate only if it decodes to a WARC header, and owns the records that start
    inside, so every record is read by exactly one task. Empty and null archives give
    nothing; a record with a wrong digest or length raises.
    """
    archives = archives.where("size > 0").select("path", "size")
    cuts = lambda size: F.sum(F.ceil(F.col("size") / size))
    total = archives.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()["bytes"]
    split_bytes = max(split_bytes, total // MOST_SPLITS)
    tasks = int(archives.agg(F.coalesce(cuts(split_bytes), F.lit(0)).alias("n")).first()["n"])
    ranges = archives.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                store, path = _open_fs(r["path"])
                with store.open_input_file(path) as f:
                    held, size = [], 0
                    for x in records_in(_Window(f, r["size"]), r["start"], min(r["size"], r["start"] + split_bytes)):
                        held.append(x)
                        size += len(x["payload"] or b"") + 200
                        if size >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema=_RECORD)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema=_RECORD)

    schema = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"
    return ranges.repartition(max(1, tasks)).mapInArrow(run, schema)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back."""
    return read_archives(write_archives(pages, fresh_path(spark, "warc")))
