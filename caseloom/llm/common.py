"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: the blank and the five ASCII controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes of text that a Python worker holds at a time; a longer text stands alone.
SLICE_ROWS, SLICE_BYTES = 1000, 4 << 20
#: Groups above the n-th part of all rows are hot. There are fewer than n of them.
HOT = 1000


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none (as in tests) a temporary folder is set,
    which goes when the process ends.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    have = spark.sparkContext._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return str(have.get()).rstrip("/")
    path = tempfile.mkdtemp(prefix="caseloom-")
    atexit.register(shutil.rmtree, path, True)
    spark.sparkContext.setCheckpointDir(f"file://{path}")
    return str(spark.sparkContext._jsc.sc().getCheckpointDir().get()).rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/caseloom/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession, rows: int = SLICE_ROWS) -> None:
    """Bound the session's Arrow batches from here on, never raising its bound: for plans that
    are returned and run later."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


@contextmanager
def bounded_batches(spark: SparkSession, rows: int = SLICE_ROWS) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for what runs within; the session's own setting comes back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if int(before) <= 0 or int(before) > rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def trim() -> None:
    """Give the memory that a Python worker has freed back to the system, where its C library can."""
    gc.collect()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    This cuts the lineage: what was written survives the loss of executors, and
    later reads prune columns, which ``checkpoint()`` cannot. Python workers get small
    batches meanwhile.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with bounded_batches(spark):
        df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterable[pa.RecordBatch], column: str, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in pieces, without copying: at most ``rows`` rows and ``size``
    bytes of ``column`` in each, or one row. Empty batches give nothing."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, held = 0, 0
        for k, n in enumerate(lengths):
            if k > start and (k - start >= rows or held + n > size):
                yield batch.slice(start, k - start)
                start, held = k, 0
            held += n
        if len(lengths) > start:
            yield batch.slice(start)


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], n: str, total: int, how: str = "inner", alike: bool = False) -> DataFrame:
    """``rows`` with the columns of their group, however large single groups are.

    ``groups`` has a row for each group, with ``n`` rows of it, and should be written;
    ``total`` is the number of all rows. Hot groups, those above a thousandth of all rows
    and hence fewer than ``HOT``, are broadcast and their rows stay where they are; only the
    others are shuffled by ``keys``, which are never null. With ``alike`` they are at every
    size, where the planner would broadcast small tables of groups.
    """
    cold = (lambda g: g.hint("merge")) if alike else (lambda g: g)
    h = F.xxhash64(*keys)
    hot = [r[0] for r in groups.where(F.col(n) * HOT > total).select(h).distinct().collect()]
    if not hot:
        return rows.join(cold(groups), keys, how)
    out = rows.where(h.isin(hot)).join(F.broadcast(groups.where(h.isin(hot))), keys, how)
    return out.unionByName(rows.where(~h.isin(hot)).join(cold(groups.where(~h.isin(hot))), keys, how))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
