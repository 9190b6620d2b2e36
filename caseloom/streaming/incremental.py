"""Incremental phase 1: spans and readings become observations as they arrive, in any order.

Phase 2 stays a batch job over the observation table: its statistics need the closed
corpus, and windows would change them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from caseloom.operators.layout import observe
from caseloom.sources.io import READ_SCHEMA, SPAN_SCHEMA

#: Parts of the state, by a hash of the case; a batch rewrites the observations of the parts that it touches.
BUCKETS = 64


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("case_id"), F.lit(buckets)).cast("int")


def _collect(stream: DataFrame, name: str, out_dir: str, checkpoint_dir: str, buckets: int) -> StreamingQuery:
    """Keep what arrives, by the bucket of its case. The batch number names the files, so a batch that
    is run again after a failure replaces its own."""

    def each(batch: DataFrame, number: int) -> None:
        batch.withColumn("bucket", _bucket(buckets)).withColumn("batch", F.lit(number)).write.partitionBy("batch", "bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{out_dir}/{name}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{checkpoint_dir}/{name}").trigger(availableNow=True).start()


def _kept(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, batch int, bucket int").parquet(folder)


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def refresh(spark: SparkSession, out_dir: str, seen: dict[str, int], buckets: int = BUCKETS) -> dict[str, int]:
    """Rewrite the observations of the buckets that got spans or readings after the batches ``seen``.

    A late reading waits for nothing: it makes its bucket be read again, with all spans and readings that
    its cases have had so far. Gives the batches that are in the result.
    """
    inputs = {"spans": SPAN_SCHEMA, "reads": READ_SCHEMA}
    have = {k: _kept(spark, f"{out_dir}/{k}", s) if _exists(spark, f"{out_dir}/{k}") else spark.createDataFrame([], f"{s}, batch int, bucket int") for k, s in inputs.items()}
    fresh = {k: df.where(F.col("batch") > seen.get(k, -1)).select("batch", "bucket").distinct().collect() for k, df in have.items()}  # files' names only
    touched = sorted({r["bucket"] for rows in fresh.values() for r in rows})
    if touched:
        mine = {k: df.where(F.col("bucket").isin(touched)).drop("batch", "bucket") for k, df in have.items()}
        obs, damaged, _ = observe(mine["spans"], mine["reads"])
        for name, df in (("observations", obs), ("damaged", damaged)):
            df.withColumn("bucket", _bucket(buckets)).write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{out_dir}/{name}")
    return {k: max([seen.get(k, -1), *[r["batch"] for r in rows]]) for k, rows in fresh.items()}


def ingest(spark: SparkSession, spans_dir: str, reads_dir: str, out_dir: str, checkpoint_dir: str, seen: dict[str, int] | None = None, buckets: int = BUCKETS, on_done: Callable[[dict[str, int]], None] | None = None) -> dict[str, int]:
    """Take all files of spans and readings that came since the last run, then ``refresh``.

    Spans of a page arrive together; its readings may come before or after them, and in any number
    of files. The result is that of a batch over all files, whatever the order.
    """
    sources = {"spans": (spans_dir, SPAN_SCHEMA), "reads": (reads_dir, READ_SCHEMA)}
    for name, (folder, schema) in sources.items():
        _collect(spark.readStream.schema(schema).parquet(folder), name, out_dir, checkpoint_dir, buckets).awaitTermination()
    done = refresh(spark, out_dir, seen or {}, buckets)
    if on_done:
        on_done(done)
    return done
