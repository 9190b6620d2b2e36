"""Sources and sinks: packets, vocabularies, labels, predictions, staged extractions."""

from __future__ import annotations

import signal
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN_SCHEMA = (
    "case_id string, page int, span_idx int, text string, bbox struct<x0: double, y0: double, x1: double, y1: double>, visible_rect struct<x0: double, y0: double, x1: double, y1: double>, "
    "font string, size double, color int, alpha int, page_rotation int, dir_y double"
)
READ_SCHEMA = "case_id string, page int, engine string, read_idx int, text string"
OUTPUT = ("adjudication", "applicant_name", "arrival_date", "case_id", "confidence", "declared_purpose", "fee_status", "home_world", "risk_flags", "species_code", "sponsor_id", "visa_class")

#: Seconds that the decoding of one packet may take.
PACKET_SECONDS = 55.0
#: Decoders of documents by name. None is built in: they need libraries of their own.
ADAPTERS: dict[str, Callable[[str, bytes], list[dict]]] = {}


def register_adapter(name: str, decode: Callable[[str, bytes], list[dict]]) -> None:
    """Make a decoder known: from case id and content to rows of the schema it is used with."""
    ADAPTERS[name] = decode


def packets(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """``case_id, path, content`` of the PDF files of a folder, without its subfolders; with a limit the first by path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "false").load(folder)
    files = files.select(F.regexp_extract("path", r"([^/]+)\.pdf$", 1).alias("case_id"), "path", "content")
    return files.orderBy("path").limit(limit) if limit is not None else files


class Overrun(Exception):
    """A packet took longer than it may."""


@contextmanager
def deadline(seconds: float | None) -> Iterator[None]:
    """Whatever runs within raises ``Overrun`` after so many seconds.

    By the alarm signal, which reaches the main thread of a worker, where Spark runs its
    functions; elsewhere, or without a limit, nothing is limited. Native code is left when it
    next returns to Python.
    """
    if seconds is None or threading.current_thread() is not threading.main_thread():
        yield
        return

    def ring(number, frame):
        raise Overrun(f"exceeded {seconds:g}s")

    before = signal.signal(signal.SIGALRM, ring)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def decode(files: DataFrame, adapter: str, schema: str = SPAN_SCHEMA, limit_s: float | None = PACKET_SECONDS) -> DataFrame:
    """Rows of an adapter for each packet, with ``failure``.

    A packet that fails, or takes longer than ``limit_s``, gives one row with its case and
    the reason, and nothing else: nothing that it gave before counts. One that holds
    nothing gives one row without reason. Others never notice.
    """
    if adapter not in ADAPTERS:
        raise LookupError(f"no adapter {adapter!r} is registered")
    run = ADAPTERS[adapter]
    names = [f.name for f in files.sparkSession.createDataFrame([], schema).schema]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for case_id, content in zip(batch["case_id"], batch["content"], strict=True):
                try:
                    with deadline(limit_s):
                        rows = list(run(case_id, content))
                    failure = None
                except Exception as e:  # a damaged document is data, not an error of the job
                    rows, failure = [], f"{type(e).__name__}: {e}"
                rows = rows or [{"case_id": case_id}]
                yield pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype="object") for n in names} | {"failure": pd.Series([failure] * len(rows), dtype="object")})

    return files.select("case_id", "content").mapInPandas(each, f"{schema}, failure string")


def json_object(spark: SparkSession, path: str, value: str) -> DataFrame:
    """``key, value`` of a JSON file that holds one object; ``value`` is the DDL of its values."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string, {value}>")).alias("key", "value"))


def _lexicon_entries(spark: SparkSession, path: str) -> DataFrame:
    """``field, entry``: the named parts of a lexicon file as JSON text; its remarks begin with an underscore."""
    text = spark.read.text(path, wholetext=True).select("value", F.explode(F.json_object_keys("value")).alias("field"))
    return text.where(~F.startswith("field", F.lit("_"))).select("field", F.expr("get_json_object(value, concat('$.', field))").alias("entry"))


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """``field, idx, value`` of a lexicon file: of each field the list itself, or the ``values`` of an object.

    First and last tokens of names are the fields ``first_name`` and ``last_name``; flags of all
    classes are the field ``risk_flag``.
    """
    listed = lambda c: F.from_json(c, "array<string>")
    part = lambda key: listed(F.get_json_object("entry", f"$.{key}"))
    classes = F.filter(F.array(part("disqualifying"), part("review_only")), lambda x: x.isNotNull())
    whole = F.when(F.startswith(F.ltrim("entry"), F.lit("[")), listed(F.col("entry"))).otherwise(F.coalesce(part("values"), F.when(F.size(classes) > 0, F.flatten(classes))))
    e = _lexicon_entries(spark, path)
    lists = e.select(F.explode(F.array(F.struct(F.when(F.col("field") == "risk_flags", F.lit("risk_flag")).otherwise(F.col("field")).alias("field"), whole.alias("v")), F.struct(F.lit("first_name").alias("field"), part("first_tokens").alias("v")), F.struct(F.lit("last_name").alias("field"), part("last_tokens").alias("v")))).alias("x"))
    return lists.select("x.field", F.posexplode("x.v").alias("idx", "value"))


def prior_modes(spark: SparkSession, path: str) -> DataFrame:
    """``field, mode`` of a lexicon file: the commonest value of each field."""
    return _lexicon_entries(spark, path).select("field", F.get_json_object("entry", "$.prior_mode").alias("mode")).where("mode is not null")


def calibration(spark: SparkSession, path: str) -> DataFrame:
    """``path, p_approved, p_denied, p_review, support, accuracy`` of a calibration artefact.

    Paths stand in its object ``paths``, how many records each was fitted on in ``_support``, how
    often evidence that decides by itself is right in ``accuracies``; the global prior
    ``fallback`` becomes the path ``*``. What the file lacks is null, or no row.
    """
    text = spark.read.text(path, wholetext=True)
    doc = F.from_json("value", "paths map<string, map<string, double>>, fallback map<string, double>, _support map<string, bigint>, accuracies map<string, double>")
    one = text.select(doc.alias("d")).select("d.*")
    rows = one.select("_support", "accuracies", F.explode(F.map_concat(F.coalesce("paths", F.create_map().cast("map<string, map<string, double>>")), F.when(F.col("fallback").isNotNull(), F.create_map(F.lit("*"), F.col("fallback"))).otherwise(F.create_map().cast("map<string, map<string, double>>")))).alias("path", "p"))
    names = (("APPROVED", "p_approved"), ("DENIED", "p_denied"), ("NEEDS_REVIEW", "p_review"))
    return rows.select("path", *[F.col("p")[k].alias(n) for k, n in names], F.col("_support")[F.col("path")].alias("support"), F.col("accuracies")[F.col("path")].alias("accuracy"))


def write_calibration(table: DataFrame, path: str) -> None:
    """The artefact that ``calibration`` reads, as one JSON object with sorted keys: paths are as few as rules."""
    named = F.struct(F.round("p_approved", 6).alias("APPROVED"), F.round("p_denied", 6).alias("DENIED"), F.round("p_review", 6).alias("NEEDS_REVIEW"))
    rows = table.select("path", named.alias("p"), *[F.col(c) if c in table.columns else F.lit(None).cast(k).alias(c) for c, k in (("support", "long"), ("accuracy", "double"))])
    mapped = lambda value, on: F.map_from_entries(F.array_sort(F.collect_list(F.when(on, F.struct("path", value)))))
    one = rows.agg(
        mapped(F.col("support"), (F.col("path") != "*") & F.col("support").isNotNull()).alias("_support"), mapped(F.col("accuracy"), F.col("accuracy").isNotNull()).alias("accuracies"),
        F.max(F.when(F.col("path") == "*", F.col("p"))).alias("fallback"), mapped(F.col("p"), F.col("path") != "*").alias("paths"),
    )
    one.select(F.to_json(F.struct("_support", "accuracies", "fallback", "paths")).alias("value")).write.mode("overwrite").text(path)


def labels(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header; values trimmed, all as text."""
    df = spark.read.csv(path, header=True)
    return df.select(*[F.trim(c).alias(c.strip()) for c in df.columns])


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def round_half(c: Column, places: int = 4) -> Column:
    """Rounded from the exact decimal digits of the double, half to even."""
    return F.bround(c, places)


def to_output(df: DataFrame) -> DataFrame:
    """The output row: fixed columns in alphabetical order, confidence to four places."""
    return df.select(*[round_half(F.col(c)).alias(c) if c == "confidence" else F.col(c).cast("string").alias(c) for c in OUTPUT])


def write_json_lines(df: DataFrame, path: str, order: str = "case_id", drop: tuple[str, ...] = ()) -> None:
    """One object a line, keys sorted, rows in order, without the columns ``drop``. A global sort in
    parts, whose file names keep the order, so no single task writes everything."""
    kept = sorted(c for c in df.columns if c not in drop)
    df.orderBy(order).select(F.to_json(F.struct(*kept), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def stage(df: DataFrame, path: str, fingerprint: str) -> DataFrame:
    """Write a staged extraction with the fingerprint of what made it, and read it back."""
    df.withColumn("_fingerprint", F.lit(fingerprint)).write.mode("overwrite").parquet(path)
    return load_stage(df.sparkSession, path, fingerprint)[0]


def load_stage(spark: SparkSession, path: str, fingerprint: str) -> tuple[DataFrame, bool]:
    """A staged extraction, and whether it is stale."""
    df = spark.read.parquet(path)
    stale = df.where(F.col("_fingerprint") != fingerprint).limit(1).count() > 0
    return df.drop("_fingerprint"), stale


def row_fingerprint(columns: list[str]) -> Column:
    """SHA-256 of a row as JSON, with its columns in alphabetical order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def tree_digest(files: DataFrame) -> DataFrame:
    """``path, depth, digest``: SHA-256 of every file ``(path, content)`` and of every folder above it, up to the root, ``""``.

    A folder's digest is that of its children's names and digests, in order. So a changed file
    changes the digests on its way to the root, and no others. Levels are worked off from
    the deepest; a level holds a row for each file or folder in it.
    """
    clean = F.regexp_replace(F.regexp_replace("path", "/+", "/"), "^/|/$", "")
    parts = F.split(clean, "/")
    leaves = files.select(clean.alias("path"), F.size(parts).alias("depth"), F.sha2("content", 256).alias("digest"))
    deepest = leaves.agg(F.max("depth")).first()[0] or 0  # one number
    level = leaves.where(F.col("depth") == deepest)
    out = level
    for depth in range(deepest - 1, -1, -1):
        parent = F.when(F.lit(depth) == 0, F.lit("")).otherwise(F.substring_index("path", "/", depth))
        child = F.struct(F.substring_index("path", "/", -1).alias("name"), "digest")
        lines = F.transform(F.array_sort(F.collect_list(child)), lambda x: F.concat_ws(" ", x["digest"], x["name"]))
        folders = level.groupBy(parent.alias("path")).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("digest"))
        level = folders.select("path", F.lit(depth).alias("depth"), "digest").unionByName(leaves.where(F.col("depth") == depth)) if depth else folders.select("path", F.lit(0).alias("depth"), "digest")
        out = out.unionByName(level)
    return out


def write_json(df: DataFrame, path: str) -> None:
    """A report of few rows as JSON lines with sorted keys."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows that a seed picks, the same in every run."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)
