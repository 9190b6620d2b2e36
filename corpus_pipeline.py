"""A corpus from raw documents to token ids, through five operators.

Toxic documents go, then exact copies, then all but one document of each group of
near duplicates; the rest is mixed to target weights and encoded. Every stage works on
all that its predecessor kept. The two stages that drop copies number the rows first,
so that of rows with the same doc_id, or of repeated rows, one stays like of any others.
The stages bound the Arrow batches of the session, as several share one executor's memory.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm.bpe import encode_documents
from caseloom.llm.common import materialize, small_batches, table
from caseloom.llm.exact_dedup import exact_duplicates
from caseloom.llm.mixing import mix
from caseloom.llm.near_dedup import kept_rows
from caseloom.llm.toxicity import clean_documents, train


#: Number of a row within a stage; rows that repeat a doc_id, or repeat altogether, differ in it.
ROW = "_pipeline_row"


def _numbered(docs: DataFrame, stage: str) -> DataFrame:
    return materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), f"pipeline-{stage}-rows", "zstd")


def _only(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Numbered rows whose number is among ``kept``, by the same kind of join at every size."""
    return rows.join(kept.hint("merge"), ROW, "left_semi").drop(ROW)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it learns from their labelled rows."""
    small_batches(spark)
    return clean_documents(docs, train(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays: the longest original with the least doc_id."""
    rows = _numbered(docs, "exact")
    return _only(rows, exact_duplicates(rows, row=ROW).where("kept").select(F.col("row").alias(ROW)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays, that with the least doc_id."""
    rows = _numbered(docs, "near")
    return _only(rows, kept_rows(rows, ROW))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources want."""
    return mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` of each row; ids as an array."""
    small_batches(spark)
    coded = encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    ids = F.when(F.col("n_tokens") > 0, F.split("ids", " ").cast("array<int>")).otherwise(F.array().cast("array<int>"))
    return coded.select("doc_id", "n_tokens", ids.alias("ids"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("bpe", encoding)]

#: SQL can express neither the model, the merges nor the sketches; tests hold ``run`` to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
