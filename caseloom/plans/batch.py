"""Packets to rows: the batch, a single packet, and scoring of staged cases under a merged corpus state."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions.validate import date_of
from caseloom.operators import corpus
from caseloom.plans.adjudicate import adjudicate, context_of, finish
from caseloom.plans.assemble import PROMOTE, assemble, gather
from caseloom.sources import io
from caseloom.sources.stages import staged

BOXES = "case_id string, page int, box_idx int, text string, confidence double"
EXTRA = "case_id string, field string, value string, score double"
#: Adapters by what they give; the first has to be registered, the others may be.
READERS = {"spans": io.SPAN_SCHEMA, "reads": io.READ_SCHEMA, "boxes": BOXES, "extra": EXTRA}


def extract(files: DataFrame, lexicon: DataFrame, limit_s: float | None = io.PACKET_SECONDS, promote: frozenset[str] = PROMOTE) -> DataFrame:
    """Phase 1 of ``files (case_id, content)``: a row for each packet that could be read, see ``assemble``.

    Each registered reader sees a packet once, and what it gives is staged. A packet that any
    reader fails on, or spends more than ``limit_s`` on, is not in the result.
    """
    spark = files.sparkSession
    given, failed = {}, []
    for name, schema in READERS.items():
        if name == "spans" or name in io.ADAPTERS:
            rows = staged(io.decode(files, name, schema, limit_s), f"read-{name}")
            failed.append(rows.where("failure is not null").select("case_id"))
            given[name] = rows.drop("failure")
        else:
            given[name] = spark.createDataFrame([], schema)
    bad = failed[0]
    for more in failed[1:]:
        bad = bad.unionByName(more)
    bad = bad.distinct()
    good = {k: v.join(bad, "case_id", "left_anti") for k, v in given.items()}
    return assemble_rows(files.select("case_id").join(bad, "case_id", "left_anti"), good["spans"], good["reads"], good["boxes"], good["extra"], lexicon, promote)


def assemble_rows(cases: DataFrame, spans: DataFrame, reads: DataFrame, boxes: DataFrame, extra: DataFrame, lexicon: DataFrame, promote: frozenset[str] = PROMOTE) -> DataFrame:
    """``assemble`` of tables of spans, readings, boxes and a third reader's values."""
    found, page = gather(spans.where("text is not null"), reads.where("text is not null"))
    return assemble(cases, found, page, boxes.where("text is not null"), extra.where("value is not null"), lexicon, promote)


def score(inputs: DataFrame, cases: DataFrame, calibration: DataFrame, priors: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Phase 2: one output row for each of ``inputs (case_id)``, of assembled ``cases``.

    Under the corpus ``state``, by default that of the cases themselves. Rows of a part of a
    corpus, scored under the merged states of all its parts, are those of a run over all.
    """
    state = corpus.corpus_state(cases) if state is None else state
    decided = adjudicate(cases, calibration, known=context_of(state))
    return io.to_output(finish(inputs, decided, calibration, priors, state))


def alone(cases: DataFrame, calibration: DataFrame, reference_date: str | None = None) -> DataFrame:
    """Decided cases without a corpus: no year is repaired, no sponsor is an outlier, and staleness is
    unknown unless a ``reference_date`` is given."""
    known = date_of(F.lit(reference_date)) if reference_date else F.lit(None).cast("date")
    return adjudicate(cases, calibration, known=context_of(corpus.corpus_state(cases.limit(0))).withColumn("reference_date", known))


def single(cases: DataFrame, calibration: DataFrame, priors: DataFrame, reference_date: str | None = None) -> DataFrame:
    """Output rows of cases that are scored ``alone``."""
    return io.to_output(finish(cases.select("case_id"), alone(cases, calibration, reference_date), calibration, priors, corpus.corpus_state(cases.limit(0))))


def run(spark: SparkSession, folder: str, out: str, lexicon: DataFrame, calibration: DataFrame, priors: DataFrame, limit: int | None = None, limit_s: float | None = io.PACKET_SECONDS) -> int:
    """Read the packets of a folder, write one JSON line for each, in the order of their paths; 0, or 1 if there are none."""
    files = io.packets(spark, folder, limit)
    inputs = files.select("case_id", "path")
    if not inputs.limit(1).count():
        spark.createDataFrame([], "value string").write.mode("overwrite").text(out)
        return 1
    cases = staged(extract(files, lexicon, limit_s), "cases")
    rows = score(inputs, cases, calibration, priors).join(inputs, "case_id")
    io.write_json_lines(rows, out, order="path", drop=("path",))
    return 0


def main(argv: list[str] | None = None) -> int:
    """``python -m caseloom.plans.batch FOLDER OUT --lexicon FILE --calibration FILE``; a module given by
    ``--adapters`` registers the readers when it is imported."""
    import importlib

    parser = argparse.ArgumentParser(description=main.__doc__)
    parser.add_argument("folder")
    parser.add_argument("out")
    parser.add_argument("--lexicon", required=True)
    parser.add_argument("--calibration", required=True)
    parser.add_argument("--adapters", required=True)
    parser.add_argument("--limit", type=int)
    parser.add_argument("--seconds", type=float, default=io.PACKET_SECONDS)
    args = parser.parse_args(argv)
    importlib.import_module(args.adapters)
    spark = SparkSession.builder.getOrCreate()
    return run(spark, args.folder, args.out, io.lexicon(spark, args.lexicon), io.calibration(spark, args.calibration), io.prior_modes(spark, args.lexicon), args.limit, args.seconds)


if __name__ == "__main__":
    sys.exit(main())
