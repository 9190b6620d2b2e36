from pyspark.sql import functions as F

from caseloom.operators.notes import note_findings, reason_facts
from caseloom.sources.io import sample_rows


def test_findings_in_order_of_evidence(spark):
    reads = [
        ("a", 1, 0, "Finding: DENIFD. Reason: Transit class is out.\nmore"), ("b", 1, 0, "Findlng; APPROVED by hand"), ("c", 1, 0, "seen: Denial supported by record"),
        ("d", 1, 0, "SAMPLE denial supported"), ("e", 1, 0, "clean or exception; denial supported"), ("f", 1, 0, "revoked sponsor"), ("g", 1, 0, "Reason: revoked sponsor"), ("a", 1, 1, "Finding: APPROVED. Reason: x"),
    ]
    got = {r["case_id"]: (r["finding"], r["reason"]) for r in note_findings(spark.createDataFrame(reads, "case_id string, page int, read_idx int, text string")).collect()}
    assert got == {"a": ("DENIED", "Transit class is out.\nmore"), "b": ("APPROVED", ""), "c": ("DENIED", ""), "g": ("DENIED", "")}


def test_reason_facts(spark):
    df = spark.createDataFrame([("Mandatory fee unpaid.",), ("Embargo home world: Eris Relay.",), ("SAMPLE mandatory fee unpaid",)], "t string")
    got = [tuple(r["x"]) for r in df.select(reason_facts(F.col("t")).alias("x")).collect()]
    assert got == [("unpaid", None), (None, "Eris Relay"), (None, None)]


def test_seeded_sample(spark):
    pick = lambda: [r["id"] for r in sample_rows(spark.range(100), "id", 5, 3).collect()]
    assert pick() == pick() and len(pick()) == 5
