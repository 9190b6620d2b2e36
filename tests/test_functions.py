import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caseloom.functions import policy as P
from caseloom.functions import text as T
from caseloom.functions import validate as V
from caseloom.functions.distance import PLAIN, SCAN, distance, weighted_distance


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (T.canon, "Sol-III b", "soliiib"),
        (T.clean, "  a   b\n", "a b"),
        (T.non_evidentiary, "barcode 12: x", True),
        (T.non_evidentiary, "code: x", False),
        (T.page_kind, "FORM B-13 rev 2", "biometric"),
        (T.page_kind, None, "unknown"),
        (T.damaged_fields, "x [VISA CLASS TORN] [NEVER HEARD]", ["visa_class"]),
        (T.flags, "b| a|none||a", ["a", "b"]),
        (T.money, "$1,809.50", 1809.5),
        (T.money, "none", None),
        (T.digits, "2O2b", None),
        (T.digits, "2O2l", "2021"),
        (T.mine_sponsors, "see SPN-4O4O and SPN 12", ["SPN-4040"]),
        (T.mine_dates, "on 2O26-02-31, not 1999-01-01 or 2026-13-01", ["2026-02-31"]),
        (T.mine_flags, "active_warrant and biohazard_red.", ["active_warrant", "biohazard_red"]),
        (T.strip_debris, "  Mars Colony | ", "Mars Colony"),
        (T.flag_string, None, None),
        (V.valid_date, "2026-02-30", False),
        (V.valid_date, "2026-2-3", False),
        (V.valid_date, "1999-12-31", False),
        (V.valid_date, "2026-02-03", True),
        (V.valid_sponsor, "SPN-00071", False),
        (V.looks_damaged, "[torn", True),
        (V.looks_damaged, "Mars", False),
        (V.looks_damaged, "a......", True),
    ],
)
def test_expressions(spark, f, value, want):
    if f is T.flag_string:
        got = spark.range(1).select(T.flag_string(F.array().cast("array<string>")).alias("x")).first()["x"]
        assert got == "none"
    else:
        assert one(spark, value, f) == want


def test_fee_needs_both_halves(spark):
    rows = [("$809.00", "none"), ("$0.00", "HW-1"), ("$0.00", "N/A"), ("$5", "HW-1"), (None, None)]
    df = spark.createDataFrame(rows, "a string, w string").select(T.fee_of(F.col("a"), F.col("w")).alias("x"))
    assert [r["x"] for r in df.collect()] == ["paid", "waived", None, None, None]


def test_visibility(spark):
    box = "struct<x0: double, y0: double, x1: double, y1: double>"
    rows = [(0, 0, (0.0, 0.0, 1.0, 1.0)), (255, 0xFFFFFF, (0.0, 0.0, 1.0, 1.0)), (255, 0, (50.0, 0.0, 60.0, 1.0)), (255, 0, (0.0, 0.0, 1.0, 1.0))]
    df = spark.createDataFrame(rows, f"alpha int, color int, bbox {box}").withColumn("v", F.struct(*[F.lit(x).alias(n) for n, x in (("x0", 0.0), ("y0", 0.0), ("x1", 10.0), ("y1", 10.0))]))
    got = [r["x"] for r in df.select(T.hide_reasons(F.col("alpha"), F.col("color"), F.col("bbox"), F.col("v")).alias("x")).collect()]
    assert got == [["invisible"], ["white"], ["offcrop"], []]


def test_watermark_only_poisons_what_is_near(spark):
    pattern = r"(?i)denial supported"
    assert one(spark, "SAMPLE denial supported", lambda c: T.near_mark(c, pattern))
    assert not one(spark, "SAMPLE" + " " * 80 + "denial supported", lambda c: T.near_mark(c, pattern))


def test_attestation_and_correction(spark):
    text = "Sponsor SPN-1234 attests that Ada Bel is expected on Earth for trade.\nThis is class XW-1 compliance."
    got = one(spark, text, T.attestation)
    assert (got["sponsor"], got["applicant"], got["purpose"], got["visa"]) == ("SPN-1234", "Ada Bel", "trade", "XW-1")
    from caseloom.operators.layout import SUBJECTS

    assert one(spark, "Manual correction: visa class is MED-3.", lambda c: T.correction(c, SUBJECTS)).asDict() == {"field": "visa_class", "value": "MED-3"}
    assert one(spark, "nothing here", lambda c: T.correction(c, SUBJECTS)) is None


RECORD = {"visa": "XW-1", "sponsor": "SPN-1", "fee": "paid", "flags": [], "stale": False, "arrival": "2026-01-01", "arrival_untrusted": False, "hardship": False, "diplomatic": False, "revoked": False, "flags_known": True, "scanned": False, "injection": False}


@pytest.mark.parametrize(
    ("change", "path"),
    [
        ({}, "clean"),
        ({"visa": "TRANSIT-7", "flags": ["biohazard_red"]}, "transit_7"),
        ({"flags": ["biohazard_red"], "fee": "unpaid"}, "disqualifying_flag"),
        ({"fee": "unpaid"}, "fee_unpaid"),
        ({"fee": "unpaid", "hardship": True}, "clean"),
        ({"revoked": True}, "sponsor_revoked"),
        ({"revoked": True, "visa": "DIP-1"}, "clean"),
        ({"revoked": True, "visa": None}, "visa_unknown"),
        ({"flags": ["identity_conflict"]}, "review_flags"),
        ({"flags": ["identity_conflict", "sponsor_mismatch"]}, "review_flags_multi"),
        ({"fee": "waived"}, "fee_waived_unjustified"),
        ({"fee": "unknown"}, "fee_stated_unknown"),
        ({"fee": None}, "fee_unknown"),
        ({"stale": True}, "stale_arrival"),
        ({"stale": True, "visa": "DIP-1", "diplomatic": True}, "stale_dip_exempt"),
        ({"arrival_untrusted": True}, "arrival_date_untrusted"),
        ({"stale": True, "arrival_untrusted": True}, "stale_arrival"),
        ({"arrival": None, "stale": None}, "arrival_date_untrusted"),
        ({"sponsor": None}, "sponsor_unknown"),
        ({"flags_known": False}, "risk_page_absent"),
        ({"flags_known": False, "scanned": True}, "risk_page_unreadable"),
        ({"flags_known": False, "scanned": True, "visa": "MED-3"}, "risk_page_unreadable_med"),
        ({"stale": None}, "staleness_indeterminate"),
        ({"injection": True}, "clean_injection_seen"),
    ],
)
def test_cascade(spark, change, path):
    r = RECORD | change
    schema = ", ".join(f"{k} {'array<string>' if k == 'flags' else 'string' if k in ('visa', 'sponsor', 'fee', 'arrival') else 'boolean'}" for k in r)
    df = spark.createDataFrame([tuple(r.values())], schema)
    assert df.select(P.decision_path({k: F.col(k) for k in r}).alias("p")).first()["p"] == path


def test_decisions_and_guard(spark):
    df = spark.createDataFrame([(0.60, 0.25, 0.15, "risk_page_unreadable"), (0.60, 0.25, 0.15, "clean"), (0.0, 0.0, 0.0, "clean")], "a double, d double, r double, path string")
    p = (F.col("a"), F.col("d"), F.col("r"))
    rows = df.select(P.decide_safely(p, F.col("path")).alias("x"), P.decide(p).alias("y")).collect()
    assert (rows[0]["x"]["decision"], rows[0]["x"]["confidence"]) == ("NEEDS_REVIEW", 0.15)
    assert rows[1]["x"]["decision"] == "APPROVED"
    assert rows[2]["y"]["decision"] == "APPROVED"  # the first listed on ties


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return float(row[-1])


@settings(max_examples=200, deadline=None)
@given(st.text("abclmnrw19gh", max_size=8), st.text("abclmnrw19gh", max_size=8))
def test_distance_is_symmetric_and_bounded(a, b):
    d = weighted_distance(a, b)
    assert d == pytest.approx(weighted_distance(b, a))
    assert 0 <= d <= plain(a, b)
    assert weighted_distance(a, b, PLAIN) == plain(a, b)


def test_cheap_misreadings(spark):
    assert weighted_distance("rnars", "mars") == pytest.approx(0.4)
    assert weighted_distance("1ove", "love") == pytest.approx(0.3)
    assert weighted_distance("0k", "ok") == 1.0  # not among the pairs that count in lower case
    df = spark.createDataFrame([("rn", "m"), (None, "m")], "a string, b string")
    assert [r[0] for r in df.select(distance(F.col("a"), F.col("b"), SCAN)).collect()] == [pytest.approx(0.4), None]
