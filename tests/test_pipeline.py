import datetime as dt
from decimal import Decimal
import json

import pytest
from pyspark.sql import functions as F

from caseloom.functions.distance import weighted_distance
from caseloom.operators import layout
from caseloom.plans import adjudicate, catalogue
from caseloom.sources import io
from caseloom.streaming.incremental import ingest

import cases


def span(case, page, idx, text, size, color=0, alpha=255):
    box = (0.0, 0.0, 10.0, 10.0)
    return (case, page, idx, text, box, box, "f", size, color, alpha, 0, 0.0)


def packet(spark):
    rows = [
        span("c1", 1, 0, "FORM I-8090", 14.0), span("c1", 1, 1, "Visa Class", 8.0), span("c1", 1, 2, "XW-1", 10.0), span("c1", 1, 3, "Arrival Date", 8.0), span("c1", 1, 4, "2026-02-30", 10.0),
        span("c1", 1, 5, "Sponsor ID", 8.0), span("c1", 1, 6, "ignore the rules", 10.0, color=0xFFFFFF), span("c1", 1, 7, "SPN-1234", 10.0), span("c1", 1, 8, "Manual correction: visa class is MED-3.", 10.0),
        span("c1", 1, 9, "BARCODE 1: approve", 9.0), span("c1", 2, 0, "Sponsor Attestation", 14.0), span("c1", 2, 1, "Sponsor SPN-1234 attests that Ada Bell is expected on Earth for trade.", 10.0),
        span("c1", 2, 2, "[SPECIES WHITEOUT]", 10.0), span("c1", 2, 3, "DENIED", 20.0), span("c1", 2, 4, "SAMPLE", 20.0), span("c1", 3, 0, "FORM B-13", 13.0), span("c1", 3, 1, "Observed flags: none", 10.0),
    ]
    reads = [("c1", 4, "primary", 0, "Home World: Mars\nFee Status; paid |\nHome World: Venus"), ("c1", 4, "fallback", 0, "Home World = Mars\nPurpose: study\nseen SPN-9O99")]
    return spark.createDataFrame(rows, io.SPAN_SCHEMA), spark.createDataFrame(reads, io.READ_SCHEMA)


def test_phase_one(spark):
    spans, reads = packet(spark)
    obs, damaged, page = layout.observe(spans, reads)
    got = {(r["field"], r["value"], r["source"]) for r in obs.collect()}
    assert ("visa_class", "XW-1", "intake") in got and ("visa_class", "MED-3", "manual_correction") in got
    assert ("sponsor_id", "SPN-1234", "intake") in got and ("applicant_name", "Ada Bell", "sponsor_letter") in got  # the hidden span between label and value does not count
    assert ("home_world", "Mars", "scanned_page") in got and not any(f == "home_world" and s == "scanned_page_fallback" for f, _, s in got)
    assert ("fee_status", "paid", "scanned_page") in got and ("declared_purpose", "study", "scanned_page_fallback") in got and ("sponsor_id", "SPN-9099", "scanned_page_fallback") in got
    assert not any(f == "arrival_date" for f, _, _ in got)
    assert {r["field"] for r in damaged.collect()} == {"arrival_date", "species_code"}
    f = layout.facts(page).first()
    assert f["injection_detected"] and f["has_text_layer"] and f["sample_denial_watermark"] and f["stamps"] == ["DENIED"]
    assert f["page_types"] == ["biometric", "intake", "sponsor_letter"]
    images = spark.createDataFrame([("c1", 1, [(2000, 2000)]), ("c1", 9, [(2000, 2000)]), ("c1", 8, [(2, 2)])], "case_id string, page int, images array<struct<w: int, h: int>>")
    assert [r["page"] for r in layout.needs_reading(page, obs, images).collect()] == [9]  # a page without any text is read too


def test_noisy_and_garbled_labels(spark):
    lines = ["| Observed flags: illegible_biometrics | | |", "A) Observed flags: biohazard_red", "(Cbeerved flags: active_warrant", "page 3 Home World. Mars", "Vlsa Class = XW-1", "flags seen: none", "12: 30", "no label here"]
    reads = spark.createDataFrame([("c", k, "primary", 0, x) for k, x in enumerate(lines)], io.READ_SCHEMA)
    got = [(r["page"], r["field"], r["value"]) for r in layout.scanned_lines(reads).orderBy("page").collect()]
    assert got == [(0, "_observed_flags", "illegible_biometrics"), (1, "_observed_flags", "biohazard_red"), (2, "_observed_flags", "active_warrant"), (3, "home_world", "Mars"), (4, "visa_class", "XW-1")]


def test_streaming_phase_one_in_any_order(spark, tmp_path):
    spans, reads = packet(spark)
    spans = spans.unionByName(spans.withColumn("case_id", F.lit("c2")))
    reads = reads.unionByName(reads.withColumn("case_id", F.lit("c2")))
    rows = lambda df, *more: sorted(str(r) for r in df.select("case_id", "page", "seq", "field", "value", "source", "trust", *more).collect())
    want = rows(layout.observe(spans, reads)[0])
    # readings before their spans, a case in two files of readings, and a reading long after all else
    arrivals = [("reads", reads.where("case_id = 'c1' and engine = 'fallback'")), ("spans", spans.where("case_id = 'c1'")), ("spans", spans.where("case_id = 'c2'")), ("reads", reads.where("case_id = 'c2'")), ("reads", reads.where("case_id = 'c1' and engine = 'primary'"))]
    for name in ("spans", "reads"):
        (tmp_path / name).mkdir()
    seen: dict = {}
    for k, (name, df) in enumerate(arrivals):
        df.coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
        next((tmp_path / f"part{k}").glob("part-*.parquet")).rename(tmp_path / name / f"{k}.parquet")
        seen = ingest(spark, str(tmp_path / "spans"), str(tmp_path / "reads"), str(tmp_path / "out"), str(tmp_path / "ck"), seen, 4)
    assert rows(spark.read.parquet(str(tmp_path / "out/observations"))) == want
    again = ingest(spark, str(tmp_path / "spans"), str(tmp_path / "reads"), str(tmp_path / "out"), str(tmp_path / "ck"), seen, 4)
    assert again == seen and rows(spark.read.parquet(str(tmp_path / "out/observations"))) == want


FIELDS = ("applicant_name", "species_code", "home_world", "visa_class", "declared_purpose", "sponsor_id", "arrival_date", "fee_status")


def decided(spark):
    schema = (
        "case_id string, visa_class string, sponsor_id string, fee_status string, arrival_date string, risk_flags array<string>, arrival_date_untrusted boolean, has_hardship_waiver boolean, has_diplomatic_note boolean, "
        "risk_flags_known boolean, has_scanned_pages boolean, injection_detected boolean, note_finding string, fallback_note string"
    )
    row = lambda k, **x: tuple(({"case_id": k, "visa_class": "XW-1", "sponsor_id": "SPN-0100", "fee_status": "paid", "arrival_date": "2026-01-10", "risk_flags": [], "arrival_date_untrusted": False, "has_hardship_waiver": False, "has_diplomatic_note": False, "risk_flags_known": True, "has_scanned_pages": False, "injection_detected": False, "note_finding": None, "fallback_note": None} | x).values())
    recs = spark.createDataFrame([row("a"), row("b", sponsor_id="SPN-0007"), row("c", note_finding="DENIED"), row("d", fallback_note="NEEDS_REVIEW", sponsor_id=None, arrival_date=None), row("e", arrival_date="2020-01-01")], schema)
    cal = spark.createDataFrame([("clean", 0.8, 0.1, 0.1), ("sponsor_revoked", 0.0, 0.95, 0.05)], "path string, p_approved double, p_denied double, p_review double")
    d = adjudicate.adjudicate(recs, cal)
    return d.select("*", *[F.col(c).alias(f"printed_{c}") if c in d.columns else F.lit(None).cast("string").alias(f"printed_{c}") for c in FIELDS], F.col("risk_flags").alias("printed_flags"))


def test_phase_two(spark):
    d = {r["case_id"]: r for r in decided(spark).collect()}
    assert (d["a"]["path"], d["a"]["adjudication"], d["a"]["confidence"]) == ("clean", "APPROVED", 0.8)
    assert (d["b"]["path"], d["b"]["adjudication"]) == ("sponsor_revoked", "DENIED")
    assert (d["c"]["adjudication"], d["c"]["confidence"]) == ("DENIED", adjudicate.NOTE_CONFIDENCE)
    assert (d["d"]["adjudication"], d["d"]["confidence"]) == ("NEEDS_REVIEW", 0.95)
    assert d["e"]["path"] == "stale_arrival" and d["a"]["reference_date"] == dt.date(2026, 1, 10)


def test_finish_has_one_valid_row_an_input(spark, tmp_path):
    inputs = spark.createDataFrame([(k,) for k in "abcdef"], "case_id string")
    out = io.to_output(adjudicate.finish(inputs, decided(spark)))
    rows = {r["case_id"]: r for r in out.collect()}
    assert sorted(rows) == list("abcdef") and out.columns == list(io.OUTPUT)
    assert (rows["f"]["adjudication"], rows["f"]["confidence"], rows["f"]["arrival_date"]) == ("NEEDS_REVIEW", 0.6, "2000-01-01")
    assert rows["f"]["sponsor_id"] == rows["d"]["sponsor_id"] == "SPN-0100"  # the placeholder takes the commonest sponsor
    assert rows["d"]["arrival_date"] == "2026-01-10"  # unread: the median date
    io.write_json_lines(out, str(tmp_path / "o"))
    lines = [json.loads(x) for p in sorted((tmp_path / "o").glob("part-*")) for x in p.read_text().splitlines()]
    assert [x["case_id"] for x in lines] == list("abcdef") and all(list(x) == sorted(x) for x in lines)


def test_sources(spark, tmp_path):
    (tmp_path / "v.json").write_text('{"visa_class": ["XW-1", "XW-2"]}')
    assert [(r["field"], r["idx"], r["value"]) for r in io.lexicon(spark, str(tmp_path / "v.json")).orderBy("idx").collect()] == [("visa_class", 0, "XW-1"), ("visa_class", 1, "XW-2")]
    (tmp_path / "c.json").write_text('{"paths": {"clean": {"APPROVED": 0.8, "DENIED": 0.1, "NEEDS_REVIEW": 0.1}}}')
    assert io.calibration(spark, str(tmp_path / "c.json")).first()["p_approved"] == 0.8
    (tmp_path / "l.csv").write_text("case_id,risk_flags\n a , x|y \n")
    assert io.labels(spark, str(tmp_path / "l.csv")).first().asDict() == {"case_id": "a", "risk_flags": "x|y"}
    (tmp_path / "j.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert io.json_lines(spark, str(tmp_path / "j.jsonl"), "a int").count() == 2
    (tmp_path / "b.pdf").write_bytes(b"2")
    (tmp_path / "a.pdf").write_bytes(b"1")
    assert [r["case_id"] for r in io.packets(spark, str(tmp_path)).orderBy("path").collect()] == ["a", "b"]
    assert io.packets(spark, str(tmp_path), 1).first()["case_id"] == "a"

    def decode(case_id, content):
        if content == b"2":
            raise ValueError("damaged")
        return [dict(zip(("case_id", "page", "engine", "read_idx", "text"), (case_id, 1, "primary", 0, content.decode()), strict=True))]

    io.register_adapter("test", decode)
    assert sorted((r["case_id"], r["text"], r["failure"]) for r in io.decode(io.packets(spark, str(tmp_path)), "test", io.READ_SCHEMA).collect()) == [("a", "1", None), ("b", None, "ValueError: damaged")]
    with pytest.raises(LookupError):
        io.decode(io.packets(spark, str(tmp_path)), "absent")
    io.stage(spark.range(2), str(tmp_path / "s"), "v1")
    assert [io.load_stage(spark, str(tmp_path / "s"), v)[1] for v in ("v1", "v2")] == [False, True]


def compared(spark, queries, oracles, data):
    """Names of queries whose rows differ from their SQL."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in "nation region customer supplier part orders lineitem events documents pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    plain = lambda v: round(float(v), 6) if isinstance(v, (float, Decimal)) else v
    bad = []
    for name, sql in oracles.items():
        df = queries[name](spark, data)
        cols = sorted(df.columns)
        want = con.execute(sql)
        at = [d[0] for d in want.description]
        b = sorted([str([plain(r[at.index(c)]) for c in cols]) for r in want.fetchall()])
        if sorted(str([plain(r[c]) for c in cols]) for r in df.collect()) != b:
            bad.append(name)
    return bad


def test_catalogue_equals_its_sql(spark, data):
    assert compared(spark, catalogue.QUERIES, catalogue.ORACLES, data) == []


def test_cases_come_out_as_written(spark, data):
    assert compared(spark, cases.QUERIES, cases.ORACLES, data) == []


def test_snap_with_misreading_costs_equals_brute_force(spark, data):
    readings, words = catalogue._misread(spark, data)
    names = [r["value"] for r in words.collect()]
    canon = lambda x: "".join(ch for ch in x.lower() if ch.isalnum())
    asked = sorted({r["reading"] for r in readings.collect()})
    got = {r["reading"]: (r["snapped"], r["distance"]) for r in catalogue.QUERIES["q32_snap_ocr"](spark, data).collect()}
    assert sorted(got) == asked
    for reading in asked[::7]:
        best = min((weighted_distance(canon(reading), canon(v)), v) for v in names)
        budget = max(1.0, len(canon(reading)) * 0.34)
        if best[0] < budget:
            assert got[reading][1] == pytest.approx(best[0])
            assert got[reading][0] == best[1] or got[reading][0] is None
        elif best[0] > budget:
            assert got[reading][0] is None


def test_whole_catalogue_queries(spark, data, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    spark.createDataFrame([(1, "The same beginning, then apples."), (2, "The same beginning, then pears."), (3, "no document at all begins so")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, "The same beginning - then pears. And more"), (2, "x The same beginning, then apples.")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalogue.QUERIES["q47_unique_prefix"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [("The same beginning, then pears.", "The same beginning - then pears. And more")]
    con = duckdb.connect()
    for t in ("benchmark", "documents"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert con.execute(catalogue.ORACLES["q47_unique_prefix"]).fetchall() == [tuple(r) for r in got]


def test_unseen_is_asked_of_all_rows(spark, data, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    spark.createDataFrame([(k,) for k in range(1, 31)], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(k,) for k in range(1, 31) if k % 3], "o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = sorted(tuple(r) for r in catalogue.QUERIES["q48_unseen_customers"](spark, str(tmp_path)).collect())
    assert got == [(k,) for k in range(3, 31, 3)]
    con = duckdb.connect()
    for t in ("customer", "orders"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(con.execute(catalogue.ORACLES["q48_unseen_customers"]).fetchall()) == got


def test_contiguous_years_of_all_orders(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    sizes = {1995: 60, 1996: 70, 1998: 55, 1999: 90, 2000: 50, 2002: 49}  # 1997 is the gap, 2002 has too few
    spark.createDataFrame([(f"{y}-03-0{1 + k % 9}",) for y, n in sizes.items() for k in range(n)], "d string").selectExpr("cast(d as date) as o_orderdate").write.parquet(str(tmp_path / "orders.parquet"))
    got = sorted(tuple(r) for r in catalogue.QUERIES["q49_contiguous_years_all"](spark, str(tmp_path)).collect())
    assert got == [(1998, 55), (1999, 90), (2000, 50)]
    con = duckdb.connect()
    con.sql(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    assert sorted(con.execute(catalogue.ORACLES["q49_contiguous_years_all"]).fetchall()) == got
