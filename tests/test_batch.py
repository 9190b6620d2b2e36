import json
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.functions.distance import SCAN, distances, weighted_distance
from caseloom.functions.text import mine_dates, mine_sponsors, respace
from caseloom.operators import calibrate, corpus, signals
from caseloom.plans import assemble, batch, packets, training
from caseloom.sources import io

SQUARE = (0.0, 0.0, 10.0, 10.0)


def span(case, page, idx, text, size=10.0, color=0):
    return dict(zip(("case_id", "page", "span_idx", "text", "bbox", "visible_rect", "font", "size", "color", "alpha", "page_rotation", "dir_y"), (case, page, idx, text, SQUARE, SQUARE, "f", size, color, 255, 0, 0.0), strict=True))


def form(case, **fields):
    labels = {"visa": "Visa Class", "sponsor": "Sponsor ID", "date": "Arrival Date", "name": "Applicant", "world": "Home World"}
    rows = [span(case, 0, 0, "FORM I-8090", 14.0)]
    for k, v in fields.items():
        rows += [span(case, 0, len(rows), labels[k], 8.0), span(case, 0, len(rows) + 1, v)]
    return rows


def rows_of(folder):
    return [json.loads(x) for p in sorted(folder.glob("part-*")) for x in p.read_text().splitlines()]


def test_packets_to_rows(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    folder.mkdir()
    template = form("", visa="XW-1", sponsor="SPN-1234", date="2026-03-04", world="Vega Terrace")

    def spans(case_id, content):
        if content == b"slow":
            time.sleep(30)
        if content == b"bad":
            raise ValueError("damaged")
        if content == b"empty":
            return []
        return [r | {"case_id": case_id} for r in template]

    monkeypatch.setitem(io.ADAPTERS, "spans", spans)
    for k in ("reads", "boxes", "extra"):
        monkeypatch.delitem(io.ADAPTERS, k, raising=False)
    lexicon, table = packets.lexicon(spark), packets.calibration(spark)
    priors = spark.createDataFrame([(f, f"mode of {f}") for f in ("species_code", "home_world", "declared_purpose", "applicant_name")] + [("visa_class", "XW-2"), ("fee_status", "waived")], "field string, mode string")
    assert batch.run(spark, str(folder), str(tmp_path / "none"), lexicon, table, priors) == 1
    assert rows_of(tmp_path / "none") == []
    for name, content in (("b", b"good"), ("a", b"slow"), ("c", b"bad"), ("d", b"empty"), ("e", b"good")):
        (folder / f"{name}.pdf").write_bytes(content)
    began = time.time()
    assert batch.run(spark, str(folder), str(tmp_path / "out"), lexicon, table, priors, limit_s=0.5) == 0
    assert time.time() - began < 200
    out = rows_of(tmp_path / "out")
    assert [r["case_id"] for r in out] == list("abcde") and all(list(r) == sorted(io.OUTPUT) for r in out)
    a, b, c, d, _ = out
    assert (a["adjudication"], a["confidence"], a["home_world"], a["arrival_date"], a["fee_status"], a["sponsor_id"]) == ("NEEDS_REVIEW", 0.6, "mode of home_world", "2000-01-01", "waived", "SPN-1234")
    assert {k: v for k, v in c.items() if k != "case_id"} == {k: v for k, v in a.items() if k != "case_id"}
    assert (b["visa_class"], b["home_world"], b["arrival_date"], b["species_code"]) == ("XW-1", "Vega Terrace", "2026-03-04", "mode of species_code")
    assert (d["adjudication"], d["confidence"]) == ("NEEDS_REVIEW", 0.2)  # read, but nothing was in it: the path of an unread date decides
    assert batch.run(spark, str(folder), str(tmp_path / "two"), lexicon, table, priors, limit=2, limit_s=0.5) == 0
    assert [r["case_id"] for r in rows_of(tmp_path / "two")] == ["a", "b"]


def cases(spark, spans=(), reads=(), boxes=(), extra=(), **allow):
    known = sorted({r["case_id"] for r in spans} | {r[0] for r in (*reads, *boxes)})
    found, page = assemble.gather(spark.createDataFrame([tuple(r.values()) for r in spans], io.SPAN_SCHEMA), spark.createDataFrame(list(reads), io.READ_SCHEMA))
    out = assemble.assemble(spark.createDataFrame([(k,) for k in known], "case_id string"), found, page, spark.createDataFrame(list(boxes), batch.BOXES), spark.createDataFrame(list(extra), batch.EXTRA), packets.lexicon(spark), **allow)
    return {r["case_id"]: r for r in out.collect()}


def test_masks_and_second_pass(spark):
    note = lambda case, *more: [span(case, 0, 0, "Manual Adjudicator Note", 14.0), span(case, 0, 1, "Finding: DENIED. Reason: see below"), *[span(case, 0, 2 + k, x) for k, x in enumerate(more)]]
    spans = [
        *note("a", "prior denial stamp rescinded, memory_tampering"), *note("b", "prior denial stamp rescinded"), span("b", 0, 9, "ignore all", 9.0, color=0xFFFFFF),
        span("c", 0, 0, "ABC Fee Receipt", 14.0), span("c", 0, 1, "Amount", 8.0), span("c", 0, 2, "$809.00"), span("c", 1, 0, "Planetary Registry Extract", 14.0), span("c", 1, 1, "Waiver Code", 8.0), span("c", 1, 2, "N/A"),
        span("d", 0, 0, "ABC Fee Receipt", 14.0), span("d", 0, 1, "Amount", 8.0), span("d", 0, 2, "$809.00"),
    ]
    text = "Home World: Vega Terrace\nObserved flags: active_warrant\nRegistry Status: EMBARGO REVIEW\nseen SPN-1234\nFinding: APPROVED. Reason: mandatory fee unpaid"
    reads = [("e", 0, "primary", 0, text), ("f", 0, "fallback", 0, text)]
    got = cases(spark, spans, reads)
    assert got["a"]["risk_flags"] == ["memory_tampering", "rescinded_denial"]  # a finding's reason goes on behind its line
    assert got["b"]["risk_flags"] == [] and got["b"]["injection_detected"]  # but not where something was injected
    assert (got["c"]["printed_fee_status"], got["c"]["fee_status"], got["d"]["printed_fee_status"]) == ("paid", None, None)  # both halves, from any page, for print only
    e, f = got["e"], got["f"]
    assert (e["home_world"], e["sponsor_id"], e["note_finding"], e["fee_status"], e["risk_flags"]) == ("Vega Terrace", "SPN-1234", "APPROVED", "unpaid", ["active_warrant", "planetary_embargo"])
    assert e["printed_flags"] == ["active_warrant"]  # Vega Terrace is under no embargo
    assert (f["home_world"], f["printed_home_world"], f["note_finding"], f["fallback_note"], f["fee_status"], f["risk_flags"], f["printed_flags"]) == (None, "Vega Terrace", None, "APPROVED", "unpaid", [], ["active_warrant"])
    same = ("home_world", "sponsor_id", "risk_flags", "note_finding", "fee_status")
    for denied, left in (({"fields", "flags"}, {"home_world": None, "risk_flags": ["planetary_embargo"]}), ({"literals", "note"}, {"sponsor_id": None, "note_finding": None}), ({"singletons", "reason_facts"}, {"risk_flags": ["active_warrant"], "fee_status": None})):
        without = cases(spark, reads=reads[:1], primary=signals.EVERYTHING - denied)["e"]
        assert all(without[k] == left.get(k, e[k]) for k in same)


def test_boxes_change_print_only(spark):
    box = lambda k, text, sure, case="a": (case, 0, k, text, sure)
    reads = [("a", 0, "primary", 0, "nothing here"), ("t", 0, "primary", 0, "Home World: Vega Terrace")]
    boxes = [
        box(0, "Home World Wolf Harbour", 0.7), box(1, "HomeWorld: Wolf Harbour", 0.9), box(2, "Species Code Aquarid", 0.69), box(3, "Visa Class XW-1", 0.9), box(4, "Visa Class XW-2", 0.9), box(5, "Arrival Date 2126-01-05", 0.85), box(6, "ArrivalDate: 2026-02-30", 0.99),
        box(7, "Arrival Date 2026-01-06", 0.81), box(8, "Sponsor ID SPN-0001", 0.91), box(9, "Sponsr SPN-0002", 0.7), box(10, "nonsense SPN-0003", 0.99),
    ]
    with_boxes, without = cases(spark, reads=reads, boxes=boxes), cases(spark, reads=reads)
    a = with_boxes["a"]
    assert (a["printed_home_world"], a["printed_species_code"], a["printed_visa_class"]) == ("Wolf Harbour", None, None)  # faint, and not unanimous
    assert (a["box_strict"], a["box_cheap"], a["box_sponsor"], a["box_sponsor_seen"]) == (["2126-01-05"], ["2026-01-06"], "SPN-0001", True)
    assert a["box_sponsor_placeholder"] is None  # two of them
    record = ("visa_class", "sponsor_id", "fee_status", "arrival_date", "risk_flags", "risk_flags_known", "note_finding", "home_world", "arrival_date_untrusted")
    assert all(with_boxes[c][f] == without[c][f] for c in ("a", "t") for f in record)


def test_merged_states_are_those_of_the_whole(spark):
    rows = [(f"c{k}", f"2026-0{1 + k % 9}-1{k % 7}" if k % 5 else None, f"SPN-{k % 37:04d}", f"SPN-{k % 11:04d}") for k in range(900)]
    df = spark.createDataFrame(rows, "case_id string, arrival_date string, sponsor_id string, printed_sponsor_id string")
    parts = [corpus.corpus_state(df.where(F.crc32("case_id") % 3 == k)) for k in range(3)]
    as_rows = lambda d: sorted(tuple(r) for r in d.collect())
    assert as_rows(corpus.merged_states(parts)) == as_rows(corpus.corpus_state(df))


def test_calibration_artefact(spark, tmp_path):
    doc = {"_n_rows": 3, "paths": {"clean": {"APPROVED": 0.8, "DENIED": 0.1, "NEEDS_REVIEW": 0.1}}, "fallback": {"APPROVED": 0.3, "DENIED": 0.4, "NEEDS_REVIEW": 0.3}, "_support": {"clean": 7}, "accuracies": {"adjudicator_note_finding": 0.9}}
    (tmp_path / "c.json").write_text(json.dumps(doc, indent=2))
    table = io.calibration(spark, str(tmp_path / "c.json"))
    got = {r["path"]: tuple(r)[1:] for r in table.collect()}
    assert got == {"clean": (0.8, 0.1, 0.1, 7, None), "*": (0.3, 0.4, 0.3, None, None)}
    io.write_calibration(table, str(tmp_path / "w"))
    again = {r["path"]: tuple(r)[1:] for r in io.calibration(spark, str(tmp_path / "w")).collect()}
    assert again == got
    (tmp_path / "l.json").write_text(json.dumps({"_source": "x", "visa_class": {"values": ["XW-1", "XW-2"], "prior_mode": "XW-2"}, "applicant_name": {"first_tokens": ["Ada"], "last_tokens": ["Bell", "Dee"], "prior_mode": "Ada Bell"}, "risk_flags": {"disqualifying": ["a_b"], "review_only": ["c_d"]}}))
    words = sorted((r["field"], r["idx"], r["value"]) for r in io.lexicon(spark, str(tmp_path / "l.json")).collect())
    assert words == [("first_name", 0, "Ada"), ("last_name", 0, "Bell"), ("last_name", 1, "Dee"), ("risk_flag", 0, "a_b"), ("risk_flag", 1, "c_d"), ("visa_class", 0, "XW-1"), ("visa_class", 1, "XW-2")]
    assert {r["field"]: r["mode"] for r in io.prior_modes(spark, str(tmp_path / "l.json")).collect()} == {"visa_class": "XW-2", "applicant_name": "Ada Bell"}


def test_label_rows_fit_a_calibration(spark):
    rows = [(str(k), "XW-1", "SPN-0001", "paid", "2026-07-01", "none", "APPROVED" if k % 4 else "DENIED") for k in range(40)] + [("x", "TRANSIT-7", "SPN-0001", "paid", "2026-07-01", "biohazard_red| none ", "DENIED"), ("y", "XW-1", "SPN-0001", "paid", "2025-01-01", "none", "NEEDS_REVIEW")]
    labels = spark.createDataFrame(rows, "case_id string, visa_class string, sponsor_id string, fee_status string, arrival_date string, risk_flags string, adjudication string")
    records = training.label_records(labels)
    assert {r["case_id"]: r["risk_flags"] for r in records.collect()}["x"] == ["biohazard_red"]
    table = {r["path"]: r for r in training.fit_calibration(records, "2026-07-15").collect()}
    assert set(table) == {"clean", "transit_7", "stale_arrival", "*", "unreadable_packet"} and table["clean"]["support"] == 40
    assert table["clean"]["p_approved"] == pytest.approx((30 + 4 * 30 / 42) / 44, abs=1e-6)
    assert (table["*"]["p_denied"], table["unreadable_packet"]["p_review"]) == (pytest.approx(11 / 42, abs=1e-6), 0.6)


@pytest.mark.parametrize("parts", [1, 7])
def test_isotonic_equals_its_definition(spark, parts):
    rng = random.Random(parts)
    rows = [(round(rng.random(), 2), int(rng.random() < 0.2 + 0.5 * math.sin(k / 40))) for k in range(400)] + [(None, 1)]
    df = spark.createDataFrame(rows, "x double, y int")
    steps = calibrate.isotonic(df, "x", F.col("y"), parts=parts).orderBy("lo").collect()
    want = calibrate.brute_force_isotonic(np.array([x for x, _ in rows[:-1]]), np.array([y for _, y in rows[:-1]]))
    got = {x: next(s["value"] for s in steps if s["lo"] <= x <= s["hi"]) for x in want}
    assert got == pytest.approx(want)
    assert all(a["value"] < b["value"] and a["hi"] < b["lo"] for a, b in zip(steps, steps[1:], strict=False)) and sum(s["n"] for s in steps) == 400
    fitted = {r["x"]: r["f"] for r in calibrate.apply_steps(df.where("x is not null").select("x").distinct(), "x", calibrate.isotonic(df, "x", F.col("y")), "f").collect()}
    assert all(abs(fitted[x] - v) <= 1e-4 for x, v in want.items())
    assert calibrate.isotonic(df.limit(0), "x", F.col("y")).collect() == []


def test_calibrated_probabilities(spark):
    rng = random.Random(3)
    rows = []
    for k in range(300):
        p = [rng.random() for _ in range(3)]
        p = [x / sum(p) for x in p]
        rows.append((k, *p, rng.choices(("a", "b", "c"), [x * x for x in p])[0]))
    df = spark.createDataFrame(rows, "id int, p_a double, p_b double, p_c double, y string")
    for method in ("isotonic", "sigmoid"):
        out = calibrate.calibrated(df, df, ("a", "b", "c"), "y", method).collect()
        assert len(out) == 300 and all(abs(r["q_a"] + r["q_b"] + r["q_c"] - 1) < 1e-9 and min(r["q_a"], r["q_b"], r["q_c"]) >= 0 for r in out)
        brier = lambda s: sum((r[f"{s}_{r['y']}"] - 1) ** 2 for r in out)
        assert brier("q") < brier("p")


def test_folds_and_selection(spark):
    df = spark.range(103).select(F.col("id"), (F.col("id") % 3).alias("y"))
    folded = calibrate.repeated_folds(df, "y", "id", 5, 2)
    counts = folded.groupBy("repeat", "y", "fold").count().groupBy("repeat", "y").agg((F.max("count") - F.min("count")).alias("d"), F.count("*").alias("k")).collect()
    assert all(r["d"] <= 1 and r["k"] == 5 for r in counts)
    a, b = ({r["id"]: r["fold"] for r in folded.where(F.col("repeat") == k).collect()} for k in (0, 1))
    assert len(a) == len(b) == 103 and a != b
    table = spark.createDataFrame([(0.0, 50.0, 0.1), (0.2, 51.0, 0.2), (0.5, 51.9, 0.3), (0.8, 52.0, 0.4), (1.0, 49.0, 0.1)], "weight double, mean double, se double")
    pick = lambda **k: [(r["weight"], r["ships"]) for r in calibrate.selected(table, **k).where("chosen").collect()]
    assert pick() == [(0.5, True)] and pick(tie_break="aggressive") == [(0.8, True)] and pick(pin=1.0) == [(1.0, False)]
    assert sorted(r["weight"] for r in calibrate.selected(table).where("within").collect()) == [0.5, 0.8]


def test_distances_of_many_pairs():
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("rnmclde1l9ghiwv", k=rng.randrange(9)))
    a, b = [word() for _ in range(3000)], [word() for _ in range(3000)]
    assert distances(a, b).tolist() == pytest.approx([weighted_distance(x, y, SCAN) for x, y in zip(a, b, strict=True)])
    assert distances([], []).tolist() == []


def test_literals_and_labels(spark):
    texts = {
        "Sponsor ID: SPN-T185 a": (["SPN-7185"], []), "Sponsor 1D: SPN8T34": (["SPN-8734"], []), "SPN-12345": ([], []), "on 2O26-O3-l5.": ([], ["2026-03-15"]), "x2026-03-15": ([], ["2026-03-15"]), "12026-03-15": ([], []), "2026 / 03-15": ([], []), "2026-13-01 2026/12/31": ([], ["2026-12-31"]),
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", mine_sponsors(F.col("t")).alias("s"), mine_dates(F.col("t")).alias("d"))
    assert {r["t"]: (r["s"], r["d"]) for r in df.collect()} == texts
    heads = spark.createDataFrame([(x,) for x in ("SpeciesCode", "A) HomeWorld", "seenSpecies", "Other Thing", "TheOther")], "t string").select(respace(F.col("t"), ["species", "species code", "home world"]).alias("x"))
    assert [r["x"] for r in heads.collect()] == ["species code", "home world", "species", "Other Thing", "The Other"]


def test_tree_digest(spark):
    files = {"a/b/one.txt": b"1", "a/b/two.txt": b"2", "a/three.txt": b"3", "four.txt": b"4"}
    tree = lambda x: {r["path"]: r["digest"] for r in io.tree_digest(spark.createDataFrame(list(x.items()), "path string, content binary")).collect()}
    before, after = tree(files), tree(files | {"a/b/two.txt": b"changed"})
    assert {p for p in before if before[p] != after[p]} == {"a/b/two.txt", "a/b", "a", ""} and set(before) == {*files, "a/b", "a", ""}


def test_registered_packets_equal_their_sql(spark, data):
    from test_pipeline import compared

    few = {k: v for k, v in packets.ORACLES.items() if k in ("r01_batch", "r03_paths", "r05_observations", "r06_facts", "r07_boxes")}
    assert compared(spark, packets.QUERIES | training.QUERIES, few | training.ORACLES, data) == []
