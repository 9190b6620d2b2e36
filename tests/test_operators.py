import datetime as dt

from pyspark.sql import functions as F

from caseloom.functions.distance import SCAN
from caseloom.operators import boxes, corpus, evaluate, evidence, features, resolve, snap

OBS = "case_id string, field string, value string, source string, page int, trust int, seq int, score double"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_resolution(spark):
    o = spark.createDataFrame(
        [("a", "f", "x", "scanned_page", 2, 6, 1, 1.0), ("a", "f", "y", "intake", 3, 2, 1, 0.5), ("a", "f", "z", "intake", 1, 2, 2, 0.9), ("b", "f", "u", "unknown", 1, 9, 1, 1.0), ("c", "f", "v", "scanned_page_fallback", 1, 7, 1, 1.0)], OBS
    )
    assert rows(resolve.trust_resolve(o, ["case_id"]), "case_id", "value") == [("a", "z"), ("c", "v")]
    assert rows(resolve.trust_resolve(o, ["case_id"], score=F.col("score")), "case_id", "value") == [("a", "z"), ("c", "v")]
    assert rows(resolve.trust_resolve(o, ["case_id"], 6, F.col("score")), "case_id", "value") == [("a", "z")]


def test_tier_majority_falls_through_and_counts(spark):
    o = spark.createDataFrame([("a", "f", "A", "s", 1, 6, 1, 1.0), ("a", "f", "B", "s", 2, 6, 2, 0.9), ("a", "f", "B", "s", 3, 6, 3, 0.9), ("b", "f", "C", "s", 1, 7, 1, 0.4)], OBS)
    assert rows(resolve.tier_majority(o, ["case_id"]), "case_id", "value") == [("a", "B"), ("b", "C")]


def test_consensus_needs_its_lead(spark):
    o = spark.createDataFrame([("a", v) for v in "xxy"] + [("b", v) for v in "xxxy"] + [("c", "x")] * 2, "case_id string, value string")
    assert rows(resolve.consensus(o, ["case_id"]), "case_id", "value", "votes", "runner_up") == [("b", "x", 3, 1), ("c", "x", 2, 0)]


def test_backfill_gives_one_row_an_input(spark):
    inputs = spark.createDataFrame([("a",), ("b",)], "case_id string")
    got = resolve.backfill(inputs, spark.createDataFrame([("a", "D", 0.7)], "case_id string, adjudication string, confidence double"), "case_id", {"adjudication": "R", "confidence": 0.6})
    assert rows(got, "case_id", "adjudication", "confidence", "missing") == [("a", "D", 0.7, False), ("b", "R", 0.6, True)]


def dates(spark, spec):
    return spark.createDataFrame([(dt.date.fromisoformat(d),) for d, n in spec for _ in range(n)], "d date")


def test_years(spark):
    d = dates(spark, [("2026-03-01", 80), ("2025-03-01", 20), ("2028-03-01", 30)]).select(F.year("d").alias("year"))
    years = corpus.contiguous_years(d, "year", support=10)
    assert rows(years, "year", "n") == [(2025, 20), (2026, 80)]
    bad = spark.createDataFrame([(dt.date(2028, 4, 18),), (dt.date(2036, 4, 15),), (dt.date(2038, 4, 18),), (dt.date(2026, 1, 1),)], "d date")
    assert [r["repaired"] for r in corpus.repair_years(bad, "d", years).orderBy("d").collect()] == [dt.date(2026, 1, 1), dt.date(2026, 4, 18), dt.date(2026, 4, 15), None]
    even = spark.createDataFrame([(2026, 50), (2027, 50)], "year int, n long")
    assert corpus.repair_years(bad.where("d = date '2028-04-18'"), "d", even).first()["repaired"] is None


def test_reference_date_ignores_far_dates(spark):
    d = dates(spark, [(f"2026-01-{k:02d}", 1) for k in range(1, 29)] + [("2060-01-01", 1)])
    assert corpus.reference_date(d, [], "d").first()["reference_date"] == dt.date(2026, 1, 28)
    assert corpus.median_date(d, [], "d").first()["median_date"] == dt.date(2026, 1, 15)
    assert corpus.reference_date(d.limit(0), [], "d").first()["reference_date"] is None


def test_outliers_need_many_distinct_values(spark):
    many = spark.range(450).select(F.concat(F.lit("s"), F.col("id")).alias("s")).union(spark.range(20).select(F.lit("hot").alias("s")))
    assert rows(corpus.frequency_outliers(many, "s"), "s", "n") == [("hot", 20)]
    assert corpus.frequency_outliers(many.limit(100).union(spark.range(20).select(F.lit("hot"))), "s").count() == 0


def test_mode_fill(spark):
    df = spark.createDataFrame([(1, "-"), (2, "X"), (3, "X"), (4, "Y")], "k int, v string")
    assert rows(corpus.mode_fill(df, "v", F.col("v") == "-"), "k", "v") == [(1, "X"), (2, "X"), (3, "X"), (4, "Y")]
    none = spark.createDataFrame([(1, "-")], "k int, v string")
    assert rows(corpus.mode_fill(none, "v", F.col("v") == "-"), "k", "v") == [(1, "-")]


def test_box_settlement(spark):
    known = F.array(*[F.struct(F.lit(n).cast("long").alias("n"), F.lit(y).alias("y")) for n, y in ((20, "2025"), (80, "2026"))])
    a = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    cases = [(a("2026-01-02"), a()), (a(), a("2025-01-02")), (a("2026-01-02"), a("2026-01-03")), (a("2126-01-02"), a())]
    got = [spark.range(1).select(corpus.settle_box_date(s, c, known, F.lit(2026)).alias("x")).first()["x"] for s, c in cases]
    assert got == ["2026-01-02", None, None, "2026-01-02"]  # 2126 is one digit off
    sponsor = lambda p, b, seen, r=None, m="P": spark.range(1).select(corpus.settle_box_sponsor(F.lit(p), F.lit(b).cast("string"), F.lit(seen), F.lit(r).cast("string"), F.array(F.lit("R1"), F.lit("R2")), F.lit(m)).alias("x")).first()["x"]
    assert [sponsor("A", "B", False), sponsor("A", "B", True), sponsor("R1", "R2", True), sponsor("P", "R1", True), sponsor("P", "B", False), sponsor("P", "B", False, "C")] == ["A", "B", "R1", "P", "B", "C"]


def vocab(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "idx int, value string")


def test_snap(spark):
    r = spark.createDataFrame([("Rnars",), ("Mars",), ("zzzzzz",), ("",), (None,)], "reading string")
    got = {x["reading"]: (x["snapped"], round(x["confidence"], 3)) for x in snap.snap(r, vocab(spark, "Mars", "Marz"), "reading").collect()}
    assert got["Mars"] == ("Mars", 1.0)
    assert got["zzzzzz"] == (None, 0.0) and got[""] == (None, 0.0) and got[None] == (None, 0.0)
    assert got["Rnars"][0] == "Mars"


def test_snap_does_not_force_a_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    r = spark.createDataFrame([("Mers",), ("Venuss",), ("zzzzzzzzzzzz",), ("--",)], "reading string")
    spark.conf.set(key, "-1")
    try:
        out = snap.snap(r, vocab(spark, "Mars", "Venus"), "reading")
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
        assert {x["reading"]: x["snapped"] for x in out.collect()} == {"Mers": "Mars", "Venuss": "Venus", "zzzzzzzzzzzz": None, "--": None}
    finally:
        spark.conf.set(key, before)


def test_names_flags_findings(spark):
    r = spark.createDataFrame([("Ada X. Bell",), ("Ada",), ("Adq Bel1",)], "n string")
    got = {x["n"]: (x["snapped"], x["confidence"]) for x in snap.snap_names(r, vocab(spark, "Ada", "Boris"), vocab(spark, "Bell", "Crane"), "n").collect()}
    assert got["Ada X. Bell"] == ("Ada Bell", 1.0) and got["Ada"] == ("Ada", 0.0) and got["Adq Bel1"][0] == "Ada Bell"
    f = spark.createDataFrame([("biohaz",), ("active_warrnt",), ("xyz",)], "raw string")
    flags = {x["raw"]: x["snapped"] for x in snap.snap_flags(f, vocab(spark, "biohazard_red", "active_warrant"), "raw").collect()}
    assert flags == {"biohaz": "biohazard_red", "active_warrnt": "active_warrant", "xyz": None}
    w = spark.createDataFrame([("APPR",), ("denial",), ("DENIFD",), ("xx",)], "w string")
    assert rows(snap.snap_findings(w, "w"), "w", "finding") == [("APPR", "APPROVED"), ("DENIFD", "DENIED")]


def test_labels_by_position(spark):
    r = spark.createDataFrame([("Vlsa Class",), ("Sponsor 1D",), ("nothing at all",)], "r string")
    labels = spark.createDataFrame([(0, "visa class"), (1, "sponsor id")], "idx int, label string")
    assert rows(snap.match_labels(r, labels, "r"), "r", "label", "mismatches") == [("Sponsor 1D", "sponsor id", 2), ("Vlsa Class", "visa class", 1)]


def test_boxes(spark):
    xy = "array<struct<x: double, y: double>>"
    raw = [("c", 1, 0, "Visa", 0.9, [(0.0, 0.0), (10.0, 10.0)]), ("c", 1, 1, "XW-1", 0.9, [(20.0, 2.0), (30.0, 12.0)]), ("c", 1, 2, "Low", 0.9, [(0.0, 30.0), (9.0, 40.0)]), ("c", 1, 3, "noise", 0.2, [(0.0, 0.0), (1.0, 1.0)])]
    b = boxes.admit(spark.createDataFrame(raw, f"case_id string, page int, box_idx int, text string, confidence double, polygon {xy}"))
    assert rows(boxes.lines(b, ["case_id", "page"]), "row", "text") == [(0, "Visa XW-1"), (1, "Low")]
    items = F.array(*[F.struct(F.lit(float(y)).alias("y"), F.lit(i).alias("i")) for i, y in enumerate((0, 8, 16, 17))])
    assert spark.range(1).select(boxes.anchored_rows(items, F.lit(10.0)).alias("r")).first()["r"] == [0, 0, 1, 1]  # 16 is near 8 but not near the anchor
    alias = spark.createDataFrame([("visa class", "visa_class")], "alias string, field string")
    one = spark.createDataFrame([("c", 1, 0, "Visa Ciass XW1", 0.8)], "case_id string, page int, box_idx int, text string, confidence double")
    assert boxes.labelled_values(one, alias, "closed").first()["value"] == "xw1"
    assert boxes.labelled_values(one.withColumn("confidence", F.lit(0.69)), alias, "closed").count() == 0


def test_evaluation(spark):
    df = spark.createDataFrame([("p", "A")] * 3 + [("q", "D")], "path string, o string")
    got = {r["path"]: r for r in evaluate.smoothed(df, "path", "o", ["A", "D"]).collect()}
    assert got["p"]["p_A"] == round((3 + 4 * 0.75) / 7, 6) and got["q"]["p_D"] == round((1 + 4 * 0.25) / 5, 6)
    d = evaluate.drift(df.where("path = 'p'"), df.where("path = 'q'"), "o")
    assert rows(d, "o", "share_a", "share_b", "delta") == [("A", 1.0, 0.0, -1.0), ("D", 0.0, 1.0, 1.0)]
    s = spark.createDataFrame([("DENIED", "APPROVED", 0.9), ("APPROVED", "APPROVED", 0.8)], "t string, d string, c double")
    r = evaluate.challenge_score(s, "t", "d", "c").first()
    assert (r["payoff"], r["accuracy"], r["false_approvals"]) == (4.0, 0.5, 1)
    assert evaluate.one_standard_error([(0.0, 1.0, 0.1), (0.5, 1.15, 0.1), (1.0, 1.2, 0.1)]) == 0.5
    folds = evaluate.stratified_folds(df.withColumn("k", F.monotonically_increasing_id()), "o", "k", 2)
    assert {r["fold"] for r in folds.collect()} <= {0, 1}


def obs_rows(spark, *r):
    return spark.createDataFrame([("c", f, v, s, p, t, k, sc) for k, (f, v, s, p, t, sc) in enumerate(r)], OBS)


def test_fallback_fills_print_but_not_policy(spark):
    o = obs_rows(spark, ("visa_class", "XW-1", "scanned_page_fallback", 1, 7, 1.0), ("home_world", "Mars", "scanned_page", 1, 6, 1.0))
    r = evidence.records(o, ("visa_class", "home_world", "fee_status")).first()
    assert (r["visa_class"], r["printed_visa_class"], r["home_world"], r["printed_home_world"]) == (None, "XW-1", "Mars", "Mars")
    r = evidence.records(o, ("visa_class", "fee_status"), frozenset()).first()
    assert r["printed_visa_class"] is None


def test_direct_repairs_change_print_only(spark):
    fields = ("applicant_name", "sponsor_id", "visa_class", "species_code", "home_world", "declared_purpose")
    o = obs_rows(
        spark, ("applicant_name", "Ada Bell", "sponsor_letter", 2, 4, 1.0), ("applicant_name", "ada bell", "scanned_page", 3, 6, 1.0),
        ("sponsor_id", "SPN-0001", "scanned_page", 1, 6, 1.0), ("sponsor_id", "SPN-0001", "scanned_page_fallback", 2, 7, 1.0), ("home_world", "Mars", "scanned_page", 1, 6, 1.0), ("home_world", "Mars", "scanned_page", 2, 6, 1.0),
    )
    before = evidence.records(o, fields)
    after = evidence.direct_repairs(before, o, spark.createDataFrame([("c", True)], "case_id string, transit boolean"))
    x, y = before.first(), after.first()
    assert all(x[f] == y[f] for f in fields)  # what policy sees never moves
    assert (y["printed_applicant_name"], y["printed_sponsor_id"], y["printed_visa_class"], y["printed_home_world"]) == ("Ada Bell", "SPN-0001", "TRANSIT-7", "Mars")


def test_risk_flags(spark):
    o = obs_rows(spark, ("sponsor_id", "SPN-0001", "intake", 1, 2, 1.0), ("sponsor_id", "SPN-0002", "sponsor_letter", 2, 4, 1.0), ("applicant_name", "A B", "intake", 1, 2, 1.0), ("applicant_name", "C D", "registry", 3, 5, 1.0))
    seen = spark.createDataFrame([("c", "biohazard_red")], "case_id string, raw string")
    reg = spark.createDataFrame([("c", "EMBARGO")], "case_id string, status string")
    got = evidence.risk_flags(seen, seen.limit(0), reg, o, vocab(spark, "biohazard_red", "active_warrant"))
    assert [r["flag"] for r in got.orderBy("flag").collect()] == ["biohazard_red", "identity_conflict", "planetary_embargo", "sponsor_mismatch"]
    # a status prints no embargo of a world that has none; what a panel states is always printed
    worlds = [("home_world", "Mars", "intake", 1, 2, 1.0)]
    read = lambda *x: spark.createDataFrame(list(x), "case_id string, raw string, observed boolean, fallback boolean")
    status = reg.withColumn("fallback", F.lit(False))
    names = vocab(spark, "planetary_embargo")

    def shown(*world, panel=()):
        obs = obs_rows(spark, *world) if world else o.limit(0)
        e = evidence.flag_evidence(read(*[("c", x, True, False) for x in panel]), status, obs, names)
        return evidence.flag_sets(e, evidence.without_embargo(obs), frozenset({"printed"})).first()

    assert (shown(*worlds)["risk_flags"], shown(*worlds)["printed_flags"]) == (["planetary_embargo"], [])
    assert shown(("home_world", "Eris Relay", "intake", 1, 2, 1.0))["printed_flags"] == shown()["printed_flags"] == shown(*worlds, panel=["planetary_embargo"])["printed_flags"] == ["planetary_embargo"]


def test_clipped_and_compound_flags(spark):
    names = "active_warrant biohazard_red illegible_biometrics identity_conflict planetary_embargo rescinded_denial sponsor_mismatch".split()
    frame = lambda *x: spark.createDataFrame(list(x), "case_id string, raw string")
    none = obs_rows(spark, ("sponsor_id", "SPN-0001", "intake", 1, 2, 1.0)).limit(0)
    reg = spark.createDataFrame([("r1", "Embargoed"), ("r2", "CLEAR")], "case_id string, status string")
    seen = frame(("a1", "resc"), ("a2", "ifle"), ("a3", "zq"), ("a4", "none"))
    loose = frame(("b1", "sor_mismatch"), ("b2", "jple_biormetrics"), ("b3", "planetary_registry"), ("b5", "biohazerd_rxd"), ("b6", "resc"))
    got = sorted((r["case_id"], r["flag"]) for r in evidence.risk_flags(seen, loose, reg, none, vocab(spark, *names)).collect())
    assert got == [("a1", "rescinded_denial"), ("a2", "illegible_biometrics"), ("b1", "sponsor_mismatch"), ("b2", "illegible_biometrics"), ("b5", "biohazard_red"), ("r1", "planetary_embargo")]


def test_third_reader_fills_what_is_left(spark):
    printed = spark.createDataFrame([("c", None, "x")], "case_id string, printed_visa_class string, printed_home_world string")
    extra = spark.createDataFrame([("c", "visa_class", "XW-1", 0.5), ("c", "home_world", "y", 1.0)], "case_id string, field string, value string, score double")
    none = spark.createDataFrame([], "case_id string, field string")
    r = evidence.fill_unresolved(printed, extra, none, none.select("case_id")).first()
    assert (r["printed_visa_class"], r["printed_home_world"]) == ("XW-1", "x")
    hurt = spark.createDataFrame([("c", "visa_class")], "case_id string, field string")
    assert evidence.fill_unresolved(printed, extra, hurt, none.select("case_id")).first()["printed_visa_class"] is None


def test_features(spark):
    r = spark.createDataFrame([("c", "XW-1", None, "paid", ["active_warrant"], True, 0.5, dt.date(2026, 1, 1), dt.date(2026, 7, 5), ["SPN-1"], ["visa_class"], "clean")],
        "case_id string, visa_class string, sponsor_id string, fee_status string, flags array<string>, flags_known boolean, biometric_confidence double, arrival date, reference_date date, revoked array<string>, damaged_fields array<string>, path string")
    r = r.select("*", *[F.lit(None).cast("string").alias(c) for c in ("arrival_date", "species_code", "home_world", "declared_purpose", "applicant_name")])
    facts = spark.createDataFrame([("c", True, False, ["DENIED"], False, ["intake"])], "case_id string, has_text_layer boolean, injection_detected boolean, stamps array<string>, sample_denial_watermark boolean, page_types array<string>")
    f = features.packet_features(r, obs_rows(spark, ("visa_class", "XW-1", "intake", 1, 2, 1.0)), facts, paths=("clean",)).first()
    assert (f["visa_XW-1"], f["flag_active_warrant"], f["has_disqualifying"], f["path_clean"], f["stamp_DENIED"], f["page_intake"], f["damaged_visa_class"]) == (1.0,) * 7
    assert f["stale_margin"] == (185 - 180) / 180 and f["known_field_count"] == 1.0
    assert "stamp_DENIED" not in features.allowed(list(f.asDict()))
    v = features.vectorise(spark.createDataFrame([(1.0, None)], "a double, b double"), ["b", "a", "zz"]).first()["features"]
    assert list(v) == [0.0, 1.0, 0.0]


def test_models_fit_out_of_fold(spark):
    df = spark.range(60).select(F.col("id").cast("string").alias("case_id"), (F.col("id") % 3).cast("double").alias("label"), (F.col("id") % 3).cast("double").alias("x"), (F.col("id") % 2).cast("int").alias("fold"))
    v = features.vectorise(df, ["x"])
    got = features.out_of_fold(v, features.candidate_models()["logistic"], 2)
    assert got.count() == 60 and all(max(range(3), key=lambda k: r["p"][k]) == r["label"] for r in got.collect())
    assert features.load_model("/nonexistent/model") is None
    assert SCAN.joined


def test_conditions_on_distances_stay_behind_the_distinct(spark):
    from caseloom.functions.distance import SCAN, distance

    rows = spark.range(200).select(F.concat(F.lit("w"), F.pmod("id", F.lit(3))).alias("a"), F.lit("w1").alias("b"))
    near = rows.distinct().withColumn("d", distance(F.col("a"), F.col("b"), SCAN)).where("d <= 0.5")
    plan = near._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.index("ArrowEvalPython") < plan.index("HashAggregate")
    assert [tuple(r) for r in near.collect()] == [("w1", "w1", 0.0)]


def test_beginnings_are_counted_without_copying_texts(spark):
    from caseloom.operators import snap

    texts = [f"The same long beginning of all texts {'x' * (k % 7)} then number {k % 40}. And so on" for k in range(60)] + ["A text of its own. More", "a text - of its own! more", "short", "Twice the same text", "Twice the same text"]
    values = spark.createDataFrame([(t,) for t in texts] + [(None,)], "value string")
    readings = values.select(F.substring_index("value", ".", 1).alias("reading")).union(spark.createDataFrame([("A text of its own. M",), ("the same LONG",), ("Twice",), ("nothing of it",)], "reading string"))
    got = snap.unique_prefix(readings, values, "reading")
    letters = lambda t: "".join(c for c in t.lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789")
    asked = {r[0] for r in readings.collect() if r[0] is not None and len(letters(r[0])) >= 6}
    hits = {r: [t for t in texts if letters(t).startswith(letters(r))] for r in asked}
    assert sorted(tuple(r) for r in got.collect()) == sorted((r, h[0]) for r, h in hits.items() if len(h) == 1)
    assert "min(value" not in got._jdf.queryExecution().optimizedPlan().toString()  # beginnings are counted by hashes, not with every pair's texts
