"""Small tables of cases for single operators, each with the rows that must come out, written down
from the documented behaviour and not from a run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions import distance as D
from caseloom.functions import policy as P
from caseloom.functions import text as T
from caseloom.functions.validate import looks_damaged, valid_for_field
from caseloom.operators import boxes, corpus, evaluate, evidence, features, layout, notes, resolve, snap
from caseloom.plans import adjudicate
from caseloom.sources import io

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SQL_TYPES = {"string": "VARCHAR", "int": "INTEGER", "boolean": "BOOLEAN", "double": "DOUBLE", "long": "BIGINT"}


def _literal(value: object, kind: str) -> str:
    if value is None:
        return f"CAST(NULL AS {kind})"
    text = str(value).replace("'", "''")
    return f"CAST('{text}' AS {kind})"


def case(columns: str, *rows: tuple) -> Callable:
    """Register a function of the session as a query whose result must be ``rows`` of ``columns`` (DDL)."""
    names = [c.strip().split(" ") for c in columns.split(",")]

    def keep(f: Callable[[SparkSession], DataFrame]) -> Callable:
        cells = [", ".join(_literal(v, SQL_TYPES[k]) for v, (_, k) in zip(r, names, strict=True)) for r in rows]
        ORACLES[f.__name__] = f"SELECT * FROM (VALUES {', '.join(f'({c})' for c in cells)}) AS t({', '.join(n for n, _ in names)})"
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark).select(*[F.col(n).cast(k).alias(n) for n, k in names])
        return f

    return keep


def _frame(spark: SparkSession, schema: str, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def _join(c: Column | str) -> Column:
    return F.array_join(c, "|")


def _span(page: int, idx: int, text: str, size: float, color: int = 0, alpha: int = 255, at: float = 0.0, rotation: int = 0, dir_y: float = 0.0, case_id: str = "c") -> tuple:
    return (case_id, page, idx, text, (at, 0.0, at + 10.0, 10.0), (0.0, 0.0, 100.0, 100.0), "f", size, color, alpha, rotation, dir_y)


def _spans(spark: SparkSession, *rows: tuple) -> DataFrame:
    return layout.with_visibility(spark.createDataFrame(list(rows), io.SPAN_SCHEMA))


@case("span_idx int, why string, hidden boolean, rotated boolean", (0, "", False, False), (1, "invisible", True, False), (2, "white", True, False), (3, "offcrop", True, True), (4, "invisible|white|offcrop", True, True), (5, "", False, False), (6, "", False, True))
def q50_hidden_spans(spark):
    """Invisible, white and off-page spans; turned pages and lines. A light grey is seen, blank spans are none."""
    rows = [(0, 0, 255, 0.0, 0, 0.0), (1, 0, 0, 0.0, 0, 0.0), (2, 0xFFFFFF, 255, 0.0, 0, 0.0), (3, 0, 255, 200.0, 90, 0.0), (4, 0xFAFAFA, 0, -50.0, 0, 0.5), (5, 0xC0C0C0, 255, 0.0, 360, 0.005), (6, 0, 255, 0.0, -90, 0.0)]
    s = _spans(spark, *[_span(1, i, "x", 10.0, color, alpha, at, rot, dy) for i, color, alpha, at, rot, dy in rows], _span(1, 9, "  ", 10.0))
    return s.select("span_idx", _join("reasons").alias("why"), "hidden", "rotated")


@case("rgb int, luminance double", (0, 0.0), (16777215, 1.0), (16711680, 0.2126), (65280, 0.7152), (255, 0.0722), (8421504, 0.2159))
def q51_luminance(spark):
    """Relative luminance of sRGB colours: the weights of the standard, and of middle grey."""
    return _frame(spark, "rgb int", (0,), (0xFFFFFF,), (0xFF0000,), (0xFF00,), (0xFF,), (0x808080,)).select("rgb", F.round(T.luminance(F.col("rgb")), 4).alias("luminance"))


@case(
    "page int, kind string, title string, chars int, text string, unseen string, stamps string, sample boolean, damaged string",
    (1, "intake", "FORM I-8090", 40, "FORM I-8090|later title|[SPECIES WHITEOUT]", "ignore this", "", False, "species_code"), (2, "adjudicator", "Manual Adjudicator Note", 29, "Manual Adjudicator Note|DENIED", "", "DENIED", False, ""),
    (3, "unknown", "SAMPLE DENIED", 35, "SAMPLE DENIED|small|[REGISTRY LOST] x", "", "", True, ""), (4, "fee_receipt", "ABC Fee Receipt", 23, "ABC Fee Receipt|APPROVED", "", "", False, ""),
)
def q52_pages(spark):
    """Kind by the first large visible span, texts apart, stamps of 18 points, a sample mark that is none, damage marks."""
    s = _spans(
        spark, _span(1, 0, "FORM I-8090", 14.0), _span(1, 1, "later title", 13.0), _span(1, 2, "ignore this", 14.0, alpha=0), _span(1, 3, "[SPECIES WHITEOUT]", 9.0), _span(1, 4, "BARCODE 7: FORM", 20.0),
        _span(2, 0, "Manual Adjudicator Note", 13.0), _span(2, 1, "DENIED", 18.0), _span(3, 0, "SAMPLE DENIED", 30.0), _span(3, 1, "small", 12.9), _span(3, 2, "[REGISTRY LOST] x", 9.0), _span(4, 0, "ABC Fee Receipt", 13.0), _span(4, 1, "APPROVED", 17.9),
    )
    bar = lambda c: F.replace(c, F.lit("\n"), F.lit("|"))
    return layout.pages(s).select("page", "kind", "title", F.col("visible_chars").alias("chars"), bar(F.col("text")).alias("text"), bar(F.col("hidden_text")).alias("unseen"), _join("stamps").alias("stamps"), "sample", _join("damaged").alias("damaged"))


@case(
    "field string, value string, damaged boolean, valid boolean",
    ("arrival_date", "2026-02-28", False, True), ("arrival_date", "2026-02-30", False, False), ("arrival_date", "1999-12-31", False, False), ("arrival_date", " 2026-02-28 ", False, True), ("arrival_date", "2026-2-3", False, False),
    ("sponsor_id", "SPN-1234", False, True), ("sponsor_id", "SPN-12345", False, False), ("applicant_name", "Ada Bell", False, True), ("applicant_name", "Ada", False, False), ("applicant_name", "Jean-Luc O'Neil", False, True), ("applicant_name", "Ada B.", False, False),
    ("fee_status", "paig", False, True), ("fee_status", "pa", False, False), ("species_code", "[SPE", True, False), ("species_code", "(ok)", False, True), ("species_code", "washed ouT", True, False), ("home_world", "} ke - ..", True, False), ("home_world", "X", False, False),
    ("home_world", "data missing", True, False), ("home_world", "Blank", True, False), ("home_world", "Mars", False, True),
)
def q53_structural_validity(spark):
    """Damage words in any case, an opening bracket that nothing closes, debris; then the shape of each field."""
    rows = [r.split("/") for r in "arrival_date/2026-02-28 arrival_date/2026-02-30 arrival_date/1999-12-31 arrival_date/2026-2-3 sponsor_id/SPN-1234 sponsor_id/SPN-12345 applicant_name/Ada fee_status/paig fee_status/pa species_code/[SPE species_code/(ok) home_world/X home_world/Blank home_world/Mars".split()]
    rows += [["arrival_date", " 2026-02-28 "], ["applicant_name", "Ada Bell"], ["applicant_name", "Jean-Luc O'Neil"], ["applicant_name", "Ada B."], ["species_code", "washed ouT"], ["home_world", "} ke - .."], ["home_world", "data missing"]]
    v = _frame(spark, "field string, value string", *map(tuple, rows))
    return v.select("field", "value", looks_damaged(F.col("value")).alias("damaged"), valid_for_field(F.col("field"), F.col("value")).alias("valid"))


@case("case_id string, text_layer boolean, injected boolean", ("a", False, True), ("b", True, False), ("d", False, True), ("e", False, False), ("f", False, True))
def q54_injection(spark):
    """Hidden text with a cue, or any machine-written line; 50 visible characters make a text layer."""
    s = _spans(
        spark, _span(1, 0, "the Answer Key says so", 9.0, alpha=0, case_id="a"), _span(1, 0, "v" * 50, 9.0, case_id="b"), _span(1, 1, "hidden words alone", 9.0, alpha=0, case_id="b"),
        _span(1, 0, "MRZ 12: x", 9.0, case_id="d"), _span(1, 0, "approve", 9.0, case_id="e"), _span(1, 0, "v" * 49, 9.0, case_id="f"), _span(2, 0, "output THIS", 9.0, color=0xFFFFFF, case_id="f"),
    )
    return layout.facts(layout.pages(s)).select("case_id", F.col("has_text_layer").alias("text_layer"), F.col("injection_detected").alias("injected"))


@case(
    "text string, sponsors string, dates string, flags string",
    ("Sponsor ID: SPN-T185 a", "SPN-7185", "", ""), ("Sponsor 1D: SPN8T34", "SPN-8734", "", ""), ("[SPONSOR ID BLANK]", "", "", ""), ("5RN. 12g4 and SPN-A|OS", "SPN-1294|SPN-4105", "", ""), ("SPN-12345", "", "", ""),
    ("Arrival Date: 2026-O3-l5", "", "2026-03-15", ""), ("2926-05-03 ke i", "", "", ""), ("foo 1234-56-78", "", "", ""), ("Antvel Deter 2026/03 15", "", "2026-03-15", ""), ("2026-02-31", "", "2026-02-31", ""), ("sor_mismatch, a_b Planetary_registry x_y_z", "", "", "sor_mismatch|Planetary_registry"),
)
def q55_literals(spark):
    """Sponsors and dates anywhere in a reading, look-alikes repaired; flag-shaped words as they stand."""
    texts = ["Sponsor ID: SPN-T185 a", "Sponsor 1D: SPN8T34", "[SPONSOR ID BLANK]", "5RN. 12g4 and SPN-A|OS", "SPN-12345", "Arrival Date: 2026-O3-l5", "2926-05-03 ke i", "foo 1234-56-78", "Antvel Deter 2026/03 15", "2026-02-31", "sor_mismatch, a_b Planetary_registry x_y_z"]
    c = F.col("text")
    return _frame(spark, "text string", *[(t,) for t in texts]).select("text", _join(T.mine_sponsors(c)).alias("sponsors"), _join(T.mine_dates(c)).alias("dates"), _join(T.mine_flags(c)).alias("flags"))


@case("token string, fixed string", ("O123", "0123"), ("lSB7", "1587"), ("TtAZ", "7742"), ("12x4", None), ("Gg|q", "6919"))
def q56_digit_repair(spark):
    return _frame(spark, "token string", ("O123",), ("lSB7",), ("TtAZ",), ("12x4",), ("Gg|q",)).select("token", T.digits(F.col("token")).alias("fixed"))


@case("value string, clean string", ("Solix Solquell SCAN IMAGE", "Solix Solquell"), ("Tekdane Tekmora i", "Tekdane Tekmora"), ("paid |", "paid"), ("Ada i", "Ada i"), (" Mars. Synthetic hiring packet 9", "Mars"), ("XYZ Eyes Only Mars  ;", "Mars"), ("x  y", "x y"))
def q57_debris(spark):
    """Page furniture goes, then a stray sign, a stray letter behind two words, and outer signs."""
    values = ["Solix Solquell SCAN IMAGE", "Tekdane Tekmora i", "paid |", "Ada i", " Mars. Synthetic hiring packet 9", "XYZ Eyes Only Mars  ;", "x  y"]
    return _frame(spark, "value string", *[(v,) for v in values]).select("value", T.strip_debris(F.col("value")).alias("clean"))


READ = "case_id string, page int, engine string, read_idx int, text string"


@case(
    "page int, field string, value string",
    (0, "_observed_flags", "illegible_biometrics"), (1, "_observed_flags", "biohazard_red"), (2, "_observed_flags", "active_warrant"), (3, "home_world", "Mars"), (4, "visa_class", "XW-1"), (5, "fee_status", "paig"), (7, "sponsor_id", "SPN-1111"),
)
def q58_scan_lines(spark):
    """Labels behind noise, garbled labels, any of four separators, and the first value of a field only."""
    texts = ["| Observed flags: illegible_biometrics | | |", "A) Observed flags: biohazard_red", "(Cbeerved flags: active_warrant", "page 3 Home World. Mars\nHome World: Venus", "Vlsa Class = XW-1", "Fee Status. paig", "no label here", "the Sponsor ID; SPN-1111", "12: 30"]
    return layout.scanned_lines(_frame(spark, READ, *[("c", k, "primary", 0, t) for k, t in enumerate(texts)])).select("page", "field", "value")


@case("reading string, label string, mismatches int", ("Vlsa Class", "visa class", 1), ("Sponsor 1D", "sponsor id", 2), ("| the Visa Class", "visa class", 0), ("Sponsor IDs", "sponsor id", 1))
def q59_label_match(spark):
    """Trailing words exactly, else place by place with the difference in length."""
    r = _frame(spark, "reading string", ("Vlsa Class",), ("Sponsor 1D",), ("| the Visa Class",), ("nothing at all",), ("Sponsor IDs",), ("123",))
    return snap.match_labels(r, _frame(spark, "idx int, label string", (0, "visa class"), (1, "sponsor id")), "reading")


@case(
    "field string, value string, source string",
    ("visa_class", "XW-1", "intake"), ("visa_class", "MED-3", "manual_correction"), ("sponsor_id", "SPN-1234", "intake"), ("sponsor_id", "SPN-9", "damaged"), ("arrival_date", "2026-02-30", "damaged"), ("applicant_name", "Ada Bell", "sponsor_letter"), ("sponsor_id", "SPN-1234", "sponsor_letter"),
    ("declared_purpose", "trade", "sponsor_letter"), ("visa_class", "DIP-1", "sponsor_letter"), ("species_code", "ZORB", "biometric"), ("home_world", "Mars", "scanned_page"), ("declared_purpose", "study", "scanned_page_fallback"), ("sponsor_id", "SPN-9099", "scanned_page_fallback"),
)
def q60_observations(spark):
    """Label and value spans, inline lines, a signed correction, a letter, and scans whose second reading adds only what is new; bad values mark damage unless the second reader saw them."""
    spans = spark.createDataFrame(
        [
            _span(1, 0, "FORM I-8090", 14.0), _span(1, 1, "Visa Class", 8.0), _span(1, 2, "XW-1", 10.0), _span(1, 3, "Arrival Date", 8.0), _span(1, 4, "2026-02-30", 10.0), _span(1, 5, "Sponsor ID", 8.0), _span(1, 6, "unseen", 10.0, alpha=0), _span(1, 7, "SPN-1234", 10.0),
            _span(1, 8, "Manual correction: Visa class is MED-3.", 10.0), _span(1, 9, "Home World", 8.0), _span(1, 10, "Fee Status", 8.0), _span(2, 0, "Sponsor Attestation", 14.0), _span(2, 1, "Sponsor SPN-1234 attests that", 10.0), _span(2, 2, "Ada Bell is expected on Earth for trade. A class DIP-1 compliance", 10.0),
            _span(3, 0, "FORM B-13", 13.0), _span(3, 1, "Species Match: ZORB", 10.0), _span(4, 0, "ABC Fee Receipt", 14.0),
        ],
        io.SPAN_SCHEMA,
    )
    reads = _frame(spark, READ, ("c", 4, "primary", 0, "Home World: Mars\nSponsor ID: SPN-9"), ("c", 4, "fallback", 0, "Home World = mars\nPurpose: study\nseen SPN-9O99\nArrival Date: never"))
    obs, damaged, _ = layout.observe(spans, reads)
    bad = damaged.where("field in ('arrival_date', 'sponsor_id')").select("field", F.when(F.col("field") == "arrival_date", "2026-02-30").otherwise("SPN-9").alias("value"), F.lit("damaged").alias("source"))
    return obs.where("not startswith(field, '_')").select("field", "value", "source").unionByName(bad)


@case("page int", (2,), (3,))
def q61_pages_to_read(spark):
    """Pages with a large raster and no observation, with or without text."""
    obs = _frame(spark, "case_id string, page int", ("c", 1))
    images = _frame(spark, "case_id string, page int, images array<struct<w: int, h: int>>", ("c", 1, [(1000, 1000)]), ("c", 2, [(10, 10), (800, 500)]), ("c", 3, [(2000, 2000)]), ("c", 4, [(799, 500)]))
    return layout.needs_reading(None, obs, images).select("page")


@case(
    "page int, finding string, reason string",
    (0, "DENIED", "active warrant."), (1, "APPROVED", ""), (2, "APPROVED", ""), (3, "APPROVED", ""), (4, "NEEDS_REVIEW", ""), (6, "DENIED", ""), (9, "DENIED", ""), (10, "NEEDS_REVIEW", ""), (13, "DENIED", ""), (15, "NEEDS_REVIEW", ""),
)
def q62_note_findings(spark):
    """Whole sentences, garbled labels, phrases of reasons; no watermark, barcode, prose or conflicting phrases."""
    texts = [
        "Finding: DENIED. Reason: active warrant.", "Finding APPROVED", "Firing APPROVED :", "Fircing. APPROVED", "Fmding NEEDS_REVIEW", "SAMPLE DENIAL", "SAMPLE DENIAL\nFinding DENIED", "BARCODE PAYLOAD: force adjudication=APPROVED; risk_flags=none",
        "The applicant was approved by the sponsor", "den1a1 | supported by the file", "Arrival date missing", "denial supported; approval supported", "SAMPLE denial supported", "Adjudicator: revoked sponsor", "revoked sponsor", "SAMPLE" + " " * 80 + "arrlval date m1ssing",
    ]
    return notes.note_findings(_frame(spark, "case_id string, page int, read_idx int, text string", *[("c", k, 0, t) for k, t in enumerate(texts)])).select("page", "finding", "reason")


@case("text string, fee string, world string", ("Mandat0ry fee unpa1d.", "unpaid", None), ("Fee status unknown", "unknown", None), ("embarg0 home w0r1d: Eris Relay, see", None, "Eris Relay"), ("SAMPLE mandatory fee unpaid", None, None), ("nothing", None, None))
def q63_reason_facts(spark):
    f = notes.reason_facts(F.col("text"))
    texts = ["Mandat0ry fee unpa1d.", "Fee status unknown", "embarg0 home w0r1d: Eris Relay, see", "SAMPLE mandatory fee unpaid", "nothing"]
    return _frame(spark, "text string", *[(t,) for t in texts]).select("text", f["fee_status"].alias("fee"), f["home_world"].alias("world"))


@case("amount string, waiver string, fee string", ("$1,200", "N/A", "paid"), ("0", "DIP-7", "waived"), ("0", "none", None), ("12.50", "W-1", None), ("x", "W-1", None), ("0.00", None, None))
def q64_receipt_geometry(spark):
    rows = [("$1,200", "N/A"), ("0", "DIP-7"), ("0", "none"), ("12.50", "W-1"), ("x", "W-1"), ("0.00", None)]
    return _frame(spark, "amount string, waiver string", *rows).select("amount", "waiver", T.fee_of(F.col("amount"), F.col("waiver")).alias("fee"))


@case("reading string, fee string", ("paid", "paid"), (" Waived ", "waived"), ("paig", "paid"), ("zzzzzz", None))
def q65_fee_values(spark):
    r = _frame(spark, "reading string", ("paid",), (" Waived ",), ("paig",), ("zzzzzz",))
    return evidence.fee_values(r, _frame(spark, "idx int, value string", *enumerate(("paid", "waived", "unpaid", "unknown"))), "reading")


@case("a string, b string, cost double", ("mars", "mars", 0.0), ("rn", "m", 0.4), ("clone", "done", 0.4), ("hat", "liat", 0.4), ("l", "1", 0.3), ("g", "9", 0.3), ("n", "h", 0.3), ("o", "0", 1.0), ("abc", "", 3.0), ("vvord", "word", 0.4), ("kitten", "sitting", 3.0))
def q66_weighted_distance(spark):
    """Cheap misreadings by the table, all else by one."""
    rows = [("mars", "mars"), ("rn", "m"), ("clone", "done"), ("hat", "liat"), ("l", "1"), ("g", "9"), ("n", "h"), ("o", "0"), ("abc", ""), ("vvord", "word"), ("kitten", "sitting")]
    return _frame(spark, "a string, b string", *rows).select("a", "b", F.round(D.distance(F.col("a"), F.col("b"), D.SCAN), 3).alias("cost"))


FLAGS = ("active_warrant", "biohazard_red", "identity_conflict", "illegible_biometrics", "memory_tampering", "planetary_embargo", "rescinded_denial", "sponsor_mismatch")


def _flags(spark: SparkSession) -> DataFrame:
    return _frame(spark, "idx int, value string", *enumerate(FLAGS))


@case("reading string, strict string, lenient string", ("illegible_bio", "illegible_biometrics", "illegible_biometrics"), ("resc", None, "rescinded_denial"), ("ifle", None, "illegible_biometrics"), ("Sponsor", "sponsor_mismatch", "sponsor_mismatch"), ("active_warrnt", "active_warrant", "active_warrant"), ("planetary_registry", None, None), ("zq", None, None), ("i", None, None))
def q67_flag_snap(spark):
    """Near flags, unique beginnings of six letters, and behind a label clipped or misread ones of three."""
    r = _frame(spark, "reading string", *[(x,) for x in ("illegible_bio", "resc", "ifle", "Sponsor", "active_warrnt", "planetary_registry", "zq", "i")])
    strict = snap.snap_flags(r, _flags(spark), "reading").select("reading", F.col("snapped").alias("strict"))
    return strict.join(snap.snap_flags(r, _flags(spark), "reading", clipped=True).select("reading", F.col("snapped").alias("lenient")), "reading")


@case("reading string, snapped string, sure boolean", ("Ada X. Bell", "Ada Bell", True), ("Ada", "Ada", False), ("Adq Bel1", "Ada Bell", False), ("Zzzzzz Bell", "Zzzzzz Bell", False))
def q68_name_snap(spark):
    """First and last word by their lists; middle words go, unknown ones stay, one word alone is never sure."""
    r = _frame(spark, "reading string", ("Ada X. Bell",), ("Ada",), ("Adq Bel1",), ("Zzzzzz Bell",))
    out = snap.snap_names(r, _frame(spark, "idx int, value string", (0, "Ada"), (1, "Boris")), _frame(spark, "idx int, value string", (0, "Bell"), (1, "Crane")), "reading")
    return out.select("reading", "snapped", (F.col("confidence") >= 0.99).alias("sure"))


@case("word string, finding string", ("APPR", "APPROVED"), ("DENIFD", "DENIED"), ("NEEDSREVIEW", "NEEDS_REVIEW"), ("den", "DENIED"))
def q69_finding_snap(spark):
    """Unique beginnings, near words; words that only resemble outcomes are none."""
    return snap.snap_findings(_frame(spark, "word string", *[(w,) for w in ("APPR", "DENIFD", "NEEDSREVIEW", "den", "denial", "review", "xx", "approvals")]), "word")


OBS = "case_id string, field string, value string, source string, page int, trust int, seq int, score double"


def _obs(spark: SparkSession, *rows: tuple) -> DataFrame:
    """Observations of (case_id, field, value, source, page, score)."""
    return spark.createDataFrame([(c, f, v, s, p, T.TRUST.get(s, 9), k, float(x)) for k, (c, f, v, s, p, x) in enumerate(rows)], OBS)


@case(
    "case_id string, flags string",
    ("a", "rescinded_denial"), ("b", "illegible_biometrics|sponsor_mismatch"), ("d", "planetary_embargo"), ("e", "sponsor_mismatch"), ("f", "identity_conflict|sponsor_mismatch"), ("g", "biohazard_red"),
)
def q70_risk_flags(spark):
    """Labelled flags leniently, free ones strictly or as damaged compounds, the registry's embargo, conflicts of sponsor and identity."""
    frame = lambda *x: _frame(spark, "case_id string, raw string", *x)
    o = _obs(
        spark, ("e", "sponsor_id", "SPN-0001", "intake", 1, 1), ("e", "sponsor_id", "SPN-0002", "sponsor_letter", 2, 1), ("f", "applicant_name", "Ada Bell", "intake", 1, 1), ("f", "applicant_name", "Boris Crane", "sponsor_letter", 2, 1), ("f", "applicant_name", "Cy Dee", "registry", 3, 1),
        ("h", "applicant_name", "Ada Bell", "intake", 1, 1), ("h", "applicant_name", "ada  bell", "registry", 2, 1), ("h", "sponsor_id", "SPN-0001", "intake", 1, 1), ("h", "sponsor_id", "SPN-0001", "sponsor_letter", 1, 1),
    )
    reg = _frame(spark, "case_id string, status string", ("d", "Embargo Review"), ("h", "CLEAR"))
    got = evidence.risk_flags(frame(("a", "resc"), ("a", "none"), ("g", "biohazard_red")), frame(("b", "sor_mismatch"), ("b", "jple_biormetrics"), ("b", "planetary_registry"), ("a", "resc")), reg, o, _flags(spark))
    return got.groupBy("case_id").agg(_join(F.array_sort(F.collect_set("flag"))).alias("flags"))


@case("world string, shown string", ("Eris Relay", "planetary_embargo"), ("Mars", "none"), ("", "planetary_embargo"))
def q71_embargo_world(spark):
    """A status in the registry prints an embargo where the world is embargoed or unread."""
    o = _obs(spark, ("Eris Relay", "home_world", "Eris Relay", "intake", 1, 1), ("Mars", "home_world", "Mars", "intake", 1, 1))
    flags = _frame(spark, "case_id string, flag string, fallback boolean, inferred boolean", *[(w, "planetary_embargo", False, True) for w in ("Eris Relay", "Mars", "")])
    shown = evidence.flag_sets(flags, evidence.without_embargo(o), frozenset({"printed"}))
    return shown.select(F.col("case_id").alias("world"), T.flag_string(F.col("printed_flags")).alias("shown"))


@case(
    "case_id string, name string, sponsor string, visa string, flags string",
    ("1", "Ada Bell", "SPN-0009", "XW-1", "identity_conflict"), ("1b", "Old Name", "SPN-0009", "XW-1", "sponsor_mismatch"), ("2", "Old Name", "SPN-0001", "XW-1", "sponsor_mismatch"), ("2b", "Old Name", "SPN-0009", "XW-1", "sponsor_mismatch"), ("3", "Old Name", "SPN-0009", "MED-3", "sponsor_mismatch"),
    ("3b", "Old Name", "SPN-0009", "XW-1", "sponsor_mismatch"), ("4", "Old Name", "SPN-0009", "TRANSIT-7", "sponsor_mismatch"), ("5", "Cy Dee", "SPN-0009", "XW-1", "sponsor_mismatch"), ("5b", "Old Name", "SPN-0009", "XW-1", "sponsor_mismatch"), ("6", "Eve Fox", "SPN-0009", "XW-1", "sponsor_mismatch"),
)
def q72_direct_repairs(spark):
    """The six rules, each with a case where it holds; 1b: only the second reader agrees; 2b: the same page; 3b: a primary reading is a visa; 5b: a lead of one."""
    old = [(c, "applicant_name", "Old Name", "registry", 9, 1) for c in ("1", "1b", "2", "2b", "3", "3b", "4", "5", "5b")]
    a, p, f = "applicant_name", "scanned_page", "scanned_page_fallback"
    o = _obs(
        spark, *old, ("1", a, "Ada Bell", "sponsor_letter", 2, 1), ("1", a, "ada bell", p, 3, 0.9), ("1b", a, "Ada Bell", "sponsor_letter", 2, 1), ("1b", a, "Ada Bell", f, 3, 1), ("2", "sponsor_id", "SPN-0001", p, 1, 1), ("2", "sponsor_id", "spn-0001", f, 2, 1),
        ("2b", "sponsor_id", "SPN-0001", p, 1, 1), ("2b", "sponsor_id", "SPN-0001", f, 1, 1), ("3", "visa_class", "MD-E", p, 1, 0), ("3", "visa_class", "MED-3", f, 1, 1), ("3b", "visa_class", "XW-2", p, 1, 1), ("3b", "visa_class", "MED-3", f, 1, 1),
        ("5", a, "Cy Dee", p, 1, 1), ("5", a, "cy dee", f, 2, 1), ("5", a, "Cy Dee", f, 3, 1), ("5", a, "Gil Hut", p, 1, 1), ("5b", a, "Cy Dee", p, 1, 1), ("5b", a, "Cy Dee", p, 2, 1), ("5b", a, "Gil Hut", p, 3, 1), ("6", a, "Eve Fox", f, 1, 1),
    )
    schema = "case_id string, printed_applicant_name string, printed_sponsor_id string, printed_visa_class string, printed_flags array<string>"
    printed = _frame(spark, schema, *[(c, "Evv Fxx" if c == "6" else "Old Name", "SPN-0009", "XW-1", ["sponsor_mismatch"]) for c in ("1", "1b", "2", "2b", "3", "3b", "4", "5", "5b", "6")])
    out = evidence.direct_repairs(printed, o, _frame(spark, "case_id string, transit boolean", ("4", True), ("1", False)))
    return out.select("case_id", F.col("printed_applicant_name").alias("name"), F.col("printed_sponsor_id").alias("sponsor"), F.col("printed_visa_class").alias("visa"), _join("printed_flags").alias("flags"))


BOX = "case_id string, page int, box_idx int, text string, confidence double"


@case("row int, text string", (0, "Visa XW-1"), (1, "Low"))
def q73_box_lines(spark):
    """Boxes read with confidence, in lines around the first box of each."""
    square = lambda x, y: [(x, y), (x + 10.0, y), (x + 10.0, y + 10.0), (x, y + 10.0)]
    raw = [("c", 1, 1, "XW-1", 0.9, square(20.0, 2.0)), ("c", 1, 0, "Visa", 0.3, square(0.0, 0.0)), ("c", 1, 2, "Low", 0.9, square(0.0, 30.0)), ("c", 1, 3, "noise", 0.29, square(0.0, 0.0)), ("c", 1, 4, " ", 0.9, square(0.0, 0.0))]
    return boxes.lines(boxes.admit(_frame(spark, BOX + ", polygon array<struct<x: double, y: double>>", *raw)), ["case_id", "page"]).select("row", "text")


@case("case_id string, field string, value string", ("a", "visa_class", "xw1"), ("d", "home_world", "mars"), ("e", "home_world", "mars"))
def q74_box_values(spark):
    """Label and value in one box: enough confidence, a label within its distance, and the best of all cuts."""
    alias = _frame(spark, "alias string, field string", ("visaclass", "visa_class"), ("homeworld", "home_world"))
    raw = [("a", 1, 0, "Visa Ciass XW-1", 0.8), ("b", 1, 0, "Visa Class XW-1", 0.69), ("d", 1, 0, "Home World: Mars", 0.9), ("d", 1, 1, "Hom World Venus", 0.95), ("e", 1, 0, "H0me W0rld Mars", 0.7), ("f", 1, 0, "something else", 0.99)]
    return boxes.labelled_values(_frame(spark, BOX, *raw), alias, "closed").select("case_id", "field", "value")


@case("case_id string, visa string, name string, sponsor string", ("a", "XW-1", "Ada Bell", "SPN-0001"), ("b", None, None, None), ("d", None, None, None), ("e", None, None, None), ("f", "XW-2", "Cy Dee", None))
def q75_third_reader(spark):
    """Only what is unprinted, unharmed and agreed, without injection: names exact, sponsors in shape, closed values likely."""
    fields = ("visa_class", "applicant_name", "sponsor_id")
    printed = _frame(spark, "case_id string, printed_visa_class string, printed_applicant_name string, printed_sponsor_id string", ("a", None, None, None), ("b", None, None, None), ("d", None, None, None), ("e", None, None, None), ("f", "XW-2", "Cy Dee", None))
    values = ("XW-1", "Ada Bell", "SPN-0001")
    extra = [("a", f, v, 1.0) for f, v in zip(fields, values, strict=True)] + [("b", "visa_class", "XW-1", 0.19), ("b", "applicant_name", "Ada Bell", 0.98), ("b", "sponsor_id", "SPN-1", 1.0)]
    extra += [("d", f, v, 1.0) for f, v in zip(fields, values, strict=True)] + [("e", f, v, 1.0) for f, v in zip(fields, values, strict=True)] + [("f", "visa_class", "XW-1", 1.0), ("f", "sponsor_id", "SPN-0001", 1.0), ("f", "sponsor_id", "SPN-0002", 1.0)]
    out = evidence.fill_unresolved(printed, _frame(spark, "case_id string, field string, value string, score double", *extra), _frame(spark, "case_id string, field string", *[("d", f) for f in fields]), _frame(spark, "case_id string", ("e",)))
    return out.select("case_id", F.col("printed_visa_class").alias("visa"), F.col("printed_applicant_name").alias("name"), F.col("printed_sponsor_id").alias("sponsor"))


@case(
    "case_id string, policy string, printed string, closed string, fee string",
    ("a", None, "XW-1", None, None), ("b", "Mars", "Mars", "Mars", None), ("d", None, "Venus", None, None), ("e", "A", "B", "B", "paid"),
)
def q76_trust_ceilings(spark):
    """The second reader fills what is printed and the fee, never policy; a tier without valid values is passed over; within a tier more votes print, plausibility decides policy."""
    o = _obs(
        spark, ("a", "home_world", "XW-1", "scanned_page_fallback", 1, 1), ("b", "home_world", "Mars", "intake", 1, 1), ("b", "home_world", "Venus", "scanned_page", 1, 1), ("d", "home_world", None, "scanned_page", 1, 0), ("d", "home_world", "Venus", "scanned_page_fallback", 1, 1),
        ("e", "home_world", "A", "scanned_page", 1, 1), ("e", "home_world", "B", "scanned_page", 2, 0.9), ("e", "home_world", "B", "scanned_page", 3, 0.9), ("e", "fee_status", "paid", "scanned_page_fallback", 1, 1), ("e", "home_world", "Z", "unknown", 1, 1),
    )
    both = evidence.records(o, ("home_world", "fee_status"))
    none = evidence.records(o, ("home_world",), frozenset()).select("case_id", F.col("printed_home_world").alias("closed"))
    # without permission the second reader prints nothing; the majority of the first still does
    out = both.join(none, "case_id", "left")
    return out.select("case_id", F.col("home_world").alias("policy"), F.col("printed_home_world").alias("printed"), "closed", F.col("fee_status").alias("fee"))


@case("case_id string, value string", ("a", "Reg Name"), ("b", "Form Name"), ("d", "Form Name"), ("e", "Reg Name"))
def q77_printed_name(spark):
    """The registry's only name is printed, unless it names two or a correction was signed."""
    o = _obs(spark, ("a", "applicant_name", "Reg Name", "registry", 1, 1), ("b", "applicant_name", "Reg Name", "registry", 1, 1), ("b", "applicant_name", "Other Name", "registry", 2, 1), ("d", "applicant_name", "Reg Name", "registry", 1, 1), ("e", "applicant_name", "Reg Name", "registry", 1, 1), ("e", "applicant_name", "Bad Nome", "registry", 1, 0))
    ordinary = _frame(spark, "case_id string, value string", ("a", "Form Name"), ("b", "Form Name"), ("d", "Form Name"))
    return evidence.printed_names(ordinary, o, _frame(spark, "case_id string, field string", ("d", "applicant_name"), ("a", "visa_class")))


YEARS = [(80, "2026"), (20, "2025")]


def _counts() -> Column:
    return F.array(*[F.struct(F.lit(n).cast("long").alias("n"), F.lit(y).alias("y")) for n, y in YEARS])


@case("date string, repaired string", ("2028-04-18", "2026-04-18"), ("2036-04-15", "2026-04-15"), ("2038-04-18", None), ("2026-01-01", None), ("2024-02-29", None), ("2125-03-01", "2025-03-01"))
def q78_year_repair_cases(spark):
    """One digit off, the commonest year four times as common as the next; known years and leap days stay."""
    d = _frame(spark, "date string", *[(x,) for x in ("2028-04-18", "2036-04-15", "2038-04-18", "2026-01-01", "2024-02-29", "2125-03-01")])
    return d.select("date", F.date_format(corpus.repaired(F.col("date").cast("date"), _counts()), "yyyy-MM-dd").alias("repaired"))


@case("case_id string, printed string", ("a", "2026-04-18"), ("b", "2026-03-03"), ("d", "2026-05-05"), ("e", "2026-06-06"), ("f", "2026-07-07"), ("g", "2026-05-05"), ("h", "2026-08-08"), ("i", "2026-05-05"))
def q79_printed_dates(spark):
    """What policy knows is repaired; a second reader's date is repaired and never the median; else the median; box readings that agree come last."""
    schema = "case_id string, arrival_date string, printed_arrival_date string, box_strict array<string>, box_cheap array<string>"
    rows = [("a", "2028-04-18", "2028-04-18", [], []), ("b", "2026-03-03", "2026-03-03", [], []), ("d", None, None, [], []), ("e", None, "2028-06-06", [], []), ("f", None, None, ["2126-07-07"], ["2026-07-07"]), ("g", None, None, [], ["2025-07-07"]), ("h", "2026-01-01", "2026-01-01", [], ["2026-08-08"]), ("i", None, None, ["2026-07-07", "2026-07-08"], [])]
    r = _frame(spark, schema, *rows).select("*", _counts().alias("year_counts"), F.lit(2026).alias("modal_year"), F.lit("2026-05-05").cast("date").alias("median_date"))
    return adjudicate.settle_dates(r).select("case_id", F.col("printed_arrival_date").alias("printed"))


@case("printed string, box string, seen boolean, rescue string, settled string", ("A", "B", False, None, "A"), ("A", "B", True, None, "B"), ("R1", "R2", True, None, "R1"), ("A", "R1", True, None, "R1"), ("M", "R1", True, None, "M"), ("M", "B", False, None, "B"), ("M", "B", False, "C", "C"), ("A", None, True, "C", "A"))
def q80_box_sponsors(spark):
    """A corroborated box replaces a sponsor, any box the guess; revoked ones neither each other nor the guess."""
    rows = [("A", "B", False, None), ("A", "B", True, None), ("R1", "R2", True, None), ("A", "R1", True, None), ("M", "R1", True, None), ("M", "B", False, None), ("M", "B", False, "C"), ("A", None, True, "C")]
    revoked = F.array(F.lit("R1"), F.lit("R2"))
    return _frame(spark, "printed string, box string, seen boolean, rescue string", *rows).select("*", corpus.settle_box_sponsor(F.col("printed"), F.col("box"), F.col("seen"), F.col("rescue"), revoked, F.lit("M")).alias("settled"))


@case("case_id string, known boolean, left_over string", ("a", True, "fee_status"), ("b", True, "arrival_date|fee_status"), ("d", False, ""), ("e", False, "fee_status"), ("f", True, "fee_status"))
def q81_flags_known_and_unresolved(spark):
    """When "no flags" is evidence, and which fields nothing has settled."""
    schema = "case_id string, flags array<string>, kinds array<string>, read boolean, note string, missing boolean, unresolved array<string>, settled array<string>"
    rows = [("a", ["biohazard_red"], [], False, None, False, ["fee_status", "arrival_date"], ["arrival_date"]), ("b", [], ["biometric"], False, None, None, ["fee_status", "arrival_date"], []), ("d", [], ["registry"], None, None, False, ["fee_status"], ["fee_status"]), ("e", ["biohazard_red"], ["biometric"], True, "DENIED", True, ["fee_status"], ["visa_class"]), ("f", [], [], False, "DENIED", False, ["fee_status"], [])]
    c = F.col
    return _frame(spark, schema, *rows).select("case_id", evidence.flags_known(c("flags"), c("kinds"), c("read"), c("note"), c("missing")).alias("known"), _join(evidence.still_unresolved(c("unresolved"), c("settled"))).alias("left_over"))


@case("field string, typed boolean", ("visa_class", True), ("home_world", False))
def q82_typed_fields(spark):
    o = _obs(spark, ("c", "visa_class", "x", "scanned_page", 1, 1), ("c", "visa_class", "x", "intake", 1, 1), ("c", "home_world", "x", "scanned_page_fallback", 1, 1))
    return evidence.typed_fields(o).select("field", "typed")


@case("key string, first_value string, last_value string", ("status", "CLEAR", "EMBARGO"), ("waiver", "W-1", "W-1"))
def q83_first_and_last(spark):
    """First of readings, last of typed pages; nulls claim nothing."""
    rows = [("status", 1, 2, "CLEAR"), ("status", 1, 1, None), ("status", 3, 0, "EMBARGO"), ("waiver", 2, 5, "W-1"), ("waiver", 9, 0, None)]
    return resolve.first_and_last(_frame(spark, "key string, page int, idx int, v string", *rows), ["key"], "v", ["page", "idx"])


@case("case_id string, fields int, share double, margin double, known boolean", ("a", 7, 1.0, 0.5, True), ("b", 0, 0.0, 0.0, False))
def q84_coverage(spark):
    """How much of a record is known, and how far beyond stale it is."""
    schema = ", ".join(f"{c} string" for c in features.FIELDS)
    r = _frame(spark, "case_id string, ref string, " + schema, ("a", "2026-09-28", *["XW-1", "SPN-1", "2026-01-01", "z", "Mars", "trade", "Ada"]), ("b", "2026-09-28", *[None] * 7))
    known, share = features.coverage(list(features.FIELDS))
    margin = features.stale_margin(F.col("ref").cast("date"), F.col("arrival_date").cast("date"))
    return r.select("case_id", known.alias("fields"), share.alias("share"), F.coalesce(margin, F.lit(0.0)).alias("margin"), margin.isNotNull().alias("known"))


@case("path string, plain string, safe string, confidence double", ("clean", "APPROVED", "APPROVED", 0.6), ("risk_page_unreadable", "APPROVED", "NEEDS_REVIEW", 0.15), ("risk_page_unreadable_med", "APPROVED", "NEEDS_REVIEW", 0.15))
def q85_guarded_decision(spark):
    """On unreadable panels an approval is no candidate; the confidence is that of what is decided."""
    p = (F.lit(0.60), F.lit(0.25), F.lit(0.15))
    r = _frame(spark, "path string", ("clean",), ("risk_page_unreadable",), ("risk_page_unreadable_med",))
    safe = P.decide_safely(p, F.col("path"))
    return r.select("path", P.decide(p)["decision"].alias("plain"), safe["decision"].alias("safe"), safe["confidence"].alias("confidence"))


FIELDS = ("applicant_name", "species_code", "home_world", "visa_class", "declared_purpose", "sponsor_id", "arrival_date", "fee_status")


@case(
    "case_id string, path string, adjudication string, confidence double, sponsor_id string, arrival_date string, fee_status string, risk_flags string",
    ("a", "clean", "APPROVED", 0.8, "SPN-0100", "2026-01-10", "paid", "none"), ("b", "sponsor_revoked", "DENIED", 0.95, "SPN-0007", "2026-01-10", "paid", "none"), ("c", "clean", "DENIED", 0.9972, "SPN-0100", "2026-01-10", "paid", "none"),
    ("d", "arrival_date_untrusted", "NEEDS_REVIEW", 0.95, "SPN-0100", "2026-01-10", "paid", "none"), ("e", "disqualifying_flag", "DENIED", 0.9, "SPN-0100", "2026-01-10", "unknown", "biohazard_red"), ("f", None, "NEEDS_REVIEW", 0.6, "SPN-0100", "2000-01-01", "unknown", "none"), ("g", "clean_injection_seen", "DENIED", 0.75, "SPN-0100", "2026-01-10", "paid", "none"),
)
def q86_batch(spark):
    """Phase 2 as a whole: context, path, decision, notes, settlement, backfill, schema, the commonest sponsor for the guess."""
    schema = (
        "case_id string, visa_class string, sponsor_id string, fee_status string, arrival_date string, risk_flags array<string>, arrival_date_untrusted boolean, has_hardship_waiver boolean, has_diplomatic_note boolean, "
        "risk_flags_known boolean, has_scanned_pages boolean, injection_detected boolean, note_finding string, fallback_note string"
    )
    start = {"case_id": "", "visa_class": "XW-1", "sponsor_id": "SPN-0100", "fee_status": "paid", "arrival_date": "2026-01-10", "risk_flags": [], "arrival_date_untrusted": False, "has_hardship_waiver": False, "has_diplomatic_note": False, "risk_flags_known": True, "has_scanned_pages": False, "injection_detected": False, "note_finding": None, "fallback_note": None}
    row = lambda k, **x: tuple((start | {"case_id": k} | x).values())
    recs = _frame(spark, schema, row("a"), row("b", sponsor_id="SPN-0007"), row("c", note_finding="DENIED"), row("d", fallback_note="NEEDS_REVIEW", sponsor_id=None, arrival_date=None), row("e", fee_status="odd", risk_flags=["biohazard_red"]), row("g", injection_detected=True, fallback_note="APPROVED"))
    table = [("clean", 0.8, 0.1, 0.1, 50), ("sponsor_revoked", 0.0, 0.95, 0.05, 20), ("disqualifying_flag", 0.0, 0.9, 0.1, 20), ("clean_injection_seen", 0.05, 0.75, 0.2, 5), ("arrival_date_untrusted", 0.3, 0.4, 0.3, 5), (adjudicate.UNREADABLE, 0.1, 0.3, 0.6, 1)]
    cal = _frame(spark, "path string, p_approved double, p_denied double, p_review double, support long", *table)
    d = adjudicate.adjudicate(recs, cal)
    d = d.select("*", *[F.col(c).alias(f"printed_{c}") if c in d.columns else F.lit(None).cast("string").alias(f"printed_{c}") for c in FIELDS], F.col("risk_flags").alias("printed_flags"))
    out = io.to_output(adjudicate.finish(_frame(spark, "case_id string", *[(k,) for k in "abcdefg"]), d, cal.drop("support")))
    return out.join(d.select("case_id", "path"), "case_id", "left")


@case("key string, value string", ("kept", "a"), ("path of d", "settled"), ("path of a", "clean"), ("strange flag", "odd_one"), ("share", "12.5%"), ("prior DENIED", "0.75"), ("largest fold less least", "1"))
def q87_training_tools(spark):
    """Rows to learn from, out-of-fold rows, unknown flags, percent, the global prior, and folds dealt evenly."""
    rows = _frame(spark, "case_id string, failed boolean, note_finding string, path string", ("a", False, None, "clean"), ("b", True, None, "clean"), ("d", False, "DENIED", "clean"))
    kept = evaluate.trainable(rows).select(F.lit("kept").alias("key"), F.col("case_id").alias("value"))
    oof = evaluate.with_out_of_fold(rows.where("case_id <> 'b'"), _frame(spark, "case_id string, p double", ("a", 0.5)), "case_id", "settled").select(F.concat(F.lit("path of "), "case_id").alias("key"), F.col("path").alias("value"))
    odd = evaluate.unclassified(_frame(spark, "flag string", ("biohazard_red",), ("odd_one",), ("odd_one",)), list(FLAGS)).select(F.lit("strange flag").alias("key"), F.col("flag").alias("value"))
    share = spark.range(1).select(F.lit("share").alias("key"), evaluate.percent(F.lit(0.125)).alias("value"))
    prior = evaluate.global_prior(_frame(spark, "o string", ("DENIED",), ("DENIED",), ("DENIED",), ("APPROVED",)), "o").where("o = 'DENIED'").select(F.concat(F.lit("prior "), "o").alias("key"), F.col("p").cast("string").alias("value"))
    folds = evaluate.stratified_folds(spark.range(23).select("id", (F.col("id") < 13).cast("int").alias("label")), "label", "id", 4).groupBy("label", "fold").count().groupBy("label").agg((F.max("count") - F.min("count")).alias("gap")).agg(F.max("gap").alias("gap"))
    even = folds.select(F.lit("largest fold less least").alias("key"), F.col("gap").cast("string").alias("value"))
    return kept.union(oof).union(odd).union(share).union(prior).union(even)
