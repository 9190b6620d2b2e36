"""Text boxes of a second reader: admission, rows, and labelled values in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions.distance import SCAN, distance
from caseloom.functions.text import canon
from caseloom.functions.validate import date_of
from caseloom.operators.snap import snap
from caseloom.sources import stages

FLOOR = 0.30
#: Least confidence and greatest label distance of each gate. Fixed values.
GATES = {"closed": (0.70, 3.0), "date_strict": (0.85, 3.0), "date_modal": (0.80, 2.0), "sponsor": (0.90, 2.0), "placeholder": (0.70, 3.0)}
#: Least confidence of a closed value's snap, and the labels of boxes without their blanks. Fixed values.
LEAST_SNAP = 0.20
CLOSED_LABELS = {"species_code": ("speciescode", "speciesmatch"), "home_world": ("homeworld",), "visa_class": ("visaclass",), "declared_purpose": ("declaredpurpose", "purpose")}
DATE_LABEL, SPONSOR_LABEL = "arrivaldate", "sponsorid"
SCANS = ("scanned_page", "scanned_page_fallback")


def admit(raw: DataFrame, floor: float = FLOOR) -> DataFrame:
    """Boxes read with confidence, with bounds and centre from ``polygon array<struct<x,y>>``."""
    xs, ys = F.transform("polygon", lambda p: p["x"]), F.transform("polygon", lambda p: p["y"])
    out = raw.where((F.col("confidence") >= floor) & (F.trim("text") != ""))
    out = out.withColumn("bounds", F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1")))
    return out.withColumn("centre", F.struct(((F.col("bounds.x0") + F.col("bounds.x1")) / 2).alias("x"), ((F.col("bounds.y0") + F.col("bounds.y1")) / 2).alias("y"))).drop("polygon")


def anchored_rows(items: Column, tolerance: Column) -> Column:
    """Groups of a sorted array of ``struct(y, ...)``: a new row where y leaves its row's first y.

    Gives the row number of each item. A fold, because the anchor is the row's first
    item and not the one before.
    """
    start = F.struct(F.lit(-1).alias("row"), F.lit(None).cast("double").alias("anchor"), F.array().cast("array<int>").alias("rows"))

    def step(acc: Column, x: Column) -> Column:
        new = acc["anchor"].isNull() | (x["y"] - acc["anchor"] > tolerance)
        row = F.when(new, acc["row"] + 1).otherwise(acc["row"])
        return F.struct(row.alias("row"), F.when(new, x["y"]).otherwise(acc["anchor"]).alias("anchor"), F.concat(acc["rows"], F.array(row)).alias("rows"))

    return F.aggregate(items, start, step, lambda acc: acc["rows"])


def lines(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """``*keys, row, text``: the boxes of a page as lines of text, left to right.

    The tolerance is 0.6 of the upper median height, at least 1.
    """
    items = F.array_sort(F.collect_list(F.struct(F.col("centre.y").alias("y"), F.col("centre.x").alias("x"), F.col("box_idx").alias("i"), "text")))
    heights = F.array_sort(F.collect_list(F.col("bounds.y1") - F.col("bounds.y0")))
    page = boxes.groupBy(*keys).agg(items.alias("items"), heights.alias("h"))
    tol = F.greatest(F.lit(1.0), 0.6 * F.element_at("h", (F.floor(F.size("h") / 2) + 1).cast("int")))
    page = page.withColumn("tol", tol).withColumn("rows", anchored_rows(F.col("items"), F.col("tol")))
    each = page.select(*keys, F.explode(F.arrays_zip("rows", "items")).alias("z")).select(*keys, F.col("z.rows").alias("row"), F.col("z.items").alias("item"))
    parts = F.array_sort(F.collect_list(F.struct(F.col("item.x").alias("x"), F.col("item.i").alias("i"), F.col("item.text").alias("text"))))
    return each.groupBy(*keys, "row").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))


def labelled_values(boxes: DataFrame, aliases: DataFrame, gate: str) -> DataFrame:
    """Best reading of ``label value`` in one box for each case and field.

    Every box meets every alias ``(alias, field)`` at all splits within four letters
    of the alias; distances are computed for distinct beginnings only. The best by
    distance, then confidence, then value stays.
    """
    least, most = GATES[gate]
    b = boxes.where(F.col("confidence") >= least).withColumn("c", canon(F.col("text")))
    a = aliases.select("field", canon(F.col("alias")).alias("alias"))
    lo, hi = F.greatest(F.lit(1), F.length("alias") - 4), F.least(F.length("c"), F.length("alias") + 4)
    pairs = b.crossJoin(F.broadcast(a)).where(lo <= hi).withColumn("cut", F.explode(F.sequence(lo, hi)))
    pairs = pairs.withColumn("head", F.substring(F.col("c"), F.lit(1), F.col("cut"))).withColumn("value", F.substring(F.col("c"), F.col("cut") + 1, F.length("c")))
    ask = pairs.select("head", "alias").distinct().withColumn("d", distance(F.col("head"), F.col("alias"), SCAN)).where(F.col("d") <= most)
    best = pairs.where("value <> ''").join(ask, ["head", "alias"]).groupBy("case_id", "field").agg(F.min(F.struct("d", (-F.col("confidence")).alias("k"), "value")).alias("m"))
    return best.select("case_id", "field", F.col("m.value").alias("value"), F.col("m.d").alias("distance"), (-F.col("m.k")).alias("confidence"))


def _candidates(boxes: DataFrame) -> DataFrame:
    """``case_id, box, confidence, field, alias, head, value`` of all gates in one pass over the boxes.

    A closed field's box may be cut anywhere within four letters of its label's length; a
    date's or a sponsor's before the value.
    """
    c = canon(F.col("text"))
    closed = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(a).alias("alias")) for f, names in CLOSED_LABELS.items() for a in names])

    def cuts(x: Column) -> Column:
        lo, hi = F.greatest(F.lit(1), F.length(x["alias"]) - 4), F.least(F.length("c"), F.length(x["alias"]) + 4)
        at = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda k: F.struct(x["field"].alias("field"), x["alias"].alias("alias"), F.substring(F.col("c"), F.lit(1), k).alias("head"), F.substring(F.col("c"), k + 1, F.length("c")).alias("value")))

    day = r"(?<![0-9])([0-9]{4}-[0-9]{2}-[0-9]{2})(?![0-9])"
    days, gaps = F.regexp_extract_all("text", F.lit(day), 1), F.split("text", day)
    upto = lambda i: F.length(F.array_join(F.slice(gaps, 1, i + 1), "")) + 10 * i
    field = lambda f, a, head, value: F.struct(F.lit(f).alias("field"), F.lit(a).alias("alias"), canon(head).alias("head"), value.alias("value"))
    dated = F.filter(F.transform(days, lambda d, i: field("arrival_date", DATE_LABEL, F.substring(F.col("text"), F.lit(1), upto(i)), d)), lambda x: date_of(x["value"]).isNotNull())
    sponsor = F.regexp_extract(F.upper("text"), r"SPN-[0-9]{4}", 0)
    before = F.substring(F.col("text"), F.lit(1), F.instr(F.upper("text"), sponsor) - 1)
    ids = F.when(sponsor != "", F.array(field("sponsor_id", SPONSOR_LABEL, before, sponsor)))
    least = min(bar for bar, _ in GATES.values())
    b = boxes.where(F.col("confidence") >= least).select("case_id", F.struct("page", "box_idx").alias("box"), "confidence", "text", c.alias("c"))
    none = F.array().cast("array<struct<field: string, alias: string, head: string, value: string>>")
    return b.select("case_id", "box", "confidence", F.explode(F.concat(F.flatten(F.transform(closed, cuts)), dated, F.coalesce(ids, none))).alias("x")).select("case_id", "box", "confidence", "x.*")


def direct(boxes: DataFrame, obs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """What single boxes say of fields that no typed page states, one row a case.

    ``box_<closed field>``: the one value that all boxes which pass the gate agree on;
    ``box_strict`` and ``box_cheap``: dates to be settled with the corpus, by gate;
    ``box_sponsor`` with ``box_sponsor_seen`` (a reader but the fallback one saw it too, or saw
    none) and ``box_sponsor_placeholder``: sponsors to be settled with the corpus. Labels and
    closed values are compared once for all boxes, as distinct texts.
    """
    typed = obs.where(~F.col("source").isin(*SCANS)).select("case_id", "field").distinct()
    cut = _candidates(boxes)
    near = cut.select("head", "alias").distinct().withColumn("d", distance(F.col("head"), F.col("alias"), SCAN)).where(F.col("d") <= max(most for _, most in GATES.values()))
    # few cuts begin with a label: those are found first, and only they meet the packet's other readings
    found = stages.staged(cut.join(stages.staged(near, "box-labels"), ["head", "alias"]).join(typed, ["case_id", "field"], "left_anti"), "box-values")
    passes = lambda gate: (F.col("confidence") >= GATES[gate][0]) & (F.col("d") <= GATES[gate][1])
    closed = found.where(F.col("field").isin(*CLOSED_LABELS) & passes("closed") & (F.col("value") != ""))
    known = snap(closed, vocabulary.where(F.col("field").isin(*CLOSED_LABELS)), "value", ["field"], costs=SCAN).where(F.col("confidence") >= LEAST_SNAP).select("field", "value", "snapped", F.col("confidence").alias("k"))
    best = closed.join(known, ["field", "value"]).groupBy("case_id", "box", "field").agg(F.min(F.struct("d", (-F.col("k")).alias("k"), "snapped"))["snapped"].alias("value"))
    said = best.groupBy("case_id", "field").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where("lo = hi")
    values = said.groupBy("case_id").agg(*[F.max(F.when(F.col("field") == f, F.col("lo"))).alias(f"box_{f}") for f in CLOSED_LABELS])
    one = lambda on: F.when(F.min(F.when(on, F.col("value"))) == F.max(F.when(on, F.col("value"))), F.min(F.when(on, F.col("value"))))
    many = lambda on: F.array_sort(F.collect_set(F.when(on, F.col("value"))))
    strict = passes("date_strict") & (F.col("field") == "arrival_date")
    ids = F.col("field") == "sponsor_id"
    staged = found.where(F.col("field").isin("arrival_date", "sponsor_id")).groupBy("case_id").agg(
        many(strict).alias("box_strict"), many(passes("date_modal") & ~strict & (F.col("field") == "arrival_date")).alias("box_cheap"),
        one(passes("sponsor") & ids).alias("box_sponsor"), one(passes("placeholder") & ids).alias("box_sponsor_placeholder"),
    )
    primary = obs.where("field = 'sponsor_id' and source <> 'scanned_page_fallback'").groupBy("case_id").agg(F.collect_set(F.upper(F.trim("value"))).alias("seen"))
    out = values.join(staged, "case_id", "full_outer").join(primary, "case_id", "left")
    return out.withColumn("box_sponsor_seen", F.col("box_sponsor").isNotNull() & F.coalesce(F.array_contains("seen", F.col("box_sponsor")), F.lit(True))).drop("seen")
