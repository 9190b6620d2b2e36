"""Shards of near equal bytes that keep linked documents together: balanced label propagation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseloom.llm.common import join_groups, materialize

SHARDS = 40
#: Parts of the documents of a group that start in one shard. They move one by one, so the
#: largest group has no more pieces than shards squared times this.
PARTS = 64
#: Rows in a cell: the most that one task orders in the running sums.
CELL_ROWS = 20_000
#: Unlinked documents are placed in classes of size, largest first: above these multiples of the mean.
CLASSES = (4.0, 1.0, 0.25, -1.0)


def _cell(seed: int, n: int, *keys: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(n)).cast("int")


def cells_for(rows: int, shards: int = 1) -> int:
    """How many cells keep ``rows`` rows, dealt to ``shards``, within ``CELL_ROWS`` each."""
    return max(64, rows // (CELL_ROWS * shards) + 1)


def _by_shard(df: DataFrame, what: str) -> dict[int, int]:
    """A sum of each shard: as many rows as there are shards."""
    return {r["shard"]: r["x"] for r in df.groupBy("shard").agg(F.sum(what).alias("x")).collect()}


def cut_edges(placed: DataFrame) -> int:
    """Links between shards, of ``placed (g, shard, n)``: all pairs of a group less those within a shard."""
    pairs = lambda c: c * (c - 1) / 2
    per = placed.groupBy("g", "shard").agg(F.sum("n").alias("n"))
    inside = per.groupBy("g").agg(F.sum("n").alias("all"), F.sum(pairs(F.col("n"))).alias("kept"))
    return int(inside.agg(F.coalesce(F.sum(pairs(F.col("all")) - F.col("kept")), F.lit(0))).first()[0])


def _wishes(pieces: DataFrame, free: dict[int, float], shards: int) -> DataFrame:
    """``g, part, place, at, size, n, to``: where the pieces of split groups want to go.

    A piece looks at the shards its neighbours are in. Shards that can hold the whole
    group come first, then those with most of it; the pieces walk through the free room of
    these in turn, so that a group which no shard can hold fills as few as it can.
    """
    room = F.element_at(F.create_map(*[F.lit(x) for s in range(shards) for x in (s, float(free[s]))]), F.col("shard"))
    labels = pieces.groupBy("g", "shard").agg(F.sum("size").alias("here")).withColumn("room", room)
    whole = W.partitionBy("g")
    labels = labels.withColumn("need", F.sum("here").over(whole)).withColumn("fits", (F.col("room") >= F.col("need")).cast("int")).where("room > 0")
    turn = whole.orderBy(F.col("fits").desc(), F.col("here").desc(), F.xxhash64("g", "shard"))
    labels = labels.withColumn("hi", F.sum("room").over(turn)).withColumn("lo", F.col("hi") - F.col("room")).where("lo < need")
    labels = labels.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("hi", F.col("shard").alias("to")))).alias("turns"))
    walk = W.partitionBy("g").orderBy("shard", "part")
    walked = pieces.withColumn("upto", F.sum("size").over(walk)).join(labels, "g")
    to = F.get(F.filter("turns", lambda t: t["hi"] >= F.col("upto")), F.lit(0))["to"]
    return walked.withColumn("to", to).where("to is not null").select("g", "origin", "part", "shard", "size", "n", "to")


def propagate(pieces: DataFrame, capacity: float, shards: int = SHARDS) -> DataFrame:
    """``g, origin, part, shard, settled``: pieces ``(g, origin, part, shard, size, n)`` after all rounds.

    In each round the pieces of split groups look where most of their group is and ask
    for that shard. A shard takes requests up to its quota, what is left of ``capacity``
    beside the groups that are settled there: by cells of whole groups, larger ones first.
    Whoever was taken is settled; the others see in the next round who has moved. It ends
    when a round moves nobody, which comes, as every round settles some and none leaves.
    """
    whole = W.partitionBy("g")
    state = pieces.withColumn("settled", F.min("shard").over(whole) == F.max("shard").over(whole))
    state = materialize(state, "shard-pieces")
    number = 0
    while True:
        number += 1
        load = _by_shard(state.where("settled"), "size")
        free = {s: max(0.0, capacity - load.get(s, 0)) for s in range(shards)}
        open_ = state.where("not settled")
        wishes = materialize(_wishes(open_.select("g", "origin", "part", "shard", "size", "n"), free, shards), "shard-wishes")
        asks = wishes.groupBy("to", "g").agg(F.sum("size").alias("size"))
        rank = -F.floor(F.log2(F.col("size"))).cast("int")
        cells = asks.groupBy("to", rank.alias("rank"), _cell(number, 1024, "g").alias("cell")).agg(F.sum("size").alias("size"))
        upto = F.sum("size").over(W.partitionBy("to").orderBy("rank", "cell"))
        room = F.element_at(F.create_map(*[F.lit(x) for s in range(shards) for x in (s, float(free[s]))]), F.col("to"))
        taken = cells.withColumn("upto", upto).where(F.col("upto") <= room).select("to", "rank", "cell")
        asks = asks.withColumn("rank", rank).withColumn("cell", _cell(number, 1024, "g"))
        agreed = asks.join(F.broadcast(taken), ["to", "rank", "cell"]).select("to", "g")  # at most shards x 64 sizes x 1024 cells
        moved = wishes.join(agreed, ["to", "g"]).select("g", "origin", "part", "to")
        new = state.join(moved, ["g", "origin", "part"], "left")
        new = new.select("g", "origin", "part", F.coalesce("to", "shard").alias("shard"), "size", "n", (F.col("settled") | F.col("to").isNotNull()).alias("settled"), F.col("to").isNotNull().alias("took"))
        new = materialize(new, "shard-pieces")
        state = new.drop("took")
        if not new.where("took").limit(1).count():
            return state


def fill(rest: DataFrame, loads: dict[int, int], total: int, rows: int, shards: int = SHARDS) -> DataFrame:
    """``uid, size, shard`` for documents ``rest (uid, gh, size)`` that even the shards out.

    In the order of ``gh``, which keeps groups together, their running sum of bytes
    walks through what each shard still lacks. The sum has two levels: of cells, and
    within a cell.
    """
    lack = [max(0.0, total / shards - loads.get(s, 0)) for s in range(shards)]
    free = max(1e-9, sum(lack))
    rest = rest.withColumn("cell", _cell(99, max(4096, cells_for(rows)), "gh"))
    cells = rest.groupBy("cell").agg(F.sum("size").alias("bytes"))
    start = cells.select("cell", (F.sum("bytes").over(W.orderBy("cell")) - F.col("bytes")).alias("start"), F.sum("bytes").over(W.partitionBy()).alias("all"))
    within = rest.withColumn("upto", F.sum("size").over(W.partitionBy("cell").orderBy("gh", "uid"))).join(start, "cell")
    middle = (F.col("start") + F.col("upto") - F.col("size") / 2) / F.col("all") * F.lit(free)
    bounds, at = [], 0.0
    for x in lack[:-1]:
        at += x
        bounds.append(F.lit(at))
    shard = F.size(F.filter(F.array(*bounds), lambda b: b <= F.col("middle"))) if bounds else F.lit(0)
    return within.withColumn("middle", middle).select("uid", "size", shard.cast("int").alias("shard"))


def linked_documents(base: DataFrame, rows: int, shards: int = SHARDS) -> DataFrame:
    """``uid, g, size, linked, origin, part``: documents ``base (uid, g, size)`` with what links them.

    Documents of the same ``g`` are linked. Each starts in the shard ``origin`` that a hash of
    its own number says, whatever its links, and in a part of what starts there.
    """
    groups = materialize(base.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shard-groups")
    found = join_groups(base.select("uid", "g", "size"), groups, ["g"], "n", rows, "left")
    return found.select("uid", "g", "size", F.col("n").isNotNull().alias("linked"), _cell(1, shards, "uid").alias("origin"), _cell(2, PARTS, "uid").alias("part"))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for every row of ``docs (doc_id, text)``.

    Linked documents are those with equal texts (null is a text of its own). Size is the
    bytes of the text in UTF-8 plus 16, whatever its length; shards become near equal in
    size. Linked documents start spread over all shards and move by label propagation
    (``propagate``) until no move lowers the number of cut links. Those that found no room,
    and documents without a link, go to what the shards lack, large ones first. Slots
    count up from 0 in each shard. Rows are told apart by a number given when they are first
    written, so repeated rows and null doc_ids are rows of their own. An empty table gives
    an empty one; other columns are ignored, whatever their names.
    """
    text = F.col("text")
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0).cast("long")).alias("text_crc32"),
        F.coalesce(F.md5(text.cast("binary")), F.lit("null")).alias("g"),
        F.monotonically_increasing_id().alias("uid"),
    )
    base = materialize(base, "shard-base")
    total, mean, n = base.agg(F.sum("size"), F.avg("size"), F.count(F.lit(1))).first()
    total, mean = total or 0, mean or 0.0
    rows = materialize(linked_documents(base, n, shards), "shard-rows")
    pieces = rows.where("linked").groupBy("g", "origin", "part").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    pieces = propagate(pieces.select("g", "origin", "part", F.col("origin").alias("shard"), "size", "n"), total / shards, shards)
    counted = pieces.select("g", "origin", "part", "shard", "settled", "n")
    linked = materialize(join_groups(rows.where("linked").select("uid", "g", "origin", "part", "size"), counted, ["g", "origin", "part"], "n", n), "shard-linked")
    placed = linked.where("settled").select("uid", "size", "shard")
    rest = rows.where("not linked").unionByName(linked.where("not settled").select("uid", "g", "size", F.lit(True).alias("linked"), "origin", "part")).select("uid", F.xxhash64("g").alias("gh"), "size")
    above = None
    for factor in CLASSES:  # large documents first, so that small ones even out what is left
        loads = _by_shard(placed, "size")
        within = (F.col("size") > factor * mean) & (F.lit(True) if above is None else F.col("size") <= above)
        placed = placed.unionByName(materialize(fill(rest.where(within), loads, total, n, shards), "shard-filled"))
        above = factor * mean
    done = materialize(placed.withColumn("cell", _cell(7, cells_for(n, shards), "uid")).select("uid", "shard", "cell"), "shard-placed")
    counts = done.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    start = counts.select("shard", "cell", (F.sum("n").over(W.partitionBy("shard").orderBy("cell")) - F.col("n")).alias("start"))
    slot = F.row_number().over(W.partitionBy("shard", "cell").orderBy("uid")) - 1
    slots = done.withColumn("k", slot).join(start, ["shard", "cell"]).select("uid", "shard", (F.col("start") + F.col("k")).cast("long").alias("slot"))
    return base.join(slots, "uid").select("doc_id", "size", "text_crc32", "shard", "slot")
