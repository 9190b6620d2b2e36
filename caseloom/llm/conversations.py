"""Repair of conversations at least cost, with an audit of the edits."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What edits cost. Keeping a turn costs nothing; a cut-off text that stays costs ``CUT_OFF`` more.
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
#: Ends of a sentence.
ENDS = "[.!?]"
WHITE = " \t\n\x0b\x0c\r"

# The grammar (s?(ua)+)? has four states: nothing yet, behind a system turn, behind a
# user's, behind an assistant's; the first and the last accept. A lane of four bits holds a
# set of states, and lane k of a word those from which the turns that follow can be
# repaired at a cost of at most (base + k).
LANES, WIDE = 8, 16
ONES = int("1" * WIDE, 16)
FULL = (1 << 4 * WIDE) - (1 << 4 * LANES)
#: Behind the last turn: nothing to add, a turn of the assistant, or both.
END = 0x9 | 0x9 << 4 | 0x9 << 8 | 0xD << 12 | 0xD << 16 | 0xD << 20 | 0xF << 24 | 0xF << 28
#: The turn that each state waits for, and the state behind it.
WANTED, AFTER = ("user", "user", "assistant", "user"), (2, 2, 3, 2)
MUST_GO, CUT = 8, 4


def _before_user(x: int) -> int:
    return ((x >> 2) & ONES) * 0b1011


def _before_assistant(x: int) -> int:
    return ((x >> 3) & ONES) << 2


def _before_system(x: int) -> int:
    return (x >> 1) & ONES


KEEP = {1: _before_system, 2: _before_user, 3: _before_assistant}


def _layers(word: int, code: int) -> tuple[int, int]:
    """The word of a turn from that of the next one, and how much the base rises.

    ``code`` holds the role (1 system, 2 user, 3 assistant, 0 another), and whether the turn
    must go or is cut off. All layers move at once: a shift by a lane is a cost of one.
    """
    word |= FULL
    out = word << 4 * DELETE
    if not code & MUST_GO:
        more = CUT_OFF if code & CUT else 0
        if code & 3:
            out |= KEEP[code & 3](word) << 4 * more
        out |= (_before_user(word) | _before_assistant(word)) << 4 * (REROLE + more)
    for _ in range(2):  # no repair inserts three turns in a row
        out |= (_before_user(out) | _before_assistant(out)) << 4 * INSERT
    rise = ((out & -out).bit_length() - 1) // 4
    return out >> 4 * rise & (1 << 4 * LANES) - 1, rise


class Layers(dict):
    """``_layers`` by word and code; there are few of them."""

    def __missing__(self, key: tuple[int, int]) -> tuple[int, int]:
        got = self[key] = _layers(*key)
        return got


LAYERS = Layers()


def _first(word: int, state: int) -> int:
    """The first layer of a word that has a state."""
    k = 0
    while not word >> 4 * k + state & 1:
        k += 1
    return k


class Conversation:
    """The turns of a conversation, from the last to the first, in about six bytes each."""

    def __init__(self):
        self.codes, self.words, self.rises = bytearray(), array("I"), bytearray()
        self.word = END

    def add(self, code: int) -> None:
        self.words.append(self.word)
        self.word, rise = LAYERS[self.word, code]
        self.codes.append(code)
        self.rises.append(rise)

    def repair(self) -> tuple[int, str]:
        """Cost, and of the cheapest edits those whose letters come first, in the order of the turns.

        The first layer that has the starting state is the cost. From there each step takes the
        least letter that leads to a state whose first layer is what is left: D, I, K, R.
        """
        out = bytearray()
        word, state, i = self.word, 0, len(self.codes)
        cost = left = sum(self.rises) + _first(word, 0)
        base = sum(self.rises)
        while left or i:
            if i:
                code, next_word, next_base = self.codes[i - 1], self.words[i - 1], base - self.rises[i - 1]
                if next_base + _first(next_word, state) + DELETE == left:
                    out += b"D"
                    left, word, base, i = left - DELETE, next_word, next_base, i - 1
                    continue
            if base + _first(word, AFTER[state]) + INSERT == left:
                out += b"I"
                state, left = AFTER[state], left - INSERT
                continue
            more = CUT_OFF if code & CUT else 0
            to = _kept(state, code & 3)
            if to is not None and next_base + _first(next_word, to) + more == left:
                out += b"K"
                state, left = to, left - more
            else:
                out += b"R"
                state, left = AFTER[state], left - REROLE - more
            word, base, i = next_word, next_base, i - 1
        return cost, out.decode()


def _kept(state: int, role: int) -> int | None:
    """The state behind a turn that stays, if the grammar takes it."""
    if role == 1:
        return 1 if state == 0 else None
    return AFTER[state] if role and WANTED[state][0] == " sua"[role] else None


def damage(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies``: rows ``(conv_id, turn, role, text)`` after damage that a checksum of
    conversation and turn decides. Nulls read as one blank. Dropped rows stay, with 0 copies."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    words = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text("text"), ENDS, "")).otherwise(text("text"))
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(kind == 4, F.lit("user")).otherwise(text("role")).alias("role"),
        words.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _each(rows: DataFrame, *more: Column) -> DataFrame:
    """A row a copy, with what tells texts apart; ``k`` is 0 for rows that only name their conversation."""
    digest = F.when(F.col("copies") > 0, F.unhex(F.md5(F.col("text").cast("binary")))).alias("digest")
    k = F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies").cast("int"))).otherwise(F.array(F.lit(0)))).alias("k")
    return rows.select("conv_id", "turn", "role", digest, *more, k)


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a conversation, from turns in descending order."""
    conv, at = None, None  # a list of one: its id
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

    def done() -> pa.RecordBatch:
        cost, audit = turns.repair()
        gaps = high - low + 1 - different if high is not None else 0
        row = [conv[0], gaps, *faults, illegal, cost, audit]
        return pa.RecordBatch.from_arrays([pa.array([v], pa.string() if n == "audit" else pa.int64()) for n, v in zip(names, row, strict=True)], names)

    for batch in batches:
        for cid, turn, role, blank, again, cut, k in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "blank", "again", "cut", "k")), strict=True):
            if conv is None or conv[0] != cid:
                if conv is not None:
                    yield done()
                conv, turns, faults, illegal = [cid], Conversation(), [0, 0, 0], 0
                high = low = at = later = None
                different = 0
            if not k:
                continue
            if turn is not None:
                if turn != at:
                    different += 1
                high, low, at = turn if high is None else high, turn, turn
            fault = 0 if blank else 1 if again else 2 if cut else None
            if fault is not None:
                faults[fault] += 1
            initial = role[:1]
            if later is not None and initial + later not in ("su", "ua", "au"):
                illegal += 1
            later = initial
            turns.add((" sua".index(initial) if initial and initial in "sua" else 0) | (MUST_GO if blank or again else CUT if cut else 0))
    if conv is not None:
        yield done()


def audit_conversations(rows: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` for rows ``(conv_id, turn, role, text, copies)``.

    Turns are taken in their order, null turns first; turns with the same number by role,
    then by the MD5 of their text. A turn's first fault counts: a blank text, a role and text
    seen before in the conversation, a text whose last character is no end of a
    sentence. ``illegal`` counts neighbours whose roles may not follow each other,
    ``gaps`` the numbers missing between the first and the last turn.

    The edits are the cheapest that make the roles' initials read ``(s?(ua)+)?``, found by
    layers of cost: one word a turn holds, for each cost above the least, the set of grammar
    states from which the rest can be repaired, and one shift moves all layers. No state
    costs over seven more than another (it can be left by inserting two turns at most, or by
    deleting one), so eight layers hold all. The first layer with the starting state gives
    the cost, and a trace of bits from there the audit that comes first by letter.

    Turns are sorted by Spark and streamed: a conversation of any length holds some six bytes a
    turn. A conversation without turns has zeros and an empty audit; an empty
    table gives an empty result; repeated rows are duplicates; null conversations are one.
    """
    text = F.col("text")
    last = F.right(F.rtrim(text, F.lit(WHITE)), F.lit(1))
    each = _each(rows, (last == "").alias("blank"), (~last.rlike(ENDS)).alias("cut")).repartition("conv_id")
    # a turn is a duplicate if the one before it, of those with its role and text, is its conversation's too
    each = each.sortWithinPartitions("conv_id", "role", "digest", F.asc_nulls_first("turn"), "k").mapInArrow(_repeats, "conv_id long, turn long, role string, digest binary, blank boolean, cut boolean, k int, again boolean")
    order = [F.asc("conv_id"), F.desc_nulls_last("turn"), F.desc("role"), F.desc("digest"), F.desc("again"), F.desc("k")]
    return each.sortWithinPartitions(*order).mapInArrow(_audited, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation, role and text, with whether the same came before."""
    last = None
    for batch in batches:
        flags = []
        for key in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "digest")), strict=True):
            flags.append(key == last)
            last = key
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(flags, pa.bool_())], [*batch.schema.names, "again"])


def _merged(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """The audit of each conversation, then its turns in order."""
    turns = _each(rows, F.col("text"), F.lit(None).cast("struct<gaps: long, blank: long, duplicate: long, truncated: long, illegal: long, cost: long>").alias("found")).where("k > 0")
    found = F.struct("gaps", "blank", "duplicate", "truncated", "illegal", "cost").alias("found")
    heads = audits.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("binary").alias("digest"), F.col("audit").alias("text"), found, F.lit(0).alias("k"))
    both = heads.unionByName(turns).withColumn("head", F.col("k") == 0).repartition("conv_id")
    return both.sortWithinPartitions("conv_id", F.desc("head"), F.asc_nulls_first("turn"), "role", "digest", "k").drop("turn", "digest", "k")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``(head, None, None)`` for each conversation, its audit among it, then ``(None, role, text)`` for its repaired turns."""
    audit, at, state = "", 0, 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "found", "head")), strict=True):
            cid, role, text, found, head = row
            if head:
                while at < len(audit):  # turns that were added behind the last one
                    yield None, WANTED[state], ""
                    state, at = AFTER[state], at + 1
                audit, at, state = text, 0, 0
                yield (cid, found, audit), None, None
                continue
            while audit[at] == "I":
                yield None, WANTED[state], ""
                state, at = AFTER[state], at + 1
            edit = audit[at]
            at += 1
            if edit == "D":
                continue
            if edit == "R":
                role = WANTED[state]
            yield None, role, text
            state = 1 if role[0] == "s" else AFTER[state]
    while at < len(audit):
        yield None, WANTED[state], ""
        state, at = AFTER[state], at + 1


def repaired_turns(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """``conv_id, place, role, text``: the conversations ``rows`` after the edits of their ``audits``."""
    names = ["conv_id", "place", "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        give = lambda: pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*held, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names)
        cid, place = None, 0
        for head, role, text in _edited(batches):
            if head:
                cid, place = head[0], 0
                continue
            held.append((cid, place, role, text))
            place += 1
            if len(held) == 1000:
                yield give()
                held = []
        if held:
            yield give()

    return _merged(rows, audits).mapInArrow(run, "conv_id long, place long, role string, text string")


def repair_digests(rows: DataFrame) -> DataFrame:
    """The columns of ``audit_conversations`` and ``repaired_sha256``, the SHA-256 of the repaired
    ``role:text`` of each conversation, joined by newlines; texts are streamed, never gathered."""
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    names = ["conv_id", *counts, "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row() -> pa.RecordBatch:
            values = [now[0], *(now[1][c] for c in counts), now[2], digest.hexdigest()]
            return pa.RecordBatch.from_arrays([pa.array([v], pa.string() if isinstance(v, str) else pa.int64()) for v in values], names)

        now = None
        for head, role, text in _edited(batches):
            if head:
                if now:
                    yield row()
                now, digest, first = head, hashlib.sha256(), True
                continue
            digest.update(f"{'' if first else '\n'}{role}:{text}".encode())
            first = False
        if now:
            yield row()

    return _merged(rows, audit_conversations(rows)).mapInArrow(run, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
