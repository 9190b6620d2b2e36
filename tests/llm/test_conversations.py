import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from caseloom.llm import conversations as C
from caseloom.llm.queries import op12_conversation_repair

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def plain_damage(rows):
    out = []
    for cid, turn, role, text in rows:
        key = f"{' ' if cid is None else cid}:{' ' if turn is None else turn}"
        role, text, kind = " " if role is None else role, " " if text is None else text, zlib.crc32(key.encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        out.append((cid, turn, role, text, {0: 0, 3: 2}.get(kind, 1)))
    return out


def cheapest(turns):
    """Least (cost, audit, repaired) of all edits, by every state at every turn; ``turns`` are (role, text, must go, cut)."""
    grammar = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    added = {"u": "user", "a": "assistant"}
    best = {q: (0, "", ()) for q in (0, 3)}

    def with_inserts(best):
        for _ in range(4):
            for q in range(4):
                for c, to in grammar[q].items():
                    if c in added and to in best:
                        cost, audit, kept = best[to]
                        new = (cost + 3, "I" + audit, (f"{added[c]}:", *kept))
                        best[q] = min(best.get(q, new), new)
        return best

    best = with_inserts(best)
    for role, text, must_go, cut in reversed(turns):
        now = {}
        for q in range(4):
            options = []
            if q in best:
                options.append((best[q][0] + 4, "D" + best[q][1], best[q][2]))
            if not must_go:
                for c, to in grammar[q].items():
                    if to in best:
                        cost, audit, kept = best[to]
                        more = 3 if cut else 0
                        if role[:1] == c:
                            options.append((cost + more, "K" + audit, (f"{role}:{text}", *kept)))
                        if c in added:
                            options.append((cost + more + 3, "R" + audit, (f"{added[c]}:{text}", *kept)))
            if options:
                now[q] = min(options)
        best = with_inserts(now)
    return best[0]


def plain(rows):
    by = defaultdict(list)
    for cid, turn, role, text, copies in rows:
        by[cid] += [(turn, role, text)] * copies
    out = {}
    for cid, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), hashlib.md5(t[2].encode()).digest()))
        known = {t[0] for t in turns if t[0] is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        seen, faults, coded = set(), [0, 0, 0], []
        for _, role, text in turns:
            bare = text.strip(SPACE)
            blank, again, cut = not bare, (role, text) in seen, bool(bare) and bare[-1] not in ".!?"
            seen.add((role, text))
            fault = 0 if blank else 1 if again else 2 if cut else None
            if fault is not None:
                faults[fault] += 1
            coded.append((role, text, blank or again, cut))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        cost, audit, kept = cheapest(coded)
        out[cid] = (gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def got(df):
    rows = df.collect()
    out = {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in rows}
    assert len(out) == len(rows)
    return out


def random_rows(seed, conversations, turns):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \n", None, "Yes. ", "ok.\x0b", "é。", "Ends here. "]
    rows = []
    for cid in [*range(conversations), None]:
        for k in range(rng.randrange(turns)):
            turn = None if rng.random() < 0.05 else k if rng.random() < 0.8 else rng.randrange(turns)
            rows.append((cid, turn, rng.choice(["user", "assistant"] * 4 + ["system", "System", "tool", "", None, "us"]), rng.choice(texts) if rng.random() < 0.4 else f"Turn {k}."))
    return rows + rows[:20]


@pytest.mark.parametrize(("seed", "conversations", "turns"), [(1, 300, 9), (2, 3, 200)])
def test_repairs_equal_the_plain_ones(spark, seed, conversations, turns):
    rows = random_rows(seed, conversations, turns)
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], f"{SCHEMA}, audit string, k long").repartition(7)
    assert got(C.repair_digests(C.damage(df))) == plain(plain_damage(rows))


def test_turns_as_given(spark):
    """Rows that nothing damaged, and the repaired turns themselves."""
    rows = [(*r[:2], r[2] or "tool", r[3] or "", 1) for r in random_rows(3, 60, 12)]
    df = spark.createDataFrame(rows, f"{SCHEMA}, copies int")
    want = plain(rows)
    assert got(C.repair_digests(df)) == want
    kept = defaultdict(list)
    for r in sorted(C.repaired_turns(df, C.audit_conversations(df)).collect(), key=lambda r: r["place"]):
        assert r["place"] == len(kept[r["conv_id"]])
        kept[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert {c: hashlib.sha256("\n".join(kept[c]).encode()).hexdigest() for c in want} == {c: v[-1] for c, v in want.items()}


def test_layers_hold_every_state():
    """Each state's first layer, over all short runs of turns, against the plain costs."""
    words, seen = {C.END}, {C.END}
    while words:
        words = {C.LAYERS[w, c][0] for w in words for c in (*range(8), C.MUST_GO)} - seen
        seen |= words
    assert len(seen) < 200
    for w in seen:
        lanes = [w >> 4 * k & 15 for k in range(C.LANES)]
        assert lanes[0] and lanes[-1] == 15 and all(a & b == a for a, b in zip(lanes, lanes[1:], strict=False))


def test_long_conversation(spark):
    rows = [(1, k, ("user", "assistant", "assistant")[k % 3], f"{k}.", 1) for k in range(20_000)]
    df = spark.createDataFrame(rows, f"{SCHEMA}, copies int")
    assert got(C.repair_digests(df)) == plain(rows)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert C.repair_digests(C.damage(df)).collect() == []
    dropped = next((c, t) for c in range(100) for t in range(9) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    one = spark.createDataFrame([(*dropped, "user", "Hi.")], SCHEMA)
    assert got(C.repair_digests(C.damage(one))) == {dropped[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_query(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(op12_conversation_repair(spark, data)) == plain(plain_damage(rows))
