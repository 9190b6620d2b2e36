"""Weighted edit distance for misread characters, as an Arrow UDF."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Costs:
    """What misreadings cost. ``alike``: groups of letters that are cheap to swap;
    ``joined``: (two letters, one letter) that are cheap to swap for each other."""

    alike: tuple[str, ...] = ()
    alike_cost: float = 0.3
    joined: tuple[tuple[str, str], ...] = ()
    joined_cost: float = 0.4
    cheap: frozenset = field(init=False, default=frozenset())

    def __post_init__(self):
        object.__setattr__(self, "cheap", frozenset((a, b) for g in self.alike for a in g for b in g))


PLAIN = Costs()
#: Pairs that scans confuse, for text in lower case. Fixed values.
SCAN = Costs(alike=("1l", "9g", "nh"), joined=(("rn", "m"), ("cl", "d"), ("ii", "n"), ("vv", "w"), ("li", "h"), ("nn", "m")))


@lru_cache(maxsize=200_000)
def weighted_distance(a: str, b: str, costs: Costs = SCAN) -> float:
    """Least cost to turn ``a`` into ``b``; symmetric, never above the plain edit distance."""
    if a == b:
        return 0.0
    rows = [[float(j) for j in range(len(b) + 1)]]
    for i in range(1, len(a) + 1):
        row = [float(i)]
        for j in range(1, len(b) + 1):
            x, y = a[i - 1], b[j - 1]
            swap = 0.0 if x == y else costs.alike_cost if (x, y) in costs.cheap else 1.0
            best = min(rows[i - 1][j] + 1.0, row[j - 1] + 1.0, rows[i - 1][j - 1] + swap)
            for two, one in costs.joined:
                if i > 1 and a[i - 2 : i] == two and y == one:
                    best = min(best, rows[i - 2][j - 1] + costs.joined_cost)
                if j > 1 and b[j - 2 : j] == two and x == one:
                    best = min(best, rows[i - 1][j - 2] + costs.joined_cost)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


#: Costs are whole numbers of this part of a change, and pairs are taken so many at a time.
PARTS, PAIRS = 1000, 4096


def distances(left: list[str], right: list[str], costs: Costs = SCAN) -> np.ndarray:
    """``weighted_distance`` of many pairs at once.

    Pairs of like length share a table of costs, one cell a pair deep. A row of it needs the two
    rows before it; what a cell owes to its left neighbour is a running minimum along the row.
    As cells depend on beginnings only, shorter pairs are read off the same table.
    """
    out = np.zeros(len(left))
    order = sorted(range(len(left)), key=lambda k: (len(left[k]), len(right[k])))
    whole = lambda c: round(c * PARTS)
    step, alike, joined = PARTS, whole(costs.alike_cost), whole(costs.joined_cost)
    for start in range(0, len(order), PAIRS):
        ks = order[start : start + PAIRS]
        la, lb = np.array([len(left[k]) for k in ks]), np.array([len(right[k]) for k in ks])
        high, wide = la.max(initial=0), lb.max(initial=0)
        a = np.array([[ord(c) for c in left[k].ljust(high, "\0")] for k in ks], np.int32).reshape(len(ks), high).T
        b = np.array([[ord(c) for c in right[k].ljust(wide, "\0")] for k in ks], np.int32).reshape(len(ks), wide).T
        places = np.arange(wide + 1, dtype=np.int32)[:, None] * step
        rows = [None, np.repeat(places, len(ks), axis=1)]
        found = rows[1][lb, np.arange(len(ks))].copy()  # of empty texts
        cheap_a, cheap_b = [[np.isin(x, [ord(c) for c in g]) for g in costs.alike] for x in (a, b)]
        for i in range(1, high + 1):
            x, before, last = a[i - 1], rows[0], rows[1]
            swap = np.where(b == x, 0, step).astype(np.int32)
            for ga, gb in zip(cheap_a, cheap_b, strict=True):
                swap = np.where(gb & ga[i - 1] & (b != x), alike, swap)
            row = np.empty_like(last)
            row[0] = i * step
            row[1:] = np.minimum(last[1:] + step, last[:-1] + swap)
            for two, one in costs.joined:
                p, q, r = ord(two[0]), ord(two[1]), ord(one)
                if i > 1:
                    here = (a[i - 2] == p) & (x == q) & (b == r)
                    row[1:] = np.where(here, np.minimum(row[1:], before[:-1] + joined), row[1:])
                here = (b[:-1] == p) & (b[1:] == q) & (x == r)
                row[2:] = np.where(here, np.minimum(row[2:], last[:-2] + joined), row[2:])
            row = np.minimum.accumulate(row - places, axis=0) + places
            done = la == i
            found[done] = row[lb[done], np.nonzero(done)[0]]
            rows = [last, row]
        out[ks] = found / PARTS
    return out


def distance(a: Column, b: Column, costs: Costs = SCAN) -> Column:
    """``weighted_distance`` of two columns, by Arrow batches. Put it on distinct pairs.
    Without costs of its own it is Spark's ``levenshtein``, which stays in the JVM.

    It is marked so that the optimizer leaves it where it is put, once: conditions on a distance
    were moved in front of the ``distinct()`` before it, and met every row there.
    """
    if costs == PLAIN:
        return F.levenshtein(a, b).cast("double")

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            known = x.notna() & y.notna()
            d = np.full(len(x), np.nan)
            d[known] = distances(x[known].tolist(), y[known].tolist(), costs)
            yield pd.Series(d).astype("object").where(known.to_numpy(), None).astype("Float64")

    return run.asNondeterministic()(a, b)
