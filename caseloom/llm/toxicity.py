"""Toxic spans by a linear-chain conditional random field, and document scores."""

from __future__ import annotations

import math
import pickle
import re
import sys
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import bounded_batches, slices, trim

#: Bounds of the labelled sample that the model is fitted on: rows by label, and bytes of text.
SAMPLE = {1: 600, 0: 1800}
SAMPLE_BYTES = 16 << 20
PREFIXES = (4, 5, 6)
#: Beginnings that make words of one text a family.
FAMILIES = (4, 5, 6, 7, 8)
#: A feature marks toxic texts if it is so many times as frequent in them.
ODDS = 20.0
#: Numerical bound of emissions, beyond which doubles would overflow.
LIMIT = 60.0
#: Bytes of text that a worker scores at a time.
SLICE = 2 << 20
EDGES = ".,;:!?\"'()*#$%&|<>[]-"
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def word_of(token: bytes) -> str:
    """The token in lower case and without signs around it."""
    return token.decode("utf-8", "replace").strip(EDGES).lower()


def features(token: bytes) -> list[str]:
    """The word and its beginnings."""
    w = word_of(token)
    return [f"={w}", *[w[:k] for k in PREFIXES if len(w) > k]]


def families(words: Iterable[str]) -> set[str]:
    """Beginnings that two or more of the distinct words of a text share, both being longer."""
    seen = Counter(w[:k] for w in words for k in FAMILIES if len(w) > k)
    return {p for p, n in seen.items() if n > 1}


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -8.0
    start: tuple[float, float] = (0.99, 0.01)
    step: tuple[tuple[float, float], tuple[float, float]] = ((0.99, 0.01), (0.9, 0.1))
    slope: float = 1.0
    offset: float = 0.0
    kin: dict[str, float] = field(default_factory=dict)  # weights of families


class Emissions(dict):
    """Log odds that a token adds to state 1, less what families add; forgets all beyond ``limit`` tokens.

    ``related`` holds the tokens with a beginning that counts as a family.
    """

    def __init__(self, model: Model, limit: int = 200_000):
        super().__init__()
        self.model, self.limit = model, limit
        self.related: dict[bytes, tuple[str, list[str]]] = {}

    def __missing__(self, token: bytes) -> float:
        if len(self) >= self.limit:
            self.clear()
            self.related.clear()
        w, kin = self.model.weights, self.model.kin
        e = self[token] = self.model.bias + sum(w.get(f, 0.0) for f in features(token))
        if kin:
            word = word_of(token)
            if found := [word[:k] for k in FAMILIES if len(word) > k and word[:k] in kin]:
                self.related[token] = (word, found)
        return e

    def of(self, words: list[bytes]) -> list[float]:
        """Emissions of the tokens of one text."""
        out = [*map(self.__getitem__, words)]
        if self.related.keys().isdisjoint(words):
            return out
        known = [self.related.get(w) for w in words]
        seen = families({x[0] for x in known if x})
        kin = self.model.kin
        return [e + sum(kin[p] for p in x[1] if p in seen) if x else e for e, x in zip(out, known, strict=True)]


def _lanes(x: np.ndarray, lanes: int, steps: int, fill: float) -> np.ndarray:
    out = np.full(lanes * steps, fill, x.dtype)
    out[: len(x)] = x
    return np.ascontiguousarray(out.reshape(lanes, steps).T)


def _run(a: tuple[np.ndarray, ...], entry: np.ndarray) -> np.ndarray:
    """States after each step of all lanes, scaled to sum 1, from the states at entry (2, lanes)."""
    a00, a01, a10, a11 = a
    out = np.empty((len(a00), 2, entry.shape[1]))
    x0, x1 = entry
    for s in range(len(a00)):
        y0 = a00[s] * x0 + a01[s] * x1
        y1 = a10[s] * x0 + a11[s] * x1
        t = y0 + y1
        x0 = y0 / t
        x1 = y1 / t
        out[s, 0] = x0
        out[s, 1] = x1
    return out


def _product(a: tuple[np.ndarray, ...]) -> np.ndarray:
    """Product of each lane's matrices, (2, 2, lanes), up to a factor."""
    a00, a01, a10, a11 = a
    lanes = a00.shape[1]
    x0, x1 = np.stack([np.ones(lanes), np.zeros(lanes)]), np.stack([np.zeros(lanes), np.ones(lanes)])
    for s in range(len(a00)):
        y0 = a00[s] * x0 + a01[s] * x1
        y1 = a10[s] * x0 + a11[s] * x1
        t = (y0 + y1).sum(axis=0)
        x0 = y0 / t
        x1 = y1 / t
    return np.stack([x0, x1])


def _chain(a: tuple[np.ndarray, ...]) -> np.ndarray:
    """Entry states of all lanes, when one lane goes on where the one before ended."""
    p = _product(a)
    v = np.array([0.5, 0.5])
    entry = np.empty((2, p.shape[2]))
    for k in range(p.shape[2]):
        entry[:, k] = v
        v = p[:, :, k] @ v
        v /= v.sum()
    return entry


def marginals(emission: np.ndarray, first: np.ndarray, model: Model, pairs: bool = False):
    """Forward-backward over many texts at once: the probability of state 1 at each token.

    ``first`` marks the first token of each text. The texts are laid end to end and
    cut into equal lanes that numpy steps through side by side; lanes are joined by
    the products of their matrices, so the result is exact whatever the lengths.
    With ``pairs`` also the expected number of each transition, [from][to].
    """
    n = len(emission)
    if not n:
        return (np.empty(0), np.zeros((2, 2))) if pairs else np.empty(0)
    lanes = int(np.sqrt(n)) + 1
    steps = -(-n // lanes)
    e = np.exp(emission)
    (p00, p01), (p10, p11) = model.step
    s0, s1 = model.start
    a = (np.where(first, s0, p00), np.where(first, s0, p10), np.where(first, s1, p01) * e, np.where(first, s1, p11) * e)
    forward = tuple(_lanes(x, lanes, steps, f) for x, f in zip(a, (1.0, 1.0, 1.0, 1.0), strict=True))
    alpha = _run(forward, _chain(forward)).transpose(2, 0, 1).reshape(-1, 2)[:n]
    # backwards: the matrices of the next token, transposed, from the last token on
    last = [np.append(x[1:], 1.0)[::-1] for x in a]
    backward = tuple(_lanes(x, lanes, steps, 1.0) for x in (last[0], last[2], last[1], last[3]))
    beta = _run(backward, _chain(backward)).transpose(2, 0, 1).reshape(-1, 2)[:n][::-1]
    joint = alpha * beta
    p = joint[:, 1] / joint.sum(axis=1)
    if not pairs:
        return p
    inner = np.nonzero(~first)[0]
    xi = np.empty((2, 2, len(inner)))
    for i in (0, 1):
        for j in (0, 1):
            xi[i, j] = alpha[inner - 1, i] * a[2 * j + i][inner] * beta[inner, j]
    xi /= xi.sum(axis=(0, 1))
    return p, xi.sum(axis=2)


def _evidence(p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How much of each text is toxic, on a log scale: the sum of squared marginals, in which the
    many tokens that are surely clean add up to nothing."""
    total = np.concatenate([[0.0], np.cumsum(p * p)])
    return np.log(total[bounds[1:]] - total[bounds[:-1]] + 0.02)


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _tokens(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    words = [(t or b"").split() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)]).astype(np.int64)
    first = np.zeros(bounds[-1], bool)
    first[bounds[:-1][np.diff(bounds) > 0]] = True
    return words, bounds, first


def _surprise(c: int, o: int, share: float) -> float:
    """Likelihood ratio statistic of c toxic and o other texts, if toxic ones are ``share`` of all."""
    n = c + o
    return 2 * (c * math.log(c / (n * share)) + (o * math.log(o / (n * (1 - share))) if o else 0.0))


def _marking(of: Callable[[int], set[str]], toxic: list[int]) -> tuple[dict[str, float], set[str]]:
    """Log odds of the features of toxic texts, and those that mark them; ``of`` gives a text's.

    A feature marks if it is ``ODDS`` times as frequent in toxic texts and too rare an
    accident among so many candidates: its statistic exceeds twice the logarithm of
    their number. So a few texts suffice where few candidates compete.
    """
    seen, rest = Counter(), Counter()
    for d, y in enumerate(toxic):
        if y:
            seen.update(of(d))
    seen = {f: c for f, c in seen.items() if c > 1}
    for d, y in enumerate(toxic):
        if not y:
            rest.update(of(d) & seen.keys())
    n = sum(toxic)
    m = len(toxic) - n
    odds = {f: math.log((c + 0.5) / (n + 1.0)) - math.log((rest[f] + 0.5) / (m + 1.0)) for f, c in seen.items()}
    bar = 2 * math.log(max(2, len(seen)))
    marks = {f for f, v in odds.items() if v >= math.log(ODDS) and _surprise(seen[f], rest[f], n / (n + m)) > bar}
    return odds, marks


def fit(texts: list[bytes], toxic: list[int], rounds: int = 25) -> Model:
    """Fit the field on labelled texts; without both labels, a model that finds nothing.

    The labels are those of texts. A token of a toxic text counts as toxic where one
    of its features marks toxic texts: its word, a beginning of it, or a beginning that
    several words of the text share. On these token labels the field's weights,
    transitions and start are fitted by maximum likelihood with an L2 penalty. The score
    of a text is a logistic function of its evidence, fitted on the labels of the texts.
    """
    model = Model()
    y_doc = np.array(toxic, float)
    n_pos, n_neg = int(y_doc.sum()), int(len(y_doc) - y_doc.sum())
    if not n_pos or not n_neg:
        return Model(slope=0.0, offset=-5.0)
    words, bounds, first = _tokens(texts)
    ids: dict[bytes, int] = {}
    for ws in words:
        for w in ws:
            ids.setdefault(w, len(ids))
    known = [tuple(map(sys.intern, features(w))) for w in ids]
    plain = [fs[0][1:] for fs in known]
    token = np.fromiter((ids[w] for ws in words for w in ws), np.int64, bounds[-1])
    del words
    tokens_of = lambda d: np.unique(token[bounds[d] : bounds[d + 1]]).tolist()
    odds, marks = _marking(lambda d: {f for k in tokens_of(d) for f in known[k]}, toxic)
    kin = lambda d: families({plain[k] for k in tokens_of(d)})
    _, kin_marks = _marking(kin, toxic)
    # what tells, and the words themselves of all tokens that it touches
    telling = {f for f, v in odds.items() if v >= 1.0 and (f in marks or v >= math.log(ODDS) / 2)}
    telling |= {fs[0] for fs, w in zip(known, plain, strict=True) if any(f in telling for f in fs) or any(w[:k] in kin_marks for k in FAMILIES if len(w) >= k)}
    use = [*sorted(telling), *sorted(f"~{p}" for p in kin_marks)]
    column = {f: k for k, f in enumerate(use)}
    marked = np.fromiter((any(f in marks for f in fs) for fs in known), bool, len(known))
    # families depend on the text, so their places are listed token by token
    at, what_kin = [], []
    related = {k: [w[:j] for j in FAMILIES if len(w) > j and w[:j] in kin_marks] for k, w in enumerate(plain)}
    for d in range(len(texts)):
        here = kin(d) & kin_marks
        if here:
            for t in range(bounds[d], bounds[d + 1]):
                for p in related[token[t]]:
                    if p in here:
                        at.append(t)
                        what_kin.append(column[f"~{p}"])
    at, what_kin = np.array(at, np.int64), np.array(what_kin, np.int64)
    y = marked[token]
    y[at] = True
    y &= np.repeat(y_doc.astype(bool), np.diff(bounds))
    who = np.fromiter((k for k, fs in enumerate(known) for f in fs if f in column), np.int64)
    what = np.fromiter((column[f] for fs in known for f in fs if f in column), np.int64)
    counts = np.zeros((2, 2))
    inner = np.nonzero(~first)[0]
    np.add.at(counts, (y[inner - 1].astype(int), y[inner].astype(int)), 1)
    model.step = tuple(map(tuple, (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)))
    s = (y[first].sum() + 0.5) / (first.sum() + 1.0)
    model.start = (1 - s, s)
    # Adam on the weights of features, the bias, and the logarithms of the transitions
    theta = np.zeros(len(use) + 5)
    theta[len(use) + 1 :] = np.log(np.array(model.step)).ravel()
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    scale = max(1.0, y.sum())
    for k in range(1, rounds + 1):
        w = theta[: len(use)]
        emission = (theta[len(use)] + np.bincount(who, w[what], len(known)))[token]
        np.add.at(emission, at, w[what_kin])
        emission = np.clip(emission, -LIMIT, LIMIT)
        model.step = tuple(map(tuple, np.exp(theta[len(use) + 1 :].reshape(2, 2))))
        p, expected = marginals(emission, first, model, pairs=True)
        rest = np.bincount(token, y - p, len(known))
        g = np.bincount(what, rest[who], len(use)) + np.bincount(what_kin, (y - p)[at], len(use))
        g = np.concatenate([g, [rest.sum()], (counts - expected).ravel()]) / scale
        g[: len(use)] -= 4.0 * w / scale
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta += 0.5 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-6) * min(1.0, 4 * (1 - k / (rounds + 1)))
    model.weights = {f: float(theta[c]) for f, c in column.items() if f[0] != "~" and abs(theta[c]) > 1e-3}
    model.kin = {f[1:]: float(theta[c]) for f, c in column.items() if f[0] == "~"}
    model.bias = float(theta[len(use)])
    model.step = tuple(map(tuple, np.exp(theta[len(use) + 1 :].reshape(2, 2)).tolist()))
    del known, plain, related, ids
    emissions, x = Emissions(model), np.empty(len(texts))
    for d in range(0, len(texts), 200):
        words, at_, starts = _tokens(texts[d : d + 200])
        x[d : d + 200] = _evidence(marginals(_emit(words, at_, emissions), starts, model), at_)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic regression on one variable
        q = _sigmoid(a * x + b)
        h = q * (1 - q) + 1e-9
        ga, gb = ((y_doc - q) * x).sum() - 0.01 * a, (y_doc - q).sum() - 0.01 * b
        haa, hab, hbb = (h * x * x).sum() + 0.01, (h * x).sum(), h.sum() + 0.01
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a + float(np.clip(da, -1, 1)), b + float(np.clip(db, -1, 1))
    model.slope, model.offset = a, b
    return model


def _emit(words: list[list[bytes]], bounds: np.ndarray, emissions: Emissions) -> np.ndarray:
    return np.clip(np.fromiter(chain.from_iterable(map(emissions.of, words)), float, bounds[-1]), -LIMIT, LIMIT)


def _spans(text: bytes, p: np.ndarray) -> list[dict]:
    """Runs of tokens with probability 0.5 or more, as code point offsets."""
    out: list[dict] = []
    for k, m in enumerate(_TOKEN.finditer(text.decode("utf-8", "replace"))):
        if p[k] >= 0.5:
            if out and k == out[-1]["k"] + 1:
                out[-1] |= {"end": m.end(), "k": k}
            else:
                out.append({"start": m.start(), "end": m.end(), "k": k})
    return [{"start": s["start"], "end": s["end"]} for s in out]


def _fitted(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The model of the rows, pickled. A text that would exceed ``most`` bytes in all teaches nothing."""
    texts, toxic, held = [], [], 0
    for batch in slices(batches, "_text"):
        for text, label in zip(batch.column("_text").to_pylist(), batch.column("_toxic").to_pylist(), strict=True):
            if held + len(text) <= most:
                held += len(text)
                texts.append(text)
                toxic.append(label)
    model = pickle.dumps(fit(texts, toxic))
    del texts, toxic
    trim()
    yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])


def train(docs: DataFrame, labels: DataFrame, sample: dict[int, int] | None = None, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """The model of the labelled rows whose crc32(doc_id) mod 5 is not 0.

    It is fitted by one task of the cluster on a bounded sample: of each label the
    ``sample`` ids with the least hash of doc_id, one text an id (the least one where rows
    repeat it), whole texts up to ``sample_bytes`` in all. As the sampled ids are so few,
    they are broadcast; the driver sees the model only. Rows without doc_id, text or
    label teach nothing.
    """
    wanted = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("_toxic")).where("_id is not null and _toxic in (0, 1)")
    wanted = wanted.where(F.crc32(F.col("_id").cast("string").cast("binary")) % 5 != 0).distinct()
    parts = [wanted.where(F.col("_toxic") == label).orderBy(F.xxhash64("_id"), "_id").limit(most) for label, most in (sample or SAMPLE).items()]
    drawn = reduce(DataFrame.unionByName, parts)
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("binary").alias("_text")).where("_text is not null").join(F.broadcast(drawn), "_id")
    rows = rows.groupBy("_id", "_toxic").agg(F.min("_text").alias("_text"))
    one = rows.repartition(1).sortWithinPartitions(F.xxhash64("_id"), "_id", "_toxic").select("_text", "_toxic")
    with bounded_batches(docs.sparkSession):
        found = one.mapInArrow(lambda it: _fitted(it, sample_bytes), "model binary").head(1)
    return pickle.loads(found[0]["model"]) if found else fit([], [])  # no task runs where there are no rows


def _score(texts: list[bytes | None], model: Model, emissions: Emissions) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of the texts, the marginals of all their tokens, and the bounds between texts."""
    words, bounds, first = _tokens(texts)
    p = marginals(_emit(words, bounds, emissions), first, model)
    return _sigmoid(model.slope * _evidence(p, bounds) + model.offset), p, bounds


def clean_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is below 0.5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emissions = Emissions(model)
        for batch in slices(batches, "text", size=SLICE):
            texts = [None if t is None else t.encode() for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(_score(texts, model, emissions)[0] < 0.5))
        del emissions
        trim()

    return docs.mapInArrow(run, docs.schema)


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted, spans`` for every row of ``docs (doc_id, text)``.

    The marginals of the field over the whole text give the expected number of toxic
    tokens and from it the score (0 to 1); ``spans`` are the code point offsets of
    runs of tokens more likely toxic than not. Null and empty texts have no tokens
    and get the score of texts without evidence. ``held_out`` says whether
    crc32(doc_id as text) mod 5 is 0 (null doc_id: false). Repeated rows stay; other
    columns are ignored, labels are no input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emissions = Emissions(model)
        for batch in slices(batches, "text", size=SLICE):
            texts = batch.column("text").to_pylist()
            score, p, bounds = _score(texts, model, emissions)
            high = np.concatenate([[0], np.cumsum(p >= 0.5)])[bounds]
            spans = [_spans(t, p[bounds[k] : bounds[k + 1]]) if high[k + 1] > high[k] else [] for k, t in enumerate(texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score, pa.float64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["doc_id", "score", "spans"]
            )

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, score double, spans array<struct<start: long, end: long>>")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
