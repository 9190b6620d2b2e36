"""Word shingles as 64-bit hashes, and HyperMinHash sketches of their sets (numpy)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

WIDTH = 5
BUCKETS = 128
ROWS = 4
BANDS = BUCKETS // ROWS
MANTISSA = 10
MAX_LZ = 53

_P = np.uint64(0x9E3779B97F4A7C15)
_C1 = np.uint64(0xFF51AFD7ED558CCD)
_C2 = np.uint64(0xC4CEB9FE1A85EC53)


class WordHashes(dict):
    """Word to 64-bit hash; forgets all when it grows past ``limit`` words."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _C1
    h = (h ^ (h >> np.uint64(29))) * _C2
    return h ^ (h >> np.uint64(32))


def shingle_set(text: bytes | None, hashes: WordHashes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles of the lower-cased text.

    ``bytes.lower`` changes A-Z only and ``bytes.split`` cuts at exactly the white
    space of the contract. Fewer words than ``width``: the whole sequence is one
    shingle. No words: an empty array.
    """
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    take = min(n, width)
    h = np.full(n - take + 1, take, np.uint64)
    for k in range(take):
        h = (h ^ (h >> np.uint64(31))) * _P + ids[k : n - take + 1 + k]
    return np.unique(_mix(h))


@lru_cache(maxsize=4)
def _probes(buckets: int) -> np.ndarray:
    """For each bucket, all buckets in an order of its own: where an empty one borrows."""
    return np.stack([np.random.RandomState(7919 + b).permutation(buckets) for b in range(buckets)]).astype(np.int16)


def registers(hashes: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """HyperMinHash registers of a non-empty sorted set of hashes; ``buckets`` a power of two.

    The top bits choose the bucket. Of the bucket's least hash the register keeps the
    count of leading zeros and the 10 bits after the first one. An empty bucket
    borrows the register of the first full one in its own fixed order, so that
    registers of small sets still agree with the probability of their Jaccard
    similarity.
    """
    top = np.uint64(65 - buckets.bit_length())
    numbers = np.arange(buckets, dtype=np.uint64)
    at = np.searchsorted(hashes, numbers << top)
    least = hashes[np.minimum(at, len(hashes) - 1)]
    full = (at < len(hashes)) & (least >> top == numbers)
    v = least << np.uint64(buckets.bit_length() - 1)
    lz = np.where(v >> np.uint64(11) == 0, MAX_LZ, 53 - np.frexp((v >> np.uint64(11)).astype(np.float64))[1]).astype(np.uint64)
    mantissa = (v << (lz + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    reg = (lz << np.uint64(MANTISSA)) | mantissa
    if not full.all():
        empty = np.nonzero(~full)[0]
        order = _probes(buckets)[empty]
        reg[empty] = reg[order[np.arange(len(empty)), full[order].argmax(axis=1)]]
    return reg


def bands(reg: np.ndarray) -> np.ndarray:
    """The registers four by four, as 32 signed 64-bit numbers: sketch and band keys in one."""
    r = reg.reshape(BANDS, ROWS)
    packed = r[:, 0] << np.uint64(48) | r[:, 1] << np.uint64(32) | r[:, 2] << np.uint64(16) | r[:, 3]
    return packed.view(np.int64)


def collision_rate(n_a: float, n_b: float) -> float:
    """Probability that registers of two disjoint sets of these sizes agree."""
    lz = np.arange(MAX_LZ + 1)
    spread = lambda n: np.exp(-(n / BUCKETS) * 2.0 ** -(lz + 1)) - np.exp(-(n / BUCKETS) * 2.0**-lz)
    return float((spread(n_a) * spread(n_b)).sum() * 2.0**-MANTISSA)
