"""Words of many texts at once as 64-bit hashes, in numpy over UTF-8 bytes."""

from __future__ import annotations

import hashlib

import numpy as np

_RNG = np.random.default_rng(20_240_611)
_BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: White space of the word rule: space and the control characters 9 to 13.
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Groups of eight bytes up to which a word is hashed along with others, and masks of the first bytes of a group.
LANES = 32
_FIRST = np.array([2 ** (8 * k) - 1 for k in range(9)], np.uint64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]))
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h[i] is the polynomial hash of data[:i]; any slice's hash follows from two entries."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[data] * up[: len(data)], dtype=np.uint64, out=out[1:])
    return out


def slice_hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of data[start:stop], equal for equal bytes wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[stop] - prefix[start]) * down[start])


def word_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[starts:ends], eight bytes mixed in at a time; longer words than LANES of them by BLAKE2."""
    size = ends - starts
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    lanes = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    out = mix(size.astype(np.uint64) + np.uint64(_BASE))
    some = np.flatnonzero(size <= 8 * LANES)
    for k in range(LANES):
        some = some[size[some] > 8 * k]
        if not len(some):
            break
        out[some] = mix(out[some] ^ (lanes[starts[some] + 8 * k] & _FIRST[np.minimum(size[some] - 8 * k, 8)]))
    for k in np.flatnonzero(size > 8 * LANES).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def words(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (A-Z lower-cased, parted at gap) of all texts, and each text's first word."""
    starts, ends, bounds = word_places(data, offsets, gap)
    return word_hash(_LOWER[data], starts, ends), bounds


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased."""
    return _LOWER[data]


def word_places(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin and end, gap telling which bytes part them, and each text's first word."""
    solid = ~gap[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(solid & (first[:-1] | ~np.concatenate(([False], solid[:-1]))))
    ends = np.flatnonzero(solid & (first[1:] | ~np.concatenate((solid[1:], [False])))) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of width words per text, ascending, and each text's first one.

    A text with fewer words has its whole sequence as one shingle; one without words has none.
    """
    counts = np.diff(bounds)
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    rolled = np.zeros(len(hashes), np.uint64)
    for k in range(min(width, len(hashes))):
        rolled[: len(hashes) - k] = mix(rolled[: len(hashes) - k] + hashes[k:] + np.uint64(k + 1))
    doc = np.repeat(np.arange(len(counts)), counts)
    keep = np.arange(len(hashes)) + width <= bounds[1:][doc]
    own, value = doc[keep], rolled[keep]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        whole = np.array([_chain(hashes[bounds[d] : bounds[d + 1]]) for d in short], np.uint64)
        own, value = np.concatenate((own, short)), np.concatenate((value, whole))
    order = np.lexsort((value, own))
    own, value = own[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (own[1:] != own[:-1])
    own, value = own[new], value[new]
    return value, np.searchsorted(own, np.arange(len(bounds)))


def _chain(hashes: np.ndarray) -> int:
    value = np.array([len(hashes)], np.uint64)
    for h in hashes:
        value = mix(value * np.uint64(3) + h)
    return int(value[0])


class MinHash:
    """Many universal hash permutations x -> a*x + b modulo 2**32 with odd a; a signature holds the minima."""

    def __init__(self, permutations: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.a = (rng.integers(0, 2**31, permutations, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.b = rng.integers(0, 2**32, permutations, dtype=np.uint32)[:, None]
        self.n = permutations

    def signatures(self, values: np.ndarray, bounds: np.ndarray, block: int = 256) -> np.ndarray:
        """One row of minima per text; a text without shingles has all bits set."""
        out = np.full((len(bounds) - 1, self.n), 2**32 - 1, np.uint32)
        low = (values >> np.uint64(32)).astype(np.uint32)
        room = np.empty((self.n, block), np.uint32)
        for d in range(len(bounds) - 1):
            for start in range(bounds[d], bounds[d + 1], block):
                x = low[start : min(start + block, bounds[d + 1])]
                part = room[:, : len(x)]
                np.multiply(x, self.a, out=part)
                part += self.b
                np.minimum(out[d], part.min(axis=1), out=out[d])
        return out
