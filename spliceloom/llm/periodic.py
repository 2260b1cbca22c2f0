"""Periodic runs: difference-cover LCE over words, and maximal runs read off a harmonic grid.

A run of period q and length 4q or more holds two words that stand q apart at places of the grid 0, 3q, 6q, ..., whatever its
start. So for each period only every 3q-th place of a text is looked at, n/3 * H(n/4) places in all; where the two words agree, their
longest common extensions to both sides bound the run. An extension (LCE) is found by a difference cover: of the suffixes of
the words only those are sorted that start at cover places modulo 31. Any two places reach cover places together within 30 words, which are
compared one by one; the rest is a range minimum, in a sparse table, over the blocks of 31 words that neighbours in sorted
order have in common, and at most 30 more words.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spliceloom.llm.common import small_batches
from spliceloom.llm.wordhash import mix

#: A perfect difference cover: each distance modulo MODULUS is that of one pair of its six places.
MODULUS, COVER = 31, (0, 1, 3, 8, 12, 18)
#: Least periods and least words of a run.
POWER, LEAST = 4, 6
#: Places of the grid that are handled at once.
BLOCK = 1 << 20

_SCHEMA = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>"


@lru_cache(maxsize=1)
def _shift() -> np.ndarray:
    """shift[a, b]: the least step after which places a and b modulo MODULUS are both in the cover."""
    inside = np.zeros(MODULUS, bool)
    inside[list(COVER)] = True
    out = np.full((MODULUS, MODULUS), MODULUS, np.int64)
    place = np.arange(MODULUS)
    for step in range(MODULUS - 1, -1, -1):
        out[inside[(place[:, None] + step) % MODULUS] & inside[(place[None, :] + step) % MODULUS]] = step
    return out


class LCE:
    """Longest common extensions of a sequence of numbers, whose last one must stand nowhere else."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.words, self.padded = words, np.concatenate((words, np.full(2 * MODULUS, -1)))
        chains = [np.arange(d, n, MODULUS) for d in COVER]
        place = np.concatenate(chains)  # sampled suffixes, those of a residue one after the other
        m = len(place)
        after = np.arange(1, m + 1)
        after[np.cumsum([len(c) for c in chains if len(c)]) - 1] = m  # the last of a residue is followed by nothing
        rank = self._blocks(place)
        # doubling: levels[k] names 2**k blocks, and names that begin alike stand together
        levels, steps = [np.append(rank, -1)], [np.append(after, m)]
        while rank.max() + 1 < m:
            after = steps[-1]
            follows = levels[-1][after[:m]]
            order = np.lexsort((follows, rank))
            new = (np.diff(rank[order]) != 0) | (np.diff(follows[order]) != 0)
            rank = np.empty(m, np.int64)
            rank[order] = np.cumsum(np.concatenate(([False], new)))
            levels.append(np.append(rank, -1))
            steps.append(after[after])
        self.rank = rank
        self.number = np.full(n + MODULUS, m)
        self.number[place] = np.arange(m)
        order = np.empty(m, np.int64)
        order[rank] = np.arange(m)
        # blocks that neighbours in sorted order have in common, by falling levels
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            same = (levels[k][a] == levels[k][b]) & (a < m) & (b < m)
            common[same] += 1 << k
            a[same], b[same] = steps[k][a[same]], steps[k][b[same]]
        self.table = [common]
        while 2 << (len(self.table) - 1) <= len(common):
            half = 1 << (len(self.table) - 1)
            self.table.append(np.minimum(self.table[-1][:-half], self.table[-1][half:]))

    def _blocks(self, place: np.ndarray) -> np.ndarray:
        """Numbers for the blocks of MODULUS words at the places, equal for equal blocks: hashed, and held against each other."""
        value = np.zeros(len(place), np.uint64)
        for k in range(MODULUS):
            value = mix(value + self.padded[place + k].view(np.uint64) + np.uint64(k))
        _, first, name = np.unique(value, return_index=True, return_inverse=True)
        other = place[first][name]
        if all((self.padded[place + k] == self.padded[other + k]).all() for k in range(MODULUS)):
            return name
        return np.unique(self.padded[place[:, None] + np.arange(MODULUS)], axis=0, return_inverse=True)[1].reshape(-1)

    def _plain(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from i and j on, compared one by one, most of them at most."""
        out = np.zeros(len(i), np.int64)
        live = np.arange(len(i))
        for k in range(MODULUS):
            live = live[most[live] > k]
            live = live[(self.padded[i[live] + k] == self.padded[j[live] + k]) & (self.padded[i[live] + k] >= 0)]
            if not len(live):
                break
            out[live] += 1
        return out

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at i and j, i != j, none past the end."""
        step = _shift()[i % MODULUS, j % MODULUS]
        out = self._plain(i, j, step)
        far = np.flatnonzero((out == step) & (i + step < len(self.words)) & (j + step < len(self.words)))
        if len(far):
            i, j = i[far] + step[far], j[far] + step[far]
            x, y = self.rank[self.number[i]], self.rank[self.number[j]]
            low, high = np.minimum(x, y), np.maximum(x, y)
            level = np.frexp(high - low)[1] - 1
            blocks = np.empty(len(far), np.int64)
            for k in np.unique(level).tolist():
                own = np.flatnonzero(level == k)
                blocks[own] = np.minimum(self.table[k][low[own]], self.table[k][high[own] - (1 << k)])
            ends = i + MODULUS * blocks, j + MODULUS * blocks
            out[far] += MODULUS * blocks + self._plain(*ends, np.full(len(far), MODULUS))
        return out


def _grid(sizes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and periods of the grid of texts of so many words, some BLOCK of them at a time."""
    most = sizes // POWER
    text = np.repeat(np.arange(len(sizes)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    count = -(-(sizes[text] - period) // ((POWER - 1) * period))
    total = np.cumsum(count)
    first = 0
    while first < len(text):
        last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + BLOCK, side="right")))
        some = count[first:last]
        turn = np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some)
        q = np.repeat(period[first:last], some)
        yield np.repeat(starts[text[first:last]], some) + turn * (POWER - 1) * q, q
        first = last


def _ahead(words: np.ndarray, i: np.ndarray, j: np.ndarray, step: int) -> np.ndarray:
    """Equal words from i and j on, to the right or (step -1) the left, up to MODULUS; texts end in numbers of their own."""
    out = np.zeros(len(i), np.int64)
    live = np.arange(len(i))
    for k in range(MODULUS):
        live = live[words[i[live] + step * k] == words[j[live] + step * k]]
        if not len(live):
            break
        out[live] += 1
    return out


def runs_of(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All maximal runs of texts, as start, length and least period, in order.

    words holds the texts' words as numbers from 0, each text with a lower number before and after it that stands once
    (starts and sizes tell where they are).
    """
    kept, lce = [], None
    for place, q in _grid(sizes, starts):
        same = words[place] == words[place + q]
        place, q = place[same], q[same]
        right = _ahead(words, place, place + q, 1)
        left = _ahead(words, place - 1, place + q - 1, -1)
        need = np.maximum(LEAST, POWER * q)
        # what a look at MODULUS words to each side can't rule out
        some = (left + right + q >= need) | (left == MODULUS) | (right == MODULUS)
        place, q, left, right, need = place[some], q[some], left[some], right[some], need[some]
        far = (left == MODULUS) | (right == MODULUS)
        if far.any():
            # extensions of the texts that need them, laid end to end
            text = np.searchsorted(starts, place, side="right") - 1
            used = np.unique(text[far])
            if lce is None or not np.array_equal(lce[0], used):
                own = np.concatenate([np.arange(starts[t] - 1, starts[t] + sizes[t] + 1) for t in used])
                ahead = words[own] - words.min()
                ahead[np.concatenate(([0], np.cumsum(sizes[used] + 2)[:-1]))] = ahead.max() + 1 + np.arange(len(used))
                shift = np.concatenate(([1], np.cumsum(sizes[used] + 2)[:-1] + 1)) - starts[used]
                lce = used, shift, len(own), LCE(ahead), LCE(ahead[::-1].copy())
            _, shift, size, right_of, left_of = lce
            at = place + shift[np.minimum(np.searchsorted(used, text), len(used) - 1)]
            some = right == MODULUS
            right[some] = right_of(at[some], at[some] + q[some])
            some = left == MODULUS
            left[some] = left_of(size - at[some], size - at[some] - q[some])
        long = left + right + q >= need
        kept.append(np.stack((place - left, left + right + q, q))[:, long])
    found = np.concatenate(kept, axis=1) if kept else np.zeros((3, 0), np.int64)
    # a multiple of a run's period bounds the same stretch: the least period stays
    order = np.lexsort((found[2], found[1], found[0]))
    found = found[:, order]
    new = np.ones(found.shape[1], bool)
    new[1:] = (np.diff(found[0]) != 0) | (np.diff(found[1]) != 0)
    found = found[:, new]
    order = np.lexsort((found[2], found[0]))
    return tuple(found[:, order])


def repeated(n: int, doc_id: int | None) -> np.ndarray:
    """For each of n words the word that stands there in the evaluation's texts: in one of ten a stretch is repeated."""
    source = np.arange(n)
    if n and doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            source[a:] = a + (source[a:] - a) % p
    return source


def _row(doc_id, words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> tuple:
    named = list(zip(start.tolist(), length.tolist(), period.tolist()))
    digest = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in named).encode()).hexdigest()
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, start + length, -1)
    kept = np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()
    plain = hashlib.sha256(b" ".join([words[k] for k in kept] if len(kept) < len(words) else words)).hexdigest()
    best = (None,) * 4
    if named:
        s, n, q = named[0]
        for x in named[1:]:
            if x[1] * q > n * x[2]:  # in order of start and period, so that ties go to the first
                s, n, q = x
        best = (s, n, q, 1000 * n // q)
    return (doc_id, len(words), len(named), *best, digest, plain, named)


def periodic_runs(docs: DataFrame, repeat: bool = False) -> DataFrame:
    """Maximal periodic runs of each row's words, and the text without their repetitions.

    docs needs doc_id and text; other columns are ignored. Words are what stands between white space (space and 9 to 13), compared by
    their bytes and numbered from 0. A run is a stretch of LEAST words or more, of at least POWER times its least period, that no
    neighbouring word extends. Columns: doc_id, n_words, n_runs; start, length, period and exponent_milli (length over period in
    thousandths, rounded down) of the run of greatest exponent, ties by start and then period, null without runs; runs_sha256 of all
    runs as lines of start, length and period; collapsed_sha256 of the words joined by one space without those that follow
    a run's first period; and runs themselves. With repeat, a stretch of some texts is repeated first (`repeated`), by a hash of doc_id.

    Null and empty texts have no words and no runs. Repeated rows give their rows each; a row without doc_id is searched as it
    stands. An empty table gives no rows. A text is handled in one task: one of n words takes some 300 bytes a word at
    most and time in proportion to n log n.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            ids = batch.column("doc_id").to_pylist()
            texts, names, pieces, sizes, fresh = [], {}, [], [], count()
            for k, (i, t) in enumerate(zip(ids, batch.column("text").to_pylist())):
                held = (t or "").encode().split()
                number = np.fromiter(map(names.setdefault, held, fresh), np.int64, len(held))
                if repeat:
                    source = repeated(len(held), i)
                    number = number[source]
                    held = [held[s] for s in source.tolist()]
                texts.append(held)
                sizes.append(len(held))
                pieces += [np.array([-2 - k]), number]
            sizes = np.array(sizes)
            starts = np.cumsum(sizes + 1) - sizes
            words = np.concatenate([*pieces, [-2 - len(texts)]]) if texts else np.zeros(0, np.int64)
            start, length, period = runs_of(words, starts, sizes)
            bounds = np.searchsorted(start, np.append(starts, len(words)))
            rows = [_row(ids[k], texts[k], *(x[bounds[k] : bounds[k + 1]] - (starts[k] if n == 0 else 0) for n, x in enumerate((start, length, period)))) for k in range(len(ids))]
            kinds = [*[pa.int64()] * 7, pa.string(), pa.string(), pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))]
            columns = list(zip(*rows))
            columns[9] = [[dict(zip(("start", "length", "period"), r)) for r in held] for held in columns[9]]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=[f.split(" ")[0] for f in _SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _SCHEMA)
