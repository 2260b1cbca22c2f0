"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Each word enters with a learned vector of its hash bucket and its labelled log odds (word input) and with the
mean of learned vectors of its character pairs (character input). Windows of WINDOW words, each overlapping
the next by half, are read in both directions; attention pools the states and a logistic unit scores the
window. A text's score is the greatest of its windows'.

Training takes STEPS steps of stochastic descent, of BATCH windows each, whatever the sample's size; the windows are drawn
in rounds: of each text the one that scores highest, and CLEAN of clean texts for each of these, drawn anew from
all. Scoring reads every window, those of a long text in stretches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spliceloom.llm.common import small_batches, text_bytes
from spliceloom.llm.quality import labelled
from spliceloom.llm.wordhash import lowered, prefix_hash, slice_hash, word_places

#: Labelled rows that are learned from, at most; words per window and between windows; sizes of the network.
SAMPLE, WINDOW, STRIDE = 3000, 24, 12
HIDDEN, WORD, CHAR = 8, 4, 4
BUCKETS, PAIRS = 1 << 16, 1 << 10
#: Texts that a word's log odds count besides those seen, in the labels' own proportion.
PRIOR = 30
#: Steps of training, windows of a step, and windows of clean texts beside each text's best.
STEPS, BATCH, CLEAN = 340, 128, 2
#: Bytes of a stretch of a text that is scored at once; it goes on to the next end of a word.
STRETCH = 1_000_000
#: Bytes from which a run is read as several words.
LONGEST = 64
#: Words are runs of letters, digits and bytes of other scripts.
_GAP = np.ones(256, bool)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_GAP_OF = _GAP.tolist()


def _pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of more than LONGEST bytes broken into consecutive ones, at the start of a character where one is near."""
    many = np.maximum(1, -(-(ends - starts) // LONGEST))
    if not (many > 1).any():
        return starts, ends, bounds
    before = np.concatenate(([0], np.cumsum(many)))
    step = np.arange(before[-1]) - np.repeat(before[:-1], many)
    cut = np.repeat(starts, many) + step * LONGEST
    for _ in range(3):  # back to the first byte of the character
        cut = cut - ((step > 0) & (data[cut] >= 128) & (data[cut] < 192))
    last = np.repeat(ends, many)
    stop = np.where(step + 1 < np.repeat(many, many), np.concatenate((cut[1:], last[-1:])), last)
    return cut, stop, before[bounds]


class Words:
    """The words of a batch of texts: bucket of each, its character pairs, and each text's first word."""

    def __init__(self, texts: pa.Array):
        data, offsets = text_bytes(texts)
        low = lowered(data)
        starts, ends, self.bounds = _pieces(low, *word_places(data, offsets, _GAP))
        hashes = slice_hash(prefix_hash(low), starts, ends)
        _, first, self.kind = np.unique(hashes, return_index=True, return_inverse=True)
        self.bucket = (hashes[first] >> np.uint64(48)).astype(np.int64)
        starts, size = starts[first], (ends - starts)[first]
        # character pairs of each distinct word, with marks before its first and after its last byte
        many = size + 1
        self.own = np.repeat(np.arange(len(first)), many)
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        place = np.repeat(starts, many) + at
        padded = np.concatenate(([0], low, [0])).astype(np.int64)
        left = np.where(at > 0, padded[np.minimum(place, len(padded) - 1)], 0)
        right = np.where(at < np.repeat(size, many), padded[np.minimum(place + 1, len(padded) - 1)], 0)
        self.pair = (left * 31 + right * 257) % PAIRS
        self.pairs = many

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All windows: their text, first word and number of words. A text without words has one empty window."""
        count = np.diff(self.bounds)
        number = np.maximum(1, -(-(count - (WINDOW - STRIDE)) // STRIDE))
        text = np.repeat(np.arange(len(count)), number)
        step = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
        return text, self.bounds[text] + step * STRIDE, np.minimum(WINDOW, count[text] - step * STRIDE)


def stretches(text: str, size: int | None = None) -> Iterator[str]:
    """A text in stretches of size characters or some more, whose windows together are those of the text.

    Each goes on to the end of a word. The next begins at the word where the first window begins that doesn't fit in; only
    a run of over LONGEST bytes of other scripts, where one ends, may be broken a few bytes aside from where it else would.
    """
    size = size or STRETCH
    at = 0
    while True:
        stop = min(at + size, len(text))
        while stop < len(text) and (text[stop] > "\x7f" or not _GAP_OF[ord(text[stop])]):
            stop += 1
        part = text[at:stop]
        if stop == len(text):
            yield part
            return
        data, offsets = text_bytes(pa.array([part], pa.large_string()))
        low = lowered(data)
        starts, _, _ = _pieces(low, *word_places(data, offsets, _GAP))
        fits = (len(starts) - WINDOW) // STRIDE + 1 if len(starts) >= WINDOW else 0
        if not fits:  # few words, of much white space: with more text behind them
            size *= 2
            continue
        # the last window of a stretch that is cut has to be whole
        end = (fits - 1) * STRIDE + WINDOW
        yield data[: starts[end] if end < len(starts) else len(data)].tobytes().decode()
        at += len(data[: starts[fits * STRIDE]].tobytes().decode())


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class BiGRU:
    """Weights of the network as a dict of float32 arrays, its forward pass and its gradients."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, s=0.3: (rng.standard_normal(shape) * s).astype(np.float32)
        width = 2 + WORD + CHAR
        self.w = {"word": draw(BUCKETS, WORD, s=0.05), "char": draw(PAIRS, CHAR, s=0.1), "v": draw(2 * HIDDEN), "o": draw(2 * HIDDEN), "c": np.zeros(1, np.float32)}
        for d in "fb":
            self.w |= {f"x{d}": draw(width, 3 * HIDDEN), f"u{d}": draw(HIDDEN, 3 * HIDDEN), f"g{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.odds = np.zeros((BUCKETS, 2), np.float32)

    def inputs(self, words: Words) -> np.ndarray:
        """Input vectors of the distinct words."""
        chars = self.w["char"][words.pair]
        total = np.stack([np.bincount(words.own, chars[:, k], len(words.bucket)) for k in range(CHAR)], axis=1) if len(words.bucket) else np.zeros((0, CHAR))
        return np.concatenate((self.odds[words.bucket], self.w["word"][words.bucket], total / np.maximum(words.pairs, 1)[:, None]), axis=1).astype(np.float32)

    def states(self, gates: np.ndarray, index: np.ndarray, sizes: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States of one direction, (words of a window, windows, HIDDEN); gates of each distinct word are given."""
        steps = range(index.shape[1]) if d == "f" else range(index.shape[1] - 1, -1, -1)
        h = np.zeros((len(index), HIDDEN), np.float32)
        out = np.zeros((index.shape[1], len(index), HIDDEN), np.float32)
        u, n = self.w[f"u{d}"], HIDDEN
        for t in steps:
            x, hu = gates[index[:, t]], h @ u
            zr = _sigmoid(x[:, : 2 * n] + hu[:, : 2 * n])
            z, r = zr[:, :n], zr[:, n:]
            c = np.tanh(x[:, 2 * n :] + r * hu[:, 2 * n :])
            inside = (t < sizes)[:, None]
            new = np.where(inside, c + z * (h - c), h)
            if keep is not None:
                keep.append((t, h, z, r, c, hu[:, 2 * n :], inside))
            h = new
            out[t] = h
        return out

    def gates(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {d: x @ self.w[f"x{d}"] + self.w[f"g{d}"] for d in "fb"}

    def logits(self, gates: dict, index: np.ndarray, sizes: np.ndarray, keep: dict | None = None) -> np.ndarray:
        tape = {d: [] if keep is not None else None for d in "fb"}
        s = np.concatenate([self.states(gates[d], index, sizes, d, tape[d]) for d in "fb"], axis=2)
        mark = s @ self.w["v"]
        mark = np.where(np.arange(index.shape[1])[:, None] < np.maximum(sizes, 1), mark, -1e9)
        a = np.exp(mark - mark.max(axis=0))
        a /= a.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", a, s)
        if keep is not None:
            keep |= {"tape": tape, "s": s, "a": a, "pooled": pooled}
        return pooled @ self.w["o"] + self.w["c"]

    def gradients(self, words: Words, x: np.ndarray, index: np.ndarray, sizes: np.ndarray, wanted: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted mean logistic loss of windows; word and char tables as (rows, values)."""
        keep: dict = {}
        gates = self.gates(x)
        p = _sigmoid(self.logits(gates, index, sizes, keep))
        g, n = {}, HIDDEN
        dl = ((p - wanted) * weight / weight.sum()).astype(np.float32)
        g["o"], g["c"] = keep["pooled"].T @ dl, np.array([dl.sum()], np.float32)
        dp = dl[:, None] * self.w["o"]
        s, a = keep["s"], keep["a"]
        da = np.einsum("bh,tbh->tb", dp, s)
        dm = a * (da - (a * da).sum(axis=0))
        g["v"] = np.einsum("tb,tbh->h", dm, s)
        ds = a[:, :, None] * dp + dm[:, :, None] * self.w["v"]
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            u, dgates = self.w[f"u{d}"], np.zeros_like(gates[d])
            g[f"u{d}"], dh = np.zeros_like(u), np.zeros((len(index), n), np.float32)
            for t, h, z, r, c, hc, inside in reversed(keep["tape"][d]):
                dh = dh + ds[t, :, k * n : k * n + n]
                dc = np.where(inside, dh * (1 - z) * (1 - c * c), 0)
                dz = np.where(inside, dh * (h - c) * z * (1 - z), 0)
                dr = dc * hc * r * (1 - r)
                dhu = np.concatenate((dz, dr, dc * r), axis=1)
                np.add.at(dgates, index[:, t], np.concatenate((dz, dr, dc), axis=1))
                g[f"u{d}"] += h.T @ dhu
                dh = np.where(inside, dh * z, dh) + dhu @ u.T
            g[f"x{d}"], g[f"g{d}"] = x.T @ dgates, dgates.sum(axis=0)
            dx += dgates @ self.w[f"x{d}"].T
        used = np.flatnonzero(np.abs(dx).sum(axis=1))
        g["word"] = (words.bucket[used], dx[used, 2 : 2 + WORD])
        some = np.isin(words.own, used)
        g["char"] = (words.pair[some], (dx[:, 2 + WORD :] / words.pairs[:, None])[words.own[some]])
        return g


class Toxicity:
    """The network with its training and the scoring of texts."""

    def __init__(self, texts: list[str], labels: np.ndarray, seed: int = 3):
        self.net = BiGRU()
        self.shift = 0.0
        self.known = bool(len(texts)) and 0 < labels.sum() < len(labels)
        if self.known:
            rng = np.random.default_rng(seed)
            labels = labels.astype(int)
            aside = rng.random(len(texts)) < 0.2
            if not 0 < labels[aside].sum() < aside.sum() or not 0 < labels[~aside].sum() < (~aside).sum():
                aside[:] = False
            self._train([t for t, a in zip(texts, aside) if not a], labels[~aside], rng)
            if aside.any():
                self._calibrate(self._texts(pa.array([t for t, a in zip(texts, aside) if a], pa.large_string())), labels[aside])

    def _calibrate(self, logits: np.ndarray, labels: np.ndarray) -> None:
        """Shift the logits so that score 0.3 stands amid the cuts whose F1 on texts set aside is best or nearly so."""
        order = np.argsort(-logits)
        hit = np.cumsum(labels[order])
        f1 = 2 * hit / (np.arange(1, len(hit) + 1) + labels.sum())
        good = np.flatnonzero(f1 >= f1.max() - 0.03)
        low = logits[order[min(good[-1] + 1, len(order) - 1)]]
        self.shift = float(np.log(0.3 / 0.7) - (logits[order[good[0]]] + low) / 2)

    def _train(self, texts: list[str], labels: np.ndarray, rng: np.random.Generator) -> None:
        words = Words(pa.array(texts, pa.large_string()))
        text = np.repeat(np.arange(len(texts)), np.diff(words.bounds))
        held = np.unique(text * len(words.bucket) + words.kind)  # distinct words of each text
        bucket, toxic = words.bucket[held % len(words.bucket)], labels[held // len(words.bucket)]
        share = labels.mean()
        bad, all_ = np.bincount(bucket, toxic, BUCKETS), np.bincount(bucket, minlength=BUCKETS)
        odds = np.log((bad + PRIOR * share) / (all_ - bad + PRIOR * (1 - share))) - np.log(share / (1 - share))
        self.net.odds = np.stack((odds, np.log1p(all_) / 4), axis=1).astype(np.float32)
        owner, first, sizes = words.windows()
        index = self._index(words, first, sizes)
        inside = np.arange(WINDOW) < sizes[:, None]
        peak = np.where(inside, odds.astype(np.float32)[words.bucket][index] if len(words.bucket) else 0, -9).max(axis=1)
        moments = {}
        step = 0
        while step < STEPS:
            lead = peak if step == 0 else self._logits(words, index, sizes)
            best = np.lexsort((-lead, owner))  # of each text, the window that scores highest
            best = best[np.unique(owner[best], return_index=True)[1]]
            clean = np.flatnonzero(labels[owner] == 0)
            some = np.concatenate((best, rng.choice(clean, min(len(clean), CLEAN * len(best)), replace=False)))
            rng.shuffle(some)
            weight = np.where(labels[owner[some]] == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
            for start in range(0, min(len(some), (STEPS - step) * BATCH), BATCH):
                b = some[start : start + BATCH]
                x = self.net.inputs(words) if len(words.bucket) < 4096 else None
                part, local = words, index[b]
                if x is None:
                    part, local = self._part(words, index[b])
                    x = self.net.inputs(part)
                g = self.net.gradients(part, x, local, sizes[b], labels[owner[b]], weight[start : start + BATCH])
                step += 1
                self._adam(g, moments, step)

    @staticmethod
    def _part(words: Words, index: np.ndarray) -> tuple[Words, np.ndarray]:
        """Only the distinct words that index names."""
        kinds, local = np.unique(index, return_inverse=True)
        part = object.__new__(Words)
        part.bucket, part.pairs = words.bucket[kinds], words.pairs[kinds]
        begin = np.cumsum(words.pairs) - words.pairs
        part.own = np.repeat(np.arange(len(kinds)), part.pairs)
        at = np.arange(len(part.own)) - np.repeat(np.cumsum(part.pairs) - part.pairs, part.pairs)
        part.pair = words.pair[np.repeat(begin[kinds], part.pairs) + at]
        return part, local.reshape(index.shape)

    def _adam(self, g: dict, moments: dict, step: int, rate: float = 0.01) -> None:
        for name, d in g.items():
            w = self.net.w[name]
            if name == "word":  # plain steps: rare words shall not be learned by heart
                np.subtract.at(w, d[0], np.clip(d[1], -1, 1) * 0.3)
                continue
            if name == "char":
                d = np.stack([np.bincount(d[0], d[1][:, k], len(w)) for k in range(w.shape[1])], axis=1)
            m, v = moments.setdefault(name, [np.zeros_like(w), np.zeros_like(w)])
            m[:] = 0.9 * m + 0.1 * d
            v[:] = 0.99 * v + 0.01 * d * d
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)

    @staticmethod
    def _index(words: Words, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        if not len(words.kind):
            return np.zeros((len(first), WINDOW), np.int64)
        place = first[:, None] + np.minimum(np.arange(WINDOW), np.maximum(sizes - 1, 0)[:, None])
        return words.kind.astype(np.int32)[np.minimum(place, len(words.kind) - 1)]

    def _logits(self, words: Words, index: np.ndarray, sizes: np.ndarray, block: int = 2048) -> np.ndarray:
        x = self.net.inputs(words)
        gates = self.net.gates(x if len(x) else np.zeros((1, 2 + WORD + CHAR), np.float32))
        parts = [self.net.logits(gates, index[k : k + block], sizes[k : k + block]) for k in range(0, len(index), block)]
        return np.concatenate(parts) if parts else np.zeros(0, np.float32)

    def score(self, texts: pa.Array) -> np.ndarray:
        """The greatest window score of each text."""
        return _sigmoid(self._texts(texts) + self.shift) if self.known else np.zeros(len(texts))

    def _texts(self, texts: pa.Array) -> np.ndarray:
        if len(texts) == 1 and texts[0].is_valid and len(texts[0].as_py()) > STRETCH:
            return np.array([max(self._best(pa.array([t], pa.large_string()))[0] for t in stretches(texts[0].as_py()))])
        return self._best(texts)

    def _best(self, texts: pa.Array) -> np.ndarray:
        """The greatest logit of each text's windows."""
        words = Words(texts)
        owner, first, sizes = words.windows()
        found = self._logits(words, self._index(words, first, sizes), sizes).astype(np.float64)
        out = np.full(len(texts), -30.0)
        np.maximum.at(out, owner, np.where(sizes > 0, found, -30.0))
        return out


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Toxicity:
    """The model of a bounded sample of labelled rows; equal texts are learned from once, as toxic if any of them is."""
    rows = labelled(docs, labels, "toxic", 4, 2, sample).where("text is not null").groupBy("text").agg(F.max("label").alias("label")).collect()
    rows = sorted((r.text, r.label) for r in rows)
    return Toxicity([t for t, _ in rows], np.array([y for _, y in rows]))


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from score 0.3) of every row of docs (doc_id, text).

    labels needs doc_id and toxic (0 or 1); rows whose crc32(doc_id as text) mod 4 is 2 are held out of
    learning. Null counts as empty; a text without words scores 0. Without labels of both kinds
    every score is 0. Repeated rows get the same score, held_out is null without doc_id, an empty table gives
    no rows and other columns are ignored. A text may be of any length: a long one is scored in stretches of STRETCH characters.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(learned(docs, labels, sample))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": model.value.score(batch.column("text"))})

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
