"""Quality classifier: Bradley-Terry scores from preference pairs over text features.

A text's strength is linear in its features. Each pair of a good and a bad text says that the good one is
preferred; the logistic loss of the feature differences gives the weights. The share of bad texts in the
sample sets the quantile of strengths that becomes score 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spliceloom.llm.common import small_batches, text_bytes
from spliceloom.llm.wordhash import lowered, prefix_hash, slice_hash, word_places

#: Labelled rows that are learned from, at most, and preference pairs drawn from them.
SAMPLE, PAIRS = 4000, 20_000

_CLASSES = [b"#$%&*", b"|", b"!", b"0123456789", bytes(range(65, 91)), b".,;:?", b"\n", bytes(range(128, 256)), bytes(range(97, 123)), b"<>{}[]=/\\_^~`@"]


def _table(members: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(members)] = 1
    return out


def features(texts: pa.Array) -> np.ndarray:
    """A row of features per text, from its whole bytes: shares of byte classes, repetition, word shapes, size."""
    data, offsets = text_bytes(texts)
    sizes = np.diff(offsets)
    n = np.maximum(sizes, 1)
    columns = []
    for members in _CLASSES:
        running = np.concatenate(([0], np.cumsum(_table(members)[data])))
        columns.append((running[offsets[1:]] - running[offsets[:-1]]) / n)
    upper, lower = columns[4], columns[8]
    columns.append(upper / np.maximum(upper + lower, 1 / n))
    low = lowered(data)
    starts, ends, bounds = word_places(data, offsets)
    hashes = slice_hash(prefix_hash(low), starts, ends)
    count = np.diff(bounds)
    doc = np.repeat(np.arange(len(count)), count)
    many = np.maximum(count, 1)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    per = lambda mark: np.bincount(doc, mark, len(count)) / many
    order = np.lexsort((hashes, doc))
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[order][1:] == hashes[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    length = ends - starts
    columns += [per(same), np.bincount(doc[order], again, len(count)) / many / np.log(many + 2), per(length) / 10, per(length <= 3), per(length == 1), per(length > 20)]
    columns += [np.log1p(count) / 10, (count == 0).astype(float)]
    return np.stack(columns, axis=1)


class BradleyTerry:
    """Strengths w * x of texts, learned from pairs; score is 0.5 at the quantile of the bad share."""

    def __init__(self, x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, seed: int = 5):
        self.mean = x.mean(axis=0) if len(x) else np.zeros(1)
        self.scale = x.std(axis=0) + 1e-3 if len(x) else np.ones(1)
        self.weights, self.cut, self.slope = np.zeros(x.shape[1] if x.ndim == 2 else 1), 0.0, 1.0
        better, worse = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
        if not len(better) or not len(worse):
            return
        z = self._standard(x)
        rng = np.random.default_rng(seed)
        d = z[rng.choice(better, pairs)] - z[rng.choice(worse, pairs)]
        first = second = np.zeros_like(self.weights)
        for step in range(1, 301):  # Adam on the mean logistic loss of the differences, with a small ridge
            slope = -d.T @ (1 / (1 + np.exp(np.clip(d @ self.weights, -30, 30)))) / pairs + 1e-3 * self.weights
            first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
            self.weights = self.weights - 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        strength = np.sort(z @ self.weights)
        self.cut = float(strength[len(worse) - 1] + strength[len(worse)]) / 2
        self.slope = 4 / max(float(np.median((z @ self.weights)[better])) - self.cut, 1e-3)

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.weights.any():
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(self.slope * (self._standard(x) @ self.weights - self.cut), -30, 30)))


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, out: int, limit: int) -> DataFrame:
    """At most limit labelled texts, by a hash of doc_id, of those whose crc32(doc_id) mod folds is not out.

    Of conflicting labels of one doc_id the greatest counts, and of several texts the least.
    """
    kept = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null")
    kept = kept.where(F.crc32(F.col("doc_id").cast("string")) % folds != out).groupBy("doc_id").agg(F.max("label").alias("label"))
    sample = kept.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    # the sample has limit rows at most, whatever the size of the corpus
    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(sample), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> BradleyTerry:
    """The model of a bounded sample of labelled rows; only their features reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "label": batch.column("label"), "x": pa.array(list(features(batch.column("text"))), pa.list_(pa.float64()))})

    rows = sorted(labelled(docs, labels, "quality", 3, 1, sample).mapInArrow(run, "doc_id long, label int, x array<double>").collect())
    return BradleyTerry(np.array([r.x for r in rows]), np.array([r.label for r in rows]))


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs (doc_id, text).

    labels needs doc_id and quality (0 or 1); rows whose crc32(doc_id as text) mod 3 is 1 are held out of
    learning. A null text counts as empty; empty texts are scored like any other. Without labels of both
    kinds every score is 0.5. Repeated rows get the same score, held_out is null without doc_id, an empty table
    gives no rows and other columns are ignored.
    """
    model = learned(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": model.score(features(batch.column("text")))})

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def filtered(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, with all their columns, that the classifier doesn't reject: those of score 0.5 or more.

    A null text is scored as an empty one. Repeated rows are kept or go together, an empty table gives no rows, and without
    labels of both kinds every row stays.
    """
    model = learned(docs, labels, sample)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            yield batch.filter(pa.array(model.score(features(batch.column("text"))) >= 0.5))

    return docs.mapInArrow(run, schema)
