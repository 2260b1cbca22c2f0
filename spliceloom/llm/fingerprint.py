"""Document fingerprints: MinHash signatures of whole texts, compared with each other and banded.

A fingerprint is the signature of a text's set of five-word shingles, 128 minima of 16 bits each in
hexadecimal. Equal texts have equal fingerprints; the share of equal minima estimates the likeness of the sets.
Bands of the same minima are joined in Spark, and the pairs found are verified by the Jaccard likeness of full sets
(alike_documents, a query of its own).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spliceloom.llm.common import small_batches, text_bytes
from spliceloom.llm.near_dedup import near_duplicates
from spliceloom.llm.wordhash import MinHash, shingles, words

PERMUTATIONS, WIDTH, SEED = 128, 5, 7
#: Bands of the fingerprint's minima: 32 of 4 miss a pair of similarity 0.8 with a probability of 5e-8.
BANDS, ROWS = 32, 4
#: Bytes of text that count as a row more where blocks are made of like size.
WEIGHT = 4096
_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def minima(texts: pa.Array, hasher: MinHash, width: int = WIDTH) -> np.ndarray:
    """Signatures of 16-bit minima, a row per text; a text without words has all bits set."""
    return (hasher.signatures(*shingles(*words(*text_bytes(texts)), width)) & 65535).astype(np.uint16)


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Share of equal minima, less what 16-bit minima share by chance, from 0 to 1."""
    share = (x == y).mean(axis=1)
    return np.clip((share - 2.0**-16) / (1 - 2.0**-16), 0.0, 1.0)


def _hex(rows: np.ndarray) -> list[str]:
    return [r.astype(">u2").tobytes().hex() for r in rows]


def fingerprints(docs: DataFrame, permutations: int = PERMUTATIONS, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """doc_id and fingerprint of every row of docs (doc_id, text); null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHash(permutations, seed)
        for batch in small_batches(batches):
            found = pa.array(_hex(minima(batch.column("text"), hasher, width)))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "fingerprint": found})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fingerprint string")


def alike_documents(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Documents alike by bands of their fingerprints' minima and verified Jaccard: doc_id and class_id, one row per doc_id.

    class_id is the least doc_id that verified links reach; a document without words is a class of its own.
    """
    found = near_duplicates(docs, WIDTH, percent, BANDS, ROWS, SEED).where("doc_id is not null")
    return found.groupBy("doc_id").agg(F.min("component_id").alias("class_id"))


def _blocks(docs: DataFrame, parts: int) -> DataFrame:
    """docs with a block number rising with doc_id, where the first rows of each block also close the block before.

    Blocks have about as many bytes each, but for texts that are longer than a block. Only the limits and the least doc_id of each
    block, as many as there are blocks, reach the driver.
    """
    ids = docs.select("doc_id", (1 + F.octet_length("text") / WEIGHT).cast("int").alias("n")).where("doc_id is not null")
    weighed = ids.select(F.explode(F.array_repeat("doc_id", F.col("n"))).alias("doc_id"))
    cuts = sorted(set(weighed.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    block = _block_of(cuts)
    heads = sorted((r.block, r.head) for r in ids.withColumn("block", block).groupBy("block").agg(F.min("doc_id").alias("head")).collect())
    # rows without doc_id have no place in the order and are dealt out evenly
    rows = docs.withColumn("block", F.coalesce(block, -1 - F.pmod(F.xxhash64("text"), F.lit(parts)).cast("int"))).withColumn("guard", F.lit(0))
    if not heads:
        return rows
    before = [-1] * (len(cuts) + 1)
    for k, (own, _) in enumerate(heads):
        before[own] = heads[k - 1][0]  # the first of all closes the last block
    guards = docs.where(F.col("doc_id").isin([head for _, head in heads]))
    guards = guards.withColumn("block", F.get(_numbers(before), block).cast("int")).withColumn("guard", F.lit(1))
    return rows.unionByName(guards)


def _spread(spark, parts: int) -> F.Column:
    """An array of one number for each of parts partitions that Spark's hash sends there, so that no two blocks share one."""
    numbers, n = {}, 0
    while len(numbers) < parts:
        rows = spark.range(n, n + 20 * parts).groupBy(F.pmod(F.hash("id"), F.lit(parts)).alias("part")).agg(F.min("id").alias("id"))
        numbers = {r.part: r.id for r in rows.collect()} | numbers
        n += 20 * parts
    return F.array(*[F.lit(numbers[p]) for p in range(parts)])


def _numbers(values: list) -> F.Column:
    """An array of numbers as one literal."""
    return F.split(F.lit(" ".join(str(int(v)) for v in values)), " ").cast("array<bigint>")


def _block_of(cuts: list[float]) -> F.Column:
    """How many of the rising cuts are at or below doc_id: looked up among every step-th, then among the step between."""
    if not cuts:
        return F.when(F.col("doc_id").isNotNull(), F.lit(0))
    step = int(len(cuts) ** 0.5) + 1
    below = lambda held: F.size(F.filter(held, lambda c: c <= F.col("doc_id")))
    whole = below(_numbers(cuts[step - 1 :: step])) if cuts[step - 1 :: step] else F.lit(0)
    part = below(F.slice(_numbers(cuts), whole * step + 1, F.lit(step)))
    return F.when(F.col("doc_id").isNotNull(), whole * step + part)


def edited_fingerprints(docs: DataFrame, permutations: int = PERMUTATIONS, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like they are.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of
    the next document in order of doc_id; after the last comes the first. Repeated rows and equal ids
    follow each other in order of text. A null text is empty; a row without doc_id is followed by an empty
    text. Texts without words have one common fingerprint, so two of them are alike (1.0); an empty table
    gives no rows and other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHash(permutations, seed)

        def result(rows: list[tuple]) -> pa.RecordBatch:
            edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for _, t, n in rows]
            own, new, following = (minima(pa.array(x, pa.large_string()), hasher, width) for x in ([r[1] for r in rows], edited, [r[2] for r in rows]))
            return pa.record_batch(
                {
                    "doc_id": pa.array([r[0] for r in rows], pa.int64()),
                    "n_chars": pa.array([len(r[1]) for r in rows], pa.int64()),
                    "edited_sha256": [hashlib.sha256(e.encode()).hexdigest() for e in edited],
                    "fingerprint": _hex(own),
                    "edited_fingerprint": _hex(new),
                    "near_edited": likeness(own, new),
                    "near_next": likeness(own, following),
                }
            )

        held, last, size = [], None, 0
        for batch in small_batches(batches):
            for row in zip(*(batch.column(c).to_pylist() for c in ("block", "guard", "doc_id", "text"))):
                if last is not None:
                    if last[0] != row[0] or last[2] is None:
                        held.append((last[2], last[3], ""))
                    else:
                        held.append((last[2], last[3], row[3]))
                    size += len(last[3])
                    last = None
                if not row[1]:
                    last = row
                if size > 500_000:
                    yield result(held)
                    held, size = [], 0
        if last is not None:
            held.append((last[2], last[3], ""))
        if held:
            yield result(held)

    ordered = _blocks(docs, parts).repartition(parts, F.element_at(_spread(spark, parts), F.pmod("block", F.lit(parts)) + 1))
    ordered = ordered.sortWithinPartitions("block", "guard", "doc_id", "text")
    return ordered.mapInArrow(run, _OUT)
