"""MinHash near-duplicate removal: banded signatures, verified links, connected components.

Texts with the same sequence of words are one class from the start, so copies never meet in pairs. Classes
that share a band are first compared with the least class of that band; the links found join classes
into components. Texts that share a band across components are then joined on the rare ends of their shingle
sets (prefix filtering), which misses no link and makes no pairs out of passages that many texts hold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spliceloom.llm.common import hot_keys, join_dealt, left_join_hot, small_batches, text_bytes, unused
from spliceloom.llm.components import components
from spliceloom.llm.wordhash import MinHash, mix, shingles, words
from spliceloom.staging import written

#: 35 bands of 5 minima miss a pair of similarity 0.8 once in a million.
BANDS, ROWS = 35, 5
#: Signatures of 175 minima, a byte each, estimate similarity within 0.03; pairs this far below the threshold go.
MARGIN = 0.2
#: Rows of a shingle that one task meets with all others of it; a commoner shingle is dealt out by salts.
SALTED = 1000
#: Shingle sets that are kept at hand while pairs are verified.
HELD = 32

_SIGNED = "doc_id long, n_shingles long, digest binary, bands array<long>, signature binary"


def signed(docs: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS, seed: int = 1) -> DataFrame:
    """Per row of docs (doc_id, text): size of its shingle set, digest of its words, band keys and a signature of bytes.

    The digest is BLAKE2 of the lower-cased words with one space between, so equal digests mean equal sets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHash(bands * rows, seed)
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in small_batches(batches):
            values, bounds = shingles(*words(*text_bytes(batch.column("text"))), width)
            minima = hasher.signatures(values, bounds)
            keys = np.repeat(salt[None, :], len(minima), 0)
            for k in range(rows):
                keys = mix(keys + minima.reshape(-1, bands, rows)[:, :, k].astype(np.uint64))
            sizes = np.diff(bounds)
            plain = (b" ".join(_words(t)) for t in batch.column("text").to_pylist())
            digests = [hashlib.blake2b(t, digest_size=16).digest() if t else None for t in plain]
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_shingles": pa.array(sizes, pa.int64()),
                    "digest": pa.array(digests, pa.binary()),
                    "bands": pa.array([k if n else None for k, n in zip(keys.view(np.int64), sizes)], pa.list_(pa.int64())),
                    "signature": pa.array([m.tobytes() for m in (minima & 255).astype(np.uint8)], pa.binary()),
                }
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _SIGNED)


def _alike(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose signatures agree in a share of at least least."""
    ends = [classes.select(F.col("doc_id").alias(x), F.col("signature").alias(f"s{x}"), F.col("n_shingles").alias(f"n{x}")) for x in "ab"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (text_bytes(batch.column(c))[0].reshape(batch.num_rows, -1) for c in ("sa", "sb"))
                keep = pa.array((left == right).mean(axis=1) >= least)
                yield batch.select(["a", "b"]).filter(keep)

    pairs = written(pairs, "pairs")
    rows = join_dealt(pairs, ends[0], "a", pairs.groupBy("a").agg(F.count("*").alias("times"))).join(ends[1], "b")
    return rows.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _word_set(text: str | None, width: int) -> set:
    found = _words(text)
    return set(zip(*(found[k:] for k in range(width)))) if len(found) >= width else {tuple(found)} if found else set()


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets, made anew from the texts, reach percent of their union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, set] = {}  # sets of the last few a, as many pairs have a common one
        for batch in batches:
            keep = []
            for a, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "ta", "tb"))):
                if (a, x) not in held:
                    if len(held) == HELD:
                        held.clear()
                    held[(a, x)] = _word_set(x, width)
                left, right = held[(a, x)], _word_set(y, width)
                both = len(left & right)
                keep.append(bool(left) and 100 * both >= percent * (len(left) + len(right) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    texts = [docs.select(F.col("doc_id").alias(x), F.col("text").alias(f"t{x}")) for x in "ba"]
    pairs = written(pairs, "pairs")
    rows = join_dealt(pairs, texts[1], "a", pairs.groupBy("a").agg(F.count("*").alias("times"))).join(texts[0], "b")
    return rows.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct()


def prefix_pairs(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a < b) of different root that may reach percent, from texts (doc_id, text, root); none is missed.

    With all shingles in one order, the rarest first, two sets that share enough also share one of the first
    n - ceil(n * percent / 100) + 1 of each. Passages that many texts hold stand last and bring no pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            values, bounds = shingles(*words(*text_bytes(batch.column("text"))), width)
            held = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.view(np.int64)))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "root": batch.column("root"), "mark": batch.column("mark"), "held": held})

    texts = texts.select("doc_id", "root", "text", F.xxhash64("text").alias("mark")).dropDuplicates(["doc_id", "mark"])
    sets = texts.mapInArrow(run, "doc_id long, root long, mark long, held array<long>")
    held = written(sets.select("doc_id", "root", "mark", F.size("held").alias("n"), F.explode("held").alias("shingle")), "held")
    common = written(held.groupBy("shingle").agg(F.count("*").alias("times")).where("times > 1"), "common")
    order = Window.partitionBy("doc_id", "mark").orderBy(F.coalesce("times", F.lit(1)), "shingle")
    ranked = left_join_hot(held, common, "shingle", hot_keys(common, "shingle")).withColumn("rank", F.row_number().over(order))
    ahead = ranked.where(f"rank <= n - ceil(n * {int(percent)} / 100) + 1 and times is not null").select("doc_id", "root", "n", "rank", "shingle")
    ahead = written(ahead, "ahead")
    mixed = ahead.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("times")).where("low != high")
    mixed = written(mixed.select("shingle", "times"), "mixed")
    salts = F.ceil(F.col("times") / SALTED).cast("int")
    ahead = left_join_hot(ahead.join(mixed, "shingle", "left_semi"), mixed, "shingle", hot_keys(mixed, "shingle"))
    sides = [F.pmod(F.xxhash64("doc_id"), salts).cast("int").alias("salt"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")]
    left, right = (ahead.select("shingle", side, *[F.col(c).alias(f"{c}_{x}") for c in ("doc_id", "root", "n", "rank")]) for x, side in zip("ab", sides))
    near = f"root_a != root_b and doc_id_a < doc_id_b and 100 * least(n_a, n_b) >= {int(percent)} * greatest(n_a, n_b)"
    # where they first meet, what follows must still be enough
    near += f" and (100 + {int(percent)}) * (1 + least(n_a - rank_a, n_b - rank_b)) >= {int(percent)} * (n_a + n_b)"
    return left.join(right, ["shingle", "salt"]).where(near).select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, seed: int = 1) -> DataFrame:
    """Classes of near-duplicate texts: doc_id, n_shingles, component_id, kept, one row per row of docs.

    docs needs doc_id and text; other columns are ignored. Two texts are linked when their shingle sets
    share at least percent of their union; component_id is the least doc_id reachable over links and kept
    marks its row. Null and empty texts, and texts of white space only, have no shingles: they link with
    nothing and are kept. Rows with the same doc_id are one node. A row without doc_id links with nothing,
    has component_id null and is kept.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    table = written(signed(docs, width, bands, rows, seed), "signed")
    named = table.where("digest is not null and doc_id is not null")
    lead = written(named.groupBy("digest").agg(F.min("doc_id").alias("lead"), F.count("*").alias("times")), "lead")
    classes = table.join(lead.select("digest", F.col("lead").alias("doc_id")), ["digest", "doc_id"], "left_semi")
    banded = classes.select("doc_id", "n_shingles", F.explode("bands").alias("key"))
    centre = banded.groupBy("key").agg(F.min("doc_id").alias("centre"), F.max("doc_id").alias("last"), F.count("*").alias("times")).where("centre != last")
    centre = written(centre.select("key", "centre", "times"), "centre")
    shared = left_join_hot(banded, centre.select("key", "centre"), "key", hot_keys(centre, "key")).where("centre is not null")
    shared = written(shared.distinct(), "shared")
    least = percent / 100 - MARGIN
    star = shared.where("doc_id != centre").select(F.col("centre").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = written(verified(_alike(star, classes, least), docs, width, percent), "links")
    roots = components(links, "a", "b")

    # texts that share a band across components: all links between them, by the rare ends of their sets
    placed = shared.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    split = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("times")).where("low != high")
    split = written(split.select("key", "low", "times"), "split")
    open_ = left_join_hot(placed, split.select("key", "low"), "key", hot_keys(split, "key")).where("low is not null").select("doc_id", "root").distinct()
    texts = written(docs.join(open_, "doc_id"), "open")
    rest = prefix_pairs(texts, width, percent).join(star, ["a", "b"], "left_anti")
    more = written(verified(_alike(rest, classes, least), texts, width, percent), "links")
    if not more.isEmpty():
        roots = components(links.unionByName(more), "a", "b")

    named = lead.join(roots.withColumnRenamed("node", "lead"), "lead", "left").select("digest", F.coalesce("root", "lead").alias("root"))
    out = left_join_hot(table, written(named, "roots"), "digest", hot_keys(lead, "digest"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, of one document of each group: the one of least doc_id.

    Of rows with the same doc_id one stays, the first by text (null first) and then by the whole row as JSON; rows
    without doc_id all stay, as do null and empty texts. An empty table gives no rows.
    """
    times, place = unused(docs, "times"), unused(docs, "place")
    found = near_duplicates(docs, width, percent).where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias(times), F.min("kept").alias("__kept"))
    found = written(found.where("__kept").select("doc_id", times), "kept")
    whole = F.when(F.col(times) > 1, F.to_json(F.struct(*docs.columns)))
    order = Window.partitionBy("doc_id").orderBy(F.col("text").cast("string"), whole)
    named = docs.join(found, "doc_id").withColumn(place, F.row_number().over(order)).where(F.col(place) == 1)
    return named.select(docs.columns).unionByName(docs.where("doc_id is null"))
