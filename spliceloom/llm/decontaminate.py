"""Benchmark decontamination: CGK embeddings of item-sized windows, bit-sampling LSH, exact verification.

The CGK random walk reads a sequence of words and, at each step, copies the current word and moves on or stays, by a
random bit of the word and step. It turns a small edit distance into a small Hamming distance. Each repetition
walks anew and hashes a few sampled positions of the walk. Windows of documents and items meet in Spark, by a join on
these keys: a window that agrees with an item in any repetition is aligned with it exactly, and is a leak if the
edit distance is within the limit. Windows start where word grams of items suggest it: a table tells at which places in an
item, of whatever name, a gram may stand.

An item of more than PIECE words is cut into pieces of like length, and each is searched for as an item of its own. Edits of
an item that are within the limit leave at least one piece within its share of them, wherever they stand, so that a leak
shows by some piece; the whole item is then aligned with the words around each piece that is found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from spliceloom.llm.common import hot_keys, left_join_hot, small_batches, text_bytes, unused
from spliceloom.llm.wordhash import mix, words
from spliceloom.staging import written

#: Share of an item's words that edits may change; walks and sampled positions of each. At the limit a window meets
#: its item in one of the walks with a probability of 0.95 or more (tests/llm/test_decontaminate.py measures it).
EDITS, WALKS, SAMPLED = 0.2, 60, 3
#: Items of like length have windows of one size: each length up to EXACT, then steps of RATIO.
EXACT, RATIO = 12, 1.2
#: Words of an item, or a piece of one, that is searched for as it stands: a bit of a slot of the gram table for each.
PIECE = 64
#: Least and most bits of a slot number of the gram table, which has 8 bytes a slot: some eight slots a gram, up to 128 MB.
SLOT_BITS = 21, 24
#: Bits of a slot number of the map of leaking texts, a bit a slot: the first three bytes of their hash.
MAP_BITS = 24
#: Rows of a window that one task meets with the items alike; a commoner window is dealt out by salts.
SALTED = 1000
_GAP = np.ones(256, bool)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_BIG = np.int64(1 << 32)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts (runs of letters, digits and other scripts, lower-cased), and each text's first."""
    return words(*text_bytes(texts), _GAP)


class Size:
    """Pieces of least to most words: windows of least words, edits allowed, words of a gram and grams that must vote."""

    def __init__(self, least: int, edits: float = EDITS):
        self.least = least
        self.most = least if least < EXACT else min(PIECE, max(least, int(np.ceil(least * RATIO)) - 1))
        self.limit = int(edits * self.most)
        # each edit spoils gram grams at most, so so many of a piece's grams stand in any leak
        self.gram = next((q for q in (3, 2) if least - q + 1 - self.limit * q >= 1), 1)
        self.votes = max(1, least - self.gram + 1 - self.limit * self.gram)


@lru_cache(maxsize=4096)
def size_of(n: int, edits: float = EDITS) -> Size:
    """The size that pieces of n words belong to, PIECE at most."""
    size = Size(min(n, EXACT), edits)
    while size.most < n:
        size = Size(size.most + 1, edits)
    return size


@lru_cache(maxsize=256)
def _walks(n: int, walks: int, sampled: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For sequences of n words: the random value of each step and walk, and which walks sample which steps.

    A walk of n words ends after 2 * n steps or so, and what follows is alike for all; the steps sampled are well before.
    """
    steps = n + max(1, n // 2)
    rng = np.random.default_rng([seed, n])
    salts = rng.integers(0, 2**63, (steps, walks), dtype=np.uint64)
    wanted = np.zeros((steps, walks), bool)
    for r in range(walks):
        wanted[rng.choice(steps, min(sampled, steps), replace=False), r] = True
    return salts, wanted


def walk_keys(windows: np.ndarray, walks: int = WALKS, sampled: int = SAMPLED, seed: int = 9) -> np.ndarray:
    """A key per window (row of word hashes) and walk: the hash of sampled positions of its CGK embedding."""
    count, n = windows.shape
    salts, wanted = _walks(n, walks, sampled, seed)
    keys = np.repeat(mix(np.arange(walks, dtype=np.uint64) * np.uint64(1 << 20) + np.uint64(n))[None, :], count, 0)
    padded = np.concatenate((windows, np.zeros((count, 1), np.uint64)), axis=1)
    row = np.arange(count)[:, None]
    at = np.zeros((count, walks), np.int64)
    for j in range(int(np.flatnonzero(wanted.any(axis=1))[-1]) + 1):
        word = padded[row, at]
        own = wanted[j]
        if own.any():
            keys[:, own] = mix(keys[:, own] + word[:, own] + np.uint64(j + 1))
        step = (word ^ salts[j]) * np.uint64(0x9E3779B97F4A7C15)
        at = np.minimum(at + ((step ^ (step >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(63)).astype(np.int64), n)
    return keys


def nearest(item: np.ndarray, regions: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least edit distance of item to any stretch of each region, with the stretch: the first that starts first."""
    longest = max(map(len, regions))
    table = np.zeros((len(regions), longest), np.uint64)
    inside = np.zeros((len(regions), longest + 1), bool)
    for k, x in enumerate(regions):
        table[k, : len(x)] = x
        inside[k, : len(x) + 1] = True
    step = np.arange(longest + 1) * _BIG
    row = np.broadcast_to(np.arange(longest + 1, dtype=np.int64), inside.shape)  # distance * _BIG + start
    for i, word in enumerate(item):
        new = np.full(row.shape, (i + 1) * _BIG)
        new[:, 1:] = np.minimum(row[:, :-1] + (table != word) * _BIG, row[:, 1:] + _BIG)
        row = np.minimum.accumulate(new - step, axis=1) + step
    row = np.where(inside, row, np.iinfo(np.int64).max)
    stop = row.argmin(axis=1)
    best = row[np.arange(len(row)), stop]
    return best // _BIG, best % _BIG, stop


def _grams(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of each width consecutive words."""
    out = hashes[: max(len(hashes) - width + 1, 0)]
    for k in range(1, width):
        out = mix(out + hashes[k : len(hashes) - width + 1 + k] + np.uint64(k))
    return mix(out + np.uint64(width))


def _slots(grams: np.ndarray, bits: int) -> np.ndarray:
    return (grams >> np.uint64(64 - bits)).astype(np.int64)


def pieces_of(benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """Items with words, in pieces of PIECE words at most: piece, item (a hash of id and text), item_id, size (the least of
    the piece's Size), words, at (the piece's place in the item, null for an item of one piece) and, for the first of several
    pieces, whole: the item's words."""
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null").distinct()
    kinds = {"piece": pa.int64(), "item": pa.int64(), "item_id": pa.int64(), "size": pa.int32(), "words": pa.binary(), "at": pa.int32(), "whole": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            hashes, bounds = word_hashes(batch.column("text"))
            out: dict = {k: [] for k in kinds}
            for k, (item, item_id) in enumerate(zip(batch.column("item").to_pylist(), batch.column("item_id").to_pylist())):
                own = hashes[bounds[k] : bounds[k + 1]]
                parts = -(-len(own) // PIECE)
                cuts = [len(own) * j // parts for j in range(parts + 1)] if parts else []
                names = mix(np.full(parts, item, np.int64).view(np.uint64) + np.arange(parts, dtype=np.uint64)).view(np.int64).tolist()
                for j, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    found = (names[j], item, item_id, size_of(b - a, edits).least, own[a:b].tobytes(), a if parts > 1 else None, own.tobytes() if parts > 1 and not a else None)
                    for name, value in zip(out, found):
                        out[name].append(value)
            yield pa.record_batch({k: pa.array(v, kinds[k]) for k, v in out.items()})

    schema = "piece long, item long, item_id long, size int, words binary, at int, whole binary"
    return rows.withColumn("item", F.xxhash64("item_id", "text")).mapInArrow(run, schema)


def _packed(rows: DataFrame, bits: int, kind: str) -> np.ndarray:
    """A table of 2**bits numbers from rows (slot, value), unset ones 0: its size on the driver doesn't grow with rows."""
    low = max(bits - 10, 0)

    def block(part: pd.DataFrame) -> pd.DataFrame:
        values = np.zeros(1 << low, kind)
        values[part["slot"].to_numpy() & ((1 << low) - 1)] = part["value"].to_numpy().astype(np.int64).view("<u8").astype(kind)
        return pd.DataFrame({"block": [int(part["slot"].iloc[0]) >> low], "values": [values.tobytes()]})

    found = rows.groupBy("slot").agg(F.bit_or("value").alias("value"))
    found = found.groupBy(F.shiftright("slot", low).alias("b")).applyInPandas(block, "block int, values binary")
    out = np.zeros((1 << (bits - low), 1 << low), kind)
    for r in found.collect():
        out[r.block] = np.frombuffer(r["values"], kind)
    return out.reshape(-1)


def _places(pieces: DataFrame, edits: float) -> np.ndarray:
    """For each slot of grams, the places in any piece at which a gram of the slot stands, as bits."""
    grams = pieces.agg(F.sum(F.octet_length("words") / 8)).first()[0] or 0
    bits = min(max(int(np.ceil(np.log2(8 * grams + 1))), SLOT_BITS[0]), SLOT_BITS[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, packed in zip(*(batch.column(c).to_pylist() for c in ("size", "words"))):
                found = _slots(_grams(np.frombuffer(packed, np.uint64), Size(size, edits).gram), bits)
                yield pa.record_batch({"slot": found.astype(np.int32), "value": (np.uint64(1) << np.arange(len(found), dtype=np.uint64)).view(np.int64)})

    return _packed(pieces.select("size", "words").mapInArrow(run, "slot int, value long"), bits, "<u8")


def starts(hashes: np.ndarray, bounds: np.ndarray, places: np.ndarray, sizes: list[Size]) -> list[tuple[Size, np.ndarray]]:
    """For each size, the words at which enough grams of pieces suggest that one starts."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    low, high = bounds[text], bounds[text + 1]
    votes = {}
    for q in {s.gram for s in sizes}:
        if len(hashes) < q:
            continue
        bits = places[_slots(_grams(hashes, q), len(places).bit_length() - 1)]
        hit = np.flatnonzero((bits != 0) & (text[q - 1 :] == text[: len(bits)]))
        bits = bits[hit]
        votes[q] = np.zeros(len(hashes), np.int64)
        for k in range(PIECE if len(hit) else 0):
            at = hit[(bits >> np.uint64(k) & np.uint64(1)) == 1]
            np.add.at(votes[q], np.maximum(at - k, low[at]), 1)
    out = []
    for s in sizes:
        if s.gram not in votes:
            continue
        some = np.flatnonzero(votes[s.gram])
        some = some[some + s.least - s.limit <= high[some]]
        running = np.concatenate(([0], np.cumsum(votes[s.gram])))
        near = running[np.minimum(some + s.limit + 1, high[some])] - running[np.maximum(some - s.limit, low[some])]
        out.append((s, some[near >= s.votes]))
    return out


def _windows(docs: DataFrame, places, sizes: list[Size], long: set[int]) -> DataFrame:
    """Windows of docs (row, doc_id, text): where each starts, the words around it, and its sizes and hashes.

    The first window of a text that has one of a size in long carries the whole text's words.
    """
    schema = "row long, doc_id long, mark binary, start int, low int, region binary, own array<struct<size:int,own:long>>, held binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            hashes, bounds = word_hashes(batch.column("text"))
            found: dict[int, list] = {}
            widest: dict[int, Size] = {}
            for size, some in starts(hashes, bounds, places.value, sizes):
                if not len(some):
                    continue
                last = bounds[np.searchsorted(bounds, some, side="right")]
                value = np.full(len(some), size.least, np.uint64)
                for k in range(size.least):
                    word = np.where(some + k < last, hashes[np.minimum(some + k, len(hashes) - 1)], 0)
                    value = mix(value + word + np.uint64(k))
                for s, v in zip(some.tolist(), value.view(np.int64).tolist()):
                    found.setdefault(s, []).append({"size": size.least, "own": v})
                    widest[s] = size
            rows = np.searchsorted(bounds, list(found), side="right") - 1 if found else np.zeros(0, np.int64)
            texts = batch.column("text")
            marks = {k: mark_of(texts[k].as_py()) for k in np.unique(rows).tolist()}
            out: dict = {k: [] for k in ("mark", "start", "low", "region", "own", "held")}
            whole = set()
            for s, k in zip(found, rows.tolist()):
                size, first, last = widest[s], int(bounds[k]), int(bounds[k + 1])
                low = max(first, s - size.limit)
                region = hashes[low : min(last, s + size.most + 2 * size.limit)]
                held = None
                if k not in whole and any(x["size"] in long for x in found[s]):
                    whole.add(k)
                    held = hashes[first:last].tobytes()
                for name, v in zip(out, (marks[k], s - first, low - first, region.tobytes(), found[s], held)):
                    out[name].append(v)
            kinds = {"held": pa.binary(), "mark": pa.binary(), "start": pa.int32(), "low": pa.int32(), "region": pa.binary(), "own": pa.list_(pa.struct({"size": pa.int32(), "own": pa.int64()}))}
            place = pa.array(rows, pa.int64())
            yield pa.record_batch({"row": batch.column("row").take(place), "doc_id": batch.column("doc_id").take(place), **{k: pa.array(v, kinds[k]) for k, v in out.items()}})

    return docs.mapInArrow(run, schema)


def mark_of(text: str | None) -> bytes:
    return hashlib.blake2b((text or "").encode(), digest_size=16).digest()


def _keyed(rows: DataFrame, name: str) -> DataFrame:
    """name and key: the keys of the walks of rows (name, size, words), of the first size words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, size = batch.column(name).to_numpy(), batch.column("size").to_numpy()
            packed = batch.column("words").to_pylist()
            for n in np.unique(size).tolist():
                same = np.flatnonzero(size == n)
                for first in range(0, len(same), 1024):
                    some = same[first : first + 1024]
                    table = np.frombuffer(b"".join(packed[k][: 8 * n].ljust(8 * n, b"\0") for k in some.tolist()), np.uint64).reshape(-1, n)
                    yield pa.record_batch({name: np.repeat(ids[some], WALKS), "key": walk_keys(table).reshape(-1).view(np.int64)})

    return rows.select(name, "size", "words").mapInArrow(run, f"{name} long, key long")


def _aligned(pairs: DataFrame, edits: float) -> DataFrame:
    """Pairs of a region and a piece that meet within the limit: row, doc_id, mark, item_id, piece, at, distance, first_word, end_word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict[bytes, list[int]] = {}
            for k, w in enumerate(batch.column("words").to_pylist()):
                groups.setdefault(w, []).append(k)
            low, regions, part = batch.column("low").to_numpy(), batch.column("region"), batch.column("at").is_valid().to_pylist()
            place, found = [], []
            for packed, rows in groups.items():
                piece = np.frombuffer(packed, np.uint64)
                for first in range(0, len(rows), 256):
                    some = rows[first : first + 256]
                    distance, begin, stop = nearest(piece, [np.frombuffer(regions[k].as_py(), np.uint64) for k in some])
                    for k, d, b, e in zip(some, distance.tolist(), begin.tolist(), stop.tolist()):
                        # a piece is up to a word shorter than its share of the item
                        if d <= int(edits * (len(piece) + part[k])):
                            place.append(k)
                            found.append((d, low[k] + b, low[k] + e))
            kept = batch.select(["row", "doc_id", "mark", "item_id", "piece", "at"]).take(pa.array(place, pa.int64()))
            numbers = {name: pa.array([f[k] for f in found], pa.int32()) for k, name in enumerate(("distance", "first_word", "end_word"))}
            yield pa.record_batch({**{c: kept.column(c) for c in kept.schema.names}, **numbers})

    schema = "row long, doc_id long, mark binary, item_id long, piece long, at int, distance int, first_word int, end_word int"
    return pairs.select("row", "doc_id", "mark", "low", "region", "item_id", "piece", "at", "words").mapInArrow(run, schema)


def _around(guesses: DataFrame, edits: float) -> DataFrame:
    """Items of several pieces aligned around the places where they may start: row, doc_id, mark, item_id, distance, first_word, end_word.

    guesses: row, doc_id, mark, item_id, whole (the item's words), held (the text's words) and starts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, found = [], []
            for k, (whole, held, starts) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("whole", "held", "starts")))):
                item, text = np.frombuffer(whole, np.uint64), np.frombuffer(held, np.uint64)
                limit = int(edits * len(item))
                best, reach = None, 0
                for s in sorted(starts):
                    # a piece's place in the text and in its item differ by the edits before it
                    low, high = max(s - 2 * limit, 0), min(s + len(item) + 2 * limit, len(text))
                    if high <= reach:
                        continue
                    reach = high
                    distance, begin, stop = (int(x[0]) for x in nearest(item, [text[low:high]]))
                    if distance <= limit and (best is None or (distance, low + begin) < best[:2]):
                        best = distance, low + begin, low + stop
                if best is not None:
                    place.append(k)
                    found.append(best)
            kept = batch.select(["row", "doc_id", "mark", "item_id"]).take(pa.array(place, pa.int64()))
            numbers = {name: pa.array([f[k] for f in found], pa.int32()) for k, name in enumerate(("distance", "first_word", "end_word"))}
            yield pa.record_batch({**{c: kept.column(c) for c in kept.schema.names}, **numbers})

    schema = "row long, doc_id long, mark binary, item_id long, distance int, first_word int, end_word int"
    return guesses.select("row", "doc_id", "mark", "item_id", "whole", "held", "starts").mapInArrow(run, schema)


def _found(docs: DataFrame, benchmark: DataFrame, edits: float) -> DataFrame:
    """row, doc_id, mark (hash of the text), item_id, distance, first_word, end_word: the nearest stretch of each row and item."""
    spark = docs.sparkSession
    pieces = written(pieces_of(benchmark, edits), "pieces")
    # no more sizes than PIECE
    found = pieces.groupBy("size").agg(F.max(F.col("at").isNotNull()).alias("long")).orderBy("size").collect()
    sizes, long = [Size(r.size, edits) for r in found], {r.size for r in found if r.long}
    places = spark.sparkContext.broadcast(_places(pieces, edits))  # of bounded size
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    windows = written(_windows(rows, places, sizes, long), "windows")

    each = windows.withColumn("x", F.explode("own")).withColumn("size", F.col("x.size")).withColumn("own", F.col("x.own")).drop("x")
    content = F.expr("substring(region, 8 * (start - low) + 1, 8 * size)")
    distinct = each.select("own", "size", content.alias("words")).groupBy("own", "size").agg(F.first("words").alias("words"), F.count("*").alias("times"))
    distinct = written(distinct, "distinct")
    alike = _keyed(distinct, "own").join(_keyed(pieces, "piece"), "key").select("own", "piece").distinct()
    alike = written(alike.join(distinct.select("own", "times"), "own"), "alike")

    met = alike.select("own", "times").distinct()
    some = left_join_hot(each.select("row", "doc_id", "mark", "start", "low", "region", "own"), met, "own", hot_keys(met, "own")).where("times is not null")
    salts = F.ceil(F.col("times") / SALTED).cast("int")
    some = some.withColumn("salt", F.pmod(F.xxhash64("row", "start"), salts).cast("int")).drop("times")
    pairs = some.join(alike.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))), ["own", "salt"])
    pairs = pairs.dropDuplicates(["row", "start", "piece"]).join(pieces.select("piece", "item_id", "at", "words"), "piece")
    met = _aligned(pairs, edits)
    out = ["row", "doc_id", "mark", "item_id", "distance", "first_word", "end_word"]
    if long:
        met = written(met, "met")
        met = met.where("at is null").select(out).unionByName(_around(_guesses(met, pieces, windows), edits))
    best = F.min(F.struct("distance", "first_word", "end_word")).alias("best")
    return met.groupBy("row", "doc_id", "mark", "item_id").agg(best).select("row", "doc_id", "mark", "item_id", "best.*")


def _guesses(met: DataFrame, pieces: DataFrame, windows: DataFrame) -> DataFrame:
    """Where items of several pieces may start, from the pieces met in a text: row, doc_id, mark, item_id, whole, held, starts."""
    named = met.where("at is not null").join(pieces.select("piece", "item"), "piece")
    places = named.groupBy("row", "doc_id", "mark", "item_id", "item").agg(F.collect_set(F.col("first_word") - F.col("at")).alias("starts"))
    places = written(places, "places")
    times = places.groupBy("item").agg(F.count("*").alias("times"))
    whole = pieces.where("whole is not null").select("item", "whole")
    texts = windows.where("held is not null").select("row", "held")
    return left_join_hot(places, whole, "item", hot_keys(times, "item")).join(texts, "row")


def leaks(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """Benchmark items that stand in a document: doc_id, item_id, distance, first_word, end_word.

    One row per row of docs (doc_id, text) and item (item_id, text) whose words, in some stretch of the text, are
    at most floor(edits * words of the item) word edits away; the nearest stretch is given, words from 0, the end
    exclusive. Null and empty texts and items hold nothing and match nothing. Repeated documents give their
    rows each, repeated items count once, an empty table gives no rows and other columns are ignored. Texts and items
    may be of any length: an item of n words is found wherever its edits stand, by a piece of PIECE words at most.
    """
    return _found(docs, benchmark, edits).drop("row", "mark")


def decontaminated(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """The rows of docs, with all their columns, in whose text no benchmark item stands.

    Null and empty texts stay, repeated rows are treated alike, and an empty table on either side drops nothing. Only
    rows whose text has the slot of a leaking one in a map of fixed size are moved, to be compared by hash.
    """
    found = written(_found(docs, benchmark, edits).groupBy("mark").agg(F.count_distinct("row").alias("times")), "leaking")
    first = found.select(F.conv(F.substring(F.hex("mark"), 1, 6), 16, 10).cast("int").alias("bit"))
    slots = first.select(F.shiftright("bit", 6).alias("slot"), F.expr("shiftleft(1L, bit & 63)").alias("value"))
    known = docs.sparkSession.sparkContext.broadcast(_packed(slots, MAP_BITS - 6, "<u8"))  # of fixed size
    mark = unused(docs, "mark")
    kept = docs.mapInArrow(_split(known, None), docs.schema)
    hits = docs.mapInArrow(_split(known, mark), StructType([*docs.schema.fields, StructField(mark, BinaryType())]))
    found = found.withColumnRenamed("mark", mark)
    hits = hits.join(F.broadcast(hot_keys(found, mark)), mark, "left_anti").join(found, mark, "left_anti")
    return kept.unionByName(hits.select(docs.columns))


def _split(known, name: str | None):
    """The rows whose text has no slot of the map or, where name is given, those that have, with the text's mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            marks = [mark_of(t) for t in batch.column("text").cast(pa.string()).to_pylist()]
            slot = np.array([int.from_bytes(m[: MAP_BITS // 8], "big") for m in marks], np.int64)
            hit = (known.value[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)) == 1
            if name is None:
                yield batch.filter(pa.array(~hit))
            elif hit.any():
                yield batch.append_column(name, pa.array(marks, pa.binary())).filter(pa.array(hit))

    return run
