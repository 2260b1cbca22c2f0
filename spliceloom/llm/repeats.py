"""Removal of repeated byte strings by prefix-free parsing over partitions.

A rolling hash of TRIGGER bytes runs over each document. The least hash of every window of LENGTH bytes is its
trigger; the windows of one trigger form a phrase, from the first window's start to the last one's end, so none is the
start of another with the same trigger place. Equal windows have equal triggers at the same place. Phrases overlap by
LENGTH - 1 bytes, so that no match of LENGTH bytes runs from one into the next: suffixes of the parse need no comparing
beyond their first phrase.

The parse, one row of numbers per phrase, is dealt out by trigger; its suffix array, rows by phrase and then by corpus
place, tells which phrases came before and are repeats as a whole. Only where a trigger stands in different phrases do the
phrases' own bytes follow, as the dictionary of the part. The suffix array of the dictionary, by prefix doubling up to
LENGTH bytes, ranks its windows byte by byte, and with the places of the parse gives the corpus order in which
every window but the first of a rank is a repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spliceloom.llm.common import small_batches, text_bytes
from spliceloom.llm.wordhash import mix, prefix_hash, slice_hash
from spliceloom.staging import written

LENGTH, TRIGGER = 100, 24
#: Windows of a long text that are parsed at once.
STRETCH = 1_000_000
#: Parts that the parse is dealt into, for each shuffle partition.
PARTS = 4


def _windowed_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of each width consecutive keys."""
    size = 1
    while 2 * size <= width:
        keys = np.minimum(keys[: len(keys) - size], keys[size:])
        size *= 2
    return keys if size == width else np.minimum(keys[: len(keys) - (width - size)], keys[width - size :])


def phrases(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, trigger: int = TRIGGER) -> dict[str, np.ndarray]:
    """The phrases of texts: text, start (of the first window, in the text), count (of windows), trigger, and BLAKE2 of
    the bytes and the trigger's place, as two numbers."""
    empty = {k: np.zeros(0, np.uint64 if k in ("trigger", "content", "more") else np.int64) for k in ("text", "start", "count", "trigger", "content", "more")}
    if len(data) < length:
        return empty
    prefix = prefix_hash(data)
    place = np.arange(len(data) - trigger + 1)
    rolled = slice_hash(prefix, place, place + trigger)
    bits = np.uint64(int(len(data)).bit_length())
    least = _windowed_least((rolled >> bits << bits) | place.astype(np.uint64), length - trigger + 1)
    where = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    first = np.arange(len(where))
    text = np.searchsorted(offsets, first, side="right") - 1
    valid = first + length <= offsets[1:][text]
    first, where, text = first[valid], where[valid], text[valid]
    if not len(first):
        return empty
    new = np.ones(len(first), bool)
    new[1:] = (where[1:] != where[:-1]) | (text[1:] != text[:-1])
    lead = np.flatnonzero(new)
    count = np.diff(np.append(lead, len(first)))
    start, own, at = first[lead], text[lead], where[lead]
    raw, digest = data.tobytes(), hashlib.blake2b
    stop = start + count + length - 1
    content = b"".join([digest(raw[s:e], digest_size=16, salt=k.to_bytes(4, "little")).digest() for s, e, k in zip(start.tolist(), stop.tolist(), (at - start).tolist())])
    content = np.frombuffer(content, np.uint64).reshape(-1, 2)
    return {"text": own, "start": start - offsets[own], "count": count, "trigger": rolled[at], "content": content[:, 0], "more": content[:, 1]}


def long_phrases(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, stretch: int | None = None) -> dict[str, np.ndarray]:
    """The phrases of texts; a lone long text is parsed in stretches of windows, whose memory doesn't grow with it.

    Where stretches meet, a phrase may be cut in two: each window still has one phrase, by its trigger.
    """
    stretch = stretch or STRETCH
    if len(offsets) != 2 or len(data) <= 2 * stretch:
        return phrases(data, offsets, length)
    found = []
    for begin in range(0, len(data) - length + 1, stretch):
        part = data[begin : begin + stretch + length - 1]
        found.append(phrases(part, np.array([0, len(part)]), length))
        found[-1]["start"] = found[-1]["start"] + begin
    return {k: np.concatenate([f[k] for f in found]) for k in found[0]}


def _parse(docs: DataFrame, parts: int, length: int) -> DataFrame:
    """A row for each batch and part: the phrases whose trigger belongs to the part, as packed arrays.

    Of a phrase that a batch holds more than once, only the first goes to the trigger's part for comparison; the
    rest are repeats already and are spread over all parts, so that a common passage doesn't gather in one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = long_phrases(*text_bytes(batch.column("text")), length)
            doc = np.array(batch.column("doc_id").to_pylist(), np.int64)
            mark = np.array(batch.column("mark").to_pylist(), np.int64)
            own = found["text"]
            order = np.lexsort((found["start"], doc[own], found["more"], found["content"]))
            own, start, count, trigger, content, more = own[order], *(found[k][order] for k in ("start", "count", "trigger", "content", "more"))
            again = _after_first((content, more), (doc[own], start))
            part = (mix(np.where(again, doc[own].view(np.uint64) + start.astype(np.uint64), trigger)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            out = {k: [] for k in ("part", "docs", "marks", "own", "start", "count", "trigger", "content", "more", "again")}
            for p in np.flatnonzero(np.diff(cuts)).tolist():
                some = order[cuts[p] : cuts[p + 1]]
                used, local = np.unique(own[some], return_inverse=True)
                values = {"docs": doc[used], "marks": mark[used], "own": local.astype(np.uint32), "start": start[some].astype(np.uint32), "count": count[some].astype(np.uint16), "trigger": trigger[some], "content": content[some], "more": more[some], "again": again[some]}
                out["part"].append(p)
                for k, v in values.items():
                    out[k].append(v.tobytes())
            yield pa.record_batch({k: pa.array(v, pa.int32() if k == "part" else pa.binary()) for k, v in out.items()})

    schema = "part int, docs binary, marks binary, own binary, start binary, count binary, trigger binary, content binary, more binary, again binary"
    return docs.mapInArrow(run, schema)


def _after_first(keys: tuple[np.ndarray, ...], places: tuple[np.ndarray, ...]) -> np.ndarray:
    """Of rows sorted by keys and then places: whether a row comes after the first place of its keys."""
    n = len(keys[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    lead = np.flatnonzero(new)[np.cumsum(new) - 1] if n else np.zeros(0, np.int64)
    return np.logical_or.reduce([p != p[lead] for p in places]) if n else np.zeros(0, bool)


_FOUND = "doc_id long, mark long, start long, count int, trigger long, edge boolean"


def _sorted_parse(rows: pd.DataFrame) -> pd.DataFrame:
    """The part's phrases in corpus order: repeats, and edges, the first phrases of a trigger that stands in several."""
    read = lambda c, kind: [np.frombuffer(x, kind) for x in rows[c]]
    own = read("own", np.uint32)
    doc = np.concatenate([d[o] for d, o in zip(read("docs", np.int64), own)])
    mark = np.concatenate([d[o] for d, o in zip(read("marks", np.int64), own)])
    kinds = {"start": np.uint32, "count": np.uint16, "trigger": np.uint64, "content": np.uint64, "more": np.uint64, "again": bool}
    start, count, trigger, content, more, again = (np.concatenate(read(c, k)) for c, k in kinds.items())
    order = np.lexsort((start, doc, more, content, trigger))
    doc, mark, start, count, trigger, content, more, again = (x[order] for x in (doc, mark, start, count, trigger, content, more, again))
    repeat = _after_first((content, more), (doc, start)) | again
    new = np.ones(len(doc), bool)
    new[1:] = trigger[1:] != trigger[:-1]
    group = np.cumsum(new) - 1
    changes = np.zeros(len(doc), bool)
    changes[1:] = ((content[1:] != content[:-1]) | (more[1:] != more[:-1])) & ~new[1:]
    several = np.bincount(group, changes, group[-1] + 1 if len(group) else 0) > 0
    keep = repeat | several[group]
    out = {"doc_id": doc, "mark": mark, "start": start.astype(np.int64), "count": count.astype(np.int32), "trigger": trigger.view(np.int64), "edge": ~repeat}
    return pd.DataFrame({k: v[keep] for k, v in out.items()})


def _compressed(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in small_batches(batches):
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "mark": batch.column("mark"), "packed": pa.array([pack(t.encode()) for t in batch.column("text").to_pylist()], pa.binary())})

    return docs.mapInArrow(run, "doc_id long, mark long, packed binary")


def _edge_phrases(texts: DataFrame, edges: DataFrame, parts: int, length: int) -> DataFrame:
    """The bytes of the edge phrases, with the part of their trigger."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {k: [] for k in ("part", "trigger", "doc_id", "mark", "start", "phrase")}
            for doc, mark, packed, own in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "mark", "packed", "own"))):
                text = zstandard.decompress(packed)
                for e in own:
                    row = (int(mix(np.array([e["trigger"]], np.int64).view(np.uint64))[0] % np.uint64(parts)), e["trigger"], doc, mark, e["start"], text[e["start"] : e["start"] + e["count"] + length - 1])
                    for k, v in zip(out, row):
                        out[k].append(v)
            yield pa.record_batch({k: pa.array(v, {"part": pa.int32(), "phrase": pa.binary()}.get(k, pa.int64())) for k, v in out.items()})

    lists = edges.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("trigger", "start", "count")).alias("own"))
    schema = "part int, trigger long, doc_id long, mark long, start long, phrase binary"
    return texts.join(lists, ["doc_id", "mark"]).select("doc_id", "mark", "packed", "own").mapInArrow(run, schema)


def suffix_ranks(data: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each suffix of data among all by its first depth bytes, equal for equal ones; 0 bytes follow the end.

    Eight bytes are ranked at once; then ranks of prefixes are doubled, the last time with as much overlap as needed.
    """
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    span = min(8, depth)
    keys = np.zeros(len(data), np.uint64)
    for k in range(span):
        keys = keys << np.uint64(8) | padded[k : k + len(data)]
    while True:
        _, ranks = np.unique(keys, return_inverse=True)
        if span >= depth or not len(data):
            return ranks
        step = min(span, depth - span)
        ahead = np.zeros(len(data), np.uint64)
        ahead[: max(len(data) - step, 0)] = ranks[step:].astype(np.uint64) + np.uint64(1)
        keys = ranks.astype(np.uint64) << np.uint64(32) | ahead
        span += step


def _sorted_windows(length: int):
    """The windows of the part's dictionary in corpus order: those that came before, as stretches of window starts."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        data, offsets = text_bytes(pa.array(rows["phrase"], pa.binary()))
        count = np.diff(offsets) - length + 1
        own = np.repeat(np.arange(len(rows)), count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        window = suffix_ranks(data, length)[offsets[own] + at]
        doc, mark, start = (rows[c].to_numpy()[own] for c in ("doc_id", "mark", "start"))
        start = start + at
        order = np.lexsort((start, doc, window))
        repeat = np.zeros(len(order), bool)
        repeat[order] = _after_first((window[order],), (doc[order], start[order]))
        hit = np.flatnonzero(repeat)
        new = np.ones(len(hit), bool)
        new[1:] = (np.diff(hit) > 1) | (own[hit][1:] != own[hit][:-1])
        lead = np.flatnonzero(new)
        size = np.diff(np.append(lead, len(hit)))
        some = hit[lead]
        return pd.DataFrame({"doc_id": doc[some], "mark": mark[some], "start": start[some], "count": size.astype(np.int32)})

    return run


def stretches(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """Texts (doc_id, mark, packed) and, for each, the starts and counts of windows that stand earlier too."""
    spark = docs.sparkSession
    parts = PARTS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("mark", F.xxhash64("text"))
    found = written(_parse(docs.where("doc_id is not null"), parts, length).groupBy("part").applyInPandas(_sorted_parse, _FOUND), "phrases")
    texts = _compressed(docs)
    edges = _edge_phrases(texts, found.where("edge"), parts, length)
    narrow = edges.groupBy("part").applyInPandas(_sorted_windows(length), "doc_id long, mark long, start long, count int")
    return texts, found.where("not edge").select("doc_id", "mark", "start", "count").unionByName(written(narrow, "windows"))


def deduplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Every row of docs (doc_id, text) without the bytes that repeat an earlier string of length bytes.

    Columns: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the bytes that remain),
    kept (those bytes). Earlier is a smaller doc_id or, in the same document, an earlier start; strings are judged
    on the input and don't cross documents. A null text counts as empty. Rows of the same doc_id and text are one
    document at one place, so neither repeats the other; a row without doc_id stands nowhere and is left whole.
    Texts shorter than length stay as they are, an empty table gives no rows, other columns are ignored. A text may be of any
    length: it is parsed in stretches, and a task holds it once or twice.
    """
    texts, repeats = stretches(docs, length)
    lists = repeats.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "count")).alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
            for doc, packed, own in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "packed", "own"))):
                text = zstandard.decompress(packed)
                pieces, runs, reach = [], 0, 0
                for start, stop in sorted((s["start"], s["start"] + s["count"] + length - 1) for s in own or ()):
                    if start > reach or not runs:  # a removed run that doesn't touch the one before
                        pieces.append(text[reach:start])
                        runs += 1
                    reach = max(reach, stop)
                kept = b"".join([*pieces, text[reach:]])
                row = (doc, len(text), len(text) - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept)
                for k, v in zip(out, row):
                    out[k].append(v)
            kinds = {"kept_sha256": pa.string(), "kept": pa.binary()}
            yield pa.record_batch({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return texts.join(lists, ["doc_id", "mark"], "left").select("doc_id", "packed", "own").mapInArrow(run, schema)
