"""Shared helpers: joins that leave hot keys in place, and Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spliceloom.staging import written

#: Bytes of text that one vectorised step handles at once; a longer text is handled alone.
BATCH_BYTES = 1_000_000
#: A key is hot if it holds more than one of so many rows, so there are fewer hot keys than this.
HOT = 10_000
#: Rows of a key that one task takes in any case.
DEALT = 1000


def hot_keys(counts: DataFrame, key: str, times: str = "times") -> DataFrame:
    """The hot keys of counts, a table with a row per key and how many rows hold it: fewer than HOT, whatever its size."""
    total = counts.agg(F.sum(times)).first()[0] or 0
    return written(counts.where(F.col(times) > max(total / HOT, 1)).select(key), "hot")


def left_join_hot(rows: DataFrame, single: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """rows left-joined with single, which has one row per key; rows of the hot keys stay where they are.

    The rows of single that belong to hot keys, fewer than HOT, are sent to all tasks; only the rest is shuffled.
    """
    hot = F.broadcast(hot)
    few = F.broadcast(single.join(hot, key, "left_semi"))
    ahead = rows.join(hot, key, "left_semi").join(few, key, "left")
    return ahead.unionByName(rows.join(hot, key, "left_anti").join(single, key, "left"))


def join_dealt(rows: DataFrame, single: DataFrame, key: str, counts: DataFrame, times: str = "times") -> DataFrame:
    """rows joined with single, which has few rows per key, on key; the rows of hot keys are dealt out to many tasks.

    counts, a table, tells how many of rows hold each key. A key is hot if more than one in HOT of the rows hold it, and DEALT at least;
    without any it is a plain join. Of a hot key each task gets no more rows than make a key hot, and the rows of single
    once; other rows are joined as ever, so that an exchange of single serves other joins too. The hot keys and their
    numbers of tasks, fewer than HOT rows, are sent to all.
    """
    total, top = counts.agg(F.sum(times), F.max(times)).first()
    most = max((total or 0) / HOT, DEALT)
    if (top or 0) <= most:
        return rows.join(single, key)
    hot = F.broadcast(written(counts.where(F.col(times) > most).select(key, F.ceil(F.col(times) / most).cast("int").alias("__salts")), "hot"))
    dealt = rows.join(hot, key).withColumn("__salt", F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), "__salts").cast("int")).drop("__salts")
    few = single.join(hot, key).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1))).drop("__salts")
    return dealt.join(few, [key, "__salt"]).drop("__salt").unionByName(rows.join(hot, key, "left_anti").join(single, key))


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def small_batches(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most limit bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(_lengths(batch.column(text)))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def _lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after the other, and where each begins; null counts as empty."""
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
