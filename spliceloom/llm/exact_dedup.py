"""Exact duplicates by a tree-merge of sorted digest runs, with DataFrame functions only.

Every input partition makes one run: a row per digest, sorted, with how often its text stands there and the identifier to
keep. Runs have numbers. In each round FAN runs of neighbouring numbers are merged into one: rows of equal digest meet,
their counts are added and the identifier to keep is chosen anew, so that a text's copies, however many, are at most FAN
rows of a round. A run is dealt out by digest, so no task holds a whole run; after the last round one run is left, with a
row per text. Merging sorts and folds (a struct is kept, which Spark aggregates in sorted order), so memory is bounded.

A digest is SHA-256. Rows are only merged where length and a second, unrelated 64-bit hash of the text agree as well, at
every level, so that a text is never taken for another by its digest alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spliceloom.llm.common import hot_keys, left_join_hot
from spliceloom.staging import written

#: Runs that are merged into one in a round.
FAN = 8


def run_count(spark, fan: int = FAN) -> int:
    """Runs to start with: a power of fan, no fewer than there are shuffle partitions."""
    runs = fan
    while runs < int(spark.conf.get("spark.sql.shuffle.partitions")):
        runs *= fan
    return runs


def signed(docs: DataFrame, text: Column) -> DataFrame:
    """Per row of docs: doc_id, the digest of text, its length in bytes and a second hash, which verify the digest."""
    data = F.coalesce(text.cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long"), data.alias("data"))
    return rows.select("doc_id", F.unhex(F.sha2("data", 256)).alias("digest"), F.octet_length("data").alias("bytes"), F.xxhash64("data").alias("check"))


def merged(runs: DataFrame, fan: int = FAN, keep: str = "largest") -> DataFrame:
    """One round: runs (run, digest, bytes, check, best, times) whose numbers agree but for the last digit become one run."""
    best = F.max("best") if keep == "largest" else F.min("best")
    return runs.groupBy(F.expr(f"run div {int(fan)}").alias("run"), "digest", "bytes", "check").agg(best.alias("best"), F.sum("times").alias("times"))


def groups(rows: DataFrame, fan: int = FAN, keep: str = "largest") -> DataFrame:
    """Texts of signed rows: digest, bytes, check, keep_id and group_size (rows that hold the text), by tree-merge."""
    runs = run_count(rows.sparkSession, fan)
    # a struct is folded in sorted order; rows without doc_id never win against one that has it
    best = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id"))
    level = rows.select((F.spark_partition_id() % runs * fan).alias("run"), "digest", "bytes", "check", best.alias("best"), F.lit(1).cast("long").alias("times"))
    level, left = merged(level, fan, keep), runs
    while left > 1:
        level, left = merged(level, fan, keep), left // fan
    return level.select("digest", "bytes", "check", F.col("best.doc_id").alias("keep_id"), F.col("times").alias("group_size"))


def exact_groups(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """Each row of docs with the row that stays of its equal texts: doc_id, keep_id, group_size, kept, text_sha256.

    docs needs doc_id and text; other columns are ignored. Texts are equal when their bytes are; null counts as empty, and
    white space and case count. keep is "largest" or "smallest": which doc_id stays. group_size counts rows, kept marks the
    row with keep_id. Rows that repeat doc_id and text alike all carry one decision (one_of_each_text leaves one of them).
    A row without doc_id stays only where no equal text has one; keep_id is null then. An empty table gives no rows. Texts may
    be of any length: a row carries 60 bytes for each.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is largest or smallest")
    table = written(signed(docs, F.col("text")), "digests")
    found = written(groups(table, keep=keep).withColumn("name", F.struct("digest", "bytes", "check")).drop("digest", "bytes", "check"), "texts")
    rows = table.select("doc_id", F.struct("digest", "bytes", "check").alias("name"))
    out = left_join_hot(rows, found, "name", hot_keys(found, "name", "group_size"))
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("name.digest")).alias("text_sha256"))


def one_of_each_text(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """doc_id and text_sha256 of one row per text, however often a row repeats."""
    return exact_groups(docs, keep).where("kept").select("doc_id", "text_sha256").distinct()
