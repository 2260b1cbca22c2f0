"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths of the tables that this process has written.
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where none is set and all run on one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as a table and read again, so that it is made once and a lost executor costs no more than its readers."""
    return opened(df.sparkSession, [append(df, name)], df.schema)


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which `drop_tables` knows."""
    _MADE.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def append(df: DataFrame, name: str) -> str:
    """The path of a new table of df's rows."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return path


def drop_tables(spark: SparkSession) -> int:
    """Delete the tables written so far, once the results that read them are written themselves; tells how many."""
    dropped = 0
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        dropped += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return dropped


def opened(spark: SparkSession, paths: list[str], schema) -> DataFrame:
    """The rows of tables of one schema."""
    return spark.read.schema(schema).parquet(*paths)
