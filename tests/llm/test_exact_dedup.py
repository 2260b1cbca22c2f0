import hashlib

import pytest
from pyspark.sql import functions as F

from spliceloom.llm import exact_dedup as x

SCHEMA = "doc_id long, text string"


def brute(rows, largest=True):
    held = {}
    for i, t in rows:
        held.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = [j for j in held[t or ""] if j is not None]
        best = (max if largest else min)(ids) if ids else None
        out.append((i, best, len(held[t or ""]), best is None or i == best, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_same_groups_as_brute_force(spark, keep):
    rows = [(k, f"text {k % 37} " * (k % 5)) for k in range(400)] + [(1000 + k, "hot") for k in range(300)]
    rows += [(2000, None), (2001, ""), (2002, " "), (2003, "Hot"), (2004, "é" * 200_000), (2005, "é" * 200_000), (None, "hot"), (None, "lone"), (7, "text 7 text 7 ")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(9)
    assert result(x.exact_groups(docs, keep)) == brute(rows, keep == "largest")


def test_rounds_merge_runs_and_keep_counts(spark):
    rows = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(64)], SCHEMA).repartition(16)
    table = x.signed(rows, F.col("text"))
    for fan in (2, 3, 8):
        assert {(r.keep_id, r.group_size) for r in x.groups(table, fan).collect()} == {(62, 32), (63, 32)}
    level = table.select(F.lit(5).alias("run"), "digest", "bytes", "check", F.struct("doc_id").alias("best"), F.lit(1).alias("times"))
    assert {(r.run, r.times) for r in x.merged(level, 2).collect()} == {(2, 32)}


def test_one_digest_with_another_length_or_check_is_another_text(spark):
    table = x.signed(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], SCHEMA), F.col("text")).withColumn("digest", F.lit(b"same"))
    assert {(r.keep_id, r.group_size) for r in x.groups(table).collect()} == {(1, 1), (2, 1), (3, 1)}


def test_empty_tables_clashing_columns_and_repeated_rows(spark):
    assert result(x.exact_groups(spark.createDataFrame([], SCHEMA))) == []
    docs = spark.createDataFrame([(1, "a", "x", 5, 0), (1, "a", "x", 5, 0), (2, None, None, None, None)], "doc_id int, text string, digest string, times int, keep_id int")
    assert result(x.exact_groups(docs)) == brute([(1, "a"), (1, "a"), (2, None)])
    assert sorted(r.doc_id for r in x.one_of_each_text(docs).collect()) == [1, 2]
    with pytest.raises(ValueError):
        x.exact_groups(docs, "first")


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a")], SCHEMA)
    plan = x.groups(x.signed(docs, F.col("text")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "SortAggregate" in plan
