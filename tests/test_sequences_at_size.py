"""Sequences are made where they are joined, and translated in batches."""

from pyspark.sql import functions as F

from spliceloom.functions import seq as s
from spliceloom.operators import annotation as a
from spliceloom.plans.tables import graph_sequences, sequences

SF = "/root/testdata/sf0.001"


def test_bases_are_made_by_as_many_tasks_as_a_shuffle_has(spark):
    """A file of keys is one task, which would make all bases."""
    for made in (sequences(spark, SF), graph_sequences(spark, SF)):
        assert made.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_sequences_are_not_broadcast(spark):
    """However small their keys' file is."""
    cds = spark.createDataFrame([(1, 10, "+", 0, 0, 30, 0)], "gene long, tx long, strand string, line int, left int, right int, phase int")
    plan = a.background_peptides(cds, sequences(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_a_filter_on_peptides_translates_once(spark):
    rows = spark.createDataFrame([("ATGGCC",), ("TAAATG",)], "d string")
    found = s.with_residues(rows, "r", F.upper("d")).withColumn("p", F.substring_index("r", "_", 1)).where("p != ''")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("_translated(") == 1
    assert [r.p for r in found.collect()] == ["MA"]


def test_residues_of_batches_with_gaps_and_other_letters(spark):
    texts = ["ATGGCCTAAAT", None, "", "at", "gccatg", "ANGGCC", "é" * 3 + "ATG", "TTTéTTTTT", "\U0001d11eATGC"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, d string").coalesce(1)
    assert [r.r for r in rows.select("k", s.residues(F.col("d")).alias("r")).sort("k").collect()] == ["MA_", None, "", "", "AM", "XA", "XM", "FXF", "X"]
    # the same without letters of several bytes, where the whole batch is looked up at once
    few = rows.where("k < 6").select("k", s.residues(F.col("d")).alias("r"), s.has_stop(F.col("d")).alias("stop")).sort("k").collect()
    assert [r.r for r in few] == ["MA_", None, "", "", "AM", "XA"] and [r.stop for r in few] == [True, None, False, False, False, False]
