"""K-mers and their places are cut by batches."""

import random

from pyspark.sql import functions as F

from spliceloom import plans
from spliceloom.functions import seq as s
from spliceloom.operators import peptides as p

SF = "/root/testdata/sf0.001"


def test_places_in_batches_are_those_of_the_expression(spark, monkeypatch):
    """Peptides of all lengths, one to three parts, empty ones too, both strands; letters of several bytes in some batches."""
    r = random.Random(1)
    rows = []
    for n in range(60):
        ends = sorted(r.sample(range(1, 120), 2 * (n % 3 + 1)))
        parts = [(a, b) for a, b in zip(ends[::2], ends[1::2])] + [(130, 130)] * (n % 2)
        size = sum(b - a for a, b in parts) // 3
        rows.append((n, "+-"[n % 2], parts if n % 2 == 0 else parts[::-1], None if n == 7 else ("é" if n < 20 else "A") + "".join(r.choices("ACDEFG", k=size - 1)) if size else ""))
    df = spark.createDataFrame(rows, "gene int, strand string, parts array<struct<start:int,stop:int>>, peptide string")
    want = df.select("gene", "strand", "parts", F.posexplode(s.kmers(F.col("peptide"), 4)).alias("pos", "kmer")).select("gene", "strand", "pos", "kmer", s.genomic_parts(F.col("pos"), 4, F.col("parts"), F.col("strand")).alias("parts"))
    want = sorted(map(str, want.collect()))
    monkeypatch.setattr(s, "CUT", 7)
    assert len(want) > 100
    for made in (df, df.coalesce(1), df.where("gene >= 20").coalesce(1)):
        got = s.with_kmers(made, 4)
        assert got.columns == ["gene", "strand", "pos", "kmer", "parts"] and set(map(str, got.collect())) <= set(want)
    assert sorted(map(str, s.with_kmers(df, 4).collect())) == want
    counted = s.with_kmers(df.select("gene", "strand", "parts", F.greatest(F.coalesce(F.length("peptide"), F.lit(0)) - 3, F.lit(0)).alias("n")), 4, "n")
    assert sorted(map(str, counted.collect())) == sorted(str(x) for x in s.with_kmers(df, 4).drop("kmer").collect())


def test_a_batch_is_cut_in_bounded_stretches():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["+"]), pa.array(["A" * 250_000]), pa.array([[{"start": 0, "stop": 750_000}]])], ["strand", "peptide", "parts"])
    sizes = [x.num_rows for x in s._cut(batch, 9, ["strand"], None)]
    assert sum(sizes) == 250_000 - 8 and max(sizes) <= s.CUT


def test_repeated_kmers_are_not_sorted(spark):
    """A column beside the keys of a distinct would make Spark sort all k-mers."""
    df = spark.createDataFrame([(1, "+", [(0, 30)], "ACDEFGHIKL", True)], "gene int, strand string, parts array<struct<start:int,stop:int>>, peptide string, annotated boolean")
    plan = p.peptide_kmers(df.union(df), 9)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and p.peptide_kmers(df.union(df), 9).count() == 2


def test_places_of_kmers_are_not_worked_out_by_functions_over_arrays(spark):
    for name in ("kmer_coords", "foreground_kmers", "roundtrip_check"):
        assert "zip_with(parts" not in plans.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
        assert "MapInArrow" in plans.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_keys_are_dealt_out_before_they_are_counted(spark):
    from spliceloom.operators.quality import repeated

    rows = spark.createDataFrame([(1, 2), (1, 2), (3, None), (3, None), (4, 5)], "a int, b int")
    plan = repeated(rows, "a", "b")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan[plan.index("Exchange") :]
    assert sorted(map(str, repeated(rows, "a", "b").collect())) == ["Row(a=1, b=2, times=2)", "Row(a=3, b=None, times=2)"]


def test_coding_pieces_are_dealt_out_once_by_order(spark):
    """For the greatest of a line, for the join with its order and for the junctions of a transcript."""
    from spliceloom.plans.tables import cds

    lines = [x for x in cds(spark, SF)._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
    assert len(lines) <= 2 and not any("l_linenumber" in x for x in lines)
