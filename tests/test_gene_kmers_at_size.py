"""K-mers are told apart, measured and cut from the genome again gene by gene, where they are made."""

import datetime
import random

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from spliceloom import plans
from spliceloom.functions import seq as s
from spliceloom.operators import peptides as p
from spliceloom.plans import graph
from spliceloom.plans.tables import dna_of, edges, placed_edges, short_bases_of, vertices

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Lines without number, part or supplier, line numbers and orders that come twice, and exons that overlap."""
    where, r = str(tmp_path_factory.mktemp("odd")), random.Random(3)
    day = datetime.datetime(2020, 1, 1)
    lines = []
    for order in range(1, 40):
        for n in r.sample(range(1, 9), r.randint(1, 7)):
            lines.append([order, r.choice([49, 50, 98, 99, 150, 151, 3, 48, 6]), r.choice([38, 39, 79, 1, 20]), n, float(r.randint(1, 50))])
    for k, at in enumerate(r.sample(range(len(lines)), 12)):
        lines[at][k % 4 + 1] = None
    lines += lines[:9]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(f"{where}/lineitem.parquet")
    orders = [(n, n % 5 + 1, day) for n in [*range(1, 40), 4, 5, 5]]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(f"{where}/orders.parquet")
    return where


@pytest.mark.parametrize("name", ["kmer_matrices", "foreground_kmers"])
def test_kmers_are_not_moved(spark, name, monkeypatch):
    monkeypatch.setattr(p, "written", None)
    plan = _plan(plans.queries()[name](spark, SF))
    above, below = plan.split("MapInArrow", 1)
    assert "Exchange" not in above and "Aggregate" not in above and "Join" not in above and "MapInArrow" not in below


def test_only_counts_of_checked_kmers_are_moved(spark):
    above = _plan(plans.queries()["roundtrip_pairs"](spark, SF)).split("MapInArrow", 1)[0]
    made = above[above.rindex("Exchange") :]
    assert "partial_count" in made and "Join" not in made


def test_lines_are_dealt_out_once_for_pairs(spark):
    for counted in (False, True):
        assert _plan(p.by_gene(placed_edges(spark, SF, counted))).count("Exchange") <= _plan(vertices(spark, SF)).count("Exchange")


def test_pairs_by_a_window_are_those_of_joins(spark, odd):
    for where in (SF, odd):
        vs = vertices(spark, where)
        want = p.placed_ends(edges(spark, where, vs).withColumnsRenamed({"src": "v", "dst": "w"}), vs.select("gene", "v", "start", "stop", "strand")).distinct()
        got = placed_edges(spark, where).distinct()
        assert _rows(got) == _rows(want) and got.count() > 50


def test_odd_rows_give_what_the_joined_tables_give(spark, odd):
    vs = graph._made(spark, odd)
    found = p.reference_peptides(graph._all_pairs(spark, odd, vs))
    want = graph._one_table(*p.kmer_matrices(found, 9, *graph._expressed(spark, odd, vs)))
    assert _rows(graph.kmer_matrices(spark, odd)) == _rows(want) and want.where("isCrossJunction and junctionAnnotated").count() > 10
    kmers = p.peptide_kmers(found, 9)
    assert _rows(graph.foreground_kmers(spark, odd)) == _rows(kmers.select("gene", "kmer", "coord", "isCrossJunction"))
    times = spark.read.parquet(f"{odd}/orders.parquet").groupBy(F.col("o_orderkey").alias("gene")).agg(F.count("*").alias("times"))
    counts = kmers.groupBy("gene").agg(F.count("*").alias("n")).join(times, "gene").select("gene", (F.col("n") * F.col("times")).alias("n_kmers"), F.lit(0).cast("long").alias("n_mismatch"))
    assert _rows(graph.roundtrip_pairs(spark, odd)) == _rows(counts)


def _random(spark):
    """Peptides of one to three parts, some of which overlap or come again, and counts of some segments and junctions."""
    r = random.Random(5)
    rows, segments, crossing, known = [], [], [], []
    for gene in range(12):
        places = [sorted(r.sample(range(1, 60), 2)) for _ in range(4)]
        for n in range(30):
            parts = [tuple(x) for x in r.sample(places, r.randint(1, 3))]
            size = sum(b - a for a, b in parts) // 3
            row = [gene, "+-"[gene % 2], n % 7 == 0, parts, "".join(random.Random(f"{gene}{parts}").choices("AC", k=size))]
            rows += [row] * r.randint(1, 2)
        cut = sorted(r.sample(range(70), 6))
        segments += [(gene, a, b, [float(r.randint(0, 9)), None if r.random() < 0.2 else float(r.randint(0, 9))]) for a, b in zip(cut, cut[1:] + [cut[-1]])] * r.randint(1, 2)
        for a, b in r.sample([(x[1], y[0]) for x in places for y in places], 8):
            crossing.append((gene, a, b, None if r.random() < 0.2 else [float(r.randint(0, 9)), 1.0]))
        known += [(gene, a, b) for _, a, b, _ in crossing[-3:]] + [(gene, 1, 2)]
    df = spark.createDataFrame(rows, "gene int, strand string, annotated boolean, parts array<struct<start:int,stop:int>>, peptide string")
    segments = spark.createDataFrame(segments, "gene int, seg_start int, seg_stop int, counts array<double>")
    crossing = spark.createDataFrame(crossing, "gene int, left_stop int, right_start int, counts array<double>").dropDuplicates(["gene", "left_stop", "right_start"])
    return df, segments, crossing, spark.createDataFrame(known, "gene int, a int, b int").distinct()


def test_kmers_are_told_apart_where_they_are_cut(spark, monkeypatch):
    df = _random(spark)[0]
    want = _rows(p.peptide_kmers(df, 2))
    for size in (100_000, 3, 50):
        monkeypatch.setattr(s, "CUT", size)
        assert _rows(p.gene_kmers(p.by_gene(df), 2)) == want
    assert len(want) > 500
    none = df.where("gene is null")
    assert p.gene_kmers(p.by_gene(none), 2).count() == 0
    text = df.withColumn("gene", F.when(F.col("gene") > 2, F.concat(F.lit("é"), "gene")))
    assert _rows(p.gene_kmers(p.by_gene(text), 2)) == _rows(p.peptide_kmers(text, 2))


def test_rows_out_of_order_are_an_error(spark):
    df = spark.createDataFrame([(2, "+", False, [(0, 9)], "ACD"), (1, "+", False, [(0, 9)], "ACD")], "gene int, strand string, annotated boolean, parts array<struct<start:int,stop:int>>, peptide string")
    with pytest.raises(PythonException, match="not in order of gene"):
        p.gene_kmers(df.coalesce(1), 2).collect()


def test_expression_carried_by_pairs_is_that_of_joins(spark):
    df, segments, crossing, known = _random(spark)
    held = segments.groupBy("gene").agg(F.collect_list(F.struct(F.col("seg_start").alias("start"), F.col("seg_stop").alias("stop"), "counts")).alias("segments"))
    flags = known.select("gene", F.col("a").alias("left_stop"), F.col("b").alias("right_start"), F.lit(True).alias("annotated"))
    steps = crossing.join(flags, ["gene", "left_stop", "right_start"], "full").groupBy("gene").agg(F.collect_list(F.struct("left_stop", "right_start", "counts", "annotated")).alias("junctions"))
    rows = p.expressed(p.gene_kmers(p.by_gene(df.join(held, "gene").join(steps, "gene")), 2), 2)
    segment, junction = p.kmer_matrices(df, 2, segments, crossing, known)
    assert _rows(rows) == _rows(segment.unionByName(junction))
    assert rows.where("isCrossJunction and expr is not null and junctionAnnotated").count() > 5 and rows.where("not isCrossJunction and expr is null").count() > 5


def test_short_bases_are_those_of_the_whole(spark):
    ends = [(0, 1), (0, 27), (5, 32), (31, 33), (32, 59), (60, 92), (1000, 1024), (1023, 1024), (1010, 1040)]
    rows = spark.createDataFrame([(7 + n, a, b) for n, (a, b) in enumerate(ends)], "gene long, start int, stop int")
    whole = F.substring(dna_of(F.col("gene")), F.col("start") + 1, F.col("stop") - F.col("start"))
    assert rows.where(short_bases_of(F.col("gene"), F.col("start"), F.col("stop")) != whole).count() == 0
