"""Plans that keep memory and shuffles in proportion to the input."""

from pyspark.sql import functions as F

from spliceloom import plans
from spliceloom.operators import cohort as c
from spliceloom.operators import specificity as sp
from spliceloom.plans.tables import cohort_matrices

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_of_a_matrix_are_added_up_in_one_shuffle(spark):
    """A row's key is the only thing that aggregates shuffle by, not key and sample."""
    for made in cohort_matrices(spark, SF):
        assert "s_nationkey" not in "".join(line for line in _plan(made).splitlines() if "Exchange hashpartitioning" in line)


def test_failing_kmers_need_no_join(spark):
    m = spark.createDataFrame([("a", [9.0, 9.0]), ("b", [1.0, 9.0])], "kmer string, expr array<double>")
    found = c.failing(m.select("kmer"), m, m.where("kmer = 'a'"), [0, 1], [0], 0, 5, 5, 1, 6.0, None)
    assert "Join" not in _plan(found) and "Generate" not in _plan(found)
    assert sorted(map(tuple, found.collect())) == [("a", "normal"), ("b", "sample")]


def test_a_result_without_name_has_no_support(spark):
    m = spark.createDataFrame([(None, [9.0, 9.0])], "kmer string, expr array<double>")
    assert [tuple(r) for r in c.failing(m.select("kmer"), m, m, [0, 1], [0], 0, 5, 5, 1, 6.0, None).collect()] == [(None, "sample")]


def test_junctions_of_a_coordinate_are_read_from_one_split(spark):
    rows = spark.createDataFrame([("1:5:9:12:None:None",), ("20:25:9:12:2:4",)], "t string")
    keyed = sp.with_junctions(rows, "t")
    assert "transform(" not in keyed._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.strand, r.jct1, r.jct2) for r in keyed.collect()) == [("+", "5:9", None), ("-", "12:20", "4:9")]


def test_found_junctions_are_a_table_of_their_own(spark):
    rows = sp.with_junctions(spark.range(8).select(F.col("id"), F.concat(F.lit("1:5:"), F.col("id") + 9, F.lit(":30:None:None")).alias("t")), "t")
    kept = sp.junction_peptides(rows, rows.where("id < 2"))
    assert _plan(kept).count("Range (") == 1 and [r.id for r in kept.sort("id").collect()] == [0, 1]


def test_vertices_are_made_once_for_all_that_read_them(spark):
    assert "lineitem" not in plans.queries()["successors"](spark, SF)._jdf.queryExecution().analyzed().toString() + _plan(plans.queries()["successors"](spark, SF))
