"""Exons carry their own bases, so that whole sequences are neither made for them nor joined with their pairs."""

from pyspark.sql import functions as F

from spliceloom import plans
from spliceloom.functions import seq as s
from spliceloom.operators import peptides as p
from spliceloom.plans import graph
from spliceloom.plans.tables import bases_of, dna_of, exons, graph_sequences

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bases_of_a_stretch_are_those_of_the_whole(spark):
    ends = [(0, 1), (0, 32), (31, 33), (32, 64), (5, 200), (1000, 1024), (1023, 1024), (990, 2000), (0, 1024)]
    rows = spark.createDataFrame([(7 + n, a, b) for n, (a, b) in enumerate(ends)], "gene long, start int, stop int")
    whole = F.substring(dna_of(F.col("gene")), F.col("start") + 1, F.col("stop") - F.col("start"))
    assert rows.where(bases_of(F.col("gene"), F.col("start"), F.col("stop")) != whole).count() == 0


def test_backward_residues_are_those_of_the_reverse_complement(spark):
    texts = ["ATGGCCTAAAT", None, "", "at", "gccatg", "ANGGCC", "TTAGGCCAT", "CAT", "TCA"]
    for more in ([], ["é" * 3 + "ATG", "CATé", "\U0001d11eATGC"]):
        rows = spark.createDataFrame([(t, b) for t in texts + more for b in (True, False)], "t string, back boolean").coalesce(1)
        want = F.when(F.col("back"), s.reverse_complement(F.col("t"))).otherwise(F.col("t"))
        found = rows.select("t", "back", s.residues(F.col("t"), F.col("back")).alias("got"), s.residues(want).alias("want")).collect()
        assert len(found) == 2 * len(texts + more) and [r for r in found if r.got != r.want] == []


def test_sequences_do_not_meet_pairs(spark):
    for name in ("foreground_peptides", "foreground_kmers", "isolated_peptides", "triple_peptides", "mutated_kmers"):
        plan = plans.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        # of each exon by its own, once on each side that reads pairs, and behind all joins with exons
        assert 1 <= plan.count("md5(") <= 4 and "md5(" not in plan[plan.rindex("Generate explode([0,1,2])") :].split("Join", 1)[1]


def test_exons_meet_before_frames_are_told_apart(spark):
    plan = _plan(graph._all_pairs(spark, SF))
    first = next(x for x in plan.splitlines() if "Join" in x or "Generate" in x)
    assert "Generate" in first


def test_pairs_with_bases_and_with_sequences_have_the_same_peptides(spark):
    pairs = graph._all_pairs(spark, SF).cache()
    names = ["gene", "v", "w", "phase", "peptide", "hasStopCodon", "isIsolated"]
    own, joined = (sorted(map(str, df.select(names).collect())) for df in (p.reference_peptides(pairs), p.reference_peptides(pairs.drop("bases"), graph_sequences(spark, SF))))
    assert own == joined and len(own) > 100


def test_only_genes_with_variants_are_paired_for_mutated_kmers(spark):
    some = exons(spark, SF).select("gene").distinct().limit(2)
    made = graph._made(spark, SF, some)
    assert made.select("gene").distinct().count() == 2


def test_bases_are_made_behind_the_join_with_variants(spark):
    plan = _plan(plans.queries()["apply_snps"](spark, SF))
    assert "md5(" in plan.split("Join")[0] and "md5(" not in plan.split("Join", 1)[1]


def test_germline_sequences_are_made_of_genes_with_variants(spark):
    plan = _plan(plans.queries()["germline_background"](spark, SF))
    assert "LeftSemi" in plan and plan.index("md5(") < plan.index("LeftSemi")


def test_numbered_peptides_are_dealt_out_by_gene_once(spark):
    """Behind the translation: for repeated ones and for their numbers."""
    plan = _plan(plans.queries()["numbered_peptides"](spark, SF))
    assert plan[: plan.index("ArrowEvalPython")].count("Exchange") == 1


def test_minus_transcripts_lose_their_phase_at_the_end(spark):
    from spliceloom.operators import annotation as a

    cds = spark.createDataFrame([(1, 10, "-", 0, 0, 8, 1), (1, 11, "+", 0, 0, 8, 2), (1, 12, "-", 0, 0, 2, 2)], "gene long, tx long, strand string, line int, left int, right int, phase int")
    dna = spark.createDataFrame([(1, "TTGGCATG", 0)], "gene long, dna string, offset int")
    assert sorted((r.tx, r.peptide) for r in a.background_peptides(cds, dna).collect()) == [(10, "MP"), (11, "GM")]
