"""Unit vectors of sequence functions and operators, and properties."""

import pytest
from pyspark.sql import functions as F

from spliceloom.functions import seq as s
from spliceloom.operators import cohort as c
from spliceloom.operators import graph as g
from spliceloom.operators import quality as q
from spliceloom.operators import specificity as sp


def _one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("dna", "pieces", "stop"),
    [("", [""], False), ("A", [""], False), ("AT", [""], False), ("ATG", ["M"], False), ("atgG", ["M"], False), ("ATGTAA", ["M", ""], True), ("TAGATG", ["", "M"], True), ("ATGNAA", ["MX"], False), ("ATGTAACCC", ["M", "P"], True)],
)
def test_translation(spark, dna, pieces, stop):
    assert _one(spark, s.peptides(F.col("d")), d=dna) == pieces
    assert _one(spark, s.has_stop(F.col("d")), d=dna) == stop
    assert _one(spark, s.peptide(F.col("d")), d=dna) == pieces[0]


def test_sequences(spark):
    assert _one(spark, s.reverse_complement(s.reverse_complement(F.col("d"))), d="ACGTNacgt") == "ACGTNacgt"
    assert _one(spark, s.kmers(F.col("d"), 3), d="ABCDE") == ["ABC", "BCD", "CDE"]
    assert _one(spark, s.kmers(F.col("d"), 3), d="AB") == []
    assert _one(spark, s.overlap_joined(F.col("a"), F.col("b")), a="ABCD", b="CDEF") == "ABCDEF"
    assert _one(spark, s.overlap_joined(F.col("a"), F.col("b")), a="AB", b="XY") is None
    assert _one(spark, s.chromosome_name(F.col("a")), a=23) == "X"
    assert _one(spark, s.attributes(F.col("a")), a='gene_id "g1"; transcript_id "t 1"; tag "a"; tag "b";') == {"gene_id": "g1", "transcript_id": "t 1", "tag": "a"}
    assert _one(spark, s.attributes(F.col("a")), a="ID=x;Parent=y") == {"ID": "x", "Parent": "y"}


def test_coordinates_round_trip(spark):
    rows = spark.sql("select array(named_struct('start', 10, 'stop', 24), named_struct('start', 40, 'stop', 70)) as parts, explode(sequence(0, 11)) as pos")
    for strand in "+-":
        out = rows.select("pos", s.genomic_parts(F.col("pos"), 3, F.col("parts"), F.lit(strand)).alias("p")).collect()
        assert all(sum(x.stop - x.start for x in r.p) == 9 for r in out)
    first = rows.where("pos = 3").select(s.coordinate_text(s.genomic_parts(F.col("pos"), 3, F.col("parts"), F.lit("+"))).alias("t")).first().t
    assert first == "19:24:40:44:None:None"
    keys = _one(spark, s.junction_keys(s.coordinate_numbers(F.col("t"))), t="990:995:1000:1004:None:None")
    assert (keys.strand, keys.jct1, keys.jct2) == ("+", "995:1000", None)


def test_variants_and_combinations(spark):
    v = spark.sql("select 'ACGT' as d, array(named_struct('pos', 11, 'base', 'T'), named_struct('pos', 12, 'base', '*'), named_struct('pos', 99, 'base', 'A')) as v")
    assert v.select(s.with_variants(F.col("d"), F.lit(10), F.col("v")).alias("x")).first().x == "ATGT"
    assert spark.sql("select array(1, 2, 3) as a").select(F.size(s.combinations(F.col("a"))).alias("n")).first().n == 8


def test_cohort_rules(spark):
    m = spark.createDataFrame([("a", [5.0, 0.0, 9.0]), ("b", [0.0, 0.0, 1.0]), ("b", [0.0, 2.0, 0.0]), ("c", [float("nan"), None, 0.0])], "kmer string, expr array<double>")
    m = m.withColumn("expr", c.clean(F.col("expr")))
    assert {r.kmer for r in c.normal_background(m, [0, 1, 2], 5.0, None).collect()} == {"a"}
    assert {r.kmer for r in c.normal_background(m, [0, 1, 2], None, 1).collect()} == {"a", "b"}
    assert c.normal_background(m, [0, 1, 2], None, None).count() == 0
    assert [r.kmer for r in m.where(c.annotation_only(F.col("expr"))).collect()] == ["c"]
    assert {r.kmer for r in c.cohort_support(m, [0, 1, 2], 0, 1, 2).collect()} == {"a", "b"}
    known = spark.createDataFrame([("L",)], "kmer string")
    assert c.without_known(spark.createDataFrame([("I", 1), ("K", 2)], "kmer string, n int"), known).collect() == [("K", 2)]


def test_background_and_result_are_disjoint_and_thresholds_monotone(spark):
    from spliceloom.plans.tables import CANCER, NORMAL, matrix

    m = matrix(spark, "/root/testdata/sf0.001").persist()
    sizes = []
    for at_least in (20.0, 40.0, 60.0):
        out = c.cohort_filter(m, m, CANCER, NORMAL, 3, 10.0, 20.0, 1, at_least, None)
        background = c.normal_background(m, NORMAL, at_least, None)
        assert out.join(background, "kmer").count() == 0
        sizes.append(out.count())
    assert sizes == sorted(sizes)
    m.unpersist()


def test_frames_reach_a_fixpoint_on_a_diamond(spark):
    exons = spark.createDataFrame([("g", 1, "ATGGCCA"), ("g", 2, "GCCGCC"), ("g", 3, "TAATAATAA"), ("g", 4, "GCCGCCG")], "gene string, v int, seq string")
    edges = spark.createDataFrame([("g", 1, 2), ("g", 1, 3), ("g", 2, 4), ("g", 3, 4)], "gene string, src int, dst int")
    seeds = spark.createDataFrame([("g", 1, 0, True)], "gene string, v int, phase int, annotated boolean")
    found = {(r.v, r.phase, r.annotated) for r in g.propagated_frames(g.transitions(exons, edges, seeds), seeds).collect()}
    assert (1, 0, True) in found and (2, 2, False) in found and (4, 2, False) in found


def test_redundant_junctions_keep_the_later_of_equals(spark):
    rows = [("g", 0, 10, 20, 5, 25, 1), ("g", 0, 10, 20, 5, 25, 2), ("g", 0, 10, 20, 7, 24, 3), ("g", 0, 10, 20, 3, 22, 4), ("g", 0, 10, None, 1, 2, 5)]
    df = spark.createDataFrame(rows, "gene string, phase int, i1 int, i2 int, o1 int, o2 int, seq_no int")
    assert {r.seq_no for r in g.maximal_junctions(df).collect()} == {2, 4, 5}


def test_null_second_junction_meets_null(spark):
    peptides = spark.createDataFrame([("p", "1:2", None), ("q", "1:2", "3:4")], "peptide string, jct1 string, jct2 string")
    found = spark.createDataFrame([("1:2", None)], "jct1 string, jct2 string")
    assert [r.peptide for r in sp.junction_peptides(peptides, found).collect()] == ["p"]


def test_input_checks(spark):
    rows = spark.createDataFrame([("1",), ("2",), ("2",)], "chrom string")
    with pytest.raises(q.InputError, match="repeated"):
        q.check(lost=q.missing(rows, rows, "chrom"), repeated=q.repeated(rows, "chrom"))


def _pair(spark):
    from spliceloom.operators import peptides as p

    vertices = spark.createDataFrame([("g", 1, 0, 8, "+"), ("g", 2, 12, 20, "+"), ("h", 1, 12, 20, "-"), ("h", 2, 0, 8, "-")], "gene string, v int, start int, stop int, strand string")
    pairs = spark.createDataFrame([("g", 1, 2, 1, True), ("h", 1, 2, 0, False)], "gene string, v int, w int, phase int, annotated boolean")
    dna = "AATGGCCA" + "TTTT" + "GCTTGGAA"
    sequences = spark.createDataFrame([("g", dna, 0), ("h", "TTCCAAGC" + "TTTT" + "TGGCCATT", 0)], "gene string, dna string, offset int")
    return p, p.modified_pairs(pairs, vertices), sequences


def test_pair_peptides_on_both_strands(spark):
    p, pairs, sequences = _pair(spark)
    rows = {r.gene: r for r in p.reference_peptides(pairs, sequences).collect()}
    assert rows["g"].peptide == "MASLE" and [tuple(x) for x in rows["g"].parts] == [(1, 8), (12, 20)]
    assert rows["h"].peptide == "NGQLG" and [tuple(x) for x in rows["h"].parts] == [(12, 20), (1, 8)]
    kmers = p.peptide_kmers(p.reference_peptides(pairs, sequences), 3)
    assert q.roundtrip(kmers.withColumn("strand", F.when(F.col("gene") == "g", "+").otherwise("-")), sequences).agg(F.sum("n_mismatch")).first()[0] == 0
    meta = p.peptide_metadata(p.reference_peptides(pairs, sequences), spark.createDataFrame([("g", "1")], "gene string, chrom string"), "ref")
    assert {r.id for r in meta.collect()} == {"g:1_2:0:1:2-exons", "h:1_2:0:20:2-exons"} and len(meta.columns) == 17
    steps = {(r.gene, r.left_stop, r.right_start) for r in p.kmer_junctions(kmers).collect()}
    assert steps == {("g", 8, 12), ("h", 8, 12)}


def test_variants_change_peptides_part_by_part(spark):
    p, pairs, sequences = _pair(spark)
    variants = spark.createDataFrame([("s", "g", 2, "C"), ("s", "g", 16, "C"), ("s", "g", 9, "A"), ("t", "g", 6, "T"), ("s", "h", 0, "A")], "sample string, gene string, pos int, base string")
    found = {(r.sample, r.gene, r.variantComb): r.peptide for r in p.mutated_peptides(pairs, sequences, variants).collect()}
    # ATGGCCA GCTTGGAA: position 2 is its second base, 16 the eleventh's neighbour in the codon TTG at 14 to 16
    assert found[("s", "g", "2")] == "TASLE" and found[("s", "g", "16")] == "MASFE" and found[("s", "g", "2;16")] == "TASFE"
    assert ("s", "g", "9") not in found and not any(g == "h" for _, g, _ in found)
    assert p.crowded_pairs(pairs, variants, 1).collect()[0].n_variants == 2


def test_all_variants_of_a_crowded_pair_are_combined(spark):
    p, pairs, sequences = _pair(spark)
    places = [1, 2, 3, 4, 5, 6, 7, 12, 13, 14, 15, 16]  # to C, which is in no stop codon
    variants = spark.createDataFrame([("s", "g", k, "C") for k in places], "sample string, gene string, pos int, base string")
    rows = p.mutated_peptides(pairs, sequences, variants, force=True).collect()
    assert len({r.variantComb for r in rows}) == len(rows) == 2**12 - 1
    assert sorted(r.variant_no for r in rows) == list(range(2**12 - 1))
    assert {r.variantComb for r in rows if r.variant_no < 12} == {str(k) for k in places}


def test_variant_combos_of_many_positions(spark, monkeypatch):
    from spliceloom.plans import sequence

    held = spark.createDataFrame([("s", 1, k) for k in range(7)] + [("t", 1, 5)], "sample string, gene long, pos int")
    monkeypatch.setattr(sequence, "variants", lambda spark, d: held)
    rows = sequence.variant_combos(spark, "").collect()
    assert len(set(rows)) == len(rows) == 2**7 + 2


def test_too_many_items_fail_instead_of_being_left_out(spark):
    rows = spark.range(1).select(F.sequence(F.lit(1), F.lit(63)).alias("x"))
    with pytest.raises(Exception, match="too many combinations"):
        s.with_combinations(rows, "x", "c").count()


def test_one_pass_filter_equals_its_steps(spark):
    import random

    rng = random.Random(5)
    row = lambda: [float(rng.choice((0, 0, 5, 9))) for _ in range(6)]
    schema = "kmer string, expr array<double>"
    cancer = spark.createDataFrame([(f"k{rng.randrange(60)}", row()) for _ in range(200)], schema).distinct()
    normal = spark.createDataFrame([(f"k{rng.randrange(60)}", row() if rng.random() < 0.5 else [0.0] * 6) for _ in range(25)], schema)
    external = spark.createDataFrame([("k3",), ("k7",)], "kmer string")
    settings = ([0, 1, 2, 3], [4, 5], 1, 5.0, 9.0, 1, 9.0, 2)
    silent = normal.where(c.support(F.col("expr"), 0, [4, 5]) == 0).select("kmer")
    background = c.normal_background(normal, [4, 5], 9.0, 2).unionByName(silent).unionByName(external)
    own, cohort = c.sample_support(cancer, 1, 5.0), c.cohort_support(cancer, [0, 1, 2, 3], 9.0, 1, 1)
    plain = lambda df: sorted((r.kmer, tuple(r.expr)) for r in df.collect())
    for union in (False, True):
        expected = c.differential(c.supported(own, cohort, cancer, union), background)
        assert plain(c.cohort_filter(cancer, normal, *settings, external=external, union=union)) == plain(expected)
    counts = {r.name: r.n for r in c.filter_counts(cancer, normal, *settings, external=external).collect()}
    both = c.supported(own, cohort, cancer)
    assert counts == {"all": cancer.count(), "sample": own.count(), "cohort": both.count(), "differential": c.differential(both, background).count()}
