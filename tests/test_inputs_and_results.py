"""Readers, checks, stages and reports on small files."""

import warnings

import pytest
from pyspark.sql import functions as F

from spliceloom.functions import seq as s
from spliceloom.operators import annotation as a
from spliceloom.operators import cohort as c
from spliceloom.operators import expression as e
from spliceloom.operators import graph as g
from spliceloom.operators import peptides as p
from spliceloom.operators import quality as q
from spliceloom.operators import specificity as sp
from spliceloom.sources import readers as r
from spliceloom.sources import sinks
from spliceloom.streaming.filters import stream_filter


def _file(path, text):
    path.write_text(text)
    return str(path)


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_field_names_in_any_case(spark, tmp_path):
    df, names = r.kmer_matrix(spark, _file(tmp_path / "m.tsv", "Kmer\tISCROSSJUNCTION\tS1\nAAA\tTrue\t2\n"))
    assert names == ["S1"] and df.columns == ["kmer", "isCrossJunction", "expr"] and _rows(df) == [("AAA", True, [2.0])]


def test_vcf_substitutions_of_equal_length(spark, tmp_path):
    head = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB\n"
    body = "1\t10\t.\tACG\tATC\t.\t.\t.\tGT\t0|1\t0|0\n1\t20\t.\tA\tAT\t.\t.\t.\tGT\t1|1\t1|1\n2\t5\t.\tC\tG\t.\t.\t.\tGT\t0/0\t1/0:9\n"
    rows = r.vcf_variants(spark, _file(tmp_path / "v.vcf", head + body)).drop("line")
    assert _rows(rows) == [("A", "1", 10, "C", "T"), ("A", "1", 11, "G", "C"), ("B", "2", 4, "C", "G")]


def test_genotypes_maps_and_variants_of_genes(spark, tmp_path):
    table = spark.createDataFrame([(23, 5, "A", "C", "m1", 0), (1, 9, "A", "G", "m2", 1), (1, 9, "A", "T", "m3", 2)], "chrom_code int, pos int, ref string, alt string, sample string, gt int")
    rows = r.genotype_variants(table)
    assert _rows(rows.drop("line")) == [("m1", "X", 4, "A", "C"), ("m2", "1", 8, "A", "G")]
    two = r.sample_map(spark, _file(tmp_path / "two.tsv", "graph\tmutation\ng1\tm1\ng2\t\n"))
    assert _rows(two) == [("g1", "m1"), ("g2", "g2")]
    three = _file(tmp_path / "three.tsv", "graph\tgermline\tsomatic\ng1\tm1\tm9\n")
    assert _rows(r.sample_map(spark, three, "germline")) == [("g1", "m1")] and _rows(r.sample_map(spark, three, "somatic")) == [("g1", "m9")]
    with pytest.raises(ValueError, match="three and a kind"):
        r.sample_map(spark, three)
    assert _rows(r.renamed_samples(rows, spark.createDataFrame([("m1", "g1")], "mutation string, graph string")).select("sample")) == [("g1",), ("m2",)]
    genes = spark.createDataFrame([("x", "X", 0, 10), ("y", "1", 0, 8)], "gene string, chrom string, start int, stop int")
    held = p.variants_of(rows.select("sample", "chrom", "pos", F.col("alt").alias("base")), genes, two)
    assert _rows(held.select("gene", "sample", "pos", "base")) == [("x", "g1", 4, "C")]
    assert p.variants_of(rows, genes.where("chrom = '7'")).count() == 0
    sequences = spark.createDataFrame([("x", "AAAAAAAAAA", 0)], "gene string, dna string, offset int")
    own = p.germline_sequences(sequences, held)
    assert _rows(own) == [("g1", "x", "AAAACAAAAA", 0)]
    cds = spark.createDataFrame([("x", "t", "+", 1, 7, 0, 1)], "gene string, tx string, strand string, left int, right int, phase int, line int")
    assert _rows(a.background_peptides(cds, own)) == [("g1", "x", "t", "KQ")] and _rows(a.background_peptides(cds, sequences)) == [("x", "t", "KK")]


def test_lists_and_tables(spark, tmp_path):
    assert _rows(r.known_kmers(spark, _file(tmp_path / "k.csv", "AIA\nALA\n CC\n"))) == [("ALA",), ("CC",)]
    assert r.sample_list(spark, _file(tmp_path / "s.csv", "S-1\nS.2\n")) == ["S1", "S2"]
    assert _rows(r.gene_list(spark, _file(tmp_path / "g.csv", "g1\ng1\n\n g2\n"))) == [("g1",), ("g2",)]
    meta = _file(tmp_path / "meta.tsv", "peptide\tid\nAA\t1\nAA\t1\n\t2\n")
    assert _rows(r.metadata_table(spark, meta)) == [("AA", "1")] and r.parts_of(spark, meta).count() == 3
    tsv = _file(tmp_path / "ext.tsv", "kmer\tn\nAA\t1\nAA\t2\n")
    spark.createDataFrame([("BB",), (None,)], "kmer string").write.parquet(str(tmp_path / "ext.parquet"))
    assert _rows(r.external_kmers(spark, tsv)) == [("AA",)] and _rows(r.external_kmers(spark, str(tmp_path / "ext.parquet"))) == [("BB",)]
    fasta = _file(tmp_path / "old.fa", ">g1_10_21_30_41\nMAKE\nIT\n>g2_1_2_x_4\nMM\n")
    assert _rows(r.junction_fasta(spark, fasta)) == [("g1", [10, 20, 30, 40], "MAKEIT"), ("g2", [1, 1, None, 3], "MM")]
    assert _rows(r.fasta_kmers(spark, fasta, 5)) == [("g1_10_21_30_41", "AKEIT"), ("g1_10_21_30_41", "MAKEI")]
    assert _rows(r.fasta_entries(spark, fasta)) == [("g1_10_21_30_41", "MAKEIT"), ("g2_1_2_x_4", "MM")]
    assert _rows(r.junction_whitelist(spark, _file(tmp_path / "w.tsv", "1\t5:9:+\n1\t5:9:+\n"))) == [("1", "+", 5, 9)]
    sizes = _file(tmp_path / "lib.tsv", "sample\tlibsize_75percent\tlibsize_total_count\nS-1\t10\t1\nS2\t30\t1\nS3\t99\t1\n")
    assert _rows(r.library_divisors(spark, sizes, ["S1", "S2"])) == [(0, 0.5), (1, 1.5)]
    with pytest.raises(ValueError, match="without a library size"):
        r.library_divisors(spark, sizes, ["S1", "S9"])
    matches = r.spectrum_matches(spark, _file(tmp_path / "psm.tsv", "peptide\tn_db\tpvalue\tconfident\nAA\t0\t0.001\tYes\n"))
    assert _rows(matches) == [("AA", 0, 0.001, "Yes")]


def test_graph_tables_and_count_store(spark, tmp_path):
    put = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
    for name, schema in r.GRAPH_TABLES.items():
        put([], schema, name)
    put([(0, "g", "1", "+", 0, 9, 2)], r.GRAPH_TABLES["genes"], "genes")
    put([(0, "S-1"), (1, "S2")], "pos int, sample string", "samples")
    put([("g", 0, [1.0, 2.0])], r.COUNT_TABLES["segment_counts"], "segment_counts")
    put([("g", 5, 9, [1.0, 2.0])], r.COUNT_TABLES["edge_counts"], "edge_counts")
    graph = r.graph_tables(spark, str(tmp_path))
    assert set(graph) == {"genes", "vertices", "edges", "segments", "seg_edges"} and graph["genes"].count() == 1
    counts, names = r.count_store(spark, str(tmp_path), graph)
    assert names == ["S1", "S2"] and counts["edge_counts"].first().counts == [1.0, 2.0]
    for rows, problem in (([("g", 0, [1.0])], "length"), ([("g", 0, [1.0, 2.0])] * 2, "repeated"), ([("h", 0, [1.0, 2.0])], "unknown genes")):
        put(rows, r.COUNT_TABLES["segment_counts"], "segment_counts")
        spark.catalog.clearCache()
        with pytest.raises(q.InputError, match=problem):
            r.count_store(spark, str(tmp_path), graph)
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        assert r.sample_positions(names, ["S-2", "cohort", "S9"]) == {"S-2": 1}
        assert len(said) == 1 and "S9" in str(said[0].message)


def test_inputs_that_do_not_fit(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    genes, cds, tx = df([("g", "1")], "gene string, chrom string"), df([("1", "t")], "chrom string, tx string"), df([("g", "t")], "gene string, tx string")
    seqs, variants = df([("1",)], "chrom string"), df([("a", "1")], "sample string, chrom string")
    q.check_inputs(cds, tx, genes, seqs, variants, df([("a",)], "sample string"))
    for bad, problem in (
        ((cds, tx.union(tx), genes, seqs), "transcripts repeated"),
        ((cds, tx, genes.limit(0), seqs), "no genes"),
        ((cds, tx, genes.withColumn("chrom", F.lit("chr1")), seqs), "genes without sequence"),
        ((cds, tx, genes, seqs, variants.withColumn("chrom", F.lit("chr1"))), "otherwise"),
        ((cds, tx, genes, seqs, variants, df([("b",)], "sample string")), "samples without variants"),
    ):
        with pytest.raises(q.InputError, match=problem):
            q.check_inputs(*bad)


def test_chosen_genes(spark):
    genes = spark.createDataFrame([(k, f"g{k}", "1" if k % 2 else "2", k) for k in range(6)], "gene_idx int, gene string, chrom string, n_vertices int")
    name = lambda **k: sorted(x.gene for x in p.chosen_genes(genes, **k).collect())
    listed = spark.createDataFrame([("g3",), ("g9",), ("g4",)], "gene string")
    assert name(offset=2, number=2) == ["g2", "g3"] and name(names=listed) == ["g3", "g4"] and name(chromosomes=["1"], most_vertices=3) == ["g1", "g3"]
    assert name(transcripts=listed, cds=listed.where("gene = 'g3'")) == ["g3"]
    with pytest.raises(q.InputError, match="no genes"):
        name(offset=6)


def test_stages_names_and_reports(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(len(made))

    folder = str(tmp_path / "stages")
    for threshold, n in ((1, 1), (1, 1), (2, 2), (None, 3)):
        assert sinks.stage_table(make, folder, spark, "support", threshold=threshold, cohort="a/b").count() == n
    assert len(made) == 3
    assert sinks.output_path("/x/", "kmers", b=None, a="p q") == "/x/kmers_a-p-q_b-none.tsv.gz"
    path = str(tmp_path / "report")
    sinks.append_counts(c.step_counts({"all": spark.range(5), "some": spark.range(2)}), path, sample="S1", at_least=None)
    sinks.append_counts(c.step_counts({"all": spark.range(4), "known": spark.range(1)}), path, sample="S2", at_least=3)
    report = sinks.counts_report(spark, path)
    assert report.columns[:3] == ["at_least", "sample", "all"] and sorted(report.columns[3:]) == ["known", "some"]
    assert _rows(report.select("sample", "at_least", "all", "some", "known")) == [("S1", None, 5, 2, None), ("S2", "3", 4, None, 1)]
    long = spark.createDataFrame([("g", 0, 1.5), ("g", 1, 2.0), ("h", 1, 4.0)], "gene string, pos int, expr double")
    table = sinks.expression_table(long, ["S1", "S2"])
    assert table.columns == ["gene", "S1", "S2"] and _rows(table) == [("g", 1.5, 2.0), ("h", 0.0, 4.0)]
    sizes = e.library_size(long)
    assert _rows(e.updated_sizes(sizes, sizes.where("pos = 1").withColumn("libsize_total_count", F.lit(9.0))).select("pos", "libsize_total_count")) == [(0, 1.5), (1, 9.0)]


def test_normals_counts_and_the_rules_of_a_result(spark):
    m = spark.createDataFrame([("a", [5.0, 5.0, 0.0]), ("a", [0.0, 9.0, 0.0]), ("b", [5.0, 0.0, 7.0]), ("d", [5.0, 5.0, 0.0])], "kmer string, expr array<double>")
    assert c.combined_normals(None, None) is None and c.combined_normals(m, None) is m and c.combined_normals(m, m).count() == 8
    counts = c.support_counts(m, [0, 1, 2], 5, 0)
    assert _rows(counts) == [("a", 1), ("b", 1), ("d", 1)] and _rows(c.recurrent(counts, 2)) == []
    out = c.cohort_filter(m, m, [0, 1], [2], 0, 5, 5, 1, 6.0, None)
    assert _rows(out.select("kmer")) == []  # no normal sample expresses a or d, so they are of the annotation
    normal = m.where("kmer = 'b'")
    out = c.cohort_filter(m, normal, [0, 1], [2], 0, 5, 5, 1, 6.0, None)
    assert {x.kmer for x in out.collect()} == {"a", "d"}
    assert c.failing(out, m, normal, [0, 1], [2], 0, 5, 5, 1, 6.0, None).count() == 0
    wrong = spark.createDataFrame([("b",), ("z",), ("a",)], "kmer string")
    assert _rows(c.failing(wrong, m, normal, [0, 1], [2], 0, 5, 5, 1, 6.0, None)) == [("b", "cohort"), ("z", "sample")]
    assert _rows(c.failing(wrong, m, normal, [0, 1], [2], 0, 5, 0, 0, 6.0, None)) == [("b", "normal"), ("z", "sample")]


def test_backgrounds_details_and_spans(spark):
    rows = spark.createDataFrame([("a", [0.0, 1.0], True), ("b", [0.0, 0.0], False), (None, [1.0, 1.0], True)], "kmer string, expr array<double>, isCrossJunction boolean")
    assert _rows(sp.background_rows(rows)) == [("a",), ("b",)] and _rows(sp.background_rows(rows, expressed=True)) == [("a",)] and _rows(sp.background_rows(rows, cross=False)) == [("b",)]
    details = sp.kmer_details(spark.createDataFrame([("a", "x", 1.0), ("a", "y", 5.0), ("b", "x", 2.0)], "kmer string, location string, expr double"))
    assert [x.kmer for x in sp.details_above(details, 2.0).collect()] == ["a"]
    at = spark.createDataFrame([(1,), (2,), (3,)], "pos int")
    assert [x.pos for x in at.where(s.inside_open(F.col("pos"), F.lit(1), F.lit(3))).collect()] == [2]
    assert [s.mutation_mode(*x) for x in ((0, 0), (1, 0), (0, 1), (1, 1))] == ["ref", "germline", "somatic", "somatic_and_germline"]
    pair = spark.createDataFrame([("MAKE", "KEIT", 0, 6), ("MAKE", "KEIT", 0, 7)], "f string, b string, x int, y int")
    assert [x[0] for x in pair.select(s.overlap_joined(F.col("f"), F.col("b"), F.col("x"), F.col("y"))).collect()] == ["MAKEIT", None]
    leq = spark.createDataFrame([("+", 1, 2), ("-", 1, 2)], "strand string, a int, b int")
    assert [x[0] for x in leq.select(s.strand_leq(F.col("strand"), F.col("a"), F.col("b"))).collect()] == [True, False]


def test_stream_of_matrix_rows(spark, tmp_path):
    schema = "kmer string, junctionAnnotated boolean, readFrameAnnotated boolean, expr array<double>"
    spark.createDataFrame([("a", False, True, [5.0]), ("b", False, True, [5.0]), ("c", True, True, [5.0]), ("d", False, True, [1.0]), ("I", False, True, [9.0])], schema).write.parquet(str(tmp_path / "in"))
    background, known = spark.createDataFrame([("b",)], "kmer string"), spark.createDataFrame([("L",)], "kmer string")
    out = stream_filter(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), background, 0, 5.0, known)
    job = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    job.awaitTermination(120)
    assert [x.kmer for x in spark.read.parquet(str(tmp_path / "out")).collect()] == ["a"]


def _graph(spark):
    vertices = spark.createDataFrame([("g", 1, 0, 8, "+"), ("g", 2, 12, 15, "+"), ("g", 3, 20, 27, "+"), ("h", 1, 20, 27, "-"), ("h", 2, 12, 15, "-"), ("h", 3, 0, 8, "-")], "gene string, v int, start int, stop int, strand string")
    edges = spark.createDataFrame([(x, 1, 2) for x in "gh"] + [(x, 2, 3) for x in "gh"], "gene string, src int, dst int")
    dna = "AATGGCCA" + "TTTT" + "GCT" + "TTTTT" + "TGGAAGG"
    return vertices, edges, spark.createDataFrame([("g", dna, 0), ("h", dna[::-1].translate(str.maketrans("ACGT", "TGCA")), 0)], "gene string, dna string, offset int")


def test_triples_single_exons_and_their_kmers(spark):
    vertices, edges, sequences = _graph(spark)
    frames = spark.createDataFrame([("g", 1, 1, True), ("g", 3, 0, False), ("h", 3, 0, False)], "gene string, v int, phase int, annotated boolean")
    triples = spark.createDataFrame([("g", 1, 2, 3, 1)], "gene string, v1 int, v2 int, v3 int, phase int")
    rows = p.modified_pairs(p.as_triples(triples, frames), vertices)
    assert [tuple(x) for x in rows.first().parts] == [(1, 8), (12, 15), (20, 25)] or [tuple(x) for x in rows.first().parts] == [(1, 8), (12, 15), (20, 27)]
    found = p.reference_peptides(rows, sequences)
    assert found.first().peptide == "MASLE" and found.first().isIsolated == 0
    kmers = p.peptide_kmers(found, 5)
    assert kmers.first().coord == "1:8:12:15:20:25" and p.kmer_junctions(kmers).count() == 2
    assert p.peptide_metadata(found, spark.createDataFrame([("g", "1")], "gene string, chrom string"), "ref", kmer_type="3-exons").first().id == "g:1_2_3:0:1:3-exons"
    single = p.isolated_exons(frames, edges)
    assert _rows(single.select("gene", "v")) == [("g", 3), ("h", 3)]
    alone = p.reference_peptides(p.modified_pairs(single, vertices), sequences)
    assert {x.gene: (x.peptide, x.isIsolated) for x in alone.collect()}["g"] == ("WK", 1)


def test_matrices_with_expression_and_flags(spark):
    vertices, edges, sequences = _graph(spark)
    pairs = spark.createDataFrame([("g", 1, 2, 1, True)], "gene string, v int, w int, phase int, annotated boolean")
    found = p.reference_peptides(p.modified_pairs(pairs, vertices), sequences)
    segments = spark.createDataFrame([("g", 0, 4, [1.0, 0.0]), ("g", 4, 8, [3.0, 2.0]), ("g", 12, 15, [9.0, 9.0])], "gene string, seg_start int, seg_stop int, counts array<double>")
    crossing = spark.createDataFrame([("g", 8, 12, [4.0, 6.0])], "gene string, left_stop int, right_start int, counts array<double>")
    known = spark.createDataFrame([("g", 8, 12)], "gene string, a int, b int")
    segment, junction = p.kmer_matrices(found, 2, segments, crossing, known)
    assert _rows(segment.select("kmer", "coord", "junctionAnnotated", "readFrameAnnotated", "expr")) == [("MA", "1:7:nan:nan:None:None", False, True, [2.0, 1.0])]
    assert _rows(junction.select("kmer", "junctionAnnotated", "expr")) == [("AS", True, [4.0, 6.0])]
    left = p.kmer_matrices(found, 2, segments, crossing.limit(0), known.limit(0), spark.createDataFrame([("MA",)], "kmer string"))
    assert left[0].count() == 0 and _rows(left[1].select("kmer", "junctionAnnotated", "expr")) == [("AS", False, None)]
    listed = p.junction_listed(p.modified_pairs(pairs, vertices).withColumn("chrom", F.lit("1")), spark.createDataFrame([("1", "+", 8, 12)], "chrom string, strand string, a int, b int"))
    assert _rows(listed) == [("g", 1, 2, 1)]


def test_variants_with_the_count_of_their_segment(spark):
    vertices, edges, sequences = _graph(spark)
    segments = spark.createDataFrame([("g", 0, 0, 8, [5.0, 7.0]), ("g", 1, 12, 15, [1.0, 2.0])], "gene string, seg_id int, seg_start int, seg_stop int, counts array<double>")
    variants = spark.createDataFrame([("g", "s", 2, "C"), ("g", "s", 13, "A"), ("g", "t", 2, "C")], "gene string, sample string, pos int, base string")
    counted = e.variant_counts(variants, segments, {"s": 1})
    assert _rows(counted.select("sample", "pos", "count")) == [("s", 13, 2.0), ("s", 2, 7.0), ("t", 2, None)]
    pairs = spark.createDataFrame([("g", 1, 2, 1, True)], "gene string, v int, w int, phase int, annotated boolean")
    found = p.mutated_peptides(p.modified_pairs(pairs, vertices), sequences, counted, force=True)
    assert {(x.sample, x.variantComb): x.variantSegExpr for x in found.collect()} == {("s", "2"): "7.0", ("s", "13"): "2.0", ("s", "2;13"): "7.0;2.0", ("t", "2"): "nan"}
    meta = p.peptide_metadata(found, spark.createDataFrame([("g", "1")], "gene string, chrom string"), "somatic")
    assert len(meta.columns) == 17 and {x.variantSegExpr for x in meta.collect()} == {"7.0", "2.0", "7.0;2.0", "nan"}


def test_order_successors_and_stops_of_all_combinations(spark):
    vertices, edges, _ = _graph(spark)
    assert _rows(g.vertex_order(vertices).select("gene", "v", "place")) == [("g", 1, 0), ("g", 2, 1), ("g", 3, 2), ("h", 1, 0), ("h", 2, 1), ("h", 3, 2)]
    assert _rows(g.successors(vertices, edges)) == sorted([(x, a, b) for x in "gh" for a, b in ((1, 2), (2, 3), (3, None))], key=str)
    steps = spark.createDataFrame([("g", 1, 2, 0, True), ("g", 1, 2, 0, False), ("g", 2, 3, 0, True), ("g", 2, 3, 0, True)], "gene string, v int, w int, phase int, has_stop boolean")
    assert _rows(g.stop_in_all(steps)) == [("g", 1, 2, 0, False), ("g", 2, 3, 0, True)]
    matrix = spark.createDataFrame([("g", 0, [0, 1, 1]), ("g", 1, [1, 0, 1]), ("g", 2, [1, 1, 0])], "gene string, src int, row array<int>")
    assert _rows(g.edge_list(matrix)) == [("g", 0, 1), ("g", 0, 2), ("g", 1, 2)]
    wide = spark.createDataFrame([("g", 1, 0, 8, "+"), ("g", 2, 2, 8, "+"), ("g", 3, 12, 15, "+")], "gene string, v int, start int, stop int, strand string")
    pairs = spark.createDataFrame([("g", 1, 3, 0), ("g", 2, 3, 0)], "gene string, v int, w int, phase int")
    assert _rows(g.without_redundant(pairs, wide)) == [("g", 1, 3, 0)]


def test_the_same_transcript_in_three_formats(spark, tmp_path):
    """A public annotation record: the formats number its end otherwise, and name genes and transcripts by other keys."""
    head = "chr1\tHAVANA\tCDS\t69091\t{end}\t.\t+\t0\t"
    shown = {
        "a.gtf": (70005, 'gene_id "ENSG00000186092.4"; transcript_id "ENST00000335137.3"; level 2;', "ENST00000335137.3"),
        "b.gff": (70006, "Parent=ENST00000335137.3;geneID=ENSG00000186092.4", "ENST00000335137.3"),
        "c.gff3": (70008, "ID=CDS:1;Parent=ENST00000335137.4;gene_id=ENSG00000186092.6;transcript_id=ENST00000335137.4", "ENST00000335137.4"),
    }
    for name, (end, text, tx) in shown.items():
        cds = a.coding_pieces(r.annotation_lines(spark, _file(tmp_path / name, head.format(end=end) + text + "\n")))
        assert _rows(cds.select("tx", "left", "right", "phase")) == [(tx, 69090, end, 0)]
