"""Readers and sinks on small files."""

import pytest
from pyspark.sql import functions as F

from spliceloom.operators import annotation as a
from spliceloom.sources import readers as r
from spliceloom.sources import sinks


def test_matrix_round_trip_and_nan(spark, tmp_path):
    path = str(tmp_path / "m.tsv")
    with open(path, "w") as f:
        f.write("kmer\tcoord\tjunctionAnnotated\treadFrameAnnotated\tS-1\tS.2\nAAA\t1:2:nan:nan:None:None\tTrue\tFalse\t1.5\tnan\nBBB\t\tFalse\tTrue\t\t3\n")
    df, names = r.kmer_matrix(spark, path)
    assert names == ["S1", "S2"] and r.positions(names, ["S_2"]) == [1]
    assert {x.kmer: x.expr for x in df.collect()} == {"AAA": [1.5, 0.0], "BBB": [0.0, 3.0]}
    sinks.write_table(sinks.wide(df, names), str(tmp_path / "out.parquet"), "parquet")
    again, _ = r.kmer_matrix(spark, str(tmp_path / "out.parquet"))
    assert sorted(map(str, again.collect())) == sorted(map(str, df.collect()))
    with pytest.raises(ValueError, match="not in the matrix"):
        r.positions(names, ["S3"])


def test_annotation_genome_and_background(spark, tmp_path):
    gtf, fasta = str(tmp_path / "a.gtf"), str(tmp_path / "g.fa")
    with open(gtf, "w") as f:
        f.write("#c\n")
        for feature, start, end in (("transcript", 1, 30), ("CDS", 1, 6), ("CDS", 13, 18)):
            f.write(f'1\tx\t{feature}\t{start}\t{end}\t.\t+\t0\tgene_id "g"; transcript_id "t";\n')
    with open(fasta, "w") as f:
        f.write("> 1 first\nATGGCCAAAAAA\nGATTGGTTTTTT\n>2\nAC\n")
    lines = r.annotation_lines(spark, gtf)
    cds = a.coding_pieces(lines)
    assert [(x.gene, x.tx, x.left, x.right) for x in cds.orderBy("left").collect()] == [("g", "t", 0, 6), ("g", "t", 12, 18)]
    assert a.transcript_genes(lines).collect() == [("g", "t")]
    chunks = r.genome_chunks(r.genome(spark, fasta), 5)
    genes = spark.createDataFrame([("g", "1", 0, 24)], "gene string, chrom string, start int, stop int")
    sequences = r.gene_sequences(genes, chunks, 5)
    assert sequences.first().dna == "ATGGCCAAAAAAGATTGGTTTTTT"
    assert a.background_peptides(cds, sequences).first().peptide == "MADW"
    assert a.annotated_junctions(cds).collect() == [("g", 6, 12)]


def test_variant_files(spark, tmp_path):
    vcf, maf = str(tmp_path / "v.vcf"), str(tmp_path / "v.maf")
    with open(vcf, "w") as f:
        f.write("##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB\n1\t10\t.\tA\tG\t.\t.\t.\tGT\t0|1:3\t0|0\n1\t12\t.\tAC\tGT\t.\t.\t.\tGT\t1|1\t1|1\n")
    with open(maf, "w") as f:
        f.write("Chromosome\tStart_Position\tStrand\tVariant_Classification\tVariant_Type\tReference_Allele\tTumor_Seq_Allele2\tTumor_Sample_Barcode\nX\t38\t+\tx\tSNP\tA\tG\ts1\nX\t39\t+\tx\tINS\tA\tGG\ts1\n")
    assert [(x.sample, x.chrom, x.pos, x.ref, x.alt) for x in r.variants(spark, vcf, "germline").collect()] == [("A", "1", 9, "A", "G"), *[(n, "1", k, *b) for n in "AB" for k, b in ((11, "AG"), (12, "CT"))]]
    assert [(x.sample, x.chrom, x.pos, x.ref, x.alt) for x in r.variants(spark, maf, "somatic").collect()] == [("s1", "X", 37, "A", "G")]
    with pytest.raises(ValueError, match="read from"):
        r.variants(spark, "x.bed", "germline")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("id1", "MAD", ["a", None, "b"])], "id string, peptide string, parts array<string>")
    assert sinks.list_text(df).first().parts == "a;b"
    sinks.write_fasta(df, "id", "peptide", str(tmp_path / "f"))
    assert [x.value for x in spark.read.text(str(tmp_path / "f")).collect()] == [">id1", "MAD"]
    calls = []
    make = lambda: calls.append(1) or df.select(F.lit(1).alias("x"))
    for _ in range(2):
        assert sinks.stage_table(make, str(tmp_path / "stage"), spark).count() == 1
    assert len(calls) == 1
