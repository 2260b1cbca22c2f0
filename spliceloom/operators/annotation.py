"""Transcripts, coding pieces and junctions from annotation tables.

cds: gene, tx, strand, left, right, phase, line (order in the file).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spliceloom.functions.seq import attributes, kmers, minus, with_residues


def coding_pieces(lines: DataFrame) -> DataFrame:
    """CDS rows of annotation lines (chrom, feature, start, end, strand, phase, attributes, line), 0-based half-open."""
    rows = lines.where("feature = 'CDS'").withColumn("a", attributes(F.col("attributes")))
    tx = F.coalesce(F.col("a")["transcript_id"], F.col("a")["Parent"])
    gene = F.coalesce(F.col("a")["gene_id"], F.col("a")["geneID"])
    return rows.select("chrom", gene.alias("gene"), tx.alias("tx"), "strand", (F.col("start") - 1).alias("left"), F.col("end").alias("right"), F.coalesce(F.col("phase").try_cast("int"), F.lit(0)).alias("phase"), "line")


def transcript_genes(lines: DataFrame) -> DataFrame:
    """gene and transcript of transcript and mRNA lines."""
    rows = lines.where("feature in ('transcript', 'mRNA')").withColumn("a", attributes(F.col("attributes")))
    return rows.select(F.coalesce(F.col("a")["gene_id"], F.col("a")["geneID"]).alias("gene"), F.coalesce(F.col("a")["transcript_id"], F.col("a")["ID"]).alias("tx")).distinct()


def first_cds(cds: DataFrame) -> DataFrame:
    """The first piece in reading order of each transcript: least left on plus, greatest right on minus; the later line on ties."""
    order = F.when(F.col("strand") == "+", -F.col("left")).otherwise(F.col("right"))
    best = F.max(F.struct(order.alias("o"), "line", "gene", "strand", "left", "right", "phase")).alias("b")
    return cds.groupBy("tx").agg(best).select("tx", "b.gene", "b.strand", "b.left", "b.right", "b.phase")


def annotated_junctions(cds: DataFrame) -> DataFrame:
    """Distinct introns (gene, a, b) between consecutive pieces of a transcript."""
    follow = F.lead("left").over(Window.partitionBy("tx").orderBy("left", "line"))
    return cds.select("gene", F.col("right").alias("a"), follow.alias("b")).where("b is not null").distinct()


def gene_transcripts(cds: DataFrame) -> DataFrame:
    """Genes with their coding transcripts in order."""
    return cds.groupBy("gene").agg(F.array_sort(F.collect_set("tx")).alias("transcripts"))


def background_peptides(cds: DataFrame, sequences: DataFrame) -> DataFrame:
    """tx, gene and peptide of each transcript, from sequences (gene, dna, offset): pieces joined in reading order.

    Germline sequences, which have a column sample, give each sample's own. The phase moves the start of the first piece only; on the minus strand the joined bases are read backwards.
    Peptides come dealt out by gene, so that repeated ones, and what follows by gene, need no other shuffle.
    """
    pieces = F.array_sort(F.collect_list(F.struct("left", "line", "right", "phase"))).alias("pieces")
    rows = cds.groupBy("gene", "tx", "strand").agg(pieces).join(sequences.hint("merge"), "gene")
    joined = F.array_join(F.transform("pieces", lambda p: F.substring(F.col("dna"), (p.left - F.col("offset") + 1).cast("int"), (p.right - p.left).cast("int"))), "")
    lead = F.when(F.col("strand") == "+", F.element_at("pieces", 1).phase).otherwise(F.element_at("pieces", -1).phase)
    back = minus(F.col("strand"))
    whole, first = F.col("whole"), F.col("first").cast("int")
    coding = F.when(back, F.substring(whole, F.lit(1), F.greatest(F.length(whole) - first, F.lit(0)))).otherwise(F.substring(whole, first + 1, F.length(whole)))
    owner = ["sample"] if "sample" in sequences.columns else []
    rows = rows.select(*owner, "gene", "tx", "strand", joined.alias("whole"), lead.alias("first"))
    rows = with_residues(rows.select(*owner, "gene", "tx", "strand", coding.alias("coding")), "residues", F.col("coding"), back)
    return rows.select(*owner, "gene", "tx", F.substring_index("residues", "_", 1).alias("peptide")).where("peptide != ''").repartition("gene").distinct()


def background_kmers(peptides: DataFrame, k: int) -> DataFrame:
    """Distinct k-mers of peptides, each peptide tiled once however many transcripts or samples have it."""
    return peptides.select("peptide").distinct().select(F.explode(kmers(F.col("peptide"), k)).alias("kmer")).distinct()
