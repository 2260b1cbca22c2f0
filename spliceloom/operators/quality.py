"""Checks of inputs and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spliceloom.functions.seq import minus, with_residues, with_variants


def roundtrip(kmers: DataFrame, sequences: DataFrame | None = None) -> DataFrame:
    """Per gene, how many k-mers (gene, kmer, parts in reading order, strand) there are and how many their bases don't give.

    K-mers with a column variants (an array of pos and base) are held against bases with these put in, so that each is translated again
    under its own combination. sequences may be those of samples, with a column sample. Without sequences k-mers have bases, an
    array of those of their parts, cut from the plus strand where the k-mers are, and are not moved.
    """
    back = minus(F.col("strand"))
    if sequences is None:
        rows, pieces = kmers, F.when(back, F.reverse("bases")).otherwise(F.col("bases"))
    else:
        rows = kmers.join(sequences.hint("merge"), ["gene", "sample"] if "sample" in sequences.columns else "gene")
        pieces = F.transform(F.when(back, F.reverse("parts")).otherwise(F.col("parts")), lambda p: _cut_out(p, "variants" in kmers.columns))
    wrong = (~F.col("__read").eqNullSafe(F.col("kmer"))).cast("long")
    read = F.array_join(pieces, "")  # of the plus strand
    return with_residues(rows, "__read", read, back).groupBy("gene").agg(F.count("*").alias("n_kmers"), F.sum(wrong).alias("n_mismatch"))


def _cut_out(p: Column, variants: bool) -> Column:
    """The bases of a part from columns dna and offset, with those of variants put in."""
    bases = F.substring(F.col("dna"), (p.start - F.col("offset") + 1).cast("int"), (p.stop - p.start).cast("int"))
    return with_variants(bases, p.start, F.col("variants")) if variants else bases


class InputError(ValueError):
    """Inputs that don't fit together."""


def check(**problems: DataFrame) -> None:
    """Raise for the first named DataFrame of offending rows that has any, with a few of them."""
    for name, rows in problems.items():
        found = rows.limit(5).collect()
        if found:
            raise InputError(f"{name}: {', '.join(map(str, map(tuple, found)))}")


def missing(rows: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Values of column that known lacks."""
    return rows.select(column).distinct().join(known.select(column), column, "left_anti")


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that stand in more than one row.

    Most stand once, so they are dealt out before they are counted: no task holds those of its part of the input first, and tasks are
    as many as a shuffle has, however small the keys are written.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select(*keys).repartition(tasks, *keys).groupBy(*keys).agg(F.count("*").alias("times")).where("times > 1")


def check_inputs(cds: DataFrame, transcripts: DataFrame, genes: DataFrame, sequences: DataFrame, variants: DataFrame | None = None, samples: DataFrame | None = None) -> None:
    """Raise where inputs don't fit together.

    cds: chrom, tx; transcripts: gene, tx, each once; genes: gene, chrom, at least one; sequences: chrom; variants: sample,
    chrom; samples: sample, each with a variant where variants are given.
    """
    if genes.isEmpty():
        raise InputError("no genes")
    problems = {"transcripts repeated": repeated(transcripts, "tx"), "chromosomes of genes without sequence": missing(genes, sequences, "chrom"), "chromosomes of annotation without sequence": missing(cds, sequences, "chrom")}
    if variants is not None:
        if variants.join(sequences.select("chrom").distinct(), "chrom", "left_semi").isEmpty() and not variants.isEmpty():
            raise InputError("variants name chromosomes otherwise than the sequences")
        if samples is not None:
            problems["samples without variants"] = missing(samples, variants, "sample")
    check(**problems)
