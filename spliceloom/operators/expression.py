"""Expression of genes, segments and junctions, library sizes, and variants placed on exons and segments.

Counts are arrays, a value per sample position; they stay arrays through joins and sums.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spliceloom.operators.variants import last_segment, overlapping, within


def gene_expression(segments: DataFrame) -> DataFrame:
    """gene, pos and the sum of length times count over segments (gene, start, stop, counts)."""
    rows = segments.select("gene", (F.col("stop") - F.col("start")).alias("n"), F.posexplode("counts").alias("pos", "x"))
    return rows.groupBy("gene", "pos").agg(F.sum(F.col("n") * F.col("x")).alias("expr"))


def library_size(genes: DataFrame) -> DataFrame:
    """pos with the interpolated upper quartile and the sum of its genes' expression (gene, pos, expr)."""
    return genes.groupBy("pos").agg(F.percentile("expr", 0.75).alias("libsize_75percent"), F.sum("expr").alias("libsize_total_count"))


def divisors(sizes: DataFrame, normalizer: float | None = None) -> DataFrame:
    """pos and divisor: the quartile over normalizer, or over the median quartile."""
    if normalizer:
        return sizes.select("pos", (F.col("libsize_75percent") / normalizer).alias("divisor"))
    middle = sizes.agg(F.median("libsize_75percent").alias("__m"))
    return sizes.join(F.broadcast(middle)).select("pos", (F.col("libsize_75percent") / F.col("__m")).alias("divisor"))  # middle is one row


def size_factors(sizes: DataFrame) -> DataFrame:
    """pos and the median quartile over its own."""
    return divisors(sizes).select("pos", (1 / F.col("divisor")).alias("factor"))


def updated_sizes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Library sizes with new samples in place of old ones."""
    return old.join(new.select("pos"), "pos", "left_anti").unionByName(new)


def segment_expression(pieces: DataFrame, segments: DataFrame, k: int) -> DataFrame:
    """Mean count over a k-mer's bases: pieces (gene, id, start, stop) over segments (gene, seg_start, seg_stop, counts), as gene, id and expr, a value per sample.

    A k-mer has 3k bases, so it lies on few segments; their counts are added as arrays, each weighed by its bases.
    """
    near = overlapping(pieces, segments, ["gene"], ("start", "stop"), ("seg_start", "seg_stop"))
    n = (F.least("stop", "seg_stop") - F.greatest("start", "seg_start")).cast("double")
    held = near.groupBy("gene", "id").agg(F.collect_list(F.struct(n.alias("n"), F.col("counts").cast("array<double>").alias("counts"))).alias("held"))
    return held.select("gene", "id", mean_counts(F.col("held"), k).alias("expr"))


def mean_counts(held: Column, k: int) -> Column:
    """The counts of held (an array of n, the bases, and counts), weighed by bases, over the 3k bases of a k-mer; null of none."""
    first = F.get(held, F.lit(0))
    rounded = lambda x: F.when(x == F.rint(x), x).otherwise(F.bround(x, 2))  # noqa: E731, whole numbers at once
    none = F.transform(first["counts"], lambda _: F.lit(0.0))
    total = F.aggregate(held, none, lambda acc, h: F.zip_with(acc, h.counts, lambda x, y: x + h.n * y))
    one = F.transform(first["counts"], lambda y: rounded((0.0 + first["n"] * y) / (3 * k)))
    return F.when(F.size(held) == 1, one).otherwise(F.transform(total, lambda x: rounded(x / (3 * k))))


def least_counts(held: Column) -> Column:
    """The least of the counts of held, an array of arrays, by sample; null of none."""
    return F.aggregate(F.slice(held, 2, F.size(held)), F.get(held, F.lit(0)), lambda acc, c: F.zip_with(acc, c, lambda x, y: F.least(x, y)))


def junction_expression(crossed: DataFrame, edge_counts: DataFrame) -> DataFrame:
    """Least count over the junctions (gene, id, left_stop, right_start) that a k-mer crosses, as gene, id and expr, a value per sample.

    A junction without counts does not count; a k-mer with none that has any is left out.
    """
    rows = crossed.join(edge_counts.where("counts is not null"), ["gene", "left_stop", "right_start"])
    held = rows.groupBy("gene", "id").agg(F.collect_list(F.col("counts").cast("array<double>")).alias("held"))
    return held.select("gene", "id", least_counts(F.col("held")).alias("expr"))


def junctions_annotated(crossed: DataFrame, known: DataFrame) -> DataFrame:
    """Per k-mer, whether any of its junctions is annotated (known: gene, a, b)."""
    held = known.select("gene", F.col("a").alias("left_stop"), F.col("b").alias("right_start"), F.lit(True).alias("held")).distinct()
    rows = crossed.join(held, ["gene", "left_stop", "right_start"], "left")
    return rows.groupBy("gene", "id").agg(F.bool_or(F.coalesce("held", F.lit(False))).alias("junctionAnnotated"))


def variants_in_exons(exons: DataFrame, variants: DataFrame) -> DataFrame:
    """Variants (gene, sample, pos, ...) inside exons (gene, v, start, stop)."""
    return within(exons, variants, ["gene"])


def variant_segment(variants: DataFrame, segments: DataFrame) -> DataFrame:
    """Each place of a sample's variants with the last segment that starts at or before it and does not end before it."""
    placed = last_segment(variants.select("gene", "sample", "pos"), segments.select("gene", "seg_start", "seg_stop", "seg_id"))
    return placed.where("pos <= segment.seg_stop").select("gene", "sample", "pos", "segment.seg_id").dropDuplicates(["gene", "sample", "pos"])


def variant_counts(variants: DataFrame, segments: DataFrame, positions: dict[str, int]) -> DataFrame:
    """Variants with the count, in their sample, of the segment they stand in; null outside of segments and for other samples.

    positions tells each sample's place in the counts of segments (gene, seg_start, seg_stop, seg_id, counts).
    """
    at = F.from_json(F.lit(json.dumps(positions)), "map<string,int>")
    placed = last_segment(variants, segments.select("gene", "seg_start", "seg_stop", "seg_id", "counts"))
    held = F.when(F.col("pos") <= F.col("segment.seg_stop"), F.get(F.col("segment.counts"), at[F.col("sample")]))
    return placed.withColumn("count", held).drop("segment")


def last_variants(variants: DataFrame) -> DataFrame:
    """The later line of each (sample, chrom, pos)."""
    held = F.max(F.struct("line", "ref", "alt")).alias("b")
    return variants.groupBy("sample", "chrom", "pos").agg(held).select("sample", "chrom", "pos", "b.ref", "b.alt")


def single_base(variants: DataFrame) -> DataFrame:
    return variants.where("length(ref) = 1 and length(alt) = 1")


def numbered(peptides: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Running number of each emitted peptide within its pair, from 0."""
    return peptides.withColumn("variant_no", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
