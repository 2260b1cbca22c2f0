"""Novelty against an annotation background, and joins with outside evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spliceloom.functions.seq import junction_keys, kmers
from spliceloom.staging import written


def background_union(*parts: DataFrame) -> DataFrame:
    """Distinct k-mers of several backgrounds."""
    out = parts[0].select("kmer")
    for p in parts[1:]:
        out = out.unionByName(p.select("kmer"))
    return out.where("kmer is not null").distinct()


def background_rows(rows: DataFrame, expressed: bool = False, cross: bool | None = None) -> DataFrame:
    """Distinct k-mers of a background table (kmer, expr, isCrossJunction): with expressed those above 0 in some sample,
    with cross those across junctions, or those within exons."""
    if expressed:
        rows = rows.where(F.exists("expr", lambda x: x > 0))
    if cross is not None:
        rows = rows.where(F.col("isCrossJunction") == cross)
    return rows.where("kmer is not null").select("kmer").distinct()


def novelty_flag(rows: DataFrame, background: DataFrame) -> DataFrame:
    """rows with is_neo_flag: the background lacks the k-mer."""
    held = background.select("kmer", F.lit(True).alias("__held")).distinct()
    return rows.join(held, "kmer", "left").withColumn("is_neo_flag", F.col("__held").isNull()).drop("__held")


def novel(rows: DataFrame, background: DataFrame) -> DataFrame:
    return rows.join(background.select("kmer"), "kmer", "left_anti")


def binding(rows: DataFrame, predictions: DataFrame, score: str, threshold: float, less: bool = True) -> DataFrame:
    """k-mers with their predictions (peptide, ...) whose score is within threshold; several alleles give several rows."""
    joined = rows.join(predictions, rows["kmer"] == predictions["peptide"]).drop("peptide")
    return joined.where(F.col(score) <= threshold if less else F.col(score) >= threshold)


def with_junctions(rows: DataFrame, coord: str) -> DataFrame:
    """rows with the numbers of a coordinate text and the strand and keys of its junctions."""
    # columns of their own, so that a text is split once and not for each key
    names = [f"__c{k}" for k in range(6)]
    rows = rows.withColumns({n: F.get(F.split(coord, ":"), F.lit(k)).try_cast("int") for k, n in enumerate(names)})
    return rows.withColumn("__k", junction_keys([F.col(n) for n in names])).select("*", "__k.strand", "__k.jct1", "__k.jct2").drop("__k", *names)


def junction_peptides(peptides: DataFrame, found: DataFrame, pairwise: bool = False) -> DataFrame:
    """Peptides whose junctions occur among found: each on its own, or as a pair; no second junction meets none.

    The keys found are a table of their own, whose size tells whether peptides have to be shuffled to meet them.
    """
    keys = written(found.select("jct1", "jct2").distinct(), "found")
    if pairwise:
        return peptides.join(keys, (peptides["jct1"] == keys["jct1"]) & peptides["jct2"].eqNullSafe(keys["jct2"]), "left_semi")
    kept = peptides.join(keys.select("jct1"), "jct1", "left_semi")
    second = keys.select("jct2").distinct()
    return kept.join(second, kept["jct2"].eqNullSafe(second["jct2"]), "left_semi")


def containing(peptides: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Peptides that hold any of the k-mers found: tiled and joined by equality."""
    tiles = peptides.select("peptide").distinct().withColumn("kmer", F.explode(kmers(F.col("peptide"), k)))
    return tiles.join(found.select("kmer"), "kmer", "left_semi").select("peptide").distinct()


def spectrum_outcome(matches: DataFrame) -> DataFrame:
    """Matches with the step at which each ends; those without an outcome go.

    step 3: no p-value and better database hits; step 4: p-value above 0.01; step 5: explained by a modification; else pass.
    """
    scored = (F.col("pvalue") < 100) & (F.col("n_db") == 0)
    good = scored & (F.col("pvalue") <= 0.01)
    outcome = (
        F.when((F.col("pvalue") == 100) & (F.col("n_db") > 0), "step 3")
        .when(scored & (F.col("pvalue") > 0.01), "step 4")
        .when(good & (F.col("n_ptm") != 0), "step 5")
        .when(good & (F.col("n_ptm") == 0) & (F.col("confident") == "Yes"), "pass")
    )
    out = matches.withColumn("outcome", outcome).where("outcome is not null")
    late = F.col("outcome").isin("step 5", "pass")
    return out.withColumn("n_ptm", F.when(late, F.col("n_ptm"))).withColumn("pvalue", F.when(F.col("outcome") != "step 3", F.col("pvalue")))


def ranked_matches(matches: DataFrame) -> DataFrame:
    """Confident matches first, then by falling score."""
    return matches.orderBy(F.when(F.col("confident") == "Yes", 0).otherwise(1), F.desc("score"))


def compared(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each k-mer of two result sets with where it occurs."""
    a, b = (x.select("kmer", F.lit(True).alias(n)).distinct() for x, n in ((left, "in_left"), (right, "in_right")))
    both = a.join(b, "kmer", "full_outer")
    where = F.when(F.col("in_left") & F.col("in_right"), "common").when(F.col("in_left"), "left").otherwise("right")
    return both.select("kmer", where.alias("found_in"))


def shifted_coordinates(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of one gene whose first coordinate is equal and whose differences add up to 0 (columns gene, c0..c3)."""
    total = lambda d: F.col(f"{d}.c0") + F.col(f"{d}.c1") + F.col(f"{d}.c2") + F.col(f"{d}.c3")
    same = F.col("a.gene").eqNullSafe(F.col("b.gene")) & (F.col("a.c0") == F.col("b.c0")) & (total("a") == total("b"))
    equal = sum((F.col(f"a.c{k}") == F.col(f"b.c{k}")).cast("int") for k in range(4))
    return left.alias("a").join(right.alias("b"), same).select("a.*", *[F.col(f"b.{n}").alias(f"other_{n}") for n in right.columns if n != "gene"], equal.alias("n_equal"))


def junction_flags(metadata: DataFrame, keys: list[str]) -> DataFrame:
    """Per junction: any stop, any isolated, any first part under 3 bases, any with more than one variant."""
    any_ = lambda c, n: F.bool_or(c).alias(n)
    return metadata.groupBy(*keys).agg(any_(F.col("hasStopCodon") == 1, "stop"), any_(F.col("isIsolated") == 1, "isolated"), any_(F.col("first_length") < 3, "short"), any_(F.col("n_variants") > 1, "variants"))


def kmer_details(*parts: DataFrame) -> DataFrame:
    """k-mer with all its places and expressions (location, expr), in order, as one text."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    held = rows.groupBy("kmer").agg(F.array_sort(F.collect_list(F.struct("location", "expr"))).alias("details"))
    return held.withColumn("detail_text", F.array_join(F.transform("details", lambda d: F.concat_ws(":", d.location, d.expr.cast("long"))), ";"))


def details_above(rows: DataFrame, threshold: float) -> DataFrame:
    """Rows of kmer_details with a place whose expression is above threshold."""
    return rows.where(F.exists("details", lambda d: d.expr > threshold))


def single_sample_filter(rows: DataFrame, cross: bool = False, junction_above: float | None = None, segment_above: float | None = None) -> DataFrame:
    """Strict thresholds on a k-mer's expressions; a missing one fails."""
    if cross:
        rows = rows.where("is_crossjunction")
    if junction_above is not None:
        rows = rows.where(F.col("junction_expr") > junction_above)
    return rows if segment_above is None else rows.where(F.col("segment_expr") > segment_above)


def metadata_filter(rows: DataFrame, metadata: DataFrame, **flags: bool) -> DataFrame:
    """Rows whose id has metadata with all the given flags."""
    for name, value in flags.items():
        metadata = metadata.where(F.col(name) == value)
    return rows.join(metadata.select("id"), "id", "left_semi")
