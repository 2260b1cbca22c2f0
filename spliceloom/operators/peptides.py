"""Foreground peptides of exon pairs, triples and single exons with their metadata, and the k-mers cut from them.

pairs: gene, v, w, phase, annotated; triples have u as well, and single exons neither w nor u. vertices: gene, v, start,
stop, strand, and bases of the plus strand, if there. sequences: gene, dna, offset; pairs of vertices with bases need none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spliceloom.functions.seq import coordinate_text, distinct_kmers, minus, residues, reverse_complement, with_combinations, with_kmers, with_residues, with_variants
from spliceloom.operators.cohort import without_known
from spliceloom.operators.expression import junction_expression, junctions_annotated, least_counts, mean_counts, segment_expression
from spliceloom.operators.quality import InputError
from spliceloom.operators.variants import within
from spliceloom.staging import written

#: Variants from which `crowded_pairs` tells a pair; all are combined, however many.
MAX_VARIANTS = 10


def _ends(rows: DataFrame) -> list[str]:
    """The columns that name the exons of a row, in reading order."""
    return [c for c in ("v", "w", "u") if c in rows.columns]


def placed_ends(pairs: DataFrame, vertices: DataFrame) -> DataFrame:
    """pairs with the strand and the places of their exons, which `modified_pairs` reads. Frames can be told apart after this: exons
    then meet once for an edge and not once for each of its frames."""
    rows = pairs
    held = [c for c in ("start", "stop", "bases") if c in vertices.columns]
    for name in _ends(pairs):
        ends = vertices.select("gene", F.col("v").alias(name), F.struct(*held).alias(f"__{name}"), *(["strand"] if name == "v" else []))
        rows = rows.join(ends, ["gene", name])
    return rows


def by_gene(pairs: DataFrame) -> DataFrame:
    """pairs dealt out by gene and in its order, as `gene_kmers` takes what is made of them row by row.

    What is dealt out is a row for each pair, and not the k-mers of its frames. Where rows are dealt out by gene already, this moves nothing.
    """
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(tasks, "gene").sortWithinPartitions("gene")


def in_all_frames(pairs: DataFrame) -> DataFrame:
    """pairs without a frame in the three frames of their first exon."""
    return pairs.select("*", F.explode(F.array(*[F.lit(p) for p in range(3)])).alias("phase"), F.lit(False).alias("annotated"))


def modified_pairs(pairs: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """Rows of one, two or three exons with strand and parts: the exons in reading order, without the bases before the first
    and after the last whole codon. Without vertices pairs are those of `placed_ends`. Where exons have bases, bases are those of the parts.
    Columns segments and junctions, which `expressed` reads, go along."""
    names = _ends(pairs)
    rows = pairs if vertices is None else placed_ends(pairs, vertices)
    plus, exons = F.col("strand") == "+", [F.col(f"__{name}") for name in names]
    rest = F.pmod(sum((x.stop - x.start for x in exons), -F.col("phase")), F.lit(3))
    part = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("stop"))

    def cut(k: int, x: Column) -> Column:
        lead = F.col("phase") if k == 0 else F.lit(0)
        tail = rest if k == len(exons) - 1 else F.lit(0)
        forward = part(x.start + lead, F.greatest(x.start + lead, x.stop - tail))
        return F.when(plus, forward).otherwise(part(F.least(x.stop - lead, x.start + tail), x.stop - lead))

    parts = F.array(*[cut(k, x) for k, x in enumerate(exons)])
    original = F.array(*[part(x.start, x.stop) for x in exons])
    out = rows.select("*", parts.alias("parts"), original.alias("original"))
    own = []
    if "bases" in rows.schema["__v"].dataType.names:
        of = lambda k, x: F.substring(x.bases, F.get("parts", F.lit(k))["start"] - x.start.cast("int") + 1, F.get("parts", F.lit(k))["stop"] - F.get("parts", F.lit(k))["start"])
        own = [F.array(*[of(k, x) for k, x in enumerate(exons)]).alias("bases")]
    return out.select("gene", *names, "phase", "annotated", "strand", "parts", "original", *own, *[c for c in ("segments", "junctions") if c in rows.columns])


def isolated_exons(frames: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows of one exon: the frames (gene, v, phase, annotated) of vertices from which no edge leads on."""
    return frames.join(edges.select("gene", F.col("src").alias("v")), ["gene", "v"], "left_anti").select("gene", "v", "phase", "annotated")


def as_triples(triples: DataFrame, frames: DataFrame) -> DataFrame:
    """exon_triples (gene, v1, v2, v3, phase) as rows of three exons, with the first one's flag."""
    rows = triples.select("gene", F.col("v1").alias("v"), F.col("v2").alias("w"), F.col("v3").alias("u"), "phase")
    return rows.join(frames.select("gene", "v", "phase", "annotated"), ["gene", "v", "phase"])


def part_bases() -> Column:
    """The bases of each of parts on the plus strand, from columns parts, dna and offset."""
    return F.transform("parts", lambda p: F.substring(F.col("dna"), (p.start - F.col("offset") + 1).cast("int"), (p.stop - p.start).cast("int")))


def forward(bases: Column) -> Column:
    """The parts' own bases as one text of the plus strand, the last part first on minus: what is read backwards there."""
    return F.array_join(F.when(minus(F.col("strand")), F.reverse(bases)).otherwise(bases), "")


def coding_of(bases: Column, variants: Column | None = None) -> Column:
    """Bases of parts in reading order, with variants put in part by part, from columns parts and strand and the parts' own bases."""

    def piece(p: Column, own: Column) -> Column:
        if variants is not None:
            own = with_variants(own, p.start, variants)
        return F.when(F.col("strand") == "+", own).otherwise(reverse_complement(own))

    return F.array_join(F.zip_with(F.col("parts"), bases, piece), "")


def coding_bases(variants: Column | None = None) -> Column:
    """coding_of the parts, from columns parts, strand, dna and offset."""
    return coding_of(part_bases(), variants)


def _emitted(rows: DataFrame) -> DataFrame:
    """One row per peptide, from columns mutated and reference (residues with stops) and variants."""
    peptide = F.substring_index("mutated", "_", 1)
    first = F.get("parts", F.lit(0))
    isolated = (F.size("original") < 2) | (3 * F.length(peptide) <= first["stop"] - first["start"] + 1)
    start = F.when(F.col("strand") == "+", first["start"]).otherwise(first["stop"])
    return rows.withColumns({"peptide": peptide, "hasStopCodon": F.contains("mutated", F.lit("_")).cast("int"), "isIsolated": isolated.cast("int"), "tran_start": start}).where("peptide != ''")


def reference_peptides(pairs: DataFrame, sequences: DataFrame | None = None) -> DataFrame:
    """Peptides of modified pairs without variants, with flags."""
    rows = pairs if sequences is None else pairs.join(sequences.hint("merge"), "gene").withColumn("bases", part_bases()).drop("dna", "offset")
    rows = with_residues(rows, "mutated", forward(F.col("bases")), minus(F.col("strand")))
    return _emitted(rows).drop("mutated", "bases").withColumns({"variantComb": F.lit(None).cast("string"), "variant_no": F.lit(0)})


def _with_variants(pairs: DataFrame, variants: DataFrame) -> DataFrame:
    """Rows with the variants (gene, sample, pos, base, and count if there) in any part, per sample, in order."""
    spans = pairs.select("*", F.explode("parts").alias("part")).select("*", "part.start", "part.stop")
    near = within(spans, variants, ["gene"])
    held = F.struct("pos", "base", *(["count"] if "count" in variants.columns else []))
    return near.groupBy(*pairs.columns, "sample").agg(F.array_sort(F.collect_set(held)).alias("held"))


def variants_of(variants: DataFrame, genes: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Variants (sample, chrom, pos, ...) on the genes (gene, chrom, start, stop) that they stand in, as gene, sample, pos, ....

    names (sample, mutation) tells under which name each graph sample's variants go; without it samples keep their own. A
    sample or chromosome without variants gives none.
    """
    if names is not None:
        variants = variants.withColumnRenamed("sample", "mutation").join(names.select("sample", "mutation").distinct(), "mutation").drop("mutation")
    return within(genes.select("gene", "chrom", "start", "stop"), variants, ["chrom"]).drop("chrom", "start", "stop")


def germline_sequences(sequences: DataFrame, variants: DataFrame) -> DataFrame:
    """sample, gene, dna and offset: sequences with each sample's germline variants (gene, sample, pos, base) put in.

    They are the reference of a sample with somatic variants; of a (sample, gene) without variants there is no row.
    """
    held = variants.groupBy("sample", "gene").agg(F.array_sort(F.collect_set(F.struct("pos", "base"))).alias("held"))
    rows = held.join(sequences.hint("merge"), "gene")
    return rows.select("sample", "gene", with_variants(F.col("dna"), F.col("offset"), F.col("held")).alias("dna"), "offset")


def crowded_pairs(pairs: DataFrame, variants: DataFrame, most: int = MAX_VARIANTS) -> DataFrame:
    """Pairs with more variants than most, whose combinations are many, for a report."""
    return _with_variants(pairs, variants).where(F.size("held") > most).select("gene", *_ends(pairs), "phase", "sample", F.size("held").alias("n_variants"))


def mutated_peptides(pairs: DataFrame, sequences: DataFrame | None, variants: DataFrame, force: bool = False) -> DataFrame:
    """Peptides of every combination of a sample's variants in a pair that differ from the reference's (or all, with force).

    variant_no counts what a pair emits, from 0, in order of size and then position of the combinations. Where variants have
    a count, the expression of their segment, variantSegExpr lists those of the combination. sequences may be those of a
    sample, with a column sample. A peptide is as long as its pair, so n variants give up to 2**n of them, spread over all tasks;
    where only k-mers are wanted, `operators.variants.mutated_kmers` has them without that.
    """
    rows = _with_variants(pairs, variants)
    if sequences is not None:
        keys = ["gene", "sample"] if "sample" in sequences.columns else ["gene"]
        rows = rows.join(sequences.hint("merge"), keys).withColumn("bases", part_bases()).drop("dna", "offset")
    rows = written(rows.withColumn("reference", residues(coding_of(F.col("bases")))), "pairs")
    rows = with_combinations(rows, "held", "chosen").where("size(chosen) > 0")
    rows = with_residues(rows, "mutated", coding_of(F.col("bases"), F.col("chosen")))
    out = _emitted(rows)
    if not force:
        out = out.where(~F.array_contains(F.split("reference", "_", -1), F.col("peptide")))
    out = _numbered(out.drop("mutated", "reference", "held", "bases"), ["sample", "gene", *_ends(pairs), "phase"])

    listed = lambda f: F.array_join(F.transform("chosen", lambda c: c[f].cast("string")), ";", "nan")
    new = {"variantComb": listed("pos")}
    if "count" in variants.columns:
        new["variantSegExpr"] = listed("count")
    return out.withColumns(new).drop("chosen")


def _numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with variant_no, from 0 for each of keys, in order of the size of chosen and then of chosen.

    Rows are numbered within those of one size and first two variants, which are in order as a whole, and on from the number of
    rows that come before these; so the rows of a pair with many combinations don't meet in one task.
    """
    own = [*keys, "size", "lead"]
    rows = written(rows.withColumns({"size": F.size("chosen"), "lead": F.slice("chosen", 1, 2)}), "emitted")
    counts = rows.groupBy(*own).agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy(*keys).orderBy("size", "lead").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("ahead", F.coalesce(ahead, F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy(*own).orderBy("chosen"))
    return rows.withColumn("place", place).join(counts, own).withColumn("variant_no", (F.col("ahead") + F.col("place") - 1).cast("int")).drop("size", "lead", "ahead", "place")


def peptide_metadata(peptides: DataFrame, genes: DataFrame, mode: str, listed: DataFrame | None = None, kmer_type: str = "2-exons") -> DataFrame:
    """The metadata table of peptides: ids, flags and coordinates; genes has gene and chrom, listed the flags of `junction_listed`."""
    numbers = lambda c: F.concat_ws(";", F.flatten(F.transform(c, lambda p: F.array(p.start, p.stop))).cast("array<string>"))
    vertices = F.concat_ws("_", *_ends(peptides))
    rows = peptides.join(genes.select("gene", "chrom"), "gene", "left")
    if listed is not None:
        rows = rows.join(listed, ["gene", "v", "w"], "left")
    else:
        rows = rows.withColumn("isInJunctionList", F.lit(None).cast("int"))
    return rows.select(
        "peptide",
        F.concat_ws(":", "gene", vertices, "variant_no", "tran_start", F.lit(kmer_type)).alias("id"),
        F.col("phase").alias("readFrame"),
        F.col("annotated").alias("readFrameAnnotated"),
        F.col("gene").alias("geneName"),
        F.col("chrom").alias("geneChr"),
        F.col("strand").alias("geneStrand"),
        F.lit(mode).alias("mutationMode"),
        "hasStopCodon",
        "isInJunctionList",
        "isIsolated",
        "variantComb",
        F.col("variantSegExpr") if "variantSegExpr" in peptides.columns else F.lit(None).cast("string").alias("variantSegExpr"),
        numbers("parts").alias("modifiedExonsCoord"),
        numbers("original").alias("originalExonsCoord"),
        F.regexp_replace(vertices, "_", ";").alias("vertexIdx"),
        F.lit(kmer_type).alias("kmerType"),
    )


def junction_listed(pairs: DataFrame, whitelist: DataFrame) -> DataFrame:
    """gene, v, w and 1 or 0: whether the intron of a pair (gene, chrom, strand, v, w, original) is in a list (chrom, a, b, strand)."""
    left, right = F.get("original", F.lit(0)), F.get("original", F.lit(1))
    plus = F.col("strand") == "+"
    rows = pairs.withColumns({"a": F.when(plus, left["stop"]).otherwise(right["stop"]), "b": F.when(plus, right["start"]).otherwise(left["start"])})
    held = whitelist.select("chrom", "strand", "a", "b", F.lit(1).alias("held")).distinct()
    return rows.join(held, ["chrom", "strand", "a", "b"], "left").select("gene", "v", "w", F.coalesce("held", F.lit(0)).alias("isInJunctionList")).distinct()


def peptide_kmers(peptides: DataFrame, k: int) -> DataFrame:
    """Distinct k-mers with their pieces in the genome: gene, strand, kmer, parts, coord, readFrameAnnotated, isCrossJunction."""
    tiles = with_kmers(peptides.select("gene", "strand", F.col("annotated").alias("readFrameAnnotated"), "parts", "peptide"), k)
    rows = tiles.select("gene", "strand", "kmer", "readFrameAnnotated", "parts").distinct()  # without columns beside the keys, which would be sorted
    return rows.withColumns({"coord": coordinate_text(F.col("parts")), "isCrossJunction": F.size("parts") > 1})


def gene_kmers(peptides: DataFrame, k: int) -> DataFrame:
    """`peptide_kmers` of the peptides of pairs that went through `by_gene`; with segments and junctions, as `expressed` takes them.

    K-mers are told apart gene by gene where they are cut, so none are shuffled.
    """
    beside = [c for c in ("segments", "junctions") if c in peptides.columns]
    rows = distinct_kmers(peptides.select("gene", "strand", F.col("annotated").alias("readFrameAnnotated"), *beside, "parts", "peptide"), k, ["gene", "strand", "readFrameAnnotated"])
    return rows.withColumns({"coord": coordinate_text(F.col("parts")), "isCrossJunction": F.size("parts") > 1})


def expressed(rows: DataFrame, k: int) -> DataFrame:
    """Both matrices of `matrices_of` in one table, of k-mers (`gene_kmers`) of pairs that carry what the counts have in reach of them.

    segments of a pair: an array of start, stop and counts, all that overlap its exons; junctions: an array of left_stop, right_start,
    counts and annotated, all that its k-mers may cross. So nothing is joined with k-mers, and they are neither shuffled nor written.
    """
    cross = F.col("isCrossJunction")
    expr = F.when(cross, least_counts(F.col("crossed").cast("array<array<double>>"))).otherwise(mean_counts(F.col("held").cast("array<struct<n:double,counts:array<double>>>"), k))
    return rows.select("gene", "kmer", "coord", "isCrossJunction", F.col("annotated").alias("junctionAnnotated"), "readFrameAnnotated", expr.alias("expr"))


def kmer_pieces(rows: DataFrame) -> DataFrame:
    """gene, id (the coordinates), start and stop of each piece, as segment expression takes them."""
    return rows.select("gene", F.col("coord").alias("id"), F.explode("parts").alias("p")).select("gene", "id", "p.start", "p.stop").distinct()


def kmer_junctions(rows: DataFrame) -> DataFrame:
    """gene, id, left_stop and right_start of each junction that a k-mer crosses, as junction expression takes them."""
    crossed = rows.where("size(parts) > 1").select("gene", F.col("coord").alias("id"), F.array_sort("parts").alias("p"))
    steps = F.transform(F.sequence(F.lit(0), F.size("p") - 2), lambda i: F.struct(F.get("p", i)["stop"].alias("left_stop"), F.get("p", i + 1)["start"].alias("right_start")))
    return crossed.select("gene", "id", F.explode(steps).alias("j")).select("gene", "id", "j.left_stop", "j.right_start").distinct()


def kmer_matrices(peptides: DataFrame, k: int, segments: DataFrame, edge_counts: DataFrame, known: DataFrame, listed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The matrices (`matrices_of`) of the k-mers of peptides."""
    return matrices_of(peptide_kmers(peptides, k), k, segments, edge_counts, known, listed)


def mutated_matrices(rows: DataFrame, k: int, segments: DataFrame, edge_counts: DataFrame, known: DataFrame, listed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The matrices of mutated k-mers (`variants.mutated_kmers`), of pairs, triples or single exons, each row with its sample and variants."""
    rows = rows.withColumnsRenamed({"pieces": "parts", "annotated": "readFrameAnnotated"})
    names = ["gene", "sample", "kmer", "variants", "coord", "readFrameAnnotated"]
    return matrices_of(rows.select(*names, "parts", "isCrossJunction").dropDuplicates(names), k, segments, edge_counts, known, listed)


def matrices_of(rows: DataFrame, k: int, segments: DataFrame, edge_counts: DataFrame, known: DataFrame, listed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The segment and the junction matrix of k-mers (gene, kmer, parts, coord, isCrossJunction, readFrameAnnotated, and whose they are
    in sample and variants, if there): gene, kmer, coord, flags and expr, a value per sample of the counts.

    segments: gene, seg_start, seg_stop, counts; edge_counts: gene, left_stop, right_start, counts; known: annotated junctions
    (gene, a, b); listed: known k-mers to leave out, with I as L. A k-mer within an exon has the mean count over its bases,
    one across junctions the least count of these; what the counts lack is null. Expression is made once for each place, whatever stands there.
    """
    if listed is not None:
        rows = without_known(rows, listed)
    rows = written(rows, "kmers")  # cut once, read by both matrices and for their places
    keys = [F.col("gene"), F.col("coord").alias("id")]
    own = [c for c in ("sample", "variants") if c in rows.columns]
    flags = [*own, "kmer", "isCrossJunction", "readFrameAnnotated"]
    within_ = segment_expression(kmer_pieces(rows.where("not isCrossJunction")), segments, k)
    crossed = kmer_junctions(rows)
    across = junction_expression(crossed, edge_counts)
    out = [*own, "gene", "kmer", F.col("id").alias("coord"), "isCrossJunction", "junctionAnnotated", "readFrameAnnotated", "expr"]
    segment = rows.where("not isCrossJunction").select(*keys, *flags, F.lit(False).alias("junctionAnnotated")).join(within_, ["gene", "id"], "left")
    junction = rows.where("isCrossJunction").select(*keys, *flags).join(across, ["gene", "id"], "left").join(junctions_annotated(crossed, known), ["gene", "id"], "left")
    return segment.select(*out), junction.select(*out)


def chosen_genes(genes: DataFrame, offset: int = 0, number: int | None = None, names: DataFrame | None = None, chromosomes: list[str] | None = None, most_vertices: int | None = None, transcripts: DataFrame | None = None, cds: DataFrame | None = None) -> DataFrame:
    """Genes (gene_idx, gene, chrom, n_vertices) to work on: by running number from offset, list, chromosome and size of graph,
    and with a transcript and a coding piece where these tables (gene) are given. None left is an error."""
    rows = genes.where(F.col("gene_idx") >= offset)
    if number:
        rows = rows.where(F.col("gene_idx") < offset + number)
    if chromosomes:
        rows = rows.where(F.col("chrom").isin(chromosomes))
    if most_vertices:
        rows = rows.where(F.col("n_vertices") <= most_vertices)
    for needed in (names, transcripts, cds):
        if needed is not None:
            rows = rows.join(needed.select("gene").distinct(), "gene", "left_semi")
    if rows.isEmpty():
        raise InputError("no genes to work on")
    return rows
