"""Readers for matrices, annotation, genomes, variants, counts and lists. Schemas are explicit; nothing is inferred."""

from __future__ import annotations

import json
import warnings

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spliceloom.functions.seq import chromosome_name, isoleucine_as_leucine, kmers
from spliceloom.operators.cohort import clean
from spliceloom.operators.expression import divisors
from spliceloom.operators.quality import InputError, check, missing, repeated

#: Columns of a k-mer matrix that are not samples, and their types.
MATRIX_FIELDS = {"kmer": "string", "coord": "string", "isCrossJunction": "boolean", "junctionAnnotated": "boolean", "readFrameAnnotated": "boolean"}
#: Genotypes of which one allele at least is the variant.
CARRIED = ("1|1", "1|0", "0|1", "0/1", "1/0", "1/1")


def sample_name(name: str) -> str:
    """Sample names are compared without -, _, . and /."""
    return "".join(c for c in name if c not in "-_./")


def _header(spark: SparkSession, path: str, sep: str) -> list[str]:
    return spark.read.option("sep", sep).option("header", True).csv(path).columns


def _fields(columns: list[str]) -> dict[str, str]:
    """The columns that are not samples, with the field that each is."""
    known = {f.lower(): f for f in MATRIX_FIELDS}
    return {c: known[c.lower()] for c in columns if c.lower() in known}


def kmer_matrix(spark: SparkSession, paths: str | list[str], kind: str | None = None) -> tuple[DataFrame, list[str]]:
    """A matrix in array form and its sample names in order; kind: parquet, tsv or csv, else by the path's end.

    All files of a list must have the same columns. Missing values and NaN become 0. Columns that are no samples are known
    in any spelling of their letters.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    kind = kind or next((k for k in ("parquet", "tsv", "csv") if f".{k}" in paths[0] or paths[0].endswith(".pq") and k == "parquet"), "tsv")
    if kind == "parquet":
        df = spark.read.parquet(*paths)
    else:
        sep = "," if kind == "csv" else "\t"
        columns = _header(spark, paths[0], sep)
        for p in paths[1:]:
            if _header(spark, p, sep) != columns:
                raise ValueError(f"{p} has other columns than {paths[0]}")
        kinds = {c: MATRIX_FIELDS[f] for c, f in _fields(columns).items()}
        schema = T.StructType([T.StructField(c, {"boolean": T.BooleanType(), "string": T.StringType()}.get(kinds.get(c), T.DoubleType())) for c in columns])
        df = spark.read.schema(schema).option("sep", sep).option("header", True).option("nanValue", "nan").csv(paths)
    field = _fields(df.columns)
    samples = [c for c in df.columns if c not in field]
    names = [sample_name(c) for c in samples]
    if len(set(names)) < len(names):
        raise ValueError("sample names are equal without their separators")
    fixed = [F.col(c).cast(MATRIX_FIELDS[field[c]]).alias(field[c]) for c in df.columns if c in field]
    return df.select(*fixed, clean(F.array(*[F.col(f"`{c}`").cast("double") for c in samples])).alias("expr")), names


def positions(names: list[str], chosen: list[str]) -> list[int]:
    """Positions of chosen samples; an unknown one is an error."""
    at = {n: k for k, n in enumerate(names)}
    lost = [c for c in chosen if sample_name(c) not in at]
    if lost:
        raise ValueError(f"samples not in the matrix: {', '.join(lost)}")
    return [at[sample_name(c)] for c in chosen]


def annotation_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a GTF, GFF or GFF3 file with their number; comments are left out."""
    schema = "chrom string, source string, feature string, start int, end int, score string, strand string, phase string, attributes string"
    df = spark.read.schema(schema).option("sep", "\t").option("comment", "#").option("quote", "").csv(path)
    return df.withColumn("line", F.monotonically_increasing_id()).where("feature in ('transcript', 'mRNA', 'CDS')")


def genome(spark: SparkSession, path: str) -> DataFrame:
    """chrom and seq of a FASTA file, a row per chromosome; the name is the first word of the header."""
    entries = spark.read.option("lineSep", ">").text(path).where("trim(value) != ''")
    head, body = F.substring_index("value", "\n", 1), F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")
    return entries.select(F.get(F.split(F.trim(head), r"\s+"), F.lit(0)).alias("chrom"), body.alias("seq"))


def genome_chunks(genome_table: DataFrame, size: int = 100_000) -> DataFrame:
    """Fixed-size chunks of chromosomes (chrom, chunk, seq), of one row per chromosome; see `fasta_chunks` for large files.

    Sequences are of one byte a base and are cut as bytes, which takes the same time wherever a chunk begins.
    """
    rows = genome_table.where("length(seq) > 0").select("chrom", F.col("seq").cast("binary").alias("seq"))
    count = F.ceil(F.length("seq") / size).cast("int")
    rows = rows.select("chrom", "seq", F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk"))
    return rows.select("chrom", "chunk", F.substring(F.col("seq"), F.col("chunk") * size + 1, F.lit(size)).cast("string").alias("seq"))


def fasta_chunks(spark: SparkSession, paths: str | list[str], size: int = 100_000) -> DataFrame:
    """Fixed-size chunks (chrom, chunk, seq) of FASTA files, read by line, so that a chromosome is spread over tasks.

    A line's place in its chromosome is a prefix sum in two passes: of lengths within each block of a file that a task reads, and
    of the blocks' totals, a row each, which tell a block with which chromosome and place it begins. Lines before the first
    header are left out; white space in lines does not count. Equal to genome_chunks of the whole sequences.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")]
    raw = spark.read.text(paths).select("value", *place)
    head = F.col("value").startswith(">")
    name = F.when(head, F.get(F.split(F.trim(F.substring("value", 2, 1 << 20)), r"\s+"), F.lit(0)))
    rows = raw.select("file", "block", "line", name.alias("name"), F.when(head, "").otherwise(F.regexp_replace("value", r"\s", "")).cast("binary").alias("bases"))
    rows = rows.withColumn("n", F.length("bases").cast("long"))
    own = Window.partitionBy("file", "block")
    rows = rows.withColumn("entry", F.count("name").over(own.orderBy("line")))
    own = Window.partitionBy("file", "block", "entry").orderBy("line")
    rows = rows.withColumns({"chrom": F.first("name").over(own), "at": F.coalesce(F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})

    # the last entry of each block: its name, if it begins there, and its bases so far
    last = F.max(F.struct("entry", F.col("chrom").alias("name"), "total")).alias("last")
    totals = rows.groupBy("file", "block", "entry").agg(F.max("chrom").alias("chrom"), F.sum("n").alias("total"))
    blocks = totals.groupBy("file", "block").agg(last).select("file", "block", "last.*")
    order = Window.partitionBy("file").orderBy("block")
    blocks = blocks.withColumns({"run": F.count("name").over(order), "name": F.last("name", ignorenulls=True).over(order)})
    blocks = blocks.withColumn("sum", F.sum("total").over(Window.partitionBy("file", "run").orderBy("block")))
    begun = blocks.select("file", "block", F.lag("name").over(order).alias("open"), F.lag("sum").over(order).alias("before"))

    rows = rows.where("n > 0").join(begun, ["file", "block"])
    first = F.col("entry") == 0
    rows = rows.select(F.when(first, F.col("open")).otherwise(F.col("chrom")).alias("chrom"), (F.col("at") + F.when(first, F.coalesce("before", F.lit(0))).otherwise(0)).alias("at"), "bases", "n").where("chrom is not null")
    span = F.sequence(F.floor(F.col("at") / size), F.floor((F.col("at") + F.col("n") - 1) / size))
    rows = rows.withColumn("chunk", F.explode(span))
    low = F.greatest(F.col("at"), F.col("chunk") * size)
    piece = F.substring(F.col("bases"), (low - F.col("at") + 1).cast("int"), (F.least(F.col("at") + F.col("n"), (F.col("chunk") + 1) * size) - low).cast("int"))
    held = rows.select("chrom", F.col("chunk").cast("int").alias("chunk"), low.alias("low"), piece.cast("string").alias("piece")).groupBy("chrom", "chunk").agg(F.array_sort(F.collect_list(F.struct("low", "piece"))).alias("ps"))
    return held.select("chrom", "chunk", F.array_join(F.transform("ps", lambda p: p.piece), "").alias("seq"))


def gene_sequences(genes: DataFrame, chunks: DataFrame, size: int = 100_000) -> DataFrame:
    """gene, dna and offset of genes (gene, chrom, start, stop), cut from the chunks they touch."""
    span = F.sequence(F.floor(F.col("start") / size).cast("int"), F.floor((F.col("stop") - 1) / size).cast("int"))
    rows = genes.withColumn("chunk", F.explode(span)).join(chunks, ["chrom", "chunk"])
    base = F.col("chunk") * size
    piece = F.substring(F.col("seq"), F.greatest(F.col("start") - base, F.lit(0)).cast("int") + 1, (F.least(F.col("stop"), base + size) - F.greatest(F.col("start"), base)).cast("int"))
    held = rows.groupBy("gene", "start").agg(F.array_sort(F.collect_list(F.struct("chunk", piece.alias("p")))).alias("ps"))
    return held.select("gene", F.array_join(F.transform("ps", lambda p: p.p), "").alias("dna"), F.col("start").alias("offset"))


def maf_variants(spark: SparkSession, path: str) -> DataFrame:
    """sample, chrom, pos (from 0), ref, alt and line of the SNPs of a MAF file."""
    df = spark.read.option("sep", "\t").option("header", True).option("comment", "#").csv(path).withColumn("line", F.monotonically_increasing_id())
    rows = df.where("Variant_Type = 'SNP'")
    return rows.select(F.col("Tumor_Sample_Barcode").alias("sample"), F.col("Chromosome").alias("chrom"), (F.col("Start_Position").cast("int") - 1).alias("pos"), F.col("Reference_Allele").alias("ref"), F.col("Tumor_Seq_Allele2").alias("alt"), "line")


def vcf_variants(spark: SparkSession, path: str) -> DataFrame:
    """sample, chrom, pos (from 0), ref, alt and line of the substitutions that samples of a VCF file carry.

    One of several bases is a variant at each place at which both differ; other lengths are no substitutions.
    """
    lines = spark.read.text(path).where("value not like '##%'").withColumn("line", F.monotonically_increasing_id())
    names = lines.where("value like '#CHROM%'").first().value.split("\t")[9:]
    f = F.split("value", "\t")
    pairs = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("sample"), F.slice(f, 10, len(names)).alias("gt"))
    rows = lines.where("value not like '#%'").select(f.alias("f"), "line", F.explode(pairs).alias("p"))
    rows = rows.select(F.col("p.sample").alias("sample"), F.get("f", F.lit(0)).alias("chrom"), (F.get("f", F.lit(1)).cast("int") - 1).alias("pos"), F.get("f", F.lit(3)).alias("ref"), F.get("f", F.lit(4)).alias("alt"), "line", F.substring_index("p.gt", ":", 1).alias("gt"))
    rows = rows.where(F.col("gt").isin(*CARRIED) & (F.length("ref") == F.length("alt")))
    base = lambda c, k: F.substring(c, k + 1, F.lit(1))
    places = F.transform(F.sequence(F.lit(0), F.length("ref") - 1), lambda k: F.struct((F.col("pos") + k).alias("pos"), base(F.col("ref"), k).alias("ref"), base(F.col("alt"), k).alias("alt")))
    return rows.select("sample", "chrom", F.explode(places).alias("x"), "line").where("x.ref != x.alt").select("sample", "chrom", "x.pos", "x.ref", "x.alt", "line")


def genotype_variants(table: DataFrame, heterozygous: int = 0) -> DataFrame:
    """Variants of a genotype table (chrom_code, pos, ref, alt, sample, gt) that samples carry."""
    rows = table.where(F.col("gt").isin(heterozygous, 1))
    return rows.select("sample", chromosome_name(F.col("chrom_code")).alias("chrom"), (F.col("pos") - 1).alias("pos"), "ref", "alt", F.monotonically_increasing_id().alias("line"))


def variants(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Variants of a file by its suffix, .maf, .vcf or .parquet, marked as germline or somatic by kind."""
    readers = {".maf": maf_variants, ".vcf": vcf_variants, ".parquet": lambda s, p: genotype_variants(s.read.parquet(p))}
    for suffix, reader in readers.items():
        if path.removesuffix(".gz").endswith(suffix):
            return reader(spark, path).withColumn("kind", F.lit(kind))
    raise ValueError(f"variants are read from {', '.join(readers)}, not {path}")


def renamed_samples(variants_table: DataFrame, names: DataFrame) -> DataFrame:
    """Variants under the graph's sample names (names: mutation, graph); others keep their own."""
    return variants_table.join(names.select(F.col("mutation").alias("sample"), "graph"), "sample", "left").withColumn("sample", F.coalesce("graph", "sample")).drop("graph")


#: Fixed schemas of the tables that hold a splice graph and its counts.
GRAPH_TABLES = {
    "genes": "gene_idx int, gene string, chrom string, strand string, start int, stop int, n_vertices int",
    "vertices": "gene string, v int, start int, stop int, strand string",
    "edges": "gene string, src int, dst int",
    "segments": "gene string, seg_id int, seg_start int, seg_stop int",
    "seg_edges": "gene string, left_stop int, right_start int",
}
COUNT_TABLES = {"segment_counts": "gene string, seg_id int, counts array<double>", "edge_counts": "gene string, left_stop int, right_start int, counts array<double>"}


def graph_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a splice graph, parquet files of a folder, with their fixed columns."""
    return {name: spark.read.schema(schema).parquet(f"{folder}/{name}.parquet") for name, schema in GRAPH_TABLES.items()}


def count_store(spark: SparkSession, folder: str, graph: dict[str, DataFrame] | None = None) -> tuple[dict[str, DataFrame], list[str]]:
    """Counts of segments and edges, an array by sample position, and the sample names of a folder.

    Arrays of another length than there are samples, repeated keys and, with a graph, counts of unknown genes are errors.
    """
    rows = spark.read.schema("pos int, sample string").parquet(f"{folder}/samples.parquet").orderBy("pos").collect()  # as long as there are samples
    names = [sample_name(r.sample) for r in rows]
    if [r.pos for r in rows] != list(range(len(rows))) or len(set(names)) < len(names):
        raise InputError("samples: positions must run from 0 and names differ")
    counts = {name: spark.read.schema(schema).parquet(f"{folder}/{name}.parquet") for name, schema in COUNT_TABLES.items()}
    for name, df in counts.items():
        keys = [c for c in df.columns if c != "counts"]
        problems = {f"{name} of another length": df.where(F.col("counts").isNull() | (F.size("counts") != len(names))).select(*keys), f"{name} repeated": repeated(df, *keys)}
        if graph:
            problems[f"{name} of unknown genes"] = missing(df, graph["genes"], "gene")
        check(**problems)
    return counts, names


def sample_positions(names: list[str], chosen: list[str]) -> dict[str, int]:
    """Positions of chosen samples among names; an unknown one is left out with a warning, and cohort without one."""
    at = {n: k for k, n in enumerate(names)}
    for c in chosen:
        if c != "cohort" and sample_name(c) not in at:
            warnings.warn(f"sample {c} has no counts, so it gets no expression", stacklevel=2)
    return {c: at[sample_name(c)] for c in chosen if sample_name(c) in at}


def junction_whitelist(spark: SparkSession, path: str) -> DataFrame:
    """chrom, strand, a and b of a list of junctions: a parquet table, or lines of chrom and a:b:strand."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.schema("chrom string, a int, b int, strand string").parquet(path).select("chrom", "strand", "a", "b").distinct()
    f = F.split("junction", ":")
    rows = spark.read.schema("chrom string, junction string").option("sep", "\t").csv(path)
    return rows.select("chrom", F.get(f, F.lit(2)).alias("strand"), F.get(f, F.lit(0)).cast("int").alias("a"), F.get(f, F.lit(1)).cast("int").alias("b")).distinct()


def sample_map(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """sample (the graph's name) and mutation (the variants') of a table with a header and two columns, or three: graph,
    germline and somatic, of which kind picks one. A missing name is the graph's own."""
    columns = _header(spark, path, "\t")
    if len(columns) not in (2, 3) or len(columns) == 3 and kind not in ("germline", "somatic"):
        raise ValueError(f"{path} needs two columns, or three and a kind of variants")
    df = spark.read.schema(", ".join(f"c{k} string" for k in range(len(columns)))).option("sep", "\t").option("header", True).csv(path)
    chosen = F.col("c2" if kind == "somatic" and len(columns) == 3 else "c1")
    return df.select(F.col("c0").alias("sample"), F.coalesce(chosen, "c0").alias("mutation")).distinct()


def gene_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct genes of a list."""
    return spark.read.schema("gene string").csv(path).select(F.trim("gene").alias("gene")).where("gene != ''").distinct()


def metadata_table(spark: SparkSession, path: str) -> DataFrame:
    """Distinct rows of a peptide metadata table that have a peptide."""
    return parts_of(spark, path).where("peptide is not null").distinct()


def external_kmers(spark: SparkSession, path: str) -> DataFrame:
    """Distinct k-mers of a parquet or tab-separated table with a column kmer."""
    df = spark.read.parquet(path) if ".parquet" in path or path.endswith(".pq") else parts_of(spark, path)
    return df.select("kmer").where("kmer is not null").distinct()


def junction_fasta(spark: SparkSession, path: str, sep: str = "_", gene: int = 0, first: int = 1) -> DataFrame:
    """gene, coords and peptide of an earlier result's entries.

    The header's fields, parted at sep, hold the gene and from field first on four coordinates, of which the second and fourth
    count from 1 and become one less.
    """
    f = F.split("id", F.lit(f"\\Q{sep}\\E"))
    at = lambda k: F.get(f, F.lit(first + k)).try_cast("int") - k % 2
    return fasta_entries(spark, path).select(F.get(f, F.lit(gene)).alias("gene"), F.array(*[at(k) for k in range(4)]).alias("coords"), F.col("sequence").alias("peptide"))


def fasta_kmers(spark: SparkSession, path: str, k: int = 9) -> DataFrame:
    """id and each distinct k-mer of FASTA entries."""
    return fasta_entries(spark, path).select("id", F.explode(kmers(F.col("sequence"), k)).alias("kmer")).distinct()


def known_kmers(spark: SparkSession, path: str) -> DataFrame:
    """Distinct k-mers of a list, with I as L."""
    return spark.read.schema("kmer string").csv(path).select(isoleucine_as_leucine(F.trim("kmer")).alias("kmer")).distinct()


def sample_list(spark: SparkSession, path: str) -> list[str]:
    """Names of a whitelist, which is as long as there are samples."""
    return [sample_name(r.sample) for r in spark.read.schema("sample string").csv(path).collect()]


def library_divisors(spark: SparkSession, path: str, samples: list[str], normalizer: float | None = None) -> DataFrame:
    """pos and divisor of each sample from a table of library sizes; a missing sample is an error."""
    df = spark.read.schema("sample string, libsize_75percent double, libsize_total_count double").option("sep", "\t").option("header", True).csv(path)
    at = F.from_json(F.lit(json.dumps({n: k for k, n in enumerate(samples)})), "map<string,int>")
    rows = df.select(at[F.regexp_replace("sample", "[-_./]", "")].alias("pos"), "libsize_75percent").where("pos is not null")
    if rows.count() < len(samples):
        raise ValueError("samples without a library size")
    return divisors(rows, normalizer)


def parts_of(spark: SparkSession, path: str) -> DataFrame:
    """All part files of a folder of tab-separated tables with headers."""
    return spark.read.option("sep", "\t").option("header", True).csv(path)


def spectrum_matches(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a spectrum-match table with numbers as numbers."""
    numbers = {"n_db": "int", "n_ptm": "int", "pvalue": "double", "score": "double", "rank": "int"}
    df = parts_of(spark, path)
    return df.select(*[F.col(f"`{c}`").cast(numbers.get(c, "string")).alias(c) for c in df.columns])


def fasta_entries(spark: SparkSession, path: str) -> DataFrame:
    """id and sequence of FASTA entries."""
    return genome(spark, path).select(F.col("chrom").alias("id"), F.col("seq").alias("sequence"))
