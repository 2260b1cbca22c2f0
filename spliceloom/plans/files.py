"""Queries that write tables in the formats of the sinks and read them again by the readers, and those of graph and count tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spliceloom.operators import annotation as a
from spliceloom.operators import graph as g
from spliceloom.operators import peptides as p
from spliceloom.plans import query
from spliceloom.plans.graph import _GENES, _counts, _genes
from spliceloom.plans.tables import CDS, DNA, GRAPH, MATRIX, VARIANTS, cds, edges, matrix, read, sequences, variants, vertices
from spliceloom.sources import readers as r
from spliceloom.sources import sinks
from spliceloom.staging import place, written


def _text(spark, df, name):
    """The path of a folder of lines, from one column."""
    path = place(spark, name)
    df.write.text(path)
    return path


def _lines(*columns):
    return F.concat_ws("\t", *[c.cast("string") for c in columns]).alias("value")


@query(f"WITH {MATRIX} SELECT kmer, ja AS \"junctionAnnotated\", rf AS \"readFrameAnnotated\", CAST(coalesce((SELECT sum(x) FROM m WHERE m.kmer = kf.kmer AND s IN (3, 12)), 0) AS DOUBLE) AS total FROM kf")
def matrix_files(spark, d):
    """The cohort matrix as a wide gzipped table with a header, and two samples of it by their names."""
    path = place(spark, "wide")
    sinks.write_table(sinks.wide(matrix(spark, d), [f"S-{k}" for k in range(25)]), path)
    table, names = r.kmer_matrix(spark, path, "tsv")
    at = r.positions(names, ["S_3", "S12"])
    return table.select("kmer", "junctionAnnotated", "readFrameAnnotated", sum(F.get("expr", F.lit(k)) for k in at).alias("total"))


@query(f"WITH {DNA} SELECT gene, 100 + gene % 300 AS start, substr(dna, CAST(101 + gene % 300 AS INT), CAST(400 + gene % 200 AS INT)) AS bases FROM dna")
def genome_files(spark, d):
    """Every sequence as a FASTA entry of many lines, read by line, and a stretch of each cut from its chunks."""
    entry = F.concat(F.lit("> c"), F.col("gene"), F.lit(" a sequence\n"), F.regexp_replace("dna", "(.{60})", "$1\n"))
    path = _text(spark, sequences(spark, d).select(entry.alias("value")), "fasta")
    start = 100 + F.col("c_custkey") % 300
    genes = read(spark, d, "customer").select(F.col("c_custkey").alias("gene"), F.concat(F.lit("c"), F.col("c_custkey")).alias("chrom"), start.alias("start"), (start + 400 + F.col("c_custkey") % 200).alias("stop"))
    return r.gene_sequences(genes, r.fasta_chunks(spark, path, 100), 100).select("gene", F.col("offset").alias("start"), F.col("dna").alias("bases"))


@query(f'WITH {CDS} SELECT CAST(gene AS VARCHAR) AS gene, CAST(tx AS VARCHAR) AS tx, strand, lft AS "left", rgt AS "right", phase FROM cds')
def annotation_files(spark, d):
    """Coding pieces as lines of an annotation file, with keys in their attributes."""
    c = cds(spark, d)
    attributes = F.format_string('gene_id "%s"; transcript_id "%s"; level 2;', F.col("gene").cast("string"), F.col("tx").cast("string"))
    lines = c.select(_lines(F.lit("1"), F.lit("made"), F.lit("CDS"), F.col("left") + 1, F.col("right"), F.lit("."), F.col("strand"), F.col("phase"), attributes))
    found = a.coding_pieces(r.annotation_lines(spark, _text(spark, lines, "gtf")))
    return found.select("gene", "tx", "strand", "left", "right", "phase")


@query(f"WITH {VARIANTS} SELECT sample, CAST(gene AS VARCHAR) AS chrom, pos, base AS alt, count(*) AS times FROM va WHERE base <> '*' GROUP BY ALL")
def maf_files(spark, d):
    """Variants as lines of a MAF table, of which only substitutions are read."""
    kind = F.when(F.col("base") == "*", "DEL").otherwise("SNP")
    named = {"Chromosome": F.col("gene"), "Start_Position": F.col("pos") + 1, "Variant_Type": kind, "Reference_Allele": F.lit("N"), "Tumor_Seq_Allele2": F.col("base"), "Tumor_Sample_Barcode": F.col("sample")}
    path = place(spark, "maf")
    variants(spark, d).select(*[c.alias(n) for n, c in named.items()]).write.option("sep", "\t").option("header", True).csv(path)
    found = r.maf_variants(spark, path)
    return found.groupBy("sample", "chrom", "pos", "alt").agg(F.count("*").alias("times"))


@query(f"WITH {VARIANTS} SELECT DISTINCT sample, CAST(gene AS VARCHAR) AS chrom, pos, base AS alt FROM va WHERE base <> '*' AND line % 3 > 0")
def vcf_files(spark, d):
    """Variants as lines of a VCF table with a genotype for each sample; those that a sample does not carry are left out."""
    names = [f"S{k}" for k in range(20)]
    rows = variants(spark, d).where("base != '*'")
    held = rows.groupBy("gene", "pos", "base").agg(F.collect_set(F.when(F.col("line") % 3 > 0, F.col("sample"))).alias("own"))
    gt = F.transform(F.array(*[F.lit(n) for n in names]), lambda n: F.when(F.array_contains("own", n), F.lit("0/1:9")).otherwise("0|0:9"))
    head = spark.createDataFrame([("##fileformat=VCFv4.2",), ("\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *names]),)], "value string")
    lines = held.select(_lines(F.col("gene"), F.col("pos") + 1, F.lit("."), F.lit("N"), F.col("base"), F.lit("."), F.lit("."), F.lit("."), F.lit("GT"), F.array_join(gt, "\t")))
    return r.vcf_variants(spark, _text(spark, head.unionByName(lines), "vcf")).select("sample", "chrom", "pos", "alt").distinct()


@query("""SELECT CASE event_id % 25 WHEN 22 THEN 'X' WHEN 23 THEN 'Y' WHEN 24 THEN 'MT' ELSE CAST(event_id % 25 + 1 AS VARCHAR) END AS chrom, user_id AS pos, coalesce('g' || (event_id % 7), 'S') AS sample, count(*) AS n
FROM events WHERE event_id % 3 < 2 GROUP BY ALL""")
def genotype_table(spark, d):
    """Genotypes with a variant allele, chromosomes by their names and samples by those of the graph."""
    e = F.col("event_id")
    table = read(spark, d, "events").select((e % 25 + 1).alias("chrom_code"), (F.col("user_id") + 1).alias("pos"), F.lit("A").alias("ref"), F.lit("C").alias("alt"), F.concat(F.lit("m"), e % 7).alias("sample"), (e % 3).alias("gt"))
    names = spark.range(7).select(F.concat(F.lit("g"), "id").alias("graph"), F.concat(F.lit("m"), "id").alias("mutation"))
    path = place(spark, "map")
    names.write.option("sep", "\t").option("header", True).csv(path)
    known = r.sample_map(spark, path).select("mutation", F.col("sample").alias("graph"))
    return r.renamed_samples(r.genotype_variants(table), known).groupBy("chrom", "pos", "sample").agg(F.count("*").alias("n"))


_INTRONS = """
it AS (SELECT ed.gene, x.strand, src AS v, dst AS w, CASE WHEN x.strand = '+' THEN x.stop ELSE y.stop END AS a, CASE WHEN x.strand = '+' THEN y.start ELSE x.start END AS b, x.l_partkey % 2 = 0 AS listed
       FROM ed JOIN vx x ON x.gene = ed.gene AND x.v = src JOIN vx y ON y.gene = ed.gene AND y.v = dst)
"""


@query(f"""WITH {CDS}, {GRAPH}, {_INTRONS}, wl AS (SELECT DISTINCT gene % 25 AS chrom, strand, a, b FROM it WHERE listed)
SELECT gene, v, w, CAST(EXISTS (SELECT 1 FROM wl WHERE wl.chrom = it.gene % 25 AND wl.strand = it.strand AND wl.a = it.a AND wl.b = it.b) AS INT) AS "isInJunctionList" FROM it""")
def junction_list_files(spark, d):
    """Whether the introns of edges stand in a list of junctions, which is read as lines of chromosome and a:b:strand."""
    vs = written(vertices(spark, d).select("gene", "v", "strand", "start", "stop", "l_partkey"), "vertices")
    pairs = edges(spark, d, vs).withColumnsRenamed({"src": "v", "dst": "w"}).join(vs.select("gene", "v", "strand", "start", "stop", "l_partkey"), ["gene", "v"])
    pairs = pairs.join(vs.select("gene", F.col("v").alias("w"), F.col("start").alias("start2"), F.col("stop").alias("stop2")), ["gene", "w"])
    pairs = pairs.withColumn("original", F.array(F.struct("start", "stop"), F.struct(F.col("start2").alias("start"), F.col("stop2").alias("stop")))).withColumn("chrom", (F.col("gene") % 25).cast("string"))
    plus = F.col("strand") == "+"
    listed = pairs.where("l_partkey % 2 = 0").select(_lines(F.col("chrom"), F.concat_ws(":", F.when(plus, F.col("stop")).otherwise(F.col("stop2")), F.when(plus, F.col("start2")).otherwise(F.col("start")), "strand"))).distinct()
    return p.junction_listed(pairs, r.junction_whitelist(spark, _text(spark, listed, "junctions")))


@query(f"WITH {CDS}, {GRAPH} SELECT gene, v, row_number() OVER (PARTITION BY gene ORDER BY CASE WHEN strand = '+' THEN start ELSE -stop END, v) - 1 AS place FROM vx")
def vertex_order(spark, d):
    """Reading order of the vertices of every gene."""
    return g.vertex_order(vertices(spark, d)).select("gene", "v", F.col("place").cast("long").alias("place"))


@query(f"""WITH {CDS}, {GRAPH}, bo AS (SELECT gene, src AS v, dst AS w FROM ed UNION SELECT gene, dst, src FROM ed),
f AS (SELECT bo.gene, bo.v, bo.w FROM bo JOIN vx x ON x.gene = bo.gene AND x.v = bo.v JOIN vx y ON y.gene = bo.gene AND y.v = bo.w WHERE CASE WHEN x.strand = '+' THEN y.start >= x.start ELSE y.stop <= x.stop END)
SELECT vx.gene, vx.v, f.w AS follows FROM vx LEFT JOIN f ON f.gene = vx.gene AND f.v = vx.v""")
def successors(spark, d):
    """Vertices that follow each in reading order, from edges of either direction."""
    vs = written(vertices(spark, d).select("gene", "v", "strand", "start", "stop", "l_partkey"), "vertices")
    return g.successors(vs, edges(spark, d, vs))


@query(f"""WITH {CDS}, {GRAPH}, n AS (SELECT gene, count(*) AS n FROM vx GROUP BY gene)
SELECT gene, n AS n_vertices FROM n WHERE gene >= 10 AND gene < 10 + (SELECT max(o_orderkey) FROM orders) // 2 AND gene % 25 IN (1, 2, 3) AND n <= 4 AND gene IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')""")
def chosen_genes(spark, d):
    """Genes by running number, chromosome, size of graph and a list that is read from a file."""
    genes = vertices(spark, d).groupBy("gene").agg(F.count("*").alias("n_vertices")).select(F.col("gene").cast("string").alias("gene"), F.col("gene").alias("gene_idx"), (F.col("gene") % 25).cast("string").alias("chrom"), "n_vertices")
    listed = read(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").cast("string").alias("value"))
    half = read(spark, d, "orders").agg(F.max("o_orderkey")).first()[0] // 2
    found = p.chosen_genes(genes, 10, half, r.gene_list(spark, _text(spark, listed, "genes")), ["1", "2", "3"], 4)
    return found.select(F.col("gene").cast("long").alias("gene"), "n_vertices")


@query(f"WITH {CDS}, {_GENES}, l AS (SELECT pos, quantile_cont(expr, 0.75) AS q FROM ge GROUP BY pos) SELECT pos, round(q / 7, 6) AS divisor FROM l")
def library_files(spark, d):
    """Library sizes upserted as a swapped table, written with sample names and read as divisors."""
    from spliceloom.operators.expression import library_size

    folder, sizes = place(spark, "sizes"), library_size(_genes(spark, d))
    sinks.upsert_sizes(sizes.withColumn("libsize_75percent", F.lit(1.0)), folder)
    table = sinks.upsert_sizes(sizes, folder)
    path = place(spark, "libsize")
    sinks.write_table(table.select(F.concat(F.lit("sample_"), "pos").alias("sample"), "libsize_75percent", "libsize_total_count"), path)
    return r.library_divisors(spark, path, ["sample0", "sample1", "sample2"], 7.0).select("pos", F.round("divisor", 6).alias("divisor"))


@query(f"WITH {CDS}, {GRAPH} SELECT gene // 1000 AS batch, l_partkey % 2 = 0 AS \"isCrossJunction\", count(*) AS n, CAST(sum(start) AS BIGINT) AS total FROM vx GROUP BY ALL")
def matrix_batches(spark, d):
    """Rows of genes written in resumable batches, partitioned by kind, with files of bounded size, and read again."""
    genes = read(spark, d, "orders").select(F.col("o_orderkey").alias("gene_idx"), F.col("o_orderkey").alias("gene"))
    rows = vertices(spark, d).select("gene", (F.col("l_partkey") % 2 == 0).alias("isCrossJunction"), "start")
    last, folder = genes.agg(F.max("gene_idx")).first()[0], place(spark, "batches")
    size = 1000 * max(1, -(-last // 4000))  # four batches or less, whatever the table's size
    batches = sinks.gene_batches(genes, lambda some: rows.join(some.select("gene"), "gene", "left_semi"), size)
    sinks.write_batches(spark, folder, dict(list(batches.items())[:1]), ["isCrossJunction"], 10_000)
    sinks.write_batches(spark, folder, batches, ["isCrossJunction"], 10_000)
    found = sinks.read_batches(spark, folder)
    return found.groupBy(F.expr("gene div 1000").alias("batch"), "isCrossJunction").agg(F.count("*").alias("n"), F.sum("start").cast("long").alias("total"))


@query(f"""WITH {CDS}, {GRAPH} SELECT gene, count(*) AS n_segments, sum(quantity) AS first, sum(quantity * 2) AS second, sum(quantity + 1) AS third FROM vx GROUP BY gene""")
def count_store(spark, d):
    """Tables of a splice graph and its counts, written with their fixed columns and read and checked as a store."""
    vs = written(vertices(spark, d).select("gene", "v", "strand", "start", "stop", "quantity", "l_partkey"), "vertices")
    folder = place(spark, "store")
    text = F.col("gene").cast("string").alias("gene")
    tables = {
        "genes": vs.select(text, "strand").distinct().select(F.lit(0).alias("gene_idx"), "gene", F.lit("1").alias("chrom"), "strand", F.lit(0).alias("start"), F.lit(0).alias("stop"), F.lit(0).alias("n_vertices")),
        "vertices": vs.select(text, "v", "start", "stop", "strand"),
        "edges": edges(spark, d, vs).select(text, "src", "dst"),
        "segments": vs.select(text, F.col("v").alias("seg_id"), F.col("start").alias("seg_start"), F.col("stop").alias("seg_stop")),
        "seg_edges": vs.select(text, F.col("stop").alias("left_stop"), F.col("start").alias("right_start")),
        "segment_counts": vs.select(text, F.col("v").alias("seg_id"), _counts(F.col("quantity")).alias("counts")),
        "edge_counts": vs.limit(0).select(text, F.col("stop").alias("left_stop"), F.col("start").alias("right_start"), _counts(F.col("quantity")).alias("counts")),
        "samples": spark.createDataFrame([(0, "a-1"), (1, "b"), (2, "c")], "pos int, sample string"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    graph = r.graph_tables(spark, folder)
    counts, _ = r.count_store(spark, folder, graph)
    rows = graph["segments"].join(counts["segment_counts"], ["gene", "seg_id"])
    each = [F.sum(F.get("counts", F.lit(k))).alias(n) for k, n in enumerate(("first", "second", "third"))]
    return rows.groupBy(F.col("gene").cast("long").alias("gene")).agg(F.count("*").alias("n_segments"), *each)


@query("""WITH w AS (SELECT DISTINCT upper(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS w FROM benchmark), e AS (SELECT DISTINCT 'P' || p_partkey AS w FROM part WHERE p_size > 10)
SELECT 'known' AS list, translate(w, 'I', 'L') AS kmer FROM w GROUP BY ALL UNION ALL SELECT 'external', w FROM e UNION ALL SELECT 'fasta', k FROM
(SELECT DISTINCT unnest(list_transform(range(1, CAST(length(n) - 7 AS BIGINT)), lambda i: substr(n, CAST(i AS INT), 9))) AS k FROM (SELECT upper(replace(p_name, ' ', '')) AS n FROM part) WHERE length(n) >= 9)""")
def kmer_lists(spark, d):
    """Known k-mers, external k-mers and those of a FASTA result, each written as its kind of list and read."""
    words = read(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w")).select(F.upper("w").alias("value")).distinct()
    known = r.known_kmers(spark, _text(spark, words, "known")).distinct()
    path = place(spark, "external")
    read(spark, d, "part").where("p_size > 10").select(F.concat(F.lit("P"), "p_partkey").alias("kmer")).write.option("sep", "\t").option("header", True).csv(path)
    fasta = place(spark, "peptides")
    names = read(spark, d, "part").select("p_partkey", F.upper(F.replace("p_name", F.lit(" "), F.lit(""))).alias("n"))
    sinks.write_fasta(names, "p_partkey", "n", fasta)
    tables = {"known": known, "external": r.external_kmers(spark, path), "fasta": r.fasta_kmers(spark, fasta, 9).select("kmer").distinct()}
    rows = [df.select(F.lit(name).alias("list"), "kmer") for name, df in tables.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(f"WITH {CDS}, {GRAPH} SELECT gene, CAST(least(src, dst) AS INT) AS src, CAST(greatest(src, dst) AS INT) AS dst FROM ed GROUP BY ALL")
def edge_lists(spark, d):
    """Edges as rows of an adjacency matrix of each gene, and back from its upper triangle."""
    both = edges(spark, d)
    both = both.unionByName(both.select("gene", F.col("dst").alias("src"), F.col("src").alias("dst")))
    rows = both.groupBy("gene", "src").agg(F.collect_set("dst").alias("to"))
    row = F.transform(F.sequence(F.lit(0), F.array_max("to")), lambda k: F.array_contains("to", k).cast("int"))
    found = g.edge_list(rows.select("gene", "src", row.alias("row")))
    return found.select("gene", F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"))


@query("""SELECT 'repeated' AS problem, CAST(l_partkey AS VARCHAR) || ':' || l_suppkey AS key FROM lineitem GROUP BY l_partkey, l_suppkey HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'missing', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def input_problems(spark, d):
    """What the checks of inputs report: repeated keys, and keys that another table lacks."""
    from spliceloom.operators.quality import missing, repeated

    twice = repeated(read(spark, d, "lineitem"), "l_partkey", "l_suppkey").select(F.lit("repeated").alias("problem"), F.concat_ws(":", "l_partkey", "l_suppkey").alias("key"))
    known = read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return twice.unionByName(missing(read(spark, d, "customer"), known, "c_custkey").select(F.lit("missing").alias("problem"), F.col("c_custkey").cast("string").alias("key")))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN l_partkey <= l_suppkey * 20 ELSE l_partkey >= l_suppkey * 20 END AS follows, l_suppkey < l_quantity AND l_quantity < l_suppkey + 30 AS inside, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""")
def strand_order(spark, d):
    """Places compared in reading order on either strand, and strictly within bounds."""
    from spliceloom.functions.seq import inside_open, strand_leq

    rows = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    strand = F.when(F.col("o_orderkey") % 2 == 0, "+").otherwise("-")
    follows = strand_leq(strand, F.col("l_partkey"), F.col("l_suppkey") * 20)
    inside = inside_open(F.col("l_quantity"), F.col("l_suppkey"), F.col("l_suppkey") + 30)
    return rows.groupBy(F.col("o_orderkey").alias("id"), follows.alias("follows"), inside.alias("inside")).agg(F.count("*").alias("n"))
