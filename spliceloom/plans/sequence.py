"""Queries of translation, variants, tiling and coordinates."""

from __future__ import annotations

from pyspark.sql import functions as F

from spliceloom.functions import seq as s
from spliceloom.operators import annotation as a
from spliceloom.operators import expression as e
from spliceloom.plans import query
from spliceloom.plans.tables import CDS, DNA, VARIANTS, cds, dna_of, read, reverse_complement_sql, sequences, translated_sql, variants, variants_sql


@query(f"""WITH {DNA}, t AS (SELECT gene, {translated_sql('dna')} AS r FROM dna)
SELECT gene, r AS residues, string_split(r, '_')[1] AS peptide, contains(r, '_') AS has_stop, CAST(len(string_split(r, '_')) AS INT) AS n_pieces FROM t""")
def translate_dna(spark, d):
    dna = F.col("dna")
    return sequences(spark, d).select("gene", s.residues(dna).alias("residues"), s.peptide(dna).alias("peptide"), s.has_stop(dna).alias("has_stop"), F.size(s.peptides(dna)).alias("n_pieces"))


@query(f"WITH {DNA} SELECT gene, {reverse_complement_sql('dna')} AS rc, translate(dna, 'ACGT', 'TGCA') AS complement FROM dna")
def reverse_complement(spark, d):
    return sequences(spark, d).select("gene", s.reverse_complement(F.col("dna")).alias("rc"), s.complement(F.col("dna")).alias("complement"))


@query(f"""WITH {DNA}, {variants_sql('customer', 'c_custkey')}, lv AS (SELECT gene, pos, max_by(base, line) AS base FROM va GROUP BY gene, pos),
b AS (SELECT dna.gene, p.p - 1 AS pos, substr(dna, CAST(p.p AS INT), 1) AS ref FROM dna, (SELECT unnest(range(1, 1025)) AS p) p)
SELECT b.gene, string_agg(CASE WHEN lv.base IS NULL OR lv.base = '*' THEN ref ELSE lv.base END, '' ORDER BY b.pos) AS mutated
FROM b LEFT JOIN lv ON lv.gene = b.gene AND lv.pos = b.pos WHERE b.gene IN (SELECT gene FROM lv) GROUP BY b.gene""")
def apply_snps(spark, d):
    held = variants(spark, d, "customer", "c_custkey").groupBy("gene", "pos").agg(F.max_by("base", "line").alias("base"))
    lists = held.groupBy("gene").agg(F.collect_list(F.struct("pos", "base")).alias("variants"))
    # bases are made of genes with variants only, behind the join, as others are not in the result
    rows = read(spark, d, "customer").select(F.col("c_custkey").alias("gene")).hint("merge").join(lists, "gene").withColumn("dna", dna_of(F.col("gene")))
    return rows.select("gene", s.with_variants(F.col("dna"), F.lit(0), F.col("variants")).alias("mutated"))


@query(f"""WITH {VARIANTS}, l AS (SELECT sample, gene, list(pos ORDER BY pos) AS ps FROM (SELECT DISTINCT sample, gene, pos FROM va) GROUP BY ALL),
c AS (SELECT sample, gene, ps, unnest(range(0, CAST(1 << len(ps) AS BIGINT))) AS mask FROM l)
SELECT sample, gene, array_to_string(list_filter(ps, lambda p, i: (mask >> (i - 1)) & 1 = 1), ';') AS combination FROM c""")
def variant_combos(spark, d):
    held = variants(spark, d).groupBy("sample", "gene").agg(F.array_sort(F.collect_set("pos")).alias("ps"))
    return s.with_combinations(held, "ps", "c").select("sample", "gene", F.concat_ws(";", F.col("c").cast("array<string>")).alias("combination"))


@query(f"""WITH {DNA}, p AS (SELECT gene, string_split({translated_sql('dna')}, '_')[1] AS peptide FROM dna)
SELECT gene, i AS pos, substr(peptide, CAST(i + 1 AS INT), 9) AS kmer FROM (SELECT gene, peptide, unnest(range(0, CAST(length(peptide) - 8 AS BIGINT))) AS i FROM p WHERE length(peptide) >= 9)""")
def tile_kmers(spark, d):
    rows = sequences(spark, d).select("gene", s.peptide(F.col("dna")).alias("p"))
    return rows.select("gene", F.posexplode(s.kmers(F.col("p"), 9)).alias("i", "kmer")).select("gene", F.col("i").cast("long").alias("pos"), "kmer")


_PAIR = """
pr AS (SELECT a.tx, a.line, a.strand, a.lft AS l1, a.rgt AS r1, b.lft AS l2, b.rgt AS r2 FROM cds a JOIN cds b ON a.tx = b.tx AND b.line = a.line + 1),
kp AS (SELECT *, unnest(range(0, (r1 - l1 + r2 - l2) // 3 - 8)) AS pos FROM pr WHERE (r1 - l1 + r2 - l2) // 3 >= 9)
"""


def _pairs(spark, d):
    c = cds(spark, d)
    first = c.select("tx", "line", "strand", F.col("left").alias("l1"), F.col("right").alias("r1"))
    second = c.select("tx", (F.col("line") - 1).alias("line"), F.col("left").alias("l2"), F.col("right").alias("r2"))
    count = F.floor((F.col("r1") - F.col("l1") + F.col("r2") - F.col("l2")) / 3).cast("int") - 8
    return first.join(second, ["tx", "line"]).withColumn("n", count).where("n > 0")


@query(f"WITH {CDS}, {_PAIR} SELECT tx, line, CAST(count(*) AS BIGINT) AS n_spanning, CAST(min(pos) AS INT) AS first_pos FROM kp WHERE 3 * pos < r1 - l1 AND 3 * (pos + 9) > r1 - l1 GROUP BY tx, line")
def spanning_kmers(spark, d):
    rows = _pairs(spark, d).withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).where(s.spans_junction(F.col("pos"), 9, F.col("r1") - F.col("l1")))
    return rows.groupBy("tx", "line").agg(F.count("*").alias("n_spanning"), F.min("pos").alias("first_pos"))


@query(f"""WITH {CDS}, {_PAIR}, o AS (SELECT *, CASE WHEN strand = '+' THEN r1 - l1 ELSE r2 - l2 END AS n1, CASE WHEN strand = '+' THEN l1 ELSE l2 END AS fl, CASE WHEN strand = '+' THEN r1 ELSE r2 END AS fr,
CASE WHEN strand = '+' THEN l2 ELSE l1 END AS sl, CASE WHEN strand = '+' THEN r2 ELSE r1 END AS sr FROM kp),
x AS (SELECT tx, line, pos, strand, CASE WHEN 3 * pos < n1 THEN CASE WHEN strand = '+' THEN (fl + 3 * pos) || ':' || least(fl + 3 * pos + 27, fr) ELSE greatest(fr - 3 * pos - 27, fl) || ':' || (fr - 3 * pos) END END AS p1,
CASE WHEN 3 * pos + 27 > n1 THEN CASE WHEN strand = '+' THEN (sl + greatest(3 * pos - n1, 0)) || ':' || (sl + 3 * pos + 27 - n1) ELSE (sr - (3 * pos + 27 - n1)) || ':' || (sr - greatest(3 * pos - n1, 0)) END END AS p2 FROM o)
SELECT tx, line, CAST(pos AS INT) AS pos, coalesce(p1, p2) || ':' || CASE WHEN p1 IS NULL OR p2 IS NULL THEN 'nan:nan' ELSE p2 END || ':None:None' AS coord FROM x""")
def kmer_coords(spark, d):
    part = lambda left, right: F.struct(F.col(left).alias("start"), F.col(right).alias("stop"))
    rows = _pairs(spark, d)
    parts = F.when(F.col("strand") == "+", F.array(part("l1", "r1"), part("l2", "r2"))).otherwise(F.array(part("l2", "r2"), part("l1", "r1")))
    placed = s.with_kmers(rows.select("tx", "line", "strand", "n", parts.alias("parts")), 9, "n")
    return placed.select("tx", "line", "pos", s.coordinate_text(F.col("parts")).alias("coord"))


@query("""WITH t AS (SELECT p_partkey, upper(replace(p_name, ' ', '')) || 'ABAB' AS f, 'ABABA' || p_brand AS b FROM part)
SELECT p_partkey, (SELECT f || substr(b, CAST(max(n) + 1 AS INT)) FROM (SELECT unnest(range(1, CAST(least(length(f), length(b)) + 1 AS BIGINT))) AS n) WHERE right(f, CAST(n AS INT)) = left(b, CAST(n AS INT))) AS joined FROM t""")
def overlap_concat(spark, d):
    rows = read(spark, d, "part").select("p_partkey", F.concat(F.upper(F.replace("p_name", F.lit(" "), F.lit(""))), F.lit("ABAB")).alias("f"), F.concat(F.lit("ABABA"), "p_brand").alias("b"))
    return rows.select("p_partkey", s.overlap_joined(F.col("f"), F.col("b")).alias("joined"))


@query("""WITH t AS (SELECT p_partkey, upper(replace(p_name, ' ', '')) || 'ABAB' AS f, 'ABABA' || p_brand AS b, p_partkey * 7 % 1000 AS x, p_partkey * 7 % 1000 + p_size AS y FROM part)
SELECT p_partkey, CASE WHEN (y - x) % 3 = 0 THEN f || substr(b, 5) END AS joined FROM t""")
def overlap_in_frame(spark, d):
    """Overlaps of the pieces of `overlap_concat` that put both into one frame."""
    rows = read(spark, d, "part").select("p_partkey", "p_size", F.concat(F.upper(F.replace("p_name", F.lit(" "), F.lit(""))), F.lit("ABAB")).alias("f"), F.concat(F.lit("ABABA"), "p_brand").alias("b"))
    start = F.col("p_partkey") * 7 % 1000
    return rows.select("p_partkey", s.overlap_joined(F.col("f"), F.col("b"), start, start + F.col("p_size")).alias("joined"))


_FIRST = """
fc AS (SELECT tx, gene, strand, lft, rgt, phase FROM (SELECT *, row_number() OVER (PARTITION BY tx ORDER BY CASE WHEN strand = '+' THEN lft ELSE -rgt END, line DESC) AS n FROM cds) WHERE n = 1)
"""


@query(f'WITH {CDS}, {_FIRST} SELECT tx, gene, strand, lft AS "left", rgt AS "right", phase FROM fc')
def first_cds(spark, d):
    return a.first_cds(cds(spark, d))


@query(f"WITH {CDS} SELECT DISTINCT gene, a, b FROM (SELECT gene, rgt AS a, lead(lft) OVER (PARTITION BY tx ORDER BY lft, line) AS b FROM cds) WHERE b IS NOT NULL")
def annotated_junctions(spark, d):
    return a.annotated_junctions(cds(spark, d))


@query(f"WITH {CDS} SELECT gene, array_to_string(list_sort(list(DISTINCT tx)), ',') AS transcripts FROM cds GROUP BY gene")
def gene_transcripts(spark, d):
    return a.gene_transcripts(cds(spark, d)).select("gene", F.concat_ws(",", F.col("transcripts").cast("array<string>")).alias("transcripts"))


_BACKGROUND = f"""
pc AS (SELECT cds.gene, tx, strand, string_agg(substr(dna, lft + 1, rgt - lft), '' ORDER BY lft, line) AS whole FROM cds JOIN dna USING (gene) GROUP BY ALL),
rd AS (SELECT pc.gene, pc.tx, substr(CASE WHEN pc.strand = '+' THEN whole ELSE {reverse_complement_sql('whole')} END, ph.phase + 1) AS coding
       FROM pc JOIN (SELECT tx, CASE WHEN strand = '+' THEN min_by(phase, lft * 10 + line) ELSE max_by(phase, lft * 10 + line) END AS phase FROM cds GROUP BY tx, strand) ph USING (tx)),
bp AS (SELECT DISTINCT gene, tx, string_split({translated_sql('coding')}, '_')[1] AS peptide FROM rd)
"""


@query(f"WITH {CDS}, {DNA}, {_BACKGROUND} SELECT gene, tx, peptide FROM bp WHERE peptide <> ''")
def background_peptides(spark, d):
    return a.background_peptides(cds(spark, d), sequences(spark, d))


@query(f"""WITH {CDS}, {DNA}, {_BACKGROUND} SELECT DISTINCT kmer FROM (SELECT unnest(list_transform(range(1, CAST(length(peptide) - 7 AS BIGINT)), lambda i: substr(peptide, CAST(i AS INT), 9))) AS kmer FROM bp WHERE length(peptide) >= 9)""")
def background_kmers(spark, d):
    return a.background_kmers(a.background_peptides(cds(spark, d), sequences(spark, d)), 9)


@query(f"""WITH {VARIANTS} SELECT sample, CAST(gene AS VARCHAR) AS chrom, pos, max_by(base, line) AS alt FROM va WHERE base <> '*' GROUP BY sample, gene, pos""")
def last_variants(spark, d):
    rows = variants(spark, d).where("base != '*'").select("sample", F.col("gene").cast("string").alias("chrom"), "pos", F.lit("N").alias("ref"), F.col("base").alias("alt"), "line")
    return e.last_variants(e.single_base(rows)).drop("ref")


@query(f"""WITH {CDS}, {DNA}, {_BACKGROUND} SELECT gene, tx, peptide, CAST(row_number() OVER (PARTITION BY gene ORDER BY tx, peptide) - 1 AS INT) AS variant_no FROM bp WHERE peptide <> ''""")
def numbered_peptides(spark, d):
    return e.numbered(a.background_peptides(cds(spark, d), sequences(spark, d)), ["gene"], ["tx", "peptide"])


@query(f"""WITH {CDS}, {DNA}, {_BACKGROUND} SELECT gene, tx, '>' || gene || ':' || tx || chr(10) || peptide AS fasta FROM bp WHERE peptide <> ''""")
def peptide_fasta(spark, d):
    from spliceloom.sources.sinks import fasta_lines

    rows = a.background_peptides(cds(spark, d), sequences(spark, d)).withColumn("id", F.concat_ws(":", "gene", "tx"))
    return fasta_lines(rows, "id", "peptide", keep=["gene", "tx"])


@query(f"""WITH {DNA}, p AS (SELECT gene, string_split({translated_sql('dna')}, '_')[1] AS peptide FROM dna), k AS (SELECT gene, unnest(range(0, CAST(length(peptide) - 8 AS BIGINT))) AS pos FROM p WHERE length(peptide) >= 9)
SELECT gene, count(*) AS n_kmers, CAST(0 AS BIGINT) AS n_mismatch FROM k GROUP BY gene""")
def roundtrip_check(spark, d):
    """Each k-mer's genomic pieces, cut from the genome and translated again, give the k-mer."""
    from spliceloom.operators.quality import roundtrip

    rows = sequences(spark, d).withColumn("peptide", s.peptide(F.col("dna")))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.lit(400).alias("stop")), F.struct(F.lit(400).alias("start"), F.lit(1024).alias("stop")))
    placed = s.with_kmers(rows.select("gene", "peptide", whole.alias("parts"), F.lit("+").alias("strand")), 9)
    return roundtrip(placed, sequences(spark, d))
