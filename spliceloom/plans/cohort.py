"""Queries of the cohort filters, specificity, scoring and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from spliceloom.operators import cohort as c
from spliceloom.operators import specificity as sp
from spliceloom.plans import query
from spliceloom.plans.tables import CANCER, COHORTS, MATRIX, NORMAL, SPLIT, TARGET, cohort_matrices, matrix, read, split_matrices
from spliceloom.staging import written

X, H = 60.0, 5  # expression that counts as support, and samples that make recurrence


def _parts(spark, d, where):
    return read(spark, d, "part").where(where).select(F.concat(F.lit("P"), F.col("p_partkey")).alias("kmer"))


_SUPPORT = f"""
su AS (SELECT kmer, count(*) FILTER (s BETWEEN 12 AND 24 AND x >= {X}) AS n_high, count(*) FILTER (s BETWEEN 12 AND 24 AND x > 0) AS n_any,
       count(*) FILTER (s <= 11 AND s <> {TARGET} AND x >= {X}) AS c_high, count(*) FILTER (s <= 11 AND s <> {TARGET} AND x > 0) AS c_any,
       coalesce(max(x) FILTER (s = {TARGET}), 0) AS own, count(*) FILTER (x <> 0) AS present FROM m GROUP BY kmer)
"""


#: Of the two cohort matrices: expression of the target, support in the others of its cohort, and of normals, by k-mer.
OWN, HIGH, LOUD, MANY = 20.0, 15.0, 30.0, 2
_COHORT = f"""
cs AS (SELECT kmer, max(CASE WHEN s = {TARGET} THEN x ELSE 0 END) AS own, count(*) FILTER (s <> {TARGET} AND x >= {HIGH}) AS high FROM cm GROUP BY kmer),
ns AS (SELECT nk.kmer, count(x) FILTER (x > 0) AS n_any, coalesce(max(x), 0) AS top FROM nk LEFT JOIN nm ON nm.kmer = nk.kmer GROUP BY nk.kmer),
cf AS (SELECT cs.*, n_any, top FROM cs LEFT JOIN ns ON ns.kmer = cs.kmer)
"""


@query(f"""WITH {COHORTS}, {_COHORT} SELECT kmer, CAST(own AS DOUBLE) AS own FROM cf
WHERE own >= {OWN} AND high >= 1 AND (n_any IS NULL OR n_any BETWEEN 1 AND {MANY - 1} AND top < {LOUD})
AND kmer NOT IN (SELECT 'P' || p_partkey || '.1' FROM part WHERE p_retailprice > 1800)
AND kmer NOT IN (SELECT 'P' || p_partkey || '.2' FROM part WHERE p_size = 7)""")
def diff_filter(spark, d):
    """Of a cancer and a normal matrix; k-mers of cancer alone stay, those that normals have without expression go."""
    return filtered(spark, d)


def filtered(spark, d, normal_at_least=LOUD):
    """The differential filter of the target against external and known k-mers too; own is its expression."""
    cancer, normal = cohort_matrices(spark, d)
    cancer = written(cancer, "cancer")
    listed = lambda where, line: _parts(spark, d, where).select(F.concat("kmer", F.lit(line)).alias("kmer"))
    out = c.cohort_filter(cancer, normal, CANCER, NORMAL, TARGET, OWN, HIGH, 1, normal_at_least, MANY, listed("p_size = 7", ".2"), listed("p_retailprice > 1800", ".1"))
    return out.select("kmer", F.get("expr", F.lit(TARGET)).alias("own"))


_GRID = {"sample": [1.0, 20.0, 40.0], "cohort": [1.0, 15.0, 30.0], "normal": [1.0, 30.0, 60.0]}


@query(f"""WITH {COHORTS}, tg AS (SELECT unnest(range(0, 12)) AS target), lv AS (SELECT a, b, e FROM (SELECT unnest({_GRID["sample"]}) AS a), (SELECT unnest({_GRID["cohort"]}) AS b), (SELECT unnest({_GRID["normal"]}) AS e)),
ow AS (SELECT kmer, target, coalesce(max(x) FILTER (s = target), 0) AS own, count(*) FILTER (s <> target AND x >= 1) AS h0, count(*) FILTER (s <> target AND x >= 15) AS h1, count(*) FILTER (s <> target AND x >= 30) AS h2 FROM cm, tg GROUP BY ALL),
ns AS (SELECT nk.kmer, coalesce(max(x), 0) AS top FROM nk LEFT JOIN nm ON nm.kmer = nk.kmer GROUP BY nk.kmer)
SELECT CAST(target AS INT) AS target, CAST(a AS DOUBLE) AS sample_at_least, CAST(b AS DOUBLE) AS cohort_at_least, CAST(r AS INT) AS recurrence, CAST(e AS DOUBLE) AS normal_at_least, count(*) AS n_kmers
FROM (SELECT ow.*, top FROM ow LEFT JOIN ns ON ns.kmer = ow.kmer) k, lv, (SELECT unnest(range(1, 13)) AS r) WHERE own >= a AND CASE b WHEN 1 THEN h0 WHEN 15 THEN h1 ELSE h2 END >= r AND (top IS NULL OR top > 0 AND top < e) GROUP BY ALL""")
def threshold_grid(spark, d):
    """Counts for every target and setting of the filter from one reading of both matrices."""
    return c.threshold_grid(*cohort_matrices(spark, d), CANCER, CANCER, NORMAL, _GRID["sample"], _GRID["cohort"], _GRID["normal"])


@query(f"""WITH {COHORTS}, {_COHORT} SELECT kmer, CASE WHEN own < {OWN} THEN 'sample' WHEN high < 1 THEN 'cohort' ELSE 'normal' END AS rule FROM cf
WHERE own < {OWN} OR high < 1 OR top >= {LOUD} OR n_any >= {MANY}""")
def failing_kmers(spark, d):
    """All k-mers of the cancer matrix, held as a result against the raw matrices, with the rule that each breaks."""
    cancer, normal = cohort_matrices(spark, d)
    cancer = written(cancer, "cancer")
    return c.failing(cancer.select("kmer"), cancer, normal, CANCER, NORMAL, TARGET, OWN, HIGH, 1, LOUD, MANY)


@query(f"""WITH {SPLIT} SELECT kmer, kind, CAST(sum(x) AS DOUBLE) AS total FROM (SELECT *, 'segment' AS kind FROM seg UNION ALL SELECT *, 'junction' FROM jun) GROUP BY kmer, kind""")
def combined_normals(spark, d):
    """All rows of both matrices; a k-mer of both keeps both."""
    segment, junction = (m.withColumn("kind", F.lit(kind)) for m, kind in zip(split_matrices(spark, d), ("segment", "junction")))
    return c.combined_normals(segment, junction).select("kmer", "kind", F.aggregate("expr", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query(f"WITH {MATRIX}, {_SUPPORT} SELECT kmer, CAST(n_high AS INT) AS n_high, CAST(n_any AS INT) AS n_any FROM su WHERE n_any > 0")
def recurrence_counts(spark, d):
    m = matrix(spark, d)
    return m.select("kmer", c.support(F.col("expr"), X, NORMAL).alias("n_high"), c.support(F.col("expr"), 0, NORMAL).alias("n_any")).where("n_any > 0")


@query(f"WITH {MATRIX}, {_SUPPORT} SELECT kmer FROM su WHERE n_high >= 1 OR n_any >= {H} UNION SELECT 'P' || p_partkey FROM part WHERE p_size = 7")
def normal_background(spark, d):
    own = c.normal_background(matrix(spark, d), NORMAL, X, H)
    return own.unionByName(_parts(spark, d, "p_size = 7")).distinct()


@query(f"WITH {MATRIX} SELECT kmer, CAST(sum(x) AS DOUBLE) AS total, sum(CASE WHEN s >= 12 THEN x ELSE 0 END) = 0 AS silent FROM m GROUP BY kmer")
def annotation_only_split(spark, d):
    m = matrix(spark, d)
    normals = F.slice("expr", 13, 13)
    return m.select("kmer", F.aggregate("expr", F.lit(0.0), lambda a, x: a + x).alias("total"), c.annotation_only(normals).alias("silent"))


@query(f"""WITH {MATRIX}, t AS (SELECT s, list_sort(list(x)) AS l, count(*) AS c FROM m GROUP BY s), n AS (SELECT 0.75 * (count(*) - 1) AS i, count(*) AS n FROM kf),
r AS (SELECT s, l, i, CAST(floor(i) AS BIGINT) - (n - c) + 1 AS low, CAST(ceil(i) AS BIGINT) - (n - c) + 1 AS high FROM t, n),
v AS (SELECT s, i - floor(i) AS part, CASE WHEN low > 0 THEN l[low] ELSE 0 END AS a, CASE WHEN high > 0 THEN l[high] ELSE 0 END AS b FROM r),
dv AS (SELECT s, greatest(a + (b - a) * part, 1) / 40 AS divisor FROM v)
SELECT kmer, CAST(s AS INT) AS pos, round(x / divisor, 2) AS x FROM m JOIN dv USING (s) WHERE x > 0""")
def libsize_normalise(spark, d):
    from spliceloom.operators.expression import divisors

    m = matrix(spark, d)
    long = m.select(F.posexplode("expr").alias("pos", "x"))
    sizes = long.groupBy("pos").agg(F.greatest(F.percentile("x", 0.75), F.lit(1.0)).alias("libsize_75percent"))
    return c.normalised(m, divisors(sizes, 40.0)).select("kmer", F.posexplode("expr").alias("pos", "x")).where("x > 0")


@query(f"WITH {MATRIX}, {_SUPPORT} SELECT kmer, CAST(own AS DOUBLE) AS own FROM su WHERE own >= 40")
def sample_support(spark, d):
    return c.sample_support(matrix(spark, d), TARGET, 40.0).select("kmer", F.get("expr", F.lit(TARGET)).alias("own"))


@query(f"WITH {MATRIX}, {_SUPPORT} SELECT kmer FROM su WHERE c_high >= 2")
def cohort_support(spark, d):
    return c.cohort_support(matrix(spark, d), CANCER, X, 2, TARGET)


@query(f"WITH {MATRIX}, {_SUPPORT} SELECT kmer FROM su WHERE own >= 40 AND c_any >= 6")
def support_intersect(spark, d):
    m = matrix(spark, d)
    return c.supported(c.sample_support(m, TARGET, 40.0), c.cohort_support(m, CANCER, 0, 6, TARGET), m).select("kmer")


@query(f"WITH {MATRIX}, {_SUPPORT} SELECT kmer FROM su WHERE own >= 40 OR c_any >= 6")
def support_union(spark, d):
    m = matrix(spark, d)
    return c.supported(c.sample_support(m, TARGET, 40.0), c.cohort_support(m, CANCER, 0, 6, TARGET), m, union=True).select("kmer")


@query(f"""WITH {SPLIT} SELECT kmer, 'junction' AS kind, CAST(sum(x) AS DOUBLE) AS total FROM jun GROUP BY kmer
UNION ALL SELECT kmer, 'segment', CAST(sum(x) AS DOUBLE) FROM seg WHERE kmer NOT IN (SELECT kmer FROM jun) GROUP BY kmer""")
def prefer_junction(spark, d):
    segment, junction = (m.withColumn("kind", F.lit(kind)) for m, kind in zip(split_matrices(spark, d), ("segment", "junction")))
    return c.prefer_junction(segment, junction).select("kmer", "kind", F.aggregate("expr", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query(f"""WITH {MATRIX} SELECT DISTINCT w AS kmer FROM (SELECT upper(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS w FROM documents)
WHERE translate(w, 'I', 'L') NOT IN
(SELECT translate(upper(x), 'I', 'L') FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS x FROM benchmark))""")
def known_peptide_filter(spark, d):
    def words(t):
        return read(spark, d, t).select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w")).select(F.upper("w").alias("kmer"))

    rows = words("documents").distinct()
    return c.without_known(rows, words("benchmark"))


@query(f"""WITH {MATRIX} SELECT kf.kmer, CASE WHEN NOT ja AND rf THEN 'both' WHEN NOT ja THEN 'junction' ELSE 'frame' END AS passes FROM kf WHERE NOT ja OR rf""")
def flag_filters(spark, d):
    m = matrix(spark, d).select("kmer", "junctionAnnotated", "readFrameAnnotated")
    a, b = c.neo_junctions(m).select("kmer"), c.annotated_frames(m).select("kmer")
    both = sp.compared(a, b)
    return both.select("kmer", F.when(F.col("found_in") == "common", "both").when(F.col("found_in") == "left", "junction").otherwise("frame").alias("passes"))


@query(f"WITH {MATRIX} SELECT kmer FROM kf WHERE ('0x' || substr(md5(kmer), 1, 8))::UBIGINT % 8 = 3")
def hash_slice(spark, d):
    """One of eight slices by MD5."""
    return c.hash_slice(matrix(spark, d), 8, 3).select("kmer")


@query(f"""WITH {COHORTS}, {_COHORT}, e AS (SELECT * FROM cf WHERE own >= {OWN} AND high >= 1)
SELECT 0 AS step, 'all' AS name, count(*) AS n FROM cf UNION ALL SELECT 1, 'sample', count(*) FROM cf WHERE own >= {OWN} UNION ALL SELECT 2, 'cohort', count(*) FROM e
UNION ALL SELECT 3, 'differential', count(*) FROM e WHERE n_any IS NULL OR n_any > 0 AND top < {LOUD}""")
def step_counts(spark, d):
    cancer, normal = cohort_matrices(spark, d)
    return c.filter_counts(written(cancer, "cancer"), normal, CANCER, NORMAL, TARGET, OWN, HIGH, 1, LOUD, None)


@query(f"""WITH {COHORTS}, n AS (SELECT kmer, count(*) FILTER (x >= {HIGH}) AS high FROM cm GROUP BY kmer)
SELECT CAST(s AS INT) AS target, kmer FROM cm JOIN n USING (kmer) WHERE x >= {OWN} AND high - CAST(x >= {HIGH} AS INT) >= 1
AND kmer NOT IN (SELECT kmer FROM nm WHERE x >= {LOUD}) AND (kmer NOT IN (SELECT kmer FROM nk) OR kmer IN (SELECT kmer FROM nm WHERE x > 0))""")
def diff_filter_all_targets(spark, d):
    """Every cancer sample as target, with the background of `diff_filter`: loud normals, and k-mers that normals have without expression."""
    cancer, normal = cohort_matrices(spark, d)
    normal = written(normal, "normal")
    silent = normal.where(c.support(F.col("expr"), 0, NORMAL) == 0).select("kmer")
    background = c.normal_background(normal, NORMAL, LOUD, None).unionByName(silent)
    return c.targets_filter(written(cancer, "cancer"), CANCER, CANCER, background, OWN, HIGH, 1).select("target", "kmer")


_BG = "bg AS (SELECT DISTINCT 'P' || p_partkey AS kmer FROM part WHERE p_brand LIKE '%1' UNION SELECT 'P' || p_partkey FROM part WHERE p_size > 40)"


def _background(spark, d):
    return sp.background_union(_parts(spark, d, "p_brand like '%1'"), _parts(spark, d, "p_size > 40"))


@query(f"WITH {MATRIX}, {_BG} SELECT kmer, kmer NOT IN (SELECT kmer FROM bg) AS is_neo_flag FROM kf")
def novelty_flag(spark, d):
    return sp.novelty_flag(matrix(spark, d).select("kmer"), _background(spark, d))


@query(f"WITH {MATRIX}, {_BG} SELECT kmer FROM kf WHERE kmer NOT IN (SELECT kmer FROM bg)")
def novelty_remove(spark, d):
    return sp.novel(matrix(spark, d).select("kmer"), _background(spark, d))


@query(f"WITH {_BG} SELECT kmer FROM bg")
def background_union(spark, d):
    return _background(spark, d)


@query(f"""WITH {MATRIX} SELECT kmer, event_type AS allele, value AS affinity FROM kf JOIN events ON kmer = 'P' || (event_id * 31 % (SELECT max(p_partkey) FROM part) + 1) WHERE value <= 20""")
def binding_join(spark, d):
    most = read(spark, d, "part").agg(F.max("p_partkey").alias("most"))
    events = read(spark, d, "events").join(F.broadcast(most))  # one row
    predictions = events.select(F.concat(F.lit("P"), F.col("event_id") * 31 % F.col("most") + 1).alias("peptide"), F.col("event_type").alias("allele"), F.col("value").alias("affinity"))
    return sp.binding(matrix(spark, d).select("kmer"), predictions, "affinity", 20.0)


_COORD = """
co AS (SELECT l_orderkey AS id, l_linenumber AS line, l_partkey % 97 AS a, l_partkey % 97 + 30 AS b, l_suppkey % 53 * 3 AS e, l_suppkey % 53 * 3 + 40 AS f, l_quantity FROM lineitem),
ck AS (SELECT *, CASE WHEN b < e THEN '+' ELSE '-' END AS strand, CASE WHEN b < e THEN b || ':' || e ELSE f || ':' || a END AS jct1 FROM co)
"""


def _coordinates(spark, d):
    a, e = F.col("l_partkey") % 97, F.col("l_suppkey") % 53 * 3
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.concat_ws(":", a, a + 30, e, e + 40, F.lit("None"), F.lit("None")).alias("coord"), "l_quantity")
    return sp.with_junctions(rows, "coord")


@query(f"WITH {_COORD} SELECT id, line, strand, jct1 FROM ck WHERE jct1 IN (SELECT jct1 FROM ck WHERE l_quantity = 50)")
def junction_peptides(spark, d):
    rows = _coordinates(spark, d)
    return sp.junction_peptides(rows, rows.where("l_quantity = 50")).select("id", "line", "strand", "jct1")


_THREE = """
c3 AS (SELECT l_orderkey AS id, l_linenumber AS line, l_quantity AS q, CASE WHEN up THEN a ELSE 400 + a END AS c0, CASE WHEN up THEN a + 30 ELSE 430 + a END AS c1,
       200 + e AS c2, 240 + e AS c3, CASE WHEN l_linenumber % 3 > 0 THEN CASE WHEN up THEN 400 + a % 7 ELSE a % 7 END END AS c4, CASE WHEN l_linenumber % 3 > 0 THEN CASE WHEN up THEN 420 + a % 7 ELSE 20 + a % 7 END END AS c5
       FROM (SELECT *, l_partkey % 11 AS a, l_suppkey % 5 * 3 AS e, l_orderkey % 2 = 0 AS up FROM lineitem)),
j3 AS (SELECT *, CASE WHEN c1 < c2 THEN '+' ELSE '-' END AS strand, CASE WHEN c1 < c2 THEN c1 || ':' || c2 ELSE c3 || ':' || c0 END AS jct1, CASE WHEN c1 < c2 THEN c3 || ':' || c4 ELSE c5 || ':' || c2 END AS jct2 FROM c3),
f3 AS (SELECT jct1, jct2 FROM j3 WHERE q = 50 AND id % 7 = 0)
"""


@query(f"""WITH {_THREE} SELECT id, line, strand, jct1, jct2, 'pair' AS kind FROM j3 WHERE EXISTS (SELECT 1 FROM f3 WHERE f3.jct1 = j3.jct1 AND f3.jct2 IS NOT DISTINCT FROM j3.jct2)
UNION ALL SELECT id, line, strand, jct1, jct2, 'each' FROM j3 WHERE jct1 IN (SELECT jct1 FROM f3) AND EXISTS (SELECT 1 FROM f3 WHERE f3.jct2 IS NOT DISTINCT FROM j3.jct2)""")
def two_junction_peptides(spark, d):
    """Peptides of two or three exons on both strands whose junctions occur among those found, as a pair or each on its own."""
    a, e, up = F.col("l_partkey") % 11, F.col("l_suppkey") % 5 * 3, F.col("l_orderkey") % 2 == 0
    third = [F.when(F.col("l_linenumber") % 3 > 0, F.when(up, x + a % 7).otherwise(y + a % 7)) for x, y in ((400, 0), (420, 20))]
    numbers = [F.when(up, a).otherwise(a + 400), F.when(up, a + 30).otherwise(a + 430), e + 200, e + 240, *third]
    coord = F.concat_ws(":", *[F.coalesce(n.cast("string"), F.lit("None")) for n in numbers])
    rows = written(read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), "l_quantity", coord.alias("coord")), "junctions")
    rows = sp.with_junctions(rows, "coord")
    found = rows.where("l_quantity = 50 and id % 7 = 0")
    both = [sp.junction_peptides(rows, found, pairwise).select("id", "line", "strand", "jct1", "jct2", F.lit(kind).alias("kind")) for kind, pairwise in (("pair", True), ("each", False))]
    return both[0].unionByName(both[1])


@query("""WITH p AS (SELECT DISTINCT w AS peptide FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) WHERE length(w) >= 5),
k AS (SELECT DISTINCT w AS kmer FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark) WHERE length(w) = 5),
t AS (SELECT peptide, unnest(list_transform(range(1, CAST(length(peptide) - 3 AS BIGINT)), lambda i: substr(peptide, i, 5))) AS kmer FROM p)
SELECT DISTINCT peptide FROM t JOIN k USING (kmer)""")
def contains_kmer(spark, d):
    words = lambda t: read(spark, d, t).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("peptide"))
    found = words("benchmark").where("length(peptide) = 5").select(F.col("peptide").alias("kmer")).distinct()
    return sp.containing(words("documents").distinct(), found, 5)


_PSM = """
ps AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 100.0 ELSE (event_id % 37) / 1000.0 END AS pvalue, event_id % 3 % 2 AS n_db, event_id % 5 % 2 AS n_ptm,
       CASE WHEN event_id % 7 < 4 THEN 'Yes' ELSE 'No' END AS confident, value AS score FROM events)
"""


@query(f"""WITH {_PSM}, o AS (SELECT *, CASE WHEN pvalue = 100 AND n_db > 0 THEN 'step 3' WHEN pvalue < 100 AND n_db = 0 AND pvalue > 0.01 THEN 'step 4'
WHEN pvalue < 100 AND n_db = 0 AND n_ptm <> 0 THEN 'step 5' WHEN pvalue < 100 AND n_db = 0 AND confident = 'Yes' THEN 'pass' END AS outcome FROM ps)
SELECT event_id, outcome, CASE WHEN outcome <> 'step 3' THEN CAST(pvalue AS DOUBLE) END AS pvalue, CASE WHEN outcome IN ('step 5', 'pass') THEN n_ptm END AS n_ptm FROM o WHERE outcome IS NOT NULL""")
def psm_classify(spark, d):
    e = F.col("event_id")
    rows = read(spark, d, "events").select("event_id", F.when(e % 4 == 0, 100.0).otherwise(e % 37 / 1000).alias("pvalue"), (e % 3 % 2).alias("n_db"), (e % 5 % 2).alias("n_ptm"), F.when(e % 7 < 4, "Yes").otherwise("No").alias("confident"), F.col("value").alias("score"))
    return sp.ranked_matches(sp.spectrum_outcome(rows)).select("event_id", "outcome", "pvalue", "n_ptm")


@query(f"""WITH {SPLIT} SELECT coalesce(a.kmer, b.kmer) AS kmer, CASE WHEN a.kmer IS NULL THEN 'right' WHEN b.kmer IS NULL THEN 'left' ELSE 'common' END AS found_in
FROM (SELECT DISTINCT kmer FROM seg) a FULL JOIN (SELECT DISTINCT kmer FROM jun) b ON a.kmer = b.kmer""")
def compare_sets(spark, d):
    return sp.compared(*split_matrices(spark, d))


@query(f"""WITH {_COORD}, k AS (SELECT id, line, a AS c0, b AS c1, e AS c2, f AS c3, a + b + e + f AS t FROM co)
SELECT x.id, x.line, y.line AS other_line, CAST(1 + (x.c1 = y.c1)::INT + (x.c2 = y.c2)::INT + (x.c3 = y.c3)::INT AS INT) AS n_equal
FROM k x JOIN k y ON x.id = y.id AND x.c0 = y.c0 AND x.t = y.t""")
def shifted_coordinates(spark, d):
    a, e = F.col("l_partkey") % 97, F.col("l_suppkey") % 53 * 3
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("gene"), "l_linenumber", a.alias("c0"), (a + 30).alias("c1"), e.alias("c2"), (e + 40).alias("c3"))
    return sp.shifted_coordinates(rows, rows).select(F.col("gene").alias("id"), F.col("l_linenumber").alias("line"), F.col("other_l_linenumber").alias("other_line"), "n_equal")


@query("""SELECT l_orderkey AS gene, bool_or(l_partkey % 5 = 1) AS stop, bool_or(l_partkey % 7 = 1) AS isolated, bool_or(l_suppkey % 9 < 3) AS short, bool_or(l_linenumber % 4 > 1) AS variants
FROM lineitem GROUP BY 1""")
def junction_flags(spark, d):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("gene"), (p % 5).alias("hasStopCodon"), (p % 7).alias("isIsolated"), (s % 9).alias("first_length"), (F.col("l_linenumber") % 4).alias("n_variants"))
    return sp.junction_flags(rows, ["gene"])


@query(f"""WITH r AS (SELECT 'P' || l_partkey AS kmer, l_orderkey AS location, l_quantity AS expr FROM lineitem), {_BG}
SELECT kmer, count(*) AS n, string_agg(location || ':' || CAST(expr AS BIGINT), ';' ORDER BY location, expr) AS detail_text FROM r
WHERE kmer NOT IN (SELECT kmer FROM bg) GROUP BY kmer""")
def neo_details(spark, d):
    rows = read(spark, d, "lineitem").select(F.concat(F.lit("P"), F.col("l_partkey")).alias("kmer"), F.col("l_orderkey").alias("location"), F.col("l_quantity").alias("expr"), "l_returnflag")
    parts = [rows.where(F.col("l_returnflag") == f).drop("l_returnflag") for f in "RAN"]
    held = sp.novel(sp.kmer_details(*parts), _background(spark, d))
    return held.select("kmer", F.size("details").cast("long").alias("n"), "detail_text")


@query(f"""WITH r AS (SELECT 'P' || l_partkey AS kmer, l_orderkey AS location, l_quantity AS expr FROM lineitem)
SELECT kmer, count(*) AS n FROM r GROUP BY kmer HAVING max(expr) > 49""")
def loud_details(spark, d):
    """k-mers with a place of expression above 49, and all their places."""
    rows = read(spark, d, "lineitem").select(F.concat(F.lit("P"), F.col("l_partkey")).alias("kmer"), F.col("l_orderkey").alias("location"), F.col("l_quantity").alias("expr"))
    return sp.details_above(sp.kmer_details(rows), 49.0).select("kmer", F.size("details").cast("long").alias("n"))


@query(f"""WITH {SPLIT} SELECT kmer, 'within' AS kind FROM seg WHERE s <= 11 GROUP BY kmer UNION ALL SELECT kmer, 'across' FROM jun WHERE s <= 11 GROUP BY kmer
UNION ALL SELECT kmer, 'all' FROM (SELECT kmer FROM seg UNION SELECT kmer FROM jun)""")
def background_options(spark, d):
    """Background k-mers: those within exons or across junctions that a cancer sample expresses, and all."""
    segment, junction = (m.withColumn("isCrossJunction", F.lit(cross)) for m, cross in zip(split_matrices(spark, d), (False, True)))
    both = written(segment.unionByName(junction).select("kmer", "isCrossJunction", F.slice("expr", 1, 12).alias("expr")), "background")
    named = {"within": sp.background_rows(both, True, False), "across": sp.background_rows(both, True, True), "all": sp.background_rows(both)}
    rows = [df.withColumn("kind", F.lit(k)) for k, df in named.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("""SELECT l_orderkey AS id, l_linenumber AS line FROM lineitem WHERE l_partkey % 2 = 0 AND CASE WHEN l_suppkey % 5 > 0 THEN l_quantity END > 20 AND l_extendedprice > 30000""")
def single_sample_filters(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), (F.col("l_partkey") % 2 == 0).alias("is_crossjunction"), F.when(F.col("l_suppkey") % 5 > 0, F.col("l_quantity")).alias("junction_expr"), F.col("l_extendedprice").alias("segment_expr"))
    return sp.single_sample_filter(rows, True, 20, 30000).select("id", "line")


@query("SELECT o_orderkey AS id FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_linestatus = 'F')")
def metadata_filter(spark, d):
    rows = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    meta = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_returnflag") == "R").alias("stop"), (F.col("l_linestatus") == "F").alias("known"))
    return sp.metadata_filter(rows, meta, stop=True, known=True)
