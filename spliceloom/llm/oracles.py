"""DuckDB SQL twins of the queries; each constant is named after its query."""



def _classes_sql(width: int, result: str) -> str:
    """Components of documents whose sets of width words share 80 percent of their union."""
    shingle = " || ' ' || ".join(f"ws[i + {k}]" if k else "ws[i]" for k in range(width))
    return rf"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {width} THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - {width - 2}), lambda i: {shingle})) END AS sh
  FROM split
), parts AS (
  SELECT doc_id, len(sh) AS n, unnest(sh) AS s FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM parts a JOIN parts b ON a.s = b.s AND a.doc_id <> b.doc_id
    AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION SELECT reach.node, links.b FROM reach JOIN links ON reach.seen = links.a
), roots AS (SELECT node, min(seen) AS root FROM reach GROUP BY node)
{result}
"""


OP6_NEAR_DEDUP_SQL = _classes_sql(2, "SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, root AS component_id, doc_id = root AS kept FROM sets JOIN roots ON doc_id = node")
FINGERPRINT_CLASSES_SQL = _classes_sql(5, "SELECT node AS doc_id, root AS class_id FROM roots")


def _license_sql() -> str:
    from spliceloom.llm.license_scan import BASE, REACH, rules

    filed = ", ".join(f"('{a}', {r['priority']}, '^({r['pattern']}) ', '{r['label']}', {round(r['weight'], 4)})" for r in rules() for a in r["anchors"])
    phrases = ", ".join(f"('{p}', {len(p.split())}, '{label}')" for p, label in BASE.items())
    return rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), rule(anchor, priority, pattern, label, weight) AS (VALUES {filed}),
phrase(words, n, label) AS (VALUES {phrases}),
place AS (
  SELECT doc_id, ws, unnest(range(0, len(ws))) AS i FROM w
), anchored AS (
  SELECT doc_id, i, ws[i + 1] AS word, array_to_string(ws[i + 1:i + {REACH}], ' ') || ' ' AS ahead FROM place
  WHERE ws[i + 1] IN (SELECT anchor FROM rule) OR ws[i + 1] IN (SELECT split_part(words, ' ', 1) FROM phrase)
), base AS (
  SELECT doc_id, i, label FROM anchored JOIN phrase ON starts_with(ahead, words || ' ')
), hit AS (
  SELECT doc_id, i, priority, label, weight, regexp_extract(ahead, pattern, 1) AS m FROM anchored JOIN rule ON word = anchor
), best AS (
  SELECT *, i + length(m) - length(replace(m, ' ', '')) + 1 AS stop FROM hit WHERE m <> ''
  QUALIFY row_number() OVER (PARTITION BY doc_id, i ORDER BY length(m) - length(replace(m, ' ', '')) DESC, priority) = 1
), kept AS (
  SELECT * FROM best
  QUALIFY coalesce(max(stop) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) < stop
), b AS (
  SELECT doc_id, count(*) AS n, min(i) AS first, max(i) AS last, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY doc_id
), k AS (
  SELECT doc_id, count(*) AS n, max(weight) AS weight FROM kept GROUP BY doc_id
), l AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT doc_id, label FROM base UNION ALL SELECT doc_id, label FROM kept) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(b.n, 0) AS n_base, b.first AS first_word, b.last AS last_word,
  coalesce(b.labels, '') AS base_labels, coalesce(l.labels, '') AS labels,
  CAST(greatest(coalesce(k.weight, 0), CASE WHEN b.n > 0 THEN 0.75 ELSE 0 END) AS DOUBLE) AS score, coalesce(k.n, 0) AS n_detections
FROM w LEFT JOIN b ON b.doc_id = w.doc_id LEFT JOIN k ON k.doc_id = w.doc_id LEFT JOIN l ON l.doc_id = w.doc_id
"""


OP9_LICENSE_SCAN_SQL = _license_sql()


OP13_EXACT_DEDUP_SQL = """
SELECT doc_id, max(doc_id) OVER t AS keep_id, count(*) OVER t AS group_size, doc_id = max(doc_id) OVER t AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW t AS (PARTITION BY coalesce(text, ''))
"""
