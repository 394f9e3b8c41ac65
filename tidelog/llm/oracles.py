"""SQL (DuckDB) for the queries that SQL can express, over whole tables."""

from __future__ import annotations

#: Shingle sets, pairs by counted common shingles, components by recursion.
NEAR_DEDUP = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
       ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, len(g)::BIGINT AS n FROM s),
e AS MATERIALIZED (SELECT doc_id, unnest(g) AS v FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.v = b.v AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
r AS (SELECT doc_id AS node, doc_id AS label FROM n UNION
      SELECT t.node, r.label FROM r JOIN (SELECT x AS near, y AS node FROM l UNION ALL SELECT y, x FROM l) t ON r.node = t.near WHERE r.label < t.node)
SELECT n.doc_id, n.n AS n_shingles, min(r.label) AS component_id, min(r.label) = n.doc_id AS kept FROM n JOIN r ON r.node = n.doc_id GROUP BY n.doc_id, n.n"""

#: Windows numbered by place within their words; all but the first cover words that go.
SUBSTRING_DEDUP = r"""
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w),
k AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS v FROM i),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY v ORDER BY doc_id, i) AS r FROM k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM f WHERE r > 1),
listed AS (SELECT doc_id, list(i) AS l FROM gone GROUP BY doc_id),
kept AS (SELECT doc_id, len(ws)::BIGINT AS n, CASE WHEN l IS NULL THEN ws ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(l, i)), lambda i: ws[i]) END AS k FROM w LEFT JOIN listed USING (doc_id))
SELECT doc_id, n AS n_words, (n - len(k))::BIGINT AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept"""

#: Windows of bytes as digits, counted; runs of covering windows are cut out.
SUFFIX_DEDUP = r"""
WITH b AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
i AS (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM b),
k AS MATERIALIZED (SELECT doc_id, i, md5_number(substr(h, (2 * i + 1)::INT, 400)) AS v FROM i),
t AS (SELECT v FROM k GROUP BY v HAVING count(*) > 1),
s AS (SELECT doc_id, i, max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k SEMI JOIN t USING (v)),
g AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s),
runs AS (SELECT doc_id, run, min(i) AS a, max(i) + 200 AS z FROM g GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_ FROM runs),
parts AS (SELECT doc_id, string_agg(substr(h, (2 * from_ + 1)::INT, (2 * (a - from_))::INT), '' ORDER BY a) AS kept, max(z) AS last, count(*) AS n_spans, sum(z - a) AS n_removed
          FROM gaps JOIN b USING (doc_id) GROUP BY doc_id)
SELECT b.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, (2 * coalesce(last, 0) + 1)::INT))) AS kept_sha256 FROM b LEFT JOIN parts USING (doc_id)"""

#: Groups of equal texts.
EXACT_DEDUP = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))"""
