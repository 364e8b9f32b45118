"""DuckDB SQL of the queries that SQL can express."""

ORACLE: dict[str, str] = {}

ORACLE["op1_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

ORACLE["op2_mixing"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [1.0, 2.0, 3.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM d GROUP BY source),
-- shares by weight; whoever is above three times its size is set to that, and the rest is shared again
fill AS (
  SELECT 0 AS round, source, source_size, weight, false AS capped, NULL::DOUBLE AS target FROM s
  UNION ALL
  SELECT round + 1, source, source_size, weight, capped OR share > 3.0 * source_size,
         CASE WHEN capped OR share > 3.0 * source_size THEN 3.0 * source_size ELSE share END
  FROM (
    SELECT *, (sum(source_size) OVER () - coalesce(sum(3.0 * source_size) FILTER (capped) OVER (), 0.0))::DOUBLE
              / nullif(sum(weight) FILTER (NOT capped) OVER (), 0) * weight AS share
    FROM fill)
  WHERE round < (SELECT count(*) + 1 FROM s)),
t AS (
  SELECT source, source_size, round(target, 6) AS near, target,
         CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs
  FROM fill WHERE round = (SELECT max(round) FROM fill)),
k AS (
  SELECT d.doc_id, d.size, t.*,
         -ln((('0x' || substr(md5('mix-1:' || d.doc_id), 1, 12))::BIGINT + 0.5) / 281474976710656.0)
         / CASE WHEN size > 0 THEN least(length(d.t) / size / 5.0, 5.0 / (length(d.t) / size)) ELSE 1.0 END AS key
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (
  SELECT *, floor(target)::BIGINT - epochs * source_size AS budget,
         coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS past
  FROM k)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - past)))::BIGINT AS taken
FROM p
"""

ORACLE["op4_line_dedup"] = r"""
WITH d AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM d),
c AS (
  SELECT key, max(doc_id) AS keep_id FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
f AS (
  SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.keep_id AS lost FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (lost)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""

ORACLE["op5_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
g AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
h AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
f AS (SELECT h.doc_id, h.i, h.n, g.item_id FROM h JOIN g ON h.gram = g.gram AND h.n = g.n),
c AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM f)) GROUP BY doc_id),
m AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM f) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN m ON d.doc_id = m.doc_id
"""

ORACLE["op10_substring_dedup"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (
  SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
r AS (SELECT doc_id, i FROM v JOIN (SELECT s FROM v GROUP BY s HAVING count(*) > 1) USING (s)),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM r),
k AS (
  SELECT u.doc_id, u.p, u.word, c.p IS NOT NULL AS gone
  FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d) u
  LEFT JOIN c ON u.doc_id = c.doc_id AND u.p = c.p),
t AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept
  FROM k GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN t ON d.doc_id = t.doc_id
"""

ORACLE["op11_embedding_dedup"] = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS i, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
g AS (
  SELECT i, vec_id, e FROM v
  WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.i, b.i AS j FROM g a JOIN g b ON a.i <> b.i AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r(i, j) AS (
  SELECT i, i FROM v UNION SELECT r.i, l.j FROM r JOIN l ON r.j = l.i),
c AS (SELECT r.i, min(v.vec_id) AS component_id FROM r JOIN v ON r.j = v.i GROUP BY r.i),
n AS (SELECT i, count(*) AS n FROM l GROUP BY i)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id::BIGINT AS component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON v.i = c.i LEFT JOIN n ON v.i = n.i
"""


def _lloyd(rounds: int) -> str:
    """Rounds of nearest centroid and floored mean, one pair of expressions each."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
d{i} AS MATERIALIZED (
  SELECT vec_id, min_by(cluster, (d, cluster)) AS cluster, min(d) AS distance
  FROM (SELECT x.vec_id, c.cluster, sum((x.x - c.x) * (x.x - c.x))::BIGINT AS d
        FROM x JOIN c{i} c ON x.p = c.p GROUP BY x.vec_id, c.cluster)
  GROUP BY vec_id)""")
        if i < rounds:
            steps.append(f"""
c{i + 1} AS MATERIALIZED (
  SELECT c.cluster, c.p, coalesce(m.x, c.x) AS x
  FROM c{i} c LEFT JOIN (
    SELECT cluster, p, ((s - ((s % n) + n) % n) // n)::BIGINT AS x
    FROM (SELECT d.cluster, x.p, sum(x.x)::BIGINT AS s, count(*) AS n FROM d{i} d JOIN x ON d.vec_id = x.vec_id GROUP BY 1, 2)) m
  ON c.cluster = m.cluster AND c.p = m.p)""")
    return ",".join(steps)


ORACLE["op12_centroids"] = f"""
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (
  SELECT vec_id, unnest(range(64)) AS p, unnest(list_transform(e, lambda x: floor(256 * x)::BIGINT)) AS x FROM v),
f AS (
  SELECT vec_id, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS cluster FROM v
  QUALIFY cluster < 40),
c0 AS MATERIALIZED (SELECT cluster, p, x FROM f JOIN x USING (vec_id)),{_lloyd(5)},
h AS (SELECT cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY p)) AS centroid_sha256 FROM c5 GROUP BY cluster)
SELECT vec_id, cluster::INT AS cluster, distance,
       (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
       centroid_sha256
FROM d5 JOIN h USING (cluster)
"""
