"""Queries of clusters, vector duplicates and the conversation trie, with SQL."""

from __future__ import annotations

from . import subspace, trie, yinyang

QUERIES = {
    "op11_yinyang_clusters": yinyang.op11_yinyang_clusters,
    "op12_subspace_near_duplicates": subspace.op12_subspace_near_duplicates,
    "op13_conversation_trie": trie.op13_conversation_trie,
}

#: crc32 of a number written in decimal, digit by digit and bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split({}::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::UBIGINT[]), lambda a, i: xor(a >> 1, (a & 1) * 3988292384))), 4294967295::UBIGINT)"


def _round(i: int) -> str:
    """One assignment to the centroids c{i}, and the centroids it gives."""
    return f"""
a{i} AS MATERIALIZED (
  SELECT r, any_value(v.x) AS x, min((list_inner_product(v.x, v.x) - 2 * list_inner_product(v.x, c.x) + list_inner_product(c.x, c.x)) * 16 + j) AS k
  FROM v, c{i} c GROUP BY r
), c{i + 1} AS MATERIALIZED (
  SELECT c.j, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (
    SELECT j, list(floor(s / n) ORDER BY p) AS x
    FROM (SELECT j, p, sum(e) AS s, count(*) AS n FROM (SELECT k % 16 AS j, unnest(x) AS e, unnest(range(64)) AS p FROM a{i}) GROUP BY j, p) GROUP BY j
  ) m ON c.j = m.j
)"""


ORACLE_SQL = {
    "op11_yinyang_clusters": f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS j, x FROM (SELECT sha256('1:' || vec_id) AS h, x FROM v ORDER BY h LIMIT 16)
),{','.join(_round(i) for i in range(3))},
a3 AS MATERIALIZED (
  SELECT r, min((list_inner_product(v.x, v.x) - 2 * list_inner_product(v.x, c.x) + list_inner_product(c.x, c.x)) * 16 + j) AS k
  FROM v, c3 c GROUP BY r
), d AS (
  SELECT vec_id, (k % 16)::INTEGER AS cluster, floor(k / 16)::BIGINT AS distance FROM a3 JOIN v USING (r)
)
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(list_transform(c3.x, lambda e: e::BIGINT), ',')) AS centroid_sha256
FROM d JOIN c3 ON cluster = j
""",
    "op12_subspace_near_duplicates": """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS x,
         coalesce(vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = len(embedding)
           AND len(list_filter(embedding, lambda e: e <> 0)) > 0, false) AS valid
  FROM embeddings
), e AS MATERIALIZED (
  SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.valid AND b.valid AND a.r <> b.r AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95
), n AS (
  SELECT a AS r, count(*) AS n_links FROM e GROUP BY a
), reached(r, c) AS (
  SELECT r, vec_id FROM v UNION SELECT e.b, reached.c FROM reached JOIN e ON reached.r = e.a
), m AS (
  SELECT r, min(c) AS component_id FROM reached GROUP BY r
)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, coalesce(vec_id = component_id, true) AS kept FROM v JOIN m USING (r) LEFT JOIN n USING (r)
""",
    "op13_conversation_trie": f"""
WITH t AS (
  SELECT conv_id AS c, conv_id - conv_id % 100 AS base, {_CRC.format('conv_id')} % 6 AS h,
         list({{'r': coalesce(role, ''), 'x': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) AS ts
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), b AS (
  SELECT t.c, list_concat(coalesce(o.ts[1:t.h], []), t.ts[t.h + 1:]) AS s FROM t LEFT JOIN t o ON o.c = t.base
), occ AS (
  SELECT c, s, len(s) AS n, unnest(range(0, len(s) + 1)) AS d FROM b
), node AS MATERIALIZED (
  SELECT s[1:d] AS p, d, min(c) AS conv_id, count(*) AS n_convs, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d) AS ends FROM occ GROUP BY s[1:d], d
), kids AS (
  SELECT p[1:d - 1] AS p, count(*) AS n_children FROM node WHERE d > 0 GROUP BY p[1:d - 1]
), each_node AS MATERIALIZED (
  SELECT node.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * CASE WHEN d = 0 THEN 0 ELSE length(node.p[d].x) END AS saved FROM node LEFT JOIN kids ON node.p = kids.p
), below AS (
  SELECT p[1:a] AS p, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM each_node) GROUP BY p[1:a]
)
SELECT e.conv_id, e.d AS depth, o.conv_id AS parent_conv_id, e.n_convs, e.n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(e.ends, '')) AS ends_sha256
FROM each_node e JOIN below ON e.p = below.p LEFT JOIN node o ON e.d > 0 AND o.p = e.p[1:e.d - 1] AND o.d = e.d - 1
""",
}
