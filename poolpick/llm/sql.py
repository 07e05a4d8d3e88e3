"""DuckDB SQL for operators whose rounds and links SQL can restate."""

from __future__ import annotations

from poolpick.llm import centroid_clustering as cc
from poolpick.llm import vector_codes as vc

_FINITE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_DIST = ("CAST(list_inner_product({a}, {a}) - 2 * list_inner_product({a}, {b}) + list_inner_product({b}, {b}) AS BIGINT)")
_FLOOR = "CASE WHEN sum(x) >= 0 THEN sum(x) // count(*) ELSE -((-sum(x) + count(*) - 1) // count(*)) END"


def _ints(scale: int) -> str:
    return f"list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE)))"


def clustering_sql(k: int = cc.K, rounds: int = cc.ROUNDS, seed: int = cc.SEED) -> str:
    ctes = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, {_ints(cc.SCALE)} AS v
      FROM embeddings WHERE {_FINITE} AND len(embedding) = {cc.DIM})""",
            f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v
      FROM (SELECT sha256('{seed}:' || vec_id) AS h, v FROM v WHERE vec_id IS NOT NULL) ORDER BY h, v LIMIT {k})"""]
    for r in range(rounds + 1):
        ctes.append(f"""a{r} AS MATERIALIZED (SELECT rid, vec_id, v, c, d FROM (
        SELECT v.rid, v.vec_id, v.v, c.c, {_DIST.format(a="v.v", b="c.v")} AS d FROM v, c{r} c)
      QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1)""")
        if r < rounds:
            ctes.append(f"""n{r} AS (SELECT c, list(CAST(m AS DOUBLE) ORDER BY j) AS v FROM (
        SELECT c, j, {_FLOOR} AS m FROM (SELECT c, unnest(range(1, {cc.DIM + 1})) AS j, CAST(unnest(v) AS BIGINT) AS x FROM a{r}) GROUP BY c, j) GROUP BY c)""")
            ctes.append(f"c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(n.v, c.v) AS v FROM c{r} c LEFT JOIN n{r} n USING (c))")
    return f"""WITH {', '.join(ctes)}
    SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
           CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(c.v, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
    FROM a{rounds} a JOIN c{rounds} c USING (c)"""


def codes_sql(parts: int = vc.PARTS, entries: int = vc.ENTRIES, rounds: int = vc.ROUNDS) -> str:
    ctes = [f"f AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, {_ints(vc.SCALE)} AS v FROM embeddings WHERE {_FINITE})",
            "d AS (SELECT len(v) AS d FROM f WHERE vec_id IS NOT NULL ORDER BY vec_id, v LIMIT 1)",
            f"k AS MATERIALIZED (SELECT f.*, d // {parts} AS w FROM f, d WHERE len(v) = d AND d % {parts} = 0)",
            f"""x AS MATERIALIZED (SELECT rid, p, w, v[CAST(p * w + 1 AS BIGINT):CAST(p * w + w AS BIGINT)] AS v
      FROM (SELECT rid, w, v, unnest(range({parts})) AS p FROM k))""",
            f"""s AS (SELECT rid, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM k WHERE vec_id IS NOT NULL ORDER BY vec_id, v LIMIT {entries})""",
            "c0 AS MATERIALIZED (SELECT p, e, v FROM s JOIN x USING (rid))"]
    for r in range(rounds + 1):
        ctes.append(f"""a{r} AS MATERIALIZED (SELECT rid, p, w, v, arg_min(e, d * 1000 + e) AS e, min(d) AS d FROM (
        SELECT x.rid, x.p, x.w, x.v, c.e, {_DIST.format(a="x.v", b="c.v")} AS d FROM x JOIN c{r} c USING (p)) GROUP BY rid, p, w, v)""")
        if r < rounds:
            ctes.append(f"""n{r} AS (SELECT p, e, list(CAST(m AS DOUBLE) ORDER BY j) AS v FROM (
        SELECT p, e, j, {_FLOOR} AS m FROM (SELECT p, e, unnest(range(1, w + 1)) AS j, CAST(unnest(v) AS BIGINT) AS x FROM a{r}) GROUP BY p, e, j) GROUP BY p, e)""")
            ctes.append(f"c{r + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(n.v, c.v) AS v FROM c{r} c LEFT JOIN n{r} n USING (p, e))")
    ctes.append(f"o AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY rid)")
    ctes.append(f"""h AS (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: CAST(x AS BIGINT)), ','), ',' ORDER BY p, e)) AS codebooks_sha256
      FROM c{rounds})""")
    return f"""WITH {', '.join(ctes)}
    SELECT k.vec_id, o.code, o.error, CAST(sum(o.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, h.codebooks_sha256
    FROM k JOIN o USING (rid), h"""


def jaccard_sql(k: int, percent: int, kept: bool = False) -> str:
    """Sets of k-word shingles, all links by a join on shingles, and components by least reachable ids."""
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    word = r"'[^\x20\x09-\x0D]+'"
    return f"""WITH RECURSIVE w AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce({low}, ''), {word}) AS w FROM documents),
    s AS MATERIALIZED (SELECT rid, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' ')) END) AS g FROM w),
    r AS MATERIALIZED (SELECT min(rid) AS rid, min(doc_id) AS doc_id, list_sort(g) AS g, len(g) AS n FROM s WHERE doc_id IS NOT NULL AND len(g) > 0 GROUP BY list_sort(g), len(g)),
    i AS MATERIALIZED (SELECT rid, n, unnest(g) AS g FROM r),
    o AS (SELECT a.rid AS a, b.rid AS b FROM i a JOIN i b ON a.g = b.g AND a.rid < b.rid AND a.n * 100 >= {percent} * b.n AND b.n * 100 >= {percent} * a.n
      GROUP BY a.rid, b.rid, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
    q AS MATERIALIZED (SELECT DISTINCT x.doc_id AS u, y.doc_id AS v FROM o JOIN r x ON o.a = x.rid JOIN r y ON o.b = y.rid
      UNION SELECT DISTINCT s.doc_id, r.doc_id FROM s JOIN r ON list_sort(s.g) = r.g WHERE s.doc_id IS NOT NULL),
    e AS MATERIALIZED (SELECT u, v FROM q WHERE u <> v UNION SELECT v, u FROM q WHERE u <> v),
    t AS (SELECT DISTINCT u AS node, u AS c FROM e UNION SELECT t.node, e.v FROM t JOIN e ON e.u = t.c),
    m AS (SELECT node, min(c) AS c FROM t GROUP BY node)
    SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, coalesce(m.c, s.doc_id) AS component_id{
        ", s.doc_id IS NOT DISTINCT FROM coalesce(m.c, s.doc_id) AS kept" if kept else ""}
    FROM s LEFT JOIN m ON m.node = s.doc_id"""
