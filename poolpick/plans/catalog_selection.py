"""Selection, neighbour and distance queries (SEL-*, JOIN-1/2/5/6, AGG-1/3/4/5/15, SET-2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from poolpick import fixtures as fx
from poolpick.fixtures import with_views
from poolpick.operators import neighbors as nb
from poolpick.operators import strategies as st
from poolpick.plans.registry import r6, register

B = fx.FLAGSHIP_BUDGET

# ----------------------------------------------------------------- shared SQL
_DIST_CTE = ("d", "SELECT t.row_id AS tgt_id, p.row_id AS src_id, list_distance(p.emb, t.emb) AS dist "
                  "FROM pool p, tgt t")
_RANKED_CTE = ("r", "SELECT tgt_id, src_id, dist, row_number() OVER (PARTITION BY tgt_id ORDER BY dist, src_id) "
                    "AS rk FROM d")


def _with_lang(sel, pool):
    return sel.join(pool.select("row_id", "language"), "row_id")


def _knn_sql(budget: int, k0: int = 1, prev: bool = True) -> str:
    prev_cte = "SELECT row_id, prev_order FROM prev" if prev else "SELECT row_id, prev_order FROM prev WHERE false"
    return with_views(
        f"""SELECT s.row_id, s.rank, p.language FROM sel s JOIN pool p USING (row_id)""",
        "pool", "tgt", "unc", "prev",
        extra=[_DIST_CTE, _RANKED_CTE,
               ("pv", prev_cte),
               ("npv", "SELECT count(*) AS n FROM pv"),
               ("best", "SELECT src_id AS row_id, min(rk) AS best FROM r GROUP BY src_id"),
               ("fresh", "SELECT * FROM best WHERE row_id NOT IN (SELECT row_id FROM pv)"),
               ("lv", f"SELECT CAST({k0} * pow(2, i) AS BIGINT) AS k FROM range(0, 40) t(i)"),
               ("cnt", "SELECT lv.k, (SELECT n FROM npv) + count(f.row_id) AS n FROM lv LEFT JOIN fresh f "
                       "ON f.best <= lv.k GROUP BY lv.k"),
               ("kstar", f"SELECT min(k) AS k FROM cnt WHERE n > {budget} OR k > (SELECT count(*) FROM pool)"),
               ("cand", "SELECT f.row_id FROM fresh f, kstar WHERE f.best <= kstar.k"),
               ("nw", "SELECT c.row_id, row_number() OVER (ORDER BY u.uncertainty ASC NULLS LAST, c.row_id) AS nr "
                      "FROM cand c JOIN unc u USING (row_id)"),
               ("sel", f"SELECT row_id, CAST(row_number() OVER (ORDER BY prev_order, row_id) AS BIGINT) AS rank "
                       f"FROM pv UNION ALL SELECT row_id, CAST(nr + (SELECT n FROM npv) AS BIGINT) FROM nw "
                       f"WHERE nr <= {budget} - (SELECT n FROM npv)")])


def flagship(spark, sf_dir):
    """select_knn_uncertainty at budget 50, k0 = 1, with the prev selection."""
    pool = fx.pool_df(spark, sf_dir)
    sel = st.select_knn_uncertainty(pool, fx.target_df(spark, sf_dir), fx.uncertainty_df(spark, sf_dir),
                                    fx.prev_df(spark, sf_dir), B, k0=1)
    return _with_lang(sel, pool)


register("select_knn_uncertainty", _knn_sql(B))(flagship)


@register("select_knn_uncertainty_noprev", _knn_sql(10, k0=2, prev=False))
def q_knn_noprev(spark, sf_dir):
    pool = fx.pool_df(spark, sf_dir)
    sel = st.select_knn_uncertainty(pool, fx.target_df(spark, sf_dir), fx.uncertainty_df(spark, sf_dir),
                                    st.empty_prev(spark), 10, k0=2)
    return _with_lang(sel, pool)


def _top_sql(score_cte: str, budget: int, order: str, prev: bool = True) -> str:
    """prev rows, then the best (budget - n_prev) rows of ``sc(row_id, score)`` by ``order``."""
    pv = "SELECT row_id, prev_order FROM prev" if prev else "SELECT row_id, prev_order FROM prev WHERE false"
    return with_views(
        "SELECT s.row_id, s.rank, p.language FROM sel s JOIN pool p USING (row_id)",
        "pool", "tgt", "unc", "prev",
        extra=[_DIST_CTE, ("pv", pv), ("npv", "SELECT count(*) AS n FROM pv"), ("sc", score_cte),
               ("nw", f"SELECT row_id, row_number() OVER (ORDER BY {order}, row_id) AS nr FROM sc "
                      f"WHERE row_id NOT IN (SELECT row_id FROM pv)"),
               ("sel", f"SELECT row_id, CAST(row_number() OVER (ORDER BY prev_order, row_id) AS BIGINT) AS rank "
                       f"FROM pv UNION ALL SELECT row_id, CAST(nr + (SELECT n FROM npv) AS BIGINT) FROM nw "
                       f"WHERE nr <= {budget} - (SELECT n FROM npv)")])


@register("select_uncertainty", _top_sql("SELECT row_id, uncertainty AS score FROM unc", B, "score ASC NULLS LAST"))
def q_select_uncertainty(spark, sf_dir):
    pool = fx.pool_df(spark, sf_dir)
    return _with_lang(st.select_uncertainty(fx.uncertainty_df(spark, sf_dir), fx.prev_df(spark, sf_dir), B), pool)


@register("select_average_dist",
          _top_sql("SELECT src_id AS row_id, avg(dist) AS score FROM d GROUP BY src_id", B, "score"))
def q_select_average_dist(spark, sf_dir):
    pool = fx.pool_df(spark, sf_dir)
    sel = st.select_average_dist(pool, fx.target_df(spark, sf_dir), fx.prev_df(spark, sf_dir), B)
    return _with_lang(sel, pool)


_COS = ("SELECT p.row_id AS src_id, list_cosine_similarity(p.emb, t.emb) AS sim FROM pool p, tgt t")


@register("select_average_cosine",
          _top_sql(f"SELECT src_id AS row_id, avg(sim) AS score FROM ({_COS}) GROUP BY src_id", B, "score DESC"))
def q_select_average_cosine(spark, sf_dir):
    pool = fx.pool_df(spark, sf_dir)
    sel = st.select_average_dist(pool, fx.target_df(spark, sf_dir), fx.prev_df(spark, sf_dir), B, metric="cosine")
    return _with_lang(sel, pool)


_MD5 = "md5(concat_ws(':', '42', CAST(row_id AS VARCHAR)))"


@register("select_random", _top_sql(f"SELECT row_id, {_MD5} AS score FROM pool", B, "score"))
def q_select_random(spark, sf_dir):
    pool = fx.pool_df(spark, sf_dir)
    return _with_lang(st.select_random(pool, fx.prev_df(spark, sf_dir), B, seed=fx.SEED), pool)


@register("select_gold", _top_sql(f"SELECT row_id, {_MD5} AS score FROM pool WHERE language IN ('ar', 'bn')",
                                  B, "score", prev=False))
def q_select_gold(spark, sf_dir):
    pool = fx.pool_df(spark, sf_dir)
    return _with_lang(st.select_gold(pool, st.empty_prev(spark), B, "gold_ar_bn", seed=fx.SEED), pool)


# allocation lines are derived from the pool: one line per (side) with 'lang:count div 8' items,
# then parsed back; the quota table must equal the counts it was written from.
def _allocation_lines(spark, sf_dir):
    v = fx.vec_df(spark, sf_dir)
    per = v.groupBy("side", "language").agg(F.expr("count(*) div 8").alias("q"))
    items = per.groupBy("side").agg(F.array_join(F.array_sort(F.collect_list(
        F.concat_ws(":", "language", F.col("q").cast("string")))), ",").alias("items"))
    return items.select(F.concat(F.lit("demo:"), F.col("side"), F.lit("\titer_1\t"), F.col("items")).alias("value"))


@register("parse_allocation", with_views(
    "SELECT 'demo' AS dataset, side AS config, 1 AS iteration, language, count(*) // 8 AS quota "
    "FROM vec GROUP BY side, language", "vec"))
def q_parse_allocation(spark, sf_dir):
    return st.parse_allocation(_allocation_lines(spark, sf_dir))


@register("select_allocated", with_views(
    f"SELECT row_id, CAST(row_number() OVER (ORDER BY language, lr) AS BIGINT) AS rank, language FROM ("
    f"SELECT p.row_id, p.language, row_number() OVER (PARTITION BY p.language ORDER BY {_MD5}, p.row_id) AS lr, "
    f"q.quota FROM pool p JOIN (SELECT language, count(*) // 8 AS quota FROM vec WHERE side = 'pool' "
    f"GROUP BY language) q USING (language)) WHERE lr <= quota", "pool"))
def q_select_allocated(spark, sf_dir):
    pool = fx.pool_df(spark, sf_dir)
    alloc = st.parse_allocation(_allocation_lines(spark, sf_dir))
    return _with_lang(st.select_allocated(pool, alloc, "demo", "pool", 1, seed=fx.SEED), pool)


_EGAL_BUDGET = 95


@register("select_egalitarian", with_views(
    f"SELECT s.row_id, s.rank, p.language FROM sel s JOIN pool p USING (row_id)", "pool", "prev",
    extra=[("npv", "SELECT count(*) AS n FROM prev"),
           ("sz", "SELECT language, count(*) AS lang_n FROM pool GROUP BY language"),
           ("nl", "SELECT count(*) AS l FROM sz"),
           ("rk", f"SELECT p.row_id, p.language, s.lang_n, row_number() OVER (PARTITION BY p.language "
                  f"ORDER BY {_MD5}, p.row_id) AS lrank FROM pool p JOIN sz s USING (language) "
                  f"WHERE p.row_id NOT IN (SELECT row_id FROM prev)"),
           ("p1", f"SELECT row_id, row_number() OVER (ORDER BY language, lrank) AS o FROM rk "
                  f"WHERE lang_n <= {_EGAL_BUDGET} // (SELECT l FROM nl) "
                  f"OR lrank <= ({_EGAL_BUDGET} - (SELECT n FROM npv)) // (SELECT l FROM nl)"),
           ("p1k", f"SELECT row_id, o FROM p1 WHERE o <= {_EGAL_BUDGET} - (SELECT n FROM npv)"),
           ("n1", "SELECT (SELECT n FROM npv) + count(*) AS n FROM p1k"),
           ("fill", f"SELECT row_id, row_number() OVER (ORDER BY {_MD5}, row_id) AS o FROM pool "
                    f"WHERE row_id NOT IN (SELECT row_id FROM prev) AND row_id NOT IN (SELECT row_id FROM p1k)"),
           ("sel", f"SELECT row_id, CAST(row_number() OVER (ORDER BY prev_order, row_id) AS BIGINT) AS rank "
                   f"FROM prev UNION ALL SELECT row_id, CAST(o + (SELECT n FROM npv) AS BIGINT) FROM p1k "
                   f"UNION ALL SELECT row_id, CAST(o + (SELECT n FROM n1) AS BIGINT) FROM fill "
                   f"WHERE o <= {_EGAL_BUDGET} - (SELECT n FROM n1)")]))
def q_select_egalitarian(spark, sf_dir):
    pool = fx.pool_df(spark, sf_dir)
    return _with_lang(st.select_egalitarian(pool, fx.prev_df(spark, sf_dir), _EGAL_BUDGET, seed=fx.SEED), pool)


@register("selection_language_distribution",
          f"SELECT language, count(*) AS n FROM ({_knn_sql(B)}) GROUP BY language")
def q_selection_language_distribution(spark, sf_dir):
    """AGG-1: language distribution of the flagship selection, most frequent first."""
    sel = flagship(spark, sf_dir)
    return sel.groupBy("language").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "language")


# ---------------------------------------------------------------- neighbours
@register("knn_join", with_views(
    "SELECT tgt_id, src_id, round(dist, 6) AS dist, CAST(rk AS BIGINT) AS rk FROM r WHERE rk <= 4",
    "pool", "tgt", extra=[_DIST_CTE, _RANKED_CTE]))
def q_knn_join(spark, sf_dir):
    e = nb.knn_edges(fx.pool_df(spark, sf_dir), fx.target_df(spark, sf_dir), 4)
    return e.select("tgt_id", "src_id", r6("dist").alias("dist"), "rk")


@register("knn_join_cosine", with_views(
    "SELECT tgt_id, src_id, round(sim, 6) AS sim, rk FROM (SELECT tgt_id, src_id, sim, CAST(row_number() OVER "
    "(PARTITION BY tgt_id ORDER BY sim DESC, src_id) AS BIGINT) AS rk FROM (SELECT t.row_id AS tgt_id, p.row_id AS src_id, "
    "list_cosine_similarity(p.emb, t.emb) AS sim FROM pool p, tgt t)) WHERE rk <= 4", "pool", "tgt"))
def q_knn_join_cosine(spark, sf_dir):
    """SEL-11 neighbours: the four most similar pool rows per target by cosine."""
    e = nb.knn_edges(fx.pool_df(spark, sf_dir), fx.target_df(spark, sf_dir), 4, metric="cosine")
    return e.select("tgt_id", "src_id", r6("dist").alias("sim"), "rk")


@register("knn_candidates", with_views(
    "SELECT DISTINCT src_id AS row_id FROM r WHERE rk <= 3", "pool", "tgt", extra=[_DIST_CTE, _RANKED_CTE]))
def q_knn_candidates(spark, sf_dir):
    e = nb.knn_edges(fx.pool_df(spark, sf_dir), fx.target_df(spark, sf_dir), 3)
    return nb.knn_candidates(e, 3)


@register("pairwise_l2", with_views(
    "SELECT src_id, count(*) AS n_tgt, round(avg(dist), 6) AS mean_dist, round(min(dist), 6) AS min_dist, "
    "round(max(dist), 6) AS max_dist FROM d GROUP BY src_id", "pool", "tgt", extra=[_DIST_CTE]))
def q_pairwise_l2(spark, sf_dir):
    """JOIN-1: the pool x target L2 matrix, reduced per pool row inside each task."""
    md = nb.mean_distance_per_source(fx.pool_df(spark, sf_dir), fx.target_df(spark, sf_dir))
    return md.select("src_id", "n_tgt", r6("mean_dist").alias("mean_dist"), r6("min_dist").alias("min_dist"),
                     r6("max_dist").alias("max_dist"))


@register("mean_dist_per_target", with_views(
    "SELECT tgt_id, round(avg(dist), 6) AS mean_dist, count(*) AS n_src FROM d GROUP BY tgt_id",
    "pool", "tgt", extra=[_DIST_CTE]))
def q_mean_dist_per_target(spark, sf_dir):
    md = nb.mean_distance_per_target(fx.pool_df(spark, sf_dir), fx.target_df(spark, sf_dir))
    return md.select("tgt_id", r6("mean_dist").alias("mean_dist"), "n_src")


@register("selected_distance_range", with_views(
    "SELECT round(min(score), 6) AS min_mean_dist, round(max(score), 6) AS max_mean_dist, count(*) AS n FROM "
    "(SELECT src_id, avg(dist) AS score FROM d GROUP BY src_id ORDER BY score, src_id LIMIT 50)",
    "pool", "tgt", extra=[_DIST_CTE]))
def q_selected_distance_range(spark, sf_dir):
    """AGG-15: min and max mean distance among the rows SEL-1 would pick (empty prev)."""
    md = nb.mean_distance_per_source(fx.pool_df(spark, sf_dir), fx.target_df(spark, sf_dir))
    top = md.orderBy("mean_dist", "src_id").limit(B)
    return top.agg(r6(F.min("mean_dist")).alias("min_mean_dist"), r6(F.max("mean_dist")).alias("max_mean_dist"),
                   F.count("*").alias("n"))


@register("exclude_selected", with_views(
    "SELECT row_id, language FROM pool WHERE row_id NOT IN (SELECT row_id FROM prev)", "pool", "prev"))
def q_exclude_selected(spark, sf_dir):
    """JOIN-5: anti join of the pool against the previous selection."""
    return fx.pool_df(spark, sf_dir).join(fx.prev_df(spark, sf_dir).select("row_id"), "row_id", "left_anti") \
        .select("row_id", "language")


@register("selected_rows", with_views(
    "SELECT d.row_id, d.language, d.config FROM docs d WHERE d.row_id IN "
    f"(SELECT row_id FROM docs ORDER BY {_MD5}, row_id LIMIT 20)", "docs"))
def q_selected_rows(spark, sf_dir):
    """JOIN-6: semi join of the raw table on a selection (20 random documents)."""
    docs = fx.docs_df(spark, sf_dir)
    sel = st.select_random(docs, st.empty_prev(spark), 20, seed=fx.SEED)
    return docs.join(sel, "row_id", "left_semi").select("row_id", "language", "config")
