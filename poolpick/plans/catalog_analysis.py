"""Neighbour-uncertainty analysis, QA roll-ups, multi-round / multi-budget selection, sinks, projection."""

from __future__ import annotations

from pyspark.sql import functions as F

from poolpick import fixtures as fx
from poolpick.fixtures import with_views
from poolpick.functions.scores import cross_entropy, top2_margin
from poolpick.functions.stats import pearson_p, t_statistic
from poolpick.operators import neighbors as nb
from poolpick.operators import prepare as pr
from poolpick.operators import qa
from poolpick.operators.projection import fit_pca, tagged_projection
from poolpick.plans import rounds as rd
from poolpick.operators import chunking as ch
from poolpick.plans.catalog_eval import CH, QA_Q, QA_STRIDE, qa_window_offsets
from poolpick.plans.catalog_selection import _DIST_CTE, _RANKED_CTE, _knn_sql, flagship
from poolpick.plans.registry import r6, register
from poolpick.session import dealt, materialise, scratch_path, tasks_for
from poolpick.sources import sinks as sk

KS = [1, 2, 4, 8, 16]
_SCORE_SQL = ("sc", "SELECT row_id, list_sort(z, 'DESC')[1] - list_sort(z, 'DESC')[2] AS uncertainty, "
                    "(list_max(z) + ln(list_sum(list_transform(z, lambda x: exp(x - list_max(z)))))) - z[gold + 1] "
                    "AS loss FROM seqlog")


def _scores(spark, sf_dir):
    """Per row: sequence margin (uncertainty) and cross entropy against the gold class (loss)."""
    s = fx.seqlog_df(spark, sf_dir)
    return s.select("row_id", top2_margin(F.col("z")).alias("uncertainty"),
                    cross_entropy(F.col("z"), F.col("gold")).alias("loss"))


def _nn_means(spark, sf_dir):
    edges = nb.knn_edges(fx.pool_df(spark, sf_dir), fx.target_df(spark, sf_dir), max(KS))
    src = _scores(spark, sf_dir).withColumnRenamed("row_id", "src_id")
    return nb.knn_mean_scores(edges, src, KS)


_NN_SQL = ("nn", "SELECT r.tgt_id, k.k, avg(sc.uncertainty) AS nn_uncertainty, avg(sc.loss) AS nn_loss FROM r "
                 "JOIN sc ON sc.row_id = r.src_id JOIN (VALUES " + ", ".join(f"({k})" for k in KS)
           + ") k(k) ON r.rk <= k.k GROUP BY r.tgt_id, k.k")


@register("knn_mean_uncertainty", with_views(
    "SELECT tgt_id, CAST(k AS BIGINT) AS k, round(nn_uncertainty, 6) AS nn_uncertainty, round(nn_loss, 6) AS nn_loss "
    "FROM nn", "pool", "tgt", "seqlog", extra=[_DIST_CTE, _RANKED_CTE, _SCORE_SQL, _NN_SQL]))
def q_knn_mean_uncertainty(spark, sf_dir):
    """AGG-4: mean neighbour uncertainty and loss per target for k = 1, 2, 4, 8, 16 (ranked once)."""
    m = _nn_means(spark, sf_dir)
    return m.select("tgt_id", "k", r6("nn_uncertainty").alias("nn_uncertainty"), r6("nn_loss").alias("nn_loss"))


def _correlation(spark, sf_dir):
    tgt = _scores(spark, sf_dir).withColumnRenamed("row_id", "tgt_id")
    j = _nn_means(spark, sf_dir).join(tgt, "tgt_id")
    c = j.groupBy("k").agg(F.count("*").alias("n"), F.corr("uncertainty", "nn_uncertainty").alias("r_unc"),
                           F.corr("loss", "nn_loss").alias("r_loss"))
    return c.withColumn("t_unc", t_statistic(F.col("r_unc"), F.col("n"))) \
        .withColumn("t_loss", t_statistic(F.col("r_loss"), F.col("n")))


@register("knn_correlation", with_views(
    "SELECT k, n, round(r_unc, 6) AS r_unc, round(r_loss, 6) AS r_loss, "
    "round(r_unc * sqrt((n - 2) / (1 - r_unc * r_unc)), 6) AS t_unc, "
    "round(r_loss * sqrt((n - 2) / (1 - r_loss * r_loss)), 6) AS t_loss FROM ("
    "SELECT CAST(nn.k AS BIGINT) AS k, count(*) AS n, corr(t.uncertainty, nn.nn_uncertainty) AS r_unc, "
    "corr(t.loss, nn.nn_loss) AS r_loss FROM nn JOIN sc t ON t.row_id = nn.tgt_id GROUP BY nn.k)",
    "pool", "tgt", "seqlog", extra=[_DIST_CTE, _RANKED_CTE, _SCORE_SQL, _NN_SQL]))
def q_knn_correlation(spark, sf_dir):
    """AGG-5: Pearson r of target uncertainty (loss) against the neighbour mean, per k, with t."""
    c = _correlation(spark, sf_dir)
    return c.select("k", "n", *[r6(x).alias(x) for x in ("r_unc", "r_loss", "t_unc", "t_loss")])


def _p_sql(r: str) -> str:
    """Two-sided Student-t p of a correlation: one minus a Simpson sum of the density over [-|t|, |t|]."""
    t = f"abs({r} * sqrt((n - 2) / (1 - {r} * {r})))"
    density = f"exp(lgamma((n - 1) / 2) - lgamma((n - 2) / 2)) / sqrt((n - 2) * pi()) * pow(1 + x * x / (n - 2), -(n - 1) / 2)"
    return (f"greatest(0, 1 - 2 * (SELECT sum(weight * {density}) * {t} / 6000 FROM (SELECT i * {t} / 2000 AS x, "
            f"CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS weight FROM range(0, 2001) s(i))))")


@register("knn_correlation_p", with_views(
    f"SELECT k, n, round(r_unc, 6) AS r_unc, round({_p_sql('r_unc')}, 6) AS p_unc, round(r_loss, 6) AS r_loss, "
    f"round({_p_sql('r_loss')}, 6) AS p_loss FROM (SELECT CAST(nn.k AS BIGINT) AS k, count(*) AS n, "
    "corr(t.uncertainty, nn.nn_uncertainty) AS r_unc, corr(t.loss, nn.nn_loss) AS r_loss "
    "FROM nn JOIN sc t ON t.row_id = nn.tgt_id GROUP BY nn.k)",
    "pool", "tgt", "seqlog", extra=[_DIST_CTE, _RANKED_CTE, _SCORE_SQL, _NN_SQL]))
def q_knn_correlation_p(spark, sf_dir):
    """AGG-5 p-values: two-sided Student-t p from t and n on the few-row result."""
    c = _correlation(spark, sf_dir).withColumn("p_unc", pearson_p(F.col("t_unc"), F.col("n"))) \
        .withColumn("p_loss", pearson_p(F.col("t_loss"), F.col("n")))
    return c.select("k", "n", *[r6(x).alias(x) for x in ("r_unc", "p_unc", "r_loss", "p_loss")])


@register("scatter_loss_distance", with_views(
    "SELECT t.row_id AS tgt_id, round(t.uncertainty, 6) AS uncertainty, round(nn.nn_uncertainty, 6) AS nn_uncertainty, "
    "round(t.loss, 6) AS loss, round(md.mean_dist, 6) AS mean_dist FROM sc t JOIN nn ON nn.tgt_id = t.row_id AND nn.k = 8 "
    "JOIN (SELECT tgt_id, avg(dist) AS mean_dist FROM d GROUP BY tgt_id) md ON md.tgt_id = t.row_id",
    "pool", "tgt", "seqlog", extra=[_DIST_CTE, _RANKED_CTE, _SCORE_SQL, _NN_SQL]))
def q_scatter_loss_distance(spark, sf_dir):
    """PLT-2: per target, uncertainty vs neighbour mean (k = 8) and loss vs mean distance."""
    nn = _nn_means(spark, sf_dir).where(F.col("k") == 8)
    md = nb.mean_distance_per_target(fx.pool_df(spark, sf_dir), fx.target_df(spark, sf_dir))
    t = _scores(spark, sf_dir).withColumnRenamed("row_id", "tgt_id")
    j = t.join(nn, "tgt_id").join(md, "tgt_id")
    return j.select("tgt_id", r6("uncertainty").alias("uncertainty"), r6("nn_uncertainty").alias("nn_uncertainty"),
                    r6("loss").alias("loss"), r6("mean_dist").alias("mean_dist"))


# ------------------------------------------------------------------ QA
@register("feature_to_example", with_views(
    "SELECT q.example_id, d.language, count(*) AS n_features, min(q.feature_id) AS first_feature "
    "FROM qafeat q JOIN docs d ON d.row_id = q.example_id GROUP BY q.example_id, d.language", "qafeat", "docs"))
def q_feature_to_example(spark, sf_dir):
    """JOIN-4: feature rows joined to their raw example (orphans raise)."""
    j = qa.feature_to_example(fx.docs_df(spark, sf_dir).select("row_id", "language"), fx.qafeat_df(spark, sf_dir))
    return j.groupBy("example_id", "language").agg(F.count("*").alias("n_features"),
                                                   F.min("feature_id").alias("first_feature"))


N_BEST, MAX_ANS = 20, 1000
TASK_WINDOWS = 50_000  # windows that one task of the search takes
# every window of every whole document is a feature; its logits are the embedding with the key below
_KEY = "(example_id * 7 + win) % (SELECT count(*) FROM embeddings)"
_SPAN_CTES = [
    ("ctx", "SELECT row_id AS example_id, length(text) AS len, CAST(ceil(length(text) / 4) AS BIGINT) AS ntok, text AS context FROM docs"),
    ("win", f"SELECT example_id, len, ws, ws // {QA_STRIDE} AS win FROM (SELECT example_id, len, "
            f"unnest(range(0, greatest(ntok - {QA_STRIDE}, 1), {QA_STRIDE})) AS ws FROM ctx)"),
    ("qft", "SELECT w.*, (e.embedding[1:32])::DOUBLE[] AS zs, (e.embedding[33:64])::DOUBLE[] AS ze FROM win w "
            f"JOIN embeddings e ON e.vec_id = {_KEY}"),
    ("stp", "SELECT example_id, win, ws, len, i - 1 AS p, zs[i] AS v, row_number() OVER "
            "(PARTITION BY example_id, win ORDER BY zs[i] DESC, i) AS rk FROM qft, range(1, 33) t(i)"),
    ("enp", "SELECT example_id, win, i - 1 AS p, ze[i] AS v, row_number() OVER (PARTITION BY example_id, win "
            "ORDER BY ze[i] DESC, i) AS rk FROM qft, range(1, 33) t(i)"),
    ("cand", f"SELECT s.example_id, s.win, s.p AS si, e.p AS ei, s.v + e.v AS score, "
             f"{CH} * (s.ws + s.p - {QA_Q}) AS cs, {CH} * (s.ws + e.p - {QA_Q}) + 3 AS ce FROM stp s "
             f"JOIN enp e USING (example_id, win) "
             f"WHERE s.rk <= {N_BEST} AND e.rk <= {N_BEST} AND e.p >= s.p AND e.p - s.p + 1 <= {MAX_ANS} "
             f"AND s.p >= {QA_Q} AND e.p >= {QA_Q} AND {CH} * (s.ws + s.p - {QA_Q}) < s.len "
             f"AND {CH} * (s.ws + e.p - {QA_Q}) < s.len"),
    ("bst", "SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY score DESC, win, si, ei) AS rn FROM cand"),
]


@register("qa_best_span", with_views(
    "SELECT c.example_id, CAST(b.win AS INTEGER) AS feature_id, CAST(b.si AS INTEGER) AS start, CAST(b.ei AS INTEGER) AS \"end\", "
    "round(b.score, 6) AS score, CASE WHEN b.win IS NULL THEN '' "
    "ELSE substring(c.context, b.cs + 1, b.ce - b.cs) END AS answer "
    "FROM ctx c LEFT JOIN bst b ON b.example_id = c.example_id AND b.rn = 1", "docs", extra=_SPAN_CTES))
def q_qa_best_span(spark, sf_dir):
    """MET-6 / JOIN-9: n-best start x end candidates of every window of every whole document, best
    per example, answer cut from the text by character offsets."""
    docs = fx.docs_df(spark, sf_dir).select(F.col("row_id").alias("example_id"), F.col("text").alias("context"))
    e = fx.table(spark, sf_dir, "embeddings")
    starts = ch.window_starts(F.ceil(F.col("len") / CH).cast("int"), 2 * QA_STRIDE, QA_STRIDE)
    w = materialise(docs.select("example_id", F.length("context").alias("len")), "qa_lengths")
    # the search is dealt by windows, not by bytes: their rows are narrow and their work is not
    n_win = w.agg(F.sum(F.size(starts))).first()[0] or 0
    tasks, n_vec = tasks_for(spark, n_win, TASK_WINDOWS), e.count()
    w = w.repartition(tasks, "example_id").select("example_id", "len", F.posexplode(starts).alias("win", "ws"))
    logits = e.select("vec_id", F.transform(F.slice("embedding", 1, 32), lambda x: x.cast("double")).alias("zs"),
                      F.transform(F.slice("embedding", 33, 32), lambda x: x.cast("double")).alias("ze"))
    copies = max(1, -(-4 * tasks // max(1, n_vec)))  # few vectors serve all tasks
    logits = logits.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).repartition(tasks, "vec_id", "copy")
    w = w.withColumn("vec_id", (F.col("example_id") * 7 + F.col("win")) % n_vec) \
        .withColumn("copy", F.pmod(F.xxhash64("example_id", "win"), F.lit(copies)).cast("int"))
    f = w.repartition(tasks, "vec_id", "copy").join(logits, ["vec_id", "copy"])
    offs, seq = qa_window_offsets(F.col("ws"), F.col("len"))
    f = f.withColumn("offsets", ch.mask_offsets(offs, seq))
    b = qa.best_spans(f, docs, N_BEST, MAX_ANS, feature_col="win")
    return b.select("example_id", F.col("feature_id").cast("int").alias("feature_id"), "start", "end", r6("score").alias("score"), "answer")


# ------------------------------------------------------------------ rounds and budgets
ROUNDS, ROUND_BUDGET = 5, 100


@register("al_rounds_uncertainty", with_views(
    f"SELECT row_id, CAST((rk - 1) // {ROUND_BUDGET // ROUNDS} + 1 AS INTEGER) AS round, rk AS rank FROM "
    f"(SELECT row_id, CAST(row_number() OVER (ORDER BY uncertainty ASC NULLS LAST, row_id) AS BIGINT) AS rk FROM unc) "
    f"WHERE rk <= {ROUND_BUDGET}", "unc"))
def q_al_rounds_uncertainty(spark, sf_dir):
    """SEL-8: five rounds of uncertainty selection to a budget of 100 (fixed scores)."""
    return rd.uncertainty_rounds(spark, fx.uncertainty_df(spark, sf_dir), ROUND_BUDGET, ROUNDS)


@register("al_rounds_refit")
def q_al_rounds_refit(spark, sf_dir):
    """UDF-5: random cold start, then a logistic-regression refit per round on the selected rows."""
    pool = fx.pool_df(spark, sf_dir)
    labels = fx.seqlog_df(spark, sf_dir).select("row_id", F.col("gold").cast("double").alias("label"))
    return rd.refit_rounds(spark, pool, labels, 60, 3, seed=fx.SEED)


RIDGE_BUDGET, RIDGE_ROUNDS, CLASSES = 60, 3, 3


def _ridge_sql() -> str:
    """Sums of products, Gauss-Jordan elimination of (X'X + 1 | X'Y) and the margins, round by round."""
    per, d = RIDGE_BUDGET // RIDGE_ROUNDS, 65
    ctes = [("xs", "SELECT p.row_id, list_append(p.emb, 1.0) AS x, list_transform(range(0, 3), lambda c: CASE WHEN s.gold = c THEN 1.0 ELSE 0.0 END) AS y "
                   "FROM pool p JOIN seqlog s USING (row_id)"),
            ("s1", f"SELECT row_id, 1 AS round, rank FROM (SELECT row_id, row_number() OVER (ORDER BY md5('{fx.SEED}:' || row_id), row_id) AS rank FROM pool) "
                   f"WHERE rank <= {per}")]
    for r in range(2, RIDGE_ROUNDS + 1):
        ctes += [
            (f"m{r}", f"SELECT list(v ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY j) AS v FROM (SELECT i, j, sum(x[i] * z[j]) + "
                      f"CASE WHEN i = j THEN 1.0 ELSE 0.0 END AS v FROM (SELECT x, list_concat(x, y) AS z FROM xs WHERE row_id IN (SELECT row_id FROM s{r - 1})), "
                      f"range(1, {d + 1}) a(i), range(1, {d + CLASSES + 1}) b(j) GROUP BY i, j) GROUP BY i)"),
            (f"g{r}", f"SELECT 1 AS k, m FROM m{r} UNION ALL SELECT k + 1, list_transform(range(1, {d + 1}), lambda i: CASE WHEN i = k "
                      f"THEN list_transform(m[i], lambda v: v / m[k][k]) ELSE list_transform(range(1, {d + CLASSES + 1}), "
                      f"lambda j: m[i][j] - m[i][k] / m[k][k] * m[k][j]) END) FROM g{r} WHERE k <= {d}"),
            (f"w{r}", f"SELECT list_transform(range({d + 1}, {d + CLASSES + 1}), lambda c: list_transform(range(1, {d + 1}), lambda i: m[i][c])) AS w "
                      f"FROM g{r} WHERE k = {d + 1}"),
            (f"u{r}", f"SELECT row_id, z[1] - z[2] AS u FROM (SELECT row_id, list_sort(list_transform(w, lambda c: list_inner_product(c, x)), 'DESC') AS z "
                      f"FROM xs, w{r} WHERE row_id NOT IN (SELECT row_id FROM s{r - 1}))"),
            (f"s{r}", f"SELECT row_id, round, rank FROM s{r - 1} UNION ALL SELECT row_id, {r}, rank + {(r - 1) * per} FROM "
                      f"(SELECT row_id, row_number() OVER (ORDER BY u, row_id) AS rank FROM u{r}) WHERE rank <= {per}"),
        ]
    return with_views(f"SELECT row_id, CAST(round AS INTEGER) AS round, CAST(rank AS BIGINT) AS rank FROM s{RIDGE_ROUNDS}",
                      "pool", "seqlog", extra=ctes).replace("WITH ", "WITH RECURSIVE ", 1)


@register("al_rounds_ridge", _ridge_sql())
def q_al_rounds_ridge(spark, sf_dir):
    """UDF-5 with a closed form: random cold start, then a ridge refit per round on the selected rows."""
    pool = fx.pool_df(spark, sf_dir)
    labels = fx.seqlog_df(spark, sf_dir).select("row_id", F.col("gold").alias("label"))
    return rd.ridge_rounds(spark, pool, labels, RIDGE_BUDGET, RIDGE_ROUNDS, CLASSES, seed=fx.SEED)


@register("select_multi_budget", with_views(
    "SELECT b.budget, row_id, rk AS rank FROM (SELECT row_id, CAST(row_number() OVER (ORDER BY uncertainty "
    "ASC NULLS LAST, row_id) AS BIGINT) AS rk FROM unc), (VALUES " + ", ".join(f"({b})" for b in fx.BUDGETS)
    + ") b(budget) WHERE rk <= b.budget", "unc"))
def q_select_multi_budget(spark, sf_dir):
    """SEL-9: uncertainty selection for budgets 5, 10, 50, 100 from one ranking."""
    return rd.multi_budget_top(fx.uncertainty_df(spark, sf_dir), fx.BUDGETS)


def _knn_multi_sql():
    parts = [f"SELECT {b} AS budget, row_id, rank FROM ({_knn_sql(b, prev=False)})" for b in fx.BUDGETS]
    return " UNION ALL ".join(parts)


@register("select_knn_multi_budget", _knn_multi_sql())
def q_select_knn_multi_budget(spark, sf_dir):
    """SEL-9 for kNN-uncertainty: one neighbour ranking, a level k per budget."""
    return rd.multi_budget_knn(fx.pool_df(spark, sf_dir), fx.target_df(spark, sf_dir),
                               fx.uncertainty_df(spark, sf_dir), fx.BUDGETS)


# ------------------------------------------------------------------ sinks, projection
@register("write_selection", _knn_sql(fx.FLAGSHIP_BUDGET))
def q_write_selection(spark, sf_dir):
    """SNK-1/SNK-2: selected rows to CSV + Parquet and their embeddings; read back."""
    pool = fx.pool_df(spark, sf_dir)
    sel = flagship(spark, sf_dir).select("row_id", "rank")
    out = scratch_path(spark, "selection")
    paths = sk.write_selection(sel, pool, pool.select("row_id", "emb"), out, all_embeddings=True)
    back = spark.read.parquet(paths["parquet"])
    emb_n = spark.read.parquet(paths["embeddings"]).count()
    if emb_n != back.count() or spark.read.parquet(paths["all_embeddings"]).count() != pool.count():
        raise RuntimeError("written embeddings do not match the selection / the pool")
    return back.select("row_id", "rank", "language")


# covariance of pool and target; its power 2^13 by repeated squaring gives a component, deflation the next one
_PCA_STEPS = 13


def _power(name: str, cov: str) -> list[tuple[str, str]]:
    """CTEs ``name`` (k, m): cov^(2^k) over its trace; ``name``v (v): the leading unit vector, largest loading positive."""
    square = "list_transform(m, lambda a: list_transform(m, lambda b: list_inner_product(a, b)))"
    trace = "list_sum(list_transform(range(1, len({m}) + 1), lambda i: {m}[i][i]))"
    return [
        (name, f"SELECT 0 AS k, m FROM {cov} UNION ALL SELECT k + 1, list_transform(q, lambda a: list_transform(a, lambda x: x / t)) FROM "
               f"(SELECT k, q, {trace.format(m='q')} AS t FROM (SELECT k, {square} AS q FROM {name} WHERE k < {_PCA_STEPS}))"),
        (f"{name}v", "SELECT list_transform(u, lambda x: x * s) AS v FROM (SELECT u, CASE WHEN u[list_position(list_transform(u, lambda x: abs(x)), "
                     "list_max(list_transform(u, lambda x: abs(x))))] < 0 THEN -1 ELSE 1 END AS s FROM (SELECT list_transform(c, lambda x: x / "
                     "sqrt(list_inner_product(c, c))) AS u FROM (SELECT m[list_position(list_transform(range(1, len(m) + 1), lambda i: m[i][i]), "
                     f"list_max(list_transform(range(1, len(m) + 1), lambda i: m[i][i])))] AS c FROM {name} WHERE k = {_PCA_STEPS})))"),
    ]


_PCA_CTES = [
    ("mu", "SELECT list(a ORDER BY i) AS mu FROM (SELECT i, avg(emb[i]) AS a FROM vec, range(1, 65) t(i) GROUP BY i)"),
    ("cen", "SELECT row_id, side, language, list_transform(range(1, 65), lambda i: emb[i] - mu[i]) AS x FROM vec, mu"),
    ("cov", "SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(c ORDER BY j) AS r FROM (SELECT i, j, sum(x[i] * x[j]) AS c "
            "FROM cen, range(1, 65) a(i), range(1, 65) b(j) GROUP BY i, j) GROUP BY i)"),
    *_power("p1", "cov"),
    ("cov2", "SELECT list_transform(range(1, 65), lambda i: list_transform(range(1, 65), lambda j: m[i][j] - l * v[i] * v[j])) AS m FROM "
             "(SELECT m, v, list_inner_product(v, list_transform(m, lambda a: list_inner_product(a, v))) AS l FROM cov, p1v)"),
    *_power("p2", "cov2"),
    ("prj", "SELECT row_id, side, list_inner_product(x, p1v.v) AS x, list_inner_product(x, p2v.v) AS y FROM cen, p1v, p2v"),
    ("parts", f"SELECT * FROM (SELECT row_id, 'source' AS type FROM pool ORDER BY md5('{fx.SEED}:' || row_id), row_id LIMIT 100) UNION ALL "
              f"SELECT * FROM (SELECT row_id, 'target' FROM tgt ORDER BY md5('{fx.SEED}:' || row_id), row_id LIMIT 50) UNION ALL "
              f"SELECT row_id, 'selected' FROM ({_knn_sql(fx.FLAGSHIP_BUDGET)})"),
]


@register("pca_project", with_views("SELECT p.row_id, round(x, 6) AS x, round(y, 6) AS y, p.type FROM parts p JOIN prj USING (row_id)",
                                    "vec", "pool", "tgt", extra=_PCA_CTES).replace("WITH ", "WITH RECURSIVE ", 1))
def q_pca_project(spark, sf_dir):
    """ML-1: PCA(2) fitted on pool + target, applied to a pool sample, a target sample and the selection."""
    pool, tgt = fx.pool_df(spark, sf_dir), fx.target_df(spark, sf_dir)
    model = fit_pca(fx.vec_df(spark, sf_dir))
    sel = pool.join(flagship(spark, sf_dir).select("row_id"), "row_id", "left_semi")
    parts = {"source": pr.sample_k(pool, 100, fx.SEED), "target": pr.sample_k(tgt, 50, fx.SEED), "selected": sel}
    return tagged_projection(model, parts).select("row_id", r6("x").alias("x"), r6("y").alias("y"), "type")
