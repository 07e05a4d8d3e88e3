"""Budgeted selection strategies.

Common contract: ``prev`` holds already selected rows (``row_id`` plus an
ordering column ``prev_order``); the result is ``(row_id, rank)`` where
ranks ``1..n_prev`` are the previous rows in their order and the new rows
follow, up to ``budget`` rows in total. Ties are broken by ``row_id``.

Small budgets end in ``orderBy(...).limit(budget - n_prev)``, planned as
a ``TakeOrderedAndProject`` (per-partition top-n, then a merge of at most
``budget`` rows per task). Budgets above ``TOPN_DIRECT_MAX`` are cut by a
quantile or a hash prefix, and ranked over range partitions, so no task holds
the selection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from poolpick.operators import neighbors as nb
from poolpick.session import materialise

ID = "row_id"


def hash_key(seed: int | str, id_col: str = ID):
    """Seeded pseudo-random order key: md5('<seed>:<id>') (identical in any SQL engine)."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))


def empty_prev(spark) -> DataFrame:
    return spark.createDataFrame([], "row_id long, prev_order long")


def with_rank(df: DataFrame, order: list, name: str = "_rank") -> DataFrame:
    """All columns plus the 1-based place in ``order``, with no task holding the table: rows are
    range-partitioned by the order and numbered inside each partition, on top of
    the counts of the partitions before (one number per partition)."""
    x = materialise(df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()), "numbered")
    sizes = x.groupBy("_pid").agg(F.count("*").alias("c"))
    before = sizes.select(F.col("_pid").alias("_p"), F.coalesce(F.sum("c").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    local = F.row_number().over(Window.partitionBy("_pid").orderBy(*order))
    return x.withColumn("_l", local).join(before, F.col("_pid") == F.col("_p")) \
        .withColumn(name, F.col("_l") + F.col("_b")).drop("_pid", "_p", "_l", "_b")


def _numbered(df: DataFrame, order: list, n_first: int, big: bool) -> DataFrame:
    """(row_id, rank): ranks n_first + 1, n_first + 2, ... in ``order``; one window numbers a small selection."""
    ranked = with_rank(df, order) if big else df.withColumn("_rank", F.row_number().over(Window.orderBy(*order)))
    return ranked.select(F.col(ID).cast("long").alias(ID), (F.col("_rank") + F.lit(n_first)).cast("long").alias("rank"))


def _prev_ranked(prev: DataFrame, n_prev: int) -> DataFrame:
    return _numbered(prev, [F.col("prev_order"), F.col(ID)], 0, n_prev > TOPN_DIRECT_MAX)


def _append(prev: DataFrame, n_prev: int, new: DataFrame, order: list, n_new: int = 0) -> DataFrame:
    """prev ranks 1..n_prev followed by the (already limited) new rows in ``order``; ``n_new`` bounds their number."""
    return _prev_ranked(prev, n_prev).unionByName(_numbered(new, order, n_prev, n_new > TOPN_DIRECT_MAX))


def _without(df: DataFrame, prev: DataFrame) -> DataFrame:
    return df.join(prev.select(ID), ID, "left_anti")


BROADCAST_MAX_ROWS = 100_000  # per-language tables broadcast below this many rows
TOPN_DIRECT_MAX = 10_000  # below this, per-task top-n lists are small enough to merge in one task


def top_n(df: DataFrame, n: int, score_col: str, ascending: bool = True) -> DataFrame:
    """The first ``n`` rows by (score, row_id), NULL scores last -- exact.

    Small n: ``orderBy().limit()`` (a TakeOrderedAndProject: per-task top-n,
    one merge). Large n: the merge would receive n rows from every task, so
    an approximate quantile of the score first cuts the table to a little
    over n rows (``score <= threshold`` keeps all ties), or to all rows if
    that keeps too few; those are ranked over range partitions.
    """
    sc = F.col(score_col).asc_nulls_last() if ascending else F.col(score_col).desc_nulls_last()
    order = [sc, F.col(ID)]
    if n <= TOPN_DIRECT_MAX:
        return df.orderBy(*order).limit(n)
    # several passes follow (counts, quantile, cut): score the rows once (e.g. mean distances)
    df = materialise(df, "topn_scores")
    total, live = df.agg(F.count(F.lit(1)), F.count(score_col)).first()
    if n >= total:
        return df
    cut = df
    if n < live:
        q = min(1.0, 1.02 * n / live + 2e-4)
        t = df.agg(F.percentile_approx(score_col, q if ascending else 1.0 - q, 10000)).first()[0]
        near = df.where(F.col(score_col) <= t) if ascending else df.where(F.col(score_col) >= t)
        cut = near if near.count() >= n else df
    return with_rank(cut, order).where(F.col("_rank") <= n).drop("_rank")


def select_top_score(scores: DataFrame, prev: DataFrame, budget: int, score_col: str = "uncertainty",
                     ascending: bool = True) -> DataFrame:
    """Rows with the smallest (or largest) score first; NULL scores last."""
    n_prev = prev.count()
    need = max(0, budget - n_prev)
    sc = F.col(score_col).asc_nulls_last() if ascending else F.col(score_col).desc_nulls_last()
    order = [sc, F.col(ID)]
    new = top_n(_without(scores, prev), need, score_col, ascending)
    return _append(prev, n_prev, new, order, need)


def select_uncertainty(scores: DataFrame, prev: DataFrame, budget: int) -> DataFrame:
    """SEL-2: smallest uncertainty (margin / negative loss) first."""
    return select_top_score(scores, prev, budget, "uncertainty", ascending=True)


def select_average_dist(pool: DataFrame, target: DataFrame, prev: DataFrame, budget: int,
                        metric: str = "l2", **kw) -> DataFrame:
    """SEL-1 / SEL-11: mean distance from each pool row to every target row, nearest first.

    With ``metric='cosine'`` the mean cosine similarity is ranked descending.
    """
    md = nb.mean_similarity_per_source(pool, target) if metric == "cosine" else nb.mean_distance_per_source(pool, target, **kw)
    md = md.select(F.col("src_id").alias(ID), F.col("mean_dist"))
    return select_top_score(md, prev, budget, "mean_dist", ascending=(metric != "cosine"))


def knn_levels(k0: int, budget: int, width: int) -> list[int]:
    """Doubling neighbour levels k0, 2k0, ... up to the first level that is > budget or > width."""
    levels = [k0]
    while levels[-1] <= budget and levels[-1] <= width:
        levels.append(levels[-1] * 2)
    return levels


def knn_level_for_budget(level_counts: dict[int, int], levels: list[int], n_prev: int,
                         budget: int, width: int) -> int:
    """Smallest level whose candidate set together with prev exceeds the budget,
    or the first level wider than the neighbour lists."""
    total = n_prev
    for j, k in enumerate(levels):
        total += level_counts.get(j, 0)
        if total > budget or k > width:
            return k
    return levels[-1]


def _level_index(best, k0: int):
    """Index j of the first level k0*2^j that covers rank ``best``."""
    return F.when(best <= k0, F.lit(0)).otherwise(F.ceil(F.log2(best / F.lit(float(k0))))).cast("int")


def knn_best(pool: DataFrame, target: DataFrame, budgets: list[int], k0: int = 1,
             max_neighbors: int | None = None, prev: DataFrame | None = None, **kw):
    """(best neighbour rank per pool row, written once; levels; width), as deep as the largest budget needs.

    Like the reference, k doubles until the candidates (with ``prev``) exceed
    the budget. Levels that cannot (targets x k rows at most) are skipped, each level
    continues the lists of the one before, and lists are no deeper than the level that ends the search. The
    neighbour-list width is the cap when one is given, else unbounded: once k
    reaches the pool, every level holds the same candidates.
    """
    width = max_neighbors if max_neighbors else float("inf")
    levels = knn_levels(k0, max(budgets), width)
    lists = nb.Neighbours(pool, target, **kw)
    n_prev = prev.count() if prev is not None else 0
    best = None
    for k in levels:
        if n_prev + lists.n_target * k <= max(budgets) and k <= min(width, lists.n_pool) and k != levels[-1]:
            continue
        depth = int(max(1, min(k, width)))
        # only the ranks that earlier levels did not list; a row that they hold keeps its better rank
        found = nb.best_rank(lists.extend(depth)).withColumnRenamed("src_id", ID)
        best = materialise(found if best is None else best.unionByName(found).groupBy(ID).agg(F.min("best").alias("best")), "knn_best")
        fresh = best if prev is None else _without(best, prev)
        if k > width or k >= lists.n_pool or n_prev + fresh.count() > max(budgets):
            break
    return best, levels, width


def select_knn_uncertainty(pool: DataFrame, target: DataFrame, scores: DataFrame, prev: DataFrame,
                           budget: int, k0: int = 1, max_neighbors: int | None = None, **kw) -> DataFrame:
    """SEL-3: the most uncertain rows among the k nearest pool rows of the targets.

    Each pool row keeps its best neighbour rank, and the candidates of level k
    are exactly the rows with best rank <= k, so one small grouped count
    picks the level.
    """
    prev = materialise(prev.select(ID, "prev_order"), "prev")
    best, levels, width = knn_best(pool, target, [budget], k0, max_neighbors, prev=prev, **kw)
    n_prev = prev.count()
    fresh = _without(best, prev)
    counts = {r["lvl"]: r["n"] for r in
              fresh.groupBy(_level_index(F.col("best"), k0).alias("lvl")).agg(F.count("*").alias("n")).collect()}
    k_star = knn_level_for_budget(counts, levels, n_prev, budget, width)
    cand = fresh.where(F.col("best") <= k_star).select(ID)
    need = max(0, budget - n_prev)
    order = [F.col("uncertainty").asc_nulls_last(), F.col(ID)]
    new = top_n(scores.join(cand, ID, "left_semi"), need, "uncertainty")
    return _append(prev, n_prev, new, order, need)


def empty_like(prev: DataFrame) -> DataFrame:
    return prev.limit(0)


def select_random(pool: DataFrame, prev: DataFrame, budget: int, seed: int = 42,
                  n_pool: int | None = None) -> DataFrame:
    """SEL-4: uniform without replacement (md5 order); a budget above the pool size takes every row."""
    n_pool = pool.count() if n_pool is None else n_pool
    if budget > n_pool:
        allrows = pool.select(ID)
        return _append(empty_like(prev), 0, allrows, [F.col(ID)], n_pool)
    n_prev = prev.count()
    need = max(0, budget - n_prev)
    order = [hash_key(seed), F.col(ID)]
    new = _random_n(_without(pool, prev), need, seed)
    return _append(prev, n_prev, new, order, need)


def _random_n(df: DataFrame, n: int, seed) -> DataFrame:
    """n rows in md5 order; large n uses the exact hash-prefix cut instead of a global sort."""
    if n <= TOPN_DIRECT_MAX:
        return df.orderBy(hash_key(seed), F.col(ID)).limit(n)
    from poolpick.operators.prepare import smallest_by_hash
    return smallest_by_hash(df, n, seed, ID)


def gold_languages(strategy: str) -> list[str]:
    """'gold_ur_ar' -> ['ur', 'ar']."""
    parts = strategy.split("_")
    if parts[0] != "gold" or len(parts) < 2:
        raise ValueError(f"not a gold strategy name: {strategy}")
    return parts[1:]


def select_gold(pool: DataFrame, prev: DataFrame, budget: int, strategy: str, seed: int = 42) -> DataFrame:
    """SEL-6: random selection restricted to the languages named in the strategy."""
    langs = gold_languages(strategy)
    return select_random(pool.where(F.col("language").isin(langs)), prev, budget, seed)


def parse_allocation(lines: DataFrame, col: str = "value") -> DataFrame:
    """SRC-6: 'dataset:config<TAB>iter_n<TAB>lang:count,...' -> (dataset, config, iteration, language, quota)."""
    f = F.split(F.trim(F.col(col)), "\t")
    head = F.split(f.getItem(0), ":")
    parsed = lines.select(head.getItem(0).alias("dataset"), head.getItem(1).alias("config"),
                          F.split(f.getItem(1), "_").getItem(1).cast("int").alias("iteration"),
                          F.explode(F.split(f.getItem(2), ",")).alias("item"))
    kv = F.split(F.col("item"), ":")
    return parsed.select("dataset", "config", "iteration", kv.getItem(0).alias("language"),
                         kv.getItem(1).cast("long").alias("quota"))


def select_allocated(pool: DataFrame, allocation: DataFrame, dataset: str, config: str, iteration: int,
                     seed: int = 42) -> DataFrame:
    """SEL-5: per-language quotas from an allocation table; prev is ignored.

    Languages without a quota contribute nothing; a quota above the
    language size takes the whole language. Rows are ranked per language
    in md5 order (a per-language window limited to the quota, planned as a
    ``WindowGroupLimit``).
    """
    q = allocation.where((F.col("dataset") == dataset) & (F.col("config") == config)
                         & (F.col("iteration") == iteration)).select("language", "quota")
    q = q.groupBy("language").agg(F.first("quota").alias("quota"))  # a key that is listed twice counts once
    max_quota, n_rows, n_lang = q.agg(F.max("quota"), F.sum("quota"), F.count("*")).first()
    max_quota, n_rows = max_quota or 0, n_rows or 0
    j = pool.select(ID, "language").join(F.broadcast(q) if n_lang <= BROADCAST_MAX_ROWS else q, "language")
    w = Window.partitionBy("language").orderBy(hash_key(seed), F.col(ID))
    # the literal bound lets Spark cut every language to max_quota rows per task before the shuffle
    picked = j.withColumn("lrank", F.row_number().over(w)) \
        .where((F.col("lrank") <= int(max_quota)) & (F.col("lrank") <= F.col("quota")))
    return _numbered(picked, [F.col("language"), F.col("lrank")], 0, n_rows > TOPN_DIRECT_MAX)


def select_egalitarian(pool: DataFrame, prev: DataFrame, budget: int, seed: int = 42) -> DataFrame:
    """SEL-7: equal quota per language, small languages whole, the rest filled at random.

    quota = floor((budget - n_prev) / L); a language with at most
    floor(budget / L) rows is taken whole. Remaining budget is filled in
    md5 order from all languages. Order: prev, per-language picks (by
    language, then md5), then the fill.
    """
    n_prev = prev.count()
    sizes = pool.groupBy("language").agg(F.count("*").alias("lang_n"))
    n_lang = sizes.count()
    if n_lang == 0:
        return _prev_ranked(prev, n_prev)
    quota = (budget - n_prev) // n_lang
    small = budget // n_lang
    # one row per language: broadcast only when that count is small (it was just counted)
    rest = _without(pool.select(ID, "language"), prev).join(
        F.broadcast(sizes) if n_lang <= BROADCAST_MAX_ROWS else sizes, "language")
    w = Window.partitionBy("language").orderBy(hash_key(seed), F.col(ID))
    ranked = rest.withColumn("lrank", F.row_number().over(w))
    # literal rank bound first (a WindowGroupLimit: a hot language is cut per task before
    # the shuffle); small languages (<= small rows) are wholly inside it
    phase1 = ranked.where((F.col("lrank") <= max(quota, small))
                          & ((F.col("lang_n") <= small) | (F.col("lrank") <= quota)))
    need1 = max(0, budget - n_prev)
    # phase 1 (<= budget rows) feeds a count and the result: one pass over the pool, written once
    p1 = materialise(phase1.orderBy("language", "lrank").limit(need1).select(ID, "language", "lrank"), "egal_p1")
    p1_ranked = _append(prev, n_prev, p1, [F.col("language"), F.col("lrank")], need1)
    n_now = n_prev + p1.count()
    if n_now >= budget:
        return p1_ranked
    order = [hash_key(seed), F.col(ID)]
    fill = _random_n(_without(pool.select(ID), p1_ranked), budget - n_now, seed)
    return _append(p1_ranked.select(ID, F.col("rank").alias("prev_order")), n_now, fill, order, budget - n_now)
