"""Multi-round and multi-budget selection drivers (SEL-8, SEL-9, UDF-5).

Only round control lives on the driver. Each round is one Spark job whose
selection is written to the shared checkpoint folder and read back: that
cuts the lineage (round r does not recompute rounds 1..r-1) and survives
the loss of executors.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolpick.functions.scores import top2_margin
from poolpick.functions.vectors import arrow_matrix
from poolpick.operators import strategies as st
from poolpick.session import materialise

ID = "row_id"


def run_rounds(spark, select: Callable[[int, DataFrame, int], DataFrame], budget: int, rounds: int,
               prev: DataFrame | None = None) -> DataFrame:
    """SEL-8: ``per_round = budget // rounds``; round r selects up to r * per_round rows
    given the previous selection. Returns (row_id, round, rank), rows tagged with the
    round that added them."""
    per_round = budget // rounds
    sel = prev if prev is not None else st.empty_prev(spark)
    n_prev = sel.count()
    added = []
    for r in range(1, rounds + 1):
        cur = materialise(select(r, sel, r * per_round), f"round{r}")
        added.append(cur.where(F.col("rank") > n_prev).withColumn("round", F.lit(r)))
        sel = cur.select(ID, F.col("rank").alias("prev_order"))
        n_prev = cur.count()
    out = added[0]
    for a in added[1:]:
        out = out.unionByName(a)
    return out.select(ID, "round", "rank")


def uncertainty_rounds(spark, scores: DataFrame, budget: int, rounds: int) -> DataFrame:
    """Rounds of SEL-2 on fixed scores (round r is a prefix of round r+1)."""
    return run_rounds(spark, lambda r, prev, b: st.select_uncertainty(scores, prev, b), budget, rounds)


def refit_rounds(spark, pool: DataFrame, labels: DataFrame, budget: int, rounds: int, seed: int = 42,
                 max_iter: int = 50) -> DataFrame:
    """UDF-5: round 1 is a random cold start; every later round fits an MLlib logistic
    regression on the rows selected so far (embeddings -> gold label), rescores the
    whole pool and selects by the top-2 log-probability margin."""
    feats = pool.select(ID, array_to_vector("emb").alias("features"))

    def rescore(picked):
        train = feats.join(picked, ID, "left_semi").join(labels, ID)
        model = LogisticRegression(maxIter=max_iter, labelCol="label").fit(train)
        prob = model.transform(feats).select(ID, vector_to_array("probability").alias("p"))
        return prob.select(ID, top2_margin(F.transform("p", lambda x: F.log(x))).alias("uncertainty"))

    return _model_rounds(spark, pool, rescore, budget, rounds, seed)


def _model_rounds(spark, pool: DataFrame, rescore, budget: int, rounds: int, seed: int) -> DataFrame:
    """Round 1 at random; ``rescore(rows picked so far)`` gives the pool's uncertainty for every later round."""

    def select(r, prev, b):
        return st.select_random(pool, prev, b, seed) if r == 1 else st.select_uncertainty(rescore(prev.select(ID)), prev, b)

    return run_rounds(spark, select, budget, rounds)


def ridge_weights(train: DataFrame, n_classes: int, alpha: float = 1.0) -> np.ndarray:
    """(dimensions + 1) x classes: weights (the last row is the intercept) that fit one-hot labels by
    ridge regression, from the sums of x x' and x y' over ``train`` (emb, label): one aggregate, of any number of rows.

    Rows without a vector, without a label or with a label outside 0 .. n_classes - 1 are left out.
    """
    rows = train.where(F.col("emb").isNotNull() & F.col("label").between(0, n_classes - 1)).select("emb", F.col("label").cast("int").alias("label"))

    def products(batches):
        total = None
        for b in batches:
            if b.num_rows:
                x = np.concatenate([arrow_matrix(b.column(0)), np.ones((b.num_rows, 1))], 1)
                now = x.T @ np.concatenate([x, np.eye(n_classes)[np.asarray(b.column(1))]], 1)
                total = now if total is None else total + now
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "sums"])

    parts = rows.mapInArrow(products, "i int, sums array<double>")
    first = rows.select(F.size("emb").alias("d")).first()
    if first is None:
        raise ValueError("no row with a vector and a label to fit on")
    d = first["d"] + 1
    sums = parts.groupBy("i").agg(F.array(*[F.sum(F.col("sums")[j]) for j in range(d + n_classes)]).alias("sums")).collect()  # a row for each dimension
    total = np.array([r["sums"] for r in sorted(sums)])
    return np.linalg.solve(total[:, :d] + alpha * np.eye(d), total[:, d:])


def linear_logits(weights: np.ndarray, emb: str = "emb"):
    """One logit for each column of ``ridge_weights``, inside the JVM."""
    dot = lambda w: F.aggregate(F.zip_with(F.col(emb), F.array(*[F.lit(float(x)) for x in w[:-1]]), lambda x, y: x * y),
                                F.lit(float(w[-1])), lambda a, x: a + x)
    return F.array(*[dot(w) for w in weights.T])


def ridge_rounds(spark, pool: DataFrame, labels: DataFrame, budget: int, rounds: int, n_classes: int, seed: int = 42,
                 alpha: float = 1.0) -> DataFrame:
    """UDF-5 with a closed form: as ``refit_rounds``, but each refit is a ridge regression on the one-hot labels."""

    def rescore(picked):
        w = ridge_weights(pool.join(picked, ID, "left_semi").join(labels, ID), n_classes, alpha)
        return pool.where(F.col("emb").isNotNull()).select(ID, top2_margin(linear_logits(w)).alias("uncertainty"))

    return _model_rounds(spark, pool, rescore, budget, rounds, seed)


def multi_budget_top(scores: DataFrame, budgets: list[int], score_col: str = "uncertainty") -> DataFrame:
    """SEL-9 for score-ranked strategies: rank once (top max(budgets)), then every budget
    is a prefix. Returns (budget, row_id, rank)."""
    order = [F.col(score_col).asc_nulls_last(), F.col(ID)]
    sel = st._append(st.empty_like(st.empty_prev(scores.sparkSession)), 0,
                     st.top_n(scores, max(budgets), score_col), order, max(budgets))
    b = F.explode(F.array(*[F.lit(int(x)) for x in sorted(budgets)])).alias("budget")
    return sel.select(b, ID, "rank").where(F.col("rank") <= F.col("budget"))


def multi_budget_knn(pool: DataFrame, target: DataFrame, scores: DataFrame, budgets: list[int], k0: int = 1,
                     max_neighbors: int | None = None) -> DataFrame:
    """SEL-9 for kNN-uncertainty: neighbour ranks computed once for the largest budget,
    each budget gets its own level k, candidates ranked per budget (a per-budget
    window limited to the budget)."""
    from pyspark.sql import Window

    best, levels, width = st.knn_best(pool, target, budgets, k0, max_neighbors)
    counts = {r["lvl"]: r["n"] for r in
              best.groupBy(st._level_index(F.col("best"), k0).alias("lvl")).agg(F.count("*").alias("n")).collect()}
    kb = [(b, st.knn_level_for_budget(counts, levels, 0, b, width)) for b in sorted(budgets)]
    pairs = F.explode(F.array(*[F.struct(F.lit(b).alias("budget"), F.lit(k).alias("k")) for b, k in kb]))
    cand = best.select(ID, "best", pairs.alias("bk")).where(F.col("best") <= F.col("bk.k")) \
        .select(ID, F.col("bk.budget").alias("budget"))
    w = Window.partitionBy("budget").orderBy(F.col("uncertainty").asc_nulls_last(), F.col(ID))
    ranked = cand.join(scores.select(ID, "uncertainty"), ID).withColumn("rank", F.row_number().over(w).cast("long"))
    # the literal bound (largest budget) lets Spark cut each budget's candidates per task
    return ranked.where((F.col("rank") <= max(budgets)) & (F.col("rank") <= F.col("budget"))) \
        .select("budget", ID, "rank")
