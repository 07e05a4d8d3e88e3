"""Scoring queries: log-softmax, uncertainty, loss, pooled embeddings, batch scorers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from poolpick import fixtures as fx
from poolpick.fixtures import with_views
from poolpick.functions.scores import argmax, top2_margin
from poolpick.operators import embeddings as emb
from poolpick.operators import uncertainty as unc
from poolpick.operators.batches import linear_scorer, map_batches, score_batches
from poolpick.plans.registry import r6, register


# DuckDB expression snippets (list indexing is 1-based there)
def _lse(z):
    return f"(list_max({z}) + ln(list_sum(list_transform({z}, lambda x: exp(x - list_max({z}))))))"


def _margin(z):
    return f"(list_sort({z}, 'DESC')[1] - list_sort({z}, 'DESC')[2])"


def _maxlp(z):
    return f"(list_max({z}) - {_lse(z)})"


def _ce(z, lab):
    return f"(CASE WHEN {lab} = -100 THEN 0.0 ELSE {_lse(z)} - {z}[{lab} + 1] END)"


_TOK_MARGIN = f"CASE WHEN lab = -100 THEN 0.0 ELSE {_margin('z')} END"


def _out(df, *cols):
    return df.select(*[r6(c).alias(c) if c in ("uncertainty", "loss", "logp", "value") else c for c in cols])


@register("log_softmax", with_views(
    f"SELECT row_id, CAST(i - 1 AS INTEGER) AS cls, round(z[i] - {_lse('z')}, 6) AS logp "
    f"FROM seqlog, range(1, 4) t(i)", "seqlog"))
def q_log_softmax(spark, sf_dir):
    return _out(unc.log_softmax_long(fx.seqlog_df(spark, sf_dir)), "row_id", "cls", "logp")


_TOKEN_SQL = {
    "min": f"coalesce(min(m) FILTER (WHERE m <> 0), 'Infinity'::DOUBLE)",
    "mean": "sum(m) / NULLIF(count(*) FILTER (WHERE lab <> -100), 0)",
    "max": "max(m)",
    "mnlp": f"sum(CASE WHEN lab <> -100 THEN {_maxlp('z')} ELSE 0.0 END) "
            f"/ NULLIF(count(*) FILTER (WHERE lab <> -100), 0)",
}


def _token_query(method):
    def q(spark, sf_dir):
        return _out(unc.token_uncertainty(fx.tok_df(spark, sf_dir), method), "row_id", "uncertainty")

    return q


for _m, _agg in _TOKEN_SQL.items():
    register(f"unc_token_{_m}", with_views(
        f"SELECT row_id, round({_agg}, 6) AS uncertainty FROM (SELECT *, {_TOK_MARGIN} AS m FROM tok) "
        f"GROUP BY row_id", "tok"))(_token_query(_m))


@register("unc_sequence", with_views(
    f"SELECT row_id, round({_margin('z')}, 6) AS uncertainty FROM seqlog", "seqlog"))
def q_unc_sequence(spark, sf_dir):
    return _out(unc.sequence_uncertainty(fx.seqlog_df(spark, sf_dir)), "row_id", "uncertainty")


@register("unc_qa_logits", with_views(
    f"SELECT feature_id, example_id, round({_maxlp('zs')} + {_maxlp('ze')}, 6) AS uncertainty FROM qafeat",
    "qafeat"))
def q_unc_qa_logits(spark, sf_dir):
    return _out(unc.qa_uncertainty(fx.qafeat_df(spark, sf_dir), "logits"), "feature_id", "example_id", "uncertainty")


@register("unc_qa_margin", with_views(
    f"SELECT feature_id, example_id, round({_margin('zs')} + {_margin('ze')}, 6) AS uncertainty FROM qafeat",
    "qafeat"))
def q_unc_qa_margin(spark, sf_dir):
    return _out(unc.qa_uncertainty(fx.qafeat_df(spark, sf_dir), "margin"), "feature_id", "example_id", "uncertainty")


@register("unc_mt", with_views(
    f"SELECT row_id, round(-(sum(ce) / NULLIF(count(*) FILTER (WHERE ce <> 0), 0)), 6) AS uncertainty "
    f"FROM (SELECT row_id, {_ce('z', 'lab')} AS ce FROM mtlog) GROUP BY row_id", "mtlog"))
def q_unc_mt(spark, sf_dir):
    return _out(unc.mt_uncertainty(fx.mtlog_df(spark, sf_dir)), "row_id", "uncertainty")


@register("unc_example_max", with_views(
    f"SELECT example_id, round(max({_margin('zs')} + {_margin('ze')}), 6) AS uncertainty FROM qafeat "
    f"GROUP BY example_id", "qafeat"))
def q_unc_example_max(spark, sf_dir):
    f = unc.qa_uncertainty(fx.qafeat_df(spark, sf_dir), "margin")
    return _out(unc.example_max(f), "example_id", "uncertainty")


@register("loss_token", with_views(
    f"SELECT row_id, round(sum(ce) / NULLIF(count(*) FILTER (WHERE ce <> 0), 0), 6) AS loss "
    f"FROM (SELECT row_id, {_ce('z', 'lab')} AS ce FROM tok) GROUP BY row_id", "tok"))
def q_loss_token(spark, sf_dir):
    return _out(unc.token_loss(fx.tok_df(spark, sf_dir)), "row_id", "loss")


@register("loss_sequence", with_views(
    f"SELECT row_id, gold, round({_ce('z', 'gold')}, 6) AS loss FROM seqlog", "seqlog"))
def q_loss_sequence(spark, sf_dir):
    return _out(unc.sequence_loss(fx.seqlog_df(spark, sf_dir)), "row_id", "gold", "loss")


def _qa_gold(df):
    """Gold start/end positions derived from the feature id (start <= end < 32)."""
    return df.withColumn("start_positions", (F.col("feature_id") % 29).cast("int")) \
        .withColumn("end_positions", (F.col("feature_id") % 29 + F.col("feature_id") % 3).cast("int"))


@register("loss_qa", with_views(
    f"SELECT example_id, round(max({_ce('zs', 's')} + {_ce('ze', 'e')}), 6) AS loss FROM "
    f"(SELECT *, CAST(feature_id % 29 AS INTEGER) AS s, CAST(feature_id % 29 + feature_id % 3 AS INTEGER) AS e "
    f"FROM qafeat) GROUP BY example_id", "qafeat"))
def q_loss_qa(spark, sf_dir):
    """LOSS-1 QA: start CE + end CE per feature, max per example."""
    f = unc.qa_loss(_qa_gold(fx.qafeat_df(spark, sf_dir)))
    return _out(unc.example_max(f, "loss"), "example_id", "loss")


# ---------------------------------------------------------------- embeddings
@register("embed_cls", with_views(
    "SELECT row_id, CAST(i - 1 AS INTEGER) AS dim, round(h[i], 6) AS value FROM states, range(1, 9) t(i) "
    "WHERE pos = 0", "states"))
def q_embed_cls(spark, sf_dir):
    c = emb.cls_embedding(fx.states_df(spark, sf_dir))
    return _out(c.select("row_id", F.posexplode("embedding").alias("dim", "value")), "row_id", "dim", "value")


@register("embed_masked_mean", with_views(
    "SELECT row_id, CAST(i - 1 AS INTEGER) AS dim, round(sum(h[i] * attn) / greatest(sum(attn), 1e-9), 6) "
    "AS value FROM states, range(1, 9) t(i) GROUP BY row_id, i", "states"))
def q_embed_masked_mean(spark, sf_dir):
    long = emb.masked_mean_long(fx.states_df(spark, sf_dir), F.col("attn"))
    return _out(long, "row_id", "dim", "value")


@register("embed_label_mean", with_views(
    "SELECT row_id, CAST(i - 1 AS INTEGER) AS dim, round(sum(z[i] * CASE WHEN lab <> -100 THEN 1.0 ELSE 0.0 END) "
    "/ greatest(sum(CASE WHEN lab <> -100 THEN 1.0 ELSE 0.0 END), 1e-9), 6) AS value "
    "FROM tok, range(1, 5) t(i) GROUP BY row_id, i", "tok"))
def q_embed_label_mean(spark, sf_dir):
    """EMB-3: first-subword mean, the mask being label <> -100."""
    long = emb.masked_mean_long(fx.tok_df(spark, sf_dir), F.col("lab") != -100, vec_col="z")
    return _out(long, "row_id", "dim", "value")


@register("embed_example_mean", with_views(
    "SELECT example_id, CAST(i - 1 AS INTEGER) AS dim, round(avg(zs[i]), 6) AS value "
    "FROM qafeat, range(1, 33) t(i) GROUP BY example_id, i", "qafeat"))
def q_embed_example_mean(spark, sf_dir):
    long = emb.example_mean_long(fx.qafeat_df(spark, sf_dir), "zs")
    return _out(long, "example_id", "dim", "value")


@register("argmax_predict", with_views(
    "SELECT row_id, CAST(list_position(z, list_max(z)) - 1 AS INTEGER) AS pred, gold FROM seqlog", "seqlog"))
def q_argmax_predict(spark, sf_dir):
    s = fx.seqlog_df(spark, sf_dir)
    return s.select("row_id", argmax(F.col("z")).alias("pred"), "gold")


# ---------------------------------------------------------------- batch UDFs
N_CLASSES = 3


def scorer_weights(dim: int = 64, n_classes: int = N_CLASSES) -> np.ndarray:
    """Deterministic linear scorer weights: w[i, j] = (((i * 5 + j * 3) % 11) - 5) / 10."""
    i = np.arange(dim)[:, None]
    j = np.arange(n_classes)[None, :]
    return (((i * 5 + j * 3) % 11) - 5) / 10.0


def _w_sql(dim=64):
    w = scorer_weights(dim)
    cols = []
    for j in range(N_CLASSES):
        lit = "[" + ", ".join(repr(float(x)) for x in w[:, j]) + "]::DOUBLE[]"
        cols.append(f"list_dot_product(emb, {lit})")
    return cols


_LOGITS = "[" + ", ".join(_w_sql()) + "]"


@register("score_batch", with_views(
    f"SELECT row_id, round({_margin('lg')}, 6) AS uncertainty, CAST(list_position(lg, list_max(lg)) - 1 AS INTEGER) "
    f"AS pred FROM (SELECT row_id, {_LOGITS} AS lg FROM pool)", "pool"))
def q_score_batch(spark, sf_dir):
    """UDF-1: a user batch scorer (here linear) run with mapInPandas, then margin + argmax."""
    pool = fx.pool_df(spark, sf_dir)
    scored = score_batches(pool, linear_scorer(scorer_weights()), id_col="row_id", vec_col="emb")
    return scored.select("row_id", r6(top2_margin(F.col("logits"))).alias("uncertainty"),
                         argmax(F.col("logits")).alias("pred"))


def _doc_stats(pdf: pd.DataFrame, newline: str = "\n") -> pd.DataFrame:
    return pd.DataFrame({"row_id": pdf["row_id"], "language": pdf["language"],
                         "n_chars": pdf["text"].str.len().astype("int64"),
                         "n_lines": (pdf["text"].str.count(newline) + 1).astype("int64")})


@register("map_batches", with_views(
    "SELECT row_id, language, CAST(length(text) AS BIGINT) AS n_chars, "
    "CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS n_lines FROM docs", "docs"))
def q_map_batches(spark, sf_dir):
    """UDF-2: a batched user transform with a bound argument; raw columns dropped."""
    return map_batches(fx.docs_df(spark, sf_dir), _doc_stats, "row_id long, language string, n_chars long, "
                                                              "n_lines long", newline="\n")
