"""Uncertainty and loss per row (UNC-1..10, LOSS-1).

Lower uncertainty = more uncertain = selected first, for every variant.
Token-level inputs come in long form ``(row_id, pos, z, lab)`` and are
reduced with one grouped aggregate (partial aggregation before the
shuffle); sequence and QA inputs are one row per example and need no
shuffle at all. Masked positions carry label -100.

SQL has no silent NaN: an all-masked row gives NULL (not NaN) for the
mean and mnlp variants; NULLs sort last when selecting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolpick.functions.scores import (MASK, cross_entropy, log_softmax, masked_margin, max_log_prob,
                                       top2_margin)

TOKEN_METHODS = ("min", "mean", "max", "mnlp")


def token_uncertainty(tok: DataFrame, method: str = "min", id_col: str = "row_id",
                      z_col: str = "z", lab_col: str = "lab") -> DataFrame:
    """UNC-2..5 over long-form token logits -> (row_id, uncertainty).

    min:  smallest non-zero margin (masked positions have margin 0 and are
          skipped, as are exact zero margins); +inf when none is left.
    mean: sum of margins / number of unmasked positions.
    max:  largest margin, masked positions counting as 0.
    mnlp: mean over unmasked positions of the top log-probability.
    """
    if method not in TOKEN_METHODS:
        raise ValueError(f"token margin method must be one of {TOKEN_METHODS}")
    m = masked_margin(F.col(z_col), F.col(lab_col))
    live = F.col(lab_col) != MASK
    n_live = F.nullif(F.count_if(live), F.lit(0))
    if method == "min":
        agg = F.coalesce(F.min(F.when(m != 0, m)), F.lit(float("inf")))
    elif method == "mean":
        agg = F.sum(m) / n_live
    elif method == "max":
        agg = F.max(m)
    else:
        agg = F.sum(F.when(live, max_log_prob(F.col(z_col))).otherwise(F.lit(0.0))) / n_live
    return tok.groupBy(id_col).agg(agg.alias("uncertainty"))


def sequence_uncertainty(df: DataFrame, z_col: str = "z") -> DataFrame:
    """UNC-6: margin between the two most probable classes."""
    return df.withColumn("uncertainty", top2_margin(F.col(z_col)))


def qa_uncertainty(df: DataFrame, method: str = "logits", start_col: str = "zs", end_col: str = "ze") -> DataFrame:
    """UNC-7 (``logits``: best start log-prob + best end log-prob) or UNC-8 (``margin``)."""
    if method == "logits":
        u = max_log_prob(F.col(start_col)) + max_log_prob(F.col(end_col))
    elif method == "margin":
        u = top2_margin(F.col(start_col)) + top2_margin(F.col(end_col))
    else:
        raise ValueError("qa method must be 'logits' or 'margin'")
    return df.withColumn("uncertainty", u)


def mt_uncertainty(tok: DataFrame, id_col: str = "row_id", z_col: str = "z", lab_col: str = "lab") -> DataFrame:
    """UNC-9: minus the mean token cross entropy over non-zero losses."""
    ce = cross_entropy(F.col(z_col), F.col(lab_col))
    return tok.groupBy(id_col).agg(
        (-(F.sum(ce) / F.nullif(F.count_if(ce != 0), F.lit(0)))).alias("uncertainty"))


def example_max(features: DataFrame, value_col: str = "uncertainty", example_col: str = "example_id") -> DataFrame:
    """UNC-10 / LOSS-1 roll-up: an example scores the max over its feature rows."""
    return features.groupBy(example_col).agg(F.max(value_col).alias(value_col))


def token_loss(tok: DataFrame, id_col: str = "row_id", z_col: str = "z", lab_col: str = "lab") -> DataFrame:
    """LOSS-1 token: mean cross entropy over positions with non-zero loss."""
    ce = cross_entropy(F.col(z_col), F.col(lab_col))
    return tok.groupBy(id_col).agg((F.sum(ce) / F.nullif(F.count_if(ce != 0), F.lit(0))).alias("loss"))


def sequence_loss(df: DataFrame, z_col: str = "z", label_col: str = "gold") -> DataFrame:
    return df.withColumn("loss", cross_entropy(F.col(z_col), F.col(label_col)))


def qa_loss(df: DataFrame, start_col="zs", end_col="ze", start_label="start_positions",
            end_label="end_positions") -> DataFrame:
    """LOSS-1 QA: start cross entropy + end cross entropy."""
    return df.withColumn("loss", cross_entropy(F.col(start_col), F.col(start_label))
                         + cross_entropy(F.col(end_col), F.col(end_label)))


def log_softmax_long(df: DataFrame, id_col: str = "row_id", z_col: str = "z") -> DataFrame:
    """UNC-1 in long form: (row_id, cls, logp)."""
    return df.select(id_col, F.posexplode(log_softmax(F.col(z_col))).alias("cls", "logp"))
