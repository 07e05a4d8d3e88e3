"""Extractive-QA roll-ups (JOIN-4, JOIN-9, MET-6).

Best-span search runs on Arrow batches: the logits of a batch are matrices, logits outside the n-best
or without an offset are blanked, and a running maximum of the starts (a sliding one if the length
limit binds) meets every end once. A feature costs its positions, not its n_best^2 pairs, and nothing loops over
rows in Python. Only the per-example maximum shuffles: one small row per feature, combined before the exchange.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counted(z: np.ndarray, live: np.ndarray, n_best: int) -> np.ndarray:
    """Logits that are among the n_best largest of their row (ties from the left) and live; -inf elsewhere."""
    z = np.where(np.isnan(z), -np.inf, z)
    if n_best < z.shape[1]:
        low = np.partition(z, z.shape[1] - n_best, axis=1)[:, [z.shape[1] - n_best]]
        above, tied = z > low, z == low
        among = above | (tied & (np.cumsum(tied, axis=1) <= n_best - above.sum(axis=1, keepdims=True)))
    else:
        among = np.ones(z.shape, bool)
    return np.where(among & live, z, -np.inf)


def sliding_max(z: np.ndarray, width: int) -> np.ndarray:
    """Per row, the maximum of each value and the width - 1 before it, by doubling."""
    if width >= z.shape[1]:
        return np.maximum.accumulate(z, axis=1)

    def with_earlier(x, by):
        out = x.copy()
        out[:, by:] = np.maximum(x[:, by:], x[:, :-by]) if by else x
        return out

    reach, out = 1, z
    while 2 * reach <= width:
        out, reach = with_earlier(out, reach), 2 * reach
    return with_earlier(out, width - reach) if reach < width else out


def best_spans_of(starts: np.ndarray, ends: np.ndarray, live: np.ndarray, n_best: int, max_len: int):
    """(found, score, start, end) of every row: start and end among the n_best, live, start <= end < start + max_len.

    The highest score wins, then the earliest start, then the earliest end.
    """
    s, e = counted(starts, live, n_best), counted(ends, live, n_best)
    top = sliding_max(s, max_len)
    with np.errstate(invalid="ignore"):
        score = np.where(np.isneginf(top) | np.isneginf(e), -np.inf, top + e)
    row = np.arange(len(score))
    best = score.max(axis=1)
    place = np.arange(s.shape[1])
    # among the ends of the best score: the earliest start that reaches one of them, then the earliest such end
    first = np.full(len(score), s.shape[1])
    end = score.argmax(axis=1)
    for at in np.flatnonzero((score == best[:, None]).any(axis=0)):
        mine = np.flatnonzero((score[:, at] == best) & ~np.isneginf(best))
        lo = max(0, at - max_len + 1)
        start = lo + (s[mine, lo:at + 1] == top[mine, at][:, None]).argmax(axis=1)
        earlier = start < first[mine]
        first[mine[earlier]], end[mine[earlier]] = start[earlier], place[at]
    return ~np.isneginf(best), best, first, end[row]


_SPANS = "feature long, score double, start int, end int, cs int, ce int"


def feature_spans(features: DataFrame, n_best: int = 20, max_len: int = 30, feature_col="feature_id", example_col="example_id",
                  start_col="zs", end_col="ze", offsets_col="offsets") -> DataFrame:
    """example, feature, score, start, end and the character span (cs, ce) of every feature with a span.

    Offsets are lists of (s, e), NULL where a position is no context; the three lists of a feature are equally
    long. A NULL or NaN logit never counts.
    """
    kind = features.schema[example_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            lists = [b.column(i) for i in (2, 3, 4)]
            size = np.diff(lists[0].offsets.to_numpy()) * ~np.asarray(lists[0].is_null())
            for n in np.unique(size[size > 0]):
                at = pa.array(np.flatnonzero(size == n))
                s, e, o = (x.take(at).flatten() for x in lists)
                if not len(s) == len(e) == len(o):
                    raise ValueError("starts, ends and offsets of a feature differ in length")
                matrix = lambda x: x.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, n)
                found, score, start, end = best_spans_of(matrix(s), matrix(e), np.asarray(o.is_valid()).reshape(-1, n), n_best, max_len)
                row = np.flatnonzero(found)
                span = lambda place, field: o.field(field).take(pa.array(row * n + place[row])).cast(pa.int32())
                keys = at.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(keys), b.column(1).take(keys).cast(pa.int64()), pa.array(score[row]), pa.array(start[row].astype(np.int32)),
                     pa.array(end[row].astype(np.int32)), span(start, "s"), span(end, "e")], ["example", "feature", "score", "start", "end", "cs", "ce"])

    return features.select(example_col, feature_col, start_col, end_col, offsets_col).mapInArrow(run, f"example {kind}, {_SPANS}")


def best_spans(features: DataFrame, contexts: DataFrame, n_best: int = 20, max_len: int = 30,
               feature_col="feature_id", example_col="example_id", start_col="zs", end_col="ze",
               offsets_col="offsets", context_col="context") -> DataFrame:
    """MET-6: best answer span per example over all of its features, text cut from the
    context by character offsets; '' when no span qualifies.

    ``contexts`` holds one row per example (example_id, context). Equal scores go to the smaller feature, start and end.
    """
    f = feature_spans(features, n_best, max_len, feature_col, example_col, start_col, end_col, offsets_col)
    key = F.struct("score", -F.col("feature"), -F.col("start"), -F.col("end"))
    m = F.struct(F.col("feature").alias("fid"), "score", F.col("start").alias("si"), F.col("end").alias("ei"), "cs", "ce")
    per_ex = f.groupBy(F.col("example").alias(example_col)).agg(F.max_by(m, key).alias("m"))
    j = contexts.join(per_ex, example_col, "left")
    text = F.when(F.col("m").isNull(), F.lit("")).otherwise(
        F.expr(f"substring({context_col}, m.cs + 1, m.ce - m.cs)"))
    return j.select(example_col, F.col("m.fid").alias("feature_id"), F.col("m.si").alias("start"),
                    F.col("m.ei").alias("end"), F.col("m.score").alias("score"), text.alias("answer"))


def feature_to_example(raw: DataFrame, features: DataFrame, raw_id: str = "row_id",
                       example_col: str = "example_id", check: bool = True) -> DataFrame:
    """JOIN-4: attach raw example columns to their feature rows; a feature whose
    example has no raw row is an error (checked with an anti join)."""
    if check:
        orphans = features.join(raw.select(F.col(raw_id).alias(example_col)), example_col, "left_anti").limit(1).count()
        if orphans:
            raise ValueError("feature rows reference examples missing from the raw table")
    return features.join(raw.withColumnRenamed(raw_id, example_col), example_col)
