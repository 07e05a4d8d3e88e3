"""Quality classifier: regularised quadratic discriminant on document statistics.

Each class has its own mean and covariance over transformed statistics of
the whole text. Covariances are shrunk twice: towards the pooled
covariance (``alpha``) and towards its average variance (``gamma``). A
text's score is the logistic of the difference of the two Mahalanobis log
densities plus the log prior; it is computed with the Cholesky factors,
which are made once on the driver and shipped with the scoring function.

Fitting reads all labelled training rows: every task returns its moment
sums (one row of fixed width), Spark adds them up, and only the two
``d x d`` moment matrices reach the driver. No sample is drawn.

Cases: an empty or null text has zero statistics and gets a score like any
other; a null doc_id is never held out and never learnt from; repeated
rows are scored each for itself, repeated labels count each; with fewer
than two classes labelled every score is the share of label 1 (0.5 without
labels); an empty table gives an empty result. Further columns of
``docs`` never reach the score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolpick.llm.common import write_out
from poolpick.llm.features import STATS, column_features, list_column, matrix_of

ALPHA, GAMMA = 0.5, 0.02  # shrinkage to the pooled covariance, to a sphere
D = len(STATS)
SLICE_ROWS = 1_000
SKEWED = [i for i, s in enumerate(STATS) if s.endswith("ratio")]
#: below this share of digits, marks or repeats a ratio is told apart by its logarithm
FLOOR = 0.01


def transform(stats: np.ndarray) -> np.ndarray:
    """Logarithms of the skewed ratios; the others as they are."""
    x = stats.copy()
    x[:, SKEWED] = np.log(x[:, SKEWED] + FLOOR)
    x[:, STATS.index("words_per_line")] = np.log1p(x[:, STATS.index("words_per_line")])
    return x


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _features(batches):
    for b in batches:
        _, stats = column_features(b.column(1))
        yield pa.RecordBatch.from_arrays([b.column(0), list_column(transform(stats))], ["doc_id", "x"])


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and transformed statistics of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(_features, f"doc_id {kind}, x array<double>")


def _moments(batches):
    """Per task and class: n, sum of x, sum of x x'."""
    acc = {c: [0.0, np.zeros(D), np.zeros((D, D))] for c in (0, 1)}
    for b in batches:
        x, y = matrix_of(b.column(0), D), np.asarray(b.column(1))
        for c in (0, 1):
            z = x[y == c]
            acc[c][0] += len(z)
            acc[c][1] += z.sum(0)
            acc[c][2] += z.T @ z
    flat = np.stack([np.concatenate([[a[0]], a[1], a[2].ravel()]) for a in acc.values()])
    yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), list_column(flat)], ["y", "m"])


def fit(labelled: DataFrame, alpha: float = ALPHA, gamma: float = GAMMA) -> dict:
    """Model from rows (x, y); the driver receives 2 x (1 + d + d^2) sums."""
    width = 1 + D + D * D
    parts = labelled.select("x", F.col("y").cast("int").alias("y")).mapInArrow(_moments, "y int, m array<double>")
    rows = (parts.select("y", F.posexplode("m").alias("i", "v")).groupBy("y", "i").agg(F.sum("v").alias("v"))
            .groupBy("y").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("m")).collect())
    sums = {r.y: np.array([e.v for e in r.m]) for r in rows}
    sums = {c: sums.get(c, np.zeros(width)) for c in (0, 1)}
    n = {c: sums[c][0] for c in (0, 1)}
    if min(n.values()) < 2:
        total = n[0] + n[1]
        return {"constant": float(n[1] / total) if total else 0.5}
    mean = {c: sums[c][1:1 + D] / n[c] for c in (0, 1)}
    cov = {c: sums[c][1 + D:].reshape(D, D) / n[c] - np.outer(mean[c], mean[c]) for c in (0, 1)}
    total = n[0] + n[1]
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / total
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
    model = {"scale": scale}
    for c in (0, 1):
        s = ((1 - alpha) * cov[c] + alpha * pooled) / np.outer(scale, scale)
        s = (1 - gamma) * s + gamma * max(np.trace(s) / D, 1e-6) * np.eye(D)
        chol = np.linalg.cholesky(s)
        model[c] = {"mean": mean[c] / scale, "inv": np.linalg.inv(chol).T,
                    "log": float(np.log(n[c] / total) - np.log(np.diag(chol)).sum())}
    return model


def log_odds(model: dict, x: np.ndarray) -> np.ndarray:
    """Log density of class 1 minus that of class 0, priors included."""
    z = x / model["scale"]
    logs = {c: model[c]["log"] - 0.5 * (((z - model[c]["mean"]) @ model[c]["inv"]) ** 2).sum(1) for c in (0, 1)}
    return logs[1] - logs[0]


def probabilities(model: dict, x: np.ndarray) -> np.ndarray:
    if "constant" in model:
        return np.full(len(x), model["constant"])
    return 1 / (1 + np.exp(-np.clip(log_odds(model, x), -700, 700)))


def score(feats: DataFrame, model: dict) -> DataFrame:
    def run(batches):
        for b in batches:
            p = probabilities(model, matrix_of(b.column(1), D))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p)], ["doc_id", "score"])

    kind = feats.schema["doc_id"].dataType.simpleString()
    return feats.select("doc_id", "x").mapInArrow(run, f"doc_id {kind}, score double")


def training_rows(feats: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics with their label, for labelled rows outside the held-out third."""
    lab = labels.where(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").alias("y"))
    return feats.where(~held_out(F.col("doc_id"))).join(lab, "doc_id").select("x", "y")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    feats = write_out(features(docs), "quality_stats")  # texts are read once
    model = fit(training_rows(feats, labels))
    return score(feats, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that the classifier accepts, all columns kept.

    The text is scored inside the row, so no join on doc_id is needed and
    repeated or null ids stay apart.
    """
    model = fit(training_rows(features(docs), labels))
    fields = docs.schema.names
    at = fields.index("text")

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE_ROWS):  # whole rows go out in small batches
                b = whole.slice(lo, SLICE_ROWS)
                _, stats = column_features(b.column(at))
                yield b.filter(pa.array(probabilities(model, transform(stats)) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
