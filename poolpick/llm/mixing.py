"""Mixing sources to target weights by balanced (cube-method) sampling.

Targets: sources in code-point order (null last) weigh 5, 2, 1 in turn and
share 150 % of all words; a source's target stops at twice its size, and
the excess is shared again by weight until no target is above.

A source is repeated ``r = target / size`` times on average: every document is
taken ``floor(r)`` times, and once more with inclusion probability
``r - floor(r)``. The extra copies are drawn by the cube method. The flight
phase moves the fractional probabilities of three documents at a time along
the null space of two constraints (words and documents), so both totals
stay exact until one probability reaches 0 or 1. It runs in independent
hash blocks; what is left of a block (two documents, and a reserve of
``RESERVE`` spread over the sizes that it does not touch) flies again, level by
level, until one block per source remains. The landing problem, at most
``RESERVE + 2`` documents, takes the rounding nearest to the words owed. All
coins are hashes of the seed and the documents held, so reruns agree.

No group is larger than a block. Cases: a null text has size 0; a document of
size 0 is moved like any other; rows that repeat are separate units; a null
doc_id is kept; a source without words has target 0 and is taken 0 times; an
empty table gives an empty result. One row per source reaches the driver.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from poolpick.llm.common import WORD, has, text_of, write_out

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
SEED = 20240
BLOCK_ROWS = 20_000  # expected documents of one flight block
RESERVE = 14  # documents of each block kept for the landing
EPS = 1e-9


def word_count(column):
    """Number of maximal runs outside the separators."""
    return F.regexp_count(column, F.lit(WORD)).cast("long")


def water_fill(sizes: dict, total_share: float = SHARE, most: float = MOST, weights=WEIGHTS) -> dict:
    """Targets per source: shares by weight, capped at ``most`` times the size, the excess shared again."""
    names = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    cap = {s: most * sizes[s] for s in names}
    left, open_, out = total_share * sum(sizes.values()), set(names), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in names if s in open_ and unit * weight[s] > cap[s]]
        if not full:
            out |= {s: unit * weight[s] for s in open_}
            break
        for s in full:
            out[s] = cap[s]
            left -= cap[s]
            open_.remove(s)
    return out


def flight(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Fast flight of probabilities ``p`` under the word and document totals.

    Three fractional documents are held; with two balancing equations one
    direction moves them, and a full step settles at least one, whose place
    the next takes. At most two stay fractional.
    """
    p = p.astype(float).tolist()
    s = size.astype(float).tolist()
    held: list[int] = []
    for i in range(len(p)):
        if EPS < p[i] < 1 - EPS:
            held.append(i)
        if len(held) < 3:
            continue
        a, b, c = held
        u = (s[b] - s[c], s[c] - s[a], s[a] - s[b])  # sum u = 0 and sum u * size = 0
        if u == (0, 0, 0):
            u = (1.0, -1.0, 0.0)
        up = min((((1 - p[k]) if x > 0 else p[k]) / abs(x) for k, x in zip(held, u) if x), default=0)
        down = min(((p[k] if x > 0 else (1 - p[k])) / abs(x) for k, x in zip(held, u) if x), default=0)
        # martingale choice: step up with probability down / (up + down), by a coin of the three sizes and places
        coin = _coin(f"{s[a]}:{s[b]}:{s[c]}:{i}:{p[a]:.6f}")
        step = up if coin * (up + down) < down else -down
        for k, x in zip(held, u):
            p[k] = min(1.0, max(0.0, p[k] + step * x))
        held = [k for k in held if EPS < p[k] < 1 - EPS]
    return np.round(np.array(p), 12)


def reserve(size: np.ndarray, k: int = RESERVE) -> np.ndarray:
    """Places of documents kept for the landing (sizes sorted descending).

    Half are spaced evenly over the words, so that large documents can offset each
    other, and half over the documents, for the small change.
    """
    if len(size) <= k:
        return np.arange(len(size))
    share = np.cumsum(size) / max(size.sum(), 1)
    by_words = np.searchsorted(share, (np.arange(k // 2) + 0.5) / (k // 2))
    by_place = np.linspace(0, len(size) - 1, k - k // 2).astype(int)
    return np.unique(np.minimum(np.concatenate([by_words, by_place]), len(size) - 1))


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Best rounding of the few fractional documents: words first, then the document count, then the first found."""
    open_ = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    if not len(open_):
        return np.round(p)
    bits = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
    words = np.abs(bits @ size[open_].astype(float) - p[open_] @ size[open_])
    docs = np.abs(bits.sum(1) - p[open_].sum())
    out = p.copy()
    out[open_] = bits[np.lexsort((docs, np.round(words, 6)))[0]]
    return np.round(out)


def _coin(key: str) -> float:
    return int.from_bytes(hashlib.blake2b(f"{SEED}:{key}".encode(), digest_size=6).digest(), "big") / (1 << 48)


def _fly(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["size", "unit"], ascending=[False, True], kind="stable")  # equal rows are interchangeable
    p, size = pdf["p"].to_numpy(float).copy(), pdf["size"].to_numpy()
    open_ = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    kept = np.zeros(len(p), bool)
    kept[open_[reserve(size[open_])]] = True
    p[~kept] = flight(p[~kept], size[~kept])
    if pdf["last"].iloc[0]:
        p = landing(p, size)
    return pdf.assign(p=p)


def draw(units: DataFrame, rows: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Settles column p (to 0 or 1) of rows (source, unit, size, p) by levels of flight blocks."""
    schema = T.StructType([*units.schema.fields, T.StructField("block", T.LongType()), T.StructField("last", T.BooleanType())])
    settled, level = [], 0
    n_blocks = max(1, math.ceil(rows / block_rows))
    while True:
        block = F.pmod(F.xxhash64(F.lit(f"{SEED}:{level}"), "unit"), F.lit(n_blocks))
        flown = (units.withColumn("block", block).withColumn("last", F.lit(n_blocks == 1))
                 .groupBy("source", "block").applyInPandas(_fly, schema).drop("block", "last"))
        if n_blocks == 1:
            return _union([*settled, flown])
        flown = write_out(flown, f"cube_level{level}")
        fractional = (F.col("p") > EPS) & (F.col("p") < 1 - EPS)
        settled.append(flown.where(~fractional))
        units = flown.where(fractional)
        level += 1
        n_blocks = max(1, math.ceil(n_blocks * (RESERVE + 2) / block_rows))


def _union(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sized(docs: DataFrame) -> DataFrame:
    """source, doc_id, size and a unit key (id and text digest) of every row."""
    return docs.select("source", "doc_id", word_count(text_of(docs)).alias("size"),
                       F.xxhash64("doc_id", "text").alias("unit"))


def mix(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, size, source, source_size, target, taken, unit for every row of ``docs``."""
    spark = docs.sparkSession
    sizes = write_out(sized(docs), "mix_sizes")  # texts are read once
    per = {r.source: (r.s, r.n) for r in sizes.groupBy("source").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()}
    targets = water_fill({s: v[0] for s, v in per.items()})
    rates = [(s, v[0], float(targets[s]), float(targets[s] / v[0]) if v[0] else 0.0) for s, v in per.items()]
    plan = spark.createDataFrame(rates, "src string, source_size long, target double, rate double")
    joined = sizes.join(F.broadcast(plan) if len(rates) <= 100_000 else plan, F.col("source").eqNullSafe(F.col("src")), "left").drop("src")
    units = joined.withColumns({"whole": F.floor(F.col("rate") + EPS), "p": F.greatest(F.lit(0.0), F.col("rate") - F.floor(F.col("rate") + EPS))})
    drawn = draw(units, sum(v[1] for v in per.values()), block_rows)
    return drawn.select("doc_id", "size", "source_size", "target",
                        (F.col("size") * (F.col("whole") + F.round("p"))).cast("long").alias("taken"),
                        (F.col("whole") + F.round("p")).cast("int").alias("copies"), "unit", "source")


def resample(docs: DataFrame) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the mix takes it.

    Equal rows are settled together: their copies are made from one of them.
    """
    cols = docs.columns
    keys = ["__mix_unit", "__mix_id", "__mix_source"]
    plan = write_out(mix(docs).select(F.col("unit").alias(keys[0]), F.col("doc_id").alias(keys[1]), F.col("source").alias(keys[2]), "copies")
                     .groupBy(*keys).agg(F.sum("copies").alias("__mix_n"), F.count("*").alias("__mix_rows")), "mix_plan")
    keyed = docs.withColumn("__mix_key", F.xxhash64("doc_id", "text"))

    def taken(part):
        on = (keyed["__mix_key"] == part[keys[0]]) & keyed["doc_id"].eqNullSafe(part[keys[1]]) & keyed["source"].eqNullSafe(part[keys[2]])
        return keyed.join(part.hint("merge"), on)  # the plan grows with the corpus

    plan = plan.where("__mix_n > 0")
    out = taken(plan.where("__mix_rows = 1"))
    if has(plan.where("__mix_rows > 1")):
        out = out.unionByName(taken(plan.where("__mix_rows > 1")).dropDuplicates(["__mix_key", "doc_id", "source"]))
    return out.withColumn("__mix_copy", F.explode(F.expr("sequence(1, int(__mix_n))"))).select(*cols)
