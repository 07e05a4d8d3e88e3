"""Quality rules with risk-controlled cutoffs.

The base rule (too few words, too many repeated windows) always holds. The
method adds one-sided rules on further statistics, whose cutoffs come from
labelled text and carry a guarantee: in every stratum (language), the
share of good documents that the rules reject is at most ``risk``, with
confidence ``1 - delta`` over all strata together.

Copies of a text would tie the two halves and count as evidence many times. So a labelled text counts
once in a stratum (by a digest of the text in lower case with single blanks), and that digest
decides its half. Near copies with other words still count each.

1. Design half of the labelled good texts: for each rung of a ladder from
   lenient to strict, a rule's cutoff is a tail quantile in the stratum, moved
   outward by a slack. One rung fixes the cutoffs of all rules.
2. Holdout half (never used in 1): for every rung, count the good documents
   that any rule rejects. The exact binomial tail ``P(Bin(n, risk) <= k)`` is the
   p-value of "this rung rejects more than ``risk``".
3. Rungs are tested from lenient to strict at level ``delta / strata``
   (Bonferroni over strata, fixed sequence inside one, so the ladder itself
   needs no further correction); the last rung that passes is used. A stratum
   with too few labelled documents certifies none, and gets the base rule only.

Only strata x rungs counts and quantiles reach the driver. Cases: null or
empty text has no words and fails the base rule; a null language is a
stratum of its own; a null doc_id is judged but never calibrates; repeated rows
are judged each; no labels: base rule only; an empty table gives an empty
result. Further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolpick.llm.common import text_of, write_out
from poolpick.llm.features import COUNTS, STATS, column_features

RISK, DELTA = 0.01, 0.05
#: rungs (tail share, slack), lenient to strict: the cutoff is the quantile that leaves the tail share of good
#: documents beyond it, moved outward by slack times its distance from the median
LADDER = ((0, 2.0), (0, 1.0), (0, 0.5), (0, 0.25), (0, 0.1), (0, 0.0), (0.0005, 0.0), (0.001, 0.0))
#: statistic -> side on which a text is bad
RULES = {"symbol_ratio": "high", "symbol_word_ratio": "high", "pipe_ratio": "high", "exclaim_ratio": "high",
         "upper_ratio": "high", "dup_line_ratio": "high", "repeat_word_ratio": "high", "distinct_word_ratio": "low"}
MIN_WORDS, MAX_REPEAT = 20, 30


def _statistics(batches):
    for b in batches:
        counts, stats = column_features(b.column(0))
        rest = [b.column(i) for i in range(1, b.num_columns)]
        yield pa.RecordBatch.from_arrays(
            rest + [pa.array(counts[:, i]) for i in range(len(COUNTS))]
            + [pa.array(np.ascontiguousarray(stats[:, STATS.index(r)])) for r in RULES],
            [f"k{i}" for i in range(len(rest))] + COUNTS + list(RULES))


def statistics(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Base counts and rule statistics of every row, beside its keys (renamed k0, k1, ...)."""
    fields = [f"k{i} {docs.schema[k].dataType.simpleString()}" for i, k in enumerate(keys)]
    fields += [f"{c} long" for c in COUNTS] + [f"{r} double" for r in RULES]
    return docs.select("text", *keys).mapInArrow(_statistics, ", ".join(fields))


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), summed in logarithms."""
    if n == 0:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
            for i in range(min(k, n) + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def choose_rung(rejected: list[int], n: int, risk: float, level: float) -> int:
    """Strictest rung that passes, in fixed sequence; -1 if none does."""
    best = -1
    for rung, k in enumerate(rejected):
        if binomial_tail(k, n, risk) > level:
            break
        best = rung
    return best


def _violates(cut):
    """Any rule broken, given an array column of cutoffs in the order of RULES."""
    out = F.lit(False)
    for i, (rule, side) in enumerate(RULES.items()):
        out = out | ((F.col(rule) > cut[i]) if side == "high" else (F.col(rule) < cut[i]))
    return out


def _ladder_map(cuts: dict, rung=None):
    """stratum -> cutoffs as a map expression (one entry per stratum that has labels)."""
    pairs = []
    for s, ladder in cuts.items():
        pairs += [F.lit(s), F.array(*[F.lit(float(x)) for x in ladder[rung if rung is not None else 0]])]
    return F.create_map(*pairs)


def calibrate(good: DataFrame, risk: float = RISK, delta: float = DELTA, ladder=LADDER) -> dict:
    """stratum -> certified cutoffs, from rows (stratum, design, rule statistics) of good documents."""
    shares = sorted({share for share, _ in ladder})
    quantiles = [F.percentile_approx(r, F.array(*[F.lit(float(1 - s if side == "high" else s)) for s in [*shares, 0.5]]), 100_000).alias(r)
                 for r, side in RULES.items()]
    rows = good.where("design").groupBy("stratum").agg(*quantiles).collect()
    cuts = {r.stratum: [[r[rule][shares.index(share)] + slack * (r[rule][shares.index(share)] - r[rule][-1]) for rule in RULES]
                        for share, slack in ladder] for r in rows}
    if not cuts:
        return {}
    held = good.where("NOT design").where(F.col("stratum").isin(list(cuts)))
    marks = [F.sum(_violates(_ladder_map(cuts, j)[F.col("stratum")]).cast("int")).alias(f"r{j}") for j in range(len(ladder))]
    tests = held.groupBy("stratum").agg(F.count("*").alias("n"), *marks).collect()
    out = {}
    for t in tests:
        rung = choose_rung([t[f"r{j}"] for j in range(len(ladder))], t.n, risk, delta / len(cuts))
        if rung >= 0:
            out[t.stratum] = [cuts[t.stratum][rung]]
    return out


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """doc_id, base counts, base_failed, kept for every row of ``docs``."""
    plain = F.lower(F.trim(F.regexp_replace(text_of(docs), r"[\x20\x09-\x0D]+", " ")))
    texts = docs.select("text", "doc_id", "lang", F.md5(plain).alias("digest"))
    stats = write_out(statistics(texts, ["doc_id", "lang", "digest"]), "quality_rules")  # texts are read once
    stats = stats.withColumnsRenamed({"k0": "doc_id", "k1": "lang", "k2": "digest"})
    stratum = F.coalesce(F.concat(F.lit("lang:"), F.col("lang")), F.lit("none"))
    lab = labels.where("quality = 1").select("doc_id")
    # what the base rule rejects is not for the calibrated rules to answer for
    good = (stats.where(~base_failed()).join(lab, "doc_id").groupBy(stratum.alias("stratum"), "digest").agg(F.min_by(F.struct(*RULES), "doc_id").alias("first"))
            .select("stratum", (F.crc32(F.col("digest").cast("binary")) % 2 == 0).alias("design"), "first.*"))
    cuts = calibrate(good, risk, delta)
    verdict = F.coalesce(_violates(_ladder_map(cuts)[stratum]), F.lit(False)) if cuts else F.lit(False)
    return stats.select("doc_id", *COUNTS, base_failed().alias("base_failed"), (~(base_failed() | verdict)).alias("kept"))
