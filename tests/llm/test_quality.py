"""Quality classifier and calibrated rules: held-out accuracy, brute-force restatements, edge tables."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from poolpick.llm import quality_classifier as Q
from poolpick.llm import quality_rules as R
from poolpick.llm import features as X
from poolpick.llm.features import STATS
from .conftest import DOCS, LABELS, words

SF = "/root/testdata/sf0.01"


def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_held_out_accuracy_and_columns(spark):
    docs, labels = tables(spark)
    got = Q.classify(docs, labels).toPandas()
    assert list(got.columns) == ["doc_id", "held_out", "score", "predicted"] and len(got) == docs.count()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    assert ((got.score >= 0.5) == (got.predicted == 1)).all() and got.score.between(0, 1).all()
    m = got.merge(labels.toPandas(), on="doc_id")
    m = m[m.held_out]
    assert (m.predicted == m.quality).mean() > 0.95


def test_scores_match_a_plain_restatement(spark):
    docs, labels = tables(spark)
    feats = Q.features(docs).toPandas().set_index("doc_id")
    lab = labels.toPandas().set_index("doc_id").quality
    ids = [i for i in lab.index if zlib.crc32(str(i).encode()) % 3 != 1]
    x, y = np.stack(feats.x[ids]), lab[ids].to_numpy()
    cov = {c: np.cov(x[y == c].T, bias=True) for c in (0, 1)}
    n = {c: (y == c).sum() for c in (0, 1)}
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / len(y)
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
    z = np.stack(feats.x) / scale
    logs = {}
    for c in (0, 1):
        s = ((1 - Q.ALPHA) * cov[c] + Q.ALPHA * pooled) / np.outer(scale, scale)
        s = (1 - Q.GAMMA) * s + Q.GAMMA * np.trace(s) / Q.D * np.eye(Q.D)
        d = z - x[y == c].mean(0) / scale
        logs[c] = math.log(n[c] / len(y)) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d)
    want = dict(zip(feats.index, 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -700, 700)))))
    got = Q.classify(docs, labels).toPandas().set_index("doc_id").score
    assert max(abs(got[i] - want[i]) for i in want) < 1e-6


def test_score_uses_the_text_alone(spark):
    docs, labels = tables(spark)
    other = docs.selectExpr("doc_id", "text", "'xx' as lang", "cast(null as string) as source", "n_chars")
    a, b = (dict(map(tuple, Q.classify(d, labels).select("doc_id", "score").collect())) for d in (docs, other))
    assert max(abs(a[i] - b[i]) for i in a) < 1e-9


def test_classifier_edges(spark, edge_docs, no_docs, no_labels):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(7)] + [(None, 1, 0), (3, None, 0)], LABELS)
    for lab in (labels, no_labels):
        assert Q.classify(edge_docs, lab).count() == edge_docs.count()
        kept = Q.keep_good(edge_docs, lab)
        assert kept.columns == edge_docs.columns
    assert Q.keep_good(edge_docs, no_labels).count() == edge_docs.count()  # no labels: nothing is known to be bad
    assert Q.classify(no_docs, no_labels).count() == 0 and Q.keep_good(no_docs, labels).count() == 0


def test_binomial_tail_and_ladder():
    def plain(k, n, p):
        return sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1))
    for k, n, p in ((0, 10, 0.1), (3, 50, 0.05), (20, 400, 0.01), (5, 5, 0.3)):
        assert abs(R.binomial_tail(k, n, p) - plain(k, n, p)) < 1e-9
    assert R.choose_rung([0, 0, 1, 30, 0], 1000, 0.01, 0.0125) == 2  # stops at the first failure
    assert R.choose_rung([0], 100, 0.01, 0.0125) == -1  # too few documents to certify anything
    assert R.binomial_tail(0, 0, 0.1) == 1.0


@pytest.fixture(scope="module")
def ruled(spark):
    rng = random.Random(2)
    good = [(i, "\n".join(words(rng, 12) + "." for _ in range(6)), "en" if i % 4 else "de", "a", 0) for i in range(3000)]
    bad = [(10_000 + i, "\n".join(" ".join(f"{w}%%%" for w in words(rng, 12).split()) for _ in range(6)), "en", "a", 0) for i in range(60)]
    alone = [(20_000, bad[0][1], "xx", "a", 0), (20_001, "few words", "en", "a", 0), (20_002, ("same eight words over and over and over " * 9), "en", "a", 0)]
    docs = spark.createDataFrame(good + bad + alone, DOCS)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(3000)] + [(10_000 + i, 0, 0) for i in range(60)], LABELS)
    return {r.doc_id: r for r in R.judge(docs, labels).collect()}


def test_rules_reject_bad_and_keep_the_promise(ruled):
    assert not any(ruled[10_000 + i].kept for i in range(60))
    for lang in (0, 1):
        good = [ruled[i].kept for i in range(3000) if (i % 4 > 0) == bool(lang)]
        assert sum(not k for k in good) <= R.RISK * len(good)
    assert ruled[20_000].kept  # no label in its stratum: base rule only
    assert ruled[20_001].base_failed and not ruled[20_001].kept and ruled[20_002].base_failed


def test_rules_edges(spark, edge_docs, no_docs, no_labels):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(7)] + [(None, 1, 0)], LABELS)
    for lab in (labels, no_labels):
        got = R.judge(edge_docs, lab).collect()
        assert len(got) == edge_docs.count() and all(r.kept != r.base_failed for r in got)
    assert R.judge(no_docs, no_labels).count() == 0
    assert len(STATS) == Q.D


def plain_cutoffs(rows, good, level):
    """Cutoffs and verdicts in plain Python: halves by the digest of a text, each text once, quantiles by rank, exact tails."""
    counts, stats = X.column_features(pa.array([t for _, t, _ in rows], pa.string()))
    value = {i: [stats[j][STATS.index(r)] for r in R.RULES] for j, (i, _, _) in enumerate(rows)}
    failed = {i: counts[j][0] < R.MIN_WORDS or 100 * counts[j][4] > R.MAX_REPEAT * counts[j][0] for j, (i, _, _) in enumerate(rows)}
    texts = {}
    for i, t, lang in sorted(rows):
        if i in good and not failed[i]:
            texts.setdefault((lang, hashlib.md5(re.sub(r"[\x20\x09-\x0D]+", " ", t).strip(" ").lower().encode()).hexdigest()), i)
    halves = {}
    for (lang, digest), i in texts.items():
        halves.setdefault(lang, ([], []))[zlib.crc32(digest.encode()) % 2].append(value[i])
    beyond = lambda v, cut: any(x > c if side == "high" else x < c for x, c, side in zip(v, cut, R.RULES.values()))
    cuts = {}
    for lang, (design, held) in halves.items():
        at = lambda j, p: sorted(v[j] for v in design)[max(math.ceil(p * len(design)) - 1, 0)]
        ladder = []
        for share, slack in R.LADDER:
            q = [at(j, 1 - share if side == "high" else share) for j, side in enumerate(R.RULES.values())]
            ladder.append([x + slack * (x - at(j, 0.5)) for j, x in enumerate(q)])
        best = None
        for cut in ladder:
            k, n = sum(beyond(v, cut) for v in held), len(held)
            if sum(math.comb(n, i) * R.RISK ** i * (1 - R.RISK) ** (n - i) for i in range(k + 1)) > level / len(halves):
                break
            best = cut
        if best:
            cuts[lang] = best
    return cuts, {i: not failed[i] and not (lang in cuts and beyond(value[i], cuts[lang])) for i, _, lang in rows}


def test_cutoffs_and_verdicts_equal_plain_python(spark):
    rng = random.Random(12)

    def text():
        return "\n".join(words(rng, rng.randrange(8, 14)) + rng.choice([".", "!", " #", "|"]) for _ in range(rng.randrange(3, 9)))

    rows = [(i, text(), "en" if i % 3 else "de") for i in range(2400)]
    rows += [(5000 + i, rows[i % 7][1].upper().lower() + " \n", "en") for i in range(1500)]  # copies of few texts are no evidence
    rows += [(9000 + i, text() + " %%% $$ ## !!" * rng.randrange(9), "en") for i in range(60)]
    good = {i for i, _, _ in rows if i < 9000}
    cuts, kept = plain_cutoffs(rows, good, R.DELTA)
    docs = spark.createDataFrame([(i, t, lang, None, None) for i, t, lang in rows], DOCS).repartition(5)
    got = {r.doc_id: r.kept for r in R.judge(docs, spark.createDataFrame([(i, int(i in good), 0) for i, _, _ in rows], LABELS)).collect()}
    assert "en" in cuts and got == kept and not all(kept.values())


def test_copies_are_no_evidence(spark):
    """Five texts in 800 copies each: too few texts to certify any cutoff."""
    rng = random.Random(13)
    base = [" ".join(words(rng, 40).split()) for _ in range(5)]
    docs = spark.createDataFrame([(i, base[i % 5], "en", None, None) for i in range(4000)] + [(9000, base[0] + "".join(f" %%%{j}" for j in range(30)), "en", None, None)], DOCS)
    got = R.judge(docs, spark.createDataFrame([(i, 1, 0) for i in range(4000)], LABELS)).where("doc_id = 9000").first()
    assert got.kept and not got.base_failed
