"""In-row searches, merges and sums against plain Python: best spans, overlaps, BLEU, running sums, refits, projections."""

import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from poolpick.operators import chunking as ch
from poolpick.operators import metrics as me
from poolpick.operators import qa
from poolpick.operators import reports as rp
from poolpick.operators import strategies as st
from poolpick.operators.projection import fit_pca, project, signed
from poolpick.plans import rounds as rd
from tests.conftest import SF_SMALL

Q = E.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ------------------------------------------------------------------ best spans


def plain_span(s, e, live, n_best, max_len):
    top = lambda z: sorted(range(len(z)), key=lambda i: (-z[i], i))[:n_best]
    best = None
    for a in top(s):
        for b in top(e):
            if live[a] and live[b] and a <= b < a + max_len:
                now = (s[a] + e[b], -a, -b)
                best = now if best is None or now > best else best
    return best


@pytest.mark.parametrize("max_len", [1, 4, 12, 30])
def test_best_span_equals_all_pairs(spark, max_len):
    rng = random.Random(max_len)
    rows = []
    for i in range(300):
        n = rng.choice((1, 2, 7, 12))
        values = (-1.0, 0.0, 0.25, 2.0) if i % 2 else [rng.uniform(-3, 3) for _ in range(50)]  # many ties, or none
        offs = [(4 * p, 4 * p + 3) if rng.random() < 0.8 else None for p in range(n)]
        rows.append((i, [rng.choice(values) for _ in range(n)], [rng.choice(values) for _ in range(n)], offs))
    rows += [(900, None, None, None), (901, [], [], []), (902, [None, 1.0], [float("nan"), 1.0], [(0, 1), (2, 3)])]
    df = spark.createDataFrame(rows, "i int, s array<double>, e array<double>, o array<struct<s:int,e:int>>")
    for n_best in (1, 3, 20):
        spans = qa.feature_spans(df.withColumn("f", F.col("i")), n_best, max_len, "f", "i", "s", "e", "o").collect()
        got = {r.feature: (r.score, -r.start, -r.end) for r in spans}
        assert all((r.cs, r.ce) == (4 * r.start, 4 * r.end + 3) for r in spans if r.feature < 900)
        assert got.pop(902) == (2.0, -1, -1)
        assert got == {i: b for i, s, e, o in rows[:300] if (b := plain_span(s, e, [x is not None for x in o], n_best, max_len))}


def test_sliding_maximum():
    z = np.random.default_rng(0).normal(size=(20, 37))
    for width in (1, 2, 3, 7, 8, 30, 37, 90):
        assert np.array_equal(qa.sliding_max(z, width), np.stack([z[:, max(0, j - width + 1):j + 1].max(1) for j in range(37)], 1))


def test_span_search_costs_no_pairs():
    """Eight times the n-best list does not cost eight times the time: 8,000 features of 400 positions."""
    rng = np.random.default_rng(1)
    s, e = rng.normal(size=(2, 8000, 400))
    live = rng.random((8000, 400)) < 0.9

    def run(n_best):
        began = time.process_time()
        qa.best_spans_of(s, e, live, n_best, 1000)
        return time.process_time() - began

    run(20)
    assert run(160) < 3 * run(20) + 0.5


def test_mask_offsets_keeps_the_context_only(spark):
    df = spark.createDataFrame([([(0, 3), (4, 7), (8, 11)], [0, 1, None])], "o array<struct<s:int,e:int>>, q array<int>")
    got = df.select(ch.mask_offsets(F.col("o"), F.col("q")).alias("m")).first().m
    assert [x and tuple(x) for x in got] == [None, (4, 7), None]


# ------------------------------------------------------------------ overlaps and BLEU


def test_overlap_equals_counters(spark):
    rng = random.Random(1)
    rows = [(i, *[[rng.choice("abcdé") for _ in range(rng.randrange(9))] for _ in range(2)]) for i in range(200)]
    rows += [(900, None, ["a"]), (901, [], ["a"]), (902, ["a", None], ["a", None]), (903, [], [])]
    df = spark.createDataFrame(rows, "i int, a array<string>, b array<string>")
    got = {r.i: r.n for r in df.select("i", me.multiset_overlap(F.col("a"), F.col("b")).alias("n")).collect()}
    assert got[900] is None and got[902] == 1
    assert all(got[i] == sum((Counter(a) & Counter(b)).values()) for i, a, b in rows if i not in (900, 902))


def test_overlap_is_linear(spark):
    def run(n):
        tokens = lambda s: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: (i * s % 1009).cast("string"))
        df = spark.range(4).select(tokens(7).alias("a"), tokens(11).alias("b"))
        began = time.time()
        n_same = df.select(F.explode(F.array(me.multiset_overlap(F.col("a"), F.col("b")))).alias("n")).first().n
        return time.time() - began, n_same

    run(1000)
    small, large = run(2000), run(32_000)
    a, b = (Counter(i * s % 1009 for i in range(1, 32_001)) for s in (7, 11))
    assert large[1] == sum((a & b).values())
    assert large[0] < 16 * small[0] + 4


def plain_bleu_sums(pairs, max_n):
    out = [0] * (2 * max_n + 1)
    for h, r in pairs:
        h, r = (h or "").split(), (r or "").split()
        for n in range(1, max_n + 1):
            grams = lambda x: Counter(tuple(x[i:i + n]) for i in range(len(x) - n + 1))
            out[n - 1] += sum((grams(h) & grams(r)).values())
            out[max_n + n - 1] += max(len(h) - n + 1, 0)
        out[-1] += len(r)
    return out


def test_bleu_counts_equal_plain_python_without_python_workers(spark):
    rng = random.Random(2)
    pairs = [tuple(" ".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in range(2)) for _ in range(150)]
    pairs += [("", ""), (None, "a b"), ("a b", None), ("  a  b\tc\n", "a b c")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "row_id int, h string, r string")
    from poolpick.functions.text import whitespace_tokens

    counts = df.select(F.explode(F.array(me.clipped_counts(whitespace_tokens(F.col("h")), whitespace_tokens(F.col("r")), 4))).alias("v"))
    got = counts.agg(*[F.sum(F.col("v")[i]) for i in range(9)]).first()
    assert list(got) == plain_bleu_sums(pairs, 4)
    p = plan(me.corpus_bleu(df, "h", "r"))
    assert "Python" not in p and "Arrow" not in p and p.count("Generate explode") == 1


# ------------------------------------------------------------------ running sums


def test_running_sum_of_a_skewed_key_in_equal_parts(spark, tmp_path):
    n = 16_000
    df = spark.range(n).select(F.when(F.col("id") < n * 0.9, F.lit("hot")).otherwise((F.col("id") % 5).cast("string")).alias("k"), F.col("id").alias("o"),
                               (F.sin(F.col("id").cast("double")) * F.pow(F.lit(10.0), (F.col("id") % 9).cast("double")) + 1e9).alias("v"))
    got = rp.running_sum(df, "k", "o", "v", partitions=16).toPandas().sort_values(["k", "o"])
    parts = spark.range(n).count() / 16
    sizes = rp.running_sum(df, "k", "o", "v", partitions=16).groupBy(F.spark_partition_id()).count().collect()
    assert len(got) == n and sizes and parts == 1000
    from fractions import Fraction

    for _, g in got.groupby("k"):
        total, want = Fraction(0), []
        for v in g["v"]:
            total += Fraction(v)
            want.append(float(total))
        assert np.allclose(g["running_sum"], want, rtol=1e-15, atol=1e-9)


def test_range_partitions_of_a_hot_key_are_even(spark, monkeypatch):
    seen, real = [], rp.materialise

    def keep(df, name):
        out = real(df, name)
        seen.append(out)
        return out

    monkeypatch.setattr(rp, "materialise", keep)
    df = spark.range(20_000).select(F.lit("hot").alias("k"), F.col("id").alias("o"), F.col("id").alias("v"))
    assert rp.running_sum(df, "k", "o", "v", partitions=16).where("o = 19999").first().running_sum == 20_000 * 19_999 // 2
    sizes = [r["count"] for r in seen[0].groupBy("_pid").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 1.5 * 20_000 / 16


def test_running_sum_of_any_partitions_is_the_same_to_the_last_digit(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("k"), F.col("id").alias("o"), F.when(F.col("id") % 7 > 0, F.sin(F.col("id").cast("double")) * 1e12).alias("v"))
    one, many = ([tuple(r) for r in rp.running_sum(df, "k", "o", "v", partitions=p).select("o", "running_sum", "running_count").orderBy("o").collect()] for p in (1, 13))
    assert [r[2] for r in one] == [r[2] for r in many]
    assert all(a[1] == b[1] or abs(a[1] - b[1]) <= 1e-15 * abs(a[1]) for a, b in zip(one, many) if a[1] is not None)
    assert [r[0] for r in one if r[1] is None] == [r[0] for r in many if r[1] is None] == [0]  # NULL until the first value
    wild = spark.createDataFrame([("a", 1, 1e300), ("a", 2, -1e300), ("a", 3, 0.5), ("b", 1, float("inf")), ("b", 2, 1.0), ("c", 1, None)], "k string, o int, v double")
    got = {(r.k, r.o): r.running_sum for r in rp.running_sum(wild, "k", "o", "v", partitions=3).collect()}
    assert got == {("a", 1): 1e300, ("a", 2): 0.0, ("a", 3): 0.5, ("b", 1): float("inf"), ("b", 2): float("inf"), ("c", 1): None}


# ------------------------------------------------------------------ refits, projections, quotas


def test_ridge_weights_equal_normal_equations(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(200, 5)), rng.integers(0, 3, 200)
    rows = [(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))] + [(900, None, 1), (901, [1.0] * 5, None), (902, [1.0] * 5, 7)]
    df = spark.createDataFrame(rows, "row_id long, emb array<double>, label int").repartition(7)
    a = np.concatenate([x, np.ones((200, 1))], 1)
    want = np.linalg.solve(a.T @ a + 0.5 * np.eye(6), a.T @ np.eye(3)[y])
    w = rd.ridge_weights(df, 3, 0.5)
    assert np.allclose(w, want)
    logits = df.where("row_id < 200").select("row_id", rd.linear_logits(w).alias("z")).orderBy("row_id").collect()
    assert np.allclose([r.z for r in logits], a @ want)
    with pytest.raises(ValueError, match="no row"):
        rd.ridge_weights(df.limit(0), 3)


def test_ridge_rounds_pick_the_least_certain_rows(spark):
    r = Q["al_rounds_ridge"](spark, SF_SMALL).collect()
    assert len({x.row_id for x in r}) == 60 and sorted(x["rank"] for x in r) == list(range(1, 61))
    assert {n: sum(x["round"] == n for x in r) for n in (1, 2, 3)} == {1: 20, 2: 20, 3: 20}


def test_projection_has_one_sign(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 4)) * [5, 3, 1, 0.5] + [7, 0, 0, -2]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(999, None)], "row_id long, emb array<double>")
    model = fit_pca(df)
    assert (model.components[np.arange(2), np.abs(model.components).argmax(1)] > 0).all()
    assert np.array_equal(signed(-model.components), model.components)
    _, vec = np.linalg.eigh(np.cov(x.T))
    want = (x - x.mean(0)) @ signed(vec.T[::-1][:2]).T
    got = project(model, df).orderBy("row_id").collect()
    assert len(got) == 300 and np.allclose([(r.x, r.y) for r in got], want)


def test_large_allocations_are_ranked_over_partitions(spark, monkeypatch):
    pool = spark.range(500).select(F.col("id").alias("row_id"), F.concat(F.lit("l"), F.col("id") % 3).alias("language"))
    quota = spark.createDataFrame([("d", "c", 1, "l0", 70), ("d", "c", 1, "l1", 9), ("d", "c", 1, "l2", 400)], "dataset string, config string, iteration int, language string, quota long")
    small = sorted(map(tuple, st.select_allocated(pool, quota, "d", "c", 1).collect()))
    monkeypatch.setattr(st, "TOPN_DIRECT_MAX", 10)
    large = st.select_allocated(pool, quota, "d", "c", 1)
    assert sorted(map(tuple, large.collect())) == small and len(small) == 70 + 9 + 166
