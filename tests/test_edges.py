"""Hand-made edge frames for scores, reports, metrics and preparation."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from poolpick.functions.stats import two_sided_p
from poolpick.operators import metrics as me
from poolpick.operators import prepare as pr
from poolpick.operators import qa
from poolpick.operators import reports as rp
from poolpick.operators import uncertainty as unc
from tests.conftest import SF_SMALL


def _tok(spark, rows):
    return spark.createDataFrame(rows, "row_id long, pos int, z array<double>, lab int")


def test_all_masked_row(spark):
    t = _tok(spark, [(1, 0, [1.0, 2.0], -100), (1, 1, [0.5, 0.1], -100)])
    got = {m: unc.token_uncertainty(t, m).first()["uncertainty"] for m in unc.TOKEN_METHODS}
    assert math.isinf(got["min"]) and got["min"] > 0
    assert got["mean"] is None and got["mnlp"] is None
    assert got["max"] == 0.0


def test_zero_margins_are_skipped_by_min(spark):
    t = _tok(spark, [(1, 0, [1.0, 1.0], 0), (1, 1, [3.0, 1.0], 1), (2, 0, [2.0, 2.0], 0)])
    got = {r.row_id: r.uncertainty for r in unc.token_uncertainty(t, "min").collect()}
    assert got[1] == pytest.approx(2.0)
    assert math.isinf(got[2])


def test_percent_rule_is_per_value(spark):
    df = spark.createDataFrame([(0.5,), (1.0,), (87.0,)], "value double")
    from poolpick.functions.scores import percent

    assert [r[0] for r in df.select(percent(F.col("value"))).collect()] == [50.0, 1.0, 87.0]


def test_ragged_lines_and_integer_round_match(spark):
    lines = spark.createDataFrame([("iter_1,gold,0.5,0.6,0.7",), ("iter_10,gold,0.1",), ("iter_1,knn,0.2",),
                                   ("iteration,strategy,a_test",)], "value string")
    p = rp.parse_result_lines(lines, rounds=[1]).collect()
    assert sorted((r.strategy, r.pos, r.value) for r in p) == [("gold", 0, 0.5), ("gold", 1, 0.6), ("gold", 2, 0.7),
                                                               ("knn", 0, 0.2)]


def test_feature_without_example_is_an_error(spark):
    raw = spark.createDataFrame([(1, "en")], "row_id long, language string")
    feats = spark.createDataFrame([(10, 1), (11, 2)], "feature_id long, example_id long")
    with pytest.raises(ValueError):
        qa.feature_to_example(raw, feats)


def test_qa_scores_empty_answers(spark):
    df = spark.createDataFrame([(1, "", [""]), (2, "", ["x"]), (3, "The cat.", ["a cat", "dog"])],
                               "qid long, pred string, golds array<string>")
    got = {r.qid: (r.exact_match, r.f1) for r in me.qa_scores(df, "pred", "golds", "qid").collect()}
    assert got[1] == (1.0, 1.0)
    assert got[2] == (0.0, 0.0)
    assert got[3] == (1.0, 1.0)  # articles and punctuation are dropped


def test_spans_from_bio_tags(spark):
    tags = ["B-PER", "I-PER", "O", "I-LOC", "I-LOC", "B-PER", "B-PER", "I-LOC"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(tags)], "row_id long, pos int, tag string")
    spans = sorted((r.start, r.end, r.type) for r in me.token_spans(df, "tag").collect())
    assert spans == [(0, 1, "PER"), (3, 4, "LOC"), (5, 5, "PER"), (6, 6, "PER"), (7, 7, "LOC")]


def test_bleu_identical_text_is_100(spark):
    df = spark.createDataFrame([(1, "a b c d e", "a b c d e"), (2, "x y z w", "x y z w")],
                               "row_id long, h string, r string")
    b = me.corpus_bleu(df, "h", "r").first()
    assert b.bleu == pytest.approx(100.0)
    assert b.bp == 1.0


def test_t_distribution_p_value():
    assert two_sided_p(2.228, 10) == pytest.approx(0.05, abs=5e-4)
    assert two_sided_p(0.0, 5) == pytest.approx(1.0)


def test_hash_cut_refines_to_the_exact_set(spark):
    df = spark.range(0, 3000).withColumnRenamed("id", "row_id")
    key = F.md5(F.concat_ws(":", F.lit("7"), F.col("row_id").cast("string")))
    pred, bucket, need = pr.hash_cut(df, 1234, key, digits=1, exact_rows=5)
    k = df.withColumn("_h", key)
    inside = k.where(pred)
    if bucket is not None:
        inside = inside.unionByName(k.where(F.substring("_h", 1, len(bucket)) == bucket).orderBy("_h").limit(need))
    got = sorted(r.row_id for r in inside.collect())
    want = sorted(sorted(range(3000), key=lambda i: hashlib.md5(f"7:{i}".encode()).hexdigest())[:1234])
    assert got == want


def test_hash_split_fraction(spark):
    d = spark.range(0, 101).withColumnRenamed("id", "row_id")
    s = pr.hash_split(d, 0.2, seed=42)
    assert s.where(F.col("split") == "validation").count() == 21
    assert s.count() == 101


def test_running_sum_across_partitions_matches_pandas(spark):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").select("event_type", "event_id", "value")
    got = rp.running_sum(ev, "event_type", "event_id", "value", partitions=7).toPandas()
    pdf = ev.toPandas().sort_values(["event_type", "event_id"])
    pdf["want"] = pdf.groupby("event_type")["value"].cumsum()
    m = pdf.merge(got, on=["event_type", "event_id"])
    assert len(m) == len(pdf)
    assert (m["want"] - m["running_sum"]).abs().max() < 1e-6


def test_dedupe_keeps_first_of_each_text(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, "b"), (5, "c")], "row_id long, text string")
    assert sorted(r.row_id for r in pr.dedupe(df, "text").collect()) == [1, 2, 5]


def test_dedupe_on_array_keys(spark):
    df = spark.createDataFrame([(3, ["a", "b"]), (1, ["a", "b"]), (2, ["b"])], "row_id long, tokens array<string>")
    assert sorted(r.row_id for r in pr.dedupe(df, "tokens").collect()) == [1, 2]


def test_validation_fallback_overlaps_train(spark):
    df = spark.createDataFrame([(i, "de" if i < 5 else "en", "train" if i != 7 else "validation") for i in range(10)],
                               "row_id long, language string, split string")
    out = pr.validation_fallback(df, 2)
    v = sorted(r.row_id for r in out.where("split = 'validation'").collect())
    assert v == [0, 1, 7]
    assert out.count() == 12


def test_masked_mean_pools_and_all_masked_gives_zeros(spark):
    from poolpick.operators import embeddings as emb

    s = spark.createDataFrame([(1, 0, [1.0, 2.0], 1), (1, 1, [3.0, 6.0], 1), (1, 2, [9.0, 9.0], 0),
                               (2, 0, [5.0, 5.0], 0)], "row_id long, pos int, h array<double>, attn int")
    got = {r.row_id: r.embedding for r in emb.masked_mean(s, F.col("attn")).collect()}
    assert got[1] == [2.0, 4.0]
    assert got[2] == [0.0, 0.0]


def test_running_sum_with_further_columns_and_null_keys(spark):
    n = 400_000
    df = spark.range(n, numPartitions=6).select(
        F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 3).alias("k"), F.col("id").alias("o"),
        (F.col("id") % 11).cast("double").alias("v"), F.concat(F.lit("x"), F.col("id")).alias("more"))
    reuse = spark.conf.get("spark.sql.exchange.reuse", "true")
    try:
        for setting in ("true", "false"):
            spark.conf.set("spark.sql.exchange.reuse", setting)
            got = rp.running_sum(df, "k", "o", "v", partitions=7).toPandas().sort_values("o")
            assert len(got) == n
            want = got.fillna({"k": -1}).groupby("k")["v"].cumsum()
            assert (got.running_sum == want).all()
    finally:
        spark.conf.set("spark.sql.exchange.reuse", reuse)


def test_dedupe_keeps_one_null_of_any_type(spark):
    lists = spark.createDataFrame([(1, None), (2, None), (3, ["x"]), (4, ["x"]), (5, [])], "row_id long, tokens array<string>")
    assert sorted(r.row_id for r in pr.dedupe(lists, "tokens").collect()) == [1, 3, 5]
    text = spark.createDataFrame([(1, None), (2, None), (3, "x")], "row_id long, t string")
    assert sorted(r.row_id for r in pr.dedupe(text, "t").collect()) == [1, 3]


def test_log_softmax_is_linear_in_the_classes(spark):
    import time

    from poolpick.functions.scores import log_softmax

    def seconds(classes):
        df = spark.range(8, numPartitions=1).select(F.transform(F.sequence(F.lit(1), F.lit(classes)), lambda x: (x * (F.col("id") + 1) % 97).cast("double")).alias("z"))
        t = time.time()
        df.select(F.array_max(log_softmax(F.col("z"))).alias("m")).collect()
        return time.time() - t

    seconds(100)
    assert seconds(20_000) < 10  # cubic time would take days, quadratic time minutes


def test_result_lines_of_any_length(spark):
    df = spark.createDataFrame([("iter_1,knn,0.5,0.25",), ("iter_10,knn",), ("other",)], "value string")
    got = rp.parse_result_lines(df).orderBy("pos").collect()
    assert [(r.iteration, r.pos, r.value) for r in got] == [(1, 0, 0.5), (1, 1, 0.25)]
    assert rp.parse_result_lines(df, [1]).count() == 2 and rp.parse_result_lines(df, [10]).count() == 0
