"""Source, sink, report and language queries (SRC-*, SNK-*, AGG-6..14, PRJ-7..9, JOIN-7/10/11, TOP-5, PLT-1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from poolpick import fixtures as fx
from poolpick.fixtures import with_views
from poolpick.functions.scores import argmax, percent
from poolpick.operators import languages as lg
from poolpick.operators import prepare as pr
from poolpick.operators import reports as rp
from poolpick.plans.registry import r6, register
from poolpick.session import materialise, scratch_path
from poolpick.sources import readers as rd
from poolpick.sources import sinks as sk

_RUN_COLS = ["config", "strategy", "iteration", "seed", "language", "split"]


def _pct_sql(v="value"):
    return f"CASE WHEN {v} < 1 THEN {v} * 100 ELSE {v} END"


# ------------------------------------------------------------------ sources
@register("scan_csv_roundtrip", with_views(
    "SELECT row_id, language, config, CAST(length(text) AS BIGINT) AS n_chars FROM docs", "docs"))
def q_scan_csv_roundtrip(spark, sf_dir):
    """SRC-1: write a table as CSV with a header, read it back with an explicit schema."""
    d = fx.docs_df(spark, sf_dir).select("row_id", "language", "config", F.length("text").cast("long").alias("n_chars"))
    path = scratch_path(spark, "csv")
    sk.write_csv(d, path)
    return rd.read_csv(spark, path, "row_id long, language string, config string, n_chars long")


_HS = ("hs", "SELECT row_id, language, config, CASE WHEN rn <= (SELECT ceil(0.2 * count(*)) FROM docs) "
             "THEN 'validation' ELSE 'train' END AS split FROM (SELECT *, row_number() OVER (ORDER BY "
             "md5(concat_ws(':', '42', CAST(row_id AS VARCHAR))), row_id) AS rn FROM docs)")


@register("scan_split", with_views("SELECT row_id, language, split FROM hs WHERE split = 'train'", "docs",
                                   extra=[_HS]))
def q_scan_split(spark, sf_dir):
    """SRC-2: a split-partitioned dataset read back one split at a time (partition pruning)."""
    s = pr.hash_split(fx.docs_df(spark, sf_dir).select("row_id", "language", "config"), 0.2, seed=fx.SEED)
    path = scratch_path(spark, "splits")
    sk.write_parquet(s, path, ["split"])
    return rd.read_split(spark, path, "train").select("row_id", "language", "split")


@register("scan_languages", with_views(
    "SELECT row_id, language, config FROM docs WHERE language IN ('de', 'fr')", "docs"))
def q_scan_languages(spark, sf_dir):
    """SRC-3: a language-partitioned dataset read for a list of languages."""
    path = scratch_path(spark, "langs")
    sk.write_parquet(fx.docs_df(spark, sf_dir).select("row_id", "language", "config"), path, ["language"])
    return rd.read_languages(spark, path, ["de", "fr"]).select("row_id", "language", "config")


_RUNS_SQL = with_views(
    "SELECT config, strategy, iteration, seed, language, split, value FROM runs", "runs")


@register("collect_run_metrics", _RUNS_SQL)
def q_collect_run_metrics(spark, sf_dir):
    """SRC-4: one metrics JSON object per run folder, scanned back into long rows."""
    runs = fx.runs_df(spark, sf_dir)
    obj = F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("_", "language", "split"), "value"))))
    per_run = runs.groupBy("config", "seed", "strategy", "iteration").agg(obj.alias("value"))
    root = scratch_path(spark, "runs")
    per_run.write.mode("overwrite").partitionBy("config", "seed", "strategy", "iteration").text(root)
    pat = r"config=([^/]+)/seed=([^/]+)/strategy=([^/]+)/iteration=(\d+)/"
    long = rp.read_run_tree(spark, root, pat, {"config": 1, "seed": 2, "strategy": 3, "iteration": 4})
    return long.select("config", "strategy", F.col("iteration").cast("int").alias("iteration"), "seed", "language",
                       "split", "value")


@register("latest_round", with_views(
    "SELECT epoch, step AS latest_step, epoch_us(mtime) AS latest_mtime FROM (SELECT *, row_number() OVER "
    "(PARTITION BY epoch ORDER BY mtime DESC, step DESC) AS rn FROM steps) WHERE rn = 1", "steps"))
def q_latest_round(spark, sf_dir):
    """SRC-10: per group, the entry with the latest modification time."""
    s = rp.latest_by(fx.steps_df(spark, sf_dir), ["epoch"], "step", "mtime")
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', latest_mtime)")
    return s.select("epoch", "latest_step", micros.alias("latest_mtime"))


@register("parse_result_lines", with_views(
    "SELECT config, seed, iteration, strategy, CAST(row_number() OVER (PARTITION BY config, seed, strategy, "
    "iteration ORDER BY language) - 1 AS INTEGER) AS pos, value FROM runs "
    "WHERE split = 'test'", "runs"))
def q_parse_result_lines(spark, sf_dir):
    """SRC-8: result CSV lines written per run folder, read back positionally, all rounds."""
    lines = rp.result_lines(fx.runs_df(spark, sf_dir))
    root = scratch_path(spark, "lines")
    lines.write.mode("overwrite").partitionBy("config", "seed").text(root)
    p = rp.parse_result_lines(rd.read_lines(spark, root))
    return p.select("config", "seed", "iteration", "strategy", "pos", "value")


@register("map_language_code", with_views(
    "SELECT row_id, language, CASE language " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in sorted(lg.CODE_MAP.items()))
    + " END AS code FROM vec", "vec"))
def q_map_language_code(spark, sf_dir):
    """SRC-7 / JOIN-11: code lookup from a literal map; missing codes are NULL."""
    v = fx.vec_df(spark, sf_dir)
    return v.select("row_id", "language", lg.map_code(F.col("language")).alias("code"))


# ------------------------------------------------------------------ sinks
def _dataset_of(config):
    return F.when(config.isin("AUTOMOBILE", "BUILDING"), F.lit("PAN-X")).otherwise(F.lit("xnli"))


@register("run_path_keys", with_views(
    "SELECT DISTINCT config, seed, strategy, iteration, concat_ws('/', 'xlm-roberta-large', "
    "CASE WHEN config IN ('AUTOMOBILE', 'BUILDING') THEN 'PAN-X' ELSE 'xnli' END, config, '2000', "
    "'2e-05_10_seed_' || seed, CASE WHEN contains(strategy, 'uncertainty') AND config IN ('AUTOMOBILE', 'BUILDING') "
    "THEN strategy || '_margin_min' ELSE strategy END, 'iter_' || CAST(iteration AS VARCHAR)) AS path FROM runs",
    "runs"))
def q_run_path_keys(spark, sf_dir):
    """SNK-3: output folder of every run; token tasks suffix uncertainty folders with the margin."""
    r = fx.runs_df(spark, sf_dir).select("config", "seed", "strategy", "iteration").distinct()
    ds = _dataset_of(F.col("config"))
    task = F.when(ds == "PAN-X", F.lit("token")).otherwise(F.lit("sequence"))
    path = rp.run_path(F.lit("xlm-roberta-large"), ds, F.col("config"), F.lit(2000), F.lit("2e-05_10"),
                       F.col("seed"), F.col("strategy"), F.col("iteration"), task, F.lit("min"))
    return r.withColumn("path", path)


_METRICS = [f"l{i}_{s}" for i in range(3) for s in ("test", "val")]


@register("wide_metrics", with_views(
    "SELECT config, strategy, iteration, seed, " + ", ".join(
        f"max(CASE WHEN language || '_' || split = '{m}' THEN value END) AS {m}" for m in _METRICS)
    + " FROM runs GROUP BY ALL", "runs"))
def q_wide_metrics(spark, sf_dir):
    """SNK-4: per-run metric dict, written as one JSON object (and one-row CSV) per run and read back."""
    w, names = rp.wide_metrics(fx.runs_df(spark, sf_dir))
    paths = sk.write_metrics(w, scratch_path(spark, "metrics"), rp.RUN_KEYS)
    w = sk.read_metrics_json(spark, paths["json"], w.schema)
    return w.select(*rp.RUN_KEYS, *[F.col(f"`{n}`").alias(n) for n in names])


@register("write_predictions", with_views(
    "SELECT v.language, count(*) AS n, count(DISTINCT CAST(list_position(s.z, list_max(s.z)) - 1 AS VARCHAR)) "
    "AS n_labels FROM seqlog s JOIN vec v USING (row_id) GROUP BY v.language", "seqlog", "vec"))
def q_write_predictions(spark, sf_dir):
    """SNK-5: predictions written one per line, a folder per language, read back and counted."""
    s = fx.vec_logits_df(spark, sf_dir)
    path = scratch_path(spark, "predictions")
    sk.write_predictions(s.select("language", argmax(F.col("z")).alias("prediction")), path)
    back = spark.read.text(path)
    return back.groupBy("language").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_labels"))


# ------------------------------------------------------------------ projections
@register("percent_normalise", with_views(
    f"SELECT config, strategy, iteration, seed, language, split, {_pct_sql()} AS value_pct FROM runs",
    "runs"))
def q_percent_normalise(spark, sf_dir):
    r = fx.runs_df(spark, sf_dir)
    return r.select(*_RUN_COLS, percent(F.col("value")).alias("value_pct"))


@register("metric_columns", with_views(
    "SELECT config, strategy, iteration, seed, language || '_test' AS \"column\", value "
    "FROM runs WHERE split = 'test'", "runs"))
def q_metric_columns(spark, sf_dir):
    """PRJ-9: test columns chosen by name from the wide per-run table."""
    w, _ = rp.wide_metrics(fx.runs_df(spark, sf_dir))
    m = rp.metric_columns(w, rp.RUN_KEYS, "test").where(F.col("value").isNotNull())
    return m.select(*rp.RUN_KEYS, "column", "value")


_LABEL_SQL = ("CASE " + " ".join(f"WHEN starts_with(strategy, '{p}') THEN '{rp.STRATEGY_LABELS[p]}'"
                                 for p in rp.STRATEGY_ORDER) + " END")


@register("round_series", with_views(
    f"SELECT config, {_LABEL_SQL} AS label, iteration AS round, round(avg(value), 6) AS value FROM runs "
    f"WHERE split = 'test' GROUP BY config, strategy, iteration", "runs"))
def q_round_series(spark, sf_dir):
    """PRJ-7 / PLT-1: line-plot series -- round parsed back from its '<n> (<budget>)' label."""
    r = fx.runs_df(spark, sf_dir).where(F.col("split") == "test")
    m = r.groupBy("config", "strategy", "iteration").agg(F.avg("value").alias("value"))
    m = m.withColumn("iter_label", rp.round_label(F.col("iteration"), 2000))
    return m.select("config", rp.strategy_label(F.col("strategy")).alias("label"),
                    rp.round_from_label(F.col("iter_label")).alias("round"), r6("value").alias("value"))


def _prefix_sql(col, prefixes):
    return "CASE " + " ".join(f"WHEN starts_with({col}, '{p}') THEN '{p}'" for p in prefixes) + " END"


_DELTA_PREFIXES = ["knn", "average", "uncertainty"]
_DELTA_BASES = ["gold", "egal"]
_DELTA_SQL = (
    "dl", f"SELECT s.config, s.seed, s.iteration, s.language, s.strategy, s.prefix, b.base, s.v - b.v AS delta FROM "
          f"(SELECT *, {_prefix_sql('strategy', _DELTA_PREFIXES)} AS prefix, {_pct_sql()} AS v FROM runs "
          f"WHERE split = 'test') s JOIN (SELECT *, {_prefix_sql('strategy', _DELTA_BASES)} AS base, "
          f"{_pct_sql()} AS v FROM runs WHERE split = 'test') b USING (config, seed, iteration, language) "
          f"WHERE s.prefix IS NOT NULL AND b.base IS NOT NULL")


@register("strategy_deltas", with_views(
    "SELECT config, seed, iteration, language, strategy, prefix, base, delta FROM dl", "runs",
    extra=[_DELTA_SQL]))
def q_strategy_deltas(spark, sf_dir):
    d = rp.strategy_deltas(fx.runs_df(spark, sf_dir), _DELTA_PREFIXES, _DELTA_BASES)
    return d.select("config", "seed", "iteration", "language", "strategy", "prefix", "base", "delta")


_LAST = "(config, seed, iteration) IN (SELECT config, seed, max(iteration) FROM runs GROUP BY config, seed)"


@register("delta_averages", with_views(
    "SELECT config, seed, CASE prefix || ':' || base " + " ".join(
        f"WHEN '{p}:{b}' THEN '{n}'" for p, b, n in rp.DELTAS)
    + " END AS delta_name, round(avg(delta), 6) AS average FROM dl WHERE " + _LAST + " GROUP BY ALL", "runs",
    extra=[_DELTA_SQL]))
def q_delta_averages(spark, sf_dir):
    """AGG-6: mean delta of the last round for the six named comparisons."""
    d = rp.delta_averages(materialise(fx.runs_df(spark, sf_dir), "runs"))  # used three times
    return d.select("config", "seed", "delta_name", r6("average").alias("average"))


@register("seed_avg_variance", with_views(
    f"SELECT config, strategy, round(avg(m), 6) AS average, round(avg(m), 1) AS average_1dp, "
    f"round(var_pop(m), 6) AS variance, count(*) AS n_seeds FROM (SELECT config, strategy, seed, "
    f"avg({_pct_sql()}) AS m FROM runs WHERE split = 'test' AND {_LAST} GROUP BY ALL) GROUP BY config, strategy",
    "runs"))
def q_seed_avg_variance(spark, sf_dir):
    """AGG-7: across seeds, mean (also shown to one decimal) and population variance."""
    a = rp.seed_avg_variance(fx.runs_df(spark, sf_dir))
    line = F.format_string("%s: Average = %.1f, Variance = %s", "strategy", "average", F.col("variance").cast("string"))
    sk.write_report(a.select("config", line.alias("line")), scratch_path(spark, "last_iter_avg"), sep="\t",
                    header=False)  # SNK-6: one small text report (strategies x configs rows)
    return a.select("config", "strategy", r6("average").alias("average"), F.round("average", 1).alias("average_1dp"),
                    r6("variance").alias("variance"), "n_seeds")


@register("config_average_deltas", with_views(
    "SELECT config, prefix, base, iteration, round(avg(delta), 6) AS avg_delta, count(DISTINCT language) AS n_lang "
    "FROM dl GROUP BY config, prefix, base, iteration HAVING count(DISTINCT language) > 1", "runs",
    extra=[_DELTA_SQL]))
def q_config_average_deltas(spark, sf_dir):
    d = rp.config_average_deltas(rp.strategy_deltas(fx.runs_df(spark, sf_dir), _DELTA_PREFIXES, _DELTA_BASES))
    return d.select("config", "prefix", "base", "iteration", r6("avg_delta").alias("avg_delta"), "n_lang")


_PIVOT = ["gold_ur", "egalitarian", "knn_uncertainty_k_1", "average_dist", "uncertainty"]


@register("pivot_strategies", with_views(
    "SELECT config, iteration, " + ", ".join(f"round(avg(CASE WHEN strategy = '{s}' THEN value END), 6) AS {s}"
                                     for s in _PIVOT)
    + " FROM runs WHERE split = 'test' GROUP BY config, iteration", "runs"))
def q_pivot_strategies(spark, sf_dir):
    """AGG-9: rounds as rows, strategies as columns (explicit pivot values)."""
    r = fx.runs_df(spark, sf_dir).where(F.col("split") == "test")
    p = rp.pivot_strategies(r, _PIVOT)
    return p.select("config", "iteration", *[r6(s).alias(s) for s in _PIVOT])


@register("strategy_display_order", with_views(
    "SELECT strategy, CAST(coalesce(CASE " + " ".join(f"WHEN starts_with(strategy, '{p}') THEN {i}"
                                                     for i, p in enumerate(rp.STRATEGY_ORDER))
    + f" END, {len(rp.STRATEGY_ORDER)}) AS INTEGER) AS display_rank, {_LABEL_SQL} AS label "
      "FROM (SELECT DISTINCT strategy FROM runs)", "runs"))
def q_strategy_display_order(spark, sf_dir):
    """TOP-5: fixed display order by strategy prefix (gold first, random last)."""
    s = fx.runs_df(spark, sf_dir).select("strategy").distinct()
    return s.select("strategy", rp.display_rank(F.col("strategy")).cast("int").alias("display_rank"),
                    rp.strategy_label(F.col("strategy")).alias("label"))


@register("eval_table", with_views(
    "SELECT language, split, iteration, round(avg(value), 6) AS value FROM runs WHERE split = 'test' OR "
    "(language IN (SELECT DISTINCT language FROM runs ORDER BY language LIMIT 2) AND iteration IN "
    "((SELECT min(iteration) FROM runs), (SELECT max(iteration) FROM runs))) GROUP BY language, split, iteration",
    "runs"))
def q_eval_table(spark, sf_dir):
    """AGG-13: validation rows only for the first languages (2 here) and the first/last round."""
    t = rp.eval_table(fx.runs_df(spark, sf_dir), n_val_languages=2)
    return t.select("language", "split", "iteration", r6("value").alias("value"))


@register("running_mean_loss", with_views(
    "SELECT epoch, step, CAST(sum(c) OVER w AS DOUBLE) / CAST(count(*) OVER w AS DOUBLE) / 100.0 AS running_mean "
    "FROM (SELECT *, CAST(round(loss * 100) AS BIGINT) AS c FROM steps) "
    "WINDOW w AS (PARTITION BY epoch ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "steps"))
def q_running_mean_loss(spark, sf_dir):
    """AGG-14: running mean of the loss within each epoch, skew-safe (range partitions + offsets).

    The loss has two decimals, so sums run on exact integer hundredths."""
    s = fx.steps_df(spark, sf_dir).select("epoch", "step", F.round(F.col("loss") * 100).cast("long").alias("c"))
    r = rp.running_sum(s, "epoch", "step", "c")
    mean = F.col("running_sum").cast("double") / F.col("running_count").cast("double") / 100.0
    return r.select("epoch", "step", mean.alias("running_mean"))


# ------------------------------------------------------------------ languages
@register("lang_pairs", with_views(
    "SELECT a.language AS src, b.language AS tgt FROM (SELECT DISTINCT language FROM vec WHERE language IN ("
    + ", ".join(f"'{k}'" for k in sorted(lg.CODE_MAP)) + ")) a, (SELECT DISTINCT language FROM vec WHERE language IN ("
    + ", ".join(f"'{k}'" for k in sorted(lg.CODE_MAP)) + ")) b WHERE a.language <> b.language", "vec"))
def q_lang_pairs(spark, sf_dir):
    """JOIN-7 + FLT-5: ordered language pairs, both sides with a known code."""
    return lg.lang_pairs(fx.vec_df(spark, sf_dir))


_CENT = [("cent", "SELECT language, i - 1 AS dim, avg(emb[i]) AS value FROM vec, range(1, 65) t(i) "
                  "WHERE language IN (" + ", ".join(f"'{k}'" for k in sorted(lg.CODE_MAP)) + ") GROUP BY language, i"),
         ("cd", "SELECT a.language AS src, b.language AS tgt, sqrt(sum((a.value - b.value) ** 2)) AS l2, "
                "1 - sum(a.value * b.value) / (sqrt(sum(a.value * a.value)) * sqrt(sum(b.value * b.value))) AS cosine "
                "FROM cent a JOIN cent b ON a.dim = b.dim AND a.language <> b.language GROUP BY a.language, b.language"),
         ("dist", "SELECT src, tgt, 'l2' AS metric, l2 AS value FROM cd UNION ALL "
                  "SELECT src, tgt, 'cosine', cosine FROM cd")]


def _centroid_distance(spark, sf_dir):
    v = lg.known_languages(fx.vec_df(spark, sf_dir))
    return lg.centroid_distances(lg.centroids(v))


@register("lang_centroid_distance", with_views(
    "SELECT src, tgt, metric, round(value, 6) AS value FROM dist", "vec", extra=_CENT))
def q_lang_centroid_distance(spark, sf_dir):
    """AGG-12: pairwise L2 / cosine distance of per-language centroids (languages with a code)."""
    d = _centroid_distance(spark, sf_dir)
    return d.select("src", "tgt", "metric", r6("value").alias("value"))


@register("min_lang_distance", with_views(
    "SELECT src AS language, max(CASE WHEN metric = 'cosine' THEN tgt END) AS cosine_language, "
    "round(max(CASE WHEN metric = 'cosine' THEN value END), 6) AS cosine_value, "
    "max(CASE WHEN metric = 'l2' THEN tgt END) AS l2_language, "
    "round(max(CASE WHEN metric = 'l2' THEN value END), 6) AS l2_value FROM ("
    "SELECT *, row_number() OVER (PARTITION BY src, metric ORDER BY value, tgt) AS rn FROM dist "
    "WHERE value > 0.05 AND value < 2 AND tgt <> 'en') WHERE rn = 1 GROUP BY src", "vec", extra=_CENT))
def q_min_lang_distance(spark, sf_dir):
    """SRC-5 + AGG-11: the distance list written as headerless TSV, read back, nearest language per metric."""
    path = scratch_path(spark, "l2v")
    sk.write_csv(_centroid_distance(spark, sf_dir), path, header=False, sep="\t")
    dist = rd.read_tsv(spark, path, "src string, tgt string, metric string, value double")
    m = lg.min_distance(dist, metrics=["cosine", "l2"])
    return m.select("language", "cosine_language", r6("cosine_value").alias("cosine_value"),
                    "l2_language", r6("l2_value").alias("l2_value"))
