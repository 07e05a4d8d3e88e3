"""Run-metric reporting (SRC-4/8/10, PRJ-7..9, JOIN-10, AGG-6..9/13/14, TOP-5, PLT-1, SNK-3/4).

All reports work on one long table
``(config, strategy, iteration, seed, language, split, value)``; wide CSV
layouts are produced only at the edge, by pivoting with explicit values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, MapType, StringType

from poolpick.functions.scores import percent
from poolpick.session import materialise

RUN_KEYS = ["config", "strategy", "iteration", "seed"]

# Display label of each strategy prefix, and the display order
# (the first matching prefix wins).
STRATEGY_LABELS = {
    "average": "AVG-DIST",
    "egalitarian": "EGAL",
    "gold": "GOLD",
    "knn": "KNN-UNC",
    "random": "RAND",
    "uncertainty": "UNC",
}
STRATEGY_ORDER = ["gold", "knn", "average", "uncertainty", "egalitarian", "random"]

# The six delta comparisons (strategy prefix, baseline prefix, name).
DELTAS = [
    ("knn", "gold", "knn_gold_delta"),
    ("knn", "egal", "knn_egal_delta"),
    ("average", "gold", "avg_dist_gold_delta"),
    ("average", "egal", "avg_dist_egal_delta"),
    ("uncertainty", "gold", "uncertainty_gold_delta"),
    ("uncertainty", "egal", "uncertainty_egal_delta"),
]


def prefix_case(col: Column, mapping: list[tuple[str, object]]) -> Column:
    """CASE over ``startswith`` prefixes, first match wins (no join to a prefix table)."""
    out = None
    for p, v in mapping:
        cond = col.startswith(p)
        out = F.when(cond, F.lit(v)) if out is None else out.when(cond, F.lit(v))
    return out


# ------------------------------------------------------------------ sources
def read_run_tree(spark, root: str, path_pattern: str, groups: dict[str, int]) -> DataFrame:
    """SRC-4: scan every metric JSON object under ``root`` into long rows.

    Keys come from the file path through ``path_pattern`` (``groups`` maps
    a column name to its regex group); each file's object of
    ``"<lang>_<split>": value`` pairs is parsed as a map, so no schema is
    inferred and missing files simply contribute nothing.
    """
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(root) \
        .select("value", F.col("_metadata.file_path").alias("path"),
                F.col("_metadata.file_modification_time").alias("mtime"))
    cols = [F.regexp_extract("path", path_pattern, g).alias(c) for c, g in groups.items()]
    m = F.explode(F.from_json("value", MapType(StringType(), DoubleType())))
    x = raw.select(*cols, "mtime", m.alias("metric", "value"))
    return x.select(*groups.keys(), "mtime",
                    F.regexp_extract("metric", r"^(.*)_(val|test)$", 1).alias("language"),
                    F.regexp_extract("metric", r"^(.*)_(val|test)$", 2).alias("split"), "value") \
        .where(F.col("split") != "")


def result_lines(runs: DataFrame, split: str = "test") -> DataFrame:
    """Format long runs as CSV result lines 'iter_<n>,<strategy>,v1,v2,...' (values in language order)."""
    r = runs.where(F.col("split") == split)
    vals = F.array_sort(F.collect_list(F.struct("language", F.col("value").cast("string").alias("v"))))
    g = r.groupBy("config", "seed", "strategy", "iteration").agg(vals.alias("vals"))
    line = F.concat_ws(",", F.concat(F.lit("iter_"), F.col("iteration").cast("string")), F.col("strategy"),
                       F.array_join(F.transform("vals", lambda s: s["v"]), ","))
    return g.select("config", "seed", line.alias("value"))


def parse_result_lines(lines: DataFrame, rounds: list[int] | None = None, col: str = "value") -> DataFrame:
    """SRC-8: headerless result lines -> (iteration, strategy, pos, value); ragged rows allowed.

    The round is compared as an integer, so round 1 does not match 'iter_10'.
    """
    parts = F.split(F.trim(F.col(col)), ",")
    x = lines.where(F.col(col).startswith("iter_")).withColumn("_p", parts)
    x = x.withColumn("iteration", F.regexp_extract(F.col("_p").getItem(0), r"^iter_(\d+)$", 1).cast("int"))
    if rounds is not None:
        x = x.where(F.col("iteration").isin(rounds))
    keep = [c for c in x.columns if c not in ("_p", col, "iteration")]
    return x.select(*keep, "iteration", F.col("_p").getItem(1).alias("strategy"),
                    F.posexplode(F.slice("_p", F.lit(3), F.greatest(F.size("_p") - 2, F.lit(0)))).alias("pos", "raw")) \
        .select(*keep, "iteration", "strategy", "pos", F.col("raw").cast("double").alias("value"))


def latest_by(df: DataFrame, keys: list[str], item: str, time_col: str) -> DataFrame:
    """SRC-10: per key, the item with the latest time (ties: the larger item)."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(F.col(time_col), F.col(item)),
                                          F.struct(F.col(time_col), F.col(item))).alias("_m")) \
        .select(*keys, F.col(f"_m.{item}").alias(f"latest_{item}"), F.col(f"_m.{time_col}").alias(f"latest_{time_col}"))


# ------------------------------------------------------------------ projections
def round_from_label(label: Column) -> Column:
    """PRJ-7: '5 (10000)' -> 5."""
    return F.split(F.trim(label), " ").getItem(0).cast("int")


def round_label(iteration: Column, per_round: int) -> Column:
    return F.concat(iteration.cast("string"), F.lit(" ("), (iteration * per_round).cast("string"), F.lit(")"))


def strategy_label(strategy: Column) -> Column:
    return prefix_case(strategy, [(p, STRATEGY_LABELS[p]) for p in STRATEGY_ORDER])


def display_rank(strategy: Column) -> Column:
    """TOP-5: position of the first matching prefix in the display order (unknown last)."""
    return F.coalesce(prefix_case(strategy, [(p, i) for i, p in enumerate(STRATEGY_ORDER)]),
                      F.lit(len(STRATEGY_ORDER)))


def wide_metrics(runs: DataFrame, keys: list[str] = RUN_KEYS) -> tuple[DataFrame, list[str]]:
    """SNK-4: one row per run with a '<lang>_<split>' column per metric (explicit pivot values)."""
    metric = F.concat_ws("_", "language", "split")
    names = sorted(r[0] for r in runs.select(metric).distinct().collect())  # bounded: languages x splits
    w = runs.withColumn("metric", metric).groupBy(*keys).pivot("metric", names).agg(F.first("value"))
    return w, names


def metric_columns(wide: DataFrame, keys: list[str], suffix: str = "test") -> DataFrame:
    """PRJ-9: pick the metric columns by name (ending in ``suffix``) and return them long."""
    cols = [c for c in wide.columns if c not in keys and c.endswith(suffix)]
    return wide.unpivot(keys, cols, "column", "value")


# ------------------------------------------------------------------ deltas
def strategy_deltas(runs: DataFrame, prefixes: list[str], bases: list[str], split: str = "test",
                    keys: list[str] = ("config", "seed", "iteration", "language")) -> DataFrame:
    """JOIN-10: per (config, seed, round, language) the strategy value minus each baseline value,
    strategies and baselines chosen by name prefix; percent-normalised first."""
    keys = list(keys)
    r = runs.where(F.col("split") == split).withColumn("value", percent(F.col("value")))
    s = r.withColumn("prefix", prefix_case(F.col("strategy"), [(p, p) for p in prefixes])) \
        .where(F.col("prefix").isNotNull())
    b = r.withColumn("base", prefix_case(F.col("strategy"), [(p, p) for p in bases])).where(F.col("base").isNotNull()) \
        .select(*keys, "base", F.col("value").alias("base_value"))
    j = s.join(b, keys)
    return j.select(*keys, "strategy", "prefix", "base", (F.col("value") - F.col("base_value")).alias("delta"))


def delta_averages(runs: DataFrame, split: str = "test") -> DataFrame:
    """AGG-6: mean of the per-language deltas of the last round, six named comparisons, per (config, seed)."""
    last = runs.groupBy("config", "seed").agg(F.max("iteration").alias("iteration"))
    r = runs.join(last, ["config", "seed", "iteration"], "left_semi")
    d = strategy_deltas(r, sorted({p for p, _, _ in DELTAS}), sorted({b for _, b, _ in DELTAS}), split)
    name = prefix_case(F.concat_ws(":", "prefix", "base"), [(f"{p}:{b}", n) for p, b, n in DELTAS])
    return d.withColumn("delta_name", name).where(F.col("delta_name").isNotNull()) \
        .groupBy("config", "seed", "delta_name").agg(F.avg("delta").alias("average"))


def seed_avg_variance(runs: DataFrame, split: str = "test") -> DataFrame:
    """AGG-7: per strategy, mean and population variance across seeds of the
    last-round language mean (percent-normalised per value)."""
    last = runs.groupBy("config", "seed").agg(F.max("iteration").alias("iteration"))
    r = runs.where(F.col("split") == split).join(last, ["config", "seed", "iteration"], "left_semi")
    per_seed = r.groupBy("config", "strategy", "seed").agg(F.avg(percent(F.col("value"))).alias("m"))
    return per_seed.groupBy("config", "strategy").agg(F.avg("m").alias("average"),
                                                      F.var_pop("m").alias("variance"),
                                                      F.count("*").alias("n_seeds"))


def config_average_deltas(deltas: DataFrame) -> DataFrame:
    """AGG-8: cross-language mean of deltas per config/strategy/base/round when >1 language."""
    g = deltas.groupBy("config", "prefix", "base", "iteration")
    return g.agg(F.avg("delta").alias("avg_delta"), F.countDistinct("language").alias("n_lang")) \
        .where(F.col("n_lang") > 1)


def pivot_strategies(df: DataFrame, strategies: list[str], value_col: str = "value",
                     keys: tuple[str, ...] = ("config", "iteration")) -> DataFrame:
    """AGG-9: one row per config and round, one column per strategy (explicit pivot values)."""
    return df.groupBy(*keys).pivot("strategy", strategies).agg(F.avg(value_col))


def eval_table(runs: DataFrame, n_val_languages: int = 5) -> DataFrame:
    """AGG-13: per-language evaluation table; validation rows only for the first
    ``n_val_languages`` languages and only at the first and last round."""
    lang_rank = F.dense_rank().over(Window.orderBy("language"))  # over distinct languages only
    langs = runs.select("language").distinct().withColumn("lrank", lang_rank)
    lo, hi = runs.agg(F.min("iteration"), F.max("iteration")).first()
    r = runs.join(langs, "language")
    keep = (F.col("split") == "test") | ((F.col("lrank") <= n_val_languages) & F.col("iteration").isin(lo, hi))
    return r.where(keep).groupBy("language", "split", "iteration").agg(F.avg("value").alias("value"))


# ------------------------------------------------------------------ running mean
_FINE = 1e19  # doubles below this are summed exactly to nine places, and beyond them as doubles


def _exact(df: DataFrame, value: str) -> tuple[Column, Column]:
    """(exact, rest): a value as a number that sums without loss, and what is left of it."""
    kind = df.schema[value].dataType.typeName()
    v = F.col(value)
    if kind not in ("double", "float"):
        return v, F.lit(0.0)
    whole = F.when(F.abs(v) < _FINE, F.round(v, 9)).otherwise(F.when(v.isNotNull(), F.lit(0.0))).cast("decimal(29,9)")
    return whole, v - whole.cast("double")


def running_sum(df: DataFrame, key: str, order: str, value: str, partitions: int | None = None) -> DataFrame:
    """Running sum and count of ``value`` from the start of each ``key`` group up to each row.

    A hot key must not land in one task, so rows are range-partitioned on
    (key, order): a key spans several partitions. Their number follows the bytes (the planner
    puts small ones together) unless ``partitions`` gives it. The partitioned rows are
    written once with their partition number, so the local sums and
    the offsets read the same partitions whatever else the frame holds.
    Per-(partition, key) totals give the offsets of earlier partitions. That
    table has about one row per distinct key (plus one per partition
    boundary), so it is joined back without a forced broadcast: the planner
    broadcasts it only when it is small. NULL keys are a group of their own.
    Rows of a key with equal ``order`` are summed in an arbitrary order.

    Doubles are summed as decimals of nine places plus what is left of each, so offsets over
    billions of rows lose no digits and the result does not depend on the partitions.
    """
    by = [F.col(key), F.col(order)]
    x = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    x = materialise(x.withColumn("_pid", F.spark_partition_id()), "running_parts")
    exact, rest = _exact(df, value)
    x = x.withColumn("_e", exact).withColumn("_r", rest)
    w = Window.partitionBy("_pid", key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = x.withColumn("_s", F.sum("_e").over(w)).withColumn("_sr", F.sum("_r").over(w)).withColumn("_c", F.count(F.lit(1)).over(w)).withColumn("_n", F.count("_e").over(w))
    tot = x.groupBy("_pid", key).agg(F.sum("_e").alias("_ts"), F.sum("_r").alias("_tr"), F.count("*").alias("_tc"), F.count("_e").alias("_tn"))
    before = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(F.col("_pid").alias("_opid"), F.col(key).alias("_okey"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(o)
                                                                               for c, o in (("_ts", "_os"), ("_tr", "_or"), ("_tc", "_oc"), ("_tn", "_on"))])
    y = local.join(off, (F.col("_pid") == F.col("_opid")) & F.col(key).eqNullSafe(F.col("_okey")))
    total = F.coalesce(F.col("_s"), F.lit(0)) + F.col("_os")
    if df.schema[value].dataType.typeName() in ("double", "float"):
        total = total.cast("double") + (F.coalesce("_sr", F.lit(0.0)) + F.col("_or"))
    # NULL until the first value, as in a plain window
    return y.withColumn("running_sum", F.when(F.col("_n") + F.col("_on") > 0, total)) \
        .withColumn("running_count", F.col("_c") + F.col("_oc")) \
        .drop("_pid", "_opid", "_okey", "_e", "_r", "_s", "_sr", "_c", "_n", "_os", "_or", "_oc", "_on")


def running_mean(df: DataFrame, key: str, order: str, value: str, partitions: int | None = None) -> DataFrame:
    """AGG-14: mean of ``value`` from the start of each ``key`` group up to each row."""
    r = running_sum(df, key, order, value, partitions)
    return r.withColumn("running_mean", F.col("running_sum") / F.col("running_count"))


# ------------------------------------------------------------------ paths
def run_path(model: Column, dataset: Column, config: Column, budget: Column, hparams: Column, seed: Column,
             strategy: Column, iteration: Column, task_type: Column, margin: Column) -> Column:
    """SNK-3: model/dataset/config/budget/<hparams>_seed_<seed>/<strategy folder>/iter_<n>;
    uncertainty strategies of token tasks get a '_margin_<m>' suffix."""
    folder = F.when(strategy.contains("uncertainty") & (task_type == "token"),
                    F.concat(strategy, F.lit("_margin_"), margin)).otherwise(strategy)
    return F.concat_ws("/", model, dataset, config, budget.cast("string"),
                       F.concat(hparams, F.lit("_seed_"), seed.cast("string")), folder,
                       F.concat(F.lit("iter_"), iteration.cast("string")))
