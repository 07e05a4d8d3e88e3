"""Preparation queries: tagging, reshaping, filters, subsets, splits, dedupe."""

from __future__ import annotations

from pyspark.sql import functions as F

from poolpick import fixtures as fx
from poolpick.fixtures import with_views
from poolpick.functions.scores import argmax
from poolpick.operators import prepare as pr
from poolpick.plans.registry import register

_MD5 = "md5(concat_ws(':', '42', CAST(row_id AS VARCHAR)))"


@register("add_language", "SELECT doc_id, quality, toxic, 'unknown' AS language FROM labels")
def q_add_language(spark, sf_dir):
    return pr.add_language(fx.table(spark, sf_dir, "labels"))


@register("drop_raw_columns", with_views(
    "SELECT row_id, language, CAST(length(text) AS BIGINT) AS n_chars FROM docs", "docs"))
def q_drop_raw_columns(spark, sf_dir):
    """PRJ-2 with the drop list taken from a dataset registry entry (SRC-11)."""
    from poolpick.schemas import REGISTRY, drop_for, load_registry

    reg = load_registry(REGISTRY)
    d = fx.docs_df(spark, sf_dir).withColumn("n_chars", F.length("text").cast("long"))
    out = drop_for(d, reg["docs"], [])
    assert drop_for(d, reg["docs_all_raw"], ["row_id", "language", "n_chars"]).columns == out.columns
    return out


def _pairs_rec(spark, sf_dir):
    return pr.translation_record(fx.pairs_df(spark, sf_dir))


@register("recast_direct", with_views("SELECT row_id, source, target FROM pairs", "pairs"))
def q_recast_direct(spark, sf_dir):
    return pr.recast_direct(_pairs_rec(spark, sf_dir)).select("row_id", "pair.source", "pair.target")


@register("recast_blank_dups", with_views(
    "SELECT row_id, CASE WHEN target IS NULL OR rn > 1 THEN '' ELSE source END AS source, "
    "CASE WHEN target IS NULL OR rn > 1 THEN '' ELSE target END AS target FROM "
    "(SELECT *, row_number() OVER (PARTITION BY source ORDER BY row_id) AS rn FROM pairs)", "pairs"))
def q_recast_blank_dups(spark, sf_dir):
    return pr.recast_blank_dups(_pairs_rec(spark, sf_dir)).select("row_id", "pair.source", "pair.target")


@register("recast_first_pairs", with_views(
    "SELECT row_id, source, target FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY row_id) AS rn "
    "FROM pairs) WHERE rn = 1", "pairs"))
def q_recast_first_pairs(spark, sf_dir):
    return pr.recast_first_pairs(fx.pairs_df(spark, sf_dir)).select("row_id", "pair.source", "pair.target")


@register("recast_custom",
          "SELECT a.conv_id * 1000 + a.turn AS row_id, a.text AS source, coalesce(NULLIF(b.text, ''), '') AS target "
          "FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 "
          "WHERE a.role = 'user'")
def q_recast_custom(spark, sf_dir):
    """PRJ-3d on user turns and the following turn (missing reply -> '')."""
    c = fx.table(spark, sf_dir, "conversations")
    a = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    j = a.join(b, ["conv_id", "turn"], "left").withColumn("row_id", F.col("conv_id") * 1000 + F.col("turn"))
    return pr.recast_custom(j, "prompt", "reply").select("row_id", "pair.source", "pair.target")


def _configs(spark, sf_dir):
    """Available pair configs: the pair languages plus 'en-<lang>' for de and es documents."""
    p = fx.pairs_df(spark, sf_dir).select(F.col("language").alias("config"))
    d = fx.docs_df(spark, sf_dir).where(F.col("language").isin("de", "es")) \
        .select(F.concat(F.lit("en-"), F.col("language")).alias("config"))
    return p.unionByName(d).distinct()


_CONFIGS_SQL = ("cfg", "SELECT DISTINCT language AS config FROM pairs UNION SELECT DISTINCT 'en-' || language "
                       "FROM docs WHERE language IN ('de', 'es')")
_REQ_SQL = ("req", "SELECT DISTINCT upper(language) || '-EN' AS request FROM docs UNION "
                   "SELECT DISTINCT 'EN-' || upper(language) FROM docs UNION SELECT 'MY-EN' UNION SELECT 'EN-UR'")


@register("resolve_pair_config", with_views(
    "SELECT request, src, tgt, coalesce(f.config, r.config) AS config, "
    "(f.config IS NULL AND r.config IS NOT NULL) AS reversed FROM "
    "(SELECT request, split_part(lower(request), '-', 1) AS src, split_part(lower(request), '-', 2) AS tgt FROM req) q "
    "LEFT JOIN cfg f ON f.config = src || '-' || tgt LEFT JOIN cfg r ON r.config = tgt || '-' || src",
    "pairs", "docs", extra=[_CONFIGS_SQL, _REQ_SQL]))
def q_resolve_pair_config(spark, sf_dir):
    d = fx.docs_df(spark, sf_dir).select(F.upper("language").alias("l")).distinct()
    req = d.select(F.concat("l", F.lit("-EN")).alias("request")) \
        .unionByName(d.select(F.concat(F.lit("EN-"), "l").alias("request"))) \
        .unionByName(spark.createDataFrame([("MY-EN",), ("EN-UR",)], "request string")).distinct()
    return pr.resolve_pair_config(req, _configs(spark, sf_dir))


@register("filter_configs", with_views(
    "SELECT config FROM cfg WHERE split_part(config, '-', 1) IN ('de', 'en', 'my', 'fr') "
    "AND split_part(config, '-', 2) IN ('de', 'en', 'my', 'fr') AND contains(config, 'en')",
    "pairs", "docs", extra=[_CONFIGS_SQL]))
def q_filter_configs(spark, sf_dir):
    return pr.filter_configs(_configs(spark, sf_dir), allowed=["de", "en", "my", "fr"], must_contain="en")


@register("lang_from_id", with_views("SELECT row_id, split_part(id, '-', 1) AS lang FROM docs", "docs"))
def q_lang_from_id(spark, sf_dir):
    return fx.docs_df(spark, sf_dir).select("row_id", pr.lang_from_id("id").alias("lang"))


@register("normalise_inputs", with_views(
    "SELECT d.row_id, md5(coalesce(regexp_replace(d.text, '^\\s+|\\s+$', '', 'g'), '')) AS premise_md5, "
    "CAST(length(coalesce(regexp_replace(d.text, '^\\s+|\\s+$', '', 'g'), '')) AS BIGINT) AS premise_len, "
    "CAST(l.quality AS INTEGER) AS label FROM docs d LEFT JOIN labels l ON l.doc_id = d.row_id", "docs"))
def q_normalise_inputs(spark, sf_dir):
    d = fx.docs_df(spark, sf_dir).join(fx.table(spark, sf_dir, "labels"), F.col("row_id") == F.col("doc_id"), "left")
    n = pr.normalise_inputs(d.select("row_id", F.col("text").alias("premise"), F.col("quality").alias("label")),
                            ["premise"], ["label"])
    return n.select("row_id", F.md5("premise").alias("premise_md5"),
                    F.length("premise").cast("long").alias("premise_len"), "label")


@register("rows_per_language", with_views("SELECT language, count(*) AS n FROM docs GROUP BY language", "docs"))
def q_rows_per_language(spark, sf_dir):
    return pr.rows_per_language(fx.docs_df(spark, sf_dir))


_CODES = ["de", "en", "es", "fr", "e"]


@register("id_contains_lang", with_views(
    " UNION ALL ".join(f"SELECT '{c}' AS lang, count(*) FILTER (WHERE contains(id, '{c}')) AS n FROM docs"
                       for c in _CODES), "docs"))
def q_id_contains_lang(spark, sf_dir):
    return pr.id_contains_counts(fx.docs_df(spark, sf_dir), _CODES)


@register("masked_token_pairs", with_views(
    "SELECT row_id, CAST(pos AS INTEGER) AS pos, CAST(list_position(z, list_max(z)) - 1 AS INTEGER) AS pred, lab FROM tok "
    "WHERE lab <> -100", "tok"))
def q_masked_token_pairs(spark, sf_dir):
    t = fx.tok_df(spark, sf_dir)
    return t.where(F.col("lab") != -100).select("row_id", "pos", argmax(F.col("z")).alias("pred"), "lab")


def _first_n_sql(n):
    return with_views(
        f"SELECT row_id, language FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY row_id) AS rn "
        f"FROM docs) WHERE rn <= {n}", "docs")


@register("subset_per_language", _first_n_sql(50))
def q_subset_per_language(spark, sf_dir):
    return pr.first_n_per_language(fx.docs_df(spark, sf_dir), 50).select("row_id", "language")


@register("debug_head", _first_n_sql(100))
def q_debug_head(spark, sf_dir):
    return pr.first_n_per_language(fx.docs_df(spark, sf_dir), 100).select("row_id", "language")


_SPLIT = "CASE WHEN row_id % 10 = 0 AND language IN ('en', 'fr') THEN 'validation' ELSE 'train' END"


@register("validation_fallback", with_views(
    f"SELECT row_id, language, split FROM s UNION ALL SELECT row_id, language, 'validation' FROM "
    f"(SELECT *, row_number() OVER (PARTITION BY language ORDER BY row_id) AS rn FROM s WHERE split = 'train' "
    f"AND language NOT IN (SELECT language FROM s WHERE split = 'validation')) WHERE rn <= 20",
    "docs", extra=[("s", f"SELECT row_id, language, {_SPLIT} AS split FROM docs")]))
def q_validation_fallback(spark, sf_dir):
    d = fx.docs_df(spark, sf_dir)
    s = d.select("row_id", "language", F.when((F.col("row_id") % 10 == 0) & F.col("language").isin("en", "fr"),
                                               "validation").otherwise("train").alias("split"))
    return pr.validation_fallback(s, 20)


_HASH_SPLIT_SQL = ("hs", f"SELECT row_id, language, config, text, CASE WHEN rn <= (SELECT ceil(0.2 * count(*)) "
                         f"FROM docs) THEN 'validation' ELSE 'train' END AS split FROM "
                         f"(SELECT *, row_number() OVER (ORDER BY {_MD5}, row_id) AS rn FROM docs)")


@register("hash_split", with_views("SELECT row_id, language, split FROM hs", "docs", extra=[_HASH_SPLIT_SQL]))
def q_hash_split(spark, sf_dir):
    return pr.hash_split(fx.docs_df(spark, sf_dir), 0.2, seed=fx.SEED).select("row_id", "language", "split")


@register("sample_k", with_views(f"SELECT row_id, language FROM docs ORDER BY {_MD5}, row_id LIMIT 25", "docs"))
def q_sample_k(spark, sf_dir):
    return pr.sample_k(fx.docs_df(spark, sf_dir), 25, seed=fx.SEED).select("row_id", "language")


@register("dedupe_column", with_views(
    "SELECT row_id, language FROM docs WHERE row_id IN (SELECT min(row_id) FROM docs GROUP BY text)", "docs"))
def q_dedupe_column(spark, sf_dir):
    return pr.dedupe(fx.docs_df(spark, sf_dir), "text").select("row_id", "language")


@register("dedupe_tokens", with_views(
    "SELECT row_id, language, CAST(len(toks) AS INTEGER) AS n_tokens FROM tk WHERE row_id IN "
    "(SELECT min(row_id) FROM tk GROUP BY toks)", "docs",
    extra=[("tk", "SELECT row_id, language, string_split(text, ' ') AS toks FROM docs")]))
def q_dedupe_tokens(spark, sf_dir):
    """DED-1 on a list column: documents with equal token lists, the first stays."""
    d = fx.docs_df(spark, sf_dir).select("row_id", "language", F.split("text", " ").alias("toks"))
    return pr.dedupe(d, "toks").select("row_id", "language", F.size("toks").alias("n_tokens"))


@register("dedupe_source", with_views(
    "SELECT row_id, language FROM pairs WHERE row_id IN (SELECT min(row_id) FROM pairs GROUP BY source)", "pairs"))
def q_dedupe_source(spark, sf_dir):
    return pr.dedupe(fx.pairs_df(spark, sf_dir), "source").select("row_id", "language")


@register("union_languages", with_views("SELECT row_id, language, config FROM docs", "docs"))
def q_union_languages(spark, sf_dir):
    """SET-1: per-language tables (one folder per language) concatenated by name.

    Each frame reads only its own partition, so the union is one pass over the data.
    """
    from poolpick.session import scratch_path
    from poolpick.sources import readers, sinks

    d = fx.docs_df(spark, sf_dir).select("row_id", "language", "config")
    path = scratch_path(spark, "per_language")
    sinks.write_parquet(d, path, ["language"])
    langs = sorted(r["language"] for r in spark.read.parquet(path).select("language").distinct().collect())
    frames = [readers.read_languages(spark, path, [l]).select("row_id", "language", "config") for l in langs]
    return pr.union_languages(frames)


@register("distinct_languages", with_views("SELECT DISTINCT language FROM docs", "docs"))
def q_distinct_languages(spark, sf_dir):
    return fx.docs_df(spark, sf_dir).select("language").distinct()


@register("dataset_plain_sizes", with_views(
    "SELECT 'pairs' AS kind, language AS config, count(*) AS n FROM pairs GROUP BY language UNION ALL "
    "SELECT 'qa', d.config, count(*) FROM answers a JOIN docs d USING (row_id) GROUP BY d.config", "pairs", "docs", "answers"))
def q_dataset_plain_sizes(spark, sf_dir):
    """AGG-2, plain counts: pair sets and QA sets are counted without dedupe."""
    pairs = fx.pairs_df(spark, sf_dir).groupBy(F.lit("pairs").alias("kind"), F.col("language").alias("config"))
    answers = fx.answers_df(spark, sf_dir).join(fx.docs_df(spark, sf_dir).select("row_id", "config"), "row_id")
    qa_sets = answers.groupBy(F.lit("qa").alias("kind"), "config")
    return pairs.agg(F.count("*").alias("n")).unionByName(qa_sets.agg(F.count("*").alias("n")))


@register("dataset_sizes", with_views(
    "SELECT config, split, count(DISTINCT text) AS n FROM hs GROUP BY config, split", "docs",
    extra=[_HASH_SPLIT_SQL]))
def q_dataset_sizes(spark, sf_dir):
    """AGG-2: deduplicated row count per config and split."""
    s = pr.hash_split(fx.docs_df(spark, sf_dir), 0.2, seed=fx.SEED)
    return s.groupBy("config", "split").agg(F.countDistinct(pr.dedupe_key(F.col("text"))).alias("n"))
