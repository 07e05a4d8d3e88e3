"""Stand-in views over the driver tables (see FIXTURES.md part B).

Each ``*_df`` builder derives a typed DataFrame from the parquet tables of
one scale-factor folder; ``DUCK_VIEWS`` holds the same views as DuckDB SQL
so oracle queries can inline them as CTEs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the fixture definitions: the ten language codes of
# the embedding labels (label 0..9, 'xx' has no entry in the code map).
LANGUAGE_CODES = ["ar", "bn", "en", "fi", "id", "ko", "ru", "sw", "te", "xx"]

PREV_MODULUS = 37       # prev selection: pool rows with row_id % 37 = 1
SEED = 42               # random strategies hash md5('42:' || row_id)
FLAGSHIP_BUDGET = 50
BUDGETS = [5, 10, 50, 100]


_TABLES: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One read of a (read-only) driver table per application; DataFrames are immutable,
    so every view shares the same scan definition instead of re-listing the files."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _TABLES:
        _TABLES[key] = spark.read.parquet(path)
    return _TABLES[key]


def _dbl(c: str) -> Column:
    return F.transform(F.col(c), lambda x: x.cast("double"))


def _dslice(c: str, start: Column | int, length: int) -> Column:
    return F.transform(F.slice(F.col(c), start, length), lambda x: x.cast("double"))


def vec_df(spark, sf_dir) -> DataFrame:
    """B1: row_id, language, side ('pool'|'target'), emb array<double>."""
    e = table(spark, sf_dir, "embeddings")
    langs = F.array(*[F.lit(c) for c in LANGUAGE_CODES])
    return e.select(
        F.col("vec_id").alias("row_id"),
        F.try_element_at(langs, (F.col("label") + 1).cast("int")).alias("language"),
        F.when(F.col("vec_id") % 5 == 0, F.lit("target")).otherwise(F.lit("pool")).alias("side"),
        _dbl("embedding").alias("emb"),
    )


def pool_df(spark, sf_dir) -> DataFrame:
    return vec_df(spark, sf_dir).where(F.col("side") == "pool").drop("side")


def target_df(spark, sf_dir) -> DataFrame:
    return vec_df(spark, sf_dir).where(F.col("side") == "target").drop("side")


def seqlog_df(spark, sf_dir) -> DataFrame:
    """B2: row_id, z (3 logits), gold."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("row_id"), _dslice("embedding", 1, 3).alias("z"),
                    (F.col("label") % 3).alias("gold"))


def tok_df(spark, sf_dir) -> DataFrame:
    """B3: row_id, pos, z (4 logits), lab (-100 = masked); 16 positions per row."""
    e = table(spark, sf_dir, "embeddings")
    x = e.select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("pos"))
    k = (F.col("vec_id") + F.col("pos")) % 5
    return x.select(
        F.col("vec_id").alias("row_id"), "pos",
        F.transform(F.slice("embedding", F.col("pos") * 4 + 1, F.lit(4)), lambda v: v.cast("double")).alias("z"),
        F.when(k == 4, F.lit(-100)).otherwise(k).cast("int").alias("lab"))


def qafeat_df(spark, sf_dir) -> DataFrame:
    """B4: feature_id, example_id, zs (32 start logits), ze (32 end logits)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("feature_id"),
                    F.expr("vec_id div 3").alias("example_id"),
                    _dslice("embedding", 1, 32).alias("zs"),
                    _dslice("embedding", 33, 32).alias("ze"))


def states_df(spark, sf_dir) -> DataFrame:
    """B5: row_id, pos, h (8 states), attn (attention mask 0/1)."""
    e = table(spark, sf_dir, "embeddings")
    x = e.select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("pos"))
    return x.select(
        F.col("vec_id").alias("row_id"), "pos",
        F.transform(F.slice("embedding", F.col("pos") * 8 + 1, F.lit(8)), lambda v: v.cast("double")).alias("h"),
        F.when(F.col("pos") < F.lit(3) + F.col("vec_id") % 6, 1).otherwise(0).alias("attn"))


def mtlog_df(spark, sf_dir) -> DataFrame:
    """B6: row_id, pos, z (8 logits over a vocabulary of 8), lab (-100 = masked)."""
    e = table(spark, sf_dir, "embeddings")
    x = e.select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("pos"))
    k = (F.col("vec_id") + F.col("pos")) % 9
    return x.select(
        F.col("vec_id").alias("row_id"), "pos",
        F.transform(F.slice("embedding", F.col("pos") * 8 + 1, F.lit(8)), lambda v: v.cast("double")).alias("z"),
        F.when(k == 8, F.lit(-100)).otherwise(k).cast("int").alias("lab"))


def pairs_df(spark, sf_dir) -> DataFrame:
    """B7: row_id, language ('my-en'|'ur-en'), source, target (user turn -> assistant reply)."""
    c = table(spark, sf_dir, "conversations")
    a = c.where(F.col("role") == "user").alias("a")
    b = c.where(F.col("role") == "assistant").alias("b")
    j = a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("b.turn") == F.col("a.turn") + 1))
    return j.select(
        (F.col("a.conv_id") * 1000 + F.col("a.turn")).alias("row_id"),
        F.when(F.col("a.conv_id") % 2 == 0, F.lit("my-en")).otherwise(F.lit("ur-en")).alias("language"),
        F.col("a.text").alias("source"), F.col("b.text").alias("target"))


def docs_df(spark, sf_dir) -> DataFrame:
    """B8: row_id, language, id ('<lang>-<doc_id>'), config, text."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("row_id"), F.col("lang").alias("language"),
                    F.concat(F.col("lang"), F.lit("-"), F.col("doc_id").cast("string")).alias("id"),
                    F.col("source").alias("config"), "text")


def answers_df(spark, sf_dir) -> DataFrame:
    """B9: benchmark passages found inside documents: item_id, row_id, answer_start, answer.

    The containment theta join runs as equi joins on inner words of the passages.
    """
    from poolpick.operators.textmatch import find_passages

    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    hits = find_passages(d, b)
    return hits.join(b, "item_id").select(
        "item_id", F.col("doc_id").alias("row_id"), F.col("start").alias("answer_start"), F.col("text").alias("answer"))


STRATEGY_BY_PRIORITY = {"1": "gold_ur", "2": "egalitarian", "3": "knn_uncertainty_k_1", "4": "average_dist"}


def runs_df(spark, sf_dir) -> DataFrame:
    """B10: long run metrics (config, strategy, iteration, seed, language, split, value)."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey)
    pr = F.substring("o_orderpriority", 1, 1)
    strategy = F.when(pr == "1", "gold_ur").when(pr == "2", "egalitarian") \
        .when(pr == "3", "knn_uncertainty_k_1").when(pr == "4", "average_dist").otherwise("uncertainty")
    keyed = j.select(
        F.col("c_mktsegment").alias("config"), strategy.alias("strategy"),
        (F.year("o_orderdate") - 1994).cast("int").alias("iteration"),
        F.col("o_orderstatus").alias("seed"),
        F.concat(F.lit("l"), (F.col("c_nationkey") % 3).cast("string")).alias("language"),
        F.when(F.col("o_orderkey") % 2 == 0, "test").otherwise("val").alias("split"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    g = keyed.groupBy("config", "strategy", "iteration", "seed", "language", "split")
    return g.agg((F.sum("cents").cast("double") / (F.count("*") * 60000000).cast("double")).alias("value"))


def steps_df(spark, sf_dir) -> DataFrame:
    """B11: epoch, step, loss, mtime (training-log stand-in)."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("epoch"), F.col("event_id").alias("step"),
                    F.col("value").alias("loss"), F.col("ts").alias("mtime"))


def vec_logits_df(spark, sf_dir) -> DataFrame:
    """B1 and B2 columns from ONE scan of the embeddings table: row_id, language, side, z, gold.

    Both views are projections of the same row, so no self-join is needed.
    """
    e = table(spark, sf_dir, "embeddings")
    langs = F.array(*[F.lit(c) for c in LANGUAGE_CODES])
    return e.select(
        F.col("vec_id").alias("row_id"),
        F.try_element_at(langs, (F.col("label") + 1).cast("int")).alias("language"),
        F.when(F.col("vec_id") % 5 == 0, F.lit("target")).otherwise(F.lit("pool")).alias("side"),
        _dslice("embedding", 1, 3).alias("z"), (F.col("label") % 3).alias("gold"))


def uncertainty_df(spark, sf_dir) -> DataFrame:
    """Per pool row: margin of the two largest seqlog logits (FIXTURES part C)."""
    from poolpick.functions.scores import top2_margin
    v = vec_logits_df(spark, sf_dir).where(F.col("side") == "pool")
    return v.select("row_id", "language", top2_margin(F.col("z")).alias("uncertainty"))


def prev_df(spark, sf_dir) -> DataFrame:
    """Previously selected rows, in order: pool rows with row_id % 37 = 1."""
    return pool_df(spark, sf_dir).where(F.col("row_id") % PREV_MODULUS == 1) \
        .select("row_id", F.col("row_id").alias("prev_order"))


# ---------------------------------------------------------------- DuckDB side
DUCK_VIEWS = {
    "vec": "SELECT vec_id AS row_id, (['ar','bn','en','fi','id','ko','ru','sw','te','xx'])[label+1] AS language, "
           "CASE WHEN vec_id % 5 = 0 THEN 'target' ELSE 'pool' END AS side, embedding::DOUBLE[] AS emb FROM embeddings",
    "pool": "SELECT row_id, language, emb FROM vec WHERE side = 'pool'",
    "tgt": "SELECT row_id, language, emb FROM vec WHERE side = 'target'",
    "seqlog": "SELECT vec_id AS row_id, (embedding[1:3])::DOUBLE[] AS z, label % 3 AS gold FROM embeddings",
    "tok": "SELECT vec_id AS row_id, pos, (embedding[pos*4+1:pos*4+4])::DOUBLE[] AS z, "
           "CAST(CASE WHEN (vec_id+pos) % 5 = 4 THEN -100 ELSE (vec_id+pos) % 5 END AS INTEGER) AS lab "
           "FROM embeddings, range(16) p(pos)",
    "qafeat": "SELECT vec_id AS feature_id, vec_id // 3 AS example_id, (embedding[1:32])::DOUBLE[] AS zs, "
              "(embedding[33:64])::DOUBLE[] AS ze FROM embeddings",
    "states": "SELECT vec_id AS row_id, pos, (embedding[pos*8+1:pos*8+8])::DOUBLE[] AS h, "
              "CASE WHEN pos < 3 + vec_id % 6 THEN 1 ELSE 0 END AS attn FROM embeddings, range(8) p(pos)",
    "mtlog": "SELECT vec_id AS row_id, pos, (embedding[pos*8+1:pos*8+8])::DOUBLE[] AS z, "
             "CAST(CASE WHEN (vec_id+pos) % 9 = 8 THEN -100 ELSE (vec_id+pos) % 9 END AS INTEGER) AS lab "
             "FROM embeddings, range(8) p(pos)",
    "pairs": "SELECT a.conv_id*1000 + a.turn AS row_id, CASE WHEN a.conv_id % 2 = 0 THEN 'my-en' ELSE 'ur-en' END "
             "AS language, a.text AS source, b.text AS target FROM conversations a JOIN conversations b "
             "ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'",
    "docs": "SELECT doc_id AS row_id, lang AS language, concat(lang, '-', CAST(doc_id AS VARCHAR)) AS id, "
            "source AS config, text FROM documents",
    "answers": "SELECT b.item_id, d.doc_id AS row_id, CAST(instr(d.text, b.text) AS BIGINT) - 1 AS answer_start, "
               "b.text AS answer FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    "runs": "SELECT c.c_mktsegment AS config, CASE substring(o.o_orderpriority,1,1) WHEN '1' THEN 'gold_ur' "
            "WHEN '2' THEN 'egalitarian' WHEN '3' THEN 'knn_uncertainty_k_1' WHEN '4' THEN 'average_dist' "
            "ELSE 'uncertainty' END AS strategy, CAST(year(o.o_orderdate) - 1994 AS INT) AS iteration, "
            "o.o_orderstatus AS seed, concat('l', CAST(c.c_nationkey % 3 AS VARCHAR)) AS language, "
            "CASE WHEN o.o_orderkey % 2 = 0 THEN 'test' ELSE 'val' END AS split, "
            "CAST(sum(CAST(round(o.o_totalprice * 100) AS BIGINT)) AS DOUBLE) / CAST(count(*) * 60000000 AS DOUBLE) "
            "AS value FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1,2,3,4,5,6",
    "steps": "SELECT event_type AS epoch, event_id AS step, value AS loss, ts AS mtime FROM events",
    "unc": "SELECT p.row_id, p.language, list_sort(s.z, 'DESC')[1] - list_sort(s.z, 'DESC')[2] AS uncertainty "
           "FROM pool p JOIN seqlog s USING (row_id)",
    "prev": "SELECT row_id, row_id AS prev_order FROM pool WHERE row_id % 37 = 1",
}

# dependency order for inlining
_VIEW_DEPS = {"pool": ["vec"], "tgt": ["vec"], "unc": ["pool", "seqlog"], "prev": ["pool"]}


def with_views(sql: str, *names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``sql`` with the named fixture views (and their dependencies) as CTEs."""
    order: list[str] = []

    def add(n):
        for d in _VIEW_DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = [f"{n} AS ({DUCK_VIEWS[n]})" for n in order]
    ctes += [f"{n} AS ({q})" for n, q in (extra or [])]
    if not ctes:
        return sql
    return "WITH " + ",\n".join(ctes) + "\n" + sql
