"""One query per operator, over whole tables, with production parameters."""

from __future__ import annotations

from poolpick.llm import (centroid_clustering, license_scan, line_dedup, mixing, near_dedup, ngram_join, quality_classifier, quality_rules, secret_scan, sentencepiece_codec, sql, token_output,
                          topk_search, vector_codes)
from poolpick.llm.common import fresh_path, table


def vocabulary(name: str) -> str:
    """Place of a public tokenizer file (installed alike on every machine)."""
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict = {}
ORACLES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_license_scan(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents"))


@query
def op2_sentencepiece(spark, sf_dir):
    return sentencepiece_codec.encode_and_check(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@query
def op3_quality_classifier(spark, sf_dir):
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op5_near_dedup(spark, sf_dir):
    return near_dedup.link(table(spark, sf_dir, "documents"), k=2)


@query
def op6_quality_rules(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_token_output(spark, sf_dir):
    path = fresh_path(spark, "token_orc")
    token_output.write_tokens(table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"))
    return token_output.document_digests(token_output.read_tokens(spark, path))


@query
def op8_secret_scan(spark, sf_dir):
    return secret_scan.scan(table(spark, sf_dir, "documents"))


@query
def op9_line_dedup(spark, sf_dir):
    out = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.selectExpr("doc_id", "__lines as n_lines", "__removed as n_removed", "text")


@query
def op10_topk_search(spark, sf_dir):
    rows = topk_search.quantised(table(spark, sf_dir, "embeddings"))
    return topk_search.top_k(rows.where("vec_id % 50 = 0"), rows)


@query
def op11_centroid_clustering(spark, sf_dir):
    return centroid_clustering.cluster(centroid_clustering.kept_vectors(table(spark, sf_dir, "embeddings")))


@query
def op12_vector_codes(spark, sf_dir):
    return vector_codes.encode(table(spark, sf_dir, "embeddings"))


@query
def op13_ngram_join(spark, sf_dir):
    return ngram_join.join(table(spark, sf_dir, "documents"))


ORACLES["op1_license_scan"] = license_scan.oracle()

ORACLES["op5_near_dedup"] = sql.jaccard_sql(2, near_dedup.PERCENT, kept=True)

ORACLES["op13_ngram_join"] = sql.jaccard_sql(ngram_join.K, ngram_join.PERCENT)

ORACLES["op11_centroid_clustering"] = sql.clustering_sql()

ORACLES["op12_vector_codes"] = sql.codes_sql()

ORACLES["op10_topk_search"] = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""
