"""Corpus pipeline: five training-data operators in a row over ``documents``.

Each stage gets the table that the stage before wrote and returns the columns
of ``documents`` (the last: token ids). Stages keep rows whole: further columns
pass through, repeated rows and nulls are treated as each operator states.
"""

from __future__ import annotations

from poolpick.llm import line_dedup, mixing, near_dedup, quality_classifier, sentencepiece_codec
from poolpick.llm.catalog import vocabulary
from poolpick.llm.common import table, write_out


def quality(spark, docs, sf_dir):
    """Drops the documents that the quality classifier rejects (fitted on the labelled rows among them)."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark, docs, sf_dir):
    """Deletes later copies of repeated line runs of 50 words or more; a text that loses all its lines goes."""
    return line_dedup.clean(docs)


def near(spark, docs, sf_dir):
    """Keeps one document of each group of near copies (five-word shingles, similarity 0.8); one doc_id may stand for several texts."""
    return near_dedup.keep_texts(docs, k=5)


def mix(spark, docs, sf_dir):
    """Repeats or drops documents so that sources come near their target shares."""
    return mixing.resample(docs)


def tokens(spark, docs, sf_dir):
    """Encodes whole texts: all columns but the text, and ids."""
    return sentencepiece_codec.encode_documents(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("mix", mix), ("tokens", tokens)]

ORACLE_SQL = None  # components, run deletion, balanced draws and token ids are not SQL: brute-force tests instead


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = write_out(docs, f"stage_{name}")
    return docs
