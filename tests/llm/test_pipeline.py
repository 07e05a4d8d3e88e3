"""The pipeline's stages against brute force on whole small tables, each on its own input."""

from collections import Counter

import pytest

import corpus_pipeline as P
from poolpick.llm import quality_classifier as Q
from poolpick.llm.catalog import vocabulary
from poolpick.llm.mixing import WEIGHTS
from .test_dedup import plain_lines, plain_near
from .test_mixing import plain_targets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows that each stage returns, written and read as the driver does."""
    out, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    out.append(docs)
    for i, (_, stage) in enumerate(P.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(i))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def texts(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_names_and_columns(stages):
    assert [n for n, _ in P.STAGES] == ["quality", "lines", "near", "mix", "tokens"]
    assert all(set(s.columns) == set(stages[0].columns) for s in stages[:-1])


def test_quality_drops_what_the_classifier_rejects(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in Q.classify(stages[0], labels).collect() if r.predicted == 1}
    assert {r.doc_id for r in stages[1].collect()} == good
    bad = {r.doc_id for r in labels.where("quality = 0").collect()}
    assert len(bad & good) <= 0.2 * len(bad)


def test_lines_equal_brute_force(stages):
    rows = texts(stages[1])
    want = plain_lines(rows, 50)
    kept = sorted((i, want[i][0] if want[i][1] else t) for i, t in rows if not want[i][1] or want[i][1] < len(t.split("\n")))
    assert texts(stages[2]) == kept
    assert all(r.n_chars == len(r.text) for r in stages[2].collect() if want[r.doc_id][1])


def test_near_keeps_one_of_each_group(stages):
    rows = texts(stages[2])
    want = plain_near(rows, 5)
    assert texts(stages[3]) == [(i, t) for i, t in rows if want[i][2]]


def test_mix_meets_the_targets(stages):
    before, after = stages[3].collect(), Counter(r.doc_id for r in stages[4].collect())
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in before:
        n = len(r.text.split())
        sizes[r.source] += n
        taken[r.source] += n * after[r.doc_id]
        largest[r.source] = max(largest[r.source], n)
    targets = plain_targets(sizes)
    assert len(WEIGHTS) == 3 and max(after.values()) <= 2
    assert all(abs(taken[s] - targets[s]) <= largest[s] / 2 + 1 for s in sizes)


def test_tokens_equal_the_library(stages):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    text = {r.doc_id: r.text for r in stages[4].collect()}
    rows = stages[5].collect()
    assert len(rows) == stages[4].count() and all(list(r.ids) == sp.encode(text[r.doc_id]) for r in rows)


def test_run_gives_the_rows_of_the_last_stage(spark, stages):
    assert Counter(r.doc_id for r in P.run(spark, SF).collect()) == Counter(r.doc_id for r in stages[5].collect())
    assert P.ORACLE_SQL is None


def test_run_on_empty_and_on_clashing_tables(spark, tmp_path, edge_docs, no_docs):
    """The pipeline as registered, over whole folders: no documents, and nulls, repeats and columns that operators use inside."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, docs in (("none", no_docs), ("edge", edge_docs)):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
    none = P.run(spark, str(tmp_path / "none"))
    assert none.count() == 0 and set(none.columns) == set(no_docs.columns) - {"text"} | {"ids"}
    edge = P.run(spark, str(tmp_path / "edge"))
    assert set(edge.columns) == set(edge_docs.columns) - {"text"} | {"ids"}
    kept = Counter(r.doc_id for r in edge.collect())
    assert 5 not in kept and set(kept) <= {r.doc_id for r in edge_docs.collect()}  # 5 repeats 4
