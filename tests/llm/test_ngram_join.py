"""The sparse product against all pairs of sets."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from poolpick.llm import bytekit as B
from poolpick.llm import ngram_join as J
from .conftest import DOCS, words
from .test_dedup import near_rows, plain_near
from .test_text_kernels import thue_morse


def run(spark, rows, k=3, percent=90, **sizes):
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], DOCS).withColumns({c: F.lit("x") for c in ("key", "cell", "fam", "sig", "n", "bits")})
    return {r.doc_id: (r.n_shingles, r.component_id) for r in J.join(df.repartition(3), k, percent, **sizes).collect()}


def plain(rows, k=3, percent=90):
    return {i: x[:2] for i, x in plain_near(rows, k, percent).items()}


def templates(seed):
    """Groups whose members share most words but differ by more or less than the similarity, and a passage that all share."""
    rng = random.Random(seed)
    passage, rows = words(rng, 30, 5000), []
    for size, changes in ((60, 5), (25, 2), (12, 12), (4, 1)):
        base = words(rng, rng.choice((90, 140, 400)), 4000).split()
        for _ in range(size):
            t = list(base)
            for _ in range(rng.randrange(changes + 1)):
                t[rng.randrange(len(t))] = f"x{rng.randrange(10 ** 6)}"
            if rng.random() < 0.2:
                t = t[:int(len(t) * rng.uniform(0.85, 1))]
            rows.append(" ".join(t))
    rows += [f"{passage} {words(rng, rng.randrange(1, 60), 4000)}" for _ in range(40)] + [words(rng, rng.randrange(1, 9), 6) for _ in range(60)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [0, 1])
def test_components_equal_all_pairs(spark, seed):
    rows = templates(seed)
    assert run(spark, rows) == plain(rows)


def test_blocks_chunks_and_pivots_lose_no_link(spark):
    """Columns of many blocks and families of many chunks give what one block and one chunk give."""
    rows = templates(2) + [(1000 + i, t) for i, t in near_rows() if t]
    want = plain(rows)
    assert run(spark, rows, cell=4, family=5) == want
    assert run(spark, rows, k=2, percent=60, cell=7, family=9) == plain(rows, 2, 60)


def test_cases(spark, edge_docs, no_docs):
    got = J.join(edge_docs).collect()
    assert len(got) == edge_docs.count()
    by = {r.doc_id: (r.n_shingles, r.component_id) for r in got}
    assert by[0] == (0, 0) and by[1] == (0, 1) and by[2] == (0, 2) and by[3] == (1, 3) and by[5] == (by[4][0], 4) and by[None][1] is None
    assert J.join(no_docs).count() == 0
    rows = [(1, "a b"), (2, "A  B"), (3, "a c"), (4, "a"), (5, "a b c"), (6, "a\tb\nc"), (7, "é b c"), (8, "É b c")]
    assert run(spark, rows) == plain(rows)
    with pytest.raises(ValueError, match="integer"):
        J.join(spark.createDataFrame([("x", "a b c")], "doc_id string, text string"))


def test_several_texts_of_one_id_are_one_node(spark):
    rng = random.Random(4)
    a, b, c = (words(rng, 60, 3000) for _ in range(3))
    rows = [(1, a), (5, a), (5, b), (7, b), (3, c)]
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], DOCS)
    assert {(r.doc_id, r.component_id) for r in J.join(df).collect()} == {(1, 1), (5, 1), (7, 1), (3, 3)}


def test_patterned_words_are_not_linked(spark):
    rows = [(2 * j + i, f"{w} one two three") for j, n in enumerate((1024, 4096)) for i, w in enumerate(thue_morse(n))]
    assert run(spark, rows) == plain(rows)


def some_sets(rng, m):
    out = []
    for _ in range(m):
        if out and rng.random() < 0.7:
            t = set(rng.choice(out))
            for _ in range(rng.randrange(len(t) // 8 + 2)):
                t.discard(rng.choice(sorted(t))) if rng.random() < 0.5 and len(t) > 1 else t.add(rng.randrange(1 << 60))
            out.append(t)
        else:
            out.append({rng.randrange(1 << 60) for _ in range(rng.choice((1, 3, 20, 150, 900)))})
    return out


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_product_gives_all_links(percent):
    sets = some_sets(random.Random(percent), 70)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    grams = np.concatenate([np.array(sorted(s), np.uint64) for s in sets])
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])}
    for columns in (3, 64, 16_384):
        i, j = J.product(grams, at, percent, columns)
        assert set(zip(i.tolist(), j.tolist())) == want


def test_parity_bits_never_exceed_the_difference():
    sets = some_sets(random.Random(8), 80)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    grams = np.concatenate([np.array(sorted(s), np.uint64) for s in sets])
    bits = J._Parity(J.parity_bits(grams, at))
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    apart = np.array([len(sets[a] ^ sets[b]) for a, b in zip(i, j)])
    found = bits.differing(i, j)
    assert (found <= apart).all() and found.max() > 30


def test_blocks_of_a_column_follow_the_sizes(spark):
    """Whatever the batches: an entry meets every block that may hold a fitting size, and none before."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        entries = [(g, 100 * g + i, 50 + 3 * i, 0) for g in range(6) for i in range((1, 2, 9, 40, 41, 100)[g])]
        df = spark.createDataFrame(entries, "gram long, key long, n int, pos int").repartition(2)
        rows = J._columns(df, 90, 5).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for g in range(6):
        mine = sorted((r.n, r.block, r.low) for r in rows if r.gram == g)
        assert len(mine) == ((0, 2, 9, 40, 41, 100)[g])
        for at, (n, block, low) in enumerate(mine):
            assert block == at // 5 and low == min((b for x, b, _ in mine[:at + 1] if 100 * x >= 90 * n))
