"""Clustering over a VA-file and Ball k-means codebooks against plain rounds of full search."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from poolpick.llm import centroid_clustering as C
from poolpick.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int"


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)


def whole(v, scale):
    return [int(np.floor(scale * float(np.float32(x)))) for x in v]


def sha(xs):
    return hashlib.sha256(",".join(map(str, xs)).encode()).hexdigest()


def plain_round(x, books):
    """Nearest entry of every row, ties to the lower index, in Python integers."""
    d = [[sum((a - b) ** 2 for a, b in zip(v, c)) for c in books] for v in x]
    return [row.index(min(row)) for row in d], [min(row) for row in d]


def plain_move(x, a, books):
    out = []
    for c, old in enumerate(books):
        mine = [v for v, e in zip(x, a) if e == c]
        out.append([sum(col) // len(mine) for col in zip(*mine)] if mine else old)
    return out


def plain_clusters(rows, k, rounds, dim, seed=1):
    kept = [(i, whole(v, 64)) for i, v, _ in rows if usable(v) and len(v) == dim]
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    books, x = [v for _, v in order[:k]], [v for _, v in kept]
    if not books:
        return []
    for _ in range(rounds):
        books = plain_move(x, plain_round(x, books)[0], books)
    a, d = plain_round(x, books)
    of = [sum(e for e, b in zip(d, a) if b == c) for c in range(len(books))]
    return sorted((-1 if i is None else i, c, e, of[c], sum(d), sha(books[c])) for (i, _), c, e in zip(kept, a, d))


def plain_codes(rows, parts, entries, rounds):
    kept = [(i, whole(v, 1024), label) for i, v, label in rows if usable(v)]
    named = sorted((i, v) for i, v, _ in kept if i is not None)
    if not named or len(named[0][1]) % parts:
        return []
    dim = len(named[0][1])
    kept, w = [r for r in kept if len(r[1]) == dim], dim // parts
    cut = lambda v, p: v[p * w:(p + 1) * w]
    starts = [v for _, v in named if len(v) == dim][:entries]
    books, got = [[cut(v, p) for v in starts] for p in range(parts)], None
    for r in range(rounds + 1):
        got = [plain_round([cut(v, p) for _, v, _ in kept], books[p]) for p in range(parts)]
        if r < rounds:
            books = [plain_move([cut(v, p) for _, v, _ in kept], got[p][0], books[p]) for p in range(parts)]
    error = [sum(got[p][1][j] for p in range(parts)) for j in range(len(kept))]
    name = sha([x for b in books for v in b for x in v])
    return sorted((-1 if i is None else i, "".join(f"{got[p][0][j]:02x}" for p in range(parts)), error[j],
                   sum(e for e, (_, _, m) in zip(error, kept) if m == label), name) for j, (i, _, label) in enumerate(kept))


def frame(spark, rows):
    clash = ["key", "code", "cluster", "v", "n", "sums", "part", "entry", "far", "dist", "__label", "__mark"]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in clash}).repartition(3)


def clusters(spark, rows, k=4, rounds=3, dim=6):
    got = C.cluster(C.kept_vectors(frame(spark, rows), dim), k, rounds).collect()
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got)


def codes(spark, rows, parts=2, entries=5, rounds=4):
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in V.encode(frame(spark, rows), parts, entries, rounds).collect())


def clumped(n, d, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, d)) * 3
    return [(i, [float(x) for x in (centres[rng.integers(5)] + rng.normal(size=d) * 0.2).astype(np.float32)], int(rng.integers(3))) for i in range(n)]


BAD = [(900, None, 1), (901, [], 1), (902, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (903, [float("nan")] * 6, 0), (904, [float("inf")] * 6, 0),
       (905, [1.0] * 5, 2), (906, [0.5] * 6, None), (907, [0.25] * 6, None), (None, [0.5, -1.0, 2.0, 0.0, 0.0, 1.0], 1), (None, None, None)]


@pytest.mark.parametrize("seed", [0, 1])
def test_clusters_equal_plain_rounds(spark, seed):
    rows = clumped(150, 6, seed) + BAD
    assert clusters(spark, rows) == plain_clusters(rows, 4, 3, 6)


def test_clusters_of_ties_repeats_and_few_rows(spark):
    same = [(i, [1.0, 2.0, 3.0, -1.0, 0.0, 0.5], 0) for i in range(30)]  # equal centroids: the smaller number wins, others stay empty
    grid = [(100 + i, [float(i % 3), 0.0, 0.0, 0.0, 0.0, float(i % 2)], 0) for i in range(24)]
    for rows in (same + same[:5], grid + same, same[:2], [(1, None, 0)], []):
        assert clusters(spark, rows) == plain_clusters(rows, 4, 3, 6)


def test_intervals_hold_every_distance(spark):
    """Whatever the values: the interval of a code holds the distance, so the nearest centroid is never left out."""
    rng = np.random.default_rng(3)
    for scale in (1, 50, 3000):
        v = np.floor(rng.standard_cauchy(size=(300, 7)).clip(-1e4, 1e4) * scale).astype(np.int64)
        cells = C.cut_cells(spark.createDataFrame([(x,) for x in v.tolist()], "v array<long>").repartition(4))
        centroids = v[:9]
        may = C.Intervals(cells, centroids).overlapping(cells.encode(v))
        d = ((v[:, None] - centroids[None]) ** 2).sum(2)
        assert may[d == d.min(1)[:, None]].all()
        assert (C.nearest(v, may, centroids) == d.argmin(1)).all()


def test_most_vectors_are_settled_without_a_fetch(spark):
    v = np.floor(np.random.default_rng(4).normal(size=(3000, 64)) * 8).astype(np.int64)
    v[:, :4] += (np.arange(3000) % 16)[:, None] * 40
    cells = C.cut_cells(spark.createDataFrame([(x,) for x in v.tolist()], "v array<long>"))
    centroids = np.stack([v[c::16].mean(0) for c in range(16)]).astype(np.int64)
    assert (C.Intervals(cells, centroids).overlapping(cells.encode(v)).sum(1) == 1).mean() > 0.9


@pytest.mark.parametrize("seed", [0, 1])
def test_codes_equal_plain_rounds(spark, seed):
    rows = clumped(120, 6, seed) + BAD
    assert codes(spark, rows) == plain_codes(rows, 2, 5, 4)


def test_codes_of_ties_repeats_and_few_rows(spark):
    same = [(i, [1.0, 2.0, 3.0, -1.0], i % 2) for i in range(30)]
    grid = [(100 + i, [float(i % 3), 0.0, float(i % 5), float(i % 2)], None) for i in range(40)]
    for rows in (same + same[:5], grid + same, same[:2], [(1, None, 0)], [(1, [1.0, 2.0, 3.0], 0)], []):
        assert codes(spark, rows) == plain_codes(rows, 2, 5, 4)


def test_balls_give_what_a_full_search_gives():
    """Stable balls, cores and rings over drifting entries, in both number ranges."""
    rng = np.random.default_rng(5)
    for wide in (1, 1 << 18):
        x = rng.integers(-60, 60, size=(4000, 4)) * wide
        entries = x[:40].copy()
        code, dist = V.full_search(x, entries)
        for step in range(6):
            before = entries.copy()
            move = rng.random(40) < (1, 0.5, 0.1, 0.02, 0, 0)[step]
            entries[move] += rng.integers(-5, 6, size=(move.sum(), 4)) * wide
            shift = np.sqrt(((entries - before).astype(float) ** 2).sum(1))
            radius = np.zeros(40)
            np.maximum.at(radius, code, np.sqrt(dist))
            balls = V.Balls(entries, radius + shift * (1 + 1e-9), shift > 0)
            code, dist = balls.assign(x, code, dist)
            d = ((x[:, None] - entries[None]) ** 2).sum(2)
            assert (code == d.argmin(1)).all() and (dist == d.min(1)).all()
        assert balls.stable.all()  # nothing moved: all work is skipped


def test_too_large_components_fail_with_a_message(spark):
    with pytest.raises(Exception, match="beyond"):
        V.encode(spark.createDataFrame([(1, [1e9, 1.0], 0)], SCHEMA), 2, 2).collect()
