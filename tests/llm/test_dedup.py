"""Line runs and near copies against brute force; components of graphs."""

import random
import re
from collections import Counter

from poolpick.llm import line_dedup as L
from poolpick.llm import near_dedup as N
from poolpick.llm.graph import components
from .conftest import DOCS, rows_of, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_lines(rows, min_words):
    """Longest run that starts earlier, at every line; runs of enough words are deleted."""
    docs = [[x.strip(" \t\n\x0b\x0c\r") for x in t.split("\n")] for _, t in rows]
    at, gone = {}, [set() for _ in docs]
    for d, lines in enumerate(docs):
        for k in range(len(lines)):
            best = 0
            for e, q in at.get(lines[k], []):
                n = 0
                while k + n < len(lines) and q + n < len(docs[e]) and lines[k + n] == docs[e][q + n]:
                    n += 1
                best = max(best, n)
            if best and sum(len(WORD.findall(x)) for x in lines[k:k + best]) >= min_words:
                gone[d].update(range(k, k + best))
            at.setdefault(lines[k], []).append((d, k))
    return {i: ("\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone[d]), len(gone[d])) for d, (i, t) in enumerate(rows)}


def test_line_runs_match_brute_force(spark):
    rng = random.Random(7)
    pool = [words(rng, rng.randrange(1, 9)) for _ in range(25)] + ["", "  "]
    rows = []
    for i in range(60):
        lines = [rng.choice(pool) for _ in range(rng.randrange(1, 40))]
        if rows and rng.random() < 0.5:
            other = rng.choice(rows)[1].split("\n")
            a = rng.randrange(len(other))
            lines[rng.randrange(len(lines)):0] = other[a:a + rng.randrange(1, 30)]
        rows.append((i, "\n".join(lines)))
    rows += [(100, rows[3][1]), (101, rows[3][1] + "\nnew line here"), (102, "\n".join(["same line again"] * 40))]
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], DOCS)
    for least in (1, 20, 50):
        got = {r.doc_id: (r.text, r["__removed"]) for r in L.dedup(df.repartition(3), least).collect()}
        want = plain_lines(rows, least)
        assert all(got[i] == (want[i][0] if want[i][1] else t, want[i][1]) for i, t in rows)


def test_line_dedup_edges(spark, edge_docs, no_docs):
    out = L.dedup(edge_docs)
    assert out.count() == edge_docs.count()
    text = {r.doc_id: r.text for r in out.collect() if r.doc_id is not None}
    assert text[0] is None and text[1] == "" and text[2] == " \n\t " and text[5] == ""  # 5 repeats 4
    cleaned = L.clean(edge_docs)
    assert cleaned.columns == edge_docs.columns and 5 not in {r.doc_id for r in cleaned.collect()}
    assert cleaned.where("doc_id = 6").count() == edge_docs.where("doc_id = 6").count()
    assert L.dedup(no_docs).count() == 0 and L.clean(no_docs).count() == 0


def plain_near(rows, k, percent=80):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def near_rows():
    rng = random.Random(11)
    rows = []

    def add(t):
        rows.append((len(rows), t))

    for _ in range(40):
        add(words(rng, rng.randrange(5, 120), 2000))
    for size in (120, 3, 5, 2, 30):  # families: copies with changed words, exact copies, chains
        base = words(rng, 80, 3000).split()
        for _ in range(size):
            t = list(base)
            for _ in range(rng.randrange(0, 7)):
                t[rng.randrange(len(t))] = f"x{rng.randrange(9999)}"
            add(" ".join(t))
            if rng.random() < 0.3:
                add(" ".join(t).upper().replace("X", "x"))
            if rng.random() < 0.3:
                base[rng.randrange(len(base))] = f"y{rng.randrange(9999)}"
    rng.shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    return rows + [(9000, "one"), (9001, "ONE"), (9002, ""), (9003, None), (9004, "two")]


def test_near_copies_match_brute_force(spark):
    rows = near_rows()
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], DOCS)
    for k, sizes in ((2, {}), (5, {}), (2, {"leaf": 6, "family": 20, "depth": 4})):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.link(df.repartition(3), k, **sizes).collect()}
        assert got == plain_near(rows, k)


def test_cut_nodes_lose_no_possible_link(spark, monkeypatch):
    monkeypatch.setattr(N, "TREES", 1)  # fewer nodes: a pair has few chances to meet in a chunk
    monkeypatch.setattr(N, "PIVOTS", 1)
    rng = random.Random(17)
    base, rows = words(rng, 100, 5000).split(), []
    for i in range(500):  # alike, but mostly below the similarity: nodes are cut, and pivots tie little
        t = list(base)
        for at in rng.sample(range(0, 100, 2), 12):
            t[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(t)))
        if i % 2 == 0:  # a near copy of this one
            t[99 - 2 * rng.randrange(50)] = "other"
            rows.append((1000 + i, " ".join(t)))
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], DOCS)
    reps = N.representatives(N.sketches(df.repartition(3), 2, 5)).localCheckpoint()
    cells, hot = N.leaves(reps, 6, N.ROOT)
    tied = N.possible_links(cells, reps).localCheckpoint()
    members = {}
    for r in hot.collect():
        members.setdefault(r.node, set()).add(r.rep)
    size = {r.rep: (r.n, N.np.frombuffer(r.sk, N.np.uint16)) for r in reps.collect()}
    possible = {(a, b) for m in members.values() for a in m for b in m if a < b and b == a + 1000}
    possible = {(a, b) for a, b in possible if len(N._near(N.np.stack([size[a][1], size[b][1]]), N.np.array([0]), N.np.array([1]), 80)[0])}
    part = lambda edges: dict(map(tuple, components(edges).collect()))
    before = part(tied)
    assert any(before.get(a, a) != before.get(b, b) for a, b in possible)  # chunks and pivots alone lose some
    after = part(tied.unionByName(N.rest_links(hot, tied, reps, wide=64)))
    assert possible and all(after.get(a, a) == after.get(b, b) for a, b in possible)
    got = {r.doc_id: r.component_id for r in N.link(df, 2, leaf=6, depth=N.ROOT, wide=64).collect()}
    assert all(got[a] == got[b] for a, b in possible)


def test_links_of_a_large_group_are_few_a_row(spark):
    rng = random.Random(29)
    base = words(rng, 80, 5000).split()
    for size in (400, 1600):  # one group of near copies, in cut nodes of all trees
        rows = []
        for i in range(size):
            t = list(base)
            t[rng.randrange(80)] = f"x{i}"
            rows.append((i, " ".join(t)))
        df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], DOCS)
        reps = N.representatives(N.sketches(df.repartition(3), 2, 5)).localCheckpoint()
        cells, hot = N.leaves(reps)
        assert hot is not None
        tied = N.possible_links(cells, reps).localCheckpoint()
        assert tied.where("u <> v").distinct().count() <= 4 * size
        assert {r.component for r in components(tied).collect()} == {0}


def test_pipeline_near_is_the_same_with_cut_and_whole_nodes(spark, monkeypatch):
    import functools

    import corpus_pipeline as P

    for name, value in (("TREES", 1), ("PIVOTS", 1)):
        monkeypatch.setattr(N, name, value)
    monkeypatch.setattr(N.B, "new_seed", lambda: 5)
    rng = random.Random(23)
    base, rows = words(rng, 150, 5000).split(), []
    for i in range(300):
        t = list(base)
        for at in rng.sample(range(0, 150, 2), 10):
            t[at] = f"x{rng.randrange(10**6)}"
        rows += [(i, " ".join(t)), (1000 + i, " ".join([*t, "more", "words"]))]
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], DOCS)
    whole, kept = N.link, []
    for leaf, wide in ((10**6, 64), (6, 64)):
        monkeypatch.setattr(N, "link", functools.partial(whole, leaf=leaf, depth=N.ROOT, wide=wide))
        kept.append(sorted(r.doc_id for r in P.near(spark, df, None).collect()))
    assert kept[0] == kept[1] and len(kept[0]) < len(rows)


def test_near_edges(edge_docs, no_docs):
    got = N.link(edge_docs, 2).collect()
    assert len(got) == edge_docs.count()
    by = {r.doc_id: r for r in got}
    assert by[5].component_id == 4 and not by[5].kept and by[4].kept
    assert by[0].n_shingles == 0 and by[0].kept and by[None].component_id is None
    one = N.keep_one(edge_docs, 5)
    assert one.columns == edge_docs.columns
    n = Counter(r.doc_id for r in one.collect())
    assert n[6] == 1 and 5 not in n and n[4] == 1 and n[None] == edge_docs.where("doc_id IS NULL").count()
    assert N.link(no_docs, 2).count() == 0 and N.keep_one(no_docs, 5).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + j) for j in range(1, 40)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    loops = {a for a, b in edges if a == b} - set(got)
    assert got == {n: find(n) for n in root if n not in loops}


def test_pipeline_near_keeps_other_texts_of_one_id(spark, edge_docs, no_docs):
    import corpus_pipeline as P

    rng = random.Random(21)
    a, b, c, d = (words(rng, 120, 3000) for _ in range(4))
    near_a, near_b = a + " more", b + " more"
    # 7 stands for b and for a copy of a (kept under 1); 3 for a repeated row; 9 for near copies of each other; 20 is a copy of the text that 7 keeps
    rows = [(1, a), (7, b), (7, near_a), (3, c), (3, c), (9, d), (9, d + " more"), (20, near_b), (-4, "short one"), (-4, "another"), (30, "last text"), (None, a)]
    df = spark.createDataFrame([(i, t, "en", "x", 0) for i, t in rows], DOCS)
    got = Counter((r.doc_id, r.text) for r in P.near(spark, df.repartition(4), None).collect())
    nines = [k for k in got if k[0] == 9]
    assert len(nines) == 1 and got[nines[0]] == 1
    assert {k: n for k, n in got.items() if k[0] != 9} == {k: 1 for k in [(1, a), (7, b), (3, c), (-4, "short one"), (-4, "another"), (30, "last text"), (None, a)]}
    for layout in (1, 3):  # the same rows in any layout
        assert Counter((r.doc_id, r.text) for r in P.near(spark, df.repartition(layout), None).collect()) == got
    out = P.near(spark, edge_docs, None)
    assert out.columns == edge_docs.columns
    n = Counter(r.doc_id for r in out.collect())
    assert n[6] == 2 and 5 not in n and n[4] == 1 and n[None] == edge_docs.where("doc_id IS NULL").count()
    assert P.near(spark, no_docs, None).count() == 0


def test_patterned_words_are_no_near_copies(spark):
    from .test_text_kernels import thue_morse

    rows = [(2 * j + i, f"{w} one two") for j, n in enumerate((1024, 2048, 16384)) for i, w in enumerate(thue_morse(n))]
    got = N.link(spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], DOCS), 2).collect()
    assert all(r.kept and r.component_id == r.doc_id and r.n_shingles == 2 for r in got)


def test_components_of_odd_edges(spark):
    none = spark.createDataFrame([], "u long, v long")
    assert components(none).count() == 0
    odd = spark.createDataFrame([(1, None, "x"), (None, 2, "x"), (None, None, "x"), (3, 3, "x"), (5, 4, "x"), (4, 5, "y")], "u long, v long, m string")
    assert sorted(map(tuple, components(odd).collect())) == [(4, 4), (5, 4)]
