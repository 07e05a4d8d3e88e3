"""MinHash near-dedup by a chosen-path set similarity join.

1. Each text becomes its set of distinct word shingles (64-bit names), a 128-bit
   signature of the set, and ``SKETCH`` minwise values. Equal sets are
   one representative (the least doc_id), however many copies there are.
2. ``TREES`` independent trees branch the representatives: a node sends
   a document to the children named by its minwise tokens of ``BRANCH`` hash functions
   of that level, so a pair of similarity 0.8 meets again with
   probability 1 - 0.2^2 a level; a tree finds it with about 0.94 at any depth,
   six trees with 1 - 5e-8. Nodes of up to ``LEAF`` documents are leaves; larger ones
   branch on, down to ``DEPTH``. A large node whose documents share most minwise tokens
   (or at that depth) holds near copies, which a further branch would not part: it is cut into hash
   chunks that all hold the same pivots. What the chunks leave apart is looked up exactly: rows outside the
   largest part of a cut node meet all its rows of other parts, block by block, so a cut node
   compares every pair that is not tied already.
3. A leaf compares all its pairs on the sketches, and returns a spanning forest of the
   pairs that may reach the similarity (4 standard errors below it), never
   the pairs. The forests' components are families.
4. Families are confirmed on full sets: the texts of their members are cut up again, and
   a family is searched breadth first, each reached document against those
   not reached yet, so a group of copies costs one comparison each. Large families
   are cut into chunks without losing a link (``families.py``).

Cases: a text with fewer words than a shingle is one shingle; without words the set is
empty and linked with nothing; a null doc_id is linked with nothing; rows of one
doc_id count as one node, whose links join; copies of a row share the
component; an empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolpick.llm import bytekit as B
from poolpick.llm.common import has, join_back, write_out
from poolpick.llm.families import LINKS, linked, sets_of
from poolpick.llm.graph import components

TREES, BRANCH, DEPTH, ROOT = 6, 2, 6, 3
SKETCH = TREES * DEPTH * BRANCH
LEAF, PIVOTS, FAMILY, LEFT, GRAMS = 48, 8, 200, 100, 4_000_000
WIDE, PAIRS = 1024, 20_000_000  # rows of a block of a cut node's rest, pairs of one task there
PERCENT = 80
SIGNS, ALIKE = 16, 0.4  # hash functions of the test for near copies, share of equal tokens that passes it
ERRORS = 4.2  # standard errors of the sketch below the similarity that still count as possible
_SEEDS = B.mix(np.arange(1, 2 * SKETCH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _sets(data: np.ndarray, offs: np.ndarray, k: int, seed: int = 0):
    low = B.LOWER[data]
    w = B.words(low, offs)
    return B.shingle_sets(w, B.span_hashes(low, w.starts, w.ends, seed), k)


def _signatures(sh: np.ndarray, at: np.ndarray) -> list[bytes]:
    """16 bytes per set: wrapping sums of two mixes of its members."""
    two = []
    for salt in (0x51ED270B, 0xB5297A4D):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(B.mix(sh + np.uint64(salt)), dtype=np.uint64)])
        two.append(sums[at[1:]] - sums[at[:-1]])
    both = np.stack([two[0], two[1] + np.diff(at).astype(np.uint64)], 1)
    raw = np.ascontiguousarray(both).tobytes()
    return [raw[i:i + 16] for i in range(0, len(raw), 16)]


def _minwise(sh: np.ndarray, at: np.ndarray) -> np.ndarray:
    """SKETCH minwise values (32 bits) per set; zero for empty sets."""
    out = np.zeros((len(at) - 1, SKETCH), np.int32)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        for i in range(SKETCH):
            x = sh * _SEEDS[2 * i]
            x ^= x >> np.uint64(32)
            x *= _SEEDS[2 * i + 1]
            out[full, i] = (np.minimum.reduceat(x, at[:-1][full]) >> np.uint64(24)).astype(np.uint32).view(np.int32)
    return out


def _binary(matrix: np.ndarray) -> pa.Array:
    """One binary value per row of a matrix."""
    raw = np.ascontiguousarray(matrix).tobytes()
    step = matrix.shape[1] * matrix.itemsize
    return pa.array([raw[i:i + step] for i in range(0, len(raw), step)], pa.binary())


def sketches(docs: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """doc_id, n (set size), sig, mh (minwise values), sk (their low 16 bits) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            data, offs = B.column_bytes(b.column(1))
            for lo, hi, d, o in B.blocks(data, offs):
                sh, at = _sets(d, o, k, seed)
                mh = _minwise(sh, at)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(np.diff(at).astype(np.int64)), pa.array(_signatures(sh, at), pa.binary()),
                     _binary(mh), _binary(mh.view(np.uint32).astype(np.uint16))], ["doc_id", "n", "sig", "mh", "sk"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, sig binary, mh binary, sk binary")


def representatives(rows: DataFrame) -> DataFrame:
    """rep (least doc_id), sig, n, mh, sk: one row per distinct non-empty set."""
    return (rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("sig")
            .agg(F.min("doc_id").cast("long").alias("rep"), F.min("n").alias("n"), F.min("mh").alias("mh"), F.min("sk").alias("sk")))


def _token(level, tree, branch):
    """SQL for the minwise token (4 bytes) of a tree's level and branch."""
    return F.substring(F.col("mh"), 4 * ((tree * DEPTH + level) * BRANCH + branch) + 1, 4)


def _root_nodes(reps: DataFrame) -> DataFrame:
    """node, tree, rep: the nodes ``ROOT`` levels down, BRANCH^ROOT of each tree."""
    nodes = []
    for tree in range(TREES):
        for path in range(BRANCH ** ROOT):
            tokens = [_token(level, tree, (path // BRANCH ** level) % BRANCH) for level in range(ROOT)]
            nodes.append(F.struct(F.xxhash64(F.lit(tree * 1000 + path), *tokens).alias("node"), F.lit(tree).alias("tree")))
    return reps.select("rep", F.explode(F.array(*nodes)).alias("x")).select("x.node", "x.tree", "rep")


def _next_nodes(rows: DataFrame, reps: DataFrame, level: int) -> DataFrame:
    """Children of large nodes: BRANCH for each document."""
    kids = []
    for tree in range(TREES):
        kids.append(F.array(*[F.xxhash64("node", F.lit(level * 10 + b), _token(level, tree, b)) for b in range(BRANCH)]))
    joined = rows.join(reps.select("rep", "mh"), "rep")
    return joined.select("rep", "tree", F.explode(F.get(F.array(*kids), F.col("tree"))).alias("node")).select("node", "tree", "rep")


def _least(key: str) -> list:
    """Aggregates p0, p1, ...: the members that come first under PIVOTS hash orders (no sort of the group)."""
    return [F.min(F.struct(F.xxhash64(key, "node", F.lit(i)), F.col("rep")))["rep"].alias(f"p{i}") for i in range(PIVOTS)]


def _alike_nodes(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """node, alike: whether a node's documents share most of their minwise tokens.

    The share of pairs with equal tokens is estimated by sums of random signs, one
    per document and hash function (a sum squared is the second moment of
    the token counts), so a node of any size is a few partial sums.
    """
    at = [i * SKETCH // SIGNS for i in range(SIGNS)]
    sign = lambda i: F.xxhash64(F.substring("mh", 4 * i + 1, 4)).bitwiseAND(F.lit(1)) * 2 - 1
    sums = (rows.join(reps.select("rep", "mh"), "rep").groupBy("node")
            .agg(F.count("*").alias("c"), *[F.sum(sign(i)).cast("double").alias(f"s{j}") for j, i in enumerate(at)]))
    pairs = sum((F.col(f"s{j}") * F.col(f"s{j}") for j in range(1, SIGNS)), F.col("s0") * F.col("s0")) / SIGNS
    return sums.select("node", (pairs >= ALIKE * F.col("c") * F.col("c")).alias("alike"))


def leaves(reps: DataFrame, leaf: int = LEAF, depth: int = DEPTH) -> tuple[DataFrame, DataFrame | None]:
    """(cell, rep: members of all leaf nodes of two documents or more; node, rep, c: members of the nodes cut into chunks, None without)."""
    rows, level, out, hot = _root_nodes(reps), ROOT, [], []
    while True:
        sizes = rows.groupBy("node").agg(F.count("*").alias("c")).where("c > 1")
        rows = write_out(join_back(rows, sizes, ["node"]), f"nodes_{level}")
        out.append(rows.where(F.col("c") <= leaf).select(F.col("node").alias("cell"), "rep"))
        big = rows.where(F.col("c") > leaf)
        if not has(big):
            break
        if level == depth:
            hot.append(big.select("node", "rep", "c"))
            break
        # more tokens would not part the near copies of one text
        big = join_back(big, write_out(_alike_nodes(big, reps), f"alike_{level}"), ["node"])
        hot.append(big.where("alike").select("node", "rep", "c"))
        rows = _next_nodes(big.where("NOT alike").select("node", "tree", "rep"), reps, level)
        level += 1
    if not hot:
        return _all(out), None
    hot, chunks = write_out(_all(hot), "cut_nodes"), F.ceil(F.col("c") / leaf)
    if not has(hot):
        return _all(out), None
    out.append(hot.select(F.xxhash64("node", F.pmod(F.xxhash64("rep", "node"), chunks)).alias("cell"), "rep"))
    # the least member is a pivot too: chunks of one group, in all its nodes and trees, then tie their rows to the same one
    nodes = hot.groupBy("node", "c").agg(F.min("rep").alias("p"), *_least("rep")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
    heads = F.array_distinct(F.array("p", *[f"p{i}" for i in range(PIVOTS)]))
    out.append(nodes.select("node", "i", F.explode(heads).alias("rep")).select(F.xxhash64("node", "i").alias("cell"), "rep"))
    return _all(out), hot


def _all(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _forest(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least reachable place of each of ``size`` places under the links (a, b)."""
    root = np.arange(size)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    return root


def _near(sk: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (i, j) whose sketches may reach the similarity."""
    floor = percent / 100 - ERRORS * math.sqrt(percent / 100 * (1 - percent / 100) / SKETCH)
    ok = np.concatenate([(sk[i[lo:lo + 20_000]] == sk[j[lo:lo + 20_000]]).mean(1) >= floor for lo in range(0, len(i), 20_000)] or [np.zeros(0, bool)])
    return i[ok], j[ok]


def _heads(cell: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))


def _compare_leaves(percent: int):
    """(i, j) of the possible links inside whole cells (sorted by cell)."""

    def pairs(cell, rep, n, sk):
        first = _heads(cell)
        size = np.diff(np.append(first, len(cell)))
        gap = 1
        place = np.arange(len(cell)) - np.repeat(first, size)
        left = np.repeat(size, size) - place  # members from here to the cell's end
        while True:  # pairs at distance 1, 2, ... inside a cell
            a = np.flatnonzero(left > gap)
            if not len(a):
                break
            b = a + gap
            a, b = (x[np.minimum(n[a], n[b]) * 100 >= percent * np.maximum(n[a], n[b])] for x in (a, b))
            yield _near(sk, a, b, percent)
            gap += 1

    return pairs


def _compare_rest(percent: int):
    """(i, j) of the possible links of rows of side 0 with rows of other parts. Side 1: the largest part, 2: others, which
    come on side 0 too."""

    def pairs(cell, rep, n, side, part, sk):
        for lo, hi in zip(first := _heads(cell), np.append(first[1:], len(cell))):
            a, b = lo + np.flatnonzero(side[lo:hi] == 0), lo + np.flatnonzero(side[lo:hi] > 0)
            step = max(1, 500_000 // max(1, len(b)))
            for s in range(0, len(a), step):
                x = a[s:s + step, None]
                open_ = (part[x] != part[b]) & ((side[b] == 1) | (rep[x] < rep[b]))
                open_ &= np.minimum(n[x], n[b]) * 100 >= percent * np.maximum(n[x], n[b])
                i, j = np.nonzero(open_)
                yield _near(sk, x[i, 0], b[j], percent)

    return pairs


def _forests(pairs, width: int):
    """Spanning forests over ``pairs`` of whole cells (rows: cell, rep, further columns, sk; ``width`` of them before sk).

    Rows come by cell and rep, so each row is tied to the least rep it reaches in its cell, and
    cells that hold the same group return the same links.
    """

    def links(cols):
        found = list(pairs(*cols))
        us, vs = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in ([f[0] for f in found], [f[1] for f in found]))
        root = _forest(len(cols[0]), us, vs)
        tied = np.flatnonzero(root != np.arange(len(root)))
        return _edges(cols[1][tied], cols[1][root[tied]])

    def run(batches):
        held = None
        for b in batches:
            cols = [*[np.asarray(b.column(i)) for i in range(width)], np.frombuffer(b"".join(b.column(width).to_pylist()), np.uint16).reshape(-1, SKETCH)]
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
            if not len(cols[0]):
                continue
            cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last cell may go on in the next batch
            held = [c[cut:] for c in cols]
            if cut:
                yield links([c[:cut] for c in cols])
        if held is not None:
            yield links(held)

    return run


def _edges(u, v) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(u, np.int64)), pa.array(np.asarray(v, np.int64))], ["u", "v"])


def possible_links(cells: DataFrame, reps: DataFrame, percent: int = PERCENT) -> DataFrame:
    """u, v: spanning forests over the pairs of each cell whose sketches may reach the similarity."""
    full = cells.join(reps.select("rep", "n", "sk"), "rep").select("cell", "rep", "n", "sk")
    return full.repartition("cell").sortWithinPartitions("cell", "rep").mapInArrow(_forests(_compare_leaves(percent), 3), "u long, v long")


def rest_links(hot: DataFrame, tied: DataFrame, reps: DataFrame, percent: int = PERCENT, wide: int = WIDE, parts: DataFrame | None = None) -> DataFrame | None:
    """u, v: spanning forests over the possible pairs of cut nodes (``hot``) that ``tied`` leaves apart; None without rows for them.

    Parts are the components of ``tied`` (``parts`` has them if they are known). Rows outside a node's largest part are dealt in blocks, all its rows in
    chunks, and every block meets every chunk. Nodes of the same rows are one.
    """
    parts = (components(tied) if parts is None else parts).select(F.col("node").alias("rep"), F.col("component").alias("part"))
    mine = write_out(hot.join(parts, "rep", "left").withColumn("part", F.coalesce("part", "rep")), "cut_parts")
    count = mine.groupBy("node", "part").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("rep")).alias("rows"))
    nodes = (count.groupBy("node").agg(F.max(F.struct("c", "part"))["part"].alias("main"), F.sum("c").alias("all"), F.max("c").alias("most"), F.bit_xor("rows").alias("rows"))
             .where("most < all").groupBy("all", "rows").agg(F.min(F.struct("node", "main", "most")).alias("x")).select("x.*", "all"))
    nodes = write_out(nodes.withColumn("blocks", F.ceil((F.col("all") - F.col("most")) / wide)).withColumn("chunks", F.ceil(F.col("all") / wide)), "cut_main")
    work = nodes.agg(F.sum((F.col("all") - F.col("most")) * F.col("all")).cast("double")).first()[0]
    if not work:
        return None
    some = mine.join(nodes.drop("all", "most"), "node")
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    outer = some.where("part <> main").select("node", F.pmod(F.xxhash64("rep", "node", F.lit("rest")), "blocks").alias("block"), every("chunks").alias("chunk"),
                                              "rep", F.lit(0).alias("side"), "part")
    whole = some.select("node", every("blocks").alias("block"), F.pmod(F.xxhash64("rep", "node"), "chunks").alias("chunk"),
                        "rep", F.when(F.col("part") == F.col("main"), 1).otherwise(2).alias("side"), "part")
    cells = outer.unionByName(whole).select(F.xxhash64("node", "block", "chunk").alias("cell"), "rep", "side", "part")
    full = cells.join(reps.select("rep", "n", "sk"), "rep").select("cell", "rep", "n", "side", "part", "sk")
    tasks = min(10_000, math.ceil(work / PAIRS))
    return full.repartition(tasks, "cell").sortWithinPartitions("cell", "rep").mapInArrow(_forests(_compare_rest(percent), 5), "u long, v long")


class _Sets:
    """Sets of one chunk, and exact links of one against many."""

    def __init__(self, grams: np.ndarray, at: np.ndarray, percent: int):
        self.sets = [grams[s:e] for s, e in zip(at[:-1], at[1:])]
        self.n = np.diff(at)
        self.percent = percent

    def linked(self, a: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` with 100 |a and b| >= percent |a or b|."""
        ok = np.minimum(self.n[a], self.n[others]) * 100 >= self.percent * np.maximum(self.n[a], self.n[others])
        others = others[ok]
        if not len(others):
            return others
        mine = self.sets[a]
        flat = np.concatenate([self.sets[b] for b in others])
        at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
        upto = np.concatenate([[0], np.cumsum(mine[at] == flat)])
        ends = np.cumsum(self.n[others])
        both = upto[ends] - upto[ends - self.n[others]]
        return others[100 * both >= self.percent * (self.n[a] + self.n[others] - both)]


def _confirm(k: int, percent: int, seed: int):
    def run(t: pa.Table, keys: int) -> pa.Table:
        """Breadth-first search over a family's chunk: (reached from, reached)."""
        rep, grams, at = sets_of(t, keys, lambda d, o: _sets(d, o, k, seed), _signatures)
        s = _Sets(grams, at, percent)
        rest, us, vs = np.argsort(rep, kind="stable"), [], []
        while len(rest):
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                a = queue.pop()
                found = s.linked(a, rest)
                us += [rep[a]] * len(found)
                vs += rep[found].tolist()
                queue += found.tolist()
                rest = rest[~np.isin(rest, found)]
        return pa.table([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], schema=LINKS)

    return run


def link(docs: DataFrame, k: int, percent: int = PERCENT, leaf: int = LEAF, family: int = FAMILY, depth: int = DEPTH, wide: int = WIDE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    seed = B.new_seed()
    rows = write_out(sketches(docs, k, seed), "sketches")
    reps = write_out(representatives(rows), "representatives")
    cells, hot = leaves(reps, leaf, depth)
    tied = write_out(possible_links(cells, reps, percent), "possible_links")
    families = write_out(components(tied), "families")
    rest = None if hot is None else rest_links(hot, tied, reps, percent, wide, families)
    if rest is not None and has(rest := write_out(rest, "possible_links_rest")):  # what is tied already is one edge a row here
        stars = families.select(F.col("node").alias("u"), F.col("component").alias("v"))
        families = write_out(components(stars.unionByName(rest)), "families_rest")
    comp = reps.select("sig", F.col("rep").alias("component"))
    if has(families):
        members = reps.join(families.select(F.col("node").alias("rep"), F.col("component").alias("fam")), "rep").select("fam", "rep", "sig", "n")
        links = linked(docs, members, _confirm(k, percent, seed), family, GRAMS, LEFT)
        if links is not None:
            found = components(links).select(F.col("node").alias("rep"), F.col("component").alias("least"))
            comp = reps.join(found, "rep", "left").select("sig", F.coalesce("least", "rep").alias("component"))
    kind = docs.schema["doc_id"].dataType
    out = rows.select("doc_id", "n", F.when(F.col("n") > 0, F.col("sig")).alias("sig")).join(comp, "sig", "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce(F.col("component").cast(kind), F.col("doc_id"))))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, k: int, percent: int = PERCENT) -> DataFrame:
    """Rows of ``docs`` without near copies: of each component the document with the least id stays, once."""
    verdict = link(docs, k, percent).where("kept").select(F.col("doc_id").alias("__kept_id"))
    verdict = write_out(verdict, "kept_ids")
    repeated = verdict.where("__kept_id IS NOT NULL").groupBy("__kept_id").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    cols = docs.columns
    kept = docs.join(verdict.where("__kept_id IS NOT NULL").distinct().hint("merge"), F.col("doc_id") == F.col("__kept_id")).drop("__kept_id")
    if has(repeated):
        again = repeated.select(F.col("__kept_id").alias("__again"))
        kept = (kept.join(again, F.col("doc_id") == F.col("__again"), "left_anti").select(*cols)
                .unionByName(kept.join(again, F.col("doc_id") == F.col("__again")).dropDuplicates(["doc_id"]).select(*cols)))
    nameless = docs.where("doc_id IS NULL")
    return kept.select(*cols).unionByName(nameless) if has(nameless) else kept.select(*cols)


def keep_texts(docs: DataFrame, k: int, percent: int = PERCENT) -> DataFrame:
    """``keep_one``, but rows of one doc_id with other texts are documents of their own.

    For ids that come again, a digest of id and text is the node and rows are joined by
    it, so a row goes only if its own set is linked, or if id and text are repeated.
    """
    named = docs.where("doc_id IS NOT NULL")
    again = write_out(named.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select(F.col("doc_id").alias("__again")), "repeated_ids")
    if not has(again):
        return keep_one(docs, k, percent)
    cols, nameless = docs.columns, docs.where("doc_id IS NULL")
    node = F.when(F.col("__again").isNotNull(), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id").cast("long"))
    rows = named.join(again, F.col("doc_id") == F.col("__again"), "left").withColumn("__node", node)
    names = rows.select("__node", F.col("doc_id").alias("__id")).distinct()
    found = link(rows.select(F.col("__node").alias("doc_id"), "text"), k, percent).select(F.col("doc_id").alias("__node"), "component_id").distinct()
    least = found.join(names, "__node").groupBy("component_id").agg(F.min(F.struct("__id", "__node"))["__node"].alias("__kept"))
    kept = rows.join(write_out(least.select("__kept"), "kept_ids").hint("merge"), F.col("__node") == F.col("__kept"))
    kept = (kept.where("__again IS NULL").select(*cols)
            .unionByName(kept.where("__again IS NOT NULL").dropDuplicates(["__node"]).select(*cols)))
    return kept.unionByName(nameless) if has(nameless) else kept
