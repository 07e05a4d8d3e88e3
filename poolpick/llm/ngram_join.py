"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Rows of the matrix are distinct sets of word n-grams (equal sets are one row, whose document is the
least doc_id), columns are n-grams. Two rows of sizes a and b are linked if their overlap reaches
need(a, b) = ceil(P (a + b) / (100 + P)), so sizes must stand P : 100 and the symmetric
difference is at most a + b - 2 need(a, b).

1. **Order of columns.** All documents add their n-grams to 2^20 counters (a fixed table
   of one byte each, which is broadcast). Columns are ordered by counter,
   then name: rare n-grams first. The order decides the work, never the result.
2. **Candidate columns.** A linked pair shares a column among the first
   n - ceil(P n / 100) + 1 of either row. Only those entries are dealt by column; entries
   without another row of fitting size in their column are dropped there.
3. **Bounds.** Pairs inside a column are held against size bounds: the sizes, the entries left
   in both rows behind the column (at the first shared column nothing was shared before), and
   parity bits of the sets (every n-gram flips one bit, so differing bits never exceed the
   symmetric difference). Each bound holds for every linked pair, so nothing is lost. Columns
   of more than ``CELL`` rows are blocks in order of size, and only
   blocks whose sizes fit meet. A task returns a spanning forest of the pairs that remain, never the pairs.
4. **Product.** The forests' components are families. A family's texts are cut up again, and
   overlaps are accumulated over blocks of columns (columns with the same rows are one,
   weighted; a broadcast table of 2^25 bits keeps most other texts out of the shuffle); a row whose pairs all fell below their bounds leaves before the next block. Families
   above ``FAMILY`` rows are chunks that share pivots; rows that this leaves outside a
   family's largest part are then multiplied with all its chunks, block by block.
5. Components of the linked pairs give the result.

Cases: a text with fewer words than an n-gram is one n-gram; without words, or null, the
set is empty and linked with nothing; rows of one doc_id count as one node, whose links join;
a null doc_id has no component; copies of a row share one; an empty table gives an empty
result; further columns are ignored; a doc_id that is no integer fails with a message.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolpick.llm import bytekit as B
from poolpick.llm.common import has, write_out
from poolpick.llm.families import LINKS, linked, sets_of, streamed
from poolpick.llm.graph import components

K, PERCENT = 3, 90
COUNTERS, SLICES = 1 << 20, 64
CELL = 1024                         # rows of one block of a column
FAMILY, GRAMS = 128, 2_000_000      # rows and n-grams of one product
LEFT = 64
LEAST_BITS, MOST_BITS = 64, 8192    # parity bits of a set: about half its size


def need(a, b, percent: int):
    """Least overlap of linked sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


def sets(data: np.ndarray, offs: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct n-grams by document, offsets)."""
    low = B.LOWER[data]
    w = B.words(low, offs)
    return B.shingle_sets(w, B.span_hashes(low, w.starts, w.ends, seed), k)


def signatures(grams: np.ndarray, at: np.ndarray) -> list[bytes]:
    """16 bytes that name a set."""
    out = np.empty((len(at) - 1, 2), np.uint64)
    for i, salt in enumerate((0x2545F4914F6CDD1D, 0x9E6C63D0876A9A35)):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(B.mix(grams ^ np.uint64(salt)), dtype=np.uint64)])
        out[:, i] = sums[at[1:]] - sums[at[:-1]]
    raw = out.tobytes()
    return [raw[i:i + 16] for i in range(0, len(raw), 16)]


# ------------------------------------------------------------------ order of columns


def column_levels(docs: DataFrame, k: int, seed: int) -> np.ndarray:
    """For every counter, the eighth-octave of its n-grams' count over all documents."""
    step = COUNTERS // SLICES

    def count(batches):
        total = np.zeros(COUNTERS, np.int64)
        for b in batches:
            data, offs = B.column_bytes(b.column(0))
            for _, _, d, o in B.blocks(data, offs):
                grams, _ = sets(d, o, k, seed)
                total += np.bincount((grams >> np.uint64(44)).astype(np.int64), minlength=COUNTERS)
        if total.any():
            packed = [zlib.compress(total[i * step:(i + 1) * step].astype(np.uint32).tobytes(), 1) for i in range(SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES, dtype=np.int32)), pa.array(packed, pa.binary())], ["slice", "counts"])

    def add(key, tables):
        total = np.zeros(step, np.int64)
        for t in tables:
            for packed in t.column(1).to_pylist():
                total += np.frombuffer(zlib.decompress(packed), np.uint32)
        level = np.ceil(8 * np.log2(np.maximum(total, 1))).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["slice", "levels"])

    parts = docs.select("text").mapInArrow(count, "slice int, counts binary")
    rows = parts.groupBy("slice").applyInArrow(streamed(add), "slice int, levels binary").collect()
    out = np.zeros(COUNTERS, np.uint8)
    for r in rows:
        out[r["slice"] * step:(r["slice"] + 1) * step] = np.frombuffer(r["levels"], np.uint8)
    return out


# ------------------------------------------------------------------ rows and their candidate entries


def _level(n: np.ndarray) -> np.ndarray:
    """log2 of the parity bits for sets of n n-grams."""
    return np.clip(np.ceil(np.log2(np.maximum(n, 2) / 2)), np.log2(LEAST_BITS), np.log2(MOST_BITS)).astype(np.int64)


def parity_bits(grams: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Per set: bit i is the parity of its n-grams with hash i, of 2^_level(n) bits."""
    n = np.diff(at)
    level = _level(n)
    place = B.mix(grams ^ np.uint64(0x6A09E667F3BCC909)) & np.repeat((1 << level) - 1, n).astype(np.uint64)
    first = np.cumsum(1 << level) - (1 << level)
    bits = np.bincount(np.repeat(first, n) + place.astype(np.int64), minlength=int((1 << level).sum())) & 1
    raw = np.packbits(bits.astype(np.uint8)).tobytes()
    return [raw[f // 8:(f + (1 << lv)) // 8] for f, lv in zip(first.tolist(), level.tolist())]


def rows_of(docs: DataFrame, levels: np.ndarray, k: int, percent: int, seed: int) -> DataFrame:
    """doc_id, n, sig, bits, head (the candidate n-grams in column order) of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(levels.tobytes())  # COUNTERS bytes

    def run(batches):
        level = np.frombuffer(shared.value, np.uint8)
        for b in batches:
            data, offs = B.column_bytes(b.column(1))
            for lo, hi, d, o in B.blocks(data, offs):
                grams, at = sets(d, o, k, seed)
                n = np.diff(at)
                order = np.lexsort((grams, level[(grams >> np.uint64(44)).astype(np.int64)], np.repeat(np.arange(len(n)), n)))
                size = np.where(n > 0, n + -percent * n // 100 + 1, 0)  # n - ceil(P n / 100) + 1
                held = np.arange(len(grams)) - np.repeat(at[:-1], n) < np.repeat(size, n)
                raw, ends = grams[order][held].tobytes(), 8 * np.cumsum(size)
                heads = [raw[e - 8 * s:e] for e, s in zip(ends.tolist(), size.tolist())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(n.astype(np.int32)), pa.array(signatures(grams, at), pa.binary()),
                                                  pa.array(parity_bits(grams, at), pa.binary()), pa.array(heads, pa.binary())], ["doc_id", "n", "sig", "bits", "head"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n int, sig binary, bits binary, head binary")


def _entries(reps: DataFrame) -> DataFrame:
    """gram, key, n, pos: candidate entries."""

    def run(batches):
        for b in batches:
            heads, n = b.column(2).to_pylist(), np.asarray(b.column(1))
            key = np.asarray(b.column(0))
            for lo in range(0, len(heads), 500):
                part = heads[lo:lo + 500]
                size = np.array([len(h) // 8 for h in part])
                gram = np.frombuffer(b"".join(part), np.int64)
                pos = np.arange(len(gram)) - np.repeat(np.cumsum(size) - size, size)
                for a in range(0, len(gram), 100_000):
                    s = slice(a, a + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(gram[s]), pa.array(np.repeat(key[lo:lo + 500], size)[s]), pa.array(np.repeat(n[lo:lo + 500], size)[s]),
                                                      pa.array(pos[s].astype(np.int32))], ["gram", "key", "n", "pos"])

    return reps.select("key", "n", "head").mapInArrow(run, "gram long, key long, n int, pos int")


def _columns(entries: DataFrame, percent: int, cell: int) -> DataFrame:
    """gram, key, n, pos, block, low: entries with another row of fitting size in their column.

    Rows of a column come in order of size. ``block`` counts them off by ``cell``; ``low`` is the first
    block that may hold a row of fitting size.
    """

    def run(batches):
        held = None  # the last entry: whether it stays is known with the next one
        gram, count, tops = None, 0, []
        for b in batches:
            if not b.num_rows:
                continue
            g, r, n, p = (np.asarray(b.column(i)) for i in range(4))
            if held is not None:
                g, r, n, p = (np.concatenate([[h], c]) for h, c in zip(held[0], (g, r, n, p)))
            fits = (g[1:] == g[:-1]) & (100 * n[:-1].astype(np.int64) >= percent * n[1:].astype(np.int64))
            stays = np.zeros(len(g), bool)
            stays[1:] |= fits
            stays[:-1] |= fits
            stays[0] |= held is not None and held[1]
            held = ([g[-1], r[-1], n[-1], p[-1]], bool(stays[-1]))
            at = np.flatnonzero(stays[:-1])
            if len(at):
                out, gram, count, tops = _numbered(g[at], n[at], gram, count, tops, percent, cell)
                yield _column_rows(g[at], r[at], n[at], p[at], *out)
        if held is not None and held[1]:
            g, r, n, p = (np.array([x]) for x in held[0])
            out, *_ = _numbered(g, n, gram, count, tops, percent, cell)
            yield _column_rows(g, r, n, p, *out)

    dealt = entries.repartition("gram").sortWithinPartitions("gram", "n", "key")
    return dealt.mapInArrow(run, "gram long, key long, n int, pos int, block int, low int")


def _column_rows(g, r, n, p, block, low) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(g.astype(np.int64)), pa.array(r.astype(np.int64)), *[pa.array(x.astype(np.int32)) for x in (n, p, block, low)]],
                                      ["gram", "key", "n", "pos", "block", "low"])


def _numbered(g, n, gram, count, tops, percent, cell):
    """((block, low), last gram, its entries so far, the largest size in each of its full blocks)."""
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    size = np.diff(np.append(first, len(g)))
    place = np.arange(len(g)) - np.repeat(first, size)
    if g[0] == gram:
        place[:size[0]] += count
    else:
        tops = []
    block, low = place // cell, place // cell
    large = np.flatnonzero(place[first + size - 1] >= cell - 1)  # columns that fill a block
    for x in large.tolist():
        mine = slice(first[x], first[x] + size[x])
        full = np.flatnonzero(place[mine] % cell == cell - 1)
        known = (tops if x == 0 else []) + n[mine][full].tolist()
        low[mine] = np.minimum(np.searchsorted(100 * np.array(known, np.int64), percent * n[mine].astype(np.int64)), block[mine])
        tops = known
    return (block, low), g[-1], int(place[-1]) + 1, tops if len(large) and large[-1] == len(first) - 1 else []


# ------------------------------------------------------------------ pairs of a column, held against the bounds


class _Parity:
    """Parity bits of rows, in every length that a row can be asked for."""

    def __init__(self, bits: list[bytes]):
        size = np.array([len(x) for x in bits])
        self.level = np.log2(size).astype(np.int64)
        self.at: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for lv in np.unique(self.level):
            mine = np.flatnonzero(self.level == lv)
            own = np.frombuffer(b"".join(bits[i] for i in mine), np.uint64).reshape(len(mine), -1)
            self._put(int(lv), mine, own)
            while (lv := lv - 1) >= 3:  # halves folded: the parity under one bit less
                own = own[:, :own.shape[1] // 2] ^ own[:, own.shape[1] // 2:]
                self._put(int(lv), mine, own)

    def _put(self, lv, mine, own):
        where, rows = self.at.get(lv, (np.full(len(self.level), -1), np.zeros((0, own.shape[1]), np.uint64)))
        where[mine] = len(rows) + np.arange(len(mine))
        self.at[lv] = where, np.concatenate([rows, own])

    def differing(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        level = np.minimum(self.level[i], self.level[j])
        for lv in np.unique(level):
            mine = np.flatnonzero(level == lv)
            where, rows = self.at[int(lv)]
            for lo in range(0, len(mine), 50_000):
                part = mine[lo:lo + 50_000]
                out[part] = np.bitwise_count(rows[where[i[part]]] ^ rows[where[j[part]]]).sum(1)
        return out


def forest(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least place reachable from each of ``size`` places by the links (a, b)."""
    root = np.arange(size)
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(up := root[root], root):
            root = up
    return root


def possible(cell, side, key, n, pos, parity: _Parity, percent: int):
    """(i, j) of the pairs inside a cell that no bound excludes. Cells with both sides: only pairs across them."""
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    size = np.diff(np.append(first, len(cell)))
    left = np.repeat(size, size) - (np.arange(len(cell)) - np.repeat(first, size))
    both = np.repeat(np.maximum.reduceat(side, first) != np.minimum.reduceat(side, first), size)
    us, vs, gap = [], [], 1
    alive = np.flatnonzero(left > gap)
    while len(alive):
        i, j = alive, alive + gap
        a, b = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        least = need(a, b, percent)
        ok = (100 * a >= percent * b) & (1 + np.minimum(n[i] - pos[i], n[j] - pos[j]) - 1 >= least) & (~both[i] | (side[i] != side[j])) & (key[i] != key[j])
        i, j, most = i[ok], j[ok], (a + b - 2 * least)[ok]
        near = parity.differing(i, j) <= most
        us.append(i[near])
        vs.append(j[near])
        gap += 1
        alive = alive[left[alive] > gap]
    return (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs))


def possible_links(cells: DataFrame, percent: int) -> DataFrame:
    """u, v: spanning forests of the possible pairs (cells: cell, side, key, n, pos, bits; dealt and sorted by cell here)."""

    def links(cols, bits):
        cell, side, key, n, pos = cols
        i, j = possible(cell, side, key, n.astype(np.int64), pos.astype(np.int64), _Parity(bits), percent)
        names, at = np.unique(key, return_inverse=True)
        root = forest(len(names), at[i], at[j])
        tied = np.flatnonzero(root != np.arange(len(names)))
        return pa.RecordBatch.from_arrays([pa.array(names[tied].astype(np.int64)), pa.array(names[root[tied]].astype(np.int64))], ["u", "v"])

    def run(batches):
        held, bits = None, []
        for b in batches:
            if not b.num_rows:
                continue
            cols = [np.asarray(b.column(i)) for i in range(5)]
            bits = bits + b.column(5).to_pylist()
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
            cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last cell may go on in the next batch
            if cut:
                yield links([c[:cut] for c in cols], bits[:cut])
            held, bits = [c[cut:] for c in cols], bits[cut:]
        if held is not None:
            yield links(held, bits)

    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "u long, v long")


def _cells(columns: DataFrame, reps: DataFrame) -> DataFrame:
    """cell, side, key, n, pos, bits: the blocks of every column, and the pairs of blocks of large ones."""
    own = columns.select(F.xxhash64("gram", "block", "block").alias("cell"), F.lit(0).alias("side"), "key", "n", "pos")
    large = columns.where("low < block")
    if has(large):
        right = large.select("gram", "key", "n", "pos", "block", F.explode(F.sequence("low", F.col("block") - 1)).alias("other"))
        pairs = right.select("gram", "other", "block").distinct().withColumnRenamed("block", "later")
        left = columns.join(pairs.withColumnRenamed("other", "block"), ["gram", "block"])
        own = (own.unionByName(right.select(F.xxhash64("gram", "other", "block").alias("cell"), F.lit(1).alias("side"), "key", "n", "pos"))
               .unionByName(left.select(F.xxhash64("gram", "block", "later").alias("cell"), F.lit(0).alias("side"), "key", "n", "pos")))
    return own.join(reps.select("key", "bits"), "key").select("cell", "side", "key", "n", "pos", "bits")


# ------------------------------------------------------------------ the product


def product(grams: np.ndarray, at: np.ndarray, percent: int, columns: int = 16_384) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), i < j: all linked pairs of the rows, by overlaps accumulated over blocks of columns."""
    m, n = len(at) - 1, np.diff(at).astype(np.int64)
    a, b = np.minimum(n[:, None], n[None]), np.maximum(n[:, None], n[None])
    least = need(a, b, percent)
    open_ = (100 * a >= percent * b) & (a > 0)
    open_ &= np.triu(np.ones((m, m), bool), 1)
    over = np.zeros((m, m), np.int64)
    row = np.repeat(np.arange(m), n)
    order = np.argsort(grams, kind="stable")
    g, row = grams[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    df = np.diff(np.append(first, len(g)))
    keep = np.repeat(df > 1, df)
    row, df = row[keep], df[df > 1]
    if not len(df):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # columns with the same rows are one column of that weight
    key = B.mix(np.arange(1, m + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))
    starts = np.cumsum(df) - df
    _, pick, weight = np.unique(np.add.reduceat(key[row], starts), return_index=True, return_counts=True)
    heavy = np.argsort(-weight, kind="stable")  # heavy columns first: bounds fall sooner
    pick, weight = pick[heavy], weight[heavy]
    left = np.zeros(m, np.int64)  # entries of each row in columns to come
    size = df[pick]
    entry = np.repeat(starts[pick] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    entries, of = row[entry], np.repeat(np.arange(len(pick)), size)
    np.add.at(left, entries, weight[of])
    for lo in range(0, len(pick), columns):
        hi = min(lo + columns, len(pick))
        alive = np.flatnonzero(open_.any(0) | open_.any(1))
        if not len(alive):
            break
        s = slice(*np.searchsorted(of, [lo, hi]))
        place = np.full(m, -1)
        place[alive] = np.arange(len(alive))
        mine = place[entries[s]] >= 0
        block = np.zeros((len(alive), hi - lo), np.float32)
        block[place[entries[s]][mine], of[s][mine] - lo] = 1
        over[np.ix_(alive, alive)] += np.rint((block * weight[lo:hi].astype(np.float32)).astype(np.float64) @ block.T.astype(np.float64)).astype(np.int64)
        np.subtract.at(left, entries[s], weight[of[s]])
        open_ &= over + np.minimum(left[:, None], left[None]) >= least
    return np.nonzero(open_ & (over >= least))


def _multiply(k: int, percent: int, seed: int):
    """Spanning forest of the linked pairs of a chunk of a family."""

    def run(t: pa.Table, keys: int) -> pa.Table:
        who, grams, at = sets_of(t, keys, lambda d, o: sets(d, o, k, seed), signatures)
        if len(who) < 2:
            return LINKS.empty_table()
        i, j = product(grams, at, percent)
        names, place = np.unique(who, return_inverse=True)
        root = forest(len(names), place[i], place[j])
        tied = np.flatnonzero(root != np.arange(len(names)))
        return pa.table([pa.array(names[tied]), pa.array(names[root[tied]])], schema=LINKS)

    return run


def _same_id(rows: DataFrame, reps: DataFrame) -> DataFrame | None:
    """u, v: ties between the sets of a doc_id that comes with several texts."""
    again = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("sig").alias("a"), F.max("sig").alias("b")).where("a <> b")
    again = write_out(again.select("doc_id"), "repeated_ids")
    if not has(again):
        return None
    return rows.join(again, "doc_id").join(reps.select("sig", "rep"), "sig").select(F.col("doc_id").cast("long").alias("u"), F.col("rep").alias("v")).distinct()


def join(docs: DataFrame, k: int = K, percent: int = PERCENT, cell: int = CELL, family: int = FAMILY) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType
    if kind.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"doc_id must be an integer, not {kind.simpleString()}")
    seed = B.new_seed()
    rows = write_out(rows_of(docs, column_levels(docs, k, seed), k, percent, seed), "rows")
    reps = write_out(rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("sig")
                     .agg(F.min("doc_id").cast("long").alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("head").alias("head"))
                     .withColumn("key", F.xxhash64("sig")), "reps")
    columns = write_out(_columns(_entries(reps), percent, cell), "columns")
    edges = write_out(possible_links(_cells(columns, reps), percent), "possible_links")
    found = _same_id(rows, reps)
    if has(edges):
        families = write_out(components(edges), "families")
        members = reps.join(families.select(F.col("node").alias("key"), F.col("component").alias("fam")), "key").select("fam", "rep", "sig", "n")
        links = linked(docs, members, _multiply(k, percent, seed), family, GRAMS, LEFT)
        found = links if found is None else found if links is None else found.unionByName(links)
    comp = reps.select("sig", F.col("rep").alias("component"))
    if found is not None:
        parts = components(found).select(F.col("node").alias("rep"), F.col("component").alias("least"))
        comp = reps.join(parts, "rep", "left").select("sig", F.coalesce("least", "rep").alias("component"))
    out = rows.select("doc_id", "n", F.when(F.col("n") > 0, F.col("sig")).alias("sig")).join(comp, "sig", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"),
                      F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce(F.col("component").cast(kind), F.col("doc_id"))).alias("component_id"))
