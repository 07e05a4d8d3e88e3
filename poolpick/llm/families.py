"""Exact links inside families: whole texts of the members, dealt in bounded chunks.

A family is a set of rows that may be linked (a superset of what is). Families of up to ``family`` rows
and ``grams`` n-grams are one chunk; larger ones are cut by hash into chunks that share ``PIVOTS`` rows.
Rows that this leaves outside a family's largest part are then held against all its chunks,
block by block, so no link inside a family is lost, and no chunk is unbounded.

Placement is planned on narrow rows (rep, sig, n); texts join it once, and a broadcast table of ``MARKS``
bits keeps most other texts out of that shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolpick.llm import bytekit as B
from poolpick.llm.common import has, write_out
from poolpick.llm.graph import components

MARKS, SLICES = 1 << 25, 64  # bits that tell which texts may be needed, and the pieces in which tasks send them
PIVOTS = 4


def streamed(add):
    """A grouped function over the group's batches, one held at a time."""
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from add(key, batches)

    return run


def marks(wanted: DataFrame) -> bytes:
    """A bit for the hash of every wanted rep: ``MARKS`` bits, however many there are."""
    step = MARKS // SLICES

    def mark(batches):
        bits = np.zeros(MARKS, bool)
        for b in batches:
            bits[np.asarray(b.column(0)) & (MARKS - 1)] = True
        if bits.any():
            packed = [zlib.compress(np.packbits(bits[i * step:(i + 1) * step]).tobytes(), 1) for i in range(SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES, dtype=np.int32)), pa.array(packed, pa.binary())], ["slice", "bits"])

    def unite(key, tables):
        total = np.zeros(step // 8, np.uint8)
        for t in tables:
            for packed in t.column(1).to_pylist():
                total |= np.frombuffer(zlib.decompress(packed), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["slice", "bits"])

    parts = wanted.select(F.xxhash64("rep").alias("h")).mapInArrow(mark, "slice int, bits binary")
    rows = parts.groupBy("slice").applyInArrow(streamed(unite), "slice int, bits binary").collect()
    return b"".join(zlib.decompress(r["bits"]) for r in sorted(rows))


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """rep, text of the documents whose id may be wanted: others stay out of the join's shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(marks(wanted))  # MARKS / 8 bytes

    @F.pandas_udf("boolean")
    def marked(h: pd.Series) -> pd.Series:
        at = h.to_numpy() & (MARKS - 1)
        return pd.Series((np.frombuffer(shared.value, np.uint8)[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1)

    named = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("rep"), "text")
    return named.where(marked(F.xxhash64("rep")))


def with_texts(texts: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """``members`` (rep, sig, keys, ...) with the whole text of each; rows of the id with another text drop out in the product."""
    return members.hint("merge").join(texts, "rep").select(*keys, "rep", "sig", "text")


def sets_of(t: pa.Table, keys: int, cut, signatures):
    """(reps, n-grams, offsets) of a chunk's rows (keys, rep, sig, text): rows of the id with another text drop out, repeated ones too."""
    rep, sig = np.asarray(t.column(keys).combine_chunks()), t.column(keys + 1).to_pylist()
    data, offs = B.column_bytes(t.column(keys + 2))
    grams, at, seen, who = [np.zeros(0, np.uint64)], [0], set(), []
    for lo, _, d, o in B.blocks(data, offs):
        g, a = cut(d, o)
        for x, s in enumerate(signatures(g, a)):
            if s == sig[lo + x] and (rep[lo + x], s) not in seen:
                seen.add((rep[lo + x], s))
                who.append(rep[lo + x])
                grams.append(g[a[x]:a[x + 1]])
                at.append(at[-1] + len(grams[-1]))
    return np.array(who, np.int64), np.concatenate(grams), np.array(at)


LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def linked(docs: DataFrame, members: DataFrame, kernel, family: int, grams: int, left: int) -> DataFrame | None:
    """u, v: links that join what is linked inside families (``members``: fam, rep, sig, n); None without links.

    ``kernel(table, keys)`` gets a chunk (``keys`` key columns, rep, sig, text) and returns its links, or a spanning forest of them.
    """
    least = [F.min(F.struct(F.xxhash64("sig", F.lit(i)), F.col("rep"), F.col("sig"))).alias(f"p{i}") for i in range(PIVOTS)]
    sizes = members.groupBy("fam").agg(F.count("*").alias("c"), F.sum("n").alias("w"), *least)
    sizes = sizes.withColumn("chunks", F.greatest(F.ceil(F.col("c") / family), F.ceil(F.col("w") / grams)))
    sizes = write_out(sizes, "family_sizes")
    placed = write_out(members.join(sizes.select("fam", "chunks"), "fam").withColumn("chunk", F.pmod(F.xxhash64("sig"), F.col("chunks"))), "family_members")
    texts = texts_of(docs, placed)

    def links_of(cells: DataFrame, keys: list[str]) -> DataFrame:
        return with_texts(texts, cells, keys).groupBy(*keys).applyInArrow(lambda t: kernel(t, len(keys)), "u long, v long")

    big = sizes.where("chunks > 1")
    cells, some_big = placed.select("fam", "chunk", "rep", "sig"), has(big)
    if some_big:
        heads = big.select("fam", "chunks", F.explode(F.array_distinct(F.array(*[f"p{i}" for i in range(PIVOTS)]))).alias("p"))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk")
        cells = cells.unionByName(heads.select("fam", every, F.col("p.rep").alias("rep"), F.col("p.sig").alias("sig"))).distinct()
    links = write_out(links_of(cells, ["fam", "chunk"]), "links")
    if not some_big:
        return links if has(links) else None
    found = write_out(components(links), "parts")
    parts = found.select(F.col("node").alias("rep"), F.col("component").alias("part"))
    mine = write_out(placed.where("chunks > 1").join(parts, "rep", "left").withColumn("part", F.coalesce("part", "rep")), "family_parts")
    count = mine.groupBy("fam", "part").agg(F.count("*").alias("c"))
    main = (count.groupBy("fam").agg(F.max(F.struct("c", "part"))["part"].alias("main"), F.sum("c").alias("all"), F.max("c").alias("most"))
            .where("most < all").withColumn("blocks", F.ceil((F.col("all") - F.col("most")) / left)))
    main = write_out(main.select("fam", "main", "blocks"), "family_main")
    if not has(main):
        return links
    some = mine.join(main, "fam")
    outside = (some.where("part <> main").withColumn("block", F.pmod(F.xxhash64("sig", F.lit("left")), F.col("blocks")))
               .select("fam", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), "rep", "sig"))
    all_ = some.select("fam", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "chunk", "rep", "sig")
    return links.unionByName(write_out(links_of(outside.unionByName(all_).distinct(), ["fam", "block", "chunk"]), "links_left"))
