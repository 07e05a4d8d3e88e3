"""Vectorised text kernels on the byte buffers of Arrow string columns.

A column is walked in blocks of whole documents of about ``BLOCK_BYTES``,
so a task's memory follows the block (or its longest document), not the
batch. Words are maximal runs of bytes outside ``\\x20\\x09-\\x0D``; that class is
ASCII, so cutting UTF-8 at byte level is exact. Words and lines are named
by keyed 64-bit hashes of their 8-byte chunks (``span_hashes``).
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_pw = {"n": 0, "p": None, "i": None}
_OWN_SEED = int.from_bytes(os.urandom(7), "little")
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(n: int):
    """P^0..P^n and its inverses modulo 2^64, grown when a longer block comes."""
    if _pw["n"] < n + 1:
        size = 1 << (n + 1).bit_length()
        with np.errstate(over="ignore"):
            for key, base in (("p", _P), ("i", _P_INV)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _pw[key] = np.multiply.accumulate(steps)
        _pw["n"] = size
    return _pw["p"], _pw["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offs


def blocks(data: np.ndarray, offs: np.ndarray, limit: int = BLOCK_BYTES):
    """(first, last, bytes, offsets) of runs of whole documents of about ``limit`` bytes."""
    first, n = 0, len(offs) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + limit, "right")) - 1)
        last = min(last, n)
        yield first, last, data[offs[first]:offs[last]], offs[first:last + 1] - offs[first]
        first = last


@dataclass
class Spans:
    """Cut pieces of a block: byte spans and, per document, the slice of pieces."""

    starts: np.ndarray
    ends: np.ndarray
    offs: np.ndarray  # piece offsets per document

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offs)

    @property
    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offs) - 1), self.counts)


def words(data: np.ndarray, offs: np.ndarray) -> Spans:
    isw = ~SPACE[data]
    before = np.zeros(len(data), bool)
    before[1:] = isw[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = isw[1:]
    full = offs[:-1] < offs[1:]
    before[offs[:-1][full]] = False
    after[offs[1:][full] - 1] = False
    starts = np.flatnonzero(isw & ~before)
    ends = np.flatnonzero(isw & ~after) + 1
    return Spans(starts, ends, np.searchsorted(starts, offs))


def lines(data: np.ndarray, offs: np.ndarray) -> Spans:
    """\\n-split lines; an empty text is one empty line."""
    cut = np.flatnonzero(data == 10)
    per_doc = np.searchsorted(cut, offs)
    counts = np.diff(per_doc) + 1
    loffs = np.concatenate([[0], np.cumsum(counts)])
    starts = np.empty(loffs[-1], np.int64)
    ends = np.empty(loffs[-1], np.int64)
    heads = np.zeros(loffs[-1], bool)
    heads[loffs[:-1]] = True
    tails = np.zeros(loffs[-1], bool)
    tails[loffs[1:] - 1] = True
    starts[heads], starts[~heads] = offs[:-1], cut + 1
    ends[tails], ends[~tails] = offs[1:], cut
    return Spans(starts, ends, loffs)


def new_seed() -> int:
    """A key for names that tasks of one run share: draw it on the driver."""
    return int.from_bytes(os.urandom(7), "little")


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int | None = None) -> np.ndarray:
    """64-bit names of byte spans: equal bytes, equal name.

    The sum of a span's 8-byte chunks, each mixed under a key of its place, mixed with the length.
    Mixing is not linear and the keys are secret (``seed``; without one, the
    process's own), so no pattern of letters makes names collide, and nobody can prepare texts that do.
    """
    key = np.uint64(_OWN_SEED if seed is None else seed)
    size = ends - starts
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:len(data)] = data
    chunk = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the 8 bytes from every place
    with np.errstate(over="ignore"):
        out = mix((chunk[starts] & _LOW_BYTES[np.minimum(size, 8)]) ^ key)
        long = np.flatnonzero(size > 8)
        if len(long):
            more = (size[long] - 1) >> 3
            upto = np.cumsum(more) - more
            place = np.arange(more.sum()) - np.repeat(upto, more) + 1
            left = np.repeat(size[long], more) - 8 * place
            w = chunk[np.repeat(starts[long], more) + 8 * place] & _LOW_BYTES[np.minimum(left, 8)]
            w ^= mix(place.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) + key)
            out[long] += np.add.reduceat(mix(w), upto)
        return mix(out ^ (size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + key))


def in_doc(docs: np.ndarray, names: np.ndarray) -> np.ndarray:
    """One 64-bit key for (document, name)."""
    return mix(names + docs.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def first_seen(docs: np.ndarray, names: np.ndarray) -> np.ndarray:
    """True where (doc, name) comes for the first time in order."""
    keys = in_doc(docs, names)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.ones(len(order), bool)
    new[1:] = keys[1:] != keys[:-1]
    out = np.zeros(len(order), bool)
    out[order[new]] = True  # the sort is stable: the group head is the earliest
    return out


def class_counts(data: np.ndarray, offs: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Bytes of a class per document."""
    return np.diff(np.searchsorted(np.flatnonzero(mask[data]), offs))


def per_doc(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of values per document slice (zero for empty slices)."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return sums[offs[1:]] - sums[offs[:-1]]


def rolling(names: np.ndarray, k: int) -> np.ndarray:
    """Names of k successive pieces, for every start (callers keep those inside a document)."""
    n = len(names) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(_P) + names[j:j + n]
    return mix(out)


def shingle_sets(spans: Spans, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingles, offsets per document); a text of 1 to k-1 words is one shingle."""
    counts, docs = spans.counts, spans.docs
    left = np.repeat(spans.offs[1:], counts) - np.arange(len(names))  # words from here to the end
    rolled = rolling(names, k)
    at = np.flatnonzero(left[:len(rolled)] >= k)
    sh, of = rolled[at], docs[at]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = counts[short] > j
            pos = np.minimum(spans.offs[:-1][short] + j, max(len(names) - 1, 0))
            whole = np.where(has, whole * np.uint64(_P) + names[pos] + np.uint64(j + 1), whole)
        sh, of = np.concatenate([sh, mix(whole)]), np.concatenate([of, short])
    order = np.lexsort((sh, of))
    sh, of = sh[order], of[order]
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (of[1:] != of[:-1])
    sh, of = sh[new], of[new]
    return sh, np.searchsorted(of, np.arange(len(counts) + 1))
