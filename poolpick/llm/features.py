"""Per-document statistics from whole texts, computed on byte blocks.

Base counts: n_words, word_chars (code points inside words), n_symbols
(``[#*$%&|<>]``), n_dup_lines (lines with a word equal to an earlier line),
n_repeat_words (words in 8-word windows found twice or more in the text).
Ratios derived from them and from letter classes feed the quality
classifier and the calibrated rules. A null or empty text has all zeros.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from poolpick.llm import bytekit as B

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
STATS = ["chars_per_word", "symbol_ratio", "dup_line_ratio", "repeat_word_ratio", "upper_ratio", "digit_ratio",
         "punct_ratio", "exclaim_ratio", "pipe_ratio", "distinct_word_ratio", "short_word_ratio", "long_word_ratio",
         "words_per_line", "log_words", "sentence_end_ratio", "symbol_word_ratio"]
WINDOW = 8


def _mask(chars: str) -> np.ndarray:
    m = np.zeros(256, bool)
    m[list(chars.encode())] = True
    return m


SYMBOL = _mask("#*$%&|<>")
UPPER = _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
DIGIT = _mask("0123456789")
PUNCT = _mask("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
END = _mask(".!?")
INNER = np.zeros(256, bool)  # bytes of a code point after its first
INNER[0x80:0xC0] = True


def block_features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts, stats) with one row per document of the block."""
    n = len(offs) - 1
    w = B.words(data, offs)
    names = B.span_hashes(data, w.starts, w.ends)
    docs, nw = w.docs, w.counts
    inner = np.flatnonzero(INNER[data])
    wlen = w.ends - w.starts - (np.searchsorted(inner, w.ends) - np.searchsorted(inner, w.starts))
    total = lambda mask: B.class_counts(data, offs, mask)

    ls = B.lines(data, offs)
    wordy = np.searchsorted(w.starts, ls.ends) > np.searchsorted(w.starts, ls.starts)
    at = np.flatnonzero(wordy)
    ldocs = ls.docs[at]
    fresh = B.first_seen(ldocs, B.span_hashes(data, ls.starts[at], ls.ends[at]))
    n_lines = np.bincount(ldocs, minlength=n)
    dup_lines = np.bincount(ldocs[~fresh], minlength=n)

    rolled = B.rolling(names, WINDOW)
    left = np.repeat(w.offs[1:], nw) - np.arange(len(names))
    at = np.flatnonzero(left[:len(rolled)] >= WINDOW)
    keys = B.in_doc(docs[at], rolled[at])
    order = np.argsort(keys)
    keys = keys[order]
    same = keys[1:] == keys[:-1]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = at[order[twice]]
    cover = np.zeros(len(names) + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + WINDOW, -1)
    repeat = np.bincount(docs[np.cumsum(cover)[:-1] > 0], minlength=n)

    counts = np.stack([nw, B.per_doc(wlen, w.offs), total(SYMBOL), dup_lines, repeat], 1).astype(np.int64)
    lower = B.span_hashes(B.LOWER[data], w.starts, w.ends)
    distinct = np.bincount(docs[B.first_seen(docs, lower)], minlength=n)
    chars = np.maximum(counts[:, 1], 1).astype(float)
    nwf, nlf = np.maximum(nw, 1).astype(float), np.maximum(n_lines, 1).astype(float)
    pipe = np.zeros(256, bool)
    pipe[ord("|")] = True
    bang = np.zeros(256, bool)
    bang[ord("!")] = True
    ends_word = END[data[w.ends - 1]] if len(names) else np.zeros(0, bool)
    odd_word = SYMBOL[data[w.ends - 1]] if len(names) else np.zeros(0, bool)
    stats = np.stack([
        counts[:, 1] / nwf, counts[:, 2] / chars, dup_lines / nlf, repeat / nwf, total(UPPER) / chars,
        total(DIGIT) / chars, total(PUNCT) / chars, total(bang) / chars, total(pipe) / chars, distinct / nwf,
        B.per_doc((wlen <= 2).astype(np.int64), w.offs) / nwf, B.per_doc((wlen >= 12).astype(np.int64), w.offs) / nwf,
        nw / nlf, np.log1p(nw), B.per_doc(ends_word.astype(np.int64), w.offs) / nwf,
        B.per_doc(odd_word.astype(np.int64), w.offs) / nwf], 1)
    return counts, stats


def column_features(column) -> tuple[np.ndarray, np.ndarray]:
    data, offs = B.column_bytes(column)
    parts = [block_features(d, o) for _, _, d, o in B.blocks(data, offs)]
    if not parts:
        return np.zeros((0, len(COUNTS)), np.int64), np.zeros((0, len(STATS)))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def list_column(matrix: np.ndarray) -> pa.Array:
    """A numpy matrix as an Arrow list column, one list per row."""
    n, k = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k, dtype=np.int32) if k else np.zeros(n + 1, np.int32)),
                                    pa.array(np.ascontiguousarray(matrix).ravel()))


def matrix_of(column, width: int) -> np.ndarray:
    """The inverse of ``list_column``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).reshape(len(column), width)
