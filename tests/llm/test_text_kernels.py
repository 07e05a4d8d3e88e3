"""Byte kernels and base statistics against plain Python on whole texts."""

import random
import re

import numpy as np
import pyarrow as pa

from poolpick.llm import bytekit as B
from poolpick.llm import features as X

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(n=300):
    rng = random.Random(1)
    parts = ["a", "bb", "é", "中文", " ", "  ", "\n", "\t", "\x0b", "#", "|", "word", "the", " ", "$$", "\n\n"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(n)]
    phrase = " ".join("abcdefghij")
    return out + ["", None, phrase + " " + phrase, "x " * 50, f"{phrase}\n{phrase}\n\n \n{phrase}"]


def base(t):
    w = WORD.findall(t or "")
    at = {}
    for k in range(len(w) - 7):
        at.setdefault(tuple(w[k:k + 8]), []).append(k)
    cover = {p for v in at.values() if len(v) > 1 for k in v for p in range(k, k + 8)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(cover)]


def test_base_counts_match_plain_python():
    ts = texts()
    counts, stats = X.column_features(pa.array(ts, pa.string()))
    assert counts.tolist() == [base(t) for t in ts]
    assert np.isfinite(stats).all()


def test_blocks_do_not_change_results(monkeypatch):
    ts = texts()
    one = X.column_features(pa.array(ts, pa.string()))
    data, offs = B.column_bytes(pa.array(ts, pa.string()))
    parts = [X.block_features(d, o) for _, _, d, o in B.blocks(data, offs, 50)]
    assert np.array_equal(one[0], np.concatenate([p[0] for p in parts]))
    assert np.allclose(one[1], np.concatenate([p[1] for p in parts]))


def test_shingle_sets():
    ts = ["a b c d", "A b C d", "a", "A", "", None, "a b a b a b", "b a"]
    data, offs = B.column_bytes(pa.array(ts, pa.string()))
    low = B.LOWER[data]
    w = B.words(low, offs)
    sh, at = B.shingle_sets(w, B.span_hashes(low, w.starts, w.ends), 2)
    sets = [set(sh[s:e].tolist()) for s, e in zip(at[:-1], at[1:])]
    assert [len(s) for s in sets] == [3, 3, 1, 1, 0, 0, 2, 1]
    assert sets[0] == sets[1] and sets[2] == sets[3] and sets[7] < sets[6]


def thue_morse(n, a="a", b="b"):
    """Words that polynomial names modulo 2^64 cannot tell from their complement, whatever the base."""
    out = a
    while len(out) < n:
        out += out.translate(str.maketrans(a + b, b + a))
    return out, out.translate(str.maketrans(a + b, b + a))


def test_names_tell_patterned_words_apart():
    spans = [w for n in (16, 64, 1024, 4096, 16384) for w in thue_morse(n)]
    spans += ["a" * n for n in range(1, 40)] + ["ab" * 8 + "c" * 8, "c" * 8 + "ab" * 8, "x" * 9, "x" * 8 + "\x00", ""]
    data, offs = B.column_bytes(pa.array(spans))
    names = B.span_hashes(data, offs[:-1], offs[1:])
    assert len(set(names.tolist())) == len(spans)
    assert np.array_equal(names, B.span_hashes(np.concatenate([data, data]), offs[:-1] + len(data), offs[1:] + len(data)))
    assert not np.array_equal(B.span_hashes(data, offs[:-1], offs[1:], 1), B.span_hashes(data, offs[:-1], offs[1:], 2))


def test_base_counts_of_patterned_words():
    ts = ["\n".join(thue_morse(n)) for n in (1024, 2048, 8192, 16384)]
    assert X.column_features(pa.array(ts))[0].tolist() == [base(t) for t in ts]
