"""SentencePiece encoding and decoding in batched numpy.

A text is normalised as its model file says (identity, a blank in front,
blanks as U+2581) and cut into words before each run of blanks and round each
line feed; no piece of the vocabulary crosses such a cut. Distinct words of
equal length form one matrix and advance together: prefix sums give the hash
of any substring, hashes probe the sorted keys of the pieces, and row-wise
maxima pick the next step.

* UNIGRAM files: Viterbi. For every end position, the best sum over all
  pieces ending there; the maximum's start is the backpointer (ties: the
  longest piece).
* BPE files: their scores are merge ranks, and their encoding is
  defined by merging the best-ranked neighbours (ties: leftmost). A Viterbi search for
  the best rank sum gives other, longer encodings, so these files take the
  merge step instead: every row of the matrix merges its best pair, so all open rows
  keep the same number of symbols. Words above ``LONG`` characters use a heap.

A character without a piece becomes its UTF-8 bytes (byte fallback) or the
unknown id. Decoding gathers piece bytes and drops the blank in front.

Cases: null and empty texts encode to no ids and decode to the empty text; U+2581 in a
text reads as a blank, as in the library; repeated rows are encoded
each; an empty table gives an empty result; other columns are kept by
``encode_documents`` and ignored by the query.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from poolpick.llm import bytekit as B
from poolpick.llm.piece_memo import PieceMemo

LONG = 192
UNKNOWN_PENALTY = 10.0  # below the least score, as in the library's unigram model
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
_state: dict = {}
_P = np.uint64(0x9E3779B97F4A7C15)


def _span_keys(sums: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of code points [first, last) of each row, from the rows' prefix sums."""
    rows = np.arange(len(sums))[:, None] if first.ndim == 2 else np.arange(len(sums))
    _, inv = B._powers(sums.shape[1])
    return B.mix((sums[rows, last] - sums[rows, first]) * inv[first] + (last - first).astype(np.uint64))


def _prefix(codes: np.ndarray) -> np.ndarray:
    pw, _ = B._powers(codes.shape[1])
    sums = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * pw[:codes.shape[1]], axis=1, out=sums[:, 1:])
    return sums


def _codes(strings: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, length)


class Vocabulary:
    """Pieces of a SentencePiece model file, and the batched encoder over them."""

    def __init__(self, proto: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(proto)
        n = m.normalizer_spec
        if n.precompiled_charsmap or not n.add_dummy_prefix or n.remove_extra_whitespaces or not n.escape_whitespaces:
            raise ValueError("only identity normalisation with a blank in front is supported")
        self.kind = m.trainer_spec.model_type
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only UNIGRAM and BPE models are supported")
        self.pieces = [p.piece for p in m.pieces]
        usable = [(i, p.piece, p.score) for i, p in enumerate(m.pieces) if p.type in (NORMAL, USER)]
        if any("▁" in p.lstrip("▁") or "\n" in p for _, p, _ in usable):
            raise ValueError("pieces that cross a word cut are not supported")
        self.unknown = next(i for i, p in enumerate(m.pieces) if p.type == UNKNOWN)
        self.byte_ids = np.full(256, self.unknown, np.int32)
        self.has_bytes = m.trainer_spec.byte_fallback
        raw = [p.piece.replace("▁", " ").encode() for p in m.pieces]
        for i, p in enumerate(m.pieces):
            if p.type == BYTE:
                raw[i] = bytes([int(p.piece[3:-1], 16)])
                self.byte_ids[int(p.piece[3:-1], 16)] = i
            elif p.type == UNKNOWN:
                raw[i] = " ⁇ ".encode()
            elif p.type not in (NORMAL, USER):
                raw[i] = b""
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        keys, ids, scores = [], [], []
        by_len: dict[int, list] = {}
        for u in usable:
            by_len.setdefault(len(u[1]), []).append(u)
        for length, us in by_len.items():
            sums = _prefix(_codes([u[1] for u in us], length))
            keys.append(_span_keys(sums, np.zeros(len(us), np.int64), np.full(len(us), length)))
            ids += [u[0] for u in us]
            scores += [u[2] for u in us]
        keys = np.concatenate(keys)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(ids, np.int32)[order]
        self.scores = np.array(scores, np.float64)[order]
        self.max_len = max(by_len)
        self.least = min(scores)
        self.lookup = {u[1]: (u[2], u[0]) for u in usable}
        self.memo = PieceMemo()

    def probe(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key among the sorted piece keys, -1 if it is none."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def _score(self, sums, first, last):
        at = self.probe(_span_keys(sums, first, last))
        return np.where(at >= 0, self.scores[at], -np.inf)

    def viterbi(self, codes: np.ndarray) -> np.ndarray:
        """Piece starts (bool, one row per word) of the best segmentation."""
        w, n = codes.shape
        sums, best, back = _prefix(codes), np.full((w, n + 1), -np.inf), np.zeros((w, n + 1), np.int64)
        best[:, 0] = 0
        for end in range(1, n + 1):
            starts = np.arange(max(0, end - self.max_len), end)
            first = np.broadcast_to(starts, (w, len(starts)))
            score = self._score(sums, first, np.full_like(first, end))
            score[:, -1] = np.where(np.isinf(score[:, -1]), self.least - UNKNOWN_PENALTY, score[:, -1])
            total = best[:, starts] + score
            pick = total.argmax(1)
            best[:, end], back[:, end] = total[np.arange(w), pick], starts[pick]
        cut = np.zeros((w, n), bool)
        at, rows = np.full(w, n), np.arange(w)
        while len(rows):
            at = back[rows, at]
            cut[rows, at] = True
            rows, at = rows[at > 0], at[at > 0]
        return cut

    def merge(self, codes: np.ndarray) -> np.ndarray:
        """Piece starts of the rank-by-rank merging; each open row merges once a round."""
        w, n = codes.shape
        sums, cut = _prefix(codes), np.zeros((w, n), bool)
        bounds = np.broadcast_to(np.arange(n + 1), (w, n + 1)).copy()
        rows = np.arange(w)
        score = self._score(sums, bounds[:, :-2], bounds[:, 2:]) if n > 1 else np.zeros((w, 0))
        while len(rows):
            if score.shape[1]:
                pick = score.argmax(1)
                done = np.isneginf(score[np.arange(len(rows)), pick])
            else:
                done = np.ones(len(rows), bool)
            if done.any():
                cut[rows[done][:, None], bounds[done, :-1]] = True
                rows, bounds, score, sums = rows[~done], bounds[~done], score[~done], sums[~done]
                if not len(rows):
                    break
                pick = pick[~done]
            k, m = len(rows), score.shape[1]
            # drop bound pick + 1, and the pair score that went with it
            keep = np.ones((k, m + 2), bool)
            keep[np.arange(k), pick + 1] = False
            bounds = bounds[keep].reshape(k, m + 1)
            keep = np.ones((k, m), bool)
            keep[np.arange(k), pick] = False
            score = score[keep].reshape(k, m - 1)
            for side in (pick - 1, pick):  # the two pairs of the merged symbol
                ok = np.flatnonzero((side >= 0) & (side < m - 1))
                s = side[ok]
                score[ok, s] = self._score(sums[ok], bounds[ok, s], bounds[ok, s + 2])
        return cut

    def merge_long(self, word: str) -> list[str]:
        """The same merging of one long word by a heap over linked symbols."""
        text = list(word)
        nxt, prv = list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        heap: list = []

        def offer(a):
            b = nxt[a]
            if b < len(text) and (hit := self.lookup.get(text[a] + text[b])) is not None:
                heapq.heappush(heap, (-hit[0], a, text[a], text[b]))

        for i in range(len(text) - 1):
            offer(i)
        while heap:
            _, a, left, right = heapq.heappop(heap)
            b = nxt[a]
            if text[a] != left or b >= len(text) or text[b] != right or not left:
                continue
            text[a], text[b] = left + right, ""
            nxt[a] = nxt[b]
            if nxt[a] < len(text):
                prv[nxt[a]] = a
            offer(a)
            if prv[a] >= 0:
                offer(prv[a])
        return [t for t in text if t]

    def _word_ids(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            hit = self.lookup.get(p)
            if hit is not None:
                out.append(hit[1])
            elif self.has_bytes:
                out += self.byte_ids[list(p.encode("utf-8", "surrogatepass"))].tolist()
            else:
                out.append(self.unknown)
        return out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, id counts) of words, blanks already U+2581."""
        counts = np.zeros(len(words), np.int64)
        owner, ids, place = [], [], []
        lengths = np.array([len(x) for x in words])
        for n in np.unique(lengths):
            who = np.flatnonzero(lengths == n)
            if n > LONG and self.kind == BPE:
                for i in who:
                    one = self._word_ids(self.merge_long(words[i]))
                    owner.append(np.full(len(one), i))
                    ids.append(np.array(one, np.int32))
                    place.append(np.arange(len(one)))
                continue
            step = max(1, 400_000 // int(n))
            for lo in range(0, len(who), step):
                part = who[lo:lo + step]
                codes = _codes([words[i] for i in part], int(n))
                cut = self.viterbi(codes) if self.kind == UNIGRAM else self.merge(codes)
                row, first = np.nonzero(cut)
                last = np.append(first[1:], n)
                last[np.flatnonzero(np.diff(row))] = n
                sums = _prefix(codes)
                at = self.probe(_span_keys(sums[row], first, last))
                found = np.where(at >= 0, self.ids[at], self.unknown).astype(np.int32)
                odd = np.flatnonzero(at < 0)
                if len(odd) and self.has_bytes:  # one character without a piece: its bytes
                    raw = [chr(codes[row[o], first[o]]).encode("utf-8", "surrogatepass") for o in odd]
                    size = np.ones(len(row), np.int64)
                    size[odd] = [len(r) for r in raw]
                    row, first, found = np.repeat(row, size), np.repeat(first, size), np.repeat(found, size)
                    start = np.cumsum(size) - size
                    put = np.concatenate([start[o] + np.arange(len(r)) for o, r in zip(odd, raw)])
                    found[put] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
                owner.append(part[row])
                ids.append(found)
                place.append(np.arange(len(row)))
        if not owner:
            return np.zeros(0, np.int32), counts
        owner, ids, place = np.concatenate(owner), np.concatenate(ids), np.concatenate(place)
        order = np.lexsort((place, owner))
        return ids[order], np.bincount(owner, minlength=len(words))

    def encode_block(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets per document) of a block of texts."""
        if b"\xe2\x96\x81" in (raw := data.tobytes()):
            texts = [raw[a:b].replace(b"\xe2\x96\x81", b" ") for a, b in zip(offs[:-1], offs[1:])]
            data = np.frombuffer(b"".join(texts), np.uint8)
            offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        full = offs[:-1] < offs[1:]
        data = np.insert(data, offs[:-1][full], 0x20)
        offs = offs + np.concatenate([[0], np.cumsum(full)])
        blank, feed = data == 0x20, data == 0x0A
        start = blank.copy()
        start[1:] &= ~blank[:-1]
        start |= feed
        start[1:] |= feed[:-1]
        start[offs[:-1][full]] = True
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        names = B.span_hashes(data, starts, ends)
        raw = data.tobytes()
        make = lambda at: self.encode_words([raw[starts[w]:ends[w]].decode("utf-8", "surrogatepass").replace(" ", "▁") for w in at])
        ids, upto = self.memo.lay_out(names, make)
        return ids, upto[np.searchsorted(starts, offs)]

    def decode_block(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets per document) of decoded id lists."""
        count = np.diff(self.raw_offs)[ids]
        upto = np.concatenate([[0], np.cumsum(count)])
        out = self.raw[np.repeat(self.raw_offs[ids] - upto[:-1], count) + np.arange(upto[-1])]
        offs = upto[at]
        heads = offs[:-1][offs[:-1] < offs[1:]]
        heads = heads[out[heads] == 0x20]
        gone = np.zeros(len(out) + 1, np.int64)
        gone[heads + 1] = 1
        return np.delete(out, heads), offs - np.cumsum(gone)[offs]


def vocabulary(path: str) -> Vocabulary:
    """The worker's vocabulary of a model file (kept for later tasks)."""
    if path not in _state:
        with open(path, "rb") as f:
            _state[path] = Vocabulary(f.read())
    return _state[path]


def _list(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))


def encode_documents(docs: DataFrame, model: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """All columns but the text, and the ids of the whole text."""
    kept = [f for f in docs.schema.fields if f.name not in (text, ids)]
    schema = T.StructType([*kept, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches):
        v = vocabulary(model)
        for b in batches:
            data, offs = B.column_bytes(b.column(0))
            for lo, hi, d, o in B.blocks(data, offs):
                yield pa.RecordBatch.from_arrays([b.column(i).slice(lo, hi - lo) for i in range(1, b.num_columns)] + [_list(*v.encode_block(d, o))], schema.names)

    return docs.select(text, *[f.name for f in kept]).mapInArrow(run, schema)


def decode_documents(tokens: DataFrame, model: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """All columns but the ids, and the decoded text (bytes that are no UTF-8 become U+FFFD)."""
    kept = [f for f in tokens.schema.fields if f.name not in (text, ids)]
    schema = T.StructType([*kept, T.StructField(text, T.StringType())])

    def run(batches):
        v = vocabulary(model)
        for b in batches:
            col = b.column(0).fill_null([]) if b.column(0).null_count else b.column(0)
            offs = np.asarray(col.offsets).astype(np.int64)
            out, at = v.decode_block(np.asarray(col.values)[offs[0]:offs[-1]], offs - offs[0])
            raw = out.tobytes()
            texts = pa.array([raw[s:e].decode("utf-8", "replace") for s, e in zip(at[:-1], at[1:])], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(1, b.num_columns)] + [texts], schema.names)

    return tokens.select(ids, *[f.name for f in kept]).mapInArrow(run, schema)


def encode_and_check(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip: the decoded ids are the text, blanks for U+2581."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        v = vocabulary(model)
        for b in batches:
            data, offs = B.column_bytes(b.column(1))
            for lo, hi, d, o in B.blocks(data, offs):
                ids, at = v.encode_block(d, o)
                out, to = v.decode_block(ids, at)
                raw, src = out.tobytes(), d.tobytes()
                if len(out) == len(d) and np.array_equal(to, o) and raw == src:
                    ok = np.ones(hi - lo, bool)
                else:
                    ok = np.array([raw[a:e] == src[s:t].replace(b"\xe2\x96\x81", b" ") for a, e, s, t in zip(to[:-1], to[1:], o[:-1], o[1:])], bool)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(np.diff(at).astype(np.int64)), _list(ids, at), pa.array(ok)],
                                                 ["doc_id", "n_tokens", "ids", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids array<int>, round_trip boolean")
