"""Token ids as sorted ORC files with row indexes and Bloom filters.

``write_tokens`` encodes whole texts with the tokenizers library, appends the
end id and writes one row per document (doc_id, first id in the file, ids) in
ascending doc_id order: range partitions, sorted inside, so file order is
id order. ORC keeps the ids in run-length encoded integer streams, cut into
stripes with row indexes; doc_id has a Bloom filter, so a search for ids
skips stripes by metadata, and stripes are read in parallel.

Encoding: the library's byte-level pre-tokenizer cuts a text into pieces that
are encoded one by one, so equal pieces have equal ids. Each task cuts its
blocks with one vectorised pass (``pieces``), lets the library encode every
distinct piece once, and lays the ids out by piece. Distinct pieces
go to the library many at a time, joined at cuts that its own
pre-tokenizer makes; an id's known byte length tells where a piece ends. A
piece cache of bounded size lives as long as the Python worker. Texts that the
pieces cannot stand for go to the library whole: those that hold an
added token of the vocabulary (such as the end-of-text mark, one id), and those
with a code point that Python's Unicode tables do not know and the library's may.

Cases: a null or empty text is the end id alone; a null doc_id sorts first; rows
with one doc_id stand next to each other, ordered by text digest; an
empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import sys
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from poolpick.llm import bytekit as B
from poolpick.llm.common import arrow_batch_bytes, write_out
from poolpick.llm.piece_memo import PieceMemo

END_ID = 0
BATCH_BYTES = "4m"  # of an Arrow batch: a task also holds sort pages and a stripe
STRIPE_BYTES = str(16 << 20)
CALL_TEXTS = 64  # texts in one call of the library, whose results are large objects
JOINED = 256  # pieces joined to one of these texts
OUT = "doc_id {kind}, first long, ids array<int>"
_state: dict = {}

# character classes of the pre-tokenizer
OTHER, LETTER, NUMBER, WHITE = 0, 1, 2, 3
#: fixed values: the contractions that the byte-level pre-tokenizer cuts off
_WHITE = frozenset(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def _classes() -> np.ndarray:
    """Class of every code point, from the Unicode categories; white space as in \\s."""
    if "classes" not in _state:
        kinds = np.zeros(sys.maxunicode + 1, np.uint8)
        for cp in range(sys.maxunicode + 1):
            cat = unicodedata.category(chr(cp))[0]
            kinds[cp] = LETTER if cat == "L" else NUMBER if cat == "N" else OTHER
        kinds[[ord(c) for c in _WHITE]] = WHITE
        _state["classes"] = kinds
    return _state["classes"]


def _unknown() -> np.ndarray:
    """Whether a code point is unassigned in Python's Unicode tables."""
    if "unknown" not in _state:
        _state["unknown"] = np.array([unicodedata.category(chr(cp)) == "Cn" for cp in range(sys.maxunicode + 1)])
    return _state["unknown"]


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte place, code point) of each character of a block."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    if len(at) == len(data):
        return at, data
    return at, np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)


def holding(data: np.ndarray, offs: np.ndarray, token: bytes) -> np.ndarray:
    """Whether each text of a block holds the bytes."""
    raw, out = data.tobytes(), np.zeros(len(offs) - 1, bool)
    at = raw.find(token)
    while at >= 0:
        doc = int(np.searchsorted(offs, at, "right")) - 1
        inside = at + len(token) <= offs[doc + 1]  # else it is made by two neighbours
        out[doc] |= inside
        at = raw.find(token, int(offs[doc + 1]) if inside else at + 1)
    return out


def pieces(data: np.ndarray, offs: np.ndarray, at: np.ndarray, chars: np.ndarray) -> B.Spans:
    """Byte spans of the pre-tokenizer's pieces. ``at``, ``chars``: the block's ``code_points``.

    A piece is a contraction; a run of letters, of numbers, or of other
    marks, with one blank before it; or white space without the blank that
    the next piece takes (before another run, the last white character stands alone).
    """
    if not len(data):
        return B.Spans(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64))
    kind = _classes()[chars]
    doc_first = np.zeros(len(at) + 1, bool)
    doc_first[np.searchsorted(at, offs)] = True  # also the end of the block
    n = len(at)
    first = doc_first[:n].copy()
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    start = first | change
    blank = data[at] == 0x20
    follows = np.zeros(n, bool)  # the next character is of the same document and not white
    follows[:-1] = ~first[1:] & (kind[1:] != WHITE)
    white = kind == WHITE
    # the last white character before a run: a blank belongs to the run, another one stands alone
    last_white = white & follows
    start |= last_white
    joins = np.zeros(n, bool)
    joins[1:] = (last_white & blank)[:-1]
    start &= ~(joins & ~first)
    # contractions: an apostrophe that starts a piece (no blank before it in the piece)
    quote = np.flatnonzero((data[at] == 0x27) & start)
    if len(quote):
        doc_end = np.append(np.flatnonzero(doc_first), n)
        ends = doc_end[np.searchsorted(doc_end, quote, "right")]
        char = np.where(np.diff(np.append(at, len(data))) == 1, data[at], 0)
        nxt = lambda k: np.where(quote + k < ends, char[np.minimum(quote + k, n - 1)], 0)
        one, two = nxt(1), nxt(2)
        for c in CONTRACTIONS:
            hit = quote[(one == ord(c[1])) & ((two == ord(c[2])) if len(c) == 3 else True)]
            hit = hit[~first[np.minimum(hit + 1, n - 1)]]
            start[hit + 1] = False
            if len(c) == 3:
                start[hit + 2] = False
            after = hit + len(c)
            start[after[after < n]] = True
    starts = at[start]
    ends = np.append(starts[1:], len(data))
    return B.Spans(starts, ends, np.searchsorted(starts, offs))


class PieceEncoder:
    """Ids of texts by the tokenizers library, each distinct piece once."""

    def __init__(self, path: str):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.lib.get_added_tokens_decoder().values()]
        vocab = self.lib.get_vocab(with_added_tokens=False)
        # one character of the byte-level alphabet stands for one byte
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.width[i] = len(token)
        self.memo = PieceMemo()

    def encode_new(self, spans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, id counts) of distinct pieces.

        Pieces of a run (letters, numbers or other marks) are joined: the pre-tokenizer cuts before the blank that a piece
        begins with, and around a line end, which stands before the pieces that begin with none. White space goes alone.
        """
        texts = [s.decode("utf-8", "replace") for s in spans]
        blank = [t[0] == " " and len(t) > 1 for t in texts]
        joins = [t[b] not in _WHITE and "\ufffd" not in t for t, b in zip(texts, blank)]
        joined = [i for i, j in enumerate(joins) if j]
        lines = [texts[i] if blank[i] else "\n" + texts[i] for i in joined]
        ids = self._ids(["".join(lines[lo:lo + JOINED]) for lo in range(0, len(lines), JOINED)])[0]
        ends = np.cumsum(self.width[ids])
        size = np.array([len(spans[i]) for i in joined], np.int64)
        stop = np.cumsum(size + ~np.array([blank[i] for i in joined], bool))
        upto, since = np.searchsorted(ends, stop, "right"), np.searchsorted(ends, stop - size, "right")
        if not (np.array_equal(ends[upto - 1], stop) and np.array_equal(np.where(since, ends[since - 1], 0), stop - size)):
            raise ValueError("the vocabulary's pre-tokenizer does not cut before blanks and around line ends")
        alone = [i for i, j in enumerate(joins) if not j]
        own, counts_own = self._ids([texts[i] for i in alone])
        first, counts = np.zeros(len(spans), np.int64), np.zeros(len(spans), np.int64)
        first[joined], counts[joined] = since, upto - since
        first[alone], counts[alone] = len(ids) + np.cumsum(counts_own) - counts_own, counts_own
        done = np.cumsum(counts) - counts
        return np.concatenate([ids, own])[np.repeat(first - done, counts) + np.arange(counts.sum())], counts

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, id counts) of texts by the library, ``CALL_TEXTS`` in a call."""
        found = [np.array(e.ids, np.int32) for lo in range(0, len(texts), CALL_TEXTS)
                 for e in self.lib.encode_batch_fast(texts[lo:lo + CALL_TEXTS], add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.int32), *found]), np.array([len(x) for x in found], np.int64)

    def encode(self, data: np.ndarray, offs: np.ndarray, added: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(ids, id offsets per document) of a block, without end ids. ``added``: whether added tokens are ids or plain text."""
        place, chars = code_points(data)
        whole = np.zeros(len(offs) - 1, bool)
        if len(place) < len(data):
            whole[np.searchsorted(offs, place[_unknown()[chars]], "right") - 1] = True
        for token in self.added if added else ():
            whole |= holding(data, offs, token)
        self.lib.encode_special_tokens = not added
        if not whole.any():
            return self.encode_pieces(data, offs, place, chars)
        raw, size = data.tobytes(), np.diff(offs)
        own = [np.array(self.lib.encode(raw[offs[d]:offs[d + 1]].decode("utf-8", "replace"), add_special_tokens=False).ids, np.int32)
               for d in np.flatnonzero(whole)]
        rest = data[np.repeat(~whole, size)]
        ids, at = self.encode_pieces(rest, np.concatenate([[0], np.cumsum(np.where(whole, 0, size))]), *code_points(rest))
        counts = np.diff(at)
        counts[whole] = [len(x) for x in own]
        ids = np.insert(ids, np.repeat(at[:-1][whole], counts[whole]), np.concatenate(own))
        return ids, np.concatenate([[0], np.cumsum(counts)])

    def encode_pieces(self, data: np.ndarray, offs: np.ndarray, place: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, id offsets per document) of texts that are cut into pieces."""
        sp = pieces(data, offs, place, chars)
        names = B.span_hashes(data, sp.starts, sp.ends)
        raw = data.tobytes()
        ids, upto = self.memo.lay_out(names, lambda at: self.encode_new([raw[lo:hi] for lo, hi in zip(sp.starts[at].tolist(), sp.ends[at].tolist())]))
        return ids, upto[sp.offs]


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder for a vocabulary file (reused by later tasks)."""
    if ("encoder", path) not in _state:
        _state["encoder", path] = PieceEncoder(path)
    return _state["encoder", path]


def encode_column(column, path: str, end_id: int | None = END_ID, added: bool = False):
    """Blocks of (first row, last row, ids, offsets) of a text column, end ids appended.

    ``added`` reads the vocabulary's added tokens as their ids, which is the library's
    default and what ``write_tokens`` stores; without it they are plain text.
    """
    enc = encoder(path)
    data, offs = B.column_bytes(column)
    for lo, hi, d, o in B.blocks(data, offs):
        ids, at = enc.encode(d, o, added)
        if end_id is not None:
            ids = np.insert(ids, at[1:], end_id)
            at = at + np.arange(len(at))
        yield lo, hi, ids, at


def _writer(path: str, end_id: int):
    def run(batches):
        done = 0
        for b in batches:
            for lo, hi, ids, at in encode_column(b.column(1), path, end_id, added=True):
                out = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(at[:-1] + done), out], ["doc_id", "first", "ids"])
                done += int(at[-1])
    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID) -> None:
    """ORC files of (doc_id, first, ids), in ascending doc_id order over the files and inside them."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    ordered = (docs.select("doc_id", "text").withColumn("__digest", F.xxhash64("text"))
               .repartitionByRange("doc_id", "__digest").sortWithinPartitions("doc_id", "__digest").select("doc_id", "text"))
    with arrow_batch_bytes(docs.sparkSession, BATCH_BYTES):
        (ordered.mapInArrow(_writer(vocabulary, end_id), OUT.format(kind=kind)).write
         .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
         .option("orc.create.index", "true").option("orc.row.index.stride", "10000").option("orc.stripe.size", STRIPE_BYTES)
         .option("compression", "zlib").orc(path))


def read_tokens(spark: SparkSession, path: str, doc_ids: list | None = None) -> DataFrame:
    """The files' rows; with ``doc_ids`` the filter reaches the ORC reader (stripe statistics and Bloom filters)."""
    out = spark.read.orc(path)
    return out if doc_ids is None else out.where(F.col("doc_id").isin(doc_ids))


def _digests(batches):
    for b in batches:
        col = b.column(2)
        offs = np.asarray(col.offsets)
        raw = memoryview(np.ascontiguousarray(np.asarray(col.values), dtype="<u4")).cast("B")
        crc = [zlib.crc32(raw[4 * int(s):4 * int(e)]) for s, e in zip(offs[:-1], offs[1:])]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(offs).astype(np.int64)),
                                          pa.array(np.array(crc, np.int64)), b.column(3)], ["doc_id", "first", "n_tokens", "ids_crc32", "file"])


def document_digests(stored: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document, from the files.

    ``start`` is the document's place in its file plus the ids of all earlier
    files; one total per file is summed in file order. The files are read once: what is made of them is written out, narrow.
    """
    kind = stored.schema["doc_id"].dataType.simpleString()
    rows = stored.select("doc_id", "first", "ids", F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long").alias("file"))
    rows = write_out(rows.mapInArrow(_digests, f"doc_id {kind}, first long, n_tokens long, ids_crc32 long, file long"), "token_digests")
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = totals.withColumn("before", F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)))
    return (rows.join(before.select("file", "before"), "file")
            .select("doc_id", (F.col("first") + F.coalesce("before", F.lit(0))).alias("start"), "n_tokens", "ids_crc32"))
