"""SentencePiece and byte-level ids against the libraries; ORC files read back."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from poolpick.llm import bytekit as B
from poolpick.llm import sentencepiece_codec as S
from poolpick.llm import token_output as TO
from poolpick.llm.catalog import vocabulary
from .conftest import DOCS

sp = pytest.importorskip("sentencepiece")
PIECES = ["a", "b", "the", "Z", "é", "ß", "1", "٣", " ", "  ", "    ", "\n", "\t", "\r\n", "'", "'s", "'ll", "▁", "!", "#", "_", "<s>", "中", "文", "😀", "　", "\x00", "ing",
          "tion", "́", "\x85"]


def texts(n, size=40):
    rng = random.Random(n)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randrange(size))) for _ in range(n)]


def encode(v, ts, block=1 << 20):
    data, offs = B.column_bytes(pa.array(ts, pa.string()))
    ids, back = [], []
    for lo, hi, d, o in B.blocks(data, offs, block):
        i, at = v.encode_block(d, o)
        ids += [i[s:e].tolist() for s, e in zip(at[:-1], at[1:])]
        out, to = v.decode_block(i, at)
        raw = out.tobytes()
        back += [raw[s:e].decode() for s, e in zip(to[:-1], to[1:])]
    return ids, back


def test_ids_equal_the_library_and_round_trip():
    path = vocabulary("piece_bpe_32k.model")
    lib = sp.SentencePieceProcessor(model_file=path)
    ts = texts(800) + ["", "x" * 500, " " * 300, "abc中" * 200, " the the"]
    for block in (64, 1 << 20):
        ids, back = encode(S.Vocabulary(open(path, "rb").read()), ts, block)
        assert ids == lib.encode(ts)
        assert back == [t.replace("▁", " ") for t in ts]


def test_viterbi_equals_the_library_on_a_unigram_file():
    """The pieces of the same file read as a unigram model, with scores small enough for the library's float32 sums."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(open(vocabulary("piece_bpe_32k.model"), "rb").read())
    m.trainer_spec.model_type = S.UNIGRAM
    for p in m.pieces:
        if p.type == S.NORMAL:
            p.score = max(p.score, -40000) / 4096
    proto = m.SerializeToString()
    ts = texts(600)
    ids, _ = encode(S.Vocabulary(proto), ts)
    assert ids == sp.SentencePieceProcessor(model_proto=proto).encode(ts)


def test_encode_and_decode_documents(spark, edge_docs, no_docs):
    path = vocabulary("piece_bpe_32k.model")
    coded = S.encode_documents(edge_docs, path)
    assert set(coded.columns) == set(edge_docs.columns) - {"text"} | {"ids"}
    back = S.decode_documents(coded, path)
    assert sorted(r.text for r in back.collect()) == sorted(r.text or "" for r in edge_docs.collect())
    rows = S.encode_and_check(edge_docs, path).collect()
    assert len(rows) == edge_docs.count() and all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)
    assert S.encode_documents(no_docs, path).count() == 0


def test_pieces_equal_the_library():
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    lib.encode_special_tokens = True
    ts = texts(1500) + ["", "<|endoftext|>", "it's we'll I'd 'S 'x'"]
    got = []
    for lo, hi, ids, at in TO.encode_column(pa.array(ts), path, None):
        got += [ids[s:e].tolist() for s, e in zip(at[:-1], at[1:])]
    assert got == [e.ids for e in lib.encode_batch_fast(ts, add_special_tokens=False)]


def test_orc_round_trip(spark, tmp_path, edge_docs, no_docs):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    ts = texts(500, 200)
    order = list(range(500))
    random.Random(0).shuffle(order)
    df = spark.createDataFrame([(i, ts[i], None, None, None) for i in order], DOCS).repartition(5)
    TO.write_tokens(df, str(tmp_path / "t"), path)
    stored = TO.read_tokens(spark, str(tmp_path / "t"))
    got = sorted(map(tuple, TO.document_digests(stored).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    want, start = [], 0
    for i, t in enumerate(ts):
        ids = np.array(lib.encode(t, add_special_tokens=False).ids + [0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    some = TO.read_tokens(spark, str(tmp_path / "t"), [7, 123])
    assert sorted(r.doc_id for r in some.collect()) == [7, 123]
    plan = some._jdf.queryExecution().toString()
    assert "PushedFilters: [In(doc_id" in plan
    TO.write_tokens(edge_docs, str(tmp_path / "e"), path)
    edge = TO.document_digests(TO.read_tokens(spark, str(tmp_path / "e"))).collect()
    assert len(edge) == edge_docs.count()
    spans = sorted((r.start, r.n_tokens) for r in edge)
    assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
    TO.write_tokens(no_docs, str(tmp_path / "n"), path)
    assert TO.read_tokens(spark, str(tmp_path / "n")).count() == 0


def test_bloom_filter_is_in_the_files(spark, tmp_path):
    from pyarrow import orc

    df = spark.createDataFrame([(i, "a b c", None, None, None) for i in range(100)], DOCS)
    TO.write_tokens(df, str(tmp_path / "t"), vocabulary("byte_bpe_50k.json"))
    files = list((tmp_path / "t").glob("*.orc"))
    assert files and all(orc.ORCFile(f).nstripes >= 1 for f in files)


ODD = ["<|endoftext|>", "<|endoftext", "|>", "\u1c89", "\U00010d40", "\ua7cb's", "\u0378", "one", " two", " ", "'s", "\n", "é", "中", "!", "7"]


def test_added_tokens_and_unknown_code_points_equal_the_default_library(spark, tmp_path):
    """Texts that the pieces cannot stand for: the plain call of a default tokenizer decides, in blocks and in the files."""
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    rng = random.Random(9)
    ts = ["one <|endoftext|> two", "<|endoftext|>", "", "\u1c89's", "\ua7cb'll", "a<|endoftext|><|endoftext|>'s", "one <|endof", "text|> two", "plain text"]
    ts += ["".join(rng.choice(ODD) for _ in range(rng.randrange(12))) for _ in range(600)] + ["", "<|endoftext|>"]
    want = [e.ids for e in lib.encode_batch(ts, add_special_tokens=False)]
    assert want[0] == [505, 220, 50256, 734]
    got = []
    for _, _, ids, at in TO.encode_column(pa.array(ts), path, None, added=True):
        got += [ids[s:e].tolist() for s, e in zip(at[:-1], at[1:])]
    assert got == want
    TO.write_tokens(spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(ts)], DOCS), str(tmp_path / "t"), path)
    rows = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in TO.document_digests(TO.read_tokens(spark, str(tmp_path / "t"))).collect())
    start = 0
    for (i, first, n, crc), ids in zip(rows, want):
        stored = np.array(ids + [TO.END_ID], "<u4")
        assert (first, n, crc) == (start, len(stored), zlib.crc32(stored.tobytes())), ts[i]
        start += n


def test_patterned_words_keep_their_own_ids():
    """Words that polynomial names modulo 2^64 confuse: the second one must not get the first one's ids."""
    from tokenizers import Tokenizer

    from .test_text_kernels import thue_morse

    ts = [w for n in (1024, 2048, 4096, 16384) for w in thue_morse(n)]
    path = vocabulary("byte_bpe_50k.json")
    got = [ids[s:e].tolist() for _, _, ids, at in TO.encode_column(pa.array(ts), path, None) for s, e in zip(at[:-1], at[1:])]
    assert got == [e.ids for e in Tokenizer.from_file(path).encode_batch(ts, add_special_tokens=False)]
    model = vocabulary("piece_bpe_32k.model")
    ids, back = encode(S.Vocabulary(open(model, "rb").read()), ts)
    assert back == ts and ids == sp.SentencePieceProcessor(model_file=model).encode(ts)


def test_new_pieces_reach_the_library_joined():
    enc = TO.PieceEncoder(vocabulary("byte_bpe_50k.json"))
    text = "".join(f"{gap}{word}{i}" for i in range(300) for gap, word in ((" ", "wörd"), ("\n", "line"), (" ", "42,"), ("\t", "'s")))
    sent, call = [], enc._ids
    enc._ids = lambda texts: sent.append(len(texts)) or call(texts)
    data = TO.np.frombuffer(text.encode(), TO.np.uint8)
    ids, _ = enc.encode(data, TO.np.array([0, len(data)]))
    assert ids.tolist() == enc.lib.encode(text, add_special_tokens=False).ids
    assert sum(sent) < 10  # pieces without a blank, and those of other letters, went alone before
