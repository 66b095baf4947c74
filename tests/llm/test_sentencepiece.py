import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece as library

from quire.llm import sentencepiece as sp

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIB = library.SentencePieceProcessor(model_file=PATH)
ODD = ["", " ", "  ", "a", " a", "a ", "a  b   c", "line\nline\n\n x", "\t\ttab", "▁x ▁", "é ß ﬁ ½ 日本語 한국 😀x", "<s> </s> <unk> <0x41>", "x" * 700, "▁" * 40, "aaaaaaaaaaaa bbbb", "\x00 \x01", "the  the   the    the"]


def cases():
    rng = random.Random(11)
    sets = ["abc ", "the and ion ", "éèàç ñ.,;", "0123456789 .", "\n\t a", "ab▁ ", "日本語のテ "]
    return ODD + ["".join(rng.choices(rng.choice(sets), k=rng.randint(1, 50))) for _ in range(1500)]


def test_ids_and_texts_equal_the_library():
    own, texts = sp.model(PATH), cases()
    ids, at = own.encode_batch(pa.array(texts))
    got = [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
    want = LIB.encode(texts)
    assert [(t, g, w) for t, g, w in zip(texts, got, want) if g != w] == []
    assert [own.decode(np.array(w)) for w in want] == LIB.decode(want)
    assert own.encode_batch(pa.array([], pa.string()))[1].tolist() == [0]


def test_real_texts_equal_the_library():
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].combine_chunks()
    ids, at = sp.model(PATH).encode_batch(texts)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == LIB.encode(texts.to_pylist())


def message(fields):
    out = b""
    for number, value in fields:
        if isinstance(value, float):
            out += bytes([number << 3 | 5]) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def test_unigram_model_by_viterbi(tmp_path):
    rng = random.Random(5)
    words = {"▁", "a", "b", "c", "▁a", "ab", "abc", "bc", "▁ab", "cab", "ca", "aab", "▁▁"}
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] + [(w, -rng.uniform(1, 9), 1) for w in sorted(words)]
    data = message([(1, message([(1, p.encode()), (2, s), (3, k)])) for p, s, k in pieces] + [(2, message([(3, 1), (35, 1)])), (3, message([(1, b"identity"), (2, b""), (3, 1), (4, 0)]))])
    path = tmp_path / "u.model"
    path.write_bytes(data)
    lib = library.SentencePieceProcessor(model_file=str(path))
    texts = ["".join(rng.choices("abc d", k=rng.randint(0, 30))) for _ in range(300)]
    ids, at = sp.model(str(path)).encode_batch(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == lib.encode(texts)


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        sp.PieceModel(message([(1, message([(1, b"a"), (2, 0.0)]))]))


def test_rows(spark):
    rows = [(i, t, "s", [1]) for i, t in enumerate(ODD)] + [(90, None, None, None), (None, "a b", "s", []), (1, "a b", "s", []), (1, "a b", "s", [])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, ids array<int>").repartition(3)
    out = sp.decode(sp.encode(docs, PATH), PATH).collect()
    want = [(d, LIB.decode(LIB.encode(t or "")), len(LIB.encode(t or "")), zlib.crc32(np.array(LIB.encode(t or ""), "<i4").tobytes())) for d, t, *_ in rows]
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, want))
    assert sp.decode(sp.encode(docs.limit(0), PATH), PATH).count() == 0
