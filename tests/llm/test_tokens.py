import functools
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quire.llm import token_counts as tc
from quire.llm import token_output as to
from quire.llm.wordcodec import codec

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = ["", " ", "a", "It's we'LL x'D  don'T\tok\n", "<|endoftext|>a<|startoftext|> b<|", "İstanbul ΑΣ σς ß é é ﬁ x y\u0085z\x0bq\x1cr", "日本語 テキスト 한국어", "😀😀 a1b22!?--", "́ x́ ‍", "a" * 3000, "-" * 900 + " b" * 50]
SCHEMA = "doc_id long, text string, source string, n_tokens string"


@functools.cache
def library(path):
    return Tokenizer.from_file(path)


def expected(path, text):
    return library(path).encode(text or "", add_special_tokens=False).ids


def test_pieces_agree_with_the_library():
    rng = random.Random(7)
    chars = "abcXYZ0189 '\"-_.,;:!?\n\t|<>é̈ßñ世😀 "
    texts = ODD + ["".join(rng.choices(chars, k=rng.randint(0, 60))) for _ in range(400)]
    ids, at = codec(WORD).ids(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [expected(WORD, t) for t in texts]
    assert codec(WORD).counts(pa.array(texts)).tolist() == np.diff(at).tolist()


@pytest.mark.parametrize("path, spans", [(WORD, tc.piece_spans), (BYTE, tc.token_spans)])
def test_chunks_are_spliced_exactly(path, spans):
    rng = random.Random(3)
    for k in range(25):
        words = ["".join(rng.choices("abcdé1'.", k=rng.choice([1, 3, 8, 300]))) for _ in range(rng.randint(1, 80))]
        text = "".join(w + rng.choice([" ", "  ", "\n"]) for w in words)
        n, chunks, _ = tc.resynchronised(text, spans(path), chunk=120, overlap=20, stable=2)
        assert n == len(expected(path, text))
    text = "x" * 5000
    assert tc.resynchronised(text, spans(path), chunk=120, overlap=20)[0] == len(expected(path, text))


def test_token_counts_rows(spark):
    rows = [(i, t, "s", "7") for i, t in enumerate([*ODD, None])] + [(None, "a b", None, None), (1, "a b", "s", "x"), (1, "a b", "s", "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens, r.over_limit) for r in tc.token_counts(docs, WORD, limit=20, chunk_chars=64, overlap_chars=8).collect())
    want = sorted((d if d is not None else -1, len((t or "").encode()), len(expected(WORD, t)), len(expected(WORD, t)) > 20) for d, t, _, _ in rows)
    assert got == want
    assert tc.token_counts(docs.limit(0), WORD).count() == 0


def test_wavelet_matrix_against_the_plain_list():
    rng = np.random.default_rng(5)
    for n, bits in ((0, 4), (1, 4), (513, 3), (3000, 16), (2000, 17)):
        ids = rng.integers(0, 1 << bits, n).astype(np.uint16 if bits <= 16 else np.uint32)
        ids[: n // 2] = 1
        shard = to.Shard(np.arange(2), np.ones(2, bool), np.array([0, n]), to.WaveletMatrix.build(ids, bits))
        m = to.Shard.from_bytes(shard.to_bytes()).matrix
        assert m.decode().tolist() == ids.tolist()
        if n:
            assert m.access(np.arange(n)).tolist() == ids.tolist()
            for token in {1, int(ids[-1]), 2}:
                where = np.flatnonzero(ids == token).tolist()
                assert m.count(token) == len(where) and m.rank(token, n // 3) == sum(x < n // 3 for x in where)
                assert [m.select(token, k) for k in range(min(20, len(where)))] == where[:20]
        assert m.count(1 << bits) == 0
    with pytest.raises(IndexError):
        m.select(3, 10**9)


def test_token_output_round_trip(spark, tmp_path):
    rows = [(i, t, "s", "7") for i, t in enumerate([*ODD, None])] + [(None, "n", None, None), (3, "tie", "s", "x"), (3, "tie", "s", "x")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    shards = to.write_tokens(docs, WORD, 2, shard_tokens=200)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    want, at = [], 0
    for d, t, _, _ in order:
        ids = np.array([*expected(WORD, t), 2], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = sorted(map(tuple, to.read_tokens(shards).collect()), key=lambda r: r[1])
    assert got == want
    own = to.write_tokens(docs, WORD, 2, shard_tokens=200, folder=str(tmp_path / "x"))
    files = sorted(r.file for r in own.collect())
    assert files == sorted(str(x) for x in (tmp_path / "x").glob("*.qwm")) and len(files) == shards.count() and to.shard(files[0]).matrix.n > 0
    assert all(open(x, "rb").read(4) == to.MAGIC for x in files)
    assert to._file_system("file:///a/b")[1] == to._file_system("file:/a/b")[1] == to._file_system("/a/b")[1] == "/a/b"
    assert to.read_tokens(to.write_tokens(docs.limit(0), WORD, 2)).count() == 0
