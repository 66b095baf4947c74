"""Very long, null and empty texts, repeated rows and clashing names at the level of tables, for the operators whose own tests have short ones."""

import hashlib
import random
import zlib

import public_tokenizers
import pytest
import sentencepiece as library
from quire.llm import fingerprints, mixing, queries, sentencepiece, token_counts, token_output
from tokenizers import Tokenizer

CLASHING = ("part", "key", "guest", "start", "block", "ids", "n_tokens", "shard", "payload", "score", "its", "piece", "before")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeéßzq", k=rng.randint(1, 9))) for _ in range(3000)]
    long = " ".join(rng.choices(words, k=120_000))
    return [(1, long), (2, None), (3, ""), (4, "x" * 300_000), (5, "\n\t  \n" * 2000), (6, "short one"), (6, "short one"), (None, "no id"), (7, long[:400_000] + "!")]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(d, t, "s", *["z"] * len(CLASHING)) for d, t in texts], "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in CLASHING)).repartition(4)


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, *[str(x) for x in r]))


def test_token_counts(docs, texts):
    tok = Tokenizer.from_file(public_tokenizers.path(queries.JSON_TOKENIZER))
    got = [(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, public_tokenizers.path(queries.JSON_TOKENIZER)).collect()]
    want = [(d, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 2048) for d, t in texts]
    assert by_id(got) == by_id(want)


def test_token_output(docs, texts):
    tok = Tokenizer.from_file(public_tokenizers.path(queries.JSON_TOKENIZER))
    shards = token_output.write_tokens(docs, public_tokenizers.path(queries.JSON_TOKENIZER), queries.END_ID, shard_tokens=50_000)
    order = sorted(((d, t or "") for d, t in texts), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want, at = [], 0
    for d, t in order:
        ids = [*tok.encode(t, add_special_tokens=False).ids, queries.END_ID]
        want.append((d, at, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        at += len(ids)
    assert by_id([tuple(r) for r in token_output.read_tokens(shards).collect()]) == by_id(want)


def test_a_lookup_opens_few_frames(docs):
    shards = token_output.write_tokens(docs, public_tokenizers.path(queries.JSON_TOKENIZER), queries.END_ID, shard_tokens=50_000)
    file = max(shards.collect(), key=lambda r: r.n_tokens).file
    whole = token_output.shard(file).matrix.decode()
    m = token_output.shard(file).matrix
    frames = sum(len(p.frames) for p in m.planes)
    assert len(whole) > 200_000 and m.access(1234)[0] == whole[1234] and sum(p.opens for p in m.planes) == m.bits < frames
    token = int(whole[77])
    assert m.count(token) == int((whole == token).sum()) and m.rank(token, 5000) == int((whole[:5000] == token).sum())
    assert m.select(token, 3) == int((whole == token).nonzero()[0][3])


def test_sentencepiece(docs, texts):
    path = public_tokenizers.path(queries.PIECE_MODEL)
    lib = library.SentencePieceProcessor(model_file=path)
    encoded = sentencepiece.encode(docs, path)
    want = [(d, lib.encode(t or "")) for d, t in texts]
    assert by_id([(r.doc_id, r.ids) for r in encoded.collect()]) == by_id(want)
    assert by_id([(r.doc_id, r.text) for r in sentencepiece.decode(encoded, path).collect()]) == by_id([(d, lib.decode(ids)) for d, ids in want])


def test_fingerprints(docs, texts):
    order = [t or "" for _, t in sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))]
    want = sorted((len(t), hashlib.sha256(fingerprints.edited(t, order[(k + 1) % len(order)]).encode()).hexdigest()) for k, t in enumerate(order))
    assert sorted((r.n_chars, r.edited_sha256) for r in fingerprints.fingerprints(docs).collect()) == want


def test_mixing(docs, texts):
    out = mixing.mix(docs, {}, block_bytes=1 << 16).collect()
    at, want = 0, []
    for _, t in sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0)):
        want.append((at >> 16, at & 0xFFFF))
        at += len((t or "").encode()) + 1
    assert sorted((r.slot, r.seq) for r in out) == want and {r.payload for r in out} == {"z"}
