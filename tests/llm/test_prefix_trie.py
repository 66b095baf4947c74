import hashlib
import random
import zlib

import numpy as np
import pytest

from quire.llm import prefix_trie

COLS = "conv_id long, turn long, role string, text string"


def ordered(rows):
    """conv_id to its (role, text), as the docstring orders turns."""
    out = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            pair = (role or "", text or "")
            digest = hashlib.sha256(f"{len(pair[0])}:{pair[0]}{pair[1]}".encode()).digest()
            out.setdefault(conv, []).append((turn is not None, turn or 0, pair[0], digest, pair))
    return {c: [x[-1] for x in sorted(t)] for c, t in out.items()}


def spliced(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + own[h:]
    return out


def plain(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, own in members.items():
        below = [n for n in members if n[: len(node)] == node]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[:-1] == n for m in members)]
        ends = sorted(c for c in own if len(convs[c]) == len(node))
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n)
        children = sum(len(m) == len(node) + 1 for m in below)
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), children, len(leaves), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def made(seed, n, ids):
    rng, rows = random.Random(seed), []
    for c in ids:
        for k in range(rng.choice([1, 1, 2, 3, 5, 7])):
            rows.append((c, k, rng.choice("ua"), "hot" if k == 0 and rng.random() < 0.5 else rng.choice(["x", "yy", "é", ""])))
    return rows


ODD = [(100, None, None, None), (100, None, "", ""), (100, 2, "u", "a"), (101, 0, "u", "b"), (101, 0, "u", "a"), (101, 0, "u", "a"), (None, 1, "u", "a"), (250, 3, "1:", "x"), (251, 3, "1", ":x"), (199, -5, "u", "z" * 200_000), (199, 1, "u", "a")]


def test_odd_rows_and_spliced_beginnings(spark):
    rows = ODD + made(1, 5, range(200, 240))
    got = found(prefix_trie.trie(prefix_trie.spliced(prefix_trie.contents(spark.createDataFrame(rows, COLS)))))
    assert got == plain(spliced(ordered(rows)))


@pytest.mark.parametrize("modulus", [1, 5, prefix_trie.MODULUS])
def test_collisions_are_split(spark, modulus):
    rows = made(modulus % 97, 5, range(60))
    turns = prefix_trie.contents(spark.createDataFrame(rows, COLS).repartition(7), digest_bytes=0)
    assert found(prefix_trie.trie(prefix_trie.as_they_are(turns), modulus=modulus)) == plain(ordered(rows))


def test_one_conversation_over_many_parts(spark):
    rows = [(7, k, "u", f"t{k % 5}") for k in range(400)] + [(8, k, "u", f"t{k % 5}") for k in range(250)] + [(9, 0, "u", "t0")]
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = found(prefix_trie.trie(prefix_trie.as_they_are(prefix_trie.contents(spark.createDataFrame(rows, COLS)))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == plain(ordered(rows))


def test_pieces_of_one_node(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(prefix_trie, "CHUNK_BYTES", 50)
    ids = list(range(95, 130))
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 35), pa.array([0] * 20 + [1] * 15), pa.array(ids)], ["depth", "key", "conv_id"])
    pieces = list(prefix_trie._chunks(iter([batch.slice(0, 9), batch.slice(9)])))
    assert sum(len(p) for p in pieces) > 2
    out = pa.Table.from_batches(list(prefix_trie._hashed(iter(pieces)))).to_pylist()
    want = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in (ids[:20], ids[20:])]
    assert [r["ends_sha256"] for r in out] == want


def test_powers():
    e = np.array([0, 1, 2, 31, 1_000_003])
    assert prefix_trie.powers(12345, e, prefix_trie.MODULUS).tolist() == [pow(12345, int(x), prefix_trie.MODULUS) for x in e]


def test_empty_table(spark):
    turns = prefix_trie.contents(spark.createDataFrame([], COLS))
    assert prefix_trie.trie(prefix_trie.spliced(turns)).collect() == []
