import hashlib
import random

import pytest

from quire.llm import exact_dedup

COLS = "doc_id long, text string"


def plain(rows):
    """Brute force over (doc_id, text, place)."""
    norm = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0, k))
    out = []
    for k, (i, t) in enumerate(rows):
        g = groups[norm(t)]
        best = min(g)
        out.append((i, None if best[1] else best[2], len(g), best[3] == k, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()], key=str)


ODD = [(5, "a b"), (3, "ab"), (2, " a\tb"), (9, None), (8, ""), (7, " \n"), (None, "a  b"), (1, "ab "), (4, "é" * 3), (6, "é é é"), (11, "x" * 300_000), (10, "x" * 299_999 + " x"), (3, "ab"), (12, " ab")]


def test_odd_rows(spark):
    assert found(exact_dedup.exact_dedup(spark.createDataFrame(ODD, COLS).coalesce(1))) == plain(ODD)


@pytest.mark.parametrize("digest_bytes", [0, 1, 32])
def test_copies_over_many_parts_with_digests_that_meet(spark, digest_bytes):
    rng = random.Random(digest_bytes)
    texts = ["hot text"] * 400 + ["".join(rng.choice("ab \n") for _ in range(rng.randint(0, 6))) for _ in range(600)]
    rng.shuffle(texts)
    rows = [(k * 7 % 1000, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, COLS).repartition(23)
    assert found(exact_dedup.exact_dedup(df, digest_bytes=digest_bytes)) == plain(rows)


def test_blocks_end_by_rows_and_bytes(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BLOCK_BYTES", 40)
    block, rows = exact_dedup.Block(0, 32), []
    for k in range(9):
        block.add(b"same" if k % 2 else b"%08d" % k, 8, k)
        rows.append(block.full())
    assert rows[:7] == [False] * 7 and rows[8]
    assert block.sizes[block.group[1]] == 4 and block.best[block.group[1]] == (-8, False, 1, 1)


def test_clashing_columns_and_texts_come_through(spark):
    df = spark.createDataFrame([(1, "a", "k", 1, "z"), (2, "a ", "m", 2, None)], "doc_id long, text string, content string, kept int, local string")
    out = exact_dedup.exact_dedup(df)
    assert out.columns == ["doc_id", "text", "content", "local", "keep_id", "group_size", "kept", "text_sha256"]
    assert [tuple(r)[:7] for r in out.filter("kept").collect()] == [(2, "a ", "m", None, 2, 2, True)]
    assert "text" not in exact_dedup.exact_dedup(df, with_text=False).columns


def test_empty_table(spark):
    assert exact_dedup.exact_dedup(spark.createDataFrame([], COLS)).collect() == []
