import hashlib
import random

from quire.llm import mixing as mx

SCHEMA = "doc_id long, source string, text string, slot string, its int"


def schedule(weights):
    """Slot by slot, the released block of the earliest deadline: heavier sources first of equals, then as they come."""
    total, had, out = sum(weights), [0] * len(weights), []
    for t in range(total):
        ready = [(-(-(had[k] + 1) * total // a), a == 1, k) for k, a in enumerate(weights) if had[k] < a and had[k] * total // a <= t]
        k = min(ready)[2]
        had[k] += 1
        out.append(k)
    return out


def test_cycle_stays_within_one_block():
    rng = random.Random(1)
    for _ in range(60):
        weights = [rng.choice([0, 1, 1, 2, 7, 40]) for _ in range(rng.randint(1, 12))]
        total, had, order = sum(weights), [0] * len(weights), schedule(weights)
        for t, k in enumerate(order, 1):
            had[k] += 1
            assert all(abs(h - a * t / total) < 1 for h, a in zip(had, weights))
        assert had == weights
        heavy = [k for k, a in enumerate(weights) if a > 1]
        assert mx.cycle([weights[k] for k in heavy], total) == [[t for t, x in enumerate(order) if x == k] for k in heavy]
    assert mx.shares({"a": 0.5, "b": 0.3, None: 0.2}, 7) == {"a": 4, "b": 2, None: 1}


def test_many_sources_of_weight_one(spark):
    """They take the slots that the others leave, in the order of their hashes."""
    rows = [(i, f"s{i}", "t", "", 0) for i in range(300)] + [(1000 + i, s, "t", "", 0) for s in ("big", "mid") for i in range(90)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {}
    for r in mx.mix(docs, {"big": 40, "mid": 9}, block_bytes=2).collect():
        got.setdefault(r.source, []).append(r.slot)
    light = sorted((f"s{i}" for i in range(300)), key=lambda s: hashlib.md5(s.encode()).hexdigest())
    names, weights = ["big", "mid", *light], [40, 9, *[1] * 300]
    want = {}
    for t, k in enumerate(schedule(weights)):
        want.setdefault(names[k], []).append(t)
    for s, slots in got.items():
        own, a = sorted(slots), len(want[s])
        assert own == [i // a * 349 + want[s][i % a] for i in range(len(own))]


def plain(rows, weights, size):
    """Slots by running the schedule one block at a time."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    light = lambda s: weights.get(s, 1) == 1
    sources = sorted(by, key=lambda s: (light(s), hashlib.md5((s or "\x00").encode()).hexdigest() if light(s) else "", s or ""))
    out, blocks, ends = {}, {}, {}
    for s in sources:
        before = 0
        for d, _, t, *_ in sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, len((r[2] or "").encode()))):
            blocks.setdefault(s, {}).setdefault(before // size, []).append((d, before % size))
            before += len((t or "").encode()) + 1
        ends[s] = (before - 1) // size + 1
    each = [weights.get(s, 1) for s in sources]
    order = schedule(each)
    at, had = 0, [0] * len(sources)
    while any(h < ends[s] for s, h, a in zip(sources, had, each) if a):
        k = order[at % len(order)]
        for d, seq in blocks[sources[k]].get(had[k], []):
            out.setdefault((d, sources[k]), []).append((had[k], at, seq))
        had[k] += 1
        at += 1
    return out


def test_rows_against_the_plain_schedule(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["hot", "hot", "hot", "b", "c", None]), rng.choice([None, "", "x" * rng.randint(1, 40), "é" * 30, "y" * 900]), "z", 3) for i in range(300)]
    rows += [(None, "b", "null id", "z", 3), (5, "b", "tie", "z", 3), (5, "b", "tie longer", "z", 3)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    weights = {"hot": 3, "b": 2, None: 4}
    got = {}
    for r in mx.mix(docs, weights, block_bytes=128).collect():
        got.setdefault((r.doc_id, r.source), []).append((r.block, r.slot, r.seq))
        assert r.its == 3
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in plain(rows, weights, 128).items()}
    assert mx.mix(docs.limit(0), weights).count() == 0


def test_repeated_rows_and_weight_nought(spark):
    docs = spark.createDataFrame([(1, "a", "t", "", 0)] * 3 + [(2, "b", "u", "", 0)], SCHEMA)
    out = sorted((r.source, r.slot, r.seq, r.on_target) for r in mx.mix(docs, {"b": 0}, block_bytes=4).collect())
    assert out == [("a", 0, 0, True), ("a", 0, 2, True), ("a", 1, 0, True), ("b", 2, 0, False)]
