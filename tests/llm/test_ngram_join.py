import random
import re

import numpy as np
import pytest

from quire.llm import ngram_join as nj
from quire.llm import queries
from quire.llm.shingles import shingle_sets


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain(rows):
    """doc_id: (size, component), by comparing all pairs that share a shingle."""
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(k)
    seen = set()
    for own in by.values():
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    x, y = sets[a][1], sets[b][1]
                    if 100 * len(x & y) >= 80 * len(x | y):
                        p, q = top(sets[a][0]), top(sets[b][0])
                        parent[max(p, q)] = min(p, q)
    return {d: (len(s), top(d)) for d, s in sets}


def check(spark, rows, parts=4):
    docs = spark.createDataFrame([(d, t, "k", 1) for d, t in rows], "doc_id long, text string, key string, n int").repartition(parts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.ngram_join(docs).collect()}
    want = plain(rows)
    assert {d: w for d, w in want.items() if got[d] != w} == {} and len(got) == len(want)
    return want


def test_every_size_near_the_threshold(spark):
    rng = random.Random(8)
    rows, d = [], 0
    for size in [5, 6, 7, 8, 9, 10, 11, 12, 14, 17, 22, 28, 40, 60, 100, 180, 300]:
        for _ in range(5):
            base = [str(rng.randrange(10**6)) for _ in range(size + 4)]
            for _ in range(5):
                words = list(base)
                for _ in range(rng.choice([0, 1, 1, 2, max(1, size // 40), max(1, size // 25)])):
                    i = rng.randrange(len(words))
                    words[i : i + 1] = rng.choice([[], ["new"], [words[i], "more"], [words[i].upper() + "x"]])
                if rng.random() < 0.3:
                    words = words[: rng.randint(len(words) * 3 // 4, len(words))]
                rows.append((d, " ".join(words)))
                d += 1
    want = check(spark, rows)
    assert len({c for _, c in want.values()}) < len(rows)


def test_common_passages_and_large_groups(spark):
    rng = random.Random(9)
    hot = " ".join(str(rng.randrange(10**6)) for _ in range(60))
    base = [str(rng.randrange(10**6)) for _ in range(150)]
    rows = [(i, hot + " " + " ".join(str(rng.randrange(10**6)) for _ in range(rng.randint(10, 80)))) for i in range(150)]
    for i in range(200):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(len(words))] = str(rng.randrange(10**6))
        rows.append((1000 + i, " ".join(words)))
    rows += [(2000 + i, " ".join(base)) for i in range(50)]
    rows += [(3000, None), (3001, ""), (3002, " \n"), (3003, "one"), (3004, "One"), (3005, "one two three four"), (3006, "x " * 50_000)]
    rng.shuffle(rows)
    check(spark, rows, 7)


def test_rows_of_one_id_and_empty_table(spark):
    a, b = " ".join(map(str, range(40))), " ".join(map(str, range(100, 140)))
    docs = spark.createDataFrame([(5, a), (5, b), (5, b), (3, a), (9, b), (None, "z"), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in nj.ngram_join(docs).collect())
    assert got == [(-1, 0, None), (-1, 1, None), (3, 36, 3), (5, 36, 3), (5, 36, 3), (5, 36, 3), (9, 36, 3)]
    assert nj.ngram_join(docs.limit(0)).count() == 0


def test_given_documents_against_all_pairs(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op1_ngram_join(spark, sf).collect()}
    assert got == plain(rows)


def test_bands_hold_partners():
    ends = nj.bands(5000).tolist()
    assert ends == sorted(set(ends)) and {nj.LARGE << k for k in range(7)} <= set(ends)
    for n in range(4, 5000):
        k = max(i for i, e in enumerate(ends) if e <= n)
        assert n * 5 // 4 < ends[k + 2]


@pytest.mark.parametrize("size", [4, 5, 6, 7, 8, 9, 10, 11, 14, 18, 24, 28, 31, 32, 33, 40, 63, 64, 70, 80, 127, 130, 400])
def test_partners_share_an_entry_whatever_their_frequencies(size):
    """Each leaves out as many entries as it can, those of the highest rank in an order that both know nothing of."""
    rng = np.random.default_rng(size)
    ends, met = nj.bands(1000), 0
    for _ in range(80):
        a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
        gone, new = rng.integers(0, size // 5 + 1), rng.integers(0, size // 4 + 1)
        b = np.unique(np.concatenate((rng.permutation(a)[gone:], rng.integers(0, 2**64, new, dtype=np.uint64))))
        if 0 < len(np.setxor1d(a, b)) and nj.links(len(a), len(b), len(np.setxor1d(a, b))):
            order, left, own = int(rng.integers(0, 2**63)), [], []
            both = [{int(k) for keys, _, _ in nj.all_entries(s, ends) for k in keys} for s in (a, b)]
            for s in (a, b):
                left.append(set())
                for keys, spare, low in nj.all_entries(s, ends):
                    shared = sorted((k for k in keys.tolist() if k in both[0] & both[1]), key=lambda k: k ^ order, reverse=True)
                    left[-1] |= set(shared[spare:]) if len(shared) + spare > len(keys) or spare < len(shared) else set()
                    own += [low] * len(set(shared[spare:]))
            assert left[0] & left[1] and any(own)
            met += 1
    assert met or size < 8


def test_sets_are_those_of_the_text():
    texts = ["a b c d e f", "A  b\tc d E f", "a", ""]
    assert [len(s) for s in shingle_sets([t.encode() for t in texts])] == [len(shingles(t)) for t in texts]


def test_long_runs_come_in_parts(monkeypatch):
    import pyarrow as pa

    entry = np.repeat(np.arange(6), [1, 2, 40, 1, 9, 30])
    key = np.arange(len(entry))
    whole = pa.table({"entry": entry, "cid": key, "meta": np.full(len(entry), 50 << 32)})
    for run, size in ((1000, 7), (10, 7), (10, 50), (5, 1)):
        monkeypatch.setattr(nj, "LONG_RUN", run)
        met = pa.Table.from_batches(nj._met(iter(whole.to_batches(max_chunksize=size)))).to_pylist()
        want = {(e, k): min(run, int((entry == e).sum())) for e, k in zip(entry.tolist(), key.tolist()) if (entry == e).sum() > 1}
        assert {(r["entry"], r["cid"]): r["n"] for r in met} == want
        keyed = pa.table({"entry": entry, "key": key, "low": np.ones(len(entry), bool)})
        stars = pa.Table.from_batches(nj._stars(iter(keyed.to_batches(max_chunksize=size)))).to_pylist()
        assert {(r["leader"], r["member"]) for r in stars} == {(int(key[entry == e][0]), k) for e, k in zip(entry.tolist(), key.tolist()) if k != key[entry == e][0]}


def test_met_are_sets_of_fitting_sizes():
    import pyarrow as pa

    def met(rows):
        rows = sorted((1, n << 32 | low, c) for c, n, low in rows)
        table = pa.table({"entry": [r[0] for r in rows], "meta": [r[1] for r in rows], "cid": [r[2] for r in rows]})
        return sorted((r["cid"], r["n"]) for b in nj._met(iter(table.to_batches())) for r in b.to_pylist())

    assert met([(1, 100, 0), (2, 125, 0), (3, 200, 0)]) == [(1, 3), (2, 3)]
    assert met([(1, 100, 0), (1, 100, 0)]) == []  # a copy that another task has indexed
    assert met([(1, 60, 0), (2, 64, 1), (3, 79, 1)]) == [(1, 3), (2, 3)]
    assert met([(2, 64, 1), (3, 66, 1)]) == []  # they meet in their own scheme
    assert met([]) == []


def test_marks_hold_every_key(spark):
    keys = spark.range(5000).selectExpr("id * 7919 as key")
    own = nj.marks(keys)
    slots = [r[0] for r in keys.selectExpr(f"pmod(xxhash64(key), {nj.MARKS})").collect()]
    assert all(own[s >> 6] >> (s & 63) & 1 for s in slots)
    assert not nj.marks(keys.limit(0)).any()


def test_several_texts_of_one_id_are_compared_apart(spark):
    """Deltas are taken within one text of a leader, never across two."""
    rng = random.Random(4)
    texts = [[str(rng.randrange(10**6)) for _ in range(120)] for _ in range(3)]
    rows = [(1, " ".join(t)) for t in texts]
    for k, t in enumerate(texts):
        for i in range(6):
            rows.append((10 * (k + 1) + i, " ".join([*t[: 70 + 3 * i], *(str(rng.randrange(10**6)) for _ in range(50 - 3 * i))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in nj.ngram_join(docs).collect()}
    assert got == {d: c for d, (_, c) in plain(rows).items()}


def test_null_ids_among_copies(spark):
    rng = random.Random(12)
    a, b, c, z = ([str(rng.randrange(10**6)) for _ in range(200)] for _ in range(4))
    near = lambda w, k: " ".join([*w[:k], "new", *w[k + 1 :]])
    most = 2**63 - 1
    rows = [(7, " ".join(a)), (3, near(a, 5)), (None, near(a, 60)), (21, " ".join(b)), (None, near(b, 9)), (None, near(b, 9)), (None, " ".join(c)), (None, near(c, 4)), (most, " ".join(z)), (None, near(z, 7)), (None, " ".join(z)), (None, "")]
    got = nj.ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == sorted([(7, 3), (3, 3), (0, 3), (21, 21), (0, 21), (0, 21), (0, 0), (0, 0), (most, most), (0, most), (0, most), (0, 0)])
    assert sorted((r.doc_id or 0, r.class_id or 0) for r in got) == sorted([(7, 7), (3, 3), (0, 0), (21, 21), (0, 0), (0, 0), (0, 0), (0, 0), (most, most), (0, 0), (0, most), (0, 0)])
    assert len({r.component_key for r in got}) == 5


def test_members_of_many_stars_are_taken_once(spark, monkeypatch):
    """Sets that share passages with many leaders become rows once each, not once a leader; links among them are found."""
    rng = random.Random(6)
    word = lambda: str(rng.randrange(10**6))
    passages = [[word() for _ in range(55)] for _ in range(18)]
    rows = []
    for i, (p, q) in enumerate((p, q) for k, p in enumerate(passages) for q in passages[:k]):
        words = p + q
        rows.append((2 * i, " ".join(words)))
        if i % 5 == 0:  # links among members that are far from their leaders
            k = rng.randrange(len(words))
            rows.append((2 * i + 1, " ".join([*words[:k], word(), *words[k + 1 :]])))
    rng.shuffle(rows)
    tables, written = {}, nj.runtime.written

    def kept(df, name, **options):
        tables[name] = written(df, name, **options)
        return tables[name]

    monkeypatch.setattr(nj.runtime, "written", kept)
    monkeypatch.setattr(nj.runtime, "discard", lambda *frames: None)
    want = check(spark, rows)
    assert len({c for _, c in want.values()}) == 153
    exploded = sum(len(r.delta) for r in tables["deltas"].select("delta").collect())
    exploded += tables["elements"].count() if "elements" in tables else 0
    assert exploded <= sum(n for n, _ in want.values())


def test_members_linked_or_not_to_their_leader(spark):
    """Chains whose middle is linked to the leader or not, in groups that share passages."""
    rng = random.Random(15)
    word = lambda: str(rng.randrange(10**6))
    rows, d = [], 0
    for size in (40, 90, 160):
        for _ in range(12):
            words = [word() for _ in range(size)]
            for _ in range(9):  # each is a step from the one before
                words = list(words)
                for _ in range(max(1, size // 60)):
                    k = rng.randrange(len(words))
                    words[k : k + 2] = rng.choice([[word()], [words[k], word(), word()]])
                rows.append((d, " ".join(words)))
                d += 1
    rng.shuffle(rows)
    want = check(spark, rows, 5)
    assert len({c for _, c in want.values()}) < len(rows) // 2


def test_pairs_compared_grow_with_a_group_of_near_copies(spark, monkeypatch):
    """Copies on both sides of the threshold: many aren't linked to their leader, nor with each other. Twice the copies are not four times the pairs."""
    rng = random.Random(21)
    word = lambda: str(rng.randrange(10**9))
    base, counts = [word() for _ in range(150)], []

    def counted(compare):
        def run(pairs, *more):
            counts[-1] += pairs.count()
            return compare(pairs, *more)

        return run

    for name in ("_verified", "_linked_deltas"):
        monkeypatch.setattr(nj, name, counted(getattr(nj, name)))
    for n in (150, 300):
        rows = []
        for d in range(n):
            words = list(base)
            for k in rng.sample(range(len(words)), rng.choice([1, 2, 3, 5, 8, 10])):
                words[k] = word()
            rows.append((d, " ".join(words)))
        counts.append(0)
        want = check(spark, rows)
        assert 1 < len({c for _, c in want.values()}) < n
    assert counts[1] <= 2.5 * counts[0]
