import hashlib
import random
import re

import numpy as np

from quire.llm import fingerprints as fp
from quire.llm.shingles import shingle_hashes, shingle_sets

SCHEMA = "doc_id long, text string, key string, part int"


def plain(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), text))
    return [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []


def texts(rng, n):
    words = ["the", "The", "a", "bé", "x.", "\x00", "ÀB", "longerword" * 3, "9"]
    return ["".join(rng.choice(words) + rng.choice([" ", "\n", "\x0b ", "\t"]) for _ in range(rng.choice([0, 1, 3, 4, 5, 6, 30, 200]))) for _ in range(n)]


def test_shingle_hashes_stand_for_shingles():
    rng = random.Random(1)
    raw = [t.encode() for t in [*texts(rng, 300), "", "  ", "one", " one\n", "a b c d e", "A b C d e", "x " * 300_000, "y" * 600_000]]
    h, at = shingle_hashes(raw)
    seen = {}
    for k, t in enumerate(raw):
        want = plain(t)
        assert at[k + 1] - at[k] == len(want)
        for x, s in zip(h[at[k] : at[k + 1]].tolist(), want):
            assert seen.setdefault(x, s) == s
    assert len(set(seen.values())) == len(seen)
    assert shingle_hashes([])[1].tolist() == [0]


def test_sketches_estimate_and_merge():
    rng = random.Random(2)
    words = [str(i) for i in range(5000)]
    a, b = " ".join(words[:4000]), " ".join(words[3000:3600])
    x, y = fp.sketches([a.encode(), b.encode()])
    assert abs(fp.containment(y, x) - 1) < 0.02
    assert abs(fp.resemblance(x, y) - 596 / 3996) < 0.05
    assert fp.from_text(fp.to_text(x))[1].tolist() == x.tolist()
    assert fp.from_text(fp.merge(fp.to_text(x), fp.to_text(y)))[1].tolist() == np.union1d(x, y).tolist()
    assert fp.resemblance(x[:0], y[:0]) == 1.0 and rng


def test_rows_against_the_plain_order(spark):
    rng = random.Random(4)
    rows = [(i * 3, t, "k", 1) for i, t in enumerate(texts(rng, 60))] + [(7, None, None, None), (None, "null id", "a", 2), (9, "tie b", "a", 2), (9, "tie a", "a", 2), (9, "tie a", "a", 2), (10**12, "😀é" * 40, "z", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    order = sorted(((d, t or "") for d, t, _, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want = []
    for k, (d, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        e = fp.edited(t, nxt)
        s, se, sn = fp.sketches([t.encode(), e.encode(), nxt.encode()])
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), fp.to_text(s), fp.to_text(se), round(fp.resemblance(s, se), 9), round(fp.resemblance(s, sn), 9)))
    got = [(r[0], r[1], r[2], r[3], r[4], round(r[5], 9), round(r[6], 9)) for r in fp.fingerprints(docs).collect()]
    key = lambda r: (r[0] is not None, r)[0:1] + tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert fp.fingerprints(docs.limit(0)).count() == 0
    same = spark.createDataFrame([(1, f"text {k % 3} " + "w " * 70 + str(k)) for k in range(200)] + [(1, "copy")] * 50, "doc_id long, text string").repartition(4)
    every = sorted(t for _, t in same.collect())
    out = same.sparkSession and fp.fingerprints(same).collect()
    assert sorted(r.edited_sha256 for r in out) == sorted(hashlib.sha256(fp.edited(t, every[(k + 1) % len(every)]).encode()).hexdigest() for k, t in enumerate(every))
    one = fp.fingerprints(docs.filter("doc_id = 7")).collect()
    assert [(r.doc_id, r.n_chars, r.near_next) for r in one] == [(7, 0, 1.0)]


def test_exact_sets_are_sorted_and_distinct():
    (s,) = shingle_sets([b"a b c d e a b c d e a b c d e"])
    assert len(s) == 5 and (np.diff(s.astype(object)) > 0).all()


def test_short_texts_are_told_apart():
    texts = [f"word{i} and" for i in range(400)]
    own = fp.sketches([t.encode() for t in texts])
    assert len({fp.to_text(s) for s in own}) == 400 and fp.to_text(fp.sketches([b""])[0]) == "4:"
    assert sum(s[-1] >= fp.LONE for s in own) > 200
    for a, b in zip(range(0, 400, 2), range(1, 400, 2)):
        x, y = fp.to_text(own[a]), fp.to_text(own[b])
        assert fp.resemblance(own[a], own[b]) == 0.0 and fp.resemblance(own[a], own[a]) == 1.0
        assert fp.from_text(x)[1].tolist() == own[a].tolist()
        together = shingle_sets([texts[a].encode()])[0].tolist() + shingle_sets([texts[b].encode()])[0].tolist()
        low = [h for h in together if h < 1 << 62]
        assert fp.from_text(fp.merge(x, y))[1].tolist() == (sorted(h >> 22 & fp.LONE.item() - 1 for h in low) or [min(together)])
