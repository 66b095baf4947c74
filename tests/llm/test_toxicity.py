import random
import zlib

import numpy as np

from quire.llm import queries
from quire.llm import toxicity as tx

DATA = "/root/testdata/sf0.1"


def made(n, seed=3):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(rng.randint(0, 60))]
        y = int(rng.random() < 0.3)
        for _ in range(2 * y):
            words.insert(rng.randint(0, len(words)), rng.choice(["Zorgu", "zorgly", "qax"]))
        rows.append((" ".join(words), y, rng.choice(["en", "fr"])))
    return rows


def test_tables_give_the_plain_convolution():
    rows = made(80)
    model = tx.fit([t.encode() for t, _, _ in rows], np.array([y for _, y, _ in rows]), [g for *_, g in rows], 0.3, epochs=1)
    texts = [b"", b"one", b"one two", b" a b c d e ", "é zorgu Zorgu qax!".encode(), b"x " * 3000]
    got = model.features(texts)
    for k, t in enumerate(texts):
        ids, n = tx.buckets([t])
        for j, w in enumerate(tx.WIDTHS):
            best = np.zeros(tx.FILTERS)
            for i in range(len(ids)):
                y = model.biases[w] + sum(model.tables[w][s][b] for s in range(w) if i + s < len(ids) for b in ids[i + s])
                best = np.maximum(best, y)
            assert np.allclose(got[k, j * tx.FILTERS : (j + 1) * tx.FILTERS], best, atol=1e-3)
    assert np.allclose(tx.buckets([b"ZorGu,x"])[0], tx.buckets([b"zorgu x"])[0])


def test_learns_and_is_calibrated():
    rows, new = made(1500), made(500, 9)
    model = tx.fit([t.encode() for t, _, _ in rows], np.array([y for _, y, _ in rows]), [g for *_, g in rows], 0.3)
    s, y = model.scores([t.encode() for t, _, _ in new]), np.array([y for _, y, _ in new])
    assert ((s >= 0.3) == (y == 1)).mean() > 0.97 and set(model.thresholds) == {"en", "fr"}


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in queries.op2_toxicity(spark, DATA).collect()}
    labels = spark.read.parquet(f"{DATA}/labels.parquet").collect()
    assert len(got) == 10_000
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d in list(got)[:500])
    own = [(got[r.doc_id].score, r.toxic) for r in labels if got[r.doc_id].held_out]
    pos, neg = [s for s, y in own if y], [s for s, y in own if not y]
    assert np.mean([s > t for s in pos for t in neg]) > 0.95
    assert np.mean([(s >= 0.3) == bool(y) for s, y in own]) > 0.96


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "en", 0.5), (2, "", None, None), (None, "a", "en", 1.0), (3, "x " * 50_000, "en", 1.0), (3, "same", "en", 1.0)], "doc_id long, text string, lang string, score double")
    none = spark.createDataFrame([(1, None), (77, 1), (None, 1)], "doc_id long, toxic int")
    model = tx.train(docs, none)
    out = tx.flagged(tx.score(docs, model), model).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    one = tx.train(docs, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int"))
    assert one.constant == 1.0
    both = tx.train(docs, spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int"))
    assert tx.score(docs, both).count() == 5 and tx.score(docs.limit(0), both).count() == 0


def test_query_against_the_plain_model(spark):
    """Every row of the query: the model that its rows give, each text convolved word by word."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = tx.train(docs, spark.read.parquet(f"{sf}/labels.parquet"), eligible=queries.remainder() != 2)
    got = {r.doc_id: r for r in queries.op2_toxicity(spark, sf).collect()}
    rows = docs.filter("n_chars < 1500").collect()
    for r in rows:
        ids, z = tx.buckets([r.text.encode()])[0], model.bias
        for j, w in enumerate(tx.WIDTHS):
            best = np.zeros(tx.FILTERS)
            for i in range(len(ids)):
                best = np.maximum(best, model.biases[w] + sum(model.tables[w][s][b] for s in range(w) if i + s < len(ids) for b in ids[i + s]))
            z += float(best @ model.weights[j * tx.FILTERS : (j + 1) * tx.FILTERS])
        mine = got[r.doc_id]
        assert abs(mine.score - 1 / (1 + np.exp(-z))) < 1e-3 and mine.predicted == int(mine.score >= 0.3)
        assert mine.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert len(got) == docs.count() and len(rows) > 50


def test_sample_is_bounded_by_bytes_and_learns_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * 400, "en") for i in range(40)] + [(3, "other", "en")] * 3, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 2, "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(tx, "fit", lambda texts, y, langs, share: seen.append((texts, y, share)))
    tx.train(docs, labels, sample_bytes=4000)
    texts, y, share = seen[0]
    assert sum(map(len, texts)) <= 8000 and abs(int(sum(y)) * 2 - len(y)) <= 1 and share == 0.5 and len(texts) >= 8
    tx.train(docs, labels, sample_bytes=10)
    assert len(seen[1][0]) == 2
