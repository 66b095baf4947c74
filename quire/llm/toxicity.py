"""Toxicity by a convolutional text classifier (operator 2).

A word is the sum of three hashed embeddings: of the whole word, of its first four and of its first five bytes, so
that inflected forms share what they have learnt. Filters of widths one, two and three run over the words, each
keeps its largest response in the whole text (at least 0), and a logistic layer scores them. Everything is trained
in numpy with Adam on a bounded sample of labelled rows, equally many of each class; a held-back part of that
sample calibrates the score to the classes' true shares, and sets one threshold for each language.

Scoring tables hold each bucket's response to every filter, so a text costs sums of table rows and one maximum.

Nulls in text count as empty; texts without words have no responses and score as the bias says; labels that are
null or without a document are ignored; a document is learnt once with each label that it has, and of several texts
of one id the first in order; with labels of one class only
(or none) every score is that class (or 0). Null ids are kept, they are never labelled; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import runtime
from quire.llm.shingles import mix, slices, word_spans

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 16, 12, (1, 2, 3)
#: Labelled rows of each class in the sample that is fitted, and the passes over it.
PER_CLASS, EPOCHS, BATCH, SEED = 2000, 12, 32, 1
#: Bytes of text of each class in that sample.
SAMPLE_BYTES = 32 << 20
#: Steps that a small sample is trained for, with at most four times the passes.
LEAST_STEPS = 500
#: Rows of each class that a threshold of its own takes, of a language or of all; below it the threshold is 0.5.
LEAST_ROWS = 20
_APART = np.ones(256, bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_SEEDS = np.array([0x51, 0xA7, 0xF3], np.uint64)


def buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(words x 3) embedding rows, and the number of words in each text; for a slice of texts."""
    sums, down, first, last, n = word_spans(texts, _APART)
    out = np.empty((len(first), 3), np.int32)
    for k, most in enumerate((None, 4, 5)):
        end = last if most is None else np.minimum(last, first + most - 1)
        out[:, k] = mix((sums[end] - sums[first - 1]) * down[first] ^ _SEEDS[k]) >> np.uint64(64 - BUCKETS.bit_length() + 1)
    return out, n


@dataclass
class Model:
    tables: dict[int, np.ndarray] = field(default_factory=dict)  # by width: (width, BUCKETS, FILTERS)
    biases: dict[int, np.ndarray] = field(default_factory=dict)
    weights: np.ndarray | None = None
    bias: float = 0.0
    constant: float | None = None  # the score where nothing could be learnt
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5

    def features(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), len(WIDTHS) * FILTERS), np.float32)
        for i, j in slices(texts):
            rows, n = buckets(texts[i:j])
            if not len(rows):
                continue
            own = np.flatnonzero(n)
            first = (np.cumsum(n) - n)[own]
            last = first + n[own] - 1
            for k, w in enumerate(WIDTHS):
                parts = []
                for t in range(w):
                    table = self.tables[w][t]
                    parts.append(table[rows[:, 0]] + table[rows[:, 1]] + table[rows[:, 2]])
                y = parts[0]
                for t in range(1, w):  # what lies behind a text's last word adds nothing
                    after = parts[t]
                    for back in range(t):
                        at = last - back
                        at = at[at >= first]
                        y[at] -= after[np.minimum(at + t, len(after) - 1)] * (at + t < len(after))[:, None]
                    y[: len(y) - t] += after[t:]
                y += self.biases[w]
                out[i + own, k * FILTERS : (k + 1) * FILTERS] = np.maximum(np.maximum.reduceat(y, first), 0)
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return _sigmoid(self.features(texts).astype(np.float64) @ self.weights + self.bias)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class _Adam:
    def __init__(self, shape, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(shape, np.float32), np.zeros(shape, np.float32), 0, rate

    def step(self, p: np.ndarray, g: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.001 * (g * g - self.v)
        p -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-7)


def fit(texts: list[bytes], labels: np.ndarray, langs: list[str], share: float, seed: int = SEED, epochs: int = EPOCHS) -> Model:
    """Train on three quarters of the rows, calibrate on the rest. share: the share of label 1 among all labelled rows."""
    labels = np.asarray(labels, np.float32)
    if len(set(labels.tolist())) < 2:
        return Model(constant=float(labels[0]) if len(labels) else 0.0)
    rng = np.random.default_rng(seed)
    docs = []
    for i, j in slices(texts):
        rows, n = buckets(texts[i:j])
        docs += np.split(rows, np.cumsum(n)[:-1])
    held = np.zeros(len(docs), bool)
    for c in (0, 1):  # every fourth of each class
        held[rng.permutation(np.flatnonzero(labels == c))[::4]] = True
    train = np.flatnonzero(~held) if len(set(labels[~held].tolist())) == 2 else np.arange(len(docs))
    emb = rng.normal(0, 0.3, (BUCKETS + 1, DIM)).astype(np.float32)
    emb[BUCKETS] = 0
    squares = np.full(BUCKETS + 1, 1e-6, np.float32)
    filters = {w: rng.normal(0, 0.5 / np.sqrt(DIM * w), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
    biases = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
    weights = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
    bias = np.zeros(1, np.float32)
    adams = {w: (_Adam(filters[w].shape, 0.01), _Adam(FILTERS, 0.01)) for w in WIDTHS}
    adam_w, adam_b = _Adam(len(weights), 0.02), _Adam(1, 0.02)
    pad = np.full((max(WIDTHS) - 1, 3), BUCKETS, np.int32)
    for _ in range(max(epochs, min(4 * epochs, LEAST_STEPS * BATCH // max(1, len(train))))):  # small samples are passed more often
        order = rng.permutation(train)
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            rows = np.concatenate([x for k in pick for x in (docs[k], pad)])
            sizes = np.array([len(docs[k]) for k in pick])
            first = np.cumsum(sizes + len(pad)) - sizes - len(pad)
            x = emb[rows[:, 0]] + emb[rows[:, 1]] + emb[rows[:, 2]]
            pooled, where = [], []
            for w in WIDTHS:
                y = np.zeros((len(x) - w + 1, FILTERS), np.float32)
                for t in range(w):
                    y += x[t : t + len(y)] @ filters[w][t]
                y += biases[w]
                best = np.array([y[a : a + n].argmax(0) + a if n else np.full(FILTERS, a) for a, n in zip(first, sizes, strict=True)])
                pooled.append(np.where(sizes[:, None] > 0, np.take_along_axis(y, np.minimum(best, len(y) - 1), 0), 0))
                where.append(best)
            z = np.concatenate(pooled, 1)
            h = np.maximum(z, 0)
            d = (_sigmoid(h @ weights + bias[0]) - labels[pick]).astype(np.float32) / len(pick)
            gh = np.outer(d, weights) * (z > 0)
            dx_at, dx = [], []
            for k, w in enumerate(WIDTHS):
                g = gh[:, k * FILTERS : (k + 1) * FILTERS]
                gf = np.zeros_like(filters[w])
                for t in range(w):
                    own = np.minimum(where[k] + t, len(x) - 1)
                    gf[t] = np.einsum("bfd,bf->df", x[own], g)
                    dx_at.append(own.reshape(-1))
                    dx.append((g[:, :, None] * filters[w][t].T[None]).reshape(-1, DIM))
                adams[w][0].step(filters[w], gf + 1e-5 * filters[w])
                adams[w][1].step(biases[w], g.sum(0))
            adam_w.step(weights, d @ h + 1e-4 * weights)
            adam_b.step(bias, d.sum(keepdims=True))
            at_x, grad = np.concatenate(dx_at), np.concatenate(dx)
            live = (grad != 0).any(1)
            spots = rows[at_x[live]].reshape(-1)
            uniq, inverse = np.unique(spots, return_inverse=True)
            sums = np.zeros((len(uniq), DIM), np.float32)
            np.add.at(sums, inverse, np.repeat(grad[live], 3, 0))
            squares[uniq] += (sums * sums).mean(1)
            emb[uniq] -= 0.05 * sums / np.sqrt(squares[uniq])[:, None]
            emb[BUCKETS] = 0
    model = Model(weights=weights.astype(np.float64), bias=float(bias[0]))
    for w in WIDTHS:
        model.tables[w] = np.stack([emb[:BUCKETS] @ filters[w][t] for t in range(w)])
        model.biases[w] = biases[w]
    _calibrate(model, texts, labels, langs, held if held.any() and len(set(labels[held].tolist())) == 2 else np.ones(len(docs), bool), share)
    return model


def _calibrate(model: Model, texts: list[bytes], labels: np.ndarray, langs: list[str], held: np.ndarray, share: float) -> None:
    """Scale the logit on the held rows, weighted to the true shares, and set thresholds by language."""
    own = np.flatnonzero(held)
    logit = model.features([texts[k] for k in own]).astype(np.float64) @ model.weights + model.bias
    y = labels[own].astype(np.float64)
    weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum()))
    a, b = 1.0, 0.0
    for _ in range(200):  # gradient steps on scale and shift, held near 1 by a weak prior
        p = _sigmoid(a * logit + b)
        e = weight * (p - y)
        curve = weight * p * (1 - p) + 1e-6
        a = float(np.clip(a - 0.5 * ((e * logit).sum() + 1e-3 * (a - 1)) / ((curve * logit**2).sum() + 1e-3), 0.2, 5))
        b -= 0.5 * e.sum() / curve.sum()
        b = float(np.clip(b, -12, 12))
    model.weights, model.bias = model.weights * a, model.bias * a + b
    p = _sigmoid(a * logit + b)

    def best(rows: np.ndarray) -> float:
        order = np.argsort(-p[rows])
        hit, all_ = np.cumsum((weight * y)[rows][order]), np.cumsum(weight[rows][order])
        f1 = 2 * hit / (all_ + (weight * y)[rows].sum())
        k = int(f1.argmax())
        low = p[rows][order][k + 1] if k + 1 < len(rows) else 0.0
        return float(np.sqrt(p[rows][order][k] * max(low, 1e-9)))  # between the two scores, as odds go

    enough = lambda rows: min((y[rows] == 1).sum(), (y[rows] == 0).sum()) >= LEAST_ROWS
    model.threshold = best(np.arange(len(own))) if enough(np.arange(len(own))) else 0.5
    for lang in {langs[k] for k in own}:
        rows = np.array([i for i, k in enumerate(own) if langs[k] == lang])
        if enough(rows):
            model.thresholds[lang] = best(rows)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", eligible=None, per_class: int = PER_CLASS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on at most per_class labelled rows and sample_bytes of text of each class, those with the smallest hashes of their ids.

    eligible: a condition on doc_id that rows to learn from must meet. lang is read for thresholds only.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    if eligible is not None:
        own = own.filter(eligible)
    shares = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = None
    for y in (0, 1):
        some = own.filter(F.col("y") == y).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = some if picked is None else picked.unionByName(some)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit("")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), runtime.text_or_empty().alias("text"), F.coalesce(lang, F.lit("")).alias("lang"))
    # 2 * per_class rows at most: a side of a fixed size; of the rows of one id one is learnt
    once = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct("text", "lang")).alias("row"))
    once = runtime.written(once.select("doc_id", "y", "row.text", "row.lang", F.octet_length("row.text").cast("long").alias("size"), F.xxhash64("doc_id").alias("turn")), "labelled")
    taken: list[tuple[int, int]] = []
    room = {0: sample_bytes, 1: sample_bytes}
    for r in sorted(once.select("doc_id", "y", "size", "turn").collect(), key=lambda r: (r["turn"], r["doc_id"], r["y"])):
        room[r["y"]] -= r["size"]
        if room[r["y"]] >= 0 or room[r["y"]] + r["size"] == sample_bytes:  # one row at least
            taken.append((r["doc_id"], r["y"]))
    chosen = once.join(F.broadcast(docs.sparkSession.createDataFrame(taken, "doc_id long, y int")), ["doc_id", "y"])
    rows = sorted(chosen.select("doc_id", "y", "text", "lang").toArrow().to_pylist(), key=lambda r: (r["doc_id"], r["y"]))
    runtime.discard(once)
    total = sum(shares.values())
    model = fit([r["text"].encode() for r in rows], np.array([r["y"] for r in rows]), [r["lang"] for r in rows], shares.get(1, 0) / total if total else 0.0)
    del rows
    runtime.trim()
    return model


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """docs with a column `into`: 0 to 1, higher where label 1 is likelier; an old column of that name goes. Only the text is read for it."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    spark = docs.sparkSession
    runtime.ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text)
            raw = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in texts.cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.scores(raw), pa.float64())], [*batch.schema.names, into])

    kept = docs.drop(into) if into in docs.columns else docs
    return kept.mapInArrow(runtime.lean(run), StructType([*kept.schema.fields, StructField(into, DoubleType())]))


def flagged(scored: DataFrame, model: Model) -> DataFrame:
    """scored with a boolean column flagged: score at or above the threshold of the row's language; an old column of that name goes."""
    limit = F.lit(model.threshold)
    if model.thresholds and "lang" in scored.columns:
        by = F.create_map(*[F.lit(x) for kv in sorted(model.thresholds.items()) for x in kv])
        limit = F.coalesce(F.element_at(by, F.col("lang").cast("string")), limit)
    return scored.withColumn("flagged", F.col("score") >= limit)
