"""Document fingerprints by a threshold-scaled sketch (operator 3).

A fingerprint holds every hash of the text's five-word shingles that falls below a fixed fraction of the hash
range: nothing else decides what is kept, so sketches of any two texts compare, merge by union, and estimate both
resemblance and containment, however unequal the texts. As a string: the denominator of the fraction, a colon, and
base64 of the kept hashes in ascending order, 5 bytes each (the 40 bits below the threshold).

A text of a few shingles may keep none. Its least hash stands for it then, whole and behind a '!', so that two such
texts are alike (1.0) only where these are the same; it says nothing of its share in a longer text (0.0). Merged, it
gives way to kept hashes, and of two the less remains: merging is the sketch of the union in all cases.

Nulls in text count as empty; only the sketch of a text without words is empty, and two empty sketches are alike
(1.0). Rows are ordered by doc_id, nulls first, equal ids by text; every repeated row has its own place in
that order; the row after the last is the first (a single row follows itself); an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import runtime
from quire.llm.shingles import shingle_hashes

SCALE, BYTES, SLICE_CHARS = 4, 5, 1 << 20
LONE = np.uint64(1 << 40)
#: Characters of a text by which rows of one doc_id are told apart when ranges are cut.
PLACE_CHARS = 64
_FIRST = -(1 << 63)


def sketches(texts: list[bytes], scale: int = SCALE) -> list[np.ndarray]:
    """Sorted kept hashes of each text, as 40-bit numbers; of a text that has shingles but keeps none the least hash, as it is (over LONE)."""
    h, at = shingle_hashes(texts)
    keep = h < np.uint64((1 << 64) // scale)
    upto = np.concatenate(([0], np.cumsum(keep)))[at]
    shift = np.uint64(64 - 8 * BYTES - (scale - 1).bit_length())
    kept = (h[keep] >> shift) & np.uint64((1 << 8 * BYTES) - 1)
    spans = zip(upto[:-1].tolist(), upto[1:].tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True)
    return [np.unique(kept[a:b]) if b > a or c == d else h[c:d].min(keepdims=True) for a, b, c, d in spans]


def to_text(sketch: np.ndarray, scale: int = SCALE) -> str:
    if len(sketch) and sketch[-1] >= LONE:
        return f"{scale}:!{base64.b64encode(sketch[:1].astype('>u8').tobytes()).decode()}"
    raw = sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BYTES :].tobytes()
    return f"{scale}:{base64.b64encode(raw).decode()}"


def from_text(text: str) -> tuple[int, np.ndarray]:
    scale, _, rest = text.partition(":")
    if rest.startswith("!"):
        return int(scale), np.frombuffer(base64.b64decode(rest[1:]), ">u8").astype(np.uint64)
    raw = np.frombuffer(base64.b64decode(rest), np.uint8).reshape(-1, BYTES)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 8 - BYTES :] = raw
    return int(scale), wide.reshape(-1).view(">u8").astype(np.uint64)


def merge(a: str, b: str) -> str:
    """The fingerprint of both texts' shingles together."""
    (scale, x), (other, y) = from_text(a), from_text(b)
    if scale != other:
        raise ValueError("fingerprints of different fractions")
    both = np.union1d(x, y)  # a lone hash only stands where nothing falls below the fraction, and the least of two is that of both
    return to_text(both[both < LONE] if (both < LONE).any() else both[:1], scale)


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    return len(np.intersect1d(x, y, assume_unique=True))


def resemblance(x: np.ndarray, y: np.ndarray) -> float:
    """Estimated Jaccard similarity."""
    n = _shared(x, y)
    union = len(x) + len(y) - n
    return n / union if union else 1.0


def containment(x: np.ndarray, y: np.ndarray) -> float:
    """Estimated share of x's shingles that y holds."""
    return _shared(x, y) / len(x) if len(x) else 1.0


def edited(text: str, following: str) -> str:
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _follow(scale: int):
    """Rows come ordered by (part, key, guest, text); the last row of a part is a guest and only follows."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "held_in_next"]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        """rows: (part, doc_id, guest, text); all but the last are answered, each if the next one follows it."""
        own = sketches([r[3].encode() for r in rows], scale)
        pairs = [k for k in range(len(rows) - 1) if rows[k][0] == rows[k + 1][0] and not rows[k][2]]
        changed = [edited(rows[k][3], rows[k + 1][3]).encode() for k in pairs]
        theirs = sketches(changed, scale)
        out = [
            (rows[k][1], len(rows[k][3]), hashlib.sha256(raw).hexdigest(), to_text(own[k], scale), to_text(e, scale), resemblance(own[k], e), resemblance(own[k], own[k + 1]), containment(own[k], own[k + 1]))
            for k, raw, e in zip(pairs, changed, theirs, strict=True)
        ]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            columns = [batch.column(c) for c in ("part", "doc_id", "guest", "text")]
            for k in range(len(batch)):
                row = tuple(c[k].as_py() for c in columns)
                if held and held[-1][2] and row[2] and held[-1][0] == row[0]:
                    continue  # of several guests the first follows
                held.append(row)
                size += len(row[3])
                if size >= SLICE_CHARS and len(held) > 1:
                    yield made(held)
                    held, size = held[-1:], len(row[3])
        if len(held) > 1:
            yield made(held)

    return run


def _places(rows: DataFrame, n: int) -> list[tuple[int, bytes]]:
    """At most n - 1 places (key, beginning of the text) that cut the rows into ranges of like numbers, by a sample of about 40 rows for each range."""
    count = rows.count()
    kept = F.pmod(F.xxhash64("key", "start"), F.lit(1 << 20)) < F.lit(min(1 << 20, -(-40 * n * (1 << 20) // max(1, count))))
    found = rows.filter(kept).select("key", "start").toArrow()
    sample = sorted(zip(found.column("key").to_pylist(), found.column("start").to_pylist(), strict=True))
    return sorted({sample[k * len(sample) // n] for k in range(1, n)}) if sample else []


def _dealt(places: list[tuple[int, bytes]], firsts: list[tuple[int, bytes] | None]):
    """Rows (doc_id, key, start, text) with their range as part; and again, as a guest, the first of a range to the one before that has rows."""
    before, last = {}, max((p for p, f in enumerate(firsts) if f is not None), default=0)
    for p, first in enumerate(firsts):
        if first is not None:
            before[first], last = last, p

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots = list(zip(batch.column("key").to_pylist(), batch.column("start").to_pylist(), strict=True))
            part = pa.array([bisect_right(places, x) for x in spots], pa.int32())
            names = ["part", "doc_id", "guest", "key", "text"]
            yield pa.RecordBatch.from_arrays([part, batch.column("doc_id"), pa.array(np.zeros(len(batch), bool)), batch.column("key"), batch.column("text")], names)
            again = [k for k, x in enumerate(spots) if x in before]
            if again:
                own = batch.take(pa.array(again))
                yield pa.RecordBatch.from_arrays([pa.array([before[spots[k]] for k in again], pa.int32()), own.column("doc_id"), pa.array(np.ones(len(again), bool)), own.column("key"), own.column("text")], names)

    return run


def fingerprints(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """Fingerprints of every row of docs (doc_id, text), of its edited text, and their likeness to each other and to the next row's.

    One shuffle deals rows to ranges of (doc_id, beginning of the text); each range also gets the first row of the next,
    as a guest. Only a bounded sample of places, some for each range, and one for each range pass through the driver.
    """
    if scale & (scale - 1) or not 2 <= scale <= 1 << 16:
        raise ValueError("scale must be a power of two from 2 to 65536")
    spark = docs.sparkSession
    runtime.ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), runtime.text_or_empty().alias("text")).withColumn("key", F.coalesce("doc_id", F.lit(_FIRST)))
    rows = rows.withColumn("start", F.encode(F.left("text", F.lit(PLACE_CHARS)), "UTF-8"))
    n = max(rows.rdd.getNumPartitions(), 2 * spark.sparkContext.defaultParallelism)
    places = _places(rows.select("key", "start"), n)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, tuple[int, bytes]] = {}
        for batch in batches:
            for x in zip(batch.column("key").to_pylist(), batch.column("start").to_pylist(), strict=True):
                p = bisect_right(places, x)
                if p not in own or x < own[p]:
                    own[p] = x
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), pa.array([x[0] for x in own.values()], pa.int64()), pa.array([x[1] for x in own.values()], pa.binary())], ["part", "key", "start"])

    found = rows.select("key", "start").mapInArrow(runtime.lean(least), "part int, key long, start binary").groupBy("part").agg(F.min(F.struct("key", "start")).alias("first"))
    firsts: list[tuple[int, bytes] | None] = [None] * (len(places) + 1)
    for r in found.collect():
        firsts[r["part"]] = (r["first"]["key"], bytes(r["first"]["start"]))
    # a range's guests come after its own rows: the last one's guest is the first row of all
    dealt = rows.select("doc_id", "key", "start", "text").mapInArrow(runtime.lean(_dealt(places, firsts)), "part int, doc_id long, guest boolean, key long, text string")
    dealt = dealt.repartition(n, "part").sortWithinPartitions("part", "guest", "key", "text").select("part", "doc_id", "guest", "text")
    return dealt.mapInArrow(runtime.lean(_follow(scale)), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, held_in_next double")
