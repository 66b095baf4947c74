"""Line dedup by a deletion-neighbourhood join (operator 9).

Lines are the parts of a text between newlines; their words are split at white space, A-Z in lower case. Two lines
are duplicates when they are equal, or one edit apart: one word inserted, deleted or replaced, which may be no more
than 1 / min_words of the longer line. A line goes when an earlier line, by (doc_id, line number), is its duplicate;
blank lines stay.

Equal lines form one class with its earliest place. Each class emits the variants within the bound as hashed keys:
with word i left out, once with i (equal keys: one word replaced) and once without (met by the shorter line's own
key: one word inserted). Members of a key are duplicates of each other, so one aggregate for each key gives every
member its earliest neighbour; no pairs are made within a key. The edit distance of each class that is to go and
its neighbour is verified on their words. Only classes that share the first or the last half of their words with
another class emit variants: one edit leaves one half alone, so no duplicate is missed.

Nulls in text stay null and hold no lines; rows with a null doc_id stand at places of their own by a hash of their
text, before all doc_ids from -2**62 on; rows that repeat a doc_id, or a text without one, stand at the same places: where they hold equal lines at equal numbers all of them keep or lose them together, and a number
that any of them keeps is kept by all. An empty table gives an empty result. All columns of the input are returned,
whatever their names, but for old ones named n_lines or n_removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quire.llm import runtime
from quire.llm.shingles import _BASE, _INVERSE, _WHITE, _fixed, _powers, mix, word_spans

#: A line of so many words may differ by one of them.
MIN_WORDS = 8
_U = np.uint64
_TAGS = _fixed(8, 907)
_SLICE = 1 << 18
_tables = {"n": 0}


def _tabled(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the inverse base, and a value for each place."""
    if _tables["n"] < n:
        m = max(n, 1 << 16)
        _tables.update(n=m, down=_powers(_INVERSE, m), place=_fixed(m, 331))
    return _tables["down"], _tables["place"]


class Lines:
    """Hashed words of many lines, and prefix sums from which any variant's hash is read."""

    def __init__(self, lines: list[bytes]):
        sums, down, first, last, self.n = word_spans(lines, _WHITE)
        words = mix((sums[last] - sums[first - 1]) * down[first])
        self.at = np.concatenate(([0], np.cumsum(self.n)))
        up = _powers(_BASE, len(words) + 1)
        self.down, self.place = _tabled(len(words) + 1)
        self.sums = np.concatenate((np.zeros(1, _U), np.cumsum(words * up[: len(words)])))

    def span(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Polynomials over words a..b - 1."""
        return (self.sums[b] - self.sums[a]) * self.down[a]

    def tagged(self, h: np.ndarray, kind: int, n: np.ndarray) -> np.ndarray:
        return mix(h + _TAGS[kind] + n.astype(_U) * _TAGS[7])

    def own(self) -> np.ndarray:
        return self.tagged(self.span(self.at[:-1], self.at[1:]), 0, self.n)

    def halves(self) -> np.ndarray:
        """Four keys of each line: with m words of the shorter line of a pair, its first m // 2 and its last m - m // 2."""
        out = np.empty((len(self.n), 4), _U)
        for k, m in enumerate((self.n, np.maximum(self.n - 1, 0))):
            a, b = self.at[:-1], self.at[1:]
            out[:, 2 * k] = self.tagged(self.span(a, a + m // 2), 1, m)
            out[:, 2 * k + 1] = self.tagged(self.span(b - (m - m // 2), b), 2, m)
        return out

    def variants(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, key with the place, key without it) of each word left out."""
        line = np.repeat(np.arange(len(self.n)), self.n)
        i = np.arange(self.at[-1])
        a, b = self.at[:-1][line], self.at[1:][line]
        left = self.sums[i] - self.sums[a]
        right = (self.sums[b] - self.sums[i + 1]) * _U(_INVERSE)
        h = (left + right) * self.down[a]
        n = self.n[line] - 1
        return line, mix(self.tagged(h, 3, n) ^ self.place[i - a]), self.tagged(h, 0, n)


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, texts = batch.column("key"), batch.column("text").cast(pa.binary())
        held: list[bytes] = []
        owner: list[int] = []
        number: list[np.ndarray] = []
        size = 0
        for k in range(len(batch)):
            if not texts[k].is_valid:
                continue
            raw = texts[k].as_py()
            lines = raw.split(b"\n")
            held += lines
            owner += [k] * len(lines)
            number.append(np.arange(len(lines)))
            size += len(raw)
            if size >= _SLICE:
                yield _made(keys, held, owner, number)
                held, owner, number, size = [], [], [], 0
        if held:
            yield _made(keys, held, owner, number)


def _made(keys: pa.Array, held: list[bytes], owner: list[int], number: list[np.ndarray]) -> pa.RecordBatch:
    lines = Lines(held)
    full = np.flatnonzero(lines.n)
    halves = lines.halves()[full].view(np.int64)
    sizes = np.arange(0, 4 * len(full) + 1, 4, dtype=np.int32)
    return pa.RecordBatch.from_arrays(
        [keys.take(pa.array(np.array(owner)[full])), pa.array(np.concatenate(number)[full].astype(np.int32)), pa.array(lines.own()[full].view(np.int64)), pa.array(lines.n[full].astype(np.int32)), pa.ListArray.from_arrays(pa.array(sizes), pa.array(halves.reshape(-1)))],
        ["key", "line", "h", "n", "halves"],
    )


def _variant_rows(min_words: int):
    """For the live lines of each text: their words, and one row (kind, key) for each variant. kind 0: one word replaced; 1: own; 2: one word left out.

    A line of fewer than min_words words has its own key only: it can have duplicates that are longer by a word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for k in range(len(batch)):
                if not texts[k].is_valid:
                    continue
                key, raw = batch.column("key")[k].as_py(), texts[k].as_py().split(b"\n")
                numbers = sorted({x for x in batch.column("lines")[k].as_py() if x < len(raw)})
                for at in range(0, len(numbers), 256):
                    own = numbers[at : at + 256]
                    lines = Lines([raw[x] for x in own])
                    h = lines.own().view(np.int64)
                    line, placed, bare = (x[np.repeat(lines.n >= min_words, lines.n)] for x in lines.variants())
                    n, m = len(own), len(line)
                    every = np.concatenate((np.arange(n), line, line))
                    kind = np.repeat(np.array([1, 0, 2], np.int8), [n, m, m])
                    keys = np.concatenate((lines.own(), placed, bare)).view(np.int64)
                    words = [b" ".join(raw[x].split()).lower().decode() for x in own]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(kind), pa.array(keys), pa.array(h[every]), pa.array(np.full(len(every), key)), pa.array(np.array(own, np.int32)[every]), pa.array(words + [None] * (2 * m), pa.string())],
                        ["kind", "k", "h", "key", "line", "words"],
                    )

    return run


def one_edit(a: list[str], b: list[str]) -> bool:
    """Whether two lists of words are at most one insertion, deletion or replacement apart."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :]
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = [one_edit(a.split(" "), b.split(" ")) for a, b in zip(batch.column("words").to_pylist(), batch.column("other").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("h").filter(pa.array(good, pa.bool_()))], ["h"])


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose first column is text and whose last are the kept lines."""
    for batch in batches:
        texts, kept = batch.column(0), batch.column("kept_lines")
        out, n_lines, n_gone = [], [], []
        for k in range(len(batch)):
            text = texts[k].as_py()
            if text is None:
                out.append(None), n_lines.append(0), n_gone.append(0)
                continue
            lines, keep = text.split("\n"), set(kept[k].as_py() or ())
            own = [x for i, x in enumerate(lines) if i in keep or not x.strip(" \t\r\x0b\x0c")]
            out.append("\n".join(own)), n_lines.append(len(lines)), n_gone.append(len(lines) - len(own))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *batch.columns[1:-1], pa.array(n_lines, pa.int64()), pa.array(n_gone, pa.int64())], [*batch.schema.names[:-1], "n_lines", "n_removed"])


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the lines that are to go taken out of text, and n_lines, n_removed (long) for each row."""
    spark = docs.sparkSession
    runtime.ship(spark)
    docs, back = runtime.aside(docs, "doc_id", "text")
    keyed = docs.withColumn("text", F.col("text").cast("string")).withColumn("quire_key", runtime.row_key())
    texts = keyed.select(F.col("quire_key").alias("key"), "text")
    lines = runtime.written(texts.mapInArrow(runtime.lean(_line_rows), "key long, line int, h long, n int, halves array<long>"), "lines")
    classes = runtime.written(lines.groupBy("h").agg(F.min(F.struct("key", "line")).alias("first"), F.max("n").alias("n")), "line-classes")

    halves = lines.filter(F.col("n") >= min_words - 1).select(F.explode("halves").alias("half"), "h")
    shared = halves.groupBy("half").agg(F.min("h").alias("a"), F.max("h").alias("b")).filter("a <> b").select("half")
    live = halves.join(shared, "half", "left_semi").select("h").distinct()
    places = classes.join(live, "h", "left_semi").groupBy(F.col("first.key").alias("key")).agg(F.collect_list("first.line").alias("lines"))
    variants = runtime.written(
        texts.join(places, "key").mapInArrow(runtime.lean(_variant_rows(min_words)), "kind byte, k long, h long, key long, line int, words string"),
        "line-variants",
    )
    runtime.discard(lines)  # all that is read from it is written
    place = F.struct("key", "line", "h")
    # kinds 1 and 2 meet in one key; kind 0 keeps its own
    grouped = variants.groupBy((F.col("kind") == 0).alias("replaced"), "k").agg(
        F.min(F.when(F.col("kind") == 1, place)).alias("whole"), F.min(F.when(F.col("kind") != 1, place)).alias("part"), F.min("h").alias("a"), F.max("h").alias("b")
    )
    grouped = grouped.filter((F.col("a") != F.col("b")) & (F.col("replaced") | (F.col("whole").isNotNull() & F.col("part").isNotNull()))).select("replaced", "k", "whole", "part")
    met = variants.select("kind", "k", "h", "key", "line", (F.col("kind") == 0).alias("replaced")).join(grouped, ["replaced", "k"])
    other = F.when(F.col("kind") == 2, F.col("whole")).otherwise(F.col("part"))
    earlier = met.withColumn("other", other).filter(F.struct("other.key", "other.line") < F.struct("key", "line")).groupBy("h").agg(F.min("other").alias("other"))
    words = variants.filter("kind = 1").select("h", "words")
    pairs = earlier.select("h", F.col("other.h").alias("other_h")).join(words, "h").join(words.select(F.col("h").alias("other_h"), F.col("words").alias("other")), "other_h")
    gone = pairs.select("h", "words", "other").mapInArrow(runtime.lean(_verified), "h long")
    kept = classes.join(gone, "h", "left_anti").groupBy(F.col("first.key").alias("quire_key")).agg(F.collect_list("first.line").alias("kept_lines"))
    both = keyed.join(kept, "quire_key", "left").select("text", "doc_id", *[c for c in docs.columns if c not in ("text", "doc_id")], "kept_lines")
    fields = [f for f in both.schema.fields if f.name != "kept_lines"]
    out = both.mapInArrow(runtime.lean(_rebuilt), StructType([*fields, StructField("n_lines", LongType()), StructField("n_removed", LongType())]))
    return back(out, "n_lines", "n_removed")
