"""Exact dedup by skew-safe combining (operator 12): equal contents find each other in three steps, none of which meets a whole group.

1. Local: each task cuts its rows into blocks of bounded bytes and rows. Rows of a block whose digests are equal and
   whose contents are, byte by byte, form a local group; its first row carries the content, packed, and the group's
   size and best row. Copies within a block go no further.
2. Salted: local groups are dealt by (salt, digest, content). The salt is the block's, and there are about as many as
   the square root of the input's partitions, so a text that all blocks hold is merged in that many places at once.
3. Global: the winners of the salts are dealt by (digest, content); a group has no more of them than there are salts.

Every step compares whole contents: bytes in step 1, packed bytes in 2 and 3, where one codec packs equal contents
alike. Contents travel twice, once a local group and once a salt's winner; rows travel without them and learn their
class by their local group, which is no larger than a block.

Results for odd rows: a null text counts as an empty one; rows that repeat a doc_id count each for themselves; of rows
that are equal in length and doc_id the first in the input's order stays; a row without a doc_id stays only where all of
its group have none longer or with an id. An empty table gives an empty result. Other columns come through, whatever their
names, but for old ones named keep_id, group_size, kept or text_sha256.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType, StructField, StructType

from quire.llm import runtime

BLOCK_BYTES, BLOCK_ROWS = 32 << 20, 1 << 16
#: What is deleted before texts are compared.
BLANK = bytes([0x20, *range(0x09, 0x0E)])
BEST = StructType([StructField("less", LongType()), StructField("unnamed", BooleanType()), StructField("id", LongType()), StructField("place", LongType())])
_ADDED = StructType([StructField("local", LongType()), StructField("place", LongType()), StructField("digest", BinaryType()), StructField("packed", BinaryType()), StructField("n", LongType()), StructField("best", BEST)])


def without_blanks(content: bytes) -> bytes:
    return content.translate(None, BLANK)


def same(content: bytes) -> bytes:
    return content


class Block:
    """Rows of one task until a bound of bytes or rows, with the groups of equal contents among them."""

    def __init__(self, number: int, digest_bytes: int):
        self.base, self.digest_bytes = number * BLOCK_ROWS, digest_bytes
        self.batches: list[pa.RecordBatch] = []
        self.met: dict[bytes, list[int]] = {}
        self.contents: list[bytes] = []
        self.best: list[tuple] = []
        self.sizes: list[int] = []
        self.first: list[int] = []
        self.group: list[int] = []
        self.digests: list[bytes] = []
        self.bytes = 0

    def add(self, content: bytes, chars: int, id_: int | None) -> None:
        digest, at = hashlib.sha256(content).digest(), len(self.group)
        near = self.met.setdefault(digest[: self.digest_bytes], [])
        group = next((g for g in near if self.contents[g] == content), None)
        rank = (-chars, id_ is None, id_ or 0, self.base + at)
        if group is None:
            group = len(self.contents)
            near.append(group)
            self.contents.append(content), self.best.append(rank), self.sizes.append(0), self.first.append(at)
            self.bytes += len(content)
        self.best[group] = min(self.best[group], rank)
        self.sizes[group] += 1
        self.group.append(group)
        self.digests.append(digest)

    def full(self) -> bool:
        return self.bytes >= BLOCK_BYTES or len(self.group) >= BLOCK_ROWS

    def rows(self) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in self.batches:
            span = range(at, at + len(batch))
            at += len(batch)
            own = [g if self.first[g] == k else None for k, g in zip(span, self.group[span.start : span.stop])]
            best = [None if g is None else dict(zip(BEST.names, (*self.best[g][:2], None if self.best[g][1] else self.best[g][2], self.best[g][3]))) for g in own]
            added = [
                pa.array([self.base + self.first[g] for g in self.group[span.start : span.stop]], pa.int64()), pa.array([self.base + k for k in span], pa.int64()),
                pa.array(self.digests[span.start : span.stop], pa.binary()), pa.array([None if g is None else pa.compress(self.contents[g], "zstd", asbytes=True) for g in own], pa.binary()),
                pa.array([None if g is None else self.sizes[g] for g in own], pa.int64()), pa.array(best, pa.struct([("less", pa.int64()), ("unnamed", pa.bool_()), ("id", pa.int64()), ("place", pa.int64())])),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *_ADDED.names])


def _local(content: Callable[[bytes], bytes], digest_bytes: int):
    """Rows (content, chars, id, …) to rows (…) with local, place, digest and, on the first of each local group, packed, n and best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 22
        block = Block(number, digest_bytes)
        for batch in batches:
            rest = [k for k, name in enumerate(batch.schema.names) if name not in ("content", "chars", "id")]
            names = [batch.schema.names[k] for k in rest]
            contents, chars, ids, began = batch.column("content"), batch.column("chars").to_pylist(), batch.column("id").to_pylist(), 0
            for k in range(len(batch)):
                block.add(content(contents[k].as_py()), chars[k], ids[k])
                if block.full() or k + 1 == len(batch):
                    block.batches.append(pa.RecordBatch.from_arrays([batch.column(x).slice(began, k + 1 - began) for x in rest], names))
                    began = k + 1
                    if block.full():
                        yield from block.rows()
                        number += 1
                        block = Block(number, digest_bytes)
        yield from block.rows()

    return run


def local_groups(rows: DataFrame, content: Callable[[bytes], bytes] = same, digest_bytes: int = 32, name: str = "exact-local") -> DataFrame:
    """Step 1 over rows (content binary, chars long, id long, …), written: content and chars stay behind. digest_bytes under 32 tells fewer contents apart before they are compared."""
    runtime.ship(rows.sparkSession)
    kept = [f for f in rows.schema.fields if f.name not in ("content", "chars", "id")]
    return runtime.written(rows.mapInArrow(runtime.lean(_local(content, digest_bytes)), StructType([*kept, *_ADDED.fields])), name)


def classes(groups: DataFrame, salts: int) -> DataFrame:
    """Steps 2 and 3 over the result of step 1: local, class (one for each content: the least local group that has it), n, best."""
    block = F.shiftrightunsigned("local", int(math.log2(BLOCK_ROWS)))
    held = groups.filter("packed is not null").select("local", "digest", "packed", "n", "best", F.pmod(F.xxhash64(block), F.lit(salts)).alias("salt"))
    in_salt = Window.partitionBy("salt", "digest", "packed")
    salted = held.select("local", "digest", "packed", F.min("local").over(in_salt).alias("winner"), F.sum("n").over(in_salt).alias("n"), F.min("best").over(in_salt).alias("best"))
    # true of all rows: with it both readers ask for the same columns, and Spark deals the contents out once for both
    salted = salted.filter("n > 0 and best is not null")
    over_all = Window.partitionBy("digest", "packed")
    winners = salted.filter("local = winner").select("winner", F.min("winner").over(over_all).alias("class"), F.sum("n").over(over_all).alias("n"), F.min("best").over(over_all).alias("best"))
    return salted.select("local", "winner").join(winners, "winner").drop("winner")


def salts_of(df: DataFrame) -> int:
    """So many that a content of all partitions meets as many groups in each salt as there are salts."""
    return max(4, math.isqrt(df.rdd.getNumPartitions()))


def exact_dedup(docs: DataFrame, content: Callable[[bytes], bytes] = without_blanks, with_text: bool = True, digest_bytes: int = 32) -> DataFrame:
    """docs with keep_id (doc_id of the row that stays), group_size (long), kept (boolean) and text_sha256 of each row's normalised text.

    The longest original text in code points stays, of these the smallest doc_id. filter("kept") is the deduplicated
    table; with_text=False leaves texts behind where only the decision is wanted.
    """
    held, back = runtime.aside(docs, "doc_id", "text")
    text = runtime.text_or_empty().cast("string")
    id_ = F.col("doc_id").cast("long")
    rows = held.select(*[c for c in held.columns if c != "text" or with_text], F.encode(text, "UTF-8").alias("content"), F.char_length(text).cast("long").alias("chars"), id_.alias("id"))
    groups = local_groups(rows, content, digest_bytes)
    found = groups.drop("packed", "n", "best").join(classes(groups, salts_of(docs)), "local")
    out = found.select(
        *[c for c in held.columns if c in found.columns], F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("best.place") == F.col("place")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )
    return back(out, "keep_id", "group_size", "kept", "text_sha256") if with_text else back(out.withColumn("text", F.lit(None).cast("string")), "keep_id", "group_size", "kept", "text_sha256").drop("text")
