"""Mixing sources to target weights by Pfair scheduling (operator 6), in DataFrame functions only.

Every source's rows, by doc_id, are cut into blocks of block_bytes of text: a row belongs to the block in which it
starts. With integer weights a that sum to D, block i of a source may not run before slot floor((i - 1) * D / a) and
must run by slot ceil(i * D / a); earliest deadline first fills one slot after another. The schedule repeats after D
slots. After any number of slots each source has had less than one block more or less than its weight says, as long
as all sources have blocks left; no row is dropped: a source that has run out leaves its slots empty. Rows run by
(slot, seq); on_target says whether the slot lies before the first source runs out.

Of equal deadlines the sources of weights over 1 come first, by name, then those of weight 1, in the order of the MD5
of their names. A source of weight 1 has the whole cycle for its one block, so these take the slots that the others
leave, one after another: only the weights that are given above 1 are laid out on the driver, as many slots as they
sum to, and there may be any number of other sources. (With a default weight over 1 all sources are laid out there.)

Sizes are bytes of text plus one (null: one); seq is the row's offset in its block. A null source is a source of its
own; a source without a weight has default_weight; a source of weight 0 runs after the others, in slots from the end
on. Rows with a null doc_id come first in their source; equal doc_ids are ordered by size and checksum; repeated rows
have a place each. An empty table gives an empty result. All columns of the input are returned, but for old ones of
the names that are added.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import runtime

BLOCK_BYTES = 65_536
#: Pieces that the range of doc_ids is cut into, at least, and rows for each piece beyond that.
PIECES, PIECE_ROWS = 200, 1_000_000
NO_SOURCE = "\x00"
ADDED = ("block", "slot", "seq", "on_target")


def cycle(weights: list[int], total: int) -> list[list[int]]:
    """The slots of each of the weights in a cycle of total slots: earliest deadline first among the released blocks. What they leave is free."""
    waiting = [(0, k, 1) for k, a in enumerate(weights) if a]  # (release, source, block)
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []  # (deadline, source, block)
    out: list[list[int]] = [[] for _ in weights]
    t = 0
    while waiting or ready:
        t = t if ready else max(t, waiting[0][0])
        while waiting and waiting[0][0] <= t:
            _, k, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-i * total // weights[k]), k, i))
        deadline, k, i = heapq.heappop(ready)
        if deadline <= t:
            raise AssertionError("a block missed its deadline")
        out[k].append(t)
        if i < weights[k]:
            heapq.heappush(waiting, (i * total // weights[k], k, i + 1))
        t += 1
    return out


def _at_or_below(cuts: list[int], value: Column) -> Column:
    """How many of the sorted cuts are at or below a value, looked up in two steps."""
    step = max(1, math.isqrt(len(cuts)))
    coarse = F.size(F.filter(F.lit(cuts[::step]), lambda x: x <= value))
    fine = F.array(*[F.lit(cuts[k : k + step]) for k in range(0, len(cuts), step)])
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + F.size(F.filter(F.element_at(fine, coarse), lambda x: x <= value)))


def _running(rows: DataFrame, n_rows: int) -> DataFrame:
    """rows (its, at, size, check) with before: the sum of size over earlier rows of the same its. A large group is cut at quantiles of at, so no task sorts it whole."""
    n = max(PIECES, -(-n_rows // PIECE_ROWS))
    cuts = sorted(set(rows.agg(F.percentile_approx("at", [k / n for k in range(1, n)], 20 * n).alias("cuts")).first()["cuts"] or []))
    rows = rows.withColumn("piece", _at_or_below(cuts, F.col("at")) if cuts else F.lit(0))
    sums = rows.groupBy("its", "piece").agg(F.sum("size").alias("sum"))
    ahead = Window.partitionBy("its").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("its", "piece", F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("base"))
    within = Window.partitionBy("its", "piece").orderBy("at", "size", "check").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return rows.join(sums, ["its", "piece"]).withColumn("before", F.col("base") + F.col("inside"))


def _schedule(sources: DataFrame) -> tuple[DataFrame, int]:
    """(its, n, weight, places) of sources (its, n, weight), places being a source's slots in the cycle; and the length of the cycle."""
    spark = sources.sparkSession
    heavy = [(r["its"], r["weight"]) for r in sources.filter("weight > 1").orderBy("its").select("its", "weight").collect()]
    total = sum(a for _, a in heavy) + sources.filter("weight = 1").count()
    places = cycle([a for _, a in heavy], total)
    # the j-th free slot has behind it all taken slots of which no more than j free ones lie before
    ahead = [slot - i for i, slot in enumerate(sorted(x for own in places for x in own))]
    bucket = F.substring(F.md5(F.encode("its", "UTF-8")), 1, 3)
    light = sources.filter("weight = 1").withColumn("bucket", bucket)
    sums = light.groupBy("bucket").agg(F.count("*").alias("m"))
    sums = sums.select("bucket", F.coalesce(F.sum("m").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    own = F.row_number().over(Window.partitionBy("bucket").orderBy(F.md5(F.encode("its", "UTF-8")), "its")) - 1
    light = light.withColumn("own", own).join(sums, "bucket").withColumn("j", F.col("first") + F.col("own"))
    slot = F.col("j") + (_at_or_below(ahead, F.col("j")) if ahead else F.lit(0))
    light = light.select("its", "n", "weight", F.array(slot.cast("long")).alias("places"))
    none = sources.filter("weight = 0").select("its", "n", "weight", F.array(F.lit(0).cast("long")).alias("places"))
    table = spark.createDataFrame([(s, p) for (s, _), p in zip(heavy, places, strict=True)], "its string, places array<long>")
    return sources.filter("weight > 1").join(table, "its").unionByName(light).unionByName(none), total


def mix(docs: DataFrame, weights: dict[str | None, int], default_weight: int = 1, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with block, slot, seq (long) and on_target (boolean)."""
    if min([default_weight, *weights.values()]) < 0:
        raise ValueError("weights must be 0 or more")
    spark = docs.sparkSession
    docs = docs.drop(*[c for c in ADDED if c in docs.columns])
    own = {c: F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)}  # no name of the input meets one of ours
    rows = docs.select(
        F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE)).alias("its"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("at"),
        (F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")).alias("check"),
        *own.values(),
    )
    given = spark.createDataFrame([(NO_SOURCE if s is None else s, int(a)) for s, a in weights.items()], "its string, given long")
    sizes = rows.groupBy("its").agg(F.sum("size").alias("n"), F.count("*").alias("n_rows"))
    sources = runtime.written(sizes.join(given, "its", "left").select("its", "n", "n_rows", F.coalesce("given", F.lit(default_weight)).cast("long").alias("weight")), "sources")
    scheduled, total = _schedule(sources.drop("n_rows"))
    scheduled = runtime.written(scheduled, "schedule")
    blocks = F.floor((F.col("n") - 1) / block_bytes) + 1
    running = F.col("weight") > 0
    a = F.greatest("weight", F.lit(1))
    out = F.floor(blocks / a) * total + F.element_at("places", (blocks % a + 1).cast("int"))
    whole = scheduled.agg(F.min(F.when(running, out)).alias("until"), F.max(F.when(running, F.ceil(blocks / a) * total)).alias("last")).first()
    until, last = whole["until"] or 0, whole["last"] or 0
    n_rows = sources.agg(F.sum("n_rows")).first()[0] or 0
    placed = _running(rows, n_rows).withColumn("block_", F.floor(F.col("before") / F.lit(block_bytes)).cast("long")).join(scheduled.select("its", "weight", "places"), "its")
    turn = F.floor(F.col("block_") / a).cast("long")
    slot = F.when(running, turn * total + F.element_at("places", (F.col("block_") % a + 1).cast("int"))).otherwise(F.lit(last).cast("long") + F.col("block_")).cast("long")
    seq = F.col("before") - F.col("block_") * F.lit(block_bytes)
    return placed.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)], F.col("block_").alias("block"), slot.alias("slot"), seq.alias("seq"), (slot < F.lit(until)).alias("on_target"))


def shares(weights: dict[str | None, float], slots: int = 1000) -> dict[str | None, int]:
    """Integer weights that sum to slots, by largest remainder."""
    whole = sum(weights.values())
    exact = {s: w * slots / whole for s, w in weights.items()}
    out = {s: int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (out[s] - exact[s], str(s)))[: slots - sum(out.values())]:
        out[s] += 1
    return out
