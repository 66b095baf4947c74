"""Incremental maintenance of a full outer join by recomputing the affected keys (operator 11).

Each side is a log of signed rows (batch, join_key, part, n): batch 0 is the first state, later ones add (n > 0) and
take away (n < 0) copies of rows. A side's state before a batch is the sum of what the log holds of earlier batches.
For one batch:

1. The keys of both sides' deltas are collected once each.
2. Both sides' logs are semi-joined to these keys and summed by (join_key, part), to the counts before and after the
   batch. Rows of other keys are read, dropped at once and never joined.
3. Both states are outer-joined as multisets: a pair of parts has as many copies as the product of both counts, a part
   without a partner its own count. Equal rows are one row with a count before they meet, so copies are not expanded.
4. After minus before, summed by joined row, is the change; what is zero is left out.

The outer join is a left join and the other side's rows without a partner, as Spark splits a skewed side of those two,
and of no full outer join. Nothing is broadcast: a batch's keys grow with the input, so all joins are sort-merge joins.

Results for odd rows: rows whose join_key is null have no partner, as in SQL, and are kept, padded; they are affected
by deltas of null keys only. A null part is a part, other than the padding of a missing side. Repeated rows are copies.
A batch without deltas, or an empty log, gives an empty result. Copies that are taken away and were never there count
as negative ones until they come. Other columns than the four are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import runtime

LOG = ("batch", "join_key", "part", "n")


def log_of(rows: DataFrame, versions: list[tuple[Column, Column, Column]], name: str) -> DataFrame:
    """The log of rows that change by rule: for each batch, from 0 on, (whether the row is present, its key, its part), written."""
    entries, before = [], None
    for batch, (present, key, part) in enumerate(versions):
        entry = lambda sign, x: F.struct(F.lit(batch).alias("batch"), x[1].cast("long").alias("join_key"), x[2].alias("part"), F.lit(sign).cast("long").alias("n"))  # noqa: E731, B023
        if before is None:
            entries.append(F.when(present, entry(1, versions[0])))
        else:
            moved = ~(key.eqNullSafe(before[1]) & part.eqNullSafe(before[2]))
            entries.append(F.when(before[0] & (~present | moved), entry(-1, before)))
            entries.append(F.when(present & (~before[0] | moved), entry(1, (present, key, part))))
        before = (present, key, part)
    out = rows.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).select("e.*")
    return runtime.written(out.groupBy("batch", "join_key", "part").agg(F.sum("n").alias("n")), name)


def affected(left_delta: DataFrame, right_delta: DataFrame) -> DataFrame:
    """Each key that a delta of either side touches, once."""
    return left_delta.select("join_key").unionByName(right_delta.select("join_key")).distinct()


def touched(state: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of a state whose keys are affected."""
    keys = keys.select(F.col("join_key").alias("touched_key")).hint("merge")
    return state.join(keys, F.col("join_key").eqNullSafe(F.col("touched_key")), "left_semi")


def outer(left: DataFrame, right: DataFrame) -> DataFrame:
    """join_key, left_part, right_part, copies of the full outer join of two multisets (join_key, part, n); a missing side's part is null, a part is in a struct."""
    l = left.select("join_key", F.struct("part").alias("left_part"), F.col("n").alias("left_n"))  # noqa: E741
    r = right.select(F.col("join_key").alias("right_key"), F.struct("part").alias("right_part"), F.col("n").alias("right_n"))
    met = l.join(r.hint("merge"), F.col("join_key") == F.col("right_key"), "left")
    met = met.select("join_key", "left_part", "right_part", (F.col("left_n") * F.coalesce("right_n", F.lit(1))).alias("copies"))
    held = l.select("join_key").distinct().hint("merge")
    alone = r.join(held, F.col("join_key") == F.col("right_key"), "left_anti")
    kind = met.schema["left_part"].dataType
    return met.unionByName(alone.select(F.col("right_key").alias("join_key"), F.lit(None).cast(kind).alias("left_part"), "right_part", F.col("right_n").alias("copies")))


def states(log: DataFrame, keys: DataFrame, batch: int) -> DataFrame:
    """join_key, part, before and after: the counts of the affected rows around a batch, in one sum over the log, written."""
    rows = touched(log.filter(F.col("batch") <= batch), keys)
    sums = rows.groupBy("join_key", "part").agg(F.sum(F.when(F.col("batch") < batch, F.col("n")).otherwise(0)).alias("before"), F.sum("n").alias("after"))
    return runtime.written(sums, "join-states")


def changes(left: DataFrame, right: DataFrame, batch: int) -> DataFrame:
    """What a batch changes in the join of two logs, written: batch, join_key, left_part, right_part (structs of part, null for padding), weight (copies after minus before), total (copies after)."""
    keys = affected(*[x.filter(F.col("batch") == batch) for x in (left, right)])
    both = [states(x, keys, batch) for x in (left, right)]
    before, after = ([x.filter(F.col(at) != 0).select("join_key", "part", F.col(at).alias("n")) for x in both] for at in ("before", "after"))
    gone = outer(*before).withColumn("signed", -F.col("copies")).withColumn("copies", F.lit(0).cast("long"))
    come = outer(*after).withColumn("signed", F.col("copies"))
    signed = gone.unionByName(come).groupBy("join_key", "left_part", "right_part").agg(F.sum("signed").alias("weight"), F.sum("copies").alias("total"))
    out = runtime.written(signed.filter("weight <> 0").select(F.lit(batch).alias("batch"), "join_key", "left_part", "right_part", "weight", "total"), "join-changes")
    runtime.discard(*both)
    return out


def maintained(left: DataFrame, right: DataFrame, batches: list[int]) -> DataFrame:
    """changes() of several batches in turn; each batch's changes are a table before the next one is looked at."""
    return reduce(DataFrame.unionByName, [changes(left, right, b) for b in batches])
