"""The prefix trie of a table of conversations (operator 13): each distinct beginning of a conversation is a node.

contents() gives every turn its place in its conversation and an exact id of its (role, text), by the combining of
exact_dedup: texts are compared there and stay behind. trie() works on rows (conv_id, depth, content, size):

1. Rows sorted by (conv_id, depth) in ranges are scanned by numpy: a turn's fingerprint is that of the prefix before it
   plus its content's value times the base to the power of its depth, in two prime fields. A sum goes on over a
   border of ranges by an offset, so no conversation has to lie in one task.
2. Rows with the same (depth, fingerprint) are candidates for one node. Its representative is its smallest conv_id; all
   others are held against it turn by turn: a node holds when the least and the greatest of its contents, and of its
   parents' fingerprints, are the same. As that is asked at every depth, all of their turns are then equal.
   Groups in which it fails are split by (content, parent), which splits those below in the next pass, until all hold.
3. Rollup: a node stands in the row of its representative at its depth. What a subtree sums up is, for every member
   of its top, the sum of the member's rows from that depth on, so one running sum from the ends of the conversations
   and one aggregate by node give all subtrees at once, with as many passes for deep tries as for flat ones.

The ids of the conversations that end in a node are packed into pieces in sorted order before they meet; the hash
itself reads them one after another, in one stream of bounded memory a node.

Results for odd rows: a null role or text is an empty one; a null turn comes before all others; equal turns of one
conversation are put in order by role and digest of (role, text), equal rows are turns of their own; rows without a
conv_id belong to no conversation and are left out. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import exact_dedup, runtime

#: Two fields of this many elements; their bases.
MODULUS, BASES = (1 << 31) - 1, (1_103_515_245, 1_664_525_017)
CHUNK_BYTES = 1 << 16
_U = np.uint64


def _parts(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv_id, content, size) with part and at: the place among this part's rows of the conversation, from 1."""
    from pyspark import TaskContext

    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        conv = batch.column("conv_id").to_numpy()
        if not len(conv):
            continue
        first = np.concatenate(([True], conv[1:] != conv[:-1]))
        began = np.flatnonzero(first)
        run = np.cumsum(first) - 1
        at = np.arange(len(conv)) - began[run] + 1
        if conv[0] == last:
            at[run == 0] += seen
        last, seen = conv[-1], int(at[-1])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "content", "size")), pa.array(np.full(len(conv), part, np.int64)), pa.array(at.astype(np.int64))], ["conv_id", "content", "size", "part", "at"])


def _carried(rows: DataFrame, totals: dict[str, Column], modulus: int | None = None, after: bool = False) -> DataFrame:
    """rows (conv_id, part, …) with, for each total, its sum over the earlier (after: later) parts of the conversation, as before_<name>.

    Parts are ranges of (conv_id, …), so no more conversations go on over a border than there are parts: that bounds what is broadcast.
    """
    order = Window.partitionBy("conv_id").orderBy(F.desc("part") if after else "part").rowsBetween(Window.unboundedPreceding, -1)
    each = rows.groupBy("conv_id", "part").agg(*[c.alias(k) for k, c in totals.items()])
    own = lambda c: F.sum(c).over(order) if modulus is None else F.pmod(F.sum(c).over(order), F.lit(modulus))
    spans = each.select("conv_id", "part", *[own(k).alias(f"before_{k}") for k in totals]).filter(f"before_{next(iter(totals))} is not null")
    out = rows.join(F.broadcast(spans), ["conv_id", "part"], "left")
    return out.withColumns({f"before_{k}": F.coalesce(f"before_{k}", F.lit(0)).cast("long") for k in totals})


def contents(conversations: DataFrame, digest_bytes: int = 32) -> DataFrame:
    """Rows (conv_id, turn, role, text) to conv_id, position (from 1), content (the same long for equal (role, text), no other) and size (code points of text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    framed = F.encode(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), "UTF-8")
    size = F.char_length(text).cast("long")
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), size.alias("size"), framed.alias("content"), size.alias("chars"), F.lit(None).cast("long").alias("id"))
    groups = exact_dedup.local_groups(rows, digest_bytes=digest_bytes, name="trie-turns")
    told = groups.drop("packed", "n", "best").join(exact_dedup.classes(groups, exact_dedup.salts_of(conversations)).select("local", F.col("class").alias("content")), "local")
    # place tells equal rows apart, so that ranges can cut between them
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"), F.col("place")]
    ranged = told.repartitionByRange(_parts(conversations), *order).sortWithinPartitions(*order).select("conv_id", "content", "size")
    ranked = runtime.written(ranged.mapInArrow(runtime.lean(_positions), "conv_id long, content long, size long, part long, at long"), "trie-positions")
    return _carried(ranked, {"n": F.max("at")}).select("conv_id", (F.col("at") + F.col("before_n")).alias("position"), "content", "size")


def spliced(turns: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Conversations rebuilt on others' beginnings: conv_id, depth, content, size, with a row of depth 0 for each conversation.

    With h = crc32(conv_id in decimal) % most, the first h turns are those of conversation conv_id - conv_id % every, all
    if it has fewer, none if it is absent; the conversation's own turns after its first h follow.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(most))
    base = F.col("conv_id") - F.col("conv_id") % every
    heads = turns.filter((F.col("conv_id") % every == 0) & (F.col("position") < most))
    lengths = heads.groupBy(F.col("conv_id").alias("base")).agg(F.max("position").alias("n"))
    own = turns.filter(F.col("position") > h).withColumn("base", base).join(lengths, "base", "left")
    own = own.select("conv_id", (F.col("position") - h + F.least(h, F.coalesce("n", F.lit(0)))).alias("depth"), "content", "size")
    convs = turns.select("conv_id").distinct()
    taken = convs.select("conv_id", base.alias("base"), h.alias("h")).join(heads.withColumnRenamed("conv_id", "base"), "base").filter("position <= h")
    roots = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("content"), F.lit(0).cast("long").alias("size"))
    return own.unionByName(taken.select("conv_id", F.col("position").alias("depth"), "content", "size")).unionByName(roots)


def as_they_are(turns: DataFrame) -> DataFrame:
    """contents() as rows for trie(): depth is the position, and each conversation has its row of depth 0."""
    zero = F.lit(0).cast("long")
    return turns.select("conv_id", F.col("position").alias("depth"), "content", "size").unionByName(turns.select("conv_id").distinct().select("conv_id", zero.alias("depth"), zero.alias("content"), zero.alias("size")))


def powers(base: int, exponents: np.ndarray, modulus: int) -> np.ndarray:
    out, square, left = np.full(len(exponents), 1 % modulus, _U), base % modulus, exponents.astype(_U)
    while left.any():
        out = np.where(left & _U(1), out * _U(square) % _U(modulus), out)
        square, left = square * square % modulus, left >> _U(1)
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.int64).view(_U) + _U(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> _U(shift))) * _U(factor)
    return x ^ (x >> _U(31))


def _scanned(modulus: int):
    """Rows sorted by (conv_id, depth) with part, and for each field the fingerprint with (a, b) and without (a0, b0) the row's turn, over this part's rows of the conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, held = TaskContext.get().partitionId(), None, [0, 0]
        m = _U(modulus)
        for batch in batches:
            conv, depth = batch.column("conv_id").to_numpy(), batch.column("depth").to_numpy()
            if not len(conv):
                continue
            first = np.concatenate(([True], conv[1:] != conv[:-1]))
            began, run_ = np.flatnonzero(first), np.cumsum(first) - 1
            values, out = _mixed(batch.column("content").to_numpy()), []
            for k, base in enumerate(BASES):
                term = ((values >> _U(32 * k)) & _U(0xFFFFFFFF)) % m * powers(base, depth, modulus) % m
                term[depth == 0] = 0
                sums = np.cumsum(term)
                sums -= (sums[began] - term[began])[run_]
                if conv[0] == last:
                    sums[run_ == 0] += _U(held[k])
                sums %= m
                out += [sums, (sums + m - term) % m]
                held[k] = int(sums[-1])
            last = conv[-1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(conv), part, np.int64)), *(pa.array(out[k].astype(np.int64)) for k in (0, 2, 1, 3))], [*batch.schema.names, "part", "a", "b", "a0", "b0"]
            )

    return run


def fingerprinted(rows: DataFrame, modulus: int = MODULUS) -> DataFrame:
    """conv_id, depth, content, size, part, key and parent: fingerprints of the prefix with and without the turn; the root's key is 0, its parent null."""
    ranged = rows.repartitionByRange(_parts(rows), "conv_id", "depth").sortWithinPartitions("conv_id", "depth")
    scanned = runtime.written(ranged.mapInArrow(runtime.lean(_scanned(modulus)), "conv_id long, depth long, content long, size long, part long, a long, b long, a0 long, b0 long"), "trie-scanned")
    scanned = _carried(scanned, {"a": F.max_by("a", "depth"), "b": F.max_by("b", "depth")}, modulus)
    pair = lambda a, b: F.shiftleft(F.pmod(F.col(a) + F.col("before_a"), F.lit(modulus)), 31).bitwiseOR(F.pmod(F.col(b) + F.col("before_b"), F.lit(modulus)))
    return scanned.select("conv_id", "depth", "content", "size", "part", pair("a", "b").alias("key"), F.when(F.col("depth") > 0, pair("a0", "b0")).alias("parent"))


def verified(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes) in which every group of (depth, key) is one node: all its turns and parents are those of its representative."""
    turn = 0
    while True:
        spread = [f(c).alias(f"{x}_{c}") for c in ("content", "parent") for x, f in (("least", F.min), ("most", F.max))]
        nodes = runtime.written(rows.groupBy("depth", "key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("size").alias("size"), *spread), "trie-nodes")
        odd = nodes.filter("least_content <> most_content or least_parent <> most_parent").select("depth", "key", F.lit(True).alias("odd"))
        if odd.isEmpty():
            return rows, nodes.select("depth", "key", F.col("least_parent").alias("parent"), "conv_id", "n_convs", "size")
        # negative keys are of split groups; the count of passes makes them new ones each time
        own = -1 - F.xxhash64("key", "content", "parent", F.lit(turn)).bitwiseAND(F.lit((1 << 62) - 1))
        split = rows.join(odd, ["depth", "key"], "left").withColumn("new", F.when(F.col("odd"), own).otherwise(F.col("key")))
        above = split.filter("odd").select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("new").alias("above"))
        split = split.join(above, ["conv_id", "depth"], "left")
        rows = runtime.written(split.select("conv_id", "depth", "content", "size", "part", F.col("new").alias("key"), F.coalesce("above", "parent").alias("parent")), "trie-split")
        turn += 1


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (depth, key, conv_id) to pieces: depth, key, first conv_id, the ids joined by commas."""

    def made(held: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], ["depth", "key", "first", "ids"])

    node, ids, size, held, total = None, [], 0, [], 0
    for batch in batches:
        for depth, key, conv in zip(*(batch.column(c).to_pylist() for c in ("depth", "key", "conv_id"))):
            if ids and (node != (depth, key) or size >= CHUNK_BYTES):
                held.append((*node, int(ids[0]), b",".join(ids)))
                total, ids, size = total + size, [], 0
                if total >= 1 << 22 or len(held) >= 10_000:
                    yield made(held)
                    held, total = [], 0
            node = (depth, key)
            ids.append(b"%d" % conv)
            size += len(ids[-1]) + 1
    if ids:
        held.append((*node, int(ids[0]), b",".join(ids)))
    if held:
        yield made(held)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by (depth, key, first) to one hash a node."""
    node, sha, held = None, None, []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.int64()), pa.array([h[2] for h in held], pa.string())], ["depth", "key", "ends_sha256"])

    for batch in batches:
        for k, at in enumerate(zip(batch.column("depth").to_pylist(), batch.column("key").to_pylist())):
            if at == node:
                sha.update(b",")
            else:
                if node is not None:
                    held.append((*node, sha.hexdigest()))
                node, sha = at, hashlib.sha256()
            sha.update(batch.column("ids")[k].as_py())
        if len(held) >= 10_000:
            yield made()
            held = []
    if node is not None:
        held.append((*node, sha.hexdigest()))
    if held:
        yield made()


def ends(rows: DataFrame) -> DataFrame:
    """depth, key, ends_sha256 of the nodes in which conversations end."""
    last = rows.groupBy("conv_id").agg(F.max_by("key", "depth").alias("key"), F.max("depth").alias("depth"))
    n = _parts(rows)
    pieces = last.repartitionByRange(n, "depth", "key", "conv_id").sortWithinPartitions("depth", "key", "conv_id").mapInArrow(runtime.lean(_chunks), "depth long, key long, first long, ids binary")
    return pieces.repartition(n, "depth", "key").sortWithinPartitions("depth", "key", "first").mapInArrow(runtime.lean(_hashed), "depth long, key long, ends_sha256 string")


def trie(rows: DataFrame, modulus: int = MODULUS) -> DataFrame:
    """Rows (conv_id, depth, content, size), one of depth 0 for each conversation and no depth left out, to one row a node:

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (over the subtree, (n_convs - 1) * size of the last turn), ends_sha256.
    """
    runtime.ship(rows.sparkSession)
    rows, nodes = verified(fingerprinted(rows, modulus))
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["depth", "key"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))

    own = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("size")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    placed = rows.select("conv_id", "depth", "part", "key").join(own, ["conv_id", "depth"], "left")
    placed = placed.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("saved", "leaf")})
    down = Window.partitionBy("conv_id", "part").orderBy(F.desc("depth"))
    sums = placed.withColumns({f"run_{c}": F.sum(c).over(down) for c in ("saved", "leaf")})
    sums = _carried(sums, {"saved": F.sum("saved"), "leaf": F.sum("leaf")}, after=True)
    whole = sums.groupBy("depth", "key").agg(*[F.sum(F.col(f"run_{c}") + F.col(f"before_{c}")).alias(n) for c, n in (("saved", "saved_tokens"), ("leaf", "n_leaves"))])

    out = nodes.join(whole, ["depth", "key"]).join(ends(rows), ["depth", "key"], "left")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = out.join(above, ["depth", "parent"], "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
