"""N-gram Jaccard join by universe partition and pigeonhole (operator 1).

A document's set is the set of its distinct five-word shingles (see shingles). Two sets a, b link when their Jaccard
similarity is 0.8 or more, which is the same as |a - b| + |b - a| <= (|a| + |b|) / 9. The links' components are found
without making all pairs of a group:

1. Size bands. Each band's upper end is over 1.25 times its lower end, so partners lie in one band or in two
   neighbouring ones. A scheme serves one band of small sets, or the three bands between two powers of two; a set
   takes part in its own scheme and, where it can have smaller partners there, in the scheme below.
2. Universe partition. A scheme cuts the hash range into segments; two sets that differ in at most d elements differ
   in at most d segments. Of two ways to index them a scheme has the one that costs less for its sizes:
   - Sets under 32 shingles, where a segment for each difference would hold few shingles or none: half as many segments,
     each with its one-deletion neighbourhood. With 2 k > d, one of k segments differs in one element at most, so two
     partners share that segment or a deletion variant of it. Such an entry holds nearly all of some eight shingles.
   - Larger sets: segments of one or two shingles, and of these, by allocation, the d + 1 that are in the fewest sets
     of the whole corpus, by exact counts. The order (number of sets, entry) is the same for all sets. Two partners
     share all but d of the segments of either, so the first shared segment in that order is among the d + 1 of both.
     Segments that no other set of a fitting size has come first and cost nothing; a set with d + 1 of them can have no
     partner and is out.
3. Stars. Of the sets in one entry and size band the most central is the leader: the one whose entries most other sets
   hold, for its size. Each other is verified against it, exactly. In a group of near copies that is the text they come
   from, or one near it, so that what is in the group's component is mostly linked to the leader.
4. Members of one leader's group that are not connected yet may still link with each other. Those that are linked to the
   leader are connected, so of two members one at least is not:
   - Deltas, where the other is linked. Their difference is that of their deltas to the leader, and both lie near it, so
     deltas of members that are near enough for that are joined: each keeps its rarest elements within the leader's
     group, by the same prefix argument, and pairs that share one are verified.
   - Homes and sets, where neither is. Such members may lie in groups of many leaders; each is taken once, whatever its
     leaders, so that this grows with the sets and not with the stars. A set's home is the leader of the largest star of
     which it is a member nearer to the leader than its own size. Sets of one home, such as near copies beyond the threshold, have
     most of their elements in common but little of their deltas to it, so these are joined. Sets of different homes, or
     without one, have little in common with their leaders, often one passage: of the elements that sets of several
     homes hold, the floor(n / 5) + 1 that the fewest hold are joined, and pairs that share one are verified.
   Elements that no pair in question can share come first in the order of each prefix, so that they cost nothing.
5. Components of all links, by alternating large and small stars over tables in the shared folder.

Equal sets form one class beforehand, found by a 128-bit hash, whose first 64 bits stand for it in the index (classes
that share them are all compared). Shingles are 64-bit hashes; a wrong result needs two different shingles of one
comparison to collide, or a set to leave so many segments empty that fewer than d + 1 are left (under 1e-17 a set).

Nulls in text and texts without words have no shingles and link with nothing. Rows with one doc_id are one document:
it links with whatever any of its rows links with. Rows without an id are one document where their texts are equal;
they link like others, but their ids don't count: component_id and class_id are the smallest ids that are not null,
and null where there is none. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import runtime
from quire.llm.shingles import mix, shingle_sets

SLICE_BYTES, SEEN = 2 << 20, 1_000_000
#: Lower ends of the bands of small sets, each with a scheme of one-deletion neighbourhoods; from the last end on, schemes of plain segments.
SMALL, LARGE = (4, 5, 7, 9, 12, 15, 19, 25), 32
#: Schemes of sets under this size have two segments for each shingle of their smallest set, others one.
SPARSE = 128
#: Rows of one entry that are held at once.
LONG_RUN = 1_000_000
#: Elements of sets that become rows at once.
PIECE = 1 << 17
#: Bits of the map by which sets that nobody asks for are passed over: a fixed size, whatever the corpus.
MARKS = 1 << 26
_U = np.uint64


def links(a: int, b: int, differing: int) -> bool:
    """Whether sets of sizes a, b that differ in so many elements have a Jaccard similarity of 0.8 or more."""
    return 9 * differing <= a + b


def bands(most: int) -> np.ndarray:
    """Lower ends of the size bands, up to past most: SMALL, then three between two powers of two."""
    out, low = list(SMALL), LARGE
    while out[-1] <= most:
        out += [low, -(-low * 63 // 50), -(-low * 127 // 80)]
        low *= 2
    return np.array([*out, low])


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[bytes]]]:
    texts = batch.column("text").cast(pa.binary())
    rows, raw, size = [], [], 0
    for k in range(len(batch)):
        rows.append(k)
        raw.append(texts[k].as_py() or b"")
        size += len(raw[-1])
        if size >= SLICE_BYTES:
            yield rows, raw
            rows, raw, size = [], [], 0
    if rows:
        yield rows, raw


def class_id(s: np.ndarray) -> tuple[bytes, int]:
    """The 128-bit hash of a set, and its first half as a number."""
    whole = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return whole, int.from_bytes(whole[:8], "little", signed=True)


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, id, n, class, cid of each document."""
    for batch in batches:
        keys, ids = batch.column("key"), batch.column("id")
        for rows, raw in _slices(batch):
            sets = shingle_sets(raw)
            marks = [class_id(s) if len(s) else (None, None) for s in sets]
            own = pa.array(rows)
            yield pa.RecordBatch.from_arrays([keys.take(own), ids.take(own), pa.array([len(s) for s in sets], pa.int64()), pa.array([m[0] for m in marks], pa.binary()), pa.array([m[1] for m in marks], pa.int64())], ["key", "id", "n", "class", "cid"])


def _segments(s: np.ndarray, n: int) -> np.ndarray:
    """The segment, of n equal ones of the hash range, of each element of a sorted set."""
    return (((s >> _U(32)) * _U(n)) >> _U(32)).astype(np.int64)


def neighbourhoods(s: np.ndarray, low: int, high: int) -> np.ndarray:
    """Index keys of a small set in the scheme of the band from low to high - 1: each segment, and each with one element left out."""
    most = (high - 1 + (high - 1) * 5 // 4) // 9
    k = most // 2 + 1
    at = _segments(s, k)
    h = mix(s)
    whole = np.zeros(k, _U)
    np.add.at(whole, at, h)
    tag = mix(np.arange(1, k + 1, dtype=_U) + _U(low << 32))
    return np.unique(mix(np.concatenate((whole + tag, (whole + tag)[at] - h))))


def plain_segments(s: np.ndarray, low: int, largest: int) -> tuple[np.ndarray, int]:
    """(index keys of a set in the scheme of sizes from low on, how many the allocation can leave out); largest: of its possible partners there."""
    at = _segments(s, 2 * low if low < SPARSE else low)
    start = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    sums = np.append(_U(0), np.cumsum(mix(s)))
    end = np.append(start[1:], len(s))
    key = mix(sums[end] - sums[start] + mix(at[start].astype(_U) + _U(low << 32)))
    return key, max(0, len(key) - (len(s) + largest) // 9 - 1)


def all_entries(s: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, int, bool]]:
    """(keys, how many can be left out, whether the scheme is the set's own) in the one or two schemes of a set."""
    n = len(s)
    if n < 4:  # no other set of any size is similar enough
        return []
    k = int(np.searchsorted(ends, n, side="right")) - 1
    own = LARGE << ((n // LARGE).bit_length() - 1) if n >= LARGE else int(ends[k])
    if n < LARGE:
        out = [(neighbourhoods(s, own, int(ends[k + 1])), 0, True)]
    else:
        out = [(*plain_segments(s, own, n * 5 // 4), True)]
    if own > SMALL[0] and 5 * (own - 1) >= 4 * n:
        if own > LARGE:
            out.append((*plain_segments(s, own // 2, own - 1), False))
        else:
            out.append((neighbourhoods(s, int(ends[k - 1]), own), 0, False))
    return out


def _indexer(most: int):
    """Rows (entry, cid, meta) of each document that is no copy of one before it in the task; meta: size << 32 | keys to spare << 1 | not the set's own scheme."""
    ends = bands(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, raw in _slices(batch):
                keys, owner, meta, count = [], [], [], []
                for s in shingle_sets(raw):
                    if len(s) < 4:
                        continue
                    mark = class_id(s)[1]
                    if mark in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(mark)
                    for found, spare, own in all_entries(s, ends):
                        keys.append(found)
                        owner.append(mark)
                        meta.append(len(s) << 32 | spare << 1 | (not own))
                        count.append(len(found))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), *(pa.array(np.repeat(np.array(x, np.int64), count)) for x in (owner, meta))], ["entry", "cid", "meta"])

    return run


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    """(sizes of the runs of one entry, columns) of whole entries at a time, from rows that come by entry.

    An entry of over LONG_RUN rows comes in parts, its first row with each, and all parts count as LONG_RUN rows.
    """
    held, long = None, False

    def made(columns: list[np.ndarray]) -> tuple:
        entry = columns[0]
        start = np.flatnonzero(np.append(True, entry[1:] != entry[:-1]))
        size = np.diff(np.append(start, len(entry)))
        count = np.minimum(size, LONG_RUN)
        if long:
            count[0] = LONG_RUN
        return start, size, count, columns

    for batch in batches:
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
        entry = columns[0]
        if not len(entry):
            continue
        cut = int(np.searchsorted(entry, entry[-1]))  # the last entry may go on
        if cut:
            yield made([c[:cut] for c in columns])
            held, long = [c[cut:] for c in columns], False
        elif len(entry) > LONG_RUN:
            long = True
            yield made(columns)
            held = [c[:1] for c in columns]
        else:
            held = columns
    if held is not None and len(held[0]) > 0:
        yield made(held)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by entry: those with another set of a fitting size in the entry, one of both in its own scheme, and the number of sets."""
    names = ["entry", "cid", "meta"]
    for _, size, parts, columns in _runs(batches, names):
        part = parts == LONG_RUN  # of a longer run: what lies in the others is not known
        met = np.repeat(part | (size > 1), size)  # most entries have one row
        if not met.any():
            continue
        entry, cid, meta = (c[met] for c in columns)
        long = np.repeat(part, size)[met]
        order = np.lexsort((cid, meta, entry))
        entry, cid, meta, long = entry[order], cid[order], meta[order], long[order]
        new = np.append(True, (entry[1:] != entry[:-1]) | (cid[1:] != cid[:-1]) | (meta[1:] != meta[:-1]))  # copies of other tasks
        entry, cid, meta, long = entry[new], cid[new], meta[new], long[new]
        start = np.flatnonzero(np.append(True, entry[1:] != entry[:-1]))
        size = np.diff(np.append(start, len(entry)))
        n, own = meta >> 32, (meta & 1) == 0
        near = np.append((entry[1:] == entry[:-1]) & (4 * n[1:] <= 5 * n[:-1]), False)  # a row and the next
        below = np.maximum.reduceat(np.where(own, n, 0), start)  # sizes of the entry's own scheme lie below the others
        ok = np.where(own, near | np.append(False, near[:-1]), 4 * n <= 5 * np.repeat(below, size))
        count = np.where(long, LONG_RUN, np.repeat(size, size))
        ok = ok & (count > 1) | long
        if ok.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[ok]) for x in (entry, cid, meta, count)], [*names, "n"])


def _grouped(most: int):
    """Rows (entry, cid, meta, central) to (entry, key, low, central): an entry for each size band in which the set can meet others; low: its own band."""
    ends = bands(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry, cid, meta, central = (batch.column(c).to_numpy() for c in ("entry", "cid", "meta", "central"))
            n, own = meta >> 32, (meta & 1) == 0
            band = np.searchsorted(ends, n, side="right") - 1
            inner = (n >= LARGE) & ((ends[band] & (ends[band] - 1)) != 0)  # the band below is in the same scheme
            lower = ~own | (inner & (5 * (ends[band] - 1) >= 4 * n))
            tagged = [mix(entry.view(_U) + b.astype(_U)).view(np.int64) for b in (band, band - 1)]
            low = np.repeat([True, False], [own.sum(), lower.sum()])
            columns = (np.concatenate((tagged[0][own], tagged[1][lower])), np.concatenate((cid[own], cid[lower])), low, np.concatenate((central[own], central[lower])))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["entry", "key", "low", "central"])

    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by entry, its leader first: (leader, member) of each entry with another member and one of the band itself."""
    leaders, members, n = [], [], 0

    def flush() -> pa.RecordBatch:
        pairs = np.unique(np.stack([np.concatenate(leaders), np.concatenate(members)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["leader", "member"])

    for start, size, count, (_, key, low) in _runs(batches, ["entry", "key", "low"]):
        first = np.repeat(key[start], size)
        ok = np.repeat(np.maximum.reduceat(low, start) | (count == LONG_RUN), size) & (first != key)
        leaders.append(first[ok])
        members.append(key[ok])
        n += int(ok.sum())
        if n > 500_000:
            yield flush()
            leaders, members, n = [], [], 0
    if n:
        yield flush()


def marks(keys: DataFrame) -> np.ndarray:
    """A map of MARKS bits with those of the keys set. It has a fixed size; the more keys, the fewer others it tells apart."""
    slot = F.pmod(F.xxhash64("key"), F.lit(MARKS))
    words = keys.select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(key), {MARKS}) & 63 as int))").alias("bit"))
    rows = words.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(MARKS // 64, np.int64)
    found = rows.toArrow()
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out


def _sets(marked):
    """class, elements of the rows (slot, text) whose slot is marked; a few that nobody asked for may come along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column("slot").to_numpy()
            batch = batch.filter(pa.array((marked.value[slot >> 6] >> (slot & 63) & 1).astype(bool)))
            for _, raw in _slices(batch):
                sets = shingle_sets(raw)
                yield pa.RecordBatch.from_arrays([pa.array([class_id(s)[0] for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["class", "elements"])

    return run


def _compared(with_delta: bool):
    """Exact comparison of (leader, member), which come by leader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, None
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                a, b, leaders = batch.column("a"), batch.column("b"), batch.column("leader").to_pylist()
                sizes, deltas = [], []
                for k in range(len(batch)):
                    if leaders[k] != last:
                        last, x = leaders[k], np.frombuffer(a[k].as_py(), _U)
                    y = np.frombuffer(b[k].as_buffer(), _U)
                    delta = np.setxor1d(x, y, assume_unique=True)
                    sizes.append((len(x), len(y), len(delta)))
                    if with_delta:
                        deltas.append(delta.view(np.int64))
                columns = [batch.column(c) for c in ("leader", "member", "l", "m")] + [pa.array([z[i] for z in sizes], pa.int64()) for i in range(3)]
                names = ["leader", "member", "l", "m", "n_leader", "n_member", "n_delta"]
                if with_delta:
                    columns, names = [*columns, pa.array(deltas, pa.list_(pa.int64()))], [*names, "delta"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each element of the sets (member, m, part, n, home, elements): member, m, part, n, home, e."""
    names = ["member", "m", "part", "n", "home"]

    def flush() -> pa.RecordBatch:
        at = pa.array(np.repeat(np.array(owner, np.int64), [len(x) for x in pieces]))
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in names), pa.array(np.concatenate(pieces))], [*names, "e"])

    for batch in batches:
        elements, owner, pieces, count = batch.column("elements"), [], [], 0
        for k in range(len(batch)):
            s = np.frombuffer(elements[k].as_buffer(), np.int64)
            for at in range(0, len(s), PIECE):
                owner.append(k)
                pieces.append(s[at : at + PIECE])
                count += len(pieces[-1])
                if count >= PIECE:
                    yield flush()
                    owner, pieces, count = [], [], 0
        if pieces:
            yield flush()


def components(edges: DataFrame) -> DataFrame:
    """A written table of node, component (its smallest reachable node) of every node of edges (a, b), by large and small stars."""
    now, mark, before = runtime.written(edges.select("a", "b").filter("a <> b").distinct(), "edges"), None, ()
    while mark != before:  # each round brings nodes nearer to their least one; it ends when a round changes nothing
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: every larger neighbour goes to the least one
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: every smaller neighbour, and the node itself, go to the least one
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        ends = F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b"))))
        after = runtime.written(large.join(least, "a").select(ends.alias("e")).select("e.a", "e.b").filter("a <> b").distinct(), "edges")
        runtime.discard(now)
        now, before = after, mark
        mark = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    out = now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    out = runtime.written(out, "components")
    runtime.discard(now)
    return out


def _verified(pairs: DataFrame, sets: DataFrame, with_delta: bool) -> DataFrame:
    """pairs (leader, member, l, m) with n_leader, n_member, n_delta, and delta where it is asked for."""
    both = pairs.join(sets.select(F.col("class").alias("member"), F.col("elements").alias("b")), "member")
    both = both.join(sets.select(F.col("class").alias("leader"), F.col("elements").alias("a")), "leader").select("leader", "member", "l", "m", "a", "b")
    return both.mapInArrow(runtime.lean(_compared(with_delta)), "leader binary, member binary, l long, m long, n_leader long, n_member long, n_delta long" + ", delta array<long>" * with_delta)


def ngram_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (smallest doc_id with an equal set; null without shingles) of every row of docs (doc_id, text).

    Also key, the row's runtime.row_key(last=True), and component_key, one key of the component, the same for all its rows.
    """
    spark = docs.sparkSession
    runtime.ship(spark)
    named = docs.select(runtime.row_key(last=True).alias("key"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    texts = named.select("key", "text")
    rows = runtime.written(named.mapInArrow(runtime.lean(_survey), "key long, id long, n long, class binary, cid long"), "survey")
    reps = runtime.written(rows.filter("class is not null").groupBy("class", "cid").agg(F.min("key").alias("rep"), F.min("id").alias("first")), "classes")
    most, unnamed = rows.agg(F.max("n"), F.max(F.col("id").isNull())).first()
    pairs = runtime.written(_candidates(texts, most or 0, reps), "pairs")
    asked = pairs.select(F.col("l").alias("key")).unionByName(pairs.select(F.col("m").alias("key"))).distinct()
    marked = spark.sparkContext.broadcast(marks(asked))
    slots = texts.select(F.pmod(F.xxhash64("key"), F.lit(MARKS)).alias("slot"), "text")
    sets = slots.mapInArrow(runtime.lean(_sets(marked)), "class binary, elements binary").groupBy("class").agg(F.any_value("elements").alias("elements"))
    sets = runtime.written(sets, "sets", codec="uncompressed")
    marked.destroy()
    runtime.trim()

    # a document with several texts is in a class for each of them: they are one
    owned = rows.filter("class is not null").join(reps, ["class", "cid"]).select("key", "id", "rep", "first")
    owned = runtime.written(owned, "owned")
    several = owned.groupBy("key").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a <> b")
    several = owned.join(several.select("key", "a"), "key").select("a", F.col("rep").alias("b"))
    linked = F.col("n_delta") * 9 <= F.col("n_leader") + F.col("n_member")
    compared = runtime.written(_verified(pairs, sets, False).withColumn("linked", linked), "compared")
    first = components(compared.filter("linked").select(F.col("l").alias("a"), F.col("m").alias("b")).unionByName(several))
    more = _member_links(pairs, sets, compared, first)
    runtime.discard(sets, pairs, compared)
    whole = components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)) if more.take(1) else first
    reach = owned.join(whole, owned["rep"] == whole["node"], "left").groupBy("key").agg(F.min(F.coalesce("component", "rep")).alias("component"), F.min("id").alias("id"), F.min("first").alias("class_id"))
    if unnamed:  # components whose least key is that of a row without an id have the smallest of their ids
        reach = runtime.written(reach, "reach")
        hidden = rows.filter("id is null").select(F.col("key").alias("component")).distinct()
        names = reach.filter("id is not null").join(hidden, "component", "left_semi").groupBy("component").agg(F.min("id").alias("name"))
        names = hidden.join(names, "component", "left").withColumn("hidden", F.lit(True))
        reach = reach.join(names, "component", "left").withColumn("name", F.when(F.col("hidden"), F.col("name")).otherwise(F.col("component")))
    else:
        reach = reach.withColumn("name", F.col("component"))
    out = rows.select("key", F.col("id").alias("doc_id"), "n").join(reach.drop("id"), "key", "left")
    alone = F.col("component").isNull()  # no shingles
    component_id = F.when(alone, F.col("doc_id")).otherwise(F.col("name"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component_id.alias("component_id"), F.when(F.col("n") > 0, F.col("class_id")).alias("class_id"), "key", F.coalesce("component", "key").alias("component_key"))


def _candidates(texts: DataFrame, most: int, reps: DataFrame) -> DataFrame:
    """leader, member (classes) and l, m (their first documents) of every star."""
    spark = texts.sparkSession
    index = texts.mapInArrow(runtime.lean(_indexer(most)), "entry long, cid long, meta long")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    met = index.repartition(n, "entry").sortWithinPartitions("entry").mapInArrow(runtime.lean(_met), "entry long, cid long, meta long, n long")
    # the allocation: of the entries that it shares, a set leaves out as many as it can, those of the most sets first
    met = met.withColumn("scheme", F.col("meta").bitwiseAND(1))  # a column, so that both windows share one exchange
    own = Window.partitionBy("cid", "scheme")
    place = F.row_number().over(own.orderBy(F.desc("n"), "entry"))
    # the likeness (cosine) of a set to the numbers of sets in all entries: the largest is that of the leader
    central = (F.sum("n").over(own) / F.sqrt(F.shiftright("meta", 32))).cast("float")
    shared = met.withColumn("place", place).withColumn("central", central).filter(F.col("place") > F.shiftright("meta", 1).bitwiseAND((1 << 31) - 1))
    shared = runtime.written(shared.select("entry", "cid", "meta", "central").mapInArrow(runtime.lean(_grouped(most)), "entry long, key long, low boolean, central float"), "shared-entries")
    n = max(shared.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)  # by the size of what is left
    found = shared.repartition(n, "entry").sortWithinPartitions("entry", F.desc("central"), "key").select("entry", "key", "low").mapInArrow(runtime.lean(_stars), "leader long, member long").distinct()
    # from the halves of the hashes to classes: to all that share one
    left = reps.select(F.col("cid").alias("leader"), F.col("class").alias("a"), F.col("rep").alias("l"))
    right = reps.select(F.col("cid").alias("member"), F.col("class").alias("b"), F.col("rep").alias("m"))
    return found.join(left, "leader").join(right, "member").select(F.col("a").alias("leader"), F.col("b").alias("member"), "l", "m")


def _member_links(pairs: DataFrame, sets: DataFrame, compared: DataFrame, parts: DataFrame) -> DataFrame:
    """A written table of a, b: links between members of one leader's group that are not connected yet."""
    of = parts.select(F.col("node").alias("m"), F.col("component").alias("part"))
    members = compared.join(of, "m", "left").withColumn("part", F.coalesce("part", "m"))
    own, other = F.when(F.col("linked"), F.col("part")), F.when(~F.col("linked"), F.col("part"))
    groups = members.groupBy("leader").agg(F.min(own).alias("own"), F.min(other).alias("p"), F.max(other).alias("q"), F.max(F.when(F.col("linked"), 9 * F.col("n_delta") + F.col("n_member"))).alias("reach"))
    members = runtime.written(members.join(groups.filter("p <> q or p <> own"), "leader"), "members")
    deltas, delta_entries, delta_links = _delta_links(pairs, sets, members)
    asked = runtime.written(_homes(compared, members.filter("not linked and p <> q").select("member", "m", "part", F.col("n_member").alias("n")).distinct()), "asked")
    home_deltas, home_entries, home_links = _home_links(pairs, sets, asked)
    elements, shared, set_links = _set_links(sets, asked)
    out = runtime.written(delta_links.unionByName(home_links).unionByName(set_links), "member-links")
    runtime.discard(members, deltas, delta_entries, asked, home_deltas, home_entries, elements, shared)
    return out


def _homes(compared: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (member) with home: the leader of the largest star in which the member is nearer to it than its size, or the member itself, without such a star."""
    size = compared.groupBy("leader").agg(F.count("*").alias("size"))
    near = compared.filter("n_delta < n_member").join(asked.select("member"), "member", "left_semi").join(size, "leader")
    best = near.groupBy("member").agg(F.max(F.struct("size", -F.col("n_delta"), "leader"))["leader"].alias("home"))
    return asked.join(best, "member", "left").withColumn("home", F.coalesce("home", "member"))


def _ranked(rows: DataFrame, count: DataFrame, by: list[str], owner: list[str], n: str) -> DataFrame:
    """rows whose element is in count (by, df), with rank in their owner's order: elements that are not in count come first, and only their number counts."""
    own = Window.partitionBy(*owner)
    return rows.join(count, by).withColumn("rank", F.col(n) - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "e")))


#: For a pair of deltas: partners' sizes, and at the first element that they share, that what follows in either still gives the overlap that a link needs.
_FITS = "5 * na >= 4 * nb and 5 * nb >= 4 * na and 9 * abs(xa - xb) <= na + nb and 18 * (1 + least(xa - ra, xb - rb)) >= 9 * (xa + xb) - (na + nb)"


def _entries(kept: DataFrame, side: str) -> DataFrame:
    """Entries of deltas, with names of one side of a pair."""
    return kept.select("leader", "e", F.col("member").alias(side), *[F.col(c).alias(x + side) for c, x in (("n_member", "n"), ("n_delta", "x"), ("rank", "r"), ("part", "part"))])


def _linked_deltas(found: DataFrame, deltas: DataFrame) -> DataFrame:
    """a, b of the pairs found (leader, a, b, na, nb) whose deltas to the leader differ in so few elements that they link."""
    one = deltas.select("leader", F.col("member").alias("a"), F.col("m").alias("ka"), F.col("delta").alias("da"))
    two = deltas.select("leader", F.col("member").alias("b"), F.col("m").alias("kb"), F.col("delta").alias("db"))
    differ = F.size("da") + F.size("db") - 2 * F.size(F.array_intersect("da", "db"))
    return found.join(one, ["leader", "a"]).join(two, ["leader", "b"]).filter(differ * 9 <= F.col("na") + F.col("nb")).select(F.col("ka").alias("a"), F.col("kb").alias("b"))


def _delta_links(pairs: DataFrame, sets: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written deltas and their entries, and a, b of links between a member that is not linked to its leader and one that is."""
    # a partner of a linked one is no further from the leader than the linked one is, and the two from each other
    strays = members.filter("not linked and part <> own and 9 * n_delta <= reach + n_member")
    least = strays.groupBy("leader").agg(F.min(9 * F.col("n_delta") - F.col("n_member")).alias("least"))
    near = members.filter("linked").join(least, "leader").filter("9 * n_delta + n_member >= least").drop("least")
    members = near.unionByName(strays).select("leader", "member", "linked", "part")
    deltas = _verified(pairs.join(members.select("leader", "member"), ["leader", "member"], "left_semi"), sets, True)
    deltas = runtime.written(deltas.join(members, ["leader", "member"]), "deltas")
    # The overlap of two deltas that a link needs at least: with any partner, whose delta can be smaller by a fourth of
    # the set (long prefix, of those not linked), and with an unlinked partner, whose delta has a least size as well
    # (short prefix, of the linked).
    any_ = F.greatest(F.lit(1), F.col("n_delta") - F.floor(F.col("n_member") / 4)).cast("long")
    open_one = F.ceil((F.col("n_delta") + (F.col("n_leader") - F.col("n_member")) / 9 - 1e-9) / 2).cast("long")
    keep = F.col("n_delta") + 1 - F.when(F.col("linked"), F.greatest(any_, open_one)).otherwise(any_)
    rows = deltas.select("leader", "member", "linked", "part", "n_member", "n_delta", keep.alias("keep"), F.explode("delta").alias("e"))
    count = rows.groupBy("leader", "e").agg(F.count("*").alias("df"), F.min("linked").alias("x"), F.max("linked").alias("y"), F.min("part").alias("p"), F.max("part").alias("q")).filter("x <> y and p <> q")
    kept = _ranked(rows, count.select("leader", "e", "df"), ["leader", "e"], ["leader", "member"], "n_delta").filter("rank <= keep")
    kept = runtime.written(kept.select("leader", "e", "member", "linked", "part", "n_member", "n_delta", "rank"), "delta-entries")
    both = _entries(kept.filter("not linked"), "a").join(_entries(kept.filter("linked"), "b"), ["leader", "e"])
    found = both.filter("parta <> partb and " + _FITS).select("leader", "a", "b", "na", "nb").distinct()
    return deltas, kept, _linked_deltas(found, deltas)


def _home_links(pairs: DataFrame, sets: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written deltas to homes and their entries, and a, b of links between sets asked of one home."""
    homes = asked.select(F.col("home").alias("leader"), "member", "part")
    several = homes.groupBy("leader").agg(F.min("part").alias("p"), F.max("part").alias("q")).filter("p <> q").select("leader")
    homes = homes.join(several, "leader", "left_semi")
    deltas = _verified(pairs.join(homes.select("leader", "member"), ["leader", "member"], "left_semi"), sets, True)
    deltas = runtime.written(deltas.join(homes, ["leader", "member"]), "home-deltas")
    keep = F.least(F.col("n_delta"), 1 + F.floor(F.col("n_member") / 4))  # as with any partner above
    rows = deltas.select("leader", "member", "part", "n_member", "n_delta", keep.alias("keep"), F.explode("delta").alias("e"))
    count = rows.groupBy("leader", "e").agg(F.count("*").alias("df"), F.min("part").alias("p"), F.max("part").alias("q")).filter("p <> q")
    kept = _ranked(rows, count.select("leader", "e", "df"), ["leader", "e"], ["leader", "member"], "n_delta").filter("rank <= keep")
    kept = runtime.written(kept.select("leader", "e", "member", "part", "n_member", "n_delta", "rank"), "home-entries")
    both = _entries(kept, "a").join(_entries(kept, "b"), ["leader", "e"])
    found = both.filter("parta <> partb and a < b and " + _FITS).select("leader", "a", "b", "na", "nb").distinct()
    return deltas, kept, _linked_deltas(found, deltas)


def _set_links(sets: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written elements and those that are kept, and a, b of links between sets asked of different homes."""
    whole = asked.join(sets.withColumnRenamed("class", "member"), "member").select("member", "m", "part", "n", "home", "elements")
    rows = runtime.written(whole.mapInArrow(runtime.lean(_elements), "member binary, m long, part long, n long, home binary, e long"), "elements")
    ends = [f(c).alias(x) for c, x, f in (("part", "p", F.min), ("part", "q", F.max), ("home", "g", F.min), ("home", "h", F.max))]
    count = rows.groupBy("e").agg(F.count("*").alias("df"), *ends).filter("p <> q and g <> h")
    kept = _ranked(rows, count.select("e", "df"), ["e"], ["member"], "n").filter("rank <= floor(n / 5) + 1")
    kept = runtime.written(kept.select("e", "member", "m", "part", "n", "home", "rank"), "shared-elements")
    a, b = (kept.select("e", *[F.col(c).alias(c + x) for c in ("member", "m", "part", "n", "home", "rank")]) for x in "ab")
    fits = "parta <> partb and homea <> homeb and membera < memberb and 5 * na >= 4 * nb and 5 * nb >= 4 * na"
    # at the first element that a pair shares, what follows in either set must still give the overlap that it needs
    fits += " and 9 * (1 + least(na - ranka, nb - rankb)) >= 4 * (na + nb)"
    found = a.join(b, "e").filter(fits).select(F.col("membera").alias("leader"), F.col("memberb").alias("member"), F.col("ma").alias("l"), F.col("mb").alias("m")).distinct()
    linked = _verified(found, sets, False).filter("n_delta * 9 <= n_leader + n_member")
    return rows, kept, linked.select(F.col("l").alias("a"), F.col("m").alias("b"))
