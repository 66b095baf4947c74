"""Approximate nearest neighbours by a hierarchical k-means tree (operator 4).

Nearness is the largest inner product. Vectors are scaled by the largest norm and given one more component that
lifts them to the unit sphere, where the largest inner product is the smallest distance.

The tree. Its top is fitted on a bounded sample by k-means, node by node, and every vector goes to the node whose
centroids it follows. Then nodes of more than `leaf` vectors are split again, all at once, each by k-means over a
bounded sample of its own, level by level until none is left that can be split: the tree grows with the table.

The search. A query walks the top best bin first, through a priority queue of the nodes not yet opened, until it has
visited a number of them; on each level below, the children of all that it has reached are ranked together and the
nearest stay. That number is calibrated on probes that are held out of the fit: their true neighbours in the whole
table say how far the visits must widen for the recall to reach a target. Below a grown top the search itself is
measured on the probes, and widened until it reaches the target. A query that has met fewer than k vectors is
widened until it has met k, or all.

Leaves are dealt to parts of about `part` vectors. A query travels once to each part that holds leaves of its own,
whatever their number. Equal vectors form one class, searched once: of a class only the k + 1 smallest ids can be
among a query's k nearest, as ties go to smaller ids, so a class of any size costs one vector.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, nor
do rows with a null id. A row repeated with its id counts once; an id with several vectors has a candidate for each,
and a result for each as query. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from quire.llm import runtime

#: Vectors that the top is fitted on; children of a node; vectors of the sample in a node of the top, and of the table in a leaf; vectors in a part.
SAMPLE, BRANCHES, LEAF_SAMPLE, LEAF, PART = 16_384, 8, 48, 512, 8192
#: Recall that the visits are calibrated to, and the vectors held out for it.
TARGET, PROBES = 0.94, 256
#: Sampled vectors by which a node below the top is split into so many.
NODE_SAMPLE, FAN = 2048, 16
#: Levels below the top: with all of them each leaf of the top would have 16 ** 12 below it.
LEVELS = 12


def _vectors(column: str, key: str, kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, ids = batch.column(column), batch.column(key)
            lists = lists.cast(pa.list_(pa.float64()))
            flat = lists.flatten()
            whole = np.concatenate(([0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))))
            values = flat.fill_null(0).to_numpy(zero_copy_only=False) + 0.0  # -0.0 becomes 0.0
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(lengths)
            rows = []
            for k, (n, end) in enumerate(zip(lengths.tolist(), ends.tolist(), strict=True)):
                v = values[end - n : end]
                if n and whole[end] == whole[end - n] and v.any() and np.isfinite(v).all() and ids[k].is_valid:
                    raw = v.astype(kind).tobytes()  # the table's own type: nothing is lost
                    rows.append((ids[k].as_py(), hashlib.blake2b(raw, digest_size=16).digest(), raw, n, float(np.sqrt(v @ v))))
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["vec_id", "key", "vec", "dim", "norm"])

    return run


def _smallest(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per task, the k smallest distinct ids of each key: a map-side combine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pandas as pd

        def reduced(frames: list) -> "pd.DataFrame":
            df = pd.concat(frames).drop_duplicates(["key", "vec_id"]).sort_values("vec_id")
            return df[df.groupby("key").cumcount() < k]

        held, n = [], 0
        for batch in batches:
            held.append(batch.to_pandas())
            n += len(batch)
            if n > 200_000:
                held = [reduced(held)]
                n = len(held[0])
                if n > 100_000:
                    yield pa.RecordBatch.from_pandas(held[0][["key", "vec_id"]], preserve_index=False)
                    held, n = [], 0
        if n:
            yield pa.RecordBatch.from_pandas(reduced(held)[["key", "vec_id"]], preserve_index=False)

    return run


class Tree:
    """The top, nodes in one list: children of inner nodes, number of leaves, centroids of all nodes."""

    def __init__(self, sample: np.ndarray, top: float, branches: int = BRANCHES, leaf_sample: int = LEAF_SAMPLE, seed: int = 0):
        self.top, self.dim = top, sample.shape[1]
        self.children: list[np.ndarray] = []
        self.leaf: list[int] = []
        self.centroids: list[np.ndarray] = []
        self.leaves = 0
        rng = np.random.default_rng(seed)
        x = lifted(sample, top)
        self._grow(x, x.mean(0) if len(x) else np.zeros(self.dim + 1), branches, leaf_sample, rng)
        self.matrix = np.array(self.centroids)
        self.square = (self.matrix**2).sum(1)

    def _grow(self, x: np.ndarray, centre: np.ndarray, branches: int, leaf_sample: int, rng) -> int:
        node = len(self.children)
        self.children.append(np.zeros(0, np.int64))
        self.leaf.append(-1)
        self.centroids.append(centre)
        if len(x) > leaf_sample:
            label, centres = _kmeans(x, branches, rng)
            groups = [g for g in range(len(centres)) if (label == g).any()]
            if len(groups) > 1:
                self.children[node] = np.array([self._grow(x[label == g], centres[g], branches, leaf_sample, rng) for g in groups])
                return node
        self.leaf[node] = self.leaves
        self.leaves += 1
        return node

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        x, out = lifted(vectors, self.top), np.zeros(len(vectors), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, own = todo.pop()
            kids = self.children[node]
            if not len(kids):
                out[own] = self.leaf[node]
                continue
            best = (self.square[kids] - 2 * x[own] @ self.matrix[kids].T).argmin(1)
            todo += [(int(kid), own[best == k]) for k, kid in enumerate(kids) if (best == k).any()]
        return out

    def visits(self, query: np.ndarray, most: int) -> list[int]:
        """Up to most leaves, best bin first."""
        far = self.square - 2 * (self.matrix @ asked_as(query))
        queue, out = [(0.0, 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            while len(kids := self.children[node]):
                each = far[kids]
                best = int(each.argmin())
                for k, kid in enumerate(kids.tolist()):
                    if k != best:
                        heapq.heappush(queue, (float(each[k]), kid))
                node = int(kids[best])
            out.append(self.leaf[node])
        return out


def lifted(vectors: np.ndarray, top: float) -> np.ndarray:
    x = vectors / top
    return np.hstack([x, np.sqrt(np.maximum(0, 1 - (x**2).sum(1)))[:, None]])


def asked_as(query: np.ndarray) -> np.ndarray:
    """A query's place on the sphere: of its length nothing matters."""
    return np.append(query / max(float(np.sqrt(query @ query)), 1e-300), 0.0)


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    label = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        new = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        if (new == label).all() and _:
            break
        label = new
        for g in range(len(centres)):
            if (label == g).any():
                centres[g] = x[label == g].mean(0)
    return label, centres


def calibrate(tree: Tree, probes: np.ndarray, neighbours: list[np.ndarray], target: float) -> tuple[int, float]:
    """(leaf visits, recall): the fewest visits by which the probes meet target of their true neighbours."""
    at = []
    for q, near in zip(probes, neighbours, strict=True):
        place = np.empty(tree.leaves, np.int64)
        place[tree.visits(q, tree.leaves)] = np.arange(tree.leaves)
        at += place[tree.assign(near)].tolist() if len(near) else []
    if not at:
        return tree.leaves, 1.0
    ranks = np.sort(at)
    visits = int(ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))))]) + 1
    return visits, float((ranks < visits).mean())


def _probed(probes: np.ndarray, k: int, kind: str):
    """Rows (key, vec) to each probe's k nearest of the task: (probe, best), nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, vecs = np.full((len(probes), 0), 0.0), np.zeros((0, probes.shape[1]))
        for batch in batches:
            for at in range(0, len(batch), 2048):
                x = _matrix(batch.column("vec").slice(at, 2048), kind)
                s = probes @ x.T
                top = min(k, len(x))
                part = np.argpartition(-s, top - 1, axis=1)[:, :top]
                keep, inverse = np.unique(part, return_inverse=True)
                wide = np.full((len(probes), len(keep)), -np.inf)
                rows = np.repeat(np.arange(len(probes)), top)
                wide[rows, inverse.reshape(-1)] = s[rows, part.reshape(-1)]
                score, vecs = np.hstack([score, wide]), np.vstack([vecs, x[keep]])
                if score.shape[1] > 4 * k * len(probes):
                    score, vecs = _top(score, vecs, k)
        score, vecs = _top(score, vecs, k)
        for p in range(len(probes)):
            own = np.flatnonzero(score[p] > -np.inf)
            if len(own):
                raw = [v.astype(kind).tobytes() for v in vecs[own]]
                best = pa.StructArray.from_arrays([pa.array(-score[p, own]), pa.array(raw, pa.binary())], ["far", "vec"])
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), best)], ["probe", "best"])

    return run


def _top(score: np.ndarray, vecs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """What of the columns is among the k best of a row."""
    if score.shape[1] > k:
        edge = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
        score = np.where(score >= edge, score, -np.inf)
    keep = (score > -np.inf).any(0)
    return score[:, keep], vecs[keep]


def _matrix(column, kind: str) -> np.ndarray:
    """The rows of a binary column, all of one length, in double precision."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, kind).reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 1))


def _runs(batch: pa.RecordBatch, *names: str) -> Iterator[tuple[int, int]]:
    """Where runs of equal values in the named columns begin and end."""
    if len(batch):
        spots = np.stack([batch.column(c).to_numpy() for c in names], 1)
        cuts = np.flatnonzero((spots[1:] != spots[:-1]).any(1)) + 1
        yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True)


def _centres(top: float, kind: str, fan: int, seed: int):
    """Sampled rows of one node to the centroids by which it is split."""

    def fit(key, frame):
        import pandas as pd

        x = lifted(np.array([np.frombuffer(v, kind) for v in frame.sort_values("key")["vec"]], np.float64), top)
        label, centres = _kmeans(x, fan, np.random.default_rng(seed + int(key[0]) % (1 << 31)))
        own = centres[[g for g in range(len(centres)) if (label == g).any()]]
        return pd.DataFrame({"node": [key[0]], "centres": [own.tobytes()]})

    return fit


def _descend(top: float, kind: str, fan: int, asks: bool):
    """Rows come by (node, salt), centroids first: vectors go to their nearest child; queries to all, with the distance. A node without centroids stays, as its own only child."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, centres = None, None
        for batch in batches:
            nodes, salts, first = batch.column("node").to_numpy(), batch.column("salt").to_numpy(), batch.column("centres")
            names = [c for c in batch.schema.names if c not in ("node", "salt", "first", "centres", "far")]
            for a, b in _runs(batch, "node", "salt"):
                if (nodes[a], salts[a]) != place:
                    place, centres = (nodes[a], salts[a]), None
                if first[a].is_valid:
                    centres = first[a].as_py()
                    a += 1
                if a == b:
                    continue
                own, node = batch.slice(a, b - a), int(nodes[a])
                if centres is None:
                    more = ["far"] if asks else []
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, node * fan)), *(own.column(c) for c in [*names, *more])], ["node", *names, *more])
                    continue
                x = _matrix(own.column("vec"), kind)
                if isinstance(centres, bytes):
                    centres = np.frombuffer(centres, np.float64).reshape(-1, x.shape[1] + 1)
                square = (centres**2).sum(1)
                if asks:
                    q = np.array([asked_as(v) for v in x])
                    far = square - 2 * q @ centres.T
                    n = len(centres)
                    again = pa.array(np.repeat(np.arange(len(x)), n))
                    yield pa.RecordBatch.from_arrays([pa.array(np.tile(node * fan + np.arange(n), len(x))), *(own.column(c).take(again) for c in names), pa.array(far.reshape(-1))], ["node", *names, "far"])
                else:
                    child = (square - 2 * lifted(x, top) @ centres.T).argmin(1)
                    yield pa.RecordBatch.from_arrays([pa.array(node * fan + child), *(own.column(c) for c in names)], ["node", *names])

    return run


def _scored(k: int, kind: str):
    """Rows come by part, its vectors by node before its queries; each query gets the k best (score, id) of its nodes there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, made = None, [], None
        for batch in batches:
            parts = batch.column("part").to_numpy() if len(batch) else []
            for a, b in _runs(batch, "part", "asks"):
                own = batch.slice(a, b - a)
                if parts[a] != place:
                    place, held, made = parts[a], [], None
                if not own.column("asks")[0].as_py():
                    ids = own.column("ids")
                    held.append((own.column("node").to_numpy(), _matrix(own.column("vec"), kind), ids.flatten().to_numpy(), ids.value_lengths().to_numpy()))
                    continue
                if not held:
                    continue
                if made is None:
                    node, matrix, flat, many = (np.concatenate(x) for x in zip(*held, strict=True))
                    start = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
                    made = {n: (x, y) for n, x, y in zip(node[start].tolist(), start.tolist(), [*start[1:].tolist(), len(node)], strict=True)}
                    offset = np.concatenate(([0], np.cumsum(many)))
                    held = [(node[:0], matrix[:0], flat[:0], many[:0])]
                for at in range(0, len(own), 128):
                    some = own.slice(at, 128)
                    q, asked = _matrix(some.column("vec"), kind), some.column("nodes").to_pylist()
                    by: dict[int, list[int]] = {}
                    for row, nodes in enumerate(asked):
                        for n in nodes:
                            if n in made:
                                by.setdefault(n, []).append(row)
                    score = np.full((len(some), len(matrix)), -np.inf)
                    for n, rows in by.items():
                        x, y = made[n]
                        score[rows, x:y] = q[rows] @ matrix[x:y].T
                    keys, sizes, far, names = [], [], [], []
                    for row, s in enumerate(score):
                        own_rows = np.flatnonzero(s > -np.inf)
                        if len(own_rows) > k:  # classes that can hold one of the k best, ties included
                            edge = np.partition(s[own_rows], len(own_rows) - k)[len(own_rows) - k]
                            own_rows = own_rows[s[own_rows] >= edge]
                        if len(own_rows):
                            values = np.repeat(s[own_rows], many[own_rows])
                            which = np.concatenate([flat[offset[r] : offset[r + 1]] for r in own_rows])
                            best = np.lexsort((which, -values))[:k]
                            keys.append(row), sizes.append(len(best)), far.append(-values[best]), names.append(which[best])
                    if keys:
                        pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(far)), pa.array(np.concatenate(names))], ["far", "id"])
                        ends = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
                        yield pa.RecordBatch.from_arrays([some.column("key").take(pa.array(keys)), pa.ListArray.from_arrays(ends, pairs)], ["key", "best"])

    return run


class Index:
    """The grown tree: the top, one table of centroids for each level below, and the classes with their leaves."""

    def __init__(self, classes: DataFrame, tree: Tree, kind: str, leaf: int = LEAF, node_sample: int = NODE_SAMPLE, part: int = PART, seed: int = 0):
        self.spark, self.tree, self.kind, self.seed, self.levels = classes.sparkSession, tree, kind, seed, []
        shared = self.shared = self.spark.sparkContext.broadcast(tree)

        def to_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    yield pa.RecordBatch.from_arrays([pa.array(shared.value.assign(_matrix(batch.column("vec"), kind))), *batch.columns], ["node", *batch.schema.names])

        own = "node long, key binary, vec binary, ids array<long>"
        self.rows = runtime.written(classes.select("key", "vec", "ids").mapInArrow(runtime.lean(to_leaf), own), "leaves")
        above = None
        while len(self.levels) < LEVELS:
            sizes = runtime.written(self.rows.groupBy("node").agg(F.count("*").alias("n")), "sizes")
            large = sizes.filter(F.col("n") > leaf)
            if above is not None:  # a node as large as the one above it lies too close together to be split; it alone stays as it is
                large = large.join(above.select(F.col("node").alias("parent"), F.col("n").alias("whole")), F.expr(f"node div {FAN}") == F.col("parent")).filter("n <> whole").select("node", "n")
            large = runtime.written(large, "large")
            runtime.discard(*[above] * (above is not None))
            above = sizes
            if large.isEmpty():
                break
            share = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) * F.col("n") < F.lit(node_sample << 30)
            sampled = self.rows.join(large, "node").filter(share).select("node", "key", "vec")
            centres = runtime.written(sampled.groupBy("node").applyInPandas(_centres(tree.top, kind, FAN, seed), "node long, centres binary"), "centres")
            below = runtime.written(self._down(self.rows, centres, False), "leaves")
            runtime.discard(self.rows, large)
            self.rows = below
            self.levels.append(centres)
        counted = self.rows.agg(F.count("*"), F.countDistinct("node")).first()
        self.n, self.leaves = counted[0], max(tree.leaves, counted[1])
        self.parts = max(1, -(-self.n // part))

    def _down(self, rows: DataFrame, centres: DataFrame, asks: bool) -> DataFrame:
        """rows (node, key, vec, ...) a level down. Rows of a node are dealt to salts, its centroids to all of them."""
        salts = 16
        names = [c for c in rows.columns if c not in ("node",)]
        kinds = {f.name: f.dataType for f in rows.schema}
        first = centres.select("node", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("first"), "centres", *[F.lit(None).cast(kinds[c]).alias(c) for c in names])
        own = rows.select("node", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("first"), F.lit(None).cast("binary").alias("centres"), *names)
        n = max(2 * self.spark.sparkContext.defaultParallelism, self.rows.rdd.getNumPartitions())
        both = first.unionByName(own).repartition(n, "node", "salt").sortWithinPartitions("node", "salt", "first")
        schema = ", ".join(["node long", *(f"{c} {kinds[c].simpleString()}" for c in names if c != "far"), *(["far double"] if asks else [])])
        return both.mapInArrow(runtime.lean(_descend(self.tree.top, self.kind, FAN, asks)), schema)

    def reached(self, queries: DataFrame, visits: int) -> DataFrame:
        """queries (key, vec) with nodes: the leaves that they visit."""
        shared, kind = self.shared, self.kind

        def to_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    found = [shared.value.visits(v, visits) for v in _matrix(batch.column("vec"), kind)]
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int64()))], [*batch.schema.names, "nodes"])

        at = queries.select("key", "vec").mapInArrow(runtime.lean(to_leaves), "key binary, vec binary, nodes array<long>")
        for centres in self.levels:
            each = at.select(F.explode("nodes").alias("node"), "key", "vec", F.lit(-4.0).alias("far"))  # a node that was not split comes before all distances
            down = self._down(each, centres, True)
            best = F.slice(F.array_sort(F.collect_list(F.struct("far", "node"))), 1, visits)
            at = down.groupBy("key").agg(F.any_value("vec").alias("vec"), best.alias("best")).select("key", "vec", F.transform("best", lambda x: x["node"]).alias("nodes"))
        return at

    def search(self, queries: DataFrame, visits: int, k: int) -> DataFrame:
        """key, best (the k best (far, id) met) of queries (key, vec), for as long as any was met."""
        part = lambda node: F.pmod(F.xxhash64(node, F.lit(self.seed)), F.lit(self.parts)).cast("int")
        held = self.rows.select(part("node").alias("part"), F.lit(0).alias("asks"), "node", "key", "vec", "ids", F.lit(None).cast("array<long>").alias("nodes"))
        spread = self.reached(queries, visits).select("key", "vec", F.explode("nodes").alias("node")).withColumn("part", part("node"))
        asked = spread.groupBy("part", "key").agg(F.any_value("vec").alias("vec"), F.collect_list("node").alias("nodes"))
        asked = asked.select("part", F.lit(1).alias("asks"), F.lit(0).cast("long").alias("node"), "key", "vec", F.lit(None).cast("array<long>").alias("ids"), "nodes")
        n = max(2 * self.spark.sparkContext.defaultParallelism, self.parts)
        both = held.unionByName(asked).repartition(n, "part").sortWithinPartitions("part", "asks", "node")
        found = both.mapInArrow(runtime.lean(_scored(k, self.kind)), "key binary, best array<struct<far:double,id:long>>")
        return found.groupBy("key").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))

    def widened(self, probes: list, near: list[np.ndarray], visits: int, k: int, target: float) -> int:
        """visits, doubled until the search itself finds target of the probes' true neighbours, or visits all leaves."""
        frame = self.spark.createDataFrame([(bytes(p["key"]), bytes(p["vec"])) for p in probes], "key binary, vec binary")
        true = [(bytes(p["key"]), float(v @ np.frombuffer(p["vec"], self.kind).astype(np.float64))) for p, own in zip(probes, near, strict=True) for v in own]
        while visits < self.leaves:
            least = {bytes(r["key"]): [-x["far"] for x in r["best"]] for r in self.search(frame, visits, k + 1).collect()}
            met = sum(any(abs(s - x) <= 1e-9 * max(1.0, abs(s)) for x in least.get(p, ())) for p, s in true)
            if met >= target * len(true):
                break
            visits *= 2
        return min(visits, self.leaves)


def shares(index: Index, queries: DataFrame, visits: int) -> float:
    """The share of all vectors that a query is compared with, on average."""
    sizes = index.rows.groupBy("node").agg(F.count("*").alias("n"))
    met = index.reached(queries, visits).select("key", F.explode("nodes").alias("node")).join(sizes, "node").groupBy("key").agg(F.sum("n").alias("n"))
    return met.agg(F.avg("n")).first()[0] / max(1, index.n)


def truth(classes: DataFrame, probes: np.ndarray, k: int, kind: str) -> list[np.ndarray]:
    """The k nearest vectors of each probe among all classes, by comparing all. A task keeps k for each probe."""
    found = classes.select("vec").mapInArrow(runtime.lean(_probed(probes, k, kind)), "probe long, best array<struct<far:double,vec:binary>>")
    merged = found.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(32))).groupBy("probe", "salt").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    rows = merged.groupBy("probe").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best")).collect()
    by = {r["probe"]: np.array([np.frombuffer(x["vec"], kind) for x in r["best"]], np.float64) for r in rows}
    return [by.get(p, np.zeros((0, probes.shape[1]))) for p in range(len(probes))]


def built(classes: DataFrame, top: float, kind: str, k: int, sample: int = SAMPLE, target: float = TARGET, leaf: int = LEAF, part: int = PART) -> tuple[Index, int]:
    """The grown tree over classes (key, vec, ids), whose largest norm is top, and the calibrated visits."""
    drawn = classes.select("key", "vec").orderBy(F.xxhash64("key"), "key").limit(sample + PROBES).collect()
    x = np.array([np.frombuffer(r["vec"], kind) for r in drawn], np.float64) if drawn else np.zeros((0, 1))
    held = min(PROBES, len(x) // 8)  # the last of the sample are held out of the fit
    tree = Tree(x[: min(sample, len(x) - held)], top)
    index = Index(classes, tree, kind, leaf, part=part)
    visits = tree.leaves
    if held:
        probes = x[len(x) - held :]
        near = truth(classes, probes, k + 1, kind)  # the probe itself may come first: it is left out
        near = [v[(v != q).any(1)][:k] for q, v in zip(probes, near, strict=True)]
        visits, _ = calibrate(tree, probes, near, target)
        if index.levels:
            visits = index.widened(drawn[len(x) - held :], near, visits, k, target)
    return index, visits


def nearest(vectors: DataFrame, is_query: str, k: int = 20, column: str = "embedding", key: str = "vec_id", sample: int = SAMPLE, target: float = TARGET, leaf: int = LEAF, part: int = PART) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest found; is_query is a SQL condition on key."""
    spark = vectors.sparkSession
    runtime.ship(spark)
    kind = "<f4" if isinstance(vectors.schema[column].dataType.elementType, FloatType) else "<f8"
    rows = vectors.select(F.col(key).cast("long").alias(key), F.col(column).cast("array<double>").alias(column))
    all_ = runtime.written(rows.mapInArrow(runtime.lean(_vectors(column, key, kind)), "vec_id long, key binary, vec binary, dim int, norm double"), "vectors")
    dims = all_.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    all_ = all_.filter(F.col("dim") == F.lit(dims["dim"] if dims else 0))
    ids = all_.select("key", "vec_id").mapInArrow(runtime.lean(_smallest(k + 1)), "key binary, vec_id long").groupBy("key").agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1).alias("ids"))
    classes = runtime.written(all_.groupBy("key").agg(F.any_value("vec").alias("vec")).join(ids, "key"), "vector-classes")

    index, visits = built(classes, all_.agg(F.max("norm")).first()[0] or 1.0, kind, k, sample, target, leaf, part)
    runtime.discard(classes)

    asked = all_.filter(F.expr(is_query.replace(key, "vec_id")))
    queries = asked.groupBy("key").agg(F.any_value("vec").alias("vec"))
    best = runtime.written(index.search(queries, visits, k + 1), "found")
    total = all_.select("vec_id").distinct().limit(k + 1).count()  # as many as a query can meet, if fewer
    while visits < index.leaves:  # queries that met too few go on until they have met enough, or all
        full = best.filter(F.size("best") >= total)
        short = queries.join(full, "key", "left_anti")
        if not short.take(1):
            break
        visits = min(index.leaves, 4 * visits)
        wider = runtime.written(full.unionByName(index.search(short, visits, k + 1)), "found")
        runtime.discard(best)
        best = wider
    own = F.slice(F.filter("best", lambda x: x["id"] != F.col("query_id")), 1, k)
    out = asked.select(F.col("vec_id").alias("query_id"), "key").distinct().join(best, "key").select("query_id", F.posexplode(own).alias("rank", "hit"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.far")).alias("score"))
