"""Token ids in wavelet-matrix shards (operator 10).

A shard file holds the ids of consecutive documents (ascending doc_id) as a wavelet matrix: one bit-plane for each
bit of an id, highest first, every plane ordered by the planes above it. With a rank directory of one counter for
512 bits a plane answers rank and select, and the whole file answers access(i), count(token), rank(token, i),
select(token, k) and occurrences(token) from the compressed file: planes are cut into frames of 16 KiB, and only those
that are looked into are opened.

File layout, little-endian: magic b"QWM2", u32 header length, JSON header {n, bits, docs, size, frame, parts}, then the
parts, each a zstd frame whose length is in the header: doc ids (i64), whether they are given (u8), doc starts (i64),
and for each plane its rank directory (u32) and the frames of its bits.

Each task writes its shards as files of this format to one folder of the shared store, through the file systems that
Arrow knows by their addresses. A table of a row a shard (part, shard, first_doc, n_docs, n_tokens, part_start, file)
says which files count, where their ids begin, and what they hold: files of attempts that failed are not in it.

Nulls in text count as empty; rows with a null doc_id come first; equal doc_ids are ordered by text; repeated rows
are kept, each with its own place; an empty table gives no shards and an empty result; other columns are ignored.
A document is never split, so a shard holds at least one whole document, whatever its length.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import runtime
from quire.llm.wordcodec import codec, drops_white_space

MAGIC, BLOCK = b"QWM2", 512
#: Bytes of a plane in one frame, and frames of a plane that stay open.
FRAME, OPEN_FRAMES = 16_384, 4
SHARD_TOKENS, SLICE_BYTES = 1 << 20, 4 << 20
SHARD_SCHEMA = "part int, shard int, first_doc long, n_docs long, n_tokens long, part_start long, file string"


class Plane:
    """The bits of one plane, in frames of FRAME bytes that are opened when they are looked into; the last few stay open."""

    def __init__(self, size: int, frames: list, opened: np.ndarray | None = None):
        self.size, self.frames, self.opened = size, frames, opened
        self.kept: dict[int, np.ndarray] = {}
        self.opens = 0

    @classmethod
    def of(cls, raw: np.ndarray) -> "Plane":
        return cls(len(raw), [], raw)

    def packed(self) -> list[bytes]:
        squeeze = zstandard.ZstdCompressor(level=1)
        return [squeeze.compress(self.opened[k : k + FRAME].tobytes()) for k in range(0, self.size, FRAME)]

    def frame(self, k: int) -> np.ndarray:
        got = self.kept.get(k)
        if got is None:
            if len(self.kept) >= OPEN_FRAMES:
                self.kept.pop(next(iter(self.kept)))
            self.opens += 1
            got = self.kept[k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.frames[k]), np.uint8)
        return got

    def whole(self) -> np.ndarray:
        if self.opened is not None:
            return self.opened
        open_ = zstandard.ZstdDecompressor()
        return np.frombuffer(b"".join(open_.decompress(f) for f in self.frames), np.uint8)

    def take(self, at: np.ndarray) -> np.ndarray:
        """Bytes at the given places; 0 behind the end."""
        out = np.zeros(at.shape, np.uint8)
        if self.opened is not None:
            inside = at < self.size
            out[inside] = self.opened[at[inside]]
            return out
        which = np.where(at < self.size, at // FRAME, -1)
        for k in np.unique(which[which >= 0]).tolist():
            own = which == k
            out[own] = self.frame(k)[at[own] - k * FRAME]
        return out


class WaveletMatrix:
    def __init__(self, n: int, bits: int, planes: list[Plane], ranks: list[np.ndarray]):
        self.n, self.bits, self.planes, self.ranks = n, bits, planes, ranks
        self.zeros = [n - int(r[-1]) for r in ranks]

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> "WaveletMatrix":
        a, planes, ranks = ids, [], []
        for level in range(bits - 1, -1, -1):
            one = (a >> a.dtype.type(level)).astype(np.uint8) & np.uint8(1)
            plane = np.packbits(one, bitorder="little")
            pad = -len(plane) % (BLOCK // 8)
            plane = np.concatenate((plane, np.zeros(pad, np.uint8))) if pad else plane
            per = np.bitwise_count(plane.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1, dtype=np.uint32)
            planes.append(Plane.of(plane))
            ranks.append(np.concatenate((np.zeros(1, np.uint32), np.cumsum(per, dtype=np.uint32))))
            one = one.view(bool)
            a = np.concatenate((np.compress(~one, a), np.compress(one, a)))
        return cls(len(ids), bits, planes, ranks)

    def _rank1(self, level: int, i: np.ndarray) -> np.ndarray:
        """Ones before each position i of a plane, by its directory and one block."""
        i = np.asarray(i, np.int64)
        block = i // BLOCK
        own = self.planes[level].take(block[:, None] * (BLOCK // 8) + np.arange(BLOCK // 8))
        left = i - block * BLOCK  # bits of the block that count
        bits = np.clip(left[:, None] - 8 * np.arange(BLOCK // 8), 0, 8)
        return self.ranks[level][block].astype(np.int64) + np.bitwise_count(own & ((1 << bits) - 1).astype(np.uint8)).sum(1, dtype=np.int64)

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) bit of the given value in a plane, by its directory and one block."""
        r = self.ranks[level].astype(np.int64)
        before = r if bit else np.arange(len(r), dtype=np.int64) * BLOCK - r
        block = int(np.searchsorted(before, k, side="right")) - 1
        own = np.unpackbits(self.planes[level].take(block * (BLOCK // 8) + np.arange(BLOCK // 8)), bitorder="little")
        return block * BLOCK + int(np.flatnonzero(own == bit)[k - int(before[block])])

    def access(self, i) -> np.ndarray:
        pos = np.atleast_1d(np.asarray(i, np.int64))
        value = np.zeros(len(pos), np.int64)
        for level in range(self.bits):
            one = (self.planes[level].take(pos >> 3) >> (pos & 7).astype(np.uint8)) & 1
            rank = self._rank1(level, pos)
            pos = np.where(one, self.zeros[level] + rank, pos - rank)
            value = value << 1 | one
        return value

    def _node(self, token: int, i: int) -> tuple[int, int]:
        """The interval that the token's occurrences before i take below the last plane."""
        lo, hi = 0, i
        for level in range(self.bits):
            a, b = self._rank1(level, np.array([lo, hi]))
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if token >> (self.bits - 1 - level) & 1 else (lo - a, hi - b)
        return int(lo), int(hi)

    def rank(self, token: int, i: int) -> int:
        if not 0 <= token < 1 << self.bits:
            return 0
        lo, hi = self._node(token, i)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        pos = self._node(token, self.n)[0] + k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            pos = self._select(level, bit, pos - self.zeros[level] if bit else pos)
        return pos

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """All ids at once, undoing the planes from the last to the first."""
        dtype = np.uint16 if self.bits <= 16 else np.uint32
        a = np.zeros(self.n, dtype)
        for level in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[level].whole(), count=self.n, bitorder="little").view(bool)
            z, up = self.zeros[level], np.empty(self.n, dtype)
            np.place(up, ~one, a[:z])
            np.place(up, one, a[z:] | dtype(1 << (self.bits - 1 - level)))
            a = up
        return a


class Shard:
    """Documents and their ids, as one file."""

    def __init__(self, doc_ids: np.ndarray, has_id: np.ndarray, starts: np.ndarray, matrix: WaveletMatrix):
        self.doc_ids, self.has_id, self.starts, self.matrix = doc_ids, has_id, starts, matrix

    def to_bytes(self) -> bytes:
        squeeze = zstandard.ZstdCompressor(level=1)
        parts = [squeeze.compress(x.tobytes()) for x in (self.doc_ids.astype("<i8"), self.has_id.astype(np.uint8), self.starts.astype("<i8"))]
        for plane, ranks in zip(self.matrix.planes, self.matrix.ranks, strict=True):
            parts += [squeeze.compress(ranks.astype("<u4").tobytes()), *plane.packed()]
        size = self.matrix.planes[0].size
        head = json.dumps({"n": self.matrix.n, "bits": self.matrix.bits, "docs": len(self.doc_ids), "size": size, "frame": FRAME, "parts": [len(p) for p in parts]}).encode()
        return b"".join([MAGIC, struct.pack("<I", len(head)), head, *parts])

    @classmethod
    def from_bytes(cls, data: bytes) -> "Shard":
        """The shard over its file: only directories are opened, frames of planes when they are looked into."""
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet-matrix shard")
        size = struct.unpack("<I", data[4:8])[0]
        head = json.loads(data[8 : 8 + size])
        if head["frame"] != FRAME:
            raise ValueError(f"frames of {head['frame']} bytes")
        at, parts, open_, view = 8 + size, [], zstandard.ZstdDecompressor(), memoryview(data)
        for k in head["parts"]:
            parts.append(view[at : at + k])
            at += k
        docs, has, starts = (open_.decompress(p) for p in parts[:3])
        per = 1 + -(-head["size"] // FRAME)
        own = [parts[3 + k * per : 3 + (k + 1) * per] for k in range(head["bits"])]
        matrix = WaveletMatrix(head["n"], head["bits"], [Plane(head["size"], p[1:]) for p in own], [np.frombuffer(open_.decompress(p[0]), "<u4") for p in own])
        return cls(np.frombuffer(docs, "<i8"), np.frombuffer(has, np.uint8).astype(bool), np.frombuffer(starts, "<i8"), matrix)


def _encoder(path: str) -> tuple[Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], int]:
    if drops_white_space(path):
        own = codec(path)
        return own.ids, max(1, (own.tok.get_vocab_size() - 1).bit_length())
    from quire.llm.wordcodec import _load

    tok = _load(path)

    def ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        each = [np.array(e.ids, np.uint32) for e in tok.encode_batch(texts.to_pylist(), add_special_tokens=False)]
        return np.concatenate(each) if each else np.zeros(0, np.uint32), np.cumsum([0, *map(len, each)])

    return ids, max(1, (tok.get_vocab_size() - 1).bit_length())


def _file_system(address: str) -> tuple[fs.FileSystem, str]:
    """Of an address such as Spark writes it; without a scheme, or with file:, it is a local path of a folder that all share."""
    if address.startswith("file:") or "://" not in address:
        return fs.LocalFileSystem(), "/" + address.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(address)


def put(address: str, payload: bytes) -> None:
    system, path = _file_system(address)
    with system.open_output_stream(path) as f:
        f.write(payload)


def shard(address: str) -> Shard:
    """A shard from its file."""
    system, path = _file_system(address)
    with system.open_input_file(path) as f:
        return Shard.from_bytes(f.read())


def shard_writer(path: str, end_id: int, shard_tokens: int, folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encode, bits = _encoder(path)
        bits = max(bits, end_id.bit_length())
        dtype = np.uint16 if bits <= 16 else np.uint32
        held: list[tuple] = []  # (doc ids, has id, lengths, ids)
        number = before = size = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, before, size, held
            docs, has, lengths, ids = (np.concatenate([h[k] for h in held]) for k in range(4))
            held, n = [], len(ids)
            payload = Shard(docs, has, np.cumsum(lengths) - lengths, WaveletMatrix.build(ids, bits)).to_bytes()
            first = pa.array([int(docs[0]) if has[0] else None], pa.int64())
            file = f"{folder}/{part:06d}-{number:06d}-{uuid.uuid4().hex}.qwm"  # a name for this attempt alone
            put(file, payload)
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), first, pa.array([len(docs)], pa.int64()), pa.array([n], pa.int64()), pa.array([before], pa.int64()), pa.array([file])], ["part", "shard", "first_doc", "n_docs", "n_tokens", "part_start", "file"])
            number, before, size = number + 1, before + n, 0
            return out

        for batch in batches:
            texts = batch.column("text")
            ends = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, offset=4 * texts.offset).astype(np.int64)
            cuts = np.unique(np.concatenate(([0], np.searchsorted(ends - ends[0], np.arange(SLICE_BYTES, ends[-1] - ends[0], SLICE_BYTES)), [len(texts)])))
            keys = batch.column("doc_id")
            docs, has = keys.fill_null(0).to_numpy(zero_copy_only=False), keys.is_valid().to_numpy(zero_copy_only=False)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                flat, at = encode(texts.slice(a, b - a))
                n = np.diff(at) + 1
                stops = np.cumsum(n)
                ids = np.empty(int(stops[-1]), dtype)
                mark = np.zeros(len(ids), bool)
                mark[stops - 1] = True
                ids[mark], ids[~mark] = end_id, flat
                i = 0
                while i < b - a:  # whole documents until the shard is full
                    base = int(stops[i - 1]) if i else 0
                    j = max(i + 1, int(np.searchsorted(stops, base + shard_tokens - size, side="right")))
                    held.append((docs[a + i : a + j], has[a + i : a + j], n[i:j], ids[base : int(stops[j - 1])]))
                    size += int(stops[j - 1]) - base
                    i = j
                    if size >= shard_tokens or i < b - a:
                        yield flush()
        if held:
            yield flush()

    return run


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, shard_tokens: int = SHARD_TOKENS, folder: str | None = None) -> DataFrame:
    """The table of the shard files of docs (doc_id, text), written in ascending doc_id order to folder, or to one of its own in the shared folder."""
    spark = docs.sparkSession
    runtime.ship(spark)
    folder = runtime.new_folder(spark, folder or f"{runtime.shared_folder(spark).rstrip('/')}/quire-shards-{uuid.uuid4().hex}")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), runtime.text_or_empty().alias("text"))
    n = max(rows.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism * 2)
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return runtime.written(rows.mapInArrow(runtime.lean(shard_writer(tokenizer, end_id, shard_tokens, folder)), SHARD_SCHEMA), "tokens")


def part_starts(shards: DataFrame) -> dict[int, int]:
    """Ids before each part: one number for each task that wrote, never for each document."""
    rows = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    out, total = {}, 0
    for r in sorted(rows, key=lambda r: r["part"]):
        out[r["part"]], total = total, total + r["n"]
    return out


def read_tokens(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read back from the shard files."""
    starts = shards.sparkSession.sparkContext.broadcast(part_starts(shards))
    n = max(shards.sparkSession.sparkContext.defaultParallelism, int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                own = shard(batch.column("file")[k].as_py())
                base = starts.value[batch.column("part")[k].as_py()] + batch.column("part_start")[k].as_py()
                ids, at = own.matrix.decode().astype("<u4"), np.append(own.starts, own.matrix.n)
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(own.doc_ids, pa.int64(), mask=~own.has_id), pa.array(own.starts + base), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # rows are names only: dealt out, so that files are read by as many tasks as there are
    names = shards.select("part", "part_start", "file").repartition(n, "file")
    return names.mapInArrow(runtime.lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long")
