"""SentencePiece encoding and decoding by a shared-prefix forward pass (operator 8).

A text is marked (a blank becomes U+2581, one is put in front) and cut into marked words: a run of marks with what
follows up to the next mark, cut again around characters that no longer piece holds, and behind letters where no piece goes on from them. No piece crosses such a cut,
so the words' ids, one after another, are the text's. The distinct words of a batch are sorted, which lays them
out as a trie, and walked depth-first: for every prefix the walk holds a forward state, and a word starts from the
states of the prefix that it shares with the word before.

Unigram models: the state is the best score of the prefix and its last piece (Viterbi). BPE models, which have no
additive score: the state is the last piece of the prefix's encoding. That piece is the only one that ends there
and forms a stable pair with the last piece of the rest, a pair being stable if merging its two pieces' characters
by the model's own order gives the pair back; merges keep their order on any part of a word, so stable pairs, and
only they, make up the encoding. The results equal the sentencepiece library's.

Only models with the identity normaliser and byte fallback are taken; others raise ValueError. Nulls in text count
as empty (no ids); null ids and repeated rows are kept; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import runtime

MARK = "▁"
#: Bytes kept in a worker's cache of words, with so many for an entry itself, and entries of its cache of pairs of pieces; beyond that they
#: start anew. Longer words aren't kept behind their slice. Bounds memory, not results.
WORD_BYTES, ENTRY_BYTES, LONGEST, PAIRS, SLICE_BYTES = 64 << 20, 150, 256, 500_000, 4 << 20
_UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 2, 3, 4, 5, 6
_MODELS: dict[str, "PieceModel"] = {}


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol-buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[i : i + n]
            i += n
        else:
            n = 4 if kind == 5 else 8
            yield key >> 3, struct.unpack("<f" if n == 4 else "<d", data[i : i + n])[0]
            i += n


def model(path: str) -> "PieceModel":
    if path not in _MODELS:
        with open(path, "rb") as f:
            _MODELS[path] = PieceModel(f.read())
    return _MODELS[path]


class PieceModel:
    def __init__(self, data: bytes):
        pieces, kinds, scores, trainer, normal = [], [], [], {}, {}
        for field, value in _fields(data):
            if field == 1:
                own = dict(_fields(value))
                pieces.append(own[1].decode())
                scores.append(own.get(2, 0.0))
                kinds.append(own.get(3, 1))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normal = dict(_fields(value))
        self.bpe = trainer.get(3, 1) == 2
        if trainer.get(3, 1) not in (1, 2) or normal.get(2) or _BYTE not in kinds or _USER in kinds or _UNUSED in kinds or normal.get(4, 1) or not normal.get(5, 1) or trainer.get(24, 0):
            raise ValueError("only unigram and BPE models with the identity normaliser, byte fallback and plain pieces are supported")
        self.prefix = MARK if normal.get(3, 1) else ""
        self.pieces, self.kinds = pieces, kinds
        self.ids = {p: k for k, (p, kind) in enumerate(zip(pieces, kinds, strict=True)) if kind == 1}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has a mark behind other characters")
        self.score = {p: scores[k] for p, k in self.ids.items()}
        self.unknown = min(self.score.values(), default=0.0) - 10.0
        self.longest = max(map(len, self.ids), default=1)
        self.tails = {p[k:] for p in self.ids for k in range(len(p))}
        self.bytes_ = {int(p[3:5], 16): k for k, (p, kind) in enumerate(zip(pieces, kinds, strict=True)) if kind == _BYTE}
        joint = set("".join(p for p in self.ids if len(p) > 1)) | {MARK}
        some = re.escape("".join(sorted(joint - {MARK})))
        # a marked word's parts: runs of joinable characters with the marks before them, or one other character; runs
        # end behind letters where no piece goes on from a letter to another character
        letters = re.escape("".join(sorted(c for c in joint if c.isalpha())))
        others = re.escape("".join(sorted(c for c in joint - {MARK} if not c.isalpha())))
        apart = letters and others and not any(a.isalpha() and not b.isalpha() for p in self.ids for a, b in zip(p, p[1:]))  # noqa: B905
        run = f"{MARK}*[{others}]*[{letters}]+|{MARK}*[{others}]+" if apart else f"{MARK}*[{some}]+"
        self.parts = re.compile(f"{run}|{MARK}+|[^{some}{MARK}]", re.DOTALL)
        self.words: dict[str, bytes] = {}
        self.long: list[str] = []
        self.word_bytes = 0
        self.stable: dict[tuple[str, str], bool] = {}
        self.out = [b"" if kind == _CONTROL else " ⁇ ".encode() if kind == _UNKNOWN else bytes([int(p[3:5], 16)]) if kind == _BYTE else p.replace(MARK, " ").encode() for p, kind in zip(pieces, kinds, strict=True)]

    def merged(self, text: str) -> list[str]:
        """The BPE symbols of a short text, merged pair by pair in the model's order."""
        own, score = list(text), self.score
        while len(own) > 1:
            best, at = None, -1
            for k in range(len(own) - 1):
                s = score.get(own[k] + own[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            own[at : at + 2] = [own[at] + own[at + 1]]
        return own

    def pair(self, a: str, b: str) -> bool:
        got = self.stable.get((a, b))
        if got is None:
            if len(self.stable) >= PAIRS:
                self.stable.clear()
            got = self.stable[a, b] = self.merged(a + b) == ([a, b] if a else [b])
        return got

    def _piece_ids(self, piece: str) -> list[int]:
        own = self.ids.get(piece)
        return [own] if own is not None else [self.bytes_[b] for b in piece.encode()]

    def forward(self, words: list[str]) -> list[list[str]]:
        """Pieces of each of the sorted words, by a depth-first walk of their trie."""
        ids, score, longest, tails, stable, out = self.ids, self.score, self.longest, self.tails, self.stable, []
        last: list[str] = [""]  # last piece of each prefix's encoding
        best = [0.0]
        before = ""
        for word in words:
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], best[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                first = max(0, end - longest)
                if self.bpe:
                    found, start, ending = word[end - 1], end, []
                    while start > first:  # pieces that end here, while any piece ends so
                        start -= 1
                        piece = word[start:end]
                        if piece not in tails:
                            break
                        if piece in ids:
                            ending.append((last[start], piece))
                    for pair in reversed(ending):
                        good = stable.get(pair)
                        if good is None:
                            good = self.pair(*pair)
                        if good:
                            found = pair[1]
                            break
                    last.append(found)
                    best.append(0.0)
                else:
                    top, found = -1e300, ""
                    for start in range(first, end):
                        piece = word[start:end]
                        s = score.get(piece)
                        if s is None and end - start == 1:
                            s = self.unknown
                        if s is not None and best[start] + s > top:
                            top, found = best[start] + s, piece
                    last.append(found)
                    best.append(top)
            pieces, end = [], len(word)
            while end:
                pieces.append(last[end])
                end -= len(last[end])
            out.append(pieces[::-1])
            before = word
        return out

    def _learn(self, marked: list[str]) -> None:
        """Put the parts of new marked words into the cache."""
        for word in self.long:
            self.words.pop(word, None)
        self.long = []
        if self.word_bytes > WORD_BYTES:
            self.words.clear()
            self.word_bytes = 0
        new = sorted(set(chain.from_iterable(map(self.parts.findall, marked))) - self.words.keys())
        for word, pieces in zip(new, self.forward(new), strict=True):
            got = self.words[word] = array("i", [k for p in pieces for k in self._piece_ids(p)]).tobytes()
            if len(word) > LONGEST:
                self.long.append(word)
            else:
                self.word_bytes += len(word) + len(got) + ENTRY_BYTES

    def encoded(self, marked: list[str]) -> list[bytes]:
        """ids of marked words, as little-endian 32-bit integers."""
        self._learn(marked)
        words = self.words
        return [b"".join([words[p] for p in self.parts.findall(w)]) for w in marked]

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts without nulls, and the len(texts) + 1 offsets between them."""
        if not len(texts):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        marked = pc.replace_substring(texts, MARK, " ")
        # pieces between single blanks; where blanks meet or stand at an end, the text is cut by _cut instead
        odd = pc.or_(pc.match_substring_regex(marked, "  |^ | $"), pc.equal(marked, "")).to_numpy(zero_copy_only=False) | (self.prefix == "")
        plain = pc.split_pattern(pc.if_else(pa.array(odd), "", marked), " ")
        coded = plain.flatten().dictionary_encode()
        ends = np.frombuffer(plain.buffers()[1], np.int32, len(plain) + 1, offset=4 * plain.offset).astype(np.int64)
        ends -= ends[0]
        ids = self.encoded([MARK + w if w else "" for w in coded.dictionary.to_pylist()])
        flat, each = np.frombuffer(b"".join(ids), "<i4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        index, starts = coded.indices.to_numpy(), np.cumsum(each) - each
        n = each[index]
        total = np.concatenate(([0], np.cumsum(n)))
        at = np.repeat(starts[index] - total[:-1], n) + np.arange(total[-1])
        out, offsets = flat[at], total[ends]
        if odd.any():
            rows = [out[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            for k in np.flatnonzero(odd).tolist():
                rows[k] = self.encode(marked[k].as_py())
            out, offsets = np.concatenate(rows), np.concatenate(([0], np.cumsum([len(r) for r in rows])))
        return out, offsets

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, "<i4")
        words = re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", self.prefix + text.replace(" ", MARK), re.DOTALL)
        return np.frombuffer(b"".join(self.encoded(words)), "<i4")

    def decode(self, ids: np.ndarray) -> str:
        out, known = self.out, [k for k in ids.tolist() if self.kinds[k] != _CONTROL]
        raw = b"".join([out[k] for k in known])
        if self.prefix and known and self.pieces[known[0]].startswith(MARK):
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return _mended(raw)


def _mended(raw: bytes) -> str:
    """Every byte that is no part of a character becomes U+FFFD."""
    out, i = [], 0
    while i < len(raw):
        n = 1 if raw[i] < 128 else 2 if raw[i] >> 5 == 6 else 3 if raw[i] >> 4 == 14 else 4
        try:
            out.append(raw[i : i + n].decode())
            i += n
        except UnicodeDecodeError:
            out.append("�")
            i += 1
    return "".join(out)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    ends = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, offset=4 * texts.offset).astype(np.int64)
    ends -= ends[0] if len(ends) else 0
    cuts = np.unique(np.concatenate(([0], np.searchsorted(ends, np.arange(SLICE_BYTES, ends[-1], SLICE_BYTES)), [len(texts)])))
    yield from zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)


def encode(docs: DataFrame, path: str, *keep: str) -> DataFrame:
    """doc_id, ids (array of int) and the columns named in keep of every row of docs (doc_id, text)."""
    runtime.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            texts = batch.column("text")
            for a, b in _slices(texts):
                ids, at = own.encode_batch(texts.slice(a, b - a))
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32, copy=False)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), lists, *(batch.column(c).slice(a, b - a) for c in keep)], ["doc_id", "ids", *keep])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), runtime.text_or_empty().alias("text"), *keep)
    return rows.mapInArrow(runtime.lean(run), ", ".join(["doc_id long, ids array<int>", *(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)]))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers) of every row of encoded (doc_id, ids); null ids count as none."""
    runtime.ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            lists = batch.column("ids")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            stops = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            rows = [flat[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([own.decode(r) for r in rows], pa.string()), pa.array([len(r) for r in rows], pa.int64()), pa.array([zlib.crc32(r.tobytes()) for r in rows], pa.int64())],
                ["doc_id", "text", "n_tokens", "ids_crc32"],
            )

    return encoded.select("doc_id", "ids").mapInArrow(runtime.lean(run), "doc_id long, text string, n_tokens long, ids_crc32 long")
