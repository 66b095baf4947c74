"""Exact, fast encoding for tokenizers that drop white space: distinct white-space pieces are encoded once.

Such a tokenizer's normaliser and pre-tokeniser never look across ASCII white space, so the ids of a text are
the ids of its pieces, one after another. Each distinct piece is encoded by the tokenizers library itself: its
model on the pre-tokenised parts, or the whole library for a piece that may hold a special string.
"""

from __future__ import annotations

import json
import os
import sys
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes kept in each of a worker's two caches, with so many for an entry itself; beyond that a cache starts anew. Longer pieces aren't kept. Bounds memory, not results.
CACHE_BYTES, ENTRY_BYTES, LONGEST = 96 << 20, 150, 256

#: Marks that no special string of a tokenizer begins with.
_MARKS = "#$%&*.,;:!?)"
_CODECS: dict[str, "WordCodec"] = {}


def _load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def drops_white_space(path: str) -> bool:
    """Whether the tokenizer file splits at white space and drops it, which WordCodec needs."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    parts = pre.get("pretokenizers", [pre])
    first = parts[0] if parts else {}
    pattern = (first.get("pattern") or {}).get("Regex", "")
    return first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert")) and "[^\\s" in pattern


def codec(path: str) -> "WordCodec":
    """One codec per worker and file: its cache serves all tasks of the worker."""
    if path not in _CODECS:
        _CODECS[path] = WordCodec(path)
    return _CODECS[path]


class WordCodec:
    """ids of white-space pieces as little-endian bytes, 2 or 4 to an id."""

    def __init__(self, path: str):
        import regex

        self.tok = _load(path)
        self.model, self.norm, self.pre = self.tok.model, self.tok.normalizer, self.tok.pre_tokenizer
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.mark = os.path.commonprefix(self.special) if self.special else "\0none\0"
        self.dtype = np.dtype("<u2") if self.tok.get_vocab_size() <= 65536 else np.dtype("<u4")
        # The file's own pattern for lower-case Latin text, where both regex engines and all Unicode versions agree.
        self.latin = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^\sa-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
        self.plain = regex.compile(r"[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
        self.shown = self._byte_letters()
        self.simple = self._latin_agrees()
        self.bare = self.simple and not self.mark.rstrip(_MARKS).isalpha() and not set(self.mark) <= set(_MARKS)
        self.pieces: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.piece_bytes = self.part_bytes = 0

    def _byte_letters(self) -> dict[int, str]:
        """What the pre-tokeniser shows for each byte of a letter's UTF-8, read off the library."""
        out = {}
        for c in range(0xC0, 0x100):
            shown = "".join(p for p, _ in self.pre.pre_tokenize_str(chr(c)))
            if len(shown) == 2:
                out.update(zip(chr(c).encode(), shown, strict=True))
        return out

    def _latin_agrees(self) -> bool:
        probe = "Ab,c xyz.!? w### A, q:;) It's he'LL don't 'dx a1b22,c!?--''s _x@y.z x'm ~`|<> we've 3rd".split()
        probe += [f"a{chr(c)}{chr(c)}1{chr(c)}'s" for c in range(0xC0, 0x100) if self.plain.fullmatch(chr(c))]
        return all(self._fast(w) == [p for p, _ in self.pre.pre_tokenize_str(self.norm.normalize_str(w))] for w in probe)

    def _fast(self, piece: str) -> list[str]:
        if piece.isascii():
            return self.latin.findall(piece.lower())
        return [p if p.isascii() else p.encode().decode("latin-1").translate(self.shown) for p in self.latin.findall(piece.lower())]

    def _part(self, part: str) -> bytes:
        got = self.parts.get(part)
        if got is None:
            ids = array("H" if self.dtype.itemsize == 2 else "I", [t.id for t in self.model.tokenize(part)])
            got = ids.tobytes() if sys.byteorder == "little" else np.array(ids, self.dtype).tobytes()
            if len(part) <= LONGEST:
                self.part_bytes += len(part) + len(got) + ENTRY_BYTES
                if self.part_bytes > CACHE_BYTES:
                    self.parts.clear()
                    self.part_bytes = 0
                self.parts[part] = got
        return got

    def piece(self, piece: str) -> bytes:
        if not piece:
            return b""
        if self.bare and piece.isascii():  # an ASCII word, perhaps with marks behind it, which are one part
            word = piece.rstrip(_MARKS)
            if word.isalpha():
                return self._part(word.lower()) + self._part(piece[len(word) :]) if len(word) < len(piece) else self._part(word.lower())
        if self.mark in piece and any(s in piece for s in self.special):
            return np.array(self.tok.encode(piece, add_special_tokens=False).ids, self.dtype).tobytes()
        if self.simple and self.plain.fullmatch(piece):
            parts = self._fast(piece)
        else:
            parts = [p for p, _ in self.pre.pre_tokenize_str(self.norm.normalize_str(piece))]
        return b"".join(map(self._part, parts)) if len(parts) != 1 else self._part(parts[0])

    def encoded(self, pieces: list[str]) -> list[bytes]:
        if self.piece_bytes > CACHE_BYTES:
            self.pieces.clear()
            self.piece_bytes = 0
        get, put, make = self.pieces.get, self.pieces.__setitem__, self.piece
        out, more = [], 0
        for p in pieces:
            got = get(p)
            if got is None:
                got = make(p)
                if len(p) <= LONGEST:
                    put(p, got)
                    more += len(p) + len(got) + ENTRY_BYTES
            out.append(got)
        self.piece_bytes += more
        return out

    def _split(self, texts: pa.Array):
        """(ends of the texts, which ids each part has, ids) of the texts' parts in order. A piece is one part, or two where its words can be cut in columns: a plain word in small letters, and the marks behind it."""
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        ends = np.frombuffer(lists.buffers()[1], np.int32, len(lists) + 1, offset=4 * lists.offset).astype(np.int64)
        ends -= ends[0]
        index, pieces = coded.indices.to_numpy(), coded.dictionary
        if not self.bare:
            return ends, index, self.encoded(pieces.to_pylist())
        lower = pc.ascii_lower(pieces)
        word = pc.ascii_rtrim(lower, characters=_MARKS)
        plain = pc.and_(pc.string_is_ascii(pieces), pc.ascii_is_alpha(word))
        marked = pc.and_(plain, pc.less(pc.binary_length(word), pc.binary_length(lower)))
        words = word.filter(plain).dictionary_encode()
        marks = pc.replace_substring_regex(lower.filter(marked), "^[a-z]+", "").dictionary_encode()
        others = pieces.filter(pc.invert(plain)).to_pylist()
        get, make = self.parts.get, self._part
        ids = [w if (w := get(x)) is not None else make(x) for x in words.dictionary.to_pylist()] + self.encoded(others) + [b""] + [make(x) for x in marks.dictionary.to_pylist()]
        none = len(words.dictionary) + len(others)
        pair = np.full((len(pieces), 2), none, np.int64)
        is_plain = plain.to_numpy(zero_copy_only=False)
        pair[is_plain, 0] = words.indices.to_numpy()
        pair[~is_plain, 0] = len(words.dictionary) + np.arange(len(others))
        pair[marked.to_numpy(zero_copy_only=False), 1] = none + 1 + marks.indices.to_numpy()
        return 2 * ends, pair[index].reshape(-1), ids

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; texts holds no nulls."""
        if not len(texts):
            return np.zeros(0, np.int64)
        ends, index, ids = self._split(texts)
        each = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        total = np.concatenate(([0], np.cumsum(each[index])))
        return total[ends[1:]] - total[ends[:-1]]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, and the len(texts) + 1 offsets between them."""
        if not len(texts):
            return np.zeros(0, self.dtype), np.zeros(1, np.int64)
        ends, index, ids = self._split(texts)
        flat = np.frombuffer(b"".join(ids), self.dtype)
        each = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        starts = np.cumsum(each) - each
        n = each[index]
        total = np.concatenate(([0], np.cumsum(n)))
        at = np.repeat(starts[index] - total[:-1], n)
        at += np.arange(total[-1])
        return flat[at], total[ends]
