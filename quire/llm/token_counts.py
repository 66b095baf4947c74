"""Token counts by overlap resynchronisation (operator 5).

A text of up to chunk_chars code points is encoded whole. A longer one is cut into chunks that overlap; every
chunk is encoded by itself into spans, each with its raw offsets and token count, and neighbouring chunks are
spliced where both have proven the same boundary: in the overlap both hold `stable` consecutive spans with equal
offsets and counts, none of them touching a chunk's cut edge, and the boundary follows white space, across which
the tokenizer never looks. Without such a run the overlap is doubled and the right chunk encoded anew, until the
run is found or the chunk begins where the last splice was made, which is plainly exact.

Nulls count as empty texts (0 bytes, 0 tokens); null ids are kept; repeated rows are counted each; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import runtime
from quire.llm.wordcodec import codec, drops_white_space

CHUNK_CHARS, OVERLAP_CHARS, STABLE = 32_768, 512, 3

#: (starts, ends, counts) of the spans of a text, by raw offsets.
Spans = tuple[np.ndarray, np.ndarray, np.ndarray]
_PIECE = re.compile(r"[^ \t\n\r\x0b\x0c]+")


def piece_spans(path: str) -> Callable[[str], Spans]:
    """Spans are white-space pieces: for tokenizers that drop white space."""
    own = codec(path)

    def encode(text: str) -> Spans:
        found = [(m.start(), m.end(), m.group()) for m in _PIECE.finditer(text)]
        size = own.dtype.itemsize
        starts, ends = (np.fromiter((x[k] for x in found), np.int64, len(found)) for k in (0, 1))
        return starts, ends, np.fromiter((len(b) // size for b in own.encoded([x[2] for x in found])), np.int64, len(found))

    return encode


def token_spans(path: str) -> Callable[[str], Spans]:
    """Spans are the library's tokens gathered up to the next blank that follows a non-blank: for other tokenizers."""
    from quire.llm.wordcodec import _load

    tok = _load(path)
    word = re.compile(r"\s*\S+|\s+$")

    def encode(text: str) -> Spans:
        cuts = [m.end() for m in word.finditer(text)]
        starts = np.array([0, *cuts[:-1]][: len(cuts)], np.int64)
        ends = np.array(cuts, np.int64)
        first = np.array([a for a, _ in tok.encode(text, add_special_tokens=False).offsets], np.int64)
        at = np.searchsorted(starts, first, side="right") - 1
        return starts, ends, np.bincount(at, minlength=len(starts)).astype(np.int64)[: len(starts)] if len(starts) else np.zeros(0, np.int64)

    return encode


def resynchronised(text: str, encode: Callable[[str], Spans], chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, stable: int = STABLE) -> tuple[int, int, int]:
    """(tokens, chunks encoded, overlaps widened) of a text of any length."""
    n = len(text)
    if n <= chunk:
        return int(encode(text)[2].sum()), 1, 0
    total, chunks, widened = 0, 1, 0
    done = 0  # raw offset up to which the total is final
    begin, end = 0, chunk
    s, e, c = encode(text[:end])
    while end < n:
        over = overlap
        while True:
            start = max(done, end - over)
            stop = min(n, max(start + chunk, 2 * end - done if start == done else end + chunk // 2))
            s2, e2, c2 = (x + start if k < 2 else x for k, x in enumerate(encode(text[start:stop])))
            chunks += 1
            if start == done:  # begins where the last splice was made: it holds all that is not final
                break
            # spans of the overlap that touch neither cut edge
            a = (s > start) & (e < end)
            b = (s2 > start) & (e2 < end)
            left = dict(zip(s[a].tolist(), zip(e[a].tolist(), c[a].tolist(), strict=True), strict=True))
            run, cut = 0, None
            for x, y, z in zip(s2[b].tolist(), e2[b].tolist(), c2[b].tolist(), strict=True):
                run = run + 1 if left.get(x) == (y, z) else 0
                if run >= stable:
                    cut = x
                    break
            if cut is not None:
                total += int(c[(s >= done) & (s < cut)].sum())
                done = cut
                break
            over *= 2
            widened += 1
        begin, end, s, e, c = start, stop, s2, e2, c2
    return total + int(c[s >= done].sum()), chunks, widened


def counter(path: str, chunk: int, overlap: int, stable: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fast = drops_white_space(path)
        encode = piece_spans(path) if fast else token_spans(path)
        for batch in batches:
            texts = batch.column("text")
            chars = pc.utf8_length(texts).to_numpy().astype(np.int64)
            tokens, chunks, widened = np.zeros(len(batch), np.int64), np.ones(len(batch), np.int32), np.zeros(len(batch), np.int32)
            if fast:
                short = np.flatnonzero(chars <= chunk)
                tokens[short] = codec(path).counts(texts.take(pa.array(short)))
                rest = np.flatnonzero(chars > chunk)
            else:
                rest = np.arange(len(batch))
            for k in rest.tolist():
                tokens[k], chunks[k], widened[k] = resynchronised(texts[k].as_py(), encode, chunk, overlap, stable)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(tokens), pa.array(chunks), pa.array(widened)], ["doc_id", "n_bytes", "n_tokens", "n_chunks", "n_widened"])

    return run


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, stable: int = STABLE) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, n_chunks, n_widened of every row of docs (doc_id, text)."""
    if overlap_chars < 1 or chunk_chars <= 2 * overlap_chars:
        raise ValueError("chunk_chars must exceed twice overlap_chars")
    runtime.ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), runtime.text_or_empty().alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    out = rows.mapInArrow(runtime.lean(counter(tokenizer, chunk_chars, overlap_chars, stable)), "doc_id long, n_bytes long, n_tokens long, n_chunks int, n_widened int")
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
