"""64-bit hashes of word shingles, over whole batches in numpy.

Words are the maximal runs of bytes other than space and \\t..\\r, with A-Z lower-cased. A shingle is five
consecutive words; a text of one to four words is one shingle, a text without words has none. Word hashes are
polynomials over the word's bytes (random odd byte values, mixed), read off prefix sums; shingle hashes combine
the word hashes. Two given different shingles collide with a chance of about 2**-64.
"""

from __future__ import annotations

import numpy as np

WIDTH, SLICE = 5, 1 << 18
_U = np.uint64


def _fixed(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit values, the same everywhere."""
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
_BYTES = _fixed(256, 17)
_BYTES[65:91] = _BYTES[97:123]
_BYTES[_WHITE] = 0
_PLACE, _LENGTH = _fixed(WIDTH, 71), _fixed(WIDTH + 1, 113)
_tables = {"n": 0}


def _tabled(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _tables["n"] < n:
        m = max(n, 2 * SLICE)
        _tables.update(n=m, up=_powers(_BASE, m), down=_powers(_INVERSE, m))
    return _tables["up"], _tables["down"]


def word_spans(texts: list[bytes], apart: np.ndarray = _WHITE) -> tuple:
    """Words of a slice as (prefix sums, inverse powers, first and last byte of each, words in each text).

    apart marks the bytes between words; the hash of bytes a..b is mix((sums[b] - sums[a - 1]) * inverse[a]).
    """
    joined = b"\n" + b"\n".join(texts) + b"\n"
    buf = np.frombuffer(joined, np.uint8)
    white = apart[buf]
    up, down = _tabled(len(buf))
    sums = _BYTES[buf]
    sums *= up[: len(buf)]
    np.cumsum(sums, out=sums)
    edges = np.flatnonzero(white[1:] != white[:-1])
    first, last = edges[0::2] + 1, edges[1::2]  # of each word
    stops = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return sums, down, first, last, np.diff(np.searchsorted(first, stops + 1), prepend=0)


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a slice, and the number of words in each text."""
    sums, down, first, last, n = word_spans(texts)
    return mix((sums[last] - sums[first - 1]) * down[first]), n


def slices(texts: list[bytes]):
    """Runs of texts of about SLICE bytes, one text at least."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) < SLICE):
            size += len(texts[j]) + 1
            j += 1
        yield i, j
        i = j


def _slice_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    words, n = _word_hashes(texts)
    first = np.cumsum(n) - n
    many = np.where(n >= WIDTH, n - WIDTH + 1, (n > 0).astype(np.int64))
    at = np.concatenate(([0], np.cumsum(many)))
    out = np.empty(int(at[-1]), _U)
    long = n >= WIDTH
    if long.any():
        m = len(words) - WIDTH + 1
        h = words[:m] * _PLACE[0]
        for j in range(1, WIDTH):
            h += words[j : j + m] * _PLACE[j]
        h += _LENGTH[WIDTH]
        h = mix(h)
        within = np.ones(m, bool)  # shingles that don't cross into the next text
        for j in range(1, WIDTH):
            cross = first[first >= j] - j
            within[cross[cross < m]] = False
        if long.all():
            out = h[within]
        else:
            mine = np.repeat(long, n)[:m]
            place = np.repeat(long, many)
            out[place] = h[within & mine]
    for k in range(1, WIDTH):
        own = np.flatnonzero(n == k)
        if len(own):
            h = np.full(len(own), _LENGTH[k], _U)
            for j in range(k):
                h += words[first[own] + j] * _PLACE[j]
            out[at[own]] = mix(h)
    return out, at


def shingle_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's shingles in order, repeats included, and the len(texts) + 1 offsets between texts."""
    hashes, counts = [], []
    for i, j in slices(texts):
        h, at = _slice_hashes(texts[i:j])
        hashes.append(h)
        counts.append(np.diff(at))
    if not hashes:
        return np.zeros(0, _U), np.zeros(1, np.int64)
    return np.concatenate(hashes), np.concatenate(([0], np.cumsum(np.concatenate(counts))))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct hashes of each text."""
    h, at = shingle_hashes(texts)
    return [np.unique(h[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
