"""Vectorised words of whole texts: 64-bit hashes straight from Arrow's string buffers.

A word is a maximal run of characters other than space and the five ASCII control spaces (tab to
carriage return), so byte values decide and UTF-8 need not be decoded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
MULT = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche over uint64 (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


BYTE_HASH = mix(np.arange(1, 257, dtype=U64) * MULT)
_POWERS = np.ones(1, dtype=U64)


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = max(n, 64)
        base = np.full(size, U64(0xD1342543DE82EF95))
        base[0] = 1
        with np.errstate(over="ignore"):
            _POWERS = np.multiply.accumulate(base)
    return _POWERS


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 offsets between them; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def word_bounds(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and length of every word, and the n + 1 offsets of the texts in the list of words."""
    n = len(raw)
    inside = ~SPACE[raw]
    if not n or not inside.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    first = np.zeros(n + 1, dtype=bool)
    first[off] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:]))
    return starts, ends - starts + 1, np.searchsorted(starts, off)


def word_hashes(col: pa.Array, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word (A-Z lower-cased if ``fold``) and the texts' offsets in that list."""
    raw, off = buffers(col)
    starts, lens, woff = word_bounds(raw, off)
    return hash_spans(FOLD[raw] if fold else raw, starts, lens), woff


def hash_spans(raw: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Hash of each byte span: a polynomial over uint64 with random byte values, then mixed."""
    if not len(starts):
        return np.zeros(0, U64)
    heads = np.cumsum(lens) - lens
    place = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(heads, lens)
    at = np.repeat(starts, lens) + place
    with np.errstate(over="ignore"):
        h = np.add.reduceat(BYTE_HASH[raw[at]] * powers(int(lens.max()))[place], heads)
        return mix(h + lens.astype(U64) * MULT)


def ngram_hashes(h: np.ndarray, woff: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every k words in a row within a text, with the index of the first word."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(woff) - 1), np.diff(woff))
    ok = np.flatnonzero(text[:m] == text[k - 1 :])
    out = np.full(len(ok), U64(k * int(MULT) & 0xFFFFFFFFFFFFFFFF))
    with np.errstate(over="ignore"):
        for j in range(k):
            out = (out ^ h[ok + j]) * U64(0xD6E8FEB86659FD93)
            out ^= out >> U64(32)
    return mix(out), ok


def shingle_sets(col: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text; a text of fewer words is one shingle, an empty one none."""
    h, woff = word_hashes(col)
    s, at = ngram_hashes(h, woff, k)
    soff = np.searchsorted(at, woff)
    counts = np.diff(woff)
    short: dict[int, np.ndarray] = {}
    for w in range(1, k):
        if (rows := np.flatnonzero(counts == w)).size:
            v, where = ngram_hashes(h, woff, w)
            for r in rows:
                short[int(r)] = v[np.searchsorted(where, woff[r]) :][:1]
    return [short[r] if r in short else np.unique(s[soff[r] : soff[r + 1]]) for r in range(len(counts))]
