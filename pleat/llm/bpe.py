"""Byte-level BPE ids of whole texts, vectorised: split by character class, encode distinct pieces once.

The vocabulary is the ``tokenizers`` JSON file at a given path; ids equal those of
``Tokenizer.from_file(path).encode(text, add_special_tokens=False)`` with special tokens taken as
ordinary text (tests compare them).  Merging distinct pieces runs in tiktoken over the same ranks.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np

from .words import hash_spans

LETTER, NUMBER, BLANK, OTHER = 1, 2, 3, 0
#: Unicode White_Space (fixed values).
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Split pattern of the byte-level vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MOST_PIECES = 1_000_000
_CLASS: np.ndarray | None = None
_MADE: dict[str, PieceCache] = {}


def classes() -> np.ndarray:
    global _CLASS
    if _CLASS is None:
        kinds = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        table[WHITE] = BLANK
        _CLASS = table
    return _CLASS


def byte_names() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


def piece_starts(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Code-point index of every piece's start; ``first`` marks the texts' first code points."""
    n = len(cp)
    kind = classes()[cp]
    fresh = first.copy()
    fresh[1:] |= kind[1:] != kind[:-1]
    start = fresh.copy()
    # white space: its last character leaves a run that non-space follows; a space joins what follows
    last = np.zeros(n, bool)
    last[:-1] = (kind[:-1] == BLANK) & (kind[1:] != BLANK) & ~first[1:]
    start |= last
    joins = np.flatnonzero(last & (cp == 0x20))
    start[joins + 1] = False
    # contractions: an apostrophe alone in its run, not joined to a space
    quote = np.flatnonzero((cp == 0x27) & start & np.append(fresh[1:], True))
    if quote.size:
        def at(i: int) -> np.ndarray:
            j = quote + i
            ok = j < n
            out = np.where(ok, cp[np.minimum(j, n - 1)], 0)
            for k in range(1, i + 1):  # within the same text
                out = np.where((quote + k < n) & ~first[np.minimum(quote + k, n - 1)], out, 0)
            return out

        one, two = at(1), at(2)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = (
            ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        ) & ~short
        size = np.where(short, 2, np.where(long, 3, 0))
        q, size = quote[size > 0], size[size > 0]
        start[q + 1] = False
        ends = q + size
        inside = ends < n
        start[q[size == 3] + 2] = False
        start[ends[inside]] = True
    return np.flatnonzero(start)


class PieceCache:
    """Ids of distinct pieces, kept across the batches of a worker up to a bound."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        names = byte_names()
        ranks = {bytes(names[c] for c in t): i for t, i in vocab.items() if all(c in names for c in t)}
        special = [t for t in vocab if t.startswith("<|")]
        for t in special:
            ranks.pop(t.encode(), None)
        self.encoding = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.newline = vocab["Ċ"]
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)  # sorted hashes, with each one's place in the lists below
        self.slot = np.zeros(0, np.int32)
        self.flat = np.zeros(1 << 20, np.uint32)
        self.bounds = np.zeros(1, np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of sorted hashes, -1 where unknown."""
        if not len(self.known):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.known, keys), len(self.known) - 1)
        return np.where(self.known[at] == keys, self.slot[at], -1).astype(np.int64)

    def add(self, keys: np.ndarray, pieces: list[str]) -> None:
        plain = [i for i, p in enumerate(pieces) if not p[1:].isspace() and "\n" not in p and not p.isspace()]
        joined = self.encoding.encode_ordinary("\n".join(pieces[i] for i in plain)) if plain else []
        ids = np.array(joined, dtype=np.uint32)
        gaps = np.append(np.flatnonzero(ids == self.newline), len(ids))
        lo = 0
        done: list[np.ndarray | None] = [None] * len(pieces)
        if len(gaps) == len(plain):
            for i, hi in zip(plain, gaps, strict=True):
                done[i] = ids[lo:hi]
                lo = hi + 1
        for i, p in enumerate(pieces):
            if done[i] is None:
                done[i] = np.array(self.encoding.encode_ordinary(p), dtype=np.uint32)
        new = np.concatenate(done)
        end = int(self.bounds[-1])
        while end + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[end : end + len(new)] = new
        base = len(self.bounds) - 1
        known = np.concatenate([self.known, keys])
        order = np.argsort(known, kind="stable")
        self.known = known[order]
        self.slot = np.concatenate([self.slot, np.arange(base, base + len(keys), dtype=np.int32)])[order]
        self.bounds = np.concatenate([self.bounds, end + np.cumsum([len(d) for d in done])])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (uint32) of each text."""
        whole = "".join(texts)
        if not whole:
            return [np.zeros(0, np.uint32)] * len(texts)
        cp = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        ends = np.cumsum([len(t) for t in texts])
        first = np.zeros(len(cp) + 1, bool)
        first[0] = True
        first[ends] = True
        first = first[:-1]
        starts = piece_starts(cp, first)
        width = 1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF)
        at = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
        raw = np.frombuffer(whole.encode("utf-8"), dtype=np.uint8)
        stops = np.append(starts[1:], len(cp))
        keys, head, inverse = np.unique(hash_spans(raw, at[starts], at[stops] - at[starts]), return_index=True, return_inverse=True)
        if len(self.known) > MOST_PIECES:
            self.clear()
        slot = self.find(keys)
        missing = np.flatnonzero(slot < 0)
        if missing.size:
            self.add(keys[missing], [whole[starts[h] : stops[h]] for h in head[missing]])
            slot = self.find(keys)
        bounds, slots = self.bounds, slot[inverse]
        lo, count = bounds[slots], bounds[slots + 1] - bounds[slots]
        total = np.cumsum(count)
        take = np.arange(int(total[-1])) - np.repeat(total - count, count) + np.repeat(lo, count)
        ids = self.flat[take]
        cuts = np.concatenate([[0], total])[np.searchsorted(starts, np.concatenate([[0], ends]))]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def piece_cache(path: str) -> PieceCache:
    if path not in _MADE:
        _MADE[path] = PieceCache(path)
    return _MADE[path]
