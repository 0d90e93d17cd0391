"""Sampled SentencePiece segmentations: forward filtering and backward sampling over the piece lattice.

Texts are bytes with the space as the word mark.  Pieces never cross from a non-space into a space,
so the lattice falls apart into segments (spaces and the word behind them), whose forward sums are
computed once per distinct segment and kept in the worker.  Every occurrence then draws its own path
from the end of its segment, with uniform numbers hashed from the row's key, the segment's place and
the step: the same row always gets the same pieces, wherever it runs.  Bytes without a piece use the
vocabulary's byte pieces, so decoding gives back every text exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import add_columns
from .words import BYTE_HASH, MULT, U64, buffers, hash_spans, mix, powers

MARK = "▁"
BYTE_PENALTY = -25.0
#: Edges of the lattices of distinct segments that a worker keeps.
MOST_EDGES = 3_000_000
_MADE: dict[tuple[str, float], Lattice] = {}
LOW = U64((1 << 18) - 1)
STEP = U64(0x9E3779B97F4A7C15)
PLACE = U64(0xC2B2AE3D27D4EB4F)


class Lattice:
    def __init__(self, path: str, sharpness: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.byte_id = np.zeros(256, np.int32)
        table: list[bytes] = [b""] * n
        by_length: dict[int, list[tuple[bytes, int, float]]] = {}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[1:-1], 16)] = i
                table[i] = bytes([int(piece[1:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                table[i] = piece.replace(MARK, " ").encode()
                # a merge vocabulary scores pieces by rank; Zipf's law turns ranks into probabilities
                rank = min(max(-model.get_score(i), 0.0), float(n))
                by_length.setdefault(len(table[i]), []).append((table[i], i, -sharpness * float(np.log(rank + 2))))
        self.piece_start = np.concatenate([[0], np.cumsum([len(t) for t in table])]).astype(np.int64)
        self.piece_bytes = np.frombuffer(b"".join(table), np.uint8)
        self.lookup = []
        self.maybe: dict[int, np.ndarray] = {}
        for size, pieces in sorted(by_length.items()):
            raw = np.frombuffer(b"".join(p for p, _, _ in pieces), np.uint8)
            h = hash_spans(raw, np.arange(len(pieces)) * size, np.full(len(pieces), size))
            o = np.argsort(h)
            maybe = np.zeros(1 << 18, bool)  # which low bits any piece of this length has
            maybe[(h & LOW).astype(np.int64)] = True
            self.maybe[size] = maybe
            self.lookup.append((size, h[o], np.array([p[1] for p in pieces], np.int32)[o], np.array([p[2] for p in pieces])[o]))
        self.clear()

    def clear(self) -> None:
        self.end_of: dict[int, int] = {}
        self.nodes = 0
        self.edges = 0
        self.first = np.zeros(0, np.int32)
        self.cum = np.zeros(1 << 20)
        self.piece = np.zeros(1 << 20, np.int32)
        self.back = np.zeros(1 << 20, np.int64)

    def _grow(self, more: int) -> None:
        while self.edges + more > len(self.cum):
            self.cum, self.piece, self.back = (np.concatenate([x, np.zeros_like(x)]) for x in (self.cum, self.piece, self.back))

    def add(self, raw: np.ndarray, starts: np.ndarray, lens: np.ndarray, keys: list[int]) -> None:
        """Forward sums of new segments; an edge keeps the share of its end's paths that use it or an earlier edge."""
        width = lens + 1  # nodes of a segment: before each byte and at its end
        base = np.cumsum(width) - width
        heads = np.cumsum(lens) - lens
        place = np.arange(int(lens.sum())) - np.repeat(heads, lens)
        at = np.repeat(starts, lens) + place
        node = np.repeat(base, lens) + place
        room = np.repeat(lens, lens) - place
        b, e, p, w = [node], [node + 1], [self.byte_id[raw[at]]], [np.full(len(node), BYTE_PENALTY)]
        off = [place + 1]
        tables = {size: rest for size, *rest in self.lookup}
        live, run = np.arange(len(node)), np.zeros(len(node), U64)
        for size in range(1, self.lookup[-1][0] + 1):  # hashes of all spans, one byte longer each turn
            going = room[live] >= size
            live, run = live[going], run[going]
            if not len(live):
                break
            with np.errstate(over="ignore"):
                run = run + BYTE_HASH[raw[at[live] + (size - 1)]] * powers(64)[size - 1]
                h = mix(run + U64(size * int(MULT) & 0xFFFFFFFFFFFFFFFF))
            if size in tables:
                hashes, ids, logp = tables[size]
                some = np.flatnonzero(self.maybe[size][(h & LOW).astype(np.int64)])
                k = np.minimum(np.searchsorted(hashes, h[some]), len(hashes) - 1)
                hit = hashes[k] == h[some]
                f, k = live[some[hit]], k[hit]
                b.append(node[f])
                e.append(node[f] + size)
                p.append(ids[k])
                w.append(logp[k])
                off.append(place[f] + size)
        # longer pieces first: they are the likelier ones, and sampling tries edges in order
        b, e, p, w, off = (np.concatenate(x[::-1]) for x in (b, e, p, w, off))
        o = np.lexsort((e, off))
        b, e, p, w, off = b[o], e[o], p[o], w[o], off[o]
        alpha = np.zeros(int(width.sum()))
        share = np.zeros(len(e))
        cuts = np.flatnonzero(np.diff(off)) + 1
        for i, j in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(e)]]), strict=True):
            x = alpha[b[i:j]] + w[i:j]
            h = np.flatnonzero(np.diff(e[i:j], prepend=-1))
            size = np.diff(np.append(h, j - i))
            top = np.maximum.reduceat(x, h)
            y = np.exp(x - np.repeat(top, size))
            total = np.add.reduceat(y, h)
            alpha[e[i:j][h]] = top + np.log(total)
            run = np.cumsum(y)
            share[i:j] = (run - np.repeat(run[h] - y[h], size)) / np.repeat(total, size)
        o = np.argsort(e, kind="stable")
        b, e, p, share = b[o], e[o], p[o], np.minimum(share[o], 1.0)
        share[np.append(np.flatnonzero(np.diff(e)), len(e) - 1)] = 1.0
        self._grow(len(e))
        span = slice(self.edges, self.edges + len(e))
        self.first = np.concatenate([self.first, self.edges + np.searchsorted(e, np.arange(int(width.sum())))]).astype(np.int32)
        self.cum[span] = share
        self.piece[span] = p
        is_start = np.zeros(int(width.sum()), bool)
        is_start[base] = True
        self.back[span] = np.where(is_start[b], -1, self.nodes + b)
        self.edges += len(e)
        for k, end in zip(keys, (self.nodes + base + lens).tolist(), strict=True):
            self.end_of[k] = end
        self.nodes += int(width.sum())

    def sample(self, col: pa.Array, keys: np.ndarray) -> list[np.ndarray]:
        """Piece ids (uint32) of each text, drawn with its key."""
        raw, off = buffers(col)
        n = len(off) - 1
        if not len(raw):
            return [np.zeros(0, np.uint32)] * n
        space = raw == 0x20
        fresh = np.zeros(len(raw) + 1, bool)
        fresh[off] = True
        fresh = fresh[:-1]
        fresh[1:] |= space[1:] & ~space[:-1]
        starts = np.flatnonzero(fresh)
        lens = np.diff(np.append(starts, len(raw)))
        h, head, inverse = np.unique(hash_spans(raw, starts, lens), return_index=True, return_inverse=True)
        if self.edges > MOST_EDGES:
            self.clear()
        hl = h.tolist()
        missing = [i for i, k in enumerate(hl) if k not in self.end_of]
        if missing:
            s = head[missing]
            self.add(raw, starts[s], lens[s], [hl[i] for i in missing])
        now = np.array([self.end_of[k] for k in hl], np.int64)[inverse]
        soff = np.searchsorted(starts, off)
        doc = np.repeat(np.arange(n), np.diff(soff))
        with np.errstate(over="ignore"):
            seed = keys[doc] + (np.arange(len(starts)) - soff[doc]).astype(U64) * PLACE
        alive = np.arange(len(starts))
        steps = np.zeros(len(starts), np.int64)
        drawn: list[tuple[np.ndarray, np.ndarray]] = []
        turn = 0
        while len(alive):
            with np.errstate(over="ignore"):
                u = (mix(seed[alive] + U64(turn + 1) * STEP) >> U64(11)).astype(np.float64) / float(1 << 53)
            edge = self.first[now].astype(np.int64)
            late = np.flatnonzero(self.cum[edge] <= u)  # the last edge of a node ends at 1
            while len(late):
                edge[late] += 1
                late = late[self.cum[edge[late]] <= u[late]]
            drawn.append((alive, self.piece[edge]))
            steps[alive] += 1
            now = self.back[edge]
            going = now >= 0
            alive, now = alive[going], now[going]
            turn += 1
        ends = np.cumsum(steps)
        out = np.zeros(int(ends[-1]), np.uint32)
        for turn, (who, ids) in enumerate(drawn):
            out[ends[who] - 1 - turn] = ids
        cuts = np.concatenate([[0], ends])[soff]
        return [out[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.piece_start[ids + 1] - self.piece_start[ids]
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.piece_start[ids], size)
        return self.piece_bytes[at].tobytes()


def lattice(path: str, sharpness: float) -> Lattice:
    if (path, sharpness) not in _MADE:
        _MADE[path, sharpness] = Lattice(path, sharpness)
    return _MADE[path, sharpness]


def encode_sampled(docs: DataFrame, model: str, key_col: str = "doc_id", text_col: str = "text", seed: int = 0, sharpness: float = 1.0, out: str = "pieces", keep: list[str] | None = None, verified: str | None = None) -> DataFrame:
    """Append ``out``: the piece ids of one sampled segmentation as little-endian uint32 (binary).

    With ``verified`` also a Boolean column of that name: whether decoding the ids, in the same task,
    gives back the text.

    Sampling is proportional to the product of the pieces' probabilities; a larger ``sharpness`` comes
    nearer to the single best one.  Null and empty texts give no ids; a null key counts as key 0;
    equal keys and texts get equal ids.  All columns (or ``keep``) are carried, one named ``out`` is
    replaced.  An empty table stays empty.
    """
    key = "__key"
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(f"`{key_col}`").cast("string"), F.lit("0")), F.lit(seed)))
    staying = docs.columns if keep is None else keep

    def make():
        own = lattice(model, sharpness)

        def work(texts: pa.Array, keys: pa.Array) -> list[pa.Array]:
            ids = own.sample(texts, keys.to_numpy(zero_copy_only=False).astype(np.int64).view(U64))
            coded = [pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary())]
            if verified:
                coded.append(pa.array([own.decode(i.astype(np.int64)) == (t or "").encode() for i, t in zip(ids, texts.to_pylist(), strict=True)], pa.bool_()))
            return coded

        return work

    fields = [T.StructField(out, T.BinaryType())] + ([T.StructField(verified, T.BooleanType())] if verified else [])
    return add_columns(keyed, fields, [text_col, key], make, staying)


def decode_pieces(docs: DataFrame, model: str, ids_col: str = "pieces", out: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """Append ``out``: the text of the ids in ``ids_col``; the inverse of every encoding.

    Null ids give null, no ids the empty text; repeated rows are read alike and an empty table stays
    empty.  All columns (or ``keep``) are carried, one named ``out`` is replaced.
    """

    def make():
        own = lattice(model, 1.0)

        def work(col: pa.Array) -> list[pa.Array]:
            return [pa.array([None if b is None else own.decode(np.frombuffer(b, "<u4").astype(np.int64)).decode("utf-8") for b in col.to_pylist()], pa.string())]

        return work

    return add_columns(docs, [T.StructField(out, T.StringType())], [ids_col], make, keep)
