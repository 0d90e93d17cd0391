"""Vector bin packing of tokenised examples by the dot-product heuristic (Panigrahy et al., 2011).

A sequence has three limits at once: tokens, segments and loss-bearing tokens.  An open sequence
takes the example with the largest demand-weighted dot product of its sizes with what is left; a
gap that no example fits is filled by cutting one.  Packing is local to a task: full-length pieces
leave at once, remainders wait in a pool of bounded size, and the last sequence of a task is split
at powers of two, so it has no padding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import piece_cache
from .runtime import carried, release_memory, split_batch, texts_of

#: Examples that wait in a task before the pool is packed.
POOL = 1024


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 128
    loss: int = 2048


def loss_tokens(start: int, length: int, masked: int = 1) -> int:
    """Loss-bearing ids of a piece of a document whose first ``masked`` ids bear none."""
    return max(0, start + length - max(start, masked))


class Packer:
    """Packs pieces (key, start, length, masked) into closed sequences; ``close`` is told each placement."""

    def __init__(self, limits: Limits, close, pool: int = POOL):
        self.limits, self.close, self.pool = limits, close, pool
        self.waiting: list[tuple[int, int, int, int]] = []
        self.sequences = 0

    def add(self, key: int, total: int, masked: int = 1) -> None:
        """An example of ``total`` tokens, the first ``masked`` of them without loss: full sequences leave, the rest waits."""
        start = 0
        while start < total:
            most = min(self.limits.tokens, max(0, masked - start) + self.limits.loss)
            if total - start < most:
                self.waiting.append((key, start, total - start, masked))
                break
            self._finished([(key, start, most, masked)], most)
            start += most
        if len(self.waiting) >= self.pool:
            self.waiting = self._pack(self.waiting)

    def finish(self) -> None:
        """Pack what waits; the last sequence is split at powers of two."""
        rest = self._pack(self.waiting)
        self.waiting = []
        self._split(rest)

    def _finished(self, pieces: list[tuple[int, int, int, int]], size: int) -> None:
        """Close a sequence that nothing more goes into."""
        if size == self.limits.tokens:
            self._close(pieces)
        else:
            self._split(pieces)

    def _split(self, rest: list[tuple[int, int, int, int]]) -> None:
        """Close pieces as sequences whose lengths are powers of two, which need no padding."""
        rest = list(rest)
        left = sum(x[2] for x in rest)
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            part = []
            while room:
                key, start, n, masked = rest.pop(0)
                take = min(n, room)
                part.append((key, start, take, masked))
                room -= take
                if take < n:
                    rest.insert(0, (key, start + take, n - take, masked))
            self._close(part)

    def _close(self, pieces: list[tuple[int, int, int, int]]) -> None:
        at = 0
        for key, start, n, _ in pieces:
            self.close(key, start, n, self.sequences, at)
            at += n
        self.sequences += 1

    def _pack(self, items: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Close full sequences; return the pieces of the last, unfilled one."""
        if not items:
            return []
        cap = np.array([self.limits.tokens, self.limits.segments, self.limits.loss], dtype=float)
        sizes = np.array([(n, 1, loss_tokens(s, n, m)) for _, s, n, m in items], dtype=float)
        weight = sizes.sum(axis=0) / cap / cap**2
        items = list(items)
        alive = np.ones(len(items), bool)
        n_alive = len(items)
        while n_alive:
            left, bin_ = cap.copy(), []
            while n_alive and left[0] > 0:
                fit = alive & (sizes[:, 0] <= left[0]) & (sizes[:, 2] <= left[2]) & (left[1] >= 1)
                score = np.where(fit, sizes @ (weight * left), -1.0)
                best = int(np.argmax(score))
                if score[best] >= 0 and not (left[1] == 1 and sizes[best, 0] < left[0]):
                    bin_.append(items[best])
                    left -= sizes[best]
                    alive[best] = False
                    n_alive -= 1
                    continue
                longest = int(np.argmax(np.where(alive, sizes[:, 0], -1.0)))
                key, start, n, masked = items[longest]
                take = int(min(left[0], max(0, masked - start) + left[2], n))
                if left[1] < 1 or take < 1:
                    break
                bin_.append((key, start, take, masked))
                left -= (take, 1, loss_tokens(start, take, masked))
                if take == n:
                    alive[longest] = False
                    n_alive -= 1
                else:
                    items[longest] = (key, start + take, n - take, masked)
                    sizes[longest] = (n - take, 1, loss_tokens(start + take, n - take, masked))
            if not n_alive and left[0] > 0:
                return bin_
            self._finished(bin_, int(cap[0] - left[0]))
        return []


PIECE = [
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids", T.BinaryType()),
    T.StructField("loss_tokens", T.LongType()),
    T.StructField("doc_tokens", T.LongType()),
    T.StructField("sequence_id", T.LongType()),
    T.StructField("offset", T.LongType()),
]


def pack_documents(docs: DataFrame, vocabulary: str, text_col: str = "text", limits: Limits = Limits(), end_id: int = 1, keep: list[str] | None = None, masked_col: str | None = None) -> DataFrame:
    """One row per piece: kept columns, start, length, ids (little-endian uint32), loss_tokens, doc_tokens, sequence_id, offset.

    A document is its ids under ``vocabulary`` (a ``tokenizers`` JSON file) and ``end_id``; a null text
    counts as empty and so is one id.  ``masked_col`` holds how many ids at a document's start bear no
    loss, such as an instruction's prompt; without it, or where it is null, only the first id bears none,
    as nothing predicts it.  Every row is packed, repeated rows too; null keys are carried.
    A sequence shorter than the limit is a power of two long, so nothing is padded.  Input
    columns named like a new one are replaced.  An empty table gives no rows.  Sequence ids start
    with the task's number, so no two tasks share one.
    """
    staying = [c for c in carried(docs, [f.name for f in PIECE], keep) if c != text_col]
    schema = T.StructType([*(docs.schema[c] for c in staying), *PIECE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        cache = piece_cache(vocabulary)
        base = TaskContext.get().partitionId() << 40
        held: dict[int, tuple[np.ndarray, pa.RecordBatch, int]] = {}
        left: dict[int, int] = {}
        free: dict[int, int] = {}
        out: list[tuple[pa.RecordBatch, int, int, bytes, int, int, int, int]] = []

        def close(key: int, start: int, n: int, seq: int, at: int) -> None:
            ids, rows, row = held[key]
            out.append((rows, row, start, ids[start : start + n].tobytes(), len(ids), base + seq, at, loss_tokens(start, n, free[key])))
            left[key] -= n
            if not left[key]:
                del held[key], left[key], free[key]

        def batch_of() -> pa.RecordBatch:
            cols = []
            if staying:
                groups: list[pa.RecordBatch] = []
                i = 0
                while i < len(out):  # runs of pieces from the same input slice
                    j = i
                    while j < len(out) and out[j][0] is out[i][0]:
                        j += 1
                    groups.append(out[i][0].take(pa.array([o[1] for o in out[i:j]])))
                    i = j
                cols = list(pa.Table.from_batches(groups).combine_chunks().to_batches()[0].columns)
            new = [pa.array([o[k] for o in out], t) for k, t in ((2, pa.int64()), (3, pa.binary()), (7, pa.int64()), (4, pa.int64()), (5, pa.int64()), (6, pa.int64()))]
            size = pa.array([len(o[3]) // 4 for o in out], pa.int64())
            out.clear()
            return pa.RecordBatch.from_arrays([*cols, new[0], size, *new[1:]], names=schema.names)

        packer = Packer(limits, close)
        key = 0
        for batch in batches:
            for part in split_batch(batch, [text_col]):
                rows = part.select(staying) if staying else part
                masks = part.column(part.schema.get_field_index(masked_col)).to_pylist() if masked_col else [None] * part.num_rows
                for row, ids in enumerate(cache.encode(texts_of(part.column(part.schema.get_field_index(text_col))))):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    held[key], left[key] = (ids, rows, row), len(ids)
                    free[key] = 1 if masks[row] is None else max(0, int(masks[row]))
                    packer.add(key, len(ids), free[key])
                    key += 1
                if len(out) > 2000:
                    yield batch_of()
        packer.finish()
        if out:
            yield batch_of()

    return docs.select(*[f"`{c}`" for c in dict.fromkeys([*staying, text_col, *([masked_col] if masked_col else [])])]).mapInArrow(run, schema)
