"""Corpus-wide counts of hashed n-grams: count tables partitioned by hash, met by packed lists.

Texts are dealt to chunks.  A chunk sends each hash bucket its sorted distinct hashes, delta-coded
and compressed to a few bytes each, with counts; a bucket sums them over all chunks and answers every
chunk in the chunk's own order.  Buckets split the hash range in order, so a chunk's answers laid end
to end stand beside its sorted hashes.  No n-gram is ever a row, and no task holds more than a chunk
or a bucket; both are bounded in bytes, whatever spark.sql.shuffle.partitions says.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .runtime import shuffle_partitions
from .words import U64

#: Bytes of input to a chunk or a bucket.
GRAIN_BYTES = 16 << 20
MOST_GRAIN = 64


def pack(x: np.ndarray, width: int) -> bytes:
    """Byte planes of the differences of a sorted array, compressed."""
    if not len(x):
        return b""
    d = np.diff(x, prepend=U64(0)).astype("<u8")
    planes = np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(b: bytes, n: int, width: int) -> np.ndarray:
    if not n:
        return np.zeros(0, U64)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(width, n)
    d = np.zeros((n, 8), np.uint8)
    d[:, :width] = planes.T
    return np.cumsum(d.view("<u8").ravel(), dtype=U64)


def pack_counts(c: np.ndarray) -> bytes:
    """Byte planes of uint32 counts, compressed."""
    if not len(c):
        return b""
    planes = np.ascontiguousarray(c.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_counts(b: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint32)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def grain(df: DataFrame) -> int:
    """Into how many parts ``df`` is dealt: one for each GRAIN_BYTES that Spark expects it to have, at least
    one for each shuffle partition, and not beyond MOST_GRAIN of these where an estimate is far too high."""
    p = shuffle_partitions(df.sparkSession)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(p, min(size // GRAIN_BYTES, MOST_GRAIN * p))


def deal(df: DataFrame, key: str = "chunk") -> DataFrame:
    return df.repartition(shuffle_partitions(df.sparkSession), key)


def answered(chunked: DataFrame, hashes: Callable[[pa.Table], tuple[np.ndarray, np.ndarray, int]], bits: int, buckets: int) -> DataFrame:
    """(chunk, bucket, n, counts, weight): for every chunk its hashes' corpus counts, bucket by bucket, and the sum of all chunks' weights.

    ``chunked`` has a long column ``chunk`` and is dealt by it; ``hashes`` maps a chunk's table to its
    sorted distinct hashes below 2 ** bits, their counts, and a weight.  All columns of ``chunked`` are
    read, so that a cogroup of it with the answers shares its exchange.
    """
    edges = np.array([(b << bits) // buckets for b in range(1, buckets)], dtype=U64)
    lows = np.concatenate([np.zeros(1, U64), edges])
    width = (bits + 7) // 8

    def send(table: pa.Table) -> pa.Table:
        x, c, weight = hashes(table)
        cuts = np.concatenate([[0], np.searchsorted(x, edges), [len(x)]])
        return pa.table(  # every bucket hears of every chunk, so that each knows all weights
            {
                "chunk": pa.array([table.column("chunk")[0].as_py()] * buckets, pa.int64()),
                "bucket": pa.array(range(buckets), pa.int32()),
                "n": pa.array(np.diff(cuts), pa.int64()),
                "hashes": pa.array([pack(x[i:j] - low, width) for i, j, low in zip(cuts, cuts[1:], lows, strict=False)], pa.binary()),
                "counts": pa.array([pack_counts(c[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)], pa.binary()),
                "weight": pa.array([weight] * buckets, pa.int64()),
            }
        )

    def total(table: pa.Table) -> pa.Table:
        ns = table.column("n").to_pylist()
        lists = [unpack(b, n, width) for b, n in zip(table.column("hashes").to_pylist(), ns, strict=True)]
        counts = [unpack_counts(b, n) for b, n in zip(table.column("counts").to_pylist(), ns, strict=True)]
        _, at = np.unique(np.concatenate(lists), return_inverse=True)
        sums = np.bincount(at, np.concatenate(counts)).astype(np.int64)
        of = np.minimum(sums[at], 0xFFFFFFFF)
        ends = np.cumsum(ns)
        return pa.table(
            {
                "chunk": table.column("chunk"),
                "bucket": table.column("bucket"),
                "n": table.column("n"),
                "counts": pa.array([pack_counts(of[e - n : e]) for e, n in zip(ends, ns, strict=True)], pa.binary()),
                "weight": pa.array([sum(table.column("weight").to_pylist())] * len(ns), pa.int64()),
            }
        )

    sent = chunked.groupBy("chunk").applyInArrow(send, "chunk long, bucket int, n long, hashes binary, counts binary, weight long")
    return sent.groupBy("bucket").applyInArrow(total, "chunk long, bucket int, n long, counts binary, weight long")


def counts_of(answers: pa.Table) -> np.ndarray:
    """A chunk's corpus counts beside its sorted hashes."""
    rows = sorted(zip(answers.column("bucket").to_pylist(), answers.column("n").to_pylist(), answers.column("counts").to_pylist(), strict=True))
    return np.concatenate([unpack_counts(b, n) for _, n, b in rows]) if rows else np.zeros(0, np.uint32)
