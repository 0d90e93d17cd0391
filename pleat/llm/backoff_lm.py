"""Stupid-backoff language-model scores (Brants et al., 2007) against counts of the whole corpus.

score(w | context) = count(context w) / count(context) if that n-gram is in the table, else 0.4 times
the score with the context's first word dropped; the unigram score is count(w) / words.  The table
holds n-grams counted at least ``floor`` times.  Counts are summed in tables partitioned by hash;
each chunk of texts explodes its n-grams, joins them to the answers of those tables by hash, and
sums logarithms per document.  N-grams travel packed, chunk by chunk (see ``counts``): as rows of
their own they would be shuffled at many times the input's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .counts import answered, counts_of, deal, grain
from .jaccard import _slices
from .runtime import carried, release_memory, split_batch
from .words import U64, ngram_hashes, word_hashes

ORDER = 3
#: n-grams of two words and more count from this many occurrences on.
FLOOR = 2
BACKOFF = 0.4
BITS = 64
#: Bytes of text to a chunk.
CHUNK_BYTES = 14 << 20


def grams(col: pa.ChunkedArray, order: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each n up to ``order`` the hashes of all n-grams with the index of their first word, and the texts' offsets."""
    out: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(order)]
    offsets, base = [np.zeros(1, np.int64)], 0
    for piece, _ in _slices(col):
        h, woff = word_hashes(piece)
        for n in range(1, order + 1):
            g, at = ngram_hashes(h, woff, n)
            out[n - 1].append((g, at + base))
        offsets.append(woff[1:] + base)
        base += len(h)
    join = lambda parts, k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, U64 if k == 0 else np.int64)
    return [(join(p, 0), join(p, 1)) for p in out], np.concatenate(offsets)


def tally(col: pa.ChunkedArray, order: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted distinct hashes, their counts, and the number of words."""
    levels, offsets = grams(col, order)
    return *np.unique(np.concatenate([g for g, _ in levels]), return_counts=True), int(offsets[-1])


def folded(table: pa.Table) -> bytes:
    """A table as compressed bytes."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unfolded(row: pa.Table) -> pa.Table:
    with pa.ipc.open_stream(pa.BufferReader(row.column("rows")[0].as_buffer())) as source:
        return source.read_all()


def chunks_of(df: DataFrame, text: str) -> DataFrame:
    """(chunk, rows): the rows of ``df`` in chunks of about CHUNK_BYTES of text, each folded into one value.

    A chunk holds neighbouring rows of one input partition, so repeated rows do not gather anywhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        base, waiting, size, made = TaskContext.get().partitionId() << 32, [], 0, 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([base + made], pa.int64()), pa.array([folded(pa.Table.from_batches(waiting).combine_chunks())], pa.binary())], names=["chunk", "rows"])

        for batch in batches:
            for part in split_batch(batch, [text]):
                col = part.column(part.schema.get_field_index(text))
                n = pc.sum(pc.binary_length(col)).as_py() or 0
                if waiting and size + n > CHUNK_BYTES:
                    yield row()
                    waiting, size, made = [], 0, made + 1
                waiting.append(part)
                size += n
        if waiting:
            yield row()

    return df.mapInArrow(run, "chunk long, rows binary")


def scores(col: pa.ChunkedArray, known: np.ndarray, count: np.ndarray, words: int, order: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Words and summed log scores of each text; ``count`` stands beside the chunk's sorted hashes ``known``."""
    levels, offsets = grams(col, order)
    total = int(offsets[-1])
    found = []
    for g, at in levels:
        c = np.zeros(total, np.int64)
        c[at] = count[np.searchsorted(known, g)]
        found.append(c)  # found[n - 1][i]: count of the n-gram that starts at word i
    log = np.log(found[0] / max(words, 1), out=np.zeros(total), where=found[0] > 0)
    for n in range(2, order + 1):
        # the n-gram that ends at word i starts at i - n + 1; its context is the (n - 1)-gram there
        full, context = found[n - 1], found[n - 2]
        has = np.zeros(total, bool)
        here = np.zeros(total)
        starts = np.flatnonzero(full >= floor)
        has[starts + n - 1] = True
        here[starts + n - 1] = np.log(full[starts] / context[starts])
        back = np.full(total, np.log(BACKOFF))
        for k in range(n - 1):  # words without a whole context never back off
            firsts = offsets[:-1] + k
            back[firsts[firsts < offsets[1:]]] = 0.0
        log = np.where(has, here, log + back)
    sums = np.concatenate([[0.0], np.cumsum(log)])
    return np.diff(offsets), np.array([log[a:b].sum() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]) if len(sums) else sums


def score_backoff(docs: DataFrame, text_col: str = "text", order: int = ORDER, floor: int = FLOOR, keep: list[str] | None = None) -> DataFrame:
    """Append n_words, log_score (natural log, summed over words) and mean_log_score (null without words).

    Counts cover every row, repeated rows as often as they stand. Words are maximal runs other than
    ASCII white space, A-Z lower-cased; null and empty texts have no words and log_score 0.  All
    columns (or ``keep``) are carried; one named like a new one is replaced. An empty table stays empty.
    ``docs`` is read once; it should be a table, or else written first, so that a lost task reads the same again.
    """
    fields = [T.StructField("n_words", T.LongType()), T.StructField("log_score", T.DoubleType()), T.StructField("mean_log_score", T.DoubleType())]
    staying, text = carried(docs, [f.name for f in fields], keep), "__text"
    chunked = docs.select(*[F.col(f"`{c}`") for c in staying], F.col(f"`{text_col}`").cast("string").alias(text))
    chunked = deal(chunks_of(chunked, text))
    answers = answered(chunked, lambda t: tally(unfolded(t).column(text), order), BITS, grain(docs))
    schema = T.StructType([*(docs.schema[c] for c in staying), *fields])

    def score(row: pa.Table, told: pa.Table) -> pa.Table:
        table = unfolded(row)
        col = table.column(text)
        known, count = tally(col, order)[0], counts_of(told)
        n, log = scores(col, known, count, told.column("weight")[0].as_py(), order, floor)
        mean = pa.array(np.divide(log, n, out=np.zeros(len(n)), where=n > 0), mask=n == 0)
        return pa.Table.from_arrays([*(table.column(c) for c in staying), pa.array(n, pa.int64()), pa.array(log), mean], names=schema.names)

    return chunked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, schema)
