"""Quality classifier: a factorisation machine over hashed words and structure statistics (Rendle, 2010).

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): the
sum-of-squares identity makes all pairwise interactions linear in the features of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import add_columns, split_batch
from .words import U64, buffers, hash_spans, ngram_hashes, word_bounds

WORD_BITS = 16
WORDS = 1 << WORD_BITS
#: Upper bin edges of each statistic: shares of 0 to 1 and, for lengths, natural logarithms.
SHARE = [0.0, 0.005, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]
LOGS = [0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0]
STATS: dict[str, list[float]] = {
    "symbols": SHARE, "exclamations": SHARE, "bars": SHARE, "capitals": SHARE, "digits": SHARE, "stops": SHARE, "commas": SHARE, "spaces": SHARE,
    "new_words": SHARE, "echoes": SHARE, "new_fourgrams": SHARE, "repeated_lines": SHARE, "length": LOGS, "lines": LOGS, "word_length": LOGS,
}
BINS = 16
FEATURES = WORDS + BINS * len(STATS)
FACTORS = 8
#: Most labelled rows that the model is fitted on (those with the smallest hash of their id).
SAMPLE = 4000
THRESHOLD = 0.3
EPOCHS = 10


@dataclass
class Model:
    bias: float
    weights: np.ndarray
    factors: np.ndarray


def _count(raw: np.ndarray, off: np.ndarray, chars: str) -> np.ndarray:
    hit = np.zeros(256, np.int64)
    hit[[ord(c) for c in chars]] = 1
    total = np.concatenate([[0], np.cumsum(hit[raw])])
    return total[off[1:]] - total[off[:-1]]


def features(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (indices, values, offsets) of a batch of texts; a null text counts as empty."""
    raw, off = buffers(col)
    starts, lens, woff = word_bounds(raw, off)
    h = hash_spans(raw, starts, lens)
    n = len(off) - 1
    chars = np.maximum(off[1:] - off[:-1], 1)
    words = np.diff(woff)
    some = np.maximum(words, 1)
    four, at = ngram_hashes(h, woff, 4)
    foff = np.searchsorted(at, woff)
    echo = np.zeros(len(h) + 1, np.int64)
    if len(h) > 1:
        echo[2:] = np.cumsum(h[1:] == h[:-1])
    letters = np.concatenate([[0], np.cumsum(lens)])
    breaks = np.flatnonzero(raw == 10)
    lstart = np.unique(np.concatenate([off[:-1], breaks + 1]))
    lend = np.append(lstart[1:], len(raw))
    lhash = hash_spans(raw, lstart[lend > lstart], (lend - lstart)[lend > lstart])
    loff = np.searchsorted(lstart[lend > lstart], off)
    new_lines = np.zeros(n)
    new_words, new_four = np.zeros(n), np.ones(n)
    idx, val = [], []
    buckets = (h >> U64(64 - WORD_BITS)).astype(np.int64)
    for r in range(n):
        a, b = woff[r], woff[r + 1]
        u, c = np.unique(buckets[a:b], return_counts=True)
        new_words[r] = len(u) / max(b - a, 1)
        if foff[r + 1] > foff[r]:
            new_four[r] = len(np.unique(four[foff[r] : foff[r + 1]])) / (foff[r + 1] - foff[r])
        if loff[r + 1] > loff[r]:
            new_lines[r] = 1 - len(np.unique(lhash[loff[r] : loff[r + 1]])) / (loff[r + 1] - loff[r])
        v = np.sqrt(c)
        idx.append(u)
        val.append(v / max(np.sqrt(c.sum()), 1.0))
    stats = {
        "symbols": _count(raw, off, "#*$%&|<>") / some, "exclamations": _count(raw, off, "!") / some, "bars": _count(raw, off, "|") / some,
        "capitals": _count(raw, off, "ABCDEFGHIJKLMNOPQRSTUVWXYZ") / chars, "digits": _count(raw, off, "0123456789") / chars,
        "stops": _count(raw, off, ".") / some, "commas": _count(raw, off, ",") / some, "spaces": _count(raw, off, " \t\n") / chars,
        "new_words": new_words, "echoes": (echo[woff[1:]] - echo[np.minimum(woff[:-1] + 1, woff[1:])]) / some, "new_fourgrams": new_four, "repeated_lines": new_lines,
        "length": np.log1p(words), "lines": np.log1p(_count(raw, off, "\n")), "word_length": (letters[woff[1:]] - letters[woff[:-1]]) / some,
    }
    dense = np.stack([WORDS + BINS * k + np.searchsorted(STATS[name], stats[name] - 1e-9) for k, name in enumerate(STATS)], axis=1)
    one = np.full(dense.shape[1], 1.0)
    for r in range(n):
        idx[r] = np.concatenate([idx[r], dense[r]])
        val[r] = np.concatenate([val[r] * 0.3, one])
    bounds = np.concatenate([[0], np.cumsum([len(i) for i in idx])]).astype(np.int64)
    return np.concatenate(idx) if idx else np.zeros(0, np.int64), np.concatenate(val).astype(np.float32) if val else np.zeros(0, np.float32), bounds


def margins(model: Model, idx: np.ndarray, val: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Margin of each row and its factor sums, by the sum-of-squares identity."""
    if len(bounds) < 2:
        return np.zeros(0), np.zeros((0, FACTORS))
    vx = model.factors[idx] * val[:, None]
    sums = np.add.reduceat(vx, bounds[:-1], axis=0)
    squares = np.add.reduceat((vx * vx).sum(axis=1), bounds[:-1])
    linear = np.add.reduceat(model.weights[idx] * val, bounds[:-1])
    return model.bias + linear + 0.5 * ((sums * sums).sum(axis=1) - squares), sums


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> Model:
    """Log loss by AdaGrad in small batches. Without rows of both labels, the smoothed share of label 1."""
    rng = np.random.default_rng(seed)
    model = Model(0.0, np.zeros(FEATURES, np.float32), rng.normal(0, 0.05, (FEATURES, FACTORS)).astype(np.float32))
    share = (labels.sum() + 1) / (len(labels) + 2)
    model.bias = float(np.log(share / (1 - share)))
    if not 0 < labels.sum() < len(labels):
        model.factors[:] = 0
        return model
    gw, gv = np.full(FEATURES, 0.1, np.float32), np.full((FEATURES, FACTORS), 0.1, np.float32)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), 32):
            pick = order[lo : lo + 32]
            idx = np.concatenate([rows[i][0] for i in pick])
            val = np.concatenate([rows[i][1] for i in pick])
            size = np.array([len(rows[i][0]) for i in pick])
            bounds = np.concatenate([[0], np.cumsum(size)])
            m, sums = margins(model, idx, val, bounds)
            g = np.repeat(((sigmoid(m) - labels[pick]) / len(pick)).astype(np.float32), size)
            s = np.repeat(sums, size, axis=0)
            u, inv = np.unique(idx, return_inverse=True)
            dw = np.bincount(inv, g * val, len(u)).astype(np.float32) + 1e-5 * model.weights[u]
            part = (g * val)[:, None] * (s - model.factors[idx] * val[:, None])
            dv = np.stack([np.bincount(inv, part[:, f], len(u)) for f in range(FACTORS)], axis=1).astype(np.float32) + 1e-5 * model.factors[u]
            gw[u] += dw * dw
            gv[u] += dv * dv
            model.weights[u] -= 0.3 * dw / np.sqrt(gw[u])
            model.factors[u] -= 0.05 * dv / np.sqrt(gv[u])
            model.bias -= 0.05 * float(g.sum() / max(1, len(g)) * len(pick))
    return model


def held_out(id_col: str):
    """The rows that a fit never sees: crc32 of the id as text leaves 0 on division by 5. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int) -> DataFrame:
    """At most ``sample`` rows (id, y, text) outside the held-out fifth, one for each id.

    Null labels and ids are left out; of repeated labels the lowest counts, of several texts of one id
    the one with the smallest hash (a null text counts as empty), chosen before anything leaves the
    executors.  Which ids are taken depends on their hashes alone: a top-k, however large the tables.
    """
    own = labels.select(F.col(id_col).cast("long").alias("id"), F.col("quality").alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull())
    own = own.where(~held_out("id")).groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(own), "id")
    return texts.groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("t")).select("id", "y", "t.text")


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Fit on ``labelled_rows``; their features, at most ``sample`` rows, come to the driver.

    Without rows of both labels (empty tables too) every score is the smoothed share of label 1.
    Input columns named otherwise than the ones given are never read.
    """
    texts = labelled_rows(docs, labels, id_col, text_col, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in split_batch(batch, ["text"]):
                idx, val, b = features(part.column(2))
                rows = [(idx[i:j].astype("<i4").tobytes(), val[i:j].astype("<f4").tobytes()) for i, j in zip(b[:-1], b[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.int32()), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["id", "y", "i", "v"])

    got = sorted(texts.mapInArrow(run, "id long, y int, i binary, v binary").collect(), key=lambda r: r["id"])
    rows = [(np.frombuffer(r["i"], "<i4").astype(np.int64), np.frombuffer(r["v"], "<f4")) for r in got]
    return fit(rows, np.array([float(r["y"]) for r in got], dtype=np.float64))


def score_quality(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append score (0 to 1) and predicted (1 if score >= THRESHOLD) of each whole text.

    Null and empty texts get the score of their statistics. Repeated rows get the same score; an empty
    table stays empty. All columns (or ``keep``) are carried; one named like a new one is replaced.
    Ids, labels, lang and source are never read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def make():
        own = shared.value

        def work(col: pa.Array) -> list[pa.Array]:
            score = sigmoid(margins(own, *features(col))[0])
            return [pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32), pa.int32())]

        return work

    return add_columns(docs, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], [text_col], make, keep)
