"""Near-duplicate vectors by an exact metric range join.

Within a label, unit vectors go to the cell of their nearest pivot and, as guests, to every cell
whose border lies within the range: the triangle inequality bounds the distance to the other pivot,
the bisector of the two pivots the distance to the border.  Cells join independently, in windows of
distance to the pivot.  A large cell is dealt to pairs of its parts, so a task's memory is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .jaccard import Forest
from .runtime import cut

#: Distinct vectors that a cell should have at home, and most vectors of one part of a cell.
CELL = 4096
#: Most labels that get pivots and most pivots in all; they are broadcast.
LABELS, PIVOTS = 1024, 4096
SLACK = 1e-9


def unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype="<f8").reshape(len(raw), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def valid_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, vec) with vec as little-endian doubles, null if the vector links with nothing."""
    for batch in batches:
        vecs = batch.column(2)
        out: list[bytes | None] = []
        for v, lab, i in zip(vecs, batch.column(1).is_valid().to_pylist(), batch.column(0).is_valid().to_pylist(), strict=True):
            if not lab or not i or not v.is_valid or not len(v.values) or v.values.null_count:
                out.append(None)
                continue
            x = np.asarray(v.values.to_numpy(zero_copy_only=False), dtype="<f8")
            out.append((x + 0.0).tobytes() if np.isfinite(x).all() and x.any() and np.isfinite(np.linalg.norm(x)) and np.linalg.norm(x) > 0 else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["id", "label", "vec"])


def join_cell(q: np.ndarray, c: np.ndarray, pivot_q: np.ndarray, pivot_c: np.ndarray, cosine: float) -> Iterator[tuple[int, np.ndarray]]:
    """(row of q, linked rows of c) by blocks of q sorted by distance to the pivot, against the window of c within range."""
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + SLACK
    qo, co = np.argsort(pivot_q, kind="stable"), np.argsort(pivot_c, kind="stable")
    sorted_c = pivot_c[co]
    for lo in range(0, len(qo), 256):
        rows = qo[lo : lo + 256]
        a = np.searchsorted(sorted_c, pivot_q[rows[0]] - reach)
        b = np.searchsorted(sorted_c, pivot_q[rows[-1]] + reach, side="right")
        if a < b:
            hit = q[rows] @ c[co[a:b]].T >= cosine
            for k in np.flatnonzero(hit.any(axis=1)):
                yield int(rows[k]), co[a:b][hit[k]]


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = 0.98) -> DataFrame:
    """One row per input row: ``id_col``, n_links, component_id, kept.

    Vectors of one label link when their cosine in double precision is at least ``cosine``; exact
    copies collapse first and count as links of each other.  A null label, id or vector, a zero one
    or one with a null or non-finite component links with nothing (component_id is its own id).
    Vectors of another length link only among themselves.  An empty table stays empty; rows that share
    an id are vectors of their own.  Other columns are ignored.

    Pivots are drawn by a hash at a label's own rate, without ranking a label's vectors; at most PIVOTS
    of at most LABELS labels are collected and broadcast.  Fewer pivots only make cells larger.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("v"))
    label_type = rows.schema["label"].dataType.simpleString()
    rows = cut(rows.mapInArrow(valid_vectors, f"id long, label {label_type}, vec binary"))
    classes = cut(
        rows.where("vec is not null")
        .withColumn("cid", F.xxhash64("label", "vec"))
        .groupBy("cid", "label", "vec")
        .agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("m"))
        .withColumn("dim", F.length("vec"))
    )
    spark = vectors.sparkSession
    big = classes.groupBy("label", "dim").count().where(F.col("count") > CELL).orderBy(F.desc("count"), "label", "dim").limit(LABELS)
    # pivots are the classes whose hash falls under their label's rate: one for each CELL vectors of it
    draw = F.pmod(F.xxhash64("cid", F.lit("pivot")), F.lit(1 << 40)).cast("double")
    drawn = classes.join(F.broadcast(big), ["label", "dim"]).where(draw * F.col("count") < (1 << 40) * F.ceil(F.col("count") / CELL).cast("double"))
    pivots: dict[tuple, list[bytes]] = {}
    for p in drawn.orderBy(draw, "cid").limit(PIVOTS).select("label", "dim", "vec").collect():
        pivots.setdefault((p["label"], p["dim"]), []).append(bytes(p["vec"]))
    shared = spark.sparkContext.broadcast({k: unit(v) for k, v in pivots.items()})
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + SLACK

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for (label, dim), g in f.groupby(["label", "dim"], sort=False):
                u = unit(g["vec"].tolist())
                p = shared.value.get((label, dim))
                if p is None:
                    yield g.assign(cell=0, home=True, far=0.0)
                    continue
                square = np.maximum(0.0, 2 - 2 * u @ p.T)
                d = np.sqrt(square)
                home = d.argmin(axis=1)
                own = np.arange(len(u))
                gap = np.sqrt(np.maximum(0.0, 2 - 2 * p @ p.T))[home]
                near = d <= d[own, home][:, None] + 2 * reach
                near &= square - square[own, home][:, None] <= 2 * reach * gap + SLACK
                near[own, home] = True
                r, c = np.nonzero(near)
                yield g.iloc[r].assign(cell=c, home=home[r] == c, far=d[r, c])

    columns = f"cid long, label {label_type}, vec binary, rep long, m long, dim int, cell long, home boolean, far double"
    placed = cut(classes.select("cid", "label", "vec", "rep", "m", "dim").mapInPandas(cells, columns))
    key = ["label", "dim", "cell"]
    parts = placed.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / CELL).alias("parts"))
    dealt = placed.join(parts, key).withColumn("part", F.pmod(F.col("cid"), F.col("parts")))
    every = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    as_query = dealt.where("home").withColumn("j", F.explode(every)).withColumn("i", F.col("part")).withColumn("query", F.lit(True))
    as_other = dealt.withColumn("i", F.explode(every)).withColumn("j", F.col("part")).withColumn("query", F.lit(False))
    task = as_query.unionByName(as_other).select(*key, "i", "j", "query", "cid", "vec", "m", "far")

    def search(f: pd.DataFrame) -> pd.DataFrame:
        q, c = f[f["query"]], f[~f["query"]]
        none = pd.DataFrame({"cid": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64"), "other": pd.Series(dtype="int64")})
        if q.empty or c.empty:
            return none
        qi, ci, m = q["cid"].to_numpy(), c["cid"].to_numpy(), c["m"].to_numpy()
        ids, at = np.unique(np.concatenate([qi, ci]), return_inverse=True)
        forest = Forest(len(ids))
        links = np.zeros(len(qi), np.int64)
        for r, hit in join_cell(unit(q["vec"].tolist()), unit(c["vec"].tolist()), q["far"].to_numpy(), c["far"].to_numpy(), cosine):
            hit = hit[ci[hit] != qi[r]]
            links[r] += m[hit].sum()
            spots = at[len(qi) + hit]
            for s in np.unique(forest.label[spots[forest.label[spots] != forest.label[at[r]]]]):
                forest.union(int(at[r]), int(s))
        root = np.flatnonzero(forest.label != np.arange(len(ids)))
        counts = pd.DataFrame({"cid": qi[links > 0], "links": links[links > 0], "other": qi[links > 0]})
        return pd.concat([none, counts, pd.DataFrame({"cid": ids[root], "links": 0, "other": ids[forest.label[root]]})])

    found = cut(task.groupBy(*key, "i", "j").applyInPandas(search, "cid long, links long, other long"))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    comps = connected_components(found.select(F.col("cid").alias("u"), F.col("other").alias("v"))).withColumnRenamed("node", "cid")
    named = classes.select("cid", "rep", "m").join(comps, "cid", "left").withColumn("c", F.coalesce("component", "cid"))
    lowest = named.groupBy("c").agg(F.min("rep").alias("lowest"))
    final = named.join(lowest, "c").join(links, "cid", "left").select("cid", "lowest", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n"))
    out = rows.withColumn("cid", F.when(F.col("vec").isNotNull(), F.xxhash64("label", "vec"))).join(final, "cid", "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("lowest", "id").alias("component_id"))
    return out.withColumn("kept", F.col(id_col) == F.col("component_id"))
