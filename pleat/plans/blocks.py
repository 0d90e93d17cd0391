"""Scans and windows over a whole ordered frame without a single-task window.

Rows are cut into blocks of positions.  A prefix fold runs inside blocks and adds what the blocks
before it come to (one row a block); a moving window gets the few rows it needs from the neighbouring
blocks as copies.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import NotYet
from .values import Frame, fresh, q

BLOCK = 1 << 16
#: Bytes of a frame from which totals of blocks are themselves folded in blocks.
VAST = 1 << 38

#: Aggregate, combination and neutral value of the folds that regroup.
FOLDS = {
    "sum": (F.sum, lambda a, b: a + b, 0),
    "product": (F.product, lambda a, b: a * b, 1.0),
    "min": (F.min, lambda a, b: F.least(a, b), None),
    "max": (F.max, lambda a, b: F.greatest(a, b), None),
}


def block_of(f: Frame, size: int) -> Column:
    return F.floor(F.col(q(f.pos)) / size).cast("long")


def earlier_totals(totals: DataFrame, b: str, total: str, fold: str, backward: bool, vast: bool) -> DataFrame:
    """(b, carry): what the blocks before each come to; ``totals`` has one row a block."""
    agg, join, _ = FOLDS[fold]
    order = F.col(b).desc() if backward else F.col(b)
    carry = fresh("carry")
    if not vast:
        return totals.select(b, agg(total).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)).alias(carry))
    g, inner, outer = fresh("g"), fresh("inner"), fresh("outer")
    grouped = totals.withColumn(g, F.floor(F.col(b) / BLOCK).cast("long"))
    sums = earlier_totals(grouped.groupBy(g).agg(agg(total).alias(total)), g, total, fold, backward, False)
    sums = sums.withColumnRenamed(sums.columns[1], outer)
    own = grouped.withColumn(inner, agg(total).over(Window.partitionBy(g).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)))
    both = F.when(F.col(outer).isNull(), F.col(inner)).when(F.col(inner).isNull(), F.col(outer)).otherwise(join(F.col(outer), F.col(inner)))
    return own.join(sums, g).select(b, both.alias(carry))


def is_vast(df: DataFrame) -> bool:
    """Whether Spark expects so many bytes that one row a block is too much for one task."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > VAST


def scan(f: Frame, col: Column, fold: str, backward: bool = False) -> tuple[Frame, str]:
    """``f`` (dense) with a new column: the fold of ``col`` from the first row to each (or from each to the last)."""
    agg, join, _ = FOLDS[fold]
    b, v, out, total = (fresh(x) for x in ("b", "v", "scan", "total"))
    df = f.df.withColumn(b, block_of(f, BLOCK)).withColumn(v, col)
    pos = F.col(q(f.pos))
    inside = Window.partitionBy(b).orderBy(pos.desc() if backward else pos).rowsBetween(Window.unboundedPreceding, 0)
    totals = earlier_totals(df.groupBy(b).agg(agg(v).alias(total)), b, total, fold, backward, is_vast(f.df))
    carry = totals.columns[1]
    local = df.withColumn(out, agg(v).over(inside)).join(totals, b)
    whole = F.when(F.col(carry).isNull(), F.col(out)).otherwise(join(F.col(carry), F.col(out)))
    return Frame(local.withColumn(out, whole).drop(b, v, carry), [], f.pos, f), out


#: Scaled sums may span this power of two.
SPAN = 500


def affine(f: Frame, col: Column, c: float) -> tuple[Frame, str]:
    """A new column acc with acc = col + c * acc of the next row.

    In runs of rows short enough for the powers of c to stay in range, acc is a sum of scaled values,
    scaled back.  What comes into a run from the one behind it follows the same rule with c to the run's
    length: where that power is next to nothing (or beyond all floats), three runs behind reach it; else
    the runs, one row each, are folded alike, in turn.
    """
    out = fresh("acc")
    df = _affine(f.df.withColumn(out, col.cast("double")), f.pos, out, float(c))
    return Frame(df, [], f.pos, f), out


def _affine(df: DataFrame, pos_: str, out: str, c: float, level: int = 0) -> DataFrame:
    """``df`` with column ``out`` replaced by its recurrence from the last position to the first."""
    if c == 0.0:
        return df
    step = abs(math.log2(abs(c)))
    run = max(1, min(BLOCK, int(SPAN / step))) if step else BLOCK
    b, last, carry, twin = fresh("b"), fresh("last"), fresh("carry"), fresh("b")
    pos = F.col(q(pos_))
    left = run - F.pmod(pos, F.lit(run))  # rows to the run's end, this one included
    power = lambda n: F.pow(F.lit(c), n.cast("double"))
    behind = Window.partitionBy(b).orderBy(pos.desc()).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn(b, F.floor(pos / run).cast("long"))
    heads = df.groupBy(b).agg(F.sum(F.col(out) * power(run - left)).alias(last))  # acc of each run's first row, nothing behind it
    df = df.withColumn(out, F.sum(F.col(out) * power(-left)).over(behind) * power(left))
    far = c**run
    if abs(far) < 2.0 ** (-SPAN / 2) or abs(far) > 2.0 ** (SPAN / 2):
        reach = [F.struct((F.col(b) - k).alias(twin), (F.col(last) * far ** (k - 1)).alias(carry)) for k in (1, 2, 3)]
        carries = heads.select(F.explode(F.array(*reach)).alias("x")).select("x.*").groupBy(twin).agg(F.sum(carry).alias(carry))
    else:
        if level > 3:
            raise NotYet("a recurrence whose factor is so near to one")
        whole = _affine(heads.withColumnRenamed(last, carry), b, carry, far, level + 1)
        carries = whole.select((F.col(b) - 1).alias(twin), carry)
    joined = df.join(carries, F.col(b) == F.col(twin), "left")
    return joined.withColumn(out, F.col(out) + power(left) * F.coalesce(F.col(carry), F.lit(0.0))).drop(b, twin, carry)


def spread(f: Frame, before: int, after: int, b: str, home: str) -> DataFrame:
    """Rows with copies from neighbouring blocks: ``b`` is the block that a row stands in, ``home`` its own."""
    size = max(BLOCK, 4 * (before + after + 1))
    pos = F.col(q(f.pos))
    inside = F.pmod(pos, F.lit(size))
    here = F.floor(pos / size).cast("long")
    copies = [here]
    if before:
        copies.append(F.when(inside >= size - before, here + 1))
    if after:
        copies.append(F.when(inside < after, here - 1))
    df = f.df.withColumn(home, here)
    return df.withColumn(b, F.explode(F.filter(F.array(*copies), lambda x: x.isNotNull()))) if len(copies) > 1 else df.withColumn(b, here)
