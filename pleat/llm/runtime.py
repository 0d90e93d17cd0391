"""Plumbing shared by the operators: shared-folder checkpoints and Arrow batches with carried columns."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own only where none is set and driver and executors are one process, as in tests."""
    set_ = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_.isEmpty() and (named := spark.conf.get("spark.checkpoint.dir", None)):
        spark.sparkContext.setCheckpointDir(named)
        set_ = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_.isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pleat-checkpoint-"))
        set_ = spark.sparkContext._jsc.sc().getCheckpointDir()
    return set_.get()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate rows from whatever store it is in."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder, so that later stages survive a lost executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables of a loop in the shared checkpoint folder, read again with their true sizes.

    A checkpoint keeps the size that the optimiser guessed, a join's being the product of its sides';
    carried from round to round these guesses grow to numbers of millions of digits on the driver.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.made = spark, f"{ensure_checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame) -> DataFrame:
        """``df`` written and read again; its folder is that of ``folder``."""
        self.made += 1
        df.write.parquet(self.folder())
        return self.spark.read.schema(df.schema).parquet(self.folder())

    def folder(self) -> str:
        return f"{self.root}/{self.made}"

    def remove(self, *folders: str) -> None:
        for f in folders:
            remove_folder(self.spark, f)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def carried(df: DataFrame, new: Iterable[str], keep: list[str] | None = None) -> list[str]:
    """Input columns that stay: all, or those of ``keep``; a name that the operator itself writes gives way."""
    taken = {c.lower() for c in new}
    return [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]


def add_columns(
    df: DataFrame,
    fields: list[T.StructField],
    inputs: list[str],
    make: Callable[[], Callable[..., list[pa.Array]]],
    keep: list[str] | None = None,
) -> DataFrame:
    """Append ``fields`` computed batch by batch from the columns ``inputs``.

    ``make()`` runs once in each task and returns the function of the batches, so that models and
    caches are built once per task.  Input columns whose names clash with a new one are replaced.
    """
    staying = carried(df, [f.name for f in fields], keep)
    need = list(dict.fromkeys([*staying, *inputs]))
    schema = T.StructType([*(df.schema[c] for c in staying), *fields])
    names = [*staying, *(f.name for f in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        work = make()
        for batch in batches:
            for part in split_batch(batch, inputs):
                new = work(*(part.column(part.schema.get_field_index(c)) for c in inputs))
                old = [part.column(part.schema.get_field_index(c)) for c in staying]
                yield pa.RecordBatch.from_arrays([*old, *new], names=names)

    return df.select(*[f"`{c}`" for c in need]).mapInArrow(run, schema)


def split_batch(batch: pa.RecordBatch, inputs: list[str], most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about a MB of text each (at least one row), to bound a task's memory."""
    n = batch.num_rows
    if n == 0:
        return
    sizes = np.ones(n, dtype=np.int64)
    for c in inputs:
        col = batch.column(batch.schema.get_field_index(c))
        if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
            sizes += pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start = 0
    ends = np.cumsum(sizes)
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def release_memory() -> None:
    """Give memory that earlier tasks of this worker used back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def texts_of(col: pa.Array) -> list[str]:
    """Python strings of a column, null as the empty text."""
    return pc.fill_null(col, "").to_pylist()
