"""Verbs of single items that Spark has no function for: the local evaluator over whole Arrow batches.

Complex items are structs of two doubles, ``re`` and ``im``; a verb whose result on every item is a
list of two numbers gives a matrix of two columns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import LanguageError, NotYet
from ..operators.verb import Verb

COMPLEX = "struct<re:double,im:double>"
TYPES = {"b": "boolean", "i": "bigint", "f": "double", "c": COMPLEX, "U": "string"}
SAMPLES = {"string": np.array(["a"], dtype="<U1"), "boolean": np.array([True, False]), "bigint": np.array([1, 2, 3], np.int64), "double": np.array([1.5, 2.25]), COMPLEX: np.array([1.5 + 1j, 2.0 - 0.5j])}


def is_complex(t: str) -> bool:
    return t.replace(" ", "") == COMPLEX


def to_array(c) -> np.ndarray:
    if isinstance(c, pd.DataFrame):
        return c["re"].to_numpy() + 1j * c["im"].to_numpy()
    return c.to_numpy()


def from_array(a: np.ndarray):
    if a.dtype.kind == "c":
        return pd.DataFrame({"re": a.real, "im": a.imag})
    return pd.Series(a)


def by_item(v: Verb, cols: list[Column], types: list[str], fixed: dict[int, np.ndarray] | None = None) -> tuple[Column, str, int]:
    """(column, type of an item, length of each result or 0 for atoms) of a verb of rank 0 on columns; ``fixed`` are local arguments by place."""
    fixed = fixed or {}
    arity = len(cols) + len(fixed)

    def call(arrays: list[np.ndarray]) -> np.ndarray:
        own = iter(arrays)
        args = [fixed[k] if k in fixed else next(own) for k in range(arity)]
        return np.asarray(v.monad(args[0]) if arity == 1 else v.dyad(*args))

    try:
        out = call([SAMPLES[t.replace(" ", "")][:2] for t in types])
    except (LanguageError, KeyError) as e:
        raise NotYet(f"{v} of distributed items ({e})") from None
    if out.dtype.kind not in TYPES or out.ndim > 2:
        raise NotYet(f"{v} of distributed items: exact numbers and boxes are no columns")
    t, width = TYPES[out.dtype.kind], out.shape[1] if out.ndim == 2 else 0
    ragged = v.name == "q:"  # factors: as many as a number has

    def run(*series: pd.Series) -> pd.Series:
        got = call([to_array(s) for s in series])
        if got.ndim == 2:
            lists = [[x for x in row if x] if ragged else row for row in got.tolist()]
            return pd.Series(lists)
        kind = {"boolean": np.bool_, "bigint": np.int64, "double": np.float64, COMPLEX: np.complex128}.get(t)
        return from_array(got.astype(kind) if kind else got)

    if t == COMPLEX and not width:
        run.__annotations__["return"] = pd.DataFrame
    return F.pandas_udf(run, f"array<{t}>" if width else t)(*cols), t, -1 if ragged else width


def by_value(f, result: str, col: Column) -> Column:
    """A Python function of one value, batch by batch."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(f)

    return F.pandas_udf(run, result)(col)
