"""Local arrays: numpy arrays of booleans, integers, floats, complex numbers, characters, exact numbers, symbols or boxes."""

from __future__ import annotations

from collections.abc import Iterable
from fractions import Fraction

import numpy as np

from .errors import DomainError, LengthError


class Box:
    """One element that holds a whole array."""

    __slots__ = ("v",)

    def __init__(self, v: np.ndarray):
        self.v = v


class Sym(str):
    """A symbol: an interned text, ordered by its text."""

    __slots__ = ()


class Sparse(np.ndarray):
    """An array whose entries that are not its fill are listed when shown; results of arithmetic on one are sparse too."""

    fill = 0

    def __array_finalize__(self, other):
        self.fill = getattr(other, "fill", 0)


EMPTY = np.zeros(0, np.int64)
INF = float("inf")


def obj(items: Iterable, shape: tuple[int, ...] | None = None) -> np.ndarray:
    items = list(items)
    out = np.empty(len(items), object)
    for i, v in enumerate(items):
        out[i] = v
    return out if shape is None else out.reshape(shape)


def atom(v) -> np.ndarray:
    """A rank-0 array of one Python value."""
    if isinstance(v, (Box, Sym, Fraction)) or (isinstance(v, int) and not isinstance(v, bool) and abs(v) >= 1 << 63):
        out = np.empty((), object)
        out[()] = v
        return out
    return np.asarray(v)


def chars(s: str) -> np.ndarray:
    return np.array(list(s), dtype="<U1") if s else np.zeros(0, "<U1")


def kind(a: np.ndarray) -> str:
    """num, exact, char, sym or box."""
    k = a.dtype.kind
    if k == "U":
        return "char"
    if k != "O":
        return "num"
    if not a.size:
        return "box"
    first = a.flat[0]
    return "box" if isinstance(first, Box) else "sym" if isinstance(first, Sym) else "exact"


def is_number(a: np.ndarray) -> bool:
    return kind(a) in ("num", "exact")


def fill_of(a: np.ndarray):
    k = kind(a)
    return {"char": " ", "box": Box(EMPTY), "sym": Sym(""), "exact": 0}.get(k, 0)


def empty_like(a: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    out = np.empty(shape, a.dtype)
    if a.dtype.kind == "O":
        for i in range(out.size):
            out.flat[i] = fill_of(a)
    else:
        out[...] = fill_of(a)
    return out


def exact_cast(a: np.ndarray) -> np.ndarray:
    return a if a.dtype.kind == "O" else obj((int(v) for v in a.ravel()), a.shape)


def common(arrays: list[np.ndarray]) -> list[np.ndarray]:
    """The arrays in one element type. Empty arrays take any."""
    kinds = {kind(a) for a in arrays if a.size} or {kind(a) for a in arrays}
    if len(kinds) == 1 and "num" in kinds:
        t = np.result_type(*[a.dtype for a in arrays if a.size or a.dtype.kind not in "UO"] or [np.int64])
        return [a.astype(t) if a.dtype.kind not in "UO" else np.zeros(a.shape, t) for a in arrays]
    if kinds == {"num", "exact"} or kinds == {"exact"}:
        if any(a.dtype.kind in "fc" for a in arrays if a.size):
            return [to_float(a) for a in arrays]
        return [exact_cast(a) if is_number(a) else np.empty(a.shape, object) for a in arrays]
    if len(kinds) > 1:
        raise DomainError(f"arrays of {' and '.join(sorted(kinds))} do not join")
    t = next(a.dtype for a in arrays if a.size or kind(a) in kinds)
    return [a if a.dtype.kind == t.kind else np.empty(a.shape, t) for a in arrays]


def to_float(a: np.ndarray) -> np.ndarray:
    if a.dtype.kind == "O":
        return np.array([float(v) for v in a.ravel()], float).reshape(a.shape)
    return a if a.dtype.kind in "fc" else a.astype(float)


def pad(a: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    if a.shape == shape:
        return a
    out = empty_like(a, shape)
    out[tuple(slice(0, n) for n in a.shape)] = a
    return out


def frame_up(cells: list[np.ndarray], frame: tuple[int, ...]) -> np.ndarray:
    """Cells as one array of shape frame + cell, ranks raised by leading ones, short cells filled."""
    if not cells:
        return np.zeros(frame, np.int64)
    rank = max(c.ndim for c in cells)
    cells = [c.reshape((1,) * (rank - c.ndim) + c.shape) for c in cells]
    shape = tuple(max(d) for d in zip(*[c.shape for c in cells], strict=True)) if rank else ()
    cells = [pad(c, shape) for c in common(cells)]
    out = np.empty((len(cells), *shape), cells[0].dtype)
    for i, c in enumerate(cells):
        out[i] = c if shape else c[()]
    return out.reshape(frame + shape)


def items(a: np.ndarray) -> list[np.ndarray]:
    return [np.asarray(a)] if a.ndim == 0 else [item(a, i) for i in range(len(a))]


def item(a: np.ndarray, i: int) -> np.ndarray:
    v = a[i]
    if isinstance(v, np.ndarray):
        return v
    out = np.empty((), a.dtype)
    out[()] = v
    return out


def ints(a: np.ndarray, what: str = "a whole number") -> np.ndarray:
    """Integers of an argument that counts or indexes; near-integers are refused."""
    if kind(a) == "exact" and all(isinstance(v, int) or v.denominator == 1 for v in a.ravel()):
        return np.array([int(v) for v in a.ravel()], np.int64).reshape(a.shape)
    if a.dtype.kind in "bi":
        return a.astype(np.int64)
    if a.dtype.kind == "f" and np.all(a == np.floor(a)) and np.all(np.abs(a) < 2**63):
        return a.astype(np.int64)
    if not a.size:
        return np.zeros(a.shape, np.int64)
    raise DomainError(f"{what} is wanted")


def one_int(a: np.ndarray, what: str = "a whole number") -> int:
    v = ints(a, what).ravel()
    if len(v) != 1:
        raise LengthError(f"{what} is wanted")
    return int(v[0])


def from_python(v) -> np.ndarray:
    """Python scalars, strings, Fractions, nested lists (ragged ones become boxes), numpy and Arrow arrays."""
    if isinstance(v, np.ndarray):
        if v.dtype.kind in "iu" and v.dtype != np.int64:
            if v.dtype == np.uint64 and v.size and v.max() >= 1 << 63:
                raise DomainError("an unsigned number above 2^63 - 1 has no integer here")
            return v.astype(np.int64)
        if v.dtype.kind == "f" and v.dtype.itemsize == 2:
            raise DomainError("half-precision columns are not read")
        return v.astype(float) if v.dtype == np.float32 else v
    if isinstance(v, str):
        return np.array(v, "<U1") if len(v) == 1 else chars(v)
    if isinstance(v, (list, tuple)):
        parts = [from_python(x) for x in v]
        if not parts:
            return EMPTY
        if len({p.shape for p in parts}) == 1 and len({("num" if is_number(p) else kind(p)) for p in parts}) == 1:
            return frame_up(parts, (len(parts),))
        return obj(Box(p) for p in parts)
    if hasattr(v, "__arrow_c_array__") or hasattr(v, "__arrow_c_stream__"):
        import pyarrow as pa

        t = pa.table(v) if hasattr(v, "__arrow_c_stream__") else None
        return from_arrow(t) if t is not None else from_arrow(pa.table({"v": pa.array(v)}))
    if isinstance(v, complex) or isinstance(v, (bool, int, float, Fraction, Box, Sym, np.generic)):
        return atom(v)
    raise DomainError(f"{type(v).__name__} values are not read")


def from_arrow(table) -> np.ndarray:
    """A table of one element type as rows by columns, a single column as a list. Nulls are refused by name."""
    columns = []
    for name, col in zip(table.column_names, table.columns, strict=True):
        if col.null_count:
            raise DomainError(f"column {name} holds nulls")
        a = col.to_numpy()
        if a.dtype.kind == "M":
            a = a.astype("datetime64[us]").astype(np.int64)
        if a.dtype.kind == "O":
            raise DomainError(f"column {name} has type {col.type}, which is not read")
        columns.append((name, from_python(a)))
    if len({a.dtype.kind for _, a in columns}) > 1:
        raise DomainError("columns of several types: " + ", ".join(n for n, _ in columns))
    return columns[0][1] if len(columns) == 1 else np.stack([a for _, a in columns], axis=1)


def to_python(a: np.ndarray):
    """Nested Python values; boxes open to theirs, a character list to a string."""
    if kind(a) == "char" and a.ndim == 1:
        return "".join(a.tolist())
    if kind(a) == "box" and a.size:
        flat = [to_python(b.v) for b in a.ravel()]
        return flat[0] if a.ndim == 0 else _nest(flat, a.shape)
    return a.tolist()


def _nest(flat: list, shape: tuple[int, ...]):
    if len(shape) == 1:
        return flat
    step = len(flat) // shape[0] if shape[0] else 0
    return [_nest(flat[i * step : (i + 1) * step], shape[1:]) for i in range(shape[0])]
