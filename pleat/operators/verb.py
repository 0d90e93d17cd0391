"""Verbs: rank, frames and agreement, over local arrays and distributed values alike.

A verb whose argument is distributed (see ``pleat.plans``) hands itself to the lowering; the
combinators of ``derived`` only call their parts, so they build plans without knowing it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import numpy as np

from ..errors import LengthError, NotYet, RankError
from ..values import atom, frame_up

INFINITE = 99


class Distributed:
    """Base of values that live in a DataFrame."""

    def __reduce__(self):
        return Elsewhere, ()


class Elsewhere(Distributed):
    """What a distributed value becomes in a verb that is sent to a worker: nothing that can be used there."""


def lower():
    from ..plans import lowering

    return lowering


@dataclass(eq=False)
class Verb:
    name: str
    one: Callable | None = None
    two: Callable | None = None
    ranks: tuple[int, int, int] = (INFINITE, INFINITE, INFINITE)
    node: str = "Prim"
    parts: tuple = ()
    inverse: Any = None
    identity: Any = None
    extra: dict = field(default_factory=dict)
    hybrid: bool = False  # calls other verbs only: distributed arguments pass through
    scalar: bool = False  # one and two work elementwise on whole arrays

    def monad(self, y):
        return whole(self._monad(y))

    def dyad(self, x, y):
        return whole(self._dyad(x, y))

    def _monad(self, y):
        if isinstance(y, Distributed) and not self.hybrid:
            return lower().monad(self, y)
        if self.one is None:
            raise NotYet(f"{self.name} with one argument")
        r = self.ranks[0]
        if self.scalar or r >= INFINITE or isinstance(y, Distributed):
            return self.one(y)
        return apply_monad(self.one, r, y)

    def _dyad(self, x, y):
        if (isinstance(x, Distributed) or isinstance(y, Distributed)) and not self.hybrid:
            return lower().dyad(self, x, y)
        if self.two is None:
            raise NotYet(f"{self.name} with two arguments")
        _, lr, rr = self.ranks
        if isinstance(x, Distributed) or isinstance(y, Distributed):
            return self.two(x, y)
        if self.scalar:
            x, y = agree(x, y, self.extra.get("exact", False))
            return self.two(x, y)
        if lr >= INFINITE and rr >= INFINITE:
            return self.two(x, y)
        return apply_dyad(self.two, lr, rr, x, y, self.extra.get("exact", False))

    def __repr__(self) -> str:
        return self.name


def whole(v):
    """Results of numpy calls on atoms are scalars; as nouns they are rank-0 arrays."""
    return v if isinstance(v, (np.ndarray, Distributed)) else atom(v)


def split_rank(ndim: int, r: int) -> int:
    """Cell rank of an argument under verb rank r; negative counts off the frame."""
    return max(0, ndim + r) if r < 0 else min(r, ndim)


def agree(x: np.ndarray, y: np.ndarray, exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Arguments of a scalar verb, shaped to broadcast: a frame is a leading part of the other, or equal (``exact``)."""
    if x.shape == y.shape or not x.ndim or not y.ndim:
        return x, y
    if exact:
        if x.size == 1 and (y.size != 1 or x.ndim <= y.ndim):
            return x.reshape(()), y
        if y.size == 1:
            return x, y.reshape(())
        raise (RankError if x.ndim != y.ndim else LengthError)(f"shapes {x.shape} and {y.shape} do not agree")
    a, b = (x, y) if x.ndim <= y.ndim else (y, x)
    if b.shape[: a.ndim] != a.shape:
        raise LengthError(f"shapes {x.shape} and {y.shape} do not agree")
    a = a.reshape(a.shape + (1,) * (b.ndim - a.ndim))
    return (a, b) if x.ndim <= y.ndim else (b, a)


def cells_of(a: np.ndarray, r: int) -> tuple[tuple[int, ...], list[np.ndarray]]:
    k = split_rank(a.ndim, r)
    frame, cell = a.shape[: a.ndim - k], a.shape[a.ndim - k :]
    n = int(np.prod(frame)) if frame else 1
    flat = a.reshape((n, *cell))
    return frame, [_cell(flat, i) for i in range(n)]


def _cell(flat: np.ndarray, i: int) -> np.ndarray:
    v = flat[i]
    if isinstance(v, np.ndarray):
        return v
    out = np.empty((), flat.dtype)
    out[()] = v
    return out


def apply_monad(f: Callable, r: int, y: np.ndarray) -> np.ndarray:
    frame, cells = cells_of(y, r)
    if not frame:
        return f(cells[0])
    if not cells:
        return probe(lambda: f(blank_cell(y, r)), frame)
    return frame_up([f(c) for c in cells], frame)


def blank_cell(a: np.ndarray, r: int) -> np.ndarray:
    from ..values import empty_like

    k = split_rank(a.ndim, r)
    return empty_like(a, a.shape[a.ndim - k :])


def probe(f: Callable, frame: tuple[int, ...]) -> np.ndarray:
    """The empty result of a frame without cells: shaped by one try on fill."""
    try:
        cell = f()
        return np.zeros(frame + cell.shape, cell.dtype)
    except Exception:
        return np.zeros(frame, np.int64)


def apply_dyad(f: Callable, lr: int, rr: int, x: np.ndarray, y: np.ndarray, exact: bool = False) -> np.ndarray:
    fx, cx = cells_of(x, lr)
    fy, cy = cells_of(y, rr)
    if not fx and not fy:
        return f(cx[0], cy[0])
    short, long = (fx, fy) if len(fx) <= len(fy) else (fy, fx)
    if long[: len(short)] != short or (exact and short and short != long):
        raise LengthError(f"frames {fx} and {fy} do not agree")
    n = int(np.prod(long))
    if not n:
        return probe(lambda: f(blank_cell(x, lr), blank_cell(y, rr)), long)
    rep = n // max(1, int(np.prod(short)))
    px = [i // rep if len(fx) < len(fy) else i for i in range(n)]
    py = [i // rep if len(fy) < len(fx) else i for i in range(n)]
    return frame_up([f(cx[i], cy[j]) for i, j in zip(px, py, strict=True)], long)
