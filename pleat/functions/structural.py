"""Structural, selection, search, set and sort functions on local arrays."""

from __future__ import annotations

from functools import cmp_to_key

import numpy as np

from ..errors import DomainError, IndexRefused, LengthError, RankError
from ..values import Box, Sym, common, empty_like, frame_up, ints, item, items, kind, obj, one_int, pad
from . import scalar as s


def shape_of(y):
    return np.array(y.shape, np.int64)


def tally(y):
    return np.asarray(len(y) if y.ndim else 1)


def ravel(y):
    return y.reshape(-1)


def as_items(y):
    return y.reshape(1) if y.ndim == 0 else y


def reshape_items(x, y):
    """x lays out y's items cyclically."""
    want = tuple(int(v) for v in ints(np.atleast_1d(x)))
    if any(v < 0 for v in want):
        raise DomainError("a shape has no negative length")
    y = as_items(y)
    n = int(np.prod(want)) if want else 1
    if not len(y):
        if n:
            raise LengthError("an empty argument has no item to lay out")
        return np.zeros(want + y.shape[1:], y.dtype)
    return y[np.arange(n) % len(y)].reshape(want + y.shape[1:])


def reshape_elements(x, y):
    """x lays out y's elements cyclically; an empty y gives fill."""
    want = tuple(int(v) for v in ints(np.atleast_1d(x)))
    if any(v < 0 for v in want):
        raise DomainError("a shape has no negative length")
    n = int(np.prod(want)) if want else 1
    flat = y.reshape(-1)
    if not flat.size:
        return empty_like(y, want)
    return flat[np.arange(n) % flat.size].reshape(want)


def copy(x, y):
    """Item i of y repeated x[i] times; complex counts add fills behind."""
    y = as_items(y)
    x = np.atleast_1d(x)
    if x.dtype.kind == "c":
        parts = []
        n = max(len(x), len(y))
        for i in range(n):
            c = x[i if len(x) > 1 else 0]
            v = y[i : i + 1] if len(y) > 1 else y[:1]
            parts += [v] * int(c.real) + [empty_like(y, (1, *y.shape[1:]))] * int(c.imag)
        return np.concatenate(parts) if parts else y[:0]
    c = ints(x)
    if np.any(c < 0):
        raise DomainError("a count is not negative")
    if len(c) == 1 and len(y) != 1:
        c = np.repeat(c, len(y))
    if len(y) == 1 and len(c) != 1:
        y = np.repeat(y, len(c), axis=0)
    if len(c) != len(y):
        raise LengthError(f"{len(c)} counts for {len(y)} items")
    return np.repeat(y, c, axis=0)


def expand(x, y):
    """Ones take the next item, zeros a fill; a larger count repeats it, a negative one adds fills."""
    m = np.atleast_1d(ints(x))
    y = as_items(y)
    takes = int((m > 0).sum())
    if len(y) == 1 and takes != 1:
        y = np.repeat(y, takes, axis=0)
    if takes != len(y):
        raise LengthError("as many ones as items are wanted")
    blank = empty_like(y, (1, *y.shape[1:]))
    out, k = [], 0
    for v in m:
        if v > 0:
            out += [y[k : k + 1]] * int(v)
            k += 1
        else:
            out += [blank] * max(1, int(-v))
    return np.concatenate(out) if out else y[:0]


def append(x, y):
    """x and y along the leading axis; unequal items are filled."""
    if x.ndim == 0 and y.ndim == 0:
        return np.concatenate([a.reshape(1) for a in common([x, y])])
    if x.ndim == 0:
        x = np.broadcast_to(x, (1, *y.shape[1:]))
    elif y.ndim == 0:
        y = np.broadcast_to(y, (1, *x.shape[1:]))
    rank = max(x.ndim, y.ndim)
    x, y = (a if a.ndim == rank else a.reshape((1,) * (rank - a.ndim) + a.shape) for a in (x, y))
    cell = tuple(max(p) for p in zip(x.shape[1:], y.shape[1:], strict=True))
    x, y = common([x, y])
    return np.concatenate([pad(x, (len(x), *cell)), pad(y, (len(y), *cell))])


def append_conform(x, y, axis: int):
    """x and y along an axis; the other axes must agree."""
    rank = max(x.ndim, y.ndim, 1)
    axis = axis % rank
    def lift(a, other):
        if a.ndim == 0:
            shape = list(other.shape) if other.ndim else [1]
            if other.ndim:
                shape[axis] = 1
            return np.broadcast_to(a, shape)
        if a.ndim == rank - 1:
            return np.expand_dims(a, axis)
        if a.ndim < rank - 1:
            raise RankError(f"ranks {x.ndim} and {y.ndim} do not join")
        return a
    x, y = lift(x, y), lift(y, x)
    if any(p != q for k, (p, q) in enumerate(zip(x.shape, y.shape, strict=True)) if k != axis):
        raise LengthError(f"shapes {x.shape} and {y.shape} do not join")
    return np.concatenate(common_mixed([x, y]), axis=axis)


def common_mixed(arrays):
    """In one type; where kinds differ every element becomes a boxed atom."""
    try:
        return common(arrays)
    except DomainError:
        return [a if kind(a) == "box" else obj((Box(item(a.reshape(-1), i)) for i in range(a.size)), a.shape) for a in arrays]


def laminate(x, y):
    if x.ndim == 0 and y.ndim == 0:
        x, y = x.reshape(1), y.reshape(1)
    if x.shape != y.shape:
        if x.ndim == 0:
            x = np.broadcast_to(x, y.shape)
        elif y.ndim == 0:
            y = np.broadcast_to(y, x.shape)
    return frame_up([x, y], (2,))


def reverse(y):
    return y[::-1] if y.ndim else y


def rotate(x, y):
    for k, r in enumerate(np.atleast_1d(ints(x))):
        if k >= y.ndim:
            if y.ndim == 0 and k == 0:
                return y
            raise LengthError("more rotations than axes")
        y = np.roll(y, -int(r), axis=k)
    return y


def shift(x, y, fill=None):
    """Shift by x items (left if positive), the gap filled."""
    n = len(y)
    k = one_int(x)
    out = empty_like(y, y.shape) if fill is None else np.full(y.shape, fill)
    if fill is not None:
        y, out = common([y, out])
        out = out.copy()
    if abs(k) < n:
        if k >= 0:
            out[: n - k] = y[k:]
        else:
            out[-k:] = y[: n + k]
    return out


def take(x, y, fill=None):
    want = np.atleast_1d(x)
    if not want.size:
        raise LengthError("a length is wanted")
    if y.ndim == 0:
        y = y.reshape((1,) * len(want))
    if len(want) > y.ndim:
        raise LengthError("more lengths than axes")
    for k, v in enumerate(want):
        n = y.shape[k]
        v = n if v == np.inf else -n if v == -np.inf else int(ints(np.asarray(v)))
        m = min(abs(v), n)
        part = np.take(y, range(m) if v >= 0 else range(n - m, n), axis=k)
        if abs(v) > n:
            shape = list(y.shape)
            shape[k] = abs(v) - n
            blank = empty_like(y, tuple(shape)) if fill is None else np.full(tuple(shape), fill)
            part = np.concatenate(common([part, blank] if v >= 0 else [blank, part]), axis=k)
        y = part
    return y


def drop(x, y):
    want = np.atleast_1d(ints(x))
    if y.ndim == 0:
        y = y.reshape((1,) * len(want))
    if len(want) > y.ndim:
        raise LengthError("more lengths than axes")
    for k, v in enumerate(want):
        n = y.shape[k]
        y = np.take(y, range(min(v, n), n) if v >= 0 else range(max(0, n + v)), axis=k)
    return y


def head(y):
    return item(y, 0) if y.ndim and len(y) else take(np.asarray(1), y).reshape(y.shape[1:]) if y.ndim else y


def tail(y):
    return item(y, len(y) - 1) if y.ndim and len(y) else take(np.asarray(-1), y).reshape(y.shape[1:]) if y.ndim else y


def from_items(x, y):
    """Items of y at the indices x; a boxed x is an index specification."""
    if kind(x) == "box" and x.size:
        return frame_up([select(b.v, y) for b in x.ravel()], x.shape) if x.ndim else select(x[()].v, y)
    y = as_items(y)
    i = ints(x, "an index")
    if np.any((i < -len(y)) | (i >= len(y))):
        raise IndexRefused("an index outside the argument")
    return np.asarray(y[i]) if i.ndim or y.ndim > 1 else item(y, int(i))


def axis_indices(b: np.ndarray, n: int) -> np.ndarray:
    """Indices of one axis of a specification; a box inside it leaves those out."""
    if kind(b) == "box" and b.size:
        out = b.ravel()[0].v
        gone = {int(v) % n if n else 0 for v in ints(out).ravel()}
        return np.array([k for k in range(n) if k not in gone], np.int64)
    i = ints(b, "an index")
    if np.any((i < -n) | (i >= n)):
        raise IndexRefused("an index outside the argument")
    return np.where(i < 0, i + n, i)


def spec_axes(spec: np.ndarray, y: np.ndarray) -> list[np.ndarray] | None:
    """Index arrays axis by axis of a boxed specification, None if it is a plain list of coordinates."""
    if kind(spec) == "box" and spec.size:
        parts = [b.v for b in np.atleast_1d(spec)]
        if len(parts) > y.ndim:
            raise IndexRefused("more axes than the argument has")
        return [axis_indices(p, y.shape[k]) for k, p in enumerate(parts)]
    return None


def select(spec: np.ndarray, y: np.ndarray) -> np.ndarray:
    axes = spec_axes(spec, y)
    if axes is None:
        at = ints(np.atleast_1d(spec), "an index")
        width = at.shape[-1]
        if width > y.ndim:
            raise IndexRefused("more axes than the argument has")
        flat = at.reshape(-1, width)
        for k in range(width):
            if np.any((flat[:, k] < -y.shape[k]) | (flat[:, k] >= y.shape[k])):
                raise IndexRefused("an index outside the argument")
        out = [np.asarray(y[tuple(int(v) for v in row)]) if width < y.ndim or y.dtype.kind != "O" else obj([y[tuple(int(v) for v in row)]], ()) for row in flat]
        return frame_up(out, at.shape[:-1]) if at.ndim > 1 else out[0]
    for k in range(len(axes) - 1, -1, -1):
        a = axes[k]
        lead = y.shape[:k]
        y = np.take(y, a.ravel(), axis=k).reshape(lead + a.shape + y.shape[k + 1 :])
    return y


def flat_positions(spec: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, tuple[int, ...]]:
    """Row-major element positions that a specification picks in y, and their shape."""
    where = np.arange(y.size).reshape(y.shape)
    if kind(spec) == "box" and spec.size:
        got = from_items(spec, where)
        return got.ravel(), got.shape
    got = where[axis_indices(spec, len(y) if y.ndim else 1)] if y.ndim else where
    return np.asarray(got).ravel(), np.asarray(got).shape


def amend(x, m, y):
    """y with the items at m replaced by x: one for all or one each."""
    at, shape = flat_positions(m, y)
    if not (shape[len(shape) - x.ndim :] == x.shape or x.ndim == 0):
        raise LengthError(f"{x.shape} does not fit the places {shape}")
    new, old = common_mixed([np.broadcast_to(x, shape), y])
    out = old.reshape(-1).copy()
    out[at] = new.ravel()
    return out.reshape(y.shape)


def transpose(y):
    return y.T


def transpose_j(x, y):
    """Named axes go to the end; a boxed group runs its axes together."""
    if kind(x) == "box" and x.size:
        groups = [[int(v) % y.ndim for v in np.atleast_1d(ints(b.v)).ravel()] for b in np.atleast_1d(x)]
    else:
        groups = [[int(v)] for v in np.atleast_1d(ints(x))]
        groups = [[g[0] + y.ndim if g[0] < 0 else g[0]] for g in groups]
    named = [a for g in groups for a in g]
    if len(set(named)) != len(named) or any(not 0 <= a < y.ndim for a in named):
        raise IndexRefused("an axis that is not there or stands twice")
    rest = [a for a in range(y.ndim) if a not in named]
    out = y.transpose(rest + named)
    at = len(rest)
    for g in groups:
        for _ in g[1:]:
            n = min(out.shape[at], out.shape[at + 1])
            out = np.moveaxis(np.stack([np.take(np.take(out, i, axis=at + 1), i, axis=at) for i in range(n)]) if n else np.zeros((0, *out.shape[:at], *out.shape[at + 2 :]), out.dtype), 0, at)
        at += 1
    return out


def transpose_apl(x, y):
    """x gives the destination of every axis; axes with one destination run together."""
    d = [int(v) for v in np.atleast_1d(ints(x))]
    if len(d) != y.ndim or sorted(set(d)) != list(range(len(set(d)))):
        raise DomainError("a destination for every axis is wanted")
    shape = [min(n for n, t in zip(y.shape, d, strict=True) if t == k) for k in range(len(set(d)))]
    grid = np.indices(shape)
    return y[tuple(grid[t] for t in d)]


def iota_j(y):
    n = ints(np.atleast_1d(y))
    out = np.arange(int(np.prod(np.abs(n)))).reshape(tuple(np.abs(n)))
    for k, v in enumerate(n):
        if v < 0:
            out = np.flip(out, k)
    return out


def steps(y):
    v = y[()] if y.ndim == 0 else y
    if y.ndim:
        raise RankError("one number is wanted")
    n = int(1 + np.floor(2 * abs(float(v)) + 1e-13))
    out = np.arange(n) - abs(v)
    out = -out if v < 0 else out
    return out if np.asarray(v).dtype.kind == "f" and v != np.floor(v) else out.astype(np.int64)


def hashable(v):
    if isinstance(v, Box):
        return ("b", v.v.shape, tuple(hashable(w) for w in v.v.ravel()))
    if isinstance(v, Sym):
        return ("s", str(v))
    return v.item() if isinstance(v, np.generic) else v


def key_of(cell: np.ndarray):
    return (tuple(cell.shape), tuple(hashable(v) for v in cell.ravel()))


def exact_keys(*arrays) -> bool:
    return all(a.dtype.kind in "biU" or kind(a) in ("sym", "exact") for a in arrays)


def classes(cells: list[np.ndarray], tolerance: float = s.J_TOLERANCE, larger: bool = False) -> list[int]:
    """For each cell the index of the first cell that equals it."""
    if all(exact_keys(c) for c in cells):
        first: dict = {}
        return [first.setdefault(key_of(c), i) for i, c in enumerate(cells)]
    out: list[int] = []
    heads: list[int] = []
    for i, c in enumerate(cells):
        hit = next((h for h in heads if s.match(cells[h], c, tolerance, larger)), i)
        if hit == i:
            heads.append(i)
        out.append(hit)
    return out


def nub(y):
    y = as_items(y)
    c = classes(items(y))
    return y[[i for i, h in enumerate(c) if h == i]]


def nub_sieve(y):
    return np.array([h == i for i, h in enumerate(classes(items(as_items(y))))], bool)


def self_classify(y):
    c = classes(items(as_items(y)))
    return np.array([[h == k for h in c] for k in sorted(set(c))], bool).reshape(len(set(c)), len(c))


def index_of(x, y, last: bool = False, tolerance: float = s.J_TOLERANCE, larger: bool = False):
    """Index among x's items of each cell of y shaped like one; absent gives their number."""
    x = as_items(x)
    rank = x.ndim - 1
    if y.ndim < rank:
        return np.asarray(len(x))
    frame = y.shape[: y.ndim - rank]
    cells = [y] if not frame else [c for c in y.reshape((int(np.prod(frame)), *y.shape[len(frame) :]))] if y.size or np.prod(frame) else []
    cells = [np.asarray(c) if isinstance(c, np.ndarray) else obj([c], ()) if y.dtype.kind == "O" else np.asarray(c) for c in cells]
    own = items(x)
    if exact_keys(x, y):
        seen: dict = {}
        for i, c in enumerate(own):
            k = key_of(c)
            if last or k not in seen:
                seen[k] = i
        out = [seen.get(key_of(c), len(x)) for c in cells]
    else:
        order = range(len(own) - 1, -1, -1) if last else range(len(own))
        out = [next((i for i in order if s.match(own[i], c, tolerance, larger)), len(x)) for c in cells]
    return np.array(out, np.int64).reshape(frame)


def member(x, y):
    """Cells of x that are items of y."""
    return index_of(y, x) < (len(y) if y.ndim else 1)


def member_elements(x, y, **t):
    flat = y.reshape(-1)
    return index_of(flat, x, **t) < len(flat)


def less_items(x, y):
    x = as_items(x)
    rank = x.ndim - 1
    if y.ndim < rank:
        return x
    pool = y.reshape((-1, *y.shape[y.ndim - rank :])) if y.size or rank else y.reshape(0)
    hit = index_of(pool, x) < len(pool)
    return x[~hit]


def indices(y):
    if y.ndim == 0:
        y = y.reshape(1)
    n = ints(y)
    if np.any(n < 0):
        raise DomainError("a count is not negative")
    return np.repeat(np.arange(len(n)), n)


def interval_index(x, y, closed: bool = False):
    """How many items of the ascending x lie below each cell of y (at or below if ``closed``)."""
    x = as_items(x)
    if x.size and y.size and kind(x) != kind(y):
        raise DomainError("the bounds are of another kind")
    rank = x.ndim - 1
    down = len(x) > 1 and compare(item(x, 0), item(x, len(x) - 1)) > 0
    frame = y.shape[: y.ndim - rank]
    cells = [np.asarray(c) for c in y.reshape((-1, *y.shape[len(frame) :]))] if frame else [y]
    out = []
    for c in cells:
        order = [compare(b, c) for b in items(x)]
        if down:
            order = [-o for o in order]
        out.append(sum(o <= 0 if closed else o < 0 for o in order))
    return np.array(out, np.int64).reshape(frame)


def find(x, y):
    """Ones where x begins in y."""
    out = np.zeros(y.shape, bool)
    if x.ndim > y.ndim:
        return out
    if y.ndim == 0:
        return np.asarray(s.match(x, y))
    x = x.reshape((1,) * (y.ndim - x.ndim) + x.shape)
    room = [min(n, n - m + 1) for n, m in zip(y.shape, x.shape, strict=True)]
    if any(r <= 0 for r in room):
        return out
    hit = np.ones(room, bool)
    for at in np.ndindex(x.shape):
        part = y[tuple(slice(a, a + r) for a, r in zip(at, room, strict=True))]
        hit &= s.equal(np.asarray(x[at]) if x.dtype.kind != "O" else obj([x[at]], ()), part)
    out[tuple(slice(0, r) for r in room)] = hit
    return out


ORDER = {"num": 0, "exact": 0, "sym": 1, "char": 2, "box": 3}


def compare(a: np.ndarray, b: np.ndarray) -> int:
    """Total array ordering: kind, rank, shape from the last axis, then elements."""
    ka, kb = (0 if not v.size else ORDER[kind(v)] for v in (a, b))
    if ka != kb:
        return -1 if ka < kb else 1
    if a.ndim != b.ndim:
        return -1 if a.ndim < b.ndim else 1
    if a.shape != b.shape:
        return -1 if a.shape[::-1] < b.shape[::-1] else 1
    for p, q in zip(a.ravel(), b.ravel(), strict=True):
        if isinstance(p, Box):
            c = compare(p.v, q.v)
            if c:
                return c
        else:
            if isinstance(p, (complex, np.complexfloating)) or isinstance(q, (complex, np.complexfloating)):
                p, q = (p.real, p.imag), (q.real, q.imag)
            if p != q:
                return -1 if p < q else 1
    return 0


def grade(y, down: bool = False):
    """Stable permutation that sorts y's items."""
    if y.ndim == 0:
        return np.zeros(1, np.int64)
    if y.ndim == 1 and y.dtype.kind in "bifU" and not (y.dtype.kind == "f" and np.isnan(y).any()):
        if not down:
            return np.argsort(y, kind="stable").astype(np.int64)
        return (len(y) - 1 - np.argsort(y[::-1], kind="stable"))[::-1].astype(np.int64)
    own = items(y)
    order = sorted(range(len(own)), key=cmp_to_key(lambda i, j: compare(own[j], own[i]) if down else compare(own[i], own[j])))
    return np.array(order, np.int64)


def sort_by(x, y, down: bool = False):
    g = grade(y, down)
    x = as_items(x)
    if len(g) > len(x):
        raise LengthError(f"{len(x)} items cannot be sorted by {len(g)}")
    return x[g]


def base_value(x, y):
    """Mixed-radix value of the last axis of y."""
    x = np.atleast_1d(x)
    y = np.atleast_1d(y)
    n = max(x.shape[-1], y.shape[-1])
    if x.shape[-1] == 1:
        x = np.repeat(x, n, axis=-1)
    if y.shape[-1] == 1 and n > 1:
        y = np.repeat(y, n, axis=-1)
    if x.shape[-1] != y.shape[-1]:
        raise LengthError("a radix for every digit is wanted")
    out = np.asarray(0)
    for k in range(n):
        out = s.add(s.multiply(out, np.asarray(x[..., k])), np.asarray(y[..., k]))
    return out


def digits(x, y):
    """Digits of y in the radices x, along a new last axis shaped like x."""
    if x.ndim == 0:
        return s.residue(x, y)
    out, rest = [], y
    for k in range(len(x) - 1, -1, -1):
        r = np.asarray(x[k])
        d = s.residue(r, rest)
        out.append(d)
        rest = s.floor(s.divide(s.subtract(rest, d), r)) if r != 0 else np.zeros_like(rest)
        if rest.dtype.kind == "f" and np.all(np.abs(rest) < 2**53) and y.dtype.kind in "bi":
            rest = rest.astype(np.int64)
    return frame_up(out[::-1], (len(out),)) if y.ndim == 0 else np.moveaxis(np.stack(common(out[::-1])), 0, -1)


def bit_digits(y):
    s.numbers(y)
    most = np.abs(s.to_float(y)).max() if y.size else 0
    n = max(1, int(np.floor(np.log2(most + 0.0 if most else 1))) + 1)
    while y.size and 2**n <= most:
        n += 1
    out = digits(np.full(n, 2), y)
    return out


def catalogue(y):
    """Every combination of one element per item, boxed."""
    parts = [b.v if isinstance(b, Box) else np.asarray(b) for b in (y.ravel() if kind(y) == "box" else items(as_items(y)))]
    shape = tuple(n for p in parts for n in p.shape)
    grids = np.indices(tuple(p.size for p in parts)).reshape(len(parts), -1) if parts else np.zeros((0, 1), int)
    out = []
    for row in grids.T:
        out.append(Box(np.concatenate(common([np.atleast_1d(np.asarray(p.ravel()[i])) if p.dtype.kind != "O" else obj([p.ravel()[i]]) for p, i in zip(parts, row, strict=True)]))))
    return obj(out, shape)


def permutation_rank(y):
    p = list(permutation(y))
    out = 0
    for i, v in enumerate(p):
        out = out * (len(p) - i) + sum(w < v for w in p[i + 1 :])
    return np.asarray(out) if out < 1 << 63 else obj([out], ())


def permutation(y) -> np.ndarray:
    if y.size and y.dtype.kind == "U":
        raise DomainError("a permutation is made of numbers")
    p = np.atleast_1d(ints(y)).ravel()
    n = len(p)
    p = np.where(p < 0, p + max(n, 1), p)
    if sorted(p.tolist()) != list(range(n)):
        m = max([n, *(p + 1)]) if n else 0
        rest = [k for k in range(m) if k not in set(p.tolist())]
        if len(set(p.tolist())) != n:
            raise IndexRefused("a permutation has no repeats")
        p = np.array(rest + p.tolist(), np.int64)
    return p


def anagram(x, y):
    y = as_items(y)
    n = len(y)
    total = 1
    for k in range(2, n + 1):
        total *= k
    r = one_int(x) if x.dtype.kind != "O" else int(x[()])
    if not -total <= r < total:
        raise IndexRefused("no such permutation")
    r %= total
    pool, out = list(range(n)), []
    for k in range(n, 0, -1):
        total //= k
        out.append(pool.pop(r // total))
        r %= total
    return y[np.array(out, np.int64)] if n else y


def cycles(y):
    """Direct permutation to boxed cycles, or back."""
    if kind(y) == "box" and y.size:
        own = [np.atleast_1d(ints(b.v)).ravel() for b in y.ravel()]
        n = max((int(c.max()) + 1 for c in own if c.size), default=0)
        return apply_cycles(own, np.arange(n))
    p = permutation(y)
    seen, out = set(), []
    for i in range(len(p)):
        if i in seen:
            continue
        c, k = [], i
        while k not in seen:
            seen.add(k)
            c.append(k)
            k = int(p[k])
        top = c.index(max(c))
        out.append(c[top:] + c[:top])
    return obj(Box(np.array(c, np.int64)) for c in sorted(out, key=lambda c: c[0]))


def apply_cycles(own: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    at = np.arange(len(y))
    for c in own:
        at2 = at.copy()
        for a, b in zip(c, np.roll(c, -1), strict=True):
            at2[a] = at[b]
        at = at2
    return y[at]


def permute(x, y):
    y = as_items(y)
    if kind(x) == "box" and x.size:
        return apply_cycles([np.atleast_1d(ints(b.v)).ravel() for b in x.ravel()], y)
    p = np.atleast_1d(ints(x))
    p = np.where(p < 0, p + len(y), p)
    if len(set(p.tolist())) != len(p) or np.any((p < 0) | (p >= len(y))):
        raise IndexRefused("a permutation has no repeats")
    rest = [k for k in range(len(y)) if k not in set(p.tolist())]
    return y[np.array(rest + p.tolist(), np.int64)] if len(y) else y




