"""Functions and operators of the second notation where they differ: pervasion, exact agreement, last axes, nesting."""

from __future__ import annotations

import numpy as np

from ..errors import DomainError, IndexRefused, LengthError, NotYet, RankError
from ..functions import numeric as n
from ..functions import scalar as s
from ..functions import structural as st
from ..functions import text as t
from ..values import EMPTY, Box, common, empty_like, fill_of, frame_up, ints, item, kind, obj, one_int
from . import derived as d
from .verb import INFINITE, Distributed, Verb, agree, lower

R = INFINITE
TOL = {"tolerance": s.APL_TOLERANCE, "larger": True}


def enclose(y):
    if y.ndim == 0 and kind(y) != "box":
        return y
    return t.box(y)


def disclose(c):
    return c[()].v if kind(c) == "box" and c.ndim == 0 and c.size else c


def elements(a) -> list:
    """Every element disclosed."""
    return [disclose(item(a.reshape(-1), i)) for i in range(a.size)]


def nested(parts: list, shape: tuple[int, ...]):
    """Elements as one array: simple scalars of one kind stay simple, anything else is boxed."""
    if parts and all(p.ndim == 0 and kind(p) != "box" for p in parts):
        try:
            return np.stack(common(parts)).reshape(shape) if parts[0].dtype.kind != "O" else obj((p[()] for p in parts), shape)
        except DomainError:
            pass
    if not parts:
        return np.zeros(shape, np.int64)
    return obj((Box(p) for p in parts), shape)


def pervade1(f):
    def go(y):
        return nested([go(p) for p in elements(y)], y.shape) if kind(y) == "box" and y.size else f(y)

    return go


def pervade2(f):
    def go(x, y):
        if (kind(x) == "box" and x.size) or (kind(y) == "box" and y.size):
            x, y = agree(x, y, True)
            a, b = np.broadcast_arrays(x, y)
            return nested([go(p, r) for p, r in zip(elements(a), elements(b), strict=True)], a.shape)
        x, y = agree(x, y, True)
        return f(x, y)

    return go


def sc(name, one, two, identity=None, inverse=None, plain_one=False):
    return Verb(name, pervade1(one) if one and not plain_one else one, pervade2(two) if two else None, (R, R, R), identity=identity, inverse=inverse, extra={"apl": True, "exact": True})


def wh(name, one, two, identity=None, inverse=None, **extra):
    return Verb(name, one, two, (R, R, R), identity=identity, inverse=inverse, extra={"apl": True, **extra})


def last_axis(a, f):
    return np.moveaxis(f(np.moveaxis(a, -1, 0)), 0, -1) if a.ndim else a


def reverse_last(y):
    return np.flip(y, -1) if y.ndim else y


def rotate_axis(x, y, axis: int):
    if y.ndim == 0:
        return y
    m = np.moveaxis(y, axis, 0)
    k = ints(x)
    if k.size == 1:
        return np.moveaxis(np.roll(m, -int(np.ravel(k)[0]), 0), 0, axis)
    if k.shape != m.shape[1:]:
        raise LengthError("one amount for every vector is wanted")
    at = (np.arange(len(m)).reshape((-1,) + (1,) * k.ndim) + k) % len(m)
    return np.moveaxis(np.take_along_axis(m, at, 0), 0, axis)


def replicate(x, y, axis: int):
    y = y.reshape(1) if y.ndim == 0 else y
    c = np.atleast_1d(ints(x))
    m = np.moveaxis(y, axis, 0)
    if c.ndim > 1:
        raise RankError("counts are a list")
    takes = int((c >= 0).sum())
    if len(c) == 1:
        c = np.repeat(c, len(m))
    elif len(m) == 1 and takes != 1:
        m = np.repeat(m, takes, axis=0)
    if int((c >= 0).sum()) != len(m) and len(c) != len(m):
        raise LengthError(f"{len(c)} counts for {len(m)} items")
    blank, out, k = empty_like(m, (1, *m.shape[1:])), [m[:0]], 0
    per_item = len(c) == len(m) and takes != len(m)
    for v in c:
        if v >= 0:
            out += [m[k : k + 1]] * int(v)
            k += 1
        else:
            out += [blank] * int(-v)
            k += per_item
    return np.moveaxis(np.concatenate(out), 0, axis)


def expand(x, y, axis: int):
    y = y.reshape(1) if y.ndim == 0 else y
    if kind(y) == "box" and y.size:  # gaps are shaped like the first element
        first_ = disclose(item(y.reshape(-1), 0))
        m = np.atleast_1d(ints(x))
        if y.ndim == 1 and int((m > 0).sum()) in (len(y), 1 if len(y) == 1 else -1) and np.all(m <= 1):
            own = elements(y) if len(y) > 1 else elements(y) * int((m > 0).sum())
            out, k = [], 0
            for f in m:
                out.append(own[k] if f > 0 else prototype(first_))
                k += f > 0
            return nested(out, (len(out),))
    return np.moveaxis(st.expand(x, np.moveaxis(y, axis, 0)), 0, axis)


def prototype(a):
    """The fill shaped like an array: zeros for numbers, blanks for characters."""
    return nested([prototype(p) for p in elements(a)], a.shape) if kind(a) == "box" and a.size else empty_like(a, a.shape)


def take(x, y):
    if y.ndim and len(np.atleast_1d(x)) != y.ndim:
        raise LengthError("a length for every axis is wanted")
    return st.take(np.atleast_1d(ints(x)), y)


def drop(x, y):
    if y.ndim and len(np.atleast_1d(x)) != y.ndim:
        raise LengthError("a length for every axis is wanted")
    return st.drop(np.atleast_1d(ints(x)), y)


def first(y):
    if not y.size:
        return np.asarray(fill_of(y)) if kind(y) != "box" else np.asarray(0)
    return disclose(item(y.reshape(-1), 0))


def mix(y):
    return frame_up(elements(y), y.shape) if kind(y) == "box" and y.size else y


def split(y):
    if y.ndim == 0:
        return y
    return nested_cells([y[i] for i in np.ndindex(y.shape[:-1])], y.shape[:-1])


def nested_cells(cells, shape):
    out = [enclose(c) for c in cells]
    return obj((c[()] for c in out), shape) if all(kind(c) == "box" for c in out) else nested(cells, shape)


def partition(x, y):
    """Runs that begin where the flags rise; zeros leave items out."""
    f = np.atleast_1d(ints(x))
    y = np.atleast_1d(y)
    if len(f) == 1:
        f = np.repeat(f, y.shape[-1])
    if len(f) != y.shape[-1]:
        raise LengthError("a flag for every item is wanted")
    if y.ndim > 1:
        raise NotYet("partitions of tables")
    runs, now = [], None
    for i, v in enumerate(f):
        if v == 0:
            now = None
            continue
        if now is None or v > f[i - 1]:
            now = []
            runs.append(now)
        now.append(i)
    return obj(Box(y[r]) for r in runs) if runs else obj([])


def pick(x, y):
    path = elements(x) if kind(x) == "box" and x.size else [item(np.atleast_1d(x), i) for i in range(x.size)]
    for p in path:
        at = np.atleast_1d(ints(p))
        if len(at) != max(1, y.ndim) and y.ndim:
            raise RankError("an index for every axis is wanted")
        at = at - 1
        if y.ndim == 0 or any(not 0 <= a < m for a, m in zip(at, y.shape, strict=True)):
            raise IndexRefused("no such element")
        y = disclose(item(y[tuple(at[:-1])] if len(at) > 1 else y, int(at[-1])))
    return y


def squad(x, y, origin):
    axes = elements(x) if kind(x) == "box" else [item(np.atleast_1d(x), i) for i in range(x.size)]
    if len(axes) != y.ndim:
        raise RankError("an index for every axis is wanted")
    return index(y, axes, origin)


def index(y, axes, origin):
    """Bracket index: one array per axis, None for a whole one."""
    if len(axes) != y.ndim:
        raise RankError(f"{len(axes)} indices for {y.ndim} axes")
    for k in range(len(axes) - 1, -1, -1):
        if axes[k] is None:
            continue
        if kind(axes[k]) == "box":
            if len(axes) == 1:
                out = [index(y, [item(np.atleast_1d(p), i) for i in range(p.size)], origin) for p in elements(axes[k])]
                return nested(out, axes[k].shape)
            raise DomainError("an index is a number")
        i = ints(axes[k], "an index") - origin
        if np.any((i < 0) | (i >= y.shape[k])):
            raise IndexRefused("an index outside the argument")
        y = np.take(y, i.ravel(), axis=k).reshape(y.shape[:k] + i.shape + y.shape[k + 1 :])
    return y


def iota(y, origin):
    m = np.atleast_1d(ints(y))
    if np.any(m < 0):
        raise DomainError("a length is not negative")
    if len(m) == 1:
        return np.arange(int(m[0])) + origin
    if not len(m):
        return t.box(EMPTY)
    return obj((Box(np.array(i, np.int64) + origin) for i in np.ndindex(tuple(m))), tuple(m))


def where(y, origin):
    s.numbers(y)
    if y.ndim <= 1:
        return st.indices(np.atleast_1d(y)) + origin
    return obj(Box(np.array(i, np.int64) + origin) for i in np.argwhere(y != 0))


def depth(y):
    return np.asarray(t.depth(y))


def union(x, y):
    x, y = np.atleast_1d(x), np.atleast_1d(y)
    if x.ndim > 1 or y.ndim > 1:
        raise RankError("lists are wanted")
    extra = y[~member(y, x)] if y.size else y
    return np.concatenate(st.common_mixed([x, st.nub(extra) if extra.size else extra]))


def member(x, y):
    flat = y.reshape(-1)
    if x.dtype.kind == "O" or flat.dtype.kind == "O":
        pool = elements(flat)
        out = [any(s.match(p, r, **TOL) for r in pool) for p in elements(x)]
        return np.array(out, bool).reshape(x.shape)
    return st.index_of(flat, x, tolerance=s.APL_TOLERANCE, larger=True) < len(flat)


def index_of(x, y, origin):
    x = np.atleast_1d(x)
    if x.dtype.kind == "O" or y.dtype.kind == "O":
        pool = elements(x)
        out = [next((i for i, p in enumerate(pool) if s.match(p, r, **TOL)), len(pool)) for r in elements(y)]
        return np.array(out, np.int64).reshape(y.shape) + origin
    return st.index_of(x, y, tolerance=s.APL_TOLERANCE, larger=True) + origin


def without(x, y):
    x = np.atleast_1d(x)
    if x.ndim > 1:
        raise RankError("a list is wanted")
    return x[~member(x, y)]


def intersection(x, y):
    x = np.atleast_1d(x)
    if x.ndim > 1:
        raise RankError("a list is wanted")
    return x[member(x, y)]


def unique(y):
    return st.nub(np.atleast_1d(y))


def decode(x, y):
    x, y = np.atleast_1d(x), np.atleast_1d(y)
    y2 = np.moveaxis(y, 0, -1)
    out = [st.base_value(r, y2) for r in x.reshape(-1, x.shape[-1])]
    res = frame_up(out, x.shape[:-1])
    return res


def encode(x, y):
    if x.ndim <= 1:
        out = st.digits(x, y) if x.ndim else s.residue(x, y)
        return np.moveaxis(out, -1, 0) if x.ndim and y.ndim else out
    cols = [encode(x[:, k], y) for k in range(x.shape[1])]
    return np.stack(cols, axis=1)


def grade(y, down, origin):
    if y.ndim == 0:
        raise RankError("a list is wanted")
    return st.grade(y, down) + origin


def collate(x, y, down, origin):
    order = {c: i for i, c in reversed(list(enumerate(x.ravel().tolist())))}
    keys = np.array([order.get(c, x.size) for c in y.ravel()]).reshape(y.shape)
    return st.grade(keys, down) + origin


def catenate(x, y, axis):
    return st.append_conform(x, y, axis)


def table_of(y):
    return y.reshape(len(y), -1) if y.ndim else y.reshape(1, 1)


def format_(y):
    return t.format_chars(y, minus="¯")


def format_spec(x, y):
    spec = np.atleast_1d(ints(x)).tolist()
    cells = y.reshape(-1, y.shape[-1]) if y.ndim else y.reshape(1, 1)
    pairs = [(0, spec[0])] if len(spec) == 1 else list(zip(spec[::2], spec[1::2], strict=False))
    if len(pairs) == 1:
        pairs = pairs * cells.shape[1]
    if len(pairs) != cells.shape[1]:
        raise LengthError("a width and a precision for every column are wanted")
    cols = []
    for k, (w, p) in enumerate(pairs):
        texts = [f"{float(v):.{p}f}".replace("-", "¯") if p >= 0 else f"{float(v):.{-p - 1}E}".replace("E+0", "E").replace("E+", "E").replace("E-0", "E¯").replace("E-", "E¯").replace("-", "¯") for v in cells[:, k]]
        w = w or max(map(len, texts)) + 1
        if any(len(v) > w for v in texts):
            raise DomainError("a field is too small")
        cols.append([v.rjust(w) for v in texts])
    rows = ["".join(r) for r in zip(*cols, strict=True)]
    out = np.array([list(r) for r in rows], "<U1")
    return out[0] if y.ndim < 2 else out.reshape(*y.shape[:-1], -1)


def boolean(op):
    def f(x, y):
        s.bits(x, y)
        return op(x, y)

    return f


def negated(y):
    s.bits(y)
    return y == 0


def primitives(origin: int) -> dict[str, Verb]:
    """The functions of the notation for an index origin."""
    eq = lambda x, y: s.equal(x, y, **TOL)
    near = s.APL_TOLERANCE
    own = [
        sc("+", s.conjugate, s.add, 0), sc("-", s.negate, s.subtract, 0), sc("×", lambda y: s.signum(y) if y.dtype.kind != "f" else np.sign(y).astype(np.int64), s.multiply, 1), sc("÷", lambda y: s.divide(np.asarray(1), y, True), lambda x, y: s.divide(x, y, True), 1),
        sc("⋆", s.exp, s.power, 1), sc("⍟", lambda y: s.ln(y, True), lambda x, y: s.log(x, y, True)), sc("⌈", lambda y: s.ceiling(y, near), s.maximum, -1.7976931348623157e308), sc("⌊", lambda y: s.floor(y, near), s.minimum, 1.7976931348623157e308),
        sc("|", s.magnitude, lambda x, y: s.residue(x, y, near), 0), sc("=", None, eq, 1), sc("<", None, lambda x, y: s.less(x, y, **TOL), 0), sc("≤", None, lambda x, y: ~s.greater(x, y, **TOL), 1), sc("≥", None, lambda x, y: ~s.less(x, y, **TOL), 1), sc(">", None, lambda x, y: s.greater(x, y, **TOL), 0),
        sc("∧", None, s.lcm, 1), sc("∨", None, s.gcd, 0), sc("⍲", None, s.nand), sc("⍱", None, s.nor), sc("!", lambda y: s.factorial(y, True), s.binomial, 1), sc("○", lambda y: s.multiply(np.asarray(np.pi), s.to_float(y)), s.circle),
        wh("?", lambda y: n.roll(y, origin=origin), lambda x, y: n.deal(x, y, origin=origin)), wh("⌹", n.inverse_matrix, n.divide_matrix), wh("⍴", st.shape_of, st.reshape_elements), wh(",", st.ravel, lambda x, y: catenate(x, y, -1)), wh("⍪", table_of, lambda x, y: catenate(x, y, 0)),
        wh("⌽", reverse_last, lambda x, y: rotate_axis(x, y, -1)), wh("⊖", st.reverse, lambda x, y: rotate_axis(x, y, 0)), wh("⍉", st.transpose, lambda x, y: st.transpose_apl(np.atleast_1d(ints(x)) - origin, y)), wh("↑", first, take), wh("↓", split, drop),
        wh("⊂", enclose, partition), wh("⊆", lambda y: y if kind(y) == "box" else enclose(y), partition), wh("⊃", mix, pick), wh("⌷", lambda y: y, lambda x, y: squad(x, y, origin)), wh("⊥", None, decode), wh("⊤", None, encode),
        wh("⍳", lambda y: iota(y, origin), lambda x, y: index_of(x, y, origin), origin=origin), wh("⍸", lambda y: where(y, origin), lambda x, y: st.interval_index(x, y, True) + origin - 1, origin=origin), wh("∊", t.enlist, member), wh("⍷", None, lambda x, y: st.find(np.atleast_1d(x) if y.ndim else x, y)),
        wh("∪", unique, union), wh("∩", None, intersection), wh("⍋", lambda y: grade(y, False, origin), lambda x, y: collate(x, y, False, origin), origin=origin), wh("⍒", lambda y: grade(y, True, origin), lambda x, y: collate(x, y, True, origin), origin=origin),
        wh("≡", depth, lambda x, y: np.asarray(s.match(x, y, **TOL))), wh("≢", st.tally, lambda x, y: np.asarray(not s.match(x, y, **TOL))), wh("⍕", format_, format_spec), wh("⊢", lambda y: y, lambda x, y: y), wh("⊣", lambda y: y, lambda x, y: x),
    ]
    out = {v.name: v for v in own}
    out["~"] = wh("~", pervade1(negated), without)
    out["≠"] = wh("≠", lambda y: st.nub_sieve(y.reshape(-1)).reshape(y.shape) if y.size else y, pervade2(lambda x, y: ~eq(x, y)), identity=0, exact=True)
    inverses = {"+": "+", "-": "-", "÷": "÷", "⋆": "⍟", "⍟": "⋆", "~": "~", "⌽": "⌽", "⊖": "⊖", "⍉": "⍉", "⌹": "⌹", "⊢": "⊢", "⊣": "⊣"}
    for a, b in inverses.items():
        out[a].inverse = lambda b=b: out[b]
    return out


# operators


def fold_cells(u: Verb, m):
    """u from the right between the items of m, elements disclosed and enclosed."""
    if m.dtype.kind == "O" and kind(m) == "box" and m.ndim == 1 and len(m):
        acc = disclose(item(m, len(m) - 1))
        for i in range(len(m) - 2, -1, -1):
            acc = u.dyad(disclose(item(m, i)), acc)
        return enclose(acc)
    if not u.extra.get("exact") and m.ndim == 1 and len(m) > 1:
        acc = item(m, len(m) - 1)
        for i in range(len(m) - 2, -1, -1):
            acc = u.dyad(item(m, i), acc)
        return enclose(acc)
    if not u.extra.get("exact") and m.ndim > 1 and len(m) > 1:
        flat = m.reshape(len(m), -1)
        return nested_cells([disclose(fold_cells(u, flat[:, k])) for k in range(flat.shape[1])], m.shape[1:])
    return d.fold(u, m)


def reduce_axis(u: Verb, axis: int, name: str) -> Verb:
    def one(y):
        if isinstance(y, Distributed):
            if axis == -1 and type(y).__name__ == "Mat":
                return lower().row_fold(u, y)
            return lower().reduce(u, y)
        return y if y.ndim == 0 else fold_cells(u, np.moveaxis(y, axis, 0))

    def two(x, y):
        if isinstance(y, Distributed):
            return lower().infix(d.insert(u), x, y, apl=True)
        return np.moveaxis(nwise(u, one_int(x), np.moveaxis(y.reshape(1) if y.ndim == 0 else y, axis, 0)), 0, axis)

    return d.derived("Reduce", name, one, two, (u,), extra={"apl": True})


def nwise(u: Verb, k: int, m):
    if abs(k) > len(m) + 1:
        raise DomainError("a window is longer than the argument by more than one")
    if k == 0:
        if u.identity is None:
            raise DomainError(f"{u} has no identity")
        return np.broadcast_to(np.asarray(u.identity), (len(m) + 1, *m.shape[1:])).copy()
    runs = [m[i : i + abs(k)] for i in range(len(m) - abs(k) + 1)]
    if not runs:
        return m[:0]
    return frame_up([fold_cells(u, r[::-1] if k < 0 else r) for r in runs], (len(runs),))


def scan_axis(u: Verb, axis: int, name: str) -> Verb:
    def one(y):
        if isinstance(y, Distributed):
            return lower().prefix(d.insert(u), y)
        if y.ndim == 0:
            return y
        m = np.moveaxis(y, axis, 0)
        if not len(m):
            return y
        out = [fold_cells(u, m[: i + 1]) for i in range(len(m))]
        if any(kind(o) == "box" for o in out):
            if m.ndim == 1:
                return obj(o[()] if kind(o) == "box" else Box(o) for o in out)
        return np.moveaxis(frame_up(out, (len(m),)), 0, axis)

    return d.derived("Windowed", name, one, None, (u,), extra={"apl": True})


def each(u: Verb) -> Verb:
    def one(y):
        if isinstance(y, Distributed):
            return lower().each(u, y)
        if not y.size:
            return y
        return nested([u.monad(p) for p in elements(y)], y.shape)

    def two(x, y):
        x, y = agree(x, y, True)
        a, b = np.broadcast_arrays(x, y)
        return nested([u.dyad(p, r) for p, r in zip(elements(a), elements(b), strict=True)], a.shape)

    return d.derived("Each", f"{u}¨", one, two, (u,), inverse=lambda: each(d.inverse_of(u)))


def outer(u: Verb) -> Verb:
    def two(x, y):
        if isinstance(x, Distributed) or isinstance(y, Distributed):
            return lower().table(u, x, y)
        shape = x.shape + y.shape
        if u.extra.get("exact") and kind(x) != "box" and kind(y) != "box" and x.size and y.size:
            return u.dyad(np.broadcast_to(x.reshape(x.shape + (1,) * y.ndim), shape), np.broadcast_to(y, shape))
        return nested([u.dyad(p, r) for p in elements(x) for r in elements(y)], shape)

    return d.derived("Reduce", f"∘.{u}", None, two, (u,))


def inner(u: Verb, v: Verb) -> Verb:
    def two(x, y):
        if isinstance(x, Distributed) or isinstance(y, Distributed):
            return lower().inner(u, v, x, y)
        x, y = np.atleast_1d(x), np.atleast_1d(y)
        k = x.shape[-1] if x.shape[-1] != 1 else y.shape[0]
        if x.shape[-1] == 1 and k != 1:
            x = np.repeat(x, k, -1)
        if y.shape[0] == 1 and k != 1:
            y = np.repeat(y, k, 0)
        if x.shape[-1] != y.shape[0]:
            raise LengthError(f"shapes {x.shape} and {y.shape} do not agree")
        rows, cols = x.reshape(-1, k), np.moveaxis(y, 0, -1).reshape(-1, k)
        out = [disclose(fold_cells(u, np.atleast_1d(v.dyad(r, c)))) for r in rows for c in cols]
        return nested(out, x.shape[:-1] + y.shape[1:])

    return d.derived("InnerProduct", f"{u}.{v}", None, two, (u, v))


def ranked(u: Verb, r) -> Verb:
    return d.with_rank(u, np.atleast_1d(r))


def key(u: Verb, origin: int) -> Verb:
    def pairs(x, y):
        x = st.as_items(x)
        c = st.classes(st.items(x), s.APL_TOLERANCE, True)
        heads = sorted(set(c))
        return [(item(x, h), [i for i, k in enumerate(c) if k == h]) for h in heads]

    def one(y):
        got = pairs(y, y)
        return frame_up([u.dyad(k, np.array(at) + origin) for k, at in got], (len(got),))

    def two(x, y):
        if isinstance(x, Distributed) or isinstance(y, Distributed):  # the function sees its groups, not their keys
            return lower().key(Verb("group", lambda g: u.dyad(EMPTY, g), hybrid=True), x, y)
        y = st.as_items(y)
        got = pairs(x, y)
        return frame_up([u.dyad(k, y[at]) for k, at in got], (len(got),))

    return d.derived("KeyPairs", f"{u}⌸", one, two, (u,))


def stencil(u: Verb, w) -> Verb:
    size = [int(v) for v in np.atleast_1d(ints(w))]
    if np.ndim(w) > 1:
        raise NotYet("movements of a stencil")

    def one(y):
        half = [(k - 1) // 2 for k in size]
        padded = empty_like(y, tuple(m + k - 1 for m, k in zip(y.shape, size, strict=False)) + y.shape[len(size) :])
        padded[tuple(slice(h, h + m) for h, m in zip(half, y.shape, strict=False))] = y
        out = []
        for at in np.ndindex(y.shape[: len(size)]):
            edge = np.array([max(0, h - a) - max(0, a + (k - 1 - h) - m + 1) for a, h, k, m in zip(at, half, size, y.shape, strict=False)], np.int64)
            out.append(u.dyad(edge, padded[tuple(slice(a, a + k) for a, k in zip(at, size, strict=True))]))
        return frame_up(out, y.shape[: len(size)])

    return d.derived("Stencil", f"{u}⌺w", one, None, (u, w))


def power(u: Verb, g) -> Verb:
    if isinstance(g, Verb):
        return d.power_until(u, g)
    return d.power_n(u, g)


def beside(f, g) -> Verb:
    if not isinstance(f, Verb):
        return d.bond_left(f, g)
    if not isinstance(g, Verb):
        return d.bond_right(f, g)
    return d.derived("Beside", f"{f}∘{g}", lambda y: f.monad(g.monad(y)), lambda x, y: f.dyad(x, g.monad(y)), (f, g), inverse=lambda: beside(d.inverse_of(g), d.inverse_of(f)))


def before(f, g) -> Verb:
    return d.derived("Before", f"{f}⍛{g}", lambda y: g.dyad(f.monad(y), y), lambda x, y: g.dyad(f.monad(x), y), (f, g))


def along(u: Verb, axis: int) -> Verb:
    """A reversal, rotation, fold or join along a named axis."""
    if u.name in ("⌽", "⊖"):
        return wh(u.name, lambda y: np.flip(y, axis), lambda x, y: rotate_axis(x, y, axis))
    if u.name in (",", "⍪"):
        return wh(u.name, lambda y: y, lambda x, y: catenate(x, y, axis))
    if u.node == "Reduce":
        return reduce_axis(u.parts[0], axis, u.name)
    if u.node == "Windowed":
        return scan_axis(u.parts[0], axis, u.name)
    raise NotYet(f"an axis of {u}")


