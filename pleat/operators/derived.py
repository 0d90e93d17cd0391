"""Verbs made from verbs. Combinators only call their parts; folds, windows and groups go to the lowering for distributed arguments."""

from __future__ import annotations

from fractions import Fraction

import numpy as np

from ..errors import DomainError, IndexRefused, LanguageError, LengthError, NotYet, RankError, Sandboxed
from ..functions import numeric, scalar, structural, text
from ..values import EMPTY, Box, common, empty_like, frame_up, ints, item, items, kind, obj, one_int
from .verb import INFINITE, Distributed, Verb, apply_dyad, apply_monad, cells_of, lower

MOST_ROUNDS = 1 << 16


def derived(node: str, name: str, one, two, parts: tuple, ranks=(INFINITE,) * 3, hybrid: bool = True, **more) -> Verb:
    return Verb(name, one, two, ranks, node, parts, hybrid=hybrid, **more)


def constant(v, name: str = "") -> Verb:
    return derived("Constant", name or "constant", lambda y: v, lambda x, y: v, (v,))


def atop(u: Verb, v: Verb, ranked: bool = False) -> Verb:
    r = v.ranks if ranked else (INFINITE,) * 3
    inv = None if inverse_of(u, False) is None or inverse_of(v, False) is None else lambda: atop(inverse_of(v), inverse_of(u), ranked)

    def one(y):
        if isinstance(y, Distributed) or r[0] >= INFINITE:
            return u.monad(v.monad(y))
        return apply_monad(lambda c: u.monad(v.monad(c)), r[0], y)

    def two(x, y):
        if isinstance(x, Distributed) or isinstance(y, Distributed) or r[1] >= INFINITE and r[2] >= INFINITE:
            return u.monad(v.dyad(x, y))
        return apply_dyad(lambda a, b: u.monad(v.dyad(a, b)), r[1], r[2], x, y)

    if ranked and u.scalar and v.scalar:
        r = (INFINITE,) * 3
    return derived("Atop", f"{u}@{'' if ranked else ':'}{v}", one, two, (u, v), r, inverse=inv, extra={"ranked": ranked})


def compose(u: Verb, v: Verb, ranked: bool = False) -> Verb:
    r = v.ranks[0] if ranked and not (u.scalar and v.scalar) else INFINITE
    inv = None if inverse_of(u, False) is None or inverse_of(v, False) is None else lambda: compose(inverse_of(v), inverse_of(u), ranked)

    def one(y):
        return u.monad(v.monad(y)) if isinstance(y, Distributed) or r >= INFINITE else apply_monad(lambda c: u.monad(v.monad(c)), r, y)

    def two(x, y):
        if isinstance(x, Distributed) or isinstance(y, Distributed) or r >= INFINITE:
            return u.dyad(v.monad(x), v.monad(y))
        return apply_dyad(lambda a, b: u.dyad(v.monad(a), v.monad(b)), r, r, x, y)

    return derived("Compose", f"{u}&{'' if ranked else ':'}{v}", one, two, (u, v), (r, r, r), inverse=inv)


def bond_left(n, v: Verb) -> Verb:
    return derived("BondLeft", f"n&{v}", lambda y: v.dyad(n, y), lambda x, y: power_n(bond_left(n, v), x).monad(y), (n, v), inverse=lambda: bond_inverse(n, v, True))


def bond_right(u: Verb, n) -> Verb:
    return derived("BondRight", f"{u}&n", lambda y: u.dyad(y, n), lambda x, y: power_n(bond_right(u, n), x).monad(y), (u, n), inverse=lambda: bond_inverse(n, u, False))


def bond_inverse(n, v: Verb, left: bool) -> Verb:
    """Inverse of n&v or v&n for the arithmetic verbs."""
    f = scalar
    left_table = {
        "+": lambda y: f.subtract(y, n), "-": lambda y: f.subtract(n, y), "*": lambda y: f.divide(y, n), "×": lambda y: f.divide(y, n), "%": lambda y: f.divide(n, y), "÷": lambda y: f.divide(n, y),
        "^": lambda y: f.log(n, y), "^.": lambda y: f.power(n, y), "⍟": lambda y: f.power(n, y), "%:": lambda y: f.power(y, n), "|.": lambda y: structural.rotate(f.negate(n), y), "⌽": lambda y: structural.rotate(f.negate(n), y),
        "#:": lambda y: structural.base_value(n, y), "#.": lambda y: structural.digits(n, y) if np.ndim(n) else _digits_of(n, y), "#": lambda y: structural.expand(n, y), "C.": lambda y: structural.permute(structural.grade(structural.permutation(n)), y),
    }
    right_table = {
        "+": lambda y: f.subtract(y, n), "-": lambda y: f.add(y, n), "*": lambda y: f.divide(y, n), "×": lambda y: f.divide(y, n), "%": lambda y: f.multiply(y, n), "÷": lambda y: f.multiply(y, n),
        "^": lambda y: f.root(n, y), "^.": lambda y: f.power(y, f.divide(np.asarray(1), y)),
    }
    table = left_table if left else right_table
    if v.name not in table:
        raise DomainError(f"no inverse of {v} with a noun")
    g = table[v.name]
    return Verb(f"inverse of {v}", lambda y: g(y))


def _digits_of(n, y):
    most = float(np.max(scalar.to_float(y))) if y.size else 0
    k = 1
    while float(n) ** k <= most:
        k += 1
    return structural.digits(np.full(k, n), y)


def commute(u: Verb) -> Verb:
    return derived("Commute", f"{u}~", lambda y: u.dyad(y, y), lambda x, y: u.dyad(y, x), (u,), inverse=lambda: _commute_inverse(u))


def _commute_inverse(u: Verb) -> Verb:
    table = {"+": lambda y: scalar.divide(y, np.asarray(2)), "*": scalar.sqrt, "×": scalar.sqrt}
    if u.name not in table:
        raise DomainError(f"no inverse of {u}~")
    return Verb(f"inverse of {u}~", table[u.name])


def hook(u: Verb, v: Verb) -> Verb:
    return derived("Hook", f"({u} {v})", lambda y: u.dyad(y, v.monad(y)), lambda x, y: u.dyad(x, v.monad(y)), (u, v))


def fork(f, g: Verb, h: Verb) -> Verb:
    if not isinstance(f, Verb):
        return derived("NounFork", f"(n {g} {h})", lambda y: g.dyad(f, h.monad(y)), lambda x, y: g.dyad(f, h.dyad(x, y)), (f, g, h))
    if f.name == "[:":
        return derived("Atop", f"([: {g} {h})", lambda y: g.monad(h.monad(y)), lambda x, y: g.monad(h.dyad(x, y)), (g, h), inverse=None if inverse_of(g, False) is None else lambda: atop(inverse_of(h), inverse_of(g)))

    def one(y):
        right = h.monad(y)
        return g.dyad(f.monad(y), right)

    def two(x, y):
        right = h.dyad(x, y)
        return g.dyad(f.dyad(x, y), right)

    return derived("Fork", f"({f} {g} {h})", one, two, (f, g, h))


def with_rank(u: Verb, r: np.ndarray) -> Verb:
    v = [INFINITE if k == np.inf else -INFINITE if k == -np.inf else int(k) for k in np.atleast_1d(r)]
    if len(v) not in (1, 2, 3):
        raise LengthError("one to three ranks are wanted")
    m, lr, rr = v * 3 if len(v) == 1 else (v[1], v[0], v[1]) if len(v) == 2 else v

    def one(y):
        if isinstance(y, Distributed):
            return lower().ranked(u, (m, lr, rr), y)
        return apply_monad(u.monad, m, y)

    def two(x, y):
        if isinstance(x, Distributed) or isinstance(y, Distributed):
            return lower().ranked(u, (m, lr, rr), y, x)
        return apply_dyad(u.dyad, lr, rr, x, y, u.extra.get("exact", False))

    return derived("Rank", f'{u}"', one, two, (u,), (m, lr, rr), inverse=None if inverse_of(u, False) is None else lambda: with_rank(inverse_of(u), r))


ASSOCIATIVE = {"+": np.add, "*": np.multiply, "×": np.multiply, "<.": np.minimum, "⌊": np.minimum, ">.": np.maximum, "⌈": np.maximum}


def fold(u: Verb, y: np.ndarray) -> np.ndarray:
    """u between the items, from the right."""
    if y.ndim == 0:
        return y
    if not len(y):
        if u.identity is None:
            if u.name == ",":
                return np.zeros((0, *y.shape[2:]), y.dtype)
            raise DomainError(f"{u} has no identity")
        ident = np.asarray(u.identity)
        return np.broadcast_to(ident, y.shape[1:]).copy()
    if len(y) == 1:
        return item(y, 0)
    if u.name in ASSOCIATIVE and u.node == "Prim" and y.dtype.kind in "bif" and not (y.dtype.kind == "f" and u.name in "*×" and not np.isfinite(y).all()):
        v = y.astype(np.int64) if y.dtype.kind == "b" else y
        with np.errstate(all="ignore"):
            real = ASSOCIATIVE[u.name].reduce(v.astype(float), axis=0)
        if v.dtype.kind == "i" and (not np.size(real) or np.abs(real).max() < 2.0**62):
            return np.asarray(ASSOCIATIVE[u.name].reduce(v, axis=0))
        if not (np.isnan(real).any() and not np.isnan(v.astype(float)).any()):
            return np.asarray(real)
    own = items(y)
    acc = own[-1]
    for x in reversed(own[:-1]):
        acc = u.dyad(x, acc)
    return acc


def insert(u: Verb) -> Verb:
    def one(y):
        return lower().reduce(u, y) if isinstance(y, Distributed) else fold(u, y)

    def two(x, y):
        if isinstance(x, Distributed) or isinstance(y, Distributed):
            return lower().table(u, x, y)
        return table(u, x, y)

    out = derived("Reduce", f"{u}/", one, two, (u,))
    u.reduce = out.monad
    return out


def table(u: Verb, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """u of every pair of cells that u's ranks ask for."""
    lr, rr = u.ranks[1], u.ranks[2]
    if u.scalar:
        lr = rr = 0
        a = x.reshape(x.shape + (1,) * y.ndim)
        try:
            return u.two(a, np.broadcast_to(y, x.shape + y.shape))
        except (LengthError, RankError):
            pass
    fx, cx = cells_of(x, lr)
    fy, cy = cells_of(y, rr)
    return frame_up([u.dyad(a, b) for a in cx for b in cy], fx + fy)


def outer(u: Verb) -> Verb:
    """Every pair of elements."""

    def two(x, y):
        if isinstance(x, Distributed) or isinstance(y, Distributed):
            return lower().table(u, x, y)
        if u.scalar:
            return table(u, x, y)
        fx, cx = cells_of(x, 0)
        fy, cy = cells_of(y, 0)
        from .apl_verbs import disclose, enclose

        return frame_up([enclose(u.dyad(disclose(a), disclose(b))) for a in cx for b in cy], fx + fy)

    return derived("Reduce", f"∘.{u}", None, two, (u,))


def prefix(u: Verb) -> Verb:
    def one(y):
        if isinstance(y, Distributed):
            return lower().prefix(u, y)
        y = structural.as_items(y)
        if u.node == "Reduce" and len(y) and u.parts[0].name in ASSOCIATIVE and u.parts[0].node == "Prim" and y.dtype.kind in "bi":
            v = y.astype(np.int64)
            f = ASSOCIATIVE[u.parts[0].name]
            with np.errstate(all="ignore"):
                if np.abs(f.accumulate(v.astype(float), axis=0)).max() < 2.0**62:
                    return f.accumulate(v, axis=0)
        if not len(y):
            return np.zeros((0, *_shape_of_try(u, y)), y.dtype)
        return frame_up([u.monad(y[: k + 1]) for k in range(len(y))], (len(y),))

    def two(x, y):
        if isinstance(y, Distributed):
            return lower().infix(u, x, y)
        return apply_dyad(lambda n, v: infix(u, n, v), 0, INFINITE, x, y)

    return derived("Windowed", f"{u}\\", one, two, (u,), extra={"kind": "prefix"}, inverse=lambda: _scan_inverse(u, False))


def _shape_of_try(u, y):
    try:
        return u.monad(y).shape
    except Exception:
        return ()


def infix(u: Verb, n, y):
    y = structural.as_items(y)
    if n == np.inf:
        n = np.asarray(len(y) + 1)
    k = one_int(np.asarray(n))
    if k < 0:
        runs = [y[i : i - k] for i in range(0, len(y), -k)]
    else:
        runs = [y[i : i + k] for i in range(max(0, len(y) - k + 1))]
    if not runs:
        try:
            cell = u.monad(empty_like(y, (abs(k), *y.shape[1:])))
            return np.zeros((0, *cell.shape), cell.dtype)
        except LanguageError:
            return EMPTY
    return frame_up([u.monad(r) for r in runs], (len(runs),))


def suffix(u: Verb) -> Verb:
    def one(y):
        if isinstance(y, Distributed):
            return lower().suffix(u, y)
        y = structural.as_items(y)
        if u.node == "Reduce" and len(y) > 1:  # the fold of a suffix extends the next shorter one
            v = u.parts[0]
            own = items(y)
            out = [own[-1]]
            for x in reversed(own[:-1]):
                out.append(v.dyad(x, out[-1]))
            return frame_up(out[::-1], (len(own),))
        if not len(y):
            return np.zeros((0, *_shape_of_try(u, y)), y.dtype)
        return frame_up([u.monad(y[k:]) for k in range(len(y))], (len(y),))

    def two(x, y):
        if isinstance(y, Distributed):
            return lower().outfix(u, x, y)
        return apply_dyad(lambda n, v: outfix(u, n, v), 0, INFINITE, x, y)

    return derived("Windowed", f"{u}\\.", one, two, (u,), extra={"kind": "suffix"}, inverse=lambda: _scan_inverse(u, True))


def outfix(u: Verb, n, y):
    y = structural.as_items(y)
    k = one_int(np.asarray(n))
    if k >= 0:
        rest = [np.concatenate([y[:i], y[i + k :]]) for i in range(max(0, len(y) - k + 1))]
    else:
        rest = [np.concatenate([y[:i], y[i - k :]]) for i in range(0, len(y), -k)]
    return frame_up([u.monad(r) for r in rest], (len(rest),)) if rest else EMPTY


def _scan_inverse(u: Verb, back: bool) -> Verb:
    table = {"+": scalar.subtract, "*": scalar.divide, "×": scalar.divide, "~:": lambda a, b: a != b, "≠": lambda a, b: a != b}
    if u.node != "Reduce" or u.parts[0].name not in table:
        raise DomainError(f"no inverse of a scan of {u}")
    f = table[u.parts[0].name]

    def one(y):
        if back:
            return np.concatenate(common([f(y[:-1], y[1:]), y[-1:]]))
        return np.concatenate(common([y[:1], f(y[1:], y[:-1])]))

    return Verb("inverse scan", one)


def key(u: Verb) -> Verb:
    def one(y):
        if isinstance(y, Distributed):
            return lower().oblique(u, y)
        return oblique(u, y)

    def two(x, y):
        if isinstance(x, Distributed) or isinstance(y, Distributed):
            return lower().key(u, x, y)
        x, y = structural.as_items(x), structural.as_items(y)
        if len(x) != len(y):
            raise LengthError(f"{len(x)} keys for {len(y)} items")
        c = structural.classes(items(x))
        groups = [y[[i for i, h in enumerate(c) if h == g]] for g in sorted(set(c))]
        if not groups:
            return np.zeros((0, *_shape_of_try(u, y)), y.dtype)
        return frame_up([u.monad(g) for g in groups], (len(groups),))

    return derived("Key", f"{u}/.", one, two, (u,))


def oblique(u: Verb, y):
    if y.ndim < 2:
        return frame_up([u.monad(v.reshape(1)) for v in items(structural.as_items(y))], (len(structural.as_items(y)),))
    n, m = y.shape[:2]
    runs = []
    for d in range(n + m - 1 if n and m else 0):
        runs.append(frame_up([np.asarray(y[i, d - i]) if y.dtype.kind != "O" or y.ndim > 2 else obj([y[i, d - i]], ()) for i in range(max(0, d - m + 1), min(n, d + 1))], (min(n, d + 1) - max(0, d - m + 1),)))
    return frame_up([u.monad(r) for r in runs], (len(runs),)) if runs else EMPTY


def inverse_of(u, must: bool = True):
    if isinstance(u, Verb) and u.inverse is not None:
        try:
            return u.inverse() if callable(u.inverse) and not isinstance(u.inverse, Verb) else u.inverse
        except LanguageError:
            if must:
                raise
            return None
    if must:
        raise DomainError(f"{u} has no inverse")
    return None


def obverse(u: Verb, v: Verb) -> Verb:
    return derived("WithObverse", f"{u} :. {v}", u.monad, u.dyad, (u, v), u.ranks, inverse=v)


def adverse(u: Verb, v: Verb) -> Verb:
    def one(y):
        try:
            return u.monad(y)
        except (NotYet, Sandboxed):
            raise
        except LanguageError:
            return v.monad(y)

    def two(x, y):
        try:
            return u.dyad(x, y)
        except (NotYet, Sandboxed):
            raise
        except LanguageError:
            return v.dyad(x, y)

    return derived("Adverse", f"{u} :: {v}", one, two, (u, v))


def same(a, b) -> bool:
    if isinstance(a, Distributed) or isinstance(b, Distributed):
        return lower().same(a, b)
    return scalar.match(a, b)


def repeated_factor(c, v: Verb, n):
    """c to the n-th power, rounded once, if multiplying n times by the atom c may be one product; else None."""
    if v.node != "Prim" or v.name not in ("*", "×") or not isinstance(c, np.ndarray) or c.ndim or c.dtype.kind not in "if" or not np.isfinite(c):
        return None
    if kind(n) == "box" or n.ndim or not 2 <= n[()] <= 1024:
        return None
    try:
        factor = Fraction(c.item()) ** one_int(n)
        out = int(factor) if c.dtype.kind == "i" else float(factor)
    except OverflowError:
        return None
    fits = abs(out) < 2**53 if c.dtype.kind == "i" else out == c[()] == 0 or abs(out) >= np.finfo(float).tiny
    return np.asarray(out) if fits else None


def power_n(u: Verb, n) -> Verb:
    """u repeated: a count, a list of counts, infinity until nothing changes, a box for the trace."""
    name = f"{u}^:n"

    def go(step, y):
        if kind(n) == "box":
            most = n[()].v if n.ndim == 0 else n.ravel()[0].v
            out, last = [y], y
            limit = MOST_ROUNDS if not most.size else int(np.ravel(most)[0]) - 1
            while len(out) <= limit:
                nxt = step(last)
                if not most.size and same(nxt, last):
                    break
                out.append(nxt)
                last = nxt
            return frame_up(out[: limit + 1], (len(out[: limit + 1]),))
        if n.ndim:
            counts = [v for v in n.ravel()]
            return frame_up([power_n(u, np.asarray(c))._go(step, y) for c in counts], n.shape) if n.size else EMPTY
        c = n[()]
        if c == np.inf:
            for _ in range(MOST_ROUNDS):
                nxt = step(y)
                if isinstance(nxt, Distributed):
                    nxt = lower().settle(nxt)
                if same(nxt, y):
                    return nxt
                y = nxt
            raise DomainError("no fixed point was reached")
        c = one_int(n)
        for _ in range(c):
            y = step(y)
        return y

    def one(y):
        if kind(n) != "box" and n.ndim == 0 and n[()] < 0:
            v = inverse_of(u)
            return power_n(v, -n).monad(y)
        if kind(n) != "box" and n.ndim and np.any(n < 0):
            return frame_up([power_n(u, np.asarray(c)).monad(y) for c in n.ravel()], n.shape)
        if isinstance(y, Distributed) and u.node in ("BondLeft", "BondRight"):  # a column is rounded once, not n times
            c, v = u.parts if u.node == "BondLeft" else u.parts[::-1]
            factor = repeated_factor(c, v, n)
            if factor is not None:
                return v.dyad(factor, y)
        return go(u.monad, y)

    def two(x, y):
        if kind(n) != "box" and n.ndim == 0 and n[()] < 0:
            return power_n(bond_inverse(x, u, True), -n).monad(y)
        factor = repeated_factor(x, u, n) if isinstance(y, Distributed) else None
        return go(lambda v: u.dyad(x, v), y) if factor is None else u.dyad(factor, y)

    out = derived("PowerN", name, one, two, (u, n), inverse=lambda: power_n(inverse_of(u), n))
    out._go = go
    return out


def power_v(u: Verb, v: Verb) -> Verb:
    return derived("PowerV", f"{u}^:{v}", lambda y: power_n(u, v.monad(y)).monad(y), lambda x, y: power_n(u, v.dyad(x, y)).dyad(x, y), (u, v))


def power_until(u: Verb, g: Verb) -> Verb:
    def run(step, y):
        for _ in range(MOST_ROUNDS):
            nxt = step(y)
            if isinstance(nxt, Distributed):
                nxt = lower().settle(nxt)
            if truth(g.dyad(nxt, y)):
                return nxt
            y = nxt
        raise DomainError("the condition was never met")

    return derived("PowerUntil", f"{u}⍣{g}", lambda y: run(u.monad, y), lambda x, y: run(lambda v: u.dyad(x, v), y), (u, g))


def truth(v) -> bool:
    """Empty is true, else the first atom decides."""
    if isinstance(v, Distributed):
        v = lower().first_atom(v)
    return not v.size or bool(np.ravel(v)[0] != 0)


def under(u: Verb, v: Verb, ranked: bool = True) -> Verb:
    if v.name == ">" and v.node == "Prim":
        return each(u)
    inv = inverse_of(v)
    r = v.ranks[0] if ranked else INFINITE

    def one(y):
        f = lambda c: inv.monad(u.monad(v.monad(c)))
        if isinstance(y, Distributed) and r == 0:
            return inv.monad(lower().ranked(u, (0, 0, 0), v.monad(y)))
        return f(y) if isinstance(y, Distributed) or r >= INFINITE or v.scalar and u.scalar else apply_monad(f, r, y)

    def two(x, y):
        f = lambda a, b: inv.monad(u.dyad(v.monad(a), v.monad(b)))
        return f(x, y) if isinstance(y, Distributed) or r >= INFINITE or v.scalar and u.scalar else apply_dyad(f, r, r, x, y)

    return derived("Atop", f"{u}&.{v}", one, two, (u, v))


def opened(c):
    return c[()].v if kind(c) == "box" and c.size and c.ndim == 0 else c


def each(u: Verb) -> Verb:
    def one(y):
        if isinstance(y, Distributed):
            return lower().each(u, y)
        return apply_monad(lambda c: text.box(u.monad(opened(c))), 0, y) if y.size else obj([], y.shape)

    return derived("Each", f"{u}&.>", one, lambda x, y: apply_dyad(lambda a, b: text.box(u.dyad(opened(a), opened(b))), 0, 0, x, y), (u,), inverse=None if inverse_of(u, False) is None else lambda: each(inverse_of(u)))


def frets(kind_: int, mask: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    at = np.flatnonzero(mask)
    if abs(kind_) == 1:
        bounds = [(a, b) for a, b in zip(at, [*at[1:], len(y)], strict=True)]
        return [y[a + (kind_ < 0) : b] for a, b in bounds]
    bounds = [(a, b) for a, b in zip([0, *(at[:-1] + 1)], at + 1, strict=True)]
    return [y[a : b - (kind_ < 0)] for a, b in bounds]


def cut(u: Verb, n) -> Verb:
    k = one_int(n)

    def finish(parts, y):
        if not parts:
            return np.zeros((0, *_shape_of_try(u, y[:0])), y.dtype)
        return frame_up([u.monad(p) for p in parts], (len(parts),))

    def one(y):
        if isinstance(y, Distributed):
            return lower().cut(u, k, None, y)
        if k == 0:
            return u.monad(np.flip(y, tuple(range(y.ndim))))
        if k in (1, -1, 2, -2):
            y = structural.as_items(y)
            if not len(y):
                return finish([], y)
            fret = item(y, 0 if abs(k) == 1 else len(y) - 1)
            return finish(frets(k, np.array([scalar.match(fret, v) for v in items(y)], bool), y), y)
        if k in (3, -3):
            side = min(y.shape) if y.ndim else 1
            return tessellate(u, k, np.full(max(1, y.ndim), side), y)
        raise DomainError(f"no cut {k}")

    def two(x, y):
        if isinstance(x, Distributed) or isinstance(y, Distributed):
            return lower().cut(u, k, x, y)
        if k in (1, -1, 2, -2):
            y = structural.as_items(y)
            if kind(x) == "box":
                return cut_axes(u, k, x, y)
            m = np.atleast_1d(ints(x))
            if len(m) == 1 and len(y) != 1:
                m = np.repeat(m, len(y))
            if len(m) != len(y):
                raise LengthError("a fret for every item is wanted")
            scalar.bits(m)
            return finish(frets(k, m, y), y)
        if k == 0:
            spec = np.atleast_2d(x) if x.ndim else np.array([[0], [int(x)]])
            if x.ndim < 2:
                spec = np.stack([np.zeros_like(np.atleast_1d(x)), np.atleast_1d(x)])
            starts, sizes = spec[0], spec[1]
            for a, (st, n) in enumerate(zip(ints(starts), ints(sizes), strict=True)):
                length = y.shape[a]
                lo = st if st >= 0 else length + st - abs(n) + 1
                picked = np.take(y, range(max(0, lo), min(length, lo + abs(n))), axis=a)
                y = np.flip(picked, a) if n < 0 else picked
            return u.monad(y)
        if k in (3, -3):
            return tessellate(u, k, x, y)
        raise DomainError(f"no cut {k}")

    return derived("Cut", f"{u};.{k}", one, two, (u, n))


def cut_axes(u, k, x, y):
    masks = [np.atleast_1d(ints(b.v)) for b in np.atleast_1d(x)]
    runs = []
    for a, m in enumerate(masks):
        at = np.arange(y.shape[a])
        runs.append([at] if not m.size else frets(k, m, at))
    shape = tuple(len(r) for r in runs)
    out = [u.monad(y[np.ix_(*[runs[a][i] for a, i in enumerate(at)])]) for at in np.ndindex(shape)]
    return frame_up(out, shape)


def tessellate(u: Verb, k: int, x, y):
    spec = np.asarray(x)
    if spec.ndim < 2:
        spec = np.stack([np.ones_like(np.atleast_1d(spec)), np.atleast_1d(spec)])
    moves, sizes = ints(spec)
    n = [y.shape[a] for a in range(len(sizes))]
    counts = []
    for a, (mv, sz) in enumerate(zip(moves, sizes, strict=True)):
        size = abs(sz) if sz != np.iinfo(np.int64).max else n[a]
        if k == 3:
            counts.append(-(-n[a] // mv) if mv else 1)
        else:
            counts.append(max(0, (n[a] - size) // mv + 1) if mv else 1)
    out = []
    for at in np.ndindex(tuple(int(c) for c in counts)):
        part = y
        for a, i in enumerate(at):
            lo = i * moves[a]
            part = np.take(part, range(lo, min(n[a], lo + abs(sizes[a]))), axis=a)
            if sizes[a] < 0:
                part = np.flip(part, a)
        out.append(u.monad(part))
    return frame_up(out, tuple(int(c) for c in counts)) if out else EMPTY


def inner(u: Verb, v: Verb) -> Verb:
    """u over v of rows and columns: J takes the items of y, one argument gives the determinant."""

    def one(y):
        if isinstance(y, Distributed):
            raise NotYet("the determinant of a distributed table")
        return apply_monad(lambda m: numeric.determinant(_folder(u), v, m), 2, y)

    def two(x, y):
        if isinstance(x, Distributed) or isinstance(y, Distributed):
            return lower().inner(u, v, x, y)
        if u.node == "Reduce" and u.parts[0].name == "+" and v.name in ("*", "×") and x.ndim and y.ndim and x.dtype.kind in "bif" and y.dtype.kind in "bif":
            if x.shape[-1] != y.shape[0]:
                if x.shape[-1] != 1 and y.shape[0] != 1:
                    raise LengthError(f"shapes {x.shape} and {y.shape} do not agree")
            else:
                real = np.tensordot(x.astype(float), y.astype(float), 1)
                if x.dtype.kind != "f" and y.dtype.kind != "f" and (not real.size or np.abs(real).max() < 2.0**53):
                    return np.tensordot(x.astype(np.int64), y.astype(np.int64), 1)
                return real
        return apply_dyad(lambda a, b: u.monad(v.dyad(a, b)), 1, INFINITE, x, y)

    return derived("InnerProduct", f"{u} . {v}", one, two, (u, v))


def _folder(u: Verb) -> Verb:
    w = u.parts[0] if u.node == "Reduce" else u
    out = Verb(w.name, w.one, w.two, w.ranks)
    out.reduce = (lambda m: fold(w, m)) if u.node == "Reduce" or u.two is not None else u.monad
    return out


def memo(u: Verb) -> Verb:
    seen: dict = {}

    def cached(k, f):
        if k not in seen:
            seen[k] = f()
        return seen[k]

    return derived("Memo", f"{u} M.", lambda y: cached(structural.key_of(y), lambda: u.monad(y)), lambda x, y: cached((structural.key_of(x), structural.key_of(y)), lambda: u.dyad(x, y)), (u,), u.ranks)


def amend_noun(m) -> Verb:
    def two(x, y):
        if isinstance(x, Distributed) or isinstance(y, Distributed):
            return lower().amend(x, m, y)
        return structural.amend(x, m, y)

    return derived("Amend", "m}", lambda y: composite(m, y), two, (m,))


def composite(m, y):
    if np.ndim(m) == 0:
        return structural.from_items(m, y)
    return np.stack([y[int(k)].reshape(-1)[i] for i, k in enumerate(np.ravel(m))]).reshape(y.shape[1:])


def amend_verb(u: Verb) -> Verb:
    return derived("AmendVerb", f"{u}}}", lambda y: composite(u.monad(y), y), lambda x, y: amend_noun(u.dyad(x, y)).dyad(x, y), (u,))


def fit(u: Verb, n) -> Verb:
    """u with another tolerance, or another fill for shifts and takes."""
    name = f"{u}!.n"
    v = n[()] if n.ndim == 0 else (n.ravel()[0] if n.size else None)
    tolerant = {"=": scalar.equal, "<": scalar.less, ">": scalar.greater, "~:": lambda x, y, **t: ~scalar.equal(x, y, **t), "<:": lambda x, y, **t: ~scalar.greater(x, y, **t), ">:": lambda x, y, **t: ~scalar.less(x, y, **t)}
    if u.name in tolerant and u.node == "Prim":
        f = tolerant[u.name]
        if not 0 <= float(v) <= 2.0**-34:
            raise DomainError("a tolerance lies from 0 to 2^-34")
        return Verb(name, u.one, lambda x, y: f(x, y, tolerance=float(v)), (u.ranks[0], 0, 0), "Fit", (u, n), scalar=True)
    if u.name == "|." and u.node == "Prim":
        one = lambda y: lower().shift(np.asarray(-1), y, v) if isinstance(y, Distributed) else structural.shift(np.asarray(-1), y, v)
        two = lambda x, y: lower().shift(x, y, v) if isinstance(y, Distributed) else structural.shift(x, y, v)
        return derived("ShiftFill", name, one, two, (u, n))
    if u.name in ("{.", "$", "#", ",", ",.", ",:") and u.node == "Prim":
        if u.name == "{.":
            return derived("Fit", name, u.monad, lambda x, y: lower().take(x, y, v) if isinstance(y, Distributed) else structural.take(x, y, v), (u, n))
        raise NotYet(f"{u}!.")
    if u.name in ("-:", "i.", "i:", "e.", "~.", "-.", "E.", "<.", ">.", "|", "#:") and u.node == "Prim":
        t = float(v)
        own = {
            "-:": (u.one, lambda x, y: np.asarray(scalar.match(x, y, t))), "i.": (u.one, lambda x, y: structural.index_of(x, y, tolerance=t)), "i:": (u.one, lambda x, y: structural.index_of(x, y, True, t)),
            "e.": (u.one, lambda x, y: structural.index_of(y, x, tolerance=t) < (len(y) if y.ndim else 1)), "<.": (lambda y: scalar.floor(y, t), u.two), ">.": (lambda y: scalar.ceiling(y, t), u.two), "|": (u.one, lambda x, y: scalar.residue(x, y, t)),
            "~.": (lambda y: y[[i for i, h in enumerate(structural.classes(items(structural.as_items(y)), t)) if h == i]], u.two),
        }.get(u.name, (u.one, u.two))
        return Verb(name, own[0], own[1], u.ranks, "Fit", (u, n), scalar=u.scalar)
    if u.name == "^" and u.node == "Prim":
        return Verb(name, None, lambda x, y: stope(x, y, n), (0, 0, 0), "Fit", (u, n), scalar=False)
    raise DomainError(f"{u} takes no fit")


def stope(x, y, step):
    out = np.asarray(1)
    for k in range(one_int(y)):
        out = scalar.multiply(out, scalar.add(x, scalar.multiply(np.asarray(k), step)))
    return out


def agenda(verbs: list[Verb], pick) -> Verb:
    def choose(v):
        i = one_int(np.asarray(v))
        if not -len(verbs) <= i < len(verbs):
            raise IndexRefused("no such verb in the agenda")
        return verbs[i]

    if isinstance(pick, Verb):
        def one(y):
            if isinstance(y, Distributed):
                return lower().agenda(verbs, pick, y)
            k = pick.monad(y)
            return choose(k).monad(y) if k.ndim == 0 else apply_monad(lambda c: choose(pick.monad(c)).monad(c), 0, y)

        return derived("Agenda", "@.", one, lambda x, y: choose(pick.dyad(x, y)).dyad(x, y), (*verbs, pick))
    return choose(pick)


def evoke(verbs: list[Verb], n: int) -> Verb:
    if n == 0:
        return derived("Evoke", "`:0", lambda y: frame_up([v.monad(y) for v in verbs], (len(verbs),)), lambda x, y: frame_up([v.dyad(x, y) for v in verbs], (len(verbs),)), tuple(verbs))
    if n == 3:
        def one(y):
            own = items(y)
            acc = own[-1]
            for i in range(len(own) - 2, -1, -1):
                acc = verbs[i % len(verbs)].dyad(own[i], acc)
            return acc

        return derived("Evoke", "`:3", one, None, tuple(verbs))
    if n == 6:
        return train(list(verbs))
    raise NotYet(f"evoke {n}")


def train(parts: list) -> Verb:
    """A run of verbs as hooks and forks, grouped from the right."""
    if len(parts) == 1:
        return parts[0]
    if len(parts) == 2:
        return hook(parts[0], parts[1])
    out = fork(parts[-3], parts[-2], parts[-1])
    rest = parts[:-3]
    while rest:
        if len(rest) == 1:
            return hook(rest[0], out)
        out, rest = fork(rest[-2], rest[-1], out), rest[:-2]
    return out


def at_level(u: Verb, n, spread: bool) -> Verb:
    want = one_int(np.atleast_1d(n)[:1])

    def go(y, limit, f):
        if text.level(y) <= limit:
            return f(y)
        return obj((Box(go(b.v, limit, f)) for b in y.ravel()), y.shape)

    def one(y):
        limit = want if want >= 0 else max(0, text.level(y) + want)
        if spread:
            found: list = []
            go(y, limit, lambda c: (found.append(u.monad(c)), c)[1])
            return frame_up(found, (len(found),))
        return go(y, limit, u.monad)

    def two(x, y):
        def pairs(a, b):
            la, lb = text.level(a) <= max(want, 0), text.level(b) <= max(want, 0)
            if la and lb:
                return u.dyad(a, b)
            if la:
                return obj((Box(pairs(a, v.v)) for v in b.ravel()), b.shape)
            if lb:
                return obj((Box(pairs(v.v, b)) for v in a.ravel()), a.shape)
            if a.shape != b.shape and a.size != 1 and b.size != 1:
                raise LengthError("levels do not agree")
            a, b = np.broadcast_arrays(a, b)
            return obj((Box(pairs(v.v, w.v)) for v, w in zip(a.ravel(), b.ravel(), strict=True)), a.shape)

        if spread:
            flat: list = []
            _leaves(pairs(x, y), max(want, 0), flat)
            return frame_up(flat, (len(flat),))
        return pairs(x, y)

    return derived("Level", f"{u}{'S' if spread else 'L'}:n", one, two, (u, n))


def _leaves(v, limit: int, out: list) -> None:
    if text.level(v) <= limit:
        out.append(v)
        return
    for b in v.ravel():
        _leaves(b.v, limit, out)


def characteristics(u: Verb, n) -> np.ndarray:
    k = one_int(n)
    if k == 0:
        return np.array([np.inf if abs(r) >= INFINITE else r for r in u.ranks])
    if k == 1:
        if u.identity is None:
            raise DomainError(f"{u} has no identity")
        return text.chars(f"{text.show_number(np.asarray(u.identity)[()])} $~ }}.@$")
    if k == -1:
        return text.chars(str(inverse_of(u)))
    raise DomainError("a characteristic is 0, 1 or _1")


