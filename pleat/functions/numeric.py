"""Primes, polynomials, matrices and random numbers on local arrays."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np

from ..errors import DomainError, LengthError, NotYet
from ..values import Box, common, frame_up, ints, kind, obj, one_int, to_float
from . import scalar as s


def is_prime(n: int) -> bool:
    if n < 2:
        return False
    for p in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37):
        if n % p == 0:
            return n == p
    d, r = n - 1, 0
    while d % 2 == 0:
        d, r = d // 2, r + 1
    for a in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37):
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(r - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_below(n: int) -> np.ndarray:
    if n <= 2:
        return np.zeros(0, np.int64)
    sieve = np.ones(n, bool)
    sieve[:2] = False
    for p in range(2, math.isqrt(n - 1) + 1):
        if sieve[p]:
            sieve[p * p :: p] = False
    return np.flatnonzero(sieve)


def nth_prime(y):
    k = one_int(y)
    if k < 0:
        raise DomainError("primes are counted from zero")
    top = 15 if k < 6 else int((k + 1) * (math.log(k + 1) + math.log(math.log(k + 1)))) + 10
    return np.asarray(primes_below(top)[k])


def factors(n: int) -> list[int]:
    if n < 1:
        raise DomainError("a positive whole number is wanted")
    out = []
    for p in (2, 3, 5):
        while n % p == 0:
            out.append(p)
            n //= p
    p = 7
    while p * p <= n and p < 100_000:
        while n % p == 0:
            out.append(p)
            n //= p
        p += 2
    stack = [n] if n > 1 else []
    while stack:
        m = stack.pop()
        if is_prime(m):
            out.append(m)
        else:
            d = _rho(m)
            stack += [d, m // d]
    return sorted(out)


def _rho(n: int) -> int:
    for c in range(1, 100):
        x = y = 2
        d = 1
        while d == 1:
            x = (x * x + c) % n
            y = (y * y + c) % n
            y = (y * y + c) % n
            d = math.gcd(abs(x - y), n)
        if d != n:
            return d
    raise DomainError("no factor found")


def whole(v) -> int:
    if isinstance(v, Fraction) and v.denominator == 1:
        return int(v)
    if isinstance(v, int):
        return v
    if float(v) != math.floor(float(v)):
        raise DomainError("a whole number is wanted")
    return int(v)


def big(values: list[int], shape=None) -> np.ndarray:
    a = np.array(values, np.int64) if all(abs(v) < 1 << 63 for v in values) else obj(values)
    return a if shape is None else a.reshape(shape)


def prime_factors(y):
    return big(factors(whole(y[()])))


def prime_exponents(x, y):
    f = factors(whole(y[()]))
    v = x[()]
    if v == -np.inf:
        own = sorted(set(f))
        return big(own + [f.count(p) for p in own], (2, len(own)))
    if v == np.inf:
        own = [int(p) for p in primes_below((max(f) if f else 1) + 1)]
        return big([f.count(p) for p in own])
    k = int(v)
    if k < 0:
        raise NotYet("negative forms of prime exponents")
    own, n = [], 2
    while len(own) < k:
        if is_prime(n):
            own.append(n)
        n += 1
    return big([f.count(p) for p in own])


def prime_query(x, y):
    k, v = one_int(x), y[()]
    if k == -1:
        return np.asarray(len(primes_below(max(0, math.ceil(float(v))))))
    if k in (0, 1):
        w = float(v) == math.floor(float(v))
        p = w and is_prime(int(v))
        return np.asarray(p if k else (w and int(v) > 1 and not p))
    if k in (2, 3):
        f = factors(whole(v))
        own = sorted(set(f))
        return big(f) if k == 3 else big(own + [f.count(p) for p in own], (2, len(own)))
    if k == 4:
        n = math.floor(float(v)) + 1
        while not is_prime(n):
            n += 1
        return np.asarray(n)
    if k == -4:
        n = math.ceil(float(v)) - 1
        while n > 1 and not is_prime(n):
            n -= 1
        if n < 2:
            raise DomainError("no prime lies below")
        return np.asarray(n)
    raise NotYet(f"prime query {k}")


def roots_form(y) -> np.ndarray:
    """Ascending coefficients of a boxed (multiplier ; roots)."""
    parts = [b.v for b in np.atleast_1d(y)]
    m, r = (np.asarray(1), parts[0]) if len(parts) == 1 else parts[:2]
    out = np.atleast_1d(m).astype(complex)
    for v in np.atleast_1d(r).ravel():
        out = np.convolve(out, np.array([-v, 1]))
    return tidy_complex(out)


def tidy_complex(a: np.ndarray) -> np.ndarray:
    if a.dtype.kind == "c" and np.all(np.abs(a.imag) <= 1e-12 * np.maximum(1, np.abs(a))):
        a = a.real
        near = np.round(a)
        if np.all(np.abs(a - near) <= 1e-10 * np.maximum(1, np.abs(a))):
            return near.astype(np.int64)
    return a


def poly_eval(x, y):
    c = roots_form(x) if kind(x) == "box" and x.size else np.atleast_1d(x)
    out = np.zeros(y.shape, np.int64)
    for k in range(len(c) - 1, -1, -1):
        out = s.add(s.multiply(out, y), np.asarray(c[k]))
    return out


def poly_roots(y):
    if kind(y) == "box" and y.size:
        return roots_form(y)
    c = np.trim_zeros(np.atleast_1d(y), "b")
    if not len(c):
        return obj([Box(np.asarray(0)), Box(np.zeros(0, np.int64))])
    r = np.roots(c[::-1].astype(complex)) if len(c) > 1 else np.zeros(0)
    for _ in range(3):  # polish by Newton steps
        if len(r):
            p, d = np.polyval(c[::-1], r), np.polyval(np.polyder(c[::-1]), r)
            r = r - np.where(d != 0, p / np.where(d == 0, 1, d), 0)
    r = np.array(sorted(r, key=lambda v: (-abs(v), -v.real, -v.imag)), complex)
    r = np.where(np.abs(r.imag) < 1e-12 * np.maximum(1, np.abs(r)), r.real + 0j, r)
    return obj([Box(np.asarray(c[-1])), Box(r.real if not np.any(r.imag) else r)])


def poly_derivative(y):
    c = roots_form(y) if kind(y) == "box" and y.size else np.atleast_1d(y)
    return s.multiply(c[1:], np.arange(1, len(c))) if len(c) > 1 else np.zeros(1, np.int64)


def poly_integral(x, y):
    c = np.atleast_1d(y)
    out = s.divide(c, np.arange(1, len(c) + 1))
    return np.concatenate(common([np.atleast_1d(x), out]))


def inverse_matrix(y):
    s.numbers(y)
    if y.ndim < 2:
        v = np.atleast_1d(y)
        if y.ndim == 0:
            if y == 0:
                raise DomainError("a singular argument")
            return s.divide(np.asarray(1), y)
        return s.divide(v, np.asarray((v * v).sum()))
    if y.shape[0] < y.shape[1]:
        raise LengthError("more columns than rows")
    if y.dtype.kind == "O":
        return solve_exact(y, obj([Fraction(int(i == j)) for i in range(len(y)) for j in range(len(y))], (len(y), len(y))))
    return solve(np.eye(len(y)), y)


def solve(x, y):
    """Least-squares solution of y a = x."""
    y = to_float(y)
    if y.ndim < 2:
        y = np.atleast_1d(y)[:, None]
        squeeze = True
    else:
        squeeze = False
    if x.ndim > 2:
        raise NotYet("a right-hand side of rank 3 and more")
    if len(np.atleast_1d(x)) != len(y):
        raise LengthError("as many equations as values are wanted")
    if y.shape[0] < y.shape[1]:
        raise LengthError("more columns than rows")
    q, r = np.linalg.qr(y)
    if np.any(np.abs(np.diag(r)) <= 1e-14 * max(1e-300, np.abs(r).max())):
        raise DomainError("a singular argument")
    out = np.linalg.solve(r, q.conj().T @ np.atleast_1d(to_float(x)))
    return out[0] if squeeze else out


def divide_matrix(x, y):
    s.numbers(x, y)
    if y.ndim == 0:
        return s.divide(x, y)
    if y.dtype.kind == "O" and x.dtype.kind != "f":
        return solve_exact(y, x)
    return np.asarray(solve(x, y))


def solve_exact(a, b):
    n = len(a)
    if a.shape[0] != a.shape[1]:
        return np.asarray(solve(to_float(b), to_float(a)))
    m = [[Fraction(v) for v in row] for row in a]
    r = [[Fraction(v) for v in np.atleast_1d(row)] for row in b]
    for i in range(n):
        p = next((k for k in range(i, n) if m[k][i]), None)
        if p is None:
            raise DomainError("a singular argument")
        m[i], m[p], r[i], r[p] = m[p], m[i], r[p], r[i]
        inv = 1 / m[i][i]
        m[i], r[i] = [v * inv for v in m[i]], [v * inv for v in r[i]]
        for k in range(n):
            if k != i and m[k][i]:
                f = m[k][i]
                m[k] = [u - f * v for u, v in zip(m[k], m[i], strict=True)]
                r[k] = [u - f * v for u, v in zip(r[k], r[i], strict=True)]
    return s.tidy(obj((v for row in r for v in row), (n, *np.shape(b)[1:])))


def determinant(u, v, y):
    """Alternating expansion: u over minors by v; elimination for minus and times."""
    if y.ndim < 2:
        y = np.atleast_1d(y)[:, None]
    if u.name == "-" and v.name in ("*", "×") and y.shape[0] == y.shape[1]:
        if y.dtype.kind in "bi":
            d = _bareiss([[int(w) for w in row] for row in y])
            return np.asarray(d) if abs(d) < 1 << 63 else np.asarray(float(d))
        if y.dtype.kind == "O":
            return s.tidy(obj([_det([[Fraction(w) for w in row] for row in y])], ()))
        return np.asarray(np.linalg.det(y))
    if len(y) > 16:
        raise DomainError("a determinant by minors has at most 16 rows")

    def minors(m):
        if m.shape[1] == 1:
            return u.reduce(m[:, 0])
        return u.reduce(frame_up([v.dyad(np.asarray(m[i, 0]), minors(np.delete(m[:, 1:], i, axis=0))) for i in range(len(m))], (len(m),)))

    return minors(y) if y.shape[1] else np.asarray(v.identity if v.identity is not None else 1)


def _bareiss(m: list[list[int]]) -> int:
    n, sign, last = len(m), 1, 1
    for k in range(n - 1):
        if not m[k][k]:
            p = next((i for i in range(k + 1, n) if m[i][k]), None)
            if p is None:
                return 0
            m[k], m[p], sign = m[p], m[k], -sign
        for i in range(k + 1, n):
            for j in range(k + 1, n):
                m[i][j] = (m[i][j] * m[k][k] - m[i][k] * m[k][j]) // last
        last = m[k][k]
    return sign * m[-1][-1] if n else 1


def _det(m: list[list[Fraction]]) -> Fraction:
    out, n = Fraction(1), len(m)
    for i in range(n):
        p = next((k for k in range(i, n) if m[k][i]), None)
        if p is None:
            return Fraction(0)
        if p != i:
            m[i], m[p], out = m[p], m[i], -out
        out *= m[i][i]
        for k in range(i + 1, n):
            f = m[k][i] / m[i][i]
            m[k] = [a - f * b for a, b in zip(m[k], m[i], strict=True)]
    return out


def hypergeometric(m, n, y, terms: int | None = None):
    m, n = ([complex(v) for v in np.atleast_1d(p)] for p in (m, n))
    for v in list(m):
        if v in n:
            m.remove(v)
            n.remove(v)
    z, total, term = complex(y[()]), 0j, 1 + 0j
    for k in range(terms if terms is not None else 1 << 16):
        total += term
        num = np.prod([v + k for v in m]) if m else 1
        den = np.prod([v + k for v in n]) if n else 1
        nxt = term * num / den * z / (k + 1)
        if nxt == 0 or (terms is None and abs(nxt) <= 1e-17 * abs(total)):
            if terms is None or nxt == 0:
                total += nxt
                break
        term = nxt
    return np.asarray(total.real if total.imag == 0 else total)


_rng = np.random.Generator(np.random.MT19937(16807))


def roll(y, fixed: bool = False, origin: int = 0):
    g = np.random.Generator(np.random.MT19937(16807)) if fixed else _rng
    n = ints(y)
    if np.any(n < 0) or (origin and np.any(n == 0)):
        raise DomainError("a positive bound is wanted")
    if np.any(n == 0):
        return np.where(n == 0, g.random(n.shape), np.floor(g.random(n.shape) * n))
    return (g.random(n.shape) * n).astype(np.int64) + origin


def deal(x, y, fixed: bool = False, origin: int = 0):
    g = np.random.Generator(np.random.MT19937(16807)) if fixed else _rng
    k, n = one_int(x), one_int(y)
    if not 0 <= k <= n:
        raise DomainError("more values than there are")
    return g.permutation(n)[:k].astype(np.int64) + origin
