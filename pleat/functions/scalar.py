"""Scalar functions on local arrays: arithmetic, comparison, Boolean, circle and number-theoretic."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np

from ..errors import DomainError, NanError, NotYet
from ..values import exact_cast, is_number, kind, obj, to_float

#: Comparison tolerances (fixed values): J relative to the smaller magnitude, APL to the larger.
J_TOLERANCE = 2.0**-44
APL_TOLERANCE = 1e-13


def numbers(*arrays: np.ndarray) -> None:
    if all(a.size for a in arrays):
        for a in arrays:
            if not is_number(a):
                raise DomainError("numbers are wanted")


def plain(a: np.ndarray) -> np.ndarray:
    """An empty argument of any kind as an empty numeric one, and what stands beside one."""
    return a if is_number(a) and (a.size or a.dtype.kind != "O") else np.zeros(a.shape, np.int64)


def wide(a: np.ndarray) -> np.ndarray:
    return a.astype(np.int64) if a.dtype.kind == "b" else a


def exact_pair(x: np.ndarray, y: np.ndarray) -> bool:
    return "O" in (x.dtype.kind, y.dtype.kind) and x.dtype.kind not in "fc" and y.dtype.kind not in "fc"


def pair(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    numbers(x, y)
    x, y = plain(x), plain(y)
    if exact_pair(x, y):
        return exact_cast(x), exact_cast(y)
    if "O" in (x.dtype.kind, y.dtype.kind):
        return to_float(x), to_float(y)
    return wide(x), wide(y)


def tidy(a) -> np.ndarray:
    """Exact results in lowest terms; whole rationals as integers."""
    a = np.asarray(a)
    if a.dtype.kind == "O":
        return obj((v.numerator if isinstance(v, Fraction) and v.denominator == 1 else v for v in a.ravel()), a.shape)
    return a


def careful(op, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Integers stay integers unless any result leaves 64 bits; then the whole pass is float."""
    x, y = pair(x, y)
    if x.dtype.kind == "i" and y.dtype.kind == "i":
        with np.errstate(all="ignore"):
            whole = op(x, y)
            real = op(x.astype(float), y.astype(float))
        return real if real.size and np.abs(real).max() >= 2.0**63 else whole
    with np.errstate(all="ignore"):
        return tidy(op(x, y))


def no_new_nan(out: np.ndarray, *args: np.ndarray) -> np.ndarray:
    if out.dtype.kind == "f" and np.isnan(out).any() and not any(a.dtype.kind == "f" and np.isnan(a).any() for a in args):
        raise NanError("infinities without an answer")
    return out


def add(x, y):
    return no_new_nan(careful(np.add, x, y), x, y)


def subtract(x, y):
    return no_new_nan(careful(np.subtract, x, y), x, y)


def multiply(x, y):
    out = careful(np.multiply, x, y)
    if out.dtype.kind == "f" and np.isnan(out).any():
        zero = np.broadcast_to((to_float(x) == 0) | (to_float(y) == 0), out.shape)
        out = np.where(zero, 0.0, out)
    return out


def divide(x, y, apl: bool = False):
    x, y = pair(x, y)
    if x.dtype.kind == "O":
        if any(v == 0 for v in y.ravel()):
            return divide(to_float(x), to_float(y), apl)
        return tidy(np.vectorize(lambda a, b: Fraction(a) / Fraction(b), otypes=[object])(x, y) if x.size and y.size else x + y)
    zero = y == 0
    if apl and np.any(zero & (x != 0)):
        raise DomainError("division by zero")
    with np.errstate(all="ignore"):
        out = np.true_divide(x, y)
        if np.any(zero):
            both = zero & (x == 0)
            sign = np.where(np.signbit(to_float(y)) if y.dtype.kind != "c" else False, -1.0, 1.0)
            out = np.where(zero, np.where(both, 1.0 if apl else 0.0, np.sign(x) * np.inf * (sign if y.dtype.kind == "f" else 1.0)), out)
    return no_new_nan(out, *(a for a in (x, y) if a.dtype.kind == "f")) if out.dtype.kind == "f" else out


def power(x, y):
    x, y = pair(x, y)
    if x.dtype.kind == "O":
        def one(a, b):
            if isinstance(b, Fraction) and b.denominator != 1:
                r = float(a) ** float(b)
                return r
            b = int(b)
            return a**b if b >= 0 else (Fraction(1) / Fraction(a) ** -b if a else math.inf)
        out = [one(a, b) for a, b in zip(*(v.ravel() for v in np.broadcast_arrays(x, y)), strict=True)]
        shape = np.broadcast_shapes(x.shape, y.shape)
        return np.array([float(v) for v in out]).reshape(shape) if any(isinstance(v, float) for v in out) else tidy(obj(out, shape))
    if "c" not in (x.dtype.kind, y.dtype.kind):
        xf, yf = to_float(x), to_float(y)
        with np.errstate(all="ignore"):
            if np.any((xf < 0) & np.isinf(yf)):
                raise NanError("an infinite power of a negative number")
            if np.any((xf < 0) & (yf != np.floor(yf))):
                return np.power(xf.astype(complex), yf)
            out = np.power(xf, yf)
        if x.dtype.kind == "i" and y.dtype.kind == "i" and np.all(y >= 0) and (not out.size or np.abs(out).max() < 2.0**63):
            return np.power(x, y)
        return out
    with np.errstate(all="ignore"):
        zero = (np.asarray(x) == 0) & (np.asarray(y) == 0)
        return np.where(zero, 1, np.power(x.astype(complex), y))


def exp(y):
    numbers(y)
    with np.errstate(all="ignore"):
        return np.exp(to_float(y))


def ln(y, apl: bool = False):
    numbers(y)
    y = to_float(y)
    if apl and np.any(y == 0):
        raise DomainError("logarithm of zero")
    with np.errstate(all="ignore"):
        if y.dtype.kind == "f" and np.any(y < 0):
            y = y.astype(complex)
        return np.log(y)


def log(x, y, apl: bool = False):
    if apl:
        xf, yf = np.broadcast_arrays(to_float(x), to_float(y))
        if np.all((xf == 1) & (yf == 1) | (xf == 0) & (yf == 0)):
            return np.ones(xf.shape, np.int64)
    return divide(ln(y, apl), ln(x, apl), apl)


def sqrt(y):
    numbers(y)
    if y.dtype.kind == "O":
        roots = [math.isqrt(abs(v.numerator)) for v in y.ravel()], [math.isqrt(v.denominator) for v in y.ravel()]
        if all(n * n == v.numerator and d * d == v.denominator for n, d, v in zip(*roots, y.ravel(), strict=True)):
            return tidy(obj((Fraction(n, d) for n, d in zip(*roots, strict=True)), y.shape))
    y = to_float(y)
    if y.dtype.kind == "f" and np.any(y < 0):
        y = y.astype(complex)
    return np.sqrt(y)


def root(x, y):
    if np.all(to_float(x) == 2):
        return sqrt(y)
    return power(y, divide(np.asarray(1), x))


def negate(y):
    return subtract(np.asarray(0), y) if y.dtype.kind != "f" else -y


def signum(y):
    numbers(y)
    if y.dtype.kind == "c":
        m = np.abs(y)
        return np.where(m == 0, 0, y / np.where(m == 0, 1, m))
    if y.dtype.kind == "O":
        return obj(((v > 0) - (v < 0) for v in y.ravel()), y.shape)
    return np.where(np.abs(y) < J_TOLERANCE, 0, np.sign(wide(plain(y)))).astype(np.int64) if y.dtype.kind == "f" else np.sign(wide(plain(y))).astype(np.int64)


def magnitude(y):
    numbers(y)
    return tidy(np.abs(wide(plain(y))))


def conjugate(y):
    numbers(y)
    return np.conj(y) if y.dtype.kind == "c" else y


def equal(x, y, tolerance: float = J_TOLERANCE, larger: bool = False) -> np.ndarray:
    """Tolerant equality; different kinds are never equal."""
    kx, ky = kind(x), kind(y)
    shape = np.broadcast_shapes(x.shape, y.shape)
    if not (is_number(x) and is_number(y)):
        if kx != ky or 0 in shape:
            return np.zeros(shape, bool)
        if kx == "box":
            return np.array([match(a.v, b.v, tolerance, larger) for a, b in zip(*(v.ravel() for v in np.broadcast_arrays(x, y)), strict=True)], bool).reshape(shape)
        return np.asarray(x == y, bool)
    if exact_pair(x, y) or x.dtype.kind in "bi" and y.dtype.kind in "bi":
        return np.asarray(x == y).astype(bool)
    x, y = to_float(x), to_float(y)
    with np.errstate(all="ignore"):
        size = (np.maximum if larger else np.minimum)(np.abs(x), np.abs(y))
        near = np.abs(x - y) < tolerance * size
        same_sign = np.ones(shape, bool) if "c" in (x.dtype.kind, y.dtype.kind) else np.sign(x) == np.sign(y)
        return (x == y) | (near & same_sign & np.isfinite(size))


def match(x, y, tolerance: float = J_TOLERANCE, larger: bool = False) -> bool:
    if x.shape != y.shape:
        return False
    return bool(np.all(equal(x, y, tolerance, larger))) if x.size else True


def _ordered(x, y):
    if x.size and y.size and kind(x) == kind(y) == "sym":
        return x, y
    for a in (x, y):
        if a.size and (not is_number(a) or a.dtype.kind == "c"):
            raise DomainError("only real numbers have an order here")
    return pair(x, y)


def less(x, y, **t):
    a, b = _ordered(x, y)
    return np.asarray(a < b, bool) & ~equal(x, y, **t)


def greater(x, y, **t):
    a, b = _ordered(x, y)
    return np.asarray(a > b, bool) & ~equal(x, y, **t)


def minimum(x, y):
    x, y = _ordered(x, y)
    return np.minimum(x, y)


def maximum(x, y):
    x, y = _ordered(x, y)
    return np.maximum(x, y)


def floor(y, tolerance: float = J_TOLERANCE):
    numbers(y)
    if y.dtype.kind in "bi":
        return wide(y)
    if y.dtype.kind == "O":
        return obj((math.floor(v) for v in y.ravel()), y.shape)
    if y.dtype.kind == "c":
        return complex_floor(y)
    near = np.round(y)
    with np.errstate(all="ignore"):
        out = np.where(np.abs(y - near) <= tolerance * np.maximum(1.0, np.abs(y)), near, np.floor(y))
    return out.astype(np.int64) if not out.size or np.abs(out).max() < 2.0**63 else out


def complex_floor(y: np.ndarray) -> np.ndarray:
    """The Gaussian integer below: the unit square's corner, moved where the remainders sum past one."""
    re, im = np.floor(y.real), np.floor(y.imag)
    fr, fi = y.real - re, y.imag - im
    over = fr + fi >= 1 - 1e-13
    return re + (over & (fr >= fi)) + 1j * (im + (over & (fr < fi)))


def ceiling(y, tolerance: float = J_TOLERANCE):
    return negate(floor(negate(y), tolerance))


def residue(x, y, tolerance: float = J_TOLERANCE):
    x, y = pair(x, y)
    if x.dtype.kind == "i" and y.dtype.kind == "i":
        with np.errstate(all="ignore"):
            return np.where(x == 0, y, np.mod(y, np.where(x == 0, 1, x)))
    if x.dtype.kind == "O":
        return tidy(obj((b if a == 0 else b - a * math.floor(Fraction(b) / Fraction(a)) for a, b in zip(*(v.ravel() for v in np.broadcast_arrays(x, y)), strict=True)), np.broadcast_shapes(x.shape, y.shape)))
    if "c" in (x.dtype.kind, y.dtype.kind):
        with np.errstate(all="ignore"):
            q = complex_floor(y / np.where(x == 0, 1, x))
        return np.where(x == 0, y, y - x * q)
    with np.errstate(all="ignore"):
        q = y / np.where(x == 0, 1.0, x)
        near = np.round(q)
        whole = np.abs(q - near) <= tolerance * np.maximum(1.0, np.abs(q))
        out = np.where(whole & np.isfinite(q), 0.0, y - x * np.floor(q))
        if np.any(np.isinf(y) & (x != 0)):
            raise NanError("the residue of an infinite number")
        far = np.isinf(x) & np.isfinite(y)
        out = np.where(far, np.where((y == 0) | (np.sign(y) == np.sign(x)), y, x), out)
    return np.where(x == 0, y, out)


def gcd(x, y):
    x, y = pair(x, y)
    if x.dtype.kind == "i" and y.dtype.kind == "i":
        return np.gcd(x, y)
    if x.dtype.kind == "O":
        return tidy(obj((_gcd(Fraction(a), Fraction(b)) for a, b in zip(*(v.ravel() for v in np.broadcast_arrays(x, y)), strict=True)), np.broadcast_shapes(x.shape, y.shape)))
    xs, ys = (v.astype(complex if "c" in (x.dtype.kind, y.dtype.kind) else float) for v in np.broadcast_arrays(x, y))
    out = xs.copy().ravel()
    for i, (a, b) in enumerate(zip(xs.ravel(), ys.ravel(), strict=True)):
        scale = max(abs(a), abs(b), 1.0)
        for _ in range(200):
            if abs(a) <= 1e-9 * scale:
                break
            a, b = residue(np.asarray(a), np.asarray(b))[()], a
        out[i] = abs(b) if out.dtype.kind == "f" else _first_quadrant(b)
    return out.reshape(xs.shape)


def _first_quadrant(b: complex) -> complex:
    while b and not (b.real > 0 and b.imag >= 0):
        b *= 1j
    return b


def _gcd(a: Fraction, b: Fraction) -> Fraction:
    d = a.denominator * b.denominator // math.gcd(a.denominator, b.denominator)
    return Fraction(math.gcd(int(a * d), int(b * d)), d)


def lcm(x, y):
    g = gcd(x, y)
    product = multiply(x, y)
    if g.dtype.kind == "i":
        return multiply(x, np.where(g == 0, 0, wide(y) // np.where(g == 0, 1, g)))
    return np.where(np.asarray(g == 0), 0, divide(product, np.where(np.asarray(g == 0), 1, g)))


def bits(*arrays):
    for a in arrays:
        if a.size and (not is_number(a) or not np.all((a == 0) | (a == 1))):
            raise DomainError("zeros and ones are wanted")


def nand(x, y):
    bits(x, y)
    return ~((x != 0) & (y != 0))


def nor(x, y):
    bits(x, y)
    return ~((x != 0) | (y != 0))


def gamma1(v: float) -> float:
    """Factorial of a real number."""
    if math.isnan(v) or math.isinf(v):
        return math.inf if v == v and v > 0 else v if v != v else math.inf
    if v == math.floor(v) and v < 0:
        return math.inf if v % 2 else -math.inf
    try:
        return math.gamma(v + 1)
    except OverflowError:
        return math.inf


def factorial(y, apl: bool = False):
    numbers(y)
    if y.dtype.kind == "c":
        raise NotYet("factorial of a complex number")
    if y.dtype.kind == "O" and all(v.denominator == 1 and v >= 0 for v in y.ravel()):
        return obj((math.factorial(int(v)) for v in y.ravel()), y.shape)
    f = to_float(y)
    if apl and np.any((f < 0) & (f == np.floor(f))):
        raise DomainError("factorial of a negative whole number")
    return np.array([gamma1(v) for v in f.ravel()], float).reshape(f.shape)


def binomial(x, y):
    x, y = pair(x, y)
    if "c" in (x.dtype.kind, y.dtype.kind):
        raise NotYet("binomial of a complex number")
    if x.dtype.kind == "O" and all(v.denominator == 1 and v >= 0 for a in (x, y) for v in a.ravel()):
        return obj((math.comb(int(b), int(a)) for a, b in zip(*(v.ravel() for v in np.broadcast_arrays(x, y)), strict=True)), np.broadcast_shapes(x.shape, y.shape))

    def one(k: float, n: float) -> float:
        if math.isnan(k) or math.isnan(n):
            return math.nan
        if math.isinf(k):
            return 0.0
        if math.isinf(n):
            return 0.0 if k < 0 else 1.0 if k == 0 else n
        whole = k == math.floor(k) and n == math.floor(n)
        if whole:
            if n >= 0:
                return float(math.comb(int(n), int(k))) if 0 <= k <= n else 0.0
            if k >= 0:
                return (-1.0) ** k * math.comb(int(k - n - 1), int(k))
            return (-1.0) ** (n - k) * math.comb(int(-k - 1), int(n - k)) if k <= n else 0.0
        if k == math.floor(k) and k < 0 or n - k == math.floor(n - k) and n - k < 0:
            return 0.0
        return gamma1(n) / (gamma1(k) * gamma1(n - k))

    xs, ys = np.broadcast_arrays(to_float(x), to_float(y))
    out = np.array([one(a, b) for a, b in zip(xs.ravel(), ys.ravel(), strict=True)], float).reshape(xs.shape)
    if x.dtype.kind in "bi" and y.dtype.kind in "bi" and np.all(np.abs(out) < 2**53):
        return out.astype(np.int64)
    return out


#: The circle functions by number (fixed meanings).
CIRCLE = {
    0: lambda y: np.sqrt(1 - y * y + 0), 1: np.sin, 2: np.cos, 3: np.tan, 4: lambda y: np.sqrt(1 + y * y), 5: np.sinh, 6: np.cosh, 7: np.tanh,
    8: lambda y: np.sqrt(-1 - y * y + 0j), 9: np.real, 10: np.abs, 11: np.imag, 12: np.angle,
    -1: np.arcsin, -2: np.arccos, -3: np.arctan, -4: lambda y: np.where(y == -1, 0, (y + 1) * np.sqrt((y - 1) / np.where(y == -1, 1, y + 1))), -5: np.arcsinh, -6: np.arccosh, -7: np.arctanh,
    -8: lambda y: -np.sqrt(-1 - y * y + 0j), -9: lambda y: y, -10: np.conj, -11: lambda y: y * 1j, -12: lambda y: np.exp(y * 1j),
}


def circle(x, y):
    numbers(x, y)
    xs, ys = np.broadcast_arrays(x, to_float(y))
    out = []
    for k, v in zip(xs.ravel(), ys.ravel(), strict=True):
        if k not in CIRCLE:
            raise DomainError("a circle function is numbered -12 to 12")
        f = CIRCLE[int(k)]
        with np.errstate(all="ignore"):
            r = f(np.asarray(v))
            if np.isrealobj(r) and np.isnan(r) and not np.isnan(v) and not (np.isinf(v) and k in (1, 2, 3)):
                r = f(np.asarray(complex(v)))
        if np.iscomplexobj(r) and r.imag == 0 and k not in (-11, -12):
            r = r.real
        out.append(r[()] if isinstance(r, np.ndarray) else r)
    return np.array(out).reshape(xs.shape) if out else np.zeros(xs.shape)


def to_exact(y):
    """Integers as they are, other numbers as the simplest rational within tolerance."""
    numbers(y)
    if y.dtype.kind == "O":
        return y
    if y.dtype.kind in "bi":
        return exact_cast(y)
    if y.dtype.kind == "c":
        raise DomainError("a complex number has no exact form")
    return tidy(obj((simplest(float(v)) for v in y.ravel()), y.shape))


def simplest(v: float) -> Fraction:
    if not math.isfinite(v):
        raise DomainError("an infinite number has no exact form")
    target, whole = Fraction(v), []
    x = target
    for _ in range(64):
        a = math.floor(x)
        whole.append(a)
        q = Fraction(whole[-1])
        for w in reversed(whole[:-1]):
            q = w + 1 / q
        if abs(float(q) - v) <= 2.0**-44 * abs(v) * 0.6 or x == a:
            return q
        x = 1 / (x - a)
    return target


def boolean(code: int, x, y):
    """One of sixteen truth tables, or from 16 on the same on every bit of integers."""
    table = [(code >> (3 - i)) & 1 for i in range(4)]
    if code < 16:
        bits(x, y)
        return np.array(table, bool)[(2 * wide(x) + wide(y)).astype(int)]
    table = [((code - 16) >> (3 - i)) & 1 for i in range(4)]
    x, y = np.broadcast_arrays(wide(x), wide(y))
    if x.dtype.kind != "i" or y.dtype.kind != "i":
        raise DomainError("whole numbers are wanted")
    out = np.zeros_like(x)
    for hit, term in zip(table, (~x & ~y, ~x & y, x & ~y, x & y), strict=True):
        if hit:
            out = out | term
    return out
