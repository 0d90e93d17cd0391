"""Scalar verbs as Column expressions, with the language's rules where Spark's differ."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import NotYet

J_TOLERANCE, APL_TOLERANCE = 2.0**-44, 1e-13


def inf() -> Column:
    return F.lit(float("inf"))


def is_float(t: str) -> bool:
    return t in ("double", "float")


def number(c: Column, t: str) -> Column:
    return c.cast("long") if t == "boolean" else c


def equal(a: Column, b: Column, ta: str, tb: str, apl: bool, tolerance: float | None = None) -> Column:
    if ta == tb == "string" or not (is_float(ta) or is_float(tb)):
        if (ta == "string") != (tb == "string"):
            return F.lit(False)
        return number(a, ta) == number(b, tb)
    a, b = number(a, ta).cast("double"), number(b, tb).cast("double")
    size = (F.greatest if apl else F.least)(F.abs(a), F.abs(b))
    near = F.abs(a - b) < (tolerance if tolerance is not None else APL_TOLERANCE if apl else J_TOLERANCE) * size
    return F.when(F.isnan(a) | F.isnan(b), False).otherwise((a == b) | (near & (F.signum(a) == F.signum(b)) & (size < inf())))


def divide(a: Column, b: Column, apl: bool) -> Column:
    a, b = a.cast("double"), b.cast("double")
    zero = F.when(a == 0, 1.0).otherwise(refused("division by zero")) if apl else F.when(a == 0, 0.0).otherwise(F.signum(a) * inf())
    return F.when(b == 0, zero).otherwise(a / b)


def residue(a: Column, b: Column, floats: bool) -> Column:
    if not floats:
        return F.when(a == 0, b).otherwise(F.expr("0") + (((b % a) + a) % a))
    quotient = b / a
    whole = F.abs(quotient - F.rint(quotient)) <= J_TOLERANCE * F.greatest(F.lit(1.0), F.abs(quotient))
    return F.when(a == 0, b).otherwise(F.when(whole, 0.0).otherwise(b - a * F.floor(quotient)))


def floor(c: Column, t: str, up: bool = False) -> Column:
    if not is_float(t):
        return number(c, t)
    near = F.rint(c)
    f = F.ceil(c) if up else F.floor(c)
    return F.when(F.abs(c - near) <= J_TOLERANCE * F.greatest(F.lit(1.0), F.abs(c)), near.cast("long")).otherwise(f)


def gcd(a: Column, b: Column) -> Column:
    """Euclid's algorithm, as many steps as 64-bit numbers can take."""
    start = F.struct(F.abs(a).alias("a"), F.abs(b).alias("b"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, F.lit(0).cast("long")).otherwise(s["a"] % F.when(s["b"] == 0, 1).otherwise(s["b"])).alias("b")))
    return done["a"]


def refused(why: str, t: str = "double") -> Column:
    return F.raise_error(F.lit(f"domain error: {why}")).cast(t)


def ln(c: Column, apl: bool) -> Column:
    zero = refused("logarithm of zero") if apl else -inf()
    return F.when(c == 0, zero).when(c < 0, refused("logarithm of a negative number")).otherwise(F.ln(c))


def power(a: Column, b: Column) -> Column:
    """Java's power, but for complex results, which are refused, and for one to any power."""
    return F.when(a == 1, 1.0).when((a < 0) & (b != F.rint(b)) & (F.abs(b) < inf()), refused("power of a negative number that is complex")).otherwise(F.pow(a, b))


def within(c: Column, ok: Column, value: Column) -> Column:
    return F.when(ok | F.isnan(c), value).otherwise(refused("circle function whose result is complex"))


def unit_angle(c: Column) -> Column:
    """The angle of the unit number at angle c: c itself up to half a turn, as sine and cosine would lose its last digits."""
    return F.when(F.abs(c) <= math.pi, c).otherwise(F.atan2(F.sin(c), F.cos(c)))


CIRCLE = {
    0: lambda c: within(c, F.abs(c) <= 1, F.sqrt(1 - c * c)), 1: F.sin, 2: F.cos, 3: F.tan, 4: lambda c: F.sqrt(1 + c * c), 5: F.sinh, 6: F.cosh, 7: F.tanh, 9: lambda c: c, 10: F.abs, 11: lambda c: c * 0,
    12: lambda c: F.when(c < 0, math.pi).otherwise(0.0), -1: lambda c: within(c, F.abs(c) <= 1, F.asin(c)), -2: lambda c: within(c, F.abs(c) <= 1, F.acos(c)), -3: F.atan,
    -4: lambda c: F.when(c == -1, 0.0).otherwise(within(c, F.abs(c) >= 1, (c + 1) * F.sqrt((c - 1) / (c + 1)))), -5: F.asinh, -6: lambda c: within(c, c >= 1, F.acosh(c)), -7: lambda c: within(c, F.abs(c) <= 1, F.atanh(c)), -9: lambda c: c, -10: lambda c: c,
}
#: Spellings of both notations, by what they do.
ONE = {
    "+": "same", "-": "negate", "*": "signum", "×": "signum", "%": "reciprocal", "÷": "reciprocal", "^": "exp", "⋆": "exp", "^.": "ln", "⍟": "ln", "%:": "sqrt", "|": "abs", "<.": "floor", "⌊": "floor", ">.": "ceil", "⌈": "ceil",
    "<:": "dec", ">:": "inc", "+:": "double", "*:": "square", "-:": "halve", "-.": "oneminus", "~": "not", "!": "factorial", "o.": "pi", "○": "pi", "]": "same", "[": "same", "⊢": "same", "⊣": "same", '":': "format", "⍕": "format", "⌷": "same",
}
TWO = {
    "+": "plus", "-": "minus", "*": "times", "×": "times", "%": "divide", "÷": "divide", "^": "power", "⋆": "power", "^.": "log", "⍟": "log", "%:": "root", "|": "residue", "<.": "min", "⌊": "min", ">.": "max", "⌈": "max",
    "=": "eq", "<": "lt", ">": "gt", "~:": "ne", "≠": "ne", "<:": "le", "≤": "le", ">:": "ge", "≥": "ge", "+:": "nor", "⍱": "nor", "*:": "nand", "⍲": "nand", "+.": "gcd", "∨": "gcd", "*.": "lcm", "∧": "lcm", "!": "binomial", "o.": "circle", "○": "circle",
}
#: APL's star is the exponential, J's the product: the APL front end names it by the other star.
APL_NAMES = frozenset("×÷⋆⍟⌊⌈~○⊢⊣⍕⌷≠≤≥⍱⍲∨∧")


def monad(name: str, c: Column, t: str, apl: bool) -> Column:
    what = ONE[name]
    n = number(c, t)
    d = n.cast("double") if t != "string" else c
    if what == "same":
        return c
    if what == "negate":
        return -n
    if what == "signum":
        return F.signum(n).cast("long")
    if what == "reciprocal":
        return divide(F.lit(1.0), d, apl)
    if what == "exp":
        return F.exp(d)
    if what == "ln":
        return ln(d, apl)
    if what == "sqrt":
        return F.when(d < 0, refused("root of a negative number")).otherwise(F.sqrt(d))
    if what == "abs":
        return F.abs(n)
    if what in ("floor", "ceil"):
        return floor(c, t, what == "ceil")
    if what == "not":
        return ~c if t == "boolean" else 1 - n
    if what == "factorial":
        if is_float(t):
            raise NotYet("the factorial of a distributed float")
        table = F.array(*[F.lit(math.gamma(k + 1.0)) for k in range(171)])
        return F.when(n < 0, inf()).when(n > 170, inf()).otherwise(F.get(table, n.cast("int")))
    if what == "format":
        return c.cast("string")
    return {"dec": n - 1, "inc": n + 1, "double": n * 2, "square": n * n, "halve": d / 2, "oneminus": 1 - n, "pi": F.lit(math.pi) * d}[what]


def dyad(name: str, a: Column, b: Column, ta: str, tb: str, apl: bool, left=None, tolerance: float | None = None) -> Column:
    what = TWO[name]
    x, y = number(a, ta), number(b, tb)
    floats = is_float(ta) or is_float(tb)
    if what == "plus":
        return x + y
    if what == "minus":
        return x - y
    if what == "times":
        return F.when((x == 0) | (y == 0), F.lit(0.0)).otherwise(x * y) if floats else x * y
    if what == "divide":
        return divide(x, y, apl)
    if what == "power":
        return power(x.cast("double"), y.cast("double"))
    if what == "log":
        return divide(ln(y.cast("double"), apl), ln(x.cast("double"), apl), apl)
    if what == "root":
        return power(y.cast("double"), divide(F.lit(1.0), x, apl))
    if what == "residue":
        return residue(x, y, floats)
    if what in ("min", "max"):
        return (F.least if what == "min" else F.greatest)(x, y)
    if what in ("eq", "ne", "lt", "gt", "le", "ge"):
        same = equal(a, b, ta, tb, apl, tolerance)
        if what in ("eq", "ne"):
            return same if what == "eq" else ~same
        if ta == "string" or tb == "string":
            return {"lt": a < b, "gt": a > b, "le": a <= b, "ge": a >= b}[what]
        if not floats:
            return {"lt": x < y, "gt": x > y, "le": x <= y, "ge": x >= y}[what]
        return {"lt": (x < y) & ~same, "gt": (x > y) & ~same, "le": (x < y) | same, "ge": (x > y) | same}[what]
    if what in ("nor", "nand"):
        p, r = x.cast("boolean"), y.cast("boolean")
        out = ~(p | r) if what == "nor" else ~(p & r)
        for c, t in ((x, ta), (y, tb)):
            if t != "boolean":
                out = F.when((c != 0) & (c != 1), refused("logic of other numbers than 0 and 1", "boolean")).otherwise(out)
        return out
    if what in ("gcd", "lcm"):
        if ta == tb == "boolean":
            return a | b if what == "gcd" else a & b
        if floats:
            raise NotYet("divisors of distributed floats")
        g = gcd(x.cast("long"), y.cast("long"))
        return g if what == "gcd" else F.when(g == 0, F.lit(0).cast("long")).otherwise(x * (y / F.when(g == 0, 1).otherwise(g)).cast("long"))
    if what == "circle":
        if left is None or int(left) not in CIRCLE:
            raise NotYet("this circle function of a distributed value")
        return CIRCLE[int(left)](y.cast("double"))
    raise NotYet(f"{name} of distributed values")
