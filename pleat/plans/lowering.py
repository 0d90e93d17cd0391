"""How verbs on distributed values become DataFrame plans."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DomainError, LanguageError, LengthError, NotYet
from ..operators.verb import Distributed, Verb
from ..values import Box, frame_up, ints, kind, obj
from . import rows, scalars
from .blocks import affine, scan, spread
from .values import POS, Frame, GroupFrame, Mat, Runs, RunScalar, Scalar, Table, Tuple, Vec, _sentence, _session, checkpointed, fresh, q

__all__ = ["Table", "monad", "dyad", "reduce", "prefix", "suffix", "infix", "outfix", "key", "cut", "table", "inner", "ranked", "oblique", "amend", "agenda", "each", "shift", "take", "same", "settle", "gather", "first_atom", "table"]

#: Folds by verb: aggregate of blocks.FOLDS, and what an empty argument gives.
FOLD = {"+": ("sum", 0), "*": ("product", 1.0), "×": ("product", 1.0), "<.": ("min", float("inf")), "⌊": ("min", float("inf")), ">.": ("max", float("-inf")), "⌈": ("max", float("-inf")), "+.": ("max", False), "∨": ("max", False), "*.": ("min", True), "∧": ("min", True)}
COMPARED = {"=", "<", ">", "~:", "≠", "<:", "≤", ">:", "≥", "+:", "⍱", "*:", "⍲"}


def apl_of(v: Verb) -> bool:
    return bool(v.extra.get("apl"))


def lit(a) -> Column:
    v = a[()] if isinstance(a, np.ndarray) and a.ndim == 0 else np.ravel(a)[0]
    return value_of(v)


def value_of(v) -> Column:
    v = v.item() if isinstance(v, np.generic) else v
    return F.lit(v).cast("long") if isinstance(v, int) and not isinstance(v, bool) else F.lit(v)


def lit_type(a) -> str:
    k = np.asarray(a).dtype.kind
    if k == "O":
        raise NotYet("exact numbers, symbols and boxes beside distributed values")
    if k == "c":
        raise NotYet("complex numbers beside distributed values")
    return {"b": "boolean", "i": "bigint", "f": "double", "U": "string"}[k]


def text_of(a) -> np.ndarray:
    """A character list beside a string column is one string."""
    return np.asarray("".join(np.ravel(a).tolist()), dtype=object) if kind(a) == "char" and a.ndim == 1 else a


def type_of(v) -> str:
    if isinstance(v, Vec):
        return v.type.simpleString()
    if isinstance(v, Scalar):
        if not hasattr(v, "_t"):
            v._t = v.to_df().schema[0].dataType.simpleString()
        return v._t
    if isinstance(v, Mat):
        if not hasattr(v, "_t"):
            c = v.cols[0] if v.cols is not None else F.get(v.cell, F.lit(0))
            v._t = v.frame.df.select(c.alias("v")).schema[0].dataType.simpleString()
        return v._t
    if isinstance(v, (Runs, RunScalar)):
        return "double"
    if isinstance(v, Tuple):
        return type_of(v.parts[0])
    a = text_of(v)
    return "string" if a.dtype.kind == "O" and isinstance(a[()], str) else lit_type(a)


# one argument


def monad(v: Verb, y):
    name = v.name
    if v.node == "TruthTable" or v.node not in ("Prim", "Fit"):
        raise NotYet(f"{name} of a distributed value")
    if isinstance(y, (Runs, RunScalar)):
        return run_monad(v, y)
    if name in ("#", "≢"):
        return tally(y)
    if name in ("$", "⍴") and isinstance(y, (Vec, Scalar)):
        return tally(y)
    if isinstance(y, Tuple):
        return Tuple([monad(v, p) for p in y.parts])
    if name in ("]", "[", "⊢", "⊣", "⌷") or (name in ("+",)):
        return y
    if name in ("{.", "{:", "↑") and isinstance(y, Vec):
        y = y.trimmed()
        by = F.min_by if name != "{:" else F.max_by
        return Scalar(y.frame, by(y.col, order_key(y.frame)))
    if isinstance(y, Vec) and rows.is_complex(type_of(y)):
        return itemwise(v, [y])
    if isinstance(y, Vec):
        if name in ("p:", "q:", "j.", "r.") or name == "!" and scalars.is_float(type_of(y)):
            out = itemwise(v, [y])
            if name == "r.":
                out.angle = scalars.unit_angle(scalars.number(y.col, type_of(y)).cast("double"))
            return out
        if name == "+." or name == "*.":
            d = scalars.number(y.col, type_of(y)).cast("double")
            parts = [d, F.lit(0.0)] if name == "+." else [F.abs(d), F.when(d < 0, float(np.pi)).otherwise(0.0)]
            return Mat(y.trimmed().frame, parts)
        if name == ",:":
            return Mat(y.trimmed().frame, [y.col], None, turned=True)
        if name == '":' or name == "⍕":
            minus = "¯" if name == "⍕" else "_"
            if type_of(y) != "string":
                return Vec(y.frame, rows.by_value(_shown(minus), "string", y.col), y.front, y.back)
            return y
        if name in ("}.", "}:"):
            return Vec(y.frame.dense(), y.col, y.front + (name == "}."), y.back + (name == "}:"))
        boxes = y.type.simpleString().startswith("array")
        if name in (",", ";", "∊") and not boxes:
            return y
        if name in (";", "∊") and boxes:
            return raze(y)
        if name in (">", "⊃") and boxes:
            return open_boxes(y)
        if name == "L.":
            return np.asarray(int(boxes))
        if name == "3!:0":
            return np.asarray({"boolean": 1, "bigint": 4, "double": 8, "string": 2}.get(type_of(y), 32 if boxes else 16))
        if name in ("|.", "⌽", "⊖"):
            p = y.placed()
            pos = F.col(q(p.frame.pos))
            return Vec(Frame(p.frame.df.withColumn(p.frame.pos, p.frame.count() - 1 - pos), [], p.frame.pos), p.col)
        if name in ("~.", "∪"):
            return nub(y)
        if name in ("~:", "≠"):
            return nub_sieve(y)
        if name in ("/:", "\\:", "⍋", "⍒"):
            return grade(y, name in ("\\:", "⍒"), v.extra.get("origin", 0))
        if name in ("I.", "⍸"):
            return indices(y, v.extra.get("origin", 0))
        if name == ";:" and y.type.simpleString() == "string":
            return Vec(y.frame, rows.by_value(_words, "array<string>", y.col), y.front, y.back)
        if name == "u:" and y.type.simpleString() == "bigint":
            return Vec(y.frame, rows.by_value(chr, "string", y.col), y.front, y.back)
        if name in ("s:", "$."):
            return y
        if name == '".':
            return Vec(y.frame, y.col.try_cast("double"), y.front, y.back)
        if name == "#:":
            return bits(y)
        if name in ("?", "?."):
            seed = 16807 if name == "?." else None
            n = y.col.cast("long")
            bad = F.raise_error(F.lit("domain error: a roll of no whole number above 0")).cast("long")
            drawn = F.floor((F.rand(seed) if seed else F.rand()) * n) + v.extra.get("origin", 0)
            return Vec(y.frame, F.when((n <= 0) | (n != y.col), bad).otherwise(drawn), y.front, y.back)
        if name in ("p..",):
            raise NotYet("the derivative of a distributed polynomial")
    if isinstance(y, Mat):
        if name in ("|:", "⍉"):
            return Mat(y.frame, y.cols, y.cell, not y.turned)
        if name in (",",):
            return ravel(y)
        if name in ("#.",):
            return Vec(y.frame, base(F.lit(2), y))
        if name in ("{.", "}."):
            raise NotYet(f"{name} of a distributed matrix")
    if name in scalars.ONE:
        t, apl = type_of(y), apl_of(v)
        f = lambda c: scalars.monad(name, c, t, apl)
        if isinstance(y, Vec):
            return Vec(y.frame, f(y.col), y.front, y.back)
        if isinstance(y, Scalar):
            return Scalar(y.frame, f(y.col))
        if isinstance(y, Mat):
            return y.map(f)
    raise NotYet(f"{name} of a distributed {type(y).__name__.lower()}")


def _shown(minus: str):
    from ..functions.text import show_number

    return lambda x: show_number(x, 6 if minus == "_" else 10, minus)


def _words(line: str) -> list[str]:
    from ..functions.text import word_spans

    return [w for w, _ in word_spans(line) if w != "\n"]


def itemwise(v: Verb, args: list):
    """A verb of rank 0 by the local evaluator, on vectors and local atoms."""
    vecs = [a for a in args if isinstance(a, Vec)]
    if len(vecs) == 2:
        vecs = list(align(*vecs))
    fixed = {k: np.asarray(a) for k, a in enumerate(args) if not isinstance(a, Vec)}
    if any(isinstance(a, Distributed) or a.ndim for a in fixed.values()):
        raise NotYet(f"{v} of a vector beside this argument")
    host = vecs[0]
    col, t, width = rows.by_item(v, [a.col for a in vecs], [type_of(a) for a in vecs], fixed)
    if not width:
        return Vec(host.frame, col, host.front, host.back)
    if width < 0:
        return Mat(host.trimmed().frame, None, col)
    cell = fresh("cell")
    f = host.trimmed().frame
    g = Frame(f.df.withColumn(cell, col), f.order, f.pos, f if f.pos else None)
    return Mat(g, [F.get(F.col(cell), F.lit(k)) for k in range(width)])


def raze(y: Vec) -> Vec:
    """The items of all boxes, in order."""
    p = y.placed()
    i, v = fresh("i"), fresh("v")
    df = p.frame.df.select(F.col(q(p.frame.pos)).alias(POS), F.posexplode(p.col).alias(i, v))
    return Vec(Frame(df, [F.col(POS), F.col(i)]), F.col(v))


def open_boxes(y: Vec) -> Mat:
    """The boxes as rows, short ones filled to the length of the longest."""
    t = y.trimmed()
    most, own = fresh("most"), fresh("own")
    longest = t.frame.df.agg(F.max(F.size(t.col)).alias("n")).scalar()
    item = t.type.elementType
    blank = (F.lit(" ") if isinstance(item, T.StringType) else F.lit(0)).cast(item)
    g = Frame(t.frame.df.withColumn(most, longest).withColumn(own, t.col), t.frame.order, t.frame.pos, t.frame if t.frame.pos else None)
    more = F.array_repeat(blank, F.col(most) - F.size(own))
    return Mat(g, None, F.concat(F.col(own), more))


def order_key(f: Frame) -> Column:
    """What min_by and max_by compare: the position, or the order as a struct."""
    if f.pos:
        return F.col(q(f.pos))
    if f.order and not any(" NULLS " in str(c) for c in f.order):
        return f.order[0] if len(f.order) == 1 else F.struct(*f.order)
    raise NotYet("the first item by descending columns; give a position column")


def tally(y):
    if isinstance(y, Vec):
        y = y.trimmed()
        return Scalar(y.frame, F.count(F.lit(1)))
    if isinstance(y, Mat):
        if y.turned:
            return np.asarray(len(y.columns()))
        return Scalar(y.frame, F.count(F.lit(1)))
    return np.asarray(len(y.parts) if isinstance(y, Tuple) else 1)


def alike(c: Column, t: str) -> Column:
    """What equal items share: floats are equal within a tolerance, so they are rounded to 44 binary digits.

    Rounding parts two floats that lie that near to each other on either side of a step, about one pair
    of neighbouring floats in 256; tolerant equality itself cannot be a key, as it is not transitive.
    """
    if not scalars.is_float(t):
        return c
    scale = F.pow(F.lit(2.0), 44 - F.floor(F.log2(F.abs(c))))
    odd = (c == 0) | F.isnan(c) | (F.abs(c) == scalars.inf()) | (scale == scalars.inf())
    return F.when(odd, c + 0.0).otherwise(F.rint(c * scale) / scale)


def nub(y: Vec) -> Vec:
    p = y.placed()
    first, name, k = fresh("first"), fresh("v"), fresh("k")
    pos = F.col(q(p.frame.pos))
    t = type_of(p)
    if scalars.is_float(t):
        df = p.frame.df.groupBy(alike(p.col, t).alias(k)).agg(F.min(pos).alias(first), F.min_by(p.col, pos).alias(name))
    else:
        df = p.frame.df.groupBy(p.col.alias(name)).agg(F.min(pos).alias(first))
    return Vec(Frame(df, [F.col(first)]), F.col(name))


def nub_sieve(y: Vec) -> Vec:
    p = y.placed()
    first, name, k = fresh("first"), fresh("v"), fresh("k")
    df = p.frame.df.withColumn(name, alike(p.col, type_of(p)))
    heads = df.groupBy(F.col(name).alias(k)).agg(F.min(q(p.frame.pos)).alias(first))
    joined = df.join(heads, F.col(name).eqNullSafe(F.col(k))).drop(k)
    return Vec(Frame(joined, [], p.frame.pos, p.frame), F.col(first) == F.col(q(p.frame.pos)))


def grade(y: Vec, down: bool, origin: int = 0) -> Vec:
    p = y.placed()
    k, at = fresh("k"), fresh("at")
    df = p.frame.df.select(p.col.alias(k), (F.col(q(p.frame.pos)) + origin).alias(at))
    return Vec(Frame(df, [F.col(k).desc() if down else F.col(k).asc(), F.col(at).asc()]), F.col(at))


def indices(y: Vec, origin: int = 0) -> Vec:
    p = y.placed()
    at = fresh("at")
    pos = F.col(q(p.frame.pos)) + origin
    if y.type.simpleString() == "boolean":
        return Vec(Frame(p.frame.df.where(p.col).select(pos.alias(at)), [F.col(at)]), F.col(at))
    return Vec(Frame(p.frame.df.select(F.explode(F.array_repeat(pos, p.col.cast("int"))).alias(at)), [F.col(at)]), F.col(at))


def bits(y: Vec) -> Mat:
    """Base-2 digits; the width is that of the largest value, read once."""
    most = y.trimmed().frame.df.agg(F.max(F.abs(y.col))).first()[0] or 0
    width = max(1, int(most).bit_length())
    return Mat(y.frame, [F.shiftright(y.col, width - 1 - k).bitwiseAND(F.lit(1).cast("long")) for k in range(width)])


def ravel(y: Mat) -> Vec:
    f = y.frame.dense()
    cell = F.array(*y.cols) if y.cols is not None else y.cell
    i, v = fresh("i"), fresh("v")
    df = f.df.select(F.col(q(f.pos)).alias(POS), F.posexplode(cell).alias(i, v))
    return Vec(Frame(df, [F.col(POS), F.col(i)]), F.col(v))


def base(radix, y: Mat) -> Column:
    if y.cols is not None:
        out = F.lit(0)
        for c in y.cols:
            out = out * radix + c
        return out
    return F.aggregate(y.cell, F.lit(0.0), lambda a, b: a * radix + b)


# two arguments


def dyad(v: Verb, x, y):
    name = v.name
    if v.node == "TruthTable":
        return truth_table(v, x, y)
    if v.node == "Fit" and v.parts[0].name in scalars.TWO:  # another tolerance
        base_ = v.parts[0]
        return scalar_dyad(Verb(base_.name, None, None, extra={**base_.extra, "tolerance": float(np.ravel(v.parts[1])[0])}), x, y)
    if isinstance(x, (Runs, RunScalar)) or isinstance(y, (Runs, RunScalar)):
        return run_dyad(v, x, y)
    if name in ("[", "⊣"):
        return x
    if name in ("]", "⊢"):
        return y
    flat = all(isinstance(a, Vec) or isinstance(a, np.ndarray) and not a.ndim for a in (x, y))
    if flat and (name in scalars.TWO or name in ("j.", "r.")):
        if scalars.TWO.get(name) == "circle" and isinstance(x, np.ndarray) and x[()] == 12 and hasattr(y, "angle"):
            return Vec(y.frame, y.angle, y.front, y.back)
        if name in ("j.", "r.") or scalars.TWO.get(name) == "binomial" or any(isinstance(a, Vec) and rows.is_complex(type_of(a)) or isinstance(a, np.ndarray) and a.dtype.kind == "c" for a in (x, y)):
            return itemwise(v, [x, y])
        if scalars.TWO[name] == "circle" and isinstance(x, np.ndarray) and int(x) not in scalars.CIRCLE:
            return itemwise(v, [x, y])
    if name in ("\\", "⍀", "#^:_1"):
        return expand(x, y)
    if name == "⊂" and isinstance(x, Vec) and isinstance(y, Vec):
        return partition(x, y)
    if name == ",:" and isinstance(x, Vec) and isinstance(y, Vec):
        a, b = (c.trimmed() for c in align(x, y))
        return Mat(a.frame, [a.col, b.col], None, turned=True)
    if name in ("#", "/", "⌿") and v.node == "Prim" and isinstance(y, (Vec, Mat)):
        return copy(x, y)
    if isinstance(y, Vec) and not isinstance(x, Distributed):
        if name in ("{.", "↑"):
            return take(x, y)
        if name in ("}.", "↓"):
            k = int(ints(x))
            return Vec(y.frame.dense(), y.col, y.front + max(k, 0), y.back + max(-k, 0))
        if name in ("|.", "⌽", "⊖"):
            p = y.placed()
            pos = F.col(q(p.frame.pos))
            n = p.frame.count()
            return Vec(Frame(p.frame.df.withColumn(p.frame.pos, F.pmod(pos - int(ints(x)), n)), [], p.frame.pos), p.col)
        if name in ("E.", "⍷"):
            return find(x, y)
        if name in ("#.", "⊥") and not np.ndim(x):
            p = y.placed()
            worth = F.pow(lit(x).cast("double"), (p.frame.count() - 1 - F.col(q(p.frame.pos))).cast("double"))
            total = F.coalesce(F.sum(scalars.number(p.col, type_of(p)) * worth), F.lit(0.0))
            return Scalar(p.frame, total if scalars.is_float(type_of(p)) or lit_type(x) == "double" else total.cast("long"))
        if name in ("#:", "⊤"):
            return digits(x, y)
        if name == "p.":
            out = F.lit(0)
            for c in reversed(np.ravel(x).tolist()):
                out = out * y.col + F.lit(c)
            return Vec(y.frame, out, y.front, y.back)
        if name == "x:":
            return y
        if name == "$.":
            return sparse_form(int(ints(x)), y)
        if name == '".':
            return Vec(y.frame, F.coalesce(y.col.try_cast("double"), lit(x)), y.front, y.back)
        if name in ("$", "⍴") and kind(x) == "num":
            return reshape(x, y)
        if name == '":':
            spec = np.ravel(x)[0]
            w, digits_ = (int(spec.real), int(spec.imag)) if isinstance(spec, complex) or np.iscomplexobj(spec) else (int(spec), 0)
            shown = rows.by_value(f"{{:.{digits_}f}}".format, "string", y.col.cast("double"))
            return Vec(y.frame, F.when(F.length(shown) > w, F.lit("*" * w)).otherwise(F.lpad(shown, w, " ")) if w else shown, y.front, y.back)
    if name in ("{", "⌷") and isinstance(y, Vec):
        return pick(x, y)
    if name == "{" and isinstance(x, Vec):
        return from_literal(x, y)
    if name in ("i.", "⍳", "i:") and isinstance(x, (Vec, np.ndarray)):
        return index_of(x, y, name == "i:", v.extra.get("origin", 0))
    if name in ("e.", "∊"):
        return member(x, y)
    if name in ("-.", "~") or name == "∩":
        return less(x, y, name == "∩")
    if name == "∪":
        return append(x, less(y, x, False))
    if name in ("I.", "⍸"):
        return interval_index(x, y, name == "⍸", v.extra.get("origin", 0))
    if name in (",", "⍪") and (isinstance(x, Vec) or isinstance(y, Vec)):
        return append(x, y)
    if name in (",.",) and isinstance(x, Vec) and isinstance(y, Vec):
        a, b = align(x, y)
        return Mat(a.frame, [a.col, b.col])
    if name in ("-:", "≡", "≢") and v.node == "Prim":
        return match(x, y, name == "≢", apl_of(v))
    if name in ("/:", "\\:") and isinstance(x, Vec) and isinstance(y, Vec):
        a, b = align(x, y)
        f = a.frame.dense()
        k = fresh("k")
        return Vec(Frame(f.df.withColumn(k, b.col), [F.col(k).desc() if name == "\\:" else F.col(k).asc(), F.col(q(f.pos)).asc()]), a.col)
    if name in ("%.", "⌹"):
        return least_squares(x, y)
    if name in ("#.", "⊥") and isinstance(y, Mat):
        return Vec(y.frame, base(lit(x), y))
    if name in scalars.TWO:
        return scalar_dyad(v, x, y)
    raise NotYet(f"{name} of distributed values")


def scalar_dyad(v: Verb, x, y):
    name, apl = v.name, apl_of(v)

    def f(a, b, ta, tb, left=None):
        return scalars.dyad(name, a, b, ta, tb, apl, left, v.extra.get("tolerance"))

    if isinstance(x, Tuple) or isinstance(y, Tuple):
        if isinstance(x, Tuple) and isinstance(y, Tuple):
            if len(x.parts) != len(y.parts):
                raise LengthError("short vectors of different lengths")
            return Tuple([scalar_dyad(v, a, b) for a, b in zip(x.parts, y.parts, strict=True)])
        if isinstance(y, (Mat, Vec)) or isinstance(x, (Mat, Vec)):
            raise NotYet("a short vector beside a matrix; name the axis with rank 1")
        return Tuple([scalar_dyad(v, a, y) for a in x.parts]) if isinstance(x, Tuple) else Tuple([scalar_dyad(v, x, b) for b in y.parts])
    tx, ty = type_of(x), type_of(y)
    left = None if isinstance(x, Distributed) else np.ravel(x)[0]
    for a in (x, y):
        if isinstance(a, np.ndarray) and a.ndim and kind(a) != "char" and a.size != 1 and not isinstance(x, Mat) and not isinstance(y, Mat):
            raise NotYet("a local list beside a distributed vector")
    if isinstance(x, Mat) or isinstance(y, Mat):
        return matrix_dyad(f, x, y, tx, ty, left)
    if isinstance(x, Vec) and isinstance(y, Vec):
        a, b = align(x, y)
        out = Vec(a.frame, f(a.col, b.col, tx, ty), a.front, a.back)
        if hasattr(x, "keys") and isinstance(a.frame, GroupFrame):
            out.keys = x.keys
        return out
    if isinstance(x, Vec):
        return Vec(x.frame, f(x.col, y.inline() if isinstance(y, Scalar) else lit(text_of(y)), tx, ty), x.front, x.back)
    if isinstance(y, Vec):
        return Vec(y.frame, f(x.inline() if isinstance(x, Scalar) else lit(text_of(x)), y.col, tx, ty, left), y.front, y.back)
    if isinstance(x, Scalar) and isinstance(y, Scalar):
        if x.frame is y.frame and x.frame is not None:
            return Scalar(x.frame, f(x.col, y.col, tx, ty))
        return Scalar(None, f(x.inline(), y.inline(), tx, ty))
    if isinstance(x, Scalar):
        return Scalar(x.frame, f(x.col, lit(text_of(y)), tx, ty))
    return Scalar(y.frame, f(lit(text_of(x)), y.col, tx, ty, left))


def matrix_dyad(f, x, y, tx, ty, left):
    m = x if isinstance(x, Mat) else y
    other = y if m is x else x
    swap = m is not x
    call = (lambda c, o, to: f(o, c, to, type_of(m))) if swap else (lambda c, o, to: f(c, o, type_of(m), to))
    if isinstance(other, Mat):
        if other.frame is not m.frame:
            raise NotYet("matrices of different tables")
        if m.cols is not None and other.cols is not None:
            return Mat(m.frame, [call(a, b, type_of(other)) for a, b in zip(m.cols, other.cols, strict=True)])
        return Mat(m.frame, None, F.zip_with(m.cell, other.cell, lambda a, b: call(a, b, type_of(other))))
    if isinstance(other, Vec):
        if other.frame is not m.frame:
            raise NotYet("a vector and a matrix of different tables")
        return m.map(lambda c: call(c, other.col, type_of(other)))
    if isinstance(other, Scalar):
        o = other.inline()
        return m.map(lambda c: call(c, o, type_of(other)))
    if other.ndim == 0:
        return m.map(lambda c: call(c, lit(other), lit_type(other)))
    raise NotYet("a local list beside a distributed matrix")


def align(x: Vec, y: Vec) -> tuple[Vec, Vec]:
    """Both on one frame and at the same rows: as they are, by a shifted column, or by a join on positions."""
    if x.frame is not y.frame:
        if y.frame.extends(x.frame):
            x = Vec(y.frame, x.col, x.front, x.back)
        elif x.frame.extends(y.frame):
            y = Vec(x.frame, y.col, y.front, y.back)
    if x.frame is y.frame:
        if (x.front, x.back) == (y.front, y.back):
            return x, y
        if x.front + x.back == y.front + y.back:
            g = x.frame.dense().windows()
            s = y.front - x.front
            near = g.add((F.lead(y.col, s) if s > 0 else F.lag(y.col, -s)).over(g.window), max(0, -s), max(0, s))
            return Vec(g, x.col, x.front, x.back), Vec(g, near, x.front, x.back)
    a, b = x.placed(), y.placed()
    va, vb, pb = fresh("x"), fresh("y"), fresh("p")
    left = a.frame.df.select(F.col(q(a.frame.pos)).alias(POS), a.col.alias(va))
    right = b.frame.df.select(F.col(q(b.frame.pos)).alias(pb), b.col.alias(vb))
    joined = left.join(right, F.col(POS) == F.col(pb), "full_outer").where(F.assert_true(F.col(pb).isNotNull() & F.col(POS).isNotNull(), F.lit("length error: vectors of different lengths")).isNull())
    g = Frame(joined, [], POS)
    return Vec(g, F.col(va)), Vec(g, F.col(vb))


def truth_table(v: Verb, x, y):
    code = int(v.name.split()[0])
    a = x.col if isinstance(x, Vec) else lit(x)
    b = y.col if isinstance(y, Vec) else lit(y)
    if isinstance(x, Vec) and isinstance(y, Vec):
        x, y = align(x, y)
        a, b = x.col, y.col
    host = x if isinstance(x, Vec) else y
    table = [(code % 16 >> (3 - i)) & 1 for i in range(4)]
    if code < 16:
        p, r = a.cast("boolean"), b.cast("boolean")
        out = F.lit(False)
        for hit, term in zip(table, (~p & ~r, ~p & r, p & ~r, p & r), strict=True):
            out = out | term if hit else out
    else:
        n = F.bitwise_not
        out = F.lit(0).cast("long")
        for hit, term in zip(table, (n(a).bitwiseAND(n(b)), n(a).bitwiseAND(b), a.bitwiseAND(n(b)), a.bitwiseAND(b)), strict=True):
            out = out.bitwiseOR(term) if hit else out
    return Vec(host.frame, out, host.front, host.back)


def expand(x, y):
    """y's items where the mask x has ones, fill elsewhere: the n-th one takes the n-th item, by a join on that number."""
    if not isinstance(x, Vec) or not isinstance(y, Vec):
        raise NotYet("this expansion of distributed values")
    a, b = x.placed(), y.placed()
    run, name = scan(a.frame, flag(a).cast("long"), "sum")
    v, at = fresh("v"), fresh("at")
    right = b.frame.df.select((F.col(q(b.frame.pos)) + 1).alias(at), b.col.alias(v))
    total = Scalar(a.frame, F.coalesce(F.sum(flag(a).cast("long")), F.lit(0))).inline()
    fits = F.when(total != b.frame.count(), F.raise_error(F.lit("length error: as many items as ones are wanted")).cast("boolean")).otherwise(flag(a))
    joined = run.df.withColumn(name, F.when(fits, F.col(name))).join(right, F.col(name) == F.col(at), "left")
    blank = F.lit(" ") if isinstance(b.type, T.StringType) else F.lit(0)
    return Vec(Frame(joined, [], a.frame.pos, a.frame), F.coalesce(F.col(v), blank.cast(b.type)))


def partition(x: Vec, y: Vec) -> Vec:
    """Runs of y that begin where the flags x rise; zeros leave items out. Each run is a box, an array column."""
    a, b = (c.placed() for c in align(x, y))
    f = a.frame
    g = f.windows()
    before = g.add(F.lag(a.col, 1).over(g.window), 1, 0)
    n = scalars.number(a.col, type_of(a))
    rise = (n > 0) & (n > F.coalesce(scalars.number(before, type_of(a)), F.lit(0)))
    run, name = scan(g, rise.cast("long"), "sum")
    pos = F.col(q(f.pos))
    key_ = fresh("key")
    kept = run.df.where(n > 0).withColumn(key_, F.col(name) - 1)
    own = F.transform(F.array_sort(F.collect_list(F.struct(pos.alias("p"), b.col.alias("v")))), lambda s: s["v"])
    v = fresh("v")
    return Vec(Frame(kept.groupBy(key_).agg(own.alias(v)), [], key_), F.col(v))


def flag(x: Vec) -> Column:
    """A mask's items as Booleans; numbers other than 0 and 1 are refused."""
    if type_of(x) == "boolean":
        return x.col
    return F.when((x.col != 0) & (x.col != 1), F.raise_error(F.lit("domain error: a mask of other numbers than 0 and 1")).cast("boolean")).otherwise(x.col.cast("boolean"))


def copy(x, y):
    """A Boolean mask filters; counts repeat rows."""
    if isinstance(x, Vec):
        if isinstance(y, Mat):
            if x.frame is not y.frame:
                raise NotYet("a mask and a matrix of different tables")
            return Mat(Frame(y.frame.df.where(x.col.cast("boolean")), y.frame.ordering(), None), y.cols, y.cell)
        a, b = (v.trimmed() for v in align(x, y))
        f = b.frame
        if a.type.simpleString() == "boolean":
            return Vec(Frame(f.df.where(a.col), f.ordering() if f.pos or f.order else [], None), b.col)
        g = f.dense()
        k, name = fresh("k"), fresh("v")
        df = g.df.select(F.col(q(g.pos)).alias(POS), b.col.alias(name), F.posexplode(F.array_repeat(F.lit(1), a.col.cast("int"))).alias(k, fresh("one")))
        return Vec(Frame(df, [F.col(POS), F.col(k)]), F.col(name))
    n = int(ints(np.ravel(x)[:1])[0])
    if np.size(x) != 1:
        raise NotYet("a local mask of a distributed vector")
    if n == 1:
        return y
    p = y.placed()
    k, name = fresh("k"), fresh("v")
    df = p.frame.df.select(F.col(q(p.frame.pos)).alias(POS), p.col.alias(name), F.explode(F.sequence(F.lit(0), F.lit(n - 1)) if n else F.array().cast("array<int>")).alias(k))
    return Vec(Frame(df, [F.col(POS), F.col(k)]), F.col(name))


#: Items of a take that are put together in one row, and of a local side or a second vector that every row meets.
FEW = 1 << 16


def take(x, y: Vec, fill=None):
    """The first x items (last if negative); more than there are adds fill.

    Few items are collected into one array in order, which is padded and spread out again.
    """
    k = int(ints(x))
    y = y.trimmed()
    name, at = fresh("v"), fresh("at")
    t = y.type
    blank = (F.lit(fill) if fill is not None else F.lit(" ") if isinstance(t, T.StringType) else F.lit(0)).cast(t)
    if abs(k) > FEW:
        p = y.placed()
        pos = F.col(q(p.frame.pos))
        place = pos if k >= 0 else pos - p.frame.count() - k
        part = p.frame.df.select(place.alias(at), p.col.alias(name)).where((F.col(at) >= 0) & (F.col(at) < abs(k)))
        slots = _session().range(abs(k)).withColumnRenamed("id", POS)
        df = slots.join(part, F.col(POS) == F.col(at), "left").select(POS, F.coalesce(F.col(name), blank).alias(name))
        return Vec(Frame(df, [], POS), F.col(name))
    if k >= 0 and not y.frame.pos:
        order = y.frame.ordering()
        top = y.frame.df.select("*", y.col.alias(name)).orderBy(*order).limit(k)
        part = top.select(F.row_number().over(Window.orderBy(*order)).cast("long").alias(at), name)  # at most FEW rows
    else:
        p = y.placed()
        pos = F.col(q(p.frame.pos))
        part = p.frame.df.where(pos < k if k >= 0 else pos >= p.frame.count() + k).select(pos.alias(at), p.col.alias(name))
    got = part.agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("p"), F.col(name).alias("v")))).alias("a"))
    short = F.lit(0) if k >= 0 else F.lit(-k) - F.size("a")
    own = F.transform(F.sequence(F.lit(0), F.lit(abs(k) - 1)), lambda i: F.when((i >= short) & (i - short < F.size("a")), F.get("a", i - short)["v"]).otherwise(blank)) if k else F.array().cast(T.ArrayType(t))
    df = got.select(F.posexplode(own).alias(at, name)).select(F.col(at).cast("long").alias(POS), name)
    return Vec(Frame(df, [], POS), F.col(name))


def shift(x, y: Vec, fill=None):
    k = int(ints(x))
    p = y.placed()
    blank = F.lit(0 if fill is None else fill.item() if isinstance(fill, np.generic) else fill)
    if not k:
        return p
    g = p.frame.windows()
    moved = g.add((F.lead(p.col, k) if k > 0 else F.lag(p.col, -k)).over(g.window), max(0, -k), max(0, k))
    pos = F.col(q(g.pos))
    inside = (pos < g.count() - k) if k > 0 else (pos >= -k)
    return Vec(g, F.when(inside, moved).otherwise(blank))


def find(x, y: Vec) -> Vec:
    """Ones where the list x begins; in strings, per row."""
    want = np.ravel(x).tolist()
    if y.type.simpleString() == "string" and kind(x) == "char":
        return Vec(y.frame, y.col.contains("".join(want)), y.front, y.back)
    p = y.placed()
    g = p.frame.windows()
    hit = F.lit(True)
    for k, v in enumerate(want):
        hit = hit & F.coalesce((F.lead(p.col, k).over(g.window) if k else p.col) == F.lit(v), F.lit(False))
    return Vec(g, g.add(hit, 0, max(0, len(want) - 1)))


def sparse_form(code: int, y: Vec):
    """Index and value lists of the entries that are not zero; storage itself stays columnar."""
    if code in (0, 1):
        return y
    p = y.placed()
    entry = p.col != 0
    if code == 4:
        return indices(Vec(p.frame, entry))
    if code == 5:
        return copy(Vec(p.frame, entry), p)
    if code == 7:
        return Scalar(p.frame, F.count(F.when(entry, 1)))
    raise NotYet(f"form {code} of $. over a distributed vector")


def digits(x, y: Vec) -> Mat:
    out, rest, cols = [], y.col, np.ravel(x).tolist()
    for r in reversed(cols):
        d = scalars.residue(F.lit(r), rest, False)
        out.append(d)
        rest = ((rest - d) / F.lit(r)).cast("long") if r else rest * 0
    return Mat(y.trimmed().frame, out[::-1]) if np.ndim(x) else Vec(y.frame, out[0], y.front, y.back)


def reshape(x, y: Vec):
    """A table of rows of the last length; the items must fill it."""
    shape = [int(v) for v in np.ravel(ints(x))]
    if len(shape) == 1:
        p = y.placed()
        n = p.frame.count()
        name = fresh("v")
        slots = _session().range(shape[0]).select(F.col("id").alias("__slot"), F.pmod(F.col("id"), n).alias("__want"))
        df = slots.join(p.frame.df.select(F.col(q(p.frame.pos)).alias("__src"), p.col.alias(name)), F.col("__want") == F.col("__src")).select(F.col("__slot").alias(POS), name)
        return Vec(Frame(df, [], POS), F.col(name))
    if len(shape) != 2:
        raise NotYet("reshaping a distributed vector to more than two axes")
    p = reshape(np.array([shape[0] * shape[1]]), y)
    pos, k = F.col(q(p.frame.pos)), shape[1]
    cell = fresh("cell")
    rows = p.frame.df.groupBy(F.floor(pos / k).cast("long").alias(POS)).agg(F.transform(F.array_sort(F.collect_list(F.struct(pos.alias("p"), p.col.alias("v")))), lambda s: s["v"]).alias(cell))
    return Mat(Frame(rows, [], POS), [F.get(F.col(cell), F.lit(i)) for i in range(k)])


def index_error() -> Column:
    return F.raise_error(F.lit("index error"))


def pick(x, y: Vec):
    """Items at positions: local ones by a filter, distributed ones by a join, in x's order.

    Positions that were just looked up in another column of y's table need none: the items join by the
    values that were looked up.
    """
    found = getattr(x, "found", None)
    if found is not None and y.frame is found["table"].frame and not (y.front or y.back):
        k, v = fresh("k"), fresh("v")
        table, by = found["table"], F.max_by if found["last"] else F.min_by
        order = order_key(table.frame)
        t = type_of(table)
        seen = table.frame.df.groupBy(alike(table.col, t).alias(k)).agg(by(F.struct(y.col.alias("v")), order).alias(v))
        asked = found["asked"]
        joined = asked.frame.df.join(seen, alike(asked.col, type_of(asked)) == F.col(k), "left")
        return Vec(Frame(joined, asked.frame.order, asked.frame.pos, asked.frame), F.when(F.col(v).isNull(), index_error().cast(y.type)).otherwise(F.col(v)["v"]))
    p = y.placed()
    pos = F.col(q(p.frame.pos))
    if isinstance(x, Vec):
        i, v, at = fresh("i"), fresh("v"), fresh("at")
        a = x.placed()
        left = a.frame.df.select(F.col(q(a.frame.pos)).alias(POS), a.col.alias(i))
        n = p.frame.count()
        left = left.withColumn(i, F.when(F.col(i) < 0, F.col(i) + n).otherwise(F.col(i)))
        right = p.frame.df.select(pos.alias(at), p.col.alias(v))
        df = left.join(right, F.col(i) == F.col(at), "left")
        return Vec(Frame(df, [], POS), F.when(F.col(at).isNull(), index_error().cast(p.type)).otherwise(F.col(v)))
    if isinstance(x, Distributed):
        raise NotYet("items at positions that are no vector")
    at = [int(v) for v in np.ravel(ints(x))]
    if np.ndim(x) == 0:
        k = at[0]
        hit = pos == k if k >= 0 else pos == p.frame.count() + k
        return Scalar(p.frame, F.when(F.count(F.when(hit, 1)) == 0, index_error().cast(p.type)).otherwise(F.max(F.when(hit, p.col))))
    idx = _session().createDataFrame([(i, a) for i, a in enumerate(at)], "i long, a long")
    return pick(Vec(Frame(idx, [], "i"), F.col("a")), y)


def from_literal(x: Vec, y) -> Vec:
    values = F.array(*[value_of(v) for v in np.ravel(y).tolist()])
    n = len(np.ravel(y))
    i = x.col.cast("int")
    i = F.when((i < -n) | (i >= n), index_error().cast("int")).when(i < 0, i + n).otherwise(i)
    return Vec(x.frame, F.get(values, i), x.front, x.back)


def index_of(x, y, last: bool, origin: int):
    """Position of each value of y in x, by one equi-join with x's distinct values; absent gives x's length."""
    if isinstance(x, np.ndarray):
        values = np.ravel(x).tolist()
        ty = type_of(y)
        hay = F.array(*[alike(value_of(v), "double" if isinstance(v, float) else "") for v in values])
        item = alike(y.col, ty) if scalars.is_float(ty) else y.col
        if last:
            found = F.when(F.array_position(F.reverse(hay), item) > 0, len(values) - F.array_position(F.reverse(hay), item)).otherwise(len(values))
        else:
            found = F.when(F.array_position(hay, item) > 0, F.array_position(hay, item) - 1).otherwise(len(values))
        return Vec(y.frame, found.cast("long") + origin, y.front, y.back)
    agg = F.max if last else F.min
    if isinstance(y, np.ndarray):
        a = x.placed()
        pos = F.col(q(a.frame.pos))
        ta = type_of(a)
        one = lambda v: Scalar(a.frame, F.coalesce(agg(F.when(scalars.equal(a.col, lit(v), ta, "double" if v.dtype.kind == "f" else "string" if v.dtype.kind in "OU" else "bigint", False), pos)), F.count(F.lit(1))) + origin)
        if kind(y) == "char" or not y.ndim:
            return one(text_of(y))
        return Tuple([one(np.asarray(v)) for v in np.ravel(y)])
    k, at = fresh("k"), fresh("at")
    b = y.trimmed()
    table = x.trimmed()

    def plan() -> tuple[DataFrame, Column]:
        a = table.placed()
        seen = a.frame.df.groupBy(alike(a.col, type_of(a)).alias(k)).agg(agg(F.col(q(a.frame.pos))).alias(at))
        return b.frame.df.join(seen, alike(b.col, type_of(b)) == F.col(k), "left"), a.frame.count()

    joined, n = plan()
    out = Vec(Frame(joined, b.frame.order, b.frame.pos, b.frame), F.coalesce(F.col(at), n) + origin)
    if not origin:
        out.found = {"table": table, "asked": b, "last": last}
    return out


def hay_of(y: np.ndarray, t: str) -> list:
    """The items of a local list as keys beside a column of type t."""
    values = np.ravel(y).tolist()
    if not scalars.is_float(t):
        return values
    return [alike(F.lit(float(v)), t) for v in values]


def member(x, y):
    if isinstance(y, np.ndarray):
        t = type_of(x)
        return Vec(x.frame, F.coalesce(alike(x.col, t).isin(hay_of(y, t)), F.lit(False)), x.front, x.back)
    b = y.trimmed()
    k, hit = fresh("k"), fresh("hit")
    own = b.frame.df.select(alike(b.col, type_of(b)).alias(k)).distinct().withColumn(hit, F.lit(True))
    a = x.trimmed()
    joined = a.frame.df.join(own, alike(a.col, type_of(a)) == F.col(k), "left")
    return Vec(Frame(joined, a.frame.order, a.frame.pos, a.frame), F.col(hit).isNotNull())


def less(x, y, keep: bool):
    """x's items that y has not (has, if ``keep``), duplicates and order kept."""
    a = x.trimmed()
    t = type_of(a)
    if isinstance(y, np.ndarray):
        hit = alike(a.col, t).isin(hay_of(y, t))
        return Vec(Frame(a.frame.df.where(hit if keep else ~hit), a.frame.ordering() if a.frame.pos or a.frame.order else []), a.col)
    b = y.trimmed()
    k = fresh("k")
    own = b.frame.df.select(alike(b.col, type_of(b)).alias(k))
    df = a.frame.df.join(own, alike(a.col, t) == F.col(k), "left_semi" if keep else "left_anti")
    return Vec(Frame(df, a.frame.ordering() if a.frame.pos or a.frame.order else []), a.col)


def interval_index(x, y: Vec, closed: bool, origin: int):
    """How many bounds lie below each value: an array of a few local bounds, or a merged sort of distributed ones."""
    if isinstance(x, np.ndarray):
        bounds = F.array(*[F.lit(float(v) if x.dtype.kind == "f" else v) for v in np.ravel(x).tolist()])
        count = F.size(F.filter(bounds, (lambda b: b <= y.col) if closed else (lambda b: b < y.col)))
        return Vec(y.frame, count.cast("long") + (origin - 1 if closed else 0), y.front, y.back)
    b, p = x.trimmed(), y.placed()
    v, flag, at = fresh("v"), fresh("bound"), fresh("at")
    left = b.frame.df.select(b.col.alias(v), F.lit(1).alias(flag), F.lit(None).cast("long").alias(at))
    right = p.frame.df.select(p.col.alias(v), F.lit(0).alias(flag), F.col(q(p.frame.pos)).alias(at))
    tie = F.col(flag).desc() if closed else F.col(flag).asc()
    merged = Frame(left.unionByName(right), [F.col(v).asc(), tie, F.col(at).asc()]).dense()
    run, name = scan(merged, F.col(flag).cast("long"), "sum")
    df = run.df.where(f"{flag} = 0").select(F.col(at).alias(POS), F.col(name))
    return Vec(Frame(df, [], POS), F.col(name) + (origin - 1 if closed else 0))


def append(x, y):
    parts = []
    for a in (x, y):
        if isinstance(a, Vec):
            p = a.placed()
            parts.append((p.frame.df.select(F.col(q(p.frame.pos)).cast("long").alias(POS), p.col.alias("__v")), p.frame.count()))
        else:
            values = np.ravel(text_of(a)).tolist()
            other = y if a is x else x
            t = other.type.simpleString()
            parts.append((_session().createDataFrame([(i, float(v) if t == "double" else v) for i, v in enumerate(values)], f"{POS} long, __v {t}"), F.lit(len(values))))
    df = parts[0][0].unionByName(parts[1][0].withColumn(POS, F.col(POS) + parts[0][1]))
    return Vec(Frame(df, [], POS), F.col("__v"))


def match(x, y, negate: bool, apl: bool):
    a, b = (v.placed() if isinstance(v, Vec) else None for v in (x, y))
    if a is None or b is None:
        raise NotYet("matching a distributed value with a local one")
    va, vb, pb = fresh("x"), fresh("y"), fresh("p")
    left = a.frame.df.select(F.col(q(a.frame.pos)).alias(POS), a.col.alias(va))
    right = b.frame.df.select(F.col(q(b.frame.pos)).alias(pb), b.col.alias(vb))
    both = left.join(right, F.col(POS) == F.col(pb), "full_outer")
    same_ = F.coalesce(scalars.equal(F.col(va), F.col(vb), a.type.simpleString(), b.type.simpleString(), apl), F.lit(False))
    out = F.coalesce(F.bool_and(same_), F.lit(True))
    return Scalar(Frame(both), ~out if negate else out)


# folds


def folded(name: str, c: Column, t: str, pos) -> Column:
    """The aggregate of u/ for a primitive u; ``pos`` gives positions to the verbs that need them."""
    n = scalars.number(c, t)
    if name in ("+.", "∨", "*.", "∧"):
        if t != "boolean":
            raise NotYet(f"{name}/ of distributed numbers that are no Booleans")
        return F.coalesce((F.bool_or if name in ("+.", "∨") else F.bool_and)(c), F.lit(name not in ("+.", "∨")))
    if name in FOLD:
        what, ident = FOLD[name]
        agg = {"sum": F.sum, "product": F.product, "min": F.min, "max": F.max}[what](n)
        if what in ("min", "max"):
            return F.coalesce(agg, F.lit(ident).cast("double")) if t in ("double", "float") else agg
        return F.coalesce(agg, F.lit(ident).cast("long") if what == "sum" and not scalars.is_float(t) else F.lit(float(ident)))
    sign = F.when(pos() % 2 == 0, 1).otherwise(-1) if name in ("-", "%", "÷") else None
    if name == "-":
        return F.coalesce(F.sum(n * sign), F.lit(0))
    if name in ("%", "÷"):
        return F.coalesce(F.product(F.pow(n.cast("double"), sign)), F.lit(1.0))
    if name in ("~:", "≠"):
        return F.coalesce(F.sum(c.cast("long")) % 2 == 1, F.lit(False))
    if name == "=":
        return F.coalesce(F.sum((~c).cast("long")) % 2 == 0, F.lit(True))
    raise NotYet(f"{name}/ of a distributed vector")


def affine_step(u: Verb):
    """The factor of [ + c * ] (either side of the product), or None."""
    if u.node == "Fork" and isinstance(u.parts[0], Verb) and u.parts[0].name == "[" and u.parts[1].name == "+":
        h = u.parts[2]
        if h.node == "NounFork" and h.parts[1].name == "*" and h.parts[2].name == "]" and np.ndim(h.parts[0]) == 0:
            return float(h.parts[0])
        if h.node == "BondLeft" and h.parts[1].name == "*" and np.ndim(h.parts[0]) == 0:
            return float(h.parts[0])
        if h.node == "Atop" and h.parts[0].node == "BondLeft" and h.parts[0].parts[1].name == "*" and h.parts[1].name == "]":
            return float(h.parts[0].parts[0])
    return None


def reduce(u: Verb, y):
    if isinstance(y, Runs):
        return RunScalar(y, run_fold(u, y))
    if isinstance(y, (RunScalar, Scalar)):
        return y
    if isinstance(y, Tuple):
        out = y.parts[-1]
        for p in reversed(y.parts[:-1]):
            out = u.dyad(p, out)
        return out
    if isinstance(y, Vec):
        c = affine_step(u)
        needs = u.name in ("-", "%", "÷") or c is not None
        y = y.placed() if needs else y.trimmed()
        pos = lambda: F.col(q(y.frame.pos))
        if c is not None:
            return Scalar(y.frame, F.coalesce(F.sum(y.col * F.pow(F.lit(c), pos())), F.lit(0.0)))
        if u.node not in ("Prim",):
            raise NotYet(f"{u}/ of a distributed vector")
        if rows.is_complex(type_of(y)):
            if u.name != "+":
                raise NotYet(f"{u}/ of distributed complex numbers")
            part = lambda k: F.coalesce(F.sum(y.col[k]), F.lit(0.0)).alias(k)
            return Scalar(y.frame, F.struct(part("re"), part("im")))
        if u.name in ("[", "⊣"):
            return Scalar(y.frame, F.min_by(y.col, order_key(y.frame)))
        if u.name in ("]", "⊢"):
            return Scalar(y.frame, F.max_by(y.col, order_key(y.frame)))
        if u.name == ",":
            return y
        return Scalar(y.frame, folded(u.name, y.col, type_of(y), pos))
    if isinstance(y, Mat):
        if y.turned:
            return row_fold(u, Mat(y.frame, y.cols, y.cell))
        t = type_of(y)
        if y.cols is None:
            raise NotYet("folding the rows of array cells")
        return Tuple([Scalar(y.frame, folded(u.name, c, t, lambda: (_ for _ in ()).throw(NotYet("this fold of a matrix")))) for c in y.cols])
    raise NotYet(f"{u}/ of a distributed value")


def row_fold(u: Verb, y: Mat) -> Vec:
    """u between the columns of every row."""
    t = type_of(y)
    if y.cols is not None:
        out, to = y.cols[-1], t
        for c in reversed(y.cols[:-1]):
            out = scalars.dyad(u.name, c, out, t, to, apl_of(u))
            to = "boolean" if u.name in COMPARED else t if t != "boolean" else "bigint"
        return Vec(y.frame, out)
    start = {"+": 0.0, "*": 1.0, "×": 1.0, "<.": float("inf"), "⌊": float("inf"), ">.": float("-inf"), "⌈": float("-inf")}
    if u.name not in start:
        raise NotYet(f"{u}/ of array cells")
    return Vec(y.frame, F.aggregate(y.cell, F.lit(start[u.name]), lambda a, b: scalars.dyad(u.name, a, b, "double", "double", False)))


# scans, windows and groups


def scan_kind(u: Verb) -> str | None:
    if u.node == "Reduce" and u.parts[0].node == "Prim" and u.parts[0].name in FOLD:
        return FOLD[u.parts[0].name][0]
    return None


def prefix(u: Verb, y, backward: bool = False):
    if isinstance(y, Runs):
        if y.scan is None or scan_kind(u) is None:
            raise NotYet(f"{u}\\ inside these runs")
        return y.scan(y.col, scan_kind(u), backward)
    if not isinstance(y, Vec):
        raise NotYet("scans of distributed matrices")
    if u.node == "Prim" and u.name in ("#", "≢"):
        p = y.placed()
        pos = F.col(q(p.frame.pos))
        return Vec(p.frame, p.frame.count() - pos if backward else pos + 1)
    step = u.parts[0] if u.node == "Reduce" else None
    p = y.placed()
    pos = F.col(q(p.frame.pos))
    t = type_of(y)
    n = scalars.number(p.col, t)
    c = affine_step(step) if step is not None else None
    if c is not None:
        if not backward:
            f, name = scan(p.frame, p.col.cast("double") * F.pow(F.lit(c), pos), "sum")
            return Vec(f, F.col(name))
        if abs(c) == 1:
            sign = F.when((pos % 2 == 0) | (F.lit(c) > 0), 1.0).otherwise(-1.0)
            f, name = scan(p.frame, p.col * sign, "sum", True)
            return Vec(f, F.col(name) * sign)
        f, name = affine(p.frame, p.col, c)
        return Vec(f, F.col(name))
    what = scan_kind(u)
    if what is not None:
        if t == "boolean" and what in ("min", "max"):
            f, name = scan(p.frame, p.col.cast("int"), what, backward)
            return Vec(f, F.col(name).cast("boolean") if step.name in ("+.", "∨", "*.", "∧") else F.col(name))
        f, name = scan(p.frame, n, what, backward)
        return Vec(f, F.col(name))
    if step is not None and step.name in ("-", "%", "÷"):
        if backward:  # from row i the signs start anew
            sign = F.when(pos % 2 == 0, 1).otherwise(-1)
            f, name = scan(p.frame, n * sign if step.name == "-" else F.pow(n.cast("double"), sign), "sum" if step.name == "-" else "product", True)
            return Vec(f, F.col(name) * sign if step.name == "-" else F.pow(F.col(name), sign))
        sign = F.when(pos % 2 == 0, 1).otherwise(-1)
        f, name = scan(p.frame, n * sign if step.name == "-" else F.pow(n.cast("double"), sign), "sum" if step.name == "-" else "product")
        return Vec(f, F.col(name))
    if step is not None and step.name in ("~:", "≠", "=") and t == "boolean":
        f, name = scan(p.frame, (p.col if step.name != "=" else ~p.col).cast("long"), "sum", backward)
        return Vec(f, F.col(name) % 2 == (1 if step.name != "=" else 0))
    if u.node == "Fork" or u.node == "Atop" or u.node == "NounFork":
        return over_prefixes(u, p, backward)
    raise NotYet(f"{u}\\ of a distributed vector: its step does not regroup")


def over_prefixes(u: Verb, p: Vec, backward: bool):
    """A train of folds over prefixes: each fold is a scan, combined by rows."""
    if u.node == "Fork":
        f, g, h = u.parts
        return g.dyad(prefix(f, p, backward), prefix(h, p, backward))
    if u.node == "NounFork":
        return u.parts[1].dyad(u.parts[0], prefix(u.parts[2], p, backward))
    return u.parts[0].monad(prefix(u.parts[1], p, backward))


def suffix(u: Verb, y):
    return prefix(u, y, True)


def infix(u: Verb, x, y: Vec, apl: bool = False):
    """u over windows of x items; for a negative x over chunks in J, over windows from their ends on in APL."""
    k = int(ints(x))
    p = y.placed()
    pos = F.col(q(p.frame.pos))
    if k < 0 and not apl:
        return grouped(u, p.frame, p.col, [F.floor(pos / -k).cast("long")], by_key=True)
    if k == 0:  # between all items and at both ends there is nothing, n + 1 times
        nothing = np.asarray(u.monad(np.zeros(0, np.int64)))
        if nothing.ndim or nothing.dtype.kind not in "bif":
            raise NotYet(f"{u} over windows of no items of a distributed vector")
        ends = p.frame.df.select((pos + 1).alias(POS)).unionByName(_session().range(1).withColumnRenamed("id", POS))
        return Vec(Frame(ends, [], POS), value_of(nothing[()]))
    back, k = k < 0, abs(k)
    g = p.frame.windows()
    frame = g.window.rowsBetween(-(k - 1), 0)

    def finish(c: Column) -> Vec:
        return Vec(g, g.add(c, k - 1, 0), k - 1, 0)

    if back and u.node == "Reduce" and u.parts[0].name in ("⊣", "⊢", "[", "]"):
        raise NotYet("ends of reversed windows over a distributed vector")
    runs = Runs(p.frame, p.col, lambda a: a.over(frame), F.lit(k), finish, pos)
    try:
        return close(u.monad(runs))
    except NotYet:
        return each_window(u, p, k, back)


def close(v):
    if isinstance(v, RunScalar):
        return v.runs.finish(v.col)
    if isinstance(v, Distributed) and not isinstance(v, Runs):
        return v
    raise NotYet("runs of items as the result; fold them")


def outfix(u: Verb, x, y: Vec):
    k = int(ints(x))
    if k <= 0 or scan_kind(u) != "sum":
        raise NotYet("outfixes of a distributed vector other than of sums")
    total = reduce(u.parts[0], y)
    from ..frontend.j import PRIMS

    return PRIMS["-"].dyad(total, infix(u, x, y))


def grouped(u: Verb, f: Frame, col: Column, keys: list[Column], by_key: bool = False, where: Column | None = None, leave: Column | None = None) -> Vec:
    """u over groups of rows, one row a group in the order of first rows; rows of ``leave`` only open groups.

    ``by_key``: the key counts the groups from 0 on, so it is their position.
    """
    pos = F.col(q(f.pos)) if f.pos else None
    made = f.__dict__.setdefault("_groups", {})
    same_groups = (_sentence[0], tuple(str(k) for k in keys), by_key, None if where is None else str(where), None if leave is None else str(leave))
    if same_groups not in made:
        names = [fresh("key") for _ in keys]
        source = f.df if where is None else f.df.where(where)
        for n_, k in zip(names, keys, strict=True):
            source = source.withColumn(n_, k)
        if leave is not None:  # aggregates skip nulls
            out = fresh("out")
            source = source.withColumn(out, leave)
        first = None if by_key else F.min(order_key(f)) if f.pos or f.order else F.lit(0)
        made[same_groups] = (GroupFrame(source, names, first), None if leave is None else out)
    g, out = made[same_groups]
    names, source = g.names, g.source

    def finish(c: Column) -> Vec:
        v = Vec(g, g.add(c))
        v.keys = [F.col(n_) for n_ in names]
        return v

    def scans(c: Column, what: str, backward: bool) -> Vec:
        from .blocks import FOLDS

        w = Window.partitionBy(*names).orderBy(*([x.desc() for x in [pos]] if backward else f.ordering())).rowsBetween(Window.unboundedPreceding, 0)
        name = fresh("s")
        return Vec(Frame(source.withColumn(name, FOLDS[what][0](c).over(w)), f.order, f.pos), F.col(name))

    if leave is not None:
        own, size = F.when(~F.col(out), col), F.count(F.when(~F.col(out), 1))
    else:
        own, size = col, F.count(F.lit(1))
    runs = Runs(Frame(source, f.order, f.pos), own, lambda a: a, size, finish, pos, scans)
    try:
        return close(u.monad(runs))
    except NotYet:
        return each_group(u, g, f, col if leave is None else None, by_key)


def probe(u: Verb, t: T.DataType) -> str:
    """The type of u's result on a few items of type t; a list of results is refused."""
    few = {"string": np.array(["a", "b", "c"], dtype=object), "boolean": np.array([True, False, True]), "double": np.array([1.5, 2.5, 4.0])}.get(t.simpleString(), np.array([1, 2, 4], np.int64))
    try:
        out = np.asarray(u.monad(few))
    except LanguageError as e:
        raise NotYet(f"{u} over runs of a distributed vector: {e}") from None
    if out.ndim or out.dtype.kind not in "bif":
        raise NotYet(f"{u} over runs of a distributed vector: its result is no number")
    return {"b": "boolean", "i": "bigint", "f": "double"}[out.dtype.kind]


def one_value(u: Verb, items_: np.ndarray, t: str):
    """u of a run as a value of type t."""
    out = np.asarray(u.monad(items_))
    if out.ndim:
        raise DomainError("results of several items")
    v = out[()].item() if isinstance(out[()], np.generic) else out[()]
    return float(v) if t == "double" else v


def each_group(u: Verb, g: GroupFrame, f: Frame, col: Column | None, by_key: bool) -> Vec:
    """Any verb on the items of every group, in order: one group at a time in Python, so a group must fit a worker."""
    if col is None:
        raise NotYet(f"{u} over cuts without their ends")
    at, v, name = fresh("at"), fresh("v"), fresh("g")
    if not (f.pos or f.order):
        raise NotYet("items of groups in order; name an order with Table(order=...)")
    source = g.source.select(*g.names, order_key(f).alias(at), col.alias(v))
    t = source.schema[v].dataType
    kind_ = probe(u, t)
    first = source.schema[at]
    from pyspark.sql.types import StructField, StructType

    schema = StructType([*(source.schema[n] for n in g.names), StructField(g.first, first.dataType), StructField(name, T._parse_datatype_string(kind_))])
    names, first_name = g.names, g.first

    def run(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        order = pc.sort_indices(table.column(at)) if not pa.types.is_struct(table.schema.field(at).type) else pa.array(sorted(range(table.num_rows), key=lambda i: tuple(table.column(at)[i].as_py().values())))
        table = table.take(order)
        own = table.column(v).to_numpy() if not pa.types.is_string(table.schema.field(v).type) else np.array(table.column(v).to_pylist(), dtype=object)
        out = one_value(u, own, kind_)
        cols = [table.column(n).slice(0, 1) for n in names] + [table.column(at).slice(0, 1), pa.chunked_array([pa.array([out])])]
        return pa.Table.from_arrays([c.combine_chunks() for c in cols], names=[*names, first_name, name]).cast(_arrow(schema))

    df = source.groupBy(*g.names).applyInArrow(run, schema)
    out = Vec(Frame(df, [], g.names[0]) if by_key else Frame(df, [F.col(first_name)]), F.col(name))
    out.keys = [F.col(n) for n in g.names]
    return out


def _arrow(schema):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def each_window(u: Verb, p: Vec, k: int, back: bool) -> Vec:
    """Any verb on every window, block by block in Python."""
    b, home, v, at, name = (fresh(x) for x in ("b", "home", "v", "at", "w"))
    kind_ = probe(u, p.type)
    df = spread(p.frame, k - 1, 0, b, home).select(b, (F.col(b) == F.col(home)).alias(home), F.col(q(p.frame.pos)).alias(at), p.col.alias(v))

    def run(table):
        import pyarrow as pa

        table = table.sort_by(at)
        own, pos = table.column(home).to_pylist(), table.column(at).to_pylist()
        items_ = table.column(v).to_numpy() if not pa.types.is_string(table.schema.field(v).type) else np.array(table.column(v).to_pylist(), dtype=object)
        ends = [i for i in range(k - 1, len(pos)) if own[i]]
        made = [one_value(u, items_[i - k + 1 : i + 1][::-1] if back else items_[i - k + 1 : i + 1], kind_) for i in ends]
        return pa.table({POS: pa.array([pos[i] - k + 1 for i in ends], pa.int64()), name: pa.array(made, {"boolean": pa.bool_(), "bigint": pa.int64(), "double": pa.float64()}[kind_])})

    return Vec(Frame(df.groupBy(b).applyInArrow(run, f"{POS} long, {name} {kind_}"), [], POS), F.col(name))


def key(u: Verb, x, y):
    """u over the items of y that share an item of x."""
    if isinstance(y, Mat) and isinstance(x, Vec):
        raise NotYet("keys over a matrix; take its columns")
    if not isinstance(y, Vec):
        raise NotYet("keys over a local argument")
    if isinstance(x, Mat):
        if x.frame is not y.frame:
            raise NotYet("keys and values of different tables")
        return grouped(u, y.frame, y.col, x.columns())
    a, b = (v.trimmed() for v in align(x, y))
    t = type_of(a)
    return grouped(u, b.frame, b.col, [alike(a.col, t)])


def run_fold(u: Verb, y: Runs) -> Column:
    if u.node != "Prim":
        raise NotYet(f"{u}/ inside runs")

    t = y.frame.df.select(y.col.alias("v")).schema[0].dataType.simpleString()
    n = scalars.number(y.col, t)
    if u.name in FOLD:
        what = FOLD[u.name][0]
        if u.name in ("+.", "∨", "*.", "∧"):
            return y.agg((F.bool_or if what == "max" else F.bool_and)(y.col))
        out = y.agg({"sum": F.sum, "product": F.product, "min": F.min, "max": F.max}[what](n))
        ident = F.lit(float(FOLD[u.name][1])) if what != "sum" or scalars.is_float(t) else F.lit(0).cast("long")
        return F.coalesce(out, ident) if what in ("sum", "product") or scalars.is_float(t) else out
    if u.name in ("[", "⊣") and y.pos is not None:
        return y.agg(F.min_by(y.col, y.pos))
    if u.name in ("]", "⊢") and y.pos is not None:
        return y.agg(F.max_by(y.col, y.pos))
    raise NotYet(f"{u}/ inside runs")


def run_monad(v: Verb, y):
    if isinstance(y, RunScalar):
        return RunScalar(y.runs, scalars.monad(v.name, y.col, "double" if v.name not in ("-", "+", "|", "<:", ">:", "*:", "+:") else "bigint", apl_of(v)))
    if v.name in ("#", "≢", "$", "⍴"):
        return RunScalar(y, y.size)
    if v.name in ("{.", "↑", "{:") and y.pos is not None:
        return RunScalar(y, y.agg((F.max_by if v.name == "{:" else F.min_by)(y.col, y.pos)))
    if v.name in ("{.", "{:"):
        key_ = order_key(y.frame)
        return RunScalar(y, y.agg((F.max_by if v.name == "{:" else F.min_by)(y.col, key_)))
    if v.name in ("~.", "∪"):
        return _Distinct(y)
    if v.name in ("]", "[", "⊢", "⊣", ","):
        return y
    if v.name in ("<", "⊂"):
        if y.pos is None:
            raise NotYet("boxed runs need a position column")
        return RunScalar(y, F.transform(F.array_sort(y.agg(F.collect_list(F.struct(y.pos.alias("p"), y.col.alias("v"))))), lambda s: s["v"]))
    if v.name in scalars.ONE:
        t = y.frame.df.select(y.col.alias("v")).schema[0].dataType.simpleString()
        return y.with_col(scalars.monad(v.name, y.col, t, apl_of(v)))
    raise NotYet(f"{v} inside runs")


class _Distinct(Distributed):
    """The distinct items of every run; only their number is read."""

    def __init__(self, runs: Runs):
        self.runs = runs


def run_dyad(v: Verb, x, y):
    def col(a):
        return a.col if isinstance(a, (Runs, RunScalar)) else a.inline() if isinstance(a, Scalar) else lit(a)

    host = x if isinstance(x, (Runs, RunScalar)) else y
    if isinstance(x, Runs) and isinstance(y, RunScalar) or isinstance(x, RunScalar) and isinstance(y, Runs):
        raise NotYet("items beside a fold of their own run")
    if isinstance(x, Vec) or isinstance(y, Vec):
        raise NotYet("a distributed vector beside runs")
    if v.name not in scalars.TWO:
        raise NotYet(f"{v} inside runs")
    out = scalars.dyad(v.name, col(x), col(y), "bigint" if isinstance(x, np.ndarray) and x.dtype.kind in "bi" else "double", "bigint" if isinstance(y, np.ndarray) and y.dtype.kind in "bi" else "double", apl_of(v), None if isinstance(x, Distributed) else np.ravel(x)[0])
    return host.with_col(out) if isinstance(host, Runs) else RunScalar(host.runs, out)


def cut(u: Verb, k: int, x, y):
    """u over segments that begin (1) or end (2) at the ones of a mask; negative kinds leave the mask's own rows out."""
    if k == 0 and x is None:
        from ..frontend.j import PRIMS

        return u.monad(PRIMS["|."].monad(y))
    if x is None and k in (1, -1, 2, -2) and isinstance(y, Vec):
        p = y.placed()
        end = Scalar(p.frame, (F.min_by if abs(k) == 1 else F.max_by)(p.col, F.col(q(p.frame.pos)))).inline()
        x, y = Vec(p.frame, p.col == end), p
    if k not in (1, -1, 2, -2) or not isinstance(x, Vec) or not isinstance(y, Vec):
        raise NotYet("this cut of distributed values")
    a, b = align(x, y)
    if a.front or a.back:
        raise NotYet("a cut of shifted views; take them apart first")
    f = b.frame.dense()
    mark = flag(a)
    run, name = scan(f, mark.cast("long"), "sum")
    seg = F.col(name)
    if abs(k) == 2:
        seg = seg - mark.cast("long")
        keep = seg < Scalar(f, F.coalesce(F.sum(mark.cast("long")), F.lit(0))).inline()
    else:
        keep = seg > 0
        seg = seg - 1
    return grouped(u, run, b.col, [seg], by_key=True, where=keep, leave=mark if k < 0 else None)


def table(u: Verb, x, y):
    """u of every pair: a local side spreads over columns or rows; of two distributed sides the right one, FEW items at most, meets every row."""
    if isinstance(x, Vec) and isinstance(y, np.ndarray):
        return Mat(x.trimmed().frame, [u.dyad(x.trimmed(), np.asarray(v)).col for v in np.ravel(y)])
    if isinstance(y, Vec) and isinstance(x, np.ndarray):
        t = y.trimmed()
        return Mat(t.frame, [u.dyad(np.asarray(v), t).col for v in np.ravel(x)], None, turned=True)
    a, b = x.trimmed(), y.placed()
    got = F.array_sort(F.collect_list(F.struct(F.col(q(b.frame.pos)).alias("p"), b.col.alias("v"))))
    some = F.when(F.count(F.lit(1)) > FEW, F.raise_error(F.lit(f"a table of pairs whose right side has more than {FEW} items"))).otherwise(got)
    few = b.frame.df.limit(FEW + 1).agg(some.alias("a")).select(F.transform("a", lambda s: s["v"])).scalar()
    tx, ty = type_of(a), type_of(b)
    name = fresh("few")
    g = Frame(a.frame.df.withColumn(name, few), a.frame.order, a.frame.pos, a.frame)
    return Mat(g, None, F.transform(name, lambda v: scalars.dyad(u.name, a.col, v, tx, ty, apl_of(u))))


def oblique(u: Verb, y):
    if not isinstance(y, Mat):
        raise NotYet("diagonals of a distributed vector")
    f = y.frame.dense()
    i, v, at = fresh("i"), fresh("v"), fresh("at")
    cell = F.array(*y.cols) if y.cols is not None else y.cell
    df = f.df.select(F.col(q(f.pos)).alias(at), F.posexplode(cell).alias(i, v))
    return grouped(u, Frame(df, [], at), F.col(v), [F.col(at) + F.col(i)], by_key=True)


def inner(u: Verb, v: Verb, x, y):
    """Products of rows and columns; for plain sums of products also Gram matrices in one aggregate."""
    step = u.parts[0] if u.node == "Reduce" else u
    if isinstance(x, Vec) and isinstance(y, Vec):
        return reduce(step, v.dyad(x, y))
    if isinstance(x, Mat) and isinstance(y, np.ndarray) and not x.turned:
        m = y if y.ndim == 2 else y.reshape(-1, 1)
        if x.cols is None:
            rows = []
            for k in range(m.shape[1]):
                w = F.array(*[F.lit(float(c)) for c in m[:, k]])
                rows.append(row_fold(step, Mat(x.frame, None, F.zip_with(x.cell, w, lambda a, b: scalars.dyad(v.name, a, b, "double", "double", False)))).col)
            return Mat(x.frame, rows) if y.ndim == 2 else Vec(x.frame, rows[0])
        cols = [row_fold(step, Mat(x.frame, [scalars.dyad(v.name, c, F.lit(w.item()), type_of(x), lit_type(m), apl_of(v)) for c, w in zip(x.cols, m[:, k], strict=True)])).col for k in range(m.shape[1])]
        return Mat(x.frame, cols) if y.ndim == 2 else Vec(x.frame, cols[0])
    if isinstance(x, Mat) and x.turned and isinstance(y, (Mat, Vec)) and x.frame is y.frame:
        t = type_of(x)
        right = y.columns() if isinstance(y, Mat) else [y.col]
        parts = [Tuple([Scalar(x.frame, folded(step.name, scalars.dyad(v.name, a, b, t, type_of(y), apl_of(v)), t, None)) for b in right]) for a in x.columns()]
        return Tuple([p for row in parts for p in row.parts]) if isinstance(y, Mat) else Tuple([row.parts[0] for row in parts])
    if isinstance(x, Mat) and isinstance(y, Mat) and x.frame is y.frame and not x.turned and not y.turned:
        raise NotYet("a product of a table with itself; turn one side")
    raise NotYet("this product of distributed values")


def least_squares(x, y):
    """Solution of y a = x by orthogonal factors: each task reduces its rows to one triangle, triangles are reduced alike."""
    if not isinstance(y, Mat) or not isinstance(x, Vec) or x.frame is not y.frame:
        raise NotYet("least squares of these arguments")
    cols = [c.cast("double") for c in y.columns()]
    k = len(cols)
    names = [f"c{i}" for i in range(k + 1)]

    def triangle(batches):
        import pyarrow as pa

        held = np.zeros((0, k + 1))
        for batch in batches:
            block = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[: k + 1]], axis=1)
            held = np.linalg.qr(np.vstack([held, block]), mode="r")
        if len(held):
            yield pa.RecordBatch.from_arrays([*(pa.array(held[:, i]) for i in range(k + 1)), pa.array([task_number() % 64] * len(held), pa.int64())], names=[*names, "g"])

    def again(table):
        import pyarrow as pa

        r = np.linalg.qr(np.stack([table.column(n).to_numpy() for n in names], axis=1), mode="r")
        return pa.table({n: r[:, i] for i, n in enumerate(names)})

    schema = ", ".join(f"{n} double" for n in names)
    rows_ = y.frame.df.select(*[c.alias(n) for c, n in zip([*cols, x.col.cast("double")], names, strict=True)])
    tops = rows_.mapInArrow(triangle, f"{schema}, g long").groupBy("g").applyInArrow(again, schema)  # at most 64 triangles
    got = np.array([list(r) for r in tops.collect()])
    if len(got) < k:
        raise DomainError("fewer rows than columns")
    r = np.linalg.qr(got, mode="r")
    top = r[:k, :k]
    if np.abs(np.diag(top)).min() <= np.abs(np.diag(top)).max() * np.finfo(float).eps * k:
        raise DomainError("a singular argument")
    return np.linalg.solve(top, r[:k, k])


def task_number() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


class Rows(Distributed):
    """Every row of a matrix at once, while a verb of rank 1 is applied to rows."""

    def __init__(self, m: Mat):
        self.m = m


def ranked(u: Verb, ranks, y, x=None):
    m = ranks[0] if x is None else ranks[2]
    if isinstance(y, Mat) and m == 1 and x is None:
        return on_rows(u, y)
    if isinstance(y, (Vec, Scalar)) and x is None:
        return on_atoms(u, y) if m == 0 and isinstance(y, Vec) else u.monad(y)
    if x is not None:
        if m == 0 and isinstance(y, Vec) and u.node != "Prim":
            raise NotYet(f"{u} between atoms of distributed vectors")
        return u.dyad(x, y)
    return u.monad(y)


def on_atoms(u: Verb, y: Vec):
    """A verb on each item of a vector: a fold of one item is the item, a count of one is 1, the rest is elementwise."""
    if u.node == "Reduce":
        return y
    if u.node == "Fork":
        f, g, h = u.parts
        return g.dyad(on_atoms(f, y), on_atoms(h, y))
    if u.node == "NounFork":
        return u.parts[1].dyad(u.parts[0], on_atoms(u.parts[2], y))
    if u.node == "Hook":
        return u.parts[0].dyad(y, on_atoms(u.parts[1], y))
    if u.node == "Atop" and len(u.parts) == 2 and all(isinstance(p, Verb) for p in u.parts):
        return on_atoms(u.parts[0], on_atoms(u.parts[1], y))
    if u.name in ("#", "≢"):
        return Vec(y.frame, F.lit(1).cast("long"), y.front, y.back)
    if u.name in ("[", "]", "⊢", "⊣", "{.", "{:", "|.", "⌽", ",", "~.", "/:~"):
        return y
    if u.node == "Prim" and u.name in scalars.ONE:
        return u.monad(y)
    raise NotYet(f"{u} on each item of a distributed vector")


def on_rows(u: Verb, y: Mat):
    """A verb on each row of a matrix: folds go across columns, trains combine, the rest is elementwise."""
    if u.node == "Reduce":
        return row_fold(u.parts[0], y)
    if u.node == "Fork":
        f, g, h = u.parts
        return g.dyad(on_rows(f, y), on_rows(h, y))
    if u.node == "NounFork":
        return u.parts[1].dyad(u.parts[0], on_rows(u.parts[2], y))
    if u.node == "Hook":
        return u.parts[0].dyad(y, on_rows(u.parts[1], y))
    if u.node == "Atop":
        inner_ = on_rows(u.parts[1], y)
        return on_rows(u.parts[0], inner_) if isinstance(inner_, Mat) else u.parts[0].monad(inner_)
    if u.node == "BondLeft":
        return u.parts[1].dyad(u.parts[0], y)
    if u.name in ("#", "≢"):
        return Vec(y.frame, F.lit(len(y.cols)) if y.cols is not None else F.size(y.cell))
    if u.name in ("[", "]", "⊢", "⊣"):
        return y
    if u.name in ("{.", "↑"):
        return Vec(y.frame, y.cols[0] if y.cols is not None else F.get(y.cell, F.lit(0)))
    if u.name == "{:":
        return Vec(y.frame, y.cols[-1] if y.cols is not None else F.element_at(y.cell, -1))
    if u.name in ("|.", "⌽"):
        return Mat(y.frame, y.cols[::-1] if y.cols is not None else None, None if y.cols is not None else F.reverse(y.cell))
    if u.name == "#.":
        return Vec(y.frame, base(F.lit(2), y))
    if u.name in ("/:", "\\:") and y.cell is not None:
        raise NotYet("grading array cells")
    return u.monad(y)


def amend(x, m, y: Vec):
    """New values at listed positions, by a condition on the position."""
    if not isinstance(y, Vec) or isinstance(x, Distributed):
        raise NotYet("this amend of distributed values")
    p = y.placed()
    if isinstance(m, Distributed):
        raise NotYet("new values at distributed positions")
    at = [int(v) for v in np.ravel(ints(m))]
    pos = F.col(q(p.frame.pos))
    n = p.frame.count()
    values = np.broadcast_to(x, np.shape(m)).ravel()
    out = p.col
    if len(at) <= 16:
        for a, v in zip(at, values, strict=True):
            out = F.when(pos == (a if a >= 0 else n + a), value_of(v).cast(p.type)).otherwise(out)
        return Vec(p.frame, out)
    i, v, k = fresh("i"), fresh("v"), fresh("k")
    t = p.type
    new = _session().createDataFrame([(a, j_, w.item()) for j_, (a, w) in enumerate(zip(at, values, strict=True))], f"{i} long, {k} long, {v} {T._parse_datatype_string(t.simpleString()).simpleString() if values.dtype.kind != 'i' else 'bigint'}")
    new = new.withColumn(i, F.when(F.col(i) < 0, F.col(i) + n).otherwise(F.col(i))).groupBy(i).agg(F.max_by(v, k).alias(v))  # the last of equal positions counts
    joined = p.frame.df.join(F.broadcast(new), pos == F.col(i), "left")  # as many rows as the sentence lists
    return Vec(Frame(joined, [], p.frame.pos, p.frame), F.when(F.col(i).isNull(), p.col).otherwise(F.col(v).cast(t)))


def agenda(verbs: list[Verb], pick_: Verb, y):
    """One of several verbs for each item, by a condition."""
    k = pick_.monad(y)
    if not isinstance(k, Vec):
        raise NotYet("an agenda of this argument")
    out = None
    for i, v in enumerate(verbs):
        r = v.monad(y)
        c = r.col if isinstance(r, Vec) else lit(r)
        hit = scalars.number(k.col, type_of(k)) == i
        out = F.when(hit, c) if out is None else out.when(hit, c)
    return Vec(y.frame, out, y.front, y.back)


def each(u: Verb, y):
    """u in every box: boxes are array columns."""
    if not isinstance(y, Vec) or not y.type.simpleString().startswith("array"):
        raise NotYet("each of a vector that holds no arrays")
    return on_rows(u, Mat(y.trimmed().frame, None, y.trimmed().col))


# actions


def plain(v):
    """A complex item as a number."""
    return complex(v["re"], v["im"]) if isinstance(v, Row) and v.asDict().keys() == {"re", "im"} else v


def gather(v) -> np.ndarray:
    """A distributed value as a local array; for results whose size is known to be small."""
    if isinstance(v, np.ndarray):
        return v
    if isinstance(v, Scalar):
        return np.asarray(plain(v.to_df().first()[0]))
    if isinstance(v, Tuple):
        return np.array(list(v.to_df().first()))
    if isinstance(v, Vec):
        found = v.to_df("v", "p").orderBy("p").collect()
        values = [plain(r["v"]) for r in found]
        if values and isinstance(values[0], str):
            return np.array(values, dtype=object) if any(len(s) != 1 for s in values) else np.array(values, "<U1")
        if values and isinstance(values[0], list):
            return obj(Box(np.array(r)) for r in values)
        return np.array(values) if values else np.zeros(0, np.int64)
    if isinstance(v, Mat):
        found = v.to_df(pos="p").orderBy("p").collect()
        out = frame_up([np.array(r[1] if v.cols is None else list(r)[1:]) for r in found], (len(found),))
        return out.T if v.turned else out
    raise NotYet("gathering this value")


def ends(v: Vec, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The first and last ``most`` items and how many lie between; all items first if there are none between."""
    p = v.placed()
    pos = F.col(q(p.frame.pos))
    head = gather(Vec(Frame(p.frame.df.where(pos < 2 * most + 1), [], p.frame.pos), p.col))
    if len(head) <= 2 * most:
        return head, head[:0], 0
    n = int(p.frame.df.agg(F.max(pos)).first()[0]) + 1
    tail = gather(Vec(Frame(p.frame.df.where(pos >= n - most).withColumn(p.frame.pos, pos - (n - most)), [], p.frame.pos), p.col))
    return head[:most], tail, n - 2 * most


def first_atom(v) -> np.ndarray:
    if isinstance(v, Vec):
        t = v.placed()
        row = t.frame.df.where(F.col(q(t.frame.pos)) == 0).select(t.col.alias("v")).first()
        return np.zeros(0) if row is None else np.asarray(row[0])
    return gather(v)


def same(a, b) -> bool:
    if isinstance(a, Distributed) and isinstance(b, Distributed) and isinstance(a, Vec) and isinstance(b, Vec):
        return bool(gather(match(a, b, False, False)))
    from ..functions.scalar import match as local_match

    return local_match(gather(a), gather(b))


def settle(v):
    """A vector whose lineage is cut, for loops over rounds: written to the shared checkpoint folder."""
    if not isinstance(v, Vec):
        return v
    df = checkpointed(v.to_df("v", "p"))
    return Vec(Frame(df, [], "p"), F.col("v"))
