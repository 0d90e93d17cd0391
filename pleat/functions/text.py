"""Boxes, characters, display and number formatting on local arrays."""

from __future__ import annotations

import math
import re
from fractions import Fraction

import numpy as np

from ..errors import DomainError, LengthError, NotYet, ParseError
from ..values import EMPTY, Box, Sparse, Sym, atom, chars, common, frame_up, ints, item, kind, obj


def box(y):
    return obj([Box(y)], ())


def open_box(y):
    return frame_up([b.v for b in y.ravel()], y.shape) if kind(y) == "box" and y.size else y


def raze(y):
    from .structural import append

    if kind(y) != "box" or not y.size:
        return y.reshape(-1)
    parts = [b.v for b in y.ravel()]
    rank = max(1, max(p.ndim for p in parts))
    out = None
    for p in parts:
        p = p.reshape((1,) * (rank - p.ndim) + p.shape) if p.ndim < rank and (p.ndim == 0 and rank == 1 or p.ndim > 0) else p
        if out is None:
            out = p if p.ndim else p.reshape(1)
        elif len(out) and len(p.shape) and not len(p):
            continue
        else:
            out = append(out, p) if out.size or len(out) else p
    return out


def link(x, y):
    left = box(x).reshape(1)
    right = y if kind(y) == "box" and (y.size or y.dtype.kind == "O") else box(y)
    return np.concatenate([left, right.reshape(1) if right.ndim == 0 else right])


def level(y) -> int:
    return 1 + max((level(b.v) for b in y.ravel()), default=0) if kind(y) == "box" and (y.size or y.dtype.kind == "O") else 0


def depth(y) -> int:
    if kind(y) == "box" and y.size:
        return 1 + max(depth(b.v) for b in y.ravel())
    return 0 if y.ndim == 0 else 1


def enlist(y):
    if kind(y) == "box" and y.size:
        from .structural import common_mixed

        parts = [enlist(b.v) for b in y.ravel()]
        parts = [p for p in parts if p.size] or parts[:1]
        return np.concatenate(common_mixed(parts))
    return y.reshape(-1)


def digits6(v: float, precision: int = 6, minus: str = "_") -> str:
    if math.isnan(v):
        return "_."
    if math.isinf(v):
        return "_" if v > 0 else "__"
    if v == 0:
        return "0"
    text = f"{v:.{precision}g}"
    if "e" in text:
        m, e = text.split("e")
        text = f"{m}e{minus if e[0] == '-' else ''}{int(e.lstrip('+-'))}"
    elif v == math.floor(v) and abs(v) < 10**precision:
        text = str(int(v))
    return text.replace("-", minus, 1) if text.startswith("-") else text


def show_number(v, precision: int = 6, minus: str = "_") -> str:
    if isinstance(v, (bool, np.bool_)):
        return str(int(v))
    if isinstance(v, Fraction):
        return f"{show_number(v.numerator, precision, minus)}r{v.denominator}"
    if isinstance(v, (int, np.integer)):
        return f"{minus if v < 0 else ''}{abs(int(v))}"
    if isinstance(v, (complex, np.complexfloating)):
        if v.imag == 0:
            return digits6(v.real, precision, minus)
        return f"{digits6(v.real, precision, minus)}{'j' if minus == '_' else 'J'}{digits6(v.imag, precision, minus)}"
    text = digits6(float(v), precision, minus)
    if minus != "_":
        text = text.replace("e", "E").replace("__", "¯∞").replace("_.", "NaN")
        text = "∞" if text == "_" else text
    return text


def lines_of(a: np.ndarray, precision: int = 6, minus: str = "_") -> list[str]:
    """Display of an array, one text a line; planes are parted by empty lines."""
    k = kind(a)
    if isinstance(a, Sparse) and a.ndim:
        return entry_lines(a, precision, minus)
    if not a.size and a.ndim >= 1:
        return [""] * (int(np.prod(a.shape[:-1])) if a.ndim > 1 and a.shape[-1] == 0 and np.prod(a.shape[:-1]) else 1) if a.ndim == 1 else [""] * int(np.prod(a.shape[:-1]))
    if k == "char":
        if a.ndim == 0:
            return [str(a[()])]
        rows = ["".join(r) for r in a.reshape(-1, a.shape[-1])]
        return planes(rows, a.shape)
    if k == "box":
        return box_lines(a, precision, minus)
    if k == "sym":
        cells = np.array(["`" + str(v) for v in a.ravel()], object)
    else:
        cells = np.array([show_number(v, precision, minus) for v in a.ravel()], object)
    if a.ndim == 0:
        return [cells[0]]
    table = cells.reshape(-1, a.shape[-1])
    if a.ndim == 1:
        return [" ".join(table[0])]
    width = [max(len(v) for v in col) for col in table.T]
    rows = [" ".join(v.rjust(w) for v, w in zip(row, width, strict=True)) for row in table]
    return planes(rows, a.shape)


def entry_lines(a: np.ndarray, precision: int, minus: str) -> list[str]:
    """Indices and values of a sparse array, one entry a line."""
    at = np.argwhere(np.asarray(a) != a.fill)
    if not len(at):
        return [""]
    left = np.array([[str(v) for v in row] for row in at], object)
    width = [max(len(v) for v in c) for c in left.T]
    values = [show_number(v, precision, minus) for v in np.asarray(a)[tuple(at.T)]]
    wide = max(len(v) for v in values)
    return [" ".join(v.rjust(w) for v, w in zip(row, width, strict=True)) + " | " + v.rjust(wide) for row, v in zip(left, values, strict=True)]


def planes(rows: list[str], shape: tuple[int, ...]) -> list[str]:
    out: list[str] = []
    for i, r in enumerate(rows):
        if i:
            n = 1
            for d in shape[-2:0:-1]:
                n *= d
                if i % n == 0:
                    out.append("")
        out.append(r)
    return out


def box_lines(a: np.ndarray, precision: int, minus: str) -> list[str]:
    shape = (1, 1) if a.ndim == 0 else (1, *a.shape) if a.ndim == 1 else a.shape
    table = a.reshape(-1, shape[-1])
    blank = lambda v: v.ndim > 1 and not v.size  # noqa: E731  an empty table is as wide as it has columns
    drawn = [[[" " * b.v.shape[-1]] * int(np.prod(b.v.shape[:-1])) if blank(b.v) else lines_of(b.v, precision, minus) for b in row] for row in table]
    width = [max([max([len(t) for t in row[c]] + [b.v.shape[-1] if blank(b.v) else 0], default=0) for row, own in zip(drawn, table, strict=True) for b in [own[c]]]) for c in range(shape[-1])]
    rule = "+" + "+".join("-" * w for w in width) + "+"
    out: list[str] = []
    per = shape[-2]
    for start in range(0, len(drawn), per):
        if start:
            out.append("")
            n = per
            for d in shape[-3:0:-1]:
                n *= d
                if start % n == 0:
                    out.append("")
        for row in drawn[start : start + per]:
            high = max(len(c) for c in row)
            out.append(rule)
            for i in range(high):
                out.append("|" + "|".join((c[i] if i < len(c) else "").ljust(w) for c, w in zip(row, width, strict=True)) + "|")
        out.append(rule)
    return out


def nested_lines(a: np.ndarray, precision: int = 10, minus: str = "¯") -> list[str]:
    """Display of the second notation: nested elements stand side by side, without a frame."""
    if kind(a) != "box" or not a.size:
        return lines_of(a, precision, minus)
    table = a.reshape(-1, a.shape[-1] if a.ndim else 1)
    drawn = [[nested_lines(b.v, precision, minus) if isinstance(b, Box) else [show_number(b, precision, minus)] for b in row] for row in table]
    width = [max(max((len(t) for t in row[c]), default=0) for row in drawn) for c in range(table.shape[1])]
    out: list[str] = []
    per = a.shape[-2] if a.ndim > 1 else 1
    for k, row in enumerate(drawn):
        if k and a.ndim > 2 and k % per == 0:
            out.append("")
        high = max(len(c) for c in row)
        for i in range(high):
            out.append("  ".join((c[i] if i < len(c) else "").ljust(w) for c, w in zip(row, width, strict=True)))
    return out


def display_nested(a: np.ndarray) -> str:
    return "\n".join(nested_lines(a))


def display(a: np.ndarray, precision: int = 6, minus: str = "_") -> str:
    return "\n".join(lines_of(a, precision, minus))


def format_chars(y, minus: str = "_"):
    """The characters that display y, shaped like it with lines along the last axis."""
    if kind(y) == "char":
        return y
    rows = lines_of(y, minus=minus)
    if y.ndim < 2 and kind(y) != "box":
        return chars(rows[0] if rows else "")
    rows = [r for r in rows if r or not y.size]
    width = max((len(r) for r in rows), default=0)
    out = np.array([list(r.ljust(width)) for r in rows], "<U1").reshape(len(rows), width)
    return out if y.ndim < 2 else out.reshape(*y.shape[:-2], -1, width)


def format_spec(x, y):
    """Fixed fields: x is w j d per column (or one for all); width 0 takes what is needed, a field too small is stars."""
    spec = np.atleast_1d(x)
    table = y.reshape(-1, y.shape[-1]) if y.ndim else y.reshape(1, 1)
    if len(spec) not in (1, table.shape[1]):
        raise LengthError("a field for every column is wanted")
    cols = []
    for c in range(table.shape[1]):
        v = spec[c if len(spec) > 1 else 0]
        w, d = (int(v.real), int(v.imag)) if isinstance(v, (complex, np.complexfloating)) else (int(v), 0)
        if w < 0 or d < 0:
            texts = [exponential(float(n), abs(d)) for n in table[:, c]]
            w = abs(w)
            texts = [(" " + t if not t.startswith("_") else t).ljust(w) if w else t for t in texts]
        else:
            texts = [_fixed(n, d) for n in table[:, c]]
        if w == 0:
            w = max(len(t) for t in texts) + (c > 0)
        cols.append([t.rjust(w) if len(t) <= w else "*" * w for t in texts])
    rows = ["".join(r) for r in zip(*cols, strict=True)]
    out = np.array([list(r) for r in rows], "<U1")
    return out[0] if y.ndim < 2 else out.reshape(*y.shape[:-1], -1)


def _fixed(n, d: int) -> str:
    if isinstance(n, (float, np.floating)) and not math.isfinite(n):
        return digits6(float(n))
    from decimal import ROUND_HALF_EVEN, Decimal

    text = str(Decimal(int(n) if isinstance(n, (int, np.integer)) else float(n)).quantize(Decimal(1).scaleb(-d), rounding=ROUND_HALF_EVEN)) if not isinstance(n, (bool, np.bool_)) else f"{int(n):.{d}f}"
    if float(text) == 0:
        text = text.lstrip("-")
    return text.replace("-", "_")


def exponential(v: float, d: int) -> str:
    m, e = f"{v:.{d}e}".split("e")
    return f"{m.replace('-', '_')}e{'_' if e[0] == '-' else ''}{int(e.lstrip('+-'))}"


NUMBER = re.compile(r"(?:_?\d+\.?\d*(?:e_?\d+)?|__?)(?![\w.])")


def number_word(w: str):
    """Value of one numeric word of J, or None."""
    if w in ("_", "__", "_."):
        return {"_": math.inf, "__": -math.inf, "_.": math.nan}[w]
    m = re.fullmatch(r"(_?\d+)x", w)
    if m:
        return ("exact", int(m[1].replace("_", "-")))
    m = re.fullmatch(r"(_?\d+)r(_?\d+)", w)
    if m:
        p, q = (int(g.replace("_", "-")) for g in m.groups())
        if q == 0:
            return math.copysign(math.inf, p) if p else 0
        f = Fraction(p, q)
        return ("exact", f.numerator if f.denominator == 1 else f)
    m = re.fullmatch(r"([^jrpxb]+|.*\d[pr]_?\d.*)j(a[dr])?(.+)|(.+)(a[dr])(.+)", w) if ("j" in w or "ad" in w or "ar" in w) else None
    if "ad" in w or "ar" in w:
        sep = "ad" if "ad" in w else "ar"
        a, b = (number_word(p) for p in w.split(sep, 1))
        if a is None or b is None:
            return None
        t = math.radians(b) if sep == "ad" else b
        return complex(a * math.cos(t), a * math.sin(t))
    if "j" in w and m:
        a, b = (number_word(p) for p in w.split("j", 1))
        if a is None or b is None or isinstance(a, complex) or isinstance(b, complex):
            return None
        return complex(_plain(a), _plain(b))
    if "b" in w:
        base, _, rest = w.partition("b")
        r = number_word(base)
        if r is None or not rest:
            return None
        r, neg, out, frac, scale = _plain(r), rest.startswith("_"), 0, False, 1.0
        for c in rest.lstrip("_"):
            if c == ".":
                frac = True
                continue
            v = int(c) if c.isdigit() else ord(c) - 87 if "a" <= c <= "z" else None
            if v is None:
                return None
            if frac:
                scale /= r
                out += v * scale
            else:
                out = out * r + v
        return -out if neg else out
    for sep, base in (("p", math.pi), ("x", math.e)):
        if sep in w:
            a, _, b = w.partition(sep)
            a, b = number_word(a), number_word(b)
            return None if a is None or b is None else _plain(a) * base ** _plain(b)
    m = re.fullmatch(r"_?\d+", w)
    if m:
        v = int(w.replace("_", "-"))
        return v if abs(v) < 1 << 63 else float(v)
    m = re.fullmatch(r"_?(\d+\.?\d*|\.\d+)(e_?\d+)?", w)
    if m:
        v = float(w.replace("_", "-"))
        return v
    return None


def _plain(v):
    return float(v[1]) if isinstance(v, tuple) else v


def number_list(words: list[str]) -> np.ndarray | None:
    values = [number_word(w) for w in words]
    if any(v is None for v in values):
        return None
    if any(isinstance(v, tuple) for v in values):
        if any(isinstance(v, (float, complex)) for v in values):
            values = [_plain(v) for v in values]
        else:
            values = [v[1] if isinstance(v, tuple) else v for v in values]
            return obj(values) if len(values) > 1 else obj(values, ())
    a = np.array(values)
    return a if len(values) > 1 else a.reshape(())


def parse_numbers(x, y):
    """Numbers spelled by a text, words that are none taken as x."""
    text = "".join(np.atleast_1d(y).tolist())
    out = []
    for w in text.replace("-", "_").split():
        v = number_word(w)
        out.append(x if v is None else atom(v[1]) if isinstance(v, tuple) else np.asarray(v))
    if not out:
        return EMPTY
    return out[0] if len(out) == 1 else frame_up(out, (len(out),))


WORD = re.compile(
    r"\s+|NB\.[^\n]*|'(?:[^']|'')*'|(?:_?\d[\w.]*|__?[\w.]*(?<=[\w.])|_)(?:\s+(?:_?\d[\w.]*|__?\.?(?![\w:])|_))*(?=\b|\s|$|[^\w.:]|_|(?<=\.))|[A-Za-z][A-Za-z0-9_]*[.:]*|\{\{(?:\)[a-z*])?|\}\}|[^\sA-Za-z0-9][.:]*"
)


def word_spans(text: str) -> list[tuple[str, int]]:
    """J words with their places; a run of numbers is one word, comments are left out."""
    out: list[tuple[str, int]] = []
    i, n = 0, len(text)
    while i < n:
        c = text[i]
        if c.isspace():
            if c == "\n":
                out.append(("\n", i))
            i += 1
            continue
        if text.startswith("NB.", i) and not text[i + 3 : i + 4] in (".", ":"):
            while i < n and text[i] != "\n":
                i += 1
            continue
        if c == "'":
            j = i + 1
            while True:
                j = text.find("'", j)
                if j < 0:
                    raise ParseError("an open quote", text, i)
                if text.startswith("''", j):
                    j += 2
                    continue
                break
            out.append((text[i : j + 1], i))
            i = j + 1
            continue
        if c.isdigit() or c == "_":
            m = re.compile(r"_?[0-9][A-Za-z0-9_.]*|__?\.?[A-Za-z0-9_.]*").match(text, i)
            word = m[0]
            if text.startswith(":", i + len(word)) and re.fullmatch(r"_?\d|_", word):
                j = i + len(word) + 1
                while j < n and text[j] in ".:":
                    j += 1
                out.append((text[i:j], i))
                i = j
                continue
            if text.startswith(":", i + len(word)) and re.fullmatch(r"__?[0-9]?", word) is None and not word[0].isdigit():
                word += ":"
            prev = out[-1] if out else None
            if prev and _numeric(prev[0]) and text[prev[1] + len(prev[0]) : i].strip(" \t") == "" and "\n" not in text[prev[1] : i]:
                out[-1] = (text[prev[1] : i + len(word)], prev[1])
            else:
                out.append((word, i))
            i += len(word)
            continue
        if c.isalpha():
            m = re.compile(r"[A-Za-z][A-Za-z0-9_]*").match(text, i)
            j = m.end()
            while j < n and text[j] in ".:":
                j += 1
            out.append((text[i:j], i))
            i = j
            continue
        if text.startswith("{{", i) and not text.startswith("{{.", i) and not text.startswith("{{:", i):
            j = i + 2
            if j < n and text[j] == ")" and j + 1 < n:
                j += 2
            out.append((text[i:j], i))
            i = j
            continue
        if text.startswith("}}", i) and text[i + 2 : i + 3] not in (".", ":"):
            out.append(("}}", i))
            i += 2
            continue
        if c == "{" and (m := re.compile(r"\{[A-Za-z_][A-Za-z0-9_]*\}(?![.:])").match(text, i)):
            out.append((m[0], i))
            i = m.end()
            continue
        j = i + 1
        while j < n and text[j] in ".:":
            j += 1
        out.append((text[i:j], i))
        i = j
    return out


def _numeric(w: str) -> bool:
    return bool(w) and (w[0].isdigit() or w[0] == "_") and not w.endswith(":")


def words(y):
    text = "".join(np.atleast_1d(y).tolist()) if y.size else ""
    return obj(Box(chars(w) if len(w) != 1 else np.array([w], "<U1")) for w, _ in word_spans(text) if w != "\n")


def unicode_of(y):
    if kind(y) == "char":
        return y
    return np.array([chr(int(v)) for v in ints(y).ravel()], "<U1").reshape(y.shape)


def unicode_form(x, y):
    k = int(x[()])
    if k == 3:
        return np.array([ord(c) for c in y.ravel()], np.int64).reshape(y.shape)
    if k == 10 or k == 4:
        return unicode_of(y)
    raise NotYet(f"form {k} of u:")


def symbols(y):
    if kind(y) == "box" and y.size:
        return obj((Sym("".join(np.atleast_1d(b.v).tolist())) for b in y.ravel()), y.shape)
    if kind(y) == "char" and y.ndim > 1:
        return obj((Sym("".join(r).rstrip(" ")) for r in y.reshape(-1, y.shape[-1])), y.shape[:-1])
    if kind(y) == "char":
        text = "".join(np.atleast_1d(y).tolist())
        parts = text[1:].split(text[0]) if text else []
        return obj(Sym(p) for p in parts)
    raise DomainError("symbols are made of text")


def symbol_form(x, y):
    k = int(x[()])
    if k == 5:
        return obj((Box(chars(str(v))) for v in y.ravel()), y.shape)
    if k == 4:
        width = max((len(v) for v in y.ravel()), default=0)
        return np.array([list(str(v).ljust(width)) for v in y.ravel()], "<U1").reshape(*y.shape, width)
    raise NotYet(f"form {k} of s:")


def fetch(x, y):
    path = [b.v for b in np.atleast_1d(x)] if kind(x) == "box" and x.size else [x] if x.ndim == 0 or not x.size else [item(x, i) for i in range(len(x))] if x.ndim else [x]
    if kind(x) != "box":
        path = [x]
    from .structural import from_items, select

    for n, p in enumerate(path):
        if not p.size and y.ndim == 0:
            got = y
        else:
            got = from_items(p, y) if p.ndim == 0 else select(p, y)
        y = got[()].v if kind(got) == "box" and got.ndim == 0 else got
        if n + 1 < len(path) and kind(got) != "box":
            pass
    return y


def map_paths(y, path=()):
    if kind(y) != "box" or not y.size:
        return obj([Box(p) for p in path]) if path else box(EMPTY)[()].v
    out = []
    for at in np.ndindex(y.shape):
        here = np.asarray(at[0]) if len(at) == 1 else np.array(at, np.int64)
        out.append(Box(map_paths(y[at].v, (*path, np.atleast_1d(here) if len(at) != 1 else here))))
    return obj(out, y.shape)


def sequential_machine(x, y):
    """A table-driven tokeniser; x is f;s;m;ijrd, results in the forms 0 to 5 of f."""
    parts = [b.v for b in np.atleast_1d(x)]
    form = int(parts[0][()])
    states = ints(parts[1])
    classes = parts[2] if len(parts) > 2 and parts[2].size else None
    i, j, r, d = (list(ints(parts[3]).ravel()) + [0, -1, 0, -1][len(parts[3].ravel()):] if len(parts) > 3 else [0, -1, 0, -1])
    if classes is None:
        codes = [int(v) for v in ints(y).ravel()]
    elif kind(classes) == "box":
        table: dict = {}
        for k, b in enumerate(classes.ravel()):
            for c in np.atleast_1d(b.v).ravel():
                table.setdefault(c, k)
        codes = [table.get(c, classes.size) for c in y.ravel()]
    else:
        codes = [int(ints(classes).ravel()[ord(c)]) for c in y.ravel()]
    out: list = []
    trace = []

    def emit(lo, hi, cell):
        if form == 5:
            return
        if form == 0:
            out.append(Box(y[lo:hi]))
        elif form == 1:
            out.append(y[lo:hi])
        elif form == 2:
            out.append([lo, hi - lo])
        elif form == 3:
            out.append(cell)
        elif form == 4:
            out.append([lo, hi - lo, cell])

    cols = states.shape[1]
    n = len(codes)
    stop = False
    while i < n and not stop:
        c = codes[i]
        new, op = int(states[r, c, 0]), int(states[r, c, 1])
        cell = c + cols * r
        if form == 5:
            trace.append([i, j, r, c, new, op])
        if op in (4, 5):
            raise NotYet("vector codes of the sequential machine")
        if op in (2, 3) and j < 0:
            raise DomainError("a word ends that has not begun")
        if op == 1:
            j = i
        elif op == 2:
            emit(j, i, cell)
            j = i
        elif op == 3:
            emit(j, i, cell)
            j = -1
        elif op == 6:
            stop = True
        r = new
        i += 1
    if not stop:
        if d >= 0 and j >= 0:
            new, op = int(states[r, d, 0]), int(states[r, d, 1])
            if op in (2, 3):
                emit(j, n, d + cols * r)
        elif d < 0 and j >= 0:
            emit(j, n, cols * r)
    if form == 5:
        return np.array(trace, np.int64).reshape(-1, 6)
    if form == 0:
        return obj(out)
    if form == 1:
        return np.concatenate(common(out)) if out else y[:0]
    return np.array(out, np.int64).reshape(-1) if form == 3 else np.array(out, np.int64).reshape(len(out), 3 if form == 4 else 2)


