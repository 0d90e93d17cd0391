"""APL notation: tokens, operator binding and evaluation from the right."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np

from ..errors import DomainError, LanguageError, LimitError, NotYet, ParseError, Sandboxed, ValueUnknown
from ..functions import text
from ..operators import apl_verbs as a
from ..operators import derived as d
from ..operators.verb import Distributed, Verb
from ..values import EMPTY, chars, kind
from .dialect import STANDARD, Dialect

MONADIC = "/⌿\\⍀⍨¨⌸"
DYADIC = ".∘⍤⍥⍣⌺⍠⍛⍢@"
FUNCTIONS = "+-×÷*⍟⌈⌊|=<≤>≥≠∧∨⍲⍱!○?⌹⍴,⍪⌽⊖⍉↑↓⊂⊆⊃⌷⊥⊤⍳⍸∊⍷∪∩⍋⍒≡≢⍕⍎⊢⊣~"
NUMBER = re.compile(r"¯?(?:\d+\.?\d*|\.\d+)(?:[eE]¯?\d+)?|¯?∞")
NAME = re.compile(r"[A-Za-z_∆⍙][A-Za-z0-9_∆⍙]*")
QUAD = re.compile(r"⎕[A-Za-z]*")
MOST_DEPTH, MOST_STEPS = 64, 1 << 22
CLOSED = frozenset("⎕TS ⎕AI ⎕FIO ⎕SH ⎕DL ⎕NC ⎕EX ⎕SVO".split())


class Tok:
    __slots__ = ("kind", "v", "at")

    def __init__(self, kind_: str, v, at: int):
        self.kind, self.v, self.at = kind_, v, at


def number(w: str):
    w = w.replace("¯", "-").replace("∞", "inf")
    try:
        v = int(w)
        return v if abs(v) < 1 << 63 else float(v)
    except ValueError:
        return float(w)


def tokens(src: str) -> list[Tok]:
    out: list[Tok] = []
    i, n = 0, len(src)
    while i < n:
        c = src[i]
        if c == "⍝":
            while i < n and src[i] != "\n":
                i += 1
            continue
        if c in "⋄\n":
            out.append(Tok("end", c, i))
            i += 1
            continue
        if c.isspace():
            i += 1
            continue
        if c == "'" or c == '"':
            j, s = i + 1, ""
            while True:
                if j >= n:
                    raise ParseError("an open quote", src, i)
                if src[j] == c:
                    if src[j + 1 : j + 2] == c:
                        s += c
                        j += 2
                        continue
                    break
                s += src[j]
                j += 1
            out.append(Tok("value", np.array(s, "<U1") if len(s) == 1 else chars(s), i))
            i = j + 1
            continue
        if c == "{" and (m := re.compile(r"\{([A-Za-z_][A-Za-z0-9_]*)\}").match(src, i)):
            out.append(Tok("hole", m[1], i))
            i = m.end()
            continue
        if m := NUMBER.match(src, i):
            v = number(m[0])
            i2 = m.end()
            if src[i2 : i2 + 1] in "jJ" and (m2 := NUMBER.match(src, i2 + 1)) and src[i2 : i2 + 1]:
                v = complex(v, number(m2[0]))
                i2 = m2.end()
            out.append(Tok("number", v, i))
            i = i2
            continue
        if c == "⎕":
            w = QUAD.match(src, i)[0].upper()
            out.append(Tok("quad", w, i))
            i += len(w)
            continue
        if c == "⍞":
            out.append(Tok("quad", c, i))
            i += 1
            continue
        if m := NAME.match(src, i):
            out.append(Tok("name", m[0], i))
            i = m.end()
            continue
        if src.startswith("⍺⍺", i) or src.startswith("⍵⍵", i):
            out.append(Tok("name", src[i : i + 2], i))
            i += 2
            continue
        if c in "⍺⍵":
            out.append(Tok("name", c, i))
            i += 1
            continue
        if c == "∇":
            out.append(Tok("name", c, i))
            i += 1
            continue
        if c == "⍬":
            out.append(Tok("value", EMPTY, i))
            i += 1
            continue
        if c in "()[]{};:←→":
            out.append(Tok(c, c, i))
            i += 1
            continue
        if c in MONADIC or c in DYADIC:
            out.append(Tok("op", c, i))
            i += 1
            continue
        if c in FUNCTIONS:
            out.append(Tok("fn", "⋆" if c == "*" else c, i))
            i += 1
            continue
        raise ParseError(f"{c} is no word of the language", src, i)
    return out


class Val:
    """A value in a sentence, or the name it will be read from."""

    __slots__ = ("v", "name", "index", "strand", "group")

    def __init__(self, v=None, name: str | None = None, strand: bool = True, group: bool = False):
        self.v, self.name, self.index, self.strand, self.group = v, name, None, strand, group


class Signal(Exception):
    def __init__(self, v):
        self.v = v


class Jump(Exception):
    def __init__(self, line):
        self.line = line


class Machine:
    """One run of a program."""

    def __init__(self, holes: dict | None = None, out: Callable[[str], None] | None = None, read: Callable[[], str] | None = None, dialect: Dialect = STANDARD):
        self.holes, self.read = holes or {}, read
        self.out = out or (lambda s: print(s, end=""))
        self.dialect = dialect
        self.origin = dialect.origin
        self.scopes: list[dict] = [{}]
        self.depth = 0
        self.src = ""
        self._prims: dict[int, dict[str, Verb]] = {}

    @property
    def prims(self) -> dict[str, Verb]:
        if self.origin not in self._prims:
            p = a.primitives(self.origin)
            p["⍎"] = Verb("⍎", lambda y: self.execute("".join(np.ravel(y).tolist())), None)
            if self.dialect.up_mixes:
                p["↑"] = a.wh("↑", a.mix, a.take)
                p["⊃"] = a.wh("⊃", a.first, a.pick)
            self._prims[self.origin] = p
        return self._prims[self.origin]

    # names

    def get(self, name: str):
        for s in reversed(self.scopes):
            if name in s:
                return s[name]
        return None

    def put(self, name: str, v) -> None:
        for s in reversed(self.scopes):
            if name in s:
                s[name] = v
                return
        self.scopes[-1][name] = v

    # programs

    def run_text(self, src: str):
        before, self.src = self.src, src
        try:
            src2 = self.tradfns(src)
            self.src = src2
            last = None
            for line in lines(tokens(src2)):
                if line:
                    last = self.line(line)
            return last
        finally:
            self.src = before

    def execute(self, src: str):
        v = self.run_text(src)
        return EMPTY if v is None else v

    def line(self, toks: list[Tok]):
        v, quiet = self.sentence(toks)
        return None if quiet else v

    def tradfns(self, src: str) -> str:
        """Definitions between ∇ lines are kept and cut out."""
        if "∇" not in src or "\n" not in src:
            return src
        out, rows, i = [], src.split("\n"), 0
        while i < len(rows):
            r = rows[i].strip()
            if r.startswith("∇") and len(r) > 1:
                j = i + 1
                while j < len(rows) and rows[j].strip() != "∇":
                    j += 1
                if j == len(rows):
                    raise ParseError("a definition without its end", src, 0)
                self.fix(r[1:].strip(), rows[i + 1 : j])
                i = j + 1
                continue
            out.append(rows[i])
            i += 1
        return "\n".join(out)

    def fix(self, header: str, body: list[str]) -> str:
        head, *local = [p.strip() for p in header.split(";")]
        result = None
        if "←" in head:
            result, head = (p.strip() for p in head.split("←"))
        words = head.split()
        names = {1: (None, words[0], None), 2: (None, words[0], words[1]) if len(words) > 1 else None, 3: tuple(words)}[len(words)]
        left, name, right = names
        labels, code = {}, []
        for k, row in enumerate(body):
            m = re.match(r"\s*([A-Za-z]\w*):", row)
            if m and not row.strip().startswith(":"):
                labels[m[1]] = np.asarray(k + 1)
                row = row[m.end() :]
            code.append(row)
        from .apl_control import structure

        plan = structure(code)

        def call(x, y):
            own = dict(labels)
            for v in (result, *local):
                if v:
                    own[v] = None
            if right:
                own[right] = y
            if left and x is not None:
                own[left] = x
            elif left:
                own[left] = None
            return self.framed(own, lambda: self.steps(code, plan, result))

        if right is None:
            self.put(name, ("niladic", lambda: call(None, None)))
        else:
            self.put(name, d.derived("Explicit", name, lambda y: call(None, y), (lambda x, y: call(x, y)) if left else None, (name,)))
        return name

    def framed(self, own: dict, f):
        self.depth += 1
        if self.depth > MOST_DEPTH:
            self.depth -= 1
            raise LimitError("recursion is too deep")
        self.scopes.append(own)
        try:
            return f()
        finally:
            self.scopes.pop()
            self.depth -= 1

    def steps(self, code: list[str], plan, result):
        from .apl_control import run_plan

        try:
            run_plan(self, plan, code)
        except Signal:
            pass
        if result is None:
            return EMPTY
        v = self.scopes[-1].get(result)
        if v is None:
            raise ValueUnknown(f"{result} was not set")
        return v

    def run_line(self, row: str):
        """One line of a definition; a branch gives the line to go to."""
        before, self.src = self.src, row
        try:
            for toks in lines(tokens(row)):
                if not toks:
                    continue
                if toks[0].kind == "→":
                    if len(toks) == 1:
                        raise Signal(None)
                    v, _ = self.sentence(toks[1:])
                    if np.size(v):
                        raise Jump(int(np.ravel(v)[0]))
                    continue
                v, quiet = self.sentence(toks)
                if not quiet and v is not None and not isinstance(v, Verb):
                    self.show(v)
        finally:
            self.src = before

    def show(self, v) -> None:
        v = v if isinstance(v, np.ndarray) else d.lower().gather(v)
        self.out(text.display_nested(v) + "\n")

    # sentences

    def sentence(self, toks: list[Tok]):
        parts = self.group(toks)
        return self.evaluate(parts)

    def group(self, toks: list[Tok]) -> list:
        """Values, functions, operators and brackets of a sentence, groups evaluated."""
        parts, i = [], 0
        while i < len(toks):
            t = toks[i]
            if t.kind == "number":
                parts.append(Val(np.asarray(t.v)))
            elif t.kind == "value":
                parts.append(Val(t.v))
            elif t.kind == "hole":
                if t.v not in self.holes:
                    raise ValueUnknown(f"nothing is bound to {{{t.v}}}", self.src, t.at)
                parts.append(Val(self.holes[t.v], group=True))
            elif t.kind == "name":
                parts.append(self.name(t))
            elif t.kind == "fn":
                parts.append(self.prims[t.v])
            elif t.kind == "op":
                parts.append(t)
            elif t.kind == "quad":
                parts.append(self.quad(t))
            elif t.kind == "←":
                parts.append(t)
            elif t.kind in "([{":
                j = close_of(toks, i, self.src)
                inner = toks[i + 1 : j]
                if t.kind == "(":
                    v, _ = self.sentence(inner)
                    parts.append(v if isinstance(v, (Verb, tuple)) else Val(v, group=True))
                elif t.kind == "{":
                    parts.append(self.dfn(inner))
                else:
                    slots = split(inner, ";")
                    parts.append(("[", slots, t.at))
                i = j
            elif t.kind == "→":
                raise ParseError("a branch stands at the start of a line", self.src, t.at)
            else:
                raise ParseError(f"{t.v} stands alone", self.src, t.at)
            i += 1
        return self.bind(self.brackets(parts))

    def name(self, t: Tok):
        v = self.get(t.v)
        if t.v == "∇":
            if v is None:
                raise ParseError("no function to refer to", self.src, t.at)
            return v
        if isinstance(v, Verb):
            return v
        if isinstance(v, tuple) and v[0] == "niladic":
            return Val(v[1](), group=True)
        if isinstance(v, tuple):
            return v
        return Val(name=t.v)

    def quad(self, t: Tok):
        w = t.v
        if w == "⎕IO":
            return Val(name="⎕IO")
        if w == "⎕CT":
            return Val(np.asarray(1e-13))
        if w == "⎕A":
            return Val(chars("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        if w == "⎕D":
            return Val(chars("0123456789"))
        if w == "⎕UCS":
            return Verb("⎕UCS", lambda y: np.array([ord(c) for c in y.ravel()], np.int64).reshape(y.shape) if kind(y) == "char" else text.unicode_of(y), None)
        if w == "⎕FX":
            return Verb("⎕FX", self.fix_value, None)
        if w in ("⎕", "⍞"):
            return Val(name=w)
        if w in CLOSED:
            raise Sandboxed(f"{w} reaches outside", self.src, t.at)
        raise NotYet(w, self.src, t.at)

    def fix_value(self, y):
        rows = ["".join(np.ravel(b.v).tolist()) for b in y.ravel()] if kind(y) == "box" else ["".join(r).rstrip() for r in np.atleast_2d(y)]
        return chars(self.fix(rows[0], rows[1:]))

    def brackets(self, parts: list) -> list:
        out: list = []
        for p in parts:
            if isinstance(p, tuple) and p and p[0] == "[":
                if not out:
                    raise ParseError("an index without an array", self.src, p[2])
                last = out[-1]
                if isinstance(last, Val):
                    if last.index is not None:
                        out[-1] = Val(self.value(last), group=True)
                        last = out[-1]
                    last.index = p
                else:
                    out.append(("axis", p))
            else:
                out.append(p)
        return out

    def bind(self, parts: list) -> list:
        """Operators with their operands."""
        out: list = []
        i = 0
        while i < len(parts):
            p = parts[i]
            if isinstance(p, Tok) and p.kind == "op":
                if p.v in MONADIC:
                    left = out[-1] if out else None
                    if isinstance(left, Verb):
                        out[-1] = self.monadic(p, left)
                    elif isinstance(left, Val) and p.v in "/⌿\\⍀":
                        out.append(self.slash(p.v))
                    elif isinstance(left, Val) and p.v == "⍨":
                        out[-1] = d.constant(self.value(left))
                    elif p.v in "/⌿\\⍀":
                        out.append(self.slash(p.v))
                    else:
                        raise ParseError(f"{p.v} has no operand", self.src, p.at)
                else:
                    if p.v == "∘" and i + 1 < len(parts) and isinstance(parts[i + 1], Tok) and parts[i + 1].v == ".":
                        f, i = self.operand(parts, i + 2, p)
                        out.append(a.outer(f))
                        i += 1
                        continue
                    if not out:
                        raise ParseError(f"{p.v} has no left operand", self.src, p.at)
                    g, i = self.operand(parts, i + 1, p)
                    left = out.pop()
                    out.append(self.dyadic(p, left, g))
            elif isinstance(p, tuple) and p[0] == "axis":
                axis = self.index_values(p[1])[0]
                k = float(np.ravel(axis)[0]) - self.origin
                if not isinstance(out[-1], Verb):
                    raise ParseError("an axis of no function", self.src, 0)
                if k != math.floor(k):
                    out[-1] = laminate(k)
                else:
                    out[-1] = a.along(out[-1], int(k))
            elif isinstance(p, tuple) and p[0] in ("adv", "conj") and (not out or isinstance(out[-1], Tok)):
                out.append(p)
            elif isinstance(p, tuple) and p[0] in ("adv", "conj"):
                left = out.pop()
                left = left if isinstance(left, Verb) else self.value(left)
                if p[0] == "adv":
                    out.append(p[1](left))
                else:
                    g, i = self.operand(parts, i + 1, None)
                    out.append(p[1](left, g if isinstance(g, Verb) else g))
            else:
                out.append(p)
            i += 1
        return out

    def operand(self, parts, i, op):
        if i >= len(parts):
            raise ParseError("an operator without its right operand", self.src, op.at if op else 0)
        g = parts[i]
        if isinstance(g, Tok) and g.kind == "op" and g.v in "/⌿\\⍀":
            g = self.slash(g.v)
        if isinstance(g, Val):
            j = i + 1  # a right operand of numbers is a strand
            got = [g]
            if op is not None and op.v in "⍤⌺⍣⍠" and not g.group:
                while j < len(parts) and isinstance(parts[j], Val) and not parts[j].group and op.v in "⍤" and np.ndim(parts[j].v) == 0 and isinstance(parts[j].v, np.ndarray) and len(got) < 3 and j + 1 < len(parts) and isinstance(parts[j + 1], Val):
                    got.append(parts[j])
                    j += 1
            v = self.value(got[0]) if len(got) == 1 else self.strand(got)
            return v, j - 1
        # a function operand takes its own monadic operators only in parentheses
        return g, i

    def slash(self, w: str) -> Verb:
        axis = -1 if w in "/\\" else 0
        if w in "/⌿":
            return Verb(w, None, lambda x, y: a.replicate(x, y, axis), extra={"apl": True})
        return Verb(w, None, lambda x, y: a.expand(x, y, axis), extra={"apl": True})

    def monadic(self, p: Tok, f: Verb) -> Verb:
        if p.v in "/⌿":
            return a.reduce_axis(f, -1 if p.v == "/" else 0, f"{f}{p.v}")
        if p.v in "\\⍀":
            return a.scan_axis(f, -1 if p.v == "\\" else 0, f"{f}{p.v}")
        if p.v == "⍨":
            return d.commute(f)
        if p.v == "¨":
            return a.each(f)
        return a.key(f, self.origin)

    def dyadic(self, p: Tok, f, g) -> Verb:
        f = f if isinstance(f, Verb) else self.value(f)
        if p.v == ".":
            if not isinstance(f, Verb) or not isinstance(g, Verb):
                raise DomainError("functions are wanted on both sides")
            return a.inner(f, g)
        if p.v == "∘":
            return a.beside(f, g)
        if p.v == "⍤":
            return d.atop(f, g) if isinstance(g, Verb) else a.ranked(f, g)
        if p.v == "⍥":
            return d.compose(f, g)
        if p.v == "⍣":
            return a.power(f, g)
        if p.v == "⌺":
            return a.stencil(f, g)
        if p.v == "⍛":
            return a.before(f, g)
        if p.v == "⍢":
            return d.under(f, g, False)
        if p.v == "⍠":
            return self.variant(f, g)
        raise NotYet(p.v, self.src, p.at)

    def variant(self, f: Verb, g):
        """A function under another comparison tolerance or index origin."""
        pairs = [g] if kind(g) != "box" or kind(g.ravel()[0].v) == "char" else [b.v for b in g.ravel()]
        for pr in pairs:
            name, v = ("".join(np.ravel(pr.ravel()[0].v).tolist()), pr.ravel()[1].v) if kind(pr) == "box" else ("CT", pr)
            if name == "IO":
                own = a.primitives(int(v))
                f = own.get(f.name, f)
            elif name == "CT":
                f = d.fit(f, np.asarray(float(np.ravel(v)[0])))
            else:
                raise NotYet(f"the variant {name}")
        return f

    # values

    def value(self, p: Val):
        if p.name is not None and p.v is None:
            if p.name == "⎕IO":
                v = np.asarray(self.origin)
            elif p.name == "⍞":
                v = chars(self.input())
            elif p.name == "⎕":
                v = self.execute(self.input())
            else:
                v = self.get(p.name)
            if v is None:
                raise ValueUnknown(f"{p.name} has no value")
            if isinstance(v, Verb):
                raise ParseError(f"{p.name} is a function")
        else:
            v = p.v
        if v is None:
            raise ValueUnknown("a value is missing")
        if p.index is not None:
            v = self.indexed(v, p.index)
        return v

    def input(self) -> str:
        if self.read is None:
            raise Sandboxed("no input is connected")
        return self.read()

    def index_values(self, p):
        return [self.sentence(s)[0] if s else None for s in reversed(p[1])][::-1]

    def indexed(self, v, p):
        axes = self.index_values(p)
        if isinstance(v, Distributed):
            if len(axes) != 1:
                raise NotYet("this index of a distributed value")
            return d.lower().pick(axes[0] - self.origin if isinstance(axes[0], np.ndarray) else axes[0], v)
        return a.index(v, axes, self.origin)

    def strand(self, parts: list[Val]):
        got = [self.value(p) for p in reversed(parts)][::-1]
        if len(got) == 1:
            return got[0]
        if any(isinstance(g, Distributed) for g in got):
            raise NotYet("a strand of distributed values")
        return a.nested(got, (len(got),))

    def evaluate(self, parts: list):
        if not parts:
            raise ParseError("an empty sentence", self.src, 0)
        quiet = False
        if not any(isinstance(p, Val) for p in parts) and not any(isinstance(p, Tok) for p in parts):
            return train(parts), False
        if len(parts) > 2 and isinstance(parts[0], Val) and isinstance(parts[1], Tok) and parts[1].kind == "←" and not any(isinstance(p, (Val, Tok)) for p in parts[2:]):
            f = train(parts[2:])
            self.scopes[-1][parts[0].name] = f
            return f, True
        i = len(parts) - 1
        if not isinstance(parts[i], Val):
            if all(not isinstance(p, Tok) for p in parts):
                return train([p if not isinstance(p, Val) else self.value(p) for p in parts]), False
            raise ParseError("a function without its argument", self.src, 0)
        right, i = self.values_at(parts, i)
        while i >= 0:
            p = parts[i]
            if isinstance(p, Tok) and p.kind == "←":
                i -= 1
                if i < 0 or not isinstance(parts[i], Val):
                    if i >= 0 and isinstance(parts[i], Verb) and i - 1 >= 0 and isinstance(parts[i - 1], Val):
                        target = parts[i - 1]
                        right = parts[i].dyad(self.value(target), right)
                        self.store(target, right)
                        i -= 2
                        quiet = i < 0
                        continue
                    if i >= 0 and isinstance(parts[i], Verb):
                        raise ParseError("an assignment to a function", self.src, 0)
                    raise ParseError("an assignment to nothing", self.src, 0)
                self.store(parts[i], right)
                i -= 1
                quiet = i < 0
                continue
            if not isinstance(p, Verb):
                raise ParseError("the sentence does not parse", self.src, 0)
            i -= 1
            try:
                if i >= 0 and isinstance(parts[i], Val):
                    left, i = self.values_at(parts, i)
                    right = p.dyad(left, right)
                else:
                    right = p.monad(right)
            except LanguageError as e:
                if e.at is None:
                    e.source, e.at = self.src, 0
                raise
            except (TypeError, ValueError, IndexError, KeyError, ArithmeticError, MemoryError) as e:  # arguments that no rule above foresees
                raise DomainError(str(e), self.src, 0) from e
            quiet = False
        return right, quiet

    def values_at(self, parts, i):
        j = i
        while j > 0 and isinstance(parts[j - 1], Val):
            j -= 1
        return self.strand(parts[j : i + 1]), j - 1

    def store(self, target: Val, v) -> None:
        if target.name is None:
            raise ParseError("an assignment needs a name", self.src, 0)
        if target.name == "⎕IO":
            self.origin = int(np.ravel(v)[0])
            return
        if target.name in ("⎕", "⍞"):
            v2 = v if isinstance(v, np.ndarray) else d.lower().gather(v)
            self.out(text.display_nested(v2) + ("\n" if target.name == "⎕" else ""))
            return
        if target.name == "⍺" and self.get("⍺") is not None and target.index is None:
            return
        if target.index is not None:
            axes = self.index_values(target.index)
            old = self.get(target.name)
            if old is None:
                raise ValueUnknown(f"{target.name} has no value")
            if isinstance(old, Distributed):
                if len(axes) != 1 or axes[0] is None or isinstance(v, Distributed):
                    raise NotYet("this indexed assignment to a distributed value")
                self.store(Val(name=target.name), d.lower().amend(v, np.asarray(axes[0]) - self.origin, old))
                return
            where = np.arange(old.size).reshape(old.shape)
            at = a.index(where, axes, self.origin)
            from ..functions.structural import common_mixed

            if np.size(v) != 1 and np.shape(v) != np.shape(at):
                from ..errors import LengthError

                raise LengthError("values and places do not agree")
            new, flat = common_mixed([np.broadcast_to(v if np.size(v) != 1 else np.reshape(v, ()), np.shape(at)), old])
            flat = flat.reshape(-1).copy()
            flat[np.ravel(at)] = np.ravel(new)
            v = flat.reshape(old.shape)
        if target.name in ("⍺",):
            self.scopes[-1]["⍺"] = v
            return
        if len(self.scopes) > 1 and target.name not in self.scopes[-1] and getattr(self, "_dfn", 0):
            self.scopes[-1][target.name] = v
        else:
            self.put(target.name, v)

    # direct functions

    def dfn(self, toks: list[Tok]):
        stmts = [s for s in lines(toks) if s]
        words = {t.v for t in toks if t.kind == "name"}
        src = self.src

        def make(extra: dict):
            def call(x, y):
                own = {"⍵": y, "∇": me, **extra}
                own["⍺"] = x
                return self.framed(own, run)

            def run():
                before, self.src, deep = self.src, src, getattr(self, "_dfn", 0)
                self._dfn = deep + 1
                try:
                    v = None
                    for s in stmts:
                        k = next((i for i, t in enumerate(s) if t.kind == ":" and level_zero(s, i)), None)
                        if k is not None:
                            c, _ = self.sentence(s[:k])
                            if d.truth(c):
                                return self.sentence(s[k + 1 :])[0]
                            continue
                        if s[0].kind == "name" and s[0].v == "⍺" and len(s) > 1 and s[1].kind == "←" and self.scopes[-1].get("⍺") is not None:
                            continue
                        v, quiet = self.sentence(s)
                        if not quiet:
                            return v
                    return v if v is not None else EMPTY
                finally:
                    self.src, self._dfn = before, deep

            me = d.derived("Explicit", "{…}", lambda y: call(None, y), lambda x, y: call(x, y), ())
            return me

        if "⍵⍵" in words:
            return ("conj", lambda f, g: make({"⍺⍺": f, "⍵⍵": g}))
        if "⍺⍺" in words:
            return ("adv", lambda f: make({"⍺⍺": f}))
        return make({})


def level_zero(toks: list[Tok], k: int) -> bool:
    deep = 0
    for t in toks[:k]:
        deep += (t.kind in "([{") - (t.kind in ")]}")
    return deep == 0


def laminate(k: float) -> Verb:
    at = int(math.floor(k)) + 1
    return a.wh(",", None, lambda x, y: np.stack(a.common([np.broadcast_to(x, y.shape) if x.ndim == 0 else x, np.broadcast_to(y, x.shape) if y.ndim == 0 else y]), at))


def train(parts: list) -> Verb:
    """Two functions are an atop, three a fork, from the right; a value may be a left tine."""
    parts = [p for p in parts]
    if any(isinstance(p, tuple) for p in parts):
        if len(parts) == 1:
            return parts[0]
        raise ParseError("an operator without its operand")
    if len(parts) == 1:
        return parts[0]
    if len(parts) == 2:
        if not isinstance(parts[0], Verb):
            raise ParseError("a value has no function to its right")
        return d.atop(parts[0], parts[1])
    out, rest = d.fork(parts[-3], parts[-2], parts[-1]), parts[:-3]
    while rest:
        if len(rest) == 1:
            return d.atop(rest[0], out)
        out, rest = d.fork(rest[-2], rest[-1], out), rest[:-2]
    return out


def lines(toks: list[Tok]) -> list[list[Tok]]:
    out: list[list[Tok]] = [[]]
    deep = 0
    for t in toks:
        deep += (t.kind in "([{") - (t.kind in ")]}")
        if t.kind == "end" and deep == 0:
            out.append([])
        else:
            out[-1].append(t)
    return out


def close_of(toks: list[Tok], i: int, src: str) -> int:
    deep = 0
    for j in range(i, len(toks)):
        if toks[j].kind in "([{":
            deep += 1
        elif toks[j].kind in ")]}":
            deep -= 1
            if not deep:
                if "([{".index(toks[i].kind) != ")]}".index(toks[j].kind):
                    break
                return j
    raise ParseError("an open bracket", src, toks[i].at)


def split(toks: list[Tok], sep: str) -> list[list[Tok]]:
    out: list[list[Tok]] = [[]]
    deep = 0
    for t in toks:
        deep += (t.kind in "([{") - (t.kind in ")]}")
        if t.kind == sep and not deep:
            out.append([])
        else:
            out[-1].append(t)
    return out


def words(src: str) -> list[str]:
    return [("{" + t.v + "}") if t.kind == "hole" else str(t.v) for t in tokens(src)]


