"""J notation: word formation, the parsing stack, definitions and control structures."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from ..errors import DomainError, IndexRefused, LanguageError, LimitError, NotYet, ParseError, Sandboxed, ValueUnknown
from ..functions import numeric, scalar, structural, text
from ..operators import derived as d
from ..operators.verb import INFINITE, Distributed, Verb
from ..values import EMPTY, INF, Box, Sparse, chars, ints, kind, obj

R = INFINITE


@dataclass
class Adverb:
    name: str
    make: Callable
    extra: dict = field(default_factory=dict)


@dataclass
class Conj:
    name: str
    make: Callable
    extra: dict = field(default_factory=dict)



def sc(name, one, two, identity=None, inverse=None, two_scalar=True):
    return Verb(name, one, two, (0, 0, 0), scalar=True, identity=identity, inverse=inverse)


def wh(name, one, two, ranks=(R, R, R), inverse=None, identity=None):
    return Verb(name, one, two, ranks, identity=identity, inverse=inverse)


def mixed(name, one, one_rank, two, identity=None, inverse=None):
    """A verb whose dyad is scalar and whose monad is not."""
    v = Verb(name, None, two, (one_rank, 0, 0), scalar=True, identity=identity, inverse=inverse)
    v.one = one
    return v


s, st, n, t = scalar, structural, numeric, text


def polar(y):
    return np.stack([np.abs(y), np.angle(y)], axis=-1) if np.size(y) else np.zeros((*np.shape(y), 2))


def parts(y):
    return np.stack([np.real(y), np.imag(y)], axis=-1)


def to_sparse(y):
    if y.ndim == 0:
        return y
    if y.dtype.kind not in "bifc":
        raise DomainError("only machine numbers are sparse")
    return y.view(Sparse)


def dense(y):
    return np.array(y, subok=False) if isinstance(y, Sparse) else y


def made_sparse(y):
    """A sparse array of a shape, or of shape ; axes ; fill."""
    parts = [b.v for b in np.atleast_1d(y)] if kind(y) == "box" and y.size else [y]
    shape = tuple(int(v) for v in np.atleast_1d(ints(parts[0])))
    fill = parts[2][()] if len(parts) > 2 else 0.0
    if len(parts) > 2 and parts[2].ndim or any(v < 0 for v in shape) or len(parts) > 3:
        raise DomainError("a shape, axes and one fill are wanted")
    axes = ints(np.atleast_1d(parts[1])) if len(parts) > 1 else np.arange(len(shape))
    if len(set(axes.tolist())) != len(axes) or any(not 0 <= v < len(shape) for v in axes):
        raise IndexRefused("axes of the shape are wanted")
    out = np.full(shape, fill).view(Sparse)
    out.fill = fill
    return out


def sparse_form(k, y):
    """Queries and conversions; storage stays dense, all axes are sparse."""
    if np.size(k) != 1:
        raise NotYet("naming the sparse axes")
    code = int(np.ravel(k)[0])
    if code == 0:
        return dense(y) if isinstance(y, Sparse) else to_sparse(y)
    if code == 1:
        return made_sparse(y)
    if code == 2:
        return np.arange(y.ndim)
    if not isinstance(y, Sparse):
        raise DomainError("a sparse argument is wanted")
    base = dense(y)
    entry = base != y.fill
    if code == -1:
        return obj([Box(np.array(y.shape)), Box(np.arange(y.ndim)), Box(np.asarray(y.fill).astype(base.dtype))])
    if code == 3:
        return np.asarray(y.fill).astype(base.dtype)
    if code == 4:
        return np.argwhere(entry)
    if code == 5:
        return base[entry]
    if code == 7:
        return np.asarray(int(entry.sum()))
    if code == 8:
        return y
    raise DomainError(f"no form {code} of $.")


def less_verb(x, y):
    return st.less_items(x, y)


def exact_form(x, y):
    k = int(np.ravel(x)[0])
    from fractions import Fraction

    e = s.to_exact(y)
    if k == 1:
        return obj((Fraction(v) if not isinstance(v, Fraction) else v for v in e.ravel()), e.shape)
    if k == 2:
        return obj([w for v in e.ravel() for w in (Fraction(v).numerator, Fraction(v).denominator)], (*e.shape, 2))
    if k == -1:
        if y.dtype.kind != "O":
            return y
        whole = all(Fraction(v).denominator == 1 and abs(v) < 1 << 63 for v in y.ravel())
        return np.array([int(v) for v in y.ravel()], np.int64).reshape(y.shape) if whole else s.to_float(y)
    if k == -2:
        return y
    raise DomainError(f"no exact form {k}")


def raze_in(y):
    pool = t.raze(y)
    rows = []
    for b in y.ravel() if kind(y) == "box" else [Box(v) for v in st.items(st.as_items(y))]:
        rows.append(st.index_of(b.v.reshape(-1) if b.v.ndim == 0 else b.v, pool) < (b.v.size if b.v.ndim == 0 else len(b.v)))
    return np.array(rows, bool).reshape(*y.shape, len(pool))


def open_chars(y):
    if kind(y) not in ("char",) and y.size:
        raise DomainError("characters are wanted")
    return "".join(np.ravel(y).tolist())


def not_equal(x, y):
    return ~s.equal(x, y)


def inv(v: str) -> Callable:
    return lambda: PRIMS[v]


PRIMS: dict[str, Verb] = {v.name: v for v in [
    sc("+", s.conjugate, s.add, 0, inv("+")), sc("-", s.negate, s.subtract, 0, inv("-")), sc("*", s.signum, s.multiply, 1),
    sc("%", lambda y: s.divide(np.asarray(1), y), s.divide, 1, inv("%")), sc("^", s.exp, s.power, 1, inv("^.")), sc("^.", s.ln, s.log, None, inv("^")),
    sc("%:", s.sqrt, s.root, 1, inv("*:")), sc("|", s.magnitude, s.residue, 0), sc("<.", s.floor, s.minimum, INF), sc(">.", s.ceiling, s.maximum, -INF),
    mixed("=", st.self_classify, R, s.equal, 1), mixed("<", t.box, R, s.less, 0, inv(">")), mixed(">", t.open_box, R, s.greater, 0, inv("<")),
    sc("<:", lambda y: s.subtract(y, np.asarray(1)), lambda x, y: ~s.greater(x, y), 1, inv(">:")), sc(">:", lambda y: s.add(y, np.asarray(1)), lambda x, y: ~s.less(x, y), 1, inv("<:")),
    sc("+:", lambda y: s.multiply(np.asarray(2), y), s.nor, None, inv("-:")), sc("*:", lambda y: s.multiply(y, y), s.nand, None, inv("%:")),
    wh("-:", lambda y: s.divide(y, np.asarray(2)), lambda x, y: np.asarray(s.match(x, y)), inverse=inv("+:")),
    wh("-.", lambda y: s.subtract(np.asarray(1), y), less_verb, inverse=inv("-.")),
    mixed("*.", polar, R, s.lcm, 1), mixed("+.", parts, R, s.gcd, 0), mixed("~:", st.nub_sieve, R, not_equal, 0),
    sc("!", s.factorial, s.binomial, 1), sc("o.", lambda y: s.multiply(np.asarray(np.pi), s.to_float(y)), s.circle, None), sc("j.", lambda y: y * 1j, lambda x, y: x + y * 1j), sc("r.", lambda y: np.exp(y * 1j), lambda x, y: x * np.exp(y * 1j)),
    wh("~.", st.nub, None), wh("$", st.shape_of, st.reshape_items, (R, 1, R)), wh("#", st.tally, st.copy, (R, 1, R)),
    wh(",", st.ravel, st.append), wh(",.", lambda y: y.reshape(len(y), int(np.prod(y.shape[1:]))) if y.ndim else y.reshape(1, 1), lambda x, y: d.apply_dyad(st.append, -1, -1, x, y)), wh(",:", lambda y: y[None], st.laminate),
    wh("|.", st.reverse, st.rotate, (R, 1, R), inverse=inv("|.")), wh("|:", st.transpose, st.transpose_j, (R, 1, R), inverse=inv("|:")),
    wh("{.", st.head, st.take, (R, 1, R)), wh("}.", lambda y: st.drop(np.asarray(1), y) if y.ndim else EMPTY, st.drop, (R, 1, R)), wh("{:", st.tail, None), wh("}:", lambda y: st.drop(np.asarray(-1), y) if y.ndim else EMPTY, None),
    wh("#.", lambda y: st.base_value(np.asarray(2), y), st.base_value, (1, 1, 1), inverse=inv("#:")), wh("#:", st.bit_digits, st.digits, (R, 1, 0), inverse=inv("#.")),
    wh("[", lambda y: y, lambda x, y: x, inverse=inv("[")), wh("]", lambda y: y, lambda x, y: y, inverse=inv("]")),
    wh("{", st.catalogue, st.from_items, (1, 0, R)), wh("{::", t.map_paths, t.fetch, (R, 1, R)), wh("i.", st.iota_j, st.index_of, (1, R, R)), wh("i:", st.steps, lambda x, y: st.index_of(x, y, True), (0, R, R)),
    wh("I.", st.indices, st.interval_index, (1, R, R)), wh("e.", raze_in, st.member), wh("E.", None, st.find),
    wh("/:", st.grade, st.sort_by, inverse=inv("/:")), wh("\\:", lambda y: st.grade(y, True), lambda x, y: st.sort_by(x, y, True)),
    wh("A.", st.permutation_rank, st.anagram, (1, 0, R)), wh("C.", st.cycles, st.permute, (1, 1, R), inverse=inv("C.")),
    wh(";", t.raze, t.link), wh(";:", t.words, t.sequential_machine, (1, R, R)), wh("L.", lambda y: np.asarray(t.level(y)), None), wh('":', t.format_chars, t.format_spec, (R, 1, R), inverse=lambda: Verb("inverse", lambda y: t.parse_numbers(np.asarray(0), y))),
    wh("u:", t.unicode_of, t.unicode_form, inverse=lambda: Verb("3&u:", lambda y: t.unicode_form(np.asarray(3), y))), wh("s:", t.symbols, t.symbol_form, inverse=lambda: Verb("5&s:", lambda y: t.symbol_form(np.asarray(5), y))), wh("$.", to_sparse, sparse_form),
    wh("x:", s.to_exact, exact_form, (R, 0, R), inverse=lambda: Verb("_1&x:", lambda y: exact_form(np.asarray(-1), y))), wh("p:", n.nth_prime, n.prime_query, (0, R, 0), inverse=lambda: Verb("_1&p:", lambda y: d.apply_monad(lambda c: n.prime_query(np.asarray(-1), c), 0, y))), wh("q:", n.prime_factors, n.prime_exponents, (0, 0, 0), inverse=lambda: Verb("*/", lambda y: d.fold(PRIMS["*"], y))),
    wh("p.", n.poly_roots, n.poly_eval, (1, 1, 0), inverse=inv("p.")), wh("p..", n.poly_derivative, n.poly_integral, (1, 0, 1)),
    wh("%.", n.inverse_matrix, n.divide_matrix, (2, R, 2), inverse=inv("%.")), wh("?", n.roll, n.deal, (0, 0, 0)), wh("?.", lambda y: n.roll(y, True), lambda x, y: n.deal(x, y, True), (R, 0, 0)),
]}
for _k in range(-9, 10):
    PRIMS[f"{'_' if _k < 0 else ''}{abs(_k)}:"] = d.constant(np.asarray(_k), f"{_k}:")
PRIMS["_:"] = d.constant(np.asarray(INF), "_:")
PRIMS["[:"] = Verb("[:", None, None)

NOUNS = {"a.": np.array([chr(c) for c in range(256)], "<U1"), "a:": obj([Box(EMPTY)], ()), "_.": np.asarray(float("nan"))}
CONTROL = frozenset("if. do. else. elseif. end. while. whilst. for. select. case. fcase. try. catch. return. break. continue. assert. throw. catcht. catchd. goto. label.".split())
MOST_DEPTH = 64


class Signal(Exception):
    def __init__(self, what: str, value=None):
        self.what, self.value = what, value


@dataclass
class Token:
    kind: str  # noun verb adv conj name asgn lp rp hole control line def
    value: object
    at: int
    word: str = ""


def tokens(source: str) -> list[Token]:
    out: list[Token] = []
    for word, at in text.word_spans(source):
        out.append(token(word, at, source))
    return out


def token(word: str, at: int, source: str) -> Token:
    if word == "\n":
        return Token("line", None, at, word)
    if word in ("(", ")"):
        return Token("lp" if word == "(" else "rp", None, at, word)
    if word in ("=.", "=:"):
        return Token("asgn", word, at, word)
    if word[0] == "'":
        body = word[1:-1].replace("''", "'")
        return Token("noun", np.array(body, "<U1") if len(body) == 1 else chars(body), at, word)
    if word.startswith("{{") or word == "}}":
        return Token("def", word, at, word)
    if word[0] == "{" and word.endswith("}") and len(word) > 2:
        return Token("hole", word[1:-1], at, word)
    if word in NOUNS:
        return Token("noun", NOUNS[word], at, word)
    if word in PRIMS or word in ('".', "echo", "$:"):
        return Token("verb", word, at, word)
    if word in ADVERBS:
        return Token("adv", word, at, word)
    if word in CONJS:
        return Token("conj", word, at, word)
    if word in CONTROL or re.fullmatch(r"for_[A-Za-z]\w*\.|goto_\w+\.|label_\w+\.", word):
        return Token("control", word, at, word)
    if word[0].isdigit() or word[0] == "_":
        v = text.number_list(word.split())
        if v is None:
            raise ParseError(f"{word} is no number", source, at)
        return Token("noun", v, at, word)
    if re.fullmatch(r"[A-Za-z][A-Za-z0-9_]*", word):
        if word.endswith("_"):
            raise NotYet("locales", source, at)
        return Token("name", word, at, word)
    raise ParseError(f"{word} is no word of the language", source, at)


def is_noun(v) -> bool:
    return isinstance(v, (np.ndarray, Distributed))


class Scope:
    def __init__(self, own: dict | None = None):
        self.own = own if own is not None else {}


class Machine:
    """One run of a program: names, bindings and output."""

    def __init__(self, holes: dict | None = None, out: Callable[[str], None] | None = None, read: Callable[[], str] | None = None):
        self.globals: dict = {}
        self.scopes: list[Scope] = []
        self.holes = holes or {}
        self.out = out or (lambda line: print(line, end=""))
        self.read = read
        self.depth = 0
        self.current: list[Verb] = []
        self.source = ""

    # names

    def lookup(self, name: str):
        if self.scopes and name in self.scopes[-1].own:
            return self.scopes[-1].own[name]
        return self.globals.get(name)

    def assign(self, name: str, v, local: bool) -> None:
        if local and self.scopes:
            self.scopes[-1].own[name] = v
        else:
            if self.scopes and name in self.scopes[-1].own and not local:
                self.scopes[-1].own.pop(name)
            self.globals[name] = v

    def named(self, name: str) -> Verb:
        def get() -> Verb:
            v = self.lookup(name)
            if v is None:
                raise ValueUnknown(f"{name} has no value")
            if not isinstance(v, Verb):
                raise DomainError(f"{name} is no verb")
            return v

        def guard(f):
            self.depth += 1
            try:
                if self.depth > MOST_DEPTH:
                    raise LimitError("recursion is too deep")
                return f()
            finally:
                self.depth -= 1

        now = self.lookup(name)
        ranks = now.ranks if isinstance(now, Verb) else (R, R, R)
        v = d.derived("Named", name, lambda y: guard(lambda: get().monad(y)), lambda x, y: guard(lambda: get().dyad(x, y)), (name,), ranks)
        if isinstance(now, Verb):
            v.inverse, v.identity = now.inverse, now.identity
            if now.node == "Prim":
                return now
        return v

    # primitives that touch the machine

    def primitive(self, word: str) -> Verb:
        if word == '".':
            return Verb('".', self.execute, t.parse_numbers, (1, R, R))
        if word == "echo":
            return Verb("echo", self.echo, lambda x, y: self.echo(y), hybrid=True)
        if word == "$:":
            return d.derived("SelfRef", "$:", lambda y: self.recur().monad(y), lambda x, y: self.recur().dyad(x, y), ())
        return PRIMS[word]

    def recur(self) -> Verb:
        if not self.current:
            raise DomainError("no verb to refer to")
        return self.current[-1]

    def show(self, v) -> np.ndarray:
        return v if isinstance(v, np.ndarray) else d.lower().gather(v)

    def echo(self, y):
        self.out(text.display(self.show(y)) + "\n")
        return np.zeros((0, 0), np.int64)

    def execute(self, y):
        v = self.run_text(open_chars(y))
        return EMPTY if v is None else v

    def foreign(self, a, b) -> Verb:
        key = (int(np.ravel(a)[0]), int(np.ravel(b)[0]))
        if key == (3, 0):
            return Verb("3!:0", type_code)
        if key == (1, 1):
            return Verb("1!:1", lambda y: chars(self.read_line()))
        if key == (1, 2):
            def write(x, y):
                self.out(text.display(self.show(x)) + "\n")
                return x
            return Verb("1!:2", None, write)
        if key == (5, 1):
            return Verb("5!:1", lambda y: atomic(self.lookup(open_chars(t.raze(y) if kind(y) == "box" else y))))
        raise Sandboxed(f"{key[0]}!:{key[1]} reaches outside")

    def read_line(self) -> str:
        if self.read is None:
            raise Sandboxed("no input is connected")
        return self.read()

    # sentences

    def run_text(self, source: str):
        before, self.source = self.source, source
        try:
            return self.run(tokens(source))
        finally:
            self.source = before

    def run(self, toks: list[Token]):
        toks = fold_definitions(toks, self.source)
        last = None
        for line in split_lines(toks):
            if line:
                if any(x.kind == "control" for x in line):
                    raise ParseError("control words stand in definitions", self.source, line[0].at)
                v, quiet = self.sentence(line)
                last = None if quiet else v
        return last

    def sentence(self, toks: list[Token]):
        """Value of one sentence and whether it was an assignment."""
        quiet = len(toks) > 2 and toks[0].kind == "name" and toks[1].kind == "asgn" or (len(toks) > 2 and toks[0].kind == "noun" and toks[1].kind == "asgn")
        quiet = quiet or (toks[0].kind == "verb" and toks[0].word == "echo")
        return self.parse(toks), quiet

    def resolve(self, tok: Token):
        if tok.kind == "verb":
            return ("V", self.primitive(tok.value), tok.at)
        if tok.kind == "adv":
            return ("A", ADVERBS[tok.value], tok.at)
        if tok.kind == "conj":
            return ("C", self.conjunction(tok.value), tok.at)
        if tok.kind == "noun":
            return ("N", tok.value, tok.at)
        if tok.kind == "hole":
            if tok.value not in self.holes:
                raise ValueUnknown(f"nothing is bound to {{{tok.value}}}", self.source, tok.at)
            return ("N", self.holes[tok.value], tok.at)
        if tok.kind == "name":
            v = self.lookup(tok.value)
            if v is None:
                return ("V", self.named(tok.value), tok.at)
            if is_noun(v):
                return ("N", v, tok.at)
            if isinstance(v, Verb):
                return ("V", self.named(tok.value), tok.at)
            return ("A" if isinstance(v, Adverb) else "C", v, tok.at)
        if tok.kind == "def":
            v = tok.value
            if not isinstance(v, tuple):
                raise ParseError("an unmatched brace", self.source, tok.at)
            return self.classify(self.define(v[0], v[1], v[2]), tok.at)
        return {"lp": ("(", None, tok.at), "rp": (")", None, tok.at), "asgn": ("=", tok.value, tok.at)}[tok.kind]

    def conjunction(self, word: str) -> Conj:
        if word == ":":
            return Conj(":", self.explicit)
        if word == "!:":
            return Conj("!:", self.foreign)
        return CONJS[word]

    def classify(self, v, at):
        return ("N" if is_noun(v) else "V" if isinstance(v, Verb) else "A" if isinstance(v, Adverb) else "C", v, at)

    def parse(self, toks: list[Token]):
        queue = list(toks)
        stack: list[tuple] = []
        edge, avn = ("#", "=", "("), ("#", "=", "(", "A", "V", "N")
        while True:
            if self.reduce(stack, edge, avn):
                continue
            if queue:
                tok = queue.pop()
                if tok.kind == "name" and stack and stack[0][0] == "=":
                    stack.insert(0, ("name", tok.value, tok.at))
                else:
                    stack.insert(0, self.resolve(tok))
            elif not stack or stack[0][0] != "#":
                stack.insert(0, ("#", None, 0))
            else:
                break
        rest = stack[1:]
        if len(rest) != 1:
            raise ParseError("the sentence does not parse", self.source, rest[1][2] if len(rest) > 1 else 0)
        if rest[0][0] in "(=)#":
            raise ParseError("the sentence does not parse", self.source, rest[0][2])
        return rest[0][1]

    def reduce(self, st_: list[tuple], edge, avn) -> bool:
        k = [e[0] for e in st_[:4]] + [""] * (4 - len(st_))
        try:
            if k[0] in edge and k[1] == "V" and k[2] == "N":
                st_[1:3] = [self.classify(st_[1][1].monad(st_[2][1]), st_[1][2])]
            elif k[0] in avn and k[1] == "V" and k[2] == "V" and k[3] == "N":
                st_[2:4] = [self.classify(st_[2][1].monad(st_[3][1]), st_[2][2])]
            elif k[0] in avn and k[1] == "N" and k[2] == "V" and k[3] == "N":
                st_[1:4] = [self.classify(st_[2][1].dyad(st_[1][1], st_[3][1]), st_[2][2])]
            elif k[0] in avn and k[1] in ("V", "N") and k[2] == "A":
                st_[1:3] = [self.classify(st_[2][1].make(st_[1][1]), st_[2][2])]
            elif k[0] in avn and k[1] in ("V", "N") and k[2] == "C" and k[3] in ("V", "N"):
                st_[1:4] = [self.classify(st_[2][1].make(st_[1][1], st_[3][1]), st_[2][2])]
            elif k[0] in avn and k[1] in ("V", "N") and k[2] == "V" and k[3] == "V":
                st_[1:4] = [("V", d.fork(st_[1][1], st_[2][1], st_[3][1]), st_[1][2])]
            elif k[0] in edge and k[1] in ("C", "A", "V", "N") and k[2] in ("C", "A", "V", "N"):
                st_[1:3] = [self.pair(st_[1], st_[2])]
            elif k[0] in ("name", "N") and k[1] == "=" and k[2] in ("C", "A", "V", "N"):
                self.set(st_[0], st_[1][1], st_[2][1])
                st_[0:3] = [st_[2]]
            elif k[0] == "(" and k[1] in ("C", "A", "V", "N") and k[2] == ")":
                v = st_[1]
                st_[0:3] = [(v[0], v[1], st_[0][2])]
            else:
                return False
        except LanguageError as e:
            if e.at is None:
                e.source, e.at = self.source, st_[1][2] if len(st_) > 1 else 0
            raise
        except (TypeError, ValueError, IndexError, KeyError, ArithmeticError, MemoryError) as e:  # arguments that no rule above foresees
            raise DomainError(f"{st_[1][0] if len(st_) > 1 else ''}: {e}", self.source, st_[1][2] if len(st_) > 1 else 0) from e
        return True

    def set(self, target, mark, v) -> None:
        local = mark == "=."
        if target[0] == "name":
            if isinstance(v, Verb) and v.node != "Explicit":
                body = v
                inner = d.derived(v.node, v.name, lambda y: self.within(body, lambda: body.monad(y)), lambda x, y: self.within(body, lambda: body.dyad(x, y)), v.parts, v.ranks, inverse=v.inverse, identity=v.identity) if uses_self(v) else v
                v = inner
            self.assign(target[1], v, local)
            return
        raise NotYet("multiple assignment")

    def within(self, v: Verb, f):
        self.current.append(v)
        try:
            self.depth += 1
            if self.depth > MOST_DEPTH * 3:
                raise LimitError("recursion is too deep")
            return f()
        finally:
            self.depth -= 1
            self.current.pop()

    def pair(self, a, b):
        """Two words that stand alone: a hook, or an adverb made of parts."""
        if a[0] == "V" and b[0] == "V":
            return ("V", d.hook(a[1], b[1]), a[2])
        if a[0] == "C" and b[0] in "NV":
            return ("A", Adverb(f"{a[1].name} n", lambda u: a[1].make(u, b[1])), a[2])
        if a[0] in "NV" and b[0] == "C":
            return ("A", Adverb(f"n {b[1].name}", lambda v: b[1].make(a[1], v)), a[2])
        if a[0] == "A" and b[0] == "A":
            return ("A", Adverb(f"{a[1].name}{b[1].name}", lambda u: b[1].make(a[1].make(u))), a[2])
        raise ParseError("the sentence does not parse", self.source, a[2])

    # definitions

    def explicit(self, a, b):
        if isinstance(a, Verb) and isinstance(b, Verb):
            return d.derived("Explicit", f"{a} : {b}", a.monad, b.dyad, (a, b), (a.ranks[0], b.ranks[1], b.ranks[2]))
        if isinstance(a, Verb) or isinstance(b, Verb):
            raise NotYet("a definition from a verb")
        k = int(np.ravel(a)[0])
        if kind(b) == "box":
            body = "\n".join(open_chars(v.v) for v in b.ravel())
        elif kind(b) == "char" or not b.size:
            body = open_chars(b) if b.ndim < 2 else "\n".join("".join(r).rstrip() for r in b)
        else:
            raise ParseError("a definition's body is text", self.source, 0)
        if k == 13:
            raise NotYet("13 : definitions")
        if k == 0:
            return chars(body)
        return self.define({1: "a", 2: "c", 3: "m", 4: "d"}.get(k, "?"), body, 0)

    def define(self, form: str, body: str, at: int):
        one_text, _, two_text = body.partition("\n:\n")
        toks = tokens(one_text)
        names = {x.value for x in toks if x.kind == "name"}
        if form == "*":
            form = "c" if names & {"v", "n"} else "a" if names & {"u", "m"} else "d" if "x" in names else "m"
        if form == "n":
            raise NotYet("noun definitions in braces")
        if form == "?":
            raise DomainError("no such kind of definition")
        first = program(fold_definitions(toks, one_text), one_text)
        second = program(fold_definitions(tokens(two_text), two_text), two_text) if two_text else None

        def call(block, src, **own):
            self.depth += 1
            if self.depth > MOST_DEPTH:
                self.depth -= 1
                raise LimitError("recursion is too deep")
            self.scopes.append(Scope(dict(own)))
            before, self.source = self.source, src
            try:
                v = self.block(block)
            except Signal as e:
                if e.what != "return":
                    raise ParseError(f"{e.what}. stands outside a loop") from None
                v = e.value
            finally:
                self.scopes.pop()
                self.source = before
                self.depth -= 1
            return np.zeros((0, 0), np.int64) if v is None else v

        def verb_of(extra: dict, name: str) -> Verb:
            def one(y):
                if form == "d" and not second:
                    raise DomainError("the definition takes two arguments")
                return self.within(v, lambda: call(first, one_text, y=y, **extra))

            def two(x, y):
                if second:
                    return self.within(v, lambda: call(second, two_text, x=x, y=y, **extra))
                if form == "m":
                    raise DomainError("the definition takes one argument")
                return self.within(v, lambda: call(first, one_text, x=x, y=y, **extra))

            v = d.derived("Explicit", name, one, two, (body,))
            return v

        if form in ("m", "d"):
            return verb_of({}, f"{'3' if form == 'm' else '4'} : '{body}'")
        uses_args = bool(names & {"x", "y"})

        def own_names(u, w=None):
            out = {"u": u, "m": u}
            if w is not None:
                out |= {"v": w, "n": w}
            return out

        def derived_form(extra):
            if uses_args:
                return verb_of(extra, "explicit modifier")
            return call(first, one_text, **extra)

        if form == "a":
            return Adverb("explicit", lambda u: derived_form(own_names(u)))
        if form == "c":
            return Conj("explicit", lambda u, w: derived_form(own_names(u, w)))

    # control

    def block(self, stmts: list):
        v = None
        for x in stmts:
            got = self.statement(x)
            if got is not NOTHING:
                v = got
        return v

    def test(self, block) -> bool:
        v = self.block(block)
        return True if v is None else d.truth(v)

    def statement(self, x):
        what = x[0]
        if what == "expr":
            v = self.parse(x[1])
            return v
        if what == "if":
            for cond, body in x[1]:
                if cond is None or self.test(cond):
                    return self.block(body) if body else NOTHING
            return NOTHING
        if what == "while":
            v, first = NOTHING, x[3]
            rounds = 0
            while first or self.test(x[1]):
                first = False
                rounds += 1
                if rounds > 1 << 22:
                    raise LimitError("the loop does not end")
                try:
                    got = self.block(x[2])
                    v = NOTHING if got is None else got
                except Signal as e:
                    if e.what == "break":
                        break
                    if e.what != "continue":
                        raise
            return v
        if what == "for":
            v = NOTHING
            over = self.show(self.block(x[2]))
            for i, it in enumerate(structural.items(structural.as_items(over))):
                if x[1]:
                    self.assign(x[1], it, True)
                    self.assign(f"{x[1]}_index", np.asarray(i), True)
                try:
                    got = self.block(x[3])
                    v = NOTHING if got is None else got
                except Signal as e:
                    if e.what == "break":
                        break
                    if e.what != "continue":
                        raise
            return v
        if what == "select":
            v = self.show(self.block(x[1]))
            v = v if kind(v) == "box" else t.box(v)
            run = False
            for cond, body, falls in x[2]:
                if not run:
                    if cond:
                        c = self.show(self.block(cond))
                        c = c if kind(c) == "box" else t.box(c)
                        run = any(s.match(a.v, b.v) for a in np.ravel(v) for b in np.ravel(c))
                    else:
                        run = True
                if run:
                    got = self.block(body)
                    if not falls:
                        return NOTHING if got is None else got
            return NOTHING
        if what == "try":
            try:
                return self.block(x[1]) if x[1] else NOTHING
            except (NotYet, Sandboxed):
                raise
            except LanguageError:
                return self.block(x[2]) if x[2] else NOTHING
        if what == "return":
            raise Signal("return", self.block(x[1]) if x[1] else None)
        raise Signal(what)


NOTHING = object()


def uses_self(v) -> bool:
    if isinstance(v, Verb):
        return v.node == "SelfRef" or any(uses_self(p) for p in v.parts)
    return False


def split_lines(toks: list[Token]) -> list[list[Token]]:
    out: list[list[Token]] = [[]]
    for x in toks:
        if x.kind == "line":
            out.append([])
        else:
            out[-1].append(x)
    return out


def fold_definitions(toks: list[Token], source: str) -> list[Token]:
    """Bodies of {{ }} and of n : 0 up to a lone parenthesis as single tokens."""
    out: list[Token] = []
    i = 0
    while i < len(toks):
        x = toks[i]
        if x.kind == "def" and isinstance(x.value, str) and x.value.startswith("{{"):
            deep, j = 1, i + 1
            while j < len(toks) and deep:
                if toks[j].kind == "def" and isinstance(toks[j].value, str):
                    deep += 1 if toks[j].value.startswith("{{") else -1
                j += 1
            if deep:
                raise ParseError("an open brace", source, x.at)
            body = source[x.at + len(x.word) : toks[j - 1].at]
            out.append(Token("def", (x.word[3:] or "*", body.strip("\n"), x.at), x.at, "{{}}"))
            i = j
            continue
        if x.kind == "def":
            if isinstance(x.value, str):
                raise ParseError("an unmatched brace", source, x.at)
        if x.kind == "conj" and x.word == ":" and i + 1 < len(toks) and toks[i + 1].kind == "noun" and toks[i + 1].word == "0" and out and out[-1].kind == "noun":
            eol = source.find("\n", x.at)
            end = re.compile(r"^\s*\)\s*$", re.M).search(source, eol + 1 if eol >= 0 else len(source))
            if not end:
                raise ParseError("a definition without its closing parenthesis", source, x.at)
            body = source[eol + 1 : end.start()].rstrip("\n")
            out.append(x)
            out.append(Token("noun", chars(body), toks[i + 1].at, "0"))
            i += 2
            while i < len(toks) and toks[i].at < eol:
                out.append(toks[i])
                i += 1
            while i < len(toks) and toks[i].at < end.end():
                i += 1
            continue
        out.append(x)
        i += 1
    return out


def program(toks: list[Token], source: str) -> list:
    """Statements of a definition's body."""
    flat: list = []
    run: list[Token] = []
    for x in [*toks, Token("line", None, 0)]:
        if x.kind in ("line", "control"):
            if run:
                flat.append(run)
                run = []
            if x.kind == "control":
                flat.append(x)
        else:
            run.append(x)
    at = 0

    def word() -> str | None:
        return flat[at].word if at < len(flat) and isinstance(flat[at], Token) else None

    def until(*ends: str) -> list:
        nonlocal at
        out = []
        while at < len(flat):
            if word() in ends:
                return out
            out += one()
        if ends:
            raise ParseError(f"{' or '.join(ends)} is missing", source, 0)
        return out

    def expect(w: str) -> None:
        nonlocal at
        if word() != w:
            raise ParseError(f"{w} is missing", source, 0)
        at += 1

    def one() -> list:
        nonlocal at
        x = flat[at]
        if not isinstance(x, Token):
            at += 1
            if word() == "return.":
                at += 1
                return [("return", [("expr", x)])]
            return [("expr", x)]
        at += 1
        w = x.word
        if w == "if.":
            branches = [(until("do."), None)]
            expect("do.")
            arms = [(branches[0][0], until("else.", "elseif.", "end."))]
            while word() in ("else.", "elseif."):
                kind_ = word()
                at += 1
                if kind_ == "elseif.":
                    cond = until("do.")
                    expect("do.")
                    arms.append((cond, until("else.", "elseif.", "end.")))
                else:
                    arms.append((None, until("end.")))
            expect("end.")
            return [("if", arms)]
        if w in ("while.", "whilst."):
            cond = until("do.")
            expect("do.")
            body = until("end.")
            expect("end.")
            return [("while", cond, body, w == "whilst.")]
        if w.startswith("for"):
            over = until("do.")
            expect("do.")
            body = until("end.")
            expect("end.")
            return [("for", w[4:-1] if w.startswith("for_") else None, over, body)]
        if w == "select.":
            subject = until("case.", "fcase.", "end.")
            arms = []
            while word() in ("case.", "fcase."):
                falls = word() == "fcase."
                at += 1
                cond = until("do.")
                expect("do.")
                arms.append((cond, until("case.", "fcase.", "end."), falls))
            expect("end.")
            return [("select", subject, arms)]
        if w == "try.":
            body = until("catch.", "end.", "catcht.", "catchd.")
            if word() in ("catcht.", "catchd."):
                raise NotYet(word())
            other = []
            if word() == "catch.":
                at += 1
                other = until("end.")
            expect("end.")
            return [("try", body, other)]
        if w == "return.":
            return [("return", [])]
        if w in ("break.", "continue."):
            return [(w[:-1],)]
        if w.startswith(("goto", "label", "throw", "assert")):
            raise NotYet(w)
        raise ParseError(f"{w} stands alone", source, x.at)

    return until()


def type_code(y):
    code = {"b": 1, "U": 2, "i": 4, "f": 8, "c": 16}.get(y.dtype.kind)
    if code is None:
        from fractions import Fraction

        code = {"box": 32, "sym": 65536, "exact": 128 if any(isinstance(v, Fraction) for v in y.ravel()) else 64}[kind(y)]
    if isinstance(y, Sparse):
        code *= 1024
    if kind(y) == "char":
        code = 2 if all(ord(c) < 128 for c in y.ravel()) else 131072
    return np.asarray(code)


def atomic(v):
    """Atomic representation of a value of a name."""
    if v is None:
        raise ValueUnknown("the name has no value")
    if is_noun(v):
        return obj([Box(obj([Box(np.array(["0"], "<U1")), Box(v)]))], ())
    if v.node == "Prim":
        return obj([Box(chars(v.name))], ())
    mark = {"Fork": "3", "Hook": "2", "NounFork": "3"}.get(v.node)
    kids = obj(b for p in v.parts for b in np.ravel(atomic(p)))
    if mark:
        return obj([Box(obj([Box(np.array([mark], "<U1")), Box(kids)]))], ())
    word = {"Reduce": "/", "Commute": "~", "Atop": "@" if v.extra.get("ranked") else "@:", "Compose": "&", "BondLeft": "&", "BondRight": "&", "Rank": '"', "Key": "/.", "Each": "&.>"}.get(v.node, v.name)
    return obj([Box(obj([Box(chars(word)), Box(kids)]))], ())


def gerund(u) -> np.ndarray:
    return u if is_noun(u) else atomic(u).reshape(1)


def tie(u, v):
    out = np.concatenate([gerund(u).reshape(-1), gerund(v).reshape(-1)])
    return out


def verbs_of(g) -> list[Verb]:
    return [revive(b) for b in np.ravel(g)]


def revive(b) -> Verb:
    """The verb that an atomic representation stands for."""
    v = b.v
    if kind(v) == "char":
        w = "".join(np.atleast_1d(v).tolist())
        if w in PRIMS:
            return PRIMS[w]
        raise DomainError(f"{w} is no verb")
    head, kids = v.ravel()[0].v, v.ravel()[1].v
    word = "".join(np.atleast_1d(head).tolist())
    if word == "0":
        return kids
    own = [revive(k) for k in np.ravel(kids)]
    if word in ("2", "3"):
        return d.train(own) if len(own) == 2 or isinstance(own[0], Verb) else d.fork(*own)
    if word in ADVERBS:
        return ADVERBS[word].make(own[0])
    if word in CONJS:
        return CONJS[word].make(*own)
    if word == "&.>":
        return d.each(own[0])
    raise DomainError(f"{word} makes no verb")


def slash(u):
    if is_noun(u):
        vs = verbs_of(u)
        return d.evoke(vs, 3)
    return d.insert(u)


def windowed(u):
    return d.prefix(gerund_cycle(u) if is_noun(u) else u)


def gerund_cycle(u):
    vs = verbs_of(u)
    state = {"i": 0}

    def one(y):
        v = vs[state["i"] % len(vs)]
        state["i"] += 1
        return v.monad(y)

    return Verb("gerund", one)


def boolean_verb(m):
    if isinstance(m, Verb):
        return Verb(f"{m} b.", lambda k: d.characteristics(m, k))
    k = int(np.ravel(m)[0])
    if not -16 <= k < 32:
        raise DomainError("a Boolean function is numbered 0 to 31")
    k %= 32 if k >= 16 else 16
    return Verb(f"{k} b.", lambda y: s.boolean(k, np.zeros_like(y), y), lambda x, y: s.boolean(k, x, y), (0, 0, 0), scalar=True, node="TruthTable")



def amend(m):
    if isinstance(m, Verb):
        return d.amend_verb(m)
    if kind(m) == "box" and m.ndim and all(kind(b.v) in ("char", "box") for b in m.ravel()) and m.size in (2, 3) and not all(kind(b.v) == "num" for b in m.ravel()):
        try:
            vs = verbs_of(m)
        except (LanguageError, IndexError, KeyError):
            return d.amend_noun(m)
        if len(vs) == 3:
            return d.derived("Amend", "gerund}", lambda y: structural.amend(vs[0].monad(y), vs[1].monad(y), vs[2].monad(y)), lambda x, y: structural.amend(vs[0].dyad(x, y), vs[1].dyad(x, y), vs[2].dyad(x, y)), tuple(vs))
    return d.amend_noun(m)


def at(u, v, ranked):
    if not isinstance(u, Verb) or not isinstance(v, Verb):
        if isinstance(v, Verb) and not isinstance(u, Verb):
            return d.atop(d.constant(u), v, ranked)
        raise DomainError("verbs are wanted on both sides")
    return d.atop(u, v, ranked)


def amp(u, v, ranked):
    if isinstance(u, Verb) and isinstance(v, Verb):
        return d.compose(u, v, ranked)
    if isinstance(v, Verb):
        return d.bond_left(u, v)
    if isinstance(u, Verb):
        return d.bond_right(u, v)
    raise DomainError("a verb is wanted")


def rank(u, r):
    if isinstance(r, Verb):
        raise NotYet('u"v')
    if not isinstance(u, Verb):
        return d.constant(u) if False else d.with_rank(d.constant(u), r)
    return d.with_rank(u, r)


def power(u, n):
    if isinstance(n, Verb):
        return d.power_v(u, n)
    if kind(n) == "box" and n.size and kind(n.ravel()[0].v) == "char":
        vs = verbs_of(n)
        if len(vs) == 2:
            return d.derived("PowerV", "gerund", lambda y: d.power_n(u, vs[0].monad(y)).monad(vs[1].monad(y)), lambda x, y: d.power_n(u, vs[0].dyad(x, y)).dyad(x, vs[1].dyad(x, y)), (u,))
    if u.name == "#" and u.node == "Prim" and kind(n) == "num" and n.ndim == 0 and n[()] == -1:
        return Verb("#^:_1", d.inverse_of(PRIMS["#:"]).one if False else None, structural.expand, (R, 1, R))
    return d.power_n(u, n)


def dot(u, v):
    if isinstance(u, Verb) and isinstance(v, Verb):
        return d.inner(u, v)
    raise DomainError("verbs are wanted on both sides")


def cut_conj(u, nn):
    return d.cut(u, nn)


def evoke_conj(m, nn):
    return d.evoke(verbs_of(m) if is_noun(m) else [m], int(np.ravel(nn)[0]))


def agenda_conj(m, pick):
    if not is_noun(m):
        m = gerund(m)
    if not isinstance(pick, Verb):
        i = ints(pick)
        vs = verbs_of(m)
        return d.agenda(vs, pick) if i.ndim == 0 else d.train([d.agenda(vs, np.asarray(k)) for k in i])
    return d.agenda(verbs_of(m), pick)


def under(u, v, ranked):
    return d.under(u, v, ranked)


def hyper(m, nn):
    if isinstance(m, Verb) or isinstance(nn, Verb):
        raise DomainError("numbers are wanted on both sides")
    return Verb("H.", lambda y: n.hypergeometric(m, nn, y), lambda x, y: n.hypergeometric(m, nn, y, int(x[()])), (0, 0, 0), "Hypergeometric")


ADVERBS: dict[str, Adverb] = {a.name: a for a in [
    Adverb("/", slash), Adverb("\\", windowed), Adverb("\\.", lambda u: d.suffix(gerund_cycle(u) if is_noun(u) else u)), Adverb("~", d.commute), Adverb("/.", lambda u: d.key(u)), Adverb("}", amend),
    Adverb("b.", boolean_verb), Adverb("f.", lambda u: u), Adverb("M.", lambda u: d.memo(u)),
]}
CONJS: dict[str, Conj] = {c.name: c for c in [
    Conj("@", lambda u, v: at(u, v, True)), Conj("@:", lambda u, v: at(u, v, False)), Conj("&", lambda u, v: amp(u, v, True)), Conj("&:", lambda u, v: amp(u, v, False)), Conj('"', rank),
    Conj("&.", lambda u, v: under(u, v, True)), Conj("&.:", lambda u, v: under(u, v, False)), Conj("^:", power), Conj(";.", cut_conj), Conj("!.", d.fit), Conj(":.", d.obverse), Conj("::", lambda u, v: d.adverse(u, d.constant(v) if is_noun(v) else v)),
    Conj("`", tie), Conj("@.", agenda_conj), Conj("`:", evoke_conj), Conj("L:", lambda u, k: d.at_level(u, k, False)), Conj("S:", lambda u, k: d.at_level(u, k, True)), Conj(".", dot), Conj("H.", hyper), Conj(":", None), Conj("!:", None),
]}
