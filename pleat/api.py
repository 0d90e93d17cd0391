"""The public surface: ``j`` and ``apl`` run a sentence, ``compile`` makes a kernel that is bound and called."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .errors import LanguageError, NotYet, ValueUnknown
from .frontend import apl as an
from .frontend import j as jn
from .frontend.dialect import MODERN, STANDARD, Dialect
from .functions import text
from .operators.verb import Distributed
from .plans.values import Mat, Scalar, Table, Tuple, Vec, next_sentence
from .values import from_python, to_python


def bound(v):
    """A value for a hole: distributed values as they are, a one-column DataFrame as its column, the rest as local arrays."""
    if isinstance(v, (Distributed, np.ndarray)) and not isinstance(v, np.ndarray):
        return v
    if isinstance(v, Table):
        raise LanguageError("bind a column or a matrix of a table, not the table")
    if isinstance(v, DataFrame):
        t = Table(v)
        return t[v.columns[0]] if len(v.columns) == 1 else t.matrix(*v.columns)
    return from_python(v)


#: Items of a distributed vector that are shown from either end.
SHOWN = 500


class Result:
    """What a program came to: a local array or a distributed value."""

    def __init__(self, value, source: str, nested: bool = False):
        self.value, self.source, self.nested = value, source, nested

    @property
    def distributed(self) -> bool:
        return isinstance(self.value, Distributed)

    def to_df(self, *names: str, pos: str | None = None) -> DataFrame:
        """The result as a DataFrame, columns named by ``names``; ``pos`` also names the positions."""
        v = self.value
        if isinstance(v, Vec):
            return v.to_df(names[0] if names else "v", pos)
        if isinstance(v, Mat):
            return v.to_df(*names, pos=pos)
        if isinstance(v, Scalar):
            return v.to_df(names[0] if names else "v")
        if isinstance(v, Tuple):
            return v.to_df(*names)
        from .plans.values import _session

        a = np.asarray(v)
        rows = [(i, x) for i, x in enumerate(np.ravel(a).tolist())]
        kind = {"b": "boolean", "i": "long", "f": "double"}.get(a.dtype.kind, "string")
        name = names[0] if names else "v"
        df = _session().createDataFrame(rows, f"{pos or '__pos'} long, `{name}` {kind}")
        return df if pos else df.drop("__pos")

    def local(self) -> np.ndarray:
        from .plans import lowering

        return lowering.gather(self.value)

    def tolist(self):
        return to_python(self.local())

    def __arrow_c_stream__(self, requested_schema=None):
        df = self.to_df() if self.distributed else None
        import pyarrow as pa

        table = df.toArrow() if df is not None else pa.table({"v": pa.array(np.ravel(self.value))})
        return table.__arrow_c_stream__(requested_schema)

    def __str__(self) -> str:
        """The value as the notation shows it; of a long distributed vector the first and last SHOWN items."""
        show = text.display_nested if self.nested else text.display
        if isinstance(self.value, Vec):
            from .plans import lowering

            head, tail, left = lowering.ends(self.value, SHOWN)
            return show(head) if not left else f"{show(head)}\n({left} more)\n{show(tail)}"
        return show(self.local())


class Kernel:
    """A compiled program; ``bind`` gives holes values, a call runs it with more."""

    def __init__(self, language: Language, source: str, values: dict | None = None):
        self.language, self.source, self.values = language, source, values or {}
        self.names = language.holes(source)

    def bind(self, values: dict | None = None, **more) -> Kernel:
        given = {**(values or {}), **more}
        for n in given:
            if n not in self.names:
                raise ValueUnknown(f"the program has no {{{n}}}")
        return Kernel(self.language, self.source, {**self.values, **given})

    def __call__(self, values: dict | None = None, out: Callable[[str], None] | None = None, read: Callable[[], str] | None = None, **more) -> Result:
        given = {**self.values, **(values or {}), **more}
        for n in given:
            if n not in self.names:
                raise ValueUnknown(f"the program has no {{{n}}}")
        missing = [n for n in self.names if n not in given]
        if missing:
            raise ValueUnknown(f"nothing is bound to {', '.join('{' + n + '}' for n in missing)}", self.source, self.source.find("{" + missing[0] + "}"))
        holes = {n: bound(v) for n, v in given.items()}
        next_sentence()
        try:
            value = self.language.run(self.source, holes, out, read)
        except (AttributeError, TypeError, ValueError) as e:
            if any(isinstance(v, Distributed) for v in holes.values()):
                raise NotYet(f"this program over distributed values ({e})") from e
            raise
        return Result(value, self.source, self.language.name == "apl")

    def deploy(self, target: str = "cluster", **_: object) -> Kernel:
        """Placement never changes a value: plans run where the session runs."""
        return self

    def explain(self, values: dict | None = None, **more) -> str:
        """The parsed words and, for a distributed result, Spark's plan."""
        import contextlib
        import io

        lines = ["words: " + " ".join(self.language.words(self.source))]
        result = self(values, **more)
        lines.append(f"result: {type(result.value).__name__.lower()}" if result.distributed else f"result: local {result.value.dtype} {result.value.shape}")
        if result.distributed:
            hold = io.StringIO()
            with contextlib.redirect_stdout(hold):
                result.to_df().explain("formatted")
            lines.append(hold.getvalue())
        return "\n".join(lines)


class Language:
    def __init__(self, name: str, machine: Callable, words: Callable[[str], list[str]]):
        self.name, self._machine, self._words = name, machine, words

    def words(self, source: str) -> list[str]:
        return self._words(source)

    @lru_cache(maxsize=512)  # noqa: B019
    def holes(self, source: str) -> tuple[str, ...]:
        return tuple(dict.fromkeys(w[1:-1] for w in self._words(source) if w.startswith("{") and w.endswith("}") and len(w) > 2))

    def compile(self, source: str) -> Kernel:
        return Kernel(self, source)

    def run(self, source: str, holes: dict, out=None, read=None):
        return self._machine(holes, out, read).run_text(source)

    def __call__(self, source: str, values: dict | None = None, **more) -> Result:
        return self.compile(source)(values, **more)


j = Language("j", lambda holes, out, read: jn.Machine(holes, out, read), lambda s: [w for w, _ in text.word_spans(s)])
apl = Language("apl", lambda holes, out, read: an.Machine(holes, out, read), an.words)
apl_modern = Language("apl", lambda holes, out, read: an.Machine(holes, out, read, MODERN), an.words)


def apl_with(dialect: Dialect = STANDARD) -> Language:
    """The second notation under other settings, such as an index origin of 0."""
    return Language("apl", lambda holes, out, read: an.Machine(holes, out, read, dialect), an.words)
