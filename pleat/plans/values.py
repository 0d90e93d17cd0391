"""Distributed values: vectors, matrices and scalars over a frame.

A frame is a DataFrame with an order.  Columns of one frame combine as Column expressions inside one
stage; a scalar of a frame is an aggregate expression that joins other aggregates of the frame in one
pass and enters other frames as a scalar subquery.  Dense positions are made only where a verb needs
them, without moving all rows to one task.
"""

from __future__ import annotations

import itertools
import re
import tempfile
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DomainError, NotYet
from ..operators.verb import Distributed

POS = "__pos"
_names = itertools.count()


def fresh(prefix: str) -> str:
    return f"__{prefix}{next(_names)}"


def q(name: str) -> str:
    return f"`{name}`"


#: The sentence that is being run: extensions of a frame are shared within one.
_sentence = [0]


def next_sentence() -> None:
    _sentence[0] += 1


@dataclass(eq=False)
class Frame:
    """Rows in an order: by the dense column ``pos`` (0 to n - 1) if there is one, else by ``order``.

    ``base`` is a frame whose rows and columns this one has too, at the same positions.  Positions that
    the caller ``claimed`` are verified before anything counts on them.
    """

    df: DataFrame
    order: list[Column] = field(default_factory=list)
    pos: str | None = None
    base: Frame | None = None
    claimed: bool = False

    def ordering(self) -> list[Column]:
        if self.pos:
            return [F.col(q(self.pos))]
        if not self.order:
            raise NotYet("the rows of this table have no order; name one with Table(order=...)")
        return self.order

    def extends(self, other: Frame) -> bool:
        f = self
        while f is not None:
            if f is other or f is getattr(other, "_dense", None):
                return True
            f = f.base
        return False

    def dense(self) -> Frame:
        """This frame with dense positions, columns unchanged.

        Rows are range-partitioned and sorted by the order and numbered inside their partition; that
        is written to the shared checkpoint folder, because a range partitioning made twice may cut
        elsewhere.  Partitions then shift by the counts of those before them: one row per partition.
        """
        if self.pos:
            if self.claimed:
                verify_positions(self.df, self.pos)
                self.claimed = False
            return self
        if getattr(self, "_dense", None) is None:
            mark, part, base = fresh("mark"), fresh("part"), fresh("base")
            cols = self.ordering()
            sorted_ = self.df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn(mark, F.monotonically_increasing_id())
            numbered = checkpointed(sorted_).withColumn(part, F.shiftright(mark, 33))
            counts = numbered.groupBy(part).agg(F.count(F.lit(1)).alias(base))
            before = counts.select(part, F.coalesce(F.sum(base).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(base))
            df = numbered.join(F.broadcast(before), part).withColumn(POS, F.col(base) + F.col(mark).bitwiseAND(F.lit((1 << 33) - 1))).drop(part, mark, base)
            self._dense = Frame(df, [], POS)
        return self._dense

    def count(self) -> Column:
        """Number of rows as a scalar subquery."""
        f = self
        while f.base is not None:
            f = f.base
        return f.df.agg(F.count(F.lit(1)).alias("n")).scalar()

    def trim(self, front: int, back: int) -> Frame:
        """This dense frame without its first and last rows; one frame for all columns that ask for the same."""
        made = self.__dict__.setdefault("_trims", {})
        if (front, back) not in made:
            made[front, back] = TrimFrame(self, front, back)
        return made[front, back]

    def windows(self) -> WindowFrame:
        """The extension of this dense frame that takes window columns; one for a sentence."""
        held = getattr(self, "_windows", None)
        if held is None or held[0] != _sentence[0]:
            self._windows = held = (_sentence[0], WindowFrame(self))
        return held[1]


class TrimFrame(Frame):
    """A dense frame's rows between its first ``front`` and last ``back``, with positions of their own."""

    def __init__(self, parent: Frame, front: int, back: int):
        self.parent, self.front, self.back = parent, front, back
        self.order, self.pos, self.base, self.claimed = [], fresh("pos"), None, False
        self._made: tuple = (None, None)

    @property
    def df(self) -> DataFrame:
        whole = self.parent.df
        if self._made[0] is not whole:
            at = F.col(q(self.parent.pos))
            keep = at >= self.front
            if self.back:
                keep = keep & (at < self.parent.count() - self.back)
            self._made = (whole, whole.where(keep).withColumn(self.pos, at - self.front))
        return self._made[1]


class WindowFrame(Frame):
    """A dense frame with columns that look at neighbouring rows: windows over blocks of rows, all in one exchange.

    Each block holds copies of the neighbours that its widest window needs; the copies leave at the end.
    """

    def __init__(self, base: Frame):
        self.base, self.order, self.pos, self.claimed = base, [], base.pos, False
        self.before = self.after = 0
        self.columns: dict[str, Column] = {}
        self.block, self.home = fresh("b"), fresh("home")
        self.window = Window.partitionBy(self.block).orderBy(F.col(q(base.pos)))
        self._made: tuple = (None, None, None)

    def add(self, col: Column, before: int, after: int) -> Column:
        name = fresh("w")
        self.columns[name] = col
        self.before, self.after = max(self.before, before), max(self.after, after)
        return F.col(name)

    @property
    def df(self) -> DataFrame:
        from .blocks import spread

        whole, size = self.base.df, len(self.columns)
        if self._made[0] is not whole or self._made[1] != size:
            df = spread(self.base, self.before, self.after, self.block, self.home).withColumns(self.columns)
            self._made = (whole, size, df.where(F.col(self.block) == F.col(self.home)).drop(self.block, self.home))
        return self._made[2]


class GroupFrame(Frame):
    """One row a group of ``source``: all columns that ask for the same groups are aggregates of one pass."""

    def __init__(self, source: DataFrame, names: list[str], first: Column | None):
        self.source, self.names = source, names
        self.base, self.claimed = None, False
        self.pos = None if first is not None else names[0]  # without first rows the key itself is the position
        self.first = fresh("first")
        self.order = [F.col(self.first)] if first is not None else []
        self.aggs = [first.alias(self.first)] if first is not None else []
        self._made: DataFrame | None = None

    def add(self, agg: Column) -> Column:
        name = fresh("g")
        self.aggs.append(agg.alias(name))
        self._made = self._dense = None
        return F.col(name)

    @property
    def df(self) -> DataFrame:
        if self._made is None:
            self._made = self.source.groupBy(*self.names).agg(*self.aggs)
        return self._made


_verified: set = set()


def verify_positions(df: DataFrame, pos: str) -> None:
    """Refuse positions other than 0 to n - 1, once each: by their number, bounds and the exclusive or of their hashes."""
    key = (df.sparkSession.sparkContext.applicationId, df.select(q(pos)).semanticHash())
    if key in _verified:
        return
    c = F.col(q(pos)).cast("long")
    n, known, low, high, mark = df.agg(F.count(F.lit(1)), F.count(c), F.min(c), F.max(c), F.bit_xor(F.xxhash64(c))).first()
    if n:
        want = None if (known, low, high) != (n, 0, n - 1) else df.sparkSession.range(n).agg(F.bit_xor(F.xxhash64("id"))).first()[0]
        if want is None or want != mark:
            raise DomainError(f"column {pos} does not hold the positions 0 to {n - 1}; name it as an order instead")
    _verified.add(key)


class Scalar(Distributed):
    """One value: an aggregate over a frame, or (frame None) an expression of subqueries and literals."""

    def __init__(self, frame: Frame | None, col: Column):
        self.frame, self.col = frame, col

    def inline(self) -> Column:
        return self.col if self.frame is None else self.frame.df.agg(self.col.alias("v")).scalar()

    def to_df(self, name: str = "v") -> DataFrame:
        if self.frame is not None:
            return self.frame.df.agg(self.col.alias(name))
        spark = _session()
        return spark.range(1).select(self.col.alias(name))


class Tuple(Distributed):
    """A short vector of scalars over one frame, such as the column sums of a matrix."""

    def __init__(self, parts: list[Scalar]):
        self.parts = parts

    def to_df(self, *names: str) -> DataFrame:
        names = names or tuple(f"v{i}" for i in range(len(self.parts)))
        frame = self.parts[0].frame
        if all(p.frame is frame for p in self.parts) and frame is not None:
            return frame.df.agg(*[p.col.alias(n) for p, n in zip(self.parts, names, strict=True)])
        return _session().range(1).select(*[p.inline().alias(n) for p, n in zip(self.parts, names, strict=True)])


class Vec(Distributed):
    """A column of a frame without its first ``front`` and last ``back`` rows."""

    def __init__(self, frame: Frame, col: Column, front: int = 0, back: int = 0):
        self.frame, self.col, self.front, self.back = frame, col, front, back

    @property
    def type(self) -> T.DataType:
        if not hasattr(self, "_type"):
            self._type = self.frame.df.select(self.col.alias("v")).schema[0].dataType
        return self._type

    def trimmed(self) -> Vec:
        """The same vector on a frame of its own rows."""
        if not self.front and not self.back:
            return self
        return Vec(self.frame.dense().trim(self.front, self.back), self.col)

    def placed(self) -> Vec:
        """On a frame with dense positions."""
        t = self.trimmed()
        f = t.frame.dense()
        return t if f is t.frame else Vec(f, t.col)

    def to_df(self, name: str = "v", pos: str | None = None) -> DataFrame:
        """The values, with their positions if a name is given for them; rows in no particular order."""
        if pos is None:
            t = self.trimmed()
            return t.frame.df.select(t.col.alias(name))
        t = self.trimmed()
        if not t.frame.pos and getattr(t.frame, "_dense", None) is None:  # only the order and the values need to move
            t = t.narrowed()
        t = t.placed()
        return t.frame.df.select(F.col(q(t.frame.pos)).cast("long").alias(pos), t.col.alias(name))

    def narrowed(self) -> Vec:
        """On a frame of nothing but the order and this column."""
        keys, v = [], fresh("v")
        order = []
        for c in self.frame.ordering():
            text = str(c)[8:-2]
            bare, _, tail = text.partition(" ASC NULLS ") if " ASC NULLS " in text else text.partition(" DESC NULLS ")
            if not bare.isidentifier() or bare not in self.frame.df.columns:
                return self
            k = fresh("o")
            keys.append(F.col(q(bare)).alias(k))
            order.append(F.col(k).desc() if " DESC NULLS " in text else F.col(k).asc() if tail else F.col(k))
        return Vec(Frame(self.frame.df.select(*keys, self.col.alias(v)), order), F.col(v))


class Mat(Distributed):
    """Rows of a frame by some of its columns, or (``cell``) by the elements of one array column."""

    def __init__(self, frame: Frame, cols: list[Column] | None = None, cell: Column | None = None, turned: bool = False):
        self.frame, self.cols, self.cell, self.turned = frame, cols, cell, turned

    def columns(self) -> list[Column]:
        if self.cols is None:
            raise NotYet("a matrix of array cells has no separate columns here")
        return self.cols

    def map(self, f) -> Mat:
        if self.cols is not None:
            return Mat(self.frame, [f(c) for c in self.cols], None, self.turned)
        return Mat(self.frame, None, F.transform(self.cell, f), self.turned)

    def to_df(self, *names: str, pos: str | None = None) -> DataFrame:
        f = self.frame.dense() if pos else self.frame
        lead = [F.col(q(f.pos)).cast("long").alias(pos)] if pos else []
        if self.cols is None:
            return f.df.select(*lead, self.cell.alias(names[0] if names else "cell"))
        names = names or tuple(f"c{i}" for i in range(len(self.cols)))
        return f.df.select(*lead, *[c.alias(n) for c, n in zip(self.cols, names, strict=True)])


class Runs(Distributed):
    """The items of every run (window, chunk, segment or group) at once, while a verb is applied to runs.

    ``agg`` turns an aggregate into a column at the level of runs, ``size`` is a run's length and
    ``finish`` builds the distributed result of a column at that level.
    """

    def __init__(self, frame: Frame, col: Column, agg, size, finish, pos: Column | None, scan=None):
        self.frame, self.col, self.agg, self.size, self.finish, self.pos, self.scan = frame, col, agg, size, finish, pos, scan

    def with_col(self, col: Column) -> Runs:
        return Runs(self.frame, col, self.agg, self.size, self.finish, self.pos, self.scan)


class RunScalar(Distributed):
    """One value for every run."""

    def __init__(self, runs: Runs, col: Column):
        self.runs, self.col = runs, col


class Table:
    """A DataFrame to bind: an order (column names, ``-name`` for descending) or a dense position column.

    ``table["c"]`` is a vector (of complex numbers, if c holds structs of re and im or c_re and c_im are
    columns), ``table.matrix("a", "b")`` a matrix of columns, ``table.cells("e")`` one
    of array cells.  Columns must be of one type per matrix.  Nulls are refused by the column's name as
    rows are read; ``whole=True`` states that there are none, which lets filters reach the files.
    """

    def __init__(self, df: DataFrame, order: list[str] | None = None, pos: str | None = None, whole: bool = False):
        if df.isStreaming and (order or pos):
            raise NotYet("an order over a stream")
        cols = [F.col(q(c[1:])).desc() if c.startswith("-") else F.col(q(c)) for c in order or []]
        self.frame = Frame(df, cols, pos, None, pos is not None)
        self.whole = whole

    def known(self, name: str, col: Column, nullable: bool, kind: T.DataType) -> Column:
        if self.whole or not nullable:
            return col
        return F.coalesce(col, F.raise_error(F.lit(f"column {name} holds nulls, which are not read")).cast(kind))

    def __getitem__(self, name: str) -> Vec:
        fields = self.frame.df.schema
        if name not in fields.names and {f"{name}_re", f"{name}_im"} <= set(fields.names):
            return Vec(self.frame, F.struct(self[f"{name}_re"].col.cast("double").alias("re"), self[f"{name}_im"].col.cast("double").alias("im")))
        if name not in fields.names:
            raise DomainError(f"the table has no column {name}")
        kind = fields[name].dataType
        if isinstance(kind, T.DecimalType):
            raise DomainError(f"column {name} holds decimals, which are not read")
        col = self.known(name, F.col(q(name)), fields[name].nullable, kind)
        if isinstance(kind, T.TimestampType):
            return Vec(self.frame, F.unix_micros(col))
        if isinstance(kind, T.TimestampNTZType):
            made = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {q(name)})")
            return Vec(self.frame, self.known(name, made, fields[name].nullable, T.LongType()))
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            return Vec(self.frame, col.cast("long"))
        if isinstance(kind, T.FloatType):
            return Vec(self.frame, col.cast("double"))
        return Vec(self.frame, col)

    def matrix(self, *names: str) -> Mat:
        kinds = {self[n].type.simpleString() for n in names}
        if len(kinds) > 1:
            raise DomainError(f"columns of several types: {', '.join(names)}")
        return Mat(self.frame, [self[n].col for n in names])

    def cells(self, name: str) -> Mat:
        kind = self.frame.df.schema[name].dataType
        col = self.known(name, F.col(q(name)), self.frame.df.schema[name].nullable, kind)
        one = lambda v: self.known(name, v, kind.containsNull, kind.elementType).cast("double")
        return Mat(self.frame, None, F.transform(col, one))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the folder of spark.checkpoint.dir; to one of our own only where none is set and all runs in one process (tests)."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise DomainError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="pleat-"))
    return df.checkpoint()


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.active()
