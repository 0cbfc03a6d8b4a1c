"""Values of the array language."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.operators import blocks, windows


class LangError(ValueError):
    """An expression that can't be read or evaluated."""


class Sym(str):
    """A symbol."""


class Ts(int):
    """Nanoseconds since 1970."""


class Dur(int):
    """A span in nanoseconds."""


@dataclass
class Vec:
    """A vector held on the driver: a literal or a small result."""

    kind: str  # int float bool sym str ts
    items: list

    def __len__(self) -> int:
        return len(self.items)


class Frame:
    """Rows with a total order. Vectors of one frame are columns of one growing DataFrame, so
    operators between them need no join; Catalyst drops what isn't used."""

    #: Size (as planned) from which rows are counted, and the rows of a block: one order over more is
    #: dealt into blocks.
    LARGE, BLOCK = blocks.LARGE, blocks.BLOCK

    def __init__(self, df: DataFrame, order: list[str], by: list[str] | None = None):
        self.df, self.order, self.by, self.made = df, order, by or [], 0
        self.place: str | None = None
        self._large: bool | None = None
        #: Of a large frame: its rows, or where it has no places yet those it may have at most.
        self.rows: int | None = None

    def among(self, df: DataFrame, order: list[str], by: list[str] | None = None, place: str | None = None) -> Frame:
        """A frame of some of these rows, or of as many; with ``place``, of as many."""
        f = Frame(df, order, by)
        f.place, f._large, f.rows = place, self.dealt(), self.rows
        return f

    def line(self, at: str) -> list[str]:
        """The order of this frame's rows, by one column where their places ``at`` tell it."""
        return self.order if self.by else [at]

    def fresh(self) -> str:
        self.made += 1
        while (name := f"__v{self.made}") in self.df.columns:
            self.made += 1
        return name

    def add(self, x: Column) -> str:
        name = self.fresh()
        self.df = self.df.withColumn(name, x)
        return name

    def dealt(self) -> bool:
        """Whether the order is dealt into blocks: one order over many rows."""
        if self._large is None:
            self.rows = None if self.by else blocks.many(self.df, self.LARGE, self.BLOCK)
            self._large = self.rows is not None
        return self._large

    def places(self) -> str:
        """A column with the rows' places, from 0."""
        if self.place is None or self.place not in self.df.columns:
            if self.dealt():
                self.place = self.fresh()
                self.df, self.rows = blocks.numbered(self.df, [F.col(f"`{o}`") for o in self.order], self.place, self.rows, self.BLOCK)
            else:
                over = Window.orderBy(*[F.col(f"`{o}`") for o in [*self.by, *self.order]])
                self.place = self.add((F.row_number().over(over) - 1).cast("long"))
        return self.place

    def windowed(self, build: Callable[[WindowSpec], Column], before: int = 0, after: int = 0) -> str:
        """Add a column of windows that reach ``before`` rows back and ``after`` ahead at most."""
        if not self.dealt():
            return self.add(build(self.window()))
        place, name = self.places(), self.fresh()
        self.df = blocks.near(self.df, {name: build}, before, after, place, self.BLOCK, self.rows)
        return name

    def running(self, func: str, x: Column) -> str:
        """Add sums avgs mins maxs prds ffill bfill of a column of doubles."""
        if not self.dealt():
            if func == "bfill":
                return self.add(windows.fill_backward(x, self.window(True)))
            return self.add(windows.fill_forward(x, self.window()) if func == "ffill" else windows.running(func, x, self.window()))
        place, value = self.places(), self.add(x)
        name = self.fresh()
        self.df = blocks.running(self.df, func, value, name, place, self.BLOCK, self.rows)
        return name

    def window(self, back: bool = False) -> WindowSpec:
        return Window.partitionBy(*self.by).orderBy(*([F.desc(o) for o in self.order] if back else self.order))

    def ordered(self) -> DataFrame:
        return self.df.orderBy(*self.by, *self.order)


@dataclass
class Col:
    """A vector of a frame."""

    frame: Frame
    name: str
    kind: str

    @property
    def x(self) -> Column:
        return F.col(f"`{self.name}`")

    def local(self) -> Vec:
        """The whole vector on the driver: only where a result is asked for."""
        rows = self.frame.ordered().select(self.x).collect()
        return Vec(self.kind, [from_spark(r[0], self.kind) for r in rows])


@dataclass
class Table:
    """Named columns: vectors on the driver, or columns of one frame."""

    names: list[str]
    columns: dict[str, Vec | Col]

    def frame(self) -> Frame | None:
        return next((c.frame for c in self.columns.values() if isinstance(c, Col)), None)

    def local(self) -> dict[str, list]:
        if (f := self.frame()) is None:
            return {n: list(self.columns[n].items) for n in self.names}
        rows = f.ordered().select(*(self.columns[n].x.alias(n) for n in self.names)).collect()
        return {n: [from_spark(r[n], self.columns[n].kind) for r in rows] for n in self.names}

    def dataframe(self) -> DataFrame:
        f = self.frame()
        if f is None:
            raise LangError("a table of literals has no DataFrame")
        return f.ordered().select(*(self.columns[n].x.alias(n) for n in self.names))


class Groups(dict):
    """The places of each value of a frame's column, by value: a dict that asks Spark key by key."""

    def __init__(self, frame: Frame, key: str, at: str):
        super().__init__()
        self.frame, self.key, self.at = frame, key, at

    def _of(self, key: object) -> DataFrame:
        return self.frame.df.filter(F.col(self.key) == str(key))

    def __contains__(self, key: object) -> bool:
        return not self._of(key).isEmpty()

    def __getitem__(self, key: object) -> Col:
        return Col(Frame(self._of(key), [self.at]), self.at, "int")

    def __iter__(self) -> Iterator[str]:
        return iter([r[0] for r in self.frame.df.select(self.key).distinct().orderBy(self.key).collect()])

    def __len__(self) -> int:
        return self.frame.df.select(self.key).distinct().count()

    def keys(self) -> list[str]:
        return list(self)

    def items(self) -> list[tuple[str, Vec]]:
        """All places on the driver: only where a result is asked for."""
        rows = self.frame.df.groupBy(self.key).agg(F.array_sort(F.collect_list(self.at)).alias("at")).orderBy(self.key).collect()
        return [(r[0], Vec("int", list(r["at"]))) for r in rows]

    def dataframe(self) -> DataFrame:
        """(key, at), a row a place."""
        return self.frame.df.select(F.col(self.key).alias("key"), F.col(self.at).alias("at"))


@dataclass
class Lambda:
    params: list[str]
    body: object
    implicit: bool = False


@dataclass
class Builtin:
    name: str


@dataclass
class Measure:
    """A measurement, filtered so far by ``where``; a field of it is named by ``only``."""

    name: str
    where: list = field(default_factory=list)
    only: str | None = None


WRAP = {"int": int, "float": float, "bool": bool, "sym": Sym, "str": str, "ts": Ts}


def from_spark(v: object, kind: str) -> object:
    if v is None:
        return float("nan") if kind == "float" else None if kind in ("int", "bool", "ts") else Sym("") if kind == "sym" else ""
    return WRAP[kind](v)


def kind_of(v: object) -> str:
    """The language's name for a value's type."""
    for t, n in ((bool, "bool"), (Sym, "sym"), (Ts, "ts"), (Dur, "dur"), (int, "int"), (float, "float"), (str, "str")):
        if isinstance(v, t):
            return n
    if v is None:
        return "null"
    if isinstance(v, (Vec, Col)):
        return f"{v.kind}[]"
    if isinstance(v, dict):
        return "dict"
    return {list: "list", Table: "table", Lambda: "fn", Builtin: "fn"}.get(type(v), "table")


def show(v: object) -> str:
    """Text of a value as the language would write it."""
    k = kind_of(v)
    if v is None:
        return "0N"
    if k == "bool":
        return "1b" if v else "0b"
    if k == "float":
        return "0n" if math.isnan(v) else ("0w" if v > 0 else "-0w") if math.isinf(v) else repr(float(v))
    if k == "sym":
        return "`" + str(v)
    if k == "str":
        return '"' + str(v) + '"'
    if k == "ts":
        t = datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=int(v) // 10**9)
        return t.strftime("%Y.%m.%dD%H:%M:%S") + (f".{int(v) % 10**9:09d}" if int(v) % 10**9 else "")
    if k == "dur":
        for unit, n in (("w", 604800 * 10**9), ("d", 86400 * 10**9), ("h", 3600 * 10**9), ("m", 60 * 10**9), ("s", 10**9), ("ms", 10**6), ("us", 10**3), ("ns", 1)):
            if int(v) % n == 0:
                return f"{int(v) // n}{unit}"
    if isinstance(v, Col):
        v = v.local()
    if isinstance(v, Vec):
        if v.kind == "bool":
            return "".join("1" if b else "0" for b in v.items) + "b"
        return ("" if v.kind == "sym" else " ").join(show(i) for i in v.items)
    if isinstance(v, list):
        return "(" + "; ".join(map(show, v)) + ")"
    if isinstance(v, dict):
        return "{" + "; ".join(f"{k}: {show(x)}" for k, x in sorted(v.items())) + "}"
    if isinstance(v, Table):
        cols = v.local()
        return "\n".join([" | ".join(v.names), *(" | ".join(show(x) for x in row) for row in zip(*(cols[n] for n in v.names), strict=True))])
    return str(v) if k not in ("fn",) else "<fn>"


def same(a: object, b: object) -> bool:
    """Deep equality; NaN equals NaN; dicts and tables equal nothing."""
    a, b = (x.local() if isinstance(x, Col) else x for x in (a, b))
    if isinstance(a, (dict, Table)) or isinstance(b, (dict, Table)) or kind_of(a) != kind_of(b):
        return False
    if isinstance(a, Vec):
        return len(a) == len(b) and all(same(x, y) for x, y in zip(a.items, b.items, strict=True))
    if isinstance(a, list):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, float):
        return a == b or (math.isnan(a) and math.isnan(b)) or abs(a - b) < 2.3e-16
    return a == b
