"""Evaluation: expressions on measurements become columns of one frame, reductions become numbers."""

from __future__ import annotations

import math
import re
import time
from collections.abc import Callable
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import calendar
from tidemark.functions import numeric as N
from tidemark.model import Measurement
from tidemark.operators import windows as W
from tidemark.operators.aggregates import correlation, median
from tidemark.operators.aggregates import nearest_rank as nearest_rank_rows
from tidemark.operators.aggregates import weighted_mean
from tidemark.operators.blocks import by_blocks
from tidemark.operators.ema import ema, ema_blocks, smooth
from tidemark.operators.joins import asof
from tidemark.plans.compiler import compile_select, predicate
from tidemark.plans.dialect import Agg, Compare, Logic, Select
from tidemark.ship import ship

from . import functions as L
from .syntax import BRACKET, MONADIC, parse
from .values import Builtin, Col, Dur, Frame, Groups, Lambda, LangError, Measure, Sym, Table, Ts, Vec, from_spark, kind_of, same, show

#: Numbers of a range that the driver holds; longer ones are a frame's column.
LOCAL = 100_000
NUMERIC = ("int", "float", "bool")
SPARK = {"int": "long", "float": "double", "bool": "boolean", "sym": "string", "str": "string", "ts": "long"}


def schema_type(kind: str) -> pa.DataType:
    return {"int": pa.int64(), "float": pa.float64(), "bool": pa.bool_()}.get(kind, pa.string())


class Session:
    """Names and measurements of an evaluation. ``measurements`` finds one by name or gives None;
    ``per_series`` partitions every window by the series, for data too large for one order."""

    def __init__(self, spark: SparkSession, measurements: Callable[[str], Measurement | None], per_series: bool = False):
        self.spark, self.measurements, self.per_series = spark, measurements, per_series
        self.env: dict[str, object] = {}
        self.frames: dict[tuple, Frame] = {}

    def run(self, text: str) -> object:
        """The value of an expression. Each run scans afresh, so writes in between are seen."""
        self.frames.clear()
        return self.settle(self.eval(parse(text), {}))

    # Names and sources.

    def eval(self, node: tuple, env: dict[str, object]) -> object:
        return getattr(self, "on_" + node[0])(env, *node[1:])

    def value(self, node: tuple, env: dict[str, object]) -> object:
        return self.settle(self.eval(node, env))

    def settle(self, v: object) -> object:
        """A filtered measurement becomes its table or field."""
        return self.scan(v) if isinstance(v, Measure) else v

    def on_value(self, env: dict, v: object) -> object:
        return v

    def on_name(self, env: dict, name: str) -> object:
        for scope in (env, self.env):
            if name in scope:
                return scope[name]
        if self.measurements(name) is not None:
            return Measure(name)
        if name in MONADIC or name in BRACKET:
            return Builtin(name)
        raise LangError(f"undefined: {name}")

    def on_assign(self, env: dict, name: str, node: tuple) -> object:
        v = self.value(node, env)
        (env if env else self.env)[name] = v
        return v

    def on_block(self, env: dict, nodes: list) -> object:
        out = None
        for n in nodes:
            out = self.value(n, env)
        return out

    def on_filter(self, env: dict, source: tuple, tags: tuple) -> object:
        m = self.eval(source, env)
        if not isinstance(m, Measure):
            raise LangError("@ restricts a measurement")
        return Measure(m.name, [*m.where, self.tag_predicate(tags, env)], m.only)

    def on_within(self, env: dict, source: tuple, a: tuple, b: tuple) -> object:
        m, low, high = self.eval(source, env), self.value(a, env), self.value(b, env)
        if not isinstance(m, Measure) or not isinstance(low, int) or not isinstance(high, int):
            raise LangError("within restricts a measurement to (start; end)")
        return Measure(m.name, [*m.where, Compare("time", "between", (int(low), int(high)))], m.only)

    def tag_predicate(self, node: tuple, env: dict) -> object:
        if node[0] in ("and", "or"):
            return Logic(node[0], self.tag_predicate(node[1], env), self.tag_predicate(node[2], env))
        _, name, op, value = node
        v = self.value(value, env)
        items = v.items if isinstance(v, Vec) else [v]
        plain = [str(x) if isinstance(x, str) else x for x in items]
        if op == "in":
            return Compare(name, "in", tuple(plain))
        if op == "like":
            return Compare(name, "=~", L.glob(plain[0]))
        return Compare(name, "!=" if op == "<>" else op, plain[0])

    def frame(self, m: Measure) -> Frame:
        key = (m.name, repr(m.where))
        if key not in self.frames:
            found = self.measurements(m.name)
            low, high = -(2**63), 2**63 - 1
            for w in m.where:
                if isinstance(w, Compare) and w.name == "time":
                    low, high = max(low, w.value[0]), min(high, w.value[1])
            df = found.between(low if low > -(2**63) else None, high if high < 2**63 - 1 else None)
            for w in m.where:
                df = df.filter(predicate(w, found))
            df = df.withColumn("__series", found.series_key())
            self.frames[key] = Frame(df, ["ts_ns", "__series", *found.order], ["__series"] if self.per_series else [])
        return self.frames[key]

    def scan(self, m: Measure) -> Col | Table:
        found, f = self.measurements(m.name), self.frame(m)
        if m.only is not None:
            return self.column(found, f, m.only)
        names = ["ts", *found.fields]
        return Table(names, {n: self.column(found, f, n) for n in names})

    def column(self, m: Measurement, f: Frame, name: str) -> Col:
        if name in ("ts", "time", "__timestamp"):
            return Col(f, "ts_ns", "ts")
        if name in m.tags:
            return Col(f, f.add(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))), "sym")
        kind = m.kind(name) if name in m.fields else None
        if kind is None:
            raise LangError(f"{m.name} has no field {name}")
        if kind == "string":
            return Col(f, name, "str")
        x = F.col(f"`{name}`")
        if kind == "boolean":
            return Col(f, name, "bool")
        if kind in ("bigint", "int", "smallint", "tinyint"):
            return Col(f, f.add(x.cast("long")), "int")
        return Col(f, f.add(F.coalesce(x.cast("double"), F.lit(N.NAN))), "float")

    def on_member(self, env: dict, node: tuple, name: str) -> object:
        v = self.eval(node, env)
        if isinstance(v, Measure) and v.only is None:
            m = self.measurements(v.name)
            if name in m.tags or name in m.fields or name in ("ts", "time", "__timestamp"):
                return Measure(v.name, v.where, name)
            raise LangError(f"{v.name} has no field {name}")
        v = self.settle(v)
        if isinstance(v, dict):
            if name not in v:
                raise LangError(f"no key {name}")
            return v[name]
        if isinstance(v, Table):
            if name not in v.columns:
                raise LangError(f"no column {name}")
            return v.columns[name]
        if kind_of(v) in ("ts", "ts[]"):
            return self.time_part(v, name)
        raise LangError(f"{kind_of(v)} has no member {name}")

    def time_part(self, v: object, name: str) -> object:
        if name not in calendar.PARTS:
            raise LangError(f"a time has no {name}")
        if isinstance(v, Col):
            return Col(v.frame, v.frame.add(calendar.part(v.x, name)), "int")

        def part(ns: int) -> int:
            t = datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=int(ns) // 10**9)
            return {"week": t.isocalendar()[1], "dow": t.weekday()}.get(name) if name in ("week", "dow") else getattr(t, name)

        return Vec("int", [part(x) for x in v.items]) if isinstance(v, Vec) else part(v)

    # Operators.

    def on_dyad(self, env: dict, op: str, left: tuple, right: tuple) -> object:
        b = self.value(right, env)
        return self.dyad(op, self.value(left, env), b)

    def dyad(self, op: str, a: object, b: object) -> object:
        if op == "~":
            return self.match(a, b)
        special = {"!": self.make_dict, ",": self.join, "#": self.take, "_": self.drop, "?": self.find, "in": self.member_of, "like": self.like}
        if op in special:
            return special[op](a, b)
        if isinstance(a, Vec) and isinstance(b, Col):
            a = self.spread(a)
        if isinstance(b, Vec) and isinstance(a, Col):
            b = self.spread(b)
        if isinstance(a, Col) or isinstance(b, Col):
            return self.dyad_columns(op, a, b)
        if isinstance(a, Vec) or isinstance(b, Vec):
            n = max(len(x) if isinstance(x, Vec) else 1 for x in (a, b))
            left, right = (x.items if isinstance(x, Vec) else [x] for x in (a, b))
            if len(left) not in (1, n) or len(right) not in (1, n):
                raise LangError(f"lengths {len(left)} and {len(right)}")
            out = [self.scalar(op, left[i % len(left)], right[i % len(right)]) for i in range(n)]
            return Vec(self.result_kind(op, kind_of(a).removesuffix("[]"), kind_of(b).removesuffix("[]")), out)
        return self.scalar(op, a, b)

    def match(self, a: object, b: object) -> bool:
        """Deep equality. Of a measurement's vectors lengths are compared first, then values by place."""
        if not (isinstance(a, Col) or isinstance(b, Col)):
            return same(a, b)
        if kind_of(a) != kind_of(b) or self.fn_count(a) != self.fn_count(b):
            return False
        a, b = (self.spread(x) if isinstance(x, Vec) else x for x in (a, b))
        x, y = self.zip(a, b)
        if x.kind == "float":
            p, q = self.double(x), self.double(y)
            equal = N.feq(p, q) | (F.isnan(p) & F.isnan(q))
        else:
            equal = x.x.eqNullSafe(y.x)
        return x.frame.df.filter(~F.coalesce(equal, F.lit(False))).isEmpty()

    def result_kind(self, op: str, a: str, b: str) -> str:
        if op in ("=", "<>", "<", ">", "<=", ">=", "&", "|"):
            return "bool"
        if "ts" in (a, b):
            return "dur" if a == b else "ts"
        if "dur" in (a, b):
            return "dur"
        return "int" if op in ("+", "-", "*", "mod") and a == b == "int" else "float"

    def scalar(self, op: str, a: object, b: object) -> object:
        ka, kb = kind_of(a), kind_of(b)
        if op in ("=", "<>") and isinstance(a, str) and isinstance(b, str):
            return (str(a) == str(b)) == (op == "=")
        timely = {"ts", "dur"}
        if {ka, kb} & timely and op in ("+", "-"):
            if (ka, op, kb) not in {("dur", "+", "dur"), ("dur", "-", "dur"), ("ts", "+", "dur"), ("ts", "-", "dur"), ("ts", "-", "ts"), ("dur", "+", "ts")}:
                raise LangError(f"{ka} {op} {kb}")
            n = int(a) + int(b) if op == "+" else int(a) - int(b)
            return Ts(n) if {ka, kb} == timely else Dur(n)
        if not all(isinstance(x, (int, float)) for x in (a, b)):
            raise LangError(f"{ka} {op} {kb}")
        whole = self.result_kind(op, ka, kb) == "int"
        x, y = (a, b) if whole else (float(a), float(b))
        if op in ("&", "|"):
            return bool(x and y) if op == "&" else bool(x or y)
        if op in ("=", "<>"):
            equal = x == y or (math.isnan(x) and math.isnan(y)) or abs(x - y) < N.EPSILON
            return equal == (op == "=")
        table = {
            "+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "%": lambda: L.div(x, y), "mod": lambda: L.mod(x, y), "^": lambda: L.power(x, y),
            "<": lambda: x < y, ">": lambda: x > y, "<=": lambda: x <= y, ">=": lambda: x >= y,
        }
        return table[op]()

    def spread(self, v: Vec) -> Col:
        """A vector of the driver as a column of a frame of its own."""
        rows = [(i, x) for i, x in enumerate(v.items)]
        df = self.spark.createDataFrame(rows, f"__i long, __x {SPARK[v.kind]}")
        return Col(Frame(df, ["__i"]), "__x", v.kind)

    def zip(self, a: Col, b: Col) -> tuple[Col, Col]:
        """Two vectors as columns of one frame: of their own, or matched by position."""
        if a.frame is b.frame:
            return a, b

        def numbered(c: Col, name: str):
            at = c.frame.places()
            return c.frame.df.select(F.col(at).alias("__i"), c.x.alias(name))

        left, right = numbered(a, "__a"), numbered(b, "__b")
        of = a.frame if a.frame.dealt() else b.frame
        if of.dealt():
            left, right = (by_blocks(x, of.rows, of.BLOCK, "__i") for x in (left, right))
        both = left.withColumn("__in", F.lit(1)).join(right.withColumn("__also", F.lit(1)), "__i", "full")
        checked = F.when(F.col("__in").isNull() | F.col("__also").isNull(), F.raise_error(F.lit("vectors of different lengths")).cast("int")).otherwise(1)
        frame = of.among(both.withColumn("__ok", checked).filter("__ok = 1"), ["__i"], place="__i")
        return Col(frame, "__a", a.kind), Col(frame, "__b", b.kind)

    def dyad_columns(self, op: str, a: object, b: object) -> Col:
        if isinstance(a, Col) and isinstance(b, Col):
            a, b = self.zip(a, b)
        frame = a.frame if isinstance(a, Col) else b.frame
        ka, kb = (x.kind if isinstance(x, Col) else kind_of(x) for x in (a, b))
        x, y = (v.x if isinstance(v, Col) else F.lit(v if not isinstance(v, (Ts, Dur)) else int(v)) for v in (a, b))
        if "null" in (ka, kb):
            x, y = (F.lit(N.NAN) if k == "null" else v for k, v in ((ka, x), (kb, y)))
        kind = self.result_kind(op, ka, kb)
        text = ka in ("sym", "str") and kb in ("sym", "str")
        if text and op in ("=", "<>"):
            out = F.coalesce(x == y, F.lit(False))
            return Col(frame, frame.add(out if op == "=" else ~out), "bool")
        if text or {ka, kb} & {"sym", "str"}:
            raise LangError(f"{ka} {op} {kb}")
        if kind in ("int", "ts", "dur"):
            out = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "mod": lambda: N.imod(x, y)}[op]()
            return Col(frame, frame.add(out.cast("long")), "int" if kind == "dur" else kind)
        x, y = (N.double(v, "boolean") if k == "bool" else v.cast("double") for v, k in ((x, ka), (y, kb)))
        if op in ("&", "|"):
            out = (x != 0) & (y != 0) if op == "&" else (x != 0) | (y != 0)
        elif op in ("=", "<>"):
            out = N.feq(x, y) if op == "=" else ~N.feq(x, y)
        elif kind == "bool":
            out = N.compare(op, x, y)
        else:
            out = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "%": lambda: N.fdiv(x, y), "mod": lambda: N.fmod(x, y), "^": lambda: F.pow(x, y)}[op]()
        return Col(frame, frame.add(out), kind)

    # Structure.

    def make_dict(self, keys: object, values: object) -> dict:
        names = [str(k) for k in (keys.items if isinstance(keys, Vec) else [keys])]
        values = values.local() if isinstance(values, Col) else values
        items = values.items if isinstance(values, Vec) else values if isinstance(values, list) else [values]
        if len(names) != len(items):
            raise LangError(f"{len(names)} keys and {len(items)} values")
        return dict(sorted(zip(names, items, strict=True)))

    def join(self, a: object, b: object) -> object:
        a, b = (x.local() if isinstance(x, Col) else x for x in (a, b))
        if kind_of(a) == kind_of(b) == "str":
            return a + b
        if isinstance(a, list) and isinstance(b, list):
            return a + b
        kinds = [x.kind if isinstance(x, Vec) else kind_of(x) for x in (a, b)]
        if (isinstance(a, Vec) or isinstance(b, Vec)) and kinds[0] == kinds[1]:
            return Vec(kinds[0], [y for x in (a, b) for y in (x.items if isinstance(x, Vec) else [x])])
        return [a, b]

    def position(self, c: Col) -> tuple[Frame, str]:
        """A frame with the rows' places, from 0, in a column."""
        at = c.frame.places()
        return c.frame.among(c.frame.df, c.frame.order, c.frame.by, at), at

    def take(self, n: object, v: object) -> object:
        if not isinstance(n, int):
            raise LangError("take has a number on the left")
        if isinstance(v, Col):
            return v if n < 0 else Col(Frame(v.frame.ordered().limit(n), v.frame.order, v.frame.by), v.name, v.kind)
        if isinstance(v, Vec):
            return Vec(v.kind, v.items[:n] if n >= 0 else v.items)
        if isinstance(v, (list, str)):
            return v[:n] if n >= 0 else v
        raise LangError(f"take of {kind_of(v)}")

    def drop(self, n: object, v: object) -> object:
        if not isinstance(n, int):
            raise LangError("drop has a number on the left")
        if isinstance(v, Col):
            f, at = self.position(v)
            place, n = f.fresh(), max(n, 0)
            out = f.among(f.df.filter(F.col(at) >= n).withColumn(place, F.col(at) - n), f.line(at), f.by, place)
            out.rows = None if f.rows is None else max(f.rows - n, 0)
            return Col(out, v.name, v.kind)
        if isinstance(v, Vec):
            return Vec(v.kind, v.items[max(n, 0) :])
        if isinstance(v, (list, str)):
            return v[max(n, 0) :]
        raise LangError(f"drop of {kind_of(v)}")

    def find(self, v: object, x: object) -> object:
        if isinstance(v, Col):
            f, at = self.position(v)
            hit = v.x == x if v.kind != "float" else N.feq(v.x, F.lit(float(x)))
            got = f.df.filter(hit).agg(F.min(at)).first()[0]
            return -1 if got is None else int(got)
        if not isinstance(v, Vec):
            raise LangError(f"find in {kind_of(v)}")
        return next((i for i, y in enumerate(v.items) if same(y, x) or (isinstance(y, (int, float)) and isinstance(x, (int, float)) and y == x)), -1)

    def member_of(self, x: object, v: object) -> object:
        if isinstance(v, Col):
            if not isinstance(x, Col):
                hit = lambda y: not v.frame.df.filter(v.x == (int(y) if isinstance(y, int) else y)).isEmpty()
                return Vec("bool", [hit(y) for y in x.items]) if isinstance(x, Vec) else hit(x)
            return self.member_column(x, v)
        if not isinstance(v, Vec):
            raise LangError("in has a vector on the right")
        if isinstance(x, Col):
            return Col(x.frame, x.frame.add(F.coalesce(x.x.isin(*v.items), F.lit(False))), "bool")
        held = set(v.items)
        return Vec("bool", [i in held for i in x.items]) if isinstance(x, Vec) else x in held

    def member_column(self, x: Col, v: Col) -> Col:
        """Whether each of ``x`` is among the different values of ``v``, by a join."""
        if "sym" in (x.kind, v.kind) or "str" in (x.kind, v.kind):
            if not {x.kind, v.kind} <= {"sym", "str"}:
                return Col(x.frame, x.frame.add(F.lit(False)), "bool")
        elif x.kind != v.kind:
            x = Col(x.frame, x.frame.add(self.double(x)), "float")
            v = Col(v.frame, v.frame.add(self.double(v)), "float")
        name, key = x.frame.fresh(), f"{x.frame.fresh()}k"
        held = v.frame.df.select(v.x.alias(key)).distinct().withColumn(name, F.lit(True))
        x.frame.df = x.frame.df.join(held, x.x == F.col(key), "left").drop(key)
        return Col(x.frame, x.frame.add(F.coalesce(F.col(name), F.lit(False))), "bool")

    def like(self, x: object, pattern: object) -> object:
        p = L.glob(str(pattern))
        if isinstance(x, Col):
            return Col(x.frame, x.frame.add(F.coalesce(x.x.rlike(p), F.lit(False))), "bool")
        test = lambda s: re.match(p, str(s), re.S) is not None
        return Vec("bool", [test(i) for i in x.items]) if isinstance(x, Vec) else test(x)

    # One argument.

    def on_monad(self, env: dict, name: str, node: tuple) -> object:
        return self.monad(name, self.value(node, env))

    def monad(self, name: str, v: object) -> object:
        if name in ("type", "null", "string", "key", "value", "count", "flip", "raze", "upper", "lower", "trim", "now", "til"):
            return getattr(self, "fn_" + name)(v)
        if name == "neg":
            return self.dyad("-" if kind_of(v).removesuffix("[]") != "dur" else "*", 0 if kind_of(v) != "dur" else -1, v) if kind_of(v) != "dur" else Dur(-v)
        if name == "not":
            if isinstance(v, Col) and v.kind == "bool":
                return Col(v.frame, v.frame.add(~v.x), "bool")
            if isinstance(v, Vec) and v.kind == "bool":
                return Vec("bool", [not x for x in v.items])
            if isinstance(v, bool):
                return not v
            raise LangError(f"not of {kind_of(v)}")
        if name in ("first", "last", "rev", "asc", "desc", "distinct", "group", "where", "prev", "next"):
            return getattr(self, "fn_" + name)(v)
        if name in L.MATH:
            if isinstance(v, Col):
                return Col(v.frame, v.frame.add(L.MATH_COLUMNS[name](self.double(v))), "float")
            items = self.floats(v)
            return Vec("float", [L.MATH[name](x) for x in items]) if isinstance(v, Vec) else L.MATH[name](items[0])
        if name in L.REDUCE:
            if isinstance(v, Col) and name == "med":
                row = median(v.frame.df.select(self.double(v).alias("v")), [], "v").first()
                return None if row is None or row[0] is None else float(row[0])
            if isinstance(v, Col):
                got = v.frame.df.agg(L.REDUCE_COLUMNS[name](self.double(v)), F.count(v.x)).first()
                if not got[1] and L.REDUCE[name][1] is LookupError:
                    raise LangError(f"{name} of an empty vector")
                return None if got[0] is None else float(got[0])
            f, empty = L.REDUCE[name]
            items = self.floats(v)
            if not items and empty is LookupError:
                raise LangError(f"{name} of an empty vector")
            return float(f(items)) if items else empty
        if name in L.RUN:
            if isinstance(v, Col):
                if name in ("fills", "ffill", "bfill") and v.kind != "float":
                    return v
                x = self.double(v)
                if name in ("deltas", "ratios"):
                    return Col(v.frame, v.frame.windowed(lambda over: L.RUN_COLUMNS[name](x, over), 1), "float")
                return Col(v.frame, v.frame.running("ffill" if name == "fills" else name, x), "float")
            if name in ("fills", "ffill", "bfill") and kind_of(v) != "float[]":
                return v
            return Vec("float", L.RUN[name](self.floats(v)))
        raise LangError(f"unknown function {name}")

    def double(self, c: Col) -> Column:
        if c.kind not in NUMERIC and c.kind != "ts":
            raise LangError(f"numbers are needed, not {c.kind}[]")
        return N.double(c.x, "boolean" if c.kind == "bool" else "double")

    def floats(self, v: object) -> list[float]:
        items = v.items if isinstance(v, Vec) else [v]
        if not all(isinstance(x, (int, float)) and not isinstance(x, Dur) for x in items):
            raise LangError(f"numbers are needed, not {kind_of(v)}")
        return [float(x) for x in items]

    def fn_type(self, v: object) -> Sym:
        return Sym(kind_of(v))

    def fn_null(self, v: object) -> bool:
        return v is None

    def fn_string(self, v: object) -> str:
        return show(v)

    def fn_key(self, v: object) -> Vec:
        return Vec("sym", [Sym(k) for k in (v.names if isinstance(v, Table) else sorted(v))])

    def fn_value(self, v: object) -> list:
        return [v.columns[n] for n in v.names] if isinstance(v, Table) else [v[k] for k in sorted(v)]

    def fn_count(self, v: object) -> int:
        if isinstance(v, Table):
            f = v.frame()
            return f.df.count() if f else max((len(c) for c in v.columns.values()), default=0)
        if isinstance(v, Col):
            return v.frame.df.count()
        return len(v) if isinstance(v, (Vec, list)) else len(v.encode()) if kind_of(v) == "str" else 1

    def fn_now(self, v: object) -> Ts:
        return Ts(time.time_ns())

    def fn_til(self, n: object) -> Vec:
        if not isinstance(n, int):
            raise LangError("til of a number")
        if n > LOCAL:
            return Col(Frame(self.spark.range(n).select(F.col("id").alias("__i")), ["__i"]), "__i", "int")
        return Vec("int", list(range(n)))

    def fn_upper(self, s: object) -> object:
        return self.text(s, str.upper, F.upper)

    def fn_lower(self, s: object) -> object:
        return self.text(s, str.lower, F.lower)

    def fn_trim(self, s: object) -> object:
        return self.text(s, str.strip, lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))

    def text(self, s: object, f: Callable, g: Callable[[Column], Column]) -> object:
        if isinstance(s, Col) and s.kind in ("sym", "str"):
            return Col(s.frame, s.frame.add(g(s.x)), s.kind)
        if kind_of(s) != "str":
            raise LangError(f"a string is needed, not {kind_of(s)}")
        return f(s)

    def fn_flip(self, v: object) -> list:
        rows = [x.items if isinstance(x, Vec) else x for x in v]
        return [[r[i] for r in rows] for i in range(len(rows[0]))] if rows else []

    def fn_raze(self, v: object) -> object:
        return [y for x in v for y in (x if isinstance(x, list) else [x])] if isinstance(v, list) else v

    def fn_first(self, v: object) -> object:
        return self.end(v, 0)

    def fn_last(self, v: object) -> object:
        return self.end(v, -1)

    def end(self, v: object, at: int) -> object:
        if isinstance(v, Col):
            order = F.struct(*[F.col(f"`{o}`") for o in [*v.frame.by, *v.frame.order]])
            row = v.frame.df.agg((F.min_by if at == 0 else F.max_by)(F.struct(v.x.alias("x")), order)).first()[0]
            if row is None:
                raise LangError("an empty vector has no first and no last")
            return from_spark(row[0], v.kind)
        if isinstance(v, (Vec, list)):
            items = v.items if isinstance(v, Vec) else v
            if not items:
                raise LangError("an empty vector has no first and no last")
            return items[at]
        return v

    def fn_rev(self, v: object) -> object:
        if isinstance(v, Col):
            f, at = self.position(v)
            # Where rows are counted their new places are known, and needn't be sorted for.
            last = f.rows - 1 if f.dealt() else 0
            return Col(f.among(f.df.withColumn("__rev", last - F.col(at)), ["__rev"], place="__rev" if f.dealt() else None), v.name, v.kind)
        return Vec(v.kind, v.items[::-1]) if isinstance(v, Vec) else v[::-1]

    def fn_asc(self, v: object) -> object:
        return self.sort(v, False)

    def fn_desc(self, v: object) -> object:
        return self.sort(v, True)

    def sort(self, v: object, down: bool) -> object:
        if kind_of(v) not in ("int[]", "float[]"):
            raise LangError(f"{kind_of(v)} can't be sorted")
        if isinstance(v, Col):
            f = v.frame
            key = f.add(-v.x if down else v.x)
            return Col(f.among(f.df, [key, *f.by, *f.order]), v.name, v.kind)
        return Vec(v.kind, sorted(v.items, key=lambda x: (math.isnan(x), -x if down else x)))

    def fn_distinct(self, v: object) -> object:
        if isinstance(v, Col):
            f, at = self.position(v)
            g = f.df.groupBy(v.x.alias("__d")).agg(F.min(at).alias("__first"))
            return Col(Frame(g, ["__first"]), "__d", v.kind)
        out: list = []
        for x in v.items:
            if not any(same(x, y) for y in out):
                out.append(x)
        return Vec(v.kind, out)

    def fn_group(self, v: object) -> dict:
        if kind_of(v) not in ("int[]", "sym[]"):
            raise LangError(f"{kind_of(v)} can't be grouped")
        if isinstance(v, Col):
            f, at = self.position(v)
            return Groups(f, f.add(v.x.cast("string")), at)
        out: dict[str, Vec] = {}
        for i, x in enumerate(v.items):
            out.setdefault(str(x), Vec("int", [])).items.append(i)
        return dict(sorted(out.items()))

    def fn_where(self, v: object) -> object:
        if kind_of(v) != "bool[]":
            raise LangError(f"where of {kind_of(v)}")
        if isinstance(v, Col):
            f, at = self.position(v)
            return Col(f.among(f.df.filter(v.x), f.line(at), f.by), at, "int")
        return Vec("int", [i for i, x in enumerate(v.items) if x])

    def fn_prev(self, v: object) -> object:
        return self.shift(v, 1)

    def fn_next(self, v: object) -> object:
        return self.shift(v, -1)

    def shift(self, v: object, by: int) -> object:
        if kind_of(v) not in ("int[]", "float[]"):
            raise LangError(f"{kind_of(v)} can't be shifted")
        empty = 0 if v.kind == "int" else N.NAN
        if isinstance(v, Col):
            x = v.x
            return Col(v.frame, v.frame.windowed(lambda over: W.shifted(x, by, over, empty), max(by, 0), max(-by, 0)), v.kind)
        return Vec(v.kind, ([empty, *v.items[:-1]] if by > 0 else [*v.items[1:], empty]) if v.items else [])

    # Calls.

    def on_call(self, env: dict, node: tuple, args: list) -> object:
        f = self.eval(node, env)
        values = [self.value(a, env) for a in args]
        if isinstance(f, (Lambda, Builtin)):
            return self.apply(f, values, env)
        f = self.settle(f)
        if len(values) != 1:
            raise LangError(f"{kind_of(f)} can't be called")
        return self.index(f, values[0])

    def apply(self, f: object, args: list, env: dict) -> object:
        if isinstance(f, Lambda):
            scope = dict(env) | {p: args[i] if i < len(args) else None for i, p in enumerate(f.params)}
            return self.value(f.body, scope)
        if isinstance(f, Builtin):
            if f.name in BRACKET:
                return self.bracket(f.name, args)
            return self.monad(f.name, args[0] if args else None)
        raise LangError(f"{kind_of(f)} can't be called")

    def bracket(self, name: str, args: list) -> object:
        arity = {"resample": 4, "asof": 4}.get(name, 2)
        if len(args) != arity:
            raise LangError(f"{name} takes {arity} arguments")
        if name in L.MOVE:
            n, v = args
            if not isinstance(n, int) or n <= 0:
                raise LangError(f"{name} of {show(n)} rows")
            if isinstance(v, Col):
                x = self.double(v)
                return Col(v.frame, v.frame.windowed(lambda over: W.weighted_moving(n, x, over) if name == "wma" else W.moving(name, n, x, over), n - 1), "float")
            return Vec("float", L.MOVE[name](n, self.floats(v)))
        return getattr(self, "call_" + name)(*args)

    def call_ema(self, alpha: object, v: object) -> object:
        if isinstance(v, Col):
            f = v.frame
            value, place = f.add(self.double(v)), f.places() if f.dealt() else None
            out = ema_blocks(f.df, float(alpha), value, "__ema", place, f.BLOCK, f.rows) if place else ema(f.df, float(alpha), value, f.order, f.by, "__ema")
            return Col(f.among(out, f.order, f.by, place), "__ema", "float")
        return Vec("float", smooth(self.floats(v), float(alpha)))

    def call_xbar(self, d: object, v: object) -> object:
        if isinstance(v, Col):
            return Col(v.frame, v.frame.add(N.bucket(v.x, int(d))), v.kind)
        cut = lambda x: 0 if d <= 0 else int(math.copysign(abs(x) // d * d, x))
        return Vec(v.kind, [Ts(cut(x)) if v.kind == "ts" else cut(x) for x in v.items]) if isinstance(v, Vec) else type(v)(cut(v))

    def call_pct(self, p: object, v: object) -> object:
        if isinstance(v, Col):
            row = nearest_rank_rows(v.frame.df.select(self.double(v).alias("v")), [], "v", {"p": float(p)}).first()
            return None if row is None or row[0] is None else float(row[0])
        items = self.floats(v)
        return L.nearest_rank(float(p), items) if items else None

    def pair(self, a: object, b: object) -> tuple[Col, Col] | None:
        if isinstance(a, Col) or isinstance(b, Col):
            return self.zip(*(x if isinstance(x, Col) else self.spread(x) for x in (a, b)))
        if len(a) != len(b):
            raise LangError(f"lengths {len(a)} and {len(b)}")
        return None

    def call_wavg(self, w: object, v: object) -> float | None:
        if (both := self.pair(w, v)) is not None:
            got = both[0].frame.df.agg(weighted_mean(*map(self.double, both))).first()[0]
            return None if got is None else float(got)
        a, b = self.floats(w), self.floats(v)
        return L.div(sum(x * y for x, y in zip(a, b, strict=True)), sum(a))

    def call_cor(self, a: object, b: object) -> float:
        if (both := self.pair(a, b)) is not None:
            got = both[0].frame.df.agg(correlation(*map(self.double, both))).first()[0]
            return N.NAN if got is None else float(got)
        x, y = self.floats(a), self.floats(b)
        mx, my = (sum(v) / max(len(v), 1) for v in (x, y))
        over = math.sqrt(sum((v - mx) ** 2 for v in x) * sum((v - my) ** 2 for v in y))
        return L.div(sum((p - mx) * (q - my) for p, q in zip(x, y, strict=True)), over) if over else N.NAN

    def call_resample(self, d: object, ts: object, v: object, f: object) -> Table:
        ts, v = (x if isinstance(x, Col) else self.spread(x) for x in (ts, v))
        ts, v = self.zip(ts, v)
        name = f.name if isinstance(f, Builtin) else ""
        x, order = self.double(v), F.struct(*[F.col(f"`{o}`") for o in v.frame.order])
        if name == "med":
            keyed = v.frame.df.select(N.bucket(ts.x, int(d)).alias("ts"), x.alias("v"))
            frame = Frame(median(keyed, ["ts"], "v", "value"), ["ts"])
            return Table(["ts", "value"], {"ts": Col(frame, "ts", ts.kind), "value": Col(frame, "value", "float")})
        if name in L.REDUCE_COLUMNS:
            agg = L.REDUCE_COLUMNS[name](x)
        elif name == "count":
            agg = F.count(F.lit(1)).cast("double")
        elif name in ("first", "last"):
            agg = (F.min_by if name == "first" else F.max_by)(x, order)
        else:
            raise LangError("resample takes a function from a vector to a number")
        g = v.frame.df.groupBy(N.bucket(ts.x, int(d)).alias("ts")).agg(agg.alias("value"))
        frame = Frame(g, ["ts"])
        return Table(["ts", "value"], {"ts": Col(frame, "ts", ts.kind), "value": Col(frame, "value", "float")})

    def call_asof(self, tl: object, vl: object, tr: object, vr: object) -> Table:
        spread = lambda x: x if isinstance(x, Col) else self.spread(x)
        (tl, vl), (tr, vr) = self.zip(spread(tl), spread(vl)), self.zip(spread(tr), spread(vr))

        def side(t: Col, v: Col):
            at = t.frame.places()
            return t.frame.df.select(t.x.alias("ts"), v.x.alias("v"), F.col(at).alias("__i"))

        out = asof(side(tl, vl), side(tr, vr), "ts", "v", None, "__i", "__i", "right")
        frame = Frame(out.withColumn("right", F.coalesce(F.col("right").cast("double"), F.lit(N.NAN))), ["__i"])
        return Table(["ts", "left", "right"], {"ts": Col(frame, "ts", tl.kind), "left": Col(frame, "v", vl.kind), "right": Col(frame, "right", "float")})

    def index(self, v: object, i: object) -> object:
        if isinstance(v, dict):
            if str(i) not in v:
                raise LangError(f"no key {i}")
            return v[str(i)]
        if isinstance(v, Table):
            if isinstance(i, Sym):
                if i not in v.columns:
                    raise LangError(f"no column {i}")
                return v.columns[i]
            if isinstance(i, int):
                return {n: self.index(v.columns[n], i) for n in v.names}
        if kind_of(i) == "bool[]":
            if isinstance(v, Col) or isinstance(i, Col):
                a, b = self.zip(*(x if isinstance(x, Col) else self.spread(x) for x in (v, i)))
                return Col(a.frame.among(a.frame.df.filter(b.x), a.frame.order, a.frame.by), a.name, a.kind)
            if len(v) != len(i):
                raise LangError(f"lengths {len(v)} and {len(i)}")
            return Vec(v.kind, [x for x, m in zip(v.items, i.items, strict=True) if m])
        if isinstance(i, Col):
            if i.kind != "int":
                raise LangError(f"an index of {kind_of(i)}")
            f, at = self.position(v if isinstance(v, Col) else self.spread(v))
            g, order = i.frame, [*i.frame.by, *i.frame.order]
            named = [f"__q{n}" for n in range(len(order))]
            values = f.df.select(F.col(at).alias("__p"), F.col(f"`{v.name if isinstance(v, Col) else '__x'}`").alias("__w"))
            places = g.df.select(*(F.col(f"`{o}`").alias(q) for o, q in zip(order, named, strict=True)), i.x.alias("__p"))
            of = f if f.dealt() else g
            if of.dealt():
                values, places = (by_blocks(x, of.rows, of.BLOCK, "__p") for x in (values, places))
            return Col(g.among(places.join(values, "__p"), named), "__w", v.kind)
        if isinstance(v, Col):
            n = self.fn_count(v) if any(x < 0 for x in (i.items if isinstance(i, Vec) else [i])) else 0
            wanted = [x + n if x < 0 else x for x in (i.items if isinstance(i, Vec) else [i])]
            f, at = self.position(v)
            got = {r[0]: from_spark(r[1], v.kind) for r in f.df.filter(F.col(at).isin(*wanted)).select(at, v.x).collect()}
            if any(w not in got for w in wanted):
                raise LangError("index out of range")
            return Vec(v.kind, [got[w] for w in wanted]) if isinstance(i, Vec) else got[wanted[0]]
        items = v.items if isinstance(v, Vec) else v
        if isinstance(items, list):
            try:
                if isinstance(i, Vec):
                    got = [items[x] for x in i.items]
                    return Vec(v.kind, got) if isinstance(v, Vec) else got
                return items[i]
            except IndexError:
                raise LangError("index out of range") from None
        raise LangError(f"{kind_of(v)} can't be indexed")

    def on_lambda(self, env: dict, params: list, body: tuple) -> Lambda:
        return Lambda(params, body)

    def on_pipe(self, env: dict, left: tuple, right: tuple) -> object:
        return self.apply(self.eval(right, env), [self.value(left, env)], env)

    def on_cond(self, env: dict, parts: list) -> object:
        for i in range(0, len(parts) - 1, 2):
            if self.truth(self.value(parts[i], env)):
                return self.value(parts[i + 1], env)
        return self.value(parts[-1], env)

    def truth(self, v: object) -> bool:
        return v != 0 and not (isinstance(v, float) and math.isnan(v)) if isinstance(v, (int, float)) else v is not None

    def on_choose(self, env: dict, parts: list) -> object:
        """?[mask; a; b]: element by element."""
        mask, a, b = (self.value(p, env) for p in parts)
        if isinstance(mask, Col):
            a, b = (self.spread(x) if isinstance(x, Vec) else x for x in (a, b))
            for other in (a, b):
                if isinstance(other, Col) and other.frame is not mask.frame:
                    raise LangError("the parts of ?[] are of one measurement")
            kind = a.kind if isinstance(a, Col) else kind_of(a)
            x, y = (v.x if isinstance(v, Col) else F.lit(v) for v in (a, b))
            return Col(mask.frame, mask.frame.add(F.when(mask.x, x).otherwise(y)), kind)
        at = lambda v, i: v.items[i] if isinstance(v, Vec) else v
        out = [at(a, i) if m else at(b, i) for i, m in enumerate(mask.items)]
        return Vec(kind_of(out[0]) if out else "float", out)

    def on_list(self, env: dict, nodes: list) -> object:
        items = [self.value(n, env) for n in nodes]
        kinds = {kind_of(x) for x in items}
        if kinds and kinds <= {"int", "float"} and len(kinds) == 2:
            return Vec("float", [float(x) for x in items])
        return Vec(kinds.pop(), items) if len(kinds) == 1 and kinds <= {"int", "float", "bool", "sym", "ts"} else items

    def on_table(self, env: dict, cols: list) -> Table:
        made = {n: self.value(v, env) for n, v in cols}
        made = {n: v if isinstance(v, (Vec, Col)) else Vec(kind_of(v), [v]) for n, v in made.items()}
        names = [n for n, _ in cols]
        if any(isinstance(v, Col) for v in made.values()):
            first: Col | None = None
            done: dict[str, Vec | Col] = {}
            for n in names:
                c = made[n] if isinstance(made[n], Col) else self.spread(made[n])
                if first is not None and c.frame is not first.frame:
                    raise LangError("a table's columns are of one measurement")
                first, done[n] = first or c, c
            return Table(names, done)
        if len({len(v) for v in made.values()}) > 1:
            raise LangError("a table's columns have one length")
        return Table(names, dict(made))

    def on_iterate(self, env: dict, kind: str, func: tuple, arg: tuple) -> object:
        f, v = self.eval(func, env), self.value(arg, env)
        if not isinstance(f, (Lambda, Builtin)):
            raise LangError(f"{kind_of(f)} can't be applied to each")
        if isinstance(v, Col):
            return self.iterate_column(env, kind, f, v)
        items = v.items if isinstance(v, Vec) else v if isinstance(v, list) else [v]
        one = lambda *xs: self.apply(f, list(xs), env)
        if kind == "'":
            return [one(x) for x in items]
        if kind == "':":
            return [one(x, items[i - 1]) if i else x for i, x in enumerate(items)]
        out: list = []
        for x in items:
            out.append(one(out[-1], x) if out else x)
        return out if kind == "\\" else out[-1] if len(items) > 1 else v

    def iterate_column(self, env: dict, kind: str, f: object, v: Col) -> object:
        """Lambdas on a measurement's vector: each and each-prior are columns; folds of + * and the
        like are aggregates and running windows, others run over the collected vector."""
        if kind == "'":
            return self.settle(self.apply(f, [v], env))
        if kind == "':":
            x = v.x
            before = Col(v.frame, v.frame.windowed(lambda over: F.lag(x).over(over), 1), v.kind)
            if v.frame.dealt():
                first = Col(v.frame, v.frame.add(F.col(v.frame.places()) == 0), "bool")
            else:
                first = Col(v.frame, v.frame.windowed(lambda over: F.row_number().over(over) == 1, 1), "bool")
            got = self.apply(f, [v, before], env)
            return Col(v.frame, v.frame.add(F.when(first.x, v.x).otherwise(got.x)), got.kind)
        body = f.body if isinstance(f, Lambda) else None
        known = {"+": ("sum", "sums"), "*": (None, "prds")}
        if body and body[0] == "dyad" and body[2:] == (("name", f.params[0]), ("name", f.params[1])) and body[1] in known:
            whole, run = known[body[1]]
            if kind == "\\":
                return self.monad(run, v)
            return self.monad(whole, v) if whole else self.end(self.monad(run, v), -1)
        return self.fold(f, v, env, kind == "\\")

    def fold(self, f: object, v: Col, env: dict, scan: bool) -> object:
        """A fold whose steps depend on one another: a loop over the sorted rows in one task, which
        holds one value. Its kind is that of the first step, which is made here."""
        head = v.frame.ordered().select(v.x).limit(2).collect()
        if len(head) < 2:
            return v.local()
        first = self.apply(f, [from_spark(r[0], v.kind) for r in head], env)
        kind = kind_of(first)
        if kind not in SPARK or (kind != v.kind and {kind, v.kind} - {"int", "float"}):
            raise LangError(f"a fold of a measurement gives numbers or names, not {kind}")
        kind = "float" if "float" in (kind, v.kind) else kind
        plain = {n: x for n, x in (self.env | env).items() if not isinstance(x, (Col, Table, Groups, Measure))}
        ship(self.spark)
        source, of = v.frame.df.select(*(F.col(f"`{o}`") for o in dict.fromkeys([*v.frame.by, *v.frame.order])), v.x.alias("__fold")), v.kind
        name, order = f"__s{self.spark.sparkContext.defaultParallelism}", [*v.frame.by, *v.frame.order]
        ordered = source.repartition(1).sortWithinPartitions(*order)
        schema = T.StructType([*source.drop("__fold").schema.fields, T.StructField(name, {"int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType()}.get(kind, T.StringType()))])

        def run(batches):
            session, e, begun = Session(None, lambda n: None), None, False
            session.env = plain
            for b in batches:
                at = b.schema.get_field_index("__fold")
                out = []
                for x in b.column(at).to_pylist():
                    x = from_spark(x, of)
                    e, begun = (session.apply(f, [e, x], {}) if begun else x), True
                    out.append(float(e) if kind == "float" else e if kind in ("int", "bool") else str(e))
                kept = [b.column(i) for i in range(b.num_columns) if i != at]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(out, schema_type(kind))], names=schema.names)

        got = Col(Frame(ordered.mapInArrow(run, schema), v.frame.order, v.frame.by), name, kind)
        return got if scan else self.end(got, -1)

    def on_select(self, env: dict, fields: list, source: str, where: tuple | None, by: list) -> Table:
        m = self.measurements(source)
        if m is None:
            raise LangError(f"no measurement {source}")
        s = Select(source, where=None if where is None else self.tag_predicate(where, env))
        funcs = {"count", "sum", "avg", "mean", "min", "max", "first", "last", "dev", "stddev"}
        for func, field, alias in fields:
            if func is None:
                s.fields.append(field)
            elif func not in funcs:
                raise LangError(f"unknown aggregate {func}")
            else:
                s.aggs.append(Agg("stddev" if func == "dev" else func, field, None, alias))
        for node in by:
            if node[0] == "call" and node[1] == ("name", "xbar"):
                s.bucket = int(self.value(node[2][0], env))
            elif node[0] == "name" and (node[1] in m.tags):
                s.group.append(node[1])
            else:
                d = self.value(node, env)
                if not isinstance(d, (Dur, int)) or isinstance(d, bool):
                    raise LangError("by takes a duration, xbar or a tag")
                s.bucket = int(d)
        df = compile_select(s, m)
        frame = Frame(df.withColumnRenamed("time", "ts"), ["ts", *s.group])
        names = [c for c in frame.df.columns]
        kinds = {"bigint": "int", "double": "float", "string": "sym", "boolean": "bool"}
        return Table(names, {n: Col(frame, n, "ts" if n == "ts" else kinds.get(t, "float")) for n, t in frame.df.dtypes})
