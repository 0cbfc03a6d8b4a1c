"""Statements of the dialect as lazy DataFrames."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numeric import bucket, double
from tidemark.model import Measurement
from tidemark.operators.aggregates import aggregate, nearest_rank
from tidemark.operators.filling import fill

from .dialect import Agg, Compare, Logic, Select

MIN_NS, MAX_NS = -(2**63), 2**63 - 1


def time_range(where: object) -> tuple[int, int]:
    """The closed range of times outside which no row can pass: ands narrow it, ors widen it."""
    if isinstance(where, Logic):
        a, b = time_range(where.left), time_range(where.right)
        if where.op == "and":
            return max(a[0], b[0]), min(a[1], b[1])
        return min(a[0], b[0]), max(a[1], b[1])
    if isinstance(where, Compare) and where.name == "time":
        v = where.value
        if where.op == "between":
            return v
        return {"=": (v, v), "<": (MIN_NS, v - 1), "<=": (MIN_NS, v), ">": (v + 1, MAX_NS), ">=": (v, MAX_NS)}.get(where.op, (MIN_NS, MAX_NS))
    return MIN_NS, MAX_NS


def _valid(pattern: str) -> bool:
    """Whether Java, whose patterns Spark's are, takes it."""
    try:
        SparkSession.active().sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, IllegalArgumentException):
        return False
    return True


def predicate(where: object, m: Measurement) -> Column:
    """A row's truth. A missing tag is unequal to everything and matches no pattern; comparisons
    of tags are of strings, those of fields of their own type."""
    if isinstance(where, Logic):
        a, b = predicate(where.left, m), predicate(where.right, m)
        return a & b if where.op == "and" else a | b
    name, op, v = where.name, where.op, where.value
    if name == "time":
        t = F.col("ts_ns")
        if op == "between":
            return t.between(*v)
        return {"=": t == v, "!=": t != v, "<": t < v, "<=": t <= v, ">": t > v, ">=": t >= v}[op]
    if name in m.tags:
        x = F.col(f"`{name}`").cast("string")
        v = tuple(map(str, v)) if op == "in" else str(v)
    elif name in m.fields:
        x = F.col(f"`{name}`")
    else:
        return F.lit(op in ("!=", "!~"))
    no = F.lit(False)
    if op == "=":
        return F.coalesce(x == v, no)
    if op == "!=":
        return ~F.coalesce(x == v, no)
    if op == "in":
        return F.coalesce(x.isin(*v), no)
    if op in ("=~", "!~"):
        found = F.coalesce(x.rlike(v), no) if _valid(v) else no
        return found if op == "=~" else ~found
    return F.coalesce({"<": x < v, "<=": x <= v, ">": x > v, ">=": x >= v}[op], no)


def scan(m: Measurement, where: object) -> DataFrame:
    low, high = time_range(where)
    df = m.between(None if low == MIN_NS else low, None if high == MAX_NS else high)
    return df if where is None else df.filter(predicate(where, m))


def compile_select(s: Select, m: Measurement) -> DataFrame:
    """``time`` (long, nanoseconds), the grouping tags, then fields or aggregates, in order of time
    and tags. Raw fields beside an aggregate are passed over; ORDER BY, LIMIT and OFFSET apply to
    the result's rows."""
    df = scan(m, s.where)
    if not s.aggs:
        fields = m.fields if s.wildcard else s.fields
        chosen = [F.col(f"`{f}`") if f in m.fields else F.lit(None).cast("double").alias(f) for f in fields]
        order = m.ordering()
        if s.descending:
            order[0] = order[0].desc()
        out = df.orderBy(*order).select(F.col("ts_ns").alias("time"), *chosen)
        return _page(out, s)
    order = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(m.ordering())])
    plain = [_aggregate(a, m, order) for a in s.aggs if a.func != "percentile"]
    tags = [F.coalesce(F.col(f"`{t}`").cast("string"), F.lit("")).alias(t) if t in m.tags else F.lit("").alias(t) for t in s.group]
    names = [f"`{t}`" for t in s.group]
    columns = [F.col(f"`{a.name}`") for a in s.aggs]
    if s.bucket is None and not s.group:
        out = df.agg(F.count("*").alias("__rows"), *plain)
        for ranked in _ranked(df, [], s, m):  # one row each
            out = out.join(F.broadcast(ranked), how="left")
        return _page(out.select(F.lit(None).cast("long").alias("time"), *columns), s)
    keys = [*(["time"] if s.bucket is not None else []), *s.group]
    time = bucket(F.col("ts_ns"), s.bucket) if s.bucket is not None else F.lit(None).cast("long")
    keyed = df.select(time.alias("time"), *tags, *_inputs(s, m, df))
    out = keyed.groupBy(*(f"`{k}`" for k in keys)).agg(F.count("*").alias("__rows"), *plain)
    for ranked in _ranked(keyed, keys, s, m):
        out = out.join(ranked, keys, "left")
    if s.bucket is None:
        out = out.withColumn("time", F.lit(None).cast("long"))
    out = out.select("time", *names, *columns)
    if s.bucket is not None:
        out = fill(out, s.bucket, s.group, {a.name: a.func.startswith("count") for a in s.aggs}, s.fill)
    order = [F.col("time").desc() if s.descending else F.col("time"), *(F.col(f"`{t}`") for t in sorted(s.group))]
    return _page(out.orderBy(*order), s)


def _aggregate(a: Agg, m: Measurement, order: Column) -> Column:
    known = a.field in m.tags or a.field in m.fields
    if a.func == "count_distinct":  # of a tag or a field, as it is
        return (F.count_distinct(F.col(f"`{a.field}`")).cast("double") if known else F.lit(0.0)).alias(a.name)
    x = double(F.col(f"`{a.field}`"), m.kind(a.field)) if a.field in m.fields else F.lit(None).cast("double")
    return aggregate(a.func, x, order).alias(a.name)


def _ranked(df: DataFrame, keys: list[str], s: Select, m: Measurement) -> list[DataFrame]:
    """A table of percentiles for each field that has some."""
    wanted: dict[str, dict[str, float]] = {}
    for a in s.aggs:
        if a.func == "percentile":
            wanted.setdefault(a.field, {})[a.name] = a.p
    out = []
    for f, ranks in wanted.items():
        x = double(F.col(f"`{f}`"), m.kind(f)) if f in m.fields else F.lit(None).cast("double")
        out.append(nearest_rank(df.select(*(F.col(f"`{k}`") for k in keys), x.alias("__value")), keys, "__value", ranks))
    return out


def _inputs(s: Select, m: Measurement, df: DataFrame) -> list[Column]:
    """The scanned columns that aggregates and their order need, but for those grouped by."""
    need = {"ts_ns", *m.tags, *m.order, *(a.field for a in s.aggs if a.field in m.fields)}
    return [F.col(f"`{c}`") for c in df.columns if c in need and c not in s.group and c != "time"]


def _page(df: DataFrame, s: Select) -> DataFrame:
    if s.offset:
        df = df.offset(s.offset)
    return df if s.limit is None else df.limit(s.limit)
