"""IEEE arithmetic as columns: Spark's ANSI mode raises where floats give infinities or NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")
#: Numbers nearer than this are equal.
EPSILON = 2.220446049250313e-16


def double(x: Column, kind: str = "double") -> Column:
    """A field as double: booleans are 1 and 0, strings null."""
    if kind == "boolean":
        return x.cast("int").cast("double")
    return F.lit(None).cast("double") if kind == "string" else x.cast("double")


def fdiv(a: Column, b: Column) -> Column:
    a, b = a.cast("double"), b.cast("double")
    over_zero = F.when(F.isnan(a) | (a == 0), NAN).when(a > 0, INF).otherwise(-INF)
    return F.when(b.isNull() | a.isNull(), None).when(b == 0, over_zero).otherwise(F.try_divide(a, b))


def fmod(a: Column, b: Column) -> Column:
    """Remainder with the sign of the dividend; NaN by 0."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b == 0, NAN).otherwise(a % F.when(b != 0, b))


def imod(a: Column, b: Column) -> Column:
    """Remainder of integers; 0 by 0."""
    return F.when(b == 0, F.lit(0)).otherwise(a % F.when(b != 0, b))


def feq(a: Column, b: Column) -> Column:
    a, b = a.cast("double"), b.cast("double")
    return (a == b) | (F.abs(a - b) < EPSILON)


def compare(op: str, a: Column, b: Column) -> Column:
    """Order of floats: nothing is less or greater than NaN."""
    a, b = a.cast("double"), b.cast("double")
    ok = ~F.isnan(a) & ~F.isnan(b)
    return ok & {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]


def quiet(x: Column) -> Column:
    """NaN as null, for minima and maxima that pass over it."""
    return F.when(~F.isnan(x), x)


def flog(x: Column) -> Column:
    x = x.cast("double")
    return F.when(x == 0, -INF).when(x < 0, NAN).otherwise(F.ln(F.when(x > 0, x).when(F.isnan(x), NAN)))


def fround(x: Column, up: bool) -> Column:
    x = x.cast("double")
    whole = F.abs(x) < 2.0**53
    safe = F.when(whole, x)
    return F.when(whole, (F.ceil(safe) if up else F.floor(safe)).cast("double")).otherwise(x)


def fsignum(x: Column) -> Column:
    """1 for 0 as for positives, -1 for -0."""
    x = x.cast("double")
    negative_zero = x.cast("string") == "-0.0"
    return F.when(F.isnan(x), NAN).when((x > 0) | ((x == 0) & ~negative_zero), 1.0).otherwise(-1.0)


def bucket(ts: Column, width: int) -> Column:
    """Start of the bucket, cut toward zero; no width is one bucket at 0."""
    return F.lit(0).cast("long") if width <= 0 else F.call_function("div", ts, F.lit(width).cast("long")) * F.lit(width).cast("long")
