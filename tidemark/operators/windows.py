"""Order-sensitive vector functions as window columns.

``over`` is a window with an order (and, at scale, a partition: by series or tag).
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.numeric import NAN, fdiv, quiet


def _size(n: int) -> int:
    if n <= 0:
        raise ValueError(f"a window of {n} rows")
    return n


def moving(func: str, n: int, x: Column, over: WindowSpec) -> Column:
    """mavg msum mmin mmax mdev mcount over the last ``n`` rows, fewer at the start."""
    w = over.rowsBetween(-(_size(n) - 1), 0)
    if func == "mavg":
        return F.avg(x).over(w)
    if func == "msum":
        return F.sum(x).over(w)
    if func == "mmin":
        return F.coalesce(F.min(quiet(x)).over(w), F.lit(NAN))
    if func == "mmax":
        return F.coalesce(F.max(quiet(x)).over(w), F.lit(NAN))
    if func == "mdev":
        return F.stddev_pop(x).over(w)
    if func == "mcount":
        return F.count(quiet(x)).over(w).cast("double")
    raise ValueError(f"unknown moving function {func!r}")


def weighted_moving(n: int, x: Column, over: WindowSpec) -> Column:
    """wma: weights 1 to k from the oldest to the newest of the frame's k rows.

    Each frame is summed with its own weights, so nothing is lost to cancellation far into a
    vector."""
    frame = F.collect_list(F.struct(x.alias("x"))).over(over.rowsBetween(-(_size(n) - 1), 0))
    k = F.size(frame)
    weighted = F.aggregate(F.transform(frame, lambda e, i: e["x"] * (i + 1)), F.lit(0.0), lambda a, e: a + e)
    return weighted / (k * (k + 1) / 2)


def running(func: str, x: Column, over: WindowSpec) -> Column:
    """sums avgs mins maxs prds from the first row on."""
    w = over.rowsBetween(Window.unboundedPreceding, 0)
    if func == "sums":
        return F.sum(x).over(w)
    if func == "avgs":
        return F.avg(x).over(w)
    if func == "mins":
        return F.coalesce(F.min(quiet(x)).over(w), F.lit(NAN))
    if func == "maxs":
        return F.coalesce(F.max(quiet(x)).over(w), F.lit(NAN))
    if func == "prds":
        return F.product(x).over(w)
    raise ValueError(f"unknown running function {func!r}")


def deltas(x: Column, over: WindowSpec) -> Column:
    """Differences to the row before; the first is the value itself."""
    return x - F.when(F.row_number().over(over) == 1, F.lit(0).cast("double")).otherwise(F.lag(x).over(over))


def ratios(x: Column, over: WindowSpec) -> Column:
    """Quotients by the row before; the first is NaN."""
    return F.when(F.row_number().over(over) == 1, F.lit(NAN)).otherwise(fdiv(x, F.lag(x).over(over)))


def shifted(x: Column, by: int, over: WindowSpec, empty: object) -> Column:
    """prev (by 1) and next (by -1); ``empty`` is at the end left bare."""
    return F.lag(x, by, empty).over(over) if by > 0 else F.lead(x, -by, empty).over(over)


def fill_forward(x: Column, over: WindowSpec) -> Column:
    return F.coalesce(F.last(quiet(x), ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, 0)), x)


def fill_backward(x: Column, back: WindowSpec) -> Column:
    """``back`` has the order falling: Spark reads a frame that ends with the last row afresh for
    every row, one that begins with the first only once."""
    return fill_forward(x, back)
