"""One order over all rows without one task for all rows: blocks of places.

Rows get their place in the order once; a block is a run of places. Windows that reach a bounded
number of rows get the rows next to their block as well; running functions get what the blocks
before add up to. So each needs one shuffle by blocks of equal size, whatever the keys are. There
are more tasks the more rows there are, so that none holds more than a few blocks.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.numeric import NAN, quiet
from tidemark.scratch import scratch_path

from . import windows as W

#: Places of a block, and the size (as planned) from which rows are counted. An order of more rows
#: than a block's is dealt into blocks; sizes don't tell, as a file may have 5 bytes a row.
BLOCK, LARGE = 1 << 17, 1 << 20


def many(df: DataFrame, least: int = LARGE, block: int = BLOCK) -> int | None:
    """The number of rows if they are more than a block's; None if one sort in one task will do."""
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < least:
        return None
    rows = df.count()
    return rows if rows > block else None


def numbered(df: DataFrame, order: list[Column | str], name: str = "__i", rows: int | None = None, block: int = BLOCK) -> tuple[DataFrame, int]:
    """``df`` with each row's place from 0 on, for an order that is total, and how many there are.
    ``rows``, if known, is how many there may be.

    Rows are dealt by ranges of the order, about a block each, sorted there and written to the shared
    folder with their number within the range, so that what is counted and what is numbered are the
    same. A place is that number and the rows of the ranges before, of which the driver has one
    number a range."""
    spark = df.sparkSession
    rows = df.count() if rows is None else rows
    parts = max(2, min(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // 10_000), -(-rows // block))
    # The range's number is above the lower 33 bits, the row's within its range in them.
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())
    path = scratch_path(spark, "ranges")
    dealt.write.parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path)
    at = F.shiftright(name, 33).cast("int")
    counts = dict(dealt.groupBy(at.alias("range")).agg(F.count("*")).collect())
    starts = list(accumulate((counts.get(i, 0) for i in range(parts)), initial=0))
    before = F.get(F.expr("array(" + ", ".join(f"{n}L" for n in starts) + ")"), at)
    return dealt.withColumn(name, before + F.col(name).bitwiseAND(F.lit((1 << 33) - 1))), starts[-1]


def by_blocks(df: DataFrame, rows: int | None, block: int = BLOCK, *keys: str) -> DataFrame:
    """``df`` dealt by ``__block``, or ``keys``, by hash over twice as many tasks as there are blocks
    among ``rows``, so that a task has few blocks however many there are."""
    return df if rows is None else df.repartition(2 * max(1, -(-rows // block)), *(keys or ("__block",)))


def near(
    df: DataFrame, columns: dict[str, Callable[[WindowSpec], Column]], before: int, after: int, place: str = "__i", block: int = BLOCK, rows: int | None = None
) -> DataFrame:
    """``df`` with columns of windows over the order of places that reach ``before`` rows back and
    ``after`` rows ahead at most. Rows that near a border are copied into the next block, and don't
    come out of it."""
    block = max(block, before, after)
    own = F.call_function("div", F.col(place), F.lit(block).cast("long"))
    at = F.col(place) % block
    to = F.filter(
        F.array(own, *([F.when(at >= block - before, own + 1)] if before else []), *([F.when((at < after) & (own > 0), own - 1)] if after else [])), lambda x: x.isNotNull()
    )
    over = Window.partitionBy("__block").orderBy(place)
    out = by_blocks(df.withColumn("__block", F.explode(to)), rows, block)
    return out.select("*", *(f(over).alias(n) for n, f in columns.items())).filter(F.col("__block") == own).drop("__block")


def _edge(func: str, x: Column, place: str) -> Column:
    """What a block adds to those after it (before it, for bfill)."""
    return {
        "sums": lambda: F.sum(x), "avgs": lambda: F.sum(x), "mins": lambda: F.min(quiet(x)), "maxs": lambda: F.max(quiet(x)), "prds": lambda: F.product(x),
        "ffill": lambda: F.max_by(x, F.when(x.isNotNull() & ~F.isnan(x), F.col(place))), "bfill": lambda: F.min_by(x, F.when(x.isNotNull() & ~F.isnan(x), F.col(place))),
    }[func]()


def running(df: DataFrame, func: str, value: str, name: str, place: str = "__i", block: int = BLOCK, rows: int | None = None) -> DataFrame:
    """``df`` with ``name``: sums avgs mins maxs prds ffill bfill of a column of doubles over places."""
    x = F.col(f"`{value}`")
    blocked = df.withColumn("__block", F.call_function("div", F.col(place), F.lit(block).cast("long")))
    edges = blocked.groupBy("__block").agg(_edge(func, x, place).alias("__edge"))
    # A row a block: a small table, in one order.
    back = func == "bfill"
    filled = lambda e: F.last(e, ignorenulls=True)
    past = Window.orderBy(F.desc("__block") if back else "__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = {"mins": F.min, "maxs": F.max, "prds": F.product, "ffill": filled, "bfill": filled}.get(func, F.sum)("__edge").over(past)
    edges = edges.select("__block", carried.alias("__carried"))
    over = Window.partitionBy("__block").orderBy(F.desc(place) if back else place)
    c = F.col("__carried")
    if func in ("ffill", "bfill"):
        own = (W.fill_backward if back else W.fill_forward)(x, over)
        out = F.when(~F.isnan(own), own).otherwise(F.coalesce(c, own))
    elif func in ("mins", "maxs"):
        least = F.least if func == "mins" else F.greatest
        out = F.coalesce(least(c, quiet(W.running(func, x, over))), F.lit(NAN))
    elif func == "prds":
        out = F.coalesce(c, F.lit(1.0)) * W.running("prds", x, over)
    else:
        out = F.coalesce(c, F.lit(0.0)) + W.running("sums", x, over)
        out = out / (F.col(place) + 1) if func == "avgs" else out
    return by_blocks(blocked, rows, block).join(F.broadcast(edges), "__block").withColumn(name, out).drop("__block", "__carried")


def last_hit(df: DataFrame, hit: str, name: str, place: str = "__i", block: int = BLOCK, rows: int | None = None) -> DataFrame:
    """``df`` with ``name``: the last value of ``hit``, of any type, that isn't null, up to each place."""
    blocked = df.withColumn("__block", F.call_function("div", F.col(place), F.lit(block).cast("long")))
    edges = blocked.groupBy("__block").agg(F.max_by(hit, F.when(F.col(hit).isNotNull(), F.col(place))).alias("__edge"))
    edges = edges.select("__block", F.last("__edge", ignorenulls=True).over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)).alias("__carried"))
    over = Window.partitionBy("__block").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    own = F.last(hit, ignorenulls=True).over(over)
    return by_blocks(blocked, rows, block).join(F.broadcast(edges), "__block").withColumn("__own", own).withColumn(name, F.coalesce("__own", "__carried")).drop("__block", "__carried", "__own")
