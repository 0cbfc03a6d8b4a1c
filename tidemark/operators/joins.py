"""As-of join: each left row with the last right row at or before its time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import BLOCK, last_hit, many, numbered


def asof(
    left: DataFrame, right: DataFrame, ts: str, value: str, by: list[str] | None = None, left_order: str | None = None, right_order: str | None = None, name: str = "right", blocks: bool | None = None, block: int = BLOCK,
) -> DataFrame:
    """``left`` with ``name``: the value of the right row with the greatest time not after its own,
    of equal times the last by ``right_order``; null where there is none.

    The sides are put into one table and the last right row is carried along each key's order of
    time: one shuffle by the keys, no join, and no row made twice. Without keys, large tables (or
    ``blocks``) are carried along in blocks of places. A null right value still counts as a match.
    """
    by = by or []
    cols = left.columns
    a = left.select(*(F.col(f"`{c}`").alias(f"l_{i}") for i, c in enumerate(cols)), F.col(ts).alias("t"), F.lit(1).alias("side"), (F.col(left_order) if left_order else F.lit(0)).cast("long").alias("seq"), *(F.col(k).alias(f"k_{k}") for k in by))
    b = right.select(F.col(ts).alias("t"), F.lit(0).alias("side"), (F.col(right_order) if right_order else F.lit(0)).cast("long").alias("seq"), F.struct(F.col(value).alias("v")).alias("hit"), *(F.col(k).alias(f"k_{k}") for k in by))
    both = a.unionByName(b, allowMissingColumns=True)
    order = ["t", "side", "seq"]
    rows = None if by or blocks is False else both.count() if blocks else many(both, block=block)
    if rows is not None:
        placed, rows = numbered(both, order, rows=rows, block=block)
        carried = last_hit(placed, "hit", "found", block=block, rows=rows)
    else:
        over = Window.partitionBy(*[f"k_{k}" for k in by]).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        carried = both.withColumn("found", F.last("hit", ignorenulls=True).over(over))
    return carried.filter("side = 1").select(*(F.col(f"l_{i}").alias(c) for i, c in enumerate(cols)), F.col("found.v").alias(name))
