"""Gap filling of bucketed results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Buckets that one array holds.
MOST = 10_000


def _buckets(one: DataFrame, tags: list[str], width: int) -> DataFrame:
    """The tags and a ``time`` for each bucket from lo to hi, in three steps of MOST at most each, so
    that no row holds all buckets of a group."""
    keys = [F.col(f"`{t}`") for t in tags]
    out = one.select(*keys, "lo", F.call_function("div", F.col("hi") - F.col("lo"), F.lit(width).cast("long")).alias("__last")).withColumn("__n", F.lit(0).cast("long"))
    for span in (MOST * MOST, MOST, 1):
        last = F.call_function("div", F.col("__last"), F.lit(span).cast("long"))
        first = F.col("__n") * (MOST if span < MOST * MOST else 1)
        upto = last if span == MOST * MOST else F.least(last, first + (MOST - 1))
        out = out.select(*keys, "lo", "__last", F.explode(F.sequence(first, upto)).alias("__n"))
    return out.select(*keys, (F.col("lo") + F.col("__n") * F.lit(width).cast("long")).alias("time"))


def fill(df: DataFrame, width: int, tags: list[str], values: dict[str, bool], policy: str | float) -> DataFrame:
    """Add the missing buckets between the first and the last of all groups to every group.

    ``df`` has ``time`` and the tags; ``values`` names its value columns, true for counts, which
    are 0 in a new bucket. Other values of new buckets are null, the one before, on the line between
    the neighbours, or ``policy`` itself, a number. One group's buckets are a window, so there is
    one shuffle by the tags; the range of buckets is one row.
    """
    if policy == "none" or width <= 0:
        return df
    edges = df.agg(F.min("time").alias("lo"), F.max("time").alias("hi")).filter("lo is not null")
    groups = df.select(*tags).distinct() if tags else None
    # One row of edges meets each group: the groups' own number of rows, not a cross product.
    one = groups.crossJoin(F.broadcast(edges)) if groups is not None else edges
    spine = _buckets(one, tags, width)
    left, right = spine.alias("s"), df.withColumn("__there", F.lit(True)).alias("d")
    on = [F.col("s.time") == F.col("d.time"), *(F.col(f"s.`{t}`").eqNullSafe(F.col(f"d.`{t}`")) for t in tags)]
    joined = left.join(right, on, "left").select("s.time", *(F.col(f"s.`{t}`") for t in tags), *(F.col(f"d.`{v}`") for v in values), F.col("d.__there").isNull().alias("__new"))
    over = Window.partitionBy(*tags).orderBy("time")
    past = over.rowsBetween(Window.unboundedPreceding, -1)
    # The rows ahead, nearest last: a frame that ends with the last row is read afresh for every row.
    ahead = Window.partitionBy(*tags).orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, -1)
    out = []
    for v, is_count in values.items():
        x, new = F.col(f"`{v}`"), F.col("__new")
        if is_count:
            made = F.when(new, F.lit(0.0)).otherwise(x)
        elif policy == "previous":
            made = F.when(new, F.last(x, ignorenulls=True).over(past)).otherwise(x)
        elif policy == "linear":
            at = F.when(x.isNotNull(), F.struct(F.col("time").alias("t"), x.alias("x")))
            a, b = F.last(at, ignorenulls=True).over(past), F.last(at, ignorenulls=True).over(ahead)
            line = a["x"] + (b["x"] - a["x"]) * (F.col("time") - a["t"]).cast("double") / F.when(b["t"] != a["t"], (b["t"] - a["t"]).cast("double"))
            made = F.when(new, line).otherwise(x)
        elif policy == "null":
            made = x
        else:
            made = F.when(new, F.lit(float(policy))).otherwise(x)
        out.append(made.alias(v))
    return joined.select("time", *(F.col(f"`{t}`") for t in tags), *out)
