"""Aggregates of the dialect and the array language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import fdiv, quiet


def _summed(df: DataFrame, keys: list[str], value: str) -> tuple[DataFrame, list[Column]]:
    """(keys, __x, __c, __upto, __n): each group's different values in order, how often each comes, how
    many values there are up to it and in all.

    Equal values are counted first, with partial counts, so that what meets by group is a row for
    each different value; these are sorted and summed along, and may spill. No group is held as one
    row."""
    k = [F.col(f"`{c}`") for c in keys]
    counts = df.filter(F.col(f"`{value}`").isNotNull()).groupBy(*k, F.col(f"`{value}`").alias("__x")).agg(F.count("*").alias("__c"))
    by = Window.partitionBy(*k)
    upto = F.sum("__c").over(by.orderBy("__x").rowsBetween(Window.unboundedPreceding, 0))
    return counts.select(*k, "__x", "__c", upto.alias("__upto"), F.sum("__c").over(by).alias("__n")), k


def _at(rank: Column) -> Column:
    return F.max(F.when((F.col("__upto") > rank) & (F.col("__upto") - F.col("__c") <= rank), F.col("__x")))


def median(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """(keys, name): the middle of each group's values, of an even number the mean of the two."""
    summed, k = _summed(df, keys, value)
    middle = lambda n: F.call_function("div", n, F.lit(2).cast("long"))
    return summed.groupBy(*k).agg(((_at(middle(F.col("__n") - 1)) + _at(middle(F.col("__n")))) / 2).alias(name))


def nearest_rank(df: DataFrame, keys: list[str], value: str, ranks: dict[str, float]) -> DataFrame:
    """For each group of ``keys`` the values at ranks round(p / 100 (n - 1)) of its sorted values,
    halves away from zero, by the names in ``ranks``. Nulls aren't values; keys aren't null."""
    summed, k = _summed(df, keys, value)
    rank = lambda p: F.round(F.lit(p / 100.0) * (F.col("__n") - 1))
    return summed.groupBy(*k).agg(*(_at(rank(p)).alias(n) for n, p in ranks.items()))


def aggregate(func: str, x: Column, order: Column) -> Column:
    """``x`` is a double, null where missing; ``order`` decides first and last."""
    if func == "count":
        return F.count(x).cast("double")
    if func == "sum":
        return F.sum(x)
    if func in ("mean", "avg"):
        return F.avg(x)
    if func == "min":
        return F.min(quiet(x))
    if func == "max":
        return F.max(quiet(x))
    if func == "first":
        return F.min_by(x, F.when(x.isNotNull(), order))
    if func == "last":
        return F.max_by(x, F.when(x.isNotNull(), order))
    if func in ("stddev", "dev"):
        return F.stddev_pop(x)
    if func == "var":
        return F.var_pop(x)
    raise ValueError(f"unknown aggregate {func!r}")


def weighted_mean(w: Column, v: Column) -> Column:
    return fdiv(F.sum(w * v), F.sum(w))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's; NaN where a side doesn't vary."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return fdiv(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
