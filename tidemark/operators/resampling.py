"""Vectors by buckets of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import bucket


def resample(df: DataFrame, width: int, ts: str, agg: Column, name: str = "value") -> DataFrame:
    """(ts, value): ``agg`` of the rows of each bucket, buckets in order."""
    return df.groupBy(bucket(F.col(ts), width).alias("ts")).agg(agg.alias(name)).orderBy("ts")
