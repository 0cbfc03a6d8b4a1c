"""Exponential moving averages: a recurrence, so a loop over each series in order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.ship import ship

from .blocks import BLOCK, by_blocks


def smooth(values, alpha: float, start: float | None = None) -> list[float]:
    """e0 = v0 (or from ``start`` on), e = alpha v + (1 - alpha) e; NaN spreads."""
    out, e = [], start
    for v in values:
        e = float(v) if e is None else alpha * float(v) + (1 - alpha) * e
        out.append(e)
    return out


def ema(df: DataFrame, alpha: float, value: str, order: list[str], by: list[str] | None = None, name: str = "ema", later: float | None = None, dealt: DataFrame | None = None) -> DataFrame:
    """``df`` with ``name``. Rows are dealt by ``by`` and sorted within partitions; the loop streams
    over batches and holds one number a series, so a long series needs no memory. ``later`` is what
    series but those of key 0 start from; ``dealt``, the same rows where they are dealt by ``by`` already."""
    by = by or []
    ship(df.sparkSession)
    if dealt is None:
        dealt = df.repartition(*by) if by else df.repartition(1)
    ordered = dealt.sortWithinPartitions(*by, *order)
    schema = T.StructType([*(f for f in df.schema if f.name != name), T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, None
        for b in batches:
            values = [float("nan") if v is None else v for v in b.column(b.schema.get_field_index(value)).to_pylist()]
            codes = list(zip(*(b.column(b.schema.get_field_index(k)).to_pylist() for k in by), strict=True)) if by else [()] * len(values)
            out, start = [0.0] * len(values), 0
            while start < len(values):
                end = start
                while end < len(values) and codes[end] == codes[start]:
                    end += 1
                got = smooth(values[start:end], alpha, last if key == codes[start] else None if codes[start] == (0,) else later)
                out[start:end] = got
                key, last, start = codes[start], got[-1], end
            kept = [b.column(i) for i, n in enumerate(b.schema.names) if n != name]
            # Arrow keeps NaN apart from null, which pandas doesn't.
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out, pa.float64())], names=schema.names)

    return ordered.mapInArrow(run, schema)


def ema_blocks(df: DataFrame, alpha: float, value: str, name: str = "ema", place: str = "__i", block: int = BLOCK, rows: int | None = None) -> DataFrame:
    """The same of one long series whose rows have their places: each block smooths from 0, and what
    the blocks before come to fades by (1 - alpha) a row. A row a block is carried along in one task."""
    blocked = df.withColumn("__block", F.call_function("div", F.col(place), F.lit(block).cast("long")))
    local = ema(blocked, alpha, value, [place], ["__block"], "__local", later=0.0, dealt=None if rows is None else by_blocks(blocked, rows, block))
    edges = local.groupBy("__block").agg(F.max_by("__local", place).alias("end"), F.count("*").alias("n"))

    def carry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = 0.0
        for b in batches:
            out = []
            for end, n in zip(b["end"], b["n"], strict=True):
                out.append(e)
                e = end + (1 - alpha) ** n * e
            yield pd.DataFrame({"__block": b["__block"], "__carried": out})

    carried = edges.repartition(1).sortWithinPartitions("__block").mapInPandas(carry, "__block long, __carried double")
    faded = F.pow(F.lit(1 - alpha), F.col(place) % block + 1) * F.col("__carried")
    out = F.when(F.col("__block") == 0, F.col("__local")).otherwise(F.col("__local") + faded)
    return local.join(F.broadcast(carried), "__block").withColumn(name, out).drop("__block", "__local", "__carried")
