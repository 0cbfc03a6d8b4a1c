"""Measurements: tags, typed fields and nanosecond times as ordinary DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NS = {"ns": 1, "us": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9, "d": 86400 * 10**9, "w": 7 * 86400 * 10**9}


@dataclass
class Measurement:
    """A DataFrame with ``ts_ns`` (long), a string column a tag and a column a field.

    ``order`` names further columns that make the order of rows total; the series key, the
    measurement's name with its sorted tags, comes before them.
    """

    name: str
    df: DataFrame
    tags: list[str]
    fields: list[str]
    order: list[str] = field(default_factory=list)
    partition: str | None = None  # column of the hour, where the data are laid out by it

    def __post_init__(self):
        self.tags, self.fields = sorted(self.tags), sorted(self.fields)

    def kind(self, name: str) -> str:
        return dict(self.df.dtypes)[name]

    def series_key(self) -> Column:
        """Missing tags are left out of the key."""
        parts = [F.concat(F.lit(f"{t}="), F.col(f"`{t}`").cast("string")) for t in self.tags]
        return F.concat_ws(",", F.lit(self.name), *parts)

    def ordering(self) -> list[Column]:
        return [F.col("ts_ns"), self.series_key(), *(F.col(f"`{c}`") for c in self.order)]

    def between(self, low: int | None, high: int | None) -> DataFrame:
        """Rows of a closed time range; the range also bounds the hour that data are laid out by,
        so that whole folders are passed over."""
        df = self.df
        for bound, op in ((low, "ge"), (high, "le")):
            if bound is None:
                continue
            limit = F.lit(max(min(bound, 2**63 - 1), -(2**63))).cast("long")
            df = df.filter(F.col("ts_ns") >= limit if op == "ge" else F.col("ts_ns") <= limit)
            if self.partition:
                hour = F.lit(hour_name(max(min(bound, 2**63 - 1), -(2**63))))
                df = df.filter(F.col(self.partition) >= hour if op == "ge" else F.col(self.partition) <= hour)
        return df


def hour_name(ts_ns: int) -> str:
    """The folder of a time, as ``calendar.hour_name`` names it."""
    return (datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=ts_ns // 10**9)).strftime("%Y-%m-%dT%H")
