"""Parts of nanosecond times in UTC, by integer arithmetic: the session's time zone plays no part."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECOND, HOUR, DAY = 10**9, 3600 * 10**9, 86400 * 10**9
_DATE = {"year": F.year, "month": F.month, "day": F.day, "week": F.weekofyear, "dow": F.weekday}
_CLOCK = {"hour": (HOUR, 24), "minute": (60 * SECOND, 60), "second": (SECOND, 60)}
PARTS = (*_DATE, *_CLOCK)


def whole(ns: Column, unit: int) -> Column:
    """How many units there are, rounded down, before 1970 as well."""
    n = F.lit(unit).cast("long")
    return F.call_function("div", ns, n) - F.when(ns % n < 0, F.lit(1)).otherwise(F.lit(0))


def date(ns: Column) -> Column:
    return F.date_from_unix_date(whole(ns, DAY).cast("int"))


def part(ns: Column, name: str) -> Column:
    """year month day hour minute second week (ISO) dow (Monday 0), as a long."""
    if name in _DATE:
        return _DATE[name](date(ns)).cast("long")
    unit, of = _CLOCK[name]
    return F.pmod(whole(ns, unit), F.lit(of)).cast("long")


def hour_name(ns: Column) -> Column:
    """``2024-01-31T05``."""
    return F.concat(date(ns).cast("string"), F.lit("T"), F.lpad(part(ns, "hour").cast("string"), 2, "0"))


def nanoseconds(column: Column, kind: T.DataType) -> Column:
    """Of a timestamp column; one without a zone is taken as UTC."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column) * 1000
    seconds = F.unix_date(column.cast("date")).cast("long") * 86400 + F.hour(column) * 3600 + F.minute(column) * 60
    return seconds * SECOND + (F.call_function("date_part", F.lit("SECONDS"), column) * 1_000_000).cast("long") * 1000
