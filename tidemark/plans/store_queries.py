"""Named queries through the line protocol and the store, each with the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.scratch import scratch_path
from tidemark.session import Engine
from tidemark.sources import line_protocol

from .views import events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

E = "(select epoch_us(ts) * 1000 as t, event_type, cast(user_id as varchar) as user_id, value, event_id from events)"


def query(name: str, sql: str) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return keep


def lines(spark: SparkSession, sf_dir: str, value: Column | None = None) -> DataFrame:
    """All events as line protocol."""
    parts = [F.lit("events,event_type="), "event_type", F.lit(",user_id="), "user_id", F.lit(" value="), (F.col("value") if value is None else value).cast("string")]
    line = F.concat(*parts, F.lit(",event_id="), F.col("event_id").cast("string"), F.lit("i "), F.col("ts_ns").cast("string"))
    return events(spark, sf_dir).df.select(line.alias("value"))


def stored(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine on a new store that all events were written to."""
    engine = Engine(spark, scratch_path(spark, "store"))
    engine.store.write_lines(lines(spark, sf_dir), now_ns=1)
    return engine


@query("line_protocol_roundtrip", f"select t as ts_ns, event_type, user_id, value, event_id from {E}")
def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = line_protocol.parse(lines(spark, sf_dir), now_ns=1)
    return line_protocol.measurement_rows(parsed, "events", ["event_type", "user_id"], {"value": "double", "event_id": "long"})


@query("line_protocol_errors", f"select event_id, case event_id % 5 when 0 then 'a field without a name or a value' when 1 then 'a time that is no number' when 2 then 'a field''s value has no type' when 3 then 'no fields' end as error from {E}")
def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id") % 5
    tail = F.when(i == 0, " v=1,junk 5").when(i == 1, " v=1 99999999999999999999").when(i == 2, " v=99999999999999999999i").when(i == 3, "").otherwise(" v=1,v=2,a=t 7")
    made = events(spark, sf_dir).df.select("event_id", F.concat(F.lit("m,id="), F.col("event_id").cast("string"), tail).alias("value"))
    return line_protocol.parse(made, now_ns=1, keep=["event_id"]).select("event_id", "error")


@query("store_range", f"select t as time, event_id, round(value, 6) as value from {E} where t >= 1704844800000000000 and t < 1705017600000000001")
def _range(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stored(spark, sf_dir).query("SELECT * FROM events WHERE time >= '2024-01-10' AND time < 1705017600000000001")
    return out.select("time", "event_id", F.round("value", 6).alias("value"))


@query("store_group", f"select t // 3600000000000 * 3600000000000 as time, event_type, round(avg(value), 6) as v from {E} group by 1, 2")
def _group(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stored(spark, sf_dir).query("SELECT mean(value) AS v FROM events GROUP BY time(1h), event_type")
    return out.select("time", "event_type", F.round("v", 6).alias("v"))


@query("store_merge", f"select t as time, event_id, round(case when event_id % 3 = 0 then value + 1 else value end, 6) as value from {E}")
def _merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third point is written again with another value, before and after a compaction."""
    engine = stored(spark, sf_dir)
    for later in (7, 1):
        again = lines(spark, sf_dir, F.col("value") + later)
        engine.store.write_lines(again.filter(F.regexp_extract("value", r"event_id=(\d+)i", 1).cast("long") % 3 == 0), now_ns=1)
        if later == 7:
            engine.store.compact("events")
    return engine.query("SELECT * FROM events").select("time", "event_id", F.round("value", 6).alias("value"))


@query("store_calendar", f"select event_id, cast(hour(make_timestamp(t // 1000)) as bigint) as h, cast(isodow(make_timestamp(t // 1000)) - 1 as bigint) as d from {E}")
def _calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = stored(spark, sf_dir)
    engine.store.compact("events")
    got = engine.eval("([] h: events.ts.hour; d: events.ts.dow)")
    return got.frame().df.select("event_id", got.columns["h"].x.alias("h"), got.columns["d"].x.alias("d"))


@query("series_list", f"select distinct 'events,event_type=' || event_type || ',user_id=' || user_id as series, event_type, user_id from {E}")
def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).store.series("events")
