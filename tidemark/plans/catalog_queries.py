"""Named queries over the driver's tables, each with the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import windows as W
from tidemark.operators.aggregates import correlation
from tidemark.operators.ema import ema
from tidemark.operators.joins import asof

from .compiler import compile_select
from .dialect import parse
from .views import VIEWS, events, orders

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

T = "epoch_us(ts) * 1000"
E = f"(select {T} as t, event_type, cast(user_id as varchar) as user_id, value, event_id from events)"
H = 3_600_000_000_000


def dialect(name: str, text: str, names: list[str], sql: str) -> None:
    """A dialect query; results are renamed to ``names`` and doubles rounded to 6 places."""
    m = parse(text).measurement

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = compile_select(parse(text), VIEWS[m](spark, sf_dir)).toDF(*names)
        return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))

    QUERIES[name], ORACLE_SQL[name] = run, sql


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["group_time"](spark, sf_dir)


# Scans and filters.
ROWS = f"select t as time, value from {E} where "
for name, where, sql in [
    ("filter_eq", "event_type = 'purchase'", "event_type = 'purchase'"),
    ("filter_neq", "event_type != 'purchase'", "event_type <> 'purchase'"),
    ("filter_regex", "event_type =~ /^(cl|vi)/", "regexp_matches(event_type, '^(cl|vi)')"),
    ("filter_notregex", "event_type !~ /e/", "not regexp_matches(event_type, 'e')"),
    ("filter_in", "event_type IN ('view', 'click')", "event_type in ('view', 'click')"),
    ("filter_and_or", "event_type = 'view' AND (user_id = '7' OR user_id = '8') OR event_type = 'error'", "event_type = 'view' and (user_id = '7' or user_id = '8') or event_type = 'error'"),
    ("filter_tag_order", "event_type >= 'purchase'", "event_type >= 'purchase'"),
    ("filter_field", "value > 50 AND value <= 60.5", "value > 50 and value <= 60.5"),
    ("time_between", "time BETWEEN '2024-01-05' AND '2024-01-06T12:00:00Z'", "t between 1704412800000000000 and 1704542400000000000"),
    ("time_cmp", "time >= '2024-01-10' AND time < '2024-01-10' + 2d AND event_type = 'view'", "t >= 1704844800000000000 and t < 1705017600000000000 and event_type = 'view'"),
    ("time_or", "time < '2024-01-03' OR event_type = 'signup'", "t < 1704240000000000000 or event_type = 'signup'"),
]:
    dialect(name, f"SELECT value FROM events WHERE {where}", ["time", "value"], f"select time, round(value, 6) as value from ({ROWS}{sql})")
dialect("scan_project", "SELECT l_quantity, l_tax FROM lineitem", ["time", "q", "x"], "select epoch_us(l_shipdate) * 1000 as time, round(l_quantity, 6) as q, round(l_tax, 6) as x from lineitem")
dialect("scan_wildcard", "SELECT * FROM lineitem WHERE l_returnflag = 'R'", ["time", "a", "b", "c", "d"], "select epoch_us(l_shipdate) * 1000 as time, round(l_discount, 6) as a, round(l_extendedprice, 6) as b, round(l_quantity, 6) as c, round(l_tax, 6) as d from lineitem where l_returnflag = 'R'")
dialect("order_desc_limit_offset", "SELECT value FROM events WHERE event_type = 'view' ORDER BY time DESC LIMIT 20 OFFSET 5", ["time", "value"], f"select time, round(value, 6) as value from ({ROWS}event_type = 'view') order by time desc limit 20 offset 5")

# Aggregates, alone and by time and tags.
RANK95 = "list_sort(list(value))[cast(round(0.95 * (count(value) - 1)) as int) + 1]"
AGG = {
    "count": "cast(count(value) as double)", "sum": "sum(value)", "mean": "avg(value)", "min": "min(value)", "max": "max(value)", "first": "arg_min(value, (t, event_id))",
    "last": "arg_max(value, (t, event_id))", "stddev": "stddev_pop(value)", "percentile": RANK95,
}
for func, sql in AGG.items():
    of = "value, 95" if func == "percentile" else "value"
    dialect(f"agg_{func}", f"SELECT {func}({of}) FROM events", ["time", "v"], f"select cast(null as bigint) as time, round({sql}, 6) as v from {E}")
dialect("agg_count_distinct", "SELECT count(distinct user_id), count(value) FROM events GROUP BY event_type", ["time", "event_type", "u", "n"], f"select cast(null as bigint) as time, event_type, cast(count(distinct user_id) as double) as u, cast(count(value) as double) as n from {E} group by event_type")
dialect("group_time", "SELECT mean(value) FROM events GROUP BY time(1h)", ["time", "v"], f"select t // {H} * {H} as time, round(avg(value), 6) as v from {E} group by 1")
dialect("group_tag", "SELECT sum(value), percentile(value, 95) FROM events GROUP BY event_type", ["time", "event_type", "s", "p"], f"select cast(null as bigint) as time, event_type, round(sum(value), 6) as s, round({RANK95}, 6) as p from {E} group by event_type")
dialect("group_time_tag", "SELECT count(value), max(value), stddev(value) FROM events GROUP BY time(6h), event_type", ["time", "event_type", "n", "m", "d"], f"select t // {6 * H} * {6 * H} as time, event_type, cast(count(value) as double) as n, round(max(value), 6) as m, round(stddev_pop(value), 6) as d from {E} group by 1, 2")
dialect("group_where", "SELECT mean(value) FROM events WHERE event_type = 'purchase' AND value > 5 GROUP BY time(1d), user_id", ["time", "u", "v"], f"select t // {24 * H} * {24 * H} as time, user_id as u, round(avg(value), 6) as v from {E} where event_type = 'purchase' and value > 5 group by 1, 2")
dialect("group_lineitem", "SELECT sum(l_quantity), mean(l_extendedprice), count(l_tax) FROM lineitem GROUP BY time(1d), l_returnflag, l_linestatus", ["time", "f", "s", "q", "p", "n"], f"select epoch_us(l_shipdate) * 1000 // {24 * H} * {24 * H} as time, l_returnflag as f, l_linestatus as s, round(sum(l_quantity), 6) as q, round(avg(l_extendedprice), 6) as p, cast(count(l_tax) as double) as n from lineitem group by 1, 2, 3")
dialect("ohlc_bars", "SELECT first(value) AS o, max(value) AS h, min(value) AS l, last(value) AS c, sum(value) AS v FROM events GROUP BY time(1d)", ["time", "o", "h", "l", "c", "v"], f"select t // {24 * H} * {24 * H} as time, round(arg_min(value, (t, event_id)), 6) as o, round(max(value), 6) as h, round(min(value), 6) as l, round(arg_max(value, (t, event_id)), 6) as c, round(sum(value), 6) as v from {E} group by 1")
dialect("group_page", "SELECT mean(value) FROM events GROUP BY time(1h) ORDER BY time DESC LIMIT 10 OFFSET 3", ["time", "v"], f"select t // {H} * {H} as time, round(avg(value), 6) as v from {E} group by 1 order by 1 desc limit 10 offset 3")

# Gap filling, by ten minutes so that there are gaps.
M = 600_000_000_000
GAPS = f"""with g as (select t // {M} * {M} as time, event_type, sum(value) as v, cast(count(value) as double) as n from {E} group by 1, 2),
 r as (select min(time) as lo, max(time) as hi from g), k as (select distinct event_type from g),
 s as (select k.event_type, unnest(range(r.lo, r.hi + 1, {M})) as time from k, r),
 j as (select s.time, s.event_type, g.v, coalesce(g.n, 0.0) as n, g.n is null as new from s left join g on g.time = s.time and g.event_type = s.event_type),
 w as (select *, last_value(case when v is not null then time end ignore nulls) over p as t0, last_value(v ignore nulls) over p as v0, first_value(case when v is not null then time end ignore nulls) over q as t1, first_value(v ignore nulls) over q as v1
 from j window p as (partition by event_type order by time rows between unbounded preceding and 1 preceding), q as (partition by event_type order by time rows between 1 following and unbounded following))
 select time, event_type, round(case when not new then v else {{fill}} end, 6) as v, n from w"""
for kind, sql in {"null": "null", "previous": "v0", "linear": "v0 + (v1 - v0) * cast(time - t0 as double) / cast(t1 - t0 as double)", "0": "0.0"}.items():
    dialect(f"fill_{'value' if kind == '0' else kind}", f"SELECT sum(value), count(value) FROM events GROUP BY time(10m), event_type FILL({kind})", ["time", "event_type", "v", "n"], GAPS.format(fill=sql))
dialect("fill_none", "SELECT sum(value), count(value) FROM events GROUP BY time(10m), event_type FILL(none)", ["time", "event_type", "v", "n"], f"select t // {M} * {M} as time, event_type, round(sum(value), 6) as v, cast(count(value) as double) as n from {E} group by 1, 2")


# Operators by key, as a table of many series has them.
def frame(name: str, sql: str) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return keep


@frame("keyed_prds", "select l_orderkey, l_linenumber, round(product(1 + l_discount) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice rows unbounded preceding), 6) as v from lineitem")
def _prds(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    over = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return t.select("l_orderkey", "l_linenumber", F.round(W.running("prds", 1 + F.col("l_discount"), over), 6).alias("v"))


@frame("keyed_mavg", f"select event_id, round(avg(value) over (partition by user_id order by t, event_id rows between 9 preceding and current row) + 1e-9, 6) as v from {E}")
def _mavg(spark: SparkSession, sf_dir: str) -> DataFrame:
    over = Window.partitionBy("user_id").orderBy("ts_ns", "event_id")
    return events(spark, sf_dir).df.select("event_id", F.round(W.moving("mavg", 10, F.col("value"), over) + 1e-9, 6).alias("v"))


@frame("keyed_ema", f"""with recursive o as (select event_type, event_id, value, row_number() over (partition by event_type order by t, event_id) as n from {E}),
 e as (select event_type, event_id, n, value as v from o where n = 1 union all select o.event_type, o.event_id, o.n, 0.1 * o.value + 0.9 * e.v from e join o on o.event_type = e.event_type and o.n = e.n + 1)
 select event_id, round(v, 6) as v from e""")
def _ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ema(events(spark, sf_dir).df.select("event_type", "ts_ns", "event_id", "value"), 0.1, "value", ["ts_ns", "event_id"], ["event_type"])
    return out.select("event_id", F.round("ema", 6).alias("v"))


@frame("keyed_asof", f"select l.event_id, round(r.value, 6) as v from (select * from {E} where event_type = 'purchase') l asof left join (select * from {E} where event_type = 'view') r on l.user_id = r.user_id and l.t >= r.t")
def _asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).df
    left, right = (e.filter(F.col("event_type") == k).select("event_id", "ts_ns", "user_id", "value") for k in ("purchase", "view"))
    return asof(left, right, "ts_ns", "value", ["user_id"], "event_id", "event_id", "v").select("event_id", F.round("v", 6).alias("v"))


@frame("topk_by_tag", f"select user_id, round(avg(value), 6) as v from {E} group by 1 order by avg(value) desc, user_id limit 5")
def _topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = compile_select(parse("SELECT mean(value) AS m FROM events GROUP BY user_id"), events(spark, sf_dir))
    return means.orderBy(F.desc("m"), "user_id").limit(5).select("user_id", F.round("m", 6).alias("v"))


@frame("order_correlation", "select o_orderpriority, round(corr(epoch_us(o_orderdate)::double, o_totalprice), 6) as v from orders group by 1")
def _cor(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = orders(spark, sf_dir).df
    return o.groupBy("o_orderpriority").agg(F.round(correlation((F.col("ts_ns") / 1000).cast("double"), F.col("o_totalprice")), 6).alias("v"))


from . import language_queries, store_queries  # noqa: E402

for more in (language_queries, store_queries):
    QUERIES |= more.QUERIES
    ORACLE_SQL |= more.ORACLE_SQL
