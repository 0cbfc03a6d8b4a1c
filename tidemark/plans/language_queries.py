"""Named queries in the array language, end to end, each with the SQL it must equal.

Vectors are all events in order of time. A result keeps event_id, the rows' own name, where its rows
are events, and else the place in the result's order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.lang.evaluate import Session
from tidemark.lang.values import Col, Groups

from .views import VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

H = 3_600_000_000_000
E = "(select epoch_us(ts) * 1000 as t, event_type, cast(user_id as varchar) as user_id, value, event_id, 'events,event_type=' || event_type || ',user_id=' || user_id as series from events)"
O = "order by t, series, event_id"


def run(spark: SparkSession, sf_dir: str, text: str) -> object:
    found = {n: v(spark, sf_dir) for n, v in VIEWS.items()}
    return Session(spark, found.get).run(text)


def tidy(x: Column, kind: str, finite: bool = True) -> Column:
    """Doubles to 6 places, NaN and infinities as null if results are to be ``finite``. The 1e-9
    keeps exact halves, which the two engines round by different rules, from coming up."""
    if kind != "float":
        return x
    rounded = F.round(x + 1e-9, 6)
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), rounded) if finite else rounded


def vector(name: str, text: str, sql: str, key: str = "event_id", finite: bool = True) -> None:
    """A vector or table over events, by event; ``sql`` names its columns. Where it gives NaN and
    infinities, ``finite`` is false."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = run(spark, sf_dir, text)
        columns = {"v": got} if isinstance(got, Col) else got.columns
        first = next(iter(columns.values()))
        return first.frame.df.select(key, *(tidy(c.x, c.kind, finite).alias(n) for n, c in columns.items()))

    QUERIES[name], ORACLE_SQL[name] = query, f"select {key}, {sql} from {E} window w as ({O}), up as ({O} rows unbounded preceding), ten as ({O} rows between 9 preceding and current row), ahead as ({O} rows between current row and unbounded following)"


def placed(name: str, text: str, sql: str) -> None:
    """A vector whose order is the result: each value with its place."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = run(spark, sf_dir, text)
        at = got.frame.places()
        return got.frame.df.select(F.col(at).cast("long").alias("i"), tidy(got.x, got.kind).alias("v"))

    QUERIES[name], ORACLE_SQL[name] = query, sql


def scalar(name: str, text: str, sql: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = run(spark, sf_dir, text)
        return spark.range(1).select(F.round(F.lit(float(got)), 6).alias("v"))

    QUERIES[name], ORACLE_SQL[name] = query, f"select round(cast({sql} as double), 6) as v from {E}"


def table(name: str, text: str, columns: list[str], sql: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = run(spark, sf_dir, text)
        return got.frame().df.select(*(tidy(got.columns[n].x, got.columns[n].kind).alias(c) for n, c in zip(got.names, columns, strict=True)))

    QUERIES[name], ORACLE_SQL[name] = query, sql


def r(sql: str) -> str:
    return f"round({sql} + 1e-9, 6)"


# Moving and running windows.
for func, sql in {"mavg": "avg(value)", "msum": "sum(value)", "mmin": "min(value)", "mmax": "max(value)", "mdev": "stddev_pop(value)", "mcount": "count(value)"}.items():
    vector(f"arr_{func}", f"{func}[10; events.value]", f"{r(f'{sql} over ten')} as v")
vector("arr_wma", "wma[10; events.value]", f"{r('list_sum(list_transform(list(value) over ten, lambda x, i: x * i)) / (count(*) over ten * (count(*) over ten + 1) / 2)')} as v")
for func, sql in {"sums": "sum(value)", "avgs": "avg(value)", "mins": "min(value)", "maxs": "max(value)"}.items():
    vector(f"arr_{func}", f"{func} events.value", f"{r(f'{sql} over up')} as v")
vector("arr_prds", "prds 1 + events.value % 1000000", f"{r('exp(sum(ln(1 + value / 1000000)) over up)')} as v")
vector("arr_deltas", "deltas events.value", f"{r('value - coalesce(lag(value) over w, 0)')} as v")
vector("arr_ratios", "ratios events.value", f"case when lag(value) over w <> 0 then {r('value / lag(value) over w')} end as v")
vector("arr_prev", "prev events.value", f"{r('lag(value) over w')} as v")
vector("arr_next", "next events.value", f"{r('lead(value) over w')} as v")
GAPPY = "?[0 = events.event_id mod 3; 0n; events.value]"
vector("arr_choose", GAPPY, f"case when event_id % 3 <> 0 then {r('value')} end as v")
vector("arr_ffill", f"g: {GAPPY}; ffill g", f"{r('last_value(case when event_id % 3 <> 0 then value end ignore nulls) over up')} as v")
vector("arr_bfill", f"g: {GAPPY}; bfill g", f"{r('first_value(case when event_id % 3 <> 0 then value end ignore nulls) over ahead')} as v")
vector("arr_scan", "{x + y}\\events.value", f"{r('sum(value) over up')} as v")
vector("arr_scan_max", "{$[x > y; x; y]}\\events.value", f"{r('max(value) over up')} as v")
vector("arr_each_prior", "{x * y}':events.value", f"{r('case when row_number() over w = 1 then value else value * lag(value) over w end')} as v")
vector("arr_each", "{(x * x) + 1}'events.value", f"{r('value * value + 1')} as v")
vector("rate_of_change", "(deltas events.value) % (deltas events.ts) % 1000000000", f"{r('(value - coalesce(lag(value) over w, 0)) / ((t::double - coalesce(lag(t::double) over w, 0)) / 1e9)')} as v", finite=False)
QUERIES["arr_ema"] = lambda spark, sf_dir: (lambda g: g.frame.df.select("event_id", tidy(g.x, "float").alias("v")))(run(spark, sf_dir, "ema[0.5; events.value]"))
ORACLE_SQL["arr_ema"] = f"""with o as (select event_id, value, row_number() over ({O}) as n from {E})
 select a.event_id, {r("sum(b.value * pow(0.5, a.n - b.n + case when b.n = 1 then 0 else 1 end))")} as v from o a join o b on b.n between a.n - 60 and a.n group by 1"""

# Reductions.
for name, text, sql in [
    ("sum", "sum events.value", "sum(value)"), ("avg", "avg events.value", "avg(value)"), ("med", "med events.value", "median(value)"), ("dev", "dev events.value", "stddev_pop(value)"),
    ("var", "var events.value", "var_pop(value)"), ("wavg", "wavg[events.event_id; events.value]", "sum(event_id * value) / sum(event_id)"), ("cor", "cor[events.event_id; events.value]", "corr(event_id, value)"),
    ("pct", "pct[90; events.value]", "list_sort(list(value))[cast(round(0.9 * (count(value) - 1)) as int) + 1]"), ("count", "count events.value", "count(*)"),
    ("first", "first events.value", "arg_min(value, (t, series, event_id))"), ("last", "last events.value", "arg_max(value, (t, series, event_id))"), ("over", "{x + y}/events.value", "sum(value)"),
    ("over_step", "{$[x > y; x; y]}/events.value", "max(value)"), ("min", "min events.value", "min(value)"), ("max", "max events.value", "max(value)"),
    ("cond", "$[(avg events.value) > 1000; 1; (avg events.value) > 0; 2; 3]", "case when avg(value) > 1000 then 1 when avg(value) > 0 then 2 else 3 end"), ("pipe", "events.value |> abs |> sum", "sum(abs(value))"),
    ("block", "a: max events.value; b: min events.value; a - b", "max(value) - min(value)"), ("find_none", "events.event_type ? `none", "-1"), ("in_one", "`error in events.event_type", "max((event_type = 'error')::int)"),
]:
    scalar(f"arr_{name}", text, sql)
scalar("spread", "spread: {(max x) - min x}; spread[events.value]", "max(value) - min(value)")

# Elementwise operators.
vector("arr_add", "([] a: events.value + events.event_id; s: events.value - events.event_id mod 7; m: events.value * 2.5)", f"{r('value + event_id')} as a, {r('value - event_id % 7')} as s, {r('value * 2.5')} as m")
vector("arr_div", "([] d: events.value % events.event_id; z: 0w = events.value % 0.0)", f"case when event_id <> 0 then {r('value / event_id')} end as d, value > 0 as z")
vector("arr_mod", "([] i: events.event_id mod 7; n: (0 - events.event_id) mod 7; z: events.event_id mod 0; f: events.value mod 3.0)", f"event_id % 7 as i, -event_id % 7 as n, 0::bigint as z, {r('value % 3.0')} as f")
vector("arr_pow", "([] p: (events.value % 100) ^ 2; r: sqrt events.value; l: log events.value + 1; c: ceil events.value; f: floor events.value; g: signum events.value - 50)", f"{r('pow(value / 100, 2)')} as p, {r('sqrt(value)')} as r, {r('ln(value + 1)')} as l, {r('ceil(value)')} as c, {r('floor(value)')} as f, {r('case when value - 50 >= 0 then 1.0 else -1.0 end::double')} as g")
vector("arr_math", "([] a: abs 50 - events.value; e: exp events.value % 100; s: sin events.value; t: log10 events.value + 1; n: neg events.value; i: reciprocal events.value + 1; o: round events.value % 3)", f"{r('abs(50 - value)')} as a, {r('exp(value / 100)')} as e, {r('sin(value)')} as s, {r('log10(value + 1)')} as t, {r('-value')} as n, {r('1 / (value + 1)')} as i, {r('round(value / 3)')} as o")
vector("arr_cmp", "([] lt: events.value < 50; ge: events.value >= 50; eq: events.value = 50; ne: events.value <> 50; nan: 0n <= events.value; s: events.event_type = `view)", "value < 50 as lt, value >= 50 as ge, value = 50 as eq, value <> 50 as ne, false as nan, event_type = 'view' as s")
vector("arr_logic", "([] a: (events.value > 50) & 0 = events.event_id mod 2; o: (events.value > 90) | 0 = events.event_id mod 5; n: not events.value > 50)", "value > 50 and event_id % 2 = 0 as a, value > 90 or event_id % 5 = 0 as o, not value > 50 as n")
vector("arr_like", '([] k: events.event_type like "*i*"; m: events.event_type like "v?ew")', "event_type like '%i%' as k, event_type like 'v_ew' as m")
vector("arr_text", "([] u: upper events.event_type; l: lower upper events.event_type; t: trim events.event_type)", "upper(event_type) as u, lower(event_type) as l, event_type as t")
vector("arr_in", "([] v: events.event_type in `view`error; n: events.event_id in events.event_id @ `event_type = `signup)", "event_type in ('view', 'error') as v, event_id in (select event_id from events where event_type = 'signup') as n")
vector("arr_xbar", "xbar[5m; events.ts]", "t // 300000000000 * 300000000000 as v")
vector("arr_time_math", "([] a: events.ts + 1h; b: events.ts - 2024.01.01D00:00)", f"t + {H} as a, t - 1704067200000000000 as b")
for part, sql in {"year": "year(ts)", "month": "month(ts)", "day": "day(ts)", "hour": "hour(ts)", "minute": "minute(ts)", "second": "second(ts)", "week": "week(ts)", "dow": "isodow(ts) - 1"}.items():
    vector(f"arr_extract_{part}", f"events.ts.{part}", f"cast({sql.replace('ts', 'make_timestamp(t // 1000)')} as bigint) as v")

# Structure: the result's own order.
N = "(select *, row_number() over (order by t, series, event_id) - 1 as n from " + E + ")"
placed("arr_distinct", "distinct events.event_type", f"select row_number() over (order by p) - 1 as i, event_type as v from (select event_type, min(n) as p from {N} group by 1)")
placed("arr_asc", "asc events.value", f"select row_number() over (order by value, n) - 1 as i, {r('value')} as v from {N}")
placed("arr_desc", "desc events.value", f"select row_number() over (order by value desc, n) - 1 as i, {r('value')} as v from {N}")
placed("arr_rev", "rev events.value", f"select row_number() over (order by n desc) - 1 as i, {r('value')} as v from {N}")
placed("arr_take", "100 # events.value", f"select n as i, {r('value')} as v from {N} where n < 100")
placed("arr_drop", "900 _ events.value", f"select n - 900 as i, {r('value')} as v from {N} where n >= 900")
placed("arr_where", "where events.value > 90", f"select row_number() over (order by n) - 1 as i, n as v from {N} where value > 90")
placed("arr_mask", "events.value[events.value > 90]", f"select row_number() over (order by n) - 1 as i, {r('value')} as v from {N} where value > 90")
placed("arr_index", "events.value[where events.event_type = `error]", f"select row_number() over (order by n) - 1 as i, {r('value')} as v from {N} where event_type = 'error'")
placed("arr_zip", "events.value + rev events.value", f"select a.n as i, {r('a.value + b.value')} as v from {N} a join {N} b on b.n = (select count(*) from events) - 1 - a.n")
scalar("arr_find", "events.event_type ? `error", f"(select coalesce(min(n), -1) from {N} where event_type = 'error')")
ORACLE_SQL["arr_find"] = f"select round(cast(coalesce(min(n), -1) as double), 6) as v from {N} where event_type = 'error'"
for name in ("arr_find_none",):
    ORACLE_SQL[name] = "select round(cast(-1 as double), 6) as v"


def _group(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = run(spark, sf_dir, "group events.user_id")
    assert isinstance(got, Groups)
    return got.dataframe().groupBy("key").agg(F.count("*").alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi"), F.sum("at").alias("s"))


QUERIES["arr_group"] = _group
ORACLE_SQL["arr_group"] = f"select user_id as key, count(*) as n, min(n) as lo, max(n) as hi, cast(sum(n) as bigint) as s from {N} group by 1"

# Tables, joins and programs.
P = f"(select * from {E} where event_type = 'purchase')"
table("lang_filter", "([] v: events.value @ `event_type = `purchase)", ["v"], f"select {r('value')} as v from {P}")
table("lang_table", "events @ `event_type = `purchase", ["ts", "id", "v"], f"select t as ts, event_id as id, {r('value')} as v from {P}")
scalar("lang_within", "avg events.value within (2024.01.05D00:00; 2024.01.06D00:00)", "avg(value) filter (t between 1704412800000000000 and 1704499200000000000)")
table("lang_select", "select avg(value), count(value) from events where event_type in `view`click by (xbar[6h; ts]; event_type)", ["ts", "k", "v", "n"], f"select t // {6 * H} * {6 * H} as ts, event_type as k, {r('avg(value)')} as v, {r('count(value)')} as n from {E} where event_type in ('view', 'click') group by 1, 2")
table("lang_resample", "resample[12h; events.ts; events.value; sum]", ["ts", "v"], f"select t // {12 * H} * {12 * H} as ts, {r('sum(value)')} as v from {E} group by 1")
table("lang_resample_count", "resample[12h; events.ts; events.value; count]", ["ts", "v"], f"select t // {12 * H} * {12 * H} as ts, {r('count(value)')} as v from {E} group by 1")
table("lang_resample_med", "resample[12h; events.ts; events.value; med]", ["ts", "v"], f"select t // {12 * H} * {12 * H} as ts, {r('median(value)')} as v from {E} group by 1")
table("lang_resample_last", "resample[1d; events.ts; events.value; last]", ["ts", "v"], f"select t // {24 * H} * {24 * H} as ts, {r('arg_max(value, (t, series, event_id))')} as v from {E} group by 1")
table("lang_asof", "asof[events.ts @ `event_type = `purchase; events.value @ `event_type = `purchase; events.ts @ `event_type = `view; events.value @ `event_type = `view]", ["ts", "l", "r"], f"select a.t as ts, {r('a.value')} as l, {r('b.value')} as r from {P} a asof left join (select * from {E} where event_type = 'view') b on a.t >= b.t")
table("lang_zscore", "v: events.value; z: abs (v - avg v) % dev v; ([] z: z[where z > 1.5])", ["z"], f"select {r('abs(value - m) / d')} as z from {E}, (select avg(value) as m, stddev_pop(value) as d from {E}) where abs(value - m) / d > 1.5")
table("lang_lambda", "f: {[a; b] (a * b) + 1}; ([] v: f[events.value; 2] % 3)", ["v"], f"select {r('(value * 2 + 1) / 3')} as v from {E}")
scalar("lang_spread", "(max events.value) - min events.value", "max(value) - min(value)")
placed("lang_top", "5 # desc events.value", f"select row_number() over (order by value desc, n) - 1 as i, {r('value')} as v from (select * from {N} order by value desc, n limit 5)")
scalar("lang_two_measurements", "cor[5 # desc events.value; 5 # desc orders.o_totalprice]", "0")
ORACLE_SQL["lang_two_measurements"] = "select round(corr(a.value, b.o_totalprice), 6) as v from (select value, row_number() over (order by value desc) as n from events) a join (select o_totalprice, row_number() over (order by o_totalprice desc) as n from orders) b using (n) where n <= 5"

