import pytest

from tidemark.model import Measurement
from tidemark.plans.compiler import compile_select, time_range
from tidemark.plans.dialect import Agg, Compare, DialectError, Logic, parse

S = 10**9


@pytest.fixture(scope="module")
def cpu(spark):
    rows = [(10**12 + i * S, "web1", float(i * 10), i, i % 2 == 0) for i in range(10)]
    return Measurement("cpu", spark.createDataFrame(rows, "ts_ns long, host string, usage double, n long, up boolean"), ["host"], ["usage", "n", "up"])


def run(text, m):
    return [tuple(r) for r in compile_select(parse(text, now_ns=10**12 + 5 * S), m).collect()]


def test_clauses():
    s = parse("select mean(usage) AS m, percentile(usage, 95) from cpu where a = 'x' and b != 'y' or c =~ /w-\\d+/ group by time(5m), host fill(previous) order by time desc limit 3 offset 2")
    assert s.aggs == [Agg("mean", "usage", None, "m"), Agg("percentile", "usage", 95.0)]
    assert s.where == Logic("or", Logic("and", Compare("a", "=", "x"), Compare("b", "!=", "y")), Compare("c", "=~", "w-\\d+"))
    assert (s.bucket, s.group, s.fill, s.descending, s.limit, s.offset) == (300 * S, ["host"], "previous", True, 3, 2)
    assert s.aggs[1].name == "percentile(usage, 95)"


@pytest.mark.parametrize("text", ["select", "select x", "select x from", "select nope(x) from m", "select x from m where", "select x from m where time > 'yesterday'", "select x from m limit -1", "select x from m group by host, time(5m) extra", "select *, x from m", "select x from m where a ~ 3", "select x from m fill(odd)"])
def test_wrong_texts(text):
    with pytest.raises(DialectError):
        parse(text)


def test_time_is_folded_to_a_closed_range():
    assert time_range(parse("select x from m where time > 1500 and time <= 2000").where) == (1501, 2000)
    assert time_range(parse("select x from m where time < 5 or host = 'a'").where)[1] == 2**63 - 1
    assert parse("select x from m where time >= now() - 1h", now_ns=10**15).where.value == 10**15 - 3600 * S
    assert parse("select x from m where time = '2024-01-15T12:30:00.5Z'").where.value == 1705321800500000000


def test_means_by_bucket(cpu):
    assert run("select mean(usage) from cpu group by time(5s)", cpu) == [(10**12, 20.0), (10**12 + 5 * S, 70.0)]


def test_result_paging_applies_after_aggregation(cpu):
    assert run("select mean(usage) from cpu group by time(5s) order by time desc limit 1", cpu) == [(10**12 + 5 * S, 70.0)]
    assert [r[0] for r in run("select usage from cpu limit 5 offset 3", cpu)] == [10**12 + i * S for i in range(3, 8)]


def test_predicates(cpu):
    assert len(run("select usage from cpu where host =~ /web-\\d+/", cpu)) == 0
    assert len(run("select usage from cpu where host =~ /eb\\d/ and n >= 5", cpu)) == 5
    assert len(run("select usage from cpu where host !~ /[/", cpu)) == 10
    assert len(run("select usage from cpu where nowhere = 'x'", cpu)) == 0
    assert len(run("select usage from cpu where nowhere != 'x' and time between 0 and 1000000000000", cpu)) == 1
    assert len(run("select usage from cpu where time < now() or up = true", cpu)) == 7


def test_missing_tags_and_empty_input(spark):
    m = Measurement("m", spark.createDataFrame([(1, None, 1.0), (2, "a", None)], "ts_ns long, t string, v double"), ["t"], ["v"])
    assert run("select v from m where t != 'a'", m) == [(1, 1.0)]
    assert run("select count(v), sum(v) from m group by t", m) == [(None, "", 1.0, 1.0), (None, "a", 0.0, None)]
    assert run("select count(v), mean(v) from m where t = 'z'", m) == [(None, 0.0, None)]
    assert run("select count(v) from m where t = 'z' group by t", m) == []


def test_nan_and_negative_times(spark):
    nan = float("nan")
    m = Measurement("m", spark.createDataFrame([(-7, 2.0), (-3, nan), (3, 1.0), (12, 4.0)], "ts_ns long, v double"), [], ["v"])
    assert run("select min(v), max(v) from m", m) == [(None, 1.0, 4.0)]
    assert run("select count(v) from m group by time(5ns)", m) == [(-5, 1.0), (0, 2.0), (10, 1.0)]


def test_first_last_stddev_and_rank(spark):
    m = Measurement("m", spark.createDataFrame([(300, 2.0), (100, 4.0), (200, 4.0), (201, 4.0), (202, 6.0)], "ts_ns long, v double"), [], ["v"])
    got = run("select first(v), last(v), stddev(v), percentile(v, 50), percentile(v, 100) from m", m)[0]
    assert got[1:3] == (4.0, 2.0) and abs(got[3] - 1.2649) < 1e-4 and got[4:] == (4.0, 6.0)


@pytest.mark.parametrize(("policy", "middle"), [("null", [None, None]), ("previous", [10.0, 10.0]), ("linear", [20.0, 30.0]), ("7", [7.0, 7.0])])
def test_fill(spark, policy, middle):
    m = Measurement("m", spark.createDataFrame([(0, "a", 10.0), (30, "a", 40.0), (10, "b", 1.0)], "ts_ns long, t string, v double"), ["t"], ["v"])
    got = run(f"select sum(v), count(v) from m group by time(10ns), t fill({policy})", m)
    assert [r[2] for r in got if r[1] == "a"] == [10.0, *middle, 40.0]
    assert [r[3] for r in got if r[1] == "a"] == [1.0, 0.0, 0.0, 1.0]
    assert [r[0] for r in got if r[1] == "b"] == [0, 10, 20, 30]


def test_range_reaches_the_scan(spark, tmp_path):
    from tidemark.session import Engine

    e = Engine(spark, f"file://{tmp_path}/s")
    e.store.write_lines([f"cpu,host=a usage={i} {i * 3600 * S}" for i in range(1, 6)])
    m = e.store.measurement("cpu")
    plan = compile_select(parse(f"select usage from cpu where time >= {4 * 3600 * S}"), m)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(__hour" in plan and "PushedFilters: [IsNotNull(ts_ns)" in plan


WHOLE = "fill_null fill_previous fill_linear fill_value fill_none arr_asc arr_desc arr_rev arr_scan_max arr_ffill arr_group arr_zip store_merge store_calendar line_protocol_errors lang_asof keyed_asof agg_percentile"


@pytest.mark.parametrize("name", WHOLE.split())
def test_whole_table_queries_equal_their_sql(spark, name):
    import duckdb

    from tidemark.plans import catalog_queries

    db = duckdb.connect()
    db.execute("create view events as select * from '/root/testdata/sf0.001/events.parquet'")
    plain = lambda x: round(x, 5) + 0.0 if isinstance(x, float) else x
    df = catalog_queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    sql = db.execute(catalog_queries.ORACLE_SQL[name])
    names = [d[0] for d in sql.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*names).collect()), key=repr)
    assert got == sorted((tuple(map(plain, r)) for r in sql.fetchall()), key=repr) and got


def test_filling_of_very_many_buckets(spark):
    """Buckets are made in steps, so no row holds them all."""
    from pyspark.sql import functions as F

    from tidemark.operators.filling import fill

    df = spark.createDataFrame([(-30_000_000, "a", 1.0), (30_000_000, "b", 2.0)], "time long, k string, v double")
    out = fill(df, 20, ["k"], {"v": False}, "null")
    assert tuple(out.agg(F.count("*"), F.min("time"), F.max("time"), F.count_distinct("time"), F.count("v")).first()) == (6_000_002, -30_000_000, 30_000_000, 3_000_001, 2)
    one = fill(df.filter("k = 'a'"), 20, ["k"], {"v": False}, "previous").collect()
    assert [tuple(r) for r in one] == [(-30_000_000, "a", 1.0)]


def test_medians_by_ranks(spark):
    from tidemark.operators.aggregates import median

    rows = [("a", x) for x in (5.0, 1.0, 1.0, 9.0)] + [("b", x) for x in (2.0, 7.0, 7.0)] + [("c", None)]
    got = {r["k"]: r["median"] for r in median(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert got == {"a": 3.0, "b": 7.0}
