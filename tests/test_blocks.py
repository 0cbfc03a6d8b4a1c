"""Orders over all rows: what a task holds and how often it reads a row."""

import math
import time

import pytest
from pyspark.sql import functions as F

from tidemark.lang.evaluate import Session
from tidemark.lang.values import Frame
from tidemark.model import Measurement

NAN = float("nan")


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """The smallest tables with each event three times, by other keys: equal times and values."""
    folder = str(tmp_path_factory.mktemp("repeated"))
    for name in ("orders", "lineitem"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.withColumn("event_id", F.explode(F.array(*[F.col("event_id") + i * 1000 for i in range(3)]))).write.parquet(f"{folder}/events.parquet")
    return folder


def differences(df, sql, folder):
    """Rows of a query's result that its SQL doesn't have, and the other way round; NaN equals NaN."""
    import duckdb

    db = duckdb.connect()
    for name in ("events", "orders", "lineitem"):
        db.execute(f"create view {name} as select * from '{folder}/{name}.parquet{'' if folder == SF else '/*.parquet'}'")
    held = db.execute(sql)
    names = [d[0] for d in held.description]
    want = sorted((repr(tuple(r)) for r in held.fetchall()))
    got = sorted(repr(tuple(r)) for r in df.select(*names).collect())
    assert want
    return sorted(set(got) ^ set(want)) if got != want else []


def test_rates_between_equal_times_equal_their_sql(spark, repeated):
    """Infinite or NaN, as the SQL has it; not null."""
    from tidemark.plans.language_queries import ORACLE_SQL, QUERIES

    assert not differences(QUERIES["rate_of_change"](spark, repeated), ORACLE_SQL["rate_of_change"], repeated)


@pytest.mark.parametrize("large", [None, 0])
def test_filling_backward_reads_rows_once(spark, monkeypatch, large):
    """60,000 rows in one order, at first without gaps, then with none but the last value: by frames
    that end with the last row these were 1.8 thousand million steps."""
    if large is not None:
        monkeypatch.setattr(Frame, "LARGE", large)
    n = 60_000
    df = spark.range(n).selectExpr("id as ts_ns", f"case when id % 7 = 0 or id > {n // 2} then double('nan') else double(id) end as v", "id as n")
    df = df.selectExpr("ts_ns", f"case when ts_ns = {n - 2} then -1.0 else v end as v")
    m = Measurement("m", df, [], ["v"])
    started = time.perf_counter()
    got = Session(spark, lambda name: m if name == "m" else None).run("bfill m.v").local().items
    assert time.perf_counter() - started < 15
    want, e = [], NAN
    for i in reversed(range(n)):
        x = -1.0 if i == n - 2 else NAN if i % 7 == 0 or i > n // 2 else float(i)
        e = e if math.isnan(x) else x
        want.append(e)
    assert all(a == b or (math.isnan(a) and math.isnan(b)) for a, b in zip(got, reversed(want), strict=True))


@pytest.fixture(scope="module")
def twice(spark, tmp_path_factory):
    """The 100,000 events of sf0.1 two times and its orders: more rows than a block's, 20 times less than
    the size from which an order was dealt into blocks before."""
    folder = str(tmp_path_factory.mktemp("twice"))
    for name in ("orders", "lineitem"):
        spark.read.parquet(f"/root/testdata/sf0.{'1' if name == 'orders' else '001'}/{name}.parquet").coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    e = spark.read.parquet(f"/root/testdata/sf0.1/events.parquet")
    e.withColumn("event_id", F.explode(F.array(F.col("event_id"), F.col("event_id") + 100_000))).write.parquet(f"{folder}/events.parquet")
    return folder


def stages(spark):
    jvm, none = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    seq = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, none, jvm.java.util.ArrayList())
    return {x.stageId(): x for x in map(seq.apply, range(seq.size()))}


def most_rows(spark, before):
    """The most rows of a shuffle that one task has read in the stages since ``before``."""
    store, out = spark.sparkContext._jsc.sc().statusStore(), 0
    for i, stage in stages(spark).items():
        if i not in before:
            tasks = store.taskList(i, stage.attemptId(), 10_000)
            for t in (tasks.apply(k) for k in range(tasks.size())):
                if t.taskMetrics().isDefined():
                    out = max(out, t.taskMetrics().get().shuffleReadMetrics().recordsRead())
    return out


#: Queries of one order over all events.
ONE_ORDER = ["arr_zip", "arr_index", "lang_zscore", "lang_two_measurements", "arr_asc", "arr_desc", "arr_wma", "arr_rev", "arr_deltas", "arr_ffill", "arr_find", "arr_find_none", "arr_ratios", "arr_avgs", "arr_drop", "arr_each_prior", "arr_mavg", "arr_maxs", "arr_mcount"]


@pytest.mark.parametrize("name", ONE_ORDER)
def test_no_task_has_all_rows(spark, twice, monkeypatch, name):
    from tidemark.plans.language_queries import ORACLE_SQL, QUERIES

    monkeypatch.setattr(Frame, "BLOCK", 20_000)  # of two blocks both may fall to one task
    before = set(stages(spark))
    # DuckDB joins by pairs unless the number of events is a literal.
    sql = ORACLE_SQL[name].replace("(select count(*) from events) - 1", "200000 - 1")
    assert not differences(QUERIES[name](spark, twice), sql, twice)
    assert 0 <= most_rows(spark, before) < 150_000


def test_ema_has_no_task_of_all_rows(spark, twice, monkeypatch):
    """Against the recurrence itself; the SQL joins each event with the 60 before."""
    import duckdb

    from tidemark.plans.language_queries import QUERIES, E, O

    monkeypatch.setattr(Frame, "BLOCK", 20_000)  # of two blocks both may fall to one task
    before = set(stages(spark))
    got = {r["event_id"]: r["v"] for r in QUERIES["arr_ema"](spark, twice).collect()}
    assert most_rows(spark, before) < 150_000
    e, db = None, duckdb.connect()
    db.execute(f"create view events as select * from '{twice}/events.parquet/*.parquet'")
    rows = db.execute(f"select event_id, value from {E} {O}").fetchall()
    for i, x in rows:
        e = x if e is None else 0.5 * x + 0.5 * e
        assert abs(got[i] - e) < 2e-6
    assert len(rows) == len(got) == 200_000
