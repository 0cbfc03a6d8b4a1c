import json
import threading
import time
import urllib.request

import pytest

from tidemark.functions import calendar
from tidemark.model import hour_name
from tidemark.session import Engine
from tidemark.sources import line_protocol
from tidemark.sources.store import SchemaError

H = 3600 * 10**9


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/store")


def test_lines(spark):
    lines = ["", "# note", 'cpu,host=web1,dc=x usage=1.5,n=42i,u=7u,ok=t,s="a b,c=d" 5', "cpu usage=1", "cpu", "cpu usage=", "cpu,host=a usage=abc 1", "cpu usage=1 x"]
    got = line_protocol.parse(spark.createDataFrame([(x,) for x in lines], "value string"), now_ns=99).collect()
    assert [r["error"] is None for r in got] == [True, True, False, False, False, False]
    assert got[0]["tags"] == {"host": "web1", "dc": "x"} and got[0]["ts_ns"] == 5 and got[1]["ts_ns"] == 99
    assert [(f["k"], f["kind"], f["v"]) for f in got[0]["fields"]] == [("usage", "double", "1.5"), ("n", "long", "42i"), ("u", "decimal", "7u"), ("ok", "boolean", "t"), ("s", "string", '"a b,c=d"')]


def test_batches_are_whole_or_nothing(engine):
    with pytest.raises(ValueError, match="1 bad lines"):
        engine.store.write_lines(["cpu usage=1 1", "oops"])
    assert engine.store.measurements() == []
    engine.store.write_lines(["cpu usage=1.0 1"])
    with pytest.raises(SchemaError):
        engine.store.write_lines(["mem used=2i 1", "cpu usage=1i 2"])
    assert engine.store.measurements() == ["cpu"]


def test_points_merge_field_by_field(engine):
    engine.store.write_lines([f"cpu,host=a usage={i},n={i}i {i * H}" for i in range(1, 4)])
    engine.store.write_lines([f"cpu,host=a usage=20 {2 * H}", f"cpu,host=a,dc=x usage=9 {2 * H}"])
    rows = engine.query("select usage, n from cpu where host = 'a'").collect()
    assert sorted((r["time"] // H, r["usage"], r["n"]) for r in rows) == [(1, 1.0, 1), (2, 9.0, None), (2, 20.0, 2), (3, 3.0, 3)]
    assert engine.store.compact("cpu") == 3
    again = engine.query("select usage, n from cpu where host = 'a'").collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, rows), key=str)
    assert engine.store.compact("cpu") == 0
    assert engine.store.retain(0, now_ns=3 * H) == ["cpu/1970-01-01T01", "cpu/1970-01-01T02"]
    assert engine.query("select count(usage) from cpu").collect()[0][1] == 1.0
    assert engine.store.status() == {"measurements": 1, "fields": 2, "series": 1, "points": 1}


POISON = [
    "m v=1,junk 5", "m v=1 99999999999999999999", "m v=99999999999999999999i", "m v=18446744073709551616u", "m,=1 v=1", "m,a v=1", "m v= 5", "m  v=1", "m s=\"abc", "m =1", "m v=1,=2",
    "m v=1,", "m, v=1", ",a=1 v=1", "m v=1 1.5", "m v=1 t", "m v=nota", "m v=1e", "m", "m,a=1",
]


def test_lines_that_are_no_points(spark, engine):
    got = line_protocol.parse(spark.createDataFrame([(x,) for x in POISON], "value string"), now_ns=1).collect()
    assert all(r["error"] and r["measurement"] is None and r["fields"] is None for r in got)
    for x in POISON:
        with pytest.raises(ValueError, match="1 bad lines"):
            engine.store.write_lines(["n v=1 1", x])
        break
    assert engine.store.measurements() == []
    assert engine.store.write_lines(["n v=1 1", *POISON], skip_bad=True) == len(POISON)
    assert engine.store.measurements() == ["n"]


def test_lines_with_repeats_and_marks(spark):
    lines = ["m,a=1,b=,a=2=3 v=1,w=2u,v=5", 'm s="x, y=\u0001 \u0001\u0004",t="" +7 ', "m v=-inf,w=1.,x=.5E3,y=nAn,z=+18446744073709551615u"]
    got = line_protocol.parse(spark.createDataFrame([(x,) for x in lines], "value string"), now_ns=1)
    rows = got.collect()
    assert rows[0]["tags"] == {"a": "2=3", "b": ""} and [f["v"] for f in rows[0]["fields"]] == ["2u", "5"]
    assert [f["v"] for f in rows[1]["fields"]] == ['"x, y=\u0001 \u0001\u0004"', '""'] and rows[1]["ts_ns"] == 7
    wide = line_protocol.measurement_rows(got, "m", ["a"], {"v": "double", "x": "double", "y": "double", "z": "decimal", "s": "string"}).collect()
    assert wide[1]["s"] == "x, y=\u0001 \u0001\u0004" and wide[2]["v"] == float("-inf") and wide[2]["x"] == 500.0 and wide[2]["y"] != wide[2]["y"] and wide[2]["z"] == 2**64 - 1


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kathmandu"])
def test_hours_to_the_nanosecond_in_any_zone(spark, engine, zone):
    from datetime import UTC, datetime, timedelta

    usual = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        borders = [0, -5 * H, 3 * H, 1_710_054_000 * 10**9, 2**62 // H * H, -(2**62) // H * H, 1_700_000_000 * 10**9 // (24 * H) * 24 * H]
        times = sorted({b + d for b in borders for d in (-1, 0, 1)})
        engine.store.write_lines([f"cpu v={i}i {t if t else '0'}" for i, t in enumerate(times) if t])
        times = [t for t in times if t]
        assert engine.store.series("cpu").collect()[0]["series"] == "cpu"
        for t in times:
            assert [r["time"] for r in engine.query(f"SELECT v FROM cpu WHERE time < {t}").collect()] == [x for x in times if x < t]
            assert [r["time"] for r in engine.query(f"SELECT v FROM cpu WHERE time >= {t}").collect()] == [x for x in times if x >= t]
        when = [datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=t // 10**9) for t in times]
        for part, f in {"year": lambda w: w.year, "month": lambda w: w.month, "day": lambda w: w.day, "hour": lambda w: w.hour, "minute": lambda w: w.minute, "second": lambda w: w.second, "week": lambda w: w.isocalendar()[1], "dow": lambda w: w.weekday()}.items():
            assert engine.db_query(f"cpu.ts.{part}") == [f(w) for w in when], part
        names = spark.createDataFrame([(t,) for t in times], "t long").select("t", calendar.hour_name(spark_col("t")).alias("h")).collect()
        assert all(r["h"] == hour_name(r["t"]) for r in names)
    finally:
        spark.conf.set("spark.sql.session.timeZone", usual)


def test_times_of_columns_in_any_zone(spark):
    from pyspark.sql import functions as F

    usual = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql("select timestamp_ntz'2024-03-10 02:30:00.123456' as a, timestamp_ntz'1969-12-31 23:59:59.999999' as b, timestamp'2024-03-10 00:00:00Z' as c")
        got = df.select(*(calendar.nanoseconds(F.col(n), df.schema[n].dataType).alias(n) for n in "abc")).first()
        assert tuple(got) == (1_710_037_800_123_456_000, -1_000, 1_710_028_800 * 10**9)
    finally:
        spark.conf.set("spark.sql.session.timeZone", usual)


def spark_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_the_last_line_of_a_point_wins(engine):
    engine.store.write_lines(["cpu a=1,b=1 5", "cpu a=2 5", "cpu b=7 5", "cpu a=4 6"])
    assert sorted(tuple(r) for r in engine.query("select a, b from cpu").collect()) == [(5, 2.0, 7.0), (6, 4.0, None)]


def test_compaction_of_overlapping_times(engine):
    engine.store.write_lines([f"cpu v={i} {t}" for i, t in enumerate((10, 20, 30))])
    engine.store.write_lines([f"cpu v={i * 11} {t}" for i, t in enumerate((20, 30, 40), 5)])
    want = [(10, 0.0), (20, 55.0), (30, 66.0), (40, 77.0)]
    assert [tuple(r) for r in engine.query("select v from cpu").collect()] == want
    assert engine.store.compact("cpu") == 1 and engine.store.compact("cpu") == 0
    assert [tuple(r) for r in engine.query("select v from cpu").collect()] == want
    assert "Aggregate" not in engine.measurement("cpu").df._jdf.queryExecution().executedPlan().toString()  # merged hours need no grouping
    assert engine.store.status()["points"] == 4
    assert engine.store.vacuum(0) == 2 and engine.store.vacuum(0) == 0
    assert [tuple(r) for r in engine.query("select v from cpu").collect()] == want


def test_an_append_while_hours_are_compacted_stays(engine, monkeypatch):
    from tidemark.sources.store import Store

    engine.store.write_lines(["cpu v=1 1"])
    engine.store.write_lines(["cpu v=2 2"])
    put, other = Store._put, Store(engine.spark, engine.store.root)

    def slow(self, name, df, batch, merged=False):
        out = put(self, name, df, batch, merged)
        if merged:
            monkeypatch.setattr(Store, "_put", put)
            other.write_lines(["cpu v=3 3"])
            assert other.compact("cpu") == 1  # another round gets there first
        return out

    monkeypatch.setattr(Store, "_put", slow)
    assert engine.store.compact("cpu") == 0
    assert [tuple(r) for r in engine.query("select v from cpu").collect()] == [(1, 1.0), (2, 2.0), (3, 3.0)]


def test_a_batch_that_fails_half_way_leaves_nothing(engine, monkeypatch):
    from tidemark.sources.store import Store

    put = Store._put

    def breaks(self, name, df, batch, merged=False):
        if name == "m2":
            raise OSError("no space")
        return put(self, name, df, batch, merged)

    monkeypatch.setattr(Store, "_put", breaks)
    with pytest.raises(OSError, match="no space"):
        engine.store.write_lines([f"m{i} v=1 1" for i in range(4)])
    monkeypatch.undo()
    assert engine.store.measurements() == [] and engine.store.status()["points"] == 0
    engine.store.write_lines([f"m{i} v=1 1" for i in range(4)])
    assert engine.store.measurements() == ["m0", "m1", "m2", "m3"]


def test_writers_at_once_lose_nothing(spark, engine):
    from tidemark.sources.store import Store

    stores = [Store(spark, engine.store.root) for _ in range(3)]
    threads = [threading.Thread(target=s.write_lines, args=([f"cpu f{i}={i} {i + 1}"],)) for i, s in enumerate(stores)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert engine.store.fields("cpu") == ["f0", "f1", "f2"] and engine.store.status()["points"] == 3
    engine.store.log.EVERY = 2
    for i in range(3):
        engine.store.insert("cpu", {"f0": 1.0}, None, 100 + i)
    assert Store(spark, engine.store.root).status()["points"] == 6


def test_a_stream_goes_on_after_bad_lines(spark, engine, tmp_path):
    from tidemark.streaming.ingest import ingest, lines_from

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("\n".join(["m v=1 1", *POISON, "m v=2i 2", "m v=3,V=1 3", "m,v=x v=4 4", "m ts_ns=1 5", "m v=5 5"]) + "\n")
    for _ in range(2):
        q = ingest(lines_from(spark, f"file://{tmp_path}/in"), engine.store, f"file://{tmp_path}/ck", once=True)
        assert q.awaitTermination(120) and q.exception() is None
        (tmp_path / "in/b.txt").write_text("m v=t 6\nm v=7 7\n")
    assert [tuple(r) for r in engine.query("select v from m").collect()] == [(1, 1.0), (5, 5.0), (7, 7.0)]
    assert engine.store.write_lines(["m v=9 9"], stream=(f"file://{tmp_path}/ck", 1)) == 0  # that batch is there
    assert engine.store.status()["points"] == 3


def test_python_calls(engine):
    engine.db_insert("t", {"v": 1.5, "s": "x"}, {"k": "a"}, 7)
    assert engine.db_measurements() == ["t"] and engine.db_fields("t") == ["s", "v"]
    assert engine.db_query("t.v + 1") == [2.5] and engine.db_query("t.k") == ["a"]
    engine.db_insert("t", {"v": 2.5}, {"k": "a"}, 8)
    assert engine.db_query("sum t.v") == 4.0


def test_streaming_ingest(spark, engine, tmp_path):
    from tidemark.streaming.ingest import ingest, lines_from

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("cpu,host=a usage=1 1\nbad\ncpu,host=b usage=2 2\n")
    for more in (None, "cpu,host=a usage=5 3\n"):
        if more:
            (tmp_path / "in/b.txt").write_text(more)
        q = ingest(lines_from(spark, f"file://{tmp_path}/in"), engine.store, f"file://{tmp_path}/ck", once=True)
        assert q.awaitTermination(120)
        assert q.exception() is None
    assert engine.query("select sum(usage), count(usage) from cpu").collect()[0][1:] == (8.0, 3.0)


def test_subscriptions_push_changes_only():
    from tidemark.streaming.ingest import Subscriptions

    values, pushed = [1, 1, 2], []
    s = Subscriptions(lambda q: values.pop(0) if len(values) > 1 else values[0], lambda i, text: pushed.append((i, text)))
    s.subscribe("a", "x", 1)
    time.sleep(0.8)
    assert s.unsubscribe("a") and not s.unsubscribe("a")
    assert pushed == [("a", "1"), ("a", "2")]


def test_http(engine):
    from tidemark.server import serve

    server = serve(engine, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"
    post = lambda path, body: urllib.request.urlopen(urllib.request.Request(base + path, body.encode(), method="POST"))
    try:
        assert post("/write", "cpu,host=a usage=1 1\ncpu,host=a usage=3 2").status == 204
        got = json.load(post("/query", json.dumps({"q": "select mean(usage) from cpu"})))
        assert got["results"][0]["series"][0] == {"name": "cpu", "columns": ["time", "mean(usage)"], "values": [[None, 2.0]]}
        assert json.load(post("/lang", json.dumps({"q": "cpu.usage"})))["values"] == [1.0, 3.0]
        assert json.load(urllib.request.urlopen(base + "/measurements")) == {"measurements": ["cpu"]}
        live = urllib.request.urlopen(base + "/subscribe?id=a&interval_ms=100&q=sum%20cpu.usage")
        assert [live.readline() for _ in range(3)][:2] == [b"id: a\n", b'data: {"elapsed_ns": 0, "type": "float", "value": 4.0}\n']
        assert post("/write", "cpu,host=a usage=5 3").status == 204
        live.readline()
        assert json.loads(live.readline()[6:])["value"] == 9.0
        live.close()
    finally:
        server.shutdown()


def test_command_line(engine, capsys):
    from tidemark.__main__ import main, run_lines

    run_lines(engine, ["/ note", "1 + 1", "\\fmt json", "`a", "nope", "\\q", "2"], "text")
    out = capsys.readouterr().out.splitlines()
    assert out[0] == "2" and json.loads(out[1])["value"] == "a" and out[2].startswith("error") and len(out) == 3
    assert main(["version"]) == 0
