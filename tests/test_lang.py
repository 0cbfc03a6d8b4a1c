import math
import random

import pytest

from tidemark.lang.evaluate import Session
from tidemark.lang.values import Frame, LangError, Vec, show
from tidemark.model import Measurement
from tidemark.session import plain

NAN = float("nan")


@pytest.fixture(scope="module")
def lang(spark):
    rows = [(10**12 + i * 10**9, f"web{1 + i % 2}", float(i * 10), i) for i in range(10)]
    cpu = Measurement("cpu", spark.createDataFrame(rows, "ts_ns long, host string, usage double, n long"), ["host"], ["usage", "n"])
    return Session(spark, lambda name: cpu if name == "cpu" else None)


@pytest.mark.parametrize(("text", "shown"), [
    ("2 * 3 + 4", "14"), ("10 % 4", "2.5"), ("-7 mod 3", "-1"), ("7 mod 0", "0"), ("1 0 % 0 0", "0w 0n"), ("2 ^ 10", "1024.0"), ("deltas 8 9 15 4", "8.0 1.0 6.0 -11.0"),
    ("prev 7 5 6", "0 7 5"), ("next 7 5 6", "5 6 0"), ("xbar[10; 0 5 10 15 20 25]", "0 0 10 10 20 20"), ("mavg[3; 1 2 3 4 5]", "1.0 1.5 2.0 3.0 4.0"),
    ("ema[0.5; 1 2 3 4]", "1.0 1.5 2.25 3.125"), ("mcount[3; 1.0 0n 3.0 4.0 0n]", "1.0 1.0 2.0 2.0 2.0"), ("til 4", "0 1 2 3"), ("count til 0", "0"), ("rev 1 2 3", "3 2 1"),
    ("desc 3 1 2", "3 2 1"), ("distinct 1 2 1", "1 2"), ("group 1 2 1", "{1: 0 2; 2: 1}"), ("where 0101b", "1 3"), ("raze (1 2; 3)", "(1 2; 3)"), ("flip (1 2; 3 4)", "((1; 3); (2; 4))"),
    ("key `b`a ! 1 2", "`a`b"), ("(`a`b ! 1 2)[`b]", "2"), ("(`a`b ! 1 2).a", "1"), ("{x + y}[3; 4]", "7"), ("{[a; b] c: a * b; c + 1}[3; 4]", "13"), ("{x + y}/1 2 3 4", "10"),
    ("{x + y}\\1 2 3", "(1; 3; 6)"), ("{x - y}':1 4 9", "(1; 3; 5)"), ("{x * 2}'1 2", "(2; 4)"), ("1 2 3 |> sum", "6.0"), ("$[0b; 1; 1b; 2; 3]", "2"), ("?[101b; 1 1 1; 2 2 2]", "1 2 1"),
    ("1 2 , 3", "1 2 3"), ('"ab" , "c"', '"abc"'), ("2 # 1 2 3", "1 2"), ("2 _ 1 2 3", "3"), ("5 6 7 ? 6", "1"), ("5 6 7 ? 9", "-1"), ("1 5 in 1 2 3", "10b"), ('`web-01 like "web-*"', "1b"),
    ("2024.01.15D12:30:00.week", "3"), ("2024.06.20D00:00.dow", "3"), ("2024.01.15D00:00 + 36h", "2024.01.16D12:00:00"), ("1h - 15m", "45m"), ("1 2 3 ~ 1 2 3", "1b"), ("0n = 0n", "1b"),
    ("signum (-2 0 3)", "-1.0 1.0 -1.0"), ("log 0", "-0w"), ("type `a`b", "`sym[]"), ("null 0N", "1b"), ('trim " a\t"', '"a"'), ('count "é"', "2"), ("string 1 2", '"1 2"'),
    ("med 1 2 3 4", "2.5"), ("dev 1 3 5 7", repr(math.sqrt(5.0))), ("pct[50; 1 2 3]", "2.0"), ("wavg[1 2 3; 10 20 30]", repr(140 / 6)), ("cor[1 2 3; 2 4 6]", "1.0"), ("cor[1 1; 2 3]", "0n"),
    ("1 2 3[-1]", "3"), ("1 2 3[0 2]", "1 3"), ("1 2 3[101b]", "1 3"), ("2 / a comment", "2"), ("([] a: 1 2; b: `x`y)[1]", "{a: 2; b: `y}"),
])
def test_literals(lang, text, shown):
    assert show(lang.run(text)) == shown


@pytest.mark.parametrize("text", ["1 +", "(1; 2", "nothing", "mavg[0; 1 2]", "1 2 + 1 2 3", "min til 0", "1 2[5]", "$[1; 2]", "not 3", "cpu.nothing", '1 + "a"', "5 @ `a = 1"])
def test_errors(lang, text):
    with pytest.raises(LangError):
        lang.run(text)


def test_measurements(lang):
    run = lambda t: plain(lang.run(t))
    assert run("avg cpu.usage") == 45.0
    assert run("cpu.usage @ `host = `web1 & `n > 3") == [40.0, 60.0, 80.0]
    assert run("cpu.n @ `host in `web2`web3") == [1, 3, 5, 7, 9]
    assert run("count cpu.n within (1970.01.01D00:16:42; 1970.01.01D00:16:45)") == 4
    assert run("select avg usage from cpu by 5s")["avg(usage)"] == [20.0, 70.0]
    assert run("select m: max(n) from cpu where host like \"*1\" by (xbar[5s; ts]; host)") == {"ts": [10**12, 10**12 + 5 * 10**9], "host": ["web1", "web1"], "m": [4.0, 8.0]}
    assert run("abs (cpu.usage - avg cpu.usage) % dev cpu.usage")[0] == pytest.approx(1.5666989)
    assert run("{x - y}':cpu.n") == [0] + [1] * 9
    assert run("{x + y}/cpu.n") == 45.0
    assert run("3 # desc cpu.usage") == [90.0, 80.0, 70.0]
    assert run("distinct cpu.host") == ["web1", "web2"]
    assert run("cpu.usage[where cpu.n > 7]") == [80.0, 90.0]
    assert run("cor[cpu.n; cpu.usage]") == pytest.approx(1.0)
    assert run("spread: {(max x) - min x}; spread[cpu.usage]") == 90.0


def test_joins_and_buckets(lang):
    got = plain(lang.run("asof[1 3 5 7; 1 3 5 7; 2 2 4 6; 100.0 200.0 300.0 400.0]"))
    assert got["ts"] == [1, 3, 5, 7] and got["right"][1:] == [200.0, 300.0, 400.0] and math.isnan(got["right"][0])
    assert plain(lang.run("resample[10; 0 5 10 15 20 25; 1 2 3 4 5 6; avg]")) == {"ts": [0, 10, 20], "value": [1.5, 3.5, 5.5]}
    assert plain(lang.run("resample[10; 0 5 10; 1 2 3; count]"))["value"] == [2.0, 1.0]


@pytest.mark.parametrize("block", [None, 7])
def test_columns_equal_the_driver(spark, monkeypatch, block):
    """Every vector function on columns against its plain form, on numbers with gaps; with ``block``
    the order is dealt into blocks of so many places."""
    if block:
        monkeypatch.setattr(Frame, "LARGE", 0)
        monkeypatch.setattr(Frame, "BLOCK", block)
    rng = random.Random(5)
    v = [NAN if rng.random() < 0.15 else round(rng.uniform(-9, 9), 2) for _ in range(40)]
    m = Measurement("m", spark.createDataFrame([(t, x) for t, x in sorted(enumerate(v), key=lambda _: rng.random())], "ts_ns long, v double").repartition(3), [], ["v"])
    s = Session(spark, lambda name: m if name == "m" else None)
    s.env["w"] = Vec("float", v)
    near = lambda a, b: (math.isnan(a) and math.isnan(b)) or a == pytest.approx(b, rel=1e-9, abs=1e-9)
    clean = "sums avgs prds deltas ratios mins maxs ffill bfill abs sqrt exp log ceil floor signum reciprocal prev next rev distinct where".split()
    for f in [*clean, *[f"{g}[4;" for g in ("mavg", "msum", "mmin", "mmax", "mcount", "wma")], "mavg[20;", "ema[0.3;", "{x - y}':", "{x + y}\\", "{x * y}\\", "{$[x > y; x; y - 1.5]}\\", "3 _", "5 #"]:
        text = (lambda x: f"{f} {x} > 0.0" if f == "where" else f"{f} {x}]" if f.endswith(";") else f"{f} {x}")  # noqa: E731, B023
        a, b = plain(s.run(text("m.v"))), plain(s.run(text("w")))
        assert len(a) == len(b) and all(map(near, a, b)), f
    for f in ("min", "max", "count", "{x + y}/", "{$[x > y; x; y]}/"):
        a, b = plain(s.run(f"{f} m.v")), plain(s.run(f"{f} w"))
        assert near(float(a), float(b)), f
    assert plain(s.run("m.v ? 0n")) == plain(s.run("w ? 0n"))
    seen = [x for x in v if not math.isnan(x)]
    m2 = Measurement("m", spark.createDataFrame(list(enumerate(seen)), "ts_ns long, v double"), [], ["v"])
    s2 = Session(spark, lambda name: m2 if name == "m" else None)
    s2.env["w"] = Vec("float", seen)
    for text in ("med {}", "asc {}", "desc {}", "{} + rev {}", "prev sums {}", "pct[30; {}]", "({} - mavg[3; {}]) * 2"):
        a, b = plain(s2.run(text.replace("{}", "m.v"))), plain(s2.run(text.replace("{}", "w")))
        assert all(map(near, a, b)) if isinstance(a, list) else near(a, b), text


@pytest.mark.parametrize("block", [None, 5])
def test_as_of_without_keys(spark, block):
    from tidemark.operators.joins import asof

    rng = random.Random(6)
    left = [(rng.randint(0, 60), i) for i in range(40)]
    right = [(rng.randint(0, 60), i, rng.choice([None, 1.5, 2.5])) for i in range(25)]
    a, b = spark.createDataFrame(left, "ts long, i long"), spark.createDataFrame(right, "ts long, i long, v double")
    got = asof(a, b, "ts", "v", None, "i", "i", "r", blocks=bool(block), block=block or 1).collect()
    for r in got:
        before = [x for x in right if x[0] <= r["ts"]]
        assert r["r"] == (max(before)[2] if before and max(before)[0] else before and max(before, key=lambda x: x[:2])[2] if before else None)
    assert len(got) == 40


def test_groups_and_members_of_columns(lang):
    run = lambda t: plain(lang.run(t))
    assert run("group cpu.host") == {"web1": [0, 2, 4, 6, 8], "web2": [1, 3, 5, 7, 9]}
    assert run("(group cpu.host)[`web2]") == [1, 3, 5, 7, 9] and run("key group cpu.host") == ["web1", "web2"]
    with pytest.raises(LangError):
        lang.run("(group cpu.host)[`web3]")
    assert run("cpu.n in 3 + cpu.n") == [False] * 3 + [True] * 7
    assert run("cpu.host in cpu.host @ `n > 8") == [False, True] * 5 and run("`web1 in cpu.host") is True and run("3.5 in cpu.usage") is False
    assert run("40 in cpu.usage") is True and run("cpu.usage in 10 * cpu.n") == [True] * 10


def test_long_ranges_and_matches(lang):
    run = lambda t: plain(lang.run(t))
    assert run("sum til 300000") == sum(range(300_000)) and run("count where 0 = (til 200001) mod 2") == 100_001 and run("3 # rev til 100001") == [100_000, 99_999, 99_998]
    assert run("cpu.n ~ til 10") is True and run("cpu.n ~ til 9") is False and run("cpu.n ~ cpu.usage") is False
    assert run("cpu.usage ~ 10.0 * cpu.n") is True and run("cpu.usage ~ rev cpu.usage") is False and run("cpu.host ~ cpu.host") is True and run("cpu.n ~ 5") is False


def test_patterns_are_javas(lang):
    run = lambda t: plain(lang.run(t))
    from tidemark.plans.compiler import _valid

    assert _valid("(?<n>a)") and not _valid("(?P<n>a)") and not _valid("[")
    assert run('count cpu.n @ `host like "web?"') == 10
