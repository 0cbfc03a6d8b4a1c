"""Vector functions, twice: of lists on the driver, and of a frame's columns."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import numeric as N
from tidemark.operators import windows as W

NAN, INF = float("nan"), float("inf")


def div(a: float, b: float) -> float:
    a, b = float(a), float(b)
    return a / b if b else NAN if a == 0 or math.isnan(a) else math.copysign(INF, a)


def mod(a: float, b: float) -> float:
    if isinstance(a, int) and isinstance(b, int):
        return 0 if b == 0 else int(math.copysign(abs(a) % abs(b), a)) if abs(a) % abs(b) else 0
    return NAN if b == 0 or math.isinf(a) else math.fmod(a, b)


def power(a: float, b: float) -> float:
    try:
        out = math.pow(a, b)
    except OverflowError:
        return INF
    except ValueError:
        return INF if a == 0 else NAN
    return out


def log(x: float) -> float:
    return -INF if x == 0 else NAN if x < 0 or math.isnan(x) else math.log(x)


def whole(f: Callable) -> Callable:
    return lambda x: x if math.isnan(x) or math.isinf(x) else float(f(x))


def exp(x: float) -> float:
    try:
        return math.exp(x)
    except OverflowError:
        return INF


def trig(f: Callable) -> Callable:
    def go(x: float) -> float:
        try:
            return f(x)
        except ValueError:
            return NAN

    return go


#: float -> float, on the driver.
MATH: dict[str, Callable[[float], float]] = {
    "abs": abs, "sqrt": lambda x: math.sqrt(x) if x >= 0 else NAN, "exp": exp, "log": log, "ceil": whole(math.ceil), "floor": whole(math.floor),
    "signum": lambda x: x if math.isnan(x) else math.copysign(1.0, x), "reciprocal": lambda x: div(1.0, x), "log2": lambda x: log(x) / math.log(2), "log10": lambda x: log(x) / math.log(10),
    "sin": trig(math.sin), "cos": trig(math.cos), "tan": trig(math.tan), "asin": trig(math.asin), "acos": trig(math.acos), "atan": trig(math.atan), "round": whole(lambda x: math.copysign(math.floor(abs(x) + 0.5), x)),
}
MATH_COLUMNS: dict[str, Callable[[Column], Column]] = {
    "abs": F.abs, "sqrt": lambda x: F.when(x < 0, NAN).otherwise(F.sqrt(F.abs(x))), "exp": F.exp, "log": N.flog, "ceil": lambda x: N.fround(x, True), "floor": lambda x: N.fround(x, False),
    "signum": N.fsignum, "reciprocal": lambda x: N.fdiv(F.lit(1.0), x), "log2": lambda x: N.flog(x) / math.log(2), "log10": lambda x: N.flog(x) / math.log(10),
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "round": lambda x: F.when(F.abs(x) < 2.0**53, F.round(F.when(F.abs(x) < 2.0**53, x))).otherwise(x),
}

_seen = lambda v: [x for x in v if not math.isnan(x)]


def deviation(v: list[float]) -> float:
    return math.sqrt(variance(v))


def variance(v: list[float]) -> float:
    m = sum(v) / len(v)
    return sum((x - m) ** 2 for x in v) / len(v)


def median(v: list[float]) -> float:
    s = sorted(v)
    return (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2


def nearest_rank(p: float, v: list[float]) -> float:
    s = sorted(v)
    return s[min(len(s) - 1, math.floor(p / 100 * (len(s) - 1) + 0.5))]


#: Vector -> number, on the driver; None stands for the empty vector's result, or a failure.
REDUCE: dict[str, tuple[Callable[[list[float]], float], object]] = {
    "sum": (sum, 0.0), "avg": (lambda v: sum(v) / len(v), None), "mean": (lambda v: sum(v) / len(v), None), "min": (lambda v: min(_seen(v), default=NAN), LookupError),
    "max": (lambda v: max(_seen(v), default=NAN), LookupError), "med": (median, None), "dev": (deviation, None), "var": (variance, None),
}
REDUCE_COLUMNS: dict[str, Callable[[Column], Column]] = {
    "sum": lambda x: F.coalesce(F.sum(x), F.lit(0.0)), "avg": F.avg, "mean": F.avg, "min": lambda x: F.coalesce(F.min(N.quiet(x)), F.when(F.count(x) > 0, NAN)),
    "max": lambda x: F.coalesce(F.max(N.quiet(x)), F.when(F.count(x) > 0, NAN)), "dev": F.stddev_pop, "var": F.var_pop,
}


def scan(f: Callable) -> Callable[[list[float]], list[float]]:
    def go(v: list[float]) -> list[float]:
        out: list[float] = []
        for x in v:
            out.append(f(out[-1], x) if out else x)
        return out

    return go


def _least(a: float, b: float) -> float:
    return b if math.isnan(a) else a if math.isnan(b) else min(a, b)


def _most(a: float, b: float) -> float:
    return b if math.isnan(a) else a if math.isnan(b) else max(a, b)


def _avgs(v: list[float]) -> list[float]:
    return [s / (i + 1) for i, s in enumerate(scan(lambda a, b: a + b)(v))]


def _ffill(v: list[float]) -> list[float]:
    return scan(lambda a, b: a if math.isnan(b) else b)(v)


RUN: dict[str, Callable[[list[float]], list[float]]] = {
    "sums": scan(lambda a, b: a + b), "avgs": _avgs, "mins": scan(_least), "maxs": scan(_most), "prds": scan(lambda a, b: a * b),
    "deltas": lambda v: [x - v[i - 1] if i else x for i, x in enumerate(v)], "ratios": lambda v: [div(x, v[i - 1]) if i else NAN for i, x in enumerate(v)],
    "fills": _ffill, "ffill": _ffill, "bfill": lambda v: _ffill(v[::-1])[::-1],
}
RUN_COLUMNS: dict[str, Callable] = {
    **{f: (lambda x, w, f=f: W.running(f, x, w)) for f in ("sums", "avgs", "mins", "maxs", "prds")},
    "deltas": W.deltas, "ratios": W.ratios, "fills": W.fill_forward, "ffill": W.fill_forward,
}


def _moving(f: Callable[[list[float]], float]) -> Callable[[int, list[float]], list[float]]:
    return lambda n, v: [f(v[max(0, i - n + 1) : i + 1]) for i in range(len(v))]


MOVE: dict[str, Callable[[int, list[float]], list[float]]] = {
    "mavg": _moving(lambda v: sum(v) / len(v)), "msum": _moving(sum), "mmin": _moving(REDUCE["min"][0]), "mmax": _moving(REDUCE["max"][0]), "mdev": _moving(deviation),
    "mcount": _moving(lambda v: float(len(_seen(v)))), "wma": _moving(lambda v: sum(x * (i + 1) for i, x in enumerate(v)) / (len(v) * (len(v) + 1) / 2)),
}


def glob(pattern: str) -> str:
    """A pattern with * and ? as an anchored regular expression."""
    import re

    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"
