"""The time-series SELECT dialect: text to statement."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import UTC, datetime

from tidemark.model import NS

#: The dialect's aggregate functions.
AGGREGATES = ("count", "sum", "mean", "avg", "min", "max", "first", "last", "stddev", "percentile")
FILLS = ("none", "null", "previous", "linear")


class DialectError(ValueError):
    """The text isn't a statement of the dialect."""


@dataclass(frozen=True)
class Agg:
    func: str
    field: str
    p: float | None = None
    alias: str | None = None

    @property
    def name(self) -> str:
        if self.alias:
            return self.alias
        inside = f"{self.field}, {self.p:g}" if self.func == "percentile" else self.field
        return f"{self.func}({inside})"


@dataclass(frozen=True)
class Compare:
    """A tag, field or ``time`` against a value; op in = != < <= > >= =~ !~ in between."""

    name: str
    op: str
    value: object


@dataclass(frozen=True)
class Logic:
    op: str
    left: object
    right: object


@dataclass
class Select:
    measurement: str
    wildcard: bool = False
    fields: list[str] = field(default_factory=list)
    aggs: list[Agg] = field(default_factory=list)
    where: object = None
    bucket: int | None = None
    group: list[str] = field(default_factory=list)
    fill: str | float = "none"
    descending: bool = False
    limit: int | None = None
    offset: int | None = None


_TOKEN = re.compile(
    r"""\s+ | (?P<dur>\d+(?:ns|us|ms|s|m|h|d|w)\b) | (?P<num>\d+\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?|\.\d+)
    | (?P<str>'(?:[^'\\]|\\.)*') | (?P<name>[A-Za-z_][\w.-]*|"(?:[^"\\]|\\.)+") | (?P<re>(?<=~)\s*/(?:[^/\\]|\\.)*/)
    | (?P<op>=~|!~|!=|<>|<=|>=|[=<>(),*+\-])""",
    re.X,
)


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if out and out[-1][1] in ("=~", "!~") and (r := re.compile(r"\s*/((?:[^/\\]|\\.)*)/").match(text, at)):
            out.append(("re", r[1].replace("\\/", "/")))
            at = r.end()
            continue
        if m is None:
            raise DialectError(f"unexpected {text[at]!r} at {at}")
        at = m.end()
        if m.lastgroup:
            value = m[m.lastgroup]
            if m.lastgroup == "str" or (m.lastgroup == "name" and value[0] == '"'):
                value = re.sub(r"\\(.)", r"\1", value[1:-1])
            out.append((m.lastgroup, value))
    return out


def duration(text: str) -> int:
    m = re.fullmatch(r"(\d+)(ns|us|ms|s|m|h|d|w)", text)
    if not m:
        raise DialectError(f"no duration: {text!r}")
    return int(m[1]) * NS[m[2]]


def instant(text: str) -> int:
    """Nanoseconds of ``YYYY-MM-DD`` or an RFC 3339 time."""
    m = re.fullmatch(r"(\d{4}-\d\d-\d\d)(?:[T ](\d\d:\d\d:\d\d)(?:\.(\d{1,9}))?(Z|[+-]\d\d:\d\d)?)?", text)
    if not m:
        raise DialectError(f"no date or time: {text!r}")
    zone = "+00:00" if m[4] in (None, "Z") else m[4]
    try:
        whole = datetime.fromisoformat(f"{m[1]}T{m[2] or '00:00:00'}{zone}")
    except ValueError as e:
        raise DialectError(str(e)) from None
    return int((whole - datetime(1970, 1, 1, tzinfo=UTC)).total_seconds()) * 10**9 + int((m[3] or "0").ljust(9, "0"))


class Parser:
    def __init__(self, text: str, now_ns: int | None = None):
        self.t, self.i, self.now_ns = tokens(text), 0, now_ns

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.t[self.i + ahead] if self.i + ahead < len(self.t) else ("end", "")

    def take(self, value: str | None = None, kind: str | None = None) -> str:
        k, v = self.peek()
        if (value is not None and v.lower() != value.lower()) or (kind is not None and k != kind) or k == "end":
            raise DialectError(f"expected {value or kind}, found {v or 'the end'!r}")
        self.i += 1
        return v

    def at(self, *words: str) -> bool:
        """Whether the next tokens are these words or signs."""
        return all(self.peek(n)[0] in ("name", "op") and self.peek(n)[1].lower() == w for n, w in enumerate(words))

    def maybe(self, *words: str) -> bool:
        if self.at(*words):
            self.i += len(words)
            return True
        return False

    def statement(self) -> Select:
        self.take("select")
        wildcard, fields, aggs = self.items()
        self.take("from")
        s = Select(self.take(kind="name"), wildcard, fields, aggs)
        if self.maybe("where"):
            s.where = self.either()
        if self.maybe("group", "by"):
            self.group(s)
        if self.maybe("fill"):
            s.fill = self.fill()
        if self.maybe("order", "by"):
            self.take("time")
            s.descending = self.maybe("desc")
            if not s.descending:
                self.maybe("asc")
        if self.maybe("limit"):
            s.limit = self.whole()
        if self.maybe("offset"):
            s.offset = self.whole()
        if self.peek()[0] != "end":
            raise DialectError(f"unexpected {self.peek()[1]!r}")
        return s

    def items(self) -> tuple[bool, list[str], list[Agg]]:
        if self.maybe("*"):
            return True, [], []
        fields, aggs = [], []
        while True:
            name = self.take(kind="name")
            if self.maybe("("):
                func = name.lower()
                if func not in AGGREGATES:
                    raise DialectError(f"unknown aggregate {name!r}")
                distinct = func == "count" and self.at("distinct") and self.peek(1)[1] != ")"
                if distinct:
                    func = "count_distinct"
                    self.i += 1
                of, p = self.take(kind="name"), None
                if func == "percentile":
                    self.take(",")
                    p = float(self.take(kind="num"))
                self.take(")")
                aggs.append(Agg(func, of, p, self.take(kind="name") if self.maybe("as") else None))
            else:
                fields.append(name)
            if not self.maybe(","):
                return False, fields, aggs

    def group(self, s: Select) -> None:
        while True:
            if self.at("time", "("):
                if s.group or s.bucket is not None:
                    raise DialectError("time() comes first, once")
                self.i += 2
                s.bucket = duration(self.take(kind="dur"))
                self.take(")")
            else:
                s.group.append(self.take(kind="name"))
            if not self.maybe(","):
                return

    def fill(self) -> str | float:
        self.take("(")
        minus = self.maybe("-")
        kind, value = self.peek()
        self.i += 1
        self.take(")")
        if kind == "num":
            return -float(value) if minus else float(value)
        if kind == "name" and value.lower() in FILLS and not minus:
            return value.lower()
        raise DialectError(f"unknown fill {value!r}")

    def whole(self) -> int:
        v = self.take(kind="num")
        if not v.isdigit():
            raise DialectError(f"expected a whole number, found {v!r}")
        return int(v)

    def either(self) -> object:
        left = self.both()
        while self.maybe("or"):
            left = Logic("or", left, self.both())
        return left

    def both(self) -> object:
        left = self.term()
        while self.maybe("and"):
            left = Logic("and", left, self.term())
        return left

    def term(self) -> object:
        if self.maybe("("):
            inside = self.either()
            self.take(")")
            return inside
        name = self.take(kind="name")
        if name.lower() == "time":
            return self.time_term()
        if self.maybe("in"):
            self.take("(")
            values = [self.value()]
            while self.maybe(","):
                values.append(self.value())
            self.take(")")
            return Compare(name, "in", tuple(values))
        op = self.take(kind="op").replace("<>", "!=")
        if op in ("=~", "!~"):
            return Compare(name, op, self.take(kind="re"))
        if op not in ("=", "!=", "<", "<=", ">", ">="):
            raise DialectError(f"unknown operator {op!r}")
        return Compare(name, op, self.value())

    def value(self) -> object:
        minus = self.maybe("-")
        kind, v = self.peek()
        self.i += 1
        if kind == "str" and not minus:
            return v
        if kind == "num":
            number = float(v) if re.search(r"[.eE]", v) else int(v)
            return -number if minus else number
        if kind == "name" and v.lower() in ("true", "false"):
            return v.lower() == "true"
        raise DialectError(f"expected a value, found {v or 'the end'!r}")

    def time_term(self) -> Compare:
        if self.maybe("between"):
            low = self.time()
            self.take("and")
            return Compare("time", "between", (low, self.time()))
        op = self.take(kind="op").replace("<>", "!=")
        if op not in ("=", "!=", "<", "<=", ">", ">="):
            raise DialectError(f"unknown operator {op!r} on time")
        return Compare("time", op, self.time())

    def time(self) -> int:
        out = self.time_part()
        while self.at("+") or self.at("-"):
            sign = 1 if self.take(kind="op") == "+" else -1
            out += sign * duration(self.take(kind="dur"))
        return out

    def time_part(self) -> int:
        if self.maybe("now", "(", ")"):
            import time

            return self.now_ns if self.now_ns is not None else time.time_ns()
        minus = self.maybe("-")
        kind, v = self.peek()
        self.i += 1
        if kind == "str" and not minus:
            return instant(v)
        if kind == "num" and v.isdigit():
            return -int(v) if minus else int(v)
        raise DialectError(f"expected a time, found {v or 'the end'!r}")


def parse(text: str, now_ns: int | None = None) -> Select:
    return Parser(text.strip().rstrip(";"), now_ns).statement()
