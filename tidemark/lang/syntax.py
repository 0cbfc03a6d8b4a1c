"""Text of the array language to nested tuples ``(kind, ...)``.

Operators have one precedence and bind to the right: ``2 * 3 + 4`` is ``2 * (3 + 4)``. A one-argument
function before an operand takes all that stands to its right.
"""

from __future__ import annotations

import re
from datetime import UTC, datetime

from tidemark.model import NS

from .values import Dur, LangError, Sym, Ts, Vec

#: Names of the one-argument functions.
MONADIC = set(
    "neg not abs sqrt exp log ceil floor signum reciprocal sum avg mean min max count first last med dev var sums avgs mins maxs prds til rev asc desc distinct"
    " group flip raze where deltas ratios prev next fills ffill bfill type null key value string upper lower trim now log2 log10 sin cos tan asin acos atan round".split()
)
#: Functions called with brackets.
BRACKET = set("mavg msum mmin mmax mdev mcount ema wma xbar pct wavg cor resample asof".split())
DYADIC = {"+", "-", "*", "%", "^", "=", "<>", "<", ">", "<=", ">=", "&", "|", "~", ",", "#", "_", "?", "!"}
WORDS = {"mod", "in", "like"}

_TOKEN = re.compile(
    r"""(?P<ts>\d{4}\.\d\d\.\d\dD\d\d:\d\d(?::\d\d(?:\.\d{1,9})?)?) | (?P<bits>[01]+b\b) | (?P<null>0N[iftu]?\b) | (?P<special>0n\b|0w\b)
    | (?P<dur>\d+(?:ns|us|ms|s|m|h|d|w)\b) | (?P<uint>\d+u\b) | (?P<float>\d+\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+|\.\d+(?:[eE][+-]?\d+)?) | (?P<int>\d+i?\b)
    | (?P<str>"(?:[^"\\]|\\.)*") | (?P<sym>`[A-Za-z0-9_./-]*) | (?P<name>[A-Za-z]\w*) | (?P<op>\|>|':|<>|<=|>=|[-+*%^=<>&|~,\#_?!@:;.$'\\/()\[\]{}])""",
    re.X,
)


def instant(text: str) -> Ts:
    m = re.fullmatch(r"(\d{4})\.(\d\d)\.(\d\d)D(\d\d):(\d\d)(?::(\d\d)(?:\.(\d{1,9}))?)?", text)
    try:
        whole = datetime(*map(int, m.groups("0")[:6]), tzinfo=UTC)
    except ValueError as e:
        raise LangError(f"{text}: {e}") from None
    return Ts(int((whole - datetime(1970, 1, 1, tzinfo=UTC)).total_seconds()) * 10**9 + int((m[7] or "0").ljust(9, "0")))


def tokens(text: str) -> list[tuple[str, object, int]]:
    out, at, spaced = [], 0, True
    while at < len(text):
        if text[at].isspace():
            at, spaced = at + 1, True
            continue
        if text[at] == "/" and spaced:  # a comment to the line's end; right after a value it folds
            at = (text.find("\n", at) + len(text) + 1) % (len(text) + 1)
            continue
        m = _TOKEN.match(text, at)
        if not m:
            line = text.count("\n", 0, at) + 1
            raise LangError(f"unexpected {text[at]!r} at line {line}, col {at - text.rfind(chr(10), 0, at)}")
        kind, raw = m.lastgroup, m[0]
        value: object = raw
        if kind == "ts":
            value = instant(raw)
        elif kind == "bits":
            value = [c == "1" for c in raw[:-1]]
        elif kind == "special":
            kind, value = "float", float("nan") if raw == "0n" else float("inf")
        elif kind == "dur":
            unit = raw.lstrip("0123456789")
            value = Dur(int(raw[: -len(unit)]) * NS[unit])
        elif kind == "float":
            value = float(raw)
        elif kind in ("int", "uint"):
            kind, value = "int", int(raw.rstrip("iu"))
        elif kind == "str":
            value = re.sub(r"\\(.)", lambda e: {"n": "\n", "t": "\t"}.get(e[1], e[1]), raw[1:-1])
        elif kind == "sym":
            value = Sym(raw[1:])
        out.append((kind, value, at))
        at, spaced = m.end(), False
    return out


class Reader:
    def __init__(self, text: str):
        self.text, self.t, self.i = text, tokens(text), 0

    def kind(self, ahead: int = 0) -> str:
        return self.t[self.i + ahead][0] if self.i + ahead < len(self.t) else "end"

    def value(self, ahead: int = 0) -> object:
        return self.t[self.i + ahead][1] if self.i + ahead < len(self.t) else None

    def op(self, *ops: str) -> bool:
        return self.kind() == "op" and self.value() in ops

    def word(self, *words: str) -> bool:
        return self.kind() == "name" and self.value() in words

    def fail(self, what: str) -> LangError:
        at = self.t[self.i][2] if self.i < len(self.t) else len(self.text)
        return LangError(f"{what} at line {self.text.count(chr(10), 0, at) + 1}, col {at - self.text.rfind(chr(10), 0, at)}")

    def expect(self, op: str) -> None:
        if not self.op(op):
            raise self.fail(f"expected {op!r}")
        self.i += 1

    def name(self) -> str:
        if self.kind() != "name":
            raise self.fail("expected a name")
        self.i += 1
        return str(self.t[self.i - 1][1])

    def starts(self) -> bool:
        """Whether an operand can begin here."""
        if self.word("from", "by", "within", "mod", "in", "like"):
            return False
        return self.kind() not in ("end", "op") or self.op("(", "{", "$")

    def program(self) -> object:
        out = self.expression()
        while self.op(";"):
            self.i += 1
            if self.kind() == "end":
                break
            out = ("block", [out, self.expression()])
        if self.kind() != "end":
            raise self.fail(f"unexpected {self.value()!r}")
        return out

    def expression(self) -> object:
        if self.kind() == "name" and self.kind(1) == "op" and self.value(1) == ":":
            name = self.name()
            self.i += 1
            return ("assign", name, self.expression())
        if self.word("select"):
            return self.select()
        out = self.right()
        while self.op("|>"):
            self.i += 1
            out = ("pipe", out, self.right())
        return out

    def right(self) -> object:
        left = self.restricted(self.operand())
        if self.op(*DYADIC) or self.word(*WORDS):
            op = str(self.value())
            self.i += 1
            return ("dyad", op, left, self.right())
        return left

    def restricted(self, left: object) -> object:
        """Tag filters and time ranges after a source."""
        while True:
            if self.op("@"):
                self.i += 1
                left = ("filter", left, self.tags())
            elif self.word("within"):
                self.i += 1
                self.expect("(")
                a = self.right()
                self.expect(";")
                b = self.right()
                self.expect(")")
                left = ("within", left, a, b)
            else:
                return left

    def operand(self) -> object:
        """An atom with what follows it: members, brackets, iterators; or a function's operand."""
        out = self.atom()
        while True:
            if self.op("."):
                self.i += 1
                out = ("member", out, self.name())
            elif self.op("["):
                self.i += 1
                args = []
                while not self.op("]"):
                    args.append(self.right())
                    if not self.op(";"):
                        break
                    self.i += 1
                self.expect("]")
                out = ("call", out, args)
            elif self.op("'", "':", "/", "\\") and self._iterates():
                kind = str(self.value())
                self.i += 1
                out = ("iterate", kind, out, self.operand())
            else:
                break
        if out[0] == "name" and out[1] in MONADIC and self.starts():
            return ("monad", out[1], self.right())
        return out

    def _iterates(self) -> bool:
        self.i += 1
        ok = self.starts()
        self.i -= 1
        return ok

    def run(self, kind: str) -> list:
        out = []
        while self.kind() == kind:
            out.append(self.value())
            self.i += 1
        return out

    def atom(self) -> object:
        kind = self.kind()
        if kind in ("int", "float", "sym"):
            got = self.run(kind)
            return ("value", got[0] if len(got) == 1 else Vec(kind, got))
        if kind == "bits":
            bits = self.value()
            self.i += 1
            return ("value", bits[0] if len(bits) == 1 else Vec("bool", bits))
        if kind in ("str", "ts", "dur"):
            self.i += 1
            return ("value", self.t[self.i - 1][1])
        if kind == "null":
            self.i += 1
            return ("value", None)
        if self.word("true", "false"):
            self.i += 1
            return ("value", self.t[self.i - 1][1] == "true")
        if kind == "name":
            return ("name", self.name())
        if self.op("-"):
            self.i += 1
            return ("monad", "neg", self.operand())
        if self.op("("):
            return self.paren()
        if self.op("{"):
            return self.function()
        if self.op("$", "?") and self.kind(1) == "op" and self.value(1) == "[":
            vector = self.op("?")
            self.i += 2
            parts = [self.expression()]
            while self.op(";"):
                self.i += 1
                parts.append(self.expression())
            self.expect("]")
            if len(parts) < 3 or len(parts) % 2 == 0:
                raise self.fail("a conditional has an odd number of parts, three or more")
            return ("choose" if vector else "cond", parts)
        raise self.fail(f"unexpected {self.value()!r}" if kind != "end" else "unexpected end")

    def paren(self) -> object:
        self.expect("(")
        if self.op("[") and self.kind(1) == "op" and self.value(1) == "]":
            self.i += 2
            cols = []
            while not self.op(")"):
                name = self.name()
                self.expect(":")
                cols.append((name, self.right()))
                if not self.op(";"):
                    break
                self.i += 1
            self.expect(")")
            return ("table", cols)
        if self.op(")"):
            self.i += 1
            return ("list", [])
        items, listed = [self.expression()], False
        while self.op(";"):
            listed = True
            self.i += 1
            if self.op(")"):
                break
            items.append(self.expression())
        self.expect(")")
        return ("list", items) if listed else items[0]

    def function(self) -> object:
        self.expect("{")
        params: list[str] = []
        named = self.op("[")
        if named:
            self.i += 1
            params.append(self.name())
            while self.op(";"):
                self.i += 1
                params.append(self.name())
            self.expect("]")
        body = [self.expression()]
        while self.op(";"):
            self.i += 1
            if self.op("}"):
                break
            body.append(self.expression())
        self.expect("}")
        return ("lambda", params if named else ["x", "y", "z"], body[0] if len(body) == 1 else ("block", body))

    def tags(self) -> object:
        """``&`` and ``|`` have one precedence here and bind to the left."""
        out = self.tag()
        while self.op("&", "|"):
            op = "and" if self.op("&") else "or"
            self.i += 1
            out = (op, out, self.tag())
        return out

    def tag(self) -> object:
        if self.op("("):
            self.i += 1
            out = self.tags()
            self.expect(")")
            return out
        if self.kind() == "sym":
            name = str(self.value())
            self.i += 1
        else:
            name = self.name()
        if not (self.op("=", "<>", "<", ">", "<=", ">=") or self.word("like", "in")):
            raise self.fail("expected a comparison")
        op = str(self.value())
        self.i += 1
        return ("tag", name, op, self.operand())

    def select(self) -> object:
        self.i += 1
        fields = [self.field()]
        while self.op(","):
            self.i += 1
            fields.append(self.field())
        if not self.word("from"):
            raise self.fail("expected 'from'")
        self.i += 1
        source, where, by = self.name(), None, []
        if self.word("where"):
            self.i += 1
            where = self.tags()
        if self.word("by"):
            self.i += 1
            by = [self.right()]
            if by[0][0] == "list":
                by = by[0][1]
        return ("select", fields, source, where, by)

    def field(self) -> tuple[str | None, str, str]:
        """(function, field, name of the result)."""
        first, alias = self.name(), None
        if self.op(":"):
            self.i += 1
            alias, first = first, self.name()
        if self.op("("):
            self.i += 1
            f = self.name()
            self.expect(")")
            return first, f, alias or f"{first}({f})"
        if self.kind() == "name" and not self.word("from"):
            f = self.name()
            return first, f, alias or f"{first}({f})"
        return None, first, alias or first


def parse(text: str) -> object:
    return Reader(text).program()
