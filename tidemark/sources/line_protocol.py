"""Line protocol: ``measurement,tag=v field=1.5,other=2i 1700000000000000000``, in SQL functions.

A text table becomes one parsed table without Python. Quotes keep blanks and commas of field values:
what is between them is masked before a line's fields are split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the kinds of field literals, by pattern, the first that matches.
LITERALS = [
    ("string", r'(?s)^".*"$'),
    ("boolean", r"^(t|T|true|TRUE|f|F|false|FALSE)$"),
    ("long", r"^[+-]?\d+i$"),
    ("decimal", r"^\+?\d+u$"),
    ("double", r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))$"),
]
TRUE = ["t", "T", "true", "TRUE"]
GREATEST_U64 = "18446744073709551615"
#: Names that a store's own columns have.
RESERVED = ("ts_ns", "__seq", "__line", "__hour", "__batch")


def _after(text: Column, at: Column) -> Column:
    return F.substr(text, at + 1)


#: What blanks and commas between quotes are meanwhile; the first keeps the marks themselves apart.
_MASKS = (("\u0001", "\u0001\u0003"), (" ", "\u0001\u0004"), (",", "\u0001\u0005"))


def _masked(text: Column) -> Column:
    def mask(x: Column) -> Column:
        for a, b in _MASKS:
            x = F.replace(x, F.lit(a), F.lit(b))
        return x

    parts = F.transform(F.split(text, '"'), lambda x, i: F.when(i % 2 == 1, mask(x)).otherwise(x))
    return F.when(F.contains(text, F.lit('"')), F.array_join(parts, '"')).otherwise(text)


def _unmasked(text: Column) -> Column:
    out = text
    for a, b in reversed(_MASKS):
        out = F.replace(out, F.lit(b), F.lit(a))
    return F.when(F.contains(text, F.lit("\u0001")), out).otherwise(text)


def _pairs(text: Column) -> Column:
    """``a=1,b="x,y"`` as an array of (k, v); of a part without a name, or without =, k is null."""

    def pair(p: Column) -> Column:
        at = F.instr(p, "=")
        return F.struct(F.when(at > 1, F.substr(p, F.lit(1), at - 1)).alias("k"), _unmasked(_after(p, at)).alias("v"))

    return F.transform(F.split(text, ","), pair)


def _last(pairs: Column) -> Column:
    """Of pairs with one name, the last."""
    names = F.transform(pairs, lambda p: p["k"])
    later = lambda p, i: F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"])
    return F.when(F.size(F.array_distinct(names)) == F.size(pairs), pairs).otherwise(F.filter(pairs, lambda p, i: ~later(p, i)))


def kind_of(v: Column) -> Column:
    """The kind of a field's literal; null where it has none or is out of its type's range."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(LITERALS):
        ok = v.rlike(pattern)
        if kind == "string":
            ok = ok & (F.length(v) >= 2)
        if kind == "long":
            ok = ok & F.regexp_replace(v, "i$", "").try_cast("bigint").isNotNull()
        if kind == "decimal":
            ok = ok & (F.regexp_replace(v, "u$", "").try_cast("decimal(38,0)") <= F.lit(GREATEST_U64).cast("decimal(20,0)"))
        out = F.when(ok, F.lit(kind)).otherwise(out)
    return out


def parse(lines: DataFrame, text: str = "value", now_ns: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """(line, measurement, tags map, fields array of (k, kind, v), ts_ns, error), and ``keep``.

    Blank lines and those that begin with # are left out. A time of 0 or none is ``now_ns`` (or the
    present). Of tags or fields with one name the last counts. A line that isn't well formed has an
    error and nulls: no measurement, no fields, a pair without a name or without =, a field's value
    of no type or out of its range, a time that is no 64-bit number. No line fails a batch.
    """
    body = F.regexp_replace(F.col(f"`{text}`"), r"^\s+|\s+$", "")
    rows = lines.select(body.alias("line"), *(keep or [])).filter("line is not null and line <> '' and not startswith(line, '#')")
    blank = F.instr("line", " ")
    head = F.when(blank > 0, F.substr(F.col("line"), F.lit(1), blank - 1)).otherwise(F.col("line"))
    parts = rows.select("line", *(keep or []), head.alias("head"), F.when(blank > 0, _masked(_after(F.col("line"), blank))).alias("rest"))
    comma, space = F.instr("head", ","), F.instr("rest", " ")
    parts = parts.select(
        "line", *(keep or []),
        F.when(comma > 0, F.substr(F.col("head"), F.lit(1), comma - 1)).otherwise(F.col("head")).alias("m"),
        F.when(comma > 0, _pairs(_after(F.col("head"), comma))).otherwise(F.array().cast("array<struct<k:string,v:string>>")).alias("t"),
        _pairs(F.when(space > 0, F.substr(F.col("rest"), F.lit(1), space - 1)).otherwise(F.col("rest"))).alias("p"),
        F.when(space > 0, F.trim(_after(F.col("rest"), space))).otherwise(F.lit("")).alias("stamp"),
    )
    typed = F.transform(_last(F.col("p")), lambda f: F.struct(f["k"].alias("k"), kind_of(f["v"]).alias("kind"), f["v"].alias("v")))
    stamp = F.when(F.col("stamp").rlike(r"^[+-]?\d+$"), F.col("stamp").try_cast("bigint"))
    no = lambda name: F.exists(name, lambda p: p["k"].isNull())
    error = (
        F.when(F.col("m") == "", "no measurement").when(F.col("p").isNull(), "no fields").when(no("t"), "a tag without a name or a value").when(no("p"), "a field without a name or a value")
        .when(F.exists("typed", lambda f: f["kind"].isNull()), "a field's value has no type").when((F.col("stamp") != "") & F.col("time").isNull(), "a time that is no number")
    )
    out = parts.withColumn("typed", typed).withColumn("time", stamp).withColumn("error", error)
    now = F.lit(now_ns).cast("long") if now_ns is not None else F.unix_micros(F.current_timestamp()) * 1000
    well = F.col("error").isNull()
    return out.select(
        "line", F.when(well, F.col("m")).alias("measurement"), F.when(well, F.map_from_entries(_last(F.col("t")))).alias("tags"), F.when(well, F.col("typed")).alias("fields"),
        F.when(well, F.when(F.coalesce("time", F.lit(0)) == 0, now).otherwise(F.col("time"))).alias("ts_ns"), "error", *(keep or []),
    )


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def measurement_rows(parsed: DataFrame, name: str, tags: list[str], fields: dict[str, str], keep: list[str] | None = None) -> DataFrame:
    """One measurement's rows in wide form: ts_ns, its tags, its fields by their types, ``keep``."""
    own = parsed.filter((F.col("measurement") == name) & F.col("error").isNull())
    found = lambda k: F.get(F.filter("fields", lambda f: f["k"] == k), F.lit(0))["v"]
    cols = []
    for k, kind in fields.items():
        v = found(k)
        if kind == "boolean":
            cols.append(v.isin(*TRUE).alias(k))
        elif kind == "string":
            cols.append(F.substr(v, F.lit(2), F.length(v) - 2).alias(k))
        elif kind == "double":
            cols.append(F.when(F.lower(v).endswith("nan"), F.lit(float("nan"))).otherwise(v.try_cast("double")).alias(k))
        else:
            cols.append(F.regexp_replace(v, "[iu]$", "").try_cast("bigint" if kind == "long" else "decimal(20,0)").alias(k))
    return own.select("ts_ns", *(F.col("tags")[t].alias(t) for t in tags), *cols, *(keep or []))


def shapes(parsed: DataFrame) -> list[tuple[str, list[str], dict[str, list[str]]]]:
    """(measurement, tags, kinds of each field) of a batch, fields and kinds by their first lines: as many
    rows as there are measurements and names, gathered by grouped aggregates."""
    good = parsed.filter("error is null")
    tags = {r[0]: sorted(r[1]) for r in good.select("measurement", F.explode(F.map_keys("tags")).alias("k")).groupBy("measurement").agg(F.collect_set("k")).collect()}
    first = "__line" if "__line" in parsed.columns else "line"
    each = good.select("measurement", first, F.explode("fields").alias("f")).groupBy("measurement", "f.k", "f.kind").agg(F.min(first).alias("first"))
    kinds = each.groupBy("measurement", "k").agg(F.array_sort(F.collect_list(F.struct("first", "kind"))).alias("kinds")).collect()
    out: dict[str, dict[str, list[str]]] = {}
    for r in sorted(kinds, key=lambda r: (r["kinds"][0]["first"], r["k"])):
        out.setdefault(r["measurement"], {})[r["k"]] = [x["kind"] for x in r["kinds"]]
    return [(m, tags.get(m, []), f) for m, f in sorted(out.items())]
