"""Results as text, JSON and CSV."""

from __future__ import annotations

import csv
import io
import json
import math

from pyspark.sql import DataFrame

from tidemark.lang.values import Col, Table, Vec, kind_of, show
from tidemark.session import plain


def finite(v: object) -> object:
    """NaN and infinities as null, which JSON has no words for."""
    if isinstance(v, float) and (math.isnan(v) or math.isinf(v)):
        return None
    if isinstance(v, list):
        return [finite(x) for x in v]
    return {k: finite(x) for k, x in v.items()} if isinstance(v, dict) else v


def series_json(name: str, df: DataFrame) -> dict:
    """A statement's result; a value that is missing is null in its column."""
    rows = [[finite(v) for v in r] for r in df.collect()]
    return {"results": [{"series": [{"name": name, "columns": df.columns, "values": rows}]}]}


def value_json(v: object, elapsed_ns: int = 0) -> dict:
    """A value of the array language with its type."""
    kind, out = kind_of(v), finite(plain(v))
    if isinstance(v, Table):
        return {"type": "table", "columns": v.names, "data": out, "elapsed_ns": elapsed_ns}
    if isinstance(v, (Vec, Col, list)):
        return {"type": kind, "values": out, "elapsed_ns": elapsed_ns}
    if isinstance(v, dict):
        return {"type": "dict", "data": out, "elapsed_ns": elapsed_ns}
    return {"type": kind, "value": out, "elapsed_ns": elapsed_ns}


def render(v: object, form: str = "text") -> str:
    if form == "json":
        return json.dumps(value_json(v))
    if form == "csv":
        out = io.StringIO()
        w = csv.writer(out, lineterminator="\n")
        if isinstance(v, Table):
            cols = plain(v)
            w.writerow(v.names)
            w.writerows(zip(*(cols[n] for n in v.names), strict=True))
        elif isinstance(v, dict):
            w.writerows(plain(v).items())
        else:
            p = plain(v)
            w.writerows([x] for x in (p if isinstance(p, list) else [p]))
        return out.getvalue().rstrip("\n")
    return show(v)
