"""The engine: measurements, both languages, and the Python calls on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.lang.evaluate import Session
from tidemark.model import Measurement
from tidemark.plans.compiler import compile_select
from tidemark.plans.dialect import parse
from tidemark.sources.store import Store


class Engine:
    """Queries over registered DataFrames and, if there is one, a store."""

    def __init__(self, spark: SparkSession, root: str | None = None, per_series: bool = False):
        self.spark = spark
        self.store = Store(spark, root) if root else None
        self.registered: dict[str, Measurement] = {}
        self.session = Session(spark, self.measurement, per_series)

    def register(self, m: Measurement) -> None:
        self.registered[m.name] = m

    def measurement(self, name: str) -> Measurement | None:
        if name in self.registered:
            return self.registered[name]
        return self.store.measurement(name, merge=True) if self.store else None

    def query(self, text: str, now_ns: int | None = None) -> DataFrame:
        """A SELECT statement as a lazy DataFrame."""
        s = parse(text, now_ns)
        m = self.measurement(s.measurement)
        if m is None:
            raise KeyError(f"no measurement {s.measurement}")
        return compile_select(s, m)

    def eval(self, text: str) -> object:
        """An expression of the array language; names that it sets stay for the next."""
        return self.session.run(text)

    # The Python calls.

    def db_query(self, text: str) -> object:
        return plain(self.eval(text))

    def db_insert(self, measurement: str, fields: dict[str, object], tags: dict[str, str] | None = None, ts_ns: int | None = None) -> None:
        if self.store is None:
            raise ValueError("the engine has no store")
        self.store.insert(measurement, fields, tags, ts_ns)

    def db_measurements(self) -> list[str]:
        return sorted({*self.registered, *(self.store.measurements() if self.store else [])})

    def db_series(self, name: str) -> list[str]:
        m = self.measurement(name)
        return [r[0] for r in m.df.select(m.series_key().alias("series")).distinct().orderBy("series").collect()] if m else []

    def db_fields(self, name: str) -> list[str]:
        m = self.measurement(name)
        return m.fields if m else []


def plain(v: object) -> object:
    """A value as plain Python: tables and dicts as dicts, vectors as lists, times as numbers."""
    from tidemark.lang.values import Builtin, Col, Lambda, Table, Vec, show

    if isinstance(v, Table):
        return {n: [plain(x) for x in c] for n, c in v.local().items()}
    if isinstance(v, Col):
        v = v.local()
    if isinstance(v, Vec):
        return [plain(x) for x in v.items]
    if isinstance(v, list):
        return [plain(x) for x in v]
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    if isinstance(v, (Lambda, Builtin)):
        return show(v)
    if isinstance(v, bool) or v is None:
        return v
    return int(v) if isinstance(v, int) else float(v) if isinstance(v, float) else str(v)
