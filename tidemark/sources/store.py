"""A durable store: Parquet laid out by hour, and a log that says which folders count."""

from __future__ import annotations

import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import calendar
from tidemark.model import Measurement, hour_name

from . import line_protocol
from .line_protocol import RESERVED, quoted
from .log import Conflict, Log, State

TYPES = {"double": "double", "long": "bigint", "decimal": "decimal(20,0)", "boolean": "boolean", "string": "string"}
KINDS = {v: k for k, v in TYPES.items()} | {"int": "long", "float": "double"}
#: Measurements of a batch that are written at once.
WRITERS = 8


class SchemaError(ValueError):
    """A field comes with another type than it has."""


class Store:
    """Measurements in a folder that all executors reach, through Spark's own file systems.

    A write adds folders, and then names them all in one change of the log: a batch of any number of
    measurements is there as a whole or not at all, and readers see a version of the log. ``__seq``
    and ``__line`` order writes and the lines of one, so that reads merge points of one series and
    time field by field, the last write winning. Files that no change names are never read.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = Log(spark, self.root)

    # The catalog: tags and field types by measurement.

    def catalog(self) -> dict[str, dict]:
        return self.log.state().catalog

    def measurements(self) -> list[str]:
        return sorted(self.catalog())

    def fields(self, name: str) -> list[str]:
        return sorted(self.catalog().get(name, {}).get("fields", {}))

    def series(self, name: str) -> DataFrame:
        """(series, and the tags) of a measurement: every series key that it has, once."""
        m = self.measurement(name)
        if m is None:
            return self.spark.createDataFrame([], "series string")
        tags = [F.col(quoted(t)) for t in m.tags]
        return m.df.select(m.series_key().alias("series"), *tags).distinct()

    def status(self) -> dict[str, int]:
        """Counts of measurements, fields, series and points. Points are counted from the log; those
        of one series and time that haven't been merged yet count each."""
        state = self.log.state()
        series = sum(self.series(name).count() for name in state.catalog)
        points = sum(f["rows"] for f in state.folders.values())
        return {"measurements": len(state.catalog), "fields": sum(len(c["fields"]) for c in state.catalog.values()), "series": series, "points": points}

    # Writing.

    @staticmethod
    def _grown(catalog: dict[str, dict], name: str, tags: list[str], fields: dict[str, str]) -> dict:
        """The measurement's entry with new tags and fields; a known field keeps its type, a name is
        a tag or a field, and names differ by more than letter case, or nothing is written."""
        known = catalog.get(name, {"tags": [], "fields": {}})
        types = dict(known["fields"])
        for f, kind in fields.items():
            if types.setdefault(f, kind) != kind:
                raise SchemaError(f"{name}.{f} is {types[f]}, not {kind}")
        all_tags = sorted({*known["tags"], *tags})
        for n in (*all_tags, *types):
            if n.lower() in RESERVED:
                raise SchemaError(f"{name}.{n} is a name that the store needs")
        if both := set(all_tags) & set(types):
            raise SchemaError(f"{name}.{sorted(both)[0]} is both tag and field")
        if len({n.lower() for n in (*all_tags, *types)}) < len(all_tags) + len(types):
            raise SchemaError(f"{name} has names that only letter case tells apart")
        return {"tags": all_tags, "fields": types}

    def _base(self, name: str) -> str:
        return f"{self.root}/data/m-{quote(name, safe='').replace('.', '%2E')}"

    def _put(self, name: str, df: DataFrame, batch: str, merged: bool = False) -> dict[str, dict]:
        """Write rows with __seq and __line; returns the new folders, which don't count yet. Hours are
        rebalanced by size, so that a large one is several tasks' and files' work."""
        out = df.withColumn("__hour", calendar.hour_name(F.col("ts_ns"))).hint("rebalance", "__hour")
        path = f"{self._base(name)}/__batch={batch}"
        out.sortWithinPartitions("__hour", "ts_ns").write.partitionBy("__hour").parquet(path)
        rows = {r["__hour"]: r["n"] for r in self.spark.read.schema("__hour string").parquet(path).groupBy("__hour").agg(F.count("*").alias("n")).collect()}  # a row an hour, from the files' own counts
        return {f"{path}/__hour={hour}": {"measurement": name, "hour": hour, "rows": n, "merged": merged} for hour, n in rows.items()}

    def append(self, name: str, df: DataFrame, tags: list[str]) -> None:
        """Rows with ts_ns, the tags, and fields in all other columns."""
        fields = {c: KINDS[t] for c, t in df.dtypes if c != "ts_ns" and c not in tags}
        self._grown(self.catalog(), name, tags, fields)
        numbered = df.withColumn("__seq", F.lit(time.time_ns())).withColumn("__line", F.monotonically_increasing_id())
        add = self._put(name, numbered, uuid.uuid4().hex)
        self.log.commit(lambda s: {"catalog": {name: self._grown(s.catalog, name, tags, fields)}, "add": add})

    def write_lines(self, lines: DataFrame | list[str], now_ns: int | None = None, skip_bad: bool = False, stream: tuple[str, int] | None = None) -> int:
        """Line protocol, all or nothing; with ``skip_bad`` bad lines, and those whose fields' types
        aren't those known (or of the first line that has the field), are left out. Returns how many
        lines were left out. ``stream`` names a stream's batch by its number; one that the log has
        isn't written again.

        Lines are parsed once, into the shared folder by measurement; each measurement's rows are
        then read from there."""
        if stream and self.log.state().streams.get(stream[0], -1) >= stream[1]:
            return 0
        if isinstance(lines, list):
            lines = self.spark.createDataFrame(list(enumerate(lines)), "__line bigint, value string")
        else:
            lines = lines.withColumn("__line", F.monotonically_increasing_id())
        batch = uuid.uuid4().hex
        staged = f"{self.root}/staged/{batch}"
        now = now_ns if now_ns is not None else time.time_ns()
        parsed = line_protocol.parse(lines, now_ns=now, keep=["__line"])
        try:
            parsed.withColumn("__m", F.md5("measurement")).write.partitionBy("__m").parquet(staged)
            parsed = self.spark.read.schema(parsed.withColumn("__m", F.lit("")).schema).parquet(staged)
            return self._write_parsed(parsed, batch, skip_bad, stream)
        finally:
            self.log.fs.delete(self.log.path(staged), True)

    def _write_parsed(self, parsed: DataFrame, batch: str, skip_bad: bool, stream: tuple[str, int] | None) -> int:
        bad = parsed.filter("error is not null")
        n = bad.count()
        if n and not skip_bad:
            first = bad.orderBy("__line").first()
            raise ValueError(f"{n} bad lines; the first: {first['error']}: {first['line']}")
        shapes = line_protocol.shapes(parsed)
        if skip_bad:
            good = self._fitting(parsed, shapes)
            if good is not parsed:
                n += parsed.filter("error is null").count() - good.filter("error is null").count()
                parsed, shapes = good, line_protocol.shapes(good)
        for name, _, kinds in shapes:
            for f, k in kinds.items():
                if len(k) > 1:
                    raise SchemaError(f"{name}.{f} is {' and '.join(k)}")
        fields = {name: {f: k[0] for f, k in kinds.items()} for name, _, kinds in shapes}

        def grown(s: State) -> dict[str, dict]:
            return {name: self._grown(s.catalog, name, tags, fields[name]) for name, tags, _ in shapes}

        grown(self.log.state())
        seq = F.lit(time.time_ns()).alias("__seq")

        def put(shape: tuple) -> dict[str, dict]:
            name, tags, _ = shape
            own = parsed.filter(F.col("__m") == F.md5(F.lit(name)))
            rows = line_protocol.measurement_rows(own, name, tags, fields[name], ["__line"])
            return self._put(name, rows.select("*", seq), batch)

        with ThreadPoolExecutor(WRITERS) as pool:
            add = {p: f for made in pool.map(put, shapes) for p, f in made.items()}

        def change(s: State) -> dict | None:
            if stream and s.streams.get(stream[0], -1) >= stream[1]:
                return None
            if not add and not stream:
                return None
            return {"catalog": grown(s), "add": add, "streams": {stream[0]: stream[1]} if stream else {}}

        self.log.commit(change)
        return n

    def _fitting(self, parsed: DataFrame, shapes: list) -> DataFrame:
        """Lines without those whose fields or tags don't fit the catalog or the batch's first line."""
        catalog = self.catalog()
        wrong_kinds, wrong_tags = [], []
        for name, tags, kinds in shapes:
            known = catalog.get(name, {"tags": [], "fields": {}})
            taken = {t.lower(): t for t in known["tags"]}
            types = {}
            for f in sorted(kinds, key=lambda f: f not in known["fields"]):  # the known first, then by first lines
                same = {x.lower() for x in (*known["tags"], *known["fields"], *types) if x != f}
                want = known["fields"].get(f, kinds[f][0])
                clash = f.lower() in RESERVED or f.lower() in same
                wrong_kinds += [(name, f, k) for k in kinds[f] if clash or k != want]
                if not clash:
                    types[f] = want
            for t in tags:
                names = {x.lower() for x in (*known["fields"], *types)}
                if t.lower() in RESERVED or t.lower() in names or taken.setdefault(t.lower(), t) != t:
                    wrong_tags.append((name, t))
        if not wrong_kinds and not wrong_tags:
            return parsed
        sep = "\u0001"
        kinds_ = F.array(*(F.lit(sep.join(x)) for x in wrong_kinds)).cast("array<string>")
        tags_ = F.array(*(F.lit(sep.join(x)) for x in wrong_tags)).cast("array<string>")
        hit = F.exists("fields", lambda f: F.array_contains(kinds_, F.concat_ws(sep, "measurement", f["k"], f["kind"])))
        hit = hit | F.exists(F.map_keys("tags"), lambda t: F.array_contains(tags_, F.concat_ws(sep, F.col("measurement"), t)))
        return parsed.filter(F.col("error").isNotNull() | ~hit)

    def insert(self, name: str, fields: dict[str, object], tags: dict[str, str] | None = None, ts_ns: int | None = None) -> None:
        tags = tags or {}
        kinds = {k: "boolean" if isinstance(v, bool) else "bigint" if isinstance(v, int) else "double" if isinstance(v, float) else "string" for k, v in fields.items()}
        ddl = ", ".join(["ts_ns bigint", *(f"{quoted(t)} string" for t in tags), *(f"{quoted(f)} {k}" for f, k in kinds.items())])
        row = (ts_ns if ts_ns is not None else time.time_ns(), *map(str, tags.values()), *fields.values())
        self.append(name, self.spark.createDataFrame([row], ddl), list(tags))

    # Reading.

    def _raw(self, name: str, spec: dict, paths: list[str]) -> DataFrame:
        ddl = ", ".join(["ts_ns bigint", *(f"{quoted(t)} string" for t in spec["tags"]), *(f"{quoted(f)} {TYPES[k]}" for f, k in spec["fields"].items()), "__seq bigint", "__line bigint", "__hour string"])
        if not paths:
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).option("basePath", self._base(name)).parquet(*sorted(paths)).drop("__batch")

    def measurement(self, name: str, merge: bool = False) -> Measurement | None:
        """A measurement as written, or with ``merge`` one row a series and time. Hours that hold one
        compacted folder are so already; only the others are grouped."""
        state = self.log.state()
        spec = state.catalog.get(name)
        if spec is None:
            return None
        folders = state.of(name)
        if not merge:
            return Measurement(name, self._raw(name, spec, list(folders)), spec["tags"], list(spec["fields"]), ["__seq", "__line"], "__hour")
        times: dict[str, int] = {}
        for f in folders.values():
            times[f["hour"]] = times.get(f["hour"], 0) + 1
        done = [p for p, f in folders.items() if f["merged"] and times[f["hour"]] == 1]
        rest = [p for p in folders if p not in set(done)]
        df = self._merged(self._raw(name, spec, rest), spec)
        if done:
            whole = self._raw(name, spec, done).select(*(F.col(quoted(c)) for c in df.columns))
            df = whole.unionByName(df) if rest else whole
        return Measurement(name, df, spec["tags"], list(spec["fields"]), ["__seq", "__line"], "__hour")

    def _merged(self, df: DataFrame, spec: dict) -> DataFrame:
        order = F.struct("__seq", "__line")
        latest = [F.max_by(F.col(quoted(f)), F.when(F.col(quoted(f)).isNotNull(), order)).alias(f) for f in spec["fields"]]
        keys = ["__hour", "ts_ns", *(F.col(quoted(t)) for t in spec["tags"])]
        grouped = df.groupBy(*keys).agg(*latest, F.max(order).alias("__order"))
        return grouped.select(*(F.col(quoted(c)) for c in grouped.columns if c != "__order"), F.col("__order.__seq").alias("__seq"), F.col("__order.__line").alias("__line"))

    # Maintenance.

    def compact(self, name: str, hours: list[str] | None = None) -> int:
        """Rewrite hours that have several folders, or one that isn't merged: one row a series and
        time, sorted. The log changes over from the old folders to the new at once, and folders that
        came meanwhile stay. Old files stay for readers until ``vacuum``. Returns how many hours
        were rewritten; 0 where another round got there first."""
        state = self.log.state()
        spec = state.catalog[name]
        by_hour: dict[str, list[str]] = {}
        for p, f in state.of(name).items():
            by_hour.setdefault(f["hour"], []).append(p)
        todo = {h: ps for h, ps in by_hour.items() if (hours is None or h in hours) and (len(ps) > 1 or not state.folders[ps[0]]["merged"])}
        if not todo:
            return 0
        old = [p for ps in todo.values() for p in ps]
        merged = self._merged(self._raw(name, spec, old), spec).drop("__hour")
        add = self._put(name, merged, uuid.uuid4().hex, merged=True)
        try:
            self.log.commit(lambda s: {"add": add, "remove": old})
        except Conflict:
            return 0
        return len(todo)

    def retain(self, seconds: int, now_ns: int | None = None) -> list[str]:
        """Drop the hours that lie wholly before ``seconds`` ago; returns their names."""
        last = hour_name((now_ns if now_ns is not None else time.time_ns()) - seconds * 10**9)
        dropped: set[str] = set()

        def change(s: State) -> dict | None:
            old = {p: f for p, f in s.folders.items() if f["hour"] < last}
            dropped.clear()
            dropped.update(f"{f['measurement']}/{f['hour']}" for f in old.values())
            return {"remove": list(old)} if old else None

        self.log.commit(change)
        return sorted(dropped)

    def vacuum(self, older_than_seconds: float = 86_400) -> int:
        """Delete folders of hours that the log doesn't name and that haven't changed for so long:
        those replaced, dropped, or left by writes that failed. Returns how many."""
        live = {tuple(p.split("/")[-3:]) for p in self.log.state().folders}
        fs, before, n = self.log.fs, (time.time() - older_than_seconds) * 1000, 0
        base = self.log.path(f"{self.root}/data")
        for m in fs.listStatus(base) if fs.exists(base) else []:
            for batch in fs.listStatus(m.getPath()):
                for hour in fs.listStatus(batch.getPath()) if batch.isDirectory() else []:
                    name = (m.getPath().getName(), batch.getPath().getName(), hour.getPath().getName())
                    if hour.isDirectory() and name not in live and hour.getModificationTime() < before:
                        n += fs.delete(hour.getPath(), True)
        return n

    def maintain(self, retention_seconds: int | None = None) -> dict[str, int]:
        """One round of upkeep: compact every measurement, drop what is too old, and delete files
        that haven't counted for a day."""
        compacted = sum(self.compact(name) for name in self.measurements())
        dropped = len(self.retain(retention_seconds)) if retention_seconds else 0
        return {"compacted": compacted, "dropped": dropped, "deleted": self.vacuum()}

    def keep_up(self, stop, every_seconds: float = 60, retention_seconds: int | None = None) -> None:
        """Upkeep every ``every_seconds`` until the event ``stop`` is set."""
        while not stop.wait(every_seconds):
            self.maintain(retention_seconds)
