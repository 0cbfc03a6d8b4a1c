"""A store's log: numbered files, each a change that is there as a whole or not at all."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.sql import SparkSession

_LOCKS: dict[str, threading.RLock] = {}


@dataclass
class State:
    """What the log says up to a version: the measurements' names and types, and their folders.

    ``folders`` maps a folder to its measurement, hour, number of rows, and whether it has one row a
    series and time; ``streams`` maps a stream to its last batch."""

    version: int = 0
    catalog: dict[str, dict] = field(default_factory=dict)
    folders: dict[str, dict] = field(default_factory=dict)
    streams: dict[str, int] = field(default_factory=dict)

    def apply(self, change: dict) -> None:
        for name, spec in change.get("catalog", {}).items():
            self.catalog[name] = spec
        for path in change.get("remove", []):
            self.folders.pop(path, None)
        self.folders.update(change.get("add", {}))
        self.streams.update(change.get("streams", {}))
        self.version += 1

    def of(self, name: str) -> dict[str, dict]:
        return {p: f for p, f in self.folders.items() if f["measurement"] == name}


class Conflict(RuntimeError):
    """A change that no longer fits what the log says."""


class Log:
    """The log in ``root``/log, through Spark's own file systems.

    A change is written aside and then renamed to the next number, which must not be there yet:
    of two writers one gets the number, and the other looks at the new state and tries again.
    That needs a file system whose rename doesn't replace (as HDFS); writers of one process also
    share a lock. Every EVERY changes the whole state is saved, so that readers start there."""

    EVERY = 50

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self.dir = f"{root}/log"
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(self._conf)
        self._lock = _LOCKS.setdefault(self.dir, threading.RLock())
        self._state = State()

    def path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def _read(self, name: str) -> dict | None:
        p = self.path(f"{self.dir}/{name}")
        if not self.fs.exists(p):
            return None
        stream = self.fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _put(self, name: str, value: dict) -> bool:
        """Whether ``name`` is now there with this value, and wasn't before."""
        aside, final = self.path(f"{self.dir}/aside-{uuid.uuid4().hex}"), self.path(f"{self.dir}/{name}")
        out = self.fs.create(aside, True)
        try:
            out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        finally:
            out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf)
        options = SparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(aside, final, options)
        except Py4JJavaError as e:
            self.fs.delete(aside, False)
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def state(self) -> State:
        """The state as of now."""
        with self._lock:
            if not self._state.version:
                names = [s.getPath().getName() for s in self.fs.listStatus(self.path(self.dir))] if self.fs.exists(self.path(self.dir)) else []
                saved = sorted(n for n in names if n.startswith("state-"))
                if saved and (whole := self._read(saved[-1])):
                    self._state = State(**whole)
            while (change := self._read(f"{self._state.version + 1:012d}")) is not None:
                self._state.apply(change)
            s = self._state
            return State(s.version, {k: json.loads(json.dumps(v)) for k, v in s.catalog.items()}, dict(s.folders), dict(s.streams))

    def commit(self, change: Callable[[State], dict | None]) -> bool:
        """Add what ``change`` makes of the state, made anew if another change came first. No change
        (None) commits nothing. Returns whether there was one."""
        while True:
            with self._lock:
                state = self.state()
                made = change(state)
                if made is None:
                    return False
                gone = [p for p in made.get("remove", []) if p not in state.folders]
                if gone:
                    raise Conflict(f"{gone[0]} is no longer there")
                if self._put(f"{state.version + 1:012d}", made):
                    state = self.state()
                    if state.version % self.EVERY == 0:
                        self._put(f"state-{state.version:012d}", vars(state))
                    return True
