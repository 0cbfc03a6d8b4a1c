"""Continuous ingestion and live queries, by Structured Streaming."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.numeric import bucket
from tidemark.sources.store import Store


def lines_from(spark: SparkSession, folder: str, most_files: int = 1000) -> DataFrame:
    """New text files of a folder as they come."""
    return spark.readStream.option("maxFilesPerTrigger", most_files).text(folder)


def ingest(lines: DataFrame, store: Store, checkpoint: str, once: bool = False, every: str = "5 seconds") -> StreamingQuery:
    """Append line protocol to the store batch by batch; bad lines are left out, whatever is wrong
    with them. With ``once`` what is there is taken in and the query ends. The store's log keeps each
    batch's number, so that one done again after a failure isn't written again."""

    def put(batch: DataFrame, number: int) -> None:
        store.write_lines(batch, skip_bad=True, stream=(checkpoint, number))

    writer = lines.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def bucketed(stream: DataFrame, width_ns: int, tags: list[str], value: str, late: str = "1 hour") -> DataFrame:
    """Running count, sum, mean, min and max by time bucket and tags of a stream with ts_ns; state
    of buckets that the watermark has passed is dropped."""
    timed = stream.withColumn("__ts", F.timestamp_micros(F.call_function("div", F.col("ts_ns"), F.lit(1000)))).withWatermark("__ts", late)
    w = F.window("__ts", f"{width_ns // 1000} microseconds")
    x = F.col(value).cast("double")
    g = timed.groupBy(w, *tags).agg(F.count(x).alias("count"), F.sum(x).alias("sum"), F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"))
    return g.select(bucket(F.unix_micros("window.start") * 1000, width_ns).alias("time"), *tags, "count", "sum", "mean", "min", "max")


class Subscriptions:
    """Queries that are run again and again; ``push`` gets (id, JSON text) when a result changes,
    and errors too, after which polling goes on. A new subscription of an id replaces the old."""

    LEAST_MS, USUAL_MS = 100, 1000

    def __init__(self, run: Callable[[str], object], push: Callable[[str, str], None]):
        self.run, self.push = run, push
        self.stops: dict[str, threading.Event] = {}
        self.lock = threading.Lock()

    def subscribe(self, id_: str, query: str, interval_ms: int | None = None) -> None:
        stop = threading.Event()
        with self.lock:
            if (old := self.stops.pop(id_, None)) is not None:
                old.set()
            self.stops[id_] = stop
        wait = max(self.LEAST_MS, interval_ms or self.USUAL_MS) / 1000
        threading.Thread(target=self._poll, args=(id_, query, wait, stop), daemon=True).start()

    def _poll(self, id_: str, query: str, wait: float, stop: threading.Event) -> None:
        last = None
        while not stop.is_set():
            try:
                text = json.dumps(self.run(query), sort_keys=True)
            except Exception as e:  # what a query raises is the subscriber's to see
                text = json.dumps({"error": str(e)})
            if text != last and not stop.is_set():
                self.push(id_, text)
                last = text
            stop.wait(wait)

    def unsubscribe(self, id_: str) -> bool:
        with self.lock:
            stop = self.stops.pop(id_, None)
        if stop is not None:
            stop.set()
        return stop is not None

    def close(self) -> None:
        for id_ in list(self.stops):
            self.unsubscribe(id_)
