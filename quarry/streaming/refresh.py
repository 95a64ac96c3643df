"""Keeping an index fresh: change events, bursts, debounced refreshes."""

from __future__ import annotations

import logging
import os
import threading
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quarry.schema import FILE_EVENT
from quarry.scratch import scratch_root, staged
from quarry.sources.tree import source_paths

GAP = timedelta(seconds=5)
#: Events of a range of time, about.
ROWS = 1 << 18
RELEVANT = ("create", "write", "remove", "rename")


def _sessions(events: DataFrame, keys: list[str], ts: str, gap: timedelta) -> DataFrame:
    # sessions that touch are one, and an event a full gap later is not of the burst
    window = F.session_window(F.col(ts), f"{gap // timedelta(microseconds=1) - 1} microseconds")
    out = events.groupBy(*keys, window.alias("w")).agg(F.count(F.lit(1)).alias("n_events"), F.max(ts).alias("burst_end"))
    return out.select(*keys, F.col("w.start").alias("burst_start"), "burst_end", "n_events")


def bursts(events: DataFrame, keys: list[str], ts: str = "ts", gap: timedelta = GAP, rows: int = ROWS) -> DataFrame:
    """Bursts of events less than gap apart: keys, burst_start, burst_end (of its last event), n_events.

    A table of more than the given number of rows is cut into ranges of time, so that events of one key spread over
    tasks. Only the first and the last burst of a range can go on in another one: these few meet per key.
    """
    parts = 1 if events.isStreaming else -(-events.count() // rows)
    if parts <= 1:
        return _sessions(events, keys, ts, gap)
    dealt = events.select(*keys, ts).where(F.col(ts).isNotNull()).repartitionByRange(parts, *keys, ts).withColumn("__part", F.spark_partition_id())
    # ranges are drawn from a sample and may differ in another run, so they are fixed here
    local = staged(_sessions(dealt, [*keys, "__part"], ts, gap), "bursts")
    start, within, along = F.col("burst_start"), Window.partitionBy(*keys, "__part"), Window.partitionBy(*keys).orderBy("burst_start")
    local = local.withColumn("__edge", (start == F.min(start).over(within)) | (start == F.max(start).over(within)))
    fresh = F.coalesce(start >= F.lag("burst_end").over(along) + F.lit(gap), F.lit(True)).cast("int")
    edges = local.where("__edge").withColumn("__fresh", fresh).withColumn("__burst", F.sum("__fresh").over(along))
    joined = edges.groupBy(*keys, "__burst").agg(F.min(start).alias("burst_start"), F.max("burst_end").alias("burst_end"), F.sum("n_events").alias("n_events"))
    names = [*keys, "burst_start", "burst_end", "n_events"]
    return local.where(~F.col("__edge")).select(names).unionByName(joined.select(names))


def relevant(events: DataFrame, op: str = "op") -> DataFrame:
    """Events that can change a file's content or existence."""
    return events.where(F.col(op).isin(*RELEVANT))


def streamed_bursts(events: DataFrame, keys: list[str], late: str = "0 seconds") -> DataFrame:
    """bursts() of a stream with its relevant events; a burst comes out when a later event has moved the watermark."""
    return bursts(relevant(events).withWatermark("ts", late), keys)


class _TreeReader(SimpleDataSourceStreamReader):
    def __init__(self, root: str):
        self.root = root

    def _state(self) -> dict[str, list[int]]:
        found = {}
        for path in source_paths(self.root):
            stat = os.stat(path)
            found[path] = [stat.st_mtime_ns, stat.st_size]
        return found

    def initialOffset(self) -> dict:
        return {"files": self._state()}

    def _events(self, before: dict, after: dict) -> Iterator[tuple]:
        now = datetime.now(timezone.utc)
        for path in sorted({*before, *after}):
            if before.get(path) != after.get(path):
                op = "create" if path not in before else "remove" if path not in after else "write"
                yield path, op, now

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        state = self._state()
        return iter(list(self._events(start["files"], state))), {"files": state}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(list(self._events(start["files"], end["files"])))

    def commit(self, end: dict) -> None:
        pass


class TreeEvents(DataSource):
    """Streaming source `quarry_tree`: created, written and removed source files below the option `path`.

    It compares listings, so folders that appear later are covered and deletions are events.
    """

    @classmethod
    def name(cls) -> str:
        return "quarry_tree"

    def schema(self) -> StructType:
        return FILE_EVENT

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _TreeReader(self.options["path"])


class Debounce:
    """Runs an action once its calls have ceased for a gap: every call starts the wait anew, and runs never overlap."""

    def __init__(self, action: Callable[[], object], gap: timedelta = GAP):
        self.action, self.gap = action, gap
        self._state, self._running = threading.Lock(), threading.Lock()
        self._timer: threading.Timer | None = None
        self._stopped = False

    def __call__(self) -> None:
        with self._state:
            if self._timer is not None:
                self._timer.cancel()
            if not self._stopped:
                self._timer = threading.Timer(self.gap.total_seconds(), self._run)
                self._timer.daemon = True
                self._timer.start()

    def _run(self) -> None:
        with self._running:
            if self._stopped:
                return
            try:
                self.action()
            except Exception as error:  # the next change tries again
                logging.getLogger("quarry").error("refresh failed: %s", error)

    def stop(self) -> None:
        """Drop a waiting run, and wait for one that has begun."""
        with self._state:
            self._stopped = True
            if self._timer is not None:
                self._timer.cancel()
        with self._running:
            pass


@dataclass
class Watch:
    """A running stream of changes and its debounced refresh."""

    query: StreamingQuery
    debounce: Debounce

    def stop(self) -> None:
        self.query.stop()
        self.debounce.stop()


def keep_fresh(events: DataFrame, refresh: Callable[[], object], checkpoint: str, every: str = "1 second", gap: timedelta = GAP) -> Watch:
    """Refresh once after every burst of changes, a gap after its last; an error is logged and the stream goes on."""
    debounce = Debounce(refresh, gap)

    def handle(batch: DataFrame, number: int) -> None:
        if relevant(batch).take(1):
            debounce()

    query = events.writeStream.trigger(processingTime=every).option("checkpointLocation", checkpoint).foreachBatch(handle).start()
    return Watch(query, debounce)


def watch_tree(spark: SparkSession, root: str, refresh: Callable[[], object], gap: timedelta = GAP) -> Watch:
    """Keep what refresh builds in step with the source files below root."""
    spark.dataSource.register(TreeEvents)
    changes = spark.readStream.format(TreeEvents.name()).load(root)
    return keep_fresh(changes, refresh, f"{scratch_root(spark)}/watch-{uuid.uuid4().hex}", gap=gap)
