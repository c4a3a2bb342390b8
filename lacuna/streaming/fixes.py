"""Streams of position fixes and feeds, each with a batch twin that gives the same rows."""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lacuna.operators.graph import scratch

FIX = "user_id long, event_id long, at long, x double, y double"
IDLE = 30 * 86_400  #: seconds without a fix after which a user starts anew
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def accept(last: tuple | None, at: int, x: float, y: float, metres: float, seconds: int) -> bool:
    """A fix counts if it is the first, or far enough and late enough after the last one that did; NaN is never far."""
    if last is None:
        return True
    moved = ((x - last[1]) ** 2 + (y - last[2]) ** 2) ** 0.5
    return moved >= metres and at - last[0] >= seconds


def _fixes(fixes: DataFrame) -> DataFrame:
    return fixes.select("user_id", "event_id", F.col("at").cast("long").alias("at"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))


def throttle_fixes(fixes: DataFrame, metres: float = 40.0, seconds: int = 15, idle: int = IDLE) -> DataFrame:
    """Accepted fixes of each user, in order of time; a user's fixes are read as a sorted stream.

    After ``idle`` seconds without any fix the next one counts as the first.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, last, seen = None, None, None
        for pdf in batches:
            keep = []
            for u, at, x, y in zip(pdf["user_id"], pdf["at"], pdf["x"], pdf["y"]):
                if u != user or at - seen > idle:
                    user, last = u, None
                seen = at
                ok = accept(last, at, x, y, metres, seconds)
                if ok:
                    last = (at, x, y)
                keep.append(ok)
            yield pdf[keep]

    return _fixes(fixes).repartition("user_id").sortWithinPartitions("user_id", "at", "event_id").mapInPandas(run, FIX)


class Throttle(StatefulProcessor):
    """A user's fixes wait until the watermark has passed them and are then judged in order of time.

    State: the fixes that wait, and the last accepted one with the time of the last fix. What a batch brings is one entry
    of the list, a column an array, as each access to the state is a message to the JVM. A user has one event-time timer,
    no later than the first fix that waits; when none does, one for the end of ``idle``, which frees the user's state.
    """

    def __init__(self, metres: float, seconds: int, idle: int):
        self.metres, self.seconds, self.idle = metres, seconds, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at array<long>, event_id array<long>, x array<double>, y array<double>")
        self.last = handle.getValueState("last", "at long, x double, y double, seen long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            if len(pdf):
                self._wait(pdf["at"].astype("int64").tolist(), pdf["event_id"].astype("int64").tolist(), pdf["x"].astype("float64").tolist(), pdf["y"].astype("float64").tolist())
                first = pdf["at"].min() if first is None else min(first, pdf["at"].min())
        if first is not None:
            self._wake(int(first) * 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = sorted(fix for entry in self.waiting.get() for fix in zip(*entry))
        n = bisect_left(rows, passed, key=lambda r: r[0] * 1000)
        ripe, rest = rows[:n], rows[n:]
        state = self.last.get()
        last, seen = (state[:3], state[3]) if state else (None, None)
        out = []
        for at, event_id, x, y in ripe:
            if seen is not None and at - seen > self.idle:
                last = None
            seen = at
            if accept(last, at, x, y, self.metres, self.seconds):
                last = (at, x, y)
                out.append((key[0], event_id, at, x, y))
        if ripe:
            self.last.update((*last, seen))
            self.waiting.clear()
            if rest:
                self._wait(*(list(c) for c in zip(*rest)))
        elif not rest and seen is not None and (seen + self.idle) * 1000 < passed:
            self.last.clear()
            seen = None
        # the timer that has expired is the user's only one and goes by itself
        if rest:
            self.handle.registerTimer(rest[0][0] * 1000 + 1)
        elif seen is not None:
            self.handle.registerTimer((seen + self.idle) * 1000 + 1)
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FIX.split(", ")])

    def _wait(self, *columns: list) -> None:
        self.waiting.appendValue(columns)

    def _wake(self, at: int) -> None:
        """An earlier timer stays: it finds nothing ripe and sets the next one."""
        timers = list(self.handle.listTimers())
        if not timers or at < min(timers):
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def throttle_fix_stream(fixes: DataFrame, metres: float = 40.0, seconds: int = 15, idle: int = IDLE, delay: str = "1 hour") -> DataFrame:
    """The same over a stream with columns of ``throttle_fixes``. A fix that comes up to ``delay`` late is judged in its
    place; a later one is dropped. The state store has to be RocksDB (see ``run_to_end``)."""
    rows = _fixes(fixes).withColumn("time", F.timestamp_seconds("at")).withWatermark("time", delay)
    return rows.groupBy("user_id").transformWithStateInPandas(Throttle(metres, seconds, idle), FIX, "Append", "EventTime")


def dedupe_feed_stream(feed: DataFrame, keys: list[str], time: str = "ts", delay: str = "1 day") -> DataFrame:
    """One row for each key that comes again within ``delay``; its state goes once the watermark has passed it."""
    return feed.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def stale_feed_drop(feed: DataFrame, local_date: Column, today: Column) -> DataFrame:
    """Availability for another local date is dropped whole."""
    return feed.where(local_date == today)


def stale_feed_stream(feed: DataFrame, zone: str, date: str = "date", time: str = "ts", delay: str = "1 day") -> DataFrame:
    """Rows whose ``date`` is the local date at which they were made (``time``, in UTC), in a time zone. For a batch or a stream."""
    local = F.to_date(F.from_utc_timestamp(F.col(time).cast("timestamp"), zone))
    rows = feed.withWatermark(time, delay) if feed.isStreaming else feed
    return stale_feed_drop(rows, local, F.col(date))


def run_to_end(stream: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """All rows of a stream over what its source holds now, from files in the shared folder.

    With a ``folder`` a later call goes on where the last one ended, and returns the rows of both.
    """
    spark: SparkSession = stream.sparkSession
    folder = folder or f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/rows")
        writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
