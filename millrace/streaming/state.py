"""Streams with state of their own: patterns of events of a key, sessions, and rows that were seen before."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What keyed state needs of the session.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed state needs, for streams that run inside; then what was set before."""
    before = spark.conf.get(ROCKSDB[0], None)
    spark.conf.set(*ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(ROCKSDB[0], before) if before else spark.conf.unset(ROCKSDB[0])


class AfterSeveral(StatefulProcessor):
    """For each row that ``answers``, how many rows that ``counts`` the key had within the time before it.

    The state has the times of the rows that count and may still be asked for. Rows that may be late are held until
    the watermark has passed them, so that they are read in order whatever batch they come in; a timer wakes the key then,
    and removes times that are out of reach.
    """

    def __init__(self, within_ms: int, least: int):
        self.within, self.least = within_ms, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, id long, answers boolean")
        self.times = handle.getListState("times", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = [(int(a), int(i), bool(y)) for part in rows for a, i, y in zip(part["at"], part["id"], part["answers"])]
        self.waiting.appendList(fresh)
        self._wake(min(a for a, _, _ in fresh))
        yield pd.DataFrame({"key": [], "id": [], "n": []}).astype("int64")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(tuple(r) for r in self.waiting.get())
        due, later = [r for r in held if r[0] <= passed], [r for r in held if r[0] > passed]
        times, out = sorted(r[0] for r in self.times.get()), []
        for at, number, answers in due:
            times = [t for t in times if t > at - self.within * 1000]
            if answers:
                if len(times) >= self.least:
                    out.append((number, len(times)))
            else:
                times.append(at)
        times = [t for t in times if t > passed - self.within * 1000]
        for state, rows in ((self.waiting, later), (self.times, [(t,) for t in times])):
            state.clear()
            if rows:
                state.put(rows)
        if later or times:
            self._wake(min([r[0] for r in later] + [t + self.within * 1000 for t in times]), expiredTimerInfo.getExpiryTimeInMs())
        yield pd.DataFrame({"key": [int(key[0])] * len(out), "id": [i for i, _ in out], "n": [n for _, n in out]}).astype("int64")

    def _wake(self, micros: int, spent: int | None = None) -> None:
        """Wake the key once the watermark has passed a time; the timer ``spent`` goes by itself."""
        at = micros // 1000 + 1
        known = [t for t in self.handle.listTimers() if t != spent]
        if not known or at < min(known):
            for t in known:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def after_several(events: DataFrame, *, by: str, time: str, key: str, counts: str, answers: str, within: str, least: int, late: str = "1 hour") -> DataFrame:
    """A stream of ``by``, ``key`` and ``n``: rows of a stream that satisfy ``answers`` and had, within the time ``within`` before
    them, ``n`` rows of the same ``by`` that satisfy ``counts``, ``least`` or more.

    ``by`` and ``key`` are whole numbers. A row counts for answers that come after it by time, then key; the far end of the time does not
    count. Rows may come in any order up to ``late``: an answer is given once the watermark has passed it, so the last
    ones are given only when later events come. Later rows are dropped; rows with a null among the three, and rows that satisfy
    neither, are not read. Run it inside ``keyed_state``.
    """
    spark = events.sparkSession
    if spark.conf.get(ROCKSDB[0], "") != ROCKSDB[1]:
        raise RuntimeError(f"set {ROCKSDB[0]} to {ROCKSDB[1]}")
    asked = F.coalesce(F.expr(answers), F.lit(False))
    rows = events.where(asked | F.coalesce(F.expr(counts), F.lit(False))).where(" and ".join(f"`{c}` is not null" for c in (by, time, key)))
    timed = rows.select(F.col(f"`{by}`").cast("long").alias("by"), F.col(f"`{time}`").cast("timestamp").alias("_at"), F.col(f"`{key}`").cast("long").alias("id"), asked.alias("answers"))
    timed = timed.withWatermark("_at", late).withColumn("at", F.unix_micros("_at"))
    millis = int(pd.Timedelta(within).total_seconds() * 1000)
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("key", "id", "n")])
    found = timed.groupBy("by").transformWithStateInPandas(AfterSeveral(millis, least), outputStructType=schema, outputMode="append", timeMode="EventTime")
    return found.select(F.col("key").alias(by), F.col("id").alias(key), "n")


def closed_sessions(events: DataFrame, *, by: str, time: str, gap: str, late: str = "1 hour") -> DataFrame:
    """A stream of ``by``, ``start``, ``last`` and ``n_events``: sessions, ended by a time ``gap`` without an event.

    A session is given once, when the watermark has passed its end (its last event and the gap); sessions that rows
    of several batches join are merged in the state until then. Rows later than ``late`` are dropped; rows with a null time
    are in no session; a null ``by`` is a key.
    """
    timed = events.select(F.col(f"`{time}`").cast("timestamp").alias("_at"), F.col(f"`{by}`")).withWatermark("_at", late)
    found = timed.groupBy(F.session_window("_at", gap).alias("_s"), F.col(f"`{by}`")).agg(F.count(F.lit(1)).alias("n_events"), F.max("_at").alias("last"))
    return found.select(F.col(f"`{by}`"), F.col("_s.start").cast("timestamp_ntz").alias("start"), F.col("last").cast("timestamp_ntz").alias("last"), "n_events")


def first_seen(events: DataFrame, *, keys: tuple[str, ...], time: str, late: str = "1 day") -> DataFrame:
    """The rows of a stream without those whose ``keys`` an earlier row had, as long as that one is within ``late``.

    The state forgets a row when the watermark has passed its time by ``late``; rows that are later than that are dropped, copies or not. Which of several
    copies in one batch stays is not stated; nulls in keys are equal to one another.
    """
    timed = events.withColumn("_at", F.col(f"`{time}`").cast("timestamp")).withWatermark("_at", late)
    return timed.dropDuplicatesWithinWatermark(list(keys)).drop("_at")
