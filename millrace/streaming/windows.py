"""Structured Streaming aggregates over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.shared import Stage


def windowed_counts(events: DataFrame, *, time: str, by: str, width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """``start`` of a window of event time, ``by``, and ``n_events``, for a stream or a table.

    Windows follow one another, or start every ``slide``.

    ``time`` may be a timestamp without time zone: it is read in the session's zone, as a watermark needs, and
    ``start`` comes out without zone again. Rows with a null time are in no window; a null ``by`` is a group.
    In append and update mode rows later than ``late`` are dropped and closed windows leave the state.
    """
    timed = events.select(F.col(f"`{time}`").cast("timestamp").alias("_at"), F.col(f"`{by}`")).withWatermark("_at", late)
    counts = timed.groupBy(F.window("_at", width, slide or width).alias("_window"), F.col(f"`{by}`")).agg(F.count(F.lit(1)).alias("n_events"))
    return counts.select(F.col("_window.start").cast("timestamp_ntz").alias("start"), F.col(f"`{by}`"), "n_events")


def interval_join(left: DataFrame, right: DataFrame, *, by: str, time: str, before: str, late: str = "1 hour") -> DataFrame:
    """Rows of two streams (or tables) with equal ``by``, where the right one's time lies up to ``before`` before the left one's.

    The far end of the interval does not count, the near one does. Both sides have ``by`` and ``time``, which come
    out once, from the left; other names must differ. Watermarks bound what is held of either side: rows later
    than ``late`` are dropped. Nulls match nothing.
    """
    timed = lambda df, name: df.withColumn(name, F.col(f"`{time}`").cast("timestamp")).withWatermark(name, late)
    a, b = timed(left, "_at"), timed(right, "_then").withColumnRenamed(by, "_by").drop(time)
    near = (F.col("_then") <= F.col("_at")) & (F.col("_then") > F.col("_at") - F.expr(f"interval {before}"))
    return a.join(b, (F.col(f"`{by}`") == F.col("_by")) & near).drop("_at", "_then", "_by")


def run_appends(result: DataFrame, name: str) -> DataFrame:
    """Run a stream that only appends over all that its source holds now; its rows. Batches are written as by ``run_to_end``."""
    return _run(result, name, "append").drop("batch")


def run_to_end(result: DataFrame, name: str, keys: tuple[str, ...]) -> DataFrame:
    """Run a streaming aggregate over all that its source holds now; the last value of every group of ``keys``.

    Update mode: a micro-batch writes only the groups that it changed, to a folder of its own number, so the
    state is bounded by the watermark, nothing is written again, and a repeated batch changes nothing. Table and
    log are in the shared folder until the driver ends. A source without rows gives an empty table.
    """
    rows = _run(result, name, "update")
    values = F.struct(*[F.col(f"`{c}`") for c in result.columns if c not in keys])
    last = rows.groupBy(*keys).agg(F.max_by(values, "batch").alias("_last"))
    return last.select(*[F.col(f"`{c}`") if c in keys else F.col(f"_last.`{c}`") for c in result.columns])


def _run(result: DataFrame, name: str, mode: str) -> DataFrame:
    """What the micro-batches gave, with the number of the batch."""
    spark = result.sparkSession
    folder = Stage(spark, name).path
    spark.createDataFrame([], result.schema).write.parquet(f"{folder}/table/batch=-1")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table/batch={number}")

    running = result.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/log")
    running.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(T.StructType([*result.schema, T.StructField("batch", T.LongType())])).parquet(f"{folder}/table")
