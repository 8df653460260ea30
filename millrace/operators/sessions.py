"""Sessions: runs of events of one key without a longer pause."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.blocks import block_of


def number_sessions(events: DataFrame, *, by: str, time: str, order: str, gap_seconds: int, width: int = 1) -> DataFrame:
    """The columns of ``events`` and ``session``, counted from 1 for each ``by``: a pause above the gap starts one.

    A null key is one key; rows with a null time come first, in the first session. Rows are numbered inside a
    block (``width`` days) of a key; then the blocks of a key, one row each, tell where their first session starts.
    """
    held = events.withColumn("_b", block_of(F.col(f"`{time}`"), events.schema[time].dataType, width))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    late = lambda pause: F.coalesce((pause > gap_seconds * 1_000_000).cast("int"), F.lit(0))
    rows = Window.partitionBy(by, "_b").orderBy(time, order)
    held = held.withColumn("_new", late(micros(F.col(f"`{time}`")) - micros(F.lag(time).over(rows))))
    blocks = held.groupBy(F.col(f"`{by}`").alias("_by"), F.col("_b").alias("_of")).agg(F.min(micros(F.col(f"`{time}`"))).alias("_lo"), F.max(micros(F.col(f"`{time}`"))).alias("_hi"), F.sum("_new").alias("_n"))
    order_of = Window.partitionBy("_by").orderBy("_of")
    starts = F.when(F.row_number().over(order_of) == 1, 1).otherwise(late(F.col("_lo") - F.lag("_hi").over(order_of)))
    blocks = blocks.withColumn("_starts", starts).withColumn("_base", F.sum(F.col("_n") + F.col("_starts")).over(order_of) - F.col("_n"))
    same = F.col(f"`{by}`").eqNullSafe(F.col("_by")) & F.col("_b").eqNullSafe(F.col("_of"))
    joined = held.withColumn("_run", F.sum("_new").over(rows)).join(blocks.select("_by", "_of", "_base"), same)
    return joined.withColumn("session", (F.col("_base") + F.col("_run")).cast("long")).select(*[F.col(f"`{c}`") for c in events.columns if c != "session"], "session")
