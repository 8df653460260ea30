"""As-of join: each row of one side with the latest row of the other side at or before its time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.blocks import block_of


def asof_join(left: DataFrame, right: DataFrame, *, by: str, time: str, value: str, order: str, width: int | None = None) -> DataFrame:
    """The columns of ``left`` and ``value``, taken from the last row of ``right`` with the same ``by`` and a time not later.

    Both sides have ``by`` and ``time``; equal times count as before; of several rows of ``right`` at one time the
    one greatest by ``order`` counts. Rows of ``left`` without such a row get null, and a null ``by`` or ``time``
    matches nothing.

    No pairs are made: rows are dealt by ``by`` and block of time (``width`` days, one if not stated; for numeric times
    ``width`` units, which must be stated: a block should hold some thousands of rows), read in order inside a block, and what a block has last is carried to the later ones of its key. So a key with many
    rows is many tasks; only its blocks, one row each, meet in one.
    """
    kind = left.schema[time].dataType
    if width is None and isinstance(kind, T.NumericType):
        raise ValueError("state the width of a block of numeric time")
    known = lambda df: df.where(F.col(f"`{by}`").isNotNull() & F.col(f"`{time}`").isNotNull())
    row = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    asks = known(left).select(F.col(f"`{by}`").alias("_by"), F.col(f"`{time}`").alias("_t"), F.lit(1).alias("_side"), row.alias("_row"), F.lit(None).alias("_o"), F.lit(None).alias("_v"))
    gives = known(right).select(
        F.col(f"`{by}`").alias("_by"), F.col(f"`{time}`").alias("_t"), F.lit(0).alias("_side"), F.lit(None).alias("_row"), F.col(f"`{order}`").alias("_o"), F.struct(F.col(f"`{value}`").alias("v")).alias("_v")
    )
    both = asks.unionByName(gives).withColumn("_b", block_of(F.col("_t"), kind, width or 1))
    past = Window.partitionBy("_by", "_b").orderBy("_t", "_side", "_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_found", F.last("_v", ignorenulls=True).over(past)).where("_side = 1")
    lasts = both.groupBy("_by", "_b").agg(F.max_by("_v", F.when(F.col("_side") == 0, F.struct("_t", "_o"))).alias("_last"))
    before = Window.partitionBy("_by").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select("_by", "_b", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    joined = found.join(carried, ["_by", "_b"]).select("_row", F.coalesce("_found", "_carried")["v"].alias("_value"))
    unknown = left.where(F.col(f"`{by}`").isNull() | F.col(f"`{time}`").isNull()).select(row.alias("_row"), F.lit(None).alias("_value"))
    return joined.unionByName(unknown).select(*[F.col(f"_row.`{c}`").alias(c) for c in left.columns], F.col("_value").alias(value))
