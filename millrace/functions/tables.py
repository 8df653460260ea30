"""Table functions and functions of groups, over Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.operators.ordered import ordered_columns


@udtf(returnType=T.StructType([T.StructField(c, T.LongType()) for c in ("key", "streak", "first_id", "last_id", "rises")]))
class Streaks:
    """Of rows (key, id, value) partitioned by key and ordered by id: the streaks in which the value rises from row to row.

    ``SELECT * FROM streaks(TABLE(t) PARTITION BY key ORDER BY id)``. Its state is the streak that is open: one number each for where
    it began, the last row and how many rises it has. A null value ends a streak and begins none; a streak has one rise or more.
    """

    def __init__(self):
        self.key = self.first = self.last = self.value = None
        self.rises = self.done = 0

    def eval(self, row):
        self.key = row["key"]
        value = row["value"]
        if self.value is not None and value is not None and value > self.value:
            self.rises += 1
        else:
            yield from self._close()
            self.first = row["id"]
        self.last, self.value = row["id"], value

    def terminate(self):
        yield from self._close()

    def _close(self):
        if self.rises:
            self.done += 1
            yield self.key, self.done, self.first, self.last, self.rises
        self.rises = 0


@pandas_udf(T.DoubleType())
def trimmed_mean(values: pd.Series) -> float | None:
    """The mean of a group without its least and its greatest tenth (rounded down). Nulls are skipped; no values give null.

    The group must fit in memory; ``trimmed_means`` is for groups that need not.
    """
    held = values.dropna().sort_values()
    cut = len(held) // 10
    return float(held.iloc[cut : len(held) - cut].mean()) if len(held) else None


def trimmed_means(rows: DataFrame, *, by: str, value: str) -> DataFrame:
    """``by`` and ``mean``: as ``trimmed_mean`` for every group, however large: equal values are one row with their number first.

    What is left of a group, its distinct values in order and how many rows come before each, is counted by ``ordered_columns``.
    """
    counted = rows.select(F.col(f"`{by}`").alias("k"), F.col(f"`{value}`").cast("double").alias("v")).where("v is not null").groupBy("k", "v").agg(F.count(F.lit(1)).alias("m"))
    placed = ordered_columns(counted, by=("k",), order=("v",), running={"upto": F.col("m")})
    total = placed.groupBy("k").agg(F.max("upto").alias("n")).withColumnRenamed("k", "_k")
    both = placed.join(total, F.col("k").eqNullSafe(F.col("_k"))).withColumn("cut", F.floor(F.col("n") / 10))
    inside = F.greatest(F.lit(0), F.least("upto", F.col("n") - F.col("cut")) - F.greatest(F.col("upto") - F.col("m"), "cut"))
    return both.groupBy("k").agg((F.sum(inside * F.col("v")) / F.sum(inside)).alias("mean")).withColumnRenamed("k", by)


def nearest_before(left: DataFrame, right: DataFrame, *, by: str, time: str, block: str) -> DataFrame:
    """The columns of ``left`` and ``before``: how many rows of ``right`` of the same ``by`` and ``block`` have a time not later.

    Both sides are grouped by key and block, met as Arrow tables and searched by bisection, so a group is as large as a block.
    Times are whole numbers without nulls; a null key or block meets nothing: it has none before.
    """
    schema = f"{left.schema.simpleString()[7:-1]},before:bigint"

    def count(own: pa.Table, other: pa.Table) -> pa.Table:
        if not own.num_rows:
            return nothing
        # a side without rows of a group comes without columns
        held = np.sort(other.column("_time").to_numpy()) if other.num_rows else np.empty(0, np.int64)
        return own.append_column("before", pa.array(held.searchsorted(own.column(time).to_numpy(), "right"), pa.int64()))

    nothing = to_arrow_schema(T._parse_datatype_string(schema)).empty_table()
    known = lambda df: df.where(F.col(f"`{by}`").isNotNull() & F.col(f"`{block}`").isNotNull())
    # named anew, since both sides may come from one table
    other = known(right).select(F.col(f"`{by}`").alias("_by"), F.col(f"`{block}`").alias("_block"), F.col(f"`{time}`").alias("_time"))
    met = known(left).groupBy(by, block).cogroup(other.groupBy("_by", "_block")).applyInArrow(count, schema)
    unknown = left.where(F.col(f"`{by}`").isNull() | F.col(f"`{block}`").isNull()).withColumn("before", F.lit(0).cast("long"))
    return met.unionByName(unknown)
