"""Range join: points with the intervals that hold them, as an equality join on bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def range_join(points: DataFrame, intervals: DataFrame, *, at: str, low: str, high: str) -> DataFrame:
    """The columns of both sides for every pair with ``low`` <= ``at`` < ``high`` (whole numbers, any that fit a long).

    An interval goes to the bins of the least power of two that is not shorter than it (2**63 at most), so to two
    bins at most, however long it is; a point goes to one bin of each width that occurs (at most 64). Bins meet
    by equality, so no side is compared with all of the other. Nulls and empty intervals match nothing; repeated rows
    match each; the column names of the two sides must differ.
    """
    whole = lambda c: F.col(f"`{c}`").cast("decimal(20,0)")  # noqa: E731  a difference of longs need not fit one
    rest = whole(high) - whole(low) - 1
    level = F.when(rest == 0, 0).when(rest >= F.expr("9223372036854775808"), 63).otherwise(F.length(F.bin(rest.try_cast("long"))))
    held = intervals.where(F.col(f"`{low}`") < F.col(f"`{high}`")).withColumn("_level", level)
    bins = F.array_distinct(F.array(F.expr(f"shiftright(cast(`{low}` as bigint), _level)"), F.expr(f"shiftright(cast(`{high}` as bigint) - 1, _level)")))
    levels = [r["_level"] for r in held.select("_level").distinct().collect()]  # powers of two: at most 64
    probes = F.array(*[F.struct(F.lit(n).alias("l"), F.expr(f"shiftright(cast(`{at}` as bigint), {n})").alias("b")) for n in levels]) if levels else F.array().cast("array<struct<l:int,b:bigint>>")
    asked = points.select("*", F.explode(probes).alias("_p")).select("*", F.col("_p.l").alias("_level"), F.col("_p.b").alias("_bin")).drop("_p")
    met = asked.join(held.withColumn("_bin", F.explode(bins)), ["_level", "_bin"])
    return met.where((F.col(f"`{at}`") >= F.col(f"`{low}`")) & (F.col(f"`{at}`") < F.col(f"`{high}`"))).drop("_level", "_bin")
