"""Equality join in which the rows of a heavy key are dealt over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.shared import Stage

#: A key is heavy from this part of the rows of a task on; groups that its rows are dealt into at most.
PART, MOST = 0.5, 256


def skew_join(left: DataFrame, right: DataFrame, *, on: str, how: str = "inner") -> DataFrame:
    """``left.join(right, on, how)`` for an inner or left join, with heavy keys of ``left`` salted.

    Keys are counted, after each task has counted its own. Those with over ``PART`` of the rows that a task would have by
    an even share are heavy: there are no more than two for each task, so they are broadcast. The rows of a heavy key are dealt by
    a hash of all their columns into as many groups as they fill, and the rows of ``right`` with that key are given
    to each group; all other keys have one group. Rows that are equal in all columns stay together.

    Edge cases: null keys match nothing, and stay in a left join; column names other than ``on`` must differ; without heavy keys it is
    the plain join.
    """
    if how not in ("inner", "left"):
        raise ValueError("only inner and left joins")
    spark = left.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = left.where(F.col(f"`{on}`").isNotNull()).groupBy(F.col(f"`{on}`").alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    counts = Stage(spark, "skew_join").write(counts, "counts")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    share = max(1, int(PART * total / tasks))
    heavy = F.broadcast(counts.where(F.col("_n") > share).select("_key", F.least(F.ceil(F.col("_n") / share), F.lit(MOST)).cast("int").alias("_groups")))
    groups = F.coalesce("_groups", F.lit(1))
    dealt = left.join(heavy, F.col(f"`{on}`") == F.col("_key"), "left").withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), groups).cast("int")).drop("_key", "_groups")
    given = right.join(heavy, F.col(f"`{on}`") == F.col("_key"), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), groups - 1))).drop("_key", "_groups")
    return dealt.join(given, [on, "_salt"], how).drop("_salt")
