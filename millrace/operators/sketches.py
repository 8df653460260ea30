"""Sketches that are stored for each group and day, and merged later without the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size of the sketches: standard errors of 1.6 % of a count of distinct values, and about 1.3 % of a rank.
LOG_K, KLL_K = 12, 200
DISTINCT_ERROR, RANK_ERROR = 3 * 1.04 / 2 ** (LOG_K / 2), 0.03


def daily_sketches(events: DataFrame, *, by: str, time: str, distinct: str, value: str) -> DataFrame:
    """One row for each ``by`` and ``day``: ``n`` rows, ``hll`` and ``theta`` of ``distinct``, ``kll`` of ``value``.

    Null values are in no sketch but in ``n``; a null ``by`` or time is a group. A group without values has null sketches
    or empty ones, which merge like others.
    """
    rows = events.select(F.col(f"`{by}`"), F.col(f"`{time}`").cast("date").alias("day"), F.col(f"`{distinct}`").alias("_d"), F.col(f"`{value}`").cast("double").alias("_v"))
    return rows.groupBy(by, "day").agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("_d", LOG_K).alias("hll"), F.theta_sketch_agg("_d", LOG_K).alias("theta"), F.kll_sketch_agg_double("_v", KLL_K).alias("kll"))


def merge_sketches(sketches: DataFrame, *, by: tuple[str, ...]) -> DataFrame:
    """The sketches of ``daily_sketches``, or of this function, merged over all rows of equal ``by``: one row each."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("hll").alias("hll"), F.theta_union_agg("theta", LOG_K).alias("theta"), F.kll_merge_agg_double("kll", KLL_K).alias("kll"))


def read_sketches(sketches: DataFrame, *, at: float = 0.5) -> DataFrame:
    """The columns of ``sketches`` but the sketches, and what they tell: ``n_hll``, ``n_theta`` (distinct values, about) and ``quantile`` (null without values)."""
    kept = [c for c in sketches.columns if c not in ("hll", "theta", "kll")]
    return sketches.select(*kept, F.hll_sketch_estimate("hll").alias("n_hll"), F.theta_sketch_estimate("theta").alias("n_theta"), F.when(F.kll_sketch_get_n_double("kll") > 0, F.kll_sketch_get_quantile_double("kll", F.lit(at))).alias("quantile"))
