"""Ordered columns against Spark's own windows, with keys over many parts."""

import random
from statistics import median

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators.ordered import ordered_columns


def events(spark, many, seed=3):
    """Nine rows of ten have one key; nulls in every column; times tie, ids do not."""
    rng = random.Random(seed)
    rows = [(rng.choice([1] * 18 + [2, None]), rng.choice([None, *range(many // 3)]), k, rng.choice([None, 1, 2, 5]), rng.choice("abc")) for k in range(many)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "u long, t long, id long, v long, kind string").repartition(5)


@pytest.mark.parametrize("by, many, parts", [(("u",), 900, 40), (("u", "kind"), 300, 400), ((), 300, 30), (("u",), 5, 16), (("u",), 0, 4)])
def test_same_as_windows(spark, by, many, parts):
    rows = events(spark, many)
    w = Window.partitionBy(*by).orderBy("t", "id")
    look = {"before": lambda w: F.lag("id", 3).over(w), "least": lambda w: F.min("v").over(w.rowsBetween(-3, -1)), "first": lambda w: F.row_number().over(w) * 0}
    total = w.rowsBetween(Window.unboundedPreceding, 0)
    running = {"place": F.lit(1), "sum_v": F.col("v"), "sum_before": F.col("before")}
    found = ordered_columns(rows, by=by, order=("t", "id"), look_back=look, reach=3, running=running, parts=parts)
    want = rows.select("*", *[f(w).alias(c) for c, f in look.items()]).withColumn("place", F.row_number().over(w).cast("long"))
    want = want.withColumn("sum_v", F.coalesce(F.sum("v").over(total), F.lit(0))).withColumn("sum_before", F.coalesce(F.sum("before").over(total), F.lit(0)))
    assert sorted(map(tuple, found.select(want.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert found.columns == want.columns
    only = ordered_columns(rows, by=by, order=("t", "id"), running={"place": F.lit(1)}, parts=parts)
    assert sorted((r.id, r.place) for r in only.collect()) == sorted((r.id, r.place) for r in want.collect())


def test_rows_of_one_key_are_spread_evenly(spark):
    """No task reads over twice what the median task reads, though nine rows of ten have one key."""
    rows = events(spark, 40_000)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = ordered_columns(rows, by=("u",), order=("t", "id"), look_back={"before": lambda w: F.lag("id").over(w)}, reach=1, running={"place": F.lit(1)})
        read = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        looked = ordered_columns(rows, by=("u",), order=("t", "id"), look_back={"before": lambda w: F.lag("id").over(w)}, reach=1)
        tasks = [r["count"] for r in looked.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(tasks) == 40_000 == sum(read) and len(tasks) >= 7 and max(tasks) <= 2 * median(tasks)
