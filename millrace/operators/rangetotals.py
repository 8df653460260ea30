"""Totals of the points in each interval, without the pairs that a range join makes.

How many pairs there are grows with points times intervals. Here points are put in order once, equal ones as one; a
running sum gives the place and the count up to each end of an interval, so its count is a difference. For the least value the
places are the leaves of a tree of wide nodes; an interval of places is the end of one node and the beginning of another
at each level, two rows at most, which meet their nodes by equality.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordered import PARTS, ordered_columns
from millrace.operators.skewjoin import skew_join
from millrace.shared import Stage

#: Rows for which a part of the order is worth a task; large tables have the parts that ``ordered_columns`` gives them.
ROWS = 20_000


def range_totals(points: DataFrame, intervals: DataFrame, *, at: str, low: str, high: str, least: str, bits: int = 8) -> DataFrame:
    """The columns of ``intervals``, ``n_points`` and ``least_point``: the number of points with ``low`` <= ``at`` < ``high``
    and the least value of their column ``least``. Times are whole numbers, any that fit a long.

    As in an inner join, intervals without a point are left out; null times match nothing. Repeated points count each,
    repeated intervals come back each; null values are passed over, and are the least only where there is no other. New
    names must differ from those of ``intervals``. A node has 2**``bits`` children; nodes and intervals that very many rows
    ask for are dealt over tasks.
    """
    spark = points.sparkSession
    stage = Stage(spark, "range_totals")
    long = lambda c: F.col(f"`{c}`").cast("long")
    cells = points.where(long(at).isNotNull()).groupBy(long(at).alias("_t")).agg(F.count(F.lit(1)).alias("_n"), F.min(F.col(f"`{least}`")).alias("_least"))
    held = intervals.where(long(low) < long(high))
    spans = held.select(long(low).alias("_low"), long(high).alias("_high")).distinct()
    # an end comes before the points of its time, so it sees those below it
    ends = spans.select(F.explode(F.array("_low", "_high")).alias("_t"), F.lit(0).alias("_cell"), "_low", "_high")
    rows = stage.write(cells.withColumn("_cell", F.lit(1)).unionByName(ends, allowMissingColumns=True), "rows")
    parts = min(PARTS * int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + rows.count() // ROWS)
    placed = ordered_columns(rows, by=(), order=("_t", "_cell", "_low", "_high"), parts=parts, running={"_place": F.col("_cell"), "_sum": F.col("_n")})
    found = placed.where("_cell = 0").groupBy("_low", "_high").agg(F.min("_place").alias("_from"), F.max("_place").alias("_to"), (F.max("_sum") - F.min("_sum")).alias("_n"))
    spans = stage.write(found.where("_from < _to"), "spans")

    # nodes: the values of their children in order; places have no gaps, so nor have nodes
    nodes, children = [], placed.where("_cell = 1").select((F.col("_place") - 1).alias("_child"), "_least")
    while not nodes or nodes[-1].count() > 1:
        values = F.sort_array(F.collect_list(F.struct("_child", "_least"))).getField("_least")
        level = children.groupBy(F.shiftright("_child", bits).alias("_node")).agg(values.alias("_values"))
        nodes.append(stage.write(level, f"nodes-{len(nodes)}"))
        children = nodes[-1].select(F.col("_node").alias("_child"), F.array_min("_values").alias("_least"))

    key = lambda node, level: (node + F.lit(level << 56)).alias("_place")
    last_child = F.lit((1 << bits) - 1).cast("long")
    asks, lo, hi = [], F.col("_from"), F.col("_to") - 1
    for k in range(len(nodes)):
        left, right = F.shiftright(lo, bits), F.shiftright(hi, bits)
        first, last = lo.bitwiseAND(last_child), hi.bitwiseAND(last_child)
        ask = lambda node, a, b: F.struct(key(node, k), a.cast("int").alias("_a"), b.cast("int").alias("_b"))  # noqa: B023, E731
        asks.append(F.when(lo <= hi, ask(left, first, F.when(left == right, last).otherwise(last_child))))
        asks.append(F.when((lo <= hi) & (left < right), ask(right, F.lit(0), last)))
        lo, hi = left + 1, right - 1  # the nodes between are children of the next level; there are none in the end
    asked = spans.select("_low", "_high", "_n", F.explode(F.array(*asks)).alias("_ask")).where("_ask is not null").select("_low", "_high", "_n", "_ask.*")
    every = nodes[0].select(key(F.col("_node"), 0), "_values")
    for k, level in enumerate(nodes[1:], 1):
        every = every.unionByName(level.select(key(F.col("_node"), k), "_values"))
    part = F.array_min(F.slice("_values", F.col("_a") + 1, F.col("_b") - F.col("_a") + 1))
    met = skew_join(asked, every, on="_place").select("_low", "_high", "_n", part.alias("_least"))
    totals = met.groupBy("_low", "_high").agg(F.max("_n").alias("n_points"), F.min("_least").alias("least_point"))

    pair = lambda a, b: F.struct(a.alias("low"), b.alias("high")).alias("_span")
    totals = stage.write(totals.select(pair(F.col("_low"), F.col("_high")), "n_points", "least_point"), "totals")
    return skew_join(held.select("*", pair(long(low), long(high))), totals, on="_span").drop("_span")
