"""Hops from some nodes to all that can be reached, over things that nodes share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.shared import Stage


def hops_from(shares: DataFrame, start: DataFrame, *, node: str, through: str, most: int = 100) -> DataFrame:
    """``node`` and ``hops``: the fewest hops from any node of ``start`` to each node that ``most`` hops or fewer reach.

    ``shares`` has ``node`` and ``through``: two nodes are one hop apart if they share a value of ``through``. A hop goes from
    the nodes of the last step to the values that they have, and from those that no step had before to their nodes, so
    every node and every value is gone over once, in circles too, and a value that very many nodes share makes a
    row for each of them, not for each pair. Every step is written, and the search ends with a step that finds nothing new.

    Edge cases: nodes of ``start`` that share nothing are reached with 0 hops; null nodes and values link nothing; repeated
    rows change nothing; an empty start gives an empty table.
    """
    stage = Stage(shares.sparkSession, "hops")
    rows = stage.write(shares.select(F.col(f"`{node}`").alias("n"), F.col(f"`{through}`").alias("v")).where("n is not null and v is not null").distinct(), "shares")
    last = stage.write(start.select(F.col(f"`{node}`").alias("n")).where("n is not null").distinct().withColumn("hops", F.lit(0)), "nodes0")
    reached, seen = last, None
    for step in range(1, most + 1):
        if last.isEmpty():
            break
        values = rows.join(last, "n", "left_semi").select("v").distinct()
        values = stage.write(values.join(seen, "v", "left_anti") if seen is not None else values, f"values{step}")
        seen = values if seen is None else seen.unionByName(values)
        found = rows.join(values, "v", "left_semi").select("n").distinct().join(reached, "n", "left_anti")
        last = stage.write(found.withColumn("hops", F.lit(step)), f"nodes{step}")
        reached = reached.unionByName(last)
    return reached.select(F.col("n").alias(node), "hops")
