"""Connected components of a graph in DataFrames: alternating large-star and small-star steps.

Each step is two joins on node ids with map-side minima; the edges are written to the shared folder after
each round, so lineage stays short and a lost executor costs one round. Nothing is collected but row counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.staging import Stage


def _star(pairs: DataFrame, small: bool) -> DataFrame:
    """Point neighbours at the least node next to them. ``pairs``: a, b."""
    both = pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    if not small:
        both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    joined = both.join(least, "a")
    if small:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    else:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").distinct()


def connected_components(edges: DataFrame, stage: Stage, name: str = "cc", rounds: int = 40) -> DataFrame:
    """``node`` and ``component``, the least node that can be reached, for every node of an edge.

    ``edges`` has two long columns. Null ends and loops link nothing; repeated and reversed edges count once;
    no edges give no rows. The number of rounds is logarithmic in a component's size; ``rounds`` is a stop that
    raises, not a cut-off.
    """
    a, b = edges.columns
    now = stage.write(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), f"{name}_0")
    mark = None
    for k in range(1, rounds + 1):
        if now.isEmpty():
            break
        new = stage.write(_star(_star(now, small=False), small=True), f"{name}_{k}")
        stage.drop(f"{name}_{k - 1}")
        now, before = new, mark
        mark = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(2**31)))).first())
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    ends = stage.write(ends.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct(), name)
    stage.drop(f"{name}_{k}", f"{name}_{k - 1}")
    return ends
