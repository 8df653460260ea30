"""Distinct, statistical, pivoted and grouping-set aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.columns import population_variance
from millrace.plans.registry import register, table


@register("""
SELECT p_brand, count(DISTINCT p_type)::BIGINT AS n_types, count(DISTINCT p_size)::BIGINT AS n_sizes, quantile_cont(p_size, 0.5)::DOUBLE AS median_size,
  (count(*) * sum(p_size::BIGINT * p_size) - sum(p_size) * sum(p_size))::DOUBLE / (count(*) * count(*))::DOUBLE AS size_variance,
  max_by(p_partkey, (p_retailprice, p_partkey)) AS dearest
FROM part GROUP BY ALL
""")
def prov_brand_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct counts, the median, the variance and the dearest part of each brand."""
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(
        F.countDistinct("p_type").alias("n_types"),
        F.countDistinct("p_size").alias("n_sizes"),
        F.percentile("p_size", 0.5).alias("median_size"),
        population_variance(F.col("p_size")).alias("size_variance"),
        F.max_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("dearest"),
    )


@register("""
SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F')::BIGINT AS f, count(*) FILTER (WHERE l_linestatus = 'O')::BIGINT AS o
FROM lineitem GROUP BY ALL
""")
def prov_flag_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by flag, a column for each status (pivot with stated values)."""
    grid = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).count()
    return grid.select("l_returnflag", F.coalesce("F", F.lit(0)).cast("long").alias("f"), F.coalesce("O", F.lit(0)).cast("long").alias("o"))


@register("""
SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus, o_orderpriority)::BIGINT AS level, count(*)::BIGINT AS n_orders
FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderpriority), ())
""")
def prov_order_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by status and priority, by priority, and all (grouping sets)."""
    sets = [["o_orderstatus", "o_orderpriority"], ["o_orderpriority"], []]
    counted = table(spark, sf_dir, "orders").groupingSets(sets, "o_orderstatus", "o_orderpriority")
    return counted.agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n_orders"))
