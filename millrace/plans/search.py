"""Queries that search: neighbours of vectors, hops over links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.hops import hops_from
from millrace.operators.neighbours import nearest_neighbours
from millrace.plans.registry import register, table


@register("""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
pairs AS (SELECT a.vec_id AS query, b.vec_id AS neighbour,
  list_sum(list_transform(range(1, len(a.e) + 1), lambda i: (a.e[i] - b.e[i]) * (a.e[i] - b.e[i]))) AS d
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
placed AS (SELECT query, neighbour, row_number() OVER (PARTITION BY query ORDER BY d, neighbour)::INTEGER AS place FROM pairs)
SELECT query, place, neighbour FROM placed WHERE place <= 10
""")
def prov_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every vector whose id is divisible by 100, among all, exactly."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors.where("vec_id % 100 = 0"), vectors, key="vec_id", vector="embedding", k=10, exact=True)


@register("""
WITH RECURSIVE l AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem WHERE l_quantity >= 48 AND l_discount >= 0.08),
links AS (SELECT DISTINCT a.s AS x, b.s AS y FROM l a JOIN l b ON a.p = b.p AND a.s <> b.s),
reach(s, hops) AS (SELECT (SELECT min(s) FROM l), 0 UNION SELECT y, hops + 1 FROM reach JOIN links ON s = x WHERE hops < 40)
SELECT s AS s_suppkey, min(hops)::INTEGER AS hops FROM reach WHERE s IS NOT NULL GROUP BY s
""")
def prov_supplier_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many parts sold in bulk lie between the first supplier and every other that is linked to it by such parts."""
    bulk = table(spark, sf_dir, "lineitem").where("l_quantity >= 48 and l_discount >= 0.08").select(F.col("l_suppkey").alias("s_suppkey"), "l_partkey").distinct()
    return hops_from(bulk, bulk.agg(F.min("s_suppkey").alias("s_suppkey")), node="s_suppkey", through="l_partkey", most=40)
