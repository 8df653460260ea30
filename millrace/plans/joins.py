"""Outer, range and correlated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.rangetotals import range_totals
from millrace.plans.registry import register, table


@register("""
SELECT coalesce(c_nationkey, s_nationkey) AS nation, coalesce(n_customers, 0)::BIGINT AS n_customers, coalesce(n_suppliers, 0)::BIGINT AS n_suppliers
FROM (SELECT c_nationkey, count(*) AS n_customers FROM customer WHERE c_acctbal < -500 GROUP BY ALL)
FULL JOIN (SELECT s_nationkey, count(*) AS n_suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY ALL) ON c_nationkey = s_nationkey
""")
def prov_nation_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in debt and rich suppliers by nation, with nations that have only one of them (full outer join)."""
    count = lambda df, key, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    poor = count(table(spark, sf_dir, "customer").where("c_acctbal < -500"), "c_nationkey", "n_customers")
    rich = count(table(spark, sf_dir, "supplier").where("s_acctbal > 5000"), "s_nationkey", "n_suppliers")
    both = poor.join(rich, F.col("c_nationkey") == F.col("s_nationkey"), "full").fillna(0, ["n_customers", "n_suppliers"])
    return both.select(F.coalesce("c_nationkey", "s_nationkey").alias("nation"), "n_customers", "n_suppliers")


@register("""
SELECT c_custkey, count(o_orderkey)::BIGINT AS n_orders, max(o_orderdate)::TIMESTAMP AS last_order
FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY ALL
""")
def prov_customer_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in progress of every customer, also of those without (left outer join after aggregating)."""
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    own = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"), F.max("o_orderdate").alias("last_order"))
    every = table(spark, sf_dir, "customer").join(own, F.col("c_custkey") == F.col("o_custkey"), "left")
    return every.select("c_custkey", F.coalesce("n_orders", F.lit(0)).cast("long").alias("n_orders"), "last_order")


@register("""
SELECT i.event_id AS error_id, count(*)::BIGINT AS n_events, min(e.event_id) AS first_event FROM events e
JOIN (SELECT event_id, epoch_us(ts) AS low, epoch_us(ts) + 600000000 * (1 + event_id % 50) AS high FROM events WHERE event_type = 'error') i
ON epoch_us(e.ts) >= i.low AND epoch_us(e.ts) < i.high GROUP BY ALL
""")
def prov_error_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the time after each error, whose length differs by error (range join, summed up without its pairs)."""
    events = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    errors = events.where("event_type = 'error'").select(F.col("event_id").alias("error_id"), F.col("at").alias("low"), F.expr("at + 600000000 * (1 + event_id % 50)").alias("high"))
    met = range_totals(events.select("event_id", "at"), errors, at="at", low="low", high="high", least="event_id")
    return met.groupBy("error_id").agg(F.sum("n_points").alias("n_events"), F.min("least_point").alias("first_event"))


@register("""
SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)
AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
""")
def prov_large_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a returned item, half as dear again as their customer's mean order (correlated subqueries, in SQL)."""
    query = """
    SELECT o_orderkey FROM {orders} o
    WHERE o_totalprice > (SELECT 1.5D * avg(o_totalprice) FROM {orders} i WHERE i.o_custkey = o.o_custkey)
      AND EXISTS (SELECT 1 FROM {items} WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
    """
    return spark.sql(query, orders=table(spark, sf_dir, "orders"), items=table(spark, sf_dir, "lineitem"))
