"""Registered queries of the relational core and their DuckDB equivalents.

The names start with ``prov_``: this scope was chosen here, from the supplied tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.columns import exact_sum
from millrace.operators.asof import asof_join
from millrace.operators.ordered import ordered_columns
from millrace.operators.sessions import number_sessions
from millrace.plans.registry import ORACLES, QUERIES, register, table
from millrace.plans import aggregates, extras, files, joins, scalars, search, streams  # noqa: F401  they register their queries

__all__ = ["ORACLES", "QUERIES"]

def revenue():
    """Exact: doubles are cast to decimals before they are multiplied and summed."""
    return F.sum(F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(3,2)")).cast("decimal(3,2)")).cast("double")


@register("""
SELECT n_name, o_orderpriority, count(*)::BIGINT AS n_items,
  sum(l_extendedprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(3,2))::DECIMAL(3,2))::DOUBLE AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' AND l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1998-01-01'
GROUP BY ALL
""")
def prov_regional_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-table join: revenue of one region's customers in one year, by nation and order priority."""
    t = lambda name: table(spark, sf_dir, name)
    items = t("lineitem").where("l_shipdate >= timestamp_ntz'1997-01-01' and l_shipdate < timestamp_ntz'1998-01-01'")
    own = t("customer").join(t("nation").join(t("region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = items.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(own, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("n_name", "o_orderpriority").agg(F.count(F.lit(1)).alias("n_items"), revenue().alias("revenue"))


@register("""
SELECT l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus)::BIGINT AS level, count(*)::BIGINT AS n_items,
  sum(l_quantity::DECIMAL(12,2))::DOUBLE AS quantity,
  sum(l_extendedprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(3,2))::DECIMAL(3,2))::DOUBLE AS revenue
FROM lineitem WHERE l_shipdate <= DATE '2001-06-01' GROUP BY ROLLUP (l_returnflag, l_linestatus)
""")
def prov_price_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roll-up of items by flag and status, with subtotals and the total."""
    items = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz'2001-06-01'")
    return items.rollup("l_returnflag", "l_linestatus").agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n_items"), exact_sum(F.col("l_quantity")).alias("quantity"), revenue().alias("revenue")
    )


@register("""
SELECT c_mktsegment, o_orderkey, o_totalprice, place::BIGINT AS place FROM (
  SELECT c_mktsegment, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice DESC, o_orderkey) AS place
  FROM orders JOIN customer ON o_custkey = c_custkey) WHERE place <= 5
""")
def prov_top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five dearest orders of each market segment."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    best = Window.partitionBy("c_mktsegment").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return rows.select("c_mktsegment", "o_orderkey", "o_totalprice", F.row_number().over(best).cast("long").alias("place")).where("place <= 5")


@register("""
SELECT o_orderpriority, count(*)::BIGINT AS n_orders FROM orders
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) GROUP BY ALL
""")
def prov_empty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without an item, by priority (anti join)."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey")
    return table(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n_orders"))


@register("""
SELECT a.event_id, a.user_id, b.event_id AS last_view FROM (SELECT * FROM events WHERE event_type = 'purchase') a
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') b ON a.user_id = b.user_id AND a.ts >= b.ts
""")
def prov_last_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with its user's latest view before it (as-of join)."""
    events = table(spark, sf_dir, "events")
    views = events.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("last_view"))
    return asof_join(events.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, by="user_id", time="ts", value="last_view", order="last_view").drop("ts")


@register("""
WITH marked AS (
  SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM marked)
SELECT user_id, session::BIGINT AS session, count(*)::BIGINT AS n_events, min(event_id) AS first_event FROM numbered GROUP BY ALL
""")
def prov_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user, ended by six hours without an event."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    numbered = number_sessions(events, by="user_id", time="ts", order="event_id", gap_seconds=6 * 3600)
    return numbered.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n_events"), F.min("event_id").alias("first_event"))


@register("""
SELECT event_id, user_id, (event_id - lag(event_id) OVER w)::BIGINT AS step,
  dense_rank() OVER (PARTITION BY user_id ORDER BY event_type)::BIGINT AS kind,
  max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS peak
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def prov_event_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the step from its user's event before, the rank of its type and the peak of three events."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", "value")
    step = {
        "step": lambda w: F.col("event_id") - F.lag("event_id").over(w),
        "peak": lambda w: F.max("value").over(w.rowsBetween(-2, 0)),
    }
    stepped = ordered_columns(events, by=("user_id",), order=("ts", "event_id"), look_back=step, reach=2)
    # a dense rank counts where the type differs from the one before
    other = {"_new": lambda w: (~F.col("event_type").eqNullSafe(F.lag("event_type").over(w)) | F.lag(F.lit(1)).over(w).isNull()).cast("long")}
    ranked = ordered_columns(stepped, by=("user_id",), order=("event_type", "event_id"), look_back=other, reach=1, running={"kind": F.col("_new")})
    return ranked.select("event_id", "user_id", "step", "kind", "peak")


@register("""
SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'
EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'
""")
def prov_settled_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with finished and open orders but none in progress (set operations)."""
    of = lambda status: table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == status).select("o_custkey")
    return of("F").intersect(of("O")).subtract(of("P"))


@register("""
SELECT event_type, count(k)::BIGINT AS n_values, min(k) AS least, max(k) AS most, sum(k)::BIGINT AS total
FROM (SELECT event_type, (props->>'$.k')::BIGINT AS k FROM events) GROUP BY ALL
""")
def prov_event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number inside the JSON properties, summed up by event type."""
    rows = table(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return rows.groupBy("event_type").agg(F.count("k").alias("n_values"), F.min("k").alias("least"), F.max("k").alias("most"), F.sum("k").alias("total"))
