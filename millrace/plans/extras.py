"""Queries over sketches, heavy keys, variants, a Python data source and Python functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.tables import Streaks, nearest_before, trimmed_means
from millrace.functions.variants import as_variant, field
from millrace.operators.sketches import DISTINCT_ERROR, RANK_ERROR, daily_sketches, merge_sketches, read_sketches
from millrace.operators.skewjoin import skew_join
from millrace.plans.registry import register, table
from millrace.shared import Stage
from millrace.sources.row_groups import register_row_groups


@register("""
SELECT event_type, count(*)::BIGINT AS n, true AS hll_fits, true AS theta_fits, true AS median_fits, true AS as_built_at_once FROM events GROUP BY event_type
""")
def prov_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether sketches stored by day and merged by type tell distinct ids and the median value within their stated errors."""
    events = table(spark, sf_dir, "events").select("event_type", "ts", "event_id", "value")
    stored = Stage(spark, "sketches").write(daily_sketches(events, by="event_type", time="ts", distinct="event_id", value="value"), "daily")
    merged = read_sketches(merge_sketches(stored, by=("event_type",)))
    # the same from all rows at once, and the exact values
    whole = events.groupBy(F.col("event_type").alias("kind")).agg(F.count_distinct("event_id").alias("ids"), F.hll_sketch_estimate(F.hll_sketch_agg("event_id", 12)).alias("hll_once"), F.theta_sketch_estimate(F.theta_sketch_agg("event_id", 12)).alias("theta_once"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= DISTINCT_ERROR * F.col("ids")
    both = merged.join(whole, F.col("event_type") == F.col("kind"))
    ranks = events.join(both.select(F.col("event_type").alias("kind"), "quantile"), F.col("event_type") == F.col("kind")).groupBy("kind")
    ranks = ranks.agg(F.avg((F.col("value") < F.col("quantile")).cast("int")).alias("below"), F.avg((F.col("value") <= F.col("quantile")).cast("int")).alias("upto")).withColumnRenamed("kind", "of")
    found = both.join(ranks, F.col("event_type") == F.col("of"))
    median = (F.col("below") - RANK_ERROR <= 0.5) & (F.col("upto") + RANK_ERROR >= 0.5)
    return found.select("event_type", "n", near("n_hll", "ids").alias("hll_fits"), near("n_theta", "ids").alias("theta_fits"), median.alias("median_fits"), (near("n_hll", "hll_once") & near("n_theta", "theta_once")).alias("as_built_at_once"))


@register("""
WITH s AS (SELECT source, count(*) AS n, sum(n_chars) AS total FROM documents GROUP BY source)
SELECT lang, count(*)::BIGINT AS n_docs, count(*) FILTER (WHERE n_chars * n > total)::BIGINT AS n_long FROM documents JOIN s USING (source) GROUP BY lang
""")
def prov_source_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By language, documents longer than the mean of their source, by a join in which a source may have most rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    means = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("total"))
    return skew_join(docs, means, on="source").groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("n_chars") * F.col("n") > F.col("total")).alias("n_long"))


@register("""
WITH told AS (SELECT event_id, event_type, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '{"a": {"b": [' || event_id || ', ' || props || ']}}' WHEN 2 THEN '{' || props ELSE '{"k": "x' || event_id || '"}' END AS p FROM events),
known AS (SELECT *, json_valid(p) AS ok FROM told)
SELECT event_type, count(*) FILTER (WHERE NOT ok)::BIGINT AS n_malformed,
  coalesce(sum(CASE WHEN ok THEN TRY_CAST(p->>'$.k' AS BIGINT) END), 0)::BIGINT AS k_sum,
  coalesce(sum(CASE WHEN ok THEN TRY_CAST(p->>'$.a.b[0]' AS BIGINT) END), 0)::BIGINT AS first_sum,
  coalesce(sum(CASE WHEN ok THEN TRY_CAST(p->>'$.a.b[1].k' AS BIGINT) END), 0)::BIGINT AS inner_sum
FROM known GROUP BY event_type
""")
def prov_event_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of four shapes, one of them malformed, read as variants: nested fields, arrays, fields of several types."""
    i = F.col("event_id").cast("string")
    told = F.when(F.col("event_id") % 4 == 0, F.col("props")).when(F.col("event_id") % 4 == 1, F.concat(F.lit('{"a": {"b": ['), i, F.lit(", "), F.col("props"), F.lit("]}}")))
    told = told.when(F.col("event_id") % 4 == 2, F.concat(F.lit("{"), "props")).otherwise(F.concat(F.lit('{"k": "x'), i, F.lit('"}')))
    rows = table(spark, sf_dir, "events").select("event_type", as_variant(told).alias("v"))
    total = lambda path, name: F.coalesce(F.sum(field(F.col("v"), path, "bigint")), F.lit(0)).alias(name)
    return rows.groupBy("event_type").agg(F.count_if(F.col("v").isNull()).alias("n_malformed"), total("$.k", "k_sum"), total("$.a.b[0]", "first_sum"), total("$.a.b[1].k", "inner_sum"))


@register("""
SELECT o_orderpriority, count(*)::BIGINT AS n_orders, min(o_orderkey) AS least, max(o_orderkey) AS most FROM orders
WHERE o_orderkey >= 100 AND o_orderkey < 700 AND o_orderstatus <> 'P' GROUP BY o_orderpriority
""")
def prov_row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some orders, read by a Python data source that skips row groups."""
    register_row_groups(spark)
    orders = spark.read.format("row_groups").load(f"{sf_dir}/orders.parquet").where("o_orderkey >= 100 and o_orderkey < 700 and o_orderstatus <> 'P'")
    return orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n_orders"), F.min("o_orderkey").alias("least"), F.max("o_orderkey").alias("most"))


@register("""
WITH marked AS (SELECT user_id, event_id, value, CASE WHEN value > lag(value) OVER w THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY event_id) AS part FROM marked),
parts AS (SELECT user_id, part, min(event_id) AS first_id, max(event_id) AS last_id, count(*)::BIGINT - 1 AS rises FROM numbered GROUP BY ALL)
SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY first_id)::BIGINT AS streak, first_id, last_id, rises FROM parts WHERE rises > 0
""")
def prov_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streaks of rising values of each user, by a table function with a state for each partition."""
    rows = table(spark, sf_dir, "events").selectExpr("user_id as key", "event_id as id", "value")
    return Streaks(rows.asTable().partitionBy("key").orderBy("id"))


@register("""
WITH placed AS (SELECT event_type, value::DECIMAL(18,2) AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, round(sum(v)::DOUBLE / count(*), 6) AS mean, count(*)::BIGINT AS n_inside FROM placed WHERE i >= n // 10 AND i < n - n // 10 GROUP BY event_type
""")
def prov_trimmed_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean value of each type of event without the least and the greatest tenth, for groups of any size."""
    events = table(spark, sf_dir, "events").select("event_type", "value")
    means = trimmed_means(events, by="event_type", value="value").withColumnRenamed("event_type", "kind")
    sizes = events.groupBy("event_type").agg(F.count("value").alias("n"))
    return sizes.join(means, F.col("event_type") == F.col("kind")).select("event_type", F.round("mean", 6).alias("mean"), (F.col("n") - 2 * F.floor(F.col("n") / 10)).alias("n_inside"))


@register("""
SELECT p.event_id, (SELECT count(*) FROM events v WHERE v.event_type = 'view' AND v.user_id = p.user_id AND v.ts <= p.ts AND v.ts::DATE = p.ts::DATE)::BIGINT AS before
FROM events p WHERE p.event_type = 'purchase'
""")
def prov_views_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with its user's views of that day before it, by cogrouped Arrow tables of a user and a day."""
    events = table(spark, sf_dir, "events").select("event_type", "event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("ts").cast("date").alias("day"))
    side = lambda kind, *columns: events.where(F.col("event_type") == kind).select(*columns)
    found = nearest_before(side("purchase", "event_id", "user_id", "at", "day"), side("view", "user_id", "at", "day"), by="user_id", time="at", block="day")
    return found.select("event_id", "before")
