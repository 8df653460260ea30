"""Streaming queries over the events, each run to the end of what there is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.registry import register, table
from millrace.streaming.state import after_several, closed_sessions, first_seen, keyed_state
from millrace.streaming.windows import interval_join, run_appends, run_to_end, windowed_counts


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@register("SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*)::BIGINT AS n_events FROM events GROUP BY ALL")
def prov_stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of event types by a stream that reads all events there are."""
    counts = windowed_counts(event_stream(spark, sf_dir), time="ts", by="event_type")
    return run_to_end(counts, "stream_hourly", ("start", "event_type"))


@register("""
SELECT (date_trunc('day', ts) + INTERVAL 6 HOUR * (hour(ts) // 6 - k))::TIMESTAMP AS start, event_type, count(*)::BIGINT AS n_events
FROM events, (SELECT unnest([0, 1, 2, 3]) AS k) GROUP BY ALL
""")
def prov_stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in windows of a day that start every six hours, by a stream."""
    counts = windowed_counts(event_stream(spark, sf_dir), time="ts", by="event_type", width="1 day", slide="6 hours")
    return run_to_end(counts, "stream_sliding", ("start", "event_type"))


@register("""
SELECT a.event_id AS purchase_id, b.event_id AS view_id FROM events a JOIN events b ON a.user_id = b.user_id
AND a.event_type = 'purchase' AND b.event_type = 'view' AND b.ts <= a.ts AND b.ts > a.ts - INTERVAL 6 HOUR
""")
def prov_stream_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases with their user's views of the six hours before, by a join of two streams."""
    side = lambda kind, name: event_stream(spark, sf_dir).where(f"event_type = '{kind}'").selectExpr(f"event_id as {name}", "user_id", "ts")
    pairs = interval_join(side("purchase", "purchase_id"), side("view", "view_id"), by="user_id", time="ts", before="6 hours")
    return run_appends(pairs.select("purchase_id", "view_id"), "stream_pairs")


@register("""
WITH asked AS (SELECT * FROM events WHERE event_type IN ('view', 'purchase'))
SELECT p.user_id, p.event_id, count(*)::BIGINT AS n FROM asked p JOIN asked v ON p.user_id = v.user_id
AND p.event_type = 'purchase' AND v.event_type = 'view' AND (v.ts, v.event_id) < (p.ts, p.event_id) AND v.ts > p.ts - INTERVAL 2 DAY
WHERE p.ts <= (SELECT date_trunc('milliseconds', max(ts)) FROM asked) - INTERVAL 1 HOUR GROUP BY ALL HAVING count(*) >= 2
""")
def prov_stream_after_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases after two views or more of the two days before, by a stream with keyed state and timers.

    Those of the last hour are not given yet: later events could still change them.
    """
    with keyed_state(spark):
        found = after_several(event_stream(spark, sf_dir), by="user_id", time="ts", key="event_id", counts="event_type = 'view'", answers="event_type = 'purchase'", within="2 days", least=2)
        return run_appends(found, "stream_after_views")


@register("""
WITH marked AS (
  SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)
), numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM marked),
sessions AS (SELECT user_id, min(ts)::TIMESTAMP AS start, max(ts)::TIMESTAMP AS last, count(*)::BIGINT AS n_events FROM numbered GROUP BY user_id, session)
SELECT * FROM sessions WHERE last + INTERVAL 6 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL 1 HOUR
""")
def prov_stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that are over by the end of the stream, with merging state."""
    return run_appends(closed_sessions(event_stream(spark, sf_dir), by="user_id", time="ts", gap="6 hours"), "stream_sessions")


@register("SELECT event_type, count(*)::BIGINT AS n_events, sum(event_id)::BIGINT AS ids FROM events GROUP BY ALL")
def prov_stream_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a source that sends everything twice, each counted once."""
    sent = event_stream(spark, sf_dir).unionByName(event_stream(spark, sf_dir))
    once = run_appends(first_seen(sent, keys=("event_id",), time="ts").select("event_type", "event_id"), "stream_replayed")
    return once.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_events"), F.sum("event_id").alias("ids"))
