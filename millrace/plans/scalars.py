"""String, date, array and map functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.columns import histogram, words
from millrace.plans.registry import register, table


@register(r"""
SELECT p_partkey, upper(split_part(p_name, ' ', 1)) AS colour, reverse(p_name) AS turned, length(p_name)::INTEGER AS n_chars,
  regexp_replace(p_name, '[aeiou]', '*', 'g') AS masked, lpad(p_partkey::VARCHAR, 8, '0') AS code, instr(p_name, ' ')::INTEGER AS gap,
  levenshtein(p_name, p_type)::INTEGER AS far, md5(p_name) AS mark
FROM part
""")
def prov_part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String functions on part names."""
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.upper(F.split_part(name, F.lit(" "), F.lit(1))).alias("colour"),
        F.reverse(name).alias("turned"),
        F.length(name).alias("n_chars"),
        F.regexp_replace(name, "[aeiou]", "*").alias("masked"),
        F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("code"),
        F.instr(name, " ").alias("gap"),
        F.levenshtein(name, F.col("p_type")).alias("far"),
        F.md5(name.cast("binary")).alias("mark"),
    )


@register("""
SELECT year(o_orderdate)::INTEGER AS year, quarter(o_orderdate)::INTEGER AS quarter, (dayofweek(o_orderdate) + 1)::INTEGER AS weekday, count(*)::BIGINT AS n_orders,
  max(date_diff('day', o_orderdate::DATE, last_day(o_orderdate)))::INTEGER AS left_of_month, min((o_orderdate::DATE + INTERVAL 3 MONTH)::DATE) AS due
FROM orders GROUP BY ALL
""")
def prov_order_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date functions on order dates."""
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").groupBy(F.year(day).alias("year"), F.quarter(day).alias("quarter"), F.dayofweek(day).alias("weekday")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.max(F.datediff(F.last_day(day), day)).alias("left_of_month"), F.min(F.add_months(day, 3)).alias("due")
    )


@register("""
SELECT vec_id, len(list_filter(embedding, lambda x: x > 0))::INTEGER AS n_positive, list_max(embedding) AS most, list_position(embedding, list_max(embedding))::BIGINT AS place,
  len(list_distinct(list_transform(embedding, lambda x: floor(x * 10)::BIGINT)))::INTEGER AS n_tenths, array_to_string(list_sort(list_transform(embedding[1:4], lambda x: floor(x * 10)::BIGINT)), ',') AS head
FROM embeddings
""")
def prov_vector_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Array and higher-order functions on vectors."""
    tenth = lambda x: F.floor(x.cast("double") * 10)
    v = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.size(F.filter(v, lambda x: x > 0)).alias("n_positive"),
        F.array_max(v).alias("most"),
        F.array_position(v, F.array_max(v)).alias("place"),
        F.size(F.array_distinct(F.transform(v, tenth))).alias("n_tenths"),
        F.array_join(F.array_sort(F.transform(F.slice(v, 1, 4), tenth)), ",").alias("head"),
    )


@register("""
SELECT word, count(*)::BIGINT AS n_parts, sum(n)::BIGINT AS n_words FROM (
  SELECT p_partkey, word, count(*) AS n FROM (SELECT p_partkey, unnest(string_split(p_name || ' ' || lower(p_type), ' ')) AS word FROM part) GROUP BY ALL)
GROUP BY ALL
""")
def prov_word_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of words for each part, and its entries summed up."""
    held = table(spark, sf_dir, "part").select(histogram(words(F.concat_ws(" ", "p_name", F.lower("p_type")))).alias("m"))
    return held.select(F.explode("m").alias("word", "n")).groupBy("word").agg(F.count(F.lit(1)).alias("n_parts"), F.sum("n").alias("n_words"))
