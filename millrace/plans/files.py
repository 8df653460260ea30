"""Round trips through file formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.columns import exact_sum
from millrace.plans.registry import register, table
from millrace.shared import Stage
from millrace.sources.files import OPTIONS, read_files, write_files


@register("""
SELECT kind, o_orderstatus, count(*)::BIGINT AS n_orders, sum(o_totalprice::DECIMAL(12,2))::DOUBLE AS total, max(o_orderdate)::TIMESTAMP AS last_order
FROM orders, (SELECT unnest(['parquet', 'orc', 'csv', 'json']) AS kind) WHERE o_orderpriority LIKE '1%' GROUP BY ALL
""")
def prov_file_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent orders written as each format, a folder for each status, read again and summed up."""
    orders = table(spark, sf_dir, "orders").where("o_orderpriority like '1%'")
    folder = Stage(spark, "files").path
    parts = []
    for kind in OPTIONS:
        write_files(orders, f"{folder}/{kind}", kind, by=("o_orderstatus",))
        # only the folder of a status that is asked for would be read
        rows = read_files(spark, f"{folder}/{kind}", kind, orders.schema)
        parts.append(rows.groupBy(F.lit(kind).alias("kind"), "o_orderstatus").agg(F.count(F.lit(1)).alias("n_orders"), exact_sum(F.col("o_totalprice")).alias("total"), F.max("o_orderdate").alias("last_order")))
    return reduce(DataFrame.unionByName, parts)
