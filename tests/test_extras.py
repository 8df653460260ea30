"""Sketches, joins with heavy keys, variants, the Python data source and Python functions on small rows."""

import random
from statistics import median

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import LessThan

from millrace.functions.tables import Streaks, nearest_before, trimmed_mean, trimmed_means
from millrace.functions.variants import as_variant, field, shape_of
from millrace.operators.sketches import DISTINCT_ERROR, daily_sketches, merge_sketches, read_sketches
from millrace.operators.skewjoin import skew_join
from millrace.sources.row_groups import GroupReader, register_row_groups


def test_sketches_merge_in_any_order(spark):
    rows = spark.range(30_000).selectExpr("id % 3 as k", "timestampadd(HOUR, cast(id % 240 as int), timestamp_ntz'2024-01-01') as t", "id % 9000 as d", "cast(id % 1000 as double) as v")
    rows = rows.unionByName(spark.createDataFrame([(7, None, None, None), (None, None, 5, 1.0)], rows.schema))
    daily = daily_sketches(rows, by="k", time="t", distinct="d", value="v")
    assert daily.where("k < 3").count() == 30
    at_once = {r.k: r for r in read_sketches(merge_sketches(daily, by=("k",))).collect()}
    weeks = merge_sketches(daily.withColumn("week", F.weekofyear("day")), by=("k", "week"))
    twice = {r.k: r for r in read_sketches(merge_sketches(weeks, by=("k",))).collect()}
    for k in (0, 1, 2):
        for found in (at_once[k], twice[k]):
            assert found.n == 10_000 and abs(found.n_hll - 3000) <= DISTINCT_ERROR * 3000 and abs(found.n_theta - 3000) <= DISTINCT_ERROR * 3000 and abs(found.quantile - 499) < 30
    assert (at_once[None].n, at_once[None].n_hll, at_once[7].n, at_once[7].n_hll) == (1, 1, 1, 0)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_heavy_keys_are_joined_as_others(spark, how):
    rng = random.Random(5)
    left = spark.createDataFrame([(k, rng.choice([1] * 8 + [2, 3, 99, None])) for k in range(3000)], "id long, k long")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (None, "e"), (50, "f")], "k long, v string")
    plain = left.join(right, "k", how)
    found = skew_join(left, right, on="k", how=how)
    assert found.columns == plain.columns and sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
    assert skew_join(left.where("false"), right, on="k", how=how).count() == 0
    with pytest.raises(ValueError, match="inner"):
        skew_join(left, right, on="k", how="full")


def test_a_heavy_key_is_read_by_many_tasks(spark):
    left = spark.range(40_000).selectExpr("id", "if(id % 10 = 0, id, -1) as k")
    right = left.select("k").distinct().withColumn("v", F.lit(1))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        read = [r["count"] for r in skew_join(left, right, on="k").groupBy(F.spark_partition_id()).count().collect()]
        plain = [r["count"] for r in left.join(right, "k").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert sum(read) == sum(plain) == 40_000 and max(plain) > 36_000 and max(read) < 4 * median(read)


def test_variants_of_odd_texts(spark):
    texts = [None, "", "{", "null", "7", '"x"', '{"a": 1}', '{"a": "2"}', '{"a": [1, {"b": 2.5}]}', '{"a": null, "c": true}', "[1, 2]"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").withColumn("v", as_variant(F.col("t")))
    found = {r.id: (r.none, r.a, r.b) for r in rows.select("id", F.col("v").isNull().alias("none"), field(F.col("v"), "$.a", "int").alias("a"), field(F.col("v"), "$.a[1].b", "double").alias("b")).collect()}
    assert [k for k, f in found.items() if f[0]] == [0, 1, 2]
    assert {k: f[1] for k, f in found.items() if f[1] is not None} == {6: 1, 7: 2} and {k: f[2] for k, f in found.items() if f[2] is not None} == {8: 2.5}
    assert shape_of(rows.where("id in (6, 9)"), "v") == "OBJECT<a: BIGINT, c: BOOLEAN>" and "VARIANT" in shape_of(rows, "v")


def test_row_groups_are_skipped(spark, tmp_path):
    rows = pa.table({"id": range(1000), "name": [f"n{k:04}" for k in range(1000)], "half": [None if k < 500 else k / 2 for k in range(1000)]})
    for k in range(2):
        pq.write_table(rows.slice(500 * k, 500), tmp_path / f"{k}.parquet", row_group_size=100)
    register_row_groups(spark)
    df = spark.read.format("row_groups").load(str(tmp_path))
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, spark.read.parquet(str(tmp_path)).collect()), key=lambda r: r[0])
    for where in ("id < 150", "id = 777", "id in (5, 905)", "name >= 'n0950'", "half > 400", "id > 2000", "id <= 3 and name > 'n0001'", "half is null"):
        assert df.where(where).count() == spark.read.parquet(str(tmp_path)).where(where).count(), where
    reader = GroupReader(str(tmp_path), df.schema)
    list(reader.pushFilters([LessThan(("id",), 150)]))
    assert [(p.path[-9:], p.group) for p in reader.partitions()] == [("0.parquet", 0), ("0.parquet", 1)]
    assert df.where("id < 150").rdd.getNumPartitions() == 2 and df.rdd.getNumPartitions() == 10
    with pytest.raises(Exception, match="no Parquet"):
        spark.read.format("row_groups").load(str(tmp_path / "none*")).count()


def test_row_groups_as_a_stream(spark, tmp_path):
    register_row_groups(spark)
    (tmp_path / "in").mkdir()
    total = 0
    for k in range(3):
        pq.write_table(pa.table({"id": range(100 * k, 100 * k + 50)}), tmp_path / "in" / f"{k}.parquet", row_group_size=20)
        total += 50
        stream = spark.readStream.format("row_groups").load(str(tmp_path / "in"))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        query.awaitTermination()
        found = [r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()]
        assert len(found) == len(set(found)) == total


def test_streaks(spark):
    rows = spark.createDataFrame([(1, k, v) for k, v in enumerate([1.0, 2.0, 3.0, 3.0, 4.0, None, 5.0, 6.0])] + [(2, 1, 1.0), (None, 1, 1.0), (None, 2, 2.0)], "key long, id long, value double")
    found = Streaks(rows.asTable().partitionBy("key").orderBy("id")).collect()
    assert sorted(map(tuple, found), key=repr) == sorted([(1, 1, 0, 2, 2), (1, 2, 3, 4, 1), (1, 3, 6, 7, 1), (None, 1, 1, 2, 1)], key=repr)


def test_trimmed_means(spark):
    rng = random.Random(3)
    rows = spark.createDataFrame([(rng.choice([1, 1, 1, 2, None]), float(rng.randrange(30))) for _ in range(900)] + [(3, None), (4, 7.0)], "k long, v double")
    pandas = {r.k: r.m for r in rows.groupBy("k").agg(trimmed_mean("v").alias("m")).collect()}
    found = {r.k: r.mean for r in trimmed_means(rows, by="k", value="v").collect()}
    assert found == {k: pytest.approx(m) for k, m in pandas.items() if m is not None} and pandas[3] is None and found[4] == 7.0


def test_rows_before_by_block(spark):
    rng = random.Random(4)
    make = lambda n: [(k, rng.choice([1, 1, 1, 2, None]), rng.randrange(100), rng.choice([1, 2, None])) for k in range(n)]
    left, right = make(200), make(300)
    a, b = (spark.createDataFrame(x, "id long, u long, at long, day int") for x in (left, right))
    found = {r.id: r.before for r in nearest_before(a, b, by="u", time="at", block="day").collect()}
    assert found == {i: sum(None not in (u, d) and (u, d) == (v, e) and s <= t for _, v, s, e in right) for i, u, t, d in left}
