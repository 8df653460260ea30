"""The relational queries against DuckDB, small rows for the operators, and the driver's entry."""

import os
import pathlib
import random
import shutil
import subprocess
import sys
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from millrace.functions.columns import exact_sum, histogram, population_variance, words
from millrace.operators.asof import asof_join
from millrace.operators import rangetotals
from millrace.operators.rangejoin import range_join
from millrace.operators.sessions import number_sessions
from millrace.plans.catalog import ORACLES, QUERIES
from millrace.shared import shared_dir
from millrace.sources.files import OPTIONS, read_files, write_files
from millrace.streaming.windows import run_to_end, windowed_counts


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(same_as_duckdb, name):
    assert same_as_duckdb(QUERIES[name], ORACLES[name])


def test_range_join_against_all_pairs(spark):
    rng = random.Random(6)
    points = [(k, rng.choice([None, -1, rng.randint(-70, 70), rng.randint(-(2**40), 2**40)])) for k in range(150)]
    spans = [(k, low, low + rng.choice([0, -3, 1, 2, 7, 8, 9, 100, 2**41])) for k in range(80) for low in [rng.choice([0, -1, 5, rng.randint(-90, 90), -(2**40)])]] + [(90, None, 4), (91, 4, None)]
    found = range_join(spark.createDataFrame(points, "p int, at long"), spark.createDataFrame(spans, "i int, low long, high long"), at="at", low="low", high="high")
    want = sorted((p, i) for p, x in points for i, a, b in spans if None not in (x, a, b) and a <= x < b)
    assert sorted((r.p, r.i) for r in found.collect()) == want and found.columns == ["p", "at", "i", "low", "high"]
    none = spark.createDataFrame([], "i int, low long, high long")
    assert range_join(spark.createDataFrame(points, "p int, at long"), none, at="at", low="low", high="high").count() == 0


def test_range_join_over_all_longs(spark):
    rng = random.Random(7)
    edges = [s * 2**k + d for k in (0, 31, 52, 53, 54, 60, 61, 62, 63) for s in (-1, 1) for d in (-2, -1, 0, 1, 5)]
    edges = sorted({x for x in edges if -(2**63) <= x < 2**63})
    points = list(enumerate(edges))
    spans = [(-(2**63), 2**63 - 1), (2**60 - 1, 2**61 + 99), (-1, 2**63 - 1), (-(2**63), 0)] + [tuple(sorted(rng.sample(edges, 2))) for _ in range(120)]
    spans = [(k, *s) for k, s in enumerate(spans)]
    found = range_join(spark.createDataFrame(points, "p int, at long"), spark.createDataFrame(spans, "i int, low long, high long"), at="at", low="low", high="high")
    assert sorted((r.p, r.i) for r in found.collect()) == sorted((p, i) for p, x in points for i, a, b in spans if a <= x < b)


@pytest.mark.parametrize("bits, rows", [(1, 9), (2, 40), (8, 20_000)])
def test_range_totals_against_all_pairs(spark, monkeypatch, bits, rows):
    monkeypatch.setattr(rangetotals, "ROWS", rows)
    rng = random.Random(bits)
    edges = [-(2**63), -(2**63) + 1, 2**63 - 2, 2**63 - 1, -1, 0, 1, 2**53 + 1]
    points = [(rng.choice([None, *range(-50, 50)]), rng.choice([None, rng.randint(-70, 70), rng.randint(-70, 70), rng.choice(edges)])) for _ in range(300)]
    spans = [(low, low + rng.choice([0, -3, 1, 2, 7, 8, 30, 100])) for _ in range(90) for low in [rng.randint(-90, 90)]]
    spans += [tuple(rng.sample(edges, 2)) for _ in range(30)] + [(-(2**63), 2**63 - 1)] * 3 + [(None, 4), (4, None), (None, None)]
    spans = [(k, *s) for k, s in enumerate(spans)]
    some, around = spark.createDataFrame(points, "p int, at long"), spark.createDataFrame(spans, "i int, low long, high long")
    totals = lambda p, i: rangetotals.range_totals(p, i, at="at", low="low", high="high", least="p", bits=bits)
    found, want = totals(some, around), []
    for i, a, b in spans:
        met = [p for p, x in points if None not in (x, a, b) and a <= x < b]
        want += [(i, a, b, len(met), min((p for p in met if p is not None), default=None))] * bool(met)
    assert sorted(map(tuple, found.collect())) == want and found.columns == ["i", "low", "high", "n_points", "least_point"]
    assert totals(some.where("false"), around).count() == 0 == totals(some, around.where("false")).count()


def test_error_windows_make_no_pairs(spark, tmp_path):
    """Copies of all events at the same times: no step gives more rows than a few times the table's, while the pairs are 400-fold."""
    import duckdb

    con, file, copies = duckdb.connect(), tmp_path / "events.parquet", 20
    con.execute(f"CREATE TABLE one AS SELECT * FROM '{os.environ.get('TEST_SF_DIR', '/root/testdata/sf0.001')}/events.parquet'")
    con.execute(f"CREATE TABLE events AS SELECT * REPLACE (event_id + 50 * (SELECT count(*) FROM one) * k AS event_id) FROM one, range({copies}) r(k)")
    con.execute(f"COPY events TO '{file}' (FORMAT parquet)")
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    before = {store.executionsList().apply(k).executionId() for k in range(store.executionsList().size())}
    found = sorted(map(tuple, QUERIES["prov_error_windows"](spark, str(tmp_path)).collect()))
    assert found == sorted(con.execute(ORACLES["prov_error_windows"]).fetchall())
    bus.waitUntilEmpty()
    most, steps = 0, store.executionsList()
    for step in (steps.apply(k) for k in range(steps.size())):
        if step.executionId() not in before:
            values = store.executionMetrics(step.executionId())
            for metric in (step.metrics().apply(k) for k in range(step.metrics().size())):
                if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    most = max(most, int(values.apply(metric.accumulatorId()).replace(",", "")))
    rows = con.execute("SELECT count(*) FROM events").fetchone()[0]
    assert rows <= most <= 4 * rows < sum(n for _, n, _ in found)


@pytest.mark.parametrize("kind", sorted(OPTIONS))
def test_files_give_back_what_was_written(spark, tmp_path, kind):
    rows = spark.sql("""select * from values (1, 'a', timestamp_ntz'2024-01-01 00:00:00.123456', 1.5D, true), (2, '', timestamp_ntz'1999-12-31 23:59:59', null, false),
        (3, null, null, 0.1D, null), (4, 'x,"y"\\nz \\\\ é', timestamp_ntz'2024-06-30 12:00:00', -1e300D, true) as t(k, s, t, d, b)""")
    for by in ((), ("k",)):
        write_files(rows, f"{tmp_path}/{len(by)}", kind, by=by)
        assert sorted(read_files(spark, f"{tmp_path}/{len(by)}", kind, rows.schema).collect(), key=lambda r: r.k) == rows.collect()


def test_column_functions_on_nulls(spark):
    rows = spark.createDataFrame([(None, None), (3, " a  b a\t"), (5, ""), (None, "b")], "x int, t string")
    assert rows.agg(population_variance(F.col("x")), exact_sum(F.col("x"))).first() == (1.0, 8.0)
    assert rows.where("false").agg(population_variance(F.col("x")), exact_sum(F.col("x"))).first() == (None, None)
    assert [r[0] for r in rows.select(histogram(words(F.col("t")))).collect()] == [{}, {"a": 2, "b": 1}, {}, {"b": 1}]


def test_entry(spark):
    assert entry.entry(spark).columns == ["n_name", "o_orderpriority", "n_items", "revenue"]
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())


def test_asof_ties_and_nulls(spark):
    left = spark.createDataFrame([(1, 10, "a"), (1, 5, "b"), (2, 1, "c"), (None, 3, "d")], "k int, t int, v string")
    right = spark.createDataFrame([(1, 10, 7, 1), (1, 10, 8, 2), (1, 6, 9, 3), (2, 2, 5, 4), (1, 9, None, 5)], "k int, t int, w int, o int")
    found = {r.v: r.w for r in asof_join(left, right, by="k", time="t", value="w", order="o", width=3).collect()}
    assert found == {"a": 8, "b": None, "c": None, "d": None}
    nulls = spark.createDataFrame([(None, 3, 1, 1), (1, None, 2, 2), (None, None, 3, 3)], "k int, t int, w int, o int")
    asks = spark.createDataFrame([(None, 3, "a"), (1, None, "b"), (None, None, "c"), (1, 9, "d")], "k int, t int, v string")
    assert {r.v: r.w for r in asof_join(asks, nulls, by="k", time="t", value="w", order="o", width=1).collect()} == dict.fromkeys("abcd")
    with pytest.raises(ValueError, match="width"):
        asof_join(asks, nulls, by="k", time="t", value="w", order="o")


@pytest.mark.parametrize("width", [1, 7, 10**6])
def test_asof_and_sessions_over_blocks(spark, width):
    """Any width of the blocks that split a key gives the same rows."""
    rng = random.Random(4)
    asks, gives = [(rng.randint(0, 3), rng.randint(0, 60), k) for k in range(200)], [(rng.randint(0, 4), rng.randint(0, 60), k) for k in range(60)]
    left, right = spark.createDataFrame(asks, "k int, t int, v int"), spark.createDataFrame(gives, "k int, t int, w int")
    found = {r.v: r.w for r in asof_join(left, right, by="k", time="t", value="w", order="w", width=width).collect()}
    assert found == {v: max(((t2, w) for k2, t2, w in gives if k2 == k and t2 <= t), default=(0, None))[1] for k, t, v in asks}
    days = spark.createDataFrame([(k, t * 12, v) for k, t, v in asks] + [(1, None, 900), (None, 5, 901), (None, None, 902)], "k int, h int, v int").selectExpr("k", "v", "timestampadd(HOUR, h, timestamp_ntz'2024-01-01') t")
    got = {r.v: r.session for r in number_sessions(days, by="k", time="t", order="v", gap_seconds=86_400, width=width).collect()}
    want, last = {}, {}
    for r in sorted(days.collect(), key=lambda r: (r.k or -1, r.t is not None, r.t or 0, r.v)):
        at, n = last.get(r.k, (None, 0))
        want[r.v] = n + (not n or (at is not None and r.t is not None and (r.t - at).total_seconds() > 86_400))
        last[r.k] = r.t, want[r.v]
    assert got == want


def test_entry_without_the_optional_parts(tmp_path):
    """Without the training-data folders the other queries stay, whether or not the pipeline's file is there."""
    root = pathlib.Path(entry.__file__).parent
    shutil.copytree(root / "millrace", tmp_path / "millrace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import millrace.llm.bpe")
    names = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*sorted(e.queries()), *sorted(e.oracle_sql()))"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True, check=True).stdout.split()
    for _ in range(2):
        assert names() == sorted(QUERIES) + sorted(ORACLES)
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)


def test_shared_folder_of_a_cluster_must_be_set():
    session = lambda master: SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master=master, getConf=dict))
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://host"):
        with pytest.raises(RuntimeError):
            shared_dir(session(master))


def test_sessions_at_the_gap(spark):
    rows = spark.createDataFrame([(1, k, s) for k, s in enumerate([0, 10, 20, 31, 31, 60])], "u int, o int, s long").selectExpr("u", "o", "cast(timestamp_seconds(s) as timestamp_ntz) t")
    found = number_sessions(rows, by="u", time="t", order="o", gap_seconds=10).orderBy("o").collect()
    assert [r.session for r in found] == [1, 1, 1, 2, 2, 3]


def test_stream_of_many_files_nulls_and_none(spark, tmp_path):
    rows = spark.createDataFrame([(0, "a"), (3599, "a"), (3600, "a"), (10, None), (None, "a")], "s long, e string").selectExpr("cast(timestamp_seconds(s) as timestamp_ntz) t", "e")
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = lambda d: windowed_counts(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(d), time="t", by="e")
    found = run_to_end(stream(f"{tmp_path}/in"), "test", ("start", "e")).collect()
    assert sorted((r.start.hour, r.e or "", r.n_events) for r in found) == [(0, "", 1), (0, "a", 2), (1, "a", 1)]
    rows.limit(0).coalesce(1).write.parquet(f"{tmp_path}/none")
    assert run_to_end(stream(f"{tmp_path}/none"), "test", ("start", "e")).count() == 0
