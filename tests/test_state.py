"""Streams with state over several files, late rows and a restart, against plain Python."""

import datetime as dt
import random

import pytest

from millrace.streaming.state import after_several, closed_sessions, first_seen, keyed_state

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string"


def events(seed, many):
    rng = random.Random(seed)
    rows = [(k, T0 + dt.timedelta(seconds=rng.randrange(40 * 3600), microseconds=rng.randrange(10**6)), rng.choice([1, 1, 1, 2, 3, None]), rng.choice(["view", "purchase", "click"])) for k in range(many)]
    return sorted(rows, key=lambda r: r[1])


class Source:
    """A folder that files come into, and one stream over it that stops and goes on from its log."""

    def __init__(self, spark, path, make):
        self.spark, self.path, self.make, self.files = spark, path, make, 0
        (path / "in").mkdir()

    def run(self, *files):
        for rows in files:
            self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(self.path / f"w{self.files}"))
            part = next((self.path / f"w{self.files}").glob("*.parquet"))
            part.rename(self.path / "in" / f"{self.files:03}.parquet")
            self.files += 1
        stream = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(self.path / "in"))
        out, log = str(self.path / "out"), str(self.path / "log")
        query = self.make(stream).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(map(tuple, self.spark.read.parquet(out).collect()))


def answers(rows, until, hours=5):
    out = []
    for i, at, u, kind in rows:
        if kind == "purchase" and u is not None and at <= until:
            n = sum(v == u and k == "view" and (t, j) < (at, i) and t > at - dt.timedelta(hours=hours) for j, t, v, k in rows)
            if n >= 2:
                out.append((u, i, n))
    return sorted(out)


def test_purchases_after_views(spark, tmp_path):
    """Rows up to an hour late in other files, a stop in between, and rows that are too late."""
    rows = events(1, 400)
    rng = random.Random(2)
    order = sorted(rows, key=lambda r: r[1] + dt.timedelta(minutes=rng.randrange(55)))
    with keyed_state(spark):
        make = lambda s: after_several(s, by="user_id", time="ts", key="event_id", counts="event_type = 'view'", answers="event_type = 'purchase'", within="5 hours", least=2)
        source = Source(spark, tmp_path, make)
        some = source.run(order[:100], order[100:200])
        done = max(r[1] for r in order[:200] if r[2] is not None and r[3] != "click") - dt.timedelta(hours=1)
        assert some == answers(rows, done.replace(microsecond=done.microsecond // 1000 * 1000)) and some
        late = [(9_000, T0 + dt.timedelta(minutes=1), 1, "view"), (9_001, T0 + dt.timedelta(minutes=2), 1, "purchase")]
        found = source.run(order[200:300], order[300:] + late)
    end = max(r[1] for r in rows if r[2] is not None and r[3] != "click") - dt.timedelta(hours=1)
    assert found == answers(rows, end.replace(microsecond=end.microsecond // 1000 * 1000)) and len(found) > 20
    with pytest.raises(RuntimeError, match="stateStore"):
        make(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")))


def test_sessions_over_files(spark, tmp_path):
    rows = [r for r in events(3, 120) if r[2] is not None]
    rng = random.Random(4)
    order = sorted(rows, key=lambda r: r[1] + dt.timedelta(minutes=rng.randrange(50)))
    source = Source(spark, tmp_path, lambda s: closed_sessions(s, by="user_id", time="ts", gap="1 hour"))
    source.run(order[:60])
    found = source.run(order[60:], [(9_000, T0 + dt.timedelta(seconds=1), 3, "view")])
    want, until = [], max(r[1] for r in rows) - dt.timedelta(hours=2)
    for user in (1, 2, 3):
        own = sorted(r[1] for r in rows if r[2] == user)
        runs = [[own[0]]]
        for t in own[1:]:
            runs[-1].append(t) if t - runs[-1][-1] < dt.timedelta(hours=1) else runs.append([t])
        want += [(user, r[0], r[-1], len(r)) for r in runs if r[-1] <= until]
    assert found == sorted(want) and len(found) > 10


def test_copies_and_late_rows(spark, tmp_path):
    """Copies in the same and in later files are dropped, and so are rows later than the watermark."""
    rows = events(5, 90)
    source = Source(spark, tmp_path, lambda s: first_seen(s, keys=("event_id",), time="ts", late="10 hours"))
    source.run(rows[:40] + rows[:10], rows[30:60])
    late = [(9_000, T0 - dt.timedelta(hours=30), 1, "view"), (9_001, rows[-1][1] - dt.timedelta(hours=2), 1, "view")]
    found = source.run(rows[60:], rows[70:] + late)
    assert [r[0] for r in found] == sorted([r[0] for r in rows] + [9_001])
