"""Keyed state over streams gives what the batch operators give, late rows and restarts included."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from parcelspark.operators import lifecycle as life
from parcelspark.session import ship_package
from parcelspark.streaming import listings as streams

T0 = datetime(2026, 1, 1)
SCAN = "id string, scope string, price double, marker string"
SCANS = [  # day, rows, full
    (0, [("a", "s", 1.0, "sold"), ("b", "s", 2.0, None), ("c", "s", 3.0, None), ("d", "t", 4.0, None)], True),
    (4, [("b", "s", 2.5, None), ("c", "s", 3.0, None)], True),
    (8, [("b", "s", 2.5, None), ("d", "t", None, None)], True),
    (9, [("c", "s", 3.0, None)], False),
    (12, [("b", "s", 2.5, "reserved"), ("e", "s", 9.0, None)], True),
    (16, [("b", "s", 2.5, "reserved"), ("e", "s", 9.0, None)], True),
]


@pytest.fixture()
def feed(spark, tmp_path):
    """The feed's rows of SCANS, one DataFrame a scan, and the state and price events of the batch steps."""
    ship_package(spark)
    state, feeds, prices = spark.createDataFrame([], life.STATE), [], []
    for day, rows, full in SCANS:
        at, scan = F.lit(T0 + timedelta(days=day)).cast("timestamp"), spark.createDataFrame(rows, SCAN)
        feeds.append((streams.sightings(scan, at), streams.closings(state, scan, at, full)))
        state, new = life.apply_scan(state, scan, at, full)
        state = state.checkpoint()
        prices += [(r.id, r.price) for r in new.collect()]
    return feeds, state, prices


def told(df):
    return sorted((r.id, r.scope, r.price, r.status, r.missed, r.first_seen, r.last_seen, r.first_missed, r.delisted_at, r.marker, r.marker_since) for r in df.collect())


def test_scans_in_runs_of_their_own(spark, feed, tmp_path):
    feeds, state, prices = feed
    for (seen, closed), (day, _, _) in zip(feeds, SCANS, strict=True):
        end = streams.tick(spark, F.lit(T0 + timedelta(days=day, hours=1)).cast("timestamp"))
        seen.union(closed).union(end).coalesce(1).write.mode("append").parquet(f"{tmp_path}/feed")
        streams.run_feed(spark, f"{tmp_path}/feed", f"{tmp_path}/out", buckets=3)
    changes = spark.read.parquet(f"{tmp_path}/out")
    assert told(streams.latest(changes)) == told(state)
    assert sorted((r.id, r.price) for r in changes.where("event = 'price'").collect()) == sorted(prices)


def test_late_rows_and_a_restart(spark, feed, tmp_path):
    feeds, state, _ = feed
    parts = []
    for i, (seen, closed) in enumerate(feeds):
        parts += [seen.where("id <> 'b'").union(closed), seen.where("id = 'b'")] if i else [seen.union(closed)]
    parts[1], parts[3] = parts[3], parts[1]  # the second scan comes after a part of the third
    parts[4], parts[5] = parts[5], parts[4]
    write = lambda df: df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/feed")
    for df in parts[:4]:
        write(df)
    run = lambda: streams.run_feed(spark, f"{tmp_path}/feed", f"{tmp_path}/out", late="10 days", files=1, buckets=3)
    run()
    for df in [*parts[4:], streams.tick(spark, F.lit(T0 + timedelta(days=27)).cast("timestamp"))]:
        write(df)
    run()
    assert told(streams.latest(spark.read.parquet(f"{tmp_path}/out"))) == told(state)
    n = spark.read.parquet(f"{tmp_path}/out").count()
    run()  # nothing is new, nothing changes
    assert spark.read.parquet(f"{tmp_path}/out").count() == n


def test_what_has_long_left_is_forgotten(spark, feed, tmp_path):
    feeds, state, _ = feed
    later = spark.createDataFrame([("b", "s", 2.5, None)], SCAN)
    at = F.lit(T0 + timedelta(days=60)).cast("timestamp")
    for df in [a.union(b) for a, b in feeds] + [streams.sightings(later, at).union(streams.closings(state.where("id in ('b', 'e')"), later, at))]:
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/feed")
    streams.tick(spark, F.lit(T0 + timedelta(days=61)).cast("timestamp")).write.mode("append").parquet(f"{tmp_path}/feed")
    streams.run_feed(spark, f"{tmp_path}/feed", f"{tmp_path}/out", buckets=2, keep_days=30)
    held = spark.read.format("statestore").option("stateVarName", "known").load(f"{tmp_path}/out-checkpoint")
    assert {r[0] for r in held.select("user_map_key.id").collect()} == {"b", "d", "e"}


def test_stale_runs_as_a_stream(spark, tmp_path):
    ship_package(spark)
    rows = [(1, "running", 0), (2, "running", 1), (2, "ok", 3), (3, "running", 9), (9, "tick", 14)]
    for run, status, hour in rows:
        df = spark.createDataFrame([(run, status, T0 + timedelta(hours=hour))], "run long, status string, at timestamp")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/runs")
    stream = spark.readStream.schema("run long, status string, at timestamp").parquet(f"{tmp_path}/runs")
    streams.run_state(spark, streams.life_of_runs(stream), f"{tmp_path}/out")
    out = {}
    for r in sorted(spark.read.parquet(f"{tmp_path}/out").collect(), key=lambda r: r.at):
        out[r.run] = r.status
    batch = life.unfinished(spark.createDataFrame([(1, "running", T0), (2, "ok", T0), (3, "running", T0 + timedelta(hours=9))], "run long, status string, started_at timestamp"), F.lit(T0 + timedelta(hours=14)))
    assert {k: v for k, v in out.items() if k < 9} == {r.run: r.status for r in batch.collect()}


def test_packed_buckets_take_late_rows_and_a_restart(spark, feed, tmp_path):
    feeds, state, prices = feed
    end = lambda day: streams.tick(spark, F.lit(T0 + timedelta(days=day)).cast("timestamp"))
    parts = [a.union(b) for a, b in feeds]
    parts[1], parts[2] = parts[2], parts[1]
    run = lambda: streams.run_feed(spark, f"{tmp_path}/feed", f"{tmp_path}/out", late="10 days", files=1, buckets=2, pack=True)
    for i, df in enumerate([*parts, end(27)]):
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/feed")
        if i in (3, len(parts)):
            run()
    changes = spark.read.parquet(f"{tmp_path}/out")
    assert told(streams.latest(changes)) == told(state)
    assert sorted((r.id, r.price) for r in changes.where("event = 'price'").collect()) == sorted(prices)


class Store:
    """A state variable that counts its calls."""

    def __init__(self):
        self.calls, self.held = 0, None

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            if name in ("put", "update"):
                self.held = args[0]
            elif name == "appendList":
                self.held = (self.held or []) + args[0]
            elif name == "clear":
                self.held = None
            return self.held is not None if name == "exists" else self.held

        return call


def test_packed_buckets_are_read_and_written_at_once():
    from types import SimpleNamespace as Of

    import pandas as pd

    stores = {"waiting": Store(), "known": Store()}
    bucket = streams.PackedListings(30)
    bucket.init(Of(getListState=lambda name, _: stores[name], getValueState=lambda name, _: stores[name], registerTimer=lambda ms: None))
    n, day = 5_000, streams.DAY
    for at in (day, 2 * day, 40 * day, 80 * day):
        ids = [f"i{k}" for k in range(n if at == day else n // 2)]
        seen = pd.DataFrame({"kind": "seen", "id": ids, "scope": "s", "price": 1.0 * (at // day), "marker": None, "full": None, "trusted": None, "at_us": at})
        closed = pd.DataFrame([("closed", None, "s", None, None, True, True, at)], columns=seen.columns)
        list(bucket.handleInputRows((0,), iter([seen, closed]), Of(getCurrentWatermarkInMs=lambda: 0)))
        out = pd.concat(bucket.handleExpiredTimer((0,), None, Of(getExpiryTimeInMs=lambda at=at: at // 1000)))
        assert (out["event"] == "price").sum() == len(ids)
    assert len(bucket.load(None)) == n // 2  # the others left 78 days ago
    assert sum(s.calls for s in stores.values()) < 30
