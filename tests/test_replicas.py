"""Replicated tables, editions that are followed, and stalls as sessions."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from parcelspark.operators.ledger import stalled
from parcelspark.sources import replica
from parcelspark.streaming import editions, outages
from parcelspark.streaming.lifecycle import run_once

ROW = "id long, v string"


def table(spark, path, version=None):
    return sorted(((r.id, r.v) for r in replica.read(spark, path, version).collect()), key=lambda r: r[0])


def test_versions_reruns_and_vacuum(spark, tmp_path):
    path = f"{tmp_path}/t"
    put = lambda rows, run: replica.replicate(spark.createDataFrame(rows, ROW), path, "id", run, buckets=4)
    assert put([(i, "a") for i in range(20)], "1")
    assert not put([(99, "z")], "1")  # that run is done
    assert not put([(i, "a") for i in range(5)], "2")  # nothing new
    assert put([(3, "b"), (4, None), (50, "c")], "3")
    want = sorted([(i, "a") for i in range(20) if i not in (3, 4)] + [(3, "b"), (50, "c")])
    rows = dict(table_all := [(r.id, r.v) for r in replica.read(spark, path).collect()])
    assert sorted(r for r in table_all if r[1]) == want and rows[4] is None
    assert not put([(4, None)], "4")  # nulls are equal
    assert table(spark, path, 1) == [(i, "a") for i in range(20)]
    entries = {r.version: r.homes for r in replica.history(spark, path).collect()}
    put([(7, "d")], "5")
    assert sum(entries[2][b] == h for b, h in replica.latest(spark, path).homes.items()) == len(entries[2]) - 1  # one bucket was written
    now = table(spark, path)
    replica.vacuum(spark, path, keep=1)
    assert table(spark, path) == now


def test_a_failed_run_leaves_the_old_table(spark, tmp_path):
    path = f"{tmp_path}/t"
    replica.replicate(spark.createDataFrame([(1, "a"), (2, "a")], ROW), path, "id", "1")
    broken = spark.createDataFrame([(1, "b"), (3, "b")], ROW).withColumn("v", F.when(F.col("id") == 3, F.raise_error(F.lit("torn"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="torn"):
        replica.replicate(broken, path, "id", "2")
    assert table(spark, path) == [(1, "a"), (2, "a")]
    assert replica.replicate(spark.createDataFrame([(1, "b"), (3, "b")], ROW), path, "id", "2")
    assert table(spark, path) == [(1, "b"), (2, "a"), (3, "b")]


def test_the_later_of_two_writers_raises(spark, tmp_path):
    path = f"{tmp_path}/t"
    replica.replicate(spark.createDataFrame([(1, "a")], ROW), path, "id", "1")
    before = replica.latest(spark, path)
    replica.replicate(spark.createDataFrame([(1, "b")], ROW), path, "id", "2")
    with pytest.raises(RuntimeError):
        replica._rewrite(spark.createDataFrame([(1, "c")], ROW), path, "id", "3", before, [], 1, replica.BUCKETS)
    assert table(spark, path) == [(1, "b")]


def test_purge_needs_the_archive(spark, tmp_path):
    path, rows = f"{tmp_path}/t", spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], ROW)
    replica.replicate(rows, path, "id", "1")
    old = F.col("v") < "c"
    assert not replica.purge(spark, path, old, rows.where("id = 1"), "id", "p")
    assert replica.purge(spark, path, old, rows, "id", "p")
    assert table(spark, path) == [(3, None)]
    assert not replica.purge(spark, path, old, rows, "id", "q")


def test_empty_tables_and_other_columns(spark, tmp_path):
    path, empty = f"{tmp_path}/t", spark.createDataFrame([], ROW)
    with pytest.raises(ValueError):
        replica.read(spark, path)
    assert replica.replicate(empty, path, "id", "1") and table(spark, path) == []
    assert not replica.replicate(empty, path, "id", "2")
    with pytest.raises(ValueError):
        replica.replicate(empty.withColumn("x", F.lit(1)), path, "id", "3")


def test_editions_are_taken_once(spark, tmp_path):
    folder, path = tmp_path / "files", f"{tmp_path}/out"
    folder.mkdir()
    put = lambda name, text: (folder / name).write_text(text)
    put("a.json", '{"date": "2026-01", "totals": {"actives": 1}}')
    put("b.json", '{"date": "2026-01", "totals": {"actives": 2}}')
    put("c.json", '{"date": "2026')
    put("d.json", "")
    editions.follow(spark, str(folder), path)
    told = lambda: {r.date: r.totals.actives for r in editions.followed(spark, path).collect()}
    assert told() == {"2026-01": 2}
    editions.follow(spark, str(folder), path)
    assert replica.latest(spark, f"{path}/editions").version == 1
    put("e.json", '{"date": "2026-02", "totals": {"actives": 3}}')
    put("f.json", "[1]")
    editions.follow(spark, str(folder), path)
    assert told() == {"2026-01": 2, "2026-02": 3}
    assert sorted(r.file[-6:] for r in replica.read(spark, f"{path}/refused").collect()) == ["c.json", "f.json"]  # nothing is read from the empty one


def test_stalls_with_late_rows(spark, tmp_path):
    t0 = datetime(2026, 1, 1)
    minute = lambda k, *ms: [(k, t0 + timedelta(minutes=m)) for m in ms]
    # "a" stalls after 5, but its row of minute 12 comes late and joins two sessions; one of "b" is too late.
    parts = [minute("a", 0, 5) + minute("b", 0), minute("a", 20) + minute("c", 24), minute("a", 12), minute("b", 90), minute("c", 95), minute("b", 3), minute("c", 200)]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, "key string, at timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("key string, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run_once(outages.sessions(stream, "key", "at", 10, "30 minutes"), f"{tmp_path}/out")
    told = sorted((r.key, (r.began - t0).seconds // 60, (r["last"] - t0).seconds // 60, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert told == [("a", 0, 20, 4), ("b", 0, 0, 1), ("b", 90, 90, 1), ("c", 24, 24, 1), ("c", 95, 95, 1)]
    taken = spark.createDataFrame([r for i, p in enumerate(parts) if i != 5 for r in p], "key string, at timestamp")
    ends = {r.key: (r["last"] - t0).seconds // 60 for r in stalled(taken, "key", "at", F.lit(t0 + timedelta(minutes=170)), 10).where("stalled").collect()}
    assert ends == {"a": 20, "b": 90}


def test_sessions_at_just_the_gap_and_outages(spark):
    t0 = datetime(2026, 1, 1)
    rows = spark.createDataFrame([("a", t0 + timedelta(minutes=m)) for m in (0, 10, 20, 31, 31)] + [(None, t0), ("b", None)], "key string, at timestamp")
    assert sorted((str(r.key), r.n) for r in outages.sessions(rows, "key", "at", 10).collect()) == [("None", 1), ("a", 2), ("a", 3)]
    assert [(r.key, r.n) for r in outages.outages(rows, "key", "at", 10).collect()] == [("a", 3)]
