import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from parcelspark.operators import lifecycle as life
from parcelspark.operators import matching, proximity

T0 = datetime(2026, 1, 1)
SCAN = "id string, scope string, price double, marker string"


def run(spark, scans):
    state, events = spark.createDataFrame([], life.STATE), []
    for day, rows, full in scans:
        state, new = life.apply_scan(state, spark.createDataFrame(rows, SCAN), F.lit(T0 + timedelta(days=day)).cast("timestamp"), full)
        state = state.checkpoint()
        events += [(r.id, r.price) for r in new.collect()]
    return {r.id: r for r in state.collect()}, events


def test_two_absences_delist_since_the_first(spark):
    both, a = [("a", "s", 1.0, None), ("b", "s", 2.0, None)], [("a", "s", 1.0, None)]
    state, _ = run(spark, [(0, both, True), (4, a, True), (8, a, True)])
    assert state["b"].status == "inactive" and state["b"].delisted_at == T0 + timedelta(days=4) and state["a"].status == "active"
    state, _ = run(spark, [(0, both, True), (4, a, True), (6, both, False), (8, a, True)])
    assert state["b"].status == "active" and state["b"].missed == 1


def test_guard_against_a_broken_scan(spark):
    rows = [(x, "s", 1.0, None) for x in "abcde"]
    state, _ = run(spark, [(0, rows, True), (4, rows[:1], True), (8, rows[:1], True)])
    assert all(r.status == "active" and r.missed == 0 for r in state.values())


def test_price_events_only_on_change(spark):
    _, events = run(spark, [(d, [("a", "s", p, None)], True) for d, p in ((0, 1.0), (4, 1.0), (8, 2.0), (12, 2.0))])
    assert events == [("a", 1.0), ("a", 2.0)]


def test_sold_marker_must_persist(spark):
    state, _ = run(spark, [(d, [("a", "s", 1.0, m)], True) for d, m in ((0, None), (4, "sold"), (8, "sold"))])
    assert state["a"].status == "active"
    state, _ = run(spark, [(d, [("a", "s", 1.0, m)], True) for d, m in ((0, None), (4, "sold"), (8, "sold"), (12, "sold"))])
    assert state["a"].status == "sold" and state["a"].delisted_at == T0 + timedelta(days=4)


def test_steps_equal_the_closed_form(spark):
    seen = {"b": (1, 2), "c": (1, 3), "d": (1, 2, 3)} | {x: (1, 2, 3, 4) for x in "aefgh"}
    state, _ = run(spark, [(d, [(k, "s", 1.0, None) for k, v in seen.items() if d in v], True) for d in (1, 2, 3, 4)])
    rows = spark.createDataFrame([(k, "s", n) for k, v in seen.items() for n in v], "id string, scope string, scan int")
    scans = spark.createDataFrame([("s", n, T0 + timedelta(days=n)) for n in (1, 2, 3, 4)], "scope string, scan int, at timestamp")
    closed = {r.id: r for r in life.from_sightings(rows, scans).collect()}
    assert {k: (r.status, r.delisted_at) for k, r in state.items()} == {k: (r.status, r.delisted_at) for k, r in closed.items()}


def test_sold_before_delisted_seen_or_not(spark):
    scan = lambda m, *ids: [(x, "s", 1.0, m if x == "a" else None) for x in ids]
    state, _ = run(spark, [(0, scan("sold", *"abc"), True), (4, scan(None, *"bc"), True), (8, scan(None, *"bc"), True)])
    assert state["a"].status == "sold" and state["a"].delisted_at == T0
    state, _ = run(spark, [(0, scan("reserved", *"abc"), True), (9, scan("reserved", *"abc"), True)])
    assert state["a"].status == "active"  # another marker is no sale
    state, _ = run(spark, [(0, scan("sold", *"abc"), True), (9, scan("sold", *"abc"), False)])
    assert state["a"].status == "active"  # a partial scan settles nothing


def test_the_guard_counts_all_that_was_seen(spark):
    known = [(x, "s", 1.0, None) for x in "abcd"]
    new = [(x, "s", 1.0, None) for x in "wxyz"]
    state, _ = run(spark, [(0, known, True), (4, new, True), (8, new, True)])
    assert state["a"].status == "inactive" and state["w"].status == "active"


def test_photo_similarity(spark):
    sets = [([100, 200], [102, 300]), ([], [1]), ([5], None), ([100, 105], [95, 109]), ([95, 109], [105, 100, 50]), ([100, 100, 100, 100], [100, 100])]
    df = spark.createDataFrame(sets, "a array<int>, b array<int>")
    # Each takes the first that is left and near enough, in the order given; the share is of the first list.
    assert [r[0] for r in df.select(matching.photo_similarity(F.col("a"), F.col("b"))).collect()] == [0.5, 0.0, 0.0, 1.0, 1.0, 0.5]


def test_photo_verdicts(spark):
    rows = [([100, 200], 2, [100, 200], 2), ([100, 200], 3, [100, 200], 2), ([100, 200, 300, 400, 500], 5, [100, 200], 5), ([100], 1, [100, 200], 2), ([100, 900], 2, [100, 200], 2), ([1, 2], None, None, 3)]
    df = spark.createDataFrame(rows, "sizes_a array<int>, count_a int, sizes_b array<int>, count_b int")
    got = [(r.reason, r.same_unit) for r in matching.photo_verdict(df).collect()]
    assert got == [("share_of_photos", True), ("same_photos_other_count", True), ("share_of_photos", False), ("too_few_photos", False), ("too_few_common", False), ("too_few_photos", False)]


def test_stale_runs(spark):
    df = spark.createDataFrame([(1, "running", T0), (2, "running", T0 + timedelta(hours=13)), (3, "ok", T0)], "i int, status string, started_at timestamp")
    got = {r.i: r.status for r in life.unfinished(df, F.lit(T0 + timedelta(hours=14))).collect()}
    assert got == {1: "interrupted", 2: "running", 3: "ok"}


def test_polygon_with_a_hole(spark):
    square = lambda a, b: [[a, a], [b, a], [b, b], [a, b], [a, a]]
    polys = spark.createDataFrame([("x", 0, [square(0.0, 1.0), square(0.4, 0.6)])], "district string, place int, rings array<array<array<double>>>")
    pts = spark.createDataFrame([(0.5, 0.5), (0.2, 0.2), (2.0, 2.0), (None, 1.0)], "lat double, lng double")
    assert [(r.lat, r.district) for r in proximity.locate(pts, polys).collect()] == [(0.2, "x")]


def test_scans_together_are_as_one_by_one_and_move_no_rows(spark):
    rng = random.Random(5)
    rows = [(f"i{k}", rng.choice("st"), *[rng.choice([None, True, True, False]) for _ in range(5)], *[rng.choice([None, 1.0, 2.0]) for _ in range(5)], *[rng.choice([None, "sold", "sold", "reserved"]) for _ in range(5)]) for k in range(200)]
    names = [f"{c}{i}" for c in ("seen", "price", "mark") for i in range(5)]
    df = spark.createDataFrame(rows, "id string, scope string, " + ", ".join(f"{n} {'boolean' if n[0] == 's' else 'double' if n[0] == 'p' else 'string'}" for n in names))
    days = [F.lit(f"2026-01-{1 + 6 * i:02}").cast("timestamp") for i in range(5)]
    state, prices = spark.createDataFrame([], life.STATE), []
    for i, at in enumerate(days):
        state, new = life.apply_scan(state, df.where(f"seen{i}").select("id", "scope", F.col(f"price{i}").alias("price"), F.col(f"mark{i}").alias("marker")), at)
        state, new = state.localCheckpoint(), new.localCheckpoint()
        prices += [tuple(r) for r in new.collect()]
    after, events = life.apply_scans(df, [(at, F.col(f"seen{i}"), F.col(f"price{i}"), F.col(f"mark{i}")) for i, at in enumerate(days)])
    key = lambda x: tuple(map(str, x))
    assert after.columns == state.columns and sorted(map(key, map(tuple, after.collect()))) == sorted(map(key, map(tuple, state.collect())))
    assert sorted(map(key, map(tuple, events.collect()))) == sorted(map(key, prices)) and len(prices) > 100
    assert "hashpartitioning" not in events._jdf.queryExecution().executedPlan().toString()
