"""The nearest places at any distance, against brute force."""

import math
import random

import pytest

from parcelspark.operators.proximity import nearest, nearest_lines, school_transit_screen


def metres(a, b, c, d):
    x = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6_371_000.0 * math.asin(math.sqrt(min(1.0, x)))


@pytest.mark.parametrize("k", [1, 2, 100])
def test_nearest_at_any_distance(spark, k):
    rng = random.Random(7)
    places = [(f"p{i}", 13.7 + rng.uniform(-0.2, 0.2), 100.5 + rng.uniform(-0.2, 0.2)) for i in range(40)]
    places += [("north", 60.0, 100.0), ("north by", 60.0, 100.05), ("line", 10.0, -179.99), ("corner", 21.0, 108.0), ("side", 13.7, 105.6)]
    # In the city; 20 degrees away; swapped; zero; high up, where degrees of longitude are short; at the date line.
    points = [(13.71, 100.52), (13.9, 100.9), (33.7, 100.5), (100.5, 13.7), (0.0, 0.0), (60.001, 100.039), (10.0, 179.99), (13.7, 101.2), (17.0, 104.0)]
    got = nearest(spark.createDataFrame(points, "lat double, lng double"), spark.createDataFrame(places, "poi string, poi_lat double, poi_lng double"), k).collect()
    want = {(*p, i + 1): name for p in points for i, (_, name) in enumerate(sorted((metres(*p, a, b), name) for name, a, b in places)[:k])}
    assert {(r.lat, r.lng, r.rank): r.poi for r in got} == want and len(got) == len(want)


def flat_distance(p, a, b):
    kx, ky = 111_320.0 * math.cos(math.radians(13.75)), 111_320.0
    (px, py), (ax, ay), (bx, by) = ((q[1] * kx, q[0] * ky) for q in (p, a, b))
    dx, dy = bx - ax, by - ay
    t = max(0.0, min(1.0, ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
    return math.hypot(px - ax - t * dx, py - ay - t * dy)


@pytest.mark.parametrize("most", [300.0, 500.0, 5_000.0, 60_000.0])
def test_nearest_lines_at_any_reach(spark, most):
    rng = random.Random(3)
    at = lambda: (13.7 + rng.uniform(-0.3, 0.3), 100.5 + rng.uniform(-0.3, 0.3))
    lines = [(f"l{i}", at(), at()) for i in range(12)] + [("dot", (13.7, 100.5), (13.7, 100.5))]
    points = [at() for _ in range(60)] + [(13.7, 100.5), (13.95, 100.5)]
    df = spark.createDataFrame([(n, *a, *b) for n, a, b in lines], "line string, lat1 double, lng1 double, lat2 double, lng2 double")
    got = {(r.lat, r.lng): r.line for r in nearest_lines(spark.createDataFrame(points, "lat double, lng double"), df, most).collect()}
    want = {}
    for p in points:
        d, name = min((flat_distance(p, a, b), n) for n, a, b in lines)
        if d <= most:
            want[p] = name
    assert got == want


def test_screen_by_car_and_far_lines(spark):
    rows = spark.createDataFrame([(1, "a", 13.7, 100.5), (2, "car", 13.7, 100.5), (3, "a", 13.75, 100.5), (4, "a", None, 100.5)], "id int, khet string, lat double, lng double")
    schools = spark.createDataFrame([("s", 13.71, 100.5), ("t", 13.75, 100.51)], "poi string, poi_lat double, poi_lng double")
    metros = spark.createDataFrame([("m", 13.75, 100.503)], "poi string, poi_lat double, poi_lng double")
    lines = lambda first: spark.createDataFrame([("l", first, 100.5, 13.7, 100.49, 13.7, 100.51)], "line string, first_lat double, first_lng double, lat1 double, lng1 double, lat2 double, lng2 double")
    by_car = spark.createDataFrame([("car",)], "khet string")
    got = {r.id: (r.metro, r.line) for r in school_transit_screen(rows, schools, metros, lines(13.7), by_car=by_car).collect()}
    assert got == {1: (None, "l"), 3: ("m", None)}
    assert {r.id for r in school_transit_screen(rows, schools, metros, lines(14.2), by_car=by_car).collect()} == {3}


@pytest.mark.parametrize("k", [1, 3])
def test_a_dense_cell_meets_few_places(spark, k):
    """Thousands of points and places in one large cell, some of them far from all others."""
    rng = random.Random(k)
    at = lambda: (13.70 + rng.random() * 0.038, 100.52 + rng.random() * 0.038)
    places = [(f"p{i:04}", *at()) for i in range(3000)] + [("edge", 13.7399, 100.5599), ("away", 13.2, 100.1)]
    points = [at() for _ in range(300)] + [(13.739, 100.52), (13.3, 100.2), places[0][1:]]
    df = spark.createDataFrame(places, "poi string, poi_lat double, poi_lng double")
    got = nearest(spark.createDataFrame(points, "lat double, lng double"), df, k).collect()
    want = {(*p, i + 1): name for p in points for i, (_, name) in enumerate(sorted((metres(*p, a, b), name) for name, a, b in places)[:k])}
    assert {(r.lat, r.lng, r.rank): r.poi for r in got} == want and len(got) == len(want)
