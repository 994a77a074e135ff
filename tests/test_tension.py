"""The index on made-up districts: who publishes, what presses, what counts as a building or a delisting."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from parcelspark.operators.tension import tension_by_district

NOW = datetime(2026, 9, 1)
CUT = datetime(2026, 7, 28)
ROWS = "khet string, street string, deal_type string, status string, first_seen timestamp, delisted_at timestamp, condo_name string"
SNAPS = "taken_at timestamp, khet string, deal_type string, active_count long, avg_psqm double, median_psqm double"


def active(khet, n, buildings, name="{0} tower {1}"):
    return [(khet, None, "sale", "active", NOW - timedelta(days=30), None, name.format(khet, i % buildings)) for i in range(n)]


def gone(khet, n, when, name="{0} other {1}"):
    return [(khet, None, "sale", "inactive", when - timedelta(days=60), when, name.format(khet, i)) for i in range(n)]


def index(spark, rows, snaps=(), since=CUT):
    out = tension_by_district(
        spark.createDataFrame(rows, ROWS), spark.createDataFrame(list(snaps), SNAPS), "sale", F.lit(NOW), None if since is None else F.lit(since)
    )
    return {r.khet: r for r in out.collect()}


def test_few_listings_publish_no_score(spark):
    got = index(spark, active("big", 180, 60) + active("small", 4, 4))
    assert got["big"].tension_score is not None and got["small"].tension_score is None


def test_pressure_lowers_the_score(spark):
    got = index(spark, active("calm", 210, 70) + active("soft", 91, 13))
    assert got["calm"].supply_pressure == 3 and got["soft"].supply_pressure == 7
    assert got["soft"].tension_score < got["calm"].tension_score


def test_buildings_of_delisted_do_not_count(spark):
    got = index(spark, active("a", 72, 12) + gone("a", 33, CUT + timedelta(days=9)) + active("b", 45, 9))
    assert got["a"].supply_pressure == 6 and got["a"].n_delisted == 33


def test_spellings_are_one_building(spark):
    rows = [("a", None, "sale", "active", NOW - timedelta(days=10), None, n) for n in ("Sky Tower", "SKY TOWER, Bangkok", "sky-tower"[:3] + " tower") for _ in range(5)]
    assert index(spark, rows)["a"].n_condos == 1


def test_delistings_before_the_cut_off(spark):
    rows = active("a", 20, 5) + gone("a", 12, CUT - timedelta(days=10))
    assert index(spark, rows)["a"].n_delisted == 0
    assert index(spark, rows, since=None)["a"].n_delisted == 12
    assert index(spark, active("a", 20, 5) + gone("a", 12, CUT + timedelta(days=10)))["a"].n_delisted == 12


def test_momentum_follows_the_median(spark):
    weeks = [NOW - timedelta(days=7 * k) for k in range(4, 0, -1)]
    flat = [(w, "a", "sale", 20, 100.0 + 10 * i, 90.0) for i, w in enumerate(weeks)]
    assert index(spark, active("a", 20, 5), flat)["a"].price_momentum == 0
    mean = [(w, k, d, n, avg, None) for w, k, d, n, avg, _ in flat]
    assert index(spark, active("a", 20, 5), mean)["a"].price_momentum > 0
