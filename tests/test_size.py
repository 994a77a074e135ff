"""What grows with the tables is shared out: no one file, task or group holds it all."""

import re
from pathlib import Path

from pyspark.sql import functions as F

from parcelspark.sources import files


def test_map_files_hold_a_run_of_features_each(spark):
    from parcelspark.plans.editions import map_file

    rows = spark.range(25_000).select(
        F.col("id").alias("place"), F.create_map(F.lit("name"), F.col("id").cast("string"), F.lit("category"), F.lit("school")).alias("properties"),
        F.lit("Point").alias("kind"), F.lit("[1.5,2.5]").alias("coordinates"),
    )
    path = map_file(spark, rows)
    assert len(list(Path(path).rglob("*.txt"))) == 3
    got = files.points(files.features(spark, path))
    assert got.count() == 25_000 and got.select("poi").distinct().count() == 25_000


def test_parts_are_dealt_out_and_texts_cleaned_once(spark):
    from parcelspark.functions import text
    from parcelspark.plans.sites import parts
    from tests.conftest import DATA

    assert parts(spark, DATA).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    df = spark.createDataFrame([("<p>a</p>",)], "t string").select(text.clean_description(F.col("t")).alias("d"))
    assert str(df._jdf.queryExecution().optimizedPlan()).count("<[^>]+>") == 1


def test_a_bucket_of_the_stream_holds_so_many_listings_only():
    from parcelspark.streaming import listings

    assert listings.buckets_for(0) == listings.buckets_for(100_000) == 16
    assert all(n / listings.buckets_for(n) <= 10_000 for n in (600_000, 36_000_000, 216_000_001))


def test_a_label_is_searched_for_once(spark):
    from parcelspark.functions import details

    df = spark.createDataFrame([("Min. Rental Duration 6 Months",)], "t string").select(details.lease_months(F.col("t")).alias("d"))
    assert str(df._jdf.queryExecution().optimizedPlan()).count("regexp_extract(t#") == 1 and df.first().d == 6


def test_an_edition_of_many_buildings_lies_in_pieces(spark, tmp_path):
    from parcelspark.operators import summary

    totals = spark.createDataFrame([(9, 4, 5, 3)], "actives bigint, sales bigint, rents bigint, condos bigint")
    stats = spark.createDataFrame([("A District", 2.0, 1.0, 3.0, 5, 6, 7)], "khet string, sale_psqm double, rent_psqm double, yield_wc double, paired bigint, sale_condos bigint, rent_condos bigint")
    tension = spark.createDataFrame([("A District", 3, 10.0)], "khet string, n_delisted bigint, delist_rate_pct double")
    buildings = spark.range(95).select(F.concat(F.lit("b"), "id").alias("building"), F.lit("A District").alias("khet"), F.col("id").cast("double").alias("sale_m2"), F.lit(1.0).alias("rent_m2"))
    for name, n, a_piece in (("many", 95, 10), ("one", 95, 100), ("none", 0, 10)):
        path = str(tmp_path / name)
        files.write_edition(summary.edition(totals, stats, tension, buildings.limit(n), "2001-12-01", 2, a_piece=a_piece), path)
        docs = files.editions(spark, f"{path}/*/*.txt").collect()
        assert [d.totals.actives for d in docs if d.piece_of is None] == [9] and {d.piece_of for d in docs} <= {None, "2001-12-01"}
        held = [b for d in docs for b in d.condo_medians or ()]
        assert len(held) == len(set(held)) == n
        assert (len(docs) > 5 and max(len(d.condo_medians) for d in docs) < 25) if name == "many" else len(docs) == 1
        assert [r.district for r in summary.tidy_series(files.editions(spark, f"{path}/*/*.txt")).collect()] == ["A"]


def test_groups_without_enough_values_are_not_put_in_order(spark):
    from parcelspark.functions import stats

    df = spark.range(40).select("id", F.when(F.col("id") < 25, "big").otherwise("small").alias("g"), (F.col("id") * 1.0).alias("v"))
    out = stats.winsorised(df, ["g"], "v", "w")
    assert {r.id: r.w for r in out.collect()} == {i: float(min(max(i, 1), 23)) if i < 25 else float(i) for i in range(40)}
    assert "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()


def test_names_and_histories_read_listings_once(spark):
    from parcelspark.plans.registry import QUERIES
    from parcelspark.sources import fixture as fx
    from tests.conftest import DATA

    optimized = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    history = fx.history(spark, DATA)
    assert optimized(history).count("Union") == 0 and optimized(history).count("l_orderkey#") > 0
    older = fx.listings(spark, DATA).where("l_discount > 0.05e0").count()
    assert history.count() == fx.listings(spark, DATA).count() + older
    # Names are told apart before their keys are made.
    assert re.match(r"(Project|Aggregate \[[^,\]]+\],)", optimized(QUERIES["norm_names"](spark, DATA)).strip())


def test_a_page_is_matched_within_its_units(spark):
    from parcelspark.operators import matching

    schema = "id string, condo_name string, khet string, bedrooms int, deal_type string, price double, area_sqm double"
    rows = [(f"{u}{d}{k}", f"Tower {u}", "k", 1, d, 100.0 + k, 30.0 + k) for u in range(20) for d in ("sale", "rent") for k in range(3)] + [("x", None, "k", 1, "sale", 1.0, 30.0)]
    df = spark.createDataFrame(rows, schema)
    page = df.where("id in ('3sale1', '7sale0', 'x')")
    near = matching.same_units(df, page)
    assert near.count() == 12
    want = {r for r in matching.unit_matches(df).collect() if r.id in ("3sale1", "7sale0", "x")}
    assert {r for r in matching.unit_matches(near).collect() if r.id in ("3sale1", "7sale0", "x")} == want and len(want) == 2


def test_listings_near_places_are_made_once(spark):
    from parcelspark.plans.registry import QUERIES
    from tests.conftest import DATA

    assert not [f for f in QUERIES["yields_near_metro"](spark, DATA).inputFiles() if "lineitem" in f]
