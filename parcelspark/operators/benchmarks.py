"""Listings against their peers: the benchmark cascade, opportunities, and the enrichment of sale deals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import half_up, leave_one_out, leave_one_out_window
from ..functions.text import building_name
from ..sources.scratch import stage

# Peers that a scope wants, and the quantiles taken.
MIN_PEERS = 5
QUARTILES = {"median_ppsqm": 0.5, "p25_ppsqm": 0.25, "p75_ppsqm": 0.75}


def listing_benchmarks(listings: DataFrame) -> DataFrame:
    """Each active listing against the first scope with five peers: building, bedrooms and area within 20 %; building;
    street. Only the first scope depends on the row's own area and joins rows, within a building and bedroom count; the
    others take quantiles without the row from one pass over each group."""
    rows = listings.where("status = 'active' and price_per_sqm > 0").select(
        "id", "condo_name", "khet", "street", "deal_type", "bedrooms", "area_sqm", "price", "price_per_sqm", "quota"
    )
    rows = stage(rows)  # read for each scope
    peers = rows.where("area_sqm is not null").select(
        F.col("id").alias("pid"), F.col("condo_name").alias("pc"), F.col("deal_type").alias("pd"), F.coalesce("bedrooms", F.lit(-1)).alias("pb"),
        F.col("area_sqm").alias("pa"), F.col("price_per_sqm").alias("pp"),
    )
    # Areas fall into bands of a factor of two: what lies within 20 % is in one or two of them.
    band = lambda c, by=1.0: F.floor(F.log2(F.col(c) * by))
    peers = peers.where("pa > 0").withColumn("pband", band("pa"))
    near = (
        (F.col("condo_name") == F.col("pc")) & (F.col("deal_type") == F.col("pd")) & (F.coalesce("bedrooms", F.lit(-1)) == F.col("pb"))
        & (F.col("band") == F.col("pband")) & (F.col("id") != F.col("pid")) & (F.col("pa") >= F.col("area_sqm") * 0.8) & (F.col("pa") <= F.col("area_sqm") * 1.2)
    )
    bands = F.explode(F.sequence(band("area_sqm", 0.799), band("area_sqm", 1.201))).alias("band")
    own = rows.where("area_sqm > 0").select("id", "condo_name", "deal_type", "bedrooms", "area_sqm", bands).join(peers, near)
    first = own.groupBy("id").agg(F.count("*").alias("n1"), *[F.percentile("pp", F.lit(q)).alias(f"{k}1") for k, q in QUARTILES.items()]).where(F.col("n1") >= MIN_PEERS)

    def scope(key: str, i: int) -> DataFrame:
        part = leave_one_out(rows.where(F.col(key).isNotNull()).select("id", key, "deal_type", "price_per_sqm"), [key, "deal_type"], "price_per_sqm", "id", QUARTILES, MIN_PEERS)
        return part.where(F.col("peers") >= MIN_PEERS).select("id", F.col("peers").alias(f"n{i}"), *[F.col(k).alias(f"{k}{i}") for k in QUARTILES])

    out = rows.join(first, "id", "left").join(scope("condo_name", 2), "id", "left").join(scope("street", 3), "id", "left")
    level = F.when(F.col("n1").isNotNull(), "immeuble_chambres").when(F.col("n2").isNotNull(), "immeuble").when(F.col("n3").isNotNull(), "rue")
    take = lambda k: F.when(F.col("n1").isNotNull(), F.col(f"{k}1")).when(F.col("n2").isNotNull(), F.col(f"{k}2")).otherwise(F.col(f"{k}3"))
    out = out.withColumn("niveau", level).where(F.col("niveau").isNotNull())
    out = out.select(*rows.columns, "niveau", F.coalesce("n1", "n2", "n3").alias("n_comparables"), *[take(k).alias(k) for k in QUARTILES])
    sure = F.when((F.col("niveau") == "immeuble_chambres") & (F.col("n_comparables") >= 8), "forte").when(F.col("niveau") != "rue", "moyenne").otherwise("faible")
    return out.select(
        "*", half_up((F.col("price_per_sqm") / F.when(F.col("median_ppsqm") != 0, F.col("median_ppsqm")) - 1) * 100).cast("int").alias("ecart_pct"),
        F.when(F.col("niveau") == "rue", 30).otherwise(15).alias("seuil_pct"), sure.alias("confiance"),
    )


def opportunities(benchmarks: DataFrame) -> DataFrame:
    """Listings below their threshold and in the lowest quarter of their peers; sorted by confidence, then gap."""
    low = benchmarks.where("ecart_pct <= -seuil_pct and price_per_sqm <= p25_ppsqm")
    rank = F.when(F.col("confiance") == "forte", 1).when(F.col("confiance") == "moyenne", 2).otherwise(3)
    return low.withColumn("position", F.lit("sous le 1er quartile")).orderBy(rank, "ecart_pct", "id")


def bed_bucket(beds: Column) -> Column:
    return F.least(beds, F.lit(4))


def sale_deals(listings: DataFrame, first_prices: DataFrame) -> DataFrame:
    """Sale listings with their discount to the building, else the street, and the yield that like rentals suggest.

    listings: plausible ones of both deals; first_prices: (id, original). Peers share the building (or street) and the
    bedroom bucket, three of them at least; a reference is the mean of the ten middle prices.
    """
    name = building_name(F.col("condo_name"))
    rows = listings.where("price_per_sqm is not null and bedrooms is not null").withColumns({
        "ck": F.when(name != "", F.concat_ws("|", name, bed_bucket(F.col("bedrooms")))),
        "sk": F.when(F.col("street") != "", F.concat_ws("|", F.col("street"), bed_bucket(F.col("bedrooms")))),
    })
    sale_value, rent_value = (F.when(F.col("deal_type") == d, F.col("price_per_sqm")) for d in ("sale", "rent"))
    out = rows.withColumns({"sv": sale_value, "rv": rent_value}).select("id", "khet", "condo_name", "street", "bedrooms", "price", "price_per_sqm", "area_sqm", "deal_type", "ck", "sk", "sv", "rv")
    for key in ("ck", "sk"):  # both values of a key come from one shuffle
        for value in ("sv", "rv"):
            out = leave_one_out_window(out, key, value, "id", f"{key}_{value}", 10, 3)
    out = out.where("deal_type = 'sale'")
    pct = lambda ref: half_up((ref - F.col("price_per_sqm")) / ref * 1000) / 10
    basis = lambda v: F.when(F.col(f"ck_{v}").isNotNull(), "condo").when(F.col(f"sk_{v}").isNotNull(), "street")
    n = F.coalesce("ck_sv_n", "sk_sv_n")
    out = out.join(first_prices.select("id", "original"), "id", "left")
    down = F.when(F.col("original") > F.col("price"), half_up((F.col("original") - F.col("price")) / F.col("original") * 1000) / 10).when(F.col("original") > 0, 0.0)
    return out.select(
        "id", "khet", "condo_name", "street", "bedrooms", "price", "price_per_sqm", "area_sqm",
        pct(F.coalesce("ck_sv", "sk_sv")).alias("market_discount_pct"), basis("sv").alias("compare_basis"),
        pct(F.col("ck_sv")).alias("condo_discount_pct"), pct(F.col("sk_sv")).alias("street_discount_pct"), down.alias("temporal_discount_pct"),
        (half_up(F.coalesce("ck_rv", "sk_rv") * 12 / F.col("price_per_sqm") * 1000) / 10).alias("est_yield_pct"), basis("rv").alias("yield_basis"),
        n.alias("comparable_count"), F.when(n < 5, "low").when(n < 10, "medium").when(n.isNotNull(), "high").alias("confidence"),
    )


def in_category(beds: Column, category: str) -> Column:
    """Bedroom categories 1, 2, 3 and 4+; none holds studios."""
    return beds >= 4 if category == "4+" else beds == int(category)


def best(deals: DataFrame, score: str, category: str, limit: int = 20) -> DataFrame:
    """The `limit` highest scores of a category, ties by id."""
    return deals.where(in_category(F.col("bedrooms"), category) & F.col(score).isNotNull()).orderBy(F.desc(score), "id").limit(limit)


def best_by_district(deals: DataFrame, score: str, category: str, limit: int = 10) -> DataFrame:
    """The `limit` highest scores of each district, with their rank."""
    rows = deals.where(in_category(F.col("bedrooms"), category) & F.col(score).isNotNull() & F.col("khet").isNotNull())
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("khet").orderBy(F.desc(score), "id"))).where(F.col("rank") <= limit)
