"""Robust prices and rental yields: medians of building medians, winsorised by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import half_up, median_positive, safe_ratio, winsorised
from ..functions.text import building_name, study_name

MIN_PAIRED, LOW_SAMPLE = 5, 20


def stratum(beds: Column, name: str) -> Column:
    """Bedroom strata 0-1, 2, 3+ and all; unknown bedrooms only in all."""
    return {"0-1": beds <= 1, "2": beds == 2, "3+": beds >= 3, "all": F.lit(True)}[name]


def building_medians(rows: DataFrame, group: str) -> DataFrame:
    """(group, deal_type, building, median_psqm, n): an unnamed listing is a building of its own, '#id'."""
    rows = rows.where(F.col("price_per_sqm") > 0)
    name = building_name(F.col("condo_name"))
    rows = rows.withColumn("building", F.when(name != "", name).otherwise(F.concat(F.lit("#"), "id")))
    clamped = winsorised(rows, [group, "deal_type"], "price_per_sqm", "clamped")
    return clamped.groupBy(group, "deal_type", "building").agg(median_positive(F.col("clamped")).alias("median_psqm"), F.count("*").alias("n"))


def yields(listings: DataFrame, group: str, beds: str = "all") -> DataFrame:
    """One row per group: prices, rents and the gross yield, from paired buildings if there are five, else a ratio."""
    rows = listings.where(F.col(group).isNotNull() & (F.col(group) != "") & stratum(F.col("bedrooms"), beds))
    groups = rows.select(group).distinct()
    sale, rent = F.col("deal_type") == "sale", F.col("deal_type") == "rent"
    per = building_medians(rows, group)
    both = per.groupBy(group, "building").agg(
        F.max(F.when(sale, F.col("median_psqm"))).alias("sale"), F.max(F.when(rent, F.col("median_psqm"))).alias("rent"),
        F.sum(F.when(sale, F.col("n"))).alias("ns"), F.sum(F.when(rent, F.col("n"))).alias("nr"),
    )
    paired = F.when(~F.col("building").startswith("#"), safe_ratio(F.col("rent") * 12, F.col("sale")) * 100)
    out = both.groupBy(group).agg(
        F.coalesce(F.sum("ns"), F.lit(0)).alias("n_sale"), F.coalesce(F.sum("nr"), F.lit(0)).alias("n_rent"),
        F.count("sale").alias("n_sale_bldg"), F.count("rent").alias("n_rent_bldg"), F.count(paired).alias("n_paired"),
        median_positive(F.col("sale")).alias("sale_median_psqm"), median_positive(F.col("rent")).alias("rent_median_psqm"),
        median_positive(paired).alias("__paired"),
    )
    out = groups.join(out, group, "left").fillna(0, ["n_sale", "n_rent", "n_sale_bldg", "n_rent_bldg", "n_paired"])
    ratio = safe_ratio(F.col("rent_median_psqm") * 12, F.col("sale_median_psqm")) * 100
    enough = F.col("n_paired") >= MIN_PAIRED
    method = F.when(enough, "within-condo").when(ratio.isNotNull(), "ratio")
    return out.select(
        group, "n_sale", "n_rent", "n_sale_bldg", "n_rent_bldg", "n_paired", "sale_median_psqm", "rent_median_psqm",
        half_up(F.when(enough, F.col("__paired")).otherwise(ratio), 1).alias("gross_yield_pct"), method.alias("yield_method"),
        ((F.col("n_sale_bldg") < LOW_SAMPLE) | (F.col("n_rent_bldg") < LOW_SAMPLE)).alias("low_sample"),
    )


def study_stats(listings: DataFrame, districts: DataFrame | None = None, beds: str = "0-1") -> DataFrame:
    """The study's district table: winsorised per building, yield only from five paired buildings.

    districts: a whitelist (khet); an absent one filters nothing. Listings without a building name share one.
    """
    rows = listings.where(F.col("khet").isNotNull() & stratum(F.col("bedrooms"), beds) & (F.col("price_per_sqm") > 0))
    if districts is not None:
        rows = rows.join(districts, "khet", "left_semi")
    rows = rows.withColumn("building", study_name(F.col("condo_name")))
    clamped = winsorised(rows, ["khet", "deal_type", "building"], "price_per_sqm", "clamped")
    sale, rent = F.col("deal_type") == "sale", F.col("deal_type") == "rent"
    per = clamped.groupBy("khet", "building").agg(
        median_positive(F.when(sale, F.col("clamped"))).alias("sale"), median_positive(F.when(rent, F.col("clamped"))).alias("rent")
    )
    paired = safe_ratio(F.col("rent") * 12, F.col("sale")) * 100
    out = per.groupBy("khet").agg(
        F.count("sale").alias("sale_condos"), F.count("rent").alias("rent_condos"), F.count(paired).alias("paired"),
        half_up(median_positive(F.col("sale"))).alias("sale_psqm"), half_up(median_positive(F.col("rent")), 1).alias("rent_psqm"),
        median_positive(paired).alias("__y"),
    )
    return out.select(
        "khet", "sale_condos", "rent_condos", "paired", "sale_psqm", "rent_psqm",
        half_up(F.when(F.col("paired") >= MIN_PAIRED, F.col("__y")), 2).alias("yield_wc"),
        ((F.col("sale_condos") < LOW_SAMPLE) | (F.col("rent_condos") < LOW_SAMPLE)).alias("low_sample"),
    )


def double_median(listings: DataFrame, deal: str, least: int = 5) -> DataFrame:
    """(khet, psqm, buildings): median over raw building names of their medians, districts of `least` buildings."""
    rows = listings.where((F.col("deal_type") == deal) & (F.col("price_per_sqm") > 0) & F.col("khet").isNotNull() & F.col("condo_name").isNotNull())
    per = rows.groupBy("khet", "condo_name").agg(F.percentile("price_per_sqm", F.lit(0.5)).alias("m"))
    out = per.groupBy("khet").agg(F.percentile("m", F.lit(0.5)).alias("psqm"), F.count("*").alias("buildings"))
    return out.where(F.col("buildings") >= least)


def paired_yield(listings: DataFrame, least: int = 5) -> DataFrame:
    """(khet, yield_pct, buildings): median yield of raw building names with both deals, from one pivoted aggregate."""
    rows = listings.where((F.col("price_per_sqm") > 0) & F.col("khet").isNotNull() & F.col("condo_name").isNotNull())
    deal = lambda d: F.percentile(F.when(F.col("deal_type") == d, F.col("price_per_sqm")), F.lit(0.5))
    per = rows.groupBy("khet", "condo_name").agg(deal("sale").alias("s"), deal("rent").alias("r")).where("s > 0 and r > 0")
    out = per.groupBy("khet").agg(F.percentile(F.col("r") * 1200 / F.col("s"), F.lit(0.5)).alias("y"), F.count("*").alias("buildings"))
    return out.where(F.col("buildings") >= least).select("khet", half_up(F.col("y"), 2).alias("yield_pct"), "buildings")
