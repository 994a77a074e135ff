"""The market-tension index of districts and streets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import half_up, mid_rank, shrunk, slope, weighted, middle_means
from ..functions.text import building_name

WEIGHTS = {"absorption": 35.0, "pressure": 25.0, "stock": 20.0, "momentum": 20.0}
MIN_DELISTED, MIN_SNAPSHOTS, MIN_BUILDINGS, MIN_ACTIVE, SHRINK = 3, 3, 3, 10, 20.0


def days(start: Column, end: Column) -> Column:
    """Fractional days between two timestamps."""
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 86_400e6


def raw_measures(listings: DataFrame, group: str, as_of: Column, since: Column | None) -> DataFrame:
    """Per group: n_active, n_delisted, n_condos, pressure, age, tom. since: delistings before it are not counted."""
    active = F.col("status") == "active"
    gone = ~active & F.col("first_seen").isNotNull() & F.col("delisted_at").isNotNull()
    if since is not None:
        gone = gone & (F.col("delisted_at") >= since)
    age, life = days(F.col("first_seen"), as_of), days(F.col("first_seen"), F.col("delisted_at"))
    name = building_name(F.col("condo_name"))
    rows = listings.where(F.col(group).isNotNull() & (F.col(group) != ""))
    ages, lives = middle_means(rows, [group], F.when(active, age), "age"), middle_means(rows, [group], F.when(gone, life), "tom_any")
    out = rows.groupBy(group).agg(
        F.count(F.when(active, 1)).alias("n_active"), F.count(F.when(gone, 1)).alias("n_delisted"),
        F.count_distinct(F.when(active & (name != ""), name)).alias("n_condos"),
        F.count(F.when(gone & (life >= 0), 1)).alias("n_lives"),
    ).join(ages, group, "left").join(lives, group, "left")
    return out.select(
        group, "n_active", "n_delisted", "n_condos",
        F.when(F.col("n_condos") >= MIN_BUILDINGS, F.col("n_active") / F.col("n_condos")).alias("pressure"),
        "age", F.when(F.col("n_lives") >= MIN_DELISTED, F.col("tom_any")).alias("tom"),
    )


def trends(snapshots: DataFrame, group: str) -> DataFrame:
    """Per group the slopes by day of stock and of the price per square metre (median, else mean), and the points."""
    first = W.partitionBy(group)
    rows = snapshots.withColumn("x", days(F.min("taken_at").over(first), F.col("taken_at")))
    price = F.coalesce("median_psqm", "avg_psqm")
    return rows.groupBy(group).agg(
        slope(F.col("active_count").cast("double"), F.col("x"), MIN_SNAPSHOTS).alias("stock_trend"),
        slope(price, F.col("x"), MIN_SNAPSHOTS).alias("price_momentum"), F.count("*").alias("n_snap"),
    )


def indexed(raw: DataFrame, group: str) -> DataFrame:
    """Scores from ranks over all groups, drawn to the market's median by sample size; none under ten active listings.

    One row per group comes in, so the windows over all groups are small."""
    every = W.partitionBy(F.lit(1))
    absorption = F.coalesce("tom", "age")
    ranks = raw.withColumns({
        "__a": 100 - mid_rank(absorption), "__p": 100 - mid_rank(F.col("pressure")), "__s": 100 - mid_rank(F.col("stock_trend")), "__m": mid_rank(F.col("price_momentum")),
    })
    score = weighted([(F.col("__a"), WEIGHTS["absorption"]), (F.col("__p"), WEIGHTS["pressure"]), (F.col("__s"), WEIGHTS["stock"]), (F.col("__m"), WEIGHTS["momentum"])])
    scored = ranks.withColumn("__score", score)
    centre = F.percentile(F.when(F.col("n_active") >= MIN_ACTIVE, F.col("__score")), F.lit(0.5)).over(every)
    scored = scored.withColumn("__centre", centre)
    final = F.when(F.col("n_active") >= MIN_ACTIVE, half_up(shrunk(F.col("__score"), F.col("n_active"), F.col("__centre"), SHRINK)))
    sure = (
        F.when(F.col("n_active") < 3, "low")
        .when((F.col("n_active") >= 8) & ((F.col("n_delisted") >= MIN_DELISTED) | (F.col("n_snap") >= MIN_SNAPSHOTS + 1)), "high")
        .otherwise("medium")
    )
    return scored.select(
        group, "n_active", "n_delisted", "n_condos", half_up(F.col("pressure"), 2).alias("supply_pressure"), half_up(F.col("age")).alias("median_age_days"),
        half_up(F.col("tom")).alias("median_tom_days"), "stock_trend", "price_momentum", final.alias("tension_score"), sure.alias("confidence"),
    )


def tension_by_district(listings: DataFrame, snapshots: DataFrame, deal: str, as_of: Column, since: Column | None) -> DataFrame:
    raw = raw_measures(listings.where(F.col("deal_type") == deal), "khet", as_of, since)
    own = trends(snapshots.where(F.col("deal_type") == deal), "khet")
    return indexed(raw.join(own, "khet", "left").fillna(0, ["n_snap"]), "khet")


def tension_by_street(listings: DataFrame, district: str, deal: str, as_of: Column, since: Column | None) -> DataFrame:
    """Two components only: streets have no snapshots, and the others' weight is shared out."""
    rows = listings.where((F.col("deal_type") == deal) & (F.col("khet") == district))
    raw = raw_measures(rows, "street", as_of, since)
    none = F.lit(None).cast("double")
    out = indexed(raw.withColumns({"stock_trend": none, "price_momentum": none, "n_snap": F.lit(0)}), "street")
    return out.drop("stock_trend", "price_momentum")


def pressure(listings: DataFrame, group: str) -> DataFrame:
    """Active listings per building on sale; null under three buildings."""
    return raw_measures(listings, group, F.lit(None).cast("timestamp"), None).select(group, "n_active", "n_condos", half_up(F.col("pressure"), 4).alias("pressure"))
