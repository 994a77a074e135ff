"""The recurring study: opportunities, delistings, official ratios, constant basket, editions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import half_up, leave_one_out, median_positive, safe_ratio
from ..functions.text import study_name

# The study's parameters.
DISCOUNT_CAP, SUSPECT_DISCOUNT, SUSPECT_YIELD, YIELD_CAP, YIELD_BASE, YIELD_FLOOR = 45.0, 45.0, 10.0, 9.0, 4.5, 5.5
FLAG_DISCOUNT, FLAG_YIELD, MIN_SALES, MIN_RENTS = 40.0, 9.5, 3, 3
BANDS = (3_000_000, 6_000_000, 12_000_000)
SALE_PRICES, RENT_MOST = (800_000, 100_000_000), 200_000
SCREEN_MIN_RENTS, SCREEN_YIELD_CAP, SCREEN_PENALTY, SCREEN_ROWS = 2, 8.5, 2.0, 60


def enriched(listings: DataFrame) -> DataFrame:
    """Sale listings with the median of their building's other sales and its rents: discount, yield, counts, flag."""
    rows = listings.where("price_per_sqm > 0").withColumn("building", study_name(F.col("condo_name"))).where("building <> ''")
    sales = rows.where("deal_type = 'sale'")
    rents = rows.where("deal_type = 'rent'").groupBy("building").agg(F.percentile("price_per_sqm", F.lit(0.5)).alias("rent_med"), F.count("*").alias("n_rent"))
    own = leave_one_out(sales, ["building"], "price_per_sqm", "id", {"others": 0.5}, 1)
    # A building of one or two sales keeps the listing itself in its median.
    whole = sales.groupBy("building").agg(F.percentile("price_per_sqm", F.lit(0.5)).alias("whole"))
    out = own.join(whole, "building").join(rents, "building", "left")
    out = out.withColumn("n_sale", F.col("peers") + 1).withColumn("sale_med", F.when(F.col("n_sale") >= 3, F.col("others")).otherwise(F.col("whole")))
    out = out.fillna(0, ["n_rent"])
    discount = half_up((F.col("sale_med") - F.col("price_per_sqm")) / F.col("sale_med") * 100, 1)
    yield_ = half_up(F.col("rent_med") * 12 / F.col("price_per_sqm") * 100, 1)
    out = out.withColumn("discount_pct", discount).withColumn("yield_pct", yield_)
    flag = (F.coalesce("discount_pct", F.lit(0.0)) > FLAG_DISCOUNT) | (F.coalesce("yield_pct", F.lit(0.0)) > FLAG_YIELD)
    return out.select("id", "khet", "building", "bedrooms", "area_sqm", "price", "price_per_sqm", "lat", "lng", "discount_pct", "yield_pct", F.col("n_sale"), "n_rent", flag.alias("flag"))


def score(rows: DataFrame) -> Column:
    d0, y0 = F.coalesce("discount_pct", F.lit(0.0)), F.coalesce("yield_pct", F.lit(0.0))
    d = F.when(F.col("n_sale") >= MIN_SALES, d0).otherwise(0.0)
    y = F.when(F.col("n_rent") >= MIN_RENTS, y0).otherwise(0.0)
    s = F.least(F.greatest(d, F.lit(0.0)), F.lit(DISCOUNT_CAP)) + F.greatest(F.least(y, F.lit(YIELD_CAP)) - YIELD_BASE, F.lit(0.0)) * 3
    return F.when((d0 > SUSPECT_DISCOUNT) | (y0 > SUSPECT_YIELD), s * 0.25).otherwise(s)


def sale_ok(rows: DataFrame) -> DataFrame:
    """Sales within the study's own bounds of prices."""
    return rows.where(F.col("price").between(*SALE_PRICES))


def rent_ok(rows: DataFrame) -> DataFrame:
    """Rents within the study's own bound; an unknown rent is 0."""
    return rows.where(F.coalesce("price", F.lit(0.0)) <= RENT_MOST)


def study_opportunities(rows: DataFrame, districts: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """The best of each district by score, one to a building. rows: of enriched(); districts: (khet) looked at, all without."""
    rows = sale_ok(rows).join(districts, "khet", "left_semi") if districts is not None else sale_ok(rows)
    good = ((F.col("n_sale") >= MIN_SALES) & (F.col("discount_pct") > 0)) | ((F.col("n_rent") >= MIN_RENTS) & (F.col("yield_pct") >= YIELD_FLOOR))
    rows = rows.where(F.col("khet").isNotNull() & good).withColumn("score", half_up(score(rows), 4))
    one = rows.withColumn("rb", F.row_number().over(W.partitionBy("khet", "building").orderBy(F.desc("score"), "id"))).where("rb = 1")
    top = one.withColumn("rank", F.row_number().over(W.partitionBy("khet").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= limit)
    return top.select("khet", "rank", "id", "building", "discount_pct", "yield_pct", "n_sale", "n_rent", "score", "flag")


def screened(rows: DataFrame, limit: int | None = SCREEN_ROWS) -> DataFrame:
    """The rows of a proximity screen that have a yield and two rents in the building, in the study's order: by capped
    yield, flagged ones two points lower, then by discount."""
    rows = sale_ok(rows).where((F.col("yield_pct") != 0) & (F.col("n_rent") >= SCREEN_MIN_RENTS))
    first = F.least("yield_pct", F.lit(SCREEN_YIELD_CAP)) - F.when(F.col("flag"), SCREEN_PENALTY).otherwise(0.0)
    out = rows.withColumn("sort_yield", first).orderBy(F.desc("sort_yield"), F.coalesce("discount_pct", F.lit(0.0)).desc(), "id")
    return out.limit(limit) if limit else out


def delisting_by_district(active: DataFrame, delisted: DataFrame) -> DataFrame:
    """Per district of delisted sales: rate, median days (zeros left out), median price; actives of sources that delist."""
    sources = delisted.select("source").distinct()
    stock = active.where("deal_type = 'sale' and khet is not null").join(sources, "source", "left_semi").groupBy("khet").agg(F.count("*").alias("active_sale"))
    life = F.greatest(F.floor((F.unix_micros(F.col("delisted_at").cast("timestamp")) - F.unix_micros(F.col("first_seen").cast("timestamp"))) / 86_400e6), F.lit(0))
    gone = delisted.where("khet is not null").groupBy("khet").agg(
        F.count("*").alias("n_delisted"), median_positive(life.cast("double")).alias("median_days_active"), median_positive(F.col("price")).alias("median_price")
    )
    out = gone.join(stock, "khet", "left").fillna(0, ["active_sale"])
    rate = half_up(F.col("n_delisted") / (F.col("n_delisted") + F.col("active_sale")) * 100, 1)
    return out.select("khet", "n_delisted", "active_sale", rate.alias("delist_rate_pct"), "median_days_active", "median_price")


def typology(beds: Column, price: Column) -> Column:
    b = F.when(F.coalesce(beds, F.lit(0)) <= 1, "studio/1BR").when(beds == 2, "2BR").otherwise("3BR+")
    p = F.coalesce(price, F.lit(0.0))
    band = F.when(p < BANDS[0], "<3M").when(p < BANDS[1], "3-6M").when(p < BANDS[2], "6-12M").otherwise(">12M")
    return F.concat_ws(" | ", b, band)


def typology_churn(active: DataFrame, delisted: DataFrame) -> DataFrame:
    sources = delisted.select("source").distinct()
    of = lambda df, n: df.groupBy(typology(F.col("bedrooms"), F.col("price")).alias("typo")).agg(F.count("*").alias(n))
    stock = of(active.where("deal_type = 'sale'").join(sources, "source", "left_semi"), "active")
    out = of(delisted, "n_delisted").join(stock, "typo", "left").fillna(0, ["active"])
    return out.withColumn("churn_pct", half_up(F.col("n_delisted") / (F.col("n_delisted") + F.col("active")) * 100, 1))


def per_1000(active: DataFrame, population: DataFrame) -> DataFrame:
    """Active listings to 1,000 inhabitants of each official district; none is 0. population: (khet, population)."""
    of = lambda d: F.count(F.when(F.col("deal_type") == d, 1))
    counts = active.where("khet is not null").groupBy("khet").agg(of("sale").alias("s"), of("rent").alias("r"))
    ratio = lambda c: half_up(safe_ratio(F.coalesce(c, F.lit(0)), F.col("population")) * 1000, 2)
    return population.join(counts, "khet", "left").select("khet", "population", ratio(F.col("s")).alias("sale_per_1000"), ratio(F.col("r")).alias("rent_per_1000"))


def building_prices(listings: DataFrame) -> DataFrame:
    """Per building: medians of sale and rent per square metre and the district of its lowest id."""
    rows = listings.withColumn("building", study_name(F.col("condo_name"))).where("building <> '' and price_per_sqm > 0")
    of = lambda d: median_positive(F.when(F.col("deal_type") == d, F.col("price_per_sqm")))
    return rows.groupBy("building").agg(
        F.min_by("khet", F.when(F.col("khet").isNotNull(), F.col("id"))).alias("khet"), half_up(of("sale")).alias("sale_m2"), half_up(of("rent"), 1).alias("rent_m2")
    )


def constant_basket(before: DataFrame, after: DataFrame, least: int = 8) -> DataFrame:
    """Per district the median change of building medians, over buildings of both editions (of building_prices())."""
    a = before.select("building", F.col("khet").alias("ka"), F.col("sale_m2").alias("sa"), F.col("rent_m2").alias("ra"))
    rows = after.join(a, "building").withColumn("khet", F.coalesce("khet", "ka")).where("khet is not null")
    change = lambda x, y: F.when((x != 0) & (y != 0), 100 * (y / x - 1))
    rows = rows.withColumn("v", change(F.col("sa"), F.col("sale_m2"))).withColumn("l", change(F.col("ra"), F.col("rent_m2")))
    out = rows.groupBy("khet").agg(
        F.count("v").alias("n_sale"), median_positive(F.col("v")).alias("dv"), F.count("l").alias("n_rent"), median_positive(F.col("l")).alias("dl")
    )
    return out.where(F.col("n_sale") >= least).select("khet", "n_sale", half_up(F.col("dv"), 4).alias("sale_change_pct"), "n_rent", half_up(F.col("dl"), 4).alias("rent_change_pct"))


def edition_changes(series: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Each key's last edition with the one before and the change in percent."""
    w = W.partitionBy(key).orderBy(at)
    rows = series.withColumn("previous", F.lag(value).over(w)).withColumn("rn", F.row_number().over(W.partitionBy(key).orderBy(F.desc(at)))).where("rn = 1")
    return rows.select(key, at, value, "previous", half_up(safe_ratio(F.col(value) - F.col("previous"), F.col("previous")) * 100, 2).alias("change_pct"))


def sparkline(series: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Each point's level 0 to 7 between its series' least and most; a flat series lies at 3, a single point has none."""
    w = W.partitionBy(key)
    low, high, n = F.min(value).over(w), F.max(value).over(w), F.count(value).over(w)
    level = F.when(n < 2, None).when(high == low, 3).otherwise(F.least(F.lit(7), F.floor((F.col(value) - low) / F.when(high != low, high - low) * 7.99)))
    return series.select(key, at, value, level.cast("int").alias("level"))
