"""The summary of a run, market movers, totals, and the tables and documents of an edition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import half_up
from ..functions.text import study_name
from ..sources.scratch import stage

# Bounds and limits of the summary of a run.
AREA, PRICES = (15, 500), {"sale": (800_000, 100_000_000), "rent": (3_000, 500_000)}
LEAST_PAIRS, LEAST_LISTED, DISCOUNT = 3, 2, -25
LEAST_BUILDINGS, MOST_ROWS = 5, 12
MOVE, LARGE_MOVE = 5, 15


def in_bounds(listings: DataFrame, deal: str) -> DataFrame:
    low, high = PRICES[deal]
    rows = listings.where("status = 'active' and khet is not null and condo_name is not null")
    return rows.where((F.col("deal_type") == deal) & F.col("area_sqm").between(*AREA) & F.col("price").between(low, high))


def by_building(listings: DataFrame, deal: str) -> DataFrame:
    """(khet, condo_name, psqm, price): medians of the buildings."""
    middle = lambda c: F.percentile(c, F.lit(0.5))
    rows = in_bounds(listings, deal)
    return rows.groupBy("khet", "condo_name").agg(middle(F.col("price") / F.col("area_sqm")).alias("psqm"), middle(F.col("price")).alias("price"))


def run_medians(listings: DataFrame, deal: str) -> DataFrame:
    """(khet, psqm, buildings): one building, one voice."""
    return by_building(listings, deal).groupBy("khet").agg(F.percentile("psqm", F.lit(0.5)).alias("psqm"), F.count("*").alias("buildings"))


def run_yields(listings: DataFrame) -> DataFrame:
    """(khet, yield_pct, pairs): the median yield of buildings with sales and rents, of three at least, by their prices."""
    rent = by_building(listings, "rent").select("khet", "condo_name", F.col("price").alias("rent"))
    both = by_building(listings, "sale").where("price > 0").join(rent, ["khet", "condo_name"])
    out = both.groupBy("khet").agg(F.percentile(F.col("rent") * 12 / F.col("price") * 100, F.lit(0.5)).alias("yield_pct"), F.count("*").alias("pairs"))
    return out.where(F.col("pairs") >= LEAST_PAIRS)


def cheap_buildings(listings: DataFrame, limit: int | None = 14) -> DataFrame:
    """Buildings whose mean sale price a square metre lies 25 % or more below their district's median: the cheapest first."""
    own = in_bounds(listings, "sale").groupBy("khet", "condo_name").agg(F.count("*").alias("n"), F.avg(F.col("price") / F.col("area_sqm")).alias("psqm"))
    base = run_medians(listings, "sale").select("khet", F.col("psqm").alias("district_psqm"))
    out = own.where(F.col("n") >= LEAST_LISTED).join(base, "khet").withColumn("gap_pct", (F.col("psqm") - F.col("district_psqm")) / F.col("district_psqm") * 100)
    out = out.where(F.col("gap_pct") <= DISCOUNT).select("khet", "condo_name", "n", "psqm", "district_psqm", "gap_pct")
    return out.orderBy("gap_pct", "khet", "condo_name").limit(limit) if limit else out


def most_pressed(listings: DataFrame, limit: int = MOST_ROWS) -> DataFrame:
    """(khet, listings, buildings, per_building): districts of five buildings or more with the most active sales to one."""
    rows = listings.where("deal_type = 'sale' and status = 'active' and khet is not null")
    out = rows.groupBy("khet").agg(F.count("*").alias("listings"), F.count_distinct("condo_name").alias("buildings")).where(F.col("buildings") >= LEAST_BUILDINGS)
    return out.withColumn("per_building", F.col("listings") / F.col("buildings")).orderBy(F.desc("per_building"), "khet").limit(limit)


def against(now: DataFrame, before: DataFrame, key: str, value: str) -> DataFrame:
    """`now` plus `before` and change_pct, null where there was nothing or zero."""
    old = before.select(key, F.col(value).alias("before"))
    return now.join(old, key, "left").withColumn("change_pct", (F.col(value) - F.col("before")) / F.when(F.col("before") != 0, F.col("before")) * 100)


def movers(now: DataFrame, before: DataFrame, key: str, value: str) -> DataFrame:
    """(key, before, value, change_pct, severity, ticket): changes of over 5 % are low, over 15 % medium with a ticket."""
    moved = F.abs("change_pct")
    out = against(now, before, key, value).where(moved > MOVE)
    return out.select(key, "before", value, half_up(F.col("change_pct"), 1).alias("change_pct"), F.when(moved > LARGE_MOVE, "medium").otherwise("low").alias("severity"), (moved > LARGE_MOVE).alias("ticket"))


def totals(actives: DataFrame) -> DataFrame:
    """(actives, sales, rents, condos), condos by their normalised name."""
    of = lambda d: F.count(F.when(F.col("deal_type") == d, 1))
    return actives.agg(F.count("*").alias("actives"), of("sale").alias("sales"), of("rent").alias("rents"), F.count_distinct(study_name(F.col("condo_name"))).alias("condos"))


# Editions


#: Buildings of one document: a document is made, written and read whole, each by one task.
BUILDINGS_A_PIECE = 10_000


def edition(totals_: DataFrame, stats: DataFrame, tension: DataFrame, buildings: DataFrame, date: str, version: int, least_delisted: int = 3, a_piece: int = BUILDINGS_A_PIECE) -> DataFrame:
    """Rows of sources.files.EDITION: the document of an edition, where the tables' rows are maps, as its readers want it,
    and `piece`, a number. The first document has all but the buildings that are too many for one: they lie in
    further ones of about `a_piece` buildings each, with `piece_of` in place of the date and nothing but the buildings."""
    buildings = stage(buildings)
    pieces = max(1, -(-buildings.count() // a_piece))

    def as_map(df: DataFrame, key: str, fields: dict[str, str], name: str, by: tuple[Column, ...] = ()) -> DataFrame:
        entry = F.struct(F.col(key), F.struct(*[F.col(c).cast(k).alias(n) for n, (c, k) in fields.items()]))
        return df.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias(name))

    stat = {n: (n, k) for n, k in (("sale_psqm", "double"), ("rent_psqm", "double"), ("yield_wc", "double"), ("paired", "bigint"), ("sale_condos", "bigint"), ("rent_condos", "bigint"))}
    parts = [
        totals_.select(F.struct("*").alias("totals")), as_map(stats, "khet", stat, "khet_stats_01"),
        as_map(tension.where((F.col("n_delisted") >= least_delisted) & F.col("khet").isNotNull()), "khet", {"rate": ("delist_rate_pct", "double"), "n": ("n_delisted", "bigint")}, "tension_by_khet"),
    ]
    head = parts[0]
    for part in parts[1:]:
        head = head.join(F.broadcast(part))  # one row each
    piece = F.pmod(F.xxhash64("building"), F.lit(pieces)).alias("piece")
    medians = as_map(buildings, "building", {"khet": ("khet", "string"), "sale_m2": ("sale_m2", "double"), "rent_m2": ("rent_m2", "double")}, "condo_medians", (piece,))
    none = F.map_from_arrays(F.array(), F.array()).cast(medians.schema["condo_medians"].dataType)
    # The first document is there without buildings too.
    out = buildings.sparkSession.range(1).select(F.col("id").alias("piece")).join(F.broadcast(head)).join(medians, "piece", "full")
    first, of = F.col("piece") == 0, F.lit(date)
    return out.select(
        "piece", F.when(first, of).alias("date"), F.when(~first, of).alias("piece_of"), F.lit(version).alias("config_version"), "totals", "khet_stats_01", "tension_by_khet",
        F.coalesce("condo_medians", none).alias("condo_medians"),
    )


def plain_district(name: str | Column) -> Column:
    return F.replace(F.col(name) if isinstance(name, str) else name, F.lit(" District"), F.lit(""))


def wide_table(stats: DataFrame, tension: DataFrame, population: DataFrame) -> DataFrame:
    """One row for each district of an edition with all its figures, the dearest first."""
    out = stats.join(tension.select("khet", "n_delisted", "delist_rate_pct"), "khet", "left").join(population, "khet", "left")
    return out.orderBy(F.coalesce("sale_psqm", F.lit(0.0)).desc(), "khet").select(
        plain_district("khet").alias("district"), "sale_psqm", "rent_psqm", "yield_wc", "sale_condos", "rent_condos", "paired", F.col("low_sample").cast("int").alias("low_sample"),
        "n_delisted", "delist_rate_pct", "population", "sale_per_1000", "rent_per_1000",
    )


def tidy_series(editions: DataFrame) -> DataFrame:
    """(date, district, sale_psqm, rent_psqm, yield_wc, paired, delist_rate_pct, config_version): all editions, all districts."""
    rows = editions.where("piece_of is null").select("date", "config_version", "tension_by_khet", F.explode("khet_stats_01").alias("khet", "s"))
    rate = F.try_element_at("tension_by_khet", F.col("khet")).rate
    return rows.select("date", plain_district("khet").alias("district"), "s.sale_psqm", "s.rent_psqm", "s.yield_wc", "s.paired", rate.alias("delist_rate_pct"), "config_version")


def pivoted(series: DataFrame, districts: list[str], value: str) -> DataFrame:
    """One row for each date, a column for each of the districts."""
    return series.where(F.col("district").isin(districts)).groupBy("date").pivot("district", districts).agg(F.first(value))


def evolution(editions: DataFrame, transfers: DataFrame | None = None) -> DataFrame:
    """(khet, date, before_date, sale_psqm, sale_change_pct, yield_wc, yield_change, rate, rate_change, transfers,
    transferred) of the last edition against the one before it.

    Nothing where there is one edition only or where the last two agree in totals and district figures: a table of zeros
    would read as a stable market. transfers: (date, n) of data carried over; those between the editions are counted, as
    they move figures without the market.
    """
    w = W.orderBy(F.desc("date"), F.desc("file"))  # one row for each edition
    last = editions.where("piece_of is null").withColumn("rn", F.row_number().over(w)).where("rn <= 2")
    a, b = (last.where(F.col("rn") == n).select(*[F.col(c).alias(f"{c}_{s}") for c in ("date", "totals", "khet_stats_01", "tension_by_khet")]) for n, s in ((2, "a"), (1, "b")))
    as_text = lambda c: F.to_json(F.col(c)) if c.startswith("totals") else F.to_json(F.array_sort(F.map_entries(c)))
    both = a.join(b).where(~((as_text("totals_a") == as_text("totals_b")) & (as_text("khet_stats_01_a") == as_text("khet_stats_01_b"))))
    keys = F.array_distinct(F.concat(*[F.map_keys(f"{c}_{s}") for c in ("khet_stats_01", "tension_by_khet") for s in "ab"]))
    rows = both.withColumn("khet", F.explode(keys))
    of = lambda c, s: F.try_element_at(f"{c}_{s}", F.col("khet"))
    stat, rate = lambda s: of("khet_stats_01", s), lambda s: of("tension_by_khet", s).rate
    diff = lambda x, y, n: half_up(F.when(x.isNotNull() & y.isNotNull(), y - x), n)
    share = F.when((stat("a").sale_psqm != 0) & (stat("b").sale_psqm != 0), (stat("b").sale_psqm - stat("a").sale_psqm) / stat("a").sale_psqm * 100)
    out = rows.select(
        "khet", F.col("date_b").alias("date"), F.col("date_a").alias("before_date"), stat("b").sale_psqm.alias("sale_psqm"), half_up(share, 1).alias("sale_change_pct"),
        stat("b").yield_wc.alias("yield_wc"), diff(stat("a").yield_wc, stat("b").yield_wc, 2).alias("yield_change"), rate("b").alias("rate"), diff(rate("a"), rate("b"), 1).alias("rate_change"),
    )
    if transfers is None:
        return out.withColumns({"transfers": F.lit(0).cast("long"), "transferred": F.lit(0).cast("long")})
    day = F.substring("date", 1, 10)
    moved = transfers.select(day.alias("day"), "n").join(both.select("date_a", "date_b"), (F.col("day") > F.col("date_a")) & (F.col("day") <= F.col("date_b")))
    moved = moved.agg(F.count("*").alias("transfers"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("transferred"))
    return out.join(F.broadcast(moved))


SHOWN = (("school1", "schools", 0), ("school2", "schools", 1), ("metro1", "metros", 0), ("metro2", "metros", 1))


def metres_text(m: Column) -> Column:
    """850 m, 1.2 km."""
    return F.when(m < 1000, F.concat(m.cast("long").cast("string"), F.lit(" m"))).when(m.isNotNull(), F.concat(F.format_string("%.1f", m / 1000), F.lit(" km")))


def card(rows: DataFrame) -> DataFrame:
    """What a listing's card shows. rows: listings with arrays `schools`, `metros` of (name, metres), nearest first,
    a struct `bus` and cbd_m; numbers come as texts, unknown ones as null."""
    near = lambda p: F.when(p.isNotNull(), F.concat(p["name"], F.lit(" ("), metres_text(p["metres"]), F.lit(")")))
    shown = {n: near(F.get(F.col(c), F.lit(i))) for n, c, i in SHOWN} | {"bus": near(F.col("bus")), "cbd": metres_text(F.col("cbd_m"))}
    price = lambda c, digits=0: F.when(F.col(c) != 0, F.concat(F.format_number(half_up(F.col(c)), digits), F.lit(" THB")))
    return rows.select(
        "id", F.coalesce(F.when(F.col("condo_name") != "", F.col("condo_name")), F.col("title")).alias("name"), price("price").alias("price"),
        F.when(F.col("area_sqm") != 0, F.concat(F.regexp_replace(F.col("area_sqm").cast("string"), r"\.0$", ""), F.lit(" m²"))).alias("area"), price("price_per_sqm").alias("ppsqm"),
        F.col("bedrooms").cast("string").alias("beds"), F.col("bathrooms").cast("string").alias("baths"), F.when(F.col("deal_type") == "sale", "For sale").otherwise("For rent").alias("deal"),
        F.when(F.col("quota") == "foreigner", "Foreigner").otherwise("Thai").alias("quota"), *[v.alias(k) for k, v in shown.items()],
    )


def with_images(listings: DataFrame, images: DataFrame, key: str = "id") -> DataFrame:
    """`listings` plus `images`: array of (storage_path, width, height, ord) in the order of ord; empty without any.
    images: (listing_id, storage_path, width, height, ord)."""
    item = F.struct("ord", "storage_path", "width", "height")
    own = images.groupBy(F.col("listing_id").alias("__l")).agg(F.array_sort(F.collect_list(item)).alias("images"))
    out = listings.join(own, F.col(key) == F.col("__l"), "left").drop("__l")
    return out.withColumn("images", F.coalesce("images", F.array().cast(own.schema["images"].dataType)))


def nested_details(listings: DataFrame, fields: list[str], name: str = "details") -> DataFrame:
    """The columns `d_<field>` as one struct, null where all of them are."""
    known = F.coalesce(*[F.when(F.col(f"d_{f}").isNotNull(), F.lit(True)) for f in fields])
    nested = F.when(known, F.struct(*[F.col(f"d_{f}").alias(f) for f in fields]))
    return listings.withColumn(name, nested).drop(*[f"d_{f}" for f in fields])
