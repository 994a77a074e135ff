"""Proximity, districts, filters and search on the fixture."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine
from ..functions.stats import half_up
from ..operators import filters, proximity, study, yields
from ..sources import fixture as fx
from ..sources.scratch import stage
from .market import ACTIVE_SQL, ENRICH_SQL, active, yield_sql
from .registry import query

HAV = "2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2))))"


def hav(a: str, c: str, b: str, d: str) -> str:
    """Metres between (a, c) and (b, d), latitudes first."""
    return HAV.format(a=a, b=b, c=c, d=d)


D = hav("lat", "lng", "poi_lat", "poi_lng")
POINTS_SQL = f"{ACTIVE_SQL}, {fx.POIS_SQL}, pts as (select distinct lat, lng from act), d as (select lat, lng, category, poi, {D} as m from pts, pois)"


def category(spark, sf, name: str) -> DataFrame:
    return fx.pois(spark, sf).where(F.col("category") == name)


@query("nearest_poi", f"""with {POINTS_SQL}, pd as (select lat, lng, min(m) filter (category = 'school') as sm, min(m) filter (category = 'metro_station') as mm from d group by 1, 2)
    select act.id, floor(sm + 0.5) as school_m, floor(mm + 0.5) as metro_m from act join pd on pd.lat = act.lat and pd.lng = act.lng""")
def nearest_poi(spark, sf):
    rows = active(spark, sf).select("id", "lat", "lng")
    kinds = F.explode(F.array(F.lit("school"), F.lit("metro_station"))).alias("category")
    near = proximity.nearest(rows.select("lat", "lng").distinct().select("lat", "lng", kinds), fx.pois(spark, sf), 1, ("category",))
    of = lambda name: half_up(F.max(F.when(F.col("category") == name, F.col("metres"))))
    near = near.groupBy("lat", "lng").agg(of("school").alias("school_m"), of("metro_station").alias("metro_m"))
    return rows.join(near, ["lat", "lng"], "left").select("id", "school_m", "metro_m")


@query("proximity_card", f"""with {POINTS_SQL}, r as (select lat, lng, category, poi, m, row_number() over (partition by lat, lng, category order by m, poi) as rank from d)
    select lat, lng, category, rank, poi, floor(m + 0.5) as metres from r where rank <= case when category = 'bus_stop' then 1 else 2 end""")
def proximity_card(spark, sf):
    kinds = F.explode(F.array(*[F.lit(x) for x in ("school", "metro_station", "bus_stop")])).alias("category")
    points = active(spark, sf).select("lat", "lng").distinct().select("lat", "lng", kinds)
    out = proximity.nearest(points, fx.pois(spark, sf), F.when(F.col("category") == "bus_stop", 1).otherwise(2), ("category",))
    return out.select("lat", "lng", "category", "rank", "poi", half_up(F.col("metres")).alias("metres"))


@query("cbd_distance", f"with {ACTIVE_SQL} select id, floor({hav('lat', 'lng', '13.7463', '100.5348')} + 0.5) as cbd_m from act")
def cbd_distance(spark, sf):
    return active(spark, sf).select("id", half_up(haversine(F.col("lat"), F.col("lng"), F.lit(13.7463), F.lit(100.5348))).alias("cbd_m"))


FLAT_X, FLAT_Y = "(111320.0 * cos(radians(13.75)))", "111320.0"
LINES_SQL = """lines as (select poi as line, poi_lat as lat1, poi_lng as lng1, lead(poi_lat) over (order by poi_key) as lat2, lead(poi_lng) over (order by poi_key) as lng2 from pois where category = 'metro_station'),
    segs as (select * from lines where lat2 is not null)"""


def segments(spark, sf) -> DataFrame:
    from pyspark.sql import Window as W

    w = W.partitionBy("category").orderBy("poi_key")
    stations = category(spark, sf, "metro_station")
    return stations.select(
        F.col("poi").alias("line"), F.col("poi_lat").alias("lat1"), F.col("poi_lng").alias("lng1"), F.lead("poi_lat").over(w).alias("lat2"), F.lead("poi_lng").over(w).alias("lng2")
    ).where("lat2 is not null")


SEG_T = f"""greatest(0.0, least(1.0, ((lng - lng1) * (lng2 - lng1) * {FLAT_X} * {FLAT_X} + (lat - lat1) * (lat2 - lat1) * {FLAT_Y} * {FLAT_Y}) /
    nullif((lng2 - lng1) * (lng2 - lng1) * {FLAT_X} * {FLAT_X} + (lat2 - lat1) * (lat2 - lat1) * {FLAT_Y} * {FLAT_Y}, 0)))"""
SEG_D = f"sqrt(pow((lng - lng1 - coalesce({SEG_T}, 0) * (lng2 - lng1)) * {FLAT_X}, 2) + pow((lat - lat1 - coalesce({SEG_T}, 0) * (lat2 - lat1)) * {FLAT_Y}, 2))"


BY_CAR = "khet like 'Brand#5%'"
SCREEN_SQL = f"""with {ENRICH_SQL}, {fx.POIS_SQL}, {LINES_SQL}, pts as (select distinct lat, lng from e),
    pd as (select lat, lng, min(m) filter (category = 'school') as near_s, min(m) filter (category = 'metro_station') as mm from (select lat, lng, category, {D} as m from pts, pois) group by 1, 2),
    ld as (select lat, lng, min({SEG_D}) as lm from pts, segs group by 1, 2),
    screen as (select e.*, floor(near_s + 0.5) as school_m, case when mm <= 500 then floor(mm + 0.5) end as metro_m, case when mm > 500 then floor(lm + 0.5) end as line_m,
            coalesce(discount_pct, 0) > 40 or coalesce(yield_pct, 0) > 9.5 as flag
        from e join pd on pd.lat = e.lat and pd.lng = e.lng left join ld on ld.lat = e.lat and ld.lng = e.lng
        where near_s <= 5000 and (mm <= 500 or lm <= 500) and yield_pct <> 0 and n_rent >= 2 and price between 800000 and 100000000 and not coalesce({BY_CAR}, false))"""


def screen_rows(spark, sf) -> DataFrame:
    rows = study.enriched(active(spark, sf))
    by_car = rows.where(BY_CAR).select("khet").distinct()
    lines = segments(spark, sf)
    return proximity.school_transit_screen(rows, category(spark, sf, "school"), category(spark, sf, "metro_station"), lines, by_car=by_car)


@query("school_metro_screen", f"{SCREEN_SQL} select id, school_m, metro_m, line_m, yield_pct, discount_pct from screen")
def school_metro_screen(spark, sf):
    out = study.screened(screen_rows(spark, sf), None)
    whole = lambda c: half_up(F.col(c)).alias(c)
    return out.select("id", whole("school_m"), whole("metro_m"), whole("line_m"), "yield_pct", "discount_pct")


@query("screen_top", f"{SCREEN_SQL} select id, rank from (select id, row_number() over (order by least(yield_pct, 8.5) - case when flag then 2 else 0 end desc, coalesce(discount_pct, 0) desc, id) as rank from screen) where rank <= 60")
def screen_top(spark, sf):
    """The screen's sixty best, in the study's order."""
    from pyspark.sql import Window as W

    top = study.screened(screen_rows(spark, sf))
    w = W.orderBy(F.desc("sort_yield"), F.coalesce("discount_pct", F.lit(0.0)).desc(), "id")  # sixty rows
    return top.select("id", F.row_number().over(w).alias("rank"))


BOX = (13.5995, 100.4495, 0.0601, 0.0401)


def polygons(spark) -> DataFrame:
    """Twenty-five rectangles: the fixture's districts."""
    rows = []
    for i in range(5):
        for j in range(5):
            a, b = BOX[0] + i * BOX[2], BOX[1] + j * BOX[3]
            c, d = a + BOX[2], b + BOX[3]
            rows.append((f"cell {i}-{j}", i * 5 + j, [[[b, a], [d, a], [d, c], [b, c], [b, a]]]))
    return spark.createDataFrame(rows, "district string, place int, rings array<array<array<double>>>")


CELL_I, CELL_J = f"floor((lat - {BOX[0]}) / {BOX[2]})", f"floor((lng - {BOX[1]}) / {BOX[3]})"
CELL_SQL = f"case when {CELL_I} between 0 and 4 and {CELL_J} between 0 and 4 then 'cell ' || cast(cast({CELL_I} as int) as varchar) || '-' || cast(cast({CELL_J} as int) as varchar) end"


@query("point_in_polygon", f"with {ACTIVE_SQL} select id, {CELL_SQL} as district from act")
def point_in_polygon(spark, sf):
    rows = active(spark, sf).select("id", "lat", "lng")
    return rows.join(proximity.locate(rows, polygons(spark)), ["lat", "lng"], "left").select("id", "district")


@query("district_repair", f"""with {ACTIVE_SQL} select case when {CELL_SQL} is null then 'outside' else 'corrected' end as outcome, count(*) as n from act where khet is not null and khet not like 'Brand#1%' group by 1""")
def district_repair(spark, sf):
    rows = active(spark, sf)
    names = rows.where("khet like 'Brand#1%'").select(F.col("khet").alias("district")).distinct()
    return proximity.repair_districts(rows, names, polygons(spark)).groupBy("outcome").agg(F.count("*").alias("n"))


@query("district_labels", f"""with {ACTIVE_SQL} select distinct upper(khet) as label, khet from act where khet is not null""")
def district_labels(spark, sf):
    rows = active(spark, sf).where("khet is not null")
    names = rows.select(F.col("khet").alias("district")).distinct()
    labels = rows.select(F.upper("khet").alias("label"), F.upper("khet").alias("khet")).distinct()
    return proximity.canonical(labels, "khet", names)


NEAR_SQL = f"{POINTS_SQL}, near as (select lat, lng from d group by 1, 2 having min(m) filter (category = 'metro_station') <= 3000 and min(m) filter (category = 'school') <= 5000)"


@query("yields_near_metro", yield_sql("khet", "true", f"with {NEAR_SQL}", "act join near using (lat, lng)"))
def yields_near_metro(spark, sf):
    rows = stage(active(spark, sf).select("id", "deal_type", "price_per_sqm", "bedrooms", "condo_name", "khet", "lat", "lng"))
    points = rows.select("lat", "lng").distinct()
    for name, most in (("metro_station", 3000), ("school", 5000)):  # of the places alone: listings are met once
        points = proximity.nearest_distance(points, category(spark, sf, name), name).where(F.col(f"{name}_m") <= most).select("lat", "lng")
    rows = rows.join(points, ["lat", "lng"], "left_semi")
    out = yields.yields(rows, "khet")
    return out.withColumns({c: half_up(F.col(c), 4) for c in ("sale_median_psqm", "rent_median_psqm")})


FILTERS = {"priceMin": 1_000_000, "areaMax": 80, "bedsMin": 1, "bathsMax": 3, "deal": {"sale"}, "quota": {"foreigner", "thai"}}


@query("filtered_listings", f"""with {ACTIVE_SQL} select id from act where price >= 1000000 and (area_sqm is null or area_sqm <= 80) and coalesce(bedrooms, 0) >= 1 and coalesce(bathrooms, 0) <= 3
    and deal_type in ('sale') and coalesce(quota in ('foreigner', 'thai'), false)""")
def filtered_listings(spark, sf):
    return active(spark, sf).where(filters.matches(filters.from_query_string(filters.to_query_string(FILTERS)))).select("id")


@query("token_search", f"""with {ACTIVE_SQL} select id from act where contains(lower(concat_ws(' ', condo_name, khet, street, source)), 'brand#1') and contains(lower(concat_ws(' ', condo_name, khet, street, source)), 'urgent')""")
def token_search(spark, sf):
    return filters.search(active(spark, sf), "  URGENT brand#1 ").select("id")


@query("suggestions", f"""with {ACTIVE_SQL}, s as (select distinct 0 as place, 'street' as kind, street as value from act union select distinct 1, 'condo', condo_name from act union select distinct 2, 'district', khet from act)
    select kind, min(value) as value from s where contains(lower(value), 'brand#2') group by place, kind, lower(value) order by place, value limit 8""")
def suggestions(spark, sf):
    return filters.suggestions(active(spark, sf), " Brand#2")


@query("facets", f"with {ACTIVE_SQL} select distinct 'khet' as facet, khet as value from act where khet is not null union select distinct 'source', source from act")
def facets(spark, sf):
    return filters.facets(active(spark, sf))


@query("slider_bounds", f"with {ACTIVE_SQL} select " + ", ".join(f"{f}({c}) as {c}_{f}" for c in ("price", "area_sqm", "bedrooms", "bathrooms") for f in ("min", "max")) + " from act")
def slider_bounds(spark, sf):
    return filters.slider_bounds(active(spark, sf)).drop("price_per_sqm_min", "price_per_sqm_max")


@query("sorted_page", f"with {ACTIVE_SQL} select id, area_sqm from act order by area_sqm desc nulls last, id limit 200 offset 200")
def sorted_page(spark, sf):
    return filters.sorted_page(active(spark, sf), "area_sqm", True, 1).select("id", "area_sqm")


ROBOTS = """# every site's file
User-agent: other
Disallow: /

User-agent: *
User-agent: nobody
Disallow:
Allow: /
Disallow: /en/
Allow: /en/1   # the first ten
Disallow: /*page=
Disallow: /p*1
Allow: /p/1
Disallow: /*9$
"""


@query("robots_match", """with u as (select distinct regexp_extract(url, '^https?://([^/]+)', 1) as host, regexp_replace(url, '^https?://[^/]+', '') as path from pages),
    r(weight, pattern, allow) as (values (1, '^/', true), (4, '^/en/', false), (5, '^/en/1', true), (6, '^/.*page=', false), (3, '^/p.*1', false), (4, '^/p/1', true), (2, '^/.*9$', false)),
    m as (select host, path, allow, row_number() over (partition by host, path order by weight desc, allow desc) as rn from u join r on regexp_matches(path, pattern))
    select u.host, u.path, coalesce(allow, true) as allowed from u left join m on m.host = u.host and m.path = u.path and rn = 1""")
def robots_match(spark, sf):
    url = F.col("url")
    urls = fx.table(spark, sf, "pages").select(F.regexp_extract(url, r"^https?://([^/]+)", 1).alias("host"), F.regexp_replace(url, r"^https?://[^/]+", "").alias("path")).distinct()
    files = urls.select("host").distinct().select("host", F.lit(ROBOTS).alias("text"))
    return filters.allowed(urls, filters.robots_rules(files, "collector/1.0"))


MAP_SQL = "coalesce(price, 0) between 1e6 and 2e7 and coalesce(bedrooms, -1) = 2 and near.m <= 3000"


@query("map_filter", f"""with {POINTS_SQL}, near as (select lat, lng, min(m) as m from d where category = 'metro_station' group by 1, 2)
    select act.id from act join near on near.lat = act.lat and near.lng = act.lng where {MAP_SQL}""")
def map_filter(spark, sf):
    rows = active(spark, sf)
    near = proximity.nearest_distance(rows, category(spark, sf, "metro_station"), "metro")
    return rows.join(near, ["lat", "lng"], "left").where(filters.map_matches(1e6, 2e7, 2, 3000)).select("id")


@query("deals_in_scope", f"with {ACTIVE_SQL} select id from act where deal_type = 'sale' and khet = 'Brand#11 District' and price >= 1.5e6 and price <= 2e7 and contains(lower(coalesce(condo_name, '')), 'metro')")
def deals_in_scope(spark, sf):
    rows = active(spark, sf).where("deal_type = 'sale'")
    return filters.in_scope(rows, "Brand#11 District", "1,5", "20", " Metro").select("id")


@query("excluded_names", f"with {ACTIVE_SQL} select id from act where not (contains(lower(concat_ws(' ', condo_name, street)), 'brand#3') or contains(lower(concat_ws(' ', condo_name, street)), 'steel'))")
def excluded_names(spark, sf):
    return filters.without_fragments(active(spark, sf), ["condo_name", "street"], ["Brand#3", "STEEL"]).select("id")
