"""Run summaries, editions, exports, map files, population and leads: files are written, read back and held against the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import geoprep, proximity, study, summary, yields
from ..operators.matching import same_units, unit_matches
from ..sources import files
from ..sources import fixture as fx
from ..sources.fixture import LISTINGS_SQL
from ..sources.scratch import scratch, stage
from .market import ACTIVE_SQL, GONE_SQL, N2, STUDY_SQL, UNIT_SQL, active, gone, r4, s4
from .places import CELL_SQL, polygons
from .registry import query

C, L = F.col, F.lit

# Run summary

BOUNDS_SQL = f"""{LISTINGS_SQL}, b as (select * from listings where status = 'active' and khet is not null and condo_name is not null and area_sqm between 15 and 500
        and price between case when deal_type = 'sale' then 800000 else 3000 end and case when deal_type = 'sale' then 100000000 else 500000 end),
    m as (select deal_type, khet, condo_name, median(price / area_sqm) as psqm, median(price) as price from b group by 1, 2, 3),
    d as (select deal_type, khet, median(psqm) as psqm, count(*) as buildings from m group by 1, 2)"""


@query("run_medians", f"with {BOUNDS_SQL} select khet, {s4('psqm')} as psqm, buildings from d where deal_type = 'sale'")
def run_medians(spark, sf):
    return summary.run_medians(fx.listings(spark, sf), "sale").select("khet", r4("psqm"), "buildings")


@query("run_yields", f"""with {BOUNDS_SQL} select s.khet, {s4('median(r.price * 12 / s.price * 100)')} as yield_pct, count(*) as pairs from m s join m r on r.khet = s.khet and r.condo_name = s.condo_name and s.deal_type = 'sale' and r.deal_type = 'rent' group by 1 having count(*) >= 3""")
def run_yields(spark, sf):
    return summary.run_yields(fx.listings(spark, sf)).select("khet", r4("yield_pct"), "pairs")


@query("cheap_buildings", f"""with {BOUNDS_SQL}, o as (select khet, condo_name, count(*) as n, avg(price / area_sqm) as psqm from b where deal_type = 'sale' group by 1, 2 having count(*) >= 2)
    select o.khet, condo_name, n, {s4('(o.psqm - d.psqm) / d.psqm * 100')} as gap_pct from o join d on d.khet = o.khet and d.deal_type = 'sale' where (o.psqm - d.psqm) / d.psqm * 100 <= -25""")
def cheap_buildings(spark, sf):
    return summary.cheap_buildings(fx.listings(spark, sf), None).select("khet", "condo_name", "n", r4("gap_pct"))


@query("most_pressed", f"""with {LISTINGS_SQL} select khet, count(*) as listings, count(distinct condo_name) as buildings, {s4('count(*) / count(distinct condo_name)')} as per_building from listings
    where deal_type = 'sale' and status = 'active' and khet is not null group by 1 having count(distinct condo_name) >= 5 order by count(*) / count(distinct condo_name) desc, khet limit 12""")
def most_pressed(spark, sf):
    return summary.most_pressed(fx.listings(spark, sf)).select("khet", "listings", "buildings", r4("per_building"))


EARLY = "first_seen < TIMESTAMP '1997-01-01 00:00:00'"
MOVES_SQL = f"""{LISTINGS_SQL}, n as (select khet, median(price_per_sqm) as v from listings where deal_type = 'sale' and status = 'active' and khet is not null group by 1),
    o as (select khet, median(price_per_sqm) as w from listings where deal_type = 'sale' and status = 'active' and khet is not null and {EARLY} group by 1)"""


@query("market_movers", f"""with {MOVES_SQL} select khet, floor((v - w) / nullif(w, 0) * 1000 + 0.5) / 10 as change_pct, case when abs((v - w) / w * 100) > 15 then 'medium' else 'low' end as severity, abs((v - w) / w * 100) > 15 as ticket
    from n join o using (khet) where abs((v - w) / nullif(w, 0) * 100) > 5""")
def market_movers(spark, sf):
    rows = fx.listings(spark, sf).where("deal_type = 'sale' and status = 'active' and khet is not null")
    of = lambda df: df.groupBy("khet").agg(F.percentile("price_per_sqm", L(0.5)).alias("v"))
    return summary.movers(of(rows), of(rows.where(EARLY)), "khet", "v").select("khet", "change_pct", "severity", "ticket")


@query("study_totals", f"with {ACTIVE_SQL} select count(*) as actives, count(*) filter (deal_type = 'sale') as sales, count(*) filter (deal_type = 'rent') as rents, count(distinct {N2}) as condos from act")
def study_totals(spark, sf):
    return summary.totals(active(spark, sf))


# Editions


def edition_listings(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The active listings with what an edition is made of, and the tension: both computed once, however many editions."""
    rows = stage(active(spark, sf).select("id", "source", "deal_type", "price", "price_per_sqm", "bedrooms", "condo_name", "khet", "first_seen"))
    return rows, stage(study.delisting_by_district(rows, gone(spark, sf)).where("khet is not null"))


def edition_rows(spark, sf) -> DataFrame:
    """Two editions, of the early listings and of all, written as files with a broken one beside them and read back."""
    (rows, tension), path = edition_listings(spark, sf), scratch(spark, "editions")
    for date, part in (("1997-01-01", rows.where(EARLY)), ("2001-12-01", rows)):
        one = summary.edition(summary.totals(part), yields.study_stats(part), tension, study.building_prices(part), date, 2)
        files.write_edition(one, f"{path}/{date}")
    spark.createDataFrame([("{broken",)], "value string").write.text(f"{path}/broken/piece=0")
    return files.editions(spark, f"{path}/*/*/*.txt")


def study_sql(where: str, name: str) -> str:
    """STUDY_SQL over a part of the active listings, as a common table."""
    return f"{name} as ({STUDY_SQL.replace('from act where', f'from act where {where} and')})"


EDITION_SQL = f"""with {study_sql(EARLY, 'ea')}, {study_sql('true', 'eb')}, ac as ({f'with {ACTIVE_SQL} select * from act'}), gn as ({f"with {GONE_SQL} select * from gone"}),
    stock as (select khet, count(*) as n from ac where deal_type = 'sale' and khet is not null and source in (select source from gn) group by 1),
    te as (select gn.khet, count(*) as n, floor(count(*) / (count(*) + coalesce(max(stock.n), 0)) * 1000 + 0.5) / 10 as rate from gn left join stock on stock.khet = gn.khet where gn.khet is not null group by 1 having count(*) >= 3),
    st as (select '1997-01-01' as date, * from ea union all select '2001-12-01', * from eb)"""


@query("edition_series", f"""{EDITION_SQL} select date, replace(st.khet, ' District', '') as district, sale_psqm, rent_psqm, yield_wc, paired, te.rate as delist_rate_pct, 2 as config_version from st left join te on te.khet = st.khet""")
def edition_series(spark, sf):
    return summary.tidy_series(edition_rows(spark, sf))


PIVOTED = ("Brand#11", "Brand#23", "Brand#55")


@query("edition_pivot", f"""{EDITION_SQL} select date, {", ".join(f"max(sale_psqm) filter (khet = '{d} District') as \"{d}\"" for d in PIVOTED)} from st group by 1""")
def edition_pivot(spark, sf):
    return summary.pivoted(summary.tidy_series(edition_rows(spark, sf)), list(PIVOTED), "sale_psqm")


@query("edition_changes", f"""{EDITION_SQL}, k as (select khet from ea union select khet from eb union select khet from te)
    select k.khet, '2001-12-01' as date, '1997-01-01' as before_date, eb.sale_psqm, floor((eb.sale_psqm - ea.sale_psqm) / nullif(ea.sale_psqm, 0) * 1000 + 0.5) / 10 as sale_change_pct, eb.yield_wc,
        floor((eb.yield_wc - ea.yield_wc) * 100 + 0.5) / 100 as yield_change, te.rate, case when te.rate is not null then 0.0 end as rate_change, 2 as transfers, 70 as transferred
    from k left join ea on ea.khet = k.khet left join eb on eb.khet = k.khet left join te on te.khet = k.khet""")
def edition_changes(spark, sf):
    """The last edition against the one before, with what was carried over between them."""
    path = scratch(spark, "transfers")
    lines = ['{"date": "1997-01-01T01:00", "annonces_transferees": 5}', '{"date": "1997-01-02T01:00", "annonces_transferees": 30}', "{bad", '{"date": "2001-12-01", "annonces_transferees": 40}', '{"date": "2002-01-01", "annonces_transferees": 9}']
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    moved = files.log_between(spark, path, "date string, annonces_transferees bigint", "1997-01-01", "2001-12-01").withColumnRenamed("annonces_transferees", "n")
    return summary.evolution(edition_rows(spark, sf), moved)


@query("unchanged_edition", "select 1 as n where false")
def unchanged_edition(spark, sf):
    """Two editions that agree show no changes at all."""
    rows, tension = edition_listings(spark, sf)
    stats, buildings = stage(yields.study_stats(rows)), stage(study.building_prices(rows))
    docs = None
    for date in ("2001-11-01", "2001-12-01"):
        one = summary.edition(summary.totals(rows), stats, tension, buildings, date, 2).withColumn("file", L(f"{date}.json"))
        docs = one if docs is None else docs.union(one)
    return summary.evolution(stage(docs)).select(L(1).alias("n"))


POP_SQL = "pop as (select p_brand || ' District' as khet, cast(1000 * count(*) as bigint) as population from part group by 1)"


@query("wide_table", f"""{EDITION_SQL}, {POP_SQL}, cn as (select khet, count(*) filter (deal_type = 'sale') as s, count(*) filter (deal_type = 'rent') as r from ac where khet is not null group by 1),
        tt as (select gn.khet, count(*) as n, floor(count(*) / (count(*) + coalesce(max(stock.n), 0)) * 1000 + 0.5) / 10 as rate from gn left join stock on stock.khet = gn.khet where gn.khet is not null group by 1)
    select replace(eb.khet, ' District', '') as district, sale_psqm, rent_psqm, yield_wc, sale_condos, rent_condos, paired, cast(low_sample as int) as low_sample, tt.n as n_delisted, tt.rate as delist_rate_pct, population,
        floor(coalesce(s, 0) / population * 1e5 + 0.5) / 100 as sale_per_1000, floor(coalesce(r, 0) / population * 1e5 + 0.5) / 100 as rent_per_1000
    from eb left join tt on tt.khet = eb.khet left join pop on pop.khet = eb.khet left join cn on cn.khet = eb.khet""")
def wide_table(spark, sf):
    return summary.wide_table(*wide_parts(spark, sf))


def wide_parts(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = active(spark, sf)
    people = fx.table(spark, sf, "part").groupBy(F.concat("p_brand", L(" District")).alias("khet")).agg((F.count("*") * 1000).alias("population"))
    return yields.study_stats(rows), study.delisting_by_district(rows, gone(spark, sf)), study.per_1000(rows, people)


@query("csv_export", r"""select 'n,x,t' as value from (select 1) union all select p_partkey || ',' || regexp_replace(regexp_replace(printf('%.2f', p_size / 8.0), '0+$', ''), '\.$', '') || ',' || case p_partkey % 4 when 1 then p_brand when 2 then '"' || p_brand || ', ""A""; b"' when 3 then ' ' || p_brand || ' ' else '' end from part
    union all select 'n;x;t' union all select p_partkey || ';' || replace(regexp_replace(regexp_replace(printf('%.2f', p_size / 8.0), '0+$', ''), '\.$', ''), '.', ',') || ';' || case p_partkey % 4 when 1 then p_brand when 2 then '"' || p_brand || ', ""A""; b"' when 3 then ' ' || p_brand || ' ' else '' end from part""")
def csv_export(spark, sf):
    """A table in both dialects of CSV, as the lines of the files without their byte-order mark: cells with separators,
    quotes and blanks at their ends, and nulls."""
    k, brand = C("p_partkey") % 4, C("p_brand")
    text = F.when(k == 1, brand).when(k == 2, F.concat(brand, L(', "A"; b'))).when(k == 3, F.concat(L(" "), brand, L(" ")))
    rows = fx.table(spark, sf, "part").select(C("p_partkey").alias("n"), (C("p_size") / 8).alias("x"), text.alias("t"))
    lines = None
    for comma in (False, True):
        path = scratch(spark, "csv")
        files.write_csv(rows.coalesce(1), path, comma)
        part = spark.read.text(path).select(F.replace("value", L("﻿"), L("")).alias("value"))
        lines = part if lines is None else lines.union(part)
    return lines


# Map files


#: Features of one map file: files are made and read whole, each by one task.
FEATURES_A_FILE = 10_000


def map_file(spark, features: DataFrame) -> str:
    """GeoJSON files of features (place, properties, kind, coordinates as JSON): one of them for each run of 10,000 places."""
    one = F.concat(L('{"type":"Feature","properties":'), F.to_json("properties"), L(',"geometry":{"type":"'), C("kind"), L('","coordinates":'), C("coordinates"), L("}}"))
    run = F.floor(C("place") / FEATURES_A_FILE).alias("run")
    rows = features.select(run, "place", one.alias("f")).groupBy("run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "f"))), lambda x: x.f), ",").alias("f"))
    path = scratch(spark, "map")
    rows.select("run", F.concat(L('{"type":"FeatureCollection","features":['), "f", L("]}")).alias("value")).write.partitionBy("run").text(path)
    return path


def poi_features(spark, sf) -> DataFrame:
    at = F.to_json(F.array("poi_lng", "poi_lat"))
    return fx.pois(spark, sf).select(C("poi_key").alias("place"), F.create_map(L("category"), C("category"), L("name"), C("poi")).alias("properties"), L("Point").alias("kind"), at.alias("coordinates"))


@query("map_points", f"with {fx.POIS_SQL} select poi, category, poi_lat, poi_lng from pois where category <> 'bus_stop'")
def map_points(spark, sf):
    rows = files.points(files.features(spark, map_file(spark, poi_features(spark, sf))))
    return geoprep.shown(rows, {"school": 10, "metro_station": 11, "bus_stop": 15}, 12.0)


@query("map_lines", """with p as (select s_suppkey as k, s_name as n, 13.6e0 + (s_suppkey % 100) * 3e-3 as y, 1.0045e2 + (s_suppkey % 65) * 3e-3 as x from supplier where s_suppkey % 2 = 0)
    select n as line, y as lat1, x as lng1, y + 1e-2 as lat2, x as lng2 from p union all select n, y + 1e-2, x, y + 1e-2, x + 2e-2 from p""")
def map_lines(spark, sf):
    """Lines of three points each, every second one of another class."""
    y, x, k = 13.6 + (C("s_suppkey") % 100) * 3e-3, 100.45 + (C("s_suppkey") % 65) * 3e-3, C("s_suppkey")
    points = F.array(F.array(x, y), F.array(x, y + 1e-2), F.array(x + 2e-2, y + 1e-2))
    kind = F.create_map(L("category"), F.when(k % 2 == 0, "future_line").otherwise("metro_line"), L("name"), C("s_name"))
    rows = fx.table(spark, sf, "supplier").select(k.alias("place"), kind.alias("properties"), L("LineString").alias("kind"), F.to_json(points).alias("coordinates"))
    return files.line_segments(files.features(spark, map_file(spark, rows))).drop("first_lat", "first_lng")


def district_features(spark) -> DataFrame:
    """The fixture's districts as features: polygons, and every third as a part of several; some with a name of another kind."""
    rows = polygons(spark)
    many = C("place") % 3 == 0
    shape = F.when(many, F.to_json(F.array("rings"))).otherwise(F.to_json("rings"))
    names = F.when(C("place") % 2 == 0, F.create_map(L("name_en"), C("district"), L("name"), L("other"), L("admin_level"), L("6"))).otherwise(F.create_map(L("name"), C("district"), L("name_en"), L(""), L("admin_level"), L("8")))
    return rows.select("place", names.alias("properties"), F.when(many, "MultiPolygon").otherwise("Polygon").alias("kind"), shape.alias("coordinates"))


@query("map_polygons", f"with {ACTIVE_SQL} select id, {CELL_SQL} as district from act")
def map_polygons(spark, sf):
    """Places in polygons that were read from a map file."""
    rows = active(spark, sf).select("id", "lat", "lng")
    read = files.polygons(files.features(spark, map_file(spark, district_features(spark))))
    return rows.join(proximity.locate(rows, read), ["lat", "lng"], "left").select("id", "district")


@query("district_boundaries", """select case when n_nationkey % 2 = 0 then n_name else 'Local ' || n_name end as district, case when n_nationkey % 3 = 0 then 'MultiPolygon' else 'Polygon' end as kind, n_regionkey + 0.5 as lng, n_nationkey + 0.5 as lat
    from nation where n_nationkey % 5 > 0""")
def district_boundaries(spark, sf):
    """Districts out of a map file with a square for each nation, a fifth of them of another administrative level."""
    k, x, y = C("n_nationkey"), C("n_regionkey").cast("double"), C("n_nationkey").cast("double")
    ring = F.array(*[F.array(x + i, y + j) for i, j in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0))])
    many = k % 3 == 0
    names = F.create_map(L("name"), F.when(k % 2 == 0, C("n_name")).otherwise(F.concat(L("Local "), "n_name")), L("name_en"), F.when(k % 2 == 0, C("n_name")), L("admin_level"), F.when(k % 5 == 0, "4").otherwise("6"))
    rows = fx.table(spark, sf, "nation").select(
        k.alias("place"), names.alias("properties"), F.when(many, "MultiPolygon").otherwise("Polygon").alias("kind"),
        F.when(many, F.to_json(F.array(F.array(ring)))).otherwise(F.to_json(F.array(ring))).alias("coordinates"),
    )
    path = map_file(spark, rows)
    read = files.districts(files.features(spark, path)).select("district", "kind")
    middle = files.polygons(files.features(spark, path))
    mean = lambda i: F.round(F.aggregate(F.slice(C("rings")[0], 1, 4), L(0.0), lambda a, p: a + p[i]) / 4, 3)
    return read.join(middle.select("district", mean(0).alias("lng"), mean(1).alias("lat")), "district")


@query("choropleth", f"""with {ACTIVE_SQL}, v as (select {CELL_SQL} as district, count(*) as n from act where {CELL_SQL} like 'cell 0-%' group by 1)
    select 'cell ' || i || '-' || j as district, i * 5 + j as place, coalesce(cast(n as double), -1.0) as value from range(5) a(i) cross join range(5) b(j) left join v on v.district = 'cell ' || i || '-' || j""")
def choropleth(spark, sf):
    rows = active(spark, sf).select("id", "lat", "lng")
    counts = rows.join(proximity.locate(rows, polygons(spark)), ["lat", "lng"]).where("district like 'cell 0-%'").groupBy(C("district").alias("khet")).agg(F.count("*").alias("n"))
    return geoprep.choropleth(polygons(spark), counts, "n")


TAGS = (
    ("metro_station", {"railway": "station", "station": "subway"}), ("train_station", {"railway": "station"}), ("hospital", {"amenity": "hospital"}), ("school", {"amenity": "school", "name": "Park International"}),
    (None, {"amenity": "school", "name": "Village"}), (None, {"amenity": "school", "name": "International", "shop": "yes"}), ("school", {"name": "Shrewsby School"}), ("airport", {"aeroway": "aerodrome"}),
    ("mall", {"shop": "mall", "name:en": "Big"}), (None, {"shop": "mall"}), ("bus_stop", {"highway": "bus_stop"}), ("monument", {"historic": "yes", "name": "Old"}),
)


@query("map_places", f"""with t(i, category) as (values {", ".join(f"({i}, {repr(c) if c else 'null'})" for i, (c, _) in enumerate(TAGS))}),
    e as (select s_suppkey as k, category, i, s_suppkey % 7 as x from supplier join t on t.i = s_suppkey % {len(TAGS)} where category is not null)
    select category, case i when 3 then 'Park International' when 6 then 'Shrewsby School' when 8 then 'Big' when 11 then 'Old' end as name, cast(100.5e0 + x as double) as lng, 13.25e0 as lat from e group by all""")
def map_places(spark, sf):
    """Elements with tags as places: classes, named ones only, near repeats once; every second by its vertices."""
    k = C("s_suppkey")
    tags = F.coalesce(*[F.when(k % len(TAGS) == i, F.create_map(*[L(x) for p in t.items() for x in p])) for i, (_, t) in enumerate(TAGS)])
    x = k % 7 + 100.5
    ring = F.array(F.array(x - 0.25, L(13.0)), F.array(x + 0.25, L(13.5)))
    rows = fx.table(spark, sf, "supplier").select(k.alias("place"), tags.alias("tags"), F.when(k % 2 == 0, x).alias("lng"), F.when(k % 2 == 0, 13.25).alias("lat"), ring.alias("ring"))
    return geoprep.places(rows, ("shrewsby",))


@query("railway_works", """select s_suppkey % 4 as k, case s_suppkey % 4 when 0 then 'MRT Orange Line (E 2028 · W 2030)' when 1 then 'SRT Red Line ext. (2029)' else 'Rail under construction' end as name, count(*) as n from supplier
    where s_suppkey % 4 <> 3 and not (s_suppkey % 4 = 2 and s_suppkey % 3 = 0) group by 1, 2""")
def railway_works(spark, sf):
    k = C("s_suppkey")
    tags = F.when(k % 4 == 0, F.create_map(L("construction"), L("subway"), L("name"), L("สายสีส้ม"))).when(k % 4 == 1, F.create_map(L("construction"), L("rail"), L("line"), L("Dark Red"))).when(
        k % 4 == 2, F.create_map(L("construction"), L("rail"))).otherwise(F.create_map(L("construction"), L("siding"), L("name"), L("Orange")))
    ring = F.transform(F.sequence(L(1), F.when(k % 3 == 0, 3).otherwise(4)), lambda i: F.array(i + 0.5, i + 0.25))
    rows = fx.table(spark, sf, "supplier").select(tags.alias("tags"), F.concat(ring, F.array(F.array((k % 4).cast("double"), L(0.0)))).alias("ring"))
    rows = rows.select("tags", F.slice("ring", 1, F.size("ring") - 1).alias("ring"), F.element_at("ring", -1)[0].cast("long").alias("k"))
    out = geoprep.railway_lines(rows.withColumn("ring", F.concat("ring", F.array().cast("array<array<double>>"))))
    return out.groupBy(F.when(C("name").startswith("MRT"), 0).when(C("name").startswith("SRT"), 1).otherwise(2).alias("k"), "name").agg(F.count("*").alias("n"))


@query("industrial_zones", """select name, floor(km2 * 1e4 + 0.5) / 1e4 as km2 from (select coalesce(case when s_suppkey % 2 = 0 then s_name end, 'Industrial area') as name,
    (s_suppkey % 10) * 1e-3 * 1e-2 * 110.57e0 * 111.32e0 * cos(radians(13.7)) as km2 from supplier) where km2 >= 0.25""")
def industrial_zones(spark, sf):
    k = C("s_suppkey")
    w = (k % 10) * 1e-3
    ring = F.array(F.array(L(100.0), L(13.0)), F.array(L(100.0) + w, L(13.0)), F.array(L(100.0) + w, L(13.01)), F.array(L(100.0), L(13.01)))
    tags = F.when(k % 2 == 0, F.create_map(L("landuse"), L("industrial"), L("name"), C("s_name"))).otherwise(F.create_map(L("landuse"), L("industrial")))
    return geoprep.industrial_zones(fx.table(spark, sf, "supplier").select(tags.alias("tags"), ring.alias("ring"))).select("name", r4("km2"))


@query("missing_schools", """with s as (select s_suppkey as k, 100 + s_suppkey * 0.1e0 as x from supplier) select 'Academy Number' || chr(cast(97 + k % 26 as int)) || ' ' || k as name from s where k % 4 in (0, 3) and k % 4 <> 3 or k % 4 = 0""")
def missing_schools(spark, sf):
    """Known schools, of which those are missing that neither share a telling word with one on the map nor lie beside one."""
    k = C("s_suppkey")
    letters = F.translate(k.cast("string"), "0123456789", "abcdefghij")
    rows = fx.table(spark, sf, "supplier")
    seed = rows.select(F.concat(L("Academy Number"), F.char(97 + k % 26), L(" "), k).alias("name"), (100 + k * 0.1).alias("lng"), L(13.5).alias("lat"), k.alias("k"), letters.alias("own"))
    named = F.concat(L("The "), F.upper(C("own")), L("zzzz School"))
    seed = seed.withColumn("known", F.when(C("k") % 4 == 1, named).when(C("k") % 4 == 2, "Other").otherwise("Far"))
    seed = seed.withColumn("asked", F.when(C("k") % 4 == 1, F.concat(L("International "), C("own"), L("zzzz College"))).otherwise(F.regexp_replace("name", "[a-z ]", "")))
    on_map = seed.where("k % 4 in (1, 2)").select(C("known").alias("name"), F.when(C("k") % 4 == 2, C("lng") + 0.003).otherwise(C("lng") + 50).alias("lng"), "lat")
    asked = seed.where("k % 4 <> 3").select(C("asked").alias("name"), "lng", "lat", C("name").alias("label"))
    out = geoprep.missing_schools(asked.select("name", "lng", "lat"), on_map)
    return out.join(asked.select("lng", "label"), "lng").select(C("label").alias("name"))


# Population and leads


@query("official_population", "select p_brand || ' District' as khet, '4012' as month, cast(sum(p_size) as bigint) as population from part where p_brand <> 'Brand#55' group by 1 having sum(p_size) > 0")
def official_population(spark, sf):
    """Inhabitants by district from the files of the first month that has any: January is empty, December before it is not."""
    rows = fx.table(spark, sf, "part")
    counts = rows.select(C("p_brand").alias("rcode"), L("4012").alias("yymm"), C("p_size").cast("string").alias("total")).union(rows.select("p_brand", L("4101"), L("0"))).union(rows.select("p_brand", L("4011"), L("7")))
    path = scratch(spark, "population")
    counts.write.json(path)
    codes = rows.select(C("p_brand").alias("rcode")).distinct().where("rcode <> 'Brand#55'").withColumn("khet", F.concat("rcode", L(" District"))).union(spark.createDataFrame([("_note", "x")], "rcode string, khet string"))
    return files.population(spark.read.schema("rcode string, yymm string, total string").json(path), codes, "4101")


@query("social_leads", """select 'facebook:g1:' || substr(sha1('Tower ' || c_custkey || '|' || cast(c_custkey % 3 * 1000 as varchar) || '|0|' || substr(repeat(c_name, 20), 1, 200)), 1, 16) as id, 'g1' as source_group,
    case c_custkey % 4 when 0 then 'sale' when 1 then 'rent' when 2 then 'sale_and_rent' else 'other' end as deal_type, case c_custkey % 2 when 0 then 'house' else 'unknown' end as property_type,
    case c_custkey % 3 when 0 then 'owner' else 'unknown' end as seller_type, case when c_custkey % 3 > 0 then c_custkey % 3 * 1000.0 end as price, cast(null as double) as rent_monthly, c_name as author,
    case when c_custkey % 2 = 0 then 1.5 else -20.0 end as deviation_pct from customer where c_custkey % 5 > 0""")
def social_leads(spark, sf):
    k = C("c_custkey")
    lead = F.struct(
        (k % 5 > 0).alias("est_une_annonce"), L("g1").alias("groupe"), F.concat(L("Tower "), k).alias("nom_immeuble"), F.repeat("c_name", 20).alias("texte"), C("c_name").alias("auteur"),
        F.when(k % 4 == 0, "vente").when(k % 4 == 1, "location").when(k % 4 == 2, "vente_et_location").alias("type_transaction"), F.when(k % 2 == 0, "maison").otherwise("chalet").alias("type_bien"),
        F.when(k % 3 == 0, "proprietaire").alias("vendeur"), (k % 3 * 1000).alias("prix_vente_thb"), L(0).alias("loyer_mensuel_thb"), F.when(k % 2 == 0, 1.5).alias("ecart_loyer_pct"), L(-20.0).alias("ecart_vente_pct"),
    )
    path = scratch(spark, "leads")
    fx.table(spark, sf, "customer").select(F.to_json(lead).alias("value")).write.text(path)
    out = files.leads(spark.read.schema(files.LEAD_FILE).json(path))
    return out.select("id", "source_group", "deal_type", "property_type", "seller_type", "price", "rent_monthly", "author", "deviation_pct")


# Listings with their parts


@query("listing_images", """select o_orderkey as id, coalesce((select string_agg(l_linenumber || ':' || l_partkey, ',' order by l_linenumber, cast(l_partkey as varchar)) from lineitem where l_orderkey = o_orderkey and l_quantity < 25), '') as images from orders""")
def listing_images(spark, sf):
    """Orders as listings and their small lines as images, in order; an empty list without any."""
    images = fx.table(spark, sf, "lineitem").where("l_quantity < 25").select(C("l_orderkey").alias("listing_id"), C("l_partkey").cast("string").alias("storage_path"), L(1).alias("width"), L(1).alias("height"), C("l_linenumber").alias("ord"))
    out = summary.with_images(fx.table(spark, sf, "orders").select(C("o_orderkey").alias("id")), images)
    return out.select("id", F.array_join(F.transform("images", lambda x: F.concat(x.ord, L(":"), x.storage_path)), ",").alias("images"))


@query("nested_details", "select p_partkey as id, case when p_partkey % 3 > 0 then p_size end as floor, p_partkey % 3 = 0 and p_partkey % 5 > 0 as bare from part")
def nested_details(spark, sf):
    k = C("p_partkey")
    rows = fx.table(spark, sf, "part").select(k.alias("id"), F.when(k % 3 > 0, C("p_size")).alias("d_floor"), F.when(k % 5 == 0, "x").alias("d_tower"))
    return summary.nested_details(rows, ["floor", "tower"]).select("id", "details.floor", C("details").isNull().alias("bare"))


@query("detail_cards", f"""with {ACTIVE_SQL} select id, coalesce(nullif(condo_name, ''), 'T') as name, case when price <> 0 then format('{{:,d}}', cast(floor(price + 0.5) as bigint)) || ' THB' end as price,
    case when area_sqm <> 0 then cast(cast(area_sqm as int) as varchar) || ' m²' end as area, case when deal_type = 'sale' then 'For sale' else 'For rent' end as deal, case when quota = 'foreigner' then 'Foreigner' else 'Thai' end as quota,
    cast(cast(bedrooms as int) as varchar) as beds, case when l_partkey % 2 = 0 then 'A (850 m)' end as school1, case when l_partkey % 2 = 0 then 'B (1.2 km)' end as school2, cast(null as varchar) as metro1, '2.5 km' as cbd from act""")
def detail_cards(spark, sf):
    near = F.array(*[F.struct(L(n).alias("name"), L(float(m)).alias("metres")) for n, m in (("A", 850), ("B", 1234))])
    none = F.array().cast("array<struct<name:string,metres:double>>")
    rows = active(spark, sf).withColumns({"title": L("T"), "schools": F.when(C("l_partkey") % 2 == 0, near).otherwise(none), "metros": none, "bus": L(None).cast("struct<name:string,metres:double>"), "cbd_m": L(2450.0)})
    return summary.card(rows.withColumn("bedrooms", C("bedrooms").cast("int"))).select("id", "name", "price", "area", "deal", "quota", "beds", "school1", "school2", "metro1", "cbd")


@query("sale_table", f"""with {UNIT_SQL}, page as (select id, price from act where deal_type = 'sale' order by price desc nulls last, id limit 100)
    select row_number() over (order by page.price desc nulls last, page.id) as place, page.id, page.price, counterpart_id, annual_yield_pct from page left join matches using (id)""")
def sale_table(spark, sf):
    """The sale table's first page by price, in its order, with the matches of the units on it."""
    from ..operators.filters import sorted_page

    rows = stage(active(spark, sf).select("id", "deal_type", "price", "area_sqm", "bedrooms", "condo_name", "khet"))
    page = stage(sorted_page(rows.where("deal_type = 'sale'"), "price", True, 0, 100))
    out = page.join(unit_matches(same_units(rows, page)).select("id", "counterpart_id", "annual_yield_pct"), "id", "left")
    place = F.row_number().over(W.partitionBy(L(1)).orderBy(C("price").desc_nulls_last(), "id"))  # of a page of a hundred
    return out.select(place.alias("place"), "id", "price", "counterpart_id", "annual_yield_pct")


@query("lite_matches", f"""with {UNIT_SQL} select id, counterpart_price from matches where id in (select id from act where deal_type = 'sale' and l_partkey % 10 = 0)""")
def lite_matches(spark, sf):
    """The matches of a few listings only, as few columns."""
    rows = active(spark, sf)
    ids = rows.where("deal_type = 'sale' and l_partkey % 10 = 0").select("id")
    return unit_matches(rows).join(ids, "id", "left_semi").select("id", "counterpart_price")


@query("whitelisted_stats", f"with f as ({STUDY_SQL.replace('from act where', "from act where khet in ('Brand#11 District', 'Brand#22 District') and")}) select * from f")
def whitelisted_stats(spark, sf):
    """The study's table for the districts of a whitelist alone."""
    names = spark.createDataFrame([("Brand#11 District",), ("Brand#22 District",), ("Nowhere",)], "khet string")
    return yields.study_stats(active(spark, sf), names)


@query("routed_tables", "select 'override' as place, count(*) as n from part union all select 'server', count(*) from part union all select 'local', count(*) from part union all select 'missing', 0")
def routed_tables(spark, sf):
    """One table by each way that leads to it, and one that is not there."""
    read = lambda name: fx.table(spark, sf, name)
    rows = {"override": files.routed(spark, "part", sf, None, "/nowhere"), "server": files.routed(spark, "part", None, read, "/nowhere"), "local": files.routed(spark, "part", None, None, sf)}
    rows["missing"] = files.or_empty(spark, lambda: fx.table(spark, sf, "no_such_table"), "a string, b int")
    out = None
    for place, df in rows.items():
        part = df.agg(L(place).alias("place"), F.count("*").alias("n"))
        out = part if out is None else out.union(part)
    return out



