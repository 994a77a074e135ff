"""Map elements made into places and lines: classes, areas, centres, near repeats, and known schools that are missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import LNG_KM, LAT_KM, ring_area_km2, vertex_mean

# Names of railway lines by pattern, in their order, and kinds of works that count.
LINES = (
    (r"(?i)orange|ส้ม", "MRT Orange Line", "E 2028 · W 2030"), (r"(?i)purple|ม่วง", "MRT Purple Line South ext.", "2029"), (r"(?i)red|แดง", "SRT Red Line ext.", "2029"),
    (r"(?i)high[- ]?speed|ความเร็วสูง|hsr|สามสนามบิน", "HSR 3 airports", "2032+ (pending)"), (r"(?i)pink|ชมพู", "MRT Pink Line ext.", "—"), (r"(?i)yellow|เหลือง", "MRT Yellow Line ext.", "—"),
)
WORKS = ("subway", "light_rail", "monorail", "rail")
LEAST_INDUSTRIAL_KM2 = 0.25
# Words of school names that say nothing about which school it is.
SCHOOL_WORDS = ("school", "international", "bangkok", "british", "college", "campus", "the")
BOX = 0.004
NAMED_ONLY = ("monument", "mall")


def tag(name: str) -> Column:
    return F.try_element_at("tags", F.lit(name))


def category(brands: tuple[str, ...] = ()) -> Column:
    """The class of an element by its `tags`; null for what is none. Schools count if they are international: by name, or
    one of the brands."""
    names = F.concat_ws(" ", *[F.when(tag(t) != "", tag(t)) for t in ("name", "name:en", "name:th")])
    known = lambda t: F.coalesce(tag(t) != "", F.lit(False))
    is_ = lambda t, v: F.coalesce(tag(t) == v, F.lit(False))
    metro = is_("station", "subway") | is_("station", "light_rail") | is_("subway", "yes") | is_("light_rail", "yes") | is_("monorail", "yes")
    branded = F.lit(False)
    for b in brands:
        branded = branded | F.contains(F.lower(names), F.lit(b))
    school = is_("amenity", "school") | is_("amenity", "college") | is_("amenity", "kindergarten") | is_("building", "school") | names.rlike(r"(?i)school|โรงเรียน|école|lycée|lycee")
    other = known("highway") | known("railway") | known("aeroway") | known("shop") | known("public_transport")
    return (
        F.when(is_("railway", "station") & metro, "metro_station").when(is_("railway", "station"), "train_station").when(is_("amenity", "hospital"), "hospital")
        .when(school & ~other, F.when(names.rlike(r"(?i)international|นานาชาติ") | branded, "school")).when(is_("aeroway", "aerodrome"), "airport")
        .when(is_("shop", "mall"), "mall").when(is_("highway", "bus_stop"), "bus_stop").when(known("historic") | is_("tourism", "attraction"), "monument")
    )


def places(elements: DataFrame, brands: tuple[str, ...] = ()) -> DataFrame:
    """(category, name, lng, lat) of elements (place, tags, lng, lat, ring): their point or the mean of their vertices.

    Monuments and malls without a name go, and of those that agree in class, name and place to a thousandth of a degree
    the first stays.
    """
    centre = vertex_mean(F.col("ring"))
    rows = elements.select(
        "place", category(brands).alias("category"), F.coalesce(F.when(tag("name:en") != "", tag("name:en")), F.when(tag("name") != "", tag("name"))).alias("name"),
        F.coalesce("lng", centre.lng).alias("lng"), F.coalesce("lat", centre.lat).alias("lat"),
    ).where("category is not null and lng is not null and lat is not null")
    rows = rows.where(~F.col("category").isin(*NAMED_ONLY) | F.col("name").isNotNull())
    cell = lambda c: F.floor(F.col(c) * 1000 + 0.5)
    w = W.partitionBy("category", F.coalesce("name", F.lit("")), cell("lng"), cell("lat")).orderBy("place")
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").select("category", "name", "lng", "lat")


def railway_lines(elements: DataFrame) -> DataFrame:
    """(name, opening, ring) of ways under construction (tags, ring): by the first pattern that their names hold; unknown
    ones only if they have four points."""
    blob = F.concat_ws(" ", *[F.when(tag(t) != "", tag(t)) for t in ("name", "name:en", "name:th", "ref", "line")])
    pick = lambda i: F.coalesce(*[F.when(blob.rlike(x[0]), F.lit(x[i])) for x in LINES])
    rows = elements.where(F.coalesce(tag("construction").isin(*WORKS), F.lit(False)) & (F.size("ring") >= 2))
    rows = rows.select(pick(1).alias("line"), pick(2).alias("opening"), "ring").where(F.col("line").isNotNull() | (F.size("ring") >= 4))
    name = F.when(F.col("line").isNotNull(), F.concat("line", F.lit(" ("), "opening", F.lit(")"))).otherwise("Rail under construction")
    return rows.select(name.alias("name"), F.coalesce("opening", F.lit("")).alias("opening"), "ring")


def industrial_zones(elements: DataFrame) -> DataFrame:
    """(name, km2) of industrial areas of a quarter of a square kilometre or more."""
    km2 = ring_area_km2(F.col("ring"), LNG_KM, LAT_KM)
    rows = elements.where((tag("landuse") == "industrial") & (F.size("ring") >= 4)).withColumn("km2", km2).where(F.col("km2") >= LEAST_INDUSTRIAL_KM2)
    return rows.select(F.coalesce(F.when(tag("name:en") != "", tag("name:en")), F.when(tag("name") != "", tag("name")), F.lit("Industrial area")).alias("name"), "km2")


def missing_schools(seed: DataFrame, schools: DataFrame) -> DataFrame:
    """Known schools (name, lng, lat) that are not among `schools`: none holds a telling word of theirs in its name, and
    none lies within 0.004 degrees. Words and places meet on equal keys."""
    words = F.filter(F.regexp_extract_all(F.lower("name"), F.lit("([a-zà-ÿ]+)"), F.lit(1)), lambda w: (F.length(w) >= 4) & ~w.isin(*SCHOOL_WORDS))
    rows = seed.withColumn("__words", F.array_distinct(words))
    # A word may lie anywhere in a name: names are listed under all their parts of four letters, which every word has.
    parts = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 3, F.lit(1))), lambda i: F.substr(c, i, F.lit(4))))
    low = F.lower("name")
    index = schools.select(low.alias("__name"), F.explode(parts(low)).alias("__part"))
    asked = rows.select("name", "lng", "lat", F.explode("__words").alias("__w")).withColumn("__part", F.substr("__w", F.lit(1), F.lit(4)))
    named = asked.join(index, "__part").where(F.contains("__name", F.col("__w"))).select("name", "lng", "lat").distinct()
    cell = lambda c: F.floor(F.col(c) / BOX)
    steps = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    at = schools.select(F.col("lng").alias("__x"), F.col("lat").alias("__y"), cell("lng").alias("cx"), cell("lat").alias("cy"))
    near = seed.withColumn("s", F.explode(steps)).select("name", "lng", "lat", (cell("lng") + F.col("s.x")).alias("cx"), (cell("lat") + F.col("s.y")).alias("cy"))
    near = near.join(at, ["cx", "cy"]).where((F.abs(F.col("lng") - F.col("__x")) < BOX) & (F.abs(F.col("lat") - F.col("__y")) < BOX)).select("name", "lng", "lat").distinct()
    same = ["name", "lng", "lat"]
    return seed.join(named, same, "left_anti").join(near, same, "left_anti")


def shown(pois: DataFrame, layers: dict[str, float], zoom: float) -> DataFrame:
    """Places of the layers (category: least zoom) that a map shows at a zoom."""
    least = F.try_element_at(F.create_map(*[F.lit(x) for k, v in layers.items() for x in (k, float(v))]), F.col("category"))
    return pois.where(F.coalesce(least <= zoom, F.lit(False)))


def choropleth(polygons: DataFrame, metrics: DataFrame, value: str) -> DataFrame:
    """(district, place, value): polygons with their district's figure, -1 where there is none."""
    own = metrics.select(F.col("khet").alias("district"), F.col(value).cast("double").alias("value"))
    return polygons.select("district", "place").join(own, "district", "left").withColumn("value", F.coalesce("value", F.lit(-1.0)))
