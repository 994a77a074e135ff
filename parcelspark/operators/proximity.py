"""Places: nearest points of interest, screens by distance, containment in polygons, district repair."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import DEGREE_M, EARTH_M, FLAT_AT, haversine, inside_polygon, segment_distance
from ..functions.text import district_key
from ..sources.scratch import stage

#: Sides of cells in degrees, each a quarter of the next: a point is looked for in the smallest about which places are
#: dense enough, DENSE times as many as are wanted.
GRID = (0.000625, 0.0025, 0.01, 0.04)
DENSE = 8
#: Cell sizes in degrees, tried in turn for what is left; and those of the blocks of places in the search for what is left, each ten times
#: the next, so that the cells of one lie in those of another.
CELLS = (0.4,)
BLOCKS = (40.0, 4.0, 0.4)


def nearest(points: DataFrame, pois: DataFrame, k: int | Column, by: tuple[str, ...] = (), cells: tuple[float, ...] = CELLS) -> DataFrame:
    """(lat, lng, *by, rank, poi, metres): the k nearest of `pois` (poi, poi_lat, poi_lng, *by) to each distinct point.

    Points have the columns of `by` too, and k may depend on them. They meet what lies in their own and the eight cells
    about it, on equal keys; where places are dense, cells are small, so that a point meets few of them however many lie
    about. A point whose k-th candidate may not be among the nearest, being further than a cell, is tried again with
    larger cells, and in the end at any distance by far(). Ties go to the lower name.
    """
    k = F.lit(k) if isinstance(k, int) else k
    at = ["lat", "lng", *by]
    w = W.partitionBy(*at).orderBy("metres", "poi")
    metres = haversine(F.col("lat"), F.col("lng"), F.col("poi_lat"), F.col("poi_lng"))
    pois = stage(pois.where("poi_lat is not null and poi_lng is not null").select("poi", "poi_lat", "poi_lng", *by))
    left, out = stage(points.select(*at).where("lat is not null and lng is not null").distinct()), None
    steps = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a in (-1, 0, 1) for b in (-1, 0, 1)])

    def cell(c: str, size: Column) -> Column:
        return F.floor(F.col(c) / size)

    def settled(left: DataFrame, near: DataFrame, own: DataFrame, size: Column) -> DataFrame:
        """The k nearest of those points whose k nearest are sure to be in the cells met."""
        found = near.join(own, ["level", "cx", "cy", *by]).withColumn("metres", metres)
        # What lies outside is a cell's size further north or south at least, or beyond the meridians a cell's size away.
        reach = EARTH_M * (1 - 1e-9) * F.asin(F.cos(F.radians("lat")) * F.sin(F.radians(size)))
        inner = (F.abs("lat") <= 90) & (F.abs("lng") <= 180 - size)
        ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        sure = F.max((F.col("rank") == k) & inner & (F.col("metres") < reach)).over(W.partitionBy(*at))
        return stage(ranked.withColumn("sure", sure).where("sure").select(*at, "rank", "poi", "metres"))

    def around(rows: DataFrame, size: Column) -> DataFrame:
        return rows.withColumn("s", F.explode(steps)).select(*at, "level", (cell("lat", size) + F.col("s.x")).alias("cx"), (cell("lng", size) + F.col("s.y")).alias("cy"))

    # Cells of all sizes with their places; how many lie in a cell and the eight about it says which size a point takes.
    size = F.element_at(F.array(*[F.lit(x) for x in GRID]), F.col("level") + 1)
    levels = F.explode(F.array(*[F.lit(i) for i in range(len(GRID))])).alias("level")
    own = pois.select("*", levels).withColumns({"cx": cell("poi_lat", size), "cy": cell("poi_lng", size)})
    held = own.groupBy("level", "cx", "cy", *by).agg(F.count("*").alias("n")).withColumn("s", F.explode(steps))
    held = held.groupBy("level", (F.col("cx") + F.col("s.x")).alias("cx"), (F.col("cy") + F.col("s.y")).alias("cy"), *by).agg(F.sum("n").alias("n"))
    sized = left.select(*at, levels).withColumns({"cx": cell("lat", size), "cy": cell("lng", size)}).join(held, ["level", "cx", "cy", *by])
    dense = F.min(F.when(F.col("n") >= DENSE * k, F.col("level")))
    sized = sized.groupBy(*at).agg(F.coalesce(dense, F.lit(len(GRID) - 1)).alias("level"))
    rounds = [(around(sized, size), own, size)]
    for wide in cells:
        fixed = F.lit(wide)
        rounds.append((None, pois.withColumns({"level": F.lit(0), "cx": cell("poi_lat", fixed), "cy": cell("poi_lng", fixed)}), fixed))
    for near, places, side in rounds:
        near = around(left.withColumn("level", F.lit(0)), side) if near is None else near
        ranked = settled(left, near, places, side)
        left = stage(left.join(ranked.select(*at).distinct(), at, "left_anti"))
        out = ranked if out is None else out.union(ranked)
        if not left.head(1):
            return out
    return out.union(far(left, pois, k, by))


def far(points: DataFrame, pois: DataFrame, k: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """nearest() at any distance: points meet blocks of places, from the largest on, and then the places of those that may
    hold a nearest.

    A block's places lie within its radius of their mean, so by the triangle inequality the k-th nearest is no further
    than the least bound under which blocks hold k places. Blocks further away go, the others are met block by block on
    equal keys. There are at most 50 of the largest ones, as the earth has no more.
    """
    at = ["lat", "lng", *by]

    def blocks(size: float) -> DataFrame:
        own = pois.withColumns({"cx": F.floor(F.col("poi_lat") / size), "cy": F.floor(F.col("poi_lng") / size)})
        mean = own.groupBy("cx", "cy", *by).agg(F.avg("poi_lat").alias("mx"), F.avg("poi_lng").alias("my"))
        away = own.join(mean, ["cx", "cy", *by]).withColumn("away", haversine(F.col("mx"), F.col("my"), F.col("poi_lat"), F.col("poi_lng")))
        return away.groupBy("cx", "cy", "mx", "my", *by).agg(F.max("away").alias("radius"), F.count("*").alias("n"))

    def kept(met: DataFrame) -> DataFrame:
        w = W.partitionBy(*at)
        met = met.withColumn("to", haversine(F.col("lat"), F.col("lng"), F.col("mx"), F.col("my")))
        held = F.sum("n").over(w.orderBy(F.col("to") + F.col("radius"), "cx", "cy").rowsBetween(W.unboundedPreceding, 0))
        met = met.withColumn("held", held).withColumn("bound", F.min(F.when(F.col("held") >= k, F.col("to") + F.col("radius"))).over(w))
        return met.where(F.col("bound").isNull() | (F.col("to") - F.col("radius") <= F.col("bound") + 1)).select(*at, "cx", "cy")

    cells = [F.struct(F.lit(x).cast("long").alias("x"), F.lit(y).cast("long").alias("y")) for x in range(-3, 3) for y in range(-5, 5)]
    met = points.select(*at, F.explode(F.array(*cells)).alias("c")).select(*at, F.col("c.x").alias("cx"), F.col("c.y").alias("cy"))
    for i, size in enumerate(BLOCKS):
        own = blocks(size)
        if i:
            own = own.withColumns({"px": F.floor(F.col("cx") / 10), "py": F.floor(F.col("cy") / 10)})
            met = met.withColumnsRenamed({"cx": "px", "cy": "py"}).join(own, ["px", "py", *by])
        else:
            met = met.join(own, ["cx", "cy", *by])
        met = kept(met)
    size = BLOCKS[-1]
    own = pois.withColumns({"cx": F.floor(F.col("poi_lat") / size), "cy": F.floor(F.col("poi_lng") / size)})
    found = met.join(own, ["cx", "cy", *by]).withColumn("metres", haversine(F.col("lat"), F.col("lng"), F.col("poi_lat"), F.col("poi_lng")))
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy(*at).orderBy("metres", "poi"))).where(F.col("rank") <= k)
    return ranked.select(*at, "rank", "poi", "metres")


def nearest_distance(points: DataFrame, pois: DataFrame, name: str) -> DataFrame:
    """(lat, lng, `name`_m, `name`) of the nearest."""
    return nearest(points, pois, 1).select("lat", "lng", F.col("metres").alias(f"{name}_m"), F.col("poi").alias(name))


def nearest_lines(points: DataFrame, lines: DataFrame, line_m: float, first_m: float | None = None) -> DataFrame:
    """(lat, lng, line_m, line): the nearest segment within `line_m` of each point.

    lines: (line, lat1, lng1, lat2, lng2), and (first_lat, first_lng) of the line's beginning if `first_m` leaves out
    lines that begin further away. Segments are listed under the cells of their bounding box and line_m about it.
    """
    # Half a percent more than line_m covers the flattening of the plane on which distances are taken.
    up = line_m * 1.005 / DEGREE_M
    aside = up / math.cos(math.radians(FLAT_AT))
    size = max(0.01, 2 * aside)
    span = lambda a, b, by: F.sequence(F.floor((F.least(a, b) - by) / size), F.floor((F.greatest(a, b) + by) / size))
    cells = lines.withColumn("cx", F.explode(span(F.col("lat1"), F.col("lat2"), up))).withColumn("cy", F.explode(span(F.col("lng1"), F.col("lng2"), aside)))
    places = points.select("lat", "lng").distinct().withColumn("cx", F.floor(F.col("lat") / size)).withColumn("cy", F.floor(F.col("lng") / size))
    d = segment_distance(F.col("lat"), F.col("lng"), F.col("lat1"), F.col("lng1"), F.col("lat2"), F.col("lng2"))
    near = places.join(cells, ["cx", "cy"]).withColumn("d", d).where(F.col("d") <= line_m)
    if first_m is not None:
        near = near.where(haversine(F.col("lat"), F.col("lng"), F.col("first_lat"), F.col("first_lng")) <= first_m)
    return near.groupBy("lat", "lng").agg(F.min("d").alias("line_m"), F.min_by("line", F.struct("d", "line")).alias("line"))


def school_transit_screen(
    rows: DataFrame, schools: DataFrame, metros: DataFrame, lines: DataFrame, school_m: float = 5000, metro_m: float = 500, line_m: float = 500,
    first_m: float | None = 25_000, by_car: DataFrame | None = None,
) -> DataFrame:
    """Rows with a school within 5 km and a metro station within 500 m, or else a future line within 500 m that begins
    within 25 km. by_car: (khet), districts that are left out."""
    rows = rows.where("lat is not null and lng is not null")
    rows = stage(rows.join(by_car, "khet", "left_anti") if by_car is not None else rows)
    points = rows.select("lat", "lng").distinct()
    near = nearest_distance(points, schools, "school").where(F.col("school_m") <= school_m)
    near = near.join(nearest_distance(points, metros, "metro"), ["lat", "lng"], "left")
    near = near.join(nearest_lines(points, lines, line_m, first_m if "first_lat" in lines.columns else None), ["lat", "lng"], "left")
    close = F.coalesce(F.col("metro_m") <= metro_m, F.lit(False))
    near = near.where(close | F.col("line_m").isNotNull()).withColumn("close", close)
    shown = {c: F.when(F.col("close"), F.col(c)) for c in ("metro_m", "metro")} | {c: F.when(~F.col("close"), F.col(c)) for c in ("line_m", "line")}
    return rows.join(near.withColumns(shown).drop("close"), ["lat", "lng"])


def locate(points: DataFrame, polygons: DataFrame, size: float = 0.05) -> DataFrame:
    """(lat, lng, district): the first polygon, by `place`, that holds each distinct point.

    polygons: (district, place, rings), rings of [lng, lat] with holes after the first. A polygon is listed under the
    cells of its bounding box and a point meets those of its own cell, so only they are tested exactly.
    """
    of = lambda i, f: f(F.transform(F.flatten("rings"), lambda p: p[i]))
    cell = lambda i: F.sequence(F.floor(of(i, F.array_min) / size), F.floor(of(i, F.array_max) / size))
    cells = polygons.withColumn("cx", F.explode(cell(1))).withColumn("cy", F.explode(cell(0)))
    own = points.select("lat", "lng").where("lat is not null and lng is not null").distinct()
    own = own.withColumn("cx", F.floor(F.col("lat") / size)).withColumn("cy", F.floor(F.col("lng") / size))
    hit = own.join(cells, ["cx", "cy"]).where(inside_polygon(F.col("lat"), F.col("lng"), F.col("rings")))
    return hit.groupBy("lat", "lng").agg(F.min_by("district", "place").alias("district"))


def canonical(rows: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """Replace district labels by their canonical spelling, unknown ones by null. names: (district)."""
    keys = names.select(F.col("district").alias("__name"), district_key(F.col("district")).alias("__key"))
    out = rows.withColumn("__key", district_key(F.col(column))).join(keys, "__key", "left")
    return out.withColumn(column, F.col("__name")).drop("__key", "__name")


def repair_districts(rows: DataFrame, names: DataFrame, polygons: DataFrame) -> DataFrame:
    """Rows whose label is no canonical one, with the district of their place and what becomes of them."""
    wrong = rows.where(F.col("khet").isNotNull()).join(names.select(F.col("district").alias("khet")), "khet", "left_anti")
    out = wrong.join(locate(wrong, polygons), ["lat", "lng"], "left")
    what = F.when(F.col("lat").isNull() | F.col("lng").isNull(), "no_coordinates").when(F.col("district").isNull(), "outside").otherwise("corrected")
    return out.withColumn("outcome", what)
