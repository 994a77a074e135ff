"""Readers and writers of files: map features, editions, event logs, population, leads, tables in two dialects of CSV.

Readers take a path that Spark can read, of one file or of many. What is corrupt is skipped, what is missing is empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import half_even, months_back
from ..functions.text import lead_id

FEATURES = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
RING, POLYGON = "array<array<array<double>>>", "array<array<array<array<double>>>>"


def routed(spark: SparkSession, name: str, override: str | None, server: Callable[[str], DataFrame] | None, local: str | None) -> DataFrame:
    """Table `name` from the override folder if there is one, else from the server's reader, else from the local folder."""
    if override:
        return spark.read.parquet(f"{override.rstrip('/')}/{name}.parquet")
    if server:
        return server(name)
    if not local:
        raise ValueError(f"no place to read {name} from")
    return spark.read.parquet(f"{local.rstrip('/')}/{name}.parquet")


def or_empty(spark: SparkSession, read: Callable[[], DataFrame], schema: str) -> DataFrame:
    """The columns of `schema` from a table; empty where the table, or one of the columns, does not exist."""
    empty = spark.createDataFrame([], schema)
    try:
        return read().select(*[F.col(f.name).cast(f.dataType) for f in empty.schema])
    except AnalysisException:
        return empty


# Map features


def features(spark: SparkSession, path: str) -> DataFrame:
    """(place, properties, kind, coordinates): the features of GeoJSON files in their order, coordinates as JSON."""
    rows = spark.read.schema(FEATURES).option("multiLine", True).json(path).select(F.posexplode("features").alias("place", "f"))
    return rows.select("place", F.col("f.properties").alias("properties"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"))


def prop(name: str) -> Column:
    return F.try_element_at("properties", F.lit(name))


def points(rows: DataFrame) -> DataFrame:
    """(poi, category, poi_lat, poi_lng) of the point features; a point without a name has an empty one."""
    at = F.from_json("coordinates", "array<double>")
    out = rows.where("kind = 'Point'").select(F.coalesce(prop("name"), F.lit("")).alias("poi"), prop("category").alias("category"), at.alias("at"))
    return out.select("poi", "category", F.col("at")[1].alias("poi_lat"), F.col("at")[0].alias("poi_lng"))


def line_segments(rows: DataFrame, category: str = "future_line") -> DataFrame:
    """(line, first_lat, first_lng, lat1, lng1, lat2, lng2): the segments of the line features of a category."""
    own = rows.where((F.col("kind") == "LineString") & (prop("category") == category))
    own = own.select(F.coalesce(prop("name"), F.lit("")).alias("line"), F.from_json("coordinates", "array<array<double>>").alias("c"))
    own = own.where(F.size("c") > 1).select("line", "c", F.explode(F.sequence(F.lit(0), F.size("c") - 2)).alias("i"))
    at = lambda i, axis: F.get(F.get("c", i), F.lit(axis))
    i = F.col("i")
    return own.select(
        "line", F.col("c")[0][1].alias("first_lat"), F.col("c")[0][0].alias("first_lng"), at(i, 1).alias("lat1"), at(i, 0).alias("lng1"), at(i + 1, 1).alias("lat2"), at(i + 1, 0).alias("lng2")
    )


def polygons(rows: DataFrame) -> DataFrame:
    """(district, place, rings) of the polygon features, a row for each part; the English name before the other.
    Features without a name are left out."""
    one, many = F.array(F.from_json("coordinates", RING)), F.from_json("coordinates", POLYGON)
    parts = F.when(F.col("kind") == "Polygon", one).when(F.col("kind") == "MultiPolygon", many)
    name = F.coalesce(F.when(prop("name_en") != "", prop("name_en")), F.when(prop("name") != "", prop("name")))
    out = rows.select(name.alias("district"), "place", F.explode(parts).alias("rings"))
    return out.where("district is not null")


def districts(rows: DataFrame, level: str = "6") -> DataFrame:
    """(district, kind, coordinates): boundaries of an administrative level, named in English, else as they are."""
    name = F.coalesce(prop("name:en"), prop("name_en"), prop("name"))
    own = rows.where(F.col("kind").isin("Polygon", "MultiPolygon") & (prop("admin_level") == level))
    return own.select(name.alias("district"), "kind", "coordinates").where("district is not null")


# Editions and logs

EDITION = (
    "date string, piece_of string, config_version int, totals struct<actives:bigint,sales:bigint,rents:bigint,condos:bigint>,"
    " khet_stats_01 map<string,struct<sale_psqm:double,rent_psqm:double,yield_wc:double,paired:bigint,sale_condos:bigint,rent_condos:bigint>>,"
    " tension_by_khet map<string,struct<rate:double,n:bigint>>, condo_medians map<string,struct<khet:string,sale_m2:double,rent_m2:double>>"
)


def editions(spark: SparkSession, path: str) -> DataFrame:
    """One row for each JSON file of an edition, with its file name; files that are no JSON are skipped. Files with further
    buildings of an edition have its date as `piece_of`, and no date."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    good = raw.where(F.try_parse_json("value").isNotNull())
    return good.select("file", F.from_json("value", EDITION).alias("e")).select("file", "e.*")


def log_between(spark: SparkSession, path: str, schema: str, after: str, until: str, at: str = "date") -> DataFrame:
    """The JSON lines of a log whose day lies behind `after` and not behind `until`; lines that do not parse are skipped."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    day = F.substring(F.coalesce(at, F.lit("")), 1, 10)
    return rows.where((day > after) & (day <= until))


# Population


def population(counts: DataFrame, codes: DataFrame, month: str, back: int = 3) -> DataFrame:
    """(khet, month, population) of the first month, going back from `month` (yymm), in which anyone is counted.

    counts: (rcode, yymm, total), a row for each part of a district, totals as text or numbers; codes: (rcode, khet).
    Districts without inhabitants are left out.
    """
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("back"), months_back(F.lit(month), i).alias("yymm")) for i in range(back)]))
    months = counts.sparkSession.range(1).select(wanted.alias("m")).select("m.*")
    total = F.coalesce(F.col("total").try_cast("bigint"), F.lit(0))
    rows = counts.join(F.broadcast(months), "yymm").withColumn("total", total)
    first = rows.where("total > 0").agg(F.min("back").alias("back"))
    rows = rows.join(F.broadcast(first), "back").join(codes.where(~F.startswith("rcode", F.lit("_"))), "rcode")
    return rows.groupBy("khet").agg(F.min("yymm").alias("month"), F.sum("total").alias("population")).where("population > 0")


# Leads

# The words of the leads' files and those of the listings.
LEAD_WORDS = {
    "deal_type": ("type_transaction", {"vente": "sale", "location": "rent", "vente_et_location": "sale_and_rent", "recherche": "wanted", "autre": "other"}, "other"),
    "property_type": ("type_bien", {"condo": "condo", "maison": "house", "townhouse": "townhouse", "terrain": "land", "commerce": "commercial", "inconnu": "unknown"}, "unknown"),
    "seller_type": ("vendeur", {"proprietaire": "owner", "agent": "agent", "inconnu": "unknown"}, "unknown"),
    "quota": ("quota", {"etranger": "foreigner", "thai": "thai", "inconnu": "unknown"}, "unknown"),
}
LEAD_NUMBERS = {"price": "prix_vente_thb", "rent_monthly": "loyer_mensuel_thb", "area_sqm": "surface_sqm", "bedrooms": "chambres", "bathrooms": "salles_de_bain"}
LEAD_PLAIN = {
    "source_url": "lien", "posted_at": "date", "station": "station_proche", "district_raw": "quartier", "furnished": "meuble", "match_score": "condo_score",
    "khet": "condo_khet", "lat": "condo_lat", "lng": "condo_lng", "median_rent_condo": "condo_med_loyer", "median_sale_condo": "condo_med_vente", "confidence": "confiance",
}
LEAD_FILE = (
    "est_une_annonce boolean, groupe string, nom_immeuble string, texte string, auteur string, ecart_loyer_pct double, ecart_vente_pct double, condo_score double, condo_lat double,"
    " condo_lng double, condo_med_loyer double, condo_med_vente double, meuble boolean, "
    + ", ".join(f"{c} double" for c in LEAD_NUMBERS.values()) + ", " + ", ".join(f"{c} string" for c, _, _ in LEAD_WORDS.values())
    + ", " + ", ".join(f"{c} string" for c in ("lien", "date", "station_proche", "quartier", "condo_khet", "confiance"))
)


def leads(rows: DataFrame, matched: str | None = None) -> DataFrame:
    """Leads of social groups (LEAD_FILE) as rows: what is no advertisement goes, words are translated, numbers of zero
    and below are unknown. The id is of the content, so an advertisement posted again has the same. matched: the column
    with the name of the building that a lead was matched to, which files name in their own way."""
    rows = rows.where(F.coalesce("est_une_annonce", F.lit(False)))
    whole = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit(0.0)).cast("string"), r"\.0$", "")
    word = lambda c, words, other: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in words.items() for x in p]), F.col(c)), F.lit(other))
    columns = {
        "id": F.concat(F.lit("facebook:"), F.coalesce("groupe", F.lit("?")), F.lit(":"), lead_id(F.col("nom_immeuble"), whole("prix_vente_thb"), whole("loyer_mensuel_thb"), F.col("texte"))),
        "source": F.lit("facebook"), "source_group": F.coalesce("groupe", F.lit("")), "author": F.substring(F.coalesce("auteur", F.lit("")), 1, 120),
        "condo_name_raw": F.when(F.col("nom_immeuble") != "", F.col("nom_immeuble")), "deviation_pct": F.coalesce("ecart_loyer_pct", "ecart_vente_pct"),
        "raw_text": F.substring(F.coalesce("texte", F.lit("")), 1, 4000), "condo_name": F.col(matched) if matched else F.lit(None).cast("string"),
    }
    columns |= {n: word(*x) for n, x in LEAD_WORDS.items()} | {n: F.when(F.col(c) > 0, F.col(c)) for n, c in LEAD_NUMBERS.items()} | {n: F.col(c) for n, c in LEAD_PLAIN.items()}
    return rows.select(*[v.alias(k) for k, v in columns.items()])


# Writers


def csv_text(df: DataFrame, comma: bool = False) -> DataFrame:
    """`df` as the text of CSV cells: floats with two decimals at most, a decimal comma if `comma`, nulls empty."""
    def cell(field) -> Column:
        c = F.col(field.name)
        if field.dataType.typeName() in ("double", "float"):
            c = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", half_even(c, 2)), "0+$", ""), r"\.$", "")
            c = F.replace(c, F.lit("."), F.lit(",")) if comma else c
        return F.when(F.col(field.name).isNotNull(), c.cast("string")).otherwise("").alias(field.name)

    return df.select(*[cell(f) for f in df.schema])


def write_csv(df: DataFrame, path: str, comma: bool = False) -> None:
    """Write a table as CSV with a byte-order mark and a header: ',' and decimal points, or ';' and decimal commas.

    Cells are bare, but those with a separator, a quote or a line break, which are quoted with their quotes doubled.
    """
    out = csv_text(df, comma)
    dialect = {"sep": ";" if comma else ",", "emptyValue": "", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    out.withColumnRenamed(out.columns[0], "\ufeff" + out.columns[0]).write.options(header=True, **dialect).csv(path)


def write_edition(edition: DataFrame, path: str) -> None:
    """Write the documents of an edition as JSON files, one for each `piece`."""
    edition.select("piece", F.to_json(F.struct(*[c for c in edition.columns if c != "piece"])).alias("value")).write.partitionBy("piece").text(path)
