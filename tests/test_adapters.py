"""Adapters of sites: what is no page of theirs gives nothing and breaks nothing."""

import json

from pyspark.sql import functions as F

from parcelspark.functions import pages, text
from parcelspark.session import ship_package
from parcelspark.sources import adapters

DEEP = "[" * 50_000 + "]" * 50_000
TOWER = {"@type": "SingleFamilyResidence", "url": "https://x.example/property-rent/t-u7?a=1", "name": "T", "numberOfRooms": "2", "floorSize": {"value": "31.5"}, "geo": "none"}


def block(x):
    return f'<script type="application/ld+json">{x if isinstance(x, str) else json.dumps(x)}</script>'


def test_pages_that_hold_nothing(spark):
    ship_package(spark)
    adapters.register(spark)
    rows = [("residences", None), ("residences", ""), ("residences", block(DEEP)), ("residences", block("{")), ("residences", block('["a", 1, null]')), ("nobody", block(TOWER)), (None, block(TOWER))]
    spark.createDataFrame(rows, "source string, html string").createOrReplaceTempView("odd_pages")
    assert spark.sql("select l.* from odd_pages p, lateral page_listings(p.source, p.html) l").count() == 0


def test_a_page_with_some_of_all(spark):
    ship_package(spark)
    adapters.register(spark)
    other = TOWER | {"url": "https://x.example/property-sales/t", "numberOfRooms": {"x": 1}, "name": ["T"]}
    html = block(DEEP) + block({"@graph": [TOWER, {"deep": [TOWER, other]}]})
    spark.createDataFrame([("residences", html)], "source string, html string").createOrReplaceTempView("full_page")
    got = spark.sql("select l.* from full_page p, lateral page_listings(p.source, p.html) l").collect()
    assert [(r.source_id, r.deal_type, r.condo_name, r.area_sqm, r.bedrooms, r.lat) for r in got] == [("7", "rent", "T", 31.5, 2, None), ("https://x.example/property-sales/t", "sale", None, 31.5, None, None)]


def test_deep_json_is_passed_over_and_the_next_source_tried(spark):
    ship_package(spark)
    meta = '<meta name="description" content="A home near the river with a long view over the old town.">'
    df = spark.createDataFrame([(block(DEEP) + meta, DEEP)], "html string, state string")
    got = df.select(pages.description(F.col("html"), F.col("state")).alias("d"), pages.residences(F.col("html")).alias("r"), pages.state_listings(F.col("state")).alias("s"), pages.products(F.col("html")).alias("p"), pages.listed_items(F.col("html")).alias("i")).first()
    assert got.d.startswith("A home near") and [len(x) for x in (got.r, got.s, got.p, got.i)] == [0, 0, 0, 0]


def test_stream_reads_each_file_once(spark, tmp_path):
    ship_package(spark)
    adapters.register(spark)
    folder, out = f"{tmp_path}/pages", f"{tmp_path}/out"

    def add(n):
        tower = TOWER | {"url": f"https://x.example/property-rent/t-u{n}"}
        spark.createDataFrame([("u", block(tower), "residences")], "url string, html string, source string").coalesce(1).write.mode("append").partitionBy("source").json(folder)

    def run():
        stream = spark.readStream.format("listing_pages").load(folder)
        stream.writeStream.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).format("parquet").option("path", out).start().awaitTermination()
        return sorted(r.source_id for r in spark.read.parquet(out).collect())

    add(1)
    assert run() == ["1"]
    add(2)
    assert run() == ["1", "2"] and run() == ["1", "2"]


def test_entities(spark):
    import html

    texts = ["&pound;5 &uuml;ber &#128516;&#x1F600; &amp;lt; &copy 2 &notit; &nothing; & &; &#0; &#xD800; &#1114112; &#150; &#65 b &NotEqualTilde; &#99999999999; a&b=c", "plain", "", None]
    got = [r.e for r in spark.createDataFrame([(t,) for t in texts], "t string").select(text.entities(F.col("t")).alias("e")).collect()]
    assert got == [None if t is None else html.unescape(t) for t in texts]


def test_entities_by_name_only(spark):
    cases = ["a&amp;lt; &amp b&amp", "&copy; &lt;i&gt; &#39;&quot;", "&amp;amp; &eacute;", None]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = [r.e for r in df.select(text.entities(F.col("t"), ("amp", "lt", "gt", "quot", "#39")).alias("e")).collect()]
    assert got == ["a&lt; &amp b&amp", "&copy; <i> '\"", "&amp; &eacute;", None]


def pages_against_sql(spark, folder, query):
    from parcelspark.plans.registry import ORACLES, QUERIES
    from tests.compare import oracle, rows

    html = [(1, "u", "<p>Fish&amp;Chips &copy; 7</p><p>and&amp<style>p{margin:0}</style> x&middot;y &quot;z&quot; by the old market street</p>"), (2, "u", "<p></p>"), (3, "u", "&amp;lt; &am<b>p;</b>"), (4, "u", None)]
    spark.createDataFrame(html, "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/x")
    next((folder / "x").glob("*.parquet")).rename(folder / "pages.parquet")
    assert rows(QUERIES[query](spark, str(folder)).toPandas()) == rows(oracle(ORACLES[query], str(folder)))


def test_page_texts_decode_what_the_sql_does(spark, tmp_path):
    pages_against_sql(spark, tmp_path, "page_texts")


def test_full_texts_decode_what_the_sql_does(spark, tmp_path):
    pages_against_sql(spark, tmp_path, "full_texts")


def test_clean_descriptions_decode_what_the_sql_does(spark, tmp_path):
    pages_against_sql(spark, tmp_path, "clean_descriptions")


def test_developers_of_any_script(spark):
    df = spark.createDataFrame([("Developed by Siamésé Développement Groupe located at the park. 12 floors",)], "t string")
    assert df.select(pages.prose(F.col("t")).alias("p")).first().p.developer == "Siamésé Développement Groupe"


def test_page_folders_are_compressed_and_read_whole(spark):
    from pathlib import Path

    from parcelspark.plans import sites
    from tests.conftest import DATA

    folder = sites.page_folder(spark, DATA)
    made = [f for f in Path(folder).rglob("*") if f.is_file() and f.name[0] not in "._"]
    pages = sites.site_pages(spark, DATA)
    plain = pages.agg(F.sum(F.octet_length("html"))).first()[0]
    assert sum(f.stat().st_size for f in made) * 4 < plain
    read = adapters.PageReader(folder)
    assert sum(len(list(read.pages(p.path))) for p in read.partitions()) == pages.count()
