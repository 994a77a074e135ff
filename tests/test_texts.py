import pytest
from pyspark.sql import functions as F

from parcelspark.functions import details as d
from parcelspark.functions import text as t
from parcelspark.operators import filters

CASES = [
    ("floor", "A corner room on the 34th Floor with light", 34),
    ("floor", "Bedroom two Floor: 9 Size 51 SqM", 9),
    ("floor", "Floor 3-Bath loft near the market", None),
    ("floor", "it is located on the 6th floor of block C", 6),
    ("floor", "Floor, 88 Units in two blocks", None),
    ("floor", "99th Floor", None),
    ("views", "View(s) River View, Garden View Building A", ["River View", "Garden View"]),
    ("views", "View(s) n/a Unit Type Duplex", None),
    ("views_count", "View(s) Pool View, Blocked View, Sea View Electricity", 2),
    ("tower", "Building C Listed By Agent", "C"),
    ("tower", "Building on the hill", None),
    ("electricity", "Electricity Price ฿7.5/kWh Water price ฿20/Unit", 7.5),
    ("electricity", "Electricity Price ฿90/kWh", None),
    ("water", "Water Price ฿22.5/Cubic Meter", 22.5),
    ("water", "Water Price N/A", None),
    ("tariff_regime", "Electricity price Government Rate Water price Government Rate", "government"),
    ("tariff_regime", "Electricity price ฿8/kWh Water price Government Rate", "private"),
    ("developer", "Developer: Green Hill Land Floors: 12", "Green Hill Land"),
    ("developer", "Developer: None Construction: Completed", None),
    ("common_fee", "CAM Fees ฿3,450/month Listed By", 3450.0),
    ("common_fee", "CAM Fee Pets ฿3,450/month", None),
    ("furnished", "Furniture Partially Furnished View(s)", "partly furnished"),
    ("furnished", "a fully-furnished loft", "fully furnished"),
    ("quota", "Foreign Quota Unit Type Loft", "foreigner"),
    ("quota", "This unit is under foreign quota. Price shown applies to Thai quota", None),
    ("quota", "Property Ownership Foreign Freehold Furniture", "foreigner"),
    ("owner", "Property Ownership Thai Company Building", "thai"),
    ("owner", "Property Ownership Company Listed By", "company"),
    ("pets", "Pets Cats Not Allowed", False),
    ("listed_by", "Listed By the owner's Agency", "agency"),
    ("year_built", "Construction Status: Off Plan (Dec 2027)", 2027),
    ("year_built", "the block was completed in March 2003", 2003),
    ("delivered", "Construction: Completed (Jan 2011)", True),
    ("delivered", "a tower still under construction", False),
    ("delivered", "BTS Line under construction next door", None),
    ("lease_months", "Min. Rental Duration 6 Months", 6),
    ("unit_id", "Unit ID 77812 Updated", "77812"),
    ("landmark", "Nearest Landmark: Old Pier - 0.4 Km", ("Old Pier", 0.4)),
    ("landmark", "Nearest Landmark: N/A - 1 Km", None),
]


@pytest.fixture(scope="module")
def fields(spark):
    df = spark.createDataFrame([(i, x) for i, (_, x, _) in enumerate(CASES)], "i int, x string")
    df = d.with_text(df, "x")
    return {r.i: r for r in df.select("i", *[v.alias(k) for k, v in d.details(F.col(d.TEXT), F.lit(None).cast("double"), 2026).items()]).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_details(fields, i):
    name, _, expected = CASES[i]
    got = fields[i][name]
    assert (tuple(got) if name == "landmark" and got else got) == expected


def test_names(spark):
    df = spark.createDataFrame([("Life One, Bangkok",), ("The  ÉDEN-Condominium",), (None,), ("Den Résidence\u00a0Condo",), ("คอนโด ลาดพร้าว 5",), ("Condor Projects_2",)], "n string")
    c = F.col("n")
    got = [tuple(r) for r in df.select(t.building_name(c), t.study_name(c), t.cohort_name(c), t.repost_key(c)).collect()]
    assert got[0] == ("life one", "life one", "life one", "lifeonebangkok")
    assert got[1][1] == "the édencondominium" and got[1][3] == "thedencondominium" and got[1][2] == "the éden"
    assert got[2] == ("", "", "", "")
    # Letters and digits of any script stay; marks that are neither are spaces, as word characters exclude them.
    assert got[3][2] == "den résidence" and got[4][2] == "คอนโด ลาดพร าว 5" and got[5][2] == "condor projects_2"


def test_cohort_keys(spark):
    rows = [("Den Résidence, Bangkok", "sale", 2.0, 42.5), ("A", None, None, None), ("Condo", "rent", 1.0, 30.0), (None, "sale", 1.0, 30.0), ("B", "rent", 0.0, -3.0)]
    df = spark.createDataFrame(rows, "n string, d string, b double, a double")
    got = [r[0] for r in df.select(t.cohort_key(F.col("n"), F.col("d"), F.col("b"), F.col("a"))).collect()]
    assert got == ["den résidence|2|45|sale", "a|-1|0|?", None, None, "b|0|0|rent"]


def test_clean_description(spark):
    keep = "A &amp; B is a fine building &#8212; close to all that one &#x41; may need in town."
    good = "A & B is a fine building — close to all that one A may need in town."
    html = [
        f"<p>{keep}</p>\n\n\n\n ( window.load(1); more", f"<p>{keep}</p> @media print", f"{keep} let x = 2", f"{keep} {{ color: red; }}", f"{keep} $root.go",
        "<p>short</p>", None, f"{keep} and 3 => 4 {{ \"a\" }} stays, as does document ready",
    ]
    got = [r[0] for r in spark.createDataFrame([(h,) for h in html], "h string").select(t.clean_description(F.col("h"))).collect()]
    assert got[:5] == [good] * 5 and got[5:7] == [None, None] and got[7].endswith('stays, as does document ready')


def test_full_text_drops_noise_and_keeps_lines(spark):
    df = spark.createDataFrame([("<noscript>no</noscript><template><b>x</b></template>  one\n\n\n\ntwo&nbsp;three<br>",), ("<p></p>",)], "h string")
    assert [r[0] for r in df.select(t.full_text(F.col("h"))).collect()] == ["one\n\ntwo three", None]


def test_filters_round_trip_and_nulls(spark):
    f = {"priceMin": 10.0, "bedsMin": 1.0, "deal": {"sale", "rent"}}
    assert filters.from_query_string(filters.to_query_string(f)) == f
    assert filters.from_query_string("priceMin=x&other=1") == {}
    df = spark.createDataFrame([(1, None, 2, "sale"), (2, 5.0, 2, "sale"), (3, 50.0, None, "sale"), (4, 50.0, 2, None)], "id int, price double, bedrooms int, deal_type string")
    assert [r.id for r in df.where(filters.matches(f)).collect()] == [1]


def test_robots(spark):
    paths = ["/", "/a/b", "/ab", "/a/c.html", "/z$x", "/z", "/end9", "/end91", "/q?x=1"]
    urls = spark.createDataFrame([("h", x) for x in paths] + [("g", "/a"), ("e", "/a")], "host string, path string")
    # An empty rule is none; * and $ have no weight, so /ab outweighs /a*; $ is an end only where it closes the rule.
    rules = [("h", "", False), ("h", "/a*", True), ("h", "/ab", False), ("h", "/a/c", False), ("h", "/*.html", True), ("h", "/z$x", False), ("h", "/*9$", False), ("h", "/q?*", False), ("e", "", False)]
    got = {(r.host, r.path): r.allowed for r in filters.allowed(urls, spark.createDataFrame(rules, "host string, rule string, allow boolean")).collect()}
    want = {"/": True, "/a/b": True, "/ab": False, "/a/c.html": True, "/z$x": False, "/z": True, "/end9": False, "/end91": True, "/q?x=1": False}
    assert got == {("h", k): v for k, v in want.items()} | {("g", "/a"): True, ("e", "/a"): True}


def test_robots_groups(spark):
    text = "User-agent: x\nDisallow: /x\n\nUser-Agent: Collector\nUser-agent: y # both\nAllow: /a:b\nDisallow:\n\nuser-agent: *\nDisallow: /"
    files = spark.createDataFrame([("h", text), ("g", "User-agent: *\r\nDisallow: /g\r\n"), ("n", "nothing")], "host string, text string")
    of = lambda agent: sorted((r.host, r.rule, r.allow) for r in filters.robots_rules(files, agent).collect())
    assert of("collector/1.0") == [("g", "/g", False), ("h", "", False), ("h", "/a:b", True)]
    assert of("other/2") == [("g", "/g", False), ("h", "/", False)]


def test_suggestions(spark):
    rows = spark.createDataFrame([("Sky Road", "SKY Tower", "North"), ("sky road", "Sky tower", "Sky District")], "street string, condo_name string, khet string")
    assert [tuple(r) for r in filters.suggestions(rows, " sky ").collect()] == [("street", "Sky Road"), ("condo", "SKY Tower"), ("district", "Sky District")]
    assert filters.suggestions(rows, "  ").count() == 0


def test_deals_in_scope(spark):
    rows = spark.createDataFrame([(1, "a", 2e6, "Sky"), (2, "a", 5e6, None), (3, "b", 2e6, "Sky")], "id int, khet string, price double, condo_name string")
    ids = lambda **k: [r.id for r in filters.in_scope(rows, **k).orderBy("id").collect()]
    assert ids(khet="a", price_max="2,5") == [1] and ids(price_min="x", text=" sky") == [1, 3] and ids() == [1, 2, 3] and ids(price_min="0") == [1, 2, 3]


def test_search_needs_words(spark):
    df = spark.createDataFrame([("Sky Tower", "X", None, "s")], "condo_name string, khet string, street string, source string")
    assert filters.search(df, "tower SKY").count() == 1 and filters.search(df, "  ").count() == 0 and filters.search(df, "sky river").count() == 0


def test_sql_functions_are_the_columns(spark):
    from parcelspark.functions import sql

    sql.register(spark)
    names = ["Life One, Bangkok", " The  Condo\tProject  Ünï 9 ", "โครงการ 1, x", None, "", "Bang Rak District", "a,b", "Residences at X' Y"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    df.createOrReplaceTempView("names_to_read")
    for f in (t.building_name, t.study_name, t.cohort_name, t.repost_key, t.district_key):
        want = [r[0] for r in df.select(f(F.col("name"))).collect()]
        assert [r[0] for r in spark.sql(f"select {f.__name__}(name) from names_to_read").collect()] == want
    assert "Python" not in spark.sql("select building_name(name) from names_to_read")._jdf.queryExecution().toString()


def test_amounts_round_by_the_doubles_own_value(spark):
    values = [135_795_000.0, 1_005_000.0, 1_015_000.0, 1_125_000.0, 1_375_000.0, 2_675_000.0, 1_234_567_890_125_000.0]
    got = [r.a for r in spark.createDataFrame([(x,) for x in values], "x double").select(t.amount_text(F.col("x")).alias("a")).collect()]
    assert got == [f"{x / 1e6:.2f} M".replace(".", ",") for x in values] and got[0] == "135,79 M"


ODD = [
    ("floor", "İFloor 7 and floor 8", 8), ("floor", "lift tó FLOOR: 12", 12), ("floor", "no 5 Floor", 5), ("tower", "xBuilding 4 Listed By Agent", None), ("pets", "Carpets Allowed", None), ("pets", "Pets Allowed", True),
    ("electricity", "İ ELECTRICITY PRICE ฿8/kWh", 8.0), ("quota", "xForeign Quota Unit Type", None), ("quota", "Foreigner Quota Unit Type", "foreigner"), ("year_built", "it Was Completed In 1999", 1999),
    ("delivered", "CONSTRUCTION: off-plan", False), ("furnished", "FULLY FURNISHED", "fully furnished"), ("views", "View(s) Sea View, Building Building", ["Sea View"]), ("lease_months", "Min. Rental Duration 2 Year", 24),
]


def test_details_read_together(spark):
    """Many fields at once are as each by itself, and what others build on is read once."""
    df = d.with_text(spark.createDataFrame([(i, x) for i, (_, x, _) in enumerate([*CASES, *ODD])], "i int, x string"), "x")
    out = d.with_details(df, F.lit(None).cast("double"), 2026)
    got = {r.i: r for r in out.collect()}
    for i, (name, _, expected) in enumerate([*CASES, *ODD]):
        value = got[i][name]
        assert (tuple(value) if name == "landmark" and value else value) == expected, (name, i)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("View\\(s\\)(") == 1 and plan.count("/\\s*kWh") == 1 and plan.count("lower(__text") == 1


def test_descriptions_are_dealt_out(spark):
    from parcelspark.plans.registry import QUERIES
    from tests.conftest import DATA

    assert QUERIES["detail_fields"](spark, DATA).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
