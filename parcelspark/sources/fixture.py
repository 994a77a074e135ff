"""The driver's tables seen as listings and their companions. Expressions are valid in Spark SQL and in DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "TIMESTAMP '2001-12-01 00:00:00'"
CUT_OFF = "TIMESTAMP '2000-01-01 00:00:00'"

LISTING = {
    "id": "concat_ws('-', cast(l_orderkey as string), cast(l_partkey as string), cast(l_suppkey as string), cast(l_linenumber as string))",
    "source": "lower(substr(o_orderpriority, 3))",
    "deal_type": "case when l_linestatus = 'F' then 'sale' else 'rent' end",
    "status": "case when l_returnflag = 'R' then 'inactive' when l_returnflag = 'A' and l_discount >= 0.09e0 then 'sold' else 'active' end",
    "area_sqm": "case when l_quantity = 50 then 6e2 when l_tax >= 0.08e0 then null else l_quantity * 2e0 end",
    "price": "cast(floor(p_retailprice * l_quantity * 2e0 * (5e-1 + l_extendedprice / 1.05e5) * (case when l_linestatus = 'F' then 1e2 else 4e-1 end)) as double)",
    "bedrooms": "case when l_linenumber = 7 then null else l_linenumber - 1 end",
    "condo_name": "case when l_suppkey % 17 = 0 then null when l_linenumber % 3 = 0 then concat(upper(p_name), ' ', cast(p_partkey as string), ', Metro') else concat(p_name, ' ', cast(p_partkey as string)) end",
    "khet": "case when l_partkey % 97 = 0 then null else concat(p_brand, ' District') end",
    "street": "case when l_suppkey % 5 = 0 then null else concat(p_brand, '/', p_type) end",
    "lat": "1.36e1 + (l_partkey % 200) * 1.5e-3 + (l_linenumber - 4) * 1e-4",
    "lng": "1.0045e2 + (l_partkey % 130) * 1.5e-3",
    "first_seen": "o_orderdate",
    "delisted_at": "case when l_returnflag = 'R' or (l_returnflag = 'A' and l_discount >= 0.09e0) then o_orderdate + cast(l_quantity as int) * interval '1' day end",
    "agent_id": "concat('ag', cast(l_suppkey as string))",
    "quota": "case when l_tax < 0.03e0 then 'foreigner' when l_tax < 0.06e0 then 'thai' end",
    "bathrooms": "case when l_linenumber = 7 then null else greatest(1, l_linenumber - 2) end",
    "l_partkey": "l_partkey",
    "l_linenumber": "l_linenumber",
    "l_discount": "l_discount",
}
PSQM = "price / area_sqm"

#: Bounds of the plausible, in one place: (deal, least price, most price); area null or within AREA.
PRICE = (("sale", 800_000, 100_000_000), ("rent", 3_000, 500_000))
AREA = (15, 500)
SANE = (
    "(" + " or ".join(f"(deal_type = '{d}' and price >= {a} and price <= {b})" for d, a, b in PRICE) + ")"
    f" and (area_sqm is null or (area_sqm >= {AREA[0]} and area_sqm <= {AREA[1]}))"
)

_SELECT = ", ".join(f"{e} as {n}" for n, e in LISTING.items())
LISTINGS_SQL = f"""listings as (select *, {PSQM} as price_per_sqm from (
    select {_SELECT} from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey))"""
SANE_SQL = f"{LISTINGS_SQL}, sane as (select * from listings where {SANE})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All listings; what a query does not use is pruned down to the scans."""
    items, orders, parts = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    joined = items.join(orders, items.l_orderkey == orders.o_orderkey).join(parts, items.l_partkey == parts.p_partkey)
    return joined.selectExpr(*[f"{e} as {n}" for n, e in LISTING.items()]).selectExpr("*", f"{PSQM} as price_per_sqm")


def sane_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).where(SANE)


# Price history: the current price, and before it a higher one for some listings.
HISTORY_SQL = """history as (select id, price, first_seen as seen_at from listings union all
    select id, cast(floor(price * 1.05e0) as double), first_seen - interval '30' day from listings where l_discount > 0.05e0)"""

POIS = {
    "poi": "s_name",
    "category": "case s_suppkey % 3 when 0 then 'school' when 1 then 'metro_station' else 'bus_stop' end",
    "poi_lat": "1.36e1 + (s_suppkey % 100) * 3e-3",
    "poi_lng": "1.0045e2 + (s_suppkey % 65) * 3e-3",
    "poi_key": "s_suppkey",
}
POIS_SQL = "pois as (select " + ", ".join(f"{e} as {n}" for n, e in POIS.items()) + " from supplier)"


def pois(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(*[f"{e} as {n}" for n, e in POIS.items()])


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both prices of a listing come from one reading of it."""
    now = "struct(price, first_seen as seen_at)"
    older = "struct(cast(floor(price * 1.05e0) as double) as price, first_seen - interval '30' day as seen_at)"
    rows = listings(spark, sf_dir).selectExpr("id", f"explode(case when l_discount > 0.05e0 then array({now}, {older}) else array({now}) end) as h")
    return rows.select("id", "h.price", "h.seen_at")


LEADS = {
    "id": "cast(c_custkey as string)",
    "seller_type": "case c_custkey % 3 when 0 then 'owner' when 1 then 'agent' else 'unknown' end",
    "quota": "case when c_custkey % 2 = 0 then 'foreigner' else 'thai' end",
    "condo_name": "concat('condo ', cast(c_custkey % 2000 as string))",
    "deviation_pct": "floor(c_acctbal / 1e2) - 50",
    "area_sqm": "case when c_custkey % 7 = 0 then null else c_custkey % 90 end",
    "author": "c_name",
}
LEADS_SQL = "leads as (select " + ", ".join(f"{e} as {n}" for n, e in LEADS.items()) + " from customer)"


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*[f"{e} as {n}" for n, e in LEADS.items()])


RUNS_SQL = "runs as (select event_id, event_type as agent, ts as started_at, case when value < 1e0 then 'failed' else 'ok' end as status, value as metric from events)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = "case when value < 1e0 then 'failed' else 'ok' end as status"
    return table(spark, sf_dir, "events").selectExpr("event_id", "event_type as agent", "ts as started_at", status, "value as metric")
