"""Prices, yields, benchmarks, matches, tension and the study, on the listings fixture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import half_up, mid_rank, slope, middle_means
from ..functions.text import building_name, cohort_key, cohort_name, repost_key, study_name
from ..operators import benchmarks, matching, study, tension, yields
from ..sources import fixture as fx
from ..sources.fixture import LISTINGS_SQL, SANE_SQL
from .registry import query

ACTIVE_SQL = f"{SANE_SQL}, act as (select * from sane where status = 'active')"
N1 = "trim(regexp_replace(regexp_replace(lower(split_part(coalesce(condo_name, ''), ',', 1)), '[^a-z0-9 ]', '', 'g'), '\\s+', ' ', 'g'))"
N2 = "trim(regexp_replace(regexp_replace(lower(split_part(coalesce(condo_name, ''), ',', 1)), '[^\\p{L}\\p{N} ]', '', 'g'), '\\s+', ' ', 'g'))"
N3 = (
    "trim(regexp_replace(regexp_replace(regexp_replace(lower(replace(coalesce(condo_name, ''), ',', ' ')),"
    " '\\b(bangkok|condominium|condo|project|residences|residence)\\b', ' ', 'g'), '[^\\p{L}\\p{N}_\\s\\p{Z}]', ' ', 'g'), '[\\s\\p{Z}]+', ' ', 'g'))"
)
N4 = "lower(regexp_replace(coalesce(condo_name, ''), '[^a-zA-Z0-9]', '', 'g'))"


def r4(name: str, out: str | None = None):
    return half_up(F.col(name), 4).alias(out or name)


def s4(expr: str) -> str:
    return f"floor(({expr}) * 1e4 + 0.5) / 1e4"


def active(spark: SparkSession, sf: str) -> DataFrame:
    return fx.sane_listings(spark, sf).where("status = 'active'")


@query("sane_listings", f"with {SANE_SQL} select id, deal_type, status, price, {s4('price_per_sqm')} as psqm from sane")
def sane_listings(spark, sf):
    return fx.sane_listings(spark, sf).select("id", "deal_type", "status", "price", r4("price_per_sqm", "psqm"))


@query("norm_names", f"with {LISTINGS_SQL} select distinct condo_name, {N1} as n1, {N2} as n2, {N3} as n3, {N4} as n4 from listings")
def norm_names(spark, sf):
    """Each name once, then its keys: only names are held while they are told apart."""
    c = F.col("condo_name")
    return fx.listings(spark, sf).select("condo_name").distinct().select("condo_name", building_name(c).alias("n1"), study_name(c).alias("n2"), cohort_name(c).alias("n3"), repost_key(c).alias("n4"))


BUCKET = "cast(case when area_sqm > 0 then floor(area_sqm / 5 + 0.5) * 5 else 0 end as int)"
COHORT = f"case when {N3} <> '' then {N3} || '|' || coalesce(cast(cast(bedrooms as int) as varchar), '-1') || '|' || cast({BUCKET} as varchar) || '|' || coalesce(deal_type, '?') end"


def cohorts(rows: DataFrame) -> DataFrame:
    c = F.col
    return rows.withColumn("unit_key", cohort_key(c("condo_name"), c("deal_type"), c("bedrooms"), c("area_sqm")))


@query("cohort_keys", f"with {LISTINGS_SQL} select {COHORT} as unit_key, count(*) as n from listings group by 1")
def cohort_keys(spark, sf):
    return cohorts(fx.listings(spark, sf)).groupBy("unit_key").agg(F.count("*").alias("n"))


def yield_sql(group: str, beds: str, start: str = f"with {ACTIVE_SQL}", rows: str = "act") -> str:
    return f"""{start}, g as (
        select *, case when {N1} <> '' then {N1} else '#' || id end as building from {rows} where {group} is not null and {group} <> '' and {beds}),
    p as (select * from g where price_per_sqm > 0),
    s as (select *, count(*) over (partition by {group}, deal_type) as n, row_number() over (partition by {group}, deal_type order by price_per_sqm) - 1 as r from p),
    q as (select {group} as k, deal_type as d, max(case when r = least(n - 1, floor(n * 0.05)) then price_per_sqm end) as lo,
            max(case when r = least(n - 1, floor(n * 0.95)) then price_per_sqm end) as hi, max(n) as n from s group by 1, 2),
    c as (select p.{group} as k, deal_type, building, case when q.n >= 20 then least(hi, greatest(lo, price_per_sqm)) else price_per_sqm end as v from p join q on q.k = p.{group} and q.d = deal_type),
    m as (select k, building, median(v) filter (deal_type = 'sale') as s, median(v) filter (deal_type = 'rent') as r, count(*) filter (deal_type = 'sale') as ns, count(*) filter (deal_type = 'rent') as nr from c group by 1, 2),
    a as (select k, cast(sum(ns) as bigint) as n_sale, cast(sum(nr) as bigint) as n_rent, count(s) as n_sale_bldg, count(r) as n_rent_bldg,
            count(case when building not like '#%' then r * 12 / s end) as n_paired, median(s) as ms, median(r) as mr, median(case when building not like '#%' then r * 12 / s * 100 end) as y from m group by 1)
    select {group}, coalesce(n_sale, 0) as n_sale, coalesce(n_rent, 0) as n_rent, coalesce(n_sale_bldg, 0) as n_sale_bldg, coalesce(n_rent_bldg, 0) as n_rent_bldg, coalesce(n_paired, 0) as n_paired,
        {s4('ms')} as sale_median_psqm, {s4('mr')} as rent_median_psqm,
        floor((case when n_paired >= 5 then y else mr * 12 / ms * 100 end) * 10 + 0.5) / 10 as gross_yield_pct,
        case when n_paired >= 5 then 'within-condo' when mr * 12 / ms is not null then 'ratio' end as yield_method,
        coalesce(n_sale_bldg, 0) < 20 or coalesce(n_rent_bldg, 0) < 20 as low_sample
    from (select distinct {group} from g) left join a on a.k = {group}"""


def yields_of(spark, sf, group: str, beds: str) -> DataFrame:
    out = yields.yields(active(spark, sf), group, beds)
    return out.withColumns({c: half_up(F.col(c), 4) for c in ("sale_median_psqm", "rent_median_psqm")})


@query("yields_by_district", yield_sql("khet", "bedrooms <= 1"))
def yields_by_district(spark, sf):
    return yields_of(spark, sf, "khet", "0-1")


@query("yields_by_district_all", yield_sql("khet", "true"))
def yields_by_district_all(spark, sf):
    return yields_of(spark, sf, "khet", "all")


@query("yields_by_street", yield_sql("street", "true"))
def yields_by_street(spark, sf):
    return yields_of(spark, sf, "street", "all")


def double_sql(deal: str) -> str:
    return f"""with {ACTIVE_SQL}, b as (select khet, condo_name, median(price_per_sqm) as m from act where deal_type = '{deal}' and price_per_sqm > 0 and khet is not null and condo_name is not null group by 1, 2)
        select khet, {s4('median(m)')} as psqm, count(*) as buildings from b group by 1 having count(*) >= 5"""


@query("double_median_sale", double_sql("sale"))
def double_median_sale(spark, sf):
    return yields.double_median(active(spark, sf), "sale").withColumn("psqm", half_up(F.col("psqm"), 4))


@query("double_median_rent", double_sql("rent"))
def double_median_rent(spark, sf):
    return yields.double_median(active(spark, sf), "rent").withColumn("psqm", half_up(F.col("psqm"), 4))


@query("paired_yield", f"""with {ACTIVE_SQL}, b as (select khet, condo_name, median(price_per_sqm) filter (deal_type = 'sale') as s, median(price_per_sqm) filter (deal_type = 'rent') as r
    from act where price_per_sqm > 0 and khet is not null and condo_name is not null group by 1, 2)
    select khet, floor(median(r * 1200 / s) * 100 + 0.5) / 100 as yield_pct, count(*) as buildings from b where s > 0 and r > 0 group by 1 having count(*) >= 5""")
def paired_yield(spark, sf):
    return yields.paired_yield(active(spark, sf))


STUDY_SQL = f"""with {ACTIVE_SQL}, p as (select *, {N2} as building from act where khet is not null and bedrooms <= 1 and price_per_sqm > 0),
    s as (select *, count(*) over w as n, row_number() over (partition by khet, deal_type, building order by price_per_sqm) - 1 as r from p window w as (partition by khet, deal_type, building)),
    q as (select khet, deal_type, building, max(case when r = least(n - 1, floor(n * 0.05)) then price_per_sqm end) as lo, max(case when r = least(n - 1, floor(n * 0.95)) then price_per_sqm end) as hi from s group by 1, 2, 3),
    c as (select khet, deal_type, building, case when n >= 20 then least(hi, greatest(lo, price_per_sqm)) else price_per_sqm end as v from s join q using (khet, deal_type, building)),
    m as (select khet, building, median(v) filter (deal_type = 'sale') as s, median(v) filter (deal_type = 'rent') as r from c group by 1, 2)
    select khet, count(s) as sale_condos, count(r) as rent_condos, count(r / s) as paired, floor(median(s) + 0.5) as sale_psqm, floor(median(r) * 10 + 0.5) / 10 as rent_psqm,
        case when count(r / s) >= 5 then floor(median(r * 12 / s * 100) * 100 + 0.5) / 100 end as yield_wc, count(s) < 20 or count(r) < 20 as low_sample from m group by 1"""


@query("study_district_stats", STUDY_SQL)
def study_district_stats(spark, sf):
    return yields.study_stats(active(spark, sf))


def group_stats_sql(group: str) -> str:
    return f"""with {LISTINGS_SQL} select {group}, count(*) filter (status = 'active') as n_active, floor(avg(price_per_sqm) filter (status = 'active') + 0.5) as avg_psqm,
        {s4("median(price_per_sqm) filter (status = 'active')")} as median_psqm from listings where {group} is not null group by 1"""


def group_stats(rows: DataFrame, group: str) -> DataFrame:
    """Count, rounded mean and median of the active listings; groups without one are kept."""
    own = F.when(F.col("status") == "active", F.col("price_per_sqm"))
    return rows.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.count(F.when(F.col("status") == "active", 1)).alias("n_active"), half_up(F.avg(own)).alias("avg_psqm"), half_up(F.percentile(own, F.lit(0.5)), 4).alias("median_psqm")
    )


@query("district_stats", group_stats_sql("khet"))
def district_stats(spark, sf):
    return group_stats(fx.listings(spark, sf), "khet")


@query("street_stats", group_stats_sql("street"))
def street_stats(spark, sf):
    return group_stats(fx.listings(spark, sf), "street")


SNAPSHOT_SQL = f"""snaps as (select date_trunc('month', first_seen) as taken_at, khet, deal_type, count(*) filter (status = 'active') as active_count,
    floor(avg(price_per_sqm) filter (status = 'active') + 0.5) as avg_psqm, median(price_per_sqm) filter (status = 'active') as median_psqm
    from listings where khet is not null and deal_type is not null group by 1, 2, 3)"""


def snapshots(spark, sf) -> DataFrame:
    """Monthly snapshots of districts and deals; a group without active listings is kept with none."""
    rows = fx.listings(spark, sf).where("khet is not null and deal_type is not null")
    own = F.when(F.col("status") == "active", F.col("price_per_sqm"))
    return rows.groupBy(F.date_trunc("month", "first_seen").alias("taken_at"), "khet", "deal_type").agg(
        F.count(F.when(F.col("status") == "active", 1)).alias("active_count"), half_up(F.avg(own)).alias("avg_psqm"), F.percentile(own, F.lit(0.5)).alias("median_psqm")
    )


@query("district_snapshot", f"""with {LISTINGS_SQL}, {SNAPSHOT_SQL} select strftime(taken_at, '%Y-%m-%d') as taken_on, khet, deal_type, active_count, {s4('avg_psqm')} as avg_psqm, {s4('median_psqm')} as median_psqm from snaps""")
def district_snapshot(spark, sf):
    return snapshots(spark, sf).select(F.date_format("taken_at", "yyyy-MM-dd").alias("taken_on"), "khet", "deal_type", "active_count", r4("avg_psqm"), r4("median_psqm"))


COHORT_SNAP_SQL = f"""cs as (select date_trunc('quarter', first_seen) as taken_at, {COHORT} as unit_key, max(condo_name) as condo_name, max(khet) as khet, max(deal_type) as deal_type, max(bedrooms) as bedrooms,
    cast(floor(avg(area_sqm) / 5 + 0.5) * 5 as int) as area_bucket, count(*) as active_count, median(price) as median_price, min(price) as min_price, max(price) as max_price
    from listings where status = 'active' and {COHORT} is not null group by 1, 2)"""


def cohort_snaps(spark, sf) -> DataFrame:
    rows = cohorts(fx.listings(spark, sf)).where("status = 'active' and unit_key is not null")
    return rows.groupBy(F.date_trunc("quarter", "first_seen").alias("taken_at"), "unit_key").agg(
        F.max("condo_name").alias("condo_name"), F.max("khet").alias("khet"), F.max("deal_type").alias("deal_type"), F.max("bedrooms").alias("bedrooms"),
        (half_up(F.avg("area_sqm") / 5) * 5).cast("int").alias("area_bucket"), F.count("*").alias("active_count"), F.percentile("price", F.lit(0.5)).alias("median_price"),
        F.min("price").alias("min_price"), F.max("price").alias("max_price"),
    )


@query("cohort_snapshot", f"with {LISTINGS_SQL}, {COHORT_SNAP_SQL} select strftime(taken_at, '%Y-%m-%d') as taken_on, unit_key, condo_name, khet, deal_type, bedrooms, area_bucket, active_count, median_price, min_price, max_price from cs")
def cohort_snapshot(spark, sf):
    return cohort_snaps(spark, sf).withColumn("taken_on", F.date_format("taken_at", "yyyy-MM-dd")).drop("taken_at")


@query("cohort_tension", f"""with {LISTINGS_SQL}, {COHORT_SNAP_SQL}, d as (select *, row_number() over (partition by unit_key order by taken_at desc) as rn from cs where unit_key is not null)
    select a.unit_key, a.khet, a.deal_type, strftime(a.taken_at, '%Y-%m-%d') as taken_on, a.active_count as stock_now, b.active_count as stock_before, a.active_count - b.active_count as variation
    from d a join d b on a.unit_key = b.unit_key and b.rn = 2 where a.rn = 1""")
def cohort_tension(spark, sf):
    out = matching.stock_change(cohort_snaps(spark, sf), "unit_key", "taken_at", "active_count", ["khet", "deal_type"])
    return out.withColumn("taken_on", F.date_format("taken_at", "yyyy-MM-dd")).drop("taken_at")


@query("original_prices", f"with {LISTINGS_SQL}, {fx.HISTORY_SQL} select id, max(price) as original from history group by 1")
def original_prices(spark, sf):
    return fx.history(spark, sf).groupBy("id").agg(F.max("price").alias("original"))


BENCH_SQL = f"""{ACTIVE_SQL}, l as (select * from act where price_per_sqm > 0),
    t1 as (select l.id, 1 as prio, 'immeuble_chambres' as niveau, count(*) as n, median(x.price_per_sqm) as m, quantile_cont(x.price_per_sqm, 0.25) as p25, quantile_cont(x.price_per_sqm, 0.75) as p75
        from l join l x on x.id <> l.id and x.condo_name = l.condo_name and x.deal_type = l.deal_type and x.bedrooms is not distinct from l.bedrooms and l.area_sqm > 0
            and x.area_sqm >= l.area_sqm * 0.8 and x.area_sqm <= l.area_sqm * 1.2 group by 1 having count(*) >= 5),
    t2 as (select l.id, 2, 'immeuble', count(*), median(x.price_per_sqm), quantile_cont(x.price_per_sqm, 0.25), quantile_cont(x.price_per_sqm, 0.75)
        from l join l x on x.id <> l.id and x.condo_name = l.condo_name and x.deal_type = l.deal_type group by 1 having count(*) >= 5),
    t3 as (select l.id, 3, 'rue', count(*), median(x.price_per_sqm), quantile_cont(x.price_per_sqm, 0.25), quantile_cont(x.price_per_sqm, 0.75)
        from l join l x on x.id <> l.id and x.street = l.street and x.deal_type = l.deal_type group by 1 having count(*) >= 5),
    t as (select *, row_number() over (partition by id order by prio) as rn from (select * from t1 union all select * from t2 union all select * from t3)),
    bench as (select l.id, l.deal_type, l.price_per_sqm, niveau, n as n_comparables, m, p25, p75, cast(floor((l.price_per_sqm / nullif(m, 0) - 1) * 100 + 0.5) as int) as ecart_pct,
        case when niveau = 'rue' then 30 else 15 end as seuil_pct, case when niveau = 'immeuble_chambres' and n >= 8 then 'forte' when niveau <> 'rue' then 'moyenne' else 'faible' end as confiance
        from l join t on t.id = l.id and rn = 1)"""


@query("listing_benchmarks", f"with {BENCH_SQL} select id, niveau, n_comparables, {s4('m')} as median_ppsqm, {s4('p25')} as p25_ppsqm, {s4('p75')} as p75_ppsqm, ecart_pct, seuil_pct, confiance from bench")
def listing_benchmarks(spark, sf):
    out = benchmarks.listing_benchmarks(fx.sane_listings(spark, sf))
    return out.select("id", "niveau", "n_comparables", r4("median_ppsqm"), r4("p25_ppsqm"), r4("p75_ppsqm"), "ecart_pct", "seuil_pct", "confiance")


@query("opportunities", f"with {BENCH_SQL} select id, niveau, ecart_pct, seuil_pct, confiance from bench where ecart_pct <= -seuil_pct and price_per_sqm <= p25")
def opportunities(spark, sf):
    out = benchmarks.opportunities(benchmarks.listing_benchmarks(fx.sane_listings(spark, sf)))
    return out.select("id", "niveau", "ecart_pct", "seuil_pct", "confiance")


def deals(spark, sf) -> DataFrame:
    return benchmarks.sale_deals(active(spark, sf), original_prices(spark, sf))


def ref_sql(key: str, deal: str, name: str) -> str:
    """The mean of the ten middle prices among the others of a key, the plain way: all pairs."""
    return f"""{name} as (select id, count(*) as n, avg(case when rn > st and rn <= st + 10 then v end) as ref from (
            select a.id, b.price_per_sqm as v, row_number() over (partition by a.id order by b.price_per_sqm) as rn,
                greatest(0, least(cast(floor(count(*) over (partition by a.id) / 2) as bigint) - 5, count(*) over (partition by a.id) - 10)) as st
            from k a join k b on a.{key} = b.{key} and a.id <> b.id and a.deal_type = 'sale' and b.deal_type = '{deal}') group by 1 having count(*) >= 3)"""


DEALS_SQL = f"""{ACTIVE_SQL}, {fx.HISTORY_SQL}, orig as (select id, max(price) as original from history group by 1),
    k as (select *, case when {N1} <> '' then {N1} || '|' || least(bedrooms, 4) end as ck, case when street <> '' then street || '|' || least(bedrooms, 4) end as sk from act where price_per_sqm is not null and bedrooms is not null),
    {ref_sql('ck', 'sale', 'cs')}, {ref_sql('sk', 'sale', 'ss')}, {ref_sql('ck', 'rent', 'cr')}, {ref_sql('sk', 'rent', 'sr')},
    deals as (select k.id, khet, bedrooms, floor((coalesce(cs.ref, ss.ref) - price_per_sqm) / coalesce(cs.ref, ss.ref) * 1000 + 0.5) / 10 as market_discount_pct,
        case when cs.ref is not null then 'condo' when ss.ref is not null then 'street' end as compare_basis,
        floor((cs.ref - price_per_sqm) / cs.ref * 1000 + 0.5) / 10 as condo_discount_pct, floor((ss.ref - price_per_sqm) / ss.ref * 1000 + 0.5) / 10 as street_discount_pct,
        case when original > price then floor((original - price) / original * 1000 + 0.5) / 10 when original > 0 then 0 end as temporal_discount_pct,
        floor(coalesce(cr.ref, sr.ref) * 12 / price_per_sqm * 1000 + 0.5) / 10 as est_yield_pct, case when cr.ref is not null then 'condo' when sr.ref is not null then 'street' end as yield_basis,
        coalesce(cs.n, ss.n) as comparable_count, case when coalesce(cs.n, ss.n) < 5 then 'low' when coalesce(cs.n, ss.n) < 10 then 'medium' when coalesce(cs.n, ss.n) is not null then 'high' end as confidence
        from k left join cs on cs.id = k.id left join ss on ss.id = k.id left join cr on cr.id = k.id left join sr on sr.id = k.id left join orig on orig.id = k.id where deal_type = 'sale')"""
DEAL_COLUMNS = "id, khet, bedrooms, market_discount_pct, compare_basis, condo_discount_pct, street_discount_pct, temporal_discount_pct, est_yield_pct, yield_basis, comparable_count, confidence"


@query("sale_deals", f"with {DEALS_SQL} select {DEAL_COLUMNS} from deals")
def sale_deals(spark, sf):
    return deals(spark, sf).select(*DEAL_COLUMNS.split(", "))


@query("best_discounts", f"with {DEALS_SQL} select id, market_discount_pct, confidence from deals where bedrooms = 2 and market_discount_pct is not null order by 2 desc, 1 limit 20")
def best_discounts(spark, sf):
    return benchmarks.best(deals(spark, sf), "market_discount_pct", "2").select("id", "market_discount_pct", "confidence")


@query("best_yields", f"with {DEALS_SQL} select id, est_yield_pct, yield_basis from deals where bedrooms = 1 and est_yield_pct is not null order by 2 desc, 1 limit 20")
def best_yields(spark, sf):
    return benchmarks.best(deals(spark, sf), "est_yield_pct", "1").select("id", "est_yield_pct", "yield_basis")


@query("best_discounts_by_district", f"""with {DEALS_SQL} select khet, rank, id, market_discount_pct from (select *, row_number() over (partition by khet order by market_discount_pct desc, id) as rank
    from deals where bedrooms >= 4 and market_discount_pct is not null and khet is not null) where rank <= 10""")
def best_discounts_by_district(spark, sf):
    return benchmarks.best_by_district(deals(spark, sf), "market_discount_pct", "4+").select("khet", "rank", "id", "market_discount_pct")


UNIT_SQL = f"""{ACTIVE_SQL}, u as (select {N1} || '|' || coalesce(khet, '') || '|' || coalesce(cast(bedrooms as varchar), '?') as unit, * from act where condo_name is not null),
    p as (select a.id, b.id as counterpart_id, b.price as counterpart_price, case when a.deal_type = 'sale' then a.price else b.price end as s, case when a.deal_type = 'rent' then a.price else b.price end as r,
        row_number() over (partition by a.id order by case when coalesce(a.area_sqm, 0) = 0 then 0 else coalesce(abs(a.area_sqm - b.area_sqm), 1e300) end, b.id) as rn
        from u a join u b on a.unit = b.unit and a.deal_type <> b.deal_type
        and (coalesce(a.area_sqm, 0) = 0 or coalesce(b.area_sqm, 0) = 0 or abs(a.area_sqm - b.area_sqm) / greatest(a.area_sqm, b.area_sqm) <= 0.07)),
    matches as (select id, counterpart_id, counterpart_price, floor(r * 12 / s * 1000 + 0.5) / 10 as annual_yield_pct from p where rn = 1)"""


@query("unit_matches", f"with {UNIT_SQL} select * from matches")
def unit_matches(spark, sf):
    return matching.unit_matches(active(spark, sf))


@query("cross_source_duplicates", f"""with {LISTINGS_SQL}, a as (select * from listings where status = 'active' and lat is not null and lng is not null)
    select a.id as id_a, a.source as source_a, a.condo_name as name_a, b.id as id_b, b.source as source_b, b.condo_name as name_b, a.bedrooms, a.area_sqm as area_a, b.area_sqm as area_b,
        a.price as price_a, b.price as price_b, a.khet, floor((abs(a.lat - b.lat) + abs(a.lng - b.lng)) * 1e5 + 0.5) / 1e5 as coord_delta
    from a join a b on coalesce(a.bedrooms, -1) = coalesce(b.bedrooms, -1) and a.source < b.source and abs(a.lat - b.lat) < 0.0015 and abs(a.lng - b.lng) < 0.0015
        and (a.area_sqm is null or b.area_sqm is null or abs(a.area_sqm - b.area_sqm) <= greatest(a.area_sqm, b.area_sqm) * 0.15)""")
def cross_source_duplicates(spark, sf):
    return matching.cross_source_duplicates(fx.listings(spark, sf))


REPOST_SQL = f"""{LISTINGS_SQL}, n as (select *, {N4} as ckey from listings where condo_name is not null and area_sqm is not null and bedrooms is not null and price > 0),
    pairs as (select a.id as id_a, b.id as id_b, a.source, a.deal_type, a.khet, a.bedrooms, a.price as price_a, b.price as price_b, {s4('abs(a.price - b.price) / greatest(a.price, b.price)')} as price_gap,
        a.status = 'active' and b.status = 'active' as both_active,
        coalesce(a.delisted_at is not null and b.first_seen > a.delisted_at and b.first_seen < a.delisted_at + interval '90' day, false) as sequential, a.agent_id = b.agent_id as same_agent
    from n a join n b on a.ckey = b.ckey and a.khet = b.khet and a.bedrooms = b.bedrooms and a.deal_type = b.deal_type and a.source = b.source and abs(a.area_sqm - b.area_sqm) < 0.01 and a.id < b.id)"""


@query("repost_pairs", f"with {REPOST_SQL} select * from pairs")
def repost_pairs(spark, sf):
    return matching.repost_pairs(fx.listings(spark, sf))


@query("repost_verdicts", f"""with {REPOST_SQL} select id_a, id_b, case when both_active then 'distinct_units' when sequential and price_gap < 0.02 then 'same_unit' else 'open' end as verdict from pairs""")
def repost_verdicts(spark, sf):
    return matching.repost_verdicts(matching.repost_pairs(fx.listings(spark, sf))).select("id_a", "id_b", "verdict")


def clock() -> tuple[Column, Column]:
    """The pinned present, and from when on delistings count."""
    return F.expr(fx.AS_OF), F.expr(fx.CUT_OFF)


def mid_sql(v: str) -> str:
    return f"case when {v} is null then null when (select count({v}) from raw) <= 1 then 50.0 else ((select count(*) from raw o where o.{v} < raw.{v}) + 0.5 * (select count(*) from raw o where o.{v} = raw.{v})) / (select count({v}) from raw) * 100 end"


def tension_sql(group: str, where: str, snaps: bool) -> str:
    avg3 = lambda c: f"(select avg(x) from (select unnest({c}[greatest(0, least(len({c}) // 2 - 1, len({c}) - 3)) + 1 : greatest(0, least(len({c}) // 2 - 1, len({c}) - 3)) + 3]) as x))"
    d = lambda a, b: f"(epoch_us({b}) - epoch_us({a})) / 86400e6"
    gone = f"status <> 'active' and first_seen is not null and delisted_at is not null and delisted_at >= {fx.CUT_OFF}"
    trend = f"""tr as (select {group} as g, case when count(*) >= 3 then regr_slope(active_count, x) end as stock_trend, case when count(median_psqm) >= 3 then regr_slope(median_psqm, x) end as price_momentum, count(*) as n_snap
        from (select *, {d('min(taken_at) over (partition by ' + group + ')', 'taken_at')} as x from snaps where deal_type = 'sale') group by 1)"""
    none = f"tr as (select cast(null as varchar) as g, cast(null as double) as stock_trend, cast(null as double) as price_momentum, 0 as n_snap)"
    return f"""with {SANE_SQL}, {SNAPSHOT_SQL}, {trend if snaps else none},
    g as (select {group} as g, count(*) filter (status = 'active') as n_active, count(*) filter ({gone}) as n_delisted, count(distinct case when status = 'active' and {N1} <> '' then {N1} end) as n_condos,
        list_sort(list({d('first_seen', fx.AS_OF)}) filter (status = 'active' and {d('first_seen', fx.AS_OF)} > 0)) as ages,
        list_sort(list({d('first_seen', 'delisted_at')}) filter ({gone} and {d('first_seen', 'delisted_at')} > 0)) as lives, count(*) filter ({gone} and {d('first_seen', 'delisted_at')} >= 0) as n_lives
        from sane where {group} is not null and {group} <> '' and {where} group by 1),
    h as (select g.*, case when n_condos >= 3 then n_active / n_condos end as pressure, {avg3('ages')} as age, case when n_lives >= 3 then {avg3('lives')} end as tom from g),
    raw as (select h.*, coalesce(tom, age) as absorption, stock_trend, price_momentum, coalesce(n_snap, 0) as n_snap from h left join tr on tr.g = h.g),
    ranked as (select *, 100 - ({mid_sql('absorption')}) as a, 100 - ({mid_sql('pressure')}) as p, 100 - ({mid_sql('stock_trend')}) as s, {mid_sql('price_momentum')} as m from raw),
    scored as (select *, floor((coalesce(a * 35, 0) + coalesce(p * 25, 0) + coalesce(s * 20, 0) + coalesce(m * 20, 0)) /
        nullif(case when a is null then 0 else 35 end + case when p is null then 0 else 25 end + case when s is null then 0 else 20 end + case when m is null then 0 else 20 end, 0) + 0.5) as score from ranked),
    centre as (select median(score) as c from scored where n_active >= 10)
    select scored.g as {group}, n_active, n_delisted, n_condos, floor(pressure * 100 + 0.5) / 100 as supply_pressure, floor(age + 0.5) as median_age_days, floor(tom + 0.5) as median_tom_days,
        {(s4('stock_trend') + ' as stock_trend, ' + s4('price_momentum') + ' as price_momentum,') if snaps else ''}
        case when n_active >= 10 then floor(case when c is null then score else (n_active * score + 20 * c) / (n_active + 20) end + 0.5) end as tension_score,
        case when n_active < 3 then 'low' when n_active >= 8 and (n_delisted >= 3 or n_snap >= 4) then 'high' else 'medium' end as confidence
    from scored, centre"""


@query("tension_by_district", tension_sql("khet", "deal_type = 'sale'", True))
def tension_by_district(spark, sf):
    out = tension.tension_by_district(fx.sane_listings(spark, sf), snapshots(spark, sf), "sale", *clock())
    return out.withColumns({c: half_up(F.col(c), 4) for c in ("stock_trend", "price_momentum")})


@query("tension_by_street", tension_sql("street", "deal_type = 'sale' and khet = 'Brand#11 District'", False))
def tension_by_street(spark, sf):
    return tension.tension_by_street(fx.sane_listings(spark, sf), "Brand#11 District", "sale", *clock())


@query("seller_pressure", f"""with {SANE_SQL} select khet, count(*) filter (status = 'active') as n_active, count(distinct case when status = 'active' and {N1} <> '' then {N1} end) as n_condos,
    case when count(distinct case when status = 'active' and {N1} <> '' then {N1} end) >= 3 then {s4("count(*) filter (status = 'active') / count(distinct case when status = 'active' and " + N1 + " <> '' then " + N1 + " end)")} end as pressure
    from sane where khet is not null and khet <> '' group by 1""")
def seller_pressure(spark, sf):
    return tension.pressure(fx.sane_listings(spark, sf), "khet")


@query("midrank", f"""with {SANE_SQL}, raw as (select khet, floor(avg(price) / 1e5) as v from sane where khet is not null group by 1) select khet, v, {s4(mid_sql('v'))} as pct from raw""")
def midrank(spark, sf):
    per = fx.sane_listings(spark, sf).where("khet is not null").groupBy("khet").agg(F.floor(F.avg("price") / 1e5).cast("double").alias("v"))
    return per.select("khet", "v", half_up(mid_rank(F.col("v")), 4).alias("pct"))


@query("slopes", f"""with {LISTINGS_SQL}, {SNAPSHOT_SQL} select khet, deal_type, case when count(*) >= 3 then {s4("regr_slope(active_count, (epoch_us(taken_at) / 86400e6))")} end as slope from snaps group by 1, 2""")
def slopes(spark, sf):
    x = F.unix_micros(F.col("taken_at").cast("timestamp")) / 86_400e6
    return snapshots(spark, sf).groupBy("khet", "deal_type").agg(half_up(slope(F.col("active_count").cast("double"), x), 4).alias("slope"))


@query("median_avg", f"""with {ACTIVE_SQL}, l as (select khet, list_sort(list(price_per_sqm) filter (price_per_sqm > 0)) as v from act where khet is not null group by 1)
    select khet, {s4("(select avg(x) from (select unnest(v[greatest(0, least(len(v) // 2 - 5, len(v) - 10)) + 1 : greatest(0, least(len(v) // 2 - 5, len(v) - 10)) + 10]) as x))")} as avg_middle from l""")
def median_avg(spark, sf):
    rows = active(spark, sf).where("khet is not null")
    means = middle_means(rows, ["khet"], F.col("price_per_sqm"), "m", 10)
    return rows.select("khet").distinct().join(means, "khet", "left").select("khet", half_up(F.col("m"), 4).alias("avg_middle"))


ENRICH_SQL = f"""{ACTIVE_SQL}, b as (select *, {N2} as building from act where price_per_sqm > 0 and {N2} <> ''), sales as (select * from b where deal_type = 'sale'),
    rents as (select building, median(price_per_sqm) as rent_med, count(*) as n_rent from b where deal_type = 'rent' group by 1),
    others as (select a.id, median(x.price_per_sqm) as others from sales a join sales x on a.building = x.building and a.id <> x.id group by 1),
    whole as (select building, median(price_per_sqm) as w, count(*) as n_sale from sales group by 1),
    e0 as (select sales.*, n_sale, coalesce(n_rent, 0) as n_rent, case when n_sale >= 3 then others else w end as sm, rent_med from sales join whole using (building) left join others on others.id = sales.id left join rents on rents.building = sales.building),
    e as (select *, floor((sm - price_per_sqm) / sm * 1000 + 0.5) / 10 as discount_pct, floor(rent_med * 12 / price_per_sqm * 100 * 10 + 0.5) / 10 as yield_pct from e0)"""


@query("study_enriched", f"with {ENRICH_SQL} select id, building, discount_pct, yield_pct, n_sale, n_rent, coalesce(discount_pct, 0) > 40 or coalesce(yield_pct, 0) > 9.5 as flag from e")
def study_enriched(spark, sf):
    return study.enriched(active(spark, sf)).select("id", "building", "discount_pct", "yield_pct", "n_sale", "n_rent", "flag")


SCORE = """(least(greatest(case when n_sale >= 3 then coalesce(discount_pct, 0) else 0 end, 0), 45) + greatest(least(case when n_rent >= 3 then coalesce(yield_pct, 0) else 0 end, 9) - 4.5, 0) * 3)
    * case when coalesce(discount_pct, 0) > 45 or coalesce(yield_pct, 0) > 10 then 0.25 else 1 end"""


@query("study_opportunities", f"""with {ENRICH_SQL}, s as (select *, {s4(SCORE)} as score from e where khet is not null and khet like 'Brand#%2%' and price between 800000 and 100000000 and ((n_sale >= 3 and discount_pct > 0) or (n_rent >= 3 and yield_pct >= 5.5))),
    o as (select *, row_number() over (partition by khet, building order by score desc, id) as rb from s), t as (select *, row_number() over (partition by khet order by score desc, id) as rank from o where rb = 1)
    select khet, rank, id, building, discount_pct, yield_pct, n_sale, n_rent, score, coalesce(discount_pct, 0) > 40 or coalesce(yield_pct, 0) > 9.5 as flag from t where rank <= 10""")
def study_opportunities(spark, sf):
    rows = study.enriched(active(spark, sf))
    return study.study_opportunities(rows, rows.where("khet like 'Brand#%2%'").select("khet").distinct())


GONE_SQL = f"{ACTIVE_SQL}, gone as (select * from sane where deal_type = 'sale' and status <> 'active' and delisted_at >= {fx.CUT_OFF})"


def gone(spark, sf) -> DataFrame:
    return fx.sane_listings(spark, sf).where(f"deal_type = 'sale' and status <> 'active' and delisted_at >= {fx.CUT_OFF}")


@query("delisting_by_district", f"""with {GONE_SQL}, a as (select khet, count(*) as n from act where deal_type = 'sale' and khet is not null and source in (select source from gone) group by 1)
    select gone.khet, count(*) as n_delisted, coalesce(max(a.n), 0) as active_sale, floor(count(*) / (count(*) + coalesce(max(a.n), 0)) * 1000 + 0.5) / 10 as delist_rate_pct,
        median(case when epoch_us(delisted_at) > epoch_us(first_seen) + 86399999999 then floor((epoch_us(delisted_at) - epoch_us(first_seen)) / 86400e6) end) as median_days_active,
        median(case when price > 0 then price end) as median_price from gone left join a on a.khet = gone.khet where gone.khet is not null group by 1""")
def delisting_by_district(spark, sf):
    return study.delisting_by_district(active(spark, sf), gone(spark, sf))


TYPO = "case when coalesce(bedrooms, 0) <= 1 then 'studio/1BR' when bedrooms = 2 then '2BR' else '3BR+' end || ' | ' || case when price < 3e6 then '<3M' when price < 6e6 then '3-6M' when price < 12e6 then '6-12M' else '>12M' end"


@query("typology_churn", f"""with {GONE_SQL}, a as (select {TYPO} as typo, count(*) as n from act where deal_type = 'sale' and source in (select source from gone) group by 1), d as (select {TYPO} as typo, count(*) as n_delisted from gone group by 1)
    select typo, n_delisted, coalesce(n, 0) as active, floor(n_delisted / (n_delisted + coalesce(n, 0)) * 1000 + 0.5) / 10 as churn_pct from d left join a using (typo)""")
def typology_churn(spark, sf):
    return study.typology_churn(active(spark, sf), gone(spark, sf))


@query("per_1000", f"""with {ACTIVE_SQL}, pop as (select p_brand || ' District' as khet, 1000 * count(*) as population from part group by 1),
    c as (select khet, count(*) filter (deal_type = 'sale') as s, count(*) filter (deal_type = 'rent') as r from act where khet is not null group by 1)
    select khet, population, floor(coalesce(s, 0) / population * 1e5 + 0.5) / 100 as sale_per_1000, floor(coalesce(r, 0) / population * 1e5 + 0.5) / 100 as rent_per_1000 from pop left join c using (khet)""")
def per_1000(spark, sf):
    population = fx.table(spark, sf, "part").groupBy(F.concat("p_brand", F.lit(" District")).alias("khet")).agg((F.count("*") * 1000).alias("population"))
    return study.per_1000(active(spark, sf), population)


def basket_sql(name: str, where: str) -> str:
    return f"""{name} as (select {N2} as building, arg_min(khet, id) filter (khet is not null) as khet, floor(median(price_per_sqm) filter (deal_type = 'sale') + 0.5) as sale_m2, floor(median(price_per_sqm) filter (deal_type = 'rent') * 10 + 0.5) / 10 as rent_m2
        from sane where {N2} <> '' and price_per_sqm > 0 and {where} group by 1)"""


@query("constant_basket", f"""with {SANE_SQL}, {basket_sql('ea', "first_seen < TIMESTAMP '1998-07-01 00:00:00'")}, {basket_sql('eb', 'true')},
    x as (select coalesce(eb.khet, ea.khet) as khet, case when ea.sale_m2 <> 0 and eb.sale_m2 <> 0 then 100 * (eb.sale_m2 / ea.sale_m2 - 1) end as v, case when ea.rent_m2 <> 0 and eb.rent_m2 <> 0 then 100 * (eb.rent_m2 / ea.rent_m2 - 1) end as l from ea join eb using (building))
    select khet, count(v) as n_sale, {s4('median(case when v > 0 then v end)')} as sale_change_pct, count(l) as n_rent, {s4('median(case when l > 0 then l end)')} as rent_change_pct from x where khet is not null group by 1 having count(v) >= 8""")
def constant_basket(spark, sf):
    rows = fx.sane_listings(spark, sf)
    early = rows.where("first_seen < TIMESTAMP '1998-07-01 00:00:00'")
    return study.constant_basket(study.building_prices(early), study.building_prices(rows))


@query("edition_evolution", f"""with {LISTINGS_SQL}, {SNAPSHOT_SQL}, s as (select *, lag(v) over (partition by khet order by taken_at) as previous, row_number() over (partition by khet order by taken_at desc) as rn
        from (select khet, taken_at, floor(median_psqm + 0.5) as v from snaps where deal_type = 'sale'))
    select khet, strftime(taken_at, '%Y-%m-%d') as taken_on, v as psqm, previous, floor((v - previous) / previous * 1e4 + 0.5) / 100 as change_pct from s where rn = 1""")
def edition_evolution(spark, sf):
    series = snapshots(spark, sf).where("deal_type = 'sale'").select("khet", "taken_at", half_up(F.col("median_psqm")).alias("psqm"))
    return study.edition_changes(series, "khet", "taken_at", "psqm").withColumn("taken_on", F.date_format("taken_at", "yyyy-MM-dd")).drop("taken_at")


@query("sparklines", f"""with {LISTINGS_SQL}, {SNAPSHOT_SQL}, s as (select khet, taken_at, active_count, min(active_count) over (partition by khet) as lo, max(active_count) over (partition by khet) as hi, count(*) over (partition by khet) as n from snaps where deal_type = 'sale')
    select khet, strftime(taken_at, '%Y-%m-%d') as taken_on, active_count, cast(case when n < 2 then null when hi = lo then 3 else least(7, floor((active_count - lo) / (hi - lo) * 7.99)) end as int) as level from s""")
def sparklines(spark, sf):
    series = snapshots(spark, sf).where("deal_type = 'sale'")
    return study.sparkline(series, "khet", "taken_at", "active_count").withColumn("taken_on", F.date_format("taken_at", "yyyy-MM-dd")).drop("taken_at")
