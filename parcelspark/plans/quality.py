"""Building dimension, votes, coverage, judgement, reconciliation and ledger queries on the fixture."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import quality as q
from ..sources import fixture as fx
from ..sources.fixture import LISTINGS_SQL, RUNS_SQL, SANE
from .market import N3
from .registry import query


@query("condos_dim", f"""with {LISTINGS_SQL} select condo_name, arg_max(khet, (first_seen, id)) filter (khet is not null) as khet, floor(avg(lat) * 1e4 + 0.5) / 1e4 as lat, floor(avg(lng) * 1e4 + 0.5) / 1e4 as lng,
    count(*) filter (deal_type = 'sale') as n_sale, count(*) filter (deal_type = 'rent') as n_rent from listings where condo_name is not null group by 1""")
def condos_dim(spark, sf):
    return q.buildings(fx.listings(spark, sf))


@query("condos_merge", f"""with {LISTINGS_SQL}, o as (select condo_name, arg_max(khet, (first_seen, id)) filter (khet is not null) as khet from listings where condo_name is not null and deal_type = 'sale' group by 1),
    n as (select condo_name, arg_max(khet, (first_seen, id)) filter (khet is not null) as khet from listings where condo_name is not null and deal_type = 'rent' group by 1)
    select coalesce(n.condo_name, o.condo_name) as condo_name, coalesce(n.khet, o.khet) as khet from n full join o on n.condo_name = o.condo_name""")
def condos_merge(spark, sf):
    rows = fx.listings(spark, sf)
    old, new = (q.buildings(rows.where(F.col("deal_type") == d)) for d in ("sale", "rent"))
    return q.merge_buildings(old, new).select("condo_name", "khet")


VOTE = "1990 + (l_partkey + (case when l_linenumber = 1 then 1 else 0 end)) % 35"


@query("year_votes", f"""with {LISTINGS_SQL}, v as (select {N3} as building, cast({VOTE} as int) as year, source from listings where condo_name is not null),
    p as (select building, year, count(distinct source) as n from v group by 1, 2), t as (select building, count(distinct source) as s from v group by 1),
    r as (select p.*, s, count(*) over (partition by building) as kinds, row_number() over (partition by building order by n desc, year) as rank, count(*) over (partition by building, n) as ties from p join t using (building)),
    w as (select *, case when kinds = 1 and s >= 3 then 'valid ' || s || ' sources' when kinds = 1 and s = 2 then 'corroborated 2 sources' when kinds = 1 then 'single source'
        when n >= 3 and ties = 1 then 'valid ' || n || '/' || s || ' sources' else 'conflict ' || kinds || ' values / ' || s || ' sources' end as verdict from r where rank = 1)
    select building, case when verdict not like 'conflict%' then year end as year, verdict from w""")
def year_votes(spark, sf):
    return q.year_votes(fx.listings(spark, sf).selectExpr("condo_name", "source", f"cast({VOTE} as int) as year"))


# No two listings of the fixture agree in all keys, so buildings, areas and prices are made coarse.
COARSE = {"condo_name": "khet", "area_sqm": "floor(area_sqm / 200)", "price": "floor(price / 3e7)"}


@query("agent_duplicates", f"""with {LISTINGS_SQL}, c as (select id, first_seen, status, agent_id, deal_type, bedrooms, {", ".join(f"{e} as {n}" for n, e in COARSE.items())} from listings)
    select agent_id, condo_name, deal_type, bedrooms, area_sqm, price, count(*) as n, array_to_string(list(id order by first_seen, id), ',') as ids, strftime(min(first_seen), '%Y-%m-%d') as oldest
    from c where status = 'active' and agent_id is not null and condo_name is not null group by all having count(*) > 1""")
def agent_duplicates(spark, sf):
    rows = fx.listings(spark, sf).select("id", "first_seen", "status", "agent_id", "deal_type", "bedrooms", *[F.expr(e).alias(n) for n, e in COARSE.items()])
    out = q.agent_duplicates(rows)
    return out.withColumn("ids", F.array_join("ids", ",")).withColumn("oldest", F.date_format("oldest", "yyyy-MM-dd"))


FIELDS = ["area_sqm", "bedrooms", "condo_name", "khet", "street", "quota"]


@query("coverage_by_source", f"with {LISTINGS_SQL} " + " union all ".join(f"select source, '{f}' as field, floor(count({f}) / count(*) * 1000 + 0.5) / 10 as pct from listings group by 1" for f in FIELDS))
def coverage_by_source(spark, sf):
    return q.coverage(fx.listings(spark, sf), "source", FIELDS)


@query("typology_pivot", f"""with {LISTINGS_SQL} select khet, count(*) as n, count(*) filter (bedrooms = 0) as studio, count(*) filter (bedrooms = 1) as one, count(*) filter (bedrooms = 2) as two,
    count(*) filter (bedrooms >= 3) as three_up, count(*) filter (bedrooms is null) as unknown from listings where khet is not null group by 1 order by 2 desc, 1 limit 12""")
def typology_pivot(spark, sf):
    return q.bedroom_pivot(fx.listings(spark, sf), 12)


EDGES = [1e6, 3e6, 6e6, 1.2e7]


@query("price_bands", f"with {LISTINGS_SQL} select deal_type, " + " + ".join(f"case when price >= {e} then 1 else 0 end" for e in EDGES) + " as band, count(*) as n from listings group by 1, 2")
def price_bands(spark, sf):
    return q.price_bands(fx.listings(spark, sf), EDGES)


@query("counts_by_source", f"with {LISTINGS_SQL} select source, deal_type, count(*) as n, count(*) filter (status = 'active') as n_active from listings group by 1, 2")
def counts_by_source(spark, sf):
    return fx.listings(spark, sf).groupBy("source", "deal_type").agg(F.count("*").alias("n"), F.count(F.when(F.col("status") == "active", 1)).alias("n_active"))


@query("cadence", "select event_type, hour(ts) as hour, count(*) as n from events group by 1, 2")
def cadence(spark, sf):
    return fx.table(spark, sf, "events").groupBy("event_type", F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))


LIMITS = {"area_sqm": 80.0, "bedrooms": 90.0, "condo_name": 99.0, "khet": 95.0}
JUDGE_SQL = " union all ".join(
    [f"select source, '{f}' as \"check\", floor(count({f}) / count(*) * 1e4 + 0.5) / 100 as value, floor(count({f}) / count(*) * 1e4 + 0.5) / 100 >= {v} as passed from listings group by 1" for f, v in LIMITS.items()]
    + [f"select source, 'plausible', floor(count(*) filter ({SANE}) / count(*) * 1e4 + 0.5) / 100, floor(count(*) filter ({SANE}) / count(*) * 1e4 + 0.5) / 100 >= 80 from listings group by 1"]
    + ["select source, 'collisions', cast(count(*) - count(distinct id) as double), count(*) = count(distinct id) from listings group by 1"]
)


@query("quality_judge", f"with {LISTINGS_SQL} {JUDGE_SQL}")
def quality_judge(spark, sf):
    return q.judge(fx.listings(spark, sf), LIMITS, F.expr(SANE))


RECON_SQL = f"""{LISTINGS_SQL}, u as (select * from listings where l_linenumber <= 6 qualify row_number() over (partition by id order by price) = 1),
    a as (select id, price, status from u where l_linenumber <> 2), b as (select id, case when l_linenumber = 3 then price + 1 else price end as price, status from u where l_linenumber <> 5)"""


def two_sides(spark, sf) -> tuple[DataFrame, DataFrame]:
    one = fx.listings(spark, sf).where("l_linenumber <= 6").groupBy("id").agg(F.min(F.struct("price", "status", "l_linenumber")).alias("s")).select("id", "s.*")
    return one.where("l_linenumber <> 2").select("id", "price", "status"), one.where("l_linenumber <> 5").withColumn("price", F.expr("case when l_linenumber = 3 then price + 1 else price end")).select("id", "price", "status")


@query("reconcile", f"""with {RECON_SQL} select coalesce(a.id, b.id) as id, case when b.id is null then 'new' when a.id is null then 'absent' else 'both' end as state,
    concat_ws(',', case when a.id is not null and b.id is not null and a.price is distinct from b.price then 'price' end, case when a.id is not null and b.id is not null and a.status is distinct from b.status then 'status' end) as changed from a full join b on a.id = b.id""")
def reconcile(spark, sf):
    return q.reconcile(*two_sides(spark, sf), "id", ["price", "status"])


@query("missing_ids", f"with {RECON_SQL} select id from a where id not in (select id from b)")
def missing_ids(spark, sf):
    a, b = two_sides(spark, sf)
    return q.silent(a.select("id"), b.select("id"), "id")


SPANS_SQL = "spans as (select event_type as agent, date_trunc('day', ts) as s, max(ts) as e from events where event_id % 3 = 0 group by 1, 2)"


@query("orphan_scans", f"""with {RUNS_SQL}, {SPANS_SQL} select event_id, agent from runs where not exists (select 1 from spans where spans.agent = runs.agent and started_at >= s and started_at <= e + interval '10' minute)""")
def orphan_scans(spark, sf):
    rows = fx.runs(spark, sf)
    spans = rows.where("event_id % 3 = 0").groupBy("agent", F.date_trunc("day", "started_at").alias("start")).agg(F.max("started_at").alias("end"))
    return q.orphans(rows, spans, "agent", "started_at").select("event_id", "agent")


@query("silent_agents", f"with {RUNS_SQL} select distinct agent from runs where agent not in (select agent from runs where started_at >= (select max(started_at) - interval '1' minute from runs))")
def silent_agents(spark, sf):
    rows = fx.runs(spark, sf)
    latest = rows.agg((F.max("started_at") - F.expr("interval 1 minute")).alias("since"))
    seen = rows.join(F.broadcast(latest), rows.started_at >= F.col("since")).select("agent").distinct()
    return q.silent(rows.select("agent").distinct(), seen, "agent")


LAST_SQL = "o as (select *, row_number() over (partition by agent order by started_at desc, event_id desc) as rn from runs)"


@query("latest_runs", f"with {RUNS_SQL}, {LAST_SQL} select agent, event_id, status from o where rn <= 10")
def latest_runs(spark, sf):
    return q.last_runs(fx.runs(spark, sf), 10).select("agent", "event_id", "status")


# Scan runs of many sources: what was new, errors, lost images; a part without figures.
HEALTH = {
    "event_id": "event_id", "agent": "concat(event_type, '-', cast(user_id % 40 as string))", "started_at": "ts", "status": "case when value < 1e1 then 'failed' else 'ok' end",
    "new": "case when event_id % 11 = 0 then null when event_id % 13 < 2 then 0e0 else floor(value) end", "errors": "case when event_id % 26 = 0 then 3 else 0 end",
    "image_errors": "case when event_id % 5 = 0 then 12 when event_id % 5 = 1 then null else 1 end",
}


@query("source_health", f"""with h as (select {", ".join(f"{e} as {n}" for n, e in HEALTH.items())} from events), o as (select *, row_number() over (partition by agent order by started_at desc, event_id desc) as rn from h),
    u as (select agent, case when count(new) >= 3 then median(new) end as usual from o where rn <= 10 group by 1),
    l as (select *, row_number() over (partition by agent order by started_at desc, event_id desc) as ok from h where status = 'ok')
    select agent, new, usual, case when new is null then 'missing_metrics' when new = 0 and errors = 0 then 'broken_parser' when new = 0 then 'network_failure' when usual > 0 and new < 0.25 * usual then 'drift'
        when new > 90 and agent like 'click%' then 'unusual_volume' when coalesce(image_errors, 0) >= 10 then 'lost_images' else 'ok' end as class from l join u using (agent) where ok = 1""")
def source_health(spark, sf):
    runs = fx.table(spark, sf, "events").selectExpr(*[f"{e} as {n}" for n, e in HEALTH.items()])
    bands = runs.select("agent").distinct().where("agent like 'click%'").select("agent", F.lit(90.0).alias("most"))
    return q.health(runs, bands)


@query("failing_streaks", f"with runs as (select event_id, user_id as agent, ts as started_at, case when event_id % 3 = 0 then 'ok' else 'failed' end as status from events), {LAST_SQL} select agent from o where rn <= 2 group by 1 having count(*) filter (status = 'failed') = 2")
def failing_streaks(spark, sf):
    """Users as agents, two thirds of whose events are failures."""
    rows = fx.table(spark, sf, "events").selectExpr("event_id", "user_id as agent", "ts as started_at", "case when event_id % 3 = 0 then 'ok' else 'failed' end as status")
    return q.streak(rows)


@query("dependency_gate", f"""with {RUNS_SQL}, {LAST_SQL}, n as (select distinct a.agent, b.agent as needs from runs a, runs b where a.agent < b.agent)
    select n.agent, bool_and(coalesce(o.status = 'ok', false)) as open from n left join o on o.agent = n.needs and rn = 1 group by 1""")
def dependency_gate(spark, sf):
    rows = fx.runs(spark, sf)
    agents = rows.select("agent").distinct()  # a handful of kinds
    needs = agents.join(agents.withColumnRenamed("agent", "needs"), F.col("agent") < F.col("needs"))
    return q.gate(rows, needs)


@query("problem_counts", f"with {RUNS_SQL} select agent, count(*) as n, count(*) filter (started_at >= (select max(started_at) from runs) - interval '7' day) as n_week from runs where status = 'failed' group by 1")
def problem_counts(spark, sf):
    rows = fx.runs(spark, sf)
    week = rows.agg((F.max("started_at") - F.expr("interval 7 days")).alias("since"))
    return rows.where("status = 'failed'").join(F.broadcast(week)).groupBy("agent").agg(F.count("*").alias("n"), F.count(F.when(F.col("started_at") >= F.col("since"), 1)).alias("n_week"))


@query("staleness", f"with {LISTINGS_SQL} select source, datediff('day', max(first_seen), {fx.AS_OF}) as age_days, datediff('day', max(first_seen), {fx.AS_OF}) > 8 as stale from listings group by 1")
def staleness(spark, sf):
    return q.stale(fx.listings(spark, sf), "source", "first_seen", F.expr(fx.AS_OF), 8)


ATTEMPT_SQL = "att as (select event_type as source, cast(user_id % 5 + 1 as int) as attempt, count(*) as n from events group by 1, 2)"


@query("crawl_convergence", f"""with {ATTEMPT_SQL}, g as (select *, n - lag(n) over (partition by source order by attempt) as gain from att)
    select source, attempt, n, coalesce(n >= 100000 or (attempt >= 2 and gain < greatest(20.0, n * 0.02)), false) as done from g""")
def crawl_convergence(spark, sf):
    rows = fx.table(spark, sf, "events").groupBy(F.col("event_type").alias("source"), (F.col("user_id") % 5 + 1).cast("int").alias("attempt")).agg(F.count("*").alias("n"))
    return q.converged(rows, 100_000)


@query("backup_check", """with l as (select 'orders' as name, count(*) as n from orders union all select 'part', count(*) from part union all select 'nation', count(*) from nation),
    a as (select 'orders' as name, count(*) as n from orders where o_orderkey % 2 = 0 union all select 'part', count(*) from part)
    select e.name, case when a.n is null then 'missing' when a.n < 0.9 * l.n then 'short' else 'ok' end as verdict from (values ('orders'), ('part'), ('nation')) e(name) left join a using (name) left join l using (name)""")
def backup_check(spark, sf):
    count = lambda name, where="true": fx.table(spark, sf, name).where(where).agg(F.lit(name).alias("name"), F.count("*").alias("n"))
    live = count("orders").union(count("part")).union(count("nation"))
    return q.backup_verdict(live.select("name"), count("orders", "o_orderkey % 2 = 0").union(count("part")), live)


@query("report_contracts", """select event_id, case event_id % 4 when 0 then '' when 1 then '' when 2 then 'n' else 'k,n' end as missing, event_id % 4 = 0 as honoured from events""")
def report_contracts(spark, sf):
    """Reports that are whole, whole but of a failed run, without a field, and no JSON."""
    k, props = F.col("event_id") % 4, F.col("props")
    body = F.when(k < 2, F.concat(F.lit('{"n": null, '), F.substr(props, F.lit(2)))).when(k == 2, props).otherwise("n: 1")
    rows = fx.table(spark, sf, "events").select(F.col("event_id").alias("key"), body.alias("body"), F.when(k == 1, "failed").otherwise("ok").alias("status"))
    return q.contract(rows, ["k", "n"]).withColumnRenamed("key", "event_id")


@query("retention", f"with {LISTINGS_SQL} select count(*) as n from listings where not coalesce(delisted_at < {fx.CUT_OFF}, false)")
def retention(spark, sf):
    rows = fx.listings(spark, sf)
    return q.retained(rows, rows.select("id"), "id", "delisted_at", F.expr(fx.CUT_OFF)).agg(F.count("*").alias("n"))


@query("replication", "select c_custkey, case when c_custkey % 2 = 0 then c_acctbal + 1 else c_acctbal end as c_acctbal from customer")
def replication(spark, sf):
    old = fx.table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return q.replicated(old, old.where("c_custkey % 2 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1), "c_custkey")


@query("storage_inventory", "select doc_id % 2 = 0 as kept_locally, count(*) as n, cast(sum(n_chars) as bigint) as bytes from documents group by 1")
def storage_inventory(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "n_chars")
    return q.inventory(docs, docs.where("doc_id % 2 = 0"), "doc_id", "n_chars")


@query("snapped_names", f"""with {LISTINGS_SQL}, n as (select distinct {N3} as name from listings where condo_name is not null), k as (select distinct p_name as known from part where length(p_name) >= 6)
    select name, (select known from k where contains(' ' || name || ' ', ' ' || known || ' ') order by length(known) desc, known desc limit 1) as snapped from n""")
def snapped_names(spark, sf):
    from ..functions.text import cohort_name

    names = fx.listings(spark, sf).where("condo_name is not null").select(cohort_name(F.col("condo_name")).alias("name"))
    return q.snapped_names(names, fx.table(spark, sf, "part").select(F.col("p_name").alias("known")))


@query("representatives", f"""with {LISTINGS_SQL} select condo_name, arg_min(id, (case source when 'urgent' then 0 when 'high' then 1 else 2 end, -epoch_us(first_seen), id)) as id from listings where condo_name is not null group by 1""")
def representatives(spark, sf):
    rank = F.when(F.col("source") == "urgent", 0).when(F.col("source") == "high", 1).otherwise(2)
    rows = fx.listings(spark, sf).where("condo_name is not null")
    return rows.groupBy("condo_name").agg(F.min_by("id", F.struct(rank.alias("a"), (-F.unix_micros(F.col("first_seen").cast("timestamp"))).alias("b"), F.col("id").alias("c"))).alias("id"))


@query("constant_basket_keys", f"with {LISTINGS_SQL} select distinct condo_name from listings where deal_type = 'sale' and condo_name is not null intersect select condo_name from listings where deal_type = 'rent'")
def constant_basket_keys(spark, sf):
    rows = fx.listings(spark, sf).where("condo_name is not null")
    return rows.where("deal_type = 'sale'").select("condo_name").intersect(rows.where("deal_type = 'rent'").select("condo_name"))
