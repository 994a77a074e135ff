"""Operations: logs, stages, interruptions, backups, tickets, sites, transfers, and how two stores agree, on the fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger
from ..operators import quality as q
from ..sources import fixture as fx
from ..sources.fixture import LISTINGS_SQL, SANE
from .market import N1
from .registry import query

C, L = F.col, F.lit


@query("log_metrics", """select p_partkey as k, case when p_partkey % 6 < 4 then p_partkey end as scanned, case when p_partkey % 6 < 4 then p_partkey % 7 end as new, case when p_partkey % 6 < 4 then 1 end as removed,
    case when p_partkey % 2 = 0 then 's1' end as snapshot, p_partkey % 3 as http_errors, case when p_partkey % 3 = 1 then 2 else 0 end as image_errors, case when p_partkey % 2 = 0 then 2 end as tables,
    case when p_partkey % 2 = 0 then p_partkey + 5 end as archived, case when p_partkey % 4 = 0 then p_partkey when p_partkey % 4 = 1 then 0 end as purged, case when p_partkey % 4 = 1 then true end as purge_refused,
    case when p_partkey % 5 = 0 then 2 else 0 end as tracebacks, p_partkey % 4 = 0 as outage from part""")
def log_metrics(spark, sf):
    """Logs of scans, some with a summary that breaks off, of replications, and of purges done, refused or not tried."""
    k = C("k")
    text = F.concat(
        L("  scannées : "), k, L(" | nouvelles : "), k % 7, L(" | changées : 3 | inchangées : 9\n"), F.when(k % 6 < 4, "retirées : 1 (4 photos)\n").otherwise(""),
        F.when(k % 2 == 0, F.concat(L("  snapshot : s1\n  a: 9 lignes serveur → 5 en archive\n  b: 8 lignes serveur → "), k, L(" en archive\n"))).otherwise(""),
        F.when(k % 4 == 0, F.concat(L("✓ "), k, L(" annonces purgées du serveur\n"))).when(k % 4 == 1, "purge ANNULÉE : archive incomplète\n").otherwise(""),
        F.repeat(L("HTTP error 503\n"), (k % 3).cast("int")), F.when(k % 3 == 1, "upload erreur x\nÉchec GET (bytes)\n").otherwise(""),
        F.when(k % 5 == 0, "Traceback\n[ERREUR] x\n").otherwise(""), F.when(k % 4 == 0, F.repeat(L("ConnectionError "), 3)).otherwise("ConnectionError"),
    )
    rows = fx.table(spark, sf, "part").select(C("p_partkey").alias("k")).select("k", text.alias("text"))
    out = ledger.log_metrics(rows)
    return out.select("k", "scanned", "new", "removed", "snapshot", "http_errors", "image_errors", "tables", "archived", "purged", "purge_refused", "tracebacks", ledger.outage(C("text")).alias("outage"))


@query("stage_times", """with p as (select o_custkey as run, o_orderpriority as stage, cast(o_orderkey % 100 as double) as s from orders), r as (select run, sum(s) + 25.0 as whole from p group by 1),
    g as (select run, stage, sum(s) as s, count(*) as calls from p group by 1, 2 union all select run, 'unmeasured', 25.0, 0 from r)
    select g.run, stage, floor(s * 10 + 0.5) / 10 as seconds, calls, floor(s * 1000 / whole + 0.5) / 10 as share_pct from g join r using (run)""")
def stage_times(spark, sf):
    times = fx.table(spark, sf, "orders").select(C("o_custkey").alias("run"), C("o_orderpriority").alias("stage"), (C("o_orderkey") % 100).cast("double").alias("seconds"))
    return ledger.stage_times(times, times.groupBy("run").agg((F.sum("seconds") + 25.0).alias("seconds")))


SLEEP_SQL = """r as (select event_id, ts as a, ts + to_minutes(event_id % 90) as b from events where event_id % 5 = 0), e as (select ts + interval 30 second as t from events where event_id % 97 = 0)"""


@query("interrupted_by_sleep", f"with {SLEEP_SQL} select event_id from r where exists (select 1 from e where e.t >= a and e.t <= b)")
def interrupted_by_sleep(spark, sf):
    rows = fx.table(spark, sf, "events")
    runs = rows.where("event_id % 5 = 0").select("event_id", L("interrupted").alias("status"), C("ts").alias("started_at"), F.expr("ts + make_interval(0, 0, 0, 0, 0, cast(event_id % 90 as int), 0)").alias("ended_at"))
    sleeps = rows.where("event_id % 97 = 0").select((C("ts") + F.expr("interval 30 seconds")).alias("at"))
    return ledger.interrupted_by(runs, sleeps).select("event_id")


@query("stalled_crawls", "with l as (select user_id % 50 as k, max(ts) as t from events group by 1), n as (select max(ts) as n from events) select k, t < n - interval 10 minute as stalled from l, n")
def stalled_crawls(spark, sf):
    rows = fx.table(spark, sf, "events").select((C("user_id") % 50).alias("k"), "ts")
    now = rows.agg(F.max("ts").alias("t")).first().t
    return ledger.stalled(rows, "k", "ts", L(now)).select("k", "stalled")


CRAWL_SQL = "a as (select event_type as source, cast(user_id % 5 + 1 as int) as attempt, count(*) as n, cast(user_id % 5 = 3 as int) as exit_code, user_id % 5 = 4 and event_type = 'click' as outage from events group by all)"


@query("crawl_verdicts", f"""with {CRAWL_SQL}, g as (select *, n - coalesce(lag(n) over (partition by source order by attempt), 0) as gain, case when source = 'view' then 10 end as expected from a),
    d as (select *, exit_code = 0 and not outage as well, coalesce(n >= expected, false) as enough, attempt >= 2 and gain < greatest(20, floor(greatest(n, 1) * 0.02e0)) as settled from g)
    select source, attempt, n, gain, well and (enough or settled) as done, case when well and enough then 'enough' when well and settled then 'converged' when outage then 'outage' when not enough then 'volume' else 'exit code' end as reason from d""")
def crawl_verdicts(spark, sf):
    attempt = (C("user_id") % 5 + 1).cast("int")
    rows = fx.table(spark, sf, "events").groupBy(C("event_type").alias("source"), attempt.alias("attempt")).agg(F.count("*").alias("n"))
    rows = rows.withColumns({"exit_code": (C("attempt") == 4).cast("int"), "outage": (C("attempt") == 5) & (C("source") == "click")})
    return ledger.converged_runs(rows, spark.createDataFrame([("view", 10)], "source string, expected long"))


@query("backup_state", """with n as (select count(*) as n from part) select 'nation' as missing, 0.5 as ratio, 9.0 as age_days, 'missing tables: nation|archive short of the live rows|backup too old' as reasons, true as catch_up from n""")
def backup_state(spark, sf):
    n = fx.table(spark, sf, "part").count()
    expected = spark.createDataFrame([("listings",), ("nation",)], "name string")
    archive = spark.createDataFrame([("listings", n)], "name string, n long")
    live = fx.table(spark, sf, "part").agg((F.count("*") * 2).alias("n"))
    runs = spark.createDataFrame([("ok", "2001-11-22"), ("failed", "2001-11-30"), ("ok", "2001-01-01")], "status string, day string").select("status", C("day").cast("timestamp").alias("started_at"))
    out = ledger.backup_state(expected, archive, live, runs, F.expr(fx.AS_OF))
    return out.select(F.array_join("missing", ",").alias("missing"), "ratio", "age_days", F.array_join("reasons", "|").alias("reasons"), "catch_up")


@query("tickets", """with t as (select event_id, event_type, strftime(date_trunc('hour', ts), '%Y-%m-%dT%H%M%S') || '-a-' || event_type as stem, row_number() over (partition by date_trunc('hour', ts), event_type order by event_id) as n from events),
    k as (select event_id, stem || case when n > 1 then '-' || n else '' end || '.json' as ticket from t) select event_id, ticket from k where event_id % 3 > 0""")
def tickets(spark, sf):
    """Escalations get names of their own, however many fall into a second; those resolved leave the queue."""
    rows = fx.table(spark, sf, "events").select(C("event_id").alias("id"), L("a").alias("agent"), C("event_type").alias("kind"), F.date_trunc("hour", "ts").alias("created_at"))
    opened = ledger.tickets(rows)
    return ledger.queue(opened, opened.where("id % 3 = 0").select("ticket")).select(C("id").alias("event_id"), "ticket")


@query("site_scores", """select p_partkey as k, case p_partkey % 4 when 0 then '__NEXT_DATA__' when 1 then 'ld+json' when 2 then '__NUXT__' end as blob, p_partkey % 30 as links,
    p_partkey % 4 < 3 and p_partkey % 30 >= 20 and p_partkey % 5 > 0 and p_partkey % 7 > 0 as promising, case when p_partkey % 2 = 0 then 'seen' end as note from part""")
def site_scores(spark, sf):
    k = C("k")
    links = F.array_join(F.transform(F.sequence(L(0), k % 30), lambda i: F.when(i > 0, F.concat(L('<a href="/condo/'), i, L('">x</a><a href="/condo/'), i, L('">y</a>'))).otherwise('<a href="/about">')), "")
    blob = F.when(k % 4 == 0, '<script id="__NEXT_DATA__">').when(k % 4 == 1, '<script type="application/ld+json">').when(k % 4 == 2, "window.__NUXT__=1").otherwise("")
    rows = fx.table(spark, sf, "part").select(C("p_partkey").alias("k"))
    probes = rows.select(k.cast("string").alias("name"), F.when(k % 5 > 0, 200).otherwise(403).alias("http"), (k % 7 > 0).alias("permissive"), F.concat(blob, links).alias("html"))
    before = rows.where("k % 2 = 0").select(k.cast("string").alias("name"), L("seen").alias("note"))
    return ledger.source_scores(probes, before).select(C("name").cast("long").alias("k"), "blob", "links", "promising", "note")


@query("typed_transfer", "select event_id, case when event_id % 3 > 0 then cast(props ->> 'k' as int) end as k, event_id % 2 = 1 as repost, case event_id % 3 when 1 then 2 end as photos from events")
def typed_transfer(spark, sf):
    i = C("event_id")
    rows = fx.table(spark, sf, "events").select("event_id", F.when(i % 3 > 0, C("props")).otherwise("{bad").alias("raw_data"), (i % 2).alias("is_auto_repost"), F.when(i % 3 == 0, "[1").when(i % 3 == 1, "[10, 20]").alias("photo_sizes"))
    out = ledger.transferred(rows)
    return out.select("event_id", F.try_variant_get("raw_data", "$.k", "int").alias("k"), C("is_auto_repost").alias("repost"), F.size("photo_sizes").alias("photos")).withColumn("photos", F.when(C("photos") >= 0, C("photos")))


@query("province_stubs", "select min(p_partkey) as place, 'https://s.example/' || p_size as url from part where p_partkey % 3 > 0 group by p_size")
def province_stubs(spark, sf):
    k = C("p_partkey")
    rows = fx.table(spark, sf, "part").select(k.alias("place"), F.concat(L("https://s.example/"), C("p_size"), L("?p="), k).alias("url"), F.when(k % 3 > 0, "Sub, Khet, BANGKOK").otherwise("Bangkok Road, Phuket").alias("full_address"))
    return ledger.without_province(rows).select("place", "url")


@query("stubs_to_visit", "select p_partkey as id, p_partkey % 2 = 0 and p_partkey % 3 > 0 and p_partkey % 5 > 0 as known from part")
def stubs_to_visit(spark, sf):
    """Stubs that are known at the same price and with an image are not visited again."""
    k, price = C("p_partkey"), C("p_retailprice")
    rows = fx.table(spark, sf, "part")
    stubs = rows.select(k.alias("id"), price.alias("price"))
    state = rows.where(k % 2 == 0).select(k.alias("id"), F.when(k % 3 > 0, price).otherwise(price + 1).alias("price"))
    images = rows.where(k % 5 > 0).select(k.alias("listing_id")).union(rows.where(k % 5 > 0).select(k))
    return ledger.to_visit(stubs, state, images).select("id", "known")


@query("images_to_prune", "select l_orderkey, l_linenumber, count(*) as n from lineitem where l_linenumber - 1 >= 1 group by 1, 2")
def images_to_prune(spark, sf):
    rows = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (C("l_linenumber") - 1).alias("ord"))
    return ledger.secondary_images(rows).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query("polluted_descriptions", "select doc_id, text like '%{%:%;%' or text like '%function(%' or lower(text) like '%most popular property website%' as polluted from (select doc_id, coalesce(case when doc_id % 9 = 0 then 'x {a: b;} ' || text when doc_id % 9 = 1 then text || ' The Most popular property website' else text end, '') as text from documents)")
def polluted_descriptions(spark, sf):
    text = F.when(C("doc_id") % 9 == 0, F.concat(L("x {a: b;} "), C("text"))).when(C("doc_id") % 9 == 1, F.concat(C("text"), L(" The Most popular property website"))).otherwise(C("text"))
    return fx.table(spark, sf, "documents").select("doc_id", ledger.polluted(text).alias("polluted"))


@query("host_verdicts", """with r as (select event_type as source, cast(user_id % 4 as int) as run, avg(case when event_type = 'click' or event_id % 10 > 0 or (event_type = 'view' and user_id % 4 = 0) then case when event_type = 'error' and user_id % 4 = 2 then 0.0 else 1.0 end else 0.0 end) as share from events group by 1, 2)
    select source, case when min(share) filter (run > 0) >= 0.9 then 'syndicated' else 'own' end as verdict from r group by 1""")
def host_verdicts(spark, sf):
    i, run = C("event_id"), (C("user_id") % 4).cast("int")
    hit = (C("event_type") == "click") | (i % 10 > 0) | ((C("event_type") == "view") & (run == 0))
    host = F.when(hit & ~((C("event_type") == "error") & (run == 2)), "img.fw.example").otherwise("other.example")
    rows = fx.table(spark, sf, "events").select(C("event_type").alias("source"), run.alias("run"), F.array(F.concat(L("https://"), host, L("/a.jpg"))).alias("image_urls"))
    return ledger.host_verdict(rows, ["img.fw.example"]).select("source", "verdict")


@query("field_coverage", f"""with {LISTINGS_SQL} select source, 'quota' as field, floor(count(quota) / count(*) * 1000 + 0.5) / 10 as pct from listings group by 1
    union all select source, 'pets', 50.0 from (select source, count(*) filter (l_partkey % 2 = 0) as a, count(*) as n from listings group by 1) where false
    union all select source, 'floor', floor(count(*) filter (l_partkey % 2 = 0) / count(*) * 1000 + 0.5) / 10 from listings group by 1""")
def field_coverage(spark, sf):
    """How often the fields of descriptions are known, by source, after they were read anew."""
    from ..functions import details as d

    rows = fx.listings(spark, sf)
    label = F.when(C("quota") == "thai", " Thai Quota Furniture").when(C("quota") == "foreigner", " Foreign Quota Furniture").otherwise("")
    text = F.concat(F.when(C("l_partkey") % 2 == 0, F.concat((C("l_linenumber") + 3).cast("string"), L("th Floor"))).otherwise("Floor N/A"), label)
    rows = d.with_text(rows.select("source", "area_sqm", text.alias("description")), "description")
    found = d.details(C(d.TEXT), C("area_sqm"), 2001)
    return q.coverage(rows.select("source", found["quota"].alias("quota"), found["floor"].alias("floor")), "source", ["quota", "floor"])


THEIRS = "case when id % 5 = 0 then 'inactive' else 'active' end"


@query("stores_compared", """with a as (select p_partkey as id, cast(p_retailprice as double) as price, p_name as condo_name, p_size * 1.0 as area_sqm, p_brand as street from part where p_partkey % 4 > 0),
    b as (select p_partkey as id, case when p_partkey % 5 = 0 then 'inactive' else 'active' end as status, p_retailprice + case p_partkey % 3 when 0 then 5 when 1 then -5 else 0 end as price, case when p_partkey % 7 = 0 then 'x' else p_name end as condo_name,
        p_size + case when p_partkey % 11 = 0 then 0.4 when p_partkey % 11 = 1 then 0.6 else 0 end as area_sqm, case when p_partkey % 2 = 0 then '' else 'z' end as street from part where p_partkey % 6 > 0),
    j as (select coalesce(a.id, b.id) as id, case when b.id is null then 'new' when a.id is null and status = 'active' then 'absent' when a.id is not null and status = 'active' then 'both' when a.id is not null then 'reappeared' end as state,
        a.price as ap, b.price as bp, a.condo_name as an, b.condo_name as bn, a.area_sqm as aa, b.area_sqm as ba, b.street as bs from a full join b on a.id = b.id)
    select id, state, concat_ws(',', case when state = 'both' and an <> bn then 'condo_name' end, case when state = 'both' and abs(aa - ba) > 0.5 then 'area_sqm' end) as diverging,
        case when state = 'both' and bs = '' then 'street' else '' end as gained, case when state = 'both' and abs(ap - bp) > 1 then case when ap < bp then 'down' else 'up' end end as price_move from j where state is not null""")
def stores_compared(spark, sf):
    k, size = C("p_partkey"), C("p_size").cast("double")
    rows = fx.table(spark, sf, "part")
    ours = rows.where(k % 4 > 0).select(k.alias("id"), C("p_retailprice").cast("double").alias("price"), C("p_name").alias("condo_name"), size.alias("area_sqm"), C("p_brand").alias("street"))
    theirs = rows.where(k % 6 > 0).select(
        k.alias("id"), F.when(k % 5 == 0, "inactive").otherwise("active").alias("status"), (C("p_retailprice") + F.when(k % 3 == 0, 5).when(k % 3 == 1, -5).otherwise(0)).alias("price"),
        F.when(k % 7 == 0, "x").otherwise(C("p_name")).alias("condo_name"), (size + F.when(k % 11 == 0, 0.4).when(k % 11 == 1, 0.6).otherwise(0.0)).alias("area_sqm"), F.when(k % 2 == 0, "").otherwise("z").alias("street"),
    )
    return ledger.compared(ours, theirs, ["condo_name", "area_sqm"], ["street"])


@query("geocode_fill", f"""with {LISTINGS_SQL}, r as (select id, {N1} as b, khet, street, lat, lng from listings where status = 'active' and condo_name is not null and (street is null or lat is null)), p as (select b, coalesce(khet, '') as k from r group by 1, 2)
    select id, coalesce(nullif(street, ''), 'S ' || r.b) as street, lat, coalesce(nullif(khet, ''), 'found') as khet from r join p on p.b = r.b and p.k = coalesce(khet, '') where length(r.b) % 2 = 0""")
def geocode_fill(spark, sf):
    """Streets and districts filled from one lookup for each building and district, of which half are found."""
    from ..functions.text import building_name

    rows = fx.listings(spark, sf)
    places = rows.where("status = 'active' and condo_name is not null").select(building_name(C("condo_name")).alias("building"), "khet").distinct().where("length(building) % 2 = 0")
    places = places.withColumns({"street": F.concat(L("S "), C("building")), "lat": L(13.7), "lng": L(100.5)})
    located = places.select("lat", "lng").distinct().withColumn("district", L("found"))
    return ledger.geocoded(rows, places, located).select("id", "street", "lat", "khet")


@query("batch_verdict", f"""with {LISTINGS_SQL}, s as (select source, floor(count(area_sqm) / count(*) * 1e4 + 0.5) / 100 as area, floor(count(khet) / count(*) * 1e4 + 0.5) / 100 as khet, floor(count(quota) / count(*) * 1e4 + 0.5) / 100 as quota,
        floor(count(*) filter ({SANE}) / count(*) * 1e4 + 0.5) / 100 as sane, count(*) - count(distinct id) as hits, floor(avg(length(condo_name)) * 100 + 0.5) / 100 as mean_length, count(*) as n from listings group by 1)
    select source, concat_ws(',', case when n < 80 then 'volume' end, case when area < 90 then 'area_sqm' end, case when khet < 95 then 'khet' end, case when sane < 90 then 'plausible' end, case when hits > 0 then 'collisions' end) as failures,
        case when quota < 70 then 'quota' else '' end as warnings, mean_length from s""")
def batch_verdict(spark, sf):
    return q.batch_verdict(fx.listings(spark, sf), 100, {"area_sqm": (90, True), "khet": (95, True), "quota": (70, False)}, F.expr(SANE), "condo_name").select("source", "failures", "warnings", "mean_length")


@query("zero_runs", "with h as (select concat(event_type, '-', cast(user_id % 40 as varchar)) as agent, floor(value / 60) as new, row_number() over (partition by event_type, user_id % 40 order by ts desc, event_id desc) as rn from events) select agent from h where rn <= 2 group by 1 having count(*) = 2 and max(new) = 0")
def zero_runs(spark, sf):
    """Sources whose last two runs found nothing new."""
    rows = fx.table(spark, sf, "events").select("event_id", F.concat("event_type", L("-"), (C("user_id") % 40).cast("string")).alias("agent"), C("ts").alias("started_at"), F.floor(C("value") / 60).alias("new"))
    return q.all_zero(rows)


@query("problem_kinds", "with r as (select event_type as agent, user_id % 7 as kind, ts from events), z as (select max(ts) as t from r) select agent, count(distinct kind) as kinds, count(distinct kind) filter (ts >= t - interval 7 day) as kinds_week, count(*) as n from r, z group by 1")
def problem_kinds(spark, sf):
    rows = fx.table(spark, sf, "events").select(C("event_type").alias("agent"), (C("user_id") % 7).alias("kind"), C("ts").alias("at"))
    return q.problems(rows, L(rows.agg(F.max("at").alias("t")).first().t))


@query("due_agents", """with r as (select event_type as agent, ts, case when event_id % 4 = 1 then 'failed' else 'ok' end as status from events), z as (select max(ts) as t from r)
    select agent, arg_max(status, ts) as status, strftime(max(ts) filter (status = 'ok'), '%Y-%m-%d') as last_ok, date_diff('day', cast(max(ts) filter (status = 'ok') as date), cast(max(t) as date)) >= 1 as due from r, z group by 1""")
def due_agents(spark, sf):
    rows = fx.table(spark, sf, "events").select("event_id", C("event_type").alias("agent"), C("ts").alias("started_at"), F.when(C("event_id") % 4 == 1, "failed").otherwise("ok").alias("status"))
    out = q.due(rows, L(rows.agg(F.max("started_at").alias("t")).first().t), 1)
    return out.select("agent", "status", F.date_format("last_ok", "yyyy-MM-dd").alias("last_ok"), "due")


@query("text_coverage", "select lang, floor(count(text) / count(*) * 1000 + 0.5) / 10 as pct, floor(avg(length(text)) * 100 + 0.5) / 100 as mean_length from documents group by 1")
def text_coverage(spark, sf):
    return q.text_coverage(fx.table(spark, sf, "documents"), "lang", "text")


@query("study_bounds", f"with {LISTINGS_SQL} select count(*) filter (deal_type = 'sale' and coalesce(price, 0) between 800000 and 100000000) as sales, count(*) filter (deal_type = 'rent' and coalesce(price, 0) <= 200000) as rents from listings")
def study_bounds(spark, sf):
    from ..operators import study

    rows = fx.listings(spark, sf)
    sales = study.sale_ok(rows.where("deal_type = 'sale'")).agg(F.count("*").alias("sales"))
    return sales.join(F.broadcast(study.rent_ok(rows.where("deal_type = 'rent'")).agg(F.count("*").alias("rents"))))


@query("compact_amounts", "select p_partkey, case when p_partkey % 3 = 0 then '—' when p_partkey >= 100 then replace(printf('%.2f', p_partkey * 12345 / 1e6), '.', ',') || ' M' else replace(format('{:,d}', p_partkey * 1000), ',', ' ') end as text from part where p_partkey >= 100 or p_partkey < 81")
def compact_amounts(spark, sf):
    from ..functions.text import amount_text

    k = C("p_partkey")
    rows = fx.table(spark, sf, "part").where("p_partkey >= 100 or p_partkey < 81")
    return rows.select("p_partkey", amount_text(F.when(k % 3 == 0, None).when(k >= 100, k * 12345).otherwise(k * 1000).cast("double")).alias("text"))


