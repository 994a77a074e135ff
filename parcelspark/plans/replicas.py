"""Replication, editions and stalls by runs that continue one another."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger
from ..sources import fixture as fx
from ..sources import replica
from ..sources.scratch import scratch
from ..streaming import editions, outages
from ..streaming.lifecycle import run_once
from .registry import query
from .timeline import event_stream

# The first run has the orders before 1998; the second all, those from 1997 on with another status.
ORDERS = "select o_orderkey, o_custkey, case when o_orderdate >= timestamp '1997-01-01' then lower(o_orderstatus) else o_orderstatus end as status, strftime(o_orderdate, '%Y-%m-%d') as ordered_on from orders"


def replicated_orders(spark, sf) -> str:
    """The folder of a table after two runs of replication, a repeated one and a purge of what is archived."""
    path = scratch(spark, "replica")
    rows = fx.table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("ordered_on"))
    later = rows.withColumn("status", F.when(F.col("ordered_on") >= "1997", F.lower("status")).otherwise(F.col("status")))
    replica.replicate(rows.where("ordered_on < '1998'"), path, "o_orderkey", "first")
    replica.replicate(later, path, "o_orderkey", "second")
    replica.replicate(later, path, "o_orderkey", "second")
    replica.replicate(later, path, "o_orderkey", "nothing new")
    old = F.col("ordered_on") < "1996"
    replica.purge(spark, path, old, rows.where("ordered_on < '1995-06-01'"), "o_orderkey", "refused")  # the archive lacks some
    replica.purge(spark, path, old, rows.where(old), "o_orderkey", "purge")
    return path


@query("replicated_orders", f"select * from ({ORDERS}) where ordered_on >= '1996'")
def replicated_rows(spark, sf):
    return replica.read(spark, replicated_orders(spark, sf))


@query("replication_journal", """select 1 as version, 'first' as run, count(*) filter (where o_orderdate < timestamp '1998-01-01') as changed from orders
    union all select 2, 'second', count(*) filter (where o_orderdate >= timestamp '1998-01-01' or o_orderdate >= timestamp '1997-01-01' and o_orderstatus <> lower(o_orderstatus)) from orders
    union all select 3, 'purge', count(*) filter (where o_orderdate < timestamp '1996-01-01') from orders""")
def replication_journal(spark, sf):
    """Versions and the rows that each changed; runs that change nothing leave none."""
    return replica.history(spark, replicated_orders(spark, sf)).select("version", "run", "changed")


@query("followed_editions", """select 'edition' as kind, strftime(o_orderdate, '%Y-%m') as date, count(*) as n from orders group by 2
    union all select 'refused', cast(year(o_orderdate) as varchar), 1 from orders group by 2""")
def followed_editions(spark, sf):
    """A month's orders as an edition's file: first those before 1998 with counts short by one, then those from 1997 on as
    they are; a torn file for each year comes with the first. The earlier months' counts are mended by a third call."""
    folder, path = scratch(spark, "edition-files"), scratch(spark, "editions")
    months = fx.table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("date")).agg(F.count("*").alias("n"))
    body = lambda n: F.to_json(F.struct("date", F.struct(n.alias("actives")).alias("totals"))).alias("value")
    put = lambda rows: rows.write.mode("append").partitionBy("part").text(folder)
    put(months.where("date < '1998'").select(body(F.col("n") - 1), F.col("date").alias("part")))
    put(months.select(F.substring("date", 1, 4).alias("part")).distinct().select(F.lit('{"date": "torn').alias("value"), F.concat("part", F.lit("-torn")).alias("part")))
    editions.follow(spark, folder, path)
    put(months.where("date >= '1997'").select(body(F.col("n")), F.col("date").alias("part")))
    editions.follow(spark, folder, path)
    put(months.where("date < '1997'").select(body(F.col("n")), F.col("date").alias("part")))
    editions.follow(spark, folder, path)
    good = editions.followed(spark, path).select(F.lit("edition").alias("kind"), "date", F.col("totals.actives").alias("n"))
    year = F.regexp_extract("file", r"part=(\d{4})-torn", 1)
    return good.union(replica.read(spark, f"{path}/refused").groupBy(year.alias("date")).agg(F.count("*").alias("n")).select(F.lit("refused").alias("kind"), "date", "n"))


GAP = 720
SESSIONS = f"""o as (select user_id, ts, case when ts - lag(ts) over w <= interval '{GAP} minutes' then 0 else 1 end as head from events window w as (partition by user_id order by ts)),
    s as (select user_id, ts, sum(head) over (partition by user_id order by ts rows unbounded preceding) as k from o), g as (select user_id, min(ts) as began, max(ts) as last, count(*) as n from s group by user_id, k)"""


@query("activity_stalls", f"""with {SESSIONS} select user_id, strftime(began, '%Y-%m-%d %H:%M:%S') as began, strftime(last, '%Y-%m-%d %H:%M:%S') as last, n
    from g where last + interval '{GAP} minutes' <= (select date_trunc('millisecond', max(ts)) - interval '1 hour' from events)""")
def activity_stalls(spark, sf):
    """What a stream tells of stalls: the sessions after which a user did nothing for half a day."""
    path = scratch(spark, "stalls")
    rows = event_stream(spark, sf).select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    run_once(outages.sessions(rows, "user_id", "ts", GAP), path)
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return spark.read.parquet(path).select("user_id", text("began"), text("last"), "n")


@query("failure_outages", f"""with clicks as (select * from events where event_type = 'click'), {SESSIONS.replace('from events', 'from clicks')}
    select user_id, strftime(began, '%Y-%m-%d %H:%M:%S') as began, strftime(last, '%Y-%m-%d %H:%M:%S') as last, n from g where n >= {ledger.LEAST_MARKS}""")
def failure_outages(spark, sf):
    """Sessions of one kind of event that hold three of them, over the whole table."""
    rows = fx.table(spark, sf, "events").where("event_type = 'click'").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return outages.outages(rows, "user_id", "ts", GAP).select("user_id", text("began"), text("last"), "n")
