"""Building dimension, votes, coverage, batch judgement, reconciliation, and the operations ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import half_up
from ..functions.text import cohort_name


def buildings(listings: DataFrame) -> DataFrame:
    """One row per building name: district last seen, mean place, listings of each deal."""
    rows = listings.where("condo_name is not null")
    of = lambda d: F.count(F.when(F.col("deal_type") == d, 1))
    last = F.when(F.col("khet").isNotNull(), F.struct("first_seen", "id"))
    return rows.groupBy("condo_name").agg(
        F.max_by("khet", last).alias("khet"), half_up(F.avg("lat"), 4).alias("lat"), half_up(F.avg("lng"), 4).alias("lng"), of("sale").alias("n_sale"), of("rent").alias("n_rent")
    )


def merge_buildings(old: DataFrame, new: DataFrame) -> DataFrame:
    """The dimension after an upsert: new values where they are known, old ones elsewhere; counts from the new."""
    o = old.select([F.col(c).alias(f"o_{c}") for c in old.columns])
    both = new.join(o, new.condo_name == o.o_condo_name, "full_outer")
    return both.select(*[F.coalesce(F.col(c), F.col(f"o_{c}")).alias(c) for c in new.columns])


def year_votes(votes: DataFrame) -> DataFrame:
    """(building, year, verdict): what the sources' years of a building settle. votes: (condo_name, source, year).

    A vote is a source. One value is taken, the more sources the surer; of several, one that three sources give and
    that leads alone; else it is a conflict and the year null.
    """
    rows = votes.where("condo_name is not null and year is not null").withColumn("building", cohort_name(F.col("condo_name")))
    per = rows.groupBy("building", "year").agg(F.count_distinct("source").alias("n"))
    total = rows.groupBy("building").agg(F.count_distinct("source").alias("sources"))
    w = W.partitionBy("building")
    ranked = per.join(total, "building").withColumns({
        "kinds": F.count("*").over(w), "rank": F.row_number().over(w.orderBy(F.desc("n"), "year")), "ties": F.count("*").over(W.partitionBy("building", "n")),
    }).where("rank = 1")
    n, s, k = F.col("n").cast("string"), F.col("sources").cast("string"), F.col("kinds").cast("string")
    verdict = (
        F.when((F.col("kinds") == 1) & (F.col("sources") >= 3), F.concat(F.lit("valid "), s, F.lit(" sources")))
        .when((F.col("kinds") == 1) & (F.col("sources") == 2), "corroborated 2 sources")
        .when(F.col("kinds") == 1, "single source")
        .when((F.col("n") >= 3) & (F.col("ties") == 1), F.concat(F.lit("valid "), n, F.lit("/"), s, F.lit(" sources")))
        .otherwise(F.concat(F.lit("conflict "), k, F.lit(" values / "), s, F.lit(" sources")))
    )
    out = ranked.withColumn("verdict", verdict)
    return out.select("building", F.when(~F.col("verdict").startswith("conflict"), F.col("year")).alias("year"), "verdict")


AGENT_KEYS = ("agent_id", "condo_name", "deal_type", "bedrooms", "area_sqm", "price")


def agent_duplicates(listings: DataFrame, keys: tuple[str, ...] = AGENT_KEYS, seen: str = "first_seen") -> DataFrame:
    """Groups of active listings of one agent and building that agree in all keys, unknown values alike: ids in the
    order of first sight, and the first sight."""
    rows = listings.where("status = 'active' and agent_id is not null and condo_name is not null")
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(F.col(seen).alias("at"), "id"))).alias("s")).where("n > 1")
    return out.select(*keys, "n", F.transform("s", lambda x: x.id).alias("ids"), F.col("s")[0].at.alias("oldest"))


def coverage(rows: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """(group, field, pct): the share of rows in which a field is known, in percent."""
    wide = rows.groupBy(group).agg(*[half_up(F.count(f) / F.count("*") * 100, 1).alias(f) for f in fields])
    return wide.select(group, F.expr("stack({}, {}) as (field, pct)".format(len(fields), ", ".join(f"'{f}', {f}" for f in fields))))


def bedroom_pivot(listings: DataFrame, top: int) -> DataFrame:
    """Counts by bedrooms of the `top` districts."""
    rows = listings.where("khet is not null")
    of = lambda name, cond: F.count(F.when(cond, 1)).alias(name)
    b = F.col("bedrooms")
    out = rows.groupBy("khet").agg(F.count("*").alias("n"), of("studio", b == 0), of("one", b == 1), of("two", b == 2), of("three_up", b >= 3), of("unknown", b.isNull()))
    return out.orderBy(F.desc("n"), "khet").limit(top)


def price_bands(listings: DataFrame, edges: list[float]) -> DataFrame:
    """(deal_type, band, n): counts in [edge, next edge) by the number of edges that the price reaches."""
    band = sum((F.when(F.col("price") >= e, 1).otherwise(0) for e in edges), F.lit(0))
    return listings.groupBy("deal_type", band.alias("band")).agg(F.count("*").alias("n"))


def judge(listings: DataFrame, thresholds: dict[str, float], sane: Column) -> DataFrame:
    """(source, check, value, passed): completeness of fields against thresholds, plausibility and colliding ids."""
    checks = {f: half_up(F.count(f) / F.count("*") * 100, 2) for f in thresholds}
    checks |= {"plausible": half_up(F.count(F.when(sane, 1)) / F.count("*") * 100, 2), "collisions": (F.count("*") - F.count_distinct("id")).cast("double")}
    wide = listings.groupBy("source").agg(*[v.alias(k) for k, v in checks.items()])
    rows = wide.select("source", F.expr("stack({}, {}) as (check, value)".format(len(checks), ", ".join(f"'{k}', {k}" for k in checks))))
    limit = F.create_map(*[x for k, v in thresholds.items() for x in (F.lit(k), F.lit(v))])
    passed = F.when(F.col("check") == "collisions", F.col("value") == 0).when(F.col("check") == "plausible", F.col("value") >= 80).otherwise(F.col("value") >= F.try_element_at(limit, F.col("check")))
    return rows.withColumn("passed", passed)


# Shares, in percent, of the volume asked for and of plausible rows that a batch wants.
LEAST_VOLUME, LEAST_PLAUSIBLE = 80, 90


def batch_verdict(listings: DataFrame, wanted: int, thresholds: dict[str, tuple[float, bool]], sane: Column, text: str) -> DataFrame:
    """(source, failures, warnings, mean_length, passed) of a batch of which `wanted` rows were asked for.

    thresholds: field -> (least percent known, whether it blocks). Too few rows, too few plausible ones and repeated ids
    block as well. mean_length is that of a text.
    """
    pct = lambda c: half_up(F.count(c) / F.count("*") * 100, 2)
    known = {f: pct(F.col(f)).alias(f"__{f}") for f in thresholds}
    wide = listings.groupBy("source").agg(
        F.count("*").alias("n"), pct(F.when(sane, 1)).alias("__sane"), (F.count("*") - F.count_distinct("id")).alias("__hits"), half_up(F.avg(F.length(text)), 2).alias("mean_length"), *known.values()
    )
    low = {f: F.when(F.col(f"__{f}") < least, F.lit(f)) for f, (least, _) in thresholds.items()}
    of = lambda blocks: [low[f] for f, (_, b) in thresholds.items() if b == blocks]
    failures = [F.when(F.col("n") * 100 < LEAST_VOLUME * wanted, "volume"), *of(True), F.when(F.col("__sane") < LEAST_PLAUSIBLE, "plausible"), F.when(F.col("__hits") > 0, "collisions")]
    out = wide.select("source", F.concat_ws(",", *failures).alias("failures"), F.concat_ws(",", *of(False), F.lit(None).cast("string")).alias("warnings"), "mean_length")
    return out.withColumn("passed", F.col("failures") == "")


def reconcile(ours: DataFrame, theirs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, state, changed): rows of both sides, of one alone, and the fields in which those of both differ."""
    b = theirs.select([F.col(c).alias(f"t_{c}") for c in (key, *fields)])
    both = ours.select(key, *fields).join(b, F.col(key) == F.col(f"t_{key}"), "full_outer")
    state = F.when(F.col(f"t_{key}").isNull(), "new").when(F.col(key).isNull(), "absent").otherwise("both")
    diff = F.array_compact(F.array(*[F.when((state == "both") & ~F.col(f).eqNullSafe(F.col(f"t_{f}")), F.lit(f)) for f in fields]))
    return both.select(F.coalesce(key, f"t_{key}").alias(key), state.alias("state"), F.array_join(diff, ",").alias("changed"))


def orphans(events: DataFrame, spans: DataFrame, key: str, at: str) -> DataFrame:
    """Events that lie in no span (start to end and ten minutes) of their key. They meet the spans of their own day."""
    s = spans.select(F.col(key).alias("__k"), F.col("start").alias("__a"), (F.col("end") + F.expr("interval 10 minutes")).alias("__b"))
    s = s.withColumn("__day", F.explode(F.sequence(F.to_date("__a"), F.to_date("__b"))))
    same = (F.col(key) == F.col("__k")) & (F.to_date(F.col(at)) == F.col("__day"))
    return events.join(s, same & (F.col(at) >= F.col("__a")) & (F.col(at) <= F.col("__b")), "left_anti")


def silent(due: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return due.join(seen, key, "left_anti")


def last_runs(runs: DataFrame, n: int = 1) -> DataFrame:
    """The last n runs of each agent, newest first."""
    w = W.partitionBy("agent").orderBy(F.desc("started_at"), F.desc("event_id"))
    return runs.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


LOST_IMAGES, DRIFT, LEAST_RUNS = 10, 0.25, 3


def health(runs: DataFrame, bands: DataFrame | None = None, depth: int = 10) -> DataFrame:
    """(agent, new, usual, class): the last good run of each agent against the median of its last `depth` runs.

    runs: (agent, started_at, event_id, status, new, errors, image_errors); bands: (agent, most). The median wants three
    runs with a number. Classes, the first that holds: missing_metrics, broken_parser (nothing new, no errors),
    network_failure (nothing new, errors), drift (under a quarter of the median), unusual_volume (over the band),
    lost_images, ok.
    """
    w = W.partitionBy("agent").orderBy(F.desc("started_at"), F.desc("event_id"))
    recent = runs.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= depth).groupBy("agent").agg(
        F.when(F.count("new") >= LEAST_RUNS, F.percentile("new", F.lit(0.5))).alias("usual"))
    last = runs.where("status = 'ok'").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("agent", "new", "errors", "image_errors")
    out = last.join(recent, "agent")
    out = out.join(bands, "agent", "left") if bands is not None else out.withColumn("most", F.lit(None).cast("double"))
    new, errors = F.col("new"), F.coalesce("errors", F.lit(0))
    kind = (
        F.when(new.isNull(), "missing_metrics").when((new == 0) & (errors == 0), "broken_parser").when(new == 0, "network_failure")
        .when((F.col("usual") > 0) & (new < DRIFT * F.col("usual")), "drift").when(new > F.col("most"), "unusual_volume")
        .when(F.coalesce("image_errors", F.lit(0)) >= LOST_IMAGES, "lost_images").otherwise("ok")
    )
    return out.select("agent", "new", "usual", kind.alias("class"))


def all_zero(runs: DataFrame, n: int = 2) -> DataFrame:
    """Agents whose last n runs all found nothing new. runs: (agent, started_at, event_id, new)."""
    rows = last_runs(runs, n).groupBy("agent").agg(F.count("*").alias("n"), F.max("new").alias("most"))
    return rows.where((F.col("n") == n) & (F.col("most") == 0)).select("agent")


def problems(findings: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """(agent, kinds, kinds_week, n): distinct kinds of findings (agent, kind, at), those of the last days, and all findings."""
    recent = F.when(F.col("at") >= as_of - F.expr(f"interval {days} days"), F.col("kind"))
    return findings.groupBy("agent").agg(F.count_distinct("kind").alias("kinds"), F.count_distinct(recent).alias("kinds_week"), F.count("*").alias("n"))


def due(runs: DataFrame, as_of: Column, days: int) -> DataFrame:
    """(agent, status, last_ok, due): the last run's status, the day of the last good one, and whether `days` have passed."""
    last = F.max(F.when(F.col("status") == "ok", F.col("started_at")))
    out = runs.groupBy("agent").agg(F.max_by("status", F.struct("started_at", "event_id")).alias("status"), last.alias("last_ok"))
    return out.withColumn("due", F.coalesce(F.datediff(as_of, "last_ok") >= days, F.lit(True)))


def text_coverage(rows: DataFrame, group: str, field: str) -> DataFrame:
    """(group, pct, mean_length): how often a text is known, in percent, and its mean length."""
    return rows.groupBy(group).agg(half_up(F.count(field) / F.count("*") * 100, 1).alias("pct"), half_up(F.avg(F.length(field)), 2).alias("mean_length"))


def streak(runs: DataFrame, n: int = 2) -> DataFrame:
    """Agents whose last n runs all failed."""
    rows = last_runs(runs, n).groupBy("agent").agg(F.count(F.when(F.col("status") == "failed", 1)).alias("failed"))
    return rows.where(F.col("failed") == n).select("agent")


def gate(runs: DataFrame, needs: DataFrame) -> DataFrame:
    """(agent, open): whether the last run of everything that an agent needs is ok. needs: (agent, needs)."""
    last = last_runs(runs).select(F.col("agent").alias("needs"), (F.col("status") == "ok").alias("ok"))
    return needs.join(last, "needs", "left").groupBy("agent").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("open"))


def stale(rows: DataFrame, group: str, at: str, as_of: Column, days: int) -> DataFrame:
    """(group, age_days, stale): whole days since the group's last row."""
    age = F.datediff(as_of, F.max(at))
    return rows.groupBy(group).agg(age.alias("age_days")).withColumn("stale", F.col("age_days") > days)


def converged(attempts: DataFrame, expected: int) -> DataFrame:
    """(source, attempt, done): enough rows, or from the second attempt on a gain under 20 rows and 2 %."""
    w = W.partitionBy("source").orderBy("attempt")
    gain = F.col("n") - F.lag("n").over(w)
    done = (F.col("n") >= expected) | ((F.col("attempt") >= 2) & (gain < F.greatest(F.lit(20.0), F.col("n") * 0.02)))
    return attempts.select("source", "attempt", "n", F.coalesce(done, F.lit(False)).alias("done"))


def backup_verdict(expected: DataFrame, archive: DataFrame, live: DataFrame, ratio: float = 0.9) -> DataFrame:
    """(name, verdict): missing, short (under `ratio` of the live rows) or ok; an unknown live count passes."""
    out = expected.join(archive.select("name", F.col("n").alias("kept")), "name", "left").join(live.select("name", F.col("n").alias("live")), "name", "left")
    return out.select("name", F.when(F.col("kept").isNull(), "missing").when(F.col("kept") < ratio * F.col("live"), "short").otherwise("ok").alias("verdict"))


def contract(reports: DataFrame, expected: list[str]) -> DataFrame:
    """(key, missing, honoured): expected fields that a report's JSON object lacks."""
    missing = F.array_except(F.array(*[F.lit(x) for x in expected]), F.coalesce(F.json_object_keys("body"), F.array().cast("array<string>")))
    return reports.select("key", F.array_join(missing, ",").alias("missing"), ((F.col("status") == "ok") & (F.size(missing) == 0)).alias("honoured"))


def retained(rows: DataFrame, archived: DataFrame, key: str, at: str, before: Column) -> DataFrame:
    """`rows` without old ones, but only if every old one is archived; otherwise all of them."""
    old = rows.where(F.col(at) < before)
    if old.join(archived, key, "left_anti").head(1):
        return rows
    return rows.where(~F.coalesce(F.col(at) < before, F.lit(False)))


def replicated(old: DataFrame, new: DataFrame, key: str | None) -> DataFrame:
    """A table after replication: new rows in place of old ones of their key, or without a key the set of both."""
    if key is None:
        return old.unionByName(new).distinct()
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def inventory(objects: DataFrame, local: DataFrame, key: str, size: str) -> DataFrame:
    """(kept_locally, n, bytes) of stored objects."""
    kept = local.select(key).distinct().withColumn("__kept", F.lit(True))
    out = objects.join(kept, key, "left").withColumn("kept_locally", F.coalesce("__kept", F.lit(False)))
    return out.groupBy("kept_locally").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))


def snapped_names(names: DataFrame, known: DataFrame, least: int = 6) -> DataFrame:
    """(name, snapped): the longest known building of `least` letters that a name holds as whole words, ties by name.

    A name's word sequences are looked up on equal keys, so no name is compared with every building.
    """
    words = F.split("name", " ")
    n = F.size(words)
    spans = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.array_join(F.slice(words, i, k), " "))))
    parts = names.select("name", F.explode(F.array_distinct(spans)).alias("known"))
    hit = parts.join(known.where(F.length("known") >= least).distinct(), "known")
    best = hit.groupBy("name").agg(F.max_by("known", F.struct(F.length("known"), "known")).alias("snapped"))
    return names.distinct().join(best, "name", "left")
