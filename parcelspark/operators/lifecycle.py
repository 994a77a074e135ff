"""The life of listings over scans: upsert, absence with grace, sold persistence, change logs, as batch steps.

Each step is a function of the state and a scan to the next state, so it can be run for each scan, in foreachBatch, or
(see streaming.lifecycle) over a stream of sightings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import stage

GRACE, SOLD_DAYS, GUARD = 2, 7, 0.5
SOLD = "sold"  # the one marker that means a sale
STATE = "id string, scope string, price double, status string, first_seen timestamp, last_seen timestamp, missed int, first_missed timestamp, delisted_at timestamp, marker string, marker_since timestamp"


def apply_scan(state: DataFrame, scan: DataFrame, at: Column, full: bool = True) -> tuple[DataFrame, DataFrame]:
    """(state, price events) after a scan of (id, scope, price, marker) at a time.

    Seen listings become active and their absences are forgotten; a price is an event when its listing is new or it differs from the known one. In a
    full scan, active listings marked SOLD for a week are sold since the mark, seen or not and whatever their scope, once
    any scanned scope is trusted; then those of the trusted scopes that are absent miss it: the second time in a row they
    are inactive since the first. A scope in which the scan saw under half as many listings as are active is not trusted,
    and none of its listings miss the scan. A partial scan only adds.
    """
    s = scan.select("id", F.col("scope").alias("n_scope"), F.col("price").alias("n_price"), F.col("marker").alias("n_marker"), F.lit(True).alias("seen"))
    both = state.join(s, "id", "full_outer").withColumn("seen", F.coalesce("seen", F.lit(False)))
    after = settled(both, scope_counts(both), at, full)
    return after.drop("news"), after.where("news is not null").select("id", F.col("news").alias("price"), at.alias("seen_at"))


def scope_counts(both: DataFrame) -> DataFrame:
    """How many listings of a scope are active or seen, and how many are seen, from rows of a state and what a scan saw."""
    return both.groupBy(F.coalesce("n_scope", "scope").alias("scope")).agg(
        F.count(F.when((F.col("status") == "active") | F.col("seen"), 1)).alias("__active"), F.count(F.when(F.col("seen"), 1)).alias("__seen")
    )


def settled(both: DataFrame, counts: DataFrame, at: Column, full: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """The state after a scan, from rows of the state before and what the scan saw (n_scope, n_price, n_marker, seen) with
    their scope_counts(); `news` is the price if it is an event. Columns to `keep` stay as they are."""
    both = both.withColumn("scope", F.coalesce("n_scope", "scope")).join(F.broadcast(counts), "scope", "left")  # scopes are few: the rows stay where they are
    # Seen listings are active by now, so they count on both sides.
    trusted = F.lit(full) & (F.col("__seen") > 0) & (F.col("__seen") >= GUARD * F.col("__active"))
    marker = F.when(F.col("seen"), F.col("n_marker")).otherwise(F.col("marker"))
    marker_new = F.col("seen") & ~F.col("n_marker").eqNullSafe(F.col("marker"))
    marked = F.when(marker_new, F.when(F.col("n_marker").isNotNull(), at)).otherwise(F.col("marker_since"))
    active = F.col("seen") | (F.col("status") == "active")
    sure = F.lit(full) & F.coalesce(counts.select(F.max((F.col("__seen") > 0) & (F.col("__seen") >= GUARD * F.col("__active")))).scalar(), F.lit(False))
    sold = F.coalesce(sure & active & (marker == SOLD) & (marked <= at - F.expr(f"interval {SOLD_DAYS} days")), F.lit(False))
    misses = ~F.col("seen") & trusted & (F.col("status") == "active") & ~sold
    missed = F.when(F.col("seen"), 0).otherwise(F.coalesce("missed", F.lit(0)) + misses.cast("int"))
    out = F.when(missed >= GRACE, True).otherwise(False) & misses
    since = F.when(F.col("seen"), None).when(misses & F.col("first_missed").isNull(), at).otherwise(F.col("first_missed"))
    # A price is news for a new listing, or when it differs from a known one.
    news = F.col("seen") & F.col("n_price").isNotNull() & (F.col("first_seen").isNull() | (F.col("n_price") != F.col("price")))
    return both.select(
        *keep, "id", "scope", F.coalesce("n_price", "price").alias("price"),
        F.when(sold, "sold").when(F.col("seen"), "active").when(out, "inactive").otherwise(F.col("status")).alias("status"),
        F.coalesce("first_seen", F.when(F.col("seen") | F.col("status").isNotNull(), at)).alias("first_seen"), F.when(F.col("seen"), at).otherwise(F.col("last_seen")).alias("last_seen"),
        missed.cast("int").alias("missed"), since.alias("first_missed"),
        F.when(sold, marked).when(F.col("seen"), None).when(out, since).otherwise(F.col("delisted_at")).alias("delisted_at"),
        marker.alias("marker"), marked.alias("marker_since"), F.when(news, F.col("n_price")).alias("news"),
    )


def apply_scans(rows: DataFrame, scans: list[tuple[Column, Column, Column, Column]]) -> tuple[DataFrame, DataFrame]:
    """(state, price events) after full scans, one after the other as by apply_scan(), of listings with a row each.

    rows: id, scope and whatever the scans are told by; scans: (at, seen, price, marker) as expressions of a row. What a
    listing becomes depends on its own row and on the counts of the scopes: rows are read once for each scan to be
    counted and once for what comes out, and none moves.
    """
    scope = F.col("scope")
    saw = [F.when(seen, F.struct(scope, price.alias("price"), marker.alias("marker"))).alias(f"__saw{i}") for i, (_, seen, price, marker) in enumerate(scans)]
    state = rows.select("id", *saw, *[F.lit(None).cast(k).alias(c) for c, k in (x.split() for x in STATE.split(", ")[1:])])
    keep = [f"__saw{i}" for i in range(len(scans))]
    for i, (at, *_) in enumerate(scans):
        saw = F.col(f"__saw{i}")
        both = state.withColumns({"seen": saw.isNotNull(), "n_scope": saw.scope, "n_price": saw.price, "n_marker": saw.marker})
        state = settled(both, stage(scope_counts(both)), at, keep=tuple(keep)).withColumnRenamed("news", f"__news{i}")
        keep.append(f"__news{i}")
    news = F.array(*[F.when(F.col(f"__news{i}").isNotNull(), F.struct(F.col(f"__news{i}").alias("price"), at.alias("seen_at"))) for i, (at, *_) in enumerate(scans)])
    events = state.select("id", F.explode(F.array_compact(news)).alias("e")).select("id", "e.price", "e.seen_at")
    return state.where("status is not null").drop(*keep), events


def from_sightings(seen: DataFrame, scans: DataFrame) -> DataFrame:
    """(id, scope, status, missed, delisted_at) after all scans, from sightings (id, scope, scan) and scans (scope, scan,
    at), numbered from 1 within a scope: inactive are those that missed the last two or more, since the first of them."""
    last = seen.groupBy("id", "scope").agg(F.max("scan").alias("last"))
    top = scans.groupBy("scope").agg(F.max("scan").alias("top"))
    out = last.join(top, "scope").withColumn("missed", F.col("top") - F.col("last"))
    at = scans.select("scope", (F.col("scan") - 1).alias("last"), F.col("at").alias("next_at"))
    out = out.join(at, ["scope", "last"], "left")
    gone = F.col("missed") >= GRACE
    return out.select("id", "scope", F.when(gone, "inactive").otherwise("active").alias("status"), "missed", F.when(gone, F.col("next_at")).alias("delisted_at"))


def changes(rows: DataFrame, key: str, at: str, value: str, tie: str) -> DataFrame:
    """Rows in which a key's value differs from the one before (the first included), in the order of time."""
    w = W.partitionBy(key).orderBy(at, tie)
    out = rows.withColumn("__before", F.lag(value).over(w)).withColumn("__n", F.row_number().over(w))
    return out.where((F.col("__n") == 1) | ~F.col(value).eqNullSafe(F.col("__before"))).drop("__before", "__n")


def unfinished(runs: DataFrame, as_of: Column, hours: int = 12) -> DataFrame:
    """Runs still running after `hours` become interrupted."""
    old = (F.col("status") == "running") & (F.col("started_at") < as_of - F.expr(f"interval {hours} hours"))
    return runs.withColumn("status", F.when(old, "interrupted").otherwise(F.col("status")))


def pending(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed job still has to do."""
    return items.join(done, key, "left_anti")
