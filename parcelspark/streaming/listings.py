"""The life of listings and of runs as keyed state over a stream, with event-time timers.

Rows are sightings (what a scan saw), closings (a scan of a scope is over; whether it was full, and large enough to be
trusted) and ticks (time has passed). Listings are dealt to buckets by their ids, so no scope is one task's share, and
closings go to every bucket. Rows wait under the time of their scan until the watermark has passed it, which brings
rows that come late and out of order into place; then the scan is applied as operators.lifecycle.apply_scan applies it
to a table. Each change of a listing's state is a row of the output, and the last one is its state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.lifecycle import GRACE, GUARD, SOLD, SOLD_DAYS

DAY = 86_400_000_000  # microseconds
FEED = "kind string, at timestamp, scope string, id string, price double, marker string, full boolean, trusted boolean"
KNOWN = "scope string, price double, status string, first_seen long, last_seen long, missed long, first_missed long, delisted_at long, marker string, marker_since long"
CHANGE = f"at long, event string, id string, {KNOWN}"
STATE = [c.split()[0] for c in KNOWN.split(", ")]
WAITING = ["kind", "id", "scope", "price", "marker", "full", "trusted"]
BUCKET_LISTINGS = 10_000
TIMES = ("first_seen", "last_seen", "first_missed", "delisted_at", "marker_since")
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


TYPES = {c: {"string": pa.string(), "double": pa.float64(), "long": pa.int64(), "boolean": pa.bool_()}[k] for c, k in (x.split() for x in f"{KNOWN}, {FEED}".split(", ") if "timestamp" not in x)}


def frame(rows: list[tuple]) -> pd.DataFrame:
    """Rows of an id and a listing's state, by id."""
    return pd.DataFrame(rows, columns=["id", *STATE]).astype({"price": float} | {c: "Int64" for c in ("missed", *TIMES)}).set_index("id")


def told(df: pd.DataFrame, columns: list[str]) -> list[tuple]:
    """The rows as tuples of Python's values, None for null."""
    return list(zip(*[[None if x is None or x is pd.NA or x != x else x for x in df[c].tolist()] for c in columns], strict=True))


def packed(df: pd.DataFrame, columns: list[str]) -> bytes:
    """Rows as one compressed Arrow stream."""
    table = pa.Table.from_pandas(df[columns], schema=pa.schema([(c, TYPES[c]) for c in columns]), preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pd.DataFrame:
    table = pa.ipc.open_stream(pa.py_buffer(bytes(data))).read_all()
    return table.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)


def differs(x: pd.Series, y: pd.Series) -> pd.Series:
    """Where values differ; two nulls do not."""
    return ~((x == y).fillna(False).astype(bool) | (x.isna() & y.isna()))


class Listings(StatefulProcessor):
    """The listings of a bucket; those that left the market longer than `keep_days` ago are forgotten.

    Rows wait, and a scan is applied, as frames: a bucket is small enough to be held as one.
    """

    def __init__(self, keep_days: int) -> None:
        self.keep = keep_days * DAY

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, rows binary")
        self.open()

    def open(self) -> None:
        self.known = self.handle.getMapState("known", "id string", KNOWN)

    def load(self, ids: list | None) -> pd.DataFrame:
        """The listings known, by id: all, or at least those of `ids`."""
        found = ((k[0], *v) for k, v in self.known.iterator()) if ids is None else ((i, *self.known.getValue((i,))) for i in ids if self.known.containsKey((i,)))
        return frame(list(found))

    def save(self, after: pd.DataFrame, changed: pd.Series, forgotten: pd.Series) -> None:
        for row in told(after[changed], ["id", *STATE]):
            self.known.updateValue((row[0],), row[1:])
        for ident in after.index[forgotten]:
            self.known.removeKey((ident,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        # Else too late: its scan has been applied.
        new = [d for df in rows if len(d := df[(df["kind"] != "tick") & (df["at_us"] // 1000 > passed)])]
        if new:
            scans = [(int(at), d) for at, d in pd.concat(new, ignore_index=True).groupby("at_us")]
            self.waiting.appendList([(at, packed(d, WAITING)) for at, d in scans])
            for ms in {at // 1000 for at, _ in scans}:
                self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto, due, rest = expiredTimerInfo.getExpiryTimeInMs(), {}, []
        for at, rows in self.waiting.get():
            due.setdefault(at, []).append(unpacked(rows)) if at // 1000 <= upto else rest.append((at, rows))
        if not due:
            return
        self.waiting.put(rest) if rest else self.waiting.clear()
        for at in sorted(due):
            out = self.settle(at, pd.concat(due[at], ignore_index=True))
            if len(out):
                yield out

    def settle(self, at: int, rows: pd.DataFrame) -> pd.DataFrame:
        """The changes that a scan at a time makes, which are then known."""
        new = rows[rows["kind"] == "seen"].drop_duplicates("id", keep="last").set_index("id")
        flag = lambda c: rows[c].eq(True).fillna(False).astype(bool)
        closed = rows.loc[(rows["kind"] == "closed") & flag("full") & flag("trusted"), "scope"].unique()
        old = self.load(None if len(closed) else list(new.index))
        was, index = old.index, old.index.append(new.index.difference(old.index, sort=False))
        old, new, seen = old.reindex(index), new.reindex(index), pd.Series(index.isin(new.index), index)
        known = pd.Series(index.isin(was), index)
        after, priced = old.copy(), seen & new["price"].notna()
        marked = seen & (~known | differs(old["marker"], new["marker"]))
        after.loc[seen, ["scope", "marker"]] = new.loc[seen, ["scope", "marker"]]
        after.loc[priced, "price"] = new.loc[priced, "price"]
        after.loc[seen, ["status", "last_seen", "missed"]] = ["active", at, 0]
        after.loc[seen, ["first_missed", "delisted_at"]] = pd.NA
        after.loc[~known, "first_seen"] = at
        after.loc[marked, "marker_since"] = pd.NA
        after.loc[marked & after["marker"].notna(), "marker_since"] = at
        news = priced & (~known | (old["price"].notna() & (old["price"] != new["price"])))  # as in apply_scan
        prices = after[news].copy()
        forgotten = pd.Series(False, index)
        if len(closed):
            active = after["status"] == "active"
            sold = active & (after["marker"] == SOLD) & (after["marker_since"] <= at - SOLD_DAYS * DAY).fillna(False).astype(bool)  # wherever it is listed
            after.loc[sold, "status"] = "sold"
            after.loc[sold, "delisted_at"] = after.loc[sold, "marker_since"]
            misses = active & ~sold & ~seen & after["scope"].isin(closed)
            after.loc[misses, "missed"] += 1
            after.loc[misses & after["first_missed"].isna(), "first_missed"] = at
            gone = misses & (after["missed"] >= GRACE).fillna(False).astype(bool)
            after.loc[gone, "status"] = "inactive"
            after.loc[gone, "delisted_at"] = after.loc[gone, "first_missed"]
        changed = ~known
        for c in STATE:
            changed |= differs(old[c], after[c])
        if len(closed):
            forgotten = ~changed & (after["status"] != "active") & (after["delisted_at"] < at - self.keep).fillna(False).astype(bool)
        after["id"] = prices["id"] = None
        after["id"], prices["id"] = after.index, prices.index
        self.save(after, changed, forgotten)
        out = pd.concat([prices.assign(event="price"), after[changed].assign(event="state")], ignore_index=True)
        return out.assign(at=at)[[c.split()[0] for c in CHANGE.split(", ")]].astype({c: "Int64" for c in ("at", "missed", *TIMES)})


class PackedListings(Listings):
    """The same with the bucket's listings as one value: a scan costs a call for each bucket, and none for each listing."""

    def open(self) -> None:
        self.known = self.handle.getValueState("known", "rows binary")

    def load(self, ids: list | None) -> pd.DataFrame:
        return unpacked(self.known.get()[0]).set_index("id") if self.known.exists() else frame([])

    def save(self, after: pd.DataFrame, changed: pd.Series, forgotten: pd.Series) -> None:
        if changed.any() or forgotten.any():
            self.known.update((packed(after[~forgotten], ["id", *STATE]),))


class Runs(StatefulProcessor):
    """A run's last status; one that still runs when `hours` have passed since its start is interrupted, once."""

    def __init__(self, hours: int) -> None:
        self.wait = hours * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "status string, started long, at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old = self.last.get() if self.last.exists() else None
        news = sorted((int(r.at_us), r.status) for df in rows for r in df.itertuples(index=False))
        at, status = news[-1]
        if old is not None and old[2] > at:
            at, status = old[2], old[0]
        started = min([n for n, s in news if s == "running"] + ([old[1]] if old is not None and old[1] is not None else []), default=None)
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        if status == "running":
            self.last.update((status, started, at))
            self.handle.registerTimer(max(started // 1000 + self.wait, timerValues.getCurrentWatermarkInMs() + 1))
        else:  # over: nothing is kept
            self.last.clear()
        yield pd.DataFrame({"run": [key[0]], "status": [status], "at": [at]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame({"run": [key[0]], "status": ["interrupted"], "at": [expiredTimerInfo.getExpiryTimeInMs() * 1000]})


def buckets_for(listings: int) -> int:
    """Buckets for so many listings: a worker holds one bucket at a time. A checkpoint keeps to the number it began with."""
    return max(16, -(-listings // BUCKET_LISTINGS))


def life_of_listings(feed: DataFrame, late: str = "0 seconds", buckets: int = 16, keep_days: int = 365, pack: bool = False) -> DataFrame:
    """The change log of a stream of FEED rows; scans count in the order of their times, rows up to `late` late.

    The state store has an entry for each listing, or with `pack` one for each bucket: no listing can then be looked up
    in it from outside, but a scan no longer costs calls for each. A checkpoint keeps to what it began with."""
    own = F.array(F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
    rows = feed.withWatermark("at", late).withColumn("bucket", F.explode(F.when(F.col("kind") == "seen", own).otherwise(F.sequence(F.lit(0), F.lit(buckets - 1)))))
    out = rows.withColumn("at_us", F.unix_micros("at")).groupBy("bucket").transformWithStateInPandas((PackedListings if pack else Listings)(keep_days), CHANGE, "Append", "EventTime")
    return out.withColumns({c: F.timestamp_micros(c) for c in ("at", *TIMES)} | {"missed": F.col("missed").cast("int")})


def life_of_runs(rows: DataFrame, late: str = "0 seconds", hours: int = 12) -> DataFrame:
    """(run, status, at) whenever a run's status is known anew, from a stream of (run, status, at)."""
    keyed = rows.withWatermark("at", late).withColumn("at_us", F.unix_micros("at"))
    out = keyed.groupBy("run").transformWithStateInPandas(Runs(hours), "run long, status string, at long", "Append", "EventTime")
    return out.withColumn("at", F.timestamp_micros("at"))


def latest(changes: DataFrame) -> DataFrame:
    """The last state of each listing of a change log."""
    w = W.partitionBy("id").orderBy(F.col("at").desc(), F.col("event").desc())
    return changes.withColumn("__n", F.row_number().over(w)).where("__n = 1 and event = 'state'").drop("__n", "event", "at")


def closings(state: DataFrame, scan: DataFrame, at: Column, full: bool = True) -> DataFrame:
    """FEED rows that end a scan: a scope is trusted if the scan saw at least half as many listings as are active."""
    active = state.where("status = 'active'").select("id", "scope").union(scan.select("id", "scope")).distinct()
    seen = scan.groupBy("scope").agg(F.countDistinct("id").alias("seen"))
    known = active.groupBy("scope").agg(F.count("*").alias("active"))
    return seen.join(known, "scope").select(
        F.lit("closed").alias("kind"), at.alias("at"), "scope", F.lit(None).cast("string").alias("id"), F.lit(None).cast("double").alias("price"),
        F.lit(None).cast("string").alias("marker"), F.lit(full).alias("full"), (F.col("seen") >= GUARD * F.col("active")).alias("trusted"),
    )


def sightings(scan: DataFrame, at: Column) -> DataFrame:
    """FEED rows of a scan of (id, scope, price, marker)."""
    return scan.select(F.lit("seen").alias("kind"), at.alias("at"), "scope", "id", "price", "marker", F.lit(None).cast("boolean").alias("full"), F.lit(None).cast("boolean").alias("trusted"))


def tick(spark: SparkSession, at: Column) -> DataFrame:
    """A FEED row that only tells the time."""
    return spark.range(1).select(F.lit("tick").alias("kind"), at.alias("at"), *[F.lit(None).cast(k).alias(c) for c, k in (x.split() for x in FEED.split(", ")[2:])])


def run_feed(spark: SparkSession, feed: str, out: str, late: str = "0 seconds", files: int | None = None, **options) -> None:
    """Runs life_of_listings over the files of FEED rows that are new in the folder `feed` into Parquet at `out`.

    The checkpoint beside `out` holds the state and which files were read, so a run that broke off is taken up again.
    """
    rows = spark.readStream.schema(FEED).options(**({"maxFilesPerTrigger": files} if files else {})).parquet(feed)
    run_state(spark, life_of_listings(rows, late, **options), out)


def run_state(spark: SparkSession, changes: DataFrame, out: str) -> None:
    """Runs a stream with keyed state over what is there now, into Parquet at `out`; the stores of an executor share one
    bound of memory."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true"}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        changes.writeStream.option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).format("parquet").option("path", out).outputMode("append").start().awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
