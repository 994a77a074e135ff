"""Structured Streaming twins of the batch operators: windowed counts with late data, and per-listing state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGE = "user_id long, observed_at timestamp, price double, previous double, sightings long"


def windowed(events: DataFrame, at: str, width: str, late: str, key: str) -> DataFrame:
    """Counts and sums by tumbling window and key; on a stream, rows later than `late` are dropped."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(F.window(at, width), key).agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


def price_changes(events: DataFrame, key: str = "user_id", at: str = "ts", value: str = "value") -> DataFrame:
    """A row for each observation whose price differs from the listing's last one; the state holds that one alone."""
    def step(ident: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values([at, value], ignore_index=True)
        price = rows[value].astype(float)
        before = price.shift(1)
        if last is not None:
            before.iloc[0] = last
        changed = (price != before) & ~(price.isna() & before.isna())
        if not n:
            changed.iloc[0] = True
        state.update((float(price.iloc[-1]), n + len(rows)))
        out = pd.DataFrame({"user_id": ident[0], "observed_at": rows[at], "price": price, "previous": before, "sightings": n + 1 + rows.index})
        yield out[changed]

    return events.groupBy(key).applyInPandasWithState(step, CHANGE, "last double, n long", "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, path: str, mode: str = "append", batch: bool = False) -> None:
    """Runs a stream over what is there now, into Parquet at `path`, with its checkpoint beside it."""
    writer = stream.writeStream.option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True)
    if batch or mode == "complete":
        writer = writer.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path))
        writer.start().awaitTermination()
    else:
        writer.outputMode(mode).format("parquet").option("path", path).start().awaitTermination()
