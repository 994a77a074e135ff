"""Stalls and outages as session windows: what comes within a gap of what came before is one session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ledger import LEAST_MARKS, STALL_MINUTES


def sessions(rows: DataFrame, key: str, at: str, minutes: int = STALL_MINUTES, late: str = "1 hour") -> DataFrame:
    """(key, began, last, n) of each session of a key; after `last` nothing came for `minutes`.

    On a stream a session comes out once the watermark has passed its last row by `minutes`, so that each row of the
    output is a stall; rows later than `late` are dropped, if their session is out. On a table all sessions come out, the last of each key too.
    Rows without a key are a key of their own; those without a time are left out.
    """
    rows = rows.withWatermark(at, late) if rows.isStreaming else rows
    window = F.session_window(at, f"{minutes} minutes").alias("w")
    out = rows.groupBy(window, key).agg(F.max(at).alias("last"), F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("began"), "last", "n")


def outages(failures: DataFrame, key: str, at: str, minutes: int = STALL_MINUTES, late: str = "1 hour", least: int = LEAST_MARKS) -> DataFrame:
    """The sessions of failures that hold `least` of them."""
    return sessions(failures, key, at, minutes, late).where(F.col("n") >= least)
