"""Dates of other calendars and notations, ages, and the rounding families."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def buddhist_month(day: Column) -> Column:
    """yymm of the month before `day`, the year in the Buddhist era."""
    before = F.add_months(day, -1)
    return F.format_string("%02d%02d", (F.year(before) + 543) % 100, F.month(before))


def months_back(yymm: Column, n: int) -> Column:
    """yymm, n months earlier; within the hundred years that two digits hold."""
    months = F.substring(yymm, 1, 2).cast("int") * 12 + F.substring(yymm, 3, 2).cast("int") - 1 - n
    return F.format_string("%02d%02d", F.floor(months / 12).cast("int"), (F.pmod(months, F.lit(12)) + 1).cast("int"))


def posted_at(text: Column) -> Column:
    """A timestamp from seconds since 1970, /Date(milliseconds)/, or 'Created DD/MM/YYYY'; null for anything else."""
    seconds = F.regexp_extract(text, r"^\s*(\d{9,10})(?:\.0+)?\s*$", 1).try_cast("bigint")
    millis = F.regexp_extract(text, r"/Date\((-?\d+)\)/", 1).try_cast("bigint")
    written = F.regexp_extract(text, r"(?:Created\s+|^\s*)(\d{2}/\d{2}/\d{4})", 1)
    return F.coalesce(F.timestamp_millis(millis), F.when(seconds > 0, F.timestamp_seconds(seconds)), F.try_to_timestamp(F.when(written != "", written), F.lit("dd/MM/yyyy")))


def building_age(year_built: Column, as_of: Column) -> Column:
    """Whole years since the year of building; null for unknown years and those to come."""
    age = F.year(as_of) - year_built
    return F.when(age >= 0, age)


def half_away(x: Column, digits: int = 0) -> Column:
    """Halves of the decimal number away from zero, as SQL rounds numerics."""
    return F.round(x.cast("decimal(30,10)"), digits).cast("double")


def half_even(x: Column, digits: int = 0) -> Column:
    """Halves to the even neighbour, as binary doubles are rounded; an exact half is one only as a double."""
    scale = float(10**digits)
    return F.rint(x * scale) / scale
