"""Order statistics, ranks and rounding that the market queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounds halves upwards: floor(x * 10^d + 0.5) / 10^d."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def positive(x: Column) -> Column:
    """x where it is over zero, else null: medians leave out zeros and what is below."""
    return F.when(x > 0, x)


def median_positive(x: Column) -> Column:
    """Exact median (mean of the two in the middle) of the values over zero."""
    return F.percentile(positive(x), F.lit(0.5))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or null."""
    return a / F.when(b != 0, b)


def middle_start(count: Column, n: int) -> Column:
    """Where the n values about the middle of `count` sorted ones begin."""
    return F.greatest(F.lit(0), F.least(F.floor(count / 2).cast("int") - n // 2, count - n))


def value_range(v: Column) -> Column:
    """A number for the range in which a value lies, greater for greater values: 64 to a doubling, and both signs."""
    return (F.signum(v) * (F.floor(F.log2(F.abs(v)) * 64) + 100_000)).cast("long")


def order_statistics(df: DataFrame, group: list[str], value: str, ranks: Callable[[Column], Column]) -> DataFrame:
    """(key, n, at) per group with values: the struct of `group`, how many values are not null, and a map from each rank
    (from 0) of the array ranks(n) to the value there.

    Selection without sorting a group anywhere: equal values are counted together, the counts of value ranges say in
    which range a rank lies, and only such ranges are put in order, each on its own. However many rows a group has, no
    task holds more than one range of its distinct values.
    """
    v = F.col(value).cast("double")
    counts = df.where(v.isNotNull()).groupBy(F.struct(*group).alias("key"), (v + F.lit(0.0)).alias("v")).agg(F.count("*").alias("c"))
    counts = counts.withColumn("range", F.when(F.col("v") == 0, 0).otherwise(value_range(F.col("v"))))
    per = counts.groupBy("key", "range").agg(F.sum("c").alias("c"))
    w = W.partitionBy("key")
    per = per.withColumns({"n": F.sum("c").over(w), "below": F.coalesce(F.sum("c").over(w.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))})
    wanted = per.withColumn("k", F.filter(F.array_distinct(ranks(F.col("n"))), lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("c"))))
    found = counts.join(wanted.where(F.size("k") > 0).select("key", "range", "n", "below", "k"), ["key", "range"])
    ahead = F.sum("c").over(W.partitionBy("key", "range").orderBy("v").rowsBetween(W.unboundedPreceding, -1))
    found = found.withColumn("from", F.col("below") + F.coalesce(ahead, F.lit(0)))
    hit = F.filter("k", lambda r: (r >= F.col("from")) & (r < F.col("from") + F.col("c")))
    found = found.select("key", "n", "v", F.explode(hit).alias("rank"))
    return found.groupBy("key").agg(F.first("n").alias("n"), F.map_from_entries(F.collect_list(F.struct(F.col("rank").cast("long"), "v"))).alias("at"))


def beside(df: DataFrame, group: list[str], found: DataFrame) -> DataFrame:
    """`df` with __n and __at of its groups from order_statistics(); 0 and null where a group has no values."""
    named = found.select(F.col("key").alias("__key"), F.col("n").alias("__n"), F.col("at").alias("__at"))
    return df.join(named, F.struct(*group) == F.col("__key"), "left").withColumn("__n", F.coalesce("__n", F.lit(0).cast("long"))).drop("__key")


def there(rank: Column) -> Column:
    return F.try_element_at(F.col("__at"), rank.cast("long"))


def total(first: Column, last: Column) -> Column:
    """The sum of the values at the ranks from first to last; null without one."""
    return F.when(last >= first, F.aggregate(F.sequence(first.cast("long"), last.cast("long")), F.lit(0.0), lambda acc, r: acc + there(r)))


def middle_means(df: DataFrame, group: list[str], value: Column, out: str, n: int = 3) -> DataFrame:
    """(*group, out): the mean of the n values about the middle of each group's values over zero."""
    start = lambda c: middle_start(c, n)
    end = lambda c: F.least(c, start(c) + n) - 1
    found = order_statistics(df.withColumn("__v", positive(value)), group, "__v", lambda c: F.sequence(start(c).cast("long"), end(c).cast("long")))
    c = F.col("__n")
    rows = found.select("key.*", F.col("n").alias("__n"), F.col("at").alias("__at"))
    return rows.select(*group, (total(start(c), end(c)) / (end(c) - start(c) + 1)).alias(out))


def winsorised(df: DataFrame, group: list[str], value: str, out: str, low: float = 0.05, high: float = 0.95, least_n: int = 20) -> DataFrame:
    """Add `out`: value, clamped to its group's quantiles s[min(n - 1, floor(p n))] where the group has `least_n` values."""
    at = lambda c, p: F.least(c - 1, F.floor(c * p))
    # Groups under `least_n` need no order at all: their rows are only counted.
    full = df.groupBy(F.struct(*group).alias("__key")).agg(F.count(value).alias("__c")).where(F.col("__c") >= least_n).select("__key")
    ordered = df.join(full, F.struct(*group) == F.col("__key"), "left_semi")
    rows = beside(df, group, order_statistics(ordered, group, value, lambda c: F.array(at(c, low), at(c, high))))
    clamped = F.least(there(at(F.col("__n"), high)), F.greatest(there(at(F.col("__n"), low)), F.col(value)))
    clamped = F.when(F.col("__n") >= least_n, clamped).otherwise(F.col(value))
    return rows.withColumn(out, clamped).drop("__n", "__at")


def mid_rank(value: Column, group: list[Column] | None = None) -> Column:
    """Percentile rank with ties at their middle: (below + equal / 2) / defined * 100; null stays null, one value is 50."""
    group = group or [F.lit(1)]
    w = W.partitionBy(*group)
    n = F.count(value).over(w)
    below = F.rank().over(w.orderBy(value.asc_nulls_last())) - 1
    equal = F.count(value).over(W.partitionBy(*group, value))
    return F.when(value.isNotNull(), F.when(n <= 1, 50.0).otherwise((below + 0.5 * equal) / n * 100))


def weighted(parts: list[tuple[Column, float]]) -> Column:
    """The weighted mean of the scores that are not null, halves up; null if all are."""
    acc = sum((F.coalesce(s * w, F.lit(0.0)) for s, w in parts), F.lit(0.0))
    weight = sum((F.when(s.isNotNull(), w).otherwise(0.0) for s, w in parts), F.lit(0.0))
    return F.when(weight > 0, half_up(acc / F.when(weight > 0, weight)))


def shrunk(score: Column, n: Column, centre: Column, k: float) -> Column:
    """(n score + k centre) / (n + k); the score itself without a centre."""
    return F.when(centre.isNull(), score).otherwise((n * score + k * centre) / (n + k))


def slope(y: Column, x: Column, least: int = 3) -> Column:
    """Least-squares slope of y on x over the pairs without nulls, null under `least` of them or without variance."""
    defined = F.count(F.when(y.isNotNull() & x.isNotNull(), 1))
    return F.when(defined >= least, F.regr_slope(y, x))


def leave_one_out(df: DataFrame, group: list[str], value: str, key: str, quantiles: dict[str, float], least: int) -> DataFrame:
    """Add, for each row, interpolated quantiles of its group's other values, and `peers`, their number.

    A row that is not a member (value null) sees the whole group. Removing the value of rank r from the sorted list
    shifts those behind it, so a quantile needs only two of the three ranks at its place: they come from windows on one
    partitioning by the group, and no pairs are formed. Quantiles of under `least` peers are null.
    """
    w = W.partitionBy(*group)
    rank = F.when(F.col(value).isNotNull(), F.row_number().over(w.orderBy(F.col(value).asc_nulls_last(), key)) - 1)
    ranked = df.withColumn("__r", rank).withColumn("__n", F.count(value).over(w))
    whole, less = F.col("__n") - 1, F.col("__n") - 2  # the last index of the whole list and of the list less one
    at_rank = lambda i: F.max(F.when(F.col("__r") == i, F.col(value))).over(w)
    points = {}
    for name, q in quantiles.items():
        points |= {f"__{name}{j}": at_rank(F.floor(less * q) + j) for j in range(3)}
        points |= {f"__{name}w0": at_rank(F.floor(whole * q)), f"__{name}w1": at_rank(F.ceil(whole * q))}
    out = ranked.withColumns(points).withColumn("peers", F.col("__n") - F.when(F.col("__r").isNotNull(), 1).otherwise(0))
    for name, q in quantiles.items():
        k = F.floor(less * q)
        at = lambda j: F.when(k + j < F.col("__r"), F.col(f"__{name}{j}")).otherwise(F.col(f"__{name}{j + 1}"))  # noqa: B023, E731
        frac = less * q - k
        own = F.when(frac > 0, at(0) + (at(1) - at(0)) * frac).otherwise(at(0))
        low, high = F.col(f"__{name}w0"), F.col(f"__{name}w1")
        other = low + (high - low) * (whole * q - F.floor(whole * q))
        out = out.withColumn(name, F.when(F.col("peers") >= least, F.when(F.col("__r").isNotNull(), own).otherwise(other)))
    return out.drop("__r", "__n", *points)


def leave_one_out_window(df: DataFrame, group: str, value: str, key: str, out: str, n: int, least: int) -> DataFrame:
    """Add `out`: the mean of the n middle values among the group's others, and `out`_n, how many those are; null under
    `least` of them. Rows whose value is null see the whole group; a null group is a group of its own row.

    All comes from windows on the one partitioning by the group. The n + 1 values about the middle are summed; what is
    left out of them is the row's own value, or the last or first of them if the row lies elsewhere.
    """
    own = F.coalesce(F.col(group), F.concat(F.lit("\u0000"), F.col(key).cast("string")))  # spreads rows without a group
    rows = df.withColumn("__g", own)
    w = W.partitionBy("__g")
    rows = rows.withColumn("__r", F.when(F.col(value).isNotNull(), F.row_number().over(w.orderBy(F.col(value).asc_nulls_last(), key)) - 1)).withColumn("__n", F.count(value).over(w))
    r, whole, less = F.col("__r"), F.col("__n"), F.col("__n") - 1
    a, b = middle_start(less, n), middle_start(less, n) + F.least(F.lit(n), less)
    pick = lambda cond: F.when(cond, F.col(value))
    rows = rows.withColumns({
        "__sum": F.sum(pick((r >= a) & (r <= b))).over(w), "__first": F.max(pick(r == a)).over(w), "__last": F.max(pick(r == b)).over(w),
        "__whole": F.sum(pick((r >= middle_start(whole, n)) & (r < middle_start(whole, n) + n))).over(w),
    })
    without = F.when(r < a, F.col("__first")).when(r >= b, F.col("__last")).otherwise(F.col(value))
    mean = (F.col("__sum") - without) / F.when(less > 0, F.least(F.lit(n), less))
    other = F.col("__whole") / F.when(whole > 0, F.least(F.lit(n), whole))
    peers = whole - F.when(r.isNotNull(), 1).otherwise(0)
    there = F.col(group).isNotNull() & (peers >= least)
    rows = rows.withColumn(out, F.when(there, F.when(r.isNotNull(), mean).otherwise(other))).withColumn(f"{out}_n", F.when(there, peers))
    return rows.drop("__g", "__r", "__n", "__sum", "__first", "__last", "__whole")
