"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix, in DataFrame operations only.

Rows lie in partitions (by a hash of the row, copies of a row told apart by numbers). How many rows of partition p go to shard s is drawn exactly as a uniform
permutation would have it: the matrix is split recursively, halves of the partitions against all shards, each cell by a
hypergeometric draw. Then each partition is permuted locally and dealt out by its row of the matrix (the exchange), and
each shard is permuted again. Nothing is sorted over the whole input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, stage

ROWS_PER_PARTITION = 1024
MOST_PARTITIONS = 65_536


def unit(*parts: Column) -> Column:
    """A number in [0, 1) that depends on `parts` alone."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` rows out of `total` are among the `good` ones, by inversion at u.

    The weights are walked by their ratios from the mode, relative to the mode's own, as far as nine standard
    deviations and 30 (what lies beyond is under the resolution of u).
    """
    n, k, m = total.cast("double"), good.cast("double"), drawn.cast("double")
    low, high = F.greatest(F.lit(0.0), m + k - n), F.least(m, k)
    mode = F.least(high, F.greatest(low, F.floor((m + 1) * (k + 1) / (n + 2)).cast("double")))
    p = k / F.greatest(n, F.lit(1.0))
    reach = F.ceil(9 * F.sqrt(F.greatest(F.lit(0.0), m * p * (1 - p) * (n - m) / F.greatest(n - 1, F.lit(1.0)))) + 30).cast("double")
    first, last = F.greatest(low, mode - reach).cast("long"), F.least(high, mode + reach).cast("long")
    centre = mode.cast("long")

    def walk(start: Column, ks: Column, stop: Column, up: bool) -> Column:
        # (weight of the last x, sum so far, the x at which the sum passes stop)
        def step(acc: Column, x: Column) -> Column:
            x = x.cast("double")
            if up:  # weight(x) from weight(x - 1)
                w = acc.w * (k - x + 1) * (m - x + 1) / (x * (n - k - m + x))
            else:  # weight(x) from weight(x + 1)
                w = acc.w * ((x + 1) * (n - k - m + x + 1)) / ((k - x) * (m - x))
            return F.struct(w.alias("w"), (acc.s + w).alias("s"), F.when(acc.at.isNull() & (acc.s + w > stop), x.cast("long")).otherwise(acc.at).alias("at"))

        return F.aggregate(ks, start, step)

    zero = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"), F.lit(None).cast("long").alias("at"))
    ups = F.when(last > centre, F.sequence(centre + 1, F.greatest(last, centre + 1))).otherwise(F.array().cast("array<bigint>"))
    downs = F.when(first < centre, F.sequence(centre - 1, F.least(first, centre - 1), F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    never = F.lit(float("inf"))
    sums = F.struct(walk(zero, ups, never, True).s.alias("up"), walk(zero, downs, never, False).s.alias("down"))

    def choose(s: Column) -> Column:
        aim = u * (1 + s.up + s.down)  # the mode first, then upwards, then downwards
        return (
            F.when(aim < 1, centre)
            .when(aim < 1 + s.up, F.coalesce(walk(zero, ups, aim - 1, True).at, last))
            .otherwise(F.coalesce(walk(zero, downs, aim - 1 - s.up, False).at, first))
        )

    return F.transform(F.array(sums), choose)[0]


def split_counts(caps: Column, rows: Column, seeds: tuple[Column, ...], shards: int) -> Column:
    """A multivariate hypergeometric draw: of each shard's `caps` places, how many fall to the first `rows` rows."""
    def step(acc: Column, s: Column) -> Column:
        cap = F.element_at(caps, s)
        x = hypergeometric(acc.places, cap, acc.rows, unit(*seeds, s))
        return F.transform(
            F.array(x),
            lambda v: F.struct(F.concat(acc.out, F.array(v)).alias("out"), (acc.rows - v).alias("rows"), (acc.places - cap).alias("places")),
        )[0]

    total = F.aggregate(caps, F.lit(0).cast("long"), lambda a, c: a + c)
    start = F.struct(F.array().cast("array<bigint>").alias("out"), rows.alias("rows"), total.alias("places"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step).out


def matrix(counts: DataFrame, partitions: int, shards: int, seed: int) -> DataFrame:
    """(part, ends): for each partition the running sums of its counts per shard. counts: (part, n), each part once.

    `partitions` is a power of two of at most MOST_PARTITIONS, so a row of the recursion holds that many longs at most.
    """
    spark = counts.sparkSession
    all_parts = spark.range(partitions).select(F.col("id").cast("int").alias("part"))
    filled = all_parts.join(counts, "part", "left").select("part", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    node = filled.agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "n"))), lambda x: x.n).alias("ns"))
    total = F.aggregate("ns", F.lit(0).cast("long"), lambda a, x: a + x)
    caps = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda s: F.floor(total / shards).cast("long") + F.when(s < total % shards, 1).otherwise(0),
    )
    node = node.select(F.lit(0).alias("lo"), "ns", caps.alias("caps"))
    width, level = partitions, 0
    while width > 1:
        half = width // 2
        left = F.slice("ns", 1, half)
        rows = F.aggregate(left, F.lit(0).cast("long"), lambda a, x: a + x)
        got = split_counts(F.col("caps"), rows, (F.lit(seed), F.lit(level), F.col("lo")), shards)
        halves = F.transform(
            F.array(got),
            lambda g: F.array(
                F.struct(F.col("lo").alias("lo"), F.slice("ns", 1, half).alias("ns"), g.alias("caps")),
                F.struct((F.col("lo") + half).alias("lo"), F.slice("ns", half + 1, half).alias("ns"), F.zip_with("caps", g, lambda c, x: c - x).alias("caps")),
            ),
        )[0]
        node = node.select(F.explode(halves).alias("h")).select("h.lo", "h.ns", "h.caps")
        if level == 5:  # 64 nodes by now: the rest of the recursion runs in parallel
            node = node.repartition("lo")
        width, level = half, level + 1
    ends = F.transform(
        F.sequence(F.lit(1), F.lit(shards)),
        lambda i: F.aggregate(F.slice("caps", 1, i), F.lit(0).cast("long"), lambda a, x: a + x),
    )
    return node.select(F.col("lo").alias("part"), ends.alias("ends"))


def dealt(rows: DataFrame, partitions: int) -> DataFrame:
    """`rows` (row, h) with their partition `part`. Copies of a row meet in one, to be numbered there; those that alone
    would fill it are numbered by shares here, their numbers hashed into h, and so lie in any partition. Which copy has
    which number makes no difference, as they are equal."""
    heavy = stage(rows.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > ROWS_PER_PARTITION).select("h"))
    if heavy.head(1):
        n_heavy = heavy.limit(BROADCAST_ROWS + 1).count()  # a thousandth of the rows at most
        known = heavy.select(F.col("h").alias("heavy"))
        marked = rows.join(F.broadcast(known) if n_heavy <= BROADCAST_ROWS else known, F.col("h") == F.col("heavy"), "left")
        # Written, so that a task run again finds each copy in the share that it had.
        own = stage(marked.where("heavy is not null").drop("heavy").withColumn("share", F.pmod(F.monotonically_increasing_id(), F.lit(partitions)).cast("int")))
        before = W.partitionBy("h").orderBy("share").rowsBetween(W.unboundedPreceding, -1)
        starts = own.groupBy("h", "share").agg(F.count("*").alias("n")).select("h", "share", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("from"))
        place = F.row_number().over(W.partitionBy("h", "share").orderBy(F.lit(0)))
        numbered = own.withColumn("place", place).join(starts, ["h", "share"])
        numbered = numbered.select("row", F.xxhash64("h", F.col("from") + F.col("place")).alias("h"))
        rows = marked.where("heavy is null").drop("heavy").union(numbered)
    return rows.withColumn("part", F.pmod("h", F.lit(partitions)).cast("int"))


def shard_rows(docs: DataFrame, shards: int, seed: int = 20, by: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """Every input row with its `shard` and `slot`: a uniform shuffle whose shards differ by one row at most.

    The draw depends on the seed, the columns named in `by` and the number of rows, not on how the input lies, so a
    task run again gives the same rows. Rows equal in all of `by` are interchangeable, and each copy lies anywhere as
    rows that differ do. Slots of a shard are gapless from 0. Nulls are values like any other and an empty table gives
    an empty result; very long texts are carried as they are; columns named shard or slot are replaced, all others are
    carried, whatever their names.
    """
    n = docs.count()
    partitions = 1
    while partitions < MOST_PARTITIONS and partitions * ROWS_PER_PARTITION < n:
        partitions *= 2
    docs = docs.drop("shard", "slot")
    # The input's columns travel as one, so that none of them can clash with those used here.
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(*[F.col(c) for c in by], F.lit(seed)).alias("h"))
    ties = [F.col("row")[c] for c in by]
    rows = dealt(rows, partitions)
    # Written, as the plan of its recursion would stand in all that follows; a row a partition.
    deal = stage(matrix(rows.groupBy("part").agg(F.count("*").alias("n")), partitions, shards, seed))
    # Both windows lie on this one exchange. Copies differ by their numbers from here on.
    rows = rows.repartition("part").withColumn("copy", F.row_number().over(W.partitionBy("part", "h", *ties).orderBy(F.lit(0))))
    local = W.partitionBy("part").orderBy(F.xxhash64("h", "copy", F.lit(1)), "h", "copy", *ties)
    rows = rows.withColumn("rank", F.row_number().over(local) - 1).join(deal, "part")
    rows = rows.withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("rank"))))
    # The second permutation: a shard's rows lie in sub-blocks in the order of a new hash, each ranked on its own.
    blocks = max(1, partitions // shards)
    block = F.floor(unit(F.col("h"), F.col("copy"), F.lit(3)) * blocks).cast("int").alias("block")
    rows = rows.select("row", "shard", "h", "copy", F.xxhash64("h", "copy", F.lit(2)).alias("again"), block)
    ranked = rows.withColumn("at", F.row_number().over(W.partitionBy("shard", "block").orderBy("again", "h", "copy", *ties)) - 1)
    if blocks == 1:
        return ranked.select("row.*", "shard", F.col("at").cast("long").alias("slot"))
    sizes = rows.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("from"))
    return ranked.join(starts, ["shard", "block"]).select("row.*", "shard", (F.col("from") + F.col("at")).cast("long").alias("slot"))
