import random
from statistics import median

from pyspark.sql import functions as F

from parcelspark.functions import stats


def quantile(xs, q):
    xs = sorted(xs)
    h = q * (len(xs) - 1)
    k = int(h)
    return xs[k] + (xs[min(k + 1, len(xs) - 1)] - xs[k]) * (h - k)


def middle(xs, n):
    xs = sorted(xs)
    start = max(0, min(len(xs) // 2 - n // 2, len(xs) - n))
    part = xs[start : start + n]
    return sum(part) / len(part)


def test_leave_one_out_equals_the_naive_way(spark):
    rng = random.Random(4)
    data = [(f"i{k}", rng.choice("abc"), float(rng.choice([1, 2, 2, 3, 5, 8, 13]))) for k in range(80)] + [("x", "d", 1.0), ("y", "e", None)]
    free = [("n1", None, 4.0), ("n2", None, 5.0)]  # rows without a group have no peers
    df = spark.createDataFrame(data, "id string, g string, v double")
    got = {r.id: r for r in stats.leave_one_out(df, ["g"], "v", "id", {"p25": 0.25, "med": 0.5, "p75": 0.75}, 1).collect()}
    win = {r.id: r for r in stats.leave_one_out_window(df.union(spark.createDataFrame(free, df.schema)), "g", "v", "id", "ref", 4, 1).collect()}
    for i, g, v in data:
        others = [w for j, h, w in data if h == g and j != i and w is not None]
        assert got[i].peers == len(others) and (win[i].ref_n or 0) == len(others)
        if not others:
            assert got[i].med is None and win[i].ref is None
            continue
        for name, q in (("p25", 0.25), ("med", 0.5), ("p75", 0.75)):
            assert abs(got[i][name] - quantile(others, q)) < 1e-9
        assert abs(win[i].ref - middle(others, 4)) < 1e-9
    assert win["n1"].ref is None and win["n2"].ref_n is None


def test_winsorised_clamps_from_twenty_on(spark):
    rows = [("a", float(i)) for i in range(1, 41)] + [("b", float(i)) for i in range(1, 11)]
    df = stats.winsorised(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", "w")
    out = {(r.g, r.v): r.w for r in df.collect()}
    assert out["a", 1.0] == 3.0 and out["a", 40.0] == 39.0 and out["a", 20.0] == 20.0 and out["b", 1.0] == 1.0


def test_mid_rank_and_median(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (None,), (4.0,)], "v double")
    got = sorted((r.v is None, r.v or 0, r.p) for r in df.select("v", stats.mid_rank(F.col("v")).alias("p")).collect())
    assert [p for *_, p in got] == [12.5, 50.0, 50.0, 87.5, None]
    one = spark.createDataFrame([(3.0,), (None,)], "v double").select(stats.mid_rank(F.col("v")).alias("p")).collect()
    assert sorted(r.p is None for r in one) == [False, True] and {r.p for r in one} == {50.0, None}
    zeros = spark.createDataFrame([(0.0,), (-1.0,), (3.0,), (5.0,)], "v double")
    assert zeros.select(stats.median_positive(F.col("v"))).first()[0] == median([3.0, 5.0])
    assert stats.middle_means(zeros.withColumn("g", F.lit("x")), ["g"], F.col("v"), "m", 3).first().m == 4.0


def test_middle_values_of_groups(spark):
    rng = random.Random(8)
    data = [(g, float(rng.randrange(-2, 30))) for g in "abcd" for _ in range({"a": 1, "b": 2, "c": 7, "d": 40}[g])] + [("e", None)]
    df = stats.middle_means(spark.createDataFrame(data, "g string, v double"), ["g"], F.col("v"), "m", 3)
    got = {r.g: r.m for r in df.collect()}
    for g in "abcde":
        values = [v for h, v in data if h == g and v is not None and v > 0]
        assert got.get(g) is None if not values else abs(got[g] - middle(values, 3)) < 1e-9


def test_weighted_shares_out_missing_weight(spark):
    a, b = F.lit(80.0), F.lit(None).cast("double")
    assert spark.range(1).select(stats.weighted([(a, 35.0), (b, 25.0)])).first()[0] == 80.0
    assert spark.range(1).select(stats.weighted([(b, 35.0)])).first()[0] is None


def test_order_statistics_of_a_group_with_all_rows(spark):
    """A null group, ties, zeros, both signs; values spread over many ranges and over one."""
    rng = random.Random(2)
    data = [("hot", rng.choice([-3.0, 0.0, -0.0, 0.001, 1e9, float(rng.randrange(1000, 1010)), rng.uniform(-1e6, 1e6)])) for _ in range(20_000)]
    data += [(None, float(i)) for i in range(5)] + [("one", 7.0), ("none", None)]
    df = spark.createDataFrame(data, "g string, v double").repartition(6)
    ranks = [0, 1, 4, 777, 9_999, 19_999]
    found = stats.order_statistics(df, ["g"], "v", lambda n: F.array(*[F.lit(r).cast("long") for r in ranks], n, F.lit(-1).cast("long")))
    got = {r.key.g: (r.n, r["at"]) for r in found.collect()}
    for g in ("hot", None, "one"):
        values = sorted(v for h, v in data if h == g and v is not None)
        assert got[g] == (len(values), {r: values[r] for r in ranks if r < len(values)})
    assert "none" not in got
    out = stats.winsorised(df, ["g"], "v", "w")
    values = sorted(v for h, v in data if h == "hot")
    low, high = values[1000], values[19_000]
    assert sorted(r.w for r in out.where("g = 'hot'").collect()) == sorted(min(high, max(low, v)) for v in values)
    assert out.where("g is null").count() == 5
