import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.operators import ordered, quantiles

T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("bucket", [1800, 86400, 10**9])
def test_chain_number_ignores_buckets_and_input_order(spark, bucket):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(300):
        a = T0 + dt.timedelta(seconds=int(rng.integers(0, 900_000)))
        rows.append((int(rng.integers(0, 3)), a, a + dt.timedelta(seconds=int(rng.integers(0, 30000))), i))
    df = spark.createDataFrame(rows[::-1], "k int, a timestamp_ntz, b timestamp_ntz, i int")
    got = {r.i: r.n for r in ordered.chain_number(df, ["k"], "a", "b", 1.0, "n", ["i"], bucket).collect()}
    for k in range(3):
        end, n = None, 0
        for _, a, b, i in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2], r[3])):
            if end is None or (a - end).total_seconds() > 3600:
                n, end = n + 1, b
            else:
                end = max(end, b)
            assert got[i] == n


def test_gap_of_exactly_the_limit_is_joined(spark):
    h = lambda x: T0 + dt.timedelta(hours=x)
    df = spark.createDataFrame([(1, h(0), h(1)), (1, h(7), h(8)), (1, h(14.01), h(15))], "k int, a timestamp_ntz, b timestamp_ntz")
    assert sorted(r.n for r in ordered.chain_number(df, ["k"], "a", "b", 6, "n").collect()) == [1, 1, 2]


def test_cumulative_and_shares(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = np.unique(np.concatenate([rng.normal(0, 1, 400), rng.lognormal(5, 3, 400), [-1e12, 1e12]]))
    df = spark.createDataFrame([(float(x), int(i % 7)) for i, x in enumerate(v)], "v double, n int")
    for bins in (1024, 16):
        monkeypatch.setattr(ordered, "BINS", bins)
        out = ordered.cumulative(df, [], "v", ["n"]).orderBy("v").toPandas()
        assert out.columns.tolist() == ["v", "n", "cum_n", "total_n"]
        assert (out.cum_n.to_numpy() == np.cumsum([i % 7 for i in range(len(v))])).all()
    assert set(out.total_n) == {sum(i % 7 for i in range(len(v)))}


def test_bins_are_even_beside_nested_outliers(spark):
    """Values crowd around 1, and each group of outliers is a million times as far out as the one before it."""
    rng = np.random.default_rng(8)
    v = np.concatenate([1 + rng.normal(0, 1e-9, 20_000), *[10.0 ** (6 * i) * (1 + rng.random(5)) for i in range(1, 6)], [-1e300, 1e300]])
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    cuts = df.agg(F.percentile_approx("v", F.array(*[F.lit(i / ordered.BINS) for i in range(1, ordered.BINS)]), 10 * ordered.BINS).alias("cuts")).scalar()
    bins = df.withColumn("cuts", cuts).groupBy(ordered._bin_of(F.col("v"), F.col("cuts")).alias("b")).count().toPandas()
    assert bins["count"].max() <= 3 * len(v) / ordered.BINS and len(bins) > 0.9 * ordered.BINS
    placed = df.withColumn("cuts", cuts).select("v", ordered._bin_of(F.col("v"), F.col("cuts")).alias("b")).orderBy("v").toPandas()
    assert placed.b.is_monotonic_increasing
    out = ordered.cumulative(df.select("v", F.lit(1).alias("n")).distinct(), [], "v", ["n"]).orderBy("v").toPandas()
    assert out.cum_n.to_list() == list(range(1, len(out) + 1))


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    rows = [("hot", float(x)) for x in np.round(rng.lognormal(0, 4, 5000), 2)] + [("few", 3.0), ("few", 9.0), ("one", 7.0), ("flat", 2.0), ("flat", 2.0)]
    df = spark.createDataFrame(rows + [("few", None)], "k string, v double")
    got = quantiles.exact_quantiles(df, ["k"], "v", {"a": .025, "m": .5, "z": .9}).toPandas().set_index("k")
    for k in ("hot", "few", "one", "flat"):
        v = [x for g, x in rows if g == k]
        assert got.loc[k, ["a", "m", "z"]].to_list() == pytest.approx(list(np.quantile(v, [.025, .5, .9])))


def test_ks_distance(spark):
    rng = np.random.default_rng(6)
    a, b = np.round(rng.normal(0, 1, 300), 1), np.round(rng.normal(.4, 1, 200), 1)
    df = spark.createDataFrame([("a", float(x)) for x in a] + [("b", float(x)) for x in b], "s string, v double")
    r = quantiles.ks_two_sample(df, [], "v", "s", "a", "b").first()
    grid = np.unique(np.concatenate([a, b]))
    d = max(abs((a <= x).mean() - (b <= x).mean()) for x in grid)
    assert r.ks_d == pytest.approx(d) and .02 < r.ks_p < .08
    same = quantiles.ks_two_sample(df.union(df.filter("s = 'a'").withColumn("s", F.lit("c"))), [], "v", "s", "a", "c").first()
    assert same.ks_d == 0 and same.ks_p == 1


def test_stable_index_is_a_permutation(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), F.col("id").alias("c"))
    out = ordered.stable_index(df, ["g"], "c", "i").toPandas()
    for _, x in out.groupby("g"):
        assert sorted(x.i) == list(range(500))


def test_runs(spark):
    d = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)
    flags = [1, 1, 0, 1, 0, 0, 1, 1, 1]
    df = spark.createDataFrame([(0, d(i), bool(f)) for i, f in enumerate(flags)] + [(1, d(0), False)], "k int, d date, f boolean")
    got = sorted((r.k, r.run_start, r.run_end, r.run_days) for r in ordered.runs(df, ["k"], "d", "f").collect())
    assert got == [(0, d(0), d(1), 2), (0, d(3), d(3), 1), (0, d(6), d(8), 3)]


def test_cumulative_share(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", 3.0), ("c", 2.0), ("d", 3.0)], "u string, v double")
    out = [(r.u, r["rank"], r.cum_share) for r in quantiles.cumulative_share(df, [], "u", "v").orderBy("rank").collect()]
    assert [x[:2] for x in out] == [("a", 1), ("b", 2), ("d", 3), ("c", 4)]
    assert [x[2] for x in out] == pytest.approx([5 / 13, 8 / 13, 11 / 13, 1])
