import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.functions import geo
from tidewake.functions.binning import cut
from tidewake.functions.dates import ceil_day, same_day_in_year, scored_season
from tidewake.functions.draws import pick
from tidewake.functions.numeric import clip, finite, log_ratio, nearest_ln, ratio


def values(df, col):
    return [r[col] for r in df.collect()]


def test_cut_sides_differ_on_edges(spark):
    df = spark.createDataFrame([(49.0,), (50.0,), (63.0,), (0.0,), (200.0,), (None,)], "x double")
    edges, labels = [0, 49, 63, 200], ["a", "b", "c"]
    out = df.select("x", cut("x", edges, labels).alias("r"), cut("x", edges, labels, right=False).alias("l")).collect()
    assert [(r.r, r.l) for r in out] == [("a", "b"), ("b", "b"), ("b", "c"), (None, "a"), ("c", None), (None, None)]
    with pytest.raises(ValueError):
        cut("x", [0, 1], ["a", "b"])


def test_null_safe_numbers(spark):
    df = spark.createDataFrame([(1.0, 0.0), (float("nan"), 2.0), (float("inf"), 2.0), (4.0, 2.0), (-1.0, 2.0)], "a double, b double")
    assert values(df.select(finite("a").alias("x")), "x") == [1.0, None, None, 4.0, -1.0]
    assert values(df.select(ratio("a", "b").alias("x")).limit(1), "x") == [None]
    out = values(df.filter("b > 0 AND a < 5").select(log_ratio("a", "b").alias("x")), "x")
    assert out[0] == pytest.approx(math.log(2)) and out[1] is None
    assert values(spark.range(1).select(clip(F.lit(None).cast("double"), 0.0, 1.0).alias("x")), "x") == [None]


def test_nearest_ln(spark):
    x = [k / 997 for k in range(1, 3000)]
    df = spark.createDataFrame([(v,) for v in [*x, 0.0, -1.0, None]], "x double")
    assert values(df.select(nearest_ln("x").alias("y")), "y") == [*map(math.log, x), None, None, None]
    assert values(df.select(log_ratio("x", F.lit(1.0), nearest_ln).alias("y")), "y") == [*map(math.log, x), None, None, None]


def test_same_day_in_year(spark):
    df = spark.createDataFrame([(dt.date(2020, 2, 29),), (dt.date(2020, 3, 1),)], "d date")
    out = df.select(same_day_in_year("d", F.lit(2019)).alias("a"), same_day_in_year("d", F.lit(2016)).alias("b"),
                    same_day_in_year("d", F.lit(2000)).alias("c"), same_day_in_year("d", F.lit(1900)).alias("e")).collect()
    assert tuple(out[0]) == (None, dt.date(2016, 2, 29), dt.date(2000, 2, 29), None)
    assert tuple(out[1]) == (dt.date(2019, 3, 1), dt.date(2016, 3, 1), dt.date(2000, 3, 1), dt.date(1900, 3, 1))


def test_day_helpers(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 1, 2),), (dt.datetime(2020, 1, 2, 6),)], "t timestamp_ntz")
    assert values(df.select(ceil_day("t").alias("d")), "d") == [dt.date(2020, 1, 2), dt.date(2020, 1, 3)]
    ev = spark.createDataFrame([(dt.date(2020, 1, 5), dt.date(2020, 1, 6)), (dt.date(2020, 12, 9), dt.date(2020, 12, 11)),
                                (dt.date(2020, 12, 9), dt.date(2020, 12, 10))], "s date, e date")
    assert values(ev.select(scored_season("s", "e").alias("ok")), "ok") == [False, False, True]


def test_point_in_ring_against_loop(spark):
    rng = np.random.default_rng(4)
    ring = [(0, 0), (4, 0.5), (5, 3), (2, 2), (1, 5), (0, 0)]
    pts = [(float(x), float(y)) for x, y in rng.uniform(-1, 6, (300, 2))]

    def inside(x, y):
        odd = False
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
        return odd

    df = spark.createDataFrame(pts, "x double, y double")
    col = F.array(*[F.struct(F.lit(float(a)).alias("lon"), F.lit(float(b)).alias("lat")) for a, b in ring])
    assert values(df.select(geo.point_in_ring("x", "y", col).alias("i")), "i") == [inside(*p) for p in pts]


def test_centroid_and_projection(spark):
    ring = lambda p: F.array(*[F.struct(F.lit(float(a)).alias("lon"), F.lit(float(b)).alias("lat")) for a, b in p])
    row = spark.range(1).select(geo.ring_centroid(ring([(0, 0), (2, 0), (2, 4), (0, 4), (0, 0)])).alias("a"),
                                geo.ring_centroid(ring([(1, 1), (3, 1), (1, 1)])).alias("b"),
                                geo.mercator_lon(F.lit(-10018754.17)).alias("x"), geo.mercator_lat(F.lit(3503549.84)).alias("y"),
                                geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("d")).first()
    assert (row.a.lat, row.a.lon) == pytest.approx((2, 1))
    assert (row.b.lat, row.b.lon) == pytest.approx((1, 5 / 3))
    assert row.x == pytest.approx(-90.0, abs=1e-6) and row.y == pytest.approx(30.0, abs=1e-5)
    assert row.d == pytest.approx(math.pi * 6371)


def test_draws_match_the_hash(spark):
    import hashlib
    df = spark.range(2000).select((F.col("id") % 50 + 1).alias("draw"), F.floor(F.col("id") / 50).alias("slot"))
    out = df.select("draw", "slot", pick("draw", "slot", F.lit(37), 9).alias("i")).collect()
    for r in out:
        assert r.i == int(hashlib.md5(f"9|{r.draw}|{r.slot}".encode()).hexdigest()[:15], 16) % 37
    assert len({r.i for r in out}) == 37


@pytest.mark.parametrize("n", [5, 20, 26, 48, 200, 1000])
def test_draws_resample_like_numpy(spark, n):
    """Over 1,000 draws: the variance of a cluster's count is 1 - 1/n, and resampled means spread as they should."""
    draws = 1000
    df = spark.range(draws).select((F.col("id") + 1).alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("slot"))
    got = df.select("draw", pick("draw", "slot", F.lit(n), 3).alias("i")).groupBy("draw", "i").count().toPandas()
    counts = np.zeros((draws, n))
    counts[got.draw.to_numpy() - 1, got.i.to_numpy()] = got["count"]
    assert abs(counts.var() / (1 - 1 / n) - 1) < 0.05
    values = np.random.default_rng(n).normal(size=(40, n))
    ratio = (counts @ values.T / n).std(axis=0) / (values.std(axis=1) / np.sqrt(n))
    assert abs(ratio.mean() - 1) < 0.1


def test_large_groups_are_drawn_whole(spark):
    top = spark.range(20000).select(F.max(pick(F.lit(1), "id", F.lit(10_000_000), 1))).first()[0]
    assert top > 9_900_000


def test_no_distance_without_a_position(spark):
    row = spark.sql("SELECT CAST(NULL AS DOUBLE) AS a, 1D AS b").select(geo.haversine_km("a", "b", "b", "b").alias("x"), geo.haversine_km("b", "b", "b", "b").alias("y")).first()
    assert row.x is None and row.y == 0
