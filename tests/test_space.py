import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.operators import exposure, space

R = 6371.0


def hav(a1, o1, a2, o2):
    a1, o1, a2, o2 = map(np.radians, (a1, o1, a2, o2))
    h = np.sin((a2 - a1) / 2) ** 2 + np.cos(a1) * np.cos(a2) * np.sin((o2 - o1) / 2) ** 2
    return 2 * R * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


def rings_df(spark, rings):
    rows = []
    for no, (name, pts) in enumerate(rings):
        xs, ys = [p[0] for p in pts], [p[1] for p in pts]
        rows.append((no, name, [{"lon": float(x), "lat": float(y)} for x, y in pts], float(min(xs)), float(max(xs)), float(min(ys)), float(max(ys))))
    return spark.createDataFrame(rows, "ring_no int, port string, pts array<struct<lon:double,lat:double>>, x0 double, x1 double, y0 double, y1 double")


def loop_assign(x, y, rings):
    for name, ring in rings:
        odd = False
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
        if odd:
            return name
    return None


def test_assign_polygon_first_ring_wins_and_holes_fill(spark):
    rings = [("outer", [(0, 0), (3, 0), (3, 3), (0, 3), (0, 0)]), ("hole", [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]),
             ("over", [(2.2, 2.2), (6, 2.2), (4, 6), (2.2, 2.2)]), ("west", [(-7.3, -1), (-6.1, -1.2), (-6.5, .9), (-7.3, -1)])]
    rng = np.random.default_rng(0)
    pts = [(float(x), float(y)) for x, y in np.column_stack([rng.uniform(-8, 7, 1500), rng.uniform(-2, 7, 1500)])] + [(1.5, 1.5), (.5, .5), (2.5, 2.5)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)] + [(-1, None, 1.0)], "i int, x double, y double")
    for cells in ((.5, .05), (1.0, .3)):
        got = {r.i: r.port for r in space.assign_polygon(df, "x", "y", rings_df(spark, rings), "port", *cells).collect()}
        assert got[-1] is None
        assert all(got[i] == loop_assign(x, y, rings) for i, (x, y) in enumerate(pts))
        assert got[1500] == "outer"


@pytest.mark.parametrize("metric", ["haversine", "planar"])
def test_nearest_is_exact(spark, metric):
    rng = np.random.default_rng(1)
    q = np.column_stack([rng.uniform(-85, 85, 150), rng.uniform(-180, 180, 150)])
    t = np.column_stack([rng.uniform(-85, 85, 40), rng.uniform(-180, 180, 40)])
    t = np.vstack([t, t[:1]])
    Q = spark.createDataFrame([(float(a), float(b)) for a, b in q] + [(None, 1.0)], "lat double, lon double")
    T = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(t)], "n int, a double, o double")
    out = space.nearest(Q, T, lat="lat", lon="lon", t_lat="a", t_lon="o", order="n", columns=["n"], metric=metric).collect()
    assert len(out) == 151
    for r in out:
        if r.lat is None:
            assert r.n is None
            continue
        d = hav(r.lat, r.lon, t[:, 0], t[:, 1]) if metric == "haversine" else np.hypot(
            (r.lat - t[:, 0]) * 110.57, (r.lon - t[:, 1]) * 111.32 * np.cos(np.radians(r.lat)))
        assert r.dist_km == pytest.approx(d.min()) and r.n != 40
    capped = space.nearest(Q, T, lat="lat", lon="lon", t_lat="a", t_lon="o", order="n", columns=["n"], cap=200.0).collect()
    assert len(capped) == 151 and all(r.dist_km is None or r.dist_km <= 200 for r in capped)


@pytest.mark.parametrize("metric", ["haversine", "planar"])
def test_nearest_beside_a_crowd(spark, metric):
    """Half of all points and targets share one degree cell; points compare themselves with few of them all the same."""
    rng = np.random.default_rng(7)
    crowd = lambda n: np.column_stack([rng.uniform(29, 30, n), rng.uniform(-95, -94, n)])
    wide = lambda n: np.column_stack([rng.uniform(-60, 60, n), rng.uniform(-179, 179, n)])
    t, q = np.vstack([crowd(2500), wide(2500)]), np.vstack([crowd(400), wide(400), [[28.2, -94.5], [30.0, 179.9], [90.0, 0.0]]])
    T = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(t)], "n int, _tlat double, _tlon double")
    S = spark.createDataFrame([(float(a), float(b)) for a, b in q], "_lat double, _lon double")
    pairs = space.candidate_places(S, T, metric, None).toPandas()
    per = pairs.groupby(["_lat", "_lon"]).size()
    assert len(per) == len(q) and per.mean() < len(t) / 15 and per.max() < len(t) / 4
    children, leaves = space.search_tree(T)
    sizes = [r.k for r in leaves.select(F.size("places").alias("k")).collect()]
    assert sum(sizes) == len(t) and max(sizes) <= space.LEAF_PLACES
    for (a, o), g in pairs.groupby(["_lat", "_lon"]):
        d = hav(a, o, t[:, 0], t[:, 1]) if metric == "haversine" else np.hypot((a - t[:, 0]) * 110.57, (o - t[:, 1]) * 111.32 * np.cos(np.radians(a)))
        assert int(d.argmin()) in set(g.n)


def test_within_km_wraps_the_date_line_and_poles(spark):
    pts = [(0.0, 179.5), (0.0, -179.5), (89.0, 10.0), (89.0, -170.0), (10.0, 10.0)]
    centers = [("date", 0.0, -179.9), ("pole", 89.5, 100.0), ("mid", 10.5, 10.5)]
    P, C = spark.createDataFrame(pts, "lat double, lon double"), spark.createDataFrame(centers, "c string, a double, o double")
    got = {(r.c, r.lat, r.lon) for r in space.within_km(P, C, lat="lat", lon="lon", c_lat="a", c_lon="o", km=300.0).collect()}
    assert got == {(c, a, o) for c, ca, co in centers for a, o in pts if hav(a, o, ca, co) <= 300}


def test_assign_cell_fine_first_and_half_to_even(spark):
    cells = spark.createDataFrame([(.5, 2, 0, "A", "port"), (2.5, 0, 0, "B", "channel"), (2.5, 0, 1, "C", "offshore")],
                                  "res_deg double, gy long, gx long, complex string, tier string")
    df = spark.createDataFrame([(1, 1.25, 0.0), (2, .75, .1), (3, .3, 2.0), (4, 80.0, 0.0)], "i int, y double, x double")
    got = {r.i: (r.complex, r.tier) for r in space.assign_cell(df, "y", "x", cells, (.5, 2.5)).collect()}
    # 1.25 / .5 = 2.5 rounds to 2 and .75 / .5 = 1.5 rounds to 2
    assert got == {1: ("A", "port"), 2: ("A", "port"), 3: ("C", "offshore"), 4: (None, None)}
    assert df.select(F.rint(F.lit(2.5))).first()[0] == 2.0


def test_exposures_of_the_same_days_share_their_window(spark, monkeypatch):
    """Forty exposures at two stations meet each observation once, not once each."""
    ev = spark.range(40).selectExpr("id AS SID", "'x' AS port", "concat('G', id % 2) AS coops_station", "CASE WHEN id <> 3 THEN concat('G', id % 2) END AS asos_station",
                                    "TIMESTAMP_NTZ'2024-01-08 00:00:00' AS exposure_start", "TIMESTAMP_NTZ'2024-01-09 00:00:00' AS exposure_end")
    obs = spark.range(600).selectExpr("concat('G', id % 2) AS station", "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, id div 2) AS t", "CAST(id AS DOUBLE) AS v")
    met, quantiles = [], exposure.exact_quantiles
    monkeypatch.setattr(exposure, "exact_quantiles", lambda df, *rest: met.append(df.count()) or quantiles(df, *rest))
    got = {r.SID: r for r in exposure.station_covariates(ev, obs, obs, obs.selectExpr("station", "t AS valid", "v / 1000 AS p01i")).collect()}
    assert max(met) <= 600 and len(got) == 40
    hours = range(168, 217)
    for i, r in got.items():
        inside = [2.0 * h + i % 2 for h in hours]
        around = sorted(2.0 * h + i % 2 for h in range(300) if h not in hours)
        calm = (around[(len(around) - 1) // 2] + around[len(around) // 2]) / 2
        assert (r.max_wind_ms, r.surge_height_m) == (max(inside), pytest.approx(max(inside) - calm))
        assert r.rainfall_mm == (pytest.approx(sum(inside) / 1000 * 25.4, abs=.006) if i != 3 else None)
