from hashlib import md5

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewake.functions import draws
from tidewake.operators import geolocate as gl, products as pr, regress as rg, resample as rs
from tests.test_space import hav


def clusters(spark, const=None, n=30, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        for u in range(3):
            e = float(rng.uniform(5, 20))
            rows.append((f"c{c}", f"u{u}", e * (const if const else float(rng.uniform(.5, 1.5))), e))
    return spark.createDataFrame(rows, "SID string, unit string, obs double, expected double")


def test_bootstrap_of_a_constant_has_no_width(spark):
    r = rs.boot_ratio(clusters(spark, .7), [], "SID", "obs", "expected", draws=50).first()
    assert (r.ratio, r.ratio_lo, r.ratio_hi, r.n_clusters) == (pytest.approx(.7), pytest.approx(.7), pytest.approx(.7), 30)


def test_bootstrap_interval_is_close_to_numpy(spark):
    df = clusters(spark)
    r = rs.boot_ratio(df, [], "SID", "obs", "expected", draws=1500).first()
    g = df.groupBy("SID").agg(F.sum("obs"), F.sum("expected")).toPandas().iloc[:, 1:].to_numpy()
    rng = np.random.default_rng(1)
    s = g[rng.integers(0, 30, (4000, 30))].sum(1)
    lo, hi = np.percentile(s[:, 0] / s[:, 1], [2.5, 97.5])
    assert r.ratio_lo == pytest.approx(lo, abs=.02) and r.ratio_hi == pytest.approx(hi, abs=.02)


def test_slots_are_hashed_once_for_all_groups(monkeypatch):
    """Groups of 5,000 and 3,000 clusters in blocks of 1,000: a draw hashes 5,000 slots, not every slot for each block and group."""
    rng, made = np.random.default_rng(2), []
    sums = {g: rng.uniform(1, 2, (n, 2)) for g, n in (("a", 5000), ("b", 3000), ("c", 5000))}
    rows = [{"_part": p, "g": g, "_block": b, "n_clusters": len(v), "_packed": v[b * 1000:(b + 1) * 1000].tobytes()} for p in (0, 1) for g, v in sums.items() for b in range(len(v) // 1000)]
    monkeypatch.setattr(rs, "DRAWS_AT_ONCE", 3)
    monkeypatch.setattr(rs, "hashes", lambda seed, draw, first, last: made.append(last - first) or draws.hashes(seed, draw, first, last))
    got = pa.Table.from_batches(rs.drawn_sums(pa.Table.from_pylist(rows).to_batches(max_chunksize=4), ["g"], [pa.string()], ["x", "y"], draws=5, seed=9)).to_pylist()
    assert sum(made) == 5 * 5000
    assert sorted((r["g"], r["draw"]) for r in got) == [(g, d) for g in "abc" for d in range(1, 6)]
    for r in got:
        v = sums[r["g"]]
        taken = [int(md5(f"9|{r['draw']}|{slot}".encode()).hexdigest()[:15], 16) % len(v) for slot in range(len(v))]
        assert (r["x"], r["y"]) == (pytest.approx(v[taken, 0].sum()), pytest.approx(v[taken, 1].sum()))


def test_few_clusters_have_no_interval(spark):
    df = clusters(spark, n=2).withColumn("g", F.when(F.col("SID") == "c0", "one").otherwise("other"))
    rows = rs.boot_ratio(df, ["g"], "SID", "obs", "expected", draws=20).collect()
    assert all(r.ratio is not None and r.ratio_lo is None for r in rows)


def test_leave_one_out_bounds(spark):
    df = clusters(spark)
    for unit in ("SID", "unit"):
        r = rs.leave_one_out(df, [], unit, "obs", "expected").first()
        assert r["min"] <= r.full <= r["max"]
    p = df.toPandas()
    loo = {u: p[p.SID != u].obs.sum() / p[p.SID != u].expected.sum() for u in p.SID.unique()}
    r = rs.leave_one_out(df, [], "SID", "obs", "expected").first()
    assert r.n_units == 30 and r["min"] == pytest.approx(min(loo.values())) and r["max"] == pytest.approx(max(loo.values()))
    assert r.most_influential == max(loo, key=lambda u: abs(loo[u] - r.full))


def test_permutation_extremes(spark):
    rng = np.random.default_rng(3)
    fake = [("s%d" % i, "u", y, float(rng.uniform(9, 11)), 10.0) for i in range(20) for y in range(2015, 2019)]
    pl = spark.createDataFrame(fake, "SID string, unit string, y int, obs double, expected double")
    low = spark.createDataFrame([("s%d" % i, "u", 2.0, 10.0) for i in range(20)], "SID string, unit string, obs double, expected double")
    r = rs.permutation_test(low, pl, [], ["SID", "unit"], "y", draws=200).first()
    assert r.p_perm == pytest.approx(1 / 201) and .97 < r.null_median < 1.03
    same = rs.permutation_test(low.withColumn("obs", F.lit(10.0)), pl, [], ["SID", "unit"], "y", draws=200).first()
    assert same.p_perm > .5


def test_slope_bootstrap_and_topk(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, 200)
    df = spark.createDataFrame([(f"c{i % 20}", float(a), float(2 * a + 1)) for i, a in enumerate(x)], "c string, _x double, _y double")
    r = rs.boot_slope(df, [], "c", draws=50).first()
    assert (r.slope, r.slope_lo, r.slope_hi) == pytest.approx((2, 2, 2))
    t = spark.createDataFrame([("a", 6.0), ("b", 3.0), ("c", 1.0), ("d", -5.0)], "u string, v double")
    got = {(q.scope, q.units): q.share for q in rs.topk_share(t, "u", "v", ks=(1, 2)).collect()}
    assert got == {("top", 1): .6, ("top", 2): .9, ("all positive", 3): 1.0}


def sandwich(X, y, groups, w=None):
    w = np.ones(len(y)) if w is None else w
    inv = np.linalg.inv((X * w[:, None]).T @ X)
    b = inv @ (X * w[:, None]).T @ y
    e = (y - X @ b) * w
    out = []
    for g in groups:
        u = np.array([(X[g == k] * e[g == k][:, None]).sum(0) for k in np.unique(g)])
        G, (n, k) = len(u), X.shape
        out.append(inv @ (u.T @ u) @ inv * G / (G - 1) * (n - 1) / (n - k))
    return b, out


def test_cluster_ols_one_and_two_way(spark):
    rng = np.random.default_rng(5)
    n = 300
    g, h = rng.integers(0, 25, n), rng.integers(0, 12, n)
    x, z = rng.normal(size=n), rng.normal(size=n)
    y = 1 + .5 * x - .2 * z + rng.normal(size=25)[g] + rng.normal(size=n)
    w = rng.uniform(.5, 2, n)
    df = spark.createDataFrame([(float(a), float(b), float(c), int(p), int(q), float(k)) for a, b, c, p, q, k in zip(y, x, z, g, h, w)] + [(float("nan"), 1.0, 1.0, 1, 1, 1.0)],
                               "y double, x double, z double, g int, h int, w double")
    X = np.column_stack([np.ones(n), x, z])
    b, (v1, v2, v12) = sandwich(X, y, [g, h, g * 100 + h])
    one = {r.term: r for r in rg.cluster_ols(df, "y", ["x", "z"], "g").collect()}
    assert [one[t].coef for t in ("intercept", "x", "z")] == pytest.approx(list(b)) and one["x"].n == n
    assert [one[t].se for t in ("intercept", "x", "z")] == pytest.approx(list(np.sqrt(np.diag(v1))))
    two = {r.term: r for r in rg.cluster_ols(df, "y", ["x", "z"], "g", second="h").collect()}
    assert two["x"].se == pytest.approx(np.sqrt((v1 + v2 - v12)[1, 1]))
    bw, (vw,) = sandwich(X, y, [g], w)
    wt = {r.term: r for r in rg.cluster_ols(df, "y", ["x", "z"], "g", weight="w").collect()}
    assert wt["z"].coef == pytest.approx(bw[2]) and wt["z"].se == pytest.approx(np.sqrt(vw[2, 2]))
    # published pair: coefficient .0920 with error .1040 has normal p .3761
    from tidewake.operators.quantiles import normal_two_sided
    assert normal_two_sided(.0920 / .1040) == pytest.approx(.3761, abs=5e-4)


def test_standardise_and_missing(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (3.0, 5.0, 2.0)], "a double, b double, c double")
    assert sorted(r.a for r in rg.zscores(df, ["a"]).collect()) == pytest.approx([-.70710678, .70710678])
    m = rg.with_missing_flag(df, ["c"], "gone").collect()
    assert sorted((r.c, r.gone) for r in m) == [(0.0, 1.0), (2.0, 0.0)]
    assert {r.b for r in rg.zscores(df, ["b"]).collect()} == {None}


def test_quantile_bands_leave_five_percent_above(spark):
    rng = np.random.default_rng(6)
    rows = []
    for g in ("p", "q", "tiny"):
        for _ in range(1500 if g != "tiny" else 20):
            s, l = rng.uniform(0, 3), rng.uniform(0, 2)
            rows.append((g, float(abs(rng.normal(0, .5 + .2 * s))), float(s), float(l)))
    df = spark.createDataFrame(rows, "g string, a double, size double, ld double")
    out = {r.g: r for r in rg.quantile_bands(df, ["g"], "a", ["size", "ld"]).collect()}
    assert set(out) == {"p", "q"}
    for g in ("p", "q"):
        above = [a > out[g].intercept + out[g]["size"] * s + out[g].ld * l for k, a, s, l in rows if k == g]
        assert .04 < np.mean(above) < .06 and out[g]["size"] > .2


def test_rounds_of_bands_read_numbers_of_fitted_groups_only(spark, monkeypatch):
    rows = [("p", "window", float(i % 7), float(i % 5), float(i % 3)) for i in range(60)] + [("tiny", "window", 1.0, 1.0, 1.0)] * 9
    kept, write = [], rg.checkpointed
    monkeypatch.setattr(rg, "checkpointed", lambda df: kept.append(write(df)) or kept[-1])
    df = spark.createDataFrame(rows, "g string, h string, a double, size double, ld double")
    assert [r.n for r in rg.quantile_bands(df, ["g", "h"], "a", ["size", "ld"], rounds=4).collect()] == [60]
    read = [t for t in kept if t.count() >= 60][-1]
    assert read.count() == 60 and {kind for _, kind in read.dtypes} == {"bigint", "double"}


def test_divergence_rules(spark):
    cols = "lh double, lc double, g double, tau_h double, tau_c double, tau_g double, hours_day double"
    rows = [(.1, .1, 0., .2, .2, .1, 30.), (.5, .5, 0., .2, .2, .1, 30.), (.3, .9, .6, .2, .2, .1, 30.), (.9, .3, -.6, .2, .2, .1, 30.),
            (.5, -.5, -1., .2, .2, .1, 30.), (.5, .5, 0., .2, .2, .1, 10.), (None, .5, None, .2, .2, .1, 30.), (.5, .5, 0., None, None, None, 30.)]
    got = [r.cls for r in pr.classify_divergence(spark.createDataFrame(rows, cols)).collect()]
    assert got == ["no response", "coupled", "relative (amplified)", "relative (damped)", "absolute", "no data", "no data", "no data"]


def test_savings_and_labels(spark):
    r = spark.range(1).select(pr.saving_per_hour(F.lit(72), F.lit(24)).alias("a"), pr.saving_per_hour(F.lit(24), F.lit(48)).alias("b"),
                              pr.coast(F.lit("Panama City Port Authority, FL")).alias("c"), pr.coast(F.lit("Milwaukee, WI")).alias("d")).first()
    assert r.a == pytest.approx(72 * (1 - .75 ** 2) / 24) and r.b == pytest.approx(24 * (1 - .36) / 48) and (r.c, r.d) == ("Gulf", "Great Lakes")


def test_concentrated_scenario_floor(spark):
    q = spark.createDataFrame([("S%d" % i, "u", "queue", "g", -5.0, 1.0, 1.0) for i in range(5)], "SID string, unit string, window string, intensity string, net_excess_wait_h double, f_main_t_per_h double, net_excess_wait_fuel_t double")
    out = pr.arrival_scenarios(q, ["window", "intensity"], draws=20).collect()
    assert len(out) == 36 and all(r.co2_saved_t == 0 and r.n_pairs == 5 and r.wait_h_hi < 0 for r in out)


def test_geolocation_finds_the_storm(spark):
    ports = [("A", 29.3, -94.8), ("B", 30.0, -90.0), ("C", 27.9, -82.4), ("D", 30.7, -88.0), ("E", 30.2, -85.7), ("F", 29.4, -91.5), ("G", 25.8, -80.2)]
    path = [(0, 26.5, -88.0), (1, 27.2, -88.8), (2, 28.0, -89.5)]
    rows = [("S", t, n, float(hav(la, lo, pa, po))) for t, la, lo in path for n, pa, po in ports if hav(la, lo, pa, po) <= 500]
    tk = spark.createDataFrame(rows, "SID string, time int, port string, dist_km double")
    P = spark.createDataFrame(ports, "port string, p_lat double, p_lon double")
    got = {r.time: r for r in gl.locate_storms(tk, P).collect()}
    seen = [t for t, *_ in path if sum(r[1] == t for r in rows) >= 3]
    assert seen and set(got) == set(seen)
    for t, la, lo in path:
        if t in got:
            assert hav(got[t].lat, got[t].lon, la, lo) < 3 and got[t].rms_km < 3
    far = [("X", 28.4, -90.4)]
    rng = np.random.default_rng(0)
    fixes = [("S", i, float(a), float(b), 1.0, 3) for i, (a, b) in enumerate(zip(rng.uniform(25, 31, 12), rng.uniform(-94, -86, 12)))]
    F1 = spark.createDataFrame(fixes, "SID string, time int, lat double, lon double, rms_km double, n_ports long")
    T1 = spark.createDataFrame([("S", i, "X", float(hav(a, b, 28.0, -90.0))) for _, i, a, b, *_ in fixes], tk.schema)
    moved = gl.refine_ports(T1, F1, spark.createDataFrame(far, P.schema)).first()
    assert (moved.p_lat, moved.p_lon) == pytest.approx((28.0, -90.0), abs=.02)
    assert gl.distance_errors(T1, F1, spark.createDataFrame([("X", 28.0, -90.0)], P.schema)).first().rms_km < 1e-6
