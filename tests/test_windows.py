import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewake.operators import calendar as cal, window_tests as wt

D0 = dt.date(2020, 1, 1)


def day(i):
    return D0 + dt.timedelta(days=int(i))


def panel(spark, values, unit="A"):
    return spark.createDataFrame([(unit, day(i), float(v)) for i, v in enumerate(values)], "unit string, date date, v double")


def event(spark, a, b, sid="S", unit="A"):
    return spark.createDataFrame([(sid, unit, day(a), day(b))], "SID string, unit string, start date, end date")


def test_densify_and_coverage(spark):
    p = spark.createDataFrame([("A", day(0), 1.0), ("B", day(1), 2.0), ("A", day(3), 3.0), ("A", day(3), 4.0)], "unit string, date date, v double")
    got = {(r.unit, r.date): r.v for r in cal.densify(p, "unit", "date", ["v"]).collect()}
    assert len(got) == 6 and got["A", day(3)] == 7 and got["B", day(0)] == 0
    ev = spark.createDataFrame([(1, day(0), day(1)), (2, day(1), day(3)), (3, day(3), day(3)), (4, day(3), day(4))], "i int, start date, end date")
    assert sorted(r.i for r in cal.covered_events(ev, p, "date", "start", "end").collect()) == [1, 3]
    assert cal.covered_events(ev, p, "date", "start", "end", 1).count() == 0
    diff = cal.calendar_difference(p, p.filter("date > '2020-01-01'").union(spark.createDataFrame([("Z", day(9), 1.0)], p.schema)), "date")
    assert sorted((r.date, r.only_in) for r in diff.collect()) == [(day(0), "first"), (day(9), "second")]
    assert [r.unit for r in cal.units_with_floor(p, "unit", "date", "v", 1.0).collect()] == ["A"]


def test_baseline_years_exclusions(spark):
    ev = spark.createDataFrame([("S", "A", dt.date(2020, 8, 1), dt.date(2020, 8, 3))], "SID string, unit string, start date, end date")
    ex = spark.createDataFrame([("A", dt.date(2018, 6, 1), dt.date(2018, 6, 2)), ("A", dt.date(2018, 9, 17), dt.date(2018, 9, 20)),
                                ("A", dt.date(2017, 9, 18), dt.date(2017, 9, 20)), ("B", dt.date(2016, 8, 1), dt.date(2016, 8, 1))], "unit string, start date, end date")
    kw = dict(unit="unit", start="start", end="end", x_start="start", x_end="end", years=(2015, 2021))
    based = cal.baseline_years(ev, ex, **kw)
    assert based.first().base == [2015, 2016, 2017, 2019, 2021]        # window is 2 June to 17 September
    fakes = cal.placebo_events(based, start="start", end="end")
    assert all(r.placebo_year not in r.base and r.placebo_year != 2020 and 2020 not in r.base and r.start.year == r.placebo_year for r in fakes.collect())
    assert fakes.count() == 5
    leap = spark.createDataFrame([("S", "A", dt.date(2020, 4, 29), dt.date(2020, 4, 30))], "SID string, unit string, start date, end date")
    assert cal.baseline_years(leap, ex, **kw).first().base == [2016]    # 60 days earlier is 29 February


def test_local_baseline_and_metrics(spark):
    v = np.full(200, 10.0)
    v[::2] = 12.0
    v[100:106] = [5, 0, 0, 4, 6, 9]
    curve = wt.local_baseline(panel(spark, v), event(spark, 101, 102), unit="unit", day="date", value="v")
    r = curve.filter(F.col("date") == day(100)).first()
    train = np.r_[v[46:91], v[113:158]]
    assert (r.yhat, r.yhat_lower, r.yhat_upper) == pytest.approx(tuple(np.quantile(train, [.5, .025, .975])))
    m = wt.disruption_metrics(curve, unit="unit", day="date").first()
    assert (m.t_initial_disruption, m.t_end_disruption, m.disruption_days, m.days_at_zero) == (day(100), day(106), 6, 2)
    assert m.t_start_recovery == day(102) and m.recovery_days == 4 and m.recovery_observed == 1 and m.max_impact == 1
    assert m.total_impact == pytest.approx(sum(1 - x / 10 for x in (5, 0, 0, 4, 6, 9)))
    p = wt.disruption_metrics(curve, unit="unit", day="date", preset="published").first()
    assert p.t_start_recovery == day(101) and p.baseline_in_window == pytest.approx(6 * r.yhat)
    quiet = wt.local_baseline(panel(spark, np.full(200, 3.0)), event(spark, 101, 102), unit="unit", day="date", value="v")
    q = wt.disruption_metrics(quiet, unit="unit", day="date").first()
    assert q.disruption_days == 0 and q.t_initial_disruption is None
    assert wt.excess_metrics(curve, unit="unit", day="date").first().excess_days == 0
    v[101:104] = 30
    x = wt.excess_metrics(wt.local_baseline(panel(spark, v), event(spark, 101, 102), unit="unit", day="date", value="v"), unit="unit", day="date").first()
    assert x.excess_days == 3 and x.total_excess == pytest.approx(3 * (30 / 12 - 1))


def test_equal_runs_take_the_first_and_short_series_drop(spark):
    v = np.full(200, 10.0)
    v[[98, 99, 103, 104]] = 1
    curve = wt.local_baseline(panel(spark, v), event(spark, 99, 103), unit="unit", day="date", value="v")
    m = wt.disruption_metrics(curve, unit="unit", day="date").first()
    assert m.t_initial_disruption == day(98) and m.disruption_days == 2
    assert wt.local_baseline(panel(spark, v), event(spark, 5, 6), unit="unit", day="date", value="v").count() == 0
    assert wt.local_baseline(panel(spark, np.zeros(200)), event(spark, 99, 103), unit="unit", day="date", value="v").count() == 0


def test_fitted_baseline_recovers_a_smooth_series(spark):
    t = np.arange(800)
    y = 50 + .02 * t + 6 * np.sin(2 * np.pi * t / 7) + 9 * np.cos(2 * np.pi * t / 365.25)
    hit = y.copy()
    hit[400:406] = 0
    ev = spark.createDataFrame([(f"S{i}", "A", day(a), day(a + 5)) for i, a in enumerate((400, 420, 300))], "SID string, unit string, start date, end date")
    out = wt.fitted_baseline(panel(spark, hit), ev.filter("SID = 'S0'"), unit="unit", day="date", value="v").orderBy("date").toPandas()
    assert len(out) == 26 and np.allclose(out.yhat, y[390:416], atol=.2)
    assert wt.disruption_metrics(spark.createDataFrame(out), unit="unit", day="date").first().disruption_days == 6
    many = wt.fitted_baseline(panel(spark, hit), ev, unit="unit", day="date", value="v")
    assert many.groupBy("SID").count().count() == 3
    same = many.filter("SID = 'S0'").orderBy("date").toPandas()
    assert np.allclose(same.yhat, out.yhat)


def test_fitted_baseline_limits(spark):
    fit = lambda v, a: wt.fitted_baseline(panel(spark, v), event(spark, a, a + 1), unit="unit", day="date", value="v").collect()
    assert fit(np.arange(60.0), 30) == [] and fit(np.zeros(200), 100) == []
    flat = fit(np.full(100, 5.0), 50)
    assert len(flat) == 22 and all(c == pytest.approx(5) for r in flat for c in (r.yhat, r.yhat_lower, r.yhat_upper))


def test_fit_solves_the_normal_equations(spark):
    from tidewake.operators import trend_fit
    rng = np.random.default_rng(4)
    y = 30 + rng.normal(0, 3, 900)
    r = trend_fit.fit(panel(spark, y), event(spark, 500, 510), unit="unit", day="date", value="v", mask=10, interval=.95).first()
    t = np.array([i for i in range(900) if not 490 <= i <= 520], float)
    x = trend_fit.design(t, r.first_t, r.last_t, r.within)
    assert x.shape == (900 - 31, 1 + 1 + 9 + 6 + 20) and r.n_train == 869 and len(r.coefficients) == 37
    assert np.abs(x.T @ (y[t.astype(int)] - x @ np.array(r.coefficients))).max() < 1e-6 and r.off_normal < 1e-8
    assert [c.observed for c in r.curve] == pytest.approx(y[490:521]) and [c.next_observed for c in r.curve] == pytest.approx(y[491:522])


def test_window_rank_against_pandas(spark):
    rng = np.random.default_rng(0)
    v = rng.poisson(20, 200).astype(float)
    r = wt.window_rank(panel(spark, v), event(spark, 100, 102), unit="unit", day="date", value="v").first()
    s = pd.Series(v[55:148]).rolling(3).mean().dropna().to_numpy()
    start = np.arange(55, 55 + len(s))
    ref = s[(start + 2 < 90) | (start > 112)]
    obs = v[100:103].mean()
    assert r.n_ref == len(ref) and r.ref_median == pytest.approx(np.median(ref)) and r.ref_p95 == pytest.approx(np.quantile(ref, .95))
    assert r.p_lower == pytest.approx(((ref <= obs).sum() + 1) / (len(ref) + 1)) and r.z == pytest.approx((obs - np.median(ref)) / ref.std(ddof=1))


def factors_panel(spark, n, h, c):
    return spark.createDataFrame([("A", day(i), float(a), float(b), float(x)) for i, (a, b, x) in enumerate(zip(n, h, c))],
                                 "unit string, date date, vessels_present double, hours double, co2_ton double")


def test_window_factors_identity_and_gaps(spark):
    rng = np.random.default_rng(1)
    rows = []
    for u in range(40):
        n = rng.integers(5, 30, 150)
        h = n * rng.uniform(5, 9, 150)
        c = h * rng.uniform(1, 2, 150)
        rows += [(f"U{u:02d}", day(i), float(n[i]), float(h[i]), float(c[i])) for i in range(150)]
    frames = spark.createDataFrame(rows, "unit string, date date, vessels_present double, hours double, co2_ton double")
    evs = spark.createDataFrame([("S", f"U{u:02d}", day(70), day(71 + u % 3)) for u in range(40)], "SID string, unit string, start date, end date")
    w = wt.window_factors(frames, evs, unit="unit", day="date")
    b = {y: wt.log_slope(w, y).first().b for y in ("r_CO2", "r_H", "r_I")}
    assert 1 + b["r_H"] + b["r_I"] == pytest.approx(b["r_CO2"])
    r = w.first()
    assert r.r_N * r.r_H * r.r_I == pytest.approx(r.r_CO2) and r.gap_adj == 1 and r.n_ref_days == 70
    gaps = frames.select("unit", "date", F.lit(3.0).alias("hours_credited"), F.when(F.col("date") == day(70), 1.0).otherwise(0.0).alias("hours_discarded"))
    g = wt.window_factors(frames, evs.filter("unit = 'U00'"), unit="unit", day="date", gaps=gaps).first()
    assert g.discard_win == pytest.approx(1 / 7) and g.discard_ref == 0 and g.gap_adj == pytest.approx(7 / 6)
    assert wt.log_slope(w.limit(5), "r_CO2").first().b is None


def test_zero_activity_is_null_not_an_error(spark):
    z = np.zeros(150)
    r = wt.window_factors(factors_panel(spark, z, z, z), event(spark, 70, 71), unit="unit", day="date").first()
    assert r.r_N is None and r.r_CO2 is None and r.co2_shortfall_t == 0
