"""Calendars, event windows, baselines and normals on the daily activity panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewake.functions.dates import same_day_in_year
from tidewake.operators import calendar as cal, normal as nm, resample as rs, trend_fit, window_tests as wt
from tidewake.operators.sizing import checkpointed
from tidewake.plans import event_study as es
from . import standins as s
from .standins import draw_sql, rounded, sql

Q, SQL = {}, {}


def query(name, text=None):
    def keep(fn):
        Q[name] = fn
        if text:
            SQL[name] = text
        return fn
    return keep


BASE = (s.PANEL, s.DAILY, s.EVENT, s.DAYS)

# ---------------------------------------------------------------- calendars
COVERED10 = """cov10 AS (SELECT e.* FROM event e WHERE (SELECT count(*) FROM days WHERE date BETWEEN e."start" - 10 AND e."end" + 10) = (e."end" - e."start") + 21)"""
COVERED0 = """cov0 AS (SELECT e.* FROM event e WHERE (SELECT count(*) FROM days WHERE date BETWEEN e."start" AND e."end") = (e."end" - e."start") + 1)"""


@query("coverage_events", sql(*BASE, COVERED10, body='SELECT SID, unit, "start", "end" FROM cov10'))
def coverage_events(spark, d):
    return cal.covered_events(s.events(spark, d), s.daily(spark, d), "date", "start", "end", 10).select("SID", "unit", "start", "end")


@query("dense_panel", sql(*BASE, body="SELECT u.unit, d.date, round(coalesce(hours,0),2) AS hours, round(coalesce(co2_ton,0),6) AS co2_ton FROM (SELECT DISTINCT unit FROM daily) u CROSS JOIN days d LEFT JOIN daily USING (unit, date)"))
def dense_panel(spark, d):
    return rounded(cal.densify(s.daily(spark, d), "unit", "date", ["hours", "co2_ton"]), {"hours": 2, "co2_ton": 6})


ORDERED = "op AS (SELECT n_regionkey AS unit, CAST(o_orderdate AS DATE) AS date, count(DISTINCT o_custkey) AS vessels_present FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey GROUP BY ALL)"


def order_panel(spark, d):
    o = s.table(spark, d, "orders").join(s.table(spark, d, "customer"), F.expr("o_custkey = c_custkey")) \
        .join(s.table(spark, d, "nation"), F.expr("c_nationkey = n_nationkey"))
    return o.selectExpr("n_regionkey AS unit", "CAST(o_orderdate AS DATE) AS date", "o_custkey") \
        .groupBy("unit", "date").agg(F.count_distinct("o_custkey").alias("vessels_present"))


@query("matched_panel", sql(*BASE, ORDERED, body="""SELECT u.unit, c.date, coalesce(vessels_present,0)::DOUBLE AS vessels_present, round(coalesce(hours,0),2) AS hours, round(coalesce(co2_ton,0),6) AS co2_ton FROM
 (SELECT unit FROM daily INTERSECT SELECT unit FROM op) u CROSS JOIN (SELECT date FROM daily INTERSECT SELECT date FROM op) c LEFT JOIN op USING (unit, date) LEFT JOIN daily USING (unit, date)"""))
def matched_panel(spark, d):
    out = cal.matched_panel(order_panel(spark, d), ["vessels_present"], s.daily(spark, d), ["hours", "co2_ton"], "unit", "date")
    return rounded(out, {"hours": 2, "co2_ton": 6})


@query("calendar_difference", sql(*BASE, ORDERED, body="SELECT date, 'first' AS only_in FROM (SELECT date FROM op EXCEPT SELECT date FROM daily) UNION ALL SELECT date, 'second' FROM (SELECT date FROM daily EXCEPT SELECT date FROM op)"))
def calendar_difference(spark, d):
    return cal.calendar_difference(order_panel(spark, d), s.daily(spark, d), "date")


@query("event_panel_join", sql(*BASE, COVERED10, body="""SELECT SID, k.unit, k.date, round(coalesce(hours,0),2) AS hours FROM (SELECT SID, unit, CAST(unnest(generate_series("start" - 10, "end" + 10, INTERVAL 1 DAY)) AS DATE) AS date FROM cov10) k JOIN days ON k.date=days.date LEFT JOIN daily p ON p.unit=k.unit AND p.date=k.date"""))
def event_panel_join(spark, d):
    p = s.daily(spark, d)
    ev = cal.covered_events(s.events(spark, d), p, "date", "start", "end", 10)
    out = cal.attach_daily(cal.event_days(ev, "start", "end", 10, 10), p, "unit", "date", ["hours"])
    return rounded(out.select("SID", "unit", "date", "hours"), {"hours": 2})


@query("active_units", sql(*BASE, body="SELECT unit FROM daily GROUP BY unit HAVING sum(hours)/(SELECT count(*) FROM days) >= 0.95 * (SELECT sum(hours)/5.0/(SELECT count(*) FROM days) FROM daily)"))
def active_units(spark, d):
    p = s.daily(spark, d)
    n = p.select("date").distinct().count()
    floor = 0.95 * p.agg(F.sum("hours")).first()[0] / 5.0 / n
    return cal.units_with_floor(p, "unit", "date", "hours", floor)


# ---------------------------------------------------------------- baselines and curves
AROUND = """around_ AS (SELECT e.SID, e.unit, e."start", e."end", k.date, coalesce(hours,0) AS observed, (k.date < e."start" - 10 OR k.date > e."end" + 10) AS train
  FROM (SELECT SID, unit, "start", "end", CAST(unnest(generate_series("start" - 55, "end" + 55, INTERVAL 1 DAY)) AS DATE) AS date FROM cov10) k JOIN cov10 e USING (SID, unit) JOIN days ON k.date=days.date LEFT JOIN daily p ON p.unit=e.unit AND p.date=k.date),
arow AS (SELECT *, CASE WHEN lead(date) OVER w = date + 1 THEN lead(observed) OVER w END AS next_observed FROM around_ WINDOW w AS (PARTITION BY SID, unit ORDER BY date)),
fit AS (SELECT SID, unit, quantile_cont(observed,0.5) AS yhat, quantile_cont(observed,0.025) AS yhat_lower, quantile_cont(observed,0.975) AS yhat_upper FROM arow WHERE train GROUP BY SID, unit HAVING count(*)>=30 AND avg(observed)>=1e-9),
curve AS (SELECT a.*, yhat, yhat_lower, yhat_upper FROM arow a JOIN fit USING (SID, unit) WHERE NOT train)"""
CURVE = (*BASE, COVERED10, AROUND)


def curve(spark, d):
    return wt.local_baseline(s.daily(spark, d), s.events(spark, d).select("SID", "unit", "start", "end"), unit="unit", day="date", value="hours")


@query("local_baseline", sql(*CURVE, body="SELECT SID, unit, date, round(observed,2) AS observed, round(yhat,4) AS yhat, round(yhat_lower,4) AS yhat_lower, round(yhat_upper,4) AS yhat_upper FROM curve"))
def local_baseline(spark, d):
    return rounded(curve(spark, d).select("SID", "unit", "date", "observed", "yhat", "yhat_lower", "yhat_upper"), {"observed": 2, "yhat": 4, "yhat_lower": 4, "yhat_upper": 4})


def run_sql(flag):
    return f"""isl AS (SELECT SID, unit, "start", "end", min(date) AS rs, max(date) AS re, count(*) AS n FROM (SELECT *, date - CAST(row_number() OVER (PARTITION BY SID, unit ORDER BY date) AS INT) AS g FROM curve WHERE {flag}) GROUP BY SID, unit, "start", "end", g),
best AS (SELECT SID, unit, rs, re, n FROM (SELECT *, row_number() OVER (PARTITION BY SID, unit ORDER BY n DESC, rs) AS k FROM isl WHERE rs <= "end" AND re >= "start") WHERE k=1)"""


def disruption_sql(flag, measure, flat):
    return sql(*CURVE, run_sql(f"observed < {flag}"), f"""ins AS (SELECT c.*, rs, re, n, {measure} AS lo, CASE WHEN {measure}<>0 THEN least(observed/nullif({measure},0),1) END AS kept, next_observed-observed AS ch FROM curve c JOIN best USING (SID, unit) WHERE date BETWEEN rs AND re),
agg AS (SELECT SID, unit, min(rs) AS t_o, min(re) AS t_e, min(n) AS dd, max(CASE WHEN NOT coalesce(ch>0,false) THEN date END) AS ns, max(CASE WHEN NOT coalesce(ch>=0,false) THEN date END) AS nf, sum(CASE WHEN observed<=0 THEN 1 ELSE 0 END) AS dz,
 coalesce(sum(1-kept),0) AS ti, sum(CASE WHEN lo-observed>0 THEN lo-observed ELSE 0 END) AS tv, max(1-kept) AS mi FROM ins GROUP BY SID, unit),
rec AS (SELECT *, CASE WHEN ns IS NULL THEN t_o ELSE least(ns+1, t_e) END AS ss, CASE WHEN nf IS NULL THEN t_o ELSE least(nf+1, t_e) END AS sf FROM agg)""",
               body=f"""SELECT e.SID, e.unit, t_o AS t_initial_disruption, {'sf' if flat else 'ss'} AS t_start_recovery, t_e+1 AS t_end_disruption, CAST(coalesce(dd,0) AS BIGINT) AS disruption_days, CAST(coalesce(t_e+1-{'sf' if flat else 'ss'},0) AS BIGINT) AS recovery_days,
 CASE WHEN ss<t_e THEN 1 ELSE 0 END AS recovery_observed, CAST(coalesce(dz,0) AS BIGINT) AS days_at_zero, round(coalesce(ti,0),5) AS total_impact, round(coalesce(tv,0),3) AS total_impact_value, round(coalesce(mi,0),5) AS max_impact
 FROM (SELECT DISTINCT SID, unit FROM curve) e LEFT JOIN rec USING (SID, unit)""")


def disruption(preset):
    def run(spark, d):
        out = wt.disruption_metrics(checkpointed(curve(spark, d)), unit="unit", day="date", preset=preset)
        return rounded(out.drop("observed_in_window", "baseline_in_window"), {"total_impact": 5, "total_impact_value": 3, "max_impact": 5})
    return run


query("disruption_lower", disruption_sql("yhat_lower", "yhat_lower", False))(disruption("lower"))
query("disruption_published", disruption_sql("yhat_lower", "yhat", True))(disruption("published"))
query("disruption_center", disruption_sql("yhat", "yhat", False))(disruption("center"))


@query("excess_center", sql(*CURVE, run_sql("observed > yhat"), body="""SELECT e.SID, e.unit, coalesce(x.n,0) AS excess_days, round(coalesce(te,0),5) AS total_excess, round(coalesce(tv,0),3) AS total_excess_value FROM (SELECT DISTINCT SID, unit FROM curve) e LEFT JOIN
 (SELECT SID, unit, min(n) AS n, sum(CASE WHEN yhat<>0 AND observed/nullif(yhat,0)-1>0 THEN observed/nullif(yhat,0)-1 ELSE 0 END) AS te, sum(greatest(observed-yhat,0)) AS tv FROM curve JOIN best USING (SID, unit) WHERE date BETWEEN rs AND re GROUP BY SID, unit) x USING (SID, unit)"""))
def excess_center(spark, d):
    return rounded(wt.excess_metrics(checkpointed(curve(spark, d)), unit="unit", day="date", preset="center"), {"total_excess": 5, "total_excess_value": 3})


@query("fitted_baseline")
def fitted_baseline(spark, d):
    out = wt.fitted_baseline(s.daily(spark, d), s.events(spark, d).select("SID", "unit", "start", "end"), unit="unit", day="date", value="hours")
    return rounded(out.select("SID", "unit", "date", "observed", "yhat", "yhat_lower", "yhat_upper"), {"observed": 2, "yhat": 3, "yhat_lower": 3, "yhat_upper": 3})


TRAIN = """tr AS (SELECT e.SID, e.unit, date_diff('day', (SELECT min(date) FROM days), d.date)::DOUBLE AS t, coalesce(p.hours,0) AS y FROM cov10 e JOIN days d ON d.date < e."start" - 10 OR d.date > e."end" + 10 LEFT JOIN daily p ON p.unit=e.unit AND p.date=d.date)"""


@query("trend_fit_checks", sql(*BASE, COVERED10, TRAIN, body="""SELECT SID, unit, count(*) AS n_train, min(t) AS first_t, max(t) AS last_t, round(quantile_cont(t,0.8),4) AS within, round(2*max(y)+stddev_samp(y)+1,4) AS top,
 CAST(2 + least(floor((max(t)-min(t))/90),12) + CASE WHEN max(t)-min(t)>=28 THEN 6 ELSE 0 END + CASE WHEN max(t)-min(t)>=730 THEN 20 WHEN max(t)-min(t)>=365 THEN 6 ELSE 0 END AS INT) AS n_terms, 0.0::DOUBLE AS off_normal FROM tr GROUP BY SID, unit HAVING count(*)>=45 AND avg(y)>=1e-9"""))
def trend_fit_checks(spark, d):
    """The fit's training days and terms, and how far its residuals are from satisfying the normal equations."""
    fits = trend_fit.fit(s.daily(spark, d), s.events(spark, d).select("SID", "unit", "start", "end"), unit="unit", day="date", value="hours", mask=wt.MASK_DAYS, interval=wt.INTERVAL)
    out = fits.select("SID", "unit", F.col("n_train").cast("bigint").alias("n_train"), "first_t", "last_t", "within", "top", F.size("coefficients").alias("n_terms"), "off_normal")
    return rounded(out, {"within": 4, "top": 4, "off_normal": 6})


# coefficients as if published: a level near the mean, then small numbers
GIVEN = "concat(array(2D), transform(sequence(1, 39), i -> CAST((SID * 7 + i * 13) % 11 - 5 AS DOUBLE) / (10 + i)))"
CURVES = """gf AS (SELECT SID, unit, min(t) AS t0, max(t) AS t1, quantile_cont(t,0.8) AS within, 2*max(y)+stddev_samp(y)+1 AS top FROM tr GROUP BY SID, unit HAVING count(*)>=45 AND avg(y)>=1e-9),
gl AS (SELECT *, t1-t0 AS len, CAST(least(floor((t1-t0)/90),12) AS INT) AS nh, CASE WHEN t1-t0>=28 THEN 3 ELSE 0 END AS nw, CASE WHEN t1-t0>=730 THEN 10 WHEN t1-t0>=365 THEN 3 ELSE 0 END AS ny,
  list_concat([2.0::DOUBLE], [((SID*7+i*13) % 11 - 5)/(10.0::DOUBLE+i) for i in range(1,40)]) AS c FROM gf),
ad AS (SELECT e.SID, e.unit, d.date, date_diff('day', (SELECT min(date) FROM days), d.date)::DOUBLE AS t, coalesce(p.hours,0) AS y, d.date BETWEEN e."start" - 10 AND e."end" + 10 AS masked FROM cov10 e CROSS JOIN days d LEFT JOIN daily p ON p.unit=e.unit AND p.date=d.date),
fx AS (SELECT ad.*, top, c, list_concat([1.0::DOUBLE, t/greatest(len,1)], [greatest(t-t0-(within-t0)*k/(nh+1),0)/greatest(len,1) for k in range(1,nh+1)], [sin(2*pi()/7*t*k) for k in range(1,nw+1)], [cos(2*pi()/7*t*k) for k in range(1,nw+1)],
  [sin(2*pi()/365.25::DOUBLE*t*k) for k in range(1,ny+1)], [cos(2*pi()/365.25::DOUBLE*t*k) for k in range(1,ny+1)]) AS x FROM ad JOIN gl USING (SID, unit)),
fy AS (SELECT SID, unit, date, y, masked, top, list_dot_product(x, c[1:len(x)]) AS m FROM fx),
fr AS (SELECT SID, unit, quantile_cont(y-m,0.025) AS lo, quantile_cont(y-m,0.975) AS hi FROM fy WHERE NOT masked GROUP BY SID, unit)"""


@query("given_baseline", sql(*BASE, COVERED10, TRAIN, CURVES, body="""SELECT SID, unit, date, round(y,2) AS observed, round(greatest(least(m,top),0),3) AS yhat, round(greatest(least(m+lo,top),0),3) AS yhat_lower, round(greatest(least(m+hi,top),0),3) AS yhat_upper
 FROM fy JOIN fr USING (SID, unit) WHERE masked"""))
def given_baseline(spark, d):
    """Curves and bounds from given coefficients."""
    ev = s.events(spark, d).select("SID", "unit", "start", "end").withColumn("given", F.expr(GIVEN))
    out = wt.fitted_baseline(s.daily(spark, d), ev, unit="unit", day="date", value="hours", coefficients="given")
    return rounded(out.select("SID", "unit", "date", "observed", "yhat", "yhat_lower", "yhat_upper"), {"observed": 2, "yhat": 3, "yhat_lower": 3, "yhat_upper": 3})


RANK = """wr AS (SELECT e.SID, e.unit, e."start", e."end", e.k_days, k.date, coalesce(hours,0) AS v, row_number() OVER (PARTITION BY e.SID, e.unit ORDER BY k.date) AS i FROM (SELECT SID, unit, CAST(unnest(generate_series("start" - 45, "end" + 45, INTERVAL 1 DAY)) AS DATE) AS date FROM cov0) k
  JOIN cov0 e USING (SID, unit) JOIN days ON k.date=days.date LEFT JOIN daily p ON p.unit=e.unit AND p.date=k.date),
win AS (SELECT a.SID, a.unit, a."start", a."end", a.k_days, a.date AS d0, avg(b.v) AS m FROM wr a JOIN wr b ON a.SID=b.SID AND a.unit=b.unit AND b.i BETWEEN a.i AND a.i + a.k_days - 1 GROUP BY ALL HAVING count(*)=a.k_days),
ob AS (SELECT SID, unit, avg(v) AS o FROM wr WHERE date BETWEEN "start" AND "end" GROUP BY SID, unit),
rf AS (SELECT w.*, o FROM win w JOIN ob USING (SID, unit) WHERE d0 + CAST(k_days AS INT) - 1 < "start" - 10 OR d0 > "end" + 10)"""


@query("window_rank", sql(*BASE, COVERED0, RANK, body="""SELECT SID, unit, k_days, round(any_value(o),4) AS obs_mean, count(*) AS n_ref, round(quantile_cont(m,0.5),4) AS ref_median, round(quantile_cont(m,0.05),4) AS ref_p05, round(quantile_cont(m,0.95),4) AS ref_p95,
 round(CASE WHEN quantile_cont(m,0.5)>0 THEN any_value(o)/quantile_cont(m,0.5) END,5) AS ratio, round(CASE WHEN stddev_samp(m)>0 THEN (any_value(o)-quantile_cont(m,0.5))/stddev_samp(m) END,5) AS z, round((sum(CASE WHEN round(m,9)<=round(o,9) THEN 1 ELSE 0 END)+1)/(count(*)+1),6) AS p_lower, round((sum(CASE WHEN round(m,9)>=round(o,9) THEN 1 ELSE 0 END)+1)/(count(*)+1),6) AS p_upper
 FROM rf GROUP BY SID, unit, k_days HAVING count(*)>=20"""))
def window_rank(spark, d):
    out = wt.window_rank(s.daily(spark, d), s.events(spark, d), unit="unit", day="date", value="hours")
    return rounded(out.drop("sig_drop", "sig_rise"), {"obs_mean": 4, "ref_median": 4, "ref_p05": 4, "ref_p95": 4, "ratio": 5, "z": 5, "p_lower": 6, "p_upper": 6})


# ---------------------------------------------------------------- activity factors
def factor_panel(spark, d):
    return s.panel(spark, d).groupBy("unit", "date").agg(
        F.sum("calls").cast("double").alias("vessels_present"), F.sum("hours").alias("hours"), F.sum("co2_ton").alias("co2_ton"))


def gap_days(spark, d):
    """Hours credited and thrown away per unit-day, missing on days without boiler fuel."""
    return s.panel(spark, d).filter("fc_boiler_ton > 0").selectExpr("unit", "date", "hours AS hours_credited", "fc_boiler_ton AS hours_discarded")


def factors_sql(ev):
    return f"""fr AS (SELECT e.SID, e.unit, e.storm, e.dist, e.wind, k.date, CASE WHEN k.date BETWEEN e."start" AND e."end" THEN 'o' WHEN k.date < e."start" - 10 OR k.date > e."end" + 10 THEN 'r' END AS role, coalesce(calls,0)::DOUBLE AS n, coalesce(hours,0) AS h, coalesce(co2_ton,0) AS c
  FROM (SELECT SID, unit, CAST(unnest(generate_series("start" - 45, "end" + 45, INTERVAL 1 DAY)) AS DATE) AS date FROM {ev}) k JOIN {ev} e USING (SID, unit) JOIN days ON k.date=days.date LEFT JOIN daily p ON p.unit=e.unit AND p.date=k.date),
fs AS (SELECT SID, unit, storm, dist, wind, count(*) FILTER (role='o') AS ko, count(*) FILTER (role='r') AS kr, sum(CASE WHEN role='o' THEN n ELSE 0 END) AS no_, sum(CASE WHEN role='o' THEN h ELSE 0 END) AS ho, sum(CASE WHEN role='o' THEN c ELSE 0 END) AS co,
  sum(CASE WHEN role='r' THEN n ELSE 0 END) AS nr, sum(CASE WHEN role='r' THEN h ELSE 0 END) AS hr, sum(CASE WHEN role='r' THEN c ELSE 0 END) AS cr FROM fr GROUP BY SID, unit, storm, dist, wind HAVING kr >= 20),
gp AS (SELECT unit, date, sum(hours) AS gc, sum(fc_boiler_ton) AS gx FROM panel WHERE fc_boiler_ton > 0 GROUP BY unit, date),
gd AS (SELECT SID, unit, sum(CASE WHEN role='o' THEN gx END)/nullif(sum(CASE WHEN role='o' THEN gc+gx END),0) AS dw, sum(CASE WHEN role='r' THEN gx END)/nullif(sum(CASE WHEN role='r' THEN gc+gx END),0) AS dr FROM fr JOIN gp USING (unit, date) WHERE role IS NOT NULL GROUP BY SID, unit),
fac AS (SELECT SID, unit, storm, dist, wind, ko AS k_days, kr AS n_ref_days, no_/ko AS N_obs, nr/kr AS N_ref, co AS co2_obs_t, cr/kr*ko AS co2_ref_t, CASE WHEN nr>0 THEN (no_/ko)/(nr/kr) END AS r_N,
  CASE WHEN nr>0 AND hr>0 AND no_>0 THEN (ho/no_)/(hr/nr) END AS r_H, CASE WHEN hr>0 AND cr>0 AND ho>0 THEN (co/ho)/(cr/hr) END AS r_I, CASE WHEN cr>0 THEN (co/ko)/(cr/kr) END AS r_CO2, CASE WHEN dw IS NOT NULL AND dr IS NOT NULL THEN (1-dr)/nullif(1-dw,0) ELSE 1 END AS gap_adj
  FROM fs LEFT JOIN gd USING (SID, unit))"""


def factors(spark, d, gaps=True):
    return wt.window_factors(factor_panel(spark, d), s.events(spark, d), unit="unit", day="date", keep=("storm", "dist", "wind"),
                             gaps=gap_days(spark, d) if gaps else None)


FAC = (*BASE, COVERED0, factors_sql("cov0"))


@query("window_elasticity", sql(*FAC, body="SELECT SID, unit, k_days, n_ref_days, round(N_obs,5) AS n_obs, round(N_ref,5) AS n_ref, round(co2_obs_t,3) AS co2_obs_t, round(co2_ref_t,3) AS co2_ref_t, round(r_N,6) AS r_n, round(r_H,6) AS r_h, round(r_I,6) AS r_i, round(r_CO2,6) AS r_co2, round(gap_adj,6) AS gap_adj, round(co2_ref_t-co2_obs_t,3) AS co2_shortfall_t FROM fac"))
def window_elasticity(spark, d):
    out = factors(spark, d).select("SID", "unit", "k_days", "n_ref_days", F.col("N_obs").alias("n_obs"), F.col("N_ref").alias("n_ref"), "co2_obs_t", "co2_ref_t",
                                   F.col("r_N").alias("r_n"), F.col("r_H").alias("r_h"), F.col("r_I").alias("r_i"), F.col("r_CO2").alias("r_co2"), "gap_adj", "co2_shortfall_t")
    return rounded(out, {"n_obs": 5, "n_ref": 5, "co2_obs_t": 3, "co2_ref_t": 3, "r_n": 6, "r_h": 6, "r_i": 6, "r_co2": 6, "gap_adj": 6, "co2_shortfall_t": 3})


def slope_sql(col):
    return f"SELECT '{col.lower()}' AS factor, count(*) AS n, round(CASE WHEN count(*)>=10 THEN regr_slope(ln({col}), ln(r_N)) END,6) AS b FROM fac WHERE r_N>0 AND {col}>0"


@query("elasticity_slope", sql(*FAC, body=" UNION ALL ".join(slope_sql(c) for c in ("r_CO2", "r_H", "r_I"))))
def elasticity_slope(spark, d):
    f = factors(spark, d, gaps=False)
    long = f.select("r_N", "r_CO2", "r_H", "r_I").unpivot(["r_N"], ["r_CO2", "r_H", "r_I"], "factor", "y")
    return rounded(wt.log_slope(long, "y", ["factor"]).withColumn("factor", F.lower("factor")), {"b": 6})


def boot_sql(source, group, cluster, sums, stats, draws, seed, min_clusters=2, extra_where=""):
    """Replicates of cluster sums as SQL: group and cluster are column names ('' = one group)."""
    g = f"{group}, " if group else ""
    pg = f"PARTITION BY {group} " if group else ""
    on = " AND ".join([*(f"s.{c.strip()}=p.{c.strip()}" for c in group.split(",") if c.strip()), "s.i=p.i"])
    gs = "".join(f"s.{c.strip()}, " for c in group.split(",") if c.strip())
    agg = ", ".join(f"sum({e}) AS {n}" for n, e in sums.items())
    resum = ", ".join(f"sum({n}) AS {n}" for n in sums)
    quant = ", ".join(f"quantile_cont({n},0.025) AS {n}_lo, quantile_cont({n},0.975) AS {n}_hi" for n in stats)
    calc = ", ".join(f"{e} AS {n}" for n, e in stats.items())
    return f"""cs AS (SELECT {g}{cluster} AS cl, {agg} FROM {source} {extra_where} GROUP BY {g}{cluster}),
ci AS (SELECT *, row_number() OVER ({pg}ORDER BY md5(CAST(cl AS VARCHAR)), cl) - 1 AS i FROM cs),
ct AS (SELECT {g}count(*) AS n_clusters, {resum} FROM cs {('GROUP BY ' + group) if group else ''}),
sl AS (SELECT {g}draw, {draw_sql('draw', 'slot', 'n_clusters', seed)} AS i FROM (SELECT {g}n_clusters, draw, unnest(range(0, n_clusters)) AS slot FROM ct, range(1, {draws + 1}) r(draw) WHERE n_clusters >= {min_clusters})),
dr AS (SELECT {gs}draw, {', '.join(f'sum(p.{n}) AS {n}' for n in sums)} FROM sl s JOIN ci p ON {on} GROUP BY {gs}draw),
bs AS (SELECT {g}{quant} FROM (SELECT {g}{calc} FROM dr) {('GROUP BY ' + group) if group else ''}),
es AS (SELECT {g}n_clusters, {calc} FROM ct),
bt AS (SELECT * FROM es {('LEFT JOIN bs USING (' + group + ')') if group else ', bs'})"""


SLOPE_E = "CASE WHEN n1 > 20 AND n1*sxx-sx*sx > 1e-9 THEN (n1*sxy-sx*sy)/(n1*sxx-sx*sx) END"


@query("elasticity_slope_ci", sql(*FAC, "lp AS (SELECT storm, ln(r_N) AS x, ln(r_CO2) AS y FROM fac WHERE r_N>0 AND r_CO2>0)",
       boot_sql("lp", "", "storm", {"n1": "1", "sx": "x", "sy": "y", "sxy": "x*y", "sxx": "x*x"}, {"slope": SLOPE_E}, 2000, 20260913),
       body="SELECT n_clusters, round(slope,5) AS slope, round(slope_lo,5) AS slope_lo, round(slope_hi,5) AS slope_hi FROM bt"))
def elasticity_slope_ci(spark, d):
    pairs = wt.log_pairs(factors(spark, d, gaps=False), "r_CO2")
    return rounded(rs.boot_slope(pairs, [], "storm", draws=2000), {"slope": 5, "slope_lo": 5, "slope_hi": 5})


SHIFTS = [("-2y", -730), ("-1y", -365), ("-60d", -60), ("-30d", -30), ("+30d", 30), ("+60d", 60), ("+1y", 365), ("+2y", 730)]
SHIFTED = "sh AS (SELECT e.* REPLACE (e.\"start\" + sd AS \"start\", e.\"end\" + sd AS \"end\", label || '/' || SID AS SID), label FROM event e, (VALUES " + ",".join(f"('{n}',{d_})" for n, d_ in SHIFTS) + """) t(label, sd) WHERE e."start" + sd >= (SELECT min(date) FROM days) + 60 AND e."end" + sd <= (SELECT max(date) FROM days) - 60),
csh AS (SELECT e.* FROM sh e WHERE (SELECT count(*) FROM days WHERE date BETWEEN e."start" AND e."end") = (e."end" - e."start") + 1)"""


def shifted_factors(spark, d):
    p = factor_panel(spark, d)
    lo, hi = cal.span(p, "date")
    moved = cal.shift_events(s.events(spark, d), "start", "end", SHIFTS, F.date_add(lo, 60), F.date_sub(hi, 60))
    moved = moved.withColumn("SID", F.concat_ws("/", F.col("shift"), F.col("SID").cast("string")))
    return wt.window_factors(p, moved, unit="unit", day="date", keep=("storm", "dist", "wind", "shift"))


@query("placebo_shift", sql(*BASE, SHIFTED, factors_sql("csh"), body="SELECT split_part(SID,'/',1) AS shift, count(*) FILTER (r_N>0 AND r_CO2>0) AS n, round(CASE WHEN count(*) FILTER (r_N>0 AND r_CO2>0)>=10 THEN regr_slope(ln(r_CO2), ln(r_N)) FILTER (r_N>0 AND r_CO2>0) END,6) AS b FROM fac GROUP BY 1"))
def placebo_shift(spark, d):
    return rounded(wt.log_slope(shifted_factors(spark, d), "r_CO2", ["shift"]), {"b": 6})


@query("placebo_verdict", sql(*BASE, COVERED0, SHIFTED, factors_sql("csh").replace("fr AS", "fr2 AS").replace("fs AS", "fs2 AS").replace("gp AS", "gp2 AS").replace("gd AS", "gd2 AS").replace("fac AS", "fac2 AS").replace("FROM fr GROUP", "FROM fr2 GROUP").replace("FROM fr JOIN gp", "FROM fr2 JOIN gp2").replace("FROM fs LEFT JOIN gd", "FROM fs2 LEFT JOIN gd2"), factors_sql("cov0"),
       """pb AS (SELECT split_part(SID,'/',1) AS shift, CASE WHEN count(*) FILTER (r_N>0 AND r_CO2>0)>=10 THEN regr_slope(ln(r_CO2), ln(r_N)) FILTER (r_N>0 AND r_CO2>0) END AS b FROM fac2 GROUP BY 1), rb AS (SELECT CASE WHEN count(*) FILTER (r_N>0 AND r_CO2>0)>=10 THEN regr_slope(ln(r_CO2), ln(r_N)) FILTER (r_N>0 AND r_CO2>0) END AS b FROM fac)""",
       body="SELECT round(rb.b,6) AS b, round(min(pb.b),6) AS placebo_lo, round(max(pb.b),6) AS placebo_hi, count(pb.b) AS n_shifts, CASE WHEN rb.b>max(pb.b) THEN 'above' WHEN rb.b<min(pb.b) THEN 'below' ELSE 'inside' END AS verdict FROM rb, pb GROUP BY rb.b"))
def placebo_verdict(spark, d):
    real = wt.log_slope(factors(spark, d, gaps=False), "r_CO2")
    out = wt.placebo_verdict(real, wt.log_slope(shifted_factors(spark, d), "r_CO2", ["shift"]))
    return rounded(out, {"b": 6, "placebo_lo": 6, "placebo_hi": 6})


@query("factor_medians", sql(*FAC, body="""SELECT level, count(*) AS n_rows, round(quantile_cont(r_CO2,0.5),6) AS median_co2, round(quantile_cont(r_N,0.5),6) AS median_n, round(quantile_cont(r_H,0.5),6) AS median_h, round(quantile_cont(r_I,0.5),6) AS median_i FROM
 (SELECT *, CASE WHEN dist>0 AND dist<=100 THEN '0-100 km' WHEN dist>100 AND dist<=200 THEN '100-200 km' WHEN dist>200 AND dist<=300 THEN '200-300 km' WHEN dist>300 AND dist<=400 THEN '300-400 km' WHEN dist>400 AND dist<=500 THEN '400-500 km' END AS level FROM fac) WHERE level IS NOT NULL GROUP BY level"""))
def factor_medians(spark, d):
    out = wt.factor_medians(checkpointed(factors(spark, d, gaps=False)), wt.distance_bin("dist"))
    return rounded(out, {c: 6 for c in ("median_co2", "median_n", "median_h", "median_i")})


@query("shortfall_totals", sql(*FAC, body="SELECT unit, count(*) AS n, round(sum(co2_ref_t-co2_obs_t),2) AS net, round(sum(greatest(co2_ref_t-co2_obs_t,0)),2) AS suppressed, round(sum(greatest(co2_obs_t-co2_ref_t,0)),2) AS raised, round(sum((1-r_N)*co2_ref_t),2) AS traffic_scaled FROM fac GROUP BY unit"))
def shortfall_totals(spark, d):
    return rounded(wt.shortfall_totals(factors(spark, d, gaps=False), ["unit"]), {c: 2 for c in ("net", "suppressed", "raised", "traffic_scaled")})


# ---------------------------------------------------------------- the normal
ROLLUP = """long AS (SELECT unit, date, vclass, tier, unnest([{'m':'hours','v':hours},{'m':'co2_ton','v':co2_ton}], recursive := true) FROM panel),
series AS (SELECT unit, date, m AS measure, coalesce(vclass,'all') AS vclass, coalesce(tier,'total') AS tier, sum(v) AS value FROM long GROUP BY GROUPING SETS ((unit,date,m,vclass,tier),(unit,date,m,vclass),(unit,date,m,tier),(unit,date,m)))"""


def series(spark, d, values=("hours", "co2_ton")):
    p = s.panel(spark, d)
    return nm.rollup_series(p.select("unit", "date", "vclass", "tier", *values), ["unit", "date"], {"vclass": "all", "tier": "total"}, list(values))


@query("series_rollup", sql(s.PANEL, ROLLUP, body="SELECT unit, date, vclass, tier, measure, round(value,6) AS value FROM series"))
def series_rollup(spark, d):
    return rounded(series(spark, d), {"value": 6})


@query("tier_series", sql(s.PANEL, body="""SELECT unit, date, coalesce(tier,'total') AS tier, 'co2_ton' AS measure, round(sum(co2_ton),6) AS value FROM panel GROUP BY GROUPING SETS ((unit,date,tier),(unit,date))
 UNION ALL SELECT unit, date, tier, 'calls', CAST(sum(calls) AS DOUBLE) FROM panel GROUP BY unit, date, tier"""))
def tier_series(spark, d):
    out = nm.tier_series(s.panel(spark, d).withColumn("calls", F.col("calls").cast("double")), ["unit", "date"], "tier", ["co2_ton"], ["calls"])
    return rounded(out, {"value": 6})


def shift_sql(expr, year):
    return (f"CASE WHEN month({expr})=2 AND day({expr})=29 AND NOT (({year})%4=0) THEN NULL ELSE make_date(({year})::BIGINT, month({expr}), day({expr})) END")


@query("same_day_in_year", "WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS dt FROM orders) SELECT o_orderkey, y, " + shift_sql("dt", "y") + " AS shifted FROM o, (VALUES (1996),(1999),(2000)) t(y)")
def same_day(spark, d):
    o = s.table(spark, d, "orders").selectExpr("o_orderkey", "CAST(o_orderdate AS DATE) AS dt").withColumn("y", F.explode(F.array(F.lit(1996), F.lit(1999), F.lit(2000))))
    return o.select("o_orderkey", "y", same_day_in_year("dt", "y").alias("shifted"))


def base_sql(excl=250, min_base=3):
    return f"""sel AS (SELECT * FROM event WHERE dist <= 200 AND wind >= 34),
span AS (SELECT min(date) AS d0, max(date) AS d1 FROM days),
cand AS (SELECT e.SID, e.unit, y, {shift_sql('e."start" - 60', 'y')} AS a, {shift_sql('e."end" + 45', 'y')} AS b FROM sel e, span, range(1900, 2101) r(y) WHERE y BETWEEN year(d0) AND year(d1) AND y <> year(e."start")),
free AS (SELECT SID, unit, y FROM cand c, span WHERE a IS NOT NULL AND b IS NOT NULL AND a >= d0 AND b <= d1 AND NOT EXISTS (SELECT 1 FROM event x WHERE x.unit=c.unit AND x.dist <= {excl} AND x."end" >= c.a AND x."start" <= c.b)),
scored AS (SELECT s.* FROM sel s WHERE (SELECT count(*) FROM free f WHERE f.SID=s.SID AND f.unit=s.unit) >= {min_base} AND s."start" - 60 >= (SELECT d0 FROM span) AND s."end" + 45 <= (SELECT d1 FROM span))"""


def bounds(spark, d):
    """First and last day of the panel, and the years they lie in."""
    first, last = cal.panel_bounds(s.table(spark, d, "lineitem"), "l_shipdate")
    return first, last, (first.year, last.year)


def based(spark, d, o):
    ev = s.events(spark, d)
    first, last, years = bounds(spark, d)
    near = ev.filter(F.col("dist") <= o["excl_km"])
    chosen = nm.select_events(ev, o)
    return cal.baseline_years(chosen, near, unit="unit", start="start", end="end", x_start="start", x_end="end", years=years, pre=o["pre"], post=o["post"], covered=(first, last))


@query("baseline_years", sql(s.PANEL, s.DAYS, s.EVENT, base_sql(), body="SELECT s.SID, s.unit, count(y) AS n_base, coalesce(string_agg(CAST(y AS VARCHAR), ',' ORDER BY y),'') AS base FROM sel s LEFT JOIN free f ON s.SID=f.SID AND s.unit=f.unit GROUP BY s.SID, s.unit"))
def baseline_years(spark, d):
    return based(spark, d, nm.options()).select("SID", "unit", F.size("base").cast("bigint").alias("n_base"), F.array_join(F.transform("base", lambda y: y.cast("string")), ",").alias("base"))


def normal_sql(ref=(45, 11), pool=3, stat="quantile_cont(b.x,0.5)", source="scored", base="free", flat=False):
    """Long-form normal: one row per event, day and series, every year and offset spelled out."""
    return f"""tot AS (SELECT unit, date, tier, value FROM series WHERE measure='co2_ton' AND vclass='all'),
ev2 AS (SELECT SID, unit, "start", "end", k_days, ("end"-"start")+1+105 AS nd, "start"-60 AS lo, tier FROM {source} JOIN (SELECT DISTINCT unit, tier FROM tot) USING (unit)),
lev AS (SELECT e.SID, e.unit, e.tier, y, coalesce(sum(t.value),0)/any_value(({shift_sql(f'e."start" - {ref[1]}', 'y')})-({shift_sql(f'e."start" - {ref[0]}', 'y')})+1) AS level FROM ev2 e JOIN (SELECT SID, unit, y FROM {base} UNION ALL SELECT SID, unit, year("start") FROM {source}) b USING (SID, unit)
  LEFT JOIN tot t ON t.unit=e.unit AND t.tier=e.tier AND t.date BETWEEN ({shift_sql(f'e."start" - {ref[0]}', 'y')}) AND ({shift_sql(f'e."start" - {ref[1]}', 'y')}) GROUP BY ALL),
grid AS (SELECT e.*, y, level, unnest(range(0, nd)) AS i FROM ev2 e JOIN lev USING (SID, unit, tier)),
idx AS (SELECT g.*, coalesce(t.value,0) AS v, CASE WHEN level>0 THEN coalesce(t.value,0)/level END AS x FROM grid g LEFT JOIN tot t ON t.unit=g.unit AND t.tier=g.tier AND t.date = ({shift_sql('g.lo', 'y')}) + CAST(g.i AS INT)),
own AS (SELECT * FROM idx WHERE y = year("start")),
pool AS (SELECT o.SID, o.unit, o.tier, o.i, {stat} AS med FROM own o JOIN (VALUES {','.join(f'({k})' for k in range(-pool, pool + 1))}) p(off) ON true
  JOIN idx b ON b.SID=o.SID AND b.unit=o.unit AND b.tier=o.tier AND b.y<>o.y AND b.i = least(greatest(o.i+off,0), o.nd-1) WHERE b.x IS NOT NULL GROUP BY ALL),
{"fl AS (SELECT e.SID, e.unit, e.tier, coalesce(sum(t.value),0)/70 AS lv FROM ev2 e LEFT JOIN tot t ON t.unit=e.unit AND t.tier=e.tier AND (t.date BETWEEN e.start-45 AND e.start-11 OR t.date BETWEEN e.end+11 AND e.end+45) GROUP BY ALL),".replace("e.start", 'e."start"').replace("e.end", 'e."end"') if flat else ""}
day_ AS (SELECT o.SID, o.unit, o.tier, o.k_days, o.i - 60 AS rel_day, o.v AS obs, {"1.0 AS med, lv AS expected FROM own o JOIN fl USING (SID, unit, tier)" if flat else "med, med*level AS expected FROM own o LEFT JOIN pool USING (SID, unit, tier, i)"}),
ph AS (SELECT *, CASE WHEN rel_day BETWEEN -2 AND -1 THEN 'prep' WHEN rel_day BETWEEN 0 AND k_days-1 THEN 'storm' WHEN rel_day BETWEEN k_days AND k_days+9 THEN 'after' END AS phase FROM day_),
yr AS (SELECT b.SID, b.unit, b.tier, b.y, p.phase, avg(b.x) AS mx, count(b.x)=count(*) AS full_ FROM idx b JOIN ph p ON b.SID=p.SID AND b.unit=p.unit AND b.tier=p.tier AND b.i-60=p.rel_day WHERE b.y<>year(b."start") AND phase IS NOT NULL GROUP BY ALL),
pm AS (SELECT SID, unit, tier, phase, sum(obs) AS obs, sum(expected) AS expected, avg(med) AS mm FROM ph WHERE phase IS NOT NULL GROUP BY ALL HAVING count(expected)=count(*) AND sum(expected)>0),
sc AS (SELECT pm.*, min(mx/nullif(mm,0)) FILTER (full_) AS lo_, max(mx/nullif(mm,0)) FILTER (full_) AS hi_ FROM pm LEFT JOIN yr USING (SID, unit, tier, phase) GROUP BY ALL)"""


def scored_rows(spark, d, scores, **changes):
    o = nm.options(**{"min_co2": 0.0, **changes})
    first, last, _ = bounds(spark, d)
    tier = nm.rollup_series(s.panel(spark, d).select("unit", "date", "tier", "co2_ton"), ["unit", "date"], {"tier": "total"}, ["co2_ton"])
    arrays = nm.series_arrays(tier, ["unit", "tier"], "date", "value", first, last)
    ev = based(spark, d, o)
    floor = arrays.filter("tier = 'total'")
    return nm.by_window(nm.active_events(ev, floor, o, first), lambda w: scores(nm.normal_arrays(w, arrays, o, first), o))


SCORE = "SELECT SID, unit, tier, phase, round(obs,6) AS obs, round(expected,4) AS expected, round(obs/expected,5) AS ratio, coalesce(obs/expected < lo_ OR obs/expected > hi_, false) AS outside FROM sc"


def phases(spark, d, **changes):
    return rounded(scored_rows(spark, d, nm.phase_scores, **changes).select("SID", "unit", "tier", "phase", "obs", "expected", "ratio", "outside"), {"obs": 6, "expected": 4, "ratio": 5})


NORMAL = (s.PANEL, s.DAYS, s.EVENT, ROLLUP)


@query("seasonal_normal", sql(*NORMAL, base_sql(), normal_sql(), body=SCORE))
def seasonal_normal(spark, d):
    return phases(spark, d)


@query("alt_normal_mean", sql(*NORMAL, base_sql(), normal_sql(stat="avg(b.x)"), body=SCORE))
def alt_normal_mean(spark, d):
    return phases(spark, d, stat="mean")


@query("alt_normal_wide", sql(*NORMAL, base_sql(excl=400, min_base=2), normal_sql(ref=(60, 11), pool=0), body=SCORE))
def alt_normal_wide(spark, d):
    return phases(spark, d, ref=(60, 11), pool=0, excl_km=400, min_base=2)


@query("same_year_normal", sql(*NORMAL, base_sql(), """tot AS (SELECT unit, date, tier, value FROM series WHERE measure='co2_ton' AND vclass='all'),
fl AS (SELECT s.SID, s.unit, u.tier, coalesce(sum(t.value),0)/70 AS lv FROM scored s JOIN (SELECT DISTINCT unit, tier FROM tot) u USING (unit) LEFT JOIN tot t ON t.unit=s.unit AND t.tier=u.tier AND (t.date BETWEEN s."start"-45 AND s."start"-11 OR t.date BETWEEN s."end"+11 AND s."end"+45) GROUP BY ALL)""",
       body="""SELECT s.SID, s.unit, f.tier, round(coalesce((SELECT sum(value) FROM tot t WHERE t.unit=s.unit AND t.tier=f.tier AND t.date BETWEEN s."start" AND s."end"),0),6) AS obs, round(lv*k_days,4) AS expected FROM scored s JOIN fl f USING (SID, unit) WHERE lv>0"""))
def same_year_normal(spark, d):
    out = scored_rows(spark, d, nm.phase_scores, normal="same_year").filter("phase = 'storm'").select("SID", "unit", "tier", "obs", "expected")
    return rounded(out, {"obs": 6, "expected": 4})


@query("normal_daily", sql(*NORMAL, base_sql(), normal_sql(), body="SELECT SID, unit, tier, k_days, rel_day, round(obs,6) AS obs, round(expected,4) AS expected FROM day_ WHERE rel_day BETWEEN -2 AND k_days-1+45"))
def normal_daily(spark, d):
    out = scored_rows(spark, d, nm.daily_scores).select("SID", "unit", "tier", "k_days", "rel_day", "obs", "expected")
    return rounded(out, {"obs": 6, "expected": 4})


def floored(floor, ref=(45, 11)):
    """Events whose total is at least `floor` a day in their own reference window."""
    return f"""act AS (SELECT s.* FROM scored s WHERE (SELECT coalesce(sum(t.value),0) FROM series t WHERE t.measure='co2_ton' AND t.vclass='all' AND t.tier='total' AND t.unit=s.unit AND t.date BETWEEN s."start" - {ref[0]} AND s."start" - {ref[1]})/{ref[0] - ref[1] + 1} >= {floor})"""


FLOOR = 110.0
MEAN_STAT = "avg(b.x)"
VARIANT_SQL = {"default": ({}, {}), "reference [-60,-11]": ({}, dict(ref=(60, 11))), "reference [-30,-8]": ({}, dict(ref=(30, 8))), "no day pooling": ({}, dict(pool=0)), "pool 7 days": ({}, dict(pool=7)),
               "mean not median": ({}, dict(stat=MEAN_STAT)), "exclusion 150 km": (dict(excl=150), {}), "exclusion 400 km": (dict(excl=400), {}), "at least 4 baseline years": (dict(min_base=4), {}), "same-year flat": ({}, dict(flat=True))}
VARIANT_PARTS = ["SELECT '" + name + "' AS variant, * FROM (" + sql(base_sql(**b), floored(FLOOR, n.get("ref", (45, 11))), normal_sql(source="act", **n), body=SCORE.replace("round(expected,4)", "round(expected,2)")) + ")" for name, (b, n) in VARIANT_SQL.items()]


@query("normal_variants", sql(*NORMAL[:3], ROLLUP.replace("series AS (", "series AS MATERIALIZED ("), body=" UNION ALL ".join(VARIANT_PARTS)))
def normal_variants(spark, d):
    """All ten normals with the activity floor on, in one plan."""
    first, last, years = bounds(spark, d)
    long = nm.rollup_series(s.panel(spark, d).select("unit", "date", "tier", "co2_ton"), ["unit", "date"], {"tier": "total"}, ["co2_ton"]).withColumn("vclass", F.lit("all"))
    ex = s.events(spark, d).withColumnsRenamed({"start": "exposure_start", "end": "exposure_end"}).withColumn("wind_at_closest", F.col("wind"))
    out = es.variants(long, ex, None, first=first, last=last, years=years, opts={"min_co2": FLOOR})
    return rounded(out.select("variant", "SID", "unit", "tier", "phase", "obs", "expected", "ratio", "outside"), {"obs": 6, "expected": 2, "ratio": 5})


PLACEBO = f"""plc AS (SELECT s.SID || '/' || f.y AS SID, s.unit, {shift_sql('s."start"', 'f.y')} AS "start", {shift_sql('s."end"', 'f.y')} AS "end", s.k_days FROM scored s JOIN free f ON s.SID=f.SID AND s.unit=f.unit WHERE (SELECT count(*) FROM free g WHERE g.SID=s.SID AND g.unit=s.unit) >= 4),
pbase AS (SELECT p.SID, p.unit, g.y FROM plc p JOIN free g ON split_part(p.SID,'/',1)=CAST(g.SID AS VARCHAR) AND p.unit=g.unit WHERE g.y <> year(p."start"))"""


@query("placebo_normal", sql(*NORMAL, base_sql(), PLACEBO, normal_sql(source="plc", base="pbase"), body=SCORE))
def placebo_normal(spark, d):
    o = nm.options(min_co2=0.0)
    first, last, _ = bounds(spark, d)
    tier = nm.rollup_series(s.panel(spark, d).select("unit", "date", "tier", "co2_ton"), ["unit", "date"], {"tier": "total"}, ["co2_ton"])
    arrays = nm.series_arrays(tier, ["unit", "tier"], "date", "value", first, last)
    ev = nm.active_events(based(spark, d, o), arrays.filter("tier = 'total'"), o, first)
    fake = cal.placebo_events(ev, start="start", end="end").withColumn("SID", F.concat_ws("/", F.col("SID").cast("string"), F.col("placebo_year").cast("string")))
    out = nm.by_window(fake, lambda w: nm.phase_scores(nm.normal_arrays(w, arrays, o, first), o))
    return rounded(out.select("SID", "unit", "tier", "phase", "obs", "expected", "ratio", "outside"), {"obs": 6, "expected": 4, "ratio": 5})

