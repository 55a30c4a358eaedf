"""Headline results within kinds of events, on forty ports."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tidewake.functions import geo
from tidewake.functions.numeric import nearest_ln
from tidewake.operators import geolocate as gl, groupings as gr, products as pr, space as sp
from tidewake.operators.sizing import checkpointed
from . import outcomes as o, standins as s
from .outcomes import CI, DIV, HU, OE, PORTS, PSUM, R5, RATIO, STS, TS, WINDOW
from .standins import rounded, sql
from .study import boot_sql

Q, SQL = {}, {}


def query(name, text=None):
    def keep(fn):
        Q[name] = fn
        if text:
            SQL[name] = text
        return fn
    return keep


def named(prefix, text):
    """The statements of a bootstrap under other names, so that one query can hold several."""
    return re.sub(r"\b(cs|ci|ct|sl|dr|bs|es|bt)\b", prefix + r"\1", text)


REGIONS = ["Gulf", "Atlantic", "Caribbean", "Great Lakes"]
KINDS = ("""pk AS (SELECT *, CASE WHEN tanker_sh>=.55 THEN 'Energy' WHEN other_sh>=.4 THEN 'Service' WHEN cargo_sh>=.5 THEN 'Cargo' ELSE 'Mixed' END AS port_type,
 CASE WHEN open_sh<.05 THEN 'River / inland' WHEN wait_sh>=.15 THEN 'Coastal, anchorage' ELSE 'Open coast' END AS layout, """ + s._nth("pn % 4", REGIONS) + """ AS region FROM pt),
kd AS (SELECT SID, pn, k_days, port, port_type, layout, region, dist, season, landfall, CASE WHEN dist>0 AND dist<=50 THEN '≤50 km' WHEN dist>50 AND dist<=100 THEN '50–100 km' WHEN dist>100 THEN '100–200 km' END AS dist_class,
 CASE WHEN k_days<=2 THEN '1–2 days' WHEN k_days<=4 THEN '3–4 days' ELSE '≥5 days' END AS dur_class, CASE WHEN region IN ('Gulf','Atlantic') THEN region ELSE 'Caribbean / Great Lakes' END AS region2, CASE WHEN season<=2019 THEN '2015–2019' ELSE '2020–2023' END AS period
 FROM (SELECT *, """ + ", ".join(f"{e} AS {n}" for n, e in o._covariates("::DOUBLE").items()) + """ FROM (SELECT DISTINCT SID, pn, k_days FROM psum)) JOIN pk USING (pn))""")
PDIV = DIV.replace("FROM wsum", "FROM psum")
EVENTS = "ev AS (SELECT cl.*, kd.* EXCLUDE (SID, pn, k_days) FROM cl JOIN kd ON kd.SID=cl.SID AND kd.pn=cl.pn AND kd.k_days=cl.k_days WHERE zone='total')"


def port_kinds(spark, d):
    t = o.port_table(spark, d).withColumn("port_type", pr.port_type("tanker_sh", "other_sh", "cargo_sh"))
    return t.withColumn("region", F.expr(s._nth("CAST(substring(port, 2) AS INT) % 4", REGIONS))).select("port", "port_type", "layout", "region")


def events(spark, d, ln=F.ln):
    """Classified events and placebo dates of whole ports with their kinds."""
    rows = o.port_events(spark, d, ln=ln)
    fine = pr.classify_divergence(pr.apply_bands(rows, o.fitted_bands(rows)))
    return gr.with_kinds(fine.where("zone = 'total'").join(port_kinds(spark, d), "port"))


def grouped_sql(groupings, where):
    names, levels = ",".join(f"'{g}'" for g in groupings), ",".join(groupings)
    return (f"eg AS (SELECT *, unnest([{names}]) AS grouping, unnest([{levels}]) AS level FROM ev WHERE py=0 {where})",
            "ge AS (SELECT * FROM eg WHERE level IS NOT NULL)",
            """gn AS (SELECT grouping, level, wd, count(*) AS n_events, count(DISTINCT port) AS n_ports, avg(CASE WHEN cls IN ('coupled','relative (amplified)','relative (damped)','absolute') THEN 1 ELSE 0 END) AS share_responding,
 avg(CASE WHEN cls LIKE 'relative%' THEN 1 ELSE 0 END) AS share_relative FROM ge GROUP BY ALL)""",
            boot_sql("ge", "grouping, level, wd", "SID", {f"{k}_{m}": f"{k}_{m}" for m in ("hours", "co2", "nox") for k in ("obs", "exp")},
                     {m: f"obs_{m}/nullif(exp_{m},0)" for m in ("hours", "co2", "nox")}, 1000, 1))


GROUPED = f"SELECT grouping, level, wd AS \"window\", n_events, n_ports, round(share_responding,6) AS share_responding, round(share_relative,6) AS share_relative, {R5(*CI('hours'), *CI('co2'), *CI('nox'))} FROM gn JOIN bt USING (grouping, level, wd)"
GROUPED_COLUMNS = ["grouping", "level", "window", "n_events", "n_ports", "share_responding", "share_relative", *CI("hours"), *CI("co2"), *CI("nox")]
GROUPED_DIGITS = {"share_responding": 6, "share_relative": 6, **{c: 5 for m in ("hours", "co2", "nox") for c in CI(m)}}


@query("grouped_responses", sql(PSUM, PORTS, KINDS, PDIV, EVENTS, *grouped_sql(list(gr.GROUPINGS), ""), body=GROUPED))
def grouped_responses(spark, d):
    out = gr.grouped_responses(events(spark, d).where("py = 0"), draws=1000)
    return rounded(out.select(*GROUPED_COLUMNS), GROUPED_DIGITS)


@query("grouped_strong_storms", sql(PSUM, PORTS, KINDS, PDIV, EVENTS, *grouped_sql(["port_type", "layout"], f"AND intensity<>'{TS}'"), body=GROUPED))
def grouped_strong_storms(spark, d):
    strong = events(spark, d).where("py = 0").where(F.col("intensity") != TS)
    out = gr.grouped_responses(strong, {"port_type": "port_type", "layout": "layout"}, draws=1000)
    return rounded(out.select(*GROUPED_COLUMNS), GROUPED_DIGITS)


@query("class_counts_by_port", sql(PSUM, PORTS, KINDS, PDIV, EVENTS, body=f"SELECT grouping, level, wd AS \"window\", count(*) AS n, {o.COUNT} FROM (SELECT *, unnest(['intensity','port_type','layout']) AS grouping, unnest([intensity,port_type,layout]) AS level FROM ev WHERE py=0) GROUP BY ALL"))
def class_counts_by_port(spark, d):
    return gr.grouped_class_counts(events(spark, d).where("py = 0"))


GAP_CELLS = """gc AS MATERIALIZED (SELECT py=0 AS ev, wd, SID, g, tg, pt, it FROM (SELECT *, unnest([intensity,'All']) AS it FROM (SELECT *, unnest([port_type,'All']) AS pt FROM ev WHERE g IS NOT NULL))),
gs AS (SELECT ev, wd, pt, it, count(*) AS n, avg(g) AS mean, quantile_cont(g,0.5) AS median, stddev_samp(g) AS sd, quantile_cont(g,0.75)-quantile_cont(g,0.25) AS iqr, avg(CASE WHEN abs(g)>tg THEN 1.0 ELSE 0.0 END) AS share_beyond FROM gc GROUP BY ALL),
gf AS (SELECT wd, pt, it, g, sum(CASE WHEN ev THEN 1 ELSE 0 END) OVER r / sum(CASE WHEN ev THEN 1 ELSE 0 END) OVER t AS f1, sum(CASE WHEN ev THEN 0 ELSE 1 END) OVER r / sum(CASE WHEN ev THEN 0 ELSE 1 END) OVER t AS f2 FROM gc
 WINDOW r AS (PARTITION BY wd, pt, it ORDER BY g), t AS (PARTITION BY wd, pt, it)),
kd_ AS (SELECT wd, pt, it, max(abs(f1-f2)) AS ks_d FROM gf GROUP BY ALL)"""
GAP_STATS = ["mean", "median", "sd", "iqr", "share_beyond"]


@query("gap_table", sql(PSUM, PORTS, KINDS, PDIV, EVENTS, GAP_CELLS, named("a", boot_sql("gc", "wd, pt, it", "SID", o.MEAN, {"st": "sv/nv"}, 1000, 5, extra_where="WHERE ev")),
                        named("b", boot_sql("gc", "wd, pt, it", "SID", o.MEAN, {"st": "sv/nv"}, 1000, 6, extra_where="WHERE NOT ev")),
                        "dq AS (SELECT wd, pt, it, quantile_cont(x.sv/x.nv-y.sv/y.nv,0.025) AS diff_lo, quantile_cont(x.sv/x.nv-y.sv/y.nv,0.975) AS diff_hi FROM adr x JOIN bdr y USING (wd, pt, it, draw) GROUP BY wd, pt, it)",
                        "lm AS (SELECT *, (sqrt(n1*n2/(n1+n2))+0.12+0.11/sqrt(n1*n2/(n1+n2)))*ks_d AS lam FROM (SELECT kd_.*, e.n*1.0::DOUBLE AS n1, p.n*1.0::DOUBLE AS n2 FROM kd_ JOIN gs e ON e.ev AND e.wd=kd_.wd AND e.pt=kd_.pt AND e.it=kd_.it JOIN gs p ON NOT p.ev AND p.wd=kd_.wd AND p.pt=kd_.pt AND p.it=kd_.it))",
                        body="SELECT e.wd AS \"window\", e.pt AS port_type, e.it AS intensity, e.n AS n_events, p.n AS n_placebo, " + ", ".join(f"round(e.{c},5) AS {c}_events, round(p.{c},5) AS {c}_placebo" for c in GAP_STATS)
                        + """, round(e.mean-p.mean,5) AS diff, round(diff_lo,5) AS diff_lo, round(diff_hi,5) AS diff_hi, round(ks_d,6) AS ks_d, round(CASE WHEN lam<0.2 THEN 1 ELSE least(greatest(2*list_sum([(CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END)*exp(-2.0::DOUBLE*j*j*lam*lam) for j in range(1,101)]),0),1) END,6) AS ks_p
 FROM gs e JOIN gs p ON NOT p.ev AND p.wd=e.wd AND p.pt=e.pt AND p.it=e.it JOIN dq ON dq.wd=e.wd AND dq.pt=e.pt AND dq.it=e.it JOIN lm ON lm.wd=e.wd AND lm.pt=e.pt AND lm.it=e.it WHERE e.ev AND e.n>=5"""))
def gap_table(spark, d):
    ev = checkpointed(events(spark, d, nearest_ln))
    out = gr.gap_table(ev.where("py = 0"), ev.where("py <> 0"), draws=1000)
    return rounded(out, {**{f"{c}_{t}": 5 for c in GAP_STATS for t in ("events", "placebo")}, "diff": 5, "diff_lo": 5, "diff_hi": 5, "ks_d": 6, "ks_p": 6})


CLAIM_LEVELS = ["'All events'", *gr.CLAIM_GROUPINGS]
PCLM = ("""pc AS (SELECT SID, pn, k_days, intensity, """ + ", ".join(f"sum(CASE WHEN zone='total' AND \"window\"='{w}' THEN {k}_{m} ELSE 0 END) AS {w}_{k[0]}_{m}" for w in WINDOW for k in ("obs", "exp") for m in ("co2", "hours", "nox", "pm25")) + """,
 sum(CASE WHEN "window"='storm' AND zone IN ('anchorage','offshore_hold','offshore') THEN obs_co2-exp_co2 ELSE 0 END) AS d_out, sum(CASE WHEN "window"='storm' AND zone<>'total' THEN obs_co2-exp_co2 ELSE 0 END) AS d_all,
 sum(CASE WHEN "window"='after' AND zone='anchorage' THEN obs_co2-exp_co2 END) AS jit_co2 FROM psum WHERE py=0 GROUP BY ALL),
pe AS (SELECT pc.*, event30_e_co2/(k_days+32) AS norm_co2_day, kd.* EXCLUDE (SID, pn, k_days) FROM pc JOIN kd USING (SID, pn, k_days)),
pg AS (SELECT *, unnest(['all',""" + ",".join(f"'{g}'" for g in gr.CLAIM_GROUPINGS) + """]) AS grouping, unnest([""" + ",".join(CLAIM_LEVELS) + """]) AS level FROM pe),
pn_ AS (SELECT grouping, level, count(*) AS n_events, count(DISTINCT SID) AS n_storms, count(DISTINCT pn) AS n_ports FROM pg GROUP BY ALL)""")
CLAIM_ESTIMATES = [c for c in o.CEST if not c.startswith("c1_")]


def port_claim_rows(spark, d):
    w = o.port_events(spark, d).where("py = 0")
    total, outer, inner = F.col("zone") == "total", F.col("zone").isin(*pr.OUTER_ZONES), F.col("zone") != "total"
    x, here = F.col("obs_co2") - F.col("exp_co2"), lambda name: F.col("window") == name
    aggs = [F.sum(F.when(total & here(wd), F.col(f"{k}_{m}")).otherwise(0.0)).alias(f"{wd}_{k[0]}_{m}") for wd in WINDOW for k in ("obs", "exp") for m in ("co2", "hours", "nox", "pm25")]
    e = w.groupBy("SID", "port", "k_days", "intensity", "season", "dist", "landfall").agg(
        *aggs, F.sum(F.when(here("storm") & outer, x).otherwise(0.0)).alias("d_out"), F.sum(F.when(here("storm") & inner, x).otherwise(0.0)).alias("d_all"),
        F.sum(F.when(here("after") & (F.col("zone") == "anchorage"), x)).alias("jit_co2"))
    e = e.withColumns({"norm_co2_day": F.col("event30_e_co2") / (F.col("k_days") + 32), "o_co2c": F.col("event30_o_co2"), "e_co2c": F.col("event30_e_co2"),
                       "o_calls": F.col("event30_o_pm25"), "e_calls": F.col("event30_e_pm25")})
    return gr.with_kinds(e.join(port_kinds(spark, d), "port"))


@query("claims_all_groups", sql(PSUM, PORTS, KINDS, PCLM, named("a", boot_sql("pg", "grouping, level", "SID", o.CSUM, o.CLS, 1000, 1, min_clusters=3)),
                                named("b", boot_sql("pg", "grouping, level, intensity", "SID", {"obs": "storm_o_co2", "expected": "storm_e_co2"}, RATIO, 1000, 1, min_clusters=3)),
                                f"""qr AS (SELECT grouping, level, jit_co2 AS v, norm_co2_day AS nd, row_number() OVER (PARTITION BY grouping, level ORDER BY jit_co2 DESC) AS r FROM pg WHERE intensity='{HU}' AND jit_co2 IS NOT NULL),
qa AS (SELECT grouping, level, greatest(sum(v),0)/nullif(sum(nd),0) AS queue_days, avg(CASE WHEN v>0 THEN 1 ELSE 0 END) AS share_with_queue, sum(greatest(v,0)) FILTER (r<=3)/nullif(sum(greatest(v,0)),0) AS top_share FROM qr GROUP BY ALL)""",
                                body=f"""SELECT grouping, level, NULL AS storm_class, n_events, n_storms, n_ports, {', '.join(f'round({c},4) AS {c}' for c in CLAIM_ESTIMATES)}, round(queue_days,6) AS queue_days, round(share_with_queue,6) AS share_with_queue, round(top_share,6) AS top_share,
 NULL::DOUBLE AS c1, NULL::DOUBLE AS c1_lo, NULL::DOUBLE AS c1_hi FROM pn_ JOIN abt USING (grouping, level) LEFT JOIN qa USING (grouping, level) UNION ALL
 SELECT grouping, level, intensity, n.c, NULL, NULL, {', '.join('NULL' for _ in CLAIM_ESTIMATES)}, NULL, NULL, NULL, round(ratio,4), round(ratio_lo,4), round(ratio_hi,4) FROM bbt JOIN (SELECT grouping, level, intensity, count(*) AS c FROM pg GROUP BY ALL) n USING (grouping, level, intensity)"""))
def claims_all_groups(spark, d):
    out = gr.claims_by_group(port_claim_rows(spark, d), HU, draws=1000)
    columns = ["grouping", "level", "storm_class", "n_events", "n_storms", "n_ports", *CLAIM_ESTIMATES, "queue_days", "share_with_queue", "top_share", *CI("c1")]
    return rounded(out.select(*columns), {**{c: 4 for c in (*CLAIM_ESTIMATES, *CI("c1"))}, "queue_days": 6, "share_with_queue": 6, "top_share": 6})


LEFT = {"c1_storm": ("_so", "_se"), "c1_hurricane": ("_ho", "_he"), "c2": ("_out", "_all"), "c3": ("event30_o_co2", "event30_e_co2"), "c6_nox": ("event30_o_nox", "event30_e_nox")}


@query("claims_left_out_seven", sql(PSUM, PORTS, KINDS, PCLM, f"""lo AS (SELECT SID, sum(CASE WHEN intensity='{TS}' THEN storm_o_co2 ELSE 0 END) AS so, sum(CASE WHEN intensity='{TS}' THEN storm_e_co2 ELSE 0 END) AS se, sum(CASE WHEN intensity='{HU}' THEN storm_o_co2 ELSE 0 END) AS ho,
 sum(CASE WHEN intensity='{HU}' THEN storm_e_co2 ELSE 0 END) AS he, sum(d_out) AS dout, sum(d_all) AS dall, sum(event30_o_co2) AS eo, sum(event30_e_co2) AS ee, sum(event30_o_nox) AS no_, sum(event30_e_nox) AS ne_,
 sum(CASE WHEN event30_e_pm25>0 THEN event30_o_co2 ELSE 0 END) AS c1_, sum(CASE WHEN event30_e_pm25>0 THEN event30_o_pm25 ELSE 0 END) AS c2_, sum(CASE WHEN event30_e_pm25>0 THEN event30_e_co2 ELSE 0 END) AS c3_, sum(CASE WHEN event30_e_pm25>0 THEN event30_e_pm25 ELSE 0 END) AS c4_,
 sum(CASE WHEN intensity='{HU}' AND jit_co2 IS NOT NULL THEN jit_co2 ELSE 0 END) AS j, sum(CASE WHEN intensity='{HU}' AND jit_co2 IS NOT NULL THEN norm_co2_day ELSE 0 END) AS nd FROM pe GROUP BY SID),
lt AS (SELECT SID AS left_out, """ + ", ".join(f"sum({c}) OVER () - {c} AS {c}" for c in ("so", "se", "ho", "he", "dout", "dall", "eo", "ee", "no_", "ne_", "c1_", "c2_", "c3_", "c4_", "j", "nd")) + " FROM lo)",
                                    body="SELECT left_out, round(so/se,6) AS c1_storm, round(ho/he,6) AS c1_hurricane, round(dout/dall,6) AS c2, round(eo/ee,6) AS c3, round((c1_/c2_)/(c3_/c4_),6) AS c4, round(no_/ne_,6) AS c6_nox, round(greatest(j,0)/nd,6) AS c7 FROM lt"))
def claims_left_out_seven(spark, d):
    out = gr.claims_left_out(port_claim_rows(spark, d), TS, HU)
    return rounded(out, {c: 6 for c in ("c1_storm", "c1_hurricane", "c2", "c3", "c4", "c6_nox", "c7")})


@query("claims_landfall", sql(PSUM, PORTS, KINDS, PCLM, boot_sql("pe", "landfall", "SID", {"obs": "storm_o_co2", "expected": "storm_e_co2"}, RATIO, 1000, 1, min_clusters=3, extra_where=f"WHERE intensity='{HU}'"),
                              body=f"""SELECT landfall, 'hurricanes' AS "group", n_events, n_cyclones, {R5(*CI('ratio'))} FROM bt JOIN (SELECT landfall, count(*) AS n_events, count(DISTINCT SID) AS n_cyclones FROM pe WHERE intensity='{HU}' GROUP BY landfall) USING (landfall)
 UNION ALL SELECT landfall, 'all classes', count(*), count(DISTINCT SID), NULL, NULL, NULL FROM pe GROUP BY landfall"""))
def claims_landfall(spark, d):
    out = gr.landfall_split(port_claim_rows(spark, d), HU, draws=1000)
    return rounded(out.select("landfall", "group", "n_events", "n_cyclones", *CI("ratio")), {c: 5 for c in CI("ratio")})


POLL = ("""ps AS (SELECT SID, intensity, "window" AS wd, zone, obs_co2, exp_co2, obs_nox, exp_nox, obs_pm25, exp_pm25, CASE WHEN zone<>'offshore' THEN obs_nox*0.07::DOUBLE ELSE 0 END AS obs_so2, CASE WHEN zone<>'offshore' THEN exp_co2*0.003::DOUBLE ELSE 0 END AS exp_so2 FROM psum WHERE py=0 AND zone<>'total'),
pl AS (SELECT SID, intensity, wd, zone, unnest(['co2','nox','pm25','so2']) AS pollutant, unnest([obs_co2,obs_nox,obs_pm25,obs_so2]) AS obs, unnest([exp_co2,exp_nox,exp_pm25,exp_so2]) AS expected FROM ps),
pa AS (SELECT intensity, wd, pollutant, sum(obs)/sum(expected) AS ratio_, sum(CASE WHEN zone IN ('anchorage','offshore_hold','offshore') THEN obs-expected ELSE 0 END)/sum(obs-expected) AS share_outside, sum(CASE WHEN zone='anchorage' THEN obs ELSE 0 END)/sum(CASE WHEN zone='anchorage' THEN expected ELSE 0 END) AS anchorage_ratio FROM pl GROUP BY ALL)""")


@query("pollutants_pooled", sql(PSUM, POLL, boot_sql("pl", "intensity, wd, pollutant", "SID", OE, RATIO, 1000, 1),
                                body='SELECT intensity, wd AS "window", pollutant, n_clusters, round(ratio_,6) AS ratio, round(ratio_lo,5) AS lo, round(ratio_hi,5) AS hi, round(share_outside,6) AS share_outside, round(anchorage_ratio,6) AS anchorage_ratio FROM pa JOIN bt USING (intensity, wd, pollutant)'))
def pollutants_pooled(spark, d):
    rows = o.port_events(spark, d).where("py = 0 AND zone <> 'total'")
    so2 = rows.where("zone <> 'offshore'").select("SID", "port", "window", "zone", "k_days", (F.col("obs_nox") * 0.07).alias("obs_so2"), (F.col("exp_co2") * 0.003).alias("exp_so2"))
    joined = rows.join(so2, ["SID", "port", "window", "zone", "k_days"], "left")
    out = gr.pollutants_pooled(joined, ["intensity", "window"], draws=1000)
    return rounded(out.select("intensity", "window", "pollutant", "n_clusters", "ratio", "lo", "hi", "share_outside", "anchorage_ratio"), {"ratio": 6, "lo": 5, "hi": 5, "share_outside": 6, "anchorage_ratio": 6})


TRACKS = """tr AS (SELECT user_id % 100 AS SID, date_trunc('hour', ts) AS time, 20 + (user_id*7 + event_id*13) % 100 AS wind FROM events),
tw AS (SELECT SID, time, max(wind) AS wind_kt FROM tr GROUP BY ALL),
fx AS (SELECT user_id % 100 AS SID, date_trunc('hour', ts) AS time, 20 + (event_id % 2000)/100.0::DOUBLE AS lat, -95 + (event_id % 3000)/100.0::DOUBLE AS lon, (event_id*31 % 600)/10.0::DOUBLE AS rms_km FROM events WHERE event_type<>'view')"""


@query("map_tracks", sql(TRACKS, body="SELECT SID, time, round(lat,4) AS lat, round(lon,4) AS lon, wind_kt FROM fx LEFT JOIN tw USING (SID, time) WHERE rms_km<30 AND SID IN (SELECT l_suppkey FROM lineitem)"))
def map_tracks(spark, d):
    e = s.table(spark, d, "events")
    tracks = e.selectExpr("user_id % 100 AS SID", "date_trunc('hour', ts) AS time", "20 + (user_id*7 + event_id*13) % 100 AS wind")
    fixes = e.where("event_type <> 'view'").selectExpr("user_id % 100 AS SID", "date_trunc('hour', ts) AS time", "20 + (event_id % 2000)/100D AS lat", "-95 + (event_id % 3000)/100D AS lon", "(event_id*31 % 600)/10D AS rms_km")
    return rounded(gr.map_tracks(fixes, tracks, s.table(spark, d, "lineitem").selectExpr("l_suppkey AS SID")), {"lat": 4, "lon": 4})


# storms on known tracks, and their exact distances to the ports in reach
PLACES = ["25 + (pn*11 % 40) * 0.2{0}", "-98 + (pn*17 % 40) * 0.6{0}"]
TRUTH = ["24 + {t} * 0.06{0}", "-96 + s_suppkey % 10 + {t} * 0.05{0}"]
HAV = "2*6371.0::DOUBLE*asin(sqrt(least(1, sin(radians({a}-{c})/2)**2 + cos(radians({a}))*cos(radians({c}))*sin(radians({b}-{d})/2)**2)))"
GEO = (f"gp AS (SELECT DISTINCT 'P' || pn AS port, {PLACES[0].format('::DOUBLE')} AS p_lat, {PLACES[1].format('::DOUBLE')} AS p_lon FROM (SELECT l_partkey % 40 AS pn FROM lineitem))",
       f"gs AS (SELECT s_suppkey % 10 AS SID, s_suppkey // 10 AS time, {TRUTH[0].format('::DOUBLE', t='(s_suppkey // 10)')} AS lat, {TRUTH[1].format('::DOUBLE', t='(s_suppkey // 10)')} AS lon FROM supplier)",
       f"gd AS (SELECT SID, time, port, {HAV.format(a='lat', b='lon', c='p_lat', d='p_lon')} AS dist_km FROM gs, gp)")


def known_ports(spark, d):
    numbers = s.table(spark, d, "lineitem").selectExpr("l_partkey % 40 AS pn").distinct()
    return checkpointed(numbers.selectExpr("concat('P', pn) AS port", f"{PLACES[0].format('D')} AS p_lat", f"{PLACES[1].format('D')} AS p_lon"))


def known_storms(spark, d):
    t = "(s_suppkey div 10)"
    return s.table(spark, d, "supplier").selectExpr("s_suppkey % 10 AS SID", f"{t} AS time", f"{TRUTH[0].format('D', t=t)} AS lat", f"{TRUTH[1].format('D', t=t)} AS lon")


def known_track(spark, d, ports):
    storms = known_storms(spark, d)
    near = sp.within_km(storms, ports, lat="lat", lon="lon", c_lat="p_lat", c_lon="p_lon", km=500.0, cell=2)
    return checkpointed(near.select("SID", "time", "port", "dist_km"))


@query("storm_fixes", sql(*GEO, body="SELECT SID, time, count(*) AS n_ports, true AS placed, 0.0::DOUBLE AS rms_km FROM gd WHERE dist_km<=500 GROUP BY SID, time HAVING count(*)>=5"))
def storm_fixes(spark, d):
    """Storms located from their distances alone; `placed` says that the fix is within a kilometre of where the storm was."""
    ports = known_ports(spark, d)
    fixes = gl.locate_storms(known_track(spark, d, ports), ports)
    truth = known_storms(spark, d).withColumnsRenamed({"lat": "t_lat", "lon": "t_lon"})
    out = fixes.where("n_ports >= 5").join(truth, ["SID", "time"]).withColumn("placed", geo.haversine_km("lat", "lon", "t_lat", "t_lon") < 1.0)
    return rounded(out.select("SID", "time", "n_ports", "placed", "rms_km"), {"rms_km": 2})


@query("port_fixes", sql(*GEO, body="SELECT port, CASE WHEN n>=5 THEN 'placed' ELSE 'as given' END AS state FROM gp LEFT JOIN (SELECT port, count(*) AS n FROM gd WHERE dist_km<=500 GROUP BY port) USING (port)"))
def port_fixes(spark, d):
    """Ports that were given a tenth of a degree off, moved to where the storms' distances put them."""
    ports = known_ports(spark, d)
    fixes = known_storms(spark, d).withColumn("rms_km", F.lit(0.0))
    given = ports.withColumns({"p_lat": F.col("p_lat") + 0.1, "p_lon": F.col("p_lon") - 0.1})
    moved = gl.refine_ports(known_track(spark, d, ports), fixes, given)
    off = geo.haversine_km("p_lat", "p_lon", "t_lat", "t_lon")
    out = moved.join(ports.withColumnsRenamed({"p_lat": "t_lat", "p_lon": "t_lon"}), "port")
    return out.select("port", F.when(off < 0.5, "placed").when((off > 10) & (off < 20), "as given").otherwise("lost").alias("state"))
