"""Positions, visits, fuel, zones and exposures."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewake.functions import geo
from tidewake.operators import emission as em, exposure as ex, lookup, space, trajectory as tr
from tidewake.operators.sizing import checkpointed
from tidewake.sources import positions, registry
from . import standins as s
from .standins import rounded, sql

Q, SQL = {}, {}
E6 = {"dt_h": 6, "hours": 6, "fc_main_ton": 6, "fc_AE_ton": 6, "fc_boiler_ton": 6, "fc_total_ton": 6, "co2_ton": 6}
SUMS = ", ".join(f"round(sum({c}),6) AS {c}" for c in em.EMISSION_COLUMNS)


def query(name, text=None):
    def keep(fn):
        Q[name] = fn
        if text:
            SQL[name] = text
        return fn
    return keep


def fuel(spark, d):
    return em.message_fuel(s.fixes(spark, d), s.ships(spark, d), s.bands(spark, d), tie=["event_id"])


def port_fuel(spark, d):
    located = space.assign_polygon(fuel(spark, d), "longitude", "latitude", s.rings(spark, d))
    return located.filter(F.col("port").isNotNull()).withColumn("vclass", em.traffic_class("vessel_type_str"))


@query("gap_credit_hours", sql(s.FIX, s.SHIP, s.CREDIT, body="""SELECT event_id, imo, round(raw_h,6) AS raw_h, round(dt_h,6) AS dt_h FROM credit"""))
def gap_credit_hours(spark, d):
    m = s.fixes(spark, d).filter(em.valid_speed("sog")).join(s.ships(spark, d), "imo")
    out = tr.credit_gaps(m, "imo", "base_date_time", "date", tie=["event_id"])
    return rounded(out.select("event_id", "imo", "raw_h", "dt_h"), {"raw_h": 6, "dt_h": 6})


@query("band_lookup", sql(s.SHIP, s.BAND, s.ENGINE, body="SELECT * FROM engine"))
def band_lookup(spark, d):
    out = lookup.band_join(s.ships(spark, d), s.bands(spark, d), "vessel_type_str", "dwt", s.BAND_TABLES)
    return out.select("imo", *s.BAND_TABLES)


@query("message_fuel", sql(s.FIX, s.SHIP, s.CREDIT, s.BAND, s.ENGINE, s.FUEL, body="""SELECT event_id, imo, phase, round(P_ME,6) AS p_me, round(P_AE,6) AS p_ae,
 round(P_boiler,6) AS p_boiler, round(dt_h,6) AS dt_h, round(fc_main_ton,6) AS fc_main_ton, round(fc_AE_ton,6) AS fc_ae_ton, round(fc_boiler_ton,6) AS fc_boiler_ton, round(co2_ton,6) AS co2_ton FROM fuel"""))
def message_fuel(spark, d):
    out = fuel(spark, d).select("event_id", "imo", "phase", F.col("P_ME").alias("p_me"), F.col("P_AE").alias("p_ae"),
                                F.col("P_boiler").alias("p_boiler"), "dt_h", "fc_main_ton", F.col("fc_AE_ton").alias("fc_ae_ton"),
                                "fc_boiler_ton", "co2_ton")
    return rounded(out, {**E6, "p_me": 6, "p_ae": 6, "p_boiler": 6, "fc_ae_ton": 6})


@query("point_in_polygon", sql(s.FIX, s.RING, s.INSIDE, body="SELECT event_id, port FROM fix LEFT JOIN located USING (event_id)"))
def point_in_polygon(spark, d):
    return space.assign_polygon(s.fixes(spark, d), "longitude", "latitude", s.rings(spark, d)).select("event_id", "port")


DETAIL = f"""detail AS (SELECT date, port, {s.VCLASS} AS vclass, scrubber_tech, count(*) AS n_messages, count(DISTINCT imo) AS n_vessels,
  sum(dt_h) AS hours, {", ".join(f"sum({c}) AS {c}" for c in em.EMISSION_COLUMNS)} FROM fuel JOIN located USING (event_id) GROUP BY ALL)"""
FUEL_CHAIN = (s.FIX, s.SHIP, s.CREDIT, s.BAND, s.ENGINE, s.FUEL)
PORT_CHAIN = (*FUEL_CHAIN, s.RING, s.INSIDE, DETAIL)
R6 = ", ".join(f"round({c},6) AS {c}" for c in em.EMISSION_COLUMNS)


@query("port_day_emissions", sql(*PORT_CHAIN, body=f"SELECT date, port, vclass, scrubber_tech, n_messages, n_vessels, round(hours,6) AS hours, {R6} FROM detail"))
def port_day_emissions(spark, d):
    return rounded(em.emission_panel(port_fuel(spark, d), ["date", "port", "vclass", "scrubber_tech"]), E6)


@query("port_day_rollup", sql(*PORT_CHAIN, body=f"SELECT date, port, CAST(sum(n_messages) AS BIGINT) AS n_messages, round(sum(hours),6) AS hours, {SUMS} FROM detail GROUP BY date, port"))
def port_day_rollup(spark, d):
    detail = em.emission_panel(port_fuel(spark, d), ["date", "port", "vclass", "scrubber_tech"])
    return rounded(em.panel_rollup(detail, ["date", "port"]), E6)


@query("class_restricted_panel", sql(*PORT_CHAIN, body="SELECT date, port, CAST(sum(n_messages) AS BIGINT) AS n_messages, round(sum(hours),6) AS hours, round(sum(co2_ton),6) AS co2_ton FROM detail WHERE vclass IN ('cargo','tanker') GROUP BY date, port"))
def class_restricted_panel(spark, d):
    detail = em.emission_panel(port_fuel(spark, d), ["date", "port", "vclass", "scrubber_tech"])
    out = em.restrict_classes(detail, ["cargo", "tanker"], ["date", "port"])
    return rounded(out.select("date", "port", "n_messages", "hours", "co2_ton"), E6)


@query("gap_panel", sql(s.FIX, s.SHIP, s.CREDIT, s.RING, s.INSIDE, body="""SELECT date, port, n_messages, n_vessels, round(hc,6) AS hours_credited, round(hd,6) AS hours_discarded, n_gaps_over,
 round(CASE WHEN hc+hd>0 THEN hd/(hc+hd) ELSE 0 END,6) AS discard_share FROM (SELECT date, port, count(*) AS n_messages, count(DISTINCT imo) AS n_vessels, sum(dt_h) AS hc,
 sum(CASE WHEN r>3 THEN least(r,24) ELSE 0 END) AS hd, CAST(sum(CASE WHEN r>3 THEN 1 ELSE 0 END) AS BIGINT) AS n_gaps_over FROM (SELECT *, coalesce(epoch_us(base_date_time)-lag(epoch_us(base_date_time))
 OVER (PARTITION BY imo, date ORDER BY base_date_time, event_id),0)/3.6e9 AS r FROM credit JOIN located USING (event_id)) GROUP BY date, port)"""))
def gap_panel(spark, d):
    m = s.fixes(spark, d).filter(em.valid_speed("sog")).join(s.ships(spark, d), "imo")
    m = tr.credit_gaps(m, "imo", "base_date_time", "date", tie=["event_id"])
    m = space.assign_polygon(m, "longitude", "latitude", s.rings(spark, d))
    out = tr.gap_panel(m, ship="imo", time="base_date_time", day="date", port="port", tie=["event_id"])
    return rounded(out, {"hours_credited": 6, "hours_discarded": 6, "discard_share": 6})


# ---------------------------------------------------------------- visits
PRESENCE = """presence AS (SELECT CAST(ts AS DATE) AS date, user_id AS ship, event_type AS port, arg_min(event_id, ts) AS imo, min(ts) AS first_seen,
  max(ts) AS last_seen, count(*) AS n_msgs FROM events GROUP BY ALL)"""
VISITS = """flag AS (SELECT *, CASE WHEN first_seen - max(last_seen) OVER (PARTITION BY ship, port ORDER BY first_seen, last_seen ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
   <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS brk FROM presence),
numbered AS (SELECT *, sum(brk) OVER (PARTITION BY ship, port ORDER BY first_seen, last_seen ROWS UNBOUNDED PRECEDING) AS visit_no,
   first_value(imo) OVER (PARTITION BY ship, port ORDER BY first_seen, last_seen) AS imo0 FROM flag),
visit AS (SELECT ship, port, CAST(visit_no AS BIGINT) AS visit_no, min(imo0) AS imo, min(first_seen) AS arrival, max(last_seen) AS departure,
   CAST(sum(n_msgs) AS BIGINT) AS n_msgs, (epoch_us(max(last_seen))-epoch_us(min(first_seen)))/3.6e9 AS duration_h FROM numbered GROUP BY ship, port, visit_no)"""


def presence(spark, d):
    e = s.table(spark, d, "events").selectExpr("user_id AS ship", "event_type AS port", "ts", "CAST(ts AS DATE) AS date", "event_id AS imo_raw")
    return checkpointed(tr.daily_presence(e, ship="ship", port="port", time="ts", day="date", imo="imo_raw"))


@query("daily_presence", sql(PRESENCE, body="SELECT * FROM presence"))
def daily_presence(spark, d):
    return presence(spark, d)


@query("visit_stitch", sql(PRESENCE, VISITS, body="SELECT ship, port, visit_no, imo, arrival, departure, n_msgs, round(duration_h,6) AS duration_h, duration_h >= 4 AS is_call, CAST(arrival AS DATE) AS date FROM visit"))
def visit_stitch(spark, d):
    return rounded(tr.stitch_visits(presence(spark, d), ship="ship", port="port"), {"duration_h": 6})


@query("call_panel", sql(PRESENCE, VISITS, body="""SELECT coalesce(a.date, p.date) AS date, coalesce(a.port, p.port) AS port, coalesce(port_calls,0) AS port_calls, coalesce(distinct_vessels,0) AS distinct_vessels,
 round(median_duration_h,6) AS median_duration_h, coalesce(vessels_present,0) AS vessels_present FROM
 (SELECT CAST(arrival AS DATE) AS date, port, count(*) AS port_calls, count(DISTINCT ship) AS distinct_vessels, quantile_cont(duration_h,0.5) AS median_duration_h FROM visit WHERE duration_h>=4 GROUP BY ALL) a
 FULL JOIN (SELECT CAST(d AS DATE) AS date, port, count(DISTINCT ship) AS vessels_present FROM (SELECT port, ship, unnest(generate_series(CAST(arrival AS DATE), CAST(departure AS DATE), INTERVAL 1 DAY)) AS d FROM visit WHERE duration_h>=4) GROUP BY ALL) p
 ON a.date=p.date AND a.port=p.port"""))
def call_panel(spark, d):
    visits = checkpointed(tr.stitch_visits(presence(spark, d), ship="ship", port="port"))
    return rounded(tr.call_panel(visits, ship="ship", port="port"), {"median_duration_h": 6})


# ---------------------------------------------------------------- tiers and zones
FINE, COARSE = 0.5, 2.5
CELLS = f"""cell AS (SELECT r AS res_deg, CAST(round_even(latitude/r,0) AS BIGINT) AS gy, CAST(round_even(longitude/r,0) AS BIGINT) AS gx, count(*) AS n_msg,
  CAST(sum(CASE WHEN status=5 AND sog<3 THEN 1 ELSE 0 END) AS BIGINT) AS n_moored, CAST(sum(CASE WHEN status=1 AND sog<3 THEN 1 ELSE 0 END) AS BIGINT) AS n_anchored,
  CAST(sum(CASE WHEN sog>=3 THEN 1 ELSE 0 END) AS BIGINT) AS n_underway FROM fix, (VALUES ({FINE}::DOUBLE),({COARSE}::DOUBLE)) t(r) GROUP BY ALL)"""
VERTEX = """vertex AS (SELECT ring_no, e AS pos, port, ex1 AS v_lon, ey1 AS v_lat FROM (SELECT *, 0 AS e FROM edge WHERE ex1 - x0 = 0.5 AND ey1 = y0))"""
TIERS = f"""kept AS (SELECT *, gy*res_deg AS lat, gx*res_deg AS lon FROM cell WHERE n_msg>=5 AND ((res_deg={FINE} AND n_moored+n_anchored>=n_underway AND n_moored+n_anchored>0)
   OR (res_deg={COARSE} AND n_moored+n_anchored<n_underway AND n_underway>0))),
near AS (SELECT res_deg, gy, gx, arg_min(port, ({s.planar_sql('lat', 'lon', 'v_lat', 'v_lon')}, ring_no)) AS complex, min({s.planar_sql('lat', 'lon', 'v_lat', 'v_lon')}) AS d_km FROM kept, vertex GROUP BY ALL),
tier AS (SELECT kept.*, complex, d_km, CASE WHEN res_deg={FINE} AND n_moored>n_anchored THEN 'port' WHEN res_deg={FINE} AND d_km<=30 THEN 'anchorage' WHEN res_deg={FINE} AND d_km<=100 THEN 'offshore_hold'
   WHEN res_deg={COARSE} AND d_km<=25 THEN 'channel' ELSE 'offshore' END AS tier FROM kept JOIN near USING (res_deg, gy, gx))"""


def cells(spark, d):
    return ex.cell_counts(s.fixes(spark, d), lat="latitude", lon="longitude", sog="sog", status="status", resolutions=(FINE, COARSE))


def tiers(spark, d):
    return ex.tier_map(cells(spark, d), ex.ring_vertices(s.rings(spark, d)), fine=FINE, coarse=COARSE, min_messages=5)


@query("cell_counts", sql(s.FIX, CELLS, body="SELECT * FROM cell"))
def cell_counts(spark, d):
    return cells(spark, d).drop("lat", "lon")


@query("tier_map", sql(s.FIX, s.RING, CELLS, VERTEX, TIERS, body="SELECT res_deg, gy, gx, complex, tier, round(d_km,5) AS d_km, n_msg FROM tier"))
def tier_map(spark, d):
    return rounded(tiers(spark, d).select("res_deg", "gy", "gx", "complex", "tier", "d_km", "n_msg"), {"d_km": 5})


ZONED = f"""zoned AS (SELECT f.*, coalesce(a.complex, b.complex, 'Outside') AS complex, CASE WHEN sog>=3 AND coalesce(a.tier,b.tier,'outside')='port' THEN 'channel' ELSE coalesce(a.tier,b.tier,'outside') END AS tier,
  {s.VCLASS} AS vclass FROM fuel f LEFT JOIN tier a ON a.res_deg={FINE} AND a.gy=round_even(latitude/{FINE},0) AND a.gx=round_even(longitude/{FINE},0)
  LEFT JOIN tier b ON b.res_deg={COARSE} AND b.gy=round_even(latitude/{COARSE},0) AND b.gx=round_even(longitude/{COARSE},0))"""
ZONE_CHAIN = (*FUEL_CHAIN, s.RING, CELLS, VERTEX, TIERS, ZONED)


def zoned(spark, d):
    stored = checkpointed(tiers(spark, d))      # the map is a stored table in practice
    m = space.assign_cell(fuel(spark, d), "latitude", "longitude", stored, (FINE, COARSE))
    return em.settle_zone(m).withColumn("vclass", em.traffic_class("vessel_type_str"))


@query("cell_tier_lookup", sql(*ZONE_CHAIN, body="SELECT event_id, complex, tier, tier <> 'outside' AS in_region FROM zoned"))
def cell_tier_lookup(spark, d):
    return zoned(spark, d).select("event_id", "complex", "tier", "in_region")


@query("zone_day_emissions", sql(*ZONE_CHAIN, body=f"SELECT date, complex, tier, vclass, scrubber_tech, count(*) AS n_messages, count(DISTINCT imo) AS n_vessels_in_cell, round(sum(dt_h),6) AS hours, {SUMS} FROM zoned GROUP BY ALL"))
def zone_day_emissions(spark, d):
    return rounded(em.emission_panel(zoned(spark, d), ["date", "complex", "tier", "vclass", "scrubber_tech"], vessels="n_vessels_in_cell"), E6)


@query("tier_fuel_share", sql(*ZONE_CHAIN, body="SELECT tier, round(100*sum(fc_total_ton)/(SELECT sum(fc_total_ton) FROM zoned WHERE tier<>'outside'),5) AS share FROM zoned WHERE tier<>'outside' GROUP BY tier"))
def tier_fuel_share(spark, d):
    inside = zoned(spark, d).filter("in_region")
    out = em.share_of_total(inside, ["tier"], "fc_total_ton", "share", scale=100.0)
    return rounded(out.select("tier", "share"), {"share": 5})


# ---------------------------------------------------------------- scrubbers and sulfur
INSTALL = "install AS (SELECT c_custkey AS imo, DATE '2024-01-01' + CAST(c_custkey % 45 AS INT) AS install_date FROM customer)"


def installs(spark, d):
    return s.table(spark, d, "customer").selectExpr("c_custkey AS imo", "date_add(DATE'2024-01-01', CAST(c_custkey % 45 AS INT)) AS install_date")


@query("scrubber_in_use", sql(s.FIX, INSTALL, body="SELECT event_id, CASE WHEN base_date_time >= install_date THEN 1 ELSE 0 END AS scrubber_fitted FROM fix LEFT JOIN install USING (imo)"))
def scrubber_in_use(spark, d):
    return em.add_fitted(s.fixes(spark, d), installs(spark, d)).select("event_id", "scrubber_fitted")


REMOVAL = "CASE scrubber_tech WHEN 'Dry' THEN 0.99::DOUBLE WHEN 'No Scrubber' THEN 0 ELSE 0.98::DOUBLE END"
DRAIN = "scrubber_tech NOT IN ('Closed Loop','Dry','No Scrubber')"


def so2_sql(fitted, source, keys):
    return f"""SELECT {keys}, round(sum(tot-cap),7) AS so2_air_ton, round(sum(CASE WHEN {DRAIN} THEN cap ELSE 0 END),7) AS so2_washwater_ton,
 round(sum(CASE WHEN {DRAIN} THEN 0 ELSE cap END),7) AS so2_retained_ton, round(sum(tot),7) AS so2_total_ton FROM (SELECT *, CASE WHEN used THEN tot*{REMOVAL} ELSE 0 END AS cap FROM
 (SELECT *, coalesce(fc_total_ton,0)*(CASE WHEN used THEN 2*0.97753::DOUBLE*0.035::DOUBLE ELSE 2*0.97753::DOUBLE*0.001::DOUBLE END) AS tot FROM
 (SELECT *, ({fitted}) AND scrubber_tech<>'No Scrubber' AS used FROM {source}))) GROUP BY {keys}"""


SO2 = {c: 7 for c in em.SO2_COLUMNS}


@query("so2_split", sql(*PORT_CHAIN, body=so2_sql("year(date) >= 2020", "detail", "date, port")))
def so2_split(spark, d):
    detail = em.emission_panel(port_fuel(spark, d), ["date", "port", "vclass", "scrubber_tech"])
    return rounded(em.sulfur_panel(detail, ["date", "port"], 2020).select("date", "port", *em.SO2_COLUMNS), SO2)


@query("so2_by_install_date", sql(*FUEL_CHAIN, INSTALL, "flagged AS (SELECT fuel.*, base_date_time >= install_date AS fit FROM fuel LEFT JOIN install USING (imo))", body=so2_sql("coalesce(fit,false)", "flagged", "date, scrubber_tech")))
def so2_by_install_date(spark, d):
    m = em.add_fitted(fuel(spark, d), installs(spark, d))
    return rounded(em.sulfur_panel(m, ["date", "scrubber_tech"]).select("date", "scrubber_tech", *em.SO2_COLUMNS), SO2)


SCEN = "scen AS (SELECT d.*, scenario FROM detail d, (VALUES ('never fitted'),('fitted from 2020'),('fitted from 2015'),('always fitted')) v(scenario))"


@query("so2_scenarios", sql(*PORT_CHAIN, SCEN, body=so2_sql("CASE scenario WHEN 'never fitted' THEN false WHEN 'fitted from 2020' THEN year(date)>=2020 WHEN 'fitted from 2015' THEN year(date)>=2015 ELSE true END", "scen", "scenario")))
def so2_scenarios(spark, d):
    detail = em.emission_panel(port_fuel(spark, d), ["date", "port", "vclass", "scrubber_tech"])
    return rounded(em.sulfur_scenarios(detail), SO2)


POLL = ", ".join(f"round(sum(coalesce(fc_main_ton,0)*(CASE WHEN vclass IN ('tanker','cargo') THEN {e['main_big']} ELSE {e['main_small']} END)::DOUBLE/1000 + coalesce(fc_AE_ton,0)*{e['aux']}::DOUBLE/1000 + coalesce(fc_boiler_ton,0)*{e['boiler']}::DOUBLE/1000),7) AS {p}_ton"
                 for p, e in em.POLLUTANTS.items())


@query("panel_pollutants", sql(*PORT_CHAIN, body=f"SELECT date, port, {POLL} FROM detail GROUP BY date, port"))
def panel_pollutants(spark, d):
    detail = em.emission_panel(port_fuel(spark, d), ["date", "port", "vclass", "scrubber_tech"])
    out = em.panel_pollutants(detail).groupBy("date", "port").agg(F.sum("nox_ton").alias("nox_ton"), F.sum("pm25_ton").alias("pm25_ton"))
    return rounded(out, {"nox_ton": 7, "pm25_ton": 7})


# ---------------------------------------------------------------- storms
HAV = s.hav_sql("p_lat", "p_lon", "LAT", "LON")
EXPO = f"""prox AS (SELECT t.*, port, {HAV} AS dist_km FROM track t, port WHERE {HAV} <= 500),
life AS (SELECT SID, arg_min(NAME, ISO_TIME) AS name, arg_min(SEASON, ISO_TIME) AS season, CAST(coalesce(max(USA_SSHS), -9) AS INT) AS sshs_storm_lifetime FROM track GROUP BY SID),
expo AS (SELECT p.SID, l.name, l.season, port, min(ISO_TIME) AS exposure_start, max(ISO_TIME) AS exposure_end, round((epoch_us(max(ISO_TIME))-epoch_us(min(ISO_TIME)))/3.6e9,5) AS exposure_hours,
 round(min(dist_km),1) AS min_dist_km, arg_min(ISO_TIME, (dist_km, ISO_TIME)) AS closest_time, arg_min(USA_WIND, (dist_km, ISO_TIME)) AS wind_at_closest_kt, max(USA_SSHS) AS sshs_max_in_window,
 l.sshs_storm_lifetime, max(USA_WIND) AS wind_max_in_window_kt, CAST(max(CASE WHEN LANDFALL=0 THEN 1 ELSE 0 END) AS INT) AS near_land_in_window, CAST(max(CASE WHEN DIST2LAND=0 THEN 1 ELSE 0 END) AS INT) AS landfall_in_window
 FROM prox p JOIN life l USING (SID) GROUP BY p.SID, l.name, l.season, port, l.sshs_storm_lifetime)"""


def exposed(spark, d):
    return ex.exposures(s.tracks(spark, d), s.port_points(spark, d))


@query("storm_exposure", sql(s.TRACK, s.PORT, EXPO, body="SELECT * FROM expo"))
def storm_exposure(spark, d):
    return rounded(exposed(spark, d).drop("pres_at_closest_mb", "sshs_at_closest"), {"exposure_hours": 5})


@query("proximity_track", sql(s.TRACK, s.PORT, EXPO, body="SELECT SID, port, ISO_TIME, round(dist_km,1) AS dist_km, USA_WIND FROM prox"))
def proximity_track(spark, d):
    return ex.proximity_track(s.tracks(spark, d), s.port_points(spark, d)).select("SID", "port", "ISO_TIME", F.round("dist_km", 1).alias("dist_km"), "USA_WIND")


@query("storm_reach", sql(s.TRACK, s.PORT, EXPO, body="SELECT season, name, count(DISTINCT port) AS ports, min(min_dist_km) AS closest, max(sshs_max_in_window) AS max_cat FROM expo GROUP BY season, name ORDER BY ports DESC, season, name LIMIT 10"))
def storm_reach(spark, d):
    return ex.storm_reach(exposed(spark, d))


STATION = "station AS (SELECT 'G' || s_suppkey AS station, s_suppkey AS s_no, 20 + ((s_suppkey*37) % 300)/10::DOUBLE AS s_lat, -100 + ((s_suppkey*53) % 400)/10::DOUBLE AS s_lon FROM supplier)"
NEAR = s.hav_sql("c_lat", "c_lon", "s_lat", "s_lon")
CPOINT = "cpoint AS (SELECT c_custkey, 18 + ((c_custkey*29) % 350)/10::DOUBLE AS c_lat, -105 + ((c_custkey*61) % 500)/10::DOUBLE AS c_lon FROM customer)"


def stations(spark, d):
    return s.table(spark, d, "supplier").selectExpr("concat('G', s_suppkey) AS station", "s_suppkey AS s_no", "20 + ((s_suppkey*37) % 300)/10D AS s_lat", "-100 + ((s_suppkey*53) % 400)/10D AS s_lon")


def points(spark, d):
    return s.table(spark, d, "customer").selectExpr("c_custkey", "18 + ((c_custkey*29) % 350)/10D AS c_lat", "-105 + ((c_custkey*61) % 500)/10D AS c_lon")


NEAREST = f"SELECT c_custkey, arg_min(station, (round({NEAR},9), s_no)) AS station, round(min({NEAR}),5) AS dist_km FROM cpoint, station GROUP BY c_custkey"


@query("nearest_station", sql(STATION, CPOINT, body=NEAREST))
def nearest_station(spark, d):
    out = space.nearest(points(spark, d), stations(spark, d), lat="c_lat", lon="c_lon", t_lat="s_lat", t_lon="s_lon", order="s_no", columns=["station"])
    return rounded(out.select("c_custkey", "station", "dist_km"), {"dist_km": 5})


@query("nearest_within_cap", sql(STATION, CPOINT, body=f"SELECT c_custkey, CASE WHEN dist_km<=60 THEN station END AS station, CASE WHEN dist_km<=60 THEN dist_km END AS dist_km FROM ({NEAREST})"))
def nearest_within_cap(spark, d):
    out = space.nearest(points(spark, d), stations(spark, d), lat="c_lat", lon="c_lon", t_lat="s_lat", t_lon="s_lon", order="s_no", columns=["station"], cap=60.0)
    return rounded(out.select("c_custkey", "station", "dist_km"), {"dist_km": 5})


EXPOSED = """ev AS (SELECT s_suppkey AS SID, 'G' || (s_suppkey % 50) AS st, DATE '2024-01-08' + CAST(s_suppkey % 14 AS INT) AS d0, DATE '2024-01-09' + CAST(s_suppkey % 14 + s_suppkey % 3 AS INT) AS d1 FROM supplier),
obs AS (SELECT 'G' || (user_id % 50) AS station, ts AS t, value AS v, value/40 AS p01i FROM events)"""


@query("station_covariates", sql(EXPOSED, body="""SELECT ev.SID, round(lv.surge,3) AS surge_height_m, round(w.mx,2) AS max_wind_ms, round(r.s*25.4,2) AS rainfall_mm, round(r.m*25.4,2) AS peak_hourly_rain_mm FROM ev
 LEFT JOIN (SELECT SID, max(CASE WHEN t>=d0 AND t<=d1 THEN v END) - coalesce(quantile_cont(CASE WHEN t<d0 OR t>d1 THEN v END,0.5), quantile_cont(v,0.5)) AS surge FROM ev JOIN obs ON st=station AND t>=d0-7 AND t<=d1+7 GROUP BY SID) lv USING (SID)
 LEFT JOIN (SELECT SID, max(v) AS mx FROM ev JOIN obs ON st=station AND t>=d0 AND t<=d1 GROUP BY SID) w USING (SID)
 LEFT JOIN (SELECT SID, sum(h) AS s, max(h) AS m FROM (SELECT SID, date_trunc('hour', t) AS hr, max(p01i) AS h FROM ev JOIN obs ON st=station AND t>=d0 AND t<=d1 GROUP BY ALL) WHERE h<=5 GROUP BY SID) r USING (SID)"""))
def station_covariates(spark, d):
    ev = s.table(spark, d, "supplier").selectExpr(
        "s_suppkey AS SID", "'x' AS port", "concat('G', s_suppkey % 50) AS coops_station", "concat('G', s_suppkey % 50) AS asos_station",
        "CAST(date_add(DATE'2024-01-08', CAST(s_suppkey % 14 AS INT)) AS TIMESTAMP_NTZ) AS exposure_start",
        "CAST(date_add(DATE'2024-01-08', CAST(s_suppkey % 14 + s_suppkey % 3 AS INT)) AS TIMESTAMP_NTZ) AS exposure_end")
    obs = s.table(spark, d, "events").selectExpr("concat('G', user_id % 50) AS station", "ts AS t", "value AS v", "ts AS valid", "value/40 AS p01i")
    out = ex.station_covariates(ev, obs.select("station", "t", "v"), obs.select("station", "t", "v"), obs.select("station", "valid", "p01i"))
    return out.select("SID", "surge_height_m", "max_wind_ms", "rainfall_mm", "peak_hourly_rain_mm")


# ---------------------------------------------------------------- scans, registry
@query("null_rates", """SELECT CAST(ts AS DATE) AS date, count(*) AS n_rows, round(avg(CASE WHEN value > 100 THEN 1 ELSE 0 END),6) AS null_sog, avg(CASE WHEN value > 100 THEN 1.0 ELSE 0 END)::DOUBLE > 0.15 AS error FROM events GROUP BY 1""")
def null_rates(spark, d):
    e = s.table(spark, d, "events").selectExpr("CAST(ts AS DATE) AS date", "CASE WHEN value <= 100 THEN value END AS SOG")
    out = positions.null_rates(e, "date", hard={"SOG": 0.15}, soft={})
    return rounded(out.select("date", "n_rows", F.col("null_SOG").alias("null_sog"), "error"), {"null_sog": 6})


@query("sample_days", """WITH d AS (SELECT date, row_number() OVER (ORDER BY date)-1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders))
 SELECT o.date, count(*) AS n_orders FROM (SELECT CAST(o_orderdate AS DATE) AS date FROM orders) o JOIN d USING (date) WHERE i % greatest(1, n//40)=0 AND i // greatest(1, n//40) < 40 GROUP BY o.date""")
def sample_days(spark, d):
    o = s.table(spark, d, "orders").selectExpr("CAST(o_orderdate AS DATE) AS date")
    return positions.sample_days(o, 40).groupBy("date").agg(F.count(F.lit(1)).alias("n_orders"))


@query("ring_centroid", """WITH r AS (SELECT c_custkey AS k, -90 + (c_custkey % 37)::DOUBLE AS x, 30 + (c_custkey % 11)::DOUBLE AS y, 1 + (c_custkey % 5)::DOUBLE AS a FROM customer),
 e AS (SELECT k, x AS x1, y AS y1, x+a AS x2, y AS y2 FROM r UNION ALL SELECT k, x+a, y, x, y+a FROM r UNION ALL SELECT k, x, y+a, x, y FROM r)
 SELECT k, round(sum((y1+y2)*(x1*y2-x2*y1))/(3*sum(x1*y2-x2*y1)),6) AS lat, round(sum((x1+x2)*(x1*y2-x2*y1))/(3*sum(x1*y2-x2*y1)),6) AS lon FROM e GROUP BY k""")
def ring_centroid(spark, d):
    r = s.table(spark, d, "customer").selectExpr("c_custkey AS k", "-90 + 1D*(c_custkey % 37) AS x", "30 + 1D*(c_custkey % 11) AS y", "1 + 1D*(c_custkey % 5) AS a") \
        .selectExpr("k", "array(named_struct('lon',x,'lat',y), named_struct('lon',x+a,'lat',y), named_struct('lon',x,'lat',y+a), named_struct('lon',x,'lat',y)) AS pts")
    return rounded(r.select("k", geo.ring_centroid("pts").alias("c")).select("k", "c.lat", "c.lon"), {"lat": 6, "lon": 6})


@query("mercator_to_degrees", "SELECT c_custkey AS k, round(degrees(c_custkey*7000/6378137::DOUBLE),8) AS lon, round(degrees(2*atan(exp(c_custkey*3000/6378137::DOUBLE))-pi()/2),8) AS lat FROM customer")
def mercator_to_degrees(spark, d):
    c = s.table(spark, d, "customer").selectExpr("c_custkey AS k", "1D*c_custkey*7000 AS x", "1D*c_custkey*3000 AS y")
    return rounded(c.select("k", geo.mercator_lon("x").alias("lon"), geo.mercator_lat("y").alias("lat")), {"lon": 8, "lat": 8})


@query("built_year_imputation", """WITH p AS (SELECT 1000000 + p_partkey*997 % 3000000 AS imo, p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(1970 + p_size AS INT) END AS yr FROM part),
 b AS (SELECT *, CASE WHEN imo > 1000000 AND imo <= 10000000 THEN CAST(ceil(imo/100000) AS BIGINT) END AS blk FROM p), m AS (SELECT blk, quantile_cont(yr,0.5) AS med FROM b WHERE yr BETWEEN 1900 AND 2030 GROUP BY blk)
 SELECT p_partkey, coalesce(yr, med)::DOUBLE AS year, CASE WHEN yr IS NOT NULL THEN 'status_date' WHEN med IS NOT NULL THEN 'imo_segment' ELSE 'none' END AS built_source FROM b LEFT JOIN m ON b.blk=m.blk""")
def built_year_imputation(spark, d):
    p = s.table(spark, d, "part").selectExpr("1000000 + p_partkey*997 % 3000000 AS imo", "p_partkey", "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(1970 + p_size AS INT) END AS year")
    return registry.impute_built(p).select("p_partkey", "year", "built_source")


@query("type_mapping", """SELECT p_partkey, CASE p_type WHEN 'STANDARD' THEN 'Tanker' WHEN 'ECONOMY' THEN 'Fully Cellular Container' ELSE 'Other Vessel' END AS registry_type,
 CASE p_type WHEN 'STANDARD' THEN 'Oil' WHEN 'ECONOMY' THEN 'Container' ELSE 'Other' END AS model_class, CASE p_type WHEN 'STANDARD' THEN 'tanker' WHEN 'ECONOMY' THEN 'cargo' ELSE 'other' END AS vclass FROM part""")
def type_mapping(spark, d):
    p = s.table(spark, d, "part").selectExpr("p_partkey", "CASE WHEN p_type = 'STANDARD' THEN 'Crude Oil Tanker' WHEN p_type = 'ECONOMY' THEN 'none' ELSE 'other' END AS l5", "CASE WHEN p_type = 'ECONOMY' THEN 'Container' ELSE 'none' END AS main")
    t = p.select("p_partkey", registry.export_type("l5", "main").alias("registry_type"))
    t = t.withColumn("model_class", registry.registry_type_class("registry_type"))
    return t.withColumn("vclass", em.traffic_class("model_class"))


@query("thin_panel", sql(body="""SELECT count(DISTINCT CAST(o_orderdate AS DATE)) FILTER (o_orderstatus = 'F') AS panel_days, count(DISTINCT CAST(o_orderdate AS DATE)) AS input_days,
 count(DISTINCT CAST(o_orderdate AS DATE)) FILTER (o_orderstatus = 'F') < 0.9 * count(DISTINCT CAST(o_orderdate AS DATE)) AS thin FROM orders""").replace("WITH \n", ""))
def thin_panel(spark, d):
    """Whether the days with finished orders, as a panel, cover the days of all orders, its input."""
    days = s.table(spark, d, "orders").selectExpr("CAST(o_orderdate AS DATE) AS date", "o_orderstatus")
    return tr.thin_panel(days.where("o_orderstatus = 'F'"), days, "date")
