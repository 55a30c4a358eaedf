"""Parsers of all sources, fed with text columns made of the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewake.functions.dates import scored_season
from tidewake.operators import emission as em, exposure as ex, lookup
from tidewake.operators.sizing import _shared_folder
from tidewake.plans import event_study
from tidewake.sources import observations, panels, places, positions, registry, tracks
from . import standins as s
from .standins import rounded, sql

Q, SQL = {}, {}


def query(name, text):
    def keep(fn):
        Q[name], SQL[name] = fn, text
        return fn
    return keep


# ---------------------------------------------------------------- positions
@query("parse_positions", """SELECT event_id AS message, user_id AS mmsi, CASE WHEN event_id % 89 = 0 THEN NULL ELSE date_trunc('second', ts) END AS at,
 CASE WHEN event_id % 97 = 0 THEN NULL ELSE 25 + event_id % 15 + 0.5::DOUBLE END AS lat, CAST(event_id % 101 AS BIGINT) AS vessel_type,
 CASE WHEN event_id % 89 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS date FROM events""")
def parse_positions(spark, d):
    text = s.table(spark, d, "events").selectExpr(
        "CAST(event_id AS STRING) AS message", "CAST(user_id AS STRING) AS mmsi",
        "CASE WHEN event_id % 89 = 0 THEN 'bad' ELSE date_format(ts, CASE WHEN event_id % 2 = 0 THEN \"yyyy-MM-dd'T'HH:mm:ss\" ELSE 'yyyy-MM-dd HH:mm:ss' END) END AS base_date_time",
        "CASE WHEN event_id % 97 = 0 THEN 'x' ELSE concat(' ', CAST(25 + event_id % 15 + 0.5D AS STRING)) END AS latitude", "CAST(event_id % 101 AS STRING) AS vessel_type")
    out = positions.canonical(text)
    return out.select(F.col("message").cast("bigint").alias("message"), F.col("MMSI").alias("mmsi"), F.col("BaseDateTime").alias("at"), F.col("LAT").alias("lat"),
                      F.col("VesselType").alias("vessel_type"), F.to_date("BaseDateTime").alias("date"))


@query("merchant_rows", """SELECT event_id, event_id % 1100 AS vessel_type FROM events
 WHERE (event_id % 1100 BETWEEN 70 AND 89 OR event_id % 1100 IN (1003,1004,1016,1017,1024)) AND event_id % 7 <> 0""")
def merchant_rows(spark, d):
    m = s.table(spark, d, "events").selectExpr("event_id", "event_id % 1100 AS VesselType", "ts AS BaseDateTime", "CASE WHEN event_id % 7 = 0 THEN NULL ELSE 1D END AS LAT", "2D AS LON")
    return positions.merchant(m).selectExpr("event_id", "VesselType AS vessel_type")


@query("ship_numbers", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 9000000 + user_id END AS imo FROM events")
def ship_numbers(spark, d):
    m = s.table(spark, d, "events").selectExpr("event_id", "CASE event_id % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN concat('IMO', 9000000 + user_id) WHEN 2 THEN concat(' ', 9000000 + user_id, ' ') ELSE CAST(9000000 + user_id AS STRING) END AS text")
    return m.select("event_id", em.normal_imo("text").alias("imo"))


# ---------------------------------------------------------------- places
NATION_NAME = "CASE n_nationkey % 6 WHEN 0 THEN concat('P', n_nationkey, ', AK') WHEN 1 THEN '  ' ELSE concat(' P', n_nationkey, ', TX ') END"


def features(spark, d):
    """A ring per customer; every fourth one's is in metres, every fifth has a short second part, every seventh is a point."""
    corner = lambda x, y: f"concat('[', CAST({x} AS STRING), ',', CAST({y} AS STRING), ']')"
    ring = f"concat('[', {corner('x', 'y')}, ',', {corner('x + w', 'y')}, ',', {corner('x + w', 'y + w')}, ',', {corner('x', 'y')}, ']')"
    return (s.table(spark, d, "customer").selectExpr("c_custkey AS n_nationkey").selectExpr("n_nationkey", "n_nationkey AS feature_no", f"{NATION_NAME} AS name",
            "CASE WHEN n_nationkey % 4 = 0 THEN -1000000D - 1000*(n_nationkey % 5000) ELSE -90D + n_nationkey % 150 END AS x",
            "CASE WHEN n_nationkey % 4 = 0 THEN 3000000D ELSE 30D END AS y", "CASE WHEN n_nationkey % 4 = 0 THEN 1000D ELSE 1D END AS w")
            .selectExpr("feature_no", "n_nationkey", f"""named_struct('properties', named_struct('PORTNAME', name, 'TYPE', 'Coastal'), 'geometry', named_struct(
              'type', CASE WHEN n_nationkey % 7 = 0 THEN 'Point' WHEN n_nationkey % 5 = 0 THEN 'MultiPolygon' ELSE 'Polygon' END,
              'coordinates', CASE WHEN n_nationkey % 5 = 0 THEN concat('[[', {ring}, '],[[[0,0],[1,1],[0,0]]]]') ELSE concat('[', {ring}, ']') END)) AS _f"""))


FEATURE = """f AS (SELECT n_nationkey AS k, 'P' || n_nationkey || ', TX' AS port, n_nationkey % 4 = 0 AS m, CASE WHEN n_nationkey % 4 = 0 THEN -1000000 - 1000*(n_nationkey % 5000) ELSE -90 + n_nationkey % 150 END::DOUBLE AS x,
 CASE WHEN n_nationkey % 4 = 0 THEN 3000000 ELSE 30 END::DOUBLE AS y, CASE WHEN n_nationkey % 4 = 0 THEN 1000 ELSE 1 END::DOUBLE AS w FROM (SELECT c_custkey AS n_nationkey FROM customer) WHERE n_nationkey % 6 NOT IN (0, 1) AND n_nationkey % 7 <> 0)"""
LON, LAT = "degrees({}/6378137::DOUBLE)", "degrees(2*atan(exp({}/6378137::DOUBLE))-pi()/2)"


@query("polygon_scan", sql(FEATURE, body=f"""SELECT row_number() OVER (ORDER BY k) - 1 AS ring_no, port, 4 AS points, round(CASE WHEN m THEN {LON.format('x')} ELSE x END, 8) AS x0, round(CASE WHEN m THEN {LON.format('(x+w)')} ELSE x+w END, 8) AS x1,
 round(CASE WHEN m THEN {LAT.format('y')} ELSE y END, 8) AS y0, round(CASE WHEN m THEN {LAT.format('(y+w)')} ELSE y+w END, 8) AS y1 FROM f"""))
def polygon_scan(spark, d):
    out = places.polygons(places.parse_features(features(spark, d)))
    return rounded(out.select(F.col("ring_no").cast("bigint").alias("ring_no"), "port", F.size("pts").alias("points"), "x0", "x1", "y0", "y1"), {c: 8 for c in ("x0", "x1", "y0", "y1")})


@query("port_point_scan", sql(FEATURE, body=f"""SELECT port, round(CASE WHEN m THEN {LAT.format('(y+w/3)')} ELSE y+w/3 END, 6) AS p_lat, round(CASE WHEN m THEN {LON.format('(x+2*w/3)')} ELSE x+2*w/3 END, 6) AS p_lon FROM f"""))
def port_point_scan(spark, d):
    return rounded(places.port_points(places.parse_features(features(spark, d))), {"p_lat": 6, "p_lon": 6})


# ---------------------------------------------------------------- tracks
@query("track_scan", """SELECT event_id, 2010 + user_id % 20 AS season, date_trunc('second', ts) AS at, 10 + event_id % 30 + 0.25::DOUBLE AS lat, CASE WHEN event_id % 3 = 0 THEN NULL ELSE (event_id % 120)::DOUBLE END AS wind
 FROM events WHERE user_id % 20 BETWEEN 5 AND 15 AND event_id % 11 <> 0""")
def track_scan(spark, d):
    blank = ", ".join(f"CAST(NULL AS STRING) AS {c}" for c in ("USA_PRES", "USA_SSHS", "LANDFALL", "DIST2LAND"))
    text = s.table(spark, d, "events").selectExpr(
        "CAST(event_id AS STRING) AS SID", "concat(' ', 2010 + user_id % 20) AS SEASON", "'N' AS NAME", "date_format(ts, 'yyyy-MM-dd HH:mm:ss') AS ISO_TIME", "'TS' AS NATURE",
        "CASE WHEN event_id % 11 = 0 THEN ' ' ELSE CAST(10 + event_id % 30 + 0.25D AS STRING) END AS LAT", "'-80.5' AS LON", "CASE WHEN event_id % 3 = 0 THEN '' ELSE CAST(event_id % 120 AS STRING) END AS USA_WIND", blank.split(", ")[0], *blank.split(", ")[1:])
    units = s.table(spark, d, "region").selectExpr("'0' AS SID", "'Year' AS SEASON", "'' AS NAME", "'' AS ISO_TIME", "'' AS NATURE", "'degrees' AS LAT", "'degrees' AS LON", "'kts' AS USA_WIND", *blank.split(", "))
    out = tracks.parse_tracks(units.unionByName(text), 2015, 2025)
    return out.select(F.col("SID").cast("bigint").alias("event_id"), F.col("SEASON").cast("bigint").alias("season"), F.col("ISO_TIME").alias("at"), F.col("LAT").alias("lat"), F.col("USA_WIND").alias("wind"))


@query("track_filters", sql(s.TRACK, body="""SELECT 'range' AS rule, SID, count(*) AS n FROM track WHERE SEASON BETWEEN 2016 AND 2018 GROUP BY SID UNION ALL SELECT 'season', SID, count(*) FROM track WHERE SEASON = 2020 GROUP BY SID
 UNION ALL SELECT 'name', SID, count(*) FROM track WHERE NAME = 'N7' GROUP BY SID"""))
def track_filters(spark, d):
    t = s.tracks(spark, d)
    parts = [ex.select_storms(t, seasons=(2016, 2018)).withColumn("rule", F.lit("range")), ex.select_storms(t, season=2020).withColumn("rule", F.lit("season")),
             ex.select_storms(t, name="n7").withColumn("rule", F.lit("name"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("rule", "SID").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- registry
def register(spark, d):
    """Two rows per ship; the second is a later one with another size, and must lose."""
    c = s.table(spark, d, "customer").selectExpr("c_custkey", "explode(array(0, 1)) AS _row").selectExpr(
        "_row", "'a' AS _file", "CASE WHEN c_custkey % 13 = 0 THEN 'n/a' ELSE CAST(9000000 + c_custkey AS STRING) END AS `IMO Number`",
        "CASE WHEN c_custkey % 17 = 0 THEN '' ELSE concat(1 + c_custkey % 200, ',', lpad(_row, 3, '0')) END AS Dwt",
        "CASE c_custkey % 4 WHEN 0 THEN concat('01-Jul-', lpad((c_custkey % 60) + 30, 2, '0')) WHEN 1 THEN concat('15-Mar-', 1990 + c_custkey % 30) WHEN 2 THEN concat(1990 + c_custkey % 30, '-05-06') ELSE concat('02/03/', 1990 + c_custkey % 30) END AS `Built Date`",
        "CASE c_custkey % 3 WHEN 0 THEN 'Ore Carrier' WHEN 1 THEN 'Cruise Ship' ELSE 'Barge' END AS Type",
        "CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'nan' WHEN 2 THEN ' Hybrid ' ELSE 'Dry' END AS `SOx Scrubber Technology Type`",
        "CASE WHEN c_custkey % 2 = 0 THEN ' y' ELSE 'N' END AS `SOx Scrubber Retrofit Indicator`", "CASE WHEN c_custkey % 6 = 0 THEN '' ELSE '2019-08-09' END AS `SOx Scrubber Retrofit Date`",
        "CASE WHEN c_custkey % 7 = 0 THEN 'Pending' ELSE 'Fitted' END AS `SOx Scrubber Status`")
    return c


# two-digit years from 30 to 89: the parser reads 2030 to 2089, and years past the latest build year go back a century
BUILT = "CASE k % 4 WHEN 0 THEN 1900 + (k % 60) + 30 ELSE 1990 + k % 30 END"


@query("registry_scan", f"""SELECT 9000000 + k AS imo, ((1 + k % 200) * 1000)::DOUBLE AS dwt, CAST({BUILT} AS INT) AS built, CASE k % 3 WHEN 0 THEN 'Bulk' WHEN 1 THEN 'Passenger' ELSE 'Other' END AS vessel_type_str,
 CASE k % 5 WHEN 0 THEN 'Unknown' WHEN 1 THEN 'Unknown' WHEN 2 THEN 'Hybrid' ELSE 'Dry' END AS scrubber_tech FROM (SELECT c_custkey AS k FROM customer) WHERE k % 13 <> 0 AND k % 17 <> 0""")
def registry_scan(spark, d):
    return registry.clean_registry(register(spark, d)).select("imo", "dwt", F.col("built").cast("int").alias("built"), "vessel_type_str", "scrubber_tech")


@query("scrubber_installs", """SELECT 9000000 + k AS imo, CASE WHEN k % 2 = 0 THEN DATE '2019-08-09' WHEN k % 4 = 1 THEN make_date(1990 + k % 30, 3, 15) ELSE make_date(1990 + k % 30, 2, 3) END AS install_date
 FROM (SELECT c_custkey AS k FROM customer) WHERE k % 13 <> 0 AND k % 7 <> 0 AND NOT (k % 2 = 0 AND k % 6 = 0)""")
def scrubber_installs(spark, d):
    return registry.clean_installs(register(spark, d))


@query("vessel_export", """WITH v AS (SELECT 1000000 + (c_custkey*7) % 5000000 AS imo, c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 1980 + c_custkey % 40 END AS y FROM customer),
 b AS (SELECT *, CASE WHEN imo > 1000000 THEN CAST(ceil(imo/100000) AS BIGINT) END AS blk FROM v WHERE k % 9 <> 0), m AS (SELECT blk, quantile_cont(y, 0.5) AS med FROM b WHERE y IS NOT NULL GROUP BY blk),
 r AS (SELECT imo, k, CAST(round_even(coalesce(y, med), 0) AS INT) AS built, CASE WHEN y IS NOT NULL THEN 'status_date' WHEN med IS NOT NULL THEN 'imo_segment' ELSE 'none' END AS built_source FROM b LEFT JOIN m ON b.blk = m.blk)
 SELECT imo, CASE k % 3 WHEN 0 THEN 'Tanker' WHEN 1 THEN 'Ro-Ro' ELSE 'Other Vessel' END AS type, (k % 300)::DOUBLE AS dwt, built_source, '01-Jul-' || built AS built_date, CASE WHEN k % 2 = 0 THEN 'Open' ELSE 'No Scrubber' END AS tech FROM r WHERE k % 300 > 0 AND built IS NOT NULL""")
def vessel_export(spark, d):
    e = s.table(spark, d, "customer").selectExpr(
        "CASE WHEN c_custkey % 9 = 0 THEN 'x' ELSE CAST(1000000 + (c_custkey*7) % 5000000 AS STRING) END AS IMO_Number", "CASE c_custkey % 3 WHEN 0 THEN 'Crude Oil Tanker' ELSE 'none' END AS Shiptype_Level_5",
        "CASE c_custkey % 3 WHEN 1 THEN 'RoRo' ELSE 'none' END AS Main_Vessel_Type", "CAST(c_custkey % 300 AS STRING) AS DWT",
        "CASE WHEN c_custkey % 4 = 0 THEN 'Laid Up' ELSE ' In Service/Commission ' END AS Ship_Status", "concat(1980 + c_custkey % 40, '-01-02') AS Ship_Status_Effective_Date")
    tech = s.table(spark, d, "customer").filter("c_custkey % 2 = 0").selectExpr("CAST(1000000 + (c_custkey*7) % 5000000 AS STRING) AS `IMO Number`", "'Open' AS `SOx Scrubber Technology Type`")
    out = registry.build_fleet(e, tech)
    return out.select(F.col("`IMO Number`").alias("imo"), F.col("Type").alias("type"), F.col("Dwt").alias("dwt"), "built_source", F.col("`Built Date`").alias("built_date"), F.col("`SOx Scrubber Technology Type`").alias("tech"))


# ---------------------------------------------------------------- panels
@query("wide_panel", """SELECT make_date(2015, 1, i::INT) AS date, 'N' || n_nationkey AS port, (n_nationkey * i)::BIGINT AS vessels_present FROM (SELECT c_custkey AS n_nationkey FROM customer), (VALUES (1),(2),(13)) t(i) WHERE n_nationkey % 5 <> i % 5""")
def wide_panel(spark, d):
    wide = s.table(spark, d, "customer").selectExpr("c_custkey AS n_nationkey").selectExpr("n_nationkey AS portid", *[f"CASE WHEN n_nationkey % 5 = {i} % 5 THEN NULL ELSE n_nationkey * {i} END AS `{name}`" for i, name in ((1, "2015-01-01"), (2, "1/2/2015"), (13, "2015-01-13"))])
    names = s.table(spark, d, "customer").selectExpr("c_custkey AS id", "concat('N', c_custkey) AS name")
    return panels.wide_to_long(wide, names, "portid")


@query("panel_scan", """SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS date, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS hours FROM lineitem""")
def panel_scan(spark, d):
    text = s.table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "date_format(l_shipdate, 'yyyy-MM-dd') AS date", "CASE WHEN l_linenumber = 3 THEN 'none' ELSE CAST(l_quantity AS STRING) END AS hours", "l_tax AS extra")
    return panels.parse_panel(text, ["l_orderkey", "l_linenumber", "date", "hours"], types={"hours": "double"})


@query("study_units", sql(s.PANEL, body="SELECT unit, date, vclass, round(sum(hours), 2) AS hours FROM panel WHERE tier <> 'O' AND unit IN (SELECT n_regionkey FROM nation WHERE n_nationkey < 12) GROUP BY unit, date, vclass"))
def study_units(spark, d):
    p = s.panel(spark, d).withColumn("tier", F.when(F.col("tier") == "O", panels.OUTSIDE).otherwise(F.col("tier")))
    reached = s.table(spark, d, "nation").filter("n_nationkey < 12").selectExpr("n_regionkey AS port")
    return rounded(panels.study_panel(p, reached, "unit").groupBy("unit", "date", "vclass").agg(F.sum("hours").alias("hours")), {"hours": 2})


@query("released_rows", """SELECT o_orderkey, CAST(substr(CAST(2010 + o_orderkey % 15 AS VARCHAR), 1, 4) AS INT) AS season, CAST(o_orderdate AS DATE) AS started, (o_orderkey % 500)::DOUBLE AS min_dist_km FROM orders""")
def released_rows(spark, d):
    it = s.table(spark, d, "orders").selectExpr("concat(2010 + o_orderkey % 15, 'N', o_orderkey) AS SID", "CAST(o_orderkey AS STRING) AS port", "date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') AS start_date",
                                                "date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') AS end_date", "CAST(o_orderkey % 500 AS DOUBLE) AS DISTANCE", "1 AS SSHS", "50D AS WIND", "0 AS IF_LANDFALL")
    out = panels.released_exposures(it)
    return out.select(F.col("port").cast("bigint").alias("o_orderkey"), "season", F.to_date("exposure_start").alias("started"), "min_dist_km")


@query("active_measures", """SELECT 'discount' AS measure, round(avg(CASE WHEN l_discount > 0 THEN 1 ELSE 0 END), 8) AS active_share, avg(CASE WHEN l_discount > 0 THEN 1 ELSE 0 END) < 0.05 AS empty FROM lineitem UNION ALL
 SELECT 'rare', round(avg(CASE WHEN l_orderkey % 40 = 0 THEN 1 ELSE 0 END), 8), avg(CASE WHEN l_orderkey % 40 = 0 THEN 1 ELSE 0 END) < 0.05 FROM lineitem""")
def active_measures(spark, d):
    p = s.table(spark, d, "lineitem").selectExpr("l_discount AS discount", "CASE WHEN l_orderkey % 40 = 0 THEN 1 END AS rare")
    return rounded(panels.active_share(p, ["discount", "rare"]), {"active_share": 8})


@query("sink_by_day", "SELECT CAST(ts AS DATE) AS date, event_type, count(*) AS n FROM events GROUP BY ALL")
def sink_by_day(spark, d):
    """Written by day, the last day twice, and read back: only its partition is replaced."""
    daily = s.table(spark, d, "events").selectExpr("CAST(ts AS DATE) AS date", "event_type").groupBy("date", "event_type").agg(F.count(F.lit(1)).alias("n"))
    folder = f"{_shared_folder(spark)}/days-{uuid.uuid4().hex}"
    panels.write_days(daily, folder)
    last = daily.agg(F.max("date")).first()[0]
    panels.write_days(daily.filter(F.col("date") == F.lit(last)), folder)
    return panels.parse_panel(spark.read.parquet(folder), ["date", "event_type", "n"])


@query("unfinished_days", "SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders WHERE CAST(o_orderdate AS DATE) NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderkey % 3 = 0) GROUP BY 1")
def unfinished_days(spark, d):
    o = s.table(spark, d, "orders").selectExpr("o_orderkey", "CAST(o_orderdate AS DATE) AS date")
    return panels.new_days(o, o.filter("o_orderkey % 3 = 0")).groupBy("date").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- observations
@query("airport_catalogue", """SELECT 'A' || s_suppkey AS station, (s_suppkey % 50)::DOUBLE + 0.5::DOUBLE AS s_lat FROM supplier WHERE s_suppkey % 4 IN (0, 1) AND s_suppkey % 6 <> 0""")
def airport_catalogue(spark, d):
    raw = s.table(spark, d, "supplier").selectExpr("concat('A', s_suppkey) AS stid", "s_name AS station_name", "CASE s_suppkey % 4 WHEN 0 THEN 'TX_ASOS' WHEN 1 THEN 'LA_ASOS' WHEN 2 THEN 'ZZ_ASOS' ELSE 'TX_RWIS' END AS iem_network",
                                                   "CASE WHEN s_suppkey % 6 = 0 THEN 'M' ELSE CAST((s_suppkey % 50) + 0.5D AS STRING) END AS lat", "'-90.25' AS lon")
    return observations.airport_stations(raw).select("station", "s_lat")


@query("gauge_catalogue", "SELECT 'G' || s_suppkey AS station, s_name AS name, (s_suppkey % 50)::DOUBLE AS s_lat FROM supplier WHERE s_suppkey % 5 <> 0")
def gauge_catalogue(spark, d):
    raw = s.table(spark, d, "supplier").selectExpr("array(named_struct('id', concat('G', s_suppkey), 'name', s_name, 'lat', CASE WHEN s_suppkey % 5 <> 0 THEN CAST(s_suppkey % 50 AS DOUBLE) END, 'lng', -90D)) AS stations")
    return observations.gauge_stations(raw).select("station", "name", "s_lat")


@query("level_series", """SELECT 'U' || (user_id % 50) AS station, date_trunc('hour', ts) AS t, round(arg_max(value, event_id), 6) AS v FROM events WHERE event_id % 10 <> 0 GROUP BY 1, 2""")
def level_series(spark, d):
    raw = (s.table(spark, d, "events").selectExpr("concat('U', user_id % 50) AS station", "event_id", "date_format(date_trunc('hour', ts), 'yyyy-MM-dd HH:mm') AS t", "CASE WHEN event_id % 10 = 0 THEN '' ELSE CAST(value AS STRING) END AS v")
           .groupBy("station").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "t", "v"))), lambda r: F.struct(r["t"].alias("t"), r["v"].alias("v"), F.lit("0").alias("s"))).alias("data"))
           .withColumn("predictions", F.array().cast("array<struct<t:string,v:string,s:string>>")))
    return rounded(observations.parse_series(raw), {"v": 6})


@query("rain_rows", "SELECT event_id, date_trunc('second', ts) AS valid, round(value, 6) AS p01i FROM events WHERE event_id % 8 <> 0")
def rain_rows(spark, d):
    raw = s.table(spark, d, "events").selectExpr("CAST(event_id AS STRING) AS station", "date_format(ts, 'yyyy-MM-dd HH:mm:ss') AS valid", "CASE WHEN event_id % 8 = 0 THEN 'T' ELSE concat(' ', CAST(value AS STRING)) END AS p01i")
    return rounded(observations.parse_rain(raw).select(F.col("station").cast("bigint").alias("event_id"), "valid", "p01i"), {"p01i": 6})


# ---------------------------------------------------------------- events and lookups
@query("season_eligible", """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 20 AS INT) AS b FROM orders)
 SELECT o_orderkey, NOT (month(a) = 1) AND NOT (month(b) = 12 AND day(b) > 10) AS eligible FROM o""")
def season_eligible(spark, d):
    o = s.table(spark, d, "orders").selectExpr("o_orderkey", "CAST(o_orderdate AS DATE) AS a", "date_add(CAST(o_orderdate AS DATE), CAST(o_orderkey % 20 AS INT)) AS b")
    return o.select("o_orderkey", scored_season("a", "b").alias("eligible"))


@query("event_covariates", sql(s.EVENT, body="SELECT SID, unit, CASE WHEN SID % 3 = 0 THEN NULL ELSE SID * 0.5::DOUBLE END AS surge_height_m, CASE WHEN SID % 3 = 0 THEN NULL ELSE (SID % 40)::DOUBLE END AS max_wind_ms FROM event"))
def event_covariates(spark, d):
    e = s.events(spark, d).select("SID", "unit")
    seen = e.filter("SID % 3 <> 0").selectExpr("SID", "unit", "SID * 0.5D AS surge_height_m", "CAST(SID % 40 AS DOUBLE) AS max_wind_ms", "0D AS rainfall_mm")
    return event_study.with_covariates(e, seen).select("SID", "unit", "surge_height_m", "max_wind_ms")


@query("dimension_lookup", "SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN c_mktsegment ELSE 'unknown' END AS layout FROM orders JOIN customer ON o_custkey = c_custkey")
def dimension_lookup(spark, d):
    traits = s.table(spark, d, "customer").filter("c_custkey % 2 = 0").selectExpr("c_custkey AS o_custkey", "c_mktsegment AS layout")
    return lookup.lookup_join(s.table(spark, d, "orders").select("o_orderkey", "o_custkey"), traits, "o_custkey", {"layout": "unknown"}).select("o_orderkey", "layout")


@query("first_row_per_key", "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_min(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus FROM orders GROUP BY o_custkey")
def first_row_per_key(spark, d):
    o = s.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return lookup.first_per_key(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")
