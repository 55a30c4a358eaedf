"""Domain tables derived from the driver tables, in Spark and as SQL text.

Attributes are computed from keys with integer arithmetic, so both engines see the same
values. Every row of a source table is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewake.operators.sizing import checkpointed

CLASSES = ["Container", "Bulk", "Oil", "Passenger", "Other-Liquids"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
TECHS = ["Open Loop", "Closed Loop", "Hybrid", "Membrane", "Dry", "TBC", "Unknown", "No Scrubber"]
STATUS = {"click": 0, "error": 1, "purchase": 5, "signup": 5, "view": 1}
BAND_TABLES = ["p_main", "v_design", "ae_sea", "ae_berth", "ae_anchor", "boiler"]


def draw_sql(draw: str, slot: str, size: str, seed: int) -> str:
    """Index in 0..size-1: the first 15 hex digits of md5('seed|draw|slot') modulo size."""
    return f"((('0x' || substr(md5(concat_ws('|', {seed}, {draw}, {slot})), 1, 15))::BIGINT) % ({size}))"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _case(col: str, pairs) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in pairs) + " END"


def _nth(expr: str, items) -> str:
    return "CASE " + expr + " " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(items)) + " END"


# ---------------------------------------------------------------- positions and ships
def fixes(spark, d):
    return table(spark, d, "events").selectExpr(
        "event_id", "user_id AS imo", "ts AS base_date_time", "CAST(ts AS DATE) AS date", "value / 5 AS sog",
        _case("event_type", STATUS.items()) + " AS status",
        "-98 + ((user_id*131 + event_id*17) % 3000) / 100D AS longitude",
        "25 + ((user_id*71 + event_id*29) % 1500) / 100D AS latitude")


def ships(spark, d):
    return table(spark, d, "customer").selectExpr(
        "c_custkey AS imo", "CAST(1000 + (c_custkey*7919) % 250000 AS DOUBLE) AS dwt",
        "CAST(1975 + c_custkey % 45 AS INT) AS built",
        _case("c_mktsegment", [(s, f"'{c}'") for s, c in zip(SEGMENTS, CLASSES)]) + " AS vessel_type_str",
        _nth("c_custkey % 8", TECHS) + " AS scrubber_tech")


def bands(spark, d):
    names = ", ".join(f"'{t}'" for t in BAND_TABLES)
    return (table(spark, d, "region")
            .selectExpr("r_regionkey AS r", f"explode(array({names})) AS table")
            .selectExpr("*", "posexplode(array(0D, 50000D, 150000D)) AS (band_no, lo)")
            .selectExpr("table", _nth("r", CLASSES) + " AS vessel_type_str", "lo",
                        "CASE band_no WHEN 0 THEN 50000D WHEN 1 THEN 150000D END AS hi", "band_no",
                        "CASE table WHEN 'p_main' THEN 8000D + 1500*r + 4000*band_no WHEN 'v_design' THEN 13D + r + band_no "
                        "WHEN 'ae_sea' THEN 900D + 100*r + 300*band_no WHEN 'ae_berth' THEN 500D + 60*r + 150*band_no "
                        "WHEN 'ae_anchor' THEN 600D + 50*r + 200*band_no ELSE 200D + 40*r + 100*band_no END AS value")
            .filter("NOT (vessel_type_str = 'Other-Liquids' AND table IN ('p_main', 'v_design'))"))


def rings(spark, d):
    """Two pentagons per nation; the second is shifted so that it overlaps the first."""
    corners = [(-1.5, -0.75), (1.5, -0.75), (2.0, 0.5), (0.0, 1.2), (-2.0, 0.5), (-1.5, -0.75)]
    pts = ", ".join(f"named_struct('lon', cx + {x}D, 'lat', cy + {y}D)" for x, y in corners)
    return (table(spark, d, "nation")
            .selectExpr("n_nationkey AS k", "explode(array(0, 1)) AS v")
            .selectExpr("k + 25*v AS ring_no", "concat(CASE WHEN v = 0 THEN 'P' ELSE 'Q' END, k) AS port",
                        "-98 + 6*(k % 5) + 3 + 1D*v AS cx", "25 + 3*(k div 5) + 1.5D AS cy")
            .selectExpr("ring_no", "port", f"array({pts}) AS pts", "cx - 2D AS x0", "cx + 2D AS x1",
                        "cy - 0.75D AS y0", "cy + 1.2D AS y1"))


def port_points(spark, d):
    return table(spark, d, "nation").selectExpr(
        "concat('P', n_nationkey) AS port", "n_nationkey AS port_no",
        "-98 + 6*(n_nationkey % 5) + 3D AS p_lon", "25 + 3*(n_nationkey div 5) + 1.5D AS p_lat")


def tracks(spark, d):
    """Every user is a storm; its events are the track points."""
    return table(spark, d, "events").selectExpr(
        "concat('S', user_id) AS SID", "concat('N', user_id % 40) AS NAME", "CAST(2015 + user_id % 9 AS INT) AS SEASON",
        "ts AS ISO_TIME", "-98 + ((user_id*131 + event_id*17) % 3000) / 100D AS LON",
        "25 + ((user_id*71 + event_id*29) % 1500) / 100D AS LAT", "value AS USA_WIND", "1010 - value / 10 AS USA_PRES",
        "CAST(CASE WHEN user_id % 7 = 0 THEN NULL ELSE event_id % 6 END AS DOUBLE) AS USA_SSHS",
        "CAST(event_id % 5 AS DOUBLE) AS LANDFALL", "CAST(event_id % 3 AS DOUBLE) AS DIST2LAND")


FIX = f"""fix AS (SELECT event_id, user_id AS imo, ts AS base_date_time, CAST(ts AS DATE) AS date, value / 5 AS sog,
  {_case("event_type", STATUS.items())} AS status,
  -98 + ((user_id*131 + event_id*17) % 3000) / 100::DOUBLE AS longitude,
  25 + ((user_id*71 + event_id*29) % 1500) / 100::DOUBLE AS latitude FROM events)"""
SHIP = f"""ship AS (SELECT c_custkey AS imo, CAST(1000 + (c_custkey*7919) % 250000 AS DOUBLE) AS dwt,
  CAST(1975 + c_custkey % 45 AS INT) AS built,
  {_case("c_mktsegment", [(s, f"'{c}'") for s, c in zip(SEGMENTS, CLASSES)])} AS vessel_type_str,
  {_nth("c_custkey % 8", TECHS)} AS scrubber_tech FROM customer)"""
BAND = f"""band AS (SELECT tb, {_nth("r", CLASSES)} AS vessel_type_str, lo, hi, band_no, value FROM (
  SELECT tb, r_regionkey AS r, band_no, CASE band_no WHEN 0 THEN 0 WHEN 1 THEN 50000 ELSE 150000 END AS lo,
   CASE band_no WHEN 0 THEN 50000 WHEN 1 THEN 150000 END AS hi,
   CASE tb WHEN 'p_main' THEN 8000::DOUBLE + 1500*r_regionkey + 4000*band_no WHEN 'v_design' THEN 13::DOUBLE + r_regionkey + band_no
    WHEN 'ae_sea' THEN 900::DOUBLE + 100*r_regionkey + 300*band_no WHEN 'ae_berth' THEN 500::DOUBLE + 60*r_regionkey + 150*band_no
    WHEN 'ae_anchor' THEN 600::DOUBLE + 50*r_regionkey + 200*band_no ELSE 200::DOUBLE + 40*r_regionkey + 100*band_no END AS value
  FROM region, (VALUES ('p_main'),('v_design'),('ae_sea'),('ae_berth'),('ae_anchor'),('boiler')) t(tb), (VALUES (0),(1),(2)) b(band_no))
  WHERE NOT (r = 4 AND tb IN ('p_main','v_design')))"""
RING = """ring AS (SELECT n_nationkey + 25*v AS ring_no, (CASE WHEN v = 0 THEN 'P' ELSE 'Q' END) || n_nationkey AS port,
  -98 + 6*(n_nationkey % 5) + 3 + 1::DOUBLE*v AS cx, 25 + 3*(n_nationkey // 5) + 1.5::DOUBLE AS cy
  FROM nation, (VALUES (0),(1)) t(v)),
corner AS (SELECT * FROM (VALUES (0,-1.5::DOUBLE,-0.75::DOUBLE,1.5::DOUBLE,-0.75::DOUBLE),(1,1.5,-0.75,2.0,0.5),(2,2.0,0.5,0.0,1.2),
  (3,0.0,1.2,-2.0,0.5),(4,-2.0,0.5,-1.5,-0.75)) c(e, ax, ay, bx, b_y)),
edge AS (SELECT ring_no, port, cx - 2 AS x0, cx + 2 AS x1, cy - 0.75::DOUBLE AS y0, cy + 1.2::DOUBLE AS y1,
  cx + ax AS ex1, cy + ay AS ey1, cx + bx AS ex2, cy + b_y AS ey2 FROM ring, corner)"""
INSIDE = """inside AS (SELECT event_id, ring_no, port FROM fix JOIN edge
   ON longitude >= x0 AND longitude <= x1 AND latitude >= y0 AND latitude <= y1
  GROUP BY event_id, ring_no, port
  HAVING sum(CASE WHEN (ey1 > latitude) <> (ey2 > latitude) AND longitude < (ex2-ex1)*(latitude-ey1)/(ey2-ey1)+ex1
    THEN 1 ELSE 0 END) % 2 = 1),
located AS (SELECT event_id, arg_min(port, ring_no) AS port FROM inside GROUP BY event_id)"""
PORT = """port AS (SELECT 'P' || n_nationkey AS port, n_nationkey AS port_no, -98 + 6*(n_nationkey % 5) + 3::DOUBLE AS p_lon,
  25 + 3*(n_nationkey // 5) + 1.5::DOUBLE AS p_lat FROM nation)"""
TRACK = """track AS (SELECT 'S' || user_id AS SID, 'N' || (user_id % 40) AS NAME, CAST(2015 + user_id % 9 AS INT) AS SEASON,
  ts AS ISO_TIME, -98 + ((user_id*131 + event_id*17) % 3000) / 100::DOUBLE AS LON,
  25 + ((user_id*71 + event_id*29) % 1500) / 100::DOUBLE AS LAT, value AS USA_WIND, 1010 - value / 10 AS USA_PRES,
  CAST(CASE WHEN user_id % 7 = 0 THEN NULL ELSE event_id % 6 END AS DOUBLE) AS USA_SSHS,
  CAST(event_id % 5 AS DOUBLE) AS LANDFALL, CAST(event_id % 3 AS DOUBLE) AS DIST2LAND FROM events)"""


def hav_sql(a1, o1, a2, o2):
    h = (f"sin((radians({a2})-radians({a1}))/2)*sin((radians({a2})-radians({a1}))/2) + cos(radians({a1}))*cos(radians({a2}))"
         f"*sin((radians({o2})-radians({o1}))/2)*sin((radians({o2})-radians({o1}))/2)")
    return f"(2*6371.0::DOUBLE*asin(sqrt(least(greatest({h}, 0), 1))))"


def planar_sql(a1, o1, a2, o2):
    dx = f"(({o1}-{o2})*111.32::DOUBLE*cos(radians({a1})))"
    dy = f"(({a1}-{a2})*110.57::DOUBLE)"
    return f"sqrt({dx}*{dx} + {dy}*{dy})"


# messages with credited intervals, then fuel, as one chain of CTEs
CREDIT = """speedy AS (SELECT fix.*, dwt, built, vessel_type_str, scrubber_tech FROM fix JOIN ship USING (imo)
  WHERE sog IS NOT NULL AND sog >= 0 AND sog < 40),
gap AS (SELECT *, coalesce(epoch_us(base_date_time) - lag(epoch_us(base_date_time))
   OVER (PARTITION BY imo, date ORDER BY base_date_time, event_id), 0) / 3.6e9 AS raw_h FROM speedy),
credit AS (SELECT *, CASE WHEN raw_h > 3 THEN 0 ELSE raw_h END AS dt_h FROM gap)"""
ENGINE = """engine AS (SELECT imo, max(CASE WHEN tb='p_main' THEN value END) AS p_main, max(CASE WHEN tb='v_design' THEN value END) AS v_design,
  max(CASE WHEN tb='ae_sea' THEN value END) AS ae_sea, max(CASE WHEN tb='ae_berth' THEN value END) AS ae_berth,
  max(CASE WHEN tb='ae_anchor' THEN value END) AS ae_anchor, max(CASE WHEN tb='boiler' THEN value END) AS boiler
  FROM ship s LEFT JOIN band b ON s.vessel_type_str=b.vessel_type_str AND dwt >= lo AND (hi IS NULL OR dwt < hi) GROUP BY imo)"""
FUEL = """m1 AS (SELECT c.*, p_main, ae_sea, ae_berth, ae_anchor, boiler, v_design*(CASE WHEN vessel_type_str='Passenger' THEN 0.70
    WHEN vessel_type_str='Container' AND dwt>=203000 THEN 0.75 ELSE 1.0 END)::DOUBLE AS v_eff,
  (CASE WHEN vessel_type_str IN ('Container','Bulk','Oil') THEN (CASE WHEN built<1984 THEN 205 WHEN built<2001 THEN 185 ELSE 175 END)
    ELSE (CASE WHEN built<1984 THEN 215 WHEN built<2001 THEN 195 ELSE 185 END) END)::DOUBLE AS sm,
  (CASE WHEN built<1984 THEN 225 WHEN built<2001 THEN 205 ELSE 195 END)::DOUBLE AS sa
  FROM credit c LEFT JOIN engine USING (imo)),
m2 AS (SELECT *, CASE WHEN v_eff > 0 THEN sog/v_eff ELSE 0 END AS sr FROM m1),
m3 AS (SELECT *, CASE WHEN sog<=1 THEN 'berth' WHEN sog<=3 THEN 'anchor' WHEN sr>=0.3::DOUBLE THEN 'cruise' ELSE 'maneuver' END AS phase FROM m2),
m4 AS (SELECT *, CASE WHEN phase IN ('cruise','maneuver') THEN (CASE WHEN p_main IS NULL THEN NULL ELSE least(greatest(p_main*sr*sr*sr*1.15::DOUBLE,0),0.85::DOUBLE*p_main) END) ELSE 0 END AS P_ME,
  CASE phase WHEN 'cruise' THEN ae_sea WHEN 'maneuver' THEN 0.5::DOUBLE*(ae_sea+ae_anchor) WHEN 'anchor' THEN ae_anchor ELSE ae_berth END AS P_AE,
  CASE WHEN phase='cruise' THEN boiler*0 ELSE boiler END AS P_boiler FROM m3),
m5 AS (SELECT *, least(greatest(CASE WHEN p_main>0 THEN P_ME/p_main ELSE 0 END, 0.07::DOUBLE), 1) AS lm,
  least(greatest(CASE WHEN ae_sea>0 THEN P_AE/ae_sea ELSE 0 END, 0.07::DOUBLE), 1) AS la FROM m4),
m6 AS (SELECT *, CASE WHEN P_ME>0 THEN sm*(0.455::DOUBLE*lm*lm - 0.71::DOUBLE*lm + 1.28::DOUBLE) ELSE 0 END AS sfm,
  sa*(0.455::DOUBLE*la*la - 0.71::DOUBLE*la + 1.28::DOUBLE) AS sfa FROM m5),
m7 AS (SELECT *, P_ME*sfm*dt_h/1e6 AS fc_main_ton, P_AE*sfa*dt_h/1e6 AS fc_AE_ton, P_boiler*340*dt_h/1e6 AS fc_boiler_ton FROM m6),
fuel AS (SELECT *, fc_main_ton+fc_AE_ton+fc_boiler_ton AS fc_total_ton, (fc_main_ton+fc_AE_ton+fc_boiler_ton)*3.114::DOUBLE AS co2_ton FROM m7)"""
VCLASS = ("CASE WHEN vessel_type_str IN ('Container','Bulk') THEN 'cargo' WHEN vessel_type_str IN ('Oil','Other-Liquids') THEN 'tanker' "
          "WHEN vessel_type_str='Passenger' THEN 'passenger' ELSE 'other' END")

# ---------------------------------------------------------------- daily panel and events
FIRST_YEAR, LAST_YEAR = 1995, 2000


def panel(spark, d):
    """Daily activity per region from line items: calls, hours, co2, fuel.

    Panels are stored tables in practice: the line items are read once, here.
    """
    li = table(spark, d, "lineitem")
    su = table(spark, d, "supplier").join(table(spark, d, "nation"), F.expr("s_nationkey = n_nationkey"))
    return checkpointed(
            li.join(su, li["l_suppkey"] == su["s_suppkey"])
            .selectExpr("n_regionkey AS unit", "CAST(l_shipdate AS DATE) AS date", "l_returnflag AS vclass",
                        "l_linestatus AS tier", "l_suppkey", "l_quantity AS hours", "l_extendedprice / 1000 AS co2_ton",
                        "l_extendedprice * l_discount / 1000 AS fc_main_ton", "l_extendedprice * l_tax / 1000 AS fc_AE_ton",
                        "l_quantity * l_tax AS fc_boiler_ton")
            .groupBy("unit", "date", "vclass", "tier")
            .agg(F.count(F.lit(1)).alias("calls"), F.sum("hours").alias("hours"), F.sum("co2_ton").alias("co2_ton"),
                 F.sum("fc_main_ton").alias("fc_main_ton"), F.sum("fc_AE_ton").alias("fc_AE_ton"),
                 F.sum("fc_boiler_ton").alias("fc_boiler_ton")))


def daily(spark, d):
    return panel(spark, d).groupBy("unit", "date").agg(
        F.sum("calls").alias("calls"), F.sum("hours").alias("hours"), F.sum("co2_ton").alias("co2_ton"))


def events(spark, d):
    """Every supplier is one exposure of its region; the year depends on the region so that
    some baseline years stay free at every scale."""
    return (table(spark, d, "supplier").join(table(spark, d, "nation"), F.expr("s_nationkey = n_nationkey"))
            .selectExpr("s_suppkey AS SID", "n_regionkey AS unit", "concat('T', (s_suppkey*7) % 20) AS storm",
                        "date_add(make_date(1996 + (n_regionkey*2 + s_suppkey % (2 + n_regionkey % 3)) % 5, 4, 1), "
                        "CAST((s_suppkey*13) % 200 AS INT)) AS start",
                        "30 + (s_suppkey*7) % 90 AS wind", "(s_suppkey*31) % 500 AS dist", "CAST(s_suppkey % 5 AS INT) AS len")
            .selectExpr("SID", "unit", "storm", "start", "date_add(start, len) AS end", "wind", "dist", "len + 1 AS k_days"))


PANEL = """panel AS (SELECT n_regionkey AS unit, CAST(l_shipdate AS DATE) AS date, l_returnflag AS vclass, l_linestatus AS tier,
  count(*) AS calls, sum(l_quantity) AS hours, sum(l_extendedprice / 1000) AS co2_ton, sum(l_extendedprice*l_discount/1000) AS fc_main_ton,
  sum(l_extendedprice*l_tax/1000) AS fc_AE_ton, sum(l_quantity*l_tax) AS fc_boiler_ton
  FROM lineitem JOIN supplier ON l_suppkey=s_suppkey JOIN nation ON s_nationkey=n_nationkey GROUP BY ALL)"""
DAILY = "daily AS (SELECT unit, date, sum(calls)::BIGINT AS calls, sum(hours) AS hours, sum(co2_ton) AS co2_ton FROM panel GROUP BY unit, date)"
EVENT = """event AS (SELECT SID, unit, storm, "start", "start" + len::INT AS "end", wind, dist, len + 1 AS k_days FROM (
  SELECT s_suppkey AS SID, n_regionkey AS unit, 'T' || ((s_suppkey*7) % 20) AS storm,
  make_date(1996 + (n_regionkey*2 + s_suppkey % (2 + n_regionkey % 3)) % 5, 4, 1) + CAST((s_suppkey*13) % 200 AS INT) AS "start",
  30 + (s_suppkey*7) % 90 AS wind, (s_suppkey*31) % 500 AS dist, CAST(s_suppkey % 5 AS INT) AS len
  FROM supplier JOIN nation ON s_nationkey=n_nationkey))"""
DAYS = "days AS (SELECT DISTINCT date FROM panel)"


def sql(*parts: str, body: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + body


def rounded(df: DataFrame, digits: dict) -> DataFrame:
    """Round the named columns; an entry maps a column to its decimals."""
    return df.select(*[F.round(F.col(c), digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])
