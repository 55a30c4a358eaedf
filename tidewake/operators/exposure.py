"""Operational tier maps, storm exposures and observed covariates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewake.functions import geo
from tidewake.functions.binning import first_match
from tidewake.functions.dates import day_range
from tidewake.functions.numeric import hours_between
from .quantiles import exact_quantiles
from .space import nearest, within_km

# fixed values of the tier map
FINE_DEG, COARSE_DEG = 0.005, 0.05
MIN_CELL_MESSAGES = 20
MOORED, AT_ANCHOR, UNDERWAY_SPEED = 5, 1, 3.0
APPROACH_KM, HOLD_KM, CHANNEL_KM = 30.0, 100.0, 25.0
VERTEX_STRIDE = 25

EXPOSURE_KM = 500.0
REFERENCE_DAYS = 7
MAX_HOURLY_RAIN_IN = 5.0
MM_PER_INCH = 25.4


def cell_counts(positions: DataFrame, *, lat: str, lon: str, sog: str, status: str,
                imo: str | None = None, resolutions=(FINE_DEG, COARSE_DEG)) -> DataFrame:
    """Messages per cell by what the ship was doing, at all resolutions in one scan."""
    df = positions.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    if imo:
        df = df.filter(F.trim(F.coalesce(F.col(imo).cast("string"), F.lit(""))) != "")
    moving = F.coalesce(F.col(sog), F.lit(0.0)) >= UNDERWAY_SPEED
    state = F.col(status).cast("int")
    tally = lambda c: F.sum(F.when(c, 1).otherwise(0))
    res = F.col("res_deg")
    return (df.withColumn("res_deg", F.explode(F.array(*[F.lit(float(r)) for r in resolutions])))
            .withColumn("gy", F.rint(F.col(lat) / res).cast("long"))
            .withColumn("gx", F.rint(F.col(lon) / res).cast("long"))
            .groupBy("res_deg", "gy", "gx")
            .agg(F.count(F.lit(1)).alias("n_msg"),
                 tally((state == MOORED) & ~moving).alias("n_moored"),
                 tally((state == AT_ANCHOR) & ~moving).alias("n_anchored"),
                 tally(moving).alias("n_underway"))
            .withColumn("lat", F.col("gy") * res).withColumn("lon", F.col("gx") * res))


def ring_vertices(rings: DataFrame, stride: int = VERTEX_STRIDE) -> DataFrame:
    """Every stride-th vertex of each ring: ring_no, pos, port, v_lat, v_lon."""
    return (rings.select("ring_no", "port", F.posexplode("pts").alias("pos", "_p"))
            .filter(F.col("pos") % stride == 0)
            .select("ring_no", "pos", "port", F.col("_p.lat").alias("v_lat"), F.col("_p.lon").alias("v_lon")))


def tier_map(counts: DataFrame, vertices: DataFrame, *, fine: float = FINE_DEG,
             coarse: float = COARSE_DEG, min_messages: int = MIN_CELL_MESSAGES) -> DataFrame:
    """Label cells: fine cells where ships mostly stop become port, anchorage, offshore_hold
    or offshore; coarse cells where they mostly move become channel or offshore."""
    stopped = F.col("n_moored") + F.col("n_anchored")
    resting = stopped >= F.col("n_underway")
    is_fine = F.abs(F.col("res_deg") - fine) < 1e-9
    kept = counts.filter((F.col("n_msg") >= min_messages)
                         & ((is_fine & resting & (stopped > 0))
                            | (~is_fine & ~resting & (F.col("n_underway") > 0))))
    placed = nearest(kept, vertices, lat="lat", lon="lon", t_lat="v_lat", t_lon="v_lon",
                     order=["ring_no", "pos"], columns=["port"], out="d_km", metric="planar")
    tier = first_match([
        (is_fine & (F.col("n_moored") > F.col("n_anchored")), "port"),
        (is_fine & (F.col("d_km") <= APPROACH_KM), "anchorage"),
        (is_fine & (F.col("d_km") <= HOLD_KM), "offshore_hold"),
        (~is_fine & (F.col("d_km") <= CHANNEL_KM), "channel")], "offshore")
    return placed.withColumn("tier", tier).withColumnRenamed("port", "complex")


def proximity_track(track: DataFrame, ports: DataFrame, km: float = EXPOSURE_KM) -> DataFrame:
    """Track points within km of a port. track: SID, NAME, SEASON, ISO_TIME, LAT, LON, ...;
    ports: port, p_lat, p_lon."""
    return within_km(track, ports, lat="LAT", lon="LON", c_lat="p_lat", c_lon="p_lon", km=km)


def exposures(track: DataFrame, ports: DataFrame, km: float = EXPOSURE_KM) -> DataFrame:
    """One row per storm and port inside the buffer. The closest point is the first of the
    equally close ones; land flags and maxima count only the points inside."""
    near = proximity_track(track, ports, km)
    life = track.groupBy("SID").agg(
        F.min_by("NAME", "ISO_TIME").alias("name"), F.min_by("SEASON", "ISO_TIME").alias("season"),
        F.coalesce(F.max("USA_SSHS"), F.lit(-9)).cast("int").alias("sshs_storm_lifetime"))
    at = F.struct("ISO_TIME", "USA_WIND", "USA_PRES", "USA_SSHS")
    flag = lambda c: F.max(F.when(F.col(c) == 0, 1).otherwise(0))
    rows = near.groupBy("SID", "port").agg(
        F.min("ISO_TIME").alias("exposure_start"), F.max("ISO_TIME").alias("exposure_end"),
        F.min("dist_km").alias("_d"), F.min_by(at, F.struct("dist_km", "ISO_TIME")).alias("_at"),
        F.max("USA_SSHS").alias("sshs_max_in_window"), F.max("USA_WIND").alias("wind_max_in_window_kt"),
        flag("LANDFALL").alias("near_land_in_window"), flag("DIST2LAND").alias("landfall_in_window"))
    return rows.join(life, "SID").select(
        "SID", "name", "season", "port", "exposure_start", "exposure_end",
        hours_between("exposure_start", "exposure_end").alias("exposure_hours"),
        F.round("_d", 1).alias("min_dist_km"), F.col("_at.ISO_TIME").alias("closest_time"),
        F.col("_at.USA_WIND").alias("wind_at_closest_kt"), F.col("_at.USA_PRES").alias("pres_at_closest_mb"),
        F.col("_at.USA_SSHS").alias("sshs_at_closest"), "sshs_max_in_window", "sshs_storm_lifetime",
        "wind_max_in_window_kt", "near_land_in_window", "landfall_in_window")


def storm_reach(exposed: DataFrame, top: int | None = 10) -> DataFrame:
    """Ports reached, closest distance and top category per storm, widest first."""
    out = exposed.groupBy("season", "name").agg(
        F.count_distinct("port").alias("ports"), F.min("min_dist_km").alias("closest"),
        F.max("sshs_max_in_window").alias("max_cat"))
    out = out.orderBy(F.desc("ports"), "season", "name")
    return out.limit(top) if top else out


def select_storms(track: DataFrame, seasons=None, season=None, name=None) -> DataFrame:
    """Track rows of a season range, one season or one name (any case)."""
    out = track
    if seasons:
        out = out.filter(F.col("SEASON").between(*seasons))
    if season is not None:
        out = out.filter(F.col("SEASON") == season)
    return out if name is None else out.filter(F.upper("NAME") == name.upper())


def nearest_station(ports: DataFrame, stations: DataFrame, prefix: str, cap: float | None = None) -> DataFrame:
    """Add <prefix>_station and <prefix>_dist_km of the nearest station. stations: station,
    s_lat, s_lon, s_no (catalogue order)."""
    out = nearest(ports, stations, lat="p_lat", lon="p_lon", t_lat="s_lat", t_lon="s_lon",
                  order="s_no", columns=["station"], out=f"{prefix}_dist_km", cap=cap)
    return (out.withColumnRenamed("station", f"{prefix}_station")
            .withColumn(f"{prefix}_dist_km", F.round(f"{prefix}_dist_km", 1)))


def station_covariates(exposed: DataFrame, levels: DataFrame, winds: DataFrame, rain: DataFrame,
                       *, keys=("SID", "port"), reference_days: int = REFERENCE_DAYS) -> DataFrame:
    """Surge, wind and rain observed around each exposure.

    exposed: keys, exposure_start, exposure_end, coops_station, asos_station. levels and
    winds: station, t, v; rain: station, valid, p01i. Surge = highest level in the window
    minus the median level of the surrounding calm days (of all days if there are none).
    Observations meet windows by station and day. Exposures of a station on the same days share one window, so the work grows with
    the observations and the calendar, not with observations times exposures.
    """
    keys = list(keys)
    first = F.to_date("exposure_start")
    last = F.date_add(F.to_date("exposure_end"), 1)
    ev = exposed.withColumns({"_d0": first, "_d1": last})

    def meet(obs, station, time, pad):
        days = ev.select(station, "_d0", "_d1").distinct().withColumn("_day", F.explode(day_range(F.date_sub("_d0", pad), F.date_add("_d1", pad))))
        o = obs.withColumn("_day", F.to_date(time)).withColumnRenamed("station", station)
        lo, hi = F.col("_d0").cast("timestamp_ntz"), F.col("_d1").cast("timestamp_ntz")
        t = F.col(time).cast("timestamp_ntz")
        whole = (t >= F.date_sub("_d0", pad).cast("timestamp_ntz")) & (t <= F.date_add("_d1", pad).cast("timestamp_ntz"))
        return days.join(o, [station, "_day"]).filter(whole).withColumn("_in", (t >= lo) & (t <= hi))

    at_level, at_rain = (["coops_station", "_d0", "_d1"], ["asos_station", "_d0", "_d1"])
    around = meet(levels, "coops_station", "t", reference_days)
    level = around.groupBy(*at_level).agg(F.max(F.when(F.col("_in"), F.col("v"))).alias("_peak"))
    calm = exact_quantiles(around.filter(~F.col("_in")), at_level, "v", {"_calm": 0.5})
    whole = exact_quantiles(around, at_level, "v", {"_all": 0.5})
    level = level.join(calm, at_level, "left").join(whole, at_level, "left")
    wind = meet(winds, "coops_station", "t", 0).groupBy(*at_level).agg(F.max("v").alias("_wind"))
    hourly = (meet(rain, "asos_station", "valid", 0)
              .groupBy(*at_rain, F.date_trunc("hour", "valid").alias("_hour")).agg(F.max("p01i").alias("_in_h"))
              .filter(F.col("_in_h") <= MAX_HOURLY_RAIN_IN))
    wet = hourly.groupBy(*at_rain).agg(F.sum("_in_h").alias("_sum"), F.max("_in_h").alias("_max"))
    return (ev.join(level, at_level, "left").join(wind, at_level, "left").join(wet, at_rain, "left")
            .select(*keys, *[c for c in exposed.columns if c not in keys], "_peak", "_calm", "_all", "_wind", "_sum", "_max")
            .withColumn("surge_height_m", F.round(F.col("_peak") - F.coalesce("_calm", "_all"), 3))
            .withColumn("max_wind_ms", F.round("_wind", 2))
            .withColumn("rainfall_mm", F.round(F.col("_sum") * MM_PER_INCH, 2))
            .withColumn("peak_hourly_rain_mm", F.round(F.col("_max") * MM_PER_INCH, 2))
            .drop("_peak", "_calm", "_all", "_wind", "_sum", "_max"))
