"""Place storms from their distances to known ports, and ports from their distances to storms.

A fix is the point that minimises the squared distance residuals. One row per fix holds its anchors and the ports near enough to matter,
both found by joins on cells; a worker runs damped Gauss-Newton steps from a grid of starts, all at once. Along a storm, the
candidates of its fixes are chosen in time order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewake.functions import geo
from .sizing import checkpointed, spread
from .space import within_km

BUFFER_KM, FAR_WEIGHT = 500.0, 0.5
MIN_ANCHORS, MAX_CANDIDATES, DISTINCT_KM = 3, 3, 30.0
JUMP_KM, JUMP_WEIGHT = 150.0, 50.0
GOOD_RMS_KM, MIN_GOOD_FIXES, MAX_MOVE_KM = 40.0, 5, 150.0
START_DEGREES = (-6, -3, 0, 3, 6)
#: How far from the mean of its anchors a fix may lie; only ports within this and the buffer can add to its cost.
REACH_KM, STEPS = 2500.0, 60


def _residuals(points: np.ndarray, near: np.ndarray, distance: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Residuals of each point (lat, lon) at the anchors and at ports that did not see the storm, and their derivatives north and east
    in km per km."""
    place = np.radians(np.concatenate([near, far]))
    lat, lon = np.radians(points[:, :1]), np.radians(points[:, 1:])
    dlon = place[None, :, 1] - lon
    cosine = np.clip(np.sin(lat) * np.sin(place[:, 0]) + np.cos(lat) * np.cos(place[:, 0]) * np.cos(dlon), -1, 1)
    half = np.sin((place[None, :, 0] - lat) / 2) ** 2 + np.cos(lat) * np.cos(place[None, :, 0]) * np.sin(dlon / 2) ** 2
    km = 2 * geo.EARTH_RADIUS_KM * np.arcsin(np.sqrt(np.clip(half, 0, 1)))
    sine = np.maximum(np.sqrt(1 - cosine ** 2), 1e-9)
    north = -(np.cos(lat) * np.sin(place[None, :, 0]) - np.sin(lat) * np.cos(place[None, :, 0]) * np.cos(dlon)) / sine
    east = -np.cos(place[None, :, 0]) * np.sin(dlon) / sine
    n = len(near)
    short = FAR_WEIGHT * np.maximum(BUFFER_KM - km[:, n:], 0)
    inside = -FAR_WEIGHT * (km[:, n:] < BUFFER_KM)
    slopes = np.stack([np.concatenate([north[:, :n], north[:, n:] * inside], axis=1), np.concatenate([east[:, :n], east[:, n:] * inside], axis=1)], axis=2)
    return np.concatenate([km[:, :n] - distance, short], axis=1), slopes


def fit_points(starts: np.ndarray, near: np.ndarray, distance: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points reached from all starts by damped Gauss-Newton steps, and their squared residuals."""
    points, damping = starts.astype(float).copy(), np.full(len(starts), 1e-2)
    rest, slopes = _residuals(points, near, distance, far)
    cost = (rest ** 2).sum(axis=1)
    for _ in range(STEPS):
        curve = np.einsum("pki,pkj->pij", slopes, slopes)
        curve = curve + damping[:, None, None] * (np.eye(2) * np.trace(curve, axis1=1, axis2=2)[:, None, None] + 1e-9 * np.eye(2))
        step = -np.linalg.solve(curve, np.einsum("pki,pk->pi", slopes, rest)[:, :, None])[:, :, 0]
        step *= np.minimum(1, 500 / np.maximum(np.linalg.norm(step, axis=1), 1e-12))[:, None]
        scale = np.degrees(1 / geo.EARTH_RADIUS_KM)
        moved = points + np.stack([step[:, 0] * scale, step[:, 1] * scale / np.maximum(np.cos(np.radians(points[:, 0])), 0.01)], axis=1)
        moved[:, 0] = np.clip(moved[:, 0], -89.9, 89.9)
        new_rest, new_slopes = _residuals(moved, near, distance, far)
        new_cost = (new_rest ** 2).sum(axis=1)
        better = new_cost < cost
        points[better], rest[better], slopes[better], cost[better] = moved[better], new_rest[better], new_slopes[better], new_cost[better]
        damping = np.where(better, np.maximum(damping / 4, 1e-9), damping * 4)
        if (damping > 1e12).all() or (np.linalg.norm(step, axis=1) < 1e-9).all():
            break
    return points, cost


def _km(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = np.radians(a), np.radians(b)
    half = np.sin((a[..., 0] - b[..., 0]) / 2) ** 2 + np.cos(a[..., 0]) * np.cos(b[..., 0]) * np.sin((a[..., 1] - b[..., 1]) / 2) ** 2
    return 2 * geo.EARTH_RADIUS_KM * np.arcsin(np.sqrt(np.clip(half, 0, 1)))


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best points of each fix that are at least DISTINCT_KM apart."""
    grid = np.array([(dy, dx) for dy in START_DEGREES for dx in START_DEGREES], float)
    kind = pa.list_(pa.struct([("cost", pa.float64()), ("lat", pa.float64()), ("lon", pa.float64())]))
    for batch in batches:
        out = []
        for near, far in zip(batch.column("_near").to_pylist(), batch.column("_far").to_pylist()):
            anchors = np.array([(p["lat"], p["lon"]) for p in near])
            others = np.array([(p["lat"], p["lon"]) for p in far or []]).reshape(-1, 2)
            middle = anchors.mean(axis=0)
            points, cost = fit_points(middle + grid, anchors, np.array([p["d"] for p in near]), others)
            kept: list[int] = []
            for i in np.argsort(cost, kind="stable"):
                if len(kept) < MAX_CANDIDATES and _km(points[i], middle) <= REACH_KM and all(_km(points[i], points[k]) >= DISTINCT_KM for k in kept):
                    kept.append(int(i))
            out.append([{"cost": cost[i], "lat": points[i, 0], "lon": points[i, 1]} for i in kept])
        yield pa.record_batch([*[batch.column(c) for c in ("SID", "time", "_near", "n_ports")], pa.array(out, kind)], names=["SID", "time", "_near", "n_ports", "candidates"])


def locate_storms(track: DataFrame, ports: DataFrame) -> DataFrame:
    """One fix per storm and time with at least three known ports: SID, time, lat, lon, rms_km,
    n_ports. track: SID, time, port, dist_km; ports: port, p_lat, p_lon.

    Each fix offers up to three candidates; along a storm the cheapest is taken, with a charge
    for jumps beyond 150 km.
    """
    known = track.join(ports, "port")
    place = F.struct(F.col("p_lat").alias("lat"), F.col("p_lon").alias("lon"), F.col("dist_km").alias("d"))
    fixes = known.groupBy("SID", "time").agg(
        F.collect_list(place).alias("_near"), F.collect_set("port").alias("_ports"), F.avg("p_lat").alias("_lat"),
        F.avg("p_lon").alias("_lon"), F.count(F.lit(1)).alias("n_ports")).filter(F.col("n_ports") >= MIN_ANCHORS)
    centre = fixes.select("SID", "time", "_lat", "_lon", "_ports")
    around = within_km(centre, ports.select("port", "p_lat", "p_lon"), lat="_lat", lon="_lon", c_lat="p_lat", c_lon="p_lon", km=REACH_KM + BUFFER_KM, cell=6)
    unseen = (around.where(~F.array_contains("_ports", F.col("port"))).groupBy("SID", "time")
              .agg(F.collect_list(F.struct(F.col("p_lat").alias("lat"), F.col("p_lon").alias("lon"))).alias("_far")))
    rows = spread(fixes.select("SID", "time", "_near", "n_ports").join(unseen, ["SID", "time"], "left"), "SID", "time")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    offered = rows.mapInArrow(_candidates, f"SID {kinds['SID']}, time {kinds['time']}, _near {kinds['_near']}, n_ports bigint, candidates array<struct<cost:double,lat:double,lon:double>>").where(F.size("candidates") > 0)
    path = offered.groupBy("SID").agg(F.sort_array(F.collect_list(F.struct("time", "candidates", "n_ports", "_near"))).alias("_path"))

    def choose(acc, x):
        jump = lambda c: F.when(F.size(acc) > 0, JUMP_WEIGHT * F.greatest(
            geo.haversine_km(c["lat"], c["lon"], F.get(acc, F.size(acc) - 1)["lat"], F.get(acc, F.size(acc) - 1)["lon"]) - JUMP_KM, F.lit(0.0))).otherwise(0.0)
        best = F.array_min(F.transform(x["candidates"], lambda c: F.struct((c["cost"] + jump(c)).alias("total"), c["lat"].alias("lat"), c["lon"].alias("lon"))))
        rms = F.sqrt(F.aggregate(x["_near"], F.lit(0.0), lambda s, p: s + F.pow(geo.haversine_km(best["lat"], best["lon"], p["lat"], p["lon"]) - p["d"], F.lit(2.0))) / F.size(x["_near"]))
        return F.concat(acc, F.array(F.struct(x["time"].alias("time"), best["lat"].alias("lat"), best["lon"].alias("lon"),
                                              rms.alias("rms_km"), x["n_ports"].alias("n_ports"))))

    kind = dict(track.dtypes)["time"]
    none = F.array().cast(f"array<struct<time:{kind},lat:double,lon:double,rms_km:double,n_ports:bigint>>")
    return (path.withColumn("_f", F.explode(F.aggregate("_path", none, choose)))
            .select("SID", "_f.time", "_f.lat", "_f.lon", "_f.rms_km", "_f.n_ports"))


def refine_ports(track: DataFrame, fixes: DataFrame, ports: DataFrame, steps: int = 8) -> DataFrame:
    """Move each port to where its good fixes put it, unless that is more than 150 km away.

    Least squares by Gauss-Newton: a step is one sum of moments per port, so the fixes of a port
    are never gathered.
    """
    good = checkpointed(track.join(
        fixes.filter(F.col("rms_km") < GOOD_RMS_KM).select("SID", "time", F.col("lat").alias("_flat"), F.col("lon").alias("_flon")),
        ["SID", "time"]).select("port", "_flat", "_flon", "dist_km"))
    enough = good.groupBy("port").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= MIN_GOOD_FIXES).select("port")
    here = ports.join(enough, "port", "left_semi").withColumnsRenamed({"p_lat": "lat", "p_lon": "lon"})
    north = (F.col("lat") - F.col("_flat")) * geo.KM_PER_LAT_DEGREE
    scale = geo.KM_PER_LON_DEGREE * F.cos(F.radians("lat"))
    east = (F.col("lon") - F.col("_flon")) * scale
    for _ in range(steps):
        rows = good.join(here, "port").withColumn("_d", F.hypot(north, east)).filter(F.col("_d") > 1e-6)
        u, v = north / F.col("_d"), east / F.col("_d")
        r = F.col("dist_km") - geo.haversine_km("lat", "lon", "_flat", "_flon")
        m = rows.groupBy("port", "lat", "lon").agg(
            F.sum(u * u).alias("a"), F.sum(u * v).alias("b"), F.sum(v * v).alias("c"), F.sum(u * r).alias("e"), F.sum(v * r).alias("f"))
        det = F.col("a") * F.col("c") - F.col("b") * F.col("b")
        dn = F.coalesce(F.try_divide(F.col("c") * F.col("e") - F.col("b") * F.col("f"), det), F.lit(0.0))
        de = F.coalesce(F.try_divide(F.col("a") * F.col("f") - F.col("b") * F.col("e"), det), F.lit(0.0))
        here = m.select("port", (F.col("lat") + dn / geo.KM_PER_LAT_DEGREE).alias("lat"), (F.col("lon") + de / scale).alias("lon"))
    moved = ports.join(here, "port", "left")
    near = F.coalesce(geo.haversine_km("lat", "lon", "p_lat", "p_lon") < MAX_MOVE_KM, F.lit(False))
    return moved.select("port", F.when(near, F.col("lat")).otherwise(F.col("p_lat")).alias("p_lat"),
                        F.when(near, F.col("lon")).otherwise(F.col("p_lon")).alias("p_lon"))


def locate(track: DataFrame, ports: DataFrame, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """(fixes, ports) after alternating both steps. Lineage is cut after each round."""
    placed = ports
    for _ in range(rounds):
        placed = checkpointed(refine_ports(track, checkpointed(locate_storms(track, placed)), placed))
    return locate_storms(track, placed), placed


def distance_errors(track: DataFrame, fixes: DataFrame, ports: DataFrame) -> DataFrame:
    """Per port: root mean square of predicted minus reported distance, and the fixes used."""
    m = track.join(fixes, ["SID", "time"]).join(ports, "port")
    err = geo.haversine_km("lat", "lon", "p_lat", "p_lon") - F.col("dist_km")
    return m.groupBy("port").agg(F.sqrt(F.avg(err * err)).alias("rms_km"), F.count(F.lit(1)).alias("n_fixes"))
