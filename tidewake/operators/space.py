"""Spatial assignment as equi-joins on grid cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tidewake.functions import geo
from .sizing import checkpointed

SLACK = 1e-9


# ---------------------------------------------------------------- point in polygon
def ring_index(rings: DataFrame, cell_lon: float = 0.5, cell_lat: float = 0.05) -> DataFrame:
    """Grid index of rings: (cx, cy) -> candidates in ring order.

    Each cell keeps only the edges a ray starting in it can meet: those crossing its
    latitude strip and not lying wholly to its west. A point then tests a handful of
    edges instead of the whole outline.
    """
    axis = lambda lo, hi, size: F.explode(F.sequence(geo.cell_index(lo, size),
                                                     geo.cell_index(hi, size)))
    cells = (rings.withColumn("_edges", geo.ring_edges("pts"))
             .withColumn("cx", axis("x0", "x1", cell_lon))
             .withColumn("cy", axis("y0", "y1", cell_lat)))
    south, west = F.col("cy") * cell_lat, F.col("cx") * cell_lon
    reachable = lambda e: ((F.greatest(e["y1"], e["y2"]) >= south - SLACK)
                           & (F.least(e["y1"], e["y2"]) <= south + cell_lat + SLACK)
                           & (F.greatest(e["x1"], e["x2"]) >= west - SLACK))
    entry = F.struct("ring_no", "port", "x0", "x1", "y0", "y1",
                     F.filter("_edges", reachable).alias("edges"))
    return (cells.groupBy("cx", "cy")
            .agg(F.sort_array(F.collect_list(entry)).alias("candidates")))


def assign_polygon(df: DataFrame, lon: str, lat: str, rings: DataFrame, out: str = "port",
                   cell_lon: float = 0.5, cell_lat: float = 0.05) -> DataFrame:
    """Add the name of the first ring (by ring_no) that holds the point, NULL for none.

    rings: ring_no, port, pts, x0, x1, y0, y1 (see sources.places). Every ring counts as
    its own polygon, so a hole is inside. With a broadcast index this is one projection
    over the positions: no shuffle and no extra rows.
    """
    x, y = F.col(lon), F.col(lat)
    index = ring_index(rings, cell_lon, cell_lat)
    holds = lambda c: ((x >= c["x0"]) & (x <= c["x1"]) & (y >= c["y0"]) & (y <= c["y1"])
                       & geo.ray_parity(x, y, c["edges"]))
    return (df.withColumn("cx", geo.cell_index(x, cell_lon))
            .withColumn("cy", geo.cell_index(y, cell_lat))
            .join(index, ["cx", "cy"], "left")
            .withColumn(out, F.get(F.filter("candidates", holds), F.lit(0))["port"])
            .drop("cx", "cy", "candidates"))


# ---------------------------------------------------------------- cell maps
def assign_cell(df: DataFrame, lat: str, lon: str, cell_map: DataFrame,
                resolutions=(0.005, 0.05), columns=("complex", "tier")) -> DataFrame:
    """Look positions up in a cell map (res_deg, gy, gx, columns), finest resolution first."""
    out = df
    hits = []
    for i, res in enumerate(sorted(resolutions)):
        level = (cell_map.filter(F.abs(F.col("res_deg") - res) < res * 1e-6)
                 .select(F.col("gy").cast("long").alias("_gy"), F.col("gx").cast("long").alias("_gx"),
                         F.struct(*columns).alias(f"_hit{i}")))
        out = (out.withColumn("_gy", geo.rounded_cell(lat, res))
               .withColumn("_gx", geo.rounded_cell(lon, res))
               .join(level, ["_gy", "_gx"], "left").drop("_gy", "_gx"))
        hits.append(F.col(f"_hit{i}"))
    found = F.coalesce(*hits)
    return (out.select("*", *[found[c].alias(c) for c in columns])
            .drop(*[f"_hit{i}" for i in range(len(hits))]))


# ---------------------------------------------------------------- distance joins
def _lon_reach(lat, km):
    """Half-width in degrees of longitude that a circle of km around lat can span."""
    r = km / F.lit(geo.EARTH_RADIUS_KM)
    spread = F.try_divide(F.sin(r), F.cos(F.radians(lat)))
    pole = (F.abs(lat) + F.degrees(r) >= 89.0) | (r >= math.pi / 2) | (spread >= 1)
    return F.when(pole, F.lit(180.0)).otherwise(F.degrees(F.asin(spread)) * 1.01 + 0.01)


def within_km(points: DataFrame, centers: DataFrame, *, lat: str, lon: str, c_lat: str,
              c_lon: str, km: float, out: str = "dist_km", cell: int = 1) -> DataFrame:
    """Pairs of points and centers at most km apart (great circle).

    Centers are copied to the cells their circle can touch, so the join is on cells and
    each point meets only nearby centers. Longitude wraps at the date line.
    """
    n = 360 // cell
    half = km / geo.KM_PER_LAT_DEGREE + 0.01
    span = _lon_reach(F.col(c_lat), F.lit(float(km)))
    west, east = (F.floor((F.col(c_lon) + s * span) / cell).cast("long") for s in (-1, 1))
    wrap = lambda c: F.pmod(c + n // 2, F.lit(n)) - n // 2
    cols = F.when(span >= 180.0, F.sequence(F.lit(-(n // 2)), F.lit(n - n // 2 - 1)).cast("array<bigint>")) \
        .otherwise(F.array_distinct(F.transform(F.sequence(west, east), wrap)))
    reach = (centers.withColumn("_cx", F.explode(cols))
             .withColumn("_cy", F.explode(F.sequence(geo.cell_index(F.col(c_lat) - half, cell),
                                                     geo.cell_index(F.col(c_lat) + half, cell)))))
    keyed = (points.withColumn("_cx", wrap(geo.cell_index(lon, cell)))
             .withColumn("_cy", geo.cell_index(lat, cell)))
    return (keyed.join(reach, ["_cx", "_cy"]).drop("_cx", "_cy")
            .withColumn(out, geo.haversine_km(c_lat, c_lon, lat, lon))
            .filter(F.col(out) <= km))


#: Target places in a leaf of the search tree, levels below the whole map (each 16 x 16 cells), and copies of a tree row so that many
#: points in one cell meet it in different tasks.
LEAF_PLACES, TREE_LEVELS, TREE_COPIES = 32, 7, 16
_NODE = ["level", "cx", "cy", "leaf", "south", "north", "west", "east"]


def _cell(fine: Column, level: Column) -> Column:
    """Cell of a level from the cell of the finest one."""
    return F.call_function("shiftright", fine, (F.lit(TREE_LEVELS) - level) * 4)


def search_tree(places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(children, leaves) of a tree over places (_tlat, _tlon and anything else), cut where places are dense.

    A cell with over LEAF_PLACES places is cut into 16 x 16, down to cells of some ten centimetres. children: level, cx, cy of a cut cell and
    an array of what it holds, with the bounds of the places in each; leaves: level, cx, cy and the array of its places.
    """
    unit = 360.0 / 16 ** TREE_LEVELS
    keyed = places.withColumn("_fx", F.floor((F.col("_tlon") + 180.0) / unit)).withColumn("_fy", F.floor((F.col("_tlat") + 90.0) / unit))
    each = (keyed.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(TREE_LEVELS))))
            .withColumn("cx", _cell(F.col("_fx"), F.col("level"))).withColumn("cy", _cell(F.col("_fy"), F.col("level"))))
    counts = each.groupBy("level", "cx", "cy").agg(F.count(F.lit(1)).alias("_n"), F.min("_tlat").alias("south"), F.max("_tlat").alias("north"), F.min("_tlon").alias("west"), F.max("_tlon").alias("east"))
    nodes = checkpointed(counts.withColumn("leaf", (F.col("_n") <= LEAF_PLACES) | (F.col("level") == TREE_LEVELS)))
    up = F.call_function("shiftright", F.col("cx"), F.lit(4)), F.call_function("shiftright", F.col("cy"), F.lit(4))
    cut = nodes.where(~F.col("leaf")).select(F.col("level").alias("_pl"), F.col("cx").alias("_px"), F.col("cy").alias("_py"))
    inner = nodes.where("level > 0").withColumns({"_pl": F.col("level") - 1, "_px": up[0], "_py": up[1]})
    kept = inner.join(cut, ["_pl", "_px", "_py"], "left_semi")
    children = kept.groupBy("_pl", "_px", "_py").agg(F.collect_list(F.struct(*_NODE)).alias("nodes")).select(F.col("_pl").alias("level"), F.col("_px").alias("cx"), F.col("_py").alias("cy"), "nodes")
    root = nodes.where("level = 0").groupBy().agg(F.collect_list(F.struct(*_NODE)).alias("nodes")).select(F.lit(-1).alias("level"), F.lit(0).cast("bigint").alias("cx"), F.lit(0).cast("bigint").alias("cy"), "nodes")
    ends = kept.where("leaf").unionByName(nodes.where("level = 0 AND leaf"), allowMissingColumns=True).select("level", "cx", "cy")
    leaves = each.join(ends, ["level", "cx", "cy"]).groupBy("level", "cx", "cy").agg(F.collect_list(F.struct(*places.columns)).alias("places"))
    return checkpointed(children.unionByName(root)), checkpointed(leaves)


def _bounds(metric: str, lat, lon, n) -> tuple[Column, Column]:
    """Least and largest distance that a place in the bounds of node n can have from a point."""
    if metric == "planar":
        scale = geo.KM_PER_LON_DEGREE * F.cos(F.radians(lat))
        outside = lambda x, lo, hi: F.greatest(lo - x, x - hi, F.lit(0.0))
        across = lambda x, lo, hi: F.greatest(hi - x, x - lo)
        return (F.hypot(outside(lat, n["south"], n["north"]) * geo.KM_PER_LAT_DEGREE, outside(lon, n["west"], n["east"]) * scale),
                F.hypot(across(lat, n["south"], n["north"]) * geo.KM_PER_LAT_DEGREE, across(lon, n["west"], n["east"]) * scale))
    middle = geo.haversine_km(lat, lon, (n["south"] + n["north"]) / 2, (n["west"] + n["east"]) / 2)
    widest = F.cos(F.radians(F.greatest(n["south"], -n["north"], F.lit(0.0))))        # along a parallel, after going along the meridian
    radius = geo.EARTH_RADIUS_KM * (F.radians(n["north"] - n["south"]) + widest * F.radians(n["east"] - n["west"])) / 2
    return F.greatest(middle - radius, F.lit(0.0)), middle + radius


def _promising(rows: DataFrame, metric: str, cap: float | None) -> DataFrame:
    """Rows (_lat, _lon, _n) of nodes that may hold the nearest place: none is farther than the nearest that some node of the point is
    sure to have."""
    least, most = _bounds(metric, F.col("_lat"), F.col("_lon"), F.col("_n"))
    per = (rows.withColumn("_least", least).withColumn("_most", most).groupBy("_lat", "_lon")
           .agg(F.min("_most").alias("_sure"), F.collect_list(F.struct("_n", "_least")).alias("_all")))
    sure = F.col("_sure") if cap is None else F.least("_sure", F.lit(float(cap)))
    return (per.select("_lat", "_lon", sure.alias("_sure"), F.explode("_all").alias("_e")).where(F.col("_e._least") <= F.col("_sure") * (1 + 1e-9) + 1e-6)
            .select("_lat", "_lon", "_e._n"))


def _dealt(df: DataFrame) -> DataFrame:
    return df.withColumn("_copy", F.pmod(F.xxhash64("_lat", "_lon"), F.lit(TREE_COPIES)).cast("int"))


def _copied(df: DataFrame) -> DataFrame:
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(TREE_COPIES - 1))))


def candidate_places(spots: DataFrame, places: DataFrame, metric: str, cap: float | None) -> DataFrame:
    """Distinct points (_lat, _lon) with every place that may be their nearest.

    All points go down the tree together, a level at a time. A point keeps the cells whose least distance does not exceed the surest
    bound of any other of its cells; cells that are cut are replaced by what they hold.
    """
    children, leaves = search_tree(places)
    depth = children.agg(F.max("level")).first()[0]
    top = children.where("level = -1").select("nodes").scalar()
    copies = _copied(children.where("level >= 0"))
    front = spots.withColumn("_n", F.explode(top))
    for level in range((depth if depth is not None else -1) + 1):
        opened = _dealt(front)
        cut = opened.where(~F.col("_n.leaf")).select("_lat", "_lon", "_copy", F.col("_n.level").alias("level"), F.col("_n.cx").alias("cx"), F.col("_n.cy").alias("cy"))
        lower = cut.join(copies, ["level", "cx", "cy", "_copy"]).select("_lat", "_lon", F.explode("nodes").alias("_n"))
        front = checkpointed(_promising(opened.where("_n.leaf").select("_lat", "_lon", "_n").unionByName(lower), metric, cap))
    last = _dealt(front.select("_lat", "_lon", F.col("_n.level").alias("level"), F.col("_n.cx").alias("cx"), F.col("_n.cy").alias("cy")))
    return last.join(_copied(leaves), ["level", "cx", "cy", "_copy"]).select("_lat", "_lon", F.explode("places").alias("_place")).select("_lat", "_lon", "_place.*")


def nearest(df: DataFrame, targets: DataFrame, *, lat: str, lon: str, t_lat: str, t_lon: str,
            order, columns, out: str = "dist_km", metric: str = "haversine",
            cap: float | None = None) -> DataFrame:
    """Add `columns` of the nearest target and its distance; ties go to the lowest `order`.

    Exact and without pairing everything: targets at one place are merged, places form a tree whose leaves are small wherever places
    crowd, and a point meets only the leaves that may hold its nearest place. `cap` leaves farther matches NULL. Points and
    targets without a position match nothing.
    """
    if metric not in ("haversine", "planar"):
        raise ValueError(f"unknown metric {metric!r}")
    order = [order] if isinstance(order, str) else list(order)
    measure = geo.haversine_km if metric == "haversine" else geo.planar_km
    t = targets.select(F.col(t_lat).cast("double").alias("_tlat"), F.col(t_lon).cast("double").alias("_tlon"), F.struct(*order).alias("_rank"), F.struct(*columns).alias("_payload"))
    places = (t.where("_tlat IS NOT NULL AND _tlon IS NOT NULL").groupBy("_tlat", "_tlon")
              .agg(F.min("_rank").alias("_rank"), F.min_by("_payload", "_rank").alias("_payload")))
    spots = (df.select(F.col(lat).alias("_lat"), F.col(lon).alias("_lon"))
             .filter(F.col("_lat").isNotNull() & F.col("_lon").isNotNull()).distinct())
    best = (candidate_places(spots, checkpointed(places), metric, cap)
            .withColumn("_d", measure("_lat", "_lon", "_tlat", "_tlon"))
            .groupBy("_lat", "_lon")
            .agg(F.min_by(F.struct("_d", "_payload"), F.struct("_d", "_rank")).alias("_best")))
    if cap is not None:
        best = best.filter(F.col("_best._d") <= cap)
    return (df.join(best, (df[lat] == best["_lat"]) & (df[lon] == best["_lon"]), "left")
            .select(*[df[c] for c in df.columns],
                    *[F.col("_best._payload")[c].alias(c) for c in columns],
                    F.col("_best._d").alias(out)))
