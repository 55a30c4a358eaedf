"""Port polygons and port points from GeoJSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidewake.functions import geo

SCHEMA = """features array<struct<properties: struct<PORTNAME: string, TYPE: string>,
            geometry: struct<type: string, coordinates: string>>>"""
PLANAR_LIMIT = 400.0
POLYGON = "array<array<array<double>>>"


def read_features(spark: SparkSession, path: str, drop_states=("AK",)) -> DataFrame:
    """Features of a GeoJSON file, see parse_features."""
    return parse_features(spark.read.schema(SCHEMA).option("multiLine", True).json(path)
                          .select(F.posexplode("features").alias("feature_no", "_f")), drop_states)


def parse_features(f: DataFrame, drop_states=("AK",)) -> DataFrame:
    """feature_no, port, type, rings of the named features, from rows of feature_no and _f. Multipolygon parts are
    flattened; other geometries and names ending in a dropped state are left out."""
    name = F.trim(F.coalesce("_f.properties.PORTNAME", F.lit("")))
    shape, text = F.col("_f.geometry.type"), F.col("_f.geometry.coordinates")
    rings = (F.when(shape == "Polygon", F.from_json(text, POLYGON))
             .when(shape == "MultiPolygon", F.flatten(F.from_json(text, f"array<{POLYGON}>"))))
    point = lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat"))
    out = f.select("feature_no", name.alias("port"), F.col("_f.properties.TYPE").alias("type"),
                   F.transform(rings, lambda r: F.transform(r, point)).alias("rings"))
    keep = (F.col("port") != "") & F.col("rings").isNotNull()
    for state in drop_states:
        keep = keep & ~F.col("port").endswith(f", {state}")
    return out.filter(keep)


def _to_degrees(p):
    return F.struct(geo.mercator_lon(p["lon"]).alias("lon"), geo.mercator_lat(p["lat"]).alias("lat"))


def read_polygons(spark: SparkSession, path: str, drop_states=("AK",)) -> DataFrame:
    """Rings of a GeoJSON file, see polygons."""
    return polygons(read_features(spark, path, drop_states))


def polygons(features: DataFrame) -> DataFrame:
    """Rings as own polygons: ring_no (file order), port, pts, x0, x1, y0, y1.

    Rings with fewer than four points are dropped and projected ones turned to degrees.
    """
    r = (features.select("feature_no", "port", F.posexplode("rings").alias("_part", "pts"))
         .filter(F.size("pts") >= 4))
    big = F.exists("pts", lambda p: (F.abs(p["lon"]) > PLANAR_LIMIT) | (F.abs(p["lat"]) > PLANAR_LIMIT))
    r = r.withColumn("pts", F.when(big, F.transform("pts", _to_degrees)).otherwise(F.col("pts")))
    bound = lambda f, axis: f(F.transform("pts", lambda p: p[axis]))
    # one port dimension file: its ring list is the bounded side of every spatial join
    number = F.row_number().over(Window.orderBy("feature_no", "_part")) - 1
    return r.select(number.alias("ring_no"), "port", "pts",
                    bound(F.array_min, "lon").alias("x0"), bound(F.array_max, "lon").alias("x1"),
                    bound(F.array_min, "lat").alias("y0"), bound(F.array_max, "lat").alias("y1"))


def read_port_points(spark: SparkSession, path: str, drop_states=("AK",), types=None) -> DataFrame:
    """Points of a GeoJSON file, see port_points. Raises if a point is not on the globe."""
    pts = port_points(read_features(spark, path, drop_states), types)
    bad = pts.filter((F.abs("p_lat") > 90) | (F.abs("p_lon") > 180)).limit(1).collect()
    if bad:
        raise ValueError(f"port coordinates are not geographic: {bad[0]}")
    return pts


def port_points(f: DataFrame, types=None) -> DataFrame:
    """port, p_lat, p_lon: centroid of the ring with most points (the first of equals); a repeated name keeps its last
    feature."""
    if types:
        f = f.filter(F.col("type").isin(*types))
    longest = F.array_max(F.transform("rings", lambda r: F.size(r)))
    ring = F.get(F.filter("rings", lambda r: F.size(r) == longest), F.lit(0))
    c = f.select("feature_no", "port", geo.ring_centroid(ring).alias("_c"))
    off = (F.abs("_c.lat") > 90) | (F.abs("_c.lon") > 180)
    pts = c.select("feature_no", "port",
                   F.when(off, geo.mercator_lat(F.col("_c.lat"))).otherwise(F.col("_c.lat")).alias("p_lat"),
                   F.when(off, geo.mercator_lon(F.col("_c.lon"))).otherwise(F.col("_c.lon")).alias("p_lon"))
    pts = pts.groupBy("port").agg(F.max_by(F.struct("p_lat", "p_lon"), "feature_no").alias("_p"))
    return pts.select("port", "_p.p_lat", "_p.p_lon")
