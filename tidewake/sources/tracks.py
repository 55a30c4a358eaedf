"""Cyclone best-track scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

NUMERIC = ["LAT", "LON", "USA_WIND", "USA_PRES", "USA_SSHS", "LANDFALL", "DIST2LAND"]
COLUMNS = ["SID", "SEASON", "NAME", "ISO_TIME", "NATURE", *NUMERIC]


def read_tracks(spark: SparkSession, path: str, season_min: int = 2015, season_max: int = 2025) -> DataFrame:
    return parse_tracks(spark.read.option("header", True).csv(path).select(*COLUMNS), season_min, season_max)


def parse_tracks(raw: DataFrame, season_min: int = 2015, season_max: int = 2025) -> DataFrame:
    """Track points of the seasons from text columns. The units row under the header has no numeric season and
    falls out with it; cells that do not parse are NULL; rows need a time and a place."""
    num = lambda c, t: F.trim(F.col(c)).try_cast(t).alias(c)
    df = raw.select("SID", num("SEASON", "int"), "NAME",
                    F.col("ISO_TIME").try_cast("timestamp_ntz").alias("ISO_TIME"), "NATURE",
                    *[num(c, "double") for c in NUMERIC])
    return (df.filter(F.col("SEASON").between(season_min, season_max))
            .dropna(subset=["LAT", "LON", "ISO_TIME"]))
