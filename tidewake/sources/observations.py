"""Station catalogues and downloaded observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# fixed values: codes of the states whose airport networks are used
STATES = ["AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS", "KY",
          "LA", "ME", "MD", "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ", "NM", "NY", "NC", "ND",
          "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY",
          "DC", "PR", "VI"]
SERIES = "data array<struct<t: string, v: string, s: string>>, predictions array<struct<t: string, v: string, s: string>>"


def airport_stations(df: DataFrame, states=None) -> DataFrame:
    """station, name, s_lat, s_lon of the state airport networks, rows without a place dropped."""
    net = F.col("iem_network")
    ok = net.rlike("^[A-Z]{2}_ASOS$") & F.substring(net, 1, 2).isin(*(states or STATES))
    return (df.filter(ok).select(F.col("stid").alias("station"), F.col("station_name").alias("name"),
                                 F.col("lat").try_cast("double").alias("s_lat"),
                                 F.col("lon").try_cast("double").alias("s_lon"))
            .dropna(subset=["s_lat", "s_lon"]))


def read_airport_stations(spark: SparkSession, path: str) -> DataFrame:
    return airport_stations(spark.read.option("header", True).csv(path))


def read_gauge_stations(spark: SparkSession, path: str) -> DataFrame:
    """Gauge catalogue of a JSON file, see gauge_stations."""
    schema = "stations array<struct<id: string, name: string, lat: double, lng: double>>"
    return gauge_stations(spark.read.schema(schema).option("multiLine", True).json(path))


def gauge_stations(raw: DataFrame) -> DataFrame:
    """station, name, s_lat, s_lon from rows with an array of stations; stations without a place are dropped."""
    return (raw.select(F.explode("stations").alias("_s"))
            .select(F.col("_s.id").alias("station"), "_s.name", F.col("_s.lat").alias("s_lat"),
                    F.col("_s.lng").alias("s_lon")).dropna(subset=["s_lat", "s_lon"]))


def read_series(spark: SparkSession, path, value: str = "v", station_pattern: str = r"([^/_]+)_[^/]*\.json") -> DataFrame:
    """Series of JSON answers, see parse_series. The station comes from the file name."""
    raw = (spark.read.schema(SERIES).option("multiLine", True).json(path)
           .withColumn("station", F.regexp_extract(F.input_file_name(), station_pattern, 1)))
    return parse_series(raw, value)


def parse_series(raw: DataFrame, value: str = "v") -> DataFrame:
    """station, t, v from answers (`v` levels, `s` wind speeds); bad rows are skipped and the last report of a time wins."""
    rows = raw.select("station", F.posexplode(F.when(F.size("data") > 0, F.col("data"))
                                              .otherwise(F.col("predictions"))).alias("_i", "_r"))
    return (rows.select("station", "_i", F.col("_r.t").try_cast("timestamp_ntz").alias("t"),
                        F.col(f"_r.{value}").try_cast("double").alias("v"))
            .dropna(subset=["t", "v"]).groupBy("station", "t").agg(F.max_by("v", "_i").alias("v")))


def read_rain(spark: SparkSession, path) -> DataFrame:
    """Hourly report CSVs, see parse_rain."""
    return parse_rain(spark.read.option("header", True).csv(path))


def parse_rain(raw: DataFrame) -> DataFrame:
    """station, valid, p01i from text columns; blank and bad amounts are skipped."""
    return (raw.select("station", F.col("valid").try_cast("timestamp_ntz").alias("valid"),
                       F.trim(F.col("p01i")).try_cast("double").alias("p01i")).dropna())
