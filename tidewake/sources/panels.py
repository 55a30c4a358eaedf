"""Panel scans, released wide tables, quality checks and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

OUTSIDE = "outside"


def read_panel(spark: SparkSession, path, columns=None, fmt: str = "parquet", day: str = "date",
               types: dict | None = None) -> DataFrame:
    """Panel with the named columns and a parsed day. CSV columns are cast by `types`."""
    df = spark.read.parquet(path) if fmt == "parquet" else spark.read.option("header", True).csv(path)
    return parse_panel(df, columns, day, types)


def parse_panel(df: DataFrame, columns=None, day: str = "date", types: dict | None = None) -> DataFrame:
    """The named columns, cast by `types` where they are text, and a parsed day."""
    missing = [c for c in columns or [] if c not in df.columns]
    if missing:
        raise ValueError(f"panel is missing columns {missing}; it has {df.columns}")
    df = df.select(*columns) if columns else df
    for c, t in (types or {}).items():
        df = df.withColumn(c, F.col(c).try_cast(t))
    return df.withColumn(day, F.to_date(day)) if day in df.columns else df


def study_panel(panel: DataFrame, exposures: DataFrame, unit: str, tier: str | None = "tier") -> DataFrame:
    """Rows of units that have an exposure, without the outside tier."""
    keep = panel.filter(F.col(tier) != OUTSIDE) if tier else panel
    wanted = exposures.select(F.col("port").alias(unit)).distinct()
    return keep.join(wanted, unit, "left_semi")


def wide_to_long(wide: DataFrame, names: DataFrame, key: str, value: str = "vessels_present") -> DataFrame:
    """Released ports x dates table as (date, port, value), ids replaced by names."""
    days = [c for c in wide.columns if c != key]
    long = wide.unpivot([key], days, "_day", value)
    return (long.join(names.select(F.col("id").alias(key), F.col("name").alias("_name")), key)
            .select(F.coalesce(F.col("_day").try_cast("date"), F.try_to_timestamp("_day", F.lit("M/d/yyyy")).cast("date")).alias("date"),
                    F.col("_name").alias("port"), value)
            .filter(F.col(value).isNotNull()))


def port_means(wide: DataFrame, key: str) -> DataFrame:
    """Mean over the date columns per port id."""
    days = [c for c in wide.columns if c != key]
    return (wide.unpivot([key], days, "_day", "_v").groupBy(key)
            .agg(F.avg(F.col("_v").try_cast("double")).alias("port_mean")))


def released_exposures(it: DataFrame) -> DataFrame:
    """Exposure table from released interactions."""
    return it.select("SID", F.col("SID").alias("name"), F.substring("SID", 1, 4).try_cast("int").alias("season"),
                     "port", F.col("start_date").try_cast("timestamp_ntz").alias("exposure_start"),
                     F.col("end_date").try_cast("timestamp_ntz").alias("exposure_end"),
                     F.col("DISTANCE").alias("min_dist_km"), F.col("SSHS").alias("sshs_max_in_window"),
                     F.col("SSHS").alias("sshs_storm_lifetime"), F.col("WIND").alias("wind_max_in_window_kt"),
                     F.col("IF_LANDFALL").alias("landfall_in_window"))


def active_share(panel: DataFrame, values, min_share: float = 0.05) -> DataFrame:
    """Share of rows above zero per value column, flagged when the input is as good as empty."""
    long = panel.unpivot([], [F.col(v).cast("double").alias(v) for v in values], "measure", "v")
    return (long.groupBy("measure").agg(F.avg(F.when(F.col("v") > 0, 1.0).otherwise(0.0)).alias("active_share"))
            .withColumn("empty", F.col("active_share") < min_share))


def require_activity(panel: DataFrame, values, min_share: float = 0.05) -> DataFrame:
    bad = [r["measure"] for r in active_share(panel, values, min_share).filter("empty").collect()]
    if bad:
        raise ValueError(f"{bad} are effectively empty; check the date range of the input")
    return panel


def write_days(df: DataFrame, path: str, day: str = "date") -> None:
    """Parquet partitioned by day; only the days present in df are replaced."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(day).parquet(path))


def write_report(df: DataFrame, path: str, order) -> None:
    """A small report table as one sorted CSV."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def new_days(source: DataFrame, done: DataFrame, day: str = "date") -> DataFrame:
    """Rows of days that the output does not have yet."""
    return source.join(done.select(day).distinct(), day, "left_anti")
