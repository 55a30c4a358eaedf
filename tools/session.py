"""Local session for checks and the bench."""

import os

from pyspark.sql import SparkSession


def local_session(cores: str | None = None) -> SparkSession:
    n = cores or os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{n}]").appName("tidewake")
             .config("spark.sql.shuffle.partitions", n).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.adaptive.enabled", "true").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
