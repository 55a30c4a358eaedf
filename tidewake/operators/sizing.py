"""Spreading CPU-heavy work, and reliable lineage cuts. Which side of a join is broadcast is left to Spark, which knows bytes
at run time."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

def spread(df: DataFrame, *columns) -> DataFrame:
    """Hash rows over all shuffle partitions before CPU-heavy work on few bytes.

    Adaptive execution merges partitions by size, which would leave such work to one task; an
    explicit partition number is kept.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *columns)


def _shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only a local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tidewake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage: write df as a Parquet table in the shared folder and read it back.

    The table outlives lost executors, is pruned by column, and has a known size, so the joins
    behind it are planned on facts. It runs the work so far.
    """
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/tidewake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
