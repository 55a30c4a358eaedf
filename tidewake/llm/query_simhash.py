"""op8_simhash: near copies among all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import simhash


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


Q = {"op8_simhash": op8_simhash}
SQL: dict[str, str] = {}
