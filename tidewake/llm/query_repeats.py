"""op9_repeats: strings of 200 bytes that occur again in any document, removed from all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import repeats


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return repeats.drop_repeats(docs, derive=lambda kept: {"kept_sha256": F.sha2(kept, 256)})


Q = {"op9_repeats": op9_repeats}
SQL: dict[str, str] = {}
