"""op10_language: language of all documents, learned from the labelled four fifths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import language_id

FOLDS = 5


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))


def trained(docs: DataFrame) -> language_id.Network:
    return language_id.train(docs.where(F.col("doc_id").isNotNull() & ~held_out()).select("text", "lang"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = language_id.predict(docs.select("doc_id", "text"), trained(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


Q = {"op10_language": op10_language}
SQL: dict[str, str] = {}
