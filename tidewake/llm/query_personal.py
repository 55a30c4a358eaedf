"""op2_personal: personal data in all documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import personal_data


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["first"].cast("string"), s["end"].cast("string"))))


def _count(kind: str) -> Column:
    return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long")


def op2_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = personal_data.find(docs, personal_data.learn(docs)).drop("text")
    base = F.filter("pii", lambda s: s["kind"].isin(personal_data.BASE_KINDS))
    counts = [_count(k).alias(f"n_{k}") for k in personal_data.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("pii")).alias("spans"))


Q = {"op2_personal": op2_personal}
SQL: dict[str, str] = {}
