"""op1_bpe: byte-level encoding and decoding of all documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return bpe.encode(docs, path, public_tokenizers.PATTERN, content="content").select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("content", 256).alias("decoded_sha256"))


Q = {"op1_bpe": op1_bpe}
SQL: dict[str, str] = {}
