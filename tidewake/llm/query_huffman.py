"""op3_huffman: token ids of all documents, written compressed and read back."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewake.operators.sizing import checkpointed

from . import huffman
from .columns import read_vocabulary
from .library_tokens import tokenize

VOCABULARY = "byte_bpe_50k.json"


def op3_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ids = checkpointed(tokenize(docs, read_vocabulary(public_tokenizers.path(VOCABULARY))).select("doc_id", "ids"))
    back = huffman.read(spark, huffman.write(ids))
    return back.select(F.col("record").alias("doc_id"), "start", F.floor(F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


Q = {"op3_huffman": op3_huffman}
SQL: dict[str, str] = {}
