"""op7_topk: the five nearest vectors of every fiftieth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import topk


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("unit"), F.col("embedding").alias("values"))
    found = topk.most_alike(vectors, F.col("unit") % 50 == 0)
    return found.select(F.col("query_unit").alias("query_id"), "rank", F.col("unit").alias("vec_id"), "score")


Q = {"op7_topk": op7_topk}

SQL = {"op7_topk": """
WITH v AS (
  SELECT row_number() OVER () AS row_no, vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.row_no, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.row_no <> c.row_no)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY row_no ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""}
