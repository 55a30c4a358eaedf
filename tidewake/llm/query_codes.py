"""op12_codes: codes of all vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import profile_codes


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = profile_codes.compress(vectors, port="vec_id", values="embedding", vclass="label")
    return found.select(F.col("port").alias("vec_id"), "code", "error", F.col("class_error").alias("label_error"), "codebooks_sha256")


Q = {"op12_codes": op12_codes}

_ASSIGN = """
a{n} AS (
  SELECT x.row_no, x.part, b.entry, (x.v[1] - b.v[1]) * (x.v[1] - b.v[1]) + (x.v[2] - b.v[2]) * (x.v[2] - b.v[2])
    + (x.v[3] - b.v[3]) * (x.v[3] - b.v[3]) + (x.v[4] - b.v[4]) * (x.v[4] - b.v[4]) AS d
  FROM x JOIN b{n} AS b USING (part)
  QUALIFY row_number() OVER (PARTITION BY x.row_no, x.part ORDER BY d, b.entry) = 1)"""
_MOVE = """
b{m} AS (
  SELECT b.part, b.entry, CASE WHEN any_value(a.row_no) IS NULL THEN any_value(b.v) ELSE [
    CAST(floor(sum(x.v[1]) / count(x.row_no)) AS BIGINT), CAST(floor(sum(x.v[2]) / count(x.row_no)) AS BIGINT),
    CAST(floor(sum(x.v[3]) / count(x.row_no)) AS BIGINT), CAST(floor(sum(x.v[4]) / count(x.row_no)) AS BIGINT)] END AS v
  FROM b{n} AS b LEFT JOIN a{n} AS a USING (part, entry) LEFT JOIN x ON x.row_no = a.row_no AND x.part = a.part
  GROUP BY b.part, b.entry)"""
#: Written for vectors of 64 components, which all tables have.
SQL = {"op12_codes": f"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row_no, vec_id, label,
    [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
x AS (SELECT row_no, part, v[4 * part + 1:4 * part + 4] AS v FROM v, range(16) AS p(part)),
b0 AS (SELECT part, row_no - 1 AS entry, v FROM x WHERE row_no <= 64),
{_ASSIGN.format(n=0)}, {_MOVE.format(n=0, m=1)}, {_ASSIGN.format(n=1)}, {_MOVE.format(n=1, m=2)}, {_ASSIGN.format(n=2)},
coded AS (SELECT row_no, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY row_no),
digest AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, i)) AS h FROM (SELECT part, entry, unnest(v) AS c, generate_subscripts(v, 1) AS i FROM b2))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM coded JOIN v USING (row_no), digest"""}
