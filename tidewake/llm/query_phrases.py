"""op11_phrases: phrases of each language in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import name_phrases


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = name_phrases.mine(docs, vessel_name="text", vclass="lang")
    return found.select(F.col("vclass").alias("lang"), "rank", "phrase", "a", "l", "r", "n", "score")


Q = {"op11_phrases": op11_phrases}

SQL = {"op11_phrases": r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
phrases AS (
  SELECT lang, m, p, count(*) AS f FROM (SELECT lang, m, w[i:i + m - 1] AS p FROM (
    SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, range(1, 6) AS s(m) WHERE len(w) >= m)) GROUP BY lang, m, p HAVING count(*) >= 100),
total AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
scored AS (
  SELECT c.lang, c.p, c.m, c.f AS a, x.f AS l, y.f AS r, n, k, (1000::HUGEINT * c.f * n) // (x.f::HUGEINT * y.f) AS score
  FROM phrases c JOIN range(1, 5) AS s(k) ON k < c.m JOIN phrases x ON x.lang = c.lang AND x.p = c.p[1:k] JOIN phrases y ON y.lang = c.lang AND y.p = c.p[k + 1:]
  JOIN total t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inside AS (
  SELECT DISTINCT b.lang, b.p FROM (SELECT lang, p, m, f, unnest(range(1, m)) AS i FROM phrases WHERE m > 2) AS big, range(2, 5) AS s(q), best AS b
  WHERE q < big.m AND i + q - 1 <= big.m AND b.lang = big.lang AND b.p = big.p[i:i + q - 1] AND 100 * big.f >= 100 * b.a),
kept AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, n, score FROM best ANTI JOIN inside USING (lang, p))
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= 2000"""}
