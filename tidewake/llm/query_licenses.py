"""op4_licenses: licences of all documents, as files of a directory tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import licenses

#: The tree: each source is a directory; each hundred of ids is one below it. The first document of a hundred is the licence
#: file of its directory, the first of ten thousand that of its source.
PATH = """concat(source, CASE WHEN doc_id % 10000 = 0 THEN '/LICENSE' ELSE concat('/', cast(floor(doc_id / 100) AS bigint),
          CASE WHEN doc_id % 100 = 0 THEN '/LICENSE' ELSE concat('/', doc_id, '.txt') END) END)"""


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.expr(PATH).alias("path"), "text")
    found = licenses.scan(docs)
    return found.select("doc_id", "path", "license", F.round("score", 5).alias("score"), "inherited_from")


Q = {"op4_licenses": op4_licenses}

_TEMPLATES = ", ".join("('" + name + "', '" + notice + "')" for name, notice in [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0 Creative Commons Attribution"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0")])

SQL = {"op4_licenses": f"""
WITH files AS (
  SELECT doc_id, source || CASE WHEN doc_id % 10000 = 0 THEN '/LICENSE' ELSE '/' || CAST(doc_id // 100 AS VARCHAR)
    || CASE WHEN doc_id % 100 = 0 THEN '/LICENSE' ELSE '/' || CAST(doc_id AS VARCHAR) || '.txt' END END AS path,
    coalesce(text, '') AS body FROM documents),
line AS (
  SELECT doc_id, path, regexp_extract_all(lower(x), '[a-z0-9]+') AS words
  FROM files, unnest(string_split(body, chr(10))) AS t(x)),
tpl AS (SELECT name, unnest(regexp_extract_all(lower(notice), '[a-z0-9]+')) AS word FROM (VALUES {_TEMPLATES}) AS v(name, notice)),
total AS (SELECT count(*) AS n FROM line),
df AS (SELECT word, count(*) AS n FROM (SELECT unnest(list_distinct(words)) AS word FROM line) WHERE word IN (SELECT word FROM tpl) GROUP BY word),
idf AS (SELECT word, ln((1 + total.n) / (1.0 + coalesce(df.n, 0))) + 1 AS idf FROM (SELECT DISTINCT word FROM tpl) AS w LEFT JOIN df USING (word), total),
tv AS (SELECT name, word, count(*) * any_value(idf) AS w FROM tpl JOIN idf USING (word) GROUP BY name, word),
tn AS (SELECT name, sqrt(sum(w * w)) AS norm FROM tv GROUP BY name),
kind AS (SELECT words, row_number() OVER () AS k FROM (SELECT DISTINCT words FROM line WHERE list_has_any(words, (SELECT list(DISTINCT word) FROM tpl)))),
tf AS (SELECT k, word, count(*) AS tf FROM (SELECT k, unnest(words) AS word FROM kind) GROUP BY k, word),
lw AS (SELECT k, word, tf * coalesce(idf, ln(1 + total.n) + 1) AS w FROM tf LEFT JOIN idf USING (word), total),
ln_ AS (SELECT k, sqrt(sum(w * w)) AS norm FROM lw GROUP BY k),
score AS (
  SELECT k, name, round(sum(lw.w * tv.w / tn.norm) / any_value(ln_.norm), 9) AS score
  FROM lw JOIN tv USING (word) JOIN tn USING (name) JOIN ln_ USING (k) GROUP BY k, name),
own AS (
  SELECT doc_id, path, name, score FROM line JOIN kind USING (words) JOIN score USING (k) WHERE score >= 0.6
  QUALIFY row_number() OVER (PARTITION BY doc_id, path ORDER BY score DESC, name) = 1),
found AS (SELECT f.doc_id, f.path, own.name, own.score FROM (SELECT DISTINCT doc_id, path FROM files) AS f LEFT JOIN own ON own.doc_id = f.doc_id AND own.path = f.path),
dirs AS (
  SELECT regexp_replace(path, '/?[^/]*$', '') AS dir, name, score FROM found WHERE name IS NOT NULL AND path LIKE '%/LICENSE'
  QUALIFY row_number() OVER (PARTITION BY regexp_replace(path, '/?[^/]*$', '') ORDER BY score DESC, name) = 1),
up AS (
  SELECT doc_id, path, dirs.dir, dirs.name, dirs.score FROM found JOIN dirs ON found.name IS NULL AND starts_with(found.path, dirs.dir || '/')
  QUALIFY row_number() OVER (PARTITION BY doc_id, path ORDER BY length(dirs.dir) DESC) = 1)
SELECT found.doc_id, found.path, coalesce(found.name, up.name) AS license, round(coalesce(found.score, up.score), 5) AS score, up.dir AS inherited_from
FROM found LEFT JOIN up ON up.doc_id = found.doc_id AND up.path = found.path"""}
