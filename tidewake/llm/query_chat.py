"""op5_chat: all conversations formatted, written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat

CONTROL_TEXT = r"\### Assistant: </turn> ok"


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], turns.schema)
    pages = chat.read_formatted(spark.read.parquet(chat.write_formatted(turns.unionByName(extra))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return pages.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("generated_text").cast("long").alias("loss_chars"), F.sha2("generated_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


Q = {"op5_chat": op5_chat}

#: A turn is "### role: text</turn>" and a line end; control strings and backslashes get one more character.
SQL = {"op5_chat": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(4 + length(regexp_replace(role, '(\\|###|</turn>|:)', '#\1', 'g')) + 2
                + length(regexp_replace(text, '(\\|###|</turn>)', '#\1', 'g')) + 8) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""}
