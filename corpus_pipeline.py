"""A corpus in five stages: language, near copies, benchmark passages, personal data, token ids."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewake.llm import bpe, language_id, personal_data, positional_index, simhash
from tidewake.llm.query_bpe import VOCABULARY
from tidewake.llm.query_language import trained
from tidewake.operators.sizing import checkpointed

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Best chance that a long text needs to stay, and the length at which half of the way to it is asked for. A text that is mixed,
#: or of a language without labels, spreads its chances.
LEAST_CHANCE, HALF_LENGTH = 0.4, 60.0
#: Pieces that a worker keeps when it encodes: half the default, as the workers of a pipeline hold what earlier stages left.
REMEMBERED_PIECES = 1 << 17


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: null texts, those without a letter, which the network gives `und`, and those whose best
    language has too small a chance. With k languages the best has 1/k at least; what is asked for rises from there, where a text has
    no length, towards LEAST_CHANCE, by one formula for all lengths. Without labels to learn from all documents with a letter stay."""
    net = trained(docs)
    if not net.labels:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    found = language_id.predict(docs, net, lang_pred="__tongue", score="__chance")
    even = min(1 / len(net.labels), LEAST_CHANCE)
    asked = even + (LEAST_CHANCE - even) * F.length("text") / (F.length("text") + HALF_LENGTH)
    return found.where((F.col("__tongue") != language_id.UNKNOWN) & (F.col("__chance") >= asked - 1e-9)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, that of the least id; of repeated rows of one id, one."""
    return simhash.first_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark."""
    index = spark.read.parquet(positional_index.build(docs))
    found = positional_index.matches(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = found.where("n_hit > 0").select(F.col("record").alias("__hit")).distinct()
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col("__hit")), "left_anti")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in texts by its kind; n_chars follows the text. No document goes."""
    found = personal_data.find(docs, personal_data.learn(docs), spans="__spans")
    masked = personal_data.mask(found, spans="__spans")
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, and the digest of what they decode to."""
    done = bpe.encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, ids="ids", content="__content", remembered=REMEMBERED_PIECES)
    return done.select("doc_id", "lang", "source", "n_chars", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("__content", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language), ("near_copies", drop_near_copies), ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data), ("token_ids", encode_tokens)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
