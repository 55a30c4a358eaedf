"""Shared helpers of this package: appended columns and bounded vocabulary files."""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import Column, DataFrame

#: Largest vocabulary file that is sent to the executors.
MAX_VOCABULARY_BYTES = 64 << 20
#: Rows that a Python worker gets at once. Texts can be long, and workers keep the memory of their largest batch.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """The same table; its session sends at most BATCH_ROWS rows at once to Python workers from here on."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, BATCH_ROWS)
    return df


def put_columns(df: DataFrame, **columns: Column) -> DataFrame:
    """Append columns. An input column of the same name (Spark compares without case) is replaced."""
    small_batches(df)
    clash = {c.lower() for c in columns}
    kept = [df[c] for c in df.columns if c.lower() not in clash]
    return df.select(*kept, *[expression.alias(name) for name, expression in columns.items()])


def read_vocabulary(path: str) -> bytes:
    """Content of a tokenizer file on the driver. Its size is fixed by the file, never by the corpus, and is checked
    before it is sent to the executors."""
    with open(path, "rb") as file:
        content = file.read(MAX_VOCABULARY_BYTES + 1)
    if len(content) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has over {MAX_VOCABULARY_BYTES} bytes")
    return content


def parse_ranks(content: bytes) -> dict[bytes, int]:
    """Token bytes to rank from lines of base64 and number."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line)}


def list_array(flat, lengths, kind) -> pa.Array:
    """A list array from flat values and the length of each list."""
    import numpy as np

    offsets = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, type=kind))
