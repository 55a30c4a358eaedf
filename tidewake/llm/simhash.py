"""Near copies by SimHash fingerprints and pivot distance tables.

The project keeps no free text, so the operators are general: records are any table with an id and a text column.

Equal fingerprints are one class from the start. Two classes that differ in at most 3 of 64 bits agree in at least two of
five bit fields, so each class is filed under its ten pairs of fields. Inside such a cell, the Hamming distances of all
members to PIVOTS reference fingerprints are tabled first: two members whose distances to any pivot differ by over 3
cannot be linked, and only survivors are verified. A cell gives the star of each group it finds, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidewake.operators.sizing import checkpointed, spread

from .columns import put_columns
from .components import connected

SHINGLE_WORDS = 3
SEED = 42
MAX_DISTANCE = 3
FIELDS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
PIVOTS = np.array([xxhash.xxh64_intdigest(str(i).encode(), SEED) for i in range(24)], np.uint64)
#: Members that one task compares at once; larger cells are split into a grid of parts.
CELL_ROWS = 1024
BLOCK = 1 << 16


def fingerprint_of(text: str | None) -> int:
    """Unsigned 64-bit fingerprint: a bit is 1 if it is set in over half the hashes of the word shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(SHINGLE_WORDS, len(words))
    first, last = starts[:len(words) - k + 1], ends[k - 1:]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(first), BLOCK):
        pieces = [joined[a:b] for a, b in zip(first[i:i + BLOCK].tolist(), last[i:i + BLOCK].tolist())]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, len(pieces))
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(first), bitorder="little").view("<u8")[0])


def fingerprints(records: DataFrame, text: str = "text", fingerprint: str = "fingerprint") -> DataFrame:
    """Append the fingerprint of a text as a long (the bits of the unsigned value).

    A null text or one without words has fingerprint 0, one of fewer than three words has one shingle. Other columns are
    kept, one named like `fingerprint` is replaced. Whole texts are read, shingles in blocks.
    """
    @F.arrow_udf("long")
    def computed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(np.array([fingerprint_of(value.as_py()) for value in batch], np.uint64).view(np.int64))

    return put_columns(records, **{fingerprint: computed(F.col(text).cast("string"))})


def group_stars(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seed and member of each group that chains of at most MAX_DISTANCE bits hold together.

    A group grows from a seed: each member takes in what is near and still free, so members of a group are never compared
    once all of a cell are taken.
    """
    table = np.bitwise_count(members[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    free = np.arange(len(members))
    seeds, found = [], []
    while len(free) > 1:
        seed, queue, free = free[0], [free[0]], free[1:]
        while queue and len(free):
            at = queue.pop()
            maybe = (np.abs(table[free] - table[at]).max(axis=1) <= MAX_DISTANCE).nonzero()[0]
            if not len(maybe):
                continue
            near = maybe[np.bitwise_count(members[free[maybe]] ^ members[at]) <= MAX_DISTANCE]
            if len(near):
                taken = free[near]
                queue += taken.tolist()
                seeds.append(np.full(len(taken), seed))
                found.append(taken)
                keep = np.ones(len(free), bool)
                keep[near] = False
                free = free[keep]
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return members[np.concatenate(seeds)], members[np.concatenate(found)]


def _cell_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of each cell of a partition that is sorted by cell. Only the cell that a batch ends in is carried on."""
    key, held = None, []

    def flush() -> pa.RecordBatch:
        a, b = group_stars(np.unique(np.concatenate(held)).view(np.uint64))
        return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        pair, value, part, prints = (batch.column(i).to_numpy() for i in range(4))
        change = 1 + np.flatnonzero((np.diff(pair) != 0) | (np.diff(value) != 0) | (np.diff(part) != 0))
        for rows in np.split(np.arange(batch.num_rows), change):
            now = (pair[rows[0]], value[rows[0]], part[rows[0]])
            if key is not None and now != key:
                if sum(map(len, held)) > 1:
                    yield flush()
                held = []
            key = now
            held.append(prints[rows])
    if held and sum(map(len, held)) > 1:
        yield flush()


def links(prints: DataFrame, fingerprint: str = "fingerprint") -> DataFrame:
    """Links (a, b) whose chains join all distinct fingerprints that chains of near ones join.

    prints: one row for each distinct fingerprint. Cells of one member are dropped by count. A cell of over CELL_ROWS
    members is dealt into parts, and each pair of parts is a cell of its own, so no task holds more than two parts.
    """
    x = F.col(fingerprint)
    fields = [F.shiftrightunsigned(x, start).bitwiseAND(F.lit((1 << bits) - 1)) for start, bits in FIELDS]
    filed = [F.struct(F.lit(i * 5 + j).alias("pair"), (fields[i] * F.lit(1 << 13) + fields[j]).alias("value"))
             for i in range(5) for j in range(i + 1, 5)]
    cells = prints.select(x.alias("print"), F.explode(F.array(*filed)).alias("cell")).select("print", "cell.pair", "cell.value")
    counts = cells.groupBy("pair", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / F.lit(CELL_ROWS))
    own = F.pmod(F.xxhash64("print"), F.col("parts"))
    grid = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1),
                       lambda t: F.least(t, F.col("own")) * F.col("parts") + F.greatest(t, F.col("own")))
    dealt = (cells.join(counts, ["pair", "value"]).withColumn("parts", parts).withColumn("own", own)
             .select("pair", "value", F.explode(grid).alias("part"), "print"))
    dealt = spread(dealt, "pair", "value", "part").sortWithinPartitions("pair", "value", "part")
    return dealt.mapInArrow(_cell_links, "a long, b long")


def classes(prints: DataFrame, record_id: str = "doc_id", fingerprint: str = "fingerprint") -> DataFrame:
    """Group of each distinct fingerprint: fingerprint, component (one name for each group, a fingerprint of it) and
    component_id (the least record id of the group; null if it has none). prints: stored ids and fingerprints of all rows."""
    distinct = checkpointed(prints.groupBy(F.col(fingerprint).alias("fingerprint")).agg(F.min(record_id).alias("least")))
    joined = connected(links(distinct))
    groups = distinct.join(joined.withColumnRenamed("vertex", "fingerprint"), "fingerprint", "left").withColumn(
        "component", F.coalesce("component", "fingerprint"))
    return groups.join(groups.groupBy("component").agg(F.min("least").alias("component_id")), "component").select(
        "fingerprint", "component", "component_id")


def near_copies(records: DataFrame, record_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint and group of every record: fingerprints of at most MAX_DISTANCE differing bits are linked.

    Returns record_id, fingerprint (long) and component_id, the least id that is reachable, the record's own included.
    Null texts and texts without words share fingerprint 0 and are linked like any other. Repeated rows stay rows. A null
    id stays null and is never a component's least id. An empty table gives no rows. Other columns are left out.
    """
    prints = checkpointed(fingerprints(records.select(F.col(record_id).alias("record"), F.col(text).alias("body")), "body")
                          .select("record", "fingerprint"))
    return prints.join(classes(prints, "record"), "fingerprint").select(
        F.col("record").alias(record_id), "fingerprint", "component_id")


def first_of_each(records: DataFrame, record_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One record of each group of near copies, with all its columns: that of the least id, of repeated rows any one, of
    records without ids any one. A column named __print is taken for the fingerprint."""
    marked = fingerprints(records, text, "__print")
    groups = classes(checkpointed(marked.select(F.col(record_id).alias("record"), "__print")), "record", "__print")
    kept = marked.join(groups.withColumnRenamed("fingerprint", "__print"), "__print").where(F.col(record_id).eqNullSafe(F.col("component_id")))
    return kept.dropDuplicates(["component"]).select(*[marked[c] for c in records.columns])
