"""Benchmark decontamination with a distributed positional inverted index.

The project keeps no free text, so the operators are general: records are any table with an id and a text column.

`build` writes the index: training records are dealt into blocks, and each block stores one posting list for each term
(positions in the block, as differences, and their number). `matches` files each phrase of the tests under its rarest term, takes it
to the blocks that hold that term, intersects the lists of its terms there from the rarest on, with positions adjusted by the
term's offset, and returns spans. A block is bounded, so
is a task, however often a term, record or passage occurs.

A word is a run of 0-9, a-z (A-Z is lowered first) and characters beyond ASCII.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidewake.operators.sizing import _shared_folder, checkpointed

from .columns import small_batches

BLOCK_WORDS = 1 << 19
#: Distinct phrases of the tests that a block is searched for at once, and rows that are made of a test at a time.
PART_PHRASES, PHRASE_ROWS = 1 << 20, 1 << 12

_WORD = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
              for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words as UTF-8 bytes."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD).split() if text else []


def _binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Binary array whose rows are consecutive runs of values."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts * values.itemsize, out=offsets[1:])
    return pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def _block(block: int, ids: list, word_lists: list[list[bytes]], schema: pa.Schema) -> pa.RecordBatch:
    """Posting lists of one block, and one row (without a term) for its records."""
    number: dict[bytes, int] = {}
    lengths = np.array([len(w) for w in word_lists], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])       # a free position ends each record: no match crosses it
    total = int(lengths.sum())
    terms = np.fromiter((number.setdefault(w, len(number)) for words in word_lists for w in words), np.int32, total)
    places = np.arange(total) + np.repeat(np.arange(len(lengths)), lengths)
    order = np.argsort(terms.astype(np.uint16) if len(number) < 1 << 16 else terms, kind="stable")
    counts = np.bincount(terms, minlength=len(number)) if total else np.zeros(0, np.int64)
    places = places[order]
    steps = np.diff(places, prepend=0)
    firsts = np.cumsum(counts) - counts
    steps[firsts] = places[firsts]
    n = len(number)
    return pa.record_batch([
        pa.array(np.full(n + 1, block)), pa.array([*number, None], pa.binary()),
        _binary(np.concatenate([steps, lengths]).astype("<u4"), np.append(counts, len(ids))),
        pa.array([None] * n + [ids], schema.field(3).type), pa.array(np.append(counts, len(ids)).astype(np.int64))], schema=schema)


def build(records: DataFrame, record_id: str = "doc_id", text: str = "text", folder: str | None = None) -> str:
    """Write the index of a table and return its folder.

    folder: where to write; by default a new one in the folder of spark.checkpoint.dir. Whole texts are indexed. A null
    or empty text has no words but stays a record; repeated rows and ids stay separate records; an empty table gives an
    empty index. Other columns are not read. A block holds BLOCK_WORDS words or one longer record.
    """
    spark = small_batches(records).sparkSession
    folder = folder or f"{_shared_folder(spark)}/index-{uuid.uuid4().hex}"
    kind = records.schema[record_id].dataType.simpleString()
    limit = BLOCK_WORDS

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, held, size = TaskContext.get().partitionId() << 32, [], [], 0
        schema = None
        for batch in batches:
            schema = schema or pa.schema([("block", pa.int64()), ("term", pa.binary()), ("positions", pa.binary()),
                                          ("ids", pa.list_(batch.schema.field(0).type)), ("n", pa.int64())])
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(value.as_py())
                if ids and size + len(words) > limit:
                    yield _block(block, ids, held, schema)
                    block, ids, held, size = block + 1, [], [], 0
                ids.append(key)
                held.append(words)
                size += len(words)
        if ids:
            yield _block(block, ids, held, schema)

    (records.select(record_id, F.col(text).cast("string"))
     .mapInArrow(postings, f"block long, term binary, positions binary, ids array<{kind}>, n long")
     .write.option("compression", "zstd").parquet(folder))
    return folder


def _find(phrase: tuple[bytes, ...], lists: dict[bytes, np.ndarray]) -> np.ndarray:
    """Start positions of an exact phrase: lists are intersected from the rarest term on."""
    parts = []
    for offset, term in enumerate(phrase):
        places = lists.get(term)
        if places is None:
            return np.empty(0, np.int64)
        parts.append((len(places), offset, places))
    parts.sort(key=lambda p: p[0])
    starts = parts[0][2] - parts[0][1]
    for size, offset, places in parts[1:]:
        at = np.searchsorted(places, starts + offset)
        at[at == size] = size - 1
        starts = starts[places[at] == starts + offset]
        if not len(starts):
            break
    return starts


def _near(phrase: tuple[bytes, ...], lists: dict[bytes, np.ndarray], reach: int) -> list[tuple[int, int]]:
    """Shortest spans of at most `reach` positions that hold all terms of a phrase in any order."""
    terms = sorted(set(phrase), key=lambda t: len(lists.get(t, ())))
    if any(t not in lists for t in terms):
        return []
    rare = lists[terms[0]]
    events = []
    for k, term in enumerate(terms):
        places = lists[term]
        at = np.searchsorted(rare, places)
        left, right = rare[np.maximum(at - 1, 0)], rare[np.minimum(at, len(rare) - 1)]
        close = np.minimum(np.abs(places - left), np.abs(places - right)) < reach
        events += [(int(p), k) for p in places[close]]
        if not close.any():
            return []
    last: dict[int, int] = {}
    found = []
    for place, k in sorted(events):
        last[k] = place
        if len(last) == len(terms) and place - (first := min(last.values())) < reach:
            found.append((first, place + 1))
    return found


def phrases_of(tests: DataFrame, window: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct phrases of the tests: phrase (words joined by spaces), terms, items (distinct ids, as strings, sorted)."""
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(value.as_py())
                at = range(max(1, len(words) - window + 1) if words else 0)
                for some in (at[i:i + PHRASE_ROWS] for i in range(0, len(at), PHRASE_ROWS)):
                    parts = [words[i:i + window] for i in some]
                    yield pa.record_batch([pa.array([b" ".join(p) for p in parts], pa.binary()), pa.array(parts, pa.list_(pa.binary())), pa.array([item] * len(parts), pa.string())],
                                          names=["phrase", "terms", "item"])

    rows = tests.select(F.col(item_id).cast("string"), F.col(text).cast("string")).mapInArrow(windows, "phrase binary, terms array<binary>, item string")
    return rows.groupBy("phrase").agg(F.first("terms").alias("terms"), F.array_sort(F.collect_set("item")).alias("items"))


def _candidates(used: DataFrame, phrases: DataFrame, parts: int) -> DataFrame:
    """block, part, phrase, items: each phrase in the blocks that hold the rarest of its terms. Phrases with a term that no block
    holds are left out."""
    counts = used.groupBy("term").agg(F.sum("n").alias("held"))
    terms = phrases.select("phrase", F.explode(F.array_distinct("terms")).alias("term"))
    rarest = (terms.join(counts, "term", "left").groupBy("phrase").agg(F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), F.col("term").alias("term"))).alias("least"))
              .where("least.held > 0").select("phrase", F.col("least.term").alias("term")))
    filed = phrases.select("phrase", "items").join(rarest, "phrase")
    return used.select("block", "term").join(filed, "term").select("block", F.pmod(F.xxhash64("phrase"), F.lit(parts)).alias("part"), "phrase", "items")


def _search(index: DataFrame, phrases: DataFrame, record_kind: str, slop: int | None, parts: int) -> DataFrame:
    terms = phrases.select(F.explode("terms").alias("term")).distinct()
    used = checkpointed(index.where(F.col("term").isNotNull()).join(terms, "term", "left_semi").select("block", "term", "positions", "n"))
    wanted = _candidates(used, phrases, parts)
    own = index.where(F.col("term").isNull()).select("block", "term", "positions", "ids")
    lists_of = used.select("block", "term", "positions", F.lit(None).cast(f"array<{record_kind}>").alias("ids"))
    postings = own.unionByName(lists_of).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def block_matches(table: pa.Table, asked: pa.Table) -> pa.Table:
        lists, ids, lengths = {}, [], np.empty(0, np.int64)
        for term, packed, owners in zip(table.column("term"), table.column("positions"), table.column("ids")):
            values = np.frombuffer(packed.as_buffer(), "<u4").astype(np.int64)
            if term.as_py() is None:
                ids, lengths = owners.as_py(), values
            else:
                lists[term.as_py()] = np.cumsum(values)
        starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]) if len(lengths) else np.empty(0, np.int64)
        spans: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set] = {}
        for joined, holders in zip(asked.column("phrase").to_pylist(), asked.column("items")):
            phrase = tuple(joined.split(b" "))
            if slop is None:
                found = [(s, s + len(phrase)) for s in _find(phrase, lists).tolist()]
            else:
                found = _near(phrase, lists, len(phrase) + slop)
            for first, end in found:
                row = int(np.searchsorted(starts, first, side="right")) - 1
                if end - starts[row] <= lengths[row]:
                    spans.setdefault(row, []).append((int(first - starts[row]), int(end - starts[row])))
                    items.setdefault(row, set()).update(holders.as_py())
        n = len(ids)
        return pa.table({
            "block": pa.array(np.full(n, table.column("block")[0].as_py() if table.num_rows else 0)), "row": pa.array(np.arange(n, dtype=np.int64)),
            "record": pa.array(ids, table.schema.field("ids").type.value_type), "n_words": pa.array(lengths),
            "spans": pa.array([[{"first": a, "end": b} for a, b in sorted(set(spans.get(i, ())))] for i in range(n)],
                              pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))),
            "items": pa.array([sorted(x for x in items.get(i, ()) if x is not None) for i in range(n)], pa.list_(pa.string()))})

    return postings.groupBy("block", "part").cogroup(wanted.groupBy("block", "part")).applyInArrow(
        block_matches, f"block long, row long, record {record_kind}, n_words long, "
                       "spans array<struct<first:long,end:long>>, items array<string>")


def matches(index: DataFrame, tests: DataFrame, item_id: str = "item_id", text: str = "text", window: int = 10,
            slop: int | None = None) -> DataFrame:
    """Matches of the tests in all indexed records: one row for each record, matched or not.

    index: table read from the folder that `build` wrote. A test's phrases are its windows of `window` consecutive words;
    a shorter test, but not one without words, is one phrase. slop: None for exact phrases; else a phrase matches where
    all its words lie, in any order, within its length plus slop words.

    Returns record, n_words, spans (array of first word and end word, exclusive, per occurrence, sorted), n_hit (words in
    any span), items (distinct ids of matched tests, as strings, sorted; tests without an id count for hits only). Null or
    empty tests never match, repeated ones count once; without tests or records the result has no matches or no rows. Phrases are a
    table keyed by their rarest term, and meet only the blocks that hold it; nothing of the tests passes the driver. Of over
    PART_PHRASES phrases, each part is searched apart.
    """
    kind = index.schema["ids"].dataType.elementType.simpleString()
    phrases = checkpointed(phrases_of(tests, window, item_id, text))
    parts = -(-phrases.count() // PART_PHRASES) or 1
    found = _search(index, phrases, kind, slop, parts)
    if parts > 1:
        found = found.groupBy("block", "row").agg(
            F.first("record").alias("record"), F.first("n_words").alias("n_words"),
            F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(F.greatest(a["end"], s["end"]).alias("end"),
                              (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["end"], s["first"]))).alias("n")))
    return found.select("record", "n_words", "spans", covered["n"].alias("n_hit"), "items")
