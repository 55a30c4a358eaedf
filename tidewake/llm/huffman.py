"""Token ids in a compressed binary table: canonical, length-limited Huffman codes.

The project keeps no token ids, so the operators are general: records are any table with an id and a binary column of
packed ids (little-endian unsigned 32-bit integers).

A file set is a Parquet table of blocks. Code lengths come from the counts of all ids (package-merge, so no code is longer
than MAX_BITS), codes are canonical, and every block repeats nothing but what it needs: its bits, and the bit offset of
every CHECKPOINT-th id. A block is read alone; its checkpoints are decoded side by side with one table look-up an id.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidewake.operators.sizing import _shared_folder

from .columns import small_batches

MAX_BITS = 20
CHECKPOINT = 64
BLOCK_IDS = 1 << 16
MAX_SYMBOLS = 1 << 18

BLOCK_TYPE = ("part int, block int, first_place int, first_id long, n_ids int, whole boolean, bits binary, checkpoints binary, "
              "records array<{kind}>, sizes array<int>")


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Bits of each symbol's code: least in sum over the counts, at most `limit` each; 0 for a symbol of count 0.

    Package-merge in the boundary form: at each level the cheapest pairs of the level below are merged with the symbols;
    how many packages a level takes tells how many symbols get one more bit.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n <= 1:
        lengths[used] = 1
        return lengths
    if n > 1 << limit:
        raise ValueError(f"{n} symbols do not fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    base = counts[order].astype(np.float64)
    levels, previous = [], np.empty(0)
    for _ in range(limit):
        pairs = previous[:len(previous) // 2 * 2].reshape(-1, 2).sum(axis=1)
        weight = np.concatenate([base, pairs])
        package = np.concatenate([np.zeros(n, bool), np.ones(len(pairs), bool)])
        place = np.argsort(weight, kind="stable")
        previous = weight[place]
        levels.append(package[place])
    take = 2 * n - 2
    for package in reversed(levels):
        packages = int(package[:take].sum())
        lengths[order[:take - packages]] += 1
        take = 2 * packages
    return lengths


@dataclass
class Code:
    """Canonical codes: shorter first, then by id."""

    lengths: np.ndarray
    codes: np.ndarray
    symbol: np.ndarray      # by the next `bits` bits
    size: np.ndarray
    bits: int


def canonical(lengths: np.ndarray) -> Code:
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    bits = int(lengths.max()) if len(used) else 1
    sizes = lengths[order].astype(np.int64)
    span = 1 << (bits - sizes)
    starts = np.cumsum(span) - span
    codes = np.zeros(len(lengths), np.int64)
    codes[order] = starts >> (bits - sizes)
    symbol = np.zeros(1 << bits, np.int32)
    size = np.ones(1 << bits, np.uint8)
    filled = int(span.sum())
    symbol[:filled] = np.repeat(order, span)
    size[:filled] = np.repeat(sizes, span)
    return Code(lengths, codes, symbol, size, bits)


def pack(code: Code, ids: np.ndarray, sizes: np.ndarray) -> list[tuple[bytes, np.ndarray]]:
    """Bits of consecutive pieces of `sizes` ids, each from a byte of its own, and the offset of every CHECKPOINT-th id in
    its piece.

    A code reaches into at most two 32-bit words. Codes do not overlap, so the words are sums, exact in doubles.
    """
    length = code.lengths[ids].astype(np.int64)
    if len(ids) and not length.all():
        raise ValueError("an id has no code")
    edges = np.concatenate([[0], np.cumsum(sizes)])
    bits = np.concatenate([[0], np.cumsum(length)])[edges]
    room = (np.diff(bits) + 7) // 8
    begin = np.concatenate([[0], np.cumsum(room)])
    own = np.cumsum(length) - length - np.repeat(bits[:-1], sizes)            # offset in the piece
    starts = own + np.repeat(8 * begin[:-1], sizes)
    word = starts >> 5
    value = code.codes[ids] << (64 - (starts & 31) - length)
    n = int(begin[-1] >> 2) + 3
    words = np.bincount(word, weights=(value >> 32) & 0xFFFFFFFF, minlength=n) + np.bincount(word + 1, weights=value & 0xFFFFFFFF, minlength=n)
    data = words.astype(np.uint32).astype(">u4").tobytes()
    return [(data[begin[i]:begin[i + 1]], own[edges[i]:edges[i + 1]:CHECKPOINT].astype("<u4")) for i in range(len(sizes))]


def unpack(code: Code, data: bytes, checkpoints: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Ids of consecutive pieces of `sizes` ids. checkpoints: bit offsets of their runs in data, which ends in 4 free bytes
    at least. All runs advance together, one id a step, the longest first."""
    runs = -(-sizes // CHECKPOINT)
    left = np.full(int(runs.sum()), CHECKPOINT)
    filled = runs > 0
    left[np.cumsum(runs)[filled] - 1] = (sizes - (runs - 1) * CHECKPOINT)[filled]
    order = np.argsort(-left, kind="stable")
    live_at = np.searchsorted(-left[order], -np.arange(CHECKPOINT), side="left")
    out = np.zeros((len(left), CHECKPOINT), np.uint32)
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    at = checkpoints.astype(np.int64)[order]
    mask, room = (1 << code.bits) - 1, 32 - code.bits
    for k in range(CHECKPOINT):
        live = int(live_at[k])
        if not live:
            break
        spot = at[:live]
        peek = (window[spot >> 3] >> (room - (spot & 7))) & mask
        out[:live, k] = code.symbol[peek]
        spot += code.size[peek]
    back = np.empty_like(out)
    back[order] = out
    return back[np.arange(CHECKPOINT) < left[:, None]]


def _part(key, bounds: list) -> int:
    """The part of a record id: how many of the ascending bounds are below it. Null comes first, NaN last."""
    return 0 if key is None else bisect_left(bounds, key) if key == key else len(bounds)


def _encode(batch: pa.RecordBatch, code: Code, limit: int, end_id: int, row: int, bounds: list) -> pa.RecordBatch:
    """Records to coded pieces of at most `limit` ids."""
    parts, sizes, records, rows, numbers, cut, places = [], [], [], [], [], [], []
    for key, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
        ids = np.append(np.frombuffer(packed.as_buffer(), "<u4"), np.uint32(end_id))
        parts.append(ids)
        place = _part(key, bounds)
        for number, start in enumerate(range(0, len(ids), limit)):
            sizes.append(min(limit, len(ids) - start))
            records.append(key)
            rows.append(row)
            numbers.append(number)
            cut.append(len(ids) > limit)
            places.append(place)
        row += 1
    done = pack(code, np.concatenate(parts), np.array(sizes))
    return pa.record_batch([pa.array(records, batch.schema.field(0).type), pa.array(rows, pa.int64()), pa.array(numbers, pa.int32()), pa.array(sizes, pa.int32()),
                            pa.array([d for d, _ in done], pa.binary()), pa.array([m.tobytes() for _, m in done], pa.binary()), pa.array(cut, pa.bool_()), pa.array(places, pa.int32())],
                           names=["record", "row", "number", "n", "bits", "marks", "cut", "part"])


def _blocks(part: int, pieces: Iterator[tuple], limit: int) -> Iterator[dict]:
    """Put the coded pieces of a part, in order, into blocks. Each piece of a cut record is a block, which lists it; all other
    blocks hold whole records."""
    held: list[tuple] = []
    block = seen = count = 0
    place, last = -1, None

    def flush() -> dict:
        nonlocal held, block, seen, count
        shift = 8 * (np.cumsum([len(p[4]) for p in held]) - [len(p[4]) for p in held])
        marks = [np.frombuffer(p[5], "<u4") + np.uint32(s) for p, s in zip(held, shift)]
        out = {"part": part, "block": block, "first_place": held[0][7], "first_id": seen, "n_ids": count, "whole": not held[0][6], "bits": b"".join(p[4] for p in held) + bytes(8),
               "checkpoints": np.concatenate(marks).astype("<u4").tobytes(), "records": [p[0] for p in held], "sizes": [p[3] for p in held]}
        seen, held, block, count = seen + count, [], block + 1, 0
        return out

    for piece in pieces:
        if piece[1] != last:
            place, last = place + 1, piece[1]
        if held and piece[6]:
            yield flush()
        held.append((*piece, place))
        count += piece[3]
        if count >= limit or piece[6]:
            yield flush()
    if held:
        yield flush()


def write(records: DataFrame, record_id: str = "doc_id", ids: str = "ids", end_id: int = 0, folder: str | None = None) -> str:
    """Write the ids of all records, in ascending order of record_id, and return the folder.

    After each record comes `end_id`. Null ids are no ids. Null record ids come first; equal record ids follow each other in
    any order. Other columns are not written. An empty table gives a file set without blocks. Ids lie in 0 .. MAX_SYMBOLS -
    1; counts of all ids are gathered (one row for each id, so bounded by MAX_SYMBOLS). `records` is computed three times (counts,
    coding, and its record ids, whose ranges are the parts: one bound for each): pass a stored table. Records are coded before they
    are sorted, so the shuffle moves coded bits. Record ids are numbers, texts, bytes, dates or times.
    """
    spark = small_batches(records).sparkSession
    folder = folder or f"{_shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    kind = records.schema[record_id].dataType.simpleString()
    whole = records.select(F.col(record_id).alias("record"), F.coalesce(F.col(ids), F.lit(b"")).alias("ids"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(MAX_SYMBOLS, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4"), minlength=MAX_SYMBOLS)
            total[end_id] += batch.num_rows
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["id", "n"])

    counts = np.zeros(MAX_SYMBOLS, np.int64)
    for r in whole.select("ids").mapInArrow(counted, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r.id] = r.n
    lengths = code_lengths(counts)
    shared = spark.sparkContext.broadcast(lengths)
    limit = BLOCK_IDS
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = whole.select("record").repartitionByRange(n, "record").groupBy(F.spark_partition_id()).agg(F.max("record").alias("last"))
    bounds = sorted(b for b in ranges.select("last").toArrow().column(0).to_pylist() if b is not None and b == b)[:n - 1]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, row = canonical(shared.value), TaskContext.get().partitionId() << 33
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                yield _encode(some, code, limit, end_id, row, bounds)
                row += some.num_rows

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None

        def pieces() -> Iterator[tuple]:
            nonlocal schema
            for batch in batches:
                schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first_place", pa.int32()), ("first_id", pa.int64()),
                                    ("n_ids", pa.int32()), ("whole", pa.bool_()), ("bits", pa.binary()), ("checkpoints", pa.binary()),
                                    ("records", pa.list_(batch.schema.field(0).type)), ("sizes", pa.list_(pa.int32()))])
                yield from zip(*(batch.column(i).to_pylist() for i in range(7)))

        for block in _blocks(TaskContext.get().partitionId(), pieces(), limit):
            yield pa.RecordBatch.from_pylist([block], schema=schema)

    pieces_of = whole.mapInArrow(coded, f"record {kind}, row long, number int, n int, bits binary, marks binary, cut boolean, part int")
    ordered = pieces_of.repartitionById(n, "part").drop("part").sortWithinPartitions("record", "row", "number")
    ordered.mapInArrow(blocks, BLOCK_TYPE.format(kind=kind)).write.option("compression", "none").parquet(f"{folder}/blocks")
    spark.createDataFrame([(bytearray(lengths.tobytes()), end_id)], "lengths binary, end_id int").write.parquet(f"{folder}/code")
    return folder


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Read a file set: one row for each record, with record, start (ids of all records before it), and ids (its own,
    packed, the end id included).

    Blocks are decoded alone, once, and in any order. Starts come from one sum for each part, which the number of written
    partitions bounds. A cut record is joined again.
    """
    blocks = spark.read.parquet(f"{folder}/blocks")
    head = spark.read.parquet(f"{folder}/code").first()
    lengths = np.frombuffer(bytes(head.lengths), np.uint8)
    shared = spark.sparkContext.broadcast(lengths)
    kind = blocks.schema["records"].dataType.elementType.simpleString()

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = canonical(shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                r = {name: batch.column(name)[i] for name in ("part", "first_place", "first_id", "bits", "checkpoints")}
                sizes = batch.column("sizes")[i].values.to_numpy()
                ids = unpack(code, r["bits"].as_buffer(), np.frombuffer(r["checkpoints"].as_buffer(), "<u4"), sizes)
                ends = np.cumsum(sizes)
                k = len(sizes)
                yield pa.record_batch([
                    pa.array(np.full(k, r["part"].as_py(), np.int32)), pa.array(r["first_place"].as_py() + np.arange(k, dtype=np.int32)),
                    batch.column("records")[i].values, pa.array(r["first_id"].as_py() + ends - sizes),
                    pa.BinaryArray.from_buffers(pa.binary(), k, [None, pa.py_buffer((4 * np.concatenate([[0], ends])).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])],
                    names=["part", "place", "record", "first_id", "ids"])

    def pieces(some: DataFrame) -> DataFrame:
        return some.select("part", "first_place", "first_id", "n_ids", "bits", "checkpoints", "records", "sizes").mapInArrow(
            decoded, f"part int, place int, record {kind}, first_id long, ids binary")

    joined = (pieces(blocks.where(F.col("whole") == F.lit(False))).groupBy("part", "place").agg(
        F.first("record").alias("record"), F.min("first_id").alias("first_id"),
        F.array_sort(F.collect_list(F.struct("first_id", "ids"))).alias("runs"))
        .withColumn("ids", F.aggregate("runs", F.lit(b""), lambda done, run: F.concat(done, run["ids"])))
        .select("part", "place", "record", "first_id", "ids"))
    parts = blocks.groupBy("part").agg(F.sum(F.col("n_ids").cast("long")).alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return pieces(blocks.where("whole")).unionByName(joined).join(F.broadcast(before), "part").select(
        "record", (F.col("before") + F.col("first_id")).alias("start"), "ids")
