"""Removal of byte strings that occur more than once, by suffix arrays of shards.

The project keeps no free text, so the operators are general: records are any table with an id and a text column.

Every window of `length` bytes has an anchor: the 32-byte gram in it with the least hash. Equal windows have equal anchors,
so windows are dealt out by the hash of their anchor, and neighbours that share an anchor travel as one piece. Anchors that
occur once cannot hold a repeat and go no further; equal pieces are counted before anything is shuffled. A window reaches
half of what it holds beside its anchor to the left or to the right, so a piece that shares neither side with another is
left out too. What is left, one copy of each piece, is gathered in shards of bounded size. A shard's suffix array is built by induced sorting, its permuted
common prefixes tell which windows start a repeat, and the places go back to the texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from tidewake.operators.sizing import _shared_folder, checkpointed, spread

from .columns import small_batches
from .suffix_array import common_prefixes, suffix_array

LENGTH = 200
GRAM = 32
BLOCK_BYTES = 1 << 17
SHARD_BYTES = 2 << 20
#: Different pieces of one anchor that may meet in a shard; anchors with more are split by the windows' own hashes.
ANCHOR_PIECES = 2048

_PLACE_BITS = 18
_BYTE_HASH = np.array([xxhash.xxh64_intdigest(bytes([b]), 9) for b in range(256)], np.uint64)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the gram that starts at each byte, by doubling."""
    h = _BYTE_HASH[data]
    step = 1
    while step < GRAM:
        x = h[:-step] * _M1
        x += h[step:]
        x ^= x >> np.uint64(32)
        x *= _M2
        h, step = x, step * 2
    return h


def _anchors(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the least gram among `width` ones from each place on, the first of equals."""
    packed = (h >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | np.arange(len(h), dtype=np.uint64)
    step = 1
    while step * 2 <= width:
        packed = np.minimum(packed[:-step], packed[step:])
        step *= 2
    if step < width:
        packed = np.minimum(packed[:len(packed) - (width - step)], packed[width - step:])
    return (packed & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)


def pieces_of(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Pieces of texts: text number, first window, windows, anchor hash, content hash, and the hashes of the left and the
    right side of the anchor in the two halves of a long (0 for a side that no window holds)."""
    found: list[list] = [[], [], [], [], [], []]
    half = (length - GRAM) // 2
    parts, size = [], 0                                   # text number, offset in the text, bytes

    def flush() -> None:
        blob = b"".join(p[2] for p in parts)
        h = _gram_hashes(np.frombuffer(blob, np.uint8))
        anchor = _anchors(h, length - GRAM + 1)
        sizes = np.array([len(p[2]) for p in parts])
        begin = np.cumsum(sizes) - sizes
        windows = sizes - length + 1
        owner = np.repeat(np.arange(len(parts)), windows)
        place = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + begin[owner]
        own = anchor[place]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        counts = np.diff(np.append(first, len(own)))
        start, part = place[first], owner[first]
        found[0].append(np.array([p[0] for p in parts])[part])
        found[1].append(start - begin[part] + np.array([p[1] for p in parts])[part])
        found[2].append(counts)
        found[3].append(h[own[first]].view(np.int64))
        found[4].append(np.array([xxhash.xxh3_64_intdigest(blob[a:b]) for a, b in zip(start.tolist(), (start + counts + length - 1).tolist())],
                                 np.uint64).view(np.int64))
        at, low, high = own[first].tolist(), begin[part].tolist(), (begin + sizes)[part].tolist()
        side = xxhash.xxh32_intdigest
        found[5].append(np.array([(side(blob[a - half:a + GRAM]) | 1 if a - half >= b else 0) << 32 | (side(blob[a:a + GRAM + half]) | 1 if a + GRAM + half <= e else 0)
                                  for a, b, e in zip(at, low, high)], np.uint64).view(np.int64))

    for i, text in enumerate(texts):
        at = 0
        while len(text) - at >= length:
            part = text[at:at + BLOCK_BYTES]
            if parts and size + len(part) > BLOCK_BYTES:
                flush()
                parts, size = [], 0
            parts.append((i, at, part))
            size += len(part)
            at += len(part) - length + 1
    if parts:
        flush()
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in found)


def _pieces(texts: DataFrame, length: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                some = batch.slice(i, 512)
                number, start, windows, anchor, content, sides = pieces_of([unpack(z.as_py()) for z in some.column(1)], length)
                yield pa.record_batch([pa.array(anchor), pa.array(content), some.column(0).take(pa.array(number)),
                                       pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array(sides)],
                                      names=["anchor", "content", "t", "start", "windows", "sides"])

    return texts.select("t", "z").mapInArrow(cut, "anchor long, content long, t binary, start int, windows int, sides long")


def repeated_windows(texts: list[bytes], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """Runs of window starts, in each text, whose window starts anywhere else in any of the texts too."""
    joined = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.uint16)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes + 1) - 1
    joined += 1
    joined[ends] = 0                                      # below every byte
    order = suffix_array(joined)
    prefix = common_prefixes(joined, order)
    left = np.repeat(ends, sizes + 1) - np.arange(len(joined))
    starts = (prefix >= length) & (left >= length)
    # the suffix before one that shares enough starts a repeat as well
    before = np.full(len(joined), -1, np.int64)
    before[order[1:]] = order[:-1]
    starts[before[starts]] = True
    edge = np.flatnonzero(np.diff(np.concatenate([[0], starts.view(np.int8), [0]])))
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        i = int(np.searchsorted(ends, a))
        out[i].append((a - int(ends[i] - sizes[i]), b - int(ends[i] - sizes[i])))
    return out


def _shards(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Suffix arrays over a partition that is sorted by anchor. A shard ends between anchors once it is full. A piece that
    comes under several salts is in a shard once, or it would repeat itself."""
    rows: list[tuple] = []
    here: set[tuple] = set()
    size, key = 0, None

    def flush() -> pa.RecordBatch:
        runs = repeated_windows([r[3] for r in rows], length)
        hits = [(r, run) for r, found in zip(rows, runs) if r[2] == 1 for run in found]
        return pa.record_batch([pa.array([r[0] for r, _ in hits], pa.binary()), pa.array([r[1] + a for r, (a, _) in hits], pa.int32()),
                                pa.array([r[1] + b for r, (_, b) in hits], pa.int32())], names=["t", "first", "end"])

    for batch in batches:
        for anchor, salt, t, start, n, piece in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if size >= SHARD_BYTES and (anchor, salt) != key:
                yield flush()
                rows, size = [], 0
                here.clear()
            key = (anchor, salt)
            if (t, start) not in here:
                here.add((t, start))
                rows.append((t, start, n, piece))
                size += len(piece)
    if rows:
        yield flush()


def _distinct_texts(records: DataFrame, length: int) -> DataFrame:
    """Texts of at least `length` bytes, once each, compressed, in a table bucketed by their digest, so that later joins
    by digest move no text. Copies are counted and dropped before the shuffle."""
    spark = records.sparkSession

    @F.arrow_udf("binary")
    def packed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield pa.array([pack(v.as_py()) for v in batch], pa.binary())

    long = records.where(F.octet_length("body") >= length)
    texts = long.select("t", packed(F.col("body").cast("binary")).alias("z")).groupBy("t").agg(
        F.first("z").alias("z"), F.count(F.lit(1)).alias("copies"))
    name = f"texts_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts.write.bucketBy(n, "t").option("path", f"{_shared_folder(spark)}/{name}").option("compression", "none").saveAsTable(name)
    return spark.table(name)


def _window_runs(texts: DataFrame, length: int) -> DataFrame:
    """Runs (t, first, end) of window starts that start somewhere else too, between different texts or inside one."""
    # stored, so that the join below reads two plain shuffles and adaptive execution can split a hot anchor
    live = checkpointed(_pieces(texts, length).groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"))
    pieces = checkpointed(_pieces(texts, length).join(live, "anchor", "left_semi"))
    groups = checkpointed(pieces.groupBy("anchor", "content").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("t", "start", "windows")).alias("at"), F.min("sides").alias("sides"))
        .select("anchor", "n", "at", "content", F.shiftrightunsigned("sides", 32).alias("left"), F.col("sides").bitwiseAND(F.lit(0xFFFFFFFF)).alias("right")))
    chosen = groups
    for side in ("left", "right"):
        shared = checkpointed(groups.where(F.col(side) != 0).groupBy("anchor", side).agg(F.count(F.lit(1)).alias("k")).where("k > 1")
                              .select("anchor", side, F.lit(True).alias(f"{side}_shared")))
        chosen = chosen.join(shared, ["anchor", side], "left")
    chosen = checkpointed(chosen.where("left_shared or right_shared").select("anchor", "n", "at"))
    hot = checkpointed(chosen.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > ANCHOR_PIECES))
    fetch = chosen.join(hot, "anchor", "left").groupBy("at.t").agg(
        F.collect_list(F.struct("at.start", "at.windows", "anchor", "n", F.coalesce("kinds", F.lit(1)).alias("kinds"))).alias("asked"))

    limit = ANCHOR_PIECES

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i in range(batch.num_rows):
                t, text = batch.column(0)[i].as_py(), unpack(batch.column(1)[i].as_py())
                out: list[tuple] = []
                for r in batch.column(2)[i].as_py():
                    piece = text[r["start"]:r["start"] + r["windows"] + length - 1]
                    salts = -(-r["kinds"] // limit)
                    own = {0} if salts == 1 else {xxhash.xxh64_intdigest(piece[k:k + length]) % salts for k in range(r["windows"])}
                    out += [(r["anchor"], salt, t, r["start"], min(r["n"], 2), piece) for salt in own]
                columns = list(zip(*out))
                yield pa.record_batch([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.binary()))],
                                      names=["anchor", "salt", "t", "start", "n", "piece"])

    cuts = texts.join(fetch, "t").select("t", "z", "asked").mapInArrow(cut, "anchor long, salt int, t binary, start int, n int, piece binary")
    dealt = spread(cuts, "anchor", "salt").sortWithinPartitions("anchor", "salt")
    singles = dealt.mapInArrow(lambda batches: _shards(batches, length), "t binary, first int, end int")
    repeated = groups.where("n > 1").select("anchor", "content")
    whole = pieces.join(repeated, ["anchor", "content"], "left_semi").select("t", F.col("start").alias("first"), (F.col("start") + F.col("windows")).alias("end"))
    return singles.unionByName(whole)


def drop_repeats(records: DataFrame, record_id: str = "doc_id", text: str = "text", length: int = LENGTH,
                 derive: Callable[[Column], dict[str, Column]] = lambda kept: {"kept": kept}) -> DataFrame:
    """Remove every byte that a string of `length` bytes covers which starts anywhere else too, in this record or another.

    Texts are UTF-8 bytes; strings never cross records, overlaps count, and all is judged on the input. derive: columns
    to return of the binary column of remaining bytes, by name; by default those bytes themselves. They are computed once
    for each different text, so copies need not be carried around whole.

    Returns record_id, n_bytes, n_removed, n_spans (maximal removed runs), and the derived columns. A null text is an
    empty one; texts shorter than `length` stay whole; repeated rows are copies of each other and lose everything if they
    are long enough; a null id stays null. An empty table gives no rows. Other columns are left out.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    plain = small_batches(records).select(F.col(record_id).alias("record"), body.alias("body")).withColumn(
        "t", F.substring(F.unhex(F.sha2(F.col("body").cast("binary"), 256)), 1, 16))
    texts = _distinct_texts(plain.select("t", "body"), length)
    runs = _window_runs(texts, length).groupBy("t").agg(F.collect_list(F.struct("first", "end")).alias("runs"))

    @F.arrow_udf("struct<kept:binary,n_removed:long,n_spans:long>")
    def removed(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        unpack = zstandard.ZstdDecompressor().decompress
        kind = pa.struct([("kept", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64())])
        for packed, places, copies in batches:
            out = []
            for z, found, n in zip(packed, places, copies):
                value = np.frombuffer(unpack(z.as_py()), np.uint8)
                change = np.zeros(len(value) + 1, np.int32)
                if n.as_py() > 1:
                    change[0] += 1
                    change[-1] -= 1
                for run in found.as_py() or ():
                    change[run["first"]] += 1
                    change[run["end"] - 1 + length] -= 1
                gone = np.cumsum(change[:-1]) > 0
                out.append({"kept": value[~gone].tobytes(), "n_removed": int(gone.sum()),
                            "n_spans": int((gone & ~np.concatenate([[False], gone[:-1]])).sum())})
            yield pa.array(out, kind)

    changed = texts.join(runs, "t", "left").where("runs is not null or copies > 1").select("t", removed("z", "runs", "copies").alias("r"))
    names = list(derive(F.col("r.kept")))
    changed = changed.select("t", "r.n_removed", "r.n_spans", F.struct(*[c.alias(k) for k, c in derive(F.col("r.kept")).items()]).alias("derived"))
    own = plain.select("record", "t", F.octet_length("body").cast("long").alias("n_bytes"),
                       F.struct(*[c.alias(k) for k, c in derive(F.col("body").cast("binary")).items()]).alias("untouched"))
    final = F.coalesce("derived", "untouched")
    return own.join(changed, "t", "left").select(
        F.col("record").alias(record_id), "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"), *[final[k].alias(k) for k in names])
