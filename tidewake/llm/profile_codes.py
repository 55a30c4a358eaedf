"""Short codes for unit profiles: product quantisation in integers, with pivot distances in place of most evaluations.

In the project's terms a record is a unit, such as a port, with its profile (an array of values, such as its daily CO2) and
its traffic class. A profile is cut into equal parts; each part gets the index of the nearest entry of its codebook.

The search is LAESA: each part's distances to a few fixed pivots are computed once and stored beside it. In a round, the
pivots' distances to the entries give |d(part, pivot) - d(pivot, entry)| as a lower bound for every entry. Entries are
visited from the least bound on, and only while the bound does not exceed the best exact distance so far; distances that
decide are exact integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidewake.operators.sizing import checkpointed

from .topk import scaled

PIVOTS = 4
#: Scaled values below this keep every distance and their sum over a profile inside 64 bits.
MAX_VALUE = 1 << 27
#: Error totals of classes are joined in so many parts, as one class can hold most units.
CLASS_PARTS = 32


def distances(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Euclidean distance of every row to every entry, as floats."""
    return np.sqrt(np.stack([((rows - e) ** 2).sum(axis=1) for e in entries], axis=1).astype(np.float64))


def far_apart(entries: np.ndarray, count: int) -> np.ndarray:
    """Up to `count` entries, each as far as possible from those before it; the first is entry 0."""
    chosen = [0]
    least = distances(entries, entries[:1])[:, 0]
    while len(chosen) < min(count, len(entries)):
        chosen.append(int(least.argmax()))
        least = np.minimum(least, distances(entries, entries[chosen[-1:]])[:, 0])
    return entries[chosen]


def nearest(rows: np.ndarray, to_pivot: np.ndarray, entries: np.ndarray, entry_to_pivot: np.ndarray):
    """Index and squared distance of the nearest entry of each row (ties to the lower index), and the number of exact
    evaluations. Stored distances are single floats, so bounds are lowered by more than their rounding."""
    bound = np.zeros((len(rows), len(entries)))
    for pivot in range(to_pivot.shape[1]):
        x, e = to_pivot[:, pivot, None].astype(np.float64), entry_to_pivot[None, :, pivot]
        np.maximum(bound, np.abs(x - e) - 1e-6 * (x + e) - 1e-6, out=bound)
    bound *= bound
    order = np.argsort(bound, axis=1, kind="stable")
    best, at = np.full(len(rows), np.iinfo(np.int64).max), np.full(len(rows), len(entries))
    alive, evaluated = np.arange(len(rows)), 0
    for step in range(len(entries)):
        entry = order[alive, step]
        open_ = bound[alive, entry] <= best[alive]
        alive, entry = alive[open_], entry[open_]
        if not len(alive):
            break
        evaluated += len(alive)
        exact = ((rows[alive] - entries[entry]) ** 2).sum(axis=1)
        better = (exact < best[alive]) | ((exact == best[alive]) & (entry < at[alive]))
        best[alive[better]], at[alive[better]] = exact[better], entry[better]
    return at, best, evaluated


def _parts(column: pa.Array, parts: int, width: int) -> np.ndarray:
    """Rows of integers as (row, part, position), filled up with 0 on the right."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), parts * width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out.reshape(len(sizes), parts, width)


def _stored(batch: pa.RecordBatch, parts: int, width: int, pivots: int) -> tuple[np.ndarray, np.ndarray]:
    """Parts and pivot distances of a batch."""
    to_pivot = batch.column("to_pivot").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, parts, pivots)
    return _parts(batch.column("v"), parts, width), to_pivot


def _moved(ready: DataFrame, books: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Codebooks after one round. A task sends counts and sums of the entries, never rows of units."""
    parts, entries, width = books.shape
    kept = pivots.shape[1]

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        between = [distances(books[p], pivots[p]) for p in range(parts)]
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            rows, to_pivot = _stored(batch, parts, width, kept)
            for p in range(parts):
                at, _, _ = nearest(rows[:, p], to_pivot[:, p], books[p], between[p])
                count[p] += np.bincount(at, minlength=entries)
                np.add.at(total[p], at, rows[:, p])
        part, entry = np.nonzero(count)
        yield pa.record_batch({"part": pa.array(part, pa.int32()), "entry": pa.array(entry, pa.int32()), "held": count[part, entry],
                               "total": pa.array(list(total[part, entry]), pa.list_(pa.int64()))})

    sums = ready.mapInArrow(totals, "part int, entry int, held long, total array<long>").groupBy("part", "entry").agg(
        F.sum("held").alias("held"), F.array(*[F.sum(F.col("total")[i]) for i in range(width)]).alias("total"))
    moved = books.copy()
    for r in sums.collect():                                        # at most one row per entry
        moved[r.part, r.entry] = [t // r.held for t in r.total]
    return moved


def compress(profiles: DataFrame, port: str = "port", values: str = "values", vclass: str = "vclass", parts: int = 16, entries: int = 64,
             rounds: int = 2, factor: int = 256) -> DataFrame:
    """Codes of all profiles: port, vclass, code, error, class_error, codebooks_sha256.

    profiles: a unit id (of a type that can be sorted), an array of numbers and a class. Values become floor(factor * value).
    Profiles that are null or hold a null or non-finite value are left out; shorter ones count as 0 beyond their end, also
    where the longest does not fill its last part. Codebooks start as the parts of the `entries` profiles of the least
    units (null units last; equal units by values), all of them if there are fewer. In each round every part goes to its
    nearest entry (squared distance, ties to the lower index) and each entry becomes the componentwise floor of the mean of
    its parts; unused entries stay.

    code: index of the entry of each part, two hex digits each (so entries <= 256); error: squared distances summed over
    parts; class_error: error summed over the units of a class, null being a class; codebooks_sha256: lowercase hex of all
    final components by part, entry and position, comma-joined. Repeated rows come back each. No profiles give no rows.
    Other columns are not read. Values of 2**27 or more after scaling raise an error, as sums of their squares would not be longs.
    """
    scaled_rows = profiles.select(F.col(port).alias("u"), F.col(vclass).alias("c"), scaled(values, factor).alias("v")).where("v IS NOT NULL")
    facts = scaled_rows.agg(F.max(F.size("v")).alias("width"), F.max(F.when(F.size("v") > 0, F.array_max(F.transform("v", lambda x: F.abs(x))))).alias("most")).first()
    if (facts.most or 0) >= MAX_VALUE:
        raise ValueError(f"scaled values must stay below {MAX_VALUE}")
    width = max(1, -(-(facts.width or 0) // parts))
    least = scaled_rows.orderBy(F.col("u").asc_nulls_last(), "v").select("v").limit(entries).collect()
    books = np.zeros((parts, max(1, len(least)), width), np.int64)
    for i, row in enumerate(least):
        books[:, i] = np.array(row.v + [0] * (parts * width - len(row.v)), np.int64).reshape(parts, width)
    pivots = np.stack([far_apart(book, PIVOTS) for book in books])
    kept = pivots.shape[1]

    def tabled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _parts(batch.column("v"), parts, width)
            table = np.stack([distances(rows[:, p], pivots[p]) for p in range(parts)], axis=1).astype(np.float32)
            listed = pa.FixedSizeListArray.from_arrays(pa.array(table.reshape(-1)), parts * kept).cast(pa.list_(pa.float32()))
            yield pa.record_batch([*batch.columns, listed], names=["u", "c", "v", "to_pivot"])

    fields = ", ".join(f"{name} {scaled_rows.schema[name].dataType.simpleString()}" for name in ("u", "c"))
    ready = checkpointed(scaled_rows.mapInArrow(tabled, f"{fields}, v array<long>, to_pivot array<float>"))
    for _ in range(rounds):
        books = _moved(ready, books, pivots)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        between = [distances(books[p], pivots[p]) for p in range(parts)]
        for batch in batches:
            rows, to_pivot = _stored(batch, parts, width, kept)
            code, error = np.zeros((len(rows), parts), np.uint8), np.zeros(len(rows), np.int64)
            for p in range(parts):
                at, best, _ = nearest(rows[:, p], to_pivot[:, p], books[p], between[p])
                code[:, p] = at
                error += best
            yield pa.record_batch([batch.column("u"), batch.column("c"), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)],
                                  names=["u", "c", "code", "error"])

    done = checkpointed(ready.mapInArrow(coded, f"{fields}, code string, error long"))
    totals = done.groupBy("c").agg(F.sum("error").alias("class_error")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(CLASS_PARTS - 1))))
    dealt = done.withColumn("part", F.pmod(F.xxhash64("u", "code"), F.lit(CLASS_PARTS)).cast("int"))
    joined = dealt.join(totals.withColumnRenamed("c", "k").withColumnRenamed("part", "q"),
                        (F.col("part") == F.col("q")) & F.col("c").eqNullSafe(F.col("k")))
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return joined.select(F.col("u").alias("port"), F.col("c").alias("vclass"), "code", "error", "class_error", F.lit(digest).alias("codebooks_sha256"))
