"""Exact top-k search by integer inner product, with MaxScore pruning.

In the project's terms a row is a unit (a port, a vessel) with a profile: an array of values, such as its daily series. A
dimension is a term, and a unit's value in it is its posting.

A first pass scores every query against a bounded sample of units; its k-th best is a floor that no answer lies below.
Queries are dealt into blocks and units into shards of about equal norm; a query goes only to shards whose norms can reach
its floor. In a cell of block and shard, terms are split for each query by what they can add at most: terms whose bounds
together cannot lift a unit over the floor are non-essential. Essential postings are traversed for all units; for units that can
still get in, the other terms are probed one after the other from the largest bound on, and a unit is dropped as soon as what is
left, by its bounds or its norm, cannot lift it over the floor. Shard results are merged by rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidewake.operators.sizing import checkpointed

BLOCK_QUERIES = 8192
SHARD_UNITS = 16384
STEP_UNITS = 256
#: Units that the first pass scores all queries against; a bound on what is sent to all tasks. Any sample gives the same answers.
SAMPLE_UNITS = 1024
#: Sums that stay below this are exact as doubles, up to MAX_LONG as 64-bit integers.
MAX_EXACT, MAX_LONG = 1 << 53, 1 << 63


def scaled(values: str, factor: int = 256):
    """Array of floor(factor * x) as long, x as double; null if a component is null or not finite."""
    fine = F.forall(values, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))) & ~F.isnan(x.cast("double")))
    whole = F.transform(values, lambda x: F.floor(F.lit(float(factor)) * x.cast("double")))
    return F.when(fine, whole)


def _matrix(column: pa.Array, width: int, kind: type = np.float64) -> np.ndarray:
    """Rows of packed 64-bit integers, filled up with 0 on the right."""
    rows = [np.frombuffer(value, np.int64) for value in column.to_pylist()]
    out = np.zeros((len(rows), width), kind)
    for i, row in enumerate(rows):
        out[i, :len(row)] = row
    return out


def _top(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int):
    """Positions of the k best of each row, ties to the smaller id, and their ranks from 0."""
    place = np.lexsort((ids, -score, row))
    counts = np.bincount(row, minlength=1)
    rank = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    return place[rank < k], rank[rank < k]


def best_of_cell(query_rows: np.ndarray, queries: np.ndarray, floor: np.ndarray, unit_rows: np.ndarray, unit_ids: np.ndarray, units: np.ndarray, k: int):
    """(query, position of the unit, score) of the k best units of each query that reach its floor, ties to the smaller unit id, and
    the number of probes made in non-essential terms. A query's own row is no answer."""
    n, width = queries.shape
    low_q, high_q = np.minimum(queries, 0), np.maximum(queries, 0)
    floor = floor.copy()
    top_q, top_at, top_score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, queries.dtype)
    norms = np.sqrt((units.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)
    probes, every = 0, np.arange(n)[:, None]
    for start in range(0, len(units), STEP_UNITS):
        some = units[start:start + STEP_UNITS]
        least, most = some.min(axis=0), some.max(axis=0)
        bound, lowest = high_q * most + low_q * least, high_q * least + low_q * most      # what a term adds at most, and at least
        spread = bound - lowest
        order = np.argsort(-spread, axis=1, kind="stable")
        left = np.cumsum(spread[every, order][:, ::-1], axis=1)[:, ::-1]                    # spread of a term and all smaller ones
        essential = (left >= (floor - lowest.sum(axis=1))[:, None]).sum(axis=1)             # a prefix of the order
        rest = np.concatenate([np.cumsum(bound[every, order][:, ::-1], axis=1)[:, ::-1], np.zeros((n, 1))], axis=1)
        tail = np.concatenate([np.cumsum((queries[every, order].astype(np.float64) ** 2)[:, ::-1], axis=1)[:, ::-1], np.zeros((n, 1))], axis=1)
        tail = np.sqrt(tail) * (1 + 1e-9)
        kept = np.zeros(queries.shape, bool)
        np.put_along_axis(kept, order, np.arange(width)[None, :] < essential[:, None], axis=1)
        partial = np.where(kept, queries, 0) @ some.T
        reach = np.minimum(rest[np.arange(n), essential][:, None], tail[np.arange(n), essential][:, None] * norms[None, start:start + STEP_UNITS])
        row, at = np.nonzero(partial + reach >= floor[:, None])
        score, term, done = partial[row, at], essential[row], []
        while len(row):                                              # the next term of every pair that is still competitive
            full = term == width
            if full.any():
                done.append((row[full], at[full], score[full]))
                row, at, score, term = row[~full], at[~full], score[~full], term[~full]
            probes += len(row)
            which = order[row, term]
            score = score + queries[row, which] * some[at, which]
            term = term + 1
            fits = score + np.minimum(rest[row, term], tail[row, term] * norms[start + at]) >= floor[row]
            row, at, score, term = row[fits], at[fits], score[fits], term[fits]
        if not done:
            continue
        row, at, score = (np.concatenate(parts) for parts in zip(*done))
        other = query_rows[row] != unit_rows[start + at]
        top_q, top_at = np.concatenate([top_q, row[other]]), np.concatenate([top_at, start + at[other]])
        top_score = np.concatenate([top_score, score[other]])
        place, rank = _top(top_q, unit_ids[top_at], top_score, k)
        top_q, top_at, top_score = top_q[place], top_at[place], top_score[place]
        last = rank == k - 1
        floor[top_q[last]] = np.maximum(floor[top_q[last]], top_score[last])
    return top_q, top_at, top_score, probes


def _packed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The same rows with their integers as bytes and with their norm."""
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [np.array(v, np.int64) for v in batch.column("v").to_pylist()]
            norm = [float(np.sqrt((v.astype(np.float64) ** 2).sum())) for v in values]
            yield pa.record_batch([*[batch.column(c) for c in columns], pa.array([v.tobytes() for v in values], pa.binary()), pa.array(norm, pa.float64())], names=[*columns, "p", "norm"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)
    return rows.mapInArrow(packed, f"{kinds}, p binary, norm double")


def most_alike(profiles: DataFrame, wanted, unit: str = "unit", values: str = "values", k: int = 5, factor: int = 256) -> DataFrame:
    """The k units of the highest score for each wanted row: floor(factor * value) of both, multiplied and summed.

    profiles: rows of a unit id (long) and an array of numbers. wanted: condition on the columns of profiles; its rows
    are the queries, all rows but the query's own are searched, in blocks. Arrays that are null or hold a null or non-finite number
    take no part; shorter arrays count as 0 beyond their end. Rows without an id take no part. Repeated rows are queries and
    answers each. Ties go to the smaller unit. Returns query_unit, rank (from 1), unit, score (long); fewer rows if there are
    fewer units, none for an empty table. Other columns are not read. Scores that could leave 64 bits are an error.
    """
    ready = checkpointed(_packed(profiles.where(F.col(unit).isNotNull()).select(
        F.col(unit).cast("long").alias("u"), scaled(values, factor).alias("v"), F.coalesce(wanted, F.lit(False)).alias("q"))
        .where("v is not null").withColumns({"n": F.monotonically_increasing_id(), "size": F.size("v"), "most": F.coalesce(F.array_max(F.transform("v", lambda x: F.abs(x))), F.lit(0))}),
        ["u", "q", "n", "size", "most"]))
    facts = ready.agg(F.count(F.lit(1)).alias("units"), F.sum(F.col("q").cast("long")).alias("asked"), F.max("size").alias("width"), F.max("most").alias("largest")).first()
    width = max(1, facts.width or 1)
    if width * (facts.largest or 0) ** 2 >= MAX_LONG:
        raise ValueError("scores would not fit 64 bits")
    kind = np.float64 if width * (facts.largest or 0) ** 2 < MAX_EXACT else np.int64
    sample = ready.orderBy(F.xxhash64("n"), "n").limit(SAMPLE_UNITS).select("n", "p").collect()
    known_rows = np.array([r.n for r in sample], np.int64)
    known = _matrix(pa.array([r.p for r in sample], pa.binary()), width, kind)

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = _matrix(batch.column("p"), width, kind) @ known.T
            own = batch.column("n").to_numpy()[:, None] == known_rows[None, :]
            count = scores.shape[1] - own.sum(axis=1)
            scores = np.where(own, np.iinfo(np.int64).min if kind is np.int64 else -np.inf, scores)
            best = np.sort(scores, axis=1)[:, ::-1]
            floor = np.where(count >= k, best[:, min(k, best.shape[1]) - 1].astype(np.float64), -np.inf)
            yield pa.record_batch([batch.column("u"), batch.column("n"), batch.column("p"), batch.column("norm"), pa.array(floor - np.abs(floor) * 1e-15)], names=["u", "n", "p", "norm", "floor"])

    # shards of units of about equal norm: a few hundred norm classes, each cut by hash into shards of bounded size
    level = F.floor(F.log2(F.col("norm") + 1) * 8)
    classes = ready.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("held"), F.max("norm").alias("top")).collect()
    shards = {r.level: max(1, -(-r.held // SHARD_UNITS)) for r in classes}
    blocks = -(-(facts.asked or 0) // BLOCK_QUERIES) or 1
    if not classes or not facts.asked:
        return ready.sparkSession.createDataFrame([], "query_unit long, rank int, unit long, score long")
    count_of = F.element_at(F.create_map(*[F.lit(x) for r in classes for x in (r.level, shards[r.level])]), level)
    units = (ready.select("u", "n", "p", level.alias("level"), F.pmod(F.xxhash64("n"), count_of).alias("shard"))
             .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))))
    # both sides of a cell are dealt by the hash of its keys, and that of an int differs from that of the same long
    every = F.array(*[F.struct(F.lit(r.level).cast("long").alias("level"), F.lit(shards[r.level]).cast("long").alias("count"), F.lit(r.top).alias("top")) for r in classes])
    asked = ready.where("q").select("u", "n", "p", "norm").mapInArrow(floors, "u long, n long, p binary, norm double, floor double")
    able = F.filter(every, lambda s: s["top"] * F.col("norm") * (1 + 1e-9) >= F.col("floor"))
    asked = (asked.withColumn("block", F.pmod(F.xxhash64("n"), F.lit(blocks))).withColumn("s", F.explode(able))
             .select("u", "n", "p", "floor", "block", "s.level", F.explode(F.sequence(F.lit(0).cast("long"), F.col("s.count") - 1)).alias("shard")))

    def cell(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("query_unit", "asked", "unit", "score")})
        ids = rows.column("u").to_numpy()
        row, at, score, _ = best_of_cell(queries.column("n").to_numpy(), _matrix(queries.column("p"), width, kind), queries.column("floor").to_numpy(),
                                         rows.column("n").to_numpy(), ids, _matrix(rows.column("p"), width, kind), k)
        return pa.table({"query_unit": queries.column("u").to_numpy()[row], "asked": queries.column("n").to_numpy()[row], "unit": ids[at], "score": score.astype(np.int64)})

    keys = ["block", "level", "shard"]
    cells = asked.groupBy(*keys).cogroup(units.groupBy(*keys)).applyInArrow(cell, "query_unit long, asked long, unit long, score long")
    best = Window.partitionBy("query_unit", "asked").orderBy(F.col("score").desc(), "unit")
    return cells.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_unit", "rank", "unit", "score")
