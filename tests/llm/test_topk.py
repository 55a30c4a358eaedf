"""MaxScore against scoring everything."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.llm import topk


def slow(rows, k):
    fine = [(u, [math.floor(256 * x) for x in v]) for u, v in rows if u is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, (q, qv) in enumerate(fine):
        if q % 5:
            continue
        scored = sorted((-sum(a * b for a, b in zip(qv, v)), u) for j, (u, v) in enumerate(fine) if j != i)[:k]
        out += [(q, i + 1, u, -s) for i, (s, u) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("sample,shard,block", [(1024, 16384, 8192), (9, 40, 6), (2, 16384, 6)])
def test_ports_by_profile(spark, monkeypatch, sample, shard, block):
    monkeypatch.setattr(topk, "SAMPLE_UNITS", sample)
    monkeypatch.setattr(topk, "SHARD_UNITS", shard)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", block)
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(8)]) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(30)]                     # many equal profiles: ties
    rows += [(300, None), (305, [1.0, None]), (310, [float("nan")] * 8), (315, [float("inf")] + [0.0] * 7), (320, []), (325, [0.5]), (7, rows[7][1]), (None, rows[2][1]),
             (10, rows[10][1])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "unit long, values array<double>, RANK string")
    got = sorted(tuple(r) for r in topk.most_alike(df, F.col("unit") % 5 == 0, k=4).collect())
    assert got == slow(rows, 4)


def test_cells_meet_in_many_partitions(spark):
    """Without merged partitions, queries and units of a cell meet only if their keys have the same types."""
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 0.3) * 10 ** (i % 4) for _ in range(8)]) for i in range(150)]
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = sorted(tuple(r) for r in topk.most_alike(spark.createDataFrame(rows, "unit long, values array<double>"), F.col("unit") % 5 == 0, k=4).collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert got == slow(rows, 4)


def test_few_and_none(spark):
    df = spark.createDataFrame([(5, [1.0, 2.0]), (6, [0.5, -1.0])], "unit long, values array<double>")
    assert [tuple(r) for r in topk.most_alike(df, F.col("unit") == 5).collect()] == [(5, 1, 6, 256 * 128 + 512 * -256)]
    assert topk.most_alike(df.limit(0), F.col("unit") == 5).count() == 0
    assert topk.most_alike(df, F.lit(False)).count() == 0


def test_scores_beyond_doubles(spark):
    rows = [(i, [float(3_000_000 + 7 * i + j) for j in range(4)]) for i in range(30)]
    df = spark.createDataFrame(rows, "unit long, values array<double>")
    assert sorted(tuple(r) for r in topk.most_alike(df, F.col("unit") % 5 == 0, k=4).collect()) == slow(rows, 4)
    assert max(r[3] for r in slow(rows, 4)) > topk.MAX_EXACT
    with pytest.raises(ValueError):
        topk.most_alike(spark.createDataFrame([(5, [1e8] * 4)], "unit long, values array<double>"), F.lit(True))


@pytest.mark.parametrize("kind", ["skewed", "classes", "even"])
def test_pruning_is_exact_and_prunes(kind):
    rng = np.random.default_rng(2)
    if kind == "classes":                                            # profiles around ten centres, as real ones are
        units = np.floor(rng.normal(0, 60, (10, 32))[rng.integers(0, 10, 4000)] + rng.normal(0, 12, (4000, 32)))
    else:
        units = np.floor(rng.normal(0, 30, (4000, 32)) * (np.linspace(0.02, 3, 32) ** 2 if kind == "skewed" else 1))
    queries = units[:20]
    every = queries @ units.T
    every[np.arange(20), np.arange(20)] = -np.inf
    floor = np.sort(every[:, :topk.SAMPLE_UNITS], axis=1)[:, -5]
    row, at, score, probes = topk.best_of_cell(np.arange(20), queries, floor, np.arange(4000), np.arange(4000), units, 5)
    for q in range(20):
        want = np.lexsort((np.arange(4000), -every[q]))[:5]
        assert at[row == q].tolist() == want.tolist() and score[row == q].tolist() == every[q][want].tolist()
    share = probes / (20 * 4000 * 32)
    assert share < {"skewed": 0.1, "classes": 0.1, "even": 0.3}[kind]
