"""Profile codes against plain search and plain means."""

import hashlib
import math
import random

import numpy as np
import pytest

from tidewake.llm import profile_codes


def slow(rows, parts, entries, rounds):
    fine = [(u, c, [math.floor(256 * x) for x in v]) for u, v, c in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max((len(v) for _, _, v in fine), default=0) // parts))
    fine = [(u, c, v + [0] * (parts * width - len(v))) for u, c, v in fine]
    cut = lambda v, p: v[p * width:(p + 1) * width]                                                  # noqa: E731
    first = sorted(fine, key=lambda r: (r[0] is None, r[0] or "", r[2]))[:entries]
    books = [[cut(v, p) for _, _, v in first] for p in range(parts)]
    near = lambda p, v: min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e)), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            held = {}
            for _, _, v in fine:
                held.setdefault(near(p, v)[1], []).append(cut(v, p))
            new.append([[sum(x) // len(held[i]) for x in zip(*held[i])] if i in held else e for i, e in enumerate(books[p])])
        books = new
    out, by_class = [], {}
    for u, c, v in fine:
        best = [near(p, v) for p in range(parts)]
        out.append((u, c, "".join(f"{i:02x}" for _, i in best), sum(d for d, _ in best)))
        by_class[c] = by_class.get(c, 0) + out[-1][3]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted([(*r, by_class[r[1]], digest) for r in out], key=str)


@pytest.mark.parametrize("parts,length,entries", [(4, 8, 6), (16, 64, 9), (3, 7, 64)])
def test_ports_by_daily_co2(spark, parts, length, entries):
    rng = random.Random(parts)
    rows = [(f"P{i:03d}", [rng.gauss(0, 0.4) for _ in range(length)], rng.choice(["cargo", "cargo", "tanker", None])) for i in range(120)]
    rows += [(f"Q{i}", rows[1][1], "cargo") for i in range(40)]                                       # many equal profiles
    rows += [("P001", rows[1][1], "cargo"), (None, rows[2][1], "tanker"), ("N1", None, "cargo"), ("N2", [1.0, None], None),
             ("N3", [float("nan")] * length, "cargo"), ("N4", [float("-inf")] * length, "cargo"), ("S", [0.5], "other"), ("E", [], "other")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "port string, values array<double>, vclass string, CODE int")
    got = profile_codes.compress(df, parts=parts, entries=entries)
    assert sorted([tuple(r) for r in got.collect()], key=str) == slow(rows, parts, entries, 2)


def test_few_none_and_large(spark):
    df = spark.createDataFrame([("Houston, TX", [1.0, 2.0, 3.0], "tanker")], "port string, values array<double>, vclass string")
    assert [(r.code, r.error, r.class_error) for r in profile_codes.compress(df, parts=2).collect()] == [("0000", 0, 0)]
    assert profile_codes.compress(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        profile_codes.compress(df.selectExpr("port", "array(1e9D) AS values", "vclass"))


def test_pivots_spare_evaluations():
    rng = np.random.default_rng(4)
    rows, entries = rng.integers(-128, 128, (3000, 4)), rng.integers(-128, 128, (64, 4))
    entries[7] = entries[3]
    pivots = profile_codes.far_apart(entries, 4)
    at, best, evaluated = profile_codes.nearest(rows, profile_codes.distances(rows, pivots).astype(np.float32), entries, profile_codes.distances(entries, pivots))
    every = ((rows[:, None] - entries[None]) ** 2).sum(axis=2)
    assert at.tolist() == every.argmin(axis=1).tolist() and best.tolist() == every.min(axis=1).tolist()
    assert evaluated < 0.35 * every.size
