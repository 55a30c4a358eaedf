"""Specifications by the sweep operator against one least-squares fit each."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.operators import specifications as sp


def direct(rows, y, xs, focus, of, scaled):
    """Coefficient, error, rows and clusters from dense matrices."""
    rows = [r for r in rows if all(r[c] is not None and math.isfinite(r[c]) for c in (*xs, y))]
    X = np.array([[r[c] for c in xs] for r in rows], float)
    kept = [i for i in range(len(xs)) if X[:, i].std() > 0]
    Z = X[:, kept] - X[:, kept].mean(axis=0)
    at = kept.index(xs.index(focus))
    if focus in scaled:
        Z[:, at] = Z[:, at] / Z[:, at].std(ddof=1)
    D = np.column_stack([np.ones(len(rows)), Z])
    Y = np.array([r[y] for r in rows])
    inv = np.linalg.pinv(D.T @ D)
    beta = inv @ D.T @ Y
    s = (inv[at + 1] @ D.T) * (Y - D @ beta)
    n, k = len(rows), np.linalg.matrix_rank(D)

    def part(of):
        sums = {}
        for r, x in zip(rows, s):
            key = tuple(r[c] for c in of)
            sums[key] = sums.get(key, 0) + x
        g = len(sums)
        return sum(v * v for v in sums.values()) * g / (g - 1) * (n - 1) / (n - k), g

    v, g = part(of[:1])
    if len(of) == 2:
        v += part(of[1:])[0] - part(of)[0]
    return beta[at + 1], math.sqrt(v), n, g


def table(seed=3, n=400):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b, c = (float(x) for x in rng.normal(size=3))
        r = dict(SID=f"S{rng.integers(30)}", port=f"P{rng.integers(12)}", a=a + 2000, b=b + a / 2, c=c, same=7.0, twice=2 * b + a, window="after" if i % 4 == 0 else "event30",
                 y=0.3 * a - 0.2 * b + float(rng.normal()), y2=float(rng.normal()))
        if i % 17 == 0:
            r["c"] = None
        if i % 23 == 0:
            r["b"] = float("nan")
        rows.append(r)
    return rows


def test_all_fits_in_two_passes(spark):
    rows = table()
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "SID string, port string, a double, b double, c double, same double, twice double, window string, y double, y2 double")
    every = ("storm", "port", "two-way")
    here = {"event30": F.col("window") == "event30", "no P3": F.col("port") != "P3", "all": None}
    fits = [sp.Fit(f"{y} {where} {xs} {focus}", y, list(xs), focus, every, here[where])
            for y in ("y", "y2") for where in here for xs, focus in [(("a",), "a"), (("a", "b"), "b"), (("a", "b", "c", "same"), "a"), (("c", "a", "b"), "b")]]
    got = {(r.fit, r.clustering): r for r in sp.fit_all(df, fits, sp.CLUSTERINGS, scaled=["a"]).collect()}
    assert len(got) == len(fits) * 3
    keep = {"event30": lambda r: r["window"] == "event30", "no P3": lambda r: r["port"] != "P3", "all": lambda r: True}
    for f in fits:
        where = next(w for w in keep if f" {w} " in f.name)
        for name in every:
            want = direct([r for r in rows if keep[where](r)], f.y, list(f.xs), f.focus, sp.CLUSTERINGS[name], ["a"])
            r = got[f.name, name]
            assert (r.coef, r.se) == pytest.approx(want[:2], rel=1e-6) and (r.n, r.n_clusters) == want[2:]


def test_terms_that_say_nothing(spark):
    rows = table()
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "SID string, port string, a double, b double, c double, same double, twice double, window string, y double, y2 double")
    fits = [sp.Fit("constant", "y", ["a", "same"], "same", ("storm",)), sp.Fit("none", "y", ["a"], "a", ("storm",), F.lit(False)),
            sp.Fit("double", "y", ["a", "b", "twice", "c"], "c", ("storm",))]
    got = {r.fit: r for r in sp.fit_all(df, fits, sp.CLUSTERINGS).collect()}
    assert set(got) == {"double"}
    want = direct(rows, "y", ["a", "b", "c"], "c", ("SID",), [])
    assert (got["double"].coef, got["double"].se) == pytest.approx(want[:2], rel=1e-6)
    assert sp.fit_all(df.limit(0), fits, sp.CLUSTERINGS).count() == 0
