"""Collocations of ship names against counting everything."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.llm import name_phrases


def slow(rows, least, longest, top, absorbed):
    counts, n = Counter(), Counter()
    for name, vclass in rows:
        c = "und" if vclass is None else vclass
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), name or "")):
            w = re.findall("[^ \t]+", piece)
            n[c] += len(w)
            counts.update((c, tuple(w[i:i + m])) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    often = {key: f for key, f in counts.items() if f >= least}
    out = {}
    for (c, p), a in often.items():
        if len(p) < 2:
            continue
        cuts = [(1000 * a * n[c] // (counts[c, p[:k]] * counts[c, p[k:]]), k) for k in range(1, len(p))]
        gone = any(c2 == c and len(q) > len(p) and 100 * f >= absorbed * a and any(q[i:i + len(p)] == p for i in range(len(q))) for (c2, q), f in often.items())
        if not gone:
            score, k = min(cuts)
            out.setdefault(c, []).append((-score, -a, " ".join(p).encode(), counts[c, p[:k]], counts[c, p[k:]]))
    return sorted((c, i + 1, p.decode(), -a, left, right, n[c], -s) for c, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


def names():
    rng = random.Random(9)
    words = ["MSC", "cma", "CGM", "Maersk", "Line", "of", "the", "Seas", "été", "\x01x", "\x1c", "ß", "x\xa0y", "I"]
    fleets = ["CMA CGM", "Maersk Line", "Freedom of the Seas", "Star of the  North Sea", "a a a a a a"]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))), rng.choice(["cargo", "cargo", "tanker", None])) for _ in range(300)]
    rows += [(rng.choice(fleets) + rng.choice([" ", ", ", "\t", ": ", "\r\n", "? "]) + rng.choice(words), "cargo") for _ in range(400)]
    return rows + [(None, "cargo"), ("", None), ("  \t. ,", "other"), ("CMA CGM " * 3000, "tanker"), ("und word", "und")] + [("OOCL Hong Kong", "cargo")] * 50


@pytest.mark.parametrize("flush,slice_,bits", [(1 << 22, 1 << 22, 1 << 26), (500, 64, 1 << 15), (3000, 64, 1 << 16)])
@pytest.mark.parametrize("absorbed", [100, 60])
def test_ship_names(spark, monkeypatch, flush, slice_, bits, absorbed):
    monkeypatch.setattr(name_phrases, "FLUSH_WORDS", flush)
    monkeypatch.setattr(name_phrases, "SLICE", slice_)
    monkeypatch.setattr(name_phrases, "BITS", bits)
    rows = names()
    df = spark.createDataFrame([(*r, 1) for r in rows], "VesselName string, vclass string, PHRASE int").repartition(5)
    got = name_phrases.mine(df, least=6, top=40, absorbed=absorbed)
    assert sorted(tuple(r) for r in got.collect()) == slow(rows, 6, 5, 40, absorbed)


def test_lengths_and_empty(spark):
    rows = names()
    df = spark.createDataFrame(rows, "VesselName string, vclass string")
    for longest in (2, 3):
        assert sorted(tuple(r) for r in name_phrases.mine(df, least=6, longest=longest).collect()) == slow(rows, 6, longest, 2000, 100)
    assert name_phrases.mine(df.limit(0)).count() == 0
    assert name_phrases.mine(df, least=10 ** 6).count() == 0


def test_large_products(spark):
    """Scores stay exact where 1000 * a * n leaves 64 bits."""
    row = spark.range(1).select(F.lit(9_000_000_000_001).alias("a"), F.lit(99_999_999_999_999).alias("n"), F.lit(9_000_000_000_007).alias("l"))
    got = row.select(name_phrases._exact(F.lit(1000), F.col("a"), F.col("n")).alias("x"), name_phrases._exact(F.col("l"), F.col("l")).alias("y")).selectExpr("x", "x div y AS q").first()
    assert int(got.x) == 1000 * 9_000_000_000_001 * 99_999_999_999_999 and got.q == int(got.x) // 9_000_000_000_007 ** 2


def test_hash_is_sparks(spark):
    words = [b".", "été".encode(), b"seas", b"a"]
    got = spark.createDataFrame([(w.decode(),) for w in words], "w string").select(F.xxhash64(F.lit("cargo"), "w")).collect()
    assert np.array([r[0] for r in got]).astype(np.int64).view(np.uint64).tolist() == name_phrases._hashes("cargo", words).tolist()
