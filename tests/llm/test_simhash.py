"""SimHash groups against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from tidewake.llm import simhash
from tidewake.llm.components import connected


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    pieces = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(values):
    group = {v: v for v in values}

    def root(v):
        while group[v] != v:
            v = group[v]
        return v
    ordered = sorted(set(values))
    for i, a in enumerate(ordered):
        for b in ordered[:i]:
            if (a ^ b).bit_count() <= 3:
                group[root(a)] = root(b)
    return {v: root(v) for v in values}


TEXTS = ["", None, " \t\n", "one", "One two", "a b", "A  b\x0bc", "x " * 5000, "é É ß ﬀ", "a b c d e f g", "the cat sat on the mat " * 40]


def test_fingerprint_matches_definition(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 7)
    for text in TEXTS:
        assert simhash.fingerprint_of(text) == slow_print(text)


@pytest.mark.parametrize("limit", [1024, 8])
def test_groups_match_all_pairs(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "CELL_ROWS", limit)
    rng = random.Random(5)
    values = [rng.getrandbits(64) for _ in range(60)] + [0, 2**64 - 1, 1 << 63]
    for base in values[:6]:                                       # dense groups and chains
        at = base
        for _ in range(40):
            at ^= 1 << rng.randrange(64)
            values += [at, base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))]
    signed = [(int(np.uint64(v).astype(np.int64)),) for v in set(values)]
    found = simhash.links(spark.createDataFrame(signed, "fingerprint long"))
    got = {r.vertex: r.component for r in connected(found).collect()}
    want = slow_groups(list(set(values)))
    by_want, by_got = {}, {}
    for v in set(values):
        s = int(np.uint64(v).astype(np.int64))
        by_want.setdefault(want[v], set()).add(v)
        by_got.setdefault(got.get(s, s), set()).add(v)
    assert sorted(map(sorted, by_want.values())) == sorted(map(sorted, by_got.values()))


def test_operator(spark):
    base = " ".join(f"w{i}" for i in range(3000))
    rows = [(10 + i, t) for i, t in enumerate(TEXTS)] + [(5, base), (4, base + " end"), (3, base), (3, base), (None, base), (2, "quite another text here")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, Fingerprint string")
    got = simhash.near_copies(df).collect()
    prints = [slow_print(t) for _, t in rows]
    groups = slow_groups(prints)
    want = []
    for (key, _), p in zip(rows, prints):
        ids = [k for (k, _), q in zip(rows, prints) if groups[q] == groups[p] and k is not None]
        want.append((key, p, min(ids)))
    assert sorted(((r.doc_id, r.fingerprint % 2**64, r.component_id) for r in got), key=str) == sorted(want, key=str)
    assert simhash.near_copies(df.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 500), (None, 3), (600, 601), (601, 600)]
    got = {r.vertex: r.component for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 600: 600, 601: 600}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0
