"""The positional index against a direct scan."""

import random
import re

import pytest

from tidewake.llm import positional_index as pi


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window):
    phrases = [(str(k) if k is not None else None, w[i:i + window]) for k, t in items for w in [words(t)]
               for i in range(max(1, len(w) - window + 1) if w else 0)]
    out = []
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for item, phrase in phrases:
            for i in range(len(w) - len(phrase) + 1):
                if w[i:i + len(phrase)] == phrase:
                    hit |= set(range(i, i + len(phrase)))
                    found.add(item)
        out.append((key, len(w), len(hit), sorted(x for x in found if x is not None)))
    return sorted(out, key=str)


def make():
    rng = random.Random(3)
    pool = ["a", "B", "c1", "É", "été", "d", "the", "Of"]
    docs = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    items = [(i, ", ".join(rng.choice(pool) for _ in range(rng.randint(1, 9)))) for i in range(25)]
    docs += [(100, None), (101, ""), (102, "?!"), (7, docs[7][1]), (None, items[2][1]), (103, "the " * 3000)]
    items += [(None, "b c1"), (200, None), (201, ""), (202, "the the the"), (3, items[3][1])]
    return docs, items


@pytest.mark.parametrize("block,phrases", [(1 << 19, 1 << 20), (50, 40)])
def test_same_as_scan(spark, monkeypatch, block, phrases):
    monkeypatch.setattr(pi, "PART_PHRASES", phrases)
    monkeypatch.setattr(pi, "BLOCK_WORDS", block)
    docs, items = make()
    table = spark.createDataFrame([(k, t, "x") for k, t in docs], "doc_id long, text string, TERM string")
    tests = spark.createDataFrame(items, "item_id long, text string")
    index = spark.read.parquet(pi.build(table))
    got = [(r.record, r.n_words, r.n_hit, list(r["items"])) for r in pi.matches(index, tests, window=4).collect()]
    assert sorted(got, key=str) == brute(docs, items, 4)


def test_empty_tables(spark):
    table = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    tests = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    index = spark.read.parquet(pi.build(table))
    assert [(r.n_words, r.n_hit) for r in pi.matches(index, tests.limit(0)).collect()] == [(3, 0)]
    assert pi.matches(spark.read.parquet(pi.build(table.limit(0))), tests).count() == 0


def test_proximity(spark):
    table = spark.createDataFrame([(1, "x b q a c y"), (2, "a x x x b x x c"), (3, "c b a")], "doc_id long, text string")
    tests = spark.createDataFrame([(9, "a b c")], "item_id long, text string")
    index = spark.read.parquet(pi.build(table))
    got = {r.record: [(s["first"], s["end"]) for s in r.spans] for r in pi.matches(index, tests, slop=1).collect()}
    assert got == {1: [(1, 5)], 2: [], 3: [(0, 3)]}


def test_small_blocks_keep_matches_inside_records():
    schema_words = [[b"a", b"b"], [b"c", b"d"]]
    import pyarrow as pa
    schema = pa.schema([("block", pa.int64()), ("term", pa.binary()), ("positions", pa.binary()), ("ids", pa.list_(pa.int64())), ("n", pa.int64())])
    batch = pi._block(0, [1, 2], schema_words, schema)
    import numpy as np
    lists = {t: np.cumsum(np.frombuffer(p, "<u4").astype(np.int64)) for t, p in
             zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()) if t is not None}
    assert len(pi._find((b"b", b"c"), lists)) == 0 and pi._find((b"c", b"d"), lists).tolist() == [3]
