"""Huffman file sets: optimal lengths, exact round trips, and the library's ids."""

import heapq
import random

import numpy as np
import public_tokenizers
import pytest

from tidewake.llm import huffman as hf
from tidewake.llm.columns import read_vocabulary
from tidewake.llm.library_tokens import tokenize


def plain_cost(counts):
    heap = [int(c) for c in counts if c]
    if len(heap) == 1:
        return heap[0]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    return cost


def test_lengths():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 10, 300):
        counts = rng.integers(0, 1000, n) ** 2 + 1
        lengths = hf.code_lengths(counts)
        assert (counts * lengths).sum() == plain_cost(counts)
    fib = [1, 1]
    while len(fib) < 30:
        fib.append(fib[-1] + fib[-2])
    lengths = hf.code_lengths(np.array(fib), 6)
    assert lengths.max() <= 6 and sum(0.5 ** lengths) <= 1
    with pytest.raises(ValueError):
        hf.code_lengths(np.ones(5), 2)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
def test_pack(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.05, n), 200).astype(np.int32)
    code = hf.canonical(hf.code_lengths(np.bincount(np.append(ids, [0, 5]), minlength=201)))
    sizes = np.array([s for s in (n // 3, 0, n // 2, n - n // 3 - n // 2)])
    done = hf.pack(code, ids, sizes)
    begin = 8 * np.cumsum([0, *(len(d) for d, _ in done)])
    marks = np.concatenate([m + b for (_, m), b in zip(done, begin)])
    assert hf.unpack(code, b"".join(d for d, _ in done) + bytes(8), marks, sizes).tolist() == ids.tolist()


@pytest.mark.parametrize("block", [1 << 16, 10])
def test_round_trip(spark, monkeypatch, block):
    monkeypatch.setattr(hf, "BLOCK_IDS", block)
    rng = random.Random(7)
    rows = [(i, [rng.randrange(50) for _ in range(rng.choice([0, 1, 5, 40, 95]))]) for i in range(0, 120, 2)]
    rows += [(3, None), (4, [9, 9]), (4, [9, 9]), (None, [7])]
    packed = [(k, None if ids is None else bytearray(np.array(ids, "<u4").tobytes()), 1) for k, ids in rows]
    df = spark.createDataFrame(packed, "doc_id long, ids binary, RECORD int")
    got = [(r.start, r.record, np.frombuffer(r.ids, "<u4").tolist()) for r in hf.read(spark, hf.write(df)).collect()]
    got.sort(key=lambda r: r[0])
    assert sorted(((k, ids) for _, k, ids in got), key=str) == sorted(((k, [*(ids or []), 0]) for k, ids in rows), key=str)
    keys = [-1 if k is None else k for _, k, _ in got]
    assert keys == sorted(keys) and [s for s, _, _ in got] == [sum(len(ids) for *_, ids in got[:i]) for i in range(len(got))]
    assert hf.read(spark, hf.write(df.limit(0))).count() == 0


def test_library_ids(spark):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = ["", None, "a b", "été <|endoftext|> x", "  \n x", "=" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in tokenize(df, read_vocabulary(path)).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids


def test_units_change_nothing():
    """Cut or whole, the ids are the library's."""
    from tokenizers import Tokenizer

    from tidewake.llm.library_tokens import LibraryEncoder
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, encoder = Tokenizer.from_file(path), LibraryEncoder(read_vocabulary(path))
    assert encoder.cuts
    rng = random.Random(9)
    parts = ["a", "the", "It", "'", "s", "'ll", " ", "  ", "\n", "\t ", "1", "23", ".", ",", "!?", "é", "ß", "ő", "\xa0", "\x1c", "²", "東", "_", "<|endoftext|>", "¿", "\x85", "×"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_blocks_hold_whole_records_or_one_piece(spark, monkeypatch):
    """A block is read by one branch only: as whole records, or as a piece of a cut record."""
    monkeypatch.setattr(hf, "BLOCK_IDS", 10)
    rows = [(k, bytearray(np.full(n, n, "<u4").tobytes())) for k, n in enumerate([3, 4, 25, 0, 8, 9, 10, 2])]
    folder = hf.write(spark.createDataFrame(rows, "doc_id string, ids binary"))
    blocks = spark.read.parquet(f"{folder}/blocks")
    assert all(b.whole == (not any(len(rows[int(k)][1]) >= 40 for k in b.records)) for b in blocks.collect())
    got = sorted((r.start, r.record, len(r.ids) // 4) for r in hf.read(spark, folder).collect())
    assert [(k, n) for _, k, n in got] == [("0", 4), ("1", 5), ("2", 26), ("3", 1), ("4", 9), ("5", 10), ("6", 11), ("7", 3)]
    assert [s for s, _, _ in got] == [0, 4, 9, 35, 36, 45, 55, 66]


def test_parts_follow_the_order_of_ids():
    bounds = [1.5, 4.0]
    assert [hf._part(k, bounds) for k in (None, 1.5, 2.0, 4.0, 4.5, float("nan"))] == [0, 0, 1, 1, 2, 2]


def test_equal_pieces_of_a_batch_are_looked_up_once():
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    from tidewake.llm import library_tokens
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, encoder = Tokenizer.from_file(path), library_tokens.LibraryEncoder(read_vocabulary(path))
    looked = []

    class Counting(library_tokens._Units):
        def __getitem__(self, unit):
            looked.append(unit)
            return super().__getitem__(unit)

    encoder.units = Counting(encoder.tokenizer)
    same = [v for some in encoder.encode_all(pa.array(["one two, one\nTwo one two,"] * 700)) for v in some.to_pylist()]
    assert len(set(same)) == 1 and len(looked) < 1000
    rnd = random.Random(7)
    bits = ["a", "the", "Ab", "é", " ", " ", "  ", "\n", "\t", " \n", "\n ", "'", "'s", "'re", "12", ".", ",", "\x00", "ß", "\r\n", "-"]
    for more in ([], ["漢", "\x1f", "<|endoftext|>", " "]):       # cut, and partly left to the library
        texts = ["".join(rnd.choice(bits + more) for _ in range(rnd.randrange(9))) for _ in range(3000)] + [None]
        got = [v for some in encoder.encode_all(pa.array(texts)) for v in some.to_pylist()]
        assert got == [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_rows_keep_their_ids_when_batches_are_held(spark):
    """Some batches are encoded together; an id still goes to the row of its text."""
    from tidewake.llm import library_tokens
    df = spark.range(5000, numPartitions=2).selectExpr("id", "concat('row ', id, repeat(' again', CAST(id % 7 AS INT))) AS text")
    ids = {r.id: bytes(r.ids) for r in tokenize(df, read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))).collect()}
    encoder = library_tokens.LibraryEncoder(read_vocabulary(public_tokenizers.path("byte_bpe_50k.json")))
    assert len(ids) == 5000 and all(ids[i] == encoder.encode(f"row {i}" + " again" * (i % 7)) for i in range(5000))
