"""Byte-level encoding against the tiktoken library, and exact round trips."""

import random

import public_tokenizers
import pytest
import tiktoken

from tidewake.llm import bpe
from tidewake.llm.columns import parse_ranks, read_vocabulary

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
EDGE = ["", " ", "a", "\n\n \t x", "naïve café – 東京 🚀🚀", "it's we'll I'd", "a" * 5000, "=" * 777 + "ab" * 300, "  x  y",
        "<|endoftext|>", "12345 67890", "\x00\x01\x7f", "é" * 40, "x é" * 50]


@pytest.fixture(scope="module")
def ranks():
    return parse_ranks(read_vocabulary(PATH))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_as_library(ranks, library):
    encoder = bpe.TextEncoder(ranks, public_tokenizers.PATTERN)
    rng = random.Random(1)
    alphabets = ["abcde", "the of and ", "éèà ñ ß", "".join(map(chr, range(32, 127))), "东京🚀é \n\t"]
    texts = EDGE + ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(1, 200))) for _ in range(1500)]
    for text in texts:
        assert encoder.encode(text) == library.encode_ordinary(text)


def test_blocks_change_nothing(ranks, library, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 20)
    encoder = bpe.TextEncoder(ranks, public_tokenizers.PATTERN)
    for text in ["one two  three\n four's  it's 12 a-b c " * 20, "x" * 200, "a b\t c  \n d" * 30]:
        assert len(list(encoder.blocks(text))) > 1 or " " not in text
        assert encoder.encode(text) == library.encode_ordinary(text)


def test_operator(spark, library):
    rows = [(i, t, "kept") for i, t in enumerate([*EDGE, None, EDGE[4], EDGE[4]])]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS string")
    both = bpe.encode(df, PATH, public_tokenizers.PATTERN, content="back")
    assert both.where("back <> encode(coalesce(text, ''), 'utf-8')").count() == 0 and both.count() == len(rows)
    out = bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH).collect()
    assert len(out) == len(rows)
    for r in out:
        text = rows[r.doc_id][1] or ""
        assert list(r.ids) == library.encode_ordinary(text) and bytes(r.content) == text.encode()
    empty = bpe.decode(bpe.encode(df.limit(0), PATH, public_tokenizers.PATTERN), PATH)
    assert empty.count() == 0 and empty.columns == ["doc_id", "text", "ids", "content"]
