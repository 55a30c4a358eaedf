"""Byte-level byte-pair encoding and decoding.

The project keeps no free text, so the operators are general: they take any table with a text column.

Encoding is by backtracking. Bytes are read as Latin-1 so that one Aho-Corasick automaton finds every token in a
piece. From the left, the longest token is tried at each position; it is taken if it can stand next to the token
before it, else a shorter one is tried, else the token before is given up. Whether two tokens can stand side by side is
decided by undoing their merges, latest first, and is remembered. A set of dead positions makes the whole linear, and
the result is the one that merging pair by pair gives.
"""

from __future__ import annotations

from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from .columns import list_array, parse_ranks, put_columns, read_vocabulary

#: Pieces that a worker remembers before the table becomes the old one, and neighbours before it starts afresh; about 200 bytes each.
MAX_REMEMBERED = 1 << 18
BLOCK_CHARS = 1 << 20
SLICE_ROWS = 256


class PairEncoder:
    """Exact merges for one vocabulary. Ranks are the ids; every single byte needs a rank."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.length = {rank: len(token) for token, rank in ranks.items()}
        self.shorter: dict[int, int] = {}
        for token, rank in ranks.items():
            for end in range(len(token) - 1, 0, -1):
                if token[:end] in ranks:
                    self.shorter[rank] = ranks[token[:end]]
                    break
        self.remembered: dict[int, bool] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for rank in sorted(self.tokens):
            self._split(rank)

    def _split(self, rank: int) -> None:
        """Find the two tokens whose merge makes this one."""
        token = self.tokens[rank]
        left = self.shorter.get(rank)
        while left is not None:
            right = self.ranks.get(token[self.length[left]:])
            if right is not None and left < rank and right < rank and self._fits(left, right):
                self.parts[rank] = (left, right)
                self.merged[left, right] = rank
                return
            left = self.shorter.get(left)

    def _fits(self, left: int, right: int) -> bool:
        """Whether merging would leave the boundary between two tokens alone.

        The merges of both are undone from the latest; if at any time the two tokens at the boundary have a merge that
        comes before the next one undone, it would have been made first.
        """
        merged, parts = self.merged, self.parts
        limit = 1 << 62
        while True:
            both = merged.get((left, right))
            if both is not None and both < limit:
                return False
            if left > right:
                limit, split = left, parts.get(left)
                if split is not None:
                    left = split[1]
                    continue
                limit, split = right + 1, parts.get(right)
                if split is None:
                    return True
                right = split[0]
            else:
                limit, split = right + 1, parts.get(right)
                if split is not None:
                    right = split[0]
                    continue
                limit, split = left, parts.get(left)
                if split is None:
                    return True
                left = split[1]

    def compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        found = self.remembered.get(key)
        if found is None:
            if len(self.remembered) >= MAX_REMEMBERED:
                self.remembered.clear()
            found = self.remembered[key] = self._fits(left, right)
        return found

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one match of the splitting pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        n = len(piece)
        longest = [(0, -1)] * n
        for end, (size, rank) in self.automaton.iter(piece.decode("latin-1")):
            start = end + 1 - size
            if longest[start][0] < size:
                longest[start] = (size, rank)
        alive = bytearray(b"\x01") * (n + 1)
        ids: list[int] = []
        at, token = 0, longest[0][1]
        length, shorter = self.length, self.shorter
        while True:
            end = at + length[token]
            if alive[end] and (not ids or self.compatible(ids[-1], token)):
                ids.append(token)
                at = end
                if at == n:
                    return tuple(ids)
                token = longest[at][1]
                continue
            fewer = shorter.get(token)
            while fewer is None:
                alive[at] = 0
                if not ids:
                    raise ValueError("the vocabulary lacks single bytes")
                last = ids.pop()
                at -= length[last]
                fewer = shorter.get(last)
            token = fewer


class Remembered(dict):
    """Ids of pieces seen lately, packed as 32-bit numbers. A full table becomes the old one, whose entries are taken back when they are asked for."""

    def __init__(self, encoder: PairEncoder, size: int):
        super().__init__()
        self.encoder, self.size, self.old = encoder, size, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            found = self.encoder.encode_piece(piece.encode("utf-8", "surrogatepass"))
            ids = pack(f"={len(found)}i", *found)
        if len(piece) <= 64:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class TextEncoder:
    """Splits text by a pattern and encodes each match; matches seen before are looked up."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = MAX_REMEMBERED):
        import regex

        self.pieces = regex.compile(pattern).findall
        self.cut = regex.compile(r"\S (?=\p{L})").search
        self.known = Remembered(PairEncoder(ranks), remembered)

    def blocks(self, text: str) -> Iterator[str]:
        """Parts of a long text. A cut lies before a space between a non-space and a letter, where the pattern of the
        public vocabularies always ends a match."""
        start = 0
        while len(text) - start > BLOCK_CHARS:
            found = self.cut(text, start + BLOCK_CHARS)
            if found is None:
                break
            yield text[start:found.start() + 1]
            start = found.start() + 1
        yield text[start:]

    def packed(self, text: str) -> bytes:
        """Ids as 32-bit numbers."""
        return b"".join([b"".join(map(self.known.__getitem__, self.pieces(block))) for block in self.blocks(text)])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()


_workers: dict = {}


def _encoder(content: Broadcast, pattern: str, remembered: int) -> TextEncoder:
    """One encoder for each Python worker and vocabulary."""
    key = (hash(content.value), pattern, remembered)
    if key not in _workers:
        _workers[key] = TextEncoder(parse_ranks(content.value), pattern, remembered)
    return _workers[key]


def encode(records: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids",
           content: str | None = None, remembered: int = MAX_REMEMBERED) -> DataFrame:
    """Append the token ids of a text column.

    records: any table; its other columns are kept, those named like the new ones are replaced. vocabulary: path on the
    driver of a rank file with lines of base64 token and rank; at most columns.MAX_VOCABULARY_BYTES, so it can be
    broadcast. pattern: regular expression whose matches are encoded separately; it must end a match before a space that
    follows a non-space and precedes a letter, as the public ones do. No special tokens. content: if given, also append
    the bytes that the ids decode to, in the same pass. remembered: pieces that a worker keeps; fewer take less memory and
    more time, and the ids are the same.

    Null and empty texts give an empty array. Repeated rows are encoded each; row order and count do not change. Very
    long texts are encoded whole, in blocks of BLOCK_CHARS characters cut where a match ends anyway.
    """
    ranks = records.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    kind = pa.struct([("ids", pa.list_(pa.int32())), ("content", pa.binary())])

    @F.arrow_udf("struct<ids:array<int>,content:binary>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, tokens = _encoder(ranks, pattern, remembered), _tokens(ranks)
        for batch in batches:
            for i in range(0, len(batch), SLICE_ROWS):
                flat, sizes, back = [], [], []
                for value in batch.slice(i, SLICE_ROWS):
                    own = np.frombuffer(encoder.packed(value.as_py() or ""), np.int32)
                    flat.append(own)
                    sizes.append(len(own))
                    back.append(b"".join(map(tokens.__getitem__, own.tolist())) if content else None)
                yield pa.StructArray.from_arrays([list_array(np.concatenate(flat), sizes, pa.int32()), pa.array(back, pa.binary())], fields=list(kind))
        encoder.known.old = {}                          # workers live on; the newer half is enough for the next task

    found = put_columns(records, __bpe=encoded(F.col(text).cast("string")))
    new = {ids: F.col("__bpe.ids")} | ({content: F.col("__bpe.content")} if content else {})
    return put_columns(found, **new).drop("__bpe")


def decode(records: DataFrame, vocabulary: str, ids: str = "ids", content: str = "content") -> DataFrame:
    """Append the bytes that an array of ids stands for, as a binary column.

    Null gives null, an empty array gives no bytes, an id outside the vocabulary is an error. One row in, one row out.
    Bytes, not text: a cut array may end inside a character. Cast to string after a whole encoding.
    """
    ranks = records.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    @F.arrow_udf("binary")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = _tokens(ranks)
        for batch in batches:
            yield pa.array([None if row is None else b"".join(map(tokens.__getitem__, row)) for row in _rows(batch)],
                           type=pa.binary())

    return put_columns(records, **{content: decoded(F.col(ids))})


def _tokens(ranks: Broadcast) -> dict[int, bytes]:
    key = ("tokens", len(ranks.value), hash(ranks.value))
    if key not in _workers:
        _workers[key] = {rank: token for token, rank in parse_ranks(ranks.value).items()}
    return _workers[key]


def _rows(lists: pa.Array) -> Iterator[list | None]:
    """Python lists of a list array, one at a time, without one object for each row's scalars."""
    flat, offsets, valid = lists.values, lists.offsets.to_numpy(), lists.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(lists)):
        yield flat.slice(offsets[i], offsets[i + 1] - offsets[i]).to_numpy(zero_copy_only=False).tolist() if valid[i] else None
