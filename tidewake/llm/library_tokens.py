"""Token ids of a text column by the tokenizers library."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from struct import Struct, pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .columns import put_columns

#: Units that a worker remembers before the table becomes the old one.
MAX_REMEMBERED = 1 << 19
#: Text that a worker holds before it looks up the different pieces of it.
HELD_BYTES = 16 << 20
#: Different pieces that are looked up at once.
PIECES = 1 << 16
#: Texts whose ids are put together at once.
SLICE = 512
_SPACE, _LETTER = r" \t\n\r\x0b\x0c", "A-Za-zÀ-ÖØ-öø-ÿ"
#: A unit is white space and a run of letters, or of anything else (an apostrophe takes the letters behind it along). The
#: splitting pattern of byte-level vocabularies always ends a match where a unit ends.
_UNITS = re.compile(f"[{_SPACE}]*+(?:[{_LETTER}]++|(?:[^{_SPACE}{_LETTER}']|'[{_LETTER}]*+)++)|[{_SPACE}]++")
#: The same for texts that are joined by a character which none of them holds.
_MARK = "\x1f"
_MARKED = re.compile(_UNITS.pattern.replace(f"[^{_SPACE}", f"[^{_MARK}{_SPACE}") + f"|{_MARK}")
_OTHER = re.compile(f"[^\\x00-\\x1b\\x20-\\x7f{_LETTER}]")
#: White space in which a match may not end before every space.
_WIDE = f"[{_SPACE}] (?:[{_SPACE}]|\\z)"
_PACK = [Struct(f"<{n}I").pack for n in range(33)]


def _byte_characters() -> dict[int, int]:
    """Character that stands for each byte in the vocabulary: printable Latin-1 stands for itself, the rest follows 255."""
    out = {b: b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    for b in range(256):
        if b not in out:
            out[b] = 256 + len(out) - 188
    return out


class _Units(dict):
    """Packed ids of units seen lately; what is missing is asked of the library."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.model, self.old = tokenizer, tokenizer.model.tokenize, {}
        self.characters = _byte_characters()

    def __missing__(self, unit: str) -> bytes:
        ids = self.old.get(unit)
        if ids is None:
            word = unit[1:] if unit[0] == " " else unit
            if word.isalpha():                            # one match of the pattern: the model alone
                if unit.isascii():
                    found = self.model(unit if word is unit else "Ġ" + word)
                else:
                    found = self.model(unit.encode().decode("latin-1").translate(self.characters))
                found = [t.id for t in found]
                ids = _PACK[len(found)](*found) if len(found) < len(_PACK) else pack(f"<{len(found)}I", *found)
            elif unit[0] in "\t\n\r" and unit[1:].isalpha():  # two matches
                ids = self[unit[0]] + self[unit[1:]]
            else:
                ids = np.array(self.tokenizer.encode(unit, add_special_tokens=False).ids, "<u4").tobytes()
        if len(unit) <= 64:
            if len(self) >= MAX_REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[unit] = ids
        return ids


class LibraryEncoder:
    """The library's ids of whole texts. A text is cut into units only if it has nothing but ASCII and Latin-1 letters, no
    string of a special token, and a tokenizer that splits bytes by the usual pattern; any other goes to the library whole."""

    def __init__(self, content: bytes):
        import json

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content.decode())
        form = json.loads(content)
        split = form["pre_tokenizer"] or {}
        self.cuts = (form["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
                     and form["model"]["type"] == "BPE" and not form["model"].get("ignore_merges") and not form["truncation"] and not form["padding"])
        self.special = [t["content"] for t in form["added_tokens"]]
        self.units = _Units(self.tokenizer)
        self.whole = "|".join([_OTHER.pattern, _WIDE, *map(re.escape, self.special)])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.cuts or any(s in text for s in self.special) or _OTHER.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.units.__getitem__, _UNITS.findall(text)))

    def encode_all(self, texts: pa.StringArray) -> Iterator[pa.Array]:
        """The ids of each text, a slice at a time; null gives no bytes. Texts are cut before each space, and equal pieces are
        looked up once.

        No match reaches over a space with something else before it. In a run of white space, a match ends before its last
        character if something follows, so texts with other spaces inside a run, or at its end, are left to `encode`.
        """
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False) if self.cuts else np.ones(len(texts), bool)
        if whole.any():
            cut = (v for some in self.encode_all(texts.filter(pa.array(~whole))) for v in some.to_pylist())
            for i in range(0, len(texts), SLICE):
                yield pa.array([self.encode(v) if w else next(cut) for v, w in zip(texts.slice(i, SLICE).to_pylist(), whole[i:i + SLICE])], pa.binary())
            return
        if not len(texts):
            return
        pieces = pc.split_pattern(texts, " ")
        flat = pieces.flatten().dictionary_encode()
        first = pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
        starts = pc.list_element(pieces, 0).to_pylist()
        codes = flat.indices.to_numpy().copy()
        codes[first[:-1]] = len(flat.dictionary) + np.arange(len(starts), dtype=np.int32)      # no space before the first piece of a text
        different, units, known, sizes = flat.dictionary, self.units, [], []
        del pieces, flat
        for i in range(0, len(different), PIECES):
            some = different.slice(i, PIECES)
            one = pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some)
            parts = _MARKED.findall(" " + pc.binary_join(one, f"{_MARK} ")[0].as_py())
            found = [b"" if p == _MARK else units[p] for p in parts]
            edges = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
            sizes.append(np.diff(edges[[j for j, p in enumerate(parts) if p == _MARK] + [-1]], prepend=0))
            known.append(b"".join(found))
        found = [b"".join(map(units.__getitem__, _UNITS.findall(piece))) for piece in starts]
        size = np.concatenate([*sizes, np.fromiter(map(len, found), np.int64, len(found))]) >> 2
        known = np.frombuffer(b"".join(known + found), "<u4")
        edges = np.cumsum(size) - size
        for i in range(0, len(texts), SLICE):
            bounds = first[i:i + SLICE + 1]
            some = codes[bounds[0]:bounds[-1]]
            n = size[some]
            ends = np.cumsum(n)
            ids = known[np.repeat(edges[some] - ends + n, n) + np.arange(ends[-1])]
            offsets = np.concatenate([[0], ends])[bounds - bounds[0]] * 4
            yield pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids)])


_workers: dict = {}


def tokenize(records: DataFrame, vocabulary: bytes, text: str = "text", ids: str = "ids") -> DataFrame:
    """Append the library's ids of each whole text, without special tokens added, packed as little-endian unsigned 32-bit
    integers in a binary column.

    vocabulary: content of a tokenizer file, of bounded size. Null and empty texts give no bytes. Other columns are kept,
    one named like `ids` is replaced.
    """
    content = records.sparkSession.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("binary")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        key = hash(content.value)
        if key not in _workers:
            _workers[key] = LibraryEncoder(content.value)
        encode_all = _workers[key].encode_all
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= HELD_BYTES:
                yield from encode_all(pa.concat_arrays(held))
                held, size = [], 0
        if held:
            yield from encode_all(pa.concat_arrays(held))

    return put_columns(records, **{ids: encoded(F.col(text).cast("string"))})
