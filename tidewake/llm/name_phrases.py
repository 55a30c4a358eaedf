"""Collocations: phrases whose words occur together far more often than their parts alone would make them.

The project's only written records are names: position messages and registries carry the name of each ship, and fleets
show in them ("CMA CGM", "MAERSK"). A record is a vessel with its name and its traffic class; any other text and class do.

Counts are kept as streams of (class, phrase, count) and never looked up in a table. Phrases are counted by length: words
first, then in each pass those of one more word whose first and last words are frequent phrases of the pass before. A frequent
phrase has only frequent parts, so nothing frequent is lost. Between passes a bitmap of fixed size tells which shorter phrases
are frequent; it can only let too much through, and the exact counts decide.

The frequent phrases then form two streams, one in the order of their words (prefix order), one in the order of their words
read backwards (suffix order). Sort-merge joins walk each of them against its own shorter phrases, which gives the counts of
all first parts and of all last parts, and, from a phrase to the one that lacks its last or first word, of its extensions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewake.operators.sizing import checkpointed

#: Bits of the map of frequent phrases of one length: 8 MB, whatever the size of the tables.
BITS = 1 << 26
BITMAP_BITS = 1 << 15                       # of one row of Spark's bitmap aggregate
#: A task passes on what it has counted after so many words, or so many different ones.
FLUSH_WORDS, FLUSH_DISTINCT = 1 << 22, 1 << 20
#: Rows that a task hands to Spark at once.
SENT_ROWS = 1 << 16
#: Bytes of text that are split into words at once; a piece without punctuation is never cut.
SLICE = 1 << 22
# A-Z become a-z, everything that ends a piece becomes a full stop
_CUT = bytes.maketrans(b",;:!?\n\x0b\x0c\rABCDEFGHIJKLMNOPQRSTUVWXYZ", b".........abcdefghijklmnopqrstuvwxyz")
_SEED = 42


class _Numbers(dict):
    """Number of each word in order of appearance; the full stop, which ends a piece, is 0."""

    def __init__(self):
        super().__init__({b".": 0})

    def __missing__(self, word):
        self[word] = number = len(self)
        return number


def split_words(text: bytes, size: int) -> Iterator[list[bytes]]:
    """Lower-cased words of a text in runs of about `size` bytes, with b"." between pieces."""
    text = text.translate(_CUT)
    start = 0
    while start < len(text):
        end = len(text)
        if end - start > size:
            end = text.rfind(b".", start, start + size) + 1 or text.find(b".", start + size) + 1 or len(text)
        yield text[start:end].replace(b".", b" . ").split()
        start = end


Counter = Callable[[str, list[bytes], list[np.ndarray]], tuple[pa.Array, np.ndarray]]


def _counted(records: DataFrame, count: Counter) -> DataFrame:
    """Sums of what `count` finds in the words of all texts: vclass, phrase, f."""
    most_words, most_distinct, size = FLUSH_WORDS, FLUSH_DISTINCT, SLICE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[_Numbers, list[np.ndarray]]] = {}
        words = distinct = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for vclass, (numbers, runs) in held.items():
                phrase, f = count(vclass, list(numbers), runs)
                for at in range(0, len(f), SENT_ROWS):
                    some = f[at:at + SENT_ROWS]
                    yield pa.record_batch({"vclass": pa.array([vclass] * len(some), pa.string()), "phrase": phrase.slice(at, SENT_ROWS).cast(pa.string()), "f": pa.array(some, pa.int64())})
            held.clear()

        for batch in batches:
            order = pc.sort_indices(batch.column("vclass"))
            rows = zip(batch.column("vclass").take(order).to_pylist(), batch.column("text").cast(pa.binary()).take(order).to_pylist())
            for vclass, group in groupby(rows, key=lambda row: row[0]):
                for _, text in group:
                    for run_of in split_words(text, size):
                        numbers, runs = held.setdefault(vclass, (_Numbers(), []))
                        before = len(numbers)
                        runs.append(np.fromiter(map(numbers.__getitem__, run_of), np.int32, len(run_of)))
                        words, distinct = words + len(run_of), distinct + len(numbers) - before
                        if words >= most_words or distinct >= most_distinct:
                            yield from flush()
                            words = distinct = 0
        yield from flush()

    return records.mapInArrow(run, "vclass string, phrase string, f long").groupBy("vclass", "phrase").agg(F.sum("f").alias("f"))


def _count_words(vclass: str, numbers: list[bytes], runs: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    f = sum((np.bincount(ids, minlength=len(numbers)) for ids in runs), np.zeros(len(numbers), np.int64))
    return pa.array(numbers, pa.binary()).slice(1), f[1:]


def _hashes(vclass: str, numbers: list[bytes]) -> np.ndarray:
    """Spark's xxhash64(vclass, word) of every word, unsigned."""
    seed = xxhash.xxh64_intdigest(vclass.encode(), _SEED)
    return np.fromiter((xxhash.xxh64_intdigest(word, seed) for word in numbers), np.uint64, len(numbers))


def _has(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = hashes & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _count_phrases(bitmap: np.ndarray, size: int) -> Counter:
    """Phrases of `size` words inside a piece of which the bitmap holds the first size - 1 words and the last size - 1 words."""
    def found(own: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Word numbers of all such phrases, a column each."""
        if len(ids) < size:
            return np.empty((size, 0), np.int32)
        count = len(ids) - size + 2                              # starts of shorter phrases
        hashes, whole = own[ids[:count]], ids[:count] > 0
        for i in range(1, size - 1):
            hashes = (hashes << np.uint64(1) | hashes >> np.uint64(63)) ^ own[ids[i:i + count]]
            whole &= ids[i:i + count] > 0
        at = np.flatnonzero(whole)
        held = np.zeros(count, bool)
        held[at] = _has(bitmap, hashes[at])
        at = np.flatnonzero(held[:-1] & held[1:])
        return ids[at + np.arange(size)[:, None]]

    def count(vclass: str, numbers: list[bytes], runs: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
        own = _hashes(vclass, numbers)
        columns = np.concatenate([found(own, ids) for ids in runs], axis=1)
        key, span = columns[0].astype(np.int64), len(numbers)
        for column in columns[1:]:
            if span * len(numbers) >= 1 << 62:                   # keys of the first words are numbered anew
                key = np.unique(key, return_inverse=True)[1]
                span = len(key)
            key, span = key * len(numbers) + column, span * len(numbers)
        _, first, f = np.unique(key, return_index=True, return_counts=True)
        listed = pa.array(numbers, pa.binary())
        return pc.binary_join_element_wise(*[listed.take(pa.array(c)) for c in columns[:, first]], pa.scalar(b" ", pa.binary())), f
    return count


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """Bits of a column `bit`, collected as at most BITS / 2**15 rows of 4 kB."""
    at = F.col("bit").bitwiseAND(F.lit(BITS - 1)) + 1
    rows = hashes.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = np.zeros(BITS // 8, np.uint8)
    for r in rows:
        start = (r.bucket - 1) * BITMAP_BITS // 8
        out[start:start + len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return out


def _phrase_hash(size: int) -> Column:
    """What `found` above makes of the words of a phrase."""
    words = [F.xxhash64("vclass", F.split("phrase", " ")[i]) for i in range(size)]
    return reduce(lambda done, word: F.shiftleft(done, 1).bitwiseOR(F.shiftrightunsigned(done, 63)).bitwiseXOR(word), words)


def frequent_phrases(records: DataFrame, least: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to `longest` words with f >= least (vclass, words, f), and the word total n of each class.
    records: vclass and text, neither null."""
    words = checkpointed(_counted(records, _count_words))
    totals = words.groupBy("vclass").agg(F.sum("f").alias("n"))
    kept = words.where(F.col("f") >= least)
    found = kept
    for size in range(2, longest + 1):
        bitmap = _bitmap(kept.select(_phrase_hash(size - 1).alias("bit")))
        kept = checkpointed(_counted(records, _count_phrases(bitmap, size)).where(F.col("f") >= least))
        found = found.unionByName(kept)
    return checkpointed(found.select("vclass", F.split("phrase", " ").alias("words"), "f")), totals


def _key(words: Column) -> Column:
    return F.array_join(words, " ")


def _stream(counts: DataFrame, backwards: bool) -> DataFrame:
    """Counts in prefix order, or in suffix order: their words backwards. Each with the key it is sorted by."""
    read = F.reverse("words") if backwards else F.col("words")
    return counts.select("vclass", _key(F.col("words")).alias("phrase"), read.alias("read"), "f").withColumn("key", _key(F.col("read")))


def _parts(stream: DataFrame, name: str) -> DataFrame:
    """Counts of the first 1, 2, ... words of every phrase in the order of the stream: vclass, phrase, size, f, <name>_size, <name>.
    Both sides of the join are sorted by the part; a part that starts very many phrases is split by adaptive execution."""
    wanted = stream.where(F.size("read") > 1).select("vclass", "phrase", F.size("read").alias("size"), "f", F.posexplode(
        F.transform(F.sequence(F.lit(1), F.size("read") - 1), lambda k: _key(F.slice("read", 1, k)))).alias("at", "part"))
    shorter = stream.select(F.col("vclass").alias("__class"), F.col("key").alias("__key"), F.col("f").alias(name)).hint("merge")
    return (wanted.join(shorter, (F.col("vclass") == F.col("__class")) & (F.col("part") == F.col("__key")))
            .select("vclass", "phrase", "size", "f", (F.col("at") + 1).alias(f"{name}_size"), name))


def _extended(stream: DataFrame) -> DataFrame:
    """Largest count of the phrases that go on for one more word in the order of the stream: vclass, key, more."""
    return (stream.where(F.size("read") > 2).select("vclass", F.slice("read", F.lit(1), F.size("read") - 1).alias("head"), "f")
            .groupBy("vclass", _key(F.col("head")).alias("key")).agg(F.max("f").alias("more")))


def _exact(*factors: Column) -> Column:
    """Product of longs as a decimal of up to 38 digits."""
    product = F.lit(1).cast("decimal(38,0)")
    for factor in factors:
        product = (product * factor.cast("decimal(19,0)")).cast("decimal(38,0)")
    return product


def mine(vessels: DataFrame, vessel_name: str = "VesselName", vclass: str = "vclass", least: int = 100, longest: int = 5, top: int = 2000,
         absorbed: int = 100, unknown: str = "und") -> DataFrame:
    """The `top` phrases of each traffic class by score: vclass, rank, phrase, a, l, r, n, score.

    vessels: a text column and a class column, of any meaning. Null texts are empty, a null class is `unknown`. A-Z become
    lower case; `.,;:!?`, line ends and form feeds (0x0A to 0x0D) end a piece; words are what spaces and tabs divide. n is the
    number of words of the class, f counts all occurrences of a phrase inside pieces, overlapping ones too.

    Candidates are phrases of 2 to `longest` words with a = f >= least. Cut after k words, l and r are the counts of the parts and the
    score is floor(1000 * a * n / (l * r)); the cut of the lowest score counts, the first of equal ones. A candidate goes if its words
    lie side by side in a longer candidate with 100 * f >= absorbed * a; that longer one goes on for one word on either side, or
    holds one that does and is at least as frequent. The order is score and a downwards, then the phrase by bytes. Rows repeat as
    often as they occur; empty tables give no rows. Other columns are not read. Products are decimals of 38 digits: exact up to
    1000 * a * n < 10**38.
    """
    records = vessels.select(F.coalesce(F.col(vclass).cast("string"), F.lit(unknown)).alias("vclass"), F.coalesce(F.col(vessel_name).cast("string"), F.lit("")).alias("text"))
    counts, totals = frequent_phrases(records, least, longest)
    forwards, backwards = _stream(counts, False), _stream(counts, True)
    left, right = _parts(forwards, "l"), _parts(backwards, "r").select(F.col("vclass").alias("__class"), F.col("phrase").alias("__phrase"), "r_size", "r")
    cuts = left.join(right.hint("merge"), (F.col("vclass") == F.col("__class")) & (F.col("phrase") == F.col("__phrase")) & (F.col("size") - F.col("l_size") == F.col("r_size")))
    scored = (cuts.join(totals, "vclass").withColumn("above", _exact(F.lit(1000), F.col("f"), F.col("n"))).withColumn("below", _exact(F.col("l"), F.col("r")))
              .withColumn("score", F.expr("above div below")))
    best = (scored.groupBy("vclass", "phrase").agg(F.min(F.struct("score", F.col("l_size").alias("k"), "l", "r", "f", "n")).alias("b"))
            .select("vclass", "phrase", F.col("b.f").alias("a"), "b.l", "b.r", "b.n", "b.score"))
    longer = _extended(forwards).select("vclass", F.col("key").alias("phrase"), "more").unionByName(
        _extended(backwards).select("vclass", _key(F.reverse(F.split("key", " "))).alias("phrase"), "more")).groupBy("vclass", "phrase").agg(F.max("more").alias("more"))
    kept = (best.join(longer.hint("merge"), ["vclass", "phrase"], "left")
            .where(F.col("more").isNull() | (_exact(F.lit(100), F.col("more")) < _exact(F.lit(absorbed), F.col("a")))))
    order = Window.partitionBy("vclass").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    return (kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("vclass", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
