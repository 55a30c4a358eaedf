"""Seeded draws from a hash of (seed, draw, slot).

The same draw comes out on every executor, after every retry and in any SQL engine that has md5, which a stateful random
generator cannot promise. 60 bits of the hash are used, so groups of any size that fits in memory anywhere are drawn
evenly (the bias of the modulus is the group size over 2 to the 60).
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
from pyspark.sql import Column, functions as F

from .numeric import as_col

HEX_DIGITS = 15


def pick(draw, slot, size, seed: int) -> Column:
    """Index in 0..size-1 for (draw, slot)."""
    name = F.concat_ws("|", F.lit(str(int(seed))), as_col(draw).cast("string"), as_col(slot).cast("string"))
    return F.conv(F.substring(F.md5(name), 1, HEX_DIGITS), 16, 10).cast("bigint") % as_col(size).cast("bigint")


def hashes(seed: int, draw: int, first: int, last: int) -> np.ndarray:
    """Hashes of the slots first..last-1 of a draw, for use inside a task; the index is their remainder by a size."""
    name = b"%d|%d|" % (seed, draw)
    digests = b"".join([md5(name + b"%d" % slot).digest() for slot in range(first, last)])
    return np.frombuffer(digests, ">u8")[::2].astype(np.uint64) >> np.uint64(64 - 4 * HEX_DIGITS)


def picked_in_draws(seed: int, draws: int, slot: int) -> np.ndarray:
    """Hashes of one slot in draws 1..draws; the index is their remainder by a size."""
    return np.array([int(md5(b"%d|%d|%d" % (seed, draw, slot)).hexdigest()[:HEX_DIGITS], 16) for draw in range(1, draws + 1)], np.int64)
