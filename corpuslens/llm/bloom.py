"""A Bloom filter sized by the number of its keys: built by Spark, small enough to send to every task.

It only spares work: what it lets through by mistake is dropped by a join afterwards.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits a key (2 in 100 other keys pass), and most bits: 16 MB, reached by 11 million keys; more keys pass more often.
PER_KEY, MOST_BITS = 12, 1 << 27


def bits_for(n: int) -> int:
    """A power of two of about PER_KEY bits a key."""
    return min(MOST_BITS, 1 << max(16, (n * PER_KEY - 1).bit_length()))


def _built(keys: DataFrame, places: Column, bits: int) -> np.ndarray:
    each = keys.select(F.explode(places).alias("p"))
    words = each.groupBy((F.col("p") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b"))
    found = words.toArrow()  # bits / 64 rows at most
    filled = np.zeros(bits // 64, np.uint64)
    filled[found["w"].to_numpy()] = found["b"].to_numpy().view(np.uint64)
    return filled


def build(keys: DataFrame, key: str = "key") -> np.ndarray:
    """Words of the filter over 16-byte keys."""
    bits = bits_for(keys.count())
    six = lambda at: F.conv(F.hex(F.substring(key, at, 6)), 16, 10).cast("long") % bits
    return _built(keys, F.array(six(1), six(7)), bits)


def holds(words: np.ndarray, key: bytes) -> bool:
    for at in (0, 6):
        p = int.from_bytes(key[at : at + 6], "big") % (len(words) * 64)
        if not (int(words[p >> 6]) >> (p & 63)) & 1:
            return False
    return True


def build_long(keys: DataFrame, key: str) -> np.ndarray:
    """The same over 64-bit hashes."""
    bits = bits_for(keys.count())
    return _built(keys, F.array(*[F.pmod(F.shiftright(key, shift), F.lit(bits)) for shift in (0, 30)]), bits)


def holds_long(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    found, bits = np.ones(len(keys), bool), np.uint64(len(words) * 64)
    for shift in (0, 30):
        p = (keys >> np.uint64(shift)) % bits
        found &= (words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return found
