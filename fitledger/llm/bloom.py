"""Bloom filters over 64-bit hashes: built by Spark, tested in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 25
SHIFTS = (0, 20, 39)


def bits_for(n: int, most: int = 30) -> int:
    """Bits, as a power of two, that keep a filter of ``n`` values at less than one false answer in a hundred: sixteen a value,
    up to 2**most (128 MB at 30)."""
    return min(max((16 * n).bit_length(), 16), most)


def bloom(hashes: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """Filter of the values of a long column: 2**bits bits, whatever their number. Only these reach the driver."""
    def place(h: Column, shift: int) -> Column:
        return F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(2**bits - 1)) + 1

    bit = hashes.select(F.explode(F.array(*(place(F.col(column), s) for s in SHIFTS))).alias("bit"))
    blocks = bit.groupBy(F.bitmap_bucket_number("bit").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map")).collect()
    out = np.zeros(2**bits // 8, np.uint8)
    for r in blocks:
        start = (r.block - 1) * 4096
        out[start:start + 4096] |= np.frombuffer(bytes(r.map), np.uint8)
    return out


def held(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """True where the filter may hold the hash (uint64)."""
    some, mask = np.arange(len(h)), np.uint64(8 * len(bits) - 1)
    for shift in SHIFTS:
        at = (h[some] >> np.uint64(shift)) & mask
        some = some[((bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)]
    out = np.zeros(len(h), bool)
    out[some] = True
    return out
