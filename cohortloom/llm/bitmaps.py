"""Bitmaps of hashes, with a bound on their size whatever they are made from."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BITS = 27  # 16 MB


def bitmap_bits(count: int) -> int:
    """64 bits per hash, within 2**20 (128 KB) and 2**MOST_BITS. A full bitmap lets more
    hashes through to the join that follows, never fewer."""
    return int(min(max(20, (64 * max(count, 1)).bit_length()), MOST_BITS))


def hash_bitmap(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """Set bits at the top ``bits`` bits of each hash; built on the executors, 2**bits / 8
    bytes at most reach the driver."""
    slot = F.shiftrightunsigned(F.col(column), 64 - bits)
    rows = (
        df.filter(F.col(column).isNotNull())
        .select(F.shiftright(slot, 15).alias("block"), slot.bitwiseAND(F.lit(32767).cast("long")).alias("bit"))
        .groupBy("block")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
        .collect()
    )
    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in rows:
        out[row["block"] * 4096 : row["block"] * 4096 + 4096] = np.frombuffer(row["bits"], np.uint8)
    return out


def in_bitmap(bitmap: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    slot = hashes >> np.uint64(64 - bits)
    return (bitmap[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0
