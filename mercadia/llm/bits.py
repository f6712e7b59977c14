"""A fixed-size bit set over hashes, built by Spark and probed in Python workers.

It only saves work: what it lets through is settled by an exact join, so its size
(``1 << LOG2`` bits, 1 MiB whatever the data) bounds the broadcast and not the result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG2 = 23
CHUNK = 1 << 15     # bits of one bitmap_construct_agg result


def build(df: DataFrame, value: Column) -> np.ndarray:
    """Bits (as bytes) of the long hashes in ``value``: one per hash, from its low bits."""
    bit = F.col("h").bitwiseAND(F.lit((1 << LOG2) - 1))
    rows = (df.select(value.alias("h")).where("h is not null")
            .groupBy(F.shiftright(bit, 15).alias("chunk"))
            .agg(F.bitmap_construct_agg(bit.bitwiseAND(F.lit(CHUNK - 1))).alias("bits")).collect())
    out = np.zeros((1 << LOG2) // 8, np.uint8)
    for r in rows:      # at most 256 rows of 4 KiB
        at = r.chunk * (CHUNK // 8)
        out[at:at + CHUNK // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each 64-bit hash is set."""
    bit = hashes.astype(np.uint64) & np.uint64((1 << LOG2) - 1)
    return (bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 != 0
