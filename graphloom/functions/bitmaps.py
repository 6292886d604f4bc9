"""Sets of hashes as bitmaps of a fixed size, made by Spark and broadcast: a superset test for joins whose small side has no bound."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bitmap(hashes: DataFrame, column: str | Column, bits: int = 24) -> bytes:
    """2^bits bits, of which those are set that the upper bits of the 64-bit hashes name; as large whatever the number of rows. Nulls are no hashes."""
    h = F.col(column) if isinstance(column, str) else column
    bit = F.shiftrightunsigned(h, 64 - bits)
    parts = hashes.select(bit.alias("bit")).where("bit is not null").groupBy(F.floor(F.col("bit") / 32768).alias("part")).agg(F.expr("bitmap_construct_agg(bit % 32768)").alias("bits"))
    out = bytearray(max(1 << (bits - 3), 4096))
    for row in parts.collect():  # at most 2^bits / 32768 rows of 4096 bytes
        out[row["part"] * 4096 : row["part"] * 4096 + 4096] = row["bits"]
    return bytes(out[: 1 << (bits - 3)])


def holds(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether hashes (uint64) may be in the set of a bitmap (bytes as uint8)."""
    at = h >> np.uint64(65 - (8 * len(bits)).bit_length())
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
