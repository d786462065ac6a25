"""Bounded sets of 64-bit hashes, small enough to broadcast."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAP_BITS = (20, 28)  #: a map has 32 bits a hash, but no fewer and no more than 2 to these powers (32 MB)


class HashSet:
    """Holds every hash that it was made of, and a few others: the more, the more there are beyond the bound."""

    def __init__(self, hashes: DataFrame, column: str, n: int):
        self.bits = min(max(MAP_BITS[0], (32 * max(n, 1)).bit_length()), MAP_BITS[1])
        # 64 bits of the map a row, so at most 2 ** (MAP_BITS[1] - 6) rows
        slot = F.shiftrightunsigned(column, 64 - self.bits)
        mask = F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))"))
        table = hashes.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("word")).agg(mask.alias("mask")).toArrow()
        self.words = np.zeros(1 << (self.bits - 6), np.uint64)
        self.words[table.column("word").to_numpy()] = table.column("mask").to_numpy().view(np.uint64)

    def holds(self, h: np.ndarray) -> np.ndarray:
        s = h.view(np.uint64) >> np.uint64(64 - self.bits)
        return (self.words[(s >> np.uint64(6)).astype(np.int64)] >> (s & np.uint64(63)) & np.uint64(1)).astype(bool)
