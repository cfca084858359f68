"""Sets of keys in a fixed number of bits, small enough to go to every task whatever the corpus."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm import text as T

BITS = 25  # log2 of the positions: 4 MB


class Bitmap:
    """A set of 64-bit keys that may say yes to a few others, never no to one of its own; its size is fixed."""

    def __init__(self, keys: DataFrame, bits: int = BITS):
        place = F.col("key").cast("long").bitwiseAND((1 << bits) - 1)
        chunk = F.bitmap_construct_agg(place.bitwiseAND((1 << 15) - 1)).alias("bits")
        rows = keys.groupBy(F.shiftright(place, 15).alias("chunk")).agg(chunk).collect()  # at most 2 ** (bits - 15) rows
        self.bits = bits
        self.bytes = np.zeros((1 << max(bits - 15, 0), 1 << 12), dtype=np.uint8)
        for r in rows:
            self.bytes[r["chunk"]] = np.frombuffer(r["bits"], dtype=np.uint8)
        self.bytes = self.bytes.ravel()

    def holds(self, keys: np.ndarray) -> np.ndarray:
        place = keys & T.U64((1 << self.bits) - 1)
        return (self.bytes[place >> T.U64(3)] >> (place & T.U64(7)).astype(np.uint8)) & np.uint8(1) == 1
