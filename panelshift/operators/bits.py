"""Sets of positions as arrays of bits: merged on the executors, only words of 64 bits reach the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that travel in one row.
SEGMENT = 1024


def bit_words(positions: DataFrame, position: str, bits: int) -> np.ndarray:
    """An array of `bits` bits (a multiple of 64) in which those at the given positions, from 0, are set; bits / 8 bytes whatever the number of rows."""
    word, bit = F.shiftright(position, 6), F.col(position).bitwiseAND(63).cast("int")
    segments = (
        positions.groupBy(word.alias("_w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("_b"))
        .groupBy(F.floor(F.col("_w") / SEGMENT).alias("_s")).agg(F.collect_list(F.struct("_w", "_b")).alias("_words"))
    )
    words = np.zeros(bits // 64, np.int64)
    for row in segments.toLocalIterator():
        words[[x["_w"] for x in row["_words"]]] = [x["_b"] for x in row["_words"]]
    return words
