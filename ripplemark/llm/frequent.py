"""Bounding a list of frequent items by their counts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def least_count(counts: DataFrame, most: int) -> int:
    """The least count ``c`` that at most ``most`` rows reach, to an eighth of an octave."""
    level = F.floor(F.log2(F.col("c").cast("double")) * 8).cast("int")
    levels = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()  # some hundreds
    total, lowest = 0, None
    for r in sorted(levels, key=lambda r: -r["level"]):
        total += r["n"]
        if total > most:
            break
        lowest = r["level"]
    return 1 << 62 if lowest is None else math.ceil(2 ** (lowest / 8) - 1e-9)
