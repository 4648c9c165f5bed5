"""Frequent keys to every task, up to a stated number of them; the rest stays a table to join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def threshold(counts: DataFrame, column: str, at_most: int) -> int:
    """The smallest bound that at most ``at_most`` rows of ``counts`` reach, from classes of an eighth of a power of two.

    There are at most 512 classes, whatever the table's size.
    """
    at = F.floor(F.log2(F.col(column).cast("double")) * 8)
    classes = counts.where(F.col(column) > 0).groupBy(at.cast("int").alias("at")).agg(F.count("*").alias("n"), F.min(column).alias("low")).collect()
    left, bound = at_most, 1 << 62
    for c in sorted(classes, key=lambda c: -c.at):
        if c.n > left:
            break
        left, bound = left - c.n, c.low
    return bound
