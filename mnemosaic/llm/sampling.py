"""Bounded samples for fitting and estimating."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_sample(df: DataFrame, key: str, rows: int, most: int) -> DataFrame:
    """At most ``most`` of about ``rows`` rows, by the hash of ``key``.

    Rows are thinned out where they lie, so what reaches the driver does not
    grow with the number of tasks.
    """
    share = min(1.0, 1.5 * most / max(rows, 1) + 64 / max(rows, 1))
    chance = (F.xxhash64(F.lit(91), key).bitwiseAND(F.lit((1 << 31) - 1)) / float(1 << 31)) < share
    return (df.where(chance) if share < 1 else df).orderBy(F.xxhash64(key), key).limit(most)
