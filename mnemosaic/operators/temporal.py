"""Ranges, bounds and extremes of ``created_at``. Predicates on a column reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidTimeRangeError, NoMemoriesInRangeError


def check_range(start: int, end: int) -> None:
    if start > end:
        raise InvalidTimeRangeError(f"the range begins at {start} and ends at {end}")


def require_rows(df: DataFrame) -> DataFrame:
    """``df``, or an error if it has no rows."""
    if not df.limit(1).count():
        raise NoMemoriesInRangeError("no memory lies in the range")
    return df


def in_range(memories: DataFrame, start: int, end: int) -> DataFrame:
    """Memories of an inclusive range."""
    check_range(start, end)
    return memories.where(F.col("created_at").between(start, end))


def range_ids(memories: DataFrame, start: int, end: int, strict: bool = False) -> DataFrame:
    """Ids of a range, in order; with ``strict`` an empty range is an error."""
    ids = in_range(memories, start, end).select("id").orderBy("id")
    return require_rows(ids) if strict else ids


def range_with_count(memories: DataFrame, start: int, end: int, strict: bool = False) -> tuple[DataFrame, int]:
    """(ids of a range in order, how many they are)."""
    ids = range_ids(memories, start, end, strict)
    return ids, in_range(memories, start, end).count()


def count_in_range(memories: DataFrame, start: int, end: int, strict: bool = False) -> DataFrame:
    inside = in_range(memories, start, end)
    return (require_rows(inside) if strict else inside).agg(F.count(F.lit(1)).alias("n"))


def bounds(memories: DataFrame) -> DataFrame:
    """One row: earliest and latest time, NULL of an empty table."""
    return memories.agg(F.min("created_at").alias("earliest"), F.max("created_at").alias("latest"))


def before(memories: DataFrame, ts: int, strict: bool = False) -> DataFrame:
    """Ids created before ``ts``, the marks for eviction; none for 0. With ``strict`` it is an error if there are none."""
    ids = memories.where(F.col("created_at") < ts if ts else F.lit(False)).select("id").orderBy("id")
    return require_rows(ids) if strict else ids


def recent(memories: DataFrame, ts: int, strict: bool = False) -> DataFrame:
    ids = memories.where(F.col("created_at") >= ts).select("id").orderBy("id")
    return require_rows(ids) if strict else ids


def oldest(memories: DataFrame, n: int, strict: bool = False) -> DataFrame:
    rows = memories.select("id", "created_at").orderBy("created_at", "id").limit(n)
    return require_rows(rows) if strict else rows


def newest(memories: DataFrame, n: int, strict: bool = False) -> DataFrame:
    rows = memories.select("id", "created_at").orderBy(F.desc("created_at"), "id").limit(n)
    return require_rows(rows) if strict else rows
