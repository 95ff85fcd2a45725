"""How much a table holds, and what has to go when that is too much."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import broadcast_if_below, materialize


@dataclass(frozen=True)
class Capacity:
    max_entries: int | None = None
    max_bytes: int | None = None


def row_bytes() -> Column:
    """Estimated bytes of a memory: texts in UTF-8, 4 for each vector component."""
    texts = F.aggregate(F.map_entries("metadata"), F.lit(0).cast("long"), lambda s, e: s + F.octet_length(e["key"]) + F.coalesce(F.octet_length(e["value"]), F.lit(0)))
    return F.octet_length("collection") + F.coalesce(F.octet_length("content"), F.lit(0)) + F.coalesce(F.size("embedding"), F.lit(0)) * 4 + texts


def usage(memories: DataFrame) -> DataFrame:
    """One row: entries and bytes."""
    return memories.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum(row_bytes()), F.lit(0)).cast("long").alias("bytes"))


def evicted(memories: DataFrame, limit: Capacity) -> DataFrame:
    """(id) of the memories that go, the oldest, least important first, until both limits hold.

    What goes is a prefix of one order over the whole table, so the order is
    range-sorted and summed up in two steps: no task sorts the table alone.
    """
    sized = memories.select("id", "created_at", F.col("importance").cast("double").alias("importance"), row_bytes().cast("long").alias("bytes"))
    if limit.max_entries is None and limit.max_bytes is None:
        return sized.select("id").limit(0)
    order = ["created_at", "importance", "id"]
    ranged = materialize(sized.repartitionByRange(*order).withColumn("pid", F.spark_partition_id()), "ranged")
    parts = ranged.groupBy("pid").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"))
    ahead = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    parts = parts.select("pid", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n0"), F.coalesce(F.sum("b").over(ahead), F.lit(0)).alias("b0"))
    total = ranged.agg(F.count(F.lit(1)).alias("n_all"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("b_all"))
    inner = Window.partitionBy("pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("n1", F.count(F.lit(1)).over(inner)).withColumn("b1", F.coalesce(F.sum("bytes").over(inner), F.lit(0)))
    placed = placed.join(broadcast_if_below(parts, 100_000), "pid").crossJoin(F.broadcast(total))
    too_many = F.lit(False) if limit.max_entries is None else F.col("n_all") - F.col("n0") - F.col("n1") > limit.max_entries
    too_large = F.lit(False) if limit.max_bytes is None else F.col("b_all") - F.col("b0") - F.col("b1") > limit.max_bytes
    return placed.where(too_many | too_large).select("id")
