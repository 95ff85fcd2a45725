"""Connected components of a graph of links, by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize


def _fingerprint(edges: DataFrame) -> tuple:
    """Number and hashes of all edges: equal for equal sets."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", F.lit(7), "u"))).collect()[0])


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label) of every end of the links (a, b); the label is the smallest node of its component.

    Each round replaces every edge by one from its larger end to the smallest
    neighbour of its smaller end, so the number of rounds is logarithmic. No
    node's neighbours are gathered: minima are pre-aggregated, and each round
    has at most as many edges as the one before. Null ends and loops are left
    out; no links give no rows.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialize(edges, "edges")
    known = _fingerprint(edges)
    for _ in range(max_rounds):
        # Large star: every larger neighbour hooks onto the smallest around the node.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        # Small star: the node and its smaller neighbours hook onto the smallest.
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(least.select("u", F.col("low").alias("v"))).where("u <> v").distinct()
        edges = materialize(small, "edges")
        before, known = known, _fingerprint(edges)
        if known == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
