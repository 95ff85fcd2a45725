"""Traversals of edges (src, dst, relation) as joins, level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import CrossCollectionError, InvalidMaxHopsError, NotFoundError
from ..runtime import materialize

#: Levels that stay one lazy plan; deeper traversals are written out between levels.
LAZY_LEVELS = 3


def neighbours(edges: DataFrame, node: int) -> DataFrame:
    """(dst, relation) of a node, in that order."""
    return edges.where(F.col("src") == node).select("dst", "relation").orderBy("dst", "relation")


def neighbour_ids(edges: DataFrame, node: int) -> DataFrame:
    """One row for each relation, so a neighbour may come more than once."""
    return edges.where(F.col("src") == node).select(F.col("dst").alias("id")).orderBy("id")


def within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (id)."""
    ids = nodes.select("id").distinct()
    kept = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
    return kept.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "relation")


def reach(edges: DataFrame, seeds: DataFrame, max_hops: int) -> DataFrame:
    """(id, hops) of every node within ``max_hops`` of any of the ``seeds`` (id), the seeds at 0.

    One traversal for all seeds: a node is expanded once, at its least distance.
    """
    if max_hops < 1:
        raise InvalidMaxHopsError(f"max_hops must be at least 1, not {max_hops}")
    steps = edges.select("src", F.col("dst").alias("id"))  # parallel relations go with what the front reaches, not with a shuffle of all edges
    found = seeds.select("id").distinct().withColumn("hops", F.lit(0))
    front = found
    for hop in range(1, max_hops + 1):
        there = front.select(F.col("id").alias("src")).join(steps, "src").select("id").distinct()
        front = there.join(found.select("id"), "id", "left_anti").withColumn("hops", F.lit(hop))
        if hop > LAZY_LEVELS:
            front = materialize(front, "front")
            if not front.limit(1).count():
                break
        found = found.unionByName(front)
        if hop >= LAZY_LEVELS and hop < max_hops:
            found = materialize(found, "reached")
    return found


def bfs(edges: DataFrame, nodes: DataFrame, start: int, max_hops: int, collection: str | None = None) -> DataFrame:
    """(id, hops) from one node. Within a collection, other nodes aren't passed; a start outside it gives no rows."""
    seed = nodes.where(F.col("id") == start)
    if collection is not None:
        inside = nodes.where(F.col("collection") == collection)
        return reach(within(edges, inside), seed.where(F.col("collection") == collection), max_hops)
    return reach(edges, seed, max_hops)


def reachable(edges: DataFrame, nodes: DataFrame, start: int, max_hops: int, collection: str | None = None) -> DataFrame:
    return bfs(edges, nodes, start, max_hops, collection).select("id")


def require_node(nodes: DataFrame, node: int) -> None:
    if not nodes.where(F.col("id") == node).limit(1).count():
        raise NotFoundError(f"no memory {node}")


def simple_paths(edges: DataFrame, start: int, max_depth: int) -> DataFrame:
    """(path) of every path without repeated nodes from ``start`` with up to ``max_depth`` edges, the bare start included; parallel relations give a path each."""
    if max_depth < 1:
        raise InvalidMaxHopsError(f"max_depth must be at least 1, not {max_depth}")
    steps = edges.select(F.col("src").alias("__src"), F.col("dst").alias("__dst"))
    level = edges.sparkSession.range(1).select(F.array(F.lit(start).cast("long")).alias("path"), F.lit(start).cast("long").alias("__at"))
    out = level
    for depth in range(1, max_depth + 1):
        level = level.join(steps, F.col("__at") == F.col("__src")).where(~F.array_contains("path", F.col("__dst")))
        level = level.select(F.array_append("path", F.col("__dst")).alias("path"), F.col("__dst").alias("__at"))
        if depth % LAZY_LEVELS == 0 and depth < max_depth:
            level = materialize(level, "paths")
        out = out.unionByName(level)
    return out.select("path")


def shortest_path(edges: DataFrame, start: int, end: int) -> list[int] | None:
    """The first in order of the shortest paths, or None. Every node is reached once, so the search ends."""
    spark = edges.sparkSession
    if start == end:
        return [start]
    steps = edges.select("src", "dst").distinct()
    front = spark.range(1).select(F.lit(start).cast("long").alias("id"), F.array(F.lit(start).cast("long")).alias("path"))
    seen = front.select("id")
    while True:
        step = front.select(F.col("id").alias("src"), "path").join(steps, "src").join(seen.select(F.col("id").alias("dst")), "dst", "left_anti")
        front = materialize(step.groupBy(F.col("dst").alias("id")).agg(F.min(F.array_append("path", F.col("dst"))).alias("path")), "paths")
        rows = front.where(F.col("id") == end).select("path").collect()
        if rows:
            return list(rows[0][0])
        if not front.limit(1).count():
            return None
        seen = materialize(seen.unionByName(front.select("id")), "seen")


def connectable(edges: DataFrame, nodes: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of new edges: accepted ones have both ends in one collection and aren't there yet."""
    a = nodes.select(F.col("id").alias("src"), F.col("collection").alias("__a"))
    b = nodes.select(F.col("id").alias("dst"), F.col("collection").alias("__b"))
    checked = new.select("src", "dst", "relation").distinct().join(a, "src", "left").join(b, "dst", "left")
    fine = F.coalesce(F.col("__a") == F.col("__b"), F.lit(False))
    reason = F.when(F.col("__a").isNull() | F.col("__b").isNull(), "missing end").otherwise("two collections")
    accepted = checked.where(fine).select("src", "dst", "relation").join(edges, ["src", "dst", "relation"], "left_anti")
    return accepted, checked.where(~fine).select("src", "dst", "relation", reason.alias("reason"))


def require_connectable(nodes: DataFrame, src: int, dst: int) -> None:
    where = {r["id"]: r["collection"] for r in nodes.where(F.col("id").isin(src, dst)).select("id", "collection").collect()}
    for node in (src, dst):
        if node not in where:
            raise NotFoundError(f"no memory {node}")
    if where[src] != where[dst]:
        raise CrossCollectionError(f"{src} and {dst} are in two collections")


def disconnect(edges: DataFrame, src: int, dst: int) -> DataFrame:
    """All edges but those from ``src`` to ``dst``, of any relation."""
    return edges.where(~((F.col("src") == src) & (F.col("dst") == dst)))


def without_nodes(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges that touch none of the deleted ids."""
    ids = gone.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst", "relation")


def joined_path(path: Column) -> Column:
    return F.concat_ws(">", F.transform(path, lambda x: x.cast("string")))
