"""Upserts, deletes and the fold of a command log, as set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import numbered
from ..schema import MEMORY_SCHEMA
from . import graph


def upsert(base: DataFrame, batch: DataFrame, seq: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(table, rejected) after a batch of memories replaces and adds to ``base``; of several rows with an id the last by ``seq`` counts.

    A new row without embedding keeps the old one if its content is the same;
    with other content it is rejected and the old row stays, whether that has an
    embedding or not. Edges are not touched.
    """
    names = [f.name for f in MEMORY_SCHEMA]
    key = F.col(seq) if seq else F.lit(0)
    last = batch.groupBy("id").agg(F.max_by(F.struct(*names), key).alias("new"))
    both = base.select("id", F.struct(*names).alias("old")).join(last, "id", "full")
    same = F.col("old.content") == F.col("new.content")
    refused = F.col("new").isNotNull() & F.col("old").isNotNull() & F.col("new.embedding").isNull() & ~same
    inherits = F.col("new.embedding").isNull() & F.coalesce(same, F.lit(False))
    taken = F.when(inherits, F.col("new").withField("embedding", F.col("old.embedding"))).otherwise(F.col("new"))
    row = F.when(F.col("new").isNull() | F.coalesce(refused, F.lit(False)), F.col("old")).otherwise(taken)
    table = both.select(row.alias("row")).select(*(F.col(f"row.{c}").alias(c) for c in names))
    return table, both.where(refused).select("id")


def allocate_ids(batch: DataFrame, order: str, first: int) -> DataFrame:
    """Give the rows ids from ``first`` on in the order of ``order``."""
    return numbered(batch, [order], "id", first)


def delete(memories: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(memories, edges) without the ids of ``gone`` and their edges."""
    return memories.join(gone.select("id").distinct(), "id", "left_anti"), graph.without_nodes(edges, gone)


def fold(commands: DataFrame, base: DataFrame | None = None, links: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(memories, edges) after all commands in the order of ``seq``, on top of the tables ``base`` and ``links`` if given.

    A memory is there if its last add or delete is an add. An edge is there if
    its last connect comes after the last disconnect of its ends and after the
    last delete of either, and both are there. Only the commands are folded:
    the rows of ``base`` that no command touches pass as they lie, so predicates
    reach its scan.
    """
    mine = commands.where(F.col("op").isin("add", "delete"))
    state = mine.groupBy("id").agg(F.max_by(F.struct("op", "memory"), "seq").alias("x"), F.max(F.when(F.col("op") == "delete", F.col("seq"))).alias("deleted"))
    there = state.where(F.col("x.op") == "add")
    names = [f.name for f in MEMORY_SCHEMA if f.name != "id"]
    memories = there.select("id", *(F.col(f"x.memory.{c}").alias(c) for c in names))
    ends = there.select("id", F.coalesce("deleted", F.lit(-1)).cast("long").alias("deleted"))
    if base is not None:
        untouched = base.join(state.select("id"), "id", "left_anti")
        memories = untouched.select("id", *names).unionByName(memories)
        ends = untouched.select("id", F.lit(-1).cast("long").alias("deleted")).unionByName(ends)
    pairs = commands.where("op = 'disconnect'").groupBy("src", "dst").agg(F.max("seq").alias("cut"))
    made = commands.where("op = 'connect'").groupBy("src", "dst", "relation").agg(F.max("seq").alias("made"))
    new = made.join(pairs, ["src", "dst"], "left")
    new = new.join(ends.withColumnsRenamed({"id": "src", "deleted": "da"}), "src").join(ends.withColumnsRenamed({"id": "dst", "deleted": "db"}), "dst")
    edges = new.where((F.col("made") > F.coalesce("cut", F.lit(-1))) & (F.col("made") > F.col("da")) & (F.col("made") > F.col("db"))).select("src", "dst", "relation")
    if links is not None:
        kept = graph.without_nodes(links, state.where("deleted IS NOT NULL")).join(pairs, ["src", "dst"], "left_anti")
        edges = kept.join(edges, ["src", "dst", "relation"], "left_anti").select("src", "dst", "relation").unionByName(edges)
    return memories, edges
