"""The given tables as memories and edges of the data model, with their dirt defined away.

Each is cleaned once for an application and kept in the shared folder, as a
store keeps its tables: memories by collection and time, edges by source. So a
query reads a table with unique ids, and its predicates reach the scan. A
table that changes is cleaned anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import fs_stamp, read_table, scratch_path
from ..schema import MEMORY_SCHEMA

DIMENSION = 64

_cleaned: dict[tuple, str] = {}


def write_memories(df: DataFrame, path: str) -> None:
    """A folder for each collection, in each the rows by time. Ranges of (collection, time) share the work, so a collection with a third of all rows has many files, and small ones share a task."""
    df.repartitionByRange("collection", "created_at", "id").sortWithinPartitions("collection", "created_at", "id").write.mode("overwrite").partitionBy("collection").parquet(path)


def read_memories(spark: SparkSession, path: str, schema: T.StructType = MEMORY_SCHEMA) -> DataFrame:
    rows = spark.read.schema(schema).parquet(path)
    # An empty name has no folder of its own.
    return rows.select(*(F.coalesce("collection", F.lit("")).alias("collection") if f.name == "collection" else f.name for f in schema))


def _kept(spark: SparkSession, sf_dir: str, name: str, sources: list[str], write: Callable[[str], None]) -> str:
    """The path of a cleaned table, which ``write`` makes unless these sources were cleaned before."""
    key = (spark.sparkContext.applicationId, name, *(fs_stamp(spark, f"{sf_dir}/{s}.parquet") for s in sources))
    if key not in _cleaned:
        path = scratch_path(spark, name)
        write(path)
        _cleaned[key] = path
    return _cleaned[key]


CLEAN_SCHEMA = T.StructType([T.StructField(f.name, T.DoubleType() if f.name == "importance" else f.dataType) for f in MEMORY_SCHEMA])


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each id (repeated rows are equal).

    An embedding of another length, or with NaN or infinite components, is
    NULL; null metadata is empty, null or NaN importance 0, a null collection
    'default' and null content empty.
    """

    def write(path: str) -> None:
        m = read_table(spark, sf_dir, "memories").where("id IS NOT NULL").dropDuplicates(["id"])
        e = F.col("embedding")
        finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        clean = m.select(
            "id",
            F.coalesce("collection", F.lit("default")).alias("collection"),
            F.coalesce("content", F.lit(b"")).alias("content"),
            F.when((F.size(e) == DIMENSION) & finite, e).alias("embedding"),
            F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"),
            F.coalesce("created_at", F.lit(0)).alias("created_at"),
            F.coalesce(F.nanvl("importance", F.lit(0.0).cast("float")), F.lit(0.0).cast("float")).cast("double").alias("importance"),
        )
        write_memories(clean, path)

    return read_memories(spark, _kept(spark, sf_dir, "memories", ["memories"], write), CLEAN_SCHEMA)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (src, dst, relation) whose ends both exist in one collection; relations without regard to case and outer blanks, null ones as 'related'."""

    def write(path: str) -> None:
        where = memories(spark, sf_dir).select("id", "collection")
        e = read_table(spark, sf_dir, "edges").where("src IS NOT NULL AND dst IS NOT NULL")
        e = e.select("src", "dst", F.coalesce(F.lower(F.trim("relation")), F.lit("related")).alias("relation")).distinct()
        a = where.select(F.col("id").alias("src"), F.col("collection").alias("ca"))
        b = where.select(F.col("id").alias("dst"), F.col("collection").alias("cb"))
        there = e.join(a, "src").join(b, "dst").where(F.col("ca") == F.col("cb")).select("src", "dst", "relation")
        there.repartitionByRange("src", "dst").sortWithinPartitions("src", "dst").write.parquet(path)

    path = _kept(spark, sf_dir, "edges", ["memories", "edges"], write)
    return spark.read.schema("src long, dst long, relation string").parquet(path)


#: The same two tables in SQL.
MEMORIES_SQL = """
mem AS (
  SELECT id, coalesce(collection, 'default') AS collection, coalesce(content, ''::BLOB) AS content,
    CASE WHEN len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 THEN list_transform(embedding, lambda x: x::DOUBLE) END AS embedding,
    coalesce(metadata, MAP {}) AS metadata, coalesce(created_at, 0) AS created_at,
    CASE WHEN importance IS NULL OR importance::VARCHAR = 'nan' THEN 0.0::DOUBLE ELSE importance::DOUBLE END AS importance
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at) AS nth FROM memories WHERE id IS NOT NULL) WHERE nth = 1)"""
EDGES_SQL = """
edg AS (
  SELECT DISTINCT e.src, e.dst, coalesce(lower(trim(e.relation)), 'related') AS relation
  FROM edges e JOIN mem a ON a.id = e.src JOIN mem b ON b.id = e.dst WHERE a.collection = b.collection)"""
