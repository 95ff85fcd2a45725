"""The commands of the recorded database, from both tables that hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import read_table


def op_name(op: Column) -> Column:
    """An operation without regard to case and outer blanks."""
    return F.lower(F.regexp_replace(op, r"^\s+|\s+$", ""))


def log_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(command_id, op, id, src, dst, relation, text, collection, recorded_at) of the lines of the replay log; the ends of older lines stand in other columns."""
    log = read_table(spark, sf_dir, "replay_log")
    return log.select("command_id", op_name(F.col("op")).alias("op"), "id", F.coalesce("id1", "from_id").alias("src"), F.coalesce("id2", "to_id").alias("dst"), "relation", "text", "collection", "recorded_at")


def wal_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commands of all log reads; null and empty lists have none, and a torn command has no op, so it has no effect."""
    c = read_table(spark, sf_dir, "wal_reads").select(F.explode("commands").alias("c")).select("c.*")
    return c.select("command_id", op_name(F.col("op")).alias("op"), "id", "src", "dst", "relation", "text", "collection")
