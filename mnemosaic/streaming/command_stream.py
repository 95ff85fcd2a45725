"""A command log as a stream: batches are committed to a store as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.changefeed import BucketedTable
from ..schema import COMMAND_SCHEMA
from ..store import MemoryStore


def read_commands(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """Commands from a folder that grows by Parquet files."""
    return spark.readStream.schema(COMMAND_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def into_store(commands: DataFrame, store: MemoryStore, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Commit each batch to the store, in the order of ``seq``; the store's capacity holds after every batch.

    Batches count in the order of their arrival. One that is sent again after a
    failure is known by ``checkpoint`` and its number, and changes nothing.
    """

    def commit(batch: DataFrame, number: int) -> None:
        store.apply_commands(batch, (checkpoint, number))

    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return commands.writeStream.option("checkpointLocation", checkpoint).foreachBatch(commit).trigger(**trigger).start()


def into_table(changes: DataFrame, table: BucketedTable, payload: list[str], checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Apply each batch of changes to a bucketed table. A batch that is sent again changes nothing, as changes count by their number."""

    def commit(batch: DataFrame, _: int) -> None:
        table.apply(batch, payload)

    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(commit).trigger(**trigger).start()


def hourly_operations(commands: DataFrame, time: str = "recorded_at", lateness: str = "1 hour") -> DataFrame:
    """Operations by hour and kind, closed ``lateness`` after the newest command seen."""
    return commands.withWatermark(time, lateness).groupBy(F.window(time, "1 hour"), "op").agg(F.count(F.lit(1)).alias("n"))
