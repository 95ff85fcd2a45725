"""The operation log: one JSON object a line, the first of which is a header."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import StorageError
from ..runtime import materialize, numbered
from ..schema import DEFAULT_COLLECTION

VERSION = "1.0"
OPERATION_SCHEMA = "op string, id long, text string, embedding array<float>, collection string, metadata map<string,string>, id1 long, id2 long, from_id long, to_id long, relation string, _corrupt string"


@dataclass(frozen=True)
class Header:
    version: str
    dimension: int
    sync: str
    recorded_at: str | None


def parse_header(line: str) -> Header:
    """The header of a log; whatever program wrote it, its version stands under a name that ends in ``_replay``."""
    try:
        h = json.loads(line)
        version = next((v for k, v in h.items() if k.endswith("_replay")), None)
        if version != VERSION:
            raise StorageError(f"unknown log version {version!r}")
        return Header(version, int(h["dimension"]), h.get("sync", "strict"), h.get("recorded_at"))
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        raise StorageError("the log has no header") from e


def read_header(spark: SparkSession, path: str) -> Header:
    first = spark.read.text(path).where(_is_header("value")).select("value").first()
    if first is None:
        raise StorageError("the log has no header")
    return parse_header(first[0])


def _is_header(line: str):
    return F.get_json_object(line, "$.dimension").isNotNull() & F.get_json_object(line, "$.op").isNull()


def read_operations(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line, op, id, ...) of all operations; blank lines are skipped, a line that isn't JSON keeps its text in ``_corrupt``.

    Their order is that of file, block (where in the file a task began) and
    line (rising within a task).
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), F.trim("value").alias("value"))
    lines = lines.where((F.col("value") != "") & ~_is_header("value"))
    parsed = F.from_json("value", OPERATION_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return lines.select("file", "block", "line", parsed.alias("o")).select("file", "block", "line", "o.*")


def valid_prefix(ops: DataFrame) -> DataFrame:
    """The operations before the first line that cannot be read: what a torn log still holds for sure."""
    place = F.struct("file", "block", "line")
    torn = ops.where("_corrupt IS NOT NULL").agg(F.min(place).alias("torn"))  # one row
    return ops.crossJoin(F.broadcast(torn)).where(F.col("torn").isNull() | (place < F.col("torn"))).drop("torn")


class ReplayWriter:
    """Appends operations to a log of the driver; the header is written only to a new file."""

    def __init__(self, path: str, dimension: int, sync: str = "strict"):
        self._file = Path(path).open("a", encoding="utf-8", buffering=1)
        if not Path(path).stat().st_size:
            self._line({"mnemosaic_replay": VERSION, "dimension": dimension, "sync": sync, "recorded_at": datetime.now(UTC).isoformat()})

    def _line(self, record: dict) -> None:
        self._file.write(json.dumps(record) + "\n")

    def add(self, mid: int, text: str, embedding: Sequence[float], collection: str, metadata: dict[str, str] | None) -> None:
        self._line({"op": "add", "id": mid, "text": text, "embedding": list(embedding), "collection": collection, "metadata": metadata})

    def connect(self, src: int, dst: int, relation: str) -> None:
        self._line({"op": "connect", "id1": src, "id2": dst, "relation": relation})

    def disconnect(self, src: int, dst: int) -> None:
        self._line({"op": "disconnect", "id1": src, "id2": dst})

    def delete(self, mid: int) -> None:
        self._line({"op": "delete", "id": mid})

    def mark(self, op: str) -> None:
        """compact and checkpoint have no arguments."""
        self._line({"op": op})

    def flush(self) -> None:
        self._file.flush()

    def close(self) -> None:
        self._file.close()

    def __enter__(self) -> ReplayWriter:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def planned(ops: DataFrame, dimension: int, first: int, now: int) -> DataFrame:
    """Every operation with what becomes of it: n, op, state (done, failed, unmapped, unknown) and, of those done, the command with new ids.

    Adds get ids from ``first`` on in the order of the log. The ends of a
    connect and the id of a delete mean the last add of that id before them. An
    add without a vector of ``dimension`` fails, so does what touches a memory
    that was deleted before, or connects two collections; an id that was never
    added is unmapped. All that is a fixed number of joins and windows over the
    table of operations, whatever its length.
    """
    o = materialize(numbered(ops, ["file", "block", "line"], "n").drop("file", "block", "line", "_corrupt"), "operations")
    fits = F.coalesce((F.col("op") == "add") & (F.size("embedding") == dimension), F.lit(False))
    collection = F.coalesce("collection", F.lit(DEFAULT_COLLECTION))
    adds = materialize(numbered(o.where(fits).select("n", F.col("id").alias("old"), collection.alias("where")), ["n"], "new", first), "adds")
    spans = adds.where("old IS NOT NULL").withColumn("until", F.lead("n").over(Window.partitionBy("old").orderBy("n"))).withColumnRenamed("n", "since")
    given = lambda a, b: F.coalesce(F.when(F.col(a) != 0, F.col(a)), b)
    ends = F.when(F.col("op") == "connect", F.array(F.struct(F.lit(1).alias("end"), given("id1", "from_id").alias("old")), F.struct(F.lit(2).alias("end"), given("id2", "to_id").alias("old")))).otherwise(F.array(F.struct(F.lit(1).alias("end"), F.col("id").alias("old"))))
    asked = o.where(F.col("op").isin("connect", "delete")).select("n", "op", F.explode(ends).alias("x")).select("n", "op", "x.end", "x.old")
    inside = (asked["old"] == spans["old"]) & (F.col("since") < F.col("n")) & (F.col("until").isNull() | (F.col("n") < F.col("until")))
    meant = materialize(asked.join(spans, inside, "left").select("n", "op", "end", "new", "where"), "meant")
    gone = meant.where("op = 'delete' AND new IS NOT NULL").groupBy("new").agg(F.min("n").alias("gone"))
    there = F.col("gone").isNull() | (F.col("n") < F.col("gone")) | ((F.col("op") == "delete") & (F.col("n") == F.col("gone")))
    of = lambda end, c: F.max(F.when(F.col("end") == end, F.col(c)))
    judged = meant.join(gone, "new", "left").groupBy("n").agg(of(1, "new").alias("a"), of(2, "new").alias("b"), F.count_if(F.col("new").isNull()).alias("unmapped"), F.count_if(F.col("new").isNotNull() & ~there).alias("absent"), F.count_distinct("where").alias("places"))
    state = (
        F.when(F.col("op") == "add", F.when(F.col("new").isNotNull(), "done").otherwise("failed"))
        .when(~F.coalesce(F.col("op").isin("connect", "delete"), F.lit(False)), "unknown")
        .when(F.col("unmapped") > 0, "unmapped")
        .when((F.col("absent") > 0) | (F.col("places") > 1), "failed")
        .otherwise("done")
    )
    memory = F.struct(F.col("new").alias("id"), collection.alias("collection"), F.coalesce("text", F.lit("")).cast("binary").alias("content"), "embedding", F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"), F.lit(now).cast("long").alias("created_at"), F.lit(0.0).cast("float").alias("importance"))
    whole = o.join(adds.select("n", "new"), "n", "left").join(judged, "n", "left")
    connects = F.col("op") == "connect"
    return whole.select("n", "op", state.alias("state"), F.when(connects, None).otherwise(F.coalesce("new", "a")).cast("long").alias("id"), F.when(F.col("op") == "add", memory).alias("memory"), F.when(connects, F.col("a")).alias("src"), F.when(connects, F.col("b")).alias("dst"), F.when(connects, F.coalesce("relation", F.lit(""))).alias("relation"))


def export(memories: DataFrame, path: str, dimension: int, edges: DataFrame | None = None) -> dict[str, int]:
    """Write all memories with an embedding (then the edges, if given) as a folder of log lines; the header is its first file."""
    spark = memories.sparkSession
    ops = memories.where("embedding IS NOT NULL").select(F.to_json(F.struct(F.lit("add").alias("op"), "id", F.decode("content", "UTF-8").alias("text"), "embedding", "collection", "metadata")).alias("value"))
    counts = memories.agg(F.count(F.lit(1)).alias("checked"), F.count("embedding").alias("exported")).collect()[0].asDict()
    spark.createDataFrame([(json.dumps({"mnemosaic_replay": VERSION, "dimension": dimension, "sync": "strict"}),)], "value string").coalesce(1).write.text(f"{path}/part=0")
    ops.write.text(f"{path}/part=1")
    if edges is not None:
        edges.select(F.to_json(F.struct(F.lit("connect").alias("op"), F.col("src").alias("id1"), F.col("dst").alias("id2"), "relation")).alias("value")).write.text(f"{path}/part=2")
    return {"checked": counts["checked"], "exported": counts["exported"], "skipped_missing_embedding": counts["checked"] - counts["exported"]}
