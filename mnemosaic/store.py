"""A store of memories and edges on any Hadoop file system.

Layout below the store's path: ``_META`` (dimension, format), ``v<n>/`` (the
tables of checkpoint n, memories by collection and time), ``_log/<seq>``
(committed commands since), ``_pointers/<n>`` (checkpoint n and the last
sequence number in it; the newest holds, and none is ever changed) and
``_LOCK`` (one writer). A commit is one directory renamed into the log; a
reader lays the folded log over the checkpoint as one lazy plan over a fixed
list of files, so what it sees does not change under it.
"""

from __future__ import annotations

import functools
import json
import threading
import time
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .errors import ConfigError, DimensionMismatchError, NotFoundError, StorageError
from .operators import capacity, graph, mutations
from .operators.capacity import Capacity
from .runtime import fs_create_once, fs_delete, fs_list, fs_of, fs_text, materialize, numbered
from .schema import COMMAND_SCHEMA, DEFAULT_COLLECTION, EDGE_SCHEMA, MEMORY_SCHEMA
from .sources.tables import read_memories, write_memories

FORMAT = 1


@dataclass(frozen=True)
class SyncPolicy:
    """When buffered commands are committed: at each call, or after a number of them or some time, whichever is first. The time is kept by a thread of its own, so nothing stays behind when calls cease."""

    kind: str = "strict"
    max_ops: int = 64
    max_seconds: float = 0.05

    @classmethod
    def of(cls, name: str | SyncPolicy) -> SyncPolicy:
        if isinstance(name, SyncPolicy):
            return name
        kinds = {"strict": cls(), "batch": cls("batch"), "async": cls("async", 1_000_000, 0.01)}
        if str(name).lower() not in kinds:
            raise ConfigError(f"unknown sync policy {name!r}")
        return kinds[str(name).lower()]


@dataclass
class Snapshot:
    """Memories and edges as they were when it was taken."""

    memories: DataFrame
    edges: DataFrame


def _row_bytes(memory: tuple) -> int:
    """As capacity.row_bytes, of a memory that the driver has."""
    _, collection, content, embedding, metadata, *_ = memory
    return len(collection.encode()) + len(content) + 4 * len(embedding or ()) + sum(len(k.encode()) + len(v.encode()) for k, v in metadata.items())


@dataclass
class EvictionReport:
    """What a capacity took away; ``table`` holds the ids (id), ``evicted`` brings them to the driver."""

    table: DataFrame | None = None
    entries_before: int = 0
    entries_after: int = 0
    bytes_before: int = 0
    bytes_after: int = 0

    @property
    def evicted(self) -> list[int]:
        return [] if self.table is None else [r["id"] for r in self.table.select("id").orderBy("id").collect()]


def _locked(f):
    """Calls of one store come one after the other, also those of its timer."""

    @functools.wraps(f)
    def call(self, *args, **options):
        with self._mutex:
            return f(self, *args, **options)

    return call


class MemoryStore:
    def __init__(self, spark: SparkSession, path: str, dimension: int | None = None, sync: str | SyncPolicy = "strict", limit: Capacity = Capacity(), checkpoint_every: int | None = None, read_only: bool = False, checkpoint_seconds: float | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.sync, self.limit, self.checkpoint_every, self.read_only = SyncPolicy.of(sync), limit, checkpoint_every, read_only
        self.checkpoint_seconds = checkpoint_seconds
        self.last_eviction = EvictionReport()
        self._mutex, self._timer, self._failed = threading.RLock(), None, None
        self._usage: tuple[int, int] | None = None  # entries and bytes, as far as they are known without a scan
        meta = self._read("_META")
        if meta is None:
            if dimension is None or dimension <= 0:
                raise ConfigError("a new store needs a dimension of at least 1")
            if read_only:
                raise StorageError(f"no store at {path}")
            self.dimension = dimension
            self._write("_pointers/0", {"version": 0, "seq": 0, "batches": {}})
            self._write("_META", {"dimension": dimension, "format": FORMAT})
        else:
            if meta["format"] != FORMAT:
                raise StorageError(f"unknown format {meta['format']}")
            if dimension is not None and dimension != meta["dimension"]:
                raise DimensionMismatchError(f"the store has {meta['dimension']} components, not {dimension}")
            self.dimension = meta["dimension"]
        if not read_only:
            self._lock()
        self._pending: list[tuple] = []
        self._commits, self._checkpointed = 0, time.monotonic()
        self._seq = max([self._current()["seq"], *self._log_ends()])
        self._next_id = (self.memories().agg(F.max("id")).collect()[0][0] or 0) + 1

    # Small files ------------------------------------------------------------

    def _read(self, name: str) -> dict | None:
        text = fs_text(self.spark, f"{self.path}/{name}")
        return None if text is None else json.loads(text)

    def _write(self, name: str, value: dict) -> None:
        """A file of that name is written once; readers find it whole or not at all."""
        if not fs_create_once(self.spark, f"{self.path}/{name}", json.dumps(value)):
            raise StorageError(f"{name} is there already")

    def _current(self) -> dict:
        """The newest pointer."""
        newest = max((int(n) for n in fs_list(self.spark, f"{self.path}/_pointers") if n.isdigit()), default=None)
        if newest is None:
            raise StorageError(f"no store at {self.path}")
        return self._read(f"_pointers/{newest}")

    def _lock(self) -> None:
        fs, p = fs_of(self.spark, f"{self.path}/_LOCK")
        if fs.exists(p):
            raise StorageError("another writer has the store open; if it is gone, call MemoryStore.unlock")
        fs.create(p, False).close()

    @staticmethod
    def unlock(spark: SparkSession, path: str) -> None:
        """Remove the lock of a writer that ended without closing."""
        fs_delete(spark, f"{path.rstrip('/')}/_LOCK")

    # Reading ------------------------------------------------------------------

    def _log_ends(self, after: int = -1) -> list[int]:
        return sorted(n for e in fs_list(self.spark, f"{self.path}/_log") if e.isdigit() and (n := int(e)) > after)

    def _commands(self, current: dict) -> DataFrame:
        names = [f"{self.path}/_log/{n:019d}" for n in self._log_ends(current["seq"])]
        return self.spark.read.schema(COMMAND_SCHEMA).parquet(*names) if names else self.spark.createDataFrame([], COMMAND_SCHEMA)

    @property
    def next_id(self) -> int:
        return self._next_id

    def snapshot(self) -> Snapshot:
        current = self._current()
        log = self._commands(current)
        if not current["version"]:
            memories, edges = mutations.fold(log)
        else:
            base = f"{self.path}/v{current['version']}"
            memories, edges = read_memories(self.spark, f"{base}/memories"), self.spark.read.schema(EDGE_SCHEMA).parquet(f"{base}/edges")
            if self._log_ends(current["seq"]):
                memories, edges = mutations.fold(log, memories, edges)
        return Snapshot(memories.select(*(f.name for f in MEMORY_SCHEMA)), edges)

    @property
    def version(self) -> tuple[int, int]:
        """Changes with each commit and checkpoint, so that what was derived from a snapshot knows whether it still holds."""
        current = self._current()
        return current["version"], max([current["seq"], *self._log_ends()])

    def memories(self) -> DataFrame:
        return self.snapshot().memories

    def edges(self) -> DataFrame:
        return self.snapshot().edges

    def get(self, mid: int) -> Row:
        rows = self.memories().where(F.col("id") == mid).collect()
        if not rows:
            raise NotFoundError(f"no memory {mid}")
        return rows[0]

    def neighbours(self, mid: int) -> list[tuple[int, str]]:
        s = self.snapshot()
        graph.require_node(s.memories, mid)
        return [(r["dst"], r["relation"]) for r in graph.neighbours(s.edges, mid).collect()]

    def stats(self) -> dict:
        r = self.memories().agg(F.count(F.lit(1)).alias("entries"), F.count("embedding").alias("indexed_embeddings")).collect()[0]
        return {"entries": r["entries"], "indexed_embeddings": r["indexed_embeddings"], "wal_length": self._commands(self._current()).count(), "vector_dimension": self.dimension, "storage_version": FORMAT}

    # Writing ------------------------------------------------------------------

    def _check_vector(self, v: Sequence[float] | None) -> None:
        if v is not None and len(v) != self.dimension:
            raise DimensionMismatchError(f"the vector has {len(v)} components, not {self.dimension}")

    def _writable(self) -> None:
        if self.read_only:
            raise ConfigError("the store is open for reading only")
        if self._failed is not None:
            failed, self._failed = self._failed, None
            raise StorageError("a commit in the background failed") from failed

    def _append(self, commands: DataFrame, last: int, batch: tuple[str, int] | None = None) -> None:
        """Commit commands as one directory of the log, by rename; with the name and number of the batch that they are."""
        tmp = f"{self.path}/_log/.{uuid.uuid4().hex}"
        commands.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in COMMAND_SCHEMA)).write.parquet(tmp)
        if batch:
            fs_create_once(self.spark, f"{tmp}/_batch", json.dumps(batch))
        fs, a = fs_of(self.spark, tmp)
        _, b = fs_of(self.spark, f"{self.path}/_log/{last:019d}")
        if fs.exists(b) or not fs.rename(a, b):
            raise StorageError("the commit was refused")
        self._commits += 1
        often = self.checkpoint_every and self._commits % self.checkpoint_every == 0
        if often or self.checkpoint_seconds is not None and time.monotonic() - self._checkpointed >= self.checkpoint_seconds:
            self.checkpoint()

    def _batches(self) -> dict[str, int]:
        """The last batch of each source that was committed."""
        current = self._current()
        found = dict(current["batches"])
        for n in self._log_ends(current["seq"]):
            if (text := fs_text(self.spark, f"{self.path}/_log/{n:019d}/_batch")) is not None:
                source, number = json.loads(text)
                found[source] = max(number, found.get(source, -1))
        return found

    def _buffer(self, op: str, mid: int | None = None, memory: tuple | None = None, src: int | None = None, dst: int | None = None, relation: str | None = None) -> None:
        self._seq += 1
        self._pending.append((self._seq, op, mid, memory, src, dst, relation))

    def _after(self) -> None:
        p = self.sync
        if p.kind == "strict" or len(self._pending) >= p.max_ops:
            self.flush()
        elif self._pending and self._timer is None:
            self._timer = threading.Timer(p.max_seconds, self._tick)
            self._timer.daemon = True
            self._timer.start()

    def _tick(self) -> None:
        with self._mutex:
            self._timer = None
            try:
                self.flush()
            except Exception as e:  # told to the next caller
                self._failed = e

    @_locked
    def flush(self) -> None:
        """Commit what is buffered, then keep to the capacity."""
        if self._timer is not None:
            self._timer.cancel()
            self._timer = None
        if self._pending:
            rows, self._pending = self._pending, []
            self._append(self.spark.createDataFrame(rows, COMMAND_SCHEMA).coalesce(1), rows[-1][0])
            added = [r[3] for r in rows if r[1] == "add"]
            if self._usage and all(r[1] != "delete" for r in rows):
                self._usage = self._usage[0] + len(added), self._usage[1] + sum(_row_bytes(m) for m in added)
            else:
                self._usage = None
            self.enforce_capacity()

    def add(self, content: bytes | str = b"", embedding: Sequence[float] | None = None, metadata: dict[str, str] | None = None, collection: str | None = None, created_at: int | None = None, importance: float = 0.0) -> int:
        return self.add_many([{"content": content, "embedding": embedding, "metadata": metadata, "collection": collection, "created_at": created_at, "importance": importance}])[0]

    @_locked
    def add_many(self, records: Iterable[dict]) -> list[int]:
        """All or none: every record is checked before the first is taken. One commit, one time."""
        self._writable()
        now, rows = int(time.time()), []
        for r in records:
            self._check_vector(r.get("embedding"))
            content = r.get("content") or b""
            rows.append((r.get("collection") or DEFAULT_COLLECTION, bytearray(content.encode() if isinstance(content, str) else content), None if r.get("embedding") is None else [float(x) for x in r["embedding"]], {str(k): str(v) for k, v in (r.get("metadata") or {}).items()}, r.get("created_at") if r.get("created_at") is not None else now, float(r.get("importance") or 0.0)))
        ids = list(range(self._next_id, self._next_id + len(rows)))
        self._next_id += len(rows)
        for mid, row in zip(ids, rows):
            self._buffer("add", mid, (mid, *row))
        self._after()
        return ids

    @_locked
    def add_table(self, df: DataFrame, order: str) -> tuple[int, int]:
        """Bulk add of (collection, content, embedding, metadata, created_at, importance); ids in the order of ``order``. Returns the first id and the one after the last."""
        self._writable()
        self.flush()
        if df.where((F.col("embedding").isNotNull()) & (F.size("embedding") != self.dimension)).limit(1).count():
            raise DimensionMismatchError(f"an embedding does not have {self.dimension} components")
        first, seq = self._next_id, self._seq
        ided = numbered(df, [order], "id", first)
        names = [f.name for f in MEMORY_SCHEMA]
        none = F.lit(None)
        n = ided.count()
        if n:
            self._append(ided.select((F.col("id") - first + 1 + seq).alias("seq"), F.lit("add").alias("op"), "id", F.struct(*names).alias("memory"), none.alias("src"), none.alias("dst"), none.alias("relation")), seq + n)
            self._seq, self._next_id, self._usage = seq + n, first + n, None
            self.enforce_capacity()
        return first, first + n

    @_locked
    def upsert(self, batch: DataFrame) -> list[int]:
        """Replace and add rows by id; returns the ids refused (other content, no embedding)."""
        self._writable()
        self.flush()
        names = [f.name for f in MEMORY_SCHEMA]
        if batch.where(F.col("embedding").isNotNull() & (F.size("embedding") != self.dimension)).limit(1).count():
            raise DimensionMismatchError(f"an embedding does not have {self.dimension} components")
        table, rejected = mutations.upsert(self.memories(), batch)
        rejected = materialize(rejected, "rejected")
        taken = table.join(batch.select("id").distinct(), "id", "left_semi").join(rejected, "id", "left_anti")
        none, seq = F.lit(None), self._seq + 1
        self._append(taken.select(F.lit(seq).alias("seq"), F.lit("add").alias("op"), "id", F.struct(*names).alias("memory"), none.alias("src"), none.alias("dst"), none.alias("relation")), seq)
        self._seq, self._usage = seq, None
        self._next_id = max(self._next_id, (batch.agg(F.max("id")).collect()[0][0] or 0) + 1)
        self.enforce_capacity()
        return [r["id"] for r in rejected.collect()]

    @_locked
    def delete(self, mid: int) -> None:
        self._writable()
        self.flush()
        graph.require_node(self.memories(), mid)
        self._buffer("delete", mid)
        self._after()

    @_locked
    def connect(self, src: int, dst: int, relation: str) -> None:
        self._writable()
        self.flush()
        graph.require_connectable(self.memories(), src, dst)
        self._buffer("connect", src=src, dst=dst, relation=relation)
        self._after()

    @_locked
    def disconnect(self, src: int, dst: int) -> None:
        self._writable()
        self._buffer("disconnect", src=src, dst=dst)
        self._after()

    @_locked
    def apply_commands(self, commands: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Commit a batch of (op, id, memory, src, dst, relation), in the order of its ``seq``.

        ``batch`` names the source and the number of the batch; one that was
        committed before, or one before that, changes nothing.
        """
        self._writable()
        self.flush()
        if batch and batch[1] <= self._batches().get(batch[0], -1):
            return 0
        ordered = numbered(commands.withColumnRenamed("seq", "__given"), ["__given"], "seq", self._seq + 1)
        n = ordered.count()
        if n:
            self._append(ordered.drop("__given"), self._seq + n, batch)
            self._seq, self._usage = self._seq + n, None
            self._next_id = max(self._next_id, (commands.agg(F.max("id")).collect()[0][0] or 0) + 1)
            self.enforce_capacity()
        return n

    @_locked
    def enforce_capacity(self) -> EvictionReport:
        """Delete the oldest, least important memories until the limits hold, as one commit. What is known from the last scan and the adds since saves another scan."""
        if self.limit.max_entries is None and self.limit.max_bytes is None:
            return EvictionReport()
        if self._usage is None:
            r = capacity.usage(self.memories()).collect()[0]
            self._usage = r["entries"], r["bytes"]
        entries, size = self._usage
        report = EvictionReport(None, entries, entries, size, size)
        if (self.limit.max_entries is None or entries <= self.limit.max_entries) and (self.limit.max_bytes is None or size <= self.limit.max_bytes):
            return report
        none, seq = F.lit(None), self._seq + 1
        self._seq = seq
        gone = capacity.evicted(self.memories(), self.limit)
        # The ids stay readable as a table of their own: a checkpoint may fold the log and compact it away.
        report.table = materialize(gone, "evicted")
        self._append(report.table.select(F.lit(seq).alias("seq"), F.lit("delete").alias("op"), "id", none.cast(COMMAND_SCHEMA["memory"].dataType).alias("memory"), none.alias("src"), none.alias("dst"), none.alias("relation")), seq)
        after = capacity.usage(self.memories()).collect()[0]
        self._usage = report.entries_after, report.bytes_after = after["entries"], after["bytes"]
        self.last_eviction = report
        return report

    @_locked
    def checkpoint(self) -> int:
        """Write the folded tables as a new version and point to it. Older files stay for the snapshots that read them, until compact()."""
        self._writable()
        rows, self._pending = self._pending, []
        if rows:
            every, self.checkpoint_every, seconds, self.checkpoint_seconds = self.checkpoint_every, None, self.checkpoint_seconds, None
            self._append(self.spark.createDataFrame(rows, COMMAND_SCHEMA).coalesce(1), rows[-1][0])
            self.checkpoint_every, self.checkpoint_seconds, self._usage = every, seconds, None
        current, batches = self._current(), self._batches()
        seq = max([current["seq"], *self._log_ends()])
        s, version = self.snapshot(), current["version"] + 1
        base = f"{self.path}/v{version}"
        write_memories(s.memories, f"{base}/memories")
        s.edges.repartitionByRange("src", "dst").sortWithinPartitions("src", "dst").write.mode("overwrite").parquet(f"{base}/edges")
        self._write(f"_pointers/{version}", {"version": version, "seq": seq, "batches": batches})
        self._checkpointed = time.monotonic()
        return version

    @_locked
    def compact(self) -> int:
        """A checkpoint, without the versions and the log before it; returns the live rows. Older snapshots can no longer be read."""
        version = self.checkpoint()
        seq = self._current()["seq"]
        for n in self._log_ends():
            if n <= seq:
                fs_delete(self.spark, f"{self.path}/_log/{n:019d}")
        for name in fs_list(self.spark, f"{self.path}/_pointers"):
            if name.isdigit() and int(name) < version:
                fs_delete(self.spark, f"{self.path}/_pointers/{name}")
        for name in fs_list(self.spark, self.path):
            if name.startswith("v") and name[1:].isdigit() and int(name[1:]) < version:
                fs_delete(self.spark, f"{self.path}/{name}")
        return self.memories().count()

    @_locked
    def close(self) -> None:
        if not self.read_only:
            self.flush()
            self.unlock(self.spark, self.path)
            self.read_only = True

    def __len__(self) -> int:
        return self.memories().count()

    def __enter__(self) -> MemoryStore:
        return self

    def __exit__(self, *_) -> None:
        self.close()
