"""Problem 4: apply a feed of inserts, updates and deletes, repeated and out of order.

A table is split into buckets by a hash of its key. A batch of changes is
reduced to the last one of each key, routed to the buckets, and sort-merged
with those buckets only; they are written anew, and a new manifest names the
files of every bucket. Readers see one manifest, so a batch is there wholly or
not at all.

The hash is Spark's own bucketing, so the base is read as it lies: each task
scans one bucket, and only the changes are shuffled. The number of buckets is
doubled when their mean size outgrows ``ROWS_PER_BUCKET``; each old bucket is
then written as several new ones where it was read, still without a shuffle.

Deleted keys stay as tombstones with the number of their deletion, so a change
that arrives late cannot bring back what a later one removed.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import bucketed_files, fs_create_once, fs_delete, fs_list, fs_text, materialize, scratch_path
from ..sources.commands import log_commands, wal_commands

ROWS_PER_BUCKET = 250_000
LEAST_BUCKETS = 16
_BUCKET_OF = re.compile(r"_(\d+)(?:\..*)?$")  # how Spark names the files of a bucket


@dataclass(frozen=True)
class Manifest:
    """Files of each bucket, below the table's path, and how many rows (tombstones too) they hold."""

    version: int
    n_buckets: int
    rows: int
    schema: T.StructType
    buckets: dict[int, list[str]]


def last_changes(changes: DataFrame, key: str, seq: str, payload: list[str]) -> DataFrame:
    """The last effective change of each key: key, seq, deleted and payload.

    ``changes`` has op (add or delete; anything else has no effect). A change
    with a null key or seq has no effect. Copies of a change count once; where
    their payloads differ, the greatest holds. A key with any number of
    changes is reduced by partial maxima before the one shuffle.
    """
    effective = changes.where(F.col("op").isin("add", "delete") & F.col(key).isNotNull() & F.col(seq).isNotNull())
    added = F.col("op") == "add"
    change = F.struct((F.col(seq) * 2 + added.cast("long")).alias("__code"), *(F.when(added, F.col(c)).alias(c) for c in payload))
    last = effective.groupBy(key).agg(F.max(change).alias("__c"))
    # The shift is a floor division also for negative numbers.
    return last.select(key, F.shiftright("__c.__code", 1).alias(seq), (F.col("__c.__code") % 2 == 0).alias("deleted"), *(F.col(f"__c.{c}").alias(c) for c in payload))


class BucketedTable:
    """A copy-on-write table below ``path``."""

    def __init__(self, spark: SparkSession, path: str, key: str, seq: str, rows_per_bucket: int = ROWS_PER_BUCKET):
        self.spark, self.path, self.key, self.seq, self.rows_per_bucket = spark, path.rstrip("/"), key, seq, rows_per_bucket

    # Manifests ------------------------------------------------------------

    def _manifest_path(self, version: int) -> str:
        return f"{self.path}/_manifests/{version:012d}.json"

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in fs_list(self.spark, f"{self.path}/_manifests") if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> Manifest | None:
        if version is None:
            version = max(self.versions(), default=None)
        if version is None:
            return None
        m = json.loads(fs_text(self.spark, self._manifest_path(version)))
        return Manifest(m["version"], m["n_buckets"], m["rows"], T.StructType.fromJson(m["schema"]), {int(b): files for b, files in m["buckets"].items()})

    def _commit(self, m: Manifest) -> None:
        """Put the manifest in place whole, or not at all if that version is there: then another writer was first."""
        text = json.dumps({"version": m.version, "n_buckets": m.n_buckets, "rows": m.rows, "schema": m.schema.jsonValue(), "buckets": m.buckets})
        if not fs_create_once(self.spark, self._manifest_path(m.version), text):
            raise RuntimeError(f"version {m.version} was committed by another writer")

    # Data -----------------------------------------------------------------

    def read(self, version: int | None = None, tombstones: bool = False) -> DataFrame:
        """The rows of a version, the newest by default."""
        m = self.manifest(version)
        if m is None:
            raise ValueError("the table has no version yet")
        paths = [f"{self.path}/{f}" for files in m.buckets.values() for f in files]
        rows = self.spark.read.schema(m.schema).parquet(*paths) if paths else self.spark.createDataFrame([], m.schema)
        return rows if tombstones else rows.where("NOT deleted").drop("deleted")

    def _enough(self, buckets: int, rows: int) -> int:
        """``buckets``, doubled until they hold ``rows``."""
        while rows > buckets * self.rows_per_bucket:
            buckets *= 2
        return buckets

    def _merge(self, m: Manifest, net: DataFrame, touched: set[int]) -> DataFrame:
        """The rows of the touched buckets with the changes, each key from whichever is newer, and whether it is ``added``. The buckets are scanned as they lie."""
        files = [f"{self.path}/{f}" for b in sorted(touched) for f in m.buckets.get(b, ())]
        base = bucketed_files(self.spark, m.schema, files, m.n_buckets, self.key)
        names = [c for c in net.columns if c != self.key]
        left, right = base.select(self.key, F.struct(*names).alias("b")), net.select(self.key, F.struct(*names).alias("c"))
        both = left.join(right.hint("merge"), self.key, "full")
        newer = F.when(F.col("c").isNull() | (F.col(f"b.{self.seq}") > F.col(f"c.{self.seq}")), F.col("b")).otherwise(F.col("c"))
        return both.select(self.key, newer.alias("x"), F.col("b").isNull().alias("added")).select(self.key, *(F.col(f"x.{c}").alias(c) for c in names), "added")

    def _write(self, rows: DataFrame, buckets: int) -> dict[int, list[str]]:
        """New files of each bucket. The name in the catalog serves the writing only and goes at once; the files stay."""
        where, name = f"data/{uuid.uuid4().hex}", f"writing_{uuid.uuid4().hex}"
        rows.write.format("parquet").bucketBy(buckets, self.key).sortBy(self.key).option("path", f"{self.path}/{where}").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")
        out: dict[int, list[str]] = {}
        for f in sorted(fs_list(self.spark, f"{self.path}/{where}")):
            if f.endswith(".parquet") and (m := _BUCKET_OF.search(f.split(".")[0])):
                out.setdefault(int(m[1]), []).append(f"{where}/{f}")
        return out

    def apply(self, changes: DataFrame, payload: list[str]) -> Manifest:
        """Apply a batch and commit it as a new version; a batch without effect commits none.

        Changes are applied by their number, not by their arrival: one that is
        older than what the table holds for its key is dropped.
        """
        net = materialize(last_changes(changes, self.key, self.seq, payload), "changes")
        old, n = self.manifest(), net.count()
        if not n and old:
            return old
        schema = old.schema if old else T.StructType([T.StructField(f.name, f.dataType, True) for f in net.schema])
        if [f.name for f in schema] != net.columns:
            raise ValueError(f"the table has other columns: {schema.names}")
        buckets = self._enough(old.n_buckets if old else LEAST_BUCKETS, n + (old.rows if old else 0))
        kept: dict[int, list[str]] = {}
        if old:
            touched = set(old.buckets)
            if buckets == old.n_buckets:  # else all are written anew
                touched = {r[0] for r in net.select(F.pmod(F.hash(self.key), F.lit(buckets))).distinct().collect()}  # a number for each bucket
                kept = {b: f for b, f in old.buckets.items() if b not in touched}
            merged = self._merge(old, net, touched)
        else:
            merged = net.repartition(buckets, self.key).withColumn("added", F.lit(True))
        seen = Observation()
        written = self._write(merged.observe(seen, F.count_if("added").alias("added")).select(*net.columns), buckets) if n else {}
        rows = (old.rows if old else 0) + (seen.get["added"] if n else 0)
        m = Manifest(old.version + 1 if old else 1, buckets, rows, schema, kept | written)
        self._commit(m)
        return m

    def vacuum(self, keep: int = 1) -> list[int]:
        """Drop all but the last ``keep`` versions and the files that only they name."""
        versions = self.versions()
        kept, gone = versions[-keep:], versions[:-keep]
        named = lambda vs: {f for v in vs for files in self.manifest(v).buckets.values() for f in files}
        needed, dropped = named(kept), named(gone)
        live = {f.rsplit("/", 1)[0] for f in needed}
        for d in {f.rsplit("/", 1)[0] for f in dropped} - live:
            fs_delete(self.spark, f"{self.path}/{d}")
        for f in dropped - needed:
            if f.rsplit("/", 1)[0] in live:
                fs_delete(self.spark, f"{self.path}/{f}")
        for v in gone:
            fs_delete(self.spark, self._manifest_path(v))
        return gone


PAYLOAD = ["collection", "text"]


def rebuild(spark: SparkSession, sf_dir: str) -> BucketedTable:
    """The recorded database after all commands: the replay log is one batch, the log reads a second that overlaps it and is older in part."""
    table = BucketedTable(spark, scratch_path(spark, "recorded"), "id", "command_id")
    columns = ["op", "id", "command_id", *PAYLOAD]
    table.apply(log_commands(spark, sf_dir).select(columns), PAYLOAD)
    table.apply(wal_commands(spark, sf_dir).select(columns), PAYLOAD)
    return table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids that exist after all commands, and the command each stems from."""
    return rebuild(spark, sf_dir).read().select("id", "command_id")


def p4_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recorded database after all commands, with collection and text."""
    return rebuild(spark, sf_dir).read().select("id", "command_id", "collection", "text")


COMMANDS_SQL = r"""
all_commands AS (
  SELECT command_id, lower(regexp_replace(op, '^\s+|\s+$', '', 'g')) AS op, id, collection, text FROM replay_log
  UNION ALL SELECT x.command_id, lower(regexp_replace(x.op, '^\s+|\s+$', '', 'g')), x.id, x.collection, x.text FROM (SELECT unnest(commands) AS x FROM wal_reads)),
effects AS (SELECT id, command_id * 2 + (op = 'add')::INT AS code, collection, text FROM all_commands WHERE op IN ('add', 'delete') AND id IS NOT NULL AND command_id IS NOT NULL)"""

SQL = {
    "p4_found": f"WITH {COMMANDS_SQL}, last AS (SELECT id, max(code) AS code FROM effects GROUP BY id) SELECT id, (code // 2)::BIGINT AS command_id FROM last WHERE code % 2 = 1",
    "p4_state": f"""WITH {COMMANDS_SQL}, last AS (SELECT id, max(code) AS code FROM effects GROUP BY id),
p AS (SELECT e.id, e.code, collection, text, row_number() OVER (PARTITION BY e.id ORDER BY collection DESC NULLS LAST, text DESC NULLS LAST) AS r FROM effects e JOIN last USING (id, code) WHERE code % 2 = 1)
SELECT id, (code // 2)::BIGINT AS command_id, collection, text FROM p WHERE r = 1""",
}
