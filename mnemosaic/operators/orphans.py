"""Problem 6: references to records that do not exist.

Direct orphans are references to a record that is missing, deleted or not yet
there at the time of the reference. Inherited ones follow by a fixpoint: what
refers to the owner of an orphaned reference is orphaned in turn, found by
semi-joins of each new level with the references until no level is new. All
queries read the result of this one cascade; direct orphans are its level 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import hot_keys, materialize, read_table, skew_safe_join
from ..sources.commands import log_commands, wal_commands
from .changefeed import COMMANDS_SQL

#: Commands of one id that are ordered in one task; ids with more are cut into blocks of command numbers.
COMMAND_BLOCK = 65_536


def edge_orphans(edges: DataFrame, memories: DataFrame, tombstones: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """(record_id, ref_field, ref_id, owner, recorded_at) of edges whose ``dst`` does not exist at their time.

    A memory exists from its first ``ingested_at`` until its first
    ``deleted_at``, ends included; so nothing exists at a null time. A null
    ``dst`` is no reference. Repeated rows count once. A very popular target
    does not gather its edges in one task.
    """
    refs = edges.where(F.col("dst").isNotNull()).select("edge_id", "src", F.col("dst").alias("ref_id"), "recorded_at").distinct()
    born = memories.where(F.col("id").isNotNull()).groupBy(F.col("id").alias("ref_id")).agg(F.min("ingested_at").alias("born"))
    died = tombstones.where(F.col("memory_id").isNotNull()).groupBy(F.col("memory_id").alias("ref_id")).agg(F.min("deleted_at").alias("died"))
    there = skew_safe_join(refs, born.join(died, "ref_id", "left"), "ref_id", hot_rows=hot_rows)
    missing = ~F.coalesce(F.col("born") <= F.col("recorded_at"), F.lit(False)) | F.coalesce(F.col("died") <= F.col("recorded_at"), F.lit(False))
    return there.where(missing).select(F.col("edge_id").alias("record_id"), F.lit("dst").alias("ref_field"), "ref_id", F.col("src").alias("owner"), "recorded_at")


def existed_before(refs: DataFrame, commands: DataFrame, block: int = COMMAND_BLOCK) -> DataFrame:
    """Add ``existed`` to refs (ref_id, command_id, ...): whether the last add or delete of ``ref_id`` before ``command_id`` was an add.

    An as-of join by equal keys: (id, block of command numbers) is ordered in
    one task, and the last effect before each block is carried into it. So an
    id with a third of all commands is spread over many tasks.
    """
    number = lambda c: F.floor(F.col(c) / block)
    effects = commands.where(F.col("op").isin("add", "delete") & F.col("id").isNotNull() & F.col("command_id").isNotNull())
    effects = effects.select(F.col("id").alias("ref_id"), "command_id", (F.col("command_id") * 2 + (F.col("op") == "add").cast("long")).alias("code"), number("command_id").alias("block"))
    asked = refs.withColumn("block", number("command_id"))
    ends = effects.groupBy("ref_id", "block").agg(F.max("code").alias("code"))
    stops = ends.unionByName(asked.select("ref_id", "block", F.lit(None).cast("long").alias("code"))).groupBy("ref_id", "block").agg(F.max("code").alias("code"))
    earlier = Window.partitionBy("ref_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = stops.withColumn("code", F.max("code").over(earlier)).where(F.col("code").isNotNull())
    given = [c for c in asked.columns if c not in ("ref_id", "command_id", "block")]
    row = F.struct(*given).alias("row") if given else F.struct(F.lit(1).alias("x")).alias("row")
    nothing = F.lit(None).cast(asked.select(row).schema["row"].dataType).alias("row")
    asked_rows = asked.select("ref_id", "block", "command_id", F.lit(None).cast("long").alias("code"), row)
    known = effects.select("ref_id", "block", "command_id", "code", nothing)
    before = carried.select("ref_id", "block", F.lit(None).cast("long").alias("command_id"), "code", nothing)
    order = Window.partitionBy("ref_id", "block").orderBy(F.col("command_id").asc_nulls_first(), F.col("code").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    seen = asked_rows.unionByName(known).unionByName(before).withColumn("last", F.max("code").over(order)).where(F.col("row").isNotNull())
    # Of rows with the same command the references come first (their code is null), so the command itself never counts.
    return seen.select("ref_id", "command_id", *(F.col(f"row.{c}").alias(c) for c in given), (F.coalesce(F.col("last") % 2, F.lit(0)) == 1).alias("existed"))


def log_orphans(log: DataFrame, commands: DataFrame, block: int = COMMAND_BLOCK) -> DataFrame:
    """(record_id, ref_field, ref_id, owner, recorded_at) of the ends of connect lines that do not exist just before the line.

    A null end is no reference; lines without a number can't be placed and are
    left out. Repeated lines count once, with their first ``recorded_at``.
    """
    lines = log.where((F.col("op") == "connect") & F.col("command_id").isNotNull())
    ends = F.explode(F.array(F.struct(F.lit("id1").alias("ref_field"), F.col("src").alias("ref_id")), F.struct(F.lit("id2").alias("ref_field"), F.col("dst").alias("ref_id")))).alias("e")
    refs = lines.select("command_id", F.col("src").alias("owner"), "recorded_at", ends).select("command_id", "owner", "recorded_at", "e.*").where(F.col("ref_id").isNotNull())
    refs = refs.groupBy("command_id", "ref_field", "ref_id").agg(F.min("recorded_at").alias("recorded_at"), F.max("owner").alias("owner"))
    found = existed_before(refs, commands, block).where(~F.col("existed"))
    return found.select(F.col("command_id").alias("record_id"), "ref_field", "ref_id", "owner", "recorded_at")


def cascade(references: DataFrame, direct: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """All orphaned references: those of ``direct`` with ``level`` 0, and the inherited ones with the length of the shortest chain that leads to a direct one.

    Both have record_id, ref_field, ref_id and owner. The owner of an orphaned
    reference is orphaned; a reference to an orphaned record is orphaned at the
    next level, unless its record has a direct orphan. Owners are found level by
    level, by semi-joins of the references with the newest level, one written
    table each; a cycle ends, as no owner is taken twice. Null owners pass
    nothing on. Repeated rows count once.
    """
    columns = ["record_id", "ref_field", "ref_id", "owner"]
    direct = materialize(direct.select(columns).distinct(), "direct")
    refs = references.where("owner IS NOT NULL AND ref_id IS NOT NULL").select(columns).distinct()
    refs = materialize(refs.join(direct.select("record_id").distinct(), "record_id", "left_anti"), "references")
    hot = hot_keys(refs, "ref_id", hot_rows)
    even = not hot.limit(1).count()  # asked once, not at each level
    meet = lambda left, right: left.join(right, "ref_id") if even else skew_safe_join(left, right, "ref_id", "inner", hot=hot)
    front = direct.where("owner IS NOT NULL").select(F.col("owner").alias("ref_id")).distinct()
    front = materialize(front.withColumn("level", F.lit(1)), "front")
    done = front
    while front.limit(1).count():
        hit = meet(refs.select("ref_id", "owner"), front)
        new = hit.groupBy(F.col("owner").alias("ref_id")).agg((F.first("level") + 1).alias("level"))
        front = materialize(new.join(done, "ref_id", "left_anti"), "front")
        done = done.unionByName(front)
    inherited = meet(refs, done)
    return direct.withColumn("level", F.lit(0)).unionByName(inherited.select(*columns, "level"))


# The two tables that refer to others go through one fixpoint: even numbers are those of edges and memories, odd ones those of the log.
_APART = ("record_id", "owner", "ref_id")


def _told_apart(df: DataFrame, odd: int) -> DataFrame:
    return df.select(*((F.col(c) * 2 + odd).alias(c) if c in _APART else F.col(c) for c in df.columns))


def orphan_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_name, record_id, ref_field, ref_id, owner, level, recorded_at) of all orphaned references of edges and of the log; recorded_at is the first of the record."""
    log = log_commands(spark, sf_dir)
    both = log.select("command_id", "op", "id").unionByName(wal_commands(spark, sf_dir).select("command_id", "op", "id"))
    edges = read_table(spark, sf_dir, "edges")
    columns = ["record_id", "ref_field", "ref_id", "owner"]
    missing = edge_orphans(edges, read_table(spark, sf_dir, "memories"), read_table(spark, sf_dir, "tombstones"))
    direct = _told_apart(missing.select(columns), 0).unionByName(_told_apart(log_orphans(log, both).select(columns), 1))
    of_edges = edges.select(F.col("edge_id").alias("record_id"), F.lit("dst").alias("ref_field"), F.col("dst").alias("ref_id"), F.col("src").alias("owner"), "recorded_at")
    of_log = log.where("op = 'connect'").select(F.col("command_id").alias("record_id"), F.lit("id2").alias("ref_field"), F.col("dst").alias("ref_id"), F.col("src").alias("owner"), "recorded_at")
    refs = _told_apart(of_edges, 0).unionByName(_told_apart(of_log, 1))
    times = refs.where("record_id IS NOT NULL").groupBy("record_id").agg(F.min("recorded_at").alias("recorded_at"))
    odd = F.pmod("record_id", F.lit(2))
    named = cascade(refs.select(columns), direct).join(times, "record_id", "left")
    back = [F.shiftright(c, 1).alias(c) for c in _APART]
    return named.select(F.when(odd == 0, "edges").otherwise("replay_log").alias("table_name"), back[0], "ref_field", back[2], back[1], "level", "recorded_at")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References without a record at that time: level 0 of the cascade."""
    return orphan_references(spark, sf_dir).where("level = 0").select("table_name", "record_id", "ref_field", "ref_id").distinct()


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with direct and with inherited orphan references, by table and month of ``recorded_at``."""
    records = orphan_references(spark, sf_dir).groupBy("table_name", "record_id").agg(F.min("level").alias("level"), F.first("recorded_at").alias("recorded_at"))
    return records.groupBy("table_name", F.date_format("recorded_at", "yyyy-MM").alias("month")).agg(F.count_if(F.col("level") == 0).alias("direct"), F.count_if(F.col("level") > 0).alias("inherited"))


def p6_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many references are orphaned at each level of the cascade, by table."""
    return orphan_references(spark, sf_dir).groupBy("table_name", "level").agg(F.count(F.lit(1)).alias("n"))


_DIRECT_SQL = rf"""
{COMMANDS_SQL},
edge_refs AS (SELECT DISTINCT edge_id, src, dst, recorded_at FROM edges WHERE dst IS NOT NULL),
direct_edges AS (SELECT e.* FROM edge_refs e LEFT JOIN (SELECT id, min(ingested_at) AS born FROM memories GROUP BY id) m ON m.id = e.dst
  LEFT JOIN (SELECT memory_id, min(deleted_at) AS died FROM tombstones GROUP BY memory_id) t ON t.memory_id = e.dst
  WHERE NOT coalesce(born <= recorded_at, false) OR coalesce(died <= recorded_at, false)),
connects AS (SELECT command_id, coalesce(id1, from_id) AS src, coalesce(id2, to_id) AS dst, recorded_at FROM replay_log WHERE lower(regexp_replace(op, '^\s+|\s+$', '', 'g')) = 'connect'),
ends AS (SELECT DISTINCT command_id, src, 'id1' AS ref_field, src AS ref_id FROM connects WHERE src IS NOT NULL UNION ALL SELECT DISTINCT command_id, src, 'id2', dst FROM connects WHERE dst IS NOT NULL),
timeline AS (SELECT ref_id AS id, command_id * 2 - 1 AS moment, NULL AS code, command_id, ref_field, src FROM ends UNION ALL SELECT DISTINCT id, code // 2 * 2, code, NULL, NULL, NULL FROM effects),
seen AS (SELECT *, max(code) OVER (PARTITION BY id ORDER BY moment ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last FROM timeline),
direct_log AS (SELECT DISTINCT command_id, ref_field, id AS ref_id, src FROM seen WHERE ref_field IS NOT NULL AND coalesce(last % 2, 0) = 0)"""

SQL = {
    "p6_found": f"""WITH {_DIRECT_SQL}
SELECT DISTINCT 'edges' AS table_name, edge_id AS record_id, 'dst' AS ref_field, dst AS ref_id FROM direct_edges
UNION ALL SELECT 'replay_log', command_id, ref_field, ref_id FROM direct_log""",
    "p6_report": f"""WITH {_DIRECT_SQL},
direct AS (SELECT DISTINCT 'edges' AS t, edge_id AS rec, src AS owner FROM direct_edges UNION SELECT 'replay_log', command_id, src FROM direct_log),
refs AS (SELECT DISTINCT 'edges' AS t, edge_id AS rec, src AS owner, dst AS ref FROM edges UNION SELECT 'replay_log', command_id, src, dst FROM connects),
other AS (SELECT * FROM refs r WHERE owner IS NOT NULL AND ref IS NOT NULL AND NOT EXISTS (SELECT 1 FROM direct d WHERE d.t = r.t AND d.rec = r.rec)),
bad AS (WITH RECURSIVE b AS (SELECT t, owner AS id FROM direct WHERE owner IS NOT NULL UNION SELECT o.t, o.owner FROM other o JOIN b ON b.t = o.t AND b.id = o.ref) SELECT * FROM b),
kinds AS (SELECT DISTINCT t, rec, 'direct' AS kind FROM direct UNION ALL SELECT DISTINCT o.t, o.rec, 'inherited' FROM other o JOIN bad ON bad.t = o.t AND bad.id = o.ref),
times AS (SELECT 'edges' AS t, edge_id AS rec, min(recorded_at) AS ts FROM edges GROUP BY edge_id UNION ALL SELECT 'replay_log', command_id, min(recorded_at) FROM connects GROUP BY command_id)
SELECT t AS table_name, strftime(ts, '%Y-%m') AS month, count(*) FILTER (kind = 'direct') AS direct, count(*) FILTER (kind = 'inherited') AS inherited FROM kinds JOIN times USING (t, rec) GROUP BY 1, 2""",
    "p6_levels": f"""WITH {_DIRECT_SQL},
direct AS (SELECT DISTINCT 'edges' AS t, edge_id AS rec, 'dst' AS field, dst AS ref, src AS owner FROM direct_edges UNION SELECT 'replay_log', command_id, ref_field, ref_id, src FROM direct_log),
refs AS (SELECT DISTINCT 'edges' AS t, edge_id AS rec, src AS owner, dst AS ref FROM edges UNION SELECT 'replay_log', command_id, src, dst FROM connects),
other AS (SELECT * FROM refs r WHERE owner IS NOT NULL AND ref IS NOT NULL AND NOT EXISTS (SELECT 1 FROM direct d WHERE d.t = r.t AND d.rec = r.rec)),
bad AS (WITH RECURSIVE b AS (SELECT DISTINCT t, owner AS id, 1 AS level FROM direct WHERE owner IS NOT NULL UNION SELECT o.t, o.owner, level + 1 FROM other o JOIN b ON b.t = o.t AND b.id = o.ref WHERE level < 40) SELECT t, id, min(level) AS level FROM b GROUP BY t, id)
SELECT t AS table_name, level::INT AS level, count(*) AS n FROM (SELECT t, 0 AS level FROM direct UNION ALL SELECT o.t, bad.level FROM other o JOIN bad ON bad.t = o.t AND bad.id = o.ref) GROUP BY ALL""",
}
