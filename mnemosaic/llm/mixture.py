"""Problem 8: mix sources to target weights.

Every document gets a hash-random key; the rows are range-sorted by source and
key, sizes are summed up over the whole order in two steps (inside each
partition, then over the few partition totals), and each source is cut where
its budget ends. A budget beyond the size of a source repeats it in whole
epochs, plus a cut one. The random keys spread even a source that holds most
rows over many partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import broadcast_if_below, materialize, read_table
from . import tokens

#: The weights are a table kept by hand; more rows than this are refused, as budgets are set on the driver.
MAX_SOURCES = 10_000


def source_key(source: Column) -> Column:
    """One spelling for each source: lower case, no outer blanks, _ for blanks and hyphens."""
    return F.regexp_replace(F.lower(F.regexp_replace(source, r"^\s+|\s+$", "")), r"[\s\-]+", "_")


def plan_budgets(weights: list[tuple[str, float, int, int]], total: int | None = None) -> dict[str, int]:
    """Budgets by source from (source, share, max_repeats, size).

    Without ``total`` the mixture is the largest in which every source that
    has documents meets its share. With it, a source that cannot fill its part
    gives all it has, and the others take the rest in proportion.
    """
    usable = {s: (w, r * n) for s, w, r, n in weights if w and w > 0 and r and r > 0 and n > 0}
    if not usable:
        return {}
    if total is None:
        whole = sum(w for w, _ in usable.values())
        total = int(min(cap * whole / w for w, cap in usable.values()))
    out: dict[str, int] = {}
    left = float(total)
    while usable:
        whole = sum(w for w, _ in usable.values())
        short = [s for s, (w, cap) in usable.items() if left * w / whole >= cap]
        if not short:
            out |= {s: round(left * w / whole) for s, (w, _) in usable.items()}
            break
        for s in short:
            out[s] = usable.pop(s)[1]
        left -= sum(out[s] for s in short)
    return out


def _running(df: DataFrame) -> DataFrame:
    """Add ``pid`` and ``before``: the partition, and the size of the rows of the same source before this one in it. Each partition is sorted by source."""
    schema = T.StructType([*df.schema.fields, T.StructField("pid", T.IntegerType(), False), T.StructField("before", T.LongType(), False)])
    at, size_at = df.columns.index("source"), df.columns.index("n_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, last, carry = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(at).dictionary_encode()
            index, names = codes.indices.to_numpy(), codes.dictionary.to_pylist()
            size = batch.column(size_at).to_numpy()
            before = np.cumsum(size) - size
            first = np.flatnonzero(np.append(True, index[1:] != index[:-1]))
            start = np.repeat(before[first], np.diff(np.append(first, len(index))))
            before = before - start
            if names[index[0]] == last:
                before[: first[1] if len(first) > 1 else len(index)] += carry
            last, carry = names[index[-1]], int(before[-1] + size[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(index), pid), pa.int32()), pa.array(before, pa.int64())], names=schema.names)

    return df.mapInArrow(run, schema)


def mix_sources(docs: DataFrame, weights: DataFrame, total_tokens: int | None = None, tokenizer: str = tokens.DEFAULT, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(mixture, shares): the documents of the mixture with their number of copies, and the shares reached.

    ``docs`` has doc_id, source and text, ``weights`` source, target_share and
    max_repeats. Each row of ``docs`` is a record of its own. Null or empty
    texts have no size and are left out, as are documents with a null source
    or one without weight. A weight without documents is reported with a share
    of 0; null or negative shares and repeats count as 0; the shares of several
    spellings of a source add up, and the largest max_repeats holds. The size of each
    source is within half a document of its budget. Empty tables give an empty
    mixture.
    """
    few = weights.limit(MAX_SOURCES + 1).collect()
    if len(few) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} weights")
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(r["source"], r["target_share"], r["max_repeats"]) for r in few if r["source"] is not None], "source string, target_share double, max_repeats int").select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    known = docs.select("doc_id", source_key(F.col("source")).alias("source"), "text").join(F.broadcast(wanted.select("source")), "source", "left_semi")
    sized = tokens.encode(known.select("doc_id", "source", "text"), keep=["doc_id", "source"], tokenizer=tokenizer, ids=None, count="n_tokens")
    sized = materialize(sized.where("n_tokens > 0").withColumn("key", F.xxhash64(F.lit(seed), "doc_id")), "sizes")
    sums = {r["source"]: r["n"] for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    plan = [(r["source"], r["target_share"], r["max_repeats"], sums.get(r["source"], 0)) for r in wanted.collect()]
    budgets = plan_budgets(plan, total_tokens)
    rows = [(s, w, r, n, budgets.get(s, 0), budgets.get(s, 0) // n if n else 0, budgets.get(s, 0) % n if n else 0) for s, w, r, n in plan]
    budget = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, available_tokens long, budget_tokens long, epochs long, rest long")

    ordered = sized.repartitionByRange("source", "key", "doc_id").sortWithinPartitions("source", "key", "doc_id")
    running = materialize(_running(ordered), "running")
    parts = running.groupBy("source", "pid").agg(F.sum("n_tokens").alias("part"))
    parts = parts.select("source", "pid", (F.sum("part").over(Window.partitionBy("source").orderBy("pid")) - F.col("part")).alias("offset"))
    placed = running.join(broadcast_if_below(parts, 100_000), ["source", "pid"]).join(F.broadcast(budget.select("source", "epochs", "rest")), "source")
    once_more = (F.col("offset") + F.col("before")) * 2 + F.col("n_tokens") <= F.col("rest") * 2
    mixture = placed.select("doc_id", "source", "n_tokens", (F.col("epochs") + F.when(once_more, 1).otherwise(0)).alias("copies")).where("copies > 0")

    reached = mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("most_copies"))
    shares = F.broadcast(budget).join(reached, "source", "left").select("source", "target_share", "max_repeats", "available_tokens", "budget_tokens", F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"))
    whole = F.sum("mixed_tokens").over(Window.partitionBy())
    shares = shares.withColumn("actual_share", F.when(whole > 0, F.col("mixed_tokens") / whole).otherwise(0.0))
    return mixture, shares


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs, read_table(spark, sf_dir, "source_weights"))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture, with their sizes in tokens and their copies."""
    return _mixed(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source."""
    return _mixed(spark, sf_dir)[1]


def p8_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each weight: whether its source is within its largest document of its budget, no document is used too often, and the budget is what the shares ask for."""
    mixture, shares = _mixed(spark, sf_dir)
    largest = mixture.groupBy("source").agg(F.max("n_tokens").alias("largest"))
    there = (F.col("available_tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    s = shares.join(largest, "source", "left")
    whole = s.where(there).agg(F.sum("budget_tokens").alias("all_tokens"), F.sum("target_share").alias("all_shares"))
    s = s.crossJoin(F.broadcast(whole))
    near = F.abs(F.col("mixed_tokens") - F.col("budget_tokens")) <= F.coalesce("largest", F.lit(0))
    asked = F.abs(F.col("budget_tokens") - F.when(there, F.col("all_tokens") * F.col("target_share") / F.col("all_shares")).otherwise(0)) <= 1
    return s.select("source", F.round("target_share", 9).alias("target_share"), near.alias("near"), (F.col("most_copies") <= F.col("max_repeats")).alias("capped"), asked.alias("asked"))


SQL = {
    "p8_check": r"SELECT regexp_replace(lower(regexp_replace(source, '^\s+|\s+$', '', 'g')), '[\s\-]+', '_', 'g') AS source, round(sum(target_share), 9) AS target_share, true AS near, true AS capped, true AS asked FROM source_weights WHERE source IS NOT NULL GROUP BY 1",
}
