"""Nearest-neighbour search over memories (id, collection, embedding, ...)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConfigError, InvalidTopKError, NoEmbeddingsError
from ..functions.vector import check_query, cosine, l2_score

PREFIX = 8
METRICS = {"cosine": cosine, "l2": l2_score}
QUERIES_AT_ONCE = 4_096
#: Queries that go to every task with the function at most (of 64 components: 17 MB), and memories of a block beyond that.
QUERIES_IN_TASKS = 32_768
ROWS_AT_ONCE = 65_536


def _check_k(k: int) -> None:
    if k < 1:
        raise InvalidTopKError(f"top_k must be at least 1, not {k}")


def scored(memories: DataFrame, q: Sequence[float], metric: str = "cosine") -> DataFrame:
    """Memories with an embedding, with their ``score``."""
    if metric not in METRICS:
        raise ConfigError(f"unknown metric {metric!r}")
    return memories.where("embedding IS NOT NULL").withColumn("score", METRICS[metric](F.col("embedding"), q))


def top(df: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k best rows; equal scores in the order of ids."""
    return df.orderBy(F.desc(score), "id").limit(k)


def knn(memories: DataFrame, q: Sequence[float], k: int, collection: str | None = None, metric: str = "cosine", validate: bool = False) -> DataFrame:
    """(id, score) of the k most similar memories, of one collection if given.

    With ``validate`` an index without any embedding is an error, as one scan
    has to find out; an unknown collection gives no rows. Fewer than k
    embeddings give as many rows as there are.
    """
    q = check_query(q)
    _check_k(k)
    if validate and not memories.where("embedding IS NOT NULL").limit(1).count():
        raise NoEmbeddingsError("no memory has an embedding")
    base = memories if collection is None else memories.where(F.col("collection") == collection)
    return top(scored(base, q, metric).select("id", "score"), k)


def knn_in_ids(memories: DataFrame, q: Sequence[float], ids: DataFrame, k: int) -> DataFrame:
    """The k most similar among the memories whose id is in ``ids``."""
    q = check_query(q)
    _check_k(k)
    return top(scored(memories.join(ids.select("id").distinct(), "id", "left_semi"), q).select("id", "score"), k)


def prefix_knn(memories: DataFrame, q: Sequence[float], k: int, multiplier: int = 7, prefix: int = PREFIX) -> DataFrame:
    """Candidates by the first components, then the k best of them by whole vectors."""
    q = check_query(q)
    _check_k(k)
    short = check_query(q[: min(prefix, len(q))])
    near = memories.where("embedding IS NOT NULL").withColumn("__near", cosine(F.slice("embedding", 1, len(short)), short))
    candidates = near.orderBy(F.desc("__near"), "id").limit(k * max(multiplier, 1))
    return top(scored(candidates, q).select("id", "score"), k)


def _best(s: np.ndarray, i: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest scores of each row; where equal scores cross the edge, those with the smallest ids."""
    keep = np.argpartition(-s, k - 1, axis=1)[:, :k]
    edge = np.take_along_axis(s, keep, 1).min(1, keepdims=True)
    tied = np.flatnonzero((s >= edge).sum(1) > k)
    if len(tied):
        keep[tied] = np.lexsort((i[tied], -s[tied]), axis=1)[:, :k]
    return keep


def _unit_rows(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have ``d`` components, and these with unit length (zero vectors stay zero)."""
    offsets = column.offsets.to_numpy()
    fits = np.flatnonzero(np.diff(offsets) == d)
    flat = column.values.to_numpy(zero_copy_only=False)
    x = flat[(offsets[:-1][fits][:, None] + np.arange(d)[None, :])].astype(np.float64)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return fits, np.divide(x, n, out=np.zeros_like(x), where=n > 0)


_SCORES = "query_id long, id long, score double"


def _score_table(query_ids: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> dict[str, pa.Array]:
    return {"query_id": pa.array(np.repeat(query_ids, scores.shape[1])), "id": pa.array(np.ascontiguousarray(ids).ravel()), "score": pa.array(scores.ravel())}


def _cut(s: np.ndarray, i: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if s.shape[1] <= k:
        return s, i
    keep = _best(s, i, k)
    return np.take_along_axis(s, keep, 1), np.take_along_axis(i, keep, 1)


def _scan_for(memories: DataFrame, ids: np.ndarray, matrix: np.ndarray, k: int) -> DataFrame:
    """Queries known to every task: one scan, nothing of the memories is shuffled; a task keeps k rows of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list = [None] * -(-len(ids) // QUERIES_AT_ONCE)
        for batch in batches:
            fits, x = _unit_rows(batch.column(1), matrix.shape[1])
            own = batch.column(0).to_numpy()[fits]
            for a in range(0, len(fits), 4096):
                for b in range(len(best)):
                    s = matrix[b * QUERIES_AT_ONCE : (b + 1) * QUERIES_AT_ONCE] @ x[a : a + 4096].T
                    i = np.broadcast_to(own[a : a + 4096], s.shape)
                    if best[b] is not None:
                        s, i = np.hstack([best[b][0], s]), np.hstack([best[b][1], i])
                    best[b] = _cut(s, i, k)
        for b, found in enumerate(best):
            if found is not None:
                yield pa.RecordBatch.from_pydict(_score_table(ids[b * QUERIES_AT_ONCE : (b + 1) * QUERIES_AT_ONCE], found[1], found[0]))

    return memories.mapInArrow(run, _SCORES)


def rank_tables(asked: pa.Table, some: pa.Table, k: int) -> pa.Table:
    """The k best rows of one table for each query of another, 512 queries at a time."""
    none = pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    if not asked.num_rows or not some.num_rows:
        return none
    q, rows = (pa.concat_arrays(t["embedding"].chunks) for t in (asked, some))
    kept, x = _unit_rows(q, len(q[0]))
    fits, y = _unit_rows(rows, len(q[0]))
    if not len(fits):
        return none
    ids, own = asked["query_id"].to_numpy()[kept], some["id"].to_numpy()[fits]
    out = []
    for a in range(0, len(ids), 512):
        s = x[a : a + 512] @ y.T
        s, i = _cut(s, np.broadcast_to(own, s.shape), k)
        out.append(pa.table(_score_table(ids[a : a + 512], i, s)))
    return pa.concat_tables(out)


def _meet_in_blocks(memories: DataFrame, queries: DataFrame, n: int, rows: int, k: int) -> DataFrame:
    """Any number of queries: blocks of queries meet blocks of memories, each pair in a task of its own."""
    qs, bs = -(-n // QUERIES_AT_ONCE), max(1, -(-rows // ROWS_AT_ONCE))

    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = queries.select(F.pmod(F.xxhash64("query_id"), F.lit(qs)).cast("int").alias("q"), every(bs).alias("b"), "query_id", "embedding")
    right = memories.select(F.pmod(F.xxhash64("id"), F.lit(bs)).cast("int").alias("b"), every(qs).alias("q"), "id", "embedding").select("q", "b", "id", "embedding")
    return left.groupBy("q", "b").cogroup(right.groupBy("q", "b")).applyInArrow(lambda asked, some: rank_tables(asked, some, k), _SCORES)


def knn_batch(memories: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank) of the k most similar memories of each query (query_id, embedding); all queries need one length.

    Up to QUERIES_IN_TASKS queries go to every task with the function, and the
    table is scanned once, each block of queries as one matrix product per batch
    of memories. More queries than that meet the memories block by block in
    tasks of their own, so neither the driver nor a task holds them all.
    """
    _check_k(k)
    asked = queries.where("embedding IS NOT NULL").select("query_id", "embedding")
    rows = memories.where("embedding IS NOT NULL").select("id", "embedding")
    some = asked.limit(QUERIES_IN_TASKS + 1).toArrow()
    if not some.num_rows:
        return memories.sparkSession.createDataFrame([], _SCORES + ", rank int")
    if some.num_rows <= QUERIES_IN_TASKS:
        column = some["embedding"].combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
        fits, matrix = _unit_rows(column, len(column[0]))
        out = _scan_for(rows, some["query_id"].to_numpy()[fits].astype(np.int64), matrix, k)
    else:
        out = _meet_in_blocks(rows, asked, asked.count(), rows.count(), k)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def recall(exact: DataFrame, approximate: DataFrame, k: int) -> DataFrame:
    """One row: the share of exact (query_id, id) pairs that the approximate result has."""
    hits = exact.select("query_id", "id").join(approximate.select("query_id", "id").withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return hits.agg(F.countDistinct("query_id").alias("queries"), (F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1))).alias("recall"))


def live(memories: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Memories whose id is not among the deleted ones."""
    return memories.join(tombstones.select("id").distinct(), "id", "left_anti")


def stale_share(memories: DataFrame, tombstones: DataFrame, limit: float = 0.2) -> DataFrame:
    """(collection, live, deleted, compactable): a collection is worth rewriting when more than ``limit`` of its rows are deleted."""
    gone = tombstones.select("id").distinct().withColumn("gone", F.lit(1))
    marked = memories.select("id", "collection").join(gone, "id", "left")
    counted = marked.groupBy("collection").agg(F.count_if(F.col("gone").isNull()).alias("live"), F.count("gone").alias("deleted"))
    return counted.withColumn("compactable", F.col("deleted") / (F.col("live") + F.col("deleted")) > limit)


def difference(a: DataFrame, b: DataFrame, only_a: str, only_b: str) -> DataFrame:
    """(id, side) of the ids that only one of two sets has; no rows if they are equal."""
    a, b = a.select("id").distinct(), b.select("id").distinct()
    return a.join(b, "id", "left_anti").withColumn("side", F.lit(only_a)).unionByName(b.join(a, "id", "left_anti").withColumn("side", F.lit(only_b)))
