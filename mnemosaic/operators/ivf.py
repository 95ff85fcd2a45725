"""Approximate search with an inverted file: k-means cells, a few of which are searched for each query."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vector import check_query, magnitude
from . import vector_search

FIT_ROWS = 50_000  # rows the centres are fitted on, or CELL_SAMPLE for each cell if that is more; every row is indexed
CELL_SAMPLE = 32
QUERIES_IN_TASK = 262_144  # queries of one cell that one task ranks at most
LEAST_PROBES = 8
PROBED_SHARE = 1 / 10  # of the cells; a fixed number of probes loses recall as the cells grow with the table


def default_probes(cells: int) -> int:
    """How many of ``cells`` are searched for a query that asks for no number."""
    return min(cells, max(LEAST_PROBES, math.ceil(cells * PROBED_SHARE)))


@dataclass
class InvertedFile:
    """Cells of unit vectors. ``rows`` is the base table with its ``cell``. Searches probe ``default_probes`` cells unless told otherwise."""

    centres: np.ndarray
    rows: DataFrame

    @classmethod
    def build(cls, memories: DataFrame, cells: int | None = None, seed: int = 42, fit_rows: int = FIT_ROWS) -> InvertedFile:
        base = memories.where("embedding IS NOT NULL").withColumn("__n", magnitude(F.col("embedding"))).where("__n > 0")
        n = base.count()
        cells = cells or max(1, round(n**0.5))
        fit_rows = max(fit_rows, CELL_SAMPLE * cells)
        unit = base.withColumn("__v", array_to_vector(F.transform("embedding", lambda x: x.cast("double") / F.col("__n"))))
        fit = unit.select("id", "__v").where((F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / float(1 << 20)) < min(1.0, fit_rows / max(n, 1)))
        model = KMeans(k=cells, seed=seed, featuresCol="__v", predictionCol="cell", maxIter=15).fit(fit)
        return cls(np.array(model.clusterCenters()), model.transform(unit).drop("__v", "__n"))

    def probe(self, q: Sequence[float], probes: int | None = None) -> list[int]:
        probes = default_probes(len(self.centres)) if probes is None else probes
        q = np.array(check_query(q))
        return np.argsort(((self.centres - q / np.linalg.norm(q)) ** 2).sum(1), kind="stable")[:probes].tolist()

    def search(self, q: Sequence[float], k: int, probes: int | None = None) -> DataFrame:
        """(id, score): exact scores within the nearest cells."""
        return vector_search.knn(self.rows.where(F.col("cell").isin(self.probe(q, probes))), q, k)

    def search_batch(self, queries: DataFrame, k: int, probes: int | None = None, block_rows: int = 50_000) -> DataFrame:
        """(query_id, id, score, rank) for each query (query_id, embedding): every query goes to its nearest cells, each cell is one matrix product.

        A cell with more than ``block_rows`` rows is searched in blocks by
        separate tasks.
        """
        centres, spark = self.centres, queries.sparkSession
        probes = min(default_probes(len(centres)) if probes is None else probes, len(centres))
        counts = {r["cell"]: r["count"] for r in self.rows.groupBy("cell").count().collect()}  # a row for each cell
        blocks = spark.createDataFrame([(c, -(-n // block_rows)) for c, n in counts.items()], "cell int, blocks int")

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lengths = (centres**2).sum(1)[None, :]
            for batch in batches:
                for a in range(0, batch.num_rows, 4096):
                    b = batch.slice(a, 4096)
                    fits, u = vector_search._unit_rows(b.column(1), centres.shape[1])
                    cells = np.argsort(lengths - 2 * u @ centres.T, axis=1, kind="stable")[:, :probes]
                    take = pa.array(np.repeat(fits, probes))
                    yield pa.RecordBatch.from_arrays([pa.array(cells.ravel(), pa.int32()), b.column(0).take(take), b.column(1).take(take)], names=["cell", "query_id", "embedding"])

        routed = queries.where("embedding IS NOT NULL").select("query_id", "embedding").mapInArrow(route, "cell int, query_id long, embedding array<float>")
        sized = F.broadcast(blocks)  # a row for each cell
        parts = max(1, -(-queries.count() // QUERIES_IN_TASK))
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        left = routed.join(sized, "cell").select("cell", every(F.col("blocks")).alias("block"), F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part"), "query_id", "embedding")
        right = self.rows.join(sized, "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), every(F.lit(parts)).alias("part"), "id", "embedding")
        found = left.groupBy("cell", "block", "part").cogroup(right.groupBy("cell", "block", "part")).applyInArrow(lambda asked, rows: vector_search.rank_tables(asked, rows, k), vector_search._SCORES)
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    def provider(self, probes: int | None = None):
        """This index as the source of candidates of a hybrid search."""
        return lambda base, q, k: vector_search.knn(base.join(self.rows.where(F.col("cell").isin(self.probe(q, probes))).select("id"), "id", "left_semi"), q, k)

    def stale(self, memories: DataFrame, limit: float = 0.2) -> bool:
        """Whether more than ``limit`` of the index is gone from the table or missing here, so that it should be built anew."""
        now = memories.where("embedding IS NOT NULL").select("id")
        changed = vector_search.difference(now, self.rows, "new", "gone").count()
        return changed > limit * max(1, self.rows.count())

    def save(self, path: str) -> None:
        """Centres and rows as Parquet, the rows by cell so that a search reads its cells only."""
        spark = self.rows.sparkSession
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(self.centres)], "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
        self.rows.repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> InvertedFile:
        centres = [r["centre"] for r in spark.read.parquet(f"{path}/centres").orderBy("cell").collect()]
        return cls(np.array(centres), spark.read.parquet(f"{path}/rows"))


def search_or_scan(index: InvertedFile | None, memories: DataFrame, q: Sequence[float], k: int, probes: int | None = None) -> DataFrame:
    """Search the index; without one, or if it is stale, scan the table."""
    if index is None or index.stale(memories):
        return vector_search.knn(memories, q, k)
    return index.search(q, k, probes)
