"""Searches within what a time range or the graph leaves: the filter comes before the ranking."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidWeightsError
from ..functions.vector import check_query, cosine, similarity_score, unit_interval
from ..runtime import materialize
from . import graph, temporal
from .vector_search import knn, knn_in_ids, top


@dataclass(frozen=True)
class RankingWeights:
    vector: int = 70
    recency: int = 20
    proximity: int = 10

    def checked(self) -> RankingWeights:
        if self.vector + self.recency + self.proximity != 100:
            raise InvalidWeightsError("the weights do not add up to 100")
        return self


def similar_in_range(memories: DataFrame, q: Sequence[float], start: int, end: int, k: int, strict: bool = False) -> DataFrame:
    inside = temporal.in_range(memories, start, end)
    return knn(temporal.require_rows(inside) if strict else inside, q, k)


def similar_connected(memories: DataFrame, edges: DataFrame, q: Sequence[float], origin: int, hops: int, k: int) -> DataFrame:
    return knn_in_ids(memories, q, graph.reachable(edges, memories, origin, hops), k)


def similar_in_range_connected(memories: DataFrame, edges: DataFrame, q: Sequence[float], start: int, end: int, origin: int, hops: int, k: int) -> DataFrame:
    both = temporal.in_range(memories, start, end).select("id").intersect(graph.reachable(edges, memories, origin, hops))
    return knn_in_ids(memories, q, both, k)


def weighted_in_range_connected(memories: DataFrame, edges: DataFrame, q: Sequence[float], start: int, end: int, origin: int, hops: int, k: int, weights: RankingWeights = RankingWeights()) -> DataFrame:
    """(id, score) by similarity, recency within the candidates, and closeness in hops."""
    w, q = weights.checked(), check_query(q)
    near = graph.bfs(edges, memories, origin, hops)
    inside = temporal.in_range(memories, start, end).where("embedding IS NOT NULL").join(near, "id")
    scored = inside.select("id", "created_at", similarity_score(cosine(F.col("embedding"), q)).alias("s"), unit_interval(1.0 - F.col("hops") / F.lit(float(max(hops, 1)))).alias("p"))
    scored = materialize(scored, "candidates")  # read twice below
    limits = scored.agg(F.min("created_at").alias("lo"), F.max("created_at").alias("hi"))
    scored = scored.crossJoin(F.broadcast(limits))
    recency = F.when(F.col("hi") == F.col("lo"), 1.0).otherwise((F.col("created_at") - F.col("lo")).cast("double") / (F.col("hi") - F.col("lo")).cast("double"))
    score = F.col("s") * (w.vector / 100) + recency * (w.recency / 100) + F.col("p") * (w.proximity / 100)
    return top(scored.select("id", score.alias("score")), k)
