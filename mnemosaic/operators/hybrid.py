"""Hybrid search: similarity, filters, graph expansion and weighted ranking in one plan, of which only the candidates are written out."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vector import check_query, similarity_score, unit_interval
from ..plans.options import IntentPolicy, Options, Path, Plan, plan, with_intent
from ..runtime import materialize
from . import graph
from .vector_search import METRICS, top

#: (memories, query, k) -> (id, score): a source of candidates.
Provider = Callable[[DataFrame, Sequence[float], int], DataFrame]

HALF_LIFE = 30 * 86_400
BOOST = 0.2
NEIGHBOUR_SHARE = 0.9


@dataclass
class Search:
    """The hits as a lazy table, the plan that made them, and the table after each stage."""

    hits: DataFrame
    plan: Plan
    stages: dict[str, DataFrame]

    def trace(self) -> dict[str, int]:
        """Rows after each stage; each count is a job."""
        return {name: df.count() for name, df in self.stages.items()}

    def metrics(self) -> dict:
        """What the search asked for and gave, and the seconds of the job that ran it."""
        began = time.monotonic()
        n = self.hits.count()
        return {"path": self.plan.path.value, "parallel": self.plan.parallel, "candidates": self.plan.candidates, "hits": n, "results": n, "elapsed_seconds": time.monotonic() - began}


def metadata_matches(wanted: dict[str, str] | None) -> Column:
    """Every wanted key is there with just that value."""
    match = F.lit(True)
    for key, value in (wanted or {}).items():
        match = match & F.coalesce(F.try_element_at("metadata", F.lit(key)) == value, F.lit(False))
    return match


def _ranked(candidates: DataFrame, p: Plan) -> DataFrame:
    o = p.options
    df = candidates.select("id", similarity_score(F.col("cos")).alias("similarity_score"), unit_interval(F.col("importance").cast("double")).alias("importance_score"), "created_at")
    weighted = o.always_weighted or p.path is Path.WEIGHTED_HYBRID
    # Recency is relative to the candidates: one row of bounds, not a window over all rows in one task. Both uses read what is written once.
    df = materialize(df, "candidates")
    limits = df.agg(F.min("created_at").alias("lo"), F.max("created_at").alias("hi"))
    df = df.crossJoin(F.broadcast(limits))
    age = (F.col("created_at") - F.col("lo")).cast("double") / (F.col("hi") - F.col("lo")).cast("double")
    df = df.withColumn("recency_score", F.when(F.col("hi") == F.col("lo"), 1.0).otherwise(age))
    a, b, c = o.weights.parts() if o.always_weighted else (o.weights.similarity / 100, o.weights.importance / 100, o.weights.recency / 100)
    final = F.col("similarity_score") * a + F.col("importance_score") * b + F.col("recency_score") * c if weighted else F.col("similarity_score")
    df = df.select("id", final.alias("final_score"), "similarity_score", "importance_score", "recency_score")
    order = [F.desc("final_score"), F.desc("similarity_score"), "id"] if o.always_weighted else [F.desc("final_score"), "id"]
    return df.orderBy(*order).limit(o.top_k)


def search(memories: DataFrame, edges: DataFrame | None, q: Sequence[float], options: Options = Options(), indexed: int = 0, policy: IntentPolicy | None = None, embed=None, provider: Provider | None = None, metric: str = "cosine") -> Search:
    """(id, final_score, similarity_score, importance_score, recency_score), the best ``top_k``.

    The filters on time and metadata come after the choice of candidates, so
    fewer hits may come out than rows match. Expansion replaces the candidates
    by what they reach (themselves included); the time range is not asked of
    what was reached. Rows without embedding never come out. A ``provider``
    chooses the candidates in place of an exact scan. ``metric`` is what they are
    scored by.
    """
    q = check_query(q)
    p = plan(with_intent(options, q, policy, embed), indexed)
    o = p.options
    base = memories.where("embedding IS NOT NULL")
    if o.collection is not None:
        base = base.where(F.col("collection") == o.collection)
    similar = lambda df: df.withColumn("cos", METRICS[metric](F.col("embedding"), q))
    if provider is None:
        scored = similar(base).orderBy(F.desc("cos"), "id").limit(p.candidates)
    else:
        scored = similar(base.join(provider(base, q, p.candidates).select("id"), "id", "left_semi"))
    kept = scored.where(metadata_matches(o.metadata))
    if o.time_range:
        kept = kept.where(F.col("created_at").between(*o.time_range))
    stages = {"scored": scored, "filtered": kept}
    candidates = kept
    if o.hops and edges is not None:
        inside = edges if o.collection is None else graph.within(edges, memories.where(F.col("collection") == o.collection))
        reached = graph.reach(inside, kept, o.hops)
        candidates = similar(base.where(metadata_matches(o.metadata)).join(reached.select("id"), "id", "left_semi"))
        stages["expanded"] = candidates
    hits = _ranked(candidates, p)
    stages["ranked"] = hits
    return Search(hits, p, stages)


def facade_search(memories: DataFrame, edges: DataFrame, q: Sequence[float], k: int, collection: str | None = None, metadata: dict[str, str] | None = None, provider: Provider | None = None, **options) -> DataFrame:
    """(id, score) of the simple call: one hop, no time range. In a collection four times as many are fetched first. ``options``: policy, embed and metric, as in ``search``."""
    if collection is None:
        return search(memories, edges, q, Options(top_k=k, metadata=metadata), provider=provider, **options).hits.select("id", F.col("final_score").alias("score"))
    found = search(memories, edges, q, Options(top_k=4 * k, collection=collection, metadata=metadata), provider=provider, **options).hits
    inside = memories.where(F.col("collection") == collection).select("id")
    return top(found.select("id", F.col("final_score").alias("score")).join(inside, "id", "left_semi"), k)


def graph_boost(hits: DataFrame, edges: DataFrame, memories: DataFrame | None = None, collections: list[str] | None = None) -> DataFrame:
    """Hits and their out-neighbours, which have 0.9 of the hit's score if that is more than their own."""
    linked = hits.select(F.col("id").alias("src"), (F.col("score") * NEIGHBOUR_SHARE).alias("score")).join(edges, "src").select(F.col("dst").alias("id"), F.greatest(F.col("score"), F.lit(0.0)).alias("score"))
    if collections and memories is not None:
        linked = linked.join(memories.where(F.col("collection").isin(collections)).select("id"), "id", "left_semi")
    return hits.select("id", "score").unionByName(linked).groupBy("id").agg(F.max("score").alias("score"))


def recency_boost(hits: DataFrame, memories: DataFrame, now: int) -> DataFrame:
    """Up to a fifth more for new memories, half of that for each 30 days of age."""
    age = F.greatest(F.lit(0), F.lit(now) - F.col("created_at"))
    boosted = F.col("score") * (1.0 + BOOST * F.pow(F.lit(0.5), age / F.lit(float(HALF_LIFE))))
    return hits.join(memories.select("id", "created_at"), "id", "left").select("id", F.coalesce(boosted, "score").alias("score"))


def client_search(memories: DataFrame, edges: DataFrame, q: Sequence[float], limit: int = 5, collections: list[str] | None = None, metadata: dict[str, str] | None = None, use_graph: bool = False, recency_bias: bool = False, now: int = 0, provider: Provider | None = None, **options) -> DataFrame:
    """(id, score): search each collection, merge, boost, sort, cut."""
    if collections is None:
        hits = facade_search(memories, edges, q, limit, None, metadata, provider, **options)
    else:
        parts = [facade_search(memories, edges, q, limit, c, metadata, provider, **options) for c in dict.fromkeys(collections)]
        hits = parts[0]
        for part in parts[1:]:
            hits = hits.unionByName(part)
        hits = top(hits.groupBy("id").agg(F.max("score").alias("score")), limit) if len(parts) > 1 else hits
    if use_graph:
        hits = graph_boost(materialize(hits, "hits"), edges, memories, collections)
    if recency_bias:
        hits = recency_boost(hits, memories, now)
    return top(hits, limit)
