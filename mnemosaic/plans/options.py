"""Query options, the choice of a path, and intent. Plain Python, no Spark."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from enum import Enum

from ..errors import EmptyQueryError, InvalidMaxHopsError, InvalidTimeRangeError, InvalidTopKError, InvalidWeightsError
from ..functions.vector import strict_cosine


@dataclass(frozen=True)
class Weights:
    """Percentages of similarity, importance and recency."""

    similarity: int = 70
    importance: int = 20
    recency: int = 10

    @property
    def total(self) -> int:
        return self.similarity + self.importance + self.recency

    def checked(self) -> Weights:
        if self.total != 100:
            raise InvalidWeightsError(f"the weights add up to {self.total}, not 100")
        return self

    def parts(self) -> tuple[float, float, float]:
        """Shares, for weights that add up to 98 to 102 too."""
        if not 98 <= self.total <= 102:
            raise InvalidWeightsError(f"the weights add up to {self.total}, not to 98 to 102")
        return self.similarity / self.total, self.importance / self.total, self.recency / self.total


@dataclass(frozen=True)
class Anchors:
    """Vectors that stand for the meanings 'semantic', 'recent' and 'related'."""

    semantic: Sequence[float]
    recency: Sequence[float]
    graph: Sequence[float]


@dataclass(frozen=True)
class IntentPolicy:
    """Texts of the anchors, hop thresholds and the share of importance."""

    # Other texts give other anchors.
    semantic_text: str = "semantic meaning, similar content, concept match"
    recency_text: str = "recent events, latest updates, time, timeline, schedule"
    graph_text: str = "relationships, connections, linked people, social graph"
    two_hops: float = 0.55
    three_hops: float = 0.80
    importance: int = 20


@dataclass(frozen=True)
class Options:
    top_k: int = 10
    collection: str | None = None
    time_range: tuple[int, int] | None = None
    hops: int = 1
    candidate_multiplier: int | None = None  # None: the planner's
    weights: Weights = field(default_factory=Weights)
    metadata: dict[str, str] | None = None
    anchors: Anchors | None = None
    always_weighted: bool = False

    def checked(self) -> Options:
        if self.top_k < 1:
            raise InvalidTopKError(f"top_k must be at least 1, not {self.top_k}")
        if self.hops < 0:
            raise InvalidMaxHopsError(f"hops must not be {self.hops}")
        if self.time_range and self.time_range[0] > self.time_range[1]:
            raise InvalidTimeRangeError(f"the range begins at {self.time_range[0]} and ends at {self.time_range[1]}")
        self.weights.parts() if self.always_weighted else self.weights.checked()
        return self


class Path(Enum):
    VECTOR_ONLY = "vector_only"
    VECTOR_TEMPORAL = "vector_temporal"
    VECTOR_GRAPH = "vector_graph"
    WEIGHTED_HYBRID = "weighted_hybrid"


@dataclass(frozen=True)
class Plan:
    path: Path
    multiplier: int
    candidates: int
    ann_multiplier: int
    parallel: bool
    options: Options


def plan(options: Options, indexed: int) -> Plan:
    """The path by what the query asks for, and how many candidates it fetches."""
    options = options.checked()
    timed, linked = options.time_range is not None, options.hops > 0
    path = {(False, False): Path.VECTOR_ONLY, (True, False): Path.VECTOR_TEMPORAL, (False, True): Path.VECTOR_GRAPH, (True, True): Path.WEIGHTED_HYBRID}[timed, linked]
    multiplier = options.candidate_multiplier or 3 + timed + 2 * linked + (options.top_k > 50)
    w = options.weights
    if path is Path.WEIGHTED_HYBRID and (w.similarity, w.importance, w.recency) == (100, 0, 0):
        options = replace(options, weights=Weights())
    candidates = options.top_k * multiplier
    return Plan(path, multiplier, candidates, max(2 * multiplier, 7), indexed >= 10_000 or candidates >= 1_000, options)


@dataclass(frozen=True)
class Intent:
    weights: Weights
    hops: int


def infer_intent(q: Sequence[float], anchors: Anchors, two_hops: float = 0.55, three_hops: float = 0.80, importance: int = 20) -> Intent | None:
    """Weights and hops by how close a query is to each anchor; None if a vector does not fit."""
    if q is None or not len(q):
        raise EmptyQueryError("the query vector is empty")
    closeness = [strict_cosine(list(q), list(a)) for a in (anchors.semantic, anchors.recency, anchors.graph)]
    if any(c is None for c in closeness):
        return None
    s, r, g = (min(1.0, max(0.0, (c + 1) / 2)) for c in closeness)
    rest = 100 - min(100, max(0, importance))
    both = s + r
    similarity = int(rest * s / both + 0.5) if both > 0 else rest
    t2 = min(1.0, max(0.0, two_hops))
    t3 = max(t2, min(1.0, max(0.0, three_hops)))
    return Intent(Weights(similarity, 100 - rest, rest - similarity), 3 if g >= t3 else 2 if g >= t2 else 1)


def with_intent(options: Options, q: Sequence[float], policy: IntentPolicy | None = None, embed=None) -> Options:
    """Explicit anchors set weights and hops; a policy with an embedder does so only where they still are the defaults."""
    if options.anchors:
        intent = infer_intent(q, options.anchors)
        return replace(options, weights=intent.weights, hops=intent.hops) if intent else options
    if policy and embed:
        anchors = Anchors(*(embed(t) for t in (policy.semantic_text, policy.recency_text, policy.graph_text)))
        intent = infer_intent(q, anchors, policy.two_hops, policy.three_hops, policy.importance)
        if intent:
            options = replace(options, weights=intent.weights if options.weights == Weights() else options.weights, hops=intent.hops if options.hops else 0)
    return options
