import pytest

from mnemosaic import errors
from mnemosaic.functions.vector import check_query, strict_cosine
from mnemosaic.plans.options import Anchors, IntentPolicy, Options, Path, Weights, infer_intent, plan, with_intent


def test_paths_and_multipliers():
    p = plan(Options(hops=0), 100)
    assert (p.path, p.multiplier, p.candidates, p.parallel) == (Path.VECTOR_ONLY, 3, 30, False)
    p = plan(Options(hops=2, time_range=(0, 1)), 15_000)
    assert p.path is Path.WEIGHTED_HYBRID and p.multiplier == 6 and p.parallel and p.ann_multiplier == 12
    assert plan(Options(hops=0, time_range=(0, 1)), 1).path is Path.VECTOR_TEMPORAL
    assert plan(Options(top_k=60), 1).multiplier == 6
    assert plan(Options(top_k=200), 1).parallel


def test_default_weights_replace_pure_similarity_on_the_weighted_path():
    assert plan(Options(time_range=(0, 1), weights=Weights(100, 0, 0)), 1).options.weights == Weights()
    assert plan(Options(hops=0, weights=Weights(100, 0, 0)), 1).options.weights == Weights(100, 0, 0)


@pytest.mark.parametrize("weights", [Weights(80, 15, 15), Weights(40, 40, 40), Weights(70, 19, 10)])
def test_weights_must_add_up(weights):
    with pytest.raises(errors.InvalidWeightsError):
        plan(Options(weights=weights), 1)


@pytest.mark.parametrize("weights", [Weights(70, 19, 10), Weights(71, 20, 10)])
def test_tolerant_weights(weights):
    assert sum(plan(Options(weights=weights, always_weighted=True), 1).options.weights.parts()) == pytest.approx(1)


@pytest.mark.parametrize("options, error", [(Options(top_k=0), errors.InvalidTopKError), (Options(time_range=(2, 1)), errors.InvalidTimeRangeError), (Options(hops=-1), errors.InvalidMaxHopsError)])
def test_bad_options(options, error):
    with pytest.raises(error):
        plan(options, 1)


def test_intent():
    anchors = Anchors([1, 0, 0], [0, 1, 0], [0, 0, 1])
    i = infer_intent([0, 0.8, 0.6], anchors)
    assert i.weights == Weights(29, 20, 51) and i.hops >= 2
    assert infer_intent([1, 0], anchors) is None
    assert with_intent(Options(anchors=anchors), [0, 0.8, 0.6]).weights == Weights(29, 20, 51)
    kept = with_intent(Options(weights=Weights(60, 30, 10), hops=0), [0, 0.8, 0.6], IntentPolicy(), lambda t: [1.0, 0.0, 0.0])
    assert kept.weights == Weights(60, 30, 10) and kept.hops == 0


def test_strict_cosine_and_query_errors():
    assert strict_cosine([1, 0], [0, 1]) == 0 and strict_cosine([1], [1, 2]) is None and strict_cosine([0, 0], [1, 0]) is None
    for q, e in (([], errors.EmptyQueryError), ([0, 0], errors.ZeroVectorError)):
        with pytest.raises(e):
            check_query(q)
    with pytest.raises(errors.DimensionMismatchError):
        check_query([1, 2], 3)


def test_predicates_reach_the_scan(spark, small):
    from mnemosaic.plans import catalog

    def scan(name):
        plan = catalog.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        return [line for line in plan.splitlines() if "FileScan" in line and "created_at" in line or "embedding" in line and "FileScan" in line or "PartitionFilters" in line]

    time = scan("time_range")
    assert len(time) == 1 and "GreaterThanOrEqual(created_at" in time[0] and "LessThanOrEqual(created_at" in time[0] and "content" not in time[0]
    for name in ("scan_collection", "vec_knn_collection", "filter_meta_time_coll"):
        assert any("PartitionFilters: [(coalesce(collection" in line for line in scan(name)), name
    assert "embedding" not in scan("scan_collection")[0]
    assert any("EqualTo(src," in line for line in scan("graph_neighbors"))
