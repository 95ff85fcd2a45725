import pytest

pytest.importorskip("public_tokenizers")

from mnemosaic.llm import mixture as m  # noqa: E402

DOCS = "doc_id long, source string, text string, key string, target_share string"
WEIGHTS = "source string, target_share double, max_repeats int"


def mixed(spark, docs, weights, **options):
    mixture, shares = m.mix_sources(spark.createDataFrame([(*d, "k", "t") for d in docs], DOCS), spark.createDataFrame(weights, WEIGHTS), **options)
    return {r["doc_id"]: r for r in mixture.collect()}, {r["source"]: r for r in shares.collect()}


def test_shares_are_met_with_repeats(spark):
    docs = [(k, "big", "one two three four") for k in range(300)] + [(1000 + k, "Sm-all ", "one two three four") for k in range(30)]
    mixture, shares = mixed(spark, docs, [("big", 0.5, 1), ("sm_all", 0.5, 4), ("gone", 0.2, 3)])
    assert shares["gone"]["actual_share"] == 0 and shares["big"]["actual_share"] == pytest.approx(0.5, abs=0.01)
    assert shares["sm_all"]["mixed_tokens"] == 4 * 30 * 4 and shares["sm_all"]["most_copies"] == 4
    assert {r["copies"] for k, r in mixture.items() if k >= 1000} == {4}
    assert sum(r["n_tokens"] * r["copies"] for r in mixture.values()) == sum(s["mixed_tokens"] for s in shares.values())


def test_budgets_are_cut_within_half_a_document(spark):
    docs = [(k, "a" if k % 3 else "b", "word " * (1 + k % 7)) for k in range(400)]
    _, shares = mixed(spark, docs, [("a", 0.3, 2), ("b", 0.7, 5)], total_tokens=900)
    for s in shares.values():
        assert abs(s["mixed_tokens"] - s["budget_tokens"]) <= 4


def test_given_total_fills_up_from_other_sources():
    budgets = m.plan_budgets([("a", 0.5, 1, 100), ("b", 0.25, 1, 1000), ("c", 0.25, 1, 1000), ("d", 0.1, 3, 0), ("e", None, 3, 5), ("f", 0.3, None, 5)], 1000)
    assert budgets == {"a": 100, "b": 450, "c": 450}
    assert m.plan_budgets([]) == {}


def test_dirt(spark):
    docs = [(1, None, "x y"), (2, "a", None), (3, "a", ""), (4, "a", "x y"), (None, "a", "x y z"), (5, "zzz", "x"), (4, "a", "x y")]
    mixture, shares = mixed(spark, docs, [("a", 1.0, 2), ("a", 0.5, 9), (None, 0.2, 1)])
    assert set(mixture) == {4, None} and shares["a"]["actual_share"] == 1.0
    mixture, shares = mixed(spark, [], [("a", 1.0, 2)])
    assert mixture == {} and shares["a"]["actual_share"] == 0
    assert mixed(spark, docs, []) == ({}, {})


def test_one_source_with_nearly_all_rows_is_spread(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "'hot' AS source", "concat('word ', id) AS text")
    mixture, _ = m.mix_sources(docs, spark.createDataFrame([("hot", 1.0, 1)], WEIGHTS), total_tokens=3000)
    total = sum(r["n_tokens"] * r["copies"] for r in mixture.collect())
    assert abs(total - 3000) <= 4
