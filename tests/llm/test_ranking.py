import numpy as np
import pyarrow as pa
import pytest

from mnemosaic.llm import ranking as k


def dense(scores, damping=k.DAMPING, steps=k.STEPS):
    """The walk with its whole matrix."""
    n = len(scores[0])
    p = np.zeros((n, n))
    for s in scores:
        v = np.where(np.isnan(s), -np.inf, s)
        up = (v[None, :] >= v[:, None]).astype(float)
        p += up / up.sum(1, keepdims=True) / len(scores)
    mass = np.full(n, 1 / n)
    for _ in range(steps):
        mass = (1 - damping) / n + damping * mass @ p
    return mass


def random_scores(rng, n):
    scores = [rng.normal(size=n) * 1000, rng.integers(0, 3, n).astype(float), rng.exponential(size=n)]
    for s in scores:
        s[rng.random(n) < 0.1] = np.nan
    return scores


def test_equals_the_dense_walk():
    rng = np.random.default_rng(0)
    sizes = [1, 2, 30, 7]
    parts = [random_scores(rng, n) for n in sizes]
    query = np.repeat(np.arange(4), sizes)
    got = k.visits(query, [np.concatenate([p[c] for p in parts]) for c in range(3)])
    assert got == pytest.approx(np.concatenate([dense(p) for p in parts]), abs=1e-12)
    assert k.visits(np.array([], int), [np.array([])]).size == 0


def test_scales_do_not_matter():
    rng = np.random.default_rng(1)
    a, b = rng.random(20), rng.random(20)
    q = np.zeros(20, int)
    assert k.visits(q, [a, b]) == pytest.approx(k.visits(q, [np.exp(50 * a), b * 1e-9]))
    best = k.visits(q, [a, a]).argmax()
    assert best == a.argmax()


ITEMS = "query_id long, memory_id long, a double, b double, rank string"


def test_tables_of_both_kinds_agree(spark):
    rng = np.random.default_rng(2)
    rows = []
    for q, n in ((1, 40), (2, 5), (3, 1)):
        s = random_scores(rng, n)
        rows += [(q, i, float(s[0][i]), float(s[1][i]), "x") for i in range(n)]
    rows += [rows[0], (1, None, 1.0, 1.0, "x"), (None, 1, 1.0, 1.0, "x"), (2, 99, None, None, "x")]
    df = spark.createDataFrame(rows, ITEMS)
    local = {(r["query_id"], r["memory_id"]): r for r in k.fuse(df, ["a", "b"], steps=6).collect()}
    spread = {(r["query_id"], r["memory_id"]): r for r in k.fuse(df, ["a", "b"], steps=6, local_items=20, block_items=7).collect()}
    assert set(local) == set(spread) and len(local) == 47
    for key, r in local.items():
        assert r["visits"] == pytest.approx(spread[key]["visits"], abs=1e-9) and r["rank"] == spread[key]["rank"]
    for q in (1, 2, 3):
        ranks = sorted(r["rank"] for (x, _), r in local.items() if x == q)
        assert ranks == list(range(1, len(ranks) + 1))
    assert k.fuse(df.limit(0), ["a", "b"]).count() == 0


def test_large_queries_keep_their_order(spark):
    rng = np.random.default_rng(3)
    n = 200_000
    a, b = rng.random(n), rng.random(n)
    df = spark.range(n).join(spark.createDataFrame(pa.table({"id": np.arange(n), "a": a, "b": b})), "id").selectExpr("1L AS query_id", "id AS memory_id", "a", "b")
    for steps, options in ((k.STEPS, {}), (2, {"local_items": 1000})):
        want = np.argsort(-k.visits(np.zeros(n, int), [a, b], steps=steps), kind="stable")
        rank = k.fuse(df, ["a", "b"], steps=steps, **options).select("memory_id", "rank", "visits").toArrow().sort_by("rank")
        assert rank["rank"].to_pylist() == list(range(1, n + 1))
        assert (rank["memory_id"].to_numpy() == want).mean() > 0.999
        assert len(np.unique(rank["visits"].to_numpy())) > 0.999 * n  # places come from visits, not from ids


def test_queries_do_not_depend_on_others_of_their_group():
    rng = np.random.default_rng(4)
    n = 20_000
    large = [rng.random(n), rng.random(n)]
    many = np.repeat(np.arange(1, 10_001), rng.integers(1, 9, 10_000))
    query = np.append(np.zeros(n, int), many)
    both = k.visits(query, [np.append(s, rng.random(len(many))) for s in large])
    assert np.array_equal(both[:n], k.visits(np.zeros(n, int), large))


def test_hits(spark):
    hits = spark.createDataFrame([(1, 10, 5.0), (1, 11, float("nan")), (1, 12, None), (1, 13, 9.0), (1, 13, 9.0)], "query_id long, memory_id long, score double")
    memories = spark.createDataFrame([(10, 0.5, 1_700_000_000), (10, 0.5, 1_700_000_000), (11, float("nan"), 0), (12, 0.1, 1_700_000_000_000), (None, 1.0, 1)], "id long, importance float, created_at long")
    got = {r["memory_id"]: r["rank"] for r in k.fused_hits(hits, memories).collect()}
    assert got[10] == 1 and got[11] == 4 and sorted(got.values()) == [1, 2, 3, 4]


def test_epochs(spark):
    df = spark.createDataFrame([(x,) for x in (0, 5, 1_700_000_000, 1_700_000_000_000, 1_700_000_000_000_000)], "c long")
    assert [r[0] for r in df.select(k.epoch_seconds(df.c)).collect()] == [None, 5, 1.7e9, 1.7e9, 1.7e9]
