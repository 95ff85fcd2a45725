"""Micro-fixtures of the operators."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mnemosaic import errors
from mnemosaic.functions.embedders import HashEmbedder, ServiceEmbedder, embed_table, hash_embedding, resolve
from mnemosaic.operators import capacity, combined, graph, hybrid, ivf, mutations, temporal, vector_search
from mnemosaic.plans.options import Options, Path
from mnemosaic.schema import MEMORY_SCHEMA


def table(spark, rows):
    """(id, collection, embedding, created_at, importance[, content])"""
    return spark.createDataFrame([(r[0], r[1], bytearray((r[5] if len(r) > 5 else "x").encode()), None if r[2] is None else [float(x) for x in r[2]], {"lang": "en"} if r[0] % 2 else {}, r[3], float(r[4])) for r in rows], MEMORY_SCHEMA)


def links(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, relation string")


def ids(df):
    return [r["id"] for r in df.collect()]


@pytest.fixture(scope="module")
def three(spark):
    return table(spark, [(1, "agent1", [1.0, 0, 0], 1000, 0.9), (2, "agent1", [0.9, 0.1, 0], 2000, 0.2), (3, "agent2", [1.0, 0, 0], 3000, 0.5)]).cache()


@pytest.fixture(scope="module")
def diamond(spark):
    nodes = table(spark, [(i, "a", [float(np.sin(0.1 * i)), float(np.cos(0.2 * i)), float(np.sin(0.3 * i))], 1000 + 1000 * i, 0) for i in range(5)]).cache()
    return nodes, links(spark, [(0, 1, "points"), (0, 2, "refers"), (1, 3, "links"), (2, 3, "connects"), (3, 4, "leads")]).cache()


def test_knn(spark, three):
    assert ids(vector_search.knn(three, [1, 0, 0], 2)) == [1, 3]  # equal scores in the order of ids
    assert ids(vector_search.knn(three, [1, 0, 0], 5, "agent1")) == [1, 2]
    assert ids(vector_search.knn(three, [1, 0, 0], 5, "none")) == []
    assert ids(vector_search.knn_in_ids(three, [1, 0, 0], spark.createDataFrame([(2,), (3,), (9,)], "id long"), 2)) == [3, 2]
    got = vector_search.knn(three, [1, 0, 0], 3, metric="l2").collect()
    assert [round(r["score"], 6) for r in got] == [1, 1, 0.98]
    for call, error in ((lambda: vector_search.knn(three, [], 1), errors.EmptyQueryError), (lambda: vector_search.knn(three, [1, 0, 0], 0), errors.InvalidTopKError), (lambda: vector_search.knn(three.limit(0), [1, 0, 0], 1, validate=True), errors.NoEmbeddingsError)):
        with pytest.raises(error):
            call()


def test_prefix_and_batch(spark):
    rows = [(i, "a", [0.6, 0.8, 0.0], 0, 0) for i in range(29)] + [(29, "a", [1.0, 0, 0], 0, 0)]
    m = table(spark, rows)
    found = ids(vector_search.prefix_knn(m, [1, 0, 0], 3))
    assert found[0] == 29 and len(found) == 3
    q = spark.createDataFrame([(7, [1.0, 0.0, 0.0]), (8, [0.6, 0.8, 0.0])], "query_id long, embedding array<float>")
    got = {(r["query_id"], r["rank"]): r["id"] for r in vector_search.knn_batch(m, q, 2).collect()}
    assert got == {(7, 1): 29, (7, 2): 0, (8, 1): 0, (8, 2): 1}
    assert vector_search.knn_batch(m, q.limit(0), 2).count() == 0


def test_vectors_of_other_lengths_and_zeros_score_zero(spark):
    m = table(spark, [(1, "a", [0.0, 0.0], 0, 0), (2, "a", [1.0], 0, 0), (3, "a", None, 0, 0), (4, "a", [1.0, 1.0], 0, 0)])
    assert [(r["id"], round(r["score"], 3)) for r in vector_search.knn(m, [1, 0], 9).collect()] == [(4, 0.707), (1, 0), (2, 0)]


def test_wide_vectors_equal_numpy(spark):
    x = np.random.default_rng(0).normal(size=(20, 200))
    m = table(spark, [(i, "a", v.tolist(), 0, 0) for i, v in enumerate(x)])
    got = vector_search.knn(m, x[3].tolist(), 5).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = np.argsort(-(u @ u[3]))[:5]
    assert [r["id"] for r in got] == want.tolist()


def test_inverted_file_recall(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(600, 16))
    m = table(spark, [(i, "a", v.tolist(), 0, 0) for i, v in enumerate(x)]).cache()
    index = ivf.InvertedFile.build(m, cells=6)
    hit = 0
    for i in range(0, 60, 20):
        exact = set(ids(vector_search.knn(m, x[i].tolist(), 10)))
        hit += len(exact & set(ids(index.search(x[i].tolist(), 10, 5))))
    assert hit / 30 >= 0.9
    asked = m.where("id % 60 = 0").withColumnRenamed("id", "query_id")
    exact = vector_search.knn_batch(m, asked, 10)
    every = sorted(map(tuple, index.search_batch(asked, 10, 6, block_rows=40).select("query_id", "id", "rank").collect()))
    assert every == sorted(map(tuple, exact.select("query_id", "id", "rank").collect()))
    assert vector_search.recall(exact, index.search_batch(asked, 10, 5), 10).collect()[0]["recall"] >= 0.9
    index.save(f"{tmp_path}/index")
    again = ivf.InvertedFile.load(spark, f"{tmp_path}/index")
    q = x[5].tolist()
    assert ids(again.search(q, 5, 6)) == ids(vector_search.knn(m, q, 5)) == ids(ivf.search_or_scan(None, m, q, 5))
    assert not again.stale(m) and again.stale(m.where("id < 100"))


def test_default_probes_follow_the_cells(spark):
    x = np.random.default_rng(2).normal(size=(40_000, 12)).astype(np.float32)
    m = spark.createDataFrame(pa.table({"id": np.arange(len(x)), "embedding": list(x)})).cache()
    index = ivf.InvertedFile.build(m)
    asked = m.where("id % 200 = 0").withColumnRenamed("id", "query_id")
    assert vector_search.recall(vector_search.knn_batch(m, asked, 10), index.search_batch(asked, 10), 10).collect()[0]["recall"] >= 0.9
    assert len(index.centres) == 200 and len(index.probe(x[0].tolist())) > 8


def test_graph(spark, diamond):
    nodes, e = diamond
    hops = lambda h: {r["id"]: r["hops"] for r in graph.bfs(e, nodes, 0, h).collect()}
    assert hops(1) == {0: 0, 1: 1, 2: 1} and hops(2) == {0: 0, 1: 1, 2: 1, 3: 2} and hops(3)[4] == 3 and hops(6) == hops(3)
    assert graph.shortest_path(e, 0, 4) == [0, 1, 3, 4] and graph.shortest_path(e, 4, 0) is None and graph.shortest_path(e, 2, 2) == [2]
    paths = sorted(r["path"] for r in graph.simple_paths(e, 0, 2).collect())
    assert paths == [[0], [0, 1], [0, 1, 3], [0, 2], [0, 2, 3]]
    cycle = links(spark, [(0, 1, "to"), (1, 0, "back")])
    assert sorted(r["path"] for r in graph.simple_paths(cycle, 0, 3).collect()) == [[0], [0, 1]]
    assert [tuple(r) for r in graph.neighbours(e, 0).collect()] == [(1, "points"), (2, "refers")]
    with pytest.raises(errors.InvalidMaxHopsError):
        graph.reach(e, nodes, 0)
    with pytest.raises(errors.NotFoundError):
        graph.require_node(nodes, 999)


def test_graph_within_a_collection(spark):
    nodes = table(spark, [(1, "a", None, 0, 0), (2, "a", None, 0, 0), (3, "b", None, 0, 0)])
    e = links(spark, [(1, 2, "ok"), (2, 3, "out")])
    assert sorted(ids(graph.bfs(e, nodes, 1, 3, "a"))) == [1, 2]
    assert ids(graph.bfs(e, nodes, 3, 3, "a")) == []
    accepted, rejected = graph.connectable(links(spark, [(1, 2, "ok")]), nodes, links(spark, [(1, 2, "ok"), (1, 2, "new"), (2, 3, "x"), (2, 9, "x")]))
    assert [tuple(r) for r in accepted.collect()] == [(1, 2, "new")]
    assert {r["reason"] for r in rejected.collect()} == {"missing end", "two collections"}
    with pytest.raises(errors.CrossCollectionError):
        graph.require_connectable(nodes, 2, 3)


def test_time(spark):
    m = table(spark, [(i, "a", None, 1000 * (i + 1), 0) for i in range(5)])
    assert ids(temporal.range_ids(m, 1000, 3000)) == [0, 1, 2] and ids(temporal.range_ids(m, 2000, 2000)) == [1]
    assert temporal.count_in_range(m, 1000, 4000).collect()[0]["n"] == 4
    assert ids(temporal.before(m, 0)) == [] and ids(temporal.before(m, 3000)) == [0, 1] and ids(temporal.recent(m, 3000)) == [2, 3, 4]
    assert ids(temporal.oldest(m, 2)) == [0, 1] and ids(temporal.newest(m, 2)) == [4, 3] and len(ids(temporal.oldest(m, 100))) == 5
    with pytest.raises(errors.InvalidTimeRangeError):
        temporal.in_range(m, 3000, 1000)
    with pytest.raises(errors.NoMemoriesInRangeError):
        temporal.range_ids(m, 6000, 7000, strict=True)
    assert tuple(temporal.bounds(m.limit(0)).collect()[0]) == (None, None)


def test_combined(spark, diamond):
    nodes, e = diamond
    assert set(ids(combined.similar_in_range(nodes, [0.1, 1, 0], 1000, 3000, 9))) <= {0, 1, 2}
    assert set(ids(combined.similar_in_range_connected(nodes, e, [0.1, 1, 0], 1000, 4000, 0, 2, 9))) <= {0, 1, 2, 3}
    first = table(spark, [(1, "a", [0.5, 0.5], 1000, 0), (2, "a", [1.0, 0], 9000, 0), (3, "a", [0.99, 0.01], 9000, 0)])
    assert ids(combined.similar_in_range(first, [1, 0], 1000, 1000, 1)) == [1]
    m = table(spark, [(0, "a", [1.0, 0], 1000, 0), (1, "a", [1.0, 0], 5000, 0), (3, "a", [0.2, 0.8], 3000, 0), (2, "a", [1.0, 0], 9000, 0)])
    g = links(spark, [(0, 1, "to"), (0, 3, "to"), (3, 2, "to")])
    assert ids(combined.weighted_in_range_connected(m, g, [1, 0], 2000, 10000, 0, 2, 1)) == [2]
    with pytest.raises(errors.InvalidWeightsError):
        combined.weighted_in_range_connected(m, g, [1, 0], 0, 1, 0, 2, 1, combined.RankingWeights(80, 30, 10))


def test_hybrid(spark, three):
    e = links(spark, [(1, 2, "linked")])
    run = lambda **o: hybrid.search(three, e, [1, 0, 0], Options(**o))
    assert set(ids(run(collection="agent1").hits)) == {1, 2}
    assert set(ids(run(time_range=(1500, 3500)).hits)) == {2, 3}
    assert set(ids(run(collection="agent1", time_range=(1000, 1000)).hits)) == {1, 2}  # the range is not asked of neighbours
    s = run(time_range=(500, 3000))
    assert s.plan.path is Path.WEIGHTED_HYBRID and s.trace()["ranked"] == 3
    assert all(0 <= r["final_score"] <= 1 for r in s.hits.collect())
    assert ids(run(hops=0, metadata={"lang": "en"}).hits) == [1, 3]
    assert ids(hybrid.search(three.limit(0), e, [1, 0, 0]).hits) == []


def test_expansion_cannot_change_an_unfiltered_exact_search(spark):
    rng = np.random.default_rng(3)
    m = table(spark, [(i, "a", rng.normal(size=4).tolist(), i, 0) for i in range(60)]).cache()
    e = links(spark, [(int(a), int(b), "r") for a, b in rng.integers(0, 60, (80, 2))])
    q = rng.normal(size=4).tolist()
    assert ids(hybrid.search(m, e, q, Options(top_k=5)).hits) == ids(vector_search.knn(m, q, 5))


def test_client_boosts(spark):
    m = table(spark, [(1, "a", [1.0, 0], 1000, 0), (2, "a", [0.0, 1], 1000, 0)])
    e = links(spark, [(1, 2, "links_to")])
    plain = {r["id"]: r["score"] for r in hybrid.client_search(m, e, [1, 0], 2).collect()}
    boosted = {r["id"]: r["score"] for r in hybrid.client_search(m, e, [1, 0], 2, use_graph=True).collect()}
    assert plain[1] > 0.9 and plain[2] <= 0.501 and boosted[2] == pytest.approx(0.9 * plain[1])
    fresh = {r["id"]: r["score"] for r in hybrid.client_search(m, e, [1, 0], 2, recency_bias=True, now=1000).collect()}
    assert fresh[1] == pytest.approx(1.2 * plain[1])


def test_capacity(spark):
    m = table(spark, [(1, "ns", [1.0], 1000, 0.1), (2, "ns", [1.0], 2000, 0.9), (3, "ns", [1.0], 3000, 0.2)])
    assert ids(capacity.evicted(m, capacity.Capacity(max_entries=2))) == [1]
    assert ids(capacity.evicted(m, capacity.Capacity())) == []
    two = table(spark, [(1, "ns", None, 1, 0, "y" * 40), (2, "ns", None, 1, 0, "y" * 40)]).withColumn("metadata", F.create_map().cast("map<string,string>"))
    assert tuple(capacity.usage(two).collect()[0]) == (2, 84) and ids(capacity.evicted(two, capacity.Capacity(max_bytes=50))) == [1]
    assert tuple(capacity.usage(two.limit(0)).collect()[0]) == (0, 0)


def test_upsert(spark):
    base = table(spark, [(90, "a", [1.0, 0], 1, 0, "old"), (91, "a", [1.0, 0], 1, 0, "same")])
    batch = table(spark, [(90, "a", None, 2, 0, "new"), (91, "b", None, 2, 0, "same"), (92, "a", [0.0, 1], 2, 0, "more")])
    after, refused = mutations.upsert(base, batch)
    rows = {r["id"]: r for r in after.collect()}
    assert ids(refused) == [90] and bytes(rows[90]["content"]) == b"old"
    assert rows[91]["embedding"] == [1.0, 0.0] and rows[91]["collection"] == "b" and len(rows) == 3


def test_fold(spark):
    m = lambda i: (i, "a", bytearray(b""), None, {}, 0, 0.0)
    rows = [(1, "add", 1, m(1), None, None, None), (2, "add", 2, m(2), None, None, None), (3, "connect", None, None, 1, 2, "r"), (4, "add", 3, m(3), None, None, None), (5, "connect", None, None, 1, 3, "r"), (6, "disconnect", None, None, 1, 2, None), (7, "delete", 3, None, None, None, None), (8, "add", 3, m(3), None, None, None), (9, "connect", None, None, 2, 1, "q")]
    from mnemosaic.schema import COMMAND_SCHEMA

    memories, edges = mutations.fold(spark.createDataFrame(rows, COMMAND_SCHEMA))
    assert sorted(ids(memories)) == [1, 2, 3] and [tuple(r) for r in edges.collect()] == [(2, 1, "q")]


def test_embedders(spark):
    h = HashEmbedder(20)
    v = h.embed("hello")
    assert len(v) == 20 and sum(x * x for x in v) == pytest.approx(1) and v == h.embed("hello") and min(v) >= 0
    with pytest.raises(errors.ConfigError):
        HashEmbedder(0)
    with pytest.raises(errors.ConfigError):
        resolve(None, "x", None)
    assert ServiceEmbedder(lambda ts: [[1, 2] for _ in ts]).embed("a") == [1.0, 2.0]
    df = spark.createDataFrame([(1, "hello"), (2, None)], "id long, text string")
    got = {r["id"]: r["embedding"] for r in embed_table(df, h).collect()}
    assert got[1] == pytest.approx(v, rel=1e-6) and len(got[2]) == 20
    made = {r["id"]: r["e"] for r in df.select("id", hash_embedding(F.col("text"), 20).alias("e")).collect()}
    assert made[1] == pytest.approx(v) and made[2] == pytest.approx(h.embed(""))


def test_many_queries_in_tasks_and_in_blocks(spark, monkeypatch):
    import numpy as np

    from mnemosaic.operators import vector_search as vs

    x = np.random.default_rng(7).normal(size=(90, 6)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, [1.0]), (901, None)], "id long, embedding array<float>")
    asked = rows.where("id < 90 AND id % 2 = 0").withColumnRenamed("id", "query_id")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, int(j), r + 1) for i in range(0, 90, 2) for r, j in enumerate(np.argsort(-(u @ u[i]), kind="stable")[:4])}
    for at_once, in_tasks, block in ((4096, 32768, 65536), (7, 32768, 65536), (16, 0, 20)):
        monkeypatch.setattr(vs, "QUERIES_AT_ONCE", at_once)
        monkeypatch.setattr(vs, "QUERIES_IN_TASKS", in_tasks)
        monkeypatch.setattr(vs, "ROWS_AT_ONCE", block)
        assert {(r["query_id"], r["id"], r["rank"]) for r in vs.knn_batch(rows, asked, 4).collect()} == want
    assert vs.knn_batch(rows, asked.limit(0), 4).count() == 0
