import numpy as np
from pyspark.sql import functions as F

from mnemosaic.llm import closeness as C
from mnemosaic.llm import knn as K

VECTORS = "id long, embedding array<float>, rep long, q long, n string"  # the last three clash with names inside


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2, "x") for i, v in rows], VECTORS)


def brute(rows, k, d):
    """Ids by vector: cosine, then the smallest id with that vector, then id."""
    good = {i: np.array(v, np.float64).astype(np.float32).astype(np.float64) for i, v in rows if i is not None and v is not None and len(v) == d and None not in v and np.isfinite(v).all() and any(v)}
    first = {}
    for i in sorted(good):
        first.setdefault(tuple(good[i]), i)
    out = {}
    for i, x in good.items():
        near = []
        for j, y in good.items():
            if i != j:
                same = (x == y).all()
                near.append((-2.0 if same else -round(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), 9), first[tuple(y)], j))
        out[i] = [j for _, _, j in sorted(near)[:k]]
    return out


def lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["id"], r["rank"])):
        out.setdefault(r["id"], []).append(r["neighbour_id"])
    return out


def rows_of(rng, n, d=8):
    x = rng.normal(size=(n, d))
    return [(3 * k, v.tolist()) for k, v in enumerate(x)]


def test_equals_brute_force_with_dirt(spark):
    rng = np.random.default_rng(1)
    rows = rows_of(rng, 80)
    copies = [(1000 + k, rows[0][1]) for k in range(9)] + [(2000, rows[5][1])]
    dirt = [(3001, None), (3002, [1.0] * 7), (3003, [0.0] * 8), (3004, [float("nan")] + [1.0] * 7), (3005, [float("inf")] + [1.0] * 7), (3006, [None] + [1.0] * 7), (None, rows[1][1]), rows[2]]
    every = rows + copies + dirt
    got = lists(K.nearest(table(spark, every), k=5, size=8))
    assert got == brute(rows + copies, 5, 8)


def test_blocks_give_the_same(spark, monkeypatch):
    rows = rows_of(np.random.default_rng(2), 90)
    monkeypatch.setattr(K, "BLOCK", 16)
    monkeypatch.setattr(K, "QUERY_BLOCK", 10)
    assert lists(K.nearest(table(spark, rows), k=4, size=8)) == brute(rows, 4, 8)


def test_least_and_asks(spark):
    rng = np.random.default_rng(3)
    rows = rows_of(rng, 60)
    rows += [(5000 + k, (np.array(rows[k][1]) + rng.normal(size=8) * 0.05).tolist()) for k in range(20)]
    want = brute(rows, 5, 8)
    good = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    cos = lambda a, b: good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b])
    got = lists(K.nearest(table(spark, rows), k=5, size=8, least=0.9))
    assert got == {i: near for i, v in want.items() if (near := [j for j in v if cos(i, j) >= 0.9])}
    asked = lists(K.nearest(table(spark, rows), k=5, size=8, asks=F.col("id") % 2 == 0))
    assert asked == {i: v for i, v in want.items() if i % 2 == 0}


def test_small_tables(spark):
    assert K.nearest(table(spark, []), size=8).count() == 0
    assert K.nearest(table(spark, [(1, [1.0] * 8)]), size=8).count() == 0
    assert lists(K.nearest(table(spark, [(1, [1.0] * 8), (2, [2.0] * 8)]), size=8)) == {1: [2], 2: [1]}


def test_levels_give_the_same(spark, monkeypatch):
    """With no least probability all partitions are searched, so the result is exact however often they were cut."""
    rows = rows_of(np.random.default_rng(6), 150)
    want = brute(rows, 4, 8)
    assert lists(K.nearest(table(spark, rows), k=4, size=8, chance=0.0, partition_rows=20, sample=96)) == want  # two levels
    monkeypatch.setattr(K, "ROUTED", 30)
    monkeypatch.setattr(K, "BLOCK", 8)
    assert lists(K.nearest(table(spark, rows), k=4, size=8, chance=0.0, partition_rows=5, sample=72)) == want  # four levels


def test_partitions_are_balanced_and_recall_is_high(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 16))
    x = centres[rng.integers(0, 60, 2400)] + rng.normal(size=(2400, 16)) * 0.4
    unit = K.unit(x)
    graph = K.neighbour_graph(unit, 10)
    label = K.partition_graph(graph, K.bisect(unit, 24), 24)
    assert np.bincount(label, minlength=24).max() <= 1.1 * 100 + 1
    inside = (label[graph] == label[:, None]).mean()
    assert inside > (K.bisect(unit, 24)[graph] == K.bisect(unit, 24)[:, None]).mean()
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    s = unit @ unit.T
    np.fill_diagonal(s, -2)
    for sample in (2400, 480):  # one level, two levels
        got = lists(K.nearest(table(spark, rows), k=5, chance=0.02, size=16, asks=F.col("id") % 20 == 0, partition_rows=100, sample=sample))
        hit = sum(len({*np.argsort(-s[i])[:5].tolist()} & {*v}) for i, v in got.items())
        assert len(got) == 120 and hit / 600 >= 0.9


def test_hot_copies(spark, monkeypatch):
    from mnemosaic import runtime

    monkeypatch.setattr(runtime, "HOT_ROWS", 3)
    rows = rows_of(np.random.default_rng(5), 10)
    rows += [(100 + k, rows[0][1]) for k in range(7)]
    assert lists(K.nearest(table(spark, rows), k=5, size=8)) == brute(rows, 5, 8)


def close(rows, k, least):
    """Pairs as in the SQL of p5_found."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(np.float64)
    c = x @ x.T / np.sqrt(np.outer((x * x).sum(1), (x * x).sum(1)))
    np.fill_diagonal(c, -2)
    out = set()
    for a, s in enumerate(c):
        near = sorted((-round(s[b], 12), ids[b]) for b in np.flatnonzero(s >= least))[:k]
        out |= {(int(min(ids[a], j)), int(max(ids[a], j))) for _, j in near}
    return out


def pairs(df):
    return {(min(r["id"], r["neighbour_id"]), max(r["id"], r["neighbour_id"])) for r in df.collect()}


def test_least_misses_nothing(spark, monkeypatch):
    """However unlikely the router thinks a partition, and however many blocks and files there are."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(350, 8))
    rows = [(3 * k, v.tolist()) for k, v in enumerate(np.concatenate([x, x + rng.normal(size=x.shape) * 0.3]))]
    want = close(rows, 5, 0.9)
    assert len(want) > 350
    assert pairs(K.nearest(table(spark, rows), k=5, size=8, least=0.9, chance=0.06, partition_rows=30, sample=240)) == want
    monkeypatch.setattr(C, "LEAST_ROWS", 20)
    monkeypatch.setattr(C, "BLOCK_ROWS", 60)
    assert C.depth_of(700) == 4
    assert pairs(K.nearest(table(spark, rows), k=5, size=8, least=0.9)) == want
    asked = K.nearest(table(spark, rows), k=5, size=8, least=0.9, asks=F.col("id") < 300)
    every = lists(K.nearest(table(spark, rows), k=5, size=8, least=0.9))
    assert lists(asked) == {i: v for i, v in every.items() if i < 300}


def test_least_ties_go_by_id(spark):
    """Copies and multiples of a vector are equally similar."""
    v = np.random.default_rng(8).normal(size=8).astype(np.float32)
    rows = [(i, (v * f).tolist()) for i, f in [(1, 2), (2, 0.5), (3, 4), *((k, 1) for k in range(10, 20)), (30, 8)]]
    assert pairs(K.nearest(table(spark, rows), k=5, size=8, least=0.9)) == close(rows, 5, 0.9)


def test_close_rows(monkeypatch):
    """Leaves, crowds and bounds on any spectrum, the pairs of one block and of two."""
    rng = np.random.default_rng(9)
    monkeypatch.setattr(C, "HELD", 500)
    monkeypatch.setattr(C, "SLAB", 10)
    for leaf, axes, data in ((16, 3, rng.normal(size=(400, 6))), (64, 2, rng.normal(size=(400, 6)) + 1.5), (32, 24, rng.normal(size=(400, 2)) @ rng.normal(size=(2, 6))), (400, 4, rng.normal(size=(400, 6)) * 0.1 + 1)):
        monkeypatch.setattr(C, "LEAF", leaf)
        monkeypatch.setattr(C, "AXES", axes)
        x = K.unit(data)
        x1 = C.turned(x, C.axes(x[:50]))
        s = (x @ x.T).astype(np.float64)
        np.fill_diagonal(s, -2)
        for same in (True, False):
            t = s.copy()
            if not same:
                t[:150, :150] = t[150:, 150:] = -2
                q, n = C.close_rows(x[:150], x1[:150], x[150:], x1[150:], False, 3, 0.9)
            else:
                q, n = C.close_rows(x, x1, x, x1, True, 3, 0.9)
            got = set(zip(q.tolist(), n.tolist()))
            assert len(got) == len(q)
            last = np.sort(t, axis=1)[:, -3]
            assert got >= {(a, b) for a, b in zip(*np.nonzero((t >= np.maximum(last, 0.9)[:, None])), strict=True)}
            assert not [1 for a, b in got if t[a, b] < max(last[a], 0.9) - 5e-5]
