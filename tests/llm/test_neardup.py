import itertools
import random
from collections import Counter

import numpy as np
import pytest
import regex

from mnemosaic.llm import neardup as n
from mnemosaic.llm.components import components

CONTENT = "id long, content binary, hash string, rep long"  # the last two clash with names inside


def similarity(a, b):
    a, b = (Counter(regex.findall(r"[\p{L}\p{N}]+", t.lower())) for t in (a, b))
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def found(spark, rows, all_pairs=n.ALL_PAIRS, **options):
    df = spark.createDataFrame([(i, None if c is None else bytearray(c), "h", 1) for i, c in rows], CONTENT)
    members, classes, links = n.near_duplicates(df, **options)
    return {(r["id_a"], r["id_b"]) for r in n.expand(members, links, classes, all_pairs).collect()}


def corpus(rng, size):
    words = [f"w{i}" for i in range(400)] + ["the"] * 60
    base = [[rng.choice(words) for _ in range(rng.randint(20, 60))] for _ in range(size)]
    texts = [" ".join(b) for b in base]
    for b in base[: size // 2]:
        edited = list(b)
        for _ in range(rng.randint(0, len(b) // 4)):
            edited[rng.randrange(len(edited))] = rng.choice(words)
        rng.shuffle(edited)
        texts.append(" ".join(edited))
    return texts


def test_equals_all_pairs(spark):
    rng = random.Random(5)
    texts = corpus(rng, 120)
    texts += texts[:5] + [texts[0]] * 3 + ["THE, " * 25, "the " * 25, "short text", "ソロ鐘 " * 21, "ソロ鐘 " * 20]
    rows = [(k * 3, t.encode()) for k, t in enumerate(texts)]
    rows += [rows[0], rows[4], (None, texts[0].encode()), (9001, None), (9002, b""), (9003, b"\xff\xfe" + texts[0].encode())]
    want = {(k * 3, j * 3) for (k, a), (j, b) in itertools.combinations(enumerate(texts), 2) if len(regex.findall(r"[\p{L}\p{N}]+", a)) >= 20 and len(regex.findall(r"[\p{L}\p{N}]+", b)) >= 20 and similarity(a, b) >= 0.7}
    assert found(spark, rows, miss=1e-6) == want


def test_large_classes_are_linked_through_representatives(spark, monkeypatch):
    a = " ".join(f"a{i}" for i in range(30))
    b = a.replace("a0 ", "b ")
    rows = [(i, (a if i < 6 else b).encode()) for i in range(10)]
    assert len(found(spark, rows)) == 45
    monkeypatch.setattr(n, "SALT_ROWS", 2)
    assert len(found(spark, rows, None)) == 45
    star = found(spark, rows, 10)
    assert star == {(0, i) for i in range(1, 6)} | {(6, i) for i in range(7, 10)} | {(i, 6) for i in range(6)} | {(0, i) for i in range(6, 10)}


def test_a_family_under_one_key_is_compared_in_blocks(spark, monkeypatch):
    """300 variants of one long text share most of their keys; every pair is found, in tasks that hold blocks only."""
    monkeypatch.setattr(n, "HOT_KEY", 20)
    monkeypatch.setattr(n, "KEY_BLOCK", 16)
    base = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join([*base, f"v{k}"]).encode()) for k in range(300)]
    assert len(found(spark, rows)) == 300 * 299 // 2


def test_no_rows_and_one_row(spark):
    assert found(spark, []) == set() and found(spark, [(1, b"x " * 30)]) == set()


def test_long_text(spark):
    long = " ".join(f"w{i % 5000}" for i in range(200_000))
    assert found(spark, [(1, long.encode()), (2, (long + " more").encode())]) == {(1, 2)}


def test_allocation():
    rng = np.random.default_rng(0)
    similarities = rng.beta(2, 12, 5000)
    small, large = (n.allocate(k, similarities, 0.7, 0.02) for k in (1_000, 10_000_000))
    for plan in (small, large):
        miss = np.prod([1 - p.meets(0.7) for p in plan])
        assert miss <= 0.02
    assert np.mean([p.width for p in large]) > np.mean([p.width for p in small])


def test_threshold_one_probes_all_subsets():
    tokens, counts = n.bag_tokens(["a b c d e f g h", "a b c d e f g h", "x y z"])
    plan = [n.Partition(4, 1), n.Partition(3, 0)]
    sketch, keys = n.partition_keys(tokens, counts, plan)
    assert keys.shape == (5, 3) and (keys[:, 0] == keys[:, 1]).all() and not (keys[:, 0] == keys[:, 2]).any()
    assert sketch.shape == (4, 3) and n.Partition(4, 1).meets(0.5) == pytest.approx(5 / 16)


def test_bags():
    tokens, counts = n.bag_tokens(["a a b", "", "B a A", "b"])
    assert counts.tolist() == [3, 0, 3, 1] and tokens[:3].tolist() == tokens[3:6].tolist()


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 140)] + [(None, 1), (5, 5)]
    label = {}
    for a, b in links:
        if a is not None and a != b:
            x, y = label.setdefault(a, a), label.setdefault(b, b)
            label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == label
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_count_redelivered_rows_once(spark, tmp_path):
    rng = random.Random(7)
    texts = corpus(rng, 60)
    texts += texts[:4] + [texts[0]] * 2
    rows = [(k, t.encode()) for k, t in enumerate(texts)]
    rows += [r for r in rows if r[0] % 3 == 0] + [rows[0]] * 3
    near = {k: {j for j, b in enumerate(texts) if j != k and similarity(a, b) >= 0.7} for k, a in enumerate(texts)}
    group = {k: k for k in near}
    for _ in texts:
        group = {k: min([group[k], *(group[j] for j in near[k])]) for k in near}
    assert any(not near[k] for k in range(0, len(texts), 3)) and any(near[k] for k in range(0, len(texts), 3))
    spark.createDataFrame([(i, bytearray(c)) for i, c in rows], "id long, content binary").write.parquet(f"{tmp_path}/memories.parquet")
    got = sorted(tuple(r) for r in n.p3_groups(spark, str(tmp_path)).select("id", "group_id", "n_links").collect())
    assert got == [(k, group[k], len(near[k])) for k in sorted(near) if near[k]]


def test_hot_classes(spark, monkeypatch):
    from mnemosaic import runtime

    monkeypatch.setattr(runtime, "HOT_ROWS", 2)
    text = " ".join(f"a{i}" for i in range(30)).encode()
    assert len(found(spark, [(i, text) for i in range(6)] + [(9, text + b" more")])) == 21
