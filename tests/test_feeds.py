"""The change feed and the orphan references against plain Python."""

import random

import pytest

from mnemosaic import runtime
from mnemosaic.operators import orphans
from mnemosaic.operators.changefeed import BucketedTable
from mnemosaic.runtime import hot_keys, numbered, skew_safe_join

CHANGES = "op string, id long, seq long, text string"


def apply_plainly(changes):
    state = {}
    for op, key, seq, text in sorted({c for c in changes if c[1] is not None and c[2] is not None and c[0] in ("add", "delete")}, key=lambda c: c[2]):
        if op == "add":
            state[key] = (seq, text)
        else:
            state.pop(key, None)
    return state


def test_batches_in_any_order(spark, tmp_path):
    rng = random.Random(4)
    changes = [(rng.choice(["add", "add", "delete", "other", None]), rng.choice([1, 1, 1, *range(2, 30), None]), k, rng.choice(["x", "", None])) for k in range(300)]
    sent = changes + rng.sample(changes, 60)
    rng.shuffle(sent)
    t = BucketedTable(spark, f"file://{tmp_path}/t", "id", "seq")
    for k in range(0, len(sent), 120):
        t.apply(spark.createDataFrame(sent[k : k + 120], CHANGES), ["text"])
    got = {r["id"]: (r["seq"], r["text"]) for r in t.read().collect()}
    assert got == apply_plainly(changes)
    assert t.read(1).count() <= 30 and len(t.versions()) == 3
    assert t.vacuum() == [1, 2] and {r["id"] for r in t.read().collect()} == set(got)


def test_only_touched_buckets_are_written_anew(spark, tmp_path):
    t = BucketedTable(spark, f"file://{tmp_path}/t", "id", "seq")
    t.apply(spark.createDataFrame([("add", k, k, "a") for k in range(100)], CHANGES), ["text"])
    first = t.manifest()
    second = t.apply(spark.createDataFrame([("add", 5, 500, "b")], CHANGES), ["text"])
    assert sum(first.buckets[b] != second.buckets[b] for b in first.buckets) == 1 and second.version == 2
    assert t.apply(spark.createDataFrame([], CHANGES), ["text"]).version == 2
    with pytest.raises(RuntimeError):
        t._commit(second)


def test_buckets_split_as_the_table_grows(spark, tmp_path):
    t = BucketedTable(spark, f"file://{tmp_path}/t", "id", "seq", rows_per_bucket=20_000)
    few = t.apply(spark.createDataFrame([("add", k, k, "a") for k in range(10)], CHANGES), ["text"])
    assert (few.n_buckets, few.rows) == (16, 10)
    many = spark.range(1_000_000).selectExpr("'add' AS op", "id", "id + 100 AS seq", "'b' AS text")
    m = t.apply(many, ["text"])
    assert (m.n_buckets, m.rows) == (64, 1_000_000) and len(m.buckets) == 64
    assert t.read().count() == t.read().where("text = 'b'").select("id").distinct().count() == 1_000_000
    sizes = [r[0] for r in t.read().selectExpr("pmod(hash(id), 64) AS b").groupBy("b").count().select("count").collect()]
    assert max(sizes) < 20_000
    # A small batch then writes its own buckets only, scans them as they lie and shuffles nothing but the changes.
    last = t.apply(spark.createDataFrame([("delete", 5, 10**9, None)], CHANGES), ["text"])
    assert sum(m.buckets[b] != last.buckets[b] for b in m.buckets) == 1
    assert t.read().count() == 999_999 and last.rows == 1_000_000
    plan = t._merge(last, spark.createDataFrame([(1, 1, False, "c")], "id long, seq long, deleted boolean, text string"), {0})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan


def test_an_empty_feed_gives_an_empty_table(spark, tmp_path):
    t = BucketedTable(spark, f"file://{tmp_path}/t", "id", "seq")
    t.apply(spark.createDataFrame([], CHANGES), ["text"])
    assert t.read().count() == 0


def test_edges_without_target(spark):
    edges = spark.createDataFrame([(1, 7, 1, "2024-01-02"), (1, 7, 1, "2024-01-02"), (2, 7, 2, "2024-01-02"), (3, 7, None, "2024-01-02"), (4, 7, 1, "2024-01-05"), (5, 7, 9, "2024-01-02"), (6, 7, 1, "2023-01-01"), (7, 7, 1, None)], "edge_id long, src long, dst long, recorded_at string")
    edges = edges.withColumn("recorded_at", edges.recorded_at.cast("timestamp_ntz"))
    memories = spark.createDataFrame([(1, "2024-01-02"), (1, "2024-01-09"), (2, "2024-01-03"), (None, None)], "id long, t string")
    memories = memories.select("id", memories.t.cast("timestamp_ntz").alias("ingested_at"))
    gone = spark.createDataFrame([(1, "2024-01-05"), (1, "2024-01-06"), (8, None)], "memory_id long, t string")
    gone = gone.select("memory_id", gone.t.cast("timestamp_ntz").alias("deleted_at"))
    for hot in (50_000, 1):  # also with every target hot
        assert sorted(r["record_id"] for r in orphans.edge_orphans(edges, memories, gone, hot).collect()) == [2, 4, 5, 6, 7]
    assert orphans.edge_orphans(edges.limit(0), memories, gone).count() == 0


@pytest.mark.parametrize("block", [7, 65_536])
def test_references_of_the_log(spark, block):
    rng = random.Random(9)
    rows = []
    for k in range(200):
        op = rng.choice(["add", "delete", "connect", "connect", "none"])
        rows.append((k, op, rng.choice([1, 1, 2, 3, 4, None]) if op in ("add", "delete") else None, rng.choice([1, 2, 3, None]), rng.choice([1, 4, 5])))
    live, want = set(), set()
    for k, op, i, a, b in rows:
        if op == "add" and i is not None:
            live.add(i)
        elif op == "delete":
            live.discard(i)
        elif op == "connect":
            want |= {(k, f, r) for f, r in (("id1", a), ("id2", b)) if r is not None and r not in live}
    sent = rows + rng.sample(rows, 50)
    rng.shuffle(sent)
    log = spark.createDataFrame([(*r, "2024-01-01") for r in sent], "command_id long, op string, id long, src long, dst long, recorded_at string")
    got = {(r["record_id"], r["ref_field"], r["ref_id"]) for r in orphans.log_orphans(log, log.select("command_id", "op", "id"), block).collect()}
    assert got == want


def test_cascade(spark):
    refs = spark.createDataFrame([(1, 10, 99), (2, 11, 10), (3, 12, 11), (4, 11, 12), (5, 13, 14), (6, 15, None), (6, 15, None)], "record_id long, owner long, ref_id long").selectExpr("*", "'f' AS ref_field")
    direct = refs.where("record_id = 1")
    for hot in (None, 0):  # also with every reference hot
        got = {r["record_id"]: r["level"] for r in orphans.cascade(refs, direct, hot).collect()}
        assert got == {1: 0, 2: 1, 3: 2, 4: 3}
    assert orphans.cascade(refs, direct.limit(0)).count() == 0


def test_hot_keys_and_joins(spark, monkeypatch):
    left = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 0), (None, 1)], "k long, v long")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, w string")
    assert [r[0] for r in hot_keys(left, "k", 10).collect()] == [1]
    for most in (20_000, 0):  # broadcast, and salted
        monkeypatch.setattr(runtime, "MOST_HOT", most)
        for how in ("left", "inner"):
            assert sorted(map(str, skew_safe_join(left, right, "k", how, 10).collect())) == sorted(map(str, left.join(right, "k", how).collect()))


def test_numbered(spark):
    df = spark.createDataFrame([(x,) for x in (5, 3, 9, 1)], "x long")
    assert sorted(tuple(r) for r in numbered(df, ["x"], "n", 10).collect()) == [(1, 10), (3, 11), (5, 12), (9, 13)]
