import json
import time

import pytest
from pyspark.sql import functions as F

from mnemosaic import errors
from mnemosaic.client import Client, parse_index_mode
from mnemosaic.functions.embedders import HashEmbedder
from mnemosaic.operators.capacity import Capacity
from mnemosaic.schema import COMMAND_SCHEMA, MEMORY_SCHEMA
from mnemosaic.sources import loaders, replay
from mnemosaic.store import MemoryStore, SyncPolicy
from mnemosaic.streaming import command_stream


def ids(df):
    return [r["id"] for r in df.collect()]


def test_life_of_a_store(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    with MemoryStore(spark, path, 2) as s:
        a, b = s.add_many([{"content": "a", "embedding": [1, 0]}, {"content": "b", "embedding": [0, 1]}])
        s.connect(a, b, "r")
        before = s.snapshot()
        assert s.checkpoint() == 1
        c = s.add("c", [1, 1], {"k": "v"}, "other")
        s.delete(a)
        assert (a, b, c) == (1, 2, 3) and sorted(ids(s.memories())) == [2, 3] and s.edges().count() == 0
        assert before.edges.count() == 1 and len(s) == 2  # a snapshot stays as it was
        with pytest.raises(errors.CrossCollectionError):
            s.connect(b, c, "r")
        with pytest.raises(errors.NotFoundError):
            s.delete(99)
        with pytest.raises(errors.DimensionMismatchError):
            s.add("x", [1])
        with pytest.raises(errors.StorageError):
            MemoryStore(spark, path)
    with MemoryStore(spark, path) as s:
        assert s.stats() == {"entries": 2, "indexed_embeddings": 2, "wal_length": 2, "vector_dimension": 2, "storage_version": 1}
        assert s.compact() == 2 and s.stats()["wal_length"] == 0 and s.add("d", [0, 0]) == 4
        assert bytes(s.get(3)["content"]) == b"c" and s.get(3)["metadata"] == {"k": "v"}
    with pytest.raises(errors.DimensionMismatchError):
        MemoryStore(spark, path, 3, read_only=True)


def test_upsert_bulk_and_capacity(spark, tmp_path):
    row = lambda i, text, e: (i, "a", bytearray(text), e, {}, i, 0.0)
    with MemoryStore(spark, f"file://{tmp_path}/db", 1, limit=Capacity(max_entries=5)) as s:
        bulk = spark.range(8).select("id", F.lit("a").alias("collection"), F.lit(b"x").alias("content"), F.array(F.lit(1.0).cast("float")).alias("embedding"), F.create_map().cast("map<string,string>").alias("metadata"), F.col("id").alias("created_at"), F.lit(0.0).cast("float").alias("importance"))
        assert s.add_table(bulk.withColumnRenamed("id", "k"), "k") == (1, 9)
        assert sorted(ids(s.memories())) == [4, 5, 6, 7, 8]
        assert s.upsert(spark.createDataFrame([row(8, b"new", None), row(7, b"x", None)], MEMORY_SCHEMA)) == [8]
        assert s.get(7)["embedding"] == [1.0] and bytes(s.get(8)["content"]) == b"x"


def test_sync_policies(spark, tmp_path):
    with pytest.raises(errors.ConfigError):
        SyncPolicy.of("often")
    with MemoryStore(spark, f"file://{tmp_path}/db", 1, SyncPolicy("async", 100, 3600)) as s:
        s.add("a", [1])
        assert len(s) == 0
        s.flush()
        assert len(s) == 1
    with MemoryStore(spark, f"file://{tmp_path}/timed", 1, SyncPolicy("batch", 100, 0.1)) as s:
        s.add("a", [1])
        for _ in range(300):  # no further call commits it, the timer does
            if s._log_ends():
                break
            time.sleep(0.1)
        assert len(s) == 1


def test_a_broken_checkpoint_leaves_the_store_readable(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/db"
    with MemoryStore(spark, path, 1) as s:
        s.add("a", [1])
        s.checkpoint()
        s.add("b", [1])
        with monkeypatch.context() as m:
            m.setattr(s, "_write", lambda *_: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                s.checkpoint()
        assert sorted(ids(MemoryStore(spark, path, read_only=True).memories())) == [1, 2]
        assert s.checkpoint() == 2 and len(s) == 2
        plan = s.memories().where("collection = 'default'")._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [(coalesce(collection" in plan


def test_log_over_a_checkpoint(spark, tmp_path):
    with MemoryStore(spark, f"file://{tmp_path}/db", 1, limit=Capacity(max_entries=4)) as s:
        a, b, c = s.add_many([{"content": x, "embedding": [1]} for x in "abc"])
        s.connect(a, b, "r"), s.connect(b, c, "r"), s.connect(a, c, "x")
        s.checkpoint()
        s.disconnect(a, b)
        s.connect(a, c, "y"), s.connect(a, c, "x")
        assert sorted(tuple(r) for r in s.edges().collect()) == [(a, c, "x"), (a, c, "y"), (b, c, "r")]
        s.delete(b)
        assert sorted(tuple(r) for r in s.edges().collect()) == [(a, c, "x"), (a, c, "y")]
        with pytest.raises(errors.DimensionMismatchError):
            s.upsert(s.memories().withColumn("embedding", F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>")))
        assert s.last_eviction.evicted == []
        s.add_many([{"content": x, "embedding": [1], "created_at": 10**10} for x in "defg"])
        assert s.last_eviction.evicted == [a, c] and s._usage[0] == len(s) == 4


def test_client(spark, tmp_path):
    log = str(tmp_path / "ops.log")
    with Client.open(spark, f"file://{tmp_path}/db", embedder=HashEmbedder(8), record=log) as c:
        a = c.add("hello", metadata={"k": "1"})
        b = c.collection("notes").add("world")
        x, y = c.add_batch([{"text": "p"}, {"text": "q", "metadata": {"k": "1"}}])
        c.connect(a, x, "next")
        assert ids(c.search("hello", limit=1)) == [a] and ids(c.search("world", collection="notes")) == [b]
        assert sorted(ids(c.query("hello").limit(5).filter(k="1").execute())) == [a, y]
        assert c.get_neighbors(a) == [(x, "next")] and len(c) == 4
        new = c.ingest('{"u": {"n": 1}, "w": 2}', strategy="json", metadata={"key": "mine"}, collection="j")
        assert [c.get(i)["metadata"]["key"] for i in new] == ["u.n", "w"]
        with pytest.raises(errors.MemoryStoreError):
            c.collection("notes", readonly=True).add("x")
        with pytest.raises(TypeError):
            c.search("x", wrong=1)
        c.delete(b)
        report = c.export_replay(f"file://{tmp_path}/out")
        assert report["exported"] == 5 and report["skipped_missing_embedding"] == 0
    again = Client.replay(spark, f"file://{log}", f"file://{tmp_path}/again")
    assert len(again) == 5 and again.last_replay_report["op_counts"] == {"add": 6, "connect": 1, "delete": 1}
    assert again.store.edges().count() == 1
    again.close()
    exported = Client.replay(spark, f"file://{tmp_path}/out", f"file://{tmp_path}/third")
    assert len(exported) == 5
    exported.close()


def test_open_needs_one_of_dimension_and_embedder(spark, tmp_path):
    for o in ({}, {"dimension": 2, "embedder": HashEmbedder(2)}):
        with pytest.raises(errors.ConfigError):
            Client.open(spark, f"file://{tmp_path}/db", **o)
    assert parse_index_mode("HNSW")["type"] == "hnsw" and parse_index_mode({"type": "exact", "metric": "l2sq"})["metric"] == "l2"
    with pytest.raises(errors.ConfigError):
        parse_index_mode("magic")


def test_replay_failures(spark, tmp_path):
    lines = [{"any_replay": "1.0", "dimension": 2}, {"op": "add", "id": 1, "embedding": [1.0, 0.0]}, {"op": "what"}, {"op": "add", "id": 2}, {"op": "connect", "from_id": 1, "to_id": 2, "relation": "r"}]
    (tmp_path / "log").write_text("\n".join(map(json.dumps, lines)) + "\n\n")
    path = f"file://{tmp_path}/log"
    with pytest.raises(errors.MemoryStoreError):
        Client.replay(spark, path, f"file://{tmp_path}/a")
    c = Client.replay(spark, path, f"file://{tmp_path}/b", strict=False)
    assert c.last_replay_report == {"checked": 4, "exported": 1, "skipped": 3, "failed": 1, "op_counts": {"add": 2, "what": 1, "unknown": 1, "connect": 1}}
    c.close()
    torn = lines[:2] + [{"op": "add", "id": 5, "embedding": [0.0, 1.0]}, {"op": "delete", "id": 5}, {"op": "add", "id": 5, "embedding": [1.0, 1.0]}, {"op": "connect", "id1": 1, "id2": 5, "relation": "r"}, {"op": "delete", "id": 77}]
    (tmp_path / "torn").write_text("\n".join(map(json.dumps, torn)) + '\n{"op": "ad\n' + json.dumps(torn[1]))
    c = Client.replay(spark, f"file://{tmp_path}/torn", f"file://{tmp_path}/c")
    assert c.last_replay_report == {"checked": 6, "exported": 5, "skipped": 1, "failed": 0, "op_counts": {"add": 3, "connect": 1, "delete": 2}, "torn": True}
    assert sorted(ids(c.store.memories())) == [1, 3] and [tuple(r) for r in c.store.edges().collect()] == [(1, 3, "r")]
    c.close()
    with pytest.raises(errors.StorageError):
        replay.parse_header('{"x_replay": "2.0", "dimension": 2}')
    with pytest.raises(errors.StorageError):
        replay.parse_header("[]")


def test_loaders(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.JSON").write_text('{"a":[1]}')
    assert loaders.load_file(spark, str(tmp_path / "a.txt")).collect()[0]["text"] == "one\ntwo"
    assert loaders.load_file(spark, str(tmp_path / "b.JSON")).collect()[0]["text"] == '{\n  "a": [\n    1\n  ]\n}'
    r = loaders.file_metadata(spark, str(tmp_path / "a.txt")).collect()[0]
    assert (r["filename"], r["file_size"], r["extension"]) == ("a.txt", 7, ".txt")
    with pytest.raises(errors.ConfigError):
        loaders.load_file(spark, "x.exe")
    with pytest.raises(FileNotFoundError):
        loaders.load_file(spark, str(tmp_path / "none.txt"))


def test_stream_of_commands(spark, tmp_path):
    m = lambda i: (i, "a", bytearray(b""), None, {}, i, 0.0)
    rows = [(k, "add", k, m(k), None, None, None) for k in (1, 2, 3)] + [(4, "connect", None, None, 1, 2, "r"), (5, "delete", 3, None, None, None, None)]
    spark.createDataFrame(rows, COMMAND_SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    with MemoryStore(spark, f"file://{tmp_path}/db", 1) as s:
        q = command_stream.into_store(command_stream.read_commands(spark, f"{tmp_path}/in"), s, f"{tmp_path}/check")
        q.awaitTermination(120)
        assert sorted(ids(s.memories())) == [1, 2] and s.edges().count() == 1
        again = spark.read.parquet(f"{tmp_path}/in")
        assert s.apply_commands(again, (f"{tmp_path}/check", 0)) == 0  # a batch that is sent again
        s.checkpoint()
        assert s.apply_commands(again, (f"{tmp_path}/check", 0)) == 0


def test_index_modes(spark, tmp_path):
    with Client.open(spark, f"file://{tmp_path}/db", dimension=2) as c:
        first = c.add_batch([{"text": str(k), "vector": [1.0, k / 10]} for k in range(12)])[0]
        exact = ids(c.search(vector=[1.0, 0.0], limit=3))
        assert exact[0] == first
        for mode in ("prefix", {"type": "hnsw", "probes": 99}):
            c.set_index_mode(mode)
            assert ids(c.search(vector=[1.0, 0.0], limit=3)) == exact
        built = c._inverted
        c.search(vector=[1.0, 0.0], limit=3)
        assert c._inverted is built
        c.set_index_mode({"type": "exact", "metric": "l2"})
        far = c.add(vector=[0.9, 0.0])
        assert ids(c.search(vector=[0.9, 0.0], limit=2)) == [far, first] and ids(c.search(vector=[1.0, 0.0], limit=1)) == [first]


def test_valid_prefix_of_a_torn_log(spark, tmp_path):
    lines = ['{"x_replay":"1.0","dimension":1}', '{"op":"add","id":1}', '{"op":"add","id":2}', '{"op":"ad', '{"op":"add","id":3}']
    (tmp_path / "log").write_text("\n".join(lines))
    ops = replay.read_operations(spark, f"file://{tmp_path}/log")
    assert ops.count() == 4 and ids(replay.valid_prefix(ops)) == [1, 2]
