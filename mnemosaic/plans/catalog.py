"""All queries of the core by name, and the SQL to compare them with.

Queries run over the whole memories and edges. Scores are rounded to 6 digits
in both, as sums in another order differ in the last ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunking, embedders
from ..operators import capacity, changefeed, combined, graph, hybrid, ivf, mutations, orphans, temporal, vector_search
from ..operators.vector_search import top
from ..runtime import numbered, read_table
from ..sources.commands import log_commands
from ..sources.tables import EDGES_SQL, MEMORIES_SQL, edges, memories
from .options import Anchors, Options, Weights, infer_intent

Query = Callable[[SparkSession, str], DataFrame]
START, END = 1_710_000_000, 1_740_000_000
NOW = 1_760_000_000

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return register


def _mem(body: str) -> str:
    return f"WITH {MEMORIES_SQL} {body}"


def _edg(body: str, more: str = "") -> str:
    return f"WITH {MEMORIES_SQL}, {EDGES_SQL}{more} {body}"


def _r(name: str = "score"):
    return F.round(name, 6).alias(name)


# The query vector: that of the first memory with one; the driver of an application has it as a parameter.
_Q = "(SELECT embedding FROM mem WHERE embedding IS NOT NULL ORDER BY id LIMIT 1)"
_COS = f"CASE WHEN list_dot_product(embedding, embedding) > 0 THEN list_dot_product(embedding, {_Q}) / sqrt(list_dot_product(embedding, embedding) * list_dot_product({_Q}, {_Q})) ELSE 0 END"
_SCORED = f", scored AS (SELECT *, {_COS} AS cos FROM mem WHERE embedding IS NOT NULL)"
_SIM = "least(1, greatest(0, (cos + 1) * 0.5))"
_START = "(SELECT src FROM edg GROUP BY src ORDER BY count(*) DESC, src LIMIT 1)"
_COLL = "(SELECT collection FROM mem GROUP BY collection ORDER BY count(*) DESC, collection LIMIT 1)"
_COLL_OF_START = f"(SELECT collection FROM mem WHERE id = {_START})"


def _vector(m: DataFrame) -> list[float]:
    return list(m.where("embedding IS NOT NULL").orderBy("id").limit(1).select("embedding").collect()[0][0])


def _start(e: DataFrame) -> int:
    return e.groupBy("src").count().orderBy(F.desc("count"), "src").limit(1).collect()[0][0]


def _collection(m: DataFrame) -> str:
    return m.groupBy("collection").count().orderBy(F.desc("count"), "collection").limit(1).collect()[0][0]


# Scans ------------------------------------------------------------------------


@query(_mem("SELECT id, collection, octet_length(content)::INT AS content_bytes, created_at, round(importance, 6) AS importance FROM mem"))
def scan_memories(spark, d):
    return memories(spark, d).select("id", "collection", F.octet_length("content").alias("content_bytes"), "created_at", _r("importance"))


@query(_mem("SELECT id, collection, hex(content) AS content, round(list_sum(embedding), 4) AS embedding_sum, list_aggregate(list_sort(list_transform(map_entries(metadata), lambda e: e.key || '=' || e.value)), 'string_agg', ',') AS metadata, created_at, round(importance, 6) AS importance FROM mem WHERE id = 42"))
def get_memory(spark, d):
    """All seven fields of one memory."""
    pairs = F.array_join(F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    total = F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 4)
    return memories(spark, d).where("id = 42").select("id", "collection", F.hex("content").alias("content"), total.alias("embedding_sum"), F.when(F.size("metadata") > 0, pairs).alias("metadata"), "created_at", _r("importance"))


@query(_mem(f"SELECT id, collection FROM mem WHERE collection = {_COLL}"))
def scan_collection(spark, d):
    m = memories(spark, d)
    return m.where(F.col("collection") == _collection(m)).select("id", "collection")


@query(_mem("SELECT id, collection FROM mem WHERE id = 42"))
def collection_of(spark, d):
    return memories(spark, d).where("id = 42").select("id", "collection")


@query(_mem("SELECT count(*) AS entries, count(embedding) AS indexed_embeddings, (SELECT count(DISTINCT command_id) FROM replay_log) AS wal_length, max(len(embedding))::INT AS vector_dimension, 1 AS storage_version FROM mem"))
def stats(spark, d):
    s = memories(spark, d).agg(F.count(F.lit(1)).alias("entries"), F.count("embedding").alias("indexed_embeddings"), F.max(F.size("embedding")).alias("vector_dimension"))
    return s.crossJoin(read_table(spark, d, "replay_log").agg(F.countDistinct("command_id").alias("wal_length"))).withColumn("storage_version", F.lit(1))


@query(_mem("SELECT collection, count(*) AS n, max(id) AS max_id FROM mem GROUP BY collection"))
def collections(spark, d):
    return memories(spark, d).groupBy("collection").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("max_id"))


# Filters ----------------------------------------------------------------------


@query(_mem("SELECT id FROM mem WHERE metadata['lang'] = 'en' AND metadata['source'] = 'chat'"))
def filter_metadata(spark, d):
    return memories(spark, d).where(hybrid.metadata_matches({"lang": "en", "source": "chat"})).select("id")


@query(_mem(f"SELECT id, created_at FROM mem WHERE created_at BETWEEN {START} AND {END}"))
def filter_time_range(spark, d):
    return temporal.in_range(memories(spark, d), START, END).select("id", "created_at")


@query(_mem(f"SELECT id FROM mem WHERE metadata['lang'] = 'en' AND created_at BETWEEN {START} AND {END} AND collection = {_COLL}"))
def filter_meta_time_coll(spark, d):
    m = memories(spark, d)
    return temporal.in_range(m.where(F.col("collection") == _collection(m)), START, END).where(hybrid.metadata_matches({"lang": "en"})).select("id")


@query(_mem(f"{_SCORED} SELECT id, round(cos, 6) AS score FROM (SELECT * FROM scored ORDER BY cos DESC, id LIMIT 100) WHERE metadata['lang'] = 'en'"))
def filter_after_top(spark, d):
    m = memories(spark, d)
    return top(vector_search.scored(m, _vector(m)), 100).where(hybrid.metadata_matches({"lang": "en"})).select("id", _r())


@query(_mem("SELECT id FROM mem WHERE id NOT IN (SELECT memory_id FROM tombstones WHERE memory_id IS NOT NULL)"))
def live_memories(spark, d):
    return vector_search.live(memories(spark, d), read_table(spark, d, "tombstones").select(F.col("memory_id").alias("id"))).select("id")


# Vectors ----------------------------------------------------------------------


@query(_mem(f"{_SCORED} SELECT id, round(cos, 6) AS score FROM scored ORDER BY cos DESC, id LIMIT 10"))
def vec_knn_exact(spark, d):
    m = memories(spark, d)
    return vector_search.knn(m, _vector(m), 10).select("id", _r())


@query(_mem(f"{_SCORED} SELECT id, round(cos, 6) AS score FROM scored WHERE collection = {_COLL} ORDER BY cos DESC, id LIMIT 10"))
def vec_knn_collection(spark, d):
    m = memories(spark, d)
    return vector_search.knn(m, _vector(m), 10, _collection(m)).select("id", _r())


@query(_mem(f"{_SCORED} SELECT id, round(cos, 6) AS score FROM scored WHERE id IN (SELECT memory_id FROM hits) ORDER BY cos DESC, id LIMIT 10"))
def vec_knn_in_ids(spark, d):
    m = memories(spark, d)
    return vector_search.knn_in_ids(m, _vector(m), read_table(spark, d, "hits").select(F.col("memory_id").alias("id")), 10).select("id", _r())


@query(_mem(f"SELECT id, round(1 - list_distance(embedding, {_Q}) ** 2, 6) AS score FROM mem WHERE embedding IS NOT NULL ORDER BY list_distance(embedding, {_Q}), id LIMIT 10"))
def vec_knn_l2(spark, d):
    m = memories(spark, d)
    return vector_search.knn(m, _vector(m), 10, metric="l2").select("id", _r())


@query(
    _mem(
        f"""{_SCORED}, short AS (SELECT *, embedding[1:8] AS s, {_Q}[1:8] AS sq FROM scored)
SELECT id, round(cos, 6) AS score FROM (SELECT * FROM short ORDER BY CASE WHEN list_dot_product(s, s) > 0 THEN list_dot_product(s, sq) / sqrt(list_dot_product(s, s) * list_dot_product(sq, sq)) ELSE 0 END DESC, id LIMIT 70) ORDER BY cos DESC, id LIMIT 10"""
    )
)
def vec_prefix_ann(spark, d):
    m = memories(spark, d)
    return vector_search.prefix_knn(m, _vector(m), 10).select("id", _r())


def _batch_queries(m: DataFrame) -> DataFrame:
    """One query in fifty, chosen by id: the stated query set of the searches."""
    return m.where("embedding IS NOT NULL AND id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")


@query(
    _mem(
        """, v AS (SELECT id, list_transform(embedding, lambda x: x / CASE WHEN list_dot_product(embedding, embedding) > 0 THEN sqrt(list_dot_product(embedding, embedding)) ELSE 1 END) AS e FROM mem WHERE embedding IS NOT NULL)
SELECT query_id, id, round(score, 6) AS score FROM (SELECT a.id AS query_id, b.id, list_dot_product(a.e, b.e) AS score, row_number() OVER (PARTITION BY a.id ORDER BY round(list_dot_product(a.e, b.e), 9) DESC, b.id) AS r FROM v a JOIN v b ON a.id % 50 = 0) WHERE r <= 10"""
    )
)
def vec_knn_batch(spark, d):
    m = memories(spark, d)
    return vector_search.knn_batch(m, _batch_queries(m), 10).select("query_id", "id", _r())


@query()
def vec_ann_recall(spark, d):
    """Recall of the inverted file, with the cells and probes that the client takes, against exact search, over the stated queries."""
    m = memories(spark, d)
    index = ivf.InvertedFile.build(m)
    queries = _batch_queries(m)
    return vector_search.recall(vector_search.knn_batch(m, queries, 10), index.search_batch(queries, 10), 10)


@query(_mem("SELECT count(*) AS n, count(embedding) AS with_embedding, (SELECT round(sum(sqrt(list_dot_product(embedding, embedding))), 4) FROM mem WHERE embedding IS NOT NULL) AS magnitudes FROM mem"))
def vec_index_stats(spark, d):
    from ..functions.vector import magnitude

    return memories(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count("embedding").alias("with_embedding"), F.round(F.sum(F.coalesce(magnitude(F.col("embedding")), F.lit(0.0))), 4).alias("magnitudes"))


@query(_mem(", gone AS (SELECT DISTINCT memory_id FROM tombstones) SELECT collection, count(*) FILTER (memory_id IS NULL) AS live, count(memory_id) AS deleted, count(memory_id) / count(*)::DOUBLE > 0.2 AS compactable FROM mem LEFT JOIN gone ON memory_id = id GROUP BY collection"))
def segment_live_ratio(spark, d):
    """Live and deleted rows of each collection, and whether it is worth rewriting."""
    return vector_search.stale_share(memories(spark, d), read_table(spark, d, "tombstones").select(F.col("memory_id").alias("id")))


@query(_mem("SELECT id, 'not in hits' AS side FROM mem WHERE embedding IS NOT NULL AND id NOT IN (SELECT memory_id FROM hits WHERE memory_id IS NOT NULL) UNION ALL SELECT DISTINCT memory_id, 'not in index' FROM hits WHERE memory_id IS NOT NULL AND memory_id NOT IN (SELECT id FROM mem WHERE embedding IS NOT NULL)"))
def index_difference(spark, d):
    """Ids of the vector index that were never hit, and hits that the index does not hold."""
    index = memories(spark, d).where("embedding IS NOT NULL").select("id")
    hit = read_table(spark, d, "hits").where("memory_id IS NOT NULL").select(F.col("memory_id").alias("id"))
    return vector_search.difference(index, hit, "not in hits", "not in index")


# Graph ------------------------------------------------------------------------


def _reach_sql(seeds: str, hops: int, edge: str = "edg") -> str:
    parts = [f", h0 AS ({seeds})"]
    for h in range(1, hops + 1):
        parts.append(f", h{h} AS (SELECT id FROM h{h - 1} UNION SELECT e.dst FROM {edge} e JOIN h{h - 1} ON e.src = h{h - 1}.id)")
    return "".join(parts)


def _hops_sql(hops: int) -> str:
    cases = " ".join(f"WHEN id IN (SELECT id FROM h{h}) THEN {h}" for h in range(hops + 1))
    return f"SELECT id, (CASE {cases} END)::INT AS hops FROM h{hops}"


@query(_edg(f"SELECT dst, relation FROM edg WHERE src = {_START}"))
def graph_neighbors(spark, d):
    e = edges(spark, d)
    return graph.neighbours(e, _start(e))


@query(_edg(f"SELECT dst AS id FROM edg WHERE src = {_START}"))
def graph_neighbor_ids(spark, d):
    e = edges(spark, d)
    return graph.neighbour_ids(e, _start(e))


@query(_edg(f"SELECT src, dst, relation FROM edg WHERE NOT (src = {_START} AND dst = (SELECT min(dst) FROM edg WHERE src = {_START}))"))
def graph_disconnect(spark, d):
    """All edges but those from the busiest memory to its smallest neighbour."""
    e = edges(spark, d)
    start = _start(e)
    return graph.disconnect(e, start, graph.neighbours(e, start).first()["dst"])


@query(_edg("SELECT count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT relation) AS relations FROM edg"))
def graph_stats(spark, d):
    return edges(spark, d).agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("src").alias("sources"), F.countDistinct("relation").alias("relations"))


@query(_edg(_hops_sql(2), _reach_sql(f"SELECT {_START} AS id", 2)))
def graph_bfs_2(spark, d):
    e = edges(spark, d)
    return graph.bfs(e, memories(spark, d), _start(e), 2)


@query(_edg(_hops_sql(3), f", inside AS (SELECT e.* FROM edg e JOIN mem a ON a.id = e.src AND a.collection = {_COLL_OF_START})" + _reach_sql(f"SELECT {_START} AS id", 3, "inside")))
def graph_bfs_collection(spark, d):
    e, m = edges(spark, d), memories(spark, d)
    start = _start(e)
    where = m.where(F.col("id") == start).select("collection").collect()[0][0]
    return graph.bfs(e, m, start, 3, where)


@query(
    _edg(
        "SELECT path FROM p0 UNION ALL SELECT path FROM p1 UNION ALL SELECT path FROM p2 UNION ALL SELECT path FROM p3",
        f", p0 AS (SELECT {_START} AS node, [{_START}] AS ids, {_START}::VARCHAR AS path)"
        + "".join(f", p{k} AS (SELECT e.dst AS node, list_append(ids, e.dst) AS ids, path || '>' || e.dst AS path FROM p{k - 1} p JOIN edg e ON e.src = p.node WHERE NOT list_contains(ids, e.dst))" for k in (1, 2, 3)),
    )
)
def graph_dfs_3(spark, d):
    e = edges(spark, d)
    return graph.simple_paths(e, _start(e), 3).select(graph.joined_path(F.col("path")).alias("path"))


_FAR = "(SELECT max(id) FROM h3)"


@query(
    _edg(
        f"SELECT path FROM (SELECT path, ids, node FROM p0 UNION ALL SELECT path, ids, node FROM p1 UNION ALL SELECT path, ids, node FROM p2 UNION ALL SELECT path, ids, node FROM p3) WHERE node = {_FAR} ORDER BY len(ids), ids LIMIT 1",
        _reach_sql(f"SELECT {_START} AS id", 3)
        + f", p0 AS (SELECT {_START} AS node, [{_START}] AS ids, {_START}::VARCHAR AS path)"
        + "".join(f", p{k} AS (SELECT e.dst AS node, list_append(ids, e.dst) AS ids, path || '>' || e.dst AS path FROM p{k - 1} p JOIN edg e ON e.src = p.node WHERE NOT list_contains(ids, e.dst))" for k in (1, 2, 3)),
    )
)
def graph_shortest_path(spark, d):
    e = edges(spark, d)
    start = _start(e)
    far = graph.reach(e, spark.createDataFrame([(start,)], "id long"), 3).agg(F.max("id")).collect()[0][0]
    path = graph.shortest_path(e, start, far)
    return spark.createDataFrame([(">".join(map(str, path)),)], "path string")


@query(_edg("SELECT id FROM h3", _reach_sql(f"SELECT {_START} AS id", 3)))
def graph_reachable(spark, d):
    e = edges(spark, d)
    return graph.reachable(e, memories(spark, d), _start(e), 3)


@query(_edg(_hops_sql(2), _reach_sql("SELECT DISTINCT id FROM mem WHERE id IN (SELECT memory_id FROM hits)", 2)))
def graph_multi_bfs(spark, d):
    seeds = memories(spark, d).select("id").join(read_table(spark, d, "hits").select(F.col("memory_id").alias("id")), "id", "left_semi")
    return graph.reach(edges(spark, d), seeds, 2)


@query(
    _mem(
        """, raw AS (SELECT DISTINCT src, dst, coalesce(lower(trim(relation)), 'related') AS relation FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL)
SELECT CASE WHEN a.collection IS NULL OR b.collection IS NULL THEN 'missing end' WHEN a.collection <> b.collection THEN 'two collections' ELSE 'accepted' END AS outcome, count(*) AS n
FROM raw LEFT JOIN mem a ON a.id = src LEFT JOIN mem b ON b.id = dst GROUP BY 1"""
    )
)
def edges_dedup_connect(spark, d):
    new = read_table(spark, d, "edges").where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst", F.coalesce(F.lower(F.trim("relation")), F.lit("related")).alias("relation"))
    none = spark.createDataFrame([], "src long, dst long, relation string")
    accepted, rejected = graph.connectable(none, memories(spark, d), new)
    return accepted.select(F.lit("accepted").alias("outcome")).unionByName(rejected.select(F.col("reason").alias("outcome"))).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


# Time -------------------------------------------------------------------------


@query(_mem(f"SELECT id FROM mem WHERE created_at BETWEEN {START} AND {END}"))
def time_range(spark, d):
    return temporal.range_ids(memories(spark, d), START, END)


@query(_mem(f"SELECT count(*) AS n FROM mem WHERE created_at BETWEEN {START} AND {END}"))
def time_count(spark, d):
    return temporal.count_in_range(memories(spark, d), START, END)


@query(_mem("SELECT min(created_at) AS earliest, max(created_at) AS latest FROM mem"))
def time_bounds(spark, d):
    return temporal.bounds(memories(spark, d))


@query(_mem(f"SELECT id FROM mem WHERE created_at < {START}"))
def time_evict_before(spark, d):
    return temporal.before(memories(spark, d), START)


@query(_mem(f"SELECT id FROM mem WHERE created_at >= {END}"))
def time_recent(spark, d):
    return temporal.recent(memories(spark, d), END)


@query(_mem("SELECT id, created_at FROM mem ORDER BY created_at, id LIMIT 25"))
def time_oldest(spark, d):
    return temporal.oldest(memories(spark, d), 25)


@query(_mem("SELECT id, created_at FROM mem ORDER BY created_at DESC, id LIMIT 25"))
def time_newest(spark, d):
    return temporal.newest(memories(spark, d), 25)


# Combined ---------------------------------------------------------------------


@query(_mem(f"{_SCORED} SELECT id, round(cos, 6) AS score FROM scored WHERE created_at BETWEEN {START} AND {END} ORDER BY cos DESC, id LIMIT 10"))
def comb_range(spark, d):
    m = memories(spark, d)
    return combined.similar_in_range(m, _vector(m), START, END, 10).select("id", _r())


@query(_edg("SELECT id, round(cos, 6) AS score FROM scored WHERE id IN (SELECT id FROM h2) ORDER BY cos DESC, id LIMIT 10", _SCORED + _reach_sql(f"SELECT {_START} AS id", 2)))
def comb_connected(spark, d):
    m, e = memories(spark, d), edges(spark, d)
    return combined.similar_connected(m, e, _vector(m), _start(e), 2, 10).select("id", _r())


@query(_edg(f"SELECT id, round(cos, 6) AS score FROM scored WHERE id IN (SELECT id FROM h3) AND created_at BETWEEN {START} AND {END} ORDER BY cos DESC, id LIMIT 10", _SCORED + _reach_sql(f"SELECT {_START} AS id", 3)))
def comb_three_way(spark, d):
    m, e = memories(spark, d), edges(spark, d)
    return combined.similar_in_range_connected(m, e, _vector(m), START, END, _start(e), 3, 10).select("id", _r())


def _weighted_sql(v: float, r: float, p: float) -> str:
    return _edg(
        f"""SELECT id, round(s * {v} + CASE WHEN hi = lo THEN 1.0 ELSE (created_at - lo)::DOUBLE / (hi - lo) END * {r} + p * {p}, 6) AS score
FROM c, (SELECT min(created_at) AS lo, max(created_at) AS hi FROM c) ORDER BY score DESC, id LIMIT 10""",
        _SCORED + _reach_sql(f"SELECT {_START} AS id", 3) + f", near AS ({_hops_sql(3)}), c AS (SELECT id, created_at, {_SIM} AS s, 1 - hops / 3.0::DOUBLE AS p FROM scored JOIN near USING (id) WHERE created_at BETWEEN {START} AND {END})",
    )


@query(_weighted_sql(0.3, 0.3, 0.4))
def comb_weighted_given(spark, d):
    m, e = memories(spark, d), edges(spark, d)
    return combined.weighted_in_range_connected(m, e, _vector(m), START, END, _start(e), 3, 10, combined.RankingWeights(30, 30, 40)).select("id", _r())


@query(
    _edg(
        """SELECT id, round(s * 0.7 + CASE WHEN hi = lo THEN 1.0 ELSE (created_at - lo)::DOUBLE / (hi - lo) END * 0.2 + p * 0.1, 6) AS score
FROM c, (SELECT min(created_at) AS lo, max(created_at) AS hi FROM c) ORDER BY score DESC, id LIMIT 10""",
        _SCORED + _reach_sql(f"SELECT {_START} AS id", 3) + f", near AS ({_hops_sql(3)}), c AS (SELECT id, created_at, {_SIM} AS s, 1 - hops / 3.0::DOUBLE AS p FROM scored JOIN near USING (id) WHERE created_at BETWEEN {START} AND {END})",
    )
)
def comb_weighted(spark, d):
    m, e = memories(spark, d), edges(spark, d)
    return combined.weighted_in_range_connected(m, e, _vector(m), START, END, _start(e), 3, 10).select("id", _r())


# Hybrid -----------------------------------------------------------------------


def _hybrid_sql(candidates: int, time: bool = False, hops: int = 0, weighted: bool = False, k: int = 10, coll: str | None = None, meta: str = "", tie: str = "") -> str:
    inside = f" WHERE collection = {coll}" if coll else ""
    where = " AND ".join(x for x in (f"created_at BETWEEN {START} AND {END}" if time else "", meta) if x) or "true"
    edge = f", inside AS (SELECT e.* FROM edg e JOIN mem a ON a.id = e.src AND a.collection = {coll})" if coll else ""
    ctes = f"{_SCORED}{edge}, best AS (SELECT * FROM scored{inside} ORDER BY cos DESC, id LIMIT {candidates}), kept AS (SELECT * FROM best WHERE {where})"
    if hops:
        ctes += _reach_sql("SELECT id FROM kept", hops, "inside" if coll else "edg") + f", c AS (SELECT * FROM scored WHERE id IN (SELECT id FROM h{hops}) AND {meta or 'true'}{f' AND collection = {coll}' if coll else ''})"
    else:
        ctes += ", c AS (SELECT * FROM kept)"
    final = f"{_SIM} * 0.7 + least(1, greatest(0, importance)) * 0.2 + CASE WHEN hi = lo THEN 1.0 ELSE (created_at - lo)::DOUBLE / (hi - lo) END * 0.1" if weighted else _SIM
    return _edg(f"SELECT id, round(final, 6) AS score FROM (SELECT id, {final} AS final, {_SIM} AS sim FROM c, (SELECT min(created_at) AS lo, max(created_at) AS hi FROM c)) ORDER BY final DESC, {tie} id LIMIT {k}", ctes)


def _hyb(spark, d, options: Options) -> DataFrame:
    m = memories(spark, d)
    found = hybrid.search(m, edges(spark, d), _vector(m), options)
    return found.hits.select("id", F.round("final_score", 6).alias("score"))


@query(_hybrid_sql(30))
def hyb_vector_only(spark, d):
    return _hyb(spark, d, Options(hops=0))


@query(_hybrid_sql(40, time=True))
def hyb_vector_temporal(spark, d):
    return _hyb(spark, d, Options(hops=0, time_range=(START, END)))


@query(_hybrid_sql(50, hops=1))
def hyb_vector_graph(spark, d):
    return _hyb(spark, d, Options(hops=1))


@query(_hybrid_sql(60, time=True, hops=1, weighted=True))
def hyb_weighted(spark, d):
    return _hyb(spark, d, Options(hops=1, time_range=(START, END)))


@query(_hybrid_sql(60, time=True, hops=2, weighted=True, meta="metadata['lang'] = 'en'"))
def hyb_weighted_metadata(spark, d):
    return _hyb(spark, d, Options(hops=2, time_range=(START, END), metadata={"lang": "en"}))


@query(_hybrid_sql(30, weighted=True, tie="sim DESC,"))
def hyb_always_weighted(spark, d):
    return _hyb(spark, d, Options(hops=0, always_weighted=True, weights=Weights(70, 20, 10)))


@query(_hybrid_sql(200, hops=1, coll=_COLL))
def hyb_collection(spark, d):
    m = memories(spark, d)
    return hybrid.facade_search(m, edges(spark, d), _vector(m), 10, _collection(m)).select("id", _r())


_INTENT = """
, v AS (SELECT id, embedding AS e, row_number() OVER (ORDER BY id) AS r FROM mem WHERE embedding IS NOT NULL),
a AS (SELECT r, e FROM v WHERE r <= 3),
near AS (SELECT v.id, least(1, greatest(0, (list_cosine_similarity(v.e, x.e) + 1) / 2)) AS s, least(1, greatest(0, (list_cosine_similarity(v.e, y.e) + 1) / 2)) AS c, least(1, greatest(0, (list_cosine_similarity(v.e, z.e) + 1) / 2)) AS g
  FROM v, a x, a y, a z WHERE x.r = 1 AND y.r = 2 AND z.r = 3 AND v.r BETWEEN 4 AND 203 AND list_dot_product(v.e, v.e) > 1e-6)
SELECT id, floor(80 * s / (s + c) + 0.5)::INT AS similarity, 20 AS importance, 80 - floor(80 * s / (s + c) + 0.5)::INT AS recency, CASE WHEN g >= 0.8 THEN 3 WHEN g >= 0.55 THEN 2 ELSE 1 END AS hops FROM near"""


@query(_mem(_INTENT))
def intent_cases(spark, d):
    """Weights and hops that 200 query vectors get by three anchors: the first memories with a vector are the anchors, the next ones the queries."""
    rows = memories(spark, d).where("embedding IS NOT NULL").orderBy("id").select("id", "embedding").limit(203).collect()
    anchors = Anchors(*(list(r["embedding"]) for r in rows[:3]))
    found = [(r["id"], infer_intent(list(r["embedding"]), anchors)) for r in rows[3:]]
    return spark.createDataFrame([(i, x.weights.similarity, x.weights.importance, x.weights.recency, x.hops) for i, x in found if x], "id long, similarity int, importance int, recency int, hops int")


# Client -----------------------------------------------------------------------

_FACADE = _hybrid_sql(25, hops=1, k=5)


def _client_sql(select: str) -> str:
    return _FACADE.replace("SELECT id, round(final, 6) AS score FROM (", "SELECT id, final AS score FROM (").replace(" SELECT id, final AS score", ", hit AS (SELECT id, final AS score", 1) + ") " + select


@query(_client_sql("SELECT id, round(max(score), 6) AS score FROM (SELECT * FROM hit UNION ALL SELECT e.dst, greatest(score * 0.9, 0) FROM hit JOIN edg e ON e.src = hit.id) GROUP BY id ORDER BY max(score) DESC, id LIMIT 5"))
def client_graph_boost(spark, d):
    m = memories(spark, d)
    return hybrid.client_search(m, edges(spark, d), _vector(m), 5, use_graph=True).select("id", _r())


@query(_client_sql(f"SELECT id, round(score * (1 + 0.2 * pow(0.5, greatest(0, {NOW} - created_at) / 2592000.0::DOUBLE)), 6) AS score FROM hit JOIN mem USING (id) ORDER BY score DESC, id"))
def client_recency_boost(spark, d):
    m = memories(spark, d)
    return hybrid.client_search(m, edges(spark, d), _vector(m), 5, recency_bias=True, now=NOW).select("id", _r())


@query(
    _mem(
        f"""{_SCORED}, two AS (SELECT collection FROM mem GROUP BY collection ORDER BY count(*) DESC, collection LIMIT 2)
SELECT id, round(s, 6) AS score FROM (SELECT id, {_SIM} AS s, row_number() OVER (PARTITION BY collection ORDER BY cos DESC, id) AS r FROM scored WHERE collection IN (SELECT collection FROM two)) WHERE r <= 5 ORDER BY s DESC, id LIMIT 5"""
    )
)
def client_fanout(spark, d):
    """Without filters, expansion cannot change the best of a collection, so the SQL leaves it out."""
    m = memories(spark, d)
    two = [r[0] for r in m.groupBy("collection").count().orderBy(F.desc("count"), "collection").limit(2).collect()]
    return hybrid.client_search(m, edges(spark, d), _vector(m), 5, collections=two).select("id", _r())


# Capacity and state -----------------------------------------------------------

_BYTES = "octet_length(encode(collection)) + octet_length(content) + coalesce(len(embedding), 0) * 4 + coalesce(list_sum(list_transform(map_entries(metadata), lambda e: strlen(e.key) + coalesce(strlen(e.value), 0))), 0)"
_EVICT = f", sized AS (SELECT id, created_at, importance, {_BYTES} AS b FROM mem), o AS (SELECT id, count(*) OVER () - row_number() OVER w + 1 AS left_n, sum(b) OVER () - coalesce(sum(b) OVER (ORDER BY created_at, importance, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_b FROM sized WINDOW w AS (ORDER BY created_at, importance, id))"
MAX_ENTRIES, MAX_BYTES = 1_500, 800_000


@query(_mem(f"SELECT count(*) AS entries, sum({_BYTES})::BIGINT AS bytes FROM mem"))
def usage_bytes(spark, d):
    return capacity.usage(memories(spark, d))


@query(_mem(f"{_EVICT} SELECT id FROM o WHERE left_n > {MAX_ENTRIES}"))
def capacity_max_entries(spark, d):
    return capacity.evicted(memories(spark, d), capacity.Capacity(max_entries=MAX_ENTRIES))


@query(_mem(f"{_EVICT} SELECT id FROM o WHERE left_b > {MAX_BYTES}"))
def capacity_max_bytes(spark, d):
    return capacity.evicted(memories(spark, d), capacity.Capacity(max_bytes=MAX_BYTES))


@query(_mem("SELECT id, CASE WHEN id % 3 = 0 THEN 'moved' ELSE collection END AS collection, created_at, (embedding IS NOT NULL) AS indexed FROM mem"))
def state_upsert(spark, d):
    """A third of the memories is written again into another collection, without embedding but with the same content."""
    base = memories(spark, d).withColumn("importance", F.col("importance").cast("float"))
    again = base.where("id % 3 = 0").withColumn("collection", F.lit("moved")).withColumn("embedding", F.lit(None).cast("array<float>"))
    return mutations.upsert(base, again)[0].select("id", "collection", "created_at", F.col("embedding").isNotNull().alias("indexed"))


@query(_mem("SELECT id FROM mem WHERE id % 5 = 0 AND id % 2 = 0"))
def state_upsert_refused(spark, d):
    """A fifth of the memories comes again without embedding, every other with other content: these are refused, with or without an old embedding."""
    base = memories(spark, d).withColumn("importance", F.col("importance").cast("float"))
    other = F.when(F.col("id") % 2 == 0, F.concat("content", F.lit(b"!"))).otherwise(F.col("content"))
    again = base.where("id % 5 = 0").withColumn("content", other).withColumn("embedding", F.lit(None).cast("array<float>"))
    return mutations.upsert(base, again)[1]


@query(_edg("SELECT src, dst, relation FROM edg WHERE src NOT IN (SELECT memory_id FROM tombstones WHERE memory_id IS NOT NULL) AND dst NOT IN (SELECT memory_id FROM tombstones WHERE memory_id IS NOT NULL)"))
def state_delete_cascade(spark, d):
    gone = read_table(spark, d, "tombstones").where("memory_id IS NOT NULL").select(F.col("memory_id").alias("id"))
    return mutations.delete(memories(spark, d), edges(spark, d), gone)[1]


_FOLD = rf"""
WITH c AS (SELECT DISTINCT command_id, lower(regexp_replace(op, '^\s+|\s+$', '', 'g')) AS op, id, coalesce(id1, from_id) AS src, coalesce(id2, to_id) AS dst, relation FROM replay_log),
last AS (SELECT id, arg_max(op, command_id) AS op, max(CASE WHEN op = 'delete' THEN command_id END) AS deleted FROM c WHERE op IN ('add', 'delete') AND id IS NOT NULL GROUP BY id),
there AS (SELECT id, coalesce(deleted, -1) AS deleted FROM last WHERE op = 'add'),
made AS (SELECT src, dst, coalesce(relation, 'related') AS relation, max(command_id) AS made FROM c WHERE op = 'connect' GROUP BY ALL),
cut AS (SELECT src, dst, max(command_id) AS cut FROM c WHERE op = 'disconnect' GROUP BY ALL)"""


def _log(spark, d) -> DataFrame:
    c = log_commands(spark, d)
    memory = F.when(F.col("op") == "add", F.struct("id", F.coalesce("collection", F.lit("default")).alias("collection"), F.coalesce("text", F.lit("")).cast("binary").alias("content"), F.lit(None).cast("array<float>").alias("embedding"), F.create_map().cast("map<string,string>").alias("metadata"), F.unix_timestamp("recorded_at").alias("created_at"), F.lit(0.0).cast("float").alias("importance")))
    used = c.where("(op IN ('add', 'delete') AND id IS NOT NULL) OR op IN ('connect', 'disconnect')")
    return used.select(F.col("command_id").alias("seq"), "op", "id", memory.alias("memory"), "src", "dst", F.when(F.col("op") == "connect", F.coalesce("relation", F.lit("related"))).alias("relation")).dropDuplicates(["seq"])


@query(f"{_FOLD} SELECT id FROM there")
def state_fold_log(spark, d):
    return mutations.fold(_log(spark, d))[0].select("id")


@query(f"{_FOLD} SELECT m.src, m.dst, m.relation FROM made m LEFT JOIN cut USING (src, dst) JOIN there a ON a.id = m.src JOIN there b ON b.id = m.dst WHERE made > coalesce(cut, -1) AND made > a.deleted AND made > b.deleted")
def state_fold_edges(spark, d):
    return mutations.fold(_log(spark, d))[1]


@query(r"SELECT coalesce(lower(regexp_replace(op, '^\s+|\s+$', '', 'g')), 'unknown') AS op, count(DISTINCT command_id) AS n FROM replay_log GROUP BY 1")
def replay_op_counts(spark, d):
    return log_commands(spark, d).select(F.coalesce("op", F.lit("unknown")).alias("op"), "command_id").distinct().groupBy("op").agg(F.count(F.lit(1)).alias("n"))


@query(
    r"""WITH c AS (SELECT DISTINCT command_id, lower(regexp_replace(op, '^\s+|\s+$', '', 'g')) AS op, id, coalesce(id1, from_id) AS src, coalesce(id2, to_id) AS dst FROM replay_log),
adds AS (SELECT id, max(command_id) AS command_id FROM c WHERE op = 'add' AND id IS NOT NULL GROUP BY id), ids AS (SELECT id, row_number() OVER (ORDER BY command_id, id) AS new_id FROM adds)
SELECT command_id, a.new_id AS new_src, b.new_id AS new_dst, a.new_id IS NULL OR b.new_id IS NULL AS skipped FROM c LEFT JOIN ids a ON a.id = c.src LEFT JOIN ids b ON b.id = c.dst WHERE op = 'connect'"""
)
def replay_id_map(spark, d):
    """New ids in the order of the adds, and the ends of each connect in them."""
    c = log_commands(spark, d).select("command_id", "op", "id", "src", "dst").distinct()
    adds = c.where("op = 'add' AND id IS NOT NULL").groupBy("id").agg(F.max("command_id").alias("command_id"))
    ids = numbered(adds, ["command_id", "id"], "new_id", 1).select("id", F.col("new_id").cast("long").alias("new_id"))
    a, b = ids.withColumnsRenamed({"id": "src", "new_id": "new_src"}), ids.withColumnsRenamed({"id": "dst", "new_id": "new_dst"})
    return c.where("op = 'connect'").join(a, "src", "left").join(b, "dst", "left").select("command_id", "new_src", "new_dst", (F.col("new_src").isNull() | F.col("new_dst").isNull()).alias("skipped"))


# Texts ------------------------------------------------------------------------


def _chunks(spark, d, strategy: str, **options) -> DataFrame:
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    return chunking.chunk_table(docs, ["doc_id"], strategy=strategy, **options)


# Words packed into chunks by recursion: from word f to the last word e that still fits; the next chunk begins with the earliest word of those that the overlap holds.
_BLANK = r"[^ \t\n\x0b\x0c\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _fixed_sql(size: int, overlap: int, where: str = "true") -> str:
    end = lambda f: f"coalesce(list_max(list_filter(range({f}, n + 1), lambda i: p[i + 1] - p[{f}] + i - {f} <= {size})), {f})"
    return f"""w AS (SELECT doc_id, regexp_extract_all(text, '{_BLANK}') AS ws FROM documents WHERE text IS NOT NULL AND {where}),
z AS (SELECT doc_id, ws, len(ws) AS n, list_concat([0], list_transform(range(1, len(ws) + 1), lambda i: list_sum(list_transform(ws[1:i], lambda x: strlen(x)))))::BIGINT[] AS p FROM w WHERE len(ws) > 0),
k AS (SELECT doc_id, 0 AS index, 1::BIGINT AS f, {end("1")} AS e FROM z
  UNION ALL SELECT doc_id, index + 1, g, {end("g")} FROM (SELECT k.doc_id, index, z.n, z.p, greatest(f + 1, coalesce(list_min(list_filter(range(f, e + 1), lambda b: p[e + 1] - p[b] + e - b <= {overlap})), e + 1)) AS g FROM k JOIN z USING (doc_id) WHERE e < n)),
packed AS (SELECT doc_id, index::INT AS index, array_to_string(ws[f:e], ' ') AS text FROM k JOIN z USING (doc_id))"""


@query(f"WITH RECURSIVE {_fixed_sql(512, 50)} SELECT doc_id, index, text FROM packed")
def chunk_fixed(spark, d):
    return _chunks(spark, d, "fixed", size=512, overlap=50)


@query()
def chunk_recursive(spark, d):
    return _chunks(spark, d, "recursive", size=512, overlap=10)


@query()
def chunk_semantic(spark, d):
    return _chunks(spark, d, "semantic", overlap=5)


@query()
def chunk_markdown(spark, d):
    return _chunks(spark, d, "markdown", overlap=5)


@query(f"WITH RECURSIVE {_fixed_sql(400, 40, 'length(text) > 400')} SELECT doc_id, index, text FROM packed UNION ALL SELECT doc_id, 0, text FROM documents WHERE length(text) <= 400 AND len(regexp_extract_all(text, '{_BLANK}')) > 0")
def chunk_legacy(spark, d):
    return _chunks(spark, d, "legacy", size=400, overlap=40)


@query(f"SELECT doc_id, true AS counted, true AS filled, len(regexp_extract_all(text, '{_BLANK}')) AS recursive_words, len(regexp_extract_all(text, '{_BLANK}')) AS semantic_words, true AS within FROM documents WHERE len(regexp_extract_all(text, '{_BLANK}')) > 0")
def chunk_check(spark, d):
    """Without overlap the chunks of a text are numbered from 0, none is blank, they hold all its words, and a semantic chunk of more than one paragraph keeps to the section size."""
    blank = _BLANK.replace(r"\x{", r"\x{")
    words = lambda c: F.size(F.regexp_extract_all(c, F.lit(f"({blank})")))
    r, s = _chunks(spark, d, "recursive", size=512, overlap=0), _chunks(spark, d, "semantic", overlap=0)
    both = r.withColumn("kind", F.lit("r")).unionByName(s.withColumn("kind", F.lit("s")))
    of = lambda kind, c: F.when(F.col("kind") == kind, c)
    counted = F.lit(True)
    for kind in "rs":
        counted = counted & (F.max(of(kind, F.col("index"))) == F.count(of(kind, F.col("index"))) - 1) & (F.count_distinct(of(kind, F.col("index"))) == F.count(of(kind, F.col("index"))))
    too_large = of("s", (F.octet_length("text") > chunking.SECTION_BYTES) & F.contains("text", F.lit("\n\n")))
    return both.groupBy("doc_id").agg(counted.alias("counted"), F.bool_and(words(F.col("text")) > 0).alias("filled"), F.sum(of("r", words(F.col("text")))).alias("recursive_words"), F.sum(of("s", words(F.col("text")))).alias("semantic_words"), (~F.bool_or(F.coalesce(too_large, F.lit(False)))).alias("within"))


@query("""WITH k AS (SELECT event_id, unnest(json_keys(props)) AS key, props FROM events WHERE props IS NOT NULL) SELECT event_id, (row_number() OVER (PARTITION BY event_id ORDER BY key) - 1)::INT AS index, json_extract_string(props, '$."' || key || '"') AS text, key, json_extract_string(props, '$."' || key || '"') AS value FROM k""")
def chunk_json_flat(spark, d):
    events = read_table(spark, d, "events").select("event_id", F.col("props").alias("text"))
    return chunking.chunk_table(events, ["event_id"], strategy="json")


@query("SELECT doc_id, round(list_max(list_transform([0, 1, 2, 3, 4, 5, 6, 7], lambda j: ('0x' || sha256(coalesce(text, '') || '0')[j * 8 + 1:j * 8 + 8])::UBIGINT))::DOUBLE, 0) AS largest FROM documents")
def embed_hash_words(spark, d):
    """The largest of the first eight words that the hash embedder makes of a text."""
    docs = read_table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = [F.conv(F.substring(F.sha2(F.concat("text", F.lit("0")), 256), 8 * j + 1, 8), 16, 10).cast("double") for j in range(8)]
    return docs.select("doc_id", F.round(F.greatest(*words), 0).alias("largest"))


@query(
    """WITH w AS (SELECT doc_id, list_transform(range(64), lambda k: ('0x' || sha256(coalesce(text, '') || (k // 8))[k % 8 * 8 + 1:k % 8 * 8 + 8])::UBIGINT::DOUBLE) AS w FROM documents)
SELECT doc_id, round(w[1] / sqrt(list_dot_product(w, w)), 6) AS first, round(w[64] / sqrt(list_dot_product(w, w)), 6) AS last, round(list_sum(w) / sqrt(list_dot_product(w, w)), 6) AS total FROM w"""
)
def embed_hash(spark, d):
    e = read_table(spark, d, "documents").select("doc_id", embedders.hash_embedding(F.col("text"), 64).alias("e"))
    return e.select("doc_id", F.round(F.get("e", F.lit(0)), 6).alias("first"), F.round(F.get("e", F.lit(63)), 6).alias("last"), F.round(F.aggregate("e", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query()
def ingest_documents(spark, d):
    """Chunk, embed and number all documents as memories: ids from 1 on in the order of documents and chunks."""
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    chunks = chunking.chunk_table(docs, ["doc_id"], strategy="recursive", size=512, overlap=10)
    rows = embedders.embed_table(chunks.select("doc_id", "index", "text"), embedders.HashEmbedder(64), "text", "embedding")
    rows = numbered(rows, ["doc_id", "index"], "id", 1)
    return rows.select(F.col("id").cast("long").alias("id"), F.lit("default").alias("collection"), F.encode("text", "UTF-8").alias("content"), "embedding", F.create_map(F.lit("doc_id"), F.col("doc_id").cast("string")).alias("metadata"), F.lit(NOW).cast("long").alias("created_at"), F.lit(0.0).cast("float").alias("importance"))


@query(f"WITH RECURSIVE {_fixed_sql(512, 50)}, n AS (SELECT *, row_number() OVER (ORDER BY doc_id, index) AS id FROM packed) SELECT id, doc_id, index, strlen(text)::INT AS content_bytes, round((('0x' || sha256(text || '0')[1:8])::UBIGINT)::DOUBLE, 0) AS word FROM n")
def ingest_numbered(spark, d):
    """The numbering of an ingestion, with the first word that the embedder makes of each chunk."""
    rows = numbered(_chunks(spark, d, "fixed", size=512, overlap=50), ["doc_id", "index"], "id", 1)
    return rows.select(F.col("id").cast("long").alias("id"), "doc_id", "index", F.octet_length("text").alias("content_bytes"), F.conv(F.substring(F.sha2(F.concat("text", F.lit("0")), 256), 1, 8), 16, 10).cast("double").alias("word"))


def queries() -> dict[str, Query]:
    return {
        **_queries,
        "p4_found": changefeed.p4_found,
        "p4_state": changefeed.p4_state,
        "p6_found": orphans.p6_found,
        "p6_report": orphans.p6_report,
        "p6_levels": orphans.p6_levels,
    }


def oracle_sql() -> dict[str, str]:
    return {**_sql, **changefeed.SQL, **orphans.SQL}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted hybrid search."""
    return hyb_weighted(spark, sf_dir)
