"""Problem 5: the most similar vectors for every vector, by learned partitions.

The neighbour graph of a bounded sample is cut into balanced partitions, and a
small network learns to tell from a vector in which partitions its neighbours
lie. Every vector of the table is indexed in its most probable partition; a
query goes to every partition that holds its neighbours with at least the
probability ``chance``, so to 1 / chance at most, and is ranked there exactly.
Only the networks are fitted on samples: each row is indexed and each query is
answered. Where only neighbours of a least cosine are wanted (p5_found), no
partition is left out: ``closeness`` finds them all.

A sample can tell only so many partitions apart. A larger table is partitioned
in levels: each partition is cut again by a network of its own, fitted on a
bounded sample of its rows, until partitions hold about PARTITION_ROWS. The
probabilities of the levels are multiplied, so ``chance`` means the same at
every size.

Equal vectors are one entry of the index, so copies cost nothing; the result
gives each copy its neighbours. A partition with more rows than a block holds
is searched block by block in separate tasks.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.vector_search import knn_batch
from ..runtime import broadcast_if_below, materialize, read_table, skew_safe_join
from .closeness import close_pairs, cosines
from .sampling import bounded_sample
from .vectors import EDGE, matrix, unit

SAMPLE = 16_384  # vectors that the partitions and the network of a level are fitted on
PARTITION_ROWS = 2_000  # rows aimed at in a partition of the last level
LEAST_SAMPLE = 24  # sampled vectors in a partition at least
BLOCK = 8_192  # rows of a partition that one task searches
QUERY_BLOCK = 32_768  # queries of one task
ROUTED = 65_536  # rows that one task takes to the next level
NEIGHBOURS = 10


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest rows of each row of unit vectors."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int32)
    for a in range(0, len(x), 1024):
        s = x[a : a + 1024] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
        out[a : a + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def bisect(x: np.ndarray, parts: int) -> np.ndarray:
    """Balanced first labels: halve along the principal direction, again and again."""
    label = np.zeros(len(x), np.int32)

    def split(rows: np.ndarray, first: int, parts: int) -> None:
        if parts == 1:
            label[rows] = first
            return
        y = x[rows] - x[rows].mean(0)
        along = y @ np.linalg.eigh(y.T @ y)[1][:, -1]
        half = parts // 2
        order = np.argsort(along, kind="stable")
        cut = len(rows) * half // parts
        split(rows[order[:cut]], first, half)
        split(rows[order[cut:]], first + half, parts - half)

    split(np.arange(len(x)), 0, parts)
    return label


def partition_graph(graph: np.ndarray, label: np.ndarray, parts: int, rounds: int = 12, slack: float = 0.1) -> np.ndarray:
    """Move vertices to the partition of most of their neighbours while no partition grows beyond the balance."""
    n, k = graph.shape
    cap = int(np.ceil(n / parts * (1 + slack)))
    label = label.copy()
    rows = np.repeat(np.arange(n), k)
    for _ in range(rounds):
        votes = np.zeros((n, parts), np.int16)
        np.add.at(votes, (rows, label[graph].ravel()), 1)
        np.add.at(votes, (graph.ravel(), np.repeat(label, k)), 1)
        to = votes.argmax(1)
        gain = votes[np.arange(n), to] - votes[np.arange(n), label]
        order = np.flatnonzero(gain > 0)
        order = order[np.lexsort((-gain[order], to[order]))]
        free = cap - np.bincount(label, minlength=parts)
        first = np.searchsorted(to[order], np.arange(parts))
        moved = order[np.arange(len(order)) - first[to[order]] < free[to[order]]]
        if not len(moved):
            break
        label[moved] = to[moved]
    return label


@dataclass
class Router:
    """A network with one hidden layer: the probability of each partition."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @property
    def parts(self) -> int:
        return len(self.b2)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def route(self, x: np.ndarray, chance: float | np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, partition, probability, whether it is the row's most probable) of the best partition of each row and of all with at least ``chance``."""
        z = self.logits(x)
        z = np.exp(z - z.max(1, keepdims=True))
        z /= z.sum(1, keepdims=True)
        best = z.argmax(1)
        keep = z >= chance
        keep[np.arange(len(x)), best] = True
        row, part = np.nonzero(keep)
        return row, part, z[row, part].astype(np.float64), part == best[row]

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, w1=self.w1, b1=self.b1, w2=self.w2, b2=self.b2)
        return out.getvalue()

    @classmethod
    def unpack(cls, raw: bytes) -> Router:
        return cls(**np.load(io.BytesIO(raw)))


def train(x: np.ndarray, graph: np.ndarray, label: np.ndarray, parts: int, hidden: int = 128, epochs: int = 24, seed: int = 5) -> Router:
    """Fit the router to the partitions of each vector's neighbours and its own (Adam, cross entropy)."""
    rng = np.random.default_rng(seed)
    d, n = x.shape[1], len(x)
    target = np.zeros((n, parts), np.float32)
    np.add.at(target, (np.repeat(np.arange(n), graph.shape[1]), label[graph].ravel()), 1)
    target[np.arange(n), label] += graph.shape[1] / 2
    target /= target.sum(1, keepdims=True)
    p = [rng.normal(0, np.sqrt(2 / d), (d, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]
    p = [w.astype(np.float32) for w in p]
    m, v, t = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p], 0
    for epoch in range(epochs):
        order = rng.permutation(n)
        rate = 0.004 * (1 - epoch / epochs) + 1e-4
        for a in range(0, n, 256):
            rows = order[a : a + 256]
            h = np.maximum(x[rows] @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            z = np.exp(z - z.max(1, keepdims=True))
            dz = (z / z.sum(1, keepdims=True) - target[rows]) / len(rows)
            dh = (dz @ p[2].T) * (h > 0)
            t += 1
            for k, g in enumerate((x[rows].T @ dh, dh.sum(0), h.T @ dz, dz.sum(0))):
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.002 * (g * g - v[k])
                p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.998**t)) + 1e-8)).astype(np.float32)
    return Router(*p)


def fit(sample: np.ndarray, parts: int) -> Router:
    """The router to ``parts`` partitions, or to as many as the sample can tell apart."""
    parts = max(1, min(parts, len(sample) // LEAST_SAMPLE))
    if parts == 1:
        d = sample.shape[1] if len(sample) else 64
        return Router(np.zeros((d, 1), np.float32), np.zeros(1, np.float32), np.zeros((1, 1), np.float32), np.zeros(1, np.float32))
    graph = neighbour_graph(sample, NEIGHBOURS)
    label = partition_graph(graph, bisect(sample, parts), parts)
    return train(sample, graph, label, parts)


def parts_of_level(rows: float, levels_left: int, partition_rows: int) -> int:
    """Into how many partitions ``rows`` are cut, if that many levels are to bring them to ``partition_rows``."""
    return max(1, math.ceil(round((rows / partition_rows) ** (1 / levels_left), 6)))


# Spark ----------------------------------------------------------------------


def usable(embedding: Column, size: int) -> Column:
    """Whether an embedding has ``size`` finite components that aren't all zero."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(embedding) == size) & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


_ROUTED = "part long, role byte, p double, rep long"


def _first_level(entries: DataFrame, router: Router, chance: float, vectors: bool) -> DataFrame:
    """(part, role, p, rep) and the vector if wanted: role 1 is an entry in its partition, 2 a query, 3 both in one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                some = batch.slice(a, 4096)
                asks = some.column(1).to_numpy(zero_copy_only=False)
                row, part, p, home = router.route(unit(matrix(some.column(2))), chance)
                use = home | asks[row]
                row, part, p, home = row[use], part[use], p[use], home[use]
                take = pa.array(row)
                out = {"part": pa.array(part, pa.int64()), "role": pa.array(np.where(home, np.where(asks[row], 3, 1), 2), pa.int8()), "p": pa.array(p), "rep": some.column(0).take(take)}
                if vectors:
                    out["vector"] = some.column(2).take(take)
                yield pa.RecordBatch.from_pydict(out)

    return entries.select("rep", "asks", "vector").mapInArrow(run, _ROUTED + (", vector array<float>" if vectors else ""))


def _sizes(routed: DataFrame) -> DataFrame:
    """Rows and queries of each partition."""
    return materialize(routed.groupBy("part").agg(F.count_if(F.col("role").bitwiseAND(1) == 1).alias("n"), F.count_if(F.col("role").bitwiseAND(2) == 2).alias("asked")), "sizes")


def _next_level(routed: DataFrame, entries: DataFrame, chance: float, levels_left: int, partition_rows: int, sample: int) -> DataFrame:
    """Cut every partition again by a network of its own. Samples are thinned out where they lie; rows go to the network of their partition in groups of ROUTED."""
    sizes = _sizes(routed)
    small = broadcast_if_below(sizes.where("n > 0").select("part", "n", F.ceil((F.col("n") + F.col("asked")) / ROUTED).cast("int").alias("tasks")), 100_000)
    vectors = entries.select("rep", "vector")
    # Of each partition the rows with the smallest hashes, half as many again as are used at most, so that no group is larger than that.
    h = F.xxhash64(F.lit(91), "rep")
    thin = routed.where(F.col("role").bitwiseAND(1) == 1).join(small.select("part", "n"), "part").select("part", "n", "rep", h.alias("h"))
    thin = thin.where(F.col("h").bitwiseAND(F.lit((1 << 31) - 1)) / float(1 << 31) * F.col("n") < 1.5 * sample + 64)

    def learn(table: pa.Table) -> pa.Table:
        order = np.argsort(table["h"].to_numpy(), kind="stable")[:sample]
        router = fit(unit(matrix(table["vector"]))[order], parts_of_level(table["n"][0].as_py(), levels_left, partition_rows))
        return pa.table({"part": table["part"].slice(0, 1), "router": pa.array([router.pack()], pa.binary())})

    routers = materialize(thin.join(vectors, "rep").groupBy("part").applyInArrow(learn, "part long, router binary"), "routers")
    # Each task has the network of its own partition only.
    spread = routers.join(small.select("part", "tasks"), "part").select("part", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), "router")
    rows = routed.join(small.select("part", "tasks"), "part").withColumn("task", F.pmod(F.xxhash64("rep"), F.col("tasks")).cast("int")).join(vectors, "rep")
    width = sample // LEAST_SAMPLE + 1

    def route(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"part": pa.array([], pa.int64()), "role": pa.array([], pa.int8()), "p": pa.array([], pa.float64()), "rep": pa.array([], pa.int64())})
        router = Router.unpack(right["router"][0].as_py())
        role, before, rep = left["role"].to_numpy(), left["p"].to_numpy(), left["rep"].to_numpy()
        x = unit(matrix(left["vector"]))
        found = []
        for a in range(0, len(x), 4096):
            row, part, p, home = router.route(x[a : a + 4096], (chance / before[a : a + 4096])[:, None])
            row += a
            inside, asks = role[row] & 1 == 1, role[row] & 2 == 2
            keep = home & inside | asks & (p * before[row] >= chance)
            row, part, p, own = row[keep], part[keep], p[keep], (home & inside)[keep]
            found.append((row, part, p * before[row], np.where(own, role[row], 2)))
        row, part, p, kind = (np.concatenate([f[c] for f in found]) for c in range(4))
        return pa.table({"part": pa.array(left["part"][0].as_py() * width + part, pa.int64()), "role": pa.array(kind, pa.int8()), "p": pa.array(p), "rep": pa.array(rep[row])})

    out = rows.select("part", "task", "role", "p", "rep", "vector").groupBy("part", "task").cogroup(spread.groupBy("part", "task")).applyInArrow(route, _ROUTED)
    return materialize(out, "routed")


def _in_blocks(routed: DataFrame, sizes: DataFrame) -> DataFrame:
    """Add ``i`` and ``j``, the blocks of entries and of queries. Entries of a partition that needs several go to every block of queries, and queries to every block of entries."""
    large = sizes.where((F.col("n") > BLOCK) | (F.col("asked") > QUERY_BLOCK))
    large = large.select("part", F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("int").alias("bs"), F.greatest(F.lit(1), F.ceil(F.col("asked") / QUERY_BLOCK)).cast("int").alias("qs"))
    if not large.limit(1).count():
        return routed.select("part", F.lit(0).alias("i"), F.lit(0).alias("j"), "role", "rep", "vector")
    marked = routed.join(broadcast_if_below(large, 100_000), "part", "left")
    one = lambda i, j, role: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), role.cast("byte").alias("role"))
    role, i, j = F.col("role"), F.pmod(F.xxhash64("rep"), F.col("bs")), F.pmod(F.xxhash64(F.lit(3), "rep"), F.col("qs"))
    none = F.array().cast("array<struct<i:int,j:int,role:tinyint>>")
    as_entry = F.when(role.bitwiseAND(1) == 1, F.transform(F.sequence(F.lit(0), F.col("qs") - 1), lambda q: one(i, q, F.lit(1)))).otherwise(none)
    as_query = F.when(role.bitwiseAND(2) == 2, F.transform(F.sequence(F.lit(0), F.col("bs") - 1), lambda b: one(b, j, F.lit(2)))).otherwise(none)
    to = F.when(F.col("bs").isNull(), F.array(one(F.lit(0), F.lit(0), role))).otherwise(F.concat(as_entry, as_query))
    return marked.select("part", F.explode(to).alias("x"), "rep", "vector").select("part", "x.i", "x.j", "x.role", "rep", "vector")


def _ranked_pairs(entries: DataFrame, count: int, k: int, chance: float, least: float | None, size: int, partition_rows: int, most: int) -> DataFrame:
    """(q, n, cosine): the k best entries for each asking entry in each of its partitions' blocks, and those that tie with them; with ``least`` in each pair of blocks of the table."""
    sample = bounded_sample(entries.select("rep", "vector"), "rep", count, most).select("vector").toArrow()
    x = unit(matrix(sample["vector"])) if sample.num_rows else np.empty((0, size), np.float32)
    if least is not None:
        return close_pairs(entries, count, x, k, least)
    apart, levels = max(2, most // LEAST_SAMPLE), 1
    while apart**levels * partition_rows < count:
        levels += 1
    router = fit(x, parts_of_level(count, levels, partition_rows))
    if levels == 1:
        sizes = _sizes(_first_level(entries, router, chance, False))
        routed = _first_level(entries, router, chance, True)
    else:
        routed = materialize(_first_level(entries, router, chance, False), "routed")
        for left in range(levels - 1, 0, -1):
            routed = _next_level(routed, entries, chance, left, partition_rows, most)
        sizes = _sizes(routed)
        routed = routed.join(entries.select("rep", "vector"), "rep")

    def search(table: pa.Table) -> pa.Table:
        role, rep = table["role"].to_numpy(), table["rep"].to_numpy()
        raw = matrix(table["vector"])
        x = unit(raw)
        index, query = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
        index = index[np.argsort(rep[index], kind="stable")]
        found_q, found_n = [], []
        for a in range(0, len(query) if len(index) else 0, 1024):
            q = query[a : a + 1024]
            s = x[q] @ x[index].T
            own = np.searchsorted(rep[index], rep[q])
            own[own == len(index)] = 0
            mine = rep[index[own]] == rep[q]
            s[np.flatnonzero(mine), own[mine]] = -2
            m = min(k, len(index))
            r, c = np.nonzero(s >= np.maximum(np.partition(s, s.shape[1] - m, axis=1)[:, [s.shape[1] - m]] - EDGE, -1.5))
            found_q.append(q[r])
            found_n.append(index[c])
        q = np.concatenate(found_q) if found_q else np.empty(0, np.int64)
        n = np.concatenate(found_n) if found_n else np.empty(0, np.int64)
        return pa.table({"q": pa.array(rep[q], pa.int64()), "n": pa.array(rep[n], pa.int64()), "cosine": pa.array(cosines(raw[q], raw[n]), pa.float64())})

    return _in_blocks(routed, sizes).groupBy("part", "i", "j").applyInArrow(search, "q long, n long, cosine double")


def nearest(vectors: DataFrame, k: int = 5, chance: float = 0.01, asks: Column | None = None, least: float | None = None, size: int = 64, partition_rows: int = PARTITION_ROWS, sample: int = SAMPLE) -> DataFrame:
    """(id, neighbour_id, cosine, rank): the k most similar other ids of each asking id.

    ``vectors`` has id and embedding; ``asks`` is a condition on id (all ids
    where None); ``least`` leaves out neighbours with a smaller cosine (ranks
    are not changed by that), and then nothing is missed, at a cost that grows
    with the square of the table. Without it a query searches the partitions
    that hold its neighbours with at least the probability ``chance``: a smaller
    one finds more and costs more. ``sample`` vectors are what each network is
    fitted on.

    Embeddings that are null, of another length, with null, NaN or infinite
    components or all zero take no part, nor do null ids. Repeated rows count
    once. Ties (of cosines rounded to 12 digits) go by the smallest id that has
    the same vector, then by id; with ``least`` by id alone, as in SQL. An
    id with fewer than k others has as many as there are; an empty table gives
    an empty result. Other columns aren't read.
    """
    good = vectors.where(F.col("id").isNotNull() & usable(F.col("embedding"), size))
    rows = good.select("id", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(17), "embedding").alias("h2"), (F.lit(True) if asks is None else F.coalesce(asks, F.lit(False))).alias("asks"), "embedding")
    entries = rows.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.max("asks").alias("asks"), F.first("embedding").alias("vector"))
    entries = materialize(entries, "vectors")
    count = entries.count()
    pairs = _ranked_pairs(entries, count, k, chance, least, size, partition_rows, sample)
    best = pairs.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cosine"), "n"))).where(F.col("r") <= k).drop("r")

    # From entries to ids: of an entry only its first k + 1 ids can be among anyone's k nearest.
    members = rows.select("id", "h1", "h2", "asks").distinct()
    members = skew_safe_join(members.withColumn("h", F.concat_ws(" ", "h1", "h2")), entries.select(F.concat_ws(" ", "h1", "h2").alias("h"), "rep"), "h", "inner").select("id", "rep", "asks")
    members = materialize(members, "members")
    first = members.withColumn("at", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("at") <= k + 1).select(F.col("rep").alias("n"), F.col("id").alias("neighbour_id"), "at")
    own = entries.where("asks").select(F.col("rep").alias("q"), F.col("rep").alias("n"), F.lit(2.0 if least is None else 1.0).alias("cosine"))
    if least is None:
        close = best.unionByName(own)
    else:
        close = best.where(F.col("cosine") >= least).unionByName(own)
    order = ["n"] if least is None else []
    listed = close.join(first, "n")
    listed = listed.groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("cosine")).alias("s"), *order, "neighbour_id"))).alias("list")).where(F.size("list") > 1)
    asking = members.where("asks").select("id", F.col("rep").alias("q"))
    lists = skew_safe_join(asking, listed, "q", "inner")
    others = F.slice(F.filter("list", lambda x: x["neighbour_id"] != F.col("id")), 1, k)
    out = lists.select("id", F.posexplode(others).alias("at", "x"))
    return out.select("id", F.col("x.neighbour_id").alias("neighbour_id"), F.least(-F.col("x.s"), F.lit(1.0)).alias("cosine"), (F.col("at") + 1).alias("rank"))


KNN_CHANCE = 0.01


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with a cosine of at least 0.9 of which one is among the 5 most similar of the other."""
    near = nearest(read_table(spark, sf_dir, "memories"), k=5, least=0.9)
    return near.select(F.least("id", "neighbour_id").alias("id_a"), F.greatest("id", "neighbour_id").alias("id_b")).distinct()


def p5_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 most similar memories of every memory whose id is divisible by 50."""
    return nearest(read_table(spark, sf_dir, "memories"), k=5, chance=KNN_CHANCE, asks=F.col("id") % 50 == 0)


def p5_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: how much p5_knn finds of an exact search for the same queries. Found is what is at least as similar as the fifth of the exact list, so that ties don't count as misses."""
    memories = read_table(spark, sf_dir, "memories")
    usable_rows = memories.where(F.col("id").isNotNull() & usable(F.col("embedding"), 64)).select("id", "embedding").dropDuplicates(["id"])
    exact = knn_batch(usable_rows, usable_rows.where("id % 50 = 0").withColumnRenamed("id", "query_id"), 6).where("id <> query_id")
    exact = exact.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list("score"), False), 1, 5).alias("s")).select(F.col("query_id").alias("id"), F.size("s").alias("n"), F.array_min("s").alias("last"))
    found = exact.join(p5_knn(spark, sf_dir), "id", "left").groupBy("id", "n").agg(F.count_if(F.col("cosine") >= F.col("last") - 1e-6).alias("hits"))
    return found.agg(F.count(F.lit(1)).alias("queries"), F.sum("n").alias("neighbours"), (F.sum(F.least("hits", "n")) / F.sum("n")).alias("recall"))


SQL = {
    "p5_found": """
WITH v AS (SELECT id, any_value(embedding) AS e FROM memories WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY id),
d AS (SELECT id, list_transform(e, lambda x: x::DOUBLE) AS e FROM v),
s AS (SELECT a.id AS id, b.id AS other, list_cosine_similarity(a.e, b.e) AS c FROM d a JOIN d b ON a.id <> b.id),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(c, 12) DESC, other) AS r FROM s WHERE c >= 0.9) WHERE r <= 5)
SELECT DISTINCT least(id, other) AS id_a, greatest(id, other) AS id_b FROM t""",
}
