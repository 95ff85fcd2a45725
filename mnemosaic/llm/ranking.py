"""Problem 1: one ranking from several scores on different scales.

A walker on the items of a query picks one of the scores at random and jumps
to an item ranked at least as high by it, all of them alike likely; with
probability 1 - damping it jumps anywhere. Items are ordered by how often the
walker visits them. Only ranks enter, so no score weighs more by its range.

One step of the power iteration over items sorted by a score is a suffix sum:
the item at place q gets mass(p) / p from every place p >= q. No matrix of
item pairs exists.

Queries with up to ``LOCAL_ITEMS`` items are iterated many at a time in numpy;
larger ones as tables: each score's order is cut into blocks, block sums give
the carry, and no block exceeds ``BLOCK_ITEMS`` items.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import broadcast_if_below, materialize, read_table, release, skew_safe_join

LOCAL_ITEMS = 200_000
BLOCK_ITEMS = 20_000
PACK_ITEMS = 50_000  # items that one call ranks, of small queries together
DAMPING = 0.85
STEPS = 40
DIGITS = 9  # visits are compared rounded, as sums depend on their order; as multiples of the query's mean 1 / n, so that a large query keeps its order


def _orders(query: np.ndarray, scores: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each score: items by (query, score from high to low), the first place of each item's tie, and places of the query up to the tie's end."""
    out = []
    n = len(query)
    begin = np.searchsorted(query, query)  # query is sorted
    for s in scores:
        value = np.where(np.isnan(s), -np.inf, s)
        order = np.lexsort((-value, query))
        v, q = value[order], query[order]
        new = np.append(True, (v[1:] != v[:-1]) | (q[1:] != q[:-1]))
        heads = np.flatnonzero(new)
        tie = np.cumsum(new) - 1
        ends = np.append(heads[1:], n)
        out.append((order, heads[tie], ends[tie] - begin[order]))
    return out


def _suffix_sums(share: np.ndarray, groups: list[np.ndarray]) -> np.ndarray:
    """Sums from each place to the end of its query, each query on its own: a difference of sums over all queries would lose the digits that the order of a large query needs."""
    share, out = np.append(share, 0.0), np.empty(len(share) + 1)
    for places in groups:
        out[places] = np.cumsum(share[places], axis=1)
    return out[:-1]


def _groups(heads: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """The places of queries of about one size, from their ends; shorter ones begin with the place behind the last, which holds 0."""
    out, n = [], int(size.sum())
    width = np.ceil(np.log2(size)).astype(int)
    for w in np.unique(width):
        some = np.flatnonzero(width == w)
        widest = size[some].max()
        left = np.arange(widest)[::-1][None, :]
        out.append(np.where(left < size[some, None], heads[some, None] + left, n))
    return out


def visits(query: np.ndarray, scores: list[np.ndarray], damping: float = DAMPING, steps: int = STEPS) -> np.ndarray:
    """How often the walker visits each item of each query; ``query`` is sorted, NaN ranks last."""
    n = len(query)
    if not n:
        return np.empty(0)
    heads = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
    size = np.diff(np.append(heads, n))
    count = np.repeat(size, size).astype(float)
    groups = _groups(heads, size)
    orders = _orders(query, scores)
    mass = 1 / count
    for _ in range(steps):
        new = (1 - damping) / count
        for order, tie_begin, reach in orders:
            # Items from the beginning of this one's tie to the end of the query can jump here.
            gain = np.empty(n)
            gain[order] = _suffix_sums(mass[order] / reach, groups)[tie_begin]
            new += damping / len(orders) * gain
        mass = new
    return mass


def _local(items: DataFrame, n: int, names: list[str], damping: float, steps: int) -> DataFrame:
    """Queries are packed into groups by hash, so one call ranks many of them; there are as many groups as ``n`` items need."""

    def run(table: pa.Table) -> pa.Table:
        table = table.drop_columns(["pack"]).sort_by([("query_id", "ascending"), ("memory_id", "ascending")])
        query = table["query_id"].to_numpy()
        mass = visits(query, [table[c].to_numpy() for c in names], damping, steps)
        begin = np.searchsorted(query, query)
        size = np.searchsorted(query, query, "right") - begin
        order = np.lexsort((table["memory_id"].to_numpy(), -np.round(mass * size, DIGITS), query))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - begin + 1
        return table.select(["query_id", "memory_id"]).append_column("rank", pa.array(rank)).append_column("visits", pa.array(np.round(mass * size, DIGITS)))

    packs = max(64, -(-n // PACK_ITEMS))
    packed = items.withColumn("pack", F.pmod(F.xxhash64("query_id"), F.lit(packs)))
    return packed.groupBy("pack").applyInArrow(run, "query_id long, memory_id long, rank long, visits double")


def _places(df: DataFrame, group: list[str], order: list[Column], weight: str, name: str) -> DataFrame:
    """Add ``name``: the running sum of ``weight`` within ``group``, by a range sort and the sums of its partitions, so that no group has to fit one task."""
    ranged = materialize(df.repartitionByRange(*group, *order).withColumn("pid", F.spark_partition_id()), "ranged")
    parts = ranged.groupBy(*group, "pid").agg(F.sum(weight).alias("__n"))
    ahead = parts.select(*group, "pid", (F.sum("__n").over(Window.partitionBy(*group).orderBy("pid")) - F.col("__n")).alias("__ahead"))
    inner = Window.partitionBy(*group, "pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumn("__sum", F.sum(weight).over(inner)).join(broadcast_if_below(ahead, 100_000), [*group, "pid"])
    return summed.withColumn(name, F.col("__sum") + F.col("__ahead")).drop("pid", "__sum", "__ahead")


def _distributed(items: DataFrame, names: list[str], damping: float, steps: int, block_items: int) -> DataFrame:
    """The same iteration over tables, for queries with any number of items."""
    sizes = broadcast_if_below(materialize(items.groupBy("query_id").agg(F.count(F.lit(1)).alias("size")), "sizes"), 100_000)
    worst = F.lit(float("-inf"))
    long = items.select("query_id", "memory_id", F.explode(F.array(*(F.struct(F.lit(k).alias("s"), F.coalesce(F.col(c), worst).alias("v")) for k, c in enumerate(names)))).alias("x")).select("query_id", "memory_id", "x.s", "x.v")
    # A tie is one value, which reaches all that rank as high.
    values = long.groupBy("query_id", "s", "v").agg(F.count(F.lit(1)).alias("n"))
    ranked = _places(values, ["query_id", "s"], [F.desc("v")], "n", "reach").select("query_id", "s", "v", "reach", F.floor(F.col("reach") / block_items).alias("block"))
    places = materialize(long.join(ranked, ["query_id", "s", "v"]).select("query_id", "memory_id", "s", "reach", "block"), "places")
    mass = items.select("query_id", "memory_id").join(sizes, "query_id").select("query_id", "memory_id", (F.lit(1.0) / F.col("size")).alias("mass"))
    before = None
    for _ in range(steps):
        share = places.join(mass, ["query_id", "memory_id"]).groupBy("query_id", "s", "block", "reach").agg(F.sum(F.col("mass") / F.col("reach")).alias("share"))
        share = materialize(share, "share")
        if before is not None:
            release(before)
        before = share
        blocks = share.groupBy("query_id", "s", "block").agg(F.sum("share").alias("b"))
        carry = blocks.withColumn("carry", F.sum("b").over(Window.partitionBy("query_id", "s").orderBy(F.desc("block"))) - F.col("b")).drop("b")
        w = Window.partitionBy("query_id", "s", "block").orderBy(F.desc("reach"))
        gain = share.withColumn("gain", F.sum("share").over(w)).join(carry, ["query_id", "s", "block"]).select("query_id", "s", "reach", (F.col("gain") + F.col("carry")).alias("gain"))
        new = places.join(gain, ["query_id", "s", "reach"]).groupBy("query_id", "memory_id").agg(F.sum("gain").alias("gain"))
        mass = new.join(sizes, "query_id").select("query_id", "memory_id", ((1 - damping) / F.col("size") + damping / len(names) * F.col("gain")).alias("mass"))
    final = mass.join(sizes, "query_id").select("query_id", "memory_id", F.round(F.col("mass") * F.col("size"), DIGITS).alias("visits"), F.lit(1).alias("one"))
    return _places(final, ["query_id"], [F.desc("visits"), F.col("memory_id")], "one", "rank").select("query_id", "memory_id", "rank", "visits")


def fuse(items: DataFrame, scores: list[str], damping: float = DAMPING, steps: int = STEPS, local_items: int = LOCAL_ITEMS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(query_id, memory_id, rank, visits) from (query_id, memory_id, scores...), a row for each item of a query.

    Visits are multiples of the query's mean (the reciprocal of its size),
    rounded to DIGITS digits, so a query of any size keeps its order; equal
    ones are ordered by memory_id. Queries with more than ``local_items`` items are
    iterated as tables; the result is the same.

    In each score the highest value is best; null and NaN count as worst, tied
    with each other. Rows with a null query or memory are left out; repeated
    items count once, with their highest scores. Extra columns are dropped. An
    empty table gives an empty one.
    """
    keys = ["query_id", "memory_id"]
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    once = items.where(F.col(keys[0]).isNotNull() & F.col(keys[1]).isNotNull()).groupBy(*keys).agg(*(F.max(number(c)).alias(c) for c in scores))
    once = materialize(once, "items")
    n = once.count()
    large = once.groupBy("query_id").count().where(F.col("count") > local_items).select("query_id")
    if not large.limit(1).count():
        return _local(once, n, scores, damping, steps)
    large = broadcast_if_below(materialize(large, "large"), 100_000)
    out = _distributed(once.join(large, "query_id", "left_semi"), scores, damping, steps, block_items)
    return _local(once.join(large, "query_id", "left_anti"), n, scores, damping, steps).unionByName(out)


def epoch_seconds(created_at: Column) -> Column:
    """Seconds from a time in seconds, milli-, micro- or nanoseconds; NULL for 0 and less."""
    c = created_at.cast("double")
    return F.when(c <= 0, None).when(c < 1e11, c).when(c < 1e14, c / 1e3).when(c < 1e17, c / 1e6).otherwise(c / 1e9)


def fused_hits(hits: DataFrame, memories: DataFrame, **options) -> DataFrame:
    """(query_id, memory_id, rank, visits) of all hits, by score, importance and creation time.

    The score is taken within its query, so scales that depend on the route
    don't meet. Importance is clamped to [0, 1]. A hit whose memory is missing
    has the worst importance and time.
    """
    about = memories.where(F.col("id").isNotNull()).groupBy(F.col("id").alias("memory_id")).agg(F.max(F.nanvl("importance", F.lit(None).cast("float"))).alias("importance"), F.max(epoch_seconds(F.col("created_at"))).alias("created_at"))
    about = about.withColumn("importance", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("importance").cast("double"))) * F.when(F.col("importance").isNotNull(), 1.0))
    joined = skew_safe_join(hits.select("query_id", "memory_id", "score"), about, "memory_id")
    return fuse(joined, ["score", "importance", "created_at"], **options)


def p1_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits of each query as one ranked list."""
    return fused_hits(read_table(spark, sf_dir, "hits"), read_table(spark, sf_dir, "memories"))


def p1_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the ranking of each judged query agrees with its grades: normalised discounted gain over the judged hits."""
    grades = read_table(spark, sf_dir, "judgements").where("grade IS NOT NULL").groupBy("query_id", "memory_id").agg(F.max("grade").alias("grade"))
    judged = p1_ranking(spark, sf_dir).join(grades, ["query_id", "memory_id"])
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    place = judged.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).withColumn("best", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "rank")))
    sums = place.groupBy("query_id").agg(F.sum(gain / F.log2(F.col("i") + 1)).alias("dcg"), F.sum(gain / F.log2(F.col("best") + 1)).alias("ideal"), F.count(F.lit(1)).alias("n_judged"))
    return sums.select("query_id", "n_judged", F.round(F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")), 9).alias("ndcg"))


_WALK = f"""
WITH RECURSIVE about AS (SELECT id AS memory_id, CASE WHEN count(*) FILTER (importance::VARCHAR <> 'nan') > 0 THEN least(1, greatest(0, max(importance) FILTER (importance::VARCHAR <> 'nan')::DOUBLE)) END AS importance, max(created_at) FILTER (created_at > 0) AS raw FROM memories WHERE id IS NOT NULL GROUP BY id),
given AS (SELECT query_id, memory_id, max(score) FILTER (score::VARCHAR <> 'nan') AS score FROM hits WHERE query_id IS NOT NULL AND memory_id IS NOT NULL GROUP BY ALL),
long AS (SELECT query_id AS q, memory_id AS i, unnest([1, 2, 3]) AS k, coalesce(unnest([score, importance, CASE WHEN raw < 1e11 THEN raw::DOUBLE WHEN raw < 1e14 THEN raw / 1e3 WHEN raw < 1e17 THEN raw / 1e6 ELSE raw / 1e9 END]), '-infinity'::DOUBLE) AS v FROM given LEFT JOIN about USING (memory_id)),
reach AS (SELECT *, count(*) OVER (PARTITION BY q, k ORDER BY v DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM long),
jump AS (SELECT a.q, a.i, b.i AS j, sum(1 / a.n::DOUBLE) / 3 AS w FROM reach a JOIN reach b ON a.q = b.q AND a.k = b.k AND b.v >= a.v GROUP BY ALL),
size AS (SELECT query_id AS q, count(*)::DOUBLE AS n FROM given GROUP BY 1),
walk AS (SELECT 0 AS step, query_id AS q, memory_id AS i, 1 / n AS mass FROM given JOIN size ON q = query_id
  UNION ALL SELECT step + 1, s.q, j, (1 - {DAMPING}) / s.n + {DAMPING} * sum(mass * w) FROM walk JOIN jump USING (q, i) JOIN size s USING (q) WHERE step < {STEPS} GROUP BY step, s.q, s.n, j),
ranked AS (SELECT q AS query_id, i AS memory_id, row_number() OVER (PARTITION BY q ORDER BY round(mass * n, {DIGITS}) DESC, i) AS rank, round(mass * n, {DIGITS}) AS visits FROM walk JOIN size USING (q) WHERE step = {STEPS})"""

SQL = {
    "p1_ranking": f"{_WALK} SELECT query_id, memory_id, rank, visits FROM ranked",
    "p1_agreement": f"""{_WALK},
grades AS (SELECT query_id, memory_id, max(grade) AS grade FROM judgements WHERE grade IS NOT NULL GROUP BY ALL),
places AS (SELECT query_id, pow(2, grade) - 1 AS gain, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, rank) AS best FROM ranked JOIN grades USING (query_id, memory_id))
SELECT query_id, count(*) AS n_judged, round(CASE WHEN sum(gain / log2(best + 1)) > 0 THEN sum(gain / log2(i + 1)) / sum(gain / log2(best + 1)) END, 9) AS ndcg FROM places GROUP BY query_id""",
}
