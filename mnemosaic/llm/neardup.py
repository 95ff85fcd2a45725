"""Problem 3: near-duplicate records with small edits.

The similarity of two contents is that of their bags of words: the sum of the
smaller counts over the sum of the larger ones. A bag is a set of (word, n-th
occurrence) tokens, so this is a Jaccard similarity, and minhash symbols agree
with just that probability.

Candidates come from a generalised pigeonhole over the code of minhash bits.
The bits of one symbol flip together, so they stay in one group; symbols form
partitions of unequal width, each with a threshold of its own: a pair is probed if some partition differs in at most
that many symbols (0 or 1; a partition with threshold 1 probes all its subsets
without one symbol). A dynamic program picks widths and thresholds that give
the fewest rows and estimated candidate pairs among all that miss a pair at
the least similarity with a probability of at most ``miss``. (A fixed number of
differing symbols, as for Hamming distances, cannot be promised at a
similarity of 0.7: it would need partitions of two symbols, which nearly all
pairs share. So the pigeonhole's budget is one of probability.) The estimate takes the
agreement of symbols among a bounded sample; everything else covers all rows.

Pairs that meet in a partition are compared by a sketch of 256 bits and by size,
and the survivors exactly, by their tokens. Exact copies of a content are one
class throughout and probed once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import runtime
from ..runtime import broadcast_if_below, materialize, read_table, skew_safe_join
from .codepoints import list_array, slices
from .components import components
from .repetition import mix, words_of
from .sampling import bounded_sample

SAMPLE = 2000  # contents for the estimate of candidate counts
SKETCH_BITS = 256
SKETCH_CUT = 59  # bits that may differ; at a similarity of 0.7 each differs with 0.15, so this loses two pairs in 10 000
SKETCH = [f"s{k}" for k in range(SKETCH_BITS // 64)]
PAIR_COST = 0.02  # what comparing two sketches that met costs, against shuffling and sorting a row
ALL_PAIRS = 4096  # default: two classes of copies with more pairs than this are linked through their representatives
MISS = 0.01  # the probability with which a pair at just the least similarity may be missed; for one at 0.8 it is below 0.0001
HOT_KEY = 8192  # contents with one key that are compared in one task
KEY_BLOCK = 4096  # of a key with more, the contents of one block
SALT_ROWS = 20_000  # members of a class in one join task

_rng = np.random.default_rng(20240607)
_MULTIPLY = (_rng.integers(0, 1 << 63, 4096, np.uint64) << np.uint64(1)) | np.uint64(1)
_XOR = _rng.integers(0, 1 << 63, 4096, np.uint64)


@dataclass(frozen=True)
class Partition:
    width: int
    threshold: int

    @property
    def keys(self) -> int:
        return self.width if self.threshold else 1

    def meets(self, j):
        """The probability that a pair of similarity ``j`` meets here."""
        whole = j**self.width
        return whole + self.width * j ** (self.width - 1) * (1 - j) if self.threshold else whole


def allocate(n: int, similarities: np.ndarray, least: float, miss: float, pair_cost: float = PAIR_COST, most_keys: int = 96) -> list[Partition]:
    """Partitions with thresholds for ``n`` contents, by dynamic programming.

    ``similarities`` are those of random pairs. State: how much of the budget
    -ln(miss) is filled; value: rows to shuffle plus ``pair_cost`` times the
    estimated candidates. Gains are rounded down, so the budget holds.
    """
    need, steps = -math.log(miss), 960
    similarities = similarities if len(similarities) else np.zeros(1)
    choices = []
    for width in range(3, 13):
        for threshold in (0, 1):
            p = Partition(width, threshold)
            gain = -math.log1p(-p.meets(least)) / need * steps
            cost = p.keys * n + pair_cost * n * n / 2 * float(np.mean(p.meets(similarities)))
            choices.append((p, gain, cost))
    best: list[tuple[float, int, tuple[int, ...]]] = [(0.0, 0, ())] + [(math.inf, 0, ())] * steps
    for filled in range(steps):
        value, keys, chosen = best[filled]
        if value == math.inf:
            continue
        for k, (p, gain, cost) in enumerate(choices):
            to = min(steps, filled + math.floor(gain))
            if to > filled and keys + p.keys <= most_keys and value + cost < best[to][0]:
                best[to] = (value + cost, keys + p.keys, (*chosen, k))
    if best[steps][0] == math.inf:
        return allocate(n, similarities, least, miss, pair_cost, most_keys * 2)
    return [choices[k][0] for k in best[steps][2]]


def bag_tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the (word, n-th occurrence) tokens of all texts, and how many each text has."""
    words, of = words_of(texts)
    order = np.lexsort((words, of))
    words, of = words[order], of[order]
    first = np.append(True, (words[1:] != words[:-1]) | (of[1:] != of[:-1])) if len(words) else np.empty(0, bool)
    at = np.arange(len(words))
    nth = at - np.maximum.accumulate(np.where(first, at, 0)) if len(words) else at
    tokens = mix(words + mix(nth.astype(np.uint64)))
    order = np.lexsort((tokens, of))
    return tokens[order], np.bincount(of, minlength=len(texts))


def symbols(tokens: np.ndarray, counts: np.ndarray, functions: range) -> np.ndarray:
    """Minhash symbols, a row for each function; every text has a token at least."""
    begin = np.cumsum(counts) - counts
    out = np.empty((len(functions), len(counts)), np.uint64)
    for row, k in enumerate(functions):
        h = (tokens ^ _XOR[k]) * _MULTIPLY[k]
        out[row] = np.minimum.reduceat(h, begin)
    return out


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].view(np.uint64), np.diff(offsets)


def partition_keys(tokens: np.ndarray, counts: np.ndarray, plan: list[Partition]) -> tuple[np.ndarray, np.ndarray]:
    """(words of the sketch of each text, its keys), a row for each word and each key."""
    bits = mix(symbols(tokens, counts, range(SKETCH_BITS))) & np.uint64(1)
    sketch = np.bitwise_or.reduce((bits << np.tile(np.arange(64, dtype=np.uint64), SKETCH_BITS // 64)[:, None]).reshape(SKETCH_BITS // 64, 64, -1), 1)
    keys, k = [], SKETCH_BITS
    for number, p in enumerate(plan):
        s = symbols(tokens, counts, range(k, k + p.width))
        k += p.width
        s = mix(s + np.arange(p.width, dtype=np.uint64)[:, None])
        whole = s.sum(0, dtype=np.uint64)
        for left in range(p.width) if p.threshold else (None,):
            salt = np.uint64(number * 64 + (63 if left is None else left))
            keys.append(mix((whole if left is None else whole - s[left]) + mix(np.array([salt]))))
    return sketch, np.array(keys)


def class_table(contents: DataFrame, min_words: int) -> tuple[DataFrame, DataFrame]:
    """(members, classes): id and hash of each content, once; a row for each distinct eligible content, with its tokens and the number of ids that have it."""
    text = contents.select("id", "content").where(F.col("id").isNotNull() & F.is_valid_utf8(F.col("content").cast("string")))
    members = text.select("id", F.unhex(F.md5("content")).alias("hash")).dropDuplicates(["id", "hash"])
    # Counted without the contents, which so are shuffled once only.
    copies = members.groupBy("hash").agg(F.count(F.lit(1)).alias("copies"))
    whole = text.groupBy(F.unhex(F.md5("content")).alias("hash")).agg(F.min("id").alias("rep"), F.first("content").alias("content")).join(copies, "hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("content").cast(pa.string())
            for a, b in slices(column):
                tokens, counts = bag_tokens(column.slice(a, b - a).to_pylist())
                long = counts >= min_words
                keep = pa.array(np.flatnonzero(long) + a)
                values = tokens[np.repeat(long, counts)].view(np.int64)
                head = [batch.column(c).take(keep) for c in ("rep", "hash", "copies")]
                yield pa.RecordBatch.from_arrays([*head, pa.array(counts[long], pa.int32()), list_array(values, counts[long], pa.int64())], names=["rep", "hash", "copies", "n", "tokens"])

    classes = whole.select("rep", "hash", "copies", "content").mapInArrow(run, "rep long, hash binary, copies long, n int, tokens array<long>")
    return members, materialize(classes, "bags")


def plan_partitions(classes: DataFrame, least: float, miss: float) -> tuple[int, list[Partition]]:
    """The number of contents, and thresholds for them. The sample has at most SAMPLE contents, chosen by a hash of their ids; of each only 64 symbols reach the driver."""
    n = classes.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = symbols(*_flat(batch.column(0)), range(64))
                yield pa.RecordBatch.from_arrays([list_array(s.T.ravel().view(np.int64), np.full(batch.num_rows, 64), pa.int64())], names=["s"])

    some = bounded_sample(classes.select("rep", "tokens"), "rep", n, SAMPLE).select("tokens").mapInArrow(run, "s array<long>").toArrow()["s"].to_numpy()
    if len(some) < 2:
        return n, [Partition(3, 0)]
    agree = np.zeros((len(some), len(some)), np.int16)
    for row in np.stack(some).T:
        agree += row[:, None] == row[None, :]
    similarities = agree[np.triu_indices(len(some), 1)] / 64
    return n, allocate(n, similarities[similarities < least], least, miss)


def _meet(probes: DataFrame, n: int, near: Column) -> DataFrame:
    """(repa, repb), repa < repb, of the contents that share a key and are ``near``, once for each key.

    A key with more than HOT_KEY contents is cut into blocks by a hash of the
    content, and each pair of blocks meets in a join group of its own.
    """
    both = [[F.col(c).alias(c + s) for c in ("rep", "n", *SKETCH)] for s in "ab"]

    def join(p: DataFrame) -> DataFrame:
        a, b = (p.select("key", *x) for x in both)
        return a.join(b.hint("merge"), "key").where(near & (F.col("repa") < F.col("repb"))).select("repa", "repb")

    if n <= HOT_KEY:  # no key can have more contents than there are
        return join(probes)
    counts = probes.groupBy("key").count().where(F.col("count") > HOT_KEY)
    hot = materialize(counts.select("key", F.ceil(F.col("count") / KEY_BLOCK).cast("int").alias("blocks")), "hot")
    if not hot.limit(1).count():
        return join(probes)
    few = broadcast_if_below(hot, 100_000)
    marked = probes.join(few, "key").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    a = marked.select("key", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"), *both[0])
    b = marked.select("key", F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"), *both[1])
    met = a.join(b.hint("merge"), ["key", "i", "j"]).where(near & ((F.col("i") < F.col("j")) | (F.col("repa") < F.col("repb"))))
    met = met.select(F.least("repa", "repb").alias("repa"), F.greatest("repa", "repb").alias("repb"))
    return join(probes.join(few, "key", "left_anti")).unionByName(met)


def similar_classes(classes: DataFrame, least: float, miss: float) -> DataFrame:
    """Pairs a < b of class representatives whose similarity is at least ``least``, and how many tokens they have in ``common``."""
    total, plan = plan_partitions(classes, least, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                tokens, counts = _flat(part.column(2))
                sketch, keys = partition_keys(tokens, counts, plan)
                many = np.tile(np.arange(part.num_rows), len(keys))
                take = pa.array(many)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), part.column(0).take(take), part.column(1).take(take), *(pa.array(w.view(np.int64)[many]) for w in sketch)], names=["key", "rep", "n", *SKETCH])

    probes = classes.select("rep", "n", "tokens").mapInArrow(run, "key long, rep long, n int, " + ", ".join(f"{c} long" for c in SKETCH))
    ratio = round(least * 1000)
    near = (
        (sum((F.bit_count(F.col(c + "a").bitwiseXOR(F.col(c + "b"))) for c in SKETCH[1:]), F.bit_count(F.col(SKETCH[0] + "a").bitwiseXOR(F.col(SKETCH[0] + "b")))) <= SKETCH_CUT)
        & (F.col("na") * 1000 >= F.col("nb") * ratio)
        & (F.col("nb") * 1000 >= F.col("na") * ratio)
    )
    met = _meet(probes, total, near).groupBy("repa", "repb").agg(F.lit(1).alias("one")).select("repa", "repb")
    bags = classes.select("rep", "tokens")
    both = met.join(bags.withColumnsRenamed({"rep": "repa", "tokens": "ta"}), "repa").join(bags.withColumnsRenamed({"rep": "repb", "tokens": "tb"}), "repb")
    common = F.size(F.array_intersect("ta", "tb"))
    return both.where(common * 1000 >= ratio * (F.size("ta") + F.size("tb") - common)).select("repa", "repb", common.alias("common"))


def _with_salt(df: DataFrame, rep: str, copies: str, spread: bool) -> DataFrame:
    """A salt below the number of join tasks that the class needs: one for each row, or all of them."""
    tasks = F.ceil(F.col(copies) / SALT_ROWS).cast("int")
    return df.withColumn("salt", F.pmod(F.xxhash64("id"), tasks).cast("int") if spread else F.explode(F.sequence(F.lit(0), tasks - 1)))


def members_of(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, rep, copies) of the members of ``class_table``; classes with many copies are known by their count."""
    hot = classes.where(F.col("copies") > runtime.HOT_ROWS).select("hash")
    return skew_safe_join(members, classes.select("hash", "rep", "copies"), "hash", "inner", hot=hot).select("id", "rep", "copies")


def near_duplicates(contents: DataFrame, least: float = 0.7, min_words: int = 20, miss: float = MISS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, classes, links) of the near-duplicates among ``contents`` (id, content).

    members: id and rep of each document with at least ``min_words`` words;
    classes: rep, copies, n and tokens of each distinct content; links: pairs of
    classes of at least ``least``, ``repa`` < ``repb``.

    Null contents, null ids and contents that aren't UTF-8 take no part.
    Repeated rows (same id and content) count once. Empty tables give empty
    results. Other columns aren't read.
    """
    members, classes = class_table(contents, min_words)
    return members_of(members, classes), classes, materialize(similar_classes(classes, least, miss), "links")


def expand(members: DataFrame, links: DataFrame, classes: DataFrame, all_pairs: int | None = ALL_PAIRS) -> DataFrame:
    """Pairs of ids from pairs of classes, and those inside classes.

    Copies are linked all with all where two classes have at most ``all_pairs``
    pairs, or everywhere if that is None; beyond it each member is linked with
    the other class's representative only, so that a group of exact copies adds
    rows in proportion to its size, not to its square. No link between two
    different texts is lost by that. A class is spread over as many tasks as it
    needs either way.
    """
    sizes = classes.select("rep", "copies")
    pairs = links.join(sizes.withColumnsRenamed({"rep": "repa", "copies": "ca"}), "repa").join(sizes.withColumnsRenamed({"rep": "repb", "copies": "cb"}), "repb")
    inside = sizes.where("copies > 1").select(F.col("rep").alias("repa"), F.col("rep").alias("repb"), F.col("copies").alias("ca"), F.col("copies").alias("cb"))
    pairs = pairs.select("repa", "repb", "ca", "cb").unionByName(inside)
    small = F.lit(True) if all_pairs is None else F.col("ca") * F.col("cb") <= all_pairs

    def side(df: DataFrame, rep: str, copies: str, to: str) -> DataFrame:
        # A content without copies is its own representative, so only copies have to be looked up.
        many = members.where("copies > 1").select(F.col("rep").alias(rep), F.col("copies").alias("__c"), "id")
        found = _with_salt(df.where(F.col(copies) > 1), rep, copies, False).join(_with_salt(many, rep, "__c", True).select(rep, "salt", F.col("id").alias(to)), [rep, "salt"]).drop("salt")
        return df.where(F.col(copies) == 1).withColumn(to, F.col(rep)).unionByName(found)

    full = side(side(pairs.where(small), "repa", "ca", "x"), "repb", "cb", "y").select("x", "y")
    left = side(pairs.where(~small), "repa", "ca", "x").select("x", F.col("repb").alias("y"))
    right = side(pairs.where(~small), "repb", "cb", "y").select(F.col("repa").alias("x"), "y")
    out = full.unionByName(left).unionByName(right).where("x <> y")
    return out.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of memories with at least 20 words each of which at least 0.7 are shared.

    All pairs are given, but for groups of exact copies of which two have more
    than ALL_PAIRS (4 096) pairs of ids: these are linked through their smallest
    ids (``expand`` with None gives all). p3_members and p3_links hold the whole
    result in rows that grow with the classes, whatever the copies.
    """
    members, classes, links = near_duplicates(read_table(spark, sf_dir, "memories"))
    return expand(members, links, classes)


def p3_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of exact copies of each memory with at least 20 words, named by its smallest id, and how many it has."""
    members, classes = class_table(read_table(spark, sf_dir, "memories"), 20)
    return members_of(members, classes)


def p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of classes of which at least 0.7 of the words are shared, by their representatives; with p3_members this is all of p3_found."""
    _, classes = class_table(read_table(spark, sf_dir, "memories"), 20)
    return similar_classes(classes, 0.7, MISS).select(F.col("repa").alias("rep_a"), F.col("repb").alias("rep_b"), "common")


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of each memory that has a near-duplicate: the connected pairs, named by their smallest id; and how many memories it is linked with."""
    members, classes, links = near_duplicates(read_table(spark, sf_dir, "memories"))
    labels = components(links.select(F.col("repa").alias("a"), F.col("repb").alias("b")))
    sizes = classes.select("rep", "copies")
    ends = links.select(F.col("repa").alias("rep"), F.col("repb").alias("to")).unionByName(links.select(F.col("repb").alias("rep"), F.col("repa").alias("to")))
    partners = ends.join(sizes.withColumnsRenamed({"rep": "to", "copies": "m"}), "to").groupBy("rep").agg(F.sum("m").alias("m"))
    info = sizes.join(partners, "rep", "left").join(labels.withColumnsRenamed({"node": "rep"}), "rep", "left")
    info = info.select("rep", F.coalesce("label", "rep").alias("group_id"), (F.coalesce("m", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return skew_safe_join(members.select("id", "rep"), info.where("n_links > 0"), "rep", "inner").select("id", "group_id", "n_links")


_CLASSES = """
WITH t AS (SELECT min(id) AS id, text FROM (SELECT id, TRY(decode(content)) AS text FROM memories WHERE id IS NOT NULL) WHERE text IS NOT NULL GROUP BY text),
"""
_BAGS = r"""
w AS (SELECT id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word FROM t WHERE text IS NOT NULL),
k AS (SELECT id, word, row_number() OVER (PARTITION BY id, word) AS nth, count(*) OVER (PARTITION BY id) AS n FROM w),
e AS (SELECT * FROM k WHERE n >= 20)"""
_PAIRS = """
FROM e a JOIN e b ON a.word = b.word AND a.nth = b.nth AND a.id < b.id AND a.n * 10 >= b.n * 7 AND b.n * 10 >= a.n * 7
GROUP BY a.id, b.id, a.n, b.n HAVING count(*) * 10 >= 7 * (a.n + b.n - count(*))"""

SQL = {
    "p3_found": f"WITH t AS (SELECT DISTINCT id, TRY(decode(content)) AS text FROM memories WHERE id IS NOT NULL), {_BAGS} SELECT a.id AS id_a, b.id AS id_b {_PAIRS}",
    "p3_links": f"{_CLASSES} {_BAGS} SELECT a.id AS rep_a, b.id AS rep_b, count(*)::INT AS common {_PAIRS}",
    "p3_members": r"""
WITH t AS (SELECT DISTINCT id, TRY(decode(content)) AS text FROM memories WHERE id IS NOT NULL)
SELECT id, min(id) OVER (PARTITION BY text) AS rep, count(*) OVER (PARTITION BY text) AS copies FROM t WHERE text IS NOT NULL AND len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) >= 20""",
    "p3_groups": f"""WITH RECURSIVE t AS (SELECT DISTINCT id, TRY(decode(content)) AS text FROM memories WHERE id IS NOT NULL), {_BAGS},
p AS (SELECT a.id AS x, b.id AS y {_PAIRS}), l AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r AS (SELECT DISTINCT x AS id, x AS label FROM l UNION SELECT l.y, r.label FROM r JOIN l ON l.x = r.id WHERE r.label < l.y)
SELECT id, min(label) AS group_id, any_value(n) AS n_links FROM r JOIN (SELECT x, count(*) AS n FROM l GROUP BY x) ON x = id GROUP BY id""",
}
