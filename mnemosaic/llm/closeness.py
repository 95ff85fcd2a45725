"""Problem 5: all neighbours of at least a given cosine, without a miss.

Vectors are turned to the principal axes of a sample and pairs are ruled out by
bounds that hold for every pair: with x', y' the first AXES components and |x"|,
|y"| the lengths of what is left, x y is at most x' y' + |x"| |y"|. A pair that
the bound leaves is scored in full. The sample only decides what the bounds
cost, not what is found.

A search tree over the same components cuts the table into blocks, written as
files; a task compares two of them, reading both from the shared folder, so no
row is copied however many blocks there are. Inside, one block is cut into
leaves, and only rows near enough to a leaf's box are compared with it. Work
grows with the square of the table, memory of a task doesn't.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame

from ..runtime import scratch_path
from .vectors import EDGE, matrix, unit

AXES = 24  # components of the first bound
BLOCK_ROWS = 131_072  # rows of a block at most
LEAST_ROWS = 8_192  # rows for which a block is worth a task
BLOCKS = 8  # blocks aimed at, where they are large enough
LEAF = 2_048  # rows of a leaf
SLAB = 512  # rows of a product that stays in the cache
HELD = 2_000_000  # pairs held before only the best of each row are kept
TILES = 20_000  # tasks at most
SLACK = 1e-5  # more than 32-bit bounds and scores can be wrong by


def axes(sample: np.ndarray) -> np.ndarray:
    """The first principal axes of unit vectors, as columns."""
    x = sample.astype(np.float64)
    y = x - x.mean(0) if len(x) else x
    return np.linalg.eigh(y.T @ y)[1][:, ::-1][:, :AXES]


def turned(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The components along the axes and the length of the rest: products of two such rows are never below those of the whole rows."""
    x = x.astype(np.float64)
    y = x @ basis
    rest = np.sqrt(np.maximum((x * x).sum(1) - (y * y).sum(1), 0))
    return np.column_stack([y, rest]).astype(np.float32)


class Tree:
    """Halves along the widest component, again and again; a block is a box that may be open."""

    def __init__(self, y: np.ndarray, depth: int):
        self.depth, width = depth, y.shape[1]
        self.axis, self.cut = np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1, np.float32)
        self.low, self.high = np.full((2**depth, width), -np.inf, np.float32), np.full((2**depth, width), np.inf, np.float32)

        def split(node: int, rows: np.ndarray, level: int) -> None:
            if level == depth:
                return
            if len(rows):
                self.axis[node] = y[rows].var(0).argmax()
                self.cut[node] = np.median(y[rows, self.axis[node]])
            right = y[rows, self.axis[node]] >= self.cut[node]
            span, first = 2 ** (depth - level - 1), (node - (2**level - 1)) * 2 ** (depth - level)
            below, above = slice(first, first + span), slice(first + span, first + 2 * span)
            self.high[below, self.axis[node]] = np.minimum(self.high[below, self.axis[node]], self.cut[node])
            self.low[above, self.axis[node]] = np.maximum(self.low[above, self.axis[node]], self.cut[node])
            split(2 * node + 1, rows[~right], level + 1)
            split(2 * node + 2, rows[right], level + 1)

        split(0, np.arange(len(y)), 0)

    def block(self, y: np.ndarray) -> np.ndarray:
        node = np.zeros(len(y), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (y[np.arange(len(y)), self.axis[node]] >= self.cut[node])
        return node - (2**self.depth - 1)

    def apart(self, a: int, b: int) -> float:
        """The square of the least distance between two blocks."""
        gap = np.maximum(np.maximum(self.low[a] - self.high[b], self.low[b] - self.high[a]), 0)
        return float((gap.astype(np.float64) ** 2).sum())


def leaves(y: np.ndarray, rows: int) -> tuple[np.ndarray, list[int]]:
    """An order of the rows in which leaves of at most ``rows`` lie together, and where each begins and the last ends."""
    order, ends = [], [0]

    def split(some: np.ndarray) -> None:
        if len(some) <= rows:
            order.append(some)
            ends.append(ends[-1] + len(some))
            return
        along = y[some, y[some].var(0).argmax()]
        half = len(some) // 2
        at = np.argpartition(along, half)
        split(some[at[:half]])
        split(some[at[half:]])

    split(np.arange(len(y)))
    return np.concatenate(order), ends


def best(q: np.ndarray, n: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each q the k pairs of the highest scores, and those that may tie with them."""
    order = np.lexsort((-s, q))
    q, n, s = q[order], n[order], s[order]
    first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.empty(0, np.int64)
    size = np.diff(np.append(first, len(q)))
    last = s[first + np.minimum(size, k) - 1]
    keep = s >= np.repeat(last, size) - EDGE
    return q[keep], n[keep], s[keep]


def outside(y1: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The square of each row's distance from a box."""
    gap = np.maximum(np.maximum(low - y1, y1 - high), 0)
    return np.einsum("ij,ij->i", gap, gap)


def true_at(mask: np.ndarray) -> np.ndarray:
    """Where a flat mask with few true values is true; eight values are looked at at once."""
    whole = len(mask) // 8 * 8
    word = np.flatnonzero(mask[:whole].view(np.uint64))
    at = (word[:, None] * 8 + np.arange(8)).ravel()
    return np.append(at[mask[at]], whole + np.flatnonzero(mask[whole:]))


def crowded(s: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k highest scores of each row, and those that may tie with them, if they reach ``least``."""
    last = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] > k else np.full(len(s), -2, s.dtype)
    return np.nonzero(s >= np.maximum(last - EDGE, least - SLACK)[:, None])


def close_rows(x: np.ndarray, x1: np.ndarray, y: np.ndarray, y1: np.ndarray, same: bool, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(q, n): for each row of x, and of y as len(x) and on, its k best of the other side with a score of ``least``, and ties. x and y may be the same."""
    order, ends = leaves(y1, LEAF)
    y, y1 = y[order], y1[order]
    order2, ends2 = (order, ends) if same else leaves(x1, LEAF)
    x, x1 = (y, y1) if same else (x[order2], x1[order2])
    far, shift = 2 - 2 * least + SLACK, 0 if same else len(x)
    held, many, limit = [], 0, HELD
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        leaf = y1[a:b]
        low, high = leaf.min(0), leaf.max(0)
        for a2, b2 in zip(ends2[:-1], ends2[1:], strict=True):
            if same and a2 < a:
                continue
            rows = a2 + np.flatnonzero(outside(x1[a2:b2], low, high) <= far)
            if not len(rows):
                continue
            some = x1[rows]
            columns = a + np.flatnonzero(outside(leaf, some.min(0), some.max(0)) <= far)
            if not len(columns):
                continue
            right = y1[columns].T
            pair = np.concatenate([true_at((some[at : at + SLAB] @ right >= least - SLACK).ravel()) + at * len(columns) for at in range(0, len(rows), SLAB)])
            if not len(pair):
                continue
            if 16 * len(pair) > len(rows) * len(columns):  # gathering costs more than the whole product
                s = x[rows] @ y[columns].T
                if same:
                    s[rows[:, None] <= columns] = -2
                r, c = crowded(s, k, least)
                c2, r2 = crowded(np.ascontiguousarray(s.T), k, least)
                some = np.append(rows[r], columns[c2] + shift), np.append(columns[c] + shift, rows[r2]), np.append(s[r, c], s[r2, c2])
            else:
                r, c = rows[pair // len(columns)], columns[pair % len(columns)]
                s = np.einsum("ij,ij->i", x[r], y[c])
                keep = (s >= least - SLACK) & (r > c if same else True)
                r, c, s = r[keep], c[keep], s[keep]
                some = np.append(r, c + shift), np.append(c + shift, r), np.append(s, s)
            if not len(some[0]):
                continue
            held.append(some)
            many += len(held[-1][0])
            if many > limit:
                held = [best(*(np.concatenate([h[i] for h in held]) for i in range(3)), k)]
                many = len(held[0][0])
                limit = max(HELD, 2 * many)
    if not held:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    q, n, _ = best(*(np.concatenate([h[i] for h in held]) for i in range(3)), k)
    back = order if same else np.append(order2, len(x) + order)
    return back[q], back[n]


def cosines(y: np.ndarray, z: np.ndarray) -> np.ndarray:
    y, z = y.astype(np.float64), z.astype(np.float64)
    y, z = y / np.abs(y).max(1, keepdims=True, initial=1e-300), z / np.abs(z).max(1, keepdims=True, initial=1e-300)
    return np.round((y * z).sum(1) / np.sqrt((y * y).sum(1) * (z * z).sum(1)), 12)


def depth_of(count: int) -> int:
    return max(0, math.ceil(math.log2(max(1, count) / min(BLOCK_ROWS, max(LEAST_ROWS, count / BLOCKS)))))


def close_pairs(entries: DataFrame, count: int, sample: np.ndarray, k: int, least: float) -> DataFrame:
    """(q, n, cosine): for each asking entry the k best of all others with a cosine of about ``least`` or more, in each pair of blocks, and ties. ``sample`` are unit vectors."""
    spark = entries.sparkSession
    basis = axes(sample)
    tree = Tree(turned(sample, basis), depth_of(count))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = tree.block(turned(unit(matrix(batch.column(2))), basis)) if batch.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), *batch.columns], ["block", "rep", "asks", "vector"])

    path = scratch_path(spark, "blocks")
    blocks = entries.select("rep", "asks", "vector").mapInArrow(assign, "block int, rep long, asks boolean, vector array<float>")
    blocks.repartition(2**tree.depth, "block").write.option("maxRecordsPerFile", BLOCK_ROWS).partitionBy("block").parquet(path)
    files = sorted(spark.read.schema("rep long").parquet(path).inputFiles())
    box = [int(re.search(r"/block=(\d+)/", f)[1]) for f in files]
    # Each pair of files once, and as many for each file: a with a, a + 1, ... half the way round.
    count, half = len(files), len(files) // 2 + 1

    def load(at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        fs, name = pyarrow.fs.FileSystem.from_uri(files[at])
        with fs.open_input_file(name) as f:
            table = pq.ParquetFile(f).read(["rep", "asks", "vector"])
        return table["rep"].to_numpy(), table["asks"].to_numpy(), matrix(table["vector"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile in batch.column(0).to_numpy():
                a, d = divmod(int(tile), half)
                b = (a + d) % count
                if d and 2 * d == count and a > b or tree.apart(box[a], box[b]) > 2 - 2 * least + SLACK:
                    continue
                rep, asks, raw = load(a)
                x = unit(raw)
                x1 = turned(x, basis)
                if d:
                    rep2, asks2, raw2 = load(b)
                    y = unit(raw2)
                    q, n = close_rows(x, x1, y, turned(y, basis), False, k, least)
                    rep, asks, raw = np.append(rep, rep2), np.append(asks, asks2), np.concatenate([raw, raw2])
                else:
                    q, n = close_rows(x, x1, x, x1, True, k, least)
                n, q = n[asks[q]], q[asks[q]]
                for i in range(0, len(q), 65_536):
                    q1, n1 = q[i : i + 65_536], n[i : i + 65_536]
                    yield pa.RecordBatch.from_arrays([pa.array(rep[q1], pa.int64()), pa.array(rep[n1], pa.int64()), pa.array(cosines(raw[q1], raw[n1]))], ["q", "n", "cosine"])

    tiles = count * half
    return spark.range(0, tiles, 1, max(1, min(tiles, TILES))).mapInArrow(compare, "q long, n long, cosine double")
