"""Problem 2: cut oversized texts at natural boundaries, with overlap.

Every codepoint boundary of a text is joined to its farthest legal successor:
the end of the next piece, if a piece ends here and the next one begins at
least ``overlap`` bytes earlier, at a natural boundary too where one is near. The table of successors is then squared again and
again; after k squarings the cuts reached from the beginning of a text cover
2**k pieces. So the cuts of all texts of a batch, however long each is, come
out of a few array operations, not of a walk along each text. Very long texts
are taken in windows; a window's cuts count as far as nothing beyond it could
change them, and the next window begins with the piece after those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import broadcast_if_below, read_table
from .codepoints import PART, codepoints, slices, utf8_widths

#: A codepoint has up to 4 bytes, so a smaller limit cannot be kept; a piece has to bring 4 new bytes.
LEAST = 4
#: A boundary of a better kind is taken only if the piece then has this part of the limit at least.
FILL = 0.5
#: The next piece may begin earlier than the overlap asks for, for the beginning of a word, by this part of what it brings at most.
EARLIER = 0.25
ANY, WORD, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(6)

# What ends a sentence or clause, by script.
_STOP, _STOP_WIDE = ".!?…", "。！？"
_PAUSE, _PAUSE_WIDE = ",;:)", "、，；："
_JSON = ",}]"
_SPACES = " \t\n\r\x0b\x0c\x85\xa0  　"


def _among(cps: np.ndarray, chars: str) -> np.ndarray:
    return np.isin(cps, np.array([ord(c) for c in chars], np.uint32))


def _joins_left(cps: np.ndarray) -> np.ndarray:
    """Codepoints that belong to the one before: combining marks, joiners, variation selectors."""
    out = np.zeros(len(cps), bool)
    for a, b in ((0x300, 0x370), (0x483, 0x48A), (0x591, 0x5C0), (0x610, 0x61B), (0x64B, 0x660), (0x93A, 0x950), (0x1AB0, 0x1B00), (0x1DC0, 0x1E00), (0x200D, 0x200E), (0x20D0, 0x2100), (0x3099, 0x309B), (0xFE00, 0xFE10), (0xFE20, 0xFE30), (0x1F3FB, 0x1F400), (0xE0100, 0xE01F0)):
        out |= (cps >= a) & (cps < b)
    return out


def boundary_levels(cps: np.ndarray) -> np.ndarray:
    """How natural a cut before each codepoint is; -1 inside what belongs together."""
    n = len(cps)
    before, before2 = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    before[1:], before2[2:] = cps[:-1], cps[:-2]
    blank_before, blank_here = _among(before, _SPACES), _among(cps, _SPACES)
    level = np.zeros(n, np.int8)
    level[blank_before & ~blank_here] = WORD
    level[blank_before & _among(before2, _PAUSE) | _among(before, _PAUSE_WIDE + _JSON) & ~blank_here] = CLAUSE
    level[blank_before & _among(before2, _STOP) | _among(before, _STOP_WIDE)] = SENTENCE
    newline = before == 10
    level[newline] = LINE
    # A paragraph ends after a line that has nothing but blanks.
    filled = np.where(~blank_before, np.arange(n), 0)
    np.maximum.accumulate(filled, out=filled)
    line = np.where(newline, np.arange(n), 0)
    lines_since = np.cumsum(newline)
    level[newline & (lines_since - lines_since[filled] >= 2) & (line > 0)] = PARAGRAPH
    # Flags are pairs of regional indicators: no cut before the second of each.
    flag = (cps >= 0x1F1E6) & (cps <= 0x1F1FF)
    outside = np.where(~flag, np.arange(n), -1)
    np.maximum.accumulate(outside, out=outside)
    level[flag & ((np.arange(n) - outside) % 2 == 0)] = -1
    level[(before == 13) & (cps == 10) | _joins_left(cps) | (before == 0x200D)] = -1
    return level


def _starts(at: np.ndarray, level: np.ndarray, begin: np.ndarray, limits: np.ndarray, overlaps: np.ndarray) -> np.ndarray:
    """Where the piece after a cut at each boundary begins: at or before the overlap, at a word if one begins near, else between what belongs together, else between codepoints."""
    node = np.arange(len(begin))
    latest = np.maximum(np.searchsorted(at, at[:-1] - overlaps, "right") - 1, begin)
    most = limits - LEAST  # a piece has to bring something new
    start = np.maximum(np.searchsorted(at, at[:-1] - np.minimum(most, at[:-1] - at[latest])), begin)
    for least, room in ((0, most), (WORD, np.minimum(most, overlaps + (EARLIER * (limits - overlaps)).astype(np.int64)))):
        back = np.maximum(np.maximum.accumulate(np.where(level >= least, node, 0))[latest], begin)
        near = at[:-1] - at[back] <= room
        start[near] = back[near]
    return np.where(overlaps > 0, start, node)


def cut_texts(texts: list[str], limits: np.ndarray, overlaps: np.ndarray, after: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first byte, end byte, number) of each piece of each text; bytes count from the beginning of the text. The first piece ends beyond codepoint ``after``."""
    limits = np.maximum(limits.astype(np.int64), LEAST)
    overlaps = np.clip(overlaps.astype(np.int64), 0, limits - LEAST)
    cps = codepoints("\0".join(texts) + "\0")
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1) - 1
    begins = ends - lengths
    n = len(cps)
    of = np.repeat(np.arange(len(texts)), lengths + 1)
    at = np.zeros(n + 1, np.int64)
    np.cumsum(utf8_widths(cps), out=at[1:])
    level = boundary_levels(cps)
    level[ends] = level[begins] = PARAGRAPH

    node = np.arange(n)
    start = _starts(at, level, begins[of], limits[of], overlaps[of])
    floor = node.copy()
    floor[begins] += after
    last = np.minimum(np.searchsorted(at, at[start] + limits[of], "right") - 1, ends[of])
    successor = np.zeros(n, np.int64)
    open_ = last < ends[of]
    successor[~open_] = last[~open_]
    rest = np.flatnonzero(open_)
    for full in (True, False):
        for kind in range(PARAGRAPH, -1, -1) if full else (WORD, ANY):
            if not len(rest):
                break
            back = np.maximum.accumulate(np.where(level >= kind, node, 0))[last[rest]]
            least = at[start[rest]] + (FILL * limits[of[rest]] if full else 0)
            good = (back > floor[rest]) & (at[back] >= least)
            successor[rest[good]] = back[good]
            rest = rest[~good]
    successor[rest] = last[rest]

    reached = np.zeros(n, bool)
    reached[begins] = True
    table, count = successor, len(texts)
    while True:
        reached[table[np.flatnonzero(reached)]] = True
        if (now := int(reached.sum())) == count:
            break
        count, table = now, table[table]
    cut = np.flatnonzero(reached)
    is_begin = np.zeros(n, bool)
    is_begin[begins[lengths > 0]] = True
    piece = cut[~is_begin[cut]]
    piece = piece[lengths[of[piece]] > 0]
    previous = cut[np.searchsorted(cut, piece) - 1]
    row = of[piece]
    number = np.arange(len(piece)) - np.searchsorted(row, row)
    return row, at[start[previous]] - at[begins[row]], at[piece] - at[begins[row]], number


def cut_long(text: str, limit: int, overlap: int, part: int = PART) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, end byte) of the pieces of one text, as ``cut_texts`` has them, with windows of about ``part`` codepoints in memory."""
    first, end = [], []
    limit = max(limit, LEAST)
    part = max(part, 4 * limit)
    at = base = after = 0  # where the window begins, in codepoints and bytes
    while True:
        window = text[at : at + part]
        _, a, b, _ = cut_texts([window], np.array([limit]), np.array([overlap]), after)
        if at + part >= len(text):
            return np.concatenate([*first, a + base]), np.concatenate([*end, b + base])
        raw = window.encode()
        sure = int((a + limit + 8 < len(raw)).sum())  # these pieces, and where the next one begins, don't depend on what follows the window
        first.append(a[:sure] + base)
        end.append(b[:sure] + base)
        to = int(a[sure])
        moved = len(raw[:to].decode())
        after = len(raw[to : b[sure - 1]].decode())
        at, base = at + moved, base + to


def split_oversized(df: DataFrame, limits: DataFrame, key: list[str], text: str = "text", strategy: str = "strategy") -> DataFrame:
    """Pieces of every text with more UTF-8 bytes than the ``max_bytes`` of its strategy.

    Columns: ``key``, piece_index (from 0), start_byte, end_byte and piece. A
    piece has at most ``max_bytes`` bytes; it shares the last ``overlap_bytes``
    of the piece before, and up to EARLIER of the rest of the limit more where
    that lets it begin with a word or cuts no cluster of codepoints. Without the
    shared parts the pieces give back the text. Limits count as 4 at least,
    overlaps as 4 less than the limit at most (and up to 3 less where a whole
    codepoint has no room then). A piece before that is shorter than the overlap
    is shared wholly, with what comes before it.

    Texts within the limit, null texts and those whose strategy is null or has
    no limit give no rows. Repeated rows (same key, strategy and text) count
    once; of a strategy with several limits the smallest holds.
    """
    clash = {*key} & {"piece_index", "start_byte", "end_byte", "piece"}
    if clash:
        raise ValueError(f"column exists already: {sorted(clash)}")
    few = limits.where(F.col("strategy").isNotNull() & F.col("max_bytes").isNotNull()).groupBy(F.col("strategy").alias("__s")).agg(F.min(F.struct("max_bytes", F.coalesce("overlap_bytes", F.lit(0)).alias("o"))).alias("__l"))
    rows = df.select(*key, F.col(strategy).alias("__s"), F.col(text).alias("__text"))
    large = rows.join(broadcast_if_below(few, 10_000), "__s").where(F.octet_length("__text") > F.greatest(F.col("__l.max_bytes"), F.lit(LEAST)))
    once = large.dropDuplicates([*key, "__s", "__text"]).select(*key, F.col("__l.max_bytes").alias("__m"), F.col("__l.o").alias("__o"), "__text")
    schema = T.StructType([once.schema[c] for c in key] + [T.StructField("piece_index", T.IntegerType(), False), T.StructField("start_byte", T.LongType(), False), T.StructField("end_byte", T.LongType(), False), T.StructField("piece", T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, o, column = batch.columns[-3:]
            for a, b in slices(column, 1 << 20):
                texts = column.slice(a, b - a).to_pylist()
                if len(texts) == 1 and len(texts[0]) > PART:
                    first, end = cut_long(texts[0], m[a].as_py(), o[a].as_py())
                    row, number = np.zeros(len(end), np.int64), np.arange(len(end))
                else:
                    row, first, end, number = cut_texts(texts, m.slice(a, b - a).to_numpy(), o.slice(a, b - a).to_numpy())
                raw = [t.encode() for t in texts]
                pieces = [raw[r][x:y].decode() for r, x, y in zip(row.tolist(), first.tolist(), end.tolist())]
                keys = [batch.column(k).slice(a, b - a).take(pa.array(row)) for k in range(len(key))]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(number, pa.int32()), pa.array(first, pa.int64()), pa.array(end, pa.int64()), pa.array(pieces, pa.string())], names=schema.names)

    return once.mapInArrow(run, schema)


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbered pieces of all oversized chunks."""
    return split_oversized(read_table(spark, sf_dir, "chunks"), read_table(spark, sf_dir, "chunk_limits"), ["item_id", "chunk_index"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that had to be cut: those with a second piece."""
    return p2_pieces(spark, sf_dir).where("piece_index = 1").select("item_id", "chunk_index").distinct()


def p2_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each oversized chunk: whether all pieces keep to the limit, share at least the overlap (or all there is before), are numbered without gaps, and without the shared parts give back the text."""
    chunks, limits = read_table(spark, sf_dir, "chunks"), read_table(spark, sf_dir, "chunk_limits")
    key = ["item_id", "chunk_index"]
    few = limits.groupBy("strategy").agg(F.min(F.struct("max_bytes", F.coalesce("overlap_bytes", F.lit(0)).alias("o"))).alias("l"))
    texts = chunks.select(*key, "strategy", "text").distinct().join(broadcast_if_below(few, 10_000), "strategy")
    pieces = split_oversized(chunks, limits, key).withColumn("size", F.octet_length("piece"))
    listed = pieces.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("piece_index", "start_byte", "end_byte", "size", "piece"))).alias("p"))  # the pieces of one text
    before = F.concat(F.array(F.lit(0).cast("long")), F.col("p.end_byte"))
    new = F.transform("p", lambda x, i: F.substring(F.encode(x["piece"], "UTF-8"), (F.get(before, i) - x["start_byte"] + 1).cast("int"), (x["end_byte"] - F.get(before, i)).cast("int")))
    shared = F.forall(F.transform("p", lambda x, i: (F.get(before, i) - x["start_byte"] >= F.least(F.col("l.o"), F.col("l.max_bytes") - LEAST)) | (x["start_byte"] == 0)), lambda ok: ok)
    fits = F.forall("p", lambda x: (x["size"] <= F.col("l.max_bytes")) & (x["size"] == x["end_byte"] - x["start_byte"]))
    counted = F.forall(F.transform("p", lambda x, i: x["piece_index"] == i), lambda ok: ok)
    return texts.join(listed, key).select(*key, fits.alias("fits"), shared.alias("shares"), counted.alias("counted"), (F.aggregate(new, F.lit(b""), lambda s, x: F.concat(s, x)) == F.encode("text", "UTF-8")).alias("whole"))


SQL = {
    "p2_check": "SELECT DISTINCT item_id, chunk_index, true AS fits, true AS shares, true AS counted, true AS whole FROM chunks JOIN chunk_limits USING (strategy) WHERE strlen(text) > max_bytes",
    "p2_found": "SELECT DISTINCT item_id, chunk_index FROM chunks JOIN chunk_limits USING (strategy) WHERE strlen(text) > max_bytes",
}
