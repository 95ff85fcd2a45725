"""Problem 7: encode a corpus with a public byte-level BPE tokenizer.

Pre-tokenisation runs over the codepoints of a whole batch at once. Each
codepoint is a class; each class is a function on the states of a small
automaton; these functions form a finite monoid whose product is a table, so
the state before every codepoint comes from an associative scan: all blocks of
the batch advance together, then the products of the blocks are combined. No
regular expression is used. The slices go to pair merging: a dictionary holds
the pieces met before, and the new ones of a batch are merged together, all
pieces of a length as one matrix.

Results: null and empty texts have an empty list of ids. Ids follow the
``tokenizers`` and ``tiktoken`` libraries, with the strings of special tokens
taken as ordinary text.
"""

from __future__ import annotations

import functools
import heapq
import json
import os
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import read_table
from . import codepoints as codepoints_module
from .codepoints import LETTER, NUMBER, SPACE, class_table, codepoints, list_array, parts_of, slices, utf8_widths

DEFAULT = "byte_bpe_50k"


def tokenizer_path(name: str = DEFAULT) -> str:
    """The vocabulary file of a byte-level BPE: a path, or the name of a public one."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return str(public_tokenizers.path(f"{name}.json"))


# Pre-tokenisation -----------------------------------------------------------

# What a codepoint is to the automaton. END stands between two texts.
(C_LETTER, C_SDMT, C_L, C_VR, C_E, C_NUMBER, C_BLANK, C_SPACE, C_QUOTE, C_OTHER, C_END) = range(11)
# The states: START, inside letters, numbers or others, after a blank (0x20) or other white space, after an
# apostrophe that may begin a contraction, after its l, after its v or r, after a whole contraction.
(START, IN_L, IN_N, IN_O, BLANK, WHITE, QUOTE, QUOTE_L, QUOTE_VR, DONE) = range(10)
CUT, CUT_BEFORE = 1, 2  # a piece begins at this codepoint; one begins at the codepoint before

_LETTERS = (C_LETTER, C_SDMT, C_L, C_VR, C_E)


def _step(state: int, c: int) -> tuple[int, int]:
    """The next state, and where pieces begin."""
    if c == C_END:
        return START, CUT
    if c in (C_BLANK, C_SPACE):
        to = BLANK if c == C_BLANK else WHITE
        return to, 0 if state in (BLANK, WHITE) else CUT
    # What is not white space takes one blank before it along; of longer white space the last codepoint is split off.
    cut = {BLANK: CUT_BEFORE, WHITE: CUT | CUT_BEFORE}.get(state, CUT)
    if c in _LETTERS:
        if state == QUOTE:
            if c == C_SDMT:
                return DONE, 0
            if c in (C_L, C_VR):
                return (QUOTE_L if c == C_L else QUOTE_VR), 0
        if (state, c) in ((QUOTE_L, C_L), (QUOTE_VR, C_E)):
            return DONE, 0
        if state in (QUOTE_L, QUOTE_VR):  # no contraction: letters began one codepoint before
            return IN_L, CUT_BEFORE
        return IN_L, 0 if state == IN_L else cut
    late = CUT_BEFORE if state in (QUOTE_L, QUOTE_VR) else 0
    if c == C_NUMBER:
        return IN_N, 0 if state == IN_N else cut | late
    if c == C_QUOTE and state not in (BLANK, IN_O, QUOTE):
        return QUOTE, cut | late
    return IN_O, 0 if state in (IN_O, QUOTE) else cut | late


@functools.cache
def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(element of each class, product table, elements' maps, cuts by state and class, class by codepoint)."""
    states, classes = DONE + 1, C_END + 1
    step = [[_step(s, c) for c in range(classes)] for s in range(states)]
    cuts = np.array([[x[1] for x in row] for row in step], np.uint8)
    maps = [tuple(range(states))]  # the identity comes first
    index = {maps[0]: 0}

    def element(m: tuple[int, ...]) -> int:
        if m not in index:
            index[m] = len(maps)
            maps.append(m)
        return index[m]

    of_class = [element(tuple(step[s][c][0] for s in range(states))) for c in range(classes)]
    # The monoid: close under composition with the generators, then tabulate all products.
    k = 0
    while k < len(maps):
        for g in of_class:
            element(tuple(maps[g][x] for x in maps[k]))
        k += 1
    product = np.array([[index[tuple(b[x] for x in a)] for b in maps] for a in maps], np.uint16)
    # END seen from QUOTE_L or QUOTE_VR: the quote and the letter are two pieces.
    late = cuts[:, C_END]
    late[[QUOTE_L, QUOTE_VR]] |= CUT_BEFORE
    for s in (QUOTE_L, QUOTE_VR):
        cuts[s, [C_BLANK, C_SPACE]] |= CUT_BEFORE
    kinds = class_table()
    to = np.full(4, C_OTHER, np.uint8)
    to[[LETTER, NUMBER, SPACE]] = C_LETTER, C_NUMBER, C_SPACE
    table = to[kinds]
    for chars, c in (("sdmt", C_SDMT), ("l", C_L), ("vr", C_VR), ("e", C_E), (" ", C_BLANK), ("'", C_QUOTE)):
        for x in chars:
            table[ord(x)] = c
    return np.array(of_class, np.uint16), product, np.array(maps, np.uint8), cuts, table


def _states_before(elements: np.ndarray, width: int = 256) -> np.ndarray:
    """The state before each element, starting in START: an exclusive scan with the monoid's product.

    The elements are cut into blocks of ``width``; all blocks are scanned side
    by side, their products are scanned in turn, and each block is shifted by
    the product of those before it.
    """
    _, product, maps, _, _ = _automaton()
    flat, m = product.ravel(), product.shape[0]
    n = len(elements)
    if n <= width:
        out = np.empty(n, np.uint8)
        state = START
        for i, e in enumerate(elements.tolist()):
            out[i] = state
            state = maps[e, state]
        return out
    blocks = -(-n // width)
    padded = np.zeros(blocks * width, np.uint16)
    padded[:n] = elements
    columns = np.ascontiguousarray(padded.reshape(blocks, width).T)
    total = np.zeros(blocks, np.int32)
    for row in columns:  # one step for all blocks
        total = flat[total * m + row].astype(np.int32)
    # ``maps`` turns the scan's products into states at once: the state is all that the cuts need.
    state = _states_before(total.astype(np.uint16), width).astype(np.int32)
    out = np.empty((width, blocks), np.uint8)
    steps, states = maps.ravel(), maps.shape[1]
    for k, row in enumerate(columns):
        out[k] = state
        state = steps[row.astype(np.int32) * states + state].astype(np.int32)
    return np.ascontiguousarray(out.T).reshape(-1)[:n]


def piece_starts(classes: np.ndarray) -> np.ndarray:
    """For codepoint classes that end in C_END: a mask of the positions at which a piece begins."""
    of_class, _, _, cuts, _ = _automaton()
    before = _states_before(of_class[classes])
    cut = cuts.ravel()[before.astype(np.int32) * (C_END + 1) + classes]
    starts = (cut & CUT) != 0
    starts[:-1] |= (cut[1:] & CUT_BEFORE) != 0
    return starts


def split_texts(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    """The pieces of all texts in order, and how many each text has."""
    joined = "\0".join(texts) + "\0"
    cps = codepoints(joined)
    classes = _automaton()[4][cps]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1) - 1  # the separators
    classes[ends] = C_END
    starts = piece_starts(classes)
    starts[ends] = True
    at = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(utf8_widths(cps), out=at[1:])
    where = np.flatnonzero(starts)
    separator = classes[where] == C_END
    raw = joined.encode()
    begin = at[where]
    stop = np.append(begin[1:], len(raw))[~separator].tolist()
    pieces = [raw[a:b] for a, b in zip(begin[~separator].tolist(), stop)]
    seen = np.cumsum(~separator)[separator]
    return pieces, np.diff(seen, prepend=0)


# Pair merging ---------------------------------------------------------------


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file: printable bytes stand for themselves, the others follow from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Numbered(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key: bytes) -> int:
        self[key] = k = len(self)
        return k


def _ranges(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The concatenation of begin[k] .. begin[k] + sizes[k] - 1."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - sizes), sizes)


class BytePairs:
    """A byte-level BPE: the ids of pieces, cached, and the bytes of ids."""

    CACHE = 400_000  # pieces kept; each Python worker has its own
    MATRIX = 200  # longer pieces are merged one by one with a heap

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters, vocab = _byte_letters(), model["vocab"]
        self.bytes_of = [b""] * (max(vocab.values()) + 1)
        for word, k in vocab.items():
            self.bytes_of[k] = bytes(letters[x] for x in word) if all(x in letters for x in word) else word.encode()
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.first = np.zeros(256, np.int32)
        for letter, b in letters.items():
            self.first[b] = vocab[letter]
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.size = len(self.bytes_of) + 1  # with one id for padding
        self.no_rank, self.pad = len(pairs), self.size - 1
        self.ranks = {vocab[a] * self.size + vocab[b]: k for k, (a, b) in enumerate(pairs)}
        self.merged = np.array([vocab[a + b] for a, b in pairs] + [0], np.int32)
        self._build_table()
        self._forget()

    def _build_table(self) -> None:
        """An open-addressing table from pair to rank, for whole arrays of pairs."""
        keys = np.fromiter(self.ranks, np.int64, len(self.ranks))
        ranks = np.fromiter(self.ranks.values(), np.int32, len(self.ranks))
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, self.no_rank, np.int32)
        self.probes, slot = 0, self._slot(keys)
        left = np.arange(len(keys))
        while len(left):
            self.probes += 1
            free = self.keys[slot[left]] < 0
            want = left[free]
            _, one = np.unique(slot[want], return_index=True)
            put = want[one]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], ranks[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            moved = left[self.keys[slot[left]] != keys[left]]
            slot[moved] = (slot[moved] + 1) & ((1 << self.bits) - 1)
            if self.probes > 1 << self.bits:
                raise ValueError("the merges repeat a pair")

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self.size + right
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.values[slot], self.no_rank)
        mask = (1 << self.bits) - 1
        left_over = np.flatnonzero((out == self.no_rank) & (self.keys[slot] >= 0) & (self.keys[slot] != keys))
        while len(left_over):  # collisions
            slot[left_over] = (slot[left_over] + 1) & mask
            at = self.keys[slot[left_over]]
            hit = at == keys[left_over]
            out[left_over[hit]] = self.values[slot[left_over[hit]]]
            left_over = left_over[~hit & (at >= 0)]
        return out

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        ids = [int(self.first[b]) for b in piece]
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        ranks, size = self.ranks, self.size
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := ranks.get(ids[i] * size + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = int(self.merged[r]), -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (q := ranks.get(ids[x] * size + ids[y])) is not None:
                    heapq.heappush(heap, (q, x, ids[x], ids[y]))
        return tuple(x for x in ids if x >= 0)

    def _merge_block(self, pieces: list[bytes], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge pieces together, padded to one width: every round takes the best pair of each row, so all rows shrink alike.

        Returns the ids as rows and how many of each row count.
        """
        width = int(lengths.max())
        ids = np.full((len(pieces), width), self.pad, np.int32)
        ids[np.arange(width)[None, :] < lengths[:, None]] = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        out, left = ids.copy(), lengths.copy()
        if width == 1:
            return out, left
        ranks = self.rank_of(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(-1, width - 1)
        rows = np.arange(len(pieces))
        while len(rows):
            at, m = np.arange(len(rows)), ids.shape[1]
            best = ranks.argmin(1) if m > 1 else np.zeros(len(rows), np.int64)
            rank = ranks[at, best] if m > 1 else np.full(len(rows), self.no_rank)
            over = rank == self.no_rank
            if over.any():
                out[rows[over], :m] = ids[over]
                going = ~over
                rows, ids, ranks, best, rank = rows[going], ids[going], ranks[going], best[going], rank[going]
                at = at[: len(rows)]
                if not len(rows):
                    break
            left[rows] -= 1
            shift = np.arange(m - 1)[None, :]
            ids = np.take_along_axis(ids, shift + (shift > best[:, None]), 1)
            ids[at, best] = self.merged[rank]
            if m == 2:
                ranks = np.empty((len(rows), 0), np.int32)
                continue
            shift = shift[:, : m - 2]
            ranks = np.take_along_axis(ranks, shift + (shift >= best[:, None]), 1)
            low = np.flatnonzero(best > 0)
            ranks[low, best[low] - 1] = self.rank_of(ids[low, best[low] - 1], ids[low, best[low]])
            high = np.flatnonzero(best < m - 2)
            ranks[high, best[high]] = self.rank_of(ids[high, best[high]], ids[high, best[high] + 1])
        return out, left

    def _learn(self, new: list[bytes]) -> None:
        """Append the ids of new pieces to those of the cache, in order."""
        lengths = np.fromiter(map(len, new), np.int64, len(new))
        sizes = np.zeros(len(new), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        width = np.where(lengths > self.MATRIX, 0, 1 << np.ceil(np.log2(lengths)).astype(np.int64))
        for w in np.unique(width).tolist():
            rows = np.flatnonzero(width == w)
            step = max(1, (1 << 20) // w) if w else 1
            for k in range(0, len(rows), step):
                some = rows[k : k + step]
                if w:
                    ids, left = self._merge_block([new[r] for r in some.tolist()], lengths[some])
                    sizes[some] = left
                    parts.append((some, ids[np.arange(ids.shape[1])[None, :] < left[:, None]]))
                else:
                    ids = np.array(self._merge_long(new[int(some[0])]), np.int32)
                    sizes[some] = len(ids)
                    parts.append((some, ids))
        begin = np.cumsum(sizes) - sizes
        flat = np.empty(int(sizes.sum()), np.int32)
        for rows, ids in parts:
            flat[_ranges(begin[rows], sizes[rows])] = ids
        self.begin = np.append(self.begin, begin + len(self.flat))
        self.sizes = np.append(self.sizes, sizes)
        self.flat = np.append(self.flat, flat)

    def _forget(self) -> None:
        self.cache = _Numbered()
        self.begin, self.sizes, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each text has. Very long texts are taken in parts, cut where a piece begins in any case."""
        if all(len(t) <= codepoints_module.PART for t in texts):
            return self._encode(texts)
        ids, counts = [], []
        for t in texts:
            done = [self._encode([p])[0] for p in parts_of(t)]
            ids += done
            counts.append(sum(map(len, done)))
        return np.concatenate(ids), np.array(counts, np.int64)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not texts:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        pieces, counts = split_texts(texts)
        if len(self.cache) > self.CACHE:
            self._forget()
        known = len(self.cache)
        at = np.fromiter(map(self.cache.__getitem__, pieces), np.int64, len(pieces))
        if len(self.cache) > known:
            self._learn(list(islice(self.cache, known, None)))
        sizes = self.sizes[at]
        ids = self.flat[_ranges(self.begin[at], sizes)]
        ends = np.append(0, np.cumsum(sizes))
        cut = np.append(0, np.cumsum(counts))
        return ids, np.diff(ends[cut])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@functools.cache
def load(path: str) -> BytePairs:
    return BytePairs(path)


# Spark ----------------------------------------------------------------------


def encode(df: DataFrame, text: str = "text", keep: list[str] | None = None, tokenizer: str = DEFAULT, ids: str | None = "ids", count: str | None = None, offsets: str | None = None) -> DataFrame:
    """Add the token ids of ``text`` to the columns ``keep``.

    ``ids``, ``count`` and ``offsets`` name the columns for the ids, their
    number and the byte at which each token begins (None: leave it out). A null
    or empty text has no ids: an empty list, a count of 0. Rows, their order
    and repeated rows are kept; an empty table gives an empty one. A name that
    ``keep`` already has is refused.
    """
    path = tokenizer_path(tokenizer)
    keep = [c for c in df.columns if c != text] if keep is None else keep
    extra = [(n, t) for n, t in ((ids, T.ArrayType(T.IntegerType(), False)), (count, T.LongType()), (offsets, T.ArrayType(T.LongType(), False))) if n]
    if clash := {n for n, _ in extra} & {*keep}:
        raise ValueError(f"column exists already: {sorted(clash)}")
    source = df.select(*keep, F.col(text).alias("__text"))
    schema = T.StructType([source.schema[c] for c in keep] + [T.StructField(n, t, False) for n, t in extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for a, b in slices(column):
                texts = ["" if x is None else x for x in column.slice(a, b - a).to_pylist()]
                values, counts = bpe.encode(texts)
                out = [batch.column(k).slice(a, b - a) for k in range(len(keep))]
                if ids:
                    out.append(list_array(values, counts, pa.int32()))
                if count:
                    out.append(pa.array(counts, pa.int64()))
                if offsets:
                    sizes = bpe.lengths[values]
                    at = np.cumsum(sizes) - sizes
                    first = (np.cumsum(counts) - counts)[counts > 0]
                    base = np.repeat(at[first], counts[counts > 0]) if len(first) else at
                    out.append(list_array(at - base, counts, pa.int64()))
                yield pa.RecordBatch.from_arrays(out, names=[*keep, *(n for n, _ in extra)])

    return source.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", text: str = "text", tokenizer: str = DEFAULT) -> DataFrame:
    """Replace the column ``ids`` by the text it encodes; a null list gives a null text."""
    path = tokenizer_path(tokenizer)
    keep = [c for c in df.columns if c != ids]
    source = df.select(*keep, ids)
    schema = T.StructType([source.schema[c] for c in keep] + [T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            rows = batch.column(batch.num_columns - 1).to_pylist()
            texts = [None if r is None else bpe.decode(r).decode("utf-8", "replace") for r in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*keep, text])

    return source.mapInArrow(run, schema)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and ids of each document."""
    return encode(read_table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
