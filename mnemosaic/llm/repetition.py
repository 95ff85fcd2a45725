"""Problem 9: repeated content inside documents, and lines repeated across documents.

Two measures, as one cannot stand in for the other:

* ``repeated_words``: the share of a document's words that lie in a run of
  ``window`` words met before in the same document. This is what ``p9_found``
  asks for. Counting lines across documents cannot give it: a document may
  repeat a phrase within one line, or lines that no other document has.
* ``line_frequency``: the method named for the problem. Lines are normalised
  and hashed, the documents of each host that hold a line are counted, lines
  above the limit are removed, and documents that lose too much are rejected.

``p9_cleaned`` takes them together: the lines go first, then what is left is
measured.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import materialize, read_table, skew_safe_join
from . import codepoints as codepoints_module
from .codepoints import LETTER, NUMBER, class_table, codepoints, slices

_BASE, _GRAM = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _inverse(odd: int) -> np.uint64:
    return np.uint64(pow(odd, -1, 1 << 64))


_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, name: str, n: int) -> np.ndarray:
    if len(have := _powers.get(name, ())) < n:
        row = np.full(n, base, np.uint64)
        row[0] = 1
        have = _powers[name] = np.multiply.accumulate(row)
    return have[:n]


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and the text of each word.

    A word is a longest run of letters and digits (categories L and N) of the
    lower-cased text. The hash of a slice is a difference of prefix sums of
    codepoints times powers of an odd number, so no slice is looked at alone.
    """
    texts = [t.lower() for t in texts]
    if any(len(t) > codepoints_module.PART for t in texts):  # very long texts: in parts that cut no word
        done = [(k, _words_of([p])) for k, t in enumerate(texts) for p in codepoints_module.parts_of(t)]
        return np.concatenate([h for _, (h, _) in done]), np.concatenate([np.full(len(h), k) for k, (h, _) in done])
    return _words_of(texts)


def _words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    cps = codepoints("\0".join(texts) + "\0")
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1) - 1
    kind = class_table()[cps]
    inside = np.zeros(len(cps) + 1, np.int8)
    inside[1:] = (kind == LETTER) | (kind == NUMBER)
    inside[ends + 1] = 0
    edge = np.diff(inside)  # one codepoint late, which the separators allow
    begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    n = len(cps)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(cps.astype(np.uint64) + np.uint64(1)) * _power(_BASE, "up", n), out=sums[1:])
    hashes = mix((sums[stop] - sums[begin]) * _power(_inverse(int(_BASE)), "down", n)[begin] + (stop - begin).astype(np.uint64))
    return hashes, np.searchsorted(ends, begin)


def count_repeated(texts: list[str], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Words and repeated words of each text."""
    hashes, of = words_of(texts)
    words = np.bincount(of, minlength=len(texts))
    n = len(hashes) - window + 1
    if n <= 0:
        return words, np.zeros(len(texts), np.int64)
    gram = np.zeros(n, np.uint64)
    for k in range(window):
        gram = gram * _GRAM + hashes[k : k + n]
    start = np.flatnonzero(of[:n] == of[window - 1 :])
    key = mix(gram[start] + mix(of[start].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    # Of each group of equal runs the first in the text is no repetition.
    head = np.flatnonzero(np.append(True, ~same)) if len(order) else np.empty(0, np.int64)
    again = np.ones(len(order), bool)
    if len(order):
        again[np.minimum.reduceat(order, head)] = False
    cover = np.zeros(len(hashes) + 1, np.int32)
    cover[start[again]] += 1
    np.add.at(cover, start[again] + window, -1)
    repeated = np.cumsum(cover[:-1]) > 0
    return words, np.bincount(of[repeated], minlength=len(texts))


def repeated_words(df: DataFrame, text: str = "text", keep: list[str] | None = None, window: int = 8) -> DataFrame:
    """Add ``n_words``, ``n_repeated`` and ``repeated_share`` to the columns ``keep``.

    A null, empty or wordless text has no words and a share of 0. Rows, also
    repeated ones, are kept; an empty table gives an empty one. A name that
    ``keep`` already has is refused.
    """
    keep = [c for c in df.columns if c != text] if keep is None else keep
    added = ["n_words", "n_repeated", "repeated_share"]
    if clash := {*added} & {*keep}:
        raise ValueError(f"column exists already: {sorted(clash)}")
    source = df.select(*keep, F.col(text).alias("__text"))
    schema = T.StructType([source.schema[c] for c in keep] + [T.StructField("n_words", T.LongType(), False), T.StructField("n_repeated", T.LongType(), False), T.StructField("repeated_share", T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for a, b in slices(column):
                texts = ["" if x is None else x for x in column.slice(a, b - a).to_pylist()]
                words, repeated = count_repeated(texts, window)
                out = [batch.column(k).slice(a, b - a) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*out, pa.array(words, pa.int64()), pa.array(repeated, pa.int64()), pa.array(repeated / np.maximum(words, 1), pa.float64())], names=[*keep, *added])

    return source.mapInArrow(run, schema)


def _held_lines(raw: DataFrame, max_docs: int) -> DataFrame:
    """(doc, key, chars, places, common) of the distinct lines of each document; a line is ``common`` if more than ``max_docs`` documents of its host hold it.

    Lines of a document are pre-aggregated before any shuffle; a line that most
    documents share is counted by partial sums, and joined back without being
    gathered in one task.
    """
    lines = raw.select("doc", "h", F.posexplode(F.split("t", "\r?\n")).alias("place", "line"))
    lines = lines.withColumn("line", F.lower(F.trim(F.regexp_replace(F.regexp_replace("line", r"[\s\u00a0\u3000]+", " "), r"\d", "0")))).where(F.length("line") > 0)
    held = lines.groupBy("doc", F.xxhash64("h", "line").alias("key")).agg(F.sum(F.length("line")).alias("chars"), F.collect_list("place").alias("places"))
    held = materialize(held, "lines")
    common = held.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_docs).select("key", F.lit(True).alias("common"))
    return skew_safe_join(held, common, "key")


def line_frequency(df: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "host", max_docs: int = 5, min_kept: float = 0.5, cleaned: bool = False) -> DataFrame:
    """Per document: characters in lines, those in lines held by more than ``max_docs`` documents of the same host, and whether the rest is too little.

    With ``cleaned`` also ``text``: what is left without the common lines and
    without blank ones, in order; NULL for rejected documents.

    A line is normalised by lower case, single blanks and zeros for digits;
    blank lines don't count. Documents without lines (null, empty or blank
    text) have 0 characters, aren't rejected and have an empty text; a null host
    is one host of its own. Repeated rows of a document count as one document,
    their characters add up, and its text is that of one of them.
    """
    raw = df.select(F.col(doc_id).alias("doc"), F.xxhash64(F.coalesce(F.col(host), F.lit("\0"))).alias("h"), F.col(text).alias("t"))
    marked = _held_lines(raw, max_docs)
    sums = [F.sum("chars").alias("n_chars"), F.sum(F.when(F.col("common"), F.col("chars")).otherwise(0)).alias("removed_chars")]
    if cleaned:
        sums.append(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("common").isNull(), F.col("places")))))).alias("kept"))
    per_doc = marked.groupBy("doc").agg(*sums)
    docs = raw.groupBy("doc").agg(F.first("t").alias("t")) if cleaned else raw.select("doc").distinct()
    out = docs.join(per_doc, "doc", "left")
    n, gone = F.coalesce("n_chars", F.lit(0)), F.coalesce("removed_chars", F.lit(0))
    rejected = F.coalesce(n - gone, F.lit(0)) < n * min_kept
    columns = [F.col("doc").alias(doc_id), n.alias("line_chars"), gone.alias("removed_chars"), rejected.alias("rejected")]
    if cleaned:
        # The lines are cut out by their places, so the text itself is shuffled once, and no line is looked for.
        split = F.split("t", "\r?\n")
        left = F.get(F.transform(F.array(split), lambda rows: F.array_join(F.transform(F.coalesce("kept", F.array().cast("array<int>")), lambda i: F.get(rows, i)), "\n")), F.lit(0))
        columns.append(F.when(~rejected, F.coalesce(left, F.lit(""))).alias("text"))
    return out.select(*columns)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", "text")


def _with_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", "text", F.lower(F.substring_index("mailbox", "@", -1)).alias("host"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with at least 40 words of which at least 0.3 are repeated."""
    share = repeated_words(_documents(spark, sf_dir), keep=["doc_id"])
    return share.where((F.col("n_words") >= 40) & (F.col("n_repeated") * 10 >= F.col("n_words") * 3)).select("doc_id")


def p9_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, repeated words and their share in each document."""
    return repeated_words(_documents(spark, sf_dir), keep=["doc_id"])


def p9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines common among the documents of a host (the domain of the mailbox), and the documents that consist of them."""
    return line_frequency(_with_host(spark, sf_dir))


def p9_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both measures on top of each other: the documents without the lines that are common on their host, and how much of what is left they repeat themselves."""
    cleaned = line_frequency(_with_host(spark, sf_dir), cleaned=True)
    return repeated_words(cleaned, keep=["doc_id", "line_chars", "removed_chars", "rejected"])


_MEASURE = """
w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM texts),
g AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id, gram ORDER BY pos) > 1 AS again
      FROM (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS pos, unnest(list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i + 7], ' '))) AS gram FROM w WHERE len(ws) >= 8)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(pos, pos + 8)) AS p FROM g WHERE again) GROUP BY doc_id),
s AS (SELECT w.doc_id, coalesce(len(ws), 0) AS n_words, coalesce(r.n, 0) AS n_repeated FROM w LEFT JOIN r USING (doc_id))
"""
_WORDS = f"WITH texts AS (SELECT doc_id, text FROM documents), {_MEASURE}"
_LINES = r"""
l AS (SELECT doc_id, coalesce(lower(split_part(mailbox, '@', -1)), chr(1)) AS host, unnest(string_split_regex(text, '\r?\n')) AS raw, generate_subscripts(string_split_regex(text, '\r?\n'), 1) AS place FROM documents),
m AS (SELECT *, lower(trim(regexp_replace(regexp_replace(raw, '[\s\x0b\x{a0}\x{3000}]+', ' ', 'g'), '\d', '0', 'g'))) AS line FROM l),
c AS (SELECT host, line FROM m WHERE length(line) > 0 GROUP BY ALL HAVING count(DISTINCT doc_id) > 5),
d AS (SELECT doc_id, sum(length(m.line)) AS line_chars, sum(CASE WHEN c.line IS NULL THEN 0 ELSE length(m.line) END) AS removed, string_agg(raw, chr(10) ORDER BY place) FILTER (c.line IS NULL) AS kept FROM m LEFT JOIN c ON c.host = m.host AND c.line = m.line WHERE length(m.line) > 0 GROUP BY doc_id),
e AS (SELECT doc_id, coalesce(line_chars, 0)::BIGINT AS line_chars, coalesce(removed, 0)::BIGINT AS removed_chars, coalesce(line_chars - removed < line_chars * 0.5, false) AS rejected, coalesce(kept, '') AS kept FROM documents LEFT JOIN d USING (doc_id))"""

SQL = {
    "p9_found": _WORDS + "SELECT doc_id FROM s WHERE n_words >= 40 AND n_repeated * 10 >= n_words * 3",
    "p9_repetition": _WORDS + "SELECT doc_id, n_words::BIGINT AS n_words, n_repeated::BIGINT AS n_repeated, n_repeated / greatest(n_words, 1)::DOUBLE AS repeated_share FROM s",
    "p9_lines": f"WITH {_LINES} SELECT doc_id, line_chars, removed_chars, rejected FROM e",
    "p9_cleaned": f"""WITH {_LINES}, texts AS (SELECT doc_id, CASE WHEN NOT rejected THEN kept END AS text FROM e), {_MEASURE}
SELECT doc_id, line_chars, removed_chars, rejected, n_words::BIGINT AS n_words, n_repeated::BIGINT AS n_repeated, n_repeated / greatest(n_words, 1)::DOUBLE AS repeated_share FROM e JOIN s USING (doc_id)""",
}
