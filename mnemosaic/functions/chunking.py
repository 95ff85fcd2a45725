"""Text chunkers with the compatible behaviour of each strategy: pure functions, and their use on tables.

Sizes are UTF-8 bytes. The overlap of ``fixed`` is bytes, that of the other
text strategies a number of words.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigError

# Fixed values of the strategies.
SECTION_BYTES = 2048
SEPARATORS = ("\n\n\n", "\n\n", "\n", ".!?", ",;: ")
CODE = " [CODE_BLOCK] "
DEFAULT_STRATEGY, DEFAULT_SIZE, DEFAULT_OVERLAP = "recursive", 512, 50
#: Unicode White_Space; str.split() would also split at U+001C to U+001F.
_SPACE = " \t\n\x0b\x0c\r\x85\xa0  -     　"
_WORD = re.compile(f"[^{_SPACE}]+")
_STRIP = " \t\n\x0b\x0c\r\x85\xa0                　"
_HEADER = re.compile(f"#{{1,6}}[{_SPACE}]+.+")
_LIST = re.compile(f"[{_SPACE}]*[-*+][{_SPACE}]+")
_FENCE = re.compile(r"```.*?```", re.DOTALL)


@dataclass(frozen=True)
class Chunk:
    index: int
    text: str
    key: str | None = None
    value: str | None = None


def _bytes(s: str) -> int:
    return len(s.encode())


def _words(s: str) -> list[str]:
    return _WORD.findall(s)


def _packed(words: list[str], size: int, overlap: int) -> list[str]:
    costs = [_bytes(w) for w in words]
    out, first = [], 0
    while first < len(words):
        end, filled = first + 1, costs[first]
        while end < len(words) and filled + costs[end] + 1 <= size:
            filled += costs[end] + 1
            end += 1
        out.append(" ".join(words[first:end]))
        if end == len(words):
            break
        back, shared = end, 0
        while back > first and shared + costs[back - 1] + (back < end) <= overlap:
            shared += costs[back - 1] + (back < end)
            back -= 1
        first = max(back, first + 1)
    return out


def _prefixed(texts: list[str], overlap: int) -> list[str]:
    """Each text after the last words of the one before, as that came out."""
    if overlap <= 0:
        return texts
    out: list[str] = []
    for t in texts:
        tail = _words(out[-1])[-overlap:] if out else []
        out.append(" ".join([*tail, t]))
    return out


def fixed(text: str, size: int, overlap: int) -> list[str]:
    """Whole words packed up to ``size`` bytes; nothing if the overlap is not smaller."""
    if size <= 0 or overlap >= size:
        return []
    return _packed(_words(text), size, overlap)


def recursive(text: str, size: int, overlap: int) -> list[str]:
    """Split at the coarsest separator that splits at all, then merge; parts that are too large stay so."""
    text = text.strip(_STRIP)
    if not text:
        return []
    if _bytes(text) <= size:
        return [text]
    for sep in SEPARATORS:
        parts = [p for p in text.split(sep) if p.strip(_STRIP)] if sep in text else []
        if len(parts) > 1:
            merged = [parts[0]]
            for part in parts[1:]:
                if _bytes(merged[-1]) + _bytes(sep) + _bytes(part) <= size:
                    merged[-1] += sep + part
                else:
                    merged.append(part)
            return _prefixed([t for m in merged if (t := m.strip(_STRIP))], overlap)
    return _prefixed(fixed(text, size, overlap), overlap)


def semantic(text: str, overlap: int) -> list[str]:
    """Paragraphs packed up to the section size."""
    out: list[str] = []
    filled = 0
    for part in text.strip(_STRIP).split("\n\n"):
        if not (part := part.strip(_STRIP)):
            continue
        cost = _bytes(part)
        if out and filled + cost + 2 <= SECTION_BYTES:
            out[-1] += "\n\n" + part
            filled += cost + 2
        else:
            out.append(part)
            filled = cost
    return _prefixed(out, overlap)


def _kind(raw: str) -> str:
    """What a line of Markdown is: header, list, fence or text."""
    line = raw.strip(_STRIP)
    if _HEADER.match(line):
        return "header"
    return "list" if _LIST.match(raw) else "fence" if line.startswith("```") else "text"


def _section(head: str, body: list[tuple[str, str]], opening: str) -> Iterator[str]:
    """The pieces of one section, each begun with ``opening`` and ended with the line that takes it beyond the section size."""
    texts = {"fence": lambda line, inside: "", "text": lambda line, inside: " " + line, "list": lambda line, inside: ("\n" if head and inside else "") + line}
    piece = opening
    if _bytes(piece) > SECTION_BYTES:
        yield piece
    for kind, line in body:
        piece += texts[kind](line, bool(piece))
        if _bytes(piece) > SECTION_BYTES:
            yield piece
            piece = opening
    if piece:
        yield piece


def markdown(text: str, overlap: int, preserve_headers: bool = True) -> list[str]:
    """Sections below headers; fenced code becomes a mark. Lines are classified first, then numbered by section, then packed."""
    lines = [(_kind(raw), raw.strip(_STRIP)) for raw in _FENCE.sub(lambda _: CODE, text.strip(_STRIP)).split("\n") if raw.strip(_STRIP)]
    heads = [i for i, (kind, _) in enumerate(lines) if kind == "header"]
    bounds = sorted({0, *heads, len(lines)})
    out: list[str] = []
    for a, b in zip(bounds, bounds[1:]):
        head = lines[a][1] if a < b and lines[a][0] == "header" else ""
        out += (p.strip(_STRIP) for p in _section(head, lines[a + bool(head) : b], head if preserve_headers else ""))
    return _prefixed(out, overlap)


def _leaves(value, path: str) -> Iterator[tuple[str, str]]:
    if isinstance(value, dict):
        for k in sorted(value):
            yield from _leaves(value[k], f"{path}.{k}" if path else k)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from _leaves(v, f"{path}[{i}]")
    else:
        yield path, value if isinstance(value, str) else json.dumps(value)


def flatten_json(text: str) -> list[Chunk]:
    """A chunk for each leaf, with its path; what isn't JSON or has no leaf is one chunk."""
    text = text.strip(_STRIP)
    if not text:
        return []
    try:
        leaves = list(_leaves(json.loads(text), ""))
    except (ValueError, RecursionError):
        leaves = []
    return [Chunk(i, v, k, v) for i, (k, v) in enumerate(leaves)] or [Chunk(0, text)]


def legacy(text: str, size: int, overlap: int) -> list[str]:
    """Blank: nothing; up to ``size`` characters: the text as it is; else as ``fixed``."""
    if not text or not text.strip():
        return []
    return [text] if len(text) <= size else fixed(text, size, overlap)


_STRATEGIES = {
    "fixed": fixed,
    "recursive": recursive,
    "semantic": lambda text, size, overlap: semantic(text, overlap),
    "markdown": lambda text, size, overlap: markdown(text, overlap),
    "legacy": legacy,
}


def chunk(text: str | None, strategy: str = DEFAULT_STRATEGY, size: int = DEFAULT_SIZE, overlap: int = DEFAULT_OVERLAP) -> list[Chunk]:
    """Chunks by a strategy, whose name has no case; a null text has none."""
    name = strategy.lower()
    if name == "json":
        return flatten_json(text or "")
    if name not in _STRATEGIES:
        raise ConfigError(f"unknown strategy {strategy!r}")
    return [Chunk(i, t) for i, t in enumerate(_STRATEGIES[name](text or "", size, overlap))]


def chunk_table(df: DataFrame, keep: list[str], text: str = "text", strategy: str = DEFAULT_STRATEGY, size: int = DEFAULT_SIZE, overlap: int = DEFAULT_OVERLAP) -> DataFrame:
    """A row for each chunk of each row: ``keep``, index, text, and for JSON key and value."""
    name = strategy.lower()
    if name != "json" and name not in _STRATEGIES:
        raise ConfigError(f"unknown strategy {strategy!r}")
    if clash := {*keep} & {"index", "text", "key", "value"}:
        raise ConfigError(f"column exists already: {sorted(clash)}")
    more = ["key", "value"] if name == "json" else []
    source = df.select(*keep, F.col(text).alias("__text"))
    schema = T.StructType([source.schema[c] for c in keep] + [T.StructField("index", T.IntegerType(), False), T.StructField("text", T.StringType(), False), *(T.StructField(c, T.StringType()) for c in more)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):  # chunks of some hundred texts at once stay small
                part = batch.slice(a, 500)
                rows, chunks = [], []
                for i, t in enumerate(part.column(part.num_columns - 1).to_pylist()):
                    found = chunk(t, name, size, overlap)
                    chunks += found
                    rows += [i] * len(found)
                take = pa.array(rows, pa.int64())
                columns = [part.column(k).take(take) for k in range(len(keep))]
                columns += [pa.array([c.index for c in chunks], pa.int32()), *(pa.array([getattr(c, n) for c in chunks], pa.string()) for n in ("text", *more))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(run, schema)
