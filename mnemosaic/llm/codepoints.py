"""Codepoint arrays of whole batches of texts, and classes of codepoints."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SIZE = 0x110000
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3

#: Unicode White_Space, as \s matches it (fixed values).
WHITE_SPACE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@functools.cache
def class_table() -> np.ndarray:
    """uint8 by codepoint: OTHER, LETTER (categories L*), NUMBER (N*) or SPACE.

    The tables of ``regex`` are taken where it is installed, as they are newer
    than those of ``unicodedata``.
    """
    table = np.zeros(SIZE, np.uint8)
    try:
        import regex

        every = "".join(map(chr, [*range(0xD800), *range(0xE000, SIZE)]))
        for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
            for m in regex.finditer(pattern, every):
                a, b = m.span()
                at = np.arange(a, b)
                table[np.where(at >= 0xD800, at + 0x800, at)] = kind
    except ImportError:
        for cp in range(SIZE):
            major = unicodedata.category(chr(cp))[0]
            table[cp] = LETTER if major == "L" else NUMBER if major == "N" else OTHER
    table[list(WHITE_SPACE)] = SPACE
    return table


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def utf8_widths(cps: np.ndarray) -> np.ndarray:
    return (1 + (cps >= 0x80).astype(np.uint8) + (cps >= 0x800) + (cps >= 0x10000)).astype(np.int64)


def slices(column: pa.Array, limit: int = 1 << 21):
    """Yield (first row, last row + 1) so that each slice holds about ``limit`` bytes of text, and one row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)
    ends, begin = np.cumsum(sizes), 0
    while begin < len(sizes):
        base = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield begin, end
        begin = end


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The list array whose rows take ``counts`` successive values each."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


#: Codepoints of one text that are worked on at once; longer texts are taken in parts.
PART = 1 << 20


def parts_of(text: str, part: int | None = None) -> list[str]:
    """A text in parts that begin with white space, so that no word or piece spans two of them; what has no white space stays whole."""
    part = part or PART
    if len(text) <= part:
        return [text]
    out, begin = [], 0
    while len(text) - begin > part:
        end = _break(text, begin, part)
        if end == begin:
            break
        out.append(text[begin:end])
        begin = end
    return [*out, text[begin:]]


def _break(text: str, begin: int, part: int) -> int:
    """The first place, about ``part`` codepoints on, at which white space follows something else; ``begin`` if there is none."""
    at = begin + part
    while at < len(text):
        if text[at] in " \n\t\r" and text[at - 1] not in _ANY_SPACE:
            return at
        at += 1
    return begin


_ANY_SPACE = frozenset(map(chr, WHITE_SPACE))
