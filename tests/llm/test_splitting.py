import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mnemosaic.llm import splitting as s


def walk(text, limit, overlap):
    """The pieces by a plain walk along the text."""
    limit = max(limit, s.LEAST)
    overlap = min(max(overlap, 0), limit - s.LEAST)
    raw, n = text.encode(), len(text)
    at = [len(text[:i].encode()) for i in range(n + 1)]
    levels = s.boundary_levels(s.codepoints(text + "\0"))
    levels[0] = levels[n] = s.PARAGRAPH
    pieces, end = [], 0
    while end < n:
        start = end
        if overlap and end:
            latest = max(i for i in range(n + 1) if at[i] <= max(0, at[end] - overlap))
            start = min(i for i in range(n + 1) if at[i] >= at[end] - min(limit - s.LEAST, at[end] - at[latest]))
            for kind, room in ((0, limit - s.LEAST), (s.WORD, min(limit - s.LEAST, overlap + int(s.EARLIER * (limit - overlap))))):
                back = max(i for i in range(latest + 1) if levels[i] >= kind or i == 0)
                if at[end] - at[back] <= room:
                    start = back
        last = max(i for i in range(n + 1) if at[i] <= at[start] + limit)
        new = last
        if last < n:
            wanted = [(k, s.FILL * limit) for k in range(s.PARAGRAPH, -1, -1)] + [(s.WORD, 0), (s.ANY, 0)]
            for kind, least in wanted:
                # the last boundary of this kind counts, be it far enough or not
                back = max((i for i in range(last + 1) if levels[i] >= kind), default=0)
                if back > end and at[back] >= at[start] + least:
                    new = back
                    break
        pieces.append((at[start], at[new]))
        end = new
    return [(a, b, raw[a:b].decode()) for a, b in pieces]


def cut(texts, limit, overlap):
    row, first, end, number = s.cut_texts(texts, np.full(len(texts), limit), np.full(len(texts), overlap))
    out = [[] for _ in texts]
    for r, a, b, k in zip(row.tolist(), first.tolist(), end.tolist(), number.tolist()):
        assert k == len(out[r])
        out[r].append((a, b, texts[r].encode()[a:b].decode()))
    return out


texts = st.lists(st.text(alphabet="ab éソ́.,!\n\r 。\u200d\U0001f1e6", max_size=80), min_size=1, max_size=4)


@settings(max_examples=300, deadline=None)
@given(texts, st.integers(1, 30), st.integers(0, 30))
def test_equals_a_plain_walk(some, limit, overlap):
    assert cut(some, limit, overlap) == [walk(t, limit, overlap) for t in some]


@settings(max_examples=200, deadline=None)
@given(texts, st.integers(4, 30), st.integers(0, 12))
def test_pieces_are_small_overlap_and_give_back_the_text(some, limit, overlap):
    for text, pieces in zip(some, cut(some, limit, overlap)):
        back, end = b"", 0
        for a, b, piece in pieces:
            assert 0 < b - a <= limit and a <= max(0, end - min(overlap, limit - s.LEAST) + (3 if overlap + 3 > limit - s.LEAST else 0)) and a <= end < b
            back += text.encode()[end:b]
            end = b
        assert back == text.encode()


def test_natural_boundaries():
    [pieces] = cut(["One two. Three four five.\n\nSix seven eight nine ten."], 30, 0)
    assert [p for _, _, p in pieces] == ["One two. Three four five.\n\n", "Six seven eight nine ten."]
    [pieces] = cut(["aaaa bbbb. cccc dddd"], 15, 0)
    assert [p for _, _, p in pieces] == ["aaaa bbbb. ", "cccc dddd"]


def test_long_text_without_boundaries():
    [pieces] = cut(["x" * 100_000], 100, 10)
    assert len(pieces) == 1112 - 1 and all(b - a <= 100 for a, b, _ in pieces)


def test_pieces_begin_with_words_and_between_clusters():
    text = "generalisation internationalism " * 20
    [pieces] = cut([text], 200, 30)
    assert all(p[0] in "gi" and text.encode()[a - 1 : a] in (b" ", b"") for a, _, p in pieces)
    family, flag = "\U0001f468\u200d\U0001f469\u200d\U0001f467", "\U0001f1eb\U0001f1f7"
    for cluster in (family, flag):
        [pieces] = cut([cluster * 40], 100, 20)
        assert len(pieces) > 3 and all(p.startswith(cluster) and p.endswith(cluster) for _, _, p in pieces)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab éソ́.,!\n\r 。\u200d", min_size=60, max_size=400), st.integers(4, 20), st.integers(0, 12))
def test_windows_of_a_long_text_give_the_same(text, limit, overlap):
    first, end = s.cut_long(text, limit, overlap, 90)
    assert list(zip(first.tolist(), end.tolist())) == [(a, b) for a, b, _ in cut([text], limit, overlap)[0]]


LIMITS = "strategy string, max_bytes int, overlap_bytes int"


def test_table(spark):
    long = "word " * 40
    rows = [(1, 0, long, "a", "x"), (1, 0, long, "a", "x"), (1, 1, "short", "a", "x"), (2, 0, None, "a", "x"), (3, 0, long, None, "x"), (4, 0, long, "none", "x"), (5, 0, "", "a", "x"), (None, None, long, "a", None), (6, 0, long, "open", "x")]
    df = spark.createDataFrame(rows, "item_id long, chunk_index int, text string, strategy string, max_bytes string")
    limits = spark.createDataFrame([("a", 50, 10), ("a", 90, 0), ("open", None, 1), (None, 3, 3)], LIMITS)
    got = s.split_oversized(df, limits, ["item_id", "chunk_index"]).collect()
    assert {(r["item_id"], r["chunk_index"]) for r in got} == {(1, 0), (None, None)}
    one = sorted((r["piece_index"], r["piece"]) for r in got if r["item_id"] == 1)
    assert [p for _, p in one] == [p for _, _, p in walk(long, 50, 10)]
    assert s.split_oversized(df.limit(0), limits, ["item_id"]).count() == 0
    assert s.split_oversized(df, limits.limit(0), ["item_id"]).count() == 0
    with pytest.raises(ValueError, match="exists already"):
        s.split_oversized(df.withColumnRenamed("max_bytes", "piece"), limits, ["piece"])
