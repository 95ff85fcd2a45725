import pytest
from hypothesis import given
from hypothesis import strategies as st

from mnemosaic.errors import ConfigError
from mnemosaic.functions import chunking as c


def test_fixed_cuts_no_word():
    text = "Hello world foo bar"
    assert {w for t in c.fixed(text, 8, 0) for w in t.split()} == set(text.split())
    assert c.fixed(text, 5, 5) == [] and c.fixed("  ", 5, 0) == [] and c.fixed(text, 0, 0) == []
    assert "superlongword" in " ".join(c.fixed("x superlongword y", 5, 0))


def test_fixed_overlap_is_bytes():
    assert c.fixed("aa bb cc dd", 5, 2) == ["aa bb", "bb cc", "cc dd"]
    assert c.fixed("éé bb", 4, 0) == ["éé", "bb"]


@given(st.text(max_size=200), st.integers(1, 40), st.integers(0, 39))
def test_fixed_keeps_all_words_in_order(text, size, overlap):
    words, out = c._words(text), c.fixed(text, size, overlap)
    if overlap >= size:
        assert out == []
    else:
        assert [w for t in c.fixed(text, size, 0) for w in t.split(" ")] == words
        assert {w for t in out for w in t.split(" ")} == set(words)


def test_recursive():
    text = "\n\n".join(["one two three four five six"] * 3)
    assert len(c.recursive(text, 30, 0)) == 3
    assert c.recursive("short", 30, 5) == ["short"]
    assert c.recursive("a" * 50, 20, 30) == []  # falls back to fixed, whose overlap is not smaller
    assert c.recursive("a b.!?c d", 5, 0) == ["a b", "c d"]


def test_semantic_and_overlap():
    text = "A" * 1200 + "\n\n" + "B" * 1200
    assert len(c.semantic(text, 0)) == 2
    assert c._prefixed(["alpha beta gamma", "delta"], 1) == ["alpha beta gamma", "gamma delta"]
    assert c._prefixed(["a", "b", "c"], 2) == ["a", "a b", "a b c"]


def test_markdown():
    out = c.markdown("# One\ntext\n- item\n```py\nx\n```\n## Two\nmore", 0)
    assert out == ["# One text\n- item [CODE_BLOCK]", "## Two more"]
    assert c.markdown("plain\nlines", 0) == ["plain lines"]


def test_json():
    found = c.flatten_json('{"user":{"name":"John","age":30},"items":["alpha",null,true]}')
    assert [(x.key, x.text) for x in found] == [("items[0]", "alpha"), ("items[1]", "null"), ("items[2]", "true"), ("user.age", "30"), ("user.name", "John")]
    assert c.flatten_json("no json")[0].text == "no json" and c.flatten_json("{}")[0].text == "{}" and c.flatten_json(" ") == []


def test_legacy_and_dispatch():
    assert c.legacy(" ab ", 10, 0) == [" ab "] and c.legacy("  ", 10, 0) == []
    assert [x.index for x in c.chunk("a b c d", "FIXED", 3, 0)] == [0, 1]
    assert c.chunk(None) == []
    with pytest.raises(ConfigError):
        c.chunk("x", "none")


def test_table(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, None), (3, "")], "doc long, text string")
    assert [tuple(r) for r in c.chunk_table(df, ["doc"], strategy="fixed", size=3, overlap=0).collect()] == [(1, 0, "a b"), (1, 1, "c d")]
    with pytest.raises(ConfigError):
        c.chunk_table(df.withColumn("index", df.doc), ["index"])
    assert c.chunk_table(df.limit(0), ["doc"]).count() == 0
