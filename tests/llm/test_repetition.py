import random

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from mnemosaic.llm import repetition as r


def plainly(text, window):
    words = regex.findall(r"[\p{L}\p{N}]+", text.lower())
    seen, marked = set(), set()
    for i in range(len(words) - window + 1):
        gram = tuple(words[i : i + window])
        if gram in seen:
            marked |= set(range(i, i + window))
        seen.add(gram)
    return len(words), len(marked)


def measured(texts, window):
    words, repeated = r.count_repeated(texts, window)
    return list(zip(words.tolist(), repeated.tolist()))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aB1 .-ソ\0İ", max_size=80), min_size=1, max_size=5), st.integers(1, 4))
def test_equals_the_definition(texts, window):
    assert measured(texts, window) == [plainly(t, window) for t in texts]


def test_longer_texts():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(3)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 400))) for _ in range(60)]
    texts += ["buy now " * 50_000, "", "one"]
    assert measured(texts, 8) == [plainly(t, 8) for t in texts]


def test_texts_in_parts(monkeypatch):
    monkeypatch.setattr(r.codepoints_module, "PART", 7)
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab1 \n.-İΣ") for _ in range(rng.randint(0, 90))) for _ in range(300)]
    assert measured(texts, 3) == [plainly(t, 3) for t in texts]


def test_table(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h " * 4, 0), (2, None, 0), (3, "", 0), (1, "a b c d e f g h " * 4, 0)], "doc_id long, text string, n_words long")
    got = [(x["doc_id"], x["w"], x["n_repeated"], x["repeated_share"]) for x in r.repeated_words(df, keep=["doc_id"]).withColumnRenamed("n_words", "w").collect()]
    assert sorted(got) == [(1, 32, 24, 0.75), (1, 32, 24, 0.75), (2, 0, 0, 0.0), (3, 0, 0, 0.0)]
    with pytest.raises(ValueError, match="exists already"):
        r.repeated_words(df)
    assert r.repeated_words(df.limit(0), keep=["doc_id"]).count() == 0


def test_lines(spark):
    rows = [(k, f"own line {'abcdefghij'[k]}\nDisclaimer 12\n\n", "h") for k in range(7)]
    rows += [(10, "disclaimer 34", "h"), (11, "Disclaimer 1", None), (12, None, "h"), (13, " \n", "h"), (0, "own line a\n", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, host string").withColumnRenamed("host", "host")
    got = {x["doc_id"]: (x["line_chars"], x["removed_chars"], x["rejected"]) for x in r.line_frequency(df, max_docs=5).collect()}
    assert got[1] == (23, 13, True) and got[10] == (13, 13, True) and got[11] == (12, 0, False)
    assert got[12] == got[13] == (0, 0, False) and got[0] == (33, 13, False)
    assert r.line_frequency(df.limit(0)).count() == 0
