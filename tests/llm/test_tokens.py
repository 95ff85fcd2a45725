import random

import pytest

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

from mnemosaic.llm import tokens  # noqa: E402


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(str(public.path("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def ours(texts):
    ids, counts = tokens.load(tokens.tokenizer_path()).encode(texts)
    out, at = [], 0
    for n in counts:
        out.append(ids[at : at + n].tolist())
        at += n
    return out


def test_mixed_texts(reference):
    rng = random.Random(1)
    alphabet = "aslvredtmKé'''  \n\t\r1②ソ鐘  　!?._-́x<|endoftext|>\0"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    assert ours(texts) == reference(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_text(reference, texts):
    assert ours(texts) == reference(texts)


def test_long_pieces(reference):
    texts = ["a" * 3000, "ab" * 900, "ソロ鐘" * 300, "x" * 199, "y" * 200, "z" * 201, " " * 5000, "word " * 4000]
    assert ours(texts) == reference(texts)


def test_pretokens_by_definition():
    regex = pytest.importorskip("regex")
    pattern = regex.compile(public.PATTERN)
    rng = random.Random(2)
    texts = ["".join(rng.choice("a'sltrevmd 1 \n!'") for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    pieces, counts = tokens.split_texts(texts)
    want = [m.group().encode() for t in texts for m in pattern.finditer(t)]
    assert pieces == want and counts.sum() == len(want)


def test_texts_in_parts(reference, monkeypatch):
    monkeypatch.setattr(tokens.codepoints_module, "PART", 5)
    rng = random.Random(3)
    texts = ["".join(rng.choice("a'sl1 \n!\u3000é") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    assert ours(texts) == reference(texts)


def test_cache_may_be_dropped_at_any_time(reference, monkeypatch):
    monkeypatch.setattr(tokens.BytePairs, "CACHE", 3)
    texts = ["some words", "other words here", "some words"]
    assert ours(texts) == reference(texts) and ours(texts) == reference(texts)


def test_table(spark, reference):
    rows = [(1, "hello world"), (2, None), (3, ""), (4, "hello world"), (5, "naïve ソ" * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in tokens.encode(df, count="n", offsets="at").collect()}
    for k, t in rows:
        want = reference([t or ""])[0]
        assert list(got[k]["ids"]) == want and got[k]["n"] == len(want)
    t, bpe = (rows[4][1] * 1).encode(), tokens.load(tokens.tokenizer_path())
    for i, at in zip(got[5]["ids"], got[5]["at"]):
        assert t[at:].startswith(bpe.bytes_of[i])
    back = {r["doc_id"]: r["text"] for r in tokens.decode(tokens.encode(df)).collect()}
    assert back == {k: t or "" for k, t in rows}


def test_edges_of_the_table(spark):
    df = spark.createDataFrame([(1, "a", "x")], "doc_id long, text string, ids string")
    with pytest.raises(ValueError, match="exists already"):
        tokens.encode(df)
    assert tokens.encode(df, keep=["doc_id", "ids"], ids="tokens").columns == ["doc_id", "ids", "tokens"]
    assert tokens.encode(df.drop("ids").limit(0)).count() == 0
