"""Merge replay against two public implementations of the same vocabulary."""

import base64
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm import tokenizer

pytestmark = pytest.mark.skipif(not os.path.isdir(tokenizer.TOKENIZERS), reason="no vocabulary files")


@pytest.fixture(scope="module")
def replay():
    return tokenizer.MergeReplay()


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(f"{tokenizer.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=tokenizer.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


TEXTS = [
    "",
    " ",
    "a",
    "aaaaaaaaaaaaaaaaa aaa aaaa",
    "Hello  world\r\n\t it's we'll <|endoftext|> 12345 67",
    "Ζητώ λόγο… ขอ 🇪🇺👏🏽 ﬁ ẞ ½ ‮​\x00\x85",
    "x" * 5000 + "é" * 3000,
    "\n\n\n   \n  end   ",
]


@pytest.mark.parametrize("text", TEXTS)
def test_known_texts(replay, reference, text):
    assert replay.encode([text]) == [reference(text)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_texts(replay, reference, texts):
    assert replay.encode(texts) == [reference(t) for t in texts]


def test_second_implementation(replay):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(f"{tokenizer.TOKENIZERS}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    assert replay.encode(TEXTS) == [e.ids for e in other.encode_batch(TEXTS, add_special_tokens=False)]


def test_frames(spark, reference, monkeypatch):
    monkeypatch.setattr(tokenizer, "SLICE_CHARS", 10)
    rows = [(1, None, 0), (2, "", 0), (3, TEXTS[4], 0), (3, TEXTS[4], 0), (None, "b c", 0), (5, TEXTS[5] * 300, 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    found = sorted(((r.doc_id or 0), r.ids) for r in tokenizer.encode(frame).collect())
    assert found == sorted(((d or 0), reference(t or "")) for d, t, _ in rows)
    marked = {r.doc_id: r.ids for r in tokenizer.encode(frame, null_ids=(7,), empty_ids=(8, 9)).collect()}
    assert (marked[1], marked[2]) == ([7], [8, 9])
    sizes = sorted(r.n_tokens for r in tokenizer.token_counts(frame, ["doc_id"]).collect())
    assert sizes == sorted(len(reference(t or "")) for _, t, _ in rows)
    assert tokenizer.encode(frame.limit(0)).count() == 0


def test_words_are_forgotten_in_time(reference, monkeypatch):
    monkeypatch.setattr(tokenizer, "KNOWN_WORDS", 3)
    own = tokenizer.MergeReplay()
    for k in range(6):
        text = f"many different words number {k} here"
        assert own.encode([text, text]) == [reference(text)] * 2
