import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import with_clashes
from threadloom.llm import bpe

if not os.path.exists(bpe.VOCABULARY):
    pytest.skip("no vocabulary here", allow_module_level=True)

RANKS = bpe.load_ranks(bpe.VOCABULARY)


def reference():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("test", pat_str=bpe.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), min_size=1, max_size=40), max_size=5))
def test_replay_of_words(words):
    enc = reference()
    assert bpe.Replay(RANKS).encode(words) == [enc._encode_single_piece(w.encode()) for w in words]


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="ascii"), max_size=80))
def test_ascii_texts_are_split_like_others(text):
    assert bpe.split(text) == bpe._SPLIT.findall(text) and "".join(bpe.split(text)) == text


def test_documents(spark):
    enc = reference()
    texts = ["Hello world, it's 2024!", "", None, "  two  spaces\n\n", "你好，世界", "<|endoftext|> is text", "aaaa" * 5000, "a‍👩‍👦 ok", "Hello world, it's 2024!", " "]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (2**60 + 1, "large id"), (0, "again")]
    got = bpe.encode_documents(with_clashes(spark.createDataFrame(rows, "doc_id bigint, text string")), block_bytes=100).collect()
    want = sorted((str(i), enc.encode_ordinary(t or "")) for i, t in rows)
    assert sorted((str(r.doc_id), list(r.ids)) for r in got) == want
    assert bpe.encode_documents(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_ids_decode_to_the_text(spark):
    token = {v: k for k, v in RANKS.items()}
    text = "Round trip: ünï 漢字 \t tabs — and \U0001f600 more " * 20
    ids = bpe.encode_documents(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first().ids
    assert b"".join(token[i] for i in ids).decode() == text
