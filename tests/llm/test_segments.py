import math
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import MESSAGE, message, with_clashes
from threadloom.functions.text import token_list
from threadloom.llm import segments as S

CONFIG = "config_id string, provider string, segment_tokens int, overlap_tokens int, http_segment_bytes int, document_prefix string"


def check(text, tokens, size, overlap):
    pieces = S.cut(text, tokens, size, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for a, b in pieces:
        assert len(token_list(text[a:b])) <= tokens and len(text[a:b].encode()) <= size
    for (a, b), (c, d) in zip(pieces, pieces[1:]):
        assert a < c <= b < d
        assert len(token_list(text[c:b])) <= overlap
    return pieces


alphabet = st.sampled_from(list("ab .!?\n\"é字符。，㎏ﬁ😀-㍿ｱ"))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet, min_size=1, max_size=400), st.sampled_from([(8, math.inf), (math.inf, 24), (12, 40)]), st.integers(0, 5))
def test_pieces_are_whole_and_under_the_limits(text, limits, overlap):
    check(text, *limits, overlap)


@pytest.mark.parametrize("text", ["x" * 100_000, "字" * 20_000, "a b " * 30_000, "\n" * 5_000, "." * 50_000 + "a", "㎏ " * 2_000])
def test_texts_without_boundaries(text):
    check(text, 384, 1536, 64)


def test_cut_falls_between_topics():
    rng = random.Random(2)
    topic = lambda ws, n: " ".join("The " + " ".join(rng.sample(ws, 5)) + "." for _ in range(n))
    a, b = topic("cat dog fur paw tail bone leash vet".split(), 9), topic("bond stock yield price market trade fund rate".split(), 9)
    pieces = S.cut(a + " " + b, 70, math.inf, 6)
    assert pieces[0][1] == len(a) + 1
    overlap = (a + " " + b)[pieces[1][0] : pieces[0][1]]
    assert len(token_list(overlap)) == 6


def test_valleys_rise_to_the_next_peaks():
    rng = random.Random(3)
    text = "".join(" ".join(rng.choice("abcde") for _ in range(rng.randrange(1, 4))) + ".\n" for _ in range(120))
    ends = [i + 1 for i, c in enumerate(text) if c == "\n"]
    depths = S.valleys(text, ends)
    assert len(depths) == len(ends) - 1 and min(depths.values()) >= 0 and max(depths.values()) > 0
    flat = S.valleys("one line.\n" * 500, [10 * (i + 1) for i in range(500)])
    assert max(flat.values()) < 1e-9


def test_a_log_of_equal_lines_takes_linear_time():
    took = []
    for n in (10_000, 40_000):
        began = time.process_time()
        assert len(S.cut("the same line again\n" * n, 384, math.inf, 64)) > n // 200
        took.append(time.process_time() - began)
    assert took[1] < 10 * max(took[0], 0.05)


def test_operator(spark):
    long = "One sentence here. " * 200
    rows = [message(1, long), message(2, "short"), message(3, None), message(4, long + "late", key="id1"), message(5, "字" * 400), (None,) * 12]
    configs = [("t", "local", 50, 8, None, ""), ("b", "http", None, 8, 300, "pre: "), ("none", "x", None, None, None, None), (None, "x", 5, 1, 5, "")]
    df = with_clashes(spark.createDataFrame(rows, MESSAGE))
    got = S.pieces(df, with_clashes(spark.createDataFrame(configs + configs[:1], CONFIG))).collect()
    assert {(r.config_id, r.id) for r in got} == {("t", "id1"), ("b", "id1"), ("b", "id5")}
    assert all(r.bytes <= 300 for r in got if r.config_id == "b") and all(r.tokens <= 50 for r in got if r.config_id == "t")
    for key, text in (("id1", long), ("id5", "字" * 400)):
        mine = sorted((r for r in got if (r.config_id, r.id) == ("b", key)), key=lambda r: r.piece)
        whole = "".join(text[max(r.start, e) : r.end] for r, e in zip(mine, [0, *[x.end for x in mine]]))
        assert whole == text and [r.piece for r in mine] == list(range(len(mine))) and all(r.text == text[r.start : r.end] for r in mine)
    audit = {(r.config_id, r.id): (r.covered, r.within) for r in S.coverage(df, spark.createDataFrame(configs, CONFIG)).collect()}
    assert audit == {("t", "id1"): (len(long), True), ("b", "id1"): (len(long), True), ("b", "id5"): (400, True)}
    assert S.pieces(df.limit(0), spark.createDataFrame(configs, CONFIG)).count() == 0
    assert S.pieces(df, spark.createDataFrame([], CONFIG)).count() == 0
