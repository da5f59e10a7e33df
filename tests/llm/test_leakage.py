import random

import numpy as np

from tests.llm.helpers import with_clashes
from threadloom.llm import leakage as L
from threadloom.llm.overlap import common_words

ITEM = "query_id string, original_split string, question string, gold_text string"
DOC = "doc_id bigint, text string"


def found(spark, docs, items):
    return {(r.doc_id, r.query_id) for r in L.leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)).collect()}


def test_plain_words():
    assert L.plain_words("Caf\\u00e9 <b>it's</b> **big** &amp; second-hand\\n> ok") == ["café", "its", "big", "secondhand", "ok"]
    assert L.plain_words("ｗｉｄｅ z​ero 漢字") == ["wide", "zero", "漢", "字"]
    assert L.plain_words(None) == L.plain_words("") == []


def test_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(300)}"
    items = [(f"q{i}", ("heldout", "validation", "dev")[i % 3], " ".join(word() for _ in range(rng.randrange(14, 30))), " ".join(word() for _ in range(rng.randrange(40, 80)))) for i in range(24)]
    docs = []
    for d in range(90):
        body = [word() for _ in range(rng.randrange(0, 120))]
        item = rng.choice(items)
        source = item[2 + d % 2].split()
        kind = d % 5
        if kind == 1:
            n = rng.choice((8, 11, 12, 14))
            at = rng.randrange(max(1, len(source) - n))
            body[30:30] = source[at : at + n]
        elif kind == 2:
            body[20:20] = [w if i % 11 != 5 else "changed" for i, w in enumerate(source)]
        elif kind == 3:
            body[10:10] = [w if i % 3 else "changed" for i, w in enumerate(source)]
        docs.append((d, " ".join(body)))
    docs += [(900, None), (901, ""), (None, items[0][2])]

    def leaks(doc, text):
        a, b = doc.split(), text.split()
        for i in range(len(b) - 11):
            if " " + " ".join(b[i : i + 12]) + " " in " " + doc + " ":
                return True
        for o in range(-len(b) // 8, max(1, len(a) - len(b) // 2), 2):
            w = a[max(0, o) : o + len(b) + len(b) // 4]
            if len(w) >= 0.8 * len(b):
                codes = {x: i for i, x in enumerate(dict.fromkeys(w + b))}
                if common_words(np.array([codes[k] for k in w]), np.array([codes[k] for k in b])) >= (1 - L.CHANGED) * len(b):
                    return True
        return False

    want = {(d, q) for d, t in docs if t and d is not None for q, s, x, y in items if s != "dev" and (leaks(t, x) or leaks(t, y))}
    got = found(spark, docs, items)
    assert got == want and len(want) > 12


def test_shared_texts_short_items_and_chinese(spark):
    gold = "the quick brown fox jumps over the lazy dog near a river bank today"
    zh = "每隔五百天栾绯就去云蓼找逄绯砚带上迷你的滑雪板和预算表还有很多其他的东西要做"
    items = [("q1", "heldout", "who?", gold), ("q2", "validation", "", gold), ("q3", "dev", gold, gold), ("q4", "heldout", "red green", None), ("q5", "heldout", zh, "x"), (None, "heldout", gold, gold)]
    docs = [(1, "<p>The QUICK brown\n> fox jumps over the lazy “dog” near a river bank</p>"), (2, "red green"), (3, zh[5:30]), (4, zh[5:27]), (5, "blue"), (1, "other row")]
    assert found(spark, docs, items) == {(1, "q1"), (1, "q2"), (2, "q4"), (3, "q5")}


def test_clashes_empty_and_the_way_without_filter(spark, monkeypatch):
    gold = " ".join(f"t{i}" for i in range(40))
    docs = with_clashes(spark.createDataFrame([(1, gold), (2, "nothing"), (1, gold)], DOC))
    items = with_clashes(spark.createDataFrame([("q", "heldout", gold, gold)] * 2, ITEM))
    assert [tuple(r) for r in L.leaks(docs, items).collect()] == [(1, "q")]
    monkeypatch.setattr(L, "IN_TASK", 3)
    assert [tuple(r) for r in L.leaks(docs, items).collect()] == [(1, "q")]
    assert L.leaks(docs.limit(0), items).count() == 0 and L.leaks(docs, items.limit(0)).count() == 0


def test_a_very_long_document(spark):
    gold = " ".join(f"t{i}" for i in range(40))
    text = "\\" * 100_000 + "_" * 100_000 + "filler words " * 200_000 + gold
    assert found(spark, [(1, text)], [("q", "heldout", "short one", gold)]) == {(1, "q")}
