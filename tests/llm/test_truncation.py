import json
import random

from tests.llm.helpers import with_clashes
from threadloom.llm import truncation as T

DOC = "doc_id bigint, text string, source string"


def sentence(rng):
    return " ".join(rng.choice(["Anna", "The", "My"]) if i == 0 else f"{rng.choice(['word', 'thing', 'place', 'river'])}{'s' * (i % 2)}" for i in range(rng.randrange(5, 12))) + "."


def corpus():
    rng = random.Random(8)
    docs, cut = [], set()

    def add(source, text, is_cut=False):
        docs.append((len(docs), text, source))
        if is_cut:
            cut.add(len(docs) - 1)

    for i in range(300):
        body = " ".join(sentence(rng) for _ in range(rng.randrange(5, 40)))
        add("limited", body[:600], len(body) > 600 and not body[:600].rstrip().endswith("."))
        add("dotted", body if len(body) <= 500 else body[:497] + "...", len(body) > 500)
        add("footed", (body if i % 10 else body[: len(body) // 2 * 2 - 9]) + "\n\n-- end of export --", not i % 10)
        add("signed", body + f"\n\nThanks,\n{rng.choice(['Anna', 'Bo'])} {rng.choice(['Lind', 'Berg'])}")
        add("tagged", body + f"\n- tags: {rng.choice(['river', 'boat', 'lake'])}, {rng.choice(['tree', 'hill'])}")
        raw = json.dumps({"a": [body, 1], "b": "x}"})
        add("json", raw if i % 9 else raw[: len(raw) // 2], not i % 9)
    return docs, cut


def test_planted_cuts(spark):
    docs, cut = corpus()
    got = {r.doc_id for r in T.cut_texts(spark.createDataFrame(docs, DOC)).collect()}
    assert len(got & cut) >= 0.96 * len(cut) and len(got - cut) <= 0.02 * len(cut), (len(got), len(cut), sorted(got - cut)[:9], sorted(cut - got)[:9])
    report = {r.source: r for r in T.truncation_report(spark.createDataFrame(docs, DOC)).collect()}
    assert report["limited"].at_limit > 50 and report["signed"].cut == 0 and report["signed"].share == 0


def test_byte_limit(spark):
    rng = random.Random(3)
    docs, cut = [], set()
    for i in range(200):
        body = "。".join("".join(rng.choice("天地人山水火木") for _ in range(rng.randrange(5, 14))) for _ in range(rng.randrange(4, 40))) + "。"
        raw = body.encode()
        docs.append((i, raw[:600].decode("utf-8", "ignore"), "b"))
        if len(raw) > 600 and not docs[-1][1].endswith("。"):
            cut.add(i)
    got = {r.doc_id for r in T.cut_texts(spark.createDataFrame(docs, DOC)).collect()}
    assert len(got & cut) >= 0.97 * len(cut) and len(got - cut) <= 2


def test_nulls_blank_repeats_clashes_long(spark):
    rows = [(1, None, "s"), (2, "", "s"), (3, " \n​", None), (None, "A text that stops in the mid", None), (4, "A whole one.", None), (4, "A whole one.", None), (2**60 + 1, "Another text that just sto", None), (5, "." * 300_000 + "x", "s"), (6, " " * 300_000 + "Done.", "s"), (7, "```\ncode", "s")]
    got = [(r.doc_id, r.source) for r in T.cut_texts(with_clashes(spark.createDataFrame(rows, DOC))).collect()]
    assert (None, "") in got and (2**60 + 1, "") in got and (7, "s") in got and not {1, 2, 3, 4, 6} & {g[0] for g in got}
    assert T.cut_texts(spark.createDataFrame([], DOC)).count() == 0
    assert T.truncation_report(spark.createDataFrame([], DOC)).count() == 0


def test_what_is_put_behind_may_be_long_and_many_lines(spark):
    rng = random.Random(5)
    long = "This notice is set under each of the texts of the archive, whatever they hold, by the service that keeps them, and it goes on for well over a hundred and twenty characters."
    many = "\n".join(f"Line {chr(97 + i)} of the notice, which is the same under every text." for i in range(20))
    docs, cut = [], set()
    for source, behind in (("long", long), ("many", many), ("both", many + "\n" + long)):
        for i in range(120):
            body = "\n".join(sentence(rng) for _ in range(rng.randrange(5, 30)))
            docs.append((len(docs), (body if i % 6 else body[: len(body) * 2 // 3] + "wor") + "\n" + behind, source))
            if not i % 6:
                cut.add(len(docs) - 1)
    got = {r.doc_id for r in T.cut_texts(spark.createDataFrame(docs, DOC)).collect()}
    assert len(got & cut) >= 0.95 * len(cut) and len(got - cut) <= 2, (len(got), len(cut), sorted(cut - got)[:9], sorted(got - cut)[:9])


def test_spikes_are_at_a_maximum(spark):
    rng = random.Random(6)
    docs, limited = [], set()
    for i in range(600):
        body = " ".join(sentence(rng) for _ in range(rng.randrange(4, 40)))
        docs.append((i, body[:300] + "..." if len(body) > 303 else body, "dotted"))
        if len(body) > 303:
            limited.add(i)
    # half of the other texts are one common length, but just as many are a little longer
    docs += [(1000 + i, ("w" * (99 if i % 2 else rng.randrange(60, 190)) + " end of it")[:200], "plain") for i in range(400)]
    rows = T.cut_texts(spark.createDataFrame(docs, DOC)).collect()
    got = {r.doc_id for r in rows if r.why == "limit"}
    assert got <= limited and len(got) >= 0.98 * len(limited)
    assert T.at_spike("字" * 10 + "a", 31, set(), {33}) and T.at_spike("字\ufffd", 6, set(), {4}) and not T.at_spike("a" * 31, 31, set(), {33})


def test_open_structures():
    cases = {'{"a": [1, 2]}': False, '{"a": [1, 2': True, '{"a": "x}]': True, '{"a": "x\\\\"': True, '["a\\"b"]': False, '["a\\"': True, "[x]": None, "{}": False, "plain": None}
    assert {t: T.open_structure(t) for t in cases} == cases
