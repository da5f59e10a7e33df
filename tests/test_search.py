import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from threadloom.functions.text import STOP_WORDS, token_list
from threadloom.operators import budgets, components, context, grading, index, ranks, search, vectors
from threadloom.plans import searching

M = "user_id string, id string, session_id string, request_id string, message_index int, role string, sequence bigint, content string, source_timestamp_ms bigint"


def store(spark, texts, user="u"):
    return spark.createDataFrame([(user, f"m{i}", "s", "r", i, "user", i, t, None) for i, t in enumerate(texts)], M)


def ask(spark, rows):
    return spark.createDataFrame(rows, "query_id string, user_id string, query string, options array<string>")


def lexical(messages, queries, most=20):
    posted = index.postings(messages)
    return search.bm25(search.weighted_terms(queries, index.term_statistics(posted), index.user_statistics(messages)), posted, most)


def brute(texts, query, options=()):
    weights = {t: 1.0 for t in token_list(query)}
    for o in options:
        for t in token_list(o):
            weights.setdefault(t, search.OPTION_WEIGHT)
    if any(t not in STOP_WORDS for t in weights):
        weights = {t: w for t, w in weights.items() if t not in STOP_WORDS}
    docs = [Counter(token_list(t)) for t in texts]
    n, average = len(docs), max(sum(sum(d.values()) for d in docs) / len(docs), 1.0)
    scores = {}
    for i, d in enumerate(docs):
        s = 0.0
        for t, w in weights.items():
            if d[t]:
                df = sum(1 for x in docs if x[t])
                idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
                s += w * idf * d[t] * 2.2 / (d[t] + 1.2 * (0.25 + 0.75 * sum(d.values()) / average))
        if s:
            scores[f"m{i}"] = round(s, 6)
    return sorted(scores.items(), key=lambda x: (-x[1], int(x[0][1:])))


def test_bm25_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["the", "of"] + [f"w{i}" for i in range(30)] + ["漢字", "straße"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 25))) for _ in range(60)]
    cases = [("q1", "w1 w2 w2 the", ["w3 w1"]), ("q2", "the of", []), ("q3", "漢字 STRASSE", None), ("q4", "zzz", ["the"]), ("q5", "", [])]
    got = {}
    for r in lexical(store(spark, texts), ask(spark, [(q, "u", t, o) for q, t, o in cases])).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    for q, t, o in cases:
        want = brute(texts, t, o or ())[:20]
        assert [x[0] for x in got.get(q, [])] == [x[0] for x in want] and all(abs(a[1] - b[1]) < 2e-6 for a, b in zip(got.get(q, []), want))


def test_scope_is_exact(spark):
    m = store(spark, ["red fox"], "u").unionByName(store(spark, ["red hen"], "U")).unionByName(store(spark, ["red cow"], "u "))
    got = lexical(m, ask(spark, [("q", "u", "red", None)])).collect()
    assert [r.user_id for r in got] == ["u"]


def test_cosine_pools_and_breaks_ties(spark):
    seg = spark.createDataFrame([("u", i, [1.0, 0.0]) for i in ("b", "aa", "z", "a", "b")] + [("u", "low", [0.0, 1.0]), ("u", "low", [0.6, 0.8])], "user_id string, id string, vector array<float>")
    q = spark.createDataFrame([("q", "u", [1.0, 0.0])], "query_id string, user_id string, vector array<float>")
    assert [(r.id, r.rank) for r in search.cosine(q, seg, 2).orderBy("rank").collect()] == [("a", 1), ("aa", 2)]
    assert {r.id: r.score for r in search.cosine(q, seg, 9).collect()}["low"] == 0.6
    for n in (2, 9):
        assert sorted(map(tuple, search.cosine(q, seg, n).collect())) == sorted(map(tuple, search.cosine_in_blocks(q, seg, n).collect()))
    assert [round(x, 6) for x in spark.range(1).select(vectors.unit(F.array(F.lit(3.0), F.lit(4.0)))).first()[0]] == [0.6, 0.8]
    assert spark.range(1).select(vectors.unit(F.array(F.lit(0.0)))).first()[0] is None


def test_fusion_tie_goes_to_the_lexical_rank(spark):
    lex = spark.createDataFrame([("q", "u", "target", 3.0, 1)], "query_id string, user_id string, id string, score double, rank int")
    sem = spark.createDataFrame([("q", "u", f"d{i:03}", 1.0, i) for i in range(1, 129)], "query_id string, user_id string, id string, score double, rank int")
    assert search.fuse(lex, sem, 1.0, 1).first().id == "target"
    assert search.fuse(lex, sem, 0).count() == 1 and search.fuse(lex, sem, 0).first().score == 3.0
    assert search.candidates_for(1) == 128 and search.candidates_for(100) == 400


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_neighbours_against_brute_force(spark, radius):
    rng = random.Random(radius)
    rows = [("u", f"m{i}", f"s{i % 3}", "r", i, "user", i, "t", rng.randrange(50) if rng.random() < 0.8 else None) for i in range(60)]
    got = {r.id: (list(r.before), list(r.after)) for r in context.neighbours(spark.createDataFrame(rows, M), radius).collect()}
    for m in rows:
        mine = sorted((x for x in rows if x[2] == m[2]), key=lambda x: x[6])
        at = mine.index(m)
        near = mine[max(0, at - radius) : at + radius + 1]
        if radius and all(x[8] is not None for x in near):
            mine = sorted((x for x in mine if x[8] is not None), key=lambda x: (x[8], x[6]))
            at = mine.index(m)
        assert got[m[1]] == ([x[1] for x in mine[max(0, at - radius) : at]] if radius else [], [x[1] for x in mine[at + 1 : at + 1 + radius]])


def test_packing(spark):
    kind = "lists array<struct<id: string, size: bigint, score: double, near: array<struct<id: string, size: bigint>>>>"
    near = lambda *xs: [(x, 10) for x in xs]

    def pack(lists, grouping="reserved", **limits):
        return [(k.id, list(k.parts)) for k in context.fold_items(spark.createDataFrame([(lists,)], kind), grouping, **limits).first().kept]

    two = [("b", 1, 3.0, near("a", "c")), ("c", 1, 2.0, near("b", "d"))]
    assert pack(two) == [("b", ["b", "a"]), ("c", ["c", "d"])]
    assert pack(two, "emitted") == [("b", ["b", "a", "c"])]
    assert pack([("a", 50, 1.0, []), ("b", 1, 0.5, [])], most=1) == [("a", ["a"])]
    assert pack([("a", 1, 1.0, [("n1", 99), ("n2", 1), ("n2", 1)])], window=40) == [("a", ["a", "n2"])]
    assert pack([("a", 5, 3.0, []), ("b", 50, 2.0, []), ("c", 1, 1.0, [])], most=20) == [("a", ["a"])]
    assert pack([]) == []


def test_evidence_of_a_search(spark):
    m = store(spark, ["red fox", "blue hen", "red cow"])
    items = context.evidence_items(lexical(m, ask(spark, [("q", "u", "blue", None)])), m).collect()
    assert len(items) == 1 and items[0].content.count("[source {") == 3 and "timestamp" not in items[0].content
    dated = m.withColumn("source_timestamp_ms", F.lit(0).cast("bigint"))
    assert '"timestamp_utc":"1970-01-01T00:00:00.000Z"' in dated.select(context.evidence()).first()[0]
    far = m.withColumn("source_timestamp_ms", F.lit(2**63 - 1).cast("bigint"))
    assert "timestamp_utc" not in far.select(context.evidence()).first()[0]


def test_segments_and_intervals(spark):
    assert "".join(context.cut_bytes("añ😀字" * 9, 5)) == "añ😀字" * 9 and all(len(p.encode()) <= 5 for p in context.cut_bytes("añ😀字" * 9, 5))
    for n in (0, 1, 448, 449, 10_000):
        got = spark.range(1).select(context.token_intervals(F.lit(n), 448, 64)).first()[0]
        assert (not got) if n == 0 else (got[0].start == 0 and got[-1].end == n and all(b.start == a.start + 384 for a, b in zip(got, got[1:])))
    for width, overlap in ((0, 0), (4, 4), (4, -1)):
        with pytest.raises(ValueError):
            context.token_intervals(F.lit(1), width, overlap)


def test_grading(spark):
    units = spark.createDataFrame([("q1", "a", "gold one"), ("q1", "b", "spans two"), ("q2", "a", "x")], "query_id string, unit_id string, text string")
    returned = spark.createDataFrame([("q1", 2, "has gold one"), ("q1", 1, "spans"), ("q1", 3, "two")], "query_id string, rank int, body string")
    graded = grading.recall_at(grading.first_ranks(units, returned, "body", "text"), (1, 5))
    got = {(r.query_id, r.k): (r.hit, r.any_hit, r.all_hit) for r in graded.collect()}
    assert got == {("q1", 1): (0, False, False), ("q1", 5): (1, True, False), ("q2", 1): (0, False, False), ("q2", 5): (0, False, False)}
    asked = spark.createDataFrame([("q1", "c"), ("q2", "c"), ("q3", "c"), ("q4", "c")], "query_id string, category string")
    mean = grading.over_requested(asked, graded, ["category"], (5,)).first()
    assert (mean.requested, mean.graded, mean.recall_any, mean.recall_macro) == (4, 2, 0.25, 0.125)
    side = lambda *xs: spark.createDataFrame(list(enumerate(xs)), "query_id int, ok boolean")
    assert tuple(grading.paired(side(True, False, True, False), side(True, True, False, False), "ok").first()) == (1, 1, 1, 1)
    same = spark.createDataFrame([(1, "a"), (2, "b")], "i int, t string")
    assert grading.differing(same, same.orderBy(F.desc("i")), ["i", "t"]).count() == 0
    assert grading.differing(same, same.withColumn("t", F.lit("a")), ["i", "t"]).count() == 2
    assert {r.rows for r in grading.fingerprint(same.withColumn("g", F.lit(1)), ["g"]).collect()} == {2}
    p = grading.spread(spark.createDataFrame([("g", float(i)) for i in range(1, 21)], "g string, v double"), ["g"], "v").first()
    assert (p.p50, p.p95, p.most) == (10.5, 19.0, 20.0)


def test_parsers(spark):
    def one(f, xs, kind="string"):
        return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], f"i int, t {kind}").orderBy("i").select(f(F.col("t"))).collect()]

    told = ["b", " (C) ", "(b).", "b because", "so <final_answer>(a)</final_answer> ", "so <final_answer> D", "<final_answer>a<final_answer>b", "</final_answer> <final_answer>a", "<final_answer>a, I think", "<final_answer>", "Final answer: (a)", "", None]
    assert one(grading.choice, told) == ["b", "c", None, None, "a", "d", None, None, None, None, None, None, None]
    named = [["D8:6; D9:17", "D30:05"], ["D"], ["D1:2 and more"], ["D08:06, D8:6"], [], ["D1:1", None], ["D1:1", ""], None]
    assert one(grading.evidence_ids, named, "array<string>") == [["D30:5", "D8:6", "D9:17"], None, None, ["D8:6"], [], None, None, None]
    dates = ["2023/05/20 (Sat) 02:21", "1:56 pm on 8 May, 2023", "1:56 PM on 8 May 2023", "12:09 am on 13 September, 2023", "11:01 am on 8 Sep, 2023", "11:01 am on 8 Sep 2023", "13:56 pm on 8 May, 2023", "2023/05/20 (Xyz) 02:21", "2023/02/30 (Thu) 02:21", "2023-05-08", "soon", None]
    assert one(grading.parse_date, dates) == [1684549260000, 1683554160000, 1683554160000, 1694563740000, 1694170860000, None, None, None, None, None, None, None]


def test_ranks_and_budgets(spark):
    groups = spark.createDataFrame([(f"g{i}",) for i in range(10)], "g string")
    got = {r.g: r.split for r in ranks.split_by_rank(groups, F.sha2("g", 256)).collect()}
    again = {r.g: r.split for r in ranks.split_by_rank(groups.orderBy(F.desc("g")), F.sha2("g", 256)).collect()}
    assert got == again and Counter(got.values()) == {"dev": 6, "validation": 2, "heldout": 2}
    sized = spark.createDataFrame([(f"g{i}", i % 3, i + 1) for i in range(30)], "g string, kind int, size int")
    summed = sorted(ranks.running_by_digest(sized, F.sha2("g", 256), "size", "kind").select("kind", F.sha2("g", 256).alias("d"), "size", "before").collect())
    for kind in range(3):
        mine = [r for r in summed if r.kind == kind]
        assert [r.before for r in mine] == [sum(x["size"] for x in mine[:i]) for i in range(10)]
    ranked = spark.createDataFrame([("q", 1, 5), ("q", 2, 9), ("q", 3, 1)], "q string, rank int, size int")
    assert [r.rank for r in ranks.within_budget(ranked, ["q"], "rank", F.col("size"), 13).collect()] == [1]
    assert ranks.within_budget(ranked, ["q"], "rank", F.col("size"), 0).count() == 3
    m = spark.createDataFrame([("u", "s", f"m{i}", i, "w " * (1500 if i == 25 else 10)) for i in range(50)], "user_id string, session_id string, id string, sequence bigint, content string")
    chunks = {r.id: r.chunk for r in budgets.chunk_messages(m).collect()}
    want, n, w, c = {}, 0, 0, 0
    for i in range(50):
        size = 1500 if i == 25 else 10
        if n and (n >= 20 or w + size > 2000):
            n, w, c = 0, 0, c + 1
        want[f"m{i}"], n, w = c, n + 1, w + size
    assert chunks == want


def test_components(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "y"), ("c", "d")], "a string, b string")
    assert {r.node: r.root for r in components.merge_roots(edges).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}
    assert components.merge_roots(edges.where("a = 'y'")) is None


def test_every_user_is_searched(spark, tmp_path):
    rows = [(f"u{u:02}", f"m{u}-{i}", "s", "r", i, "user", u * 100 + i, f"red fox {u}", None, 0, 3, "st") for u in range(15) for i in range(20 - u)]
    spark.createDataFrame(rows, M + ", ingested_at_ms bigint, doc_length int, store_id string").write.parquet(f"{tmp_path}/messages.parquet")
    spark.createDataFrame([("q1", "which fox", "red"), ("q2", "what is red", "fox")], "query_id string, question string, answer string").write.parquet(f"{tmp_path}/eval_items.parquet")
    for query in (searching.bm25_topk, searching.rrf_fusion):
        got = query(spark, str(tmp_path)).collect()
        assert {r.id.split("-")[0] for r in got} == {f"m{u}" for u in range(15)}
        assert {"q1", "q2"} < {r.query_id for r in got} and all(r.id.startswith(f"m{int(r.query_id[-2:])}-") for r in got if "@" in r.query_id)


def test_cosine_leaves_out_null_vectors_both_ways(spark, monkeypatch):
    seg = spark.createDataFrame([("u", "a", [1.0, 0.0]), ("u", "b", None), ("u", "c", [0.6, 0.8]), ("u", "c", None)], "user_id string, id string, vector array<double>")
    q = spark.createDataFrame([("q", "u", [1.0, 0.0]), ("none", "u", None)], "query_id string, user_id string, vector array<double>")
    want = [("q", "u", "a", 1.0, 1), ("q", "u", "c", 0.6, 2)]
    assert sorted(map(tuple, search.cosine(q, seg, 9).collect())) == want
    assert sorted(map(tuple, search.cosine_in_blocks(q, seg, 9).collect())) == want
    monkeypatch.setattr(search, "MOST_QUERIES", 0)
    assert sorted(map(tuple, search.cosine_in_blocks(q, seg, 9).collect())) == want
