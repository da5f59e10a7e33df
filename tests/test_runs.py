import math

import pytest
from pyspark.sql import functions as F

from threadloom.operators import grading, prepare, runs, vectors


def test_grading_by_source_and_limits(spark):
    units = spark.createDataFrame([("q1", "a", "s1", "m1", "the red  fox"), ("q1", "b", "s1", "m2", "ok"), ("q1", "c", "s2", "m3", "blue hen"), ("q2", "a", "s9", "m9", "never")], "query_id string, unit_id string, session_id string, id string, text string")
    returned = spark.createDataFrame([("q1", 1, "m7", "s7", "here: the red fox"), ("q1", 2, "m8", "s8", "ok"), ("q1", 3, "m3", "s2", "blue hen"), ("q3", 1, "x", "s", None)], "query_id string, rank int, id string, session_id string, body string")
    frequency = spark.createDataFrame([("q1", "a", 1), ("q1", "b", 5), ("q1", "c", 2), ("q2", "a", 1)], "query_id string, unit_id string, times bigint")
    ranks = {(r.query_id, r.unit_id): (r.source_at, r.text_at) for r in runs.unit_ranks(units, returned, frequency).collect()}
    assert ranks == {("q1", "a"): (None, 1), ("q1", "b"): (None, None), ("q1", "c"): (3, None), ("q2", "a"): (None, None)}
    cut = runs.limits(returned, (1, 5), (0, 19))
    kept = {(r.query_id, r.k, r.budget): (r.cutoff, r["items"], r.characters) for r in cut.collect()}
    assert kept["q1", 5, 0] == (3, 3, 27) and kept["q1", 5, 19] == (2, 2, 19) and kept["q1", 1, 19] == (1, 1, 17) and kept["q3", 1, 19] == (1, 1, 0)
    grades = runs.graded(runs.unit_ranks(units, returned, frequency), cut)
    got = {(r.k, r.budget): (r.gold, r.hit, r.verified, r.ambiguous, r.gold_sessions, r.hit_sessions, r.any_hit, r.all_hit) for r in grades.where("query_id = 'q1'").collect()}
    assert got[5, 0] == (3, 2, 1, 1, 2, 1, True, False) and got[1, 0] == (3, 1, 0, 2, 2, 0, True, False)
    mean = {(r.k, r.budget): r for r in runs.summary(units.select("query_id"), grades, cut, []).collect()}[5, 0]
    assert (mean.requested, mean.graded, mean.recall_any, mean.recall_macro) == (2, 1, 0.5, round(1 / 3, 9))
    other = grades.withColumn("any_hit", ~F.col("any_hit"))
    assert {(r.both, r.gains, r.losses, r.neither, r.one_sided) for r in runs.compared(grades, other, "any_hit").collect()} == {(0, 0, 1, 0, 0)}
    assert {r.one_sided for r in runs.compared(grades, other.limit(0), "any_hit").collect()} == {1}


def test_contract_of_a_run(spark):
    rows = [("q1", "a", 1.0, "x"), ("q1", "a", 0.5, " "), ("q1", "", math.nan, "y"), ("q2", "b", 1.0, "x"), ("q9", "c", math.inf, "x")]
    run = spark.createDataFrame(rows, "query_id string, id string, score double, content string")
    asked = spark.createDataFrame([("q1",), ("q2",), ("q2",)], "query_id string")
    got = {(r.query_id, r.violation): r.n for r in runs.violations(run, asked, 2, F.trim("content") == "").collect()}
    assert got == {("q1", "too_many"): 1, ("q1", "repeated_id"): 1, ("q1", "blank_id"): 1, ("q1", "blank_content"): 1, ("q1", "no_score"): 1, ("q9", "no_score"): 1, ("q9", "not_asked"): 1}
    assert runs.violations(run.where("query_id = 'q2'"), asked, 2, F.trim("content") == "").count() == 0


@pytest.mark.parametrize("at_once", [1, 2, 100])
def test_texts_sought_in_blocks(spark, at_once):
    bodies = spark.createDataFrame([(1, "aaa b"), (2, "漢字 b"), (3, None), (None, "b"), (4, "")], "doc_id bigint, body string")
    texts = spark.createDataFrame([("aa",), ("b",), ("字",), ("b",), ("",), (None,), ("zz",)], "text string")
    assert {(r.doc_id, r.text) for r in grading.containing(bodies, texts, at_once).collect()} == {(1, "aa"), (1, "b"), (2, "字"), (2, "b")}
    assert grading.containing(bodies, texts.limit(0)).count() == 0


def test_stored_vectors(spark):
    rows = [(1, [0.6, 0.8]), (2, [1.0, 1.0]), (3, None), (4, [math.nan, 1.0]), (5, [])]
    df = spark.createDataFrame(rows, "i int, v array<float>").withColumn("back", vectors.decoded(vectors.encoded("v")))
    got = {r.i: r.back for r in df.collect()}
    assert [round(x, 6) for x in got[1]] == [0.6, 0.8] and all(got[i] is None for i in (2, 3, 4, 5))
    assert [r[0] for r in df.orderBy("i").select(vectors.equivalent(F.col("v"), F.col("back"))).collect()] == [True, False, False, False, False]
    assert spark.range(1).select(vectors.decoded(F.lit(b"abc"))).first()[0] is None
    near = spark.createDataFrame([([0.6, 0.8], [0.600005, 0.8]), ([0.6, 0.8], [0.601, 0.8]), ([0.6, 0.8], [0.6])], "a array<double>, b array<double>")
    assert [r[0] for r in near.select(vectors.equivalent(F.col("a"), F.col("b"))).collect()] == [True, False, False]


def test_told_messages_and_migration(spark):
    m = spark.createDataFrame([("system", "be kind", "Ann"), ("user", "hi", " "), ("assistant", "yes", None)], "role string, content string, speaker string")
    safe = m.select(prepare.without_system(F.col("role"), F.col("content")).alias("s"), prepare.told(F.col("content"), F.lit("2024/01/01"), F.col("speaker")).alias("t")).collect()
    assert [tuple(r.s) for r in safe] == [("user", "[historical system note]\nbe kind"), ("user", "hi"), ("assistant", "yes")]
    assert [r.t for r in safe] == ["[session_date: 2024/01/01]\nAnn: be kind", "[session_date: 2024/01/01]\nhi", "[session_date: 2024/01/01]\nyes"]
    labels = spark.createDataFrame([(1, "s", 0, "a"), (2, "s", 1, "b"), (3, "s", 0, "zz"), (4, "t", 0, "a")], "label_id int, session_id string, position int, content string")
    held = spark.createDataFrame([("s", "s#0", 0, "a"), ("s", "s#1", 0, "other"), ("s", "s#0", 1, "b"), ("s", "s#1", 1, "b")], "session_id string, occurrence_id string, position int, content string")
    assert {r.label_id: (r.matches, r.occurrence_id) for r in prepare.migrated(labels, held).collect()} == {1: (1, "s#0"), 2: (2, None), 3: (0, None), 4: (0, None)}
    same = spark.createDataFrame([("A  b", "a B"), ("a", "b"), (None, "a")], "a string, b string")
    assert [r[0] for r in same.select(prepare.same_answer(F.col("a"), F.col("b"))).collect()] == [True, False, None]
