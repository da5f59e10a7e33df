import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadloom.functions.text import token_list
from threadloom.operators import index, skewed_totals, store
from threadloom.operators.delivery import first_delivery
from threadloom.operators.memory import Memory
from threadloom.sources import formats, snapshots
from threadloom.streaming import ingest as streaming

ROW = "store_id string, id string, user_id string, sequence bigint, doc_length int, content string"


def test_tokens():
    assert token_list("Straße ＡＢＣ don't x2") == ["strasse", "abc", "don", "t", "x2"]
    assert token_list("你好吗 ok") == ["你", "好", "吗", "你好", "好吗", "ok"]
    assert token_list("한국어 예시") == ["한국어", "예시"]
    assert token_list("a_b") == ["a", "b"] and token_list("") == token_list(None) == []


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=30), min_size=1, max_size=20))
def test_tokens_in_the_plan_are_exact(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", index.exact_tokens(F.col("t")).alias("x"))
    assert {r.i: list(r.x) for r in df.collect()} == {i: token_list(t) for i, t in enumerate(texts)}


def test_first_delivery(spark):
    rows = [("s", "a", "u", 5, 1, "late"), ("s", "a", "u", 2, 9, "first"), ("s", "a", "u", 2, 9, "first"), ("s", None, "u", 1, 1, "x"), ("s", None, "u", 1, 1, "x"), ("s", "b", "u", None, 1, "n"), ("s", "b", "u", 7, None, None)]
    df = spark.createDataFrame(rows, ROW).withColumn("row__", F.lit(1)).withColumn("k0", F.lit(2))
    got = sorted((str(r.id), str(r.sequence), str(r.content)) for r in first_delivery(df, ["content"]).collect())
    assert got == sorted([("a", "2", "first"), ("None", "1", "x"), ("None", "1", "x"), ("b", "7", "None")])
    assert first_delivery(df.limit(0), ["content"]).count() == 0


def test_totals_under_skew_nulls_and_clashes(spark):
    rows = [("s", f"m{i}", "hot" if i % 3 else f"u{i}", i, i % 7, "") for i in range(3000)] + [("s", "m1", "hot", 9999, 500, "")] * 2 + [(None, "z", None, 1, None, None)]
    messages = spark.createDataFrame(rows, ROW).withColumn("message_count", F.lit(-1)).withColumn("is_right", F.lit("x"))
    want = {}
    for s, _, u, _, n, _ in rows[:3000] + rows[-1:]:
        c, t = want.get((s, u), (0, 0))
        want[s, u] = (c + 1, t + (n or 0))
    got = {(r.store_id, r.user_id): (r.message_count, r.total_length) for r in skewed_totals.message_totals(messages).collect()}
    assert got == want
    stored = [(*k, *v) for k, v in want.items() if k[1] not in ("u0", "u3", "u6", "u9")] * 2 + [("s", "u3", 1, 99), ("s", "u6", None, 6), ("s", "gone", 1, 1), ("s", "u9", 1, 2), ("s", "u9", 1, 3)]
    statistics = spark.createDataFrame(stored, "store_id string, user_id string, message_count bigint, total_length bigint").withColumn("kind", F.lit("x"))
    got = {(r.user_id, r.kind) for r in skewed_totals.wrong_totals(messages, statistics).collect()}
    assert got == {("u0", "missing"), ("u3", "differs"), ("u6", "null"), ("gone", "extra"), ("u9", "differs")}
    assert skewed_totals.wrong_totals(messages.limit(0), statistics.limit(0)).count() == 0
    assert {r.kind for r in skewed_totals.wrong_totals(messages.limit(0), statistics).collect()} == {"extra"}


def test_statistics_of_two_users(spark):
    rows = [("s", "a1", "A", 1, 2, "red fox"), ("s", "a2", "A", 2, 2, "red hen"), ("s", "b1", "B", 3, 1, "noise")]
    m = spark.createDataFrame(rows, ROW)
    stats = {r.user_id: (r.message_count, r.total_length) for r in index.user_statistics(m).collect()}
    assert stats == {"A": (2, 4), "B": (1, 1)}
    terms = {(r.user_id, r.term): r.document_count for r in index.term_statistics(index.postings(m)).collect()}
    assert terms["A", "red"] == 2 and ("B", "red") not in terms


def test_validation_and_ids(spark):
    rows = [("u", "user", "hi"), ("u", "User", "hi"), ("u", "assistant", " 　 "), (" ", "user", "hi"), (None, "user", None), ("u", None, "x")]
    df = spark.createDataFrame(rows, "u string, role string, content string")
    errors = [r[0] for r in df.select(store.add_error(F.col("role"), F.col("content"), F.col("u"))).collect()]
    assert errors == [None, "role", "content", "id", "id", "role"]
    import hashlib

    user = 'a "q" ü\\'
    got = spark.createDataFrame([(user, "r", 3)], "u string, r string, i int").select(store.message_id(F.col("u"), F.col("r"), F.col("i"))).first()[0]
    assert got == "msg_" + hashlib.sha256(json.dumps([user, "r", 3], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    s = spark.createDataFrame([("u", "q", 5), ("u", None, 5), ("u", "q", 101), ("", "q", 1)], "u string, q string, k int")
    assert [r[0] for r in s.select(store.search_error(F.col("u"), F.col("q"), F.col("k"))).collect()] == [None, "query", "top_k", "user"]


def test_ingest_retries_conflicts_and_sequences(spark):
    arrivals = spark.createDataFrame([("u", "r1", "A", 1), ("u", "r1", "A", 2), ("u", "r1", "B", 3), ("u", "r2", "C", 4), ("v", "r1", "A", 5), ("u", "r3", "D", 6)], "user_id string, request_id string, body string, arrival bigint")
    held = spark.createDataFrame([("u", "r2", "C"), ("u", "r3", "old")], "user_id string, request_id string, body string")
    got = {r.arrival: (r.status, r.sequence) for r in store.ingest(arrivals, held, 10).collect()}
    assert got == {1: ("new", 11), 2: ("retry", None), 3: ("conflict", None), 4: ("retry", None), 5: ("new", 12), 6: ("conflict", None)}


def arrivals(spark, rows):
    """(request, arrival, [contents]) of one user as message rows."""
    return spark.createDataFrame([("u", "s", r, i, "user" if i % 2 == 0 else "assistant", t, None, at) for r, at, texts in rows for i, t in enumerate(texts)], streaming.MESSAGE)


def ask(spark, text, user="u"):
    return spark.createDataFrame([("q", user, text, None)], "query_id string, user_id string, query string, options array<string>")


def test_memory_adds_are_found_at_once(spark, tmp_path):
    memory = Memory(spark, str(tmp_path / "memory"))
    assert memory.lexical(ask(spark, "red"), 9).count() == 0
    status = lambda df: {r.arrival: r.status for r in df.collect()}
    assert status(memory.add(arrivals(spark, [("r1", 1, ["red fox", "blue hen"]), ("r2", 2, ["red cow"]), ("bad", 3, ["fine", " "])]))) == {1: "new", 2: "new", 3: "invalid"}
    assert memory.lexical(ask(spark, "red"), 9).count() == 2 and memory.lexical(ask(spark, "fine"), 9).count() == 0
    before = memory.high_water()
    assert status(memory.add(arrivals(spark, [("r1", 4, ["red fox", "blue hen"]), ("r2", 5, ["red cat"]), ("r3", 6, ["red hen"])]), "second")) == {4: "retry", 5: "conflict", 6: "new"}
    assert memory.add(arrivals(spark, [("r9", 7, ["never"])]), "second").count() == 0
    hits = memory.lexical(ask(spark, "red"), 9).orderBy("sequence").collect()
    assert [r.sequence for r in hits] == [1, 3, 4] and before == 3 and memory.high_water() == 4
    assert memory.lexical(ask(spark, "red", "v"), 9).count() == 0
    users = memory.read("users").collect()
    assert [tuple(r) for r in users] == [("u", 4, 8)]
    assert {r.term: r.document_count for r in memory.read("terms").collect()} == {"red": 3, "fox": 1, "blue": 1, "hen": 2, "cow": 1}
    small = memory.compact(str(tmp_path / "small"))
    assert sorted(map(tuple, small.lexical(ask(spark, "red"), 9).collect())) == sorted(map(tuple, hits)) and small.high_water() == 4
    assert status(small.add(arrivals(spark, [("r3", 8, ["red hen"])]))) == {8: "retry"}


def test_a_failed_add_leaves_the_store_as_it_was(spark, tmp_path, monkeypatch):
    memory = Memory(spark, str(tmp_path / "memory"))
    memory.add(arrivals(spark, [("r1", 1, ["red fox"])]))
    from threadloom.operators import index

    monkeypatch.setattr(index, "term_statistics", lambda posted: posted.select(F.raise_error(F.lit("down")).cast("string").alias("user_id")))
    with pytest.raises(Exception, match="down"):
        memory.add(arrivals(spark, [("r2", 2, ["red cow"])]))
    monkeypatch.undo()
    assert memory.lexical(ask(spark, "red"), 9).count() == 1 and memory.high_water() == 1
    assert [r.status for r in memory.add(arrivals(spark, [("r2", 2, ["red cow"])])).collect()] == ["new"]
    assert [r.sequence for r in memory.lexical(ask(spark, "red"), 9).orderBy("sequence").collect()] == [1, 2]


def test_streaming_adds(spark, tmp_path):
    inbox, state = (str(tmp_path / x) for x in ("in", "state"))
    memory = Memory(spark, str(tmp_path / "memory"))
    run = lambda: streaming.follow_requests(spark.readStream.schema(streaming.MESSAGE).parquet(inbox), memory, state).awaitTermination()
    arrivals(spark, [("r1", 1, ["red fox"]), ("r2", 2, ["red cow"])]).write.mode("append").parquet(inbox)
    run()
    assert memory.lexical(ask(spark, "red"), 9).count() == 2
    arrivals(spark, [("r1", 3, ["red fox"]), ("r2", 4, ["other"]), ("r9", 5, ["red hen"])]).write.mode("append").parquet(inbox)
    run()
    assert [r.sequence for r in memory.lexical(ask(spark, "red"), 9).orderBy("sequence").collect()] == [1, 2, 3]


def test_streaming_statistics(spark, tmp_path):
    rows = [("a", "st", "u", 3, 1000), ("a", "st", "u", 3, 2000), ("b", "st", "u", 4, 3000), ("c", "st", "v", None, 4000)]
    spark.createDataFrame(rows, "id string, store_id string, user_id string, doc_length int, ingested_at_ms bigint").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, store_id string, user_id string, doc_length int, ingested_at_ms bigint").parquet(str(tmp_path / "in"))
    query = streaming.running_statistics(stream).writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.user_id: (r.message_count, r.total_length) for r in spark.table("running").collect()} == {"u": (2, 7), "v": (1, None)}


def test_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "i int, t string")
    path = str(tmp_path / "x.jsonl")
    formats.write_json_lines(df, path)
    assert sorted(map(tuple, formats.read_json_lines(spark, path, "i int, t string").collect())) == [(1, "a b"), (2, None)]
    with pytest.raises(Exception, match="exist"):
        formats.write_json_lines(df, path)
    (tmp_path / "bad.jsonl").write_text('{"i": 1}\nnot json\n')
    with pytest.raises(Exception):  # noqa: B017
        formats.read_json_lines(spark, str(tmp_path / "bad.jsonl"), "i int").collect()
    (tmp_path / "keyed.jsonl").write_text('{"c1": [{"role": "user"}]}\n{"c2": []}\n')
    assert {r.key: len(r.value) for r in formats.read_keyed_lines(spark, str(tmp_path / "keyed.jsonl"), "array<struct<role: string>>").collect()} == {"c1": 1, "c2": 0}
    (tmp_path / "a.json").write_text('[{"i": 1}, {"i": 2}]')
    assert formats.read_json_array(spark, str(tmp_path / "a.json"), "i int").count() == 2
    (tmp_path / "t.csv").write_text('a,b\n1,"x ""q""\ny"\n')
    from pyspark.sql.types import IntegerType, StringType, StructField, StructType

    schema = StructType([StructField("a", IntegerType()), StructField("b", StringType())])
    assert formats.read_csv_checked(spark, str(tmp_path / "t.csv"), schema, ["a"]).first().b == 'x "q"\ny'
    with pytest.raises(ValueError, match="missing"):
        formats.read_csv_checked(spark, str(tmp_path / "t.csv"), schema, ["zz"])
    found = formats.file_digests(spark, str(tmp_path / "a.json"))
    want = spark.createDataFrame([("a.json", found.first().sha256), ("b.json", "0")], "name string, sha256 string")
    assert [tuple(r) for r in formats.check_digests(found, want).select("name", "problem").collect()] == [("b.json", "missing or changed")]
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    assert formats.selected(rows, spark.createDataFrame([(2,)], "k int"), "k").count() == 1
    with pytest.raises(Exception, match="repeated key"):
        formats.selected(rows, spark.createDataFrame([(1,)], "k int"), "k").collect()


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "store")
    assert snapshots.versions(spark, path) == []
    snapshots.commit(spark, path, {"t": spark.range(3).toDF("i")})
    snapshots.commit(spark, path, {"t": spark.range(5).toDF("i")})
    assert snapshots.read(spark, path, "t").count() == 5 and snapshots.read(spark, path, "t", 1).count() == 3
    with pytest.raises(ValueError):
        snapshots.read(spark, path, "t", 9)
