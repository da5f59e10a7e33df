from pyspark.sql import functions as F

from threadloom.operators import attribution, prepare
from threadloom.operators.context import BETWEEN


def test_closed_world(spark):
    df = spark.createDataFrame([('{"a": 1, "b": 2}',), ('{"a": 1, "x": 2}',), ("[]",)], "j string").select(prepare.closed_world(F.col("j"), ["a", "b"], ["c"]).alias("w"))
    got = [(r.w.missing, r.w.unknown) for r in df.collect()]
    assert got[0] == ([], []) and got[1] == (["b"], ["x"]) and got[2] == (None, None)


def test_positions_uniqueness_and_cutoff(spark):
    h = spark.createDataFrame([("h", ["s1"]), ("h", ["s1"])], "sample_id string, session_ids array<string>")
    m = spark.createDataFrame([("a", "s1", 3, "same  text"), ("b", "s1", 1, " same text"), ("c", "s1", 2, "other"), ("d", "s2", 1, "x")], "id string, session_id string, sequence bigint, content string")
    got = prepare.history_messages(h, m)
    assert {(r.id, r.position, r.unique_text) for r in got.collect()} == {("b", 0, False), ("c", 1, True), ("a", 2, False)}
    ends = spark.createDataFrame([("h", 2)], "sample_id string, end_index int")
    assert {r.id for r in prepare.before_cutoff(got, ends, ["sample_id"]).collect()} == {"b", "c"}


def test_parts_occurrences_and_contamination(spark):
    m = spark.createDataFrame([("u", "s", str(i), i, r) for i, r in enumerate(["user", "assistant", " System", "user", None, "system"])], "user_id string, session_id string, id string, sequence bigint, role string")
    assert [r.part for r in prepare.session_parts(m).orderBy("sequence").collect()] == [1, 1, 2, 2, 2, 3]
    ids = spark.range(2).select(prepare.occurrence_id(F.lit("k"), F.col("id"))).collect()
    assert ids[0][0] == "k" and ids[1][0].startswith("occ_")
    c = spark.createDataFrame([("1", "u", None), ("2", None, "c"), ("3", "U", "C"), ("4", None, None)], "k string, user string, conv string")
    used = spark.createDataFrame([("9", "u", "c"), ("8", None, None)], "k string, user string, conv string")
    assert {r.k for r in prepare.contaminated(c, used, ["user", "conv"]).collect()} == {"1", "2"}


def test_parsers(spark):
    one = lambda f, xs: [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, t string").orderBy("i").select(f(F.col("t"))).collect()]
    assert one(prepare.judgement, ['{"label": "CORRECT"}', '{"label": "right"}', '{"label": "WRONG", "why": 1}', "WRONG"]) == ["CORRECT", None, None, None]
    assert one(prepare.options, ["(a) one (b) two (c) three (d) four", "(a) one (c) x", None]) == [["one", "two", "three", "four"], None, None]


def test_attribution(spark):
    head = lambda k: '[source {"role":"user","message_id":"' + k + '"}]\n'
    quoted = "see" + BETWEEN + "[source not json]\nend"
    content = head("m1") + quoted + BETWEEN + head("m2") + "two"
    assert attribution.parts(content) == [("m1", quoted), ("m2", "two")]
    assert attribution.parts("bare text") == [(None, "bare text")]
    items = spark.createDataFrame([("q", 1, content), ("q", 2, head("m2") + "twoX")], "query_id string, place int, content string")
    messages = spark.createDataFrame([("m1", quoted), ("m2", "two")], "id string, content string")
    assert sorted((r.place, r.part, r.grounded) for r in attribution.grounded(items, messages).collect()) == [(1, 0, True), (1, 1, True), (2, 0, False)]


def test_split_writer(spark, tmp_path):
    path = str(tmp_path / "out")
    prepare.write_splits(spark.createDataFrame([("d", "dev", 1), ("d", "heldout", 2)], "dataset string, split string, v int"), path)
    assert spark.read.parquet(path).where("split = 'dev'").count() == 1
