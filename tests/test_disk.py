"""Bytes that the searches put into shuffles and leave in the shared folder, against the bytes of their input."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from threadloom.operators import blocks, index, memory as stored, search, store
from threadloom.operators.memory import Memory
from threadloom.plans import searching
from threadloom.session import shared_dir

M = "user_id string, id string, session_id string, request_id string, message_index int, role string, sequence bigint, content string, source_timestamp_ms bigint"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """4,000 messages of 200 users, one of them with a quarter."""
    d, draw = tmp_path_factory.mktemp("disk"), random.Random(7)
    words = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(3000)]
    rows = [("u0" if i % 4 == 0 else f"u{draw.randrange(200)}", i, f"s{i // 5}", f"r{i // 2}", i % 2, "user", i, " ".join(draw.choices(words, k=36)), None, 0, 36, "st") for i in range(4000)]
    df = spark.createDataFrame(rows, M.replace("id string, session", "id int, session") + ", ingested_at_ms bigint, doc_length int, store_id string").withColumn("id", F.concat(F.lit("msg_"), F.sha2(F.col("id").cast("string"), 256)))
    df.coalesce(4).write.parquet(f"{d}/messages.parquet")
    asked = [(f"q{i}", " ".join(draw.choices(words, k=12)), draw.choice(words)) for i in range(40)]
    spark.createDataFrame(asked, "query_id string, question string, answer string").write.parquet(f"{d}/eval_items.parquet")
    return d


def shuffled(spark) -> int:
    """Bytes that this session has written to shuffles so far."""
    context, jvm = spark.sparkContext, spark._jvm
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def size(path) -> int:
    return sum(p.stat().st_size for p in Path(path).rglob("*.parquet"))


@pytest.mark.parametrize(("name", "most"), [("bm25_options", 6), ("query_term_weights", 8), ("char_budget_prefix", 8), ("evidence_pack_emitted", 10), ("evidence_grounded", 11), ("retrieval_summary", 9), ("hashed_topk", 8), ("rrf_weighted_half", 9), ("bm25_topk", 8), ("evidence_pack_reserved", 10), ("retrieval_compare", 10), ("scoped_fetch", 8), ("memory_search", 12), ("retrieval_run", 9), ("rrf_fusion", 9)])
def test_shuffles_follow_the_input(spark, folder, name, most):
    searching._BUILT.clear()  # each pays for its build
    before = shuffled(spark)
    assert entry.queries()[name](spark, str(folder)).count()
    assert shuffled(spark) - before < most * size(folder / "messages.parquet")


def test_stored_index_is_no_larger_than_twice_the_messages(spark, folder, tmp_path):
    memory = Memory(spark, str(tmp_path / "memory"))
    memory.load(spark.read.parquet(f"{folder}/messages.parquet").drop("ingested_at_ms", "doc_length", "store_id"))
    assert size(tmp_path / "memory") < 2 * size(folder / "messages.parquet")


def test_blocks_give_what_joins_give(spark, folder, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 150)
    messages = spark.read.parquet(f"{folder}/messages.parquet").withColumn("content", F.when(F.col("sequence") % 50 == 1, "").otherwise(F.col("content")))
    users, posted = index.user_statistics(messages), index.postings(messages)
    items = spark.read.parquet(f"{folder}/eval_items.parquet")
    queries = items.crossJoin(spark.createDataFrame([("u0",), ("u1",), ("u2",), ("none",)], "user_id string")).select(F.concat_ws("@", "query_id", "user_id").alias("query_id"), "user_id", F.col("question").alias("query"), F.array("answer").alias("options"))
    held = messages.select("user_id", "id", "sequence", F.array_join(index.exact_tokens(F.col("content")), " ").alias("tokens"))
    weighted = search.weighted_terms(queries, index.term_statistics(posted), users)
    for most in (3, 20):
        want = sorted(map(tuple, search.bm25(weighted, posted, most).collect()))
        assert want and sorted(map(tuple, blocks.bm25(held, weighted, users, most).select("query_id", "user_id", "id", "score", "sequence", "rank").collect())) == want
    from threadloom.operators import vectors

    segments = messages.select("user_id", "id", vectors.hashed(F.col("content")).alias("vector"))
    want = sorted(map(tuple, search.cosine(queries.select("query_id", "user_id", vectors.hashed(F.col("query")).alias("vector")), segments, 5).collect()))
    asked = queries.select("query_id", "user_id", F.array_join(index.exact_tokens(F.col("query")), " ").alias("tokens"))
    assert want and sorted(map(tuple, blocks.cosine(held, asked, users, 5).collect())) == want


def test_sums_before(spark, monkeypatch):
    monkeypatch.setattr(store, "SPAN", 4)
    rows = spark.createDataFrame([(i, i % 3) for i in range(1, 30)], "i bigint, n bigint")
    assert {r.i: r.before for r in store.sums_before(rows, "i", "n").collect()} == {i: sum(k % 3 for k in range(1, i)) for i in range(1, 30)}


def test_terms_are_counted_in_steps_and_stored_in_order(spark, folder, tmp_path, monkeypatch):
    monkeypatch.setattr(stored, "STEP", 500)
    messages, memory = spark.read.parquet(f"{folder}/messages.parquet"), Memory(spark, str(tmp_path / "memory"))
    memory.load(messages.drop("ingested_at_ms", "doc_length", "store_id"))
    want = index.term_statistics(index.postings(messages))
    got = memory.read("terms")
    assert got.count() == want.count() and not got.exceptAll(want.select(got.columns)).count()
    files = sorted((tmp_path / "memory/data/terms/version=1").glob("*.parquet"))
    assert len(files) > 4  # steps
    rows = [tuple(r) for r in spark.read.parquet(str(files[0])).select("user_id", "term").collect()]
    assert rows == sorted(rows)


def test_adds_leave_their_store_and_outcomes_only(spark, folder):
    from threadloom.plans.memory import _added

    at = Path(f"{shared_dir(spark).removeprefix('file://')}/threadloom")
    held = set(at.glob("*"))
    memory, outcomes = _added(spark, str(folder))
    assert [p.name.split("-")[0] for p in sorted(set(at.glob("*")) - held)] == ["memory", "status", "status"]
    assert all(o.count() for o in outcomes) and memory.read("messages").count() == 4000
