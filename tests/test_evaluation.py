from pyspark.sql import functions as F

from tests.llm.helpers import HISTORY, MESSAGE, message
from threadloom.plans import evaluation


def test_equal_transcripts_link_samples(spark, tmp_path):
    h = lambda s, split, user, session: (s, "d", "src", split, user, None, [session], None)
    histories = [h("a", "dev", "u1", "s1"), h("b", "heldout", "u2", "s2"), h("c", "validation", "u2", "s3"), h("e", "heldout", None, "s4"), h("f", "heldout", None, "s5"), h("g", "validation", "u7", "s6")]
    texts = {"s1": ["hello", "there"], "s2": ["hello", "there"], "s3": ["other"], "s4": ["  "], "s5": ["  "], "s6": ["there", "hello"]}
    rows, n = [], 0
    for session, contents in texts.items():
        for i, t in enumerate(contents):
            n += 1
            rows.append(message(n, t, session=session, index=i, ts=1000 + n))
    spark.createDataFrame(histories, HISTORY).write.parquet(f"{tmp_path}/histories.parquet")
    spark.createDataFrame(rows + rows[:2], MESSAGE).write.parquet(f"{tmp_path}/messages.parquet")
    d = str(tmp_path)
    assert {r.sample_id: r.component for r in evaluation.identity_components(spark, d).collect()} == {"a": "a", "b": "a", "c": "a", "e": "e", "f": "f", "g": "g"}
    assert {r.component: r.partition for r in evaluation.governance_partition(spark, d).collect()} == {"a": "development", "e": "holdout", "f": "holdout", "g": "validation"}
    placed = {r.sample_id: (r.place, r.split) for r in evaluation.split_allocation(spark, d).collect()}
    assert placed["a"] == placed["b"] == placed["c"] and len({p for p, _ in placed.values()}) == 4
    used = spark.createDataFrame([("u:u7",)], "b string")
    known = spark.read.parquet(f"{d}/histories.parquet").select("sample_id", "original_split")
    got = evaluation.partitions(known, evaluation.identity_components(spark, d), evaluation._component_links(spark, d), used)
    assert {(r.component, r.reason) for r in got.where(F.col("partition") == "development").collect()} == {("a", "several splits"), ("g", "used before")}
    drawn = evaluation.partitions(known, evaluation.identity_components(spark, d), evaluation._component_links(spark, d), used, (0.5, 0.5)).collect()
    assert {r.component: r.reason for r in drawn} == {"a": "drawn", "e": "drawn", "f": "drawn", "g": "used before"} and all(r.partition in ("validation", "holdout") for r in drawn if r.component != "g")


def test_rerank_is_a_permutation_of_the_whole_list(spark, tmp_path):
    rows = [(i, [1.0] if i % 50 == 0 else [((i * 7) % 50) / 100], f"l{i // 360}") for i in range(720)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label string").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = evaluation.rerank_order(spark, str(tmp_path)).collect()
    for label in ("l0", "l1"):
        mine = sorted((r for r in got if r.query_id == label), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 121)) and len({r.item for r in mine}) == 120
        assert [(-r.score, r.item) for r in mine] == sorted((-r.score, r.item) for r in mine)


def test_texts_are_found_in_documents_of_any_language(spark, tmp_path):
    items = [("q1", "d", "dev", "c", "en", "which heron", "heron", "the grey heron"), ("q2", "d", "dev", "c", "de", "welcher Reiher", "Reiher", "der Reiher")]
    spark.createDataFrame(items, "query_id string, dataset string, original_split string, category string, lang string, question string, answer string, gold_text string").write.parquet(f"{tmp_path}/eval_items.parquet")
    docs = [(1, "see the grey heron", "en"), (2, "on the grey heron there", None), (3, "of the grey heron", "de"), (4, "nur der Reiher", "fr"), (5, None, None)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    d = str(tmp_path)
    assert {(r.doc_id, r.query_id) for r in evaluation.gold_contains(spark, d).collect()} == {(1, "q1"), (2, "q1"), (3, "q1"), (4, "q2")}
    assert {(r.query_id, r.unit_id): r.frequency for r in evaluation.text_frequency(spark, d).collect()} == {("q1", "gold"): 3, ("q1", "question"): 0, ("q2", "gold"): 1, ("q2", "question"): 0}
    assert {(r.query_id, r.hit) for r in evaluation.k_prefix_recall(spark, d).where("k = 20").collect()} == {("q1", 1), ("q2", 1)}
