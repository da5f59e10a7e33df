import os
import pathlib
import re

import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_core_never_imports_the_llm_subpackage():
    root = pathlib.Path(__spark_entry__.__file__).parent / "threadloom"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"^\s*(from|import) threadloom\.llm", path.read_text(), re.MULTILINE), path


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", ["p3_found", "store_totals", "ingest_classes", "neighbours_radius1", "evidence_render", "token_intervals", "reused_sessions", "latency_percentiles", "date_parse", "choice_scoring", "evidence_id_parse", "bm25_topk", "evidence_pack_emitted", "memory_search", "chunk_requests", "retrieval_run", "run_contract", "gold_sessions", "prepared_counts", "rerank_order", "ledger_totals", "session_migration", "vector_audit"])
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for file in os.listdir(DATA):
        connection.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{file}')")
    df = __spark_entry__.queries()[name](spark, DATA)
    cursor = connection.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda rows: sorted(str(tuple(r)) for r in rows)
    assert key(df.select(*columns).collect()) == key(cursor.fetchall())


def test_entry(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    assert __spark_entry__.entry(spark).limit(1).count() == 1
