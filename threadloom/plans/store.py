"""Queries on the store: tokens, statistics, identities, validation, ingest classes, fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import grading, index, store
from threadloom.plans.prelude import SQL_M, SQL_POSTED, SQL_USERS, first_messages
from threadloom.sources.tables import table


def postings(spark: SparkSession, d: str) -> DataFrame:
    return index.postings(first_messages(spark, d, ["user_id", "content"])).select("user_id", "id", "term", "frequency", "doc_length", "sequence")


def user_statistics(spark: SparkSession, d: str) -> DataFrame:
    return index.user_statistics(first_messages(spark, d, ["user_id", "content"]))


def term_statistics(spark: SparkSession, d: str) -> DataFrame:
    return index.term_statistics(index.postings(first_messages(spark, d, ["user_id", "content"])))


def message_identity(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "messages")
    return m.select("id", "sequence", store.message_id(F.col("user_id"), F.col("request_id"), F.col("message_index")).alias("derived"))


def validate_reject(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "messages")
    error = store.add_error(F.col("role"), F.col("content"), F.col("user_id"), F.col("session_id"), F.col("request_id"))
    return m.select("id", "sequence", error.alias("error")).where("error IS NOT NULL")


def ingest_classes(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "messages")
    return store.classify(m, ["id"], ["sequence", "role", "content"], ["role", "content"]).select("id", "sequence", "status")


def delivery_occurrence(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    m = table(spark, d, "messages")
    return m.select("id", "sequence", (F.row_number().over(Window.partitionBy("id").orderBy("sequence")) - 1).alias("occurrence"))


def orphan_statistics(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "user_statistics").select("store_id", "user_id").distinct()
    m = table(spark, d, "messages").select("store_id", "user_id").distinct()
    return s.join(m, ["store_id", "user_id"], "left_anti")


def missing_vectors(spark: SparkSession, d: str) -> DataFrame:
    m = first_messages(spark, d, ["user_id", "content"])
    indexed = index.postings(m).select("id").distinct()
    return m.join(indexed, "id", "left_anti").select("user_id", "id")


def table_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumns({"o_totalprice": F.col("o_totalprice").cast("decimal(20,6)").cast("string"), "o_orderdate": F.unix_micros(F.col("o_orderdate").cast("timestamp"))})
    return grading.fingerprint(o, ["o_orderstatus"])


def redelivered_rows(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "messages").select("id", "role", "content")
    firsts = first_messages(spark, d, ["role", "content"]).select("id", "role", "content")
    return grading.differing(m, firsts, ["id", "role", "content"])


def store_totals(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "messages")
    return m.groupBy("store_id").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("messages"), F.count_distinct("user_id").alias("users"), F.max("sequence").alias("high_water"))


def duplicate_texts(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    x = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "source", F.md5(F.trim(F.regexp_replace("text", r"[ \t\n\r]+", " "))).alias("digest"))
    return x.withColumn("copies", F.count(F.lit(1)).over(Window.partitionBy("source", "digest"))).where("copies > 1").select("doc_id", "copies")


QUERIES = {f.__name__: f for f in (postings, user_statistics, term_statistics, message_identity, validate_reject, ingest_classes, delivery_occurrence, orphan_statistics, missing_vectors, table_fingerprint, redelivered_rows, store_totals, duplicate_texts)}

_SPACE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}\x{0b}]"


def _blank(c: str) -> str:
    return f"coalesce(regexp_replace({c}, '{_SPACE}', '', 'g'), '') = ''"


ORACLES = {
    "postings": f"WITH m AS ({SQL_M}) SELECT user_id, id, term, frequency, doc_length, sequence FROM ({SQL_POSTED})",
    "user_statistics": f"WITH m AS ({SQL_M}) {SQL_USERS}",
    "term_statistics": f"WITH m AS ({SQL_M}) SELECT user_id, term, count(*) AS document_count FROM ({SQL_POSTED}) GROUP BY user_id, term",
    "message_identity": "SELECT id, sequence, 'msg_' || sha256('[' || to_json(user_id)::VARCHAR || ',' || to_json(request_id)::VARCHAR || ',' || message_index || ']') AS derived FROM messages",
    "validate_reject": f"""SELECT id, sequence, error FROM (SELECT id, sequence, CASE WHEN {_blank("user_id")} OR {_blank("session_id")} OR {_blank("request_id")} THEN 'id'
WHEN coalesce(role, '') NOT IN ('user', 'assistant') THEN 'role' WHEN {_blank("content")} THEN 'content' END AS error FROM messages) WHERE error IS NOT NULL""",
    "ingest_classes": """SELECT id, sequence, CASE WHEN n = 1 THEN 'new' WHEN role IS NOT DISTINCT FROM r1 AND content IS NOT DISTINCT FROM c1 THEN 'retry' ELSE 'conflict' END AS status
FROM (SELECT *, row_number() OVER w AS n, first_value(role) OVER w AS r1, first_value(content) OVER w AS c1 FROM messages WINDOW w AS (PARTITION BY id ORDER BY sequence, role NULLS FIRST, content NULLS FIRST))""",
    "delivery_occurrence": "SELECT id, sequence, row_number() OVER (PARTITION BY id ORDER BY sequence) - 1 AS occurrence FROM messages",
    "orphan_statistics": "SELECT DISTINCT store_id, user_id FROM user_statistics s WHERE NOT EXISTS (SELECT 1 FROM messages m WHERE m.store_id = s.store_id AND m.user_id = s.user_id)",
    "missing_vectors": f"WITH m AS ({SQL_M}) SELECT user_id, id FROM m WHERE id NOT IN (SELECT id FROM ({SQL_POSTED}))",
    "table_fingerprint": """SELECT o_orderstatus, count(*) AS rows, CAST(sum(CAST(('0x' || substr(sha256('{"o_custkey":' || o_custkey || ',"o_orderdate":' || epoch_us(o_orderdate) || ',"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority
|| '","o_orderstatus":"' || o_orderstatus || '","o_totalprice":"' || CAST(o_totalprice AS DECIMAL(20,6)) || '"}'), 1, 15)) AS HUGEINT)) AS VARCHAR) AS digest FROM orders GROUP BY o_orderstatus""",
    "redelivered_rows": f"WITH m AS ({SQL_M}) SELECT *, 'left' AS side FROM (SELECT id, role, content FROM messages EXCEPT ALL SELECT id, role, content FROM m)",
    "store_totals": "SELECT store_id, count(*) AS rows, count(DISTINCT id) AS messages, count(DISTINCT user_id) AS users, max(sequence) AS high_water FROM messages GROUP BY store_id",
    "duplicate_texts": r"""SELECT doc_id, copies FROM (SELECT doc_id, count(*) OVER (PARTITION BY source, md5(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g'), ' '))) AS copies FROM documents WHERE text IS NOT NULL) WHERE copies > 1""",
}
