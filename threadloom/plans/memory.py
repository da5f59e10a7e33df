"""Queries on a stored memory that is added to in rounds: outcomes of the adds, statistics, and searches afterwards."""

from __future__ import annotations

from contextlib import ExitStack

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.operators.memory import Memory
from threadloom.plans.prelude import SQL_M, first_messages, search_requests
from threadloom.plans.searching import _STORE, _weighted
from threadloom.plans.store import _blank
from threadloom.session import put_aside, put_table, scratch_path

_COLUMNS = ["user_id", "session_id", "request_id", "message_index", "role", "content", "source_timestamp_ms"]


def _added(spark: SparkSession, d: str) -> tuple[Memory, list[DataFrame]]:
    """A store after two rounds of adds, and their outcomes.

    The first round has every second request, by a digest of its id; the second has all of them, every twentieth with other
    source times, so that what was stored before comes again, as it was or changed, among new requests.
    """
    memory = Memory(spark, scratch_path(spark, "memory"))
    m = first_messages(spark, d, _COLUMNS)
    drawn = F.conv(F.substring(F.md5("request_id"), 1, 4), 16, 10).cast("int") % 20
    arrived = lambda first: first.select(*_COLUMNS, drawn.alias("drawn"), F.min("sequence").over(Window.partitionBy("user_id", "request_id")).alias("arrival"))
    with ExitStack() as stack:
        with put_aside(m, "first") as held:
            rows = stack.enter_context(put_aside(arrived(held), "arrivals"))
        first = rows.where("drawn % 2 = 0")
        changed = F.when(F.col("drawn") == 0, F.coalesce("source_timestamp_ms", F.lit(0)) + 1).otherwise(F.col("source_timestamp_ms"))
        second = rows.withColumn("source_timestamp_ms", changed).withColumn("arrival", F.col("arrival") + 10**12)
        return memory, [memory.add(x.drop("drawn"), name) for x, name in ((first, "first"), (second, "second"))]


def memory_adds(spark: SparkSession, d: str) -> DataFrame:
    _, outcomes = _added(spark, d)
    each = [o.groupBy("status").agg(F.count(F.lit(1)).alias("requests")).withColumn("round", F.lit(i + 1)) for i, o in enumerate(outcomes)]
    return each[0].unionByName(each[1]).select("round", "status", "requests")


def memory_statistics(spark: SparkSession, d: str) -> DataFrame:
    return _added(spark, d)[0].read("users")


def memory_search(spark: SparkSession, d: str) -> DataFrame:
    """Messages found and best score of each search after both rounds."""
    memory, _ = _added(spark, d)
    requests = put_table(search_requests(spark, d, memory.read("messages")), "requests")
    weighted = put_table(memory.weighted(requests), "weighted")
    # a query lies in one part, as its user does
    return memory.stepwise("found", lambda part, _: part.scores(requests, weighted).groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), F.max("score").alias("best")))


QUERIES = {f.__name__: f for f in (memory_adds, memory_statistics, memory_search)}

_REQUESTS = f"""m0 AS ({SQL_M}), req AS (SELECT user_id, request_id, CAST('0x' || substr(md5(request_id), 1, 4) AS INT) % 20 AS drawn,
bool_or({_blank("user_id")} OR {_blank("session_id")} OR {_blank("request_id")} OR coalesce(role, '') NOT IN ('user', 'assistant') OR {_blank("content")}) AS wrong FROM m0 GROUP BY user_id, request_id)"""
_KEPT = "SELECT m0.* FROM m0 JOIN req USING (user_id, request_id) WHERE NOT wrong"

ORACLES = {
    "memory_adds": f"""WITH {_REQUESTS} SELECT round, status, count(*) AS requests FROM (SELECT 1 AS round, CASE WHEN wrong THEN 'invalid' ELSE 'new' END AS status FROM req WHERE drawn % 2 = 0
UNION ALL SELECT 2, CASE WHEN wrong THEN 'invalid' WHEN drawn = 0 THEN 'conflict' WHEN drawn % 2 = 0 THEN 'retry' ELSE 'new' END FROM req) GROUP BY ALL""",
    "memory_statistics": f"WITH {_REQUESTS}, m AS ({_KEPT}) SELECT user_id, count(*) AS message_count, CAST(sum(doc_length) AS BIGINT) AS total_length FROM m GROUP BY user_id",
    "memory_search": f"""WITH {_REQUESTS}, {_STORE.replace(SQL_M, _KEPT, 1)}, {_weighted(True)} SELECT query_id, count(*) AS found, max(score) AS best FROM (
SELECT query_id, id, round(sum(weight * idf * frequency * 2.2::DOUBLE / (frequency + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_length / average))), 6) AS score FROM posted JOIN w USING (user_id, term) GROUP BY ALL) GROUP BY query_id""",
}
