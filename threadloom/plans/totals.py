"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.operators.skewed_totals import message_totals, wrong_totals
from threadloom.sources.tables import table


def p3_totals(spark: SparkSession, d: str) -> DataFrame:
    return message_totals(table(spark, d, "messages"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return wrong_totals(table(spark, d, "messages"), table(spark, d, "user_statistics")).select("store_id", "user_id")


QUERIES = {"p3_totals": p3_totals, "p3_found": p3_found}

_TOTALS = """
SELECT store_id, user_id, count(*) AS message_count, CAST(coalesce(sum(doc_length), 0) AS BIGINT) AS total_length
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sequence NULLS LAST, store_id, user_id, doc_length) AS n FROM messages)
WHERE n = 1 OR id IS NULL
GROUP BY store_id, user_id
"""

ORACLES = {
    "p3_totals": _TOTALS,
    "p3_found": f"""
WITH t AS ({_TOTALS}), s AS (SELECT DISTINCT store_id, user_id, message_count, total_length FROM user_statistics)
SELECT DISTINCT coalesce(t.store_id, s.store_id) AS store_id, coalesce(t.user_id, s.user_id) AS user_id
FROM t FULL JOIN s ON t.store_id IS NOT DISTINCT FROM s.store_id AND t.user_id IS NOT DISTINCT FROM s.user_id
WHERE t.message_count IS DISTINCT FROM s.message_count OR t.total_length IS DISTINCT FROM s.total_length
""",
}
