"""Pieces of SQL and views that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions.text import CJK_RANGES, STOP_WORDS
from threadloom.operators.delivery import first_delivery
from threadloom.sources.tables import table

#: The largest users by message count, in whose scopes the evaluation questions are put one after another.
SCOPES = 9

_CJK = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in CJK_RANGES)
# full-width forms become their ASCII twins under NFKC
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)).replace("＇", "")
_NARROW = "".join(chr(ord(c) - 0xFEE0) for c in _WIDE)

MESSAGE_COLUMNS = ["store_id", "user_id", "session_id", "request_id", "message_index", "role", "content", "source_timestamp_ms", "ingested_at_ms", "doc_length"]


def sql_tokens(text: str) -> str:
    """DuckDB expression of the project tokens of a text."""
    folded = f"replace(lower(nfc_normalize(translate(coalesce({text}, ''), '{_WIDE}µ', '{_NARROW}μ'))), 'ß', 'ss')"
    runs = f"regexp_extract_all(regexp_replace({folded}, '([{_CJK}]+)', ' \\1 ', 'g'), '[\\p{{L}}\\p{{N}}{_CJK}]+')"
    split = f"CASE WHEN regexp_matches(r, '^[{_CJK}]') THEN list_concat(string_split(r, ''), list_transform(range(1, length(r)), lambda i: substr(r, i, 2))) ELSE [r] END"
    return f"flatten(list_transform({runs}, lambda r: {split}))"


#: First deliveries, as a CTE body.
SQL_M = "SELECT * FROM messages QUALIFY row_number() OVER (PARTITION BY id ORDER BY sequence, content) = 1"
SQL_POSTED = f"""SELECT user_id, id, sequence, len(ts) AS doc_length, term, count(*) AS frequency
FROM (SELECT user_id, id, sequence, ts, unnest(ts) AS term FROM (SELECT user_id, id, sequence, {sql_tokens("content")} AS ts FROM m))
GROUP BY ALL"""
SQL_USERS = f"SELECT user_id, count(*) AS message_count, CAST(sum(len({sql_tokens('content')})) AS BIGINT) AS total_length FROM m GROUP BY user_id"
SQL_STOP = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"
SQL_QUERIES = f"""WITH i AS (SELECT *, row_number() OVER (ORDER BY query_id) - 1 AS i FROM (SELECT DISTINCT query_id, question, answer FROM eval_items)),
c AS (SELECT user_id, row_number() OVER (ORDER BY count(*) DESC, user_id) - 1 AS n FROM m WHERE user_id IS NOT NULL GROUP BY user_id)
SELECT query_id, user_id, question AS query, [answer] AS options FROM i JOIN c ON c.n = i.i % {SCOPES} AND c.n < {SCOPES}
UNION ALL SELECT query_id || '@' || user_id, user_id, question, [answer] FROM c JOIN i ON i.i = CAST('0x' || substr(md5(user_id), 1, 8) AS BIGINT) % (SELECT count(*) FROM i)"""


def first_messages(spark: SparkSession, d: str, columns: list[str] | None = None) -> DataFrame:
    """Stored messages, one row per id."""
    return first_delivery(table(spark, d, "messages"), columns or MESSAGE_COLUMNS)


def search_requests(spark: SparkSession, d: str, messages: DataFrame) -> DataFrame:
    """Each evaluation question in the scope of one of the largest users, and each user of the store asked one of the
    questions, named ``question@user``; the question's answer is an option.

    Every stored message lies in the scope of at least one search.
    """
    counted = messages.where("user_id IS NOT NULL").groupBy("user_id").agg(F.count(F.lit(1)).alias("c"))
    users = counted.orderBy(F.desc("c"), "user_id").limit(SCOPES)
    users = users.select("user_id", (F.row_number().over(Window.orderBy(F.desc("c"), "user_id")) - 1).alias("n"))
    items = table(spark, d, "eval_items").select("query_id", "question", "answer").distinct()  # 320 rows at every scale
    numbered = items.withColumn("i", F.row_number().over(Window.orderBy("query_id")) - 1)
    largest = numbered.withColumn("n", F.col("i") % SCOPES).join(users, "n").select("query_id", "user_id", "question", "answer")
    drawn = F.conv(F.substring(F.md5("user_id"), 1, 8), 16, 10).cast("bigint") % items.count()
    each = counted.select("user_id", drawn.alias("i")).join(F.broadcast(numbered), "i").select(F.concat_ws("@", "query_id", "user_id").alias("query_id"), "user_id", "question", "answer")
    return largest.unionByName(each).select("query_id", "user_id", F.col("question").alias("query"), F.array("answer").alias("options"))
