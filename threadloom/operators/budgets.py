"""Request chunks and budget ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_MESSAGES = 20
CHUNK_WORDS = 2000


def chunk_messages(messages: DataFrame, most_messages: int = CHUNK_MESSAGES, most_words: int = CHUNK_WORDS) -> DataFrame:
    """Adds ``chunk``, the number of the request each message of a session is sent in, counted from 0.

    A chunk is closed before a message that would be its 21st or would take it over the word limit; a message
    over the limit is a chunk by itself. The state of the fold is three numbers and where chunks start; contents
    stay out of it, and each message is looked at once.
    """
    words = F.when(F.trim(F.coalesce("content", F.lit(""))) == "", 0).otherwise(F.size(F.split(F.trim("content"), r"(?U)\s+")))
    sessions = messages.select("user_id", "session_id", F.struct("sequence", "id", words.alias("words")).alias("m")).groupBy("user_id", "session_id").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    starts = F.expr(
        f"""aggregate(ms, named_struct('at', 1, 'n', 0, 'w', 0, 'starts', array(1)),
        (a, m) -> IF(a.n > 0 AND (a.n >= {int(most_messages)} OR a.w + m.words > {int(most_words)}),
          named_struct('at', a.at + 1, 'n', 1, 'w', m.words, 'starts', array_append(a.starts, a.at)),
          named_struct('at', a.at + 1, 'n', a.n + 1, 'w', a.w + m.words, 'starts', a.starts)),
        a -> a.starts)"""
    )
    begun = sessions.withColumn("starts", starts)
    cut = begun.select("user_id", "session_id", F.posexplode(F.expr("transform(starts, (b, c) -> slice(ms, b, coalesce(get(starts, c + 1), size(ms) + 1) - b))")).alias("chunk", "part"))
    return cut.select("user_id", "session_id", F.explode("part.id").alias("id"), "chunk")


def ledger_totals(calls: DataFrame, by: list[str]) -> DataFrame:
    """Attempts, outcomes, reserved and accounted tokens; an unsettled call is accounted as reserved."""
    return calls.groupBy(*by).agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count(F.when(F.col("status") == "ok", 1)).alias("ok"),
        F.count(F.when(F.col("status") == "failed", 1)).alias("failed"),
        F.sum("reserved").alias("reserved"),
        F.sum(F.coalesce("actual", "reserved")).alias("accounted"),
    )
