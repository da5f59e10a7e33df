"""Term index of a message store: postings and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import is_plain, plain_tokens, tokens


def exact_tokens(text: Column) -> Column:
    """Project tokens: inside the JVM for ASCII texts, by an Arrow UDF for the others only."""
    plain = is_plain(text)
    return F.when(text.isNull(), F.array().cast("array<string>")).when(plain, plain_tokens(text)).otherwise(tokens(F.when(~plain, text)))


def postings(messages: DataFrame) -> DataFrame:
    """``user_id, term, id, frequency, doc_length, sequence``; lengths and order ride along, so ranking needs no join back."""
    rows = messages.select("user_id", "id", "sequence", exact_tokens(F.col("content")).alias("tokens"))
    exploded = rows.select("user_id", "id", "sequence", F.size("tokens").alias("doc_length"), F.explode("tokens").alias("term"))
    return exploded.groupBy("user_id", "term", "id", "doc_length", "sequence").agg(F.count(F.lit(1)).alias("frequency"))


def user_statistics(messages: DataFrame) -> DataFrame:
    """``user_id, message_count, total_length``."""
    rows = messages.select("user_id", F.size(exact_tokens(F.col("content"))).alias("length"))
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("message_count"), F.sum("length").alias("total_length"))


def statistics_of(messages: DataFrame, posted: DataFrame) -> DataFrame:
    """``user_statistics`` of messages whose postings are there: lengths are summed from them, so no text is read again."""
    counted = messages.groupBy("user_id").agg(F.count(F.lit(1)).alias("message_count"), F.lit(0).cast("bigint").alias("total_length"))
    summed = posted.groupBy("user_id").agg(F.lit(0).cast("bigint").alias("message_count"), F.sum("frequency").alias("total_length"))
    return counted.unionByName(summed).groupBy("user_id").agg(F.sum("message_count").alias("message_count"), F.sum("total_length").alias("total_length"))


def term_statistics(posted: DataFrame) -> DataFrame:
    """``user_id, term, document_count``."""
    return posted.groupBy("user_id", "term").agg(F.count(F.lit(1)).alias("document_count"))
