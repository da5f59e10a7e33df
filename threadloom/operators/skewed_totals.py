"""Per-key totals when a few keys hold most rows (problem 3).

Method: map-side combining. Spark's partial hash aggregate keeps a bounded table of mergeable key states per
input partition and spills it when full; what crosses the shuffle is one compact state per key and partition,
however many rows a key has. Sums and counts are algebraic, so no salting is needed on top.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.delivery import first_delivery

KEYS = ("store_id", "user_id")


def key_totals(rows: DataFrame, keys: tuple[str, ...] = KEYS, length: str = "doc_length") -> DataFrame:
    """``message_count`` and ``total_length`` per key; partial states are combined before the shuffle.

    Defined cases: null is a key value of its own; a null length adds 0; no rows, no result.
    """
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("message_count"), F.coalesce(F.sum(F.col(length).cast("bigint")), F.lit(0)).alias("total_length"))


def message_totals(messages: DataFrame) -> DataFrame:
    """The right ``message_count`` and ``total_length`` of every store and user.

    A message delivered several times counts once, by its row of the smallest sequence
    (``first_delivery`` gives the cases of null ids and ties).
    """
    return key_totals(first_delivery(messages, ["store_id", "user_id", "doc_length"]))


def wrong_totals(messages: DataFrame, statistics: DataFrame) -> DataFrame:
    """Keys whose stored statistics aren't what messages gives.

    Result: ``store_id, user_id, kind`` with kind ``missing`` (no stored row), ``extra`` (no message),
    ``null`` (a stored value is null) or ``differs``. Equal stored rows are one row; a key with several
    different stored rows is reported when any of them is wrong. Null keys match null keys.
    """
    # two dense partial states per key instead of a join on skewed keys: stored rows enter as their own state
    right = message_totals(messages).select(*KEYS, "message_count", "total_length", F.lit(True).alias("is_right"))
    stored = statistics.select(*KEYS, F.col("message_count").cast("bigint").alias("message_count"), F.col("total_length").cast("bigint").alias("total_length"), F.lit(False).alias("is_right"))
    both = right.unionByName(stored).groupBy(*KEYS)
    of = lambda column, here: F.when(F.col("is_right") == F.lit(here), F.col(column))
    merged = both.agg(
        F.max(of("message_count", True)).alias("count_right"),
        F.max(of("total_length", True)).alias("length_right"),
        F.min(of("message_count", False)).alias("count_low"),
        F.max(of("message_count", False)).alias("count_high"),
        F.min(of("total_length", False)).alias("length_low"),
        F.max(of("total_length", False)).alias("length_high"),
        F.count(F.when(~F.col("is_right"), 1)).alias("stored_rows"),
        F.count(F.when(~F.col("is_right") & (F.col("message_count").isNull() | F.col("total_length").isNull()), 1)).alias("null_rows"),
    )
    agree = (F.col("count_low") == F.col("count_right")) & (F.col("count_high") == F.col("count_right")) & (F.col("length_low") == F.col("length_right")) & (F.col("length_high") == F.col("length_right"))
    kind = F.when(F.col("count_right").isNull(), "extra").when(F.col("stored_rows") == 0, "missing").when(F.col("null_rows") > 0, "null").when(~agree, "differs")
    return merged.select(*KEYS, kind.alias("kind")).where(F.col("kind").isNotNull())
