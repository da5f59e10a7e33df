"""Write-once ingest: validation, retries and conflicts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.session import write_table

#: Unicode white space, as the language the store was first written in counts it.
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"


def blank(text: Column) -> Column:
    return text.isNull() | (F.regexp_replace(text, SPACE, "") == "")


def add_error(role: Column, content: Column, *ids: Column) -> Column:
    """First reason why a message can't be stored, or null: ``id``, ``role``, ``content``."""
    wrong = F.lit(False)
    for c in ids:
        wrong = wrong | blank(c)
    return F.when(wrong, "id").when(role.isNull() | ~role.isin("user", "assistant"), "role").when(blank(content), "content")


def search_error(user: Column, query: Column, top_k: Column) -> Column:
    return F.when(blank(user), "user").when(query.isNull(), "query").when(top_k.isNull() | ~top_k.between(1, 100), "top_k")


def classify(arrivals: DataFrame, key: list[str], order: list[str], body: list[str]) -> DataFrame:
    """Adds ``status``: ``new`` for the first arrival of a key, then ``retry`` (same body) or ``conflict``."""
    w = Window.partitionBy(*key).orderBy(*order)
    digest = F.sha2(F.to_json(F.struct(*body), {"ignoreNullFields": "false"}), 256)
    marked = arrivals.withColumn("digest__", digest).withColumn("first__", F.first("digest__").over(w)).withColumn("n__", F.row_number().over(w))
    return marked.withColumn("status", F.when(F.col("n__") == 1, "new").when(F.col("digest__") == F.col("first__"), "retry").otherwise("conflict")).drop("digest__", "first__", "n__")


def message_id(user: Column, request: Column, index: Column) -> Column:
    """The id of a message: a digest of the JSON array of user, request and place."""
    quoted = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    return F.concat(F.lit("msg_"), F.sha2(F.concat(F.lit("["), quoted(user), F.lit(","), quoted(request), F.lit(","), index.cast("string"), F.lit("]")), 256))


def ingest(arrivals: DataFrame, stored: DataFrame, high_water: int, put: Callable[[DataFrame, str], DataFrame] = write_table) -> DataFrame:
    """Classified arrivals against what is stored: ``request`` rows with ``status`` and, for new ones, a sequence.

    arrivals: ``user_id, request_id, body, arrival``; stored: ``user_id, request_id, body``. Sequences go up
    from ``high_water`` in order of arrival, by one range shuffle and per-partition offsets, not one task. ``put`` as in ``number_rows``.
    """
    earlier = stored.select("user_id", "request_id", F.sha2("body", 256).alias("held"))
    seen = classify(arrivals, ["user_id", "request_id"], ["arrival"], ["body"]).join(earlier, ["user_id", "request_id"], "left")
    status = F.when(F.col("held").isNull(), F.col("status")).when(F.col("held") == F.sha2("body", 256), "retry").otherwise("conflict")
    return number_rows(seen.withColumn("status", status).drop("held"), F.col("status") == "new", ["arrival", "user_id", "request_id"], high_water, put)


def number_rows(rows: DataFrame, counted: Column, order: list[str], start: int, put: Callable[[DataFrame, str], DataFrame] = write_table) -> DataFrame:
    """Adds ``sequence`` to the rows that count, consecutive in ``order`` from ``start`` + 1. ``put`` stores the rows in their ranges."""
    ranged = put(rows.withColumn("counted__", counted).repartitionByRange(*order).withColumn("part__", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("part__").agg(F.count(F.when(F.col("counted__"), 1)).alias("n__"))
    offset = sums.withColumn("offset__", F.coalesce(F.sum("n__").over(Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n__")
    inside = F.sum(F.col("counted__").cast("int")).over(Window.partitionBy("part__").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    numbered = ranged.withColumn("inside__", inside).join(offset, "part__")
    return numbered.withColumn("sequence", F.when(F.col("counted__"), start + F.col("offset__") + F.col("inside__"))).drop("counted__", "part__", "inside__", "offset__")


#: Consecutive numbers of which one task sums up the weights.
SPAN = 10_000


def sums_before(rows: DataFrame, number: str, weight: str) -> DataFrame:
    """Adds ``before``, the summed ``weight`` of the rows with a smaller ``number`` (consecutive, each once), span by span."""
    marked = rows.withColumn("span__", F.floor(F.col(number) / SPAN))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = marked.groupBy("span__").agg(F.sum(weight).alias("n__"))
    offset = sums.withColumn("offset__", F.coalesce(F.sum("n__").over(earlier(Window.orderBy("span__"))), F.lit(0))).drop("n__")
    inside = F.coalesce(F.sum(weight).over(earlier(Window.partitionBy("span__").orderBy(number))), F.lit(0))
    return marked.withColumn("inside__", inside).join(F.broadcast(offset), "span__").withColumn("before", F.col("offset__") + F.col("inside__")).drop("span__", "offset__", "inside__")
