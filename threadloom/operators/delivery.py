"""At-least-once delivery: one row per message id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_delivery(messages: DataFrame, columns: list[str]) -> DataFrame:
    """One row per ``id`` with ``columns`` of the row of the smallest ``sequence``.

    Rows delivered more than once shrink in the map-side half of the aggregate, so the shuffle carries
    one row per id and input partition, and only the named columns. Ids are near unique, so no key is hot.

    Defined cases: a row whose id is null is a message of its own; a null sequence counts as later than any
    other; rows equal in id and sequence are told apart by the named columns, nulls last, so the choice
    doesn't depend on row order; an empty table gives an empty one. Columns not named are never read.
    """
    columns = [c for c in dict.fromkeys(columns) if c not in ("id", "sequence")]
    # (is null, value) makes a null sort last inside the ordering struct
    order = F.struct(
        F.col("sequence").isNull().alias("k0"),
        F.col("sequence").alias("k1"),
        *[x for i, c in enumerate(columns) for x in (F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"v{i}"))],
    )
    nameless = F.when(F.col("id").isNull(), F.monotonically_increasing_id())
    first = messages.groupBy("id", nameless.alias("nameless__")).agg(F.min(order).alias("row__"))
    return first.select("id", F.col("row__.k1").alias("sequence"), *[F.col(f"row__.v{i}").alias(c) for i, c in enumerate(columns)])
