"""Global ranks without a window over one partition, budgets and prefixes over ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Hex digits of the bucket: 16 ** DIGITS buckets, whose counts are the only thing that reaches the driver.
DIGITS = 3


def rank_by_digest(df: DataFrame, digest: Column, out: str = "place") -> DataFrame:
    """Adds the 1-based rank of each row by a hexadecimal digest (ties: same digest, adjacent ranks).

    Rows are ranked inside the digest's leading digits; a bucket's offset is the count of the buckets before
    it, so each of 16 ** DIGITS buckets is sorted by itself and none of them is the whole table.
    """
    marked = df.withColumn("digest__", digest).withColumn("bucket__", F.substring("digest__", 1, DIGITS))
    counts = marked.groupBy("bucket__").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("offset__", F.coalesce(F.sum("n").over(Window.orderBy("bucket__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy("bucket__").orderBy("digest__"))
    return marked.withColumn("inside__", inside).join(F.broadcast(before), "bucket__").withColumn(out, F.col("inside__") + F.col("offset__")).drop("digest__", "bucket__", "inside__", "offset__")


def running_by_digest(df: DataFrame, digest: Column, weight: str, group: str, out: str = "before") -> DataFrame:
    """Adds the summed ``weight`` of the rows of the same ``group`` that come before a row in the order of a hexadecimal digest.

    The offset of a bucket of leading digits is the sum of the buckets before it, so no group is sorted as a whole.
    """
    marked = df.withColumn("digest__", digest).withColumn("bucket__", F.substring("digest__", 1, DIGITS))
    sums = marked.groupBy(group, "bucket__").agg(F.sum(weight).alias("n__"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset__", F.coalesce(F.sum("n__").over(earlier(Window.partitionBy(group).orderBy("bucket__"))), F.lit(0))).drop("n__")
    inside = F.coalesce(F.sum(weight).over(earlier(Window.partitionBy(group, "bucket__").orderBy("digest__"))), F.lit(0))
    return marked.withColumn("inside__", inside).join(offsets, [group, "bucket__"]).withColumn(out, F.col("inside__") + F.col("offset__")).drop("digest__", "bucket__", "inside__", "offset__")


def split_by_rank(groups: DataFrame, digest: Column, first: float = 0.6, second: float = 0.2) -> DataFrame:
    """Adds ``split``: the first, second and remaining share of groups by digest rank.

    Each of the first two parts has at least one group and the last keeps one, where there are three or more.
    """
    total = groups.count()
    a = min(max(1, int(total * first)), max(total - 2, 1))
    b = max(1, int(total * second))
    return rank_by_digest(groups, digest).withColumn("split", F.when(F.col("place") <= a, "dev").when(F.col("place") <= a + b, "validation").otherwise("heldout"))


def within_budget(ranked: DataFrame, by: list[str], rank: str, size: Column, budget: int) -> DataFrame:
    """The whole-item prefix of each list whose summed size stays within ``budget`` (0: no budget)."""
    if not budget:
        return ranked
    running = F.sum(F.greatest(size, F.lit(1))).over(Window.partitionBy(*by).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("used", running).where(F.col("used") <= budget).drop("used")


def top(df: DataFrame, by: list[str], order: list[Column], most: int | Column, out: str = "rank") -> DataFrame:
    """The first ``most`` rows of each list with their 1-based rank; Spark limits each group before the shuffle."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(out) <= most)
