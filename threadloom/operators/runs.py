"""Retrieval runs: what of the gold a ranked list found, graded by source, at item and character limits; and their contracts.

``units``: ``query_id, unit_id, session_id, id, text`` - the gold messages of a query with their place; ``returned``:
``query_id, rank, id, session_id, body``; ``frequency``: ``query_id, unit_id, times`` - in how many messages of the
query's scope the unit's text stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions.text import squeezed


def unit_ranks(units: DataFrame, returned: DataFrame, frequency: DataFrame) -> DataFrame:
    """``query_id, unit_id, session_id, times, source_at, text_at``: the best rank at which a unit's own message came back,
    and at which its text did, whatever message held it. Only a text that stands once in the scope tells its place.

    The equal query id keeps the containment test to a query's own list.
    """
    told = returned.select("query_id", "rank", F.col("id").alias("returned_id"), squeezed(F.coalesce("body", F.lit(""))).alias("body"))
    both = units.join(told, "query_id")
    same = F.col("returned_id") == F.col("id")
    inside = F.col("body").contains(squeezed(F.coalesce("text", F.lit(""))))
    found = both.groupBy("query_id", "unit_id").agg(F.min(F.when(same, F.col("rank"))).alias("source_at"), F.min(F.when(inside, F.col("rank"))).alias("text_at"))
    joined = units.select("query_id", "unit_id", "session_id").join(frequency, ["query_id", "unit_id"], "left").join(found, ["query_id", "unit_id"], "left")
    once = F.coalesce(F.col("times") == 1, F.lit(False))
    return joined.select("query_id", "unit_id", "session_id", "times", "source_at", F.when(once, F.col("text_at")).alias("text_at"))


def limits(returned: DataFrame, prefixes: tuple[int, ...], budgets: tuple[int, ...]) -> DataFrame:
    """``query_id, k, budget, cutoff, items, characters`` of every query with a result, prefix and budget (0: none).

    A list is cut before the first item that goes over the budget; ``cutoff`` is the last rank that is kept.
    """
    order = Window.partitionBy("query_id").orderBy("rank")
    size = F.length(F.coalesce("body", F.lit("")))
    running = returned.select("query_id", "rank", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("used"))
    grid = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(b).alias("budget")) for k in prefixes for b in budgets]))
    each = running.withColumn("g", grid).select("query_id", "rank", "used", "g.*")
    kept = (F.col("rank") <= F.col("k")) & ((F.col("budget") == 0) | (F.col("used") <= F.col("budget")))
    last = lambda c: F.coalesce(F.max(F.when(kept, F.col(c))), F.lit(0))
    return each.groupBy("query_id", "k", "budget").agg(last("rank").alias("cutoff"), F.count(F.when(kept, 1)).alias("items"), last("used").alias("characters"))


def graded(ranks: DataFrame, cut: DataFrame) -> DataFrame:
    """Per query, prefix and budget: gold and hit turns, those verified by source, ambiguous ones, gold and hit sessions.

    A turn is hit by its own message or by a text that can stand nowhere else; a text that stands several times and whose
    message didn't come back is ambiguous and no hit. A session is hit by the message of one of its turns.
    """
    within = lambda c: F.coalesce(F.col(c) <= F.col("cutoff"), F.lit(False))
    hit = within("source_at") | within("text_at")
    unsure = ~within("source_at") & F.coalesce(F.col("times") != 1, F.lit(True))
    n = lambda c: F.count(F.when(c, 1))
    one = ranks.join(cut.select("query_id", "k", "budget", "cutoff"), "query_id").groupBy("query_id", "k", "budget").agg(
        F.count(F.lit(1)).alias("gold"),
        n(hit).alias("hit"),
        n(within("source_at")).alias("verified"),
        n(unsure).alias("ambiguous"),
        F.count_distinct("session_id").alias("gold_sessions"),
        F.count_distinct(F.when(within("source_at"), F.col("session_id"))).alias("hit_sessions"),
    )
    return one.withColumns({"any_hit": F.col("hit") > 0, "all_hit": F.col("hit") == F.col("gold"), "macro": F.col("hit") / F.col("gold")})


def summary(requested: DataFrame, grades: DataFrame, cut: DataFrame, by: list[str]) -> DataFrame:
    """Means over all requested queries, one row per ``by``, prefix and budget; a query without a grade counts as 0."""
    pairs = sorted((r["k"], r["budget"]) for r in cut.select("k", "budget").distinct().collect())  # the grid, a handful of rows
    one = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(b).alias("budget")) for k, b in pairs or [(0, 0)]])
    grid = requested.select("query_id", *by).distinct().withColumn("g", F.explode(one)).select("query_id", *by, "g.*")
    joined = grid.join(grades, ["query_id", "k", "budget"], "left").join(cut, ["query_id", "k", "budget"], "left")
    mean = lambda c: F.round(F.sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0))) / F.count(F.lit(1)), 9)
    return joined.groupBy(*by, "k", "budget").agg(
        F.count(F.lit(1)).alias("requested"),
        F.count("gold").alias("graded"),
        mean("any_hit").alias("recall_any"),
        mean("all_hit").alias("recall_all"),
        mean("macro").alias("recall_macro"),
        F.sum(F.coalesce("ambiguous", F.lit(0))).alias("ambiguous"),
        mean("characters").alias("mean_characters"),
    )


def compared(a: DataFrame, b: DataFrame, good: str) -> DataFrame:
    """Two runs over the same queries, per prefix and budget: both, gains, losses, neither, and queries only one has."""
    key = ["query_id", "k", "budget"]
    both = a.select(*key, F.col(good).alias("a")).join(b.select(*key, F.col(good).alias("b")), key, "full")
    n = lambda c: F.count(F.when(c, 1))
    x, y = F.col("a"), F.col("b")
    return both.groupBy("k", "budget").agg(n(x & y).alias("both"), n(~x & y).alias("gains"), n(x & ~y).alias("losses"), n(~x & ~y).alias("neither"), n(x.isNull() | y.isNull()).alias("one_sided"))


def violations(run: DataFrame, requests: DataFrame, most: int, blank: Column) -> DataFrame:
    """``query_id, violation, n`` of a run ``query_id, id, score``: more than ``most`` rows, a repeated or blank id, a blank
    content (``blank``), a score that is no number, and rows of queries that weren't asked. A sound run has none."""
    asked = requests.select("query_id").distinct().withColumn("asked__", F.lit(True))
    counted = run.join(asked, "query_id", "left").groupBy("query_id").agg(
        F.greatest(F.count(F.lit(1)) - most, F.lit(0)).alias("too_many"),
        (F.count("id") - F.count_distinct("id")).alias("repeated_id"),
        F.count(F.when(F.col("id").isNull() | (F.trim("id") == ""), 1)).alias("blank_id"),
        F.count(F.when(blank, 1)).alias("blank_content"),
        F.count(F.when(F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf")), 1)).alias("no_score"),
        F.count(F.when(F.col("asked__").isNull(), 1)).alias("not_asked"),
    )
    names = ("too_many", "repeated_id", "blank_id", "blank_content", "no_score", "not_asked")
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("violation"), F.col(x).alias("n")) for x in names]))
    return counted.select("query_id", each.alias("v")).select("query_id", "v.*").where("n > 0")
