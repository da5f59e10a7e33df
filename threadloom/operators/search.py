"""Ranked search of many queries in one plan, each inside its user's scope.

``queries``: ``query_id, user_id, query, options`` (array of strings or null). Scores are rounded before they
are ranked, as the order of a distributed sum isn't fixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions.text import STOP_WORDS
from threadloom.operators.index import exact_tokens
from threadloom.operators.ranks import top

QUERY_TERMS = 64
OPTION_WEIGHT = 0.35
RRF = 60
DIGITS = 6
#: Queries whose vectors are sent to every task; more are joined.
MOST_QUERIES = 10_000


def candidates_for(top_k: int) -> int:
    """How many candidates each ranking hands on."""
    return min(512, max(128, 4 * top_k))


def term_weights(queries: DataFrame) -> DataFrame:
    """``query_id, user_id, term, weight``: 1 for terms of the query, less for terms of its options only.

    Stop words go where the query and its options have another term.
    """
    own = queries.select("query_id", "user_id", F.explode(F.array_distinct(exact_tokens(F.col("query")))).alias("term"), F.lit(1.0).alias("weight"))
    options = queries.select("query_id", "user_id", F.explode("options").alias("option")).select("query_id", "user_id", F.explode(F.array_distinct(exact_tokens(F.col("option")))).alias("term"), F.lit(OPTION_WEIGHT).alias("weight"))
    merged = own.unionByName(options).repartition("query_id").groupBy("query_id", "user_id", "term").agg(F.max("weight").alias("weight"))
    stop = F.col("term").isin(*STOP_WORDS)
    return merged.withColumn("other", F.max(~stop).over(Window.partitionBy("query_id"))).where(~F.col("other") | ~stop).drop("other")


def weighted_terms(queries: DataFrame, terms: DataFrame, users: DataFrame) -> DataFrame:
    """``query_id, user_id, term, weight, idf, average``: the terms the user's messages have, best 64 per query."""
    return weigh(term_weights(queries), terms, users)


def weigh(asked: DataFrame, terms: DataFrame, users: DataFrame) -> DataFrame:
    """``weighted_terms`` of the result of ``term_weights``."""
    found = asked.join(terms, ["user_id", "term"]).join(users, "user_id")
    idf = F.round(F.log(1 + (F.col("message_count") - F.col("document_count") + 0.5) / (F.col("document_count") + 0.5)), 12)
    scored = found.select("query_id", "user_id", "term", "weight", idf.alias("idf"), F.greatest(F.col("total_length") / F.col("message_count"), F.lit(1.0)).alias("average"))
    return top(scored, ["query_id"], [F.desc("weight"), F.desc("idf"), F.asc("term")], QUERY_TERMS, "place").drop("place")


def bm25(weighted: DataFrame, posted: DataFrame, most: int) -> DataFrame:
    """``query_id, user_id, id, score, sequence, rank``; ties go to the earlier message."""
    joined = posted.join(weighted, ["user_id", "term"])
    f = F.col("frequency")
    part = F.col("weight") * F.col("idf") * f * F.lit(2.2) / (f + F.lit(1.2) * (F.lit(0.25) + F.lit(0.75) * F.col("doc_length") / F.col("average")))
    scored = joined.groupBy("query_id", "user_id", "id").agg(F.round(F.sum(part), DIGITS).alias("score"), F.min("sequence").alias("sequence"))
    return top(scored, ["query_id"], [F.desc("score"), F.asc("sequence"), F.asc("id")], most)


def cosine(queries: DataFrame, segments: DataFrame, most: int) -> DataFrame:
    """Best segment of each message by the dot product of unit vectors, clamped to [-1, 1].

    ``queries``: ``query_id, user_id, vector``; ``segments``: ``user_id, id, vector``. Result: ``query_id,
    user_id, id, score, rank``; ties go to the smaller id. Rows without a vector are left out.
    """
    both = segments.where("vector IS NOT NULL").join(queries.where("vector IS NOT NULL").withColumnRenamed("vector", "asked"), "user_id")
    dot = F.aggregate(F.zip_with("asked", "vector", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    scored = both.select("query_id", "user_id", "id", F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)), DIGITS).alias("score"))
    pooled = scored.groupBy("query_id", "user_id", "id").agg(F.max("score").alias("score"))
    return top(pooled, ["query_id"], [F.desc("score"), F.asc("id")], most)


def cosine_in_blocks(queries: DataFrame, segments: DataFrame, most: int) -> DataFrame:
    """``cosine`` for a set of at most ``MOST_QUERIES`` queries: their vectors go to every task, and each Arrow block of
    segments is one matrix product that keeps each query's best messages, ties included. A larger set is joined.
    """
    asked = queries.select("query_id", "user_id", "vector").where("vector IS NOT NULL")
    if asked.limit(MOST_QUERIES + 1).count() > MOST_QUERIES:
        return cosine(asked, segments, most)
    held = asked.toPandas()
    by_user = {u: (g["query_id"].to_list(), np.stack([np.asarray(v, float) for v in g["vector"]])) for u, g in held.groupby("user_id", dropna=False)}
    vectors = queries.sparkSession.sparkContext.broadcast(by_user)
    kinds = {f.name: f.dataType.simpleString() for f in [*queries.schema.fields, *segments.schema.fields]}

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for user, group in batch.groupby("user_id", sort=False):
                if user not in vectors.value:
                    continue
                ids, matrix = vectors.value[user]
                keys, names = pd.factorize(group["id"])
                products = np.clip(np.stack([np.asarray(v, float) for v in group["vector"]]) @ matrix.T, -1.0, 1.0)
                best = np.full((len(names), len(ids)), -np.inf)
                np.maximum.at(best, keys, products)
                for j, query in enumerate(ids):
                    column = best[:, j]
                    least = np.partition(column, -most)[-most] - 10.0**-DIGITS if len(names) > most else -np.inf
                    rows += [(query, user, names[i], column[i]) for i in np.flatnonzero(column >= least)]
            yield pd.DataFrame(rows, columns=["query_id", "user_id", "id", "score"])

    scored = segments.where("vector IS NOT NULL").select("user_id", "id", "vector").mapInPandas(score, f"query_id {kinds['query_id']}, user_id {kinds['user_id']}, id {kinds['id']}, score double")
    pooled = scored.groupBy("query_id", "user_id", "id").agg(F.round(F.max("score"), DIGITS).alias("score"))
    return top(pooled, ["query_id"], [F.desc("score"), F.asc("id")], most)


def fuse(lexical: DataFrame, semantic: DataFrame, semantic_weight: float = 1.0, most: int = 100) -> DataFrame:
    """Weighted reciprocal rank fusion of two ranked lists; weight 0 returns the lexical list as it is.

    Result: ``query_id, user_id, id, score, rank``; ties go to the better lexical rank, then the smaller id.
    """
    if not semantic_weight:
        return lexical.where(F.col("rank") <= most).select("query_id", "user_id", "id", "score", "rank")
    a = lexical.select("query_id", "user_id", "id", (F.lit(1.0) / (RRF + F.col("rank"))).alias("s"), F.col("rank").alias("l"))
    b = semantic.select("query_id", "user_id", "id", (F.lit(float(semantic_weight)) / (RRF + F.col("rank"))).alias("s"), F.lit(None).cast("int").alias("l"))
    merged = a.unionByName(b).groupBy("query_id", "user_id", "id").agg(F.round(F.sum("s"), 9).alias("score"), F.min("l").alias("l"))
    return top(merged, ["query_id"], [F.desc("score"), F.asc_nulls_last("l"), F.asc("id")], most).select("query_id", "user_id", "id", "score", "rank")


def fetch(ranked: DataFrame, messages: DataFrame) -> DataFrame:
    """Rows of the final ids, scoped by user again; an id of another user is dropped and not made up for."""
    return ranked.join(messages, ["user_id", "id"])
