"""Grading of ranked lists: evidence recall, prefixes, fixed denominators, percentiles, paired comparison."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.session import write_table

PREFIXES = (5, 10, 20, 50, 100)
#: Texts that are sought in one pass over the bodies; more take several passes.
SOUGHT = 20_000


def containing(bodies: DataFrame, texts: DataFrame, at_once: int = SOUGHT) -> DataFrame:
    """``doc_id, text``: which bodies (``doc_id, body``) hold which of ``texts`` (``text``), character by character.

    A stated set of texts against all rows: the texts of one block are one automaton, which reads each body once
    whatever their number; more than ``at_once`` are split into blocks by their digest, and each block takes a pass.
    Null and empty texts are held by nothing.
    """
    wanted = write_table(texts.select("text").where("length(text) > 0").distinct(), "sought")
    blocks = max(1, -(-wanted.count() // at_once))
    found = None
    for block in range(blocks):
        sought = [r["text"] for r in wanted.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).collect()]

        def read(batches: Iterator[pd.DataFrame], sought=sought) -> Iterator[pd.DataFrame]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for text in sought:
                automaton.add_word(text, text)
            automaton.make_automaton()
            for batch in batches:
                rows = [(doc, text) for doc, body in zip(batch["doc_id"], batch["body"]) for text in {t for _, t in automaton.iter(body)}]
                yield pd.DataFrame(rows, columns=["doc_id", "text"])

        if sought:
            kind = bodies.schema["doc_id"].dataType.simpleString()
            part = bodies.where("doc_id IS NOT NULL AND body IS NOT NULL").select("doc_id", "body").mapInPandas(read, f"doc_id {kind}, text string")
            found = part if found is None else found.unionByName(part)
    return bodies.select("doc_id", F.col("body").alias("text")).limit(0) if found is None else found


def first_ranks(units: DataFrame, returned: DataFrame, body: str, text: str) -> DataFrame:
    """``query_id, unit_id, found_at``: the best rank whose body contains the unit's whole text, or null.

    The equal query id keeps this off a nested loop; containment is the residual test. Two bodies are never
    joined, so a text that spans them isn't found.
    """
    both = units.join(returned.select("query_id", "rank", F.col(body).alias("body__")), "query_id").where(F.col("body__").contains(F.col(text)))
    found = both.groupBy("query_id", "unit_id").agg(F.min("rank").alias("found_at"))
    return units.select("query_id", "unit_id").join(found, ["query_id", "unit_id"], "left")


def recall_at(ranks: DataFrame, prefixes: tuple[int, ...] = PREFIXES) -> DataFrame:
    """``query_id, k, gold, hit, any_hit, all_hit, macro`` of every query and prefix."""
    grid = ranks.withColumn("k", F.explode(F.array(*[F.lit(k) for k in prefixes])))
    inside = F.coalesce(F.col("found_at") <= F.col("k"), F.lit(False))
    counted = grid.groupBy("query_id", "k").agg(F.count(F.lit(1)).alias("gold"), F.count(F.when(inside, 1)).alias("hit"))
    return counted.select("query_id", "k", "gold", "hit", (F.col("hit") > 0).alias("any_hit"), (F.col("hit") == F.col("gold")).alias("all_hit"), (F.col("hit") / F.col("gold")).alias("macro"))


def over_requested(requested: DataFrame, graded: DataFrame, by: list[str], prefixes: tuple[int, ...] = PREFIXES) -> DataFrame:
    """Means over all requested queries, those without a grade counting as 0; one row per ``by`` and k."""
    grid = requested.select("query_id", *by).distinct().withColumn("k", F.explode(F.array(*[F.lit(k) for k in prefixes])))
    joined = grid.join(graded, ["query_id", "k"], "left")
    share = lambda c: F.round(F.sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0))) / F.count(F.lit(1)), 9)
    return joined.groupBy(*by, "k").agg(
        F.count(F.lit(1)).alias("requested"),
        F.count("gold").alias("graded"),
        share("any_hit").alias("recall_any"),
        share("all_hit").alias("recall_all"),
        share("macro").alias("recall_macro"),
    )


def spread(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, median, nearest-rank 95th percentile and maximum per group."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.median(value).alias("p50"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95"), F.max(value).alias("most"))


def paired(baseline: DataFrame, candidate: DataFrame, good: str) -> DataFrame:
    """``both, gains, losses, neither`` over queries graded on both sides."""
    a = baseline.select("query_id", F.col(good).alias("a"))
    joined = a.join(candidate.select("query_id", F.col(good).alias("b")), "query_id")
    n = lambda c: F.count(F.when(c, 1))
    return joined.agg(n(F.col("a") & F.col("b")).alias("both"), n(~F.col("a") & F.col("b")).alias("gains"), n(F.col("a") & ~F.col("b")).alias("losses"), n(~F.col("a") & ~F.col("b")).alias("neither"))


def fingerprint(df: DataFrame, by: list[str]) -> DataFrame:
    """Order-free content fingerprint per group: row count and the sum of 60-bit row digests.

    Rows are digested where they lie and sums are combined before the shuffle; nothing is collected or sorted.
    """
    digest = F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256), 1, 15), 16, 10)
    return df.select(*by, digest.cast("decimal(38,0)").alias("d")).groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.sum("d").cast("string").alias("digest"))


def differing(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of either side that the other lacks, with multiplicity; none where one is a permutation of the other."""
    left, right = a.select(*columns), b.select(*columns)
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


#: The tag before a final answer and the one that may close it (fixed values).
FINAL, FINAL_END = "<final_answer>", "</final_answer>"


def choice(text: Column) -> Column:
    """The chosen option a-d of an answer, or null.

    Without a final tag the whole answer is one letter, bare or in parentheses. With it the tag occurs exactly
    once, no closing tag stands before it, and only the letter and perhaps the closing tag follow.
    """
    one = r"(?U)\A\s*(?:\([a-dA-D]\)|[a-dA-D])\s*"
    letter = lambda c: F.lower(F.regexp_extract(c, "[a-dA-D]", 0))
    before, after = F.substring_index(text, FINAL, 1), F.substring_index(text, FINAL, -1)
    tags = (F.length(text) - F.length(F.replace(text, F.lit(FINAL), F.lit("")))) / len(FINAL)
    tagged = (tags == 1) & ~before.contains(FINAL_END) & after.rlike(one + r"(?:</final_answer>)?\s*\z")
    return F.when(tags == 0, F.when(text.rlike(one + r"\z"), letter(text))).when(tagged, letter(after))


def evidence_ids(values: Column) -> Column:
    """Sorted distinct ``D<session>:<turn>`` ids named by an array of texts, without leading zeros.

    Null where the array is null or a text is null, names no id, or holds more than ids, blanks, commas and semicolons.
    """
    whole = F.forall(values, lambda v: F.coalesce(v.rlike(r"D\d+:\d+") & (F.regexp_replace(F.regexp_replace(v, r"D\d+:\d+", ""), r"(?U)[\s,;]+", "") == ""), F.lit(False)))
    found = F.flatten(F.transform(values, lambda v: F.regexp_extract_all(v, F.lit(r"D\d+:\d+"), F.lit(0))))
    return F.when(whole, F.array_sort(F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"(?<=[D:])0+(?=\d)", "")))))


#: English names of the months (fixed values).
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def parse_date(text: Column) -> Column:
    """Milliseconds of a date in one of four written forms, taken as UTC; null where none fits.

    ``2023/05/08 (Mon) 13:56`` (any weekday's name), ``1:56 pm on 8 May, 2023``, the same without the comma, and with the
    comma and a month of three letters. Names of any case.
    """
    part = lambda pattern, i: F.regexp_extract(text, pattern, i).try_cast("int")
    slashed = r"(?i)\A(\d{4})/(\d{1,2})/(\d{1,2})\s+\((?:mon|tue|wed|thu|fri|sat|sun)\)\s+(\d{1,2}):(\d{1,2})\z"
    full, short = "|".join(MONTHS), "|".join(m[:3] for m in MONTHS)
    spoken = rf"(?i)\A(\d{{1,2}}):(\d{{1,2}})\s+([ap]m)\s+on\s+(\d{{1,2}})\s+(?:({full}),?|({short}),)\s+(\d{{4}})\z"
    name = F.lower(F.substring(F.concat(F.regexp_extract(text, spoken, 5), F.regexp_extract(text, spoken, 6)), 1, 3))
    month = F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), name).cast("int")
    hour = part(spoken, 1)
    hour = F.when(hour.between(1, 12), hour % 12 + F.when(F.lower(F.regexp_extract(text, spoken, 3)) == "pm", 12).otherwise(0))
    zero, utc = F.lit(0), F.lit("UTC")
    a = F.try_make_timestamp(part(slashed, 1), part(slashed, 2), part(slashed, 3), part(slashed, 4), part(slashed, 5), zero, utc)
    b = F.try_make_timestamp(part(spoken, 7), month, part(spoken, 4), hour, part(spoken, 2), zero, utc)
    return F.unix_millis(F.when(text.rlike(slashed), a).when(text.rlike(spoken), b))
