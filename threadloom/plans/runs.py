"""Queries on retrieval runs over the stored messages: known messages are sought again and graded by source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions.text import squeezed
from threadloom.operators import runs, store
from threadloom.operators.memory import Memory
from threadloom.plans.prelude import SQL_QUERIES
from threadloom.plans.searching import _STORE, _lexical, _semantic, _weighted, memory_of
from threadloom.session import put_table
from threadloom.sources.tables import table

#: Items and characters at which runs are graded; 0 is no budget.
PREFIXES, BUDGETS, TOP = (1, 5, 20), (0, 2000), 20


class _Known:
    """Every fiftieth message, by a digest of its id, is sought by its own text; it and the message after it are the gold."""

    def __init__(self, spark: SparkSession, d: str):
        self.memory = memory_of(spark, d)
        after = F.lead(F.struct("id", "content")).over(Window.partitionBy("user_id", "session_id").orderBy("sequence", "id"))
        drawn = F.conv(F.substring(F.md5("id"), 1, 4), 16, 10).cast("int") % 50 == 0
        picked = lambda messages: messages.select("user_id", "session_id", "id", "content", after.alias("after")).where(drawn & ~store.blank(F.col("content")) & F.col("user_id").isNotNull())
        self.known = self.memory.stepwise("known", lambda part, _: picked(part.read("messages")))
        self.requests = self.known.select(F.col("id").alias("query_id"), "user_id", F.col("content").alias("query"), F.array().cast("array<string>").alias("options"))
        gold = F.array(F.struct(F.lit("own").alias("unit_id"), F.col("id").alias("id"), F.col("content").alias("text")), F.struct(F.lit("next").alias("unit_id"), F.col("after.id").alias("id"), F.col("after.content").alias("text")))
        self.units = self.known.select(F.col("id").alias("query_id"), "user_id", "session_id", F.explode(gold).alias("u")).select("query_id", "user_id", "session_id", "u.*").where("id IS NOT NULL")

    def _frequency(self, units: DataFrame, messages: DataFrame) -> DataFrame:
        """In how many messages of its user a unit's text stands, apart from white space."""
        digest = lambda c: F.md5(squeezed(F.coalesce(c, F.lit(""))))
        wanted = units.select("query_id", "unit_id", "user_id", digest(F.col("text")).alias("digest"))
        held = messages.select("user_id", digest(F.col("content")).alias("digest")).join(wanted.select("user_id", "digest").distinct(), ["user_id", "digest"], "left_semi")
        return wanted.join(held.groupBy("user_id", "digest").agg(F.count(F.lit(1)).alias("times")), ["user_id", "digest"], "left").select("query_id", "unit_id", "times")

    def _graded(self, ranked: Callable[[Memory], DataFrame]) -> tuple[DataFrame, DataFrame]:
        """Grades and limits of the lists that ``ranked`` gives for a part of the store; a query and its gold lie in one part."""

        def of_part(part: Memory, aside: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
            messages, units = part.read("messages"), part.own(self.units)
            found = aside(ranked(part).select("query_id", "user_id", "id", "score", "rank"), "ranked")
            returned = aside(found.join(messages.select("user_id", "id", "session_id", F.col("content").alias("body")), ["user_id", "id"]), "returned")
            cut = aside(runs.limits(returned, PREFIXES, BUDGETS), "cut")
            ranks = aside(runs.unit_ranks(units, returned, aside(self._frequency(units, messages), "frequency")), "ranks")
            return cut.join(runs.graded(ranks, cut), ["query_id", "k", "budget"], "left")

        both = self.memory.stepwise("graded", of_part)
        limits = ["cutoff", "items", "characters"]
        return both.where("gold IS NOT NULL").drop(*limits), both.select("query_id", "k", "budget", *limits)

    def lexical(self) -> tuple[DataFrame, DataFrame]:
        weighted = put_table(self.memory.weighted(self.requests), "weighted")
        return self._graded(lambda part: part.lexical(self.requests, TOP, weighted))

    def semantic(self) -> tuple[DataFrame, DataFrame]:
        return self._graded(lambda part: part.semantic(self.requests, TOP))


def retrieval_run(spark: SparkSession, d: str) -> DataFrame:
    return _Known(spark, d).lexical()[0].withColumn("macro", F.round("macro", 9))


def retrieval_summary(spark: SparkSession, d: str) -> DataFrame:
    known = _Known(spark, d)
    return runs.summary(known.requests, *known.lexical(), [])


def retrieval_compare(spark: SparkSession, d: str) -> DataFrame:
    known = _Known(spark, d)
    return runs.compared(known.lexical()[0], known.semantic()[0], "all_hit")


def run_contract(spark: SparkSession, d: str) -> DataFrame:
    """What a run breaks that takes each session's delivered rows as they are: one list per session, in order of arrival."""
    m = table(spark, d, "messages").where("session_id IS NOT NULL").select(F.col("session_id").alias("query_id"), "id", "content", F.when(F.col("source_timestamp_ms").isNotNull(), 1.0).alias("score"))
    asked = table(spark, d, "histories").select(F.explode("session_ids").alias("query_id"))
    return runs.violations(m, asked, 50, store.blank(F.col("content")))


def gold_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Of each history: its sessions, those that have messages, those that lack them, and whether the sets are equal."""
    asked = table(spark, d, "histories").select("sample_id", F.explode("session_ids").alias("session_id")).where("session_id IS NOT NULL").distinct()
    held = table(spark, d, "messages").select("session_id").distinct().withColumn("held", F.lit(True))
    each = asked.join(held, "session_id", "left").groupBy("sample_id").agg(F.collect_set("session_id").alias("gold"), F.collect_set(F.when(F.col("held"), F.col("session_id"))).alias("found"))
    return each.select("sample_id", F.size("gold").alias("gold"), F.size(F.array_intersect("gold", "found")).alias("found"), F.array_join(F.array_sort(F.array_except("gold", "found")), "|").alias("missing"), (F.array_sort("gold") == F.array_sort("found")).alias("equal"))


QUERIES = {f.__name__: f for f in (retrieval_run, retrieval_summary, retrieval_compare, run_contract, gold_sessions)}

_SPACES = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"
_SQUEEZE = lambda c: f"trim(regexp_replace(coalesce({c}, ''), '{_SPACES}+', ' ', 'g'), ' ')"
_ASKED = f"SELECT id AS query_id, user_id, content AS query, []::VARCHAR[] AS options FROM m WHERE CAST('0x' || substr(md5(id), 1, 4) AS INT) % 50 = 0 AND regexp_replace(coalesce(content, ''), '{_SPACES}', '', 'g') <> '' AND user_id IS NOT NULL"
_KNOWN = f"""{_STORE.replace(SQL_QUERIES, _ASKED)}, nx AS (SELECT *, lead(id) OVER w AS next_id, lead(content) OVER w AS next_text FROM m WINDOW w AS (PARTITION BY user_id, session_id ORDER BY sequence, id)),
units AS (SELECT query_id, nx.user_id, session_id, 'own' AS unit_id, id, content AS text FROM q JOIN nx ON nx.id = query_id UNION ALL SELECT query_id, nx.user_id, session_id, 'next', next_id, next_text FROM q JOIN nx ON nx.id = query_id WHERE next_id IS NOT NULL),
held AS (SELECT user_id, md5({_SQUEEZE("content")}) AS digest, count(*) AS times FROM m GROUP BY ALL),
u AS (SELECT units.*, times, {_SQUEEZE("text")} AS bare FROM units LEFT JOIN held ON held.user_id = units.user_id AND held.digest = md5({_SQUEEZE("text")}))"""


def _graded_sql(run: str) -> str:
    """CTEs ``<run>_cut`` and ``<run>_graded`` of a ranked list."""
    return f"""{run}_ret AS (SELECT query_id, rank, r.id, session_id, {_SQUEEZE("content")} AS bare, sum(length(coalesce(content, ''))) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM {run} r JOIN m USING (user_id, id)),
{run}_cut AS (SELECT query_id, k, budget, coalesce(max(CASE WHEN ok THEN rank END), 0) AS cutoff, count(CASE WHEN ok THEN 1 END) AS items, coalesce(max(CASE WHEN ok THEN used END), 0) AS characters
  FROM (SELECT *, rank <= k AND (budget = 0 OR used <= budget) AS ok FROM {run}_ret, (SELECT unnest({list(PREFIXES)}) AS k), (SELECT unnest({list(BUDGETS)}) AS budget)) GROUP BY ALL),
{run}_at AS (SELECT u.query_id, u.unit_id, u.session_id, u.times, min(CASE WHEN r.id = u.id THEN rank END) AS source_at, min(CASE WHEN u.times = 1 AND contains(r.bare, u.bare) THEN rank END) AS text_at FROM u LEFT JOIN {run}_ret r USING (query_id) GROUP BY ALL),
{run}_graded AS (SELECT query_id, k, budget, count(*) AS gold, count(CASE WHEN source_at <= cutoff OR text_at <= cutoff THEN 1 END) AS hit, count(CASE WHEN source_at <= cutoff THEN 1 END) AS verified,
  count(CASE WHEN NOT coalesce(source_at <= cutoff, false) AND coalesce(times <> 1, true) THEN 1 END) AS ambiguous, count(DISTINCT session_id) AS gold_sessions, count(DISTINCT CASE WHEN source_at <= cutoff THEN session_id END) AS hit_sessions FROM {run}_at JOIN {run}_cut USING (query_id) GROUP BY ALL)"""


_LEXICAL_RUN = f"WITH {_KNOWN}, {_weighted(False)}, {_lexical(TOP)}, {_graded_sql('lexical')}"

ORACLES = {
    "retrieval_run": f"{_LEXICAL_RUN} SELECT *, hit > 0 AS any_hit, hit = gold AS all_hit, round(hit / gold, 9) AS macro FROM lexical_graded",
    "retrieval_summary": f"""{_LEXICAL_RUN} SELECT k, budget, count(*) AS requested, count(gold) AS graded, round(sum(coalesce((hit > 0)::INT, 0)) / count(*), 9) AS recall_any, round(sum(coalesce((hit = gold)::INT, 0)) / count(*), 9) AS recall_all,
round(sum(coalesce(hit / gold, 0)) / count(*), 9) AS recall_macro, CAST(sum(coalesce(ambiguous, 0)) AS BIGINT) AS ambiguous, round(sum(coalesce(characters, 0)) / count(*), 9) AS mean_characters
FROM q JOIN (SELECT DISTINCT k, budget FROM lexical_cut) ON true LEFT JOIN lexical_graded USING (query_id, k, budget) LEFT JOIN lexical_cut USING (query_id, k, budget) GROUP BY k, budget""",
    "retrieval_compare": f"""WITH {_KNOWN}, {_weighted(False)}, {_lexical(TOP)}, {_semantic(TOP).replace("query || chr(10) || options[1]", "query")}, {_graded_sql("lexical")}, {_graded_sql("semantic")}
SELECT k, budget, count(CASE WHEN a AND b THEN 1 END) AS both, count(CASE WHEN NOT a AND b THEN 1 END) AS gains, count(CASE WHEN a AND NOT b THEN 1 END) AS losses, count(CASE WHEN NOT a AND NOT b THEN 1 END) AS neither, count(CASE WHEN a IS NULL OR b IS NULL THEN 1 END) AS one_sided
FROM (SELECT query_id, k, budget, l.hit = l.gold AS a, s.hit = s.gold AS b FROM lexical_graded l FULL JOIN semantic_graded s USING (query_id, k, budget)) GROUP BY k, budget""",
    "run_contract": f"""WITH c AS (SELECT session_id AS query_id, greatest(count(*) - 50, 0) AS too_many, count(id) - count(DISTINCT id) AS repeated_id, count(CASE WHEN id IS NULL OR trim(id, ' ') = '' THEN 1 END) AS blank_id,
count(CASE WHEN regexp_replace(coalesce(content, ''), '{_SPACES}', '', 'g') = '' THEN 1 END) AS blank_content, count(CASE WHEN source_timestamp_ms IS NULL THEN 1 END) AS no_score, count(CASE WHEN session_id NOT IN (SELECT s FROM (SELECT unnest(session_ids) AS s FROM histories) WHERE s IS NOT NULL) THEN 1 END) AS not_asked
FROM messages WHERE session_id IS NOT NULL GROUP BY session_id) SELECT query_id, violation, n FROM (UNPIVOT c ON too_many, repeated_id, blank_id, blank_content, no_score, not_asked INTO NAME violation VALUE n) WHERE n > 0""",
    "gold_sessions": """WITH a AS (SELECT DISTINCT sample_id, unnest(session_ids) AS s FROM histories), h AS (SELECT sample_id, s, s IN (SELECT session_id FROM messages WHERE session_id IS NOT NULL) AS held FROM a WHERE s IS NOT NULL)
SELECT sample_id, CAST(count(*) AS INT) AS gold, CAST(count(CASE WHEN held THEN 1 END) AS INT) AS found, coalesce(string_agg(CASE WHEN NOT held THEN s END, '|' ORDER BY s), '') AS missing, bool_and(held) AS equal FROM h GROUP BY sample_id""",
}
