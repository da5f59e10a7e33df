"""Queries on prepared histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions.text import PLACEHOLDERS
from threadloom.operators import attribution, prepare
from threadloom.plans.prelude import SQL_M, first_messages
from threadloom.plans.searching import _packed, _Store
from threadloom.sources.tables import table


def history_units(spark: SparkSession, d: str) -> DataFrame:
    m = first_messages(spark, d, ["session_id", "content"])
    return prepare.history_messages(table(spark, d, "histories"), m).select("sample_id", "session_id", "position", "id", "unique_text")


def history_prefix(spark: SparkSession, d: str) -> DataFrame:
    """The first half of each session, rounded down, as turns before a cut-off."""
    turns = prepare.history_messages(table(spark, d, "histories"), first_messages(spark, d, ["session_id", "content"]))
    ends = turns.groupBy("sample_id", "session_id").agg(F.floor(F.count(F.lit(1)) / 2).alias("end_index"))
    return prepare.before_cutoff(turns, ends, ["sample_id", "session_id"]).select("sample_id", "session_id", "position", "id")


def session_parts(spark: SparkSession, d: str) -> DataFrame:
    return prepare.session_parts(first_messages(spark, d, ["user_id", "session_id", "role"])).select("id", "part")


def occurrence_ids(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "messages").select("id", "sequence")
    n = F.row_number().over(Window.partitionBy("id").orderBy("sequence")) - 1
    return m.withColumn("n", n).select("id", "sequence", prepare.occurrence_id(F.col("id"), F.col("n")).alias("occurrence_id"))


def contaminated_histories(spark: SparkSession, d: str) -> DataFrame:
    known = lambda c: F.when(~F.lower(F.trim(c)).isin(*PLACEHOLDERS), F.col(c)).alias(c)
    h = table(spark, d, "histories").select("sample_id", "original_split", known("user_id"), known("conversation_id"))
    hits = prepare.contaminated(h.where("original_split <> 'dev'"), h.where("original_split = 'dev'"), ["user_id", "conversation_id"])
    return hits.select("sample_id").distinct()


def evidence_grounded(spark: SparkSession, d: str) -> DataFrame:
    s = _Store(spark, d)
    checked = attribution.grounded(s.stepwise("items", lambda p: p.evidence("reserved")), s.messages)
    return checked.groupBy("query_id").agg(F.count(F.lit(1)).alias("parts"), F.count(F.when(F.col("grounded"), 1)).alias("grounded"))


QUERIES = {f.__name__: f for f in (history_units, history_prefix, session_parts, occurrence_ids, contaminated_histories, evidence_grounded)}

_UNITS = f"""m AS ({SQL_M}), h AS (SELECT DISTINCT sample_id, unnest(session_ids) AS session_id FROM histories),
u AS (SELECT sample_id, session_id, id, row_number() OVER (PARTITION BY sample_id, session_id ORDER BY sequence, id) - 1 AS position, count(*) OVER (PARTITION BY sample_id, session_id) AS n,
count(*) OVER (PARTITION BY sample_id, session_id, trim(regexp_replace(coalesce(content, ''), '[\\s\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}\\p{{Z}}]+', ' ', 'g'), ' ')) = 1 AS unique_text FROM m JOIN h USING (session_id))"""


def _known(c: str) -> str:
    return f"CASE WHEN lower(trim({c}, ' ')) NOT IN ({', '.join(repr(x) for x in PLACEHOLDERS)}) THEN {c} END"


ORACLES = {
    "history_units": f"WITH {_UNITS} SELECT sample_id, session_id, position, id, unique_text FROM u",
    "history_prefix": f"WITH {_UNITS} SELECT sample_id, session_id, position, id FROM u WHERE position < n // 2",
    "session_parts": f"WITH m AS ({SQL_M}) SELECT id, CAST(sum(s) OVER (PARTITION BY user_id, session_id ORDER BY sequence, id) AS BIGINT) AS part FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY user_id, session_id ORDER BY sequence, id) = 1 OR lower(trim(role, ' ')) = 'system' THEN 1 ELSE 0 END AS s FROM m)",
    "occurrence_ids": "SELECT id, sequence, CASE WHEN n = 0 THEN id ELSE 'occ_' || sha256(id || chr(0) || n) END AS occurrence_id FROM (SELECT id, sequence, row_number() OVER (PARTITION BY id ORDER BY sequence) - 1 AS n FROM messages)",
    "evidence_grounded": f"WITH RECURSIVE {_packed('reserved')} SELECT query_id, CAST(sum(len(parts)) AS BIGINT) AS parts, CAST(sum(len(parts)) AS BIGINT) AS grounded FROM kept GROUP BY query_id",
    "contaminated_histories": f"""WITH h AS (SELECT sample_id, original_split, {_known("user_id")} AS u, {_known("conversation_id")} AS c FROM histories), dev AS (SELECT * FROM h WHERE original_split = 'dev')
SELECT DISTINCT sample_id FROM h WHERE original_split <> 'dev' AND (u IN (SELECT u FROM dev WHERE u IS NOT NULL) OR c IN (SELECT c FROM dev WHERE c IS NOT NULL))""",
}
