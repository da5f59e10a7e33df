"""Queries of the problems on training text, and SQL where it can express them on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import bpe, conversations, leakage, overlap, segments, splits, truncation
from threadloom.session import scratch_path
from threadloom.sources.tables import table

PROPORTIONS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = overlap.cross_split_pairs(table(spark, d, "histories"), table(spark, d, "messages"))
    return pairs.select(F.least("train_id", "other_id").alias("sample_id_a"), F.greatest("train_id", "other_id").alias("sample_id_b")).distinct()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(table(spark, d, "histories"), table(spark, d, "messages"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_conflicts(table(spark, d, "histories"))


def _split_in_batches(spark: SparkSession, d: str) -> DataFrame:
    """The stored component table after two batches, halves of the histories by a digest of the sample."""
    h = table(spark, d, "histories")
    stored = splits.ComponentTable(spark, scratch_path(spark, "split-table"))
    half = F.conv(F.substring(F.md5("sample_id"), 1, 4), 16, 10).cast("int") % 2
    stored.add(h.where(half == 0), PROPORTIONS, "first")
    return stored.add(h.where(half == 1), PROPORTIONS, "second")


def p2_assigned(spark: SparkSession, d: str) -> DataFrame:
    return splits.record_splits(splits.assign_splits(table(spark, d, "histories"), PROPORTIONS))


def p2_batches(spark: SparkSession, d: str) -> DataFrame:
    return splits.record_splits(_split_in_batches(spark, d))


def p2_audit(spark: SparkSession, d: str) -> DataFrame:
    """Of p2_assigned: samples, components, components in several splits, and whether each split has its share of records.

    A share is right where it is off by no more than the largest component and a hundredth of all.
    """
    r = p2_assigned(spark, d)
    parts = r.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("split").alias("splits"))
    whole = parts.agg(F.sum("n").alias("samples"), F.count(F.lit(1)).alias("components"), F.count(F.when(F.col("splits") != 1, 1)).alias("torn"), F.max("n").alias("largest"))
    shares = r.agg(*[F.count(F.when(F.col("split") == s, 1)).alias(s) for s in PROPORTIONS]).first()  # one row
    off = F.greatest(*[F.abs(F.lit(shares[s]) - share * F.col("samples")) for s, share in PROPORTIONS.items()])
    return whole.select("samples", "components", "torn", (off <= F.col("largest") + F.col("samples") / 100).alias("in_proportion"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.replay(spark, f"{d}/messages.parquet", contents=False).where("reason IS NOT NULL").select("user_id", "session_id")


def p4_conversations(spark: SparkSession, d: str) -> DataFrame:
    return conversations.replay(spark, f"{d}/messages.parquet").where("reason IS NULL").select("user_id", "session_id", "turns")


def p4_turns(spark: SparkSession, d: str) -> DataFrame:
    """The turns of each good conversation in order, contents by their digests."""
    good = conversations.replay(spark, f"{d}/messages.parquet").where("reason IS NULL")
    return good.select("user_id", "session_id", F.posexplode("turns").alias("place", "t")).select("user_id", "session_id", "place", "t.speaker", F.md5("t.content").alias("digest"))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Conversations by verdict, and how many of them went on after a silence that had closed them."""
    judged = conversations.replay(spark, f"{d}/messages.parquet", contents=False)
    return judged.groupBy((F.col("reason").isNotNull()).alias("dropped")).agg(F.count(F.lit(1)).alias("conversations"), F.count(F.when(F.col("parts") > 1, 1)).alias("reopened"))


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return segments.pieces(table(spark, d, "messages"), table(spark, d, "embedding_config"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_pieces(spark, d).where("piece = 0").select("config_id", "id")


def p5_coverage(spark: SparkSession, d: str) -> DataFrame:
    return segments.coverage(table(spark, d, "messages"), table(spark, d, "embedding_config"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_documents(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_texts(table(spark, d, "documents")).select("doc_id").distinct()


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_report(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_assigned, p2_batches, p2_audit, p4_found, p4_conversations, p4_turns, p4_report, p5_pieces, p5_found, p5_coverage, p6_ids, p7_found, p8_found, p8_report)}

_NOBODY = "(" + ", ".join(f"'{x}'" for x in splits.PLACEHOLDERS) + ")"


def _known(column: str) -> str:
    return f"CASE WHEN lower(regexp_replace({column}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')) NOT IN {_NOBODY} THEN {column} END"


def _listed(roles: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{r}'" for r in roles) + ")"


_ROLE = r"lower(regexp_replace(role, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'))"
_SIDE = f"CASE WHEN {_ROLE} IN {_listed(conversations.USER_SIDE)} THEN 'u' WHEN {_ROLE} IN {_listed(conversations.ASSISTANT_SIDE)} THEN 'a' WHEN {_ROLE} IN {_listed(conversations.OTHER_SIDE)} THEN 's' END"

_BAD = f"""WITH r AS (SELECT user_id, session_id, request_id, id, message_index AS place, sequence, source_timestamp_ms AS ts, content, {_SIDE} AS side,
  regexp_replace(coalesce(content, ''), '[\\s\\p{{Z}}\\p{{Cc}}\\p{{Cf}}]', '', 'g') = '' AS blank FROM messages),
f AS (SELECT *, min(ts) OVER q AS rts, min(sequence) OVER q AS rseq, count(*) OVER q AS rn, count(*) FILTER (ts IS NULL) OVER (PARTITION BY user_id, session_id) = 0 AS dated
  FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY user_id, session_id, id ORDER BY sequence) = 1) WINDOW q AS (PARTITION BY user_id, session_id, request_id)),
t AS (SELECT user_id, session_id, side, request_id, lead(side) OVER o AS next_side, lead(request_id) OVER o AS next_request FROM f WHERE NOT blank AND side IN ('u', 'a')
  WINDOW o AS (PARTITION BY user_id, session_id ORDER BY CASE WHEN dated THEN rts ELSE 0 END, rseq, request_id, place)),
bad AS (
  SELECT user_id, session_id FROM r GROUP BY user_id, session_id, id HAVING count(DISTINCT coalesce(side, '-') || coalesce('=' || content, '')) > 1
  UNION SELECT user_id, session_id FROM f GROUP BY user_id, session_id, request_id HAVING min(place) <> 0 OR max(place) <> count(*) - 1 OR count(DISTINCT place) <> count(*)
  UNION SELECT user_id, session_id FROM f WHERE side IS NULL
  UNION SELECT user_id, session_id FROM f GROUP BY user_id, session_id HAVING count(*) FILTER (side = 'u' AND NOT blank) = 0 OR count(*) FILTER (side = 'a' AND NOT blank) = 0
  UNION SELECT user_id, session_id FROM t WHERE side = 'u' AND NOT coalesce(next_side = 'a' OR next_request = request_id, false))"""

_LABELS = f"""WITH RECURSIVE edges AS (SELECT DISTINCT sample_id AS a, 'u' || {_known("user_id")} AS b FROM histories WHERE {_known("user_id")} IS NOT NULL
  UNION SELECT DISTINCT sample_id, 'c' || {_known("conversation_id")} FROM histories WHERE {_known("conversation_id")} IS NOT NULL),
star AS (SELECT a, min(a) OVER (PARTITION BY b) AS m FROM edges),
links AS (SELECT a, m FROM star WHERE a <> m UNION SELECT m, a FROM star WHERE a <> m),
reach AS (SELECT DISTINCT sample_id AS a, sample_id AS r FROM histories UNION SELECT links.a, reach.r FROM reach JOIN links ON links.m = reach.a),
labels AS (SELECT a AS sample_id, min(r) AS component FROM reach GROUP BY a)"""

ORACLES: dict[str, str] = {
    "p2_found": f"{_LABELS} SELECT sample_id FROM labels WHERE component IN (SELECT component FROM labels JOIN histories USING (sample_id) GROUP BY component HAVING count(DISTINCT original_split) > 1)",
    "p2_audit": f"{_LABELS} SELECT count(*) AS samples, count(DISTINCT component) AS components, 0::BIGINT AS torn, true AS in_proportion FROM labels",
    "p4_found": f"{_BAD} SELECT user_id, session_id FROM bad",
    "p4_turns": f"""{_BAD} SELECT f.user_id, f.session_id, CAST(row_number() OVER (PARTITION BY f.user_id, f.session_id ORDER BY CASE WHEN dated THEN rts ELSE 0 END, rseq, request_id, place) - 1 AS INT) AS place,
CASE side WHEN 'u' THEN 'user' ELSE 'assistant' END AS speaker, md5(content) AS digest FROM f ANTI JOIN bad ON bad.user_id IS NOT DISTINCT FROM f.user_id AND bad.session_id IS NOT DISTINCT FROM f.session_id WHERE NOT blank AND side IN ('u', 'a')""",
    "p4_report": f"""{_BAD}, g AS (SELECT user_id, session_id, ingested_at_ms - lag(ingested_at_ms) OVER (PARTITION BY user_id, session_id ORDER BY ingested_at_ms) AS silence FROM messages),
c AS (SELECT user_id, session_id, max(coalesce(silence, 0)) >= 172800000 AS reopened FROM g GROUP BY user_id, session_id)
SELECT bad.user_id IS NOT NULL AS dropped, count(*) AS conversations, count(CASE WHEN c.reopened THEN 1 END) AS reopened FROM c LEFT JOIN bad USING (user_id, session_id) GROUP BY ALL""",
    "p5_coverage": """
SELECT c.config_id, m.id, CAST(length(m.content) AS INT) AS covered, true AS within
FROM (SELECT id, content, doc_length FROM messages QUALIFY row_number() OVER (PARTITION BY id ORDER BY sequence) = 1) m
JOIN (SELECT DISTINCT * FROM embedding_config) c
  ON m.content IS NOT NULL AND (m.doc_length > c.segment_tokens OR strlen(c.document_prefix) + strlen(m.content) > c.http_segment_bytes)
""",
    "p5_found": """
SELECT c.config_id, m.id
FROM (SELECT id, content, doc_length FROM messages QUALIFY row_number() OVER (PARTITION BY id ORDER BY sequence) = 1) m
JOIN (SELECT DISTINCT * FROM embedding_config) c
  ON m.content IS NOT NULL AND (m.doc_length > c.segment_tokens OR strlen(c.document_prefix) + strlen(m.content) > c.http_segment_bytes)
""",
}
