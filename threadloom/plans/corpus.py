"""Queries on preparing evaluation corpora and on the table of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.operators import components, grading, prepare, vectors
from threadloom.operators.ranks import top, within_budget
from threadloom.operators.store import blank
from threadloom.plans.evaluation import identity_components
from threadloom.plans.prelude import SQL_M, first_messages
from threadloom.plans.store import _blank
from threadloom.session import settle, write_table
from threadloom.sources.tables import table


def _gold(spark: SparkSession, d: str) -> DataFrame:
    """``text, places``: in how many documents each gold text stands."""
    found = grading.containing(table(spark, d, "documents").select("doc_id", F.col("text").alias("body")), table(spark, d, "eval_items").select(F.col("gold_text").alias("text")))
    return write_table(found, "gold")


def prepared_questions(spark: SparkSession, d: str) -> DataFrame:
    """Each question with the reason why it is left out, or ``kept``, and the number of places of its evidence."""
    places = _gold(spark, d).groupBy("text").agg(F.count(F.lit(1)).alias("places"))
    items = table(spark, d, "eval_items").join(places.withColumnRenamed("text", "gold_text"), "gold_text", "left")
    reason = F.when(blank(F.col("question")), "blank question").when(F.col("query_id").endswith("_abs"), "abstention").when(blank(F.col("gold_text")), "no evidence").when(F.col("places").isNull(), "unresolved evidence").when(F.col("places") > 1, "evidence in several places").otherwise("kept")
    return items.select("query_id", "dataset", "original_split", reason.alias("reason"), F.coalesce("places", F.lit(0)).alias("places"))


def prepared_counts(spark: SparkSession, d: str) -> DataFrame:
    return prepared_questions(spark, d).groupBy("dataset", "original_split", "reason").agg(F.count(F.lit(1)).alias("questions"))


def question_groups(spark: SparkSession, d: str) -> DataFrame:
    """Questions whose evidence stands in one document, or is the same text, are one group, named by its smallest question."""
    items = table(spark, d, "eval_items").where("query_id IS NOT NULL").select("query_id", "gold_text")
    by_document = items.join(_gold(spark, d).withColumnRenamed("text", "gold_text"), "gold_text").select(F.concat(F.lit("q:"), "query_id").alias("a"), F.concat(F.lit("r:"), F.col("doc_id").cast("string")).alias("b"))
    by_text = items.where("length(gold_text) > 0").select(F.concat(F.lit("q:"), "query_id").alias("a"), F.concat(F.lit("s:"), F.md5("gold_text")).alias("b"))
    roots = components.merge_roots(by_document.unionByName(by_text).distinct())
    nodes = items.select(F.concat(F.lit("q:"), "query_id").alias("node"), "query_id").distinct()
    if roots is None:
        return nodes.select("query_id", F.col("query_id").alias("group"))
    return nodes.join(roots, "node", "left").select("query_id", F.substring(F.coalesce("root", "node"), 3, 2**31 - 3).alias("group"))


def told_messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages with a date line and a speaker, system messages as quoted notes."""
    m = first_messages(spark, d, ["user_id", "role", "content", "ingested_at_ms"]).where("content IS NOT NULL")
    safe = m.withColumn("safe", prepare.without_system(F.lower(F.trim("role")), F.col("content")))
    date = F.date_format(F.timestamp_millis("ingested_at_ms"), "yyyy/MM/dd HH:mm")
    return safe.select("id", F.col("safe.role").alias("role"), F.md5(prepare.told(F.col("safe.content"), date, F.col("user_id"))).alias("digest"))


def session_migration(spark: SparkSession, d: str) -> DataFrame:
    """Labels on every fiftieth message moved to the one row of its request that has the same place and content."""
    m = table(spark, d, "messages").where("content IS NOT NULL").select("request_id", "id", "sequence", "message_index", "content")
    occurrences = m.select(F.col("request_id").alias("session_id"), F.concat_ws("#", "id", F.col("sequence").cast("string")).alias("occurrence_id"), F.col("message_index").alias("position"), "content")
    drawn = F.conv(F.substring(F.md5("id"), 1, 4), 16, 10).cast("int") % 50 == 0
    labels = first_messages(spark, d, ["request_id", "message_index", "content"]).where(drawn & F.col("content").isNotNull()).select(F.col("id").alias("label_id"), F.col("request_id").alias("session_id"), F.col("message_index").alias("position"), "content")
    return prepare.migrated(labels, occurrences)


def first_groups(spark: SparkSession, d: str) -> DataFrame:
    """The first two conversations of each store, by arrival, whose requests are whole."""
    m = first_messages(spark, d, ["store_id", "user_id", "session_id", "request_id", "message_index"]).where("user_id IS NOT NULL AND session_id IS NOT NULL")
    requests = m.groupBy("store_id", "user_id", "session_id", "request_id").agg(F.count_distinct("message_index").alias("places"), F.count(F.lit(1)).alias("n"), F.max("message_index").alias("last"), F.min("sequence").alias("first"))
    whole = (F.col("places") == F.col("n")) & (F.col("last") == F.col("n") - 1)
    sessions = requests.groupBy("store_id", "user_id", "session_id").agg(F.min(F.coalesce(whole, F.lit(False))).alias("whole"), F.min("first").alias("first"))
    return top(sessions.where("whole"), ["store_id"], [F.asc("first")], 2, "place").select("store_id", "user_id", "session_id", "place")


def query_sample(spark: SparkSession, d: str) -> DataFrame:
    """A fixed sample of the questions of each dataset: the first twenty by digest, whatever order they came in."""
    items = table(spark, d, "eval_items").select("dataset", "query_id").distinct()
    return top(items, ["dataset"], [F.sha2("query_id", 256).asc()], 20, "place")


def two_limit_prefix(spark: SparkSession, d: str) -> DataFrame:
    """The first messages of each session that fit 2000 characters and 300 project tokens at once."""
    m = first_messages(spark, d, ["user_id", "session_id", "content", "doc_length"]).where("doc_length IS NOT NULL")
    placed = m.withColumn("place", F.row_number().over(Window.partitionBy("user_id", "session_id").orderBy("sequence", "id")))
    characters = within_budget(placed, ["user_id", "session_id"], "place", F.length(F.coalesce("content", F.lit(""))), 2000)
    return within_budget(characters, ["user_id", "session_id"], "place", F.col("doc_length"), 300).select("id", "place")


def membership(spark: SparkSession, d: str) -> DataFrame:
    """Whether each sample lies in exactly one component, and components keep their samples."""
    labels = settle(identity_components(spark, d))
    asked = table(spark, d, "histories").where("sample_id IS NOT NULL").select("sample_id").distinct()
    held = labels.groupBy("sample_id").agg(F.count_distinct("component").alias("n"))
    return asked.join(held, "sample_id", "full").agg(F.count(F.lit(1)).alias("samples"), F.count(F.when(F.col("n") > 1, 1)).alias("in_several"), F.count(F.when(F.col("n").isNull(), 1)).alias("in_none"))


def vector_audit(spark: SparkSession, d: str) -> DataFrame:
    """Per label: vectors, those that a stored copy doesn't give back, and how far lengths are off 1, of all and of the first 16."""
    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding", vectors.decoded(vectors.encoded("embedding")).alias("back"))
    off = F.abs(vectors.norm(F.col("embedding")) - 1)
    ranked = e.select("label", off.alias("off"), F.coalesce(vectors.equivalent(F.col("embedding"), F.col("back")), F.lit(False)).alias("same"), F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).alias("place"))
    return ranked.groupBy("label").agg(F.count(F.lit(1)).alias("vectors"), F.count(F.when(~F.col("same"), 1)).alias("lost"), F.round(F.max("off"), 6).alias("most_off"), F.round(F.max(F.when(F.col("place") <= 16, F.col("off"))), 6).alias("first_off"))


def vector_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Documents without a vector and vectors without a document, by language or label."""
    documents, e = table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    lacking = documents.join(e, "doc_id", "left_anti").groupBy(F.coalesce("lang", F.lit("")).alias("key")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("missing"))
    orphans = e.join(documents, "doc_id", "left_anti").groupBy(F.coalesce(F.col("label").cast("string"), F.lit("")).alias("key")).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("orphan"))
    return lacking.unionByName(orphans)


def config_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Digest of each embedding configuration's settings in the order of their names; equal settings have one fingerprint."""
    c = table(spark, d, "embedding_config")
    names = sorted(x for x in c.columns if x != "config_id")
    settings = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    return c.select("config_id", F.sha2(settings, 256).alias("fingerprint"))


QUERIES = {f.__name__: f for f in (prepared_questions, prepared_counts, question_groups, told_messages, session_migration, first_groups, query_sample, two_limit_prefix, membership, vector_audit, vector_coverage, config_fingerprints)}

_GOLD = "g AS (SELECT DISTINCT i.gold_text, d.doc_id FROM documents d JOIN (SELECT DISTINCT gold_text FROM eval_items WHERE length(gold_text) > 0) i ON contains(d.text, i.gold_text))"
_PREPARED = f"""{_GOLD}, p AS (SELECT gold_text, count(*) AS places FROM (SELECT i.gold_text FROM documents d JOIN (SELECT DISTINCT gold_text FROM eval_items WHERE length(gold_text) > 0) i ON contains(d.text, i.gold_text)) GROUP BY gold_text),
k AS (SELECT query_id, dataset, original_split, CASE WHEN {_blank("question")} THEN 'blank question' WHEN ends_with(query_id, '_abs') THEN 'abstention' WHEN {_blank("gold_text")} THEN 'no evidence' WHEN places IS NULL THEN 'unresolved evidence'
  WHEN places > 1 THEN 'evidence in several places' ELSE 'kept' END AS reason, coalesce(places, 0) AS places FROM eval_items LEFT JOIN p USING (gold_text))"""
_NORM = "sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE)))"

ORACLES = {
    "prepared_questions": f"WITH {_PREPARED} SELECT * FROM k",
    "prepared_counts": f"WITH {_PREPARED} SELECT dataset, original_split, reason, count(*) AS questions FROM k GROUP BY ALL",
    "question_groups": f"""WITH RECURSIVE {_GOLD}, edges AS (SELECT query_id AS a, 'r:' || doc_id AS b FROM eval_items JOIN g USING (gold_text) UNION SELECT query_id, 's:' || md5(gold_text) FROM eval_items WHERE length(gold_text) > 0),
star AS (SELECT a, min(a) OVER (PARTITION BY b) AS m FROM edges), links AS (SELECT DISTINCT a, m FROM star WHERE a <> m UNION SELECT DISTINCT m, a FROM star WHERE a <> m),
reach AS (SELECT DISTINCT query_id AS a, query_id AS r FROM eval_items UNION SELECT l.a, reach.r FROM reach JOIN links l ON l.m = reach.a) SELECT a AS query_id, min(r) AS "group" FROM reach GROUP BY a""",
    "told_messages": f"""WITH m AS ({SQL_M}), s AS (SELECT *, lower(trim(role, ' ')) AS r FROM m WHERE content IS NOT NULL)
SELECT id, CASE WHEN r = 'system' THEN 'user' ELSE r END AS role, md5('[session_date: ' || strftime(make_timestamp(ingested_at_ms * 1000), '%Y/%m/%d %H:%M') || ']' || chr(10) || CASE WHEN length(trim(coalesce(user_id, ''), ' ')) > 0 THEN user_id || ': ' ELSE '' END
|| CASE WHEN r = 'system' THEN '[historical system note]' || chr(10) ELSE '' END || content) AS digest FROM s""",
    "session_migration": f"""WITH m AS ({SQL_M}), l AS (SELECT * FROM m WHERE content IS NOT NULL AND CAST('0x' || substr(md5(id), 1, 4) AS INT) % 50 = 0)
SELECT l.id AS label_id, count(o.id) AS matches, CASE WHEN count(o.id) = 1 THEN min(o.id || '#' || o.sequence) END AS occurrence_id FROM l LEFT JOIN messages o ON o.request_id = l.request_id AND o.message_index = l.message_index AND o.content = l.content GROUP BY l.id""",
    "first_groups": f"""WITH m AS ({SQL_M}), r AS (SELECT store_id, user_id, session_id, request_id, count(DISTINCT message_index) = count(*) AND max(message_index) = count(*) - 1 AS whole, min(sequence) AS first FROM m WHERE user_id IS NOT NULL AND session_id IS NOT NULL GROUP BY ALL),
s AS (SELECT store_id, user_id, session_id, min(first) AS first FROM r GROUP BY ALL HAVING bool_and(coalesce(whole, false))) SELECT store_id, user_id, session_id, row_number() OVER (PARTITION BY store_id ORDER BY first) AS place FROM s QUALIFY place <= 2""",
    "query_sample": "SELECT dataset, query_id, row_number() OVER (PARTITION BY dataset ORDER BY sha256(query_id)) AS place FROM (SELECT DISTINCT dataset, query_id FROM eval_items) QUALIFY place <= 20",
    "two_limit_prefix": f"""WITH m AS ({SQL_M}), o AS (SELECT id, row_number() OVER w AS place, sum(greatest(length(coalesce(content, '')), 1)) OVER w AS characters, sum(greatest(doc_length, 1)) OVER w AS tokens FROM m WHERE doc_length IS NOT NULL
WINDOW w AS (PARTITION BY user_id, session_id ORDER BY sequence, id ROWS UNBOUNDED PRECEDING)) SELECT id, place FROM o WHERE characters <= 2000 AND tokens <= 300""",
    "membership": "SELECT count(DISTINCT sample_id) AS samples, 0::BIGINT AS in_several, 0::BIGINT AS in_none FROM histories",
    "vector_audit": f"""WITH v AS (SELECT label, abs({_NORM} - 1) AS off, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS place FROM embeddings)
SELECT label, count(*) AS vectors, count(CASE WHEN off > 1e-3 THEN 1 END) AS lost, round(max(off), 6) AS most_off, round(max(CASE WHEN place <= 16 THEN off END), 6) AS first_off FROM v GROUP BY label""",
    "vector_coverage": """SELECT coalesce(lang, '') AS key, count(*) AS n, 'missing' AS kind FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) GROUP BY ALL
UNION ALL SELECT coalesce(CAST(label AS VARCHAR), ''), count(*), 'orphan' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents) GROUP BY ALL""",
    "config_fingerprints": """SELECT config_id, sha256('{"document_prefix":' || coalesce(to_json(document_prefix)::VARCHAR, 'null') || ',"http_segment_bytes":' || coalesce(http_segment_bytes::VARCHAR, 'null') || ',"overlap_tokens":' || coalesce(overlap_tokens::VARCHAR, 'null')
|| ',"provider":' || coalesce(to_json(provider)::VARCHAR, 'null') || ',"segment_tokens":' || coalesce(segment_tokens::VARCHAR, 'null') || '}') AS fingerprint FROM embedding_config""",
}
