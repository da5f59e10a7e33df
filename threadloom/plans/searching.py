"""Queries on search: term weights, BM25, cosine, fusion, fetch, neighbours, evidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import context, search, vectors
from threadloom.operators.memory import Memory
from threadloom.operators.ranks import within_budget
from threadloom.plans.prelude import SQL_M, SQL_POSTED, SQL_QUERIES, SQL_STOP, SQL_USERS, first_messages, search_requests, sql_tokens
from threadloom.session import put_table, scratch_path
from threadloom.sources.tables import table

TOP = 20


#: Stores that this session has built, by what they were built from.
_BUILT: dict[tuple, str] = {}


def memory_of(spark: SparkSession, d: str) -> Memory:
    """The stored memory of a folder's messages, in the shared folder; built once, then every search reads it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/messages.parquet")
    status = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at)
    key = (spark.sparkContext.applicationId, d, status.getModificationTime(), status.getLen())
    if key not in _BUILT:
        memory = Memory(spark, scratch_path(spark, "memory"))
        memory.load(first_messages(spark, d, ["user_id", "session_id", "request_id", "message_index", "role", "content", "source_timestamp_ms"]))
        _BUILT[key] = memory.path
    return Memory(spark, _BUILT[key])


class _Store:
    """A folder's stored messages and the searches that are put to them."""

    def __init__(self, spark: SparkSession, d: str):
        self.memory = memory_of(spark, d)
        self.messages = self.memory.read("messages").drop("bucket")
        self.requests = put_table(search_requests(spark, d, self.messages), "requests")

    def weighted(self) -> DataFrame:
        return self.memory.weighted(self.requests)

    def stepwise(self, what: str, make: Callable[[_Part], DataFrame], options: bool = True) -> DataFrame:
        """The rows that ``make`` gives for each part of the store, written one part after another; terms are weighed before."""
        asked = self.requests if options else self.requests.withColumn("options", F.array().cast("array<string>"))
        weighted = put_table(self.memory.weighted(asked), "weighted")
        return self.memory.stepwise(what, lambda part, aside: make(_Part(part, asked, weighted, aside)))


class _Part:
    """A part of the store, and the searches that are put to it."""

    def __init__(self, memory: Memory, requests: DataFrame, weighted: DataFrame, aside: Callable[[DataFrame, str], DataFrame]):
        self.memory, self.requests, self.weighted, self.aside = memory, requests, weighted, aside
        self.messages = memory.read("messages").drop("bucket")

    def lexical(self, most: int | None = None) -> DataFrame:
        return self.memory.lexical(self.requests, most or search.candidates_for(TOP), self.weighted)

    def semantic(self, most: int | None = None) -> DataFrame:
        """Cosine over stand-in vectors."""
        return self.memory.semantic(self.requests, most or search.candidates_for(TOP))

    def fused(self, weight: float) -> DataFrame:
        return search.fuse(self.aside(self.lexical(), "lexical"), self.aside(self.semantic(), "semantic"), weight, TOP)

    def fetched(self, messages: DataFrame) -> DataFrame:
        """The best by BM25 with their rows of ``messages``."""
        return search.fetch(self.aside(self.lexical(TOP), "lexical"), messages)

    def evidence(self, grouping: str) -> DataFrame:
        return context.evidence_items(self.fused(1.0), self.messages, grouping=grouping, aside=self.aside)


def query_term_weights(spark: SparkSession, d: str) -> DataFrame:
    return _Store(spark, d).weighted().select("query_id", "user_id", "term", "weight", F.round("idf", 9).alias("idf"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _Store(spark, d).stepwise("ranked", lambda p: p.lexical(TOP).select("query_id", "id", "score", "rank"), options=False)


def bm25_options(spark: SparkSession, d: str) -> DataFrame:
    return _Store(spark, d).stepwise("ranked", lambda p: p.lexical(TOP).select("query_id", "id", "score", "rank"))


def hashed_topk(spark: SparkSession, d: str) -> DataFrame:
    s = _Store(spark, d)
    return s.memory.stepwise("ranked", lambda part, _: part.semantic(s.requests, TOP).select("query_id", "id", "score", "rank"))


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return _Store(spark, d).stepwise("fused", lambda p: p.fused(1.0).select("query_id", "id", "score", "rank"))


def rrf_weighted_half(spark: SparkSession, d: str) -> DataFrame:
    return _Store(spark, d).stepwise("fused", lambda p: p.fused(0.5).select("query_id", "id", "score", "rank"))


def scoped_fetch(spark: SparkSession, d: str) -> DataFrame:
    return _Store(spark, d).stepwise("fetched", lambda p: p.fetched(p.messages.drop("sequence")).select("query_id", "rank", "id", "session_id", "role", "content"))


def evidence_pack_reserved(spark: SparkSession, d: str) -> DataFrame:
    return _Store(spark, d).stepwise("items", lambda p: p.evidence("reserved"))


def evidence_pack_emitted(spark: SparkSession, d: str) -> DataFrame:
    return _Store(spark, d).stepwise("items", lambda p: p.evidence("emitted"))


def char_budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    size = F.length(F.coalesce("content", F.lit(""))).alias("size")
    cut = lambda rows: within_budget(rows, ["query_id"], "rank", F.col("size"), 2000).select("query_id", "rank", "id")
    return _Store(spark, d).stepwise("fetched", lambda p: cut(p.fetched(p.messages.select("user_id", "id", size))))


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    message = F.floor(F.col("vec_id") / 2).cast("string")
    segments = e.select(F.col("label").alias("user_id"), message.alias("id"), F.col("embedding").alias("vector"))
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("user_id"), F.col("embedding").alias("vector"))
    return search.cosine_in_blocks(asked, segments, TOP).select("query_id", "id", "score", "rank")


def segment_mean(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("message"), F.col("embedding").alias("vector"))
    return vectors.mean_unit(e, ["message"]).select("message", "pos", F.round("value", 9).alias("value"))


def neighbours_radius1(spark: SparkSession, d: str) -> DataFrame:
    m = first_messages(spark, d, ["user_id", "session_id", "source_timestamp_ms"])
    return context.neighbours(m, 1).select("id", F.get("before", F.lit(0)).alias("before"), F.get("after", F.lit(0)).alias("after"), "by_time")


def evidence_render(spark: SparkSession, d: str) -> DataFrame:
    m = first_messages(spark, d)
    return m.select("id", context.evidence().alias("evidence"))


def token_intervals(spark: SparkSession, d: str) -> DataFrame:
    m = first_messages(spark, d, ["doc_length"])
    return m.select("id", F.explode(context.token_intervals(F.col("doc_length"), 128, 32)).alias("w")).select("id", "w.start", "w.end")


QUERIES = {
    f.__name__: f
    for f in (query_term_weights, bm25_topk, bm25_options, hashed_topk, rrf_fusion, rrf_weighted_half, scoped_fetch, evidence_pack_reserved, evidence_pack_emitted, char_budget_prefix, cosine_topk, segment_mean, neighbours_radius1, evidence_render, token_intervals)
}

_TOKENS = sql_tokens
_STORE = f"""m AS ({SQL_M}),
q AS ({SQL_QUERIES}),
s AS (SELECT m.* FROM m SEMI JOIN q USING (user_id)),
posted AS ({SQL_POSTED.replace("FROM m)", "FROM s)")}),
users AS ({SQL_USERS.replace("FROM m ", "FROM s ")}),
terms AS (SELECT user_id, term, count(*) AS document_count FROM posted GROUP BY user_id, term)"""


def _weighted(options: bool) -> str:
    own = f"SELECT query_id, user_id, unnest({_TOKENS('query')}) AS term, 1.0::DOUBLE AS weight FROM q"
    more = f" UNION ALL SELECT query_id, user_id, unnest({_TOKENS('options[1]')}) AS term, 0.35::DOUBLE AS weight FROM q" if options else ""
    return f"""w0 AS (SELECT query_id, user_id, term, max(weight) AS weight FROM ({own}{more}) GROUP BY ALL),
w1 AS (SELECT * FROM (SELECT *, max(CASE WHEN term IN {SQL_STOP} THEN 0 ELSE 1 END) OVER (PARTITION BY query_id) AS other FROM w0) WHERE other = 0 OR term NOT IN {SQL_STOP}),
w AS (SELECT query_id, w1.user_id, term, weight, round(ln(1 + (message_count - document_count + 0.5::DOUBLE) / (document_count + 0.5::DOUBLE)), 12) AS idf, greatest(total_length / message_count, 1.0::DOUBLE) AS average
FROM w1 JOIN terms USING (user_id, term) JOIN users USING (user_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, idf DESC, term) <= 64)"""


def _lexical(most: int) -> str:
    return f"""lexical AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, sequence, id) AS rank FROM (
SELECT query_id, w.user_id, id, round(sum(weight * idf * frequency * 2.2::DOUBLE / (frequency + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_length / average))), 6) AS score, min(sequence) AS sequence
FROM posted JOIN w USING (user_id, term) GROUP BY ALL) QUALIFY rank <= {most})"""


def _hashed(rows: str, by: str, text: str) -> str:
    counted = f"SELECT {by}, CAST('0x' || substr(md5(term), 1, 4) AS INT) % 64 AS pos, count(*) AS n FROM (SELECT {by}, unnest({_TOKENS(text)}) AS term FROM {rows}) GROUP BY ALL"
    return f"SELECT {by}, pos, n / sqrt(sum(n * n) OVER (PARTITION BY {by})) AS value FROM ({counted})"


def _semantic(most: int) -> str:
    asked = _hashed("q", "query_id, user_id", "query || chr(10) || options[1]")
    return f"""qv AS ({asked}), mv AS ({_hashed("s", "user_id, id", "content")}),
semantic AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
SELECT query_id, user_id, id, round(greatest(-1, least(1, coalesce(dot, 0))), 6) AS score FROM (SELECT DISTINCT query_id, user_id FROM qv) JOIN (SELECT DISTINCT user_id, id FROM mv) USING (user_id)
LEFT JOIN (SELECT query_id, id, sum(qv.value * mv.value) AS dot FROM mv JOIN qv USING (user_id, pos) GROUP BY ALL) USING (query_id, id)) QUALIFY rank <= {most})"""


_RANKED = f"{_STORE}, {_weighted(True)}, {_lexical(128)}, {_semantic(128)}"


def _rrf(weight: float) -> str:
    return f"""WITH {_RANKED} {_fused_sql(weight)}"""


def _fused_sql(weight: float) -> str:
    return f"""SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, l NULLS LAST, id) AS rank FROM (
SELECT query_id, id, round(sum(s), 9) AS score, min(l) AS l FROM (
SELECT query_id, id, 1.0::DOUBLE / (60 + rank) AS s, rank AS l FROM lexical UNION ALL SELECT query_id, id, {weight}::DOUBLE / (60 + rank), NULL FROM semantic) GROUP BY ALL) QUALIFY rank <= {TOP}"""


_EVIDENCE = """'[source ' || '{' || concat_ws(',', CASE WHEN role IS NOT NULL THEN '"role":' || to_json(role)::VARCHAR END, '"session_id":' || to_json(session_id)::VARCHAR,
'"request_id":' || to_json(request_id)::VARCHAR, '"message_index":' || message_index, '"message_id":' || to_json(id)::VARCHAR, '"received_sequence":' || sequence, '"timestamp_ms":' || source_timestamp_ms,
'"timestamp_utc":"' || CASE WHEN source_timestamp_ms BETWEEN -62135596800000 AND 253402300799999 THEN strftime(make_timestamp(source_timestamp_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') END || 'Z"') || '}]' || chr(10) || coalesce(content, '')"""
_NEAR = """SELECT id, CASE WHEN by_time THEN t0 ELSE a0 END AS before, CASE WHEN by_time THEN t1 ELSE a1 END AS after, by_time FROM (SELECT id,
count(CASE WHEN source_timestamp_ms IS NULL THEN 1 END) OVER (PARTITION BY user_id, session_id ORDER BY sequence, id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 0 AS by_time,
lag(id) OVER a AS a0, lead(id) OVER a AS a1, lag(id) OVER t AS t0, lead(id) OVER t AS t1 FROM m
WINDOW a AS (PARTITION BY user_id, session_id ORDER BY sequence, id), t AS (PARTITION BY user_id, session_id, source_timestamp_ms IS NULL ORDER BY source_timestamp_ms, sequence, id))"""


def _packed(grouping: str) -> str:
    """CTEs of the items of the fused lists; ``kept`` has a row per item with its parts. Needs WITH RECURSIVE."""
    gap, reserved = len(context.BETWEEN), grouping == "reserved"
    free = lambda c: f"x.{c} IS NOT NULL AND NOT list_contains(seen, x.{c}) AND x.{c} <> x.id" + (f" AND NOT {c}_ranked" if reserved else "")
    return f"""{_RANKED}, r AS ({_fused_sql(1.0)}), n AS ({_NEAR}), e AS (SELECT id, {_EVIDENCE} AS text FROM m),
x AS (SELECT r.query_id, r.rank, r.id, r.score, length(e.text) AS size, n.before, n.after, length(b.text) AS before_size, length(a.text) AS after_size,
  exists(SELECT 1 FROM r AS o WHERE o.query_id = r.query_id AND o.id = n.before) AS before_ranked, exists(SELECT 1 FROM r AS o WHERE o.query_id = r.query_id AND o.id = n.after) AS after_ranked
  FROM r JOIN n USING (id) JOIN e USING (id) LEFT JOIN e AS b ON b.id = n.before LEFT JOIN e AS a ON a.id = n.after),
f AS (SELECT DISTINCT query_id, 0::BIGINT AS rank, NULL::VARCHAR AS id, NULL::DOUBLE AS score, []::VARCHAR[] AS seen, 0::BIGINT AS used, 0::BIGINT AS place, true AS going, false AS taken, []::VARCHAR[] AS parts FROM r
  UNION ALL SELECT query_id, rank, id, score, CASE WHEN fits THEN list_concat(seen, said) ELSE seen END, used + CASE WHEN fits THEN total ELSE 0 END, place + CASE WHEN fits THEN 1 ELSE 0 END, going AND (fits OR skipped), fits, said FROM (
    SELECT *, going AND NOT skipped AND (place = 0 OR used + total <= {context.EVIDENCE_CHARACTERS}) AS fits, list_concat([id], list_concat(CASE WHEN first THEN [before] ELSE [] END, CASE WHEN second THEN [after] ELSE [] END)) AS said FROM (
      SELECT *, size + CASE WHEN first THEN {gap} + before_size ELSE 0 END + CASE WHEN second THEN {gap} + after_size ELSE 0 END AS total FROM (
        SELECT *, second_free AND size + CASE WHEN first THEN {gap} + before_size ELSE 0 END + {gap} + after_size <= {context.WINDOW_CHARACTERS} AS second FROM (
          SELECT x.*, f.seen, f.used, f.place, f.going, {"false" if reserved else "list_contains(f.seen, x.id)"} AS skipped, {free("before")} AND x.size + {gap} + x.before_size <= {context.WINDOW_CHARACTERS} AS first,
            {free("after")} AND x.after IS DISTINCT FROM x.before AS second_free FROM f JOIN x ON x.query_id = f.query_id AND x.rank = f.rank + 1))))),
kept AS (SELECT query_id, place, id, score, parts FROM f WHERE taken)"""


def _pack_sql(grouping: str) -> str:
    return f"""WITH RECURSIVE {_packed(grouping)} SELECT query_id, CAST(place AS INT) AS place, id, score, string_agg(text, chr(10) || chr(10) || '[adjacent context]' || chr(10) ORDER BY pos) AS content
FROM (SELECT query_id, place, kept.id, score, unnest(range(len(parts))) AS pos, unnest(parts) AS part FROM kept) k JOIN (SELECT id AS part, text FROM e) USING (part) GROUP BY query_id, place, id, score"""


_TOP20 = f"WITH {_STORE}, {_weighted(True)}, {_lexical(TOP)}"

ORACLES = {
    "query_term_weights": f"WITH {_STORE}, {_weighted(True)} SELECT query_id, user_id, term, weight, round(idf, 9) AS idf FROM w",
    "bm25_topk": f"WITH {_STORE}, {_weighted(False)}, {_lexical(TOP)} SELECT query_id, id, score, rank FROM lexical",
    "bm25_options": f"{_TOP20} SELECT query_id, id, score, rank FROM lexical",
    "hashed_topk": f"WITH {_STORE}, {_semantic(TOP)} SELECT query_id, id, score, rank FROM semantic",
    "rrf_fusion": _rrf(1.0),
    "rrf_weighted_half": _rrf(0.5),
    "scoped_fetch": f"{_TOP20} SELECT query_id, rank, id, session_id, role, content FROM lexical JOIN m USING (user_id, id)",
    "char_budget_prefix": f"""{_TOP20} SELECT query_id, rank, id FROM (SELECT query_id, rank, id, sum(greatest(length(coalesce(content, '')), 1)) OVER (PARTITION BY query_id ORDER BY rank) AS used
FROM lexical JOIN m USING (user_id, id)) WHERE used <= 2000""",
    "cosine_topk": f"""SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
SELECT a.vec_id AS query_id, CAST(e.vec_id // 2 AS VARCHAR) AS id, max(round(greatest(-1, least(1, list_inner_product(a.embedding::DOUBLE[], e.embedding::DOUBLE[]))), 6)) AS score
FROM embeddings a JOIN embeddings e ON a.label = e.label WHERE a.vec_id % 50 = 0 GROUP BY ALL) QUALIFY rank <= {TOP}""",
    "segment_mean": """WITH p AS (SELECT vec_id // 4 AS message, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings),
a AS (SELECT message, pos, avg(x) AS x FROM p GROUP BY ALL) SELECT message, pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY message)), 9) AS value FROM a""",
    "evidence_pack_reserved": _pack_sql("reserved"),
    "evidence_pack_emitted": _pack_sql("emitted"),
    "neighbours_radius1": f"WITH m AS ({SQL_M}) {_NEAR}",
    "evidence_render": f"WITH m AS ({SQL_M}) SELECT id, {_EVIDENCE} AS evidence FROM m",
    "token_intervals": f"""WITH m AS ({SQL_M}) SELECT id, CAST(s AS INT) AS start, CAST(least(s + 128, doc_length) AS INT) AS "end"
FROM (SELECT id, doc_length, unnest(range(0, CAST(greatest(0, ceil((doc_length - 128) / 96.0)) * 96 + 1 AS BIGINT), 96)) AS s FROM m WHERE doc_length > 0)""",
}
