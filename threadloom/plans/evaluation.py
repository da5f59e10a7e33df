"""Queries on evaluation: gold texts, recall at prefixes, breakdowns, paired runs, splits, budgets, parsers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions.text import PLACEHOLDERS
from threadloom.operators import budgets, components, grading, index, search
from threadloom.operators.delivery import first_delivery
from threadloom.operators.ranks import split_by_rank
from threadloom.plans.prelude import SQL_M, SQL_STOP, first_messages, sql_tokens
from threadloom.session import settle, write_table
from threadloom.sources.tables import table

PREFIXES = (1, 5, 10, 20)


def _units(spark: SparkSession, d: str) -> DataFrame:
    """Question and gold text of each item; a fixed table of 320 items."""
    i = table(spark, d, "eval_items")
    return i.select("query_id", "category", "lang", F.explode(F.array(F.struct(F.lit("question").alias("unit_id"), F.col("question").alias("text")), F.struct(F.lit("gold").alias("unit_id"), F.col("gold_text").alias("text")))).alias("u")).select("query_id", "category", "lang", "u.unit_id", "u.text")


def gold_contains(spark: SparkSession, d: str) -> DataFrame:
    units = _units(spark, d).select("query_id", "unit_id", "text")
    found = grading.containing(table(spark, d, "documents").select("doc_id", F.col("text").alias("body")), units)
    return found.join(units, "text").select("doc_id", "query_id", "unit_id")


def text_frequency(spark: SparkSession, d: str) -> DataFrame:
    found = gold_contains(spark, d).groupBy("query_id", "unit_id").agg(F.count(F.lit(1)).alias("n"))
    return _units(spark, d).select("query_id", "unit_id").join(found, ["query_id", "unit_id"], "left").select("query_id", "unit_id", F.coalesce("n", F.lit(0)).alias("frequency"))


def _run(spark: SparkSession, d: str, column: str) -> DataFrame:
    """BM25 of a text column of the items over all documents, one scope: ``query_id, id, rank``."""
    every = F.lit("documents").alias("user_id")
    docs = table(spark, d, "documents").where("text IS NOT NULL").select(every, F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("sequence"), F.col("text").alias("content"))
    asked = table(spark, d, "eval_items").select("query_id", every, F.col(column).alias("query"), F.array().cast("array<string>").alias("options"))
    posted = write_table(index.postings(docs), "postings")
    users = index.user_statistics(docs)
    weighted = search.weighted_terms(asked, index.term_statistics(posted), users)
    return search.bm25(weighted, posted, max(PREFIXES)).select("query_id", "id", "score", "rank")


def _graded(spark: SparkSession, d: str, column: str) -> DataFrame:
    ranked = _run(spark, d, column)
    bodies = ranked.join(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("body")), "id")
    return grading.recall_at(grading.first_ranks(_units(spark, d), bodies, "body", "text"), PREFIXES)


def k_prefix_recall(spark: SparkSession, d: str) -> DataFrame:
    g = _graded(spark, d, "question")
    return g.select("query_id", "k", "gold", "hit", "any_hit", "all_hit", F.round("macro", 9).alias("macro"))


def category_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return grading.over_requested(table(spark, d, "eval_items").select("query_id", "category"), _graded(spark, d, "question"), ["category"], PREFIXES)


def paired_gain_loss(spark: SparkSession, d: str) -> DataFrame:
    at = lambda c: _graded(spark, d, c).where(F.col("k") == 20)
    return grading.paired(at("answer"), at("question"), "any_hit")


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return grading.spread(table(spark, d, "events"), ["event_type"], "value")


def split_allocation(spark: SparkSession, d: str) -> DataFrame:
    """Splits of whole components: linked samples share a place."""
    labels = settle(identity_components(spark, d))
    groups = split_by_rank(labels.select("component").distinct(), F.sha2("component", 256))
    return labels.join(groups, "component").select("sample_id", "place", "split")


def reused_sessions(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "histories")
    known = F.when(~F.lower(F.trim("conversation_id")).isin(*PLACEHOLDERS), F.col("conversation_id"))
    return h.select(known.alias("conversation_id"), "original_split").where("conversation_id IS NOT NULL").groupBy("conversation_id").agg(F.count_distinct("original_split").alias("splits")).where("splits > 1")


def _transcripts(spark: SparkSession, d: str) -> DataFrame:
    """``sample_id, digest`` of each session's roles and contents in order, whatever its ids and times; sessions of blanks have none.

    The reference's digest holds source times too; stored ones differ in unit and may be missing, so these links are a superset.
    """
    sessions = table(spark, d, "histories").select("sample_id", F.explode("session_ids").alias("session_id")).distinct()
    rows = table(spark, d, "messages").join(sessions.select("session_id").distinct(), "session_id", "left_semi")
    first = first_delivery(rows, ["session_id", "role", "content"])
    one = F.struct("sequence", "id", F.md5(F.to_json(F.struct("role", "content"))).alias("digest"))
    filled = F.max(F.coalesce(F.col("content"), F.lit("")).rlike(r"\S")).alias("filled")
    whole = first.groupBy("session_id").agg(F.sort_array(F.collect_list(one)).alias("rows"), filled).where("filled")
    return whole.select("session_id", F.sha2(F.concat_ws(",", "rows.digest"), 256).alias("digest")).join(sessions, "session_id").select("sample_id", "digest")


def _component_links(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "histories")
    known = lambda c: F.when(~F.lower(F.trim(c)).isin(*PLACEHOLDERS), F.col(c))
    one = lambda c, p: h.select(F.concat(F.lit("s:"), "sample_id").alias("a"), F.concat(F.lit(p), known(c)).alias("b"))
    shared = _transcripts(spark, d).select(F.concat(F.lit("s:"), "sample_id").alias("a"), F.concat(F.lit("x:"), "digest").alias("b"))
    return one("user_id", "u:").unionByName(one("conversation_id", "v:")).unionByName(shared).where("b IS NOT NULL").distinct()


def identity_components(spark: SparkSession, d: str) -> DataFrame:
    roots = components.merge_roots(_component_links(spark, d))
    samples = table(spark, d, "histories").select(F.concat(F.lit("s:"), "sample_id").alias("node"), "sample_id").distinct()
    if roots is None:
        return samples.select("sample_id", F.col("sample_id").alias("component"))
    return samples.join(roots, "node", "left").select("sample_id", F.substring(F.coalesce("root", "node"), 3, 2**31 - 1).alias("component"))


def governance_partition(spark: SparkSession, d: str) -> DataFrame:
    """Components whose samples lie in several splits go to development, others keep theirs. The tables name no used identities."""
    h = table(spark, d, "histories").select("sample_id", "original_split").distinct()
    return partitions(h, settle(identity_components(spark, d)))


def governance_draw(spark: SparkSession, d: str) -> DataFrame:
    """Partitions drawn by a digest, where all identities of the first dataset count as used before."""
    h = table(spark, d, "histories").select("sample_id", "original_split").distinct()
    links = _component_links(spark, d)
    datasets = table(spark, d, "histories").select(F.concat(F.lit("s:"), "sample_id").alias("a"), "dataset")
    first = datasets.agg(F.min("dataset").alias("dataset"))
    used = links.join(datasets.join(first, "dataset", "left_semi").select("a").distinct(), "a", "left_semi").select("b")
    return partitions(h, settle(identity_components(spark, d)), links, used, drawn=(0.2, 0.2))


def partitions(h: DataFrame, labels: DataFrame, links: DataFrame | None = None, used: DataFrame | None = None, drawn: tuple[float, float] | None = None) -> DataFrame:
    """``component, members, partition, reason`` of each component.

    One that has a used identity (``used``: ``b``, as in ``links``) goes to development. Otherwise, without ``drawn``, it keeps
    its split, or goes to development where it has several; with ``drawn`` = (validation, holdout) a digest of it decides.
    """
    spoiled = labels.select(F.lit(None).cast("string").alias("component")).limit(0)
    if used is not None:
        hit = links.join(used.select("b").distinct(), "b", "left_semi").select(F.substring("a", 3, 2**31 - 1).alias("sample_id")).distinct()
        spoiled = labels.join(hit, "sample_id", "left_semi").select("component").distinct()
    verdict = h.join(labels, "sample_id").groupBy("component").agg(F.count_distinct("sample_id").alias("members"), F.min("original_split").alias("low"), F.max("original_split").alias("high"))
    marked = verdict.join(spoiled.withColumn("used", F.lit(True)), "component", "left")
    if drawn:
        draw = F.conv(F.substring(F.sha2("component", 256), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
        other = F.when(draw < drawn[0], "validation").when(draw < sum(drawn), "holdout").otherwise("development")
        why = F.lit("drawn")
    else:
        several = F.col("low") != F.col("high")
        other = F.when(several | (F.col("low") == "dev"), "development").when(F.col("low") == "heldout", "holdout").otherwise(F.col("low"))
        why = F.when(several, "several splits").otherwise("kept")
    return marked.select("component", "members", F.when(F.col("used"), "development").otherwise(other).alias("partition"), F.when(F.col("used"), "used before").otherwise(why).alias("reason"))


def rerank_order(spark: SparkSession, d: str) -> DataFrame:
    """A permutation of each whole list: the best pair of a window of the query and one of the item decides an item's
    place, ties keep the order they came in. Every 50th vector of a list is a window of its query, three in a row are an item.
    """
    e = table(spark, d, "embeddings").select(F.col("label").alias("query_id"), "vec_id", F.floor(F.col("vec_id") / 3).alias("item"), "embedding")
    asked = e.where("vec_id % 50 = 0").groupBy("query_id").agg(F.collect_list("embedding").alias("asked"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    scored = e.join(asked, "query_id").withColumn("score", F.round(F.array_max(F.transform("asked", lambda a: dot(a, F.col("embedding")))), 6))
    best = scored.groupBy("query_id", "item").agg(F.max("score").alias("score"), F.min("vec_id").alias("came"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "came"))).select("query_id", "item", "score", "rank")


def chunk_requests(spark: SparkSession, d: str) -> DataFrame:
    m = first_messages(spark, d, ["user_id", "session_id", "content"])
    return budgets.chunk_messages(m).select("id", "chunk")


def byte_plan(spark: SparkSession, d: str) -> DataFrame:
    m = first_messages(spark, d, ["user_id", "content"]).where("content IS NOT NULL")
    return m.groupBy("user_id").agg(F.sum(F.octet_length("content") + 32).cast("bigint").alias("reserved"), F.ceil(F.count(F.lit(1)) / 10).alias("calls"))


def ledger_totals(spark: SparkSession, d: str) -> DataFrame:
    """Ledger of sending each user's messages in calls of ten: bytes reserved, tokens spent; a blank content fails its call."""
    m = first_messages(spark, d, ["store_id", "user_id", "content", "doc_length"])
    place = F.row_number().over(Window.partitionBy("store_id", "user_id").orderBy("sequence", "id")) - 1
    text = F.coalesce("content", F.lit(""))
    calls = m.withColumn("call", F.floor(place / 10)).groupBy("store_id", "user_id", "call").agg(F.sum(F.octet_length(text) + 32).cast("bigint").alias("reserved"), F.sum("doc_length").alias("spent"), F.max(F.trim(text) == "").alias("refused"))
    return budgets.ledger_totals(calls.select("store_id", "reserved", F.when(F.col("refused"), "failed").otherwise("ok").alias("status"), F.when(~F.col("refused"), F.col("spent")).alias("actual")), ["store_id"])


def identity_merge(spark: SparkSession, d: str) -> DataFrame:
    """Known conversations of each known author, as one sorted set per author."""
    h = table(spark, d, "histories")
    known = lambda c: F.when(~F.lower(F.trim(c)).isin(*PLACEHOLDERS), F.col(c))
    rows = h.select(known("user_id").alias("user_id"), known("conversation_id").alias("conversation_id")).where("user_id IS NOT NULL AND conversation_id IS NOT NULL")
    return rows.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("conversation_id")), "|").alias("conversations"))


def date_parse(spark: SparkSession, d: str) -> DataFrame:
    """Event times written in the four forms, and in two that none of them fits."""
    e = table(spark, d, "events").select("event_id", "ts", (F.col("event_id") % 6).alias("form"))
    t = F.col("ts")
    forms = ("yyyy/MM/dd (E) HH:mm", "h:mm a 'on' d MMMM, yyyy", "hh:mm a 'on' d MMMM yyyy", "h:mm a 'on' d MMM, yyyy", "yyyy-MM-dd HH:mm", "H:mm 'on' d MMMM, yyyy")
    text = F.coalesce(*[F.when(F.col("form") == i, F.date_format(t, f)) for i, f in enumerate(forms)])
    return e.select("event_id", grading.parse_date(text).alias("millis"))


def choice_scoring(spark: SparkSession, d: str) -> DataFrame:
    """Answers in eight forms drawn from the orders, the first four of them valid."""
    o = table(spark, d, "orders").select(F.substring(F.lit("abcd"), (F.col("o_orderkey") % 4 + 1).cast("int"), F.lit(1)).alias("right"), (F.col("o_custkey") % 8).alias("form"), F.substring(F.lit("abcd"), (F.col("o_custkey") % 4 + 1).cast("int"), F.lit(1)).alias("said"))
    forms = ("{}", " ({})\n", "It fits. <final_answer>({})</final_answer>", "So <final_answer> {} ", "<final_answer>(a) <final_answer>({})", "{} because of that", "({}).", "</final_answer><final_answer>{}")
    text = F.coalesce(*[F.when(F.col("form") == i, F.replace(F.lit(f), F.lit("{}"), F.upper("said") if i % 2 else F.col("said"))) for i, f in enumerate(forms)])
    chosen = grading.choice(text)
    return o.select("form", chosen.alias("choice"), F.coalesce(chosen == F.col("right"), F.lit(False)).alias("correct")).groupBy("form").agg(F.count(F.lit(1)).alias("asked"), F.count("choice").alias("valid"), F.count(F.when(F.col("correct"), 1)).alias("correct"))


def evidence_id_parse(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    first = F.concat(F.lit("D0"), F.col("l_partkey") % 30, F.lit(":0"), F.col("l_suppkey") % 20, F.when(F.col("l_linenumber") == 3, " see there").otherwise("; "))
    second = F.concat(F.lit("D"), F.col("l_linenumber"), F.lit(":"), F.col("l_orderkey") % 9)
    return line.select("l_orderkey", "l_linenumber", F.array_join(grading.evidence_ids(F.array(first, second)), "|").alias("ids"))


QUERIES = {
    f.__name__: f
    for f in (gold_contains, text_frequency, k_prefix_recall, category_breakdown, paired_gain_loss, latency_percentiles, split_allocation, reused_sessions, identity_components, governance_partition, governance_draw, rerank_order, chunk_requests, byte_plan, ledger_totals, identity_merge, date_parse, choice_scoring, evidence_id_parse)
}

_UNITS = "units AS (SELECT query_id, category, lang, 'question' AS unit_id, question AS text FROM eval_items UNION ALL SELECT query_id, category, lang, 'gold', gold_text FROM eval_items)"
_FOUND = "SELECT d.doc_id, u.query_id, u.unit_id FROM documents d JOIN units u ON contains(d.text, u.text) WHERE length(u.text) > 0"


def _sql_run(column: str) -> str:
    """CTEs ``<column>_graded`` of recall at the prefixes for a run on one column of the items."""
    p = column
    return f"""{p}_w0 AS (SELECT DISTINCT query_id, 'documents' AS user_id, unnest({sql_tokens(column)}) AS term FROM eval_items),
{p}_w1 AS (SELECT * FROM (SELECT *, max(CASE WHEN term IN {SQL_STOP} THEN 0 ELSE 1 END) OVER (PARTITION BY query_id) AS other FROM {p}_w0) WHERE other = 0 OR term NOT IN {SQL_STOP}),
{p}_w AS (SELECT query_id, {p}_w1.user_id, term, round(ln(1 + (message_count - document_count + 0.5::DOUBLE) / (document_count + 0.5::DOUBLE)), 12) AS idf, greatest(total_length / message_count, 1.0::DOUBLE) AS average
FROM {p}_w1 JOIN terms USING (user_id, term) JOIN users USING (user_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY idf DESC, term) <= 64),
{p}_run AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, sequence, id) AS rank FROM (
SELECT query_id, id, round(sum(idf * frequency * 2.2::DOUBLE / (frequency + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_length / average))), 6) AS score, min(sequence) AS sequence
FROM posted JOIN {p}_w w USING (user_id, term) GROUP BY ALL) QUALIFY rank <= {max(PREFIXES)}),
{p}_at AS (SELECT u.query_id, u.unit_id, min(CASE WHEN contains(d.text, u.text) THEN r.rank END) AS found_at FROM units u LEFT JOIN {p}_run r USING (query_id) LEFT JOIN documents d ON CAST(d.doc_id AS VARCHAR) = r.id GROUP BY ALL),
{p}_graded AS (SELECT query_id, k, count(*) AS gold, count(CASE WHEN found_at <= k THEN 1 END) AS hit FROM {p}_at, (SELECT unnest({list(PREFIXES)}) AS k) GROUP BY ALL)"""


_DOCS = f"""docs AS (SELECT 'documents' AS user_id, CAST(doc_id AS VARCHAR) AS id, doc_id AS sequence, {sql_tokens("text")} AS ts FROM documents WHERE text IS NOT NULL),
posted AS (SELECT user_id, id, sequence, doc_length, term, count(*) AS frequency FROM (SELECT user_id, id, sequence, len(ts) AS doc_length, unnest(ts) AS term FROM docs) GROUP BY ALL),
users AS (SELECT user_id, count(*) AS message_count, CAST(sum(len(ts)) AS BIGINT) AS total_length FROM docs GROUP BY user_id),
terms AS (SELECT user_id, term, count(*) AS document_count FROM posted GROUP BY ALL), {_UNITS}"""
_NOBODY = "(" + ", ".join(f"'{x}'" for x in PLACEHOLDERS) + ")"


def _known(c: str) -> str:
    return f"CASE WHEN lower(trim({c}, ' ')) NOT IN {_NOBODY} THEN {c} END"


#: Needs WITH RECURSIVE.
_COMPONENTS = f"""m AS ({SQL_M}), h AS (SELECT DISTINCT sample_id, unnest(session_ids) AS session_id FROM histories),
x AS (SELECT session_id, list({{'r': role, 'c': content}} ORDER BY sequence, id) AS said FROM m WHERE session_id IN (SELECT session_id FROM h) GROUP BY session_id HAVING bool_or(regexp_matches(coalesce(content, ''), '\\S'))),
edges AS (SELECT DISTINCT sample_id AS a, 'u:' || {_known("user_id")} AS b FROM histories WHERE {_known("user_id")} IS NOT NULL UNION SELECT DISTINCT sample_id, 'v:' || {_known("conversation_id")} FROM histories WHERE {_known("conversation_id")} IS NOT NULL
  UNION SELECT DISTINCT sample_id, 'x:' || md5(said::VARCHAR) FROM x JOIN h USING (session_id)),
star AS (SELECT a, min(a) OVER (PARTITION BY b) AS m FROM edges), links AS (SELECT DISTINCT a, m FROM star WHERE a <> m UNION SELECT DISTINCT m, a FROM star WHERE a <> m),
reach AS (SELECT DISTINCT sample_id AS a, sample_id AS r FROM histories UNION SELECT l.a, reach.r FROM reach JOIN links l ON l.m = reach.a),
labels AS (SELECT a AS sample_id, min(r) AS component FROM reach GROUP BY a)"""
_DRAW = "CAST('0x' || substr(sha256(component), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE"

ORACLES = {
    "gold_contains": f"WITH {_UNITS} {_FOUND}",
    "text_frequency": f"WITH {_UNITS}, f AS ({_FOUND}) SELECT u.query_id, u.unit_id, count(f.doc_id) AS frequency FROM units u LEFT JOIN f USING (query_id, unit_id) GROUP BY ALL",
    "k_prefix_recall": f"WITH {_DOCS}, {_sql_run('question')} SELECT query_id, k, gold, hit, hit > 0 AS any_hit, hit = gold AS all_hit, round(hit / gold, 9) AS macro FROM question_graded",
    "category_breakdown": f"""WITH {_DOCS}, {_sql_run("question")} SELECT category, k, count(*) AS requested, count(gold) AS graded, round(sum((coalesce(hit, 0) > 0)::INT) / count(*), 9) AS recall_any,
round(sum(coalesce(hit = gold, false)::INT) / count(*), 9) AS recall_all, round(sum(coalesce(hit / gold, 0)) / count(*), 9) AS recall_macro FROM (SELECT DISTINCT query_id, category FROM eval_items) JOIN question_graded USING (query_id) GROUP BY category, k""",
    "paired_gain_loss": f"""WITH {_DOCS}, {_sql_run("question")}, {_sql_run("answer")} SELECT count(CASE WHEN a.hit > 0 AND b.hit > 0 THEN 1 END) AS both, count(CASE WHEN a.hit = 0 AND b.hit > 0 THEN 1 END) AS gains,
count(CASE WHEN a.hit > 0 AND b.hit = 0 THEN 1 END) AS losses, count(CASE WHEN a.hit = 0 AND b.hit = 0 THEN 1 END) AS neither FROM answer_graded a JOIN question_graded b USING (query_id, k) WHERE k = 20""",
    "latency_percentiles": "SELECT event_type, count(value) AS n, median(value) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS most FROM events GROUP BY event_type",
    "split_allocation": f"""WITH RECURSIVE {_COMPONENTS}, g AS (SELECT component, row_number() OVER (ORDER BY sha256(component)) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT component FROM labels))
SELECT sample_id, place, CASE WHEN place <= least(greatest(1, floor(n * 0.6)), greatest(n - 2, 1)) THEN 'dev' WHEN place <= least(greatest(1, floor(n * 0.6)), greatest(n - 2, 1)) + greatest(1, floor(n * 0.2)) THEN 'validation' ELSE 'heldout' END AS split FROM g JOIN labels USING (component)""",
    "reused_sessions": f"SELECT c AS conversation_id, count(DISTINCT original_split) AS splits FROM (SELECT {_known('conversation_id')} AS c, original_split FROM histories) WHERE c IS NOT NULL GROUP BY c HAVING splits > 1",
    "identity_components": f"WITH RECURSIVE {_COMPONENTS} SELECT sample_id, component FROM labels",
    "governance_partition": f"""WITH RECURSIVE {_COMPONENTS} SELECT component, count(DISTINCT sample_id) AS members, CASE WHEN min(original_split) <> max(original_split) OR min(original_split) = 'dev' THEN 'development' WHEN min(original_split) = 'heldout' THEN 'holdout' ELSE min(original_split) END AS partition,
CASE WHEN min(original_split) <> max(original_split) THEN 'several splits' ELSE 'kept' END AS reason FROM labels JOIN histories USING (sample_id) GROUP BY component""",
    "governance_draw": f"""WITH RECURSIVE {_COMPONENTS}, spoiled AS (SELECT DISTINCT component FROM labels JOIN histories USING (sample_id) WHERE dataset = (SELECT min(dataset) FROM histories) AND sample_id IN (SELECT a FROM edges))
SELECT component, count(DISTINCT sample_id) AS members, CASE WHEN component IN (SELECT component FROM spoiled) THEN 'development' WHEN {_DRAW} < 0.2 THEN 'validation' WHEN {_DRAW} < 0.4 THEN 'holdout' ELSE 'development' END AS partition,
CASE WHEN component IN (SELECT component FROM spoiled) THEN 'used before' ELSE 'drawn' END AS reason FROM labels JOIN histories USING (sample_id) GROUP BY component""",
    "rerank_order": """WITH q AS (SELECT label, embedding AS asked FROM embeddings WHERE vec_id % 50 = 0)
SELECT query_id, item, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, came) AS rank FROM (SELECT e.label AS query_id, vec_id // 3 AS item, max(round(list_inner_product(asked::DOUBLE[], embedding::DOUBLE[]), 6)) AS score, min(vec_id) AS came
FROM embeddings e JOIN q ON e.label = q.label GROUP BY ALL)""",
    "chunk_requests": f"""WITH RECURSIVE m AS ({SQL_M}), o AS (SELECT id, user_id, session_id, row_number() OVER (PARTITION BY user_id, session_id ORDER BY sequence, id) AS n,
  CASE WHEN trim(coalesce(content, ''), ' ') = '' THEN 0 ELSE len(regexp_split_to_array(trim(content, ' '), '[\\s\\x{{0b}}\\x{{85}}\\p{{Z}}]+')) END AS words FROM m),
c AS (SELECT id, user_id, session_id, n, 1 AS held, words AS used, 0 AS chunk FROM o WHERE n = 1
  UNION ALL SELECT o.id, o.user_id, o.session_id, o.n, CASE WHEN held >= 20 OR used + words > 2000 THEN 1 ELSE held + 1 END, CASE WHEN held >= 20 OR used + words > 2000 THEN words ELSE used + words END,
  CASE WHEN held >= 20 OR used + words > 2000 THEN chunk + 1 ELSE chunk END FROM c JOIN o ON o.user_id IS NOT DISTINCT FROM c.user_id AND o.session_id IS NOT DISTINCT FROM c.session_id AND o.n = c.n + 1)
SELECT id, chunk FROM c""",
    "byte_plan": f"WITH m AS ({SQL_M}) SELECT user_id, CAST(sum(strlen(content) + 32) AS BIGINT) AS reserved, CAST(ceil(count(*) / 10) AS BIGINT) AS calls FROM m WHERE content IS NOT NULL GROUP BY user_id",
    "ledger_totals": f"""WITH m AS ({SQL_M}), c AS (SELECT store_id, sum(strlen(coalesce(content, '')) + 32) AS reserved, sum(doc_length) AS spent, bool_or(trim(coalesce(content, ''), ' ') = '') AS refused
FROM (SELECT *, (row_number() OVER (PARTITION BY store_id, user_id ORDER BY sequence, id) - 1) // 10 AS call FROM m) GROUP BY store_id, user_id, call)
SELECT store_id, count(*) AS attempts, count(CASE WHEN NOT refused THEN 1 END) AS ok, count(CASE WHEN refused THEN 1 END) AS failed, CAST(sum(reserved) AS BIGINT) AS reserved, CAST(sum(CASE WHEN refused THEN reserved ELSE coalesce(spent, reserved) END) AS BIGINT) AS accounted FROM c GROUP BY store_id""",
    "identity_merge": f"""SELECT user_id, array_to_string(list_sort(list_distinct(list(c))), '|') AS conversations FROM (SELECT {_known("user_id")} AS user_id, {_known("conversation_id")} AS c FROM histories) WHERE user_id IS NOT NULL AND c IS NOT NULL GROUP BY user_id""",
    "date_parse": "SELECT event_id, CASE WHEN event_id % 6 < 4 THEN epoch_ms(date_trunc('minute', ts)) END AS millis FROM events",
    "choice_scoring": """WITH o AS (SELECT substr('abcd', o_orderkey % 4 + 1, 1) AS right_one, o_custkey % 8 AS form, substr('abcd', o_custkey % 4 + 1, 1) AS said FROM orders)
SELECT form, count(*) AS asked, count(CASE WHEN form < 4 THEN 1 END) AS valid, count(CASE WHEN form < 4 AND said = right_one THEN 1 END) AS correct FROM o GROUP BY form""",
    "evidence_id_parse": """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 3 THEN array_to_string(list_sort(list_distinct(['D' || (l_partkey % 30) || ':' || (l_suppkey % 20), 'D' || l_linenumber || ':' || (l_orderkey % 9)])), '|') END AS ids FROM lineitem""",
}
