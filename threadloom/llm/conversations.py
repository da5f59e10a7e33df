"""Rebuilding conversations from message rows (problem 4).

Method: message rows are a stream keyed by conversation. Streaming state (a session window per user and
session) buffers the rows of each conversation, late ones too, under an event-time watermark; when the
watermark passes a conversation's last arrival by the gap, the conversation is closed, put in order, judged
and emitted. State lives in the session's state store and checkpoint, so a lost executor replays from there.

A stored table is replayed through the same stream in slices of its time of arrival, one micro-batch each, so state
holds a slice and what is open before it, not the store. A conversation that goes on after it was closed comes out in
several parts; it is put together again from its stored rows, and so is one of which the stream gave up a row.

The unit of the result is a conversation, and its rows meet in one state entry. Rows are slimmed before the
state: unless contents are asked for, a message is its ids, place, side, flags and a digest.
"""

from __future__ import annotations

import datetime
import re
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threadloom.session import scratch_path, write_table

#: Spellings of roles by side (fixed values), compared without case and outer blanks.
USER_SIDE = ("user", "human", "customer")
ASSISTANT_SIDE = ("assistant", "ai assistant", "ai", "bot", "model")
OTHER_SIDE = ("system", "tool", "function", "developer")

#: White space and characters that show nothing.
INVISIBLE = r"[\s\p{Z}\p{Cc}\p{Cf}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{2800}\x{3164}\x{FFA0}\x{FE00}-\x{FE0F}]"

#: Silence after which a replay closes a conversation, and how far behind the newest row another may be.
GAP, DELAY = "2 days", "1 hour"
#: Slices of a replay.
SLICES = 4
_MARKER = "\u0000end"

_KEEP = ("id", "user_id", "session_id", "request_id", "message_index", "sequence", "role", "content", "source_timestamp_ms", "ingested_at_ms")


def slim(messages: DataFrame, contents: bool) -> DataFrame:
    """Stream or batch rows with side, blank flag and digest instead of what they are made from."""
    role = F.lower(F.regexp_replace(F.regexp_replace("role", f"^{INVISIBLE}+", ""), f"{INVISIBLE}+$", ""))
    side = F.when(role.isin(*USER_SIDE), "u").when(role.isin(*ASSISTANT_SIDE), "a").when(role.isin(*OTHER_SIDE), "s")
    blank = F.regexp_replace(F.coalesce("content", F.lit("")), INVISIBLE, "") == ""
    arrived = F.timestamp_millis(F.coalesce("ingested_at_ms", F.lit(0)))
    return messages.select(
        "user_id",
        "session_id",
        arrived.alias("arrived"),
        F.struct(
            "id",
            "sequence",
            F.coalesce("request_id", F.lit("")).alias("request"),
            F.col("message_index").alias("place"),
            side.alias("side"),
            F.col("source_timestamp_ms").alias("ts"),
            blank.alias("blank"),
            F.md5("content").alias("digest"),
            (F.col("content") if contents else F.lit(None).cast("string")).alias("content"),
        ).alias("m"),
    )


def in_order(grouped: DataFrame) -> DataFrame:
    """Adds ``requests``, the requests of a conversation in order with their messages in order, to buffered ``rows``."""
    for name in ("sorted", "firsts", "dated", "heads", "requests"):
        grouped = grouped.withColumn(name, F.expr(_STEPS[name]))
    return grouped


#: SQL over ``rows``, the buffered rows of one conversation; each step uses the ones before it.
_STEPS = {
    # rows of one id stand together, the smallest sequence first; a null id is a message of its own
    "sorted": "array_sort(rows, (x, y) -> CASE WHEN x.id < y.id THEN -1 WHEN x.id > y.id THEN 1 WHEN x.id IS NULL AND y.id IS NOT NULL THEN 1 WHEN y.id IS NULL AND x.id IS NOT NULL THEN -1"
    " WHEN x.sequence < y.sequence THEN -1 WHEN x.sequence > y.sequence THEN 1 WHEN x.sequence IS NULL AND y.sequence IS NOT NULL THEN 1 WHEN y.sequence IS NULL AND x.sequence IS NOT NULL THEN -1"
    " WHEN x < y THEN -1 WHEN x > y THEN 1 ELSE 0 END)",
    "conflict": "exists(sequence(1, size(sorted)), i -> i > 1 AND sorted[i-1].id = sorted[i-2].id AND NOT (sorted[i-1].side <=> sorted[i-2].side AND sorted[i-1].digest <=> sorted[i-2].digest))",
    "firsts": "array_sort(filter(sorted, (x, i) -> i = 0 OR x.id IS NULL OR NOT (x.id <=> sorted[greatest(i-1, 0)].id)), (x, y) -> CASE WHEN x.request < y.request THEN -1 WHEN x.request > y.request THEN 1"
    " WHEN coalesce(x.place, -1) < coalesce(y.place, -1) THEN -1 WHEN coalesce(x.place, -1) > coalesce(y.place, -1) THEN 1 WHEN x.sequence < y.sequence THEN -1 WHEN x.sequence > y.sequence THEN 1 ELSE 0 END)",
    "gaps": "exists(sequence(0, size(firsts) - 1), i -> NOT (firsts[i].place <=> IF(i > 0 AND firsts[greatest(i-1, 0)].request = firsts[i].request, firsts[greatest(i-1, 0)].place + 1, 0)))",
    "unreadable": "exists(firsts, x -> x.side IS NULL)",
    "dated": "forall(firsts, x -> x.ts IS NOT NULL)",
    # rows of one request stand together: where each request starts, and its slice
    "heads": "filter(sequence(1, size(firsts)), i -> i = 1 OR firsts[i-1].request <> get(firsts, i-2).request)",
    "requests": "array_sort(transform(transform(heads, (h, k) -> slice(firsts, h, coalesce(get(heads, k + 1), size(firsts) + 1) - h)),"
    " g -> named_struct('ts', IF(dated, array_min(transform(g, x -> x.ts)), 0L), 'seq', array_min(transform(g, x -> x.sequence)), 'request', g[0].request, 'messages', g)),"
    " (x, y) -> CASE WHEN x.ts < y.ts THEN -1 WHEN x.ts > y.ts THEN 1 WHEN x.seq < y.seq THEN -1 WHEN x.seq > y.seq THEN 1 WHEN x.request < y.request THEN -1 WHEN x.request > y.request THEN 1 ELSE 0 END)",
    "turns": "filter(flatten(transform(requests, r -> r.messages)), x -> NOT x.blank AND x.side IN ('u', 'a'))",
    "one_sided": "NOT (exists(turns, x -> x.side = 'u') AND exists(turns, x -> x.side = 'a'))",
    "unanswered": "exists(sequence(1, size(turns)), i -> i <= size(turns) AND i > 0 AND turns[i-1].side = 'u' AND NOT coalesce(get(turns, i).side = 'a' OR get(turns, i).request = turns[i-1].request, false))",
}


def judge(closed: DataFrame, *more: str) -> DataFrame:
    """Orders and judges closed conversations: ``user_id, session_id, reason, turns`` after the columns ``more``.

    reason is null for a good conversation, else the first that holds of ``conflict`` (two rows of one id
    differ in side or content), ``gap`` (a request's places aren't 0..n-1), ``role`` (null, blank or of no
    side), ``one_sided`` and ``unanswered``. turns: ``array<struct<speaker, content>>`` in order.
    """
    for name, sql in _STEPS.items():
        closed = closed.withColumn(name, F.expr(sql))
    reason = F.when(F.col("conflict"), "conflict").when(F.col("gaps"), "gap").when(F.col("unreadable"), "role").when(F.col("one_sided"), "one_sided").when(F.col("unanswered"), "unanswered")
    turns = F.transform("turns", lambda x: F.struct(F.when(x["side"] == "u", "user").otherwise("assistant").alias("speaker"), x["content"].alias("content")))
    return closed.select("user_id", "session_id", *more, reason.alias("reason"), turns.alias("turns"))


def closed_parts(slimmed: DataFrame, gap: str, delay: str) -> DataFrame:
    """``user_id, session_id, rows`` of each conversation of a stream of ``slim`` rows when it closes."""
    rows = slimmed.withWatermark("arrived", delay)
    return rows.groupBy(F.session_window("arrived", gap), "user_id", "session_id").agg(F.collect_list("m").alias("rows")).select("user_id", "session_id", "rows")


def conversation_stream(messages: DataFrame, gap: str, delay: str, contents: bool = True) -> DataFrame:
    """The streaming operator: message rows in, judged conversations out, each when it closes.

    ``messages`` is a streaming table of message rows. ``delay`` is how late a row may arrive behind the newest one before it
    is given up (the stream's progress counts such rows), ``gap`` how long a conversation must be silent to be closed.
    """
    return judge(closed_parts(slim(messages, contents), gap, delay))


#: State on disk beside the executor, so that a slice larger than memory can be open at once.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SETTINGS = {"spark.sql.streaming.minBatchesToRetain": "2", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


def replay_parts(spark: SparkSession, path: str, contents: bool = True, gap: str = GAP, delay: str = DELAY, slices: int = SLICES, state_store: str | None = ROCKSDB) -> tuple[DataFrame, DataFrame]:
    """(parts, rows): what the stream emitted for the stored message table at ``path``, and the slimmed rows it was given.

    parts: ``user_id, session_id, held, reason, turns``, with held the rows of the part. Rows are staged by time of arrival in
    ``slices`` of about equal size; each becomes visible to the running query as one micro-batch, and conversations that were silent
    for ``gap`` before its end close with the next. An end marker behind the last row closes the rest.
    """
    base = scratch_path(spark, "conversations")
    slimmed = slim(spark.read.parquet(path).select(*_KEEP), contents)
    seconds = F.col("arrived").cast("double")
    shares = [k / slices for k in range(1, slices)] or [1.0]
    high, bounds = slimmed.agg(F.max("arrived"), F.percentile_approx(seconds, shares, 1000)).first()
    high = high or datetime.datetime(1970, 1, 1)
    place = F.lit(0)
    for bound in sorted(set(bounds or [])) if slices > 1 else ():
        place = place + (seconds >= bound).cast("int")
    slimmed.withColumn("slice", place).write.partitionBy("slice").parquet(f"{base}/staged")
    schema = slimmed.schema
    system = spark._jvm.org.apache.hadoop.fs.Path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{p}")
    system.mkdirs(at("in"))
    end = F.lit(high).cast("timestamp") + F.expr(f"INTERVAL {gap}") + F.expr(f"INTERVAL {delay}") + F.expr("INTERVAL 1 minute")
    marker = spark.range(1).select(F.lit(_MARKER).alias("user_id"), F.lit(None).cast("string").alias("session_id"), end.alias("arrived"), F.lit(None).cast(schema["m"].dataType).alias("m"))
    for k in (slices, slices + 1):  # the first moves the watermark, and the batch of the second closes what is behind it
        marker.write.parquet(f"{base}/staged/slice={k}")

    stream = closed_parts(spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{base}/in"), gap, delay)
    judged = judge(stream.withColumn("held", F.size("rows")), "held")
    settings = _SETTINGS | ({"spark.sql.streaming.stateStore.providerClass": state_store} if state_store else {})

    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:  # a query keeps the settings it starts with
        query = judged.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").start()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    seen = -1
    try:
        for k in range(slices + 2):
            if system.exists(at(f"staged/slice={k}")):
                system.rename(at(f"staged/slice={k}"), at(f"in/{k}"))
                seen += 1
                _await_offset(query, seen)
    finally:
        query.stop()
    parts = spark.read.schema("user_id string, session_id string, held int, reason string, turns array<struct<speaker: string, content: string>>").parquet(f"{base}/out")
    given = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{base}/in")
    real = F.col("user_id").isNull() | (F.col("user_id") != _MARKER)
    return parts.where(real), given.where(real)


def replay(spark: SparkSession, path: str, contents: bool = True, **options) -> DataFrame:
    """Judged conversations of a stored message table: ``user_id, session_id, reason, turns, parts``.

    A conversation that came out in one part with all of its rows is as the stream judged it; any other is judged again from
    all of its rows, so neither the gap nor a row that was given up changes the result. ``options`` are those of ``replay_parts``.

    Defined cases: null user or session ids are key values; a null arrival time counts as the earliest; a null
    request id is one request; a null place breaks the conversation; null contents are blank; repeated rows
    change nothing; an empty table gives no rows; columns not used are unread.
    """
    parts, given = replay_parts(spark, path, contents, **options)
    key = ["user_id", "session_id"]
    counted = parts.select(*key, "held", F.lit(1).alias("parts")).unionByName(given.select(*key, F.lit(-1).alias("held"), F.lit(0).alias("parts")))
    several = write_table(counted.groupBy(*key).agg(F.sum("held").alias("missing"), F.sum("parts").cast("int").alias("parts")).where("missing <> 0 OR parts <> 1"), "several")
    same = lambda a, b: a["user_id"].eqNullSafe(b["user_id"]) & a["session_id"].eqNullSafe(b["session_id"])
    whole = parts.join(several, same(parts, several), "left_anti").select(*key, "reason", "turns", F.lit(1).alias("parts"))
    again = given.join(several, same(given, several)).select(given["user_id"], given["session_id"], "m", "parts").groupBy(*key).agg(F.collect_list("m").alias("rows"), F.max("parts").alias("parts"))
    # written, as a filter on the verdict would be pushed into the steps that lead to it and repeat them
    return whole.unionByName(write_table(judge(again, "parts").select(*key, "reason", "turns", "parts"), "again"))


def _await_offset(query: StreamingQuery, offset: int) -> None:
    """Waits until the query's batches have taken in its source up to ``offset`` and it waits for more."""
    while True:
        if query.exception():
            raise query.exception()
        progress = query.lastProgress
        ends = re.findall(r"\d+", str(progress["sources"][0]["endOffset"])) if progress else []
        if ends and int(ends[0]) >= offset and "Waiting for data" in query.status["message"]:
            return
        time.sleep(0.02)
