"""Neighbours of a message and whole-item evidence under character limits."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import ExitStack

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.session import put_aside, put_table

WINDOW_CHARACTERS = 16_000
EVIDENCE_CHARACTERS = 500_000
BETWEEN = "\n\n[adjacent context]\n"


def source_header(role: str = "role") -> Column:
    """JSON of where a message comes from; null fields are left out, times outside the calendar have no text."""
    ts = F.col("source_timestamp_ms")
    utc = F.when(ts.between(-62135596800000, 253402300799999), F.date_format(F.timestamp_millis(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    return F.to_json(
        F.struct(
            F.col(role).alias("role"),
            "session_id",
            "request_id",
            "message_index",
            F.col("id").alias("message_id"),
            F.col("sequence").alias("received_sequence"),
            ts.alias("timestamp_ms"),
            utc.alias("timestamp_utc"),
        )
    )


def evidence() -> Column:
    """Header line and exact content of a message."""
    return F.concat(F.lit("[source "), source_header(), F.lit("]\n"), F.coalesce("content", F.lit("")))


def neighbours(messages: DataFrame, radius: int, item: str = "id") -> DataFrame:
    """Adds ``before`` and ``after``: ids (or another ``item``) of up to ``radius`` messages on each side inside (user, session).

    Source time orders the neighbours only where the message and all its neighbours by arrival have one; then
    they are the nearest dated messages, otherwise the nearest by arrival. Radius 0 gives none.
    """
    if not radius:
        none = F.filter(F.array(item), lambda _: F.lit(False))
        return messages.select("user_id", "session_id", "id", none.alias("before"), none.alias("after"), F.lit(False).alias("by_time"))
    scope = Window.partitionBy("user_id", "session_id")
    arrival = scope.orderBy("sequence", "id")
    dated = F.col("source_timestamp_ms").isNotNull()
    # undated messages sort apart, so that a frame among the dated ones never meets them
    time = Window.partitionBy("user_id", "session_id", dated).orderBy("source_timestamp_ms", "sequence", "id")
    ids = lambda order, a, b: F.collect_list(item).over(order.rowsBetween(a, b))
    marked = messages.select(
        "user_id",
        "session_id",
        "id",
        (F.count(F.when(~dated, 1)).over(arrival.rowsBetween(-radius, radius)) == 0).alias("by_time"),
        ids(arrival, -radius, -1).alias("a0"),
        ids(arrival, 1, radius).alias("a1"),
        ids(time, -radius, -1).alias("t0"),
        ids(time, 1, radius).alias("t1"),
    )
    return marked.select("user_id", "session_id", "id", F.when(F.col("by_time"), F.col("t0")).otherwise(F.col("a0")).alias("before"), F.when(F.col("by_time"), F.col("t1")).otherwise(F.col("a1")).alias("after"), "by_time")


#: One step per ranked message over ids and lengths only. ``seen``: ids shown so far, ``used``: characters, ``open``: whether
#: the list goes on, ``kept``: the items so far. ``:window`` and ``:most`` are the two limits.
_FOLD = """aggregate(lists,
  named_struct('seen', CAST(array() AS array<string>), 'used', 0L, 'open', true, 'kept', CAST(array() AS array<struct<id: string, score: double, parts: array<string>>>)),
  (s, x) -> IF(NOT s.open OR :skip, s,
    CASE WHEN size(s.kept) > 0 AND s.used + :item.size > :most
      THEN named_struct('seen', s.seen, 'used', s.used, 'open', false, 'kept', s.kept)
      ELSE named_struct('seen', array_union(s.seen, :item.parts), 'used', s.used + :item.size, 'open', true,
        'kept', array_append(s.kept, named_struct('id', x.id, 'score', x.score, 'parts', :item.parts))) END),
  s -> s.kept)"""
#: The parts of one item and their joint size: each neighbour that is free and still fits is taken.
_ITEM = """aggregate(filter(x.near, n -> NOT array_contains(s.seen, n.id) AND :free), named_struct('parts', array(x.id), 'size', x.size),
  (i, n) -> IF(array_contains(i.parts, n.id) OR i.size + :between + n.size > :window, i,
    named_struct('parts', array_append(i.parts, n.id), 'size', i.size + :between + n.size)))"""


def fold_items(lists: DataFrame, grouping: str, window: int = WINDOW_CHARACTERS, most: int = EVIDENCE_CHARACTERS) -> DataFrame:
    """Adds ``kept``, the items of each ranked list as ``array<struct<id, score, parts>>``, from ids and sizes.

    ``lists``: ``array<struct<id, size: bigint, score, near: array<struct<id, size: bigint>>>>`` in rank order. A neighbour
    that doesn't fit the window is passed over and later ones are still tried; the first item that doesn't fit the total ends
    the list. The first item is kept whole whatever its size. ``reserved``: a ranked message is never the context of another;
    ``emitted``: what was context is no item any more.
    """
    skip, free = {"reserved": ("false", "NOT array_contains(ranked, n.id)"), "emitted": ("array_contains(s.seen, x.id)", "true")}[grouping]
    item = _ITEM.replace(":free", free).replace(":between", str(len(BETWEEN))).replace(":window", str(int(window)))
    fold = _FOLD.replace(":skip", skip).replace(":most", str(int(most))).replace(":item", f"({item})")
    return lists.withColumn("ranked", F.transform("lists", lambda x: x["id"])).withColumn("kept", F.expr(fold)).drop("ranked")


def evidence_items(ranked: DataFrame, messages: DataFrame, radius: int = 1, grouping: str = "reserved", window: int = WINDOW_CHARACTERS, most: int = EVIDENCE_CHARACTERS, aside: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """``query_id, place, id, content, score`` of every ranked list (at most a hundred anchors each).

    Neighbours are sought in the sessions of the ranked messages only. What is folded is ids and lengths; texts are
    joined afterwards, for the messages that are shown. ``aside``: that of ``put_stepwise``, for a step of it.
    """
    sized = messages.select("user_id", "session_id", "id", "sequence", "source_timestamp_ms", F.length(evidence()).cast("bigint").alias("size"))
    with ExitStack() as stack:
        put = aside or (lambda df, name: stack.enter_context(put_aside(df, name)))
        hits = put(ranked.select("query_id", "user_id", "id", "rank", F.col("score").cast("double").alias("score")), "hits")
        with put_aside(sized.join(hits.select("user_id", "id").distinct(), ["user_id", "id"], "left_semi").select("user_id", "session_id").distinct(), "sessions") as sessions:
            inside = sized.join(sessions, ["user_id", "session_id"], "left_semi").withColumn("one", F.struct("id", "size"))
            near = put(neighbours(inside, radius, "one").select("user_id", "id", F.filter(F.concat("before", "after"), lambda x: x["id"].isNotNull()).alias("near")), "near")
        anchors = hits.join(near, ["user_id", "id"]).join(sized.select("user_id", "id", "size"), ["user_id", "id"])
        lists = anchors.groupBy("query_id", "user_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "size", "score", "near"))).alias("lists"))
        kept = fold_items(lists, grouping, window, most).select("query_id", "user_id", F.posexplode("kept").alias("at", "k"))
        parts = kept.select("query_id", "user_id", (F.col("at") + 1).alias("place"), "k.score", F.posexplode("k.parts").alias("pos", "id"))
        # headers are long and follow from a few fields, so they are made where the parts of an item have met; its first part is the item's own
        fields = messages.select("user_id", "id", "role", "session_id", "request_id", "message_index", "sequence", "source_timestamp_ms", "content")
        met = put(parts, "shown").join(fields, ["user_id", "id"]).drop("user_id")
        met = (put_table(met, "parts") if aside is None else met).repartition("query_id", "place")
    told = met.select("query_id", "place", "score", "pos", "id", evidence().alias("text")).groupBy("query_id", "place").agg(F.min("score").alias("score"), F.sort_array(F.collect_list(F.struct("pos", "id", "text"))).alias("ts"))
    return told.select("query_id", "place", F.col("ts")[0]["id"].alias("id"), F.array_join("ts.text", BETWEEN).alias("content"), "score")


def cut_bytes(text: str, most: int) -> list[str]:
    """Pieces of at most ``most`` bytes, never inside a character; no piece for an empty text."""
    if most < 4:
        raise ValueError("a character may need four bytes")
    raw, pieces, start = text.encode("utf-8"), [], 0
    while start < len(raw):
        end = min(start + most, len(raw))
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end -= 1
        pieces.append(raw[start:end].decode("utf-8"))
        start = end
    return pieces


def token_intervals(length: Column, width: int, overlap: int) -> Column:
    """Half-open intervals of ``width`` that cover a length, each starting ``width - overlap`` after the one before."""
    if width <= 0 or not 0 <= overlap < width:
        raise ValueError("needs 0 <= overlap < width")
    step = width - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((length - width) / step).cast("int") * step), F.lit(step))
    return F.when(length > 0, F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + width, length).alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
