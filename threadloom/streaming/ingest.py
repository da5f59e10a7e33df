"""Write-once ingest from a stream of requests (an extension: the batch operators do the same work)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threadloom.operators.memory import Memory

MESSAGE = "user_id string, session_id string, request_id string, message_index int, role string, content string, source_timestamp_ms bigint, arrival bigint"


def follow_requests(arrivals: DataFrame, memory: Memory, checkpoint: str) -> StreamingQuery:
    """Adds each micro-batch of message rows to the store; a search started afterwards finds them.

    A batch is committed under its own number, so one that is run again after a failure adds nothing twice. Requests don't
    expire: what was stored once is compared with for good, in the folders of the batch's users only. A request's
    rows must arrive in one micro-batch.
    """

    def put(batch: DataFrame, number: int) -> None:
        memory.add(batch, name=f"batch {number}")

    return arrivals.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_statistics(messages: DataFrame, delay: str = "30 days") -> DataFrame:
    """Streaming message counts and lengths per store and user; a row delivered again within ``delay`` counts once."""
    arrived = messages.withColumn("arrived", F.timestamp_millis("ingested_at_ms")).withWatermark("arrived", delay)
    return arrived.dropDuplicatesWithinWatermark(["id"]).groupBy("store_id", "user_id").agg(F.count(F.lit(1)).alias("message_count"), F.sum("doc_length").alias("total_length"))



