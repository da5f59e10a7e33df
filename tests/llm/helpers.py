"""Message rows for tests."""

MESSAGE = "store_id string, id string, user_id string, session_id string, request_id string, message_index int, sequence bigint, role string, content string, source_timestamp_ms bigint, ingested_at_ms bigint, doc_length int"
HISTORY = "sample_id string, dataset string, source string, original_split string, user_id string, conversation_id string, session_ids array<string>, prepared_at timestamp_ntz"
CLASHING = ("n", "m", "rows", "over", "bytes", "class", "words", "digests", "band", "node", "component", "split", "probe", "shingle", "block", "word", "h", "lines", "what", "key", "turns", "reason")


def message(seq, content, role="user", user="u", session="s", request="r", index=0, key=None, ts=None, store="st"):
    return (store, key or f"id{seq}", user, session, request, index, seq, role, content, ts, 1_700_000_000_000 + seq, len((content or "").split()))


def with_clashes(df):
    """Extra columns with names that the operators use inside."""
    from pyspark.sql import functions as F

    for c in CLASHING:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("x"))
    return df
