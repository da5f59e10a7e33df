"""Taking packed evidence apart again: which message each part is, and whether every character is accounted for."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.context import BETWEEN
from threadloom.session import put_table

_OPEN, _CLOSE = "[source ", "]\n"


def parts(content: str) -> list[tuple[str | None, str]]:
    """(message id, body) of each part. A part starts with a header line at the start or behind a separator.

    Headers quoted inside a body don't split it, as only a separator directly before a readable header does;
    text without such a header is a part without id.
    """
    starts, at = [0], 0
    while (at := content.find(BETWEEN + _OPEN, at)) >= 0:
        at += len(BETWEEN)
        if _header(content, at)[0] is not None:
            starts.append(at)
    out = []
    for i, start in enumerate(starts):
        end = starts[i + 1] - len(BETWEEN) if i + 1 < len(starts) else len(content)
        key, body = _header(content, start)
        out.append((key, content[body if key is not None else start : end]))
    return out


def _header(content: str, at: int) -> tuple[str | None, int]:
    if not content.startswith(_OPEN, at):
        return None, at
    end = content.find("\n", at)
    line = content[at + len(_OPEN) : end - 1] if end > 0 and content[end - 1] == "]" else ""
    try:
        key = json.loads(line).get("message_id")
    except (ValueError, AttributeError):
        return None, at
    return (key, end + 1) if isinstance(key, str) else (None, at)


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(q, p, i, key, body) for q, p, content in zip(batch["query_id"], batch["place"], batch["content"]) for i, (key, body) in enumerate(parts(content))]
        yield pd.DataFrame(rows, columns=["query_id", "place", "part", "id", "body"])


def grounded(items: DataFrame, messages: DataFrame) -> DataFrame:
    """``query_id, place, part, id, grounded``: whether each part is the exact content of the message it names, by its digest."""
    digest = lambda text: F.unhex(F.sha2(text, 256))
    split = items.select("query_id", "place", "content").mapInPandas(_rows, "query_id string, place int, part int, id string, body string")
    told = put_table(split.select("query_id", "place", "part", "id", digest(F.col("body")).alias("body")), "told")
    known = messages.select("id", digest(F.coalesce("content", F.lit(""))).alias("content"))
    return told.join(known, "id", "left").select("query_id", "place", "part", "id", F.coalesce(F.col("body") == F.col("content"), F.lit(False)).alias("grounded"))
