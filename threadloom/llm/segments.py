"""Splitting oversized items at natural boundaries (problem 5).

Method: lexical-cohesion segmentation. A text is a row of sentences; at each boundary the words of the block
before and of the block after are compared, and valleys of that similarity mark changes of topic. Inside the
part of the size window that a piece may end in, the deepest valley is the cut; the next piece then starts
``overlap_tokens`` before the cut. Where a sentence alone is over the limit it is cut at white space, and
where a word is, between characters.

Scale: the limits are compared with stored lengths and byte lengths inside the JVM, so only oversized rows
and their contents are shuffled or reach Python; pieces of one message are made in one pass over it.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions.text import CJK_CLASS, token_list
from threadloom.operators.delivery import first_delivery

#: Sentences on each side of a boundary that are compared.
BLOCK = 3
#: A piece is filled to this share of its limit before a natural cut may end it.
LEAST_FILL = 0.5
#: Configurations are a fixed small table; more rows than this are refused.
MOST_CONFIGS = 256

_ATOM = re.compile(f"([{CJK_CLASS}])|[^\\W_{CJK_CLASS}]+")
#: The same for texts that NFKC changes: a sign may become letters.
_ATOM_OR_SIGN = re.compile(f"([{CJK_CLASS}])|[^\\W_{CJK_CLASS}]+|([^\\w\\s])")
_SENTENCE_END = re.compile(r"(?:(?<![.!?…])[.!?…]++[\"'”’)\]]*+(?=\s|$)|[。！？；]+[”’」』）]*|\n+)\s*")


class _Text:
    """Offsets, token costs and byte lengths of one text; costs are upper bounds that add up."""

    def __init__(self, text: str):
        self.text = text
        self.starts, self.costs = [], [0]
        stable = text.isascii() or unicodedata.is_normalized("NFKC", text)
        total = 0
        for m in (_ATOM if stable else _ATOM_OR_SIGN).finditer(text):
            if m.lastindex == 2:  # letters under NFKC; one more, as they may pair with what is next to them
                if not (cost := len(token_list(m.group()))):
                    continue
                total += cost + 1
            else:
                total += 2 if m.lastindex else 1 if stable else max(1, len(token_list(m.group())))
            self.starts.append(m.start())
            self.costs.append(total)
        ends = [m.end() for m in _SENTENCE_END.finditer(text)]
        self.ends = ends if ends and ends[-1] == len(text) else [*ends, len(text)]
        self._depth: dict[int, float] | None = None
        self.bytes = None
        if not text.isascii():
            self.bytes = [0]
            for ch in text:
                self.bytes.append(self.bytes[-1] + len(ch.encode("utf-8", "surrogatepass")))

    @property
    def depth(self) -> dict[int, float]:
        if self._depth is None:
            self._depth = valleys(self.text, self.ends)
        return self._depth

    def tokens(self, a: int, b: int) -> int:
        """Cost of the atoms that start in [a, b); a cut inside an atom counts it on both sides."""
        i = max(0, bisect_right(self.starts, a) - 1) if a else 0
        if self.starts and self.starts[i] < a and not self._inside(i, a):
            i += 1
        j = bisect_right(self.starts, b - 1)
        return max(0, self.costs[j] - self.costs[min(i, j)])

    def _inside(self, i: int, at: int) -> bool:
        m = _ATOM.match(self.text, self.starts[i])
        return bool(m and m.end() > at)

    def size(self, a: int, b: int) -> int:
        return b - a if self.bytes is None else self.bytes[b] - self.bytes[a]

    def fits(self, a: int, b: int, most_tokens: float, most_bytes: float) -> bool:
        return self.size(a, b) <= most_bytes and (most_tokens == math.inf or self.tokens(a, b) <= most_tokens)

    def furthest(self, a: int, most_tokens: float, most_bytes: float) -> int:
        """Largest end of a piece from ``a``; at least one character."""
        low, high = a + 1, len(self.text)
        if self.fits(a, high, most_tokens, most_bytes):
            return high
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.fits(a, mid, most_tokens, most_bytes) else (low, mid - 1)
        return low

    def back(self, a: int, b: int, overlap: int) -> int:
        """Start of the last ``overlap`` tokens before ``b``, after ``a``."""
        j = bisect_right(self.starts, b - 1)
        i = j
        while i > 0 and self.costs[j] - self.costs[i - 1] <= overlap and self.starts[i - 1] > a:
            i -= 1
        return self.starts[i] if i < j else b


def valleys(text: str, ends: list[int]) -> dict[int, float]:
    """Depth of the similarity valley at each sentence end: how far cohesion rises on both sides of it."""
    bags = [Counter(token_list(text[a:b])) for a, b in zip([0, *ends[:-1]], ends)]
    scores = []
    for k in range(1, len(bags)):
        left: dict[str, int] = {}
        right: dict[str, int] = {}
        for side, near in ((left, bags[max(0, k - BLOCK) : k]), (right, bags[k : k + BLOCK])):
            for bag in near:
                for w, c in bag.items():
                    side[w] = side.get(w, 0) + c
        dot = sum([c * right[w] for w, c in left.items() if w in right])
        norm = math.sqrt(sum([c * c for c in left.values()]) * sum([c * c for c in right.values()]))
        scores.append(dot / norm if norm else 0.0)
    # the highest point of the slope that climbs away from each boundary, by one pass in each direction
    left, right = list(scores), list(scores)
    for i in range(1, len(scores)):
        if scores[i - 1] >= scores[i]:
            left[i] = left[i - 1]
    for i in range(len(scores) - 2, -1, -1):
        if scores[i + 1] >= scores[i]:
            right[i] = right[i + 1]
    return {ends[i]: a + b - 2 * s for i, (a, b, s) in enumerate(zip(left, right, scores))}


def cut(text: str | _Text, most_tokens: float, most_bytes: float, overlap: int) -> list[tuple[int, int]]:
    """Pieces of ``text`` as (start, end): in order, each under both limits, together the whole text.

    Neighbours share ``overlap`` tokens, or fewer where that many would leave a piece less than a third of
    its limit for new text, or where the end of a piece isn't between tokens.
    """
    t = _Text(text) if isinstance(text, str) else text
    text, n = t.text, len(t.text)
    if t.fits(0, n, most_tokens, most_bytes):
        return [(0, n)]
    ends, depth = t.ends, t.depth
    pieces, start, done = [], 0, 0
    while True:
        end = t.furthest(start, most_tokens, most_bytes)
        if end >= n:
            pieces.append((start, n))
            return pieces
        least = max(done + 1, start + int((end - start) * LEAST_FILL))
        inside = [e for e in ends[bisect_right(ends, least - 1) : bisect_right(ends, end)] if e < n]
        if inside:
            end = max(inside, key=lambda e: (depth.get(e, 0.0), e))
        else:
            space = max((i for i in range(end, least, -1) if text[i - 1].isspace()), default=None)
            if space:
                end = space
            else:  # no white space: between words or characters, never inside a surrogate or combining pair where avoidable
                at = bisect_right(t.starts, end - 1) - 1
                if at >= 0 and least < t.starts[at] < end and t._inside(at, end):
                    end = t.starts[at]
        pieces.append((start, end))
        done = end
        start = t.back(start, end, overlap)
        while start < end and not (t.tokens(start, end) <= most_tokens * 2 / 3 and t.size(start, end) <= most_bytes * 2 / 3 and t.fits(start, end + 1, most_tokens, most_bytes)):
            start = next((s for s in t.starts[bisect_right(t.starts, start) :] if s > start), end)
            start = min(start, end)


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["config_id", "id", "piece", "start", "end", "tokens", "bytes", "text"]
    known = None
    for batch in batches:
        rows = []
        for config, key, content, tokens, prefix, most, overlap in batch[["config_id", "id", "content", "most_tokens", "prefix_bytes", "most_bytes", "overlap"]].itertuples(index=False):
            most_tokens = math.inf if pd.isna(tokens) else int(tokens)
            most_bytes = math.inf if pd.isna(most) else int(most) - int(prefix)
            if most_tokens < 2 or most_bytes < 4:
                raise ValueError(f"limits of {config} leave no room for a character")
            if known is None or known.text != content:  # rows of one message follow each other
                known = _Text(content)
            for i, (a, b) in enumerate(cut(known, most_tokens, most_bytes, 0 if pd.isna(overlap) else int(overlap))):
                text = content[a:b]
                rows.append((config, key, i, a, b, len(token_list(text)), int(prefix) + len(text.encode("utf-8", "surrogatepass")), text))
            if len(rows) > 5000:
                yield pd.DataFrame(rows, columns=names)
                rows = []
        yield pd.DataFrame(rows, columns=names)


def pieces(messages: DataFrame, configs: DataFrame) -> DataFrame:
    """Pieces of every message that is over a configuration's limit.

    Result: ``config_id, id, piece, start, end, tokens, bytes, text``; piece counts from 0, start and end are
    characters of the content, bytes counts the configuration's prefix, which goes before every piece. A text
    over a limit by its stored length only may be one piece.

    Defined cases: null contents have no pieces; a null limit limits nothing; an id delivered several times is
    its row of the smallest sequence; null ids are messages of their own; a null config_id is left out; equal
    configuration rows are one. A limit that leaves no room for one character raises an error.
    """
    limits = configs.where("config_id IS NOT NULL").select("config_id", F.col("segment_tokens").cast("int").alias("most_tokens"), F.octet_length(F.coalesce("document_prefix", F.lit(""))).alias("prefix_bytes"), F.col("http_segment_bytes").cast("int").alias("most_bytes"), F.col("overlap_tokens").cast("int").alias("overlap")).distinct()
    if limits.limit(MOST_CONFIGS + 1).count() > MOST_CONFIGS:
        raise ValueError(f"more than {MOST_CONFIGS} configurations")
    # all of them as one value (a scalar subquery), so nothing is multiplied before it is known to be over a limit
    every = limits.agg(F.sort_array(F.collect_list(F.struct("config_id", "most_tokens", "prefix_bytes", "most_bytes", "overlap")))).scalar()
    over = F.filter(
        "limits__",
        lambda c: F.coalesce(F.col("doc_length") > c["most_tokens"], F.lit(False)) | F.coalesce(c["prefix_bytes"] + F.octet_length("content") > c["most_bytes"], F.lit(False)),
    )
    # contents that exceed nothing are dropped before the shuffle that finds the row that counts
    slim = messages.select("id", "sequence", "content", "doc_length").withColumn("limits__", every).withColumn("over", F.when(F.col("content").isNotNull(), over)).select("id", "sequence", F.when(F.size("over") > 0, F.col("content")).alias("content"), F.when(F.size("over") > 0, F.col("over")).alias("over"))
    first = first_delivery(slim, ["over", "content"]).where("over IS NOT NULL")
    work = first.select("id", "content", F.explode("over").alias("c")).select("id", "content", "c.*")
    return work.mapInPandas(_pieces, "config_id string, id string, piece int, start int, end int, tokens int, bytes int, text string")


def coverage(messages: DataFrame, configs: DataFrame) -> DataFrame:
    """Audit of ``pieces``: ``config_id, id, covered, within`` - characters that the pieces cover in order without a gap,
    and whether every piece is under both limits."""
    cut = pieces(messages, configs)
    before = F.coalesce(F.lag("end").over(Window.partitionBy("config_id", "id").orderBy("piece")), F.lit(0))
    limits = configs.where("config_id IS NOT NULL").select("config_id", "segment_tokens", "http_segment_bytes").distinct()
    joined = cut.withColumn("new", F.when(F.col("start") <= before, F.col("end") - before)).join(limits, "config_id")
    under = (F.col("tokens") <= F.coalesce("segment_tokens", "tokens")) & (F.col("bytes") <= F.coalesce("http_segment_bytes", "bytes"))
    return joined.groupBy("config_id", "id").agg(F.sum("new").cast("int").alias("covered"), F.min(under).alias("within"))
