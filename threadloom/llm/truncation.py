"""Text cut off by field limits (problem 8).

Method: per source, histograms of text lengths in characters and in bytes are tested for spikes at a maximum, as a field
limit leaves many texts of exactly one length and few longer ones; a text at a spike that doesn't end with terminal
punctuation is cut (rule ``limit``). An ellipsis that a source puts where it cuts counts as part of the length, and a
byte limit reaches down by the bytes of the character it broke.

Texts cut in transfer have no common length, so no histogram shows them (``unfinished``, rules ``sentence``, ``dots`` and
``structure``): here the corpus itself tells how complete texts of a source end - closing lines that many texts share,
tails behind the last sentence, and line starts whose lines usually go without a full stop. Every result row names its rule.

Scale: one pass makes narrow counts (lengths, last lines, line starts), combined before they are shuffled; a
source's profile holds only what a hundredth of its texts have, so it is bounded whatever the corpus, and a
second pass decides each text by its source's profile. No text is shuffled. The last lines are counted DEPTH deep; where
a text has only common ones among them, its source is counted twice as deep, until that is so no more.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.session import write_table

#: Last lines of a text that are counted at first; twice as many where that isn't enough.
DEPTH = 8
#: What this share of a source's different texts have, and at least LEAST of them, is common.
COMMON, LEAST = 0.01, 5
#: A length is a spike where its count is so many times that of the lengths around it.
SPIKE, AROUND = 4.0, 25
#: A spike is at a maximum where the lengths up to BEYOND behind it have at most this share of those before it.
BEYOND, LEFT = 100, 0.75
#: Share of lines with one start that go without a full stop, from which this is their way to end.
OPEN_SHARE = 0.8
#: Longest key of a count that is kept as it is; of longer ones a digest is.
KEY = 120

_CLOSE = r"[\"'”’»」』)\]*_]*"
_SENTENCE = re.compile(rf"(?<![.!?…])[.!?…]++{_CLOSE}+(?=\s|$)|[。！？…]+[”’」』）)]*")
_ITEM = re.compile(r"\s*(?:[-*•+]|\d{1,9}[.)])\s+")
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_UNSEEN = "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"
_NUMBERED_END = re.compile(r"\d\.\Z")
_NUMBER = re.compile(r"\d+(?:[.,:]\d+)*")
_NAME = re.compile(r"\b[A-ZÀ-Þ][a-zß-ÿ'’-]+\b")
_LATIN = re.compile(r"[^\W\d_]+")
_BULLET = re.compile(r"(?:[-*•+]|#[.)])\s+")
_KEYED = re.compile(r"([^\W\d_][\w'’ -]{0,30}):\s")
_DOTS = re.compile(r"(?<!\.)(?:\.\.\.|…)\W{0,20}\Z")


def trimmed(text: str) -> str:
    """The text without white space, invisible characters and bare tags at its end."""
    while True:
        end = len(text)
        while end and (text[end - 1].isspace() or text[end - 1] in _UNSEEN):
            end -= 1
        text = text[:end]
        tag = text.rfind("<") if text.endswith(">") else -1
        if tag < 0 or not _TAG.fullmatch(text[tag:]):
            return text
        text = text[:tag]


def key_of(text: str) -> str:
    """The text itself, or a digest of a long one."""
    return text if len(text) <= KEY else hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()


def item(line: str) -> str:
    """A line without its bullet or number."""
    return line[m.end() :].strip() if (m := _ITEM.match(line)) else line.strip()


def tail(line: str) -> str:
    """What follows the last finished sentence of a line; empty where the line ends with one."""
    text, end = item(line), 0
    for m in _SENTENCE.finditer(text):
        end = m.end()
    return text[end:].strip()


def flat(line: str) -> str:
    """A line with every number as #."""
    return _NUMBER.sub("#", line.strip())


def mask(line: str) -> str:
    """A line with every number as # and every capitalised word as N."""
    return _NAME.sub("N", flat(line))


def lead(line: str) -> str:
    """How a line starts: its bullet and its key or first word; a key behind a bullet counts by its form."""
    s = flat(line)
    bullet = m.group() if (m := _BULLET.match(s)) else ""
    s = s[len(bullet) :]
    if m := _KEYED.match(s):
        return bullet + (mask(m.group(1)) if bullet else m.group(1)) + ":"
    return bullet + key_of(s.split(" ", 1)[0])


def last_word(line: str) -> str:
    words = _LATIN.findall(line)
    return key_of(words[-1].casefold()) if words else line.strip()[-1:]


def lines_of(text: str) -> list[str]:
    return [x for x in trimmed(text).split("\n") if x.strip()]


def open_structure(text: str) -> bool | None:
    """Of a JSON text, whether it stops before its brackets close; None for other texts."""
    s = text.strip()
    if not (s[:1] == "{" and s[1:].lstrip()[:1] in ('"', "}", "") or s[:1] == "[" and s[1:].lstrip()[:1] in ("{", "[", '"', "]")):
        return None
    outside, quote, _ = _STRING.sub("", s).partition('"')
    return bool(quote) or outside.count("{") + outside.count("[") > outside.count("}") + outside.count("]")


#: A JSON string that is closed.
_STRING = re.compile(r'"(?:[^"\\]++|\\.)*+"', re.DOTALL)
_COUNTS = "source string, what string, key string, extra string, n bigint, h bigint"


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of a batch. Rows with a text hash are counted by different texts later, others are summed."""
    for batch in batches:
        single, summed = set(), Counter()
        for source, text, h, size in batch[["source", "text", "h", "bytes"]].itertuples(index=False):
            lines = lines_of(text)
            if not lines:
                continue
            single.add((source, "texts", "", None, h))
            single.add((source, "characters", str(len(text)), None, h))
            single.add((source, "bytes", str(size), None, h))
            for line in lines[-DEPTH:]:
                single.add((source, "line", key_of(mask(line)), None, h))
            last = lines[-1]
            if (t := flat(tail(last))) and t != flat(item(last)):
                single.add((source, "tail", key_of(t), None, h))
            if _DOTS.search(last) and (t := flat(tail(_DOTS.sub("", last)))):
                single.add((source, "dots", key_of(t), None, h))
            single.add((source, "final", lead(last), last_word(last) if tail(last) else "", h))
            for line in lines[:-1]:
                summed[source, "inner", lead(line), last_word(line) if tail(line) else ""] += 1
        rows = [(s, w, k, x, 1, h) for s, w, k, x, h in single] + [(s, w, k, x, n, 0) for (s, w, k, x), n in summed.items()]
        yield pd.DataFrame(rows, columns=["source", "what", "key", "extra", "n", "h"])


def _deeper(start: int, end: int):
    """Counts of the masked lines from the ``start``-th last up to the ``end``-th last."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            single = {(source, "line", key_of(mask(line)), None, 1, h) for source, text, h in batch[["source", "text", "h"]].itertuples(index=False) for line in lines_of(text)[-end : -start or None]}
            yield pd.DataFrame(list(single), columns=["source", "what", "key", "extra", "n", "h"])

    return read


def _decide(depth: int):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, source, text, size, lines, tails, dots, characters, sizes in batch[["doc_id", "source", "text", "bytes", "lines", "tails", "dots", "characters", "sizes"]].itertuples(index=False):
                why, start, end = judge(text, int(size), *(set(() if x is None else x) for x in (lines, tails, dots, characters, sizes)), depth)
                if why != "whole":
                    rows.append((doc, source, why, start, end))
            yield pd.DataFrame(rows, columns=["doc_id", "source", "why", "lead", "last"])

    return read


def at_spike(text: str, size: int, characters: set[int], sizes: set[int]) -> bool:
    """Whether a text has the length of a spike, in characters or bytes.

    Below a limit in bytes by up to three where a wider character would have had to be broken; above it by up to two
    where the broken character was replaced by a mark of three bytes.
    """
    if len(text) in characters or size in sizes:
        return True
    if size == len(text) or not sizes:
        return False
    return bool(sizes & {size + 1, size + 2, size + 3}) or text.endswith("\ufffd") and bool(sizes & {size - 1, size - 2})


def judge(text: str, size: int, lines: set[str], tails: set[str], dots: set[str], characters: set[int], sizes: set[int], depth: int = DEPTH) -> tuple[str, str, str]:
    """(verdict, lead, last word) of one text by its source's profile.

    Verdicts: ``whole``, or how it is cut - ``limit`` (at a spike without terminal punctuation), ``structure``, ``dots``
    (an ellipsis put where it stops), ``sentence`` - or ``line``, which the ways of its source's lines with the same
    start decide, or ``deeper`` where its last ``depth`` lines are all common and further ones haven't been counted.
    """
    broken = open_structure(text)
    if broken is not None:
        return ("structure" if broken else "whole"), "", ""
    left = lines_of(text)
    if not left:
        return "whole", "", ""
    at_limit = at_spike(text, size, characters, sizes)
    if text.count("```") % 2:
        return ("limit" if at_limit else "structure"), "", ""
    kept = len(left)
    while kept and key_of(mask(left[kept - 1])) in lines:
        kept -= 1
        if kept and len(left) - kept >= depth:
            return "deeper", "", ""
    if not kept:
        return "whole", "", ""
    line, t = left[kept - 1], tail(left[kept - 1])
    if kept == len(left) and _DOTS.search(line):
        return ("limit" if at_limit else "whole" if key_of(flat(tail(_DOTS.sub("", line)))) in dots else "dots"), "", ""
    if not t and not (at_limit and kept == len(left) and _NUMBERED_END.search(line[-40:])):
        return "whole", "", ""
    if t and t != item(line) and key_of(flat(t)) in tails:
        return "whole", "", ""
    if at_limit and kept == len(left):
        return "limit", "", ""
    if t != item(line):
        return "sentence", "", ""
    return "line", lead(line), last_word(line)


def _profiles(counts: DataFrame) -> DataFrame:
    """One row per source: its common closing lines, tails and dotted tails, and its spike lengths."""
    total = counts.where("what = 'texts'").select("source", F.col("n").alias("total"))
    least = F.greatest(F.lit(LEAST), F.col("total") * COMMON)
    at = Window.partitionBy("source", "what").orderBy(F.col("key").cast("bigint"))
    lengths = (
        counts.where("what IN ('characters', 'bytes')")
        .withColumn("around", (F.sum("n").over(at.rangeBetween(-AROUND, AROUND)) - F.col("n")) / (2 * AROUND))
        .withColumn("longer", F.coalesce(F.sum("n").over(at.rangeBetween(1, BEYOND)), F.lit(0)))
        .withColumn("shorter", F.coalesce(F.sum("n").over(at.rangeBetween(-BEYOND, -1)), F.lit(0)))
        .where(F.col("longer") <= LEFT * F.col("shorter"))
        .drop("longer", "shorter")
    )
    marks = counts.where("what IN ('line', 'tail', 'dots')").withColumn("around", F.lit(0.0)).unionByName(lengths)
    held = marks.join(total, "source").where((F.col("n") >= least) & (F.col("n") >= SPIKE * F.col("around")))
    of = lambda what, kind: F.collect_set(F.when(F.col("what") == what, F.col("key").cast(kind)))
    return held.groupBy("source").agg(of("line", "string").alias("lines"), of("tail", "string").alias("tails"), of("dots", "string").alias("dots"), of("characters", "int").alias("characters"), of("bytes", "int").alias("sizes"))


def cut_texts(documents: DataFrame) -> DataFrame:
    """``doc_id, source, why`` of every row whose text stops before its end; why names the rule.

    Defined cases: null, empty and blank texts are not cut; a null source is a source of its own; rows with a
    null doc_id are judged like others; a repeated row gives a repeated result row; equal texts count once in
    every statistic; an empty table gives no rows.
    """
    rows = documents.where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("source", F.lit("")).alias("source"), "text", F.octet_length("text").alias("bytes"), F.xxhash64("text").alias("h"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    told = "doc_id string, source string, why string, lead string, last string"
    of_texts = lambda counted: counted.groupBy("source", "what", "key", "extra", "h").agg(F.sum("n").alias("n")).groupBy("source", "what", "key", "extra").agg(F.sum(F.when(F.col("what") == "inner", F.col("n")).otherwise(1)).alias("n"))
    counts = write_table(of_texts(rows.mapInPandas(_count, _COUNTS)), "counts")
    decided = lambda texts, depth: write_table(texts.join(_profiles(counts), "source", "left").mapInPandas(_decide(depth), told), "verdicts")
    depth = DEPTH
    verdicts = decided(rows, depth)
    while not (short := verdicts.where("why = 'deeper'").select("source").distinct()).isEmpty():
        again = rows.join(short, "source", "left_semi")
        counts = write_table(counts.unionByName(of_texts(again.mapInPandas(_deeper(depth, 2 * depth), _COUNTS))).groupBy("source", "what", "key", "extra").agg(F.sum("n").alias("n")), "counts")
        depth *= 2
        verdicts = verdicts.join(short, "source", "left_anti").unionByName(decided(again, depth))
    # lines that start alike: inside texts where there are enough of them, else the last lines of texts
    ways = counts.where("what IN ('inner', 'final')").groupBy("source", F.col("key").alias("lead"), "what").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("extra") != "", F.col("n")).otherwise(0)).alias("open"))
    best = ways.where(F.col("n") >= LEAST).groupBy("source", "lead").agg(F.max(F.struct((F.col("what") == "inner").alias("first"), "what", "n", "open")).alias("w")).select("source", "lead", "w.what", "w.n", "w.open")
    usual = best.where(F.col("open") >= OPEN_SHARE * F.col("n")).select("source", "lead", "what")
    ends = counts.where("what IN ('inner', 'final') AND extra <> '' AND n >= 3").select("source", F.col("key").alias("lead"), "what", F.col("extra").alias("last"))
    complete = usual.join(ends, ["source", "lead", "what"]).select("source", "lead", "last")
    asked = verdicts.where("why = 'line'").join(complete, ["source", "lead", "last"], "left_anti")
    return verdicts.where("why <> 'line'").unionByName(asked.withColumn("why", F.lit("sentence"))).select(F.col("doc_id").cast(kind).alias("doc_id"), "source", "why")


def truncation_report(documents: DataFrame) -> DataFrame:
    """Per source: texts, cut texts, and their share; ``source`` is empty for a null source."""
    texts = documents.where("text IS NOT NULL").groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("texts"))
    cut = cut_texts(documents).groupBy("source").agg(F.count(F.lit(1)).alias("cut"), F.count(F.when(F.col("why") == "limit", 1)).alias("at_limit"))
    return texts.join(cut, "source", "left").select("source", "texts", F.coalesce("cut", F.lit(0)).alias("cut"), F.coalesce("at_limit", F.lit(0)).alias("at_limit"), (F.coalesce("cut", F.lit(0)) / F.col("texts")).alias("share"))
