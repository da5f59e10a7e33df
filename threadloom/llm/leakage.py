"""Evaluation texts leaking into training text (problem 7).

Method: prefix-filtered set join. Probes (questions and gold texts of held-out items) and documents become
word sequences; probe shingles are ordered by how many documents have them, and only the rarest that a
containing document can't all miss are joined. Candidates must then have enough shingles at one place
(length and positional bounds), and an exact check over a window of the probe's size decides.

Scale: documents emit only shingles that some probe has, filtered in the task that reads them when the probe
shingles fit a checked bound, else by a shuffled semi join; texts are joined back for the few candidates that
pass the bounds. No pair of a document and a probe is formed without a shared rare shingle.
"""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from threadloom.functions.text import CJK_CLASS
from threadloom.session import write_table

HELD_OUT = ("validation", "heldout")
SHINGLE = 5
#: Words (characters of Chinese) in a row that are a leak by themselves.
RUN_WORDS, RUN_CHARACTERS = 12, 24
#: "About a tenth": a probe is whole where at most this share of its words is changed.
CHANGED = 0.13
#: Probe shingles up to this number are filtered for inside the reading tasks (8 bytes each).
IN_TASK = 2_000_000

_WORDS = re.compile(f"[{CJK_CLASS}]|[^\\W_{CJK_CLASS}]+")
_ESCAPED = re.compile(r"(?<!\\)\\++u([0-9a-fA-F]{4})")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>")
_INSIDE = re.compile(r"(?<=\w)['’ʼ`´‐‑-](?=\w)")
_MARKUP = re.compile(r"\*+|~~+|`+|__+|(?<!\w)_|_(?!\w)")
_UNSEEN = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯⠀ㅤ︀-️﻿ﾠ]")


def plain_words(text: str | None) -> list[str]:
    """Words (characters of Chinese and kana) without case, punctuation, markup, escapes or invisible characters."""
    if not text:
        return []
    if "\\" in text:
        text = _ESCAPED.sub(lambda m: chr(int(m.group(1), 16)), text)
        text = re.sub(r"(?<!\\)\\++[nrt]", " ", text).replace("\\", "")
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _UNSEEN.sub("", unicodedata.normalize("NFKC", text))
    text = _INSIDE.sub("", _MARKUP.sub("", text))
    return _WORDS.findall(text.casefold())


def _codes(text: str | None) -> np.ndarray:
    words = plain_words(text)
    return np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint32, len(words))


def shingles(codes: np.ndarray, size: int) -> np.ndarray:
    """64-bit digests of all runs of ``size`` words; the size is part of the digest."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.full(n, size * 0x9E37 + 1, np.uint64)
    for k in range(size):
        x = (out * np.uint64(0x9E3779B97F4A7C15)) ^ (codes[k : k + n].astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        out = x ^ (x >> np.uint64(29))
    return out.view(np.int64)


def _needs(codes: np.ndarray, characters: bool) -> tuple[int, int, int]:
    """Shingle size, run length, and number of shingles that some place of a leaking document shares."""
    size = max(1, min(SHINGLE, len(codes)))
    run = RUN_CHARACTERS if characters else RUN_WORDS
    whole = (len(codes) - size + 1) - size * int(np.ceil(CHANGED * len(codes)))
    return size, run, max(1, min(run - size + 1, whole))


_PROBE = "probe string, n int, size int, run int, least int, codes array<int>"


def _read_probes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for query, text in zip(batch["query_id"], batch["text"]):
            words = plain_words(text)
            codes = _codes(text)
            if not len(codes):
                continue
            characters = 2 * sum(len(w) == 1 and ord(w) > 0x3000 for w in words) > len(words)
            rows.append((query, hashlib.md5(codes.tobytes()).hexdigest(), len(codes), *_needs(codes, characters), codes.view(np.int32)))
        rows = [(q, p, n, size, run, least, c) for q, p, n, size, run, least, c in rows]
        yield pd.DataFrame(rows, columns=["query_id", "probe", "n", "size", "run", "least", "codes"])


def probes(items: DataFrame) -> DataFrame:
    """Question and gold text of each held-out item as probes; equal texts have one ``probe`` digest."""
    held = items.where(F.col("original_split").isin(*HELD_OUT) & F.col("query_id").isNotNull())
    texts = held.select("query_id", F.explode(F.array("question", "gold_text")).alias("text")).where("text IS NOT NULL")
    return texts.mapInPandas(_read_probes, f"query_id string, {_PROBE}")


def _probe_shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(p, n, size, run, least, i, s) for p, n, size, run, least, codes in batch.itertuples(index=False) for i, s in enumerate(shingles(np.asarray(codes, np.int32).view(np.uint32), size).tolist())]
        yield pd.DataFrame(rows, columns=["probe", "n", "size", "run", "least", "at", "shingle"])


def _necessary(group: pd.DataFrame) -> pd.DataFrame:
    """The rarest shingles of a probe of which a leaking document has at least one."""
    g = group.sort_values(["documents", "shingle", "at"])
    n, size, run = int(g["n"].iloc[0]), int(g["size"].iloc[0]), int(g["run"].iloc[0])
    keep = set(g["at"].head(size * int(np.ceil(CHANGED * n)) + 1))  # changes can't destroy all of these
    rank = dict(zip(g["at"], range(len(g))))
    width = run - size + 1
    for start in range(len(g) - width + 1):  # a run has all shingles of one of these spans
        keep.add(min(range(start, start + width), key=rank.__getitem__))
    kept = g[g["at"].isin(keep) & (g["documents"] > 0)]
    return kept[["probe", "shingle"]]


def _document_shingles(sizes: list[int], wanted):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = None if wanted is None else wanted.value
        for batch in batches:
            ids, at, found = [], [], []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                codes = _codes(text)
                for size in sizes:
                    s = shingles(codes, size)
                    if known is not None and len(s):
                        place = np.searchsorted(known, s)
                        here = np.flatnonzero(known[np.minimum(place, len(known) - 1)] == s)
                    else:
                        here = np.arange(len(s))
                    if len(here):
                        ids.append(np.full(len(here), doc, np.int64))
                        at.append(here.astype(np.int32))
                        found.append(s[here])
            if ids:
                yield pd.DataFrame({"doc_id": np.concatenate(ids), "pos": np.concatenate(at), "shingle": np.concatenate(found)})

    return read


def holds(document: np.ndarray, probe: np.ndarray, size: int, run: int) -> bool:
    """Exact check: ``run`` words of the probe in a row, or all of it but ``CHANGED`` inside one window."""
    n = len(probe)
    where: dict[int, list[int]] = {}
    for i, s in enumerate(shingles(probe, size).tolist()):
        where.setdefault(s, []).append(i)
    offsets = sorted({pos - i for pos, s in enumerate(shingles(document, size).tolist()) for i in where.get(s, ())})
    for o in offsets:
        low = max(0, -o)
        same = document[max(0, o) : o + n] == probe[low : low + max(0, min(len(document) - max(0, o), n - low))]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
        if len(edges) and (edges[1::2] - edges[::2]).max() >= run:
            return True
    slack, last = max(2, n // 8), None
    masks: dict[int, int] = {}
    for i, x in enumerate(probe.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << n) - 1
    for o in offsets:
        if last is not None and o < last + slack:
            continue
        last = o
        row = full
        for y in document[max(0, o - slack) : o + n + 2 * slack].tolist():
            hit = row & masks.get(y, 0)
            row = ((row + hit) | (row - hit)) & full
        if n - row.bit_count() >= (1 - CHANGED) * n:
            return True
    return False


@F.pandas_udf(BooleanType())
def _holds(text: pd.Series, codes: pd.Series, size: pd.Series, run: pd.Series) -> pd.Series:
    return pd.Series([holds(_codes(t), np.asarray(c, np.int32).view(np.uint32), int(s), int(r)) for t, c, s, r in zip(text, codes, size, run)], dtype=bool)


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, query_id`` of each document that holds a held-out item's question or gold text, fully or partly.

    Defined cases: null or empty texts hold and leak nothing; rows with a null doc_id or query_id are left
    out; items that share a text are each a case; a doc_id on several rows is reported once if any row leaks;
    probes shorter than a shingle are one shingle; without items or documents there is no row.
    """
    spark = documents.sparkSession
    probe = write_table(probes(items), "probes")
    distinct = probe.drop("query_id").dropDuplicates(["probe"])
    sizes = [r["size"] for r in distinct.select("size").distinct().collect()]  # at most SHINGLE values
    texts = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    parts = write_table(distinct.mapInPandas(_probe_shingles, "probe string, n int, size int, run int, least int, at int, shingle bigint"), "probe-shingles")
    unique = parts.select("shingle").distinct()
    small = unique.limit(IN_TASK + 1).count() <= IN_TASK
    wanted = spark.sparkContext.broadcast(np.sort(unique.toPandas()["shingle"].to_numpy(np.int64))) if small and sizes else None
    hits = texts.mapInPandas(_document_shingles(sizes, wanted), "doc_id bigint, pos int, shingle bigint")
    if wanted is None:
        hits = hits.join(unique, "shingle", "left_semi")
    hits = write_table(hits, "hits")
    rarity = hits.select("shingle", "doc_id").distinct().groupBy("shingle").agg(F.count(F.lit(1)).alias("documents"))
    ranked = parts.join(rarity, "shingle", "left").fillna(0, ["documents"])
    prefix = ranked.groupBy("probe").applyInPandas(_necessary, "probe string, shingle bigint").distinct()
    candidates = hits.join(prefix, "shingle").select("doc_id", "probe").distinct()
    # shingles of a candidate at nearly one offset; bands overlap, so that some band has all of them
    width = F.greatest(F.lit(4), F.floor(F.col("n") / 4)).cast("int")
    # candidates first: a frequent shingle then meets the probes of its documents only, not all probes that have it
    placed = hits.join(candidates, "doc_id").join(parts, ["probe", "shingle"])
    band = F.floor((F.col("pos") - F.col("at")) / width)
    counted = placed.select("doc_id", "probe", "least", "at", F.explode(F.array(band, band + 1)).alias("band")).groupBy("doc_id", "probe", "band").agg(F.count_distinct("at").alias("shared"), F.first("least").alias("least"))
    likely = counted.where("shared >= least").select("doc_id", "probe").distinct()
    checked = likely.join(distinct.select("probe", "codes", "size", "run"), "probe").join(texts, "doc_id").where(_holds("text", "codes", "size", "run")).select("doc_id", "probe").distinct()
    return checked.join(probe.select("probe", "query_id").distinct(), "probe").select("doc_id", "query_id").distinct()
