"""Encoding of the whole corpus with a public tokenizer (problem 6).

Method: corpus-level merge replay. Every distinct word of the corpus is encoded once. The words lie in one
flat row of symbols with an inverted index from symbol pair to positions; merges are applied in rank order
to all positions of their pair, and only the neighbours of a merged position change the index.

Scale: documents fall into blocks of bounded size. A block sends each of its distinct words once; words are
shuffled by word, so each is merged in one place however often it occurs, and a common word is at most one row
per block. Ids go back to their block, where one pass over its documents puts them together. What crosses
the network is the texts once and the distinct words of each block twice.
"""

from __future__ import annotations

import base64
import heapq
import math
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the byte-level vocabulary cuts a text into words (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of a block of documents on average; a larger document is in one block all the same.
BLOCK_BYTES = 1_000_000
#: Distinct words that are merged at a time inside a task.
WORDS_AT_ONCE = 200_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Replay:
    """Replays the merges of one vocabulary over many words at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.of_byte = [ranks[bytes([b])] for b in range(256)]
        text = {rank: token for token, rank in ranks.items()}
        self.text = [text[i] for i in range(len(text))] if len(text) == max(text) + 1 else text
        self.ranks = ranks
        self.pairs: dict[tuple[int, int], int] = {}

    def rank(self, a: int, b: int) -> int:
        """Id that the pair becomes, or -1."""
        found = self.pairs.get((a, b))
        if found is None:
            found = self.pairs[a, b] = self.ranks.get(self.text[a] + self.text[b], -1)
        return found

    def encode(self, words: Iterable[str]) -> list[list[int]]:
        """Ids of each word."""
        symbols: list[int] = []
        bounds = [0]
        for word in words:
            symbols.extend(self.of_byte[b] for b in word.encode("utf-8"))
            bounds.append(len(symbols))
        n = len(symbols)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        for end in bounds[1:]:
            if end:
                after[end - 1] = -1
        for start in bounds[:-1]:
            if start < n:
                before[start] = -1
        index: dict[tuple[int, int], list[int]] = {}
        heap: list[tuple[int, int, int]] = []

        def add(at: int, a: int, b: int) -> None:
            if (found := index.get((a, b))) is not None:
                found.append(at)
            elif (rank := self.rank(a, b)) >= 0:
                index[a, b] = [at]
                heapq.heappush(heap, (rank, a, b))

        for i, j in enumerate(after):
            if j > 0:
                add(i, symbols[i], symbols[j])
        while heap:
            rank, a, b = heapq.heappop(heap)
            for at in sorted(index.pop((a, b))):
                right = after[at]
                if symbols[at] != a or right < 0 or symbols[right] != b:
                    continue
                symbols[at] = rank
                symbols[right] = -1
                after[at] = further = after[right]
                if further >= 0:
                    before[further] = at
                    add(at, rank, symbols[further])
                if (earlier := before[at]) >= 0:
                    add(earlier, symbols[earlier], rank)
        return [[s for s in symbols[a:b] if s >= 0] for a, b in zip(bounds, bounds[1:])]


_SPLIT = regex.compile(PATTERN)
#: The same on texts of ASCII only, where the letters and digits are these.
_SPLIT_ASCII = re.compile(PATTERN.replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9").replace("?a-zA-Z+", "?[a-zA-Z]+").replace("?0-9+", "?[0-9]+"), re.ASCII)


def split(text: str) -> list[str]:
    """The words of a text, each of which is merged by itself; together they are the text."""
    return _SPLIT_ASCII.findall(text) if text.isascii() else _SPLIT.findall(text)


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words per block; a word may come again in a later batch of rows."""
    for batch in batches:
        words: dict[int, set[str]] = {}
        for block, text in zip(batch.column("block").to_pylist(), batch.column("text").to_pylist()):
            words.setdefault(block, set()).update(split(text))
        blocks = np.repeat(np.fromiter(words, np.int64, len(words)), [len(ws) for ws in words.values()])
        yield pa.RecordBatch.from_arrays([pa.array(blocks), pa.array([w for ws in words.values() for w in ws], pa.string())], ["block", "word"])


def _lists(rows: list[list[int]]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.fromiter(chain.from_iterable(rows), np.int32, int(ends[-1]))))


def _merge(ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = Replay(ranks.value)
        held: dict[str, list[int]] = {}

        def flush() -> pa.RecordBatch:
            times = [len(blocks) for blocks in held.values()]
            ids = _lists(replay.encode(held)).take(pa.array(np.repeat(np.arange(len(held)), times)))
            words = pa.array(list(held), pa.string()).take(pa.array(np.repeat(np.arange(len(held)), times)))
            blocks = pa.array(np.fromiter(chain.from_iterable(held.values()), np.int64, sum(times)))
            held.clear()
            return pa.RecordBatch.from_arrays([blocks, words, ids], ["block", "word", "ids"])

        # rows come sorted by word, so all blocks of a word are in one replay
        last = None
        for batch in batches:
            for block, word in zip(batch.column("block").to_pylist(), batch.column("word").to_pylist()):
                if word != last and len(held) >= WORDS_AT_ONCE:
                    yield flush()
                last = word
                held.setdefault(word, []).append(block)
        if held:
            yield flush()

    return run


def _assemble(documents: pa.Table, words: pa.Table) -> pa.Table:
    """Ids of the documents of a block: each word is looked up, and its ids are copied as a run."""
    place = {w: i for i, w in enumerate(words.column("word").to_pylist())}
    ids = words.column("ids").combine_chunks() if words.num_rows else _lists([])
    ids = ids if isinstance(ids, pa.ListArray) else ids.chunk(0)
    starts = ids.offsets.to_numpy().astype(np.int64)
    values, lengths = ids.values.to_numpy(), np.diff(starts)
    parts, ends = [], [0]
    for text in documents.column("text").to_pylist():
        at = np.fromiter(map(place.__getitem__, split(text)), np.int64)
        n = lengths[at]
        total = int(n.sum())
        parts.append(values[np.repeat(starts[at] - np.cumsum(n) + n, n) + np.arange(total)])
        ends.append(ends[-1] + total)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return pa.table({"doc_id": documents.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(np.asarray(ends, np.int32)), pa.array(flat, pa.int32()))})


def encode_documents(documents: DataFrame, vocabulary: str = VOCABULARY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, ids`` of every document row: ids by the vocabulary, without special tokens.

    Defined cases: null and empty texts have an empty list; a null or repeated doc_id is kept, row by row;
    strings of special tokens are ordinary text; an empty table gives no rows; other columns are unread.
    """
    spark: SparkSession = documents.sparkSession
    ranks = spark.sparkContext.broadcast(load_ranks(vocabulary))  # a published vocabulary: fixed size, whatever the corpus
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text")  # as text, ids keep all digits beside nulls
    empty = rows.where("text IS NULL OR text = ''").select("doc_id", F.array().cast("array<int>").alias("ids"))
    texts = rows.where("text <> ''")
    size = texts.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    blocked = texts.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    pairs = blocked.select("block", "text").mapInArrow(_words_of, "block bigint, word string").distinct()
    merged = pairs.repartition("word").sortWithinPartitions("word").mapInArrow(_merge(ranks), "block bigint, word string, ids array<int>")
    whole = blocked.groupBy("block").cogroup(merged.groupBy("block")).applyInArrow(_assemble, "doc_id string, ids array<int>")
    return whole.unionByName(empty).select(F.col("doc_id").cast(kind).alias("doc_id"), "ids")
