"""Problem 8: encoding with a public byte-level BPE vocabulary (contiguous rank array)."""

from __future__ import annotations

import base64
import functools
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie; a parameter of every function below.
TOKENIZERS = os.environ.get("SKEIN_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the published pre-tokenisation pattern of this vocabulary.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words up to this many bytes are merged by scanning the rank array, longer ones with a heap.
SHORT = 96
#: Words kept with their ids in each Python worker.
CACHE = 400_000
NONE = 1 << 60


def ranks_of(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}


def merged_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word: part boundaries and the rank of each adjacent pair lie in two arrays; the
    least rank's boundary is deleted until no pair is in the vocabulary."""
    get = ranks.get
    bound = list(range(len(word) + 1))
    pair = [get(word[i : i + 2], NONE) for i in range(len(word) - 1)]
    while pair:
        least = min(pair)
        if least == NONE:
            break
        i = pair.index(least)
        del bound[i + 1]
        del pair[i]
        if i < len(pair):
            pair[i] = get(word[bound[i] : bound[i + 2]], NONE)
        if i:
            pair[i - 1] = get(word[bound[i - 1] : bound[i + 1]], NONE)
    return [ranks[word[a:b]] for a, b in zip(bound, bound[1:], strict=False)]


def merged_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same result for a long word in O(n log n): a heap of pairs over linked parts."""
    n = len(word)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, stop = heapq.heappop(heap)
        j = end[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        alive[j] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
            if (x := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (x, i, end[stop]))
        if (h := before[i]) >= 0 and (x := ranks.get(word[h:stop])) is not None:
            heapq.heappush(heap, (x, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    """Ids of texts as little-endian int32 bytes, with a bounded cache of words."""

    def __init__(self, raw: bytes) -> None:
        self.ranks = ranks_of(raw)
        self.find = regex.compile(WORDS).findall
        self.cache: dict[str, bytes] = {}

    def word(self, w: str) -> bytes:
        raw = w.encode("utf-8", "surrogatepass")
        ids = merged_short(raw, self.ranks) if len(raw) <= SHORT else merged_long(raw, self.ranks)
        packed = np.asarray(ids, "<i4").tobytes()
        if len(w) <= SHORT:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[w] = packed
        return packed

    def text(self, t: str) -> bytes:
        get, word = self.cache.get, self.word
        return b"".join([get(w) or word(w) for w in self.find(t)])


@functools.lru_cache(maxsize=2)
def encoder(raw: bytes) -> Encoder:
    """The encoder of a vocabulary file, one in each Python worker for all its tasks."""
    return Encoder(raw)


def shipped(df: DataFrame, path: str) -> Broadcast[bytes]:
    """The vocabulary file (about a megabyte) for all executors, which need not have it themselves."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encoded(df: DataFrame, id_col: str, text_col: str, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """Columns ``id_col`` and ``ids`` (array of int), without special tokens.

    The empty text gives an empty array, null gives null. Texts are encoded whole. Each row of the
    table gives one row. Equal ranks within a word are merged from the left.
    """
    raw = shipped(df, f"{tokenizers}/{vocabulary}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(raw.value)
        for batch in batches:
            parts = [None if t is None else enc.text(t) for t in batch.column(1).to_pylist()]
            size = np.fromiter((0 if p is None else len(p) // 4 for p in parts), np.int64, len(parts))
            # lists of at most 16 million ids in one batch
            cut = [0, *(np.flatnonzero(np.diff(np.cumsum(size) // (1 << 24))) + 1).tolist(), len(parts)]
            for a, b in zip(cut, cut[1:], strict=False):
                if a == b:
                    continue
                offsets = np.concatenate([[0], np.cumsum(size[a:b])]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join([p for p in parts[a:b] if p]), "<i4"))
                null = np.array([p is None for p in parts[a:b]])
                ids = pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array(null))
                yield pa.record_batch([batch.column(0).slice(a, b - a), ids], names=["k", "ids"])

    out = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).mapInArrow(run, "k bigint, ids array<int>")
    return out.withColumnRenamed("k", id_col)


def token_counts(df: DataFrame, id_col: str, text_col: str, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """Columns ``id_col`` and ``n_tokens``; null texts have no row, the empty text has 0."""
    raw = shipped(df, f"{tokenizers}/{vocabulary}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(raw.value)
        for batch in batches:
            n = [len(enc.text(t)) // 4 for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64())], names=["k", "n"])

    part = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).filter(F.col("t").isNotNull())
    return part.mapInArrow(run, "k bigint, n bigint").select(F.col("k").alias(id_col), F.col("n").alias("n_tokens"))
