"""Pluggable models: batch functions that run in tasks, with deterministic defaults that need no network."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Texts to vectors, made once a task by a factory, so that a model is loaded once a worker.
Embedder = Callable[[Sequence[str]], np.ndarray]
#: Texts of one batch to one answer (JSON text or None) each.
Answerer = Callable[[Sequence[str]], Sequence[str | None]]


def hashing_embedder(dims: int = 64) -> Embedder:
    """Vectors of length 1 from hashed words; equal texts get equal vectors on any machine."""

    def embed(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % dims] += 1.0 if h >> 63 else -1.0
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n > 0, n, 1.0)

    return embed


def halving(embed: Embedder, batch: int) -> Embedder:
    """``embed`` in batches; one that does not fit in memory is given in halves, down to single texts."""

    def some(texts: Sequence[str]) -> np.ndarray:
        try:
            return embed(texts)
        except MemoryError:
            if len(texts) == 1:
                raise
            half = len(texts) // 2
            return np.concatenate([some(texts[:half]), some(texts[half:])])

    def all_of(texts: Sequence[str]) -> np.ndarray:
        parts = [some(texts[i : i + batch]) for i in range(0, len(texts), batch)]
        return np.concatenate(parts) if parts else embed(texts)

    return all_of


def unit_vector(v: Column) -> Column:
    """The vector at length 1; one of length 0 stays as it is."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x.cast("double")))


def embedded(df: DataFrame, id_col: str, text_col: str, factory: Callable[[], Embedder], task: str = "") -> DataFrame:
    """Columns ``id_col`` and embedding. ``task`` is put before each text, as some models want it."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = factory()
        for part in parts:
            texts = [f"{task}{t or ''}" for t in part[text_col]]
            yield pd.DataFrame({id_col: part[id_col], "embedding": list(embed(texts).astype(np.float32))})

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, embedding array<float>")


def embedded_with_cache(df: DataFrame, cache: DataFrame, id_col: str, text_col: str, factory: Callable[[], Embedder]) -> tuple[DataFrame, DataFrame]:
    """Vectors of all rows, and the new cache rows (h, embedding). Each missing text is embedded once."""
    keyed = df.select(id_col, text_col, F.sha2(F.coalesce(text_col, F.lit("")), 256).alias("h"))
    missing = keyed.join(cache.select("h"), "h", "left_anti").groupBy("h").agg(F.first(text_col).alias(text_col))
    new = embedded(missing, "h", text_col, factory)
    return keyed.join(cache.select("h", "embedding").unionByName(new), "h").select(id_col, "embedding"), new


def answered(df: DataFrame, id_col: str, text_col: str, factory: Callable[[], Answerer], batch: int = 30) -> DataFrame:
    """Columns ``id_col``, answer, error: a failed batch gives an error for its rows and no failed task."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = factory()
        for part in parts:
            answers: list[str | None] = []
            errors: list[str | None] = []
            for i in range(0, len(part), batch):
                texts = part[text_col].iloc[i : i + batch].tolist()
                try:
                    got = list(ask(texts))
                    if len(got) != len(texts):
                        raise ValueError(f"{len(got)} answers to {len(texts)} texts")
                    answers += got
                    errors += [None] * len(texts)
                except Exception as e:  # noqa: BLE001 - any failure of a model is data here
                    answers += [None] * len(texts)
                    errors += [f"{type(e).__name__}: {e}"[:200]] * len(texts)
            yield pd.DataFrame({id_col: part[id_col], "answer": answers, "error": errors})

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, answer string, error string")


def within_quota(df: DataFrame, id_col: str, order: Sequence[Column], quota: int) -> tuple[DataFrame, DataFrame]:
    """The rows that a model may see, and the rest: ranked before the call, as tasks share no counter.

    The ranking is global; a limit with a total order takes the first rows of each partition before
    it moves anything. ``id_col`` is unique; only ids are compared for the rest.
    """
    first = df.orderBy(*order).limit(quota)
    return first, df.join(first.select(id_col), id_col, "left_anti")


def with_fallback(df: DataFrame, answers: DataFrame, id_col: str, parsed: Column, fallback: Column, name: str) -> DataFrame:
    """``df`` with the parsed answer, or the rule's value where a row has no answer that parses."""
    return df.join(answers, id_col, "left").withColumn(name, F.coalesce(parsed, fallback)).drop("answer", "error")


def running_cost(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], cost: str, cap: float) -> DataFrame:
    """Calls of each run in order while the sum of costs stays within the cap."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn("spent", F.sum(cost).over(w)).filter(F.col("spent") <= cap)
