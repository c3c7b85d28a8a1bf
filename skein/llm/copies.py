"""Problem 4: duplicates hidden by formatting differences (recursive radix partitioning, tries)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.keys import bare
from skein.llm.store import joined, written

#: A bucket is split by further bytes while it holds more rows or more bytes of keys.
BUCKET_ROWS = 50_000
BUCKET_BYTES = 16_000_000
#: Bytes of the key that a trie edge carries.
EDGE = 8
FIELDS = ("youtube_comment_id", "parent_comment_id", "author_name", "author_channel_id", "text_raw", "like_count", "reply_count", "published_at", "is_top_level")
#: Fields that are compared without case, white space and punctuation.
LOOSE = ("author_name", "text_raw")


def canonical(fields: Sequence[Column]) -> Column:
    """Bytes that are equal if and only if all fields are; null equals null and nothing else."""
    return F.encode(F.concat(*[F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in fields]), "utf-8")


def json_key(payload: Column, fields: Sequence[str] = FIELDS, loose: Sequence[str] = LOOSE) -> Column:
    """Canonical bytes of a JSON object whatever the order of its fields, its spacing and escapes.

    Null for a payload that is null or no JSON object.
    """
    schema = ", ".join(f"{f} string" for f in fields) + ", bad string"
    o = F.from_json(payload, schema, {"columnNameOfCorruptRecord": "bad"})
    key = canonical([bare(o.getField(f)) if f in loose else o.getField(f) for f in fields])
    return F.when(o.isNotNull() & o.getField("bad").isNull() & F.ltrim(payload).startswith("{"), key)


@F.pandas_udf(T.IntegerType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the common beginning of two byte strings."""

    def one(x: bytes, y: bytes) -> int:
        n = min(len(x), len(y))
        return next((i for i in range(n) if x[i] != y[i]), n)

    return pd.Series([one(bytes(x), bytes(y)) for x, y in zip(a, b, strict=True)], dtype="int32")


def _put(root: dict, key: bytes, row: int) -> None:
    """Add a row to a trie. A leaf holds the rest of its key and the rows that end there; it is
    opened into a node when a key arrives that shares its edge but not its rest."""
    node, at = root, 0
    while True:
        edge = key[at : at + EDGE]
        at += EDGE
        below = node.get(edge)
        if below is None:
            node[edge] = [key[at:], [row]]
            return
        if type(below) is list:
            rest, rows = below
            if rest == key[at:]:
                rows.append(row)
                return
            below = node[edge] = {rest[:EDGE]: [rest[EDGE:], rows]}
        node = below


def _terminals(node: dict) -> Iterator[list[int]]:
    stack = [node]
    while stack:
        for below in stack.pop().values():
            if type(below) is list:
                yield below[1]
            else:
                stack.append(below)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, kept, copies) for rows that come sorted by bucket; one bucket's trie is held at a time."""

    def emit(root: dict) -> pa.RecordBatch:
        row, kept, copies = [], [], []
        for rows in _terminals(root):
            row += rows
            kept += [min(rows)] * len(rows)
            copies += [len(rows)] * len(rows)
        return pa.record_batch([pa.array(row, pa.int64()), pa.array(kept, pa.int64()), pa.array(copies, pa.int64())], names=["row", "kept", "copies"])

    root: dict = {}
    now = None
    for batch in batches:
        for bucket, key, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if bucket != now:
                if root:
                    yield emit(root)
                root, now = {}, bucket
            _put(root, key, row)
    if root:
        yield emit(root)


def grouped_copies(df: DataFrame, id_col: str, key: Column, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Columns ``id_col``, ``kept_id`` (least id of the rows with the same key) and ``copies`` (their number).

    Rows whose key is null are left out; a row that is there twice counts twice. Keys are split by their first bytes; a bucket that is too
    large is split by the bytes after its common beginning, and so on. A bucket that stays too
    large holds one key only: its rows get their result from its counters, without being gathered.
    """
    rows, _ = written(df.select(F.col(id_col).alias("row"), key.alias("key")).filter(F.col("key").isNotNull()).withColumn("bucket", F.substring("key", 1, 4)), "radix")
    fitting: list[DataFrame] = []
    single: list[DataFrame] = []
    while True:
        sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"), F.sum(F.length("key")).alias("bytes"))
        over, _ = written(sizes.filter((F.col("c") > bucket_rows) | ((F.col("bytes") > bucket_bytes) & (F.col("c") > 1))).select("bucket", "c"), "over")
        n = over.agg(F.sum("c")).first()[0] or 0
        if not n:
            fitting.append(rows)
            break
        fitting.append(rows.join(over.select("bucket"), "bucket", "left_anti"))
        large = joined(rows, over, ["bucket"], n)
        ends = large.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"), F.min("key").alias("lo"), F.max("key").alias("hi"), F.min("row").alias("kept"))
        ends, _ = written(ends.select("bucket", "c", "kept", (F.col("lo") == F.col("hi")).alias("one_key"), (_common("lo", "hi") + 2).alias("depth")), "ends")
        one = ends.filter("one_key").select("bucket", "c", "kept", F.col("c").alias("copies"))
        single.append(joined(large, one, ["bucket"], n).select("row", "kept", "copies"))
        deeper = joined(large, ends.filter(~F.col("one_key")).select("bucket", "c", "depth"), ["bucket"], n)
        rows, _ = written(deeper.select("row", "key", F.expr("substring(key, 1, depth)").alias("bucket")), "radix")
    parts = fitting[0].select("bucket", "key", "row")
    for p in fitting[1:]:
        parts = parts.unionByName(p.select("bucket", "key", "row"))
    out = parts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_counted, "row bigint, kept bigint, copies bigint")
    for s in single:
        out = out.unionByName(s)
    return out.select(F.col("row").alias(id_col), F.col("kept").alias("kept_id"), "copies")


def comment_key(author: str = "author_name", text: str = "text_raw") -> Column:
    """Author and text without case, white space and punctuation; null where the author is null."""
    return F.when(F.col(author).isNotNull(), canonical([bare(F.col(author)), bare(F.col(text))]))


def copies_of(df: DataFrame, id_col: str, key: Column, **sizes: int) -> DataFrame:
    """Columns ``kept_id`` and ``copy_id``: one row for every row of a group but the kept one."""
    return grouped_copies(df, id_col, key, **sizes).filter(F.col(id_col) != F.col("kept_id")).select("kept_id", F.col(id_col).alias("copy_id"))


def collapsed(df: DataFrame, id_col: str, key: Column, **sizes: int) -> DataFrame:
    """Columns ``kept_id`` and ``copies``: one row for every group, single rows included."""
    return grouped_copies(df, id_col, key, **sizes).filter(F.col(id_col) == F.col("kept_id")).select("kept_id", "copies")
