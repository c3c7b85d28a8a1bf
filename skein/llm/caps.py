"""Problem 5: capping records per dominant contributor (global range sort, prefix sums)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.store import written

PLACES = "part int, k bigint, place bigint, continued boolean, author string, n bigint"


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of each author within a sorted partition; columns after k and author are carried along.

    Rows of the partition's first author are marked as continued, as earlier partitions may hold
    more of them. At the end come two rows without k: the first author with the size of the
    first run, and the last author with the size of the last run.
    """
    part = TaskContext.get().partitionId()
    first = last = None
    run = first_run = total = 0
    whole = True
    schema = pa.schema([("part", pa.int32()), ("k", pa.int64()), ("place", pa.int64()), ("continued", pa.bool_()), ("author", pa.string()), ("n", pa.int64())])
    for batch in batches:
        m = batch.num_rows
        if not m:
            continue
        author = batch.column("author")
        starts = np.zeros(m, bool)
        starts[1:] = np.asarray(pc.not_equal(author[1:], author[:-1]).to_pylist() if m > 1 else [], bool)
        head = author[0].as_py()
        starts[0] = total == 0 or head != last
        if total == 0:
            first = head
        at = np.where(starts, np.arange(m), -1)
        at = np.maximum.accumulate(at)
        place = np.where(at < 0, np.arange(m) + run, np.arange(m) - at)
        new = np.flatnonzero(starts)
        if total == 0:
            ends = int(new[1]) if len(new) > 1 else m
        else:
            ends = (int(new[0]) if len(new) else m) if whole else 0
        continued = np.arange(m) < ends
        first_run += ends
        whole = whole and ends == m
        run = int(place[-1]) + 1
        last = author[m - 1].as_py()
        total += m
        more = list(batch.schema)[2:]
        full = pa.schema([*schema, *more])
        yield pa.record_batch([pa.array(np.full(m, part, np.int32)), batch.column("k"), pa.array(place), pa.array(continued), pa.nulls(m, pa.string()), pa.nulls(m, pa.int64()), *batch.columns[2:]], schema=full)
    if total:
        yield pa.record_batch([[part] * 2, [None] * 2, [0, 1], [whole] * 2, [first, last], [first_run, run], *[pa.nulls(2, f.type) for f in more]], schema=full)


def ranked_places(df: DataFrame, id_col: str, author: Column, order: Sequence[Column], carried: Sequence[str] = ()) -> DataFrame:
    """Columns ``id_col``, ``carried`` and ``place``: 0 for the author's first row by ``order``, 1 for the next.

    Rows whose author is null are left out; ``order`` must end in a unique column. One range
    partitioning by author and order spreads even an author with a third of all rows over several
    tasks. To the driver come two small rows a partition, from which prefix sums give each
    partition's offset in the author that goes on from the partition before.
    """
    spark = df.sparkSession
    names = [f"o{i}" for i in range(len(order))]
    rows = df.select(F.col(id_col).alias("k"), author.alias("author"), *[c.alias(n) for c, n in zip(order, names, strict=True)], *[F.col(c).alias(f"c{i}") for i, c in enumerate(carried)]).filter(F.col("author").isNotNull())
    by = [F.col("author"), *[F.col(n) for n in names]]
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by).select("k", "author", *[f"c{i}" for i in range(len(carried))])
    kinds = "".join(f", c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(carried))
    places, _ = written(ordered.mapInArrow(_numbered, PLACES + kinds), "places")
    moved: list[tuple[int, int]] = []
    open_author, open_run = None, 0
    ends: dict[int, dict[int, tuple[str, int, bool]]] = {}
    for r in places.filter(F.col("k").isNull() & F.col("n").isNotNull()).collect():  # two rows a partition
        ends.setdefault(r["part"], {})[r["place"]] = (r["author"], r["n"], r["continued"])
    for part in sorted(ends):
        (head, _, whole), (tail, last_run, _) = ends[part][0], ends[part][1]
        before = open_run if head == open_author else 0
        moved.append((part, before))
        open_author, open_run = tail, last_run + (before if whole else 0)
    offsets = F.broadcast(spark.createDataFrame(moved, "part int, before bigint"))
    places = places.filter(F.col("n").isNull()).join(offsets, "part")
    return places.select(F.col("k").alias(id_col), *[F.col(f"c{i}").alias(c) for i, c in enumerate(carried)], (F.col("place") + F.when(F.col("continued"), F.col("before")).otherwise(0)).alias("place"))


def over_cap(df: DataFrame, id_col: str, author: Column, order: Sequence[Column], cap: int | None = None, share: float | None = None) -> DataFrame:
    """Column ``id_col`` of the rows that go when each author keeps ``cap`` rows, or ``share`` of all rows
    (rounded down, one at least); the smaller limit holds if both are given. Rows without author stay.

    Null values of ``order`` come first. Rows that are there twice take two places, in any order.
    An empty table gives an empty result.
    """
    limits = [x for x in (cap, None if share is None else max(1, int(df.count() * share))) if x is not None]
    if not limits or min(limits) < 0:
        raise ValueError("cap or share must be given, and not below 0")
    return ranked_places(df, id_col, author, order).filter(F.col("place") >= min(limits)).select(id_col)
