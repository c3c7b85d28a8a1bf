"""Relational operators of the read models: latest rows, upserts, null-aware anti joins, sampling, budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order``: a maximum of structs, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return top.select(*keys, *[F.col(f"row.{c}").alias(c) for c in rest])


def upsert(old: DataFrame, new: DataFrame, key: str, ordinal: str, insert_only: Sequence[str] = ()) -> DataFrame:
    """``old`` with the rows of ``new``: a known key takes the new values, except of ``insert_only`` columns.

    Of rows of ``new`` with one key the last by ``ordinal`` holds, but for ``insert_only`` the first.
    """
    value = [c for c in new.columns if c not in (key, ordinal, *insert_only)]
    last = new.groupBy(key).agg(*[F.max_by(c, ordinal).alias(c) for c in value], *[F.min_by(c, ordinal).alias(c) for c in insert_only])
    o = old.select(key, *[F.col(c).alias(f"old_{c}") for c in (*value, *insert_only)], F.lit(True).alias("there"))
    n = last.withColumn("fresh", F.lit(True))
    joined = o.join(n, key, "full")
    kept = [F.when(F.col("fresh"), F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in value]
    first = [F.when(F.col("there"), F.col(f"old_{c}")).otherwise(F.col(c)).alias(c) for c in insert_only]
    return joined.select(key, *kept, *first)


def insert_absent(old: DataFrame, new: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The rows of ``new`` to append: first row of each key that ``old`` lacks."""
    first = new.groupBy(key).agg(F.min_by(F.struct(*[c for c in new.columns if c != key]), ordinal).alias("row"))
    return first.join(old.select(key), key, "left_anti").select(key, "row.*")


def without_identities(df: DataFrame, banned: DataFrame, channel: str, name: str) -> DataFrame:
    """Rows of no banned identity: the channel where the row has one, else the name among bans without channel.

    Two anti joins on plain keys; null keys match nothing, as a NOT IN would not guarantee.
    """
    b = banned.select(F.col(channel).alias("b_channel"), F.col(name).alias("b_name"))
    by_channel = b.filter(F.col("b_channel").isNotNull()).select("b_channel").distinct()
    by_name = b.filter(F.col("b_channel").isNull() & F.col("b_name").isNotNull()).select("b_name").distinct()
    left = df.join(by_channel, F.col(channel) == F.col("b_channel"), "left_anti")
    return left.join(by_name, F.col(channel).isNull() & (F.col(name) == F.col("b_name")), "left_anti")


def every_nth(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], target: int) -> DataFrame:
    """About ``target`` evenly spaced rows of each key in its order."""
    w = W.partitionBy(*keys)
    n = df.withColumns({"place": F.row_number().over(w.orderBy(*order)), "n": F.count(F.lit(1)).over(w)})
    step = F.greatest(F.lit(1), F.floor(F.col("n") / target)).cast("int")
    kept = n.filter(((F.col("place") - 1) % step == 0) & (F.floor((F.col("place") - 1) / step) < target))
    return kept.drop("place", "n")


def within_budget(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], size: str, budget: int) -> DataFrame:
    """Rows of each key in order while their running size is below the budget; the last is cut to what is left."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum(size).over(w), F.lit(0))
    return df.withColumn("used", before).filter(F.col("used") < budget).withColumn("taken", F.least(F.col(size), F.lit(budget) - F.col("used"))).drop("used")


def batches(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], size: int) -> DataFrame:
    """Number of the batch of ``size`` rows, from 0, and of the row within it, from 1."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("batch", F.floor(place / size)).withColumn("number", place % size + 1)


def unioned_samples(samples: Sequence[DataFrame], key: str, ordinal: str, cap: int | None = None) -> DataFrame:
    """Samples one after another without repeated keys; earlier samples and rows come first."""
    rows = None
    for i, s in enumerate(samples):
        part = s.withColumn("sample", F.lit(i))
        rows = part if rows is None else rows.unionByName(part)
    first = rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), F.struct("sample", ordinal)).alias("row"))
    out = first.select(key, "row.*")
    return out if cap is None else out.orderBy("sample", ordinal).limit(cap)
