"""Tables written to the shared folder, to cut lineage where a result is used more than once.

The folder is the one that the session names in ``spark.checkpoint.dir``. Only where that is
unset and the master is this machine (tests), a folder of this process is made. Tables of rounds
are removed once the next round has its own; a table that a lazy result reads is removed by
``released``, or when the application ends.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.sources.scratch import hadoop, shared_dir

#: Rows of one key that one task of a shuffle join may take. Keys with more are joined without a shuffle.
CHUNK = 1_000_000
#: Keys in one broadcast. Keys with more than CHUNK rows are at most rows / CHUNK: one broadcast for 10^11 rows.
BLOCK = 100_000

_kept: set[str] = set()


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """``df`` after a round trip through a Parquet table of the shared folder, and its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skein/{tag}-{uuid.uuid4().hex}"
    _kept.add(path)
    df.write.parquet(path)
    files, p = hadoop(spark, path)
    files.deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, *paths: str) -> None:
    """Remove tables that no later plan reads."""
    for path in paths:
        files, p = hadoop(spark, path)
        files.delete(p, True)
        files.cancelDeleteOnExit(p)
        _kept.discard(path)


def swept(spark: SparkSession) -> None:
    """Let the driver forget the plans and broadcasts of a round: they are kept until it collects garbage,
    which a driver with rounds of small plans would put off until its memory is full."""
    spark.sparkContext._jvm.java.lang.System.gc()


def released(spark: SparkSession) -> int:
    """Remove the tables of all results so far, which must not be read any more; gives their number."""
    n = len(_kept)
    dropped(spark, *list(_kept))
    return n


def joined(rows: DataFrame, sized: DataFrame, on: list[str], n: int) -> DataFrame:
    """``rows`` joined with ``sized``, one row a key with its number of rows in column ``c`` (not kept).

    ``n`` is the number of ``rows``. A key with more than CHUNK rows would make one huge task of a
    shuffle join. Those keys are few by arithmetic and go by broadcasts of at most BLOCK keys each,
    so that their rows stay where they are; all others take the usual join.
    """
    value = [x for x in sized.columns if x not in on and x != "c"]
    plain = sized.filter(F.col("c") <= CHUNK).drop("c")
    if n <= CHUNK:
        return rows.join(plain, on)
    hot = sized.filter(F.col("c") > CHUNK).select(*on, F.struct(F.lit(True).alias("hot"), *value).alias("_hot"))
    blocks = -(-n // CHUNK // BLOCK)
    marked, found = rows, F.lit(None)
    for i in range(blocks):
        of = hot if blocks == 1 else hot.filter(F.pmod(F.xxhash64(*on), F.lit(blocks)) == i)
        marked = marked.join(F.broadcast(of.withColumnRenamed("_hot", f"_hot{i}")), on, "left")
        found = F.col("_hot0") if i == 0 else F.coalesce(found, F.col(f"_hot{i}"))
    marked = marked.select(*rows.columns, found.alias("_hot"))
    cold = marked.filter(F.col("_hot").isNull()).select(*rows.columns).join(plain, on)
    return cold.unionByName(marked.filter(F.col("_hot").isNotNull()).select(*rows.columns, *[F.col(f"_hot.{x}").alias(x) for x in value]))


def positioned(df: DataFrame, by: list[str], tag: str) -> tuple[DataFrame, int]:
    """``df`` with its 0-based ``position`` in the order of ``by`` (a unique key), and its number of rows.

    A range partitioning sorts across partitions; the partitions' row counts, one number each, are
    summed up on the driver and added to the places within partitions. ``df`` is written first, as
    the partitioning reads it twice, once to sample its bounds.
    """
    place = F.monotonically_increasing_id()
    df, aside = written(df, tag)
    rows, _ = written(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("place", place), tag)
    dropped(df.sparkSession, aside)
    part = F.shiftright("place", 33).cast("int")
    n = {r["part"]: r["n"] for r in rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, offsets = 0, []
    for p in sorted(n):
        offsets.append((p, before))
        before += n[p]
    small = F.broadcast(df.sparkSession.createDataFrame(offsets, "part int, before bigint"))
    out = rows.withColumn("part", part).join(small, "part").withColumn("position", F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1))
    return out.drop("part", "before", "place"), before
