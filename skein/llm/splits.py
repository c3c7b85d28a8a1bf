"""Problem 1: splits that keep related records together (hash-to-min components)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.keys import bare
from skein.llm.store import dropped, joined, written


def _print_of(rows: DataFrame) -> tuple[int, int, int]:
    """Number of rows and two sums of hashes: equal sets of rows have equal prints."""
    half = [F.sum(F.xxhash64(F.lit(s), "u", "v").bitwiseAND(0x7FFFFFFF)).alias(f"h{s}") for s in (1, 2)]
    r = rows.agg(F.count(F.lit(1)).alias("n"), *half).first()
    return r["n"], r["h1"], r["h2"]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Columns ``node`` and ``component`` (its least node) for the nodes of ``edges`` (u bigint, v bigint).

    Hash-to-min: a cluster is kept as rows (node, member), never as one value. In each round a
    node sends its cluster to the cluster's least member, and that member to the whole cluster,
    until the rows stay the same. An edge with a null end is left out, a loop gives a node alone.
    """
    spark = edges.sparkSession
    e = edges.filter(F.col("u").isNotNull() & F.col("v").isNotNull()).select("u", "v")
    ends = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")), F.struct("u", F.col("u").alias("v")), F.struct(F.col("v").alias("u"), "v")))
    rows, path = written(e.select(ends.alias("e")).select("e.u", "e.v").distinct(), "clusters")
    state = _print_of(rows)
    for _ in range(rounds):
        least, aside = written(rows.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c")), "least")
        pairs = F.explode(F.array(F.struct(F.col("m").alias("u"), "v"), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        sent, new = written(joined(rows, least, ["u"], state[0]).select(pairs.alias("e")).select("e.u", "e.v").distinct(), "clusters")
        before, state = state, _print_of(sent)
        dropped(spark, path, aside)
        rows, path = sent, new
        if state == before:
            return rows.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    raise RuntimeError(f"clusters still change after {rounds} rounds")


def linked_rows(df: DataFrame, id_col: str, author: str, keys: Sequence[str]) -> DataFrame:
    """Columns ``id_col`` and ``group_id``: the least id among the rows linked with this one.

    Rows are linked by an author that differs only in case, white space and punctuation, or by an
    equal value of one of ``keys``; null links nothing. A row without links is its own group;
    equal ids are one row, a null id is left out. Each row is joined to the least id of each of
    its values, so that a value held by a third of the rows costs a star and no pairs. The empty
    name is a name like any other. An empty table gives an empty result.
    """
    values = [bare(F.col(author)), *[F.col(k).cast("string") for k in keys]]
    each = F.explode(F.array(*[F.struct(F.lit(w).alias("w"), x.alias("x")) for w, x in enumerate(values)]))
    links = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("i"), each.alias("l")).select("i", "l.w", "l.x").filter(F.col("x").isNotNull())
    links, path = written(links, "links")
    sized, sizes = written(links.groupBy("w", "x").agg(F.min("i").alias("v"), F.count(F.lit(1)).alias("c")), "values")
    found = components(joined(links, sized, ["w", "x"], links.count()).select(F.col("i").alias("u"), "v"))
    dropped(df.sparkSession, path, sizes)
    ids = df.filter(F.col(id_col).isNotNull()).select(id_col).distinct()
    return ids.join(found.withColumnRenamed("node", id_col), id_col, "left").select(id_col, F.coalesce("component", F.col(id_col)).alias("group_id"))


def rendezvous(key: Column, shares: Mapping[str, float], seed: int = 42) -> Column:
    """The split whose score -weight / ln(u) is highest, u being a hash of key and split in (0, 1)."""
    if not shares or min(shares.values()) < 0 or sum(shares.values()) <= 0:
        raise ValueError("shares must be at least 0, one of them more")

    def score(name: str, w: float) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(name), key), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
        return F.struct((-F.lit(float(w)) / F.log(u)).alias("score"), F.lit(name).alias("name"))

    return F.array_max(F.array(*[score(n, w) for n, w in shares.items() if w > 0])).getField("name")


def assign_splits(df: DataFrame, id_col: str, author: str, keys: Sequence[str], shares: Mapping[str, float], seed: int = 42) -> DataFrame:
    """Columns ``id_col``, ``group_id``, ``split``. A group is assigned as a whole, by its id alone,
    so that the assignment stays when other groups come or go. Shares hold for groups in
    expectation; a group that is larger than a split's share makes that split larger."""
    groups = linked_rows(df, id_col, author, keys)
    return groups.withColumn("split", rendezvous(F.col("group_id"), shares, seed))


def achieved(assigned: DataFrame, shares: Mapping[str, float]) -> DataFrame:
    """Columns split, n_groups, n, share, wanted, deviation of ``assign_splits``; a split without rows has 0."""
    total = sum(shares.values())
    wanted = assigned.sparkSession.createDataFrame([(k, float(v) / total) for k, v in shares.items()], "split string, wanted double")
    found = assigned.groupBy("split", "group_id").agg(F.count(F.lit(1)).alias("m")).groupBy("split").agg(F.count(F.lit(1)).alias("n_groups"), F.sum("m").alias("n"))
    out = F.broadcast(wanted).join(found, "split", "left")  # one row a split
    share = F.coalesce(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), F.lit(0.0))
    return out.select("split", F.coalesce("n_groups", F.lit(0)).alias("n_groups"), F.coalesce("n", F.lit(0)).alias("n"), share.alias("share"), "wanted").withColumn("deviation", F.col("share") - F.col("wanted"))
