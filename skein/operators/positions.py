"""Positions inside topics: groups of close comments, the rest to the nearest group or undetermined."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.operators import clusters as C
from skein.operators.fit import MOST, sample_and_rest, sub_clusters, unit_rows
from skein.settings import DEFAULT, Settings

UNDETERMINED = "undetermined"


def resolved(labels: np.ndarray, unit: np.ndarray, s: Settings = DEFAULT) -> np.ndarray:
    """Group keys of all rows: groups that are too small are dissolved; their rows and noise join the
    nearest group if it is near and clearly nearer than the next one, and are undetermined otherwise."""
    n = len(labels)
    least = max(2, math.ceil(0.03 * n))
    kept = [k for k in sorted(set(labels.tolist()) - {-1}) if (labels == k).sum() >= least]
    out = np.full(n, UNDETERMINED, object)
    if not kept:
        return out
    for j, k in enumerate(kept):
        out[labels == k] = f"position_{j + 1}"
    near = unit @ unit_rows(np.stack([unit[labels == k].mean(axis=0) for k in kept])).T
    order = np.sort(near, axis=1)
    margin = order[:, -1] - (order[:, -2] if len(kept) > 1 else -1.0)
    free = (out == UNDETERMINED) & (order[:, -1] >= s.position_cosine) & (margin >= s.position_margin)
    out[free] = [f"position_{j + 1}" for j in near[free].argmax(axis=1)]
    return out


def assigned_positions(points: DataFrame, video: str, topic: str, s: Settings = DEFAULT, most: int = MOST) -> DataFrame:
    """Columns ``video``, ``topic``, id, position: every row of a topic has one position.

    One task groups one topic, of which the ``most`` rows with the least hashes of their ids at most. Rows
    beyond go to the nearest position, if it is near enough, whatever the margin, else they are undetermined.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        unit = unit_rows(np.stack(part["v"].to_numpy()))
        return part[[video, topic, "id"]].assign(position=resolved(sub_clusters(unit), unit, s))

    kind = dict(points.dtypes)
    p = points.select(video, topic, "id", "v").withColumn("_group", F.struct(video, topic))
    first, rest = sample_and_rest(p, "_group", "id", most)
    grouped = first.drop("_group").groupBy(video, topic).applyInPandas(run, f"{video} {kind[video]}, {topic} {kind[topic]}, id {kind['id']}, position string")
    named = grouped.filter(F.col("position") != UNDETERMINED).select("id", "position").join(first.select(video, topic, "id", "v"), "id")
    centers = C.centroids(named, [video, topic, "position"]).withColumn("at", F.regexp_extract("position", r"(\d+)$", 1).cast("int"))
    near = C.nearest_two(rest.drop("_group"), centers, "at", run=[video, topic])
    joined = F.when(F.col("primary_cos") >= s.position_cosine, F.concat(F.lit("position_"), F.col("primary").cast("string"))).otherwise(UNDETERMINED)
    return grouped.unionByName(near.select(video, topic, "id", joined.alias("position")))


def position_table(assigned: DataFrame, weights: DataFrame, video: str, topic: str) -> DataFrame:
    """Count, share and weighted share of each position; the shares of a topic add up to 100. Undetermined comes last."""
    g = assigned.join(weights.select("id", "weight"), "id").groupBy(video, topic, "position").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))
    w = W.partitionBy(video, topic)
    last = F.col("position") == UNDETERMINED
    return g.select(video, topic, "position", "n", (100.0 * F.col("n") / F.sum("n").over(w)).alias("pct"), (100.0 * F.col("weight") / F.sum("weight").over(w)).alias("weighted_pct"), F.row_number().over(w.orderBy(last, F.desc("n"), "position")).alias("sort_order"))
