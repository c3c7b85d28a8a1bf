"""Comparison of clusterings by several embedding models: results of each video, their means, a composite score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEASURES = ("comment_count", "cluster_count", "emerging_cluster_count", "cluster_confidence", "ambiguous_share_pct", "cluster_size", "max_cluster_share_pct")


def composite_score(confidence: Column, ambiguous: Column, largest: Column, clusters: Column, emerging: Column) -> Column:
    """Confidence and clear assignments count most, then even sizes and up to twelve clusters; emerging ones cost."""
    clear = lambda c: F.greatest(F.lit(0.0), F.lit(100.0) - c)
    # rounded twice, so that what is a tie but for the last bits is a tie
    return F.round(F.round(confidence * 45.0 + clear(ambiguous) * 0.35 + clear(largest) * 0.10 + F.least(clusters, F.lit(12.0)) * 0.8 - emerging * 1.5, 9), 3)


def video_results(members: DataFrame, keys: tuple[str, ...] = ("model", "video_id"), cluster: str = "cluster", least: int = 1) -> DataFrame:
    """Measures of each model and video from members (``keys``, cluster, confidence, is_ambiguous, is_emerging); videos with fewer than ``least`` comments are left out."""
    c = members.groupBy(*keys, cluster).agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("confidence"), F.count_if("is_ambiguous").alias("ambiguous"), F.max("is_emerging").alias("emerging"))
    total = F.sum("n")
    g = c.groupBy(*keys).agg(
        total.alias("comment_count"), F.count(F.lit(1)).alias("cluster_count"), F.count_if("emerging").alias("emerging_cluster_count"), F.round(F.avg("confidence"), 4).alias("cluster_confidence"),
        F.round(F.lit(100.0) * F.sum("ambiguous") / total, 2).alias("ambiguous_share_pct"), F.round(F.avg("n"), 2).alias("cluster_size"), F.round(F.lit(100.0) * F.max("n") / total, 2).alias("max_cluster_share_pct"),
    )
    return g.filter(F.col("comment_count") >= least)


def summaries(results: DataFrame, model: str = "model") -> DataFrame:
    """Means of the measures of each model over its videos, and the composite score."""
    digits = {"cluster_confidence": 4}
    g = results.groupBy(model).agg(F.count(F.lit(1)).alias("videos_evaluated"), *[F.round(F.avg(m), digits.get(m, 2)).alias(f"avg_{m}") for m in MEASURES])
    return g.withColumn("composite_score", composite_score(*[F.col(f"avg_{m}") for m in ("cluster_confidence", "ambiguous_share_pct", "max_cluster_share_pct", "cluster_count", "emerging_cluster_count")]))


def markdown(summary: DataFrame, model: str = "model") -> DataFrame:
    """Columns ``model`` and text: the section of each model in the benchmark's report."""
    text = F.format_string(
        "## %s\n- Videos evaluated: %d\n- Composite score: %.3f\n- Avg cluster confidence: %.3f\n- Avg ambiguous share: %.2f%%\n- Avg cluster count: %.2f\n- Avg max cluster share: %.2f%%\n",
        F.col(model), "videos_evaluated", "composite_score", F.round("avg_cluster_confidence", 3), "avg_ambiguous_share_pct", "avg_cluster_count", "avg_max_cluster_share_pct",
    )
    return summary.select(model, text.alias("text"))
