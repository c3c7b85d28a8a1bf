"""Clusters that are fitted to vectors; checked by their invariants, as seeds and ties are free."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import vectors as V
from skein.operators import clusters as C
from skein.operators import fit
from skein.operators import topics as K
from skein.plans.registry import query
from skein.plans.vectors import points
from skein.sources import table


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points with the video of their comment; a vector without a comment has no video and is left out."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), V.doubles(F.col("embedding")).alias("v"))
    return e.join(table(spark, sf_dir, "raw_comments").select(F.col("comment_id").alias("id"), F.col("video_id").cast("bigint").alias("video_id")), "id")


@query("vec_01_fit_clusters")
def vec_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignments of all points; those that the quality filter or the collapse removes have a null key."""
    weights = points(spark, sf_dir).select("id", "weight")
    return fit.fit_clusters(_grouped(spark, sf_dir).join(weights, "id"), "video_id", weight="weight")


@query("vec_02_principal_components")
def vec_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).select("id", array_to_vector("v").alias("v"))
    return PCA(k=8, inputCol="v", outputCol="r").fit(p).transform(p).select("id", vector_to_array("r").alias("reduced"))


@query("vec_05_silhouette")
def vec_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Euclidean silhouette of the given labels in each group."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"video_id": part["video_id"].iloc[:1], "silhouette": [fit.silhouette(np.stack(part["v"].to_numpy()), part["label"].to_numpy())]})

    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return _grouped(spark, sf_dir).join(labels, "id").groupBy("video_id").applyInPandas(run, "video_id bigint, silhouette double")


@query("vec_17_sub_clusters")
def vec_17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions inside each given cluster of each group."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        return part[["video_id", "label", "id"]].assign(position=fit.sub_clusters(np.stack(part["v"].to_numpy())).astype("int32"))

    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return _grouped(spark, sf_dir).join(labels, "id").groupBy("video_id", "label").applyInPandas(run, "video_id bigint, label int, id bigint, position int")


@query("vec_16_merge_clusters")
def vec_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar clusters of a run merged until nothing changes; a run has few clusters, so one task holds them."""
    words = points(spark, sf_dir).select("id", "label").join(table(spark, sf_dir, "raw_comments").select(F.col("comment_id").alias("id"), F.col("text_raw").alias("text")), "id")
    words = K.keywords(words, ["label"], "text", most=8).groupBy("label").agg(F.collect_list("token").alias("keywords"))
    c = C.centroids(points(spark, sf_dir), ["label"]).join(words, "label").withColumn("run", F.lit(1))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("label")
        home = fit.merged_clusters(np.stack(part["centroid"].to_numpy()), part["size"].to_numpy(), [set(k) for k in part["keywords"]])
        labels = part["label"].to_numpy()
        return pd.DataFrame({"label": labels, "merged_into": labels[home]})

    return c.groupBy("run").applyInPandas(run, "label int, merged_into int")


@query("join_14_merge_pairs")
def join_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = points(spark, sf_dir).select("id", "label").join(table(spark, sf_dir, "raw_comments").select(F.col("comment_id").alias("id"), F.col("text_raw").alias("text")), "id")
    words = K.keywords(words, ["label"], "text", most=8).groupBy("label").agg(F.collect_list("token").alias("keywords"))
    return C.merge_pairs(C.centroids(points(spark, sf_dir), ["label"]).join(words, "label"), "label")
