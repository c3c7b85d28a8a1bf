"""Decisions of models, nested positions, topic pairs, labels and briefing parts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import clusters as C
from skein.operators import fit
from skein.operators import positions as Q
from skein.operators import topic_runs as R
from skein.plans.filters import like_sql, squeeze_sql, words_sql
from skein.plans.registry import query
from skein.plans.vectors import POINTS, points
from skein.sources import spread, table

@query("flt_23_video_candidates", "SELECT id FROM videos WHERE regexp_matches(lower(title), 'разбор|эфир') AND (duration_seconds IS NULL OR duration_seconds >= 120)")
def flt_23(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("duration_seconds")
    return table(spark, sf_dir, "videos").filter(F.lower("title").rlike("разбор|эфир") & (d.isNull() | (d >= 120))).select("id")


@query("flt_25_without_kind", "SELECT id, ban_reason FROM banned_users WHERE ban_reason <> 'toxic_auto'")
def flt_25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "banned_users").filter(F.col("ban_reason") != "toxic_auto").select("id", "ban_reason")


_ACT = squeeze_sql("lower(text_raw)")


@query("flt_26_practical_actions", f"SELECT comment_id FROM raw_comments WHERE len({words_sql(_ACT)}) >= 4 AND NOT {like_sql(_ACT, R.UNREALISTIC)} AND {like_sql(_ACT, R.PRACTICAL)}")
def flt_26(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.squeezed(F.lower("text_raw"))
    return spread(table(spark, sf_dir, "raw_comments")).filter((F.size(T.words(t)) >= 4) & ~t.rlike(R.UNREALISTIC) & t.rlike(R.PRACTICAL)).select("comment_id")


@query("flt_35_active_bans", "SELECT id, coalesce(author_channel_id, 'name:' || username) AS identity FROM banned_users WHERE unbanned_at IS NULL")
def flt_35(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "banned_users").filter(F.col("unbanned_at").isNull())
    return b.select("id", F.coalesce("author_channel_id", F.concat(F.lit("name:"), "username")).alias("identity"))


_TOK = "list_distinct(regexp_extract_all(lower(title), '[\\p{L}\\p{N}_]{4,}'))"


@query("srt_01_by_weighted_share", f"WITH {POINTS} SELECT label, round(sum(weight), 4) AS weight FROM p GROUP BY 1 ORDER BY weight DESC, label")
def srt_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).groupBy("label").agg(F.round(F.sum("weight"), 4).alias("weight")).orderBy(F.desc("weight"), "label")


@query("arr_01_explode_collect", "SELECT video_id, count(*) AS n, min(comment_id) AS first_id FROM raw_comments GROUP BY 1")
def arr_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "raw_comments").groupBy("video_id").agg(F.collect_list("comment_id").alias("ids"))
    return g.select("video_id", F.explode("ids").alias("comment_id")).groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), F.min("comment_id").alias("first_id"))


@query("arr_04_ordered_union", "SELECT video_id, string_agg(id::VARCHAR, ' ' ORDER BY tier, id) AS quotes FROM (SELECT video_id, id, min(tier) AS tier FROM (SELECT video_id, id, 0 AS tier FROM toxic_training_data WHERE labeled_by = 'admin' UNION ALL SELECT video_id, id, 1 FROM toxic_training_data) GROUP BY 1, 2) GROUP BY 1")
def arr_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched quotes first, then all others, each once, as a union of ordered arrays."""
    t = table(spark, sf_dir, "toxic_training_data")
    every = F.array_sort(F.collect_list("id"))
    first = F.array_sort(F.collect_list(F.when(F.col("labeled_by") == "admin", F.col("id"))))
    g = t.groupBy("video_id").agg(first.alias("a"), every.alias("b"))
    return g.select("video_id", F.array_join(F.transform(F.array_union("a", "b"), lambda x: x.cast("string")), " ").alias("quotes"))


@query("str_16_task_prefix", "SELECT comment_id, sha256('clustering: ' || text_raw) AS key FROM raw_comments")
def str_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "raw_comments").select("comment_id", T.text_hash(F.concat(F.lit("clustering: "), "text_raw")).alias("key"))


@query("lbl_12_supported_topic", "SELECT v.id, count(c.comment_id) AS support FROM videos v LEFT JOIN raw_comments c ON c.video_id = v.id AND contains(lower(c.text_raw), lower(regexp_extract(v.title, '[\\p{L}]{5,}'))) GROUP BY 1")
def lbl_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments that hold the first long word of the title."""
    v = table(spark, sf_dir, "videos").select("id", F.lower(F.regexp_extract("title", r"[\p{L}]{5,}", 0)).alias("word"))
    c = table(spark, sf_dir, "raw_comments").select(F.col("video_id").alias("id"), F.lower("text_raw").alias("low"))
    return v.join(c, "id", "left").groupBy("id").agg(F.count_if(F.contains(F.col("low"), F.col("word"))).alias("support"))


@query("src_12_last_reports", "SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ' ' ORDER BY o_orderdate, o_orderkey) AS reports FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders) WHERE place <= 6 GROUP BY 1")
def src_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last six rows of each key, oldest first."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    last = C.top_k(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 6)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))), lambda x: x["o_orderkey"].cast("string"))
    return last.groupBy("o_custkey").agg(F.array_join(ordered, " ").alias("reports"))


def _per_group(spark: SparkSession, sf_dir: str, run, schema: str) -> DataFrame:
    from skein.plans.fitted import _grouped

    return _grouped(spark, sf_dir).groupBy("video_id").applyInPandas(run, schema)


@query("vec_03_adaptive_grid")
def vec_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tries of the density grid with their share of noise and silhouette."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x = fit.unit_rows(np.stack(part.sort_values("id")["v"].to_numpy()))
        rows = []
        for size, samples, eps in fit.grid(len(x), fit.FitSettings()):
            labels, _ = fit.density_clusters(x, size, samples, eps)
            rows.append((part["video_id"].iloc[0], size, samples, eps, len(set(labels.tolist()) - {-1}), float((labels == -1).mean()), fit.silhouette(x, labels)))
        return pd.DataFrame(rows, columns=["video_id", "min_size", "samples", "epsilon", "clusters", "noise", "silhouette"])

    return _per_group(spark, sf_dir, run, "video_id bigint, min_size int, samples int, epsilon double, clusters int, noise double, silhouette double")


@query("vec_04_k_means")
def vec_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k from 2 to 10 with the silhouette of each."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x = fit.unit_rows(np.stack(part.sort_values("id")["v"].to_numpy()))
        rows = [(part["video_id"].iloc[0], k, fit.silhouette(x, fit.k_means(x, k, tries=2))) for k in range(2, 11) if k < len(x)]
        return pd.DataFrame(rows, columns=["video_id", "k", "silhouette"])

    return _per_group(spark, sf_dir, run, "video_id bigint, k int, silhouette double")


@query("vec_09_split_gate")
def vec_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a split of each group into three passes the gate."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x = fit.unit_rows(np.stack(part.sort_values("id")["v"].to_numpy()))
        labels = fit.k_means(x, min(3, len(x)))
        groups = [np.flatnonzero(labels == j) for j in range(3) if (labels == j).sum() >= 3]
        return pd.DataFrame([(part["video_id"].iloc[0], len(groups), fit.passes_gate(x, groups, fit.FitSettings()))], columns=["video_id", "groups", "passes"])

    return _per_group(spark, sf_dir, run, "video_id bigint, groups int, passes boolean")


def _topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.plans.fitted import _grouped

    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return _grouped(spark, sf_dir).join(labels, "id")


@query("lbl_04_positions")
def lbl_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of each topic of each video with their shares."""
    assigned = Q.assigned_positions(_topics(spark, sf_dir), "video_id", "label")
    return Q.position_table(assigned, points(spark, sf_dir), "video_id", "label")


@query("set_04_subset", "SELECT a.video_id, len(list_filter(a.l, lambda x: NOT list_contains(b.l, x))) = 0 AS is_subset FROM (SELECT video_id, list(DISTINCT author_name) AS l FROM toxic_training_data WHERE author_name IS NOT NULL GROUP BY 1) a JOIN (SELECT video_id, list(DISTINCT author_name) AS l FROM raw_comments WHERE author_name IS NOT NULL GROUP BY 1) b USING (video_id)")
def set_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all labelled authors of a video comment there: an anti join, as author sets may be large."""
    labelled = table(spark, sf_dir, "toxic_training_data").filter(F.col("author_name").isNotNull()).select("video_id", "author_name").distinct()
    authors = table(spark, sf_dir, "raw_comments").filter(F.col("author_name").isNotNull()).select("video_id", "author_name").distinct()
    missing = labelled.join(authors, ["video_id", "author_name"], "left_anti").groupBy("video_id").agg(F.count(F.lit(1)).alias("missing"))
    both = labelled.select("video_id").distinct().join(authors.select("video_id").distinct(), "video_id")
    return both.join(missing, "video_id", "left").select("video_id", F.col("missing").isNull().alias("is_subset"))


@query("api_02_statuses", "SELECT v.id, coalesce(r.o_orderstatus, 'none') AS status FROM videos v LEFT JOIN (SELECT o_custkey, max_by(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1) r ON r.o_custkey = v.id")
def api_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max_by("o_orderstatus", "o_orderkey").alias("status"))
    return table(spark, sf_dir, "videos").select("id").join(runs, "id", "left").select("id", F.coalesce("status", F.lit("none")).alias("status"))


@query("api_04_latest_report", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def api_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    return o.agg(F.max_by(F.struct("o_orderkey", "o_custkey"), F.struct("o_orderdate", "o_orderkey")).alias("o")).select("o.*")


@query("vec_08_noise_split")
def vec_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The noise of each video's fit; large noise is split in up to three groups, where the gate lets them pass."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        x, s = fit.unit_rows(np.stack(part["v"].to_numpy())), fit.FitSettings()
        if len(x) < max(3, s.min_size):  # nothing is fitted to so few rows
            return part[["video_id", "id"]].iloc[:0].assign(cluster_key="")
        noise = fit.assigned(x, s).labels == -1
        keys = np.full(len(x), "emerging_other", object)
        fit.split_noise(x, noise, keys, s)
        return part[["video_id", "id"]].assign(cluster_key=keys)[noise]

    return _per_group(spark, sf_dir, run, "video_id bigint, id bigint, cluster_key string")
