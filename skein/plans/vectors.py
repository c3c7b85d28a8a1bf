"""Vectors and given clusters: the label of an embedding stands for a cluster found before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions import vectors as V
from skein.operators import clusters as C
from skein.plans.registry import query
from skein.settings import DEFAULT as S
from skein.sources import table

#: Points: vector, label, and weight and engagement of the comment with the same id.
POINTS = """p AS (SELECT e.vec_id AS id, e.label, e.embedding::DOUBLE[] AS v, coalesce(c.like_count, 0) AS likes, coalesce(c.reply_count, 0) AS replies,
    1 + least(coalesce(c.like_count, 0), 100) * 0.03::DOUBLE + least(coalesce(c.reply_count, 0), 30) * 0.08::DOUBLE AS weight
  FROM embeddings e LEFT JOIN raw_comments c ON c.comment_id = e.vec_id)"""
CENTERS = """x AS (SELECT label, i, avg(v[i]) AS m FROM p, generate_series(1, 64) g(i) GROUP BY label, i),
c AS (SELECT label, list(m ORDER BY i) AS centroid FROM x GROUP BY label)"""
NEAR = """n AS (SELECT p.id, p.label, p.weight, c.label AS center, list_cosine_similarity(p.v, c.centroid) AS cos FROM p, c),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(cos, 9) DESC, center) AS place FROM n),
w AS (SELECT a.id, a.label, a.weight, a.center AS primary_label, a.cos AS primary_cos, b.center AS secondary_label, b.cos AS secondary_cos FROM r a LEFT JOIN r b ON b.id = a.id AND b.place = 2 WHERE a.place = 1)"""
OWN = "o AS (SELECT p.*, list_cosine_similarity(p.v, c.centroid) AS cos FROM p JOIN c USING (label))"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", V.doubles(F.col("embedding")).alias("v"))
    c = table(spark, sf_dir, "raw_comments").select(F.col("comment_id").alias("id"), "like_count", "reply_count")
    likes, replies = F.coalesce("like_count", F.lit(0)), F.coalesce("reply_count", F.lit(0))
    weight = 1 + F.least(likes, F.lit(100)) * 0.03 + F.least(replies, F.lit(30)) * 0.08
    return e.join(c, "id", "left").select("id", "label", "v", likes.alias("likes"), replies.alias("replies"), weight.alias("weight"))


def near(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return C.nearest_two(p.select("id", "label", "weight", "v"), C.centroids(p, ["label"]), "label")


@query("mth_01_cosine", f"WITH {POINTS} SELECT a.id, round(list_cosine_similarity(a.v, b.v), 6) AS cos FROM p a JOIN p b ON b.id = a.id + 1")
def mth_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    b = p.select((F.col("id") - 1).alias("id"), F.col("v").alias("u"))
    return p.join(b, "id").select("id", F.round(V.cosine(F.col("v"), F.col("u")), 6).alias("cos"))


@query("mth_02_unit", f"WITH {POINTS} SELECT id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS first_element FROM p")
def mth_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("id", F.round(V.norm(F.col("v")), 6).alias("norm"), F.round(F.get(V.unit(F.col("v")), F.lit(0)), 6).alias("first_element"))


@query("agg_04_cluster_stats", f"WITH {POINTS} SELECT label, count(*) AS size, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 4) AS share_pct, round(100.0::DOUBLE * sum(weight) / sum(sum(weight)) OVER (), 4) AS weighted_share FROM p GROUP BY label")
def agg_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = C.cluster_stats(points(spark, sf_dir), ["label"])
    return s.select("label", "size", F.round("share_pct", 4).alias("share_pct"), F.round("weighted_share", 4).alias("weighted_share"))


@query("agg_05_centroid", f"WITH {POINTS}, {CENTERS} SELECT label, i - 1 AS at, round(m, 6) AS mean FROM x")
def agg_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = C.centroids(points(spark, sf_dir), ["label"]).select("label", F.posexplode("centroid").alias("at", "mean"))
    return c.select("label", F.col("at").cast("bigint").alias("at"), F.round("mean", 6).alias("mean"))


@query("agg_06_coherence", f"WITH {POINTS}, {CENTERS}, {OWN} SELECT label, round(greatest(0, least(1, avg(cos))), 6) AS coherence FROM o GROUP BY label")
def agg_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.coherence(points(spark, sf_dir), ["label"]).select("label", F.round("coherence", 6).alias("coherence"))


@query("agg_07_weighted_coherence", f"WITH {POINTS}, {CENTERS}, {OWN} SELECT label, round(greatest(0, least(1, sum(cos * greatest(0.1, weight)) / sum(greatest(0.1, weight)))), 6) AS weighted_coherence FROM o GROUP BY label")
def agg_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.coherence(points(spark, sf_dir), ["label"]).select("label", F.round("weighted_coherence", 6).alias("weighted_coherence"))


_DIAGNOSED = f"""WITH {POINTS}, {CENTERS}, {NEAR}, d AS (SELECT *, least(1.0, greatest(primary_cos, 0.0)) AS confidence FROM w),
g AS (SELECT *, confidence < {S.ambiguous_confidence} OR confidence - coalesce(secondary_cos, 0) < {S.ambiguous_margin} AS is_ambiguous, primary_cos >= {S.soft_assign} AS is_soft FROM d)"""


@query("join_13_two_nearest", f"WITH {POINTS}, {CENTERS}, {NEAR} SELECT id, primary_label, round(primary_cos, 5) AS primary_cos, secondary_label, round(secondary_cos, 5) AS secondary_cos FROM w")
def join_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near(spark, sf_dir).select("id", F.col("primary").alias("primary_label"), F.round("primary_cos", 5).alias("primary_cos"), F.col("secondary").alias("secondary_label"), F.round("secondary_cos", 5).alias("secondary_cos"))


@query("win_07_margin", f"WITH {POINTS}, {CENTERS}, {NEAR} SELECT id, round(primary_cos - secondary_cos, 5) AS margin FROM w")
def win_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near(spark, sf_dir).select("id", F.round(F.col("primary_cos") - F.col("secondary_cos"), 5).alias("margin"))


@query("vec_06_diagnostics", f"{_DIAGNOSED} SELECT id, primary_label, round(confidence, 5) AS confidence, is_ambiguous FROM g")
def vec_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.diagnostics(near(spark, sf_dir)).select("id", F.col("primary").alias("primary_label"), F.round("confidence", 5).alias("confidence"), "is_ambiguous")


@query("vec_07_soft_assign", f"{_DIAGNOSED} SELECT id, CASE WHEN is_soft THEN primary_label END AS assigned FROM g")
def vec_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.diagnostics(near(spark, sf_dir)).select("id", F.when(F.col("is_soft"), F.col("primary")).alias("assigned"))


@query("agg_08_run_metrics", f"{_DIAGNOSED} SELECT round(avg((NOT is_soft)::INT), 6) AS noise_ratio, round(avg(confidence), 6) AS mean_confidence, round(avg(is_ambiguous::INT), 6) AS ambiguous_share FROM g")
def agg_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = C.diagnostics(near(spark, sf_dir))
    return d.agg(F.round(F.avg((~F.col("is_soft")).cast("int")), 6).alias("noise_ratio"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.round(F.avg(F.col("is_ambiguous").cast("int")), 6).alias("ambiguous_share"))


_REPRESENTATIVE = f"""WITH {POINTS}, {CENTERS}, {OWN},
s AS (SELECT *, count(*) OVER (PARTITION BY label) AS n, round(cos * 0.7::DOUBLE + coalesce(weight / nullif(max(weight) OVER (PARTITION BY label), 0), 0) * 0.3::DOUBLE, 6) AS score FROM o),
k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, id) AS place, least(n, greatest(8, least(30, round_even(sqrt(n), 0)::INT))) AS most FROM s)"""


@query("win_03_representatives", f"{_REPRESENTATIVE} SELECT label, id, score FROM k WHERE place <= most")
def win_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.representatives(points(spark, sf_dir), ["label"]).select("label", "id", "score")


@query("win_04_alternative_representatives", f"WITH {POINTS}, {CENTERS}, {OWN}, s AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(weight + cos, 6) DESC, id) AS place FROM o) SELECT label, id, round(weight + cos, 6) AS score FROM s WHERE place <= 8")
def win_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = C.with_centroid(points(spark, sf_dir), ["label"]).withColumn("score", F.round(F.col("weight") + F.col("cos"), 6))
    return C.top_k(p, ["label"], [F.desc("score"), F.col("id")], 8).select("label", "id", "score")


_RELEVANCE = f"least(1.0, greatest(0.0, greatest(0.0, cos) * 0.75::DOUBLE + weight / {S.weight_max}::DOUBLE * 0.20::DOUBLE + least(1.0, (least(likes, 60) / 60.0::DOUBLE + least(replies, 30) / 30.0::DOUBLE) / 2.0::DOUBLE) * 0.05::DOUBLE)) + CASE WHEN place <= most THEN 0.05::DOUBLE ELSE 0 END"


@query("win_05_member_relevance", f"{_REPRESENTATIVE} SELECT label, id, round({_RELEVANCE}, 5) AS relevance FROM k")
def win_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    r = C.representatives(p, ["label"]).select("id", F.lit(True).alias("is_rep"))
    m = C.with_centroid(p, ["label"]).join(r, "id", "left")
    return m.select("label", "id", F.round(C.relevance(F.col("cos"), F.col("weight"), F.col("likes"), F.col("replies"), F.coalesce("is_rep", F.lit(False))), 5).alias("relevance"))


@query("win_06_quantile_floor", f"""WITH {POINTS}, {CENTERS}, {OWN}, s AS (SELECT label, count(*) AS n, list_sort(list(round(cos, 6))) AS l FROM o GROUP BY label)
SELECT label, n, greatest(CASE WHEN n >= 80 THEN 0.52 WHEN n >= 40 THEN 0.50 WHEN n >= 20 THEN 0.47 ELSE 0.42 END::DOUBLE, l[1 + round_even((n - 1) * (CASE WHEN n >= 80 THEN 0.65 WHEN n >= 40 THEN 0.55 WHEN n >= 20 THEN 0.45 ELSE 0.30 END)::DOUBLE, 0)::INT]) AS threshold FROM s""")
def win_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = C.with_centroid(points(spark, sf_dir), ["label"]).select("label", F.round("cos", 6).alias("cos"))
    return C.quantile_floor(p, ["label"], "cos")


@query("vec_12_drop_low_quality", f"{_DIAGNOSED}, q AS (SELECT *, count(*) OVER (PARTITION BY primary_label) AS n FROM g WHERE confidence >= {S.low_confidence} AND primary_cos >= {S.low_cosine}) SELECT id, primary_label FROM q WHERE n >= {max(3, S.cluster_min_samples)}")
def vec_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.drop_low_quality(near(spark, sf_dir), "primary").select("id", F.col("primary").alias("primary_label"))


@query("vec_13_capped_clusters", f"WITH {POINTS}, s AS (SELECT label, round(100.0::DOUBLE * sum(weight) / sum(sum(weight)) OVER (), 6) AS share, count(*) OVER () AS n FROM p GROUP BY label), r AS (SELECT *, row_number() OVER (ORDER BY share DESC, label) AS place FROM s) SELECT label, CASE WHEN n <= 6 OR place < 6 THEN label::VARCHAR ELSE 'emerging_other' END AS new_label FROM r")
def vec_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = C.cluster_stats(points(spark, sf_dir), ["label"]).select("label", F.round("weighted_share", 6).alias("weighted_share"))
    return C.capped_clusters(s, "label", 6).select("label", "new_label")


@query("vec_14_collapse_small", f"""{_DIAGNOSED}, h AS (SELECT id % 40 AS run, CASE WHEN is_soft THEN primary_label ELSE -1 END AS label, count(*) AS size, avg(primary_cos) AS coherence, avg(is_ambiguous::INT) AS ambiguous, 100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY id % 40) AS share, count(*) OVER (PARTITION BY id % 40) AS n FROM g GROUP BY 1, 2)
SELECT run, label, CASE WHEN n > 1 AND size < {max(12, 2 * S.cluster_min_size)} AND share < {max(6.0, S.large_share_pct / 4)} AND (coherence < {max(0.28, S.coherence_min - 0.08)} OR ambiguous >= {S.ambiguous_share}) THEN 'emerging_other' WHEN label = -1 THEN 'emerging_other' ELSE label::VARCHAR END AS new_label FROM h WHERE n = 1 OR label <> -1 OR coherence >= {S.emerging_coherence}""")
def vec_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty runs at once: the clusters of each are judged within their run."""
    d = C.diagnostics(near(spark, sf_dir)).withColumns({"run": F.col("id") % 40, "label": F.when(F.col("is_soft"), F.col("primary")).otherwise(-1)})
    d = d.groupBy("run", "label").agg(F.count(F.lit(1)).alias("size"), F.avg("primary_cos").alias("coherence"), F.avg(F.col("is_ambiguous").cast("int")).alias("ambiguous"))
    d = d.withColumn("share", F.lit(100.0) * F.col("size") / F.sum("size").over(W.partitionBy("run")))
    return C.collapsed_clusters(d, "label", run=["run"])


@query("vec_15_single_cluster", f"WITH {POINTS} SELECT label, count(*) AS size, CASE WHEN count(*) < 40 THEN 'emerging_other' ELSE label::VARCHAR END AS cluster FROM p GROUP BY label")
def vec_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = points(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    return g.select("label", "size", F.when(F.col("size") < 40, "emerging_other").otherwise(F.col("label").cast("string")).alias("cluster"))


@query("vec_19_assign_rest", f"WITH {POINTS}, {CENTERS}, {NEAR} SELECT id, CASE WHEN primary_cos >= {S.position_cosine} THEN primary_label END AS position FROM w")
def vec_19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members get the nearest position, if it is near enough, whatever the margin."""
    return near(spark, sf_dir).select("id", F.when(F.col("primary_cos") >= S.position_cosine, F.col("primary")).alias("position"))


@query("vec_18_group_resolution", f"""WITH {POINTS}, t AS (SELECT id % 20 AS run, id, CASE WHEN label = 9 THEN -1 ELSE label END AS own, v FROM p), z AS (SELECT run, greatest(2, ceil(count(*) * 0.03::DOUBLE)) AS least FROM t GROUP BY run),
x AS (SELECT run, own, i, avg(v[i]) AS m FROM t, generate_series(1, 64) g(i) WHERE own <> -1 GROUP BY ALL), q AS (SELECT run, own, count(*) AS size FROM t WHERE own <> -1 GROUP BY ALL),
c AS (SELECT x.run, x.own, list(m ORDER BY i) AS centroid, any_value(size) AS size FROM x JOIN q USING (run, own) GROUP BY x.run, x.own),
k AS (SELECT c.* FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY size DESC, own) AS first FROM c) c JOIN z USING (run) WHERE size >= least OR first = 1),
n AS (SELECT t.run, t.id, t.own, k.own AS near, list_cosine_similarity(t.v, k.centroid) AS cos FROM t JOIN k USING (run)), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(cos, 9) DESC, near) AS place FROM n),
w AS (SELECT a.run, a.id, a.own, a.near, a.cos, b.cos AS other FROM r a LEFT JOIN r b ON b.id = a.id AND b.place = 2 WHERE a.place = 1)
SELECT w.run, id, CASE WHEN k.own IS NOT NULL THEN w.own WHEN cos >= {S.position_cosine} AND cos - coalesce(other, -1) >= {S.position_margin} THEN near END AS position FROM w LEFT JOIN k ON k.run = w.run AND k.own = w.own""")
def vec_18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty topics at once, with the labels as their groups and label 9 as noise."""
    p = points(spark, sf_dir).withColumns({"run": F.col("id") % 20, "label": F.when(F.col("label") == 9, -1).otherwise(F.col("label"))})
    return C.resolved_groups(p, "label", run=["run"])


@query("vec_20_prototype", f"WITH {POINTS}, {CENTERS}, {OWN}, s AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(cos, 9) DESC, id) AS place FROM o) SELECT label, string_agg(id::VARCHAR, ' ' ORDER BY place) AS prototype FROM s WHERE place <= 3 GROUP BY label")
def vec_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = C.with_centroid(points(spark, sf_dir), ["label"]).withColumn("cos", F.round("cos", 9))
    top = C.top_k(p, ["label"], [F.desc("cos"), F.col("id")], 3)
    return top.groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"].cast("string")), " ").alias("prototype"))


_HALVES = """h AS (SELECT label, id % 2 AS half, i, avg(v[i]) AS m FROM p, generate_series(1, 64) g(i) GROUP BY ALL), t AS (SELECT label, half, list(m ORDER BY i) AS centroid FROM h GROUP BY label, half),
s AS (SELECT a.label, b.label AS other, list_cosine_similarity(a.centroid, b.centroid) AS cos FROM t a, t b WHERE a.half = 0 AND b.half = 1)"""


@query("join_12_best_match", f"""WITH {POINTS}, {_HALVES}, r AS (SELECT label, other, round(greatest(cos * 0.75::DOUBLE, cos * 0.6::DOUBLE, cos * 0.7::DOUBLE), 6) AS score FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, other) AS place FROM r)
SELECT label AS id, CASE WHEN score >= {S.trend_score} THEN other END AS matched, score FROM k WHERE place = 1""")
def join_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of the current briefing (even points) matched with those of the previous one (odd points)."""
    c = C.centroids(points(spark, sf_dir).withColumn("half", F.col("id") % 2), ["label", "half"]).select(F.col("label").cast("bigint").alias("id"), "half", "centroid", F.array().cast("array<string>").alias("tokens"))
    out = C.best_match(c.filter("half = 0").drop("half"), c.filter("half = 1").drop("half"))
    return out.select(F.col("id").cast("int").alias("id"), F.col("matched").cast("int").alias("matched"), "score")


@query("mth_07_match_score", f"WITH {POINTS}, {_HALVES} SELECT label AS id, other AS previous, round(greatest(cos * 0.75::DOUBLE, cos * 0.6::DOUBLE, cos * 0.7::DOUBLE), 5) AS score FROM s")
def mth_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = C.centroids(points(spark, sf_dir).withColumn("half", F.col("id") % 2), ["label", "half"])
    a, b = c.filter("half = 0").select(F.col("label").alias("id"), "centroid"), c.filter("half = 1").select(F.col("label").alias("previous"), F.col("centroid").alias("cp"))
    cos = V.cosine(F.col("centroid"), F.col("cp"))
    return a.crossJoin(F.broadcast(b)).select("id", "previous", F.round(F.greatest(cos * 0.75, cos * 0.6, cos * 0.7), 5).alias("score"))


@query("win_08_arg_max", f"WITH {POINTS}, {CENTERS}, {OWN}, s AS (SELECT label, id, round(cos, 5) AS cos, row_number() OVER (PARTITION BY label ORDER BY round(cos, 5) DESC, id) AS place FROM o) SELECT label, id AS best, cos FROM s WHERE place = 1")
def win_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = C.with_centroid(points(spark, sf_dir), ["label"]).withColumn("cos", F.round("cos", 5))
    return p.groupBy("label").agg(F.max_by("id", F.struct("cos", -F.col("id"))).alias("best"), F.max("cos").alias("cos"))


@query("win_09_numbering", f"WITH {POINTS}, s AS (SELECT label, count(*) AS size FROM p GROUP BY label) SELECT label, 'cluster_' || (row_number() OVER (ORDER BY label) - 1) AS cluster_key, row_number() OVER (ORDER BY size DESC, label) - 1 AS sort_order FROM s")
def win_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = points(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    return s.select("label", F.concat(F.lit("cluster_"), (F.row_number().over(W.orderBy("label")) - 1).cast("string")).alias("cluster_key"), (F.row_number().over(W.orderBy(F.desc("size"), "label")) - 1).cast("bigint").alias("sort_order"))
