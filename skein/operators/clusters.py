"""Given clusters: centroids, shares, coherence, nearest centroids, representatives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions import vectors as V
from skein.settings import DEFAULT, Settings


def centroids(points: DataFrame, keys: Sequence[str], vector: str = "v") -> DataFrame:
    """Element-wise mean of each cluster; partial means are combined before the shuffle."""
    return points.groupBy(*keys).agg(V.mean_vector(F.col(vector)).alias("centroid"), F.count(F.lit(1)).alias("size"))


def with_centroid(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Points with their own cluster's centroid and the cosine to it."""
    c = centroids(points, keys).select(*keys, "centroid")
    return points.join(c, list(keys)).withColumn("cos", V.cosine(F.col("v"), F.col("centroid")))


def cluster_stats(points: DataFrame, keys: Sequence[str], total: Sequence[str] = ()) -> DataFrame:
    """Size, share and weighted share of each cluster, among the clusters with equal ``total``."""
    g = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), F.sum("weight").alias("weight"))
    w = W.partitionBy(*total) if total else W.partitionBy(F.lit(0))
    return g.select(*keys, "size", (F.lit(100.0) * F.col("size") / F.sum("size").over(w)).alias("share_pct"), (F.lit(100.0) * F.col("weight") / F.sum("weight").over(w)).alias("weighted_share"))


def coherence(points: DataFrame, keys: Sequence[str], floor: float = 0.1) -> DataFrame:
    """Mean cosine to the centroid, plain and weighted with a floor of the weight, within 0 and 1."""
    cos, w = F.col("cos"), F.greatest(F.lit(floor), F.col("weight"))
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return with_centroid(points, keys).groupBy(*keys).agg(unit(F.avg(cos)).alias("coherence"), unit(F.sum(cos * w) / F.sum(w)).alias("weighted_coherence"))


def nearest_two(points: DataFrame, centers: DataFrame, label: str, id_col: str = "id", run: Sequence[str] = ()) -> DataFrame:
    """Primary and secondary centroid of each point among the clusters of its run, with cosines.

    ``centers`` (``run``, label, centroid) are at most a few dozen a run: they travel as one array a
    run, so each point meets them by one join on the run's key and no pairs of points and clusters
    are made. A point whose run has no cluster has nulls. Without ``run`` all points are one run.
    """
    key = F.struct(*run) if run else F.lit(0)
    arrays = centers.groupBy(key.alias("_run")).agg(F.collect_list(F.struct(F.col(label).alias("label"), "centroid")).alias("_centers"))
    scored = F.transform("_centers", lambda c: F.struct(V.cosine(F.col("v"), c["centroid"]).alias("cos"), (-c["label"]).alias("neg")))
    p = points.withColumn("_run", key).join(arrays, "_run", "left").withColumn("_ranked", F.sort_array(scored, asc=False))
    first, second = F.get("_ranked", F.lit(0)), F.get("_ranked", F.lit(1))
    return p.select(id_col, *[c for c in points.columns if c not in (id_col, "v")], (-first["neg"]).alias("primary"), first["cos"].alias("primary_cos"), (-second["neg"]).alias("secondary"), second["cos"].alias("secondary_cos"))


def diagnostics(near: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Confidence, ambiguity and soft assignment from the two nearest centroids."""
    confidence = F.least(F.lit(1.0), F.greatest(F.col("primary_cos"), F.lit(0.0)))
    gap = confidence - F.coalesce("secondary_cos", F.lit(0.0))
    return near.withColumns({"confidence": confidence, "is_ambiguous": (confidence < s.ambiguous_confidence) | (gap < s.ambiguous_margin), "is_soft": F.col("primary_cos") >= s.soft_assign})


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: Column | int, name: str = "rank") -> DataFrame:
    """The first k rows of each key; Spark keeps only k rows a key before the shuffle where k is a number."""
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(name) <= k)


def representatives(points: DataFrame, keys: Sequence[str], id_col: str = "id") -> DataFrame:
    """The points nearest the centroid and heaviest: clamp(round(sqrt(size)), 8, 30) of each cluster."""
    w = W.partitionBy(*keys)
    p = with_centroid(points, keys).withColumns({"n": F.count(F.lit(1)).over(w), "top": F.max("weight").over(w)})
    score = F.col("cos") * 0.7 + F.coalesce(F.try_divide(F.col("weight"), F.col("top")), F.lit(0.0)) * 0.3
    k = F.least(F.col("n"), F.greatest(F.lit(8), F.least(F.lit(30), F.rint(F.sqrt("n")).cast("int"))))
    p = p.withColumn("score", F.round(score, 6))
    return top_k(p, keys, [F.desc("score"), F.col(id_col)], k)


def relevance(cos: Column, weight: Column, likes: Column, replies: Column, representative: Column, weight_max: float = DEFAULT.weight_max) -> Column:
    """Rank score of a member: mostly nearness, then weight and engagement, a bonus for representatives."""
    engagement = (F.least(likes, F.lit(60)) / 60.0 + F.least(replies, F.lit(30)) / 30.0) / 2.0
    base = F.greatest(F.lit(0.0), cos) * 0.75 + weight / weight_max * 0.20 + F.least(F.lit(1.0), engagement) * 0.05
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), base)) + F.when(representative, 0.05).otherwise(0.0)


def quantile_floor(df: DataFrame, keys: Sequence[str], value: str, digits: int = 6) -> DataFrame:
    """Nearest-rank quantile of each group, not below a floor; both depend on the group's size.

    Values, cosines between -1 and 1, are counted to ``digits`` digits by partial aggregation, so a
    group has at most 2 * 10^digits + 1 counts however many rows it has; the rank is found in their running sum.
    """
    g = df.groupBy(*keys, F.round(value, digits).alias("x")).agg(F.count(F.lit(1)).alias("m"))
    w = W.partitionBy(*keys)
    g = g.withColumns({"n": F.sum("m").over(w), "upto": F.sum("m").over(w.orderBy("x").rowsBetween(W.unboundedPreceding, W.currentRow))})
    n = F.col("n")
    q = F.when(n >= 80, 0.65).when(n >= 40, 0.55).when(n >= 20, 0.45).otherwise(0.30)
    low = F.when(n >= 80, 0.52).when(n >= 40, 0.50).when(n >= 20, 0.47).otherwise(0.42)
    reached = g.filter(F.col("upto") > F.rint((n - 1) * q))
    return reached.groupBy(*keys).agg(F.max("n").alias("n"), F.min("x").alias("at")).select(*keys, "n", F.greatest(low, F.col("at")).alias("threshold"))


def drop_low_quality(near: DataFrame, label: str, s: Settings = DEFAULT, run: Sequence[str] = ()) -> DataFrame:
    """Assignments without those of low confidence or cosine, and without clusters of a run that are then too small."""
    good = diagnostics(near, s).filter((F.col("confidence") >= s.low_confidence) & (F.col("primary_cos") >= s.low_cosine))
    left = good.groupBy(*run, label).agg(F.count(F.lit(1)).alias("left")).filter(F.col("left") >= max(3, s.cluster_min_samples))
    return good.join(left, [*run, label])


def capped_clusters(stats: DataFrame, label: str, most: int, run: Sequence[str] = ()) -> DataFrame:
    """Each cluster with its label, or ``emerging_other`` beyond the ``most`` - 1 of largest weighted share of its run."""
    w = W.partitionBy(*(run or [F.lit(0)]))
    place = F.row_number().over(w.orderBy(F.desc("weighted_share"), label))
    named = F.when((F.count(F.lit(1)).over(w) <= most) | (place < most), F.col(label).cast("string")).otherwise("emerging_other")
    return stats.withColumns({"place": place, "new_label": named})


def resolved_groups(points: DataFrame, label: str, s: Settings = DEFAULT, run: Sequence[str] = ()) -> DataFrame:
    """Columns ``run``, id, position: the groups of each topic (``run``) after small ones are dissolved.

    ``label`` is the group, -1 for noise. Members of large groups keep theirs. Rows of groups below
    max(2, 3 %) and noise join the nearest large group if it is near and clearly nearer than the next
    one, else their position is null. If no group is large enough, the largest stays.
    """
    key = F.struct(*run) if run else F.lit(0)
    p = points.withColumn("_topic", key)
    total = p.groupBy("_topic").agg(F.greatest(F.lit(2), F.ceil(F.count(F.lit(1)) * 0.03)).alias("least"))
    c = centroids(p.filter(F.col(label) != -1), ["_topic", label]).join(total, "_topic")
    first = F.row_number().over(W.partitionBy("_topic").orderBy(F.desc("size"), label))  # groups of one topic are few
    c = c.withColumn("first", first).filter((F.col("size") >= F.col("least")) | (F.col("first") == 1))
    own = c.select("_topic", F.col(label).alias("own"), F.lit(True).alias("kept"))
    n = nearest_two(p.select(*run, "_topic", "id", F.col(label).alias("own"), "v"), c, label, run=["_topic"]).join(own, ["_topic", "own"], "left")
    free = (F.col("primary_cos") >= s.position_cosine) & (F.col("primary_cos") - F.coalesce("secondary_cos", F.lit(-1.0)) >= s.position_margin)
    return n.select(*run, "id", F.when(F.col("kept"), F.col("own")).when(free, F.col("primary")).alias("position"))


def collapsed_clusters(stats: DataFrame, label: str, s: Settings = DEFAULT, run: Sequence[str] = ()) -> DataFrame:
    """Each cluster (columns size, share, coherence, ambiguous) with its label, or ``emerging_other`` where it is small
    and incoherent or ambiguous. Noise (label -1) is the ``emerging_other`` of before: it is deleted where it is
    incoherent. The only cluster of a run stays as it is.
    """
    name = F.when(F.col(label) == -1, "emerging_other").otherwise(F.col(label).cast("string"))
    several = F.count(F.lit(1)).over(W.partitionBy(*(run or [F.lit(0)]))) > 1
    bad = (F.col("coherence") < max(0.28, s.coherence_min - 0.08)) | (F.col("ambiguous") >= s.ambiguous_share)
    small = (F.col("size") < max(12, 2 * s.cluster_min_size)) & (F.col("share") < max(6.0, s.large_share_pct / 4)) & bad
    all_ = stats.withColumn("several", several)
    kept = all_.filter(~F.col("several") | (F.col(label) != -1) | (F.col("coherence") >= s.emerging_coherence))
    return kept.select(*run, label, F.when(F.col("several") & small, "emerging_other").otherwise(name).alias("new_label"))


def merge_pairs(clusters: DataFrame, label: str, s: Settings = DEFAULT, run: Sequence[str] = ()) -> DataFrame:
    """Pairs of clusters of one run with near centroids and shared keywords (columns centroid, keywords); a run has few clusters."""
    key = F.struct(*run) if run else F.lit(0)
    a = clusters.select(*run, key.alias("_run"), F.col(label).alias("a"), F.col("centroid").alias("ca"), F.col("keywords").alias("ka"))
    b = clusters.select(key.alias("_run"), F.col(label).alias("b"), F.col("centroid").alias("cb"), F.col("keywords").alias("kb"))
    union = F.size(F.array_union("ka", "kb"))
    pairs = a.join(b, "_run").filter("a < b")
    pairs = pairs.select(*run, "a", "b", V.cosine(F.col("ca"), F.col("cb")).alias("cos"), F.coalesce(F.try_divide(F.size(F.array_intersect("ka", "kb")), union), F.lit(0.0)).alias("jaccard"))
    return pairs.withColumn("merge", (F.col("cos") >= s.merge_cosine) & (F.col("jaccard") >= s.merge_jaccard))


def best_match(current: DataFrame, previous: DataFrame, s: Settings = DEFAULT, run: Sequence[str] = ()) -> DataFrame:
    """For each current topic the previous topic of its run with the highest score, and the score's verdict.

    Both sides carry ``run``, id, centroid and tokens; the previous topics of a run, a dozen at most, travel as one array.
    """
    key = F.struct(*run) if run else F.lit(0)
    p = previous.groupBy(key.alias("_run")).agg(F.collect_list(F.struct("id", "centroid", "tokens")).alias("_previous"))

    def score(t: Column) -> Column:
        lexical = F.coalesce(F.try_divide(F.size(F.array_intersect("tokens", t["tokens"])), F.size(F.array_union("tokens", t["tokens"]))), F.lit(0.0))
        cos = V.cosine(F.col("centroid"), t["centroid"])
        mixed = F.greatest(cos * 0.75 + lexical * 0.25, cos * 0.6 + lexical * 0.4, cos * 0.7 + lexical * 0.3)
        same = (F.size("tokens") > 0) & (F.array_sort("tokens") == F.array_sort(t["tokens"]))
        return F.struct(F.round(F.when(same, 1.0).otherwise(mixed), 6).alias("score"), (-t["id"]).alias("neg"))

    scored = current.withColumn("_run", key).join(p, "_run").select(*run, "id", F.array_max(F.transform("_previous", score)).alias("best"))
    return scored.select(*run, "id", F.when(F.col("best.score") >= s.trend_score, -F.col("best.neg")).alias("matched"), F.col("best.score").alias("score"))
