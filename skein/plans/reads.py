"""Read models: joins, latest rows, reports and aggregates over comments, videos, bans and labels.

Where the test tables lack a table, another with the same shape stands in: orders for runs of a
video (a customer), lineitem for their items, events for the ledger of calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import providers as M
from skein.operators import relational as R
from skein.plans.registry import query
from skein.settings import DEFAULT as S
from skein.sources import table

#: The tables that most plans read, under short names.
_COMMENTS, _VIDEOS, _TOXIC, _BANS = "raw_comments", "videos", "toxic_training_data", "banned_users"


#: What is there, and a later delivery.
OLD, NEW = "fetched_at < TIMESTAMP '2025-10-01'", "fetched_at >= TIMESTAMP '2025-10-01'"


def _n(name: str = "n") -> F.Column:
    return F.count(F.lit(1)).alias(name)


@query("join_01_newest_other", "SELECT o_orderkey, c_custkey, o_orderdate FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_custkey <> 1 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def join_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).filter("c_custkey <> 1")
    return j.select("o_orderkey", "c_custkey", "o_orderdate").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(1)


@query("join_02_cluster_comments", "SELECT e.label, c.comment_id, c.text_raw FROM embeddings e JOIN raw_comments c ON c.comment_id = e.vec_id WHERE e.label IN (1, 3, 5)")
def join_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "embeddings").filter(F.col("label").isin(1, 3, 5)).select("label", F.col("vec_id").alias("comment_id"))
    return items.join(table(spark, sf_dir, _COMMENTS).select("comment_id", "text_raw"), "comment_id")


@query("join_03_items_by_confidence", "SELECT t.id, c.comment_id, t.confidence_score, row_number() OVER (PARTITION BY t.video_id ORDER BY t.confidence_score DESC, t.id) AS place FROM toxic_training_data t JOIN raw_comments c USING (comment_id)")
def join_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, _TOXIC).select("id", "video_id", "comment_id", "confidence_score")
    j = t.join(table(spark, sf_dir, _COMMENTS).select("comment_id"), "comment_id")
    place = F.row_number().over(W.partitionBy("video_id").orderBy(F.desc_nulls_last("confidence_score"), "id"))
    return j.select("id", "comment_id", "confidence_score", place.cast("bigint").alias("place"))


@query("join_04_newest_videos_with_comments", "SELECT video_id, max(c.published_at) AS newest FROM raw_comments c JOIN videos v ON v.id = video_id GROUP BY video_id ORDER BY newest DESC, video_id LIMIT 20")
def join_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, _VIDEOS).select(F.col("id").alias("video_id"))
    c = table(spark, sf_dir, _COMMENTS).groupBy("video_id").agg(F.max("published_at").alias("newest"))
    return c.join(v, "video_id").orderBy(F.desc("newest"), "video_id").limit(20).select("video_id", "newest")


@query("join_05_latest_run", "SELECT * FROM (SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey IN (SELECT max(o_orderkey) FROM orders GROUP BY o_custkey))")
def join_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    return R.latest(o, ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")


_REVIEW = """SELECT t.id, t.comment_id FROM toxic_training_data t JOIN raw_comments c USING (comment_id) WHERE t.is_toxic
AND NOT EXISTS (SELECT 1 FROM banned_users b WHERE b.unbanned_at IS NULL AND b.author_channel_id = c.author_channel_id)
AND NOT (c.author_channel_id IS NULL AND EXISTS (SELECT 1 FROM banned_users b WHERE b.unbanned_at IS NULL AND b.author_channel_id IS NULL AND b.username = c.author_name))"""


@query("join_06_review_without_banned", _REVIEW)
def join_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, _TOXIC).filter("is_toxic").select("id", "comment_id")
    c = table(spark, sf_dir, _COMMENTS).select("comment_id", "author_channel_id", F.col("author_name").alias("username"))
    bans = table(spark, sf_dir, _BANS).filter(F.col("unbanned_at").isNull())
    return R.without_identities(t.join(c, "comment_id"), bans, "author_channel_id", "username").select("id", "comment_id")


@query(
    "join_07_video_overview",
    """SELECT v.id, v.title, c.comment_id AS latest_comment, t.id AS latest_label, b.id AS latest_ban FROM (SELECT * FROM videos ORDER BY published_at DESC, id DESC LIMIT 100) v
LEFT JOIN (SELECT video_id, max(comment_id) AS comment_id FROM raw_comments GROUP BY 1) c ON c.video_id = v.id LEFT JOIN (SELECT video_id, max(id) AS id FROM toxic_training_data GROUP BY 1) t ON t.video_id = v.id LEFT JOIN (SELECT video_id, max(id) AS id FROM banned_users GROUP BY 1) b ON b.video_id = v.id""",
)
def join_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, _VIDEOS).select(F.col("id").alias("video_id"), "title", "published_at").orderBy(F.desc("published_at"), F.desc("video_id")).limit(100)
    for name, col, out in ((_COMMENTS, "comment_id", "latest_comment"), (_TOXIC, "id", "latest_label"), (_BANS, "id", "latest_ban")):
        v = v.join(table(spark, sf_dir, name).groupBy("video_id").agg(F.max(col).alias(out)), "video_id", "left")
    return v.select(F.col("video_id").alias("id"), "title", "latest_comment", "latest_label", "latest_ban")


@query("join_08_items_with_text", "SELECT e.vec_id, coalesce(c.text_raw, '') AS text FROM embeddings e LEFT JOIN raw_comments c ON c.comment_id = e.vec_id * 40")
def join_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") * 40).alias("comment_id"))
    c = table(spark, sf_dir, _COMMENTS).select("comment_id", "text_raw")
    return e.join(c, "comment_id", "left").select("vec_id", F.coalesce("text_raw", F.lit("")).alias("text"))


@query("join_09_clusters_with_topics", "SELECT e.label, count(*) AS n FROM embeddings e JOIN region r ON r.r_regionkey = e.label GROUP BY e.label")
def join_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    topics = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("label"))
    return table(spark, sf_dir, "embeddings").join(topics, "label").groupBy("label").agg(_n())


@query("join_10_missing_rows", "SELECT count(*) AS missing FROM toxic_training_data t WHERE NOT EXISTS (SELECT 1 FROM raw_comments c WHERE c.comment_id = t.comment_id)")
def join_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, c = table(spark, sf_dir, _TOXIC).select("comment_id"), table(spark, sf_dir, _COMMENTS).select("comment_id")
    return t.join(c, "comment_id", "left_anti").agg(_n("missing"))


@query("join_11_insert_absent", "SELECT youtube_comment_id, comment_id FROM (SELECT *, row_number() OVER (PARTITION BY youtube_comment_id ORDER BY comment_id) AS place FROM raw_comments WHERE fetched_at >= TIMESTAMP '2025-10-01') n WHERE place = 1 AND NOT EXISTS (SELECT 1 FROM raw_comments o WHERE o.fetched_at < TIMESTAMP '2025-10-01' AND o.youtube_comment_id = n.youtube_comment_id)")
def join_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows fetched later as a new delivery, earlier ones as what is there."""
    c = table(spark, sf_dir, _COMMENTS)
    old, new = (c.filter(w).select("youtube_comment_id", "comment_id") for w in (OLD, NEW))
    return R.insert_absent(old, new, "youtube_comment_id", "comment_id")


@query("snk_04_insert_raw_comments", "SELECT youtube_comment_id, comment_id, sha256(regexp_replace(regexp_replace(coalesce(text_raw, ''), '[\\s\\p{Z}]+', ' ', 'g'), '^ | $', '', 'g')) AS text_hash FROM (SELECT *, row_number() OVER (PARTITION BY youtube_comment_id ORDER BY comment_id) AS place FROM raw_comments WHERE fetched_at >= TIMESTAMP '2025-10-01') n WHERE place = 1 AND NOT EXISTS (SELECT 1 FROM raw_comments o WHERE o.fetched_at < TIMESTAMP '2025-10-01' AND o.youtube_comment_id = n.youtube_comment_id)")
def snk_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows to append, with a hash of the text as written, case and links kept."""
    c, h = table(spark, sf_dir, _COMMENTS), T.text_hash(T.squeezed(F.coalesce("text_raw", F.lit(""))))
    old, new = (c.filter(w).select("youtube_comment_id", "comment_id", h.alias("text_hash")) for w in (OLD, NEW))
    return R.insert_absent(old, new, "youtube_comment_id", "comment_id")


@query(
    "snk_03_upsert_comments",
    """WITH n AS (SELECT youtube_comment_id, arg_max_null(like_count, comment_id) AS likes, arg_max_null(reply_count, comment_id) AS replies, arg_min_null(published_at, comment_id) AS published FROM raw_comments WHERE fetched_at >= TIMESTAMP '2025-10-01' GROUP BY 1),
o AS (SELECT youtube_comment_id, arg_max_null(like_count, comment_id) AS likes, arg_max_null(reply_count, comment_id) AS replies, arg_min_null(published_at, comment_id) AS published FROM raw_comments WHERE fetched_at < TIMESTAMP '2025-10-01' GROUP BY 1)
SELECT coalesce(n.youtube_comment_id, o.youtube_comment_id) AS youtube_comment_id, CASE WHEN n.youtube_comment_id IS NOT NULL THEN n.likes ELSE o.likes END AS like_count, CASE WHEN n.youtube_comment_id IS NOT NULL THEN n.replies ELSE o.replies END AS reply_count, coalesce(o.published, n.published) AS published_at FROM o FULL JOIN n USING (youtube_comment_id)""",
)
def snk_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last values of a delivery win, but the time of publication is written once."""
    c = table(spark, sf_dir, _COMMENTS).select("youtube_comment_id", "comment_id", "like_count", "reply_count", "published_at", "fetched_at")
    old = c.filter(OLD).groupBy("youtube_comment_id").agg(F.max_by("like_count", "comment_id").alias("like_count"), F.max_by("reply_count", "comment_id").alias("reply_count"), F.min_by("published_at", "comment_id").alias("published_at"))
    return R.upsert(old, c.filter(NEW).drop("fetched_at"), "youtube_comment_id", "comment_id", insert_only=["published_at"])


@query("snk_02_upsert_videos", "SELECT youtube_video_id, max_by(title, id) AS title, max_by(playlist_id, id) AS playlist_id FROM videos GROUP BY 1")
def snk_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second ingestion of a video overwrites the first."""
    v = table(spark, sf_dir, _VIDEOS).select("youtube_video_id", "id", "title", "playlist_id")
    return R.upsert(v.limit(0).drop("id"), v, "youtube_video_id", "id")


@query("join_16_shared_tokens", "SELECT id, len(list_intersect(list_distinct(regexp_extract_all(lower(title), '[\\p{L}\\p{N}_]{4,}')), list_distinct(regexp_extract_all(lower(coalesce(description, '')), '[\\p{L}\\p{N}_]{4,}')))) AS shared FROM videos")
def join_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = lambda c: F.array_distinct(T.words(F.lower(F.coalesce(c, F.lit(""))), 4))
    return table(spark, sf_dir, _VIDEOS).select("id", F.size(F.array_intersect(tokens(F.col("title")), tokens(F.col("description")))).cast("bigint").alias("shared"))


@query("join_17_newest_ban_per_comment", "SELECT t.id, b.id AS ban_id FROM toxic_training_data t LEFT JOIN (SELECT comment_id, max_by(id, struct_pack(a := banned_at, b := id)) AS id FROM banned_users WHERE unbanned_at IS NULL AND comment_id IS NOT NULL GROUP BY 1) b USING (comment_id)")
def join_17(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, _BANS).filter(F.col("unbanned_at").isNull() & F.col("comment_id").isNotNull())
    newest = b.groupBy("comment_id").agg(F.max_by("id", F.struct("banned_at", "id")).alias("ban_id"))
    return table(spark, sf_dir, _TOXIC).select("id", "comment_id").join(newest, "comment_id", "left").select("id", "ban_id")


@query("join_20_replies_with_parents", "SELECT c.comment_id, p.comment_id AS parent FROM raw_comments c LEFT JOIN (SELECT youtube_comment_id, min(comment_id) AS comment_id FROM raw_comments GROUP BY 1) p ON p.youtube_comment_id = c.parent_comment_id WHERE NOT c.is_top_level")
def join_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies and their parents; parents that were deleted are null."""
    c = table(spark, sf_dir, _COMMENTS)
    p = c.groupBy(F.col("youtube_comment_id").alias("parent_comment_id")).agg(F.min("comment_id").alias("parent"))
    return c.filter(~F.col("is_top_level")).select("comment_id", "parent_comment_id").join(p, "parent_comment_id", "left").select("comment_id", "parent")


@query("agg_18_day_snapshot", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS provider, round(sum(value), 2) AS cost, count(*) AS calls FROM events GROUP BY ALL")
def agg_18(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("provider")).agg(F.round(F.sum("value"), 2).alias("cost"), _n("calls"))


@query("agg_19_spend_by_stage", "SELECT event_type, round(sum(value), 2) AS cost, count(*) AS calls, string_agg(DISTINCT (user_id % 7)::VARCHAR, ' ' ORDER BY (user_id % 7)::VARCHAR) AS models FROM events GROUP BY event_type")
def agg_19(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = F.array_join(F.array_sort(F.collect_set((F.col("user_id") % 7).cast("string"))), " ")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.sum("value"), 2).alias("cost"), _n("calls"), models.alias("models"))


@query("agg_20_filtered_sums", "SELECT round(sum(value) FILTER (event_type = 'click'), 2) AS click_value, round(sum(value) FILTER (event_type <> 'click'), 2) AS other_value FROM events")
def agg_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    click = F.col("event_type") == "click"
    return table(spark, sf_dir, "events").agg(F.round(F.sum(F.when(click, F.col("value"))), 2).alias("click_value"), F.round(F.sum(F.when(~click, F.col("value"))), 2).alias("other_value"))


@query("agg_21_training_stats", "SELECT count(*) AS total, count(*) FILTER (is_toxic) AS toxic, count(*) FILTER (NOT is_toxic) AS harmless, count(*) FILTER (labeled_by = 'auto') AS by_auto, count(*) FILTER (labeled_by = 'admin') AS by_admin FROM toxic_training_data")
def agg_21(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, by = F.col("is_toxic"), F.col("labeled_by")
    return table(spark, sf_dir, _TOXIC).agg(_n("total"), F.count_if(t).alias("toxic"), F.count_if(~t).alias("harmless"), F.count_if(by == "auto").alias("by_auto"), F.count_if(by == "admin").alias("by_admin"))


@query("agg_21_training_targets", "SELECT insult_target, count(*) AS n FROM toxic_training_data WHERE is_toxic AND insult_target IS NOT NULL GROUP BY 1")
def agg_21_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, _TOXIC).filter("is_toxic AND insult_target IS NOT NULL").groupBy("insult_target").agg(_n())


@query("agg_22_latest_id", "SELECT video_id, max(comment_id) AS latest FROM raw_comments GROUP BY 1")
def agg_22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, _COMMENTS).groupBy("video_id").agg(F.max("comment_id").alias("latest"))


@query("agg_23_repeating_authors", "SELECT comment_id FROM raw_comments WHERE trim(author_name) <> '' AND author_name IN (SELECT author_name FROM raw_comments WHERE trim(author_name) <> '' GROUP BY author_name, sha256(lower(text_raw)) HAVING count(*) >= 2)")
def agg_23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All comments of authors who posted one text at least twice. Counts shuffle one row for each author and text."""
    c = table(spark, sf_dir, _COMMENTS).filter(F.trim("author_name") != "")
    spam = c.groupBy("author_name", T.text_hash(F.lower("text_raw")).alias("h")).agg(_n()).filter("n >= 2").select("author_name").distinct()
    return c.select("comment_id", "author_name").join(spam, "author_name", "left_semi").select("comment_id")


@query("agg_24_toxic_by_author", "SELECT coalesce(c.author_channel_id, 'name:' || coalesce(c.author_name, '')) AS author_key, count(*) AS n, min(t.id) AS first_id FROM toxic_training_data t JOIN raw_comments c USING (comment_id) WHERE t.is_toxic GROUP BY 1")
def agg_24(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, _COMMENTS).select("comment_id", F.coalesce("author_channel_id", F.concat(F.lit("name:"), F.coalesce("author_name", F.lit("")))).alias("author_key"))
    return table(spark, sf_dir, _TOXIC).filter("is_toxic").select("id", "comment_id").join(c, "comment_id").groupBy("author_key").agg(_n(), F.min("id").alias("first_id"))


@query("agg_27_two_level_means", "SELECT l_shipmode_key, round(avg(m), 4) AS mean FROM (SELECT l_suppkey % 3 AS l_shipmode_key, l_suppkey, avg(l_discount) AS m FROM lineitem GROUP BY ALL) GROUP BY 1")
def agg_27(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 3).alias("l_shipmode_key"), "l_suppkey").agg(F.avg("l_discount").alias("m"))
    return per.groupBy("l_shipmode_key").agg(F.round(F.avg("m"), 4).alias("mean"))


@query("agg_28_call_counters", "SELECT event_type AS task, count(*) AS calls, count(*) FILTER (value IS NULL) AS failed FROM events GROUP BY 1")
def agg_28(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("task")).agg(_n("calls"), F.count_if(F.col("value").isNull()).alias("failed"))


@query("agg_29_negative_share", "SELECT video_id, round(100.0 * count(*) FILTER (is_toxic) / count(*), 4) AS share, 100.0 * count(*) FILTER (is_toxic) / count(*) >= 35 AS is_negative FROM toxic_training_data GROUP BY 1")
def agg_29(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.lit(100.0) * F.count_if(F.col("is_toxic")) / F.count(F.lit(1))
    return table(spark, sf_dir, _TOXIC).groupBy("video_id").agg(F.round(share, 4).alias("share"), (share >= 35).alias("is_negative"))


@query("agg_31_position_shares", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag), 4) AS pct, round(100.0 * sum(l_quantity) / sum(sum(l_quantity)) OVER (PARTITION BY l_returnflag), 4) AS weighted_pct FROM lineitem GROUP BY 1, 2")
def agg_31(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each part of a group by rows and by weight; the shares of a group add up to 100."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(_n(), F.sum("l_quantity").alias("q"))
    w = W.partitionBy("l_returnflag")
    return g.select("l_returnflag", "l_linestatus", "n", F.round(100.0 * F.col("n") / F.sum("n").over(w), 4).alias("pct"), F.round(100.0 * F.col("q") / F.sum("q").over(w), 4).alias("weighted_pct"))


@query("agg_32_conditional_count", "SELECT count(*) FILTER (o_orderstatus = 'P') AS running FROM orders")
def agg_32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").agg(F.count_if(F.col("o_orderstatus") == "P").alias("running"))


@query("agg_33_distinct_banned", "SELECT count(DISTINCT author_channel_id) AS channels, count(DISTINCT username) AS usernames FROM banned_users")
def agg_33(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, _BANS).agg(F.countDistinct("author_channel_id").alias("channels"), F.countDistinct("username").alias("usernames"))


@query("agg_10_safe_percent", "SELECT video_id, round(coalesce(100.0 * count(*) FILTER (is_toxic) / nullif(count(*) FILTER (labeled_by = 'admin'), 0), 0), 4) AS pct FROM toxic_training_data GROUP BY 1")
def agg_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    pct = F.coalesce(F.try_divide(F.lit(100.0) * F.count_if(F.col("is_toxic")), F.count_if(F.col("labeled_by") == "admin")), F.lit(0.0))
    return table(spark, sf_dir, _TOXIC).groupBy("video_id").agg(F.round(pct, 4).alias("pct"))


@query("agg_11_watchdog", "SELECT video_id, array_to_string(list_filter([CASE WHEN a > 0.35 THEN 'undetermined' END, CASE WHEN b > 0.40 THEN 'fallback' END], lambda x: x IS NOT NULL), ',') AS reasons FROM (SELECT video_id, avg((insult_target IS NULL)::INT) AS a, avg((labeled_by = 'admin')::INT) AS b FROM toxic_training_data GROUP BY 1)")
def agg_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, _TOXIC).groupBy("video_id").agg(F.avg(F.col("insult_target").isNull().cast("int")).alias("a"), F.avg((F.col("labeled_by") == "admin").cast("int")).alias("b"))
    reasons = F.array_compact(F.array(F.when(F.col("a") > 0.35, F.lit("undetermined")), F.when(F.col("b") > 0.40, F.lit("fallback"))))
    return g.select("video_id", F.array_join(reasons, ",").alias("reasons"))


@query("win_02_latest_label", "SELECT video_id, id, is_toxic FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY labeled_at DESC, id DESC) AS place FROM toxic_training_data) WHERE place = 1")
def win_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latest(table(spark, sf_dir, _TOXIC).select("video_id", "id", "is_toxic", "labeled_at"), ["video_id"], ["labeled_at", "id"]).select("video_id", "id", "is_toxic")


@query("win_10_position_decay", "SELECT video_id, id, round(score, 5) AS score FROM (SELECT *, confidence_score - 0.04::DOUBLE * (row_number() OVER (PARTITION BY video_id ORDER BY id) - 1) AS score FROM toxic_training_data)")
def win_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(W.partitionBy("video_id").orderBy("id")) - 1
    return table(spark, sf_dir, _TOXIC).select("video_id", "id", F.round(F.col("confidence_score") - place * 0.04, 5).alias("score"))


@query("win_11_systematic_sample", "SELECT video_id, comment_id FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY like_count DESC NULLS LAST, comment_id) AS place, count(*) OVER (PARTITION BY video_id) AS n FROM raw_comments) WHERE (place - 1) % greatest(1, n // 20) = 0 AND (place - 1) // greatest(1, n // 20) < 20")
def win_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, _COMMENTS).select("video_id", "comment_id", "like_count")
    return R.every_nth(c, ["video_id"], [F.desc_nulls_last("like_count"), F.col("comment_id")], 20).select("video_id", "comment_id")


@query("win_12_character_budget", "SELECT video_id, comment_id, least(len, 4000 - used) AS taken FROM (SELECT video_id, comment_id, length(text_raw) AS len, coalesce(sum(length(text_raw)) OVER (PARTITION BY video_id ORDER BY comment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used FROM raw_comments) WHERE used < 4000")
def win_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, _COMMENTS).select("video_id", "comment_id", F.length("text_raw").cast("bigint").alias("len"))
    return R.within_budget(c, ["video_id"], ["comment_id"], "len", 4000).select("video_id", "comment_id", "taken")


@query("win_13_batches", "SELECT video_id, comment_id, (place - 1) // 30 AS batch, (place - 1) % 30 + 1 AS number FROM (SELECT video_id, comment_id, row_number() OVER (PARTITION BY video_id ORDER BY comment_id) AS place FROM raw_comments)")
def win_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, _COMMENTS).select("video_id", "comment_id")
    return R.batches(c, ["video_id"], ["comment_id"], 30).select("video_id", "comment_id", F.col("batch").cast("bigint").alias("batch"), F.col("number").cast("bigint").alias("number"))


@query("win_16_trend_series", "SELECT e.label, strftime(c.published_at, '%Y-%m') AS month, count(x.vec_id) AS n FROM (SELECT DISTINCT label FROM embeddings) e CROSS JOIN (SELECT DISTINCT date_trunc('month', published_at) AS published_at FROM raw_comments) c LEFT JOIN (SELECT vec_id, label, date_trunc('month', published_at) AS month FROM embeddings JOIN raw_comments ON comment_id = vec_id) x ON x.label = e.label AND x.month = c.published_at GROUP BY 1, 2")
def win_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One point for each topic and month, 0 where the topic has no comment."""
    e, c = table(spark, sf_dir, "embeddings").select("label", "vec_id"), table(spark, sf_dir, _COMMENTS).select(F.col("comment_id").alias("vec_id"), F.date_format("published_at", "yyyy-MM").alias("month"))
    counted = e.join(c, "vec_id").groupBy("label", "month").agg(_n())
    months = c.select("month").distinct()
    every = e.select("label").distinct().join(F.broadcast(months.agg(F.collect_set("month").alias("months"))), how="cross").select("label", F.explode("months").alias("month"))
    return every.join(counted, ["label", "month"], "left").select("label", "month", F.coalesce("n", F.lit(0)).alias("n"))


@query("win_17_trend_delta", "SELECT day, event_type, n, CASE WHEN prev IS NULL THEN 'new' WHEN share - prev > 1 THEN 'up' WHEN share - prev < -1 THEN 'down' ELSE 'flat' END AS trend FROM (SELECT *, lag(share) OVER (PARTITION BY event_type ORDER BY day) AS prev FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY strftime(ts, '%Y-%m-%d')), 4) AS share FROM events GROUP BY 1, 2))")
def win_17(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(_n())
    g = g.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy("day")), 4)).withColumn("prev", F.lag("share").over(W.partitionBy("event_type").orderBy("day")))
    gap = F.col("share") - F.col("prev")
    return g.select("day", "event_type", "n", F.when(gap.isNull(), "new").when(gap > 1, "up").when(gap < -1, "down").otherwise("flat").alias("trend"))


@query("src_01_latest_video", "SELECT playlist_id, id, youtube_video_id, published_at FROM (SELECT *, row_number() OVER (PARTITION BY playlist_id ORDER BY published_at DESC, id DESC) AS place FROM videos WHERE regexp_matches(lower(trim(title)), 'выпуск|эфир|разбор') AND (duration_seconds IS NULL OR duration_seconds >= 120)) WHERE place = 1")
def src_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest video of each playlist whose title fits and that is no short; an unknown length is no short."""
    long = F.col("duration_seconds").isNull() | (F.col("duration_seconds") >= 120)
    v = table(spark, sf_dir, _VIDEOS).filter(F.lower(F.trim("title")).rlike("выпуск|эфир|разбор") & long)
    return v.groupBy("playlist_id").agg(F.max_by(F.struct("id", "youtube_video_id", "published_at"), F.struct("published_at", "id")).alias("v")).select("playlist_id", "v.*")


@query("src_03_video_lookup", "SELECT id, title FROM videos WHERE youtube_video_id = (SELECT min(youtube_video_id) FROM videos)")
def src_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, _VIDEOS).select("id", "title", "youtube_video_id")
    return v.join(v.agg(F.min("youtube_video_id").alias("youtube_video_id")), "youtube_video_id").select("id", "title")


@query("src_04_flatten_threads", "SELECT parent, comment_id, is_top FROM (SELECT youtube_comment_id AS parent, comment_id, true AS is_top FROM raw_comments WHERE is_top_level UNION ALL SELECT parent_comment_id, comment_id, false FROM raw_comments WHERE NOT is_top_level AND parent_comment_id IS NOT NULL)")
def src_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads, a top comment with an array of its replies, flattened again into rows."""
    c = table(spark, sf_dir, _COMMENTS).select("comment_id", "is_top_level", F.when(F.col("is_top_level"), F.col("youtube_comment_id")).otherwise(F.col("parent_comment_id")).alias("parent"))
    threads = c.filter(F.col("parent").isNotNull()).groupBy("parent").agg(F.collect_list(F.struct(F.col("comment_id"), F.col("is_top_level").alias("is_top"))).alias("items"))
    return threads.select("parent", F.explode("items").alias("i")).select("parent", "i.comment_id", "i.is_top")


def _fetched(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The first delivery of each comment of a video; a comment without an id is repeated by none."""
    c = table(spark, sf_dir, _COMMENTS).withColumn("key", F.coalesce("youtube_comment_id", F.concat(F.lit("row "), F.col("comment_id").cast("string"))))
    return c.groupBy("video_id", "key").agg(F.min_by(F.struct("comment_id", *columns), "comment_id").alias("row")).select("video_id", "row.*")


#: Comments without those fetched again.
_ONCE = "f AS (SELECT * FROM raw_comments c WHERE NOT EXISTS (SELECT 1 FROM raw_comments d WHERE d.video_id = c.video_id AND d.youtube_comment_id = c.youtube_comment_id AND d.comment_id < c.comment_id))"


@query("src_05_hybrid_sample", f"""WITH {_ONCE}, r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY published_at DESC, comment_id) AS a, row_number() OVER (PARTITION BY video_id ORDER BY like_count DESC NULLS LAST, comment_id) AS b FROM f),
u AS (SELECT video_id, comment_id, 0 AS s, a AS o FROM r WHERE a <= {S.max_comments} UNION ALL SELECT video_id, comment_id, 1, b FROM r WHERE b <= {S.max_relevant} AND a > {S.max_comments}) SELECT comment_id FROM u QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY s, o) <= {S.max_comments}""")
def src_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest comments of each video, then its most liked ones, each once, up to the cap of a video."""
    w = W.partitionBy("video_id")
    c = _fetched(spark, sf_dir, "published_at", "like_count")
    c = c.withColumns({"newest": F.row_number().over(w.orderBy(F.desc("published_at"), "comment_id")), "liked": F.row_number().over(w.orderBy(F.desc_nulls_last("like_count"), "comment_id"))})
    by_time = F.col("newest") <= S.max_comments
    c = c.filter(by_time | (F.col("liked") <= S.max_relevant)).withColumn("ord", F.when(by_time, F.struct(F.lit(0).alias("sample"), F.col("newest").alias("place"))).otherwise(F.struct(F.lit(1).alias("sample"), F.col("liked").alias("place"))))
    return c.withColumn("place", F.row_number().over(w.orderBy("ord"))).filter(F.col("place") <= S.max_comments).select("comment_id")


@query("src_08_pushed_filter", "SELECT comment_id FROM raw_comments WHERE video_id = 3 AND like_count >= 2")
def src_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, _COMMENTS).filter("video_id = 3 AND like_count >= 2").select("comment_id")


@query("src_09_cache_lookup", "SELECT n.comment_id, o.comment_id IS NOT NULL AS is_hit FROM raw_comments n LEFT JOIN (SELECT sha256(lower(text_raw)) AS h, min(comment_id) AS comment_id FROM raw_comments WHERE fetched_at < TIMESTAMP '2025-10-01' GROUP BY 1) o ON o.h = sha256(lower(n.text_raw)) WHERE n.fetched_at >= TIMESTAMP '2025-10-01'")
def src_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and misses of a cache that is keyed by the hash of the text."""
    c = table(spark, sf_dir, _COMMENTS).select("comment_id", "fetched_at", T.text_hash(F.lower("text_raw")).alias("h"))
    cache = c.filter(OLD).select("h").distinct().withColumn("hit", F.lit(True))
    return c.filter(NEW).join(cache, "h", "left").select("comment_id", F.coalesce("hit", F.lit(False)).alias("is_hit"))


@query("vec_23_cached_embed", "SELECT count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses FROM (SELECT e.vec_id IS NOT NULL AS hit FROM raw_comments c LEFT JOIN embeddings e ON e.vec_id = c.comment_id)")
def vec_23(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, e = table(spark, sf_dir, _COMMENTS).select("comment_id"), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("comment_id"), F.lit(True).alias("hit"))
    return c.join(e, "comment_id", "left").agg(F.count_if(F.col("hit")).alias("hits"), F.count_if(F.col("hit").isNull()).alias("misses"))


@query("vec_23_cached_vectors")
def vec_23_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector of every comment: cached where the comment has one, else embedded, each missing text once."""
    c, e = table(spark, sf_dir, _COMMENTS).select("comment_id", "text_raw"), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("comment_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    hits = c.join(e, "comment_id").select("comment_id", "embedding", F.lit(True).alias("is_hit"))
    none = spark.createDataFrame([], "h string, embedding array<float>")
    vectors, _ = M.embedded_with_cache(c.join(e, "comment_id", "left_anti"), none, "comment_id", "text_raw", M.hashing_embedder)
    return hits.unionByName(vectors.withColumn("is_hit", F.lit(False)))


@query("set_01_sample_union", "SELECT comment_id, sample FROM (SELECT comment_id, min(s) AS sample FROM (SELECT comment_id, 0 AS s FROM raw_comments WHERE like_count >= 5 UNION ALL SELECT comment_id, 1 FROM raw_comments WHERE reply_count >= 2) GROUP BY 1)")
def set_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, _COMMENTS).select("comment_id", F.col("comment_id").alias("ord"), "like_count", "reply_count")
    a, b = c.filter("like_count >= 5").select("comment_id", "ord"), c.filter("reply_count >= 2").select("comment_id", "ord")
    return R.unioned_samples([a, b], "comment_id", "ord").select("comment_id", "sample")


@query("set_02_member_union", "SELECT DISTINCT video_id, author_name FROM (SELECT video_id, author_name FROM raw_comments UNION SELECT video_id, username FROM banned_users) WHERE author_name IS NOT NULL")
def set_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = table(spark, sf_dir, _COMMENTS).select("video_id", "author_name"), table(spark, sf_dir, _BANS).select("video_id", F.col("username").alias("author_name"))
    return a.union(b).filter(F.col("author_name").isNotNull()).distinct()


_TOKENS = "list_distinct(regexp_extract_all(lower(coalesce({}, '')), '[\\p{{L}}\\p{{N}}_]{{4,}}'))"


@query("set_03_jaccard", f"SELECT id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(a || b)) END, 6) AS jaccard, len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 AS is_subset FROM (SELECT id, {_TOKENS.format('title')} AS a, {_TOKENS.format('description')} AS b FROM videos)")
def set_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = lambda c: F.array_distinct(T.words(F.lower(F.coalesce(c, F.lit(""))), 4))
    v = table(spark, sf_dir, _VIDEOS).select("id", tokens(F.col("title")).alias("a"), tokens(F.col("description")).alias("b"))
    return v.select("id", F.round(T.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"), (F.size(F.array_except("a", "b")) == 0).alias("is_subset"))


@query("set_05_difference", "SELECT comment_id FROM raw_comments EXCEPT SELECT comment_id FROM toxic_training_data")
def set_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, _COMMENTS).select("comment_id").join(table(spark, sf_dir, _TOXIC).select("comment_id"), "comment_id", "left_anti").distinct()


@query("set_06_ordered_distinct", "SELECT video_id, string_agg(a, ' ' ORDER BY first_id) AS labels FROM (SELECT video_id, language_label AS a, min(comment_id) AS first_id FROM raw_comments WHERE language_label IS NOT NULL GROUP BY ALL) GROUP BY 1")
def set_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values in the order of their first row."""
    g = table(spark, sf_dir, _COMMENTS).filter(F.col("language_label").isNotNull()).groupBy("video_id", "language_label").agg(F.min("comment_id").alias("first_id"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("first_id", "language_label"))), lambda x: x["language_label"])
    return g.groupBy("video_id").agg(F.array_join(ordered, " ").alias("labels"))


@query("set_07_concat", "SELECT id AS row_id, 'toxic' AS kind FROM toxic_training_data UNION ALL SELECT id, 'ban' FROM banned_users")
def set_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = table(spark, sf_dir, _TOXIC), table(spark, sf_dir, _BANS)
    return a.select(F.col("id").alias("row_id"), F.lit("toxic").alias("kind")).unionAll(b.select(F.col("id").alias("row_id"), F.lit("ban").alias("kind")))


@query("set_08_one_group_each", "SELECT comment_id, min(label) AS label FROM (SELECT vec_id AS comment_id, label FROM embeddings UNION ALL SELECT vec_id, (label + 1) % 10 FROM embeddings) GROUP BY 1")
def set_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members that are named in several groups stay in the first."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("comment_id"), F.explode(F.array("label", (F.col("label") + 1) % 10)).alias("label"))
    return e.groupBy("comment_id").agg(F.min("label").alias("label"))


def _ordered(name: str, table_name: str, columns: list[str], order: list[tuple[str, bool]], limit: int | None = None) -> None:
    """A sorted report, with a limit where that is the report."""
    by = ", ".join(f"{c} DESC NULLS LAST" if d else f"{c} NULLS FIRST" for c, d in order)
    cut = f" LIMIT {limit}" if limit else ""

    @query(name, f"SELECT {', '.join(columns)} FROM {table_name} ORDER BY {by}{cut}")
    def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, table_name).orderBy(*[F.desc_nulls_last(c) if d else F.asc_nulls_first(c) for c, d in order]).select(*columns)
        return df.limit(limit) if limit else df


_ordered("srt_02_newest_videos", _VIDEOS, ["id", "title", "published_at"], [("published_at", True), ("id", True)], 100)
_ordered("srt_03_newest_run", "orders", ["o_orderkey", "o_orderdate"], [("o_orderdate", True), ("o_orderkey", True)], 1)
_ordered("srt_05_by_score", _TOXIC, ["id", "confidence_score"], [("confidence_score", True), ("id", False)])
_ordered("srt_11_by_order_and_label", "nation", ["n_nationkey", "n_name"], [("n_regionkey", False), ("n_name", False)])
_ordered("srt_12_recent_jobs", "orders", ["o_orderkey"], [("o_orderdate", True), ("o_orderkey", True)], 20)
_ordered("api_15_banned_users", _BANS, ["id", "username", "banned_at"], [("banned_at", True), ("id", False)])


@query("srt_04_capped_comments", f"WITH {_ONCE} SELECT comment_id, published_at FROM f QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY published_at DESC, comment_id) <= {S.max_comments}")
def srt_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest comments of each video up to its cap, after repeats are removed; in the order of their time."""
    place = F.row_number().over(W.partitionBy("video_id").orderBy(F.desc("published_at"), "comment_id"))
    c = _fetched(spark, sf_dir, "published_at").withColumn("place", place).filter(F.col("place") <= S.max_comments)
    return c.select("comment_id", "published_at").orderBy("published_at", "comment_id")


@query("srt_10_authors_by_comments", "SELECT author_name, count(*) AS n FROM raw_comments WHERE author_name IS NOT NULL GROUP BY 1 ORDER BY n DESC, author_name")
def srt_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, _COMMENTS).filter(F.col("author_name").isNotNull()).groupBy("author_name").agg(_n()).orderBy(F.desc("n"), "author_name")


@query("srt_06_undetermined_last", "SELECT coalesce(insult_target, 'undetermined') AS target, count(*) AS n, insult_target IS NULL AS is_last FROM toxic_training_data GROUP BY ALL ORDER BY is_last, n DESC")
def srt_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, _TOXIC).groupBy("insult_target").agg(_n())
    return g.select(F.coalesce("insult_target", F.lit("undetermined")).alias("target"), "n", F.col("insult_target").isNull().alias("is_last")).orderBy("is_last", F.desc("n"))


@query("api_07_author_comments", "SELECT c.comment_id, c.text_raw FROM raw_comments c WHERE c.author_name = (SELECT author_name FROM raw_comments WHERE author_name IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, author_name LIMIT 1)")
def api_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All comments of the most frequent author."""
    c = table(spark, sf_dir, _COMMENTS).select("comment_id", "author_name", "text_raw")
    top = c.filter(F.col("author_name").isNotNull()).groupBy("author_name").agg(_n()).orderBy(F.desc("n"), "author_name").limit(1).select("author_name")
    return c.join(F.broadcast(top), "author_name").select("comment_id", "text_raw")


@query("api_08_toxic_review", f"SELECT r.id, r.comment_id, t.confidence_score FROM ({_REVIEW}) r JOIN toxic_training_data t ON t.id = r.id ORDER BY t.confidence_score DESC, r.id")
def api_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, _TOXIC).select("id", "confidence_score")
    return join_06(spark, sf_dir).join(scores, "id").select("id", "comment_id", "confidence_score").orderBy(F.desc("confidence_score"), "id")


@query("api_10_guest_names", "SELECT video_id, array_to_string(list_filter(list_transform(string_split(coalesce(guest_names, ''), ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS guests FROM video_settings")
def api_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.filter(F.transform(F.split(F.coalesce("guest_names", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return table(spark, sf_dir, "video_settings").select("video_id", F.array_join(parts, "|").alias("guests"))


@query("api_01_videos", "SELECT v.id, v.title, coalesce(c.n, 0) AS n_comments, coalesce(t.n, 0) AS n_labels FROM (SELECT * FROM videos ORDER BY published_at DESC, id DESC LIMIT 100) v LEFT JOIN (SELECT video_id, count(*) AS n FROM raw_comments GROUP BY 1) c ON c.video_id = v.id LEFT JOIN (SELECT video_id, count(*) AS n FROM toxic_training_data GROUP BY 1) t ON t.video_id = v.id")
def api_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, _VIDEOS).select(F.col("id").alias("video_id"), "title", "published_at").orderBy(F.desc("published_at"), F.desc("video_id")).limit(100)
    c, t = table(spark, sf_dir, _COMMENTS).groupBy("video_id").agg(_n("c")), table(spark, sf_dir, _TOXIC).groupBy("video_id").agg(_n("t"))
    j = v.join(c, "video_id", "left").join(t, "video_id", "left")
    return j.select(F.col("video_id").alias("id"), "title", F.coalesce("c", F.lit(0)).alias("n_comments"), F.coalesce("t", F.lit(0)).alias("n_labels"))


@query("api_03_video_detail", "SELECT v.id, v.title, r.o_orderkey AS latest_run, EXISTS (SELECT 1 FROM banned_users b WHERE b.video_id = v.id) AS has_bans FROM videos v LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) r ON r.o_custkey = v.id")
def api_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderkey").alias("latest_run"))
    bans = table(spark, sf_dir, _BANS).select(F.col("video_id").alias("id"), F.lit(True).alias("ban")).distinct()
    v = table(spark, sf_dir, _VIDEOS).select("id", "title").join(runs, "id", "left").join(bans, "id", "left")
    return v.select("id", "title", "latest_run", F.coalesce("ban", F.lit(False)).alias("has_bans"))


@query("api_11_budget", "SELECT round(sum(value), 2) AS cost, count(*) AS calls FROM events WHERE ts::DATE = DATE '2024-01-10'")
def api_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = (F.col("ts") >= "2024-01-10") & (F.col("ts") < "2024-01-11")
    return table(spark, sf_dir, "events").filter(day).agg(F.round(F.sum("value"), 2).alias("cost"), _n("calls"))
