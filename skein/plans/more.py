"""Parsing, maps, streams in batch form, reports and model plug-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import parsing as P
from skein.functions import text as T
from skein.operators import clusters as C
from skein.operators import providers as M
from skein.plans.registry import query
from skein.plans.vectors import CENTERS, OWN, POINTS, points
from skein.sources import table
from skein.sources.sinks import label_rows, markdown_report
from skein.streaming import events as E


@query("dat_02_iso_duration", "SELECT id, CASE WHEN duration_seconds IS NOT NULL THEN duration_seconds END AS seconds FROM videos")
def dat_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations written as ISO text and read back."""
    s = F.col("duration_seconds")
    iso = F.concat(F.lit("PT"), F.floor(s / 3600).cast("string"), F.lit("H"), F.floor(s % 3600 / 60).cast("string"), F.lit("M"), (s % 60).cast("string"), F.lit("S"))
    return table(spark, sf_dir, "videos").select("id", P.duration_seconds(iso).alias("seconds"))


@query("dat_06_dates", "SELECT id, strftime(published_at, '%Y-%m-%d') AS day, strftime(published_at, '%H:%M') AS clock FROM videos")
def dat_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = P.iso_date(F.date_format("published_at", "yyyy-MM-dd'T'HH:mm"))
    return table(spark, sf_dir, "videos").select("id", F.date_format(day, "yyyy-MM-dd").alias("day"), P.clock_time(F.date_format("published_at", "HH:mm")).alias("clock"))


@query("str_20_truth", "SELECT id, is_toxic AS flag FROM toxic_training_data")
def str_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.when(F.col("is_toxic"), F.element_at(F.array(*map(F.lit, ("1", "true", "YES", " on "))), (F.col("id") % 4 + 1).cast("int"))).otherwise(F.element_at(F.array(*map(F.lit, ("0", "False", "no", "off"))), (F.col("id") % 4 + 1).cast("int")))
    return table(spark, sf_dir, "toxic_training_data").select("id", P.truth(word).alias("flag"))


@query("mth_11_threshold", "SELECT id, round(CASE WHEN v > 1 AND v <= 100 THEN v / 100 ELSE least(1, greatest(0, v)) END, 6) AS share FROM (SELECT id, CASE WHEN id % 2 = 0 THEN confidence_score ELSE confidence_score * 100 END AS v FROM toxic_training_data)")
def mth_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("id") % 2 == 0, F.col("confidence_score")).otherwise(F.col("confidence_score") * 100)
    return table(spark, sf_dir, "toxic_training_data").select("id", F.round(P.threshold(v), 6).alias("share"))


@query("jsn_01_lenient_object", "SELECT payload_id, json_extract_string(payload, '$.youtube_comment_id') AS key FROM raw_payloads")
def jsn_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects found inside a fenced answer with words around them."""
    fenced = F.concat(F.lit("Here it is:\n```json\n"), "payload", F.lit("\n```\nDone {almost."))
    return table(spark, sf_dir, "raw_payloads").select("payload_id", F.get_json_object(P.lenient_object(fenced), "$.youtube_comment_id").alias("key"))


@query("jsn_02_unwrapped", "SELECT payload_id, json_extract_string(payload, '$.youtube_comment_id') AS key FROM raw_payloads")
def jsn_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrapped = F.when(F.col("payload_id") % 2 == 0, F.concat(F.lit('{"response": '), "payload", F.lit("}"))).otherwise(F.col("payload"))
    return table(spark, sf_dir, "raw_payloads").select("payload_id", F.get_json_object(P.unwrapped(wrapped), "$.youtube_comment_id").alias("key"))


@query("jsn_03_scored_results", "SELECT id, id % 30 AS number, CASE WHEN is_toxic THEN 'toxic' ELSE 'skip' END AS category, greatest(1, least(10, id % 13)) AS score FROM toxic_training_data")
def jsn_03_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers like {"results": {"4": "toxic:7"}} taken apart; scores are kept within 1 and 10."""
    i = F.col("id")
    answer = F.concat(F.lit('{"results": {"'), (i % 30).cast("string"), F.lit('": "'), F.when(F.col("is_toxic"), "toxic").otherwise("skip"), F.lit(":"), (i % 13).cast("string"), F.lit('", "x": "toxic:1", "99": "unknown:3"}}'))
    r = table(spark, sf_dir, "toxic_training_data").select("id", F.explode(P.scored_results(answer)).alias("r"))
    return r.select("id", F.col("r.number").cast("bigint").alias("number"), "r.category", F.col("r.score").cast("bigint").alias("score"))


@query("map_01_merged_counts", "SELECT video_id, sum(CASE WHEN is_toxic THEN 1 ELSE 0 END)::BIGINT AS toxic, count(*) - sum(CASE WHEN is_toxic THEN 1 ELSE 0 END)::BIGINT AS harmless FROM toxic_training_data GROUP BY 1")
def map_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of counts of two kinds of labels, added."""
    t = table(spark, sf_dir, "toxic_training_data")

    def half(k: int) -> DataFrame:
        g = t.filter((F.col("labeled_by") == "admin") == F.lit(bool(k))).groupBy("video_id").agg(F.count_if("is_toxic").alias("a"), F.count_if(~F.col("is_toxic")).alias("b"))
        return g.select("video_id", F.create_map(F.lit("toxic"), "a", F.lit("harmless"), "b").alias(f"m{k}"))

    empty = F.create_map().cast("map<string,bigint>")
    j = half(0).join(half(1), "video_id", "full").select("video_id", P.merged_counts(F.coalesce("m0", empty), F.coalesce("m1", empty)).alias("m"))
    return j.select("video_id", F.coalesce(F.col("m")["toxic"], F.lit(0)).alias("toxic"), F.coalesce(F.col("m")["harmless"], F.lit(0)).alias("harmless"))


@query("str_12_safe_text", "SELECT doc_id, regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g') AS safe FROM documents")
def str_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", P.safe_text(F.col("text")).alias("safe"))


@query("str_15_cache_key", "SELECT comment_id, CASE WHEN regexp_matches('emb-' || youtube_comment_id, '^[A-Za-z0-9._-]{1,80}$') THEN 'emb-' || youtube_comment_id ELSE sha256('emb-' || youtube_comment_id) END AS key FROM raw_comments")
def str_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "raw_comments").select("comment_id", P.cache_key(F.col("youtube_comment_id"), "emb-").alias("key"))


@query("str_22_formats", "SELECT id, CASE WHEN d % 10 = 1 AND d % 100 <> 11 THEN 'секунда' WHEN d % 10 BETWEEN 2 AND 4 AND NOT d % 100 BETWEEN 12 AND 14 THEN 'секунды' ELSE 'секунд' END AS noun FROM (SELECT id, duration_seconds AS d FROM videos WHERE duration_seconds IS NOT NULL)")
def str_22(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "videos").filter(F.col("duration_seconds").isNotNull())
    return v.select("id", P.plural(F.col("duration_seconds"), "секунда", "секунды", "секунд").alias("noun"))


@query("snk_05_cluster_items", f"WITH {POINTS}, {CENTERS}, {OWN}, s AS (SELECT label, id, round(cos, 5) AS score, row_number() OVER (PARTITION BY label ORDER BY round(cos, 5) DESC, id) - 1 AS sort_order FROM o) SELECT label, id, score, sort_order, sort_order < 3 AS is_representative FROM s")
def snk_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the bridge from clusters to comments, ranked within a cluster."""
    p = C.with_centroid(points(spark, sf_dir), ["label"]).withColumn("score", F.round("cos", 5))
    r = C.top_k(p, ["label"], [F.desc("score"), F.col("id")], F.lit(1 << 30)).withColumn("sort_order", (F.col("rank") - 1).cast("bigint"))
    return r.select("label", "id", "score", "sort_order", (F.col("sort_order") < 3).alias("is_representative"))


@query("snk_14_ledger_rows", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS usage_date, event_type AS provider, round(value, 6) AS cost FROM events")
def snk_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("usage_date"), F.col("event_type").alias("provider"), F.round("value", 6).alias("cost"))


@query("snk_15_label_rows", "SELECT t.id, c.text_raw AS text, c.author_name FROM toxic_training_data t JOIN raw_comments c USING (comment_id)")
def snk_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = label_rows(table(spark, sf_dir, "toxic_training_data").select("id", "comment_id"), table(spark, sf_dir, "raw_comments"))
    return rows.select("id", "text", "author_name")


@query("snk_09_markdown_report")
def snk_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = C.cluster_stats(points(spark, sf_dir), ["label"])
    top = C.representatives(points(spark, sf_dir), ["label"]).select("label", F.col("id").alias("comment_id"), "rank")
    q = top.join(table(spark, sf_dir, "raw_comments").select("comment_id", "text_raw"), "comment_id").groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text_raw"))), lambda x: x["text_raw"]).alias("quotes"))
    topics = s.join(q, "label").select(F.lit(1).alias("run"), F.concat(F.lit("Topic "), F.col("label").cast("string")).alias("label"), F.lit("").alias("description"), "share_pct", "weighted_share", "quotes")
    return markdown_report(topics, "run")


@query("lbl_08_merge_primary", "WITH " + POINTS + ", s AS (SELECT label % 5 AS topic, label, count(*) AS n, round(sum(weight), 4) AS w FROM p GROUP BY ALL) SELECT topic, label AS main FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY w DESC, n DESC, label) AS place FROM s) WHERE place = 1")
def lbl_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = points(spark, sf_dir).groupBy((F.col("label") % 5).alias("topic"), "label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 4).alias("w"))
    return g.groupBy("topic").agg(F.max_by("label", F.struct("w", "n", -F.col("label"))).alias("main"))


@query("udf_01_embeddings")
def udf_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "raw_comments").select("comment_id", "text_raw")
    return M.embedded(c, "comment_id", "text_raw", M.hashing_embedder, task="cluster: ")


@query("stm_02_first_deliveries", "SELECT youtube_comment_id, min(fetched_at) AS first_seen FROM raw_comments GROUP BY 1")
def stm_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "raw_comments").groupBy("youtube_comment_id").agg(F.min("fetched_at").alias("first_seen"))


@query("stm_windows", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2")
def stm_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: the windowed aggregate of the stream, on the batch table."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return E.windowed(e).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("brf_06_trend_lines", "SELECT label, month, n, coalesce(n - lag(n) OVER (PARTITION BY label ORDER BY month), 0) AS delta FROM (SELECT e.label, strftime(c.published_at, '%Y-%m') AS month, count(*) AS n FROM embeddings e JOIN raw_comments c ON c.comment_id = e.vec_id GROUP BY 1, 2)")
def brf_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    e, c = table(spark, sf_dir, "embeddings").select("label", "vec_id"), table(spark, sf_dir, "raw_comments").select(F.col("comment_id").alias("vec_id"), F.date_format("published_at", "yyyy-MM").alias("month"))
    g = e.join(c, "vec_id").groupBy("label", "month").agg(F.count(F.lit(1)).alias("n"))
    return g.select("label", "month", "n", F.coalesce(F.col("n") - F.lag("n").over(W.partitionBy("label").orderBy("month")), F.lit(0)).alias("delta"))


@query("str_05_signature_tokens", "SELECT id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(title || ' ' || coalesce(description, '')), '[a-zа-яё0-9]{3,}'))), ' ') AS tokens FROM videos")
def str_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.lower(F.concat("title", F.lit(" "), F.coalesce("description", F.lit(""))))
    return table(spark, sf_dir, "videos").select("id", F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(both, F.lit("[a-zа-яё0-9]{3,}"), F.lit(0)))), " ").alias("tokens"))


@query("str_09_squeezed", "SELECT doc_id, regexp_replace(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g'), '^ | $', '', 'g') AS line FROM documents")
def str_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.squeezed(F.col("text")).alias("line"))
