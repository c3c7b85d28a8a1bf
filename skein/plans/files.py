"""Files that a run writes and reads: raw dumps, CSV, caches, reports, diagnostics, fixtures. Each query writes to the
shared folder and gives the rows that a reader finds there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from skein.operators import providers as M
from skein.plans.registry import SQL, query
from skein.plans.topic_runs import agg_12, quoted
from skein.sources import landing, scratch, sinks, table


@query("snk_01_raw_dump", "SELECT strftime(fetched_at, '%Y-%m-%d') AS day, video_id, count(*) AS n, min(comment_id) AS first_id FROM raw_comments WHERE fetched_at IS NOT NULL AND video_id IS NOT NULL GROUP BY ALL")
def snk_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw payloads below day and video, read back by their partitions."""
    path = scratch.fresh(spark, "raw")
    c = table(spark, sf_dir, "raw_comments").filter("fetched_at IS NOT NULL AND video_id IS NOT NULL")
    sinks.dump_raw(c.repartition("video_id"), path)
    back = sinks.read_raw(spark, path, "comment_id bigint, text_raw string")
    return back.groupBy("day", "video_id").agg(F.count(F.lit(1)).alias("n"), F.min("comment_id").alias("first_id"))


@query("snk_13_ban_rows", "SELECT b.id AS ban_id, substring(c.text_raw, 1, 200) AS text FROM banned_users b JOIN raw_comments c USING (comment_id) WHERE c.text_raw IS NOT NULL AND NOT regexp_matches(c.text_raw, '[\\r\\n\"\\\\]') AND trim(c.text_raw) = c.text_raw AND c.text_raw <> ''")
def snk_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ban rows appended as CSV in two parts with seven columns, the text cut, read back with their header."""
    path = scratch.fresh(spark, "bans")
    c = table(spark, sf_dir, "raw_comments").select("comment_id", F.col("text_raw").alias("text"))
    one_line = ~F.col("text").rlike('[\r\n"\\\\]') & (F.trim("text") == F.col("text")) & (F.col("text") != "")
    b = table(spark, sf_dir, "banned_users").join(c, "comment_id").filter(one_line).withColumn("username", F.col("id").cast("string"))
    sinks.append_bans(b.filter("id % 2 = 0"), path)
    sinks.append_bans(b.filter("id % 2 = 1"), path)
    return spark.read.option("header", True).csv(path).select(F.col("username").cast("bigint").alias("ban_id"), "text")


@query("snk_08_cache_write_through", "SELECT count(DISTINCT sha256(coalesce(text_raw, ''))) AS keys, count(*) AS vectors FROM raw_comments")
def snk_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of half the comments are written to the cache; those of all then come from the cache or are added to it."""
    path = scratch.fresh(spark, "vectors")
    c = table(spark, sf_dir, "raw_comments").select("comment_id", "text_raw")
    none = spark.createDataFrame([], "h string, embedding array<float>")
    M.embedded_with_cache(c.filter("comment_id % 2 = 0"), none, "comment_id", "text_raw", M.hashing_embedder)[1].write.parquet(path)
    cache = spark.read.parquet(path)
    vectors, new = M.embedded_with_cache(c, cache, "comment_id", "text_raw", M.hashing_embedder)
    whole = cache.select("h").unionByName(new.select("h"))
    return whole.agg(F.count(F.lit(1)).alias("keys")).join(vectors.agg(F.count("embedding").alias("vectors")), F.lit(True))  # two counts, one row each


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = quoted(spark, sf_dir).select("run", F.col("title").alias("label"), "description", "share_pct", "weighted_share", "quotes")
    return sinks.markdown_report(t, "run")


@query("snk_10_html_reports")
def snk_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTML of the Markdown reports, one a run."""
    html = F.udf(sinks.html_of, Y.StringType())  # a report a row, a few a run
    return _reports(spark, sf_dir).select("run", html("markdown").alias("html"))


@query("snk_11_report_files")
def snk_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports written as text below their run and read back as whole texts."""
    path = scratch.fresh(spark, "reports")
    _reports(spark, sf_dir).select("run", F.col("markdown").alias("value")).write.partitionBy("run").text(path)
    return spark.read.text(path, wholetext=True).select("run", F.length("value").alias("n_chars"), F.regexp_count("value", F.lit("(?m)^## ")).alias("n_topics"))


@query("snk_12_diagnostics_files", SQL["agg_12_diagnostics"])
def snk_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnostics of all clusters written as JSON below their run and read back."""
    path = scratch.fresh(spark, "diagnostics")
    d = agg_12(spark, sf_dir)
    d.write.partitionBy("run").json(path)
    return spark.read.schema(d.schema).json(path).select(*d.columns)


@query("src_06_fixture_file", "SELECT youtube_comment_id, like_count, row_number() OVER (ORDER BY comment_id) - 1 AS ord FROM raw_comments WHERE video_id = (SELECT min(id) FROM videos)")
def src_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dry-run file of one video and its comments, written and read by the fixture source."""
    path = scratch.fresh(spark, "fixture")
    v = table(spark, sf_dir, "videos")
    v = v.join(v.agg(F.min("id").alias("id")), "id")
    c = table(spark, sf_dir, "raw_comments").join(v.select(F.col("id").alias("video_id")), "video_id")
    fields = [f.split(" ")[0] for f in landing.RAW_COMMENT.split(", ")]
    both = c.groupBy("video_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("comment_id", F.struct(*fields).alias("c")))), lambda x: x["c"]).alias("comments"))  # the comments of one video, as the file holds them
    video = v.select(F.col("id").alias("video_id"), F.struct(*[f.split(" ")[0] for f in landing.VIDEO_META.split(", ")]).alias("latest_video"))
    video.join(both, "video_id").select("latest_video", "comments").coalesce(1).write.json(path)
    _, comments = landing.fixture(spark, path)
    return comments.select("youtube_comment_id", "like_count", F.col("ord").cast("bigint").alias("ord"))


@query("src_02_video_details", "SELECT v.id, v.title, v.duration_seconds FROM videos v WHERE v.id IN (SELECT DISTINCT video_id FROM toxic_training_data)")
def src_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details of the videos with the given ids: one semi join in place of requests for fifty ids each."""
    ids = table(spark, sf_dir, "toxic_training_data").select(F.col("video_id").alias("id"))
    return table(spark, sf_dir, "videos").join(ids, "id", "left_semi").select("id", "title", "duration_seconds")
