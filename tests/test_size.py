"""Queries end on texts and tables of a size at which their first versions did not."""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import functions as F

from compare import database, same_rows
from skein.operators import topics
from skein.plans import catalog
from skein.sources import sinks


def test_quotes_of_long_texts_are_found_in_linear_time(spark):
    r = np.random.default_rng(5)
    words = ["".join(chr(1072 + i) for i in r.integers(0, 32, 6)) for _ in range(500)]
    long = " ".join(r.choice(words, 30_000))
    rows = [(1, 10, 1, long), (1, 11, 0, "короткий текст без этих слов вообще"), (1, 12, 2, long + "!"), (2, 13, 0, long), (1, 14, 0, "ну вот " + "!? " * 12 + "да"), (1, 15, 0, "ха" * 400 + "ы" + "ха" * 400), (1, 16, 0, "а б в г д " * 3 + "слово словами словечко")]
    quotes = [(1, 1, long[150_000:150_040]), (1, 2, long[-60:].replace(" ", " - ").upper()), (1, 3, "?! " * 11 + "да"), (1, 4, "!? " * 11 + "да"), (1, 5, "ха" * 12 + "ы"), (3, 6, long[:80]), (1, 7, long[100:120]), (1, 8, "а, б, в, г, д, " * 2 + "а б в г д слово слов"), (1, 9, "а б в г д " * 2 + "а б в г д слово с")]
    q = spark.createDataFrame(quotes, "g int, quote_id int, quote string")
    c = spark.createDataFrame(rows, "g int, comment_id int, rank int, text string")
    began = time.perf_counter()
    got = sorted((x["quote_id"], x["comment_id"], x["tier"]) for x in topics.matched_quotes(q, c, ["g"]).collect())
    assert got == [(1, 10, 1), (2, 10, 2), (4, 14, 1), (5, 15, 2), (8, 16, 2), (9, 16, 1)]
    assert time.perf_counter() - began < 90


def test_capitals_of_several_letters_are_those_of_sql(spark, tmp_path):
    texts = ["Grüße aus Lawisy an alle! Zum ersten Mal hier 👏👏", "the ﬁrmware update quite differently #ручовязячу"]
    spark.createDataFrame([(5 * k + 3, k, 1, t) for k, t in enumerate(texts)], "id bigint, comment_id bigint, video_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "toxic_training_data.parquet"))
    spark.createDataFrame([(k, 1, k, t) for k, t in enumerate(texts)], "comment_id bigint, video_id bigint, like_count int, text_raw string").coalesce(1).write.parquet(str(tmp_path / "raw_comments.parquet"))
    con = database("/none")
    for name in ("toxic_training_data", "raw_comments"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    same_rows(catalog.queries()["join_15_quote_match"](spark, str(tmp_path)), con, catalog.oracle_sql()["join_15_quote_match"])


def test_dump_of_many_days_and_videos_ends_and_is_whole(spark, tmp_path):
    rows = spark.range(9000).select(F.expr("timestamp'2026-01-01' + make_interval(0, 0, 0, cast(id % 60 as int))").alias("fetched_at"), F.expr("id % 50").alias("video_id"), F.col("id").alias("comment_id"), F.expr("if(id % 7 = 0, NULL, 'a\\n\"b\" ' || id)").alias("text_raw"))
    path, fields = f"file://{tmp_path}/raw", "comment_id bigint, text_raw string"
    began = time.perf_counter()
    sinks.dump_raw(rows.repartition("video_id"), path)
    back = sinks.read_raw(spark, path, fields)
    want = sorted(map(str, rows.select("comment_id", "text_raw", F.date_format("fetched_at", "yyyy-MM-dd").alias("day"), "video_id").collect()))
    assert sorted(map(str, back.collect())) == want
    assert time.perf_counter() - began < 60
    one = "day=2026-01-01"
    assert spark.read.schema(fields).json(f"{path}/{one}").count() == rows.filter("fetched_at < '2026-01-02'").count()
    sinks.dump_raw(rows.limit(10), path)
    assert back.count() == 9010  # appended


def test_dump_is_laid_out_as_spark_does(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a/b=c {d}", 1.5), (2, None, None), (3, "x y", 2.0)], "id int, k string, x double").withColumn("fetched_at", F.expr("if(id = 3, NULL, timestamp'2026-03-04 05:06:07')"))
    sinks.dump_raw(rows, f"file://{tmp_path}/own", video="k")
    rows.withColumn("day", F.date_format("fetched_at", "yyyy-MM-dd")).write.partitionBy("day", "k").json(f"{tmp_path}/spark")
    files = [sorted((str(p.parent.relative_to(tmp_path / d)), p.read_text()) for p in (tmp_path / d).rglob("part-*.json")) for d in ("own", "spark")]
    assert files[0] == files[1]
