"""Raw files as they are landed: threads of an API, a JSON fixture, and a paged source."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RAW_COMMENT = "youtube_comment_id string, parent_comment_id string, author_name string, author_channel_id string, text_raw string, like_count int, reply_count int, published_at timestamp, is_top_level boolean"
VIDEO_META = "youtube_video_id string, playlist_id string, title string, description string, published_at timestamp, duration_seconds int, url string"


def fixture(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Video and comments of a dry-run file: {"latest_video": ..., "comments": [...]}."""
    both = spark.read.schema(f"latest_video struct<{_typed(VIDEO_META)}>, comments array<struct<{_typed(RAW_COMMENT)}>>").option("multiLine", True).json(path)
    return both.select("latest_video.*"), both.select(F.posexplode("comments").alias("ord", "c")).select("ord", "c.*")


def _typed(ddl: str) -> str:
    return ", ".join(f"{n}:{t}" for n, t in (p.split(" ") for p in ddl.split(", ")))


def flattened_threads(threads: DataFrame) -> DataFrame:
    """A row for each top comment and for each reply of its array; rows without id or time are left out.

    ``threads`` has the columns of a comment and ``replies``, an array of the same. Replies get
    the top comment as parent and no replies of their own.
    """
    own = [c for c in threads.columns if c not in ("replies", "parent_comment_id", "is_top_level", "reply_count")]
    top = threads.select(*own, F.lit(None).cast("string").alias("parent_comment_id"), F.coalesce("reply_count", F.lit(0)).alias("reply_count"), F.lit(True).alias("is_top_level"))
    replies = threads.select(F.col("youtube_comment_id").alias("parent"), F.explode("replies").alias("r"))
    below = replies.select(*[F.col(f"r.{c}").alias(c) for c in own], F.col("parent").alias("parent_comment_id"), F.lit(0).alias("reply_count"), F.lit(False).alias("is_top_level"))
    return top.unionByName(below).filter(F.col("youtube_comment_id").isNotNull() & F.col("published_at").isNotNull())


class Pages(DataSource):
    """``spark.read.format("pages").load(folder)``: each file of JSON lines is a page and a partition.

    A stand-in for a paged web source: pages are read by tasks, in parallel, and a failed page is
    read again by Spark's own task retries. Option ``most`` limits the number of pages.
    """

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "page int, ord int, item string"

    def reader(self, schema: object) -> DataSourceReader:  # noqa: ARG002
        return _PageReader(dict(self.options))


class _PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.most = options["path"], int(options.get("most", 20))

    def partitions(self) -> list[InputPartition]:
        files = sorted(str(p) for p in Path(self.folder).glob("*.jsonl"))[: self.most]
        return [InputPartition((i, f)) for i, f in enumerate(files)]

    def read(self, partition: InputPartition) -> Iterator[tuple[int, int, str]]:
        page, path = partition.value
        with open(path, encoding="utf-8") as f:
            for i, line in enumerate(f):
                if line.strip():
                    yield page, i, json.dumps(json.loads(line), ensure_ascii=False)
