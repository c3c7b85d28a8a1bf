"""Writers: partitioned raw dumps, appended CSV and label rows, reports."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as T

#: Characters that Hive escapes in the name of a folder.
_ODD = r"""[\x00-\x1f"#%'*/:=?\\\x7f{\[\]^]"""


def dump_raw(df: DataFrame, path: str, day: str = "fetched_at", video: str = "video_id") -> None:
    """JSON lines below day=.../video_id=..., as ``partitionBy`` writes them; each partition is written by the tasks that hold it.

    Hadoop's local files start a process for each file and folder and are committed one by one, so tasks write the files themselves, each
    under a hidden name until it is whole. A repeated task writes the same names again; each call writes names of its own.
    """
    rows = df.withColumn("day", F.date_format(day, "yyyy-MM-dd"))
    lines = rows.select(F.col("day").alias("_day"), F.col(video).cast("string").alias("_video"), F.to_json(F.struct(*[c for c in rows.columns if c not in ("day", video)])).alias("value"))
    call = uuid.uuid4().hex

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(path)
        name, attempt = f"part-{TaskContext.get().partitionId():05d}-{call}.json", TaskContext.get().taskAttemptId()
        parts = ((k, [v for _, _, v in g]) for b in batches for k, g in groupby(zip(*(c.to_pylist() for c in b.columns), strict=True), lambda x: x[:2]))
        for (d, v), same in groupby(parts, lambda x: x[0]):
            folder = f"{root}/{_part('day', d)}/{_part(video, v)}"
            fs.create_dir(folder, recursive=True)
            with fs.open_output_stream(f"{folder}/.{name}.{attempt}") as f:
                for _, values in same:
                    f.write(("\n".join(values) + "\n").encode())
            fs.move(f"{folder}/.{name}.{attempt}", f"{folder}/{name}")
        yield from ()

    FileSystem.from_uri(path)[0].create_dir(FileSystem.from_uri(path)[1], recursive=True)
    lines.sortWithinPartitions("_day", "_video").mapInArrow(write, "n int").collect()


def read_raw(spark: SparkSession, path: str, fields: str, video: str = "video_id") -> DataFrame:
    """Rows of ``dump_raw``: ``fields`` of the JSON lines, day and ``video`` of their folders.

    The driver lists the days alone; tasks list and read what is below them, so files are neither known to the driver nor a task each.
    """
    fs, root = FileSystem.from_uri(path)
    days = [(x.base_name,) for x in fs.get_file_info(FileSelector(root)) if x.type == FileType.Directory and x.base_name.startswith("day=")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(path)
        out: list[tuple[str | None, str | None, bytes]] = []
        size = 0
        for d in (d for b in batches for d in b.column(0).to_pylist()):
            for folder in fs.get_file_info(FileSelector(f"{root}/{d}")):
                for file in fs.get_file_info(FileSelector(folder.path)):
                    if file.base_name[0] in "._":
                        continue
                    with fs.open_input_file(file.path) as f:
                        rest = b""
                        while chunk := f.read(1 << 22):
                            *whole, rest = (rest + chunk).split(b"\n")
                            out += [(_value(d), _value(folder.base_name), x) for x in whole if x]
                            size += len(chunk)
                            if size > 1 << 22:
                                yield _lines(out)
                                out, size = [], 0
                        out += [(_value(d), _value(folder.base_name), rest)] * bool(rest)
        yield _lines(out)

    tasks = max(1, min(len(days), 8 * spark.sparkContext.defaultParallelism))
    lines = spark.createDataFrame(days, "d string").repartition(tasks).mapInArrow(read, "day string, video string, value string")
    return lines.select(F.from_json("value", fields).alias("r"), "day", F.col("video").cast("bigint").alias(video)).select("r.*", "day", video)


def _part(name: str, value: str | None) -> str:
    """Name of the folder of a value, in Hive's form."""
    return f"{name}={'__HIVE_DEFAULT_PARTITION__' if value in (None, '') else re.sub(_ODD, lambda m: f'%{ord(m[0]):02X}', value)}"


def _value(folder: str) -> str | None:
    v = folder.partition("=")[2]
    return None if v == "__HIVE_DEFAULT_PARTITION__" else re.sub("%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), v)


def _lines(rows: list[tuple[str | None, str | None, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] if k < 2 else r[k].decode() for r in rows], pa.string()) for k in range(3)], ["day", "video", "value"])


def append_bans(df: DataFrame, path: str) -> None:
    """CSV rows with a header, the comment cut to 200 characters, the confidence with two digits."""
    rows = df.select("banned_at", "username", "author_channel_id", "video_id", F.substring("text", 1, 200).alias("text"), F.format_string("%.2f", F.col("confidence_score").cast("double")).alias("confidence"), "insult_target")
    rows.write.mode("append").option("header", True).csv(path)


def label_rows(labels: DataFrame, comments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New training labels with text and author of their comments, and the labels whose comment is missing."""
    c = comments.select("comment_id", F.col("text_raw").alias("text"), "author_name")
    return labels.join(c, "comment_id"), labels.join(c.select("comment_id"), "comment_id", "left_anti")


def markdown_report(topics: DataFrame, group: str) -> DataFrame:
    """One Markdown text a group, topics by weighted share: heading, shares, description, quotes.

    ``topics`` has label, description, share_pct, weighted_share and quotes; a report holds the few
    topics of one video.
    """
    quotes = F.array_join(F.transform("quotes", lambda q: F.concat(F.lit("> "), T.squeezed(q))), "\n")
    part = F.concat_ws("\n\n", F.concat(F.lit("## "), "label"), F.format_string("%.1f%% of comments, %.1f%% by weight", F.col("share_pct").cast("double"), F.col("weighted_share").cast("double")), "description", F.nullif(quotes, F.lit("")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("weighted_share")).alias("by"), "label", part.alias("part")))), lambda x: x["part"])
    return topics.groupBy(group).agg(F.concat(F.lit("# Topics\n\n"), F.array_join(ordered, "\n\n"), F.lit("\n")).alias("markdown"))


def html_of(markdown: str) -> str:
    """HTML of the Markdown that ``markdown_report`` writes: headings, quotes, paragraphs."""
    import html

    out, quote = [], []
    for line in [*markdown.splitlines(), ""]:
        if line.startswith("> "):
            quote.append(html.escape(line[2:]))
            continue
        if quote:
            out.append(f"<blockquote>{'<br />'.join(quote)}</blockquote>")
            quote = []
        level = len(line) - len(line.lstrip("#"))
        if 0 < level <= 6 and line[level : level + 1] == " ":
            out.append(f"<h{level}>{html.escape(line[level + 1 :])}</h{level}>")
        elif line.strip():
            out.append(f"<p>{html.escape(line)}</p>")
    return "\n".join(out)
