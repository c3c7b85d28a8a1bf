"""Queries of the ten corpus problems over the test tables, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import abuse, caps, containers, copies, encode, language, normal_form, personal, splits, subjects
from skein.llm.keys import bare
from skein.sources import spread, table

SPLITS = {"train": 0.8, "validation": 0.1, "test": 0.1}
CAP = 25
#: Tokens of a container.
CAPACITY = 2048
#: Least score of a text that counts as abusive.
ABUSIVE = 0.5


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = splits.linked_rows(table(spark, sf_dir, "toxic_training_data"), "id", "author_name", ["video_id"])
    return rows.filter(F.col("id") != F.col("group_id")).select("group_id", "id")


def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.assign_splits(table(spark, sf_dir, "toxic_training_data"), "id", "author_name", ["video_id"], SPLITS)


def p1_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the splits hold against what was wanted: groups are assigned whole, so small tables deviate."""
    return splits.achieved(p1_splits(spark, sf_dir), SPLITS)


_PERSONAL = {"text_raw": False, "author_name": True}


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = personal.found_spans(spread(table(spark, sf_dir, "raw_comments")), "comment_id", _PERSONAL, personal.fitted(), kinds_only=True)
    return spans.select("comment_id", "field_name", "kind")


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.redacted(spread(table(spark, sf_dir, "raw_comments")), "comment_id", _PERSONAL, personal.fitted())


def _languages(spark: SparkSession, sf_dir: str) -> language.CrossParser:
    return language.fit(language.sampled(table(spark, sf_dir, "raw_comments"), "comment_id", "text_raw", "language_label"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.wrong_labels(spread(table(spark, sf_dir, "raw_comments")), "comment_id", "text_raw", "language_label", _languages(spark, sf_dir))


def p3_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _languages(spark, sf_dir)
    comments = language.segment_languages(spread(table(spark, sf_dir, "raw_comments")), "comment_id", "text_raw", model).withColumnRenamed("comment_id", "row_id")
    documents = language.segment_languages(spread(table(spark, sf_dir, "documents")), "doc_id", "text", model).withColumnRenamed("doc_id", "row_id")
    return comments.select(F.lit("raw_comments").alias("tbl"), "*").unionByName(documents.select(F.lit("documents").alias("tbl"), "*"))


def _delivered(spark: SparkSession, sf_dir: str, what: Callable) -> DataFrame:
    comments = what(spread(table(spark, sf_dir, "raw_comments")), "comment_id", copies.comment_key())
    payloads = what(spread(table(spark, sf_dir, "raw_payloads")), "payload_id", copies.json_key(F.col("payload")))
    return comments.select(F.lit("raw_comments").alias("tbl"), "*").unionByName(payloads.select(F.lit("raw_payloads").alias("tbl"), "*"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _delivered(spark, sf_dir, copies.copies_of)


def p4_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _delivered(spark, sf_dir, copies.collapsed)


def _places(spark: SparkSession, sf_dir: str, *carried: str) -> DataFrame:
    likes = -F.coalesce(F.col("like_count"), F.lit(0)).cast("bigint")
    return caps.ranked_places(table(spark, sf_dir, "raw_comments"), "comment_id", bare(F.col("author_name")), [likes, F.col("published_at"), F.col("comment_id")], carried)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(spark, sf_dir).filter(F.col("place") >= CAP).select("comment_id")


def p5_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _places(spark, sf_dir, "author_name", "like_count").filter(F.col("place") < CAP).drop("place")
    nameless = table(spark, sf_dir, "raw_comments").filter(F.col("author_name").isNull())
    return kept.unionByName(nameless.select(*kept.columns))


def _abuse_model(spark: SparkSession, sf_dir: str) -> abuse.Scorer:
    return abuse.train(*abuse.sampled(table(spark, sf_dir, "toxic_training_data"), "text", "is_toxic"))


def _scored(spark: SparkSession, sf_dir: str, tables: dict[str, tuple[str, str]]) -> DataFrame:
    model = _abuse_model(spark, sf_dir)
    out = None
    for name, (row_id, text) in tables.items():
        rows = abuse.scored(spread(table(spark, sf_dir, name)), row_id, text, model).withColumnRenamed(row_id, "row_id").select(F.lit(name).alias("tbl"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


_SPOKEN = {"raw_comments": ("comment_id", "text_raw"), "toxic_training_data": ("id", "text")}


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, _SPOKEN).filter(F.col("score") >= ABUSIVE).select("tbl", "row_id")


def p6_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, _SPOKEN)


def p6_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments, abusive comments and rate of each video and of each playlist."""
    scores = abuse.scored(spread(table(spark, sf_dir, "raw_comments")), "comment_id", "text_raw", _abuse_model(spark, sf_dir), ["video_id"])
    bad = F.count_if(F.col("score") >= ABUSIVE).alias("n_abusive")
    videos = scores.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), bad)
    named = table(spark, sf_dir, "videos").select(F.col("id").alias("video_id"), "playlist_id")
    lists = videos.join(named, "video_id", "left").groupBy("playlist_id").agg(F.sum("n").alias("n"), F.sum("n_abusive").alias("n_abusive"))
    both = videos.select(F.lit("video").alias("kind"), F.col("video_id").cast("string").alias("source"), "n", "n_abusive").unionByName(lists.select(F.lit("playlist").alias("kind"), F.col("playlist_id").alias("source"), "n", "n_abusive"))
    return both.withColumn("rate", F.col("n_abusive") / F.col("n"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normal_form.look_alikes(spread(table(spark, sf_dir, "raw_comments")), "comment_id", "text_raw")


def p7_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of the classes of texts that look the same, with the number of their links."""
    rows = normal_form.look_alike_classes(spread(table(spark, sf_dir, "raw_comments")), "comment_id", "text_raw")
    return rows.select("comment_id", "form_a", "form_b", (F.col("n_form") - F.col("n_text")).alias("n_links"))


def p7_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normal_form.normal_forms(spread(table(spark, sf_dir, "raw_comments")), "comment_id", "text_raw")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encoded(spread(table(spark, sf_dir, "documents")), "doc_id", "text")


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.packed(encode.token_counts(spread(table(spark, sf_dir, "documents")), "doc_id", "text"), "doc_id", "n_tokens", CAPACITY)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "subject_areas").select("subject", F.concat_ws("\n", "subject", "title_ru", F.replace("scope_note", F.lit(","), F.lit("\n"))).alias("text"))
    return subjects.subject_lists(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "subject_labels"), listed)


def p10_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and characters of each subject, by kind of document."""
    sized = table(spark, sf_dir, "documents").select("doc_id", "doc_type", "n_chars")
    return sized.join(p10_found(spark, sf_dir), "doc_id").groupBy("doc_type", "subject").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_chars").alias("n_chars"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit()}


_IGNORED = r"[\p{P}\p{Z}\x{9}-\x{D}\x{1C}-\x{1F}\x{85}]+"


def _bare(c: str) -> str:
    return f"lower(upper(regexp_replace({c}, '{_IGNORED}', '', 'g')))"


def oracle_sql() -> dict[str, str]:
    field = "json_extract_string(payload, '$.{}')"
    fields = ", ".join(_bare(field.format(f)) if f in copies.LOOSE else field.format(f) for f in copies.FIELDS)
    group = "SELECT '{t}' AS tbl, min({i}) OVER w AS kept_id, {i} AS copy_id, count(*) OVER w AS copies FROM {t} WHERE {k} IS NOT NULL WINDOW w AS (PARTITION BY {p})"
    both = group.format(t="raw_comments", i="comment_id", k="author_name", p=f"{_bare('author_name')}, {_bare('text_raw')}") + " UNION ALL " + group.format(t="raw_payloads", i="payload_id", k="payload", p=fields)
    capped = f"SELECT comment_id, author_name, like_count, row_number() OVER (PARTITION BY {_bare('author_name')} ORDER BY coalesce(like_count, 0) DESC, published_at, comment_id) AS place FROM raw_comments"
    return {
        "p1_found": f"""
            WITH RECURSIVE v AS (
                SELECT id, 'a' || {_bare("author_name")} AS x FROM toxic_training_data WHERE author_name IS NOT NULL
                UNION ALL SELECT id, 'v' || video_id FROM toxic_training_data WHERE video_id IS NOT NULL),
            s AS (SELECT id, min(id) OVER (PARTITION BY x) AS least FROM v),
            e AS (SELECT id AS a, least AS b FROM s UNION SELECT least, id FROM s),
            r AS (SELECT id, id AS g FROM toxic_training_data UNION SELECT e.b, r.g FROM r JOIN e ON e.a = r.id)
            SELECT min(g) AS group_id, id FROM r GROUP BY id HAVING min(g) <> id""",
        "p4_found": f"SELECT tbl, kept_id, copy_id FROM ({both}) WHERE kept_id <> copy_id",
        "p4_collapsed": f"SELECT tbl, kept_id, copies FROM ({both}) WHERE kept_id = copy_id",
        "p5_found": f"SELECT comment_id FROM ({capped}) WHERE author_name IS NOT NULL AND place > {CAP}",
        "p5_kept": f"SELECT comment_id, author_name, like_count FROM ({capped}) WHERE author_name IS NULL OR place <= {CAP}",
    }
