"""Projections, filters and predicates over comments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import preprocess as P
from skein.plans.registry import query
from skein.settings import DEFAULT as S
from skein.sources import spread, table


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, {_q(f'^{T.WS}+|{T.WS}+$')}, '', 'g')"


def squeeze_sql(x: str) -> str:
    return _strip(f"regexp_replace({x}, {_q(T.WS + '+')}, ' ', 'g')")


def normal_sql(x: str) -> str:
    return squeeze_sql(f"regexp_replace({x}, {_q('(?i)' + T.URL)}, ' ', 'g')")


def words_sql(x: str, least: int = 1) -> str:
    return f"regexp_extract_all({x}, {_q(f'{T.W}{{{least},}}')})"


def tokens_sql(x: str, least: int) -> str:
    stops = ", ".join(map(_q, P.STOPWORDS))
    return f"list_sort(list_filter(list_distinct({words_sql(f'lower({x})', least)}), lambda x: x NOT IN ({stops})))"


def like_sql(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {_q(pattern)})"


REPEATS_SQL = "len(list_filter(range(1, length({t}) - 4), lambda i: substring({t}, i, 6) = repeat(substring({t}, i, 1), 6))) > 0"
DIVERSITY_SQL = "len(list_distinct(list_transform(w, lambda x: lower(x))))::DOUBLE / greatest(len(w), 1)"
TOP_SQL = "coalesce(list_max(list_transform(w, lambda x: len(list_filter(w, lambda y: lower(y) = lower(x)))))::DOUBLE / len(w), 0)"
SYMBOL_SQL = f"coalesce(length(regexp_replace(regexp_replace(t, {_q(T.WS + '+')}, '', 'g'), '[\\p{{L}}\\p{{N}}]+', '', 'g'))::DOUBLE / nullif(length(regexp_replace(t, {_q(T.WS + '+')}, '', 'g')), 0), 1.0)"
ALPHA_SQL = "length(regexp_replace(t, '[^\\p{L}]+', '', 'g'))"
NOISE_SQL = "(t = '' OR NOT regexp_matches(t, '[\\p{L}\\p{N}]') OR length(replace(t, ' ', '')) <= 3)"
URL_ONLY_SQL = like_sql("lower(raw)", T.URL_ONLY)
_low = squeeze_sql("lower(t)")
_stops = f"len(list_filter(w, lambda x: lower(x) IN ({', '.join(map(_q, P.STOPWORDS))})))::DOUBLE / greatest(len(w), 1)"
LOW_CONTENT_SQL = f"((len(w) <= 5 AND {like_sql(_low, P.EMOTION)}) OR (len(w) <= 4 AND {like_sql(_low, P.PRAISE)}) OR (len(w) <= 6 AND {like_sql(_low, P.META)} AND NOT {like_sql(_low, P.CLAIM)}) OR (len(w) <= 8 AND {like_sql(_low, P.EMPTY_QUESTION)}) OR (len(w) <= 5 AND NOT {like_sql(_low, P.CLAIM)} AND {_stops} > 0.6))"
LOW_SIGNAL_SQL = f"({REPEATS_SQL.format(t='lower(t)')} OR {ALPHA_SQL} < {S.min_alpha} OR ({SYMBOL_SQL} > {S.max_symbol_ratio} AND len(w) <= 10) OR (len(w) >= 6 AND ({DIVERSITY_SQL} < {S.min_diversity} OR {TOP_SQL} >= 0.7)))"
SPAM_SQL = f"(len(regexp_extract_all(lower(raw), {_q(T.URL)})) >= 2 OR {like_sql('lower(raw)', P.SPAM)} OR {like_sql('lower(t)', P.SPAM)} OR (len(regexp_extract_all(lower(raw), {_q(T.URL)})) >= 1 AND (contains(lower(raw), 'promo') OR contains(lower(raw), 'промо'))))"
PROFANE_SQL = like_sql("lower(t)", P.PROFANITY)
POSITION_SQL = f"({like_sql('lower(t)', P.CLAIM)} OR coalesce(len(list_intersect({tokens_sql('t', 4)}, topic)) >= {S.topic_overlap}, false))"
SCORE_SQL = f"greatest(0.0, least(1.0, (CASE WHEN len(w) BETWEEN 3 AND 6 THEN 0.35::DOUBLE WHEN len(w) <= 2 THEN 0.12::DOUBLE ELSE 0.20::DOUBLE END) - (CASE WHEN position THEN 0.22::DOUBLE ELSE 0 END) + (CASE WHEN profane THEN 0.18::DOUBLE ELSE 0 END) + (CASE WHEN contains(t, '?') THEN 0.07::DOUBLE ELSE 0 END) + (CASE WHEN {REPEATS_SQL.format(t='lower(t)')} THEN 0.10::DOUBLE ELSE 0 END) + greatest(0.0, 0.3::DOUBLE - {DIVERSITY_SQL}) * 0.5::DOUBLE))"


def weight_sql(n_words: str) -> str:
    age = f"greatest(0.0, (epoch_us(TIMESTAMP '{S.as_of}') - epoch_us(published_at))::DOUBLE / 86400000000.0) + (CASE WHEN published_at < video_published_at THEN 1.0 ELSE 0.0 END)"
    return f"least({S.weight_max}::DOUBLE, 1.0::DOUBLE + least(coalesce(like_count, 0), 100) * 0.03::DOUBLE + least(coalesce(reply_count, 0), 30) * 0.08::DOUBLE + least({n_words} / 45.0::DOUBLE, 1.0::DOUBLE) + greatest(0.0::DOUBLE, 1.0::DOUBLE - ln(1 + {age}) / 4.0::DOUBLE))"


#: Comments with raw and normal text, words, and the tokens of their video.
BASE = f"""b0 AS (SELECT c.*, v.published_at AS video_published_at, {tokens_sql("concat_ws(' ', v.title, v.description)", 4)} AS topic, {_strip("coalesce(text_raw, '')")} AS raw FROM raw_comments c LEFT JOIN videos v ON v.id = c.video_id),
b1 AS (SELECT *, {normal_sql("raw")} AS t FROM b0), b AS (SELECT *, {words_sql("t")} AS w FROM b1)"""


def _comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spread(table(spark, sf_dir, "raw_comments")).join(P.topic_tokens(table(spark, sf_dir, "videos")), "video_id", "left")
    return c.withColumn("raw", T.stripped(F.coalesce("text_raw", F.lit("")))).withColumn("t", T.normalized(F.col("raw"))).withColumn("w", T.words(F.col("t")))


def _predicate(name: str, column: Callable[[Column, Column, Column], Column], sql: str) -> None:
    """A query for the ids of the comments for which a predicate holds."""

    @query(name, f"WITH {BASE} SELECT comment_id FROM b WHERE {sql}")
    def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _comments(spark, sf_dir).filter(column(*map(F.col, ("raw", "t", "w")))).select("comment_id")


def _value(name: str, columns: Callable[[Column, Column, Column], dict[str, Column]], sql: str) -> None:
    """A query for values of every comment."""

    @query(name, f"WITH {BASE} SELECT comment_id, {sql} FROM b")
    def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _comments(spark, sf_dir).select("comment_id", *[c.alias(n) for n, c in columns(*map(F.col, ("raw", "t", "w"))).items()])


_predicate("flt_02_empty", lambda raw, t, w: raw == "", "raw = ''")
_predicate("flt_03_too_short", lambda raw, t, w: F.size(w) < S.min_words, f"len(w) < {S.min_words}")
_predicate("flt_04_noise", lambda raw, t, w: T.is_noise(t) | T.is_url_only(raw), f"{NOISE_SQL} OR {URL_ONLY_SQL}")
_predicate("flt_05_low_content", lambda raw, t, w: P.low_content(t, w), LOW_CONTENT_SQL)
_predicate("flt_06_low_signal", lambda raw, t, w: P.low_signal(t, w), LOW_SIGNAL_SQL)
_predicate("flt_08_spam_link", lambda raw, t, w: P.spam_link(raw, t), SPAM_SQL)
_predicate("flt_09_profanity", lambda raw, t, w: F.lower(t).rlike(P.PROFANITY), PROFANE_SQL)
_predicate("flt_10_position_signal", lambda raw, t, w: P.position_signal(t, F.col("topic")), POSITION_SQL)
_predicate("flt_18_question", lambda raw, t, w: t.rlike(r"[?¿？]"), "regexp_matches(t, '[?¿？]')")
_predicate("str_18_cyrillic", lambda raw, t, w: T.has_cyrillic(t), like_sql("t", T.CYRILLIC))
_value("flt_11_borderline_score", lambda raw, t, w: {"score": F.round(P.borderline_score(t, w, P.position_signal(t, F.col("topic")), F.lower(t).rlike(P.PROFANITY)), 4)}, f"round({SCORE_SQL.replace('position', POSITION_SQL).replace('profane', PROFANE_SQL)}, 4) AS score")
_value("flt_13_engagement_weight", lambda raw, t, w: {"weight": F.round(P.engagement_weight(F.col("like_count"), F.col("reply_count"), F.size(w), F.col("published_at"), F.col("video_published_at")), 6)}, f"round({weight_sql('len(w)')}, 6) AS weight")
_value("str_01_normalize", lambda raw, t, w: {"text_normalized": t}, "t AS text_normalized")
_value("str_02_hash", lambda raw, t, w: {"text_hash": T.text_hash(F.lower(t))}, "sha256(lower(t)) AS text_hash")
_value("str_03_tokens", lambda raw, t, w: {f"n{k}": F.size(T.words(F.lower(t), k)).cast("bigint") for k in (1, 3, 4)}, ", ".join(f"len({words_sql('lower(t)', k)}) AS n{k}" for k in (1, 3, 4)))
_value("str_04_token_set", lambda raw, t, w: {"tokens": F.array_join(T.token_set(t, 4, P.STOPWORDS), " ")}, f"array_to_string({tokens_sql('t', 4)}, ' ') AS tokens")
_value("str_06_clip", lambda raw, t, w: {"clipped": T.clipped(t, 60)}, "CASE WHEN length(t) <= 60 THEN t ELSE regexp_replace(substring(t, 1, 57), '[ ,;:\\-]+$', '') || '...' END AS clipped")
_value("str_07_clip_words", lambda raw, t, w: {"clipped": T.clipped_words(t, 12)}, "CASE WHEN len(string_split(t, ' ')) <= 12 THEN t ELSE array_to_string(string_split(t, ' ')[1:8] || ['...'] || string_split(t, ' ')[-4:], ' ') END AS clipped")
_value("str_10_compact", lambda raw, t, w: {"compact": T.compacted(t)}, "regexp_replace(lower(t), '[^\\p{L}\\p{N}]+', '', 'g') AS compact")
_value("arr_03_top_token_share", lambda raw, t, w: {"share": F.round(T.top_token_share(w), 4)}, f"round({TOP_SQL}, 4) AS share")
_value("mth_09_token_estimates", lambda raw, t, w: {"by_chars": F.ceil(F.length(t) / 4.0).cast("bigint"), "by_bytes": F.octet_length(t).cast("bigint")}, "ceil(length(t) / 4.0)::BIGINT AS by_chars, strlen(t)::BIGINT AS by_bytes")
_value("dat_03_age_days", lambda raw, t, w: {"age_days": F.round((F.unix_micros(F.lit(S.as_of).cast("timestamp")) - F.unix_micros(F.col("published_at").cast("timestamp"))) / F.lit(86_400_000_000.0), 6)}, f"round((epoch_us(TIMESTAMP '{S.as_of}') - epoch_us(published_at))::DOUBLE / 86400000000.0, 6) AS age_days")
_value("dat_04_day", lambda raw, t, w: {"day": F.date_format("published_at", "yyyy-MM-dd")}, "strftime(published_at, '%Y-%m-%d') AS day")
_value("dat_05_local_time", lambda raw, t, w: {"clock": F.date_format(F.from_utc_timestamp(F.col("published_at").cast("timestamp"), "Europe/Kyiv"), "HH:mm")}, "strftime(published_at AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Kyiv', '%H:%M') AS clock")
_value("dat_01_rfc3339", lambda raw, t, w: {"parsed": F.to_timestamp(F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).cast("timestamp_ntz")}, "date_trunc('second', published_at) AS parsed")

_FULL = f"""WITH {BASE},
p AS (SELECT *, {PROFANE_SQL} AS profane, {POSITION_SQL} AS position FROM b),
s AS (SELECT *, {SCORE_SQL} AS score, CASE WHEN raw = '' THEN 'empty' WHEN len(w) < {S.min_words} THEN 'too_short' WHEN {NOISE_SQL} OR {URL_ONLY_SQL} THEN 'noise' WHEN {LOW_CONTENT_SQL} THEN 'low_content' WHEN {LOW_SIGNAL_SQL} THEN 'low_signal' END AS early0 FROM p),
r AS (SELECT *, CASE WHEN {SPAM_SQL} THEN 1 WHEN profane AND position THEN 2 WHEN profane THEN 3 WHEN len(w) BETWEEN 3 AND 6 AND score BETWEEN {S.borderline_min} AND {S.borderline_max} THEN 4 ELSE 5 END AS rule FROM s),
e AS (SELECT *, coalesce(early0, CASE rule WHEN 1 THEN 'spam_link' WHEN 3 THEN 'profanity_only' END) AS early, sha256(lower(CASE WHEN t <> '' THEN t ELSE coalesce(text_raw, '') END)) AS text_hash FROM r),
d AS (SELECT *, row_number() OVER (PARTITION BY video_id, text_hash, early IS NULL ORDER BY comment_id) AS place, count(*) OVER (PARTITION BY video_id, text_hash, early IS NULL) AS copies FROM e),
f AS (SELECT *, coalesce(early, CASE WHEN place > 1 THEN 'duplicate' END) AS filter_reason, {weight_sql(f"len({words_sql('CASE WHEN t <> chr(0) AND length(t) > 0 THEN t ELSE coalesce(text_raw, chr(32)) END')})")} AS weight0 FROM d)
SELECT comment_id, video_id, filter_reason, filter_reason IS NOT NULL AS is_filtered,
  CASE WHEN filter_reason IS NOT NULL THEN 'drop' WHEN rule = 2 THEN 'flag' ELSE 'keep' END AS moderation_action,
  CASE WHEN filter_reason IS NOT NULL THEN filter_reason WHEN rule = 2 THEN 'toxic_with_position' WHEN rule = 4 THEN 'borderline_for_llm' END AS moderation_reason,
  round(CASE WHEN filter_reason IS NOT NULL THEN least(0.5, weight0) ELSE least({S.weight_max}, (CASE WHEN rule = 2 THEN least({S.weight_max}, weight0 * {S.flagged_multiplier}::DOUBLE) ELSE weight0 END) + (CASE WHEN copies > 1 THEN least(1.25::DOUBLE, least(7, copies - 1) * 0.18::DOUBLE) ELSE 0 END)) END, 6) AS weight FROM f"""


def preprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.preprocess(spread(table(spark, sf_dir, "raw_comments")), table(spark, sf_dir, "videos"))


@query("flt_01_preprocess", _FULL)
def flt_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = preprocessed(spark, sf_dir)
    return p.select("comment_id", "video_id", "filter_reason", "is_filtered", "moderation_action", "moderation_reason", F.round("weight", 6).alias("weight"))


@query("flt_07_moderation", f"SELECT comment_id, moderation_action, moderation_reason FROM ({_FULL}) WHERE NOT is_filtered OR moderation_reason IN ('spam_link', 'profanity_only')")
def flt_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = preprocessed(spark, sf_dir).filter(~F.col("is_filtered") | F.col("moderation_reason").isin("spam_link", "profanity_only"))
    return p.select("comment_id", "moderation_action", "moderation_reason")


@query("flt_12_dropped_rows", f"SELECT comment_id, filter_reason, weight FROM ({_FULL}) WHERE is_filtered")
def flt_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocessed(spark, sf_dir).filter("is_filtered").select("comment_id", "filter_reason", F.round("weight", 6).alias("weight"))


@query("flt_14_flagged_weight", f"SELECT comment_id, weight FROM ({_FULL}) WHERE moderation_action = 'flag'")
def flt_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocessed(spark, sf_dir).filter("moderation_action = 'flag'").select("comment_id", F.round("weight", 6).alias("weight"))


@query("agg_01_reason_counts", f"SELECT coalesce(nullif(trim(filter_reason), ''), 'unspecified') AS reason, count(*) AS n FROM ({_FULL}) WHERE is_filtered GROUP BY 1 ORDER BY n DESC, reason")
def agg_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.reason_counts(preprocessed(spark, sf_dir).filter("is_filtered"), "filter_reason")


@query("agg_02_moderation_totals", f"SELECT count(*) AS total, count(*) FILTER (is_filtered) AS dropped, count(*) FILTER (moderation_action = 'flag') AS flagged, count(*) FILTER (moderation_action = 'keep') AS kept FROM ({_FULL})")
def agg_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.moderation_totals(preprocessed(spark, sf_dir))


_DUPLICATES = f"SELECT video_id, sha256(lower(t)) AS text_hash, count(*) AS n, least(1.25::DOUBLE, 0.18::DOUBLE * least(7, count(*) - 1)) AS boost FROM b WHERE t <> '' GROUP BY ALL HAVING count(*) > 1"


@query("agg_03_duplicates_per_hash", f"WITH {BASE} SELECT video_id, text_hash, n FROM ({_DUPLICATES})")
def agg_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _comments(spark, sf_dir).filter("t <> ''").groupBy("video_id", T.text_hash(F.lower("t")).alias("text_hash"))
    return c.agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("flt_15_volume_boost", f"WITH {BASE} SELECT video_id, text_hash, round(boost, 4) AS boost FROM ({_DUPLICATES})")
def flt_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg_03(spark, sf_dir).select("video_id", "text_hash", F.round(F.least(F.lit(1.25), F.least(F.lit(7), F.col("n") - 1) * 0.18), 4).alias("boost"))


@query("win_01_first_per_key", f"WITH {BASE} SELECT comment_id FROM (SELECT comment_id, row_number() OVER (PARTITION BY video_id, lower(t) ORDER BY comment_id) AS place FROM b) WHERE place = 1")
def win_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _comments(spark, sf_dir).select("comment_id", "video_id", F.lower("t").alias("low"))
    return c.groupBy("video_id", "low").agg(F.min("comment_id").alias("comment_id")).select("comment_id")
