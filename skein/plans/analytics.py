"""Text analytics of comments and clusters: categories, targets, keywords, intents, briefings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import appeal as A
from skein.operators import briefing as B
from skein.operators import topics as K
from skein.plans.filters import _q, _strip, like_sql, squeeze_sql, words_sql
from skein.plans.registry import query
from skein.sources import spread, table

AUTHOR = "Олег"
_LOWER = f"lower({squeeze_sql('coalesce(text_raw, chr(32))')})"


def _stems_sql(names: str) -> str:
    parts = f"list_filter(list_transform(regexp_split_to_array({names}, '[\\s\\p{{Z}}]+'), lambda p: regexp_replace(lower(p), '[^\\p{{L}}\\p{{N}}]+', '', 'g')), lambda p: length(p) >= 2)"
    stems = f"list_transform({parts}, lambda p: CASE WHEN length(regexp_replace(p, '[аеёийоуыьюя]+$', '')) < 2 THEN substring(p, 1, greatest(2, length(p) - 1)) ELSE regexp_replace(p, '[аеёийоуыьюя]+$', '') END)"
    return f"CASE WHEN len({parts}) > 0 THEN '(^|{T.NOT_W})(?:' || array_to_string({stems}, '|') || '){T.W}*($|{T.NOT_W})' END"


_GUESTS = "array_to_string(list_filter(list_transform(string_split(coalesce(guest_names, ''), ','), lambda x: trim(x)), lambda x: x <> ''), ' ')"
APPEAL = f"""g AS (SELECT video_id, {_stems_sql(_GUESTS)} AS guests FROM video_settings),
a AS (SELECT c.comment_id, c.video_id, text_raw, {_LOWER} AS t, {squeeze_sql("coalesce(text_raw, chr(32))")} AS s, len(string_split({_LOWER}, ' ')) AS n, g.guests, {_stems_sql(_q(AUTHOR))} AS author FROM raw_comments c LEFT JOIN g USING (video_id))"""
_BY_AUTHOR = f"(coalesce(regexp_matches(t, author), false) OR {like_sql('t', A.AUTHOR)})"
_BY_GUEST = "coalesce(regexp_matches(t, guests), false)"
_ADDRESSED = f"({_BY_AUTHOR} OR {_BY_GUEST} OR {like_sql('t', A.CONTENT)})"
_OFFENSIVE = f"({like_sql('t', A.OFFENSIVE)} OR {like_sql('t', A.DEROGATORY)})"
_QUESTION = f"({like_sql('t', A.QUESTION)} OR {like_sql('t', A.QUESTION_WORD)})"
CATEGORY = f"CASE WHEN n < 3 THEN 'skip' WHEN {_OFFENSIVE} AND {_ADDRESSED} THEN 'toxic' WHEN {_QUESTION} AND n >= 4 AND {_ADDRESSED} THEN 'question' WHEN {like_sql('t', A.CRITICISM)} AND n >= 5 AND {_ADDRESSED} THEN 'criticism' WHEN {like_sql('t', A.REQUEST)} AND NOT {like_sql('t', A.GRATITUDE)} AND ({_ADDRESSED} OR {like_sql('t', A.DIRECTIVE)}) THEN 'appeal' ELSE 'skip' END"
_SCORE = f"greatest(1, least(10, round_even(5.0::DOUBLE + (CASE WHEN n BETWEEN 8 AND 40 THEN 1.0 WHEN n > 40 THEN 0.5 WHEN n < 5 THEN -1.5 ELSE 0 END) + (CASE WHEN {like_sql('t', A.ARGUMENT)} THEN 1.5 ELSE 0 END) + (CASE WHEN len(regexp_extract_all(t, {_q(A.CRITICISM)})) >= 2 THEN 1.0 ELSE 0 END) - (CASE WHEN s = upper(s) AND s <> t AND length(s) > 15 THEN 2.0 ELSE 0 END) - (CASE WHEN n <= 4 THEN 1.0 ELSE 0 END) + (CASE WHEN {_QUESTION} AND {like_sql('t', A.QUESTION_WORD)} THEN 0.5 ELSE 0 END), 0)::INT))"
_INSULT = f"({like_sql('t', A.INSULT)} OR {like_sql('t', A.INSULT_PHRASE)})"
_ADDRESS = f"({like_sql('t', A.ADDRESS)} OR coalesce(regexp_matches(t, author), false))"
TARGET = f"CASE WHEN t <> '' AND ({_INSULT} OR {_ADDRESS} OR {_BY_GUEST} OR {like_sql('t', A.SHOW)}) THEN CASE WHEN {_ADDRESS} THEN 'author' WHEN {_BY_GUEST} THEN 'guest' WHEN {like_sql('t', A.SHOW)} THEN 'content' WHEN {like_sql('t', A.VAGUE)} THEN 'undefined' ELSE 'third_party' END END"
_SURE = f"CASE {TARGET} WHEN 'author' THEN (CASE WHEN {_INSULT} THEN 0.90 ELSE 0.55 END) WHEN 'guest' THEN (CASE WHEN {_INSULT} THEN 0.90 ELSE 0.55 END) WHEN 'content' THEN (CASE WHEN {_INSULT} THEN 0.85 ELSE 0.50 END) WHEN 'undefined' THEN (CASE WHEN {_INSULT} THEN 0.60 ELSE 0.40 END) WHEN 'third_party' THEN 0.30 END::DOUBLE"


def _addressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "video_settings").select("video_id", A.name_pattern(A.guest_names(F.col("guest_names"))).alias("guests"))
    c = spread(table(spark, sf_dir, "raw_comments")).select("comment_id", "video_id", F.coalesce("text_raw", F.lit(" ")).alias("text_raw"))
    return c.join(g, "video_id", "left").withColumn("author", A.name_pattern(F.array(F.lit(AUTHOR))))


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _addressed(spark, sf_dir).withColumn("category", A.category(F.col("text_raw"), F.col("author"), F.col("guests")))


@query("cls_02_category", f"WITH {APPEAL} SELECT comment_id, {CATEGORY} AS category FROM a")
def cls_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return categories(spark, sf_dir).select("comment_id", "category")


@query("cls_08_blocks", f"WITH {APPEAL} SELECT video_id, category, count(*) AS n FROM (SELECT video_id, {CATEGORY} AS category FROM a) WHERE category <> 'skip' GROUP BY ALL")
def cls_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return categories(spark, sf_dir).filter("category <> 'skip'").groupBy("video_id", "category").agg(F.count(F.lit(1)).alias("n"))


@query("mth_03_constructiveness", f"WITH {APPEAL} SELECT comment_id, {_SCORE} AS score FROM a")
def mth_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.lower(T.squeezed(F.col("text_raw")))
    return _addressed(spark, sf_dir).select("comment_id", A.constructiveness(F.col("text_raw"), t.rlike(A.QUESTION) | t.rlike(A.QUESTION_WORD)).alias("score"))


@query("cls_06_insult_target", f"WITH {APPEAL} SELECT comment_id, {TARGET} AS target, {_SURE} AS confidence FROM a WHERE {TARGET} IS NOT NULL")
def cls_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = A.insult_target(F.col("text_raw"), F.col("author"), F.col("guests"))
    return _addressed(spark, sf_dir).withColumn("told", told).filter(F.col("told").isNotNull()).select("comment_id", "told.target", "told.confidence")


@query("flt_19_offensive", f"WITH {APPEAL} SELECT comment_id, {_OFFENSIVE} AS narrow, {_INSULT} AS wide, trim(t) = '' OR {like_sql('t', A.OFFENSIVE_QUESTION)} AS question, trim(t) = '' OR {like_sql('t', A.OFFENSIVE_DISAGREEMENT)} AS disagreement FROM a")
def flt_19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four predicates, each with its own words; the last two take an empty text for offensive."""
    t = F.lower(T.squeezed(F.col("text_raw")))
    wide = t.rlike(A.INSULT) | t.rlike(A.INSULT_PHRASE)
    return _addressed(spark, sf_dir).select("comment_id", (t.rlike(A.OFFENSIVE) | t.rlike(A.DEROGATORY)).alias("narrow"), wide.alias("wide"), ((t == "") | t.rlike(A.OFFENSIVE_QUESTION)).alias("question"), ((t == "") | t.rlike(A.OFFENSIVE_DISAGREEMENT)).alias("disagreement"))


REFERS = f"(contains(t, '{AUTHOR.lower()}') OR {like_sql('t', A.AUTHOR_WORDS)})"
DISAGREES = f"(t <> '' AND NOT {like_sql('t', A.OFFENSIVE_DISAGREEMENT)} AND {REFERS} AND {like_sql('t', A.DISAGREEMENT)})"


@query("flt_20_author_reference", f"WITH {APPEAL} SELECT comment_id FROM a WHERE {REFERS}")
def flt_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "raw_comments")).filter(A.refers_to_author(F.col("text_raw"), AUTHOR)).select("comment_id")


@query("flt_21_author_disagreement", f"WITH {APPEAL} SELECT comment_id FROM a WHERE {DISAGREES}")
def flt_21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "raw_comments")).filter(A.author_disagreement(F.col("text_raw"), AUTHOR)).select("comment_id")


@query("str_13_name_pattern", f"WITH {APPEAL} SELECT video_id, guests FROM g")
def str_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "video_settings").select("video_id", A.name_pattern(A.guest_names(F.col("guest_names"))).alias("guests"))


@query("mth_04_strict_question_score", """WITH q AS (SELECT event_id, (event_id % 11)::INT AS score, (user_id % 10)::INT AS depth, CASE event_type WHEN 'click' THEN 'attack_ragebait' WHEN 'view' THEN 'analysis_why_how' WHEN 'purchase' THEN 'clarification_needed' ELSE 'other' END AS kind FROM events),
s AS (SELECT *, CASE WHEN depth >= 7 AND kind = 'clarification_needed' THEN least(score, 6) ELSE score END AS a FROM q), d AS (SELECT *, CASE WHEN depth <= 3 THEN least(a, 5) WHEN depth <= 5 THEN least(a, 7) WHEN depth = 6 THEN least(a, 8) ELSE a END AS b FROM s)
SELECT event_id, CASE WHEN kind = 'attack_ragebait' THEN least(score, 3) ELSE greatest(1, least(10, CASE WHEN depth >= 7 AND kind = 'analysis_why_how' THEN greatest(b, 7) ELSE b END)) END AS strict FROM d""")
def mth_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "attack_ragebait").when(F.col("event_type") == "view", "analysis_why_how").when(F.col("event_type") == "purchase", "clarification_needed").otherwise("other")
    return table(spark, sf_dir, "events").select("event_id", A.strict_score((F.col("event_id") % 11).cast("int"), (F.col("user_id") % 10).cast("int"), kind).alias("strict"))


_INTENT = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text_raw), {_q(s)})" for s in signs) + f" THEN '{name}'" for name, signs in K.INTENTS) + " ELSE 'other' END"


@query("agg_13_intents", f"SELECT video_id, {_INTENT} AS intent, count(*) AS n FROM raw_comments GROUP BY ALL")
def agg_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "raw_comments").groupBy("video_id", K.intent(F.col("text_raw")).alias("intent")).agg(F.count(F.lit(1)).alias("n"))


_VOTE = "len(list_filter(regexp_extract_all(lower(text_raw), '[\\p{{L}}\\p{{N}}_]{{3,}}'), lambda x: x IN ({})))"


@query("agg_14_sentiment", f"""SELECT video_id, positive, negative, CASE WHEN negative > positive + 1 THEN 'negative' WHEN positive > negative + 1 THEN 'positive' ELSE 'neutral' END AS sentiment
FROM (SELECT video_id, sum({_VOTE.format(', '.join(map(_q, K.POSITIVE)))})::BIGINT AS positive, sum({_VOTE.format(', '.join(map(_q, K.NEGATIVE)))})::BIGINT AS negative FROM raw_comments GROUP BY 1)""")
def agg_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.sentiments(table(spark, sf_dir, "raw_comments"), ["video_id"], "text_raw").select("video_id", "positive", "negative", "sentiment")


def keyword_sql(weight: str, drop: tuple[str, ...], most: int = 5, first: int = 0) -> str:
    """CTEs up to r (video_id, token, score, place): the salient words of each video, of its first comments where ``first`` is given."""
    words = f"list_filter({words_sql('lower(text_raw)', 4)}, lambda x: x NOT IN ({', '.join(map(_q, drop))}) AND NOT regexp_matches(x, '^\\p{{N}}+$'))"
    limit = f"QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY comment_id) <= {first}" if first else ""
    return f"""d AS (SELECT video_id, comment_id, {weight} AS w, {words} AS ws FROM raw_comments WHERE {squeeze_sql("text_raw")} <> '' {limit}),
n AS (SELECT video_id, count(*) AS docs FROM d GROUP BY 1), u AS (SELECT video_id, comment_id, w, unnest(ws) AS token FROM d),
g AS (SELECT video_id, token, count(*) AS tf, count(DISTINCT comment_id) AS df, sum(w) AS weight FROM u GROUP BY 1, 2),
s AS (SELECT g.*, round(tf * (1.6::DOUBLE - df::DOUBLE / docs) + 0.35::DOUBLE * weight / docs, 6) AS score FROM g JOIN n USING (video_id) WHERE tf >= CASE WHEN docs >= 6 THEN 2 ELSE 1 END AND df::DOUBLE / docs <= 0.72),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, token) AS place FROM s) WHERE place <= {most})"""


#: Comments that the words of a title are taken from.
FIRST = 24


@query("agg_15_keywords", f"WITH {keyword_sql('0.0::DOUBLE', (*K.STOPWORDS, *K.LOW_VALUE), first=FIRST)} SELECT video_id, token, score FROM r")
def agg_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.keywords(spread(table(spark, sf_dir, "raw_comments")), ["video_id"], "text_raw", first=FIRST, order=["comment_id"]).select("video_id", "token", "score")


LIKED = "greatest(0.1::DOUBLE, 1 + coalesce(like_count, 0)::DOUBLE)"


@query("agg_16_weighted_keywords", f"WITH {keyword_sql(LIKED, (*K.LABEL_STOPWORDS, *K.LABEL_LOW_VALUE))} SELECT video_id, token, score FROM r")
def agg_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spread(table(spark, sf_dir, "raw_comments")).withColumn("weight", 1 + F.coalesce("like_count", F.lit(0)).cast("double"))
    return K.keywords(c, ["video_id"], "text_raw", "weight").select("video_id", "token", "score")


@query("agg_17_keyword_set", f"""WITH t AS (SELECT video_id, text_raw, row_number() OVER (PARTITION BY video_id ORDER BY like_count DESC NULLS LAST, comment_id) AS place FROM raw_comments),
u AS (SELECT video_id, unnest(list_filter({words_sql("lower(text_raw)", 4)}, lambda x: x NOT IN ({", ".join(map(_q, K.STOPWORDS))}))) AS token FROM t WHERE place <= 48),
g AS (SELECT video_id, token, count(*) AS n, row_number() OVER (PARTITION BY video_id ORDER BY count(*) DESC, token) AS place FROM u GROUP BY 1, 2) SELECT video_id, token, n FROM g WHERE place <= 8""")
def agg_17(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "raw_comments").select("video_id", "comment_id", "like_count", "text_raw")
    top = c.withColumn("place", F.row_number().over(W.partitionBy("video_id").orderBy(F.desc_nulls_last("like_count"), "comment_id"))).filter("place <= 48")
    g = top.select("video_id", F.explode(F.filter(T.words(F.lower("text_raw"), 4), lambda x: ~x.isin(*K.STOPWORDS))).alias("token")).groupBy("video_id", "token").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(W.partitionBy("video_id").orderBy(F.desc("n"), "token"))
    return g.withColumn("place", place).filter("place <= 8").select("video_id", "token", "n")


def _named_titles(x: str) -> str:
    return f"list_filter({words_sql(f'lower({x})')}, lambda x: x NOT IN ({', '.join(map(_q, (*K.GENERIC_TITLE, *K.FUNCTION_WORDS)))}))"


_TITLE = squeeze_sql("title")
_TWICE = rf"(^|{T.NOT_W})(?:и|или|and|or){T.NOT_W}(.*{T.NOT_W})?(?:и|или|and|or)($|{T.NOT_W})"


_TRIMMED = f"trim(regexp_replace({_TITLE}, '^[ \\-:;,.]+|[ \\-:;,.]+$', '', 'g'))"


def title_sql(t: str, support: str) -> str:
    """Whether ``t`` is a valid title with lexical support in the text ``support``."""
    good = _named_titles(t)
    return f"(NOT regexp_matches({t}, '[/\\\\]') AND len({words_sql(t)}) BETWEEN 3 AND 10 AND len({good}) >= 2 AND NOT ({like_sql(f'lower({t})', K.BAD_TITLE)} AND len({good}) < 3) AND len(list_intersect({words_sql(f'lower({t})')}, ['misc', 'other', 'разное', 'прочее'])) = 0 AND len(list_filter({good}[1:4], lambda w: contains(coalesce({support}, ''), w))) > 0)"


@query("flt_27_valid_title", f"""WITH c AS (SELECT video_id AS id, string_agg(lower(text_raw), ' ' ORDER BY comment_id) AS support FROM (SELECT * FROM raw_comments WHERE text_raw IS NOT NULL QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY comment_id) <= 80) GROUP BY 1)
SELECT v.id FROM (SELECT id, {_TRIMMED} AS t FROM videos) v LEFT JOIN c ON c.id = v.id WHERE {title_sql('t', 'support')}""")
def flt_27(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that hold a word of their first 80 comments."""
    c = table(spark, sf_dir, "raw_comments").filter(F.col("text_raw").isNotNull()).select("video_id", "comment_id", "text_raw")
    first = c.withColumn("place", F.row_number().over(W.partitionBy("video_id").orderBy("comment_id"))).filter("place <= 80")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text_raw"))), lambda x: F.lower(x["text_raw"])), " ")
    support = first.groupBy(F.col("video_id").alias("id")).agg(joined.alias("support"))
    return table(spark, sf_dir, "videos").select("id", "title").join(support, "id", "left").filter(K.valid_title(F.col("title"), F.col("support"))).select("id")


@query("flt_28_single_claim", f"SELECT id FROM (SELECT id, lower({_TITLE}) AS t FROM videos) WHERE t <> '' AND NOT regexp_matches(t, '[/\\\\;|]') AND length(t) - length(replace(t, ':', '')) <= 1 AND length(t) - length(replace(t, ',', '')) <= 1 AND NOT (contains(t, ':') AND {like_sql('t', T.whole_word('и|или|and|or|but'))}) AND NOT {like_sql('t', _TWICE)}")
def flt_28(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "videos").filter(K.single_claim(F.col("title"))).select("id")


_DESC = squeeze_sql("coalesce(description, '')")


@query("flt_29_detailed_description", f"SELECT id FROM videos WHERE length({_DESC}) >= 96 AND len(regexp_extract_all({_DESC}, '[.!?]')) >= 2 AND len(list_filter(list_distinct({words_sql(f'lower({_DESC})', 4)}), lambda x: x NOT IN ({', '.join(map(_q, K.STOPWORDS))}))) >= 8")
def flt_29(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "videos").filter(K.detailed(F.coalesce("description", F.lit("")))).select("id")


def _tokens4(x: str) -> str:
    return f"list_filter(list_distinct({words_sql(f'lower({x})', 4)}), lambda x: x NOT IN ({', '.join(map(_q, K.STOPWORDS))}))"


@query("mth_08_support_score", f"SELECT comment_id, round(CASE WHEN len(d) = 0 OR len(c) = 0 THEN 0 ELSE len(list_intersect(d, c))::DOUBLE / greatest(1, least(10, len(d))) END, 6) AS support FROM (SELECT comment_id, {_tokens4('description')} AS d, {_tokens4('text_raw')} AS c FROM raw_comments JOIN videos ON id = video_id WHERE description IS NOT NULL)")
def mth_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "videos").filter(F.col("description").isNotNull()).select(F.col("id").alias("video_id"), "description")
    c = table(spark, sf_dir, "raw_comments").select("comment_id", "video_id", "text_raw")
    return c.join(v, "video_id").select("comment_id", F.round(K.support_score(F.col("description"), F.col("text_raw")), 6).alias("support"))


@query("mth_05_question_score", f"SELECT comment_id, (CASE WHEN contains(t, '?') THEN 5 ELSE 0 END) + (CASE WHEN {like_sql('lower(t)', B.QUESTION_START)} THEN 4 ELSE 0 END) + (CASE WHEN length(t) BETWEEN 35 AND 220 THEN 3 WHEN length(t) BETWEEN 20 AND 320 THEN 1 ELSE 0 END) + (CASE WHEN regexp_matches(lower(t), 'почему|как|что будет|что делать|зачем') THEN 2 ELSE 0 END) AS score FROM (SELECT comment_id, {squeeze_sql('text_raw')} AS t FROM raw_comments)")
def mth_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "raw_comments").select("comment_id", B.question_score(T.squeezed(F.col("text_raw"))).alias("score"))


@query("brf_03_key_question", f"""WITH q AS (SELECT video_id, comment_id, {squeeze_sql("text_raw")} AS t FROM raw_comments), s AS (SELECT video_id, comment_id, (CASE WHEN contains(t, '?') THEN 5 ELSE 0 END) + (CASE WHEN {like_sql('lower(t)', B.QUESTION_START)} THEN 4 ELSE 0 END) + (CASE WHEN length(t) BETWEEN 35 AND 220 THEN 3 WHEN length(t) BETWEEN 20 AND 320 THEN 1 ELSE 0 END) + (CASE WHEN regexp_matches(lower(t), 'почему|как|что будет|что делать|зачем') THEN 2 ELSE 0 END) AS score FROM q)
SELECT video_id, comment_id, score FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, comment_id) AS place FROM s WHERE score > 0) WHERE place = 1""")
def brf_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "raw_comments").select("video_id", "comment_id", B.question_score(T.squeezed(F.col("text_raw"))).alias("score")).filter("score > 0")
    best = s.groupBy("video_id").agg(F.max_by(F.struct("comment_id", "score"), F.struct("score", -F.col("comment_id"))).alias("b"))
    return best.select("video_id", "b.comment_id", "b.score")


_QUOTES = """q AS (SELECT video_id, list(text_raw) AS quotes, avg(is_toxic::INT) AS tone FROM (SELECT t.video_id, t.is_toxic, lower(t.text) AS text_raw FROM toxic_training_data t) GROUP BY 1)"""


def _hits(pattern: str) -> str:
    return f"len(list_filter(quotes, lambda x: {like_sql('x', pattern)}))"


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "toxic_training_data").groupBy("video_id").agg(F.collect_list(F.lower("text")).alias("quotes"), F.avg(F.col("is_toxic").cast("int")).alias("tone"))
    return t.withColumn("sentiment", F.when(F.col("tone") > 0.5, "negative").otherwise("neutral"))


@query("agg_30_signal_ratios", f"WITH {_QUOTES} SELECT video_id, round({_hits(B.FACTUAL)}::DOUBLE / len(quotes), 6) AS factual, round({_hits(B.CONFUSION)}::DOUBLE / len(quotes), 6) AS confusion, round({_hits(B.TOXIC)}::DOUBLE / len(quotes), 6) AS toxic FROM q")
def agg_30(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("quotes")
    return _quotes(spark, sf_dir).select("video_id", F.round(B.share_of(q, B.FACTUAL), 6).alias("factual"), F.round(B.share_of(q, B.CONFUSION), 6).alias("confusion"), F.round(B.share_of(q, B.TOXIC), 6).alias("toxic"))


@query("mth_13_misunderstanding_and_risk", f"""WITH {_QUOTES}, h AS (SELECT video_id, len(quotes) AS n, {_hits(B.FACTUAL)} AS f, {_hits(B.CONFUSION)} AS c, {_hits(B.TOXIC)} AS x, tone FROM q),
s AS (SELECT *, f::DOUBLE / n * 0.6::DOUBLE + c::DOUBLE / n * 0.4::DOUBLE AS m, x::DOUBLE / n * 0.75::DOUBLE + (CASE WHEN tone > 0.5 THEN 0.25::DOUBLE ELSE 0 END) AS r FROM h)
SELECT video_id, CASE WHEN n >= 2 AND m >= 0.2 AND greatest(f, c) >= 2 THEN round(m, 6) END AS misunderstanding, CASE WHEN r >= 0.28 AND x >= 2 THEN round(r, 6) END AS risk FROM s""")
def mth_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quotes(spark, sf_dir).select("video_id", F.round(B.misunderstanding(F.col("quotes")), 6).alias("misunderstanding"), F.round(B.risk(F.col("quotes"), F.col("sentiment")), 6).alias("risk"))


@query("mth_06_action_priority", f"WITH {_QUOTES}, h AS (SELECT *, {_hits(B.TOXIC)} AS x, {_hits(B.FACTUAL)} AS f FROM q) SELECT video_id, (CASE WHEN tone > 0.5 THEN 50 ELSE 0 END) + x * 15 + f * 20 + trunc(len(quotes) * 100.0::DOUBLE)::INT AS priority FROM h")
def mth_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size("quotes").cast("double")
    return _quotes(spark, sf_dir).select("video_id", B.action_priority(n, F.col("sentiment"), F.col("quotes"), F.lit(0), F.lit(0)).cast("bigint").alias("priority"))


@query("str_08_snippet", f"""SELECT comment_id, CASE WHEN length(t) > 80 THEN regexp_replace(substring(t, 1, 79), '[ ,.;:]+$', '') || '…' ELSE t END AS snippet FROM (SELECT comment_id, regexp_replace({squeeze_sql("text_raw")}, '^[«»"'']+|[«»"'']+$', '', 'g') AS t FROM raw_comments)""")
def str_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "raw_comments").select("comment_id", B.snippet(F.col("text_raw"), 80).alias("snippet"))


@query("str_14_video_id", "SELECT id, regexp_extract(url, '[?&]v=([A-Za-z0-9_-]{6,})', 1) AS video_key FROM videos")
def str_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "videos").select("id", T.video_id_of(F.col("url")).alias("video_key"))


@query("str_19_first_filled", f"SELECT id, coalesce(nullif({_strip('description')}, ''), nullif({_strip('title')}, '')) AS shown FROM videos")
def str_19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "videos").select("id", T.first_filled(F.col("description"), F.col("title")).alias("shown"))


@query("arr_02_question_split", "SELECT video_id, count(*) FILTER (contains(text_raw, '?')) AS questions, count(*) FILTER (NOT contains(text_raw, '?')) AS others FROM raw_comments GROUP BY 1")
def arr_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of a video as an array, split in two by a predicate."""
    g = table(spark, sf_dir, "raw_comments").groupBy("video_id").agg(F.count_if(F.col("text_raw").contains("?")).alias("questions"), F.count_if(~F.col("text_raw").contains("?")).alias("others"))
    return g.select("video_id", "questions", "others")


@query("jsn_03_parsed_payload", "SELECT payload_id, json_extract_string(payload, '$.author_name') AS author, json_extract_string(payload, '$.like_count')::INT AS likes FROM raw_payloads")
def jsn_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.from_json("payload", "author_name string, like_count int")
    return table(spark, sf_dir, "raw_payloads").select("payload_id", o["author_name"].alias("author"), o["like_count"].alias("likes"))


@query("jsn_04_round_trip", "SELECT payload_id, json_extract_string(payload, '$.text_raw') AS text FROM raw_payloads")
def jsn_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = "author_name string, text_raw string, like_count int"
    again = F.from_json(F.to_json(F.from_json("payload", kind)), kind)
    return table(spark, sf_dir, "raw_payloads").select("payload_id", again["text_raw"].alias("text"))


_QUOTE = "CASE id % 5 WHEN 0 THEN text WHEN 1 THEN substring(text, 4, 60) WHEN 2 THEN replace(replace(substring(text, 3, 70), ',', ' —'), ' ', '  ') WHEN 3 THEN '«' || upper(text) || '»' ELSE replace(text, ' ', '') END"
# DuckDB gives a character one capital; those of which Spark makes several letters stay
_CAPITALS = "CASE WHEN length(upper(text)) = length(text) THEN upper(text) ELSE array_join(transform(split(text, ''), x -> CASE WHEN length(upper(x)) = 1 THEN upper(x) ELSE x END), '') END"
_NORM = lambda x: f"lower({squeeze_sql(x)})"
_BARE = lambda x: f"regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


@query("join_15_quote_match", f"""WITH q AS (SELECT id, video_id, {_NORM(_QUOTE)} AS q FROM toxic_training_data WHERE text IS NOT NULL), c AS (SELECT comment_id, video_id, coalesce(like_count, 0) AS likes, {_NORM('text_raw')} AS t FROM raw_comments WHERE text_raw IS NOT NULL),
m AS (SELECT q.id, comment_id, likes, CASE WHEN q = t THEN 0 WHEN length(q) >= 26 AND contains(t, q) THEN 1 WHEN length({_BARE('q')}) >= 22 AND contains({_BARE('t')}, {_BARE('q')}) THEN 2 END AS tier FROM q JOIN c USING (video_id) WHERE q <> '' AND t <> '')
SELECT id AS quote_id, comment_id, tier FROM m WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY tier, -likes, comment_id) = 1""")
def join_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes, some shortened, with other marks, in capitals or without spaces, and the comment of their video that each came from."""
    q = table(spark, sf_dir, "toxic_training_data").filter(F.col("text").isNotNull()).select("video_id", F.col("id").alias("quote_id"), F.expr(_QUOTE.replace("upper(text)", _CAPITALS)).alias("quote"))
    c = table(spark, sf_dir, "raw_comments").filter(F.col("text_raw").isNotNull()).select("video_id", "comment_id", (-F.coalesce("like_count", F.lit(0))).alias("rank"), F.col("text_raw").alias("text"))
    return K.matched_quotes(q, spread(c), ["video_id"]).select("quote_id", "comment_id", "tier")


@query("win_14_near_duplicates")
def win_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "raw_comments").select("video_id", F.col("comment_id").alias("id"), (-F.coalesce("like_count", F.lit(0))).alias("rank"), F.col("text_raw").alias("text"))
    return K.without_near_duplicates(c, "video_id")


@query("win_15_unique_labels")
def win_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = K.keywords(spread(table(spark, sf_dir, "raw_comments")), ["video_id"], "text_raw").groupBy("video_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "token"))), lambda x: x["token"]).alias("tokens"))
    v = table(spark, sf_dir, "videos").select(F.col("id").alias("video_id"), "playlist_id", F.split("title", ":")[0].alias("label")).join(words, "video_id")
    return K.unique_labels(v.withColumn("ord", F.col("video_id")), "playlist_id")
