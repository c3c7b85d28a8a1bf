"""Answers of models about comments: parsers, promotion, verification, blocks and their report.

The answers are made from the rows by one expression that both engines read. They hold what models
send: fenced, with words around, without the wrapper, broken, out of range and with fields missing.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions import answers as N
from skein.functions import text as T
from skein.operators import appeal as A
from skein.operators import providers as M
from skein.plans.analytics import _ADDRESS, _INSULT, APPEAL, CATEGORY, _addressed, _q, categories
from skein.plans.filters import like_sql, squeeze_sql
from skein.plans.registry import query
from skein.settings import DEFAULT as S
from skein.sources import table

#: Numbers of one batch in the made-up answers.
BATCH = 2


def answer_sql(value: str) -> str:
    """Answer text with ``value`` (an SQL expression for JSON) under number 1, a number beyond the batch and one that is none."""
    inner = f"""'{{"1": ' || {value} || ', "99": ' || {value} || ', "x": 1}}'"""
    whole = f"""'{{"results": ' || {inner} || '}}'"""
    return f"""CASE id % 8 WHEN 1 THEN '```json' || chr(10) || {whole} || chr(10) || '```' WHEN 2 THEN {inner} WHEN 4 THEN '{{"results": {{"1": [1, 2]}}}}' WHEN 5 THEN '{{"results": {{"1": ' WHEN 6 THEN 'Вот ответ: ' || {whole} || ' и все.' WHEN 7 THEN '{{"results": {{"1": {{}}}}}}' ELSE {whole} END"""


_TYPES = (*N.REAL_TYPES, *N.LOW_TYPES, "unheard_of")
_PICK = lambda options, n: "CASE " + " ".join(f"WHEN {n} % {len(options)} = {i} THEN {_q(o)}" for i, o in enumerate(options)) + " END"
REFINER = answer_sql(f"""'{{"topic": "' || {_PICK((*N.TOPICS, 'Sport'), 'id')} || '", "score": ' || CAST(id % 14 - 1 AS STRING) || ', "depth_score": "' || CAST(id % 13 - 1 AS STRING) || '", "question_type": "' || {_PICK(_TYPES, 'id')} || '", "short": "«Почему так» вышло ' || CAST(id AS STRING) || CASE WHEN id % 3 = 0 THEN '?' WHEN id % 3 = 1 THEN '!.' ELSE ' 👍' END || '"}}'""")
TARGETED = answer_sql(f"""'{{"target": "' || {_PICK((*N.TARGETS, 'viewer'), 'id')} || '", "confidence": ' || CAST((id % 15) / 10.0 - 0.2 AS DECIMAL(4,1)) || '}}'""")
PRECISE = answer_sql("CASE WHEN id % 5 = 0 THEN '\"sure\"' ELSE CAST(CAST((id % 15) / 10.0 - 0.2 AS DECIMAL(4,1)) AS STRING) END")
VERDICT = answer_sql(f"""'{{"allow_auto_ban": ' || CASE WHEN id % 3 = 0 THEN 'false' ELSE 'true' END || ', "confidence": ' || CAST((id % 15) / 10.0 - 0.2 AS DECIMAL(4,1)) || ', "target_confirmed": "' || {_PICK(('Author ', 'guest', 'content', 'third_party', 'nobody'), 'id')} || '"}}'""")
POLITICAL = answer_sql("CASE id % 7 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN '0' WHEN 3 THEN '3' WHEN 4 THEN '\"keep\"' WHEN 5 THEN '\"no\"' ELSE 'null' END")
UNIFIED = answer_sql("CASE id % 9 WHEN 0 THEN '\"question:7\"' WHEN 1 THEN '\"Criticism:99\"' WHEN 2 THEN '\"toxic\"' WHEN 3 THEN '\"question\"' WHEN 4 THEN '\"praise:3\"' WHEN 5 THEN '\"criticism:x\"' WHEN 6 THEN '\"skip\"' WHEN 7 THEN '\"appeal:0\"' ELSE '\" SKIP : 4\"' END")
INDICES = """CASE id % 6 WHEN 0 THEN '[1, 2, "x", 3.7]' WHEN 1 THEN '{"indices": [2]}' WHEN 2 THEN '{"numbers": "none", "result": [1, 3]}' WHEN 3 THEN '```json' || chr(10) || '{"comments": [4]}' || chr(10) || '```' WHEN 4 THEN '{"indices": []}' ELSE 'nothing' END"""

_BODY = "CASE WHEN json_valid(regexp_extract(answer, '(?s)\\{.*\\}')) THEN regexp_extract(answer, '(?s)\\{.*\\}') END"


def told_sql(answer: str, source: str) -> str:
    """CTE x (id, e): the JSON value under number 1 of each row's answer; null where there is none."""
    return f"b AS (SELECT id, {answer} AS answer FROM {source}), y AS (SELECT id, {_BODY} AS body FROM b), x AS (SELECT id, coalesce(json_extract(body, '$.results.\"1\"'), json_extract(body, '$.\"1\"')) AS e FROM y)"


def _f(name: str) -> str:
    return f"json_extract_string(e, '$.{name}')"


_TOXIC = "toxic_training_data"
_WHOLE = "greatest({low}, least({high}, coalesce(trunc(TRY_CAST(trim({v}) AS DOUBLE))::INT, {default})))"
_SHARE = "greatest(0.0, least(1.0, coalesce(TRY_CAST(trim({v}) AS DOUBLE), 0.0)))"
_KIND = f"CASE WHEN {_f('question_type')} IN ({', '.join(map(_q, (*N.REAL_TYPES, *N.LOW_TYPES)))}) THEN {_f('question_type')} ELSE 'clarification_needed' END"
_LOW = ", ".join(map(_q, N.LOW_TYPES))
_REAL = ", ".join(map(_q, N.REAL_TYPES))


def short_sql(t: str, kind: str) -> str:
    """The summary rule in steps; ``t`` is the raw text."""
    a = f"regexp_replace(regexp_replace({t}, '[\\x{{1F600}}-\\x{{1F64F}}\\x{{1F300}}-\\x{{1F5FF}}\\x{{1F680}}-\\x{{1F9FF}}\\x{{2600}}-\\x{{27BF}}\\x{{1FA00}}-\\x{{1FAFF}}]+', '', 'g'), '[«»„\"“”‘’]', '', 'g')"
    a = f"regexp_replace(regexp_replace({a}, '^[ \\t\\n\"'']+|[ \\t\\n\"'']+$', '', 'g'), '  +', ' ', 'g')"
    a = f"CASE WHEN length({a}) > 160 THEN regexp_replace(substring({a}, 1, 157), '[ ,;]+$', '') || '…' ELSE {a} END"
    return f"(SELECT nullif(CASE WHEN s = '' THEN NULL WHEN {kind} IN ({_REAL}) THEN CASE WHEN suffix(s, '?') THEN s ELSE regexp_replace(s, '[.!]+$', '') || '?' END WHEN {kind} IN ({_LOW}) THEN regexp_replace(regexp_replace(s, '[?]+$', ''), ' +$', '') ELSE s END, '') FROM (SELECT {a} AS s))"


_REFINED = f"""k AS (SELECT id, {_KIND} AS kind, {_WHOLE.format(low=1, high=10, v=_f('score'), default=5)} AS raw, {_WHOLE.format(low=0, high=10, v=_f('depth_score'), default=0)} AS depth, CASE WHEN {_f('topic')} IN ({', '.join(map(_q, N.TOPICS))}) THEN {_f('topic')} ELSE 'Other' END AS topic, {_f('short')} AS short FROM x WHERE json_type(e) = 'OBJECT'),
s1 AS (SELECT *, CASE WHEN depth >= 7 AND kind = 'clarification_needed' THEN least(raw, 6) ELSE raw END AS a FROM k), s2 AS (SELECT *, CASE WHEN depth <= 3 THEN least(a, 5) WHEN depth <= 5 THEN least(a, 7) WHEN depth = 6 THEN least(a, 8) ELSE a END AS b FROM s1),
q AS (SELECT id, topic, CASE WHEN kind IN ({_LOW}) THEN least(raw, 3) WHEN depth >= 7 AND kind IN ('analysis_why_how', 'prediction_what_next', 'fact_check', 'myth_claim', 'strategy_advice') THEN greatest(b, 7) ELSE greatest(1, b) END AS score, {short_sql('short', 'kind')} AS short, CASE WHEN kind IN ({_LOW}) THEN least(depth, 3) ELSE depth END AS depth_score, kind AS question_type FROM s2)"""


def refined_sql(told: str) -> str:
    """CTEs up to q (id, topic, score, short, depth_score, question_type) for the answers of CTE x."""
    return f"{told}, {_REFINED}"


def _answers(spark: SparkSession, sf_dir: str, answer: str) -> DataFrame:
    return table(spark, sf_dir, _TOXIC).select("id", F.expr(answer).alias("answer"))


@query("cls_03_refined_questions", f"WITH {refined_sql(told_sql(REFINER, _TOXIC))} SELECT * FROM q")
def cls_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic, strict score, summary, depth and type of each question that the refiner answered."""
    r = _answers(spark, sf_dir, REFINER).select("id", F.explode(N.refined(F.col("answer"), BATCH)).alias("r"))
    return r.select("id", "r.topic", "r.score", "r.short", "r.depth_score", "r.question_type")


@query("jsn_03_targets", f"WITH {told_sql(TARGETED, _TOXIC)} SELECT id, CASE WHEN {_f('target')} IN ({', '.join(map(_q, N.TARGETS))}) THEN {_f('target')} ELSE 'undefined' END AS target, {_SHARE.format(v=_f('confidence'))} AS confidence FROM x WHERE json_type(e) = 'OBJECT'")
def jsn_03_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _answers(spark, sf_dir, TARGETED).select("id", F.explode(N.targets(F.col("answer"), BATCH)).alias("r"))
    return r.select("id", "r.target", "r.confidence")


@query("jsn_03_precisions", f"WITH {told_sql(PRECISE, _TOXIC)} SELECT id, {_SHARE.format(v='''json_extract_string(e, '$')''')} AS confidence FROM x WHERE e IS NOT NULL")
def jsn_03_precisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _answers(spark, sf_dir, PRECISE).select("id", F.explode(N.precisions(F.col("answer"), BATCH)).alias("r"))
    return r.select("id", "r.confidence")


_ALLOWED = f"coalesce({_f('allow_auto_ban')}, 'false') = 'true'"
_CONFIRMED = f"CASE WHEN lower(trim({_f('target_confirmed')})) IN ({', '.join(map(_q, N.TARGETS))}) THEN lower(trim({_f('target_confirmed')})) ELSE 'undefined' END"


@query("jsn_03_verdicts", f"WITH {told_sql(VERDICT, _TOXIC)} SELECT id, {_ALLOWED} AS allow_auto_ban, {_SHARE.format(v=_f('confidence'))} AS confidence, {_CONFIRMED} AS target_confirmed FROM x WHERE json_type(e) = 'OBJECT'")
def jsn_03_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _answers(spark, sf_dir, VERDICT).select("id", F.explode(N.verdicts(F.col("answer"), BATCH)).alias("r"))
    return r.select("id", "r.allow_auto_ban", "r.confidence", "r.target_confirmed")


_KEEP = "CASE WHEN e IS NULL OR json_type(e) IN ('NULL', 'OBJECT', 'ARRAY') THEN true WHEN TRY_CAST(json_extract_string(e, '$') AS INT) IS NOT NULL THEN TRY_CAST(json_extract_string(e, '$') AS INT) <> 0 ELSE lower(trim(json_extract_string(e, '$'))) IN ('true', 'yes', '1', 'keep') END"


@query("jsn_03_kept", f"WITH {told_sql(POLITICAL, _TOXIC)} SELECT id, 1 AS number, {_KEEP} AS keep FROM x UNION ALL SELECT id, 2, true FROM x")
def jsn_03_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _answers(spark, sf_dir, POLITICAL).select("id", F.explode(N.kept(F.col("answer"), BATCH)).alias("r"))
    return r.select("id", "r.number", "r.keep")


_CAT = "lower(trim(json_extract_string(e, '$')))"


@query("jsn_03_unified", f"""WITH {told_sql(UNIFIED, _TOXIC)}, z AS (SELECT id, {_CAT} AS v, trim(regexp_replace({_CAT}, ':[^:]*$', '')) AS category FROM x WHERE e IS NOT NULL)
SELECT id, category, CASE WHEN contains(v, ':') AND TRY_CAST(trim(regexp_extract(v, ':([^:]*)$', 1)) AS INT) IS NOT NULL THEN greatest(1, least(10, TRY_CAST(trim(regexp_extract(v, ':([^:]*)$', 1)) AS INT))) WHEN category IN ('criticism', 'question') THEN 5 ELSE 0 END AS score FROM z WHERE category IN ({", ".join(map(_q, N.CATEGORIES))})""")
def jsn_03_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _answers(spark, sf_dir, UNIFIED).select("id", F.explode(N.unified(F.col("answer"), BATCH)).alias("r"))
    return r.select("id", "r.category", "r.score")


@query("jsn_03_indices", "SELECT id, unnest(CASE id % 6 WHEN 0 THEN [1, 2, 3] WHEN 1 THEN [2] WHEN 2 THEN [1, 3] WHEN 3 THEN [4] ELSE []::INT[] END) AS number FROM toxic_training_data")
def jsn_03_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir, INDICES).select("id", F.explode(N.indices(F.col("answer"))).alias("number"))


@query("str_11_short_form", f"SELECT comment_id, {short_sql('text_raw', 'kind')} AS short FROM (SELECT comment_id, text_raw, CASE comment_id % 3 WHEN 0 THEN 'fact_check' WHEN 1 THEN 'meme_one_liner' ELSE 'none' END AS kind FROM raw_comments)")
def str_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without pictographs and quotation marks, at most 160 characters; real questions end with a question mark, low-value ones without."""
    kind = F.when(F.col("comment_id") % 3 == 0, "fact_check").when(F.col("comment_id") % 3 == 1, "meme_one_liner").otherwise("none")
    return table(spark, sf_dir, "raw_comments").select("comment_id", N.short_form(F.col("text_raw"), kind).alias("short"))


# --- promotion and demotion ----------------------------------------------------------------------

_SIGNAL = f"({like_sql('t', A.QUESTION)} OR {like_sql('t', A.QUESTION_WORD)})"
#: Answers of the refiner about comments; every fifth comment got none.
_ASKED = re.sub(r"\bid\b", "comment_id", REFINER)
_REFINED_COMMENTS = refined_sql(told_sql(REFINER, "(SELECT comment_id AS id FROM raw_comments WHERE comment_id % 5 <> 0)"))


@query("cls_04_promotion", f"""WITH {APPEAL}, {_REFINED_COMMENTS}, c AS (SELECT comment_id, {CATEGORY} AS category, {_SIGNAL} AS signal FROM a), j AS (SELECT c.*, q.question_type AS kind, q.score FROM c LEFT JOIN q ON q.id = c.comment_id AND (category = 'question' OR (category = 'criticism' AND signal)) WHERE category IN ('question', 'criticism')),
p AS (SELECT *, category = 'criticism' AND signal AND kind IS NOT NULL AND kind NOT IN ({_LOW}) AS promoted FROM j)
SELECT comment_id, CASE WHEN NOT (category = 'question' OR promoted) THEN 'criticism' WHEN kind IS NULL THEN 'question' WHEN kind IN ({_LOW}) OR (kind = 'clarification_needed' AND score <= 5 AND NOT signal) THEN 'criticism' ELSE 'question' END AS category, score FROM p""")
def cls_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions and criticism after the refiner: criticism that asks is promoted to a question, a
    question of low value is demoted to criticism, and the refiner's score replaces the classifier's."""
    t = F.lower(T.squeezed(F.col("text_raw")))
    c = categories(spark, sf_dir).filter(F.col("category").isin("question", "criticism")).withColumn("signal", t.rlike(A.QUESTION) | t.rlike(A.QUESTION_WORD))
    sent = (F.col("category") == "question") | F.col("signal")
    answer = F.when(sent & (F.col("comment_id") % 5 != 0), F.expr(_ASKED))
    c = c.withColumn("r", F.get(N.refined(answer, BATCH), F.lit(0)))
    return A.promoted(c, F.col("category"), F.col("signal"), F.col("r.question_type"), F.col("r.score")).select("comment_id", "category", F.col("r.score").alias("score"))


@query("cls_05_political_filter")
def cls_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Criticism that a model keeps, in batches of 20; all rows of a batch that fails are kept, and rows without an answer."""

    def factory() -> M.Answerer:
        def ask(texts: list[str]) -> list[str | None]:
            if any("эфир" in (t or "").lower() for t in texts[:1]):
                raise TimeoutError("no answer")
            return ['{"results": {"1": false}}' if "видео" in (t or "").lower() else None for t in texts]

        return ask

    c = categories(spark, sf_dir).filter("category = 'criticism'").select("comment_id", "text_raw")
    answers = M.answered(c, "comment_id", "text_raw", factory, batch=20)
    told = M.with_fallback(c, answers, "comment_id", F.get(N.kept(F.col("answer"), 1), F.lit(0))["keep"], F.lit(True), "keep")
    return told.filter("keep").select("comment_id")


@query("cls_07_verified", f"""WITH {told_sql(VERDICT, _TOXIC)}, v AS (SELECT id, {_ALLOWED} AND {_CONFIRMED} IN ('author', 'guest', 'content') AND {_SHARE.format(v=_f('confidence'))} >= {S.auto_ban_review} AS confirmed FROM x WHERE json_type(e) = 'OBJECT')
SELECT t.id, CASE WHEN coalesce(v.confirmed, false) THEN 'confirmed_auto_ban' ELSE 'downgraded_to_manual_review' END AS status FROM {_TOXIC} t LEFT JOIN v USING (id) WHERE t.insult_target IN ('author', 'guest', 'content') AND t.confidence_score >= 0.8""")
def cls_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates for a ban that a second look confirms; without a clear answer they fall back to review."""
    t = table(spark, sf_dir, _TOXIC).filter(F.col("insult_target").isin("author", "guest", "content") & (F.col("confidence_score") >= 0.8))
    v = F.get(N.verdicts(F.expr(VERDICT), BATCH), F.lit(0))
    confirmed = v["allow_auto_ban"] & v["target_confirmed"].isin("author", "guest", "content") & (v["confidence"] >= S.auto_ban_review)
    return t.select("id", F.when(F.coalesce(confirmed, F.lit(False)), "confirmed_auto_ban").otherwise("downgraded_to_manual_review").alias("status"))


@query("cls_09_author_appeals", f"WITH {APPEAL} SELECT comment_id FROM a WHERE trim(t) <> '' AND (coalesce(regexp_matches(t, author), false) OR {like_sql('t', A.FORMAL)} OR {like_sql('t', A.FAMILIAR)})")
def cls_09_author_appeals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.lower(T.squeezed(F.col("text_raw")))
    return _addressed(spark, sf_dir).filter((t != "") & (A.named(t, F.col("author")) | t.rlike(A.FORMAL) | t.rlike(A.FAMILIAR))).select("comment_id")


@query("cls_09_toxic_to_author", f"WITH {APPEAL} SELECT comment_id FROM a WHERE trim(t) <> '' AND {_INSULT} AND {_ADDRESS}")
def cls_09_toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offensive comments that address the author by name or pronoun: the detector's rule without a model."""
    t = F.lower(T.squeezed(F.col("text_raw")))
    return _addressed(spark, sf_dir).filter((t != "") & (t.rlike(A.INSULT) | t.rlike(A.INSULT_PHRASE)) & (t.rlike(A.ADDRESS) | A.named(t, F.col("author")))).select("comment_id")


@query("cls_09_precise", f"WITH {told_sql(PRECISE, _TOXIC)} SELECT id FROM x WHERE e IS NOT NULL AND {_SHARE.format(v='''json_extract_string(e, '$')''')} >= {S.precision}")
def cls_09_precise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic rows that the precision filter is sure of."""
    r = _answers(spark, sf_dir, PRECISE).select("id", F.explode(N.precisions(F.col("answer"), BATCH)).alias("r"))
    return r.filter(F.col("r.confidence") >= S.precision).select("id")


# --- blocks and their report -----------------------------------------------------------------------

_BLOCK = "CASE WHEN t.is_toxic AND t.insult_target IN ('author', 'guest', 'content') AND t.confidence_score >= 0.8 THEN 'toxic_auto_banned' WHEN t.is_toxic THEN 'toxic_manual_review' WHEN t.id % 4 = 0 THEN 'constructive_question' WHEN t.id % 4 = 1 THEN 'constructive_criticism' WHEN t.id % 4 = 2 THEN 'author_appeal' ELSE 'spam' END"
# Order of the blocks.
ORDER = {"constructive_question": 1, "constructive_criticism": 2, "author_appeal": 3, "toxic_auto_banned": 4, "toxic_manual_review": 5}
_PLACE = "CASE block_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ORDER.items()) + " ELSE 99 END"
#: Rows of the blocks, with score and comment; texts of missing comments are empty.
_ITEMS = f"""{refined_sql(told_sql(REFINER, _TOXIC))}, i AS (SELECT t.id, t.video_id, {_BLOCK} AS block_type, t.comment_id, coalesce(t.author_name, 'Unknown') AS author, {squeeze_sql("coalesce(c.text_raw, '')")} AS text, c.author_channel_id AS channel, q.score FROM {_TOXIC} t LEFT JOIN q USING (id) LEFT JOIN raw_comments c ON c.comment_id = t.comment_id)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, _TOXIC).alias("t")
    items = t.select("id", "video_id", F.expr(_BLOCK).alias("block_type"), "comment_id", F.coalesce("author_name", F.lit("Unknown")).alias("author"), F.get(N.refined(F.expr(REFINER), BATCH), F.lit(0)).alias("r"), "confidence_score", "insult_target")
    c = table(spark, sf_dir, "raw_comments").select("comment_id", "text_raw", F.col("author_channel_id").alias("channel"))
    return items.join(c, "comment_id", "left").withColumn("text", T.squeezed(F.coalesce("text_raw", F.lit("")))).withColumn("score", F.col("r.score"))


@query("snk_07_block_items", f"""WITH {refined_sql(told_sql(REFINER, _TOXIC))}, d AS (SELECT t.id, {_BLOCK} AS block_type, q.score, q.topic, q.short, q.depth_score, q.question_type, t.is_toxic, t.confidence_score, t.insult_target FROM {_TOXIC} t LEFT JOIN q USING (id))
SELECT id, block_type, score, topic, short, question_type, CASE WHEN is_toxic THEN confidence_score END AS confidence, CASE WHEN is_toxic THEN insult_target END AS target FROM d""")
def snk_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the persisted blocks: the detail JSON holds score, refiner fields and, of toxic rows, confidence and
    target, and leaves out what is null; it is read back here as a reader would."""
    t = table(spark, sf_dir, _TOXIC).alias("t")
    r = F.get(N.refined(F.expr(REFINER), BATCH), F.lit(0))
    detail = A.block_detail(r, F.when(F.col("is_toxic"), F.col("confidence_score")), F.when(F.col("is_toxic"), F.col("insult_target")))
    back = F.from_json("detail", "score int, topic string, short string, question_type string, confidence_score double, insult_target string")
    d = t.select("id", F.expr(_BLOCK).alias("block_type"), detail.alias("detail")).withColumn("d", back)
    return d.select("id", "block_type", "d.score", "d.topic", "d.short", "d.question_type", F.col("d.confidence_score").alias("confidence"), F.col("d.insult_target").alias("target"))


@query("api_06_appeal_blocks", f"""WITH {_ITEMS} SELECT video_id, block_type, {_PLACE} AS sort_order, comment_id, author, text, score, channel, row_number() OVER (PARTITION BY video_id, block_type ORDER BY CASE WHEN block_type IN ('constructive_question', 'constructive_criticism') THEN coalesce(score, 0) ELSE 0 END DESC, id) AS place FROM i WHERE block_type <> 'spam'""")
def api_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of all blocks but the legacy one, in the order of the report: blocks by their place, questions and criticism by score."""
    i = _items(spark, sf_dir).filter("block_type <> 'spam'")
    scored = F.when(F.col("block_type").isin("constructive_question", "constructive_criticism"), F.coalesce("score", F.lit(0))).otherwise(0)
    order = F.coalesce(F.create_map(*[F.lit(x) for kv in ORDER.items() for x in kv])[F.col("block_type")], F.lit(99))
    place = F.row_number().over(W.partitionBy("video_id", "block_type").orderBy(scored.desc(), "id"))
    return i.select("video_id", "block_type", order.alias("sort_order"), "comment_id", "author", "text", "score", "channel", place.cast("bigint").alias("place"))


@query("api_06_banned_authors", f"""WITH {_ITEMS}, n AS (SELECT comment_id, id AS ban, youtube_banned FROM banned_users WHERE comment_id IS NOT NULL AND unbanned_at IS NULL QUALIFY row_number() OVER (PARTITION BY comment_id ORDER BY banned_at DESC, id DESC) = 1),
g AS (SELECT i.video_id, coalesce(channel, 'name:' || author) AS author_key, i.id, author, n.ban, coalesce(n.youtube_banned, false) AS yt FROM i LEFT JOIN n USING (comment_id) WHERE block_type = 'toxic_auto_banned'),
f AS (SELECT *, row_number() OVER (PARTITION BY video_id, author_key ORDER BY id) AS first, count(*) OVER (PARTITION BY video_id, author_key) AS n FROM g)
SELECT video_id, author_key, author, n AS comment_count, ban AS banned_user_id, ban IS NOT NULL AS is_banned_active, yt AS youtube_banned, row_number() OVER (PARTITION BY video_id ORDER BY n DESC, author_key) AS place FROM f WHERE first = 1""")
def api_06_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors of the auto-ban block by number of comments, with the newest active ban of their first comment."""
    active = table(spark, sf_dir, "banned_users").filter(F.col("comment_id").isNotNull() & F.col("unbanned_at").isNull())
    ban = active.groupBy("comment_id").agg(F.max_by(F.struct("id", "youtube_banned"), F.struct("banned_at", "id")).alias("ban"))
    i = _items(spark, sf_dir).filter("block_type = 'toxic_auto_banned'").join(ban, "comment_id", "left")
    key = F.coalesce("channel", F.concat(F.lit("name:"), "author")).alias("author_key")
    g = i.groupBy("video_id", key).agg(F.min_by(F.struct("author", "ban"), "id").alias("f"), F.count(F.lit(1)).alias("comment_count"))
    place = F.row_number().over(W.partitionBy("video_id").orderBy(F.desc("comment_count"), "author_key"))
    return g.select("video_id", "author_key", "f.author", "comment_count", F.col("f.ban.id").alias("banned_user_id"), F.col("f.ban").isNotNull().alias("is_banned_active"), F.coalesce("f.ban.youtube_banned", F.lit(False)).alias("youtube_banned"), place.cast("bigint").alias("place"))


@query("cls_01_model_categories", f"""WITH {APPEAL}, {told_sql(UNIFIED, "(SELECT comment_id AS id FROM raw_comments)")}, z AS (SELECT id, {_CAT} AS v, trim(regexp_replace({_CAT}, ':[^:]*$', '')) AS told FROM x WHERE e IS NOT NULL), o AS (SELECT id, CASE WHEN told IN ({", ".join(map(_q, N.CATEGORIES))}) THEN told END AS told FROM z),
c AS (SELECT comment_id, {CATEGORY} AS rule FROM a) SELECT comment_id, CASE WHEN told IS NULL OR told = 'skip' THEN rule ELSE told END AS category FROM c LEFT JOIN o ON o.id = comment_id""")
def cls_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories by a pluggable model in batches of 30. What it skips is tested again by the rule, and
    what it leaves out or fails on is left to the rule. The model here replays made-up answers."""
    rules = categories(spark, sf_dir).select("comment_id", F.expr(re.sub(r"\bid\b", "comment_id", UNIFIED)).alias("prompt"), F.col("category").alias("rule"))

    def factory() -> M.Answerer:
        return lambda prompts: list(prompts)

    answers = M.answered(rules, "comment_id", "prompt", factory, batch=30)
    told = F.get(N.unified(F.col("answer"), BATCH), F.lit(0))["category"]
    out = M.with_fallback(rules, answers, "comment_id", F.nullif(told, F.lit("skip")), F.col("rule"), "category")
    return out.select("comment_id", "category")
