"""Steps of a run around its models: titles and labels by rule, splits, quotas, language, the benchmark of models, ticks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions import detect as D
from skein.functions import parsing as P
from skein.functions import text as T
from skein.operators import appeal as A
from skein.operators import benchmark as X
from skein.operators import fit
from skein.operators import models as M2
from skein.operators import providers as M
from skein.operators import topic_runs as R
from skein.operators import topics as K
from skein.plans.analytics import AUTHOR, FIRST, LIKED, _q, keyword_sql, title_sql
from skein.plans.filters import _FULL, like_sql, preprocessed, squeeze_sql, words_sql
from skein.plans.registry import query
from skein.plans.topic_runs import TOPICS, _points, members, quoted, topics
from skein.settings import DEFAULT as S
from skein.sources import spread, table


@query("flt_24_benchmark_comments", f"SELECT comment_id FROM ({_FULL}) WHERE NOT is_filtered AND (moderation_action IS NULL OR moderation_action <> 'drop')")
def flt_24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments that a benchmark reads: neither filtered nor dropped by moderation."""
    action = F.col("moderation_action")
    return preprocessed(spark, sf_dir).filter(~F.col("is_filtered") & (action.isNull() | (action != "drop"))).select("comment_id")


_NESTED = f"x AS (SELECT id, video_id, {squeeze_sql('text')} AS s, lower({squeeze_sql('text')}) AS low FROM toxic_training_data WHERE confidence_score >= 0.3 AND text IS NOT NULL), r AS (SELECT * FROM x WHERE contains(low, '{AUTHOR.lower()}') OR {like_sql('low', A.AUTHOR_WORDS)})"


@query("flt_22_nested_disagreement", f"WITH {_NESTED}, f AS (SELECT video_id, low, min(id) AS id FROM r GROUP BY ALL) SELECT video_id, id FROM f WHERE low <> '' AND NOT {like_sql('low', A.OFFENSIVE_DISAGREEMENT)}")
def flt_22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments inside positions that disagree with the author: exploded twice, tested for a reference to the author,
    made unique without case, and only then tested for offence. Confident rows stand for the model's flag."""
    t = table(spark, sf_dir, "toxic_training_data").filter(F.col("text").isNotNull())
    c = F.struct("id", T.squeezed(F.col("text")).alias("text"), F.coalesce(F.col("confidence_score") >= 0.3, F.lit(False)).alias("is_author_disagreement"))
    nested = t.groupBy("video_id", F.coalesce("insult_target", F.lit("undetermined")).alias("position")).agg(F.collect_list(c).alias("comments")).groupBy("video_id").agg(F.collect_list(F.struct("position", "comments")).alias("positions"))
    flat = nested.select("video_id", F.explode("positions").alias("p")).select("video_id", F.explode("p.comments").alias("c")).filter("c.is_author_disagreement")
    own = flat.filter(A.refers_to_author(F.col("c.text"), AUTHOR))
    once = own.groupBy("video_id", F.lower("c.text").alias("low")).agg(F.min("c.id").alias("id"))
    return once.filter((F.col("low") != "") & ~F.col("low").rlike(A.OFFENSIVE_DISAGREEMENT)).select("video_id", "id")


_VERDICT = """CASE comment_id % 6 WHEN 0 THEN '{"action": "drop", "reason_code": "Insult ", "score": 1.7}' WHEN 1 THEN '{"action": " KEEP", "score": "0.2"}' WHEN 2 THEN '```json' || chr(10) || '{"action": "flag", "reason_code": "heat", "score": -1}' || chr(10) || '```' WHEN 3 THEN '{"action": "maybe", "reason_code": "odd", "score": "high"}' WHEN 4 THEN 'no idea' ELSE '{"action": "keep", "reason_code": "fine"}' END"""
_VERDICT_SQL = """CASE comment_id % 6 WHEN 0 THEN {'action': 'drop', 'reason': 'insult', 'score': 1.0::DOUBLE} WHEN 1 THEN {'action': 'keep', 'reason': 'llm_invalid_fallback', 'score': 0.2::DOUBLE} WHEN 2 THEN {'action': 'flag', 'reason': 'heat', 'score': 0.0::DOUBLE} WHEN 3 THEN {'action': 'flag', 'reason': 'odd', 'score': 0.5::DOUBLE} WHEN 4 THEN {'action': 'flag', 'reason': 'llm_invalid_fallback', 'score': 0.5::DOUBLE} ELSE {'action': 'keep', 'reason': 'fine', 'score': 0.5::DOUBLE} END"""


@query("flt_17_parsed_decisions", f"SELECT comment_id, d.action, d.reason, d.score FROM (SELECT comment_id, {_VERDICT_SQL} AS d FROM raw_comments)")
def flt_17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of a model, parsed: odd actions are flags, scores stay within 0 and 1."""
    d = M2.moderation_decision(F.expr(_VERDICT))
    return table(spark, sf_dir, "raw_comments").select("comment_id", d.alias("d")).select("comment_id", "d.action", "d.reason", "d.score")


@query("flt_16_reviewed_decisions", f"""WITH b AS (SELECT video_id, comment_id, row_number() OVER (PARTITION BY video_id ORDER BY comment_id) AS place FROM ({_FULL}) WHERE moderation_reason = 'borderline_for_llm'), e AS (SELECT video_id, min(place) AS stop FROM b WHERE place <= {S.max_reviews} AND comment_id % 101 = 0 GROUP BY 1), d AS (SELECT b.*, {_VERDICT_SQL} AS d FROM b)
SELECT comment_id, CASE WHEN place > {S.max_reviews} OR place >= stop OR comment_id % 19 = 0 THEN 'flag' ELSE d.action END AS action, CASE WHEN place > {S.max_reviews} THEN 'llm_review_cap_fallback' WHEN place >= stop THEN 'llm_task_quota_fallback' WHEN comment_id % 19 = 0 THEN 'llm_error_fallback' ELSE d.reason END AS reason FROM d LEFT JOIN e USING (video_id)""")
def flt_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Borderline comments of each video after a model's review, whose calls fail now and then, and for some videos end with the quota."""

    def factory() -> M.Answerer:
        def ask(prompts: list[str]) -> list[str | None]:
            n, answer = prompts[0].split("|", 1)
            if int(n) % 101 == 0:
                raise RuntimeError("Task quota reached")
            if int(n) % 19 == 0:
                raise ConnectionError("no route")
            return [answer]

        return ask

    b = preprocessed(spark, sf_dir).filter("moderation_reason = 'borderline_for_llm'").select("video_id", "comment_id")
    prompts = b.withColumn("prompt", F.concat_ws("|", F.col("comment_id").cast("string"), F.expr(_VERDICT)))
    return M2.reviewed(prompts, "video_id", "comment_id", "prompt", factory, S.max_reviews).select("comment_id", "action", "reason")


@query("agg_26_emotions", f"""WITH {TOPICS}, e AS (SELECT run, lower(trim(unnest(CASE sentiment WHEN 'negative' THEN ['тревога', 'раздражение'] WHEN 'positive' THEN ['поддержка', ' Тревога'] ELSE []::VARCHAR[] END))) AS tag FROM topics) SELECT run, tag, count(*) AS n FROM e GROUP BY ALL""")
def agg_26(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emotion tags of the topics of each run with their counts."""
    mood = F.col("sentiment")
    tags = F.when(mood == "negative", F.array(F.lit("тревога"), F.lit("раздражение"))).when(mood == "positive", F.array(F.lit("поддержка"), F.lit(" Тревога")))
    return topics(spark, sf_dir).select("run", F.explode(tags).alias("tag")).groupBy("run", F.lower(F.trim("tag")).alias("tag")).agg(F.count(F.lit(1)).alias("n"))


# --- labels by rule ----------------------------------------------------------------------------------

_WORDS = keyword_sql("0.0::DOUBLE", (*K.STOPWORDS, *K.LOW_VALUE), most=4, first=FIRST)
_NO_TITLE = "Позиция аудитории по теме"


def _first(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    c = table(spark, sf_dir, "raw_comments").filter(F.col("text_raw").isNotNull()).select("video_id", "comment_id", "text_raw")
    return c.withColumn("place", F.row_number().over(W.partitionBy("video_id").orderBy("comment_id"))).filter(F.col("place") <= n)


@query("str_23_keyword_titles", f"""WITH {_WORDS}, k AS (SELECT video_id, list(token ORDER BY place) AS ks FROM r GROUP BY 1), v AS (SELECT DISTINCT video_id FROM raw_comments), c AS (SELECT video_id, string_agg(lower(text_raw), ' ' ORDER BY comment_id) AS support FROM (SELECT * FROM raw_comments WHERE text_raw IS NOT NULL QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY comment_id) <= 80) GROUP BY 1),
j AS (SELECT v.video_id, support, CASE WHEN len(ks) >= 3 THEN ks[1] || ' ' || ks[2] || ' ' || ks[3] WHEN len(ks) = 2 THEN ks[1] || ' и ' || ks[2] WHEN len(ks) = 1 THEN ks[1] || ' и позиция аудитории' ELSE '{_NO_TITLE}' END AS t FROM v LEFT JOIN k USING (video_id) LEFT JOIN c USING (video_id))
SELECT video_id, CASE WHEN {title_sql('t', 'support')} THEN t ELSE '{_NO_TITLE}' END AS title FROM j""")
def str_23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles from the words of the first comments, where they make a valid title."""
    c = spread(table(spark, sf_dir, "raw_comments"))
    words = K.keywords(c, ["video_id"], "text_raw", most=4, first=FIRST, order=["comment_id"]).groupBy("video_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "token"))), lambda x: x["token"]).alias("ks"))
    support = _first(spark, sf_dir, 80).groupBy("video_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text_raw"))), lambda x: F.lower(x["text_raw"])), " ").alias("support"))
    j = c.select("video_id").distinct().join(words, "video_id", "left").join(support, "video_id", "left")
    k = lambda i: F.get("ks", F.lit(i))
    n = F.coalesce(F.size("ks"), F.lit(0))
    t = F.when(n >= 3, F.concat_ws(" ", k(0), k(1), k(2))).when(n == 2, F.concat_ws(" и ", k(0), k(1))).when(n == 1, F.concat(k(0), F.lit(" и позиция аудитории"))).otherwise(_NO_TITLE)
    j = j.withColumn("t", t)
    return j.select("video_id", F.when(K.valid_title(F.col("t"), F.col("support")), F.col("t")).otherwise(_NO_TITLE).alias("title"))


_VOTE = "len(list_filter(regexp_extract_all(lower(text_raw), '[\\p{{L}}\\p{{N}}_]{{3,}}'), lambda x: x IN ({})))"
_MOOD = f"q AS (SELECT video_id, sum({_VOTE.format(', '.join(map(_q, K.POSITIVE)))})::BIGINT AS positive, sum({_VOTE.format(', '.join(map(_q, K.NEGATIVE)))})::BIGINT AS negative FROM raw_comments GROUP BY 1), y AS (SELECT video_id, CASE WHEN negative > positive + 1 THEN 'negative' WHEN positive > negative + 1 THEN 'positive' ELSE 'neutral' END AS sentiment FROM q)"
# Sentences of grounded descriptions.
LEAD, NO_LEAD = "В комментариях по теме чаще обсуждают: ", "В комментариях по теме обсуждают детали события и его последствия."
TONES = {"negative": "Преобладают критические оценки и спорные трактовки.", "positive": "Преобладают поддержка и одобрительные оценки.", "neutral": "Тон обсуждения смешанный: мнения разделены."}
ASKED = " Отдельно заметен блок вопросов аудитории по этой теме."


@query("str_21_grounded_description", f"""WITH {keyword_sql("0.0::DOUBLE", (*K.STOPWORDS, *K.LOW_VALUE), first=FIRST)}, {_MOOD}, k AS (SELECT video_id, string_agg(token, ', ' ORDER BY place) AS ks FROM r GROUP BY 1), a AS (SELECT video_id, count(*) FILTER (regexp_matches(text_raw, '[?¿？]')) AS asked FROM (SELECT * FROM raw_comments WHERE text_raw IS NOT NULL QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY comment_id) <= 16) GROUP BY 1)
SELECT video_id, CASE WHEN ks IS NULL THEN '{NO_LEAD}' ELSE '{LEAD}' || ks || '.' END || ' ' || CASE sentiment WHEN 'negative' THEN '{TONES["negative"]}' WHEN 'positive' THEN '{TONES["positive"]}' ELSE '{TONES["neutral"]}' END || CASE WHEN coalesce(asked, 0) > 0 THEN '{ASKED}' ELSE '' END AS description FROM y LEFT JOIN k USING (video_id) LEFT JOIN a USING (video_id)""")
def str_21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Description from keywords, mood and questions of a cluster's comments; here of a video's."""
    c = spread(table(spark, sf_dir, "raw_comments"))
    words = K.keywords(c, ["video_id"], "text_raw", first=FIRST, order=["comment_id"]).groupBy("video_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "token"))), lambda x: x["token"]), ", ").alias("ks"))
    asked = _first(spark, sf_dir, 16).groupBy("video_id").agg(F.count_if(F.col("text_raw").rlike("[?¿？]")).alias("asked"))
    j = K.sentiments(c, ["video_id"], "text_raw").join(words, "video_id", "left").join(asked, "video_id", "left")
    lead = F.when(F.col("ks").isNull(), NO_LEAD).otherwise(F.concat(F.lit(LEAD), "ks", F.lit(".")))
    tone = F.when(F.col("sentiment") == "negative", TONES["negative"]).when(F.col("sentiment") == "positive", TONES["positive"]).otherwise(TONES["neutral"])
    return j.select("video_id", F.concat(lead, F.lit(" "), tone, F.when(F.coalesce("asked", F.lit(0)) > 0, ASKED).otherwise("")).alias("description"))


_NEW = "Новая тема комментариев"
# Sentences of labels by rule.
MARKERS, NO_MARKERS = "Ключевые маркеры обсуждения: ", "В комментариях нет устойчивых смысловых маркеров."
UNMATCHED = "Тема сформировалась из комментариев и не совпала напрямую с темами транскрипта."
BEFORE = f"Перед следующим выпуском {AUTHOR} важно закрыть тему коротко и с проверяемыми формулировками."
FACTCHECK = f"{AUTHOR}: заранее выпишите спорный тезис и один фактчек-источник, который озвучите в начале."
MINI_FAQ = f"{AUTHOR}: добавьте мини-FAQ из 3 вопросов аудитории и коротких ответов в конце выпуска."
CLOSING = f"{AUTHOR}: в финале сформулируйте 2 конкретных вывода и один следующий шаг для аудитории."
_INTENT_OF = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text_raw), {_q(x)})" for x in signs) + f" THEN '{name}'" for name, signs in K.INTENTS) + " ELSE 'other' END"


@query("lbl_02_rule_labels", f"""WITH {keyword_sql(LIKED, (*K.LABEL_STOPWORDS, *K.LABEL_LOW_VALUE))}, {_MOOD}, k AS (SELECT video_id, string_agg(token, ' и ' ORDER BY place) FILTER (place <= 2) AS label, string_agg(token, ', ' ORDER BY place) AS ks FROM r GROUP BY 1), i AS (SELECT video_id, count(*) FILTER ({_INTENT_OF} IN ('request', 'question')) AS asked, count(*) FILTER ({_INTENT_OF} = 'complaint') AS complaints FROM raw_comments GROUP BY 1),
l AS (SELECT video_id, list_filter([CASE WHEN complaints >= 2 THEN '{FACTCHECK}' END, CASE WHEN asked >= 2 THEN '{MINI_FAQ}' END, '{CLOSING}'], lambda a: a IS NOT NULL AND len(string_split(a, ' ')) >= 4 AND NOT {like_sql('lower(a)', R.UNREALISTIC)} AND {like_sql('lower(a)', R.PRACTICAL)}) AS acts FROM i)
SELECT video_id, coalesce(label, '{_NEW}') AS label, sentiment, CASE WHEN ks IS NULL THEN '{NO_MARKERS}' ELSE '{MARKERS}' || ks || '.' END || ' {UNMATCHED} {BEFORE}' AS description, array_to_string(acts, '|') AS actions, asked, complaints FROM y LEFT JOIN k USING (video_id) JOIN i USING (video_id) JOIN l USING (video_id)""")
def lbl_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label, mood, description and actions of each cluster without a model; here of each video's comments."""
    c = spread(table(spark, sf_dir, "raw_comments")).withColumn("weight", 1 + F.coalesce("like_count", F.lit(0)).cast("double"))
    words = K.keywords(c, ["video_id"], "text_raw", "weight").groupBy("video_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "token"))), lambda x: x["token"]).alias("ks"))
    intent = K.intent(F.coalesce("text_raw", F.lit("")))
    counts = c.groupBy("video_id").agg(F.count_if(intent.isin("request", "question")).alias("asked"), F.count_if(intent == "complaint").alias("complaints"))
    j = K.sentiments(c, ["video_id"], "text_raw").join(words, "video_id", "left").join(counts, "video_id")
    acts = F.array_compact(F.array(F.when(F.col("complaints") >= 2, FACTCHECK), F.when(F.col("asked") >= 2, MINI_FAQ), F.lit(CLOSING)))
    markers = F.when(F.col("ks").isNull(), NO_MARKERS).otherwise(F.concat(F.lit(MARKERS), F.array_join("ks", ", "), F.lit(".")))
    return j.select("video_id", F.coalesce(F.array_join(F.slice("ks", 1, 2), " и "), F.lit(_NEW)).alias("label"), "sentiment", F.concat_ws(" ", markers, F.lit(UNMATCHED), F.lit(BEFORE)).alias("description"), F.array_join(F.filter(acts, R.practical), "|").alias("actions"), "asked", "complaints")


# --- labels by models --------------------------------------------------------------------------------


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quoted(spark, sf_dir).withColumns({"id": F.concat_ws("/", F.col("run").cast("string"), "key"), "prompt": F.concat_ws("\n", "title", F.array_join(F.slice("quotes", 1, 3), "\n"))})


@query("lbl_01_model_labels")
def lbl_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of all topics by a pluggable model within its quota of calls; failed calls and topics beyond the quota get the rule's label and an error."""

    def factory() -> M.Answerer:
        def ask(prompts: list[str]) -> list[str | None]:
            if len(prompts[0]) % 7 == 0:
                raise ConnectionError("try later")
            return [None if len(p) % 5 == 0 else '{"label": "' + " ".join(p.split()[:4]).replace('"', "") + '"}' for p in prompts]

        return ask

    p = _prompts(spark, sf_dir)
    first, rest = M.within_quota(p, "id", [F.desc("weighted_share"), F.col("id")], 30)
    told = M.answered(first, "id", "prompt", factory, batch=1).unionByName(rest.select("id", F.lit(None).cast("string").alias("answer"), F.lit("quota").alias("error")))
    label = R.sanitized_label(F.get_json_object(P.lenient_object("answer"), "$.label"), F.col("title"), F.lit(None).cast("string"))
    return p.join(told, "id").select("run", "key", F.when(F.col("answer").isNull(), F.col("title")).otherwise(label).alias("label"), F.col("answer").isNull().alias("is_fallback"), "error")


@query("lbl_03_normalized_labels")
def lbl_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chat model's whole answer, field by field, against the rule's result: what is missing or odd is the rule's."""

    def factory() -> M.Answerer:
        def one(i: int, p: str) -> str:
            return ['{"result": {"label": ["%s"], "sentiment": "negative", "emotion_tags": ["Гнев", "гнев", "страх", "x"], "intent_distribution": {"complaint": 3, "odd": 9, "praise": -1}, "description": "Коротко.", "author_actions": ["лайк"]}}', '{"label": {"title": "%s"}, "sentiment": "furious", "intent_distribution": {}}', "```json\n{}\n```", "no"][i % 4].replace("%s", p.split("\n")[0].replace('"', ""))

        return lambda prompts: [one(len(p), p) for p in prompts]

    p = _prompts(spark, sf_dir)
    told = p.join(M.answered(p, "id", "prompt", factory, batch=10), "id")
    body = P.unwrapped(P.lenient_object("answer"))
    return M2.normalized_label(told.withColumn("body", body)).select("run", "key", "label", "sentiment", "emotions", "intents", "description", "actions")


@query("lbl_10_second_titles")
def lbl_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second names for weak topics only, asked twice where the first answer is no valid title; else the old name stays."""

    def factory() -> M.Answerer:
        return lambda prompts: ['{"title": "Спор о выпуске и тоне эфира"}' if p.startswith("Повтор") else '{"title": "тема"}' for p in prompts]

    p = _prompts(spark, sf_dir)
    weak = p.filter(R.weak_topic(F.when(F.col("label") % 3 == 0, F.lit("Обсуждение")).otherwise(F.col("title")), F.col("description"), F.col("size") % 5))
    return M2.retitled(p, weak, "id", "prompt", factory).select("run", "key", "title", "renamed")


@query("lbl_05_model_positions")
def lbl_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of each topic by a model over a numbered sample: groups cover each comment once, others stay out;
    topics where fewer than two groups come back keep the groups of the vectors."""

    def factory() -> M.Answerer:
        def one(p: str) -> str | None:
            n = p.count("\n") + 1
            if n % 4 == 0:
                return None
            return '{"positions": [{"title": "Первая позиция зрителей выпуска", "members": [%s, 999]}, {"title": "x", "members": [%s]}]}' % (", ".join(map(str, range(1, n // 2 + 1))), ", ".join(map(str, range(n // 2, n + 1))))  # noqa: UP031

        return lambda prompts: [one(p) for p in prompts]

    return M2.model_positions(members(spark, sf_dir).join(_points(spark, sf_dir).select("id", "v"), "id"), ["run", "label"], factory)


@query("lbl_06_position_titles")
def lbl_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of positions by a model; one that is no valid single claim is asked again, then taken from the words of the comments."""
    p = lbl_05(spark, sf_dir).filter("position <> 'undetermined'")
    texts = members(spark, sf_dir).select("id", "text", "weight")
    rows = p.join(texts, "id")
    words = K.keywords(rows, ["run", "label", "position"], "text", most=3).groupBy("run", "label", "position").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "token"))), lambda x: x["token"]), " ").alias("words"))
    heads = rows.groupBy("run", "label", "position").agg(F.max_by("text", F.struct("weight", -F.col("id"))).alias("prompt"), F.count(F.lit(1)).alias("n")).join(words, ["run", "label", "position"], "left")
    heads = heads.withColumns({"id": F.concat_ws("/", *[F.col(c).cast("string") for c in ("run", "label", "position")]), "title": F.coalesce("words", F.lit("Позиция аудитории"))})

    def factory() -> M.Answerer:
        return lambda prompts: ['{"title": "Зрители просят подробный разбор"}' if p.startswith("Повтор") else '{"title": "да; нет; и то, и другое"}' for p in prompts]

    return M2.retitled(heads, heads.filter("n >= 3"), "id", "prompt", factory).select("run", "label", "position", "title", "renamed")


@query("lbl_07_postprocessed_topics")
def lbl_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics after harmonizing with the episode's titles and collapsing the uncertain ones; each key stays at most once."""
    from skein.plans.topic_runs import join_19

    t = quoted(spark, sf_dir).drop("label", "source").join(join_19(spark, sf_dir), ["run", "key"])
    t = t.withColumns({"tokens": R.label_tokens(F.col("label")), "n_comments": F.size("quotes") + F.size("questions"), "support": F.lit(0.2), "low": R.low_coherence(F.col("weighted_share"), F.col("size"), F.col("coherence"))})
    return R.collapsed_uncertain(t.select("run", "key", "label", "tokens", "n_comments", "support", "source", "weighted_share", "low"), "run")


# --- large clusters ----------------------------------------------------------------------------------


def _per_run(spark: SparkSession, sf_dir: str, run, schema: str) -> DataFrame:
    """One task a run; the rows of a run beyond the fit's limit are left to the fit of all clusters (``fit_clusters``)."""
    first, _ = fit.sample_and_rest(_points(spark, sf_dir).select("run", "id", "v"), "run", "id", fit.MOST)
    return first.groupBy("run").applyInPandas(run, schema)


def _large(part: pd.DataFrame) -> tuple[np.ndarray, fit.Assigned, np.ndarray]:
    unit, s = fit.unit_rows(np.stack(part["v"].to_numpy())), fit.FitSettings()
    a = fit.assigned(unit, s)
    return unit, a, np.array([f"cluster_{k}" if k >= 0 else "emerging_other" for k in a.labels], object)


@query("vec_10_split_large_clusters")
def vec_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of each row before and after large clusters are split."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        unit, a, keys = _large(part)
        before = keys.copy()
        fit.split_large(unit, keys, a, fit.FitSettings())
        return part[["run", "id"]].assign(before=before, after=keys)

    return _per_run(spark, sf_dir, run, "run bigint, id bigint, before string, after string")


@query("vec_11_large_split_gate")
def vec_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each cluster of a run: whether it is large, its parts, and whether the gate lets them pass."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        unit, a, keys = _large(part)
        rows = []
        for k in sorted(set(keys.tolist())):
            at = np.flatnonzero(keys == k)
            parts = fit.large_parts(unit, at, len(keys), fit.FitSettings()) if k != "emerging_other" else []
            rows.append((int(part["run"].iloc[0]), k, len(at), fit.coherence(unit[at]), len(parts), bool(parts) and fit.passes_large_gate(unit, at, parts, a, fit.FitSettings())))
        return pd.DataFrame(rows, columns=["run", "cluster", "size", "coherence", "parts", "passes"])

    return _per_run(spark, sf_dir, run, "run bigint, cluster string, size int, coherence double, parts int, passes boolean")


@query("vec_21_embedded_batches")
def vec_21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of all comments from a provider that is given halves of a batch where the whole does not fit in its memory."""

    def factory() -> M.Embedder:
        whole = M.hashing_embedder()

        def tight(texts: list[str]) -> np.ndarray:
            if len(texts) > 20:
                raise MemoryError
            return whole(texts)

        return M.halving(tight, 32)

    return M.embedded(spread(table(spark, sf_dir, "raw_comments")), "comment_id", "text_raw", factory, "clustering: ")


@query("vec_22_budgeted_vectors")
def vec_22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of unit length from a paid provider, for the comments of each video that the budget of a run covers."""
    c = table(spark, sf_dir, "raw_comments").filter(F.col("text_raw").isNotNull()).select("video_id", "comment_id", "text_raw").withColumn("cost", F.ceil(F.length("text_raw") / 4.0) * 0.00001)
    paid = M.running_cost(c, ["video_id"], ["comment_id"], "cost", 0.002)
    raw = M.embedded(spread(paid), "comment_id", "text_raw", M.hashing_embedder)
    return raw.select("comment_id", M.unit_vector(F.col("embedding")).alias("embedding"))


# --- benchmark of models -------------------------------------------------------------------------------

_RESULTS = f"""{TOPICS}, h AS (SELECT 'model_' || (o.id % 3) AS model, r.video_id % 7 AS video_id, o.label, round(least(1, greatest(o.cos, 0)), 6) AS confidence, round(o.cos, 6) < 0.5 AS amb FROM o JOIN raw_comments r ON r.comment_id = o.id), a AS (SELECT model, video_id, label, count(*) AS n, avg(confidence) AS confidence, count(*) FILTER (amb) AS amb, max(label >= 8) AS emerging FROM h GROUP BY ALL),
res AS (SELECT model, video_id, sum(n) AS comment_count, count(*) AS cluster_count, count(*) FILTER (emerging) AS emerging_cluster_count, round(avg(confidence), 4) AS cluster_confidence, round(100.0::DOUBLE * sum(amb) / sum(n), 2) AS ambiguous_share_pct, round(avg(n), 2) AS cluster_size, round(100.0::DOUBLE * max(n) / sum(n), 2) AS max_cluster_share_pct FROM a GROUP BY ALL),
su AS (SELECT model, count(*) AS videos_evaluated, {", ".join(f"round(avg({m}), {4 if m == 'cluster_confidence' else 2}) AS avg_{m}" for m in X.MEASURES)} FROM res GROUP BY model),
sc AS (SELECT *, round(round(avg_cluster_confidence * 45.0::DOUBLE + greatest(0.0, 100.0::DOUBLE - avg_ambiguous_share_pct) * 0.35::DOUBLE + greatest(0.0, 100.0::DOUBLE - avg_max_cluster_share_pct) * 0.10::DOUBLE + least(avg_cluster_count, 12.0) * 0.8::DOUBLE - avg_emerging_cluster_count * 1.5::DOUBLE, 9), 3) AS composite_score FROM su)"""


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.operators import clusters as C

    o = C.with_centroid(_points(spark, sf_dir), ["run", "label"]).withColumn("cos", F.round("cos", 6))
    r = table(spark, sf_dir, "raw_comments").select(F.col("comment_id").alias("id"), (F.col("video_id") % 7).alias("video_id"))
    m = o.join(r, "id").select(F.concat(F.lit("model_"), (F.col("id") % 3).cast("string")).alias("model"), "video_id", F.col("label").alias("cluster"), F.least(F.lit(1.0), F.greatest("cos", F.lit(0.0))).alias("confidence"), (F.col("cos") < 0.5).alias("is_ambiguous"), (F.col("label") >= 8).alias("is_emerging"))
    return X.summaries(X.video_results(m))


@query("mth_12_composite_score", f"WITH {_RESULTS} SELECT model, videos_evaluated, avg_cluster_confidence, avg_ambiguous_share_pct, avg_cluster_count, composite_score FROM sc")
def mth_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite score of three models over the clusterings of their videos."""
    return _summaries(spark, sf_dir).select("model", "videos_evaluated", "avg_cluster_confidence", "avg_ambiguous_share_pct", "avg_cluster_count", "composite_score")


@query("srt_14_models_by_score", f"WITH {_RESULTS} SELECT model, composite_score, row_number() OVER (ORDER BY composite_score DESC, model) AS place FROM sc")
def srt_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models, a handful, by falling score."""
    s = _summaries(spark, sf_dir).select("model", "composite_score")
    return s.withColumn("place", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("composite_score"), "model")).cast("bigint"))


@query("snk_22_benchmark_markdown", f"WITH {_RESULTS} SELECT model, '## ' || model || chr(10) || '- Videos evaluated: ' || videos_evaluated || chr(10) || '- Composite score: ' || printf('%.3f', composite_score) || chr(10) || '- Avg cluster confidence: ' || printf('%.3f', round(avg_cluster_confidence, 3)) || chr(10) || '- Avg ambiguous share: ' || printf('%.2f', avg_ambiguous_share_pct) || '%' || chr(10) || '- Avg cluster count: ' || printf('%.2f', avg_cluster_count) || chr(10) || '- Avg max cluster share: ' || printf('%.2f', avg_max_cluster_share_pct) || '%' || chr(10) AS text FROM sc")
def snk_22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.markdown(_summaries(spark, sf_dir))


# --- quotas, costs, language, ticks ----------------------------------------------------------------------


@query("udf_04_within_quota", "SELECT id, row_number() OVER (ORDER BY confidence_score DESC NULLS LAST, id) <= 50 AS is_asked FROM toxic_training_data")
def udf_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rows a model may see: the first of a global order, chosen before any call."""
    first, rest = M.within_quota(table(spark, sf_dir, "toxic_training_data").select("id", "confidence_score"), "id", [F.desc_nulls_last("confidence_score"), F.col("id")], 50)
    return first.select("id", F.lit(True).alias("is_asked")).unionByName(rest.select("id", F.lit(False).alias("is_asked")))


@query("udf_05_within_budget", "SELECT comment_id FROM (SELECT comment_id, sum(ceil(length(coalesce(text_raw, '')) / 4.0)) OVER (PARTITION BY video_id ORDER BY comment_id ROWS UNBOUNDED PRECEDING) AS spent FROM raw_comments) WHERE spent <= 1000")
def udf_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of each run, in order, while their estimated tokens stay within its budget."""
    c = table(spark, sf_dir, "raw_comments").select("video_id", "comment_id", F.ceil(F.length(F.coalesce("text_raw", F.lit(""))) / 4.0).alias("tokens"))
    return M.running_cost(c, ["video_id"], ["comment_id"], "tokens", 1000).select("comment_id")


@query("udf_02_model_answers", "SELECT id, text IS NOT NULL AND length(text) % 11 <> 0 AS has_answer FROM toxic_training_data")
def udf_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a pluggable model asked row by row; a failure is an error in its row."""

    def factory() -> M.Answerer:
        def ask(texts: list[str]) -> list[str | None]:
            if texts[0] is None or len(texts[0]) % 11 == 0:
                raise ValueError("cannot read this")
            return ["{}" for _ in texts]

        return ask

    a = M.answered(table(spark, sf_dir, "toxic_training_data"), "id", "text", factory, batch=1)
    return a.select("id", (F.col("answer").isNotNull() & F.col("error").isNull()).alias("has_answer"))


_SCORES = [f"len(list_intersect(list_distinct({words_sql('low')}), [{', '.join(map(_q, D.WORDS[lang]))}]))" + (f" + CASE WHEN regexp_matches(low, '[{D.LETTERS[lang]}]') THEN 1 ELSE 0 END" if D.LETTERS[lang] else "") for lang in D.WORDS]


@query("str_17_detected_language", f"SELECT comment_id, CASE WHEN greatest({', '.join(f's{i}' for i in range(5))}) > 0 THEN CASE greatest({', '.join(f's{i}' for i in range(5))}) {' '.join(f'WHEN s{i} THEN {_q(lang)}' for i, lang in enumerate(D.WORDS))} END END AS lang FROM (SELECT comment_id, {', '.join(f'{x} AS s{i}' for i, x in enumerate(_SCORES))} FROM (SELECT comment_id, lower(text_raw) AS low FROM raw_comments))")
def str_17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each comment, null where nothing tells it."""
    return spread(table(spark, sf_dir, "raw_comments")).select("comment_id", D.detected(F.col("text_raw")).alias("lang"))


@query("stm_01_daily_tick", "SELECT strftime(clock, '%Y-%m-%d') AS day, min(ts) AS fired_at FROM (SELECT ts, ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Kyiv' AS clock FROM events) WHERE strftime(clock, '%H:%M') >= '09:00' AND strftime(clock, '%H:%M') < '10:00' GROUP BY 1")
def stm_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks at which a daily job fires: the first one of each local day in the hour that it is set to, once a day."""
    clock = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Europe/Kyiv")
    e = table(spark, sf_dir, "events").select("ts", F.date_format(clock, "yyyy-MM-dd").alias("day"), F.date_format(clock, "HH:mm").alias("at"))
    return e.filter((F.col("at") >= "09:00") & (F.col("at") < "10:00")).groupBy("day").agg(F.min("ts").alias("fired_at"))


@query("src_11_prior_topics", f"WITH {TOPICS}, n AS (SELECT a.run, max(b.run) AS prior FROM (SELECT DISTINCT run FROM topics) a JOIN (SELECT DISTINCT run FROM topics) b ON b.run <> a.run GROUP BY 1) SELECT n.run, prior, t.key, t.title AS label, round(t.weighted_share, 4) AS weighted_share FROM n JOIN topics t ON t.run = n.prior")
def src_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of the newest report of another video, parsed from its JSON; entries that do not parse are left out."""
    t = topics(spark, sf_dir).select("run", F.to_json(F.struct("key", F.col("title").alias("label"), "weighted_share")).alias("j"))
    reports = t.groupBy("run").agg(F.array_append(F.collect_list("j"), F.lit('{"key": 5, "label": ')).alias("top_topics"))  # the last one is broken
    # the newest report, or for the newest one itself the second: two rows travel to all
    two = reports.orderBy(F.desc("run")).limit(2).groupBy(F.lit(1).alias("one")).agg(F.sort_array(F.collect_list(F.struct("run", "top_topics")), asc=False).alias("two"))
    pairs = reports.select("run", F.lit(1).alias("one")).join(two, "one")
    p = F.when(F.col("two")[0]["run"] != F.col("run"), F.get("two", F.lit(0))).otherwise(F.get("two", F.lit(1)))
    prior = pairs.select("run", p.alias("p")).select("run", F.col("p.run").alias("prior"), F.explode("p.top_topics").alias("j"))
    o = F.from_json("j", "key string, label string, weighted_share double, bad string", {"columnNameOfCorruptRecord": "bad"})
    return prior.select("run", "prior", o.alias("o")).filter("o.bad IS NULL").select("run", "prior", "o.key", "o.label", F.round("o.weighted_share", 4).alias("weighted_share"))


# --- smaller parts -------------------------------------------------------------------------------------


@query("snk_19_guest_upsert", """WITH n AS (SELECT video_id, guest_names FROM video_settings UNION ALL SELECT id, CASE WHEN id % 2 = 0 THEN ' Анна ,, Пётр  , ' END FROM videos WHERE id % 5 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY (guest_names IS NOT DISTINCT FROM ' Анна ,, Пётр  , ' OR (video_id % 5 = 0 AND video_id % 2 = 1 AND guest_names IS NULL)) DESC) AS place FROM n)
SELECT video_id, nullif(array_to_string(list_filter(list_transform(string_split(coalesce(CASE WHEN video_id % 5 = 0 AND video_id IN (SELECT id FROM videos) THEN CASE WHEN video_id % 2 = 0 THEN ' Анна ,, Пётр  , ' END ELSE guest_names END, ''), ','), lambda x: trim(x)), lambda x: x <> ''), ', '), '') AS guests FROM r WHERE place = 1""")
def snk_19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guest names of each video after new ones are set: trimmed, without blanks, null where none is left."""
    old = table(spark, sf_dir, "video_settings").select("video_id", "guest_names", F.lit(0).alias("at"))
    new = table(spark, sf_dir, "videos").filter("id % 5 = 0").select(F.col("id").alias("video_id"), F.when(F.col("id") % 2 == 0, " Анна ,, Пётр  , ").alias("guest_names"), F.lit(1).alias("at"))
    last = old.unionByName(new).groupBy("video_id").agg(F.max_by(F.struct("guest_names"), "at").alias("s"))
    return last.select("video_id", F.nullif(F.array_join(A.guest_names(F.col("s.guest_names")), ", "), F.lit("")).alias("guests"))


@query("flt_33_question_partition", """WITH q AS (SELECT id, CASE id % 4 WHEN 0 THEN 'attack_ragebait' WHEN 1 THEN 'clarification_needed' WHEN 2 THEN 'fact_check' END AS kind, (id % 9)::INT AS score, contains(text, '?') AS signal FROM toxic_training_data WHERE text IS NOT NULL) SELECT id, NOT coalesce(kind = 'attack_ragebait' OR (kind = 'clarification_needed' AND score <= 5 AND NOT signal), false) AS is_kept FROM q""")
def flt_33(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that stay after the refiner; those of low value, or mere clarifications without a signal, are demoted."""
    n = F.col("id") % 4
    q = table(spark, sf_dir, "toxic_training_data").filter(F.col("text").isNotNull()).select("id", F.lit("question").alias("category"), F.when(n == 0, "attack_ragebait").when(n == 1, "clarification_needed").when(n == 2, "fact_check").alias("kind"), (F.col("id") % 9).cast("int").alias("score"), F.col("text").contains("?").alias("signal"))
    return A.promoted(q, F.col("category"), F.col("signal"), F.col("kind"), F.col("score")).select("id", (F.col("category") == "question").alias("is_kept"))


@query("sup_03_keyword_sentences", f"""WITH {keyword_sql(LIKED, (*K.LABEL_STOPWORDS, *K.LABEL_LOW_VALUE))}, k AS (SELECT video_id, string_agg(token, ', ' ORDER BY place) AS ks FROM r GROUP BY 1), c AS (SELECT video_id, count(*) AS m FROM raw_comments GROUP BY 1) SELECT video_id, CASE WHEN ks IS NULL THEN '{NO_MARKERS}' ELSE '{MARKERS}' || ks || '.' END AS sentence, greatest(8, least(40, m)) AS quote_limit FROM c LEFT JOIN k USING (video_id)""")
def sup_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence of keywords that goes with a description, and how many quotes a cluster may show."""
    c = spread(table(spark, sf_dir, "raw_comments")).withColumn("weight", 1 + F.coalesce("like_count", F.lit(0)).cast("double"))
    words = K.keywords(c, ["video_id"], "text_raw", "weight").groupBy("video_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "token"))), lambda x: x["token"]), ", ").alias("ks"))
    j = c.groupBy("video_id").agg(F.count(F.lit(1)).alias("m")).join(words, "video_id", "left")
    sentence = F.when(F.col("ks").isNull(), NO_MARKERS).otherwise(F.concat(F.lit(MARKERS), "ks", F.lit(".")))
    return j.select("video_id", sentence.alias("sentence"), F.greatest(F.lit(8), F.least(F.lit(40), F.col("m"))).alias("quote_limit"))


@query("sup_04_disable_events", "WITH e AS (SELECT event_type AS run, event_id, CASE event_id % 3 WHEN 0 THEN 'budget_exceeded' WHEN 1 THEN 'rate_limited' END AS reason FROM events WHERE event_id % 50 < 3) SELECT run, min_by(reason, event_id) AS first_reason, count(*) AS n_events FROM e WHERE reason IS NOT NULL GROUP BY run")
def sup_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why the model was first disabled in each run, and how often."""
    n = F.col("event_id") % 3
    e = table(spark, sf_dir, "events").filter("event_id % 50 < 3").select(F.col("event_type").alias("run"), "event_id", F.when(n == 0, "budget_exceeded").when(n == 1, "rate_limited").alias("reason"))
    return e.filter("reason IS NOT NULL").groupBy("run").agg(F.min_by("reason", "event_id").alias("first_reason"), F.count(F.lit(1)).alias("n_events"))


@query("sup_05_moderation_summary", f"SELECT video_id, count(*) AS total, count(*) FILTER (is_filtered) AS dropped, count(*) FILTER (NOT is_filtered AND moderation_action = 'flag') AS flagged, count(*) FILTER (moderation_reason = 'borderline_for_llm') AS borderline FROM ({_FULL}) GROUP BY video_id")
def sup_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What moderation did to the comments of each video."""
    f = F.col("is_filtered")
    return preprocessed(spark, sf_dir).groupBy("video_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(f).alias("dropped"), F.count_if(~f & (F.col("moderation_action") == "flag")).alias("flagged"), F.count_if(F.col("moderation_reason") == "borderline_for_llm").alias("borderline"))


@query("brf_07_polished_summaries", f"""WITH {TOPICS}, r AS (SELECT DISTINCT run FROM topics) SELECT run, CASE WHEN run % 2 = 0 THEN 'Итог выпуска ' || run ELSE 'rule' END AS summary FROM r""")
def brf_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries polished by a model; where it fails, or answers without a summary, the rule's stays (shown here as its kind)."""

    def factory() -> M.Answerer:
        def ask(prompts: list[str]) -> list[str | None]:
            n = int(prompts[0].split("|")[0])
            if n == 1:
                raise ConnectionError("no route")
            return ['{"executive_summary": "Итог выпуска %d"}' % n if n % 2 == 0 else '{"executive_summary": " "}']  # noqa: UP031

        return ask

    s = R.executive_summary(topics(spark, sf_dir).withColumn("label", F.col("title")), "run").withColumn("prompt", F.concat_ws("|", F.col("run").cast("string"), "summary"))
    a = M.answered(s, "run", "prompt", factory, batch=1)
    told = F.nullif(T.squeezed(F.get_json_object(P.lenient_object("answer"), "$.executive_summary")), F.lit(""))
    return M.with_fallback(s, a, "run", told, F.lit("rule"), "polished").select("run", F.col("polished").alias("summary"))
