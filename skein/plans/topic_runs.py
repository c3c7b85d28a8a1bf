"""Topics of several runs at once: decisions, labels, quality, briefings and the details of a report.

The test tables hold no topics, so they are put together: the clusters of a run are the labels of
its quarter of the embeddings, their comments those with the same id, and their titles and
descriptions those of videos. All rules then run on real texts, vectors and weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import appeal as A
from skein.operators import briefing as B
from skein.operators import clusters as C
from skein.operators import topic_runs as R
from skein.operators import topics as K
from skein.plans.analytics import _named_titles, _q
from skein.plans.filters import like_sql, squeeze_sql, words_sql
from skein.plans.registry import query
from skein.plans.vectors import POINTS, points
from skein.settings import DEFAULT as S
from skein.sources import table

RUNS = 4
_MOODS = ("negative", "neutral", "positive", "mixed")
_INTENT_NAMES = (*[n for n, _ in K.INTENTS], "other")
_LOW = "lower(text)"
_INTENT = "CASE " + " ".join("WHEN " + " OR ".join(f"contains({_LOW}, {_q(x)})" for x in signs) + f" THEN '{name}'" for name, signs in K.INTENTS) + " ELSE 'other' END"
_TITLE = squeeze_sql("coalesce(title, '')")
#: Topics of each run (run, label, key, size, shares, coherence, confidence, title, description, source, sentiment), and their comments m.
TOPICS = f"""{POINTS}, t AS (SELECT id % {RUNS} AS run, label, id, v, weight, likes, replies FROM p), x AS (SELECT run, label, i, avg(v[i]) AS m FROM t, generate_series(1, 64) g(i) GROUP BY ALL), c AS (SELECT run, label, list(m ORDER BY i) AS centroid FROM x GROUP BY ALL),
o AS (SELECT t.*, list_cosine_similarity(t.v, c.centroid) AS cos FROM t JOIN c USING (run, label)),
g AS (SELECT run, label, count(*) AS size, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY run), 4) AS share_pct, round(100.0::DOUBLE * sum(weight) / sum(sum(weight)) OVER (PARTITION BY run), 4) AS weighted_share, round(avg(cos), 6) AS coherence, round(avg(least(1, greatest(cos, 0))), 6) AS confidence, count(*) FILTER (cos < 0.5) AS ambiguous, round(100.0::DOUBLE * count(*) FILTER (cos < 0.5) / count(*), 4) AS ambiguous_share FROM o GROUP BY run, label),
topics AS (SELECT g.*, 'cluster_' || g.label AS key, {_TITLE} AS title, coalesce(v.description, '') AS description, CASE WHEN g.label % 3 = 0 THEN 'episode_topic' ELSE 'comment_topic' END AS source, [{", ".join(map(_q, _MOODS))}][1 + (g.label + g.run)::INT % 4] AS sentiment FROM g LEFT JOIN videos v ON v.id = 1 + g.run * 10 + g.label),
m AS (SELECT o.run, o.label, o.id, o.weight, o.cos, o.likes, o.replies, {squeeze_sql("c.text_raw")} AS text FROM o JOIN raw_comments c ON c.comment_id = o.id WHERE {squeeze_sql("c.text_raw")} <> '')"""
#: Quotes and questions among the eight heaviest comments of each topic, in order; actions are its quotes.
QUOTED = """e AS (SELECT *, row_number() OVER (PARTITION BY run, label ORDER BY weight DESC, id) AS place FROM m), w AS (SELECT run, label, coalesce(list(text ORDER BY place) FILTER (NOT regexp_matches(text, '[?¿？]')), []::VARCHAR[]) AS quotes, coalesce(list(text ORDER BY place) FILTER (regexp_matches(text, '[?¿？]')), []::VARCHAR[]) AS questions FROM e WHERE place <= 8 GROUP BY ALL)"""


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).withColumn("run", F.col("id") % RUNS)


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir)
    o = C.with_centroid(p, ["run", "label"])
    g = o.groupBy("run", "label").agg(
        F.count(F.lit(1)).alias("size"), F.sum("weight").alias("weight"), F.round(F.avg("cos"), 6).alias("coherence"), F.round(F.avg(F.least(F.lit(1.0), F.greatest("cos", F.lit(0.0)))), 6).alias("confidence"), F.count_if(F.col("cos") < 0.5).alias("ambiguous"), F.first("centroid").alias("centroid")
    )
    w = W.partitionBy("run")
    g = g.withColumns({
        "share_pct": F.round(F.lit(100.0) * F.col("size") / F.sum("size").over(w), 4), "weighted_share": F.round(F.lit(100.0) * F.col("weight") / F.sum("weight").over(w), 4), "ambiguous_share": F.round(F.lit(100.0) * F.col("ambiguous") / F.col("size"), 4),
        "key": F.concat(F.lit("cluster_"), F.col("label").cast("string")), "source": F.when(F.col("label") % 3 == 0, "episode_topic").otherwise("comment_topic"), "sentiment": F.get(F.array(*map(F.lit, _MOODS)), ((F.col("label") + F.col("run")) % 4).cast("int")), "video": 1 + F.col("run") * 10 + F.col("label"),
    })
    v = table(spark, sf_dir, "videos").select(F.col("id").alias("video"), "title", "description")
    return g.join(v, "video", "left").withColumns({"title": T.squeezed(F.coalesce("title", F.lit(""))), "description": F.coalesce("description", F.lit(""))}).drop("video", "weight")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = C.with_centroid(_points(spark, sf_dir), ["run", "label"])
    c = table(spark, sf_dir, "raw_comments").select(F.col("comment_id").alias("id"), T.squeezed(F.col("text_raw")).alias("text"))
    return o.join(c, "id").filter("text <> ''").select("run", "label", "id", "weight", "cos", "likes", "replies", "text")


def _texts(which: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.when(which, F.struct("rank", "text")))), lambda x: x["text"])


def quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics with quotes, questions, actions and intents."""
    m = members(spark, sf_dir)
    top = C.top_k(m, ["run", "label"], [F.desc("weight"), F.col("id")], 8)
    asked = F.col("text").rlike("[?¿？]")
    q = top.groupBy("run", "label").agg(_texts(~asked).alias("quotes"), _texts(asked).alias("questions"))
    counts = m.groupBy("run", "label").agg(*[F.count_if(K.intent(F.col("text")) == n).cast("int").alias(n) for n in _INTENT_NAMES])
    intents = F.create_map(*[x for n in _INTENT_NAMES for x in (F.lit(n), F.col(n))])
    q = q.join(counts.select("run", "label", intents.alias("intents")), ["run", "label"])
    return topics(spark, sf_dir).join(q, ["run", "label"]).withColumn("actions", F.col("quotes"))


# --- quality ---------------------------------------------------------------------------------------


@query("flt_30_low_coherence", f"WITH {TOPICS} SELECT run, label, weighted_share < {S.low_coherence_share} AND size < {max(20, 3 * S.cluster_min_size)} AND coherence < {S.coherence_min} AS is_skipped FROM topics")
def flt_30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics(spark, sf_dir).select("run", "label", R.low_coherence(F.col("weighted_share"), F.col("size"), F.col("coherence")).alias("is_skipped"))


def _detailed_sql(d: str) -> str:
    d = squeeze_sql(d)
    return f"(length({d}) >= 96 AND len(regexp_extract_all({d}, '[.!?]')) >= 2 AND len(list_filter(list_distinct({words_sql(f'lower({d})', 4)}), lambda x: x NOT IN ({', '.join(map(_q, K.STOPWORDS))}))) >= 8)"


_WEAK_MARKS = " OR ".join(f"contains(l, {_q(x)})" for x in R.WEAK_LABELS)


@query("flt_31_weak_topics", f"WITH {TOPICS}, z AS (SELECT run, label, CASE WHEN label = 7 THEN 'Новая тема дня' WHEN label = 8 THEN 'тема' ELSE title END AS name, description, (size % 5)::INT AS positions FROM topics), y AS (SELECT *, lower({squeeze_sql('name')}) AS l FROM z) SELECT run, label, len(string_split(l, ' ')) < 2 OR l = lower('{R.UNCERTAIN}') OR starts_with(l, '[ошибка]') OR {_WEAK_MARKS} OR (positions >= 3 AND NOT {_detailed_sql('description')}) AS is_weak FROM y")
def flt_31(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics that are worth a second naming."""
    name = F.when(F.col("label") == 7, "Новая тема дня").when(F.col("label") == 8, "тема").otherwise(F.col("title"))
    return topics(spark, sf_dir).select("run", "label", R.weak_topic(name, F.col("description"), F.col("size") % 5).alias("is_weak"))


#: Positions of a topic: three parts of its points, the first undetermined, with titles of videos.
_POSITIONS = f"""q AS (SELECT t.run, t.label, t.id // {RUNS} % 3 AS position, count(*) AS n FROM t GROUP BY ALL), u AS (SELECT q.*, {squeeze_sql("coalesce(v.title, '')")} AS name FROM q LEFT JOIN videos v ON v.id = 1 + q.label * 3 + q.position)"""
_TWICE = rf"(^|{T.NOT_W})(?:и|или|and|or){T.NOT_W}(.*{T.NOT_W})?(?:и|или|and|or)($|{T.NOT_W})"
_SINGLE = f"(name <> '' AND NOT regexp_matches(lower(name), '[/\\\\;|]') AND length(name) - length(replace(name, ':', '')) <= 1 AND length(name) - length(replace(name, ',', '')) <= 1 AND NOT (contains(name, ':') AND {like_sql('lower(name)', T.whole_word('и|или|and|or|but'))}) AND NOT {like_sql('lower(name)', _TWICE)})"


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _points(spark, sf_dir).groupBy("run", "label", F.floor(F.col("id") / RUNS).cast("bigint").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    q = q.groupBy("run", "label", (F.col("at") % 3).alias("position")).agg(F.sum("n").alias("n")).withColumn("video", 1 + F.col("label") * 3 + F.col("position"))
    v = table(spark, sf_dir, "videos").select(F.col("id").alias("video"), "title")
    return q.join(v, "video", "left").withColumn("name", T.squeezed(F.coalesce("title", F.lit("")))).drop("title", "video")


_PCT = "CASE WHEN {b} > 0 THEN 100.0::DOUBLE * {a} / {b} ELSE 0 END"
_METRICS = f"""{_POSITIONS}, y AS (SELECT run, sum(n) AS total, sum(n) FILTER (position = 0) AS lost, count(*) FILTER (position <> 0) AS named, count(*) FILTER (position <> 0 AND {_SINGLE}) AS single FROM u GROUP BY run)"""


def _metrics(spark: SparkSession, sf_dir: str, keys: list[str]) -> DataFrame:
    named = F.col("position") != 0
    g = _positions(spark, sf_dir).groupBy(*keys).agg(F.sum("n").alias("total"), F.sum(F.when(~named, F.col("n")).otherwise(0)).alias("lost"), F.count_if(named).alias("named"), F.count_if(named & K.single_claim(F.col("name"))).alias("single"))
    return g.select(*keys, "named", "lost", R.pct(F.col("lost"), F.col("total")).alias("undetermined"), R.pct(F.col("single"), F.col("named")).alias("single_claim"))


@query("agg_09_position_metrics", f"WITH {TOPICS}, {_METRICS} SELECT run, named, round({_PCT.format(a='coalesce(lost, 0)', b='total')}, 6) AS undetermined_comment_share, round({_PCT.format(a='single', b='named')}, 6) AS single_claim_pass_rate FROM y")
def agg_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named positions, share of undetermined comments, and share of titles with one claim, of each run."""
    return _metrics(spark, sf_dir, ["run"]).select("run", "named", F.round("undetermined", 6).alias("undetermined_comment_share"), F.round("single_claim", 6).alias("single_claim_pass_rate"))


def _good_title_sql(t: str) -> str:
    t = f"trim(regexp_replace({t}, '^[ \\-:;,.]+|[ \\-:;,.]+$', '', 'g'))"
    good = _named_titles(t)
    return f"(NOT regexp_matches({t}, '[/\\\\]') AND len({words_sql(t)}) BETWEEN 3 AND 10 AND len({good}) >= 2 AND NOT ({like_sql(f'lower({t})', K.BAD_TITLE)} AND len({good}) < 3) AND len(list_intersect({words_sql(f'lower({t})')}, ['misc', 'other', 'разное', 'прочее'])) = 0)"


_RATES = f"""a AS (SELECT run, count(*) AS n, count(*) FILTER (NOT {_good_title_sql("title")}) AS bad FROM topics GROUP BY run), b AS (SELECT run, count(*) AS n, count(*) FILTER (NOT {_good_title_sql("name")}) AS bad FROM u WHERE position <> 0 GROUP BY run)"""


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = topics(spark, sf_dir).groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.count_if(~K.valid_title(F.col("title"))).alias("bad"))
    b = _positions(spark, sf_dir).filter("position <> 0").groupBy("run").agg(F.count(F.lit(1)).alias("m"), F.count_if(~K.valid_title(F.col("name"))).alias("worse"))
    return a.join(b, "run").select("run", "n", R.pct(F.col("bad"), F.col("n")).alias("topic_rate"), R.pct(F.col("worse"), F.col("m")).alias("position_rate"), R.pct(F.col("bad") + F.col("worse"), F.col("n") + F.col("m")).alias("rate"))


@query("agg_10_fallback_rates", f"WITH {TOPICS}, {_POSITIONS}, {_RATES} SELECT run, round({_PCT.format(a='a.bad', b='a.n')}, 6) AS topic_rate, round({_PCT.format(a='b.bad', b='b.n')}, 6) AS position_rate, round({_PCT.format(a='(a.bad + b.bad)', b='(a.n + b.n)')}, 6) AS rate FROM a JOIN b USING (run)")
def agg_10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of topics and positions whose title is no good, so that a title from keywords stands in."""
    return _rates(spark, sf_dir).select("run", *[F.round(c, 6).alias(c) for c in ("topic_rate", "position_rate", "rate")])


@query("agg_11_run_watchdog", f"""WITH {TOPICS}, {_METRICS}, {_RATES}, z AS (SELECT run, {_PCT.format(a='coalesce(lost, 0)', b='total')} AS lost, {_PCT.format(a='(a.bad + b.bad)', b='(a.n + b.n)')} AS rate, a.n AS n FROM y JOIN a USING (run) JOIN b USING (run))
SELECT run, lost > {S.watchdog_undetermined} OR rate > {S.watchdog_fallback} AS degraded, concat_ws('; ', CASE WHEN lost > {S.watchdog_undetermined} THEN 'undetermined_comment_share>{S.watchdog_undetermined:.1f}% (' || printf('%.2f', round(lost, 2)) || '%)' END, CASE WHEN rate > {S.watchdog_fallback} THEN 'fallback_title_rate>{S.watchdog_fallback:.1f}% (' || printf('%.2f', round(rate, 2)) || '%)' END) AS reasons, rate > 65 OR run * 2 < greatest(3, ceil(n / 2.0)) AS llm_starved FROM z""")
def agg_11_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degraded runs with their reasons, and runs whose labelling had too few calls (here twice the run's number)."""
    j = _metrics(spark, sf_dir, ["run"]).join(_rates(spark, sf_dir), "run").withColumn("reasons", R.watchdog(F.col("undetermined"), F.col("rate")))
    return j.select("run", (F.size("reasons") > 0).alias("degraded"), F.array_join("reasons", "; ").alias("reasons"), R.starved(F.col("rate"), F.col("run") * 2, F.col("n")).alias("llm_starved"))


@query("agg_12_diagnostics", f"""WITH {TOPICS}, {_POSITIONS}, y AS (SELECT run, label, sum(n) AS total, coalesce(sum(n) FILTER (position = 0), 0) AS lost, count(*) FILTER (position <> 0) AS named, count(*) FILTER (position <> 0 AND {_SINGLE}) AS single FROM u GROUP BY ALL)
SELECT run, key, title AS label, source, size, share_pct, weighted_share, coherence, confidence, ambiguous_share, named AS positions_count, lost AS undetermined_comments, round({_PCT.format(a='lost', b='total')}, 2) AS undetermined_share, round({_PCT.format(a='single', b='named')}, 2) AS single_claim_pass_rate, row_number() OVER (PARTITION BY run ORDER BY weighted_share DESC, key) AS place FROM topics JOIN y USING (run, label)""")
def agg_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each cluster of a run, by falling share."""
    j = topics(spark, sf_dir).join(_metrics(spark, sf_dir, ["run", "label"]), ["run", "label"])
    place = F.row_number().over(W.partitionBy("run").orderBy(F.desc("weighted_share"), "key")).cast("bigint")
    return j.select(
        "run", "key", F.col("title").alias("label"), "source", "size", "share_pct", "weighted_share", "coherence", "confidence", "ambiguous_share", F.col("named").alias("positions_count"), F.col("lost").alias("undetermined_comments"),
        F.round("undetermined", 2).alias("undetermined_share"), F.round("single_claim", 2).alias("single_claim_pass_rate"), place.alias("place"),
    )


# --- merges and labels -----------------------------------------------------------------------------


def _tok(x: str) -> str:
    return f"list_sort(list_filter(list_distinct({words_sql(f'lower({x})', 4)}), lambda x: x NOT IN ({', '.join(map(_q, K.STOPWORDS))})))"


def _jac(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct({a} || {b})) END)"


def _subset(a: str, b: str) -> str:
    return f"len(list_filter({a}, lambda x: NOT list_contains({b}, x))) = 0"


_NEAR, _ALIKE = max(0.90, S.topic_merge_cosine), max(0.42, S.topic_merge_jaccard, 0.34)
#: Titles of pairs overlap more often when the last word of the second is that of the first.
_NAME_B = "CASE WHEN b.label % 2 = 1 THEN a.title || ' снова' ELSE b.title END"


@query("join_18_topic_pairs", f"""WITH {TOPICS}, i AS (SELECT a.run, a.key AS a, b.key AS b, a.title AS label_a, {_NAME_B} AS label_b, a.weighted_share AS wa, b.weighted_share AS wb, {_tok('a.title')} AS la, {_tok(_NAME_B)} AS lb, {_tok('a.description')} AS da, {_tok('b.description')} AS db, list_cosine_similarity(ca.centroid, cb.centroid) AS cos FROM topics a JOIN topics b ON b.run = a.run AND a.label < b.label JOIN c ca ON ca.run = a.run AND ca.label = a.label JOIN c cb ON cb.run = b.run AND cb.label = b.label),
s AS (SELECT *, {_jac('la', 'lb')} AS j, {_jac('da', 'db')} AS d, len(la) >= {S.topic_subset_tokens} AND len(lb) >= {S.topic_subset_tokens} AND ({_subset('la', 'lb')} OR {_subset('lb', 'la')}) AS sub, contains(lower(label_a), lower(label_b)) OR contains(lower(label_b), lower(label_a)) AS con FROM i)
SELECT run, a, b, round(cos, 5) AS cos, round(j, 6) AS jaccard, NOT (least(wa, wb) >= {S.low_coherence_share} AND j < 0.42) AND ((cos >= {min(0.98, _NEAR + 0.04)} AND j >= {_ALIKE}) OR (sub AND j >= 0.34 AND cos >= {_NEAR}) OR (con AND j >= 0.38 AND cos >= {_NEAR}) OR (j >= 0.62 AND cos >= 0.90) OR (d >= 0.45 AND j >= 0.38 AND cos >= 0.92)) AS merge FROM s""")
def join_18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of topics of each run, which has a dozen at most, with the merge decision."""
    t = topics(spark, sf_dir)
    a, b = (t.select("run", *[F.col(c).alias(f"{c}_{s}") for c in ("label", "key", "title", "description", "weighted_share", "centroid")]) for s in ("a", "b"))
    p = a.join(b, "run").filter("label_a < label_b").withColumn("title_b", F.when(F.col("label_b") % 2 == 1, F.concat("title_a", F.lit(" снова"))).otherwise(F.col("title_b")))
    p = p.drop("label_a", "label_b").withColumnsRenamed({"title_a": "label_a", "title_b": "label_b"})
    d = R.merged_decision(p)
    return d.select("run", F.col("key_a").alias("a"), F.col("key_b").alias("b"), F.round("cos", 5).alias("cos"), F.round("jaccard", 6).alias("jaccard"), "merge")


def _pick_sql(a: str, b: str) -> str:
    return f"CASE WHEN {a} = '' THEN {b} WHEN {b} = '' THEN {a} WHEN {_jac(_tok(a), _tok(b))} >= 0.6 AND length({b}) < length({a}) THEN {b} ELSE {a} END"


@query("join_19_best_title", f"""WITH {TOPICS}, e AS (SELECT r.run, v.id AS ord, {_TITLE} AS title, {_tok('title')} AS tt FROM videos v, (SELECT DISTINCT run FROM topics) r WHERE v.id % {RUNS} = r.run AND v.id <= 60 AND len({_tok('title')}) > 0),
s AS (SELECT t.run, t.key, t.title AS label, t.source, e.title, e.ord, {_tok("t.title || ' ' || t.description")} AS own, tt FROM topics t LEFT JOIN e USING (run)), k AS (SELECT *, {_jac('own', 'tt')} AS j, len(list_intersect(own, tt))::DOUBLE / greatest(1, len(tt)) AS cover FROM s),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY run, key ORDER BY greatest(j, cover) DESC NULLS LAST, ord) = 1), d AS (SELECT *, source <> 'episode_topic' AND len(own) > 0 AND coalesce(greatest(j, cover) > 0 AND (j >= 0.55 OR cover >= 0.72), false) AS about FROM b)
SELECT run, key, CASE WHEN about THEN {_pick_sql('title', 'label')} ELSE label END AS label, CASE WHEN about THEN 'episode_topic' ELSE source END AS source FROM d""")
def join_19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comment topics that are about an episode's topic take its label; the episodes of a run are some sixty titles at most."""
    episodes = table(spark, sf_dir, "videos").filter("id <= 60").select((F.col("id") % RUNS).alias("run"), F.col("id").alias("ord"), "title")
    return R.harmonized(topics(spark, sf_dir).select("run", "key", F.col("title").alias("label"), "description", "source"), episodes, "run")


_TAGS = "CASE {m} WHEN 'negative' THEN ['тревога', 'раздражение'] WHEN 'positive' THEN ['поддержка', 'Тревога '] ELSE []::VARCHAR[] END"
_SCORE = "CASE {m} WHEN 'positive' THEN 1.0::DOUBLE WHEN 'negative' THEN -1.0::DOUBLE ELSE 0 END"


@query("agg_25_merge_rollup", f"""WITH {TOPICS}, n AS (SELECT run, label, {", ".join(f"count(*) FILTER ({_INTENT} = '{n}') AS {n}" for n in _INTENT_NAMES)} FROM m GROUP BY ALL), z AS (SELECT t.*, {", ".join(f"coalesce(n.{n}, 0) AS {n}" for n in _INTENT_NAMES)} FROM topics t LEFT JOIN n USING (run, label)),
r AS (SELECT *, row_number() OVER (PARTITION BY run, label // 2 ORDER BY source = 'episode_topic' DESC, weighted_share DESC, size DESC, label) AS place FROM z),
j AS (SELECT a.run, a.key, b.key AS other, a AS a, b AS b FROM r a JOIN r b ON b.run = a.run AND b.label // 2 = a.label // 2 AND b.place = 2 WHERE a.place = 1),
gg AS (SELECT run, key, e.tag AS tag, sum(e.w) AS w, min(e.pos) AS pos FROM (SELECT run, key, unnest(list_transform({_TAGS.format(m='a.sentiment')}, lambda x, i: {{'tag': lower(trim(x)), 'w': greatest(1, round_even(a.weighted_share, 0))::INT, 'pos': i}}) || list_transform({_TAGS.format(m='b.sentiment')}, lambda x, i: {{'tag': lower(trim(x)), 'w': greatest(1, round_even(b.weighted_share, 0))::INT, 'pos': i + 1000}})) AS e FROM j) GROUP BY ALL),
h AS (SELECT run, key, string_agg(tag, ', ' ORDER BY w DESC, pos) AS emotions FROM (SELECT * FROM gg QUALIFY row_number() OVER (PARTITION BY run, key ORDER BY w DESC, pos) <= 2) GROUP BY ALL),
q AS (SELECT *, ({_SCORE.format(m='a.sentiment')} * greatest(0.01, a.weighted_share) + {_SCORE.format(m='b.sentiment')} * greatest(0.01, b.weighted_share)) / (greatest(0.01, a.weighted_share) + greatest(0.01, b.weighted_share)) AS mean FROM j)
SELECT q.run, q.key, other, round((a.confidence * a.size + b.confidence * b.size) / (a.size + b.size), 4) AS confidence, round((a.ambiguous_share * a.size + b.ambiguous_share * b.size) / (a.size + b.size), 2) AS ambiguous_share, CASE WHEN mean >= 0.15 THEN 'positive' WHEN mean <= -0.15 THEN 'negative' ELSE 'neutral' END AS sentiment, {_pick_sql('a.title', 'b.title')} AS label,
CASE WHEN a.source = 'episode_topic' OR b.source = 'episode_topic' THEN 'episode_topic' ELSE 'comment_topic' END AS source, a.question + b.question AS questions, a.complaint + b.complaint AS complaints, coalesce(emotions, '') AS emotions, CASE WHEN a.title = '' THEN b.title WHEN lower(a.title) = lower(b.title) OR b.title = '' THEN a.title ELSE a.title || '|' || b.title END AS actions FROM q LEFT JOIN h ON h.run = q.run AND h.key = q.key""")
def agg_25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What neighbouring topics of a run become when they are merged: the primary is an episode's, else the larger one."""
    t = topics(spark, sf_dir).drop("centroid")
    counts = members(spark, sf_dir).groupBy("run", "label").agg(*[F.count_if(K.intent(F.col("text")) == n).alias(n) for n in _INTENT_NAMES])
    t = t.join(counts, ["run", "label"], "left").na.fill(0, list(_INTENT_NAMES))
    tags = F.when(F.col("sentiment") == "negative", F.array(F.lit("тревога"), F.lit("раздражение"))).when(F.col("sentiment") == "positive", F.array(F.lit("поддержка"), F.lit("Тревога "))).otherwise(F.array().cast("array<string>"))
    order = [F.desc(F.col("source") == "episode_topic"), F.desc("weighted_share"), F.desc("size"), F.col("label")]
    t = t.withColumns({"tags": tags, "pair": F.floor(F.col("label") / 2)}).withColumn("place", F.row_number().over(W.partitionBy("run", "pair").orderBy(*order)))
    row = F.struct(*[c for c in t.columns if c not in ("run", "pair", "place")])
    j = t.groupBy("run", "pair").agg(F.first(F.when(F.col("place") == 1, row), True).alias("a"), F.first(F.when(F.col("place") == 2, row), True).alias("b")).filter("b IS NOT NULL")
    a, b = F.col("a"), F.col("b")
    return j.select(
        "run", a["key"].alias("key"), b["key"].alias("other"), R.weighted_mean(a["confidence"], a["size"], b["confidence"], b["size"], 4).alias("confidence"), R.weighted_mean(a["ambiguous_share"], a["size"], b["ambiguous_share"], b["size"], 2).alias("ambiguous_share"),
        R.merged_sentiment(a["sentiment"], a["weighted_share"], b["sentiment"], b["weighted_share"]).alias("sentiment"), R.picked_label(a["title"], b["title"]).alias("label"), F.when((a["source"] == "episode_topic") | (b["source"] == "episode_topic"), "episode_topic").otherwise("comment_topic").alias("source"),
        (a["question"] + b["question"]).alias("questions"), (a["complaint"] + b["complaint"]).alias("complaints"), F.array_join(R.merged_emotions(a["tags"], a["weighted_share"], b["tags"], b["weighted_share"]), ", ").alias("emotions"), F.array_join(R.distinct_folded(F.array(a["title"], b["title"])), "|").alias("actions"),
    )


@query("lbl_11_soft_notes", f"WITH {TOPICS} SELECT run, key, concat_ws('; ', CASE WHEN confidence > 0 THEN 'Средняя уверенность распределения комментариев: ' || printf('%.2f', round(confidence, 2)) END, CASE WHEN ambiguous > 0 THEN 'Пограничных комментариев: ' || ambiguous || '/' || size END) AS notes FROM topics")
def lbl_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics(spark, sf_dir).select("run", "key", F.array_join(R.soft_notes(F.col("confidence"), F.col("ambiguous"), F.col("size")), "; ").alias("notes"))


_ONE_LINE = "replace(replace(replace(title, '\"', ''), chr(10), ' '), chr(9), ' ')"
_RAW_LABEL = f"CASE id % 4 WHEN 0 THEN title WHEN 1 THEN '[\"' || {_ONE_LINE} || '\", \"x\"]' WHEN 2 THEN '{{\"title\": \"' || {_ONE_LINE} || '\"}}' ELSE 'я' END"
_FLAT = squeeze_sql("replace(title, '\"', '')")


@query("str_24_sanitized_labels", f"""SELECT id, CASE WHEN id % 4 = 0 AND length({squeeze_sql('title')}) >= 2 THEN {squeeze_sql('title')} WHEN id % 4 IN (1, 2) AND length({_FLAT}) >= 2 THEN {_FLAT} WHEN id % 3 = 0 THEN 'тема выпуска' ELSE 'правило' END AS label,
CASE WHEN id % 2 = 0 THEN {squeeze_sql("coalesce(description, '')")} ELSE array_to_string(list_filter([{_FLAT}, 'два', 'три'], lambda x: x <> ''), '. ') END AS description,
CASE WHEN length({squeeze_sql("coalesce(description, '')")}) >= 80 THEN {squeeze_sql("coalesce(description, '')")} WHEN {squeeze_sql("coalesce(description, '')")} = '' THEN {squeeze_sql('title')} WHEN contains(lower({squeeze_sql("description")}), lower({squeeze_sql('title')})) THEN {squeeze_sql('description')} ELSE {squeeze_sql('description')} || CASE WHEN regexp_matches({squeeze_sql('description')}, '[.!?]$') THEN '' ELSE '.' END || ' ' || {squeeze_sql('title')} END AS extended FROM videos""")
def str_24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that come as text, list or object; descriptions as text or list; short descriptions with the rule's added."""
    flat = F.replace("title", F.lit('"'), F.lit(""))
    raw = F.when(F.col("id") % 2 == 0, F.col("description")).otherwise(F.concat(F.lit('["'), flat, F.lit('", "два", " ", "три", "четыре"]')))
    matched = F.when(F.col("id") % 3 == 0, F.lit("тема выпуска"))
    return table(spark, sf_dir, "videos").select("id", R.sanitized_label(F.expr(_RAW_LABEL), F.lit("правило"), matched).alias("label"), R.normalized_description(raw).alias("description"), R.extended_description(F.col("description"), F.col("title")).alias("extended"))


_PRACTICAL_SQL = f"len(string_split({{a}}, ' ')) >= 4 AND NOT {like_sql('lower({a})', R.UNREALISTIC).replace('{', '{{').replace('}', '}}').replace('{{a}}', '{a}')} AND {like_sql('lower({a})', R.PRACTICAL).replace('{', '{{').replace('}', '}}').replace('{{a}}', '{a}')}"


@query("str_24_sanitized_lists", f"""WITH {TOPICS}, {QUOTED}, n AS (SELECT run, label, quotes || questions AS raw FROM w), k AS (SELECT run, label, raw, list_filter(raw, lambda a: {_PRACTICAL_SQL.format(a='a')}) AS own FROM n), f AS (SELECT *, ['Дайте короткий ответ на каждый вопрос зрителей'] AS rule FROM k), z AS (SELECT *, CASE WHEN len(own) < 2 THEN rule ELSE own END AS base FROM f),
y AS (SELECT run, label, raw, rule, list_filter(base, lambda a, i: list_position(list_transform(base, lambda x: lower(x)), lower(a)) = i) AS good FROM z)
SELECT run, label, array_to_string(CASE WHEN len(good) > 0 THEN good ELSE rule END, '|') AS actions, array_to_string(list_filter(raw, lambda a, i: list_position(list_transform(raw, lambda x: lower(x)), lower(a)) = i)[1:8], '|') AS quotes FROM y""")
def str_24_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions an author can take, and quotes without repeats; the rule's lists where too little is left."""
    raw, rule = F.concat("quotes", "questions"), F.array(F.lit("Дайте короткий ответ на каждый вопрос зрителей"))
    return quoted(spark, sf_dir).select("run", "label", F.array_join(R.sanitized_actions(raw, rule), "|").alias("actions"), F.array_join(R.sanitized_quotes(raw, rule), "|").alias("quotes"))


# --- briefing --------------------------------------------------------------------------------------


def _snip(x: str, most: int) -> str:
    t = f"regexp_replace({x}, '^[«»\"'']+|[«»\"'']+$', '', 'g')"
    return f"CASE WHEN length({t}) > {most} THEN regexp_replace(substring({t}, 1, {most - 1}), '[ ,.;:]+$', '') || '…' ELSE {t} END"


_QSCORE = f"((CASE WHEN contains(q, '?') THEN 5 ELSE 0 END) + (CASE WHEN {like_sql('lower(q)', B.QUESTION_START)} THEN 4 ELSE 0 END) + (CASE WHEN length(q) BETWEEN 35 AND 220 THEN 3 WHEN length(q) BETWEEN 20 AND 320 THEN 1 ELSE 0 END) + (CASE WHEN regexp_matches(lower(q), 'почему|как|что будет|что делать|зачем') THEN 2 ELSE 0 END))"
_BRIEFED = f"""{TOPICS}, {QUOTED}, n AS (SELECT run, label, count(*) FILTER ({_INTENT} = 'complaint') AS complaints, count(*) FILTER ({_INTENT} = 'question') AS asked FROM m GROUP BY ALL),
z AS (SELECT t.*, w.quotes, w.questions, n.complaints, n.asked, list_filter(list_transform(w.quotes, lambda x: {_snip('x', 260)}), lambda x: x <> '' AND NOT {like_sql('lower(x)', B.GENERIC)} AND NOT {like_sql('lower(x)', B.IMPRACTICAL)}) AS good, list_filter(list_transform(w.questions || w.quotes, lambda x: {_snip('x', 800)}), lambda x: x <> '') AS lines FROM topics t JOIN w USING (run, label) JOIN n USING (run, label))"""


@query("brf_02_action_items", f"""WITH {_BRIEFED}, l AS (SELECT run, label, q, {_QSCORE} AS score, pos FROM (SELECT run, label, unnest(lines) AS q, generate_subscripts(lines, 1) AS pos FROM z)), k AS (SELECT run, label, q FROM l WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY run, label ORDER BY score DESC, pos) = 1)
SELECT z.run, z.key, CASE WHEN title = '' THEN 'текущая тема' ELSE title END AS label, trunc(weighted_share * 100)::INT + CASE sentiment WHEN 'negative' THEN 50 WHEN 'mixed' THEN 25 ELSE 0 END + 15 * len(list_filter(quotes, lambda x: {like_sql('lower(x)', B.TOXIC)})) + 20 * len(list_filter(quotes, lambda x: {like_sql('lower(x)', B.FACTUAL)})) + CASE WHEN complaints >= greatest(2, asked) THEN 30 ELSE 0 END AS priority, coalesce(good[1], '') AS action, coalesce(k.q, '') AS key_question FROM z LEFT JOIN k ON k.run = z.run AND k.label = z.label""")
def brf_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An action item for each topic: priority, first practical action, key question."""
    return R.action_items(quoted(spark, sf_dir).withColumn("label", F.col("title")), "run").select("run", "key", "label", "priority", "action", "key_question")


@query("srt_09_items_by_priority", f"""WITH {_BRIEFED}, i AS (SELECT run, key, weighted_share, trunc(weighted_share * 100)::INT + CASE sentiment WHEN 'negative' THEN 50 WHEN 'mixed' THEN 25 ELSE 0 END + 15 * len(list_filter(quotes, lambda x: {like_sql('lower(x)', B.TOXIC)})) + 20 * len(list_filter(quotes, lambda x: {like_sql('lower(x)', B.FACTUAL)})) + CASE WHEN complaints >= greatest(2, asked) THEN 30 ELSE 0 END AS priority FROM z)
SELECT run, key, row_number() OVER (PARTITION BY run ORDER BY priority DESC, weighted_share DESC, key) AS place FROM i""")
def srt_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.action_items(quoted(spark, sf_dir).withColumn("label", F.col("title")), "run").select("run", "key", F.col("place").cast("bigint").alias("place"))


@query("brf_04_summary", f"""WITH {TOPICS}, n AS (SELECT run, sum(share_pct) FILTER (sentiment = 'negative') AS negative FROM topics GROUP BY run), d AS (SELECT * FROM topics QUALIFY row_number() OVER (PARTITION BY run ORDER BY weighted_share DESC, key DESC) = 1)
SELECT run, 'Главный фокус аудитории: «' || title || '» (' || printf('%.1f', round(share_pct, 1)) || '% комментариев, ' || printf('%.1f', round(weighted_share, 1)) || '% с учетом веса). Общий тон дискуссии: ' || CASE WHEN coalesce(negative, 0) >= 35 THEN 'напряженный' ELSE 'умеренный' END || '. Перед следующим выпуском важно закрыть претензии, которые чаще всего повторяются в топ-темах.' AS summary FROM d JOIN n USING (run)""")
def brf_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.executive_summary(topics(spark, sf_dir).withColumn("label", F.col("title")), "run")


def _lines_sql(pattern: str) -> str:
    return f"list_transform(list_filter(all_quotes, lambda x: {like_sql('lower(x)', pattern)}), lambda x: {_snip('x', 800)})"


_ANY = "|".join(f"(?:{x})" for x in (B.TOXIC, B.FACTUAL, B.CONFUSION))
#: Quotes of a topic: the comments with some signal, dealt out to the topics by their ids.
_SIGNALS = f"""{TOPICS}, e AS (SELECT comment_id % {RUNS} AS run, comment_id // {RUNS} % 10 AS label, comment_id AS id, {squeeze_sql("text_raw")} AS text FROM raw_comments WHERE {like_sql("lower(text_raw)", _ANY)}), w AS (SELECT run, label, list(text ORDER BY id) AS all_quotes FROM e GROUP BY ALL), z AS (SELECT t.*, all_quotes, len(all_quotes) AS n, {_lines_sql(B.FACTUAL)} AS facts, {_lines_sql(B.CONFUSION)} AS lost, {_lines_sql(B.TOXIC)} AS bad FROM topics t JOIN w ON w.run = t.run AND w.label = t.label)"""


def _signalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics with their quotes. A report holds the quotes of a topic in one row, as the rules read them together."""
    c = table(spark, sf_dir, "raw_comments").select((F.col("comment_id") % RUNS).alias("run"), (F.floor(F.col("comment_id") / RUNS) % 10).cast("int").alias("label"), F.col("comment_id").alias("id"), T.squeezed(F.col("text_raw")).alias("text")).filter(F.lower("text").rlike(_ANY))
    q = c.groupBy("run", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda x: x["text"]).alias("quotes"))
    return topics(spark, sf_dir).join(q, ["run", "label"]).withColumn("label", F.col("title"))


@query("brf_05_misunderstandings", f"""WITH {_SIGNALS}, v AS (SELECT *, len(facts)::DOUBLE / n AS f, len(lost)::DOUBLE / n AS c FROM z), y AS (SELECT *, f * 0.6::DOUBLE + c * 0.4::DOUBLE AS value FROM v WHERE n >= 2 AND greatest(len(facts), len(lost)) >= 2)
SELECT run, row_number() OVER (PARTITION BY run ORDER BY value DESC, weighted_share DESC, key) AS place, 'Тема «' || title || CASE WHEN f >= c THEN '»: аудитория спорит с фактурой (' || len(facts) ELSE '»: аудитория не понимает ход аргументации (' || len(lost) END || '/' || n || ' сильных сигналов). Пример: «' || coalesce(facts[1], lost[1]) || '».' AS message FROM y WHERE value >= 0.2 QUALIFY row_number() OVER (PARTITION BY run ORDER BY value DESC, weighted_share DESC, key) <= 4""")
def brf_05_misunderstandings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.top_lines(_signalled(spark, sf_dir), "run", R.misunderstanding_line(F.col("label"), F.col("quotes")))
    return out.withColumn("place", F.col("place").cast("bigint"))


@query("brf_05_risks", f"""WITH {_SIGNALS}, y AS (SELECT *, len(bad)::DOUBLE / n * 0.75::DOUBLE + CASE WHEN sentiment = 'negative' THEN 0.25 ELSE 0 END AS value FROM z WHERE len(bad) >= 2)
SELECT run, row_number() OVER (PARTITION BY run ORDER BY value DESC, weighted_share DESC, key) AS place, 'Тема «' || title || CASE WHEN value >= 0.55 THEN '»: высокий риск агрессивной эскалации (' || len(bad) || '/' || n || ' репрезентативных цитат)' ELSE '»: заметен конфликтный тон (' || len(bad) || '/' || n || ' цитат с агрессивной формулировкой)' END || '. Пример: «' || bad[1] || '».' AS message FROM y WHERE value >= 0.28 QUALIFY row_number() OVER (PARTITION BY run ORDER BY value DESC, weighted_share DESC, key) <= 4""")
def brf_05_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.top_lines(_signalled(spark, sf_dir), "run", R.risk_line(F.col("label"), F.col("quotes"), F.col("sentiment")))
    return out.withColumn("place", F.col("place").cast("bigint"))


@query("srt_08_top_four", f"WITH {_SIGNALS}, y AS (SELECT run, key, len(bad)::DOUBLE / n AS value, weighted_share FROM z) SELECT run, key, row_number() OVER (PARTITION BY run ORDER BY value DESC, weighted_share DESC, key) AS place FROM y QUALIFY row_number() OVER (PARTITION BY run ORDER BY value DESC, weighted_share DESC, key) <= 4")
def srt_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four topics of each run with the largest share of toxic quotes."""
    value = F.size(F.filter("quotes", lambda q: F.lower(q).rlike(B.TOXIC))) / F.size("quotes")
    t = _signalled(spark, sf_dir).withColumn("value", value)
    return C.top_k(t, ["run"], [F.desc("value"), F.desc("weighted_share"), F.col("key")], 4, "place").select("run", "key", F.col("place").cast("bigint").alias("place"))


def briefing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested row a run: topics with positions, action items, misunderstandings, risks, disagreements and summary."""
    named = quoted(spark, sf_dir).withColumn("label", F.col("title"))
    positions = _positions(spark, sf_dir).groupBy("run", F.concat(F.lit("cluster_"), F.col("label").cast("string")).alias("key")).agg(F.array_sort(F.collect_list(F.struct((F.col("position") == 0).alias("is_undetermined"), (-F.col("n")).alias("less"), "name", F.col("n").alias("count")))).alias("positions"))
    t = named.join(positions, ["run", "key"], "left").groupBy("run").agg(F.array_sort(F.collect_list(F.struct((-F.col("weighted_share")).alias("falling"), "key", "label", "share_pct", "weighted_share", "sentiment", "quotes", "questions", "positions"))).alias("top_topics"), F.count(F.lit(1)).alias("topic_count"))
    items = R.action_items(named, "run").groupBy("run").agg(F.array_sort(F.collect_list(F.struct("place", "key", "priority", "action", "key_question"))).alias("action_items"))
    against = members(spark, sf_dir).filter(A.author_disagreement(F.col("text"), "Олег")).groupBy("run", F.lower("text").alias("low")).agg(F.min(F.struct("id", "text")).alias("first")).groupBy("run").agg(F.transform(F.array_sort(F.collect_list("first")), lambda x: x["text"]).alias("author_disagreement_comments"))
    signals = _signalled(spark, sf_dir)

    def lines(name: str, line: Column) -> DataFrame:
        return R.top_lines(signals, "run", line).groupBy("run").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "message"))), lambda x: x["message"]).alias(name))

    out = R.executive_summary(named, "run").withColumnRenamed("summary", "executive_summary").join(t, "run").join(items, "run")
    for more in (lines("misunderstandings", R.misunderstanding_line(F.col("label"), F.col("quotes"))), lines("risks", R.risk_line(F.col("label"), F.col("quotes"), F.col("sentiment"))), against):
        out = out.join(more, "run", "left")
    none = F.array().cast("array<string>")
    return out.withColumns({c: F.coalesce(c, none) for c in ("misunderstandings", "risks", "author_disagreement_comments")})


@query("brf_01_briefing")
def brf_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return briefing(spark, sf_dir)


@query("snk_06_report_rows", f"WITH {TOPICS} SELECT run, count(*) AS topic_count, max_by(title, struct_pack(w := weighted_share, k := key)) AS dominant FROM topics GROUP BY run")
def snk_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report rows: the briefing as JSON, read back as the API reads it."""
    b = briefing(spark, sf_dir)
    stored = b.select("run", F.to_json(F.struct(*[c for c in b.columns if c != "run"])).alias("structured_json"))
    back = F.from_json("structured_json", "topic_count bigint, executive_summary string")
    return stored.select("run", back.alias("b")).select("run", "b.topic_count", F.regexp_extract("b.executive_summary", "«(.*?)» \\(", 1).alias("dominant"))


# --- details of a report -----------------------------------------------------------------------------

_REPRESENTED = f"""s AS (SELECT *, count(*) OVER (PARTITION BY run, label) AS n, round(cos * 0.7::DOUBLE + coalesce(weight / nullif(max(weight) OVER (PARTITION BY run, label), 0), 0) * 0.3::DOUBLE, 6) AS score FROM o), k AS (SELECT *, row_number() OVER (PARTITION BY run, label ORDER BY score DESC, id) AS pos, least(n, greatest(8, least(30, round_even(sqrt(n), 0)::INT))) AS most FROM s),
f AS (SELECT k.run, k.label, k.id, CASE WHEN pos <= most THEN pos END AS rep, round(least(1.0, greatest(0.0, greatest(0.0, k.cos) * 0.75::DOUBLE + k.weight / {S.weight_max}::DOUBLE * 0.20::DOUBLE + least(1.0, (least(k.likes, 60) / 60.0::DOUBLE + least(k.replies, 30) / 30.0::DOUBLE) / 2.0::DOUBLE) * 0.05::DOUBLE)) + CASE WHEN pos <= most THEN 0.05::DOUBLE ELSE 0 END, 5) AS relevance, m.text, m.weight FROM k JOIN m ON m.id = k.id)"""


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members with their rank as a representative (null for others) and their relevance."""
    p = _points(spark, sf_dir)
    reps = C.representatives(p, ["run", "label"]).select("id", F.col("rank").alias("rep"))
    m = members(spark, sf_dir).join(reps, "id", "left")
    return m.withColumn("relevance", F.round(C.relevance(F.col("cos"), F.col("weight"), F.col("likes"), F.col("replies"), F.col("rep").isNotNull()), 5))


@query("srt_07_cluster_comments", f"WITH {TOPICS}, {_REPRESENTED} SELECT run, label, id, row_number() OVER (PARTITION BY run, label ORDER BY rep IS NOT NULL DESC, relevance DESC, id) AS place FROM f")
def srt_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments of a cluster: representatives first, then by relevance."""
    place = F.row_number().over(W.partitionBy("run", "label").orderBy(F.desc(F.col("rep").isNotNull()), F.desc("relevance"), "id"))
    return _ranked(spark, sf_dir).select("run", "label", "id", place.cast("bigint").alias("place"))


_WORDS4 = f"list_filter(list_distinct({words_sql('lower(text)', 4)}), lambda x: x NOT IN ({', '.join(map(_q, K.LABEL_STOPWORDS))}))"


@query("srt_13_prompt_order", f"""WITH {TOPICS}, {_REPRESENTED}, h AS (SELECT *, {_WORDS4} AS ws, count(*) OVER (PARTITION BY run, label) AS total, row_number() OVER (PARTITION BY run, label, lower(text) ORDER BY rep NULLS LAST, weight DESC, id) AS first FROM f), u AS (SELECT * FROM h WHERE first = 1),
a AS (SELECT run, label, list_distinct(flatten(list(ws))) AS anchors FROM u WHERE rep IS NOT NULL GROUP BY ALL HAVING len(list_distinct(flatten(list(ws)))) > 0), j AS (SELECT u.*, anchors, coalesce(len(list_intersect(ws, anchors)), 0) AS overlap, coalesce(len(list_intersect(ws, anchors))::DOUBLE / nullif(len(ws), 0), 0) AS cover FROM u LEFT JOIN a USING (run, label)),
r AS (SELECT *, CASE WHEN rep IS NOT NULL THEN 0 WHEN anchors IS NULL OR overlap >= 2 OR (overlap >= 1 AND cover >= 0.14) THEN 1 ELSE 2 END AS tier FROM j), q AS (SELECT *, row_number() OVER (PARTITION BY run, label ORDER BY tier, CASE WHEN tier = 0 THEN rep END, overlap DESC, cover DESC, weight DESC, id) AS place FROM r)
SELECT run, label, id, place FROM q WHERE place <= least(40, greatest(8, total))""")
def srt_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments as a labelling model is shown them."""
    rows = _ranked(spark, sf_dir).withColumn("tokens", T.token_set(F.col("text"), 4, K.LABEL_STOPWORDS))
    return R.prompt_order(rows, ["run", "label"], "rep", "tokens", "weight").withColumn("place", F.col("place").cast("bigint"))


_SIGNAL = T.whole_word("почему|зачем|как|какой|какая|какие|когда|где|что|кто|можно ли|есть ли|why|how|what|when|where|who|is there|can you")


def question_quality(text: Column, index: Column) -> Column:
    """How well a question stands in a report; later ones count a little less."""
    n = F.size(F.split(text, " "))
    shouted = (text == F.upper(text)) & (text != F.lower(text)) & (F.length(text) > 15)
    flag = lambda c, v: F.when(c, v).otherwise(0.0)
    return flag(F.contains(text, F.lit("?")), 1.2) + F.when(n.between(6, 30), 1.0).when(n < 4, -0.7).otherwise(0.0) + flag(F.lower(text).rlike(_SIGNAL), 0.8) - flag(F.length(text) > 320, 0.6) - flag(shouted, 0.6) - index * 0.04


_CURATED = 5


@query("api_05_report_detail", f"""WITH {TOPICS}, {_REPRESENTED}, z AS (SELECT run, label, id, text, row_number() OVER (PARTITION BY run, label ORDER BY CASE WHEN label % {_CURATED} = 0 THEN 0 ELSE (rep IS NOT NULL)::INT END DESC, CASE WHEN label % {_CURATED} = 0 THEN weight ELSE relevance END DESC, id) AS ord FROM f), y AS (SELECT * FROM z WHERE label % {_CURATED} <> 0 OR ord <= 8),
u AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY run, label, lower(text) ORDER BY ord) = 1), b AS (SELECT *, regexp_matches(text, '[?¿？]') AS asked FROM u), i AS (SELECT *, row_number() OVER (PARTITION BY run, label, asked ORDER BY ord) - 1 AS idx FROM b),
sq AS (SELECT *, round((CASE WHEN contains(text, '?') THEN 1.2::DOUBLE ELSE 0 END) + (CASE WHEN len(string_split(text, ' ')) BETWEEN 6 AND 30 THEN 1.0 WHEN len(string_split(text, ' ')) < 4 THEN -0.7::DOUBLE ELSE 0 END) + (CASE WHEN {like_sql('lower(text)', _SIGNAL)} THEN 0.8::DOUBLE ELSE 0 END) - (CASE WHEN length(text) > 320 THEN 0.6::DOUBLE ELSE 0 END) - (CASE WHEN text = upper(text) AND text <> lower(text) AND length(text) > 15 THEN 0.6::DOUBLE ELSE 0 END) - idx * 0.04::DOUBLE, 6) AS quality FROM i WHERE NOT asked OR NOT {like_sql('lower(text)', A.OFFENSIVE_QUESTION)})
SELECT run, label, asked AS is_question, id, row_number() OVER (PARTITION BY run, label, asked ORDER BY CASE WHEN asked THEN quality END DESC, idx) AS place FROM sq""")
def api_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments and questions of each topic of a report.

    Comments come in the order of the cluster, repeats that differ in case left out; where a briefing
    has curated quotes, here every fifth topic's eight heaviest, they stand instead. Questions are
    ordered by quality, which falls with their place, and offensive ones are left out.
    """
    curated = F.col("label") % _CURATED == 0
    w = W.partitionBy("run", "label")
    order = [F.desc(F.when(curated, 0).otherwise(F.col("rep").isNotNull().cast("int"))), F.desc(F.when(curated, F.col("weight")).otherwise(F.col("relevance"))), F.col("id")]
    m = _ranked(spark, sf_dir).withColumn("ord", F.row_number().over(w.orderBy(*order))).filter(~curated | (F.col("ord") <= 8))
    once = m.groupBy("run", "label", F.lower("text").alias("low")).agg(F.min(F.struct("ord", "id", "text")).alias("x")).select("run", "label", "x.*")
    asked = once.withColumn("is_question", F.col("text").rlike("[?¿？]"))
    at = W.partitionBy("run", "label", "is_question")
    i = asked.withColumn("idx", F.row_number().over(at.orderBy("ord")) - 1).filter(~F.col("is_question") | ~F.lower("text").rlike(A.OFFENSIVE_QUESTION))
    i = i.withColumn("quality", F.when(F.col("is_question"), F.round(question_quality(F.col("text"), F.col("idx")), 6)))
    return i.select("run", "label", "is_question", "id", F.row_number().over(at.orderBy(F.desc("quality"), "idx")).cast("bigint").alias("place"))


@query("lbl_09_uncertain_collapse")
def lbl_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics that stay, and one uncertain topic in place of those that do not."""
    t = quoted(spark, sf_dir).withColumn("label", F.when(F.col("label") % 4 == 3, F.lit("Общая тема выпуска недели")).otherwise(F.col("title")))
    support = F.exists(F.concat("quotes", "questions"), lambda q: F.size(F.array_intersect(R.label_tokens(q), R.label_tokens(F.col("description")))) > 0)
    t = t.withColumns({"tokens": R.label_tokens(F.col("label")), "n_comments": F.size("quotes") + F.size("questions"), "support": support.cast("double"), "low": R.low_coherence(F.col("weighted_share"), F.col("size"), F.col("coherence"))})
    return R.collapsed_uncertain(t.select("run", "key", "label", "tokens", "n_comments", "support", "source", "weighted_share", "low"), "run")
