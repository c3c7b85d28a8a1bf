"""Topics of a run: merge decisions, labels, actions, notes, watchdog, and the lists of a briefing.

A run has a dozen topics at most; plans hold the topics of all runs at once, keyed by the run.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions import vectors as V
from skein.operators import briefing as B
from skein.operators import topics as K
from skein.settings import DEFAULT, Settings

UNCERTAIN = "Разное / Неопределенные комментарии"
# Marks of labels that say little.
WEAK_LABELS = ("новая тема", "тема комментариев", "комментарии", "обсуждение", "позиция аудитории")
# Words of actions that an author can take, of those nobody can, and of those that say nothing.
UNREALISTIC = T.whole_word("правительств|президент|парламент|министер|департамент|закон|реформ|госпрограмм|генштаб|армия|армии|армией|фронт|батальон|бригада|военн|командир|командован|ввести механизм|создать механизм|система мониторинга|общественные слушания|audit of military strategy|military strategy|commander|government|ministry|policy reform")
PRACTICAL = T.whole_word("выпуск|ролик|видео|интро|подводк|описани|таймкод|глав|цитат|источник|ссылк|уточн|объясн|ответ|вопрос|faq|закреп|комментар|опрос|тезис|формулировк|превью|заголов|структур|блок|раздел|сегмент|плашк|корректировк")
WEAK_ACTION = "^(like|dislike|comment|share|subscribe|liking|sharing|commenting|reaction|engagement|лайк|дизлайк|коммент|комментарий|комментарии|подпишись|подписка|репост|шэр)$"


def label_tokens(label: Column) -> Column:
    """Different words of four letters and more, without stopwords."""
    return T.token_set(label, 4, K.STOPWORDS)


def weak_topic(label: Column, description: Column, positions: Column) -> Column:
    """Whether a topic is worth another name: short, generic or failed labels, or a thin description over three positions."""
    t = F.lower(T.squeezed(F.coalesce(label, F.lit(""))))
    generic = F.lit(False)
    for mark in WEAK_LABELS:
        generic = generic | F.contains(t, F.lit(mark))
    return (F.size(F.split(t, " ")) < 2) | (t == UNCERTAIN.lower()) | F.startswith(t, F.lit("[ошибка]")) | generic | ((positions >= 3) & ~K.detailed(F.coalesce(description, F.lit(""))))


def low_coherence(weighted_share: Column, size: Column, coherence: Column, s: Settings = DEFAULT) -> Column:
    """Whether a small incoherent cluster is collapsed."""
    return (weighted_share < s.low_coherence_share) & (size < max(20, 3 * s.cluster_min_size)) & (coherence < s.coherence_min)


def merged_decision(pairs: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Pairs of topics (columns label_a, label_b, description_, weighted_share_ and centroid_ of both) with cos, jaccard and merge."""
    la, lb = label_tokens(F.col("label_a")), label_tokens(F.col("label_b"))
    p = pairs.withColumns({"la": la, "lb": lb, "cos": V.cosine(F.col("centroid_a"), F.col("centroid_b"))})
    p = p.withColumns({"jaccard": T.jaccard(F.col("la"), F.col("lb")), "described": T.jaccard(label_tokens(F.col("description_a")), label_tokens(F.col("description_b")))})
    j, cos = F.col("jaccard"), F.col("cos")
    least = max(1, s.topic_subset_tokens)
    subset = (F.size("la") >= least) & (F.size("lb") >= least) & ((F.size(F.array_except("la", "lb")) == 0) | (F.size(F.array_except("lb", "la")) == 0))
    a, b = F.lower(T.stripped(F.col("label_a"))), F.lower(T.stripped(F.col("label_b")))
    contains = F.contains(a, b) | F.contains(b, a)
    near, alike = max(0.90, s.topic_merge_cosine), max(0.42, s.topic_merge_jaccard, 0.34)
    both_large = F.least("weighted_share_a", "weighted_share_b") >= s.low_coherence_share
    merge = ((cos >= min(0.98, near + 0.04)) & (j >= alike)) | (subset & (j >= 0.34) & (cos >= near)) | (contains & (j >= 0.38) & (cos >= near)) | ((j >= 0.62) & (cos >= 0.90)) | ((F.col("described") >= 0.45) & (j >= 0.38) & (cos >= 0.92))
    return p.withColumn("merge", ~(both_large & (j < 0.42)) & merge).drop("la", "lb", "described")


def picked_label(primary: Column, secondary: Column) -> Column:
    """The primary label, unless it is blank or the secondary says nearly the same in less."""
    a, b = T.squeezed(F.coalesce(primary, F.lit(""))), T.squeezed(F.coalesce(secondary, F.lit("")))
    shorter = (T.jaccard(label_tokens(a), label_tokens(b)) >= 0.6) & (F.length(b) < F.length(a))
    return F.when(a == "", b).when(b == "", a).when(shorter, b).otherwise(a)


def merged_sentiment(a: Column, wa: Column, b: Column, wb: Column) -> Column:
    score = lambda c: F.when(c == "positive", 1.0).when(c == "negative", -1.0).otherwise(0.0)
    wa, wb = F.greatest(F.lit(0.01), wa), F.greatest(F.lit(0.01), wb)
    mean = (score(a) * wa + score(b) * wb) / (wa + wb)
    return F.when(mean >= 0.15, "positive").when(mean <= -0.15, "negative").otherwise("neutral")


def weighted_mean(a: Column, na: Column, b: Column, nb: Column, digits: int) -> Column:
    na, nb = F.greatest(F.lit(1), na), F.greatest(F.lit(1), nb)
    return F.round((a * na + b * nb) / F.greatest(F.lit(1), na + nb), digits)


def merged_emotions(a: Column, wa: Column, b: Column, wb: Column) -> Column:
    """The two heaviest tags of two topics, each weighing its topic's rounded share; the first topic's win ties."""

    def tagged(tags: Column, w: Column, side: int) -> Column:
        low = F.filter(F.transform(tags, lambda t: F.lower(T.stripped(t))), lambda t: t != "")
        return F.transform(low, lambda t, i: F.struct(t.alias("t"), F.greatest(F.lit(1), F.rint(w)).cast("int").alias("w"), (i + side * 1000).alias("at")))

    every = F.concat(tagged(a, wa, 0), tagged(b, wb, 1))
    names = F.array_distinct(F.transform(every, lambda e: e["t"]))
    sums = F.transform(names, lambda n, i: F.struct(F.aggregate(F.filter(every, lambda e: e["t"] == n), F.lit(0), lambda acc, e: acc + e["w"]).alias("w"), (-i).alias("at"), n.alias("t")))
    return F.transform(F.slice(F.sort_array(sums, asc=False), 1, 2), lambda x: x["t"])


def distinct_folded(items: Column) -> Column:
    """Items on one line, without blanks and repeats that differ in case only, in their order."""
    lines = F.filter(F.transform(items, T.squeezed), lambda x: x != "")
    low = F.transform(lines, F.lower)
    return F.filter(lines, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def soft_notes(confidence: Column, ambiguous: Column, size: Column, s: Settings = DEFAULT) -> Column:
    """Notes about how surely comments were assigned."""
    notes = F.array(
        F.when(confidence > 0, F.format_string("Средняя уверенность распределения комментариев: %.2f", F.round(confidence.cast("double"), 2))),
        F.when(ambiguous > 0, F.format_string("Пограничных комментариев: %d/%d", ambiguous.cast("int"), size.cast("int"))),
    )
    return F.slice(F.array_compact(notes), 1, s.note_limit)


def practical(action: Column) -> Column:
    """Whether an author can take the action at once: four words, realistic, about the show."""
    t = F.lower(T.squeezed(action))
    return (t != "") & (F.size(F.split(t, " ")) >= 4) & ~t.rlike(UNREALISTIC) & t.rlike(PRACTICAL)


def sanitized_actions(raw: Column, fallback: Column, most: int = 50) -> Column:
    """Practical actions without repeats; those of the rule where fewer than two remain."""
    own = F.filter(F.transform(raw, T.squeezed), lambda a: (a != "") & ~F.lower(a).rlike(WEAK_ACTION) & practical(a))
    base = F.when(F.size(own) < 2, fallback).otherwise(own)
    low = F.transform(base, F.lower)
    good = F.filter(base, lambda a, i: (F.array_position(low, F.lower(a)) == i + 1) & practical(a))
    rest = F.filter(fallback, practical)
    return F.slice(F.transform(F.when(F.size(good) > 0, good).otherwise(rest), T.stripped), 1, most)


def sanitized_quotes(raw: Column, fallback: Column, most: int = 8) -> Column:
    own = F.filter(F.transform(F.coalesce(raw, F.array().cast("array<string>")), T.squeezed), lambda q: q != "")
    return F.slice(distinct_folded(F.when(F.size(own) > 0, own).otherwise(fallback)), 1, most)


def normalized_description(raw: Column) -> Column:
    """One line; a JSON list of texts becomes its first three, as sentences."""
    t = T.squeezed(F.coalesce(raw, F.lit("")))
    items = F.filter(F.transform(F.from_json(t, "array<string>"), T.squeezed), lambda x: x != "")
    listed = F.startswith(t, F.lit("[")) & F.endswith(t, F.lit("]")) & (F.coalesce(F.size(items), F.lit(0)) > 0)
    return F.when(listed, F.array_join(F.slice(items, 1, 3), ". ")).otherwise(t)


def extended_description(description: Column, fallback: Column, least: int = 80) -> Column:
    """A short description is followed by the rule's, unless it holds it already."""
    a, b = T.squeezed(F.coalesce(description, F.lit(""))), T.squeezed(F.coalesce(fallback, F.lit("")))
    ended = F.when(a.rlike("[.!?]$"), a).otherwise(F.concat(a, F.lit(".")))
    return F.when(F.length(a) >= least, a).when(b == "", a).when(a == "", b).when(F.contains(F.lower(a), F.lower(b)), a).otherwise(F.concat(ended, F.lit(" "), b))


def sanitized_label(raw: Column, fallback: Column, matched: Column) -> Column:
    """The label of an answer, which may be a text, a JSON list or an object with text or title; else the
    matched topic of the episode, else the rule's."""
    t = F.trim(F.coalesce(raw, F.lit("")))
    from_list = F.get(F.from_json(F.when(F.startswith(t, F.lit("[")), t), "array<string>"), F.lit(0))
    from_object = F.when(F.startswith(t, F.lit("{")), F.coalesce(F.get_json_object(t, "$.text"), F.get_json_object(t, "$.title"), F.lit("")))
    label = T.squeezed(F.coalesce(from_object, from_list, t))
    return F.when(F.length(label) >= 2, label).when(F.coalesce(F.length(matched), F.lit(0)) > 0, T.squeezed(matched)).otherwise(fallback)


def pct(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole * 100.0).otherwise(0.0)


def watchdog(undetermined: Column, fallback: Column, s: Settings = DEFAULT) -> Column:
    """Reasons for which a run counts as degraded, none for a sound one."""
    u, f = s.watchdog_undetermined, s.watchdog_fallback
    return F.array_compact(F.array(
        F.when(undetermined > u, F.format_string(f"undetermined_comment_share>{u:.1f}%% (%.2f%%)", F.round(undetermined, 2))),
        F.when(fallback > f, F.format_string(f"fallback_title_rate>{f:.1f}%% (%.2f%%)", F.round(fallback, 2))),
    ))


def starved(fallback: Column, calls: Column, topics: Column) -> Column:
    """Whether the labelling model had too few calls: many fallback titles, or fewer than max(3, half the topics) calls."""
    return (fallback > 65.0) | (calls < F.greatest(F.lit(3), F.ceil(topics / 2)))


def harmonized(topics: DataFrame, episodes: DataFrame, run: str) -> DataFrame:
    """Topics (``run``, key, label, description, source) with the label and source of the episode topic that they are about.

    ``episodes`` (``run``, ord, title) travel as one array a run. The best title wins by overlap or cover, the first of equals.
    """
    titles = episodes.withColumn("t", label_tokens(F.col("title"))).filter(F.size("t") > 0)
    titles = titles.groupBy(run).agg(F.array_sort(F.collect_list(F.struct("ord", F.struct(T.squeezed(F.col("title")).alias("title"), "t").alias("e")))).alias("titles"))
    j = topics.join(titles, run, "left").withColumn("own", label_tokens(F.concat_ws(" ", "label", "description")))

    def score(e: Column) -> Column:
        jaccard, cover = T.jaccard(F.col("own"), e["e"]["t"]), F.size(F.array_intersect("own", e["e"]["t"])) / F.greatest(F.lit(1), F.size(e["e"]["t"]))
        return F.struct(F.greatest(jaccard, cover).alias("score"), (-e["ord"]).alias("neg"), jaccard.alias("jaccard"), cover.alias("cover"), e["e"]["title"].alias("title"))

    j = j.withColumn("best", F.array_max(F.transform("titles", score)))
    about = (F.col("source") != "episode_topic") & (F.size("own") > 0) & (F.col("best.score") > 0) & ((F.col("best.jaccard") >= 0.55) | (F.col("best.cover") >= 0.72))
    about = F.coalesce(about, F.lit(False))
    return j.select(run, "key", F.when(about, picked_label(F.col("best.title"), F.col("label"))).otherwise(F.col("label")).alias("label"), F.when(about, "episode_topic").otherwise(F.col("source")).alias("source"))


# --- briefing ------------------------------------------------------------------------------------


def picked_action(actions: Column) -> Column:
    """The first action that is neither generic nor out of the author's hands; the empty text if there is none."""
    lines = F.transform(actions, lambda a: B.snippet(a, 260))
    good = F.filter(lines, lambda a: (a != "") & ~F.lower(a).rlike(B.GENERIC) & ~F.lower(a).rlike(B.IMPRACTICAL))
    return F.coalesce(F.get(good, F.lit(0)), F.lit(""))


def key_question(questions: Column, quotes: Column) -> Column:
    """The text that serves best as the topic's question, the first of equals; the empty text if none does."""
    lines = F.filter(F.transform(F.concat(questions, quotes), lambda q: B.snippet(q)), lambda q: q != "")
    scored = F.filter(F.transform(lines, lambda q, i: F.struct(B.question_score(q).alias("score"), (-i).alias("neg"), q.alias("q"))), lambda x: x["score"] > 0)
    return F.coalesce(F.array_max(scored)["q"], F.lit(""))


def hits(quotes: Column, pattern: str) -> Column:
    return F.transform(F.filter(quotes, lambda q: F.lower(q).rlike(pattern)), lambda q: B.snippet(q))


def misunderstanding_line(label: Column, quotes: Column) -> Column:
    """Struct of confidence and message; null where the audience neither disputes facts nor loses the thread."""
    n, facts, lost = F.size(quotes), hits(quotes, B.FACTUAL), hits(quotes, B.CONFUSION)
    f, c = F.size(facts) / F.greatest(F.lit(1), n), F.size(lost) / F.greatest(F.lit(1), n)
    confidence = f * 0.6 + c * 0.4
    example = F.coalesce(F.get(facts, F.lit(0)), F.get(lost, F.lit(0)))
    message = F.when(f >= c, F.format_string("Тема «%s»: аудитория спорит с фактурой (%d/%d сильных сигналов). Пример: «%s».", label, F.size(facts), n, example)).otherwise(
        F.format_string("Тема «%s»: аудитория не понимает ход аргументации (%d/%d сильных сигналов). Пример: «%s».", label, F.size(lost), n, example)
    )
    return F.when((n >= 2) & (confidence >= 0.2) & (F.greatest(F.size(facts), F.size(lost)) >= 2), F.struct(confidence.alias("value"), message.alias("message")))


def risk_line(label: Column, quotes: Column, sentiment: Column) -> Column:
    """Struct of severity and message; null where the tone of the quotes is no risk."""
    n, bad = F.size(quotes), hits(quotes, B.TOXIC)
    severity = F.size(bad) / F.greatest(F.lit(1), n) * 0.75 + F.when(sentiment == "negative", 0.25).otherwise(0.0)
    example = F.get(bad, F.lit(0))
    message = F.when(severity >= 0.55, F.format_string("Тема «%s»: высокий риск агрессивной эскалации (%d/%d репрезентативных цитат). Пример: «%s».", label, F.size(bad), n, example)).otherwise(
        F.format_string("Тема «%s»: заметен конфликтный тон (%d/%d цитат с агрессивной формулировкой). Пример: «%s».", label, F.size(bad), n, example)
    )
    return F.when((n > 0) & (severity >= 0.28) & (F.size(bad) >= 2), F.struct(severity.alias("value"), message.alias("message")))


def top_lines(topics: DataFrame, run: str, line: Column, most: int = 4) -> DataFrame:
    """Columns ``run``, place, message: the highest ``most`` lines of each run, equal ones in the order of the topics' shares."""
    found = topics.withColumn("line", line).filter(F.col("line").isNotNull())
    place = F.row_number().over(W.partitionBy(run).orderBy(F.desc("line.value"), F.desc("weighted_share"), "key"))
    return found.withColumn("place", place).filter(F.col("place") <= most).select(run, "place", F.col("line.message").alias("message"))


def action_items(topics: DataFrame, run: str) -> DataFrame:
    """Columns ``run``, key, label, share_pct, priority, action, key_question, place: all topics by priority; a run without topics is not there.

    ``topics`` has label, share_pct, weighted_share, sentiment, quotes, questions, actions, intents.
    """
    count = lambda name: F.coalesce(F.try_element_at("intents", F.lit(name)), F.lit(0))
    bad = F.size(F.filter("quotes", lambda q: F.lower(q).rlike(B.TOXIC))) * 15 + F.size(F.filter("quotes", lambda q: F.lower(q).rlike(B.FACTUAL))) * 20
    mood = F.when(F.col("sentiment") == "negative", 50).when(F.col("sentiment") == "mixed", 25).otherwise(0)
    complaints = F.when(count("complaint") >= F.greatest(F.lit(2), count("question")), 30).otherwise(0)
    items = topics.select(
        run, "key", F.coalesce(F.nullif(T.squeezed(F.col("label")), F.lit("")), F.lit("текущая тема")).alias("label"), "share_pct", "weighted_share",
        ((F.col("weighted_share") * 100).cast("int") + mood + bad + complaints).alias("priority"), picked_action(F.col("actions")).alias("action"), key_question(F.col("questions"), F.col("quotes")).alias("key_question"),
    )
    place = F.row_number().over(W.partitionBy(run).orderBy(F.desc("priority"), F.desc("weighted_share"), "key"))
    return items.withColumn("place", place).drop("weighted_share")


def executive_summary(topics: DataFrame, run: str) -> DataFrame:
    """Columns ``run``, summary: the dominant topic and the mood."""
    first = F.max_by(F.struct("label", "share_pct", "weighted_share"), F.struct("weighted_share", F.col("key"))).alias("top")
    g = topics.groupBy(run).agg(first, F.sum(F.when(F.col("sentiment") == "negative", F.col("share_pct")).otherwise(0.0)).alias("negative"))
    text = F.format_string(
        "Главный фокус аудитории: «%s» (%.1f%% комментариев, %.1f%% с учетом веса). Общий тон дискуссии: %s. Перед следующим выпуском важно закрыть претензии, которые чаще всего повторяются в топ-темах.",
        "top.label", F.round("top.share_pct", 1), F.round("top.weighted_share", 1), F.when(F.col("negative") >= 35, "напряженный").otherwise("умеренный"),
    )
    return g.select(run, text.alias("summary"))


# --- order-dependent post-processing ---------------------------------------------------------------


def _jaccard(a: set[str], b: set[str]) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def collapsed_uncertain(topics: DataFrame, run: str, s: Settings = DEFAULT) -> DataFrame:
    """Columns ``run``, key, label, collapsed: topics by falling share; those that are incoherent, empty or repeat
    an earlier label become one uncertain topic, which takes the key of the one with the least share.

    ``topics`` has label, tokens, n_comments, support, source, weighted_share, low (from ``low_coherence``).
    The choice depends on the order, so one task reads the dozen topics of one run.
    """

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["weighted_share", "key"], ascending=[False, True])
        seen: list[set[str]] = []
        labels: set[str] = set()
        bad = []
        for r in part.itertuples():
            own = set(r.tokens)
            near = any(_jaccard(own, other) >= 0.5 for other in seen)
            name = r.label.strip().lower()
            least = s.uncertain_min_comments
            drop = r.low or r.n_comments < least or (name in labels and r.n_comments <= max(3, least + 2)) or (near and r.source == "comment_topic" and r.n_comments <= max(2, least + 1)) or (near and r.support < s.uncertain_support and r.n_comments <= 2)
            bad.append(drop)
            if not drop:
                seen.append(own)
                if name:
                    labels.add(name)
        part = part.assign(collapsed=bad)
        kept = part[~part["collapsed"]][[run, "key", "label", "collapsed"]]
        gone = part[part["collapsed"]].sort_values(["weighted_share", "key"]).head(1)
        return pd.concat([kept, gone.assign(label=UNCERTAIN)[[run, "key", "label", "collapsed"]]])

    kind = dict(topics.dtypes)
    return topics.groupBy(run).applyInPandas(fold, f"{run} {kind[run]}, key string, label string, collapsed boolean")


def prompt_order(rows: DataFrame, keys: Sequence[str], representative: str, tokens: str, weight: str) -> DataFrame:
    """Columns ``keys``, id, place: the comments of each cluster as a model is shown them.

    Representatives (by their rank, null for others) come first; then comments that share two words
    with them, or one of every seven of their own words, by overlap, cover and weight; then the rest
    in the same order; repeats that differ in case are left out; clamp(n, 8, 40) of n comments stay.
    """
    w = W.partitionBy(*keys)
    total = F.count(F.lit(1)).over(w)
    first = F.row_number().over(W.partitionBy(*keys, F.lower("text")).orderBy(F.col(representative).asc_nulls_last(), F.desc(weight), "id"))
    once = rows.withColumn("n", total).withColumn("first", first).filter("first = 1")
    anchors = once.filter(F.col(representative).isNotNull()).select(*keys, F.explode(tokens).alias("t")).groupBy(*keys).agg(F.collect_set("t").alias("anchors"))  # words of 30 comments at most
    j = once.join(anchors, list(keys), "left")
    overlap = F.coalesce(F.size(F.array_intersect(tokens, "anchors")), F.lit(0))
    cover = F.coalesce(F.try_divide(overlap, F.size(tokens)), F.lit(0.0))
    near = F.col("anchors").isNull() | (overlap >= 2) | ((overlap >= 1) & (cover >= 0.14))
    tier = F.when(F.col(representative).isNotNull(), 0).when(near, 1).otherwise(2)
    order = [tier, F.when(tier == 0, F.col(representative)), overlap.desc(), cover.desc(), F.desc(weight), F.col("id")]
    placed = j.withColumn("place", F.row_number().over(w.orderBy(*order)))
    return placed.filter(F.col("place") <= F.least(F.lit(40), F.greatest(F.lit(8), F.col("n")))).select(*keys, "id", "place")
