"""Briefing operators: signals of quotes, priorities, key questions, trends."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions import text as T

# Signals of quotes, whole words of a lower-case text.
TOXIC = T.whole_word("ложь|ненавиж|пропаганд|предател|обман|манипул|туп|идиот|мраз|бред")
FACTUAL = T.whole_word("факт|источник|доказатель|неверн|ошибк|искажен|неправд|неточн")
CONFUSION = T.whole_word("не понял|непонятн|как так|почему|объясни|противореч|неясн")
GENERIC = T.whole_word("faq|вопрос аудитории|отдельный блок faq|дай faq|ответь на вопрос|просто ответь|разбери тему|сделай блок по теме")
QUESTION_START = rf"^(почему|зачем|как|когда|где|кто|что|сколько|разве|неужели|ли)($|{T.NOT_W})"
IMPRACTICAL = T.whole_word("правительств|министер|парламент|генштаб|армия|фронт|военн|реформ|ввести механизм|создать механизм|общественные слушания")


def snippet(c: Column, most: int = 800) -> Column:
    """A quote on one line without outer quotation marks, cut with an ellipsis."""
    t = F.regexp_replace(T.squeezed(c), "^[«»\"']+|[«»\"']+$", "")
    return F.when(F.length(t) > most, F.concat(F.regexp_replace(F.substring(t, 1, most - 1), r"[ ,.;:]+$", ""), F.lit("…"))).otherwise(t)


def question_score(c: Column) -> Column:
    """How well a text serves as the key question of a topic."""
    low, n = F.lower(c), F.length(c)
    hint = low.contains("почему") | low.contains("как") | low.contains("что будет") | low.contains("что делать") | low.contains("зачем")
    return F.when(c.contains("?"), 5).otherwise(0) + F.when(low.rlike(QUESTION_START), 4).otherwise(0) + F.when(n.between(35, 220), 3).when(n.between(20, 320), 1).otherwise(0) + F.when(hint, 2).otherwise(0)


def share_of(quotes: Column, pattern: str) -> Column:
    """Share of the quotes of an array that match; 0 for none."""
    hits = F.size(F.filter(quotes, lambda q: F.lower(q).rlike(pattern)))
    return F.coalesce(F.try_divide(hits, F.size(quotes)), F.lit(0.0))


def misunderstanding(quotes: Column) -> Column:
    """Confidence that the audience disputes facts or does not follow; null below the reporting limits."""
    n = F.size(quotes)
    hits = F.greatest(share_of(quotes, FACTUAL), share_of(quotes, CONFUSION)) * n
    confidence = share_of(quotes, FACTUAL) * 0.6 + share_of(quotes, CONFUSION) * 0.4
    return F.when((n >= 2) & (confidence >= 0.2) & (F.round(hits) >= 2), confidence)


def risk(quotes: Column, sentiment: Column) -> Column:
    """Severity of aggression in the quotes; null below the reporting limits."""
    toxic = share_of(quotes, TOXIC)
    severity = toxic * 0.75 + F.when(sentiment == "negative", 0.25).otherwise(0.0)
    return F.when((severity >= 0.28) & (F.round(toxic * F.size(quotes)) >= 2), severity)


def action_priority(weighted_share: Column, sentiment: Column, quotes: Column, complaints: Column, questions: Column) -> Column:
    n = F.size(quotes)
    hits = F.round(share_of(quotes, TOXIC) * n).cast("int") * 15 + F.round(share_of(quotes, FACTUAL) * n).cast("int") * 20
    return (weighted_share * 100).cast("int") + F.when(sentiment == "negative", 50).when(sentiment == "mixed", 25).otherwise(0) + hits + F.when(complaints >= F.greatest(F.lit(2), questions), 30).otherwise(0)


def summary(label: Column, share: Column, weighted: Column, negative: Column) -> Column:
    mood = F.when(negative >= 35, "напряженный").otherwise("умеренный")
    return F.format_string("%s: %.1f%% комментариев, %.1f%% с учетом веса, тон %s", label, share, weighted, mood)
