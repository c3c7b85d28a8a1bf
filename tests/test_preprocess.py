"""Invariants of preprocessing on small comments."""

from __future__ import annotations

from datetime import datetime

import pytest

from skein.operators import preprocess as P
from skein.settings import Settings

WHEN = datetime(2026, 6, 1)


def run(spark, texts, settings=Settings(), title="Экономика и бюджет страны", **columns):
    rows = [(i, 1, f"c{i}", None, "a", t, columns.get("likes", 0), 0, WHEN, True) for i, t in enumerate(texts)]
    c = spark.createDataFrame(rows, "comment_id bigint, video_id bigint, youtube_comment_id string, parent_comment_id string, author_name string, text_raw string, like_count int, reply_count int, published_at timestamp, is_top_level boolean")
    v = spark.createDataFrame([(1, title, None, WHEN)], "id bigint, title string, description string, published_at timestamp")
    return {r["comment_id"]: r for r in P.preprocess(c, v, settings).collect()}


@pytest.mark.parametrize(
    ("text", "reason"),
    [
        (None, "empty"),
        ("  \n", "empty"),
        ("два слова", "too_short"),
        ("!!! ??? ... ---", "too_short"),
        ("https://a.test/x", "too_short"),
        ("лайк если ты тоже здесь", "low_content"),
        ("слово слово слово слово слово слово", "low_signal"),
        ("ааааааааааа это было очень долго и скучно", "low_signal"),
        ("смотрите https://a.test и https://b.test прямо сейчас друзья", "spam_link"),
        ("подпишись на мой канал и получи подарок скорее", "spam_link"),
        ("ведущий идиот и слушать противно совсем", "profanity_only"),
    ],
)
def test_filter_reasons(spark, text, reason):
    assert run(spark, [text])[0]["filter_reason"] == reason


def test_first_of_duplicates_is_kept_and_heavier(spark):
    text = "Очень подробный рассказ про работу больницы"
    got = run(spark, [text, text.upper(), f"  {text}  ", "Совсем другой рассказ про школьную столовую"])
    assert [got[i]["filter_reason"] for i in range(4)] == [None, "duplicate", "duplicate", None]
    assert got[0]["weight"] == pytest.approx(got[3]["weight"] + 0.36, abs=0.1) and got[1]["weight"] <= 0.5


def test_profanity_with_position_is_flagged(spark):
    got = run(spark, ["ведущий идиот но бюджет страны посчитан верно и подробно"])[0]
    assert got["moderation_action"] == "flag" and not got["is_filtered"]
    hard = run(spark, ["ведущий идиот но бюджет страны посчитан верно и подробно"], Settings(toxicity_policy="hard_delete"))[0]
    assert hard["filter_reason"] == "profanity"


def test_borderline_keeps_its_score(spark):
    got = run(spark, ["какая странная погода сегодня"])[0]
    assert got["moderation_reason"] == "borderline_for_llm" and got["moderation_source"] == "fallback" and 0.35 <= got["moderation_score"] <= 0.55


def test_weight_is_capped_and_repeatable(spark):
    text = "Очень подробный рассказ про работу больницы"
    first, second = run(spark, [text], likes=10_000)[0]["weight"], run(spark, [text], likes=10_000)[0]["weight"]
    assert first == second and 4.0 < first <= 5.0


def test_without_videos(spark):
    c = spark.createDataFrame([(1, 9, "a", "Очень подробный рассказ про работу больницы", None, None, WHEN)], "comment_id bigint, video_id bigint, author_name string, text_raw string, like_count int, reply_count int, published_at timestamp")
    v = spark.createDataFrame([], "id bigint, title string, description string, published_at timestamp")
    assert P.preprocess(c, v).count() == 1
