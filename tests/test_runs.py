"""Answers of models, topics of runs, reviews, quotes and bounded fits: fixtures, brute force and invariants."""

from __future__ import annotations

import json
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.functions import answers, detect
from skein.operators import appeal, benchmark, clusters, fit, models, positions, preprocess, providers
from skein.operators import topic_runs as R
from skein.operators import topics as K


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column(F.col("c")).alias("r")).first()["r"]


def plain(rows):
    return [r.asDict(recursive=True) for r in rows]


# --- answers -----------------------------------------------------------------------------------


GOOD = {"topic": "USA", "score": 8, "short": "«Почему» так.", "depth_score": 7, "question_type": "fact_check"}


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        (json.dumps({"results": {"1": GOOD}}), ("USA", 8, "Почему так?", 7, "fact_check")),
        ("```json\n" + json.dumps({"results": {"1": GOOD}}) + "\n```", ("USA", 8, "Почему так?", 7, "fact_check")),
        ("Ответ: " + json.dumps({"1": GOOD}) + " Готово.", ("USA", 8, "Почему так?", 7, "fact_check")),
        (json.dumps({"results": {"1": {**GOOD, "topic": "Sport", "score": 99, "depth_score": 2}}}), ("Other", 5, "Почему так?", 2, "fact_check")),
        (json.dumps({"results": {"1": {**GOOD, "question_type": "meme_one_liner", "short": "Что??"}}}), ("USA", 3, "Что", 3, "meme_one_liner")),
        (json.dumps({"results": {"1": {"question_type": "new", "score": "x", "depth_score": None}}}), ("Other", 5, None, 0, "clarification_needed")),
        (json.dumps({"results": {"1": {**GOOD, "score": 2}}}), ("USA", 7, "Почему так?", 7, "fact_check")),
    ],
)
def test_refined_questions(spark, answer, want):
    got = plain(one(spark, lambda c: answers.refined(c, 2), answer))
    assert [tuple(r[k] for k in ("topic", "score", "short", "depth_score", "question_type")) for r in got] == [want] and got[0]["number"] == 1


@pytest.mark.parametrize("answer", [None, "", "no", '{"results": {"1": ', "[]", '{"results": {"3": {}}}', '{"results": {"x": {}, "-1": {}, "1": "fact_check"}}'])
def test_answers_without_use_give_nothing(spark, answer):
    assert one(spark, lambda c: answers.refined(c, 2), answer) == []
    assert [r["keep"] for r in one(spark, lambda c: answers.kept(c, 2), answer)] in ([True, True], [False, True])


def test_other_parsers(spark):
    assert plain(one(spark, lambda c: answers.unified(c, 9), '{"results": {"1": "Question: 12", "2": "toxic", "3": "praise:1", "4": "criticism:x", "5": "a:question:2", "10": "toxic"}}')) == [
        {"number": 1, "category": "question", "score": 10}, {"number": 2, "category": "toxic", "score": 0}, {"number": 4, "category": "criticism", "score": 5},
    ]
    assert plain(one(spark, lambda c: answers.targets(c, 3), '{"1": {"target": "guest", "confidence": "1.5"}, "2": {"target": "me"}, "3": 1}')) == [{"number": 1, "target": "guest", "confidence": 1.0, "ok": True}, {"number": 2, "target": "undefined", "confidence": 0.0, "ok": True}]
    assert plain(one(spark, lambda c: answers.precisions(c, 3), '{"results": {"1": 0.9, "2": "sure", "3": -1}}')) == [{"number": 1, "confidence": 0.9}, {"number": 2, "confidence": 0.0}, {"number": 3, "confidence": 0.0}]
    assert [r["keep"] for r in one(spark, lambda c: answers.kept(c, 7), '{"1": false, "2": "No", "3": 0, "4": "keep", "5": null, "6": {}}')] == [False, False, False, True, True, True, True]
    assert [(r["allow_auto_ban"], r["target_confirmed"], r["confidence"]) for r in one(spark, lambda c: answers.verdicts(c, 2), '{"1": {"allow_auto_ban": true, "confidence": 2, "target_confirmed": " AUTHOR"}, "2": {"confidence": "x"}}')] == [(True, "author", 1.0), (False, "undefined", 0.0)]
    for text, want in (("[3, 1]", [3, 1]), ('```json\n[2]\n```', [2]), ('{"numbers": [4, "x", 5.0]}', [4, 5]), ('{"indices": {}}', []), ("", []), (None, None)):
        assert (one(spark, answers.indices, text) or None) == (want or None)


def test_long_summaries_are_cut(spark):
    got = spark.createDataFrame([("слово " * 60, "other"), ("a" * 170, "fact_check"), ("“”", "other"), (None, "fact_check")], "c string, k string").select(answers.short_form(F.col("c"), F.col("k")).alias("r")).collect()
    assert got[0]["r"] == ("слово " * 60)[:157].rstrip() + "…" and got[1]["r"] == "a" * 157 + "…?" and got[2]["r"] is None and got[3]["r"] is None


def test_promotion_and_demotion(spark):
    rows = [(1, "criticism", True, "fact_check", 8), (2, "criticism", True, "meme_one_liner", 3), (3, "criticism", True, None, None), (4, "criticism", False, "fact_check", 8), (5, "question", True, "attack_ragebait", 2), (6, "question", False, "clarification_needed", 5), (7, "question", True, "clarification_needed", 5), (8, "question", False, None, None)]
    df = spark.createDataFrame(rows, "id int, category string, signal boolean, kind string, score int")
    got = {r["id"]: r["category"] for r in appeal.promoted(df, F.col("category"), F.col("signal"), F.col("kind"), F.col("score")).collect()}
    assert got == {1: "question", 2: "criticism", 3: "criticism", 4: "criticism", 5: "criticism", 6: "criticism", 7: "question", 8: "question"}


def test_insult_words_are_complete(spark):
    df = spark.createDataFrame([(w,) for w in ("ебал", "жид", "хачи", "чурка", "нигеры", "черножопый", "долбоёб", "тварь", "твари", "сучий", "бля")], "t string")
    assert df.filter(F.col("t").rlike(appeal.INSULT)).count() == 11


# --- reviews and models ---------------------------------------------------------------------------


def test_reviews_by_failure_class(spark):
    def factory():
        def ask(prompts):
            p = prompts[0]
            if p == "quota":
                raise RuntimeError("Per-run call limit reached")
            if p == "net":
                raise ConnectionError("no route")
            return [p]

        return ask

    drop, odd = '{"action": "drop", "reason_code": "x", "score": 5}', "what?"
    rows = [(1, 1, drop), (1, 2, "net"), (1, 3, odd), (1, 4, '{"action":"keep"}'), (1, 5, drop), (2, 11, drop), (2, 12, "quota"), (2, 13, drop), (2, 14, "net")]
    df = spark.createDataFrame(rows, "video int, id int, prompt string")
    got = {r["id"]: (r["action"], r["reason"], r["source"]) for r in models.reviewed(df, "video", "id", "prompt", factory, 4).collect()}
    assert got == {
        1: ("drop", "x", "llm"), 2: ("flag", "llm_error_fallback", "fallback"), 3: ("flag", "llm_invalid_fallback", "llm"), 4: ("keep", "llm_invalid_fallback", "llm"), 5: ("flag", "llm_review_cap_fallback", "fallback"),
        11: ("drop", "x", "llm"), **{i: ("flag", "llm_max_calls_fallback", "fallback") for i in (12, 13, 14)},
    }


def test_model_positions_cover_each_comment_once(spark):
    r = np.random.default_rng(2)
    rows = [(t, i, f"t{i}", float(100 - i), [float(x) for x in r.normal(size=4)]) for t in (1, 2, 3) for i in range(t * 100, t * 100 + (30 if t < 3 else 3))]
    df = spark.createDataFrame(rows, "topic int, id int, text string, weight double, v array<double>")

    def factory():
        def ask(prompts):
            if "t200" in prompts[0]:
                raise TimeoutError
            return ['{"positions": [{"members": [1, 2, 3, 99, "4"]}, {"members": [3, 4]}, {"members": "all"}, 7]}']

        return ask

    got = models.model_positions(df, ["topic"], factory, shown=20).collect()
    assert Counter(x["topic"] for x in got) == {1: 30, 2: 30, 3: 3} and len({x["id"] for x in got}) == 63
    first = {x["id"]: x["position"] for x in got if x["topic"] == 1}
    assert [first[100 + i] for i in range(5)] == ["position_1"] * 3 + ["position_2", "undetermined"]
    assert {p for i, p in first.items() if i >= 120} <= {"position_1", "position_2", "undetermined"}


def test_second_titles_are_asked_for_twice(spark):
    def factory():
        return lambda prompts: ['{"title": "Зрители ждут честный разбор"}' if p.startswith("Повтор") or p == "good" else '{"title": "да"}' for p in prompts]

    df = spark.createDataFrame([(1, "good", "a"), (2, "bad", "b"), (3, "other", "c")], "id int, prompt string, title string")
    got = {r["id"]: (r["title"], r["renamed"]) for r in models.retitled(df, df.filter("id < 3"), "id", "prompt", factory).collect()}
    assert got == {1: ("Зрители ждут честный разбор", True), 2: ("Зрители ждут честный разбор", True), 3: ("c", False)}


def test_halving_gives_the_same_vectors():
    whole = providers.hashing_embedder()
    seen = []

    def tight(texts):
        seen.append(len(texts))
        if len(texts) > 3:
            raise MemoryError
        return whole(texts)

    texts = [f"слово {i}" for i in range(17)]
    assert np.array_equal(providers.halving(tight, 8)(texts), whole(texts)) and max(s for s in seen) == 8
    with pytest.raises(MemoryError):
        providers.halving(lambda t: (_ for _ in ()).throw(MemoryError()), 4)(["x"])


# --- topics of runs ----------------------------------------------------------------------------------


def test_merge_decisions(spark):
    rows = [
        ("тарифы жкх растут", "тарифы жкх растут снова", "", "", 5.0, 5.0, [1.0, 0.0], [1.0, 0.05], True),
        ("тарифы жкх растут", "тарифы жкх растут снова", "", "", 5.0, 5.0, [1.0, 0.0], [0.0, 1.0], False),
        ("спор ведущего", "погода весной", "", "", 9.0, 9.0, [1.0, 0.0], [1.0, 0.0], False),
        ("Суд и приговор", "суд и приговор", "", "", 9.0, 9.0, [1.0, 0.0], [1.0, 0.45], True),
    ]
    df = spark.createDataFrame(rows, "label_a string, label_b string, description_a string, description_b string, weighted_share_a double, weighted_share_b double, centroid_a array<double>, centroid_b array<double>, want boolean")
    assert all(r["merge"] == r["want"] for r in R.merged_decision(df).collect())


def test_labels_and_lists(spark):
    pick = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string").select(R.picked_label(F.col("a"), F.col("b")).alias("r")).first()["r"]
    assert pick("", "два слова") == "два слова" and pick("один", None) == "один"
    assert pick("рост тарифов жилищных услуг", "рост тарифов жилищных") == "рост тарифов жилищных" and pick("рост тарифов", "суд и приговор") == "рост тарифов"
    emotions = spark.createDataFrame([(["Гнев ", "страх"], 3.4, ["страх", "радость"], 2.5)], "a array<string>, wa double, b array<string>, wb double").select(R.merged_emotions(F.col("a"), F.col("wa"), F.col("b"), F.col("wb")).alias("r")).first()["r"]
    assert emotions == ["страх", "гнев"]
    acts = spark.createDataFrame([(["лайк", "Дайте ответ на каждый вопрос", "дайте ответ на каждый вопрос", "Закрепите ответ под этим выпуском", "реформ не будет никогда тут"], ["запас"])], "a array<string>, f array<string>").select(R.sanitized_actions(F.col("a"), F.col("f")).alias("r")).first()["r"]
    assert acts == ["Дайте ответ на каждый вопрос", "Закрепите ответ под этим выпуском"]


def test_uncertain_topics_become_one(spark):
    rows = [
        (1, "a", "Рост тарифов", ["рост", "тарифов"], 9, 0.5, "comment_topic", 40.0, False), (1, "b", "рост тарифов ", ["рост", "тарифов"], 2, 0.5, "comment_topic", 30.0, False), (1, "c", "Суд", ["судья"], 0, 0.5, "comment_topic", 20.0, False),
        (1, "d", "Кино", ["кино"], 5, 0.0, "comment_topic", 10.0, True), (2, "e", "Кино", ["кино"], 5, 0.0, "comment_topic", 10.0, False),
    ]
    df = spark.createDataFrame(rows, "run int, key string, label string, tokens array<string>, n_comments int, support double, source string, weighted_share double, low boolean")
    got = {(r["run"], r["key"]): (r["label"], r["collapsed"]) for r in R.collapsed_uncertain(df, "run").collect()}
    assert got == {(1, "a"): ("Рост тарифов", False), (1, "d"): (R.UNCERTAIN, True), (2, "e"): ("Кино", False)}


def test_prompt_order_puts_near_comments_before_the_rest(spark):
    rows = [(1, 1, "тарифы растут каждый месяц", 1, 1.0), (1, 2, "погода весной", None, 9.0), (1, 3, "тарифы снова растут", None, 2.0), (1, 4, "ТАРИФЫ растут каждый месяц", None, 8.0), (1, 5, "тарифы", None, 1.0)]
    df = spark.createDataFrame(rows, "topic int, id int, text string, rep int, weight double").withColumn("tokens", K.T.token_set(F.col("text"), 4, K.LABEL_STOPWORDS))
    got = [r["id"] for r in R.prompt_order(df, ["topic"], "rep", "tokens", "weight").orderBy("place").collect()]
    assert got == [1, 3, 5, 2]


def test_composite_score(spark):
    df = spark.createDataFrame([(0.82, 14.0, 30.0, 7.0, 1.0)], "a double, b double, c double, d double, e double")
    got = df.select(benchmark.composite_score(*map(F.col, "abcde")).alias("r")).first()["r"]
    assert got == pytest.approx(0.82 * 45 + 86 * 0.35 + 70 * 0.1 + 7 * 0.8 - 1.5, abs=1e-3)


def test_language_of_comments(spark):
    texts = {"Это не так, и вы знаете почему": "ru", "Це не так, і ви знаєте чому": "uk", "This is not what you said about it": "en", "Das ist nicht so, und ihr wisst es": "de", "No es así, y lo sabes muy bien": "es", "12345 👍": None, "": None}
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    assert {r["t"]: r["r"] for r in df.select("t", detect.detected(F.col("t")).alias("r")).collect()} == {**texts, None: None}


# --- hot groups ---------------------------------------------------------------------------------------


def test_one_text_on_half_the_rows(spark):
    rows = [(i, 1 if i % 4 else None, "same" if i % 2 else f"t{i}", i % 7 == 0) for i in range(1, 2001)]
    df = spark.createDataFrame(rows, "comment_id bigint, video_id bigint, text_hash string, dropped boolean")
    for most in (10, 10_000):
        out = preprocess.with_repeats(df, ["video_id", "text_hash"], "comment_id", ~F.col("dropped"), most=most)
        got = {r["comment_id"]: (r["first_id"], r["copies"]) for r in out.collect()}
        groups = defaultdict(list)
        for i, v, h, d in rows:
            if not d:
                groups[v, h].append(i)
        for i, v, h, d in rows:
            g = groups.get((v, h), [])
            assert got[i] == ((min(g), len(g)) if not d and len(g) > 1 else (None, None))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "Window" not in plan


def test_groups_above_the_limit_are_fitted_on_a_sample(spark):
    r = np.random.default_rng(4)
    rows = [(g, g * 1000 + i, [float(x) for x in np.eye(8)[i % 2] + 0.05 * r.normal(size=8)]) for g, n in ((1, 200), (2, 30)) for i in range(n)]
    df = spark.createDataFrame(rows, "g int, id int, v array<double>")
    got = fit.fit_clusters(df, "g", most=60).collect()
    assert len(got) == len({x["id"] for x in got}) == 230
    whole = {x["id"]: x["cluster_key"] for x in fit.fit_clusters(df.filter("g = 2"), "g").collect()}
    assert {x["id"]: x["cluster_key"] for x in got if x["g"] == 2} == whole
    sides = defaultdict(set)
    for x in got:
        if x["g"] == 1 and x["cluster_key"]:
            sides[x["cluster_key"]].add(x["id"] % 2)
    assert sides and all(len(s) == 1 for s in sides.values()) and sum(x["cluster_key"] is not None for x in got) >= 220
    topics = df.withColumnRenamed("g", "topic").withColumn("video", F.lit(1))
    placed = positions.assigned_positions(topics, "video", "topic", most=50).collect()
    assert len(placed) == len({x["id"] for x in placed}) == 230
    pairs = defaultdict(set)
    for x in placed:
        if x["position"] != "undetermined":
            pairs[x["topic"], x["position"]].add(x["id"] % 2)
    assert all(len(s) == 1 for s in pairs.values())


def test_quotes_are_found_as_by_comparing_all(spark):
    r = random.Random(6)
    words = ["налог", "выпуск", "какой-то", "сервер", "не", "и", "тариф", "суд", "гость", "почему"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    comments = [(g, i + 100 * g, r.randrange(5), text(r.randint(1, 14))) for g in (1, 2) for i in range(60)] + [(1, 999, 0, None), (1, 998, 0, "")]
    quotes = []
    for k in range(150):
        g, _, _, t = r.choice([c for c in comments if c[3]])
        a = r.randrange(max(1, len(t) // 3))
        form = r.random()
        quotes.append((g, k, t if form < 0.3 else t[a : a + r.randint(10, 60)] if form < 0.6 else t[a:].replace(" ", ", ").upper() if form < 0.8 else text(6)))
    q = spark.createDataFrame([*quotes, (1, 500, None), (1, 501, " ")], "g int, quote_id int, quote string")
    c = spark.createDataFrame(comments, "g int, comment_id int, rank int, text string")
    got = {x["quote_id"]: (x["comment_id"], x["tier"]) for x in K.matched_quotes(q, c, ["g"]).collect()}
    norm = lambda s: " ".join(s.split()).lower()
    bare = lambda s: "".join(ch for ch in s if ch.isalnum())
    want = {}
    for g, k, s in quotes:
        a = norm(s)
        best = None
        for h, i, rank, t in comments:
            if h != g or not t:
                continue
            b = norm(t)
            tier = 0 if a == b else 1 if len(a) >= 26 and a in b else 2 if len(bare(a)) >= 22 and bare(a) in bare(b) else None
            if tier is not None and (best is None or (tier, rank, i) < best):
                best = (tier, rank, i)
        if best:
            want[k] = (best[2], best[0])
    assert got == want


def test_quantile_of_many_rows_equals_sorting(spark):
    r = np.random.default_rng(9)
    rows = [(g, round(float(x), 6)) for g, n in ((1, 7), (2, 25), (3, 60), (4, 500)) for x in r.uniform(-1, 1, n)]
    got = {x["g"]: (x["n"], x["threshold"]) for x in clusters.quantile_floor(spark.createDataFrame(rows, "g int, x double"), ["g"], "x").collect()}
    for g in (1, 2, 3, 4):
        v = sorted(x for h, x in rows if h == g)
        n = len(v)
        q, low = next((q, low) for least, q, low in ((80, 0.65, 0.52), (40, 0.55, 0.50), (20, 0.45, 0.47), (0, 0.30, 0.42)) if n >= least)
        assert got[g] == (n, max(low, v[int(np.rint((n - 1) * q))]))
