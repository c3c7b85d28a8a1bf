"""Fitted clusters, greedy text operators, relational helpers, parsing, sources, sinks, models, streams."""

from __future__ import annotations

import json
from datetime import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.functions import parsing, text, vectors
from skein.operators import appeal, clusters, fit, providers, relational, topics
from skein.sources import landing, sinks
from skein.streaming import events

R = np.random.default_rng(1)


def blobs(*sizes, dims=8, spread=0.05):
    centers = np.eye(dims)[: len(sizes)]
    return np.vstack([c + spread * R.normal(size=(n, dims)) for c, n in zip(centers, sizes, strict=True)])


# --- clusters ---------------------------------------------------------------------------------


def test_density_clusters_find_blobs_and_noise():
    x = np.vstack([blobs(30, 25), [[5.0] * 8], [[-5.0] * 8]])
    labels, strength = fit.density_clusters(x, 6, 2)
    assert len(set(labels[:30])) == 1 and len(set(labels[30:55])) == 1 and labels[0] != labels[30]
    assert list(labels[55:]) == [-1, -1] and ((strength >= 0) & (strength <= 1)).all()


def test_every_row_has_a_cluster_and_few_rows_have_one():
    out = fit.cluster_rows(blobs(20, 20, 15))
    assert len(out) == 55 and out["cluster_key"].nunique() >= 2 and out["confidence"].between(0, 1).all()
    assert set(fit.cluster_rows(blobs(3))["cluster_key"]) == {"emerging_other"}


def test_cluster_count_is_capped():
    out = fit.cluster_rows(blobs(*[12] * 14, dims=16, spread=0.01))
    assert out["cluster_key"].nunique() <= 10


@settings(max_examples=20, deadline=None)
@given(st.integers(1, 40), st.integers(0, 5))
def test_cluster_rows_never_fails(n, seed):
    x = np.random.default_rng(seed).normal(size=(n, 5))
    x[: n // 3] = 0
    assert len(fit.cluster_rows(x)) == n and len(fit.sub_clusters(x)) == n


def test_silhouette_and_components():
    x = blobs(20, 20)
    assert fit.silhouette(x, np.repeat([0, 1], 20)) > 0.8 and fit.silhouette(x, np.zeros(40, int)) == -1.0
    r, kept = fit.reduced(x, 3)
    assert r.shape == (40, 3) and 0 < kept <= 1


def test_similar_clusters_merge():
    c = np.array([[1.0, 0.0], [0.99, 0.01], [0.0, 1.0]])
    assert fit.merged_clusters(c, np.array([5, 3, 4]), [{"a", "b"}, {"a", "c"}, {"a", "b"}]) == [0, 0, 2]
    assert fit.merged_clusters(c, np.array([5, 3, 4]), [{"a"}, {"z"}, {"q"}]) == [0, 1, 2]


def test_fit_clusters_by_group(spark):
    rows = [(g, i, [float(v) for v in row]) for g in (1, 2) for i, row in enumerate(blobs(12, 12))]
    got = fit.fit_clusters(spark.createDataFrame(rows, "video_id bigint, id bigint, v array<double>"), "video_id")
    assert got.count() == 48 and got.select("video_id", "cluster_key").distinct().count() >= 4


def test_shares_add_up(spark):
    p = spark.createDataFrame([(i, i % 3, [1.0, float(i)], 1.0 + i % 2) for i in range(20)], "id bigint, label int, v array<double>, weight double")
    s = clusters.cluster_stats(p, ["label"]).agg(F.sum("share_pct").alias("a"), F.sum("weighted_share").alias("b")).first()
    assert s["a"] == pytest.approx(100) and s["b"] == pytest.approx(100)


def test_vectors_of_odd_shape(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0]), ([], [])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0, 0.0]


# --- texts ------------------------------------------------------------------------------------


def test_near_duplicates_keep_the_first(spark):
    texts = ["Красная площадь зимой особенно красива", "красная площадь зимой особенно КРАСИВА", "Красная площадь зимой особенно красива!!", "Совсем другая мысль здесь написана", "Красная площадь летом особенно шумная"]
    df = spark.createDataFrame([(1, i, i, t) for i, t in enumerate(texts)], "g bigint, id bigint, rank int, text string")
    assert sorted(r["id"] for r in topics.without_near_duplicates(df, "g").collect()) == [0, 3, 4]


def test_labels_become_unique(spark):
    df = spark.createDataFrame([(1, 0, "Тема", ["цены"]), (1, 1, "тема", ["цены", "рост"]), (1, 2, "Тема", ["цены"]), (1, 3, "Тема", [])], "run bigint, ord int, label string, tokens array<string>")
    got = {r["ord"]: r["label"] for r in topics.unique_labels(df, "run").collect()}
    assert got[0] == "Тема" and len({v.lower() for v in got.values()}) == 4 and got[1] == "тема: цены"


def test_quotes_match_by_tiers(spark):
    q = spark.createDataFrame([(1, 1, "Полностью равный текст"), (1, 2, "достаточно длинная часть другого комментария"), (1, 3, "часть, с знаками - которая длинная весьма"), (1, 4, "нет такого")], "g bigint, quote_id bigint, quote string")
    c = spark.createDataFrame([(1, 10, 1, "полностью  равный текст"), (1, 11, 2, "Тут достаточно длинная часть другого комментария есть"), (1, 12, 3, "Вот часть с знаками которая длинная весьма")], "g bigint, comment_id bigint, rank int, text string")
    assert sorted(tuple(r) for r in topics.matched_quotes(q, c, ["g"]).collect()) == [(1, 1, 10, 0), (1, 2, 11, 1), (1, 3, 12, 2)]


@pytest.mark.parametrize(
    ("text_raw", "category"),
    [("Автор дебил и видео ужас", "toxic"), ("Автор, почему вы так решили?", "question"), ("Автор, это неправильно и спорн вывод", "criticism"), ("Автор снимите ещё один выпуск", "appeal"), ("Спасибо автор за выпуск", "skip"), ("да", "skip"), (None, "skip")],
)
def test_categories(spark, text_raw, category):
    df = spark.createDataFrame([(text_raw,)], "t string")
    none = F.lit(None).cast("string")
    assert df.select(appeal.category(F.col("t"), none, none)).first()[0] == category


def test_names_are_found_in_other_cases(spark):
    df = spark.createDataFrame([("Спросите Олега об этом", "Олег, Анна Ян"), ("Нам Анну позвать", "Олег, Анна Ян"), ("олений рог", "Олег"), ("x", None)], "t string, names string")
    p = appeal.name_pattern(appeal.guest_names(F.col("names")))
    assert [r[0] for r in df.select(appeal.named(F.lower("t"), p)).collect()] == [True, True, False, False]


def test_targets_and_strict_scores(spark):
    none = F.lit(None).cast("string")
    df = spark.createDataFrame([("ты идиот",), ("вы молодец",), ("хороший канал",), ("погода",)], "t string")
    got = [r[0] for r in df.select(appeal.insult_target(F.col("t"), none, none)).collect()]
    assert [(g["target"], g["confidence"]) if g else None for g in got] == [("author", 0.9), ("author", 0.55), ("content", 0.5), None]
    s = spark.createDataFrame([(9, 2, "x"), (9, 5, "x"), (4, 8, "fact_check"), (9, 9, "meme_one_liner"), (10, 8, "clarification_needed")], "score int, depth int, kind string")
    assert [r[0] for r in s.select(appeal.strict_score(F.col("score"), F.col("depth"), F.col("kind"))).collect()] == [5, 7, 7, 3, 6]


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=60))
def test_balanced_object_is_json_or_none(t):
    s = json.dumps({"a": t, "b": {"c": [t]}})
    assert parsing.balanced_object(f"x {s} y") == s
    parsing.balanced_object(t)


def test_parsers(spark):
    df = spark.createDataFrame([("PT1H2M3S", "9:05", "2026-01-02T03", "yes"), ("P1DT5S", "24:00", "x", "off"), ("bad", "", "", "")], "d string, c string, i string, b string")
    got = [tuple(r) for r in df.select(parsing.duration_seconds(F.col("d")), parsing.clock_time(F.col("c")), parsing.iso_date(F.col("i")).cast("string"), parsing.truth(F.col("b"), True)).collect()]
    assert got == [(3723, "09:05", "2026-01-02", True), (86405, None, None, False), (None, None, None, False)]
    r = spark.createDataFrame([('{"results": {"1": "question:99", "2": "bogus:3", "x": "toxic:1", "3": "skip"}}',), ("broken",)], "s string").select(parsing.scored_results(F.col("s")).alias("r")).collect()
    assert sorted(tuple(x) for x in r[0]["r"]) == [(1, "question", 10), (3, "skip", 5)] and not r[1]["r"]


def test_text_helpers(spark):
    df = spark.createDataFrame([("a" * 50,), ("кратко",), ("слово, " * 20,)], "t string")
    got = [r[0] for r in df.select(text.clipped(F.col("t"), 20)).collect()]
    assert got[0] == "a" * 17 + "..." and got[1] == "кратко" and len(got[2]) <= 20
    urls = spark.createDataFrame([("https://youtu.be/abc123DEF45",), ("https://x.test/watch?t=1&v=abc123DEF45",), ("https://x.test/shorts/abc123DEF45?a",), ("abc123DEF45",), ("nothing",)], "u string")
    assert [r[0] for r in urls.select(text.video_id_of(F.col("u"))).collect()] == ["abc123DEF45"] * 4 + [None]


# --- relations --------------------------------------------------------------------------------


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1, "old"), ("b", 2, "old")], "k string, v int, born string")
    new = spark.createDataFrame([("a", 5, "x", 1), ("a", None, "y", 2), ("c", 7, "c1", 3), ("c", 8, "c2", 4)], "k string, v int, born string, ord int")
    once = relational.upsert(old, new, "k", "ord", insert_only=["born"])
    assert sorted(map(tuple, once.select("k", "v", "born").collect())) == [("a", None, "old"), ("b", 2, "old"), ("c", 8, "c1")]
    twice = relational.upsert(once.select("k", "v", "born"), new, "k", "ord", insert_only=["born"])
    assert sorted(map(tuple, twice.select("k", "v", "born").collect())) == sorted(map(tuple, once.select("k", "v", "born").collect()))


def test_banned_identities(spark):
    c = spark.createDataFrame([(1, "ch1", "a"), (2, None, "b"), (3, None, "c"), (4, "ch4", "b"), (5, None, None)], "id bigint, author_channel_id string, username string")
    b = spark.createDataFrame([("ch1", "zz"), (None, "b"), ("ch9", "c"), (None, None)], "author_channel_id string, username string")
    assert sorted(r["id"] for r in relational.without_identities(c, b, "author_channel_id", "username").collect()) == [3, 4, 5]


def test_samples_budgets_batches(spark):
    df = spark.range(100).withColumn("g", F.lit(1)).withColumn("size", F.lit(30).cast("bigint"))
    assert relational.every_nth(df, ["g"], ["id"], 10).count() == 10
    taken = [r["taken"] for r in relational.within_budget(df, ["g"], ["id"], "size", 100).orderBy("id").collect()]
    assert taken == [30, 30, 30, 10]
    assert relational.batches(df, ["g"], ["id"], 30).groupBy("batch").count().count() == 4
    a, b = df.filter("id < 10").select("id", F.col("id").alias("ord")), df.filter("id between 5 and 20").select("id", F.col("id").alias("ord"))
    assert [r["id"] for r in relational.unioned_samples([a, b], "id", "ord", 12).collect()] == list(range(12))


# --- files, models, streams -------------------------------------------------------------------


def test_fixture_and_threads(spark, tmp_path):
    c = {"youtube_comment_id": "x", "text_raw": "t", "like_count": 1, "reply_count": 0, "published_at": "2026-01-01T00:00:00Z", "is_top_level": True}
    (tmp_path / "f.json").write_text(json.dumps({"latest_video": {"youtube_video_id": "v", "title": "T"}, "comments": [c, c | {"youtube_comment_id": "y"}]}, indent=1))
    v, got = landing.fixture(spark, str(tmp_path / "f.json"))
    assert v.first()["youtube_video_id"] == "v" and [r["ord"] for r in got.orderBy("ord").collect()] == [0, 1]
    reply = {k: c[k] for k in ("youtube_comment_id", "text_raw", "like_count")} | {"published_at": datetime(2026, 1, 1)}
    kind = "youtube_comment_id string, text_raw string, like_count int, published_at timestamp"
    t = spark.createDataFrame([("p", "t", 1, datetime(2026, 1, 1), 2, [tuple(reply.values()), (None, "z", 0, None)])], f"{kind}, reply_count int, replies array<struct<{kind.replace(' ', ':')}>>".replace(",:", ", "))
    flat = landing.flattened_threads(t)
    assert sorted((r["youtube_comment_id"], r["parent_comment_id"]) for r in flat.collect()) == [("p", None), ("x", "p")]


def test_paged_source(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.jsonl").write_text("\n".join(json.dumps({"n": i * 10 + j}) for j in range(4)) + "\n\n")
    spark.dataSource.register(landing.Pages)
    df = spark.read.format("pages").option("most", "2").load(str(tmp_path))
    assert df.count() == 8 and df.select("page").distinct().count() == 2


def test_sinks(spark, tmp_path):
    now = datetime(2026, 1, 2, 3)
    df = spark.createDataFrame([(now, 5, "t" * 300, "u", None, 0.5, "author")], "banned_at timestamp, video_id bigint, text string, username string, author_channel_id string, confidence_score double, insult_target string")
    for _ in range(2):
        sinks.append_bans(df, str(tmp_path / "bans"))
    back = spark.read.option("header", True).csv(str(tmp_path / "bans"))
    assert back.count() == 2 and back.first()["confidence"] == "0.50" and len(back.first()["text"]) == 200
    sinks.dump_raw(df.withColumn("fetched_at", F.col("banned_at")), str(tmp_path / "raw"))
    assert (tmp_path / "raw" / "day=2026-01-02" / "video_id=5").exists()
    labels = spark.createDataFrame([(1, 7), (2, 8)], "id bigint, comment_id bigint")
    ok, missing = sinks.label_rows(labels, spark.createDataFrame([(7, "t", "a")], "comment_id bigint, text_raw string, author_name string"))
    assert ok.count() == 1 and [r["id"] for r in missing.collect()] == [2]
    t = spark.createDataFrame([(1, "B", "d", 10.0, 20.0, ["q <b>"]), (1, "A", "d", 30.0, 40.0, [])], "run int, label string, description string, share_pct double, weighted_share double, quotes array<string>")
    md = sinks.markdown_report(t, "run").first()["markdown"]
    assert md.index("## A") < md.index("## B") and "&lt;b&gt;" in sinks.html_of(md) and "<h1>Topics</h1>" in sinks.html_of(md)


def test_models_and_fallback(spark):
    df = spark.createDataFrame([(i, f"text {i % 3}") for i in range(10)], "id bigint, t string")
    cache = spark.createDataFrame([], "h string, embedding array<float>")
    got, new = providers.embedded_with_cache(df, cache, "id", "t", providers.hashing_embedder)
    assert got.count() == 10 and new.count() == 3

    def broken():
        def ask(texts):
            if any("2" in t for t in texts):
                raise RuntimeError("no")
            return [t.upper() for t in texts]

        return ask

    a = providers.answered(df, "id", "t", broken, batch=1)
    out = providers.with_fallback(df, a, "id", F.col("answer"), F.lit("rule"), "final")
    assert out.count() == 10 and out.filter("final = 'rule'").count() == 3
    first, rest = providers.within_quota(df, "id", [F.col("id")], 4)
    assert first.count() == 4 and rest.count() == 6
    assert providers.running_cost(df.withColumn("g", F.lit(1)).withColumn("c", F.lit(1.0)), ["g"], ["id"], "c", 3.0).count() == 3


def test_stream_equals_batch(spark, sf, tmp_path):
    import shutil

    (tmp_path / "in").mkdir()
    shutil.copy(f"{sf}/events.parquet", tmp_path / "in" / "events.parquet")
    batch = spark.read.parquet(f"{sf}/events.parquet")
    schema = ", ".join(f"{n} {t}" for n, t in batch.dtypes)
    stream = events.event_stream(spark, str(tmp_path / "in"), schema).withColumn("ts", F.col("ts").cast("timestamp"))
    q = events.windowed(stream).writeStream.format("memory").queryName("win").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    expected = events.windowed(batch.withColumn("ts", F.col("ts").cast("timestamp")))
    assert sorted(map(tuple, spark.table("win").collect())) == sorted(map(tuple, expected.collect()))
    assert events.sessions(batch.withColumn("ts", F.col("ts").cast("timestamp"))).count() > 0


def test_positions_cover_topics_and_shares_add_up(spark):
    from skein.operators import positions

    x = np.vstack([blobs(14, 12), R.normal(size=(3, 8))])
    df = spark.createDataFrame([(g, t, i, [float(v) for v in row], 1.0 + i % 3) for g in (1, 2) for t in (0, 1) for i, row in enumerate(x, start=1000 * (2 * g + t))], "video_id bigint, label int, id bigint, v array<double>, weight double")
    a = positions.assigned_positions(df, "video_id", "label").cache()
    assert a.count() == df.count() and a.groupBy("id").count().filter("count > 1").count() == 0
    p = positions.position_table(a, df, "video_id", "label")
    for r in p.groupBy("video_id", "label").agg(F.sum("pct").alias("a"), F.sum("weighted_pct").alias("b")).collect():
        assert r["a"] == pytest.approx(100) and r["b"] == pytest.approx(100)
    last = p.filter("position = 'undetermined'").join(p.groupBy("video_id", "label").agg(F.max("sort_order").alias("m")), ["video_id", "label"])
    assert all(r["sort_order"] == r["m"] for r in last.collect())


def test_small_groups_and_far_rows_are_undetermined():
    from skein.operators import positions

    unit = fit.unit_rows(np.array([[1.0, 0], [1, 0.01], [0, 1.0], [0.01, 1], [0.7, 0.7], [-1.0, 0.1]]))
    got = positions.resolved(np.array([0, 0, 1, 1, -1, -1]), unit)
    assert list(got[:4]) == ["position_1"] * 2 + ["position_2"] * 2 and list(got[4:]) == ["undetermined"] * 2
