"""The ten corpus problems: brute force, round trips, held-out accuracy, and odd inputs."""

from __future__ import annotations

import json
import random
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.llm import abuse, caps, containers, copies, encode, keys, language, normal_form, personal, splits, store, subjects

LONG = "очень длинный текст " * 20_000


def rows(df):
    return [tuple(r) for r in df.collect()]


def comments(spark, data, extra=""):
    """Comments (id, author, text, likes); ``extra`` adds columns with names that operators use inside."""
    df = spark.createDataFrame(data, "comment_id bigint, author_name string, text_raw string, like_count int")
    for name in extra.split():
        df = df.withColumn(name, F.lit("x"))
    return df


CLASHING = "k t key row bucket kept copies author place part i u v w x c m n a b"


# --- 1 -----------------------------------------------------------------------------------------


def brute_components(data):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    bare = lambda s: "".join(c for c in s if unicodedata.category(c)[0] not in "PZ" and not c.isspace()).lower()
    for i, a, v in data:
        for link in ([("a", bare(a))] if a is not None else []) + ([("v", v)] if v is not None else []):
            parent[find(("i", i))] = find(link)
    least = {}
    for i, _, _ in data:
        least[find(("i", i))] = min(i, least.get(find(("i", i)), i))
    return {(i, least[find(("i", i))]) for i, _, _ in data}


def test_linked_rows_equal_union_find(spark):
    r = random.Random(3)
    data = [(i, r.choice([None, f"Name {r.randrange(60)}", f"NAME_{r.randrange(60)}."]), r.choice([None, r.randrange(70)])) for i in range(200)]
    data += [(1000 + i, f"chain {i}", i) for i in range(70)] + [(1000 + i, f"Chain {i + 1}!", i) for i in range(70)]
    df = spark.createDataFrame(data, "id bigint, author_name string, video_id bigint").withColumn("v", F.lit(1)).withColumn("group", F.lit("z"))
    assert set(rows(splits.linked_rows(df, "id", "author_name", ["video_id"]))) == brute_components(data)


def test_hot_keys_are_joined_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(store, "CHUNK", 100)
    monkeypatch.setattr(store, "BLOCK", 2)
    left = spark.createDataFrame([(i % 2 if i < 900 else i, i) for i in range(1000)] + [(None, -1)], "k bigint, v bigint")
    sized = spark.createDataFrame([(0, 450, "a"), (1, 450, "b"), *[(i, 1, "c") for i in range(950, 1000)], (7, 500, "d")], "k bigint, c bigint, w string")
    got = store.joined(left, sized, ["k"], 1001)
    assert sorted(rows(got)) == sorted((i % 2 if i < 900 else i, i, "ab"[i % 2] if i < 900 else "c") for i in [*range(900), *range(950, 1000)])
    # no task of the shuffle join sees a key with more rows than a chunk
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 5


def test_tables_are_removed(spark, tmp_path):
    import os

    root = store.shared_dir(spark).removeprefix("file://") + "/skein"
    store.released(spark)
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    df, path = store.written(spark.range(5), "test")
    assert df.count() == 5 and os.path.isdir(path.removeprefix("file://"))
    assert store.released(spark) >= 1 and not os.path.exists(path.removeprefix("file://"))
    copies.copies_of(comments(spark, [(1, "a", "x", 0), (2, "a", "X", 0)]), "comment_id", copies.comment_key()).collect()
    store.released(spark)
    assert set(os.listdir(root)) == before


def test_hot_value_is_a_star(spark, monkeypatch):
    monkeypatch.setattr(store, "CHUNK", 100)
    data = [(i, "Same", None) for i in range(2500)] + [(5000 + i, None, i) for i in range(5)]
    df = spark.createDataFrame(data, "id bigint, author_name string, video_id bigint")
    got = dict(rows(splits.linked_rows(df, "id", "author_name", ["video_id"])))
    assert all(got[i] == 0 for i in range(2500)) and all(got[5000 + i] == 5000 + i for i in range(5))


def test_splits_hold_groups_together_and_shares(spark):
    df = spark.createDataFrame([(i, f"a{i // 3}", None) for i in range(3000)], "id bigint, author_name string, video_id bigint")
    got = rows(splits.assign_splits(df, "id", "author_name", ["video_id"], {"train": 0.8, "test": 0.2}))
    by = defaultdict(set)
    for _, g, s in got:
        by[g].add(s)
    assert all(len(s) == 1 for s in by.values())
    assert 0.75 < sum(s == "train" for _, _, s in got) / len(got) < 0.85
    with pytest.raises(ValueError):
        splits.assign_splits(df, "id", "author_name", ["video_id"], {})


def test_achieved_shares(spark):
    df = spark.createDataFrame([(i, f"a{i}", None) for i in range(100)] + [(1000 + i, "Big", None) for i in range(100)], "id bigint, author_name string, video_id bigint")
    wanted = {"train": 0.6, "test": 0.2, "none": 0.2, "never": 0.0}
    got = {r["split"]: r for r in splits.achieved(splits.assign_splits(df, "id", "author_name", ["video_id"], wanted), wanted).collect()}
    assert set(got) == set(wanted) and sum(r["n"] for r in got.values()) == 200 and sum(r["n_groups"] for r in got.values()) == 101
    assert got["never"]["n"] == 0 and all(abs(r["share"] - r["wanted"] - r["deviation"]) < 1e-12 for r in got.values())


def test_splits_of_empty_table(spark):
    df = spark.createDataFrame([], "id bigint, author_name string, video_id bigint")
    assert rows(splits.linked_rows(df, "id", "author_name", ["video_id"])) == []


# --- 2 -----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def detector():
    return personal.fitted()


def kinds(detector, text, author=False):
    return {personal.KINDS[k] for _, _, _, k, _ in detector.found([text], author)}


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("Пишите на ivan.petrov@mail.test пожалуйста", "email"),
        ("ivan собака mail точка test", "email"),
        ("Write to bob(at)mail.test", "email"),
        ("Звоните +7 (912) 345-67-89 вечером", "phone"),
        ("тел. ８ ９１２ ３４５ ６７ ８９", "phone"),
        ("Мой паспорт 4509 123456 потерян", "id_number"),
        ("lost my SSN 123-45-6789 again", "id_number"),
        ("Живу по адресу ул. Садовая, д. 5, кв. 12", "street_address"),
        ("I live at 12 Baker Street, Apt 4", "street_address"),
        ("Vivo en la calle Mayor 18, vengan", "street_address"),
        ("Меня зовут Иван Сидоренко, я врач", "person_name"),
        ("сосед, Сидоренко Иван", "person_name"),
        ("Ольга Петровна против", "person_name"),
        ("My name is Derek Longworth and I teach", "person_name"),
    ],
)
def test_personal_is_found(detector, text, kind):
    assert kind in kinds(detector, text)


@pytest.mark.parametrize("text", ["Олег, спасибо за тон", "Закон № 123-ФЗ принят", "Набрали 1 234 567 просмотров", "Версия 12.4.33.1 вышла", "Тайм-код 00:12:33", "Дом на проспекте сносят", "@user_12 и #tag12345", "https://a.test/watch?v=abc123", "", " ", "👍" * 500])
def test_harmless_is_left(detector, text):
    assert not kinds(detector, text)


def test_detector_on_held_out_candidates(detector):
    x, y, k = personal.training_set(seed=1234, size=4000)
    for kind, tree in enumerate(detector.trees):
        p, truth = tree.probability(x[k == kind]), y[k == kind]
        said = p >= detector.thresholds[kind]
        assert truth[said].mean() > 0.93 and said[truth > 0].mean() > 0.93, personal.KINDS[kind]


def test_redaction_changes_spans_only(spark, detector):
    data = [(1, "Иван Сидоренко", "Хвалю. Звоните +7 (912) 345-67-89 вечером 🔥", 1), (2, None, None, None), (3, "", "", 0), (4, "Бодрый кот 12", LONG, 0), (5, "x", "З​воните +7 (912) 345-67-89!", 0)]
    got = {r["comment_id"]: r for r in personal.redacted(comments(spark, data, CLASHING), "comment_id", {"text_raw": False, "author_name": True}, detector).collect()}
    assert got[1]["text_raw"] == "Хвалю. Звоните [PHONE] вечером 🔥" and got[1]["author_name"] == "[PERSON_NAME]"
    assert got[2]["text_raw"] is None and got[3]["text_raw"] == "" and got[4]["text_raw"] == LONG
    assert got[5]["text_raw"] == "З​воните [PHONE]!"
    spans = rows(personal.found_spans(comments(spark, data, CLASHING), "comment_id", {"text_raw": False, "author_name": True}, detector).select("comment_id", "field_name", "kind"))
    assert sorted(spans) == [(1, "author_name", "person_name"), (1, "text_raw", "phone"), (5, "text_raw", "phone")]


def test_adversarial_lengths_end(detector):
    for t in ("а-" * 30_000, "1" * 60_000, "a." * 30_000, "1 " * 30_000, "Иван " * 5000):
        detector.found([t], False)


@pytest.mark.parametrize("text", ["Меня зовут Жансая Ахметова", "С уважением, Рустам Гафуров", "My name is Priya Raman", "Our neighbour Fatima Haddad", "Sincerely, Liam Nguyen", "Ich heiße Lukas Brandt", "меня зовут жансая ахметова"])
def test_names_that_no_list_holds(detector, text):
    assert kinds(detector, text) == {"person_name"}


@pytest.mark.parametrize("text", ["Guten Abend! Gute Arbeit", "Смотрю из города Новая Ладога, привет всем!", "Большой Театр закрыли", "Saludos a todos desde Nueva York", "Меня зовут на работу", "Der Cloud Server fällt aus", "Open Source is good", "На 57-Й Хвилині Ви Слушно Згадали Тренерський Штаб"])
def test_capitals_are_no_names(detector, text):
    assert kinds(detector, text) == set()


def test_halves_of_the_training_data_share_nothing():
    both = [{personal._person(random.Random(i), half)[0].split()[0] for i in range(400)} for half in (0, 1)]
    listed = [{n for n in b if n.lower() in personal.GIVEN} for b in both]
    assert not listed[0] & listed[1]


# --- 3 -----------------------------------------------------------------------------------------

SENTENCES = {
    "ru": ["Сегодня мы долго говорили о погоде в городе", "Вчера вечером соседи снова включили громкую музыку", "Мне очень понравилась эта интересная книга", "Завтра утром поезд отправится без опоздания", "Дети играли во дворе до позднего вечера"],
    "en": ["Today we talked about the weather in the city", "The neighbours turned on loud music last night", "I really liked this interesting book", "Tomorrow morning the train will leave on time", "The children played in the yard until late"],
    "uk": ["Сьогодні ми довго говорили про погоду в місті", "Учора ввечері сусіди знову ввімкнули гучну музику", "Мені дуже сподобалася ця цікава книжка", "Завтра вранці потяг вирушить без запізнення", "Діти гралися у дворі до пізнього вечора"],
    "de": ["Heute haben wir lange über das Wetter in der Stadt geredet", "Gestern Abend machten die Nachbarn wieder laute Musik", "Dieses interessante Buch hat mir sehr gefallen", "Morgen früh fährt der Zug ohne Verspätung ab", "Die Kinder spielten bis spät im Hof"],
    "es": ["Hoy hablamos mucho del tiempo en la ciudad", "Anoche los vecinos pusieron otra vez música alta", "Me gustó mucho este libro interesante", "Mañana por la mañana el tren saldrá sin retraso", "Los niños jugaron en el patio hasta tarde"],
}


@pytest.fixture(scope="module")
def parser():
    r = random.Random(5)
    sample = {k: [". ".join(r.sample(v[:4], 2)) for _ in range(30)] for k, v in SENTENCES.items()}
    sample["ru"] += SENTENCES["en"][:2]  # wrong labels
    return language.fit(sample)


def test_held_out_sentences(parser):
    texts = [v[4] for v in SENTENCES.values()]
    assert list(language.detect(parser, texts)["lang"]) == list(SENTENCES)


def test_mixed_text_and_romanised(parser):
    out = language.detect(parser, ["Сегодня мы долго говорили о погоде в городе.\nI really liked this interesting book.", "Segodnya my dolgo govorili o pogode v gorode", "Сeгoдня мы дoлгo гoвopили o пoгoдe"])
    assert set(out[out["doc"] == 0]["lang"]) == {"ru", "en"}
    assert set(out[out["doc"] == 1]["lang"]) == {"ru"} and set(out[out["doc"] == 2]["lang"]) == {"ru"}
    assert out["confidence"].between(0, 1).all()


def test_segments_name_their_place(parser):
    t = "👍 Hi! Сегодня мы долго​ говорили о погоде. ＃тег"
    out = language.detect(parser, [t])
    assert [t[b:e] for b, e in zip(out["begin"], out["end"], strict=True)] == ["Hi", "Сегодня мы долго​ говорили о погоде"]


def test_cross_parse_counts_equal_brute_force():
    train = language.segments(["абракадабра кабан абак"])[0]
    model = language.CrossParser({"ru": language.automaton([train])})
    text = "".join(language.ALPHABET[c] for c in train.tolist())
    for s in ("абаракада кабанчик", "я", "кабан", "ббббб абрак"):
        x, b, *_ = language.segments([s])
        probe = "".join(language.ALPHABET[c] for c in x.tolist())
        n, i = 0, 0
        while i < len(probe):
            j = i + 1
            while j <= len(probe) and probe[i:j] in text:
                j += 1
            i = max(i + 1, j - 1)
            n += 1
        assert model.phrases(x, b)[0, 0] == n


def test_wrong_labels(spark, parser):
    data = [(1, "ru", "Мне очень понравилась эта книга"), (2, "RU-ru", "I really liked this interesting book"), (3, None, "Дети играли во дворе до вечера"), (4, "ru", None), (5, "und", "👍 12:30"), (6, "Russian", LONG), (7, "eng", "")]
    df = spark.createDataFrame(data, "comment_id bigint, language_label string, text_raw string").withColumn("k", F.lit(0)).withColumn("lang", F.lit("q"))
    assert sorted(rows(language.wrong_labels(df, "comment_id", "text_raw", "language_label", parser))) == [(2, "en"), (3, "ru")]
    empty = language.fit(language.sampled(df.limit(0), "comment_id", "text_raw", "language_label"))
    assert rows(language.segment_languages(df.limit(0), "comment_id", "text_raw", empty)) == []


@pytest.mark.parametrize("n", [1, 900, 901, 10**6, 10**9, 10**12, 10**15])
def test_sampling_bound_holds_at_any_size(n):
    share = (language.hash_bound(900, n) + (1 << 63) + 1) / (1 << 64)
    assert abs(share * n - min(n, 900)) <= 1 and share > 0


def test_samples_are_bounded_and_never_empty(spark):
    df = spark.range(5000).select("id", F.concat(F.lit("текст номер "), "id").alias("t"), F.lit("ru").alias("l"), (F.col("id") % 2 == 0).alias("y"))
    got = language.sampled(df, "id", "t", "l", 50)
    assert len(got["ru"]) == 50 and got == language.sampled(df.orderBy(F.rand(1)), "id", "t", "l", 50)
    texts, labels = abuse.sampled(df, "t", "y", 40)
    assert len(texts) == len(set(texts)) == 40 and 5 < sum(labels) < 35
    assert language.sampled(df.limit(0), "id", "t", "l") == {} and abuse.sampled(df.limit(0), "t", "y") == ([], [])
    both = df.select("t", F.lit(True).alias("y")).unionByName(df.select("t", F.lit(False).alias("y")))
    assert abuse.sampled(both, "t", "y") == ([], [])


# --- 4 -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [10, 100_000])
def test_copies_equal_grouping(spark, size):
    r = random.Random(9)
    data = [(i, r.choice(["Автор", "автор!", "Other", None, "Дневник дня"]), r.choice(["Да", "да ", "Д а.", "нет", "", None, "ё", "е", LONG]), 0) for i in range(400)]
    df = comments(spark, data, CLASHING)
    groups = defaultdict(list)
    bare = lambda s: None if s is None else "".join(c for c in s if unicodedata.category(c)[0] not in "PZ" and not c.isspace()).lower()
    for i, a, t, _ in data:
        if a is not None:
            groups[bare(a), bare(t)].append(i)
    assert set(rows(copies.copies_of(df, "comment_id", copies.comment_key(), bucket_rows=size))) == {(min(g), i) for g in groups.values() for i in g if i != min(g)}
    assert set(rows(copies.collapsed(df, "comment_id", copies.comment_key(), bucket_rows=size))) == {(min(g), len(g)) for g in groups.values()}


def test_one_key_larger_than_a_bucket(spark):
    df = comments(spark, [(i, "a", "same", 0) for i in range(500)] + [(900, "a", "samesame", 0)])
    got = rows(copies.collapsed(df, "comment_id", copies.comment_key(), bucket_rows=20))
    assert sorted(got) == [(0, 500), (900, 1)]


def test_payloads(spark):
    a = {"author_name": "A b", "text_raw": "Х 🔥", "like_count": 1, "is_top_level": True, "parent_comment_id": None}
    b = {k: a[k] for k in reversed(a)} | {"author_name": "a-B"}
    other = a | {"like_count": 2}
    data = [(1, json.dumps(a)), (2, json.dumps(b, ensure_ascii=False, indent=1)), (3, json.dumps(other)), (4, "not json"), (5, "not json"), (6, None), (7, "[1]"), (8, "{}"), (9, " {} ")]
    df = spark.createDataFrame(data, "payload_id bigint, payload string").withColumn("bad", F.lit(1))
    assert sorted(rows(copies.copies_of(df, "payload_id", copies.json_key(F.col("payload"))))) == [(1, 2), (8, 9)]
    assert rows(copies.collapsed(df.limit(0), "payload_id", copies.json_key(F.col("payload")))) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=30), max_size=60))
def test_trie_counts(data):
    root: dict = {}
    for i, k in enumerate(data):
        copies._put(root, k, i)
    assert sorted(map(len, copies._terminals(root))) == sorted(Counter(data).values())


# --- 5 -----------------------------------------------------------------------------------------


def test_caps_equal_sorting(spark):
    r = random.Random(2)
    data = [(i, r.choice(["hot"] * 5 + [None, "", "A b", "a-B", "c"]), "t", r.choice([None, 0, 1, 1, 2])) for i in range(1500)]
    order = [-F.coalesce(F.col("like_count"), F.lit(0)).cast("bigint"), F.col("comment_id")]
    author = keys.bare(F.col("author_name"))
    by = defaultdict(list)
    for i, a, _, n in data:
        if a is not None:
            by[a.replace(" ", "").replace("-", "").lower()].append((-(n or 0), i))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # several partitions, so that authors go over their ends
    try:
        for cap in (0, 1, 7, 400):
            assert set(rows(caps.over_cap(comments(spark, data, CLASHING), "comment_id", author, order, cap=cap))) == {(i,) for v in by.values() for _, i in sorted(v)[cap:]}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(rows(caps.over_cap(comments(spark, data), "comment_id", author, order, share=0.01))) == sum(max(0, len(v) - 15) for v in by.values())
    assert rows(caps.over_cap(comments(spark, []), "comment_id", author, order, cap=3)) == []
    with pytest.raises(ValueError):
        caps.over_cap(comments(spark, data), "comment_id", author, order)


# --- 6 -----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def scorer():
    r = random.Random(4)
    mild = ["Спасибо за выпуск.", "Где вторая часть?", "Сдохла батарейка на даче.", "The sound is fine.", "Мне понравилось интервью.", "Голые цифры скучны."]
    bad = ["Какой же дурак этот гость.", "Ты просто болван, уйди.", "You are a total fool, leave.", "Чтоб ты сдох со своим каналом."]
    texts, labels = [], []
    for _ in range(600):
        part = r.sample(mild, r.randint(1, 3)) + ([r.choice(bad)] if r.random() < 0.5 else [])
        r.shuffle(part)
        texts.append(" ".join(part))
        labels.append(any(p in bad for p in part) if r.random() > 0.05 else r.random() < 0.5)
    return abuse.train(texts, labels)


def score(scorer, *texts):
    c, b, d, *_ = abuse.sentences(texts)
    return abuse.noisy_or(scorer.sentence_scores(c, b), d, len(texts)) if len(d) else np.zeros(len(texts))


def test_abuse_in_any_spelling(scorer):
    bad = score(scorer, "Мне понравилось интервью. Какой же дурак этот гость.", "Какой же д у р а к этот гость", "КАКОЙ ЖЕ ДУУУРАК ЭТОТ ГОСТЬ", "Какой же дyр​ак этoт гость", "Какой же дур*к этот гость")
    mild = score(scorer, "Сдохла батарейка на даче.", "Мне понравилось интервью. Где вторая часть?", "", "👍", "12:30")
    assert (bad > 0.5).all() and (mild < 0.5).all()


def test_scores_locate_sentences(spark, scorer):
    data = [(1, "a", "Спасибо за выпуск. Ты просто болван, уйди. Где вторая часть?", 0), (2, "a", None, 0), (3, "a", "", 0), (4, "a", LONG, 0), (5, "a", "🔥", 0)]
    got = {r["comment_id"]: r for r in abuse.scored(comments(spark, data, CLASHING + " score begin"), "comment_id", "text_raw", scorer).collect()}
    assert data[0][2][got[1]["begin"] : got[1]["end"]] == "Ты просто болван, уйди" and got[1]["score"] > 0.5
    assert got[2]["score"] == 0 and got[2]["begin"] is None and got[3]["score"] == 0 and got[5]["score"] == 0
    empty = comments(spark, [])
    assert rows(abuse.scored(empty, "comment_id", "text_raw", abuse.train([], []))) == []


# --- 7 -----------------------------------------------------------------------------------------


def test_look_alikes(spark):
    data = [(1, "a", "Привет, мир", 0), (2, "a", "Пpивeт, мир", 0), (3, "a", "Привет, мир", 0), (4, "a", "привет, мир", 0), (5, "a", "При​вет， мир", 0), (6, "a", "Привет,  мир", 0), (7, "a", None, 0), (8, "a", "", 0), (9, "a", "​", 0), (10, "a", "й й ё", 0), (11, "a", "й й ë", 0), (12, "a", "и и е", 0), (13, "a", "👨‍👩", 0), (14, "a", "👨👩", 0), (15, "a", LONG, 0)]
    got = set(rows(normal_form.look_alikes(comments(spark, data, CLASHING), "comment_id", "text_raw")))
    assert got == {(1, 2), (1, 5), (2, 3), (2, 5), (3, 5), (8, 9), (10, 11)}


def test_look_alikes_of_many_copies_are_cut_into_blocks(spark):
    data = [(i, "a", "сок" if i % 3 else "coк", 0) for i in range(90)]
    df = comments(spark, data)
    got = rows(normal_form.look_alikes(df, "comment_id", "text_raw", block=7))
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if (i % 3 == 0) != (j % 3 == 0)}
    assert len(got) == len(want) and set(got) == want
    links = {(r["n_form"] - r["n_text"], r["comment_id"] % 3 == 0) for r in normal_form.look_alike_classes(df, "comment_id", "text_raw").collect()}
    assert links == {(60, True), (30, False)}
    assert rows(normal_form.look_alikes(df.limit(0), "comment_id", "text_raw")) == []


@pytest.mark.parametrize(
    ("odd", "plain"),
    [("ｶﾞｷﾞ", "ガギ"), ("𝐇𝐞𝐥𝐥𝐨 𝟗", "Hello 9"), ("𝕊𝕔𝕣𝕚𝕡𝕥 ℋℓ", "Script Hl"), ("Глава Ⅷ", "Глава VIII"), ("№ ok", "№ ok"), ("aﾠbㅤc", "abc"), ("x\ufe0ey", "xy"), ("ɡood", "good"), ("ᎪᏴ", "AB"), ("￥５", "¥5"), ("x²", "x²"), ("❤️", "❤️")],
)
def test_compatibility_forms(spark, odd, plain):
    got = dict(rows(normal_form.normal_forms(comments(spark, [(1, "a", odd, 0), (2, "a", plain, 0)]), "comment_id", "text_raw")))
    assert got[1] == got[2]
    assert plain.isascii() is False or got[1] == plain


def test_normal_forms_agree_and_read_well(spark):
    data = [(1, "a", "Сосед у нас хороший", 0), (2, "a", "Cоceд y нac хоpoший", 0), (3, "a", "ｆｕｌｌ ﬁt", 0), (4, "a", None, 0), (5, "a", "", 0), (6, "a", "cop is here", 0)]
    got = dict(rows(normal_form.normal_forms(comments(spark, data), "comment_id", "text_raw")))
    assert got[1] == got[2] == "Сосед у нас хороший" and got[3] == "full fit" and got[4] is None and got[5] == "" and got[6] == "cop is here"


# --- 8 -----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference_encoder():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{encode.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def test_encoding_equals_library(spark, reference_encoder):
    texts = ["", " ", "Hello  world\r\n\tdon't", "Привет, мир! 👩‍🚀", "а" * 5000, "x" * 97, "<|endoftext|>", "１２３ ǅ", LONG[:5000], "a\x00b c"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "doc_id bigint, text string").withColumn("ids", F.lit(1)).withColumn("k", F.lit(1))
    got = dict(rows(encode.encoded(df, "doc_id", "text")))
    assert got.pop(len(texts)) is None
    assert all(got[i] == reference_encoder.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts))
    assert rows(encode.encoded(df.limit(0), "doc_id", "text")) == []
    assert dict(rows(encode.token_counts(df, "doc_id", "text"))) == {i: len(v) for i, v in got.items()}


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=120))
def test_both_merges_agree_and_decode(t):
    enc = ENCODER
    raw = t.encode()
    if raw:
        ids = encode.merged_short(raw, enc.ranks)
        assert ids == encode.merged_long(raw, enc.ranks)
        assert b"".join(BYTES[i] for i in ids) == raw


with open(f"{encode.TOKENIZERS}/{encode.VOCABULARY}", "rb") as _f:
    ENCODER = encode.Encoder(_f.read())
BYTES = {v: k for k, v in ENCODER.ranks.items()}


# --- 9 -----------------------------------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=300))
def test_plan_places_every_item_once(sizes):
    h = Counter(sizes)
    p = containers.plan(h, 64)
    order = sorted(sizes, reverse=True)
    fill, at = Counter(), {}
    for a, n, base, first, per in zip(p.start, p.count, p.base, p.first, p.per, strict=True):
        for i in range(n):
            assert a + i not in at
            at[a + i] = base + (first + i) // per
            fill[at[a + i]] += order[a + i]
    assert len(at) == len(sizes) and max(fill.values()) <= 64
    assert len(fill) <= 1.3 * sum(sizes) / 64 + max(1, sum(s > 32 for s in sizes))


def test_packing(spark):
    r = random.Random(1)
    data = [(i, r.choice([0, 1, 30, 64, 100, 257, int(r.expovariate(0.01))])) for i in range(3000)] + [(9001, None), (9002, 1000)]
    df = spark.createDataFrame(data, "doc_id bigint, n_tokens bigint").withColumn("n", F.lit(1)).withColumn("piece", F.lit(1))
    got = containers.packed(df, "doc_id", "n_tokens", 256).collect()
    fill, total = Counter(), Counter()
    for x in got:
        fill[x["container_id"]] += x["n"]
        total[x["doc_id"]] += x["n"]
        assert x["begin"] == 256 * x["piece"]
    assert max(fill.values()) <= 256 and {k: v for k, v in data if v is not None} == dict(total)
    assert sum(fill.values()) / (256 * len(fill)) > 0.97
    assert all(x["piece"] == 0 for x in got if total[x["doc_id"]] <= 256)
    assert rows(containers.packed(df.limit(0), "doc_id", "n_tokens", 256)) == []


# --- 10 ----------------------------------------------------------------------------------------


def test_subjects_spread_from_seeds(spark):
    r = random.Random(8)
    phrases = {
        "sport": ["зелёный кубок", "прыжок с шестом", "синий мяч", "быстрый старт"],
        "law": ["спорный договор", "вызов свидетеля", "тайное дело", "новый закон"],
        "economy": ["рост цен", "слабый рубль", "дешёвый кредит", "закрытый завод"],
        "culture": ["старая икона", "громкая премьера", "первый рассказ", "весёлый хор"],
        "science": ["далёкая звезда", "редкий вид", "точный опыт", "древняя кость"],
    }
    frames = ["Почему так мало сказали про {}?", "Гость быстро свернул разговор про {}.", "Хотелось бы отдельный разбор про {}."]
    talk = ["Спасибо за выпуск.", "Где обещанная часть?", "Это как прыжок выше головы.", "Звук сегодня тихий."]
    docs, truth, seeds = [], {}, []
    for i in range(900):
        about = r.sample(sorted(phrases), r.choices([0, 1, 2], [2, 8, 2])[0])
        part = [r.choice(frames).format(r.choice(phrases[s])) for s in about for _ in range(r.randint(1, 3))] + r.sample(talk, 2)
        r.shuffle(part)
        docs.append((i, " ".join(part)))
        truth[i] = set(about)
        if about and i % 4 == 0:
            seeds += [(i, s if r.random() > 0.08 else r.choice(sorted(phrases))) for s in about]
    docs += [(1000, None), (1001, ""), (1002, "👍"), (1003, LONG)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("doc", F.lit(1)).withColumn("sentence", F.lit(1))
    labels = spark.createDataFrame([*seeds, (0, None), (None, "law"), (5, "unknown")], "doc_id bigint, subject string")
    got = defaultdict(set)
    listed = spark.createDataFrame([(s, f"{s}\nпрочее") for s in phrases] + [("law", None), (None, "ничьё")], "subject string, text string")
    for i, s in rows(subjects.subject_lists(d, labels, listed)):
        got[i].add(s)
    right = sum(got[i] == truth[i] for i in range(900))
    assert right > 810 and not any(got[i] for i in (1000, 1001, 1002))
    assert rows(subjects.subject_lists(d.limit(0), labels.limit(0), listed)) == []
    assert rows(subjects.subject_lists(d, labels, listed.limit(0))) == []
    with pytest.raises(RuntimeError, match="still change"):
        subjects.subject_lists(d, labels, listed, rounds=1)


def test_words_of_subjects_are_whole(spark):
    d = spark.createDataFrame([(1, "Про давление в трубах. Про давлениеметр в трубах!"), (2, "на 57-й минуте сказали"), (3, "на 8-й минуте сказали")], "doc_id bigint, text string")
    got = rows(subjects.sentence_terms(d.coalesce(1), "doc_id", "text").select("doc", "sentence", "terms"))
    assert len({s for i, s, _ in got if i == 1}) == 2 and len({s for i, s, _ in got if i != 1}) == 1
    assert len({t for i, _, ts in got if i == 1 for t in ts}) == 7 + 3


def test_subjects_reach_over_many_hops_and_unsettled_rounds_raise(spark):
    words = ["kelmor", "bavuni", "tizgad", "rulpex", "womfit", "dagrun", "pikloz", "nebvar", "hostum", "gyrfal", "zembok", "fuwlid"]
    texts = [f"{words[0]}."] * 12 + [f"{a}. {b}." for a, b in zip(words, words[1:], strict=False) for _ in range(12)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, "law") for i in range(12)], "doc_id bigint, subject string")
    listed = spark.createDataFrame([("law", "law"), ("sport", "sport")], "subject string, text string")
    got = {(r["doc_id"], r["subject"]) for r in subjects.subject_lists(d, labels, listed).collect()}
    assert got == {(i, "law") for i in range(len(texts))}
    with pytest.raises(RuntimeError, match="still change"):
        subjects.subject_lists(d, labels, listed, rounds=3)
