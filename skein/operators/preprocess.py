"""Filtering, moderation, weighting and de-duplication of the comments of many videos at once."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.settings import DEFAULT, Settings

#: Rows of one text of a video that one task may take.
HOT_ROWS = 1_000_000

# Words and patterns that define which comments carry no content. Texts are matched in lower case.
EMOTION = r"^((ха{2,}|хе{2,}|хи{2,}|хо{2,})|(лол+|lol+|ку{2,}|кек+)|(ого+|вау|wow+|вот это да)|(👍|👎|❤|🔥|💯|😂|😭|🤣|😅|😊|🙏)|(\+{2,}|-{2,}|={2,}))\.?!?$"
PRAISE = r"^((спасибо|благодарю|thanks|thank you)|(молодец|отлично|супер|класс|круто|топ)|(great|nice|good|cool|awesome|perfect)|(респект|уважуха|браво|bravo)|(❤|🔥|👍|💯))\.?!?$"
META = r"((первый|first|кто\s+(смотрит|читает))|(алгоритм|algorithm|рекоменд|recommend)|(лайк|like\s+(если|if)|подпиш|subscribe)|(закреп|pin(ned)?|топ\s+комент)|(коммент|comment\s+section))"
EMPTY_QUESTION = r"^((когда|when)\s+(видео|выпуск|новое|video|episode)|(кто|who)\s+(смотрит|сюда|here|watching)|(где|where)\s+(видео|часть|video|part)|(почему нет|why no|где|where is)\s+(субтитр|subtitle|перевод))\??\.?$"
SPAM = r"(t\.me/|wa\.me/|telegram|телеграм|промокод|promo code|подпиш(ись|итесь)|заработа|реферал|referral|мой канал)"
PROFANITY = T.whole_word("бляд|бля|сука|сучк|хуй|хуе|пизд|ебан|ебат|мудак|дебил|идиот|тварь|ублюд|fuck|fucking|shit|bitch|asshole|moron|idiot")
CLAIM = T.whole_word("потому|поэтому|считаю|думаю|поддерживаю|против|не соглас|лож|прав|винов|нужно|должн|надо")
STOPWORDS = ("это", "как", "что", "для", "или", "если", "про", "все", "просто", "очень", "this", "that", "with", "from", "have", "about")


def low_content(t: Column, w: Column) -> Column:
    """Reactions, bare praise, remarks about comments, empty questions, and a few stopwords."""
    low, n = F.lower(T.squeezed(t)), F.size(w)
    claim = low.rlike(CLAIM)
    stops = F.size(F.filter(w, lambda x: F.lower(x).isin(*STOPWORDS))) / F.greatest(n, F.lit(1))
    return ((n <= 5) & low.rlike(EMOTION)) | ((n <= 4) & low.rlike(PRAISE)) | ((n <= 6) & low.rlike(META) & ~claim) | ((n <= 8) & low.rlike(EMPTY_QUESTION)) | ((n <= 5) & ~claim & (stops > 0.6))


def low_signal(t: Column, w: Column, s: Settings = DEFAULT) -> Column:
    """Repeated characters, few letters, many symbols, or few different words."""
    n, diversity = F.size(w), T.lexical_diversity(w)
    # a word that makes up 70 % of six words or more leaves a diversity below 0.5, so few rows are counted
    same = (diversity < s.min_diversity) | ((diversity < 0.5) & (T.top_token_share(w) >= 0.7))
    return T.repeats(F.lower(t)) | (T.alpha_count(t) < s.min_alpha) | ((n <= 10) & (T.symbol_ratio(t) > s.max_symbol_ratio)) | ((n >= 6) & same)


def spam_link(raw: Column, t: Column) -> Column:
    low = F.lower(raw)
    links = T.count_matches(low, T.URL)
    return (links >= 2) | low.rlike(SPAM) | F.lower(t).rlike(SPAM) | ((links >= 1) & (low.contains("promo") | low.contains("промо")))


def position_signal(t: Column, topic: Column, s: Settings = DEFAULT) -> Column:
    """A claim word, or words shared with the video's own."""
    shared = F.size(F.array_intersect(T.token_set(t, 4, STOPWORDS), topic))
    return F.lower(t).rlike(CLAIM) | F.coalesce(shared >= s.topic_overlap, F.lit(False))


def borderline_score(t: Column, w: Column, position: Column, profane: Column) -> Column:
    n = F.size(w)
    base = F.when(n.between(3, 6), 0.35).when(n <= 2, 0.12).otherwise(0.20)
    score = base - F.when(position, 0.22).otherwise(0.0) + F.when(profane, 0.18).otherwise(0.0) + F.when(t.contains("?"), 0.07).otherwise(0.0) + F.when(T.repeats(F.lower(t)), 0.10).otherwise(0.0)
    score = score + F.greatest(F.lit(0.0), F.lit(0.3) - T.lexical_diversity(w)) * 0.5
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def engagement_weight(likes: Column, replies: Column, n_words: Column, published: Column, video_published: Column, s: Settings = DEFAULT) -> Column:
    """1 + likes + replies + length + recency, each capped, and the sum capped."""
    age = F.greatest(F.lit(0.0), (F.unix_micros(F.lit(s.as_of).cast("timestamp")) - F.unix_micros(published.cast("timestamp"))) / F.lit(86_400_000_000.0))
    age = age + F.when(published < video_published, 1.0).otherwise(0.0)
    recency = F.greatest(F.lit(0.0), 1.0 - F.log1p(age) / 4.0)
    total = 1.0 + F.least(F.coalesce(likes, F.lit(0)), F.lit(100)) * 0.03 + F.least(F.coalesce(replies, F.lit(0)), F.lit(30)) * 0.08 + F.least(n_words / 45.0, F.lit(1.0)) + recency
    return F.least(total, F.lit(s.weight_max))


def topic_tokens(videos: DataFrame) -> DataFrame:
    """Video id, time of publication, and the distinct long words of title and description."""
    both = F.concat_ws(" ", "title", "description")
    return videos.select(F.col("id").alias("video_id"), F.col("published_at").alias("video_published_at"), T.token_set(both, 4, STOPWORDS).alias("topic"))


def preprocess(comments: DataFrame, videos: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Every comment with its filter reason (null if kept), moderation and weight.

    The reasons are tried in a fixed order and duplicates are ranked, by video and text, only
    among comments that no earlier reason removed. The videos are joined by a broadcast that
    Spark chooses by size. Duplicates are counted by partial aggregation and joined back. What the
    counts and the rows both need is kept on the executors' disks (``persist``) until the session
    frees it; a lost executor's part is worked out again.
    """
    c = comments.join(topic_tokens(videos), "video_id", "left")
    c = c.withColumns({"raw": T.stripped(F.coalesce("text_raw", F.lit("")))}).withColumn("text_normalized", T.normalized(F.col("raw"))).withColumn("w", T.words(F.col("text_normalized")))
    raw, t, w = F.col("raw"), F.col("text_normalized"), F.col("w")
    early = (
        F.when(raw == "", "empty")
        .when(F.size(w) < s.min_words, "too_short")
        .when(T.is_noise(t) | T.is_url_only(raw), "noise")
        .when(low_content(t, w), "low_content")
        .when(low_signal(t, w, s), "low_signal")
    )
    c = c.withColumns({"early": early, "profane": F.lower(t).rlike(PROFANITY), "position": position_signal(t, F.col("topic"), s)})
    c = c.withColumn("score", borderline_score(t, w, F.col("position"), F.col("profane")))
    profane, position, score = F.col("profane"), F.col("position"), F.col("score")
    borderline = F.size(w).between(3, 6) & score.between(s.borderline_min, s.borderline_max)
    hard, keep_flag = F.lit(s.toxicity_policy == "hard_delete"), F.lit(s.toxicity_policy == "keep_flag")

    def decision(action: str, reason: str | None, source: str, value: Column) -> Column:
        return F.struct(F.lit(action).alias("action"), F.lit(reason).cast("string").alias("reason"), F.lit(source).alias("source"), value.cast("double").alias("score"))

    ruled = (
        F.when(spam_link(raw, t), decision("drop", "spam_link", "rule", F.lit(0.98)))
        .when(profane & hard, decision("drop", "profanity", "rule", F.lit(0.94)))
        .when(profane & position & keep_flag, decision("flag", "toxic_with_position", "rule", F.lit(0.72)))
        .when(profane & ((F.size(w) <= s.profanity_only_words) | ~position), decision("drop", "profanity_only", "rule", F.lit(0.90)))
        .when(profane, decision("flag", "toxic_with_position", "rule", F.lit(0.68)))
        .when(borderline, decision("keep", "borderline_for_llm", "fallback", score))
        .otherwise(decision("keep", None, "rule", score))
    )
    c = c.withColumn("ruled", ruled).withColumn("early", F.coalesce("early", F.when(F.col("ruled.action") == "drop", F.col("ruled.reason"))))
    key = F.when(F.length(t) > 0, t).otherwise(F.coalesce("text_raw", F.lit("")))
    c = c.withColumn("text_hash", T.text_hash(F.lower(key)))
    c = c.withColumn("base", engagement_weight(F.col("like_count"), F.col("reply_count"), F.size(T.words(key)), F.col("published_at"), F.col("video_published_at"), s))
    # what is known of a row alone is worked out once and kept on disk, as it is read for the counts and for the rows
    c = c.select("comment_id", "video_id", "author_name", "text_normalized", "text_hash", "early", "ruled", "base").persist(StorageLevel.DISK_ONLY)
    c = with_repeats(c, ["video_id", "text_hash"], "comment_id", F.col("early").isNull())
    reason = F.coalesce("early", F.when(F.col("comment_id") > F.col("first_id"), "duplicate"))
    weight = F.col("base")
    flagged = F.least(F.lit(s.weight_max), weight * s.flagged_multiplier)
    kept = F.when(F.col("ruled.action") == "flag", flagged).otherwise(weight)
    boost = F.when(F.col("copies") > 1, F.least(F.lit(1.25), F.least(F.lit(7), F.col("copies") - 1) * 0.18)).otherwise(0.0)
    c = c.withColumn("filter_reason", reason)
    dropped = F.col("filter_reason").isNotNull()
    return c.select(
        "comment_id", "video_id", "author_name", "text_normalized", "text_hash", "filter_reason", dropped.alias("is_filtered"),
        F.when(dropped, "drop").otherwise(F.col("ruled.action")).alias("moderation_action"),
        F.when(dropped, F.col("filter_reason")).otherwise(F.col("ruled.reason")).alias("moderation_reason"),
        F.when(dropped & (F.col("ruled.action") != "drop"), "rule").otherwise(F.col("ruled.source")).alias("moderation_source"),
        F.when(~dropped | (F.col("filter_reason") == F.col("ruled.reason")), F.col("ruled.score")).alias("moderation_score"),
        F.when(dropped, F.least(F.lit(0.5), weight)).otherwise(F.least(F.lit(s.weight_max), kept + boost)).alias("weight"),
    )


def with_repeats(df: DataFrame, keys: list[str], id_col: str, counted: Column, most: int = HOT_ROWS) -> DataFrame:
    """``df`` with first_id and copies of the counted rows with equal ``keys``; null and null where there is one row or none.

    Groups are counted by partial aggregation. Groups with more than ``most`` rows, of which there
    are at most rows / ``most``, meet their rows by broadcast; a random salt keeps those rows apart
    in the join of the other groups, so that no task takes a group as a whole. Rows that are not
    counted get no group and are spread in the same way.
    """
    key = F.struct(*keys).alias("group")  # structs with equal nulls are equal
    g = df.filter(counted).groupBy(key).agg(F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    hot = g.filter(F.col("copies") > most).select("group", F.struct("first_id", "copies").alias("hot"))
    cold = g.filter(F.col("copies") <= most).select("group", F.struct("first_id", "copies").alias("cold"), F.lit(0).alias("salt"))
    apart = F.when(F.col("hot").isNotNull() | ~counted, F.pmod(F.xxhash64(id_col), F.lit(1 << 20)).cast("int") + 1).otherwise(0)
    out = df.withColumn("group", key).join(F.broadcast(hot), "group", "left").withColumn("salt", apart).join(cold, ["group", "salt"], "left")
    found = F.when(counted, F.coalesce("hot", "cold"))
    return out.withColumns({"first_id": found["first_id"], "copies": found["copies"]}).drop("group", "hot", "cold", "salt")


def reason_counts(df: DataFrame, reason: str) -> DataFrame:
    """Number of rows by reason, blank ones as unspecified, most frequent first."""
    named = F.coalesce(F.nullif(T.stripped(F.col(reason)), F.lit("")), F.lit("unspecified"))
    return df.groupBy(named.alias("reason")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason")


def moderation_totals(df: DataFrame) -> DataFrame:
    a, f = F.col("moderation_action"), F.col("is_filtered")
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(f).alias("dropped"), F.count_if(~f & (a == "flag")).alias("flagged"), F.count_if(~f & (a != "flag")).alias("kept"))


def first_by(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key by ``order``, which must be unique within a key."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter("_place = 1").drop("_place")
