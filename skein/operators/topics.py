"""Text analytics of clusters: keywords, intents, sentiment, titles, quotes, near duplicates."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from skein.functions import text as T

# Words without meaning for labels, those for titles and descriptions (nine more), and frequent words of little value for either.
LABEL_STOPWORDS = (
    "это", "как", "что", "для", "или", "если", "про", "все", "сегодня", "завтра", "когда", "очень", "тоже", "почему", "просто", "чтобы", "который", "которые", "потому", "будет", "нужно", "можно", "канал", "видео", "news", "video", "comments",
)
STOPWORDS = (
    "это", "как", "что", "для", "или", "если", "про", "все", "сегодня", "завтра", "когда", "очень", "тоже", "почему", "просто", "чтобы", "который", "которые", "потому", "будет", "нужно", "можно", "канал", "видео", "news", "video", "comments",
    "того", "только", "этого", "этом", "этой", "такой", "такая", "такие", "именно",
)
LABEL_LOW_VALUE = (
    "more", "most", "very", "just", "only", "than", "then", "this", "that", "they", "them", "their", "about", "более", "менее", "теперь", "просто", "только", "его", "ее", "их", "они", "она", "оно", "ваш", "ваши", "наш", "наши",
)
LOW_VALUE = ("более", "менее", "теперь", "просто", "только", "его", "ее", "её", "их", "они", "она", "оно", "their", "about", "very", "just")
POSITIVE = ("спасибо", "класс", "отлично", "поддерживаю", "супер", "хорошо")
NEGATIVE = ("ложь", "проблема", "плохо", "ужас", "бред", "ошибка", "скандал", "негатив")
INTENTS = (
    ("question", ("?",)),
    ("request", ("прошу", "пожалуйста", "сделайте", "расскажите")),
    ("complaint", ("плохо", "ошибка", "неправда", "бред", "ложь")),
    ("praise", ("спасибо", "класс", "отлично", "лучший")),
    ("suggestion", ("можно", "стоит", "предлагаю", "лучше")),
    ("joke", ("ха", "лол", "шутка", "мем")),
)
GENERIC_TITLE = (
    "comment", "comments", "topic", "topics", "discussion", "комментарии", "обсуждение", "разбор", "новости", "видео", "политика", "спасибо", "дело", "меня", "ваши", "есть", "просто", "вообще",
)
FUNCTION_WORDS = (
    "и", "а", "но", "или", "что", "как", "это", "для", "все", "они", "он", "она", "мы", "вы", "то", "не", "да", "нет", "уже", "еще", "его", "ее", "их", "мне", "нам", "вам", "был", "была", "было", "были", "быть", "при", "без", "под", "над", "между",
)
NO_TITLE = ("misc", "other", "разное", "прочее")
BAD_TITLE = T.whole_word("разное|прочее|misc|other|комментарии|обсуждение|разбор|новости|видео|политика|спасибо|дело|меня|ваши|есть|просто|вообще")


def intent(t: Column) -> Column:
    """The first intent with a word in the text, in the order of INTENTS."""
    low = F.lower(t)
    out = F.lit("other")
    for name, signs in reversed(INTENTS):
        found = low.contains(signs[0])
        for s in signs[1:]:
            found = found | low.contains(s)
        out = F.when(found, name).otherwise(out)
    return out


def sentiments(comments: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Mood of each cluster by votes of words: one side must lead by more than one."""
    w = F.transform(T.words(F.lower(F.col(text)), 3), lambda x: F.when(x.isin(*POSITIVE), 1).when(x.isin(*NEGATIVE), -1).otherwise(0))
    votes = comments.select(*keys, F.size(F.filter(w, lambda v: v == 1)).alias("p"), F.size(F.filter(w, lambda v: v == -1)).alias("n"))
    g = votes.groupBy(*keys).agg(F.sum("p").alias("positive"), F.sum("n").alias("negative"))
    mood = F.when(F.col("negative") > F.col("positive") + 1, "negative").when(F.col("positive") > F.col("negative") + 1, "positive").otherwise("neutral")
    return g.withColumn("sentiment", mood)


def keywords(comments: DataFrame, keys: Sequence[str], text: str, weight: str | None = None, most: int = 5, first: int | None = None, order: Sequence[str | Column] = (), dropped: Sequence[str] | None = None) -> DataFrame:
    """The ``most`` salient words of each cluster: frequent, but not in nearly all its comments.

    Without ``weight``, as for titles; with it, as for labels, with the label's lists of words and a bonus for weight.
    ``first`` reads only the first comments of a cluster by ``order``, as the rule for titles does with 24.
    Counts by cluster and word are combined before the shuffle; only then are words ranked. Equal scores go by the word.
    """
    docs = comments.filter(T.squeezed(F.col(text)) != "")
    if first is not None:
        docs = docs.withColumn("_at", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_at") <= first)
    n = docs.groupBy(*keys).agg(F.count(F.lit(1)).alias("docs"))
    w = F.greatest(F.lit(0.1), F.col(weight)) if weight else F.lit(0.0)
    out = dropped if dropped is not None else (*LABEL_STOPWORDS, *LABEL_LOW_VALUE) if weight else (*STOPWORDS, *LOW_VALUE)
    words = F.filter(T.words(F.lower(F.col(text)), 4), lambda x: ~x.isin(*out) & ~x.rlike(r"^\p{N}+$"))
    tokens = docs.select(*keys, w.alias("w"), words.alias("words")).select(*keys, "w", F.explode(F.transform(F.array_distinct("words"), lambda x: F.struct(x.alias("token"), (F.size("words") - F.size(F.array_remove("words", x))).alias("tf")))).alias("t"))
    g = tokens.groupBy(*keys, F.col("t.token").alias("token")).agg(F.sum("t.tf").alias("tf"), F.count(F.lit(1)).alias("df"), F.sum(F.col("w") * F.col("t.tf")).alias("weight"))
    g = g.join(n, list(keys)).withColumn("share", F.col("df") / F.col("docs"))
    g = g.filter((F.col("tf") >= F.when(F.col("docs") >= 6, 2).otherwise(1)) & (F.col("share") <= 0.72))
    g = g.withColumn("score", F.round(F.col("tf") * (1.6 - F.col("share")) + 0.35 * F.col("weight") / F.col("docs"), 6))
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), "token"))
    return g.withColumn("place", place).filter(F.col("place") <= most).select(*keys, "token", "tf", "df", "score", "place")


def title_words(title: Column) -> Column:
    return F.filter(T.words(F.lower(title)), lambda x: ~x.isin(*GENERIC_TITLE, *FUNCTION_WORDS))


def valid_title(title: Column, support: Column | None = None) -> Column:
    """3 to 10 words, no slash, at least two words with meaning, or three if one is generic.

    ``support`` is a lower-case text, of the first 80 comments of the cluster, that must hold one of the first four words with meaning.
    """
    t = T.stripped(F.regexp_replace(T.squeezed(title), r"^[ \-:;,.]+|[ \-:;,.]+$", ""))
    n, good = F.size(T.words(t)), title_words(t)
    ok = ~t.rlike(r"[/\\]") & n.between(3, 10) & (F.size(good) >= 2) & ~(F.lower(t).rlike(BAD_TITLE) & (F.size(good) < 3)) & ~F.exists(T.words(F.lower(t)), lambda w: w.isin(*NO_TITLE))
    return ok if support is None else ok & F.exists(F.slice(good, 1, 4), lambda w: F.contains(F.coalesce(support, F.lit("")), w))


def single_claim(title: Column) -> Column:
    """No list marks, at most one comma and colon, and no two joined claims."""
    t = F.lower(T.squeezed(title))
    joined = T.whole_word("и|или|and|or|but")
    twice = rf"(^|{T.NOT_W})(?:и|или|and|or){T.NOT_W}(.*{T.NOT_W})?(?:и|или|and|or)($|{T.NOT_W})"
    return (t != "") & ~t.rlike(r"[/\\;|]") & (T.count_matches(t, ":") <= 1) & (T.count_matches(t, ",") <= 1) & ~(t.contains(":") & t.rlike(joined)) & ~t.rlike(twice)


def detailed(description: Column) -> Column:
    """At least 96 characters, two sentence ends and eight different words."""
    t = T.squeezed(description)
    return (F.length(t) >= 96) & (T.count_matches(t, "[.!?]") >= 2) & (F.size(T.token_set(t, 4, STOPWORDS)) >= 8)


def support_score(description: Column, comment: Column) -> Column:
    """Share of the description's words, ten at most, that a comment holds."""
    d, c = T.token_set(description, 4, STOPWORDS), T.token_set(comment, 4, STOPWORDS)
    return F.when((F.size(d) == 0) | (F.size(c) == 0), 0.0).otherwise(F.size(F.array_intersect(d, c)) / F.greatest(F.lit(1), F.least(F.lit(10), F.size(d))))


#: Characters of an indexed piece; least characters of a quote that is looked up without marks, and as it is.
PIECE, BARE, PLAIN = 8, 22, 26


def _least_hashes(texts: Sequence[str], least: int, masks: Sequence[str] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of texts and, for each, the different least hashes of the pieces of PIECE characters of its windows of ``least`` characters.

    All texts are hashed as one array, in time that grows with their characters. A text contained in another has each of its
    hashes in common with it; texts below ``least`` characters have none. With ``masks``, where every letter and digit is
    an a, only windows with less than BARE of these count.
    """
    codes = lambda ts: np.frombuffer("".join(ts).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    h = codes(texts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    if len(h) < least:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    width = 1
    while width < PIECE:  # doubles the hashed characters
        h = h[:-width] * np.uint64(0xD6E8FEB86659FD93) + h[width:]
        h ^= h >> np.uint64(29)
        width *= 2
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    width, pieces = 1, least - PIECE + 1
    while width < pieces:  # least of ever more neighbours
        step = min(width, pieces - width)
        h = np.minimum(h[:-step], h[step:])
        width += step
    at, end = np.repeat(np.arange(len(n)), n)[: len(h)], np.repeat(np.cumsum(n), n)[: len(h)]
    counted = np.arange(len(h)) + least <= end  # windows within one text
    if masks is not None:
        letters = np.concatenate([[0], np.cumsum(codes(masks) == ord("a"))])
        counted &= letters[least:] - letters[:-least] < BARE
    for sort in (False, True):  # neighbours repeat most of them
        at, h = at[counted], h[counted]
        if sort:
            order = np.lexsort((h, at))
            at, h = at[order], h[order]
        counted = np.ones(len(h), bool)
        counted[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
    return at[counted], h[counted].view(np.int64)


def _indexed(df: DataFrame, text: str, quotes: bool) -> DataFrame:
    """A row for each least hash _h of the column ``text`` without marks, and as it is where it has many, in place of it; of quotes of either."""
    kept = [c for c in df.columns if c != text]
    bare = T.compacted(F.col(text))
    plain = F.when(F.length(bare) < BARE, F.col(text)).otherwise("") if quotes else F.col(text)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            plain = _least_hashes(b.column("_plain").to_pylist(), PLAIN, b.column("_mask").to_pylist())
            for at, h in (_least_hashes(b.column("_bare").to_pylist(), BARE), (plain[0], ~plain[1])):
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(at)) for c in kept), pa.array(h)], [*kept, "_h"])

    forms = df.select(*kept, plain.alias("_plain"), bare.alias("_bare"), F.regexp_replace(plain, r"[\p{L}\p{N}]", "a").alias("_mask"))
    return forms.mapInArrow(index, Y.StructType([*(df.schema[c] for c in kept), Y.StructField("_h", Y.LongType())]))


def _contained(quotes: DataFrame, texts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Quotes (keys, q) with the best tier and first text (keys, t, first) that holds them.

    Texts and quotes are indexed by the least hashes of windows. A text that holds a quote holds all its hashes, so a quote is
    compared only with texts that hold the rarest of them, never with all comments of its group. What a text holds as it is, it
    also holds without marks; only quotes of few letters and digits are looked up as they are.
    """
    by = [*keys, "_h"]
    q = _indexed(quotes.select(*keys, "q", F.col("q").alias("_f")), "_f", quotes=True)
    index = _indexed(texts.select(*keys, F.col("first.comment_id").alias("_c"), F.col("t").alias("_f")), "_f", quotes=False)
    index = index.join(q.select(*by).distinct(), by).groupBy(*by).agg(F.collect_list("_c").alias("_in"))
    rarest = q.join(index, by).groupBy(*keys, "q").agg(F.min_by("_in", F.struct(F.size("_in"), "_h")).alias("_in"))
    t = texts.select(*keys, F.col("first.comment_id").alias("_c"), "t", "first")
    j = rarest.select(*keys, "q", F.explode("_in").alias("_c")).join(t, [*keys, "_c"])
    b = T.compacted(F.col("q"))
    tier = F.when((F.length("q") >= PLAIN) & F.contains("t", "q"), 1).when((F.length(b) >= BARE) & F.contains(T.compacted(F.col("t")), b), 2)
    best = j.withColumn("tier", tier).filter("tier IS NOT NULL").groupBy(*keys, "q").agg(F.min(F.struct("tier", "first")).alias("_m"))
    return best.select(*keys, "q", "_m.first", "_m.tier")


def matched_quotes(quotes: DataFrame, comments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For each quote the comment of its cluster that it was taken from: equal, else held, else held without marks;
    of several the first by rank.

    Equality is a hash join of different texts. What is left is looked up by an index of pieces.
    Quotes below 26 characters, or 22 without marks, are matched by equality only.
    """
    norm = lambda c: F.lower(T.squeezed(c))
    quotes, comments = quotes.dropna(subset=[*keys]), comments.dropna(subset=[*keys])
    q = quotes.select(*keys, "quote_id", norm(F.col("quote")).alias("q")).filter("q <> ''")
    # all that read t ask for the same rows and columns, so that Spark shuffles the texts once
    t = comments.select(*keys, norm(F.col("text")).alias("t"), F.struct("rank", "comment_id").alias("first")).filter("t <> ''").groupBy(*keys, "t").agg(F.min("first").alias("first"))
    looked = q.select(*keys, "q").distinct().join(t.withColumnRenamed("t", "q"), [*keys, "q"], "left")
    equal = looked.filter("first IS NOT NULL").withColumn("tier", F.lit(0))
    found = equal.unionByName(_contained(looked.filter("first IS NULL"), t, keys))
    return q.join(found, [*keys, "q"]).select(*keys, "quote_id", F.col("first.comment_id").alias("comment_id"), "tier")


def without_near_duplicates(ranked: DataFrame, group: str, threshold: float = 0.9) -> DataFrame:
    """Rows of a group (columns id, rank, text) in rank order, without those that repeat an earlier kept one.

    A text repeats another if it is equal but for case, or if their word sets overlap by
    ``threshold``. The choice depends on the order, so one task reads one group, such as the
    comments of one topic; an index from words to kept rows keeps the comparisons few.
    """

    def keep(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["rank", "id"])
        seen: set[str] = set()
        sets: list[set[str]] = []
        index: dict[str, list[int]] = {}
        kept = []
        for text, tokens in zip(part["text"], part["tokens"], strict=True):
            key, words = text.lower(), set(tokens)
            near = key in seen
            if not near and words:
                shared: dict[int, int] = {}
                for w in words:
                    for i in index.get(w, ()):
                        shared[i] = shared.get(i, 0) + 1
                near = any(n / (len(words) + len(sets[i]) - n) >= threshold for i, n in shared.items())
            kept.append(not near)
            if not near:
                seen.add(key)
                for w in words:
                    index.setdefault(w, []).append(len(sets))
                sets.append(words)
        return part.loc[kept, [group, "id", "rank"]]

    kind = dict(ranked.dtypes)
    rows = ranked.select(group, "id", "rank", T.squeezed(F.col("text")).alias("text")).filter("text <> ''").withColumn("tokens", T.token_set(F.col("text"), 4, STOPWORDS))
    return rows.groupBy(group).applyInPandas(keep, f"{group} {kind[group]}, id {kind['id']}, rank {kind['rank']}")


def unique_labels(topics: DataFrame, run: str) -> DataFrame:
    """Labels (columns ord, label, tokens by frequency) made unique within a run: the first keeps its
    label, later ones get a word of their comments, or a number."""

    def name(part: pd.DataFrame) -> pd.DataFrame:
        seen: set[str] = set()
        out = []
        for label, tokens in zip(part.sort_values("ord")["label"], part.sort_values("ord")["tokens"], strict=True):
            base = " ".join(label.split())
            choices: Iterator[str] = iter([base, *[f"{base}: {t}" for t in tokens], *[f"{base} ({n})" for n in range(2, len(part) + 3)]])
            chosen = next(c for c in choices if c.lower() not in seen)
            seen.add(chosen.lower())
            out.append(chosen)
        return part.sort_values("ord")[[run, "ord"]].assign(label=out)

    kind = dict(topics.dtypes)
    return topics.groupBy(run).applyInPandas(name, f"{run} {kind[run]}, ord {kind['ord']}, label string")
