"""Column functions over comment texts. Patterns use explicit classes, so that JVM and RE2 agree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One character of white space, of a word, and outside words.
WS = r"[\s\p{Z}]"
W = r"[\p{L}\p{N}_]"
NOT_W = r"[^\p{L}\p{N}_]"
URL = r"https?://[^\s\p{Z}]+|www\.[^\s\p{Z}]+"
URL_ONLY = rf"^(?:{URL})$"
CYRILLIC = r"[А-Яа-яЁё]"


def whole_word(alternatives: str) -> str:
    """Pattern for the alternatives as whole words of a lower-case text."""
    return rf"(^|{NOT_W})(?:{alternatives})($|{NOT_W})"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def squeezed(c: Column) -> Column:
    """White space collapsed to single spaces, none at the ends."""
    return stripped(F.regexp_replace(c, rf"{WS}+", " "))


def normalized(c: Column) -> Column:
    """Text without links, white space collapsed."""
    return squeezed(F.regexp_replace(c, rf"(?i){URL}", " "))


def words(c: Column, least: int = 1) -> Column:
    """Array of the words of at least ``least`` characters, in order."""
    return F.regexp_extract_all(c, F.lit(f"{W}{{{least},}}"), F.lit(0))


def token_set(c: Column, least: int, stopwords: Sequence[str]) -> Column:
    """Distinct lower-case words of at least ``least`` characters without the stopwords, sorted."""
    tokens = F.array_distinct(words(F.lower(c), least))
    return F.array_sort(F.array_except(tokens, F.array(*map(F.lit, stopwords)).cast("array<string>")))


def text_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def is_noise(c: Column) -> Column:
    """Empty, without a letter or digit, or at most three characters besides spaces."""
    return (c == "") | ~c.rlike(r"[\p{L}\p{N}]") | (F.length(F.replace(c, F.lit(" "), F.lit(""))) <= 3)


def is_url_only(c: Column) -> Column:
    return F.lower(c).rlike(URL_ONLY)


def has_cyrillic(c: Column) -> Column:
    return c.rlike(CYRILLIC)


def count_matches(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def clipped(c: Column, most: int) -> Column:
    """At most ``most`` characters, three dots in place of the rest."""
    cut = F.regexp_replace(F.substring(c, 1, most - 3), r"[ ,;:\-]+$", "")
    return F.when(F.length(c) <= most, c).otherwise(F.concat(cut, F.lit("...")))


def clipped_words(c: Column, most: int = 220) -> Column:
    """First and last words of a long text around an ellipsis; the tail has min(40, most / 3) words."""
    tail = min(40, most // 3)
    w = F.split(squeezed(c), " ")
    both = F.concat_ws(" ", F.slice(w, 1, most - tail), F.lit("..."), F.slice(w, -tail, tail))
    return F.when(F.size(w) <= most, squeezed(c)).otherwise(both)


def compacted(c: Column) -> Column:
    """Lower case without anything but letters and digits."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def first_filled(*cs: Column) -> Column:
    """The first value that is neither null nor blank, stripped."""
    return F.coalesce(*[F.nullif(stripped(c), F.lit("")) for c in cs])


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two sets; 0 where one is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def repeats(c: Column, times: int = 6) -> Column:
    """Whether one character stands ``times`` times in a row."""
    return c.rlike(rf"(.)\1{{{times - 1},}}")


def lexical_diversity(w: Column) -> Column:
    low = F.transform(w, F.lower)
    return F.size(F.array_distinct(low)) / F.greatest(F.size(w), F.lit(1))


def top_token_share(w: Column) -> Column:
    """Share of the most frequent word."""
    low = F.transform(w, F.lower)
    # what is left without a word is counted by a built-in pass, not by a lambda for each pair
    rest = F.transform(F.array_distinct(low), lambda x: F.size(F.array_remove(low, x)))
    return F.coalesce(F.try_divide(F.size(w) - F.array_min(rest), F.size(w)), F.lit(0.0))


def symbol_ratio(c: Column) -> Column:
    """Share of characters that are neither letter nor digit, spaces aside."""
    solid = F.regexp_replace(c, rf"{WS}+", "")
    return F.coalesce(F.try_divide(F.length(F.regexp_replace(solid, r"[\p{L}\p{N}]+", "")), F.length(solid)), F.lit(1.0))


def alpha_count(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}]+", ""))


def video_id_of(url: Column) -> Column:
    """Video id of a bare id, a short link, a watch page, or a shorts or live page; null if there is none."""
    t = stripped(url)
    plain = F.when(t.rlike(r"^[A-Za-z0-9_-]{11}$"), t)
    found = [F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in (r"youtu\.be/([A-Za-z0-9_-]{6,})", r"[?&]v=([A-Za-z0-9_-]{6,})", r"/(?:shorts|live|embed)/([A-Za-z0-9_-]{6,})")]
    return F.coalesce(plain, *found)
