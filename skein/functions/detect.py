"""Language of a comment for routing: function words and letters. A column function; a model may take its place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions import text as T

# Frequent function words, and letters that only one of the languages has.
WORDS = {
    "ru": ("и", "в", "не", "на", "что", "с", "как", "это", "по", "но", "из", "у", "за", "от", "так", "для", "вы", "уже", "про", "где", "почему", "очень", "или", "если", "только", "был", "мы", "я"),
    "uk": ("і", "в", "не", "на", "що", "з", "як", "це", "та", "але", "із", "у", "за", "від", "так", "для", "ви", "вже", "про", "де", "чому", "дуже", "або", "якщо", "тільки", "був", "ми", "я"),
    "en": ("the", "and", "of", "to", "in", "is", "that", "it", "for", "was", "on", "are", "with", "this", "not", "but", "you", "from", "have", "why", "what", "about", "my", "an", "who", "at", "be", "so"),
    "de": ("der", "die", "das", "und", "in", "ist", "nicht", "ein", "zu", "mit", "auf", "für", "den", "ich", "aber", "auch", "war", "so", "wie", "von", "dem", "es", "bei", "sie", "uns", "warum", "über", "ihr"),
    "es": ("el", "la", "de", "que", "y", "en", "un", "los", "las", "se", "no", "con", "por", "una", "su", "para", "es", "al", "lo", "como", "pero", "sus", "del", "muy", "más", "qué", "sobre", "sin"),
}
LETTERS = {"ru": "ыэъё", "uk": "іїєґ", "en": "", "de": "äöüß", "es": "ñ¿¡áí"}


def detected(c: Column) -> Column:
    """ru, uk, en, de, es, or null where no function word and no telling letter is found.

    A function word counts one, and so does a letter that only one language has, once a text; the first
    language of the list wins ties.
    """
    low = F.lower(c)
    words = F.array_distinct(T.words(low))

    def score(lang: str) -> Column:
        n = F.size(F.array_intersect(words, F.array(*map(F.lit, WORDS[lang]))))
        return n + F.when(low.rlike(f"[{LETTERS[lang]}]"), 1).otherwise(0) if LETTERS[lang] else n

    scores = [F.struct(score(lang).alias("n"), F.lit(-i).alias("neg"), F.lit(lang).alias("lang")) for i, lang in enumerate(WORDS)]
    best = F.greatest(*scores)
    return F.when(best["n"] > 0, best["lang"])
