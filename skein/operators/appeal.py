"""Comments that address the author: rule-based categories, targets and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import text as T

_W = T.W + "*"
# Signals of the categories. Texts are matched in lower case; entries are whole words.
QUESTION = r"[?¿？]"
QUESTION_WORD = T.whole_word("почему|зачем|как|какой|какая|какие|когда|где|что|кто|можно ли|есть ли")
CRITICISM_ALT = r"не\s+соглас|неправ|ошиба|заблуждени|предвзят|не\s+верю|искажа|нужно\s+было|стоило\s+бы|лучше\s+бы|надо\s+было|не\s+так|неправильно|проблема\s+в\s+том|не\s+учит|слабый\s+аргумент|не\s+убедительно|спорн|сомнительн"
CRITICISM = T.whole_word(CRITICISM_ALT)
OFFENSIVE = T.whole_word("бляд|бля|сука|суч|хуй|хуе|хуё|пизд|ебан|ебат|ёбан|мудак|мудил|долбо[её]|дебил|идиот|мраз|твар|ублюд|гандон|гнид|чмо|урод|падл|мразот|подонок|подонк|fuck|shit|bitch|asshole|moron|retard|cunt|dumbass")
DEROGATORY = r"(?:что за бред|закрой рот|заткни|пошёл на|пошел на|иди на|катись|вали отсюда|рот закрой|больной на голову|клоун|позор|несёт чушь|несет чушь|несёт бред|несет бред|городит чушь)"
AUTHOR = T.whole_word(f"автор{_W}")
GRATITUDE = T.whole_word("спасибо|благодар|молодец|молодчин|лучший канал|так держать|здоровья|удачи|успехов|браво|респект|класс|супер|отлично|замечательн|прекрасн|великолепн|превосходн")
REQUEST = T.whole_word("сними|снимите|расскажи|расскажите|сделай|сделайте|пригласи|пригласите|рассмотри|рассмотрите|разбери|разберите|прокомментируй|прокомментируйте|пожалуйста|можно ли|хотелось бы|было бы|предлагаю|прошу|попрос")
DIRECTIVE = rf"^(сними(?:те)?|расскажи(?:те)?|сделай(?:те)?|пригласи(?:те)?|рассмотри(?:те)?|разбери(?:те)?|прокомментируй(?:те)?)($|{T.NOT_W})"
CONTENT = T.whole_word(f"видео|ролик|канал|выпуск|эфир|контент|передач{T.W}+|програм{T.W}+")
ARGUMENT = T.whole_word("потому что|так как|например|факт|доказательств|источник|ссылк|по данным|согласно|статистик|исследовани|история|на самом деле|в действительности|однако|вместе с тем|при этом")
# Signals of the target of an insult: beginnings of words, whole words, and phrases.
INSULT_STEMS = (
    "бляд", "сука", "хуй", "хуе", "хуё", "пизд", "ебан", "ебат", "ёбан", "ебал", "мудак", "мудил", "долбое", "долбоё", "дебил", "идиот", "мраз", "твар", "ублюд", "гандон", "гнид", "чмо", "лох", "шлюх", "шалав", "даун", "кретин", "недоум", "отброс", "подонок", "подонк", "урод", "падл", "мразот",
    "жид", "хач", "чурк", "нигер", "черножоп", "fuck", "shit", "bitch", "asshole", "moron", "retard", "cunt", "dumbass",
)
INSULT_WORDS = ("бля", f"суч{T.W}+")
INSULT = T.whole_word("|".join((*(s + _W for s in INSULT_STEMS), *INSULT_WORDS)))
INSULT_PHRASES = (
    "что за бред", "закрой рот", "заткни", "пошёл на", "пошел на", "иди на", "катись", "вали отсюда", "рот закрой", "больной на голову", "тупой", "тупая", "тупое", "клоун", "позор", "несёт чушь", "несет чушь", "несёт бред", "несет бред", "городит чушь",
)
INSULT_PHRASE = "(?:" + "|".join(INSULT_PHRASES) + ")"
# Offensive words of questions shown in reports, and of disagreement with the author.
OFFENSIVE_QUESTION = T.whole_word("бляд|бля|сука|сучк|хуй|хуе|пизд|ебан|ебат|мудак|дебил|идиот|мраз|твар|гандон|fuck|fucking|shit|bitch|asshole|moron|idiot")
OFFENSIVE_DISAGREEMENT = T.whole_word("бляд|бля|сука|сучк|хуй|хуе|пизд|ебан|ебат|мудак|дебил|идиот|тварь|ублюд|fuck|fucking|shit|bitch|asshole|moron|idiot")
DISAGREEMENT = T.whole_word(rf"не\s+соглас{_W}|неправ|ошиба|вводите\s+в\s+заблуждени|ложь|вр[её]т|манипул|бред|чушь|пропаганд|предвзят|не\s+верю|искажа|перекручива")
AUTHOR_WORDS = T.whole_word("вы|вас|вам|ваш")
# Ways to speak to the author, formal and familiar.
FORMAL = T.whole_word("вы|вас|вам|ваш|ваша|ваше|ваши|вашим|вашей|вашего|вашу|вами")
FAMILIAR = T.whole_word("ты|тебя|тебе|тобой|тобою|твой|твоя|твоё|твоего|твоей|твоему|твою|твоим|твоих")
ADDRESS = T.whole_word(f"вы|вас|вам|ваш|ваша|ваше|ваши|ты|тебя|тебе|тобой|твой|твоя|автор{_W}|ведущ{_W}")
SHOW = T.whole_word(f"видео|канал|выпуск|эфир|передач{T.W}+|програм{T.W}+")
VAGUE = T.whole_word("этот|эта|эти|те|тот|та|дед")


def name_pattern(names: Column) -> Column:
    """Pattern for the names of an array in any case: stems of their words without final vowels. Null if there is none."""
    parts = F.filter(F.transform(F.split(F.array_join(names, " "), r"[\s\p{Z}]+"), lambda p: F.regexp_replace(F.lower(p), r"[^\p{L}\p{N}]+", "")), lambda p: F.length(p) >= 2)
    stem = lambda p: F.regexp_replace(p, "[аеёийоуыьюя]+$", "")
    stems = F.transform(parts, lambda p: F.when(F.length(stem(p)) < 2, F.substring(p, F.lit(1), F.greatest(F.lit(2), F.length(p) - 1))).otherwise(stem(p)))
    return F.when(F.size(stems) > 0, F.concat(F.lit(f"(^|{T.NOT_W})(?:"), F.array_join(stems, "|"), F.lit(f"){_W}($|{T.NOT_W})")))


def guest_names(raw: Column) -> Column:
    """Names of a comma-separated list, blanks left out."""
    return F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), ","), lambda x: T.stripped(x)), lambda x: x != "")


def named(t: Column, pattern: Column) -> Column:
    return F.coalesce(F.regexp_like(t, pattern), F.lit(False))


def category(raw: Column, author: Column, guests: Column) -> Column:
    """toxic, question, criticism, appeal or skip, tried in this order; ``author`` and ``guests`` are name patterns."""
    t = F.lower(T.squeezed(raw))
    n = F.size(F.split(t, " "))
    by_author = named(t, author) | t.rlike(AUTHOR)
    addressed = by_author | named(t, guests) | t.rlike(CONTENT)
    offensive = t.rlike(OFFENSIVE) | t.rlike(DEROGATORY)
    question = t.rlike(QUESTION) | t.rlike(QUESTION_WORD)
    return (
        F.when(F.coalesce(n < 3, F.lit(True)), "skip")
        .when(offensive & addressed, "toxic")
        .when(question & (n >= 4) & addressed, "question")
        .when(t.rlike(CRITICISM) & (n >= 5) & addressed, "criticism")
        .when(t.rlike(REQUEST) & ~t.rlike(GRATITUDE) & (addressed | t.rlike(DIRECTIVE)), "appeal")
        .otherwise("skip")
    )


def constructiveness(raw: Column, is_question: Column) -> Column:
    """Score from 1 to 10 by length, arguments, criticism, capitals and question words."""
    text = T.squeezed(raw)
    t = F.lower(text)
    n = F.size(F.split(t, " "))
    length = F.when(n.between(8, 40), 1.0).when(n > 40, 0.5).when(n < 5, -1.5).otherwise(0.0)
    shouted = (text == F.upper(text)) & (text != t) & (F.length(text) > 15)
    score = F.lit(5.0) + length + F.when(t.rlike(ARGUMENT), 1.5).otherwise(0.0) + F.when(T.count_matches(t, CRITICISM) >= 2, 1.0).otherwise(0.0) - F.when(shouted, 2.0).otherwise(0.0) - F.when(n <= 4, 1.0).otherwise(0.0) + F.when(is_question & t.rlike(QUESTION_WORD), 0.5).otherwise(0.0)
    return F.greatest(F.lit(1), F.least(F.lit(10), F.rint(score).cast("int")))


def insult_target(raw: Column, author: Column, guests: Column) -> Column:
    """Struct of target and confidence; null for a comment that neither offends nor addresses anyone."""
    t = F.lower(T.squeezed(raw))
    offensive = t.rlike(INSULT) | t.rlike(INSULT_PHRASE)
    by_author, by_guest, by_show = t.rlike(ADDRESS) | named(t, author), named(t, guests), t.rlike(SHOW)

    def told(target: str, sure: float, mild: float) -> Column:
        return F.struct(F.lit(target).alias("target"), F.when(offensive, sure).otherwise(mild).alias("confidence"))

    told_all = F.when(by_author, told("author", 0.90, 0.55)).when(by_guest, told("guest", 0.90, 0.55)).when(by_show, told("content", 0.85, 0.50)).when(t.rlike(VAGUE), told("undefined", 0.60, 0.40)).otherwise(told("third_party", 0.30, 0.30))
    return F.when((t != "") & (offensive | by_author | by_guest | by_show), told_all)


def refers_to_author(raw: Column, name: str) -> Column:
    """Whether a text holds a word of the author's name, of three letters or more, or a formal address."""
    t = F.lower(T.squeezed(raw))
    found = t.rlike(AUTHOR_WORDS)
    for part in name.lower().split():
        if len(part) >= 3:
            found = found | F.contains(t, F.lit(part))
    return found


def author_disagreement(raw: Column, name: str) -> Column:
    """Whether a text disagrees with the author and does not offend."""
    t = F.lower(T.squeezed(raw))
    return (t != "") & ~t.rlike(OFFENSIVE_DISAGREEMENT) & refers_to_author(raw, name) & t.rlike(DISAGREEMENT)


def strict_score(score: Column, depth: Column, kind: Column) -> Column:
    """A question's score within the limits that its depth and kind set."""
    s = F.when((depth >= 7) & (kind == "clarification_needed"), F.least(score, F.lit(6))).otherwise(score)
    s = F.when(depth <= 3, F.least(s, F.lit(5))).when(depth <= 5, F.least(s, F.lit(7))).when(depth == 6, F.least(s, F.lit(8))).otherwise(s)
    s = F.when((depth >= 7) & kind.isin("analysis_why_how", "prediction_what_next", "fact_check", "myth_claim", "strategy_advice"), F.greatest(s, F.lit(7))).otherwise(s)
    return F.when(kind.isin("attack_ragebait", "meme_one_liner"), F.least(score, F.lit(3))).otherwise(F.greatest(F.lit(1), F.least(F.lit(10), s)))


def promoted(df: DataFrame, category: Column, signal: Column, kind: Column, score: Column) -> DataFrame:
    """``df`` with its category after the refiner, whose type and score are null where it gave no answer.

    Criticism with a question's signal becomes a question if the refiner names a real type. A question
    of a low-value type, or a mere clarification of low score without a signal, becomes criticism.
    """
    low = kind.isin("attack_ragebait", "meme_one_liner")
    asked = (category == "question") | (signal & F.coalesce(~low, F.lit(False)))
    weak = low | ((kind == "clarification_needed") & (score <= 5) & ~signal)
    return df.withColumn("category", F.when(~asked, "criticism").when(F.coalesce(weak, F.lit(False)), "criticism").otherwise("question"))


def block_detail(refined: Column, confidence: Column, target: Column) -> Column:
    """Detail JSON of a block item; fields that are null are left out."""
    return F.to_json(F.struct(*[refined[f].alias(f) for f in ("score", "topic", "short", "depth_score", "question_type")], confidence.alias("confidence_score"), target.alias("insult_target")))
