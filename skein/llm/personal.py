"""Problem 2: personal information inside free text (candidate spans, boosted trees, thresholds)."""

from __future__ import annotations

import random
import re
import unicodedata
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import names as N
from skein.llm.normal_form import LOOK_ALIKE
from skein.llm.trees import Trees, boost

KINDS = ("email", "phone", "id_number", "street_address", "person_name")
GIVEN = N.given_names()

# Ways to write @ and the dot of an address.
AT = r"(?:\s?@\s?|\s?[(\[{<]\s?(?:at|@|собака)\s?[)\]}>]\s?|\s(?:собака|собачка|равлик|arroba)\s)"
SPOKEN_AT = r"(?:\s(?:at|ät)\s)"
DOT = r"(?:\.|\s?[(\[{<]\s?(?:dot|точка|крапка|punkt|punto)\s?[)\]}>]\s?|\s(?:точка|крапка|dot|punkt|punto)\s)"
EMAIL = re.compile(rf"(?<![\w.+-])[\w+-]+(?:\.[\w+-]+)*{AT}[\w-]+(?:{DOT}[a-z0-9-]+)+", re.I)
SPOKEN_EMAIL = re.compile(rf"(?<![\w.+-])[\w+-]+(?:\.[\w+-]+)*{SPOKEN_AT}[\w-]+(?:\s(?:dot|punkt|punto|точка)\s[a-z0-9-]+)+", re.I)
NUMBER = re.compile(r"(?<![\w.,@#-])(?:\+\s?|\()?(?:[A-Z]{1,3}[\s-]?(?=\d))?\d(?:[\s()./№–-]{0,3}[\dA-Z](?![a-zа-яё])){4,22}(?![\w])")
# Words for kinds of streets, houses and flats.
STREET = r"(?:улица|улице|улицы|улицу|ул|проспект|проспекте|проспекта|просп|пр-т|пр-кт|переулок|переулке|переулка|пер|бульвар|бульваре|бульвара|б-р|шоссе|площадь|площади|пл|набережная|набережной|наб|проезд|проезде|тупик|аллея|аллее|вулиця|вулиці|вулицю|вул|провулок|провулку|пров|проспекті|бульварі|площа|площі|набережна)"
HOUSE = r"(?:дом|доме|дома|д|буд|будинок|будинку|строение|стр|владение)"
NO = r"\d{1,4}(?!\d)(?:\s?[а-яa-z](?![а-яёa-z])|[/-]\d{1,4})?"
NAME = r"[^\W\d_][\w'’-]*(?:\s[^\W\d_][\w'’-]*)?"
CYRILLIC_ADDRESS = re.compile(
    rf"(?:(?<!\w){STREET}\.?\s{{0,2}}{NAME},?\s{{0,2}}(?:{HOUSE}\.?\s?)?№?\s?{NO}"
    rf"|(?<!\w)[^\W\d_][\w-]{{0,40}}(?:ий|ый|ой|ая|ський|цький|ська|ого|ом)\s(?:{STREET})\.?,?\s{{0,2}}(?:{HOUSE}\.?\s?)?№?\s?{NO}"
    rf"|(?<!\w)\d{{1,4}}(?:-?[йяі])?\s{HOUSE}\s(?:на|по)\s{STREET}\.?\s{NAME}"
    rf"|(?<!\w)[^\W\d_][\w-]{{0,40}}(?:ая|яя|ий|ый|ой|ська|івська|евська|а),\s{{0,2}}{HOUSE}\.?\s?{NO})"
    r"(?:,?\s{0,2}(?:корп(?:ус)?|к|стр(?:оение)?|кв(?:артира)?|оф(?:ис)?|под(?:ъезд)?)\.?\s?\d{1,4}[а-я]?)*",
    re.I,
)
LATIN_ADDRESS = re.compile(
    r"(?:(?<!\w)(?:(?:flat|apt|apartment|unit|suite)\.?\s?\d{1,5}[a-z]?,?\s)?\d{1,5}[a-z]?,?\s(?:[a-z][\w'’-]*\s){1,3}(?:street|st|road|rd|lane|ln|avenue|ave|drive|dr|court|ct|square|sq|way|boulevard|blvd|close|terrace|crescent|place)(?!\w)\.?(?:,?\s(?:apt|apartment|flat|unit|suite)\.?\s?\d{1,5}[a-z]?)?"
    r"|(?<!\w)[a-zäöüß][\wäöüß-]{0,40}\s?(?:straße|strasse|str\.|weg|allee|gasse|platz|damm|ufer|ring)\s(?:nr\.?\s?)?\d{1,4}\s?(?:[a-z](?!\w))?"
    r"|(?<!\w)(?:calle|c/|avenida|avda|av|plaza|paseo|camino|carretera|ronda|travesía)\.?\s(?:de\s(?:la\s|los\s|las\s)?|del\s)?[a-záéíóúñ][\w-]*(?:\s[a-záéíóúñ][\w-]*)?,?\s(?:n[.º°]{0,2}\s?|número\s)?\d{1,4}(?!\d)(?:,\s?\d{1,2}\s?[ºª°]\s?[a-z]?)?)",
    re.I,
)
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
PATRONYMIC = re.compile(rf"[^\W\d_]{{2,}}?{N.PATRONYMIC}$", re.I)
FAMILY = re.compile(rf"[^\W\d_]{{2,}}(?:{N.FAMILY_CYRILLIC}|{N.FAMILY_LATIN})$", re.I)
#: What stands between the words of a name.
BETWEEN = re.compile(r"[ \t_-]{1,3}$|[ \t]?-[ \t]?$")
# Words near a span that tell of a kind, by beginning.
NEAR = {
    "phone": r"тел|звон|телефон|номер|number|nummer|número|numero|набир|пиш|whats|viber|call|phone|ring|ruf|anruf|llám|llam|дзвон|мастер|майстер|mobil|after|после|після|nach",
    "id": r"паспорт|инн|снилс|іпн|удостов|посвідч|passport|reisepass|ssn|social|tax|dni|nie|nif|documento|ident|ausweis|steuer|card|полис|страх|personal|рнокпп|ипн|іпн",
    "other": r"закон|гост|фз|статьи|стать|верси|версі|version|build|просмотр|перегляд|views|aufruf|visit|курс|руб|евро|доллар|usd|eur|тайм|хвил|минут|minut|zeit|marca|timecode|article|пункт|серии|выпуск|likes|лайк|подписч|subscr|просм|release|заказ|order|год|року|jahr|año",
    "home": r"жив|адрес|мешк|прожива|live|address|wohn|vivo|домой|дом|приез|приїзд|come|kommt|veng|тут|here|находит|потоп|flood",
    "name": r"зовут|зват|звати|имя|ім|сосед|сусід|уваж|повагою|найти|знайти|name|regards|sincerely|neighbour|neighbor|heiße|heisse|nachbar|grüß|llamo|vecin|saludos|atentamente|господин|пан|инженер|вчител|teacher|engineer|lehrer|maestr|подпись|автор|вот|said|told",
}
_NEAR = {k: re.compile(rf"(?<![^\W\d_])(?:{v})", re.I) for k, v in NEAR.items()}
# Frequent words that are no family names although their ending fits one.
COMMON = frozenset(
    """в на и не но за из от до для про что как это или при над под так там тут вот уже ещё очень спасибо здравствуйте привет просто только слов готов здоров любов новый новая снова слова основа голова дорога долго много никто кто где когда почему
    и з на про що як це або так тут вже дуже дякую мова нова слово
    the and for with from this that you your are was were has have had not but his her its our their who why how what when where there here they will would can could about after before over under into then than only very just more most one two said says
    der die das und ist nicht mit von für auf ein eine einen dem den des zu im in an aus bei nach über unter wie was wer wo wann auch nur noch sehr mehr hier dort
    el la los las y es no con de del para por un una en que como más muy pero sin sobre entre hasta desde este esta aquí allí todo todos gracias""".split()
)

# What introduces a name directly, strongly or by naming a role.
INTRO = re.compile(r"(?<!\w)(?:зовут|звать|звати|уважением|повагою|name is|name's|regards|sincerely|yours|heiße|heisse|heiß|name ist|gr[üu](?:ß|ss)en?|llamo|llama|nombre es|saludos|atentamente|фамилия|прізвище|подпись|підпис)[\s,.:—–-]{1,4}$", re.I)
ROLE = re.compile(r"(?<!\w)(?:сосед(?:ка|у|ом|ка|ке|кой)?|сусід(?:ка|у|ом|ці)?|господин|госпожа|пан|пані|инженер|вчител\w*|учител\w*|врач|лікар|neighbou?r|teacher|engineer|doctor|mr|mrs|ms|dr|nachbar(?:in)?|herr|frau|lehrer(?:in)?|vecin[oa]|maestr[oa]|señora?|sr|sra)[\s,.:—–-]{1,4}$", re.I)
#: Two or three words that begin with capitals, as names do.
CAPITALS = re.compile(r"(?<![\w@#'’-])[^\W\d_a-zа-яёіїєґà-öø-ÿ][^\W\d_]+(?:-[^\W\d_]+)?(?:[ \t]{1,2}[^\W\d_a-zа-яёіїєґà-öø-ÿ][^\W\d_]+(?:-[^\W\d_]+)?){1,2}(?![\w-])")
#: Two words in any letters after an introduction.
INTRODUCED = re.compile(r"(?<!\w)(?:зовут|звать|звати|name is|heiße|heisse|llamo)[\s:—–-]{1,3}([^\W\d_]{3,}[ \t][^\W\d_]{3,})(?!\w)", re.I)

#: A number before such a word counts something.
COUNTED = re.compile(r"\s*(?:просмотр|перегляд|prosmotr|views?|aufruf|visit|vistas|лайк|like|подписч|subscrib|руб|грн|евро|долл|usd|eur|раз|человек|люд|people|personas|leute|лет|рок|year|jahr|años|дней|дня|days|tage|días|минут|процент|штук|км|кг|km|kg)", re.I)
#: Context ends where a sentence does.
SENTENCE_END = re.compile(r"[!?…\n]\s*|\.\s+(?=[A-ZА-ЯЁІЇЄҐ])")


class Text:
    """A text in usual width, spacing and scripts, with the place of each character in the original."""

    __slots__ = ("at", "s")
    UNUSUAL = re.compile(r"[^\x00-\x7F\xA1-\xAC\xAE-\xFFА-яЁёІіЇїЄєҐґ–—…«»№“”‘’\U0001F000-\U0001FAFF\u2600-\u27BF\uFE0F]|[A-Za-z][А-яЁёІіЇїЄєҐґ]|[А-яЁёІіЇїЄєҐґ][A-Za-z]|[\n\t]")
    MIXED = re.compile(r"[^\W\d_]+")
    _TO_CYRILLIC = {v: k for k, v in reversed(LOOK_ALIKE.items()) if "Ѐ" <= k <= "ӿ" and k not in "һԁԛԝӏӀԚԜҮјѕЈЅ"}
    _ONLY = frozenset(c for c in map(chr, range(0x400, 0x500)) if c not in LOOK_ALIKE)

    def __init__(self, s: str) -> None:
        self.at: Sequence[int] | None = None
        self.s = s
        if not self.UNUSUAL.search(s):
            return
        out: list[str] = []
        at: list[int] = []
        for i, c in enumerate(s):
            o = ord(c)
            kind = unicodedata.category(c) if o > 0x7F else ""
            if kind == "Cf" or 0xFE00 <= o <= 0xFE0F:
                continue
            if kind == "Mn" and out:
                joined = unicodedata.normalize("NFC", out[-1] + c)
                if len(joined) == 1:
                    out[-1] = joined
                continue
            if kind == "Zs" or c in "\t\n\r":
                c = " " if c != "\n" else "\n"
            elif 0xFF01 <= o <= 0xFF5E:
                c = chr(o - 0xFEE0)
            elif len(w := unicodedata.normalize("NFKC", c)) == 1 and kind[:1] in "LN":
                c = w
            out.append(c)
            at.append(i)
        t = "".join(out)

        def one_script(m: re.Match) -> str:
            w = m[0]
            if w.isascii() or not any(c in LOOK_ALIKE or c in self._ONLY for c in w):
                return w
            if any(c in self._ONLY for c in w):
                return "".join(self._TO_CYRILLIC.get(c, c) for c in w)
            return "".join(LOOK_ALIKE.get(c, c) for c in w) if any(c.isascii() for c in w) else w

        self.s = self.MIXED.sub(one_script, t)
        self.at = at

    def span(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.at is None else (self.at[a], self.at[b - 1] + 1)


def _features(t: str, a: int, b: int, kind: int, author: bool, extra: Mapping[str, float]) -> list[float]:
    """Format and context of a candidate span; the same columns for every kind."""
    span, left, right = t[a:b], SENTENCE_END.split(t[max(0, a - 32) : a])[-1], SENTENCE_END.split(t[b : b + 24])[0]
    after = t[b : b + 2].ljust(2)
    follows = 0.0 if not after.strip() else 1.0 if not after[0].isspace() else 2.0 if after[1].islower() else 3.0
    digits = sum(c.isdigit() for c in span)
    letters = sum(c.isalpha() for c in span)
    upper = sum(c.isupper() for c in span)
    groups = len(re.findall(r"\d+", span))
    first = re.match(r"\D*(\d+)", span)
    near = [float(bool(r.search(left))) for r in _NEAR.values()] + [float(bool(r.search(right))) for r in _NEAR.values()]
    return [
        float(kind), float(author), float(len(span)), float(digits), float(letters), float(upper), float(groups), float(len(first[1]) if first else 0),
        float(span[0] in "+("), float("(" in span), float(span.count("-")), float(span.count(".")), float(span.count(" ")), float("№" in span or left.rstrip()[-1:] == "№"),
        extra.get("a", 0.0), extra.get("b", 0.0), extra.get("c", 0.0), extra.get("d", 0.0), float(right[:1] in "%$€₽,:" and right[1:2].isdigit() or left[-1:] in "$€"), float(not left.strip()),
        follows, float(bool(COUNTED.match(t[b : b + 16]))), extra.get("e", 0.0), extra.get("f", 0.0), extra.get("g", 0.0),
        *near,
    ]


def candidates(t: str, author: bool) -> Iterator[tuple[int, int, int, Mapping[str, float]]]:
    """(kind, begin, end, extra features) of every span that could be personal, overlaps included."""
    low = t.lower()
    digit = any(c.isdigit() for c in t) if len(t) < 40 else re.search(r"\d", t) is not None
    if "@" in t or any(w in low for w in ("(at", "[at", "{at", "<at", "собак", "равлик", "arroba", " at ")):
        for m in (*EMAIL.finditer(t), *SPOKEN_EMAIL.finditer(t)):
            yield 0, m.start(), m.end(), {"a": float("@" in m[0]), "b": float(bool(re.search(r"[(\[{<]", m[0]))), "c": float(len(m[0].split())), "d": float(len(re.split(DOT, m[0])[-1]))}
    if digit:
        for m in NUMBER.finditer(t):
            a, b = m.span()
            n = sum(c.isdigit() for c in m[0])
            if n >= 6:
                dotted = float(bool(re.fullmatch(r"\d{1,3}(?:\.\d{1,3}){3}", m[0])))
                thousands = float(bool(re.fullmatch(r"\d{1,3}(?:[ ,.]\d{3})+", m[0])))
                alnum = float(any(c.isalpha() for c in m[0]))
                clock = float(bool(re.search(r"\d:\d", t[max(0, a - 3) : b + 3])))
                if n >= 7:
                    yield 1, a, b, {"a": dotted, "b": thousands, "c": alnum, "d": clock}
                yield 2, a, b, {"a": dotted, "b": thousands, "c": alnum, "d": clock}
        for pattern in (CYRILLIC_ADDRESS, LATIN_ADDRESS):
            for m in pattern.finditer(t):
                typed = float(bool(re.search(rf"(?<!\w){STREET}(?!\w)", m[0], re.I)))
                yield 3, m.start(), m.end(), {"a": typed, "b": float(bool(re.search(rf"(?<!\w){HOUSE}(?!\w)", m[0], re.I))), "c": float(m[0][:1].isupper()), "d": float(pattern is LATIN_ADDRESS)}
    words = [(m.start(), m.end()) for m in WORD.finditer(t)]
    known = [GIVEN.get(low[a:b].replace("ё", "е")) for a, b in words]
    capital = [t[a].isupper() for a, _ in words]
    titled = float(len(words) > 3 and sum(capital) > 0.7 * len(words))
    shouted = float(t.isupper())
    taken: set[tuple[int, int]] = set()
    for i, k in enumerate(known):
        if not k:
            continue
        for j in (i + 1, i - 1):
            if not 0 <= j < len(words) or known[j] and j < i and known[i] and not PATRONYMIC.match(t[slice(*words[i])]):
                continue
            lo, hi = min(i, j), max(i, j)
            if not BETWEEN.match(t[words[lo][1] : words[hi][0]]):
                continue
            w = t[slice(*words[j])]
            if len(w) < 3 or w.lower() in COMMON:
                continue
            patron = bool(PATRONYMIC.match(w))
            family = bool(FAMILY.match(w))
            a, b = words[lo][0], words[hi][1]
            if not (patron or family or capital[i] or capital[j] or _NEAR["name"].search(t[max(0, a - 24) : a])):
                continue
            more = hi + 1
            if patron and more < len(words) and BETWEEN.match(t[b : words[more][0]]) and FAMILY.match(t[slice(*words[more])]):
                b = words[more][1]
            if lo and (patron or PATRONYMIC.match(t[slice(*words[hi])])) and BETWEEN.match(t[words[lo - 1][1] : a]) and FAMILY.match(t[slice(*words[lo - 1])]) and capital[lo - 1]:
                a = words[lo - 1][0]
            both = float(capital[i] and capital[j])
            taken.add((a, b))
            yield 4, a, b, {"a": 2.0 * patron + family, "b": both * (1 - 0.5 * max(titled, shouted)), "c": float(j < i) + 2 * (k == 2), "d": titled + 2 * shouted + 4 * (capital[i] != capital[j]), "e": 1.0 + bool(known[j]), "f": _introduced(t, a), "g": float(hi - lo + 1)}
    if shouted:
        return
    # names that no list holds
    spans = [m.span() for m in CAPITALS.finditer(t)]
    if any(w in low for w in ("зовут", "звать", "звати", "name is", "heiße", "heisse", "llamo")):
        spans += [m.span(1) for m in INTRODUCED.finditer(t)]
    for a, b in spans:
        part = re.split(r"[ \t]+", t[a:b])
        led = _introduced(t, a)
        # where nearly all words have capitals they tell nothing
        if titled and not led or any(a < d and c < b for c, d in taken) or any(w.lower() in COMMON for w in part):
            continue
        taken.add((a, b))
        ends = [2.0 * bool(PATRONYMIC.match(w)) + bool(FAMILY.match(w)) for w in part]
        yield 4, a, b, {"a": max(ends), "b": float(all(w[0].isupper() for w in part)) * (1 - 0.5 * titled), "c": float(ends[0] > 0), "d": titled, "e": 0.0, "f": led, "g": float(len(part))}


def _introduced(t: str, a: int) -> float:
    """2 if the text before ``a`` introduces a name, 1 if it ends in a role, else 0."""
    left = t[max(0, a - 24) : a]
    return 2.0 if INTRO.search(left) else 1.0 if ROLE.search(left) else 0.0


class Detector:
    """Boosted trees over candidates, with a threshold for each kind."""

    def __init__(self, trees: Sequence[Trees], thresholds: Sequence[float]) -> None:
        self.trees, self.thresholds = list(trees), list(thresholds)

    def found(self, texts: Sequence[str], author: bool) -> list[tuple[int, int, int, int, float]]:
        """(text, begin, end, kind, probability) of the spans to redact, in the texts as they are.

        Where spans overlap, the more probable one is taken, then the longer one.
        """
        where: list[tuple[int, int, int, int]] = []
        rows: list[list[float]] = []
        for i, raw in enumerate(texts):
            if len(raw) < 5:
                continue
            t = Text(raw)
            for kind, a, b, extra in candidates(t.s, author):
                where.append((i, kind, *t.span(a, b)))
                rows.append(_features(t.s, a, b, kind, author, extra))
        if not rows:
            return []
        x, kinds = np.array(rows), np.array([w[1] for w in where])
        p = np.zeros(len(x))
        for k, tree in enumerate(self.trees):
            if (kinds == k).any():
                p[kinds == k] = tree.probability(x[kinds == k])
        kept = [(w[0], -q, w[2] - w[3], w[2], w[3], w[1]) for w, q in zip(where, p.tolist(), strict=True) if q >= self.thresholds[w[1]]]
        out: list[tuple[int, int, int, int, float]] = []
        now, taken = -1, []
        for i, q, _, a, b, k in sorted(kept):
            if i != now:
                now, taken = i, []
            if all(b <= c or a >= d for c, d in taken):
                taken.append((a, b))
                out.append((i, a, b, k, -q))
        return out


# --- training data -----------------------------------------------------------------------------

_SYLLABLES = "ba be bo da de do ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta te to va ve vo pa pe po li mi ni ri".split()
_CYR = dict(zip("abdeklmnoprstvi", "абдеклмнопрстви", strict=True))


def _made_up(r: random.Random, cyrillic: bool) -> str:
    w = "".join(r.choice(_SYLLABLES) for _ in range(r.randint(2, 4)))
    return "".join(_CYR[c] for c in w) if cyrillic else w


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _phone(r: random.Random) -> str:
    a, b, c, d = _digits(r, 3), _digits(r, 3), _digits(r, 2), _digits(r, 2)
    head = r.choice(["+7 ", "8 ", "+7", "8", "8-", "+380 ", "+49 ", "0034 ", "+1 ", "", "00"])
    return r.choice([f"{head}({a}) {b}-{c}-{d}", f"{head}{a} {b} {c} {d}", f"{head}{a}-{b}-{c}-{d}", f"{head or '8'}{a}{b}{c}{d}", f"{a}.{b}.{c}.{d}", f"{a}-{b}-{c}{d}", f"({a}) {b}-{c}{d}", f"{head}{a} {b}{c}{d}"])


def _identity(r: random.Random) -> str:
    d = lambda n: _digits(r, n)
    u = lambda n: "".join(r.choice("ABCDEFGHKLXZ") for _ in range(n))
    return r.choice([d(10), d(12), d(11), f"{d(4)} {d(6)}", f"{d(2)} {d(2)} {d(6)}", f"{d(4)}-{d(6)}", f"{d(4)} № {d(6)}", f"{d(3)}-{d(3)}-{d(3)} {d(2)}", f"{d(3)}-{d(2)}-{d(4)}", d(9), f"{u(1)}{d(8)}", f"{u(2)} {d(3)} {d(4)}", f"{u(1)}{d(2)}{u(1)}{d(5)}", f"{d(8)}{u(1)}", f"{d(8)}-{u(1)}", f"{u(1)}{d(7)}{u(1)}"])


def _email(r: random.Random) -> str:
    local = _made_up(r, False) + r.choice(["", ".", "_", "-"]) + _made_up(r, False)[:3] + r.choice(["", _digits(r, 2), "+" + _made_up(r, False)[:2]])
    domain = [_made_up(r, False), r.choice(["com", "org", "ru", "net", "test", "de", "info"])] + ([r.choice(["com", "org"])] if r.random() < 0.3 else [])
    at, dot = r.choice([("@", "."), ("@", "."), (" @ ", "."), ("(at)", "."), ("[at]", "[dot]"), (" собака ", " точка "), (" at ", " dot ")])
    e = local + at + dot.join(domain)
    return e.upper() if r.random() < 0.1 else e


def _address(r: random.Random) -> str:
    n, m = r.randint(1, 200), r.randint(1, 300)
    s, l = _made_up(r, True), _made_up(r, False).capitalize()
    return r.choice([
        f"ул. {s.capitalize()}вая, д. {n}, кв. {m}", f"улица {s.capitalize()}ная {n}", f"ул {s.capitalize()}ная {n} корп 2", f"{s.capitalize()}ский проспект, дом {n}", f"пер. {s.capitalize()}льный, {n}-{m}", f"{n}-й дом на бульваре {s.capitalize()}, квартира {m}", f"{s.capitalize()}нская, д. {n}, кв. {m}",
        f"вул. {s.capitalize()}ська, буд. {n}", f"вулиця {s.capitalize()} {n}", f"{n} {l} Street, Apt {m}", f"{n} {l} Rd", f"flat {m}, {n} {l} Lane", f"{l}straße {n}", f"{l}weg {n}", f"calle {l} {n}, 3º B", f"avenida {l}, {n}", f"plaza de {l} {n}",
    ])


def _in_part(name: str, part: int | None) -> bool:
    """Whether a name, frame or format belongs to a part of the training data; None stands for all."""
    return part is None or sum(name.encode()) % 2 == part


def _person(r: random.Random, part: int | None = None, listed: bool = True) -> tuple[str, bool]:
    """A name, and whether it is Cyrillic. Where not ``listed``, the given name is made up, too."""
    lang = r.choice(["ru", "ru", "ru", "uk", "en", "de", "es"])
    cyr = lang in ("ru", "uk")
    given = r.choice([n for n in {"ru": N.RUSSIAN, "uk": N.UKRAINIAN, "en": N.ENGLISH, "de": N.GERMAN, "es": N.SPANISH}[lang] if _in_part(n, part)]) if listed else _made_up(r, cyr)
    given = given.capitalize()
    tail = {"ru": ["ов", "ова", "ев", "ин", "ина", "ский", "ская", "енко", "цев"], "uk": ["енко", "чук", "ський"], "en": ["worth", "ley", "son", "man", "ridge", "ford", "", ""], "de": ["mann", "stein", "berg", "", "er"], "es": ["ez", "illas", "ero", "", "ano"]}[lang]
    family = (_made_up(r, cyr) + r.choice([x for x in tail if _in_part(x, part)] or tail)).capitalize()
    patron = r.choice(["Иванович", "Олегович", "Павлович", "Юрьевна", "Игоревна", "Олеговна"]) if lang == "ru" else "Іванович"
    form = r.random()
    name = f"{given} {patron} {family}" if cyr and form < 0.15 else f"{given} {patron}" if cyr and form < 0.3 else f"{family} {given}" if cyr and form < 0.5 else f"{given} {family}"
    return name, cyr


_FRAMES = {
    0: ["Пишите на {}, жду ответа.", "{}", "Моя почта {}", "Contact: {} please", "Write to {}.", "Schreibt an {}.", "Escriban a {}", "Пишіть на {}", "{} — туда шлите файлы."],
    1: ["Звоните {} вечером.", "Мой телефон {}", "тел. {}", "{}", "Call me at {} tonight.", "Мастер {}", "Ruft an: {}.", "Llámenme al {} hoy.", "Телефонуйте {} зранку.", "Нужен ремонт? {}", "Отличный выпуск. {}", "{} звоните вечером", "{} — мастер", "{} call any time"],
    2: ["Мой паспорт {} потерян.", "ИНН {} указан неверно", "СНИЛС {}, отказали", "Удостоверение № {} нашли.", "My passport {} expired.", "lost my SSN {} again", "ID card {} was refused", "Ausweisnummer {} prüfen", "Mi DNI es {} y punto", "паспорт {}, перевіряйте", "documento de identidad {}"],
    3: ["Живу по адресу {}, заходите.", "Это было тут: {}.", "{}", "I live at {}, come over.", "Ich wohne in der {}.", "Vivo en {}, vengan.", "Мешкаю: {}, приїздіть", "Авария: {}, второй день.", "Flooded again at {} and so on", "{} затопило вчера", "{} is closed today", "Meet me at {} tonight"],
    4: ["Меня зовут {}, я врач.", "С уважением, {}", "{}", "Нам говорил сосед, {}.", "Ищем: {}, пропал вчера.", "My name is {} and I teach.", "Our neighbour {} said so.", "Ich heiße {} und koche.", "Me llamo {} y canto.", "Мене звати {}, я лікар.", "А вот {} против.", "{} против этой идеи", "{} говорил иначе.", "{} said the same yesterday.", "{} wohnt hier", "{} lo sabe bien", "{}, привет вам", "Передайте {} привет", "Ждём {} в студии"],
}
#: Frames that introduce a name, in which names stand that no list holds.
_INTRODUCING = ["Меня зовут {}, я врач.", "Меня зовут {}.", "меня зовут {}", "С уважением, {}", "Спасибо за эфир. С уважением, {}", "Мене звати {}, я лікар.", "З повагою, {}", "My name is {} and I teach.", "My name is {}.", "Sincerely, {}", "Best regards, {}", "Ich heiße {} und koche.", "Ich heiße {}.", "Mit freundlichen Grüßen, {}", "Me llamo {} y canto.", "Atentamente, {}", "Our neighbour {} said so.", "Our neighbour {} was there", "Нам говорил сосед {}.", "Наша соседка {} против", "Mein Nachbar {} sagt das.", "Mi vecina {} lo vio", "The teacher {} was right", "Господин {} опоздал", "Herr {} war da", "Mrs {} told me"]
#: Words with capitals that are no names, and frames for them.
_CAPITAL = ["Большой Театр", "Новый Год", "Красная Площадь", "Верховный Суд", "Государственная Дума", "Добрый Вечер", "Первый Канал", "Чёрное Море", "Открытый Код", "Новая Волна", "Великий Пост", "Нижний Город", "Гражданский Кодекс", "Верховна Рада", "Добрий Вечір", "Новий Рік", "Чорне Море", "New York", "Great Show", "Supreme Court", "Open Source", "Cloud Server", "Red Square", "Good Evening", "Prime Minister", "World Cup", "White House", "Daily News", "Big Data", "Central Bank", "Guten Abend", "Gute Arbeit", "Neue Folge", "Großes Theater", "Vielen Dank", "Bad Homburg", "Neues Jahr", "Gute Frage", "Buenas Tardes", "Nueva York", "Gran Vía", "Corte Suprema", "Muchas Gracias", "Copa Mundial", "Año Nuevo", "Banco Central"]
_CAPITAL_FRAMES = ["{}!", "{}", "Вчера смотрели {} вместе.", "Про {} уже говорили", "Привет из города {}!", "У нас в посёлке {} тихо", "{} Спасибо", "Про це {} мовчить", "We watched {} yesterday.", "Greetings from {} to all!", "Thanks, {} is fine", "Grüße aus {} an alle!", "Ich finde {} gut", "Saludos desde {} a todos", "Bei uns in {} redet jeder", "В {} всё иначе", "Back in {} people talk", "{}. Дальше другое", "Меня зовут в {} завтра", "My name is on {} now", "Heute {} gesehen", "Aquí en {} nadie lo sabe"]
_LOWER_AFTER = ["меня зовут на работу", "меня зовут друзья в гости", "как вас зовут скажите пожалуйста", "my name is not important", "my name is never mentioned", "Ich heiße das nicht gut", "me llamo la atención siempre", "Всех зовут послушать музыку", "My name is already known", "нас зовут выступать завтра"]
_OTHER = [
    "Набрали {n3} просмотров за день", "{n3} views in a week", "Nabrali {n3} prosmotrov za den", "Набрали {n3} просмотров", "Уже {n3} просмотров и лайков", "{n3} Aufrufe am Tag", "{n3} visitas en un día", "Закон № {n2}-ФЗ", "По ГОСТ {n5}-20{n2} нельзя", "Нарушен ГОСТ {n5}-20{n2}", "ГОСТ Р {n5}-19{n2} отменён", "Po GOST {n5}-20{n2} nelzya", "Версия {n2}.{n1}.{n2}.{n1} вышла", "Build {n2}.{n1}.{n2}.{n1}", "Курс был {n2},{n5}, стал {n2},{n5}.", "Тайм-код 00:{n2}:{n2}", "Заказ {n5}{n2} отменён", "В 20{n2}-20{n2} годах", "Цена {n2} 000 000 руб", "счёт {n1}:{n1}", "{n3} лайков", "статья {n5}{n1} пункт {n1}", "Бюджет {n3} рублей",
    "Дом на проспекте сносят", "На улице людно, {n2} человек", "улица пустая, {n5}", "the street is loud at {n2}", "В дом {n2} раза звонили", "la calle está llena, {n2} personas", "Auf dem Weg {n2} Leute", "Площадь затопило, {n2} дней ждали", "Only {n2} people on the road", "на 2-й минуте, {n2} раз",
    "{g}, спасибо за тон", "Слушаю, {g} молодец", "{g} говорит правду", "Привет от {g} из зала", "Thanks {g} for the show", "hello {g} nice one", "роман в стихах", "Новый перевод романа читается легче", "вера людей в науку", "Сравните роман с фильмом", "Обсудите роман здесь", "Читали роман всей семьёй", "Дайте надежду людям", "Наша вера крепка", "Покажите любовь к делу", "Buy a rose today", "Please mark the date", "Say grace before dinner", "Total grace under pressure", "любовь зрителей", "Danke {g} für alles", "gracias {g} por todo", "{g} Спасибо Вам Большое", "{g} ведущий отличный", "{g} рассказал новости", "{g} was right", "надежда остаётся", "Alle kennen {g} gut",
    "@user_{n2} и @{w}_{n1}", "ссылка https://site.test/{w}?v={n5}", "встреча в {n2} at the {w}", "look at {w}.com now", "Бодрый компас {n5}{n2}", "@{w}{n5}{n2}", "@user-{n5}{n2}", "{w} {n5}{n2}", "Весёлый кот {n5}", "Большой {w} {n5}{n1}", "Мастер дел", "{w} собака лает громко", "at home {w}. ok then",
]


def training_set(seed: int = 7, size: int = 14_000, part: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and kinds of candidates in made-up sentences, right and wrong ones.

    ``part`` 0 and 1 share no given name, no ending of a family name and no frame; None has all.
    """
    r = random.Random(seed)
    frames = {k: [f for f in v if _in_part(f, part)] or v for k, v in _FRAMES.items()}
    introducing, capital, capital_frames, other, lower = ([f for f in v if _in_part(f, part)] for v in (_INTRODUCING, _CAPITAL, _CAPITAL_FRAMES, _OTHER, _LOWER_AFTER))
    given = [n for n in (*N.RUSSIAN, *N.ENGLISH, *N.GERMAN, *N.SPANISH) if _in_part(n, part)]
    makers = [_email, _phone, _identity, _address, lambda q: _person(q, part)[0]]
    rows, label, kinds = [], [], []
    for i in range(size):
        author = i % 5 == 0
        if i % 12 == 1:
            k, author = 4, False
            value = _person(r, part, False)[0]
            frame = r.choice(introducing)
            if frame.islower() or r.random() < 0.1:
                value = value.lower()
            t = frame.format(value)
            a = t.find(value)
            b = a + len(value)
        elif i % 12 in (4, 8):
            k, a, b = -1, 0, 0
            what = r.choice(capital) if r.random() < 0.6 else f"{_made_up(r, r.random() < 0.5)} {_made_up(r, r.random() < 0.5)}".title()
            t = r.choice(capital_frames).format(what) if r.random() < 0.9 else r.choice(lower)
        elif i % 2:
            k = r.randrange(5)
            value = makers[k](r)
            form = r.random()
            if k == 4 and form < 0.25:
                value = value.lower()
            elif k in (3, 4) and form < 0.35:
                value = value.upper()
            frame = "{}" if author else r.choice(frames[k])
            if r.random() < 0.3 and not author:
                frame = r.choice(["Хороший эфир. ", "Great show! ", "Ну вот. ", "В 2024 году было лучше. "]) + frame
            if r.random() < 0.25 and not author:
                frame += r.choice([" Спасибо всем", " 👍", " Great show", " #тег12", "\nДальше другое", " Danke", ")))", "!!"])
            if author and k in (0, 1):
                frame = r.choice(["{}", "Мастер 42 {}"])
            t = frame.format(value)
            a = t.find(value)
            b = a + len(value)
        else:
            g = r.choice(given).capitalize()
            t = r.choice(other)
            t = t.format(n1=r.randint(1, 9), n2=r.randint(10, 60), n3=r.choice([" ", " ", ",", "."]).join([str(r.randint(1, 999)), *(_digits(r, r.choice([2, 3, 3])) for _ in range(r.randint(2, 3)))]), n5=r.randint(10000, 199999), g=g, w=_made_up(r, False))
            form = r.random()
            if r.random() < 0.25:
                t += r.choice([" Спасибо всем", " 👍", " Great show", " #тег12", "\nДальше другое", " Danke", ")))", "!!"])
            t = t.title() if form < 0.12 else t.upper() if form < 0.2 else t.lower() if form < 0.35 else t
            k, a, b = -1, 0, 0
        for kind, x, y, extra in candidates(t, author):
            same = kind == k and x < b and y > a
            rows.append(_features(t, x, y, kind, author, extra))
            label.append(float(same and min(y, b) - max(x, a) >= 0.6 * max(y - x, b - a)))
            kinds.append(kind)
    return np.array(rows), np.array(label), np.array(kinds)


def fitted(seed: int = 7, precision: float = 0.97) -> Detector:
    """Trees trained on all made-up sentences. For each kind the threshold is the lowest from 0.3 on at
    which trees of one half reach ``precision`` on the other half, which shares no name or frame
    with it, or else the one with the best F-measure there."""
    x, y, k = training_set(seed)
    halves = [training_set(seed + 1 + h, 7_000, h) for h in (0, 1)]
    trees, thresholds = [], []
    for kind in range(len(KINDS)):
        trees.append(boost(x[k == kind], y[k == kind]))
        p, truth = [], []
        for h in (0, 1):
            (u, v, w), (s, t, q) = halves[h], halves[1 - h]
            p.append(boost(u[w == kind], v[w == kind]).probability(s[q == kind]))
            truth.append(t[q == kind])
        p, truth = np.concatenate(p), np.concatenate(truth)
        steps = np.arange(0.3, 0.95, 0.05)
        good = [c for c in steps if (p >= c).any() and truth[p >= c].mean() >= precision]
        balance = [2 * truth[p >= c].sum() / max(1.0, (p >= c).sum() + truth.sum()) for c in steps]
        thresholds.append(float(good[0] if good else steps[int(np.argmax(balance))]))
    return Detector(trees, thresholds)


# --- DataFrames --------------------------------------------------------------------------------


def found_spans(df: DataFrame, id_col: str, text_cols: Mapping[str, bool], detector: Detector, kinds_only: bool = False) -> DataFrame:
    """Columns ``id_col``, field_name, kind, begin, end (code points), probability: a row for each span,
    or, with ``kinds_only``, for the first span of each kind in a field.

    ``text_cols`` gives the columns, and for each whether it holds a name of an author. Null and
    empty texts give nothing; texts are read whole. A row that is there twice repeats its spans.
    """
    shared = df.sparkSession.sparkContext.broadcast(detector)
    cols = list(text_cols.items())

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            ids = part["k"].to_numpy()
            for j, (name, author) in enumerate(cols):
                # equal values of a batch are looked at once
                code, texts = pd.factorize(part[f"t{j}"])
                spans = pd.DataFrame(shared.value.found(list(texts), author), columns=["i", "begin", "end", "kind", "probability"])
                if kinds_only:
                    spans = spans.drop_duplicates(["i", "kind"])
                rows = pd.DataFrame({"k": ids, "i": code}).merge(spans, on="i")
                kind = np.array(KINDS, object)[rows["kind"].to_numpy(np.int64)] if len(rows) else np.zeros(0, object)
                yield pd.DataFrame({"k": rows["k"], "field_name": name, "kind": kind, "begin": rows["begin"].astype("int32"), "end": rows["end"].astype("int32"), "probability": rows["probability"].astype("float64")})

    part = df.select(F.col(id_col).alias("k"), *[F.col(c).alias(f"t{j}") for j, (c, _) in enumerate(cols)])
    return part.mapInPandas(run, "k bigint, field_name string, kind string, begin int, end int, probability double").withColumnRenamed("k", id_col)


def redacted(df: DataFrame, id_col: str, text_cols: Mapping[str, bool], detector: Detector) -> DataFrame:
    """``id_col`` and the text columns, with [EMAIL], [PHONE] and so on in place of what was found.

    Everything else stays as it is; null stays null, the empty text stays empty. Rows keep their number.
    """
    shared = df.sparkSession.sparkContext.broadcast(detector)
    cols = list(text_cols.items())

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = {"k": part["k"]}
            for j, (_, author) in enumerate(cols):
                texts = part[f"t{j}"].tolist()
                for i, a, b, k, _ in sorted(shared.value.found([t or "" for t in texts], author), key=lambda s: (s[0], -s[1])):
                    texts[i] = f"{texts[i][:a]}[{KINDS[k].upper()}]{texts[i][b:]}"
                out[f"t{j}"] = pd.Series(texts, dtype=object)
            yield pd.DataFrame(out)

    part = df.select(F.col(id_col).alias("k"), *[F.col(c).alias(f"t{j}") for j, (c, _) in enumerate(cols)])
    out = part.mapInPandas(run, "k bigint, " + ", ".join(f"t{j} string" for j in range(len(cols))))
    return out.select(F.col("k").alias(id_col), *[F.col(f"t{j}").alias(c) for j, (c, _) in enumerate(cols)])
