"""Problem 3: languages of documents and of their segments (cross-parsing entropy)."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm import fold

# Spellings of the languages that labels use, in lower case.
NAMES = {
    "ru": ("ru", "rus", "russian", "русский", "рус", "російська"),
    "en": ("en", "eng", "english", "английский", "англійська"),
    "uk": ("uk", "ukr", "ua", "ukrainian", "украинский", "українська"),
    "de": ("de", "deu", "ger", "german", "deutsch", "немецкий"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano", "испанский"),
}
LANGUAGES = tuple(NAMES)
#: Labelled texts sampled for each language, and letters that each automaton holds. NATIVE is the
#: part of the letters that stays for the script itself where romanised forms are added.
SAMPLE = 1200
LETTERS = 100_000
NATIVE = 0.6
# The usual romanisation of Russian and Ukrainian, and second forms in use.
LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "ґ": "g", "д": "d", "е": "e", "ё": "yo", "є": "ye", "ж": "zh", "з": "z", "и": "i", "і": "i", "ї": "yi", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n",
    "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}
SECOND = {"х": "h", "щ": "shch", "ё": "e", "є": "ie", "ї": "i", "ю": "iu", "я": "ia", "й": "i", "ж": "j", "ц": "c"}
UKRAINIAN = {"и": "y", "г": "h"}

#: Private characters that end a text and a segment while a batch is one string.
END, STOP = "\uE001", "\uE002"


def _shape(words: str) -> str:
    return fold.FOLD[[ord(c) for c in words]].astype("<u4").tobytes().decode("utf-32-le")


#: Links, addresses (masked ones too), tags, handles, bracketed marks and numbers have no language.
_AT = rf"\s?(?:@|\(at\)|\[at\])\s?|\s(?:{_shape('собака')}|{_shape('равлик')}|at)\s(?=[\w-]+\s?(?:\.|\(|\[|{_shape('точка')}|{_shape('крапка')}|dot\b))"
_DOT = rf"\s?(?:\(dot\)|\[dot\])\s?|\.|\s(?:{_shape('точка')}|{_shape('крапка')}|dot)\s"
NO_WORDS = re.compile(rf"(?:https?://|www\.)[^\s{END}]+|(?<![\w.+-])[\w.+-]+(?:{_AT})[\w-]+(?:(?:{_DOT})[\w-]+)*|[#@][^\s{END}]+|\[[^\]\n{END}]{{1,24}}\]|\d+")
BOUND = re.compile(rf"[.!?…]+(?=[\s{END}]|$)|\n+| [/|] |:\s")
ALPHABET = " 'ßabcdefghijklmnopqrstuvwxyzбвгґджзиклмнптфцчшщъыьэюяє"
INDEX = np.zeros(0x110000, np.uint8)
for _i, _c in enumerate(ALPHABET):
    INDEX[ord(_c)] = _i
#: Letters that one segment is parsed in at a time; longer ones are parsed piece by piece, whole.
PIECE = 400


def label_code(label: Column) -> Column:
    """The language that a label names, null if it names none of LANGUAGES."""
    first = F.regexp_extract(F.lower(F.trim(label)), r"^[\p{L}]+", 0)
    code = F.lit(None).cast("string")
    for lang, names in NAMES.items():
        code = F.when(first.isin(*names), F.lit(lang)).otherwise(code)
    return code


def segments(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letters (indices in ALPHABET, words divided by one space) of all segments of all texts.

    Gives them with the offsets of the segments, and each segment's text, and first and last
    position there. Segments without letters are left out.
    """
    codes, offsets = fold.codes_of(list(texts))
    low = fold.FOLD[codes]
    low[(low == ord(END)) | (low == ord(STOP))] = 0x20
    mask = low != fold.GONE
    where = np.flatnonzero(mask)
    low, offsets2 = fold.keep(low, offsets, mask)
    ends = np.insert(low, offsets2[1:], ord(END))
    where = np.insert(where, offsets2[1:], -1)
    joined = ends.astype("<u4").tobytes().decode("utf-32-le", "replace")
    joined = NO_WORDS.sub(lambda m: " " * len(m[0]), joined)
    joined = BOUND.sub(lambda m: STOP * len(m[0]), joined)
    chars = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    doc = np.cumsum(chars == ord(END)) - (chars == ord(END))
    stop = (chars == ord(END)) | (chars == ord(STOP))
    seg = np.cumsum(stop)
    idx = INDEX[chars]
    letter = (idx > 1) & ~stop
    # one space before each word of a segment
    prev = np.zeros(len(idx), bool)
    prev[1:] = letter[:-1] | (idx[:-1] == 1)
    keepit = letter | ((idx == 1) & prev)
    start = letter & ~prev
    seg_l, doc_l, pos_l, idx_l = seg[keepit], doc[keepit], where[keepit], idx[keepit]
    before = start[keepit]
    # insert the space in front of word starts
    at = np.flatnonzero(before)
    idx_l, seg_l, doc_l, pos_l = (np.insert(x, at, v) for x, v in ((idx_l, np.zeros(len(at), np.uint8)), (seg_l, seg_l[at]), (doc_l, doc_l[at]), (pos_l, pos_l[at])))
    if not len(idx_l):
        none = np.zeros(0, np.int64)
        return idx_l, np.zeros(1, np.int64), none, none, none
    first = np.flatnonzero(np.concatenate([[True], seg_l[1:] != seg_l[:-1]]))
    bounds = np.concatenate([first, [len(idx_l)]])
    d = doc_l[first]
    return idx_l, bounds, d, pos_l[first] - offsets[d], pos_l[bounds[1:] - 1] - offsets[d] + 1


def automaton(parts: Sequence[np.ndarray]) -> np.ndarray:
    """Suffix automaton of the parts: a row for each state, the next state by letter, 0 for none."""
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    for part in parts:
        last = 0
        for c in part.tolist():
            q = nxt[last].get(c)
            if q is not None:
                if length[q] == length[last] + 1:
                    last = q
                    continue
                cur = len(nxt)
                nxt.append(nxt[q].copy())
                length.append(length[last] + 1)
                link.append(link[q])
                link[q] = cur
                p = last
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = cur
                    p = link[p]
                last = cur
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    twin = len(nxt)
                    nxt.append(nxt[q].copy())
                    length.append(length[p] + 1)
                    link.append(link[q])
                    link[q] = link[cur] = twin
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = twin
                        p = link[p]
            last = cur
    table = np.zeros((len(nxt), len(ALPHABET)), np.int32)
    for s, t in enumerate(nxt):
        for c, v in t.items():
            table[s, c] = v
    return table


class CrossParser:
    """Counts, for each language, the phrases into which its automaton parses a segment."""

    def __init__(self, tables: Mapping[str, np.ndarray]) -> None:
        self.languages = tuple(tables)
        starts = np.cumsum([0, *[len(t) for t in tables.values()]])
        # one table of all automata; a state is a row of it, a language's root its first row
        self.root = starts[:-1].astype(np.int64)
        self.next = np.concatenate([np.where(t > 0, t + s, 0) for t, s in zip(tables.values(), starts, strict=False)]).astype(np.int32).ravel()
        self.size = np.log2(np.maximum(2, [len(t) for t in tables.values()]))

    def phrases(self, letters: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Phrases of each segment (row) in each language (column), all segments in lockstep."""
        size = np.diff(bounds)
        pieces = np.maximum(1, -(-size // PIECE))
        owner = np.repeat(np.arange(len(size)), pieces)
        rank = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = bounds[:-1][owner] + rank * PIECE
        length = np.minimum(PIECE, bounds[1:][owner] - begin)
        order = np.argsort(-length, kind="stable")
        begin, length, owner = begin[order], length[order], owner[order]
        width, k = len(ALPHABET), len(self.root)
        state = np.repeat(self.root[:, None], len(order), 1)
        count = np.zeros((k, len(order)), np.int32)
        # active pieces at each step: those longer than it
        active = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), side="left")
        for j, n in enumerate(active.tolist()):
            c = letters[begin[:n] + j].astype(np.int64)
            s = state[:, :n]
            step = self.next[s * width + c]
            dead = step == 0
            count[:, :n] += dead | (s == self.root[:, None])
            if dead.any():
                again = self.next[self.root[:, None] * width + c[None, :]]
                step = np.where(dead, np.where(again > 0, again, self.root[:, None]), step)
            state[:, :n] = step
        total = np.zeros((len(size), k), np.int64)
        np.add.at(total, owner, count.T)
        return total

    def bits(self, letters: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Phrases times the bits that name one, the cost of a segment in each language."""
        return self.phrases(letters, bounds) * self.size[None, :]


def romanised(text: str, lang: str, second: bool) -> str:
    table = LATIN | (UKRAINIAN if lang == "uk" else {}) | (SECOND if second else {})
    return "".join(table.get(c, c) for c in text.lower())


def consistent(parts: Mapping[str, Sequence[np.ndarray]], rounds: int = 5) -> dict[str, list[np.ndarray]]:
    """The segments that belong to the language of their label.

    Labels may be wrong, and the automata know presence only, so one segment under a wrong label
    would win for good. A segment is judged by how often its four-letter runs occur in each language's
    kept segments and, where it occurs more than once, by the labels of its other copies. How
    likely a language gets each label is estimated from the judgements of the round before: a
    frequent language strays into the labels of a rare one more often than the other way round.
    """
    width, n = 1 << 18, len(LANGUAGES)
    rows = [(lang, r) for lang, rs in parts.items() for r in rs]
    if not rows:
        return {lang: [] for lang in parts}
    runs = []
    for _, r in rows:
        x = np.concatenate([r, np.zeros(3, np.uint8)]).astype(np.int64)
        runs.append(((x[:-3] * 64 + x[1:-2]) * 64 + x[2:-1]) * 64 + x[3:])
    size = np.array([len(x) for x in runs])
    at = (np.concatenate(runs).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(46)).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), size)
    label = np.array([LANGUAGES.index(lang) for lang, _ in rows])
    _, same = np.unique([r.tobytes() for _, r in rows], return_inverse=True)
    copies = np.stack([np.bincount(same[label == k], minlength=same.max() + 1)[same] - (label == k) for k in range(n)], axis=1)
    keep = np.ones(len(rows), bool)
    strays = None
    for _ in range(rounds):
        score = np.zeros((len(rows), n))
        for k in range(n):
            ours = keep & (label == k)
            # a row's own part of the counts is taken off, or rare runs would speak for its label
            runs_k = np.bincount(at[ours[owner]], minlength=width)
            left = np.maximum(runs_k[at] - ours[owner], 0) + 0.05
            score[:, k] = np.bincount(owner, np.log(left / (runs_k.sum() + 0.05 * width)), len(rows))
        if strays is not None:
            # as strong as the runs, which are not independent of each other
            score += size[:, None] / 4 * (copies @ np.log(strays).T)
        best = score.argmax(axis=1)
        keep = best == label
        strays = np.bincount(best * n + label, minlength=n * n).reshape(n, n) + 0.5
        strays /= strays.sum(axis=1, keepdims=True)
    out: dict[str, list[np.ndarray]] = {lang: [] for lang in parts}
    for (lang, r), k in zip(rows, keep, strict=True):
        if k:
            out[lang].append(r)
    return out


def fit(sample: Mapping[str, Sequence[str]], letters: int = LETTERS) -> CrossParser:
    """Automata of labelled texts, from the segments that are consistent with their labels."""
    parts: dict[str, list[np.ndarray]] = {}
    for lang in LANGUAGES:
        x, b, *_ = segments(list(sample.get(lang, ())))
        parts[lang] = [x[i:j] for i, j in zip(b[:-1], b[1:], strict=True) if j - i >= 6]
    # an automaton gains nothing from a segment that it has
    parts = {lang: list({r.tobytes(): r for r in rows}.values()) for lang, rows in consistent(parts).items()}

    def first(rows: list[np.ndarray], most: int) -> list[np.ndarray]:
        size = np.cumsum([len(r) for r in rows]) if rows else np.zeros(0)
        return rows[: int(np.searchsorted(size, most))]

    out = {}
    for lang in LANGUAGES:
        rows = parts[lang]
        if lang in ("ru", "uk") and rows:
            # letters were folded, so they are unfolded before they are romanised
            back = {v: k for k, v in fold.SAME_SHAPE.items() if "Ѐ" <= k <= "ӿ"}
            rows, extra = first(rows, int(letters * NATIVE)), []
            for i, r in enumerate(rows):
                s = "".join(ALPHABET[c] for c in r.tolist())
                if any("а" <= c <= "я" for c in s):
                    text = romanised("".join(back.get(c, c) for c in s), lang, i % 3 == 2)
                    extra += [x[a:b] for x, bb, *_ in [segments([text])] for a, b in zip(bb[:-1], bb[1:], strict=True)]
            rows = rows + first(extra, letters - sum(map(len, rows)))
        out[lang] = automaton(first(rows, letters))
    return CrossParser(out)


#: A segment is given another language than its text only if it has this many letters, and
#: parsing it in the text's language costs this many times the bits, and this many bits, more.
OWN_LETTERS, OWN_RATIO, OWN_BITS = 8, 1.35, 25.0
#: Bits by which one language must be cheaper for a confidence of about 0.73.
UNIT_BITS = 12.0


def detect(model: CrossParser, texts: Sequence[str]) -> pd.DataFrame:
    """A row for each segment with words: text number, begin, end, language, confidence, and the text's own language."""
    x, bounds, doc, begin, end = segments(texts)
    cols = ["doc", "begin", "end", "lang", "confidence", "main"]
    if not len(doc):
        return pd.DataFrame({c: pd.Series(dtype="object" if c in ("lang", "main") else "float64") for c in cols})
    cost = model.bits(x, bounds)
    size = np.diff(bounds)
    k = cost.shape[1]
    whole = np.zeros((int(doc[-1]) + 1, k))
    np.add.at(whole, doc, cost)
    main = whole.argmin(axis=1)
    # the main language is that of most letters among the segments' own winners, so that one long odd segment doesn't decide
    win = cost.argmin(axis=1)
    votes = np.zeros_like(whole)
    np.add.at(votes, (doc, win), size)
    main = np.where(votes.max(axis=1) > 0.5 * votes.sum(axis=1), votes.argmax(axis=1), main)
    here = main[doc]
    rows = np.arange(len(doc))
    best, usual = cost[rows, win], cost[rows, here]
    letters = np.add.reduceat((x > 1).astype(np.int64), bounds[:-1])
    other = (win != here) & (letters >= OWN_LETTERS) & (usual >= OWN_RATIO * best) & (usual - best >= OWN_BITS)
    lang = np.where(other, win, here)
    gap = (cost - cost[rows, lang][:, None]) / UNIT_BITS
    confidence = 1 / np.exp(-np.clip(gap, -30, 60)).sum(axis=1)
    names = np.array(model.languages, object)
    return pd.DataFrame({"doc": doc, "begin": begin, "end": end, "lang": names[lang], "confidence": confidence, "main": names[here]})


def hash_bound(wanted: int, n: int) -> int:
    """Signed 64-bit hashes below this bound are ``wanted`` of ``n``, in expectation; all of them if n is not larger."""
    return (1 << 63) - 1 if wanted >= n else (wanted << 64) // n - (1 << 63)


def sampled(df: DataFrame, id_col: str, text_col: str, label_col: str, per_language: int = SAMPLE) -> dict[str, list[str]]:
    """The texts of ``per_language`` labelled rows of each language at most, those with the least hashes of id and text.

    Rows are sampled, not different texts, so that what is said often is in the sample. The bound is
    exact to one row whatever the size of the table. A language with labelled rows of which none is
    sampled is an error. A table without labels gives no samples.
    """
    rows = df.select(label_code(F.col(label_col)).alias("lang"), F.col(id_col).alias("k"), F.col(text_col).alias("t")).filter(F.col("lang").isNotNull() & (F.length("t") >= 12))
    n = {r["lang"]: r["c"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("c")).collect()}
    if not n:
        return {}
    # twice as many as wanted pass the bound, so that chance leaves enough; the least hashes are taken
    h, bound = F.xxhash64("k", "t"), F.lit(-(1 << 63))
    for lang, c in n.items():
        bound = F.when(F.col("lang") == lang, F.lit(hash_bound(2 * per_language, c))).otherwise(bound)
    out: dict[str, list[str]] = {k: [] for k in n}
    for r in rows.filter(h <= bound).select("lang", "t", h.alias("h")).orderBy("h", "lang", "t").limit(4 * per_language * len(n)).collect():  # bounded by per_language
        if len(out[r["lang"]]) < per_language:
            out[r["lang"]].append(r["t"])
    if not all(out.values()):
        raise RuntimeError(f"no sample of {sorted(k for k, v in out.items() if not v)}")
    return out


SEGMENTS = "k bigint, begin int, end int, lang string, confidence double, main string"


def segment_languages(df: DataFrame, id_col: str, text_col: str, model: CrossParser) -> DataFrame:
    """Columns ``id_col``, begin, end (code points), lang, confidence, main: a row for each segment with words.

    Null, empty and wordless texts have no row. Texts of any length are parsed whole. Equal costs
    go to the language that comes first in LANGUAGES; a row that is there twice repeats its segments.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in (whole.iloc[i:j] for whole in parts for i, j in fold.slices(whole["t"].tolist())):
            out = detect(shared.value, part["t"].tolist())
            ids = part["k"].to_numpy()
            yield pd.DataFrame({"k": ids[out["doc"].to_numpy(np.int64)], "begin": out["begin"].astype("int32"), "end": out["end"].astype("int32"), "lang": out["lang"], "confidence": out["confidence"].astype("float64"), "main": out["main"]})

    part = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).filter(F.col("t").isNotNull())
    return part.mapInPandas(run, SEGMENTS).withColumnRenamed("k", id_col)


def wrong_labels(df: DataFrame, id_col: str, text_col: str, label_col: str, model: CrossParser) -> DataFrame:
    """Columns ``id_col``, lang: a row for each language of a text whose label names no language or
    another one, or that has segments in more than one language. Texts without words have no row."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in (whole.iloc[i:j] for whole in parts for i, j in fold.slices(whole["t"].tolist())):
            out = detect(shared.value, part["t"].tolist())[["doc", "lang"]].drop_duplicates()
            doc = out["doc"].to_numpy(np.int64)
            several = np.bincount(doc, minlength=len(part))[doc] > 1 if len(doc) else np.zeros(0, bool)
            found = several | (out["lang"].to_numpy() != part["label"].to_numpy()[doc])
            yield pd.DataFrame({"k": part["k"].to_numpy()[doc[found]], "lang": out["lang"].to_numpy()[found]})

    part = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"), label_code(F.col(label_col)).alias("label")).filter(F.col("t").isNotNull())
    return part.mapInPandas(run, "k bigint, lang string").withColumnRenamed("k", id_col)
