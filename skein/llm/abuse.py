"""Problem 6: abusive, hateful or sexual content (multiple-instance learning, noisy-or)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import fold
from skein.llm.language import hash_bound

#: Labelled texts that the model is trained on, chosen by a hash of the text.
SAMPLE = 16_000
BUCKETS = 1 << 18
RUNS = (3, 4, 5)
#: Share of labels taken to be wrong, and the fewest sentences with a feature.
NOISE, LEAST = 0.05, 3
SPACE, MASK = 0x20, ord("*")
#: A long sentence is scored by the worst of overlapping windows of so many characters.
WINDOW = 48


def _table() -> np.ndarray:
    lut = fold.FOLD.copy()
    lut[[ord(c) for c in "иИйЙ"]] = ord("u")
    lut[ord("@")] = ord("a")
    lut[fold.FOLD == ord("@")] = ord("a")
    for d in range(0x30, 0x3A):
        lut[fold.FOLD == d] = 0x30
    return lut


SHAPE = _table()
LETTERS = fold.LETTER.copy()
LETTERS[[MASK, 0x30]] = True
STOPS = np.zeros(0x110000, bool)
STOPS[[0xA, *map(ord, ".!?…")]] = True


def _past(x: np.ndarray, n: int) -> np.ndarray:
    """``x`` shifted so that place i holds x[i + n]; False beyond the ends."""
    out = np.zeros_like(x)
    if n >= 0:
        out[: max(0, len(x) - n)] = x[n:]
    else:
        out[-n:] = x[:n]
    return out


def sentences(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all sentences in the form that spelling tricks leave alike, the sentences'
    offsets, and each one's text, begin and end there.

    Letters set apart one by one are joined, repeated letters are one, look-alikes and accents
    are folded, masks stay as one mark. A sentence begins and ends with a space.
    """
    codes, offsets = fold.codes_of(list(texts))
    low = SHAPE[codes]
    low[low == 1] = SPACE
    mask = low != fold.GONE
    where = np.flatnonzero(mask)
    low, offsets2 = fold.keep(low, offsets, mask)
    low = np.insert(low, offsets2[1:], 1)  # 1 ends a text
    where = np.insert(where, offsets2[1:], -1)
    doc = np.cumsum(low == 1) - (low == 1)
    letter = LETTERS[low]
    apart = letter & ~_past(letter, -1) & ~_past(letter, 1)
    run = apart & _past(apart, 2) & _past(apart, 4) & ~STOPS[_past(low, 1)] | apart & _past(apart, 2) & _past(apart, 4) & _past(apart, 6)
    same = (_past(low, 1) == _past(low, 3)) & (_past(low, 1) != 1)
    run &= same
    gap = np.zeros(len(low), bool)
    gap |= _past(run, -1)
    gap |= _past(run, -3)
    tail = apart & _past(apart, -2) & _past(gap, -3) & (_past(low, -1) == _past(low, -3))
    gap |= _past(tail, 1)
    low, where, doc = low[~gap], where[~gap], doc[~gap]
    letter = LETTERS[low]
    ends = (low == 1) | (STOPS[low] & (~_past(letter, 1) | (low == 0xA)))
    seg = np.cumsum(ends) - ends
    again = letter & (low == np.concatenate([[0], low[:-1]])) & (low != 0x30)
    blank = ~letter & ~ends
    low = np.where(blank, SPACE, low)
    before = np.concatenate([[True], (blank | ends)[:-1]])
    keepit = ~ends & ~again & ~(blank & before)
    low, seg, doc, where = low[keepit], seg[keepit], doc[keepit], where[keepit]
    if not len(low):
        none = np.zeros(0, np.int64)
        return low, np.zeros(1, np.int64), none, none, none
    first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
    stop = np.concatenate([first[1:], [len(low)]])
    d, begin, end = doc[first], where[first] - offsets[doc[first]], where[stop - 1] - offsets[doc[first]] + 1
    # a space on both sides
    chars = np.insert(low, np.concatenate([first, stop]), SPACE)
    size = stop - first + 2
    order = np.insert(np.repeat(np.arange(len(first)), stop - first), np.concatenate([first, stop]), np.concatenate([np.arange(len(first))] * 2))
    if np.any(np.diff(order) < 0):  # spaces of neighbours met in the wrong order
        chars = chars[np.argsort(order, kind="stable")]
    return chars, np.concatenate([[0], np.cumsum(size)]), d, begin, end


def features(chars: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of characters within a sentence, and the sentence of each."""
    size = np.diff(bounds)
    owner = np.repeat(np.arange(len(size)), size)
    left = np.repeat(bounds[1:], size) - np.arange(len(chars))
    hashes, owners = [], []
    h = np.zeros(len(chars), np.uint64)
    c = chars.astype(np.uint64)
    for k in range(max(RUNS)):
        h[: len(c) - k] = (h[: len(c) - k] * np.uint64(0x100000001B3)) ^ c[k:] if k else c
        if k + 1 in RUNS:
            ok = left > k
            x = h[ok]
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            hashes.append((x >> np.uint64(64 - 18)).astype(np.int64))
            owners.append(owner[ok])
    return np.concatenate(hashes), np.concatenate(owners)


def windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of the windows of all sentences, and the sentence of each."""
    size = np.diff(bounds)
    n = np.maximum(1, -(-(size - WINDOW) // (WINDOW // 2)) + 1)
    owner = np.repeat(np.arange(len(size)), n)
    begin = bounds[:-1][owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)) * (WINDOW // 2)
    return begin, np.minimum(begin + WINDOW, bounds[1:][owner]), owner


def cut(chars: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all windows one after another, and the windows' offsets."""
    size = end - begin
    offsets = np.concatenate([[0], np.cumsum(size)])
    return chars[np.repeat(begin - offsets[:-1], size) + np.arange(offsets[-1])], offsets


class Scorer:
    """Probability that a sentence is abusive: a logistic function of the weights of its runs."""

    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights.astype(np.float32), float(bias)

    def sentence_scores(self, chars: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        begin, end, sentence = windows(bounds)
        flat, offsets = cut(chars, begin, end)
        at, owner = features(flat, offsets)
        n = len(begin)
        total = np.bincount(owner, self.weights[at], n)
        size = np.maximum(1, np.bincount(owner, minlength=n))
        z = np.maximum.reduceat(total / np.sqrt(size), np.searchsorted(sentence, np.arange(len(bounds) - 1)))
        return 1 / (1 + np.exp(-np.clip(z + self.bias, -30, 30)))


def noisy_or(score: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """1 - prod(1 - score) over the sentences of each text; 0 for a text without sentences."""
    return 1 - np.exp(np.bincount(doc, np.log1p(-np.minimum(score, 1 - 1e-9)), n))


def train(texts: Sequence[str], labels: Sequence[bool], steps: int = 120, rate: float = 0.25, decay: float = 1e-4) -> Scorer:
    """Fit sentence weights from labels of whole texts.

    A text is abusive unless all its sentences are harmless (noisy-or), and a label is wrong with
    probability NOISE, so that single wrong labels pull little. Full-batch Adagrad.
    """
    chars, bounds, doc, *_ = sentences(texts)
    y = np.asarray(labels, float)
    bias = -2.0
    if not len(doc):
        return Scorer(np.zeros(BUCKETS), bias)
    # equal sentences are one row
    keys = [chars[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    first: dict[bytes, int] = {}
    kind = np.array([first.setdefault(k, len(first)) for k in keys])
    rows = np.full(len(first), -1)
    rows[kind[::-1]] = np.arange(len(kind))[::-1]
    flat, inner = cut(chars, bounds[:-1][rows], bounds[1:][rows])
    begin, end, sentence = windows(inner)
    at, owner = features(*cut(flat, begin, end))
    head = np.searchsorted(sentence, np.arange(len(rows)))
    pair = np.unique(sentence[owner] * BUCKETS + at)
    held = np.bincount(pair % BUCKETS, np.bincount(kind)[pair // BUCKETS], BUCKETS) >= LEAST
    ok = held[at]
    count = np.maximum(1, np.bincount(owner, minlength=len(begin)))
    at, owner = at[ok], owner[ok]
    share = 1 / np.sqrt(count)
    value = share[owner]
    w = np.zeros(BUCKETS)
    g2, b2 = np.full(BUCKETS, 1e-4), 1e-4
    n = len(y)
    for _ in range(steps):
        z = np.bincount(owner, w[at] * value, len(begin))
        top = np.maximum.reduceat(z, head)
        worst = z == top[sentence]
        p = 1 / (1 + np.exp(-np.clip(top + bias, -30, 30)))
        s = p[kind]
        none = np.exp(np.bincount(doc, np.log1p(-np.minimum(s, 1 - 1e-9)), n))
        q = NOISE + (1 - 2 * NOISE) * (1 - none)
        slope = (y / q - (1 - y) / (1 - q)) * (1 - 2 * NOISE)
        # d(1 - none)/ds = none / (1 - s), ds/dz = s (1 - s)
        dz = np.bincount(kind, (slope * none)[doc] * s, len(rows))
        g = np.bincount(at, (dz[sentence] * worst)[owner] * value, BUCKETS) - decay * n * w
        g2 += g * g
        w += rate * g / np.sqrt(g2)
        b = float(dz.sum())
        b2 += b * b
        bias += 0.1 * b / np.sqrt(b2)
    return Scorer(w, bias)


def sampled(df: DataFrame, text_col: str, label_col: str, most: int = SAMPLE) -> tuple[list[str], list[bool]]:
    """``most`` different labelled texts at most, those with the least hashes; texts with opposite labels are left out.

    The bound of the hash is exact to one row whatever the size of the table. A large table of
    which none is sampled is an error; one without usable labels gives no samples.
    """
    rows = df.select(F.col(text_col).alias("t"), F.col(label_col).alias("y")).filter(F.col("t").isNotNull() & F.col("y").isNotNull())
    h = F.xxhash64("t")
    n = rows.agg(F.approx_count_distinct(h)).first()[0]
    rows = rows.filter(h <= hash_bound(2 * most, n))
    rows = rows.groupBy("t").agg(F.min("y").alias("y"), F.max("y").alias("z")).filter(F.col("y") == F.col("z"))
    got = rows.orderBy(F.xxhash64("t"), "t").limit(most).select("t", "y").collect()  # bounded by most
    if n > 2 * most and not got:
        raise RuntimeError("no sample of the labelled texts")
    return [r["t"] for r in got], [r["y"] for r in got]


SCORES = "score double, begin int, end int, worst double"


def scored(df: DataFrame, id_col: str, text_col: str, model: Scorer, carried: Sequence[str] = ()) -> DataFrame:
    """Columns ``id_col``, ``carried``, score, begin, end, worst: the text's score, and place and score of its worst sentence.

    Texts that are null or hold no word score 0 and have no sentence. Texts are read whole. Of
    sentences with equal scores the first is named. Each row of the table gives one row.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in (whole.iloc[i:j] for whole in parts for i, j in fold.slices(whole["t"].tolist())):
            texts = [t or "" for t in part["t"].tolist()]
            chars, bounds, doc, begin, end = sentences(texts)
            n = len(texts)
            out = part.drop(columns="t").reset_index(drop=True)
            out["score"] = np.zeros(n)
            out["begin"] = out["end"] = pd.array([None] * n, dtype="Int32")
            out["worst"] = np.nan
            if len(doc):
                s = shared.value.sentence_scores(chars, bounds)
                out["score"] = noisy_or(s, doc, n)
                order = np.lexsort((begin, -s, doc))
                top = order[np.concatenate([[True], doc[order][1:] != doc[order][:-1]])]
                at = doc[top]
                b, e, w = np.zeros(n, np.int32), np.zeros(n, np.int32), np.full(n, np.nan)
                b[at], e[at], w[at] = begin[top], end[top], s[top]
                has = np.zeros(n, bool)
                has[at] = True
                out["begin"] = pd.Series(b).astype("Int32").where(pd.Series(has))
                out["end"] = pd.Series(e).astype("Int32").where(pd.Series(has))
                out["worst"] = w
            yield out

    part = df.select(F.col(id_col).alias("k"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carried)], F.col(text_col).alias("t"))
    kinds = "".join(f", c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(carried))
    out = part.mapInPandas(run, f"k bigint{kinds}, {SCORES}")
    return out.select(F.col("k").alias(id_col), *[F.col(f"c{i}").alias(c) for i, c in enumerate(carried)], "score", "begin", "end", "worst")
