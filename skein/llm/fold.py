"""Texts of an Arrow batch as one array of folded code points.

Folding removes what makes equal-looking letters differ: case, width, accents, invisible
characters, and letters of another alphabet with the same shape. It serves features and
statistics only; texts that come out of an operator are never folded.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np

# Cyrillic and Greek letters (lower case) and the Latin letter of the same shape.
SAME_SHAPE = dict(zip("аеорсухіјѕԁһԛԝοεακρτυχν", "aeopcyxijsdhqwoeakptuxv", strict=True))
INVISIBLE = [0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x206A), 0xFEFF, *range(0xFE00, 0xFE10)]
GONE = 0


def fold_table() -> np.ndarray:
    """For each code point the folded one, or GONE."""
    lut = np.arange(0x110000, dtype=np.uint32)
    for cp in [*range(0x20, 0x2200), *range(0xFF01, 0xFF5F), 0x3000]:
        base = unicodedata.normalize("NFKD", chr(cp))
        kept = [c for c in base if not unicodedata.combining(c)]
        if not kept:
            lut[cp] = GONE
        elif len(kept) == 1 or cp > 0xFF00:
            low = kept[0].lower()
            low = unicodedata.normalize("NFKD", low)[0]
            lut[cp] = ord(SAME_SHAPE.get(low, low))
    lut[INVISIBLE] = GONE
    for cp in range(0x1C, 0x20):
        lut[cp] = 0x20
    lut[[0x9, 0xB, 0xC, 0x85, 0x2028, 0x2029]] = 0x20
    lut[0xD] = 0xA
    return lut


FOLD = fold_table()
LETTER = np.zeros(0x110000, bool)
for _cp in range(0x20, 0x3000):
    if unicodedata.category(chr(_cp))[0] == "L":
        LETTER[_cp] = True


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after another, and the n+1 offsets of the texts."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    raw = "".join(texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(raw, np.uint32), np.concatenate([[0], np.cumsum(size)])


def keep(codes: np.ndarray, offsets: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Only the code points where ``mask`` holds, with the offsets moved accordingly."""
    before = np.concatenate([[0], np.cumsum(mask)])
    return codes[mask], before[offsets]


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    codes, offsets = codes_of(texts)
    codes = FOLD[codes]
    return keep(codes, offsets, codes != GONE)


def slices(texts: Sequence[str | None], most: int = 1_500_000) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts with about ``most`` characters, so that arrays of a batch stay small.

    A single longer text is a run of its own.
    """
    start = total = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)
