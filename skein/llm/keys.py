"""Comparison keys: text without letter case, white space and punctuation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode punctuation, separators and the white-space controls; symbols and invisible characters stay.
IGNORED = r"[\p{P}\p{Z}\x{9}-\x{D}\x{1C}-\x{1F}\x{85}]+"


def bare(c: Column) -> Column:
    """Null stays null. The way through upper case makes forms equal whose case differs in length."""
    return F.lower(F.upper(F.regexp_replace(c, IGNORED, "")))
