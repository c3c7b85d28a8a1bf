"""Column functions that parse durations, times, flags and the JSON that language models return."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions import text as X


def duration_seconds(c: Column) -> Column:
    """Seconds of an ISO-8601 duration of days, hours, minutes and seconds; null if it is none."""
    pattern = r"^P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?$"
    n = [F.coalesce(F.nullif(F.regexp_extract(c, pattern, i), F.lit("")).try_cast("int"), F.lit(0)) for i in (1, 2, 3, 4)]
    return F.when(c.rlike(pattern) & (c != "P"), n[0] * 86400 + n[1] * 3600 + n[2] * 60 + n[3])


def clock_time(c: Column) -> Column:
    """HH:MM of a time of day, null if it is none."""
    t = X.stripped(c)
    return F.when(t.rlike(r"^([01]?\d|2[0-3]):[0-5]\d$"), F.lpad(t, 5, "0"))


def iso_date(c: Column) -> Column:
    return F.try_to_date(F.substring(X.stripped(c), 1, 10), "yyyy-MM-dd")


def truth(c: Column, default: bool = False) -> Column:
    """Boolean of the usual words and numbers, else the default."""
    t = F.lower(X.stripped(c.cast("string")))
    return F.when(t.isin("1", "true", "yes", "on", "да"), True).when(t.isin("0", "false", "no", "off", "нет", ""), False).otherwise(F.lit(default))


def threshold(c: Column) -> Column:
    """A share from 0 to 1; values from 1 to 100 are per cent."""
    v = F.when((c > 1) & (c <= 100), c / 100.0).otherwise(c)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def balanced_object(s: str | None) -> str | None:
    """The first complete JSON object in a text, fenced or surrounded by words; null if there is none."""
    if not s:
        return None
    depth, start, quoted, escaped = 0, -1, False, False
    for i, c in enumerate(s):
        if start < 0:
            if c == "{":
                start, depth = i, 1
            continue
        if escaped:
            escaped = False
        elif c == "\\" and quoted:
            escaped = True
        elif c == '"':
            quoted = not quoted
        elif not quoted and c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return s[start : i + 1]
    return None


@F.pandas_udf(T.StringType())
def lenient_object(s: pd.Series) -> pd.Series:
    """Column form of ``balanced_object``; scanning braces has no built-in function."""
    return s.map(balanced_object)


def unwrapped(c: Column, names: tuple[str, ...] = ("result", "response", "data", "output")) -> Column:
    """The object inside one of the usual wrappers, else the object itself, as JSON text."""
    inner = [F.get_json_object(c, f"$.{n}") for n in names]
    return F.coalesce(*[F.when(X.stripped(i).startswith("{"), i) for i in inner], c)


def scored_results(c: Column) -> Column:
    """Array of (number, category, score) from {"results": {"1": "question:7"}}; broken entries are left out, scores kept within 1 and 10."""
    entries = F.map_entries(F.from_json(c, "results map<string,string>")["results"])

    def one(e: Column) -> Column:
        part = F.split(e["value"], ":")
        score = F.coalesce(F.try_element_at(part, F.lit(2)).try_cast("int"), F.lit(5))
        return F.struct(e["key"].try_cast("int").alias("number"), F.lower(F.trim(part[0])).alias("category"), F.greatest(F.lit(1), F.least(F.lit(10), score)).alias("score"))

    ok = ("toxic", "criticism", "question", "appeal", "skip")
    return F.filter(F.transform(entries, one), lambda x: x["number"].isNotNull() & x["category"].isin(*ok))


def merged_counts(a: Column, b: Column) -> Column:
    """Maps of counts added key by key."""
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def safe_text(c: Column) -> Column:
    """Text without control characters that JSON does not allow."""
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def cache_key(c: Column, prefix: str = "") -> Column:
    """A key that is safe as a file name: the value if it is plain and short, else its hash."""
    v = F.concat(F.lit(prefix), c)
    return F.when(v.rlike(r"^[A-Za-z0-9._-]{1,80}$"), v).otherwise(F.sha2(v, 256))


def plural(n: Column, one: str, few: str, many: str) -> Column:
    """The Slavic form of a noun after a number."""
    ten, hundred = n % 10, n % 100
    return F.when((ten == 1) & (hundred != 11), one).when(ten.between(2, 4) & ~hundred.between(12, 14), few).otherwise(many)

