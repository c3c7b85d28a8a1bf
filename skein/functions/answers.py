"""Parsers of a model's answers about a numbered batch: {"results": {"1": ...}}, fenced or with words around it.

Each takes a column of answers and gives an array of structs with the number. Numbers beyond the
batch are left out, bad fields take defaults and scores their limits, so that no answer fails a task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.parsing import lenient_object
from skein.operators.appeal import strict_score

# What a model may answer.
CATEGORIES = ("toxic", "criticism", "question", "appeal", "skip")
SCORED = ("criticism", "question")
TOPICS = ("Ukraine_Russia", "Israel_Palestine_Iran", "USA", "Economy", "AI", "Philosophy", "Life", "Other")
REAL_TYPES = ("myth_claim", "fact_check", "analysis_why_how", "prediction_what_next", "strategy_advice", "clarification_needed")
LOW_TYPES = ("attack_ragebait", "meme_one_liner")
TARGETS = ("author", "guest", "content", "undefined", "third_party")
YES = ("true", "yes", "1", "keep")
EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F9FF}\x{2600}-\x{27BF}\x{1FA00}-\x{1FAFF}]+"
CURLY = "[«»„\"“”‘’]"


def _entries(c: Column, most: int) -> Column:
    """Number and value of each entry of the answer's results, or of the answer itself, for the numbers 1 to ``most``."""
    body = lenient_object(c)
    inner = F.get_json_object(body, "$.results")
    pairs = F.map_entries(F.from_json(F.when(F.startswith(inner, F.lit("{")), inner).otherwise(body), "map<string,string>"))
    numbered = F.transform(pairs, lambda e: F.struct(F.when(e["key"].rlike("^[1-9][0-9]{0,8}$"), e["key"].try_cast("int")).alias("number"), e["value"].alias("value")))
    return F.coalesce(F.filter(numbered, lambda e: e["number"].between(1, most)), F.array().cast("array<struct<number:int,value:string>>"))


def _each(c: Column, most: int, one: Callable[[Column], Column], ok: Callable[[Column], Column] | None = None) -> Column:
    rows = F.transform(_entries(c, most), one)
    return rows if ok is None else F.filter(rows, ok)


def _is_object(e: Column) -> Column:
    return F.coalesce(F.startswith(F.ltrim(e["value"]), F.lit("{")), F.lit(False))


def _within(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def _whole(value: Column, low: int, high: int, default: int) -> Column:
    return _within(F.coalesce(F.trim(value).try_cast("double").cast("int"), F.lit(default)), low, high)


def _share(value: Column) -> Column:
    return _within(F.coalesce(F.trim(value).try_cast("double"), F.lit(0.0)), 0.0, 1.0)


def unified(c: Column, most: int) -> Column:
    """Number, category, score from "question:7" or "toxic"; without a score 5 for criticism and questions, else 0."""

    def one(e: Column) -> Column:
        low = F.lower(F.trim(e["value"]))
        scored = F.contains(low, F.lit(":"))
        kind = F.when(scored, F.trim(F.regexp_replace(low, ":[^:]*$", ""))).otherwise(low)
        default = F.when(kind.isin(*SCORED), 5).otherwise(0)
        given = F.trim(F.regexp_extract(low, ":([^:]*)$", 1)).try_cast("int")
        score = F.when(scored & given.isNotNull(), _within(given, 1, 10)).otherwise(default)
        return F.struct(e["number"].alias("number"), kind.alias("category"), score.cast("int").alias("score"))

    return _each(c, most, one, lambda r: r["category"].isin(*CATEGORIES))


def short_form(c: Column, kind: Column) -> Column:
    """A summary without pictographs and quotation marks, of 160 characters at most. Real questions end with
    a question mark, low-value ones without; null if nothing is left."""
    t = F.regexp_replace(F.regexp_replace(c, EMOJI, ""), CURLY, "")
    t = F.regexp_replace(F.regexp_replace(t, "^[ \\t\\n\"']+|[ \\t\\n\"']+$", ""), "  +", " ")
    t = F.when(F.length(t) > 160, F.concat(F.regexp_replace(F.substring(t, 1, 157), "[ ,;]+$", ""), F.lit("…"))).otherwise(t)
    asked = F.when(F.endswith(t, F.lit("?")), t).otherwise(F.concat(F.regexp_replace(t, "[.!]+$", ""), F.lit("?")))
    plain = F.regexp_replace(F.regexp_replace(t, "[?]+$", ""), " +$", "")
    out = F.when(t == "", None).when(kind.isin(*REAL_TYPES), asked).when(kind.isin(*LOW_TYPES), plain).otherwise(t)
    return F.nullif(out, F.lit(""))


def refined(c: Column, most: int) -> Column:
    """Number, topic, score, short, depth_score, question_type of refined questions."""

    def one(e: Column) -> Column:
        field = lambda name: F.when(_is_object(e), F.get_json_object(e["value"], f"$.{name}"))
        topic = F.trim(F.coalesce(field("topic"), F.lit("Other")))
        kind = F.trim(F.coalesce(F.nullif(field("question_type"), F.lit("")), F.lit("clarification_needed")))
        kind = F.when(kind.isin(*REAL_TYPES, *LOW_TYPES), kind).otherwise("clarification_needed")
        depth = _whole(field("depth_score"), 0, 10, 0)
        score = strict_score(_whole(field("score"), 1, 10, 5), depth, kind)
        return F.struct(
            e["number"].alias("number"), F.when(topic.isin(*TOPICS), topic).otherwise("Other").alias("topic"), score.cast("int").alias("score"), short_form(field("short"), kind).alias("short"),
            F.when(kind.isin(*LOW_TYPES), F.least(depth, F.lit(3))).otherwise(depth).cast("int").alias("depth_score"), kind.alias("question_type"), _is_object(e).alias("ok"),
        )

    return _each(c, most, one, lambda r: r["ok"])


def targets(c: Column, most: int) -> Column:
    """Number, target, confidence of insults."""

    def one(e: Column) -> Column:
        field = lambda name: F.when(_is_object(e), F.get_json_object(e["value"], f"$.{name}"))
        target = field("target")
        return F.struct(e["number"].alias("number"), F.when(target.isin(*TARGETS), target).otherwise("undefined").alias("target"), _share(field("confidence")).alias("confidence"), _is_object(e).alias("ok"))

    return _each(c, most, one, lambda r: r["ok"])


def precisions(c: Column, most: int) -> Column:
    """Number and confidence; what is no number is not confident."""
    return _each(c, most, lambda e: F.struct(e["number"].alias("number"), _share(e["value"]).alias("confidence")))


def verdicts(c: Column, most: int) -> Column:
    """Number, allow_auto_ban, confidence, target_confirmed of the last check before a ban."""

    def one(e: Column) -> Column:
        field = lambda name: F.when(_is_object(e), F.get_json_object(e["value"], f"$.{name}"))
        allow = F.coalesce(field("allow_auto_ban"), F.lit("false"))
        target = F.lower(F.trim(F.coalesce(field("target_confirmed"), F.lit("undefined"))))
        return F.struct(
            e["number"].alias("number"), (~allow.isin("false", "0", "", "null", "[]", "{}")).alias("allow_auto_ban"), _share(field("confidence")).alias("confidence"),
            F.when(target.isin(*TARGETS), target).otherwise("undefined").alias("target_confirmed"), _is_object(e).alias("ok"),
        )

    return _each(c, most, one, lambda r: r["ok"])


def kept(c: Column, most: int) -> Column:
    """Number and keep for all numbers of the batch; what is missing or unclear is kept."""

    def one(e: Column) -> Column:
        low = F.lower(F.trim(e["value"]))
        number = low.try_cast("int")
        unclear = low.isNull() | F.startswith(low, F.lit("{")) | F.startswith(low, F.lit("["))
        return F.struct(e["number"].alias("number"), F.when(unclear, True).when(number.isNotNull(), number != 0).otherwise(low.isin(*YES)).alias("keep"))

    every = F.map_from_arrays(F.sequence(F.lit(1), F.lit(most)), F.array_repeat(F.lit(True), most))
    merged = F.map_zip_with(every, F.map_from_entries(_each(c, most, one)), lambda _, default, told: F.coalesce(told, default))
    return F.transform(F.map_entries(merged), lambda e: F.struct(e["key"].alias("number"), e["value"].alias("keep")))


def indices(c: Column) -> Column:
    """The numbers of a list, or of the first list under the usual names; what is no number is left out."""
    names = ("indices", "numbers", "result", "comments")
    body = lenient_object(c)
    found = [F.get_json_object(body, f"$.{n}") for n in names]
    plain = F.regexp_extract(c, r"^\s*(?:```(?:json)?\s*)?(\[[^\[\]{}]*\])", 1)
    raw = F.coalesce(F.nullif(plain, F.lit("")), *[F.when(F.startswith(f, F.lit("[")), f) for f in found], F.lit("[]"))
    parts = F.regexp_extract_all(raw, F.lit(r"(?:^\[|,)\s*(-?\d+)(?:\.\d+)?\s*(?=,|\])"), F.lit(1))
    return F.transform(parts, lambda x: x.cast("int"))
