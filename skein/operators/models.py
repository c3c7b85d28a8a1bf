"""Steps that ask a model about topics and positions, and check what it says against the rules."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions import parsing as P
from skein.functions import text as T
from skein.operators import clusters as C
from skein.operators import providers as M
from skein.operators import topic_runs as R
from skein.operators import topics as K
from skein.operators.fit import sub_clusters, unit_rows
from skein.operators.positions import UNDETERMINED
from skein.settings import DEFAULT, Settings

SENTIMENTS = ("positive", "neutral", "negative", "mixed")
INTENTS = (*[name for name, _ in K.INTENTS], "other")
#: Comments of a topic that a model is shown, and the fewest of which it is asked.
SHOWN, LEAST = 60, 4


def normalized_label(told: DataFrame) -> DataFrame:
    """``told`` with the fields of the JSON object ``body`` where they are sound, else those of the rule.

    The rule's fields are title, sentiment, intents, description, actions. Emotions are two at most, without repeats.
    """
    field = lambda name: F.get_json_object("body", f"$.{name}")
    empty = F.array().cast("array<string>")
    counts = F.from_json(field("intent_distribution"), "map<string,double>")
    own = F.map_filter(F.transform_values(F.coalesce(counts, F.create_map().cast("map<string,double>")), lambda _, v: F.greatest(F.lit(0), v.cast("int"))), lambda k, _: k.isin(*INTENTS))
    total = F.aggregate(F.map_values(own), F.lit(0), lambda acc, v: acc + v)
    emotions = R.distinct_folded(F.coalesce(F.from_json(field("emotion_tags"), "array<string>"), empty))
    mood = F.lower(F.trim(field("sentiment")))
    return told.select(
        *[c for c in told.columns if c not in ("label", "sentiment", "emotions", "intents", "description", "actions", "title")],
        R.sanitized_label(field("label"), F.col("title"), F.lit(None).cast("string")).alias("label"), F.when(mood.isin(*SENTIMENTS), mood).otherwise(F.col("sentiment")).alias("sentiment"), F.slice(emotions, 1, 2).alias("emotions"),
        F.when(total > 0, own).otherwise(F.col("intents")).alias("intents"), R.extended_description(R.normalized_description(field("description")), F.col("description")).alias("description"),
        R.sanitized_actions(F.coalesce(F.from_json(field("author_actions"), "array<string>"), empty), F.col("actions")).alias("actions"),
    )


def retitled(df: DataFrame, asked: DataFrame, id_col: str, prompt: str, factory: Callable[[], M.Answerer]) -> DataFrame:
    """``df`` with ``title`` renamed where a model gives a valid single claim for the rows of ``asked``; renamed says where.

    A row whose first answer is not valid is asked once more, with a word in front of the prompt that says so.
    """

    def ask(rows: DataFrame) -> DataFrame:
        a = M.answered(rows, id_col, prompt, factory, batch=10)
        t = T.squeezed(F.get_json_object(P.lenient_object("answer"), "$.title"))
        return a.select(id_col, F.when(K.valid_title(t) & K.single_claim(t), t).alias("told"))

    first = ask(asked.select(id_col, prompt))
    failed = asked.select(id_col, prompt).join(first.filter(F.col("told").isNull()).select(id_col), id_col)
    second = ask(failed.withColumn(prompt, F.concat(F.lit("Повтор: "), prompt)))
    told = first.filter(F.col("told").isNotNull()).unionByName(second.filter(F.col("told").isNotNull()))
    j = df.join(told, id_col, "left")
    return j.withColumns({"title": F.coalesce("told", "title"), "renamed": F.col("told").isNotNull()}).drop("told")


def model_positions(comments: DataFrame, keys: Sequence[str], factory: Callable[[], M.Answerer], s: Settings = DEFAULT, shown: int = SHOWN) -> DataFrame:
    """Columns ``keys``, id, position of comments (``keys``, id, text, weight, v).

    A model is shown the ``shown`` heaviest comments of a topic by number and answers with lists of members.
    A comment belongs to the first list that names it, numbers that were not shown are left out. Where
    the topic is too small, or fewer than two lists come back, the groups of the vectors stand instead.
    Comments that were not shown join the nearest position, if it is near enough, else they are undetermined.
    """
    kind = dict(comments.dtypes)
    top = C.top_k(comments, keys, [F.desc("weight"), F.col("id")], shown)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = factory()
        for part in parts:
            for r in part.itertuples():
                ids = [x["id"] for x in r.rows]
                at: dict[int, int] = {}
                if len(ids) >= LEAST:
                    try:
                        answer = ask(["\n".join(f"{i}. {x['text']}" for i, x in enumerate(r.rows, 1))])[0]
                        found = json.loads(P.balanced_object(answer) or "{}")
                        lists = [p.get("members") for p in found.get("positions", []) if isinstance(p, dict)]
                    except Exception:  # noqa: BLE001 - a failed call leaves the topic to the vectors
                        lists = []
                    for g, listed in enumerate(lists):
                        for n in listed if isinstance(listed, list) else []:
                            if isinstance(n, int) and 1 <= n <= len(ids):
                                at.setdefault(n - 1, g)
                if len(set(at.values())) >= 2:
                    groups = {g: i + 1 for i, g in enumerate(dict.fromkeys(at[k] for k in sorted(at)))}
                    names = [f"position_{groups[at[i]]}" if i in at else UNDETERMINED for i in range(len(ids))]
                else:
                    labels = sub_clusters(unit_rows(np.stack([np.asarray(x["v"]) for x in r.rows])))
                    names = [f"position_{k + 1}" if k >= 0 else UNDETERMINED for k in labels.tolist()]
                yield pd.DataFrame({**{k: [getattr(r, k)] * len(ids) for k in keys}, "id": ids, "position": names})

    rows = top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "id", "text", "v"))).alias("rows"))  # at most ``shown``
    named = rows.mapInPandas(run, ", ".join(f"{k} {kind[k]}" for k in keys) + f", id {kind['id']}, position string")
    rest = comments.join(top.select("id"), "id", "left_anti").select(*keys, "id", "v")
    known = named.filter(F.col("position") != UNDETERMINED).select("id", "position").join(comments.select(*keys, "id", "v"), "id")
    centers = C.centroids(known, [*keys, "position"]).withColumn("at", F.regexp_extract("position", r"(\d+)$", 1).cast("int"))
    near = C.nearest_two(rest, centers, "at", run=list(keys))
    joined = F.when(F.col("primary_cos") >= s.position_cosine, F.concat(F.lit("position_"), F.col("primary").cast("string"))).otherwise(UNDETERMINED)
    return named.unionByName(near.select(*keys, "id", joined.alias("position")))


#: Why a row was not reviewed, by the words of the error that ended a run's calls.
ENDINGS = (("reserved for topic labeling", "llm_reserved_for_labeling"), ("task quota reached", "llm_task_quota_fallback"), ("per-run call limit reached", "llm_max_calls_fallback"), ("budget", "llm_budget_fallback"))


def moderation_decision(answer: Column, fallback_action: str = "flag", fallback_reason: str = "llm_invalid_fallback") -> Column:
    """Struct of action, reason, score of an answer; unknown actions and blank reasons take the fallbacks, the score stays within 0 and 1."""
    body = P.lenient_object(answer)
    action, reason = (F.lower(F.trim(F.coalesce(F.get_json_object(body, f"$.{n}"), F.lit("")))) for n in ("action", "reason_code"))
    score = F.coalesce(F.get_json_object(body, "$.score").try_cast("double"), F.lit(0.5))
    return F.struct(
        F.when(action.isin("keep", "flag", "drop"), action).otherwise(fallback_action).alias("action"), F.when(reason == "", fallback_reason).otherwise(reason).alias("reason"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"),
    )


def reviewed(candidates: DataFrame, run: str, id_col: str, prompt: str, factory: Callable[[], M.Answerer], most: int) -> DataFrame:
    """Columns ``run``, ``id_col``, action, reason, source: borderline rows of each run after a model's review.

    The first ``most`` rows of a run by id are asked, one call each; those beyond are flagged. A failed call flags
    its row. An error that ends the run's calls, such as a spent budget, flags its row and all later ones
    of the run with the error's reason, whatever tasks have asked in the meantime.
    """
    placed = candidates.withColumn("_place", F.row_number().over(W.partitionBy(run).orderBy(id_col)))
    asked = placed.filter(F.col("_place") <= most)
    a = asked.join(M.answered(asked.select(id_col, prompt), id_col, prompt, factory, batch=1), id_col)
    ending = F.lit(None).cast("string")
    for words, name in reversed(ENDINGS):
        ending = F.when(F.contains(F.lower("error"), F.lit(words)), name).otherwise(ending)
    a = a.withColumn("_ending", ending)
    first = F.min(F.when(F.col("_ending").isNotNull(), F.struct(F.col("_place").alias("at"), F.col("_ending").alias("reason")))).alias("_end")
    a = a.join(a.groupBy(run).agg(first), run, "left")
    d = moderation_decision(F.col("answer"))
    ended = F.coalesce(F.col("_place") >= F.col("_end.at"), F.lit(False))
    told = a.select(
        run, id_col, F.when(ended | F.col("error").isNotNull(), "flag").otherwise(d["action"]).alias("action"),
        F.when(ended, F.col("_end.reason")).when(F.col("error").isNotNull(), "llm_error_fallback").otherwise(d["reason"]).alias("reason"), F.when(ended | F.col("error").isNotNull(), "fallback").otherwise("llm").alias("source"),
    )
    over = placed.filter(F.col("_place") > most)
    return told.unionByName(over.select(run, id_col, F.lit("flag").alias("action"), F.lit("llm_review_cap_fallback").alias("reason"), F.lit("fallback").alias("source")))
