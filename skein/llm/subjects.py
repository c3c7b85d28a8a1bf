"""Problem 10: subject areas (labels propagated over the documents' verified common phrases)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.abuse import sentences
from skein.llm.fold import slices
from skein.llm.store import CHUNK, dropped, joined, swept, written

#: Rounds after which sentences that still change are an error.
ROUNDS = 60
#: For a phrase to carry a subject, the subject's smoothed share of the weight of the phrase's
#: documents must go this part of the way from an even share to all, in so many documents.
SHARE, PRIOR, SUPPORT = 0.49, 4.0, 3.0
#: Within a sentence a subject may be this much below the best one.
BELOW = 0.25
#: A sentence known from this many documents is judged as a whole: if the subject's share goes
#: less than this part of the way, it is a figure of speech, whatever its words are.
WHOLE, WHOLE_SHARE = 8.0, 0.31
#: Documents that the definition of a subject counts as.
KNOWN = 6.0
#: Weights are rounded, as the last bits of a sum depend on the order in which tasks end.
DIGITS = 9
#: Sentences that a task remembers to have given the terms of.
KEPT = 200_000
TERMS = "doc bigint, sentence bigint, times int, terms array<bigint>"


def _signed(b: bytes) -> int:
    return xxhash.xxh64_intdigest(b) - (1 << 63)


def sentence_terms(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns doc, sentence (hash of its words), times, terms (hashes of its words and word pairs).

    Words are whole words. Case, accents, look-alike letters and marks do not matter; words with
    digits are left out, so that sentences which differ in a number are one. Terms are given where
    a task first meets a sentence, null after that. Null ids, null texts and wordless texts have no row.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, int] = {}
        known: dict[str, int] = {}
        for part in (batch.iloc[i:j] for batch in parts for i, j in slices(batch["t"].tolist())):
            if len(seen) > KEPT:
                seen.clear()
                known.clear()
            ids = part["k"].to_numpy()
            chars, bounds, doc, *_ = sentences(part["t"].tolist())
            whole = chars.astype("<u4").tobytes().decode("utf-32-le")
            at: dict[tuple[int, int], int] = {}
            docs, sids, times, terms = [], [], [], []
            for d, a, b in zip(doc.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                raw = whole[a:b]
                sid = known.get(raw, 0)
                given = None
                if not sid:
                    words = [w for w in raw.split() if "0" not in w]
                    if not words:
                        continue
                    key = " ".join(words)
                    sid = seen.get(key, 0)
                    if not sid:
                        sid = seen[key] = _signed(key.encode())
                        of = dict.fromkeys([*words, *map(" ".join, zip(words, words[1:], strict=False))])
                        given = [_signed(w.encode()) for w in of]
                    known[raw] = sid
                if (row := at.get((d, sid))) is not None:
                    times[row] += 1
                    continue
                at[d, sid] = len(docs)
                docs.append(ids[d])
                sids.append(sid)
                times.append(1)
                terms.append(given)
            yield pd.DataFrame({"doc": np.array(docs, np.int64), "sentence": np.array(sids, np.int64), "times": np.array(times, np.int32), "terms": pd.Series(terms, dtype=object)})

    part = df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).filter(F.col("k").isNotNull() & F.col("t").isNotNull())
    return part.mapInPandas(run, TERMS)


def _print_of(told: DataFrame) -> tuple[int, int, int]:
    """Number of rows and two sums of hashes: equal sets of sentences with their subjects have equal prints."""
    half = [F.sum(F.xxhash64(F.lit(h), "sentence", "subjects").bitwiseAND(0x7FFFFFFF)).alias(f"h{h}") for h in (1, 2)]
    r = told.agg(F.count(F.lit(1)).alias("n"), *half).first()
    return r["n"], r["h1"] or 0, r["h2"] or 0


class Graph:
    """Documents joined by their common sentences and phrases, as written tables.

    Two documents are linked by each sentence and each phrase that both hold. Pairs would grow with
    the square of a phrase's documents, so a link is kept as two rows that meet in the phrase, the
    class that stands for all its pairs, and is followed by two joins. Phrases that occur in fewer
    than SUPPORT documents can never be verified and are left out.
    """

    def __init__(self, documents: DataFrame, id_col: str, text_col: str) -> None:
        self.spark = documents.sparkSession
        rows, _ = written(sentence_terms(documents, id_col, text_col), "sentences")
        #: Which document holds which sentence, and how often.
        self.has = rows.select("doc", "sentence", "times")
        self.n_has = self.has.count()
        #: Documents of each sentence.
        self.sizes, _ = written(self.has.groupBy("sentence").agg(F.count(F.lit(1)).alias("c")), "sizes")
        terms, terms_path = written(rows.filter(F.col("terms").isNotNull()).select("sentence", F.explode("terms").alias("term")).distinct(), "terms")
        same = [F.sum(F.xxhash64(F.lit(h), "sentence").bitwiseAND(0x7FFFFFFFFF)).alias(f"h{h}") for h in (1, 2)]
        held = terms.join(self.sizes, "sentence").groupBy("term").agg(F.count(F.lit(1)).alias("c"), F.sum("c").alias("n"), *same).filter(F.col("n") >= SUPPORT)
        #: Phrases with their number of sentences (c) and documents (n), and a print of the set of their sentences.
        self.all_held, held_path = written(held, "held")
        # phrases of the same sentences have the same links and weights, so one of them stands for all
        alike = self.all_held.groupBy("c", "n", "h1", "h2").agg(F.min("term").alias("term"))
        alike, alike_path = written(alike, "alike")
        #: Which sentence holds which phrase.
        self.terms, _ = written(joined(terms, alike.select("term", "c", "n"), ["term"], terms.count()), "terms")
        self.alike = alike
        self.n_terms = self.terms.count()
        # the usual surroundings of a phrase: what is most often the most frequent word of its sentences
        tops = self.terms.groupBy("sentence").agg(F.max(F.struct("n", "term")).getField("term").alias("around"))
        near = self.terms.join(tops, "sentence").groupBy("term", "around").agg(F.count(F.lit(1)).alias("m")).groupBy("term").agg(F.max(F.struct("m", "around")).getField("around").alias("around"))
        #: Number of sentences (c) and surroundings of each phrase.
        self.held, _ = written(alike.select("term", "c").join(near, "term"), "held")
        self.arounds, _ = written(self.held.groupBy("around").agg(F.count(F.lit(1)).alias("c")), "arounds")
        dropped(self.spark, terms_path)
        self.aside = (held_path, alike_path)
        swept(self.spark)

    def with_subjects(self, told: DataFrame) -> DataFrame:
        """Columns doc, sentence, times, subjects (null where the sentence has none)."""
        return joined(self.has, self.sizes.join(told, "sentence", "left"), ["sentence"], self.n_has)


def _evidence(graph: Graph, told: DataFrame, seeds: DataFrame) -> DataFrame:
    """Columns sentence, all (subject and y: the weight of the sentence's documents by subject), n (their sum).

    A document has one unit, divided among its seeds, which stay, or else among the subjects of
    its other sentences: a sentence is no evidence for itself.
    """
    mine = graph.with_subjects(told)
    counts = mine.select("doc", "times", F.explode("subjects").alias("subject")).groupBy("doc", "subject").agg(F.sum("times").cast("double").alias("m"))
    free = counts.groupBy("doc").agg(F.collect_list(F.struct("subject", "m")).alias("all"), F.sum("m").alias("total"))  # one entry a subject
    fixed = seeds.groupBy("doc").agg(F.collect_list(F.struct("subject", F.col("share").alias("m"))).alias("fixed"))
    docs = free.join(fixed, "doc", "full").select("doc", F.coalesce("fixed", "all").alias("all"), F.when(F.col("fixed").isNull(), F.col("total")).alias("total"))
    each = mine.join(docs, "doc").select("sentence", "times", "subjects", "total", F.explode("all").alias("a")).select("sentence", "times", "subjects", "total", "a.subject", "a.m")
    own = F.coalesce(F.array_contains("subjects", F.col("subject")), F.lit(False)).cast("int") * F.col("times")
    rest = F.col("total") - F.coalesce(F.size("subjects"), F.lit(0)) * F.col("times")
    y = F.when(F.col("total").isNull(), F.col("m")).when(rest > 0, (F.col("m") - own) / rest)
    whole = each.select("sentence", "subject", y.alias("y")).filter(F.col("y") > 0).groupBy("sentence", "subject").agg(F.round(F.sum("y"), DIGITS).alias("y"))
    return whole.groupBy("sentence").agg(F.collect_list(F.struct("subject", "y")).alias("all"), F.round(F.sum("y"), DIGITS).alias("n"))  # one entry a subject


def subject_lists(documents: DataFrame, labels: DataFrame, definitions: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Columns ``id_col``, subject: the subjects that at least one sentence of a document is about.

    ``labels`` (``id_col``, subject) are seeds for whole documents and stay fixed in every round;
    wrong ones are outvoted. ``definitions`` (subject, text) is the closed list of subjects; the
    words of a definition have KNOWN documents' worth of evidence, which the corpus can outvote.
    A document has one unit of weight, divided among its seeds, or else among the subjects of its
    sentences. A round follows the links of documents through their phrases. A phrase is verified,
    and its links are followed, if one subject holds most of the weight of its documents. A sentence
    gets the subjects of its verified phrases, unless the sentence as a whole occurs in documents of
    many subjects; a document those of its sentences. Several subjects are kept. Rounds go on until
    no sentence changes. Sentences that change in a circle keep the subjects they had in both of
    the last two rounds; no end after ``rounds`` is an error. Null and blank texts, and texts on none of the
    subjects, have no row. Rows with one id are one document; labels with a null or unknown subject
    are left out; a subject that is defined twice has both definitions.
    """
    spark = documents.sparkSession
    closed = sorted({r["subject"] for r in definitions.select("subject").filter(F.col("subject").isNotNull()).distinct().collect()})  # the closed list
    number = F.create_map(*[F.lit(x) for i, s in enumerate(closed) for x in (s, i)]) if closed else F.lit(None).cast("map<string,int>")
    even = 1 / max(1, len(closed))
    enough, figure = even + SHARE * (1 - even), even + WHOLE_SHARE * (1 - even)
    graph = Graph(documents, id_col, text_col)
    seeds = labels.select(F.col(id_col).cast("bigint").alias("doc"), number[F.col("subject")].alias("subject")).filter(F.col("doc").isNotNull() & F.col("subject").isNotNull()).distinct()
    several = seeds.groupBy("doc").agg((1 / F.count(F.lit(1))).alias("share"))
    seeds, seeds_path = written(seeds.join(several, "doc"), "seeds")
    given = sentence_terms(definitions.select(number[F.col("subject")].cast("bigint").alias("k"), F.col("text").alias("t")), "k", "t")
    given = given.select(F.explode("terms").alias("term"), F.col("doc").cast("int").alias("subject")).distinct()
    given = graph.all_held.join(given, "term").drop("term").join(graph.alike, ["c", "n", "h1", "h2"])  # a definition's words are few
    given, given_path = written(given.select("term", "subject", F.lit(KNOWN).alias("y")).distinct(), "definitions")
    dropped(spark, *graph.aside)
    told, told_path = written(spark.createDataFrame([], "sentence bigint, subjects array<int>"), "told")
    state, seen, circle = _print_of(told), set(), False
    for _ in range(rounds):
        whole, whole_path = written(_evidence(graph, told, seeds), "whole")
        swept(spark)
        y = graph.terms.join(whole.select("sentence", F.explode("all").alias("a")).select("sentence", "a.subject", "a.y"), "sentence").select("term", "subject", "y").unionByName(given).groupBy("term", "subject").agg(F.round(F.sum("y"), DIGITS).alias("y"))
        y = y.groupBy("term").agg(F.round(F.sum("y"), DIGITS).alias("n"), F.collect_list(F.struct("subject", "y")).alias("all")).filter(F.col("n") >= SUPPORT)  # one entry a subject
        p = (F.col("of.y") + PRIOR * even) / (F.col("n") + PRIOR)
        likely = y.select("term", "n", F.explode("all").alias("of")).filter(p >= enough).select("term", F.col("of.subject").alias("subject"), p.alias("p"))
        usual = graph.arounds.join(y.select(F.col("term").alias("around"), F.map_from_entries("all").alias("ys"), F.col("n").alias("usual")), "around", "left")
        likely = joined(graph.held.join(likely, "term"), usual, ["around"], graph.n_terms)
        base = (F.coalesce(F.try_element_at("ys", F.col("subject")), F.lit(0.0)) + PRIOR * even) / (F.coalesce("usual", F.lit(0.0)) + PRIOR)
        # what is itself the most frequent word around has no surroundings to compare with
        base = F.when(F.col("around") == F.col("term"), F.lit(even)).otherwise(base)
        verified, verified_path = likely.filter(F.col("p") >= base + SHARE * (1 - base)).select("term", "c", "subject", "p"), None
        if graph.n_terms > CHUNK:  # it is read twice then
            verified, verified_path = written(verified, "verified")
        best = joined(graph.terms.select("sentence", "term"), verified, ["term"], graph.n_terms).groupBy("sentence", "subject").agg(F.max("p").alias("p"))
        best = best.groupBy("sentence").agg(F.max("p").alias("top"), F.collect_list(F.struct("subject", "p")).alias("likely"))  # one entry a subject
        best = best.join(whole.filter(F.col("n") >= WHOLE).select("sentence", "n", F.map_from_entries("all").alias("ys")), "sentence", "left")
        figure_of = lambda x: F.coalesce(F.coalesce(F.try_element_at("ys", x["subject"]), F.lit(0.0)) < figure * F.col("n"), F.lit(False))
        kept = F.filter("likely", lambda x: (x["p"] >= F.col("top") - BELOW) & ~figure_of(x))
        new = best.select("sentence", F.array_sort(F.transform(kept, lambda x: x["subject"])).alias("subjects")).filter(F.size("subjects") > 0)
        new, new_path = written(new, "told")
        before, state = state, _print_of(new)
        if state in seen and state != before:
            both = new.join(told.withColumnRenamed("subjects", "b"), "sentence").select("sentence", F.array_intersect("subjects", "b").alias("subjects")).filter(F.size("subjects") > 0)
            both, both_path = written(both, "told")
            dropped(spark, new_path)
            new, new_path, circle = both, both_path, True
        dropped(spark, *filter(None, (told_path, whole_path, verified_path)))
        swept(spark)
        told, told_path = new, new_path
        if state == before or circle:
            break
        seen.add(state)
    else:
        raise RuntimeError(f"sentences still change after {rounds} rounds")
    out = graph.with_subjects(told).select("doc", F.explode("subjects").alias("s")).distinct()
    names = F.array(*[F.lit(s) for s in closed]) if closed else F.array(F.lit(None).cast("string"))
    dropped(spark, seeds_path, given_path)
    return out.select(F.col("doc").alias(id_col), F.element_at(names, F.col("s") + 1).alias("subject"))
