"""Language identification by rank-order profiles of n-grams.

A profile is a list of the most frequent character n-grams (1 to 3 letters,
a blank for each end of a word) in order of frequency.  A document is given
the language whose profile is nearest by out-of-place distance: the sum, over
the document's n-grams, of the difference of ranks, or the most that is
possible for an n-gram that the profile lacks.

Profiles are learnt from at most about `sample` labelled documents, chosen by
a hash of their ids; counts are added up in the executors' batches and then
by Spark, and only the first `size` of each language reach the driver.  All
languages of the labels are learnt, each from an equal part of the sample.

Defined cases: a null text, or one without letters, is `und` with score 0;
without any labelled document everything is `und`; ties in frequency go by
n-gram and ties in distance by language name; repeated rows get the same
answer; whole texts count, however long.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
#: Bits for a letter in the number of an n-gram.
BITS = 21


def grams(text: str, longest: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and counts of the n-grams of a text's words, from the words' counts."""
    words = LETTERS.findall(text.lower())
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # one blank before, between and behind the words
    codes = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    blank = codes == 32
    found = [codes[~blank]]
    if longest > 1:
        two = (codes[:-1] << BITS) | codes[1:]
        found.append(two)
    if longest > 2:
        # a blank in the middle would join two words
        three = (codes[:-2] << 2 * BITS) | (codes[1:-1] << BITS) | codes[2:]
        found.append(three[~blank[1:-1]])
    # numbers are apart by length, for no letter is 0
    return np.unique(np.concatenate(found), return_counts=True)


def ranked(numbers: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The `size` most frequent n-grams, most frequent first, ties by number."""
    if len(numbers) > 4 * size:  # the rest need not be sorted
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        numbers, counts = numbers[counts >= least], counts[counts >= least]
    return numbers[np.lexsort((numbers, -counts))][:size]


def learn(labelled: DataFrame, size: int = 300, sample: int = 8000) -> dict[str, np.ndarray]:
    """Profiles by language, from labelled documents (doc_id, text, lang)."""
    spark = labelled.sparkSession
    common.small_batches(spark)
    labelled = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    by_lang = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not by_lang:
        return {}
    # each language gets an equal part of the sample, or all that it has
    part = max(1, sample // len(by_lang))
    share = F.create_map(*[x for k, n in by_lang.items() for x in (F.lit(k), F.lit(common.threshold(min(1.0, part / n))))])
    chosen = labelled.filter(F.xxhash64(F.lit(3), "doc_id") <= share[F.col("lang")]).select("text", "lang")

    def count(frames):
        held: dict[str, dict[int, int]] = {}
        n = 0
        for pdf in common.text_batches(frames):
            for lang, own in pdf.groupby("lang"):
                numbers, counts = grams("\n".join(own["text"]))
                known = held.setdefault(lang, {})
                n -= len(known)
                for k, c in zip(numbers.tolist(), counts.tolist(), strict=True):
                    known[k] = known.get(k, 0) + c
                n += len(known)
            if n > 500_000:
                yield from flushed(held)
                held, n = {}, 0
        yield from flushed(held)

    def flushed(held):
        for lang, known in held.items():
            yield pd.DataFrame({"lang": pd.Series([lang] * len(known), dtype=object), "gram": np.fromiter(known.keys(), np.int64, len(known)), "n": np.fromiter(known.values(), np.int64, len(known))})

    sums = chosen.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    from pyspark.sql import Window

    first = sums.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("r") <= size)
    profiles: dict[str, list] = {}
    for r in first.collect():
        profiles.setdefault(r["lang"], []).append((r["r"], r["gram"]))
    return {lang: np.array([g for _, g in sorted(own)], np.int64) for lang, own in sorted(profiles.items())}


def nearest(rank: np.ndarray, profiles: list[tuple[str, np.ndarray, np.ndarray]], size: int) -> tuple[str, float]:
    """Language and score of a document's ranked n-grams.

    Profiles come as (language, sorted n-grams, their ranks).  The score is
    the share of the possible distance that the document stays below.
    """
    if not len(rank) or not profiles:
        return UNKNOWN, 0.0
    place = np.arange(len(rank))
    best, name = None, UNKNOWN
    for lang, known, ranks in profiles:
        at = np.minimum(np.searchsorted(known, rank), len(known) - 1)
        there = known[at] == rank
        distance = int(np.where(there, np.abs(ranks[at] - place), size).sum())
        if best is None or distance < best:
            best, name = distance, lang
    return name, 1.0 - best / (size * len(rank))


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], size: int = 300, keep: tuple[str, ...] = (), added: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """doc_id, lang_pred, score and the columns of `keep`."""
    sorted_profiles = []
    for lang, own in profiles.items():
        order = np.argsort(own)
        sorted_profiles.append((lang, own[order], order.astype(np.int64)))

    def guess(texts):
        got = [nearest(ranked(*grams(t), size), sorted_profiles, size) for t in texts]
        return [g[0] for g in got], [g[1] for g in got]

    return common.map_text(docs, ["doc_id", *[c for c in keep if c != "doc_id"]], guess, f"`{added[0]}` string, `{added[1]}` double")


def identify(docs: DataFrame, size: int = 300, sample: int = 8000) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from the documents outside the held-out fold."""
    rows = docs.select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(F.expr(common.crc_is_held_out("doc_id")), F.lit(False)))
    profiles = learn(rows.filter(~F.col("held_out")), size, sample)
    return predict(rows, profiles, size, keep=("held_out",)).select("doc_id", "held_out", "lang_pred", "score")


def accepted(docs: DataFrame, least: float = 0.2) -> DataFrame:
    """The documents whose language is known: not `und`, and of some likeness to a learnt one."""
    names = docs.columns
    profiles = learn(docs.select("doc_id", "text", "lang").filter(~F.coalesce(F.expr(common.crc_is_held_out("doc_id")), F.lit(False))))
    # the prediction's columns get names that the table lacks
    lang, score = common.free_names(docs, "lang_pred", "score")
    scored = predict(docs, profiles, keep=tuple(names), added=(lang, score))
    return scored.filter((F.col(f"`{lang}`") != UNKNOWN) & (F.col(f"`{score}`") >= least)).select(*names)
