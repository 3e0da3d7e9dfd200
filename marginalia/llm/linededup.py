"""Line dedup by deletion neighbourhoods.

A line is its words; two lines are near if at most one word has to be put in,
taken out or replaced.  A line goes if an earlier line, by document id and
line number, is equal or near to it.

The deletion neighbourhood of a line is the line and all lines with one word
less.  Two keys make equality of neighbours exact, so that the earliest line
under a key is found by a minimum and no pairs are ever listed:

* a variant with the place of the missing word: lines that share it differ in
  that word only;
* a variant without the place, matched with whole lines: they differ by that
  word put in.

Only lines that can have a near one emit variants.  If one word differs, the
lines share their first or their last half (of the shorter one's words), so
lines without such a half in common with another line are left out first,
and a line that shares one half only varies the words outside of it; this
loses nothing.  Witnesses are verified word by word before a line goes.

Defined cases: blank lines and null texts never go; lines of fewer than
`min_words` words only go as exact copies (of two words, one is half of the
line; at one word any two lines would be near); words are split at white space and compared as they are; rows of
the same doc_id share their line numbers, and lines at equal places never
remove each other; rows without doc_id come before all others.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Inverse of the base of the polynomial hash, modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
NO_ID = -(1 << 63)
#: Words of a line that may go as a near copy.
MIN_WORDS = 3


def powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, BASE, np.uint64))])


HASHES: list = []


def words_hashes(words: list[str]) -> np.ndarray:
    if not HASHES:
        HASHES.append(common.WordHashes())
    return HASHES[0].of(words)


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64)


def line_hash(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Running polynomial hashes: entry k is that of the first k words."""
    with np.errstate(over="ignore"):
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * p[: len(h)], dtype=np.uint64)])


def name_of(value: np.ndarray, n) -> np.ndarray:
    """A line's or variant's key from its polynomial hash and number of words."""
    with np.errstate(over="ignore"):
        return common.mix64(np.atleast_1d(value) + np.asarray(n, np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def variants(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the line without its word k, for all k."""
    run = line_hash(h, p)
    with np.errstate(over="ignore"):
        return run[:-1] + (run[-1] - run[1:]) * np.uint64(INVERSE)


def half_keys(run: np.ndarray, start: np.ndarray, n: np.ndarray, m: np.ndarray, p_inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the first and of the last m words of lines that start at `start` in the running hashes."""
    with np.errstate(over="ignore"):
        first = run[start + m] - run[start]
        last = (run[start + n] - run[start + n - m]) * p_inverse[n - m]
        by_m = m.astype(np.uint64) * np.uint64(8)
        return tuple(signed(common.mix64(v + np.uint64(side * 0x51ED270B) + by_m)) for side, v in ((1, first), (2, last)))


def describe(texts: list[str], min_words: int) -> tuple[list, ...]:
    """For each text: line numbers, keys, numbers of words and half keys of its lines.

    The words of all lines lie in one array, whose running polynomial hash
    gives that of any stretch of a line.  The halves are those that a partner
    of the same length or one word more or less may share.
    """
    words: list[str] = []
    numbers, counts, of_text = [], [], []
    for text in texts:
        before = len(numbers)
        for k, line in enumerate(text.split("\n")):
            if own := line.split():
                numbers.append(k)
                counts.append(len(own))
                words += own
        of_text.append(len(numbers) - before)
    n = np.array(counts, np.int64)
    start = np.cumsum(n) - n
    longest = int(n.max(initial=0)) + 1
    p = powers(longest)
    with np.errstate(over="ignore"):
        p_inverse = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(longest, INVERSE, np.uint64))])
    place = np.arange(len(words)) - np.repeat(start, n)
    run = line_hash(words_hashes(words), p[place])
    with np.errstate(over="ignore"):
        keys = signed(name_of(run[start + n] - run[start], n)).tolist()
    one, two = n // 2, (n - 1) // 2
    a, b = half_keys(run, start, n, one, p_inverse)
    c, d = half_keys(run, start, n, two, p_inverse)
    half = [[] if size < min_words else [w, x] if same else [w, x, y, z] for size, same, w, x, y, z in zip(counts, (one == two).tolist(), a.tolist(), b.tolist(), c.tolist(), d.tolist(), strict=True)]
    out: tuple[list, ...] = ([], [], [], [])
    at = 0
    for size in of_text:
        for own, every in zip(out, (numbers, keys, counts, half), strict=True):
            own.append(every[at : at + size])
        at += size
    return out


def at(doc: str = "doc", line: str = "line") -> Column:
    return F.struct(F.col(doc).alias("doc"), F.col(line).alias("line"))


def near(a: list[str], b: list[str]) -> bool:
    """Whether one word put in, taken out or replaced makes one of the other."""
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def lines(docs: DataFrame, min_words: int) -> DataFrame:
    """doc, line, key, n, halves: one row per non-blank line."""
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), "text")

    def take(texts):
        from marginalia.llm.linededup import describe

        return describe(texts, min_words)

    found = common.map_text(ids, ["doc"], take, "line array<int>, key array<long>, n array<int>, halves array<array<long>>")
    return found.select("doc", F.explode(F.arrays_zip("line", "key", "n", "halves")).alias("l")).select("doc", "l.*")


def near_earlier(docs: DataFrame, every: DataFrame, min_words: int) -> DataFrame:
    """key, by: lines that have a near line before their first occurrence, and the first place of that one."""
    firsts = every.groupBy("key").agg(F.min(at()).alias("at"), F.first("n").alias("n"), F.first("halves").alias("halves")).filter(F.col("n") >= min_words)
    firsts = common.materialize(firsts.select("key", "at", "halves"), "lines")
    # first halves stand at even places, last halves at odd ones
    half = firsts.select("key", F.posexplode("halves").alias("k", "half"))
    shared = half.groupBy("half").agg(F.count("*").alias("n")).filter("n > 1").select("half")
    sides = half.join(shared.hint("merge"), "half").groupBy("key").agg(F.max(F.col("k") % 2 == 0).alias("first"), F.max(F.col("k") % 2 == 1).alias("last"))
    wanted = sides.join(firsts.select("key", "at").hint("merge"), "key")
    wanted = common.materialize(wanted.groupBy(F.col("at.doc").alias("doc")).agg(F.collect_list(F.struct("at.line", "key", "first", "last")).alias("lines")), "wanted")
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), "text")

    # the words of these lines, from their first documents; by a shuffle at every size
    texts = ids.join(wanted.hint("merge"), "doc").select("doc", "text", F.to_json("lines").alias("pick"))

    def emit(texts, picks):
        import json

        from marginalia.llm.linededup import name_of, powers, variants, words_hashes

        p, keys, os, ks, ws = powers(0), [], [], [], []
        for text, pick in zip(texts, picks, strict=True):
            rows = text.split("\n")
            own_keys, own_os, own_ks, own_ws = [], [], [], []
            for one in json.loads(pick):
                if one["line"] >= len(rows):
                    continue
                words = rows[one["line"]].split()
                if len(words) < 2:
                    continue
                if len(words) >= len(p):
                    p = powers(2 * len(words))
                h = words_hashes(words)
                if int(name_of((h * p[: len(h)]).sum(dtype=np.uint64), len(h))[0].astype(np.int64)) != one["key"]:
                    continue  # another row of the same doc_id
                # behind a shared first half, or before a shared last one, the lines differ
                n, m = len(h), (len(h) - 1) // 2
                begin, end = 0 if one["last"] else m, n if one["first"] else n - m
                own_keys.append(one["key"])
                own_os.append(begin)
                own_ks.append(signed(name_of(variants(h, p)[begin:end], n - 1)).tolist())
                own_ws.append(" ".join(words))
            for every, own in ((keys, own_keys), (os, own_os), (ks, own_ks), (ws, own_ws)):
                every.append(own)
        return keys, os, ks, ws

    out = common.map_text(texts, ["doc"], emit, "key array<long>, begin array<int>, variants array<array<long>>, words array<string>", also="pick")
    out = out.select(F.explode(F.arrays_zip("key", "begin", "variants", "words")).alias("l")).select("l.*").dropDuplicates(["key"])
    out = common.materialize(out.join(firsts.select("key", "at"), "key"), "variants")

    own = out.select("key", "at", "begin", F.posexplode("variants").alias("k", "v")).select("key", "at", (F.col("begin") + F.col("k")).alias("place"), "v")
    me = F.struct("at", "key")
    # the same word missing at the same place: a replaced word
    replaced = own.groupBy("v", "place").agg(F.min(me).alias("w"), F.count("*").alias("c")).filter("c > 1")
    one = own.join(replaced.select("v", "place", "w").hint("merge"), ["v", "place"]).filter(F.col("w.key") != F.col("key")).groupBy("key").agg(F.min("w").alias("w"))
    # a variant that is a whole line: a word put in; the earlier of the two stays
    whole = out.select(F.col("key").alias("v"), F.struct(F.col("at"), F.col("key")).alias("w"))
    short = own.select("v", me.alias("long")).join(whole.hint("merge"), "v")
    two = short.filter(F.col("w.at") < F.col("long.at")).groupBy(F.col("long.key").alias("key")).agg(F.min("w").alias("w"))
    three = short.filter(F.col("long.at") < F.col("w.at")).groupBy(F.col("v").alias("key")).agg(F.min("long").alias("w"))
    best = one.unionByName(two).unionByName(three).groupBy("key").agg(F.min("w").alias("w"))
    best = best.join(out.select("key", "at", "words"), "key").filter(F.col("w.at") < F.col("at"))
    best = best.join(out.select(F.col("key").alias("wk"), F.col("words").alias("other")), F.col("w.key") == F.col("wk"))

    def check(texts, others):
        from marginalia.llm.linededup import near

        return ([near(a.split(" "), b.split(" ")) for a, b in zip(texts, others, strict=True)],)

    pairs = best.select("key", F.col("w.at").alias("by"), "words", "other")
    return common.map_text(pairs, ["key", "by"], check, "near boolean", text="words", also="other").filter("near").select("key", "by")


def removals(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc, line, near (else an exact copy) of every line that goes."""
    every = common.materialize(lines(docs, min_words), "every")
    firsts = every.groupBy("key").agg(F.min(at()).alias("first"))
    by = common.materialize(near_earlier(docs, every, min_words), "near")
    marks = firsts.join(by.hint("merge"), "key", "left")
    joined = every.select("doc", "line", "key").join(marks.hint("merge"), "key")
    here = at()
    exact = here > F.col("first")
    nearly = F.col("by").isNotNull() & (here > F.col("by"))
    return joined.filter(exact | nearly).select("doc", "line", (~exact).alias("near")).distinct()


def report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_exact, n_near, removed (line numbers) of every document."""
    gone = removals(docs, min_words).groupBy("doc").agg(F.count_if(~F.col("near")).alias("n_exact"), F.count_if("near").alias("n_near"), F.array_sort(F.collect_list("line")).alias("removed"))
    text = F.coalesce("text", F.lit(""))
    every = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.when(text == "", 0).otherwise(F.size(F.split(text, "\n"))).alias("n_lines"))
    none = F.array().cast("array<int>")
    return every.join(gone, "doc", "left").select("doc_id", "n_lines", F.coalesce("n_exact", F.lit(0)).alias("n_exact"), F.coalesce("n_near", F.lit(0)).alias("n_near"), F.coalesce("removed", none).alias("removed"))


def without_duplicates(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without the lines that go."""
    doc, lines_gone = common.free_names(docs, "doc", "gone")
    gone = removals(docs.select("doc_id", "text"), min_words).groupBy(F.col("doc").alias(doc)).agg(F.collect_set("line").alias(lines_gone))
    rows = docs.withColumn(doc, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).join(gone, doc, "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda line, k: ~F.array_contains(lines_gone, k)), "\n")
    return rows.withColumn("text", F.when(F.col(lines_gone).isNull(), F.col("text")).otherwise(kept)).select(*docs.columns)
