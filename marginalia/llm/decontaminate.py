"""Benchmark decontamination by template windows.

Texts become template tokens: words in lower case, numbers as <num>, units
behind a number as <unit>, names (capitalised words inside a sentence) as
<name>.  Each text gives two such sequences, one with names replaced and one
with them as plain words, so that text without capitals is found as well.
Windows of WINDOW tokens are hashed; a window of which less than LEAST_WORDS
is words, such as one of a sequence of numbers, is hashed by its plain values
instead, so that it is found verbatim.  Windows of the documents that a fixed-
size bit map of the benchmark's hashes lets through are joined with the
benchmark's windows on the hash.

Matches of one document and one item on one diagonal (place in the document
minus place in the item) are one alignment.  It counts if at least `least`
windows, or all of a shorter item,
* are verbatim, that is, have the item's own values in all slots, whatever the
  rest of the alignment says; or
* follow each other with slots that agree: each value of the item stands for
  one value in the document, so that a question with other numbers or names
  is caught, and a text that only has the same grammar is not.  Two values of
  the item may become one.

Items of fewer than FEW_WORDS words are too short for a template; they are
matched verbatim, by windows of words, numbers and single marks.  An item of
one word or none, which stands in countless texts, is found in documents that
say nothing else.

The bit map has 2 ** BITS bits whatever the size of the benchmark; if it
fills up it lets more windows through, and the join still decides.

Defined cases: null or empty texts match nothing; items shorter than a window
are matched by windows of their own length; rows are judged by their id and
text, so that rows without an id are judged as well and equal rows alike;
items without an id count but are not listed; an empty benchmark leaves all
documents clean.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, FEW_WORDS, BITS = 8, 4, 24
#: Share of a template window that must be words, not slots.
LEAST_WORDS = 0.5
TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[.!?\n:]")
#: Tokens of items too short for a template: words, numbers and each mark.
FINE = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[^\w\s]|_")
#: How a window was made.
TEMPLATE, VERBATIM, WHOLE = 0, 1, 2
#: Units that may follow a number.
UNITS = frozenset("mm cm m km in ft yd mi mg g kg t oz lb lbs ml l s sec min h hr hrs day days week weeks month months year years hz khz mhz ghz w kw v a j kj pa kpa mol c f k usd eur gbp dollars cents euros percent meters metres miles kilometers kilometres minutes hours seconds grams kilograms liters litres feet inches pounds ounces".split())
NUM, UNIT, NAME = (xxhash.xxh64_intdigest(x) & ~7 for x in ("<num>", "<unit>", "<name>"))
#: Low bits of a token's number: what kind it is.
IS_END, IS_NUM, IS_UNIT, IS_CAPITAL = 1, 2, 3, 4
WINDOW_TYPE = "place:long,hash:long,slots:array<struct<place:int,kind:int,value:string>>"


class Tokens(dict):
    """token -> 61 bits of a hash and 3 of its kind, remembered up to a bound."""

    def __missing__(self, token: str) -> int:
        if len(self) > 300_000:
            self.clear()
        if token in ".!?\n:":
            n = IS_END
        elif token[0].isdecimal():
            n = (xxhash.xxh64_intdigest(token) & ~7) | IS_NUM
        else:
            low = token.lower()
            kind = IS_UNIT if low in UNITS else IS_CAPITAL if token[0] != low[0] else 0
            n = (xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass")) & ~7) | kind
        self[token] = n
        return n


KNOWN = Tokens()


def template(text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words, their hashes, and their slots: 0 none, 1 number, 2 unit, 3 name."""
    tokens = TOKEN.findall(text)
    n = np.fromiter(map(KNOWN.__getitem__, tokens), np.uint64, len(tokens))
    kind = (n & np.uint64(7)).astype(np.int8)
    end = kind == IS_END
    after_end = np.append(True, end[:-1]) if len(end) else end
    after_num = np.append(False, kind[:-1] == IS_NUM) if len(end) else end
    slots = np.where(kind == IS_NUM, 1, np.where((kind == IS_UNIT) & after_num, 2, np.where((kind == IS_CAPITAL) & ~after_end, 3, 0))).astype(np.int8)
    keep = ~end
    words = tokens if keep.all() else [t for t, k in zip(tokens, keep, strict=True) if k]
    return words, n[keep] & ~np.uint64(7), slots[keep]


def hashes_at(x: np.ndarray, at: np.ndarray | slice, length: int, seed: int) -> np.ndarray:
    """Hashes of the windows of a length that start at the given places."""
    with np.errstate(over="ignore"):
        c = common.constants(length, seed + length)
        m = len(x) - length + 1
        h = x[:m][at] * c[0]
        for j in range(1, length):
            h += x[j : j + m][at] * c[j]
        return common.mix64(h)


def words_in(taken: np.ndarray, length: int) -> np.ndarray:
    """Tokens of each window that are not taken by slots."""
    filled = np.append(0, np.cumsum(taken))
    return length - (filled[length:] - filled[:-length])


def windows(hashes: np.ndarray, slots: np.ndarray, length: int, loose: bool = False):
    """(places, hashes, names: whether names are slots, None in windows by plain values) of the windows of a length.

    loose: plain values also where the slots, with less around the window,
    might be too many.
    """
    if len(hashes) < length:
        return
    kinds = np.bincount(slots, minlength=4)
    x, enough = hashes, np.full(len(hashes) - length + 1, length)
    if kinds[1] + kinds[2]:
        x = np.where(slots == 1, np.uint64(NUM), np.where(slots == 2, np.uint64(UNIT), hashes))
        enough = words_in((slots == 1) | (slots == 2), length)
    few = enough < LEAST_WORDS * length + loose
    yield from some_of(x, enough >= LEAST_WORDS * length, length, False)
    if kinds[3]:
        name = slots == 3
        yield from some_of(np.where(name, np.uint64(NAME), x), words_in(slots > 0, length) >= LEAST_WORDS * length, length, True)
    if few.any():
        at = np.flatnonzero(few)
        yield at, hashes_at(hashes, at, length, 531), None


def some_of(x: np.ndarray, ok: np.ndarray, length: int, names: bool):
    h = hashes_at(x, slice(None), length, 31)
    at = np.flatnonzero(ok)
    yield at, (h if len(at) == len(h) else h[at]), names


def fine_tokens(text: str) -> list[str]:
    return FINE.findall(text.lower())


def verbatim_windows(tokens: list[str], length: int) -> np.ndarray:
    x = np.array([xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for t in tokens], np.uint64)
    return hashes_at(x, slice(None), length, 1031) if len(x) >= length else np.empty(0, np.uint64)


def whole_hash(tokens: list[str]) -> int:
    return xxhash.xxh64_intdigest("\n".join(tokens).encode("utf-8", "surrogatepass"))


def slot_values(words: list[str], slots: np.ndarray, at: int, length: int, names: bool | None) -> list[dict]:
    if names is None:
        return []
    return [{"place": k, "kind": int(slots[at + k]), "value": words[at + k].lower()} for k in range(length) if slots[at + k] and (names or slots[at + k] != 3)]


def signed(h: np.ndarray) -> list[int]:
    return h.astype(np.int64).tolist()


def item_windows(text: str, most: int = WINDOW) -> list[dict]:
    """family, length, place, hash, slots of an item's windows, each hash and place once."""
    words, hashes, slots = template(text)
    if len(words) >= FEW_WORDS:
        length, found = min(most, len(words)), {}
        for at, h, names in windows(hashes, slots, length):
            for k, own in zip(at.tolist(), signed(h), strict=True):
                found.setdefault((k, own), {"family": TEMPLATE, "length": length, "place": k, "hash": own, "slots": slot_values(words, slots, k, length, names)})
        return list(found.values())
    tokens = fine_tokens(text)
    if not tokens:
        return []
    if len(words) < 2:
        return [{"family": WHOLE, "length": len(tokens), "place": 0, "hash": signed(np.array([whole_hash(tokens)], np.uint64))[0], "slots": []}]
    length = min(most, len(tokens))
    return [{"family": VERBATIM, "length": length, "place": k, "hash": h, "slots": []} for k, h in enumerate(signed(verbatim_windows(tokens, length)))]


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item (key), item_id, family, length, place, hash, slots, n (windows of the item)."""

    def cut(texts):
        got = [item_windows(t) for t in texts]
        return got, [len({w["place"] for w in own}) for own in got]

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").withColumn("item", F.coalesce(F.col("item_id").cast("string"), F.concat(F.lit("-"), F.md5("text"))))
    found = common.map_text(rows, ["item", "item_id"], cut, f"w array<struct<family:int,length:int,{WINDOW_TYPE}>>, n int")
    return common.materialize(found.select("item", "item_id", "n", F.explode("w").alias("w")).select("item", "item_id", "n", "w.*"), "benchmark")


def bit_map(hashes: DataFrame) -> np.ndarray:
    """2 ** BITS bits, set where a hash falls; parts are joined by Spark, so that the driver sees the map only."""
    parts = 64
    size = (1 << BITS) // 8 // parts

    def fill(frames):
        own = np.zeros((1 << BITS) // 8, np.uint8)
        for pdf in frames:
            at = (pdf["hash"].to_numpy(np.int64).astype(np.uint64) >> np.uint64(64 - BITS)).astype(np.int64)
            np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pd.DataFrame({"part": np.arange(parts), "bits": [own[k * size : (k + 1) * size].tobytes() for k in range(parts)]})

    def merge(pdf):
        own = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in pdf["bits"]])
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "bits": [own.tobytes()]})

    # at most 16 maps meet in a merge
    maps = hashes.select("hash").coalesce(16).mapInPandas(fill, "part int, bits binary").groupBy("part").applyInPandas(merge, "part int, bits binary")
    out = np.zeros((parts, size), np.uint8)
    for r in maps.collect():
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def document_windows(docs: DataFrame, bits: np.ndarray, kinds: list[tuple[int, int]]) -> DataFrame:
    """row_key, at, hash, values of the windows that the bit map lets through; kinds: families and lengths of the benchmark's windows."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    lengths, fine = [n for f, n in kinds if f == TEMPLATE], [n for f, n in kinds if f == VERBATIM]
    whole = {n for f, n in kinds if f == WHOLE}

    def look(texts):
        table = shared.value

        def known(h):
            at = (h >> np.uint64(64 - BITS)).astype(np.int64)
            return np.flatnonzero((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1)

        out = []
        for text in texts:
            found = {}
            if lengths:
                words, hashes, slots = template(text)
                for length in lengths:
                    for at, h, names in windows(hashes, slots, length, loose=True):
                        hit = known(h)
                        for k, own in zip(at[hit].tolist(), signed(h[hit]), strict=True):
                            found.setdefault((k, own), slot_values(words, slots, k, length, names))
            if fine or whole:
                tokens = fine_tokens(text)
                for length in fine:
                    h = verbatim_windows(tokens, length)
                    found.update({(k, own): [] for k in known(h).tolist() for own in signed(h[k : k + 1])})
                if len(tokens) in whole:
                    found[0, signed(np.array([whole_hash(tokens)], np.uint64))[0]] = []
            out.append([{"place": k, "hash": h, "slots": values} for (k, h), values in found.items()])
        return (out,)

    found = common.map_text(docs, ["row_key"], look, f"w array<struct<{WINDOW_TYPE}>>")
    found = found.filter(F.size("w") > 0).select("row_key", F.explode("w").alias("w"))
    return found.select("row_key", F.col("w.place").alias("at"), "w.hash", F.col("w.slots").alias("values"))


#: Bytes of benchmark windows that may be broadcast; beyond that the join is a shuffle.
BROADCAST_BYTES = 32_000_000


def row_key() -> Column:
    """Rows with the same id and text are judged alike."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.xxhash64(F.lit(1), "text"), F.xxhash64(F.lit(2), "text"))


def agreement(found: list) -> tuple[int, int]:
    """Of the windows (place, pairs of the item's and the document's slot values) of an alignment: how many are verbatim, and the most in order whose slots agree."""
    verbatim, places = set(), {}
    for place, same in found:
        pairs = {(i, d) for i, d in same}
        places.setdefault(place, set()).update(pairs)
        if all(i == d for i, d in pairs):
            verbatim.add(place)
    rows = [places[k] for k in sorted(places)]
    # of the stretch from `begin`: each item value's values in the document, with their numbers
    values: dict[str, dict[str, int]] = {}
    begin = best = clashes = 0
    for k, row in enumerate(rows):
        for i, d in row:
            own = values.setdefault(i, {})
            own[d] = own.get(d, 0) + 1
            clashes += own[d] == 1 and len(own) > 1
        while clashes:
            for i, d in rows[begin]:
                own = values[i]
                own[d] -= 1
                if not own[d]:
                    del own[d]
                    clashes -= len(own) > 0
            begin += 1
        best = max(best, k + 1 - begin)
    return len(verbatim), best


def alignments(docs: DataFrame, benchmark: DataFrame, least: int = 6) -> DataFrame:
    """row_key, item, item_id, windows (matched), verbatim (enough of them): the contaminated documents with their items."""
    own = benchmark_windows(benchmark)
    kinds = sorted((r["family"], r["length"]) for r in own.select("family", "length").distinct().collect())
    found = document_windows(docs.select("text", row_key().alias("row_key")), bit_map(own), kinds)
    size = own.agg(F.sum(F.length("item") + 60 + 60 * F.size("slots"))).first()[0] or 0
    # a hash that many items share meets the many documents that have it: a broadcast spreads them, and a shuffle splits such keys
    pairs = found.join(F.broadcast(own) if size <= BROADCAST_BYTES else own.hint("merge"), "hash")
    pairs = pairs.filter(F.size("slots") == F.size("values")).withColumn("diagonal", F.col("at") - F.col("place"))
    name = lambda s: F.concat_ws(":", s["kind"].cast("string"), s["value"])
    pairs = pairs.withColumn("same", F.arrays_zip(F.transform("slots", name).alias("i"), F.transform("values", name).alias("d")))
    # an item's windows bound these sets
    runs = pairs.groupBy("row_key", "item", "diagonal").agg(F.first("item_id").alias("item_id"), F.count_distinct("place").alias("windows"), F.first("n").alias("n"), F.collect_set(F.struct("place", "same")).alias("found"))
    enough = F.least(F.lit(least), "n")
    runs = runs.filter(F.col("windows") >= enough).withColumn("agreed", F.udf(agreement, "verbatim int, run int", useArrow=False)("found"))
    runs = runs.withColumn("verbatim", F.col("agreed.verbatim") >= enough).filter(F.col("verbatim") | (F.col("agreed.run") >= enough))
    return runs.groupBy("row_key", "item").agg(F.first("item_id").alias("item_id"), F.max("windows").alias("windows"), F.max("verbatim").alias("verbatim"))


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, contaminated, n_items, items (their ids) of every document."""
    hits = alignments(docs, benchmark, **options).groupBy("row_key").agg(F.count("*").cast("int").alias("n_items"), F.array_sort(F.collect_set("item_id")).alias("items"))
    hits = common.materialize(hits, "contaminated")
    out = docs.select("doc_id", row_key().alias("row_key")).join(hits, "row_key", "left")
    none = F.array().cast("array<long>")
    return out.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items", none).alias("items"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows without an item of the benchmark."""
    hits = common.materialize(alignments(docs, benchmark, **options).select("row_key").distinct(), "contaminated")
    return docs.join(hits, row_key() == hits["row_key"], "left_anti").select(*docs.columns)
