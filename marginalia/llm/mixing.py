"""Mixing sources to target weights, in DataFrame functions only.

Sizes are words.  The words of a source, its documents in a seeded random
order, are one stream that is packed into blocks of `block_words`.  The mix
takes slots of such blocks: a source whose target is T words out of S gets
T div S whole passes over its blocks and, of one more pass, as many slots as
the rest needs; the last slot takes only the words still missing.

Each source's slots are dealt to the output shards by a multinomial draw:
`shard_counts` draws a shard for each slot by a seeded hash and counts, so
that the counts of a source over the shards are multinomial and their sum is
its target.  The counts make the slots: those of a shard follow on those of
the shards before it, are mapped to blocks by a pseudorandom permutation of
the source's block numbers, and joined to the blocks by number.  `shards`
gives the packed blocks of each shard, and the words taken of a document are
added up from them.

The permutation is a swap-or-not shuffle: each round pairs x with
(key - x) mod n and swaps the pair if a hash bit of the larger one says so.
Every round is its own inverse, so that for every n each pass takes each
block at most once.

No window covers a whole source: documents are spread over buckets by their
hash, bucket sums are added up, and offsets run within a bucket only.

Defined cases: null texts have size 0; documents without words are never
taken; a null source is a source, the last one; repeated rows are documents
of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WORDS = "[^\\x20\\x09-\\x0D]+"
#: Weights of the sources in order, share of all words, most passes over a source.
WEIGHTS, SHARE, PASSES = (3, 1, 2), 1.5, 2
BUCKETS, CHUNK = 8192, 65_536
#: Shards whose counts are added up in one task.
GROUP = 4096
#: Stands for the null source in joins; no source can start with it and go on like this.
NULL_SOURCE = "￿￿null"


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, s (source, never null), size, h: one row per document."""
    return docs.select(
        "doc_id",
        F.coalesce(F.col("source").cast("string"), F.lit(NULL_SOURCE)).alias("s"),
        F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
        # rows without an id are told apart by their text
        F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(31), "text")).otherwise(F.xxhash64(F.lit(29), "doc_id", F.octet_length("text"))).alias("h"),
    )


def targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """s, source_size, target: one row per source.

    Sharing by weight up to a limit of `passes` times the size, the excess
    reshared, is one level L with targets least(L * weight, limit).  Sources
    fill in the order of limit / weight: with the limits of those before it
    spent, a source is full if the level that the rest would get reaches its
    own.  The table has one row per source; its windows are running sums.
    """
    by_source = sized.groupBy("s").agg(F.sum("size").alias("source_size"))
    null_last = [(F.col("s") == NULL_SOURCE).asc(), F.col("s").asc()]
    k = F.row_number().over(Window.orderBy(*null_last)) - 1
    t = by_source.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(k, F.lit(len(weights))) + 1).cast("int")))
    t = t.withColumn("limit", F.col("source_size") * float(passes)).withColumn("own", F.col("limit") / F.col("weight"))
    order = Window.orderBy("own", *null_last)
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    t = t.withColumn("level", level)
    # the first source that its level does not fill sets the level of all others
    t = t.withColumn("final", F.min(F.when(F.col("level") < F.col("own"), F.struct("own", "level"))).over(everything)["level"])
    target = F.coalesce(F.least("limit", F.col("final") * F.col("weight")), F.col("limit"))
    return t.select("s", "source_size", target.alias("target"))


def packed(sized: DataFrame) -> DataFrame:
    """Adds `at`, the place of each document's first word in the stream of its source."""
    d = sized.filter("size > 0").withColumn("b", F.pmod("h", F.lit(BUCKETS)))
    sums = d.groupBy("s", "b").agg(F.sum("size").alias("n"))
    before = F.sum("n").over(Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("s", "b", F.coalesce(before, F.lit(0)).alias("base"))
    within = F.sum("size").over(Window.partitionBy("s", "b").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1))
    return d.withColumn("in", F.coalesce(within, F.lit(0))).join(sums, ["s", "b"]).select("doc_id", "s", "size", (F.col("base") + F.col("in")).alias("at"))


def permuted(x: Column, n: Column, seed: int, *keys: Column, rounds: int = 12) -> Column:
    """Where a seeded permutation of 0 .. n-1, another one for each value of the keys, sends x."""

    def swap(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit(seed), r, *keys), n) - at, n)
        bit = F.xxhash64(F.lit(seed + 1), r, F.greatest(at, other), *keys)
        return F.when(F.pmod(bit, F.lit(2)) == 1, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x, swap)


def plan(quota: DataFrame, block_words: int, shard_slots: int) -> DataFrame:
    """s, source_size, blocks, whole (passes), rest (words), last (slots of the rest), n (slots), shards (of all sources): one row per source with slots."""
    t = quota.filter("source_size > 0").select("s", "source_size", F.round("target").cast("long").alias("goal"), F.ceil(F.col("source_size") / block_words).cast("long").alias("blocks"))
    t = t.withColumn("whole", F.expr("goal div source_size")).withColumn("rest", F.expr("goal % source_size"))
    t = t.withColumn("last", F.ceil(F.col("rest") / block_words).cast("long")).withColumn("n", F.col("whole") * F.col("blocks") + F.col("last"))
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return t.withColumn("shards", F.ceil(F.sum("n").over(everything) / shard_slots)).filter("n > 0")


def spread(df: DataFrame, n: str, *keys: str) -> DataFrame:
    """Adds k = 0 .. n - 1, made in chunks that are dealt out, so that no task makes all rows of a hot source."""
    c = df.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({n} - 1) div {CHUNK}"))))
    c = c.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "c")
    return c.withColumn("k", F.explode(F.sequence(F.col("c") * CHUNK, F.least(F.col(n), (F.col("c") + 1) * CHUNK) - 1))).drop("c")


def shard_counts(planned: DataFrame, seed: int) -> DataFrame:
    """s, shard, n (slots of the source in the shard), before (its slots in earlier shards): multinomial counts that add up to the source's slots."""
    drawn = spread(planned.select("s", "n", "shards"), "n", "s").select("s", F.pmod(F.xxhash64(F.lit(seed), "s", "k"), "shards").alias("shard"))
    counts = drawn.groupBy("s", "shard").agg(F.count("*").alias("n")).withColumn("g", F.expr(f"shard div {GROUP}"))
    sums = counts.groupBy("s", "g").agg(F.sum("n").alias("m"))
    base = F.sum("m").over(Window.partitionBy("s").orderBy("g").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("s", "g", F.coalesce(base, F.lit(0)).alias("base"))
    within = F.sum("n").over(Window.partitionBy("s", "g").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return counts.withColumn("in", F.coalesce(within, F.lit(0))).join(sums, ["s", "g"]).select("s", "shard", "n", (F.col("base") + F.col("in")).alias("before"))


def slots(quota: DataFrame, block_words: int, seed: int, shard_slots: int) -> DataFrame:
    """s, shard, slot, block, take (words from the block's start): the mix.

    quota: s, source_size, target.  The slots of a shard are those that its
    counts say.
    """
    planned = plan(quota, block_words, shard_slots)
    counts = common.materialize(shard_counts(planned, seed), "counts")
    t = spread(counts, "n", "s", "shard").select("s", "shard", (F.col("before") + F.col("k")).alias("slot"))
    t = t.join(planned.drop("shards").hint("broadcast"), "s") if planned.count() <= MOST_SOURCES else t.join(planned.drop("shards").hint("merge"), "s")
    t = t.withColumn("pass", F.expr("slot div blocks")).withColumn("x", F.expr("slot % blocks"))
    # a part of a pass goes over the full blocks only, if they are enough, so that it meets its goal
    full = F.expr(f"source_size div {block_words}")
    t = t.withColumn("domain", F.when((F.col("pass") == F.col("whole")) & (F.col("last") <= full), full).otherwise(F.col("blocks")))
    t = t.withColumn("x", permuted(F.col("x"), F.col("domain"), seed, F.col("s"), F.col("pass")))
    take = F.when((F.col("last") > 0) & (F.col("slot") == F.col("n") - 1), F.col("rest") - (F.col("last") - 1) * block_words).otherwise(F.lit(block_words))
    return t.select("s", "shard", "slot", F.col("x").alias("block"), take.cast("long").alias("take"))


#: Sources whose plan, one row of numbers each, may be broadcast.
MOST_SOURCES = 10_000


def packed_blocks(place: DataFrame, block_words: int) -> DataFrame:
    """s, block, begin, end (words in the block), at, doc_id, size: the documents' parts of the blocks."""
    first, last = F.expr(f"at div {block_words}"), F.expr(f"(at + size - 1) div {block_words}")
    parts = place.withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("at") - F.col("block") * block_words, F.lit(0))
    end = F.least(F.col("at") + F.col("size") - F.col("block") * block_words, F.lit(block_words))
    return parts.select("s", "block", begin.alias("begin"), end.alias("end"), "at", "doc_id", "size")


def drawn_parts(sized: DataFrame, quota: DataFrame, block_words: int, seed: int, shard_slots: int) -> DataFrame:
    """s, shard, slot, block, begin, words, at, doc_id, size: the parts of documents that the mix takes, slot by slot."""
    parts = packed_blocks(packed(sized), block_words)
    takes = slots(quota, block_words, seed, shard_slots)
    # both sides grow with the data, though the planner takes slots for a few rows
    drawn = parts.join(takes.hint("merge"), ["s", "block"])
    return drawn.withColumn("words", F.least("end", "take") - F.col("begin")).filter("words > 0").drop("end", "take")


def shards(docs: DataFrame, block_words: int = 256, seed: int = 7, shard_slots: int = 4096) -> DataFrame:
    """The output: shard, slot, source (null for the null source), block, pieces (place in the block, doc_id, first word in the document, words), one row per slot."""
    sized = common.materialize(sizes(docs), "sizes")
    quota = common.materialize(targets(sized), "targets")
    p = drawn_parts(sized, quota, block_words, seed, shard_slots)
    from_word = F.col("block") * block_words + F.col("begin") - F.col("at")
    pieces = F.array_sort(F.collect_list(F.struct(F.col("begin").alias("place"), "doc_id", from_word.alias("first"), "words")))
    source = F.when(F.col("s") != NULL_SOURCE, F.col("s"))
    return p.groupBy("shard", "s", "slot", "block").agg(pieces.alias("pieces")).select("shard", "slot", source.alias("source"), "block", "pieces")


def taken_words(docs: DataFrame, block_words: int = 256, seed: int = 7, shard_slots: int = 4096) -> DataFrame:
    """doc_id, s, size, source_size, target, taken of every document (doc_id, text, source)."""
    sized = common.materialize(sizes(docs), "sizes")
    quota = common.materialize(targets(sized), "targets")
    taken = drawn_parts(sized, quota, block_words, seed, shard_slots).groupBy("s", "at", "doc_id", "size").agg(F.sum("words").alias("taken"))
    place = packed(sized)
    none = sized.filter("size = 0").select("s", F.lit(None).cast("long").alias("at"), "doc_id", "size")
    every = place.select("s", "at", "doc_id", "size").unionByName(none)
    joined = every.join(taken.select("s", "at", "taken").hint("merge"), ["s", "at"], "left")
    return joined.join(quota, "s").select("doc_id", "s", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document (doc_id, text, source)."""
    return taken_words(docs, **options).drop("s")


#: Order of documents for whole copies: size classes in an octave, and hash buckets in a class.
CLASSES, SPREAD = 8, 64
#: Times taken are whole numbers of this part, so that their sums are exact.
PART_BITS = 20


def copies(took: DataFrame, seed: int = 7) -> DataFrame:
    """Adds n, the whole copies of all rows of a key, to _k, s, rows, size (of a row), taken (by all rows).

    Cumulative rounding: the times taken are added up along each source from
    its longest to its shortest documents, and a document gets as many copies
    as the sum passes whole numbers, from a seeded start.  Each gets the floor
    of its times or one more, and its times on average; as neighbours are of
    about the same size, a source's words miss its target by less than its
    longest documents.
    """
    t = took.filter("size > 0").withColumn("times", F.expr(f"(taken * {1 << PART_BITS}) div size"))
    t = t.withColumn("c", -F.floor(F.log2("size") * CLASSES)).withColumn("b", F.pmod(F.xxhash64(F.lit(seed + 2), "_k"), F.lit(SPREAD)))
    sums = t.groupBy("s", "c", "b").agg(F.sum("times").alias("sum"))
    before = F.sum("sum").over(Window.partitionBy("s").orderBy("c", "b").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("s", "c", "b", F.coalesce(before, F.lit(0)).alias("base"))
    within = F.sum("times").over(Window.partitionBy("s", "c", "b").orderBy(F.col("size").desc(), "_k").rowsBetween(Window.unboundedPreceding, -1))
    t = t.withColumn("in", F.coalesce(within, F.lit(0))).join(sums, ["s", "c", "b"])
    start = F.pmod(F.xxhash64(F.lit(seed + 3), "s"), F.lit(1 << PART_BITS)) + F.col("base") + F.col("in")
    return t.select("_k", "rows", (F.shiftright(start + F.col("times"), PART_BITS) - F.shiftright(start, PART_BITS)).alias("n"))


def mixed_documents(docs: DataFrame, seed: int = 7, **options) -> DataFrame:
    """The documents of the mix: each row as often as the mix takes its words, in whole copies.

    Rows are matched by doc_id and a hash of the text; equal rows share the
    copies of all of them evenly.
    """
    key, rows_, n_, r_, i_ = common.free_names(docs, "key", "rows", "n", "r", "i")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text", "source"))
    ids = keyed.select(F.col(key).alias("doc_id"), "text", "source")
    took = taken_words(ids, seed=seed, **options).groupBy(F.col("doc_id").alias("_k"), "s")
    took = took.agg(F.count("*").alias("rows"), F.max("size").alias("size"), F.sum("taken").alias("taken"))
    n = common.materialize(copies(took, seed).filter("n > 0").select(F.col("_k").alias(key), F.col("rows").alias(rows_), F.col("n").alias(n_)), "copies")
    one = keyed.join(n.filter(F.col(rows_) == 1), key)
    # the rows of a key are told apart only where there are several
    fixed = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(*fixed)))
    many = keyed.join(n.filter(F.col(rows_) > 1), key).withColumn(r_, place)
    share = F.expr(f"`{n_}` div `{rows_}` + if(`{r_}` <= `{n_}` % `{rows_}`, 1, 0)")
    many = many.withColumn(n_, share).filter(F.col(n_) > 0).drop(r_)
    out = one.unionByName(many)
    return out.withColumn(i_, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n_)))).select(*[F.col(f"`{c}`") for c in docs.columns])
