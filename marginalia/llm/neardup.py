"""N-gram Jaccard join with an LSH forest.

Texts with the same set of word shingles are one class; the work is done on
classes.  A class has a label of DEPTH min-hashes in each of TREES trees, and
the labels of a tree make a trie: classes that share the first x values lie
under one node at depth x.

The forest is read from its longest prefixes upwards.  At each depth the nodes
that hold two classes or more are candidates, but for nodes with the very
members of one that was done before.  Their classes are compared exactly, and
a pair only in the first tree in which it shares a node, and at the greatest
depth at which it does so in any tree; labels alone tell, so every pair is
compared once, and pairs are never listed.  From the similarities of the links
found so far, each of which had a known chance to meet at this depth, the
number of all links is estimated; prefixes are shortened until the share found
reaches `recall`, or until even a pair at the threshold meets with that chance.

A node's classes are compared in blocks: a unit of work holds the shingle sets
of at most two blocks and gives, for each class, its number of links and the
least class it hangs together with.  So a node of any size is spread over
tasks, no set of partners is cut, and links between different texts of one
node are all counted.

Defined cases: words are runs of \\w in lower case; a text shorter than a
shingle is one shingle; a text without words and a row without doc_id link to
nothing; rows that repeat a document are copies; whole texts count; an empty
table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

TREES, DEPTH = 16, 8
#: Bytes of a min-hash in a label, and of a tree's part of it.
VALUE = 2
PART = DEPTH * VALUE
#: Classes and shingles of a block: two blocks are what a task holds.
BLOCK, BLOCK_SHINGLES = 1024, 1_000_000
#: Buckets of similarity between the threshold and 1.
BUCKETS = 20


def chance(similarity, depth: int, trees: int = TREES):
    """That a pair shares a node at this depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def floor_depth(threshold: float, recall: float) -> int:
    """The greatest depth at which even pairs at the threshold meet with the target recall."""
    return max([x for x in range(1, DEPTH + 1) if chance(threshold, x) >= recall], default=1)


def set_name(shingles: np.ndarray) -> str:
    return xxhash.xxh3_128_hexdigest(shingles.tobytes())


class Shingler:
    def __init__(self, n: int):
        self.n, self.words = n, common.WordHashes()

    def __call__(self, text: str) -> np.ndarray:
        return common.shingle_hashes(self.words.of(common.WORD.findall(text.lower())), self.n)


SHINGLERS: dict[int, Shingler] = {}


def shingler(n: int) -> Shingler:
    """One in each worker process, so that it remembers words from batch to batch."""
    return SHINGLERS.setdefault(n, Shingler(n))


def label(shingles: np.ndarray) -> bytes:
    """The least of each of TREES x DEPTH hashes of the shingles, as 16 bits each."""
    many = TREES * DEPTH
    out = np.empty(many, ">u2")
    a = common.constants(many, 71)
    with np.errstate(over="ignore"):
        step = max(1, 400_000 // max(1, len(shingles)))
        for k in range(0, many, step):
            h = shingles[None, :] * a[k : k + step, None]
            h ^= h >> np.uint64(29)
            out[k : k + step] = h.min(1) >> np.uint64(48)
    return out.tobytes()


def signatures(docs: DataFrame, n: int, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, other columns to be kept, c (class, null without words), label."""

    def sign(texts):
        from marginalia.llm.neardup import label, set_name, shingler

        sets = [shingler(n)(text) for text in texts]
        return [set_name(s) if len(s) else None for s in sets], [label(s) if len(s) else None for s in sets]

    return common.map_text(docs, ["doc_id", *also], sign, "c string, label binary")


def similarities(sets: list[np.ndarray]) -> np.ndarray:
    """Jaccard similarities of all pairs of sets."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.float64)
    if n == 2:
        inter = np.zeros((2, 2))
        inter[0, 1] = inter[1, 0] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
    else:
        _, codes, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rows = np.repeat(np.arange(n), sizes.astype(np.int64))[np.argsort(codes, kind="stable")]
        start = np.cumsum(uses) - uses
        inter = np.zeros((n, n))
        # shingles of many sets by products of matrices, those of few by counting their pairs of rows
        limit = max(2, n // 8)
        often = np.flatnonzero(uses > limit)
        for k in range(0, len(often), 4096):
            part = often[k : k + 4096]
            many = uses[part]
            column = np.repeat(np.arange(len(part)), many)
            x = np.zeros((n, len(part)), np.float32)
            x[rows[np.repeat(start[part] - (np.cumsum(many) - many), many) + np.arange(len(column))], column] = 1
            inter += x @ x.T
        held, size = [], 0
        for m in np.unique(uses[(uses > 1) & (uses <= limit)]).tolist():
            part = np.flatnonzero(uses == m)
            step = max(1, 4_000_000 // (m * m))
            for k in range(0, len(part), step):
                r = rows[start[part[k : k + step], None] + np.arange(m)]
                held.append((r[:, :, None] * n + r[:, None, :]).ravel())
                size += len(held[-1])
                if size > 4_000_000:
                    inter += np.bincount(np.concatenate(held), minlength=n * n).reshape(n, n)
                    held, size = [], 0
        if held:
            inter += np.bincount(np.concatenate(held), minlength=n * n).reshape(n, n)
        np.fill_diagonal(inter, sizes)
    return inter / np.maximum(sizes[:, None] + sizes[None] - inter, 1)


def owned(labels: list[bytes], tree: int, depth: int, split: int | None) -> np.ndarray:
    """Which pairs are compared at this node: sharing it, none before it at this depth, and none at a greater depth.

    With `split`, only pairs across it.
    """

    def codes(t: int, x: int) -> np.ndarray:
        number: dict[bytes, int] = {}
        return np.array([number.setdefault(a[t * PART : t * PART + x * VALUE], len(number)) for a in labels])

    def share(t: int, x: int) -> np.ndarray:
        c = codes(t, x)
        return c[:, None] == c[None]

    out = share(tree, depth)
    np.fill_diagonal(out, False)
    if split is not None:
        out[:split, :split] = False
        out[split:, split:] = False
    for t in range(tree):
        if not out.any():
            return out
        out &= ~share(t, depth)
    for t in range(TREES if depth < DEPTH else 0):
        if not out.any():
            return out
        out &= ~share(t, depth + 1)
    return out


def least_of_parts(linked: np.ndarray) -> np.ndarray:
    """For each row the least index that it hangs together with."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None], len(label)).min(1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


LINKS = "c string, root string, links long, text_links long, found array<long>"


def verified(parts: DataFrame, depth: int, threshold: float) -> DataFrame:
    """c, root, links (documents), text_links (classes) of each class in each unit of work, and on one row of a unit its links by similarity.

    parts: unit string, tree int, side int (0 or 1; all 0 in a block with
    itself), c, copies, label, shingles; rows of a unit come one after the
    other.
    """

    def work(frames):
        unit, tree, rows = None, 0, {}

        def done():
            order = sorted(rows, key=lambda c: (rows[c][0], c))
            sides = [rows[c][0] for c in order]
            split = sides.index(1) if 1 in sides and 0 in sides else None
            mine = owned([rows[c][2] for c in order], tree, depth, split)
            if not mine.any():
                return
            j = similarities([np.frombuffer(rows[c][3], np.uint64) for c in order])
            linked = mine & (j >= threshold - 1e-9)
            some = np.flatnonzero(linked.any(1))
            if not len(some):
                return
            root = least_of_parts(linked[np.ix_(some, some)])
            copies = np.array([rows[c][1] for c in order], np.float64)
            names = [order[k] for k in some]
            # the least name of a part, for order is by side first
            least: dict[int, str] = {}
            for k, r in enumerate(root.tolist()):
                least[r] = min(least.get(r, names[k]), names[k])
            bucket = ((j[np.triu(linked)] - threshold) / (1 - threshold + 1e-9) * BUCKETS).astype(int).clip(0, BUCKETS - 1)
            found = [np.bincount(bucket, minlength=BUCKETS).tolist()] + [None] * (len(some) - 1)
            yield pd.DataFrame({"c": pd.Series(names, dtype=object), "root": pd.Series([least[r] for r in root.tolist()], dtype=object), "links": (linked[some] @ copies).astype(np.int64), "text_links": linked[some].sum(1).astype(np.int64), "found": pd.Series(found, dtype=object)})

        for pdf in frames:
            for u, t, side, c, copies, name, shingles in zip(pdf["unit"], pdf["tree"], pdf["side"], pdf["c"], pdf["copies"], pdf["label"], pdf["shingles"], strict=True):
                if u != unit:
                    if len(rows) > 1:
                        yield from done()
                    unit, tree, rows = u, int(t), {}
                rows[c] = (side, copies, name, shingles)
        if len(rows) > 1:
            yield from done()

    return parts.mapInPandas(work, LINKS)


def node(depth: int) -> Column:
    """A class's node in a tree, from its label."""
    return F.xxhash64("tree", F.substring("label", F.col("tree") * PART + 1, F.lit(depth * VALUE)))


def in_trees(classes: DataFrame) -> DataFrame:
    return classes.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))))


def shingle_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """c, copies, label, shingles, size of the wanted classes (c, first, copies, label), from the texts of one document of each."""
    ids = wanted.select(F.col("c").alias("wanted"), "first", "copies", "label")
    texts = docs.select("doc_id", "text").join(ids.hint("merge"), F.col("doc_id") == F.col("first"))

    def sets(texts):
        from marginalia.llm.neardup import set_name, shingler

        got = [shingler(n)(t) for t in texts]
        return [set_name(s) for s in got], [s.tobytes() for s in got], [len(s) for s in got]

    # other rows of the same doc_id are other classes
    made = common.map_text(texts, ["wanted", "copies", "label"], sets, "c string, shingles binary, size long").filter("c = wanted").drop("wanted")
    return made.dropDuplicates(["c"])


def groups(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.999, also: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, list[dict]]:
    """(doc_id, also..., c) of all rows; c, root, class_id, copies, links, text_links of all classes; and of each depth the links so far and their estimated share of all.

    root names the group; class_id, its least doc_id, need not where unlike texts have one id.
    """
    lowest = floor_depth(threshold, recall)
    signed = common.materialize(signatures(docs, n, also), "signatures")
    live = signed.filter("c IS NOT NULL AND doc_id IS NOT NULL")
    classes = live.groupBy("c").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.min("label").alias("label"))
    classes = common.materialize(classes, "classes")

    # classes that share no node even at the lowest depth have no candidates at all
    rows = in_trees(classes).select(node(lowest).alias("node"), F.xxhash64("c").alias("id"))
    shared = rows.groupBy("node").count().filter("count > 1").select("node")
    near = rows.join(shared.hint("merge"), "node", "left_semi").select("id").distinct()
    wanted = classes.join(near.hint("merge"), F.xxhash64("c") == F.col("id"), "left_semi")
    sets = common.materialize(shingle_sets(docs, wanted, n), "sets")

    tries = in_trees(sets.select("c", "label", "size"))
    links, seen, levels, found = [], None, [], np.zeros(BUCKETS)
    for depth in range(DEPTH, lowest - 1, -1):
        places = tries.withColumn("node", node(depth))
        nodes = places.groupBy("node").agg(F.min("tree").alias("tree"), F.count("*").alias("n"), F.sum("size").alias("size"), F.bit_xor(F.xxhash64("c")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "c")).alias("y")).filter("n > 1")
        # of nodes with the same members one is enough, and none if a deeper one had them
        fresh = nodes.groupBy("n", "x", "y").agg(F.min(F.struct("tree", "node", "size")).alias("first"))
        if seen is not None:
            fresh = fresh.join(seen.hint("merge"), ["n", "x", "y"], "left_anti")
        fresh = common.materialize(fresh.select("n", "x", "y", "first.*"), "nodes")
        seen = fresh.select("n", "x", "y") if seen is None else seen.unionByName(fresh.select("n", "x", "y"))
        blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("size") / BLOCK_SHINGLES)).cast("int")
        members = places.select("c", "node").join(fresh.select("node", "tree", blocks.alias("blocks")).hint("merge"), "node")
        members = members.withColumn("own", F.pmod(F.xxhash64(F.lit(2), "c"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        units = members.select(F.concat_ws("/", "node", F.least("own", "other"), F.greatest("own", "other")).alias("unit"), "tree", (F.col("own") > F.col("other")).cast("int").alias("side"), "c")
        parts = units.join(sets.select("c", "copies", "label", "shingles").hint("merge"), "c")
        links.append(common.materialize(verified(parts.repartition(F.col("unit")).sortWithinPartitions("unit"), depth, threshold), "links"))
        sums = links[-1].filter("found IS NOT NULL").agg(*[F.sum(F.element_at("found", k + 1)).alias(f"b{k}") for k in range(BUCKETS)]).first()
        found += np.array([x or 0 for x in sums], float)
        # each link stands for as many as have its similarity, taken as the least of its bucket
        everything = float((found / chance(threshold + (1 - threshold) * np.arange(BUCKETS) / BUCKETS, depth)).sum())
        levels.append({"depth": depth, "links": int(found.sum()), "recall": float(found.sum() / everything) if everything else None})
        if everything and found.sum() >= recall * everything:
            break

    every = reduce(DataFrame.unionByName, links)
    roots = components(every.select(F.col("c").alias("a"), F.col("root").alias("b")))
    counts = every.groupBy("c").agg(F.sum("links").alias("links"), F.sum("text_links").alias("text_links"))
    rooted = classes.select("c", "first", "copies").join(roots.select(F.col("id").alias("c"), "root").hint("merge"), "c", "left").join(counts.hint("merge"), "c", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "c"))
    least = rooted.groupBy("root").agg(F.min("first").alias("class_id"))
    out = rooted.join(least.hint("merge"), "root").select("c", "root", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("text_links", F.lit(0)).alias("text_links"))
    out = common.materialize(out, "groups")
    common.discard(sets, classes, *links, roots)
    return signed.select("doc_id", *also, "c"), out, levels


def link(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id, n_links, n_text_links, n_copies: one row per document.

    class_id: the least doc_id of the near-duplicate group (its own for a
    document alone); n_links: other documents at or over the threshold, copies
    included; n_text_links: other classes of texts; n_copies: other documents
    with the same shingles.
    """
    rows, found, _ = groups(docs, **options)
    joined = rows.join(found.hint("merge"), "c", "left")
    extra = F.coalesce(F.col("copies") - 1, F.lit(0))
    # rows without an id share a class with documents of the same text, but link to nothing
    live = F.col("doc_id").isNotNull()
    return joined.select(
        "doc_id",
        F.when(live, F.coalesce("class_id", "doc_id")).alias("class_id"),
        F.when(live, F.coalesce("links", F.lit(0)) + extra).otherwise(0).alias("n_links"),
        F.when(live, F.coalesce("text_links", F.lit(0))).otherwise(0).alias("n_text_links"),
        F.when(live, extra).otherwise(0).alias("n_copies"),
    )


def row_key() -> Column:
    """Rows with the same id and text are the same document."""
    return F.concat_ws(":", F.col("doc_id").cast("string"), F.xxhash64(F.lit(1), "text"), F.xxhash64(F.lit(2), "text"))


def without_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row of each group: that with the least doc_id, and of several texts with this id one that the group holds.

    Rows are told apart by id and text, so that an unlike text under the id of
    a duplicate stays.  Of rows with the same id and text one stays.  Rows
    without an id or without words stay.
    """
    (key,) = common.free_names(docs, "row_key")
    keyed = docs.withColumn(key, row_key())
    rows, found, _ = groups(keyed, also=(key,), **options)
    named = rows.filter("c IS NOT NULL AND doc_id IS NOT NULL").join(found.select("c", "root").hint("merge"), "c")
    named = common.materialize(named.select("doc_id", F.col(key).alias("k"), "root"), "named")
    first = named.groupBy("root").agg(F.min(F.struct("doc_id", "k")).alias("first")).select("first.k")
    all_keys = named.groupBy("k").count()
    # keys with what becomes of them: away, or one of several equal rows
    fate = all_keys.join(first.withColumn("stays", F.lit(True)), "k", "left").filter("stays IS NULL OR count > 1")
    fate = common.materialize(fate.select(F.col("k").alias("fate_key"), F.coalesce("stays", F.lit(False)).alias("fate_stays")), "fate")
    kept = keyed.join(fate, F.col(key) == F.col("fate_key"), "left_anti").select(*docs.columns)
    equal = common.materialize(fate.filter("fate_stays"), "equal")
    if equal.isEmpty():
        return kept
    several = keyed.join(equal, F.col(key) == F.col("fate_key"), "left_semi")
    # rows of one key differ in other columns at most: the least stays
    whole = F.struct(*[F.col(c) for c in docs.columns])
    one = several.groupBy(key).agg(F.min_by(whole, F.to_json(whole)).alias("row")).select("row.*")
    return kept.unionByName(one)
