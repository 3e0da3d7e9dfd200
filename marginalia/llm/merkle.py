"""Merkle manifest of a dataset, by slot pivots.

Every row is a leaf: the SHA-256 of its columns, each as `-` if null, else its
length in UTF-8 bytes, `:` and its value.  The leaves of one group (a
language, say) ascend by their key; while a level of a group has more than one
node, every `fanout` consecutive nodes become the SHA-256 of their digests'
hex text (the last run may be shorter, even one node).  What remains is the
group's subroot; the subroots in order of the group make the root likewise.

A pass spreads the nodes below one ancestor into columns with conditional
aggregates, one column a slot; the digests of the levels between are hashes of
concatenated columns, and a node's siblings are its run's columns without its
own slot.  A pass goes up `LEVELS[fanout]` levels at once, so that there are
few passes, and each has a small part of the rows of the one below.  Proofs
come down the same tables: a node's proof is its siblings, level by level,
and then its ancestor's.

No group is sorted or numbered in one task: rows are dealt by ranges of
(group, key), numbered within their range, and each range's start is the sum
of the counts before it.

Defined results: a null group is a group of its own, before all others; rows
without a key come first; rows with equal keys follow by their leaves, and
rows equal in all columns are leaves of their own with equal digests.  Null,
empty and very long values are hashed whole.  Extra columns take no part.  An
empty table gives no rows.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: A proof: of each level, the digests before and after the own one in its run.
PROOF = "array<struct<left: string, right: string>>"


def levels_of(fanout: int, width: int = 16) -> int:
    """Levels that one pass goes up: as many as keep its slots within the width, one at least."""
    levels = 1
    while fanout ** (levels + 1) <= width:
        levels += 1
    return levels


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("", *parts), 256)


def field(value: Column) -> Column:
    """A value as it enters a leaf."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(names: tuple[str, ...] = COLUMNS, **changed: Column) -> Column:
    """The digest of a row; columns in `changed` enter with another value."""
    return digest(*[field(changed.get(name, F.col(name))) for name in names])


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its siblings lead to."""
    return F.aggregate(proof, start, lambda acc, step: F.sha2(F.concat(step["left"], acc, step["right"]), 256))


def proof_text(proof: Column) -> Column:
    """All digests of a proof, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), "")


# ---------------------------------------------------------------- passes


def numbered(nodes: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes (`_group` and others) with `_at`, their place from 0 in their group, and `_n`, its size; and the table that they are read from."""
    spark = nodes.sparkSession
    keys = [F.col(c).asc_nulls_first() for c in ("_group", *order)]
    # the last key only parts rows that are equal in all others
    tied = nodes.withColumn("_tie", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys, "_tie").withColumn("_part", F.spark_partition_id())
    dealt = common.materialize(dealt, "ranges")
    counts = dealt.groupBy("_group", "_part").count()
    by_part = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("_group").alias("_g"), F.col("_part").alias("_p"), F.coalesce(F.sum("count").over(by_part), F.lit(0)).alias("_start"), F.sum("count").over(Window.partitionBy("_group")).alias("_n")
    )
    within = Window.partitionBy("_group", "_part").orderBy(*keys[1:], "_tie")
    placed = dealt.withColumn("_k", F.row_number().over(within)).join(starts, F.col("_group").eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return placed.withColumn("_at", F.col("_start") + F.col("_k") - 1).drop("_tie", "_part", "_g", "_p", "_start", "_k"), dealt


def climbed(n: Column, fanout: int, levels: int) -> Column:
    """How many of the pass's levels a group of n nodes has."""
    return sum((F.when(n > F.lit(fanout**t), 1).otherwise(0) for t in range(1, levels)), F.when(n > 1, 1).otherwise(0))


def spread(nodes: DataFrame, fanout: int, levels: int, carried: list[str]) -> DataFrame:
    """One row for each ancestor: its slots, the digests of the levels between, its own digest.

    _group, _at (the ancestor's place), _n (its level's size), climbed, slots
    (array of struct of digest and the carried columns), floors (of each level
    below the ancestor, the digests), digest.
    """
    width = fanout**levels
    slot = [F.max(F.when(F.col("_at") % width == j, F.struct("digest", *carried))).alias(f"c{j}") for j in range(width)]
    rows = nodes.groupBy("_group", F.floor(F.col("_at") / width).alias("_up"), "_n").agg(*slot).withColumn("climbed", climbed(F.col("_n"), fanout, levels))
    floors = ["f0"]
    rows = rows.withColumn("f0", F.array(*[F.col(f"c{j}.digest") for j in range(width)]))
    for t in range(levels):
        below = [F.col(floors[t])[i] for i in range(width // fanout**t)]
        runs = [below[i : i + fanout] for i in range(0, len(below), fanout)]
        rows = rows.withColumn(f"f{t + 1}", F.array(*[F.when(run[0].isNotNull(), digest(*run)) for run in runs]))
        floors.append(f"f{t + 1}")
    top = functools.reduce(lambda other, t: F.when(F.col("climbed") == t, F.col(floors[t])[0]).otherwise(other), range(levels), F.col(floors[levels])[0])
    return rows.select(
        "_group",
        F.col("_up").alias("_at"),
        F.ceil(F.col("_n") / F.pow(F.lit(float(fanout)), F.col("climbed"))).cast("long").alias("_n"),
        "climbed",
        F.array(*[F.col(f"c{j}") for j in range(width)]).alias("slots"),
        F.array(*[F.col(f) for f in floors[:levels]]).alias("floors"),
        top.alias("digest"),
    )


def siblings(slot: Column, fanout: int, levels: int) -> Column:
    """A slot's steps up to its ancestor: the run's digests before and after the own one, of each level climbed."""
    steps = []
    for t in range(levels):
        own = F.floor(slot / fanout**t).cast("int")
        first = (own - own % fanout).cast("int")
        nodes = F.col("floors")[t]
        before, after = F.slice(nodes, first + 1, own - first), F.slice(nodes, own + 2, first + (fanout - 1) - own)
        steps.append(F.struct(F.array_join(before, "").alias("left"), F.array_join(after, "").alias("right")))
    return F.slice(F.array(*steps), F.lit(1), F.col("climbed"))


@dataclass
class Trees:
    """The trees of all groups: the tables of the passes from the leaves up, and the tops (_group, digest)."""

    passes: list[DataFrame]
    tops: DataFrame
    fanout: int
    levels: int


def grow(nodes: DataFrame, order: list[str], carried: list[str], fanout: int) -> Trees:
    """Trees over nodes (_group, digest, the order's and the carried columns)."""
    if fanout < 2:
        raise ValueError("a fanout of at least 2")
    levels = levels_of(fanout)
    now, dealt = numbered(nodes, order)
    passes, largest = [], None
    while largest is None or largest > 1:
        table = common.materialize(spread(now, fanout, levels, carried), f"pass{len(passes)}")
        passes.append(table)
        largest = table.agg(F.max("_n")).first()[0] or 0
        now, carried = table.select("_group", "_at", "_n", "digest"), []
    common.discard(dealt)
    return Trees(passes, now.select("_group", "digest"), fanout, levels)


def descend(trees: Trees, tops: DataFrame, more: list[str]) -> DataFrame:
    """Leaves with their proofs: tops (_group, proof, more...) come down pass by pass."""
    ups = tops.select("_group", F.lit(0).cast("long").alias("_at"), "proof", *more)
    width = trees.fanout**trees.levels
    for k in reversed(range(len(trees.passes))):
        above = ups.select(F.col("_group").alias("_g"), F.col("_at").alias("_a"), F.col("proof").alias("_proof"), *more)
        met = trees.passes[k].join(above, F.col("_group").eqNullSafe(F.col("_g")) & (F.col("_at") == F.col("_a")))
        slots = met.select("_group", "_at", "climbed", "floors", "_proof", *more, F.posexplode("slots").alias("_slot", "_node")).where("_node is not null")
        ups = slots.select(
            "_group", (F.col("_at") * width + F.col("_slot")).alias("_at"), F.concat(siblings(F.col("_slot"), trees.fanout, trees.levels), F.col("_proof")).alias("proof"), *more, "_node"
        )
        if k:
            ups = ups.drop("_node")
    return ups


# ---------------------------------------------------------------- manifests


def manifest(docs: DataFrame, fanout: int = 2, group: str = "lang", key: str = "doc_id", names: tuple[str, ...] = COLUMNS, **also: Column) -> DataFrame:
    """One row per row of the table: key, leaf, subroot, root, proof, and columns of `also`, expressions over the row.

    The proof leads from the leaf through its subroot to the root.
    """
    leaves = docs.select(F.col(group).alias("_group"), F.col(key).alias("_key"), leaf(names).alias("digest"), *[c.alias(n) for n, c in also.items()])
    leaves = common.materialize(leaves, "leaves")
    carried = ["_key", *also]
    below = grow(leaves, ["_key", "digest"], carried, fanout)
    common.discard(leaves)
    tops = below.tops.select(F.lit(0).alias("_group"), F.col("_group").alias("_name"), "digest")
    above = grow(tops, ["_name"], ["_name"], fanout)
    none = F.lit(None).cast(PROOF)
    root = above.tops.select("_group", F.coalesce(none, F.array().cast(PROOF)).alias("proof"), F.col("digest").alias("root"))
    subroots = descend(above, root, ["root"]).select(F.col("_node._name").alias("_group"), "proof", "root", F.col("_node.digest").alias("subroot"))
    found = descend(below, subroots, ["root", "subroot"])
    return found.select(F.col("_node._key").alias(key), F.col("_node.digest").alias("leaf"), "subroot", "root", "proof", *[F.col(f"_node.{n}").alias(n) for n in also])


def tamper_check(docs: DataFrame, fanout: int = 2) -> DataFrame:
    """The manifest of documents, checked against copies of which every seventh (by checksum of the id) was tampered with.

    doc_id, leaf, subroot, root, proof_sha256, folded_root (from the leaf as
    it is now and the original siblings), verified.
    """
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    n_chars = F.when(hit, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars").cast("decimal(20,0)"))
    made = manifest(docs, fanout, now=leaf(n_chars=n_chars))
    folded = made.withColumn("folded_root", fold(F.col("now"), F.col("proof")))
    return folded.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("proof")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
