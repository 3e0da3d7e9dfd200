"""Hard negatives by a multiway hyperplane tree with distance ranges.

A node of the tree has several split points; a row belongs to the nearest, so
that hyperplanes part the children.  For every pair of siblings a split point
stores the range of its distances to the other's rows, and every child the
range of its rows' norms.  A query asks for rows whose score (inner product)
with it lies in a window, which for rows of known norm is an annulus of
distances around it.  From its distance to a split point and the stored range
the triangle inequality bounds its distances to a sibling's rows; where that
does not meet the annulus, the sibling goes.  The rows of the leaves that are
left are compared exactly, so nothing is missed.

The split points are chosen from a sample of at most `sample` rows.  All rows
are dealt to leaves, and the ranges are taken over all rows.  A large leaf (of
many copies, say) is cut into blocks, and a block's queries into chunks, so
that a task holds at most about BLOCK rows and CHUNK queries at a time; the
best of each block are merged.  Both searches go twice: the anchors' own leaf
gives a first bound of the window, then all leaves that can hold better rows
are read.  Data without structure in many dimensions keep nearly all leaves;
then the work is that of all anchors against all rows, in blocks.

Defined results: rows with a null label or vector or a null or non-finite
component take no part.  Shorter vectors are as if filled up with zeros, an
empty one is all zeros.  Rows of one id count once where they have the same
score, and never for an anchor of that id; of an anchor id's rows the least
(label, vector) is the anchor.  A row without an id can be a positive or a
negative, after all others of its score, each for itself.  Extra columns take
no part; an empty table gives no rows.  Scores are exact integers of 64 bits.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

ROWS = "vec_id long, label long, vec binary"
RANGES = "child int, point int, low double, high double, n long"
#: Rows and queries that are compared at a time.
BLOCK, CHUNK = 4_096, 4_096
#: Doubles are exact up to here.
EXACT = float(1 << 53)
#: Roundings of a distance stay below this share of the norms.
SLACK = 1e-6


# ---------------------------------------------------------------- vectors


def packed(matrix: np.ndarray) -> list[bytes]:
    """Vectors of whole numbers as bytes: small ones of two bytes a component, others as doubles."""
    small = (np.abs(matrix) < 1 << 15).all(axis=1) if matrix.size else np.ones(len(matrix), bool)
    return [b"h" + v.astype("<i2").tobytes() if s else b"d" + v.astype("<f8").tobytes() for v, s in zip(matrix, small, strict=True)]


def vector(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i2" if raw[:1] == b"h" else "<f8", offset=1).astype(np.float64)


def matrix_of(raws: list[bytes]) -> np.ndarray:
    """Packed vectors as rows, shorter ones filled up with zeros."""
    if raws and all(r[:1] == b"h" and len(r) == len(raws[0]) for r in raws):
        return np.frombuffer(b"".join(r[1:] for r in raws), "<i2").reshape(len(raws), -1).astype(np.float64)
    vectors = [vector(r) for r in raws]
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of vectors of whole numbers, 64-bit integers."""
    a, b = same_width(a, b)
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = [[[int(x) for x in v] for v in m] for m in (a, b)]
    return np.array([[sum(map(int.__mul__, v, w)) for w in whole[1]] for v in whole[0]], dtype=np.int64)


def squares(a: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, a)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = same_width(a, b)
    return np.sqrt(np.maximum(squares(a)[:, None] + squares(b)[None, :] - 2.0 * (a @ b.T), 0.0))


def vectors(table: DataFrame, label: Column, scale: float = 256.0, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """ROWS of a table: rows that take part, with components floor(scale * x)."""
    usable = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = table.where(F.col(embedding).isNotNull() & usable).select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(embedding).cast("array<double>").alias("x"))

    arrow = common.arrow_schema(ROWS)

    def quantize(batches):
        for batch in batches:
            lists = batch.column(2)
            lengths = np.diff(lists.offsets.to_numpy())
            raw = np.empty(len(lengths), object)
            values = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False))
            ends = np.cumsum(lengths)
            for size in np.unique(lengths):
                at = np.flatnonzero(lengths == size)
                raw[at] = packed(values[(ends[at] - size)[:, None] + np.arange(size)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.binary())], schema=arrow)

    return rows.where("label is not null").mapInArrow(quantize, ROWS)


# ---------------------------------------------------------------- tree


@dataclass
class Node:
    """Split points; of each child its number (ranges are kept by it) and the node or leaf below."""

    points: np.ndarray
    children: list[int]
    below: list[int]  # a node, or -1 - leaf


@dataclass
class Tree:
    nodes: list[Node] = field(default_factory=list)
    paths: list[list[tuple[int, int]]] = field(default_factory=list)  # of each leaf: (node, slot) from the root down
    n_children: int = 0
    arity: int = 1
    low: np.ndarray | None = None  # distance range of (child, split point of its node)
    high: np.ndarray | None = None
    norm: np.ndarray | None = None  # range of squared norms of a child
    blocks: np.ndarray | None = None  # of each leaf

    @classmethod
    def fit(cls, sample: np.ndarray, leaf: int, arity: int, seed: int = 1) -> Tree:
        """Split points from the sample; leaves hold about `leaf` rows of it."""
        tree, rng = cls(arity=arity), np.random.default_rng(seed)
        # an explicit stack: (rows of the sample, path to them)
        tree.grow(sample, np.arange(len(sample)), [], leaf, rng)
        return tree

    def grow(self, sample, rows, path, leaf, rng) -> int:
        """The node (or -1 - leaf) over rows of the sample."""
        points = spread_points(sample[rows], self.arity, rng) if len(rows) > leaf and len(path) < 40 else []
        if len(points) < 2 and path:
            self.paths.append(path)
            return -len(self.paths)
        if len(points) < 2:  # the root has a child even so
            points = sample[rows[:1]] if len(rows) else np.zeros((1, 0))
        number, node = len(self.nodes), Node(points, list(range(self.n_children, self.n_children + len(points))), [])
        self.nodes.append(node)
        self.n_children += len(points)
        nearest = distances(sample[rows], points).argmin(axis=1) if len(rows) else np.empty(0, int)
        for slot in range(len(points)):
            part = rows[nearest == slot]
            node.below.append(self.grow(sample, part, [*path, (number, slot)], leaf if len(part) < len(rows) else len(part), rng))
        return number

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out, todo = np.empty(len(x), np.int32), [(0, np.arange(len(x)))]
        while todo:
            k, rows = todo.pop()
            if k < 0:
                out[rows] = -1 - k
            elif len(rows):
                node = self.nodes[k]
                nearest = distances(x[rows], node.points).argmin(axis=1)
                todo += [(b, rows[nearest == slot]) for slot, b in enumerate(node.below)]
        return out

    def surviving(self, x: np.ndarray, least: np.ndarray, most: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(leaf, rows of x) for which rows of the leaf can have scores from `least` to `most`."""
        own, out, todo = squares(x), [], [(0, np.arange(len(x)))]
        while todo:
            k, q = todo.pop()
            if k < 0:
                out.append((-1 - k, q))
                continue
            node = self.nodes[k]
            d = distances(x[q], node.points)
            for slot, (child, below) in enumerate(zip(node.children, node.below, strict=True)):
                n = len(node.points)
                if self.norm[child, 0] > self.norm[child, 1]:
                    continue  # a child without rows
                slack = SLACK * (np.sqrt(own[q]) + np.sqrt(self.norm[child, 1]) + np.sqrt(squares(node.points).max()) + 1)
                near = np.maximum(np.maximum(d - self.high[child, :n], self.low[child, :n] - d).max(axis=1) - slack, 0.0)
                far = (d + self.high[child, :n]).min(axis=1) + slack
                best = (own[q] + self.norm[child, 1] - near**2) / 2 + slack
                worst = (own[q] + self.norm[child, 0] - far**2) / 2 - slack
                alive = (best >= least[q]) & (worst <= most[q])
                if alive.any():
                    todo.append((below, q[alive]))
        return out


def spread_points(x: np.ndarray, arity: int, rng) -> np.ndarray:
    """Up to `arity` different rows far from each other, among some drawn ones."""
    drawn = x[rng.choice(len(x), min(len(x), 3 * arity), replace=False)]
    chosen = [0]
    away = distances(drawn, drawn[:1])[:, 0]
    while len(chosen) < arity and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, distances(drawn, drawn[chosen[-1:]])[:, 0])
    return drawn[chosen]


def index(rows: DataFrame, sample: int = 16_384, leaf_rows: int = 2_048, arity: int = 8, block: int = BLOCK) -> tuple[Tree, DataFrame]:
    """The tree over all rows, and a written table of them: ROWS, leaf, block.

    rows is a written table.  The driver gets the sample and one range for
    each split point and sibling, of which the sample bounds the number.
    """
    drawn = rows.orderBy(F.xxhash64("vec_id", "vec"), "vec_id", "vec").limit(sample).select("vec").collect()
    total = rows.count()
    share = len(drawn) / max(total, 1)
    tree = Tree.fit(matrix_of([bytes(r["vec"]) for r in drawn]), max(16, int(leaf_rows * share)), arity)
    dealt = common.materialize(rows.mapInArrow(deal(tree), f"{ROWS}, leaf int, turn long"), "leaves")
    ranges = dealt.select("vec", "leaf").mapInArrow(measure(tree), RANGES)
    found = ranges.groupBy("child", "point").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).collect()
    tree.low, tree.high = np.full((tree.n_children, tree.arity), np.inf), np.full((tree.n_children, tree.arity), -np.inf)
    tree.norm = np.array([[np.inf, -np.inf]] * tree.n_children)
    counts = np.zeros(tree.n_children, np.int64)
    for r in found:
        if r["point"] < 0:
            tree.norm[r["child"]], counts[r["child"]] = (r["low"], r["high"]), r["n"]
        else:
            tree.low[r["child"], r["point"]], tree.high[r["child"], r["point"]] = r["low"], r["high"]
    ends = [tree.nodes[path[-1][0]].children[path[-1][1]] for path in tree.paths]
    tree.blocks = np.maximum(1, -(-counts[ends] // block))
    return tree, dealt


def deal(tree: Tree):
    def run(batches):
        from pyspark import TaskContext

        turn = TaskContext.get().partitionId()
        for batch in batches:
            leaf = tree.leaves_of(matrix_of(batch.column(2).to_pylist())) if len(batch) else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32()), pa.array(np.arange(turn, turn + len(batch)), pa.int64())], names=["vec_id", "label", "vec", "leaf", "turn"])
            turn += len(batch)

    return run


def measure(tree: Tree):
    """The ranges of a task's rows: (child, split point) of distances, (child, -1) of squared norms with their number."""
    arrow = common.arrow_schema(RANGES)

    def run(batches):
        ranges: dict[tuple[int, int], list] = {}

        def widen(key, values):
            low, high, n = ranges.get(key, (np.inf, -np.inf, 0))
            ranges[key] = [min(low, float(values.min())), max(high, float(values.max())), n + len(values)]

        for batch in batches:
            if not len(batch):
                continue
            x, leaf = matrix_of(batch.column(0).to_pylist()), batch.column(1).to_numpy()
            own = squares(x)
            for k in np.unique(leaf):
                at = np.flatnonzero(leaf == k)
                for number, slot in tree.paths[k]:
                    node = tree.nodes[number]
                    child = node.children[slot]
                    widen((child, -1), own[at])
                    d = distances(x[at], node.points)
                    for p in range(d.shape[1]):
                        widen((child, p), d[:, p])
        if ranges:
            columns = zip(*((*k, *v) for k, v in ranges.items()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return run


# ---------------------------------------------------------------- searches

#: A query: an anchor and its windows; rows of the same or of other labels are wanted, `best` of each window.
PROBES = "anchor_id long, label long, vec binary, least array<long>, most array<long>"
FOUND = "anchor_id long, window int, vec_id long, score long"
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def probes(anchors: DataFrame, tree: Tree, chunks: int, home: bool) -> DataFrame:
    """PROBES with the leaf, block and chunk to be read: the anchor's own leaf only, or all that can meet a window."""
    schema = f"{PROBES}, leaf int, block int"
    arrow = common.arrow_schema(schema)

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            x = matrix_of(batch.column(2).to_pylist())
            if home:
                leaf = tree.leaves_of(x)
                pairs = [(np.arange(len(x)), leaf, np.arange(len(x)) % tree.blocks[leaf])]
            else:
                windows = [(k, lo, hi) for k, (los, his) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)) for lo, hi in zip(los, his, strict=True) if lo <= hi]
                if not windows:
                    continue
                of = np.array([k for k, _, _ in windows])
                pairs = []
                for leaf, q in tree.surviving(x[of], np.array([float(lo) for _, lo, _ in windows]), np.array([float(hi) for _, _, hi in windows])):
                    hit = np.unique(of[q])
                    for block in range(int(tree.blocks[leaf])):
                        pairs.append((hit, np.full(len(hit), leaf), np.full(len(hit), block)))
            for at, leaf, block in pairs:
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(leaf.astype(np.int32)), pa.array(block.astype(np.int32))], schema=arrow)

    return anchors.select("anchor_id", "label", "vec", "least", "most").mapInArrow(run, schema).withColumn("chunk", F.pmod(F.xxhash64("anchor_id"), F.lit(chunks)).cast("int"))


def compare(same: bool, best: int):
    """The best rows of a block in every window of every query."""
    arrow = common.arrow_schema(FOUND)

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and asked.num_rows:
            ids, label = rows.column("vec_id").combine_chunks(), rows.column("label").to_numpy()
            nameless = ids.is_null().to_numpy(zero_copy_only=False)
            vec_id = ids.fill_null(0).to_numpy(zero_copy_only=False)
            x, q = matrix_of(rows.column("vec").to_pylist()), matrix_of(asked.column("vec").to_pylist())
            alone = len(np.unique(vec_id[~nameless])) == (~nameless).sum()
            anchors, labels = asked.column("anchor_id").to_pylist(), asked.column("label").to_pylist()
            least, most = asked.column("least").to_pylist(), asked.column("most").to_pylist()
            for start in range(0, len(q), 256):
                scores = products(q[start : start + 256], x)
                for k, score in enumerate(scores, start):
                    wanted = (label == labels[k]) == same
                    wanted &= (vec_id != anchors[k]) | nameless
                    for window, (lo, hi) in enumerate(zip(least[k], most[k], strict=True)):
                        at = np.flatnonzero(wanted & (score >= lo) & (score <= hi))
                        if alone and len(at) > best:
                            at = at[score[at] >= np.partition(score[at], -best)[-best]]
                        at = at[np.lexsort((vec_id[at], nameless[at], -score[at]))]
                        taken, seen = 0, set()
                        for j in at:
                            if not nameless[j]:
                                if int(vec_id[j]) in seen:
                                    continue
                                seen.add(int(vec_id[j]))
                            out.append((anchors[k], window, None if nameless[j] else int(vec_id[j]), int(score[j])))
                            taken += 1
                            if taken == best:
                                break
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(arrow), arrow, strict=True)], schema=arrow)

    return run


def search(asked: DataFrame, tree: Tree, dealt: DataFrame, chunks: int, same: bool, best: int) -> DataFrame:
    """FOUND with `nth` from 1: the best rows of each window, among the blocks asked for."""
    blocks = F.element_at(F.lit([int(b) for b in tree.blocks]), F.col("leaf") + 1)
    rows = dealt.withColumn("block", F.pmod("turn", blocks).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    unit = ["leaf", "block", "chunk"]
    rows = rows.join(asked.select(*unit).distinct(), unit, "left_semi").select(*unit, "vec_id", "label", "vec")
    found = rows.groupBy(*unit).cogroup(asked.groupBy(*unit)).applyInArrow(compare(same, best), FOUND)
    # an id once; rows without one each for themselves
    once = found.repartition("anchor_id", "window").withColumn("each", F.when(F.col("vec_id").isNull(), F.monotonically_increasing_id()))
    once = once.groupBy("anchor_id", "window", "vec_id", "each").agg(F.max("score").alias("score"))
    order = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return once.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= best).select("anchor_id", "window", "nth", "vec_id", "score")


def twice(anchors: DataFrame, tree: Tree, dealt: DataFrame, chunks: int, same: bool, best: int) -> DataFrame:
    """The best rows of all windows: the own leaf's raise the windows' lower ends, then every leaf that is left is read."""
    first = search(probes(anchors, tree, chunks, True), tree, dealt, chunks, same, best)
    bounds = first.where(F.col("nth") == best).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("bound"))
    raised = anchors.join(bounds, "anchor_id", "left").withColumn(
        "least", F.transform("least", lambda low, k: F.greatest(low, F.coalesce(F.try_element_at("bound", k), low)))
    )
    asked = common.materialize(probes(raised, tree, chunks, False), "probes")
    return common.materialize(search(asked, tree, dealt, chunks, same, best), "found")


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, sample: int = 16_384, leaf_rows: int = 2_048, block: int = BLOCK) -> DataFrame:
    """Of ROWS: for each anchor and each of its best positives, the best rows of other labels whose scores are `least` to `most` % of the positive's.

    anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    rows = common.materialize(rows, "vectors")
    tree, dealt = index(rows, sample, leaf_rows, block=block)
    one = F.min(F.struct("label", "vec"))
    anchors = rows.where(F.col("vec_id").isNotNull() & is_anchor).groupBy(F.col("vec_id").alias("anchor_id")).agg(one.alias("a"))
    anchors = common.materialize(anchors.select("anchor_id", "a.label", "a.vec"), "anchors")
    chunks = max(1, -(-anchors.count() // CHUNK))
    whole = anchors.withColumn("least", F.array(F.lit(LOWEST))).withColumn("most", F.array(F.lit(HIGHEST)))
    near = twice(whole, tree, dealt, chunks, True, positives)
    listed = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("p"))
    # whole-number bounds of  least * positive <= 100 * negative <= most * positive
    windows = anchors.join(listed, "anchor_id").select(
        "anchor_id",
        "label",
        "vec",
        F.transform("p", lambda p: F.ceil(p["score"].cast("decimal(20,0)") * F.lit(least) / F.lit(100)).cast("long")).alias("least"),
        F.transform("p", lambda p: F.floor(p["score"].cast("decimal(20,0)") * F.lit(most) / F.lit(100)).cast("long")).alias("most"),
    )
    far = twice(common.materialize(windows, "windows"), tree, dealt, chunks, False, negatives)
    named = near.select("anchor_id", (F.col("nth") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return far.join(named, ["anchor_id", "window"]).select(
        "anchor_id", "positive_id", F.col("nth").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
