"""Hard negatives against all pairs, the tree's bounds, and odd tables."""

import math
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import negatives, queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, positives=5, best=10, least=30, most=90, every=100):
    """All pairs in whole numbers; rows are (vec_id, label, components)."""

    def score(a, b):
        return sum(x * y for x, y in zip(a, b))

    anchors = {}
    for vec_id, label, v in rows:
        if vec_id is not None and vec_id % every == 0:
            anchors[vec_id] = min(anchors.get(vec_id, (label, v)), (label, v), key=lambda a: (a[0], negatives.packed(np.array([a[1]], float))[0] if a[1] else b"h"))
    out = []
    for anchor, (own, a) in anchors.items():
        scored = {True: [], False: []}
        once = set()
        for vec_id, label, v in rows:
            s = score(a, v)
            if vec_id == anchor or (vec_id, label == own, s) in once:
                continue
            if vec_id is not None:
                once.add((vec_id, label == own, s))
            scored[label == own].append((-s, vec_id is None, vec_id or 0))
        scored = {k: sorted(v) for k, v in scored.items()}

        def distinct(found, n):
            taken, seen = [], set()
            for s, nameless, vec_id in found:
                if nameless or vec_id not in seen:
                    seen.add(None if nameless else vec_id)
                    taken.append((None if nameless else vec_id, -s))
            return taken[:n]

        for positive, ps in distinct(scored[True], positives):
            fit = [f for f in scored[False] if least * ps <= 100 * -f[0] <= most * ps]
            out += [(anchor, positive, k, vec_id, ps, s) for k, (vec_id, s) in enumerate(distinct(fit, best), 1)]
    return Counter(out)


def whole(rows):
    """Usable rows with whole-number components."""
    out = []
    for vec_id, v, label in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            out.append((vec_id, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    return out


def mined(spark, rows, **kw):
    table = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumn("vec", F.lit("x")).withColumn("leaf", F.lit(1)).withColumn("score", F.lit(0))
    every = kw.pop("every", 100)
    return Counter(map(tuple, negatives.mine(negatives.vectors(table, F.col("label")), F.col("vec_id") % every == 0, **kw).collect()))


def test_same_as_sql(spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{data}/embeddings.parquet'")
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = queries.op13_hard_negatives(spark, data)
    assert got.columns == names
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(queries.OP13_SQL).fetchall())


def test_clusters_copies_and_ties(spark):
    """Clustered rows, a third of them copies of one, in small leaves and blocks."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 5))
    rows = []
    for k in range(500):
        v = centres[k % 6] + 0.2 * rng.normal(size=5) if k % 3 else centres[0]
        rows.append((k, [float(x) for x in v], k % 4))
    assert mined(spark, rows, every=10, leaf_rows=20, block=16, sample=200) == brute(whole(rows), every=10)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.4], 1), (2, [0.4, 0.4], 2), (3, None, 2), (4, [1.0, None], 2), (5, [nan, 1.0], 2), (6, [inf, 1.0], 2), (7, [0.4, 0.4], None)]
    rows += [(8, [], 2), (9, [0.5], 3), (10, [0.5, 0.1, 9.0], 3), (None, [0.4, 0.4], 2), (None, [0.4, 0.4], 2), (None, [0.9, 0.5], 1), (2, [0.4, 0.4], 2), (2, [0.3, 0.4], 2)]
    rows += [(0, [1.0, 0.6], 1), (0, [1.0, 0.5], 1), (-100, [-1.0, -0.5], 1), (100, [0.0, 0.0], 3), (200, [300.0, 200.0], 2), (11, [200.0, 300.0], 2), (12, [100.0, 90.0], 4)]
    got = mined(spark, rows, leaf_rows=2, block=3)
    assert got == brute(whole(rows)) and got
    assert mined(spark, rows[:2]) == Counter()  # no other label
    assert mined(spark, rows[:0]) == Counter()


def test_scores_beyond_doubles(spark):
    rows = [(0, [3.0e6, 1.0], 1), (1, [2.0e6, 5.0], 1), (2, [1.0e6, 3.0], 2), (3, [1.0e6, 3.5], 2)]
    assert mined(spark, rows) == brute(whole(rows))


def test_tree_keeps_what_can_meet_the_window(spark):
    """Every row with a score in the window lies in a surviving leaf, and clusters do drop leaves."""
    rng = np.random.default_rng(5)
    x = np.floor(256 * np.concatenate([rng.normal(c, 0.05, size=(300, 4)) for c in (-2, 0, 2, 5)]))
    rows = spark.createDataFrame([(k, k % 3, negatives.packed(x[k : k + 1])[0]) for k in range(len(x))], "vec_id long, label long, vec binary")
    tree, dealt = negatives.index(rows, sample=400, leaf_rows=40)
    leaf_of = {r["vec_id"]: r["leaf"] for r in dealt.collect()}
    assert len(set(leaf_of.values())) > 10
    score = negatives.products(x, x)
    kept = defaultdict(set)
    least, most = np.sort(score, axis=1)[:, -40].astype(float), np.sort(score, axis=1)[:, -10].astype(float)
    for leaf, q in tree.surviving(x, least, most):
        for k in q:
            kept[k].add(leaf)
    for k in range(len(x)):
        assert {leaf_of[j] for j in np.flatnonzero((score[k] >= least[k]) & (score[k] <= most[k]))} <= kept[k]
    assert np.mean([len(v) for v in kept.values()]) < 0.7 * len(tree.paths)
