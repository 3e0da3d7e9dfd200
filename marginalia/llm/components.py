"""Connected components of large edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """id, root: the least id of each component, for all ids in the edges (a, b).

    In each round every id takes the least root among its own and its
    neighbours' and then the root of that root, so that the paths halve.
    Minima are combined before they are moved, so that no id's neighbours
    meet in one task.  Each round is a table in the shared folder, which replaces
that of the round before; the result is the last one (id, before, root).
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = common.materialize(both, "edges")
    roots = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("n")).select("id", F.least("id", "n").alias("root"))
    roots = common.materialize(roots, "roots")
    for _ in range(most_rounds):
        near = both.join(roots.select(F.col("id").alias("b"), "root").hint("merge"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        step = roots.join(near, "id", "left").select("id", F.col("root").alias("before"), F.least("root", F.coalesce("near", "root")).alias("r"))
        up = roots.select(F.col("id").alias("r"), F.col("root").alias("up"))
        new = common.materialize(step.join(up.hint("merge"), "r", "left").select("id", "before", F.least("r", F.coalesce("up", "r")).alias("root")), "roots")
        changed = new.filter("before <> root").limit(1).count()
        common.discard(roots)
        roots = new
        if not changed:
            common.discard(both)
            return roots
    raise RuntimeError("components did not settle")
