"""Changes of several reviewers: overlap, conflicts, application (DIF-04..10, JOIN-12, SET-04)."""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Width of the buckets by which changes are compared.
WIDTH = 256
#: A place that is neither before nor behind any other.
NOWHERE = float("nan")
CHANGE = "reviewer string, type string, start int, end int, old_text string, new_text string"


def overlap(a: str, b: str) -> Column:
    """DIF-06: whether two changes (struct columns) are in conflict."""
    x, y = F.col(a), F.col(b)
    same_place = (x["type"] == "insert") & (y["type"] == "insert") & (x["start"] == y["start"])
    x_end = F.when(x["type"] == "insert", x["start"]).otherwise(x["end"])
    y_end = F.when(y["type"] == "insert", y["start"]).otherwise(y["end"])
    apart = (x_end <= y["start"]) | (y_end <= x["start"])
    same = (x["type"] == y["type"]) & x["old_text"].eqNullSafe(y["old_text"]) & x["new_text"].eqNullSafe(y["new_text"])
    return F.when(same_place, ~x["new_text"].eqNullSafe(y["new_text"])).otherwise(~apart & ~same)


def overlapping_pairs(changes: DataFrame, key: str, change_id: str) -> DataFrame:
    """JOIN-12: pairs of changes of one document that are in conflict, each once.

    Changes are spread over the buckets they touch, so that only those near
    each other meet; a pair is taken in the first bucket that both touch.
    """
    c = changes.select(key, change_id, F.struct("type", "start", "end", "old_text", "new_text").alias("c"))
    c = c.withColumn("_first", F.floor(F.col("c.start") / WIDTH))
    c = c.withColumn("_b", F.explode(F.sequence("_first", F.floor(F.greatest("c.end", "c.start") / WIDTH))))
    a, b = c.select(key, F.col(change_id).alias("a_id"), F.col("c").alias("a"), F.col("_first").alias("_fa"), "_b"), c.select(key, F.col(change_id).alias("b_id"), F.col("c").alias("b"), F.col("_first").alias("_fb"), "_b")
    pairs = a.join(b, [key, "_b"]).filter((F.col("a_id") < F.col("b_id")) & (F.col("_b") == F.greatest("_fa", "_fb")))
    return pairs.filter(overlap("a", "b")).select(key, "a_id", "b_id")


class _Leader:
    """A change that no earlier one has taken, with those it has taken."""

    __slots__ = ("closed", "end", "members", "new", "number", "old", "reach", "row", "start", "type")

    def __init__(self, row, type_, start, end, old, new):
        self.row, self.type, self.start, self.end, self.old, self.new = row, type_, start, end, old, new
        # an insertion has no width: nothing that starts later can touch it
        self.reach = start if type_ == "insert" else end
        self.members, self.number, self.closed = 1, None, False


class _Grouping:
    """The greedy conflicts of one document, whose changes come in order; what is open is all that is kept."""

    def __init__(self):
        self.open: list[_Leader] = []
        self.unsettled: deque[_Leader] = deque()
        self.n = 0

    def taken(self, row: int, type_, start, end, old, new) -> tuple[_Leader, int]:
        """The leader of the next change, and the change's place behind it."""
        expired = again = False
        found = None
        for one in self.open:
            if start > one.reach:
                one.closed = expired = True
                continue
            if one.type == "insert" and type_ == "insert" and one.start == start:
                if one.new != new:
                    found = one
                    break
                again = True
                continue
            if one.reach <= start or (start if type_ == "insert" else end) <= one.start:
                continue
            if one.type == type_ and one.old == old and one.new == new:
                again = again or (one.start == start and one.end == end)
                continue
            found = one
            break
        if expired:
            self.open = [one for one in self.open if not one.closed]
        if found is not None:
            found.members += 1
            return found, found.members - 1
        own = _Leader(row, type_, start, end, old, new)
        # what is in conflict with one of several equal changes goes to the first of them
        own.closed = again
        if not again:
            self.open.append(own)
        self.unsettled.append(own)
        return own, 0

    def settle(self, ended: bool) -> int | None:
        """Number the conflicts whose turn is known; the first row that still waits."""
        waiting = self.unsettled
        while waiting and (ended or waiting[0].closed or waiting[0].members > 1):
            one = waiting.popleft()
            if one.members > 1:
                self.n += 1
                one.number = f"c{self.n}"
        return waiting[0].row if waiting else None


def _values(column: pa.Array) -> list:
    """A column as Python values, each different one made once."""
    if pa.types.is_nested(column.type):
        return column.to_pylist()
    d = column.dictionary_encode()
    values = [*d.dictionary.to_pylist(), None]  # the last one for nulls
    return [values[k] for k in d.indices.fill_null(-1).to_numpy().tolist()]


def conflicts(changes: DataFrame, key: str) -> DataFrame:
    """DIF-05: each change with the conflict it belongs to (null: none) and its place in it.

    Greedy in the order of start, end, reviewer, sequence and texts: a change takes
    the later ones that conflict with it and are not taken yet; it is not a
    transitive closure.  Tasks read sorted changes of many documents and keep
    only what later changes can still touch.
    """
    schema = T.StructType([*changes.schema.fields, T.StructField("conflict", T.StringType()), T.StructField("place", T.IntegerType())])
    arrow = to_arrow_schema(schema)
    names = (key, "type", "start", "end", "old_text", "new_text")

    def group(batches):
        last, state, at = None, None, 0
        held: deque = deque()  # (batch, number of its first row, leaders, places)

        def ready(first):
            while held and (first is None or held[0][1] + held[0][0].num_rows <= first):
                batch, _, leaders, places = held.popleft()
                made = [pa.array([one.number for one in leaders], pa.string()), pa.array(places, pa.int32())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], schema=arrow)

        for batch in batches:
            leaders, places = [], []
            held.append((batch, at, leaders, places))
            for k, type_, start, end, old, new in zip(*(_values(batch.column(batch.schema.get_field_index(n))) for n in names), strict=True):
                if state is None or k != last:
                    if state is not None:
                        state.settle(True)
                    last, state = k, _Grouping()
                # what has no place is in conflict with all that it is not equal to
                one, place = state.taken(at, type_, NOWHERE if start is None else start, NOWHERE if end is None else end, old, new)
                leaders.append(one)
                places.append(place)
                at += 1
            if state is not None:
                yield from ready(state.settle(False))
        if state is not None:
            state.settle(True)
        yield from ready(None)

    n = int(changes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c).asc_nulls_last() for c in (key, "start", "end", "reviewer_ord", "seq", "type", "old_text", "new_text")]
    return changes.repartition(n, key).sortWithinPartitions(*order).mapInArrow(group, schema)


def stored(found: DataFrame, *columns: str) -> DataFrame:
    """Columns of the changes that are in conflict, written once for all that is read of them."""
    from ..streaming.watch import shared_folder

    spark = found.sparkSession
    own = found.filter("conflict IS NOT NULL").select(*columns)
    folder = f"{shared_folder(spark)}/conflicts"
    own.write.parquet(folder)
    return spark.read.schema(own.schema).parquet(folder)


def deduplicated(free: DataFrame, key: str) -> DataFrame:
    """SET-04: of equal changes without a conflict, that of the first reviewer."""
    w = Window.partitionBy(key, "start", "end", "type", "new_text").orderBy("reviewer_ord", "seq")
    return free.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def conflict_summary(found: DataFrame, key: str) -> DataFrame:
    """DIF-05: one row per conflict: its range, its changes and both simple resolutions (DIF-08)."""
    own = found.filter("conflict IS NOT NULL")
    return own.groupBy(key, "conflict").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.count("*").alias("changes"),
        F.min_by("new_text", "place").alias("first_text"),
        F.max_by("new_text", "place").alias("latest_text"),
    )


def resolved(found: DataFrame, choices: DataFrame, key: str) -> DataFrame:
    """DIF-08: of each conflict that has a choice (key, conflict, choice from 0) the change with that number, with whom it is resolved by.

    A choice that the conflict does not have gives a row with an error.
    """
    own = found.filter("conflict IS NOT NULL").withColumnRenamed("conflict", "_own")
    # equal choices stay as many rows as they are
    asked = choices.groupBy(F.col(key).alias("_key"), F.col("conflict").alias("_conflict"), "choice").agg(F.count("*").alias("_times"))
    row = F.struct("reviewer", "type", "start", "end", "old_text", "new_text")
    met = asked.join(own, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_own") == F.col("_conflict")))
    one = met.groupBy("_key", "_conflict", "choice", "_times").agg(F.count("*").alias("changes"), F.max(F.when(F.col("place") == F.col("choice"), row)).alias("_row"))
    bad = (F.col("choice") < 0) | (F.col("choice") >= F.col("changes")) | F.col("choice").isNull()
    each = one.withColumn("_each", F.explode(F.array_repeat(F.lit(0), F.col("_times").cast("int"))))
    return each.select(
        F.col("_key").alias(key), F.col("_conflict").alias("conflict"), "choice", "_row.*",
        F.when(bad, F.concat(F.lit("no such choice, there are "), "changes")).alias("error"),
    )


def unresolved(found: DataFrame, choices: DataFrame, key: str) -> DataFrame:
    """DIF-08: conflicts without a valid choice."""
    every = found.filter("conflict IS NOT NULL").groupBy(key, "conflict").agg(F.count("*").alias("changes"))
    asked = choices.select(F.col(key).alias("_key"), F.col("conflict").alias("_conflict"), "choice")
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("conflict") == F.col("_conflict"))
    return every.join(asked, same & (F.col("choice") >= 0) & (F.col("choice") < F.col("changes")), "left_anti").select(key, "conflict")


def applied(texts: DataFrame, changes: DataFrame, key: str, annotate: bool = False) -> DataFrame:
    """DIF-07: texts with changes that do not touch each other, as they are or as annotations.

    The pieces between the changes and the new texts are put together in one
    fold from the left, so that no offset has to move.
    """
    c = F.array_sort(F.collect_list(F.struct("start", "end", "type", F.coalesce("old_text", F.lit("")).alias("old"), F.coalesce("new_text", F.lit("")).alias("new"))))
    rows = texts.join(changes.groupBy(key).agg(c.alias("c")), key, "left")

    def new(x: Column) -> Column:
        if not annotate:
            return F.when(x["type"] == "delete", "").otherwise(x["new"])
        return F.when(x["type"] == "insert", F.concat(F.lit("{++"), x["new"], F.lit("++}"))).when(x["type"] == "delete", F.concat(F.lit("{--"), x["old"], F.lit("--}"))).otherwise(F.concat(F.lit("{~~"), x["old"], F.lit("~>"), x["new"], F.lit("~~}")))

    def step(s: Column, x: Column) -> Column:
        end = F.when(x["type"] == "insert", x["start"]).otherwise(x["end"])
        return F.struct(F.concat(s["out"], F.substr("text", s["at"] + 1, F.greatest(x["start"] - s["at"], F.lit(0))), new(x)).alias("out"), end.cast("int").alias("at"))

    state = F.aggregate("c", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step)
    whole = F.concat(state["out"], F.substr("text", state["at"] + 1))
    return rows.select(key, F.when(F.col("c").isNull(), F.col("text")).otherwise(whole).alias("text"))


def statistics(found: DataFrame, key: str) -> DataFrame:
    """AGG-16: reviewers, changes, conflicts of each document; a conflict has one change at place 0."""
    return found.groupBy(key).agg(
        F.count_distinct("reviewer").alias("reviewers"),
        F.count("*").alias("changes"),
        F.count_if(F.col("conflict").isNull()).alias("free"),
        F.count_if(F.col("conflict").isNotNull() & (F.col("place") == 0)).alias("conflicts"),
    )
