"""Diffs, three-way merges and comment placement over tables of texts (DIF-01..04, 09, 11, SCL-02)."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import batches as sizes
from ..functions import diff
from ..functions.text import chain
from . import merging

CHANGES = "array<struct<type:string,start:int,end:int,old_text:string,new_text:string>>"


def changes(versions: DataFrame, *keep: str, old: str = "old", new: str = "new", by: str = "word") -> DataFrame:
    """DIF-04: one row per change between two versions of a text."""

    @F.pandas_udf(CHANGES)
    def find(a: pd.Series, b: pd.Series) -> pd.Series:
        from marginalia.functions.diff import changes

        return pd.Series([changes(x or "", y or "", by) for x, y in zip(a, b, strict=True)])

    sizes.small(versions.sparkSession)
    rows = versions.select(*keep, F.posexplode(find(old, new)).alias("seq", "c"))
    return rows.select(*keep, "seq", "c.*")


def _over(df: DataFrame, function, *columns: str):
    @F.pandas_udf("string")
    def apply(*series: pd.Series) -> pd.Series:
        return pd.Series([function(*[v or "" for v in row]) for row in zip(*series, strict=True)], dtype=object)

    sizes.small(df.sparkSession)
    return apply(*columns)


def annotated(versions: DataFrame, *keep: str, old: str = "old", new: str = "new") -> DataFrame:
    """DIF-01."""
    return versions.select(*keep, _over(versions, diff.annotated, old, new).alias("text"))


def single_spaced(docs: DataFrame, *keep: str) -> DataFrame:
    """SCL-02."""
    return docs.select(*keep, _over(docs, diff.single_spaced, "text").alias("text"))


def merged(base: DataFrame, reviews: DataFrame, key: str, by: str = "word") -> tuple[DataFrame, DataFrame]:
    """DIF-09: base texts with all changes that are not in conflict as annotations, and the conflicts.

    reviews: key, reviewer, reviewer_ord, text.
    """
    pairs = reviews.join(base.select(key, F.col("text").alias("_base")), key)
    found = changes(pairs, key, "reviewer", "reviewer_ord", old="_base", new="text", by=by)
    grouped = merging.conflicts(found.select(key, "reviewer", "reviewer_ord", F.col("seq").cast("long").alias("seq"), "type", "start", "end", "old_text", "new_text"), key)
    free = merging.deduplicated(grouped.filter("conflict IS NULL"), key)
    return merging.applied(base, free, key, annotate=True), merging.conflict_summary(grouped, key)


PLACED = "text string, report array<struct<id:string,strategy:string,pos:int>>"


def placed(texts: DataFrame, comments: DataFrame, key: str) -> DataFrame:
    """DIF-11: texts with their comments set in; a document's comments are what a task holds of it.

    comments: key, ord, id, author, text, anchor, before, after, position,
    parent.  Null keys meet null keys.  Keys stay in Arrow, so that large ones
    come through whole beside nulls.
    """
    names = ("ord", "id", "author", "text", "anchor", "before", "after", "position", "parent")
    own = comments.groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_list(F.struct(*names))).alias("_c"))
    rows = texts.select(key, "text").join(own, F.col(key).eqNullSafe(F.col("_key")), "left")
    return placed_lists(rows, key, "_c")


def placed_lists(texts: DataFrame, key: str, comments: str) -> DataFrame:
    """DIF-11 for texts (key, text) that have their comments beside them, as a sorted array."""
    rows = texts.select(key, "text", comments)
    schema = T.StructType([rows.schema[0], *T.StructType.fromDDL(PLACED).fields])
    arrow = to_arrow_schema(schema)

    def put(batches):
        from marginalia.functions.diff import placed

        for batch in batches:
            got = [placed(t or "", c or []) for t, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], arrow.field(1).type), pa.array([g[1] for g in got], arrow.field(2).type)], schema=arrow)

    sizes.small(rows.sparkSession)
    return rows.mapInArrow(put, schema)


def realigned(texts: DataFrame, comments: DataFrame, key: str, authors: list[str] | None = None) -> DataFrame:
    """DIF-13: the comments that stand in the texts go, those of the reviewed version are set in anew.

    With `authors`, only these people's comments are set in.
    """
    bare = texts.select(key, chain("text", (r"\s*\{>>[\s\S]+?<<\}", "")).alias("text"))
    return placed(bare, comments if authors is None else comments.filter(F.col("author").isin(authors)), key)
