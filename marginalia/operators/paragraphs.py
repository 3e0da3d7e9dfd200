"""Paragraphs of two versions aligned and compared, protected pieces kept whole (DIF-02, JOIN-15, SCL-22, SCL-23)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import batches, markdown, protect
from ..functions.text import bound, col, normalize_whitespace, strip

ALIGNED = "array<struct<left: int, right: int, overlap: double>>"


def paragraphs(text: Column | str) -> Column:
    """Stretches between blank lines, empty ones left out."""
    return F.filter(F.split(F.coalesce(col(text), F.lit("")), r"\n\n+"), lambda p: p.rlike(r"\S"))


def alignment(left: Column | str, right: Column | str) -> Column:
    """JOIN-15: of two arrays of paragraphs, each left one with the best of the next three right ones, as ALIGNED.

    The overlap is the share of words of the right paragraph that stand in the
    left one's first line (without its mark of a heading or list), out of the
    longer of both; only more than 0.3 counts, and of equal ones the first.  A
    left paragraph with a mark also goes with the next right one if that holds
    the beginning of its line.  The cursor moves behind each partner, so pairs
    never cross.  Without a partner, right is null.
    """

    @F.pandas_udf(ALIGNED)
    def align(lefts: pd.Series, rights: pd.Series) -> pd.Series:
        from marginalia.functions.diff import alignment

        return pd.Series([alignment(list(a), list(b)) for a, b in zip(lefts, rights, strict=True)])

    return align(left, right)


def aligned(versions: DataFrame, *keep: str, old: str = "old", new: str = "new") -> DataFrame:
    """JOIN-15 as rows: keep, left, right, overlap, and the paragraphs."""
    batches.small(versions.sparkSession)
    rows = versions.select(*keep, paragraphs(old).alias("_a"), paragraphs(new).alias("_b"))
    met = rows.select(*keep, "_a", "_b", F.inline(alignment("_a", "_b")))
    return met.select(*keep, "left", "right", "overlap", F.get("_a", F.col("left")).alias("old"), F.get("_b", F.col("right")).alias("new"))


def smart(versions: DataFrame, *keep: str, old: str = "old", new: str = "new", shown: bool = False) -> DataFrame:
    """DIF-02: keep and `text`, the new version with what changed as annotations, paragraph by paragraph.

    Tables, images, anchors, references, mathematics and citations are words
    of their own and come back whole.  With `shown` the new version is as a
    word processor shows it: formulas and citations in it are recognized, and
    markdown's marks of the old version are no change.  Headings never go.
    """
    pattern = protect.WHOLE
    rows = versions.select(*keep, F.coalesce(col(old), F.lit("")).alias("_old"), F.coalesce(col(new), F.lit("")).alias("_new"))
    rows = rows.select(*keep, "_old", "_new", protect.pieces("_old", "_new", pattern=pattern).alias("_known"), protect.fence("_old", "_new").alias("_mark"))
    known, mark = F.col("_known"), F.col("_mark")
    rows = rows.select(*keep, "_known", "_mark", protect.hidden("_old", known, mark, pattern).alias("_old"), protect.hidden("_new", known, mark, pattern).alias("_new"))
    if shown:
        rows = rows.withColumn("_new", protect.math_recognized("_new", known, mark)).withColumn("_new", protect.citations_recognized("_new", known, mark))
    rows = rows.select(*keep, "_known", "_mark", paragraphs("_old").alias("_a"), paragraphs("_new").alias("_b"))
    batches.small(versions.sparkSession)
    compared = ["_a", "_b"]
    if shown:
        bare = F.transform("_a", lambda p: F.struct(markdown.prefix(p)["prefix"].alias("prefix"), F.when(p.rlike(markdown.SOME_MARK), markdown.plain(p)).otherwise(strip(p)).alias("text")))
        compared += [bare, F.transform("_b", lambda p: normalize_whitespace(p))]

    @F.pandas_udf("string")
    def compare(*sides: pd.Series) -> pd.Series:
        from marginalia.functions.diff import paragraphs_annotated

        # without other forms paragraphs are compared as they are, and go to Python once
        return pd.Series([paragraphs_annotated(*map(list, row)) for row in zip(*sides, strict=True)], dtype=object)

    made = rows.select(*keep, "_known", "_mark", compare(*compared).alias("_text"))
    return made.select(*keep, protect.shown("_text", known, mark).alias("text"))


# ---------------------------------------------------------------- tables of a document in running text


def _cells(row: Column) -> Column:
    return F.filter(F.transform(F.split(row, r"\|"), lambda c: F.trim(c)), lambda c: c != "")


def _with_table(text: Column, table: Column) -> Column:
    """DIF-03 of one table: the stretch from its first cell to the next place of its last one, out to blank lines, becomes the table."""
    rows = F.split(table, "\n")
    first, last = F.get(_cells(F.get(rows, F.lit(0))), F.lit(0)), F.try_element_at(_cells(F.try_element_at(rows, F.lit(-1))), F.lit(-1))

    def put(at: Column) -> Column:
        before, behind = F.left(text, at["start"] - 1), F.substr(text, at["end"] + F.length(last))
        # what follows the last blank line before stays out; what precedes the next one behind, too
        tail = F.length(F.call_function("substring_index", before, F.lit("\n\n"), F.lit(-1)))
        gap = F.instr(behind, "\n\n")
        rest = F.when(gap > 0, F.substr(behind, gap)).otherwise("")
        return F.concat(F.left(before, F.length(before) - tail), table, F.lit("\n\n"), rest)

    start = F.instr(text, first)
    place = F.struct(start.alias("start"), F.call_function("locate", last, text, start).alias("end"))
    return bound(place, lambda at: F.when((at["start"] > 0) & (at["end"] > 0), put(at)).otherwise(text))


def with_tables(text: Column | str, tables: Column | str) -> Column:
    """A text with the tables of an array of structs (markdown) set in, one after the other."""
    own = F.coalesce(F.transform(col(tables), lambda t: F.coalesce(t["markdown"], F.lit(""))), F.array().cast("array<string>"))
    return F.aggregate(own, F.coalesce(col(text), F.lit("")), lambda t, table: F.coalesce(_with_table(t, table), t))


def tables_set_in(texts: DataFrame, tables: DataFrame, key: str) -> DataFrame:
    """DIF-03: texts (key, text) in which flattened tables stand as markdown again; tables are (key, ord, markdown).

    Tables go in by `ord`, each into the text that the one before left; one
    whose cells are not found is left out.  A text meets all its tables at once.
    """
    lists = tables.groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_list(F.struct("ord", "markdown"))).alias("_tables"))
    met = texts.join(lists, F.col(key).eqNullSafe(F.col("_key")), "left")
    return met.select(key, F.when(F.col("text").isNotNull(), with_tables("text", "_tables")).alias("text"))
