"""Texts as lines: the base of the line-oriented operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip


def lines(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """One row per line: the kept columns, line (from 1) and its text."""
    return docs.select(*keep, F.posexplode(F.split(text, "\n")).alias("_k", "line_text")).select(*keep, (F.col("_k") + 1).alias("line"), "line_text")


def state_before(toggles: Column, *key: str) -> Column:
    """WIN-06: whether an odd number of toggles stands before a line."""
    before = Window.partitionBy(*key).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(toggles.cast("int")).over(before), F.lit(0)) % 2 == 1


def is_fence(line: Column) -> Column:
    return strip(line).startswith("```")


def search(docs: DataFrame, pattern: str, *keep: str, ignore_case: bool = False) -> DataFrame:
    """EXT-29: the lines that a pattern matches; a pattern that is none is taken literally."""
    import re

    try:
        re.compile(pattern)
    except re.error:
        pattern = re.escape(pattern)
    found = F.col("line_text").rlike(("(?i)" if ignore_case else "") + pattern)
    return lines(docs, *keep).filter(found)
