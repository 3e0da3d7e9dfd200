"""Annotations as rows (EXT-01..05, AGG-01, SRT-01, SCL-37)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markup

#: Characters of a line kept around an annotation.
CONTEXT = 50


def annotations(docs: DataFrame, *keep: str, false_comments: bool = False) -> DataFrame:
    """One row per annotation of each text: kept columns, kind, kind_rank, pos, match, content, replacement, author, line, before, after.

    The kinds are looked for independently, so nested markup gives overlapping
    rows.  Comments that are none are left out unless asked for.
    """
    found = []
    for kind, pattern in markup.KINDS.items():
        groups = 2 if kind == "substitute" else 1
        rows = docs.select(*keep, "text", F.explode(markup.matches("text", pattern, groups)).alias("a"))
        if kind == "comment" and not false_comments:
            rows = rows.filter(~markup.is_false_comment("a.g1", "text", "a.pos"))
        content = F.col("a.g1")
        author = markup.author_of(content) if kind == "comment" else F.lit(None).cast("string")
        before, after = F.substr("text", F.lit(1), F.col("a.pos")), F.substr("text", F.col("a.pos") + F.length("a.match") + 1)
        found.append(
            rows.select(
                *keep,
                F.lit(kind).alias("kind"),
                F.lit(markup.RANKS[kind]).alias("kind_rank"),
                F.col("a.pos").alias("pos"),
                F.col("a.match").alias("match"),
                (markup.said(content) if kind == "comment" else content).alias("content"),
                (F.col("a.g2") if kind == "substitute" else F.lit(None).cast("string")).alias("replacement"),
                author.alias("author"),
                (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).alias("line"),
                F.right(F.substring_index(before, "\n", -1), F.lit(CONTEXT)).alias("before"),
                F.left(F.substring_index(after, "\n", 1), F.lit(CONTEXT)).alias("after"),
            )
        )
    return reduce(DataFrame.unionByName, found)


def track_changes(found: DataFrame) -> DataFrame:
    """EXT-04."""
    return found.filter("kind <> 'comment'")


def comments(found: DataFrame) -> DataFrame:
    """EXT-05: comments with their status."""
    own = found.filter("kind = 'comment'")
    return own.withColumn("resolved", markup.is_resolved("content")).withColumn("content", markup.without_status("content"))


def counts(docs: DataFrame, *keep: str) -> DataFrame:
    """AGG-01: annotations of each kind in each text, without making rows of them."""
    n = {k: F.size(markup.all_of("text", p)) for k, p in markup.KINDS.items() if k != "comment"}
    real = F.size(F.filter(markup.matches("text", markup.COMMENT, 1), lambda a: ~markup.is_false_comment(a["g1"], "text", a["pos"])))
    out = docs.select(*keep, n["insert"].alias("inserts"), n["delete"].alias("deletes"), n["substitute"].alias("substitutes"), real.alias("comments"))
    return out.withColumn("total", F.col("inserts") + F.col("deletes") + F.col("substitutes") + F.col("comments"))


def numbered(found: DataFrame, *key: str) -> DataFrame:
    """WIN-02: number of a comment within its file."""
    return found.withColumn("number", F.row_number().over(Window.partitionBy(*key).orderBy("pos")))


def neighbours(found: DataFrame, *key: str) -> DataFrame:
    """WIN-03: pending comments with their rank from both ends and the next and previous one."""
    w = Window.partitionBy(*key).orderBy("pos")
    own = found.filter("NOT resolved")
    return own.select(
        *own.columns,
        F.row_number().over(w).alias("nth"),
        F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("pos"))).alias("nth_last"),
        F.lead("pos").over(w).alias("next_pos"),
        F.lag("pos").over(w).alias("prev_pos"),
    )


def placeholders(found: DataFrame, *key: str) -> DataFrame:
    """SCL-37: {{TC_n}} ids, kind by kind and then by place."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy("kind_rank", "pos")) - 1
    return found.withColumn("placeholder", F.concat(F.lit("{{TC_"), n.cast("string"), F.lit("}}")))
