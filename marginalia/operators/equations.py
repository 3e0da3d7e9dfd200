"""Equations in texts (EXT-14, AGG-04)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from .lines import is_fence, lines

#: Fixed value: inline mathematics.
INLINE = r"(?<![$\\])\$(?!\$)([^$\n]+)\$(?!\$)"


def equations(docs: DataFrame, *keep: str) -> DataFrame:
    """One row per equation: kept columns, kind (inline, display), content, line.

    Lines with $$ open, close or hold display mathematics; a window over the
    lines knows which.  A line with two $$ or more holds its own when no
    display is open; otherwise every line with $$ toggles.  Blank lines and
    fence lines are skipped, also inside display mathematics.
    """
    rows = lines(docs, *keep).filter((F.col("line_text") != "") & ~is_fence(F.col("line_text")))
    parts = F.split("line_text", r"\$\$", -1)
    rows = rows.withColumn("parts", parts).withColumn("n", F.size("parts") - 1)
    order = Window.partitionBy(*keep).orderBy("line")
    # a line with one $$ always toggles; one with more toggles only when open, which it then closes
    fold = F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("open", F.coalesce(fold, F.lit(0)) % 2 == 1)
    inline_of = (
        F.when(F.col("n") == 0, F.when(F.col("open"), F.lit("")).otherwise(F.col("line_text")))
        .when(F.col("open"), F.col("parts")[1])
        .when(F.col("n") == 1, F.col("parts")[0])
        .otherwise(F.concat(F.col("parts")[0], F.lit("\n"), F.when(F.col("n") % 2 == 0, F.element_at("parts", -1)).otherwise("")))
    )
    inline = rows.select(*keep, "line", F.explode(F.regexp_extract_all(inline_of, F.lit(INLINE), F.lit(1))).alias("content"))
    inline = inline.select(*keep, F.lit("inline").alias("kind"), strip("content").alias("content"), "line")
    odd = F.filter("parts", lambda p, k: k % 2 == 1)
    single = rows.filter("NOT open AND n >= 2").select(*keep, "line", F.explode(odd).alias("content"))
    single = single.select(*keep, F.lit("display").alias("kind"), strip("content").alias("content"), "line").filter("content <> ''")
    # blocks: the lines from an opening one to the one that closes it
    starts = F.when((F.col("n") == 1) & ~F.col("open"), F.col("line"))
    block = rows.withColumn("start", F.last(starts, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = block.filter(F.col("start").isNotNull() & ((F.col("start") == F.col("line")) | F.col("open")))
    piece = F.when(F.col("line") == F.col("start"), F.col("parts")[1]).when(F.col("n") >= 1, F.col("parts")[0]).otherwise(F.col("line_text"))
    whole = inside.select(*keep, "start", "line", "n", piece.alias("t")).groupBy(*keep, "start").agg(F.array_sort(F.collect_list(F.struct("line", "t"))).alias("p"), F.count_if(F.col("n") >= 1).alias("marks"))
    display = whole.filter("marks >= 2").select(*keep, F.lit("display").alias("kind"), strip(F.array_join(F.transform("p", lambda x: x["t"]), "\n")).alias("content"), F.col("start").alias("line"))
    return inline.unionByName(single).unionByName(display.filter("content <> ''"))


def statistics(found: DataFrame, file: str) -> DataFrame:
    """AGG-04: equations of each file, and of all files in a row without one."""
    return found.rollup(file).agg(F.count("*").alias("total"), F.count_if(F.col("kind") == "display").alias("display"), F.count_if(F.col("kind") == "inline").alias("inline"))
