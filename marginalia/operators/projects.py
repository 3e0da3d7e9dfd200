"""Project-level tables: authors, versions, caches, PDF remarks, lookups (SRC-17/18/25, AGG-06..10, JOIN-16..22)."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import batches

#: White space of Spark's patterns.
WHITE = re.compile(r"[ \t\n\x0b\f\r]+")


def author_shares(blame: DataFrame, file: str = "file", author: str = "author") -> DataFrame:
    """AGG-08, WIN-10: lines of each author in each file, and their share in percent."""
    n = blame.groupBy(file, author).agg(F.count("*").alias("lines"))
    total = F.sum("lines").over(Window.partitionBy(file))
    return n.withColumn("percent", F.floor(100 * F.col("lines") / total + 0.5).cast("long"))


def contributors(blame: DataFrame, file: str = "file", author: str = "author") -> DataFrame:
    """AGG-09, SRT-07."""
    return blame.groupBy(author).agg(F.count("*").alias("lines"), F.count_distinct(file).alias("files")).orderBy(F.desc("lines"), author)


def blame_lines(porcelain: DataFrame, key: str = "file", text: str = "text") -> DataFrame:
    """EXT-33: the lines of porcelain blame output with the author of their commit.

    A header starts each line's block; what a block says of its commit holds
    for later blocks of the same commit that leave it out.
    """
    rows = porcelain.select(key, F.posexplode(F.split(text, "\n")).alias("k", "t"))
    head = r"^([0-9a-f]{40}) \d+ (\d+)"
    order = Window.partitionBy(key).orderBy("k")
    rows = rows.withColumn("start", F.last(F.when(F.col("t").rlike(head), F.col("k")), ignorenulls=True).over(order)).filter("start IS NOT NULL")
    block = rows.groupBy(key, "start").agg(
        F.max(F.when(F.col("t").rlike(head), F.regexp_extract("t", head, 1))).alias("hash"),
        F.max(F.when(F.col("t").rlike(head), F.regexp_extract("t", head, 2))).cast("int").alias("line"),
        F.max(F.when(F.col("t").startswith("author "), F.substr("t", F.lit(8)))).alias("author"),
        F.max(F.when(F.col("t").startswith("\t"), F.substr("t", F.lit(2)))).alias("content"),
    )
    known = F.first("author", ignorenulls=True).over(Window.partitionBy(key, "hash").orderBy("start").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return block.withColumn("author", known).select(key, "line", "author", "hash", "content")


def log_rows(log: DataFrame, key: str, text: str = "text") -> DataFrame:
    """EXT-33: commits of a log of the form hash|date|author|message; messages may hold bars."""
    p = F.split("t", r"\|", 4)
    rows = log.select(key, F.posexplode(F.split(text, "\n")).alias("k", "t")).filter("t <> ''")
    return rows.select(key, p[0].alias("hash"), p[1].alias("date"), p[2].alias("author"), F.coalesce(F.get(p, F.lit(3)), F.lit("")).alias("message"))


def _changed_words(old: str | None, new: str | None) -> list[tuple[str | None, int]]:
    """Words that one version has more often, and by how many; no word and 0 where there is none but words are."""
    words, others = (WHITE.split(t) if t else [] for t in (old, new))
    if not any(words) and not any(others):
        return []
    n = Counter(others)
    n.subtract(words)
    return [(w, k) for w, k in n.items() if w and k] or [(None, 0)]


def word_count_diff(versions: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """AGG-10: words that went and came between two versions, as multisets.

    Words that a row has as often in both are left out where the row is read,
    so that only changed ones are moved; rows of one key are added up.
    """
    schema = T.StructType([versions.schema[key], *T.StructType.fromDDL("w string, n long").fields])
    arrow = to_arrow_schema(schema)

    def count(rows):
        for batch in rows:
            found = [_changed_words(a, b) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            at = pa.array([k for k, own in enumerate(found) for _ in own], pa.int64())
            w, n = (pa.array([x[k] for own in found for x in own], t) for k, t in ((0, pa.string()), (1, pa.int64())))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at).cast(arrow.types[0]), w, n], schema=arrow)

    batches.small(versions.sparkSession)
    change = versions.select(key, old, new).mapInArrow(count, schema).groupBy(key, "w").agg(F.sum("n").alias("n"))
    return change.groupBy(key).agg(F.sum(F.greatest("n", F.lit(0))).alias("added"), F.sum(F.greatest(-F.col("n"), F.lit(0))).alias("removed"))


def fresh(cache: DataFrame, as_of: Column, at: str = "ts", days: int = 7) -> DataFrame:
    """SRC-25: entries that are not older than the given days."""
    return cache.filter(F.col(at) >= as_of - F.expr(f"INTERVAL {days} DAYS"))


def evicted(cache: DataFrame, at: str, *tie: str, most: int = 1000, left: int = 800) -> DataFrame:
    """SRC-25: the newest entries, once there are too many; a top-k, not a sort of all in one task."""
    if cache.count() <= most:
        return cache
    return cache.orderBy(F.desc(at), *tie).limit(left)


def remark_statistics(remarks: DataFrame, *by: str) -> DataFrame:
    """AGG-06: remarks by each of the columns on its own, and in all."""
    return remarks.groupingSets([[b] for b in by] + [[]], *by).agg(F.count("*").alias("n"))


def in_quads(items: DataFrame, quads: DataFrame, page: str, width: float = 1.0) -> DataFrame:
    """SRC-17, JOIN-21: text items with the quads that their point lies in, on the same page.

    Quads are spread over the stripes that they touch, points lie in one.
    """
    spread = quads.withColumn("_s", F.explode(F.sequence(F.floor(F.col("y1") / width), F.floor(F.col("y2") / width)))).withColumnRenamed(page, "_page")
    own = items.withColumn("_stripe", F.floor(F.col("y") / width))
    hit = (F.col(page) == F.col("_page")) & (F.col("_stripe") == F.col("_s")) & F.col("x").between(F.col("x1"), F.col("x2")) & F.col("y").between(F.col("y1"), F.col("y2"))
    return own.join(spread, hit).drop("_stripe", "_s", "_page")


def remarks_appended(texts: DataFrame, remarks: DataFrame, key: str) -> DataFrame:
    """DIF-14, FLT-09: PDF remarks as comments behind a text, those without contents left out."""
    c = remarks.filter(F.trim("contents") != "").withColumn("m", F.format_string("{>>%s: [p.%s] %s<<}", F.col("author"), F.col("page").cast("string"), F.col("contents")))
    block = c.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("page", "m"))).alias("b"))
    rows = texts.join(block, key, "left")
    return rows.select(key, F.when(F.col("b").isNull(), F.col("text")).otherwise(F.concat("text", F.lit("\n\n"), F.array_join(F.transform("b", lambda x: x["m"]), "\n"))).alias("text"))


def quality_tally(found: DataFrame, column: str = "quality") -> DataFrame:
    """AGG-17: how many anchors of each quality, with zeros."""
    every = found.sparkSession.createDataFrame([("clean",), ("drift",), ("context-only",), ("ambiguous",), ("unmatched",)], f"{column} string")
    return every.join(found.groupBy(column).agg(F.count("*").alias("n")), column, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def newest(files: DataFrame, *key: str, at: str = "modified") -> DataFrame:
    """SRT-05."""
    return files.groupBy(*key).agg(F.max_by("path", at).alias("path"), F.max(at).alias("modified"))


def only_reviewer(comments: DataFrame, *key: str) -> DataFrame:
    """AGG-21: documents whose comments are all of one known author."""
    who = F.collect_set(F.when(F.col("author") != "Unknown", F.col("author")))
    return comments.groupBy(*key).agg(who.alias("w")).filter(F.size("w") == 1).select(*key, F.col("w")[0].alias("author"))


def changed_files(old: DataFrame, new: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """JOIN-22: files added, deleted, modified or left between two versions."""
    both = old.select(file, F.col(text).alias("a"), F.lit(True).alias("in_a")).join(new.select(file, F.col(text).alias("b"), F.lit(True).alias("in_b")), file, "full")
    status = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "deleted").when(~F.col("a").eqNullSafe(F.col("b")), "modified").otherwise("unchanged")
    return both.select(file, status.alias("status"))


def history(states: DataFrame, *key: str, order: str = "seq", most: int = 10) -> DataFrame:
    """WIN-12: the last states of each document."""
    return states.withColumn("back", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).filter(F.col("back") <= most)


#: What a build leaves beside the sources, by the title's short form or `paper`.
OUTPUTS = (".docx", "_comments.docx", "-changes.docx")


def without_outputs(files: DataFrame, titles: DataFrame, key: str) -> DataFrame:
    """FLT-10: files (key, path) that are no build output of their project (key, title); a project without a title keeps all."""
    slug = F.left(F.regexp_replace(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", "-"), "^-|-$", ""), F.lit(50))
    own = titles.filter(F.coalesce(F.col("title"), F.lit("")) != "").select(F.col(key).alias("_key"), slug.alias("_slug")).filter("_slug <> ''").groupBy("_key").agg(F.min("_slug").alias("_slug"))
    base = F.lower(F.regexp_extract("path", r"[^/\\]*$", 0))
    names = [F.concat(stem, F.lit(end)) for stem in (F.col("_slug"), F.lit("paper")) for end in OUTPUTS]
    return files.join(own, F.col(key).eqNullSafe(F.col("_key")), "left").filter(F.col("_slug").isNull() | ~base.isin(*names)).select(*files.columns)
