"""Sections, headings and boundaries (EXT-18..22, WIN-05/07, JOIN-11/13/14, DIF-15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chain, strip, words
from .lines import lines

MARKER = r"<!--\s*@section:\s*(\S+)\s*-->"
HEADING = r"^#{1,6}\s+(.+)$"


def headings(docs: DataFrame, *keep: str) -> DataFrame:
    """EXT-21, SRC-08: one row per heading: kept columns, line, level, title."""
    rows = lines(docs, *keep).filter(F.col("line_text").rlike(r"^#+\s+.+$"))
    return rows.select(*keep, "line", F.length(F.regexp_extract("line_text", "^(#+)", 1)).alias("level"), strip(F.regexp_extract("line_text", r"^#+\s+(.+)$", 1)).alias("title"))


def matched(titles: DataFrame, config: DataFrame, title: str = "title") -> DataFrame:
    """JOIN-14: headings with the first section whose header, alias or 70 % of header words they have.

    config: file, header, aliases, ord; a table of the project's sections.
    """
    t = strip(F.lower(chain(title, (r"^#{1,6}\s+", ""))))
    own = titles.select(title).distinct().select(title, t.alias("_t"))
    names = F.array_append(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: strip(F.lower(a))), strip(F.lower("header")))
    same = own.join(config.select("file", "ord", F.explode(names).alias("_t")), "_t").select(title, "file", "ord")
    # shared words, counted: each word of the header that the title has
    words_of = config.select("file", "ord", "header").distinct().select("file", "ord", "header", F.split(F.lower("header"), r"\s+").alias("_w")).select("file", "ord", "header", F.size("_w").alias("_n"), F.explode("_w").alias("_word"))
    has = own.select(title, F.explode(F.array_distinct(F.split("_t", r"\s+"))).alias("_word"))
    near = has.join(words_of, "_word").groupBy(title, "file", "ord", "header", "_n").count().filter(F.col("count") >= F.col("_n") * 0.7).select(title, "file", "ord")
    best = same.unionByName(near).groupBy(title).agg(F.min_by("file", "ord").alias("file"))
    return titles.join(best, title, "left")


def split_by_markers(docs: DataFrame, *keep: str) -> DataFrame:
    """EXT-19, WIN-07: the text under each section marker; of repeated files the last holds."""
    order = Window.partitionBy(*keep).orderBy("line")
    rows = lines(docs, *keep).withColumn("file", F.regexp_extract("line_text", MARKER, 1))
    rows = rows.withColumn("file", F.nullif("file", F.lit("")))
    start = F.last(F.when(F.col("file").isNotNull(), F.col("line")), ignorenulls=True).over(order)
    rows = rows.withColumn("start", start).withColumn("section", F.last("file", ignorenulls=True).over(order)).filter("section IS NOT NULL AND file IS NULL")
    text = rows.groupBy(*keep, "section", "start").agg(F.array_sort(F.collect_list(F.struct("line", "line_text"))).alias("l"))
    text = text.select(*keep, "section", "start", strip(F.array_join(F.transform("l", lambda x: x["line_text"]), "\n")).alias("content"))
    last = F.row_number().over(Window.partitionBy(*keep, "section").orderBy(F.desc("start")))
    return text.withColumn("_r", last).filter("_r = 1").drop("_r", "start")


def split_by_headings(docs: DataFrame, *keep: str, known: Column | None = None) -> DataFrame:
    """EXT-18, EXT-20: the non-blank text under each heading; text before the first one is dropped."""
    order = Window.partitionBy(*keep).orderBy("line")
    rows = lines(docs, *keep).filter("line_text <> ''")
    is_head = F.col("line_text").rlike(r"^#{1,6}\s+.+$") & (known if known is not None else F.lit(True))
    title = F.when(is_head, strip(chain("line_text", (r"^#{1,6}\s+", ""))))
    rows = rows.withColumn("is_head", is_head).withColumn("start", F.last(F.when(is_head, F.col("line")), ignorenulls=True).over(order)).withColumn("header", F.last(title, ignorenulls=True).over(order))
    rows = rows.filter("start IS NOT NULL")
    text = rows.groupBy(*keep, "start", "header").agg(F.array_sort(F.collect_list(F.when(~F.col("is_head"), F.struct("line", "line_text")))).alias("l"))
    return text.select(*keep, F.col("start").alias("line"), "header", F.array_join(F.transform("l", lambda x: x["line_text"]), "\n").alias("content"))


def boundaries(found: DataFrame, key: str, doc_length: str, start: str = "start") -> DataFrame:
    """WIN-05, JOIN-13: sections as half-open intervals, each up to the next."""
    return found.withColumn("end", F.lead(start).over(Window.partitionBy(key).orderBy(start))).withColumn("end", F.coalesce("end", doc_length))


def located(points: DataFrame, sections: DataFrame, key: str, at: str = "pos", width: int = 4096) -> DataFrame:
    """JOIN-11: points with the section they lie in; points before the first section go to it.

    A range join by buckets: sections are spread over the buckets of width
    `width` that they touch, points have one, and the equal buckets join.
    """
    names = points.columns
    first = sections.groupBy(F.col(key).alias("_key")).agg(F.min("start").alias("_first"))
    own = points.join(first, F.col(key) == F.col("_key"), "left").withColumn("_at", F.greatest(F.col(at), F.coalesce("_first", F.col(at)))).withColumn("_b", F.floor(F.col("_at") / width))
    spread = sections.filter("end > start").withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    spread = spread.select(F.col(key).alias("_section_key"), "file", "start", "end", "_bucket")
    inside = (F.col(key) == F.col("_section_key")) & (F.col("_b") == F.col("_bucket")) & (F.col("_at") >= F.col("start")) & (F.col("_at") < F.col("end"))
    return own.select(*names, "_at", "_b").join(spread, inside, "left").select(*names, "file", "start", "end")


def abstract(c: Column | str) -> Column:
    """EXT-22: text of the abstract; a last section is found only if a Z follows, as in the original's pattern."""
    c = F.col(c) if isinstance(c, str) else c
    first = r"(?mi)^#+\s*Abstract\s*\n([\s\S]*?)(?=^#+|Z)"
    second = r"(?mi)^Abstract[:\s]*\n([\s\S]*?)(?=^#+|\n\n)"
    one, two = F.nullif(F.regexp_extract(c, first, 1), F.lit("")), F.nullif(F.regexp_extract(c, second, 1), F.lit(""))
    return strip(F.coalesce(one, two))


def title(c: Column | str) -> Column:
    """EXT-22: from the frontmatter, else the first heading of level 1."""
    c = F.col(c) if isinstance(c, str) else c
    front = F.regexp_extract(c, r"""(?m)^---\n[\s\S]*?title:\s*["']?([^"'\n]+)["']?[\s\S]*?\n---""", 1)
    head = F.regexp_extract(c, r"(?m)^#\s+(.+)$", 1)
    return F.nullif(strip(F.when(front != "", front).otherwise(head)), F.lit(""))


def combined(sections: DataFrame, project: str, order: str, text: str = "text") -> DataFrame:
    """DIF-15: the sections of a project put together in order."""
    parts = sections.groupBy(project).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("p"))
    return parts.select(project, F.array_join(F.transform("p", lambda x: strip(x["t"])), "\n\n").alias("text"))


def word_counts(sections: DataFrame, project: str, file: str) -> DataFrame:
    """AGG-12: words of each section, of each project and of all."""
    return sections.withColumn("n", F.size(words("text"))).rollup(project, file).agg(F.sum("n").alias("words"))


def ordered(config: DataFrame) -> DataFrame:
    """SRT-09: sections by order, those without one last."""
    return config.orderBy(F.coalesce("ord", F.lit(999)), "file")


def chosen(found: DataFrame, names: list[str]) -> DataFrame:
    """FLT-06: sections (file, header) that one of the names means: the file without .md, a part of it, or a part of the header."""
    file, header = F.lower(F.regexp_replace("file", r"(?i)\.md$", "")), F.lower("header")
    wanted = F.lit(False)
    for name in (n.strip().lower() for n in names):
        wanted = wanted | F.contains(file, F.lit(name)) | F.contains(header, F.lit(name))
    return found.filter(wanted) if names else found


def header(c: Column | str) -> Column:
    """EXT-32: the first heading of level 1; empty if there is none."""
    return strip(F.regexp_extract(c, r"(?m)^#[^\S\n]+([^\n]+)$", 1))


def first_heading(c: Column | str) -> Column:
    """EXT-32: the first heading of any level; empty if there is none."""
    return strip(F.regexp_extract(c, r"(?m)^#{1,6}[^\S\n]+([^\n]+)$", 1))


def derived(listed: DataFrame, texts: DataFrame, project: str) -> DataFrame:
    """SRC-20: the configuration that a project's list of files stands for: project, file, header, aliases, ord.

    listed: project, files (array, in order; null entries count as places).
    texts: project, file, text.  The header is the file's first heading, else
    its name in words.  A file that is listed twice has the later place.
    """
    each = listed.select(project, F.posexplode("files").alias("ord", "file")).filter("file IS NOT NULL").groupBy(project, "file").agg(F.max("ord").alias("ord"))
    heads = texts.select(F.col(project).alias("_project"), F.col("file").alias("_file"), F.nullif(first_heading("text"), F.lit("")).alias("_head"))
    name = F.regexp_replace(F.regexp_extract("file", r"[^/]*\z", 0), r"\.md\z", "")
    words_of = F.transform(F.split(name, r"[-_\s]+", -1), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2))))
    rows = each.join(heads, F.col(project).eqNullSafe(F.col("_project")) & (F.col("file") == F.col("_file")), "left")
    return rows.select(project, "file", F.coalesce("_head", F.array_join(words_of, " ")).alias("header"), F.array().cast("array<string>").alias("aliases"), "ord")


def resolved(explicit: DataFrame, listed: DataFrame, texts: DataFrame, project: str) -> DataFrame:
    """SRC-20: a project's own configuration if it has one, else what its list of files stands for, with `origin`."""
    have = explicit.select(F.col(project).alias("_have")).distinct()
    lists = listed.join(have, F.col(project).eqNullSafe(F.col("_have")), "left_anti")
    own = explicit.select(project, "file", "header", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "ord", F.lit("own").alias("origin"))
    return own.unionByName(derived(lists, texts, project).withColumn("origin", F.lit("derived")))
