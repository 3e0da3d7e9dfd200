"""Bibliographies (SRC-04/05)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bare_doi, strip

ENTRY = r"@([A-Za-z0-9_]+)\s*\{\s*([^,\s]+)\s*,"
#: Characters of a title that are kept; characters before an entry in which a remark counts.
TITLE, REMARK = 60, 200


def field(body: Column | str, name: str) -> Column:
    """A field's value in braces (nested twice at most) or quotes, or bare; null if there is none."""
    b = F.col(body) if isinstance(body, str) else body
    braces = r"\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}"
    got = [F.regexp_extract(b, rf"(?i)(?<![A-Za-z]){name}\s*=\s*{v}", 1) for v in (braces, r'"([^"]*)"', r"(\w+)")]
    return F.coalesce(*[F.nullif(strip(g), F.lit("")) for g in got])


def entries(texts: DataFrame, *keep: str) -> DataFrame:
    """SRC-05: one row per entry: kept columns, key, type, doi, title, author, year, journal, skip, line.

    A text is cut where entries start, so that an entry's fields are looked
    for up to the next entry only.
    """
    marked = F.split(F.regexp_replace("text", r"(?m)(?=@[A-Za-z0-9_]+\s*\{)", "\x00"), "\x00")
    rows = texts.select(*keep, F.posexplode(marked).alias("k", "e"), marked.alias("all"))
    rows = rows.filter(F.col("e").rlike("^" + ENTRY) & ~F.col("e").rlike("(?i)^@(comment|string|preamble)"))
    before = F.element_at("all", F.when(F.col("k") > 0, F.col("k")).otherwise(1))
    remark = F.when(F.col("k") > 0, F.substring_index(F.right(before, F.lit(REMARK)), "}", -1).rlike(r"(?i)%\s*no-?doi")).otherwise(False)
    line = F.length(F.regexp_replace(F.array_join(F.slice("all", F.lit(1), F.col("k")), ""), "[^\n]", "")) + 1
    body = F.regexp_replace("e", "^" + ENTRY, ",")
    e = rows.select(*keep, F.regexp_extract("e", ENTRY, 2).alias("key"), F.lower(F.regexp_extract("e", ENTRY, 1)).alias("type"), body.alias("body"), remark.alias("remark"), line.alias("line"))
    return e.select(
        *keep,
        "key",
        "type",
        bare_doi(field("body", "doi")).alias("doi"),
        F.left(field("body", "title"), F.lit(TITLE)).alias("title"),
        field("body", "author").alias("author"),
        F.nullif(F.regexp_extract(F.coalesce(field("body", "year"), F.lit("")), r"(\d{4})", 1), F.lit("")).cast("int").alias("year"),
        field("body", "journal").alias("journal"),
        (F.coalesce(F.lower(field("body", "nodoi")) == "true", F.lit(False)) | F.coalesce("remark", F.lit(False))).alias("skip"),
        "line",
    )
