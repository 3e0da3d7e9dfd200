"""Queries over versions of texts: diffs, merges, placement, SQL functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sql
from ..functions import markup, protect
from ..operators import diffs, paragraphs
from . import corpora
from .base import Family, with_corpus

family = Family()
QUERIES, SQL = family.queries, family.sql


def _versions(c):
    """A text and the same with its first 'the' and 'und' replaced and a word behind."""
    new = F.concat(F.regexp_replace("text", r"^([\s\S]*?)\bthe\b", "$1THAT"), F.lit(" More."))
    return c.select("doc_id", F.col("text").alias("old"), new.alias("new"))


@family.over("documents")
def word_diff(c):
    return diffs.changes(_versions(c), "doc_id").select("doc_id", "seq", "type", "start", "end", "old_text", "new_text")


@family.over("documents", r"SELECT doc_id, concat(text, ' More.') AS accepted, text AS rejected FROM c")
def word_diff_round_trip(c):
    """An annotated diff gives the new text when all is accepted and the old one when all is rejected."""
    v = c.select("doc_id", F.col("text").alias("old"), F.concat("text", F.lit(" More.")).alias("new"))
    d = diffs.annotated(v, "doc_id")
    return d.select("doc_id", markup.all_accepted("text").alias("accepted"), markup.all_rejected("text").alias("rejected"))


@family.over("documents")
def smart_diff(c):
    return paragraphs.smart(_versions(c), "doc_id")


def _tidy(text: str) -> str:
    """DuckDB: without empty paragraphs."""
    return f"array_to_string(list_filter(string_split_regex({text}, '\\n\\n+'), lambda p: regexp_matches(p, '\\S')), chr(10) || chr(10))"


@family.over("rewritten", f"SELECT doc_id, {_tidy('new')} AS accepted, {_tidy('old')} AS rejected FROM c")
def smart_diff_round_trip(c):
    """DIF-02: what is accepted gives the new paragraphs, what is rejected the old ones."""
    made = paragraphs.smart(c, "doc_id")

    def tidy(text):
        return F.array_join(paragraphs.paragraphs(text), "\n\n")

    return made.select("doc_id", tidy(markup.all_accepted("text")).alias("accepted"), tidy(markup.all_rejected("text")).alias("rejected"))


_TABLE_1 = "concat('| Site ', doc_id, ' | Rain |', chr(10), '|---|---|', chr(10), '| Hill ', doc_id, ' | total ', doc_id, ' |')"
_TABLE_2 = "concat('| Year ', doc_id, ' |', chr(10), '| sum ', doc_id, ' |')"


@family.over("flattened", f"""SELECT doc_id, concat(coalesce(text, ''), chr(10), chr(10), {_TABLE_1}, chr(10), chr(10), chr(10), chr(10), 'Words between.', chr(10), chr(10),
    CASE WHEN doc_id % 3 = 0 THEN 'Nothing here' ELSE concat({_TABLE_2}, chr(10), chr(10)) END) AS text FROM c""")
def word_tables_set_in(c):
    """DIF-03: a table in the middle, and one at the end that a third of the texts lack."""
    first = F.concat(F.lit("| Site "), "doc_id", F.lit(" | Rain |\n|---|---|\n| Hill "), "doc_id", F.lit(" | total "), "doc_id", F.lit(" |"))
    second = F.concat(F.lit("| Year "), "doc_id", F.lit(" |\n| sum "), "doc_id", F.lit(" |"))
    tables = c.select("doc_id", F.posexplode(F.array(first, second)).alias("ord", "markdown"))
    return paragraphs.tables_set_in(c.select("doc_id", "flat").withColumnRenamed("flat", "text"), tables, "doc_id")


#: DuckDB: the same, told from the other side: which marks were put into the texts, and what they leave.
@family.over("reworded", "SELECT doc_id, concat(coalesce(text, ''), ' [@A2020] $x$ so. [@B2001] {~~old~>new~~} end ', doc_id, '.') AS text FROM c")
def citations_restored(c):
    """SCL-21."""
    return c.select("doc_id", F.concat(F.coalesce("text", F.lit("")), protect.citations_kept("marked")).alias("text"))


#: DuckDB: a cursor over the right paragraphs; each left one takes the best of the next three, or with a mark the next one that holds its beginning.
_ALIGN = r"""+ q AS (SELECT doc_id, list_filter(string_split_regex(old, '\n\n+'), lambda p: regexp_matches(p, '\S')) AS a, list_filter(string_split_regex(new, '\n\n+'), lambda p: regexp_matches(p, '\S')) AS b FROM c),
    r AS (SELECT doc_id, a, b, list_transform(a, lambda p: regexp_extract(string_split(p, chr(10))[1], '^(#{1,6}\s+|\s*[-*+]\s+|\s*\d+\.\s+|>\s*)')) AS m FROM q),
    p AS (SELECT doc_id, len(a) AS n, b, m, list_transform(a, lambda p, k: lower(substr(string_split(p, chr(10))[1], length(m[k]) + 1))) AS l,
            list_transform(b, lambda p: string_split_regex(lower(p), '\s+')) AS w FROM r),
    walk AS (SELECT doc_id, 0 AS i, 0::BIGINT AS place, NULL::STRUCT(o DOUBLE, j BIGINT) AS x FROM p
        UNION ALL SELECT doc_id, i, CASE WHEN x.j IS NULL THEN place ELSE 1 - x.j END, x FROM (
            SELECT v.doc_id, v.i + 1 AS i, v.place, coalesce(
                list_sort(list_filter(list_transform(range(v.place, least(v.place + 3, len(p.b))), lambda j: {'o': len(list_filter(p.w[j + 1], lambda t: list_contains(string_split_regex(p.l[v.i + 1], '\s+'), t)))::DOUBLE / greatest(len(list_distinct(string_split_regex(p.l[v.i + 1], '\s+'))), len(p.w[j + 1])), 'j': -j}), lambda y: y.o > 0.3), 'DESC')[1],
                CASE WHEN p.m[v.i + 1] <> '' AND v.place < len(p.b) AND contains(lower(p.b[v.place + 1]), left(p.l[v.i + 1], 20)) THEN {'o': 0.0::DOUBLE, 'j': -v.place} END) AS x
            FROM walk v JOIN p ON p.doc_id = v.doc_id WHERE v.i < p.n))
    SELECT doc_id, (i - 1)::INT AS "left", (-x.j)::INT AS "right", x.o AS overlap FROM walk WHERE i > 0"""


@family.over("rewritten")
def paragraph_alignment(c):
    """JOIN-15."""
    return paragraphs.aligned(c, "doc_id").select("doc_id", "left", "right", "overlap")


SQL["paragraph_alignment"] = with_corpus("rewritten", _ALIGN).replace("WITH c", "WITH RECURSIVE c", 1)


@family.over("documents")
def single_space(c):
    return diffs.single_spaced(c.select("doc_id", F.regexp_replace("text", " ", "  ").alias("text")), "doc_id")


@family.over("documents")
def three_way_merge(c):
    base = c.select("doc_id", "text")
    one = base.select("doc_id", F.lit("R1").alias("reviewer"), F.lit(1).alias("reviewer_ord"), F.concat("text", F.lit(" One.")).alias("text"))
    two = base.select("doc_id", F.lit("R2").alias("reviewer"), F.lit(2).alias("reviewer_ord"), F.regexp_replace("text", r"^(\S+)", "First").alias("text"))
    return diffs.merged(base, one.unionByName(two), "doc_id")[0]


_ANCHOR = "trim(array_to_string(list_slice(string_split(coalesce(text, ''), ' '), 4, 7), ' '), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


@family.over("documents", f"""SELECT doc_id, (length(coalesce(text, '')) + length('{{>>Ann: look<<}}') + length('{{>>↪ Bo: done<<}}'))::INT AS n,
    [CASE WHEN {_ANCHOR} = '' THEN 'position-only' ELSE 'direct' END, 'reply'] AS strategies FROM c""")
def place_comments(c):
    texts = c.select("doc_id", "text")
    words = F.slice(F.split("text", " "), 4, 4)
    comments = texts.select("doc_id", F.lit(1).alias("ord"), F.lit("1").alias("id"), F.lit("Ann").alias("author"), F.lit("look").alias("text"), F.array_join(words, " ").alias("anchor"), F.lit("").alias("before"), F.lit("").alias("after"), F.lit(0.1).alias("position"), F.lit(None).cast("string").alias("parent"))
    reply = comments.withColumn("ord", F.lit(2)).withColumn("id", F.lit("2")).withColumn("author", F.lit("Bo")).withColumn("text", F.lit("done")).withColumn("parent", F.lit("1"))
    return diffs.placed(texts, comments.unionByName(reply), "doc_id").select("doc_id", F.length("text").alias("n"), F.transform("report", lambda r: r["strategy"]).alias("strategies"))


@family.over("annotated", f"""SELECT doc_id, (length(text) + length('{{>>Ann: look<<}}'))::INT AS n, [CASE WHEN {_ANCHOR} = '' THEN 'position-only' ELSE 'direct' END] AS strategies
    FROM (SELECT doc_id, regexp_replace(text, '\\s*\\{{>>[\\s\\S]+?<<\\}}', '', 'g') AS text FROM c)""")
def comments_realigned(c):
    """DIF-13: the corpus' own comments go, one comes, that of another author does not."""
    bare = F.regexp_replace("text", r"\s*\{>>[\s\S]+?<<\}", "")
    anchor = F.array_join(F.slice(F.split(bare, " "), 4, 4), " ")
    own = [F.lit(v).alias(n) for v, n in (("1", "id"), ("Ann", "author"), ("look", "text"))]
    comments = c.select("doc_id", F.lit(1).alias("ord"), *own, anchor.alias("anchor"), F.lit("").alias("before"), F.lit("").alias("after"), F.lit(0.1).alias("position"), F.lit(None).cast("string").alias("parent"))
    others = comments.withColumn("ord", F.lit(2)).withColumn("id", F.lit("2")).withColumn("author", F.lit("Bo"))
    return diffs.realigned(c.select("doc_id", "text"), comments.unionByName(others), "doc_id", authors=["Ann"]).select("doc_id", F.length("text").alias("n"), F.transform("report", lambda r: r["strategy"]).alias("strategies"))


_SQL_STRIP = r"regexp_replace(regexp_replace(regexp_replace(text, '(?s)\{~~(.+?)~>(.+?)~~\}', '\2', 'g'), '(?s)\{\+\+(.+?)\+\+\}', '\1', 'g'), '(?s)\{--(.+?)--\}', '', 'g')"


@family.over(None, f"WITH c AS ({corpora.for_duckdb('annotated')}) SELECT doc_id, {_SQL_STRIP} AS text FROM c")
def sql_accept_all(spark, sf_dir):
    """The verbs from SQL."""
    sql.register(spark)
    return spark.sql("SELECT doc_id, accept_all(text) AS text FROM {c}", c=corpora.for_spark(spark, sf_dir, "annotated"))


@family.over(None, f"WITH c AS ({corpora.for_duckdb('annotated')}) SELECT doc_id, concat('added ', doc_id) AS content FROM c")
def sql_annotations(spark, sf_dir):
    sql.register(spark)
    return spark.sql("SELECT doc_id, a.content FROM {c}, LATERAL annotations(text) a WHERE a.kind = 'insert' AND a.content LIKE 'added%'", c=corpora.for_spark(spark, sf_dir, "annotated"))


