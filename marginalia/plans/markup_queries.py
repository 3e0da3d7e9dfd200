"""Queries over annotated, citing and cross-referencing texts."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import markup
from ..operators import annotations, citations, crossref, equations, threads
from . import corpora
from .base import Family, duck_lines, duck_matches

family = Family()
QUERIES, SQL = family.queries, family.sql

#: The grammars as DuckDB takes them.
PATTERNS = {"insert": r"(?s)\{\+\+(.+?)\+\+\}", "delete": r"(?s)\{--(.+?)--\}", "substitute": r"(?s)\{~~(.+?)~>(.+?)~~\}", "comment": r"(?s)\{>>(.+?)<<\}"}
#: The comments of the corpora have none of the marks of false ones but length.
REAL = "NOT (length(g1) > 200 AND NOT regexp_matches(trim(g1), '^\\p{L}[\\p{L}\\s\\-''.]{0,30}:\\s'))"


def _kind_sql(kind: str, extra: str = "NULL::VARCHAR") -> str:
    groups = 2 if kind == "substitute" else 1
    return f"SELECT doc_id, '{kind}' AS kind, pos::INT AS pos, match, g1, {extra} AS g2, text FROM ({duck_matches('doc_id', PATTERNS[kind], groups=groups)})" + (f" WHERE {REAL}" if kind == "comment" else "")


ALL_SQL = " UNION ALL ".join([_kind_sql("insert"), _kind_sql("delete"), _kind_sql("substitute", "g2"), _kind_sql("comment")])
AUTHOR = "CASE WHEN instr(g1, ':') - 1 > 0 AND instr(g1, ':') - 1 < 30 THEN regexp_replace(substr(g1, 1, instr(g1, ':') - 1), '^\\s+|\\s+$', '', 'g') ELSE '' END"
SAID = "CASE WHEN instr(g1, ':') - 1 > 0 AND instr(g1, ':') - 1 < 30 THEN regexp_replace(substr(g1, instr(g1, ':') + 1), '^\\s+|\\s+$', '', 'g') ELSE g1 END"
LINE = "(length(substr(text, 1, pos)) - length(replace(substr(text, 1, pos), chr(10), '')) + 1)::INT"


@family.over("annotated", f"""SELECT doc_id, kind, pos, match, CASE WHEN kind = 'comment' THEN {SAID} ELSE g1 END AS content, g2 AS replacement,
    CASE WHEN kind = 'comment' THEN {AUTHOR} END AS author, {LINE} AS line FROM ({ALL_SQL})""")
def annotation_parse(c):
    return annotations.annotations(c, "doc_id").select("doc_id", "kind", "pos", "match", "content", "replacement", "author", "line")


@family.over("annotated", f"""SELECT doc_id, kind, pos, right(list_extract(string_split(substr(text, 1, pos), chr(10)), -1), 50) AS before,
    left(list_extract(string_split(substr(text, pos + length(match) + 1), chr(10)), 1), 50) AS after FROM ({ALL_SQL}) WHERE kind <> 'comment'""")
def annotation_context(c):
    return annotations.track_changes(annotations.annotations(c, "doc_id")).select("doc_id", "kind", "pos", "before", "after")


@family.over("annotated", f"""SELECT doc_id, count(*) FILTER (kind = 'insert')::INT AS inserts, count(*) FILTER (kind = 'delete')::INT AS deletes, count(*) FILTER (kind = 'substitute')::INT AS substitutes,
    count(*) FILTER (kind = 'comment')::INT AS comments, count(*)::INT AS total FROM ({ALL_SQL}) GROUP BY doc_id""")
def annotation_counts(c):
    return annotations.counts(c, "doc_id")


_DOUBT = r"""SELECT doc_id, pos, g1 AS content,
    n(before, '(?m)^```|^~~~') > n(before, '(?m)```$|~~~$') OR regexp_matches(line, '^(\t|    )') OR n(line, '`') % 2 = 1 OR n(near, '\{--') > n(near, '--\}') OR n(near, '\{\+\+') > n(near, '\+\+\}')
    OR regexp_matches(g1, '(?i)\(figures?/|\(images?/|\.png|\.jpg|\.jpeg|\.gif|\.svg|\.pdf') OR regexp_matches(g1, '\{#fig:|!\[') OR (NOT author AND regexp_matches(g1, '(?i)https?://|www\.') AND length(g1) < 150)
    OR regexp_matches(g1, 'function\s*\(|=>|import\s+|export\s+|const\s+|let\s+|var\s+') OR (NOT author AND NOT regexp_matches(c, '^[✓✔]\s') AND length(g1) > 200)
    OR regexp_matches(c, '(?i)^(Fig\.?|Figure|Table|Sankey|Diagram|Proportion|Distribution|Map|Chart|Graph|Plot|Panel)') OR regexp_matches(g1, '\\[a-z]+\{|\\frac|\\sum|\\int|\\begin\{') OR regexp_matches(g1, '(?i)@article\{|@book\{|@inproceedings\{') AS mistaken
    FROM (SELECT *, trim(g1) AS c, regexp_matches(trim(g1), '^\p{L}[\p{L}\s\-''.]{0,30}:\s') AS author, right(substr(text, 1, pos), 2000) AS before, right(substr(text, 1, pos), 500) AS near, list_extract(string_split(right(substr(text, 1, pos), 2000), chr(10)), -1) AS line FROM (__))"""


def _counted(sql: str) -> str:
    """n(text, pattern) as DuckDB has it."""
    return re.sub(r"\bn\((\w+), ('[^']*')\)", r"len(regexp_extract_all(\1, \2))", sql)


@family.over("doubtful", _counted(_DOUBT).replace("__", duck_matches("doc_id", r"(?s)\{>>(.+?)<<\}")))
def comments_mistaken(c):
    """EXT-02: what looks like a comment, in each of its forms, and whether it is none."""
    found = c.select("doc_id", "text", F.explode(markup.matches("text", markup.COMMENT, 1)).alias("m"))
    return found.select("doc_id", "m.pos", F.col("m.g1").alias("content"), markup.is_false_comment("m.g1", "text", "m.pos").alias("mistaken"))


_STRIP = [(r"(?s)\{~~(.+?)~>(.+?)~~\}", r"\2"), (r"(?s)\{\+\+(.+?)\+\+\}", r"\1"), (r"(?s)\{--(.+?)--\}", ""), (r"(?s)\{==(.+?)==\}", r"\1"), (r"(?s)\{>>(.+?)<<\}", ""), (r"\[([^\]]*)\]\{\.mark\}", r"\1"), (r"\{----\}", ""), (r"\{\+\+\+\+\}", ""), (r"\{--\s*--\}", ""), (r"\{\+\+\s*\+\+\}", ""), (r"~>[^{]*?~~\}", ""), (r"\{~~\{~~", "{~~"), (r"~~\}~~\}", "~~}")]


def _nest(inner: str, steps) -> str:
    for a, b in steps:
        inner = f"regexp_replace({inner}, '{a}', '{b}', 'g')"
    return inner


#: Passes of the rewrite, one after the other; three are enough for the corpora.
def _passes(n: int, keep_comments: bool = False) -> str:
    steps = [x for x in _STRIP if not (keep_comments and "<<" in x[0])]
    sql = "SELECT doc_id, text AS t FROM c"
    for _ in range(n):
        sql = f"SELECT doc_id, {_nest('t', steps)} AS t FROM ({sql})"
    return f"SELECT doc_id, {_nest('t', [(chr(45) * 2 + r'\}|\+\+\}|~~\}', ''), (r'\{--|\{\+\+|\{~~', ''), ('~>', '')])} AS text FROM ({sql})"


@family.over("annotated", _passes(2))
def annotation_strip(c):
    return c.select("doc_id", markup.stripped("text").alias("text"))


@family.over("nested", _passes(4))
def strip_fixpoint(c):
    return c.select("doc_id", markup.stripped("text").alias("text"))


@family.over("nested", _passes(4, keep_comments=True))
def strip_keeping_comments(c):
    return c.select("doc_id", markup.stripped("text", keep_comments=True).alias("text"))


def _orphans_sql() -> str:
    """By lists: pieces up to each closing brace lose a lone end, pieces behind each opener tell whether it stays."""
    t = "SELECT doc_id, text AS t FROM c"
    for mark in ("++", "--", "~~"):
        lone = f"ends_with(p, '{mark}') AND NOT contains(left(p, length(p) - 2), '{{{mark}')"
        t = f"SELECT doc_id, array_to_string(list_transform(ps, lambda p, i: CASE WHEN i = n THEN p WHEN {lone} THEN left(p, length(p) - 2) ELSE p || '}}' END), '') AS t FROM (SELECT doc_id, string_split(t, '}}') AS ps, len(string_split(t, '}}')) AS n FROM ({t}))"
    opened = {
        "++": ("regexp_matches(p, '^[^+]*?(\\{[-+~>]|$)')", "p"),
        "--": ("regexp_matches(p, '^[^-]*?(\\{[-+~>]|$)')", "p"),
        "~~": ("NOT starts_with(p, '}') AND regexp_matches(p, '^[^~]*?~>[^~]*?(\\{[-+~>]|$)')", "regexp_replace(p, '^[^~]*?~>([^~]*?)(\\{[-+~>]|$)', '\\1\\2')"),
    }
    for mark, (unclosed, content) in opened.items():
        t = f"SELECT doc_id, array_to_string(list_transform(string_split(t, '{{{mark}'), lambda p, i: CASE WHEN i = 1 THEN p WHEN {unclosed} THEN {content} ELSE '{{{mark}' || p END), '') AS t FROM ({t})"
    return f"SELECT doc_id, t AS text FROM ({t})"


@family.over("nested", _orphans_sql())
def orphans_swept(c):
    return c.select("doc_id", markup.without_orphans("text").alias("text"))


@family.over("annotated", f"SELECT doc_id, {_nest('text', [(PATTERNS['substitute'], r'\2'), (PATTERNS['insert'], r'\1'), (PATTERNS['delete'], '')])} AS text FROM c")
def accept_all(c):
    return c.select("doc_id", markup.all_accepted("text").alias("text"))


@family.over("annotated", f"SELECT doc_id, {_nest('text', [(PATTERNS['substitute'], r'\1'), (PATTERNS['insert'], ''), (PATTERNS['delete'], r'\1')])} AS text FROM c")
def reject_all(c):
    return c.select("doc_id", markup.all_rejected("text").alias("text"))


@family.over("annotated", f"""SELECT doc_id, kind, pos, CASE kind WHEN 'insert' THEN g1 WHEN 'delete' THEN '' ELSE g2 END AS accepted, CASE kind WHEN 'insert' THEN '' ELSE g1 END AS rejected
    FROM ({ALL_SQL}) WHERE kind <> 'comment'""")
def decisions(c):
    found = annotations.track_changes(annotations.annotations(c, "doc_id"))
    args = ("kind", "match", "content", "replacement")
    return found.select("doc_id", "kind", "pos", markup.decided(*args, F.lit(True)).alias("accepted"), markup.decided(*args, F.lit(False)).alias("rejected"))


@family.over("annotated", "SELECT lang, count(*) FILTER (regexp_matches(text, '(?s)\\{==.+?==\\}|\\{\\+\\+.+?\\+\\+\\}'))::BIGINT AS annotated, count(*)::BIGINT AS docs FROM c GROUP BY lang")
def annotated_docs(c):
    return c.groupBy("lang").agg(F.count_if(markup.is_annotated("text")).alias("annotated"), F.count("*").alias("docs"))


@family.over("annotated", "SELECT source, sum(len(regexp_extract_all(text, '\\{\\+\\+')))::BIGINT AS inserts, sum(len(regexp_extract_all(text, '\\{--')))::BIGINT AS deletes, sum(len(regexp_extract_all(text, '\\{~~')))::BIGINT AS substitutes, sum(len(regexp_extract_all(text, '\\{>>')))::BIGINT AS comments FROM c GROUP BY source")
def import_marker_counts(c):
    return c.groupBy("source").agg(*[F.sum(v).alias(k) for k, v in markup.marker_counts("text").items()])


STATUS_SQL = f"SELECT doc_id, pos, {AUTHOR} AS author, {SAID} AS said FROM ({ALL_SQL}) WHERE kind = 'comment'"
DONE = "(ends_with(said, '[RESOLVED]') OR ends_with(said, '[✓]'))"
BARE = "regexp_replace(regexp_replace(said, '\\s*(\\[RESOLVED\\]|\\[✓\\])\\s*$', '', 'g'), '^\\s+|\\s+$', '', 'g')"


def _comments(c):
    return annotations.comments(annotations.annotations(c, "doc_id"))


@family.over("annotated", f"SELECT doc_id, pos, author, {BARE} AS content, {DONE} AS resolved FROM ({STATUS_SQL})")
def comments_list(c):
    return _comments(c).select("doc_id", "pos", "author", "content", "resolved")


@family.over("annotated", f"SELECT doc_id, pos, author FROM ({STATUS_SQL}) WHERE NOT {DONE} AND contains(lower(author), 'reviewer 1')")
def comments_pending_by_author(c):
    return _comments(c).filter(~F.col("resolved") & F.lower("author").contains("reviewer 1")).select("doc_id", "pos", "author")


@family.over("annotated", f"SELECT author, count(*)::BIGINT AS n, count(*) FILTER (NOT {DONE})::BIGINT AS pending FROM ({STATUS_SQL}) GROUP BY author")
def todo_by_author(c):
    return _comments(c).groupBy("author").agg(F.count("*").alias("n"), F.count_if(~F.col("resolved")).alias("pending"))


@family.over("annotated", f"SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos)::INT AS number FROM ({STATUS_SQL})")
def comment_numbering(c):
    return annotations.numbered(_comments(c), "doc_id").select("doc_id", "pos", "number")


@family.over("annotated", f"""SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos)::INT AS nth, row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC)::INT AS nth_last,
    lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS next_pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS prev_pos FROM ({STATUS_SQL}) WHERE NOT {DONE}""")
def comment_next_pending(c):
    return annotations.neighbours(_comments(c), "doc_id").select("doc_id", "pos", "nth", "nth_last", "next_pos", "prev_pos")


@family.over("annotated", f"SELECT doc_id, pos, regexp_replace(regexp_replace(match, '\\s*(\\[RESOLVED\\]|\\[✓\\])\\s*<<\\}}$', '<<}}'), '<<\\}}$', ' [RESOLVED]<<}}') AS resolved, regexp_replace(match, '\\s*(\\[RESOLVED\\]|\\[✓\\])\\s*<<\\}}$', '<<}}') AS pending FROM ({ALL_SQL}) WHERE kind = 'comment'")
def comment_status(c):
    found = annotations.annotations(c, "doc_id").filter("kind = 'comment'")
    return found.select("doc_id", "pos", markup.with_status("match", True).alias("resolved"), markup.with_status("match", False).alias("pending"))


@family.over("annotated", f"""SELECT doc_id, kind, pos, '{{{{TC_' || (row_number() OVER (PARTITION BY doc_id ORDER BY CASE kind WHEN 'insert' THEN 0 WHEN 'delete' THEN 1 WHEN 'substitute' THEN 2 ELSE 3 END, pos) - 1) || '}}}}' AS placeholder FROM ({ALL_SQL})""")
def track_change_placeholders(c):
    return annotations.placeholders(annotations.annotations(c, "doc_id"), "doc_id").select("doc_id", "kind", "pos", "placeholder")


@family.over("annotated", f"SELECT doc_id, {_nest('text', [(PATTERNS['comment'], r'\\marginnote{\1}'), (PATTERNS['insert'], r'\\textcolor{blue}{\1}'), (PATTERNS['delete'], r'\\textcolor{red}{\1}'), (PATTERNS['substitute'], r'\\textcolor{red}{\1}\\textcolor{blue}{\2}')])} AS text FROM c")
def latex_markup(c):
    return c.select("doc_id", markup.latex_comments("text").alias("text"))


@family.over("documents", r"SELECT doc_id, regexp_replace(concat('[Ann: look] ', coalesce(text, '')), '\[([^\]:]+):\s*([^\]]+)\]', '{>>\1: \2<<}', 'g') AS text FROM c")
def visible_comments(c):
    return c.select("doc_id", markup.visible_comments(F.concat(F.lit("[Ann: look] "), F.coalesce("text", F.lit("")))).alias("text"))


# -- threads

TALK = "SELECT conv_id, string_agg(markup, ' ' ORDER BY turn) AS text FROM c GROUP BY conv_id"
_AUTHORED = r"\{>>([^:]+):\s*([^<]+)<<\}"


def _talk(c):
    joined = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "markup"))).alias("m"))
    return joined.select("conv_id", F.array_join(F.transform("m", lambda x: x["markup"]), " ").alias("text"))


THREADS = f"""SELECT conv_id, trim(a[1], chr(32)||chr(9)||chr(10)||chr(13)||chr(12)) AS author, regexp_replace(t[1], '^\\s+|\\s+$', '', 'g') AS text, (len(a) - 1)::INT AS replies
    FROM (SELECT conv_id, regexp_extract_all(text, '{_AUTHORED}', 1) AS a, regexp_extract_all(text, '{_AUTHORED}', 2) AS t FROM ({TALK})) WHERE len(a) > 0"""


@family.over("talk", THREADS)
def threads_by_line(c):
    return threads.threads(_talk(c), "conv_id").select("conv_id", "author", "text", F.size("replies").alias("replies"))


@family.over("talk", f"""SELECT a[1] AS author, count(*)::BIGINT AS comments, sum(len(a) - 1)::BIGINT AS replies FROM (SELECT regexp_extract_all(text, '{_AUTHORED}', 1) AS a FROM ({TALK})) WHERE len(a) > 0 GROUP BY 1""")
def comments_by_reviewer(c):
    return threads.by_reviewer(threads.threads(_talk(c), "conv_id"))


@family.over("talk", f"""SELECT project, concat('# Response to Reviewers', chr(10), chr(10), string_agg(body, '' ORDER BY NOT contains(lower(author), 'reviewer'), author)) AS letter, sum(n)::BIGINT AS comments
    FROM (SELECT project, author, count(*) AS n, concat('## ', author, chr(10), chr(10), string_agg(concat('**Comment ', k, '** (line 1)', chr(10), chr(10), '> ', text, chr(10), chr(10)), '' ORDER BY k)) AS body
    FROM (SELECT conv_id % 10 AS project, author, text, row_number() OVER (PARTITION BY conv_id % 10, author ORDER BY text) AS k FROM ({THREADS}) WHERE author <> 'system') GROUP BY 1, 2) GROUP BY 1""")
def response_letters(c):
    return threads.letter(threads.threads(_talk(c), "conv_id").withColumn("project", F.col("conv_id") % 10), "project", own="system")


@family.over("events", """, e AS (SELECT user_id, event_id, (event_id * 7 % 2000)::BIGINT AS pos, (event_id * 7 % 2000)::BIGINT + 4 AS "end" FROM c),
    g AS (SELECT *, CASE WHEN pos - lag("end") OVER w >= 10 OR lag("end") OVER w IS NULL THEN 1 ELSE 0 END AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
    k AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cluster FROM g)
    SELECT user_id, event_id, cluster::BIGINT AS cluster, first_value(pos) OVER (PARTITION BY user_id, cluster ORDER BY pos) AS parent, pos <> first_value(pos) OVER (PARTITION BY user_id, cluster ORDER BY pos) AS is_reply FROM k""".replace(", e AS", "+ e AS", 1))
def threads_by_gap(c):
    e = c.select("user_id", "event_id", (F.col("event_id") * 7 % 2000).alias("pos")).withColumn("end", F.col("pos") + 4)
    return threads.clusters(e, "user_id").select("user_id", "event_id", "cluster", "parent", "is_reply")


@family.over("conversations", "SELECT concat(conv_id, '-', turn) AS id, concat(conv_id, '-', min(turn) OVER (PARTITION BY conv_id)) AS root FROM c")
def reply_root(c):
    from pyspark.sql import Window

    before = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    parent = F.when(before.isNotNull(), F.concat("conv_id", F.lit("-"), before))
    return threads.roots(c.select(F.concat("conv_id", F.lit("-"), "turn").alias("id"), parent.alias("parent_id")))


# -- citations

CITED = f"""SELECT doc_id, file, line, regexp_replace(trim(unnest(string_split(g, ';'))), '^@', '') AS key FROM (SELECT doc_id, file, line, unnest(regexp_extract_all(line_text, '\\[@([^\\]]+)\\]', 1)) AS g FROM ({duck_lines('doc_id, file')}) WHERE NOT starts_with(trim(line_text), '<!--'))
    UNION ALL SELECT doc_id, file, line, unnest(regexp_extract_all(line_text, ' @([A-Za-z][A-Za-z0-9_-]*\\d{{4}}[a-z]?) ', 1)) AS key FROM ({duck_lines('doc_id, file')}) WHERE NOT starts_with(trim(line_text), '<!--')"""
BIB = "SELECT concat('P', p_partkey) AS key FROM part"


def _bib(spark, sf_dir):
    return citations.bibliography_keys(corpora.for_spark(spark, sf_dir, "bibliography"))


def _cited(spark, sf_dir):
    return citations.citations(corpora.for_spark(spark, sf_dir, "citing"), "doc_id", "file")


def _citing(sql: str) -> str:
    return f"WITH c AS ({corpora.for_duckdb('citing')}), cited AS ({CITED}), bib AS ({BIB}) {sql}"


@family.over(None, _citing("SELECT doc_id, file, line::INT AS line, key FROM cited"))
def citation_extract(spark, sf_dir):
    return _cited(spark, sf_dir).select("doc_id", "file", "line", "key")


@family.over(None, _citing("SELECT key FROM bib"))
def bib_keys(spark, sf_dir):
    return _bib(spark, sf_dir)


@family.over(None, _citing("SELECT doc_id, key FROM cited WHERE key IN (SELECT key FROM bib)"))
def citation_valid(spark, sf_dir):
    return citations.valid(_cited(spark, sf_dir), _bib(spark, sf_dir)).select("doc_id", "key")


@family.over(None, _citing("SELECT doc_id, key FROM cited WHERE key NOT IN (SELECT key FROM bib)"))
def citation_missing(spark, sf_dir):
    return citations.missing(_cited(spark, sf_dir), _bib(spark, sf_dir)).select("doc_id", "key")


@family.over(None, _citing("SELECT key FROM bib WHERE key NOT IN (SELECT key FROM cited)"))
def citation_unused(spark, sf_dir):
    return citations.unused(_cited(spark, sf_dir), _bib(spark, sf_dir))


@family.over(None, _citing("SELECT key, count(*)::BIGINT AS n FROM cited GROUP BY key HAVING count(*) > 1"))
def citation_duplicates(spark, sf_dir):
    return citations.duplicates(_cited(spark, sf_dir))


@family.over(None, _citing("SELECT doc_id, file, line::INT AS line, key, n::BIGINT AS n FROM (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM cited) WHERE n > 1"))
def citation_duplicate_uses(spark, sf_dir):
    """AGG-03 with all places."""
    return citations.duplicate_uses(_cited(spark, sf_dir)).select("doc_id", "file", "line", "key", "n")


@family.over(None, _citing("""SELECT count(*)::BIGINT AS total, count(DISTINCT key)::BIGINT AS unique_keys, count(*) FILTER (key IN (SELECT key FROM bib))::BIGINT AS valid, count(*) FILTER (key NOT IN (SELECT key FROM bib))::BIGINT AS missing,
    count(DISTINCT key) FILTER (key NOT IN (SELECT key FROM bib))::BIGINT AS missing_keys, (SELECT count(*) FROM bib)::BIGINT AS bib_entries, (SELECT count(*) FROM bib WHERE key NOT IN (SELECT key FROM cited))::BIGINT AS unused FROM cited"""))
def citation_stats(spark, sf_dir):
    return citations.statistics(_cited(spark, sf_dir), _bib(spark, sf_dir))


# -- cross-references

ANCHORS = f"SELECT project, file, file_ord, lower(g1) AS kind, g2 AS label, pos FROM ({duck_matches('project, file, file_ord', r'(?i)\{#(fig|tbl|eq):([a-zA-Z0-9_-]+)', groups=2)})"
REGISTRY = f"""SELECT project, kind, label, num::INT AS num, is_supp, file FROM (SELECT *, row_number() OVER (PARTITION BY project, kind, is_supp ORDER BY file_ord, pos) AS num, row_number() OVER (PARTITION BY project, kind, label ORDER BY file_ord DESC, pos DESC) AS r
    FROM (SELECT *, starts_with(file, 'supp') AND kind <> 'eq' AS is_supp FROM ({ANCHORS}))) WHERE r = 1"""
REFS = f"SELECT doc_id, project, file, lower(g1) AS kind, g2 AS label, match, pos FROM ({duck_matches('doc_id, project, file', r'(?i)@(fig|tbl|eq):([a-zA-Z0-9_-]+)', groups=2)})"
SHOWN = "concat(CASE kind WHEN 'fig' THEN 'Figure' WHEN 'tbl' THEN 'Table' ELSE 'Equation' END, ' ', CASE WHEN is_supp THEN 'S' ELSE '' END, num)"


def _registry(c):
    return crossref.registry(c, "project", "file", "file_ord")


@family.over("papers", REGISTRY)
def figure_registry(c):
    return _registry(c)


@family.over("papers", f"SELECT r.doc_id, r.kind, r.label, r.pos::INT AS pos, {SHOWN.replace('kind', 'r.kind')} AS display FROM ({REFS}) r JOIN ({REGISTRY}) g ON r.project = g.project AND r.kind = g.kind AND r.label = g.label UNION ALL SELECT doc_id, kind, label, pos::INT AS pos, NULL FROM ({REFS}) r WHERE NOT EXISTS (SELECT 1 FROM ({REGISTRY}) g WHERE r.project = g.project AND r.kind = g.kind AND r.label = g.label)")
def ref_resolution(c):
    refs = crossref.references(c, "doc_id", "project")
    known = _registry(c).select("project", "kind", "label", crossref.display("kind", "num", "is_supp").alias("display"))
    return refs.join(known, ["project", "kind", "label"], "left").select("doc_id", "kind", "label", "pos", "display")


@family.over("papers", f"SELECT doc_id, project, kind, label, pos::INT AS pos FROM ({REFS}) r WHERE NOT EXISTS (SELECT 1 FROM ({ANCHORS}) a WHERE a.project = r.project AND a.kind = r.kind AND a.label = r.label)")
def broken_refs(c):
    """JOIN-06."""
    known = crossref.anchors(c, "project").select("project", "kind", "label").distinct()
    return crossref.references(c, "doc_id", "project").join(known, ["project", "kind", "label"], "left_anti").select("doc_id", "project", "kind", "label", "pos")


@family.over("papers", f"""SELECT r.doc_id, r.kind, r.label, r.pos::INT AS pos, a.p::INT AS anchor_pos FROM ({REFS}) r LEFT JOIN (SELECT file_ord AS doc_id, kind, label, min(pos) AS p FROM ({ANCHORS}) GROUP BY 1, 2, 3) a
    ON r.doc_id = a.doc_id AND r.kind = a.kind AND r.label = a.label WHERE a.p IS NULL OR r.pos < a.p""")
def forward_refs(c):
    return crossref.forward(c, "doc_id").select("doc_id", "kind", "label", "pos", "anchor_pos")


@family.over("papers", f"""SELECT g.kind, g.label, g.num, g.project, count(r.label)::BIGINT AS refs FROM ({REGISTRY}) g LEFT JOIN ({REFS}) r ON r.project = g.project AND r.kind = g.kind AND r.label = g.label GROUP BY 1, 2, 3, 4""")
def figure_inventory(c):
    """JOIN-09, AGG-18."""
    n = crossref.references(c, "project").groupBy("project", "kind", "label").agg(F.count("*").alias("refs"))
    return _registry(c).join(n, ["project", "kind", "label"], "left").select("kind", "label", "num", "project", F.coalesce("refs", F.lit(0)).alias("refs"))


@family.over("papers", f"""SELECT project, label FROM ({REGISTRY}) g WHERE kind = 'fig' AND NOT EXISTS (SELECT 1 FROM ({REFS}) r WHERE r.project = g.project AND r.kind = 'fig' AND contains(r.label, g.label))""")
def unreferenced_figures(c):
    """JOIN-07: a label counts as referenced if a reference of its project has it as a part.

    The parts of each reference's label are what is joined, so that the join
    is one of equal keys.
    """
    refs = crossref.references(c, "project").filter("kind = 'fig'").select("project", "label").distinct()
    n = F.length("label")
    parts = refs.select("project", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), n), lambda a: F.transform(F.sequence(F.lit(1), n - a + 1), lambda k: F.substr("label", a, k))))).alias("label")).distinct()
    return _registry(c).filter("kind = 'fig'").join(parts, ["project", "label"], "left_anti").select("project", "label")


_WRITTEN = r"((?:\d+|S\d+)[a-z]?(?:(?:\s*[-–—,&]\s*(?:and\s+)?|\s+and\s+)(?:(?:\d+|S\d+)[a-z]?|[a-z]\b))*)"
_WRITTEN_SQL = {"fig": r"(?i)\b(Figures?|Figs?\.?)\s+" + _WRITTEN, "tbl": r"(?i)\b(Tables?|Tabs?\.?)\s+" + _WRITTEN, "eq": r"(?i)\b(Equations?|Eqs?\.?)\s+" + _WRITTEN.replace(r"(?:\d+|S\d+)", r"(?:\d+)")}


@family.over("papers", " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, match, g2 AS list, pos::INT AS pos FROM ({duck_matches('doc_id', p, groups=2)})" for k, p in _WRITTEN_SQL.items()))
def hardcoded_refs(c):
    return crossref.written_references(c, "doc_id")


@family.over("part", """, v AS (SELECT p_partkey, p_size % 5 + 1 AS a, p_size % 5 + 1 + p_partkey % 4 AS b FROM c)
    SELECT p_partkey, (unnest(range(a, b + 1)))::INT AS num, p_partkey % 2 = 0 AS is_supp FROM v UNION ALL SELECT p_partkey, (b + 2)::INT, false FROM v""".replace(", v AS", "+ v AS", 1))
def ref_list_expand(c):
    a = F.col("p_size") % 5 + 1
    b = a + F.col("p_partkey") % 4
    supp = F.when(F.col("p_partkey") % 2 == 0, "S").otherwise("")
    written = F.concat(supp, a.cast("string"), F.lit("–"), supp, b.cast("string"), F.lit(" and "), (b + 2).cast("string"))
    return c.select("p_partkey", F.explode(crossref.numbers(written)).alias("n")).select("p_partkey", "n.num", "n.is_supp")


@family.over("papers", f"""SELECT r.doc_id, r.kind, n.num, g.label FROM (SELECT doc_id, project, kind, unnest([1, 2, 3]) AS num FROM (SELECT doc_id, project, 'fig' AS kind FROM c)) n0, LATERAL (SELECT n0.num AS num) n, LATERAL (SELECT n0.doc_id, n0.project, n0.kind) r
    JOIN ({REGISTRY}) g ON g.project = r.project AND g.kind = 'fig' AND g.num = n.num AND NOT g.is_supp""")
def hardcoded_to_labels(c):
    """JOIN-05: written numbers with their labels."""
    refs = crossref.written_references(c, "doc_id", "project").filter("kind = 'fig'")
    n = refs.select("doc_id", "project", "kind", F.explode(crossref.numbers("list")).alias("n")).select("doc_id", "project", "kind", "n.num", "n.is_supp")
    return n.filter("NOT is_supp").join(_registry(c), ["project", "kind", "num", "is_supp"]).select("doc_id", "kind", "num", "label")


def _splice_sql() -> str:
    shown = f"SELECT label, {SHOWN} AS d FROM ({REGISTRY}) WHERE kind = 'fig' AND starts_with(label, 'f')"
    one = "SELECT c.doc_id, c.text, CASE WHEN s.d IS NULL THEN c.text ELSE replace(c.text, '@fig:f' || (c.doc_id + c.doc_id % 2), s.d) END AS t FROM c LEFT JOIN shown s ON s.label = 'f' || (c.doc_id + c.doc_id % 2)"
    return f"+ shown AS ({shown}), one AS ({one}) SELECT c.doc_id, CASE WHEN s.d IS NULL THEN c.t ELSE replace(c.t, '@fig:f' || (c.doc_id - c.doc_id % 2), s.d) END AS text FROM one c LEFT JOIN shown s ON s.label = 'f' || (c.doc_id - c.doc_id % 2)"


@family.over("papers", _splice_sql())
def ref_splice(c):
    labels = _registry(c).filter("kind = 'fig'").select("kind", "label", "num", "is_supp")
    return crossref.spliced(c, labels, "doc_id")


@family.over("papers", r"""SELECT doc_id, len(regexp_extract_all(text, '(?i)@(fig|tbl|eq):([a-zA-Z0-9_-]+)'))::INT AS dynamic, 3::INT AS written, len(regexp_extract_all(text, '\{#fig:[a-zA-Z0-9_-]+'))::INT AS fig_anchors,
    len(regexp_extract_all(text, '\{#tbl:[a-zA-Z0-9_-]+'))::INT AS tbl_anchors, len(regexp_extract_all(text, '\{#eq:[a-zA-Z0-9_-]+'))::INT AS eq_anchors FROM c""")
def ref_status(c):
    return crossref.status(c, "doc_id")


# -- equations

MATHS = f"""SELECT doc_id, file, 'inline' AS kind, concat('x_', doc_id) AS content, (n + 1)::INT AS line FROM m UNION ALL SELECT doc_id, file, 'inline', 'y', (n + 1)::INT FROM m
    UNION ALL SELECT doc_id, file, 'display', concat('E = ', doc_id), (n + 2)::INT FROM m UNION ALL SELECT doc_id, file, 'display', concat('a + b = ', doc_id), (n + 3)::INT FROM m UNION ALL SELECT doc_id, file, 'inline', 'z', (n + 6)::INT FROM m"""
_M = "+ m AS (SELECT doc_id, file, len(string_split(text, chr(10))) - 6 AS n FROM c) "


@family.over("maths", _M + MATHS)
def equations_extract(c):
    return equations.equations(c, "doc_id", "file")


@family.over("maths", _M + f"SELECT file, count(*)::BIGINT AS total, count(*) FILTER (kind = 'display')::BIGINT AS display, count(*) FILTER (kind = 'inline')::BIGINT AS inline FROM ({MATHS}) GROUP BY ROLLUP (file)")
def equation_stats(c):
    return equations.statistics(equations.equations(c, "doc_id", "file"), "file")

