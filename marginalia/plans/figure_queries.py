"""Queries over images, slides, markdown and conversions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markdown
from ..operators import crossref, figures, merging, slides
from . import relations
from .base import Family, duck_matches, quote

family = Family()
QUERIES, SQL = family.queries, family.sql


@family.over("papers", "SELECT doc_id, project, concat('f', doc_id) AS label, 'fig' AS type, 'cap' AS caption_key FROM c")
def image_registry(c):
    return figures.images(c, "doc_id", "project").select("doc_id", "project", "label", "type", "caption_key")


@family.over("papers", "+ r AS (SELECT doc_id, project, starts_with(file, 'supp') AS s, file_ord FROM c) SELECT doc_id, concat(CASE WHEN s THEN 'S' ELSE '' END, row_number() OVER (PARTITION BY project, s ORDER BY file_ord)) AS number FROM r")
def image_numbers(c):
    labels = crossref.registry(c, "project", "file", "file_ord")
    return figures.numbered(figures.images(c, "doc_id", "project"), labels, "project").select("doc_id", "number")


@family.over("documents", "SELECT doc_id, (length(text) - length(replace(text, chr(10), '')) + 2)::INT AS line, doc_id % 2 = 1 AS exotic FROM c")
def latex_figures(c):
    block = F.concat(F.lit("\\begin{figure}\n\\includegraphics[width=0.5\\textwidth]{a.png}"), F.when(F.col("doc_id") % 2 == 1, "\\subfloat{x}").otherwise(""), F.lit("\n\\end{figure}"))
    return figures.latex_figures(c.select("doc_id", F.concat("text", F.lit("\n"), block).alias("text")), "doc_id").select("doc_id", "line", "exotic")


@family.over("documents", """SELECT doc_id, concat(text, chr(10), CASE doc_id % 3 WHEN 0 THEN concat('![A {nested {cap}} of ', doc_id, '](a.png) {#fig:l', doc_id, ' width=50%}') WHEN 1 THEN '![](b.png)'
    ELSE concat('\\begin{figure}', chr(10), '\\includegraphics{a.png}\\subfloat{x}', chr(10), '\\end{figure}') END, ' end') AS text FROM c""".replace("\\\\", "\\"))
def latex_translated(c):
    """SCL-39: captions with braces inside, blocks without a caption, and blocks that stay."""
    k = F.col("doc_id")
    inner = F.when(k % 3 == 0, F.concat(F.lit("\\includegraphics[width=0.5\\textwidth]{a.png}\n\\caption {A {nested {cap}} of "), k, F.lit("}\n\\label{l"), k, F.lit("}")))
    inner = inner.when(k % 3 == 1, "\\includegraphics{ b.png }").otherwise("\\includegraphics{a.png}\\subfloat{x}")
    block = F.concat(F.lit("\\begin{figure}\n"), inner, F.lit("\n\\end{figure}"))
    return c.select("doc_id", figures.translated(F.concat("text", F.lit("\n"), block, F.lit(" end"))).alias("text"))


@family.over("papers", "SELECT doc_id, 0::INT AS f, 0::INT AS o, (CASE WHEN doc_id % 2 = 0 THEN 210 ELSE 110 END)::INT AS score FROM c")
def image_matches(c):
    own = figures.images(c, "doc_id")
    found = own.withColumn("caption", F.concat(F.lit("Figure 1. "), "caption")).withColumn("label", F.when(F.col("doc_id") % 2 == 0, F.col("label")))
    return figures.matched(own, found, "doc_id")


@family.over("annotated", f"""SELECT doc_id, count(*)::BIGINT AS n, min(pos)::INT AS first FROM (SELECT doc_id, pos FROM ({duck_matches('doc_id', r'\{\+\+([^+]*)\+\+\}')}) UNION ALL SELECT doc_id, pos FROM ({duck_matches('doc_id', r'\{--([^-]*)--\}')}) UNION ALL SELECT doc_id, pos FROM ({duck_matches('doc_id', r'\{~~([^~]*)~>([^~]*)~~\}')})) GROUP BY 1""")
def diff_previews(c):
    return figures.previews(c, "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("pos").alias("first"))


@family.over("papers")
def refs_to_labels(c):
    labels = crossref.registry(c, "project", "file", "file_ord")
    return figures.labelled(c, labels, "doc_id", "project")


@family.over("citing", "SELECT doc_id, concat('P', doc_id % 300) AS key FROM c UNION ALL SELECT doc_id, concat('P', doc_id % 450) FROM c UNION ALL SELECT doc_id, concat('Smith', 1990 + doc_id % 30) FROM c UNION ALL SELECT doc_id, concat('Hidden', doc_id) FROM c UNION ALL SELECT doc_id, unnest(regexp_extract_all(regexp_extract(text, '^([\\s\\S]*)\\nAs shown', 1), '@([a-zA-Z][a-zA-Z0-9_-]*)', 1)) FROM c")
def loose_citations(c):
    return figures.loose_citations(c, "doc_id")


@family.over("changes")
def conflict_text(c):
    texts = c.select("doc_id").distinct().withColumn("text", F.repeat(F.lit("some text of the base. "), 300))
    return figures.conflict_text(merging.conflicts(c, "doc_id"), texts, "doc_id")


def _shown_sql() -> str:
    """The options of each conflict and what stands around it, as the operator writes them out."""
    x = "CASE WHEN type = 'delete' THEN old_text ELSE new_text END"
    what = "CASE type WHEN 'insert' THEN 'Insert: ' WHEN 'delete' THEN 'Delete: ' ELSE 'Replace → ' END"
    option = f"concat('    ', place + 1, '. [', reviewer, '] ', {what}, chr(34), CASE WHEN length({x}) > 60 THEN left({x}, 60) || '...' ELSE {x} END, chr(34))"
    each = f"""SELECT doc_id, conflict, min("start") AS a, max("end") AS b, string_agg({option}, chr(10) ORDER BY place) AS options, repeat('some text of the base. ', 300) AS t FROM g WHERE conflict IS NOT NULL GROUP BY 1, 2"""
    parts = f"""SELECT *, trim(substr(t, greatest(a - 50, 0) + 1, least(a, 50))) AS before, substr(t, a + 1, b - a) AS original, trim(substr(t, b + 1, 50)) AS after FROM ({each})"""
    shown = """concat_ws(chr(10), CASE WHEN before <> '' THEN '  ...' || before END, concat('  [ORIGINAL]: ', chr(34), CASE WHEN original = '' THEN '(insertion point)' ELSE original END, chr(34)), CASE WHEN after <> '' THEN '  ' || after || '...' END, '', '  Options:', options)"""
    return relations.grouped(f"SELECT doc_id, conflict, {shown} AS shown FROM ({parts})")


SQL["conflict_text"] = _shown_sql()


@family.over("changes")
def conflict_markers(c):
    texts = c.select("doc_id").distinct().withColumn("text", F.concat(F.repeat(F.lit("some text of the base. "), 300), F.col("doc_id").cast("string")))
    return figures.conflict_markers(merging.conflicts(c, "doc_id"), texts, "doc_id")


def _marked_sql() -> str:
    """The conflicts of a text from the last to the first, each put into what the ones before gave."""
    option = """concat('======= ', reviewer, chr(10), CASE WHEN type = 'delete' THEN concat('[DELETED: ', chr(34), old_text, chr(34), ']') ELSE new_text END)"""
    each = f"""SELECT doc_id, conflict, min("start") AS s, max("end") AS e, concat('<<<<<<< CONFLICT ', conflict, chr(10), string_agg({option}, chr(10) ORDER BY place), chr(10), '>>>>>>> END ', conflict) AS m FROM g WHERE conflict IS NOT NULL GROUP BY 1, 2"""
    lists = f"SELECT doc_id, list(struct_pack(s := s, e := e, m := m) ORDER BY s DESC, substr(conflict, 2)::INT) AS l FROM ({each}) GROUP BY 1"
    begin = "struct_pack(s := 0, e := 0, m := concat(repeat('some text of the base. ', 300), d.doc_id))"
    put = "lambda a, x: struct_pack(s := x.s, e := x.e, m := concat(left(a.m, x.s), x.m, substr(a.m, x.e + 1)))"
    return relations.grouped(f"SELECT d.doc_id, list_reduce(list_prepend({begin}, coalesce(l, [])), {put}).m AS text FROM (SELECT DISTINCT doc_id FROM c) d LEFT JOIN ({lists}) l ON l.doc_id = d.doc_id")


SQL["conflict_markers"] = _marked_sql()


#: DuckDB: lines with the run of rows that they stand in, the head of the first table of each run, and the columns that are wanted.
_TABLED = r"""+ l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM c),
    r AS (SELECT *, regexp_full_match(t, '\|.+\|') AS bar, regexp_full_match(t, '\|[-:| ]+\|') AS dash FROM l),
    h AS (SELECT *, bar AND coalesce(lead(dash) OVER w, false) AND coalesce(lead(bar, 2) OVER w, false) AS head, sum((NOT bar)::INT) OVER w AS run FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
    b AS (SELECT *, min(n) FILTER (bar AND head) OVER (PARTITION BY doc_id, run) AS top FROM h),
    k AS (SELECT b.*, list_transform(string_split(x.t, '|'), lambda y, i: i > 1 AND i < len(string_split(x.t, '|')) AND regexp_matches(lower(y), 'prior|shape')) AS wanted FROM b LEFT JOIN b x ON x.doc_id = b.doc_id AND x.n = b.top),
    d AS (SELECT doc_id, n, t, bar AND n > top + 1 AND list_bool_or(wanted) AS done, list_transform(string_split(t, '|'), lambda y, i: CASE WHEN coalesce(wanted[i], false) AND trim(y) <> '' AND left(trim(y), 1) NOT IN ('$', chr(92)) THEN concat(' ', __, ' ') ELSE y END) AS cells FROM k)
    SELECT doc_id, string_agg(CASE WHEN done THEN array_to_string(cells, '|') ELSE t END, chr(10) ORDER BY n) || CASE WHEN arg_max(coalesce(done, false), n) THEN chr(10) ELSE '' END AS text FROM d GROUP BY 1"""


def _tabled_sql() -> str:
    """Names of distributions as formulas, one after the other."""
    cell = "trim(y)"
    for name, formula in (("Half-Normal", r"$\\text{Half-Normal}(\1)$"), ("Normal", r"$\\mathcal{N}(\1)$"), ("Student-t", ""), ("Gamma", r"$\\text{Gamma}(\1)$"), ("Exponential", r"$\\text{Exp}(\1)$")):
        pattern, formula = (r"\(([^)]+)\)", formula) if formula else (r"\((\d+),\s*([^)]+)\)", r"$t_{\1}(\2)$")
        cell = f"regexp_replace({cell}, '{name}{pattern}', '{formula}', 'g')"
    return _TABLED.replace("__", cell)


@family.over("priors", _tabled_sql())
def tables_kept_whole(c):
    """SCL-38: columns of priors and shapes."""
    return c.select("doc_id", markdown.tables_kept_whole("text", ["Prior", "shape"]).alias("text"))


@family.over("documents")
def slides_parse(c):
    deck = F.concat(F.lit("---\ntitle: t\n---\n# One {.dark}\n- a\n  - b\n- c\n::: step\n"), F.col("source"), F.lit("\n:::\n---\n## Two\n"), F.col("text"))
    return slides.slides(c.select("doc_id", deck.alias("text")), "doc_id").select("doc_id", "slide", "title", "level", F.size("steps").alias("steps"), F.size("reveals").alias("reveals"), "classes")


@family.over("documents", r"SELECT doc_id, concat(p, 'tail of ', lang) AS line, p AS prefix, concat('tail of ', lang) AS content FROM (SELECT doc_id, lang, CASE doc_id % 4 WHEN 0 THEN '## ' WHEN 1 THEN '  - ' WHEN 2 THEN '12. ' ELSE '> ' END AS p FROM c)")
def markdown_prefix(c):
    p = F.element_at(F.array(F.lit("## "), F.lit("  - "), F.lit("12. "), F.lit("> ")), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = c.select("doc_id", F.concat(p, F.lit("tail of "), "lang").alias("line"))
    return rows.select("doc_id", "line", markdown.prefix("line").alias("p")).select("doc_id", "line", "p.*")


@family.over("part", "SELECT p_partkey, concat('a/b of Σ ', p_partkey, '·x _y') AS shown FROM c")
def math_simplified(c):
    return c.select("p_partkey", markdown.plain_math(F.concat(F.lit(r"\frac{a}{b} \text{of} \sum_i "), "p_partkey", F.lit(r"\cdot{x} \_y"))).alias("shown"))


#: The marks as RE2 takes them: without back-references, with the kinds of emphasis one by one.
_PLAIN = "text"
for _a, _b in [(r"(?m)^---[\s\S]*?---\n*", ""), (r"(?m)^#{1,6}\s+", ""), (r"\*\*(.*?)\*\*|__(.*?)__", r"\1\2"), (r"\*(.*?)\*|_(.*?)_", r"\1\2"), (r"\[([^\]]+)\]\([^)]+\)", r"\1"), (r"!\[([^\]]*)\]\([^)]+\)", ""), (r"`([^`]+)`", r"\1"), (r"```[\s\S]*?```", ""), (r"(?m)^>\s*", ""), (r"(?m)^[-*_]{3,}\s*$", ""), (r"(?m)^[\s]*[-*+]\s+", ""), (r"(?m)^[\s]*\d+\.\s+", ""), (r"\|", " "), (r"(?m)^[-:]+$", ""), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", "")]:
    _PLAIN = f"regexp_replace({_PLAIN}, {quote(_a)}, {quote(_b)}, 'g')"


@family.over("documents", f"SELECT doc_id, {_PLAIN} AS text FROM c")
def markdown_stripped(c):
    return c.select("doc_id", markdown.plain("text").alias("text"))


_TIDY = "text || ' {--a--} {++b++} {++c++}{--d--} {--  --} end'"
for _a, _b in [(r"\{--(.+?)--\}\s*\{\+\+(.+?)\+\+\}", r"{~~\1~>\2~~}"), (r"\{\+\+(.+?)\+\+\}\s*\{--(.+?)--\}", r"{~~\2~>\1~~}"), (r"\{--([^}]+?)~>([^}]+?)~~\}", r"{~~\1~>\2~~}"), (r"\{~~([^~]+)\s*--\}", r"{--\1--}"), (r"\{\+\+([^+]+)~~\}", r"{++\1++}"), (r"\{--\s*--\}", ""), (r"\{\+\+\s*\+\+\}", "")]:
    _TIDY = f"regexp_replace({_TIDY}, {quote(_a)}, {quote(_b)}, 'g')"


@family.over("documents", f"SELECT doc_id, {_TIDY} AS text FROM c")
def annotations_tidied(c):
    return c.select("doc_id", markdown.tidy(F.concat("text", F.lit(" {--a--} {++b++} {++c++}{--d--} {--  --} end"))).alias("text"))


@family.over("part", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '50%' WHEN 1 THEN '100%' WHEN 2 THEN '8cm' END AS width FROM c")
def latex_widths(c):
    w = F.element_at(F.array(F.lit(r"0.5\textwidth"), F.lit(r"\linewidth"), F.lit("8cm"), F.lit("2em")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return c.select("p_partkey", markdown.latex_width(w).alias("width"))


