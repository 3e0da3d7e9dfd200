"""Queries over whole documents: counts, style, spelling, sections, journals, similarity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import journals, lines, sections, style

from .base import Family, duck_lines, table

family = Family()
QUERIES, SQL = family.queries, family.sql

PLAIN = "len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))"


def _counted(text: str = "text") -> str:
    steps = [(r"(?m)^---[\s\S]*?---", "", ""), (r"!\[.*?\]\(.*?\)", "", "g"), (r"\[([^\]]+)\]\([^)]+\)", r"\1", "g"), (r"#+\s*", "", "g"), (r"\*\*|__|[*_`]", "", "g"), (r"```[\s\S]*?```", "", "g"), (r"\{[^}]+\}", "", "g"), (r"@\w+:\w+", "", "g"), (r"@\w+", "", "g"), (r"\|[^|]+\|", " ", "g"), (r"[-=]{3,}", "", "g")]
    for a, b, g in steps:
        text = f"regexp_replace({text}, '{a}', '{b}', 'g')" if g or True else text
    return f"len(list_filter(string_split_regex({text}, '\\s+'), lambda w: w <> ''))"


@family.over("papers", f"SELECT doc_id, {_counted()}::INT AS words, {PLAIN}::INT AS plain_words FROM c")
def word_count(c):
    return c.select("doc_id", X.count_words("text").alias("words"), X.plain_word_count("text").alias("plain_words"))


@family.over("papers", f"SELECT project, file, sum({PLAIN})::BIGINT AS words FROM c GROUP BY ROLLUP (project, file)")
def word_count_rollup(c):
    return sections.word_counts(c, "project", "file")


@family.over("papers", f"SELECT project, sum({PLAIN}) > 20000 AS over_limit, sum({PLAIN})::BIGINT AS words FROM c GROUP BY project")
def word_limit_check(c):
    return c.groupBy("project").agg(F.sum(X.plain_word_count("text")).alias("words")).withColumn("over_limit", F.col("words") > 20000)


@family.over("papers", r"""SELECT project, count(*)::BIGINT AS files, sum(len(regexp_extract_all(text, '!\[.*?\]\(.*?\)')))::BIGINT AS figures, round(sum(len(regexp_extract_all(text, '(?m)^\|[^|]+\|'))) / 5.0)::BIGINT AS tables FROM c GROUP BY project""")
def project_stats(c):
    """AGG-11."""
    return c.groupBy("project").agg(
        F.count("*").alias("files"),
        F.sum(F.regexp_count("text", F.lit(r"!\[.*?\]\(.*?\)"))).alias("figures"),
        F.round(F.sum(F.regexp_count("text", F.lit(r"(?m)^\|[^|]+\|"))) / 5.0).cast("long").alias("tables"),
    )


@family.over("annotated", f"""SELECT source, lang, count(*)::BIGINT AS docs, sum({PLAIN})::BIGINT AS words, sum(len(regexp_extract_all(text, '(?s)\\{{\\+\\+(.+?)\\+\\+\\}}')))::BIGINT AS inserts FROM c GROUP BY GROUPING SETS ((source, lang), (source), ())""")
def status_dashboard(c):
    """AGG-15."""
    n = c.select("source", "lang", X.plain_word_count("text").alias("w"), F.regexp_count("text", F.lit(r"(?s)\{\+\+(.+?)\+\+\}")).alias("i"))
    return n.groupingSets([["source", "lang"], ["source"], []], "source", "lang").agg(F.count("*").alias("docs"), F.sum("w").alias("words"), F.sum("i").alias("inserts"))


@family.over("documents", r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\t', '    ', 'g'), ' +', ' ', 'g'), '^\s+|\s+$', '', 'g') AS text FROM c")
def normalized_whitespace(c):
    return c.select("doc_id", X.normalize_whitespace("text").alias("text"))


@family.over("documents", "SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS escaped, text AS back FROM c")
def escape_xml(c):
    e = X.escape_xml("text")
    return c.select("doc_id", e.alias("escaped"), X.unescape_xml(e).alias("back"))


@family.over("documents", r"""SELECT doc_id, replace(replace(replace(regexp_replace(replace(text, '\', '\textbackslash{}'), '([#$%&_{}])', '\\\1', 'g'), '^', '\textasciicircum{}'), '~', '\textasciitilde{}'), chr(10), ' ') AS text FROM c""")
def escape_latex(c):
    return c.select("doc_id", X.escape_latex("text").alias("text"))


SLUG = "regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@family.over("documents", f"""SELECT doc_id, CASE WHEN s = '' THEN 'paper' WHEN length(s) <= 80 THEN s WHEN instr(left(s, 80), '-') > 0 AND 80 - instr(reverse(left(s, 80)), '-') >= 40 THEN left(s, 80 - instr(reverse(left(s, 80)), '-')) ELSE left(s, 80) END AS slug,
    left(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 30) || '.md' AS file FROM (SELECT doc_id, text, {SLUG} AS s FROM c)""")
def slugify(c):
    return c.select("doc_id", X.slug("text").alias("slug"), X.header_file("text").alias("file"))


@family.over("documents", r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '[{}\\]', '', 'g'), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS text FROM c")
def normalize_title(c):
    return c.select("doc_id", X.for_matching("text").alias("text"))


@family.over("papers", r"SELECT doc_id, regexp_replace(text, '\A---\n[\s\S]*?\n---\n?', '') AS text FROM c")
def frontmatter_stripped(c):
    return c.select("doc_id", X.without_frontmatter("text").alias("text"))


@family.over("papers", r"SELECT doc_id, concat('Paper ', doc_id) AS title FROM c")
def paper_title(c):
    return c.select("doc_id", sections.title("text").alias("title"))


@family.over("documents", f"SELECT doc_id, line::INT AS line, line_text FROM ({duck_lines('doc_id')}) WHERE regexp_matches(line_text, '(?i)licen[sc]e')")
def search_lines(c):
    return lines.search(c, "licen[sc]e", "doc_id", ignore_case=True)


# -- style

_B = r"\b"
_RULES = {
    "passive-voice": ("info", r"(?i)\b(is|are|was|were|be|been|being)\s+(being\s+)?\w+ed\b"),
    "weasel-words": ("warning", r"(?i)\b(very|really|quite|extremely|fairly|rather|somewhat|just)\b"),
    "weak-start": ("info", r"(?mi)^\s*(There (is|are|was|were)|It is)\b"),
    "split-infinitive": ("info", r"(?i)\bto\s+(\w+ly)\s+\w+\b"),
    "cliches": ("warning", r"(?i)\b(at the end of the day|in terms of|it goes without saying|needless to say|as a matter of fact|first and foremost|last but not least)\b"),
    "hedging": ("info", r"(?i)\b(seems to|appears to|tends to|might|may|could possibly|would seem)\b"),
    "redundancy": ("warning", r"(?i)\b(basic fundamentals|end result|free gift|future plans|past history|completely unique|absolutely essential|close proximity|each and every|first began|true fact|advance planning|final outcome)\b"),
    "first-person": ("info", r"(?i)\b(I|we|my|our)\b"),
    "prove": ("warning", r"(?i)\b(prove[ds]?|proof)\b"),
    "obviously": ("warning", r"(?i)\b(obviously|clearly|of course)\b"),
}
_SKIP = r"line_text <> '' AND NOT starts_with(t, '```') AND NOT starts_with(t, '---') AND NOT (regexp_matches(t, '^[#\-*>|]') AND length(t) < 5)"
_PROSE = f"SELECT * FROM (SELECT *, regexp_replace(line_text, '^\\s+|\\s+$', '', 'g') AS t FROM ({duck_lines('doc_id, file')})) WHERE {_SKIP}"
_SENTENCE = r"""SELECT doc_id, file, line, 'sentence-length' AS rule, 'warning' AS severity, match FROM (SELECT doc_id, file, line, unnest(regexp_extract_all(line_text, '[^.!?]*[.!?]')) AS match FROM l)
    WHERE len(string_split_regex(regexp_replace(match, '^\s+|\s+$', '', 'g'), '\s+')) > 40"""
ISSUES = " UNION ALL ".join(f"SELECT doc_id, file, line, '{k}' AS rule, '{s}' AS severity, unnest(regexp_extract_all(line_text, '{p}')) AS match FROM l" for k, (s, p) in _RULES.items()) + " UNION ALL " + _SENTENCE
_WITH = f"+ l AS ({_PROSE}), i AS ({ISSUES}) "


def _issues(c):
    # the two rules that the SQL of the other side can't say are tested on their own
    return style.issues(c, "doc_id", "file").filter(~F.col("rule").isin("duplicate-words", "significant"))


@family.over("prose", _WITH + "SELECT doc_id, line::INT AS line, rule, severity, match FROM i")
def grammar_issues(c):
    return _issues(c).select("doc_id", "line", "rule", "severity", "match")


@family.over("prose", _WITH + "SELECT severity, rule, count(*)::BIGINT AS n FROM i GROUP BY GROUPING SETS ((severity), (rule), ())")
def grammar_summary(c):
    return style.summary(_issues(c))


@family.over("prose", _WITH + "SELECT file, count(*)::BIGINT AS n FROM i WHERE severity <> 'info' GROUP BY file")
def grammar_severity(c):
    return style.at_least(_issues(c), "warning").groupBy("file").agg(F.count("*").alias("n"))


@family.over("prose", _WITH + "SELECT rule, count(*)::BIGINT AS n FROM i WHERE lower(match) NOT IN ('very', 'clearly', 'we') GROUP BY rule")
def grammar_with_dictionary(c):
    words = c.sparkSession.createDataFrame([("very",), ("clearly",), ("we",)], "word string")
    found = style.issues(c, "doc_id", dictionary=words).filter(~F.col("rule").isin("duplicate-words", "significant"))
    return found.groupBy("rule").agg(F.count("*").alias("n"))


@family.over("prose")
def grammar_duplicates_and_significance(c):
    """The rules with a back-reference and a look-ahead."""
    return style.issues(c, "doc_id").filter(F.col("rule").isin("duplicate-words", "significant")).select("doc_id", "line", "rule", "match")


_CLEAN = "line_text"
for _a, _b2 in [(r"`[^`]+`", ""), (r"\[([^\]]+)\]\([^)]+\)", r"\1"), (r"!\[[^\]]*\]\([^)]+\)", ""), (r"@(fig|tbl|eq):\w+", ""), (r"\{[^}]+\}", ""), (r"https?://\S+", ""), (r"\$[^$]+\$", ""), (r"\\\w+", ""), (r"[#*_~`>|]", " ")]:
    _CLEAN = f"regexp_replace({_CLEAN}, '{_a}', '{_b2}', 'g')"
_W = "[a-zA-Z][a-zA-Z'']*[a-zA-Z]|[a-zA-Z]"
TOKENS = f"""SELECT doc_id, line, w AS word, place FROM (SELECT doc_id, line, unnest(ws) AS w, unnest(range(len(ws))) AS place FROM (SELECT doc_id, line, regexp_extract_all({_CLEAN}, '{_W}') AS ws FROM ({duck_lines('doc_id')})
    WHERE line_text <> '' AND NOT starts_with(trim(line_text), 'http') AND NOT starts_with(trim(line_text), '/'))) WHERE length(w) >= 3 AND NOT regexp_matches(w, '^[A-Z]+$') AND NOT regexp_matches(w, '(?i)^(md|tex|png|jpg|pdf|csv|js|py|html|css|yaml|json|docx|bib)$') AND NOT regexp_matches(w, '[a-z][A-Z]')"""
DICTIONARY = f"SELECT DISTINCT lower(unnest(regexp_extract_all(text, '{_W}'))) AS word FROM benchmark"


def _dictionary(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(style.WORD), F.lit(0))).alias("word")).select(F.lower("word").alias("word")).distinct()


@family.over("documents", f"SELECT doc_id, line::INT AS line, word FROM ({TOKENS})")
def spelling_tokens(c):
    return style.words(c, "doc_id").select("doc_id", "line", "word")


@family.over(None, f"WITH c AS (SELECT * FROM documents), t AS ({TOKENS}), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(word) ORDER BY line, place) AS r FROM t) WHERE r = 1) SELECT doc_id, line::INT AS line, word, regexp_matches(word, '^[A-Z][a-z]{{2,}}$') AS is_name FROM f WHERE lower(word) NOT IN ({DICTIONARY})")
def spelling_unknown(spark, sf_dir):
    found = style.words(table(spark, sf_dir, "documents"), "doc_id")
    return style.unknown(found, _dictionary(spark, sf_dir), "doc_id").select("doc_id", "line", "word", "is_name")


#: An affix file; the flags of a stem are told by its length.
AFFIX_FILE = """SFX S Y 3
SFX S y ies [^aeiou]y
SFX S 0 s [^sxzhy]
SFX S 0 es [sxzh]
SFX G Y 2
SFX G e ing e
SFX G 0 ing [^e]
SFX N N 1
SFX N 0 en .
PFX U Y 1
PFX U 0 un .
"""
_FLAGS = "CASE WHEN length(word) % 2 = 0 THEN 'SG' ELSE 'SNU' END"
#: DuckDB goes the other way: all forms of all stems.
_FORMS = f"""stems AS (SELECT word, {_FLAGS} AS flags FROM ({DICTIONARY})),
    s AS (SELECT 'S' AS flag, true AS x, 'y' AS strip, 'ies' AS affix, '[^aeiou]y$' AS cond UNION ALL VALUES ('S', true, '', 's', '[^sxzhy]$'), ('S', true, '', 'es', '[sxzh]$'), ('G', true, 'e', 'ing', 'e$'), ('G', true, '', 'ing', '[^e]$'), ('N', false, '', 'en', '.$')),
    ends AS (SELECT word, flags, x, concat(left(word, length(word) - length(strip)), affix) AS form FROM stems JOIN s ON contains(flags, flag) AND regexp_matches(word, cond)),
    forms AS (SELECT word AS form FROM stems UNION SELECT form FROM ends UNION SELECT concat('un', word) FROM stems WHERE contains(flags, 'U') UNION SELECT concat('un', form) FROM ends WHERE x AND contains(flags, 'U'))"""


@family.over(None, f"WITH c AS (SELECT * FROM documents), t AS ({TOKENS}), {_FORMS}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(word) ORDER BY line, place) AS r FROM t) WHERE r = 1) SELECT doc_id, line::INT AS line, word FROM f WHERE lower(word) NOT IN (SELECT form FROM forms)")
def spelling_affixes(spark, sf_dir):
    """DIF-16 with a stem dictionary and affix rules."""
    rules = style.affix_rules(spark.createDataFrame([(AFFIX_FILE,)], "text string"))
    flags = F.when(F.length("word") % 2 == 0, F.array(F.lit("S"), F.lit("G"))).otherwise(F.array(F.lit("S"), F.lit("N"), F.lit("U")))
    stems = _dictionary(spark, sf_dir).withColumn("flags", flags)
    found = style.words(table(spark, sf_dir, "documents"), "doc_id")
    return style.unknown_by_affixes(found, stems, rules, "doc_id").select("doc_id", "line", "word")


_NAMES = "SELECT DISTINCT lower(unnest(string_split(p_name, ' '))) AS w FROM part"


@family.over(None, f"""WITH d AS ({DICTIONARY}), wrong AS (SELECT DISTINCT lower(r_name) AS w FROM region UNION SELECT DISTINCT lower(word) FROM ({TOKENS.replace('FROM c', 'FROM benchmark').replace('doc_id', 'item_id')}) WHERE length(word) <= 4 AND lower(word) NOT IN (SELECT word FROM d WHERE length(word) > 4))
    SELECT w AS wrong, word, levenshtein(w, word)::INT AS distance FROM (SELECT w, word, row_number() OVER (PARTITION BY w ORDER BY levenshtein(w, word), word) AS r FROM wrong, d WHERE levenshtein(w, word) BETWEEN 1 AND 2) WHERE r <= 5""")
def spelling_suggest(spark, sf_dir):
    d = _dictionary(spark, sf_dir)
    b = table(spark, sf_dir, "benchmark")
    long_words = d.filter(F.length("word") > 4)
    short = style.words(b, "item_id").filter(F.length("word") <= 4).select(F.lower("word").alias("word")).distinct().join(long_words, "word", "left_anti")
    wrong = table(spark, sf_dir, "region").select(F.lower("r_name").alias("word")).union(short).distinct()
    return style.suggestions(wrong, d).select("wrong", "word", "distance")


def unknown_words(documents, dictionary):
    """word: the distinct words of documents, in lower case, that the dictionary lacks."""
    return style.words(documents, "doc_id").select(F.lower("word").alias("word")).distinct().join(dictionary, "word", "left_anti")


@family.over(None, f"""WITH c AS (SELECT * FROM documents), d AS ({DICTIONARY}), wrong AS (SELECT DISTINCT lower(word) AS w FROM ({TOKENS}) WHERE lower(word) NOT IN (SELECT word FROM d))
    SELECT w AS wrong, word, levenshtein(w, word)::INT AS distance FROM (SELECT w, word, row_number() OVER (PARTITION BY w ORDER BY levenshtein(w, word), word) AS r FROM wrong, d WHERE abs(length(w) - length(word)) <= 2 AND levenshtein(w, word) BETWEEN 1 AND 2) WHERE r <= 5""")
def spelling_suggest_documents(spark, sf_dir):
    """Suggestions for every unknown word of documents."""
    d = _dictionary(spark, sf_dir)
    return style.suggestions(unknown_words(table(spark, sf_dir, "documents"), d), d).select("wrong", "word", "distance")


# -- sections

@family.over("papers", f"SELECT doc_id, line::INT AS line, length(regexp_extract(line_text, '^(#+)', 1))::INT AS level, trim(regexp_extract(line_text, '^#+\\s+(.+)$', 1)) AS title FROM ({duck_lines('doc_id')}) WHERE regexp_matches(line_text, '^#+\\s+.+$')")
def headings(c):
    return sections.headings(c, "doc_id")


@family.over("papers", "SELECT doc_id, 'a.md' AS section, 'part a' AS content FROM c UNION ALL SELECT doc_id, 'b.md', concat('part b ', doc_id) FROM c")
def section_split(c):
    return sections.split_by_markers(c, "doc_id")


@family.over("papers", """SELECT doc_id, header, length(content)::INT AS n FROM (SELECT doc_id, 'Introduction' AS header, array_to_string(list_filter(string_split(coalesce(regexp_extract(text, '(?s)# Introduction\\n(.*)\\n## Methods', 1), ''), chr(10)), lambda l: l <> ''), chr(10)) AS content FROM c)""")
def section_by_heading(c):
    return sections.split_by_headings(c, "doc_id").filter("header = 'Introduction'").select("doc_id", "header", F.length("content").alias("n"))


@family.over("papers", "SELECT doc_id, title, CASE title WHEN 'Introduction' THEN 'intro.md' WHEN 'Methods' THEN 'methods.md' END AS file FROM (SELECT doc_id, unnest(['Introduction', 'Methods', 'Results']) AS title FROM c)")
def heading_match(c):
    config = c.sparkSession.createDataFrame([("intro.md", "Introduction", [], 1), ("methods.md", "Materials and Methods", ["methods"], 2), ("disc.md", "Discussion", [], 3)], "file string, header string, aliases array<string>, ord int")
    return sections.matched(sections.headings(c, "doc_id"), config).select("doc_id", "title", "file")


_BOUNDS = "b0 AS (SELECT user_id, event_id, (event_id * 13 % 5000)::BIGINT AS start FROM c), b1 AS (SELECT user_id, start, min(event_id) AS event_id FROM b0 GROUP BY 1, 2), b AS (SELECT user_id, concat('s', event_id) AS file, start, coalesce(lead(start) OVER (PARTITION BY user_id ORDER BY start), 6000) AS \"end\" FROM b1)"


def _bounds(c):
    b = c.select("user_id", (F.col("event_id") * 13 % 5000).alias("start"), "event_id").groupBy("user_id", "start").agg(F.min("event_id").alias("event_id"))
    return sections.boundaries(b.withColumn("doc_length", F.lit(6000).cast("long")), "user_id", "doc_length").select("user_id", F.concat(F.lit("s"), "event_id").alias("file"), "start", "end")


@family.over("events", "+ " + _BOUNDS + " SELECT * FROM b")
def section_boundaries(c):
    return _bounds(c)


@family.over("events", "+ " + _BOUNDS + """, p AS (SELECT user_id, event_id, event_id * 29 % 6000 AS pos FROM c), f AS (SELECT user_id, min(start) AS first FROM b GROUP BY 1)
    SELECT p.user_id, p.event_id, b.file FROM p LEFT JOIN f ON f.user_id = p.user_id LEFT JOIN b ON b.user_id = p.user_id AND greatest(p.pos, coalesce(f.first, p.pos)) >= b.start AND greatest(p.pos, coalesce(f.first, p.pos)) < b."end" """)
def anchor_section_range_join(c):
    points = c.select("user_id", "event_id", (F.col("event_id") * 29 % 6000).alias("pos"))
    return sections.located(points, _bounds(c), "user_id").select("user_id", "event_id", "file")


@family.over("papers", "SELECT project, string_agg(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10) || chr(10) ORDER BY file_ord) AS text FROM c GROUP BY project")
def combined_paper(c):
    return sections.combined(c, "project", "file_ord")


@family.over("documents", "SELECT source, count(*) FILTER (length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 50)::BIGINT AS empty FROM c GROUP BY source")
def empty_sections(c):
    return c.groupBy("source").agg(F.count_if(X.section_is_empty("text")).alias("empty"))


# -- journals

PROFILES = ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, (int, bool)) else str(v) if isinstance(v, list) else f"'{v}'" for v in p) + ")" for p in journals.PROFILES)
_MEASURED = f"""m AS (SELECT doc_id, {_counted()}::INT AS words, len(list_distinct(regexp_extract_all(text, '@(\\w+)', 1)))::INT AS refs, len(regexp_extract_all(text, '!\\[.*?\\]\\(.*?\\)'))::INT AS figures,
    list_transform(regexp_extract_all(text, '(?m)^#+\\s+(.+)$', 1), lambda h: lower(h)) AS headings FROM c), p AS (SELECT * FROM (VALUES {PROFILES}) AS v(id, name, main_max, abstract_max, ref_max, doi_required, fig_max, sections))"""


@family.over("papers", "+ " + _MEASURED + """ SELECT doc_id, id AS journal, words, refs, figures, ((coalesce(words > main_max, false))::INT + (coalesce(refs > ref_max, false))::INT + (coalesce(figures > fig_max, false))::INT)::INT AS errors FROM m, p""")
def journal_validate(c):
    return journals.validated(c, journals.profiles(c.sparkSession), "doc_id").select("doc_id", "journal", "words", "refs", "figures", "errors")


@family.over("papers", "+ " + _MEASURED + " SELECT doc_id, id AS journal, list_filter(sections, lambda s: NOT list_bool_or(list_transform(headings, lambda h: contains(h, lower(s))))) AS missing_sections FROM m, p")
def journal_missing_sections(c):
    return journals.validated(c, journals.profiles(c.sparkSession), "doc_id").select("doc_id", "journal", "missing_sections")


@family.over(None, f"SELECT id, name, main_max::INT AS main_max, abstract_max::INT AS abstract_max, doi_required FROM (VALUES {PROFILES}) AS v(id, name, main_max, abstract_max, ref_max, doi_required, fig_max, sections)")
def journal_profiles(spark, sf_dir):
    return journals.profiles(spark).select("id", "name", "main_max", "abstract_max", "doi_required")


# -- similarity of versions

def _next_of_source(c):
    """Documents with the next one of their source: ids are put in order by themselves, the texts join them."""
    pairs = c.select("doc_id", F.lead("doc_id").over(Window.partitionBy("source").orderBy("doc_id")).alias("other")).filter("other IS NOT NULL")
    return pairs.join(c.select("doc_id", "text"), "doc_id").join(c.select(F.col("doc_id").alias("other"), F.col("text").alias("other_text")), "other")


_SIM = "list_filter(string_split_regex(lower({0}), '\\s+'), lambda w: length(w) > 2)"


@family.over("documents", f"""+ p AS (SELECT source, doc_id, text, lead(doc_id) OVER w AS other, lead(text) OVER w AS other_text FROM c WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
    s AS (SELECT doc_id, other, list_distinct({_SIM.format('text')}) AS a, {_SIM.format('other_text')} AS b FROM p WHERE other IS NOT NULL)
    SELECT doc_id, other, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_filter(b, lambda w: list_contains(a, w))) / greatest(len(a), len(b)) END, 9) AS similarity FROM s""")
def similarity_pairs(c):
    return _next_of_source(c).select("doc_id", "other", F.round(X.similarity("text", "other_text"), 9).alias("similarity"))


@family.over("documents", f"""+ p AS (SELECT source, doc_id, text, lead(doc_id) OVER w AS other, concat(text, ' ', lead(text) OVER w) AS other_text FROM c WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
    s AS (SELECT doc_id, other, list_distinct({_SIM.format('text')}) AS a, {_SIM.format('other_text')} AS b FROM p WHERE other IS NOT NULL)
    SELECT doc_id, other FROM s WHERE len(a) > 0 AND len(b) > 0 AND len(list_filter(b, lambda w: list_contains(a, w))) / greatest(len(a), len(b)) > 0.5""")
def base_match(c):
    """DIF-10."""
    p = _next_of_source(c).withColumn("other_text", F.concat("text", F.lit(" "), "other_text"))
    return p.filter(X.similarity("text", "other_text") > 0.5).select("doc_id", "other")


@family.over("papers", r"SELECT doc_id, ['author', 'title'] AS names FROM c")
def template_variables(c):
    t = F.concat(F.lit("by {{author}} on {{title}} by {{author}} "), "text")
    return c.select("doc_id", X.variables(t).alias("names"))


@family.over("documents", r"SELECT doc_id, regexp_replace(regexp_replace(concat('author: Ann Lee', chr(10), 'By ann lee, see @Lee2020.', chr(10), text), '(?m)^(author|authors|affiliation|affiliations|email|orcid):.*\n?', '', 'g'), '(?i)\bAnn Lee\b', '[AUTHOR]', 'g').regexp_replace('(?i)@Lee(\d{4})', '@AUTHOR\1', 'g') AS text FROM c")
def anonymize(c):
    t = F.concat(F.lit("author: Ann Lee\nBy ann lee, see @Lee2020.\n"), "text")
    return c.select("doc_id", X.anonymized(t, ["Ann Lee"]).alias("text"))


#: DuckDB: the texts under names of files, four to a project; every third begins with a heading of level 2, every other of these has one of level 1 behind.
_NAMED = """t AS (SELECT doc_id, doc_id // 4 AS project, concat('parts/', doc_id % 4, '_more-Words_', doc_id, '.md') AS file,
    CASE doc_id % 3 WHEN 0 THEN concat('## Aims of ', doc_id, '  ', chr(10), coalesce(text, ''), chr(10), CASE WHEN doc_id % 2 = 0 THEN '# Late' ELSE '#hash' END) WHEN 1 THEN concat('####### seven', chr(10), coalesce(text, '')) ELSE text END AS text FROM c)"""


def _named(c):
    k = F.col("doc_id")
    late = F.when(k % 2 == 0, "# Late").otherwise("#hash")
    t = F.coalesce("text", F.lit(""))
    text = F.when(k % 3 == 0, F.concat(F.lit("## Aims of "), k, F.lit("  \n"), t, F.lit("\n"), late)).when(k % 3 == 1, F.concat(F.lit("####### seven\n"), t)).otherwise(F.col("text"))
    return c.select("doc_id", F.floor(k / 4).alias("project"), F.concat(F.lit("parts/"), k % 4, F.lit("_more-Words_"), k, F.lit(".md")).alias("file"), text.alias("text"))


@family.over("documents", "+ " + _NAMED + r""" SELECT doc_id, trim(list_extract(list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '^#\s+.+$')), 1)[2:]) AS header,
    trim(regexp_replace(list_extract(list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '^#{1,6}\s+.+$')), 1), '^#+', '')) AS heading FROM t""")
def first_headings(c):
    """EXT-32."""
    return _named(c).select("doc_id", F.nullif(sections.header("text"), F.lit("")).alias("header"), F.nullif(sections.first_heading("text"), F.lit("")).alias("heading"))


@family.over("documents", "+ " + _NAMED + r""", own AS (SELECT project, file, row_number() OVER (PARTITION BY project ORDER BY doc_id DESC)::INT - 1 AS ord, list_extract(list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '^#{1,6}\s+.+$')), 1) AS head, doc_id FROM t)
    SELECT project, file, coalesce(trim(regexp_replace(head, '^#+', '')), concat(doc_id % 4, ' More Words ', doc_id)) AS header, []::VARCHAR[] AS aliases, ord, 'derived' AS origin FROM own WHERE project % 5 <> 1
    UNION ALL SELECT project, file, concat('Own ', doc_id), CASE WHEN doc_id % 2 = 0 THEN ['alias'] ELSE [] END, (doc_id % 4)::INT, 'own' FROM t WHERE project % 5 = 1""")
def sections_resolved(c):
    """SRC-20: every fifth project has a configuration, the others list their files from the last to the first."""
    texts = _named(c)
    own = texts.filter("project % 5 = 1").select("project", "file", F.concat(F.lit("Own "), "doc_id").alias("header"), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("alias"))).alias("aliases"), (F.col("doc_id") % 4).cast("int").alias("ord"))
    files = F.sort_array(F.collect_list(F.struct("doc_id", "file")), asc=False)
    listed = texts.groupBy("project").agg(F.transform(files, lambda x: x["file"]).alias("files"))
    return sections.resolved(own, listed, texts.select("project", "file", "text"), "project")
