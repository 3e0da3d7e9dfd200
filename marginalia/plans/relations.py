"""Queries over tables: lookups, merges, shares, caches, geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import anchors, citations, journals, merging, projects, sections
from ..sources import bibtex
from . import corpora
from .base import Family, table, with_corpus

family = Family()
QUERIES, SQL = family.queries, family.sql

# -- bibliography and DOIs

_DOI = "CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN concat('11.', p_partkey, '/x') ELSE concat('10.', 1000 + p_partkey % 9000, '/p', p_partkey) END"
_TYPE = "CASE WHEN p_partkey % 7 = 0 THEN 'book' WHEN p_partkey % 11 = 0 THEN 'misc' ELSE 'article' END"
ENTRIES = f"SELECT concat('P', p_partkey) AS key, {_TYPE} AS type, {_DOI} AS doi, left(p_name, 60) AS title, concat(p_brand, ', Ann and Bo ', p_type) AS author, (1990 + p_size % 30)::INT AS year, concat('Journal of ', p_brand) AS journal FROM part"


def _entries(spark, sf_dir):
    return bibtex.entries(corpora.for_spark(spark, sf_dir, "bibliography"))


@family.over(None, ENTRIES)
def bib_entries(spark, sf_dir):
    return _entries(spark, sf_dir).select("key", "type", "doi", "title", "author", "year", "journal")


_STATUS = f"CASE WHEN doi IS NULL THEN CASE WHEN type IN ('book', 'misc') THEN 'skipped' ELSE 'missing' END WHEN regexp_matches(doi, '^10\\.\\d{{4,}}/\\S+$') THEN 'valid' ELSE 'invalid' END"


@family.over(None, f"SELECT {_STATUS} AS status, count(*)::BIGINT AS n, count(*) FILTER (type = 'article')::BIGINT AS expected FROM ({ENTRIES}) GROUP BY 1")
def doi_status_tally(spark, sf_dir):
    return citations.doi_status(_entries(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"), F.count_if("expects_doi").alias("expected"))


@family.over(None, f"SELECT key, type FROM ({ENTRIES}) WHERE doi IS NULL AND type = 'article'")
def doi_needed(spark, sf_dir):
    """FLT-04."""
    return citations.doi_status(_entries(spark, sf_dir)).filter("status = 'missing' AND expects_doi").select("key", "type")


@family.over("part", r"SELECT p_partkey, regexp_matches(d, '^10\.\d{4,}/\S+$') AS ok FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN concat('10.', p_partkey, '/a') WHEN 1 THEN concat('10.123', p_partkey, '/b') WHEN 2 THEN concat('11.1234/', p_partkey) ELSE concat('10.1234/x y', p_partkey) END AS d FROM c)")
def doi_format(c):
    k = F.col("p_partkey")
    d = F.when(k % 4 == 0, F.concat(F.lit("10."), k, F.lit("/a"))).when(k % 4 == 1, F.concat(F.lit("10.123"), k, F.lit("/b"))).when(k % 4 == 2, F.concat(F.lit("11.1234/"), k)).otherwise(F.concat(F.lit("10.1234/x y"), k))
    return c.select("p_partkey", X.is_doi(d).alias("ok"))


_CAND = """q AS (SELECT p_partkey AS query_key, p_name AS title, p_brand AS journal, 2000 + p_size % 20 AS year FROM part WHERE p_partkey % 100 = 0), x AS (SELECT p_partkey, p_name, p_brand, p_size FROM part),
    s AS (SELECT query_key, concat('10.1000/', p_partkey) AS doi, (CASE WHEN lower(title) = lower(p_name) THEN 100.0 ELSE 0.0 END) + (CASE WHEN lower(journal) = lower(p_brand) THEN 1.0 ELSE 0.0 END) * 0 + (CASE abs(2000 + p_size % 20 - year) WHEN 0 THEN 50.0 WHEN 1 THEN 20.0 ELSE -50.0 END)::DOUBLE AS score FROM q JOIN x ON x.p_brand = q.journal AND lower(x.p_name) = lower(q.title))"""


@family.over(None, f"WITH {_CAND}, r AS (SELECT query_key, doi, score, row_number() OVER (PARTITION BY query_key ORDER BY score DESC, doi) AS k, lead(score) OVER (PARTITION BY query_key ORDER BY score DESC, doi) AS runner_up FROM s) SELECT query_key, doi, score::DOUBLE AS score, CASE WHEN score >= 120 AND (runner_up IS NULL OR score - runner_up >= 30) THEN 'high' WHEN score >= 70 THEN 'medium' ELSE 'low' END AS confidence FROM r WHERE k = 1")
def doi_best_match(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    q = part.filter("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_key"), F.col("p_name").alias("title"), F.col("p_brand").alias("j"), (2000 + F.col("p_size") % 20).alias("year"))
    x = part.select(F.concat(F.lit("10.1000/"), "p_partkey").alias("doi"), F.col("p_name").alias("item_title"), F.col("p_brand").alias("item_j"), (2000 + F.col("p_size") % 20).alias("item_year"))
    pairs = q.join(x, (q.j == x.item_j) & (F.lower("title") == F.lower("item_title")))
    none = F.lit(None).cast("string")
    pairs = pairs.withColumn("journal", none).withColumn("author", none).withColumn("base", F.lit(0.0))
    scored = pairs.withColumn("score", citations.match_score("title", "journal", "year", "author", "item_title", "journal", "item_year", "doi", "author", "base"))
    return citations.best_matches(scored).select("query_key", "doi", "score", "confidence")


_WORDS = "list_distinct(list_filter(string_split(lower({0}), ' '), lambda w: length(w) > {1}))"
_LIKE_WORDS = "len(list_filter({0}, lambda w: len(list_filter({1}, lambda v: contains(v, w) OR contains(w, v))) > 0))"


@family.over("part", f"""+ w AS (SELECT *, {_WORDS.format('p_name', 3)} AS tw, {_WORDS.format('p_type', 2)} AS jw, 2000 + p_size % 20 AS y FROM c),
    pairs AS (SELECT DISTINCT a.p_partkey AS q, b.p_partkey AS x FROM (SELECT p_partkey, unnest(tw) AS t FROM w WHERE p_partkey % 100 = 0) a JOIN (SELECT p_partkey, unnest(tw) AS t FROM w) b ON a.t = b.t),
    s AS (SELECT q.p_partkey AS query_key, concat('10.1000/', x.p_partkey) AS doi,
            (CASE WHEN lower(q.p_name) = lower(x.p_name) THEN 100.0 WHEN contains(lower(x.p_name), lower(q.p_name)) OR contains(lower(q.p_name), lower(x.p_name)) THEN 50.0 ELSE {_LIKE_WORDS.format('q.tw', 'x.tw')} / greatest(len(q.tw), 1) * 40.0 END
            + CASE WHEN contains(lower(x.p_brand), lower(q.p_brand)) OR contains(lower(q.p_brand), lower(x.p_brand)) THEN 30.0 ELSE 0.0 END
            + CASE WHEN {_LIKE_WORDS.format('q.jw', 'x.jw')} >= least(2, len(q.jw)) THEN 40.0 WHEN {_LIKE_WORDS.format('q.jw', 'x.jw')} >= 1 THEN 15.0 ELSE 0.0 END + CASE WHEN lower(q.p_type) = lower(x.p_type) THEN 20.0 ELSE 0.0 END
            + CASE abs(x.y - q.y) WHEN 0 THEN 50.0 WHEN 1 THEN 20.0 ELSE -50.0 END)::DOUBLE AS score
          FROM pairs JOIN w q ON q.p_partkey = pairs.q JOIN w x ON x.p_partkey = pairs.x),
    r AS (SELECT *, row_number() OVER o AS k, lead(score) OVER o AS runner_up FROM s WINDOW o AS (PARTITION BY query_key ORDER BY score DESC, doi))
    SELECT query_key, doi, score, CASE WHEN score >= 120 AND (runner_up IS NULL OR score - runner_up >= 30) THEN 'high' WHEN score >= 70 THEN 'medium' ELSE 'low' END AS confidence FROM r WHERE k = 1""")
def doi_fuzzy_match(c):
    """JOIN-19 in full: titles that only share words, and the terms of journal, author and year."""
    year = (2000 + F.col("p_size") % 20).alias("year")
    wanted = c.filter("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_key"), F.col("p_name").alias("title"), F.col("p_type").alias("journal"), F.col("p_brand").alias("author"), year)
    works = c.select(F.concat(F.lit("10.1000/"), "p_partkey").alias("doi"), F.col("p_name").alias("item_title"), F.col("p_type").alias("item_journal"), F.col("p_brand").alias("item_author"), year.alias("item_year"))
    return citations.best_known(wanted, works).select("query_key", "doi", "score", "confidence")


_ANSWER = "p_name AS title, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN concat('https://doi.org/10.1/P', p_size) ELSE concat('10.1/p', p_size) END AS doi"


@family.over("part", f"""+ a AS (SELECT {_ANSWER} FROM c WHERE p_partkey % 3 = 0), b AS (SELECT {_ANSWER} FROM c WHERE p_partkey % 3 <> 0),
    n AS (SELECT *, regexp_replace(lower(doi), '^https?://(dx\\.)?doi\\.org/', '') AS k FROM b)
    SELECT title, doi FROM a UNION ALL SELECT title, doi FROM n WHERE k IS NULL
    UNION ALL SELECT r.title, r.doi FROM (SELECT min({{'title': title, 'doi': doi}}) AS r FROM n WHERE k IS NOT NULL AND k NOT IN (SELECT regexp_replace(lower(doi), '^https?://(dx\\.)?doi\\.org/', '') FROM a WHERE doi IS NOT NULL) GROUP BY k)""")
def answers_appended(c):
    """SET-05: answers of one source and those of another that it lacks."""
    k = F.col("p_partkey")
    doi = F.when(k % 5 == 0, None).when(k % 2 == 0, F.concat(F.lit("https://doi.org/10.1/P"), "p_size")).otherwise(F.concat(F.lit("10.1/p"), "p_size"))
    rows = c.select(F.col("p_name").alias("title"), doi.alias("doi"), k)
    return citations.appended(rows.filter("p_partkey % 3 = 0").drop("p_partkey"), rows.filter("p_partkey % 3 <> 0").drop("p_partkey"))


_FILES = "SELECT p_partkey, p_size AS project, concat('out/', CASE p_partkey % 4 WHEN 0 THEN concat('Title-of-', p_size, '.docx') WHEN 1 THEN concat('title-of-', p_size, '-changes.docx') WHEN 2 THEN 'Paper_comments.docx' ELSE concat('draft', p_partkey, '.docx') END) AS path FROM {}"


@family.over("part", f"SELECT p_partkey FROM ({_FILES.format('c')}) WHERE p_partkey % 4 = 3 OR project % 7 = 0")
def files_without_outputs(c):
    """FLT-10: every seventh project has no title."""
    files = c.sparkSession.sql(_FILES.format("{c}"), c=c)
    titles = c.select(F.col("p_size").alias("project")).distinct().withColumn("title", F.when(F.col("project") % 7 == 0, None).otherwise(F.concat(F.lit("Title of: "), "project", F.lit("!"))))
    return projects.without_outputs(files, titles, "project").select("p_partkey")


@family.over("part", "SELECT p_partkey FROM c WHERE contains(lower(p_name), 'co') OR lower(p_brand) LIKE '%2%'")
def sections_chosen(c):
    """FLT-06."""
    rows = c.select("p_partkey", F.concat("p_brand", F.lit(".MD")).alias("file"), F.col("p_name").alias("header"))
    return sections.chosen(rows.withColumn("file", F.when(F.col("file").contains("2"), F.col("file")).otherwise("x.md")), ["2", " CO "]).select("p_partkey")


@family.over("supplier", "SELECT s_suppkey, s_suppkey % 3 <> 2 AS ok, CASE s_suppkey % 3 WHEN 0 THEN concat('0000-0001-', lpad((s_suppkey % 10000)::VARCHAR, 4, '0'), '-123X') WHEN 1 THEN concat('0000-0002-', lpad((s_suppkey % 10000)::VARCHAR, 4, '0'), '-1234') ELSE concat('0000-2-', s_suppkey) END AS orcid FROM c")
def orcid_valid(c):
    k = F.col("s_suppkey")
    four = F.lpad((k % 10000).cast("string"), 4, "0")
    o = F.when(k % 3 == 0, F.concat(F.lit("https://orcid.org/0000-0001-"), four, F.lit("-123X"))).when(k % 3 == 1, F.concat(F.lit("0000-0002-"), four, F.lit("-1234"))).otherwise(F.concat(F.lit("0000-2-"), k))
    return c.select("s_suppkey", X.is_orcid(o).alias("ok"), X.bare_orcid(o).alias("orcid"))


@family.over("orders", "SELECT o_orderkey, strftime(o_orderdate, '%-d %B %Y') AS long, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM c")
def date_variables(c):
    return c.select("o_orderkey", X.dated(F.lit("D MMMM YYYY"), "o_orderdate").alias("long"), X.dated(F.lit("YYYY-MM-DD"), "o_orderdate").alias("iso"))


@family.over("orders", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN ((o_orderkey % 100) * 1000.0)::DOUBLE ELSE 0.0::DOUBLE END AS ms FROM c")
def retry_after(c):
    h = F.when(F.col("o_orderkey") % 2 == 0, (F.col("o_orderkey") % 100).cast("string")).otherwise("Wed, 21 Oct 2015 07:28:00 GMT")
    return c.select("o_orderkey", X.retry_after_ms(h, F.lit("2020-01-01 00:00:00").cast("timestamp")).alias("ms"))


@family.over("customer", "SELECT c_custkey, concat('D:', 20200101 + c_custkey % 28, '120000Z') AS raw, concat('2020-01-', lpad((1 + c_custkey % 28)::VARCHAR, 2, '0')) AS date FROM c")
def pdf_dates(c):
    raw = F.concat(F.lit("D:"), 20200101 + F.col("c_custkey") % 28, F.lit("120000Z"))
    return c.select("c_custkey", raw.alias("raw"), X.pdf_date(raw).alias("date"))


@family.over("part", "SELECT p_partkey, p_brand AS surname FROM c")
def first_author(c):
    a = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_brand", F.lit(", Ann and Bo Li"))).otherwise(F.concat(F.lit("Ann "), "p_brand", F.lit(" and Bo Li")))
    return c.select("p_partkey", X.surname(a).alias("surname"))


# -- merging

_OVER = """CASE WHEN a.type = 'insert' AND b.type = 'insert' AND a."start" = b."start" THEN a.new_text <> b.new_text
    ELSE NOT ((CASE WHEN a.type = 'insert' THEN a."start" ELSE a."end" END) <= b."start" OR (CASE WHEN b.type = 'insert' THEN b."start" ELSE b."end" END) <= a."start") AND NOT (a.type = b.type AND a.old_text = b.old_text AND a.new_text = b.new_text) END"""


@family.over("changes", f"SELECT a.doc_id, a.seq AS a_id, b.seq AS b_id FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.seq < b.seq WHERE {_OVER}")
def change_overlap_pairs(c):
    return merging.overlapping_pairs(c, "doc_id", "seq")


#: DuckDB: the greedy grouping, one change after the other; near has the later changes that each one is in conflict with.
GROUPS = f"""s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "start", "end", reviewer_ord, seq, type, old_text, new_text) AS i FROM c),
    near AS MATERIALIZED (SELECT a.doc_id, a.i, list(b.i ORDER BY b.i) FILTER (b.i IS NOT NULL) AS js FROM s a LEFT JOIN s b ON a.doc_id = b.doc_id AND a.i < b.i AND ({_OVER}) GROUP BY 1, 2),
    walk AS (SELECT doc_id, 0::BIGINT AS i, []::BIGINT[] AS taken, 0 AS n, []::BIGINT[] AS own FROM (SELECT DISTINCT doc_id FROM c)
        UNION ALL SELECT doc_id, i, list_concat(taken, own), n + (len(own) > 0)::INT, own FROM (SELECT w.doc_id, r.i, w.taken, w.n, CASE WHEN list_contains(w.taken, r.i) THEN [] ELSE list_filter(coalesce(r.js, []), lambda j: NOT list_contains(w.taken, j)) END AS own FROM walk w JOIN near r ON r.doc_id = w.doc_id AND r.i = w.i + 1)),
    member AS (SELECT doc_id, n, unnest(list_prepend(i, own)) AS i, unnest(range(len(own) + 1)) AS place FROM walk WHERE len(own) > 0),
    g AS MATERIALIZED (SELECT s.*, CASE WHEN m.n IS NOT NULL THEN concat('c', m.n) END AS conflict, coalesce(m.place, 0)::INT AS place FROM s LEFT JOIN member m ON m.doc_id = s.doc_id AND m.i = s.i)"""
_SUMMARY = """SELECT doc_id, conflict, min("start")::INT AS "start", max("end")::INT AS "end", count(*)::BIGINT AS changes, arg_min(new_text, place) AS first_text, arg_max(new_text, place) AS latest_text FROM g WHERE conflict IS NOT NULL GROUP BY 1, 2"""


def grouped(sql: str) -> str:
    return with_corpus("changes", f"+ {GROUPS} {sql}").replace("WITH c", "WITH RECURSIVE c", 1)


@family.over("changes")
def conflict_groups(c):
    return merging.conflicts(c, "doc_id").select("doc_id", "reviewer", "seq", "conflict", "place")


SQL["conflict_groups"] = grouped("SELECT doc_id, reviewer, seq, conflict, place FROM g")


@family.over("changes")
def conflict_resolutions(c):
    return merging.conflict_summary(merging.conflicts(c, "doc_id"), "doc_id")


SQL["conflict_resolutions"] = grouped(_SUMMARY)


def _choices(found):
    """Choices for two of three conflicts, some of which there are not."""
    return found.filter("conflict IS NOT NULL").select("doc_id", "conflict").distinct().filter("doc_id % 3 <> 0").withColumn("choice", (F.col("doc_id") % 4 - 1).cast("int"))


#: DuckDB: the changes of each conflict by place, and the choice.
_CHOSEN = """, n AS (SELECT doc_id, conflict, count(*) AS n, (doc_id % 4 - 1)::INT AS choice FROM g WHERE conflict IS NOT NULL GROUP BY doc_id, conflict)
    SELECT n.doc_id, n.conflict, n.choice, g.reviewer, g.new_text, CASE WHEN n.choice < 0 OR n.choice >= n.n THEN concat('no such choice, there are ', n.n) END AS error
    FROM n LEFT JOIN g ON g.doc_id = n.doc_id AND g.conflict = n.conflict AND g.place = n.choice WHERE n.doc_id % 3 <> 0"""


@family.over("changes")
def conflicts_resolved(c):
    """DIF-08: each conflict by the number of the change that was chosen."""
    found = merging.stored(merging.conflicts(c, "doc_id"), "doc_id", "reviewer", "type", "start", "end", "old_text", "new_text", "conflict", "place")
    return merging.resolved(found, _choices(found), "doc_id").select("doc_id", "conflict", "choice", "reviewer", "new_text", "error")


SQL["conflicts_resolved"] = grouped(_CHOSEN)


@family.over("changes")
def conflicts_unresolved(c):
    found = merging.stored(merging.conflicts(c, "doc_id"), "doc_id", "conflict")
    return merging.unresolved(found, _choices(found), "doc_id")


SQL["conflicts_unresolved"] = grouped("SELECT doc_id, conflict FROM g WHERE conflict IS NOT NULL GROUP BY 1, 2 HAVING doc_id % 3 = 0 OR doc_id % 4 - 1 < 0 OR doc_id % 4 - 1 >= count(*)")


@family.over("changes")
def merge_stats(c):
    return merging.statistics(merging.conflicts(c, "doc_id"), "doc_id")


SQL["merge_stats"] = grouped("SELECT doc_id, count(DISTINCT reviewer)::BIGINT AS reviewers, count(*)::BIGINT AS changes, count(*) FILTER (conflict IS NULL)::BIGINT AS free, count(DISTINCT conflict)::BIGINT AS conflicts FROM g GROUP BY 1")


@family.over("changes", """SELECT doc_id, reviewer_ord, seq FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, "start", "end", type, new_text ORDER BY reviewer_ord, seq) AS r FROM c) WHERE r = 1""")
def conflict_dedupe(c):
    return merging.deduplicated(c, "doc_id").select("doc_id", "reviewer_ord", "seq")


_EDIT = "CASE WHEN length(text) >= 20 THEN substr(text, 1, 5) || {0} || substr(text, 11, 5) || {1} || substr(text, 16) ELSE text END"


def _edits(c):
    ok = c.filter(F.length("text") >= 20)
    one = ok.select("doc_id", F.lit("replace").alias("type"), F.lit(5).alias("start"), F.lit(10).alias("end"), F.substring("text", 6, 5).alias("old_text"), F.lit("NEW").alias("new_text"))
    two = ok.select("doc_id", F.lit("insert").alias("type"), F.lit(15).alias("start"), F.lit(15).alias("end"), F.lit("").alias("old_text"), F.lit("<in>").alias("new_text"))
    return one.unionByName(two)


@family.over("documents", "SELECT doc_id, " + _EDIT.format("'NEW'", "'<in>'") + " AS text FROM c")
def changes_applied(c):
    return merging.applied(c.select("doc_id", "text"), _edits(c), "doc_id")


@family.over("documents", "SELECT doc_id, " + _EDIT.format("'{~~' || substr(text, 6, 5) || '~>NEW~~}'", "'{++<in>++}'") + " AS text FROM c")
def changes_annotated(c):
    return merging.applied(c.select("doc_id", "text"), _edits(c), "doc_id", annotate=True)


# -- shares, versions, caches

_BLAME = "SELECT o_orderpriority AS file, concat('u', o_custkey % 17) AS author FROM c"


def _blame(c):
    return c.select(F.col("o_orderpriority").alias("file"), F.concat(F.lit("u"), F.col("o_custkey") % 17).alias("author"))


@family.over("orders", f"SELECT file, author, n::BIGINT AS lines, floor(100.0 * n / sum(n) OVER (PARTITION BY file) + 0.5)::BIGINT AS percent FROM (SELECT file, author, count(*) AS n FROM ({_BLAME}) GROUP BY 1, 2)")
def author_share(c):
    return projects.author_shares(_blame(c))


@family.over("orders", f"SELECT author, count(*)::BIGINT AS lines, count(DISTINCT file)::BIGINT AS files FROM ({_BLAME}) GROUP BY author")
def contributors(c):
    return projects.contributors(_blame(c))


@family.over("orders", "SELECT concat('f', o_custkey) AS file, o_orderkey::INT AS line, concat('u', o_custkey % 7) AS author FROM c")
def blame_parse(c):
    line = F.concat(F.lpad(F.hex(F.col("o_custkey") % 7), 40, "0"), F.lit(" 1 "), "o_orderkey", F.lit(" 1\nauthor u"), F.col("o_custkey") % 7, F.lit("\n\tcode\n"))
    files = c.select(F.concat(F.lit("f"), "o_custkey").alias("file"), F.lower(line).alias("t"), "o_orderkey").groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "t"))), lambda x: x["t"]), "").alias("text"))
    return projects.blame_lines(files).select("file", "line", "author")


@family.over("orders", "SELECT o_custkey AS repo, concat('h', o_orderkey) AS hash, concat('u', o_custkey) AS author, concat('fix | part ', o_orderkey) AS message FROM c")
def git_log_parse(c):
    line = F.concat(F.lit("h"), "o_orderkey", F.lit("|2024-01-01|u"), "o_custkey", F.lit("|fix | part "), "o_orderkey")
    log = c.groupBy(F.col("o_custkey").alias("repo")).agg(F.array_join(F.collect_list(line), "\n").alias("text"))
    return projects.log_rows(log, "repo").select("repo", "hash", "author", "message")


_TOKENS = "list_filter(string_split_regex({0}, '\\s+'), lambda w: w <> '')"


@family.over("documents", f"""+ w AS (SELECT doc_id, w, sum(s) AS n FROM (SELECT doc_id, unnest({_TOKENS.format('text')}) AS w, -1 AS s FROM c UNION ALL SELECT doc_id, unnest({_TOKENS.format("replace(text, ' the ', ' THE some ')")}), 1 FROM c) GROUP BY 1, 2)
    SELECT doc_id, sum(greatest(n, 0))::BIGINT AS added, sum(greatest(-n, 0))::BIGINT AS removed FROM w GROUP BY 1""")
def word_count_diff(c):
    return projects.word_count_diff(c.withColumn("new", F.replace("text", F.lit(" the "), F.lit(" THE some "))), "doc_id", "text", "new")


@family.over("events", "SELECT event_id FROM c WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 7 DAYS")
def cache_ttl(c):
    return projects.fresh(c, F.lit("2024-01-30 00:00:00").cast("timestamp")).select("event_id")


@family.over("events", "SELECT event_id FROM c ORDER BY ts DESC, event_id LIMIT CASE WHEN (SELECT count(*) FROM c) > 1000 THEN 800 ELSE 1000 END")
def cache_evict(c):
    return projects.evicted(c, "ts", "event_id").select("event_id")


@family.over("events", "SELECT event_type, user_id % 10 AS author, (event_id % 12)::BIGINT AS page, count(*)::BIGINT AS n FROM c GROUP BY GROUPING SETS ((event_type), (user_id % 10), (event_id % 12), ())")
def pdf_stats_grouping_sets(c):
    return projects.remark_statistics(c.select("event_type", (F.col("user_id") % 10).alias("author"), (F.col("event_id") % 12).alias("page")), "event_type", "author", "page")


@family.over("embeddings", """+ i AS (SELECT vec_id, vec_id % 5 AS page, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM c), q AS (SELECT vec_id AS quad, vec_id % 5 AS page, embedding[3]::DOUBLE - 0.05 AS x1, embedding[3]::DOUBLE + 0.05 AS x2, embedding[4]::DOUBLE - 0.05 AS y1, embedding[4]::DOUBLE + 0.05 AS y2 FROM c)
    SELECT i.vec_id, q.quad FROM i JOIN q ON i.page = q.page AND x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2""")
def point_in_quad(c):
    e = [F.col("embedding")[k].cast("double") for k in range(4)]
    items = c.select("vec_id", (F.col("vec_id") % 5).alias("page"), e[0].alias("x"), e[1].alias("y"))
    quads = c.select(F.col("vec_id").alias("quad"), (F.col("vec_id") % 5).alias("page"), (e[2] - 0.05).alias("x1"), (e[2] + 0.05).alias("x2"), (e[3] - 0.05).alias("y1"), (e[3] + 0.05).alias("y2"))
    return projects.in_quads(items, quads, "page", 0.1).select("vec_id", "quad")


@family.over("supplier", "SELECT s_suppkey % 40 AS id, max_by(s_name, s_suppkey) AS name FROM c WHERE s_suppkey > (SELECT max(s_suppkey) / 2 FROM c) OR NOT EXISTS (SELECT 1 FROM c d WHERE d.s_suppkey % 40 = c.s_suppkey % 40 AND d.s_suppkey > (SELECT max(s_suppkey) / 2 FROM c)) GROUP BY 1")
def profile_overlay(c):
    half = c.agg((F.max("s_suppkey") / 2).alias("h"))
    rows = c.crossJoin(F.broadcast(half)).select((F.col("s_suppkey") % 40).alias("id"), F.col("s_name").alias("name"), "s_suppkey", (F.col("s_suppkey") > F.col("h")).alias("custom"))
    best = rows.groupBy("id", "custom").agg(F.max_by("name", "s_suppkey").alias("name"))
    return journals.overlaid(best.filter("NOT custom").drop("custom"), best.filter("custom").drop("custom"))


@family.over("events", "SELECT user_id, count(*)::BIGINT AS n FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM c) WHERE r <= 10 GROUP BY 1")
def undo_history(c):
    return projects.history(c, "user_id", order="event_id").groupBy("user_id").agg(F.count("*").alias("n"))


@family.over("documents", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'added' WHEN 1 THEN 'deleted' WHEN 2 THEN 'modified' ELSE 'unchanged' END AS status FROM c")
def changed_files(c):
    old = c.filter("doc_id % 4 <> 0").select("doc_id", "text")
    new = c.filter("doc_id % 4 <> 1").select("doc_id", F.when(F.col("doc_id") % 4 == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return projects.changed_files(old, new, "doc_id")


@family.over("conversations", "SELECT conv_id, min(role) AS author FROM c WHERE role <> 'system' GROUP BY conv_id HAVING count(DISTINCT role) = 1")
def single_reviewer(c):
    return projects.only_reviewer(c.select("conv_id", F.when(F.col("role") == "system", "Unknown").otherwise(F.col("role")).alias("author")), "conv_id")


@family.over("documents", "SELECT doc_id, concat(text, chr(10), chr(10), '{>>Ann: [p.', 1 + doc_id % 3, '] see ', lang, '<<}') AS text FROM c")
def pdf_comments_appended(c):
    remarks = c.select("doc_id", (1 + F.col("doc_id") % 3).alias("page"), F.lit("Ann").alias("author"), F.concat(F.lit("see "), "lang").alias("contents")).unionByName(c.select("doc_id", F.lit(9).cast("long").alias("page"), F.lit("B").alias("author"), F.lit("  ").alias("contents")))
    return projects.remarks_appended(c, remarks, "doc_id")


# -- anchors


@family.over("documents", "SELECT doc_id, (CASE WHEN a <> '' AND contains(lower(text), lower(a)) THEN 'direct' WHEN a = '' THEN 'empty' ELSE 'failed' END) AS strategy, (CASE WHEN a <> '' THEN instr(lower(text), lower(a)) - 1 ELSE -1 END)::INT AS pos FROM (SELECT doc_id, text, replace(substr(text, 8, 30), 'e', 'E') AS a FROM c)")
def anchor_tiers(c):
    s = anchors.strategy("a", "text")
    return c.select("doc_id", "text", F.replace(F.substring("text", 8, 30), F.lit("e"), F.lit("E")).alias("a")).select("doc_id", s.alias("s")).select("doc_id", "s.strategy", "s.pos")


def _bracket(least: str, most: str) -> str:
    """DuckDB: context on both sides, with a gap within bounds; -1: both are there, with another gap."""
    gap = "(instr(substr(lt, s + 1), left(f, 50)) - 1)"
    return f"CASE WHEN b <> '' AND f <> '' AND s IS NOT NULL AND {gap} >= 0 THEN CASE WHEN {gap} BETWEEN {least} AND {most} THEN s ELSE -1 END END"


_SIDES = """WHEN b <> '' AND contains(lt, right(b, 30)) THEN {'y': 'context-before', 'm': NULL, 'h': NULL, 'p': length(lt) - instr(reverse(lt), reverse(right(b, 30))) + 1}
    WHEN f <> '' AND contains(lt, left(f, 30)) THEN {'y': 'context-after', 'm': NULL, 'h': NULL, 'p': instr(lt, left(f, 30)) - 1}"""
#: DuckDB: the six ways one after the other; h is where all places of the match are looked up.
_SEARCH = rf"""+ x AS (SELECT doc_id, coalesce(anchor, '') AS a, lower(coalesce(anchor, '')) AS la, lower(text) AS lt, lower(regexp_replace(text, '\{{\+\+(.+?)\+\+\}}', '\1', 'g')) AS bt, lower(before) AS b, lower(after) AS f FROM c),
    y AS (SELECT *, string_split_regex(a, '\s+') AS w, regexp_replace(lt, '\s+', ' ', 'g') AS nt, regexp_replace(la, '\s+', ' ', 'g') AS na, CASE WHEN contains(lt, right(b, 50)) THEN instr(lt, right(b, 50)) - 1 + length(right(b, 50)) END AS s FROM x),
    z AS (SELECT *, list_filter(CASE WHEN len(w) > 3 THEN flatten(list_transform([6, 5, 4, 3], lambda n: list_transform(range(1, len(w) - n + 2), lambda k: {{'k': k, 'w': array_to_string(w[k:k + n - 1], ' ')}}))) ELSE [] END,
            lambda r: length(r.w) >= 15 AND (contains(lt, lower(r.w)) OR contains(bt, lower(r.w))))[1] AS r,
            list_filter(flatten(list_transform([' ', ', ', '. ', ' - ', ' – '], lambda q: CASE WHEN contains(a, q) THEN string_split(a, q) ELSE [] END)), lambda p: length(p) >= 4 AND (length(lt) - length(replace(lt, lower(p), ''))) // greatest(length(p), 1) BETWEEN 1 AND 4)[1] AS q,
            {_bracket('floor(length(a) * 0.3)', 'least(500, 2 * length(a) + 50)')} AS g, {_bracket('0', '499')} AS e FROM y),
    v AS (SELECT doc_id, CASE
        WHEN trim(a) = '' THEN CASE WHEN e >= 0 THEN {{'y': 'context-both', 'm': NULL, 'h': NULL, 'p': e}} {_SIDES} ELSE {{'y': 'empty-anchor', 'm': NULL, 'h': NULL, 'p': NULL}} END
        WHEN contains(lt, la) THEN {{'y': 'direct', 'm': a, 'h': lt, 'p': NULL}}
        WHEN contains(nt, na) THEN {{'y': 'normalized', 'm': a, 'h': NULL, 'p': instr(nt, na) - 1}}
        WHEN contains(bt, la) THEN {{'y': 'stripped', 'm': a, 'h': bt, 'p': NULL}}
        WHEN r IS NOT NULL THEN {{'y': concat(CASE WHEN r.k = 1 THEN 'partial-start' ELSE 'partial-window' END, CASE WHEN contains(lt, lower(r.w)) THEN '' ELSE '-stripped' END), 'm': r.w, 'h': CASE WHEN contains(lt, lower(r.w)) THEN lt ELSE bt END, 'p': NULL}}
        WHEN g >= 0 THEN {{'y': 'context-both', 'm': NULL, 'h': NULL, 'p': g}}
        WHEN g = -1 THEN {{'y': 'failed', 'm': NULL, 'h': NULL, 'p': NULL}} {_SIDES}
        WHEN q IS NOT NULL THEN {{'y': 'split-match', 'm': q, 'h': lt, 'p': NULL}} ELSE {{'y': 'failed', 'm': NULL, 'h': NULL, 'p': NULL}} END AS o FROM z),
    places AS (SELECT doc_id, o.y AS strategy, o.m AS matched, CASE WHEN o.p IS NOT NULL THEN [o.p] WHEN o.h IS NULL THEN [] ELSE list_filter(range(0, length(o.h) - length(o.m) + 1), lambda i: substr(o.h, i + 1, length(o.m)) = lower(o.m)) END AS hits FROM v)
    SELECT doc_id, strategy, matched, len(hits)::INT AS n, coalesce(hits[1], -1)::INT AS first, coalesce(hits[-1], -1)::INT AS last FROM places"""


@family.over("anchored", _SEARCH)
def anchor_search(c):
    """SCL-29: anchors damaged in every way are found by the way made for it."""
    found = anchors.located(c.select("doc_id", "anchor", "before", "after"), c.select("doc_id", "text"), "doc_id")
    at = F.col("positions")
    return found.select("doc_id", "strategy", "matched", F.size(at).alias("n"), F.coalesce(F.get(at, F.lit(0)), F.lit(-1)).alias("first"), F.coalesce(F.try_element_at(at, F.lit(-1)), F.lit(-1)).alias("last"))


_NORMAL = "regexp_replace(lower({0}), '\\s+', ' ', 'g')"
_LIKE = f"""+ a AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN 'no such anchor anywhere here' ELSE replace(substr(text, 5, 40), ' ', '  ') END AS a FROM c),
    q AS (SELECT CASE WHEN coalesce(a, '') = '' THEN 'unmatched' WHEN contains({_NORMAL.format('text')}, {_NORMAL.format('a')}) THEN 'clean'
        WHEN contains({_NORMAL.format('text')}, 'such anchor anywhere') OR contains({_NORMAL.format('text')}, 'anchor anywhere here') THEN 'drift'
        WHEN doc_id % 3 = 0 AND len(list_filter(['such', 'anchor', 'anywhere', 'here'], lambda p: (length(text) - length(replace(lower(text), p, ''))) // length(p) BETWEEN 1 AND 4)) > 0 THEN 'drift' ELSE 'unmatched' END AS quality FROM a) """


@family.over("documents", _LIKE + "SELECT v.quality, coalesce(n, 0)::BIGINT AS n FROM (VALUES ('clean'), ('drift'), ('context-only'), ('ambiguous'), ('unmatched')) v(quality) LEFT JOIN (SELECT quality, count(*) AS n FROM q GROUP BY 1) USING (quality)")
def anchor_quality_tally(c):
    a = F.when(F.col("doc_id") % 3 == 0, F.lit("no such anchor anywhere here")).otherwise(F.regexp_replace(F.substring("text", 5, 40), " ", "  "))
    s = anchors.strategy("a", "text")["strategy"]
    return projects.quality_tally(c.select("text", a.alias("a")).select(anchors.quality(s).alias("quality")))


_WORDS = "list_filter(string_split_regex(lower({0}), '\\s+'), lambda w: length(w) > 3)"


@family.over("documents", f"""+ p AS (SELECT doc_id, text, 60 AS pos, substr(text, 31, 30) AS before, substr(text, 71, 30) AS after FROM c WHERE length(text) >= 120), w AS (SELECT *, lower(substr(text, 11, 50)) AS l, lower(substr(text, 71, 50)) AS r FROM p)
    SELECT doc_id, (2 * len(list_filter({_WORDS.format('before')}, lambda x: contains(l, x))) + CASE WHEN contains(l, right(lower(before), 30)) THEN 5 ELSE 0 END + 2 * len(list_filter({_WORDS.format('after')}, lambda x: contains(r, x))) + CASE WHEN contains(r, left(lower(after), 30)) THEN 5 ELSE 0 END)::INT AS score FROM w""")
def context_score(c):
    p = c.filter(F.length("text") >= 120).select("doc_id", "text", F.substring("text", 31, 30).alias("before"), F.substring("text", 71, 30).alias("after"))
    return p.select("doc_id", anchors.context_score(F.lit(60), "text", "before", "after", F.lit(10)).alias("score"))


@family.over("part", "SELECT p_partkey, list_filter(range(0, length(p_name)), lambda i: substr(p_name, (i + 1)::INT, 1) = 'a') AS at FROM c")
def occurrences(c):
    return c.select("p_partkey", F.transform(anchors.occurrences("p_name", F.lit("a")), lambda k: k.cast("long")).alias("at"))
