"""Queries over registries' answers that are made of the tables: JSON of each row."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import answers
from . import relations
from .base import Family, table

family = Family()
QUERIES, SQL = family.queries, family.sql


def _answer(one, two=None):
    """By the key modulo 4: no answer, a broken one, one work, two works of which the second has no fields."""
    k = F.col("p_partkey") % 4
    few = F.when(k == 2, one).when(k == 3, two)
    return F.when(k == 1, F.concat(F.lit('{"cut": '), F.col("p_name"))).otherwise(few)


_SOUND = "concat('10.5/', p_partkey) AS doi, p_name AS item_title, p_brand AS item_author"


@family.over("part", f"""SELECT p_partkey, 'crossref' AS source, 0 AS n, {_SOUND}, p_type AS item_journal, (1990 + p_size)::INT AS item_year, p_size / 2.0::DOUBLE AS base FROM c WHERE p_partkey % 4 IN (2, 3)
    UNION ALL SELECT p_partkey, 'datacite', 0, {_SOUND}, p_type, (1990 + p_size)::INT, 50.0 FROM c WHERE p_partkey % 4 IN (2, 3)
    UNION ALL SELECT p_partkey, unnest(['crossref', 'datacite']), 1, concat('10.6/', p_partkey), '', NULL, '', unnest([2020, NULL]), unnest([0.0, 50.0]) FROM c WHERE p_partkey % 4 = 3""")
def registry_works(c):
    """SRC-24: the works of two registries' searches in one form."""
    date = lambda name: f"'{name}', named_struct('date-parts', array(array({{}}, 5)))"
    full = "'DOI', concat('10.5/', p_partkey), 'title', array(p_name, 'second'), 'author', array(named_struct('given', 'Ann', 'family', p_brand)), 'container-title', array(p_type), 'score', p_size / 2.0, " + date("published-print").format("1990 + p_size")
    bare = "'DOI', concat('10.6/', p_partkey), 'title', array(), " + date("published-online").format("2020")
    one = F.expr(f"to_json(named_struct('message', named_struct('items', array(named_struct({full})))))")
    # the two works have different fields, so the second is put in as text
    two = F.expr(f"concat('{{\"message\": {{\"items\": [', to_json(named_struct({full})), ',', to_json(named_struct({bare})), ']}}}}')")
    works = answers.crossref(c.select("p_partkey", _answer(one, two).alias("json")), "p_partkey")
    full = "'id', concat('10.5/', p_partkey), 'attributes', named_struct('titles', array(named_struct('title', p_name)), 'creators', array(named_struct('familyName', p_brand)), 'publicationYear', 1990 + p_size, 'publisher', p_type)"
    bare = "'id', concat('10.6/', p_partkey), 'attributes', named_struct('publicationYear', 0)"
    one = F.expr(f"to_json(named_struct('data', array(named_struct({full}))))")
    two = F.expr(f"concat('{{\"data\": [', to_json(named_struct({full})), ',', to_json(named_struct({bare})), ']}}')")
    return works.unionByName(answers.datacite(c.select("p_partkey", _answer(one, two).alias("json")), "p_partkey"))


@family.over("supplier", """SELECT s_suppkey, CASE WHEN s_suppkey % 6 = 0 THEN 'x' ELSE concat('0000-0001-', lpad((s_suppkey % 10000)::VARCHAR, 4, '0'), '-000X') END AS orcid,
    CASE WHEN s_suppkey % 6 IN (3, 4, 5) THEN trim(CASE s_suppkey % 6 WHEN 3 THEN concat('Ann ', s_name) WHEN 4 THEN s_name ELSE '' END) END AS name,
    CASE s_suppkey % 6 WHEN 3 THEN concat('Nation ', s_nationkey) WHEN 4 THEN '' WHEN 5 THEN '' END AS affiliation, CASE s_suppkey % 6 WHEN 3 THEN concat('b', s_suppkey, '@x.org') WHEN 4 THEN 'first@x.org' WHEN 5 THEN '' END AS email,
    CASE s_suppkey % 6 WHEN 0 THEN 'Invalid ORCID format: x' WHEN 1 THEN concat('ORCID not found: 0000-0001-', lpad((s_suppkey % 10000)::VARCHAR, 4, '0'), '-000X') WHEN 2 THEN 'ORCID API error: 503' END AS error FROM c""")
def orcid_people(c):
    """SRC-24: profiles, and why there is none."""
    full = F.expr("""to_json(named_struct('name', named_struct('given-names', named_struct('value', 'Ann'), 'family-name', named_struct('value', s_name)),
        'emails', named_struct('email', array(named_struct('email', 'a@x.org', 'primary', false), named_struct('email', concat('b', s_suppkey, '@x.org'), 'primary', true))),
        'employments', named_struct('affiliation-group', array(named_struct('summaries', array(named_struct('employment-summary', named_struct('organization', named_struct('name', concat('Nation ', s_nationkey))))))))))""")
    half = F.expr("to_json(named_struct('name', named_struct('family-name', named_struct('value', s_name)), 'emails', named_struct('email', array(named_struct('email', 'first@x.org')))))")
    k = F.col("s_suppkey") % 6
    asked = F.when(k == 0, "x").otherwise(F.concat(F.lit("https://orcid.org/0000-0001-"), F.lpad((F.col("s_suppkey") % 10000).cast("string"), 4, "0"), F.lit("-000X")))
    rows = c.select("s_suppkey", asked.alias("orcid"), F.when(k == 1, 404).when(k == 2, 503).otherwise(200).alias("status"), F.when(k == 3, full).when(k == 4, half).otherwise("{}").alias("json"))
    return answers.people(rows, "s_suppkey")


def _asked(c):
    key = F.col("p_partkey")
    k = key % 7
    full = F.expr("to_json(named_struct('title', p_name, 'container-title', array(p_type), 'issued', named_struct('date-parts', array(array(1990 + p_size))), 'author', array(named_struct('given', 'Ann', 'family', p_brand, 'familyName', null), named_struct('given', null, 'family', null, 'familyName', 'Lee')), 'type', 'article'))")
    bare = F.expr("to_json(named_struct('title', array(p_name), 'publisher', p_brand, 'created', named_struct('date-parts', array(array(2001, 2)))))")
    doi = F.when(k == 0, F.concat(F.lit("doi "), key)).otherwise(F.concat(F.lit("10.1234/p"), key))
    status = F.when(k == 1, 404).when(k == 2, 500).when(k == 3, None).otherwise(200)
    return c.select("p_partkey", doi.alias("doi"), status.alias("status"), F.when(k == 4, full).when(k == 5, bare).when(k == 6, "<html>").alias("json"))


@family.over("part", """SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN concat('doi ', p_partkey) ELSE concat('10.1234/p', p_partkey) END AS doi, p_partkey % 7 IN (4, 5) AS valid, p_partkey % 7 IN (2, 3, 6) AS unreachable,
    CASE p_partkey % 7 WHEN 0 THEN 'Invalid DOI format' WHEN 1 THEN 'DOI not found' WHEN 2 THEN 'HTTP 500' WHEN 3 THEN 'no answer' WHEN 6 THEN 'no JSON' END AS error,
    CASE WHEN p_partkey % 7 IN (4, 5) THEN p_name END AS title, CASE p_partkey % 7 WHEN 4 THEN [concat('Ann ', p_brand), 'Lee'] WHEN 5 THEN []::VARCHAR[] END AS authors,
    CASE p_partkey % 7 WHEN 4 THEN (1990 + p_size)::INT WHEN 5 THEN 2001 END AS year, CASE p_partkey % 7 WHEN 4 THEN p_type WHEN 5 THEN p_brand END AS journal, CASE p_partkey % 7 WHEN 4 THEN 'article' END AS type FROM c""")
def doi_lookups(c):
    """SRC-24: what a look-up of each DOI says."""
    return answers.doi_checks(_asked(c), "p_partkey")


@family.over(None, f"""WITH e AS ({relations.ENTRIES}), o AS (SELECT *, ('0' || right(key, 1))::INT % 4 AS k, regexp_matches(doi, '^10\\.\\d{{4,}}/\\S+$') AS ok FROM e)
    SELECT key, type, doi, CASE WHEN doi IS NULL THEN CASE WHEN type IN ('article', 'inproceedings') THEN 'missing' ELSE 'skipped' END WHEN NOT ok THEN 'invalid' WHEN k = 0 THEN 'valid' WHEN k = 1 THEN 'invalid' ELSE 'unreachable' END AS status,
    CASE WHEN doi IS NULL THEN CASE WHEN type IN ('article', 'inproceedings') THEN 'Expected DOI for article/proceedings' ELSE concat(type, ' typically has no DOI') END WHEN NOT ok THEN 'Invalid DOI format'
        WHEN k = 1 THEN 'DOI not found' WHEN k = 2 THEN 'HTTP 502' WHEN k = 3 THEN 'no answer' END AS message FROM o""")
def bibliography_checked(spark, sf_dir):
    """SRC-24, AGG-07: every entry by the answer to its DOI; a quarter was never asked for."""
    entries = relations.QUERIES["bib_entries"](spark, sf_dir).withColumn("skip", F.lit(False))
    k = F.right("key", F.lit(1)).cast("int") % 4
    asked = entries.filter(k != 3).filter("doi IS NOT NULL").select("doi", F.when(k == 0, 200).when(k == 1, 410).otherwise(502).alias("status"), F.lit("{}").alias("json"))
    return answers.bibliography_checked(entries, answers.doi_checks(asked))
