"""Deterministic corpora made from the tables, in SQL that Spark and DuckDB share.

The tables hold no annotations, citations or anchors, so queries put them
into the whole texts by the same expressions on both sides.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

CORPORA = {
    "annotated": """
        SELECT doc_id, lang, source, concat(coalesce(text, ''), chr(10), 'We {{++added ', doc_id, '++}} and {{--dropped ', lang, '--}} then {{~~', source, '~>', lang, '~~}} here {{>>Reviewer ', doc_id % 5, ': see line ', doc_id % 7,
               CASE WHEN doc_id % 3 = 0 THEN ' [RESOLVED]' ELSE '' END, '<<}} end.', chr(10), 'A {{==mark==}} and {{>>note ', doc_id, '<<}} with {{++more++}}.') AS text
        FROM {documents}""",
    "nested": """
        SELECT doc_id, concat(coalesce(text, ''), chr(10), '{{--{{++in ', doc_id, '++}}--}} {{++{{++twice++}}++}} {{~~old~>new~~}} [x]{{.mark}} {{--{{--gone--}}--}} {{==kept==}} {{>>A: b<<}} tail') AS text
        FROM {documents}""",
    "citing": """
        SELECT doc_id, concat('f', doc_id % 40, '.md') AS file, concat(coalesce(text, ''), chr(10), 'As shown [@P', doc_id % 300, '; @P', doc_id % 450, '] here and @Smith', 1990 + doc_id % 30, ' says .', chr(10), '<!-- [@Hidden', doc_id, '] -->') AS text
        FROM {documents}""",
    "bibliography": """
        SELECT p_partkey, concat('@', CASE WHEN p_partkey % 7 = 0 THEN 'book' WHEN p_partkey % 11 = 0 THEN 'misc' ELSE 'article' END, '{{P', p_partkey, ',', chr(10), '  title = {{', p_name, '}},', chr(10), '  author = {{', p_brand, ', Ann and Bo ', p_type, '}},', chr(10),
               '  year = {{', 1990 + p_size % 30, '}},', chr(10), CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 5 = 0 THEN concat('  doi = {{11.', p_partkey, '/x}},', chr(10)) ELSE concat('  doi = {{https://doi.org/10.', 1000 + p_partkey % 9000, '/p', p_partkey, '}},', chr(10)) END,
               '  journal = {{Journal of ', p_brand, '}}', chr(10), '}}') AS text
        FROM {part}""",
    "talk": """
        SELECT conv_id, turn, role, concat('{{>>', role, ': ', replace(replace(coalesce(text, ''), '<', '('), chr(10), ' '), CASE WHEN turn % 3 = 2 THEN ' [RESOLVED]' ELSE '' END, '<<}}') AS markup FROM {conversations}""",
    "papers": """
        SELECT doc_id, concat('proj', doc_id % 20) AS project, CASE WHEN doc_id % 9 = 0 THEN concat('supp', doc_id, '.md') ELSE concat('sec', doc_id, '.md') END AS file, doc_id AS file_ord,
               concat('---', chr(10), 'title: Paper ', doc_id, chr(10), '---', chr(10), '# Introduction', chr(10), coalesce(text, ''), chr(10), '## Methods', chr(10), 'See @fig:f', doc_id + doc_id % 2, ' and @tbl:t', doc_id % 11, ' or @fig:none', doc_id % 3, '.', chr(10),
               '![Cap](f.png){{#fig:f', doc_id, '}}', chr(10), 'As in Figures 1-3 and S2 or Table ', doc_id % 4 + 1, ' and Eq. 2 there.', chr(10), '| a | b |{{#tbl:t', doc_id % 11, '}}', chr(10), '# Results', chr(10), 'Value {{#eq:e', doc_id, '}} done. @fig:f', doc_id - doc_id % 2, ' again.', chr(10), '<!-- @section: a.md -->', chr(10), 'part a', chr(10), '<!-- @section: b.md -->', chr(10), 'part b ', doc_id) AS text
        FROM {documents}""",
    "maths": """
        SELECT doc_id, concat('f', doc_id % 25, '.md') AS file, concat(replace(coalesce(text, ''), '$', ''), chr(10), 'With $x_', doc_id, '$ and $y$ inline.', chr(10), 'Single $$E = ', doc_id, '$$ here.', chr(10), '$$', chr(10), 'a + b = ', doc_id, chr(10), '$$', chr(10), 'end $z$.') AS text
        FROM {documents}""",
    "prose": """
        SELECT doc_id, concat('f', doc_id % 25, '.md') AS file, concat(coalesce(text, ''), chr(10), 'It is very clearly shown that we may really prove the end result.', chr(10), 'The report was finished to quickly test in terms of hedging; obviously.', chr(10), '```', chr(10), '--- x') AS text
        FROM {documents}""",
    "anchored": """
        SELECT doc_id, concat(coalesce(text, ''), chr(10), 'Lead words ', doc_id, ' before the gap. Here the {{++quite ++}}long marker phrase', doc_id, ' of some weight stands and words after it close paragraph ', doc_id, '.') AS text,
               CASE doc_id % 9 WHEN 0 THEN replace(substring(text, 9, 30), 'e', 'E') WHEN 1 THEN replace(substring(text, 5, 40), ' ', '  ') WHEN 2 THEN concat('quite long marker phrase', doc_id) WHEN 3 THEN concat('xq zq marker phrase', doc_id, ' of some weight qx')
                    WHEN 4 THEN 'here the quite long qx zx' WHEN 5 THEN 'vanished words of this size' WHEN 6 THEN 'vanished words of this size' WHEN 7 THEN concat('qxq, phrase', doc_id) ELSE CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'zzzz yyyy' END END AS anchor,
               CASE doc_id % 9 WHEN 5 THEN 'Before the gap. ' WHEN 6 THEN concat('Lead words ', doc_id, ' ') ELSE '' END AS before,
               CASE doc_id % 9 WHEN 5 THEN CASE WHEN doc_id % 2 = 0 THEN ' of some weight' ELSE 'Here' END WHEN 8 THEN CASE WHEN doc_id % 2 = 0 THEN 'close paragraph' ELSE '' END ELSE '' END AS after
        FROM {documents}""",
    "rewritten": """
        SELECT doc_id, concat('# Opening of ', doc_id, chr(10), chr(10), old, chr(10), chr(10), '- a point of ', lang) AS old,
               concat('Fresh words come first.', chr(10), chr(10), '# Opening of ', doc_id, chr(10), chr(10), CASE WHEN doc_id % 3 = 0 THEN concat('Another paragraph stands in between here.', chr(10), chr(10)) ELSE '' END,
                      CASE WHEN doc_id % 4 = 0 THEN substring(old, 1 + length(old) % 200) ELSE replace(old, ' the ', ' that ') END, chr(10), chr(10), 'a point of order') AS new
        FROM (SELECT doc_id, lang, replace(coalesce(text, ''), chr(10), concat(chr(10), chr(10))) AS old FROM {documents})""",
    "flattened": """
        SELECT doc_id, text, concat(coalesce(text, ''), chr(10), chr(10), 'Site ', doc_id, chr(10), 'Rain Hill ', doc_id, ' some', chr(10), 'total ', doc_id, ' left', chr(10), chr(10), 'Words between.', chr(10), chr(10),
               CASE WHEN doc_id % 3 = 0 THEN 'Nothing here' ELSE concat('Year ', doc_id, ' and sum ', doc_id) END) AS flat
        FROM {documents}""",
    "reworded": """
        SELECT doc_id, text, concat(' {{~~[@A2020]~>(Author 2020)~~}} {{--$x$--}} so {{++(Author et al. 2021; Other 2022)++}}. {{~~[@B2001] old~>new~~}}{{++2020a).++}} end ', doc_id, '{{++ ++}} .') AS marked
        FROM {documents}""",
    "doubtful": """
        SELECT doc_id, concat(coalesce(text, ''), chr(10), CASE doc_id % 24
               WHEN 0 THEN concat('```r', chr(10), '{{>>in code<<}}') WHEN 1 THEN concat('```r', chr(10), 'x', chr(10), '```', chr(10), '{{>>behind code<<}}') WHEN 2 THEN '    {{>>set in<<}}'
               WHEN 3 THEN 'a `b {{>>c<<}} d`' WHEN 4 THEN 'a `b` {{>>c<<}}' WHEN 5 THEN '{{--old {{>>in a deletion<<}}--}}'
               WHEN 6 THEN '{{++new {{>>in an insertion<<}}++}}' WHEN 7 THEN '{{++new++}} {{>>behind one<<}} {{--old--}} {{>>and one<<}}' WHEN 8 THEN '{{>>look (figure/one)<<}}'
               WHEN 9 THEN '{{>>rain.PNG<<}}' WHEN 10 THEN '{{>>{{#fig:a}}<<}}' WHEN 11 THEN '{{>>see https://x.org<<}}'
               WHEN 12 THEN '{{>>Ann: see https://x.org<<}}' WHEN 13 THEN concat('{{>>www.', repeat('x', 150), '<<}}') WHEN 14 THEN '{{>>let it rain<<}}'
               WHEN 15 THEN concat('{{>>', repeat('long ', 45), '<<}}') WHEN 16 THEN concat('{{>>Bo: ', repeat('long ', 45), '<<}}') WHEN 17 THEN concat('{{>>✓ ', repeat('long ', 45), '<<}}')
               WHEN 18 THEN '{{>> figure of rain<<}}' WHEN 19 THEN '{{>>Ann: Figure of rain<<}}' WHEN 20 THEN concat('{{>>so ', chr(92), 'frac{{a}}<<}}')
               WHEN 21 THEN '{{>>@Book{{x<<}}' WHEN 22 THEN '{{>>plain<<}}' WHEN 23 THEN '{{>>Ann: function (x)<<}}' END, chr(10), '{{>>last ', doc_id, '<<}}') AS text
        FROM {documents}""",
    "priors": """
        SELECT doc_id, concat(coalesce(text, ''), chr(10), chr(10), '| No | Table |', chr(10), '| of | dashes |', chr(10), chr(10), '| Normal(1) | none |', chr(10), '|--|--|', chr(10), '| Normal(2) | prior |', chr(10), chr(10),
               '| Term | Prior ', doc_id, '| Rest | Shape|', chr(10), '|:---|:-: |---|-|', chr(10), '| a | Normal(0, ', doc_id, ') | Gamma(1, 2) |Gamma(', doc_id, ', 3)|', chr(10), '|b|Half-Normal(3) or Normal(4)| ', source, ' | |', chr(10),
               '| c |Student-t(4,  0, 1) and Exponential(2)|', chr(10), '| d |$y$ Normal(1)| e | ', chr(92), 'beta |Normal(2)|', chr(10), '|Normal(3)||', lang, ' | flat|', CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN chr(10) ELSE concat(chr(10), 'After. | Normal(1) |', chr(10)) END) AS text
        FROM {documents}""",
    "changes": """
        SELECT CAST(floor(l_orderkey / 60) AS BIGINT) AS doc_id, concat('R', l_suppkey % 4) AS reviewer, CAST(l_suppkey % 4 AS INT) AS reviewer_ord, CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS seq,
               CASE WHEN l_partkey % 5 = 0 THEN 'insert' WHEN l_partkey % 5 = 1 THEN 'delete' ELSE 'replace' END AS type,
               CAST((l_orderkey * 37 + l_linenumber * 11) % 6000 AS INT) AS "start", CAST((l_orderkey * 37 + l_linenumber * 11) % 6000 AS INT) + CASE WHEN l_partkey % 5 = 0 THEN 0 ELSE CAST(l_quantity AS INT) END AS "end",
               CASE WHEN l_partkey % 5 = 0 THEN '' ELSE concat('old', l_orderkey % 9) END AS old_text, CASE WHEN l_partkey % 5 = 1 THEN '' ELSE concat('new', l_partkey % 6) END AS new_text
        FROM {lineitem}""",
}


def tables(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", sql)))


def for_duckdb(name: str) -> str:
    sql = CORPORA[name]
    return sql.format(**{t: t for t in tables(sql)})


def for_spark(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = CORPORA[name]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables(sql)}
    return spark.sql(sql.replace('"start"', "`start`").replace('"end"', "`end`"), **frames)
