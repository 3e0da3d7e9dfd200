"""Queries over Word files that are made of the documents: one file of each text."""

from __future__ import annotations

import io
import re
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from ..functions import batches, xml
from ..operators import importing
from ..sources import docx, word_source
from ..streaming.watch import shared_folder
from .base import Family, table

family = Family()
QUERIES, SQL = family.queries, family.sql

_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
#: What XML can't hold, and what a paragraph is cut at.
_CONTROL = r"[\x00-\x08\x0b-\x1f\t￾￿]"


def _p(inner: str, style: str = "") -> str:
    style = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{style}{inner}</w:p>"


def _r(text: str, tag: str = "t") -> str:
    return f'<w:r><w:{tag} xml:space="preserve">{escape(text)}</w:{tag}></w:r>'


def word_file(doc_id: int, text: str) -> bytes:
    """By the id modulo 4: with tracked changes and a comment; without; with a heading and a table; no Word file at all."""
    kind = doc_id % 4
    if kind == 3:
        return b"no archive"
    body = [_p(_r(line)) for line in re.sub(_CONTROL, " ", text or "").split("\n")]
    if kind == 0:
        body.append(_p(f'{_r("Rain ")}<w:ins w:id="1" w:author="Ann">{_r("heavily ")}</w:ins><w:commentRangeStart w:id="5"/>{_r(f"fellx{doc_id}")}<w:commentRangeEnd w:id="5"/>{_r(" ")}<w:del w:id="2" w:author="Ann">{_r("on", "delText")}</w:del>{_r(" here")}'))
    elif kind == 1:
        body.append(_p(_r("Rain fell on a long pass today.")))
    else:
        cells = [[f"Sitex{doc_id}", "Rain"], ["Hill", f"sumx{doc_id}"]]
        rows = "".join("<w:tr>" + "".join(f"<w:tc>{_p(_r(c))}</w:tc>" for c in row) + "</w:tr>" for row in cells)
        body += [_p(_r(f"Methods {doc_id}"), "Heading2"), f"<w:tbl>{rows}</w:tbl>", _p(_r(f"End {doc_id}."))]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f"<w:document {_W}><w:body>{''.join(body)}</w:body></w:document>")
        if kind == 0:
            z.writestr("word/comments.xml", f'<w:comments {_W}><w:comment w:id="5" w:author="Ann" w:date="2024-05-06T00:00:00Z">{_p(_r("look"))}</w:comment></w:comments>')
    return out.getvalue()


def _files(spark, sf_dir):
    @F.pandas_udf("binary")
    def made(doc_id: pd.Series, text: pd.Series) -> pd.Series:
        from marginalia.plans.word_queries import word_file

        return pd.Series([word_file(int(k), t) for k, t in zip(doc_id, text, strict=True)])

    batches.small(spark)
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), "doc_id", F.lit(".docx")).alias("path"), made("doc_id", "text").alias("content"))


_PATH = "concat('doc', doc_id, '.docx') AS path"
_FULL = r"len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '\S')))"


@family.over(None, rf"""SELECT {_PATH}, CASE doc_id % 4 WHEN 0 THEN 'tracked' WHEN 1 THEN 'compared' WHEN 2 THEN 'plain' ELSE 'failed' END AS way,
    CASE doc_id % 4 WHEN 0 THEN concat('Rain {{++heavily ++}}fellx', doc_id, '{{>>Ann: look<<}} {{--on--}} here') WHEN 1 THEN 'Rain fell on {{~~the~>a~~}} long pass today.' WHEN 2 THEN concat('End ', doc_id, '.') END AS tail,
    CASE WHEN doc_id % 4 = 0 THEN {_FULL} + 1 END::INT AS paragraphs, CASE WHEN doc_id % 4 = 2 THEN concat('| Sitex', doc_id, ' | Rain |', chr(10), '| --- | --- |', chr(10), '| Hill | sumx', doc_id, ' |') END AS tabled,
    CASE WHEN doc_id % 4 = 3 THEN 'not a Word document' END AS error FROM documents""".replace("{{", "{").replace("}}", "}"))
def word_import(spark, sf_dir):
    """DIF-12: one job over the files of all documents, with the originals of all but a quarter."""
    docs = table(spark, sf_dir, "documents")
    lines = F.regexp_replace(F.coalesce("text", F.lit("")), r"\n", "\n\n")
    originals = docs.filter("doc_id % 4 <> 2").select(F.concat(F.lit("doc"), "doc_id", F.lit(".docx")).alias("path"), F.concat(lines, F.lit("\n\nRain fell on the long pass today.")).alias("text"))
    made = importing.imported(_files(spark, sf_dir), originals)
    full = F.size(F.filter(F.split("text", r"\n\n"), lambda p: p.rlike(r"\S")))
    return made.select(
        "path", "way", F.call_function("substring_index", "text", F.lit("\n"), F.lit(-1)).alias("tail"), F.when(F.col("way") == "tracked", full).alias("paragraphs"),
        F.when(F.col("way") == "plain", F.regexp_extract("text", r"(?s)\n\n(\|.*\|)\n\n", 1)).alias("tabled"), "error",
    )


@family.over(None, f"SELECT {_PATH}, '5' AS id, 'Ann' AS author, '2024-05-06' AS date, 'look' AS text, concat('fellx', doc_id) AS anchor FROM documents WHERE doc_id % 4 = 0")
def word_comments(spark, sf_dir):
    """SRC-06, SRC-07, JOIN-10: the comments of all files with what they are on."""
    files = _files(spark, sf_dir)
    anchors = docx.read(files, "anchors").select("path", F.col("comment_id").alias("id"), "anchor")
    return docx.read(files, "comments").join(anchors, ["path", "id"], "left").select("path", "id", "author", "date", "text", "anchor")


@family.over(None, f"SELECT {_PATH}, 2 AS level, concat('Methods ', doc_id) AS text FROM documents WHERE doc_id % 4 = 2")
def word_headings(spark, sf_dir):
    """SRC-08."""
    return docx.read(_files(spark, sf_dir), "headings").select("path", "level", "text")


@family.over(None, f"SELECT {_PATH}, [[concat('Sitex', doc_id), 'Rain'], ['Hill', concat('sumx', doc_id)]] AS rows FROM documents WHERE doc_id % 4 = 2")
def word_tables(spark, sf_dir):
    """SRC-09."""
    return docx.read(_files(spark, sf_dir), "tables").select("path", "rows")


@family.over(None, f"SELECT {_PATH}, (doc_id % 4 = 0)::INT AS insertions, (doc_id % 4 = 0)::INT AS deletions FROM documents")
def word_change_counts(spark, sf_dir):
    """SRC-13."""
    return docx.read(_files(spark, sf_dir), "change_counts").select("path", "insertions", "deletions")


def edited_file(doc_id: int, text: str) -> bytes:
    """Every line a paragraph behind changes of one of three forms; the first paragraph is a heading."""
    old = "".join(f'<w:del w:id="1">{_r(x, "delText")}</w:del>' for x in ("old ", "words"))
    new = "".join(f'<w:ins w:id="2">{_r(x)}</w:ins>' for x in ("new ", "text "))
    before = (f"{old}{new}", f'{new}{_r(" ")}{old}', f'{old}<w:ins w:id="3">{_r("  ")}</w:ins>{_r("and ")}')[doc_id % 3]
    field = "<w:r><w:instrText>PAGE</w:instrText></w:r>"
    lines = re.sub(_CONTROL, " ", text or "").split("\n")
    body = "".join(_p(f"{before}{field}{_r(line + '.')}", "" if k else "Heading2") for k, line in enumerate(lines))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        # other prefixes than the usual one
        z.writestr("word/document.xml", f"<w:document {_W}><w:body>{body}</w:body></w:document>".replace("<w:", "<own:").replace("</w:", "</own:").replace(" w:", " own:").replace("xmlns:w=", "xmlns:own="))
    return out.getvalue()


_CLEAN = r"regexp_replace(coalesce(text, ''), '[\x00-\x08\x0b-\x1f\t\x{FFFE}\x{FFFF}]', ' ', 'g')"
_CHANGED = "CASE doc_id % 3 WHEN 2 THEN '{--old words--} and ' ELSE '{~~old words~>new text~~} ' END"


@family.over(None, rf"""SELECT {_PATH}, concat('## ', array_to_string(list_transform(string_split({_CLEAN}, chr(10)), lambda l: regexp_replace(concat({_CHANGED}, l, '.'), ' {{2,}}', ' ', 'g')), chr(10) || chr(10))) AS text,
    (CASE doc_id % 3 WHEN 2 THEN 0 ELSE 2 END * len(string_split(coalesce(text, ''), chr(10))))::INT AS insertions, (2 * len(string_split(coalesce(text, ''), chr(10))))::INT AS deletions FROM documents""")
def word_native_text(spark, sf_dir):
    """SRC-11: tracked changes on every line of every document, neighbours merged."""
    @F.pandas_udf("binary")
    def made(doc_id: pd.Series, text: pd.Series) -> pd.Series:
        from marginalia.plans.word_queries import edited_file

        return pd.Series([edited_file(int(k), t) for k, t in zip(doc_id, text, strict=True)])

    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), "doc_id", F.lit(".docx")).alias("path"), made("doc_id", "text").alias("content"))
    return docx.read(files, "native_text")


_TOKEN = r"""<!--[\s\S]*?-->|<!\[CDATA\[[\s\S]*?\]\]>|<\?[\s\S]*?\?>|<(?:[^!?>"'']|![^>"''\-\[])(?:[^>"'']|"[^"]*"|''[^'']*'')*>|<[\s\S]*|[^<]+"""


@family.over(None, rf"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '{_TOKEN}')) AS raw, generate_subscripts(regexp_extract_all(html, '{_TOKEN}'), 1) AS seq FROM pages),
    k AS (SELECT *, CASE WHEN NOT starts_with(raw, '<') THEN 'text' WHEN starts_with(raw, '<!--') THEN 'comment' WHEN starts_with(raw, '<![CDATA[') THEN 'cdata' WHEN starts_with(raw, '<?xml') THEN 'decl'
        WHEN starts_with(raw, '<?') THEN 'pi' WHEN starts_with(raw, '</') THEN 'close' WHEN ends_with(raw, '/>') THEN 'selfclose' ELSE 'open' END AS kind,
        (sum(length(raw)) OVER (PARTITION BY page_id ORDER BY seq))::INT AS "end" FROM t)
    SELECT page_id, (seq - 1)::INT AS seq, kind, CASE WHEN kind IN ('open', 'close', 'selfclose') THEN regexp_extract(raw, '^</?([^\s/>]*)', 1) ELSE '' END AS name, "end" - length(raw)::INT AS "start", "end", raw FROM k""")
def xml_tokens(spark, sf_dir):
    """SRC-15: the tokens of all pages with their places."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(xml.tokens("html")).alias("seq", "t"))
    return rows.select("page_id", "seq", "t.kind", F.concat_ws(":", F.nullif("t.prefix", F.lit("")), "t.local").alias("name"), "t.start", "t.end", "t.raw")


def _from_files(spark, sf_dir, what):
    """The Word files of all documents, written as such and read by the data source."""
    folder = shared_folder(spark)
    word_source.written(_files(spark, sf_dir), folder)
    word_source.register(spark)
    rows = spark.read.format("word").option("what", what).load(folder)
    return rows.withColumn("path", F.substring_index("path", "/", -1))


_FAILED = "SELECT concat('doc', doc_id, '.docx') AS path, {} 'ValueError: not a Word document' AS error FROM documents WHERE doc_id % 4 = 3"


@family.over(None, f"SELECT {_PATH}, '5' AS id, 'Ann' AS author, 'look' AS text, NULL::VARCHAR AS parent_id, NULL::VARCHAR AS error FROM documents WHERE doc_id % 4 = 0 UNION ALL " + _FAILED.format("NULL, NULL, NULL, NULL,"))
def word_source_comments(spark, sf_dir):
    """SRC-06 as a data source; files that can't be read are rows with an error."""
    return _from_files(spark, sf_dir, "comments").select("path", "id", "author", "text", "parent_id", "error")


@family.over(None, f"SELECT {_PATH}, 'Heading2' AS style, 2 AS level, concat('Methods ', doc_id) AS text, NULL::VARCHAR AS error FROM documents WHERE doc_id % 4 = 2 UNION ALL " + _FAILED.format("NULL, NULL, NULL,"))
def word_source_headings(spark, sf_dir):
    """SRC-08 as a data source."""
    return _from_files(spark, sf_dir, "headings").select("path", "style", "level", "text", "error")


@family.over(None, f"SELECT {_PATH}, concat('| Sitex', doc_id, ' | Rain |', chr(10), '| --- | --- |', chr(10), '| Hill | sumx', doc_id, ' |') AS markdown, NULL::VARCHAR AS error FROM documents WHERE doc_id % 4 = 2 UNION ALL " + _FAILED.format("NULL,"))
def word_source_tables(spark, sf_dir):
    """SRC-09 as a data source."""
    return _from_files(spark, sf_dir, "tables").select("path", "markdown", "error")
