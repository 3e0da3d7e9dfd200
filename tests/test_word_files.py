"""XML tokens, tracked text of Word files, and Word files as a data source."""

import io
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from marginalia.functions import xml
from marginalia.plans.word_queries import edited_file, word_file
from marginalia.sources import docx, word_source

W = 'xmlns:q="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def archive(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<q:document {W}><q:body>{body}</q:body></q:document>")
    return out.getvalue()


def run(text, tag="t"):
    return f'<q:r><q:{tag} xml:space="preserve">{text}</q:{tag}></q:r>'


def cut(text):
    """Tokens one character after the other."""
    out, at = [], 0
    while at < len(text):
        if text[at] != "<":
            end = text.find("<", at)
            end = len(text) if end < 0 else end
        else:
            for begin, closing in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<?", "?>")):
                if text.startswith(begin, at):
                    end = text.find(closing, at + len(begin))
                    end = len(text) if end < 0 else end + len(closing)
                    break
            else:
                end, quote = at + 1, ""
                while end < len(text) and (quote or text[end] != ">"):
                    quote = ("" if text[end] == quote else quote) if quote else text[end] if text[end] in "\"'" else ""
                    end += 1
                end = min(end + 1, len(text))
        out.append((at, end, text[at:end]))
        at = end
    return out


TEXTS = [
    "", "no tags", "<a/>", "<a b='>' c=\">\">x</a>", "<!-- <b> -->t<![CDATA[<c>]]>", "<?xml version='1.0'?><?go on?>", "<!DOCTYPE html><p>x", "<a b='never closed> <c/>",
    "<!-- never closed <d/>", "<![CDATA[ open", "<? open", "< >", "a < b > c", "<", "<!->x", "<![x]>y", "𝒜<é:ü 𝒷='1'/>𝒞", "<a " + "k='v' " * 2000 + "/>z",
]


def test_tokens_are_the_text(spark):
    df = spark.createDataFrame([*enumerate(TEXTS), (99, None)], "id int, x string")
    rows = {r["id"]: r["t"] for r in df.select("id", xml.tokens("x").alias("t")).collect()}
    assert rows[99] is None
    for k, text in enumerate(TEXTS):
        assert [(t["start"], t["end"], t["raw"]) for t in rows[k]] == cut(text)
    assert [(t["kind"], t["prefix"], t["local"]) for t in rows[16]] == [("text", "", ""), ("selfclose", "é", "ü"), ("text", "", "")]
    assert [t["kind"] for t in rows[4]] == ["comment", "text", "cdata"]
    assert [t["kind"] for t in rows[5]] == ["decl", "pi"]


def test_namespaces(spark):
    text = """<a xmlns="one" xmlns:w='two'><b xmlns:w = "three" c="xmlns:d='no'"/>xmlns:e="text"</a>"""
    df = spark.createDataFrame([(text,), ("plain",)], "x string").select(xml.namespaces("x").alias("n"))
    assert [r["n"] for r in df.collect()] == [{"": "one", "w": "three"}, {}]


@pytest.mark.parametrize(
    "text, want",
    [
        ("a{--b--}{++c++}d", "a{~~b~>c~~}d"),
        ("{++c++}  {--b --}d", "{~~b~>c~~} d"),
        ("{--a--}{--b--}", "{--ab--}"),
        ("{++a++}{++b++} {++c++}", "{++ab++} {++c++}"),
        ("{--a--}{++b++}{++c++}{--d--}", "{~~a~>bc~~}{--d--}"),
        ("{--a ++} b--}x", "{--a ++} b--}x"),
        ("{--never closed {++a++}", "{--never closed {++a++}"),
        ("", ""),
    ],
)
def test_neighbouring_marks(text, want):
    assert docx.merged_marks(text) == want


def test_native_text():
    style = '<q:pPr><q:pStyle q:val="Heading{}"/><q:tabs><q:tab q:val="left"/></q:tabs></q:pPr>'
    body = (
        f"<q:p>{style.format(3)}{run(' A  title ')}</q:p>"
        f"<q:p>{run('x &amp; y')}<q:ins>{run('in')}<q:r><q:tab/></q:r></q:ins><q:r><q:rPr><q:ins/></q:rPr><q:br/></q:r><q:del>{run('out', 'delText')}</q:del></q:p>"
        f"<q:p>{run('no')}<q:ins>{run(' ')}</q:ins><q:del>{run(' ', 'delText')}</q:del>{run('PAGE', 'instrText')}{run('gap')}</q:p><q:p/>"
        f"<q:p>{style.format(7)}{run('deep')}</q:p>"
    )
    got = docx.native_text(archive(body))
    assert got == {"text": "### A title\n\nx & y{++in\t++}\n{--out--}\n\nno gap\n\ndeep", "insertions": 1, "deletions": 1}
    assert docx.native_text(b"") == {"text": "", "insertions": 0, "deletions": 0}
    assert docx.native_text(edited_file(1, ""))["text"] == "## {~~old words~>new text~~} ."


def test_source_by_files(spark, tmp_path):
    folder = str(tmp_path / "files")
    made = spark.createDataFrame([(f"d{k}.docx", word_file(k, f"text {k}")) for k in range(12)], "path string, content binary")
    assert word_source.written(made, folder) == 12
    assert word_source.written(made, folder) == 12  # once more, over the first
    assert word_source.written(made.filter("false"), folder) == 0
    (tmp_path / "files" / "~$d0.docx").write_bytes(b"lock")
    (tmp_path / "files" / "notes.txt").write_text("x")
    (tmp_path / "files" / "deep").mkdir()
    (tmp_path / "files" / "deep" / "Last.DOCX").write_bytes(word_file(0, "deep"))
    word_source.register(spark)
    read = spark.read.format("word")
    rows = read.option("what", "change_counts").option("partitionFiles", 5).load(folder)
    assert rows.rdd.getNumPartitions() == 3
    got = {r["path"].split("files/")[1]: r for r in rows.collect()}
    assert len(got) == 13 and got["deep/Last.DOCX"]["insertions"] == 1 and got["d1.docx"]["deletions"] == 0
    assert got["d3.docx"]["error"] == "ValueError: not a Word document" and got["d3.docx"]["insertions"] is None
    one = spark.read.format("word").option("what", "comments").load(f"file://{folder}/d0.docx")
    assert [(r["id"], r["text"], r["error"]) for r in one.collect()] == [("5", "look", None)]
    kinds = spark.read.format("word").option("what", "is_word").load(folder)
    assert {r["path"][-6:]: r["is_word"] for r in kinds.filter(F.col("path").like("%d3.docx")).collect()} == {"3.docx": False}
    with pytest.raises(PySparkException, match="not a Word document"):
        spark.read.format("word").option("mode", "FAILFAST").load(folder).collect()
    with pytest.raises(PySparkException, match="what is one of"):
        spark.read.format("word").option("what", "pictures").load(folder)


def test_partitions_by_bytes():
    files = [("a", 10), ("b", 90), ("c", 1), ("d", 500), ("e", 1), ("f", 1), ("g", 1)]
    assert [p.paths for p in word_source.packed(files, 100, 2)] == [["a", "b"], ["c"], ["d"], ["e", "f"], ["g"]]
    assert word_source.packed([]) == []
