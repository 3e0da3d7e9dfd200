"""Word documents: comments, anchors, headings, tables, tracked changes (SRC-06..15).

Files are read as binaries and parsed in the workers, one document at a time,
with the standard library.  Names are matched by namespace, not by prefix.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import batches as sizes

#: Namespaces of the parts.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
W14 = "{http://schemas.microsoft.com/office/word/2010/wordml}"
W15 = "{http://schemas.microsoft.com/office/word/2012/wordml}"
M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
DC, TERMS = "{http://purl.org/dc/elements/1.1/}", "{http://purl.org/dc/terms/}"
#: Characters of context around an anchor.
CONTEXT = 150
#: Rows that are handed to Spark at once.
ROWS = 100


def files(spark: SparkSession, path: str) -> DataFrame:
    """SRC-12: path and content of the .docx files of a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", True).load(path).select("path", "content")


class Opened:
    """A file of which each part is parsed once, however many readers ask for it."""

    def __init__(self, data: bytes):
        self.data, self.parts = data, {}

    def part(self, name: str) -> ET.Element | None:
        if name not in self.parts:
            self.parts[name] = part(self.data, name)
        return self.parts[name]


def part(data: bytes | Opened, name: str) -> ET.Element | None:
    if isinstance(data, Opened):
        return data.part(name)
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return ET.fromstring(z.read(name)) if name in z.namelist() else None
    except (zipfile.BadZipFile, ET.ParseError):
        return None


def is_word(data: bytes) -> bool:
    return part(data, "word/document.xml") is not None


def run_text(e: ET.Element) -> str:
    """Text of an element's runs; tabs and breaks count, deleted text too."""
    out = []
    for x in e.iter():
        if x.tag in (f"{W}t", f"{W}delText", f"{M}t"):
            out.append(x.text or "")
        elif x.tag == f"{W}tab" and x.attrib == {}:
            out.append("\t")
        elif x.tag in (f"{W}br", f"{W}cr"):
            out.append("\n")
    return "".join(out)


def comments(data: bytes) -> list[dict]:
    """SRC-06, JOIN-18: comments with their parents, which the extended part names by paragraph."""
    root, more = part(data, "word/comments.xml"), part(data, "word/commentsExtended.xml")
    if root is None:
        return []
    out, by_para = [], {}
    for c in root.iter(f"{W}comment"):
        paras = list(c.iter(f"{W}p"))
        out.append({"id": c.get(f"{W}id"), "author": c.get(f"{W}author") or "Unknown", "date": (c.get(f"{W}date") or "")[:10], "text": "\n".join(run_text(p) for p in paras).strip(), "parent_id": None})
        for p in paras:
            by_para[p.get(f"{W14}paraId")] = out[-1]
    for e in more.iter(f"{W15}commentEx") if more is not None else []:
        child, parent = by_para.get(e.get(f"{W15}paraId")), by_para.get(e.get(f"{W15}paraIdParent"))
        if child and parent and child is not parent:
            child["parent_id"] = parent["id"]
    return out


def flow(data: bytes):
    """(kind, value) of the body in order: text, start and end of comments, end of paragraph."""
    root = part(data, "word/document.xml")
    body = root.find(f"{W}body") if root is not None else None

    def walk(e):
        for x in e:
            if x.tag == f"{W}commentRangeStart":
                yield "start", x.get(f"{W}id")
            elif x.tag == f"{W}commentRangeEnd":
                yield "end", x.get(f"{W}id")
            elif x.tag == f"{W}t":
                yield "text", x.text or ""
            elif x.tag == f"{W}tab":
                yield "text", "\t"
            elif x.tag in (f"{W}br", f"{W}cr"):
                yield "text", "\n"
            elif x.tag not in (f"{W}del", f"{W}pPr", f"{W}rPr"):
                yield from walk(x)
            if x.tag == f"{W}p":
                yield "text", "\n"

    if body is not None:
        yield from walk(body)


def anchors(data: bytes) -> list[dict]:
    """SRC-07: the text that each comment is on, its surroundings and its place."""
    text, starts, ends = [], {}, {}
    at = 0
    for kind, v in flow(data):
        if kind == "text":
            text.append(v)
            at += len(v)
        elif kind == "start":
            starts.setdefault(v, at)
        else:
            ends[v] = at
    whole = "".join(text)
    out = []
    for k, s in starts.items():
        e = ends.get(k, s)
        before, after = whole[max(0, s - CONTEXT) : s], whole[e : e + CONTEXT]
        out.append({"comment_id": k, "anchor": whole[s:e].strip(), "before": re.split(r"(?<=[.!?])\s+", before)[-1].strip(), "after": re.split(r"(?<=[.!?])\s", after)[0].strip(), "doc_position": s, "doc_length": len(whole), "is_empty": not whole[s:e].strip()})
    return out


def paragraphs(data: bytes):
    root = part(data, "word/document.xml")
    for p in root.iter(f"{W}p") if root is not None else []:
        style = p.find(f"{W}pPr/{W}pStyle")
        yield p, (style.get(f"{W}val") if style is not None else "") or ""


def headings(data: bytes) -> list[dict]:
    """SRC-08."""
    out, at = [], 0
    for p, style in paragraphs(data):
        text = "".join(t.text or "" for t in p.iter(f"{W}t"))
        if re.search("heading", style, re.I) and text.strip():
            level = re.search(r"\d+", style)
            out.append({"style": style, "level": int(level[0]) if level else 1, "text": text.strip(), "doc_position": at})
        at += len(text) + 1
    return out


def tables(data: bytes) -> list[dict]:
    """SRC-09: tables as rows of cells and as pipe tables; spanned and continued cells are blank."""
    root = part(data, "word/document.xml")
    out = []
    for t in root.iter(f"{W}tbl") if root is not None else []:
        rows = []
        for r in t.findall(f"{W}tr"):
            cells = []
            for c in r.findall(f"{W}tc"):
                merged, span = c.find(f"{W}tcPr/{W}vMerge"), c.find(f"{W}tcPr/{W}gridSpan")
                going_on = merged is not None and merged.get(f"{W}val") != "restart"
                cells.append("" if going_on else " ".join(run_text(p).strip() for p in c.findall(f"{W}p")).strip().replace("|", "\\|"))
                cells += [""] * (int(span.get(f"{W}val")) - 1 if span is not None else 0)
            rows.append(cells)
        width = max(map(len, rows), default=0)
        rows = [r + [""] * (width - len(r)) for r in rows]
        lines = ["| " + " | ".join(r) + " |" for r in rows]
        out.append({"rows": rows, "markdown": "\n".join([*lines[:1], "|" + " --- |" * width, *lines[1:]]) if rows else ""})
    return out


def tracked_text(data: bytes) -> str:
    """SRC-10: the text with tracked changes as annotations and headings as markdown."""
    out = []

    def inline(e) -> str:
        got = []
        for x in e:
            if x.tag in (f"{W}ins", f"{W}del"):
                text = run_text(x)
                sign = "++" if x.tag == f"{W}ins" else "--"
                got.append(f"{{{sign}{text}{sign}}}" if text.strip() else text if sign == "++" else "")
            elif x.tag == f"{W}r":
                got.append(run_text(x))
            elif x.tag != f"{W}pPr":
                got.append(inline(x))
        return "".join(got)

    for p, style in paragraphs(data):
        text = inline(p)
        if text.strip():
            level = re.search(r"heading\s*(\d)", style, re.I)
            out.append("#" * int(level[1]) + " " + text.strip() if level else text)
    text = "\n\n".join(out)
    return re.sub(r"\{--((?:(?!--\}).)*)--\}\{\+\+((?:(?!\+\+\}).)*)\+\+\}", r"{~~\1~>\2~~}", text, flags=re.S)


def merged_marks(text: str) -> str:
    """Runs of like marks as one; a deletion and an insertion with at most blanks between them, in either order, as a substitution."""
    run = {"--": r"(?:\{--(?:(?!--\}).)*--\})+", "++": r"(?:\{\+\+(?:(?!\+\+\}).)*\+\+\})+"}
    either = re.compile("|".join(rf"(?P<first{k}>{run[a]})(?: *(?P<second{k}>{run[b]}))?" for k, (a, b) in enumerate((("--", "++"), ("++", "--")))), re.S)

    def inner(marks: str, sign: str) -> str:
        s = re.escape(sign)
        return "".join(re.findall(rf"\{{{s}(.*?){s}\}}", marks, re.S))

    def one(m: re.Match) -> str:
        k = 0 if m["first0"] is not None else 1
        sign, other = ("--", "++")[:: 1 if k == 0 else -1]
        first, second = inner(m[f"first{k}"], sign), m[f"second{k}"]
        if second is None:
            return f"{{{sign}{first}{sign}}}"
        old, new = (first, inner(second, other))[:: 1 if k == 0 else -1]
        return f"{{~~{old.rstrip()}~>{new.rstrip()}~~}}" + (" " if old.endswith(" ") or new.endswith(" ") else "")

    return either.sub(one, text)


def native_text(data: bytes) -> dict:
    """SRC-11: text with tracked changes straight from the flow of the main part, its insertions and deletions counted.

    Text counts inside of t and delText only, tabs and breaks inside of runs
    only.  Blank changes become plain text; neighbouring changes are merged;
    several blanks become one; blank paragraphs go.
    """
    root = part(data, "word/document.xml")
    out, counts = [], {"ins": 0, "del": 0}
    text, held, mode, level, runs, properties = [], [], None, 0, 0, 0

    def put(x: str) -> None:
        (held if mode else text).append(x)

    # elements with whether they begin or end; a stack, as documents may be nested deeply
    todo = [(root, True)] if root is not None else []
    while todo:
        e, begins = todo.pop()
        tag = e.tag[len(W) :] if isinstance(e.tag, str) and e.tag.startswith(W) else ""
        empty = len(e) == 0 and not e.text
        if begins:
            todo.append((e, False))
            todo += [(x, True) for x in reversed(e)]
            if tag == "p":
                text, held, mode, level = [], [], None, 0
            elif tag == "pStyle" and properties and re.search("heading", e.get(f"{W}val") or "", re.I):
                digits = re.search(r"\d+", e.get(f"{W}val"))
                level = int(digits[0]) if digits else 0
            elif tag in ("t", "delText") and e.text:
                put(e.text)
            elif tag in ("tab", "br", "cr") and runs and not properties:
                put("\t" if tag == "tab" else "\n")
            elif tag in ("ins", "del") and not empty:
                held, mode = [], tag
        elif tag in ("ins", "del") and not empty:
            change = "".join(held)
            if change.strip():
                counts[tag] += 1
                sign = "++" if tag == "ins" else "--"
                change = f"{{{sign}{change}{sign}}}"
            text.append(change)
            held, mode = [], None
        elif tag == "p":
            line = re.sub(" {2,}", " ", merged_marks("".join(text)))
            if line.strip():
                out.append("#" * level + " " + line.strip() if 1 <= level <= 6 else line)
            text, held, mode, level = [], [], None, 0
        if tag == "r":
            runs += 1 if begins else -1
        elif tag == "pPr":
            properties += 1 if begins else -1
    return {"text": "\n\n".join(out), "insertions": counts["ins"], "deletions": counts["del"]}


def plain_text(data: bytes) -> str:
    """SRC-12."""
    return "".join(v for k, v in flow(data) if k == "text").strip()


def metadata(data: bytes) -> dict:
    root = part(data, "docProps/core.xml")

    def get(tag):
        e = root.find(tag) if root is not None else None
        return e.text if e is not None else None

    return {"title": get(f"{DC}title"), "author": get(f"{DC}creator"), "created": get(f"{TERMS}created"), "modified": get(f"{TERMS}modified")}


def change_counts(data: bytes) -> dict:
    """SRC-13: tracked insertions and deletions that are not blank."""
    root = part(data, "word/document.xml")
    n = {k: sum(bool(run_text(e).strip()) for e in root.iter(f"{W}{k}")) if root is not None else 0 for k in ("ins", "del")}
    return {"insertions": n["ins"], "deletions": n["del"]}


def equation_counts(data: bytes) -> dict:
    """SRC-14: equations on lines of their own, and inside of text."""
    root = part(data, "word/document.xml")
    display = sum(1 for _ in root.iter(f"{M}oMathPara")) if root is not None else 0
    return {"display": display, "inline": (sum(1 for _ in root.iter(f"{M}oMath")) if root is not None else 0) - display}


#: What can be read from files, and the rows it gives.
READERS = {
    "comments": (comments, "id string, author string, date string, text string, parent_id string"),
    "anchors": (anchors, "comment_id string, anchor string, before string, after string, doc_position int, doc_length int, is_empty boolean"),
    "headings": (headings, "style string, level int, text string, doc_position int"),
    "tables": (tables, "rows array<array<string>>, markdown string"),
    "tracked_text": (lambda d: [{"text": tracked_text(d)}], "text string"),
    "native_text": (lambda d: [native_text(d)], "text string, insertions int, deletions int"),
    "plain_text": (lambda d: [{"text": plain_text(d)}], "text string"),
    "metadata": (lambda d: [metadata(d)], "title string, author string, created string, modified string"),
    "change_counts": (lambda d: [change_counts(d)], "insertions int, deletions int"),
    "equation_counts": (lambda d: [equation_counts(d)], "display int, inline int"),
    "is_word": (lambda d: [{"is_word": is_word(d)}], "is_word boolean"),
}


def read(documents: DataFrame, what: str) -> DataFrame:
    """Rows of one kind from documents (path, content)."""
    schema = READERS[what][1]
    whole = T.StructType.fromDDL(f"path string, {schema}")
    arrow = to_arrow_schema(whole)

    def parse(batches):
        from marginalia.sources.docx import READERS

        reader = READERS[what][0]
        for batch in batches:
            rows = []
            # one file at a time as Python's
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                rows += [{"path": path.as_py()} | r for r in reader(content.as_py())]
                if len(rows) >= ROWS:
                    yield pa.RecordBatch.from_pylist(rows, arrow)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, arrow)

    sizes.small(documents.sparkSession)
    return documents.select("path", "content").mapInArrow(parse, whole)


#: All that an import needs of a file, read at once: its tracked text and comments if it has changes, else its plain text and tables.
PARTS = """path string, error string, changed boolean, tracked string, plain string, tables array<struct<ord: int, markdown: string>>,
    comments array<struct<ord: int, id: string, author: string, text: string, anchor: string, before: string, after: string, position: double, parent: string>>"""


def parts_of(data: bytes) -> dict:
    data = Opened(data)
    if not is_word(data):
        return {"error": "not a Word document"}
    counts = change_counts(data)
    if counts["insertions"] + counts["deletions"] == 0:
        text = "\n\n".join("".join(t.text or "" for t in p.iter(f"{W}t")) for p, _ in paragraphs(data))
        return {"changed": False, "plain": text, "tables": [{"ord": k, "markdown": t["markdown"]} for k, t in enumerate(tables(data))]}
    places = {a["comment_id"]: a for a in anchors(data)}
    found = []
    for k, c in enumerate(comments(data)):
        a = places.get(c["id"], {})
        share = a["doc_position"] / a["doc_length"] if a.get("doc_length") else 0.0
        found.append({"ord": k, "id": c["id"], "author": c["author"], "text": c["text"], "anchor": a.get("anchor", ""), "before": a.get("before", ""), "after": a.get("after", ""), "position": share, "parent": c["parent_id"]})
    # a reply comes behind its parent, whichever stands first in the file
    found.sort(key=lambda c: (c["parent"] is not None, c["ord"]))
    for k, c in enumerate(found):
        c["ord"] = k
    return {"changed": True, "tracked": tracked_text(data), "comments": found}


def parts(documents: DataFrame) -> DataFrame:
    """PARTS of documents (path, content); what can't be read is a row with an error."""
    schema = T.StructType.fromDDL(PARTS)
    arrow = to_arrow_schema(schema)

    def parse(batches):
        from marginalia.sources.docx import parts_of

        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    row = parts_of(content.as_py() or b"")
                except (KeyError, ValueError, zipfile.BadZipFile, zlib.error, ET.ParseError) as e:
                    row = {"error": f"{type(e).__name__}: {e}"}
                rows.append({"path": path.as_py()} | row)
                if len(rows) >= ROWS:
                    yield pa.RecordBatch.from_pylist(rows, arrow)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, arrow)

    sizes.small(documents.sparkSession)
    return documents.select("path", "content").mapInArrow(parse, schema)
