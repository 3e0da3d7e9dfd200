"""Scalar text functions: Column in, Column out (SCL-*)."""

from __future__ import annotations

import re
from itertools import groupby

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII word boundary; \b of the JVM is Unicode-aware (H2).
LEFT, RIGHT = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
SPACE = re.compile(r"[ \t\n\x0b\f\r]+")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def chain(c: Column | str, *steps: tuple[str, str]) -> Column:
    """Regular-expression replacements, one after the other."""
    c = col(c)
    for pattern, to in steps:
        c = F.regexp_replace(c, F.lit(pattern), F.lit(to))
    return c


def bound(value: Column, function) -> Column:
    """function of a value that is computed once, however often the function names it."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def chain_marked(c: Column | str, *steps: tuple[str, str]) -> Column:
    """The same as chain; steps that begin with the mark of an annotation are left out for texts without that mark."""

    def mark(step: tuple[str, str]) -> str | None:
        return next((m for m in (r"\{--", r"\{\+\+", r"\{~~") if step[0].startswith(m)), None)

    def where(own: str, some: list[tuple[str, str]]):
        return lambda t: F.when(F.contains(t, F.lit(own.replace("\\", ""))), chain(t, *some)).otherwise(t)

    c = col(c)
    for own, some in groupby(steps, mark):
        c = chain(c, *some) if own is None else bound(c, where(own, list(some)))
    return c


def running(lengths: Column, chunk: int = 128) -> Column:
    """Sums of the lengths before each one.  Chunks are summed first, so that the work stays near to linear."""

    def sums(own: Column, base: Column) -> Column:
        begin = F.struct(base.alias("at"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(own, begin, lambda s, n: F.struct((s["at"] + n).alias("at"), F.array_append(s["all"], s["at"]).alias("all")), lambda s: s["all"])

    def chunks(all_of: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(all_of), F.lit(1)), F.lit(chunk)), lambda k: F.slice(all_of, k, F.lit(chunk)))

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0), lambda s, n: s + n)

    def based(parts: Column) -> Column:
        totals = F.transform(parts, total)
        return bound(totals, lambda t: F.flatten(F.transform(parts, lambda p, k: sums(p, total(F.slice(t, F.lit(1), k))))))

    return bound(lengths, lambda all_of: bound(chunks(all_of), based))


def strip(c: Column | str) -> Column:
    """Without white space at both ends; trim() of Spark takes blanks only."""
    return chain(c, (r"^\s+|\s+$", ""))


def words(c: Column | str) -> Column:
    """Runs between white space, empty ones left out."""
    return F.filter(F.split(col(c), r"\s+"), lambda w: w != "")


def plain_word_count(c: Column | str) -> Column:
    """SCL-08."""
    return F.size(words(c))


def count_words(c: Column | str) -> Column:
    """SCL-07: words of manuscript text without its markup; the order of the steps matters."""
    bare = chain(
        c,
        (r"(?m)^---[\s\S]*?---", ""),
        (r"!\[.*?\]\(.*?\)", ""),
        (r"\[([^\]]+)\]\([^)]+\)", "$1"),
        (r"#+\s*", ""),
        (r"\*\*|__|[*_`]", ""),
        (r"```[\s\S]*?```", ""),
        (r"\{[^}]+\}", ""),
        (r"@[A-Za-z0-9_]+:[A-Za-z0-9_]+", ""),
        (r"@[A-Za-z0-9_]+", ""),
        (r"\|[^|]+\|", " "),
        (r"[-=]{3,}", ""),
    )
    return F.size(words(bare))


def normalize_whitespace(c: Column | str) -> Column:
    """SCL-09."""
    return strip(chain(F.replace(col(c), F.lit("\r\n"), F.lit("\n")), (r"\t", "    "), (r" +", " ")))


def replaced(c: Column | str, *pairs: tuple[str, str]) -> Column:
    """Literal replacements in order."""
    c = col(c)
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


#: XML entities in the order in which they are written.
XML = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))


def escape_xml(c: Column | str) -> Column:
    """SCL-10."""
    return replaced(c, *XML)


def unescape_xml(c: Column | str) -> Column:
    """SCL-10: the ampersand comes last."""
    return replaced(c, *[(b, a) for a, b in reversed(XML)])


def escape_latex(c: Column | str) -> Column:
    """SCL-11: the braces that stand for a backslash are escaped again, and line feeds become blanks."""
    c = replaced(c, ("\\", "\\textbackslash{}"))
    c = chain(c, (r"([#$%&_{}])", r"\\$1"))
    return replaced(c, ("^", "\\textasciicircum{}"), ("~", "\\textasciitilde{}"), ("\n", " "))


def slug(c: Column | str, most: int = 80) -> Column:
    """SCL-24: title as a file name, cut at a dash if that leaves half of it."""
    s = chain(F.lower(col(c)), (r"[^a-z0-9]+", "-"), (r"^-+|-+$", ""))
    cut = F.substring(s, 1, most)
    last = F.length(cut) - F.instr(F.reverse(cut), "-")
    short = F.when((F.instr(cut, "-") > 0) & (last >= most / 2), F.substring(cut, F.lit(1), last.cast("int"))).otherwise(cut)
    return F.when(F.coalesce(s, F.lit("")) == "", "paper").otherwise(F.when(F.length(s) <= most, s).otherwise(short))


def header_file(c: Column | str) -> Column:
    """SCL-24: section header as a file name."""
    return F.concat(F.substring(chain(F.lower(col(c)), (r"[^a-z0-9]+", "-"), (r"^-|-$", "")), 1, 30), F.lit(".md"))


def title_case(c: Column | str) -> Column:
    return F.initcap(col(c))


def for_matching(c: Column | str) -> Column:
    """SCL-15: lower-case letters, digits and single blanks."""
    return strip(chain(F.lower(F.coalesce(col(c), F.lit(""))), (r"[{}\\]", ""), (r"[^a-z0-9\s]", " "), (r"\s+", " ")))


def is_doi(c: Column | str) -> Column:
    """SCL-12."""
    return F.coalesce(col(c).rlike(r"^10\.\d{4,}/\S+$"), F.lit(False))


def bare_doi(c: Column | str) -> Column:
    """SCL-13."""
    return chain(c, (r"(?i)^https?://(dx\.)?doi\.org/", ""))


def bare_orcid(c: Column | str) -> Column:
    """SCL-14."""
    return strip(chain(c, (r"(?i)^https?://orcid\.org/", "")))


def is_orcid(c: Column | str) -> Column:
    """SCL-14: the form only, no check digit."""
    return F.coalesce(bare_orcid(c).rlike(r"^\d{4}-\d{4}-\d{4}-\d{3}[\dX]$"), F.lit(False))


def is_supplement(doi: Column | str, title: Column | str, journal: Column | str) -> Column:
    """SCL-16: supplements, figures and reviews, by their DOI, title or journal."""
    d, t, j = (F.lower(F.coalesce(col(c), F.lit(""))) for c in (doi, title, journal))
    return d.rlike(r"\.suppl|/suppl|\.figure|/figure|\.s\d+$|_s\d+$") | d.rlike(r"10\.3410/f\.") | j.rlike("faculty opinions") | t.rlike("^supplementary|^supporting information|^appendix")


def similarity(a: Column | str, b: Column | str, longer_than: int = 2) -> Column:
    """SCL-27: share of the second text's words that the first has; not symmetric.

    Looking up each word needs a hash set, which expressions over arrays do
    not have: for long texts a vectorised function beats them by far.
    """

    @F.pandas_udf("double")
    def share(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for one, two in zip(x, y, strict=True):
            first = {w for w in SPACE.split((one or "").lower()) if len(w) > longer_than}
            second = [w for w in SPACE.split((two or "").lower()) if len(w) > longer_than]
            out.append(sum(w in first for w in second) / max(len(first), len(second)) if first and second else 0.0)
        return pd.Series(out, dtype=float)

    return share(col(a), col(b))


def variables(c: Column | str) -> Column:
    """EXT-28: distinct names of {{name}}, in order."""
    return F.array_distinct(F.regexp_extract_all(col(c), F.lit(r"\{\{([A-Za-z0-9_]+)\}\}"), F.lit(1)))


def dated(form: Column | str, date: Column | str) -> Column:
    """SCL-25: the first of each token of a date pattern replaced."""
    f, d = col(form), col(date)

    def once(c: Column, token: str, to: str) -> Column:
        return F.regexp_replace(c, F.lit(f"^([\\s\\S]*?){token}"), F.lit(f"$1{to}"))

    marks = (("YYYY", "\x01"), ("MMMM", "\x02"), ("MMM", "\x03"), ("MM", "\x04"), ("DD", "\x05"), (r"(?<![A-Za-z0-9_])D(?![A-Za-z0-9_])", "\x06"))
    for token, mark in marks:
        f = once(f, token, mark)
    for mark, form_of in (("\x01", "yyyy"), ("\x02", "MMMM"), ("\x03", "MMM"), ("\x04", "MM"), ("\x05", "dd"), ("\x06", "d")):
        f = F.replace(f, F.lit(mark), F.date_format(d, form_of))
    return f


def retry_after_ms(c: Column | str, now: Column) -> Column:
    """SCL-42: a Retry-After header, in seconds or as a date, as milliseconds from now."""
    seconds = col(c).try_cast("double")
    at = F.try_to_timestamp(F.regexp_replace(col(c), r"^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss 'GMT'"))
    return F.coalesce(seconds * 1000, F.greatest(F.lit(0.0), (F.unix_timestamp(at) - F.unix_timestamp(now)) * 1000.0))


def authors(c: Column | str) -> Column:
    """SCL-48: names of a bibliography's author field."""
    return F.transform(F.split(col(c), r"(?i)\s+and\s+"), strip)


def surname(c: Column | str) -> Column:
    """SCL-48: of the first author, in either order of names."""
    first = F.element_at(authors(c), 1)
    return F.when(F.instr(first, ",") > 0, strip(F.element_at(F.split(first, ","), 1))).otherwise(F.element_at(F.split(first, r"\s+"), -1))


def section_is_empty(c: Column | str) -> Column:
    """FLT-08."""
    return F.length(strip(c)) < 50


def looks_like_name(c: Column | str) -> Column:
    """FLT-07."""
    return col(c).rlike("^[A-Z][a-z]{2,}$")


def pdf_string(c: Column | str) -> Column:
    """SCL-35."""
    return strip(chain(c, (r"\\n", "\n"), (r"\\r", ""), (r"\\([()\\])", "$1"), (r"\x00", "")))


def pdf_date(c: Column | str) -> Column:
    """SCL-35: D:YYYYMMDD... as YYYY-MM-DD."""
    d = F.regexp_replace(col(c), "^D:", "")
    return F.when(d.rlike(r"^\d{8}"), F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2)))


def without_frontmatter(c: Column | str) -> Column:
    """SCL-40."""
    return chain(c, (r"\A---\n[\s\S]*?\n---\n?", ""))


def anonymized(c: Column | str, names: list[str]) -> Column:
    """SCL-41: author fields, thanks and the given names out of a text."""
    c = chain(
        c,
        (r"(?m)^(author|authors|affiliation|affiliations|email|orcid):.*(\n[ \t]+.*)*\n?", ""),
        (r"(?mi)^#+\s*(Acknowledgments?|Acknowledgements?|Funding)\s*\n[\s\S]*?(?=^#|\z)", ""),
    )
    for name in names:
        last = name.split()[-1]
        c = chain(c, (f"(?i){LEFT}{_literal(name)}{RIGHT}", "[AUTHOR]"), (f"(?i)@{_literal(last)}(\\d{{4}})", "@AUTHOR$1"))
    return c


def _literal(text: str) -> str:
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in text)
