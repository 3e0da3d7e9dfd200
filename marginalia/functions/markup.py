"""Inline annotations as expressions: insertions, deletions, substitutions, comments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, chain, col, running, strip

#: The annotation grammar.
INSERT = r"(?s)\{\+\+(.+?)\+\+\}"
DELETE = r"(?s)\{--(.+?)--\}"
SUBSTITUTE = r"(?s)\{~~(.+?)~>(.+?)~~\}"
COMMENT = r"(?s)\{>>(.+?)<<\}"
HIGHLIGHT = r"(?s)\{==(.+?)==\}"
KINDS = {"insert": INSERT, "delete": DELETE, "substitute": SUBSTITUTE, "comment": COMMENT}
#: Order of kinds that start at the same place.
RANKS = {"insert": 0, "delete": 1, "substitute": 2, "comment": 3}
RESOLVED = ("[RESOLVED]", "[✓]")
#: Passes over nested markup.
PASSES = 20
#: Anything that looks like a marker.
MARKER = r"(?=[{+\-~<\[])(?:\{(?:\+\+|--|~~|==|>>)|\+\+\}|--\}|~[~>]|<<\}|\[)"


def all_of(c: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col(c), F.lit(pattern), F.lit(group))


def matches(c: Column | str, pattern: str, groups: int) -> Column:
    """array<struct<pos, match, g1, ...>>: matches with their offsets, in order.

    An offset is the sum of the lengths of what stands between the matches
    before it and of these matches.
    """

    def placed(whole: Column) -> Column:
        between = F.transform(F.split(col(c), pattern, -1), F.length)
        steps = running(F.zip_with(F.slice(between, F.lit(1), F.size(whole)), F.transform(whole, F.length), lambda b, w: b + w))
        parts = lambda x: [F.regexp_extract(x, pattern, g).alias(f"g{g}") for g in range(1, groups + 1)]
        each = F.zip_with(whole, F.zip_with(steps, F.slice(between, F.lit(1), F.size(whole)), lambda s, b: s + b), lambda x, p: F.struct(p.alias("pos"), x.alias("match"), *parts(x)))
        return F.when(F.size(whole) > 0, each).otherwise(F.slice(each, 1, 0))

    return bound(all_of(c, pattern), placed)


def strip_once(c: Column, keep_comments: bool = False) -> Column:
    """One pass of SCL-01."""
    steps = [(SUBSTITUTE, "$2"), (INSERT, "$1"), (DELETE, ""), (HIGHLIGHT, "$1")]
    if not keep_comments:
        steps.append((COMMENT, ""))
    mark = r"(?<!<<\}\s{0,3})" if keep_comments else ""
    steps += [
        (mark + r"\[([^\]]*)\]\{\.mark\}", "$1"),
        (r"\{----\}", ""), (r"\{\+\+\+\+\}", ""), (r"\{--\s*--\}", ""), (r"\{\+\+\s*\+\+\}", ""),
        (r"~>[^{]*?~~\}", ""), (r"(?m)\{~~[^~}]*$", ""),
        (r"\{~~\{~~", "{~~"), (r"~~\}~~\}", "~~}"),
    ]
    return chain(c, *steps)


def stripped(c: Column | str, keep_comments: bool = False, passes: int = PASSES) -> Column:
    """SCL-01: the text as if all changes were accepted, down to nested and orphaned markers.

    What stands before the first marker is looked through once and left alone;
    passes over the rest go on until one changes nothing.
    """
    some = r"(?=[{+\-~\]])(?:\{\+\+|\+\+\}|\{--|--\}|\{~~|~~\}|~>|\{==|\]\{\.mark\}" + (")" if keep_comments else r"|\{>>)")

    def once(s: Column, _: Column) -> Column:
        return F.when(s["more"], bound(strip_once(s["t"], keep_comments), lambda n: F.struct(n.alias("t"), (n != s["t"]).alias("more")))).otherwise(s)

    def rest(t: Column) -> Column:
        begin = F.struct(t.alias("t"), t.rlike(some).alias("more"))
        text = F.aggregate(F.sequence(F.lit(1), F.lit(passes)), begin, once, lambda s: s["t"])
        return chain(text, (r"--\}|\+\+\}|~~\}", ""), (r"\{--|\{\+\+|\{~~", ""), (r"~>", ""), (r"\[(?![^\]\n]*\])", ""))

    text = col(c)
    return bound(F.get(F.split(text, MARKER, 2), F.lit(0)), lambda head: F.when(F.length(head) == F.length(text), text).otherwise(F.concat(head, bound(F.substr(text, F.length(head) + 1), rest))))


def _without_lone_end(opener: str, closer: str):
    def kept(piece: Column) -> Column:
        before = F.left(piece, F.length(piece) - len(closer))
        return F.when(F.endswith(piece, F.lit(closer)) & ~F.contains(before, F.lit(opener)), before).otherwise(piece)

    return kept


def without_orphans(c: Column | str) -> Column:
    """SCL-06: ends without a beginning go; beginnings without an end leave their content, of a substitution the new text.

    An end has a beginning if one of its kind stands before it with no closing
    brace between them, so each stretch up to a brace is looked at by itself.
    """
    out = col(c)
    for opener, closer in (("{++", "++}"), ("{--", "--}"), ("{~~", "~~}")):
        out = F.array_join(F.transform(F.split(out, r"(?<=\})", -1), _without_lone_end(opener, closer)), "")
    ahead = r"(?=\{[+\-~>]|\z)"
    return chain(out, (r"\{\+\+([^+]*?)" + ahead, "$1"), (r"\{--([^-]*?)" + ahead, "$1"), (r"\{~~(?!\})[^~]*?~>([^~]*?)" + ahead, "$1"))


def is_annotated(c: Column | str) -> Column:
    """SCL-03."""
    out = col(c).rlike(HIGHLIGHT)
    for p in KINDS.values():
        out = out | col(c).rlike(p)
    return out


def comments_in(c: Column | str) -> Column:
    return F.array_join(all_of(c, r"(?s)\{>>.*?<<\}"), "")


def decided(kind: Column | str, match: Column | str, content: Column | str, replacement: Column | str, accept: Column) -> Column:
    """SCL-04: what an annotation becomes; comments inside removed text stay."""
    k, inside = col(kind), comments_in(match)
    return (
        F.when(k == "insert", F.when(accept, col(content)).otherwise(inside))
        .when(k == "delete", F.when(accept, inside).otherwise(col(content)))
        .when(k == "substitute", F.when(accept, F.concat(comments_in(content), F.coalesce(col(replacement), F.lit("")))).otherwise(col(content)))
        .otherwise(col(match))
    )


def all_accepted(c: Column | str) -> Column:
    """SCL-04 for every change of a text without nested markup."""
    return chain(c, (SUBSTITUTE, "$2"), (INSERT, "$1"), (DELETE, ""))


def all_rejected(c: Column | str) -> Column:
    return chain(c, (SUBSTITUTE, "$1"), (INSERT, ""), (DELETE, "$1"))


def is_resolved(content: Column | str) -> Column:
    """EXT-05."""
    c = strip(content)
    return F.endswith(c, F.lit(RESOLVED[0])) | F.endswith(c, F.lit(RESOLVED[1]))


def without_status(content: Column | str) -> Column:
    return strip(chain(content, (r"\s*(\[RESOLVED\]|\[✓\])\s*$", "")))


def with_status(match: Column | str, resolved: bool) -> Column:
    """SCL-05: a comment's markup, marked as resolved or as pending."""
    bare = chain(match, (r"\s*(\[RESOLVED\]|\[✓\])\s*<<\}$", "<<}"))
    return chain(bare, (r"<<\}$", " [RESOLVED]<<}")) if resolved else bare


def author_of(content: Column | str) -> Column:
    """EXT-03: what stands before a colon within the first 30 characters."""
    at = F.instr(col(content), ":") - 1
    return F.when((at > 0) & (at < 30), strip(F.substring(col(content), F.lit(1), at))).otherwise("")


def said(content: Column | str) -> Column:
    at = F.instr(col(content), ":") - 1
    return F.when((at > 0) & (at < 30), strip(F.substr(col(content), at + 2))).otherwise(col(content))


def is_false_comment(content: Column | str, text: Column | str, pos: Column | str) -> Column:
    """EXT-02: captions, code, links and the like that look like comments.

    pos is the offset of the comment in the text.
    """
    c, t, p = strip(content), col(text), col(pos)
    raw = col(content)
    before = F.substr(t, F.greatest(p - 2000, F.lit(0)) + 1, F.least(p, F.lit(2000)))
    near = F.substr(t, F.greatest(p - 500, F.lit(0)) + 1, F.least(p, F.lit(500)))
    line = F.substring_index(before, "\n", -1)

    def open_of(a: str, b: str) -> Column:
        return F.regexp_count(near, F.lit(a)) > F.regexp_count(near, F.lit(b))

    author = c.rlike(r"^\p{L}[\p{L}\s\-'.]{0,30}:\s")
    marked = c.rlike(r"^[✓✔]\s")
    fences = F.regexp_count(before, F.lit(r"(?m)^```|^~~~")) > F.regexp_count(before, F.lit(r"(?m)```$|~~~$"))
    return (
        fences
        | line.rlike(r"^(\t|    )")
        | (F.regexp_count(line, F.lit("`")) % 2 == 1)
        | open_of(r"\{--", r"--\}")
        | open_of(r"\{\+\+", r"\+\+\}")
        | raw.rlike(r"(?i)\(figures?/|\(images?/|\.png|\.jpg|\.jpeg|\.gif|\.svg|\.pdf")
        | raw.rlike(r"\{#fig:|!\[")
        | (~author & raw.rlike(r"(?i)https?://|www\.") & (F.length(raw) < 150))
        | raw.rlike(r"function\s*\(|=>|import\s+|export\s+|const\s+|let\s+|var\s+")
        | (~author & ~marked & (F.length(raw) > 200))
        | c.rlike(r"(?i)^(Fig\.?|Figure|Table|Sankey|Diagram|Proportion|Distribution|Map|Chart|Graph|Plot|Panel)")
        | raw.rlike(r"\\[a-z]+\{|\\frac|\\sum|\\int|\\begin\{")
        | raw.rlike(r"(?i)@article\{|@book\{|@inproceedings\{")
    )


def visible_comments(c: Column | str) -> Column:
    """EXT-24: [Author: text] as comment markup."""
    return chain(c, (r"\[([^\]:]+):\s*([^\]]+)\]", "{>>$1: $2<<}"))


def latex_comments(c: Column | str) -> Column:
    """SCL-36: comments as margin notes, tracked changes as colours."""
    return chain(c, (COMMENT, r"\\marginnote{$1}"), (INSERT, r"\\textcolor{blue}{$1}"), (DELETE, r"\\textcolor{red}{$1}"), (SUBSTITUTE, r"\\textcolor{red}{$1}\\textcolor{blue}{$2}"))


def marker_counts(c: Column | str) -> dict[str, Column]:
    """AGG-20: raw counts of the opening markers."""
    return {k: F.regexp_count(col(c), F.lit(p)) for k, p in {"inserts": r"\{\+\+", "deletes": r"\{--", "substitutes": r"\{~~", "comments": r"\{>>"}.items()}
