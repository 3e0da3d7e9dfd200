"""Markdown and LaTeX inside of texts as expressions (SCL-17..20, SCL-39)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .protect import replaced_by
from .text import bound, chain, chain_marked, col, strip

#: LaTeX as a word processor shows it; the order matters.
MATH = (
    (r"\\text\{([^}]+)\}", "$1"), (r"\\hat\{([^}]+)\}", "$1"), (r"\\bar\{([^}]+)\}", "$1"), (r"\\frac\{([^}]+)\}\{([^}]+)\}", "$1/$2"), (r"\\sum_([a-z])", "Σ"), (r"\\sum", "Σ"),
    (r"\\cdot", "·"), (r"\\quad", " "), (r"\\,", " "), (r"\\_", "_"), (r"\\", ""), (r"[{}]", ""), (r"\s+", " "),
)
#: markdown's marks, in the order in which they go.
MARKS = (
    (r"(?m)^---[\s\S]*?---\n*", ""), (r"(?m)^#{1,6}\s+", ""), (r"(\*\*|__)(.*?)\1", "$2"), (r"(\*|_)(.*?)\1", "$2"), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"!\[([^\]]*)\]\([^)]+\)", ""),
    (r"`([^`]+)`", "$1"), (r"```[\s\S]*?```", ""), (r"(?m)^>\s*", ""), (r"(?m)^[-*_]{3,}\s*$", ""), (r"(?m)^[\s]*[-*+]\s+", ""), (r"(?m)^[\s]*\d+\.\s+", ""), (r"\|", " "), (r"(?m)^[-:]+$", ""), (r"\n{3,}", "\n\n"),
)
#: What each of these patterns needs some of.
SOME_MARK = r"[-#*_\[`>+|:]|\d\.|\n{3}"
#: Fixed value: what a line may start with.
PREFIX = r"^(#{1,6}\s+|\s*[-*+]\s+|\s*\d+\.\s+|>\s*)"

#: Fixed value: a pipe table, its head with the line of dashes and its rows.
TABLE = r"(?m)^(\|[^\n]+\|\r?\n\|[-:| ]+\|\r?\n)((?:\|[^\n]+\|\r?\n?)++)"
#: Distributions as formulas; the order matters.
DISTRIBUTIONS = (
    (r"Half-Normal\(([^)]+)\)", r"\$\\text{Half-Normal}($1)\$"), (r"Normal\(([^)]+)\)", r"\$\\mathcal{N}($1)\$"), (r"Student-t\((\d+),\s*([^)]+)\)", r"\$t_{$1}($2)\$"),
    (r"Gamma\(([^)]+)\)", r"\$\\text{Gamma}($1)\$"), (r"Exponential\(([^)]+)\)", r"\$\\text{Exp}($1)\$"),
)


def plain_math(c: Column | str) -> Column:
    """SCL-17."""
    return strip(chain(c, *MATH))


def plain(c: Column | str) -> Column:
    """SCL-18."""
    return strip(chain(c, *MARKS))


def prefix(c: Column | str) -> Column:
    """SCL-19: struct<prefix, content>."""
    p = F.regexp_extract(col(c), PREFIX, 1)
    return F.struct(p.alias("prefix"), F.substr(col(c), F.length(p) + 1).alias("content"))


def tidy(c: Column | str) -> Column:
    """SCL-20, the markup part: a deletion beside an insertion is a substitution; broken and empty marks go."""
    return chain_marked(
        c,
        (r"\{--(.+?)--\}\s*\{\+\+(.+?)\+\+\}", "{~~$1~>$2~~}"),
        (r"\{\+\+(.+?)\+\+\}\s*\{--(.+?)--\}", "{~~$2~>$1~~}"),
        (r"\{--([^}]+?)~>([^}]+?)~~\}", "{~~$1~>$2~~}"),
        (r"\{~~([^~]+)\s*--\}", "{--$1--}"),
        (r"\{\+\+([^+]+)~~\}", "{++$1++}"),
        (r"\{--\s*--\}", ""),
        (r"\{\+\+\s*\+\+\}", ""),
    )


def latex_width(c: Column | str) -> Column:
    """SCL-39: a LaTeX width as percent or as it is; null for what has no simple form."""
    w = strip(c)
    share = F.regexp_extract(w, r"^(\d*\.?\d*)\s*\\(?:text|line|column)width$", 1)
    percent = F.concat(F.round(F.when(share == "", 1.0).otherwise(share.try_cast("double")) * 100).cast("int").cast("string"), F.lit("%"))
    return F.when(w.rlike(r"^\d*\.?\d*\s*\\(text|line|column)width$"), percent).when(w.rlike(r"^\d+(\.\d+)?\s*(cm|mm|in|pt|px|%)$"), w)


def braced(c: Column | str, command: str) -> Column:
    """SCL-39: the argument in braces behind the first place of a command, braces inside of it balanced; null if there is none.

    A fold over the characters counts the depth; what follows a backslash
    counts as a letter.
    """
    text = col(c)
    at = F.instr(text, command)
    rest = F.regexp_replace(F.substr(text, at + len(command)), r"^\s+", "")
    begin = F.struct(F.lit(0).alias("i"), F.lit(0).alias("depth"), F.lit(False).alias("skip"), F.lit(0).alias("end"))

    def step(s: Column, ch: Column) -> Column:
        i = (s["i"] + 1).alias("i")
        depth = F.when(s["skip"], s["depth"]).when(ch == "{", s["depth"] + 1).when(ch == "}", s["depth"] - 1).otherwise(s["depth"])
        skip = ~s["skip"] & (ch == "\\")
        end = F.when(~s["skip"] & (ch == "}") & (s["depth"] == 1), s["i"] + 1).otherwise(0)
        return F.when(s["end"] > 0, s).otherwise(F.struct(i, depth.alias("depth"), skip.alias("skip"), end.alias("end")))

    def inside(r: Column) -> Column:
        end = F.aggregate(F.split(r, ""), begin, step, lambda s: s["end"])
        return bound(end, lambda e: F.when(e > 0, F.substr(r, F.lit(2), e - 2)))

    return F.when((at > 0) & rest.startswith("{"), bound(rest, inside))


def tables_kept_whole(c: Column | str, nowrap: list[str], to: str = "pdf") -> Column:
    """SCL-38: in columns whose header has one of the names, distributions become formulas, so that cells are not broken; for pdf and tex only.

    Cells that are empty, or begin with a formula or a command, stay.  Tables
    without such a column stay byte for byte; others end with a line feed.
    """
    names = [n.lower() for n in nowrap]
    if to not in ("pdf", "tex") or not names:
        return col(c)

    def cell(x: Column) -> Column:
        own = strip(x)
        return F.when((own == "") | own.startswith("$") | own.startswith("\\"), x).otherwise(F.concat(F.lit(" "), chain(own, *DISTRIBUTIONS), F.lit(" ")))

    def table(whole: Column) -> Column:
        head = F.regexp_extract(whole, r"\A[^\n]*\n[^\n]*\n", 0)
        titles = F.transform(F.split(F.split(whole, "\n", 2)[0], r"\|", -1), lambda t: F.lower(strip(t)))
        # the first and the last piece of a row stand outside of the bars
        wanted = F.transform(titles, lambda t, k: (k > 0) & (k < F.size(titles) - 1) & F.array_max(F.array(*(F.contains(t, F.lit(n)) for n in names))))
        rows = F.filter(F.split(F.substr(whole, F.length(head) + 1), r"\r?\n", -1), lambda r: strip(r) != "")

        def put(own: Column) -> Column:
            row = lambda r: F.array_join(F.transform(F.split(r, r"\|", -1), lambda x, k: F.when(F.coalesce(F.get(own, k), F.lit(False)), cell(x)).otherwise(x)), "|")
            return F.when(F.array_max(own), F.concat(head, F.array_join(F.transform(rows, row), "\n"), F.lit("\n"))).otherwise(whole)

        return bound(wanted, put)

    return replaced_by(c, TABLE, table)
