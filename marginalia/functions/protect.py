"""Pieces that a diff must not cut, put away behind stand-ins and brought back (SCL-22, SCL-23, SCL-21)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import markdown
from .text import bound, chain, chain_marked, col

#: Tables, images with their anchors, anchors, references, mathematics, citations.
TABLE = r"(?:^|\n)\|[^\n]*\|[ \t]*(?:\n\|[^\n]*\|[ \t]*)+"
IMAGE = r"!\[[^\]]*\]\([^)]+\)(?:\{[^}]+\})?"
MATH = r"\$\$[\s\S]+?\$\$|\$[^$\n]+\$"
CITATION = r"\[@[^\]]+\]"
PROTECTED = "|".join((IMAGE, MATH, CITATION, r"@(?:fig|tbl|eq):[\w-]+", r"\{#[^}]+\}"))
#: Tables and all of these; what they begin with is looked for first.
WHOLE = rf"(?=[\n|!$\[@{{])(?:{TABLE}|{PROTECTED})"
#: Fixed value: a citation as a word processor shows it, (Author 2021), (Author et al. 2021; Other 2020a) and so on.
_NAME, _MORE = r"[A-Z][a-zé]+(?:\s+et\s+al\.?)?", r"(?:\s*[&,;]\s*[A-Z][a-zé]+(?:\s+et\s+al\.?)?)*"
SHOWN_CITATION = rf"\({_NAME}{_MORE}\s+\d{{4}}(?:[a-z])?(?:\s*[,;]\s*(?:{_NAME}\s+)?\d{{4}}(?:[a-z])?)*\)"


def pieces(*texts: Column | str, pattern: str = PROTECTED) -> Column:
    """The different protected pieces of all texts, in order of first appearance."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(F.coalesce(col(t), F.lit("")), F.lit(pattern), F.lit(0)) for t in texts]))


def fence(*texts: Column | str) -> Column:
    """A run of `q` longer than any in the texts: what begins with it stands in none of them."""
    runs = F.concat(*[F.regexp_extract_all(F.coalesce(col(t), F.lit("")), F.lit("q+"), F.lit(0)) for t in texts])
    return F.repeat(F.lit("q"), F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0)) + 1)


def interleaved(between: Column, inserted: Column) -> Column:
    """between[0] inserted[0] between[1] ...: one more of the former than of the latter."""
    return F.array_join(F.zip_with(between, inserted, lambda b, x: F.concat(b, F.coalesce(x, F.lit("")))), "")


def replaced_by(text: Column | str, pattern: str, function) -> Column:
    """Every match becomes what the function makes of it; function: match, and its number from 0 if it takes two."""
    t = col(text)
    return bound(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, t).otherwise(interleaved(F.split(t, pattern, -1), F.transform(found, function))))


def hidden(text: Column | str, known: Column, mark: Column, pattern: str = PROTECTED) -> Column:
    """The text with every protected piece as one word: the fence, the piece's number in `known`, `x`."""
    found = F.regexp_extract_all(col(text), F.lit(pattern), F.lit(0))
    names = F.transform(found, lambda p: F.concat(mark, F.array_position(known, p).cast("string"), F.lit("x")))
    return F.when((F.size(known) == 0) | (F.size(found) == 0), col(text)).otherwise(interleaved(F.split(col(text), pattern, -1), names))


def shown(text: Column | str, known: Column, mark: Column) -> Column:
    """The text with all pieces back in their places."""
    stand_in = F.concat(mark, F.lit(r"(\d+)x"))
    found = F.regexp_extract_all(col(text), stand_in, F.lit(1))
    return F.when(F.size(found) == 0, col(text)).otherwise(interleaved(F.split(col(text), stand_in, F.lit(-1)), F.transform(found, lambda n: F.get(known, n.cast("int") - 1))))


def math_recognized(text: Column | str, known: Column, mark: Column) -> Column:
    """SCL-23: the first place of each formula as a word processor shows it becomes the formula's stand-in."""

    def put(t: Column, p: Column) -> Column:
        plain = markdown.plain_math(F.regexp_replace(p["piece"], F.lit(r"^\$+|\$+$"), F.lit("")))
        at = F.instr(t, plain)
        return F.when((F.length(plain) >= 2) & (at > 0), F.concat(F.left(t, at - 1), mark, p["n"].cast("string"), F.lit("x"), F.substr(t, at + F.length(plain)))).otherwise(t)

    formulas = F.filter(F.transform(known, lambda p, k: F.struct((k + 1).alias("n"), p.alias("piece"))), lambda p: p["piece"].startswith("$"))
    return F.aggregate(formulas, col(text), put)


def citations_recognized(text: Column | str, known: Column, mark: Column) -> Column:
    """SCL-23: the citations that a word processor shows become the stand-ins of the source's, in order, as far as these go."""
    own = F.filter(F.transform(known, lambda p, k: F.struct((k + 1).alias("n"), p.alias("piece"))), lambda p: p["piece"].startswith("[@"))

    def put(found: Column) -> Column:
        # one stand-in to each shown citation, as long as there are some
        names = F.zip_with(found, F.slice(own, F.lit(1), F.size(found)), lambda p, o: F.coalesce(F.concat(mark, o["n"].cast("string"), F.lit("x")), p))
        return F.when(F.size(found) == 0, col(text)).otherwise(interleaved(F.split(col(text), SHOWN_CITATION, -1), names))

    return bound(F.regexp_extract_all(col(text), F.lit(SHOWN_CITATION), F.lit(0)), put)


#: Fixed values of SCL-21, in this order: formulas and citations stay, shown citations and their fragments go.
_AUTHOR = r"\p{Lu}\p{L}*(?:\s+et\s+al\.?)?"
_YEAR, _YEARS = r"\d{4}[a-z]?", r"(?:[;,]\s*" + _AUTHOR + r"\s+\d{4}[a-z]?)*"
_LOOSE_YEARS = r"(?:[;,]\s*(?:" + _AUTHOR + r"\s+)?\d{4}[a-z]?)*"
KEPT_FORMULAS = (
    (r"\{--(\$[^$]+\$)--\}", "$1"), (r"\{--(\$\$[^$]+\$\$)--\}", "$1"), (r"\{~~(\$[^$]+\$)~>[^~]+~~\}", "$1"), (r"\{~~(\$\$[^$]+\$\$)~>[^~]+~~\}", "$1"),
    (r"\{~~(\[@[^\]]+\])~>[^~]+~~\}", "$1"),
)
FRAGMENTS = (
    (r"\{--(\[@[^\]]+\])--\}", "$1"), (r"\{\+\+\([A-Z][^)]*\d{4}[^)]*\)\+\+\}", ""), (r"\{~~(@[A-Za-z]+\d{4})~>[^~]+~~\}", "[$1]"),
    (r"\{~~\[@~>[^~]*~~\}([A-Za-z]+\d{4})\]", "[@$1]"), (r"\{~~;\s*@([A-Za-z]+\d{4})\]~>[^~]*~~\}", "; [@$1]"),
    (rf"\{{\+\+\({_AUTHOR}\s+{_YEAR}{_YEARS}\)\+\+\}}", ""), (rf"\{{\+\+\({_AUTHOR}\s+{_YEAR}{_YEARS}\)\.\s*\+\+\}}", ""),
    (rf"\{{\+\+{_YEAR}{_LOOSE_YEARS}\)\.\s*\+\+\}}", ""), (rf"\{{\+\+{_YEAR}{_LOOSE_YEARS}\)\s*\+\+\}}", ""),
    (rf"\{{\+\+{_YEAR}\)\.\s*\+\+\}}", ""), (rf"\{{\+\+{_YEAR}\)\s*\+\+\}}", ""), (rf"\{{\+\+\(?{_AUTHOR}\s*\+\+\}}", ""), (rf"\{{\+\+[;,]\s*{_AUTHOR}\s+{_YEAR}\+\+\}}", ""),
    (rf"\{{\+\+{_AUTHOR}\s+{_YEAR}{_YEARS}\)\s*\+\+\}}", ""), (rf"\{{\+\+{_AUTHOR}\s+{_YEAR}{_YEARS}\)\.\s*\+\+\}}", ""),
    (r"  +", " "), (r"\s+\.", "."), (r"\s+,", ","), (r"\{~~\s*~>\s*~~\}", ""), (r"\{\+\+\s*\+\+\}", ""), (r"\{--\s*--\}", ""),
)
#: A substitution whose old side begins with a citation.
LED = r"\{~~(\[@[^\]]+\])\s*([^~]*)~>([^~]*)~~\}"


def citations_kept(text: Column | str) -> Column:
    """SCL-21: annotations that would replace citations and formulas by what a word processor shows of them go."""

    def led(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(LED), F.lit(0))

        def one(m: Column) -> Column:
            cite, old, new = (F.regexp_extract(m, LED, g) for g in (1, 2, 3))
            was, now = (chain(c, (r"^\s+|\s+$", "")) for c in (old, new))
            change = F.when(was != now, F.concat(F.lit(" {~~"), was, F.lit("~>"), now, F.lit("~~}"))).otherwise(F.concat(F.lit(" "), new))
            return F.concat(cite, F.when((was == "") & (now == ""), "").otherwise(change))

        return F.when(F.size(found) == 0, t).otherwise(interleaved(F.split(t, LED, -1), F.transform(found, one)))

    return chain_marked(bound(chain_marked(text, *KEPT_FORMULAS), led), *FRAGMENTS)
