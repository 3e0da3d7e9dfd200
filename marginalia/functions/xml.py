"""XML texts as tokens with their places (SRC-15): the tokens of a text, put together, are the text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, col, running

#: Comment, character data, processing instruction, tag (a `>` in quotes does not end it), text; what is never closed goes up to the end.
TOKEN = r"""<!--[\s\S]*?-->|<!\[CDATA\[[\s\S]*?\]\]>|<\?[\s\S]*?\?>|<(?!!--|!\[CDATA\[|\?)[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>|<[\s\S]*|[^<]+"""


def kind(raw: Column) -> Column:
    """What a token is."""
    opens = lambda s: F.startswith(raw, F.lit(s))
    return (
        F.when(~opens("<"), "text").when(opens("<!--"), "comment").when(opens("<![CDATA["), "cdata").when(opens("<?xml"), "decl").when(opens("<?"), "pi")
        .when(opens("</"), "close").when(F.endswith(raw, F.lit("/>")), "selfclose").otherwise("open")
    )


def name(raw: Column) -> Column:
    """struct<prefix, local> of a tag's name; both empty where there is none."""
    whole = F.when(kind(raw).isin("open", "close", "selfclose"), F.regexp_extract(raw, r"^</?([^\s/>]*)", 1)).otherwise("")
    return F.struct(F.regexp_extract(whole, r"^([^:]*):", 1).alias("prefix"), F.regexp_replace(whole, r"^[^:]*:", "").alias("local"))


def tokens(c: Column | str) -> Column:
    """array<struct<kind, prefix, local, start, end, raw>>: offsets in code points; null for a null text."""

    def placed(raws: Column) -> Column:
        lengths = F.transform(raws, F.length)
        each = F.zip_with(raws, F.zip_with(running(lengths), lengths, lambda s, n: F.struct(s.alias("s"), n.alias("n"))), lambda r, p: F.struct(
            kind(r).alias("kind"), name(r)["prefix"].alias("prefix"), name(r)["local"].alias("local"), p["s"].alias("start"), (p["s"] + p["n"]).alias("end"), r.alias("raw")))
        return F.when(F.size(raws) > 0, each).otherwise(F.slice(each, 1, 0))

    return bound(F.regexp_extract_all(col(c), F.lit(TOKEN), F.lit(0)), placed)


def namespaces(c: Column | str) -> Column:
    """map<prefix, address> of all tags of a text; the default one has an empty prefix, of a prefix given twice the last holds."""
    tags = F.array_join(F.transform(F.filter(tokens(c), lambda t: t["kind"].isin("open", "selfclose")), lambda t: t["raw"]), " ")
    given = r"""(?<=\s)xmlns(?::([^\s=]+))?\s*=\s*(?:"([^"]*)"|'([^']*)')"""

    def found(own: Column) -> Column:
        part = lambda g: F.regexp_extract_all(own, F.lit(given), F.lit(g))
        each = F.zip_with(part(1), F.zip_with(part(2), part(3), lambda x, y: F.concat(x, y)), lambda k, v: F.struct(k.alias("key"), v.alias("value")))
        return F.aggregate(each, F.array().cast("array<struct<key: string, value: string>>"), lambda a, x: F.array_append(F.filter(a, lambda y: y["key"] != x["key"]), x))

    return F.map_from_entries(bound(tags, found))
