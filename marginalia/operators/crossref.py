"""Cross-references: registry, references, resolution (EXT-09..13, WIN-01, JOIN-04..09, SCL-47, FLT-05)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markup
from ..functions.text import LEFT, chain

#: The grammars of anchors, references and written-out references.
ANCHOR = r"(?i)\{#(fig|tbl|eq):([a-zA-Z0-9_-]+)"
REFERENCE = r"(?i)@(fig|tbl|eq):([a-zA-Z0-9_-]+)"
_LIST = r"((?:\d+|S\d+)[a-z]?(?:(?:\s*[-–—,&]\s*(?:and\s+)?|\s+and\s+)(?:(?:\d+|S\d+)[a-z]?|[a-z](?![A-Za-z0-9_])))*)"
WRITTEN = {
    "fig": r"(?i)" + LEFT + r"(Figures?|Figs?\.?)\s+" + _LIST,
    "tbl": r"(?i)" + LEFT + r"(Tables?|Tabs?\.?)\s+" + _LIST,
    "eq": r"(?i)" + LEFT + r"(Equations?|Eqs?\.?)\s+" + _LIST.replace(r"(?:\d+|S\d+)", r"(?:\d+)"),
}
NAMES = {"fig": "Figure", "tbl": "Table", "eq": "Equation"}


def anchors(docs: DataFrame, *keep: str) -> DataFrame:
    """One row per anchor: kept columns, kind, label, pos."""
    rows = docs.select(*keep, F.explode(markup.matches("text", ANCHOR, 2)).alias("a"))
    return rows.select(*keep, F.lower("a.g1").alias("kind"), F.col("a.g2").alias("label"), F.col("a.pos").alias("pos"))


def registry(docs: DataFrame, project: str, file: str, order: str) -> DataFrame:
    """EXT-12, WIN-01: numbers of all labels of a project; the last of equal labels holds.

    Supplementary files (supp or appendix in the name) number on their own,
    except for equations.
    """
    supp = F.lower(file).contains("supp") | F.lower(file).contains("appendix")
    found = anchors(docs, project, file, order).withColumn("is_supp", supp & (F.col("kind") != "eq"))
    n = F.row_number().over(Window.partitionBy(project, "kind", "is_supp").orderBy(order, "pos"))
    last = F.row_number().over(Window.partitionBy(project, "kind", "label").orderBy(F.desc(order), F.desc("pos")))
    numbered = found.withColumn("num", n).withColumn("_last", last)
    return numbered.filter("_last = 1").select(project, "kind", "label", "num", "is_supp", file)


def display(kind: Column | str, num: Column | str, is_supp: Column | str) -> Column:
    """SCL-33: Figure 2, Table S1."""
    k = F.col(kind) if isinstance(kind, str) else kind
    name = F.when(k == "fig", "Figure").when(k == "tbl", "Table").otherwise("Equation")
    return F.concat(name, F.lit(" "), F.when(F.col(is_supp), "S").otherwise(""), F.col(num).cast("string"))


def references(docs: DataFrame, *keep: str) -> DataFrame:
    """EXT-09: one row per reference by label."""
    rows = docs.select(*keep, F.explode(markup.matches("text", REFERENCE, 2)).alias("r"))
    return rows.select(*keep, F.lower("r.g1").alias("kind"), F.col("r.g2").alias("label"), F.col("r.match").alias("match"), F.col("r.pos").alias("pos"))


def written_references(docs: DataFrame, *keep: str) -> DataFrame:
    """EXT-10: one row per written-out reference, such as Figs. 1-3 and S2."""
    found = []
    for kind, pattern in WRITTEN.items():
        rows = docs.select(*keep, F.explode(markup.matches("text", pattern, 2)).alias("r"))
        found.append(rows.select(*keep, F.lit(kind).alias("kind"), F.col("r.match").alias("match"), F.col("r.g2").alias("list"), F.col("r.pos").alias("pos")))
    return reduce(DataFrame.unionByName, found)


def kind_of(written: Column | str) -> Column:
    w = F.lower(F.col(written) if isinstance(written, str) else written)
    return F.when(w.startswith("fig"), "fig").when(w.startswith("tab"), "tbl").when(w.startswith("eq"), "eq").otherwise(chain(w, (r"\.$", "")))


NUMBERS = "array<struct<num:int,is_supp:boolean,suffix:string>>"


def numbers(written: Column | str) -> Column:
    """EXT-11: the numbers of a written list, array<struct<num, is_supp, suffix>>.

    A fold over the parts carries the last full number, which letters on
    their own go with.
    """
    w = F.col(written) if isinstance(written, str) else written
    flat = chain(w, (r"(?i)\s+and\s+", ", "), (r"[–—]", "-"), (r"&", ", "))
    parts = F.filter(F.split(flat, r"\s*,\s*"), lambda p: F.trim(p) != "")

    def number(p: Column) -> Column:
        return F.coalesce(F.regexp_extract(p, r"(?i)^S?(\d+)", 1).try_cast("int"), F.lit(0))

    def letter(p: Column) -> Column:
        return F.nullif(F.lower(F.regexp_extract(p, r"(?i)^S?\d+([a-z])$", 1)), F.lit(""))

    def one(num: Column, supp: Column, suffix: Column) -> Column:
        return F.struct(num.cast("int").alias("num"), supp.alias("is_supp"), suffix.cast("string").alias("suffix"))

    def letters(num: Column, supp: Column, a: Column, b: Column) -> Column:
        codes = F.when(F.ascii(a) <= F.ascii(b), F.sequence(F.ascii(a), F.ascii(b))).otherwise(F.array().cast("array<int>"))
        return F.transform(codes, lambda k: one(num, supp, F.char(k)))

    def step(state: Column, part: Column) -> Column:
        p = F.trim(part)
        begin, end = F.trim(F.split(p, "-")[0]), F.trim(F.coalesce(F.get(F.split(p, "-"), F.lit(1)), F.lit("")))
        ranged, alone = F.contains(p, F.lit("-")), p.rlike("(?i)^[a-z]$")
        only_letter = end.rlike("(?i)^[a-z]$")
        n1, s1, supp1 = number(begin), letter(begin), F.upper(begin).startswith("S")
        n2 = F.when(only_letter, n1).otherwise(number(end))
        s2 = F.when(only_letter, F.lower(end)).otherwise(letter(end))
        many = F.when(n1 <= n2, F.sequence(n1, n2)).otherwise(F.array().cast("array<int>"))
        most = F.when(F.coalesce(s1, F.lit("a")) > F.coalesce(s2, F.lit("a")), s1).otherwise(s2)
        across = F.flatten(F.transform(many, lambda n: letters(n, supp1, F.when(n == n1, s1).otherwise(F.lit("a")), F.when(n == n2, s2).otherwise(most))))
        own = F.when(n1 != 0, n1).otherwise(F.coalesce(state["num"], F.lit(1)))
        own_supp = supp1 | F.coalesce(state["is_supp"], F.lit(False))
        within = letters(own, own_supp, F.coalesce(s1, F.lit("a")), F.coalesce(s2, F.lit("a")))
        plain = F.transform(many, lambda n: one(n, supp1, F.lit(None)))
        implied = alone & state["num"].isNotNull()
        both = s1.isNotNull() & s2.isNotNull() & (n1 != n2)
        some = s1.isNotNull() | s2.isNotNull()
        new = F.when(ranged & both, across).when(ranged & some, within).when(ranged, plain).when(implied, F.array(one(state["num"], state["is_supp"], F.lower(p)))).otherwise(F.array(one(number(p), F.upper(p).startswith("S"), letter(p))))
        num = F.when(ranged & ~both & some, own).when(ranged, n2).when(implied, state["num"]).otherwise(number(p))
        supp = F.when(ranged & ~both & some, own_supp).when(ranged, supp1).when(implied, state["is_supp"]).otherwise(F.upper(p).startswith("S"))
        return F.struct(F.concat(state["out"], new.cast(NUMBERS)).alias("out"), num.cast("int").alias("num"), supp.alias("is_supp"))

    start = F.struct(F.array().cast(NUMBERS).alias("out"), F.lit(None).cast("int").alias("num"), F.lit(None).cast("boolean").alias("is_supp"))
    return F.aggregate(parts, start, step)["out"]


def forward(docs: DataFrame, *keep: str) -> DataFrame:
    """FLT-05: references before their anchor, or without one in the text."""
    first = anchors(docs, *keep).groupBy(*keep, "kind", "label").agg(F.min("pos").alias("anchor_pos"))
    joined = references(docs, *keep).join(first, [*keep, "kind", "label"], "left")
    return joined.filter(F.col("anchor_pos").isNull() | (F.col("pos") < F.col("anchor_pos")))


def resolved(docs: DataFrame, labels: DataFrame, *keep: str) -> DataFrame:
    """JOIN-04: references with their display text; null where the label is unknown."""
    known = labels.select("kind", "label", display("kind", "num", "is_supp").alias("display"))
    return references(docs, *keep).join(known, ["kind", "label"], "left")


def spliced(docs: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """SCL-47: texts with known references replaced by what they display.

    A text's pieces between the references and the references themselves get
    places, are joined with the labels, and are put together again.
    """
    between = docs.select(key, F.posexplode(F.split("text", REFERENCE, -1)).alias("k", "t")).select(key, (F.col("k") * 2).alias("k"), "t")
    known = labels.select("kind", "label", display("kind", "num", "is_supp").alias("display"))
    refs = docs.select(key, F.posexplode(markup.all_of("text", REFERENCE)).alias("k", "t"))
    refs = refs.withColumn("kind", F.lower(F.regexp_extract("t", REFERENCE, 1))).withColumn("label", F.regexp_extract("t", REFERENCE, 2))
    refs = refs.join(known, ["kind", "label"], "left").select(key, (F.col("k") * 2 + 1).alias("k"), F.coalesce("display", "t").alias("t"))
    pieces = between.unionByName(refs).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("k", "t"))).alias("p"))
    return pieces.select(key, F.array_join(F.transform("p", lambda x: x["t"]), "").alias("text"))


def status(docs: DataFrame, *keep: str) -> DataFrame:
    """EXT-13: numbers of references and anchors of each text; anchors count in lower case only."""
    n = {k: F.regexp_count("text", F.lit(r"\{#" + k + ":[a-zA-Z0-9_-]+")) for k in NAMES}
    written = sum((F.size(markup.all_of("text", p)) for p in WRITTEN.values()), F.lit(0))
    return docs.select(*keep, F.size(markup.all_of("text", REFERENCE)).alias("dynamic"), written.alias("written"), *[n[k].alias(f"{k}_anchors") for k in NAMES])
