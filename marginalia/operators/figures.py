"""Figures: registries, LaTeX blocks, matching, previews, conversion of written references (EXT-23/25/30, JOIN-08/16, SCL-34/47)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import markdown, markup, protect
from ..functions.text import chain, strip
from . import crossref

IMAGE = r"!\[([^\]]*)\]\(([^)]+)\)(?:\{#(fig|tbl):([a-zA-Z0-9_-]+)[^}]*\})?"
LATEX = r"(?s)\\begin\{figure\*?\}.*?\\end\{figure\*?\}"
#: What an agreement of two images is worth, and what it takes to match them.
BY_LABEL, BY_NUMBER, BY_CAPTION, BY_PART, BY_FILE, ENOUGH = 100, 90, 80, 40, 30, 40
#: Code points of the pieces that texts are cut into where many places of one text are looked at.
PIECE = 256


def images(docs: DataFrame, *keep: str) -> DataFrame:
    """EXT-23: images of markdown texts in order, with the key that captions are compared by."""
    rows = docs.select(*keep, F.posexplode(markup.matches("text", IMAGE, 4)).alias("ord", "i"))
    kind, label = F.nullif("i.g3", F.lit("")), F.nullif("i.g4", F.lit(""))
    return rows.select(*keep, "ord", F.col("i.g1").alias("caption"), F.col("i.g2").alias("path"), label.alias("label"), F.coalesce(kind, F.lit("fig")).alias("type"), strip(F.lower(F.left("i.g1", F.lit(50)))).alias("caption_key"))


def numbered(found: DataFrame, labels: DataFrame, *key: str) -> DataFrame:
    """EXT-23: images with their display numbers."""
    n = F.concat(F.when(F.col("is_supp"), "S").otherwise(""), F.col("num").cast("string"))
    return found.join(labels.select(*key, F.col("kind").alias("type"), "label", n.alias("number")), [*key, "type", "label"], "left")


def latex_figures(docs: DataFrame, *keep: str) -> DataFrame:
    """EXT-25: figure blocks in LaTeX, and whether they have more than one plain image."""
    rows = docs.select(*keep, "text", F.explode(markup.matches("text", LATEX, 0)).alias("f")).filter(F.contains("f.match", F.lit("\\includegraphics")))
    before = F.substr("text", F.lit(1), F.col("f.pos"))
    block = F.col("f.match")
    exotic = block.rlike(r"\\subfloat\b") | block.rlike(r"\\rotatebox\b") | (F.regexp_count(block, F.lit(r"\\includegraphics\b")) != 1)
    return rows.select(*keep, (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).alias("line"), block.alias("block"), exotic.alias("exotic"))


#: Fixed value: an image command with its options and its path.
GRAPHICS = r"\\includegraphics\s*(?:\[([^\]]*)\])?\s*\{([^}]+)\}"


def translated(text: Column | str) -> Column:
    """SCL-39: figure blocks in LaTeX with one plain image as markdown images with caption, label and width; others stay."""

    def one(block: Column) -> Column:
        options, path = (F.regexp_extract(block, GRAPHICS, g) for g in (1, 2))
        asked = F.nullif(F.regexp_extract(options, r"(?:^|,)\s*width\s*=\s*([^,]+)", 1), F.lit(""))
        width = markdown.latex_width(asked)
        plain = ~block.rlike(r"\\(subfloat|rotatebox)\b") & (F.regexp_count(block, F.lit(r"\\includegraphics\b")) == 1) & block.rlike(GRAPHICS) & (asked.isNull() | width.isNotNull())
        caption = strip(F.coalesce(markdown.braced(block, "\\caption"), F.lit("")))
        label = strip(markdown.braced(block, "\\label"))
        name = F.when(label != "", F.concat(F.lit("#"), F.when(label.rlike(r"(?i)^[a-z]+:"), label).otherwise(F.concat(F.lit("fig:"), label))))
        marks = F.concat_ws(" ", name, F.concat(F.lit("width="), width))
        image = F.concat(F.lit("!["), caption, F.lit("]("), strip(path), F.lit(")"), F.when(marks != "", F.concat(F.lit(" {"), marks, F.lit("}"))).otherwise(""))
        return F.when(plain, image).otherwise(block)

    return protect.replaced_by(text, LATEX, one)


def matched(original: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """JOIN-16: found images with the original each stands for, each original once.

    Scores are made by joins on what can agree (label, caption, file name);
    the choice, in the order of the found images, is one document's.
    """
    name = chain(F.lower(F.element_at(F.split("path", "/"), -1)))
    bare = strip(F.lower(chain("caption", (r"(?i)^(?:Figure|Fig\.?|Table|Tbl\.?)\s+\d+[:.]?\s*", ""))))
    a = original.select(key, F.col("ord").alias("o"), F.col("label").alias("a_label"), F.left(F.lower("caption"), F.lit(50)).alias("a_cap"), name.alias("a_file"))
    b = found.select(key, F.col("ord").alias("f"), F.col("label").alias("b_label"), F.left(bare, F.lit(50)).alias("b_cap"), name.alias("b_file"))
    pairs = a.join(b, key)
    same = (F.col("a_cap") != "") & (F.col("a_cap") == F.col("b_cap"))
    part = (F.col("a_cap") != "") & (F.col("b_cap") != "") & (F.contains("b_cap", F.left("a_cap", F.lit(30))) | F.contains("a_cap", F.left("b_cap", F.lit(30))))

    def points(c, n):
        return F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)

    score = points(F.col("a_label") == F.col("b_label"), BY_LABEL) + F.when(same, BY_CAPTION).otherwise(points(part, BY_PART)) + points(F.col("a_file") == F.col("b_file"), BY_FILE)
    scored = pairs.select(key, "f", "o", score.alias("score")).filter(F.col("score") >= ENOUGH)

    schema = T.StructType([scored.schema[key], *T.StructType.fromDDL("f int, o int, score int").fields])
    arrow = to_arrow_schema(schema)

    def choose(batches):
        last, used, done = None, None, None
        for batch in batches:
            rows = []
            for k, f, o, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if used is None or k != last:
                    last, used, done = k, set(), None
                if f != done and o not in used:
                    used.add(o)
                    done = f
                    rows.append((k, f, o, s))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)

    n = int(original.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = scored.select(key, *[F.col(c).cast("int").alias(c) for c in ("f", "o", "score")])
    return rows.repartition(n, key).sortWithinPartitions(key, "f", F.desc("score"), "o").mapInArrow(choose, schema)


def previews(docs: DataFrame, *keep: str, most: int = 10, context: int = 40) -> DataFrame:
    """EXT-30: the first changes of each text with what stands around them; marks may not hold their own sign."""
    kinds = {"insert": r"\{\+\+([^+]*)\+\+\}", "delete": r"\{--([^-]*)--\}", "substitute": r"\{~~([^~]*)~>([^~]*)~~\}"}
    rows = None
    for kind, p in kinds.items():
        own = docs.select(*keep, "text", F.explode(markup.matches("text", p, 2 if kind == "substitute" else 1)).alias("m"))
        own = own.select(*keep, "text", F.lit(kind).alias("kind"), F.col("m.pos").alias("pos"), F.col("m.match").alias("match"))
        rows = own if rows is None else rows.unionByName(own)
    n = F.row_number().over(Window.partitionBy(*keep).orderBy("pos"))
    start = F.greatest(F.col("pos") - context, F.lit(0))
    around = F.concat(F.substr("text", start + 1, F.col("pos") - start), "match", F.substr("text", F.col("pos") + F.length("match") + 1, F.lit(context)))
    return rows.withColumn("n", n).filter(F.col("n") <= most).select(*keep, "n", "kind", "pos", F.replace(around, F.lit("\n"), F.lit(" ")).alias("preview"))


def labelled(docs: DataFrame, labels: DataFrame, key: str, *project: str) -> DataFrame:
    """SCL-47: written references with the labels they become; null where a number is unknown or the label already stands near.

    All numbers of a reference must be known.
    """
    refs = crossref.written_references(docs, key, *project)
    before = docs.select(key, "text")
    n = refs.select(key, *project, "kind", "match", "pos", F.posexplode(crossref.numbers("list")).alias("k", "n")).select(key, *project, "kind", "match", "pos", "k", "n.num", "n.is_supp")
    known = labels.select(*project, "kind", "num", "is_supp", "label")
    joined = n.join(known, [*project, "kind", "num", "is_supp"], "left")
    all_of = joined.groupBy(key, "kind", "match", "pos").agg(F.array_sort(F.collect_list(F.struct("k", F.concat(F.lit("@"), "kind", F.lit(":"), "label").alias("l")))).alias("l"), F.count_if(F.col("label").isNull()).alias("unknown"))
    near = F.substr("text", F.greatest(F.col("pos") - 100, F.lit(0)) + 1, F.least("pos", F.lit(100)))
    there = F.exists("l", lambda x: F.contains(F.col("near"), x["l"]))
    rows = all_of.join(before, key).withColumn("near", near)
    return rows.select(key, "kind", "match", "pos", F.when((F.col("unknown") == 0) & ~there, F.array_join(F.transform("l", lambda x: x["l"]), "; ")).alias("replacement"))


def loose_citations(docs: DataFrame, *keep: str) -> DataFrame:
    """JOIN-08: keys by the looser grammar of the project check."""
    keys = F.regexp_extract_all("text", F.lit(r"@([a-zA-Z][a-zA-Z0-9_-]*)(?![:A-Za-z0-9_])"), F.lit(1))
    return docs.select(*keep, F.explode(keys).alias("key")).filter(~F.col("key").isin("fig", "tbl", "eq"))


def conflict_text(found: DataFrame, texts: DataFrame, key: str, around: int = 50, most: int = 60) -> DataFrame:
    """SCL-34: conflicts written out for a person to choose.

    Texts are cut into pieces once, and a conflict reads those that it touches,
    so that its cost does not go by the length of its text.
    """
    t = F.concat(F.when(F.length("x") > most, F.concat(F.left("x", F.lit(most)), F.lit("..."))).otherwise(F.col("x")))
    own = found.filter("conflict IS NOT NULL").withColumn("x", F.when(F.col("type") == "delete", F.col("old_text")).otherwise(F.col("new_text")))
    what = F.when(F.col("type") == "insert", "Insert: ").when(F.col("type") == "delete", "Delete: ").otherwise("Replace → ")
    option = F.concat(F.lit("    "), (F.col("place") + 1).cast("string"), F.lit(". ["), "reviewer", F.lit("] "), what, F.lit('"'), t, F.lit('"'))
    each = own.withColumn("option", option).groupBy(key, "conflict").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_list(F.struct("place", "option"))).alias("o"))
    cut = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    rows = each.join(texts.select(key, cut.alias("pieces")), key)
    # places before the text count from its end, as in SQL: those, and what has no place, see the whole text
    within = (F.col("start") >= 0) & (F.col("end") >= 0)
    low = F.greatest(F.least(F.col("start") - around, F.col("end")), F.lit(0))
    first, last = (F.floor(n.cast("long") / PIECE).cast("int") for n in (low, F.greatest("start", "end").cast("long") + around))
    rows = rows.withColumn("near", F.when(within, F.array_join(F.slice("pieces", first + 1, last - first + 1), "")).otherwise(F.array_join("pieces", "")))
    rows = rows.withColumn("off", F.when(within, first * PIECE).otherwise(0))
    rows = rows.withColumn("before", strip(F.substr("near", F.greatest(F.col("start") - around, F.lit(0)) - F.col("off") + 1, F.least("start", F.lit(around)))))
    rows = rows.withColumn("original", F.substr("near", F.col("start") - F.col("off") + 1, F.col("end") - F.col("start")))
    rows = rows.withColumn("after", strip(F.substr("near", F.col("end") - F.col("off") + 1, F.lit(around))))
    before, original, after = F.col("before"), F.col("original"), F.col("after")
    parts = [F.when(before != "", F.concat(F.lit("  ..."), before)), F.concat(F.lit('  [ORIGINAL]: "'), F.when(original == "", "(insertion point)").otherwise(original), F.lit('"')), F.when(after != "", F.concat(F.lit("  "), after, F.lit("...")))]
    return rows.select(key, "conflict", F.concat_ws("\n", *parts, F.lit(""), F.lit("  Options:"), F.array_join(F.transform("o", lambda x: x["option"]), "\n")).alias("shown"))


def conflict_markers(found: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """SCL-34: each conflict's part of the text becomes its changes between markers, from the end of the text backwards; texts without conflicts stay."""
    own = found.filter("conflict IS NOT NULL")
    said = F.when(F.col("type") == "delete", F.concat(F.lit('[DELETED: "'), "old_text", F.lit('"]'))).otherwise(F.col("new_text"))
    option = F.concat(F.lit("======= "), "reviewer", F.lit("\n"), said)
    each = own.withColumn("option", option).groupBy(key, "conflict").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_list(F.struct("place", "option"))).alias("o"))
    marks = F.concat(F.lit("<<<<<<< CONFLICT "), "conflict", F.lit("\n"), F.array_join(F.transform("o", lambda x: x["option"]), "\n"), F.lit("\n>>>>>>> END "), "conflict")
    ord_ = F.regexp_extract("conflict", r"\d+", 0).cast("int")
    # the last first; of those that begin in one place the first first
    row = F.struct((-F.col("start")).alias("back"), ord_.alias("ord"), "start", "end", marks.alias("marks"))
    of_text = each.groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_list(row)).alias("_c"))
    put = lambda t, c: F.concat(F.substr(t, F.lit(1), c["start"]), c["marks"], F.substr(t, c["end"] + 1))
    rows = texts.join(of_text, F.col(key).eqNullSafe(F.col("_key")), "left")
    return rows.select(key, F.when(F.col("_c").isNull(), F.col("text")).otherwise(F.aggregate("_c", F.col("text"), put)).alias("text"))
