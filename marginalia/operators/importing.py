"""Reviewed Word files taken back into Markdown (DIF-12, SCL-46): one job over a table of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markdown, markup, protect
from ..functions.text import LEFT, RIGHT, col
from . import diffs, paragraphs

#: References and captions as a word processor shows them.
_KIND = r"Figure|Fig\.?|Table|Tbl\.?"
MARKED = r"(?i)\[(Figure|Table|Fig\.?)\]\{\.mark\}\s*\[(\d+|S\d+)\]\{\.mark\}"
PLAIN = rf"(?i)(?=[ft])(?<!!){LEFT}({_KIND})\s+(\d+|S\d+){RIGHT}(?!\s*:)"
CAPTION_AGAIN = rf"(?i)(!\[[^\]]+\]\([^)]+\)(?:\{{[^}}]*\}})?)\s*\n+\s*(?:{_KIND})\s+\d+[:.]?\s*[^\n]+"
PICTURE = rf"(?i)!\[({_KIND})\s+(\d+|S\d+)[:.]?\s*([^\]]*)\]\(([^)]+)\)(?:\{{[^}}]*\}})?"
REGISTRY = "map<string, struct<label: string, caption: string, path: string>>"


def _key(match: Column, pattern: str) -> Column:
    """fig:N or tbl:N of a match."""
    kind = F.when(F.lower(F.regexp_extract(match, pattern, 1)).startswith("tab"), "tbl").otherwise("fig")
    return F.concat(kind, F.lit(":"), F.regexp_extract(match, pattern, 2))


def references_restored(text: Column | str, registry: Column) -> Column:
    """SCL-46: numbered references become references by label, pictures get their captions, paths and labels back.

    registry: REGISTRY, by kind and number.  A marked reference without an
    entry gets a made-up label, a plain one stays.  Only the first picture of
    a label gets its anchor; captions repeated below pictures go.
    """

    def known(key: Column) -> Column:
        return F.try_element_at(registry, key)

    def label(key: Column) -> Column:
        return F.concat(F.lit("@"), F.left(key, F.lit(4)), known(key)["label"])

    def marked(m: Column) -> Column:
        key = _key(m, MARKED)
        return F.coalesce(label(key), F.concat(F.lit("@"), F.left(key, F.lit(4)), F.lit("fig"), F.substr(key, F.lit(5))))

    t = protect.replaced_by(text, MARKED, marked)
    t = protect.replaced_by(t, PLAIN, lambda m: F.coalesce(label(_key(m, PLAIN)), m))
    t = F.regexp_replace(t, CAPTION_AGAIN, "$1")

    def pictures(whole: Column) -> Column:
        keys = F.transform(F.regexp_extract_all(whole, F.lit(PICTURE), F.lit(0)), lambda m: _key(m, PICTURE))

        def put(all_keys: Column) -> Column:
            def one(m: Column, k: Column) -> Column:
                key = _key(m, PICTURE)
                e = known(key)
                anchor = F.when(F.array_position(all_keys, key) == k + 1, F.concat(F.lit("{#"), F.left(key, F.lit(4)), e["label"], F.lit("}"))).otherwise("")
                bare = F.concat(F.lit("!["), F.trim(F.regexp_extract(m, PICTURE, 3)), F.lit("]("), F.regexp_extract(m, PICTURE, 4), F.lit(")"))
                return F.coalesce(F.concat(F.lit("!["), e["caption"], F.lit("]("), e["path"], F.lit(")"), anchor), bare)

            return protect.replaced_by(whole, PICTURE, one)

        return protect.bound(keys, put)

    return protect.bound(t, pictures)


def registries(rows: DataFrame, *key: str) -> DataFrame:
    """Keys and REGISTRY of registry rows (key, kind, num, label, caption, path); of several with one number the least label counts."""
    one = rows.groupBy(*key, "kind", "num").agg(F.min(F.struct("label", "caption", "path")).alias("e"))
    entry = F.struct(F.concat(F.col("kind"), F.lit(":"), F.col("num").cast("string")), F.col("e"))
    return one.groupBy(*key).agg(F.map_from_entries(F.collect_list(entry)).alias("registry"))


def imported(files: DataFrame, originals: DataFrame | None = None, registry: DataFrame | None = None) -> DataFrame:
    """DIF-12: one row per Word file (path, content): path, text, way, counts, error.

    A file with tracked changes gives its own text with the changes and the
    comments set in (way `tracked`).  One without is compared with its
    original (path, text), whose annotations go first (way `compared`); flat
    tables, formulas and citations in it are recognized.  Without an original
    it is its plain text (way `plain`).  A file that can't be read is a row
    with an error.  registry: path, kind, num, label, caption, path of the
    picture as `picture`, for references by number.  Files without tracked
    changes keep their comments out, as those stand in no text.
    """
    from ..sources import docx
    from ..streaming.watch import shared_folder

    # read once for all that is made of it
    folder = shared_folder(files.sparkSession)
    parts = docx.parts(files)
    parts.write.parquet(f"{folder}/parts")
    found = files.sparkSession.read.schema(parts.schema).parquet(f"{folder}/parts")
    if registry is not None:
        owned = registries(registry.select(F.col("path").alias("_path"), "kind", "num", "label", "caption", F.col("picture").alias("path")), "_path")
        found = found.join(owned, F.col("path") == F.col("_path"), "left").drop("_path")
    else:
        found = found.withColumn("registry", F.lit(None).cast(REGISTRY))
    own = F.coalesce("registry", F.map_from_entries(F.array().cast("array<struct<k: string, v: struct<label: string, caption: string, path: string>>>")))
    failed = found.filter("error IS NOT NULL").select("path", F.lit(None).cast("string").alias("text"), F.lit("failed").alias("way"), "error")
    read = found.filter("error IS NULL")

    tracked = read.filter("changed").select("path", references_restored("tracked", own).alias("text"), "comments")
    set_in = diffs.placed_lists(tracked, "path", "comments").select("path", markdown.tidy("text").alias("text"), F.lit("tracked").alias("way"))

    flat = read.filter("NOT changed").select("path", "plain", "tables", own.alias("registry"))
    shown = references_restored(paragraphs.with_tables("plain", "tables"), F.col("registry")).alias("shown")
    if originals is not None:
        met = flat.join(originals.select(F.col("path").alias("_path"), markup.stripped("text").alias("original")), F.col("path") == F.col("_path"), "left")
        # texts meet their originals once; those without one go along and are compared with nothing
        met, one = met.select("path", "original", shown), F.col("original").isNotNull()
        met = met.select("path", F.when(~one, F.col("shown")).alias("alone"), "original", F.when(one, F.col("shown")).alias("shown"))
        against = paragraphs.smart(met, "path", "alone", old="original", new="shown", shown=True)
        compared = markup.visible_comments(protect.citations_kept(markdown.tidy("text")))
        rest = against.select("path", F.coalesce("alone", compared).alias("text"), F.when(F.col("alone").isNull(), "compared").otherwise("plain").alias("way"))
    else:
        rest = flat.select("path", shown.alias("text"), F.lit("plain").alias("way"))

    done = set_in.unionByName(rest).withColumn("error", F.lit(None).cast("string")).unionByName(failed)
    counts = [F.coalesce(F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0))), F.lit(0)).alias(n) for n, p in (("insertions", r"\{\+\+"), ("deletions", r"\{--"), ("substitutions", r"\{~~"), ("comments", r"\{>>"))]
    return done.select("path", "text", "way", *[F.when(F.col("error").isNull(), c).otherwise(0).alias(n) for c, n in zip(counts, ("insertions", "deletions", "substitutions", "comments"), strict=True)], "error")
