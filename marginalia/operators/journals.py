"""Journal requirements (JOIN-20, FLT-11, SRC-21, SET-06)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import sections

IMRAD = ["Abstract", "Introduction", "Methods", "Results", "Discussion"]
#: Id, name, words, abstract words, references, DOI wanted, figures, sections.
PROFILES = (
    ("nature", "Nature", 3000, 150, 50, True, 6, ["Abstract", "Introduction", "Results", "Discussion", "Methods"]),
    ("science", "Science", 2500, 125, 40, True, 4, ["Abstract", "Introduction", "Results", "Discussion"]),
    ("plos-one", "PLOS ONE", None, 300, None, False, None, IMRAD),
    ("pnas", "PNAS", 4500, 250, 50, True, 6, ["Abstract", "Introduction", "Results", "Discussion"]),
    ("ecology-letters", "Ecology Letters", 5000, 150, 50, True, 6, IMRAD),
    ("ecological-applications", "Ecological Applications", 7000, 350, None, True, None, IMRAD),
    ("molecular-ecology", "Molecular Ecology", 8000, 250, None, True, 8, IMRAD),
    ("elife", "eLife", None, 150, None, True, None, ["Abstract", "Introduction", "Results", "Discussion", "Methods"]),
    ("cell", "Cell", 7000, 150, 100, True, 7, ["Abstract", "Introduction", "Results", "Discussion"]),
    ("current-biology", "Current Biology", 5000, 150, 60, True, 4, ["Summary", "Results", "Discussion"]),
    ("conservation-biology", "Conservation Biology", 7000, 300, None, True, 6, IMRAD),
    ("biological-conservation", "Biological Conservation", 8000, 400, None, True, None, IMRAD),
    ("journal-of-ecology", "Journal of Ecology", 7000, 350, None, True, None, IMRAD),
    ("functional-ecology", "Functional Ecology", 7000, 350, None, True, None, IMRAD),
    ("global-change-biology", "Global Change Biology", 7000, 300, None, True, 8, IMRAD),
    ("oikos", "Oikos", 8000, 350, None, True, None, IMRAD),
    ("oecologia", "Oecologia", 8000, 250, None, True, None, IMRAD),
    ("biological-invasions", "Biological Invasions", None, 250, None, True, None, IMRAD),
    ("diversity-distributions", "Diversity and Distributions", 6000, 300, None, True, 6, IMRAD),
    ("neobiota", "NeoBiota", None, 350, None, True, None, IMRAD),
    ("peerj", "PeerJ", None, 500, None, False, None, IMRAD),
    ("methods-ecology-evolution", "Methods in Ecology and Evolution", 7000, 350, None, True, None, IMRAD),
)
SCHEMA = "id string, name string, main_max int, abstract_max int, ref_max int, doi_required boolean, fig_max int, sections array<string>"


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PROFILES), SCHEMA)


def journal_id(c: Column | str) -> Column:
    return X.chain(F.lower(X.col(c)), (r"\s+", "-"))


def overlaid(*layers: DataFrame, key: str = "id") -> DataFrame:
    """SET-06, SRC-21: rows by key, later layers over earlier ones."""
    rows = None
    for k, layer in enumerate(layers):
        own = layer.withColumn("_layer", F.lit(k))
        rows = own if rows is None else rows.unionByName(own)
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_layer")))
    return rows.withColumn("_r", last).filter("_r = 1").drop("_r", "_layer")


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """EXT-21: figures of a manuscript: words, abstract words, title, figures, tables, references, headings."""
    abstract = sections.abstract("text")
    headings = F.transform(F.regexp_extract_all("text", F.lit(r"(?m)^#+\s+(.+)$"), F.lit(1)), lambda h: F.lower(X.strip(h)))
    keys = F.array_distinct(F.regexp_extract_all("text", F.lit(r"@([A-Za-z0-9_]+)"), F.lit(1)))
    return docs.select(
        *keep,
        X.count_words("text").alias("words"),
        F.when(abstract.isNull(), 0).otherwise(X.count_words(abstract)).alias("abstract_words"),
        F.coalesce(F.length(sections.title("text")), F.lit(0)).alias("title_chars"),
        F.regexp_count("text", F.lit(r"!\[.*?\]\(.*?\)(\{#fig:[^}]+\})?")).alias("figures"),
        F.ceil(F.regexp_count("text", F.lit(r"(?m)^\|[^|]+\|")) / 5).cast("int").alias("tables"),
        F.size(keys).alias("refs"),
        headings.alias("headings"),
    )


def validated(docs: DataFrame, wanted: DataFrame, *keep: str) -> DataFrame:
    """JOIN-20, FLT-11: every manuscript against every profile: numbers of errors and missing sections.

    The profiles are a stated set of questions to each manuscript; they are
    sent to all tasks as long as they are few.
    """
    m = measured(docs, *keep).crossJoin(F.broadcast(wanted) if wanted.count() <= 1000 else wanted)

    def over(n: str, most: str) -> Column:
        return F.coalesce(F.col(n) > F.col(most), F.lit(False)).cast("int")

    missing = F.filter("sections", lambda s: ~F.exists("headings", lambda h: F.contains(h, F.lower(s))))
    errors = over("words", "main_max") + over("abstract_words", "abstract_max") + over("refs", "ref_max") + over("figures", "fig_max")
    return m.select(*keep, F.col("id").alias("journal"), "words", "refs", "figures", errors.alias("errors"), missing.alias("missing_sections"), (errors == 0).alias("valid"))
