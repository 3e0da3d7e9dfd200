"""Text corpora, dictionaries, registries and lookups from files (SRC-01..03, 18..24)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip

#: Files of a project that are no sections.
NO_SECTIONS = ("paper.md", "readme.md", "claude.md")


def whole_files(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """SRC-01, SRC-03: path, file and text of the files of a folder; names with a dot in front are left out."""
    rows = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
    return rows.filter(~F.col("file").startswith("."))


def sections(texts: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """SRC-01/02: sections with their order: as configured, else all but the known other files by name."""
    if order is not None:
        return texts.join(order.select("file", "ord"), "file")
    own = texts.filter(~F.lower("file").isin(*NO_SECTIONS))
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return own.withColumn("ord", F.row_number().over(Window.partitionBy(folder).orderBy("file")))


def dictionary(spark: SparkSession, *paths: str) -> DataFrame:
    """SRC-22, SET-02: distinct words of dictionary files; # starts a remark."""
    rows = spark.read.text(list(paths)).select(F.lower(strip("value")).alias("word"))
    return rows.filter((F.col("word") != "") & ~F.col("word").startswith("#")).distinct()


IMAGES = "array<struct<caption:string,path:string,label:string,type:string,number:string>>"


def image_registry(texts: DataFrame) -> DataFrame:
    """SRC-23, EXT-23: entries of image registries in JSON; broken ones give none."""
    rows = texts.select("path", F.from_json("text", f"struct<figures:{IMAGES}>").alias("j"))
    found = rows.select("path", F.explode("j.figures").alias("i")).select("path", F.col("i.caption").alias("caption"), F.col("i.path").alias("image"), F.col("i.label").alias("label"), F.col("i.number").alias("number"))
    return found.withColumn("caption_key", F.left(F.lower(strip("caption")), F.lit(50)))


CSL = "struct<title:string,`container-title`:string,DOI:string,author:array<struct<family:string,given:string>>,issued:struct<`date-parts`:array<array<int>>>,`published-print`:struct<`date-parts`:array<array<int>>>>"


def csl_metadata(rows: DataFrame, *keep: str, column: str = "json") -> DataFrame:
    """SRC-24, SCL-43: what a reference lookup's answer in JSON says."""
    j = rows.select(*keep, F.from_json(column, CSL).alias("j"))
    year = F.coalesce(F.get(F.get(F.col("j.issued.date-parts"), F.lit(0)), F.lit(0)), F.get(F.get(F.col("j.published-print.date-parts"), F.lit(0)), F.lit(0)))
    names = F.transform("j.author", lambda a: strip(F.concat_ws(" ", a["given"], a["family"])))
    return j.select(*keep, F.col("j.title").alias("title"), F.col("j.container-title").alias("journal"), F.col("j.DOI").alias("doi"), year.alias("year"), names.alias("authors"))
