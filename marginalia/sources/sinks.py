"""Sinks (SNK-01..04, 08)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def comments_csv(found: DataFrame, path: str) -> None:
    """SNK-01: quotes inside of fields are doubled."""
    status = F.when(F.col("resolved"), "resolved").otherwise("pending")
    out = found.select("number", "author", F.col("content").alias("comment"), F.col("before").alias("context"), status.alias("status"), "file", "line")
    out.write.mode("overwrite").option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def json_lines(df: DataFrame, path: str) -> None:
    """SNK-02, SNK-04."""
    df.write.mode("overwrite").json(path)


def save_conflicts(found: DataFrame, path: str) -> None:
    """SNK-03."""
    found.withColumn("resolved", F.lit(None).cast("string")).write.mode("overwrite").parquet(path)


def unresolved(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).filter("resolved IS NULL")


def reports(df: DataFrame, path: str, key: str, text: str = "text") -> None:
    """SNK-08: one text file per partition of the key."""
    df.select(key, text).write.mode("overwrite").partitionBy(key).text(path)
