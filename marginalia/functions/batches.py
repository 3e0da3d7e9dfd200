"""How much of a table a Python worker holds at a time."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows of one Arrow batch: whole texts or files, some of which are long.
ROWS = 500


def small(spark: SparkSession) -> None:
    """Bound the memory of Python workers on tables of texts and files; a smaller bound that is set stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > ROWS:
        spark.conf.set(name, str(ROWS))
