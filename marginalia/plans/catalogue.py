"""Registry of the named queries and their SQL.

A query is a function of (spark, sf_dir); its SQL is what DuckDB runs on the
same tables.  Queries are listed by family in the modules beside this one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import documents, figure_queries, markup_queries, registry_queries, relations, streams, versions, word_queries

FAMILIES = (markup_queries, documents, relations, registry_queries, figure_queries, versions, word_queries, streams)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for family in FAMILIES for k, v in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for family in FAMILIES for k, v in family.SQL.items()}
