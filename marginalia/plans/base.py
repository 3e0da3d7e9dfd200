"""How the families of queries register themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import corpora


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Family:
    """Decorator of queries over a corpus or a table, with their SQL."""

    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def over(self, name: str | None, sql: str | None = None):
        """The query gets the corpus or table of that name; SQL sees it as c."""

        def register(f):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                if name is None:
                    return f(spark, sf_dir)
                return f(corpora.for_spark(spark, sf_dir, name) if name in corpora.CORPORA else table(spark, sf_dir, name))

            self.queries[f.__name__] = run
            if sql is not None:
                self.sql[f.__name__] = sql if name is None else with_corpus(name, sql)
            return f

        return register


def with_corpus(name: str, sql: str) -> str:
    source = corpora.for_duckdb(name) if name in corpora.CORPORA else f"SELECT * FROM {name}"
    return f"WITH c AS ({source}){',' if sql.lstrip().startswith('+') else ''} {sql.lstrip().lstrip('+')}"


#: DuckDB: the lines of c's texts, numbered; keys are given by the query.
def duck_lines(keys: str) -> str:
    return f"SELECT {keys}, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, unnest(string_split(text, chr(10))) AS line_text FROM c"


def duck_matches(keys: str, pattern: str, source: str = "c", groups: int = 1) -> str:
    """DuckDB: matches of a pattern with their offsets."""
    got = ", ".join(f"unnest(regexp_extract_all(text, {quote(pattern)}, {g})) AS g{g}" for g in range(1, groups + 1))
    a, b = f"regexp_extract_all(text, {quote(pattern)})", f"string_split_regex(text, {quote(pattern)})"
    return f"""SELECT {keys}, text, match, {', '.join(f'g{g}' for g in range(1, groups + 1))}, length(array_to_string(b[1:k], '')) + length(array_to_string(a[1:k - 1], '')) AS pos
        FROM (SELECT {keys}, text, {a} AS a, {b} AS b, unnest(range(1, len({a}) + 1)) AS k, unnest({a}) AS match, {got} FROM {source})"""


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"
