"""The scalar and table functions under SQL names (2.14)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

#: SQL functions by expression: these stay in the JVM and are inlined into the plan.
FUNCTIONS = {
    "plain_word_count(t STRING) RETURNS INT": r"size(filter(split(t, '\\s+'), w -> w <> ''))",
    "strip_text(t STRING) RETURNS STRING": r"regexp_replace(t, '^\\s+|\\s+$', '')",
    "accept_all(t STRING) RETURNS STRING": r"regexp_replace(regexp_replace(regexp_replace(t, '(?s)\\{~~(.+?)~>(.+?)~~\\}', '$2'), '(?s)\\{\\+\\+(.+?)\\+\\+\\}', '$1'), '(?s)\\{--(.+?)--\\}', '')",
    "reject_all(t STRING) RETURNS STRING": r"regexp_replace(regexp_replace(regexp_replace(t, '(?s)\\{~~(.+?)~>(.+?)~~\\}', '$1'), '(?s)\\{\\+\\+(.+?)\\+\\+\\}', ''), '(?s)\\{--(.+?)--\\}', '$1')",
    "is_doi(t STRING) RETURNS BOOLEAN": r"coalesce(t rlike '^10\\.\\d{4,}/\\S+$', false)",
    "escape_xml(t STRING) RETURNS STRING": "replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '\\'', '&apos;')",
}


@udtf(returnType="kind string, pos int, content string, replacement string")
class Annotations:
    """EXT-01 as a table function: annotations(text)."""

    def eval(self, text: str):
        import re

        patterns = (("insert", r"\{\+\+(.+?)\+\+\}"), ("delete", r"\{--(.+?)--\}"), ("substitute", r"\{~~(.+?)~>(.+?)~~\}"), ("comment", r"\{>>(.+?)<<\}"))
        found = [(m.start(), k, kind, m) for k, (kind, p) in enumerate(patterns) for m in re.finditer(p, text or "", re.S)]
        for at, _, kind, m in sorted(found, key=lambda f: f[:2]):
            yield kind, at, m[1], m[2] if kind == "substitute" else None


@udtf(returnType="type string, start int, `end` int, old_text string, new_text string")
class Changes:
    """DIF-04 as a table function: text_changes(old, new)."""

    def eval(self, old: str, new: str):
        from marginalia.functions.diff import changes

        for c in changes(old or "", new or ""):
            yield c["type"], c["start"], c["end"], c["old_text"], c["new_text"]


def register(spark: SparkSession) -> None:
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("annotations", Annotations)
    spark.udtf.register("text_changes", Changes)
