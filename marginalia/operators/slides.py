"""Slides and bullet trees of markdown texts (EXT-26/27)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import batches

SLIDES = "array<struct<title:string,level:int,steps:array<string>,notes:string,classes:array<string>,reveals:array<struct<item:int,sub:int>>>>"
BLOCK = re.compile(r"^:::+\s*\{?\.?(step|notes)\b[^\n]*\n(.*?)^:::+\s*$", re.S | re.M)
HEAD = re.compile(r"^(#{1,6})\s+(.*?)(?:\s*\{([^}]*)\})?\s*$", re.M)
BULLET = re.compile(r"^(\s*)[-*]\s+(.+)$")


def bullets(text: str) -> list[tuple[int, str]]:
    """(depth, text) of a text's bullets; depth by indentation against the bullets above."""
    above: list[int] = []
    out = []
    for line in text.split("\n"):
        if m := BULLET.match(line):
            indent = len(m[1])
            above = [i for i in above if i < indent]
            out.append((len(above), m[2].strip()))
            above.append(indent)
    return out


def reveals(items: list[tuple[int, str]]) -> list[dict]:
    """The steps in which a list builds up: each item, and each of its children after it."""
    out, item, child = [], -1, 0
    depths = [d for d, _ in items]
    for k, d in enumerate(depths):
        if d == 0:
            item, child = item + 1, 0
            has_children = k + 1 < len(depths) and depths[k + 1] > 0
            out.append({"item": item, "sub": -1 if has_children else None})
        elif d == 1:
            out.append({"item": item, "sub": child})
            child += 1
    return out


def slide(text: str) -> dict:
    head = HEAD.search(text)
    blocks = BLOCK.findall(text)
    rest = BLOCK.sub("", text)
    return {
        "title": head[2].strip() if head else None,
        "level": len(head[1]) if head else None,
        "steps": [b.strip() for kind, b in blocks if kind == "step"],
        "notes": "\n".join(b.strip() for kind, b in blocks if kind == "notes") or None,
        "classes": re.findall(r"\.([\w-]+)", head[3]) if head and head[3] else [],
        "reveals": reveals(bullets(rest)),
    }


def slides_of(text: str) -> list[dict]:
    body = re.sub(r"\A---\n.*?\n---(?:\n|\Z)", "", text.replace("\r\n", "\n"), flags=re.S)
    return [slide(p.strip()) for p in re.split(r"\n---\n", body) if p.strip()]


def slides(docs: DataFrame, *keep: str) -> DataFrame:
    """One row per slide."""

    @F.pandas_udf(SLIDES)
    def parse(texts: pd.Series) -> pd.Series:
        from marginalia.operators.slides import slides_of

        return pd.Series([slides_of(t or "") for t in texts])

    batches.small(docs.sparkSession)
    rows = docs.select(*keep, F.posexplode(parse("text")).alias("slide", "s"))
    return rows.select(*keep, "slide", "s.*")
