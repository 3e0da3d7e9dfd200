"""Queries that SQL can't tell, against brute force over the whole smallest tables."""

import re

import pytest

from marginalia.functions import diff
from marginalia.plans import catalogue

QUERIES = catalogue.queries()


def tokens(text):
    return re.findall(r"\s+|\w+|[^\w\s]", text)


def longest_common(a, b):
    """Length of a longest common subsequence, a bit for each token of a."""
    masks = {}
    for k, t in enumerate(a):
        masks[t] = masks.get(t, 0) | 1 << k
    row = whole = (1 << len(a)) - 1
    for t in b:
        hit = row & masks.get(t, 0)
        row = ((row + hit) | (row - hit)) & whole
    return len(a) - row.bit_count()


@pytest.fixture(scope="module")
def texts(spark, data):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}


def test_word_diff_is_a_shortest_script(spark, data, texts):
    """The changes give the new text, and no script with fewer tokens does."""
    rows = {}
    for r in QUERIES["word_diff"](spark, data).collect():
        rows.setdefault(r["doc_id"], []).append(r)
    for doc_id, old in texts.items():
        new = re.sub(r"^([\s\S]*?)\bthe\b", r"\1THAT", old, count=1, flags=re.ASCII) + " More."
        out, at, touched = [], 0, 0
        for r in sorted(rows.get(doc_id, []), key=lambda r: r["seq"]):
            assert old[r["start"] : r["end"]] == r["old_text"]
            out += [old[at : r["start"]], r["new_text"]]
            at = r["end"]
            touched += len(tokens(r["old_text"])) + len(tokens(r["new_text"]))
        assert "".join(out) + old[at:] == new
        a, b = tokens(old), tokens(new)
        assert touched == len(a) + len(b) - 2 * longest_common(a, b)


def test_diffs_of_unlike_documents_are_shortest(texts):
    """Each document against the next one."""
    ids = sorted(texts)
    for x, y in zip(ids, ids[1:], strict=False):
        a, b = tokens(texts[x])[:1500], tokens(texts[y])[:1500]
        script = diff.edits(a, b)
        assert [t for kind, i, i2, _, _ in script if kind != "insert" for t in a[i:i2]] == a
        assert [t for kind, _, _, j, j2 in script if kind != "delete" for t in b[j:j2]] == b
        assert sum(i2 - i for kind, i, i2, _, _ in script if kind == "equal") == longest_common(a, b)


def test_three_way_merge_holds_both_edits(spark, data, texts):
    """What is accepted is both reviewers' text, what is rejected the base."""
    seen = 0
    for r in QUERIES["three_way_merge"](spark, data).collect():
        base, text = texts[r["doc_id"]], r["text"]
        if len(base.split()) < 3:
            continue
        seen += 1
        accepted = re.sub(r"\{~~(.+?)~>(.+?)~~\}", r"\2", text, flags=re.S)
        accepted = re.sub(r"\{\+\+(.+?)\+\+\}", r"\1", re.sub(r"\{--(.+?)--\}", "", accepted, flags=re.S), flags=re.S)
        rejected = re.sub(r"\{~~(.+?)~>(.+?)~~\}", r"\1", text, flags=re.S)
        rejected = re.sub(r"\{\+\+(.+?)\+\+\}", "", re.sub(r"\{--(.+?)--\}", r"\1", rejected, flags=re.S), flags=re.S)
        assert accepted == re.sub(r"^(\S+)", "First", base, count=1) + " One."
        assert rejected == base
    assert seen > 100


def test_single_space_by_pairs_of_lines(spark, data, texts):
    """A line keeps its gaps if one within five lines has a gap that ends in the same column."""
    for r in QUERIES["single_space"](spark, data).collect():
        lines = texts[r["doc_id"]].replace(" ", "  ").split("\n")
        ends = [{k for k in range(3, len(l)) if l[k - 2 : k] == "  " and not l[k].isspace() and l[:k].rstrip(" ") and not l[:k].rstrip(" ")[-1].isspace()} for l in lines]
        keep = [any(ends[k] & ends[n] for n in range(max(0, k - 5), min(len(lines), k + 6)) if n != k) for k in range(len(lines))]
        for line, stays, got in zip(lines, keep, r["text"].split("\n"), strict=True):
            body = line.lstrip()
            assert got == (line if stays else line[: len(line) - len(body)] + re.sub(r"(?<=\S) {2,}", " ", body))
