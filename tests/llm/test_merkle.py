"""The Merkle manifest against the same trees built level by level, and on odd tables."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from marginalia.llm import merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def hexed(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def value(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, n_chars):
    return hexed(*map(value, (r["doc_id"], r["source"], r["lang"], n_chars, r["text"])))


def levels(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([hexed(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def steps(tree, at, fanout):
    for level in tree[:-1]:
        first = at - at % fanout
        yield "".join(level[first:at]), "".join(level[at + 1 : first + fanout])
        at //= fanout


def expected(rows, fanout=2):
    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["n_chars"]), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda x: x[:3])
        trees[g] = levels([x[2] for x in groups[g]], fanout)
    top = levels([trees[g][-1][0] for g in names], fanout)
    for k, g in enumerate(names):
        for at, (_, _, own, r) in enumerate(groups[g]):
            proof = [*steps(trees[g], at, fanout), *steps(top, k, fanout)]
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            now = leaf(r, r["n_chars"] + 1) if hit and r["n_chars"] is not None else own
            for left, right in proof:
                now = hexed(left, now, right)
            yield r["doc_id"], own, trees[g][-1][0], top[-1][0], hexed(*[a + b for a, b in proof]), now, now == top[-1][0]


@pytest.fixture(scope="module")
def odd(spark):
    """Groups of 1, 2, 3, 16, 17 and 40 rows; null ids, groups and values; repeated rows; long texts; values of one and two bytes."""
    rows = [(None, None, None, None, None), (None, "x", None, "a", 1), (7, "", "de", "", 0)]
    rows += [(i, f"t{i}" * (i % 5), "en", None if i % 4 else "s", i) for i in range(40)]
    rows += [(i, "é漢 " * 9000, "fr", "b", None) for i in range(17)] + [(5, "same", "é", "c", 4)] * 16 + [(2**53 + 1, "a", "z", "c", 2**63 - 1), (2**53 + 3, "a", "z", "c", 1), (2**53, "a", "z", "c", 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("fanout", [2, 3, 5, 20])
def test_manifest_as_built_level_by_level(odd, fanout):
    extra = odd.withColumn("digest", F.lit("x")).withColumn("_group", F.lit(1)).withColumn("leaf", F.lit(0))
    got = merkle.tamper_check(extra, fanout)
    assert Counter(map(tuple, got.collect())) == Counter(expected(odd.collect(), fanout))


def test_hit_rows_alone_fail(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").collect()
    got = merkle.tamper_check(spark.read.parquet(f"{data}/documents.parquet")).collect()
    assert Counter(map(tuple, got)) == Counter(expected(rows))
    assert {r["verified"] for r in got} == {True, False}


def test_same_as_sql(spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = queries.op12_merkle_manifest(spark, data)
    assert got.columns == names
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(queries.OP12_SQL).fetchall())


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(3, "t", "en", None, 1)], SCHEMA)
    assert list(map(tuple, merkle.tamper_check(one).collect())) == list(expected(one.collect()))
    assert merkle.tamper_check(one.limit(0)).count() == 0


def test_other_columns_and_keys(spark):
    rows = [(k, f"{k % 3}", "x" * k) for k in range(20)]
    got = merkle.manifest(spark.createDataFrame(rows, "id int, part string, body string"), 4, group="part", key="id", names=("id", "body")).collect()
    roots = {r["root"] for r in got}
    assert len(roots) == 1 and len({r["subroot"] for r in got}) == 3
    for r in got:
        now = r["leaf"]
        assert now == hexed(value(r["id"]), value("x" * r["id"]))
        for step in r["proof"]:
            now = hexed(step["left"], now, step["right"])
        assert now in roots
