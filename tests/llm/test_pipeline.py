"""The whole pipeline over a table with odd rows: what comes out of the records is what the stage before kept."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F


def test_run_on_odd_rows(spark, data, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{data}/documents.parquet").filter("doc_id < 60")
    text = docs.filter("lang = 'en' AND length(text) > 400").orderBy("doc_id").first()["text"]
    odd = [(1_000, None, "en", "a", 0), (1_001, "", "en", "a", 0), (1_002, " \n\t", None, None, None), (None, text, "en", "a", None), (1_003, text, "en", "a", None), (1_003, text, "en", "a", None), (1_003, text[::-1], "en", "b", None), (1_004, text + " \x00 漢字", "en", "b", None), (1_005, (text + "\n") * 40, "en", "b", None)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumn("row_key", F.lit("clash")).withColumn("score", F.lit(1))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{data}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, kept, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        kept = spark.read.parquet(f"{tmp_path}/stage{k}")
        assert kept.columns == docs.columns
    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = Counter()
    for r in kept.collect():
        ids = np.array(coder.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4")
        expected[r["doc_id"], len(ids), zlib.crc32(ids.tobytes())] += 1
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == expected and expected
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    assert 1_000 not in {r["doc_id"] for r in got}  # no language


def test_run_on_an_empty_table(spark, data, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    spark.read.parquet(f"{data}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{data}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
