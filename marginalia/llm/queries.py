"""Queries that apply the operators to whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import records

    return records.tokenize_to_records(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    return warc.round_trip(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
g AS (SELECT t, max(page_id) AS top, count(*) AS n, sha1(t) AS h FROM p GROUP BY t),
b AS (SELECT t, top, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + ((('0x' || substr(h, (1 + 5 * (i // 4))::INT, 5))::BIGINT >> (5 * (3 - i % 4))) & 31))::INT, 1)), '') AS payload_digest FROM g)
SELECT p.page_id, octet_length(encode(p.t))::BIGINT AS payload_bytes, b.payload_digest,
       CASE WHEN p.page_id = b.top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id = b.top THEN NULL ELSE b.top END AS refers_to
FROM p JOIN b ON p.t = b.t
"""


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import rules

    judged = rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    return langid.identify(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import linecrf

    return linecrf.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    documents = table(spark, sf_dir, "documents")
    return pii.find(documents, pii.fit(documents))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import neardup

    return neardup.link(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import linededup

    return linededup.report(table(spark, sf_dir, "documents"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import packing

    return packing.contents(packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import merkle

    return merkle.tamper_check(table(spark, sf_dir, "documents"))


#: One way up for all groups, then every leaf's siblings level by level; the root's tree is one more group.
OP12_SQL = """
WITH RECURSIVE f AS (
  SELECT doc_id, lang, n_chars, [CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END,
         CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END, CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END] AS head,
         CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail FROM documents),
h AS (
  SELECT doc_id, lang, sha256(array_to_string(head, '') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
         sha256(array_to_string(head, '') || coalesce(strlen(n1::VARCHAR) || ':' || n1, '-') || tail) AS changed
  FROM (SELECT *, n_chars::HUGEINT + 1 AS n1 FROM f)),
l AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n,
         coalesce('1' || lang, '0') AS g FROM h),
up AS (
  SELECT g, 0 AS lvl, place, n, leaf AS d FROM l
  UNION ALL
  SELECT g, lvl + 1, place // 2, (n + 1) // 2, sha256(d || coalesce(other, ''))
  FROM (SELECT *, lead(d) OVER (PARTITION BY g, lvl ORDER BY place) AS other FROM up WHERE n > 1) WHERE place % 2 = 0),
subroots AS (SELECT g, d, row_number() OVER (ORDER BY g) - 1 AS place, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (
  SELECT 0 AS lvl, place, n, d FROM subroots
  UNION ALL
  SELECT lvl + 1, place // 2, (n + 1) // 2, sha256(d || coalesce(other, ''))
  FROM (SELECT *, lead(d) OVER (PARTITION BY lvl ORDER BY place) AS other FROM top WHERE n > 1) WHERE place % 2 = 0),
steps AS (
  SELECT l.g, l.place AS leaf_place, u.lvl, s.d AS sibling, (l.place >> u.lvl) % 2 = 1 AS before
  FROM l JOIN (SELECT DISTINCT g, lvl FROM up WHERE n > 1) u ON u.g = l.g LEFT JOIN up s ON s.g = l.g AND s.lvl = u.lvl AND s.place = xor(l.place >> u.lvl, 1)
  UNION ALL
  SELECT l.g, l.place, 100 + u.lvl, s.d, (r.place >> u.lvl) % 2 = 1
  FROM l JOIN subroots r ON r.g = l.g CROSS JOIN (SELECT DISTINCT lvl FROM top WHERE n > 1) u LEFT JOIN top s ON s.lvl = u.lvl AND s.place = xor(r.place >> u.lvl, 1)),
proofs AS (SELECT g, leaf_place, list(struct_pack(s := coalesce(sibling, ''), b := before) ORDER BY lvl) AS p FROM steps GROUP BY g, leaf_place),
crc AS (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(i)),
entries AS (SELECT list(v ORDER BY i) AS v FROM crc),
m AS (
  SELECT l.*, r.d AS subroot, coalesce(p.p, []) AS p, (SELECT d FROM top WHERE n = 1) AS root,
         coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(doc_id::VARCHAR) + 1), lambda i: ord(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT)),
                  lambda c, b: xor(c >> 8, e.v[xor(c & 255, b) + 1])), 4294967295) % 7 = 0, false) AS hit
  FROM l JOIN subroots r ON r.g = l.g CROSS JOIN entries e LEFT JOIN proofs p ON p.g = l.g AND p.leaf_place = l.place),
folds AS (
  SELECT *, list_reduce(list_prepend(struct_pack(s := CASE WHEN hit THEN changed ELSE leaf END, b := false), p),
                        lambda a, x: struct_pack(s := sha256(CASE WHEN x.b THEN x.s || a.s ELSE a.s || x.s END), b := false)).s AS folded_root FROM m)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(p, lambda x: x.s), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folds
"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from . import negatives

    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return negatives.mine(negatives.vectors(table(spark, sf_dir, "embeddings"), label), F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.own AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc,
        "op2_mixing": op2_mixing,
        "op3_language_id": op3_language_id,
        "op4_line_dedup": op4_line_dedup,
        "op5_quality_classifier": op5_quality_classifier,
        "op6_token_records": op6_token_records,
        "op7_pii": op7_pii,
        "op8_quality_rules": op8_quality_rules,
        "op9_jaccard_join": op9_jaccard_join,
        "op10_decontamination": op10_decontamination,
        "op11_best_fit_packing": op11_best_fit_packing,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": OP1_SQL,
        "op12_merkle_manifest": OP12_SQL,
        "op13_hard_negatives": OP13_SQL,
    }
