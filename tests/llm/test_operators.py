"""Operators against brute force, exact round trips and held-out accuracy, and on odd tables."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import common, decontaminate, langid, linecrf, linededup, mixing, neardup, pii, queries, records, rules, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in all columns, empty and very long texts, ties and repeated rows."""
    long = "word other thing. " * 4000
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "   \n\n", "en", "a"), (4, long, "en", "b"), (None, "no id here at all, but some words are", None, "b"), (6, "twice the same row of text is here", "en", "c"), (6, "twice the same row of text is here", "en", "c"), (7, "é ü ñ 漢字 \x00 ok", "fr", None)]
    return docs(spark, rows).withColumn("score", F.lit(1)).withColumn("label", F.lit("x")).withColumn("c", F.lit(2))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---------------------------------------------------------------- 1


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_round_trip(spark):
    big = "<p>" + "é" * 30_000
    rows = [(1, "http://a", "<x>"), (2, "http://b", "<x>"), (3, None, None), (4, "u", ""), (5, "u", big), (6, "u", big), (5, "u", big), (None, "u", "<x>")]
    got = warc.round_trip(spark, pages(spark, rows), keep_payload=True).collect()
    assert len(got) == len(rows) and all(r["error"] is None for r in got)
    text = {r[0]: (r[2] or "").encode() for r in rows}
    top = defaultdict(int)
    for k, v in text.items():
        if k is not None:
            top[v] = max(top[v], k)
    for r in got:
        payload = text[r["page_id"]]
        assert r["payload_bytes"] == len(payload)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        first = r["page_id"] == top[payload]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first else ("revisit", top[payload]))
        if first:
            assert bytes(r["payload"]) == payload
    assert max(r["segments"] for r in got) > 5


def test_warc_small_payloads_stay_responses(spark):
    got = warc.round_trip(spark, pages(spark, [(1, "u", "x"), (2, "u", "x")]), min_revisit_bytes=5).collect()
    assert {r["record_type"] for r in got} == {"response"}


def test_warc_damage_is_reported(spark, tmp_path):
    def rec(fields, block):
        return warc.record(fields, block)

    head = [("WARC-Type", "response"), ("WARC-Record-ID", "<a>"), ("WARC-Segment-Number", 1), ("WARC-Page-ID", 1)]
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"hello world", 4)
    tail = [("WARC-Type", "continuation"), ("WARC-Record-ID", "<b>"), ("WARC-Segment-Origin-ID", "<a>"), ("WARC-Segment-Number", 3), ("WARC-Segment-Total-Length", len(block))]
    (tmp_path / "a.warc.gz").write_bytes(rec(head, block[:50]) + rec(tail, block[50:]))
    (tmp_path / "b.warc.gz").write_bytes(rec([("WARC-Type", "response"), ("WARC-Record-ID", "<c>"), ("WARC-Page-ID", 2)], block[:-9]))
    paths = spark.createDataFrame([(str(tmp_path / f),) for f in ("a.warc.gz", "b.warc.gz")], "path string")
    got = {r["page_id"]: r["error"] for r in warc.read_archives(spark, paths).collect()}
    assert "missing" in got[1] and "chunk" in got[2]


def test_chunks():
    for n in (0, 1, 7, 100):
        data = bytes(range(256))[:n] * 3
        assert warc.dechunk(warc.chunked(data, 7)) == data
    with pytest.raises(ValueError):
        warc.dechunk(b"5\r\nabc")


BIG = 2**53 + 1


def test_warc_keeps_large_ids_beside_nulls(spark):
    rows = [(BIG, "u", "<a>"), (BIG + 2, "u", "<a>"), (None, "u", "<b>"), (BIG + 4, "u", "é" * 9000), (BIG + 6, "u", None)]
    wide = pages(spark, rows).coalesce(1).select("*", F.lit(1).alias("_d"), F.lit(2).alias("refers_to"), F.lit("x").alias("error"), F.lit("y").alias("_k"))
    got = {(r["page_id"], r["refers_to"], r["record_type"], r["payload_bytes"]) for r in warc.round_trip(spark, wide).collect()}
    assert got == {(BIG, BIG + 2, "revisit", 3), (BIG + 2, None, "response", 3), (None, None, "response", 3), (BIG + 4, None, "response", 18_000), (BIG + 6, None, "response", 0)}


def test_warc_empty(spark):
    assert warc.round_trip(spark, pages(spark, [])).count() == 0


# ---------------------------------------------------------------- 2


def brute_targets(size, weights=(3, 1, 2), share=1.5, most=2):
    """Sharing and resharing in rounds."""
    order = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in size if s is None]
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    total, fixed = share * sum(size.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        target = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if target[s] > most * size[s]]
        if not over:
            return fixed | target
        fixed |= {s: most * size[s] for s in over}


def test_mixing(spark, data):
    d = spark.read.parquet(f"{data}/documents.parquet")
    got = mixing.mix(d).toPandas().sort_values("doc_id").reset_index(drop=True)
    again = mixing.mix(d.repartition(7)).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert got.equals(again)
    text = {r["doc_id"]: r for r in d.collect()}
    assert len(got) == len(text)
    size = Counter()
    for r in got.itertuples():
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", text[r.doc_id]["text"] or ""))
        size[text[r.doc_id]["source"]] += r.size
    want = brute_targets(size)
    assert (got.taken <= 2 * got["size"]).all()
    taken = Counter()
    for r in got.itertuples():
        s = text[r.doc_id]["source"]
        assert r.source_size == size[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 257 for s in size)


def test_shards_are_multinomial_draws(spark, data):
    """Shards' source counts add up to the targets, vary as a multinomial draw does, and their blocks give the words taken."""
    quota = spark.createDataFrame([("a", 256 * 30_000, 256.0 * 20_000), ("b", 256 * 9_000, 256.0 * 10_000 + 5), ("c", 700, 0.0)], "s string, source_size long, target double")
    counts = mixing.shard_counts(mixing.plan(quota, 256, 300), 7).toPandas()
    assert counts.groupby("s").n.sum().to_dict() == {"a": 20_000, "b": 10_001}
    n_shards = -(-30_001 // 300)
    assert set(counts.shard) == set(range(n_shards))
    for s, total in (("a", 20_000), ("b", 10_001)):
        own = counts[counts.s == s].sort_values("shard")
        mean = total / n_shards
        assert (own.before.to_numpy() == np.append(0, own.n.cumsum()[:-1])).all()
        # the sum of squares over the mean is a chi-square of n_shards - 1 degrees
        assert abs(((own.n - mean) ** 2).sum() / mean - (n_shards - 1)) < 5 * np.sqrt(2 * n_shards)
    size = counts.groupby("shard").n.sum()
    assert (abs(size - 300) < 6 * np.sqrt(300)).all()
    drawn = mixing.slots(quota, 256, 7, 300).toPandas()
    assert drawn.groupby(["s", "shard"]).size().to_dict() == {(r.s, r.shard): r.n for r in counts.itertuples()}
    assert not drawn.duplicated(["s", "slot"]).any() and drawn[drawn.s == "a"].block.is_unique
    d = spark.read.parquet(f"{data}/documents.parquet")
    blocks = mixing.shards(d, shard_slots=32).collect()
    words = {r["doc_id"]: re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "") for r in d.select("doc_id", "text").collect()}
    taken, per_shard = Counter(), Counter()
    for r in blocks:
        at = 0
        per_shard[r["shard"]] += 1
        for p in r["pieces"]:
            assert p["place"] == at and p["first"] + p["words"] <= len(words[p["doc_id"]])
            at += p["words"]
            taken[p["doc_id"]] += p["words"]
        assert at <= 256
    assert taken == {r["doc_id"]: r["taken"] for r in mixing.mix(d, shard_slots=32).collect() if r["taken"]}
    assert len(per_shard) > 3 and sum(at < 256 for at in (sum(p["words"] for p in r["pieces"]) for r in blocks)) <= 3 * 20


def test_mixing_odd(spark, odd, empty):
    clash = odd.withColumn("_k", F.lit(1)).withColumn("key", F.lit(2)).withColumn("n", F.lit(3)).withColumn("rows", F.lit(4)).withColumn("i", F.lit(5))
    mixed = mixing.mixed_documents(clash)
    assert mixed.columns == clash.columns and {(r["_k"], r["key"], r["n"], r["rows"], r["i"]) for r in mixed.collect()} == {(1, 2, 3, 4, 5)}
    # rows without an id are of their own, whatever their length
    nameless = docs(spark, [(None, f"word w{k}", "en", "a") for k in range(400)])
    assert mixing.mix(nameless).count() == 400 and mixing.sizes(nameless).select("h").distinct().count() == 400
    got = mixing.mix(odd).toPandas()
    assert len(got) == odd.count()
    assert (got.taken <= 2 * got["size"]).all() and got[got["size"] == 0].taken.sum() == 0
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed_documents(odd).columns == odd.columns


def test_mixed_words_meet_targets(spark):
    """One hot source at 0.65 of its words, documents of many blocks, and repeated rows."""
    rng = np.random.default_rng(5)
    rows = [(i, "w " * int(n), "en", "abc"[0 if i % 10 < 7 else 1 + i % 2]) for i, n in enumerate(np.minimum(rng.lognormal(5.5, 1.3, 1500), 8000).astype(int) + 1)]
    rows += [(9000, "z " * 700, "en", "a")] * 40
    d = docs(spark, rows)
    for options in ({}, {"seed": 11}):
        got = mixing.mix(d, **options).toPandas()
        source = {r[0]: r[3] for r in rows}
        want = {source[i]: x for i, x in zip(got.doc_id, got.target, strict=True)}
        out = [(r["doc_id"], r["source"], r["n"]) for r in mixing.mixed_documents(d, **options).select("doc_id", "source", F.regexp_count("text", F.lit(r"\S+")).alias("n")).collect()]
        size = {"all": Counter(), "long": Counter()}
        for i, s, n in out:
            size["all"][s] += n
            size["long"][s] += n * (n > 1000)
        long = got[got["size"] > 1000].groupby(got.doc_id.map(source)).taken.sum()
        for s in want:
            assert abs(size["all"][s] / want[s] - 1) < 0.03, (s, size["all"][s], want[s])
            assert abs(size["long"][s] - long[s]) < 8001
    took = spark.createDataFrame([(i, "s", 1 + i % 3, 50 + i, (1 + i % 3) * (30 + 2 * i)) for i in range(300)], "_k long, s string, rows long, size long, taken long")
    for r in mixing.copies(took).join(took.drop("rows"), "_k").collect():
        assert r["taken"] // r["size"] <= r["n"] <= -(-r["taken"] // r["size"])


@pytest.mark.parametrize("n", [1, 2, 3, 10, 257])
def test_permutations(spark, n):
    got = [r["y"] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), 5, F.lit("s")).alias("y")).collect()]
    assert sorted(got) == list(range(n))
    assert n < 10 or got != list(range(n))


# ---------------------------------------------------------------- 3


def test_language_accuracy(spark, data):
    d = spark.read.parquet(f"{data}/documents.parquet")
    got = langid.identify(d).join(d.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 20 and (held.lang_pred == held.lang).mean() > 0.95
    assert got.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(got.doc_id, got.held_out, strict=True))


def brute_grams(text):
    """Letters, pairs and triples of the words with one blank around each; a blank between two words is shared."""
    words = re.findall(r"[^\W\d_]+", text.lower())
    if not words:
        return Counter()
    line = f" {' '.join(words)} "
    c = Counter(x for x in line if x != " ")
    c.update(line[k : k + 2] for k in range(len(line) - 1))
    c.update(x for k in range(len(line) - 2) if (x := line[k : k + 3])[1] != " ")
    return c


def brute_rank(counts, size):
    key = lambda g: sum(ord(c) << (21 * (len(g) - 1 - k)) for k, c in enumerate(g))
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], key(x[0])))][:size]


def test_language_by_brute_force(spark):
    """Every prediction and score against ranks and out-of-place distances worked out by hand on strings."""
    rng = np.random.default_rng(9)
    vocabulary = {"en": "the cat and dog ran to a big house by the river".split(), "de": "der hund und die katze lief über straße zum großen fluß".split(), "es": "el gato y la niña corren por año hacia una casa".split()}
    rows = [(i, " ".join(rng.choice(vocabulary[lang], rng.integers(1, 30))) + ["", " 12 _x 3.5", "\n\nÀÉ"][i % 3], lang, "s") for i, lang in enumerate(rng.choice(["en", "de", "es"], 120).tolist())]
    rows += [(500, None, "en", "s"), (501, "12 34 !!", "de", "s"), (502, "the the the", None, "s")]
    for size in (20, 300):
        counts = {}
        for i, t, lang, _ in rows:
            if t is not None and lang and zlib.crc32(str(i).encode()) % 4 != 2:
                # as the operator does, texts of one language are laid side by side
                counts.setdefault(lang, []).append(t)
        learnt = {r[2]: r for r in rows}
        profiles = langid.learn(docs(spark, [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]).coalesce(1), size)
        assert set(profiles) == set(counts) <= set(learnt)
        named = {lang: [g for g in brute_rank(brute_grams("\n".join(t)), size)] for lang, t in counts.items()}
        spelled = lambda n: "".join(chr(int(n) >> (21 * k) & (1 << 21) - 1) for k in (2, 1, 0) if int(n) >> (21 * k))
        assert {lang: [spelled(n) for n in own] for lang, own in profiles.items()} == named
        for r in langid.identify(docs(spark, rows).coalesce(1), size).collect():
            rank = brute_rank(brute_grams(dict((i, t or "") for i, t, _, _ in rows)[r["doc_id"]]), size)
            far = {lang: sum(abs(p.index(g) - k) if g in p else size for k, g in enumerate(rank)) for lang, p in named.items()}
            best = min(far, key=lambda x: (far[x], x))
            assert (r["lang_pred"], r["score"]) == ((best, pytest.approx(1 - far[best] / (size * len(rank)))) if rank else ("und", 0.0))


def test_many_languages_are_learnt(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, f"{letters[i % 26]}{letters[i // 26]}" * 3 + " " + letters[i // 26] * 4, f"l{i:03d}", "s") for i in range(260)]
    known = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    assert len(langid.learn(docs(spark, known))) == len(known) == len({r[2] for r in known})


def test_language_odd(spark, odd, empty):
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.identify(odd).collect()}
    assert (1, "und") in got and (2, "und") in got and (3, "und") in got and (4, "en") in got
    assert langid.identify(empty).count() == 0
    clash = odd.withColumn("_held", F.lit(5)).withColumn("lang_pred", F.lit("z")).withColumn("score", F.lit(9))
    kept = langid.accepted(clash)
    assert kept.columns == clash.columns and {(r["_held"], r["lang_pred"], r["score"]) for r in kept.collect()} == {(5, "z", 9)}
    kept = langid.accepted(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id IN (1, 2, 3)").count() == 0 and kept.filter("doc_id = 6").count() == 2


# ---------------------------------------------------------------- 4


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:j] + b[j + 1 :] == a for j in range(len(b)))


def brute_lines(rows, least):
    first, seen = {}, []
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            if w := tuple(line.split()):
                seen.append((i, k, w))
                first[w] = min(first.get(w, (i, k)), (i, k))
    gone = set()
    for i, k, w in seen:
        if first[w] < (i, k) or (len(w) >= least and any(len(o) >= least and o != w and at < (i, k) and near(w, o) for o, at in first.items())):
            gone.add((i, k))
    return gone


def test_line_dedup(spark):
    base = [f"w{k}" for k in range(10)]
    lines = [" ".join(base)]
    for k in range(10):
        lines += [" ".join(base[:k] + ["x"] + base[k + 1 :]), " ".join(base[:k] + base[k + 1 :]), " ".join(base[:k] + ["y"] + base[k:])]
    lines += ["short line", "short lime", "", "  ", "short line", " ".join(base[::-1]), " ".join(["z", *base[1:9], "q"])]
    rng = np.random.default_rng(3)
    rows = [(d, "\n".join(lines[k] for k in rng.integers(0, len(lines), 6))) for d in range(30)] + [(90, None), (91, ""), (92, "a " * 5000)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc"], r["line"]) for r in linededup.removals(table).collect()}
    assert got == brute_lines(rows, linededup.MIN_WORDS)
    kept = {r["doc_id"]: r["text"] for r in linededup.without_duplicates(table).collect()}
    for i, t in rows:
        assert kept[i] == (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in got))


def test_short_lines_and_nul(spark):
    """Boilerplate of few words goes, and lines with U+0000 go like others; random lines against brute force."""
    rng = np.random.default_rng(13)
    rows = [(1, "Click here to read our privacy policy\nnul \x00 in\x00side a line of words"), (2, "Click here to read our privacy policies\nnul \x00 in\x00side a line of texts"), (3, "two words\ntwo swords\none\ntwo")]
    rows += [(10 + k, "\n".join(" ".join(rng.choice(list("abcd"), rng.integers(1, 7))) for _ in range(4))) for k in range(40)]
    got = {(r["doc"], r["line"]) for r in linededup.removals(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(2, 0), (2, 1)} <= got and not {(3, 0), (3, 1), (3, 2), (3, 3)} & got
    assert got == brute_lines(rows, linededup.MIN_WORDS)


def test_line_dedup_odd(spark, odd, empty):
    clash = odd.withColumn("_doc", F.lit(3)).withColumn("doc", F.lit(4)).withColumn("gone", F.lit(5)).withColumn("line", F.lit(6))
    out = linededup.without_duplicates(clash)
    assert out.columns == clash.columns and {(r["_doc"], r["doc"], r["gone"], r["line"]) for r in out.collect()} == {(3, 4, 5, 6)}
    out = linededup.without_duplicates(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert linededup.report(empty).count() == 0


# ---------------------------------------------------------------- 5


def test_forward_backward_by_brute_force():
    rng = np.random.default_rng(1)
    sizes = np.array([3, 0, 1, 5])
    scores, moves = rng.standard_normal(9), rng.standard_normal((2, 2))
    p, pairs, log_z = linecrf.marginals(scores, moves, sizes)
    want, z_all, pair = np.zeros(9), 0.0, np.zeros((2, 2))
    at = 0
    for n in sizes:
        if n:
            z, hit, own = 0.0, np.zeros(n), np.zeros((2, 2))
            for k in range(2**n):
                y = [(k >> j) & 1 for j in range(n)]
                w = np.exp(sum(scores[at + j] * y[j] for j in range(n)) + sum(moves[y[j], y[j + 1]] for j in range(n - 1)))
                z += w
                hit += w * np.array(y)
                for j in range(n - 1):
                    own[y[j], y[j + 1]] += w
            want[at : at + n] = hit / z
            pair += own / z
            z_all += np.log(z)
        at += n
    assert np.allclose(p, want) and np.allclose(pairs, pair) and np.isclose(log_z, z_all)


def test_quality_accuracy(spark, data):
    d, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    got = linecrf.classify(d, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.9
    assert got.score.between(0, 1).all()


def test_quality_odd(spark, odd, empty):
    labels = spark.createDataFrame([(2, 1), (4, 0), (6, 1), (7, None)], "doc_id long, quality int")
    assert linecrf.classify(odd, labels).count() == odd.count()
    assert linecrf.classify(odd, labels.limit(0)).filter("score = 0.5").count() == odd.count()
    assert linecrf.classify(empty, labels).count() == 0
    # a null id has no label; one id with two texts counts with both, and two labels of one id with each
    twice = docs(spark, [(1, "good text here.\nand more of it.", "en", "a"), (1, "### $$$ ###", "en", "a"), (None, "some", "en", "a"), (3, "fine line.", "en", "a")]).withColumn("quality", F.lit(7)).withColumn("held_out", F.lit(0))
    got = linecrf.classify(twice, spark.createDataFrame([(1, 1), (1, 0), (3, 1), (None, 0)], "doc_id long, quality int")).collect()
    assert len(got) == 4 and all(0 <= r["score"] <= 1 for r in got)


def test_quality_sample_is_bounded(spark, data, monkeypatch):
    d, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    seen = []
    train = linecrf.train
    monkeypatch.setattr(linecrf, "train", lambda own, *a, **b: seen.append(own) or train(own, *a, **b))
    linecrf.fit(d, labels, sample=40)
    linecrf.fit(d, labels, sample_lines=100)
    linecrf.fit(d, labels, most_lines=3)
    assert 20 <= len(seen[0]) <= 40 and sum(map(len, seen[1])) <= 100 and max(map(len, seen[2])) <= 3


# ---------------------------------------------------------------- 6


@pytest.fixture(scope="module")
def tokenizer():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


def test_encoder(tokenizer):
    path, t = tokenizer
    e = records.Encoder(path, 2)
    texts = ["a<|endoftext|>b don't I'LL it's 12,3", "x\x1cq\x85z ́e é ΣΑΣ İß", "naïve, Œuvre 漢字 ª µ", "", "  ", "Hello, WORLD!! ***"]
    for text in texts:
        assert np.frombuffer(e.encode(text), "<u4").tolist() == [*t.encode(text, add_special_tokens=False).ids, 2]


def test_records(spark, odd, empty, tokenizer):
    path, t = tokenizer
    manifest = records.write(odd, common.new_folder(spark, "test"), path)
    got = records.read(spark, manifest).collect()
    rows = odd.collect()
    assert len(got) == len(rows)
    want = Counter()
    for r in rows:
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        want[r["doc_id"], len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    got.sort(key=lambda r: r["start"])
    assert [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got][:-1]]).tolist()
    known = [r["doc_id"] for r in got if r["doc_id"] is not None]
    assert known == sorted(known) and got[0]["doc_id"] is None
    for r in manifest.collect():
        in_order = [(i, x.tobytes()) for i, x in records.records_of(r["path"])]
        assert sorted(in_order, key=str) == sorted([(i, x.tobytes()) for i, x in records.shuffled(r["path"], 1)], key=str)
        assert len(records.index_of(r["path"])) == r["docs"]
    assert records.read(spark, records.write(empty, common.new_folder(spark, "test"), path)).count() == 0


def test_records_keep_large_ids_beside_nulls(spark, tokenizer):
    table = docs(spark, [(BIG, "one", None, None), (None, "two", None, None), (BIG + 2, None, None, None)]).coalesce(1).withColumn("_h", F.lit(3)).withColumn("n_tokens", F.lit(4))
    got = records.tokenize_to_records(spark, table, tokenizer[0]).collect()
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == [None, BIG, BIG + 2]


def test_damaged_records(tmp_path):
    data = records.frame(records.pack(5, np.array([1, 2, 70_000])))
    (tmp_path / "f").write_bytes(data)
    assert [(i, x.tolist()) for i, x in records.records_of(str(tmp_path / "f"))] == [(5, [1, 2, 70_000])]
    for k in (0, 9, 15, len(data) - 1):
        bad = bytearray(data)
        bad[k] ^= 1
        (tmp_path / "g").write_bytes(bad)
        with pytest.raises(ValueError):
            list(records.records_of(str(tmp_path / "g")))


# ---------------------------------------------------------------- 7


def brute_pii(t):
    luhn = pii.luhn
    out = [(a.start(), 0, a.end()) for a in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(a.start(), 1, a.end()) for a in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in a[0].split("."))]
    out += [(a.start(), 2, a.end()) for a in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(re.sub("[ -]", "", a[0])) <= 19 and luhn(re.sub("[ -]", "", a[0]))]
    out += [(a.start(), 3, a.end()) for a in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", a[0])) <= 15]
    return sorted(out)


def test_base_spans():
    rng = np.random.default_rng(2)
    letters = list("a.@1+- 2(-.@b,3é")
    for _ in range(5000):
        t = "".join(rng.choice(letters, rng.integers(0, 40)))
        assert pii.base_spans(t) == brute_pii(t), t


def test_slopes_of_the_tagger():
    """The gradient through both LSTMs agrees with differences."""
    rng = np.random.default_rng(0)
    x, w = rng.standard_normal((5, 2, 3, 4)), rng.standard_normal((2, 4 + 2 + 1, 8)) * 0.5
    out, kept = pii.lstm(x, w)
    slope = rng.standard_normal(out.shape)
    dw, dx = pii.lstm_back(x, w, kept, slope)
    for at in ((0, 1, 2), (1, 5, 7), (0, 6, 3)):
        for sign in (1,):
            up, down = w.copy(), w.copy()
            up[at] += 1e-6
            down[at] -= 1e-6
            assert np.isclose(dw[at], sign * ((pii.lstm(x, up)[0] - pii.lstm(x, down)[0]) * slope).sum() / 2e-6, atol=1e-5)
    up = x.copy()
    up[2, 1, 0, 1] += 1e-6
    assert np.isclose(dx[2, 1, 0, 1], ((pii.lstm(up, w)[0] - out) * slope).sum() / 1e-6, atol=1e-4)


def test_pii(spark, data, odd, empty):
    some = spark.createDataFrame([(1, "mail a.b@c.de or +1 (234) 555-0100."), (2, None), (3, "ip 10.0.0.1 and 999.1.1.1"), (4, "x" * 3000 + " 4111 1111 1111 1111")], "doc_id long, text string")
    model = pii.fit(some, rounds=3)
    got = {r["doc_id"]: r for r in pii.find(some, model).collect()}
    assert (got[1]["n_email"], got[1]["n_phone"], got[3]["n_ip"], got[4]["n_card"]) == (1, 1, 1, 1)
    assert got[2]["spans"] == "" and got[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    for r in some.collect():
        base = pii.written(brute_pii(r["text"] or ""))
        assert got[r["doc_id"]]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) <= set(got[r["doc_id"]]["spans"].split(","))
    assert pii.find(odd, model).count() == odd.count()
    assert pii.find(empty, pii.fit(empty, rounds=2)).count() == 0
    assert pii.redact("mail a.b@c.de now", [(5, 0, 13)]) == "mail <email> now"


@pytest.fixture(scope="module")
def tagger(spark, data):
    return pii.fit(spark.read.parquet(f"{data}/documents.parquet"))


def corpus_windows(spark, data, part):
    rows = spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect()
    return [(w, pii.base_spans(w)) for r in rows if r["text"] and r["doc_id"] % 2 == part for w in pii.cut_windows(r["text"][::-1])]


def test_tagger_finds_what_the_patterns_do_not(spark, data, tagger):
    """Held-out made-up data in forms that the patterns do not know: recall and precision per kind, and none in clean text."""
    rows = pii.examples(corpus_windows(spark, data, 0), np.random.default_rng(77), 1200, base=0.0, made=1.0)
    texts = [t for t, _ in rows]
    base = [pii.base_spans(t) for t in texts]
    added = pii.added_spans(texts, base, tagger, tagger.sure)
    wanted, hit, wrong = Counter(), Counter(), 0
    for (_, gold), own, new in zip(rows, base, added, strict=True):
        got = {x[:3] for x in new}
        wrong += len(got - set(gold))
        for s, k, e in gold:
            if e < pii.LENGTH and not any(s < e2 and s2 < e for s2, _, e2 in own):
                wanted[k] += 1
                hit[k] += (s, k, e) in got
    assert all(hit[k] >= 0.9 * wanted[k] > 50 for k in range(4)), (hit, wanted)
    assert wrong <= 0.05 * sum(hit.values())
    clean = [t for t, s in corpus_windows(spark, data, 1) if not re.search(r"[0-9@]", t)]
    assert sum(map(len, pii.added_spans(clean, [[] for _ in clean], tagger, tagger.sure))) <= len(clean) / 200
    for text, want in (("please write to jane [at] example [dot] org today", "jane [at] example [dot] org"), ("you can call (555) 123-4567 now", "(555) 123-4567")):
        found = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string"), tagger).first()
        assert want in [text[int(a) : int(b)] for _, a, b in (x.split(":") for x in found["spans"].split(",") if x)]
        assert found["n_email"] == found["n_phone"] == 0


def test_windows_are_reconciled(tagger):
    """A datum is found wherever it lies against the windows' edges, and long texts get the scores of single windows."""
    fill = "thing of the other that was in here for them and so on with these "
    datum, hits = "(0171) 234567", 0
    places = range(pii.STRIDE - 40, pii.WINDOW + 40, 4)
    for at in places:
        text = (fill * 20)[:at] + " " + datum + " " + fill * 5
        spans = pii.added_spans([text], [[]], tagger, tagger.sure)[0]
        hits += (at + 1, 3, at + 1 + len(datum)) in {x[:3] for x in spans}
        assert len(spans) <= 1
    assert hits >= 0.9 * len(places)
    # the averaged scores by a plain loop
    text = (fill * 3 + datum + " ") * 12  # a datum in each window, so that all are run
    codes = np.append(pii.codes_of(text), np.full(pii.WINDOW, 95))
    total, mass = np.zeros((len(text), pii.TAGS)), np.zeros(len(text))
    for start in range(0, max(1, len(text) - (pii.WINDOW - pii.STRIDE)), pii.STRIDE):
        part = pii.tag_scores(codes[None, start : start + pii.WINDOW], tagger)[:, 0]
        end = min(len(text), start + pii.WINDOW)
        head, tail = start > 0, end < len(text)
        weight = np.ones(end - start)
        over = pii.WINDOW - pii.STRIDE
        if head:
            weight[:over] = pii.EDGE[:over]
        if tail:
            weight[pii.STRIDE :] = pii.EDGE[pii.STRIDE :][: len(weight) - pii.STRIDE]
        for k in range(end - start):
            shared = (head and k < over) or (tail and k >= pii.STRIDE)
            w = weight[k] / (over + 1) if shared else 1.0
            total[start + k] += w * part[k]
            mass[start + k] += w
    places, scores, _ = pii.plausible([text], tagger)
    assert np.allclose(mass, 1) and len(places) and np.allclose(scores, total[places], atol=1e-3)


def test_decoding_by_brute_force():
    """Best tags, and the probability of a span, over all tag sequences of short stretches."""
    rng = np.random.default_rng(5)
    moves = rng.standard_normal((pii.TAGS, pii.TAGS)) + pii.allowed()
    sizes = np.array([3, 1, 4])
    starts = np.cumsum(sizes) - sizes
    scores = rng.standard_normal((8, pii.TAGS)) * 2
    tags, a, b, z = pii.decode(scores, starts, sizes, moves)
    for g, (s, n) in enumerate(zip(starts, sizes, strict=True)):
        ways = np.stack(np.meshgrid(*[range(pii.TAGS)] * n, indexing="ij"), -1).reshape(-1, n)
        value = scores[s + np.arange(n), ways].sum(1) + moves[0, ways[:, 0]] + moves[ways[:, -1], 0] + moves[ways[:, :-1], ways[:, 1:]].sum(1)
        assert ways[value.argmax()].tolist() == tags[s : s + n].tolist()
        assert np.isclose(np.log(np.exp(value).sum()), z[g])
        for k in range(n):
            own = np.array([np.exp(value[ways[:, k] == y]).sum() for y in range(pii.TAGS)])
            assert np.allclose(np.exp(a[s + k] + b[s + k] - z[g]), own / own.sum(), atol=1e-6)


def test_tagger_on_odd_texts(tagger):
    texts = ["", "5", "5" * 50_000, "a" * 3000, "+1 (", "@" * 500, "1.2.3.4 " * 400]
    base, every = pii.all_spans(texts, tagger)
    for text, own, all_ in zip(texts, base, every, strict=True):
        assert set(own) <= set(all_) and all(0 <= s < e <= len(text) for s, _, e in all_)
        for kind in range(4):
            ends = [x for x in all_ if x[1] == kind]
            assert all(x[2] <= y[0] for x, y in zip(ends, ends[1:], strict=False))


# ---------------------------------------------------------------- 8


def test_rules(spark, data, odd, empty):
    d, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    got = rules.judge(d).toPandas()
    text = {r["doc_id"]: r["text"] for r in d.collect()}
    for r in got.itertuples():
        t = text[r.doc_id]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        win = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        cover = {k + j for k in range(len(w) - 2) if win[tuple(w[k : k + 3])] > 1 for j in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (r.base_failed and r.kept)
    m = got.merge(labels.toPandas(), on="doc_id")
    assert m[(m.quality == 1) & ~m.base_failed].kept.mean() > 0.95
    assert rules.judge(odd).count() == odd.count() and rules.judge(empty).count() == 0


def test_repeated_words_of_many_kinds(monkeypatch):
    rng = np.random.default_rng(7)
    for _ in range(20):
        codes = rng.integers(0, 4, 40)
        assert rules.repeat_words(codes, 4) == rules.repeat_words(codes, 3_000_000)
    # three of these numbers would wrap around: (a, b, c) and (d, e, f) may not be taken for equal
    kinds = 2_200_000
    assert rules.repeat_words(np.arange(kinds), kinds) == 0
    assert rules.repeat_words(np.concatenate([np.arange(kinds), [5, 6, 7]]), kinds) == 6


def test_label_model_learns_what_rules_are_worth():
    """Votes drawn from a known model: accuracies come out, and the posterior decides better than all-must-pass."""
    rng = np.random.default_rng(3)
    n, true = 20_000, rng.random(20_000) < 0.7
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.6])
    votes = np.where(rng.random((n, 5)) < right, 1, -1) * np.where(true, 1, -1)[:, None]
    votes[rng.random((n, 5)) < 0.2] = 0
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    prior, p = rules.fit(patterns, counts.astype(float), weight=0.001)
    assert abs(prior - 0.7) < 0.03 and np.abs(rules.accuracies(prior, p) - right).max() < 0.04
    kept = rules.posterior(prior, p, patterns)[at.ravel()] >= 0.5
    assert (kept == true).mean() > 0.93 > ((votes >= 0).all(1) == true).mean()


def test_posterior_overrules_single_rules(spark, data):
    """`kept` is the label model's verdict, row by row, not the base rules alone."""
    got = rules.judge(spark.read.parquet(f"{data}/documents.parquet")).toPandas()
    names = [f"vote_{k}" for k in rules.rules()]
    patterns, at, counts = np.unique(got[names].to_numpy(), axis=0, return_inverse=True, return_counts=True)
    prior, p = rules.fit(patterns, counts.astype(float))
    want = rules.posterior(prior, p, patterns)[at.ravel()]
    assert np.allclose(got.posterior, want) and (got.kept == (~got.base_failed & (want >= 0.5))).all()
    assert ((got[names] < 0).any(axis=1) & got.kept).any() and (~got.base_failed & ~got.kept).any()


# ---------------------------------------------------------------- 9


def brute_links(rows, threshold=0.8, n=5):
    sets = {}
    for i, t in rows:
        w = re.findall(r"\w+", (t or "").lower())
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    links, root = Counter(), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (find(i), links[i]) for i in ids}


def test_near_duplicates(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for g in range(12):
        base = list(rng.choice(words, 80))
        for k in range(8):
            t = list(base)
            for _ in range(k // 3):
                t[int(rng.integers(0, 80))] = "changed"
            rows.append((g * 100 + k, " ".join(t)))
    rows += [(5000, ""), (5001, None), (5002, "one two"), (5003, "one two"), (5004, "word " * 9000)]
    monkeypatch.setattr(neardup, "BLOCK", 3)  # so that nodes have several blocks
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in neardup.link(table).collect()} == brute_links(rows)


def test_links_of_documents(spark, data):
    """Every link of the given documents at the default settings, against all pairs."""
    d = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    want = brute_links([(r["doc_id"], r["text"]) for r in d.collect()])
    assert sum(n for _, n in want.values()) > 20
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in neardup.link(d).collect()} == want


def test_forest_shortens_prefixes_until_recall(spark):
    """Prefixes are shortened further for links near the threshold than for close copies, and the estimate tells the truth."""
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(5000)]

    def pairs(share):
        rows = []
        for g in range(300):
            base = rng.choice(words, 240).tolist()
            cut = int(240 * share)
            rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(base[:cut] + rng.choice(words, 240 - cut).tolist()))]
        return rows

    depths = {}
    for name, share in (("close", 0.985), ("far", 0.905)):
        rows = pairs(share)
        _, found, levels = neardup.groups(spark.createDataFrame(rows, "doc_id long, text string"))
        links = sum(n for _, n in brute_links_of_pairs(rows)) // 2
        assert sum(r["links"] for r in found.collect()) // 2 == levels[-1]["links"] and levels[-1]["links"] >= 0.995 * links > 200
        depths[name] = [v["depth"] for v in levels]
        assert all(abs(v["links"] / links - v["recall"]) < 0.05 for v in levels)
    assert depths["close"][0] == depths["far"][0] == neardup.DEPTH and len(depths["close"]) < len(depths["far"])


def brute_links_of_pairs(rows):
    """(root, links) where only 2g and 2g + 1 can be alike."""
    out = []
    for k in range(0, len(rows), 2):
        out += brute_links(rows[k : k + 2]).values()
    return out


def test_pairs_are_compared_once():
    """Over all trees and depths each pair has one owner, the deepest and then first node that it shares."""
    rng = np.random.default_rng(6)
    labels = [rng.integers(0, 2, neardup.TREES * neardup.DEPTH).astype(">u2").tobytes() for _ in range(30)]
    seen = Counter()
    for depth in range(neardup.DEPTH, 0, -1):
        for tree in range(neardup.TREES):
            prefix = defaultdict(list)
            for k, own in enumerate(labels):
                prefix[own[tree * neardup.PART : tree * neardup.PART + depth * neardup.VALUE]].append(k)
            for members in prefix.values():
                mine = neardup.owned([labels[k] for k in members], tree, depth, None)
                seen.update((members[a], members[b]) for a, b in zip(*np.nonzero(np.triu(mine)), strict=True))
    assert set(seen.values()) == {1} and len(seen) == 30 * 29 // 2


def test_floor():
    assert neardup.floor_depth(0.8, 0.999) == 4 and neardup.floor_depth(0.8, 0.0) == neardup.DEPTH


def test_near_duplicates_odd(spark, odd, empty):
    assert neardup.link(odd).count() == odd.count()
    kept = neardup.without_duplicates(odd)
    assert kept.columns == odd.columns
    assert kept.filter("doc_id = 6").count() == 1 and kept.filter("doc_id IS NULL").count() == 1 and kept.count() == odd.count() - 1
    assert neardup.link(empty).count() == 0


def test_unlike_texts_under_one_id_stay(spark):
    """Only what is a copy goes, whatever else has its id."""
    a, b, c = ("the first text of some words and more of them", "quite another story about snow on the high pass", "a third thing that nobody else has ever said here")
    rows = [(1, a, "x"), (2, b, "x"), (2, a, "x"), (3, b, "x"), (3, c, "x"), (3, c, "y"), (4, c, "x"), (None, a, "x"), (5, "", "x"), (5, "", "x"), (6, None, "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, row_key string")
    kept = neardup.without_duplicates(table)
    assert kept.columns == table.columns
    got = sorted(map(tuple, kept.collect()), key=repr)
    assert got == sorted([(1, a, "x"), (2, b, "x"), (3, c, "x"), (None, a, "x"), (5, "", "x"), (5, "", "x"), (6, None, "x")], key=repr)


# ---------------------------------------------------------------- 10


def test_decontamination(spark, odd, empty):
    item = "A train leaves Paris at 9 and goes 120 km in 3 hours, so how fast does the train go on this trip with Anna"
    bench = spark.createDataFrame([(1, item), (2, "tiny one"), (3, None), (4, "short question of five words")], "item_id long, text string")
    filler = "Nothing of the kind is written in this text, which goes on for a while without any question. "
    other = item.replace("Paris", "Rome").replace("120", "450").replace("Anna", "Otto")
    rows = [(1, filler + item), (2, filler + other + filler), (3, filler), (4, item.lower()), (5, None), (6, "a short question of five words here"), (7, filler + item[:40]), (8, item.replace("9", "5").replace("5 and", "7 and"))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["contaminated"], r["items"]) for r in decontaminate.report(table, bench).collect()}
    assert got[1] == (True, [1]) and got[2] == (True, [1]) and got[4] == (True, [1]) and got[6] == (True, [4])
    assert not got[3][0] and not got[5][0] and not got[7][0]
    # a number that stands for two values of the document, but the stretch before it is long enough
    assert {r["doc_id"] for r in decontaminate.clean(table, bench).collect()} == {3, 5, 7} and got[8] == (True, [1])
    kept = decontaminate.clean(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert decontaminate.report(odd, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.report(empty, bench).count() == 0


def test_slots_must_agree(spark):
    item = "if we take the number 5 and add to it the number 5 then we get what as the sum of these"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, item.replace("5", "8")), (2, item.replace("5", "8", 1))]
    got = {r["doc_id"]: r["contaminated"] for r in decontaminate.report(spark.createDataFrame(rows, "doc_id long, text string"), bench, least=12).collect()}
    assert got == {1: True, 2: False}


def test_verbatim_and_merged_slots(spark):
    """A long copy with one repeated name changed, a question whose numbers became equal, and texts of the same grammar."""
    story = "in the morning we saw Anna go down to the river with a basket of bread and cheese for the old man on the other side, and later that day the whole village came and asked Anna for the way"
    sums = "if a farmer has 3 cows in the field and buys 5 more of them at the market how many are there at the end"
    pure = "so Anna met Bert and Anna told Carl that Dora saw Bert with Emil and Carl left Dora for Emil"
    bench = spark.createDataFrame([(1, story), (2, sums), (3, pure)], "item_id long, text string")
    rows = [
        (1, "x " + story.replace("asked Anna", "asked Otto")),
        (2, "x " + sums.replace("3", "4").replace("5", "4")),
        (3, "so Nora met Olaf and Paul told Quin that Rosa saw Sven with Toni and Ulla left Vera for Wilm"),
        (4, story[:70]),
    ]
    got = {r["doc_id"]: r["items"] for r in decontaminate.report(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {1: [1], 2: [2], 3: [], 4: [1]}


def test_agreement_by_brute_force():
    def one(rows):
        seen = {}
        return all(seen.setdefault(i, d) == d for row in rows for i, d in row)

    rng = np.random.default_rng(2)
    for _ in range(300):
        rows = [{(f"i{rng.integers(3)}", f"d{rng.integers(3)}") for _ in range(rng.integers(3))} for _ in range(8)]
        best = max(b - a for a in range(9) for b in range(a, 9) if one(rows[a:b]))
        assert decontaminate.agreement([(k, list(r)) for k, r in enumerate(rows)])[1] == best


def brute_template(text):
    """(word, kind) in order; kinds: word, num, unit, name."""
    out, before, start = [], None, True
    for t in re.findall(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[.!?\n:]", text):
        if t in ".!?\n:":
            before, start = None, True
            continue
        kind = "num" if t[0].isdigit() else "unit" if t.lower() in decontaminate.UNITS and before == "num" else "name" if t[0] != t[0].lower() and not start and t.lower() not in decontaminate.UNITS else "word"
        out.append((t.lower(), kind))
        before, start = ("num" if kind == "num" else None), False
    return out


def brute_fine(text):
    return re.findall(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[^\w\s]|_", text.lower())


def brute_contaminated(doc, item, least=6):
    """Every window of the item against every place of the document, without hashes."""
    own, other = brute_template(item), brute_template(doc)
    if len(own) < 4:
        a, b = brute_fine(item), brute_fine(doc)
        if len(own) < 2:
            return bool(a) and a == b
        size = min(8, len(a))
        need = min(least, len(a) - size + 1)
        for d in range(-len(a), len(b)):
            hits = sum(k + d >= 0 and b[k + d : k + d + size] == a[k : k + size] for k in range(len(a) - size + 1))
            if hits >= need:
                return True
        return False
    size = min(8, len(own))
    need = None
    ways = []
    for k in range(len(own) - size + 1):
        w = own[k : k + size]
        ways.append([slots for slots in (("num", "unit"), ("num", "unit", "name")) if sum(kind not in slots for _, kind in w) >= size / 2 and (slots[-1] != "name" or any(kind == "name" for _, kind in own))])
        if sum(kind not in ("num", "unit") for _, kind in w) < size / 2:
            ways[-1].append(())
    need = min(least, len(ways))
    for d in range(-len(own), len(other)):
        found = []
        for k, slots_of in enumerate(ways):
            w, v = own[k : k + size], other[max(0, k + d) : k + d + size]
            if k + d < 0 or len(v) < size:
                continue
            pairs = None
            for slots in slots_of:
                plain = lambda x: ("", x[1]) if x[1] in slots else (x[0], "")
                if [plain(x) for x in w] == [plain(x) for x in v]:
                    pairs = (pairs or set()) | {(f"{x[1]}:{x[0]}", f"{y[1]}:{y[0]}") for x, y in zip(w, v, strict=True) if x[1] in slots}
            if pairs is not None:
                found.append(pairs)
        if sum(all(i == j for i, j in p) for p in found) >= need:
            return True
        for a in range(len(found)):
            for b in range(a + need, len(found) + 1):
                seen = {}
                if all(seen.setdefault(i, j) == j for p in found[a:b] for i, j in p):
                    return True
    return False


def test_decontamination_by_brute_force(spark):
    rng = np.random.default_rng(21)
    words, names, units = "the a farmer has cows and buys more of them at market how many".split(), "Anna Bert Carl Dora".split(), "km kg hours".split()

    def text(n):
        out = []
        for _ in range(n):
            x = rng.random()
            out.append(str(rng.choice(words)) if x < 0.55 else str(rng.choice(names)) if x < 0.7 else str(rng.integers(2, 6)) + (f" {rng.choice(units)}" if rng.random() < 0.4 else "") if x < 0.93 else str(rng.choice([".", "?", "+", "=", "\n"])))
        return " ".join(out)

    def varied(t):
        swap = {str(k): str(k + int(rng.integers(0, 3))) for k in range(2, 6)} | {n: str(rng.choice(names)) for n in names}
        return " ".join(swap.get(w, w) if rng.random() < 0.97 else str(rng.choice(words)) for w in t.split(" "))

    items = [(k, text(int(rng.integers(1, 24)))) for k in range(30)] + [(100, "2 + 2 = ?"), (101, "Compute 3 4"), (102, "Yes."), (103, "3 5 8 13 21 34 55 89 144 233 377 610 987 1597"), (104, "12 km 13 km 14 km 15 km 16 km 17 km 18 km 19 km"), (105, "= ?")]
    rows = [(k, text(15) + " " + (varied(t) if rng.random() < 0.8 else t) + " " + text(15)) for k, (_, t) in enumerate(items * 4)]
    rows += [(900, "we ask what is 2 + 2 = ? in this text"), (901, "please Compute 3 4 now"), (902, "Yes."), (903, "yes. and more"), (904, "the row 3 5 8 13 21 34 55 89 144 233 377 610 987 1597 is known"), (905, "the row 4 6 9 14 22 35 56 90 145 234 378 611 988 1598 is not"), (906, "2 + 3 = ?"), (907, "so 12 km 13 km 14 km 15 km 16 km 17 km 18 km 19 km it is"), (908, "= ?")]
    got = {r["doc_id"]: r["items"] for r in decontaminate.report(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {i: sorted(k for k, item in items if brute_contaminated(t, item)) for i, t in rows}
    assert got == want
    assert 100 in want[900] and 101 in want[901] and 102 in want[902] and 102 not in want[903] and 103 in want[904] and 103 not in want[905] and 104 in want[907]
    assert 20 < sum(map(bool, want.values())) < len(rows)


def test_rows_without_ids_are_judged(spark):
    item = "how many cows does the farmer have at the end of the day after he went to the market"
    rows = [(None, "x " + item), (None, "nothing of the kind"), (None, None), (7, item), (7, "another text of the same id"), (8, item), (8, item)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row_key", F.lit("k")).withColumn("items", F.lit(1)).withColumn("item_id", F.lit(2))
    bench = spark.createDataFrame([(1, item), (None, item + " with 7 kg"), (2, None), (3, ""), (1, "short")], "item_id long, text string").withColumn("n", F.lit(9))
    kept = decontaminate.clean(table, bench)
    assert kept.columns == table.columns
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in kept.collect()) == [("7", "another text of the same id"), ("None", ""), ("None", "nothing of the kind")]
    got = [(r["doc_id"], r["contaminated"], r["n_items"], r["items"]) for r in decontaminate.report(table, bench).collect()]
    assert sorted(got, key=str) == sorted([(None, True, 2, [1]), (None, False, 0, []), (None, False, 0, []), (7, True, 2, [1]), (7, False, 0, []), (8, True, 2, [1]), (8, True, 2, [1])], key=str)


# ---------------------------------------------------------------- the pipeline


def test_pipeline(spark, data):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    d = spark.read.parquet(f"{data}/documents.parquet")
    kept = [d]
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = common.materialize(stage(spark, kept[-1], data), "stage")
        assert out.columns == d.columns, name
        kept.append(out)
    ids = [{r["doc_id"] for r in k.select("doc_id").collect()} for k in kept]
    assert ids[1] <= ids[0] and ids[2] <= ids[1] and ids[3] <= ids[2] and ids[4] <= ids[3]
    classes = {r["doc_id"]: r["class_id"] for r in neardup.link(kept[1]).collect()}
    assert ids[2] == set(classes.values())
    assert decontaminate.report(kept[3], spark.read.parquet(f"{data}/benchmark.parquet")).filter("contaminated").count() == 0
    assert corpus_pipeline.STAGES[4][1](spark, kept[4], data).count() == kept[4].count()


def test_registered():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in queries.queries()) == list(range(1, 14))
