"""Packing: the plan against best fit piece by piece, and packed documents read back."""

import bisect
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import packing, queries, records

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def tokenizer():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path("word_bpe_49k.json")


def best_fit(counts, capacity):
    """Sequences that best fit takes, piece by piece from the longest down."""
    rooms, n = [], 0
    for s in sorted(counts, reverse=True):
        for _ in range(counts[s]):
            k = bisect.bisect_left(rooms, s)
            n += k == len(rooms)
            room = (rooms.pop(k) if k < len(rooms) else capacity) - s
            bisect.insort(rooms, room)
    return n


def most_pairs(counts, capacity):
    """The most pairs of pieces above a third, by trying all ways for few pieces."""
    items = [s for s, n in counts.items() if 3 * s > capacity for _ in range(n)]

    def pairs(left):
        if len(left) < 2:
            return 0
        first, rest = left[0], left[1:]
        return max([pairs(rest)] + [1 + pairs(rest[:k] + rest[k + 1 :]) for k in range(len(rest)) if first + rest[k] <= capacity])

    return len(items), pairs(items)


@pytest.mark.parametrize("seed", range(150))
def test_plan_fills_without_gaps(seed):
    rnd = random.Random(seed)
    capacity, kinds = rnd.choice([1, 2, 10, 100, 2048]), rnd.choice([1, 5, 50, 300])
    counts = {rnd.randint(1, capacity if rnd.random() < 0.5 else max(1, capacity // 3)): rnd.choice([1, 2, 3, rnd.randint(1, 200)]) for _ in range(kinds)}
    made = packing.Plan(dict(counts), capacity)
    inside, ranks = defaultdict(list), defaultdict(list)
    for r in made.runs:
        ranks[r.length] += range(r.rank, r.rank + r.count)
        for k in range(r.count):
            inside[r.sequence + k // r.per].append((r.offset + k % r.per * r.length, r.length))
    assert {s: list(range(n)) for s, n in counts.items()} == {s: sorted(k) for s, k in ranks.items()}
    assert set(inside) == set(range(made.sequences))
    for pieces in inside.values():
        end = 0
        for at, length in sorted(pieces):
            assert at == end
            end += length
        assert end <= capacity and sum(3 * s > capacity for _, s in pieces) <= 2
    assert made.sequences <= best_fit(counts, capacity)


@pytest.mark.parametrize("seed", range(40))
def test_large_pieces_get_the_most_pairs(seed):
    rnd = random.Random(seed)
    counts = Counter(rnd.randint(34, 100) for _ in range(9))
    n, pairs = most_pairs(counts, 100)
    assert packing.Plan(dict(counts), 100).sequences == n - pairs


def brute(docs, tokenizer, capacity, end_id=0):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(tokenizer)
    for doc_id, text in docs:
        ids = np.array(coder.encode(text or "", add_special_tokens=False).ids + [end_id], "<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at : at + capacity]
            yield doc_id, k, at, len(own), zlib.crc32(own.tobytes())


def check(got, docs, tokenizer, capacity):
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == Counter(brute(docs, tokenizer, capacity))
    inside = defaultdict(list)
    for r in got:
        inside[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in inside.values():
        end = 0
        for at, length in sorted(pieces):
            assert at == end
            end += length
        assert end <= capacity
    assert len(inside) <= best_fit(Counter(r["length"] for r in got), capacity)


def test_documents_read_back(spark, data, tokenizer):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    check(queries.op11_best_fit_packing(spark, data).collect(), docs, tokenizer, 2048)


def test_odd_tables(spark, tokenizer):
    rows = [(1, None), (2, ""), (None, "no id"), (None, "no id"), (4, "same words"), (4, "same words"), (4, "other words"), (5, "long text, " * 3000), (2**53 + 1, "é 漢字 <|endoftext|> \x00"), (6, " \n ")]
    rows += [(100 + k, "a copy of a hot text " * 4) for k in range(300)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("ids", F.lit(1)).withColumn("length", F.lit("x")).withColumn("part", F.lit(None).cast("int"))
    check(packing.contents(packing.pack(table, tokenizer, capacity=64)).collect(), rows, tokenizer, 64)
    assert packing.contents(packing.pack(table.limit(0), tokenizer)).count() == 0


def test_sequences_hold_the_ids(spark, tokenizer):
    rows = [(k, "some words of a text " * (k % 7)) for k in range(60)]
    packed = packing.pack(spark.createDataFrame(rows, SCHEMA), tokenizer, end_id=None, capacity=50).collect()
    coder = records.Encoder(tokenizer, None)
    found = {}
    for s in packed:
        ids = packing.ids_of(s["pieces"])
        assert len(ids) == s["length"] == sum(p["length"] for p in s["pieces"])
        for p in s["pieces"]:
            found[p["doc_id"], p["piece"]] = ids[p["offset"] : p["offset"] + p["length"]].tobytes()
    for k, text in rows:  # without an end id an empty text has no pieces
        parts = sorted(key for key in found if key[0] == k)
        assert b"".join(found[key] for key in parts) == coder.encode(text)
