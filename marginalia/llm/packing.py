"""Packing of documents into sequences of bounded length by large-item matching and best fit.

Documents are encoded and cut into pieces of at most `capacity` ids.  Of
pieces above a third of the capacity at most two fit into a sequence, so they
are matched in pairs first: the longest first, each with the longest that fits
beside it, which gives the most pairs.  The others, from the longest down, go
where the least room that holds them is left.

Pieces of one length are alike.  So the plan is made for the counts of each
length, of which there are no more than the capacity whatever the number of
documents, in runs: so many pieces of a length, from such a rank on, go into
consecutive sequences at such an offset.  Pieces are then numbered within
their length (by task and place in the task, and the counts of the tasks
before) and look their run up.  Only the counts reach the driver.

Defined results: a null or empty text is a piece of the end id alone (without
an end id: of nothing, which is left out).  Rows without an id, repeated rows
and rows of one id are documents of their own.  Extra columns take no part.
An empty table gives no sequences.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, records

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length int, part int, nth long, ids binary"
RESULT = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


# ---------------------------------------------------------------- plan


@dataclass(frozen=True)
class Run:
    """Pieces of one length with ranks from `rank` on: `per` of them in each sequence from `sequence` on, at `offset`."""

    length: int
    rank: int
    count: int
    sequence: int
    per: int
    offset: int


@dataclass
class Bins:
    """Consecutive sequences that are filled alike."""

    first: int
    count: int
    used: int


class Plan:
    """Runs that place all pieces, given how many there are of each length."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left = capacity, {s: n for s, n in counts.items() if n > 0}
        self.placed: dict[int, int] = defaultdict(int)
        self.runs: list[Run] = []
        self.sequences = 0
        self.open: dict[int, list[Bins]] = defaultdict(list)  # room -> sequences
        self.rooms: list[int] = []  # in ascending order
        self.match_large()
        self.fit_small()

    def put(self, length: int, count: int, bins: Bins, per: int = 1) -> None:
        """Deal `count` pieces over the bins, `per` to each of them (the last may get fewer)."""
        self.runs.append(Run(length, self.placed[length], count, bins.first, per, bins.used))
        self.placed[length] += count
        self.left[length] -= count
        if not self.left[length]:
            del self.left[length]

    def new_bins(self, count: int) -> Bins:
        self.sequences += count
        return Bins(self.sequences - count, count, 0)

    def keep(self, bins: Bins) -> None:
        room = self.capacity - bins.used
        if bins.count and room:
            if not self.open[room]:
                insort(self.rooms, room)
            self.open[room].append(bins)

    def match_large(self) -> None:
        """Pairs of pieces above a third of the capacity, the longest first, each with the longest that fits."""
        large = sorted(s for s in self.left if 3 * s > self.capacity)
        while large:
            a = large[-1]
            k = bisect_left(large, self.capacity - a + 1) - 1
            b = large[k] if k >= 0 else None
            if b == a and self.left[a] == 1:
                b = large[k - 1] if k else None
            n = self.left[a] if b is None else self.left[a] // 2 if b == a else min(self.left[a], self.left[b])
            bins = self.new_bins(n)
            if b == a:
                self.put(a, 2 * n, bins, 2)
                bins.used = 2 * a
            else:
                self.put(a, n, bins)
                bins.used = a
                if b is not None:
                    self.put(b, n, bins)
                    bins.used += b
            self.keep(bins)
            large = [s for s in large if s in self.left]

    def fit_small(self) -> None:
        """The other pieces, from the longest down: the least room that holds one, filled with as many as it holds."""
        for s in sorted(self.left, reverse=True):
            while s in self.left:
                n = self.left[s]
                k = bisect_left(self.rooms, s)
                if k < len(self.rooms):
                    room = self.rooms[k]
                    bins = self.open[room].pop()
                    if not self.open[room]:
                        del self.rooms[k]
                else:
                    room = self.capacity
                    bins = self.new_bins(-(-n // (room // s)))
                per = room // s
                whole = min(bins.count, n // per)
                if whole:
                    self.keep(Bins(bins.first + whole, bins.count - whole, bins.used))
                    full = Bins(bins.first, whole, bins.used)
                    self.put(s, whole * per, full, per)
                    full.used += per * s
                    self.keep(full)
                else:  # fewer than one sequence takes
                    self.keep(Bins(bins.first + 1, bins.count - 1, bins.used))
                    one = Bins(bins.first, 1, bins.used)
                    self.put(s, n, one, n)
                    one.used += n * s
                    self.keep(one)

    def lookup(self) -> dict[int, np.ndarray]:
        """Of each length its runs in order of rank: rank, sequence, per, offset."""
        out = defaultdict(list)
        for r in self.runs:
            out[r.length].append((r.rank, r.sequence, r.per, r.offset))
        return {s: np.array(sorted(runs), np.int64) for s, runs in out.items()}


# ---------------------------------------------------------------- pieces


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int | None = 0, capacity: int = CAPACITY) -> DataFrame:
    """All pieces of documents (doc_id, text): PIECES, ids deflated; `nth` numbers those of one length in a task.

    The table is written: a task that runs again counts anew, and only one
    of its attempts is kept.
    """
    common.small_batches(docs.sparkSession)
    schema = common.arrow_schema(PIECES)

    def cut(batches):
        from pyspark import TaskContext

        from marginalia.llm.records import encoder

        part, seen, coder = TaskContext.get().partitionId(), defaultdict(int), encoder(tokenizer_path, end_id)
        for batch in batches:
            out, held = [], 0
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = coder.encode(text)
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    ids = np.frombuffer(raw[at : at + 4 * capacity], "<u4")
                    out.append((doc_id, k, k * capacity, len(ids), part, seen[len(ids)], records.pack(None, ids)))
                    seen[len(ids)] += 1
                    held += len(out[-1][-1])
                    if held > 8_000_000:
                        yield table(out)
                        out, held = [], 0
            if out:
                yield table(out)

    def table(out):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return common.materialize(rows.mapInArrow(cut, PIECES), "pieces")


def plan(cut: DataFrame, capacity: int = CAPACITY) -> Plan:
    """The plan for all pieces; the driver gets one count of each length."""
    counts = cut.groupBy("length").count()
    return Plan({r["length"]: r["count"] for r in counts.collect()}, capacity)


def placed(cut: DataFrame, made: Plan) -> DataFrame:
    """Pieces with sequence_id and offset."""
    by_part = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy("length", "part").count().select("length", "part", F.coalesce(F.sum("count").over(by_part), F.lit(0)).alias("first"))
    # written, so that its size is known and decides how it is joined
    starts = common.materialize(starts, "starts")
    ranked = cut.join(starts, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids", (F.col("first") + F.col("nth")).alias("rank"))
    runs = made.lookup()
    schema = "doc_id long, piece int, start long, length int, ids binary, sequence_id long, offset int"
    arrow = common.arrow_schema(schema)

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in (3, 5))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for s in np.unique(length):
                at = np.flatnonzero(length == s)
                found = runs[int(s)]
                run = found[np.searchsorted(found[:, 0], rank[at], side="right") - 1]
                nth = rank[at] - run[:, 0]
                sequence[at] = run[:, 1] + nth // run[:, 2]
                offset[at] = run[:, 3] + nth % run[:, 2] * s
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset.astype(np.int32))], schema=arrow)

    return ranked.mapInArrow(place, schema)


def sequences(pieces_placed: DataFrame) -> DataFrame:
    """sequence_id, length, pieces: those of each sequence by offset, (offset, doc_id, piece, start, length, ids), ids deflated.

    A sequence has no more pieces than its capacity.
    """
    struct = F.struct("offset", "doc_id", "piece", "start", "length", "ids")
    grouped = pieces_placed.groupBy("sequence_id").agg(F.sum("length").cast("int").alias("length"), F.sort_array(F.collect_list(struct)).alias("pieces"))
    return grouped.select("sequence_id", "length", "pieces")


def ids_of(parts: list) -> np.ndarray:
    """The ids of a sequence, given its pieces."""
    return np.concatenate([records.unpack(bytes(p["ids"]))[1] for p in parts])


def pack(docs: DataFrame, tokenizer_path: str, end_id: int | None = 0, capacity: int = CAPACITY) -> DataFrame:
    """Whole documents as few packed sequences, a written table."""
    cut = pieces(docs, tokenizer_path, end_id, capacity)
    table = common.materialize(sequences(placed(cut, plan(cut, capacity))), "sequences")
    common.discard(cut)
    return table


def contents(packed: DataFrame) -> DataFrame:
    """Every piece as it is read back from the packed sequences: RESULT."""
    schema = common.arrow_schema(RESULT)
    flat = packed.select("sequence_id", F.inline("pieces")).select("doc_id", "piece", "start", "sequence_id", F.col("offset").cast("long").alias("offset"), "ids")

    def read(batches):
        for batch in batches:
            own = [records.unpack(raw)[1] for raw in batch.column(5).to_pylist()]
            length, crc = pa.array([len(i) for i in own], pa.int64()), pa.array([zlib.crc32(i) for i in own], pa.int64())
            doc_id, piece, start, sequence, offset, _ = batch.columns
            yield pa.RecordBatch.from_arrays([doc_id, piece, start, length, crc, sequence, offset], schema=schema)

    return flat.mapInArrow(read, RESULT)
