"""Length-delimited binary records of token ids.

One data file holds framed records in ascending order of the key:

    uint64 length | uint32 masked checksum of the length |
    payload       | uint32 masked checksum of the payload

A payload is one document: int64 doc_id, uint8 flags, uint32 number of ids,
then the ids, deflated.  Flag 1: no doc_id (null); flag 2: the ids are
uint32, else uint16, which every vocabulary of up to 65,536 ids fits.  All
integers are little-endian.  Checksums are CRC-32, masked by a rotation and a
constant so that a checksum of data that holds checksums stays useful.

Beside each data file stands an index of fixed-size entries (uint64 offset,
uint32 frame length, int64 doc_id, uint32 number of ids), so that records can
be read in any order without a scan.

Null texts count as empty; a document without ids still has its end id.
Repeated rows stay repeated records; equal keys are ordered by a hash of the
text.  An empty table gives no files and an empty result.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Formats of a frame's head, an index entry and a payload's head.
HEAD, ENTRY, META = "<QI", "<QIqI", "<qBI"
NO_ID, WIDE = 1, 2
MANIFEST = "part int, path string, docs long, tokens long"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def pack(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = len(ids) and int(ids.max()) > 0xFFFF
    flags = (NO_ID if doc_id is None else 0) | (WIDE if wide else 0)
    body = zlib.compress(ids.astype("<u4" if wide else "<u2").tobytes(), 1)
    return struct.pack(META, doc_id or 0, flags, len(ids)) + body


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, flags, n = struct.unpack_from(META, payload)
    ids = np.frombuffer(zlib.decompress(payload[struct.calcsize(META) :]), "<u4" if flags & WIDE else "<u2").astype("<u4")
    if len(ids) != n:
        raise ValueError(f"record of {doc_id}: {len(ids)} ids, {n} announced")
    return (None if flags & NO_ID else doc_id), ids


def read_frame(f) -> bytes | None:
    head = f.read(struct.calcsize(HEAD))
    if not head:
        return None
    length, check = struct.unpack(HEAD, head)
    if masked(head[:8]) != check:
        raise ValueError("damaged record length")
    payload, tail = f.read(length), f.read(4)
    if len(payload) != length or len(tail) != 4 or masked(payload) != struct.unpack("<I", tail)[0]:
        raise ValueError("damaged record")
    return payload


def records_of(uri: str) -> Iterator[tuple[int | None, np.ndarray]]:
    with common.open_stream(uri) as f:
        while (payload := read_frame(f)) is not None:
            yield unpack(payload)


def index_of(uri: str) -> np.ndarray:
    """Entries of a data file's index: offset, length, doc_id, n."""
    with common.open_stream(f"{uri}.index") as f:
        return np.frombuffer(f.read(), dtype=[("offset", "<u8"), ("length", "<u4"), ("doc_id", "<i8"), ("n", "<u4")])


def record_at(uri: str, offset: int) -> tuple[int | None, np.ndarray]:
    """One record by its offset: the unit of a shuffled read."""
    with common.open_stream(uri, int(offset)) as f:
        return unpack(read_frame(f))


def shuffled(uri: str, seed: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """All records of a file in a seeded random order, through the index."""
    for entry in np.random.default_rng(seed).permutation(index_of(uri)):
        yield record_at(uri, entry["offset"])


#: Texts of these characters alone are their own composed form, and their lower case goes letter by letter.
PLAIN = re.compile(r"[\t\n\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
#: Fixed value: the pattern of tokenizers that can be encoded word by word.
WORDS_KEPT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What it keeps of a lower-case plain text.
KEPT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00e0-\u00f6\u00f8-\u00ff\u00df]+|[0-9]|[^\sa-z\u00e0-\u00f6\u00f8-\u00ff\u00df0-9]+")
ENCODERS: dict = {}


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: visible Latin-1 bytes stand for themselves, the others for 256 and up in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Words(dict):
    """word -> ids as bytes, by the tokenizer's model, remembered up to a bound."""

    def __init__(self, model, bound: int):
        super().__init__()
        self.model, self.bound, self.letters = model, bound, byte_letters()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.bound:
            self.clear()
        letters = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
        ids = self[word] = np.array([t.id for t in self.model.tokenize(letters)], "<u4").tobytes()
        return ids


class Encoder:
    """Whole texts to ids.

    A tokenizer that lower-cases, then keeps only letters, single digits and
    runs of marks as byte-level words gives a text the ids of its words in
    order; each word of a plain text is encoded once by the tokenizer's model
    and remembered.  Texts with other characters or special tokens, and
    tokenizers of another make, are encoded whole.
    """

    def __init__(self, path: str, end_id: int | None, bound: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(Path(path).read_text())
        first, second = (made["normalizer"] or {}).get("normalizers", []), (made["pre_tokenizer"] or {}).get("pretokenizers", [])
        split = second[0] if second else {}
        self.by_word = [x["type"] for x in [*first, *second]] == ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"] and (split["behavior"], split["invert"], split["pattern"].get("Regex")) == ("Removed", True, WORDS_KEPT)
        self.end = b"" if end_id is None else struct.pack("<I", end_id)
        self.words = Words(self.tokenizer.model, bound)

    def encode(self, text: str) -> bytes:
        if self.by_word and "<|" not in text and PLAIN.fullmatch(text):
            return b"".join(map(self.words.__getitem__, KEPT.findall(text.lower()))) + self.end
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes() + self.end


def encoder(path: str, end_id: int | None) -> Encoder:
    """One encoder in each worker process."""
    if (path, end_id) not in ENCODERS:
        ENCODERS[path, end_id] = Encoder(path, end_id)
    return ENCODERS[path, end_id]


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int | None = 2) -> DataFrame:
    """Encode all documents and write them in ascending doc_id order.

    Returns the manifest, one row per file: part int, path string, docs long,
    tokens long.  Files are named by the task's attempt and only those of the
    committed manifest count, so that a task that ran twice does no harm.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("_h", F.xxhash64("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "_h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_h")

    schema = common.arrow_schema(MANIFEST)

    def put(batches):
        import uuid

        from pyspark import TaskContext

        from marginalia.llm.records import encoder

        part, coder, data, index = TaskContext.get().partitionId(), None, None, None
        n_docs = n_tokens = 0
        for batch in batches:
            for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if data is None:
                    coder = encoder(tokenizer_path, end_id)
                    path = f"{folder}/tokens-{part:06d}-{uuid.uuid4().hex[:8]}.bin"
                    data, index = common.AtomicFile(path), common.AtomicFile(f"{path}.index")
                ids = np.frombuffer(coder.encode(text), "<u4")
                framed = frame(pack(key, ids))
                index.write(struct.pack(ENTRY, data.at, len(framed), key or 0, len(ids)))
                data.write(framed)
                n_docs += 1
                n_tokens += len(ids)
        if data is not None:
            data.close()
            index.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "path": path, "docs": n_docs, "tokens": n_tokens}], schema)

    return common.materialize(rows.select("doc_id", "text").mapInArrow(put, MANIFEST), "manifest")


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record, read from the files.

    The manifest has one row per file, so its running sum is made on the
    driver; the files are read one to a task.
    """
    files, start = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r["part"]):
        files.append((r["path"], start))
        start += r["tokens"]
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("start", T.LongType())])
    if not files:
        return spark.createDataFrame([], RESULT)

    result = common.arrow_schema(RESULT)

    def get(batches):
        for batch in batches:
            for path, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = []
                for doc_id, ids in records_of(path):
                    out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
                    at += len(ids)
                    if len(out) >= 20_000:
                        yield table(out)
                        out = []
                if out:
                    yield table(out)

    def table(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), result.types, strict=True)], schema=result)

    rdd = spark.sparkContext.parallelize(files, len(files))
    return spark.createDataFrame(rdd, schema).mapInArrow(get, RESULT)


def tokenize_to_records(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int | None = 2) -> DataFrame:
    """Write documents (doc_id, text) as records in the shared folder and read them back."""
    return read(spark, write(docs, common.new_folder(spark, "records"), tokenizer_path, end_id))
