"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Rows of one Arrow batch.  Texts can be long, so batches are kept small.
BATCH_ROWS = 2_000

MASK64 = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; our own only where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base is None:
        base = spark.sparkContext.getCheckpointDir()
    if base is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "marginalia-checkpoints")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder, which survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, tag)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.folder = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for table in tables:
        fs, path = filesystem(table.folder)
        fs.delete_dir(path)


def threshold(share: float) -> int:
    """The signed 64-bit hash below which the given share of hashes lies."""
    return min((1 << 63) - 1, int(share * 2.0**64) - (1 << 63))


def arrow_schema(ddl: str):
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(ddl))


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Python workers on tables of long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


# ---------------------------------------------------------------- files


def filesystem(uri: str):
    """(pyarrow file system, path) of a folder or file in shared storage."""
    from pyarrow import fs

    if re.match(r"file:/", uri):
        return fs.LocalFileSystem(), re.sub(r"^file:(//)?", "", uri)
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


class AtomicFile:
    """A file that appears under its name only when it was written whole."""

    def __init__(self, uri: str):
        self.fs, self.path = filesystem(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.tmp = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.tmp)
        self.at = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.tmp, self.path)

    def abort(self) -> None:
        self.out.close()
        self.fs.delete_file(self.tmp)


def open_stream(uri: str, offset: int = 0):
    fs, path = filesystem(uri)
    f = fs.open_input_file(path)
    if offset:
        f.seek(offset)
    return f


# ---------------------------------------------------------------- hashes


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers, the same on every machine."""
    with np.errstate(over="ignore"):
        base = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
        return mix64(base) | np.uint64(1)


class WordHashes(dict):
    """word -> unsigned 64-bit hash, remembered up to a bound."""

    def __init__(self, bound: int = 200_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: str) -> int:
        if len(self) >= self.bound:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


WORD = re.compile(r"\w+")


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Distinct, sorted hashes of the n-word shingles; a shorter text is one shingle."""
    if not len(words):
        return np.empty(0, np.uint64)
    k = min(n, len(words))
    with np.errstate(over="ignore"):
        c = constants(n, 17)
        m = len(words) - k + 1
        h = words[:m] * c[0]
        for j in range(1, k):
            h = h + words[j : j + m] * c[j]
        return np.unique(mix64(h + np.uint64(k)))


def text_batches(frames: Iterator, column: str = "text") -> Iterator:
    """Pandas batches cut so that one holds at most some millions of characters."""
    for pdf in frames:
        if not len(pdf):
            continue
        sizes = pdf[column].str.len().fillna(0).to_numpy().cumsum()
        start = 0
        while start < len(pdf):
            base = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, base + 4_000_000, side="right")))
            yield pdf.iloc[start:end]
            start = end


def strings(values) -> list[str]:
    """Column values as texts, null as the empty text."""
    return [v if isinstance(v, str) else "" for v in values]


def columns(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that clashing extra columns never reach an operator."""
    return df.select(*names)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind as it takes to differ from all columns of the table."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def crc_is_held_out(doc_id_text: str) -> str:
    """SQL of the fixed fold: crc32 of the id as text, modulo 4, is 2."""
    return f"crc32(cast({doc_id_text} AS string)) % 4 = 2"


def map_text(df: DataFrame, keep: list[str], function, added: str, text: str = "text", most_chars: int = 4_000_000, also: str | None = None) -> DataFrame:
    """The columns of `keep` as they are, and columns that `function` makes of whole texts.

    function: list of texts (null: empty), and of those of the column `also`
    if there is one -> one list or array for each column of `added`, a DDL
    string.  Kept columns stay in Arrow, so that ids and nulls come through
    unchanged.  Few characters are handled at a time.
    """
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(df.sparkSession)
    more = [df[also].alias("__also")] if also else []
    rows = df.select(*keep, df[text].alias("__text"), *more)
    n_keep = len(keep)
    new = T.StructType.fromDDL(added)
    schema = T.StructType([*rows.schema.fields[:n_keep], *new.fields])
    arrow_new = to_arrow_schema(new)

    def run(batches):
        for batch in batches:
            columns = [strings(c.to_pylist()) for c in batch.columns[n_keep:]]
            texts = columns[0]
            start = 0
            while start < len(texts):
                end, size = start, 0
                while end < len(texts) and (end == start or size + len(texts[end]) <= most_chars):
                    size += len(texts[end])
                    end += 1
                part = batch.slice(start, end - start)
                made = function(*[c[start:end] for c in columns])
                arrays = [*part.columns[:n_keep], *[pa.array(m, type=f.type, from_pandas=False) for m, f in zip(made, arrow_new, strict=True)]]
                yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:n_keep], *arrow_new.names])
                start = end

    return rows.mapInArrow(run, schema)
