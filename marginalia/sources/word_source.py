"""Word files as a data source of Spark: spark.read.format("word").option("what", "comments").load(folder).

The driver lists names and sizes; files are opened and parsed by the tasks.
"""

from __future__ import annotations

import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import batches

#: Bytes and files of a partition; a file larger than that is a partition of its own.
PARTITION_BYTES, PARTITION_FILES = 64 << 20, 500
#: Rows of a batch that is handed to Spark.
BATCH_ROWS = 1000


@dataclass
class Files(InputPartition):
    paths: list[str]


def listed(path: str) -> list[tuple[str, int]]:
    """Names and sizes of the .docx files at or below an address, in order of names; what begins with ~$ is an editor's lock."""
    system, at = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
    names = [(f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name.lower().endswith(".docx") and not f.base_name.startswith("~$")]
    return sorted(names)


def packed(files: list[tuple[str, int]], most_bytes: int = PARTITION_BYTES, most_files: int = PARTITION_FILES) -> list[Files]:
    """Files in their order, as many to a partition as fit."""
    out, own, size = [], [], 0
    for path, n in files:
        if own and (size + n > most_bytes or len(own) == most_files):
            out.append(Files(own))
            own, size = [], 0
        own.append(path)
        size += n
    return [*out, Files(own)] if own else out


class WordReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options):
        if not options.get("path"):
            raise ValueError("word: a path is needed")
        self.own = schema
        self.path, self.what = options["path"], options.get("what", "comments")
        self.failing = options.get("mode", "PERMISSIVE").upper() == "FAILFAST"
        self.bytes, self.files = int(options.get("partitionBytes", PARTITION_BYTES)), int(options.get("partitionFiles", PARTITION_FILES))

    def partitions(self) -> list[Files]:
        return packed(listed(self.path), self.bytes, self.files)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from marginalia.sources.docx import READERS, Opened, is_word

        system = fs.FileSystem.from_uri(self.path)[0] if ":/" in self.path else fs.LocalFileSystem()
        arrow, rows = to_arrow_schema(self.own), []
        for path in partition.paths:
            with system.open_input_stream(path) as f:
                data = Opened(f.read())
            try:
                if not is_word(data) and self.what != "is_word":
                    raise ValueError("not a Word document")
                found = [{"path": path, "error": None} | r for r in READERS[self.what][0](data)]
            except (KeyError, ValueError, zipfile.BadZipFile, zlib.error, ET.ParseError) as e:
                if self.failing:
                    raise
                found = [{"path": path, "error": f"{type(e).__name__}: {e}"}]
            for row in found:
                rows.append(row)
                if len(rows) == BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, arrow)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, arrow)


class WordSource(DataSource):
    """Options: what (a key of docx.READERS), mode (PERMISSIVE: a file that can't be read is a row with an error; FAILFAST), partitionBytes, partitionFiles."""

    @classmethod
    def name(cls) -> str:
        return "word"

    def schema(self) -> str:
        from marginalia.sources.docx import READERS

        what = self.options.get("what", "comments")
        if what not in READERS:
            raise ValueError(f"word: what is one of {', '.join(READERS)}, not {what}")
        return f"path string, error string, {READERS[what][1]}"

    def reader(self, schema: T.StructType) -> WordReader:
        return WordReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WordSource)


def written(files: DataFrame, folder: str) -> int:
    """The documents (path, content) as files of a folder, each by a name of its own that appears whole; their number."""

    def put(parts):
        system, at = fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)
        system.create_dir(at, recursive=True)
        for batch in parts:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                # a task that is run again, or beside another, writes the same bytes
                part, whole = f"{at}/.{path}.{uuid.uuid4().hex}", f"{at}/{path}"
                with system.open_output_stream(part) as f:
                    f.write(content)
                try:
                    system.move(part, whole)
                except OSError:
                    if system.get_file_info(whole).type != fs.FileType.File:
                        raise
                    system.delete_file(part)
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    batches.small(files.sparkSession)
    return files.select("path", "content").mapInArrow(put, "n long").groupBy().sum("n").first()[0] or 0  # a row for each batch, none of an empty table
