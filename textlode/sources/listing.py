"""Every regular file below a directory, as a Spark data source.

Spark's own file sources leave out names that start with ``_`` or ``.`` and files without
content.  This one plans one partition for each set of directories: the driver looks only
at the upper levels of the tree, tasks walk the rest and send paths and lengths.  Contents are
read after these were dealt out by path, so a flat directory is read by many tasks.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from textlode.plans.sizing import TEXT_PARTITION_BYTES
from textlode.plans.storage import stored

FORMAT = "every_file"
SCHEMA = "path STRING, length BIGINT"
#: Directories that the driver looks for before it deals them to tasks.
FRONTIER = 256
PARTITIONS = 64
#: Rows of a listing, and bytes of contents, that a task sends together.
BATCH_ROWS = 10_000
BATCH_BYTES = 8 * 1024 * 1024
#: Longer files do not fit a binary value.
MOST_BYTES = 2**31 - 1_024


@dataclass
class Directories(InputPartition):
    """Directories listed with all below them, and those of which only files are."""

    whole: tuple[str, ...]
    own_files: tuple[str, ...]


class EveryFile(DataSource):
    """``spark.read.format("every_file").load(directory)``: (path, length)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return EveryFileReader(self.options["path"])


class EveryFileReader(DataSourceReader):
    def __init__(self, directory: str):
        self.directory = directory

    def partitions(self) -> list[InputPartition]:
        level, looked_at = [_absolute(self.directory)], []
        while level and len(level) < FRONTIER:
            looked_at += level
            level = [path for folder in level for path, _, is_file in _entries(folder) if not is_file]
        parts = [
            Directories(tuple(level[i::PARTITIONS]), tuple(looked_at[i::PARTITIONS]))
            for i in range(PARTITIONS)
        ]
        return [p for p in parts if p.whole or p.own_files]

    def read(self, partition: Directories) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("length", pa.int64())])
        rows: list[tuple[str, int]] = []
        for row in _files(partition):
            rows.append(row)
            if len(rows) == BATCH_ROWS:
                yield pa.record_batch(list(map(list, zip(*rows, strict=True))), schema=schema)
                rows = []
        if rows:
            yield pa.record_batch(list(map(list, zip(*rows, strict=True))), schema=schema)


def _files(partition: Directories) -> Iterator[tuple[str, int]]:
    for folder in partition.own_files:
        yield from ((path, length) for path, length, is_file in _entries(folder) if is_file)
    waiting = list(partition.whole)
    while waiting:
        for path, length, is_file in _entries(waiting.pop()):
            if is_file:
                yield path, length
            else:
                waiting.append(path)


def _is_local(path: str) -> bool:
    return urlsplit(path).scheme in ("", "file")


def _absolute(path: str) -> str:
    """Local paths without scheme, others as given."""
    if not _is_local(path):
        return path.rstrip("/")
    return os.path.abspath(unquote(urlsplit(path).path) if path.startswith("file:") else path)


def _entries(folder: str) -> Iterator[tuple[str, int, bool]]:
    """(path, length, whether a file) of the regular files and directories of a directory.

    Links and special files are neither, so no link leads out of the tree or round in it.
    """
    if _is_local(folder):
        with os.scandir(folder) as found:
            for entry in found:
                if entry.is_file(follow_symlinks=False):
                    yield entry.path, entry.stat(follow_symlinks=False).st_size, True
                elif entry.is_dir(follow_symlinks=False):
                    yield entry.path, 0, False
        return
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder)
    prefix = folder[: len(folder) - len(root)]
    for info in system.get_file_info(fs.FileSelector(root)):
        if info.type in (fs.FileType.File, fs.FileType.Directory):
            yield prefix + info.path, info.size or 0, info.type == fs.FileType.File


def _content(path: str) -> bytes | None:
    """Null where the file cannot be read or is gone by now."""
    try:
        if _is_local(path):
            with open(path, "rb") as file:
                return file.read()
        from pyarrow import fs

        system, name = fs.FileSystem.from_uri(path)
        with system.open_input_stream(name) as file:
            return file.read()
    except OSError:
        return None


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("path", pa.string()), ("content", pa.binary())])
    paths: list[str] = []
    contents: list[bytes | None] = []
    held = 0
    for batch in batches:
        for path, length in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if paths and held + length > BATCH_BYTES:
                yield pa.record_batch([paths, contents], schema=schema)
                paths, contents, held = [], [], 0
            paths.append(path)
            contents.append(_content(path) if length <= MOST_BYTES else None)
            held += length
    if paths:
        yield pa.record_batch([paths, contents], schema=schema)


def list_files(spark: SparkSession, directory: str) -> DataFrame:
    """(path, length) of every regular file below a directory, which has to exist."""
    spark.dataSource.register(EveryFile)
    return spark.read.format(FORMAT).load(directory)


def read_files(spark: SparkSession, directory: str) -> DataFrame:
    """(path, content) of every regular file; content is null where it cannot be read.

    The listing is stored once, so the files that are read are those that were counted.
    """
    files = stored(list_files(spark, directory), "listing")
    total = files.agg(F.sum("length")).head()[0] or 0
    width = max(2 * spark.sparkContext.defaultParallelism, -(-total // TEXT_PARTITION_BYTES))
    dealt = files.repartition(int(width), "path")
    return dealt.mapInArrow(_contents, "path STRING, content BINARY")
