"""Binary files that tasks write to and read from the shared folder."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else f"file:{uri}")


def task_file(folder: str, ending: str) -> str:
    """Name of a new file of the running task.

    No other attempt of the task has the same, so a repeated or doubled attempt never
    touches what another wrote; readers take the names from the rows that Spark kept.
    """
    context = TaskContext.get()
    part = context.partitionId() if context else 0
    return f"{folder}/part-{part:06d}-{uuid.uuid4().hex}{ending}"


def create(uri: str) -> pa.NativeFile:
    store, path = _at(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path, compression=None)


def reader(uri: str) -> pa.NativeFile:
    store, path = _at(uri)
    return store.open_input_file(path)
