"""Files in the shared folder, written and range-read by executors through pyarrow's file systems (file, hdfs, s3, gs)."""

from __future__ import annotations

from pyarrow import fs


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def create(uri: str):
    """An output stream; missing folders are made. A task that runs again writes under another name, so nothing half-written is ever read."""
    system, path = _open(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path)


def reader(uri: str):
    """A random-access file."""
    system, path = _open(uri)
    return system.open_input_file(path)


def task_name() -> str:
    """A name that no other attempt of any task takes."""
    from pyspark import TaskContext

    t = TaskContext.get()
    return f"{t.partitionId():06d}-{t.taskAttemptId()}"
