"""Append-only logs that tasks write while they work: JSON lines in files that belong to one writer each.

A record is on disk once append returns, where the file system shows what is written to an open file (local disks, HDFS); on object stores, once its
file is full or closed. A writer that dies leaves at most a torn last line, which readers skip. Folders are those of the shared storage, as paths or
URIs that Spark and Arrow both know.
"""

from __future__ import annotations

import json
import re
import threading
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def located(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, and its path there."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", folder))


class Journal:
    """A writer of its own files below folder; threads may share it."""

    def __init__(self, folder: str, rows_a_file: int = 1000):
        self.fs, self.folder = located(folder)
        self.rows_a_file, self.rows, self.stream, self.lock = rows_a_file, 0, None, threading.Lock()

    def append(self, **record) -> None:
        line = (json.dumps(record) + "\n").encode()
        with self.lock:
            if self.stream is None:
                self.fs.create_dir(self.folder, recursive=True)
                self.stream = self.fs.open_output_stream(f"{self.folder}/{uuid.uuid4().hex}.jsonl")
            self.stream.write(line)
            self.stream.flush()
            self.rows += 1
            if self.rows >= self.rows_a_file:
                self._end()

    def _end(self) -> None:
        if self.stream is not None:
            self.stream.close()
        self.stream, self.rows = None, 0

    def __enter__(self) -> Journal:
        return self

    def __exit__(self, *_) -> None:
        with self.lock:
            self._end()


def records(folder: str) -> Iterator[dict]:
    """The records of one folder, file by file; for a task's own share, or for logs with a row per task or batch."""
    system, root = located(folder)
    for f in sorted(system.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True)), key=lambda f: f.path):
        if f.type == fs.FileType.File and f.base_name.endswith(".jsonl"):
            with system.open_input_stream(f.path) as stream:
                for line in stream.read().split(b"\n"):
                    try:
                        yield json.loads(line)
                    except ValueError:  # torn, or the empty end
                        continue


def table(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All records below folder; none if there is no such folder. Torn lines have no row."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    rows = spark.read.schema(StructType.fromDDL(schema)).json(folder, recursiveFileLookup=True, pathGlobFilter="*.jsonl")
    return rows.where(F.coalesce(*[F.col(c).isNotNull() for c in rows.columns[:1]]))
