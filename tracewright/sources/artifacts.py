"""A sink that writes a tree of text files, one a row, with a commit.

Tasks write to a folder of their attempt below `_attempts` in the target; when all have ended, the files are moved to their places. If the job
fails the attempts are deleted, and no file of it is seen. What failed attempts left goes with those of the job.
"""

from __future__ import annotations

import json
import posixpath
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from tracewright.functions.journal import located

ATTEMPTS = "_attempts"
#: The list of an attempt's paths, by number of file.
PATHS = "paths.json"
#: Files that are moved at once, and tries to delete.
MOVERS, TRIES = 32, 6


@dataclass
class Attempt(WriterCommitMessage):
    folder: str
    files: int


def safe(path: str) -> str:
    """A relative path of the parts of path; parts that would lead elsewhere are replaced by a hyphen."""
    return "/".join("-" if part in ("", ".", "..") else part for part in path.split("/"))


class ArtifactWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite, self.job = folder, overwrite, uuid.uuid4().hex
        system, root = located(folder)
        system.create_dir(f"{root}/{ATTEMPTS}/{self.job}", recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        """Files by number, and a list of their paths. No folder above the attempt's is made: once the job is given up, a task that still runs fails."""
        system, root = located(self.folder)
        own, paths = f"{root}/{ATTEMPTS}/{self.job}/{uuid.uuid4().hex}", []
        for batch in iterator:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if not paths:
                    system.create_dir(own, recursive=False)
                with system.open_output_stream(f"{own}/{len(paths)}") as out:
                    out.write((text or "").encode())
                paths.append(safe(path))
        if paths:
            with system.open_output_stream(f"{own}/{PATHS}") as out:
                out.write(json.dumps(paths).encode())
        return Attempt(own, len(paths))

    def commit(self, messages: list[Attempt | None]) -> None:
        system, root = located(self.folder)
        if self.overwrite:
            for x in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if x.base_name != ATTEMPTS:
                    system.delete_dir(x.path) if x.type == fs.FileType.Directory else system.delete_file(x.path)

        def move(pair: tuple[str, str]) -> None:
            system.create_dir(posixpath.dirname(pair[1]), recursive=True)
            system.move(*pair)

        with ThreadPoolExecutor(MOVERS) as pool:
            for m in messages:
                if m is not None and m.files:
                    with system.open_input_stream(f"{m.folder}/{PATHS}") as listed:
                        places = json.loads(listed.read())
                    list(pool.map(move, [(f"{m.folder}/{i}", f"{root}/{path}") for i, path in enumerate(places)]))
        self._clear()

    def abort(self, messages: list[Attempt | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """Delete this job's attempts, and their folder if no other job has any. Tasks that are being ended may still add a file meanwhile."""
        system, root = located(self.folder)
        top = f"{root}/{ATTEMPTS}"
        for again in range(TRIES):
            try:
                if system.get_file_info(f"{top}/{self.job}").type == fs.FileType.Directory:
                    system.delete_dir(f"{top}/{self.job}")
                break
            except OSError:
                if again + 1 == TRIES:
                    raise
                time.sleep(0.1 * 2**again)
        if system.get_file_info(top).type == fs.FileType.Directory and not system.get_file_info(fs.FileSelector(top)):
            system.delete_dir(top)


class ArtifactSource(DataSource):
    """Options: folder. Rows: path, relative to it, and text; a null text is an empty file."""

    @classmethod
    def name(cls) -> str:
        return "artifacts"

    def schema(self) -> str:
        return "path string, text string"

    def writer(self, schema: StructType, overwrite: bool) -> ArtifactWriter:
        return ArtifactWriter(self.options["folder"], overwrite)
