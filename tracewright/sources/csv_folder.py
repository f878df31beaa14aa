"""A source of CSV files that have a header each: one scan, whatever the number of files and headers, that reads each file once.

A partition is a large file or a group of small ones. Its task maps a file's header to the wanted columns; a file whose header lacks one has no
rows. Cells may span lines, so a file is not split; it is streamed, and a task holds a batch of rows.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tracewright.functions.journal import located

#: Bytes of files that one partition reads, and rows and characters of a batch.
GROUP_BYTES, BATCH_ROWS, BATCH_CHARS = 32 << 20, 2000, 8 << 20


@dataclass
class Files(InputPartition):
    paths: list[str]


def header(cells: list[str]) -> list[str]:
    """Names of columns: stripped; cells without a name, and further ones of a name, have their place as name."""
    names = [c.strip() for c in cells]
    return [c if c and c not in names[:i] else f"_c{i}" for i, c in enumerate(names)]


class CsvFolderReader(DataSourceReader):
    def __init__(self, folder: str, columns: list[str]):
        self.folder, self.columns = folder, columns

    def partitions(self) -> list[Files]:
        system, root = located(self.folder)
        found = system.get_file_info(fs.FileSelector(root))
        named = sorted((x.path, x.size or 0) for x in found if x.type == fs.FileType.File and x.base_name.endswith(".csv") and x.base_name[0] not in "._")
        groups, size = [], GROUP_BYTES
        for path, more in named:
            if size + more > GROUP_BYTES:
                groups.append([])
                size = 0
            groups[-1].append(path)
            size += more
        return [Files(g) for g in groups] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = located(self.folder)
        csv.field_size_limit((1 << 31) - 1)
        names = ["service_name", "seq", *(f"c{i}" for i in range(len(self.columns)))]
        kinds = [pa.string(), pa.int64(), *[pa.string()] * len(self.columns)]
        made, chars = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names=names)

        for path in partition.paths:
            stem = path.rpartition("/")[2].rpartition(".")[0]
            with system.open_input_stream(path) as raw:
                rows = csv.reader(io.TextIOWrapper(raw, encoding="utf-8-sig", newline=""))
                places = {c: i for i, c in enumerate(header(next(rows, [])))}
                if not set(self.columns) <= places.keys():
                    continue
                wanted, seq = [places[c] for c in self.columns], 0
                for row in rows:
                    if not row:
                        continue
                    made.append((stem, seq, *(row[i] if i < len(row) else "" for i in wanted)))
                    seq, chars = seq + 1, chars + sum(map(len, row))
                    if len(made) >= BATCH_ROWS or chars >= BATCH_CHARS:
                        yield batch()
                        made, chars = [], 0
        if made:
            yield batch()


class CsvFolderSource(DataSource):
    """Options: folder; columns, a JSON list of names. Rows: service_name (the file's name without its last extension), seq (the row's place
    in its file, from 0) and c0, c1, … (the columns, as text; empty where a row is short)."""

    @classmethod
    def name(cls) -> str:
        return "csv_folder"

    def _columns(self) -> list[str]:
        return json.loads(self.options["columns"])

    def schema(self) -> str:
        return "service_name string, seq long, " + ", ".join(f"c{i} string" for i in range(len(self._columns())))

    def reader(self, schema: StructType) -> CsvFolderReader:
        return CsvFolderReader(self.options["folder"], self._columns())
