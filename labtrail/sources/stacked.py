"""A data source for exports with stacked headers: a title line, dates, laboratories, a spare line, then tests.

    spark.dataSource.register(StackedHeaders)
    cells = spark.read.format("stacked_headers").load(path)

Every file has columns of its own: its second line names their dates, its third
their laboratories, and data starts at the fifth.  A reader takes its files one
after another, reads the three lines that matter first, and streams the rest
into long cells, so a file of any length costs one batch of memory.  Files are
listed once; an input partition is one file, or several small ones up to
``partition_bytes``.  Cells may be quoted and hold line breaks.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CELLS = "Source_Filename string, Test_Category string, Test_Name string, Test_Date string, Lab_Name string, Result string, Reference_Range string"
NAMES = [c.split()[0] for c in CELLS.split(", ")]
PARTITION_BYTES = 64 << 20
BATCH = 10_000

# fixed values: what stands for nothing in a header, in a cell, and in a test's name
NO_DATE = {"", "nan", "col", "ranges"}
NO_RESULT = {"", "None", "nan"}
NO_NAME = {"", "nan", "test_name"}
NOTHING = {"", "nan"}


def _open(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), path


def list_files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of all files below a folder but hidden ones, in order."""
    from pyarrow import fs

    system, root = _open(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        return [(info.path, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = system.get_file_info(fs.FileSelector(root, recursive=True))
    hidden = lambda p: any(part[:1] in ("_", ".") for part in p[len(root):].split("/"))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not hidden(f.path))


class Columns:
    """What the headers of one file say: dated columns (place, date, laboratory) and the place of the ranges."""

    def __init__(self, dates: list[str], labs: list[str]):
        self.dated, self.ranges = [], None
        for i in range(2, len(dates)):
            date, lab = dates[i], labs[i] if i < len(labs) else ""
            if "reference" in date.lower() or "reference" in lab.lower():
                self.ranges = i if self.ranges is None else self.ranges
            elif date.lower() not in NO_DATE:
                self.dated.append((i, date, "Lab" if lab.lower() in NOTHING else lab))


def long_cells(lines: Iterator[list[str]], file_name: str) -> Iterator[tuple[str, ...]]:
    """The cells of one export, in the order of ``CELLS``; a file without headers has none."""
    columns, dates = None, []
    for number, line in enumerate(lines):
        line = [c.strip() for c in line]
        if number == 1:
            dates = line
        elif number == 2:
            columns = Columns(dates, line)
        elif number >= 4 and len(line) > 1 and line[1].lower() not in NO_NAME:
            at = lambda i: line[i] if i is not None and i < len(line) else ""
            ref = at(columns.ranges)
            for i, date, lab in columns.dated:
                if at(i) not in NO_RESULT:
                    yield file_name, line[0] or "General", line[1], date, lab, at(i), "N/A" if ref.lower() in NOTHING else ref


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class StackedReader(DataSourceReader):
    def __init__(self, path: str, partition_bytes: int):
        self.path, self.partition_bytes = path, partition_bytes

    def partitions(self) -> list[Files]:
        groups, size = [], 0
        for path, length in list_files(self.path):
            if not groups or size + length > self.partition_bytes:
                groups.append([])
                size = 0
            groups[-1].append(path)
            size += length
        return [Files(g) for g in groups]

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.string()) for n in NAMES])
        system, _ = _open(self.path)
        rows: list[tuple[str, ...]] = []
        for path in partition.paths if partition else []:
            with system.open_input_stream(path) as raw, io.TextIOWrapper(raw, "utf-8-sig", newline="") as text:
                for cell in long_cells(csv.reader(text), path.rsplit("/", 1)[-1]):
                    rows.append(cell)
                    if len(rows) >= BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], schema=schema)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], schema=schema)


class StackedHeaders(DataSource):
    """Options: ``path`` and ``partition_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "stacked_headers"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> StackedReader:
        return StackedReader(self.options["path"], int(self.options.get("partition_bytes", PARTITION_BYTES)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(StackedHeaders)
