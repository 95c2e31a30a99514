"""File source: listings that hold empty files too, small files packed into tasks, byte ranges of large texts.

``list_files`` is a Python data source: the driver lists the first levels of folders, each
task walks the folders it is given. Contents are read by tasks that get a share of the
listing by bytes and number, so a million small files are few tasks, and a large text file
is many. Paths are any that pyarrow's file systems open (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LISTING = "path string, length long, modified timestamp"
FOLDERS = 64  # folders from which on the driver stops looking deeper
TASK_BYTES, TASK_FILES = 64 << 20, 10_000
RANGE_BYTES = 32 << 20


def file_system(path: str) -> tuple[pafs.FileSystem, str, str]:
    """File system, inner path, and what to put before an inner path for a whole one."""
    if not re.match(r"^[a-z][a-z0-9+.-]*:", path):
        path = "file://" + path
    path = re.sub(r"^file:/(?!/)", "file:///", path)
    fs, inner = pafs.FileSystem.from_uri(path)
    scheme = path.split(":", 1)[0]
    host = path.split("://", 1)[1].split("/", 1)[0] if scheme not in ("file", "s3", "gs") else ""
    return fs, inner, "" if scheme == "file" else f"{scheme}://{host}"


class Folder(InputPartition):
    """A folder to walk, or (deep=False) only its own files."""

    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class FolderReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[Folder]:
        """Folders level by level until there are FOLDERS of them; each one above gives its own files."""
        fs, inner, _ = file_system(self.root)
        above, level = [], [inner]
        while level and len(level) < FOLDERS:
            below = [e.path for p in level for e in fs.get_file_info(pafs.FileSelector(p)) if e.type == pafs.FileType.Directory]
            above, level = above + level, below
        return [Folder(p, False) for p in above] + [Folder(p, True) for p in level]

    def read(self, partition: Folder) -> Iterator[tuple]:
        fs, _, start = file_system(self.root)
        waiting = [partition.path]
        while waiting:
            for e in fs.get_file_info(pafs.FileSelector(waiting.pop(), allow_not_found=True)):
                if e.type == pafs.FileType.File:
                    yield start + e.path, e.size, e.mtime or datetime.fromtimestamp(0, timezone.utc)
                elif e.type == pafs.FileType.Directory and partition.deep:
                    waiting.append(e.path)


class FileListing(DataSource):
    """spark.read.format("file_listing").load(folder): path, length and time of every file below it, empty ones too."""

    @classmethod
    def name(cls) -> str:
        return "file_listing"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> FolderReader:
        if not self.options.get("path"):
            raise ValueError("file_listing needs a folder")
        return FolderReader(self.options["path"])


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modified) of every file below a folder."""
    spark.dataSource.register(FileListing)
    return spark.read.format("file_listing").load(path)


def shared_out(files: DataFrame, size: str) -> DataFrame:
    """Rows dealt into as many tasks as their bytes and their number ask for."""
    n, total = files.agg(F.count("*"), F.sum(size)).first()
    return files.repartition(max(1, -(-(total or 0) // TASK_BYTES), -(-n // TASK_FILES)))


def read_whole(files: DataFrame) -> DataFrame:
    """(path, length, content) of listed files, one row a file; an empty file has an empty content.

    A file that is gone, or cannot be read, has a null content.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    fs, inner, _ = file_system(path)
                    with fs.open_input_stream(inner, compression=None) as stream:
                        content = stream.read()
                except OSError:
                    content = None
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([length], pa.int64()), pa.array([content], pa.binary())], names=["path", "length", "content"])

    return shared_out(files.select("path", "length"), "length").mapInArrow(run, "path string, length long, content binary")


def read_lines(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, offset, line) of listed files, as bytes: lines end at a newline, which is left out, as is a carriage return before it.

    A file is read in byte ranges by different tasks; a line belongs to the range in which it
    begins. offset is where it begins in the file, so (path, offset) orders the lines. An
    empty file has none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                fs, inner, _ = file_system(path)
                with fs.open_input_file(inner) as stream:
                    yield from lines_between(stream, path, start, end)

    starts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))
    ranges = files.where("length > 0").select("path", "length", F.explode(starts).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + range_bytes, "length").alias("end"))
    return shared_out(ranges.withColumn("bytes", F.col("end") - F.col("start")), "bytes").drop("bytes").mapInArrow(run, "path string, offset long, line binary")


def lines_between(stream, path: str, start: int, end: int, piece: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of the lines that begin in [start, end): the first is looked for behind a newline, the last is read to its end."""
    at = max(start - 1, 0)
    stream.seek(at)
    held, skipping = b"", start > 0
    while True:
        data = stream.read(piece)
        held += data
        if skipping:
            k = held.find(b"\n")
            if k < 0:
                at, held = at + len(held), b""
                if not data or at >= end:
                    return
                continue
            at, held, skipping = at + k + 1, held[k + 1 :], False
        offsets, lines = [], []
        pieces = held.split(b"\n")
        if data:
            held = pieces.pop()
        elif not pieces[-1]:
            pieces.pop()  # the file ends with a newline
        for line in pieces:
            if at >= end:
                break
            offsets.append(at)
            lines.append(line.removesuffix(b"\r"))
            at += len(line) + 1
        if lines:
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(lines), pa.string()), pa.array(offsets, pa.int64()), pa.array(lines, pa.binary())], names=["path", "offset", "line"])
        if not data or at >= end:
            return
