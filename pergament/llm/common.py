"""Shared folder, written tables and atomic file output for the training-data operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir of the session.

    Where that is unset, a local session (tests) gets a temporary folder, once; on a cluster,
    whose machines do not share such a folder, it raises ValueError.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(_own_dirs[app])
    return _own_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def save(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(schema).parquet(path)


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and inner path of a URI or local path, usable in any task."""
    if "://" not in path:
        path = "file://" + (path[5:] if path.startswith("file:") else os.path.abspath(path))
    return pafs.FileSystem.from_uri(path)


def write_atomic(folder: str, name: str, chunks) -> int:
    """Write byte chunks to ``folder/name``; the file appears whole or not at all.

    A retried or speculative task writes the same bytes under the same final name.
    """
    fs, inner = open_fs(folder)
    fs.create_dir(inner, recursive=True)
    temp, size = f"{inner}/.{name}.{uuid.uuid4().hex}", 0
    with fs.open_output_stream(temp, compression=None) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    fs.move(temp, f"{inner}/{name}")
    return size


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1,000 rows and 32 MB for this session: texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def need(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, cast; clashing extra columns of the caller stay out of the work."""
    bound_batches(df.sparkSession)
    return df.select(*(df[c].cast(t).alias(c) for c, t in columns.items()))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` with the number of each row in its scan, and that column's name.

    Another scan may be split otherwise and number the rows anew (splits depend on the
    cores at planning): to come back to the rows, use ``save_numbered``.
    """
    bound_batches(df.sparkSession)
    name = fresh(df, "__row")
    return df.withColumn(name, F.monotonically_increasing_id()), name


def save_numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written with the number of each row, and that column's name.

    The numbers are read from the table, so they hold for every later scan, however it is split.
    """
    rows, name = numbered(df)
    return save(rows, "numbered"), name


#: Rows of a written table that is broadcast rather than shuffled to; two numbers a row, some 10 MB.
FEW_ROWS = 100_000


def join_written(rows: DataFrame, table: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with a written table of row numbers.

    Up to FEW_ROWS rows, counted in the files, are broadcast, so that long texts stay where
    they are; beyond that both sides are sorted and merged.
    """
    few = table.count() <= FEW_ROWS
    hinted = F.broadcast(table) if few else table.hint("merge")
    return (rows if few else rows.hint("merge")).join(hinted, on, how)


def without_rows(rows: DataFrame, name: str, dropped: DataFrame) -> DataFrame:
    """Rows of ``save_numbered`` without those whose number is in ``dropped`` (row)."""
    gone = save(dropped.select(F.col("row").alias(name)), "dropped")
    return join_written(rows, gone, name, "left_anti").drop(name)
