"""Derived tables that are read several times: written to the shared folder and read back."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; a local session without one gets a temporary folder.

    On a cluster the setting must be there, as its machines do not share a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table: its lineage ends there and nothing stays in memory."""
    path, schema = folder(df.sparkSession, name), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def stored_by(df: DataFrame, name: str, key: str, parts: int | None = None, lies: bool = False) -> DataFrame:
    """``df`` as a written table in buckets of ``key``, each sorted by it: joins and groups by the key then need no shuffle.

    The rows are dealt by the key before, so a bucket is one file. Tables of one session
    have the same number of buckets, spark.sql.shuffle.partitions, and so fit together; large
    ones are given a number of their own, so that a bucket does not grow with the table.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex[:12]}".replace("-", "_")
    (df if lies else df.repartition(parts, key)).write.bucketBy(parts, key).sortBy(key).option("path", folder(spark, name)).format("parquet").saveAsTable(table)
    return spark.table(table)
