"""Sharding by jump consistent hashing.

A stable 64-bit key walks through the shard counts at which it would move; the last stop
below the wanted count is its shard. No ring table is kept, and with one shard more a key
either stays or moves into the new shard. Slots number the rows of a shard without gaps:
each scan partition numbers its own rows, and the partitions' counts, one row per
partition and shard, give the offsets. No shard passes through one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pergament.llm import common

# Fixed value: multiplier of the published generator.
STEP = np.uint64(2862933555777941757)
NULL_KEY = (1 << 64) - 1


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    out = np.zeros(len(keys), dtype=np.int64)
    key, at = keys.astype(np.uint64), np.arange(len(keys))
    stop = np.zeros(len(keys), dtype=np.int64)
    while len(at):
        out[at] = stop
        with np.errstate(over="ignore"):
            key = key * STEP + np.uint64(1)
        draw = (key >> np.uint64(33)).astype(np.float64) + 1.0
        stop = ((stop + 1) * (float(1 << 31) / draw)).astype(np.int64)
        on = stop < shards
        at, key, stop = at[on], key[on], stop[on]
    return out


def assign(docs: DataFrame, shards: int = 40) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``key``: doc_id and the shard count decide, equal texts under different ids
    may go apart. size is the text's UTF-8 bytes plus 16 (null text: 16, CRC of nothing).
    A null doc_id has a key of its own; rows that repeat a doc_id share its shard and get
    slots of their own. Slots follow the order of the scan. Empty table: no rows. Extra
    columns are ignored.
    """
    data = F.coalesce(F.col("text").cast("string"), F.lit(""))
    light = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(data) + 16).cast("long").alias("size"), F.crc32(data.cast("binary")).alias("text_crc32"), F.spark_partition_id().alias("part"))
    schema = "doc_id long, size long, text_crc32 long, part int, shard int, grown_shard int, own_slot long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = np.zeros(shards, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.array([NULL_KEY if k is None else k & NULL_KEY for k in batch.column(0).to_pylist()], dtype=np.uint64)
            shard, grown = jump(keys, shards), jump(keys, shards + 1)
            order = np.argsort(shard, kind="stable")
            counts = np.bincount(shard, minlength=shards)
            slot = np.empty(len(shard), dtype=np.int64)
            slot[order] = np.arange(len(shard)) - np.repeat(np.cumsum(counts) - counts, counts)
            slot += used[shard]
            used += counts
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard, pa.int32()), pa.array(grown, pa.int32()), pa.array(slot)], names=[x.split(" ")[0] for x in schema.split(", ")])

    placed = common.save(light.mapInArrow(run, schema), "shards")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("part", "shard").count().select("part", "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    joined = placed.hint("merge").join(offsets.hint("merge"), ["part", "shard"])
    return joined.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("own_slot") + F.col("offset")).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 40) -> None:
    """Write ``docs`` with a shard column, one folder per shard; a map over the scan, no shuffle.

    A column of the caller's named shard gets underscores behind it until no other has its
    name. Null doc_ids have a shard of their own number; repeated rows, null, empty and very
    long texts are written as they are; an empty table writes no folder.
    """
    docs = docs.withColumnRenamed("shard", common.fresh(docs, "shard_"))

    @F.pandas_udf("int")
    def shard(ids):
        keys = [NULL_KEY if k is None else int(k) & NULL_KEY for k in ids]
        return pd.Series(jump(np.array(keys, dtype=np.uint64), shards))

    docs.withColumn("shard", shard(F.col("doc_id").cast("string"))).write.partitionBy("shard").parquet(path)
