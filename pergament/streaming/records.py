"""Incremental form of the record pipeline: arriving files of card lines to validated records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pergament.functions import text as X
from pergament.operators import lines as L
from pergament.operators import quality as Q
from pergament.sources.scratch import stored

#: One arriving document: its key, arrival time and recognised lines in order.
ARRIVAL = "doc_id long, arrived timestamp, lines array<string>"


def records_of(arrivals: DataFrame) -> DataFrame:
    """Records of a bounded table of arrivals: T4, L10 and Q1, one row per document.

    Lines are dealt by document before they are judged, so that none is moved with its
    facts, and frequent lines are judged once. They are written, since they are passed over
    twice and a stream must be run once.
    """
    parts = int(arrivals.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # composed (in Python, whose rows have no known place) before they are dealt
    rows = arrivals.select("doc_id", F.posexplode("lines").alias("at", "line")).withColumn("line", X.nfkc("line"))
    lines = L.normalized(stored(rows, "arrivals").repartition(parts, "doc_id"), compose=False, once=True, facts=True)
    return Q.validate(L.extract_by_lines(lines.withColumnRenamed("at", "line_no")))


def stream_records(spark: SparkSession, landing: str, out: str, checkpoint: str, dedupe: str | None = None) -> StreamingQuery:
    """S6. Each micro-batch of JSON files in ``landing`` becomes validated records in ``out``.

    A document comes whole in one file, so no state is kept between batches; dedupe (a
    delay such as "1 hour") drops a doc_id that arrives again within that time. Each batch
    writes a folder of its own, so a repeated batch replaces its output.
    """
    arrivals = spark.readStream.schema(ARRIVAL).json(landing)
    if dedupe:
        arrivals = arrivals.withWatermark("arrived", dedupe).dropDuplicatesWithinWatermark(["doc_id"])

    def write(batch: DataFrame, number: int) -> None:
        records_of(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
