"""Documents whose lines arrive in several files: keyed state until they are whole."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pergament.streaming.records import records_of

#: One arriving part: its document, time, place among the document's parts, their number where it is known, and its lines.
PART = "doc_id long, arrived timestamp, part int, parts int, lines array<string>"
GATHERED = "doc_id long, arrived timestamp, part int, lines array<string>, outcome string"
HELD = "documents array<struct<doc_id:bigint,due:bigint,parts:int,last:bigint,numbers:array<int>,lines:array<array<string>>,closed:boolean>>"
#: Groups of documents that share a row of the state: a call in Python costs some milliseconds, and a document only microseconds.
#: A stream's checkpoint holds for one number.
GROUPS = 2048


def joiner(wait_ms: int):
    """Stateful function of a group of documents: their parts in, one row out for each document that is whole or has waited long enough.

    outcome: whole (all of the stated number have come), waited (none came for so long) or
    late, a part of its own row that came after its document had left. A part that comes
    twice counts once; the lines of parts stand in the order of their numbers. Each document
    has a time of its own at which it is due; the group's is the earliest of them.
    """

    def join(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        documents = {d: [due, total, last, dict(zip(numbers, lines)), closed] for d, due, total, last, numbers, lines, closed in (state.get[0] if state.exists else ())}
        came, out = set(), []
        if not state.hasTimedOut:
            for rows in batches:
                for d, arrived, part, parts, lines in zip(*(rows[c] for c in ("doc_id", "arrived", "part", "parts", "lines"))):
                    came.add(d := int(d))
                    document = documents.setdefault(d, [0, None, 0, {}, False])
                    document[2] = max(document[2], int(arrived.timestamp() * 1000))
                    own = [] if lines is None else list(lines)
                    if document[4]:
                        out.append((d, arrived, part, own, "late"))
                    else:
                        document[3].setdefault(int(part), own)
                        document[1] = int(parts) if pd.notna(parts) else document[1]
        for d in list(documents):
            due, total, last, held, closed = documents[d]
            waited = d not in came and due < now
            if waited and closed:
                del documents[d]
                continue
            whole = d in came and total is not None and len(held) >= total
            if not closed and (whole or waited):
                out.append((d, pd.Timestamp(last, unit="ms"), None, [line for n in sorted(held) for line in held[n]], "whole" if whole else "waited"))
                held, closed = {}, True
            # a document that has left is remembered as long again, so that late parts are known as such
            documents[d] = [max(last + wait_ms, now + 1) if waited or d in came else due, total, last, held, closed]
        if documents:
            state.update(([(d, due, total, last, list(held), list(held.values()), closed) for d, (due, total, last, held, closed) in documents.items()],))
            state.setTimeoutTimestamp(max(min(due for due, *_ in documents.values()), now + 1))
        else:
            state.remove()
        if out:
            frame = pd.DataFrame(out, columns=["doc_id", "arrived", "part", "lines", "outcome"])
            yield frame.astype({"part": "Int32"})

    return join


def gathered(parts: DataFrame, wait: str = "10 minutes") -> DataFrame:
    """(doc_id, arrived, part, lines, outcome) of a stream of parts, see ``joiner``. State is kept by groups of documents."""
    ms = int(pd.Timedelta(wait) / timedelta(milliseconds=1))
    timed = parts.withWatermark("arrived", wait).withColumn("group", F.pmod(F.xxhash64("doc_id"), F.lit(GROUPS)).cast("int"))
    return timed.groupBy("group").applyInPandasWithState(joiner(ms), GATHERED, HELD, "append", GroupStateTimeout.EventTimeTimeout)


def stream_parts(spark: SparkSession, landing: str, out: str, checkpoint: str, wait: str = "10 minutes", files_at_once: int | None = None) -> StreamingQuery:
    """S6 for documents in parts. Validated records go to ``out``/records, late parts to ``out``/late.

    Each micro-batch writes a folder of its own in both, so a repeated batch replaces its
    output. A document without a stated number of parts, or with one missing, leaves when
    the newest arrival lies ``wait`` twice ahead of it (once for the watermark, once for the
    document's own patience); until then it waits in the state across restarts. arrived is
    the time at which a part was put there: one that lies behind the watermark is not seen,
    while a part of any document that has left, put there now, is told as late.
    """
    reader = spark.readStream.schema(PART)
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    rows = gathered(reader.json(landing), wait)

    def write(batch: DataFrame, number: int) -> None:
        known = batch.persist()  # both outputs come from one evaluation of the state
        try:
            done = known.where("outcome <> 'late'")
            records = records_of(done.select("doc_id", "arrived", "lines"))
            records.hint("merge").join(done.select("doc_id", "outcome").hint("merge"), "doc_id").write.mode("overwrite").parquet(f"{out}/records/batch={number}")
            known.where("outcome = 'late'").select("doc_id", "arrived", "part", "lines").write.mode("overwrite").parquet(f"{out}/late/batch={number}")
        finally:
            known.unpersist()

    return rows.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
