"""Exact dedup by content-defined chunk recipes.

A text, white space normalised, is cut where a rolling hash of the last 32 bytes says so.
Equal chunks get one identifier: chunks are grouped by hash AND bytes, so an identifier is
verified; where two chunks share a hash they get different identifiers. A text is then its
ordered identifier list, and texts are compared by these short lists alone: the bytes of a
chunk move once, map-side combined, and whole documents never move.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pergament.llm import common

GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint32)
MIN, BITS, MAX = 256, 11, 16_384  # shortest chunk, log2 of the mean distance of cuts, longest chunk
SPACE = re.compile(rb"[ \t-\r]+")


def normalise(text: str | None) -> bytes:
    return SPACE.sub(b" ", (text or "").encode())


def rolling(data: np.ndarray) -> np.ndarray:
    """Gear hash of the 32 bytes that end at each place."""
    h = GEAR[data]
    for s in (1, 2, 4, 8, 16):
        shifted = h[:-s] << np.uint32(s)
        h[s:] += shifted
    return h


def chunks(texts: list[bytes]) -> list[list[bytes]]:
    """Chunks of each text; they depend on the text's own bytes alone. Empty text: no chunk."""
    whole = b"".join(texts)
    if not whole:
        return [[] for _ in texts]
    h = rolling(np.frombuffer(whole, dtype=np.uint8))
    cuts = np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + 1
    out, base = [], 0
    for text in texts:
        end, at, got = base + len(text), base, []
        for cut in cuts[np.searchsorted(cuts, base + MIN) : np.searchsorted(cuts, end)].tolist():
            while cut - at > MAX:
                got.append(whole[at : at + MAX])
                at += MAX
            if cut - at >= MIN:
                got.append(whole[at:cut])
                at = cut
        while end - at > MAX:
            got.append(whole[at : at + MAX])
            at += MAX
        if end > at:
            got.append(whole[at:end])
        out.append(got)
        base = end
    return out


def cut_documents(docs: DataFrame, hash_bytes: int = 16, row: str | None = None) -> DataFrame:
    """(row, doc_id, text_sha256, hashes, chunks) of every row: a map over the scan."""
    schema = "row long, doc_id long, text_sha256 string, hashes array<binary>, chunks array<binary>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                texts = [normalise(t) for t in part.column(2).to_pylist()]
                cut = chunks(texts)
                yield pa.RecordBatch.from_pydict({
                    "row": part.column(0), "doc_id": part.column(1), "text_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                    "hashes": pa.array([[hashlib.blake2b(c, digest_size=16).digest()[:hash_bytes] for c in x] for x in cut], pa.list_(pa.binary())), "chunks": pa.array(cut, pa.list_(pa.binary())),
                })

    rows, name = (docs, row) if row else common.numbered(docs)
    common.bound_batches(docs.sparkSession)
    return rows.select(name, F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def recipes(cut: DataFrame) -> DataFrame:
    """(row, doc_id, text_sha256, recipe): verified chunk identifiers in order.

    Hash and bytes together make a chunk. A hash with one chunk is its identifier; the
    chunks of any other hash are numbered, and their documents' lists rewritten.
    """
    place = cut.select("row", F.posexplode(F.arrays_zip("hashes", "chunks")).alias("ord", "c")).select("row", "ord", F.col("c.hashes").alias("hash"), F.col("c.chunks").alias("bytes"))
    distinct = place.groupBy("hash", "bytes").agg(F.lit(1).alias("one"))
    clashing = common.save(distinct.groupBy("hash").count().where("count > 1").select("hash"), "clashing")
    plain = cut.select("row", "doc_id", "text_sha256", F.col("hashes").alias("recipe"))
    if clashing.isEmpty():
        return plain
    number = F.row_number().over(Window.partitionBy("hash").orderBy("bytes")).cast("string").cast("binary")
    variants = distinct.hint("merge").join(clashing.hint("merge"), "hash").select("hash", "bytes", F.concat("hash", number).alias("id"))
    named = place.hint("merge").join(variants.hint("merge"), ["hash", "bytes"], "left").select("row", "ord", F.coalesce("id", "hash").alias("id"))
    lists = named.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("ord", "id"))).alias("ids"))
    rewritten = plain.drop("recipe").hint("merge").join(lists.hint("merge"), "row", "left")
    return rewritten.select("row", "doc_id", "text_sha256", F.coalesce(F.col("ids.id"), F.array().cast("array<binary>")).alias("recipe"))


def dedup(docs: DataFrame, hash_bytes: int = 16, row: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; all empty texts form one group. Of equal texts the row with
    the smallest doc_id stays (null after any number; of rows that repeat it, one). Empty
    table: no rows. Extra columns are ignored. The group table is summed up before its
    shuffle and written; the join back is then a plain sort-merge join, whose large
    partitions Spark splits. ``row`` names a column of row numbers; without it they are
    those of this one scan.
    """
    cut = common.save(cut_documents(docs, hash_bytes, row), "chunks")
    listed = common.save(recipes(cut), "recipes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    groups = common.save(listed.groupBy("recipe").agg(first, F.count("*").alias("group_size")), "groups")
    joined = listed.hint("merge").join(groups.hint("merge"), "recipe")
    return joined.select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256", "row")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Null text is the empty one, of which one row stays. Of equal texts the smallest doc_id's
    row stays (null doc_ids last), of rows that repeat both one. Very long texts are compared
    whole, by their chunks. Empty table: no rows. Other columns go along, whatever their names.
    """
    rows, name = common.save_numbered(docs)
    return common.without_rows(rows, name, dedup(rows, row=name).where("NOT kept"))


def oracle() -> str:
    return r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g ON n.t = g.t"""
