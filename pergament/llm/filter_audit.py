"""Filter interaction audit: what each of five filters removes in every order of application.

Four filters look at one text. The fifth, identical to an earlier text, needs equal texts to
meet: texts are dealt to range partitions by adaptive prefixes (short ones, longer where a
short one is too heavy), and inserted whole into a compressed radix trie whose terminals
hold the smallest id. Tasks that read the documents do the same with their own rows first,
so of a text that stands very often one row a task is moved. Failures become a bit mask a
document; masks are counted by part, and the counts alone give all orders.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pergament.llm import common

NAMES = "ABCDE"
DUPLICATE = 1 << NAMES.index("E")
CAPITALS, ODD = bytes(range(65, 91)), b"#$%&*|"
NOT_CAPITALS = bytes(set(range(256)) - set(CAPITALS))
NOT_ODD = bytes(set(range(256)) - set(ODD))
CONTINUATION = bytes(range(0x80, 0xC0))
LEVELS = (4, 16, 64, 256)  # code points of a prefix; beyond them the whole text's hash follows
PART_BYTES = 32 << 20  # text a partition gets, and a trie holds before a reading task hands it on
OUT_ROWS = 1000


def mask(data: bytes) -> int:
    """Failures of A to D as bits 0 to 3, in integers, so that SQL can restate them."""
    words = data.split()
    n = len(words)
    points = len(data.translate(None, CONTINUATION))
    return (n < 50) | (100 * len(set(words)) < 65 * n) << 1 | (100 * len(data.translate(None, NOT_CAPITALS)) > 5 * points) << 2 | bool(data.translate(None, NOT_ODD)) << 3


def common_length(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of ``a`` and of ``b`` from ``at`` on, of which ``a`` is no prefix."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[at + low : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Trie:
    """Compressed radix trie of whole texts; a terminal holds the smallest id and the rows that bear it.

    A node is [children by first byte, terminal]; a child is (label, node), a terminal [id, rows].
    """

    def __init__(self):
        self.root, self.bytes = [{}, None], 0

    def node(self, text: bytes) -> list:
        at, node = 0, self.root
        while at < len(text):
            children, first = node[0], text[at]
            edge = children.get(first)
            if edge is None:
                fresh = [{}, None]
                children[first] = (text[at:], fresh)
                self.bytes += len(text) - at + 400
                return fresh
            label, below = edge
            if not text.startswith(label, at):
                n = common_length(label, text, at)
                between = [{label[n]: (label[n:], below)}, None]
                children[first] = (label[:n], between)
                self.bytes += 400
                label, below = label[:n], between
            at, node = at + len(label), below
        return node

    def add(self, text: bytes, doc: int, row) -> list:
        """Insert a row; the rows that are now known to repeat a smaller id's text."""
        node = self.node(text)
        held = node[1]
        if held is None:
            node[1] = [doc, [row]]
        elif doc > held[0]:
            return [row]
        elif doc == held[0]:
            held[1].append(row)
        else:
            node[1] = [doc, [row]]
            return held[1]
        return []

    def firsts(self) -> Iterator[tuple[bytes, list]]:
        """(text, rows) of every terminal, in the order of the texts."""
        stack = [(b"", self.root)]
        while stack:
            text, (children, held) = stack.pop()
            if held:
                yield text, held[1]
            stack.extend((text + children[c][0], children[c][1]) for c in sorted(children, reverse=True))


def prefix_hashes(text: Column) -> list[Column]:
    return [F.xxhash64(F.substring(text, 1, n)) for n in LEVELS] + [F.xxhash64(text)]


def heavy_prefixes(docs: DataFrame, parts: int | None = None) -> tuple[int, list[set[int]]]:
    """Number of partitions, and of each level the hashes of prefixes too heavy for one.

    A level has at most two heavy prefixes a partition, whatever the number of documents.
    """
    weighed = docs.select(F.octet_length("text").cast("long").alias("bytes"), F.posexplode(F.array(*prefix_hashes(F.col("text"))[:-1])).alias("level", "hash"))
    sums = common.save(weighed.groupBy("level", "hash").agg(F.sum("bytes").alias("bytes")), "prefix-weights", "lz4")
    total = sums.where("level = 0").agg(F.sum("bytes")).first()[0] or 0
    parts = parts or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))
    heavy: list[set[int]] = [set() for _ in LEVELS]
    for r in sums.where(F.col("bytes") > max(total // (2 * parts), 1)).select("level", "hash").collect():
        heavy[r["level"]].add(r["hash"])
    return parts, heavy


SCHEMA = "doc_id long, part string, mask int, n long, prefix string, text binary"


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc_id", "part", "mask", "n", "prefix", "text"])


def batches_of(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1] or b"")
        if len(held) >= OUT_ROWS or size >= 8 << 20:
            yield batch_of(held)
            held, size = [], 0
    if held:
        yield batch_of(held)


def read_rows(docs: DataFrame, heavy: list[set[int]]) -> DataFrame:
    """Every row with its mask: settled ones without a text, those that may be the first of theirs with prefix and text."""

    def prefix(text: bytes, hashes: tuple[int, ...]) -> str:
        for level, n in enumerate(LEVELS):
            if hashes[level] not in heavy[level]:
                return text[: 4 * n].decode("utf-8", "ignore")[:n]
        return text[: 4 * LEVELS[-1]].decode("utf-8", "ignore")[: LEVELS[-1]] + f"{hashes[-1] & (1 << 64) - 1:016x}"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        def handed(trie: Trie) -> Iterator[tuple]:
            for text, firsts in trie.firsts():
                counts: dict[tuple, int] = {}
                for row in firsts:
                    counts[row] = counts.get(row, 0) + 1
                for (doc, part, m, hashes), n in counts.items():
                    yield doc, part, m, n, prefix(text, hashes), text

        trie = Trie()
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for doc, part, text, *hashes in zip(*columns):
                m = mask(text)
                if doc is None:
                    yield None, part, m, 1, None, None
                    continue
                for d, p, was, _ in trie.add(text, doc, (doc, part, m, tuple(hashes))):
                    yield d, p, was | DUPLICATE, 1, None, None
            if trie.bytes > PART_BYTES:
                yield from handed(trie)
                trie = Trie()
        yield from handed(trie)

    narrow = docs.select("doc_id", "part", F.col("text").cast("binary").alias("text"), *(h.alias(f"h{k}") for k, h in enumerate(prefix_hashes(F.col("text")))))
    return narrow.mapInArrow(lambda batches: batches_of(rows(batches)), SCHEMA)


def resolved(rows: DataFrame, parts: int) -> DataFrame:
    """The rows that carry a text, with the duplicate flag in their mask, by one trie a range of prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        trie = Trie()
        for batch in batches:
            for doc, part, m, n, _, text in zip(*(c.to_pylist() for c in batch.columns)):
                for d, p, was, k in trie.add(text, doc, (doc, part, m, n)):
                    yield d, p, was | DUPLICATE, k, None, None
        for _, firsts in trie.firsts():
            for d, p, m, k in firsts:
                yield d, p, m, k, None, None

    dealt = rows.where("text is not null").repartitionByRange(parts, "prefix")
    return dealt.mapInArrow(lambda batches: batches_of(run(batches)), SCHEMA)


def masks(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """(doc_id, part, mask, n): the failures of n rows of ``docs`` (doc_id, text, source) as bits A to E.

    Null text or source: empty; the empty text is one like any other. A null doc_id neither
    repeats a text nor is repeated. Rows that repeat the smallest doc_id with the text are
    all first. Very long texts are taken whole. Empty table: no rows. Extra columns are
    ignored, whatever their names.
    """
    named = common.need(docs, doc_id="long", text="string", source="string")
    docs = named.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("")).alias("part"))
    parts, heavy = heavy_prefixes(docs, parts)
    rows = common.save(read_rows(docs, heavy), "masks")
    return rows.where("text is null").unionByName(resolved(rows, parts)).select("doc_id", "part", "mask", "n")


def report(counts: DataFrame) -> DataFrame:
    """One row per part, order and step of counts (part, mask, n, good, toxic): at most 32 rows a part."""
    orders = ["".join(p) for p in permutations(NAMES)]
    bit = np.array([[1 << NAMES.index(f) for f in o] for o in orders])
    before = np.cumsum(bit, axis=1) - bit
    every = np.arange(32)
    fails = (every & bit[..., None]) > 0
    reached = (every & before[..., None]) == 0
    removed, kept = reached & fails, (every & (before + bit)[..., None]) == 0
    redundant, alone = fails & ~reached, every == bit[..., None]
    shown = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, good, toxic = np.zeros((3, 32), dtype=np.int64)
                for r in found:
                    n[r["mask"]], good[r["mask"]], toxic[r["mask"]] = r["n"], r["good"], r["toxic"]
                gone = removed @ n
                total = {b: gone[bit == b].sum() for b in bit[0]}
                shapley = np.vectorize(total.get)(bit)
                columns = [kept @ n, gone, redundant @ n, alone @ n, removed @ good, removed @ toxic, shapley]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * bit.size), pa.array(np.repeat(orders, 5).tolist()), pa.array(np.tile(np.arange(1, 6), len(orders)), pa.int32()), *(pa.array(c.ravel(), pa.int64()) for c in columns)],
                    names=["part", "filter_order", "step", *shown],
                )

    gathered = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("found"))
    return gathered.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in shown))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, see ``report``; ``docs`` as for ``masks``.

    labels (doc_id, quality, toxic): a document is good where any of its rows says quality 1,
    toxic where any says toxic 1; null and missing labels say neither. Empty labels: nothing
    good or toxic is lost.
    """
    by_doc = masks(docs).groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    says = common.need(labels, doc_id="long", quality="long", toxic="long").groupBy("doc_id")
    says = says.agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).cast("long").alias(a) for c, a in (("quality", "good"), ("toxic", "bad"))))
    marked = by_doc.hint("merge").join(says.hint("merge"), "doc_id", "left")
    flagged = [F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(a) for c, a in (("good", "good"), ("bad", "toxic"))]
    return report(marked.groupBy("part", "mask").agg(F.sum("n").alias("n"), *flagged))


def oracle() -> str:
    """DuckDB SQL for ``audit`` on the tables documents and labels."""
    return r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY text) AS low FROM t),
m AS (SELECT doc_id, part, (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
  + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > low, false)::INT AS mask FROM w),
l AS (SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS bad FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(bad, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(f, b)),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM f a, f b, f c, f d, f e WHERE a.b | b.b | c.b | d.b | e.b = 31),
s AS (SELECT filter_order, i::INT AS step, bits[i] AS b, (list_sum(bits[1:i]) - bits[i])::INT AS before FROM o, unnest(range(1, 6)) AS u(i)),
r AS (SELECT part, filter_order, step, b, sum(CASE WHEN mask & (before | b) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN mask & before = 0 AND mask & b <> 0 THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN mask & before <> 0 AND mask & b <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN mask = b THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN mask & before = 0 AND mask & b <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN mask & before = 0 AND mask & b <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM c, s GROUP BY part, filter_order, step, b)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, b))::BIGINT AS shapley FROM r"""
