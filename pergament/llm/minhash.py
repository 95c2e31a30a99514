"""MinHash near-dedup by an inverted join on signature coordinates.

A signature has COORDINATES values; each folds LEAST least shingle hashes, every one under
an order of its own. Documents are posted under their (coordinate, value) pairs, here
called cells. Two documents at similarity 0.8 agree in half of their coordinates on
average, and in MATCHES or more but for 3e-7 of such pairs, so a pair is a candidate from
MATCHES common cells on. Counting starts from the rare end: of its cells, ordered by the
length of their lists over the whole corpus, a document is posted under all but the
MATCHES - 1 longest. Two documents with MATCHES cells in common still meet in one of the
others, so very common cells are skipped wherever rarer ones decide.

Lists are never expanded into all pairs. First every list proposes its smallest member with
the others; pairs that hold on the full sets form groups, so a group of copies costs as
many checks as members. Then, where a list still holds several groups, members of
different groups count their common coordinates within a task; those with a pair above the
threshold are compared on their full sets, and only links leave the task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pergament.llm import common
from pergament.llm.simhash import HASHES, MOST, across, by_cell, components, dealt, first_bearer, named

COORDINATES, LEAST, MATCHES = 40, 3, 6
MIX, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
WORD_MEMO = 500_000  # words of a worker's memo; it is emptied when full
CHUNK = 512


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= WORD_MEMO:
            self.clear()
        got = xxh64_intdigest(word, 11)
        if len(word) <= 64:
            self[word] = got
        return got


_words = WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * MIX2
    return x ^ x >> np.uint64(29)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """64-bit hashes of the distinct k-word shingles, ascending; fewer words: one of the whole sequence; none: empty."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(len(words) - k + 1, 1)
    x = np.full(n, min(len(words), k), dtype=np.uint64)  # a shorter sequence never equals a shingle
    for j in range(min(k, len(words))):
        x = mixed(x * MIX + hashes[j : j + n])
    return np.unique(x)


def orders() -> np.ndarray:
    return np.random.default_rng(11).integers(0, 1 << 63, (COORDINATES * LEAST, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(x: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """One value a coordinate; it names the coordinate too, so a value is a cell. Of an empty set none."""
    if not len(x):
        return np.zeros(0, dtype=np.uint64)
    least = np.full(len(multipliers), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(x), CHUNK):
        least = np.minimum(least, (x[at : at + CHUNK] * multipliers).min(axis=1))
    out = np.arange(1, COORDINATES + 1, dtype=np.uint64)
    for part in least.reshape(COORDINATES, LEAST).T:
        out = mixed(out * MIX + part)
    return out


def signatures(rows: DataFrame, k: int) -> DataFrame:
    """(row, doc_id, mark, n, cells) of rows (row, doc_id, text): digest and size of the shingle set, and its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers = orders()
        for batch in batches:
            sets = [shingle_set(t, k) for t in batch.column(2).to_pylist()]
            marks = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets]
            cells = [signature(x, multipliers).view(np.int64) for x in sets]
            columns = [batch.column(0), batch.column(1), pa.array(marks, pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.array(cells, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "mark", "n", "cells"])

    return rows.mapInArrow(run, "row long, doc_id long, mark binary, n long, cells array<long>")


def prefixes(nodes: DataFrame) -> DataFrame:
    """(node, posted): the coordinates under which a node is posted, as an array of (list length, cell, coordinate), shortest list first.

    Only cells that several nodes have count; a node with fewer than MATCHES of them has no
    partner, and of the others the MATCHES - 1 with the longest lists are left out.
    """
    postings = nodes.select("node", F.posexplode("cells").alias("coordinate", "cell"))
    lists = common.save(postings.groupBy("cell").count().where("count > 1"), "lists", "lz4")
    met = postings.hint("merge").join(lists.hint("merge"), "cell")
    gathered = met.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("count", "cell", "coordinate"))).alias("posted")).where(F.size("posted") >= MATCHES)
    return gathered.select("node", F.slice("posted", F.lit(1), F.size("posted") - (MATCHES - 1)).alias("posted"))


def shingle_sets(rows: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, set) of wanted (node, row), a written table: the shingle hashes of the row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, k).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"])

    texts = common.join_written(rows.select("row", "text"), wanted.select("node", "row"), "row").select("node", "text")
    return texts.mapInArrow(run, "node long, set array<long>")


def matrix(cells: np.ndarray) -> np.ndarray:
    """Signatures as rows of 32-bit values."""
    return np.stack(cells).view(np.uint64).astype(np.uint32)


def close_sizes(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 5 * np.minimum(n, m) >= 4 * np.maximum(n, m)


def common_hashes(x: np.ndarray, y: np.ndarray) -> int:
    """Number of values that two ascending arrays without repeats share."""
    at = np.searchsorted(x, y)
    at[at == len(x)] = len(x) - 1
    return int((x[at] == y).sum())


def held(columns: list[np.ndarray], at: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(a, b): the hub of each block with those members that agree in MATCHES coordinates and reach the similarity on full sets."""
    is_hub, node, n, cells, sets = columns[2:7]
    a, b = [], []
    for g in range(len(at) - 1):
        s = slice(at[g], at[g + 1])
        hub = at[g] + int(np.flatnonzero(is_hub[s])[0])
        values, whole = matrix(cells[s]), sets[hub].view(np.uint64)
        hopeful = ((values == values[hub - at[g]]).sum(axis=1) >= MATCHES) & close_sizes(n[s], n[hub])
        hopeful[hub - at[g]] = False
        for r in np.flatnonzero(hopeful) + at[g]:
            if 9 * common_hashes(whole, sets[r].view(np.uint64)) >= 4 * (n[hub] + n[r]):
                a.append(int(node[hub]))
                b.append(int(node[r]))
    yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def star_links(members: DataFrame, signs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between the smallest node of each list and its other members.

    A hub with very many members is compared block by block; its set goes to each block.
    """
    hubs = common.save(members.groupBy("cell").agg(F.min("node").alias("hub")), "hubs", "lz4")
    met = members.hint("merge").join(hubs.hint("merge"), "cell").where("node <> hub")
    pairs = common.save(met.groupBy("hub", "node").agg(F.first("n").alias("n")), "pairs", "lz4")
    blocks = common.save(pairs.groupBy("hub").agg(F.ceil(F.sum("n") / HASHES).cast("int").alias("blocks")), "blocks", "lz4")
    spread = pairs.hint("merge").join(blocks.hint("merge"), "hub").select("hub", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"), F.lit(False).alias("is_hub"), "node")
    own = blocks.select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("is_hub"), F.col("hub").alias("node"))
    # a block that got no member costs one row
    rows = spread.unionByName(own).hint("merge").join(signs.hint("merge"), "node").hint("merge").join(sets.hint("merge"), "node")
    return by_cell(rows.select("hub", "block", "is_hub", "node", "n", "cells", "set"), 2, held, "a long, b long")


def opened(members: DataFrame, name: str) -> DataFrame:
    """Members (cell, node, label, ...) of the cells that hold several labels; left where the label is not the cell's commonest."""
    counts = members.groupBy("cell", "label").count().groupBy("cell").agg(F.max_by("label", F.struct("count", "label")).alias("most"), F.count("*").alias("labels"))
    several = common.save(counts.where("labels > 1").select("cell", "most"), name, "lz4")
    return members.hint("merge").join(several.hint("merge"), "cell").withColumn("left", F.col("label") != F.col("most")).drop("most")


def counted(columns: list[np.ndarray], at: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(cell, node, label): members of a block with a partner of another label, close in size, that agrees in MATCHES coordinates.

    A pair counts in one list only: that of the first coordinate under which both are posted.
    """
    cell, coordinate, left, right, node, n, label, mask, cells = columns[0], *columns[3:]
    out = []
    for g in range(len(at) - 1):
        s = slice(at[g], at[g + 1])
        lefts, rights = np.flatnonzero(left[s]), np.flatnonzero(right[s])
        if not len(lefts) or not len(rights):
            continue
        values, size, name, bits = matrix(cells[s]), n[s], label[s], mask[s]
        here, hit = int(coordinate[at[g]]), np.zeros(at[g + 1] - at[g], dtype=bool)
        earlier = bits & ((1 << here) - 1)
        for k in range(0, len(lefts), 256):
            some = lefts[k : k + 256]
            close = close_sizes(size[some][:, None], size[rights][None, :]) & (name[some][:, None] != name[rights][None, :])
            if not close.any():
                continue
            same = np.zeros(close.shape, dtype=np.int8)
            first = close
            for j in range(COORDINATES):
                equal = values[some, j][:, None] == values[rights, j][None, :]
                same += equal
                if j < here:
                    both = (earlier[some] >> j & 1)[:, None] & (earlier[rights] >> j & 1)[None, :]
                    first = first & ~(equal & (both == 1))
            close = first & (same >= MATCHES)
            hit[some[close.any(axis=1)]] = True
            hit[rights[close.any(axis=0)]] = True
        mine = np.flatnonzero(hit)
        if len(mine):
            out.append((np.full(len(mine), cell[at[g]]), node[s][mine], name[mine]))
    yield pa.RecordBatch.from_pydict({k: pa.array(np.concatenate(c), pa.int64()) for k, c in zip(("cell", "node", "label"), zip(*out))} if out else {k: pa.array([], pa.int64()) for k in ("cell", "node", "label")})


def group_links(members: DataFrame, labels: DataFrame, signs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between members of different groups that some list holds: counted on signatures, then confirmed on full sets."""
    known = members.hint("merge").join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    open_ = common.save(opened(common.save(known, "known", "lz4"), "several"), "open", "lz4")
    wide = dealt(open_, "cell", "left", F.lit(1), MOST).hint("merge").join(signs.drop("n").hint("merge"), "node")
    found = by_cell(wide.select("cell", "i", "j", "coordinate", "left", "right", "node", "n", "label", "mask", "cells"), 3, counted, "cell long, node long, label long")
    hopeful = common.save(opened(common.save(found.distinct(), "hopeful", "lz4"), "mixed").hint("merge").join(signs.select("node", "n").hint("merge"), "node"), "hopeful", "lz4")
    blocks = dealt(hopeful, "cell", "left", F.greatest("n", F.lit(HASHES >> 12)), HASHES).hint("merge").join(sets.hint("merge"), "node")
    return by_cell(blocks.select("cell", "i", "j", "left", "right", "node", "n", "label", "set"), 3, across, "a long, b long").distinct()


def cluster(docs: DataFrame, k: int = 2) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row: groups linked by Jaccard similarity 0.8 of k-word shingle sets.

    Null or empty text, or white space only: no set, linked with nothing. Fewer than k
    words: one shingle of all words. Equal sets are one node, so copies and repeated rows
    share their group whatever their number; two rows of one doc_id are both kept.
    component_id is the smallest doc_id of the group (nulls ignored; null if all are); kept
    compares it with doc_id, null equal to null. Very long texts are taken whole. Empty
    table: no rows. Extra columns are ignored, whatever their names.
    """
    rows, row = common.save_numbered(common.need(docs, doc_id="long", text="string"))
    rows = rows.withColumnRenamed(row, "row").select("row", "doc_id", "text")
    marks = common.save(signatures(rows, k), "signatures", "lz4")
    one = [F.first(c).alias(c) for c in ("n", "cells")]
    nodes = common.save(marks.where("n > 0").groupBy("mark").agg(first_bearer(), *one).withColumn("node", F.monotonically_increasing_id()), "nodes", "lz4")
    posted = common.save(prefixes(nodes), "prefixes", "lz4")
    mask = F.aggregate("posted", F.lit(0).cast("long"), lambda m, p: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), p["coordinate"])))
    signs = common.save(nodes.hint("merge").join(posted.withColumn("mask", mask).select("node", "mask").hint("merge"), "node").select("node", F.col("first.row").alias("row"), "n", "mask", "cells"), "signs", "lz4")
    cells = posted.select("node", F.explode("posted").alias("p")).select("node", F.col("p.cell").alias("cell"), F.col("p.coordinate").alias("coordinate"))
    shared = common.save(cells.groupBy("cell").count().where("count > 1").select("cell"), "shared", "lz4")
    members = common.save(cells.hint("merge").join(shared.hint("merge"), "cell").hint("merge").join(signs.select("node", "n").hint("merge"), "node"), "members", "lz4")
    wanted = common.save(signs.hint("merge").join(members.select("node").distinct().hint("merge"), "node", "left_semi").select("node", "row"), "wanted", "lz4")
    sets = common.save(shingle_sets(rows, wanted, k), "sets", "lz4")
    signs = signs.drop("row")
    edges = common.save(star_links(members, signs, sets), "links", "lz4")
    labels = components(edges)
    more = common.save(group_links(members, labels, signs, sets), "links", "lz4")
    if not more.isEmpty():
        labels = components(edges.unionByName(more))
    names = named(nodes, labels, ["mark"]).select("mark", "component_id")
    full = marks.where("n > 0").select("doc_id", "n", "mark").hint("merge").join(names.hint("merge"), "mark").select("doc_id", "n", "component_id")
    every = full.unionByName(marks.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return every.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
