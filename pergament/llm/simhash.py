"""SimHash near-dedup by anchor-point covering.

The anchors are the words of a covering code: on each block of 23 fingerprint bits the
binary Golay code, whose 4096 words lie so that every 23-bit word has exactly one within
distance 3. A fingerprint's home is its nearest anchor; every fingerprint is replicated to
each anchor within covering radius plus threshold. Two fingerprints within the threshold
therefore meet at the home of either, and comparing per anchor loses no link. With a
product of blocks, the threshold is shared among the blocks, so few replicas suffice.

Equal fingerprints are one node from the start. Each anchor emits a spanning forest of the
links it found, never all pairs; connected components follow from these edges.

``cluster`` holds pairs to an exact shingle similarity: the anchors bring documents
together first, and each link is checked on the two shingle sets before it counts. Pairs too
far apart for a replica each, which similarity 0.8 allows, are brought together by band keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pergament.llm import common

# Length, covering radius and generator polynomial of the binary Golay code.
LENGTH, RADIUS, GENERATOR = 23, 3, 0xC75
SEED = 42
# Bands of least hashes: a pair of similarity 0.8 shares no key with probability 7e-5.
BANDS, BAND_ROWS = 24, 5
# Of 256 bits a pair of similarity 0.8 differs in 42 on average, 48 for very short texts, with a deviation of 6.
FAR = 68
# Anchors of groups by shingle similarity: bits 0 to 45 of the first word, met within one bit; it is compared whole.
NEAR_BAND, NEAR_BITS, NEAR_LIMIT = [[list(range(s, s + LENGTH)) for s in (0, LENGTH)]], 1, 17
MOST = 16_384  # rows of a cell that are compared in one task; larger cells are cut into blocks
HASHES = 1 << 21  # shingle hashes of a block on either side, 16 MB


class Golay:
    """Error patterns by syndrome: those that lead from a word to its anchors, by excess weight."""

    def __init__(self, extra: int):
        weights = range(RADIUS + extra + 1)
        patterns = np.array([sum(1 << i for i in c) for w in weights for c in combinations(range(LENGTH), w)], dtype=np.uint32)
        excess = np.maximum(np.bitwise_count(patterns).astype(np.int64) - RADIUS, 0)
        syndrome = self.syndrome(patterns)
        self.lists = []
        for x in range(extra + 1):
            own, s = patterns[excess == x], syndrome[excess == x]
            order = np.argsort(s, kind="stable")
            self.lists.append((own[order], np.searchsorted(s[order], np.arange((1 << 11) + 1))))

    @staticmethod
    def syndrome(words: np.ndarray) -> np.ndarray:
        rest = words.astype(np.uint32).copy()
        for bit in range(LENGTH - 1, 10, -1):
            rest ^= np.where(rest >> np.uint32(bit) & np.uint32(1), np.uint32(GENERATOR << (bit - 11)), np.uint32(0))
        return rest.astype(np.int64)


def contiguous(*starts: int) -> list[list[int]]:
    """Blocks of 23 neighbouring bits that begin at the given fingerprint bits."""
    return [list(range(s, s + LENGTH)) for s in starts]


def drawn(bands: int, bits: int, seed: int = 8) -> list[list[list[int]]]:
    """Bands of one block each, whose bits are drawn from the whole fingerprint."""
    rng = np.random.default_rng(seed)
    return [[rng.permutation(bits)[:LENGTH].tolist()] for _ in range(bands)]


def take_bits(words: np.ndarray, positions: Sequence[int]) -> np.ndarray:
    out = np.zeros(len(words), dtype=np.uint32)
    for k, p in enumerate(positions):
        out |= (words[:, p // 64] >> np.uint64(p % 64) & np.uint64(1)).astype(np.uint32) << np.uint32(k)
    return out


def anchors(words: np.ndarray, band: list[list[int]], threshold: int, code: Golay) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, is_home) of every anchor within covering radius plus threshold of each row."""
    row = np.arange(len(words))
    key = np.zeros(len(words), dtype=np.int64)
    left = np.full(len(words), threshold)
    for positions in band:
        block = take_bits(words, positions)
        syndrome = code.syndrome(block)
        parts = []
        for x in range(threshold + 1):
            patterns, at = code.lists[x]
            own = np.flatnonzero(left >= x)
            s = syndrome[row[own]]
            n = at[s + 1] - at[s]
            src = np.repeat(own, n)
            nth = np.arange(len(src)) - np.repeat(np.cumsum(n) - n, n)
            anchor = block[row[src]] ^ patterns[np.repeat(at[s], n) + nth]
            parts.append((row[src], key[src] << 12 | (anchor >> np.uint32(11)).astype(np.int64), left[src] - x))
        row, key, left = (np.concatenate(p) for p in zip(*parts))
    return row, key, left == threshold


def shingle_hashes(data: bytes, k: int, h) -> list[int]:
    words = data.split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= k:
        return [h(joined, SEED)]
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *[e + 1 for e in ends]]
    return [h(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :])]


def fingerprint(text: str | None, k: int, words: int, h) -> list[int]:
    """``words`` unsigned 64-bit integers; the first is made of the shingles' own XXH64."""
    got = shingle_hashes((text or "").encode().lower(), k, h)
    return majority(np.array(got, dtype=np.uint64), words) if got else [0] * words


def majority(x: np.ndarray, words: int) -> list[int]:
    n, out = len(x), []
    for j in range(words):
        if j:
            x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(27)
        bits = np.unpackbits(x.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        out.append(int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > n).tobytes(), "big"))
    return out


def fingerprints(docs: DataFrame, k: int, words: int = 1) -> DataFrame:
    """(row, doc_id, w0, w1, ...) of every row; fingerprints as signed longs. A map over the scan."""
    names = [f"w{j}" for j in range(words)]
    schema = "row long, doc_id long, " + ", ".join(f"{n} long" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest as h

        for batch in batches:
            got = np.array([fingerprint(t, k, words, h) for t in batch.column(2).to_pylist()], dtype=np.uint64).reshape(-1, words).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(got[:, j].copy()) for j in range(words))], names=["row", "doc_id", *names])

    common.bound_batches(docs.sparkSession)
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return numbered.mapInArrow(run, schema)


def by_cell(rows: DataFrame, n_keys: int, found: Callable, schema: str) -> DataFrame:
    """``found(columns, starts)`` over rows dealt and sorted by their first ``n_keys`` columns.

    columns hold some whole cells, starts where each begins, and the end. One batch of rows
    and one cell are in memory at a time; ``dealt`` bounds the cells.
    """
    keys = rows.columns[:n_keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            new = np.logical_or.reduce([c[1:] != c[:-1] for c in columns[:n_keys]])
            return found(columns, np.append(np.flatnonzero(np.r_[True, new]), len(columns[0])))

        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            last = [c[-1] for c in held[-1][:n_keys]]
            if all(c[0] == x for c, x in zip(held[0], last)):
                continue  # still the same cell
            columns = [np.concatenate(c) for c in zip(*held)]
            cut = int(np.logical_and.reduce([c == x for c, x in zip(columns, last)]).argmax())
            yield from whole([c[:cut] for c in columns])
            held = [[c[cut:] for c in columns]]
        if held:
            yield from whole([np.concatenate(c) for c in zip(*held)])

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def dealt(rows: DataFrame, cell: str, left: str, weight: Column, most: int) -> DataFrame:
    """Rows with block numbers i and j and a flag ``right``; every left row meets every row of its cell in one block.

    A cell whose rows weigh up to ``most`` is one block in which each row is on both sides.
    A heavier one is a grid: its left rows are split into parts i, all its rows into parts
    j, by the hash of the node, and each pair of parts is a block of its own. ``rows`` is a
    written table.
    """
    sizes = rows.groupBy(cell).agg(F.sum(F.when(F.col(left), weight).otherwise(0)).alias("lefts"), F.sum(weight).alias("alls")).where(F.col("alls") > most)
    parts = [F.ceil(F.col(n) / most).cast("int").alias(m) for n, m in (("lefts", "is"), ("alls", "js"))]
    hot = common.save(sizes.select(cell, *parts), "hot-cells")
    one = F.lit(0)
    if hot.isEmpty():
        return rows.withColumns({"i": one, "j": one, "right": F.lit(True)})
    grid = rows.hint("merge").join(hot.hint("merge"), cell).where("is > 0")
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(one, F.col(n) - 1))
    lefts = grid.where(left).withColumns({"i": part("is"), "j": every("js"), "right": F.lit(False)})
    rights = grid.withColumns({"i": every("is"), "j": part("js"), "right": F.lit(True), left: F.lit(False)})
    rest = rows.hint("merge").join(hot.hint("merge"), cell, "left_anti").withColumns({"i": one, "j": one, "right": F.lit(True)})
    return rest.unionByName(lefts.drop("is", "js")).unionByName(rights.drop("is", "js"))


def cell_edges(node: np.ndarray, words: np.ndarray, left: np.ndarray, right: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Spanning forest of the links between a block's left and right fingerprints."""
    lefts, rights, label, out = np.flatnonzero(left), np.flatnonzero(right), None, []
    for at in range(0, len(lefts), 256):
        some = lefts[at : at + 256]
        d = np.zeros((len(some), len(rights)), dtype=np.int16)
        for j in range(words.shape[1]):
            d += np.bitwise_count(words[some, j][:, None] ^ words[rights, j][None, :])
        close = (d <= limit) & (node[some][:, None] != node[rights][None, :])
        for r in np.flatnonzero(close.any(axis=1)):
            if label is None:
                label = np.arange(len(node))
            me, hit = some[r], rights[close[r]]
            others, first = np.unique(label[hit], return_index=True)
            new = others != label[me]
            if new.any():
                out += [(int(node[me]), int(node[hit[f]])) for f in first[new]]
                label[np.isin(label, others)] = label[me]
    return out


def links(nodes: DataFrame, bands: list[list[list[int]]], threshold: int, limit: int) -> DataFrame:
    """Edges (a, b) between nodes (node, w0, ...) whose fingerprints differ in ``limit`` bits or fewer.

    Complete for one band if limit <= threshold; several bands with a larger limit find a
    pair when any band holds it within the threshold. An anchor that very many fingerprints
    share is compared block by block, see ``dealt``.
    """
    names = [c for c in nodes.columns if c != "node"]
    schema = "anchor long, home boolean, node long, " + ", ".join(f"{n} long" for n in names)

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Golay(threshold)
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                node = part.column(0).to_numpy()
                words = np.stack([c.to_numpy() for c in part.columns[1:]], axis=1)
                for b, band in enumerate(bands):
                    row, key, home = anchors(words.view(np.uint64), band, threshold, code)
                    yield pa.RecordBatch.from_arrays([pa.array(key * len(bands) + b), pa.array(home), pa.array(node[row]), *(pa.array(words[row, j]) for j in range(len(names)))], names=["anchor", "home", "node", *names])

    def forests(columns: list[np.ndarray], at: np.ndarray) -> Iterator[pa.RecordBatch]:
        left, right, node = columns[3:6]
        words, edges = np.stack(columns[6:], axis=1).view(np.uint64), []
        any_left = np.add.reduceat(left.astype(np.int64), at[:-1]) > 0
        for g in np.flatnonzero((np.diff(at) > 1) & any_left):
            s = slice(at[g], at[g + 1])
            edges += cell_edges(node[s], words[s], left[s], right[s], limit)
        a, b = zip(*edges) if edges else ((), ())
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    replicas = common.save(nodes.select("node", *names).mapInArrow(replicate, schema), "replicas")
    blocks = dealt(replicas, "anchor", "home", F.lit(1), MOST).select("anchor", "i", "j", "home", "right", "node", *names)
    found = by_cell(blocks, 3, forests, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node on an edge.

    Alternating large-star and small-star rounds; each half is a written table, so a lost
    executor costs half a round. The number of rounds grows with the logarithm of the
    longest path. Minima are combined before the shuffle. Few of them, by the number of
    edges, are broadcast; more are written, so that the joins are plain sort-merge joins,
    whose large partitions Spark splits where a node has very many neighbours.
    """
    edges = common.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")

    def state(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())

    def joined(df: DataFrame, low: DataFrame, n: int) -> DataFrame:
        if 2 * n <= common.FEW_ROWS:  # two nodes an edge
            return df.join(F.broadcast(low), "u")
        return df.hint("merge").join(common.save(low, "lowest").hint("merge"), "u")

    before = state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = joined(both.where("v > u"), low, before[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = common.save(large, "edges")
        after = state(large)
        if after == before and large.groupBy("u").count().where("count > 1").isEmpty():
            break
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = joined(large, low, after[0]).select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        edges = common.save(small.select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct(), "edges")
        before = state(edges)
    # each edge leads from a node, which has no other, to the smallest of its component
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select("v", F.col("v").alias("w")).distinct().toDF("node", "component"))


def hamming_cluster(docs: DataFrame, k: int, words: int, bands: list[list[list[int]]], threshold: int, limit: int) -> DataFrame:
    """(row, doc_id, w0, ..., component_id, first_row) of every row of ``docs``, by fingerprint distance.

    component_id is the smallest doc_id of the linked group (nulls ignored; null if all
    are), first_row the row that bears it. Null or empty text: fingerprint zero, linked like
    any other. Texts shorter than k words: one shingle of all words. Repeated rows: one
    node. Empty table: no rows. Extra columns are ignored.
    """
    names = [f"w{j}" for j in range(words)]
    marks = common.save(fingerprints(docs, k, words), "fingerprints")
    nodes = common.save(marks.groupBy(*names).agg(first_bearer()).withColumn("node", F.monotonically_increasing_id()), "nodes")
    labels = components(links(nodes.select("node", *names), bands, threshold, limit))
    return marks.hint("merge").join(named(nodes, labels, names).hint("merge"), names)


def first_bearer() -> Column:
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")


def named(nodes: DataFrame, labels: DataFrame, names: list[str]) -> DataFrame:
    """(*names, component_id, first_row) of every node, written; so are the tables joined on the way."""
    grouped = common.save(nodes.select("node", "first", *names).hint("merge").join(labels.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node")), "grouped")
    best = common.save(grouped.groupBy("component").agg(F.min("first").alias("best")), "best")
    joined = grouped.hint("merge").join(best.hint("merge"), "component")
    return common.save(joined.select(*names, F.col("best.doc_id").alias("component_id"), F.col("best.row").alias("first_row")), "named")


# ---- groups by exact shingle similarity


def shingle_set(text: str | None, k: int, h) -> np.ndarray:
    """Hashes of the distinct k-word shingles, ascending."""
    return np.unique(np.array(shingle_hashes((text or "").encode().lower(), k, h), dtype=np.uint64))


def band_keys(x: np.ndarray, h) -> list[int]:
    """One key a band: BAND_ROWS least hashes, each under an order of its own. Of an empty set none."""
    if not len(x):
        return []
    orders = np.random.default_rng(5).integers(0, 1 << 64, (BANDS * BAND_ROWS, 1), dtype=np.uint64)
    least = np.full(len(orders), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(x), 4096):
        least = np.minimum(least, ((x[at : at + 4096] ^ orders) * np.uint64(0xBF58476D1CE4E5B9)).min(axis=1))
    return [h(part.tobytes(), band) for band, part in enumerate(least.reshape(BANDS, BAND_ROWS))]


WORDS = [f"w{j}" for j in range(4)]


def sketches(rows: DataFrame, k: int) -> DataFrame:
    """(row, doc_id, mark, n, w0 to w3, keys) of rows (row, doc_id, text): digest, size, fingerprint and band keys of the shingle set."""
    schema = "row long, doc_id long, mark binary, n long, " + ", ".join(f"{w} long" for w in WORDS) + ", keys array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest as h

        for batch in batches:
            sets = [shingle_set(t, k, h) for t in batch.column(2).to_pylist()]
            words = np.array([majority(x, 4) for x in sets], dtype=np.uint64).reshape(-1, 4).view(np.int64)
            keys = [np.array(band_keys(x, h), dtype=np.uint64).view(np.int64) for x in sets]
            marks = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(marks, pa.binary()), pa.array([len(x) for x in sets], pa.int64()), *(pa.array(words[:, j].copy()) for j in range(4)), pa.array(keys, pa.list_(pa.int64()))],
                names=["row", "doc_id", "mark", "n", *WORDS, "keys"],
            )

    return rows.mapInArrow(run, schema)


def near(n: np.ndarray, words: np.ndarray, m: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether each (n, words) may reach similarity 0.8 with each (m, others): sizes (no loss) and fingerprints."""
    d = np.zeros((len(n), len(m)), dtype=np.int16)
    for j in range(words.shape[1]):
        d += np.bitwise_count(words[:, j][:, None] ^ others[:, j][None, :])
    return (d <= FAR) & (5 * np.minimum(n[:, None], m[None, :]) >= 4 * np.maximum(n[:, None], m[None, :]))


def star(columns: list[np.ndarray], at: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(cell, a, b): each block's middle member, nearest to the majority of all bits, with the others near it.

    The middle of a block that is only a part of its cell comes along as (cell, a, a).
    """
    cell, node, n, blocks = columns[0], columns[2], columns[3], columns[4]
    words, out = np.stack(columns[5:], axis=1).view(np.uint64), []
    for g in range(len(at) - 1):
        s, hub = slice(at[g], at[g + 1]), 0
        if at[g + 1] - at[g] > 2:
            bits = np.unpackbits(words[s].view(np.uint8), axis=1)
            centre = np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(bits)).view(np.uint64)
            hub = int(np.bitwise_count(words[s] ^ centre).sum(axis=1, dtype=np.int64).argmin())
        close = near(n[s][hub : hub + 1], words[s][hub : hub + 1], n[s], words[s])[0]
        close[hub] = blocks[at[g]] > 1
        other = node[s][close]
        out.append((np.full(len(other), cell[at[g]]), np.full(len(other), node[s][hub]), other))
    yield pa.RecordBatch.from_pydict({k: pa.array(np.concatenate(c)) for k, c in zip(("cell", "a", "b"), zip(*out))})


def shared_shingles(sets: list[np.ndarray], lefts: np.ndarray, rights: np.ndarray) -> np.ndarray:
    """Number of hashes that each left set has in common with each right one, by bit rows over the hashes that recur."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, word, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    again = times[word] > 1
    owner, word = owner[again], (np.cumsum(times > 1) - 1)[word[again]]
    shared = np.zeros((len(lefts), len(rights)), dtype=np.int32)
    order = np.argsort(word, kind="stable")
    owner, word = owner[order], word[order]
    for at in range(0, int(word[-1]) + 1 if len(word) else 0, 4096):
        some = slice(*np.searchsorted(word, [at, at + 4096]))
        bits = np.zeros((len(sets), 4096), dtype=bool)
        bits[owner[some], word[some] - at] = True
        packed = np.packbits(bits[:, : int(word[some][-1]) - at + 1], axis=1)
        packed = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)
        for k in range(0, len(lefts), 256):
            for w in range(packed.shape[1]):
                mine = packed[lefts[k : k + 256], w]
                if mine.any():
                    shared[k : k + 256] += np.bitwise_count(mine[:, None] & packed[rights, w][None, :])
    return shared


def across(columns: list[np.ndarray], at: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(a, b): links of similarity 0.8 or more between a block's left and right members, one for each pair of groups that they join.

    All pairs are compared, on the sets whole; none but the links leave the task.
    """
    left, right, node, n, label, sets = columns[3:9]
    a, b = [], []
    for g in range(len(at) - 1):
        s = slice(at[g], at[g + 1])
        lefts, rights = np.flatnonzero(left[s]), np.flatnonzero(right[s])
        if not len(lefts) or not len(rights):
            continue
        size, name, own = n[s], label[s].copy(), node[s]
        shared = shared_shingles(list(sets[s]), lefts, rights)
        close = (9 * shared >= 4 * (size[lefts][:, None] + size[rights][None, :])) & (name[lefts][:, None] != name[rights][None, :])
        for r in np.flatnonzero(close.any(axis=1)):
            me, hit = lefts[r], rights[close[r]]
            others, first = np.unique(name[hit], return_index=True)
            new = others != name[me]
            a += [own[me]] * int(new.sum())
            b += own[hit[first[new]]].tolist()
            name[np.isin(name, others)] = name[me]
    yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def star_pairs(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``star`` in the cells of members (cell, count, node, n, w0 to w3)."""
    blocks = F.ceil(F.col("count") / MOST).cast("int")
    parts = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    found = common.save(by_cell(parts.select("cell", "block", "node", "n", "blocks", *WORDS), 2, star, "cell long, a long, b long"), "stars")
    # the middles of a cell that was cut into blocks meet the smallest of them
    middles = found.where("a = b").select("cell", F.col("a").alias("b"))
    first = common.save(middles.groupBy("cell").agg(F.min("b").alias("a")), "middles")
    more = middles.hint("merge").join(first.hint("merge"), "cell").select("a", "b")
    return found.select("a", "b").unionByName(more).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) whose nodes are not in one group of ``labels`` already."""
    for c in "ab":
        name = labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in"))
        pairs = pairs.hint("merge").join(name.hint("merge"), c, "left")
    return pairs.where(F.col("a_in").isNull() | ~F.col("a_in").eqNullSafe(F.col("b_in"))).select("a", "b")


def across_links(members: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) of ``across``: in each cell that holds several groups, between all its members of different groups.

    All members of a cell but its largest group are compared with the whole cell.
    """
    known = members.select("cell", "node", "n").hint("merge").join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    known = common.save(known, "known")
    counts = known.groupBy("cell", "label").count().groupBy("cell").agg(F.max_by("label", F.struct("count", "label")).alias("most"), F.count("*").alias("labels"))
    mixed = common.save(counts.where("labels > 1").select("cell", "most"), "mixed")
    open_ = common.save(known.hint("merge").join(mixed.hint("merge"), "cell").withColumn("left", F.col("label") != F.col("most")).drop("most"), "open")
    blocks = dealt(open_, "cell", "left", F.greatest("n", F.lit(HASHES >> 12)), HASHES).hint("merge").join(sets.hint("merge"), "node")
    return by_cell(blocks.select("cell", "i", "j", "left", "right", "node", "n", "label", "set"), 3, across, "a long, b long").distinct()


def shingle_sets(rows: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, set) of wanted (node, row), a written table: the shingle hashes of the row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest as h

        for batch in batches:
            sets = [shingle_set(t, k, h).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"])

    texts = common.join_written(rows.select("row", "text"), wanted.select("node", "row"), "row").select("node", "text")
    return texts.mapInArrow(run, "node long, set array<long>")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose shingle sets have a Jaccard similarity of 0.8 or more, by both sets whole."""
    left, right = (sets.select(F.col("node").alias(c), F.col("set").alias(f"{c}_set")).hint("merge") for c in "ab")
    shared = F.size(F.array_intersect("a_set", "b_set"))
    both = pairs.hint("merge").join(left, "a").hint("merge").join(right, "b")
    return both.where(9 * shared >= 4 * (F.size("a_set") + F.size("b_set"))).select("a", "b")


def cluster(docs: DataFrame, k: int = 5, row: str | None = None) -> DataFrame:
    """(row, doc_id, component_id, first_row) of every row: groups linked by Jaccard similarity 0.8 of k-word shingles.

    Equal shingle sets are one node. Every node is replicated to its anchors, whose links
    form the first groups. Fingerprints of pairs at 0.8 lie farther apart than replicas can
    reach, so nodes with a band key in common meet in a cell as well: each cell proposes its
    middle member with each other one that is not in its group yet, so a group of copies
    costs as many checks as members. Then, in cells that hold several groups, all members of
    different groups are compared on their sets, within a task; only links come out of it.
    Every link holds on the exact sets. Cells with very many members are compared in blocks.
    ``row`` names a column of row numbers; without it the rows are numbered and written here.

    component_id is the smallest doc_id of the group (nulls ignored; null if all are),
    first_row the row that bears it. Null or empty texts are one group. Texts shorter than
    k words: one shingle of all words. Empty table: no rows. Extra columns are ignored.
    """
    if row is None:
        docs, row = common.save_numbered(docs)
    common.bound_batches(docs.sparkSession)
    rows = docs.select(docs[row].alias("row"), docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    marks = common.save(sketches(rows, k), "sketches")
    same = [F.first(c).alias(c) for c in ("n", *WORDS, "keys")]
    nodes = common.save(marks.groupBy("mark").agg(first_bearer(), *same).withColumn("node", F.monotonically_increasing_id()), "nodes")
    anchored = common.save(links(nodes.select("node", "w0"), NEAR_BAND, NEAR_BITS, NEAR_LIMIT), "anchored")
    cells = nodes.select(F.explode("keys").alias("cell"), "node")
    shared = common.save(cells.groupBy("cell").count().where("count > 1"), "shared")
    met = common.save(cells.hint("merge").join(shared.hint("merge"), "cell"), "met")
    ends = met.select("node").unionByName(anchored.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    some = common.save(nodes.hint("merge").join(ends.hint("merge"), "node", "left_semi").select("node", F.col("first.row").alias("row"), "n", *WORDS), "some")
    sets = common.save(shingle_sets(rows, some, k), "sets")
    edges = common.save(verified(anchored, sets), "links")
    members = common.save(met.hint("merge").join(some.drop("row").hint("merge"), "node").select("cell", "count", "node", "n", *WORDS), "members")
    pairs = common.save(apart(star_pairs(members), components(edges)), "pairs")
    edges = edges.unionByName(common.save(verified(pairs, sets), "links"))
    labels = components(edges)
    more = common.save(across_links(members, labels, sets), "links")
    if not more.isEmpty():
        # only the groups that the new links join; every node then takes the name of its group's group
        name = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in"))
        between = more.hint("merge").join(name("a").hint("merge"), "a", "left").hint("merge").join(name("b").hint("merge"), "b", "left")
        joined = components(between.select(F.coalesce("a_in", "a").alias("a"), F.coalesce("b_in", "b").alias("b"))).toDF("component", "whole")
        renamed = labels.hint("merge").join(joined.hint("merge"), "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
        # ends that were in no group before
        labels = renamed.unionByName(joined.hint("merge").join(labels.select(F.col("node").alias("component")).hint("merge"), "component", "left_anti").toDF("node", "component"))
    return marks.select("row", "doc_id", "mark").hint("merge").join(named(nodes, labels, ["mark"]).hint("merge"), "mark").drop("mark")


def exact_links(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex), component_id: 3-word shingles, links at 2 bits or fewer, complete."""
    found = hamming_cluster(docs, k=3, words=1, bands=[contiguous(0, LENGTH)], threshold=2, limit=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("w0"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, k: int = 5) -> DataFrame:
    """One row of each near-duplicate group (the smallest doc_id's), with all columns.

    Null and empty texts are one group. Null doc_ids come last in their group; of rows that
    repeat doc_id and text one stays. Very long texts are compared whole. Empty table: no
    rows. Other columns go along, whatever their names.
    """
    rows, name = common.save_numbered(docs)
    return common.without_rows(rows, name, cluster(rows, k, name).where("row <> first_row"))
