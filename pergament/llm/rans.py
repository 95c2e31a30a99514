"""Static range asymmetric numeral system (rANS) for token-id streams.

One frequency table, made from the counts of all tokens, is shared by every file. A
file (segment) holds whole documents in ascending doc_id order, cut into independent
blocks of ``BLOCK`` tokens. In a block, token i belongs to lane i % LANES; every lane has
its own 64-bit state and all lanes of a block share one stream of 32-bit words. The
footer holds a checkpoint per block (byte offset, first token, token count, CRC-32 of the
tokens), so any block can be decoded alone and checked.

Segment layout (little endian):
  magic 'RNS1' | blocks | zlib(doc_id int64[], n_tokens int64[]) | checkpoints | tail
  block: final lane states uint64[LANES], then words uint32[]
  tail: first token of the segment, docs, blocks, offsets, CRC of table and of footer
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pergament.llm import common
from pergament.llm.bpe import byte_alphabet

MAGIC = b"RNS1"
SCALE = 20  # frequencies sum to 2**SCALE; more than any vocabulary has entries
LANES = 64
BLOCK = 1 << 15
GROUP = 32  # blocks that are coded side by side as one numpy vector
SEGMENT = 1 << 21  # a segment is closed at the first document end beyond so many tokens
LOW = np.uint64(1 << 31)
CHECKPOINT = np.dtype([("offset", "<u8"), ("start", "<u8"), ("n", "<u4"), ("words", "<u4"), ("crc", "<u4")])
TAIL = struct.Struct("<QQIQQIII4s")


def quantise(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies that sum to 2**scale; every counted symbol gets at least 1.

    The remainder of rounding goes to the largest counts (ties: smallest id), so the
    table depends on the counts alone. All counts zero: an all-zero table.
    """
    counts = np.asarray(counts, dtype=np.int64)
    total, whole = int(counts.sum()), 1 << scale
    present = np.flatnonzero(counts)
    if len(present) > whole:
        raise ValueError("more symbols than the frequency table can hold")
    freq = np.zeros(len(counts), dtype=np.int64)
    if not total:
        return freq
    spare = whole - len(present)
    share = counts[present].astype(np.float64) / total * spare
    freq[present] = 1 + np.floor(share).astype(np.int64)
    rest = whole - int(freq.sum())
    order = present[np.lexsort((present, -counts[present]))]
    freq[order] += rest // len(order)
    freq[order[: rest % len(order)]] += 1
    return freq


class Table:
    """Frequencies, cumulative frequencies and the slot-to-symbol table."""

    def __init__(self, freq: np.ndarray):
        self.freq = np.append(freq, 1 << SCALE).astype(np.uint64)  # the last is the padding symbol
        self.cum = np.zeros(len(self.freq), dtype=np.uint64)
        self.cum[1:-1] = np.cumsum(freq)[:-1]
        self.slots = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.crc = zlib.crc32(np.asarray(freq, dtype="<u4").tobytes())


def encode_blocks(ids: np.ndarray, table: Table) -> list[tuple[int, np.ndarray, np.ndarray, int]]:
    """(token count, final states, words, CRC-32) of each block of ``ids``."""
    out = []
    pad = len(table.freq) - 1
    s, sixty3 = np.uint64(SCALE), np.uint64(63 - SCALE)
    for at in range(0, len(ids), BLOCK * GROUP):
        part = ids[at : at + BLOCK * GROUP]
        n_blocks = -(-len(part) // BLOCK)
        size = BLOCK if n_blocks > 1 else -(-len(part) // LANES) * LANES
        grid = np.full(n_blocks * size, pad, dtype=np.uint32)
        grid[: len(part)] = part
        grid = grid.reshape(n_blocks, size // LANES, LANES).transpose(1, 0, 2)
        state = np.full((n_blocks, LANES), LOW, dtype=np.uint64)
        words = np.empty(grid.shape, dtype=np.uint32)
        sent = np.empty(grid.shape, dtype=bool)
        for t in range(len(grid) - 1, -1, -1):
            f = table.freq[grid[t]]
            m = state >= (f << sixty3)
            sent[t], words[t] = m, state  # the low half is what is sent
            np.right_shift(state, np.uint64(32), out=state, where=m)
            q = state // f
            state = (q << s) + (state - q * f) + table.cum[grid[t]]
        for b in range(n_blocks):
            own = part[b * BLOCK : (b + 1) * BLOCK]
            out.append((len(own), state[b], words[:, b][sent[:, b]], zlib.crc32(own.astype("<u4").tobytes())))
    return out


def decode_blocks(blocks: list[tuple[int, np.ndarray, np.ndarray, int]], table: Table) -> np.ndarray:
    """The tokens of some blocks, in order; a wrong checksum raises ValueError."""
    s, mask = np.uint64(SCALE), np.uint64((1 << SCALE) - 1)
    counts = np.array([b[0] for b in blocks], dtype=np.int64)
    state = np.stack([b[1] for b in blocks]).astype(np.uint64)
    first = np.cumsum([0] + [len(b[2]) for b in blocks])
    words = np.append(np.concatenate([b[2] for b in blocks]), np.uint32(0)).astype(np.uint64)
    at = first[:-1].copy()
    steps = int(-(-counts.max() // LANES)) if len(blocks) else 0
    got = np.zeros((len(blocks), steps, LANES), dtype=np.uint32)
    lane = np.arange(LANES)
    even = int(counts.min()) // LANES
    pad = np.uint32(len(table.freq) - 1)
    for t in range(steps):
        slot = state & mask
        sym = table.slots[slot]
        if t >= even:
            sym = np.where(t * LANES + lane[None, :] < counts[:, None], sym, pad)
        got[:, t] = sym
        state = table.freq[sym] * (state >> s) + slot - table.cum[sym]
        m = state < LOW
        take = np.cumsum(m, axis=1)
        fresh = words[np.minimum(at[:, None] + take - 1, len(words) - 1)]
        state = np.where(m, (state << np.uint64(32)) | fresh, state)
        at += take[:, -1]
    if (at != first[1:]).any() or (state != LOW).any():
        raise ValueError("a block did not end in its start state")
    out = []
    for b, (n, _, _, crc) in enumerate(blocks):
        ids = got[b].reshape(-1)[:n]
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError("checksum of a block does not match")
        out.append(ids)
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)


def segment_bytes(start: int, doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, table: Table) -> Iterator[bytes]:
    yield MAGIC
    offset, first, checks = len(MAGIC), start, []
    for n, state, words, crc in encode_blocks(ids, table):
        data = state.astype("<u8").tobytes() + words.astype("<u4").tobytes()
        checks.append((offset, first, n, len(words), crc))
        offset, first = offset + len(data), first + n
        yield data
    docs = zlib.compress(doc_ids.astype("<i8").tobytes() + lengths.astype("<i8").tobytes(), 3)
    index = np.array(checks, dtype=CHECKPOINT).tobytes()
    yield docs
    yield index
    yield TAIL.pack(start, len(doc_ids), len(checks), offset, offset + len(docs), table.crc, zlib.crc32(docs + index), SCALE, MAGIC)


class Segment:
    """Footer of an open segment file; blocks are read by their checkpoints when asked for.

    A damaged footer, or one written with another frequency table, raises ValueError; a
    damaged block does so when it is decoded, and only then.
    """

    def __init__(self, file, table: Table, name: str = "segment"):
        self.file, self.table = file, table
        size = file.size()
        self.start, n_docs, _, docs_at, index_at, table_crc, crc, scale, magic = TAIL.unpack(file.read_at(TAIL.size, size - TAIL.size))
        footer = file.read_at(size - TAIL.size - docs_at, docs_at)
        if magic != MAGIC or bytes(file.read_at(4, 0)) != MAGIC or zlib.crc32(footer) != crc:
            raise ValueError(f"{name}: damaged segment")
        if table_crc != table.crc or scale != SCALE:
            raise ValueError(f"{name}: written with another frequency table")
        docs = np.frombuffer(zlib.decompress(footer[: index_at - docs_at]), dtype="<i8")
        self.doc_ids, self.lengths = docs[:n_docs], docs[n_docs:]
        self.checkpoints = np.frombuffer(footer[index_at - docs_at :], dtype=CHECKPOINT)

    def blocks(self, first: int, last: int) -> Iterator[np.ndarray]:
        """Tokens of the blocks ``first`` to ``last`` (exclusive), GROUP blocks at a time."""
        for k in range(first, last, GROUP):
            some = []
            for c in self.checkpoints[k : min(k + GROUP, last)]:
                data = self.file.read_at(LANES * 8 + 4 * int(c["words"]), int(c["offset"]))
                some.append((int(c["n"]), np.frombuffer(data, "<u8", LANES), np.frombuffer(data, "<u4", offset=LANES * 8), int(c["crc"])))
            yield decode_blocks(some, self.table)

    def tokens(self, start: int, end: int) -> np.ndarray:
        """Tokens ``start`` to ``end`` (exclusive), numbered as in the archive: the blocks that hold them are decoded, no other."""
        firsts = self.checkpoints["start"].astype(np.int64)
        first, last = int(np.searchsorted(firsts, start, "right")) - 1, int(np.searchsorted(firsts, end, "left"))
        if start < self.start or end > self.start + int(self.lengths.sum()):
            raise ValueError("these tokens are not all in this segment")
        if end <= start:
            return np.zeros(0, dtype=np.uint32)
        at = int(firsts[first])
        return np.concatenate(list(self.blocks(first, last)))[start - at : end - at]


def read_segment(path: str, table: Table) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(first token, doc_ids, token counts, tokens) of a whole segment."""
    fs, inner = common.open_fs(path)
    with fs.open_input_file(inner) as file:
        segment = Segment(file, table, path)
        parts = list(segment.blocks(0, len(segment.checkpoints)))
    ids = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)
    return segment.start, segment.doc_ids, segment.lengths, ids


def read_tokens(manifest: DataFrame, freq: np.ndarray, start: int, end: int) -> DataFrame:
    """(start, ids) of the archive's tokens ``start`` to ``end`` (exclusive), in pieces of GROUP blocks at most.

    Each piece is a row of its own before it is decoded, so tasks share one segment; every
    task reads a footer and, by its checkpoints, the blocks of its pieces. Tokens that no
    segment holds give no rows.
    """
    shared = manifest.sparkSession.sparkContext.broadcast(freq)
    size = GROUP * BLOCK
    low, high = F.greatest("first", F.lit(start)), F.least(F.col("first") + F.col("n_tokens"), F.lit(end))
    named = manifest.select("path", F.col("start").alias("first"), "n_tokens").withColumns({"low": low, "high": high}).where("low < high")
    piece = F.col("first") + (F.col("k") * size)
    steps = F.sequence(F.floor((F.col("low") - F.col("first")) / size), F.floor((F.col("high") - 1 - F.col("first")) / size))
    pieces = named.withColumn("k", F.explode(steps)).select("path", F.greatest("low", piece).alias("low"), F.least("high", piece + size).alias("high"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(shared.value)
        for batch in batches:
            for path, low, high in zip(*(c.to_pylist() for c in batch.columns)):
                fs, inner = common.open_fs(path)
                with fs.open_input_file(inner) as file:
                    ids = Segment(file, table, path).tokens(low, high)
                yield pa.RecordBatch.from_arrays([pa.array([low], pa.int64()), pa.array([ids.astype(np.int32)], pa.list_(pa.int32()))], names=["start", "ids"])

    n = max(1, manifest.sparkSession.sparkContext.defaultParallelism * 4)
    return pieces.repartition(n).mapInArrow(run, "start long, ids array<int>")


# The settings of a vocabulary file that ``WordEncoder`` follows word by word.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": PIECES}, "behavior": "Removed", "invert": True}
MARKS = b".,;:!?"  # a mark behind letters is a piece of its own
SHORT = 64  # longer words, in bytes, stay out of the memo


def word_by_word(data: dict) -> bool:
    """Whether a vocabulary file has the settings above, under which no token spans ASCII white space."""
    pre = (data.get("pre_tokenizer") or {}).get("pretokenizers", [])
    plain = all(t["content"].startswith("<|") and not any(c.isspace() for c in t["content"]) and not any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")) for t in data["added_tokens"])
    last = len(pre) == 2 and pre[1].get("type") == "ByteLevel" and not pre[1].get("add_prefix_space") and not pre[1].get("use_regex")
    return data.get("normalizer") == NORMALIZER and last and pre[0] == SPLIT and plain and data["model"].get("type") == "BPE"


class Pieces(dict):
    """Ids of the pieces of words, by the library's BPE model; at most ``limit`` entries."""

    def __init__(self, tok, limit: int):
        alphabet = byte_alphabet()
        self.tokenize, self.limit = tok.model.tokenize, limit
        self.letters = str.maketrans({chr(b): c for c, b in alphabet.items()})

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        plain = piece.isascii() and piece.isprintable()  # such bytes stand for themselves
        ids = [t.id for t in self.tokenize(piece if plain else piece.encode().decode("latin-1").translate(self.letters))]
        ids = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= SHORT:
            self[piece] = ids
        return ids


class Words(dict):
    """Ids of white-space separated words, in two generations of at most ``limit`` words.

    When the young generation is full it becomes the old one, and old words that are met
    again come back, so frequent words stay and memory is bounded.
    """

    def __init__(self, tok, limit: int):
        import regex

        self.tok, self.limit, self.old, self.pieces = tok, limit, {}, Pieces(tok, limit)
        self.find, self.latin = regex.compile(PIECES).findall, re.compile("[\0-\u024f]*").fullmatch

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None and word.isalpha():  # ASCII letters alone
            ids = self.pieces[word.lower().decode()]
        elif ids is None and word[-1] in MARKS and word[:-1].isalpha():
            low = word.lower().decode()
            ids = self.pieces[low[:-1]] + self.pieces[low[-1]]
        elif ids is None:
            text = word.decode()
            if self.latin(text) and "<|" not in text:  # composed already, so lower case is all that is left
                low = text.lower()
                ids = self.pieces[low] if low.isalpha() else b"".join(map(self.pieces.__getitem__, self.find(low)))
            else:
                ids = np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(word) > SHORT:
            return ids
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


class WordEncoder:
    """The library's tokenizer, word by word where the vocabulary's settings allow it, else text by text.

    Normalising, the BPE model and any unusual word (beyond Latin letters, or with special
    tokens in it) are the library's; its ids are kept word by word in a bounded memo, and
    the ids of a text are those of its words in order. Any vocabulary with other settings
    is given whole texts.
    """

    def __init__(self, path: str, limit: int = 500_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            whole = not word_by_word(json.load(file))
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.memo = None if whole else Words(self.tok, limit)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian uint32 ids of each text; a null text has none."""
        if self.memo is None:
            return [np.array(self.tok.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
        get = self.memo.__getitem__
        return [b"".join(map(get, t.encode().split())) if t else b"" for t in texts]


_encoders: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def pack(ids: bytes) -> bytes:
    """uint32 ids, as uint16 where all fit; the last byte tells which."""
    wide = np.frombuffer(ids, dtype="<u4")
    return ids + b"4" if len(wide) and wide.max() >= 1 << 16 else wide.astype("<u2").tobytes() + b"2"


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype="<u4" if data[-1:] == b"4" else "<u2", count=len(data) // (4 if data[-1:] == b"4" else 2))


def tokenize(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(part, doc_id, local_start, n_tokens, ids): range partitions in ascending doc_id order.

    Equal doc_ids are spread by a row number as second key, so that one id with very many
    rows does not fill one partition. ids is packed, see ``pack``.
    """
    ordered = (
        common.need(docs, doc_id="long", text="string")
        .withColumn("row", F.monotonically_increasing_id())
        .repartitionByRange("doc_id", "row")
        .sortWithinPartitions("doc_id", "row")
        .drop("row")
        .withColumn("part", F.spark_partition_id())
    )
    schema = "part int, doc_id long, local_start long, n_tokens long, ids binary"
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, at = word_encoder(tokenizer), 0
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                rows = batch.slice(k, 500).to_pydict()
                starts, counts, packed = [], [], []
                for ids in encoder.encode(rows["text"]):
                    ids += end
                    starts.append(at)
                    counts.append(len(ids) // 4)
                    at += counts[-1]
                    packed.append(pack(ids))
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(rows["part"], pa.int32()), "doc_id": pa.array(rows["doc_id"], pa.int64()),
                    "local_start": pa.array(starts, pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "ids": pa.array(packed, pa.binary()),
                })

    return ordered.select("part", "doc_id", "text").mapInArrow(run, schema)


def token_counts(tokens: DataFrame) -> DataFrame:
    """(id, n) over all documents: counted in each task, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, dtype=np.int64)
        for batch in batches:
            packed = batch.column(0).to_pylist()
            for k in range(0, len(packed), 200):
                got = np.bincount(np.concatenate([unpack(data).astype(np.uint32) for data in packed[k : k + 200]]))
                if len(got) > len(total):
                    total = np.pad(total, (0, len(got) - len(total)))
                total[: len(got)] += got
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(used, pa.int64()), "n": pa.array(total[used], pa.int64())})

    return tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_archive(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> tuple[DataFrame, np.ndarray]:
    """Encode, count, code and write all documents; returns (manifest, frequency table).

    manifest: (path, start, n_docs, n_tokens, bytes), one row per segment file, whose names
    sort as the documents do. What the driver gathers: one count per vocabulary entry and
    one token total per partition.

    Null text: no tokens but the end id. Null doc_id: sorts first. Repeated doc_ids: each
    row keeps its own run of tokens. Empty table: no segments. Extra columns are ignored.
    """
    spark = docs.sparkSession
    folder = folder or common.new_path(spark, "rans")
    tokens = common.save(tokenize(docs, tokenizer, end_id), "tokens", "none")
    counted = {r["id"]: r["n"] for r in token_counts(tokens).collect()}
    counts = np.zeros(max(counted, default=0) + 1, dtype=np.int64)
    counts[list(counted)] = list(counted.values())
    freq = quantise(counts)
    common.write_atomic(folder, "frequencies.u4", [freq.astype("<u4").tobytes()])
    base, at = {}, 0
    for r in tokens.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():
        base[r["part"]], at = at, at + r["n"]
    shared = spark.sparkContext.broadcast((freq, base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq, base = shared.value
        table = Table(freq)
        first = then = 0
        doc_ids, lengths, parts, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            name = f"seg-{first:020d}-{len(doc_ids):08d}.rans"
            known = np.array([np.iinfo(np.int64).min if d is None else d for d in doc_ids], dtype=np.int64)
            size = common.write_atomic(folder, name, segment_bytes(first, known, np.array(lengths), np.concatenate(parts), table))
            row = {"path": [f"{folder}/{name}"], "start": [first], "n_docs": [len(doc_ids)], "n_tokens": [held], "bytes": [size]}
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for part, doc_id, start, n, data in zip(*(batch.column(k).to_pylist() for k in range(5))):
                start += base[part]
                if doc_ids and (start != then or held >= SEGMENT):
                    yield close()
                    doc_ids, lengths, parts, held = [], [], [], 0
                if not doc_ids:
                    first = start
                doc_ids.append(doc_id)
                lengths.append(n)
                parts.append(unpack(data))
                held, then = held + n, start + n
        if doc_ids:
            yield close()

    manifest = tokens.select("part", "doc_id", "local_start", "n_tokens", "ids").mapInArrow(run, "path string, start long, n_docs long, n_tokens long, bytes long")
    return common.save(manifest, "rans-manifest"), freq


def read_archive(spark: SparkSession, manifest: DataFrame, freq: np.ndarray, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) decoded from the segment files, one task a few segments."""
    shared = spark.sparkContext.broadcast(freq)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(shared.value)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                start, doc_ids, lengths, ids = read_segment(path, table)
                ends = np.cumsum(lengths)
                raw, starts = ids.astype("<u4"), start + ends - lengths
                cut = list(zip((ends - lengths).tolist(), ends.tolist()))
                cols = {
                    "doc_id": pa.array([None if d == np.iinfo(np.int64).min else d for d in doc_ids.tolist()], pa.int64()), "start": pa.array(starts, pa.int64()),
                    "n_tokens": pa.array(lengths, pa.int64()), "ids_crc32": pa.array([zlib.crc32(raw[a:b].tobytes()) for a, b in cut], pa.int64()),
                }
                if with_ids:
                    cols["ids"] = pa.array([raw[a:b].astype(np.int32) for a, b in cut], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(cols)

    n = max(1, spark.sparkContext.defaultParallelism * 4)
    return manifest.select("path").repartition(n, "path").mapInArrow(run, schema)
