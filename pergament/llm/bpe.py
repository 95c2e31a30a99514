"""Byte-level BPE encoding and decoding with a contiguous rank array per word.

A text is cut at special tokens, then into words by the vocabulary's pattern. A word is
coded as an array of part boundaries and an array of the ranks of adjacent pairs; the
smallest rank (leftmost on ties) is sought, its boundary deleted and the two neighbouring
ranks refreshed, until no pair has a rank. That scan is cheap on short words, and a bounded
memo keeps the ids of those seen before. A word of more than LONG bytes keeps its boundaries
as links and its ranks in a heap, with the same result in n log n time.
"""

from __future__ import annotations

import hashlib
import json
import re
from heapq import heapify, heappop, heappush
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pergament.llm import common

# Fixed value: the word pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = 1 << 60
LONG = 64  # longer words, in bytes, take the heap and stay out of the memo
# Fixed value: the only way of splitting that this codec follows.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in character of each byte, as vocabulary files of this kind write it."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + k): b for k, b in enumerate(rest)}


class Memo(dict):
    """Ids of short words as bytes, at most ``limit`` words of at most LONG bytes."""

    def __init__(self, merge, limit: int):
        self.merge, self.limit = merge, limit

    def __missing__(self, word: str) -> bytes:
        data = word.encode()
        ids = np.array(self.merge(data), dtype="<u4").tobytes()
        if len(data) <= LONG:
            if len(self) >= self.limit:
                self.clear()
            self[word] = ids
        return ids


def check_settings(data: dict) -> None:
    """ValueError where a vocabulary file asks for anything that ``Codec`` does not do."""
    model, pre = data["model"], data.get("pre_tokenizer") or {}
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    if data.get("normalizer") or model.get("type") != "BPE" or odd or any(pre.get(k) != v for k, v in BYTE_LEVEL.items()):
        raise ValueError("not a plain byte-level BPE vocabulary")
    if any(t.get(k) for t in data["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens with conditions of their own are not followed")


class Codec:
    """Encoder and decoder of one vocabulary file; made once in each Python worker."""

    def __init__(self, path: str, limit: int = 500_000):
        import regex

        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        check_settings(data)
        model, alphabet = data["model"], byte_alphabet()
        vocab = model["vocab"]
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.bytes_of = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items() if all(c in alphabet for c in t)}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.id_of_byte = [0] * 256
        for c, b in alphabet.items():
            self.id_of_byte[b] = vocab[c]
        self.ranks = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.find = regex.compile(PATTERN).findall
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.memo = Memo(self.merge, limit)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word."""
        return self.by_scan(word) if len(word) <= LONG else self.by_heap(word)

    def by_scan(self, word: bytes) -> list[int]:
        ids, get = [self.id_of_byte[b] for b in word], self.ranks.get
        none = (NONE, 0)
        ranks = [get(pair, none) for pair in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best[0] == NONE:
                break
            k = ranks.index(best)
            ids[k] = best[1]
            del ids[k + 1], ranks[k]
            if k < len(ranks):
                ranks[k] = get((ids[k], ids[k + 1]), none)
            if k:
                ranks[k - 1] = get((ids[k - 1], ids[k]), none)
        return ids

    def by_heap(self, word: bytes) -> list[int]:
        """As ``by_scan``. Parts are named by their first byte; heap entries that no longer hold are passed over."""
        ids, n = [self.id_of_byte[b] for b in word], len(word)
        after, before, ranks = list(range(1, n + 1)), list(range(-1, n - 1)), self.ranks
        heap = [ranks[pair][0] << 40 | k for k, pair in enumerate(zip(ids, ids[1:])) if pair in ranks]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            k = entry & (1 << 40) - 1
            m = after[k]
            if ids[k] < 0 or m >= n:
                continue
            got = ranks.get((ids[k], ids[m]))
            if got is None or got[0] != entry >> 40:
                continue
            ids[k], ids[m], after[k] = got[1], -1, after[m]
            if after[k] < n:
                before[after[k]] = k
            for left, right in ((before[k], k), (k, after[k])):
                if left >= 0 and right < n:
                    got = ranks.get((ids[left], ids[right]))
                    if got:
                        heappush(heap, got[0] << 40 | left)
        return [i for i in ids if i >= 0]

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian uint32; null and empty text: none."""
        get, out = self.memo.__getitem__, []
        pieces = self.cut.split(text or "") if self.cut else [text or ""]
        for k, piece in enumerate(pieces):
            out.append(self.special[piece].to_bytes(4, "little") if k % 2 else b"".join(map(get, self.find(piece))))
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """Text of some ids; bytes that are no UTF-8 become the replacement character, unknown ids nothing."""
        get = self.bytes_of.get
        return b"".join([get(i, b"") for i in ids]).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _mapped(df: DataFrame, columns: list[str], schema: str, row, rows: int = 1000) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, max(batch.num_rows, 1), rows):
                part = batch.slice(k, rows)
                yield row(part)

    return df.select(*columns).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids binary of little-endian uint32): a map over the scan, no shuffle.

    Null or empty text: no ids. Repeated doc_ids: one row each. Empty table: no rows. Very
    long texts and words: whole, in n log n time. Extra columns are ignored. A vocabulary
    with other settings than plain byte-level BPE raises ValueError.
    """

    def row(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path)
        return pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "ids": pa.array([c.encode(t) for t in batch.column(1).to_pylist()], pa.binary())})

    return _mapped(common.need(docs, doc_id="long", text="string"), ["doc_id", "text"], "doc_id long, ids binary", row)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give an empty text."""

    def row(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path)
        texts = [c.decode(np.frombuffer(x or b"", dtype="<u4").tolist()) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": pa.array(texts, pa.string())})

    return _mapped(encoded, ["doc_id", "ids"], "doc_id long, text string", row)


def digest(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document, both ways in one pass; see ``encode``."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def row(batch: pa.RecordBatch) -> pa.RecordBatch:
        c, n, a, b = codec(path), [], [], []
        for text in batch.column(1).to_pylist():
            ids = c.encode(text)
            n.append(len(ids) // 4)
            a.append(hashlib.sha256(ids).hexdigest())
            b.append(hashlib.sha256(c.decode(np.frombuffer(ids, dtype="<u4").tolist()).encode()).hexdigest())
        return pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())})

    return _mapped(common.need(docs, doc_id="long", text="string"), ["doc_id", "text"], schema, row)
