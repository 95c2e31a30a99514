"""Fill-in-middle transformation over seekable compressed frames.

A text is stored as independent zstandard frames of UNITS code points with the cumulative
count at the end of each. A cut decompresses only the frame that it falls into; ranges are
streamed frame by frame, so of a very long text one frame at a time is in memory beside
the compressed ones. The output is written as such frames too, and the text is rebuilt from
output and form alone.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pergament.llm import common

UNITS = 16_384
LEVEL = 3
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN_FROM, SPM_BELOW = 90, 20  # of 100


def starts(data: bytes) -> np.ndarray | None:
    """Byte offsets of the code points; None where each is one byte."""
    return None if data.isascii() else np.flatnonzero((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)


def count(data: bytes) -> int:
    return len(data) if data.isascii() else len(starts(data))


def byte_at(data: bytes, unit: int) -> int:
    """Offset of a code point; that of the end is the length."""
    at = starts(data)
    return min(unit, len(data)) if at is None else int(at[unit]) if unit < len(at) else len(data)


class Frames:
    """Compressed frames of a text and the number of code points up to the end of each."""

    def __init__(self, frames: list[bytes], ends: list[int]):
        self.frames, self.ends, self.unpack = frames, ends, zstandard.ZstdDecompressor().decompress

    @property
    def units(self) -> int:
        return self.ends[-1] if self.ends else 0

    def stream(self, start: int = 0, end: int | None = None) -> Iterator[bytes]:
        """Code points ``start`` to ``end`` in order; frames outside are not touched."""
        end = self.units if end is None else end
        k = bisect_right(self.ends, start)
        while start < end:
            first = self.ends[k - 1] if k else 0
            data = self.unpack(self.frames[k])
            stop = min(end, self.ends[k])
            low = byte_at(data, start - first) if start > first else 0
            yield data[low : byte_at(data, stop - first)] if stop < self.ends[k] else data[low:]
            start, k = stop, k + 1

    def find(self, marker: bytes, start: int = 0) -> int:
        """Code point at which ``marker`` first stands from ``start`` on, across frames too; -1 if nowhere."""
        tail, at = b"", start
        for data in self.stream(start):
            joined = tail + data
            found = joined.find(marker)
            if found >= 0:
                return at - count(tail) + count(joined[:found])
            at += count(data)
            tail = joined[-(len(marker) - 1) :]
            while tail and tail[0] & 0xC0 == 0x80:  # a marker begins with a whole code point
                tail = tail[1:]
        return -1


class FrameWriter:
    """Cuts what is written into frames of UNITS code points."""

    def __init__(self, units: int = UNITS):
        self.units, self.pack = units, zstandard.ZstdCompressor(level=LEVEL).compress
        self.frames, self.ends, self.held, self.n = [], [], bytearray(), 0

    def write(self, data: bytes) -> None:
        while data:
            cut = byte_at(data, self.units - self.n)
            piece, data = data[:cut], data[cut:]
            self.held += piece
            self.n += count(piece)
            if self.n == self.units:
                self.flush()

    def flush(self) -> None:
        if self.n:
            self.frames.append(self.pack(bytes(self.held)))
            self.ends.append((self.ends[-1] if self.ends else 0) + self.n)
            self.held, self.n = bytearray(), 0

    def close(self) -> Frames:
        self.flush()
        return Frames(self.frames, self.ends)


def framed(chunks: Iterator[bytes], units: int = UNITS) -> Frames:
    out = FrameWriter(units)
    for chunk in chunks:
        out.write(chunk)
    return out.close()


def text_frames(data: bytes, units: int = UNITS) -> Frames:
    """``framed`` of one text, cut at offsets found once."""
    at = starts(data)
    n = len(data) if at is None else len(at)
    edges = [*range(0, n, units), n] if n else []
    offsets = edges if at is None else [*at[edges[:-1]].tolist(), len(data)] if n else []
    pack = zstandard.ZstdCompressor(level=LEVEL).compress
    return Frames([pack(data[a:b]) for a, b in zip(offsets, offsets[1:])], edges[1:])


def decision(doc_id: int | None, n: int, marked: bool) -> tuple[str, int, int]:
    """Form, and the ends of prefix and middle, of a text of ``n`` code points; ``marked`` if a marker stands in it."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in range(0, 32, 8))
    if not n or marked or h3 % 100 >= PLAIN_FROM:
        return "plain", n, n
    return ("spm" if h4 % 100 < SPM_BELOW else "psm"), *sorted((h1 % (n + 1), h2 % (n + 1)))


def output(text: Frames, form: str, a: int, b: int) -> Iterator[bytes]:
    """The transformed text, chunk by chunk."""
    if form == "plain":
        yield from text.stream()
        return
    parts = {PREFIX: (0, a), SUFFIX: (b, text.units), MIDDLE: (a, b)}
    if form == "psm":
        for marker, span in parts.items():
            yield marker
            yield from text.stream(*span)
    else:
        yield SUFFIX
        yield from text.stream(*parts[SUFFIX])
        yield PREFIX
        yield from text.stream(*parts[PREFIX])
        yield MIDDLE
        yield from text.stream(*parts[MIDDLE])


def restored(out: Frames, form: str) -> Iterator[bytes]:
    """The text again, from the output and its form; ValueError where a marker is missing."""
    if form == "plain":
        yield from out.stream()
        return
    markers = (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE)
    at = []
    for marker in markers:
        at.append(out.find(marker, at[-1] + 3 if at else 0))
        if at[-1] < 0:
            raise ValueError(f"no {marker.decode()} in the output")
    spans = dict(zip(markers, zip((x + 3 for x in at), [*at[1:], out.units])))
    for marker in (PREFIX, MIDDLE, SUFFIX):
        yield from out.stream(*spans[marker])


def digest(chunks: Iterator[bytes]) -> str:
    got = hashlib.sha256()
    for chunk in chunks:
        got.update(chunk)
    return got.hexdigest()


STORE = "doc_id long, n long, form string, prefix_end long, middle_end long, frames array<binary>, ends array<long>"


def store(docs: DataFrame, units: int = UNITS) -> DataFrame:
    """(doc_id, n, form, prefix_end, middle_end, frames, ends) of every row: its text as frames, and where it is cut.

    Null text: empty, of no frame and plain. A null doc_id is hashed as no digits. Repeated
    rows: one row each. Very long texts: whole, as many frames as they need. Empty table: no
    rows. Extra columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(6)]
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = data or b""
                text = text_frames(data, units)
                form, a, b = decision(doc_id, text.units, any(m in data for m in (PREFIX, SUFFIX, MIDDLE)))
                for column, value in zip(columns, (text.units, form, a, b, text.frames, text.ends)):
                    column.append(value)
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=["doc_id", "n", "form", "prefix_end", "middle_end", "frames", "ends"])

    narrow = common.need(docs, doc_id="long", text="string")
    return narrow.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, STORE)


def transform(stored: DataFrame, units: int = UNITS) -> DataFrame:
    """(doc_id, form, frames, ends) of ``store``: the outputs, as frames again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [framed(output(Frames(f, e), form, a, b), units) for form, a, b, f, e in zip(*(c.to_pylist() for c in batch.columns[1:]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.frames for x in done], pa.list_(pa.binary())), pa.array([x.ends for x in done], pa.list_(pa.int64()))], names=["doc_id", "form", "frames", "ends"])

    return stored.select("doc_id", "form", "prefix_end", "middle_end", "frames", "ends").mapInArrow(run, "doc_id long, form string, frames array<binary>, ends array<long>")


def texts(framed_rows: DataFrame) -> DataFrame:
    """(doc_id, text) of rows with frames and ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                data = b"".join(Frames(one.column(1)[0].as_py(), one.column(2)[0].as_py()).stream())
                yield pa.RecordBatch.from_arrays([one.column(0), pa.array([data.decode()], pa.string())], names=["doc_id", "text"])

    return framed_rows.select("doc_id", "frames", "ends").mapInArrow(run, "doc_id long, text string")


def restore(outputs: DataFrame, units: int = UNITS) -> DataFrame:
    """(doc_id, frames, ends): the original texts, from ``transform``'s outputs and forms alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [framed(restored(Frames(f, e), form), units) for form, f, e in zip(*(c.to_pylist() for c in batch.columns[1:]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.frames for x in done], pa.list_(pa.binary())), pa.array([x.ends for x in done], pa.list_(pa.int64()))], names=["doc_id", "frames", "ends"])

    return outputs.select("doc_id", "form", "frames", "ends").mapInArrow(run, "doc_id long, frames array<binary>, ends array<long>")


def digests(docs: DataFrame, units: int = UNITS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every row, see ``store``.

    The frames are written to the shared folder and read back; outputs are streamed from
    them, and the restored text is streamed from the output's frames and its form.
    """
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second, third, fourth = [], [], [], []
            for form, a, b, frames, ends in zip(*(c.to_pylist() for c in batch.columns[2:])):
                plain = form == "plain"
                out = framed(output(Frames(frames, ends), form, a, b), units)
                first.append(None if plain else a)
                second.append(None if plain else b - a)
                third.append(digest(out.stream()))
                fourth.append(digest(restored(out, form)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(third, pa.string()), pa.array(fourth, pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
            )

    return common.save(store(docs, units), "frames", "uncompressed").mapInArrow(run, schema)


def oracle() -> str:
    """DuckDB SQL for ``digests`` on the table documents."""
    return r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, text, length(text) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
f AS (SELECT doc_id, text, n, CASE WHEN n = 0 OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
  least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM u),
p AS (SELECT *, left(text, a) AS pre, substring(text, a + 1, b - a) AS mid, substring(text, b + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE pre || mid || suf END) AS restored_sha256
FROM p"""
