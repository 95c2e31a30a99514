"""WARC archives with one Zstandard frame per record and a dictionary in the leading skippable frame.

Writing: pages with equal payloads form a group; the largest page_id is written as a
response record, the others as revisit records that refer to it. Reading: the dictionary
is loaded from the first frame where that is skippable (raw, or itself
Zstandard-compressed); later skippable frames are passed over, and one data frame after the
other is decoded. Each record's version line, required headers, lengths and digests are
checked; a violation raises ValueError. Records of any type and of other producers are
read: header names in any case, folded lines, no payload headers.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pergament.llm import common

# Frame magics of the format and names of WARC headers.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
SKIPPABLE = 0x184D2A50  # with any last hexadecimal digit
VERSION, VERSIONS = b"WARC/1.1", (b"WARC/1.0", b"WARC/1.1")
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
REPEATABLE = ("warc-concurrent-to",)
PAGE = "urn:x-page:"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"  # the tables hold no crawl time
ROLL = 64 << 20  # an archive is closed at the first record beyond so many bytes


def train_dictionary(pages: DataFrame, rows: int = 400, longest: int = 16_384, size: int = 32_768) -> bytes:
    """Dictionary fitted on at most ``rows`` payloads of at most ``longest`` bytes (6.6 MB at most).

    Chosen by the hash of their text, so reruns agree: first the smallest hashes, which are
    all that every task sends, then one payload for each. Too few samples to train on: empty.
    """
    import zstandard

    short = pages.select("html").where(F.octet_length("html").between(64, longest)).withColumn("h", F.xxhash64("html"))
    hashes = [r["h"] for r in short.select("h").distinct().orderBy("h").limit(rows).collect()]
    if not hashes:
        return b""
    few = short.where(F.col("h") <= max(hashes)).groupBy("h").agg(F.min("html").alias("html"))
    picked = [r["html"].encode() for r in sorted(few.collect(), key=lambda r: r["h"])]
    try:
        return zstandard.train_dictionary(size, picked).as_bytes() if len(picked) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def record(page_id, url, payload: bytes, kind: str, digest: str, refers_to=None) -> bytes:
    """Bytes of one record; a revisit carries no payload, only its length and digest."""
    name = f"{PAGE}{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid4()}"
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)))
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Bytes", len(payload))]
    block = HTTP_HEAD
    if kind == "revisit":
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{PAGE}{refers_to}>")]
    else:
        block += payload
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in head)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(lines: list[bytes]) -> dict[str, str]:
    """Fields by lower-case name; a folded line continues the one before."""
    fields, name = {}, None
    for line in lines:
        if line[:1] in (b" ", b"\t") and name:
            fields[name] += " " + line.decode().strip()
            continue
        name, colon, value = line.decode().partition(":")
        name = name.strip().lower()
        if not colon or not name:
            raise ValueError(f"malformed header {line!r}")
        if name in fields and name not in REPEATABLE:
            raise ValueError(f"header {name} stands twice")
        fields[name] = f"{fields[name]}, {value.strip()}" if name in fields else value.strip()
    return fields


def check_digest(data: bytes, stated: str | None, what: str) -> None:
    """ValueError where a stated sha1, sha256 or md5 digest is not that of ``data``; others are not checked."""
    algorithm, colon, value = (stated or "").partition(":")
    if not colon or algorithm.lower() not in ("sha1", "sha256", "md5"):
        return
    raw = hashlib.new(algorithm.lower(), data).digest()
    if value.lower() not in (raw.hex(), base64.b32encode(raw).decode().lower(), base64.b32encode(raw).decode().rstrip("=").lower()):
        raise ValueError(f"{what} does not match its digest")


def parse(data: bytes) -> dict:
    """fields, payload (None for a revisit) of one record, checked.

    The payload is what follows the HTTP header in an HTTP block, else the whole block.
    """
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or lines[0] not in VERSIONS:
        raise ValueError("not a WARC record")
    fields = headers(lines[1:])
    if missing := [k for k in REQUIRED if not fields.get(k)]:
        raise ValueError(f"record lacks {missing}")
    n = fields["content-length"]
    if not (n.isascii() and n.isdigit()) or len(rest) != int(n) + 4 or rest[int(n) :] != b"\r\n\r\n":
        raise ValueError("Content-Length does not match the block")
    block = rest[: int(n)]
    check_digest(block, fields.get("warc-block-digest"), "block")
    if fields["warc-type"].lower() == "revisit":
        return {"fields": fields, "payload": None}
    payload, chunked = block, False
    if fields.get("content-type", "").lower().startswith("application/http"):
        http, sep, payload = block.partition(b"\r\n\r\n")
        if not sep:
            raise ValueError("block has no HTTP header")
        chunked = b"transfer-encoding:" in http.lower()
    if "x-payload-bytes" in fields and fields["x-payload-bytes"] != str(len(payload)):
        raise ValueError("payload does not match its length")
    if not chunked:  # producers disagree whether the digest is of the transferred or the plain bytes
        check_digest(payload, fields.get("warc-payload-digest"), "payload")
    return {"fields": fields, "payload": payload}


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


class Writer:
    """One archive file: the dictionary frame, then a frame per record."""

    def __init__(self, folder: str, dictionary: bytes):
        import zstandard

        self.path = f"{folder}/pages-{uuid.uuid4().hex}.warc.zst"  # a name of its own for every task attempt
        self.fs, inner = common.open_fs(self.path)
        self.fs.create_dir(inner.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(inner, compression=None)
        packed = zstandard.ZstdCompressor().compress(dictionary) if dictionary else b""
        self.out.write(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.zip = zstandard.ZstdCompressor(level=3, dict_data=known, write_checksum=True)
        self.bytes = self.records = 0

    def add(self, data: bytes) -> None:
        self.bytes += self.out.write(self.zip.compress(data))
        self.records += 1

    def close(self) -> pa.RecordBatch:
        self.out.close()
        return pa.RecordBatch.from_pydict({"path": [self.path], "records": [self.records], "bytes": [self.bytes]})


def read_file(path: str, piece: int = 1 << 20) -> Iterator[dict]:
    """Checked records of one archive, one in memory at a time."""
    import zstandard

    fs, inner = common.open_fs(path)
    with fs.open_input_stream(inner, compression=None) as file:
        held, dictionary, first = b"", b"", True

        def ready(n: int) -> bool:
            """Whether ``n`` bytes are held, after reading on; none left at a frame's start ends the file."""
            nonlocal held
            while len(held) < n and (more := file.read(piece)):
                held += more
            if 0 < len(held) < n or (n > 4 and len(held) < n):
                raise ValueError(f"{path}: the last frame is cut off")
            return len(held) >= n

        unzip = zstandard.ZstdDecompressor()
        while ready(4):
            magic = int.from_bytes(held[:4], "little")
            if magic & ~15 == SKIPPABLE:
                ready(8)
                n = int.from_bytes(held[4:8], "little")
                held = held[8:]
                if first and magic == DICTIONARY_MAGIC and n:
                    ready(max(n, 5))
                    dictionary = held[:n]
                    if dictionary[:4] == FRAME_MAGIC:
                        dictionary = whole_frame(dictionary)
                    unzip = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
                while n > len(held):  # other skippable frames may be of any size
                    n -= len(held)
                    held = file.read(piece)
                    if not held:
                        raise ValueError(f"{path}: the last frame is cut off")
                held, first = held[n:], False
                continue
            first, frame, got = False, unzip.decompressobj(), []
            try:
                while True:
                    got.append(frame.decompress(held))
                    if frame.eof:
                        held = frame.unused_data
                        break
                    held = file.read(piece)
                    if not held:
                        raise ValueError(f"{path}: the last frame is cut off")
            except zstandard.ZstdError as e:
                raise ValueError(f"{path}: {e}") from e
            yield parse(b"".join(got))


def whole_frame(data: bytes) -> bytes:
    import zstandard

    try:
        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    except zstandard.ZstdError as e:
        raise ValueError(f"dictionary frame: {e}") from e


def roles(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """(page_id, url, html, size, kind, refers_to) of every page.

    Equal payloads are found by SHA-256 and length, summed up before the shuffle and
    written; the join back is then a plain sort-merge join, whose large partitions Spark
    splits when one payload is very common. Null html is an empty payload; a null page_id counts as smaller than any;
    rows that repeat the largest page_id are all responses.
    """
    sized = common.need(pages, page_id="long", url="string", html="string").withColumn("html", F.coalesce("html", F.lit("")))
    sized = sized.withColumns({"key": F.sha2("html", 256), "size": F.octet_length("html").cast("long")})
    last = common.save(sized.groupBy("key", "size").agg(F.max("page_id").alias("last")), "last-pages")
    joined = sized.hint("merge").join(last.hint("merge"), ["key", "size"])
    first = F.col("page_id").eqNullSafe(F.col("last")) | (F.col("size") < min_payload)
    return joined.select("page_id", "url", "html", "size", F.when(first, "response").otherwise("revisit").alias("kind"), F.when(~first, F.col("last")).alias("refers_to"))


def write(pages: DataFrame, folder: str | None = None, min_payload: int = 0) -> DataFrame:
    """Write the archives; returns the manifest (path, records, bytes) of committed files.

    A file of a failed or speculative attempt has a name of its own and is in no manifest.
    Empty table: no files. Extra columns are ignored.
    """
    spark = pages.sparkSession
    folder = folder or common.new_path(spark, "warc")
    dictionary = train_dictionary(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = None
        for batch in batches:
            for page_id, url, html, kind, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                payload = html.encode()
                file = file or Writer(folder, dictionary)
                file.add(record(page_id, url, payload, kind, base32_sha1(payload), refers_to))
                if file.bytes >= ROLL:
                    yield file.close()
                    file = None
        if file:
            yield file.close()

    common.bound_batches(spark)
    rows = roles(pages, min_payload).select("page_id", "url", "html", "kind", "refers_to")
    return common.save(rows.mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


def records(spark: SparkSession, archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every record of archives (path): record_id, record_type, date, uri, refers_to, payload_bytes, payload_digest[, payload].

    payload_bytes and payload_digest (bare base32 SHA-1) are of the payload; of a revisit
    they are what its headers state, null where they state none. A file that breaks the
    format raises ValueError.
    """
    schema = "record_id string, record_type string, date string, uri string, refers_to string, payload_bytes long, payload_digest string" + (", payload binary" if with_payload else "")
    types = [*[pa.string()] * 5, pa.int64(), pa.string(), pa.binary()][: 8 if with_payload else 7]
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def rows(path: str) -> Iterator[tuple]:
        for x in read_file(path):
            f, data = x["fields"], x["payload"]
            stated = f.get("warc-payload-digest", "")
            size = len(data) if data is not None else int(f["x-payload-bytes"]) if f.get("x-payload-bytes", "").isdigit() else None
            digest = base32_sha1(data) if data is not None else stated[5:] if stated.lower().startswith("sha1:") else None
            yield f["warc-record-id"], f["warc-type"], f["warc-date"], f.get("warc-target-uri"), f.get("warc-refers-to"), size, digest, data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for row in rows(path):
                    held.append(row[: len(types)])
                    size += len(row[7] or b"") if with_payload else 0
                    if len(held) >= 500 or size > 32 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)

    n = max(1, spark.sparkContext.defaultParallelism * 4)
    return archives.select("path").repartition(n, "path").mapInArrow(run, schema)


def read(spark: SparkSession, manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to[, payload]) of the archives that ``write`` made."""
    number = lambda c: F.regexp_extract(c, f"^<{PAGE}(-?[0-9]+)>$", 1).try_cast("long")
    more = ["payload"] if with_payload else []
    return records(spark, manifest, with_payload).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), *more)
