"""Sources and sinks: label files, capture intake, OCR output, text corpora, results with an error branch."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pergament.functions import tables as T
from pergament.functions import text as X
from pergament.sources.files import list_files, read_lines, read_whole
from pergament.sources.scratch import stored

# ---- S1


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """S1. (path, sample_id, document_type, fields map, parse_error), one JSON object per .json file below ``path``.

    Small files are packed into few tasks; empty files have rows too. Both {"fields": {...}} and flat objects; a leading byte-order mark is accepted; anything
    that is no JSON object is a row with parse_error.
    """
    listed = list_files(spark, path).where(F.lower("path").endswith(".json"))
    return parse_labels(read_whole(listed).select("path", F.col("content").try_cast("string").alias("value")))


def parse_labels(files: DataFrame) -> DataFrame:
    """S1 for (path, value) rows; null values are no objects either."""
    files = files.withColumn("value", F.regexp_replace("value", "^﻿", ""))
    root = F.from_json("value", "map<string,string>", {"mode": "PERMISSIVE"})
    good = F.trim("value").startswith("{") & F.try_parse_json("value").isNotNull()
    nested = F.from_json(F.get_json_object("value", "$.fields"), "map<string,string>")
    flat = F.map_filter(root, lambda k, v: ~k.isin("sampleId", "documentType", "fields"))
    fields = F.when(good, F.coalesce(nested, flat))
    return files.select("path", F.when(good, F.get_json_object("value", "$.sampleId")).alias("sample_id"), F.when(good, F.get_json_object("value", "$.documentType")).alias("document_type"), fields.alias("fields"), F.when(~F.coalesce(good, F.lit(False)), "not a JSON object").alias("parse_error"))


# ---- S2

EXTENSIONS = ("jpg", "jpeg", "png")  # fixed values: accepted capture files


def intake(files: DataFrame, max_mb: float = 10) -> DataFrame:
    """S2. (path, length, ext, accepted, reason); contents are never read."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    rows = files.select("path", "length", ext.alias("ext"))
    reason = F.when(~F.col("ext").isin(*EXTENSIONS), "unsupported extension").when(F.col("length").isNull() | (F.col("length") == 0), "empty file").when(F.col("length") > max_mb * 1024 * 1024, "file too large")
    return rows.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def read_captures(spark: SparkSession, path: str, max_mb: float = 10) -> DataFrame:
    """S2 for a folder and all below it, empty files included."""
    return intake(list_files(spark, path), max_mb)


# ---- S3


def explode_boxes(df: DataFrame, column: str = "items", key: str = "doc_id", normalize: bool = True) -> DataFrame:
    """S3. (key, box_id, text, original_text, confidence, corners), one row per text box; blank text dropped.

    column holds an array of structs (box, text, confidence), or a struct of parallel
    arrays (texts, scores, boxes) that are cut to the shortest.
    """
    kind = df.schema[column].dataType.typeName()
    if kind == "array":
        rows = df.select(key, F.posexplode(column).alias("box_id", "i")).select(key, "box_id", F.col("i.text").alias("original_text"), F.col("i.confidence").alias("confidence"), F.col("i.box").alias("corners"))
    else:
        c = F.col(column)
        n = F.least(F.size(c["texts"]), F.size(c["scores"]), F.size(c["boxes"]))
        zipped = F.slice(F.arrays_zip(c["texts"].alias("t"), c["scores"].alias("s"), c["boxes"].alias("b")), 1, F.greatest(n, F.lit(0)))
        rows = df.select(key, F.posexplode(zipped).alias("box_id", "i")).select(key, "box_id", F.col("i.t").alias("original_text"), F.col("i.s").alias("confidence"), F.col("i.b").alias("corners"))
    text = X.normalize_text("original_text") if normalize else F.trim("original_text")
    return X.kept(rows, "text", text, X.filled).select(key, "box_id", "text", "original_text", "confidence", "corners")


# ---- S4


DETAILS = ("raw_text", "text_boxes", "field_results", "metadata")


def as_success_record(df: DataFrame) -> DataFrame:
    """S4. (doc_id, status, data struct, is_valid, errors) of validated records, and any of DETAILS that ``df`` has."""
    more = [c for c in DETAILS if c in df.columns]
    return df.select("doc_id", F.lit("success").alias("status"), F.struct(*T.FIELDS).alias("data"), "is_valid", "errors", *more)


def with_details(df: DataFrame, lines: DataFrame | None = None, boxes: DataFrame | None = None, fields: DataFrame | None = None, metadata: DataFrame | None = None) -> DataFrame:
    """S4. Adds what a result document also holds, for ``as_success_record``; each table is packed by document.

    raw_text: lines(doc_id, line_no, line) in order. text_boxes: boxes(doc_id, box_id, text,
    confidence, edges). field_results: fields(doc_id, field, value, source). metadata: the
    other columns of metadata(doc_id, ...), one row a document. Documents without rows have null.
    """
    packed = []
    if lines is not None:
        packed.append(lines.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x.line).alias("raw_text")))
    if boxes is not None:
        packed.append(boxes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("box_id", "text", "confidence", "left", "top", "right", "bottom"))).alias("text_boxes")))
    if fields is not None:
        packed.append(fields.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("field", "value", "source"))).alias("field_results")))
    if metadata is not None:
        packed.append(metadata.select("doc_id", F.struct(*(c for c in metadata.columns if c != "doc_id")).alias("metadata")))
    for table in packed:
        df = df.hint("merge").join(table.hint("merge"), "doc_id", "left")
    return df


def as_error_record(df: DataFrame) -> DataFrame:
    """S4. (doc_id, message) to the same shape: every field null, the message as the only error."""
    empty = F.struct(*(F.lit(None).cast("string").alias(f) for f in T.FIELDS))
    return df.select("doc_id", F.lit("error").alias("status"), empty.alias("data"), F.lit(False).alias("is_valid"), F.array(F.coalesce("message", F.lit("unknown error"))).alias("errors"))


def write_results(success: DataFrame, failed: DataFrame, path: str, kind: str = "parquet") -> None:
    """S4. One table partitioned by status."""
    rows = as_success_record(success).unionByName(as_error_record(failed), allowMissingColumns=True)
    rows.write.partitionBy("status").format(kind).save(path)


# ---- S5

CHARSETS = ("cp1258", "cp1252", "latin-1")  # fixed values, tried in this order


def _decoder(charsets: tuple[str, ...]):
    @F.pandas_udf("text string, charset string")
    def decode(s: pd.Series) -> pd.DataFrame:
        def one(x):
            for name in charsets if x is not None else ():
                try:
                    return bytes(x).decode(name), name
                except UnicodeDecodeError:
                    continue
            return None, None

        return pd.DataFrame([one(x) for x in s], columns=["text", "charset"])

    return decode


def decode_fallback(files: DataFrame, charsets: tuple[str, ...] = CHARSETS, content: str = "content") -> DataFrame:
    """S5. (path, text, charset): UTF-8 natively, its byte-order mark removed; only other files go through Python."""
    utf8 = F.is_valid_utf8(F.col(content).cast("string"))
    native = files.where(utf8).select("path", F.regexp_replace(F.col(content).cast("string"), "^﻿", "").alias("text"), F.lit("utf-8").alias("charset"))
    rest = files.where(~utf8).select("path", _decoder(charsets)(F.col(content)).alias("d")).select("path", "d.text", "d.charset")
    return native.unionByName(rest)


def read_text_fallback(spark: SparkSession, path: str, charsets: tuple[str, ...] = CHARSETS) -> DataFrame:
    """S5 for a folder and all below it: one row a file."""
    return decode_fallback(read_whole(list_files(spark, path)), charsets)


def read_lines_fallback(spark: SparkSession, path: str, charsets: tuple[str, ...] = CHARSETS) -> DataFrame:
    """S5 for large text files: (path, offset, text, charset) of every line, read in byte ranges.

    The charset is chosen for the whole file, the first that all its lines can be decoded
    with, so a file is decoded as ``read_text_fallback`` does it.
    """
    lines = stored(read_lines(list_files(spark, path)), "lines")
    told = lines.withColumn("able", able_charsets(charsets)(F.col("line"))).groupBy("path").agg(F.expr("bit_and(able)").alias("able"))
    names = F.array(*map(F.lit, ("utf-8", *charsets)))
    first = F.get(F.filter(F.transform(names, lambda n, k: F.when(F.getbit("able", k) == 1, n)), lambda n: n.isNotNull()), F.lit(0))
    known = lines.hint("merge").join(told.select("path", first.alias("charset")).hint("merge"), "path")
    utf8 = known.where("charset = 'utf-8'").select("path", "offset", F.regexp_replace(F.col("line").cast("string"), "^\ufeff", "").alias("text"), "charset")
    rest = known.where("charset <> 'utf-8'").select("path", "offset", _recoder()(F.col("line"), F.col("charset")).alias("text"), "charset")
    return utf8.unionByName(rest).unionByName(known.where("charset IS NULL").select("path", "offset", F.lit(None).cast("string").alias("text"), "charset"))


def able_charsets(charsets: tuple[str, ...]):
    """Bit k of a line says that the k-th charset, UTF-8 first, can decode it."""

    @F.pandas_udf("int")
    def able(s: pd.Series) -> pd.Series:
        def one(x: bytes) -> int:
            bits = 0
            for k, name in enumerate(("utf-8", *charsets)):
                try:
                    bytes(x).decode(name)
                    bits |= 1 << k
                except UnicodeDecodeError:
                    pass
            return bits

        return s.map(one)

    return able


def _recoder():
    @F.pandas_udf("string")
    def recode(s: pd.Series, charset: pd.Series) -> pd.Series:
        return pd.Series([bytes(x).decode(c) for x, c in zip(s, charset)])

    return recode


def fence_strip(df: DataFrame, column: str = "text") -> DataFrame:
    """S5. Lines that are code fences go, all others stay in order."""
    kept = F.filter(F.split(column, "\n"), lambda x: ~F.rlike(x, F.lit(r"^\s*```")))
    return df.withColumn(column, F.array_join(kept, "\n"))


def decode_summary(df: DataFrame) -> DataFrame:
    """S5. Counts of files that were UTF-8, converted or undecodable."""
    state: Column = F.when(F.col("charset").isNull(), "failed").when(F.col("charset") == "utf-8", "already_utf8").otherwise("converted")
    return df.groupBy(state.alias("state")).count()
