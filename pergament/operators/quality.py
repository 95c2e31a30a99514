"""Validation, quality gates and metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pergament.functions import tables as T
from pergament.functions import trie
from pergament.functions.numbers import rounded
from pergament.operators.dictionary import dealt
from pergament.sources.scratch import stored


def validate(records: DataFrame) -> DataFrame:
    """Q1. Adds errors (ordered) and is_valid. Addresses and the expiry date are not checked."""
    ok = {
        "idNumber": F.col("idNumber").rlike(r"^\d{12}$"), "fullName": F.size(F.filter(F.split("fullName", r"\s+"), lambda w: w != "")) >= 2, "dateOfBirth": F.try_to_date("dateOfBirth", "d/M/yyyy").isNotNull(),
        "gender": F.col("gender").isin(T.MALE, T.FEMALE), "nationality": F.col("nationality").isin("Viet Nam", T.COUNTRY),
    }
    errors = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), T.ERRORS[f]) for f, c in ok.items())))
    return records.withColumn("errors", errors).withColumn("is_valid", F.size("errors") == 0)


#: Fixed value: field names of earlier label files.
LEGACY_FIELDS = ("dateOfIssue", "issueDate", "placeOfIssue")


def check_label_schema(labels: DataFrame, required=T.FIELDS, legacy=LEGACY_FIELDS) -> DataFrame:
    """Q2. Adds missing, legacy (sorted arrays) and is_valid to rows with a fields map."""
    keys = F.coalesce(F.map_keys("fields"), F.array().cast("array<string>"))
    out = labels.withColumns({"missing": F.array_sort(F.array_except(F.array(*map(F.lit, required)), keys)), "legacy": F.array_sort(F.array_intersect(F.array(*map(F.lit, legacy)), keys))})
    bad = F.col("parse_error").isNotNull() if "parse_error" in labels.columns else F.lit(False)
    return out.withColumn("is_valid", ~bad & (F.size("missing") == 0) & (F.size("legacy") == 0))


def schema_summary(checked: DataFrame) -> DataFrame:
    """Q2. Total, valid and invalid counts."""
    return checked.agg(F.count("*").alias("total"), F.count_if("is_valid").alias("valid"), F.count_if(~F.col("is_valid")).alias("invalid"))


def avg_confidence(boxes: DataFrame, docs: DataFrame | None = None, by: str = "doc_id") -> DataFrame:
    """Q3. Mean of the parsable confidences within [0, 1], rounded to 4; 0 where there is none."""
    score = F.col("confidence").try_cast("double")
    out = boxes.groupBy(by).agg(F.coalesce(rounded(F.avg(F.when(score.between(0.0, 1.0), score)), 4), F.lit(0.0)).alias("avg_confidence"))
    if docs is None:
        return out
    return docs.select(by).distinct().hint("merge").join(out.hint("merge"), by, "left").select(by, F.coalesce("avg_confidence", F.lit(0.0)).alias("avg_confidence"))


def field_confidences(df: DataFrame) -> DataFrame:
    """Q4. (doc_id, confidences map) of (doc_id, field, confidence); unparsable is 0, rounded to 4; of repeated fields the largest counts."""
    score = F.round(F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0)), 4)
    one = df.groupBy("doc_id", "field").agg(F.max(score).alias("c"))
    return one.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "c")))).alias("confidences"))


def quality_gate(metrics: DataFrame, blur: float = 100.0, dark: float = 60.0) -> DataFrame:
    """Q5. Adds accepted and reason to (blur_score, brightness_score[, channels]); nulls are unreadable images."""
    reasons = F.array_compact(F.array(F.when(F.col("blur_score") < blur, "blurred"), F.when(F.col("brightness_score") < dark, "dark")))
    unread = F.col("blur_score").isNull() | F.col("brightness_score").isNull()
    reason = F.when(unread, "unreadable")
    if "channels" in metrics.columns:
        reason = reason.when(~F.col("channels").isin(1, 3, 4), "unsupported")
    reason = reason.otherwise(F.when(F.size(reasons) > 0, F.array_join(reasons, " and ")))
    return metrics.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def split_gate(gated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Q5. Accepted rows and rejected rows, for separate later stages."""
    return gated.where("accepted").drop("reason"), gated.where("NOT accepted")


def blur_band(df: DataFrame, column: str = "blur_score") -> DataFrame:
    """Q6. Adds band: very_blurred below 35, blurred below 80, soft below 150, else sharp."""
    c: Column = F.col(column)
    return df.withColumn("band", F.when(c < 35, "very_blurred").when(c < 80, "blurred").when(c < 150, "soft").when(c.isNotNull(), "sharp"))


def pick_variant(scores: DataFrame, retry: float = 7.0, margin: float = 1.5) -> DataFrame:
    """Q8. (doc_id, variant 0 or 1, score, rotation) to the chosen variant, both scores and the rotation mod 360.

    Variant 0 stays at retry or more; else variant 1 wins only when it leads by the margin.
    """
    at = lambda v, c: F.max(F.when(F.col("variant") == v, F.col(c)))
    both = scores.groupBy("doc_id").agg(at(0, "score").alias("initial"), at(1, "score").alias("rotated"), at(0, "rotation").alias("r0"), at(1, "rotation").alias("r1"))
    second = (F.col("initial") < retry) & (F.col("rotated") >= F.col("initial") + margin)
    second = F.coalesce(second, F.lit(False))
    return both.select(
        "doc_id", F.when(second, 1).otherwise(0).alias("variant"), "initial", F.when(F.col("initial") < retry, F.col("rotated")).alias("rotated"),
        F.when(second, F.col("rotated")).otherwise(F.col("initial")).alias("selected"), F.pmod(F.when(second, F.col("r0") + F.col("r1")).otherwise(F.col("r0")), F.lit(360)).alias("rotation"),
    )


def term_hits(corpus: DataFrame, terms: list[str], key: str = "path") -> DataFrame:
    """Q9. (key, line_no from 1, term, line) of every line that holds a term; the terms are a short list, see ``term_table_hits`` for a table."""
    lines = corpus.select(key, F.posexplode(F.split("text", "\n")).alias("n", "line"))
    some = reduce(lambda a, b: a | b, (F.contains("line", F.lit(t)) for t in terms))
    held = F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(F.col("line"), t))
    return lines.where(some).select(key, (F.col("n") + 1).alias("line_no"), F.explode(held).alias("term"), "line")


GRAM = 4  # letters of the piece of a term that is looked up
STRETCH = 1 << 16  # letters of a line whose pieces are held at once
FEW_VALUES, FEW_BYTES = 1_000_000, 16 << 20  # terms up to which each task has them all, and their bytes
LONGEST = 4096  # bytes of a term in such a table


def numbered_terms(terms: DataFrame) -> DataFrame:
    """(term, number) of the distinct terms; empty ones and nulls are left out."""
    known = terms.select(F.col("term").cast("string").alias("term")).where("term <> ''").distinct()
    return stored(known.withColumn("number", F.monotonically_increasing_id()), "terms")


def term_grams(known: DataFrame) -> DataFrame:
    """(term, gram, at, size): of each distinct term one piece of GRAM letters, the one that fewest terms have, and its place.

    Shorter terms are their own piece.
    """
    sized = known.select("term").withColumn("size", F.least(F.length("term"), F.lit(GRAM)))
    starts = F.sequence(F.lit(1), F.length("term") - F.col("size") + 1)
    pieces = sized.select("term", "size", F.explode(starts).alias("at")).withColumn("gram", F.expr("substring(term, at, size)"))
    shared = pieces.groupBy("gram").agg(F.count_distinct("term").alias("n"))
    best = pieces.join(shared.hint("merge"), "gram").groupBy("term").agg(F.min(F.struct("n", "gram", "at", "size")).alias("b"))
    return stored(best.select("term", "b.gram", "b.at", "b.size"), "terms")


def term_table_hits(corpus: DataFrame, terms: DataFrame, key: str = "path", shown: Callable[[Column], Column] | None = None) -> DataFrame:
    """Q9 for a table of terms, of any number: (key, line_no from 1, term, line) of every line that holds a term.

    A term counts once a line. Lines are dealt evenly first, since a file of one row group
    would leave them to one task. ``shown`` says what stands for a line in the result; it is
    worked out once a line, not once a hit. Up to FEW_VALUES terms each task has them as a
    trie (``functions.trie``) that is walked from all places of its lines together, so work
    grows with the text and the hits; beyond that pieces go to terms by shuffle (``term_pieces``).
    """
    known = numbered_terms(terms)
    n, size, longest = known.agg(F.count("*"), F.sum(F.octet_length("term")), F.max(F.octet_length("term"))).first()
    lines = dealt(corpus.select(key, F.posexplode(F.split("text", "\n")).alias("n", "line")), key, "n")
    lines = lines.withColumn("shown", shown(F.col("line")) if shown else F.col("line"))
    if not n:
        return lines.select(key, (F.col("n") + 1).alias("line_no"), F.lit("").alias("term"), F.col("shown").alias("line")).where("false")
    if n <= FEW_VALUES and size <= FEW_BYTES and longest <= LONGEST:
        found = terms_held(lines, known).withColumn("number", F.explode("numbers")).join(F.broadcast(known), "number")
    else:
        found = term_pieces(lines, term_grams(known), key)
    return found.select(key, (F.col("n") + 1).alias("line_no"), "term", F.col("shown").alias("line"))


def terms_held(lines: DataFrame, known: DataFrame) -> DataFrame:
    """Lines without their text, with the numbers of the terms that each holds, each term once; lines without any go."""
    # a line holds no line end, so a term with one is in none
    table = known.where(~F.contains("term", F.lit("\n"))).select("number", F.col("term").cast("binary")).toArrow()
    shared = known.sparkSession.sparkContext.broadcast((trie.grown(*trie.packed(table["term"])), table["number"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grown, numbers = shared.value
        for batch in batches:
            data, starts, sizes = trie.packed(batch["line"])
            rest = batch.drop_columns(["line"])
            for first, counts, terms in trie.held(grown, data, starts + sizes):
                some = np.flatnonzero(counts)
                ends = np.concatenate([[0], np.cumsum(counts[some])]).astype(np.int32)
                found = pa.ListArray.from_arrays(pa.array(ends), pa.array(numbers[terms]))
                yield rest.take(pa.array(first + some)).append_column("numbers", found)

    ended = lines.withColumn("line", F.concat("line", F.lit("\n")).cast("binary"))
    schema = ended.drop("line").withColumn("numbers", F.lit(None).cast("array<long>")).schema
    return ended.mapInArrow(run, schema)


def term_pieces(lines: DataFrame, grams: DataFrame, key: str) -> DataFrame:
    """Hits of any number of terms: every distinct piece of GRAM letters of a line meets one chosen piece a term.

    The whole term is compared where it fits. Pieces go to terms by shuffle, as numbers and
    stretches alone, and come back to their lines by ``key``, which must be unique.
    """
    sizes = sorted(r[0] for r in grams.select("size").distinct().collect())  # 1 to GRAM
    # the pieces of a line at once, each one once; a very long line is cut into stretches first
    stretch = F.sequence(F.lit(0), F.greatest(F.length("line") - 1, F.lit(0)), F.lit(STRETCH))
    cut = lines.withColumn("begin", F.explode(stretch)).withColumn("t", F.substring(F.col("line"), F.col("begin") + 1, F.lit(STRETCH + GRAM - 1)))
    pieces = F.concat(*(F.regexp_extract_all("t", F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1)) for k in sizes))
    spread = cut.withColumn("gram", F.explode(F.array_distinct(pieces)))
    met = spread.select(key, "n", "begin", "gram").hint("merge").join(grams.hint("merge"), "gram").select(key, "n", "begin", "at", "term")
    found = met.hint("merge").join(lines.hint("merge"), [key, "n"])
    # of a line of several stretches in that where the piece of its first place begins
    first = F.contains("line", "term") & (F.expr(f"octet_length(line) <= {STRETCH}") | F.expr(f"locate(term, line) + at - 1 - begin BETWEEN 1 AND {STRETCH}"))
    return found.where(first)


def files_with(corpus: DataFrame, terms: list[str], key: str = "path") -> DataFrame:
    """Q9. (key, term) of every text that holds a term, without splitting into lines."""
    held = F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(F.col("text"), t))
    return corpus.select(key, F.explode(held).alias("term")).distinct()


def migrate_terms(corpus: DataFrame, replacements: list[tuple[str, str]]) -> DataFrame:
    """Q10. Replacements in order; adds changed and gives the new text. Write only the changed rows, to a new path."""
    new = reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), replacements, F.col("text"))
    return corpus.withColumn("__new", new).withColumn("changed", ~F.col("__new").eqNullSafe(F.col("text"))).withColumn("text", F.col("__new")).drop("__new")


def write_changed(migrated: DataFrame, path: str) -> int:
    """Q10. Writes changed rows to a new folder; returns their number."""
    migrated.where("changed").write.parquet(path)
    return migrated.sparkSession.read.parquet(path).count()
