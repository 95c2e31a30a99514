"""License scan by diagonal voting, in DataFrame functions only.

Every rolling word 2-gram hash of a text is joined to the positions of the same 2-gram in
the templates (words checked, so a hash collision adds nothing). A hit at text position p
and template position t votes for diagonal p - t. Votes of neighbouring diagonals (up to
``DRIFT`` apart: a few words inserted or left out) are merged to one occurrence, and its span
is verified by the share of the template's 2-grams that it holds in their order. A phrase
stands exactly where its diagonal alone has every 2-gram.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# Opening or grant sentences of public licenses, lower case, words only.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu", "gnu-notice"),
    ("this work is licensed under a creative commons attribution", "cc-attribution"),
    ("licensed under the creative commons attribution", "cc-attribution"),
    ("released under the mit license", "mit"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("unauthorized copying of this file via any medium is strictly prohibited", "proprietary"),
)
DRIFT = 3
MIN_SHARE = 0.8
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ASCII_OTHER = "".join(chr(c) for c in range(128) if not chr(c).isalnum() or chr(c).isupper())
HEADER = -1  # template number of the row that stands for the document itself


def lower_ascii(text):
    """Lower case as far as word splitting and ASCII words can tell.

    lower() agrees with an A-Z lowering on every ASCII character; the two other
    characters whose lower case holds an ASCII letter are replaced first.
    """
    return F.lower(F.translate(text, "Kİ", "éé"))


def words(text):
    """Array of words of a lower-cased text; null and empty text: empty array."""
    bare = F.btrim(text, F.lit(ASCII_OTHER))
    return F.when(F.length(bare) > 0, F.split(bare, SEPARATOR)).otherwise(F.array().cast("array<string>"))


def template_positions(spark: SparkSession, templates) -> DataFrame:
    """(gram, template, t, w0, w1, n_grams, label, base): a few hundred rows whatever the corpus."""
    rows = [("", "", HEADER, HEADER, 0, "", False)]
    for k, (phrase, label, base) in enumerate(templates):
        w = phrase.split(" ")
        if not 2 <= len(w) <= 64:
            raise ValueError("a template has 2 to 64 words")
        rows += [(a, b, k, t, len(w) - 1, label, base) for t, (a, b) in enumerate(zip(w, w[1:]))]
    df = spark.createDataFrame(rows, "w0 string, w1 string, template int, t int, n_grams int, label string, base boolean")
    return df.withColumn("gram", F.xxhash64("w0", "w1"))


def votes(docs: DataFrame, templates) -> DataFrame:
    """One row per document (template HEADER) and one per voted diagonal.

    (row, doc_id, n_words, template, n_grams, label, base, diagonal, votes, seen, first_at,
    last_at); seen is a bit mask of the template positions hit on the diagonal, first_at and
    last_at the places of its first and last 2-gram. Each 2-gram is exploded with its own
    two words alone, so time grows with the length of a text.
    """
    table = template_positions(docs.sparkSession, templates)

    def gram(at, w0, w1):
        return F.struct(at.cast("int").alias("at"), F.xxhash64(w0, w1).alias("gram"), w0.alias("u"), w1.alias("v"))

    none = F.lit("")
    grams = F.concat(F.array(gram(F.lit(HEADER), none, none)), F.zip_with("words", F.transform(F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))), lambda w, i: F.struct(i.alias("at"), w.alias("w"))), lambda u, x: gram(x.at, u, x.w)))
    hits = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(lower_ascii(F.col("text").cast("string"))).alias("words"))
        .withColumn("row", F.monotonically_increasing_id())
        .select("row", "doc_id", F.size("words").cast("long").alias("n_words"), grams.alias("grams"))
        .select("row", "doc_id", "n_words", F.inline("grams"))
        .join(F.broadcast(table), "gram")
        .where((F.col("u") == F.col("w0")) & (F.col("v") == F.col("w1")))
        .select("row", "doc_id", "n_words", "template", "n_grams", "label", "base", "t", "at", (F.col("at") - F.col("t")).alias("diagonal"))
    )
    return (
        hits.repartition("row")
        .groupBy("row", "doc_id", "n_words", "template", "n_grams", "label", "base", "diagonal")
        .agg(F.count("*").alias("votes"), F.expr("bit_or(shiftleft(1L, greatest(t, 0)))").alias("seen"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    )


def spans(docs: DataFrame, templates=None) -> DataFrame:
    """One row per occurrence of a template: ``votes`` with span, share, in_order and the verdict; and the HEADER rows, unfound.

    Diagonals up to DRIFT apart are one occurrence; it is told at the one that gathers most
    (ties: most votes of its own, then the smallest). start and end: first and last word of
    the span in the text, from 0. share: the part of the template's 2-grams that it holds.
    in_order: how many of them, less the places where the text goes back in the template.
    found: a base phrase needs all its 2-grams on its own diagonal, so each of its diagonals
    has a row; any other template needs MIN_SHARE of its 2-grams in order.
    """
    templates = templates or [(p, x, True) for p, x in BASE] + [(p, x, False) for p, x in TEMPLATES]
    near = Window.partitionBy("row", "template").orderBy("diagonal").rangeBetween(-DRIFT, DRIFT)
    weight = (F.bit_count("merged").cast("long") * 64 + F.col("votes")) * (1 << 40) - F.col("diagonal")
    told = votes(docs, templates).withColumns({"merged": F.bit_or("seen").over(near), "start": F.min("first_at").over(near), "end": F.max("last_at").over(near) + 1})
    told = told.withColumns({"weight": weight, "share": F.try_divide(F.bit_count("merged"), "n_grams")}).withColumn("most", F.max("weight").over(near))
    hopeful = ~F.col("base") & (F.col("share") >= MIN_SHARE)
    told = told.withColumn("parts", F.collect_list(F.when(F.bit_count("seen") > 0, F.struct("diagonal", "seen"))).over(near))
    one = told.where((F.col("template") == HEADER) | F.col("base") | (F.col("weight") == F.col("most")))

    def places(x):
        return F.transform(F.filter(F.sequence(F.lit(0), F.col("n_grams") - 1), lambda t: F.getbit(x["seen"], t) == 1), lambda t: F.struct((t + x["diagonal"]).alias("at"), t.alias("t")))

    ordered = F.sort_array(F.flatten(F.transform("parts", places)))
    back = F.aggregate(ordered, F.struct(F.lit(0).alias("n"), F.lit(-1).alias("t")), lambda s, x: F.struct((s["n"] + (x["t"] < s["t"]).cast("int")).alias("n"), x["t"].alias("t")))["n"]
    in_order = F.when(hopeful, F.bit_count("merged") - back)
    return (
        one.withColumn("in_order", in_order)
        .withColumn("share", F.when(F.col("template") == HEADER, 0.0).when(F.col("base"), F.col("votes") / F.col("n_grams")).otherwise(F.col("share")))
        .withColumn("found", (F.col("template") != HEADER) & F.when(F.col("base"), F.col("share") >= 1.0).otherwise(F.coalesce(F.try_divide("in_order", "n_grams") >= MIN_SHARE, F.lit(False))))
        .drop("weight", "most", "parts", "merged")
    )


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): words, base places, labels and score.

    Null or empty text: no words, no labels, score 0, null first_word and last_word. Null
    doc_ids stay null; repeated rows each give a row; an empty table gives none; other
    columns are ignored. score is the largest share of any template that the text holds.
    """
    base, found = F.col("found") & F.col("base"), F.col("found")

    def joined(cond):
        return F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("label")))), ",")

    return (
        spans(docs)
        .groupBy("row", "doc_id", "n_words")
        .agg(
            F.count_if(base).alias("n_base"),
            F.min(F.when(base, F.col("diagonal"))).cast("long").alias("first_word"),
            F.max(F.when(base, F.col("diagonal"))).cast("long").alias("last_word"),
            joined(base).alias("base_labels"),
            joined(found).alias("labels"),
            F.max("share").alias("score"),
        )
        .drop("row")
    )


def oracle() -> str:
    """DuckDB SQL for ``scan``: 2-grams joined by their words."""
    rows = []
    for k, (phrase, label, base) in enumerate([(p, x, True) for p, x in BASE] + [(p, x, False) for p, x in TEMPLATES]):
        w = phrase.split(" ")
        rows += [f"('{a}','{b}',{k},{t},{len(w) - 1},'{label}',{str(base).lower()})" for t, (a, b) in enumerate(zip(w, w[1:]))]
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH tpl(w0, w1, template, t, n_grams, label, base) AS (VALUES {", ".join(rows)}),
d AS (SELECT row_number() OVER () AS r, doc_id,
  list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT r, unnest(range(1, len(w))) AS i, w FROM d),
h AS (SELECT g.r, tpl.*, g.i - 1 - tpl.t AS diagonal FROM g JOIN tpl ON g.w[g.i] = tpl.w0 AND g.w[g.i + 1] = tpl.w1),
v AS (SELECT r, template, n_grams, label, base, diagonal, count(*) AS votes, bit_or(1::BIGINT << t) AS seen FROM h GROUP BY ALL),
m AS (SELECT *, bit_or(seen) OVER (PARTITION BY r, template ORDER BY diagonal RANGE BETWEEN {DRIFT} PRECEDING AND {DRIFT} FOLLOWING) AS merged FROM v),
k AS (SELECT *, (bit_count(merged)::BIGINT * 64 + votes) * 1099511627776 - diagonal AS weight, CASE WHEN base THEN votes / n_grams ELSE bit_count(merged) / n_grams END AS share FROM m),
o AS (SELECT * FROM k QUALIFY base OR weight = max(weight) OVER (PARTITION BY r, template ORDER BY diagonal RANGE BETWEEN {DRIFT} PRECEDING AND {DRIFT} FOLLOWING)),
x AS (SELECT o.r, o.template, o.diagonal, (h.t < lag(h.t) OVER (PARTITION BY o.r, o.template, o.diagonal ORDER BY h.t + h.diagonal, h.t))::INT AS back
  FROM o JOIN h ON o.r = h.r AND o.template = h.template AND h.diagonal BETWEEN o.diagonal - {DRIFT} AND o.diagonal + {DRIFT} WHERE NOT o.base AND o.share >= {MIN_SHARE}),
b AS (SELECT r, template, diagonal, coalesce(sum(back), 0) AS back FROM x GROUP BY ALL),
f AS (SELECT o.*, CASE WHEN base THEN share >= 1.0 ELSE share >= {MIN_SHARE} AND (bit_count(merged) - back) / n_grams >= {MIN_SHARE} END AS found FROM o LEFT JOIN b USING (r, template, diagonal))
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, count(*) FILTER (f.found AND f.base)::BIGINT AS n_base,
  min(f.diagonal) FILTER (f.found AND f.base)::BIGINT AS first_word, max(f.diagonal) FILTER (f.found AND f.base)::BIGINT AS last_word,
  coalesce(string_agg(DISTINCT f.label, ',' ORDER BY f.label) FILTER (f.found AND f.base), '') AS base_labels,
  coalesce(string_agg(DISTINCT f.label, ',' ORDER BY f.label) FILTER (f.found), '') AS labels,
  coalesce(max(f.share), 0)::DOUBLE AS score
FROM d LEFT JOIN f ON d.r = f.r GROUP BY d.r, d.doc_id, d.w"""
