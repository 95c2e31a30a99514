"""Queries of the box-table operators (B1 to B18) and label search (A1 to A9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pergament.functions import tables as T
from pergament.functions import text as X
from pergament.operators import boxes as B
from pergament.operators import labels as A
from pergament.operators.dictionary import remembered
from pergament.plans import text_queries as TQ
from pergament.plans import views as V
from pergament.functions.numbers import rounded
from pergament.plans.registry import query, rounded_sql
from pergament.sources.scratch import stored_by

BOX = "doc_id, box_id, text"
CY, CX = '("top" + bottom) / 2', '("left" + "right") / 2'


def slim(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "box_id", "text")


CORNERS = "array(array(`right`, bottom), array(`left`, top), array(`right`, top), array(`left`, bottom))"


@query(f'WITH {V.BOXES_SQL} SELECT doc_id, box_id, "left", top, "right" - "left" AS width, bottom - top AS height, {CX} AS center_x, {CY} AS center_y, greatest(least(confidence * 3 - 1, 1), 0)::DOUBLE AS confidence FROM boxes WHERE trim(text) <> \'\'')
def b1_normalize(spark, sf_dir):
    raw = V.boxes(spark, sf_dir).select("doc_id", "box_id", "text", F.expr(CORNERS).alias("corners"), (F.col("confidence") * 3 - 1).alias("confidence"))
    return B.normalize_boxes(raw).select("doc_id", "box_id", "left", "top", "width", "height", "center_x", "center_y", "confidence")


@query(f"WITH {V.BOXES_SQL} SELECT {BOX} FROM boxes WHERE confidence >= 0.5")
def b2_confidence(spark, sf_dir):
    return slim(B.filter_confidence(V.boxes(spark, sf_dir), 0.5))


@query(f'WITH {V.BOXES_SQL} SELECT {BOX} FROM boxes WHERE "right" - "left" >= 40 AND bottom - top >= 2')
def b3_size(spark, sf_dir):
    return slim(B.filter_min_size(V.boxes(spark, sf_dir), 40, 2))


# the greedy rule in rounds: what no better box overlaps stays, what a box that stays overlaps goes; three rounds settle these boxes
SHARED = """(least(o."right", c."right") - greatest(o."left", c."left")) * (least(o.bottom, c.bottom) - greatest(o.top, c.top))"""
DUPLICATES_SQL = V.BOXES_TWICE_SQL + f""", ky AS (SELECT *, regexp_replace(lower(text), '[^\\pL\\pN]', '', 'g') AS key, ("right" - "left") * (bottom - top) AS area FROM boxes2),
ov AS MATERIALIZED (SELECT c.doc_id, o.box_id AS better, c.box_id FROM ky o JOIN ky c ON o.doc_id = c.doc_id AND o.key = c.key AND o.line_no = c.line_no AND o.box_id <> c.box_id AND o."left" < c."right" AND c."left" < o."right"
 WHERE {SHARED} / (o.area + c.area - {SHARED}) >= 0.8 AND (o.confidence > c.confidence OR o.confidence = c.confidence AND (o.area > c.area OR o.area = c.area AND o.box_id < c.box_id))),
g1 AS (SELECT DISTINCT doc_id, box_id FROM ov WHERE NOT EXISTS (SELECT 1 FROM ov w WHERE w.doc_id = ov.doc_id AND w.box_id = ov.better)),
o2 AS (SELECT * FROM ov ANTI JOIN g1 USING (doc_id, box_id) WHERE NOT EXISTS (SELECT 1 FROM g1 WHERE g1.doc_id = ov.doc_id AND g1.box_id = ov.better)),
g2 AS (SELECT DISTINCT doc_id, box_id FROM o2 WHERE NOT EXISTS (SELECT 1 FROM o2 w WHERE w.doc_id = o2.doc_id AND w.box_id = o2.better)),
o3 AS (SELECT * FROM o2 ANTI JOIN g2 USING (doc_id, box_id) WHERE NOT EXISTS (SELECT 1 FROM g2 WHERE g2.doc_id = o2.doc_id AND g2.box_id = o2.better)),
g3 AS (SELECT DISTINCT doc_id, box_id FROM o3), gone AS (SELECT * FROM g1 UNION ALL SELECT * FROM g2 UNION ALL SELECT * FROM g3)"""


@query(f"WITH {DUPLICATES_SQL} SELECT doc_id, box_id, text FROM boxes2 ANTI JOIN gone USING (doc_id, box_id)")
def b4_duplicates(spark, sf_dir):
    return slim(B.suppress_duplicates(V.boxes(spark, sf_dir, twice=True).select("doc_id", "box_id", "text", *B.EDGES, "confidence")))


@query(f'WITH {V.BOXES_SQL} SELECT doc_id, box_id, row_number() OVER (PARTITION BY doc_id ORDER BY "left", {CY}, box_id)::INT AS by_left, row_number() OVER (PARTITION BY doc_id ORDER BY top, "left", box_id)::INT AS by_top, row_number() OVER (PARTITION BY doc_id ORDER BY {CY}, "left", box_id)::INT AS by_reading FROM boxes')
def b5_orders(spark, sf_dir):
    out = V.boxes(spark, sf_dir)
    for kind in ("left", "top", "reading"):
        out = B.order_boxes(out, kind).withColumnRenamed("pos", f"by_{kind}")
    return out.select("doc_id", "box_id", "by_left", "by_top", "by_reading")


@query(f"WITH {V.BOXES_SQL} SELECT doc_id, box_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY line_no)::INT AS line_id FROM boxes")
def b6_group_lines(spark, sf_dir):
    return B.group_lines(V.boxes(spark, sf_dir).select("doc_id", "box_id", *B.EDGES)).select("doc_id", "box_id", "line_id")


@query(
    f"""WITH {V.BOXES_SQL} SELECT doc_id, line_no::INT AS line_no, md5(string_agg(text, ' ' ORDER BY "left")) AS text, min("left") AS "left", max("right") AS "right", count(*) AS box_count,
 {rounded_sql('sum(confidence * greatest(("right" - "left") * 20, 1)) / sum(greatest(("right" - "left") * 20, 1))', 4)} AS confidence FROM boxes GROUP BY ALL"""
)
def b7_merge_lines(spark, sf_dir):
    merged = B.merge_lines(V.boxes(spark, sf_dir), "line_no")
    return merged.select("doc_id", "line_no", F.md5("text").alias("text"), "left", "right", "box_count", rounded("confidence", 4).alias("confidence"))


@query(f"WITH {V.BOXES_SQL} SELECT doc_id, box_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY line_no)::INT AS row_id FROM boxes")
def b8_group_rows(spark, sf_dir):
    return B.group_rows(V.boxes(spark, sf_dir).select("doc_id", "box_id", *B.EDGES)).select("doc_id", "box_id", "row_id")


# ---- card boxes: a label box and a value box for every card line, with gaps that depend on the card


CARD_BOXES = """SELECT doc_id, line_no * 2 AS box_id, line_no AS row_id, trim(split_part(line, ':', 1)) AS text, 300.0 AS x, 0.95 - (doc_id % 40) / 100.0 AS c FROM lines
UNION ALL SELECT doc_id, line_no * 2 + 1, line_no, trim(substr(line, length(split_part(line, ':', 1)) + 2)), 330.0 + 8 * length(split_part(line, ':', 1)) + 20.0 * (doc_id % 3), 0.55 + (doc_id % 40) / 100.0 FROM lines WHERE contains(line, ':')"""
CARD_BOXES_SQL = (
    TQ.NORMAL_SQL + f""", cb AS ({CARD_BOXES}), cards AS MATERIALIZED (SELECT doc_id, box_id, row_id, text, x::DOUBLE AS "left", 40.0::DOUBLE * row_id AS top, (x + 8 * length(text))::DOUBLE AS "right", 40.0::DOUBLE * row_id + 24 AS bottom, c::DOUBLE AS confidence FROM cb WHERE text <> '')"""
)


def loose_card_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes of cards, dealt by card as the cards are; for operators that pass over them once."""
    # both boxes of a line at once: a union would make all lines twice; frequent lines are cut up once
    head = "split_part(line, ':', 1)"
    cut = F.expr(f"struct(trim({head}) AS label, CASE WHEN contains(line, ':') THEN trim(substr(line, length({head}) + 2)) END AS value, length({head}) AS n)")
    label = "struct(line_no * 2 AS box_id, facts.label AS text, CAST(300.0 AS DOUBLE) AS x, CAST(0.95 - (doc_id % 40) / 100.0 AS DOUBLE) AS c)"
    value = "CASE WHEN facts.value IS NOT NULL THEN struct(line_no * 2 + 1 AS box_id, facts.value AS text, CAST(330.0 + 8 * facts.n + 20.0 * (doc_id % 3) AS DOUBLE) AS x, CAST(0.55 + (doc_id % 40) / 100.0 AS DOUBLE) AS c) END"
    raw = TQ.lines_of(spark, sf_dir, cut).select("doc_id", F.col("line_no").cast("long").alias("row_id"), F.explode(F.expr(f"array({label}, {value})")).alias("b")).select("doc_id", "row_id", "b.*").where("text <> ''")
    top = 40.0 * F.col("row_id").cast("double")
    return raw.select("doc_id", F.col("box_id").cast("long").alias("box_id"), "row_id", "text", F.col("x").alias("left"), top.alias("top"), (F.col("x") + 8.0 * F.length("text")).alias("right"), (top + 24).alias("bottom"), F.col("c").alias("confidence"))


def card_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, written in buckets of cards: label search reads them several times, always by card."""
    return stored_by(loose_card_boxes(spark, sf_dir), "card_boxes", "doc_id", V.card_parts(spark, sf_dir), lies=True)


LAGS = 'lag("right") OVER w AS pr, lag("left") OVER w AS pl, lag(text) OVER w AS pt, lag(box_id) OVER w AS pb'


@query(
    f"""WITH {CARD_BOXES_SQL}, p AS (SELECT *, {LAGS} FROM cards WINDOW w AS (PARTITION BY doc_id, row_id ORDER BY "left", box_id)),
b AS (SELECT *, CASE WHEN pb IS NULL THEN 0 WHEN pl < 330 AND "left" >= 300 AND regexp_matches(lower(pt), {TQ.q(T.EXPIRY_LOOK)}) AND regexp_matches(lower(text), {TQ.q(T.ADDRESS_LOOK)}) THEN 1 WHEN "left" - pr <= 0 THEN 0
 WHEN "left" - pr > 24 * 1.8 THEN 1 WHEN regexp_matches(text, {TQ.q(T.FIELD_START)}, 'i') AND NOT regexp_matches(pt, {TQ.q(T.LOCAL_LABEL)}, 'i') THEN 1 ELSE 0 END AS br FROM p)
SELECT doc_id, box_id, 1 + sum(br) OVER (PARTITION BY doc_id, row_id ORDER BY "left", box_id)::BIGINT AS segment_id FROM b"""
)
def b9_segments(spark, sf_dir):
    return B.segment_rows(card_boxes(spark, sf_dir)).select("doc_id", "box_id", "segment_id")


@query(
    f"""WITH {V.BOXES_SQL}, m AS (SELECT doc_id, line_no, word_no // 5 AS seg, string_agg(text, ' ' ORDER BY "left", box_id) AS text, min("left") AS "left", max("right") AS "right", min(top) AS top, {rounded_sql("avg(confidence)", 4)} AS confidence, count(*) AS source_count FROM boxes GROUP BY ALL)
SELECT doc_id, md5(text) AS text, "left", "right", confidence, source_count, row_number() OVER (PARTITION BY doc_id ORDER BY top, "left")::INT AS pos FROM m"""
)
def b10_merge_segments(spark, sf_dir):
    rows = V.boxes(spark, sf_dir).withColumns({"row_id": F.col("line_no"), "segment_id": F.floor(F.col("word_no") / 5)})
    return B.merge_segments(rows, normalize=False).select("doc_id", F.md5("text").alias("text"), "left", "right", "confidence", "source_count", "pos")


@query(f"WITH {V.BOXES_SQL} SELECT {BOX} FROM boxes WHERE {CY} BETWEEN 50 AND 200")
def b11_vertical_range(spark, sf_dir):
    return slim(B.in_vertical_range(V.boxes(spark, sf_dir), 50, 200))


@query(f"WITH {V.BOXES_SQL} SELECT {BOX} FROM boxes WHERE {CX} BETWEEN 100 AND 900")
def b12_horizontal_range(spark, sf_dir):
    return slim(B.in_horizontal_range(V.boxes(spark, sf_dir), 100, 900))


REGIONS_SQL = "regions(region, x1, y1, x2, y2) AS (VALUES " + ", ".join(f"('{n}', {a}, {b}, {c}, {d})" for n, a, b, c, d in T.REGIONS) + ")"
INSIDE = '(least("right", x2) - greatest("left", x1)) * (least(bottom, y2) - greatest(top, y1)) / (("right" - "left") * (bottom - top)) >= 0.5 AND least("right", x2) > greatest("left", x1) AND least(bottom, y2) > greatest(top, y1)'


@query(f"WITH {V.BOXES_SQL}, {REGIONS_SQL} SELECT doc_id, box_id, region FROM boxes JOIN regions ON {INSIDE}")
def b13_regions(spark, sf_dir):
    return B.boxes_in_regions(V.boxes(spark, sf_dir)).select("doc_id", "box_id", "region")


@query(
    f"""WITH {V.BOXES_SQL}, {REGIONS_SQL}, s AS (SELECT doc_id, box_id, text, confidence, "left" * sx AS "left", "right" * sx AS "right", top * sy AS top, bottom * sy AS bottom FROM (SELECT *, 1000.0::DOUBLE / (1000 + doc_id % 3 * 500) AS sx, 630.0::DOUBLE / (630 + doc_id % 2 * 630) AS sy FROM boxes))
SELECT doc_id, region AS field, CASE WHEN region LIKE 'place%' THEN string_agg(text, ', ' ORDER BY {CY}, "left", box_id) ELSE string_agg(text, ' ' ORDER BY {CY}, "left", box_id) END AS raw, {rounded_sql("avg(confidence)", 4)} AS confidence FROM s JOIN regions ON {INSIDE} WHERE region <> 'portrait' GROUP BY doc_id, region"""
)
def b14_template(spark, sf_dir):
    boxes = V.boxes(spark, sf_dir)
    pages = boxes.select("doc_id").distinct().select("doc_id", (1000 + F.col("doc_id") % 3 * 500).alias("page_width"), (630 + F.col("doc_id") % 2 * 630).alias("page_height"))
    return B.template_fields(boxes, pages).select("doc_id", "field", "raw", "confidence")


# pairs over whole lines: every pair of a line with a gap up to REACH, whatever their word numbers

REACH = 200.0
NEAR_PAIRS = V.BOXES_SQL + f""", pr AS (SELECT a.doc_id, a.box_id AS a, b.box_id AS b, a."left" AS al, a."right" AS ar, b."left" AS bl, b."right" AS br FROM boxes a JOIN boxes b ON a.doc_id = b.doc_id AND a.line_no = b.line_no AND a.box_id <> b.box_id AND greatest(b."left" - a."right", a."left" - b."right", 0) <= {REACH})"""


@query(
    f"WITH {NEAR_PAIRS} SELECT doc_id, a, b, greatest(bl - ar, al - br, 0)::DOUBLE AS x_gap, 20.0::DOUBLE AS y_overlap, round(abs((al + ar) / 2 - (bl + br) / 2), 6) AS distance, round(greatest(bl - ar, al - br, 0) / 20, 6)::DOUBLE AS x_gap_ratio FROM pr"
)
def b15_pair_metrics(spark, sf_dir):
    """Pairs of a line with a horizontal gap up to REACH."""
    m = B.pair_metrics(V.boxes(spark, sf_dir), ("doc_id", "line_no"), within=REACH)
    return m.select("doc_id", "a", "b", "x_gap", "y_overlap", F.round("distance", 6).alias("distance"), F.round("x_gap_ratio", 6).alias("x_gap_ratio"))


@query(f"WITH {NEAR_PAIRS} SELECT doc_id, a AS box, b AS other FROM pr WHERE bl + br > al + ar")
def b16_right_of(spark, sf_dir):
    """Boxes right of a box on its line, with a horizontal gap up to REACH."""
    return B.relate(V.boxes(spark, sf_dir), "right_of", by=("doc_id", "line_no"), within=REACH).select("doc_id", "box", "other")


@query(
    f"""WITH {CARD_BOXES_SQL} SELECT a.doc_id, a.box_id AS box, b.box_id AS other FROM cards a JOIN cards b ON a.doc_id = b.doc_id AND b.top > a.top
 AND greatest(least(a."right", b."right") - greatest(a."left", b."left"), 0) / least(a."right" - a."left", b."right" - b."left") >= 0.2"""
)
def b16_below(spark, sf_dir):
    return B.relate(card_boxes(spark, sf_dir), "below")


@query(f'WITH {V.BOXES_SQL}, pt AS (SELECT doc_id, g AS point_id, 37.0 * g AS x, 24.0 * (g % 7) + 10 AS y FROM (SELECT doc_id, unnest(range(0, 20)) AS g FROM documents)) SELECT b.doc_id, box_id, point_id FROM boxes b JOIN pt ON b.doc_id = pt.doc_id AND x BETWEEN "left" AND "right" AND y BETWEEN top AND bottom')
def b17_contains_point(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.explode(F.expr("sequence(0L, 19L)")).alias("point_id"))
    points = docs.withColumns({"x": 37.0 * F.col("point_id"), "y": 24.0 * (F.col("point_id") % 7) + 10})
    return B.contains_point(V.boxes(spark, sf_dir), points)


@query(f'WITH {V.BOXES_SQL} SELECT {BOX}, row_number() OVER (PARTITION BY doc_id ORDER BY {CY}, "left", box_id)::INT AS pos FROM boxes WHERE confidence >= 0.05')
def b18_prepare(spark, sf_dir):
    return B.prepare_boxes(V.boxes(spark, sf_dir)).select("doc_id", "box_id", "text", "pos")


RATIO = lambda x, y, low, high: f'greatest(least({x}."{high}", {y}."{high}") - greatest({x}."{low}", {y}."{low}"), 0) / least({x}."{high}" - {x}."{low}", {y}."{high}" - {y}."{low}")'
LINE_OF = lambda x, y: f"({RATIO(x, y, 'top', 'bottom')} >= 0.45 OR abs({x}.top - {y}.top) / 24 <= 0.65)"
BESIDE = lambda c, a, beyond: f"({beyond} AND ({RATIO(c, a, 'top', 'bottom')} >= 0.3 OR {LINE_OF(c, a)}))"
FARTHER = lambda c, a: f'{c}."left" + {c}."right" > {a}."left" + {a}."right"'
RELATIONS = {
    "left_of": BESIDE("a", "b", FARTHER("a", "b")), "left_of_strict": BESIDE("a", "b", 'a."left" >= b."right"'), "right_of_strict": BESIDE("b", "a", 'b."left" >= a."right"'),
    "above": f"a.top > b.top AND {RATIO('a', 'b', 'left', 'right')} >= 0.2", "below_strict": f"b.top >= a.bottom AND {RATIO('b', 'a', 'left', 'right')} >= 0.2", "same_line": LINE_OF("a", "b"),
}


@query(f"WITH {CARD_BOXES_SQL}, pr AS (SELECT a.doc_id, a.box_id AS box, b.box_id AS other, [" + ", ".join(f"CASE WHEN {on} THEN '{k}' END" for k, on in RELATIONS.items()) + "] AS kinds FROM cards a JOIN cards b ON a.doc_id = b.doc_id AND a.box_id <> b.box_id), ks AS (SELECT doc_id, box, other, unnest(kinds) AS kind FROM pr) SELECT doc_id, box, other, kind FROM ks WHERE kind IS NOT NULL")
def b16_relations(spark, sf_dir):
    """The relations that the two queries above leave out, over the boxes of a card."""
    boxes = card_boxes(spark, sf_dir)
    parts = [B.relate(boxes, k.removesuffix("_strict"), strict=k.endswith("_strict")).withColumn("kind", F.lit(k)) for k in RELATIONS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"""WITH {CARD_BOXES_SQL} SELECT a.doc_id, a.box_id AS outer_box, b.box_id AS inner_box FROM cards a JOIN cards b ON a.doc_id = b.doc_id AND a.box_id <> b.box_id AND b."left" >= a."left" - 60 AND b."right" <= a."right" + 60 AND b.top >= a.top - 60 AND b.bottom <= a.bottom + 60""")
def b17_contains_box(spark, sf_dir):
    return B.contains_box(card_boxes(spark, sf_dir), tolerance=60.0).toDF("doc_id", "outer_box", "inner_box")


REGIONS_V1_SQL = "regions(region, x1, y1, x2, y2) AS (VALUES " + ", ".join(f"('{n}', {a}, {b}, {c}, {d})" for n, a, b, c, d in T.REGIONS_V1) + ")"


@query(f"""WITH {V.BOXES_SQL}, {REGIONS_V1_SQL} SELECT doc_id, region AS field, CASE WHEN region LIKE 'place%' THEN string_agg(text, ', ' ORDER BY {CY}, "left", box_id) ELSE string_agg(text, ' ' ORDER BY {CY}, "left", box_id) END AS raw, {rounded_sql("avg(confidence)", 4)} AS confidence FROM boxes JOIN regions ON {INSIDE} WHERE region <> 'portrait' GROUP BY doc_id, region""")
def b14_template_earlier(spark, sf_dir):
    boxes = V.boxes(spark, sf_dir)
    pages = boxes.select("doc_id").distinct().select("doc_id", F.lit(1000).alias("page_width"), F.lit(630).alias("page_height"))
    return B.template_fields(boxes, pages, T.REGIONS_V1).select("doc_id", "field", "raw", "confidence")


STRIPPED = "CASE region " + " ".join(f"WHEN '{f}' THEN " + TQ.squeeze_sql(f"regexp_replace(regexp_replace(raw, {TQ.q(p)}, ' ', 'gi'), '^[\\s:/,;.-]+', '')") for f, p in (("idNumber", r"\b(?:so|no)\b"), ("fullName", T.NAME_LABEL), ("dateOfBirth", T.BIRTH_LABEL), ("gender", T.GENDER_LABEL), ("nationality", T.NATIONALITY_LABEL), ("placeOfOrigin", T.ORIGIN_LABEL), ("placeOfResidence", T.RESIDENCE_LABEL), ("dateOfExpiry", T.EXPIRY_LABEL))) + " END"
WORDS_OF = "array_to_string(regexp_extract_all(value, '\\pL+'), ' ')"
FIELD_VALUE = f"""CASE WHEN region = 'idNumber' THEN nullif(regexp_extract(regexp_replace(translate(value, 'OoIiLl', '001111'), '\\D', '', 'g'), '^\\d{{12}}$'), '')
 WHEN region = 'fullName' THEN CASE WHEN len(regexp_extract_all(value, '\\pL+')) >= 2 AND length({WORDS_OF}) >= 3 THEN upper({WORDS_OF}) END
 WHEN region LIKE 'date%' THEN CASE WHEN regexp_matches(fd, {TQ.q(TQ.FIELD_DATE)}) THEN {TQ.real_sql('(' + TQ.dmy_sql('fd', TQ.FIELD_DATE) + ')')} WHEN length(dg) = 8 THEN {TQ.real_sql('(' + TQ.eight_sql('dg') + ')')} END
 WHEN region = 'gender' THEN {TQ.gender_sql('value', [w for w in T.FEMALE_WORDS if w != 'nuu'])}
 WHEN region = 'nationality' THEN CASE WHEN regexp_matches(lower({TQ.FOLD.format(c='value')}), {TQ.q(T.COUNTRY_FIELD)}) THEN 'Việt Nam' ELSE nullif({WORDS_OF}, '') END
 ELSE CASE WHEN length({TQ.FA}) >= 3 THEN {TQ.FA} END END"""
#: Where a card's lines lie on the sheet: each line in the region of the field that it is about, as far as its text tells.
PLACED = """CASE WHEN text IN ('No', 'So / No') OR regexp_matches(replace(text, ' ', ''), '^[0-9]{12}$') THEN 1 WHEN regexp_matches(lower(text), 'ngay|birth|/19') THEN 3 WHEN regexp_matches(lower(text), 'sex|^nam$|^nu$') THEN 4 WHEN regexp_matches(lower(text), '^viet') THEN 5 WHEN regexp_matches(lower(text), 'que|origin|xa |thon ') THEN 6 WHEN regexp_matches(lower(text), 'noi|residence|khu|to ') THEN 7 WHEN regexp_matches(lower(text), 'gia tri|expiry|/20') THEN 8 ELSE 2 END"""


@query(
    f"""WITH {CARD_BOXES_SQL}, {REGIONS_SQL}, own AS (SELECT * REPLACE (regexp_replace(text, '^(Nam|Nu) Quoc tich.*$', '\\1') AS text) FROM cards), spotted AS (SELECT *, {PLACED} AS spot FROM own), spots AS (SELECT *, row_number() OVER (ORDER BY o) AS spot FROM (SELECT *, CASE region {' '.join(f"WHEN '{r[0]}' THEN {n}" for n, r in enumerate(T.REGIONS))} END AS o FROM regions)),
p AS (SELECT a.doc_id, a.box_id, a.text, a.confidence, s.x1 + a.row_id AS "left", s.y1 + a.row_id AS top, s.x1 + a.row_id + 20 AS "right", s.y1 + a.row_id + 10 AS bottom FROM spotted a JOIN spots s USING (spot)),
h AS (SELECT doc_id, region, CASE WHEN region LIKE 'place%' THEN string_agg(text, ', ' ORDER BY {CY}, "left", box_id) ELSE string_agg(text, ' ' ORDER BY {CY}, "left", box_id) END AS raw FROM p JOIN regions ON {INSIDE} WHERE region <> 'portrait' GROUP BY doc_id, region),
v AS (SELECT *, {STRIPPED} AS value FROM h), d AS (SELECT *, {TQ.FD} AS fd, regexp_replace({TQ.FD}, '\\D', '', 'g') AS dg FROM v)
SELECT doc_id, region AS field, raw, {FIELD_VALUE} AS value FROM d"""
)
def b14_card_values(spark, sf_dir):
    """Cleaned values of card texts that lie in the regions of the template sheet."""
    names = {n + 1: r for n, r in enumerate(T.REGIONS)}
    # a dozen patterns, met once for each frequent text, else once a box: filters on the corners made of it would be moved below and meet them again
    boxes = card_boxes(spark, sf_dir).withColumnRenamed("text", "read")
    own = F.regexp_replace("read", "^(Nam|Nu) Quoc tich.*$", "$1").alias("text")
    spotted = lambda df: df.select("read", own).select("read", "text", F.expr(PLACED.replace("regexp_matches", "regexp_like")).alias("spot"))
    rows = remembered(boxes, ["read"], spotted, "spots")
    here = rows.withColumn("text", F.coalesce(F.col("__known.text"), own)).withColumn("spot", F.expr(f"CASE WHEN __known IS NOT NULL THEN __known.spot ELSE {PLACED.replace('regexp_matches', 'regexp_like')} END"))
    at = X.kept(here.withColumnRenamed("spot", "__spot"), "spot", F.col("__spot"), lambda s: s.isNotNull())
    corner = lambda k: F.create_map(*(F.lit(x) for n, r in names.items() for x in (n, float(r[k]))))[F.col("spot")] + F.col("row_id")
    placed = at.select("doc_id", "box_id", "text", "confidence", corner(1).alias("left"), corner(2).alias("top"))
    placed = placed.withColumns({"right": F.col("left") + 20.0, "bottom": F.col("top") + 10.0})
    pages = placed.select("doc_id").distinct().select("doc_id", F.lit(T.SHEET[0]).alias("page_width"), F.lit(T.SHEET[1]).alias("page_height"))
    return B.template_fields(placed, pages).select("doc_id", "field", "raw", "value")


# ---- label search


HITS_SQL = (
    CARD_BOXES_SQL + f", {TQ.ALIASES_SQL}, tx AS (SELECT DISTINCT text FROM cards), ks AS (SELECT text, field, alias, pos, least, {TQ.key_sql('text')} AS x, {TQ.key_sql('alias')} AS y, {TQ.key_sql('text', '')} AS u, {TQ.key_sql('alias', '')} AS v FROM tx, alias), "
    f"sc AS (SELECT text, field, alias, pos, {TQ.similarity_sql('x', 'y', 'u', 'v')}::DOUBLE AS s, least FROM ks), hits AS (SELECT c.*, field, alias, pos, s FROM cards c JOIN sc USING (text) WHERE s >= least)"
)
BEST_SQL = HITS_SQL + f""", best AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id, field ORDER BY s DESC, confidence DESC, {CY}, "left", box_id, pos) = 1)"""


@query(f"WITH {BEST_SQL} SELECT doc_id, field, alias, box_id, round(s, 6) AS similarity FROM best")
def a1_best_label(spark, sf_dir):
    found = A.best_label(card_boxes(spark, sf_dir), A.label_table(spark), "levenshtein")
    return found.select("doc_id", "field", "alias", "box_id", F.round("similarity", 6).alias("similarity"))


@query(
    f"""WITH {HITS_SQL}, o AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id, field, box_id ORDER BY s DESC, pos) = 1)
SELECT doc_id, field, alias, box_id, row_number() OVER (PARTITION BY doc_id, field ORDER BY s DESC, confidence DESC, {CY}, "left", box_id)::INT AS rank FROM o"""
)
def a2_all_labels(spark, sf_dir):
    return A.all_labels(card_boxes(spark, sf_dir), A.label_table(spark), "levenshtein").select("doc_id", "field", "alias", "box_id", "rank")


OV = lambda low, high: f'greatest(least(a."{high}", c."{high}") - greatest(a."{low}", c."{low}"), 0)'
GAP = lambda low, high: f'greatest(c."{low}" - a."{high}", a."{low}" - c."{high}", 0)'
WA, WC = '(a."right" - a."left")', '(c."right" - c."left")'
SAME = f"({OV('top', 'bottom')} / 24 >= 0.45 OR abs(a.top - c.top) / 24 <= 0.65)"
RIGHT_SCORE = f"(CASE WHEN {SAME} THEN 4 ELSE 0 END + 3 * {OV('top', 'bottom')} / 24 + 2 * c.confidence - 3 * least({GAP('left', 'right')} / 24 / 8, 1))"
BELOW_SCORE = f"""(3 * {OV('left', 'right')} / least({WA}, {WC}) + 2 * greatest(0, 1 - abs(c."left" - a."left") / greatest({WA}, {WC})) + 2 * c.confidence - 3 * least({GAP('top', 'bottom')} / 24 / 5, 1))"""
RIGHT_ON = f"""c."left" + c."right" > a."left" + a."right" AND ({OV('top', 'bottom')} / 24 >= 0.3 OR {SAME}) AND {GAP('left', 'right')} / 24 <= 8"""
BELOW_ON = f"c.top > a.top AND {OV('left', 'right')} / least({WA}, {WC}) >= 0.2 AND {GAP('top', 'bottom')} / 24 <= 5"
CAND = lambda name, on, score: f"SELECT a.doc_id, a.field, '{name}' AS direction, c.box_id AS value_box, c.text AS value_text, {score} + 2 * a.s AS score, (c.top + c.bottom) / 2 AS y, c.\"left\" AS x FROM best a JOIN cards c ON a.doc_id = c.doc_id AND a.box_id <> c.box_id AND {on}"
FIRST = "QUALIFY row_number() OVER (PARTITION BY doc_id, field ORDER BY score DESC, y, x, value_box) = 1"


@query(f"WITH {BEST_SQL}, cd AS ({CAND('right', RIGHT_ON, RIGHT_SCORE)}) SELECT doc_id, field, value_box, round(score, 6)::DOUBLE AS final_score FROM cd {FIRST}")
def a3_right_value(spark, sf_dir):
    boxes = card_boxes(spark, sf_dir)
    found = A.right_value(boxes, A.best_label(boxes, A.label_table(spark), "levenshtein"))
    return found.select("doc_id", "field", "value_box", F.round("final_score", 6).alias("final_score"))


@query(f"WITH {BEST_SQL}, cd AS ({CAND('below', BELOW_ON, BELOW_SCORE)}) SELECT doc_id, field, value_box, round(score, 6)::DOUBLE AS final_score FROM cd {FIRST}")
def a4_below_value(spark, sf_dir):
    boxes = card_boxes(spark, sf_dir)
    found = A.below_value(boxes, A.best_label(boxes, A.label_table(spark), "levenshtein"))
    return found.select("doc_id", "field", "value_box", F.round("final_score", 6).alias("final_score"))


BELOW_FIRST_SQL = ", ".join(map(TQ.q, T.BELOW_FIRST))
ALL_CAND = f"{BEST_SQL}, cd0 AS ({CAND('right', RIGHT_ON, RIGHT_SCORE)} UNION ALL {CAND('below', BELOW_ON, BELOW_SCORE)}), cd AS (SELECT *, CASE WHEN (direction = 'below') = (field IN ({BELOW_FIRST_SQL})) THEN 0 ELSE 1 END AS dr FROM cd0)"
RANKED = "PARTITION BY doc_id, field ORDER BY dr, score DESC, y, x, value_box"


@query(f"WITH {ALL_CAND} SELECT doc_id, field, direction, value_box FROM cd QUALIFY row_number() OVER ({RANKED}) = 1")
def a5_label_value(spark, sf_dir):
    return A.label_value(card_boxes(spark, sf_dir), A.label_table(spark), "levenshtein").select("doc_id", "field", "direction", "value_box")


def exclusive_ctes() -> tuple[str, str]:
    """CTEs of A6, one for each field in order, and the union of their rows (doc_id, field, value_box)."""
    steps, used = [], []
    for n, field in enumerate(T.FIELDS):
        free = " AND ".join(f"NOT EXISTS (SELECT 1 FROM e{m} WHERE e{m}.doc_id = cd.doc_id AND e{m}.value_box = cd.value_box)" for m in range(n)) or "true"
        steps.append(f"e{n} AS MATERIALIZED (SELECT doc_id, field, value_box FROM cd WHERE field = '{field}' AND {free} QUALIFY row_number() OVER ({RANKED}) = 1)")
        used.append(f"SELECT * FROM e{n}")
    return f"{ALL_CAND.replace('cd AS (', 'cd AS MATERIALIZED (')}, {', '.join(steps)}", " UNION ALL ".join(used)


def exclusive_sql() -> str:
    ctes, rows = exclusive_ctes()
    return f"WITH {ctes} {rows}"


@query(exclusive_sql())
def a6_exclusive(spark, sf_dir):
    boxes = card_boxes(spark, sf_dir)
    found = A.value_candidates(boxes, A.best_label(boxes, A.label_table(spark), "levenshtein"))
    return A.assign_exclusive(found).select("doc_id", "field", "value_box")


DIGITS = "regexp_replace(translate(upper(text), 'OILSB', '01158'), '\\D', '', 'g')"


@query(f"""WITH {CARD_BOXES_SQL}, d AS (SELECT *, {DIGITS} AS dg, 2 * confidence - 0.0001 * {CY} AS score FROM cards), v AS (SELECT *, CASE WHEN length(dg) >= 12 THEN substr(dg, 1, 12) END AS value FROM d)
SELECT doc_id, value, box_id FROM v WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, {CY}, "left", box_id) = 1""")
def a7_id_fallback(spark, sf_dir):
    return A.id_fallback(loose_card_boxes(spark, sf_dir)).select("doc_id", "value", "box_id")


@query(f"""WITH {CARD_BOXES_SQL}, l AS (SELECT *, {TQ.LD.replace('value', 'text')} AS ld, max(bottom) OVER (PARTITION BY doc_id) AS low FROM cards),
x AS (SELECT *, ({TQ.dmy_sql('ld', TQ.LAYOUT_DATE)}) AS dt, regexp_replace(ld, '\\D', '', 'g') AS dg, {CY} / low AS rel FROM l),
v AS (SELECT *, CASE WHEN regexp_matches(ld, {TQ.q(TQ.LAYOUT_DATE)}) THEN CASE WHEN substr(dt, 1, 2) BETWEEN '01' AND '31' AND substr(dt, 4, 2) BETWEEN '01' AND '12' AND substr(dt, 7) BETWEEN '1900' AND '2199' THEN dt END WHEN length(dg) = 8 THEN {TQ.eight_sql('dg')} END AS value FROM x)
SELECT doc_id, value, box_id FROM v WHERE value IS NOT NULL AND rel <= 0.8 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY 2 * confidence - rel DESC, {CY}, "left", box_id) = 1""")
def a8_date_fallback(spark, sf_dir):
    return A.date_fallback(card_boxes(spark, sf_dir)).select("doc_id", "value", "box_id")


@query()
def a9_layout(spark, sf_dir):
    return A.extract_by_layout(card_boxes(spark, sf_dir), parts=V.card_parts(spark, sf_dir))


def layout_sql() -> str:
    """A9 with the edit ratio: exclusive values under their layout rules, the two fallbacks, empty strings else."""
    ctes, rows = exclusive_ctes()
    name = TQ.squeeze_sql(f"regexp_replace({TQ._prefix_sql('trim(value)', T.ALIASES['fullName'])}, '[^{TQ.LET}{chr(92)}s''-]', ' ', 'g')")
    place = TQ._prefix_sql(f"trim({TQ._prefix_sql('trim(value)', T.ALIASES['placeOfOrigin'])})", T.ALIASES["placeOfResidence"])
    place = TQ.squeeze_sql(f"regexp_replace(regexp_replace({place}, '\\s*,\\s*', ', ', 'g'), '\\s*;\\s*', ', ', 'g')")
    inside = "substr(dt, 1, 2) BETWEEN '01' AND '31' AND substr(dt, 4, 2) BETWEEN '01' AND '12' AND substr(dt, 7) BETWEEN '1900' AND '2199'"
    date = f"CASE WHEN regexp_matches(ld, {TQ.q(TQ.LAYOUT_DATE)}) THEN CASE WHEN {inside} THEN dt END WHEN length(dg) = 8 THEN {TQ.eight_sql('dg')} END"
    dated = lambda source, more="": f"SELECT *, ({TQ.dmy_sql('ld', TQ.LAYOUT_DATE)}) AS dt, regexp_replace(ld, '\\D', '', 'g') AS dg FROM (SELECT *, {TQ.LD} AS ld{more} FROM {source})"
    digits = DIGITS.replace("(text)", "(value)")
    gender = f"CASE WHEN g IN ('nam', 'male') THEN 'Nam' WHEN g IN ('nu', 'nữ') OR contains(g, 'female') THEN 'Nữ' WHEN contains(g, 'male') THEN 'Nam' WHEN contains(g, 'nu') THEN 'Nữ' WHEN contains(g, 'nam') THEN 'Nam' ELSE {TQ.squeeze_sql('value')} END"
    nation = f"CASE WHEN regexp_replace(lower({TQ.NATION_LAYOUT}), '[^a-z]', '', 'g') IN ('vietnam', 'vietnan', 'vietnarn', 'victnam') THEN 'Việt Nam' ELSE {TQ.NATION_LAYOUT} END"
    wide = ", ".join(f"max(v) FILTER (field = '{f}') AS {f}" for f in T.FIELDS)
    backup = {"idNumber": "coalesce(nullif(p.idNumber, ''), f7.v, '')", "dateOfBirth": "coalesce(p.dateOfBirth, f8.v, '')"}
    return f"""WITH {ctes}, chosen AS ({rows}), vt AS (SELECT h.doc_id, field, c.text AS value FROM chosen h JOIN cards c ON h.doc_id = c.doc_id AND h.value_box = c.box_id),
cleaned AS (SELECT doc_id, field, CASE WHEN field = 'idNumber' THEN CASE WHEN length(dd) >= 12 THEN substr(dd, 1, 12) ELSE dd END WHEN field = 'fullName' THEN trim({name}, ' :-/') WHEN field LIKE 'date%' THEN {date} WHEN field = 'gender' THEN {gender} WHEN field = 'nationality' THEN {nation} ELSE trim({place}, ' :-/,') END AS v
 FROM ({dated('vt', f", {digits} AS dd, {TQ.GENDER_WORD} AS g")})),
p AS (SELECT doc_id, {wide} FROM cleaned GROUP BY doc_id),
f7 AS (SELECT doc_id, substr(dd, 1, 12) AS v FROM (SELECT *, {DIGITS} AS dd FROM cards) WHERE length(dd) >= 12 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY 2 * confidence - 0.0001 * {CY} DESC, {CY}, "left", box_id) = 1),
f8 AS (SELECT doc_id, v FROM (SELECT *, {date} AS v, {CY} / low AS rel FROM ({dated('(SELECT *, text AS value, max(bottom) OVER (PARTITION BY doc_id) AS low FROM cards)')})) WHERE v IS NOT NULL AND rel <= 0.8 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY 2 * confidence - rel DESC, {CY}, "left", box_id) = 1)
SELECT d.doc_id, {', '.join(backup.get(f, f"coalesce(p.{f}, '')") + f' AS {f}' for f in T.FIELDS)} FROM (SELECT DISTINCT doc_id FROM cards) d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN f7 ON d.doc_id = f7.doc_id LEFT JOIN f8 ON d.doc_id = f8.doc_id"""


@query(layout_sql())
def a9_layout_edit(spark, sf_dir):
    return A.extract_by_layout(card_boxes(spark, sf_dir), method="levenshtein", parts=V.card_parts(spark, sf_dir))
