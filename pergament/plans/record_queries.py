"""Queries of line extraction (L), fusion (F), quality (Q), vectors (E) and sources (S)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pergament.functions import tables as T
from pergament.functions import text as X
from pergament.operators import fusion as Fu
from pergament.operators import lines as L
from pergament.operators import quality as Q
from pergament.operators import vectors as E
from pergament.plans import text_queries as TQ
from pergament.plans import views as V
from pergament.plans.registry import query, rounded_sql
from pergament.sources import io as S
from pergament.sources.scratch import folder
from pergament.streaming.parts import stream_parts
from pergament.streaming.records import stream_records

q = TQ.q

# ---- lines

NEAR_SQL = TQ.NORMAL_SQL + ", near AS (SELECT *, lag(line) OVER w AS prev, lead(line) OVER w AS next, lead(line, 2) OVER w AS next2 FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))"


def has_sql(pattern: str, c: str = "line") -> str:
    return f"regexp_matches({c}, {q(pattern)}, 'i')"


def first_sql(name: str, value: str, source: str = "near") -> str:
    return f"SELECT doc_id, arg_min(v, line_no) FILTER (v <> '') AS {name} FROM (SELECT doc_id, line_no, {value} AS v FROM {source}) GROUP BY doc_id"


PACKED = "regexp_replace(regexp_replace(line, '(\\d)\\s+(\\d)', '\\1\\2', 'g'), '(\\d)\\s+(\\d)', '\\1\\2', 'g')"
ID_SQL = f"regexp_extract('x' || {PACKED} || 'x', '[^\\d](\\d{{12}})[^\\d]', 1)"
BIRTH_SQL = f"CASE WHEN {has_sql(T.BIRTH_LABEL)} THEN coalesce({TQ.line_date_sql('line')}, {TQ.line_date_sql('next')}) END"
EXPIRY_SQL = f"CASE WHEN {has_sql(T.EXPIRY_LABEL)} THEN coalesce({TQ.line_date_sql('line', True)}, {TQ.line_date_sql('next', True)}) END"


@query(f"WITH {NEAR_SQL} {first_sql('idNumber', ID_SQL)}")
def l1_first_id(spark, sf_dir):
    return L.first_id(TQ.lines_of(spark, sf_dir))


@query(f"WITH {NEAR_SQL} {first_sql('dateOfBirth', BIRTH_SQL)}")
def l2_birth_date(spark, sf_dir):
    return L.labelled_date(TQ.lines_of(spark, sf_dir))


@query(f"WITH {NEAR_SQL} {first_sql('dateOfExpiry', EXPIRY_SQL)}")
def l3_expiry_date(spark, sf_dir):
    return L.expiry_date(TQ.lines_of(spark, sf_dir))


MISREAD = "CASE doc_id % 4 WHEN 0 THEN replace(line, 'Co gia tri den', 'Duto of erpiry') WHEN 1 THEN replace(line, 'Co gia tri den', 'Co gia un den') ELSE line END"


@query(f"""WITH {TQ.NORMAL_SQL}, ml AS (SELECT doc_id, line_no, {MISREAD} AS line FROM lines), near AS (SELECT *, lead(line) OVER w AS next, lead(line, 2) OVER w AS next2 FROM ml WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
{first_sql('dateOfExpiry', f"CASE WHEN regexp_matches(line, {q(T.EXPIRY)}, 'i') OR regexp_matches(line, '^(Duto of erpiry|Co gia un den)') THEN coalesce({TQ.fusion_date_sql('line')}, {TQ.fusion_date_sql('next')}, {TQ.fusion_date_sql('next2')}) END")}""")
def l3_expiry_fuzzy(spark, sf_dir):
    """Every second card has its expiry label misread."""
    return L.expiry_date(TQ.stored_lines_of(spark, sf_dir).withColumn("line", F.expr(MISREAD)), fuzzy=True)


AFTER_GENDER = f"regexp_replace(regexp_replace(regexp_extract(line, {q('(?is)^.*?' + T.GENDER_LABEL + '(.*)$')}, 1), {q('(?is)' + T.NATIONALITY_LABEL + '.*$')}, ''), '(?i)^\\s*/?\\s*sex\\s*[:;/,-]?\\s*', '')"


def pick_gender_sql(c: str) -> str:
    w = f"regexp_extract_all(lower({c}), '[a-zà-ỹ]+')"
    return f"CASE WHEN list_has_any({w}, ['nu', 'nữ', 'ni', 'nv', 'nw', 'female']) THEN 'Nữ' WHEN list_has_any({w}, ['nam', 'male']) THEN 'Nam' END"


GENDER_SQL = f"CASE WHEN {has_sql(T.GENDER_LABEL)} THEN coalesce({pick_gender_sql(AFTER_GENDER)}, {pick_gender_sql('next')}) END"


@query(f"WITH {NEAR_SQL} {first_sql('gender', GENDER_SQL)}")
def l4_gender(spark, sf_dir):
    return L.labelled_gender(TQ.lines_of(spark, sf_dir))


def rest_sql(pattern: str) -> str:
    both = f"regexp_extract(line, {q('(?is)^(.*?)' + pattern)}, 1) || regexp_extract(line, {q('(?is)^.*?' + pattern + '(.*)$')}, 1)"
    both = f"regexp_replace({both}, '(?i)^\\s*/?\\s*(?:full\\s*name|date\\s*of\\s*birth|sex|nationality|place\\s*of\\s*origin|place\\s*of\\s*residence)\\s*:?\\s*', '')"
    return f"trim(regexp_replace({both}, '^[\\s:;/,-]+', ''))"


def label_value_sql(pattern: str) -> str:
    return f"CASE WHEN {has_sql(pattern)} THEN CASE WHEN {rest_sql(pattern)} <> '' THEN {rest_sql(pattern)} WHEN trim(next) <> '' AND NOT {has_sql(T.STOP_LABEL_LINE, 'next')} THEN trim(next) END END"


CLEAN_NATION = f"CASE WHEN regexp_matches(lower(a), '\\b(viet\\s*nam|vict\\s*nam|vict\\s*nana)\\b') THEN 'Việt Nam' ELSE nullif({TQ.squeeze_sql(f'''regexp_replace(regexp_replace(a, {q(T.STOP_LABEL_LINE)}, ' ', 'gi'), '[^{TQ.LET}\\s]', ' ', 'g')''')}, '') END"


@query(f"""WITH {NEAR_SQL}, lv AS ({first_sql('a', label_value_sql(T.NATIONALITY_LABEL))}), ln AS ({first_sql('b', "CASE WHEN regexp_matches(line, '(?i)viet\\s*nam') AND regexp_matches(line, '(?i)\\bviet\\s*nam\\b') THEN 'Việt Nam' END")})
SELECT doc_id, coalesce({CLEAN_NATION}, b) AS nationality FROM lv JOIN ln USING (doc_id)""")
def l5_nationality(spark, sf_dir):
    return L.labelled_nationality(TQ.lines_of(spark, sf_dir))


NAME_SQL = (
    f"CASE WHEN {has_sql(T.NAME_LABEL)} THEN coalesce({TQ.line_name_sql('regexp_extract(line, ' + q('(?is)^(.*?)' + T.NAME_LABEL) + ', 1)')}, "
    f"{TQ.line_name_sql('regexp_extract(line, ' + q('(?is)^.*?' + T.NAME_LABEL + '(.*)$') + ', 1)')}, {TQ.line_name_sql('prev')}, {TQ.line_name_sql('next')}) END"
)


@query(f"WITH {NEAR_SQL} {first_sql('fullName', NAME_SQL)}")
def l6_name(spark, sf_dir):
    return L.labelled_name(TQ.lines_of(spark, sf_dir))


AFTER_LABEL = lambda label, c="line": f"regexp_extract({c}, {q('(?is)^.*?' + label + '(.*)$')}, 1)"
BEFORE_LABEL = lambda label, c="line": f"regexp_extract({c}, {q('(?is)^(.*?)' + label)}, 1)"
FOLDED, NEXT = TQ.FOLD.format(c="line"), "next"


@query(f"WITH {NEAR_SQL} {first_sql('fullName', f'CASE WHEN {has_sql(T.NAME_LABEL)} THEN coalesce({TQ.line_name_sql(AFTER_LABEL(T.NAME_LABEL))}, {TQ.line_name_sql(NEXT)}) END')}")
def l6_name_simple(spark, sf_dir):
    """The earlier policy: the label line or the next one."""
    return L.labelled_name(TQ.lines_of(spark, sf_dir), simple=True)


RECOVERED_NAME = ", ".join(TQ.fusion_name_sql(c) for c in (BEFORE_LABEL(T.NAME_LABEL_RECOVER), AFTER_LABEL(T.NAME_LABEL_RECOVER), "prev", "next", "next2"))


@query(f"WITH {NEAR_SQL} {first_sql('fullName', f'CASE WHEN {has_sql(T.NAME_LABEL_RECOVER)} THEN coalesce({RECOVERED_NAME}) END')}")
def l6_name_recovered(spark, sf_dir):
    """The label line, the previous and the next two."""
    return L.labelled_name(TQ.lines_of(spark, sf_dir), recover=True)


SECTION = f"regexp_replace({TQ.squeeze_sql(FOLDED)}, {q('(?is)' + T.NATIONALITY_LABEL_WORD + '.*$')}, '')"
SEX = f"regexp_replace(CASE WHEN regexp_matches({SECTION}, '(?i)\\bsex\\b') THEN regexp_extract({SECTION}, '(?is)\\bsex\\b\\s*[:/-]?\\s*(.*)$', 1) ELSE regexp_extract({SECTION}, '(?is)\\bgioi\\s*tinh\\b\\s*[:/-]?\\s*(.*)$', 1) END, '(?i)^\\s*/?\\s*sex\\s*[:/-]?\\s*', '')"


@query(f"WITH {NEAR_SQL} {first_sql('gender', f'CASE WHEN {has_sql(T.GENDER_LABEL_RECOVER, FOLDED)} THEN {TQ.gender_sql(SEX)} END')}")
def l4_gender_recovered(spark, sf_dir):
    return L.labelled_gender(TQ.lines_of(spark, sf_dir), recover=True)


CUT_NATION = f"regexp_replace({AFTER_LABEL(T.NATIONALITY_LABEL_RECOVER, FOLDED)}, {q('(?is)' + T.STOP_LABEL + '.*$')}, '')"


@query(f"WITH {NEAR_SQL}, two AS (SELECT doc_id, line_no, CASE WHEN doc_id % 3 = 0 THEN regexp_replace(line, '^.*Quoc tich / ', '') ELSE line END AS line FROM lines) {first_sql('nationality', f'CASE WHEN {has_sql(T.NATIONALITY_LABEL_RECOVER, FOLDED)} THEN {TQ.nation_sql(CUT_NATION)} END', 'two')}")
def l5_nationality_recovered(spark, sf_dir):
    """Of every third card, the line begins with the English label, so that nothing cuts its value."""
    lines = TQ.lines_of(spark, sf_dir).withColumn("line", F.expr("CASE WHEN doc_id % 3 = 0 THEN regexp_replace(line, '^.*Quoc tich / ', '') ELSE line END"))
    return L.labelled_nationality(lines, recover=True)


def looks_sql(c: str) -> str:
    w = f"regexp_extract_all({c}, '[{TQ.LET}0-9]+')"
    return f"(len({w}) >= 2 AND len(list_filter({w}, lambda z: length(z) > 1)) > 0)"


def block_sql(label: str, name: str) -> str:
    part = lambda p: f"trim(regexp_extract(line, {q(p)}, 1), ' :;,/-\"')"
    before, after = part(f"(?is)^(.*?){label}"), part(f"(?is)^.*?{label}(.*)$")
    stop = f"{has_sql(T.STOP_LABEL_LINE, 'x.line')} OR regexp_matches('x' || replace(x.line, ' ', '') || 'x', '[^\\d]\\d{{12}}[^\\d]')"
    return f"""fl_{name} AS (SELECT doc_id, min(line_no) AS f FROM lines WHERE {has_sql(label)} GROUP BY doc_id),
own_{name} AS (SELECT doc_id, f, list_filter([{before}, {after}], lambda p: {looks_sql('p')}) AS own FROM fl_{name} JOIN lines USING (doc_id) WHERE line_no = f),
st_{name} AS (SELECT o.doc_id, min(x.line_no) AS e FROM own_{name} o JOIN lines x ON o.doc_id = x.doc_id AND x.line_no > o.f WHERE {stop} GROUP BY o.doc_id),
nx_{name} AS (SELECT o.doc_id, list(trim(x.line) ORDER BY x.line_no) AS l FROM own_{name} o LEFT JOIN st_{name} s ON o.doc_id = s.doc_id JOIN lines x ON o.doc_id = x.doc_id AND x.line_no > o.f AND x.line_no < coalesce(s.e, 999999) WHERE {looks_sql('x.line')} GROUP BY o.doc_id),
al_{name} AS (SELECT o.doc_id, list_concat(own, coalesce(l, []))[1:3] AS p FROM own_{name} o LEFT JOIN nx_{name} n ON o.doc_id = n.doc_id),
{name}_t AS (SELECT d.doc_id, nullif({TQ.line_address_sql("array_to_string(p, ', ')")}, '') AS {name} FROM (SELECT DISTINCT doc_id FROM lines) d LEFT JOIN al_{name} a ON d.doc_id = a.doc_id)"""


@query(f"WITH {TQ.NORMAL_SQL}, {block_sql(T.ORIGIN_LABEL, 'placeOfOrigin')} SELECT doc_id, placeOfOrigin FROM placeOfOrigin_t")
def l7_address_origin(spark, sf_dir):
    return L.address_block(TQ.lines_of(spark, sf_dir), "placeOfOrigin")


@query(f"WITH {TQ.NORMAL_SQL}, {block_sql(T.RESIDENCE_LABEL, 'placeOfResidence')} SELECT doc_id, placeOfResidence FROM placeOfResidence_t")
def l7_address_residence(spark, sf_dir):
    return L.address_block(TQ.lines_of(spark, sf_dir), "placeOfResidence")


@query()
def l7_address_recovered(spark, sf_dir):
    return L.address_block(TQ.stored_lines_of(spark, sf_dir), "placeOfResidence", mode="recover")


@query(f"WITH {NEAR_SQL} {first_sql('value', label_value_sql(T.ORIGIN_LABEL))}")
def l8_label_value(spark, sf_dir):
    return L.label_value_line(TQ.lines_of(spark, sf_dir), T.ORIGIN_LABEL)


LEGACY_NAME = lambda c: f"upper({TQ.squeeze_sql(f'''regexp_replace({c}, '[^{TQ.LET}\\s]', '', 'g')''')})"
LOUD = f"CASE WHEN NOT regexp_matches(upper(line), '[0-9]') AND len(string_split_regex(trim(line), '\\s+')) >= 2 AND regexp_matches(upper(line), '[A-Z]') AND NOT regexp_matches(upper(line), {q('|'.join(T.NOT_HEADINGS))}) THEN {LEGACY_NAME('line')} END"


@query(f"""WITH {NEAR_SQL}, a AS ({first_sql('x', f"CASE WHEN regexp_matches(upper(line), 'FULL NAME|HO VA TEN|HOVA TEN') AND next IS NOT NULL THEN {LEGACY_NAME('next')} END")}), b AS ({first_sql('y', LOUD)}) SELECT doc_id, coalesce(x, y) AS fullName FROM a JOIN b USING (doc_id)""")
def l9_heuristic_name(spark, sf_dir):
    return L.heuristic_name(TQ.lines_of(spark, sf_dir))


RECORDS_SQL = f"""{NEAR_SQL}, r1 AS ({first_sql('idNumber', ID_SQL)}), r2 AS ({first_sql('fullName', NAME_SQL)}), r3 AS ({first_sql('dateOfBirth', BIRTH_SQL)}), r4 AS ({first_sql('gender', GENDER_SQL)}),
lv AS ({first_sql('a', label_value_sql(T.NATIONALITY_LABEL))}), ln AS ({first_sql('b', "CASE WHEN regexp_matches(line, '(?i)\\bviet\\s*nam\\b') THEN 'Việt Nam' END")}), r5 AS (SELECT doc_id, coalesce({CLEAN_NATION}, b) AS nationality FROM lv JOIN ln USING (doc_id)),
{block_sql(T.ORIGIN_LABEL, 'placeOfOrigin')}, {block_sql(T.RESIDENCE_LABEL, 'placeOfResidence')}, r8 AS ({first_sql('dateOfExpiry', EXPIRY_SQL)}),
records AS (SELECT * FROM r1 JOIN r2 USING (doc_id) JOIN r3 USING (doc_id) JOIN r4 USING (doc_id) JOIN r5 USING (doc_id) JOIN placeOfOrigin_t USING (doc_id) JOIN placeOfResidence_t USING (doc_id) JOIN r8 USING (doc_id))"""


@query(f"WITH {RECORDS_SQL} SELECT doc_id, {', '.join(T.FIELDS)} FROM records")
def l10_extract(spark, sf_dir):
    return L.extract_by_lines(TQ.judged_lines(spark, sf_dir))


LEGACY_DATE = "nullif(regexp_extract(regexp_replace(regexp_replace(translate(t, 'OoIl', '0011'), '(\\d{2})/(\\d{2})1(\\d{4})', '\\1/\\2/\\3', 'g'), '(\\d{2})/(\\d{2})(\\d{4})', '\\1/\\2/\\3', 'g'), '\\b\\d{2}/\\d{2}/\\d{4}\\b'), '')"


@query(f"""WITH {TQ.NORMAL_SQL}, lc AS (SELECT doc_id, line_no, translate(regexp_replace(trim(line), '\\s+', ' ', 'g'), '!|;', '//:') AS line FROM lines), near AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS next FROM lc),
a AS ({first_sql('x', f"CASE WHEN regexp_matches(upper(line), 'FULL NAME|HO VA TEN|HOVA TEN') AND next IS NOT NULL THEN {LEGACY_NAME('next')} END")}), b AS ({first_sql('y', LOUD)}), w AS (SELECT doc_id, string_agg(line, ' ' ORDER BY line_no) AS t FROM lc GROUP BY doc_id)
SELECT w.doc_id, nullif(regexp_extract(t, '\\b\\d{{12}}\\b'), '') AS idNumber, {LEGACY_DATE} AS dateOfBirth, CASE WHEN regexp_matches(upper(t), '\\bNAM\\b') THEN 'Nam' WHEN contains(upper(t), 'NU') OR contains(upper(t), 'NỮ') THEN 'Nữ' END AS gender,
 CASE WHEN regexp_matches(upper(t), 'VIET|VICT|NANA') THEN 'Việt Nam' END AS nationality, coalesce(x, y) AS fullName FROM w JOIN a USING (doc_id) JOIN b USING (doc_id)""")
def l10_extract_legacy(spark, sf_dir):
    return L.extract_by_lines(TQ.lines_of(spark, sf_dir), legacy=True)


# ---- quality

VALID_SQL = f"""list_filter([CASE WHEN NOT coalesce(regexp_matches(idNumber, '^\\d{{12}}$'), false) THEN {q(T.ERRORS['idNumber'])} END, CASE WHEN NOT coalesce(len(list_filter(string_split_regex(fullName, '\\s+'), lambda z: z <> '')) >= 2, false) THEN {q(T.ERRORS['fullName'])} END,
 CASE WHEN try_strptime(dateOfBirth, '%d/%m/%Y') IS NULL THEN {q(T.ERRORS['dateOfBirth'])} END, CASE WHEN NOT coalesce(gender IN ('Nam', 'Nữ'), false) THEN {q(T.ERRORS['gender'])} END, CASE WHEN NOT coalesce(nationality IN ('Viet Nam', 'Việt Nam'), false) THEN {q(T.ERRORS['nationality'])} END], lambda e: e IS NOT NULL)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.extract_by_lines(TQ.judged_lines(spark, sf_dir))


@query(f"WITH {RECORDS_SQL}, v AS (SELECT doc_id, {VALID_SQL} AS errors FROM records) SELECT doc_id, array_to_string(errors, '; ') AS errors, len(errors) = 0 AS is_valid FROM v")
def q1_validate(spark, sf_dir):
    return Q.validate(records(spark, sf_dir)).select("doc_id", F.array_join("errors", "; ").alias("errors"), "is_valid")


FLAGSHIP_SQL = f"WITH {RECORDS_SQL}, v AS (SELECT *, {VALID_SQL} AS errors FROM records) SELECT len(errors)::INT AS n_errors, gender, count(*) AS n, count(dateOfBirth) AS n_born, count(placeOfOrigin) AS n_origin, min(idNumber) AS first_id FROM v GROUP BY ALL"


@query(FLAGSHIP_SQL)
def flagship(spark, sf_dir):
    """Cards to validated records, summed up by error count and gender."""
    checked = Q.validate(records(spark, sf_dir))
    return checked.groupBy(F.size("errors").alias("n_errors"), "gender").agg(F.count("*").alias("n"), F.count("dateOfBirth").alias("n_born"), F.count("placeOfOrigin").alias("n_origin"), F.min("idNumber").alias("first_id"))


def label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields maps of cards: readings of one source, with a field missing or a legacy name now and then."""
    some = V.candidates(spark, sf_dir).where("source = 'FULL_CARD_OCR' AND value IS NOT NULL").withColumn("field", F.expr("CASE WHEN field = 'dateOfExpiry' AND doc_id % 9 = 0 THEN 'issueDate' ELSE field END"))
    return some.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("fields"))


REQUIRED = "[" + ", ".join(map(q, sorted(T.FIELDS))) + "]"


@query(f"""WITH {V.CANDIDATES_SQL}, c AS (SELECT doc_id, list(CASE WHEN field = 'dateOfExpiry' AND doc_id % 9 = 0 THEN 'issueDate' ELSE field END) AS k FROM candidates WHERE source = 'FULL_CARD_OCR' AND value IS NOT NULL GROUP BY doc_id)
SELECT doc_id, array_to_string(list_filter({REQUIRED}, lambda z: NOT list_contains(k, z)), ',') AS missing, CASE WHEN list_contains(k, 'issueDate') THEN 'issueDate' ELSE '' END AS legacy, len(list_filter({REQUIRED}, lambda z: NOT list_contains(k, z))) = 0 AND NOT list_contains(k, 'issueDate') AS is_valid FROM c""")
def q2_label_schema(spark, sf_dir):
    return Q.check_label_schema(label_rows(spark, sf_dir)).select("doc_id", F.array_join("missing", ",").alias("missing"), F.array_join("legacy", ",").alias("legacy"), "is_valid")


@query(f"WITH {V.BOXES_SQL} SELECT doc_id, coalesce({rounded_sql('avg(confidence * 2 - 0.5) FILTER (confidence * 2 - 0.5 BETWEEN 0 AND 1)', 4)}, 0)::DOUBLE AS avg_confidence FROM boxes GROUP BY doc_id")
def q3_avg_confidence(spark, sf_dir):
    return Q.avg_confidence(V.boxes(spark, sf_dir).withColumn("confidence", F.col("confidence") * 2 - 0.5))


@query("WITH o AS (SELECT l_orderkey AS doc_id, l_returnflag AS field, max(CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE round(l_discount * 100) END) AS c FROM lineitem GROUP BY ALL) SELECT doc_id, string_agg(field || '=' || CAST(c::BIGINT AS VARCHAR), ',' ORDER BY field) AS confidences FROM o GROUP BY doc_id")
def q4_field_confidences(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("field"), F.when(F.col("l_linenumber") % 3 == 0, "unreadable").otherwise(F.col("l_discount").cast("string")).alias("confidence"))
    parts = F.transform(F.map_entries("confidences"), lambda e: F.concat(e.key, F.lit("="), F.round(e.value * 100, 0).cast("long").cast("string")))
    return Q.field_confidences(rows).select("doc_id", F.array_join(parts, ",").alias("confidences"))


METRICS = "SELECT l_orderkey * 10 + l_linenumber AS image_id, l_quantity * 4.5 AS blur_score, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice % 200 END AS brightness_score FROM lineitem"


@query(f"WITH m AS ({METRICS}), g AS (SELECT image_id, CASE WHEN blur_score IS NULL OR brightness_score IS NULL THEN 'unreadable' WHEN blur_score < 100 AND brightness_score < 60 THEN 'blurred and dark' WHEN blur_score < 100 THEN 'blurred' WHEN brightness_score < 60 THEN 'dark' END AS reason FROM m) SELECT image_id, reason, reason IS NULL AS accepted FROM g")
def q5_quality_gate(spark, sf_dir):
    V.load(spark, sf_dir, "lineitem")
    return Q.quality_gate(spark.sql(METRICS)).select("image_id", "reason", "accepted")


@query(f"WITH m AS ({METRICS}) SELECT CASE WHEN blur_score < 35 THEN 'very_blurred' WHEN blur_score < 80 THEN 'blurred' WHEN blur_score < 150 THEN 'soft' ELSE 'sharp' END AS band, count(*) AS n FROM m GROUP BY band")
def q6_blur_bands(spark, sf_dir):
    V.load(spark, sf_dir, "lineitem")
    return Q.blur_band(spark.sql(METRICS)).groupBy("band").agg(F.count("*").alias("n"))


def score_sql(source: str = "lines") -> str:
    points = " + ".join([f"CASE WHEN regexp_matches(t, {q(p)}) THEN {w} ELSE 0 END" for p, w in T.CONTENT_PATTERNS] + ["CASE WHEN regexp_matches('x' || t || 'x', '[^\\d]\\d{12}[^\\d]') THEN 3 ELSE 0 END", "CASE WHEN regexp_matches(t, '\\d{1,2}/\\d{1,2}/\\d{4}') THEN 1 ELSE 0 END", "CASE WHEN n >= 8 THEN 0.5 ELSE 0 END"])
    folded = TQ.FOLD.format(c="string_agg(line, ' ' ORDER BY line_no)")
    return f"wt AS (SELECT doc_id, lower({folded}) AS t, count(*) AS n FROM {source} GROUP BY doc_id), ii AS ({first_sql('i', ID_SQL)}), sc AS (SELECT doc_id, round({points} + CASE WHEN i IS NOT NULL THEN 1 ELSE 0 END, 2)::DOUBLE AS score FROM wt JOIN ii USING (doc_id))"


@query(f"WITH {NEAR_SQL}, {score_sql()} SELECT doc_id, score FROM sc")
def q7_content_score(spark, sf_dir):
    return L.content_score(TQ.lines_of(spark, sf_dir))


VARIANTS = "SELECT l_orderkey AS doc_id, CAST(l_linenumber - 1 AS INT) AS variant, l_discount * 100 AS score, CAST((l_linenumber - 1) * 180 + l_orderkey % 4 * 90 AS INT) AS rotation FROM lineitem WHERE l_linenumber <= 2"


@query(f"""WITH v AS ({VARIANTS}), b AS (SELECT doc_id, max(score) FILTER (variant = 0) AS a, max(score) FILTER (variant = 1) AS b, max(rotation) FILTER (variant = 0) AS r0, max(rotation) FILTER (variant = 1) AS r1 FROM v GROUP BY doc_id)
SELECT doc_id, CASE WHEN coalesce(a < 7 AND b >= a + 1.5, false) THEN 1 ELSE 0 END AS variant, round(CASE WHEN coalesce(a < 7 AND b >= a + 1.5, false) THEN b ELSE a END, 4)::DOUBLE AS selected, (CASE WHEN coalesce(a < 7 AND b >= a + 1.5, false) THEN r0 + r1 ELSE r0 END % 360)::INT AS rotation FROM b""")
def q8_pick_variant(spark, sf_dir):
    V.load(spark, sf_dir, "lineitem")
    return Q.pick_variant(spark.sql(VARIANTS)).select("doc_id", "variant", F.round("selected", 4).cast("double").alias("selected"), F.col("rotation").cast("int").alias("rotation"))


TERMS = ["license", "permission", "copyright", "reserved"]
TERMS_SQL = "[" + ", ".join(map(q, TERMS)) + "]"


@query(f"WITH l AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, line_no::INT AS line_no, term, line FROM l, (SELECT unnest({TERMS_SQL}) AS term) WHERE contains(line, term)")
def q9_term_hits(spark, sf_dir):
    return Q.term_hits(spark.read.parquet(f"{sf_dir}/documents.parquet"), TERMS, "doc_id")


#: A term from each document: some letters of its text.
TERM_OF = "replace(substr(text, CAST(1 + doc_id % 60 AS INT), CAST(2 + doc_id % 14 AS INT)), chr(10), ' ')"


@query(f"WITH l AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents), t AS (SELECT DISTINCT {TERM_OF} AS term FROM documents) SELECT doc_id, line_no::INT AS line_no, term, md5(line) AS line FROM l JOIN t ON contains(line, term) WHERE term <> ''")
def q9_term_table(spark, sf_dir):
    """As many terms as there are documents, looked for in all lines."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return Q.term_table_hits(docs, docs.select(F.expr(TERM_OF).alias("term")), "doc_id", shown=F.md5).select("doc_id", "line_no", "term", "line")


@query("WITH m AS (SELECT doc_id, text, replace(replace(replace(text, 'the ', 'THE '), 'license', 'licence'), 'THE THE', 'THE') AS t FROM documents) SELECT doc_id, text <> t AS changed, md5(t) AS text FROM m")
def q10_migrate_terms(spark, sf_dir):
    done = Q.migrate_terms(spark.read.parquet(f"{sf_dir}/documents.parquet"), [("the ", "THE "), ("license", "licence"), ("THE THE", "THE")])
    return done.select("doc_id", "changed", F.md5("text").alias("text"))


# ---- fusion

CLEAN_SQL = f"""{V.CANDIDATES_SQL}, cl AS (SELECT doc_id, field, source, CASE WHEN source = 'RAW_TEXT_RECOVERY' THEN value
 WHEN field = 'idNumber' THEN nullif(regexp_extract(regexp_replace(translate(value, 'OoIl|', '00111'), '\\D', '', 'g'), '\\d{{12}}'), '')
 WHEN field = 'fullName' THEN CASE WHEN len(nw) BETWEEN 2 AND 7 THEN upper(array_to_string(nw, ' ')) END
 WHEN field LIKE 'date%' THEN {TQ.fusion_date_sql('value')} WHEN field = 'gender' THEN {TQ.gender_sql('value')} WHEN field = 'nationality' THEN {TQ.nation_sql('value')} ELSE CASE WHEN ok THEN fa END END AS value
 FROM (SELECT *, len(aw) >= 3 AND len(list_filter(aw, lambda z: length(z) = 1)) < 3 AND NOT regexp_matches(pl, 'full name|date of birth|gioi tinh|sex|quoc tich|nationality|date of expiry|co gia tri den') AND (field <> 'placeOfOrigin' OR length(regexp_replace(pl, '[^0-9]', '', 'g')) <= 2) AS ok
 FROM (SELECT *, regexp_extract_all(pl, '[a-z0-9]+') AS aw FROM (SELECT *, {TQ.fusion_address_sql('value')} AS fa, lower({TQ.FOLD.format(c=TQ.fusion_address_sql('value'))}) AS pl,
  list_filter(regexp_extract_all(regexp_replace(value, {q('(?s)' + T.STOP_LABEL + '.*$')}, '', 'i'), '\\pL+'), lambda x: NOT list_contains({TQ.NOT_NAMES}, upper({TQ.FOLD.format(c='x')})) AND length(x) > 1) AS nw FROM candidates))))"""
PRIORITY_SQL = "prio(field, source, rank) AS (VALUES " + ", ".join(f"('{f}', '{s}', {k})" for f, order in T.PRIORITIES.items() for k, s in enumerate(order)) + ")"
FUSED_SQL = f"{CLEAN_SQL}, {PRIORITY_SQL}, rk AS (SELECT * FROM cl JOIN prio USING (field, source) WHERE value <> ''), bs AS (SELECT doc_id, field, arg_min(value, rank) AS value, arg_min(source, rank) AS source FROM rk GROUP BY ALL), dm AS (SELECT k AS doc_id, unnest([{', '.join(map(q, T.FIELDS))}]) AS field FROM truth), fused AS (SELECT doc_id, field, value, coalesce(source, 'NOT_FOUND') AS source FROM dm LEFT JOIN bs USING (doc_id, field))"


@query(f"""WITH {V.CANDIDATES_SQL}, p AS (SELECT doc_id, field, max(value) FILTER (source = 'FIELD_OCR') AS a, max(value) FILTER (source = 'FULL_CARD_OCR') AS b FROM candidates GROUP BY ALL)
SELECT doc_id, field, coalesce(trim(a), trim(b)) AS value, CASE WHEN a IS NOT NULL THEN 'FIELD_OCR' WHEN b IS NOT NULL THEN 'FULL_CARD_OCR' ELSE 'NOT_FOUND' END AS source FROM p""")
def f1_merge_two(spark, sf_dir):
    pick = lambda s: F.max(F.when(F.col("source") == s, F.col("value")))
    wide = V.candidates(spark, sf_dir).groupBy("doc_id", "field").agg(pick("FIELD_OCR").alias("field_value"), pick("FULL_CARD_OCR").alias("full_value"))
    return Fu.merge_two(wide).select("doc_id", "field", "value", "source")


@query(f"WITH {FUSED_SQL} SELECT doc_id, field, value, source FROM fused")
def f2_fuse(spark, sf_dir):
    return Fu.fuse(V.candidates(spark, sf_dir))


MARKS = "(length({c}) - length(regexp_replace({c}, '[^\\x00-\\x7F]', '', 'g')))"
NAMES_SQL = f"{FUSED_SQL}, nk AS (SELECT *, upper({TQ.FOLD.format(c='value')}) AS k, len(list_filter(string_split(value, ''), lambda z: z IN ('Ổ', 'Ă', 'Ồ', 'ổ', 'ă'))) * 2 - len(list_filter(string_split(value, ''), lambda z: z IN ('Ă', 'ă'))) AS sc FROM rk WHERE field = 'fullName'), nb AS (SELECT doc_id, k, min(rank) AS f, arg_max(value, sc * 10 - rank) AS value, arg_max(source, sc * 10 - rank) AS source FROM nk GROUP BY ALL), nn AS (SELECT doc_id, arg_min(value, f) AS value, arg_min(source, f) AS source FROM nb GROUP BY doc_id)"


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Fu.clean_candidates(V.candidates(spark, sf_dir))


@query(f"WITH {NAMES_SQL} SELECT doc_id, value, source FROM nn")
def f3_richest(spark, sf_dir):
    return Fu.richest_equivalent(cleaned(spark, sf_dir))


@query(f"""WITH {NAMES_SQL}, sp AS (SELECT doc_id, count(DISTINCT upper(split_part(value, ' ', 1))) AS n FROM cl WHERE field = 'fullName' AND value <> '' AND upper({TQ.FOLD.format(c="split_part(value, ' ', 1)")}) = 'HO' GROUP BY doc_id)
SELECT doc_id, CASE WHEN n >= 2 AND upper({TQ.FOLD.format(c="split_part(value, ' ', 1)")}) = 'HO' THEN 'HỒ' || substr(value, length(split_part(value, ' ', 1)) + 1) ELSE value END AS value FROM nn LEFT JOIN sp USING (doc_id)""")
def f4_disputed(spark, sf_dir):
    rows = cleaned(spark, sf_dir)
    return Fu.reconcile_disputed(Fu.richest_equivalent(rows).select("doc_id", "value"), rows.where("field = 'fullName'").select("doc_id", "value"))


def case_sql(c: str, d: dict[str, str]) -> str:
    return f"CASE upper({TQ.FOLD.format(c=c)}) " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in d.items()) + f" ELSE {c} END"


@query(f"""WITH truth AS ({V.TRUTH}), w AS (SELECT k AS doc_id, string_split(name, ' ') AS w, CASE WHEN k % 3 = 0 THEN NULL WHEN sex = 'Nu' THEN 'Nữ' ELSE 'Nam' END AS gender FROM truth)
SELECT doc_id, gender, CASE WHEN gender IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_transform(w, lambda x, i: CASE WHEN i = 1 THEN {case_sql('x', T.SURNAMES)} WHEN gender = 'Nữ' THEN {case_sql('x', T.FEMALE_NAMES)} ELSE {case_sql('x', T.MALE_NAMES)} END), ' ') END AS fullName FROM w""")
def f5_context(spark, sf_dir):
    rows = V.truth(spark, sf_dir).select(F.col("k").alias("doc_id"), F.col("name").alias("fullName"), F.expr("CASE WHEN k % 3 = 0 THEN NULL WHEN sex = 'Nu' THEN 'Nữ' ELSE 'Nam' END").alias("gender"))
    return Fu.restore_by_context(rows).select("doc_id", "gender", "fullName")


def address_readings(spark: SparkSession, sf_dir: str, field: str) -> tuple[DataFrame, DataFrame]:
    rows = cleaned(spark, sf_dir).where(F.col("field") == field)
    own = Fu.fuse(V.candidates(spark, sf_dir)).where((F.col("field") == field) & F.col("value").isNotNull()).select("doc_id", "value")
    return own, rows.select("doc_id", "value")


PIECES = "list_filter(list_transform(regexp_split_to_array(value, '[,;]'), lambda p: trim(p, ' ,.;:/-')), lambda p: p <> '')"
TOKENS = "regexp_extract_all(value, '[\\pL\\pN]+|[^\\pL\\pN]+')"


def components_sql(field: str, name: str) -> str:
    """CTE ``name`` (doc_id, value): F6 on a field of ``fused`` and ``cl``."""
    return f"""al_{name} AS (SELECT doc_id, unnest({PIECES}) AS p FROM cl WHERE field = '{field}' AND value <> ''), ag_{name} AS (SELECT doc_id, {TQ.key_sql('p')} AS k, count(DISTINCT lower(p)) AS n, max(p) AS s FROM al_{name} WHERE regexp_matches(p, '[^\\x00-\\x7F]') GROUP BY ALL),
ow_{name} AS (SELECT doc_id, unnest(range(0, len({PIECES}))) AS i, unnest({PIECES}) AS p FROM fused WHERE field = '{field}' AND value IS NOT NULL),
{name} AS (SELECT o.doc_id, string_agg(CASE WHEN n = 1 AND NOT regexp_matches(p, '[^\\x00-\\x7F]') THEN s ELSE p END, ', ' ORDER BY i) AS value FROM ow_{name} o LEFT JOIN ag_{name} g ON o.doc_id = g.doc_id AND {TQ.key_sql('p')} = g.k GROUP BY o.doc_id)"""


def identifiers_sql(field: str, own: str, name: str) -> str:
    """CTE ``name`` (doc_id, value): F7 on ``own`` (doc_id, value) with the readings of a field of ``cl``."""
    return f"""tk_{name} AS (SELECT doc_id, unnest({TOKENS}) AS t FROM cl WHERE field = '{field}' AND value <> ''), ix_{name} AS (SELECT doc_id, translate(lower({TQ.FOLD.format(c='t')}), '8015', 'bois') AS k, count(DISTINCT t) AS n, max(t) AS t FROM tk_{name} WHERE regexp_matches(t, '\\pN') AND regexp_matches(t, '\\pL') GROUP BY ALL),
wd_{name} AS (SELECT doc_id, unnest(range(0, len({TOKENS}))) AS i, unnest({TOKENS}) AS w FROM ({own})),
{name} AS (SELECT d.doc_id, string_agg(CASE WHEN n = 1 AND regexp_matches(w, '^[0-9]+$') THEN t ELSE w END, '' ORDER BY i) AS value FROM wd_{name} d LEFT JOIN ix_{name} x ON d.doc_id = x.doc_id AND translate(w, '8015', 'bois') = x.k GROUP BY d.doc_id)"""


@query(f"WITH {FUSED_SQL}, {components_sql('placeOfOrigin', 'fixed')} SELECT doc_id, value FROM fixed")
def f6_components(spark, sf_dir):
    return Fu.restore_components(*address_readings(spark, sf_dir, "placeOfOrigin"))


@query(f"""WITH {FUSED_SQL}, {identifiers_sql('placeOfResidence', "SELECT doc_id, value FROM fused WHERE field = 'placeOfResidence' AND value IS NOT NULL", 'fixed')} SELECT doc_id, value FROM fixed""")
def f7_identifiers(spark, sf_dir):
    return Fu.repair_identifiers(*address_readings(spark, sf_dir, "placeOfResidence"))


@query(f"WITH {V.CARDS_SQL} SELECT doc_id, line_no::INT AS line_no, {TQ.phrases_sql('line', T.PLACES)} AS line FROM raw_cards WHERE line_no BETWEEN 6 AND 9")
def f8_gazetteer(spark, sf_dir):
    return V.cards(spark, sf_dir).where("line_no BETWEEN 6 AND 9").select("doc_id", "line_no", X.apply_gazetteer("line").alias("line"))


PLAIN = TQ.squeeze_sql(f"regexp_replace(lower({TQ.FOLD.format(c='line')}), '[^a-z0-9/,;:\\-\\s]', ' ', 'g')")


@query(f"""WITH {TQ.NORMAL_SQL}, p AS (SELECT doc_id, line_no, {PLAIN} AS p FROM lines), w AS (SELECT *, regexp_extract_all(p, '[a-z0-9]+') AS w FROM p)
SELECT doc_id, line_no::INT AS line_no, len(w) >= 3 AND len(list_filter(w, lambda z: length(z) = 1)) < 3 AND NOT list_has_any(w, [{', '.join(map(q, T.NOISE_WORDS))}]) AND NOT regexp_matches(p, {q('|'.join(T.NOT_ADDRESS_LABELS))}) AND length(regexp_replace(p, '[^0-9]', '', 'g')) <= 2 AS valid FROM w""")
def f9_valid_address(spark, sf_dir):
    return TQ.lines_of(spark, sf_dir, X.is_valid_address("line", True)).select("doc_id", "line_no", F.col("facts").alias("valid"))


@query(f"""WITH {TQ.NORMAL_SQL}, w AS (SELECT doc_id, line_no, list_filter(string_split_regex(upper({TQ.FOLD.format(c='line')}), '\\s+'), lambda z: z <> '') AS w FROM lines)
SELECT doc_id, line_no::INT AS line_no, len(w) BETWEEN 2 AND 8 AND len(list_filter(w, lambda z: NOT list_contains({TQ.NOT_NAMES}, z))) >= 2 AS valid FROM w""")
def f10_valid_name(spark, sf_dir):
    return TQ.lines_of(spark, sf_dir, X.is_valid_name("line")).select("doc_id", "line_no", F.col("facts").alias("valid"))


SPELT_SQL = f"""sp AS (SELECT doc_id, count(DISTINCT upper(split_part(value, ' ', 1))) AS n FROM cl WHERE field = 'fullName' AND value <> '' AND upper({TQ.FOLD.format(c="split_part(value, ' ', 1)")}) = 'HO' GROUP BY doc_id),
nm AS (SELECT doc_id, source, CASE WHEN n >= 2 AND upper({TQ.FOLD.format(c="split_part(value, ' ', 1)")}) = 'HO' THEN 'HỒ' || substr(value, length(split_part(value, ' ', 1)) + 1) ELSE value END AS value FROM nn LEFT JOIN sp USING (doc_id))"""
ONE_FIELD = ", ".join(f"max(value) FILTER (field = '{f}') AS {f}, max(source) FILTER (field = '{f}') AS s_{f}" for f in T.FIELDS)
SOURCES_JSON = "'{' || " + " || ',' || ".join(f"'\"{f}\":\"' || " + ("coalesce(nm.source, 'NOT_FOUND')" if f == "fullName" else f"s_{f}") + " || '\"'" for f in T.FIELDS) + " || '}'"
CONTEXT = f"""CASE WHEN nm.value IS NULL OR coalesce(gender, '') = '' THEN nm.value ELSE array_to_string(list_transform(string_split(nm.value, ' '), lambda x, i: CASE WHEN i = 1 THEN {case_sql('x', T.SURNAMES)} WHEN gender = 'Nữ' THEN {case_sql('x', T.FEMALE_NAMES)} WHEN gender = 'Nam' THEN {case_sql('x', T.MALE_NAMES)} ELSE x END), ' ') END"""


@query(f"""WITH {NAMES_SQL.replace(', cl AS (', ', cl AS MATERIALIZED (').replace(', fused AS (', ', fused AS MATERIALIZED (')}, {SPELT_SQL}, {components_sql('placeOfOrigin', 'o1')}, {identifiers_sql('placeOfOrigin', 'SELECT * FROM o1', 'o2')}, {components_sql('placeOfResidence', 'r1')}, {identifiers_sql('placeOfResidence', 'SELECT * FROM r1', 'r2')},
wide AS (SELECT doc_id, {ONE_FIELD} FROM fused GROUP BY doc_id)
SELECT wide.doc_id, idNumber, {CONTEXT} AS fullName, dateOfBirth, gender, nationality, {TQ.phrases_sql('o2.value', T.PLACES)} AS placeOfOrigin, {TQ.phrases_sql('r2.value', T.PLACES)} AS placeOfResidence, dateOfExpiry, {SOURCES_JSON} AS sources
FROM wide LEFT JOIN nm ON wide.doc_id = nm.doc_id LEFT JOIN o2 ON wide.doc_id = o2.doc_id LEFT JOIN r2 ON wide.doc_id = r2.doc_id""")
def fuse_records(spark, sf_dir):
    return Fu.fuse_records(V.candidates(spark, sf_dir)).withColumn("sources", F.to_json("sources"))


PRIORITY_V1_SQL = "prio1(field, source, rank) AS (VALUES " + ", ".join(f"('{f}', '{s}', {k})" for f, order in T.PRIORITIES_V1.items() for k, s in enumerate(order)) + ")"


@query(f"""WITH {V.CANDIDATES_SQL}, {PRIORITY_V1_SQL}, rk AS (SELECT * FROM candidates JOIN prio1 USING (field, source) WHERE field IN ('gender', 'idNumber', 'dateOfExpiry', 'placeOfOrigin', 'placeOfResidence') AND value <> ''), bs AS (SELECT doc_id, field, arg_min(value, rank) AS value, arg_min(source, rank) AS source FROM rk GROUP BY ALL),
dm AS (SELECT k AS doc_id, unnest(['gender', 'idNumber', 'dateOfExpiry', 'placeOfOrigin', 'placeOfResidence']) AS field FROM truth) SELECT doc_id, field, value, coalesce(source, 'NOT_FOUND') AS source FROM dm LEFT JOIN bs USING (doc_id, field)""")
def f2_fuse_earlier(spark, sf_dir):
    """The five fields that the earlier rules take as they are."""
    return Fu.fuse_v1(V.candidates(spark, sf_dir)).where("field NOT IN ('fullName', 'dateOfBirth', 'nationality')")


# ---- vectors


@query("WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), s AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS s FROM n) SELECT vec_id, CASE WHEN s <= 1e-12 THEN 'zero_norm' END AS reject, round(e[1] / s, 6) AS first, round(list_max(e) / s, 6) AS largest FROM s")
def e1_prepare_vectors(spark, sf_dir):
    done = E.prepare_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), dimension=64)
    return done.select("vec_id", "reject", F.round(F.get("unit", F.lit(0)), 6).alias("first"), F.round(F.array_max("unit"), 6).alias("largest"))


FACES = """SELECT l_orderkey AS image_id, CAST(l_linenumber AS BIGINT) AS pos, CAST(l_partkey % 700 AS DOUBLE) AS x, CAST(l_suppkey % 300 AS DOUBLE) AS y, CAST(20 + l_quantity * 4 AS DOUBLE) AS w, CAST(20 + l_quantity * 5 AS DOUBLE) AS h, 1 - CAST(l_discount AS DOUBLE) * 6 AS score, CASE WHEN l_linenumber % 2 = 0 THEN 'region' ELSE 'image' END AS pass FROM lineitem"""


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    V.load(spark, sf_dir, "lineitem")
    return spark.sql(FACES).select("image_id", "pos", F.col("x").alias("left"), F.col("y").alias("top"), (F.col("x") + F.col("w")).alias("right"), (F.col("y") + F.col("h")).alias("bottom"), "score", "pass")


@query(f"WITH f AS ({FACES}) SELECT image_id, pos, round(w * h, 4) AS area FROM f WHERE score >= 0.6 QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY w * h DESC, pos) = 1")
def e2_largest_face(spark, sf_dir):
    return E.largest_per_image(faces(spark, sf_dir)).select("image_id", "pos", F.round("area", 4).alias("area"))


IMAGES = "SELECT o_orderkey AS image_id, CAST(900 + o_orderkey % 3 * 100 AS INT) AS width, CAST(600 + o_orderkey % 2 * 30 AS INT) AS height FROM orders"
PORTRAIT_SQL = f"""f AS ({FACES}), i AS ({IMAGES}), r AS (SELECT *, floor(width * 0.02) AS x1, floor(width * 0.37) AS x2, floor(height * 0.25) AS y1, floor(height * 0.94) AS y2 FROM i),
g AS (SELECT image_id, pos, x + CASE WHEN pass = 'region' THEN x1 ELSE 0 END AS l, y + CASE WHEN pass = 'region' THEN y1 ELSE 0 END AS t, w, h, score, CASE WHEN pass = 'region' THEN 1 WHEN x + w / 2 <= 0.55 * width AND y + h / 2 BETWEEN 0.15 * height AND 0.92 * height AND w >= 40 AND h >= 40 THEN 0 END AS b FROM f JOIN r USING (image_id) WHERE score >= 0.4),
u AS (SELECT image_id, pos, l, t, l + w AS rr, t + h AS bb, score, b, w * h AS a FROM g WHERE b IS NOT NULL UNION ALL SELECT image_id, 0, x1, y1, x2, y2, 0, 2, 0 FROM r),
portrait AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY b, a DESC, score DESC, pos, l, t) = 1)"""


@query(f"WITH {PORTRAIT_SQL} SELECT image_id, round(l, 3)::DOUBLE AS \"left\", round(t, 3)::DOUBLE AS top, round(rr, 3)::DOUBLE AS \"right\", round(bb, 3)::DOUBLE AS bottom, ['whole_image', 'region', 'fixed_region'][b + 1] AS method FROM portrait")
def e3_portrait(spark, sf_dir):
    V.load(spark, sf_dir, "orders")
    found = E.select_portrait(faces(spark, sf_dir), spark.sql(IMAGES))
    return found.select("image_id", *(F.round(c, 3).alias(c) for c in ("left", "top", "right", "bottom")), "method")


@query(f"""WITH f AS ({FACES}), i AS ({IMAGES}), c AS (SELECT image_id, pos, least(greatest(trunc(x - w * 0.25), 0), width)::INT AS crop_left, least(greatest(trunc(y - h * 0.25), 0), height)::INT AS crop_top, least(greatest(trunc(x + w + w * 0.25), 0), width)::INT AS crop_right, least(greatest(trunc(y + h + h * 0.45), 0), height)::INT AS crop_bottom FROM f JOIN i USING (image_id))
SELECT *, crop_right <= crop_left OR crop_bottom <= crop_top AS crop_error FROM c""")
def e4_crop(spark, sf_dir):
    V.load(spark, sf_dir, "orders")
    done = E.crop_box(faces(spark, sf_dir).hint("merge").join(spark.sql(IMAGES).hint("merge"), "image_id"))
    return done.select("image_id", "pos", "crop_left", "crop_top", "crop_right", "crop_bottom", "crop_error")


def pair_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pairs = V.pairs(spark, sf_dir)
    return pairs.select("subject_id", "probe_id", "embedding"), pairs.select("subject_id", F.col("enrolled").alias("embedding"))


COS = "list_sum(list_transform(range(1, len(embedding) + 1), lambda i: embedding[i] * enrolled[i])) / sqrt(list_sum(list_transform(embedding, lambda x: x * x))) / sqrt(list_sum(list_transform(enrolled, lambda x: x * x)))"


@query(f"WITH {V.PAIRS_SQL} SELECT subject_id, probe_id, round({COS}, 6) AS similarity, round(1 - {COS}, 6) AS distance FROM pairs")
def e5_verify(spark, sf_dir):
    done = E.verify_pairs(*pair_tables(spark, sf_dir))
    return done.select("subject_id", "probe_id", F.round("similarity", 6).alias("similarity"), F.round("distance", 6).alias("distance"))


@query(f"WITH {V.PAIRS_SQL}, s AS (SELECT subject_id, {COS} AS s FROM pairs) SELECT subject_id, round(s, 4) AS similarity, CASE WHEN s >= 0.5 THEN 'match' WHEN s >= 0.4 THEN 'review' ELSE 'not_match' END AS verdict, s >= 0.4 AND s < 0.5 AS needs_review FROM s")
def e6_decide(spark, sf_dir):
    return E.decide(E.verify_pairs(*pair_tables(spark, sf_dir))).select("subject_id", "similarity", "verdict", "needs_review")


QUADS = "SELECT l_orderkey AS image_id, CAST(l_linenumber AS BIGINT) AS quad_id, CAST(l_partkey % 90 AS DOUBLE) AS x, CAST(l_suppkey % 60 AS DOUBLE) AS y, CAST(300 + l_quantity * 12 AS DOUBLE) AS w, CAST(300 + l_linenumber * 60 AS DOUBLE) AS h FROM lineitem"


@query(f"""WITH z AS ({QUADS}), i AS ({IMAGES}), g AS (SELECT *, w * h AS area FROM z JOIN i USING (image_id) WHERE w * h >= 0.2 * width * height AND greatest(w, h) / least(w, h) BETWEEN 1.35 AND 2.35)
SELECT image_id, quad_id, area, greatest(round(greatest(w, h)), 64)::INT AS out_width, greatest(round(greatest(round(greatest(w, h)), 64)::INT / (85.60 / 53.98)), 64)::INT AS out_height, h > w AS rotate FROM g QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY area DESC, quad_id) = 1""")
def e7_quads(spark, sf_dir):
    V.load(spark, sf_dir, "orders", "lineitem")
    quads = spark.sql(QUADS).select("image_id", "quad_id", F.expr("array(array(x + w, y + h), array(x, y), array(x + w, y), array(x, y + h))").alias("corners"), (F.col("w") * F.col("h")).alias("area"))
    return E.screen_quads(quads, spark.sql(IMAGES)).select("image_id", "quad_id", "area", "out_width", "out_height", "rotate")


# ---- sources and sinks


@query(f"WITH {V.CARDS_SQL} SELECT doc_id, line_no::INT AS box_id, trim(line) AS text, (doc_id % 100) / 100.0::DOUBLE AS confidence FROM raw_cards WHERE trim(line) <> '' AND line_no < 9")
def s3_explode(spark, sf_dir):
    rows = V.cards(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    score = F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: (F.col("doc_id") % 100) / 100.0)
    packed = rows.select("doc_id", F.struct(F.transform("l", lambda s: s.line).alias("texts"), score.alias("scores"), F.transform("l", lambda s: F.array(F.array(s.line_no))).alias("boxes")).alias("items"))
    return S.explode_boxes(packed, normalize=False).select("doc_id", "box_id", "text", "confidence")


@query(f"WITH {RECORDS_SQL}, v AS (SELECT *, {VALID_SQL} AS errors FROM records) SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'error' ELSE 'success' END AS status, CASE WHEN doc_id % 13 <> 0 THEN idNumber END AS idNumber, CASE WHEN doc_id % 13 = 0 THEN false ELSE len(errors) = 0 END AS is_valid, CASE WHEN doc_id % 13 = 0 THEN 'no card found' ELSE array_to_string(errors, '; ') END AS errors FROM v")
def s4_results(spark, sf_dir):
    checked = Q.validate(records(spark, sf_dir))
    good = S.as_success_record(checked.where("doc_id % 13 <> 0"))
    bad = S.as_error_record(checked.where("doc_id % 13 = 0").select("doc_id", F.lit("no card found").alias("message")))
    return good.unionByName(bad).select("doc_id", "status", F.col("data.idNumber").alias("idNumber"), "is_valid", F.array_join("errors", "; ").alias("errors"))


@query("SELECT url AS path, page_id * 100000 AS length, lower(regexp_extract(url, '\\.([^./]+)$', 1)) AS ext, lower(regexp_extract(url, '\\.([^./]+)$', 1)) IN ('jpg', 'jpeg', 'png') AND page_id > 0 AND page_id * 100000 <= 10485760 AS accepted FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') || CASE page_id % 4 WHEN 0 THEN '.JPG' WHEN 1 THEN '.png' WHEN 2 THEN '.gif' ELSE '' END AS url FROM pages)")
def s2_intake(spark, sf_dir):
    V.load(spark, sf_dir, "pages")
    files = spark.sql(r"SELECT regexp_replace(url, '[?#].*$', '') || CASE page_id % 4 WHEN 0 THEN '.JPG' WHEN 1 THEN '.png' WHEN 2 THEN '.gif' ELSE '' END AS path, page_id * 100000 AS length FROM pages")
    return S.intake(files).select("path", "length", "ext", "accepted")


# letters of Western Europe are the same bytes in both code pages, and no valid UTF-8 before an ASCII letter
WESTERN = "CASE WHEN doc_id % 3 = 1 THEN 'Café à la crème, n° ' || doc_id WHEN doc_id % 3 = 2 THEN 'ÃÒ ' || doc_id ELSE text END"


@query(f"SELECT doc_id, md5(CASE WHEN doc_id % 3 = 2 THEN 'Ẳ ' || doc_id ELSE {WESTERN} END) AS text, CASE WHEN doc_id % 3 = 0 THEN 'utf-8' ELSE 'cp1258' END AS charset FROM documents")
def s5_decode_charsets(spark, sf_dir):
    """Two of three documents in a code page: what cp1258 can decode is read as it, also where cp1252 was meant."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("path"), "doc_id", F.expr(WESTERN).alias("text"))
    raw = F.when(F.col("doc_id") % 3 == 0, F.encode("text", "UTF-8")).otherwise(F.encode("text", "ISO-8859-1"))
    return S.decode_fallback(docs.select("path", raw.alias("content"))).select(F.col("path").alias("doc_id"), F.md5("text").alias("text"), "charset")


@query("SELECT doc_id, md5(text) AS text, 'utf-8' AS charset FROM documents")
def s5_decode(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("path"), F.col("text").cast("binary").alias("content"))
    return S.decode_fallback(docs).select(F.col("path").alias("doc_id"), F.md5("text").alias("text"), "charset")


NESTED = """'{"sampleId": "' || CAST(k AS STRING) || '", "documentType": "CARD", "fields": {"idNumber": "' || id || '", "fullName": "' || name || '"}}'"""
LABEL_TEXT = f"""CASE k % 4 WHEN 0 THEN {NESTED} WHEN 1 THEN '{{"sampleId": "' || CAST(k AS STRING) || '", "idNumber": "' || id || '", "fullName": "' || name || '"}}' WHEN 2 THEN char(65279) || {NESTED} ELSE '["' || id || '"]' END"""


@query(f"""WITH truth AS ({V.TRUTH}) SELECT k AS path, CASE WHEN k % 4 < 3 THEN CAST(k AS VARCHAR) END AS sample_id, CASE WHEN k % 4 IN (0, 2) THEN 'CARD' END AS document_type, CASE WHEN k % 4 < 3 THEN id END AS idNumber, CASE WHEN k % 4 < 3 THEN name END AS fullName,
CASE WHEN k % 4 < 3 THEN 2 END::INT AS n_fields, CASE WHEN k % 4 = 3 THEN 'not a JSON object' END AS parse_error FROM truth""")
def s1_labels(spark, sf_dir):
    """Label texts of cards: with a fields object, flat, with a byte-order mark, and no object at all."""
    found = S.parse_labels(V.truth(spark, sf_dir).select(F.col("k").alias("path"), F.expr(LABEL_TEXT.replace("char(65279)", "'\ufeff'")).alias("value")))
    size = F.when(F.col("fields").isNotNull(), F.size("fields"))
    return found.select("path", "sample_id", "document_type", F.col("fields")["idNumber"].alias("idNumber"), F.col("fields")["fullName"].alias("fullName"), size.alias("n_fields"), "parse_error")


STREAMED_SQL = f"WITH {RECORDS_SQL}, v AS (SELECT doc_id, idNumber, gender, {VALID_SQL} AS errors FROM records) SELECT doc_id, idNumber, gender, array_to_string(errors, '; ') AS errors, len(errors) = 0 AS is_valid FROM v"


@query(STREAMED_SQL)
def s6_stream(spark, sf_dir):
    """Cards that arrive as files, run through the stream; the SQL is that of the batch form."""
    base = folder(spark, "arrivals")
    packed = V.cards(spark, sf_dir).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x.line).alias("lines"))
    packed.select("doc_id", F.lit("2024-01-01 00:00:00").alias("arrived"), "lines").write.json(f"{base}/in")
    stream_records(spark, f"{base}/in", f"{base}/out", f"{base}/state").awaitTermination()
    done = spark.read.parquet(f"{base}/out")
    return done.select("doc_id", "idNumber", "gender", F.array_join("errors", "; ").alias("errors"), "is_valid")


@query(STREAMED_SQL)
def s6_parts(spark, sf_dir):
    """Cards whose lines arrive in two halves, in any order of files; the SQL is that of the batch form."""
    base = folder(spark, "arrivals")
    lines = V.cards(spark, sf_dir).withColumns({"part": F.floor(F.col("line_no") / 6).cast("int"), "parts": F.lit(2)})
    packed = lines.groupBy("doc_id", "part", "parts").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x.line).alias("lines"))
    packed.select("doc_id", F.lit("2024-01-01 00:00:00").alias("arrived"), "part", "parts", "lines").repartition("part", "doc_id").write.json(f"{base}/in")
    stream_parts(spark, f"{base}/in", f"{base}/out", f"{base}/state").awaitTermination()
    done = spark.read.parquet(f"{base}/out/records")
    return done.select("doc_id", "idNumber", "gender", F.array_join("errors", "; ").alias("errors"), "is_valid")
