"""Queries of the text rules (T1 to T16) over cards, candidate readings and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from pergament.functions import tables as T
from pergament.functions import text as X
from pergament.operators import labels as A
from pergament.operators import lines as L
from pergament.operators.cleaning import clean_columns
from pergament.operators.dictionary import remembered
from pergament.plans import views as V
from pergament.plans.registry import query
from pergament.sources.scratch import stored_by

LET = "A-Za-zÀ-ỹ"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def phrases_sql(c: str, phrases=T.PHRASES) -> str:
    for pattern, new in phrases:
        c = f"regexp_replace({c}, {q(pattern)}, {q(new)}, 'gi')"
    return c


def slashes_sql(c: str) -> str:
    for _ in range(2):
        c = f"regexp_replace({c}, '(\\d)\\s*/\\s*(\\d)', '\\1/\\2', 'g')"
    for _ in range(2):
        c = f"regexp_replace({c}, '([{LET}])\\s*/\\s*([{LET}])', '\\1 / \\2', 'g')"
    return c


def squeeze_sql(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def normalize_sql(c: str) -> str:
    c = squeeze_sql(f"translate({c}, '_|–—', ' /--')")
    c = f"regexp_replace(regexp_replace({c}, '\\s+([,.:;])', '\\1', 'g'), '([,:;])([{LET}0-9])', '\\1 \\2', 'g')"
    return squeeze_sql(slashes_sql(phrases_sql(slashes_sql(c))))


#: Normalised card lines, renumbered; used by all line queries.
NORMAL_SQL = V.CARDS_SQL + f", n0 AS (SELECT doc_id, line_no AS place, {normalize_sql('line')} AS line FROM raw_cards), lines AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS line_no, line FROM n0 WHERE line <> '')"


def lines_of(spark, sf_dir, facts=False):
    return L.renumber(L.normalized(V.cards(spark, sf_dir).withColumnRenamed("line_no", "at"), compose=False, once=True, facts=facts))


def stored_lines_of(spark, sf_dir):
    """The same, written by card, for operators that pass over the lines several times."""
    return stored_by(lines_of(spark, sf_dir), "card_lines", "doc_id", V.card_parts(spark, sf_dir))


def judged_lines(spark, sf_dir):
    """The same for extraction: with the facts of each line, in the order of their places on the card."""
    lines = L.normalized(V.cards(spark, sf_dir).withColumnRenamed("line_no", "at"), compose=False, once=True, facts=True)
    return lines.withColumnRenamed("at", "line_no")


@query(f"WITH {V.CARDS_SQL} SELECT doc_id, line_no::INT AS line_no, {normalize_sql('line')} AS line FROM raw_cards")
def t1_normalize(spark, sf_dir):
    rows = remembered(V.cards(spark, sf_dir), ["line"], lambda values: values.withColumn("made", X.normalize_text("line")))
    return rows.select("doc_id", "line_no", F.when(F.col("__known").isNotNull(), F.col("__known.made")).otherwise(X.normalize_text("line")).alias("line"))


@query("SELECT doc_id, md5(replace(replace(strip_accents(text), 'đ', 'd'), 'Đ', 'D')) AS folded, md5(trim(regexp_replace(lower(replace(replace(strip_accents(text), 'đ', 'd'), 'Đ', 'D')), '[^a-z0-9]+', ' ', 'g'))) AS anchor FROM documents")
def t2_fold(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.md5(X.fold("text")).alias("folded"), F.md5(X.key("text", "anchor")).alias("anchor"))


@query(f"WITH {V.CARDS_SQL} SELECT doc_id, line_no::INT AS line_no, {phrases_sql('line')} AS line FROM raw_cards")
def t3_phrases(spark, sf_dir):
    return V.cards(spark, sf_dir).select("doc_id", "line_no", X.replace_phrases("line").alias("line"))


@query(f"WITH {NORMAL_SQL} SELECT doc_id, line_no::INT AS line_no, line FROM lines")
def t4_normalize_lines(spark, sf_dir):
    return lines_of(spark, sf_dir)


@query(f"WITH {V.CANDIDATES_SQL} SELECT doc_id, field, source, translate(value, 'OoIl|', '00111') AS fusion, translate(value, 'OoIiLl', '001111') AS field_, translate(upper(value), 'OILSB', '01158') AS layout, translate(value, 'OoIilh', '00111/') AS dates FROM candidates WHERE field IN ('idNumber', 'dateOfBirth')")
def t5_digits(spark, sf_dir):
    some = V.candidates(spark, sf_dir).where("field IN ('idNumber', 'dateOfBirth')")
    return some.select("doc_id", "field", "source", *(X.fix_digits("value", p).alias("field_" if p == "field" else p) for p in ("fusion", "field", "layout", "dates")))


def dmy_sql(c: str, pattern: str) -> str:
    return f"lpad(regexp_extract({c}, {q(pattern)}, 1), 2, '0') || '/' || lpad(regexp_extract({c}, {q(pattern)}, 2), 2, '0') || '/' || regexp_extract({c}, {q(pattern)}, 3)"


def real_sql(c: str, low: int = 1, high: int = 9999) -> str:
    return f"CASE WHEN year(try_strptime({c}, '%d/%m/%Y')) BETWEEN {low} AND {high} THEN {c} END"


def eight_sql(d: str) -> str:
    return f"substr({d}, 1, 2) || '/' || substr({d}, 3, 2) || '/' || substr({d}, 5, 4)"


def fusion_date_sql(v: str) -> str:
    t = f"regexp_replace(translate({v}, 'OoIl|', '00111'), '\\s+', '', 'g')"
    padded, p = f"('x' || {t} || 'x')", r"[^\d](\d{1,2})[./\\-](\d{1,2})[./\\-](\d{4})[^\d]"
    d = f"regexp_replace({t}, '\\D', '', 'g')"
    drop = f"substr({d}, 1, k - 1) || substr({d}, k + 1)"
    tries = f"list_concat(list_filter([1,2,3,4,5,6,7,8], lambda k: substr({d}, k, 1) = substr({d}, k + 1, 1)), [1,2,3,4,5,6,7,8,9])"
    good = f"list_filter(list_transform(list_transform({tries}, lambda k: {drop}), lambda e: {real_sql(eight_sql('e'), 1900, 2100)}), lambda g: g IS NOT NULL)[1]"
    return f"coalesce(CASE WHEN regexp_matches({padded}, {q(p)}) THEN {real_sql('(' + dmy_sql(padded, p) + ')', 1900, 2100)} END, CASE length({d}) WHEN 8 THEN {real_sql('(' + eight_sql(d) + ')', 1900, 2100)} WHEN 9 THEN {good} END)"


def line_date_sql(c: str, checked: bool = False) -> str:
    p = r"\b(\d{1,2})[/-](\d{1,2})[/-](\d{4})\b"
    whole = f"({dmy_sql(c, p)})"
    test = f"try_strptime({whole}, '%d/%m/%Y') IS NOT NULL" if checked else f"substr({whole}, 1, 2) BETWEEN '01' AND '31' AND substr({whole}, 4, 2) BETWEEN '01' AND '12' AND substr({whole}, 7) >= '1900'"
    return f"CASE WHEN regexp_matches({c}, {q(p)}) AND {test} THEN {whole} END"


FIELD_DATE = r"(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})"
LAYOUT_DATE = r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b"
FD, LD = "translate(value, 'OoIilh', '00111/')", "regexp_replace(translate(trim(value), '.-\\', '///'), '\\s*/\\s*', '/', 'g')"


@query(f"""WITH {V.CANDIDATES_SQL}, c AS (SELECT * FROM candidates WHERE field IN ('dateOfBirth', 'dateOfExpiry')),
w AS (SELECT *, {FD} AS fd, {LD} AS ld FROM c), x AS (SELECT *, ({dmy_sql('fd', FIELD_DATE)}) AS fdate, ({dmy_sql('ld', LAYOUT_DATE)}) AS ldate, regexp_replace(fd, '\\D', '', 'g') AS fdig, regexp_replace(ld, '\\D', '', 'g') AS ldig FROM w)
SELECT doc_id, field, source, {fusion_date_sql('value')} AS fusion,
 CASE WHEN regexp_matches(fd, {q(FIELD_DATE)}) THEN {real_sql('fdate')} WHEN length(fdig) = 8 THEN {real_sql('(' + eight_sql('fdig') + ')')} END AS field_,
 CASE WHEN regexp_matches(ld, {q(LAYOUT_DATE)}) THEN CASE WHEN substr(ldate, 1, 2) BETWEEN '01' AND '31' AND substr(ldate, 4, 2) BETWEEN '01' AND '12' AND substr(ldate, 7) BETWEEN '1900' AND '2199' THEN ldate END WHEN length(ldig) = 8 THEN {eight_sql('ldig')} END AS layout,
 {line_date_sql('value')} AS line, {line_date_sql('value', True)} AS expiry,
 nullif(regexp_extract(regexp_replace(regexp_replace(translate(value, 'OoIl', '0011'), '(\\d{{2}})/(\\d{{2}})1(\\d{{4}})', '\\1/\\2/\\3', 'g'), '(\\d{{2}})/(\\d{{2}})(\\d{{4}})', '\\1/\\2/\\3', 'g'), '\\b\\d{{2}}/\\d{{2}}/\\d{{4}}\\b'), '') AS legacy FROM x""")
def t6_dates(spark, sf_dir):
    some = V.candidates(spark, sf_dir).where("field IN ('dateOfBirth', 'dateOfExpiry')")
    return some.select("doc_id", "field", "source", *(X.clean_date("value", p).alias("field_" if p == "field" else p) for p in ("fusion", "field", "layout", "line", "expiry", "legacy")))


@query(f"""WITH {V.CANDIDATES_SQL}, c AS (SELECT *, regexp_replace(translate(value, 'OoIl|', '00111'), '\\D', '', 'g') AS a, regexp_replace(translate(value, 'OoIiLl', '001111'), '\\D', '', 'g') AS b, regexp_replace(translate(upper(value), 'OILSB', '01158'), '\\D', '', 'g') AS l FROM candidates WHERE field = 'idNumber')
SELECT doc_id, source, nullif(regexp_extract(a, '\\d{{12}}'), '') AS fusion, nullif(regexp_extract(b, '^\\d{{12}}$'), '') AS field_, CASE WHEN regexp_matches(l, '\\d{{12}}') THEN regexp_extract(l, '\\d{{12}}') ELSE l END AS layout FROM c""")
def t7_ids(spark, sf_dir):
    some = V.candidates(spark, sf_dir).where("field = 'idNumber'")
    return some.select("doc_id", "source", *(X.clean_id("value", p).alias("field_" if p == "field" else p) for p in ("fusion", "field", "layout")))


FOLD = "replace(replace(strip_accents({c}), 'đ', 'd'), 'Đ', 'D')"
NOT_NAMES = "[" + ", ".join(map(q, T.NOT_NAMES)) + "]"


@query(f"""WITH {V.CANDIDATES_SQL}, c AS (SELECT *, regexp_extract_all(regexp_replace(value, {q('(?s)' + T.STOP_LABEL + '.*$')}, '', 'i'), '\\pL+') AS w, regexp_extract_all(value, '\\pL+') AS fw FROM candidates WHERE field = 'fullName'),
k AS (SELECT *, list_filter(w, lambda x: NOT list_contains({NOT_NAMES}, upper({FOLD.format(c='x')})) AND length(x) > 1) AS kw FROM c)
SELECT doc_id, source, CASE WHEN len(kw) BETWEEN 2 AND 7 THEN upper(array_to_string(kw, ' ')) END AS fusion, CASE WHEN len(fw) >= 2 AND length(array_to_string(fw, ' ')) >= 3 THEN upper(array_to_string(fw, ' ')) END AS field_ FROM k""")
def t8_names(spark, sf_dir):
    some = V.candidates(spark, sf_dir).where("field = 'fullName'")
    return some.select("doc_id", "source", X.clean_name("value", "fusion").alias("fusion"), X.clean_name("value", "field").alias("field_"))


def fusion_name_sql(c: str) -> str:
    words = f"regexp_extract_all(regexp_replace({c}, {q('(?s)' + T.STOP_LABEL + '.*$')}, '', 'i'), '\\pL+')"
    kept = f"list_filter({words}, lambda z: NOT list_contains({NOT_NAMES}, upper({FOLD.format(c='z')})) AND length(z) > 1)"
    return f"CASE WHEN len({kept}) BETWEEN 2 AND 7 THEN upper(array_to_string({kept}, ' ')) END"


def gender_sql(c: str, words=T.FEMALE_WORDS) -> str:
    w = f"regexp_replace(lower({FOLD.format(c=c)}), '[^a-z]', '', 'g')"
    return f"CASE WHEN {w} IN ({', '.join(map(q, words))}) THEN 'Nữ' WHEN {w} IN ('nam', 'male') THEN 'Nam' END"


@query(f"WITH {V.CANDIDATES_SQL} SELECT doc_id, source, {gender_sql('value')} AS fusion, CASE WHEN regexp_matches(upper(value), '\\bNAM\\b') THEN 'Nam' WHEN contains(upper(value), 'NU') OR contains(upper(value), 'NỮ') THEN 'Nữ' END AS legacy FROM candidates WHERE field = 'gender'")
def t9_gender(spark, sf_dir):
    some = V.candidates(spark, sf_dir).where("field = 'gender'")
    return some.select("doc_id", "source", X.canon_gender("value", "fusion").alias("fusion"), X.canon_gender("value", "legacy").alias("legacy"))


def nation_sql(c: str) -> str:
    return f"CASE WHEN regexp_matches(regexp_replace(lower({FOLD.format(c=c)}), '[^a-z]', '', 'g'), 'vietna[mn]') THEN 'Việt Nam' END"


@query(f"""WITH {V.CANDIDATES_SQL} SELECT doc_id, source, {nation_sql('value')} AS fusion, CASE WHEN regexp_matches(lower({FOLD.format(c='value')}), '\\b(viet\\s*nam|vict\\s*nam|viet\\s*nana|vict\\s*nana|vietnam)\\b') THEN 'Việt Nam' ELSE nullif(array_to_string(regexp_extract_all(value, '\\pL+'), ' '), '') END AS field_ FROM candidates WHERE field = 'nationality'""")
def t10_nationality(spark, sf_dir):
    some = V.candidates(spark, sf_dir).where("field = 'nationality'")
    return some.select("doc_id", "source", X.canon_nationality("value", "fusion").alias("fusion"), X.canon_nationality("value", "field").alias("field_"))


def line_address_sql(c: str) -> str:
    c = f"regexp_replace({c}, '(?:co|c[o0])\\s*[g9]ia\\s*(?:tri|t[1il])\\s*den\\s*\\d{{1,2}}[/-]\\d{{1,2}}[/-]\\d{{4}}', ' ', 'gi')"
    return f"trim(regexp_replace(regexp_replace(regexp_replace({c}, '\\s+([,.;])', '\\1', 'g'), '[,;]\\s*[,;]+', ', ', 'g'), '\\s+', ' ', 'g'), ' ,.;:-')"


def fusion_address_sql(c: str) -> str:
    """For readings without expiry labels and dates."""
    kept = f"list_filter(regexp_split_to_array({c}, '[,;]'), lambda p: trim(p, ' :/-') <> '')"
    text = f"regexp_replace(array_to_string({kept}, ', '), {q('(?:que' + chr(92) + 's*quan|' + T.ORIGIN_EN + '|' + T.RESIDENCE_VI + '|' + T.RESIDENCE_EN + ')' + chr(92) + 's*:?')}, ' ', 'gi')"
    return f"nullif(trim(regexp_replace(regexp_replace(regexp_replace({text}, '\\s*,\\s*', ', ', 'g'), ',(?:\\s*,)+', ', ', 'g'), '\\s+', ' ', 'g'), ' ,/:;-'), '')"


FA = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(value, ';', ','), '\\s+([,.:])', '\\1', 'g'), ',\\s*,+', ', ', 'g'), '\\s*,\\s*', ', ', 'g'), '\\s+', ' ', 'g'), ' ,.;:/-')"


@query(f"WITH {V.CANDIDATES_SQL} SELECT doc_id, field, source, {fusion_address_sql('value')} AS fusion, {line_address_sql('value')} AS line, CASE WHEN length({FA}) >= 3 THEN {FA} END AS field_ FROM candidates WHERE field LIKE 'place%'")
def t11_addresses(spark, sf_dir):
    some = V.candidates(spark, sf_dir).where("field LIKE 'place%'")
    return some.select("doc_id", "field", "source", *(X.clean_address("value", p).alias("field_" if p == "field" else p) for p in ("fusion", "line", "field")))


@query(f"""WITH {NORMAL_SQL} SELECT doc_id, line_no::INT AS line_no, {squeeze_sql(f"regexp_replace(regexp_replace(line, {q(T.BIRTH_LABEL)}, ' ', 'gi'), '^[\\s:/,;.\\-]+', '')")} AS anywhere,
 trim(regexp_extract(line, {q('(?is)^.*?' + T.BIRTH_LABEL + '(.*)$')}, 1), ' :;,/-') AS after_, trim(regexp_extract(line, {q('(?is)^(.*?)' + T.BIRTH_LABEL)}, 1), ' :;,/-') AS before_ FROM lines""")
def t12_labels(spark, sf_dir):
    lines = lines_of(spark, sf_dir)
    return lines.select("doc_id", "line_no", X.strip_labels("line", "dateOfBirth").alias("anywhere"), X.strip_labels("line", "dateOfBirth", "after").alias("after_"), X.strip_labels("line", "dateOfBirth", "before").alias("before_"))


# an e with acute accent as the code page 437 shows its two UTF-8 bytes; a text with any other accent has no way back
ONLY_ACUTE = "regexp_matches(text, '^[\\x00-\\x7Fé]*$')"


@query(f"SELECT doc_id, md5(CASE WHEN {ONLY_ACUTE} THEN text ELSE replace(text, 'é', '├⌐') END) AS repaired FROM documents")
def t13_mojibake(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.md5(X.repair_mojibake(F.replace("text", F.lit("é"), F.lit("├⌐")))).alias("repaired"))


@query("SELECT doc_id, CASE WHEN lower(trim(source)) NOT IN ('', 'none', 'null', 'unknown', 'not found') THEN trim(source) END AS source, CASE WHEN lower(trim(lang)) NOT IN ('', 'none', 'null', 'unknown', 'not found') THEN trim(lang) END AS lang FROM documents")
def t14_null_tokens(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", X.null_tokens("source").alias("source"), X.null_tokens("lang").alias("lang"))


@query("SELECT doc_id, (length(text) - length(regexp_replace(text, '[à-öø-ÿÀ-ÖØ-Þ]', '', 'g')) - (length(text) - length(regexp_replace(text, '[æøðþÆØÐÞ÷×]', '', 'g'))))::BIGINT AS score FROM documents")
def t15_diacritics(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", X.diacritic_score("text").cast("long").alias("score"))


ALIASES_SQL = "alias(field, alias, pos, least) AS (VALUES " + ", ".join(f"({q(f)}, {q(a)}, {k}, {T.MIN_SIMILARITY_ID if f == 'idNumber' else T.MIN_SIMILARITY})" for f, names in T.ALIASES.items() for k, a in enumerate(names)) + ")"


def key_sql(c: str, glue: str = " ") -> str:
    return f"trim(regexp_replace(lower({FOLD.format(c=c)}), '[^a-z0-9]+', '{glue}', 'g'))"


def similarity_sql(x: str, y: str, u: str, v: str) -> str:
    ratio = lambda a, b: f"1 - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b}))"
    inside = lambda a, b: f"CASE WHEN contains({a}, {b}) OR contains({b}, {a}) THEN least(length({a}), length({b}))::DOUBLE / greatest(length({a}), length({b})) ELSE 0 END"
    return f"CASE WHEN {x} = '' OR {y} = '' THEN 0 WHEN {x} = {y} OR {u} = {v} THEN 1 ELSE greatest({ratio(x, y)}, {ratio(u, v)}, {inside(x, y)}, {inside(u, v)}) END"


@query(f"""WITH {NORMAL_SQL}, {ALIASES_SQL}, t AS (SELECT DISTINCT trim(split_part(line, ':', 1)) AS text FROM lines),
k AS (SELECT text, field, alias, {key_sql('text')} AS x, {key_sql('alias')} AS y, {key_sql('text', '')} AS u, {key_sql('alias', '')} AS v, least FROM t, alias WHERE text <> ''),
s AS (SELECT text, field, alias, {similarity_sql('x', 'y', 'u', 'v')} AS s, least FROM k) SELECT text, field, alias, round(s, 6)::DOUBLE AS similarity FROM s WHERE s >= least""")
def t16_similarity(spark, sf_dir):
    texts = lines_of(spark, sf_dir).select(F.trim(F.split_part("line", F.lit(":"), F.lit(1))).alias("text"))
    return A.label_scores(texts, A.label_table(spark), "levenshtein").select("text", "field", "alias", F.round("similarity", 6).alias("similarity"))


# ---- profiles that the queries above leave out

def _prefix_sql(c: str, names: tuple[str, ...]) -> str:
    for a in names:
        c = f"regexp_replace({c}, {q('^' + chr(92) + 's*' + X.quoted(a) + chr(92) + 's*[:/' + chr(92) + '-]*' + chr(92) + 's*')}, '', 'i')"
    return c


def line_name_sql(c: str) -> str:
    text = squeeze_sql(f"regexp_replace(regexp_replace({c}, {q(T.STOP_LABEL_LINE)}, ' ', 'gi'), '[^{LET}\\s]', ' ', 'g')")
    kept = f"list_filter(string_split({text}, ' '), lambda w: length(w) > 1 AND NOT list_contains([{', '.join(map(q, T.NOT_NAMES_LINE))}], upper(w)))"
    return f"CASE WHEN len({kept}) BETWEEN 2 AND 7 THEN upper(array_to_string({kept}, ' ')) END"


@query(f"""WITH {V.CANDIDATES_SQL} SELECT doc_id, source, {line_name_sql('value')} AS line, upper({squeeze_sql(f"regexp_replace(value, '[^{LET}{chr(92)}s]', '', 'g')")}) AS legacy,
 trim({squeeze_sql(f"regexp_replace({_prefix_sql('trim(value)', T.ALIASES['fullName'])}, '[^{LET}{chr(92)}s''-]', ' ', 'g')")}, ' :-/') AS layout FROM candidates WHERE field = 'fullName' AND value IS NOT NULL""")
def t8_profiles(spark, sf_dir):
    some = V.candidates(spark, sf_dir).where("field = 'fullName' AND value IS NOT NULL")
    return some.select("doc_id", "source", *(X.clean_name("value", p).alias(p) for p in ("line", "legacy", "layout")))


GENDER_WORD = f"regexp_replace(lower({_prefix_sql('trim(value)', T.ALIASES['gender'])}), '[^a-zà-ỹđ]', '', 'g')"


@query(f"""WITH {V.CANDIDATES_SQL}, g AS (SELECT *, {GENDER_WORD} AS w FROM candidates WHERE field = 'gender') SELECT doc_id, source, {gender_sql('value', [w for w in T.FEMALE_WORDS if w != 'nuu'])} AS field_,
 CASE WHEN w IN ('nam', 'male') THEN 'Nam' WHEN w IN ('nu', 'nữ') OR contains(w, 'female') THEN 'Nữ' WHEN contains(w, 'male') THEN 'Nam' WHEN contains(w, 'nu') THEN 'Nữ' WHEN contains(w, 'nam') THEN 'Nam' ELSE {squeeze_sql('value')} END AS layout FROM g""")
def t9_profiles(spark, sf_dir):
    some = V.candidates(spark, sf_dir).where("field = 'gender'")
    return some.select("doc_id", "source", X.canon_gender("value", "field").alias("field_"), X.canon_gender("value", "layout").alias("layout"))


NATION_LAYOUT = f"trim({squeeze_sql(_prefix_sql('trim(value)', T.ALIASES['nationality']))}, ' :-/')"


@query(f"""WITH {V.CANDIDATES_SQL}, n AS (SELECT *, {NATION_LAYOUT} AS lv, regexp_replace(lower({FOLD.format(c='value')}), '[^a-z]', '', 'g') AS w FROM candidates WHERE field = 'nationality')
SELECT doc_id, source, CASE WHEN regexp_matches(upper(value), 'VIET|VICT|NANA') THEN 'Việt Nam' END AS legacy, CASE WHEN regexp_matches(w, 'vietna[mn]') OR w IN ('vn', 'vnm') THEN 'Việt Nam' WHEN length(w) >= 4 THEN {squeeze_sql('value')} END AS v1,
 CASE WHEN regexp_replace(lower(lv), '[^a-z]', '', 'g') IN ('vietnam', 'vietnan', 'vietnarn', 'victnam') THEN 'Việt Nam' ELSE lv END AS layout FROM n""")
def t10_profiles(spark, sf_dir):
    some = V.candidates(spark, sf_dir).where("field = 'nationality'")
    return some.select("doc_id", "source", *(X.canon_nationality("value", p).alias(p) for p in ("legacy", "v1", "layout")))


@query(f"""WITH {NORMAL_SQL}, f AS (SELECT *, CASE WHEN regexp_matches(line, {q(T.BIRTH_LABEL)}, 'i') THEN regexp_extract(line, {q('(?is)^(.*?)' + T.BIRTH_LABEL)}, 1) || regexp_extract(line, {q('(?is)^.*?' + T.BIRTH_LABEL + '(.*)$')}, 1) ELSE line END AS r FROM lines)
SELECT doc_id, line_no::INT AS line_no, trim(regexp_replace(regexp_replace(r, '(?i)^\\s*/?\\s*(?:full\\s*name|date\\s*of\\s*birth|sex|nationality|place\\s*of\\s*origin|place\\s*of\\s*residence)\\s*:?\\s*', ''), '^[\\s:;/,-]+', '')) AS first_,
 {_prefix_sql('trim(line)', T.ALIASES['dateOfBirth'])} AS prefix FROM f""")
def t12_modes(spark, sf_dir):
    lines = lines_of(spark, sf_dir)
    return lines.select("doc_id", "line_no", X.strip_labels("line", "dateOfBirth", "first").alias("first_"), X.strip_labels("line", "dateOfBirth", "prefix").alias("prefix"))


@query("""WITH n AS (SELECT *, CASE WHEN lower(trim(source)) NOT IN ('', 'none', 'null', 'unknown', 'not found') THEN trim(source) END AS s, translate(upper(text), 'OILSB', '01158') AS d FROM documents)
SELECT 'source' AS column_name, 1 AS step, 'null_tokens' AS rule, count(*) AS rows, count(*) FILTER (source IS DISTINCT FROM s) AS changed, count(*) FILTER (source IS NOT NULL AND s IS NULL) AS nulled FROM n
UNION ALL SELECT 'text', 1, 'digits', count(*), count(*) FILTER (text IS DISTINCT FROM d), count(*) FILTER (text IS NOT NULL AND d IS NULL) FROM n""")
def clean_columns_report(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return clean_columns(docs, {"source": [("null_tokens",)], "text": [("digits", "layout")]})[1]
