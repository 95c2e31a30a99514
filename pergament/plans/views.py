"""Views that Spark and DuckDB build from the driver tables with the same SQL expressions.

v_cards and v_candidates: identity cards made of orders, customers and nations, misread in
several ways by the order key. v_boxes: the words of documents as text boxes. v_scores,
v_faces, v_quads and v_pairs: arithmetic on lineitem, part and embeddings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Invented words for cards.
SURNAME = "NGUYEN,TRAN,LE,PHAM,HOANG,VU,DANG,BUI,DO,HO,NGO"
MIDDLE = "VAN,THI,MINH,THANH,NGOC,QUOC,HUYEN"
GIVEN = "MAU,LAN,TUNG,MAY,HUNG,DUNG,HOA,BINH,AN,LINH,SON,HA,GIANG"
PLACE = "Thai Binh,Nam Dinh,Hai Hau,Bac Giang,Dong Son,Tan Son,Hai Chau,Thanh Hoa,Phu Vang"
COMMUNE = "Xa Le Loi,Phuong Vinh Ha,Thi tran Voi,Thon Phu Tuyen,Xa Binh Thanh,Xa Vu Thu,Xom 3 Tan Lap"

#: Truth of a card, one row per order; the same text runs in both engines.
TRUTH_COLUMNS = f"""
SELECT o_orderkey AS k, n_name AS nation,
 lpad(CAST((o_orderkey * 7919 + 1000000007) % 1000000000000 AS VARCHAR(20)), 12, '0') AS id,
 split_part('{SURNAME}', ',', CAST(o_custkey % 11 + 1 AS INT)) || ' ' || split_part('{MIDDLE}', ',', CAST(o_orderkey % 7 + 1 AS INT)) || ' ' || split_part('{GIVEN}', ',', CAST(o_orderkey % 13 + 1 AS INT)) AS name,
 lpad(CAST(o_orderkey % 28 + 1 AS VARCHAR(9)), 2, '0') AS dd, lpad(CAST(o_custkey % 12 + 1 AS VARCHAR(9)), 2, '0') AS mm, CAST(1950 + o_orderkey % 55 AS VARCHAR(9)) AS yy,
 CASE WHEN o_orderkey % 2 = 0 THEN 'Nam' ELSE 'Nu' END AS sex,
 split_part('{COMMUNE}', ',', CAST(o_custkey % 7 + 1 AS INT)) AS c1, split_part('{PLACE}', ',', CAST(o_orderkey % 9 + 1 AS INT)) AS p1,
 split_part('{COMMUNE}', ',', CAST(o_orderkey % 7 + 1 AS INT)) AS c2, split_part('{PLACE}', ',', CAST(o_custkey % 9 + 1 AS INT)) AS p2"""
TRUTH_TABLES = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
TRUTH = f"{TRUTH_COLUMNS}\nFROM {TRUTH_TABLES}"
CARDS_A_TASK = 50_000
TEXTS_A_TASK = 4_000

#: Ten lines of a card with its misreadings.
CARD_LINES = [
    "CASE WHEN k % 10 = 0 THEN 'No: ' || substr(id, 1, 4) || ' ' || substr(id, 5, 4) || ' ' || substr(id, 9, 4) WHEN k % 17 = 0 THEN 'No: ' || substr(id, 1, 11) ELSE 'So / No: ' || id END",
    "CASE WHEN k % 5 = 0 THEN 'Hovaten / Full name: ' || name WHEN k % 19 = 0 THEN 'Ho va len' ELSE 'Ho va ten / Full name:' END",
    "CASE WHEN k % 5 = 0 THEN '' ELSE name END",
    "CASE WHEN k % 4 = 0 THEN 'Ngay sinh / Date of birth:' WHEN k % 9 = 0 THEN 'Ngaysinh / Date of birth: ' || dd || '/' || mm || '1' || yy ELSE 'Ngay sinh/Date of birth: ' || dd || '/' || mm || '/' || yy END",
    "CASE WHEN k % 4 = 0 THEN dd || ' / ' || mm || ' / ' || yy ELSE '' END",
    "CASE WHEN k % 6 = 0 THEN 'Gioi tinh / Sex: ' || sex || ' Quoc tich / Nationality: Viet Nam' WHEN k % 21 = 0 THEN 'Gioi tinh / Sex:' ELSE 'Gioitinh / Sex: ' || sex || ' Quoctich / Nationality: ' || CASE WHEN k % 8 = 0 THEN nation ELSE 'Vietnam' END END",
    "CASE WHEN k % 7 = 0 THEN 'Que quan / Place of origin: ' || c1 ELSE 'Que quan / Place of origin:' END",
    "CASE WHEN k % 7 = 0 THEN p1 || ', Viet Nam' ELSE c1 || ', ' || p1 || ', Viet Nam' END",
    "CASE WHEN k % 3 = 0 THEN 'Noi thuong tru / Place of residence: ' || c2 || ', ' || p2 ELSE 'Noi thuong tru / Place of residence:' END",
    "CASE WHEN k % 3 = 0 THEN 'To ' || CAST(k % 40 AS VARCHAR(9)) || ', khu pho 2' ELSE c2 || ' , ' || p2 || ',, To ' || CAST(k % 40 AS VARCHAR(9)) END",
    "CASE WHEN k % 11 = 0 THEN 'Co gia tri den' WHEN k % 12 = 0 THEN 'Date of expiry: 31-02-2030' ELSE 'Co gia tri den: ' || dd || '/' || mm || '/' || CAST(2020 + k % 20 AS VARCHAR(9)) END",
    "CASE WHEN k % 11 = 0 THEN dd || '/' || mm || '/2031' ELSE '' END",
]

#: Three readings of each field; NULL where a source has none.
READINGS = {
    "idNumber": ("id", "CASE WHEN k % 3 = 0 THEN replace(id, '0', 'O') WHEN k % 5 = 0 THEN NULL ELSE id END", "CASE WHEN k % 4 = 0 THEN 'No ' || id ELSE replace(id, '1', 'l') END"),
    "fullName": ("CASE WHEN k % 4 = 0 THEN NULL ELSE name END", "CASE WHEN k % 5 = 0 THEN 'HO' ELSE lower(name) END", "CASE WHEN k % 3 = 0 THEN replace(replace(name, 'HO ', 'HỔ '), 'VAN', 'VĂN') ELSE name || ' Ngay sinh 01' END"),
    "dateOfBirth": ("CASE WHEN k % 6 = 0 THEN NULL ELSE dd || '/' || mm || '/' || yy END", "CASE WHEN k % 4 = 0 THEN dd || mm || yy ELSE dd || '-' || mm || '-' || yy END", "CASE WHEN k % 9 = 0 THEN dd || '/' || mm || '1' || yy ELSE '32/13/1990' END"),
    "gender": ("CASE WHEN k % 3 = 0 THEN NULL ELSE sex END", "CASE WHEN k % 5 = 0 THEN 'Viet Nam' ELSE lower(sex) END", "CASE WHEN k % 2 = 0 THEN 'Male' ELSE 'Nữ' END"),
    "nationality": ("CASE WHEN k % 2 = 0 THEN 'Việt Nam' ELSE NULL END", "CASE WHEN k % 3 = 0 THEN nation ELSE 'Viet  Nam' END", "'vietnan'"),
    "placeOfOrigin": ("CASE WHEN k % 3 = 0 THEN NULL ELSE c1 || ', ' || p1 END", "CASE WHEN k % 4 = 0 THEN 'sex' ELSE c1 || '; ' || p1 || ', Viet Nam' END", "replace(replace(c1, 'Le Loi', 'Lê Lợi'), 'Vinh Ha', 'Vinh Hà') || ', ' || p1 || ', Viet Nam'"),
    "placeOfResidence": ("CASE WHEN k % 2 = 0 THEN c2 || ', ' || p2 || ', To ' || CAST(k % 10 AS VARCHAR(9)) || '8' ELSE NULL END", "c2 || ',, ' || p2 || ', To B' || CAST(k % 10 AS VARCHAR(9))", "CASE WHEN k % 5 = 0 THEN NULL ELSE replace(c2, 'Xa', 'Xã') || ', ' || p2 || ', To ' || CAST(k % 10 AS VARCHAR(9)) || 'B' END"),
    "dateOfExpiry": ("CASE WHEN k % 7 = 0 THEN NULL ELSE dd || '/' || mm || '/2031' END", "dd || '.' || mm || '.2031'", "NULL"),
}
SOURCE_ORDER = ("RAW_TEXT_RECOVERY", "FULL_CARD_OCR", "FIELD_OCR")


def load(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def card_parts(spark: SparkSession, sf_dir: str) -> int:
    """Parts in which cards and what is made of them are kept, by card."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-spark.read.parquet(f"{sf_dir}/orders.parquet").count() // CARDS_A_TASK))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dealt by card: a file of few row groups would give few tasks, and a card is a dozen lines of costly text rules.

    The number of parts grows with the cards, so what a task holds does not. Operators by doc_id find the rows in place.
    """
    load(spark, sf_dir, "orders", "customer", "nation")
    keys = spark.sql(f"SELECT o_orderkey, o_custkey, n_name FROM {TRUTH_TABLES}")
    return spark.sql(f"{TRUTH_COLUMNS} FROM {{keys}}", keys=keys.repartition(card_parts(spark, sf_dir), "o_orderkey"))


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, line), empty lines included."""
    rows = truth(spark, sf_dir).select(F.col("k").alias("doc_id"), F.posexplode(F.array(*map(F.expr, CARD_LINES))).alias("line_no", "line"))
    return rows


CARDS_SQL = f"truth AS ({TRUTH}), raw_cards AS (SELECT k AS doc_id, unnest(range(0, {len(CARD_LINES)})) AS line_no, unnest([{', '.join(CARD_LINES)}]) AS line FROM truth)"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, field, source, value)."""
    one = [f"struct('{f}' AS field, '{s}' AS source, CAST({r} AS STRING) AS value)" for f, readings in READINGS.items() for s, r in zip(SOURCE_ORDER, readings)]
    rows = truth(spark, sf_dir).select(F.col("k").alias("doc_id"), F.explode(F.array(*map(F.expr, one))).alias("c"))
    return rows.select("doc_id", "c.*")


CANDIDATES_SQL = f"truth AS ({TRUTH}), candidates AS (" + " UNION ALL ".join(f"SELECT k AS doc_id, '{f}' AS field, '{s}' AS source, CAST({r} AS VARCHAR) AS value FROM truth" for f, readings in READINGS.items() for s, r in zip(SOURCE_ORDER, readings)) + ")"


def boxes(spark: SparkSession, sf_dir: str, twice: bool = False) -> DataFrame:
    """(doc_id, box_id, line_no, word_no, text, left, top, right, bottom, confidence): the words of documents.

    twice adds a shifted copy of every seventh box with lower confidence.
    """
    # texts are dealt by document before they become boxes, so that what follows by document or line moves no box
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // TEXTS_A_TASK)), "doc_id")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    words = lines.select("doc_id", "line_no", F.filter(F.split("line", " "), lambda w: w != "").alias("w"))
    w = F.posexplode("w").alias("word_no", "text")
    flat = words.select("doc_id", "line_no", w)

    before = F.coalesce(F.sum(F.length("text") + 1).over(Window.partitionBy("doc_id", "line_no").orderBy("word_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = flat.withColumn("left", 8.0 * before).select(
        "doc_id", (F.col("line_no") * 100000 + F.col("word_no")).cast("long").alias("box_id"), "line_no", "word_no", "text", "left", (24.0 * F.col("line_no")).alias("top"),
        (F.col("left") + 8.0 * F.length("text")).alias("right"), (24.0 * F.col("line_no") + 20.0).alias("bottom"), (((F.col("doc_id") * 31 + F.col("line_no") * 7 + F.col("word_no") * 13) % 100) / 100.0).alias("confidence"),
    )
    if not twice:
        return out
    # both at once: a union would make all boxes twice
    moved = {"box_id": F.col("box_id") + 50000, "left": F.col("left") + 1, "right": F.col("right") + 1, "confidence": F.col("confidence") / 2}
    own, copy = (F.struct(*(made.get(c, F.col(c)).alias(c) for c in out.columns)) for made in ({}, moved))
    return out.select(F.explode(F.when(F.expr("(line_no + word_no) % 7 = 0"), F.array(own, copy)).otherwise(F.array(own))).alias("b")).select("b.*")


BOXES_SQL = """lines0 AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents),
words0 AS (SELECT doc_id, line_no, list_filter(string_split(line, ' '), lambda x: x <> '') AS w FROM lines0),
flat0 AS (SELECT doc_id, line_no, unnest(range(0, len(w))) AS word_no, unnest(w) AS text FROM words0),
at0 AS (SELECT *, 8.0::DOUBLE * coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, line_no ORDER BY word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM flat0),
boxes AS MATERIALIZED (SELECT doc_id, line_no * 100000 + word_no AS box_id, line_no, word_no, text, l AS "left", 24.0::DOUBLE * line_no AS top, l + 8.0::DOUBLE * length(text) AS "right", 24.0::DOUBLE * line_no + 20 AS bottom, ((doc_id * 31 + line_no * 7 + word_no * 13) % 100) / 100.0::DOUBLE AS confidence FROM at0)"""
BOXES_TWICE_SQL = BOXES_SQL + """, boxes2 AS MATERIALIZED (SELECT * FROM boxes UNION ALL SELECT doc_id, box_id + 50000, line_no, word_no, text, "left" + 1, top, "right" + 1, bottom, confidence / 2 FROM boxes WHERE (line_no + word_no) % 7 = 0)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject_id, probe_id, enrolled, embedding): a neighbour of the same label, mixed into the enrolled vector."""
    load(spark, sf_dir, "embeddings")
    both = spark.sql("SELECT vec_id AS subject_id, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS probe_id, embedding AS enrolled, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS other FROM embeddings").where("probe_id IS NOT NULL")
    share = F.when(F.col("subject_id") % 3 == 0, 0.6).when(F.col("subject_id") % 3 == 1, 0.33).otherwise(0.0)
    mixed = F.zip_with("enrolled", "other", lambda a, b: share * a.cast("double") + (1 - share) * b.cast("double"))
    return both.select("subject_id", "probe_id", "enrolled", mixed.alias("embedding"))


PAIRS_SQL = """nb AS (SELECT vec_id AS subject_id, lead(vec_id) OVER w AS probe_id, embedding AS enrolled, lead(embedding) OVER w AS other FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
pairs AS (SELECT subject_id, probe_id, list_transform(enrolled, lambda x: x::DOUBLE) AS enrolled, list_transform(range(1, len(enrolled) + 1), lambda i: CASE subject_id % 3 WHEN 0 THEN 0.6::DOUBLE WHEN 1 THEN 0.33::DOUBLE ELSE 0 END * enrolled[i]::DOUBLE + (1 - CASE subject_id % 3 WHEN 0 THEN 0.6::DOUBLE WHEN 1 THEN 0.33::DOUBLE ELSE 0 END) * other[i]::DOUBLE) AS embedding FROM nb WHERE probe_id IS NOT NULL)"""
