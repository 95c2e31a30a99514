"""Earlier profiles, the cleaning job, the gestalt ratio on whole tables, and brute force on random boxes."""

import random
from difflib import SequenceMatcher

import pytest
from pergament.functions import tables as T
from pergament.functions import text as X
from pergament.functions.numbers import rounded
from pergament.operators import boxes as B
from pergament.operators import fusion as Fu
from pergament.operators import labels as A
from pergament.operators import lines as L
from pergament.operators.cleaning import clean_columns
from pergament.plans import text_queries as TQ
from pergament.sources import io as S
from pyspark.sql import functions as F


def values(spark, texts, f):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, v string").select("k", f(F.col("v")).alias("x")).collect()
    return [r["x"] for r in sorted(rows, key=lambda r: r["k"])]


def test_earlier_dates(spark):
    texts = ["sinh 24031995 nam", "so 240311995 cuoi", "24/03/1995", "9924031995", "nothing", None, "x 32131990 y", "a 12345678901234 b 01011990"]
    got = values(spark, texts, lambda c: X.clean_date(c, "fusion_v1"))
    assert got[:3] == ["24/03/1995", "24/03/1995", "24/03/1995"] and got[4:7] == [None, None, None] and got[7] == "01/01/1990"


def test_recovered_birth_tries_every_label(spark):
    rows = [
        (1, "Ngay sinh 01/02/1990 Date of birth 03/04/1991 Ngay sinh x"), (2, "Ngay sinh 01/02/1990 Date of birth none Ngay sinh none"),
        (3, "05/06/1992 Ngay sinh"), (4, "Ngày sinh / Date of birth: 24/0311995"), (5, "no label 01/01/1990"),
    ]
    lines = spark.createDataFrame([(i, 0, t) for i, t in rows], "doc_id long, line_no int, line string")
    got = {r["doc_id"]: r["dateOfBirth"] for r in L.labelled_date(lines, recover=True).collect()}
    assert got == {1: "03/04/1991", 2: "01/02/1990", 3: "05/06/1992", 4: "24/03/1995", 5: None}


def test_earlier_line_rules(spark):
    lines = spark.createDataFrame([(1, 0, "TRAN VAN AN"), (1, 1, "Ho va ten / Full name:"), (1, 2, "LE THI LAN"), (1, 3, "x 05/06/1992")], "doc_id long, line_no int, line string")
    assert L.labelled_name(lines, simple=True).first()["fullName"] == "LE THI LAN"
    assert L.labelled_name(lines).first()["fullName"] == "TRAN VAN AN"
    assert L.labelled_date(lines, unlabelled=True).first()["dateOfBirth"] == "05/06/1992"


def test_earlier_fusion(spark):
    rows = [
        (1, "fullName", "FIELD_OCR", "tran van an"), (1, "fullName", "FULL_CARD_OCR", "LE LAN"), (1, "dateOfBirth", "FIELD_OCR", "99/99/1990"), (1, "dateOfBirth", "RAW_TEXT_RECOVERY", "sinh 24031995 nam"),
        (1, "gender", "FULL_CARD_OCR", "nam"), (1, "nationality", "FIELD_OCR", "vn"), (1, "idNumber", "RAW_TEXT_RECOVERY", "001095010001"),
    ]
    got = {r["field"]: (r["value"], r["source"]) for r in Fu.fuse_v1(spark.createDataFrame(rows, "doc_id long, field string, source string, value string")).collect()}
    assert got["fullName"] == ("TRAN VAN AN", "FIELD_OCR") and got["dateOfBirth"] == ("24/03/1995", "RAW_TEXT_RECOVERY")
    assert got["gender"] == ("nam", "FULL_CARD_OCR") and got["nationality"] == (T.COUNTRY, "FIELD_OCR") and got["idNumber"] == (None, "NOT_FOUND")


def test_earlier_rows_and_segments(spark):
    rng = random.Random(4)
    rows = []
    for doc in range(6):
        for k in range(25):
            x, y = rng.randrange(0, 900), rng.randrange(0, 300)
            rows.append((doc, k, f"w{k}", float(x), float(y), float(x + rng.randrange(20, 90)), float(y + rng.randrange(10, 40)), 0.5))
    boxes = spark.createDataFrame(rows, "doc_id long, box_id long, text string, left double, top double, right double, bottom double, confidence double")
    got = {(r["doc_id"], r["box_id"]): r["row_id"] for r in B.group_rows(boxes, mode="centre").collect()}
    for doc in range(6):
        groups: list[list[tuple]] = []
        for r in sorted((r for r in rows if r[0] == doc), key=lambda r: (r[4], r[3], r[1])):
            centre, tall = (r[4] + r[6]) / 2, r[6] - r[4]
            for g in groups:
                mean = sum((b[4] + b[6]) / 2 for b in g) / len(g)
                if abs(centre - mean) <= 0.6 * max(sum(b[6] - b[4] for b in g) / len(g), tall):
                    g.append(r)
                    break
            else:
                groups.append([r])
        assert sorted(sorted(b[1] for b in g) for g in groups) == sorted(sorted(b for (d, b), n in got.items() if d == doc and n == m) for m in {n for (d, _), n in got.items() if d == doc})
    row = [(1, k, 1, t, float(x), 0.0, float(x + 40), 20.0, 0.5) for k, (t, x) in enumerate([("Ho ten:", 0), ("AN", 60), ("Quoc tich", 90), ("far", 400)])]
    cut = B.segment_rows(spark.createDataFrame(row, "doc_id long, box_id long, row_id long, text string, left double, top double, right double, bottom double, confidence double"), 3.5, labels=False)
    assert [r["segment_id"] for r in cut.orderBy("left").collect()] == [1, 1, 1, 2]


@pytest.mark.parametrize("compare_text", [True, False])
def test_suppression_against_brute_force(spark, compare_text):
    rng, rows = random.Random(8), []
    for doc in range(8):
        for k in range(60):
            x, y, w, h = rng.randrange(0, 60), rng.randrange(0, 40), rng.randrange(8, 30), rng.randrange(8, 20)
            rows.append((doc, k, rng.choice(["a", "A.", "b"]), float(x), float(y), float(x + w), float(y + h), rng.randrange(5) / 5))
    rows += [(9, k, "same", 0.0, 0.0, 10.0, 10.0, 0.5) for k in range(40)]

    def iou(a, b):
        both = max(min(a[5], b[5]) - max(a[3], b[3]), 0) * max(min(a[6], b[6]) - max(a[4], b[4]), 0)
        return both / ((a[5] - a[3]) * (a[6] - a[4]) + (b[5] - b[3]) * (b[6] - b[4]) - both)

    kept: list[tuple] = []
    for r in sorted(rows, key=lambda r: (-r[7], -(r[5] - r[3]) * (r[6] - r[4]), r[1])):
        key = r[2].strip(".").lower() if compare_text else ""
        if not any(k[0] == r[0] and (k[2].strip(".").lower() if compare_text else "") == key and iou(k, r) >= 0.4 for k in kept):
            kept.append(r)
    boxes = spark.createDataFrame(rows, "doc_id long, box_id long, text string, left double, top double, right double, bottom double, confidence double").repartition(5)
    got = B.suppress_duplicates(boxes, 0.4, compare_text)
    assert got.columns == boxes.columns and sorted((r["doc_id"], r["box_id"]) for r in got.collect()) == sorted((r[0], r[1]) for r in kept)
    with pytest.raises(ValueError):
        B.suppress_duplicates(boxes, 0.0)


def test_gestalt_on_a_whole_table(spark):
    """Label search by the gestalt ratio, over every line start of the cards, against the standard library."""
    texts = TQ.lines_of(spark, "/root/testdata/sf0.001").select(F.trim(F.split_part("line", F.lit(":"), F.lit(1))).alias("text")).distinct()
    labels = A.label_table(spark)
    got = {(r["text"], r["field"], r["alias"]): r["similarity"] for r in A.label_scores(texts, labels, "gestalt").collect()}
    keys = texts.select("text", X.key("text", "anchor").alias("x"), X.key("text", "compact").alias("u")).collect()
    want = {}
    for t in keys:
        for a in labels.collect():
            x, y, u, v = t["x"], a["alias_key"], t["u"], a["alias_compact"]
            if x and y:
                inside = [min(len(p), len(q)) / max(len(p), len(q)) for p, q in ((x, y), (u, v)) if p in q or q in p]
                s = 1.0 if x == y or u == v else max([SequenceMatcher(None, x, y).ratio(), SequenceMatcher(None, u, v).ratio(), *inside])
                if s >= a["min_similarity"]:
                    want[t["text"], a["field"], a["alias"]] = s
    assert len(want) > 100 and got == want
    assert values(spark, ["Ho ten", None, ""], lambda c: X.similarity(c, F.lit("Họ tên:"), "gestalt"))[::2] == [1.0, 0.0]


def test_clean_columns(spark):
    df = spark.createDataFrame([(1, " None ", "O1/02/l990", 5), (2, "a", None, 6), (3, None, "01/02/1990", 7)], "k int, name string, born string, __name_1 int")
    clean, report = clean_columns(df.drop("__name_1"), {"name": [("null_tokens",), ("key", "anchor")], "born": [("digits", "fusion"), ("date", "fusion")]})
    assert [tuple(r) for r in clean.orderBy("k").collect()] == [(1, None, "01/02/1990"), (2, "a", None), (3, None, "01/02/1990")]
    found = {(r["column_name"], r["step"]): (r["rule"], r["rows"], r["changed"], r["nulled"]) for r in report.collect()}
    assert found == {("name", 1): ("null_tokens", 3, 1, 1), ("name", 2): ("key", 3, 0, 0), ("born", 1): ("digits", 3, 1, 0), ("born", 2): ("date", 3, 0, 0)}
    empty = clean_columns(df.where("k < 0"), {"name": [("fold",)]})
    assert empty[0].count() == 0 and [tuple(r) for r in empty[1].collect()] == [("name", 1, "fold", 0, 0, 0)]
    with pytest.raises(ValueError):
        clean_columns(df, {"name": [("no such rule",)]})


def test_rounding_of_ties(spark):
    got = spark.createDataFrame([(0.12345,), (0.1 + 0.2 - 0.17655,), (-0.00005,), (None,)], "x double").select(rounded("x", 4).alias("r")).collect()
    assert [r["r"] for r in got] == [0.1235, 0.1235, -0.0001, None]


def test_result_details(spark):
    record = spark.createDataFrame([(1, *[None] * 8, True, [])], "doc_id long, " + ", ".join(f"{f} string" for f in T.FIELDS) + ", is_valid boolean, errors array<string>")
    lines = spark.createDataFrame([(1, 1, "b"), (1, 0, "a")], "doc_id long, line_no int, line string")
    full = S.with_details(record, lines=lines, metadata=spark.createDataFrame([(1, 0.5)], "doc_id long, avg_confidence double"))
    done = S.as_success_record(full).unionByName(S.as_error_record(spark.createDataFrame([(2, None)], "doc_id long, message string")), allowMissingColumns=True)
    by = {r["doc_id"]: r for r in done.collect()}
    assert by[1]["raw_text"] == ["a", "b"] and by[1]["metadata"]["avg_confidence"] == 0.5 and by[2]["raw_text"] is None and by[2]["errors"] == ["unknown error"]
